"""Spelling variants: words that differ by one code point, found by bit-sliced position indexes.

Two words one edit apart agree on all that lies before the edit and all that lies
behind it. For a shorter length m the place of the edit lies in one of two ranges
of 0..m; words of m and m + 1 code points meet in the bucket of a range if they
agree on everything outside it, so each pair meets in exactly one bucket, the one
whose range holds the first place where the words differ. A bucket of very many
words is dealt anew with its range halved, until it is small or the range is one
place wide, where the alphabet bounds it.

Inside a bucket 64 words are the bits of one machine word. Per position and letter
a bitset says which words have that letter there. A query of length m is read once:
its zero-error set is met with the bitset of each letter in turn, and two one-error
sets run along, one after a replaced letter, one shifted by a position after a
letter that only the longer word has. (A letter too few is a letter too many, read
from the other word.) All queries of a batch take each step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import attach, settle

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shorter words and rarer ones are no words of the vocabulary.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many occurrences loses a code point.
SLIP = 31
#: A form occurs at least so many times as often as the word.
RATIO = 10
#: Buckets of more words are dealt anew.
BUCKET = 4_096
#: Pairs of a query and 64 words that are read at once.
LANES = 1 << 17
U = np.uint64
_ALL = U(0xFFFFFFFFFFFFFFFF)


def occurrences(docs: DataFrame, slip: int = SLIP, least: int = LEAST_LENGTH) -> DataFrame:
    """One row per occurrence of a word (`word`) of at least `least` code points.

    Words are maximal runs of `LETTERS`, with A-Z lower-cased. With `slip`, an
    occurrence whose CRC-32 of '<doc_id>:<word>' is divisible by it loses the code
    point at that number modulo its length. Runs shorter than `least` can't
    become words and are skipped by the pattern.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{{least},}}+)"), F.lit(1))).alias("run"))
    run = found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    if not slip:
        return run.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    place = (F.col("h") % F.length("run")).cast("int")
    slipped = F.overlay("run", F.lit(""), place + 1, F.lit(1))
    word = F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run"))
    return run.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words with their number of rows, `least_count` at least."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _in_range(m: Column, lo: Column, hi: Column) -> Column:
    """A word's membership in the bucket of length `m` and places `lo` to `hi` - 1."""
    tail = F.greatest(m - hi, F.lit(0))
    key = F.xxhash64(m, lo, hi, F.substring("word", F.lit(1), lo), F.when(tail > 0, F.right("word", tail)).otherwise(F.lit("")))
    return F.struct(m.alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), key.alias("bucket"))


def _dealt(rows: DataFrame, ranges: list[tuple]) -> DataFrame:
    places = rows.select("word", "n", F.explode(F.array(*[_in_range(*r) for r in ranges])).alias("x"))
    return places.select("word", "n", "x.*")


def memberships(vocab: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi, bucket): every word in the two ranges of its length and of the length before."""
    rows = vocab.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    m = F.col("m")
    middle = F.floor((m + 1) / 2).cast("int")
    return _dealt(rows, [(m, F.lit(0), middle), (m, middle, m + 1)])


def _refined(rows: DataFrame) -> DataFrame:
    m, lo, hi = F.col("m"), F.col("lo"), F.col("hi")
    middle = F.floor((lo + hi) / 2).cast("int")
    return _dealt(rows, [(m, lo, middle), (m, middle, hi)])


def buckets(vocab: DataFrame, most: int = BUCKET) -> DataFrame:
    """Memberships whose buckets hold at most `most` words, or one place of difference."""
    rows, ready = memberships(vocab), None
    while True:
        wide = rows.filter(F.col("hi") - F.col("lo") > 1)
        large = settle(wide.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most).select("bucket"), "large-buckets")
        if large.isEmpty():
            return rows if ready is None else ready.unionByName(rows)
        small = attach(rows, large, "bucket", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        rows = settle(_refined(attach(rows, large, "bucket", "left_semi")), "refined-buckets")


def _found(sets: np.ndarray, tile: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, found row) for the bits of each lane's set."""
    some = np.flatnonzero(sets)
    bits = np.unpackbits(sets[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lane, bit = np.nonzero(bits)
    return query[some[lane]], tile[some[lane]] * 64 + bit


def near_rows(codes: np.ndarray, offsets: np.ndarray, bucket: np.ndarray, m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, near row), both ways, for words in runs of equal `bucket`.

    Word i is codes[offsets[i]:offsets[i + 1]]; all have m or m + 1 code points.
    Pairs are those one edit apart whose common beginning is lo to hi - 1 long.
    """
    rows = len(bucket)
    length = np.diff(offsets)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    size = np.diff(edges)
    first, last = np.repeat(edges[:-1], size), np.repeat(edges[1:], size)
    asks = np.flatnonzero((length == m) & (last - first > 1))
    if not len(asks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters, letter = np.unique(codes, return_inverse=True)
    own_tile, bit = np.arange(rows) // 64, U(1) << (np.arange(rows) % 64).astype(U)
    tiles = own_tile[-1] + 1

    def plane(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tile: the words with each letter at place i, and those with any."""
        some = np.flatnonzero(length > i)
        of_letter, of_any = np.zeros((tiles, len(letters)), U), np.zeros(tiles, U)
        np.bitwise_or.at(of_letter, (own_tile[some], letter[offsets[some] + i]), bit[some])
        np.bitwise_or.at(of_any, own_tile[some], bit[some])
        return of_letter, of_any

    of_length = [np.zeros(tiles, U), np.zeros(tiles, U)]
    for extra in (0, 1):
        some = np.flatnonzero(length == m + extra)
        np.bitwise_or.at(of_length[extra], own_tile[some], bit[some])

    spread = (last[asks] - 1) // 64 - first[asks] // 64 + 1
    query = np.repeat(asks, spread)
    tile = first[query] // 64 + np.arange(len(query)) - np.repeat(np.cumsum(spread) - spread, spread)
    low, high = np.maximum(first[query] - 64 * tile, 0), np.minimum(last[query] - 64 * tile, 64)
    zero = (_ALL << low.astype(U)) & (_ALL >> (64 - high).astype(U))

    replaced, at_lo, at_hi = np.zeros_like(zero), zero, np.zeros_like(zero)
    here = plane(0)
    added = zero & here[1][tile]
    for i in range(m):
        beyond = plane(i + 1)
        q = letter[offsets[query] + i]
        same = here[0][tile, q]
        replaced = (replaced & same) | (zero & ~same & here[1][tile])
        zero = zero & same
        added = (added & beyond[0][tile, q]) | (zero & beyond[1][tile])
        here = beyond
        at_lo = zero if i + 1 == lo else at_lo
        at_hi = zero if i + 1 == hi else at_hi
    right = at_lo & ~at_hi
    one, other = _found(replaced & of_length[0][tile] & right, tile, query)
    short, long = _found(added & of_length[1][tile] & right, tile, query)
    return np.concatenate([one, short, long]), np.concatenate([other, long, short])


RESULT = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _summed(words: list[str], counts: np.ndarray, bucket: np.ndarray, m: int, lo: int, hi: int) -> pa.RecordBatch:
    """Each word's near words in these whole buckets: how many, and the most frequent (ties: the first row)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    row, near = near_rows(codes, offsets, bucket, m, lo, hi)
    order = np.lexsort((near, -counts[near], row))
    row, near = row[order], near[order]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in row[heads]], pa.string()),
            pa.array(np.diff(np.r_[heads, len(row)]), pa.int64()),
            pa.array(counts[near[heads]], pa.int64()),
            pa.array([words[i] for i in near[heads]], pa.string()),
        ],
        schema=RESULT,
    )


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words bucket by bucket; rows come ordered by (m, lo, hi, bucket, word), and the last bucket of a batch waits for the next."""

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = [table.column(c).to_numpy() for c in ("m", "lo", "hi", "bucket")]
        words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in kind[:3]], axis=0), True]
        for a, b in zip(np.flatnonzero(new)[:-1], np.flatnonzero(new)[1:], strict=True):
            # whole buckets, so many that their lanes stay bounded
            edges = a + np.flatnonzero(np.r_[True, kind[3][a + 1 : b] != kind[3][a : b - 1], True])
            lanes = np.cumsum(np.diff(edges) * (np.diff(edges) // 64 + 2))
            turn = np.flatnonzero(np.diff(np.r_[-1, lanes // LANES]))
            for x, y in zip(edges[turn], [*edges[turn[1:]], b], strict=True):
                yield _summed(words[x:y], counts[x:y], kind[3][x:y], *(int(k[x]) for k in kind[:3]))

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        bucket = now.column("bucket").to_numpy()
        other = np.flatnonzero(bucket != bucket[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        held = now.slice(cut)
        if cut:
            yield from parts(now.slice(0, cut))
    if held is not None:
        yield from parts(held)


def near_words(vocab: DataFrame, most: int = BUCKET) -> DataFrame:
    """(word, n_near, best_n, best) for every word with a near one: how many, and the most frequent of them.

    Every bucket sends one row per word, never a pair.
    """
    dealt = buckets(vocab, most).repartition("bucket").sortWithinPartitions("m", "lo", "hi", "bucket", "word")
    found = dealt.mapInArrow(_near_words, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from settled (word, form): forms followed to the last.

    Each form is `RATIO` times as frequent as its word, so the steps are few.
    """
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        moved = now.join(step, "root", "left")
        now = settle(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def group_vocabulary(vocab: DataFrame, ratio: int = RATIO, most: int = BUCKET) -> DataFrame:
    """Words (word, n) with their form, root and near words; `vocab` is settled and its words are distinct."""
    near = settle(near_words(vocab, most), "near-words")
    joined = vocab.join(near, "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    judged = settle(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    found = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, slip: int = SLIP, most: int = BUCKET) -> DataFrame:
    """Every word of the documents' whole texts with the frequent spelling it varies.

    Words: see `occurrences` and `vocabulary`. Near words differ by exactly one
    inserted, deleted or replaced code point. `form` is the near word of largest n
    (ties: the first in code-point order) if it is `RATIO` times as frequent as the
    word, `root` the end of the chain of forms. Returns word, form, root, n,
    n_near, form_n.

    Null or empty text: no words. Null doc_id: slips are drawn from ':<word>'.
    Repeated rows: each counts. A very long run of letters is a word like any
    other; its steps are as many as its letters. Empty table: empty result.
    Further columns are ignored.
    """
    words = occurrences(docs.select("doc_id", "text"), slip)
    return group_vocabulary(settle(vocabulary(words), "vocabulary"), most=most)


SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head,
    unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]{{{LEAST_LENGTH},}}')) AS run
  FROM documents
), lowered AS (
  SELECT head, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(strlen(head || run)), lambda i: ('0x' || substr(hex(encode(head || run)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM lowered, crc
), vocab AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
      ELSE run END AS word
    FROM hashed) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cuts AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut
  FROM (SELECT word, unnest(range(length(word))) AS i FROM vocab)
), pairs AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cuts c JOIN vocab v ON v.word = c.cut
  UNION SELECT v.word, c.word FROM cuts c JOIN vocab v ON v.word = c.cut
), best AS (
  SELECT p.word, p.other, v.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN vocab v ON v.word = p.other
  QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.other) = 1
), judged AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN other_n >= {RATIO} * v.n THEN other END AS form,
    CASE WHEN other_n >= {RATIO} * v.n THEN other_n END AS form_n
  FROM vocab v LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, form AS root FROM judged WHERE form IS NOT NULL
  UNION ALL
  SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, coalesce(e.root, j.word) AS root, j.n, j.n_near, j.form_n
FROM judged j LEFT JOIN (
  SELECT c.word, c.root FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NULL) e ON e.word = j.word
"""
