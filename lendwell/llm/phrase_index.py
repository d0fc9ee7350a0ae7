"""Distributed positional inverted index, and benchmark passages found in it.

Documents are inverted where they are read. A segment is a few megabytes of whole
documents; per term it has one row with the term's places, counted over the
segment's words in order and stored as gaps. A header row per segment holds the
documents and their numbers of words, so that a place names a document and a
position in it. Building the index moves nothing.

A search sends the test terms to all tasks, in blocks of bounded size, and brings
a segment's lists of those terms together. There each phrase starts from its
rarest term: the list, shifted by the term's offset, gives places where the
phrase may begin, and the other terms' lists, shifted by their offsets, are met
with them from the rarest on. What survives the last list is an exact match. A
proximity search meets, in the same order, the spans round the rarest term's
places that hold every term in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell.llm import words
from lendwell.llm.common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Consecutive words of a test item that count as found.
WINDOW = 10
#: Bytes of text in a segment; a longer document has one of its own.
SEGMENT = 1 << 22
#: Bytes of test items that are searched for at once.
BLOCK = 2 << 20
#: Places met at once.
PLACES = 1 << 20
#: Widest span of a proximity search, in words.
SPAN_MOST = 64

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32

INDEX = pa.schema(
    [("segment", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("places", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
)
INDEX_DDL = "segment long, term string, n int, places binary, ids array<long>, lengths array<int>"
_WIDTHS = {1: np.dtype("<u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def word_spans(chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a chunk's words: runs of ASCII letters and digits and of anything beyond ASCII."""
    return chunk.spans(_BREAK[chunk.data])


def _sliced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges end to end, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)], offsets


def packed(places: np.ndarray, heads: np.ndarray) -> pa.Array:
    """Ascending places of each list (lists begin at `heads`) as gaps of 1, 2 or 4 bytes behind the width."""
    counts = np.diff(np.r_[heads, len(places)])
    gaps = np.diff(places, prepend=0)
    gaps[heads] = places[heads]
    top = np.maximum.reduceat(gaps, heads)
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))
    offsets = np.concatenate([[0], np.cumsum(1 + counts * width)])
    out = np.empty(offsets[-1], np.uint8)
    out[offsets[:-1]] = width
    wide = np.repeat(width, counts)
    at = np.repeat(offsets[:-1] + 1, counts) + (np.arange(len(places)) - np.repeat(heads, counts)) * wide
    for byte in range(4):
        some = wide > byte
        out[at[some] + byte] = (gaps[some] >> (8 * byte)) & 255
    return pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, _WIDTHS[blob[0]], offset=1), dtype=np.int64)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of a task's documents; segment numbers are told apart by the task's partition."""
    segment = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for chunk in words.chunks(batch.column("text").fill_null(""), SEGMENT):
            starts, ends = word_spans(chunk)
            lengths = np.bincount(chunk.text_of(starts), minlength=chunk.count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment], pa.int64()), pa.array([None], pa.string()), pa.array([len(starts)], pa.int32()),
                    pa.array([None], pa.binary()), pa.array([ids.slice(chunk.first, chunk.count).to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
                ],
                schema=INDEX,
            )
            if len(starts):
                hashes = chunk.hashes(starts, ends, lower=True)
                places = np.argsort(hashes, kind="stable")
                hashes = hashes[places]
                heads = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                text, offsets = _sliced(chunk.data, starts[places[heads]], ends[places[heads]])
                terms = pa.Array.from_buffers(
                    pa.large_string(), len(heads), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOW[text])]
                )
                counts = np.diff(np.r_[heads, len(places)])
                none = pa.nulls(len(heads), pa.list_(pa.int64())), pa.nulls(len(heads), pa.list_(pa.int32()))
                rows = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(heads), segment), pa.int64()), terms.cast(pa.string()), pa.array(counts, pa.int32()),
                        packed(places, heads).cast(pa.binary()), *none,
                    ],
                    schema=INDEX,
                )
                for at in range(0, rows.num_rows, 10_000):
                    yield rows.slice(at, 10_000)
            segment += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of all words of `docs` (doc_id, text): rows (segment, term, n, places), and a header a segment.

    Null or empty text: a document without words. Null doc_id and repeated rows:
    documents of their own, told apart by segment and number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(_invert, INDEX_DDL), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, doc, doc_id, n_words) for every indexed document."""
    heads = index.filter("term is null").select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("doc", "x"))
    return heads.select("segment", "doc", F.col("x.ids").alias("doc_id"), F.col("x.lengths").cast("long").alias("n_words"))


@dataclass
class Phrases:
    """Distinct windows of a block of test items.

    `terms` are sorted; window w has size[w] of them in a row of `term`, padded
    with -1, and stands in items[bounds[w]:bounds[w + 1]].
    """

    terms: list[str]
    term: np.ndarray
    size: np.ndarray
    items: np.ndarray
    bounds: np.ndarray


def phrases(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    """The windows of (item id, text): `window` consecutive words, or all of them where there are fewer."""
    found: dict[tuple[str, ...], set] = {}
    for item, text in items:
        for chunk in words.chunks(pa.array([text], pa.string())):
            low = _LOW[chunk.data].tobytes()
            said = [low[a:b].decode() for a, b in zip(*word_spans(chunk), strict=True)]
            for i in range(max(1, len(said) - window + 1) if said else 0):
                found.setdefault(tuple(said[i : i + window]), set()).add(item)
    terms = sorted({t for w in found for t in w})
    number = {t: i for i, t in enumerate(terms)}
    term = np.full((len(found), window), -1, np.int64)
    for row, w in zip(term, found, strict=True):
        row[: len(w)] = [number[t] for t in w]
    named = [sorted(x for x in s if x is not None) for s in found.values()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in named])]).astype(np.int64)
    return Phrases(terms, term, (term >= 0).sum(1), np.array([x for s in named for x in s], dtype=object), bounds)


def blocks(items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> Iterator[Phrases]:
    """Test items (item_id, text) in blocks of about `block` bytes, dealt by hash."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(1 + size // block))
    for i in range(1 + size // block):
        some = phrases([tuple(r) for r in rows.filter(number == i).toLocalIterator()], window)
        if some.terms:
            yield some


@dataclass
class Lists:
    """The lists of test terms in one segment: `key` is term << 32 | place, ascending; `edges` bound the documents."""

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    ids: list
    edges: np.ndarray

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, place, side="right") - 1

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        wanted = term << 32 | place
        at = np.searchsorted(self.key, wanted)
        return self.key[np.minimum(at, len(self.key) - 1)] == wanted


def segments(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[tuple[int, Lists]]:
    """Rows ordered by (segment, term), headers first, as lists segment by segment."""

    def made(segment: int, ids: list, lengths: list, found: list) -> tuple[int, Lists]:
        counts = np.zeros(terms, np.int64)
        for term, places in found:
            counts[term] = len(places)
        key = np.concatenate([np.zeros(0, np.int64), *(term << 32 | places for term, places in found)])
        last = np.cumsum(counts)
        return segment, Lists(key, last - counts, last, ids, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))

    now: tuple | None = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("segment", "tid", "places", "ids", "lengths"))
        for segment, term, blob, ids, lengths in zip(*columns, strict=True):
            if now is None or segment != now[0]:
                if now and now[3]:
                    yield made(*now)
                now = (segment, ids, lengths, [])
            else:
                now[3].append((term, unpacked(blob)))
    if now and now[3]:
        yield made(*now)


def _begun(lists: Lists, wanted: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, place of its rarest term, its terms' offsets from the rarest on), blocks of places at a time."""
    count = np.where(wanted.term >= 0, (lists.last - lists.first)[wanted.term], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    alive = np.flatnonzero(count.min(axis=1) > 0)
    rarest = wanted.term[alive, order[alive, 0]]
    many = lists.last[rarest] - lists.first[rarest]
    turn = (np.cumsum(many) - 1) // PLACES
    for t in np.unique(turn):
        some = turn == t
        w = np.repeat(alive[some], many[some])
        start = np.cumsum(many[some]) - many[some]
        at = np.repeat(lists.first[rarest[some]] - start, many[some]) + np.arange(len(w))
        yield w, lists.key[at] & 0xFFFFFFFF, order


def exact_places(lists: Lists, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, first place) of every occurrence inside one document."""
    out_w, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, place, order in _begun(lists, wanted):
        place = place - order[w, 0]
        w, place = w[place >= 0], place[place >= 0]
        for k in range(1, wanted.term.shape[1]):
            offset = order[w, k]
            term = wanted.term[w, offset]
            keep = (term < 0) | lists.holds(term, place + offset)
            w, place = w[keep], place[keep]
        inside = lists.document(place) == lists.document(place + wanted.size[w] - 1)
        out_w.append(w[inside])
        out_p.append(place[inside])
    return np.concatenate(out_w), np.concatenate(out_p)


def near_places(lists: Lists, wanted: Phrases, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, first place of a span) for spans of size + `slack` words of one document that hold all of a
    window's terms in any order; the first span round each place of the rarest term."""
    out_w, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, anchor, order in _begun(lists, wanted):
        span = wanted.size[w] + slack
        doc = lists.document(anchor)
        low, high = lists.edges[doc], lists.edges[doc + 1]
        # bit b: the span that begins at anchor - span + 1 + b; spans begin inside the document
        bits = np.full(len(w), words.U(0xFFFFFFFFFFFFFFFF)) >> (64 - span).astype(words.U)
        early = np.clip(low - (anchor - span + 1), 0, 63).astype(words.U)
        bits &= words.U(0xFFFFFFFFFFFFFFFF) << early
        for k in range(1, wanted.term.shape[1]):
            term = wanted.term[w, order[w, k]]
            real = term >= 0
            t = np.maximum(term, 0) << 32
            a = np.searchsorted(lists.key, t | np.maximum(anchor - span + 1, low))
            b = np.searchsorted(lists.key, t | np.minimum(anchor + span, high))
            held = np.zeros(len(w), words.U)
            for step in range(int((b - a)[real].max(initial=0))):
                some = np.flatnonzero(real & (a + step < b))
                d = (lists.key[a[some] + step] & 0xFFFFFFFF) - anchor[some]
                first, last = np.maximum(d, 0), np.minimum(span[some] - 1 + d, span[some] - 1)
                held[some] |= (words.U(0xFFFFFFFFFFFFFFFF) << first.astype(words.U)) & (
                    words.U(0xFFFFFFFFFFFFFFFF) >> (63 - last).astype(words.U)
                )
            bits = np.where(real, bits & held, bits)
            keep = bits > 0
            w, anchor, span, low, high, bits = w[keep], anchor[keep], span[keep], low[keep], high[keep], bits[keep]
        lowest = np.log2((bits & (~bits + words.U(1))).astype(np.float64)).astype(np.int64)
        out_w.append(w)
        out_p.append(anchor - span + 1 + lowest)
    return np.concatenate(out_w), np.concatenate(out_p)


MATCHES = pa.schema(
    [
        ("segment", pa.int64()), ("doc", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
    ]
)
MATCHES_DDL = "segment long, doc int, starts array<int>, ends array<int>, items array<string>"


def _matched(segment: int, lists: Lists, wanted: Phrases, w: np.ndarray, place: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Per document with matches: its disjoint stretches of matched words, and the items of the windows."""
    doc = lists.document(place)
    order = np.lexsort((place, doc))
    w, place, doc = w[order], place[order], doc[order]
    end = np.minimum(place + size[order], lists.edges[doc + 1])
    upto = np.maximum.accumulate(end)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] > upto[:-1])]
    head = np.flatnonzero(fresh)
    starts, ends = place[head], np.maximum.reduceat(end, head)
    base, new_doc = lists.edges[doc[head]], np.flatnonzero(np.r_[True, doc[head][1:] != doc[head][:-1]])
    pairs = np.unique(np.stack([doc, w], 1), axis=0)
    rows = []
    for x, y in zip(new_doc, [*new_doc[1:], len(head)], strict=True):
        d = doc[head[x]]
        mine = pairs[np.searchsorted(pairs[:, 0], d) : np.searchsorted(pairs[:, 0], d, side="right"), 1]
        names = sorted({i for v in mine for i in wanted.items[wanted.bounds[v] : wanted.bounds[v + 1]]})
        rows.append((segment, d, starts[x:y] - base[x:y], ends[x:y] - base[x:y], names))
    columns = [pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), MATCHES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=MATCHES)


def _search(wanted: Phrases, slack: int | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, lists in segments(batches, len(wanted.terms)):
            if slack is None:
                w, place = exact_places(lists, wanted)
                size = wanted.size[w]
            else:
                w, place = near_places(lists, wanted, slack)
                size = wanted.size[w] + slack
            if len(w):
                yield _matched(segment, lists, wanted, w, place, size)

    return search


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int | None = None, block: int = BLOCK) -> DataFrame:
    """(segment, doc, starts, ends, items): the documents of a written index that hold windows of the test items.

    Without `slack`, exact phrases: `starts` to `ends` (exclusive) are the stretches
    of matched words. With it, spans of window + `slack` words that hold all the
    window's terms in any order, at most `SPAN_MOST` words; a term that a window
    has twice is asked for once, and the stretches are the first spans found.
    `items` are the ids, as text, of items with a matched window. The lists of a
    block's terms are brought together segment by segment.
    """
    if slack is not None and window + slack > SPAN_MOST:
        raise ValueError(f"a span of {window + slack} words; {SPAN_MOST} at most")
    spark, found = index.sparkSession, None
    for wanted in blocks(items, window, block):
        terms = spark.createDataFrame(pa.table({"term": pa.array(wanted.terms, pa.string()), "tid": pa.array(range(len(wanted.terms)), pa.int64())}))
        # at most the terms of one block of items, whose bytes `block` bounds
        lists = index.join(F.broadcast(terms), "term").select("segment", "tid", "places", "ids", "lengths")
        heads = index.filter("term is null").select("segment", F.lit(-1).cast("long").alias("tid"), "places", "ids", "lengths")
        dealt = lists.unionByName(heads).repartition("segment").sortWithinPartitions("segment", "tid")
        some = dealt.mapInArrow(_search(wanted, slack), MATCHES_DDL)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], MATCHES_DDL)
    return settle(found, "matches")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None, block: int = BLOCK) -> DataFrame:
    """Every document with the words that windows of test items cover.

    Words are `WORD` after A-Z are lower-cased. Returns doc_id, n_words, n_hit,
    n_items, items_sha256 (of the sorted ids, comma-joined), contaminated, and
    items. With `slack`, a proximity search (`matches`).

    Null or empty text: no words, in documents and items alike. Items without an
    id hit words but aren't counted or named. Items that share an id are one
    where items are counted. Null doc_id and repeated rows: each document has
    its row. Terms are compared as whole words; inside a segment words are told
    apart by a 64-bit hash. A very long document is a segment of its own.
    Empty tables: no rows, or no hits. Further columns are ignored.
    """
    index = build_index(docs)
    found = matches(index, benchmark, window, slack, block)
    merged = found.groupBy("segment", "doc").agg(
        F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans", begin,
        lambda acc, x: F.struct(
            F.greatest(acc["upto"], x["ends"]).alias("upto"),
            (acc["n"] + F.greatest(x["ends"] - F.greatest(x["starts"], acc["upto"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    hits = merged.select("segment", "doc", covered.alias("n_hit"), "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return documents_of(index).join(hits, ["segment", "doc"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), items.alias("items"),
    )


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
), asked AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS said
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)
), tokens AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
), grams AS (
  SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g FROM tokens
), seen AS (
  SELECT r, p, size, item_id
  FROM (SELECT r, p, size, array_to_string(g[1:size], ' ') AS said FROM grams, (SELECT DISTINCT size FROM asked) WHERE len(g) >= size)
  JOIN asked USING (size, said)
), hit AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, p + unnest(range(size)) AS p FROM seen) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM seen WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
