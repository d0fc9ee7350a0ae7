"""Toxicity after noisy-channel deobfuscation.

A word that holds look-alike characters, long repetitions or letters spaced out
is taken for a noisy copy of a plain one. Its characters span a lattice: each
may stand for itself, for the letters it looks like, or for nothing. A character
trigram model, counted over all documents, gives the prior; the Viterbi path is
the restored word. Words whose lattice has one path are left as they are.
Words that may as well end in punctuation, or hold no letter, are read both ways.
Restored texts are scored by a logistic model over words and word beginnings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lendwell.llm import words
from lendwell.llm.common import key_text, settle
from lendwell.llm.words import U

#: Labelled documents that the classifier is fitted on, the first by hash.
SAMPLE = 20_000
#: Features of the classifier, those that tell the labels apart most.
FEATURES = 1024
#: A feature needs so many documents, and so large a likelihood-ratio statistic.
LEAST_DOCS, LEAST_G2 = 4, 15.0
BEGINNINGS = range(3, 9)
#: Words longer than this are restored in pieces of this length.
PIECE = 64
#: Single characters in a row that count as one spaced-out word.
SPACED = 4
#: The same, of characters that are read beside their plain form (`masked_words`).
MASKED_SPACED = 3
TOKENS = 256

#: What a character may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "(": "c",
}
#: Log costs of reading a character as another, as itself, as nothing.
AS_OTHER, AS_ITSELF, DROPPED, SPACE_DROPPED, SPACE_KEPT = (math.log(p) for p in (0.8, 0.2, 0.3, 0.8, 0.2))

# Classes of the character model: 0 a word's edge, 1 to 26 letters, 27 anything else.
N = 28
_CLASS = np.full(256, 27, np.int64)
_CLASS[words.SPACE] = 0
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LIKE = np.zeros(256, bool)
_LIKE[[ord(c) for c in LOOKALIKE]] = True
_WORDY = _LETTER.copy()
_WORDY[48:58] = _WORDY[128:] = True
_OPENING = _WORDY.copy()
_OPENING[[ord(c) for c in "@$!+|"]] = True
#: Symbols that look like a letter and, at a word's end, may as well be punctuation.
SYMBOLS = "@$!+|("
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_INNER = np.zeros(256, bool)
_INNER[[ord(c) for c in ".-_*"]] = True


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N**3, np.int64)
    for batch in batches:
        for chunk in words.chunks(batch.column(0)):
            c = np.concatenate([[0, 0], _CLASS[chunk.data], [0]])
            total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """Log probabilities [before last, last, next] from the trigrams of all texts.

    Every task counts what it reads into N^3 cells; so many rows at most reach
    the driver, whatever the corpus. Trigrams back off to bigrams, bigrams to
    single classes.
    """
    rows = texts.mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    tri = np.zeros(N**3)
    for r in rows:
        tri[r["code"]] = r["n"]
    tri = tri.reshape(N, N, N)
    one = (tri.sum((0, 1)) + 1) / (tri.sum() + N)
    two = (tri.sum(0) + 5 * one) / (tri.sum((0, 2))[:, None] + 5)
    return np.log((tri + 5 * two) / (tri.sum(2)[:, :, None] + 5)).astype(np.float32)


def _options(token: str) -> tuple[list[list[tuple[int, float, str]]], list[float]]:
    """Per character: (class, log cost, text) readings, and the log cost of dropping it."""
    reads, drops = [], []
    body = len(token.rstrip(SYMBOLS))
    repeated = any(token[i] == token[i + 1] == token[i + 2] for i in range(len(token) - 2))
    for i, c in enumerate(token):
        drop = DROPPED if repeated and i and c == token[i - 1] else -math.inf
        if c == " ":
            reads.append([(0, SPACE_KEPT, " ")])
            drop = SPACE_DROPPED
        elif "a" <= c <= "z":
            reads.append([(ord(c) - 96, 0.0, c)])
        else:
            own = [(27, AS_ITSELF if c in LOOKALIKE else 0.0, c)]
            reads.append([(ord(x) - 96, AS_OTHER - math.log(len(LOOKALIKE[c])), x) for x in LOOKALIKE.get(c, "")] + own)
            if c in ".-_*":
                drop = SPACE_DROPPED
            elif i >= body:
                drop = DROPPED
        drops.append(drop)
    return reads, drops


def restore(tokens: list[str], model: np.ndarray) -> list[str]:
    """The most probable plain form of every lower-case token."""
    out: dict[int, str] = {}
    order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
    for at in range(0, len(order), TOKENS):
        some = order[at : at + TOKENS]
        for i, text in zip(some, _viterbi([tokens[i] for i in some], model), strict=True):
            out[i] = text
    return [out[i] for i in range(len(tokens))]


def _viterbi(tokens: list[str], model: np.ndarray) -> list[str]:
    """Paths of several tokens at once; the state is the last two classes read."""
    lattices = [_options(t) for t in tokens]
    count, longest = len(tokens), max(map(len, tokens), default=0)
    score = np.full((count, N, N), -np.inf, np.float32)
    score[:, 0, 0] = 0
    toward = np.ascontiguousarray(model.transpose(2, 0, 1))  # [next, before last, last]
    back = []
    for t in range(longest):
        live = np.array([i for i in range(count) if t < len(tokens[i])])
        new = score.copy()
        new[live] += np.array([lattices[i][1][t] for i in live], np.float32)[:, None, None]
        origin = np.full((count, N, N), 255, np.uint8)  # 255: nothing was read
        for k in range(max(len(lattices[i][0][t]) for i in live)):
            rows = np.array([i for i in live if k < len(lattices[i][0][t])])
            cls = np.array([lattices[i][0][t][k][0] for i in rows])
            cost = np.array([lattices[i][0][t][k][1] for i in rows], np.float32)
            came = score[rows] + toward[cls]
            best = came.argmax(1)
            value = np.take_along_axis(came, best[:, None], 1)[:, 0] + cost[:, None]
            better = value > new[rows, :, cls]
            new[rows, :, cls] = np.where(better, value, new[rows, :, cls])
            origin[rows, :, cls] = np.where(better, best, origin[rows, :, cls])
        score = new
        back.append(origin)
    final = (score + model[:, :, 0]).reshape(count, -1).argmax(1)
    out = []
    for i, token in enumerate(tokens):
        before, last, text = int(final[i]) // N, int(final[i]) % N, []
        for t in range(len(token) - 1, -1, -1):
            came = back[t][i, before, last]
            if came != 255:
                text.append(next(x for c, _, x in lattices[i][0][t] if c == last))
                before, last = int(came), before
        out.append("".join(reversed(text)))
    return out


@dataclass
class Noisy:
    """A chunk's words without their edge symbols, and which need restoring."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    tokens: list[str]
    token_text: np.ndarray


def noisy_words(chunk: words.Chunk) -> Noisy:
    """Plain words as byte ranges; suspicious ones as lower-case tokens.

    Symbols around a word are dropped. Suspicious are words with a letter and a
    look-alike, with three equal letters in a row, or with single letters split
    by inner marks, and rows of `SPACED` or more single characters.
    """
    data = chunk.data
    starts, ends = chunk.spans(words.SPACE[data])
    if not len(starts):
        return Noisy(starts, ends, starts, [], starts)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    opening, wordy = np.flatnonzero(_OPENING[data]), np.flatnonzero(_WORDY[data])
    raw_starts, raw_ends = starts, ends
    i, j = np.searchsorted(opening, starts), np.searchsorted(wordy, ends) - 1
    first = np.append(opening, len(data))[i]
    last = np.append(wordy, -1)[j] + 1
    whole = (first < ends) & (last > first)
    starts, ends, raw_starts, raw_ends = first[whole], last[whole], raw_starts[whole], raw_ends[whole]
    text = chunk.text_of(starts)
    size = ends - starts
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = _LETTER[data[2:]] & (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2])
    letters, likes, inner = sums(_LETTER[data]), sums(_LIKE[data]), sums(_INNER[data])
    runs = sums(triple)
    within = lambda s, skip=0: s[ends] - s[np.minimum(starts + skip, ends)]
    marks = within(inner)
    odd = ((within(letters) > 0) & (within(likes) > 0)) | (within(runs, 2) > 0) | ((marks >= 2) & (size == 2 * marks + 1))
    # Rows of single characters, one blank apart.
    single = (size == 1) & (raw_ends - raw_starts == 1) & (_LETTER[data[starts]] | _LIKE[data[starts]])
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (starts[1:] == ends[:-1] + 1) & (text[1:] == text[:-1])
    row = np.cumsum(~joined) - 1
    long_row = single & (np.bincount(row)[row] >= SPACED)
    tokens, owners = [], []
    raw = lower.tobytes()
    for k in np.flatnonzero(odd & ~long_row):
        word = raw[starts[k] : ends[k]].decode("utf-8", "replace")
        for at in range(0, len(word), PIECE):
            tokens.append(word[at : at + PIECE])
            owners.append(text[k])
    heads = np.flatnonzero(long_row & ~joined)
    for k in heads:
        members = int(np.searchsorted(row, row[k], side="right")) - k
        word = raw[starts[k] : ends[k + members - 1]].decode("utf-8", "replace")
        for at in range(0, len(word), PIECE):
            tokens.append(word[at : at + PIECE])
            owners.append(text[k])
    plain = ~(odd | long_row)
    return Noisy(starts[plain], ends[plain], text[plain], tokens, np.array(owners, np.int64))


def masked_words(chunk: words.Chunk) -> tuple[list[str], np.ndarray]:
    """Lower-case tokens, and their texts, that `noisy_words` reads without their look-alikes.

    Words that end in look-alike symbols, words of two or more look-alikes
    without a letter, and rows of `MASKED_SPACED` single characters: the lattice
    decides between letters, the characters themselves and punctuation. They are
    read beside the plain form, which stays.
    """
    data = chunk.data
    starts, ends = chunk.spans(words.SPACE[data])
    if not len(starts):
        return [], starts
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    opening, wordy = np.flatnonzero(_OPENING[data] | _SYMBOL[data]), np.flatnonzero(_WORDY[data])
    first = np.append(opening, len(data))[np.searchsorted(opening, starts)]
    core = np.append(wordy, -1)[np.searchsorted(wordy, ends) - 1] + 1
    some = first < ends
    starts, ends, first, core = starts[some], ends[some], first[some], core[some]
    # Symbols that follow the last letter or digit, or the first symbol, at once.
    other = np.append(np.flatnonzero(~_SYMBOL[data]), len(data))
    core = np.maximum(first, core)
    last = np.minimum(other[np.searchsorted(other, core)], ends)
    text = chunk.text_of(first)
    size = last - first
    letters, likes = sums(_LETTER[data] | (data >= 128)), sums(_LIKE[data])
    tail = (last > core) & (letters[last] > letters[first])
    bare = (size >= 2) & (likes[last] - likes[first] == size)
    single = (ends - starts == 1) & (_LETTER[data[starts]] | _LIKE[data[starts]])
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (starts[1:] == ends[:-1] + 1) & (text[1:] == text[:-1])
    row = np.cumsum(~joined) - 1
    length = np.bincount(row)[row]
    # Longer rows are noisy words already, unless a symbol without a letter is part of them.
    wide = np.bincount(row, single & _SYMBOL[data[starts]])[row] > 0
    heads = single & ~joined & (length >= MASKED_SPACED) & ((length < SPACED) | wide)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8).tobytes()
    tokens, owners = [], []
    for k in np.flatnonzero(heads | ((tail | bare) & ~single)):
        stop = ends[k + length[k] - 1] if heads[k] else last[k]
        word = lower[first[k] : stop].decode("utf-8", "replace")
        for at in range(0, len(word), PIECE):
            tokens.append(word[at : at + PIECE])
            owners.append(text[k])
    return tokens, np.array(owners, np.int64)


def _features(chunk: words.Chunk, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of whole words and of their beginnings, by code points."""
    lead = (chunk.data & 0xC0) != 0x80
    places = np.append(np.flatnonzero(lead), [len(chunk.data)] * (max(BEGINNINGS) + 1))
    before = np.concatenate([[0], np.cumsum(lead)])
    index = before[starts]
    length = before[ends] - index
    owners, features = [text], [words.mix(chunk.hashes(starts, ends, lower=True) + U(1))]
    for k in BEGINNINGS:
        here = length > k
        stop = places[index[here] + k]
        owners.append(text[here])
        features.append(chunk.hashes(starts[here], stop, lower=True))
    return np.concatenate(owners), np.concatenate(features)


def text_features(chunk: words.Chunk, model: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) of the restored texts; only `known` features (ordered), if given."""
    noisy = noisy_words(chunk)
    owner, feature = _features(chunk, noisy.starts, noisy.ends, noisy.text)
    masked, masked_text = masked_words(chunk)
    tokens, token_text = noisy.tokens + masked, np.concatenate([noisy.token_text, masked_text])
    if tokens:
        distinct, where = np.unique(np.array(tokens, dtype=object), return_inverse=True)
        plain = restore(list(distinct), model)
        for extra in words.chunks(pa.array(plain)):
            starts, ends = extra.spans(words.SPACE[extra.data])
            token, found = _features(extra, starts, ends, extra.text_of(starts) + extra.first)
            # Every text that holds the token has its features.
            order = np.argsort(where, kind="stable")
            bounds = np.searchsorted(where[order], np.arange(len(distinct) + 1))
            times = bounds[token + 1] - bounds[token]
            at = np.repeat(bounds[token], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            owner = np.concatenate([owner, token_text[order[at]]])
            feature = np.concatenate([feature, np.repeat(found, times)])
    if known is not None:
        if not len(known):
            return owner[:0], feature[:0]
        table = np.zeros(1 << 16, bool)
        table[(known >> U(48)).astype(np.int64)] = True
        may = table[(feature >> U(48)).astype(np.int64)]
        owner, feature = owner[may], feature[may]
        hit = known[np.minimum(np.searchsorted(known, feature), len(known) - 1)] == feature
        owner, feature = owner[hit], feature[hit]
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
    return owner[fresh], feature[fresh]


@dataclass
class Classifier:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, chunk: words.Chunk, model: np.ndarray) -> np.ndarray:
        owner, feature = text_features(chunk, model, self.features)
        z = np.bincount(owner, self.weights[np.searchsorted(self.features, feature)], minlength=chunk.count) if len(owner) else np.zeros(chunk.count)
        return 1 / (1 + np.exp(-(z + self.bias)))


def fit(labelled: DataFrame, model: np.ndarray) -> Classifier:
    """Select features by the likelihood-ratio statistic and fit a logistic model.

    `labelled`: text, toxic; `SAMPLE` rows at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in words.chunks(batch.column(0)):
                owner, feature = text_features(chunk, model)
                names, where, n = np.unique(feature, return_inverse=True, return_counts=True)
                bad = np.bincount(where, toxic[chunk.first + owner], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n), pa.array(bad)], names=["feature", "n", "bad"])

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in words.chunks(batch.column(0)):
                owner, feature = text_features(chunk, model, known)
                bounds = np.searchsorted(owner, np.arange(chunk.count + 1)).astype(np.int32)
                columns = np.searchsorted(known, feature).astype(np.int32)
                part = toxic[chunk.first : chunk.first + chunk.count]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.ListArray.from_arrays(pa.array(bounds), pa.array(columns))], names=["toxic", "features"]
                )

    toxic, all_docs = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not toxic or toxic == all_docs:
        return Classifier(np.zeros(0, U), np.zeros(0), 30.0 if toxic else -30.0)
    counts = labelled.mapInArrow(count, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    part = lambda o, r, c: F.when(o > 0, o * F.log(o * F.lit(float(all_docs)) / (r * c))).otherwise(0.0)
    n, bad, t = F.col("n").cast("double"), F.col("bad").cast("double"), F.lit(float(toxic))
    rest, d = F.lit(float(all_docs)) - n, F.lit(float(all_docs - toxic))
    g2 = 2 * (part(bad, n, t) + part(n - bad, n, d) + part(t - bad, rest, t) + part(d - n + bad, rest, d))
    best = counts.filter(F.col("n") >= LEAST_DOCS).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2)
    rows = best.orderBy(F.desc("g2"), "feature").limit(FEATURES).select("feature").collect()
    known = np.sort(np.array([r["feature"] for r in rows], np.int64).view(U))
    docs = labelled.mapInArrow(present, "toxic long, features array<int>").toArrow()
    lists = docs["features"].combine_chunks()
    y = docs["toxic"].to_numpy().astype(float)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets))
    weights, bias = _logistic(row, lists.flatten().to_numpy().astype(np.int64), y, len(known))
    return Classifier(known, weights, bias)


def _logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 1500):
    """Logistic regression on present features by accelerated gradient steps."""
    order = np.lexsort((column, row))
    row, column = row[order], column[order]
    n = len(y)
    v = np.ones(width + 1)
    for _ in range(30):  # the largest eigenvalue of X'X / n, for the step size
        z = np.bincount(row, v[column], minlength=n) + v[-1]
        v = np.append(np.bincount(column, z[row], minlength=width), z.sum()) / n
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.25 * 1.1 * top + ridge)
    w = ahead = np.zeros(width + 1)
    w[-1] = ahead[-1] = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for k in range(steps):
        z = np.bincount(row, ahead[column], minlength=n) + ahead[-1]
        off = 1 / (1 + np.exp(-z)) - y
        slope = np.append(np.bincount(column, off[row], minlength=width) / n + ridge * ahead[:-1], off.mean())
        new = ahead - rate * slope
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _held_out(doc_id: Column) -> Column:
    return F.crc32(key_text(doc_id)) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Rows whose crc32 of the doc_id's text is a multiple of 5 are held out: their
    labels are never read. A score rests on the text alone.

    Null and empty texts: no features, so the model's base rate. Null doc_id:
    scored, never labelled. Repeated rows: each scored alike, one of them teaches;
    several labels of one doc_id: the largest counts. No labels, or all alike: every score is next
    to 0, or next to 1 if all are toxic. Empty table: empty result. Further
    columns are ignored.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    model = language_model(texts)
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # SAMPLE rows at most, so the labels go to the documents.
    marked = settle(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labels")
    labelled = known.join(F.broadcast(marked), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")
    labelled = settle(labelled, "labelled")
    classifier = fit(labelled, model)

    @arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)] + [classifier.scores(c, model) for c in words.chunks(texts)]
        return pa.array(np.concatenate(parts))

    out = docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def restored_text(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and the restored suspicious words of every text, in order."""

    @arrow_udf(T.ArrayType(T.StringType()))
    def plain(texts: pa.Array) -> pa.Array:
        out: list[list[str]] = []
        for chunk in words.chunks(texts):
            noisy = noisy_words(chunk)
            mine: list[list[str]] = [[] for _ in range(chunk.count)]
            for i, word in zip(noisy.token_text, restore(noisy.tokens, model), strict=True):
                mine[i].append(word)
            out += mine
        return pa.array(out, pa.list_(pa.string()))

    return docs.select("doc_id", plain(F.coalesce("text", F.lit(""))).alias("restored"))
