"""Packing token sequences by minimum bin slack.

A document gives full windows, which need no packing, and one remainder shorter
than a window. Which remainders share a window depends on their lengths alone,
so the plan is made from the number of remainders of each length: at most
`window` numbers, however many documents there are. Remainders of one length are
interchangeable; they are numbered, and their numbers look up the plan.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import numbered

WINDOW = 1024
END = 0
#: Slacks that a window may be content with; a plan is made for each.
SLACKS = (0, 1, 2, 4, 8, 12, 16, 24, 32, 48)
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SPECIAL = "<|endoftext|>"
_encoders: dict = {}


def vocabulary() -> tuple[str, str]:
    """Path and split pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoder(path: str, pattern: str):
    """A tokenizer over a file of ranks, one per Python worker.

    Declared difference: ids are taken by `tiktoken` from the rank form of the
    50k vocabulary, not by `tokenizers` from its JSON form. They are the same ids
    (the tests compare them) at about five times the speed; the special token's
    text counts as that token. A very long text is encoded whole, in its task.
    """
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path, pattern] = tiktoken.Encoding(
            "public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)}
        )
    return _encoders[path, pattern]


def pieces(docs: DataFrame, window: int, path: str, pattern: str, with_ids: bool) -> DataFrame:
    """Each document's ids and END, cut into full windows and a remainder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*coder.encode(text, allowed_special="all"), END], dtype="<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    row = (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids))
                    rows.append((*row, part.astype("int32")) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, PIECE + (", ids array<int>" if with_ids else ""))


def fill(counts: dict[int, int], room: int, slack: int = 0) -> list[tuple[int, int]]:
    """The multiset of lengths with the largest sum up to `room`, as (length, copies).

    Bit s of `reach` says that some multiset sums to s. A length that occurs c
    times is added in doubling batches, so that up to c copies are covered; the
    bits after every length are kept, and the copies are read off backwards.
    Lengths are added from the longest on, until a sum leaves at most `slack`.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    goal = mask >> max(0, room - slack) << max(0, room - slack)
    for length in sorted((n for n in counts if counts[n] and n <= room), reverse=True):
        steps.append((length, reach))
        left, batch = min(counts[length], room // length), 1
        while left:
            batch = min(batch, left)
            reach |= (reach << (length * batch)) & mask
            left -= batch
            batch *= 2
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        copies = 0
        while not before >> total & 1:
            total -= length
            copies += 1
        if copies:
            out.append((length, copies))
    return out


def plan(counts: dict[int, int], window: int = WINDOW, slacks: tuple[int, ...] = SLACKS) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of lengths and how many windows follow each.

    The longest remainder left opens a window, `fill` picks what leaves the
    least slack, and the pattern is repeated until one of its lengths runs out.
    So there are at most about as many patterns as lengths. Short remainders
    spent on the last few tokens of early windows are missed in later ones; so
    plans that are content with some slack are made too, and the one of fewest
    windows counts.
    """
    return min((_planned(counts, window, slack) for slack in slacks), key=lambda made: sum(times for _, times in made))


def _planned(counts: dict[int, int], window: int, slack: int) -> list[tuple[list[tuple[int, int]], int]]:
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        first = max(left)
        left[first] -= 1
        chosen = dict(fill(left, window - first, slack))
        left[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        for n, c in chosen.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
        out.append((sorted(chosen.items(), reverse=True), times))
    return out


def _table(patterns: list, first_sequence: int = 0) -> np.ndarray:
    """The plan by length: rows (length, first number, sequence, copies, offset), ordered."""
    used: dict[int, int] = {}
    rows, sequence = [], first_sequence
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, window: int = WINDOW, path: str = "", pattern: str = "", with_ids: bool = False) -> DataFrame:
    """Where every piece of every document lies: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and with `with_ids` the ids themselves.

    Null and empty texts: END alone. Null doc_id: kept. Repeated rows: packed
    each. Ties: pieces of one length are numbered by a hash of doc_id, start and
    checksum. Empty table: empty result. Further columns are ignored.
    """
    if not path:
        path, pattern = vocabulary()
    cut = pieces(docs, window, path, pattern, with_ids)
    by = [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    ranked = numbered(cut, "length", by, "_number", settled := [])
    counts = {r["length"]: r["n"] for r in settled[0].groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _table(plan(counts, window))
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, number = batch["length"].to_numpy(np.int64), batch.pop("_number").to_numpy(np.int64)
            entry = table[np.searchsorted(keys, (length << 48) + number, side="right") - 1]
            ahead, copies = number - entry[:, 1], entry[:, 3]
            batch["sequence_id"] = entry[:, 2] + ahead // copies
            batch["offset"] = entry[:, 4] + ahead % copies * length
            yield batch.astype({"doc_id": "Int64"})

    schema = PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    names = [c for c in cut.columns] + ["_number"]
    return ranked.select(*names).mapInPandas(place, schema)
