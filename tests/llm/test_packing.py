"""Packing: the contract's invariants, ids against the JSON tokenizer, slack against brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lendwell.llm import packing


def texts():
    rng = random.Random(3)
    words = ["the", "Wörld", "它们", "don't", "12,345", "\n\n", "  ", "😀", "<|endoftext|>", "a" * 300, "\t", "x_y"]
    out = ["", None, " ", "<|endoftext|>", "b" * 20_000]
    for _ in range(120):
        out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 900]))))
    return out


def test_pieces_and_places(spark):
    all_texts = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(all_texts)] + [(0, "", 1), (None, "x", 1)], "doc_id long, text string, length int")
    rows = packing.pack(df).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(all_texts):
        if i == 0:
            continue
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert sum(r.length for r in own) == len(ids) and all(r.doc_tokens == len(ids) for r in own)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    assert sum(r.doc_id == 0 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024 and set(used) == set(range(len(used)))
    assert sum(1024 - u for u in used.values()) <= 0.06 * sum(used.values())


def test_fill_is_the_best_multiset():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        room = rng.randint(1, 70)
        best = max(
            s
            for c in itertools.product(*[range(n + 1) for n in counts.values()])
            if (s := sum(a * b for a, b in zip(counts, c, strict=True))) <= room
        )
        got = packing.fill(counts, room)
        assert sum(a * b for a, b in got) == best
        assert all(c <= counts[n] for n, c in got)


def least_windows(counts, window):
    """A lower bound of any packing (Martello and Toth's L2).

    Pieces longer than window - k share with none of at least k; longer than half, with none of their
    kind; what the others of at least k fill beyond the room beside those takes further windows.
    """
    best = 0
    for k in range(window // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > window - k)
        halves = [(n, c) for n, c in counts.items() if window // 2 < n <= window - k]
        room = sum(c * (window - n) for n, c in halves)
        rest = sum(n * c for n, c in counts.items() if k <= n <= window // 2)
        best = max(best, alone + sum(c for _, c in halves) + max(0, -(-(rest - room) // window)))
    return best


def test_plan_uses_every_length_once():
    rng = random.Random(6)
    counts = {n: rng.randint(0, 50_000) for n in range(1, 1025)}
    patterns = packing.plan(counts)
    used = {}
    for pattern, times in patterns:
        assert sum(n * c for n, c in pattern) <= 1024
        for n, c in pattern:
            used[n] = used.get(n, 0) + c * times
    assert used == {n: c for n, c in counts.items() if c}
    assert len(patterns) <= 1100
    assert sum(t for _, t in patterns) <= 1.0025 * least_windows(counts, 1024)


def test_ids_are_kept(spark):
    df = spark.createDataFrame([(1, "a b c " * 1000)], "doc_id long, text string")
    rows = packing.pack(df, with_ids=True).orderBy("start").collect()
    assert sum(len(r.ids) for r in rows) == rows[0].doc_tokens
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
