"""Spelling variants against the plain definition."""

import random
import re
import zlib
from collections import Counter

import pytest

from lendwell.llm import spelling

DOCS = "doc_id long, text string, word string, n int, bucket string"
FIELDS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 10 * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, counts[form] if form else None))
    return sorted(rows, key=str)


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            if len(low) >= 7:
                counts[low] += 1
    return grouped({w: n for w, n in counts.items() if n >= 2})


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [4096, 3])
def test_variants_equal_the_definition(spark, most):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["Generation", "generation", "États×Unis"]
    docs = []
    for i in range(120):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        docs.append((i, "".join(w + rng.choice([" ", ". ", "1", "_", "Ā", "\n"]) for w in words)))
    docs += [(None, None), (None, "generation generation"), (3, ""), (7, docs[7][1]), (9, "Ab" * 3000 + " " + "ab" * 2999 + "ac")]
    docs += [(400 + i, "ab" * 3000 + " " + "ab" * 2999 + "ac") for i in range(2)]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in docs], DOCS)
    assert got(spelling.spelling_variants(df, most=most)) == brute(docs)


@pytest.mark.parametrize("most", [4096, 20])
def test_large_buckets_and_chains(spark, most):
    """Hundreds of words that share one half, in buckets of more than 64 words, and chains of forms."""
    rng = random.Random(6)
    counts = {"common" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 10, 20, 300, 5000]) for _ in range(700)}
    counts |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) + "ending": rng.choice([1, 10, 100]) for _ in range(40)}
    counts = {w: n for w, n in counts.items() if len(w) >= 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.group_vocabulary(df, most=most)) == grouped(counts)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, "x", 1, "y")], DOCS)).count() == 0
