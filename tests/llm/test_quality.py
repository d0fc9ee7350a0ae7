"""Quality rules: counts against the plain definition, outliers against a plain estimate."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lendwell.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside)


def random_texts():
    rng = random.Random(8)
    bits = ["a", "b", "ab", "é", "#", "|", " ", " ", " ", "\n", "\n", "\t", " ", "😀", "\x00", "\r\n", "x" * 40]
    yield from ["", " \n ", "a", "a b c", "a b c a b c", "A a\n" * 400_000]
    for _ in range(500):
        yield "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))


def test_counts_equal_the_definition():
    texts = list(random_texts())
    got = quality.count_batch(pa.array(texts))
    for i, t in enumerate(texts):
        if len(t) < 10_000:
            assert tuple(int(got[k][i]) for k in quality.COUNTS[:5]) == brute(t), t
    big = next(i for i, t in enumerate(texts) if len(t) > 10_000)
    assert [int(got[k][big]) for k in quality.COUNTS[:5]] == [800_000, 800_000, 0, 399_999, 800_000]


def test_a_slice_of_an_arrow_column():
    texts = pa.array(["one two", "x", "", "three four five"])
    assert quality.count_batch(texts.slice(1, 3))["n_words"].tolist() == [1, 0, 3]
    assert quality.count_batch(texts.slice(0, 0))["n_words"].tolist() == []


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    clean = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, clean(rng.randint(60, 600)), "en", "hot", "y") for i in range(400)]
    rows += [(1000 + i, clean(rng.randint(60, 600)), rng.choice(["de", "fr"]), f"s{i % 9}", "y") for i in range(120)]
    rows += [(2000 + i, " ".join(word() + "###" for _ in range(200)), "en", "hot", "y") for i in range(40)]
    rows += [(3000, None, "en", None, "y"), (3001, "", None, "hot", "y"), (3002, clean(100), None, None, "y"), (0, rows[0][1], "en", "hot", "y")]
    rows += [(None, clean(90), "en", "hot", "y"), (3003, "w " * 100, "en", "hot", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    return rows, df, quality.judge(df).collect()


def test_outliers_go_and_clean_documents_stay(judged):
    rows, _, got = judged
    assert len(got) == len(rows)
    for r in got:
        clean = r.doc_id is None or r.doc_id < 2000 or r.doc_id == 3002
        assert r.kept == clean, r
        if r.base_failed:
            assert not r.kept and r.distance is None


def test_distances_equal_a_plain_estimate(judged):
    """The same steps by numpy over one group, ordered exactly: the same core, near enough."""
    rows, _, got = judged
    mine = {r.doc_id: r for r in got if r.distance is not None}
    ids = [r[0] for r in rows if r[2] == "en" and r[3] == "hot" and r[0] in mine and r[0] is not None]
    c = quality.count_batch(pa.array([r[1] for r in rows if r[0] in mine and r[2] == "en" and r[3] == "hot" and r[0] is not None]))
    n = c["n_words"].astype(float)
    x = np.stack([np.log1p(n), np.log1p(c["word_chars"] / n), np.sqrt(c["n_symbols"] / n), np.sqrt(c["n_repeat_words"] / n), np.sqrt(c["n_upper"] / c["word_chars"])], 1)
    mid = np.median(x, 0)
    spread = np.maximum((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349, quality.FLOOR)
    d = (((x - mid) / spread) ** 2).sum(1)
    for _ in range(quality.STEPS):
        core = x[np.argsort(d)[: int(np.ceil(quality.CORE * len(x)))]]
        cov = np.cov(core.T, bias=True) * quality.core_scale() + np.diag(quality.FLOOR**2)
        d = np.einsum("ij,jk,ik->i", x - core.mean(0), np.linalg.inv(cov), x - core.mean(0))
    ratio = np.array([mine[i].distance for i in ids]) / d
    assert np.median(abs(ratio - 1)) < 0.1
    assert ((d > quality.CUTOFF) == np.array([not mine[i].kept for i in ids])).all()


def test_kept_documents_have_the_input_columns(spark, judged):
    rows, df, got = judged
    out = quality.kept_documents(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.kept for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(df).count() == 0


def test_counting_holds_little_beside_the_texts():
    """A worker runs on every core, so what counting holds at once must not follow the batch."""
    texts = pa.array(["some words of a long page in a line\n" * 300] * 1000)
    quality.count_batch(texts.slice(0, 1))
    tracemalloc.start()
    counts = quality.count_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts["n_words"].tolist() == [2700] * 1000
    assert peak < 16 << 20
