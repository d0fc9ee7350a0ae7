"""Source mixing: targets by plain water filling, budgets, draws, odd rows."""

import random
import re
from collections import defaultdict

import pytest

from lendwell.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight, cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total >= cap * sizes[s]]
        if not above:
            goal |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            goal[s] = float(cap * sizes[s])
            open_.discard(s)
        left -= sum(goal[s] for s in above)
    return goal


def rows(n, seed, sources):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 400])) or None, rng.choice(sources), 1.0) for i in range(n)]


CASES = [
    rows(300, 1, ["a", "b", "c", None, "é", "Z"]),
    rows(200, 2, ["hot"] * 20 + ["x", "y"]),
    rows(40, 3, ["only"]),
    [(1, None, "a", 1.0), (2, "", None, 1.0)],
    [(1, "a b c", None, 1.0), (1, "a b c", None, 1.0), (None, "a #|* b", "s", 1.0), (None, "x y", "s", 1.0), (5, "q", "t", 1.0)],
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_budgets(spark, case):
    data = CASES[case]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, target double")
    got = mixing.mix(df.repartition(3)).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for _, text, source, _ in data:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_only_one_document_of_a_source_is_cut(spark):
    df = spark.createDataFrame(CASES[0], "doc_id long, text string, source string, target double")
    cut = defaultdict(int)
    for r in mixing.mix(df).collect():
        cut[r.source] += 0 < r.taken - r.epochs * r.size < r.size
    assert max(cut.values()) <= 1


def test_quality_weighs_the_draw(spark):
    """Of a source that gives two thirds of its words, nearly all clean ones are drawn."""
    data = [(i, ("word " if i % 2 else "w### ") * 10, "b" if i < 600 else "a") for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    taken = [r for r in mixing.mix(df).collect() if r.source == "a"]
    clean = sum(r.taken for r in taken if r.doc_id % 2)
    assert sum(r.taken for r in taken) == 4000 and clean > 0.85 * 3000


def test_documents_of_the_mix(spark):
    df = spark.createDataFrame(CASES[0], "doc_id long, text string, source string, target double")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert {d: n for d, n in words.items() if n} == {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
