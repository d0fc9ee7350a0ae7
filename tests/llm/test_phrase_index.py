"""Benchmark passages in the positional index against the plain definition."""

import hashlib
import random
import re

import numpy as np
import pytest

from lendwell.llm import phrase_index as px

DOCS = "doc_id long, text string, segment int, term string, places string"
FIELDS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(px.WORD, low)


def asked(items):
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            yield item, w[i : i + 10]


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, names = words_of(text), set(), set()
        for item, win in asked(items):
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    names |= {str(item)} - {"None"}
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


def brute_near(docs, items, slack):
    out = []
    for doc, text in docs:
        w, names = words_of(text), set()
        for item, win in asked(items):
            size = len(win) + slack
            if any(set(win) <= set(w[p : p + size]) for p in range(len(w))):
                names.add(str(item))
        out.append((doc, sorted(names)))
    return sorted(out, key=str)


def made(rng):
    pool = ["a", "b", "c", "dé", "e5", "Ünd", "词语", "g", "h", "ii", "jj", "kk"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 10, 11, 25])))) for i in range(30)]
    items += [(None, "only without id " * 4), (7, items[7][1]), (7, "another text for item seven"), (50, None), (51, "..."), (9, "once more with a comma")]
    docs = []
    for i in range(150):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.4:
            said = rng.choice(items)[1] or ""
            text = f"{text} {rng.choice(['', 'x'])} {rng.choice([said, said.upper(), said.replace(' ', ', ')])}! {text[:9]}"
        docs.append((i, text))
    return docs + [(None, None), (None, items[3][1]), (3, docs[3][1]), (4, ""), (200, "\x00@[`{"), (201, ("zz " * 40_000) + items[4][1])], items


def table(spark, docs):
    return spark.createDataFrame([(*r, 1, "x", None) for r in docs], DOCS)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_contamination_equals_the_definition(spark, block, monkeypatch):
    docs, items = made(random.Random(8))
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    assert got(px.contamination(table(spark, docs).repartition(3), bench, block=block)) == brute(docs, items)


def test_proximity_equals_the_definition(spark):
    rng = random.Random(9)
    docs, items = made(rng)
    docs = [d for d in docs if d[0] != 201]
    items = [x for x in items if x[0] is not None]
    for slack in (0, 3, 20):
        df = px.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), slack=slack)
        assert sorted(((r.doc_id, r["items"]) for r in df.collect()), key=str) == brute_near(docs, items, slack)
    with pytest.raises(ValueError):
        px.matches(None, None, slack=px.SPAN_MOST)


def test_places_are_packed_and_unpacked():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(top, n, replace=False)) for top, n in ((5, 3), (200, 200), (70_000, 9), (1 << 30, 5), (1, 1))]
    heads = np.cumsum([0] + [len(x) for x in lists[:-1]])
    for blob, want in zip(px.packed(np.concatenate(lists), heads).to_pylist(), lists, strict=True):
        assert px.unpacked(blob).tolist() == want.tolist()


def test_empty_tables(spark):
    bench = "item_id long, text string"
    assert px.contamination(table(spark, []), spark.createDataFrame([(1, "a b")], bench)).count() == 0
    df = px.contamination(table(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], bench))
    assert got(df) == brute([(1, "a b"), (2, None)], [])
