"""The prefix trie against the plain definition."""

import hashlib
import random
import zlib
from collections import defaultdict

from lendwell.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, path string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, fork=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if fork else 0
        made[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
            if d:
                kids[ts[: d - 1]].add(ts[:d])

    def saved(p):
        return (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0

    leaves, total = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        total[p] = saved(p) + sum(total[k] for k in kids[p])
    out = []
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(made[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out.append((min(ms), len(p), up, len(ms), len(kids[p]), leaves[p], total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


def dialogue(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 3, 5, 9, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hé", "ho", ""])))
    return rows


def test_trie_equals_the_definition(spark):
    rng = random.Random(3)
    rows = dialogue(rng, 120)
    rows = [r for r in rows if r[0] not in (10, 25)]  # bases that are absent
    rows += [(200, None, None, None), (200, 0, "user", None), (None, 0, "user", "lost"), (3, 0, "user", "hi"), (3, 0, "user", "hi")]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    assert got(pt.trie(table(spark, rows), wide=3)) == brute(rows)


def test_deep_conversations_and_whole_tails(spark):
    """Long tails peeled inside tasks and level by level give the same nodes."""
    rng = random.Random(4)
    rows = dialogue(rng, 30)
    stem = [("user", f"turn {t}") for t in range(60)]
    for c, n in ((100, 60), (101, 60), (102, 40), (103, 41), (104, 7)):
        rows += [(c, t, *stem[t]) for t in range(n)] + ([(c, 99, "user", "fork " + "long" * 5000)] if c % 2 else [])
    want = brute(rows, fork=False)
    assert got(pt.trie(table(spark, rows), fork=False, tail_share=0.9)) == want
    few = [r for r in rows if r[0] < 30]
    assert got(pt.trie(table(spark, few), fork=False, tail_turns=0)) == brute(few, fork=False)


def test_many_ends_of_one_node(spark):
    rows = [(c, 0, "user", "the same") for c in range(3000)]
    assert got(pt.trie(table(spark, rows), fork=False)) == brute(rows, fork=False)


def test_empty_table(spark):
    assert pt.trie(table(spark, [])).count() == 0
    assert pt.trie(table(spark, [(None, None, None, None)])).count() == 0
