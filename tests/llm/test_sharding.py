"""Hash-tree sharding: the law, balance, confined movement, slots."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lendwell.llm import sharding
from lendwell.llm.sharding import Node


def plain_place(key, node, seed="shard"):
    while node.shard is None:
        if len(node.children) > 1:
            def draw(c):
                bits = int(hashlib.md5(f"{seed}/{c.name}/{key}".encode()).hexdigest()[:13], 16)
                return math.log((bits + 0.5) / 2**52) / c.weight
            node = max(node.children, key=draw)
        else:
            node = node.children[0]
    return node.shard


def test_places_equal_the_plain_descent(spark):
    data = [(i, None if i % 7 == 0 else "tëxt" * (i % 5), i) for i in range(800)] + [(None, "x", 0), (3, "a", 0), (3, "a", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, slot int")
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(data)
    root = sharding.tree(8)
    more = sharding.grown(root, 8)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == plain_place(key, root) and r.grown_shard == plain_place(key, more)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    texts = {d: t for d, t, _ in data[:800]}
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))


def test_weights_and_growth(spark):
    keys = spark.range(40_000).select(F.col("id").cast("string").alias("k"))
    root = sharding.tree(8)
    more = sharding.grown(root, 8)
    rows = keys.select(sharding.place(F.col("k"), root).alias("a"), sharding.place(F.col("k"), more).alias("b")).collect()
    old, new = Counter(r.a for r in rows), Counter(r.b for r in rows)
    assert all(abs(n - 5000) < 350 for n in old.values())
    assert all(abs(new[s] - 40_000 / 9) < 350 for s in range(9))
    assert all(r.b == r.a or r.b == 8 for r in rows)


def test_a_changed_weight_moves_rows_of_its_subtree_only(spark):
    root = sharding.tree(8)
    region = root.children[1]
    rack = region.children[0]
    # Weight goes from one shard of a rack to the other: no weight above changes.
    shards = tuple(Node(s.name, shard=s.shard, own=w) for s, w in zip(rack.children, (1.5, 0.5), strict=True))
    changed = Node(root.name, (root.children[0], Node(region.name, (Node(rack.name, shards), *region.children[1:]))))
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(sharding.place(F.col("k"), root).alias("a"), sharding.place(F.col("k"), changed).alias("b")).collect()
    moved = Counter((r.a, r.b) for r in rows if r.a != r.b)
    assert set(moved) == {(rack.children[1].shard, rack.children[0].shard)}


def test_tree_shapes():
    assert [sorted(s.shard for r in root.children for k in r.children for s in k.children) for root in map(sharding.tree, (1, 3, 8, 13))] == [
        list(range(n)) for n in (1, 3, 8, 13)
    ]
    assert sharding.tree(8).weight == 8


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_growth_is_the_placement_of_one_shard_more(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    by = lambda c, **how: {r.doc_id: r[c] for r in sharding.shard_documents(df, **how).collect()}
    for shards in (8, 9):
        assert by("grown_shard", shards=shards) == by("shard", shards=shards + 1)
    heavy = sharding.grown(sharding.tree(3), 3, 5.0)
    assert by("grown_shard", shards=3, weight=5.0) == by("shard", root=heavy)
