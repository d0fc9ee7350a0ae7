"""Trie of conversation prefixes, peeled from its deepest turns to the root.

A node stands for a distinct sequence of first turns. Nodes of the deepest level
are known first: conversations that end there, copies merged. Their last turn is
stripped, what is left is regrouped together with the conversations that end one
turn earlier, and so on up to the root. One aggregation per level both finds the
level's nodes and completes their subtree values, so a turn that very many
conversations share is merged before it is moved.

Nodes are told apart by a 128-bit hash chain over the turns (role, text); texts
are hashed where they are read and never moved. Each level is written once; the
next level reads it, so a lost executor costs one level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType

from lendwell.llm.common import settle

ROOT = bytes(16)
#: The deepest levels that hold at most this many turns together, and at most this
#: share of the table's turns, are peeled inside tasks: a few very long
#: conversations cost no round of their own per turn.
TAIL_TURNS, TAIL_SHARE = 100_000, 0.05
#: Ends of a node are hashed in blocks of this many consecutive ids.
ID_BLOCK = 512
#: A node of more than max(this, nodes / 10,000) children is sent to every task
#: that looks up parents; there are at most 10,000 such nodes.
WIDE = 1_000

NODE = (
    "key binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, path array<binary>, sizes array<long>"
)


@pandas_udf(ArrayType(BinaryType()))
def _chain(digests: pd.Series) -> pd.Series:
    """Keys of all prefixes of a conversation from its turns' digests, 32 hex digits each."""

    def keys(text: str) -> list[bytes]:
        out, key = [], ROOT
        for at in range(0, len(text), 32):
            key = hashlib.blake2b(key + text[at : at + 32].encode(), digest_size=16).digest()
            out.append(key)
        return out

    return digests.map(keys)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turns): per conversation its turns in order as (turn, role, digest, size).

    Equal turn numbers are ordered by role, then by the turn's digest.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.filter("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % 5).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")
    )
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def forked(turns: DataFrame, most: int = 8) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 5, then its own after h.

    h is the CRC-32 of c in decimals, modulo `most` + 1. Returns (conv_id, turns).
    """
    heads = turns.filter("conv_id = base").select("base", F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return turns.join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def with_keys(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, len, end, keys, sizes): prefix keys, bytes of each turn and the last prefix's key."""
    text = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    keyed = rebuilt.select("conv_id", _chain(text).alias("keys"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    return keyed.select("conv_id", F.size("keys").alias("len"), _prefix_key("keys", F.size("keys")).alias("end"), "keys", "sizes")


def _prefix_key(keys: str, depth: Column) -> Column:
    return F.when(depth > 0, F.get(F.col(keys), depth - 1)).otherwise(F.lit(ROOT))


def _level(depth: int, ended: DataFrame, stripped: DataFrame | None) -> DataFrame:
    """Nodes of one level: conversations that end here and the level below without its last turn."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = ended.select(
        F.col("end").alias("key"), F.slice("keys", 1, max(depth - 1, 0)).alias("path"), "sizes",
        "conv_id", one.alias("n"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"),
    )
    if stripped is not None:
        rows = rows.unionByName(
            stripped.select(
                F.col("parent").alias("key"), F.slice("path", 1, max(depth - 1, 0)).alias("path"),
                F.slice("sizes", 1, depth).alias("sizes"), "conv_id", F.col("n_convs").alias("n"), one.alias("children"),
                F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
            )
        )
    merged = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.any_value(F.struct("path", "sizes")).alias("way"),
    )
    size = F.get(F.col("way.sizes"), F.lit(depth - 1)) if depth else F.lit(0).cast("long")
    parent = F.get(F.col("way.path"), F.lit(depth - 2)) if depth > 1 else F.lit(ROOT if depth else None).cast("binary")
    return merged.select(
        "key", parent.alias("parent"), F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), F.col("way.path").alias("path"), F.col("way.sizes").alias("sizes"),
    )


def _peel_tail(cut: int):
    """The same peeling inside a task, down to level `cut` + 1; its nodes keep their path for the level above."""

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ending: dict[int, list] = {}
        for batch in batches:
            for conv, keys, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "keys", "sizes")), strict=True):
                ending.setdefault(len(keys), []).append((conv, keys, sizes))
        kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in NODE.split(", "))])
        level: dict[bytes, list] = {}  # key -> [least conversation, conversations, children, leaves, saved, keys, sizes]
        for depth in range(max(ending, default=0), cut, -1):
            here: dict[bytes, list] = {}
            for low, n, _, leaves, saved, keys, sizes in level.values():
                node = here.setdefault(keys[depth - 1], [low, 0, 0, 0, 0, keys, sizes])
                node[0] = min(node[0], low)
                node[1:5] = node[1] + n, node[2] + 1, node[3] + leaves, node[4] + saved
            for conv, keys, sizes in ending.get(depth, ()):
                node = here.setdefault(keys[depth - 1], [conv, 0, 0, 0, 0, keys, sizes])
                node[0] = min(node[0], conv)
                node[1] += 1
            rows = []
            for key, node in here.items():
                keys, sizes = node[5:]
                node[3] = node[3] if node[2] else 1
                node[4] += (node[1] - 1) * sizes[depth - 1]
                last = depth == cut + 1
                rows.append(
                    (key, keys[depth - 2] if depth > 1 else ROOT, depth, *node[:5], keys[: depth - 1] if last else None,
                     sizes[:depth] if last else None)
                )
            level = here
            if rows:
                columns = [pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return peel


def _cut(convs: DataFrame, tail_turns: int, tail_share: float) -> tuple[int, int]:
    """(longest conversation, deepest level that isn't peeled inside tasks), from the counts of lengths.

    Distinct lengths are few: n of them take n * n / 2 turns.
    """
    lengths = {r["len"]: r["n"] for r in convs.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}
    longest = max(lengths, default=0)
    room = min(tail_turns, tail_share * sum(k * n for k, n in lengths.items()))
    cut, alive = longest, 0
    while cut > 1:
        alive += lengths.get(cut, 0)
        room -= alive
        if room < 0:
            break
        cut -= 1
    return longest, cut


def nodes(convs: DataFrame, tail_turns: int = TAIL_TURNS, tail_share: float = TAIL_SHARE) -> DataFrame:
    """All trie nodes of settled conversations (`with_keys`), without the names of their parents."""
    longest, cut = _cut(convs, tail_turns, tail_share)
    found, below = [], None
    if longest > cut:
        long = convs.filter(F.col("len") > cut).withColumn("at", _prefix_key("keys", F.lit(cut))).repartition("at")
        tail = settle(long.select("conv_id", "keys", "sizes").mapInArrow(_peel_tail(cut), NODE), "trie-tail")
        found, below = [tail], tail.filter(F.col("depth") == cut + 1)
    for depth in range(cut, -1, -1):
        below = settle(_level(depth, convs.filter(F.col("len") == depth), below), "trie-level")
        found.append(below)
    out = found[0].drop("path", "sizes")
    for more in found[1:]:
        out = out.unionByName(more.drop("path", "sizes"))
    return out


def _end_hashes(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids from its ordered blocks, carried over batches."""

    def batch_of(keys: list, hashes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])

    now, state = None, None
    for batch in blocks:
        keys, out = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if state is not None:
                    keys.append(now)
                    out.append(state.hexdigest())
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield batch_of(keys, out)
    if state is not None:
        yield batch_of([now], [state.hexdigest()])


def end_hashes(convs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end.

    A hash over a list is sequential; a node with very many ends passes as one
    short text per block of `ID_BLOCK` ids, read in order and never held whole.
    """
    block = F.floor(F.col("conv_id") / ID_BLOCK)
    blocks = convs.groupBy(F.col("end").alias("key"), block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    dealt = blocks.select("key", "block", text.alias("ids")).repartition("key").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_end_hashes, "key binary, ends_sha256 string")


def with_parents(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """Nodes with `parent_conv_id`; children of very wide nodes aren't gathered to find it."""
    wide = max(wide, found.count() // 10_000)
    parents = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("w"))
    hot = F.broadcast(parents.filter(F.col("w") > wide).drop("w"))
    others = found.join(hot, "parent", "left_anti")
    return found.join(hot, "parent").unionByName(others.join(parents.filter(F.col("w") <= wide).drop("w"), "parent", "left"))


def trie(conversations: DataFrame, fork: bool = True, tail_turns: int = TAIL_TURNS, tail_share: float = TAIL_SHARE, wide: int = WIDE) -> DataFrame:
    """Every node of the trie of conversations (conv_id, turn, role, text).

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 and `node`, the node's key. With `fork`
    conversations are rebuilt first (`forked`); without, they are taken as they are.

    Null role or text: empty. Null turn: first. Rows without a conv_id belong to
    no conversation and are left out. Equal turn numbers: by role, then by a
    digest; repeated rows are turns of their own. Negative ids follow the sign
    of the dividend in c % 5. Very long texts are hashed in place; a very long
    conversation is one row of 24 bytes a turn. A table without conversations
    has no node, not even a root. Further columns are ignored.
    """
    turns = ordered_turns(conversations.select("conv_id", "turn", "role", "text"))
    convs = settle(with_keys(forked(turns) if fork else turns.select("conv_id", "turns")), "conversations")
    found = settle(nodes(convs, tail_turns, tail_share), "trie")
    ends = settle(end_hashes(convs), "ends")
    none = hashlib.sha256(b"").hexdigest()
    return with_parents(found, wide).join(ends, "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.hex("key").alias("node"),
    )


_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, x:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) FROM range(256) r(i))"""

SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t
), turns AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, base, xor(list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id, base FROM turns), crc
), rebuilt AS (
  SELECT i.conv_id, k, role, text FROM ids i JOIN turns t ON t.conv_id = i.base AND k <= h
  UNION ALL
  SELECT i.conv_id, k, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND k > h
), paths AS (
  SELECT i.conv_id, coalesce(p, []) AS p, coalesce(s, []) AS s
  FROM ids i LEFT JOIN (
    SELECT conv_id, list(md5(strlen(role)::VARCHAR || ':' || role || text) ORDER BY k) AS p,
      list(strlen(text) ORDER BY k) AS s
    FROM rebuilt GROUP BY conv_id) USING (conv_id)
), prefixes AS (
  SELECT conv_id, d, array_to_string(p[1:d], '') AS key, array_to_string(p[1:greatest(d - 1, 0)], '') AS up,
    CASE WHEN d > 0 THEN s[d] ELSE 0 END AS size, d = len(p) AS ended
  FROM (SELECT conv_id, p, s, unnest(range(len(p) + 1)) AS d FROM paths)
), nodes AS (
  SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends
  FROM prefixes GROUP BY key, d
), kids AS (
  SELECT up AS key, d - 1 AS d, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT a.key, a.d, count(*) FILTER (WHERE kids IS NULL) AS leaves, sum((n.n - 1) * n.size) AS saved
  FROM nodes n LEFT JOIN kids USING (key, d) JOIN prefixes a ON a.conv_id = n.conv_id AND a.d <= n.d
  GROUP BY a.key, a.d
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs,
  coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b ON b.key = n.key AND b.d = n.d
LEFT JOIN kids k ON k.key = n.key AND k.d = n.d
LEFT JOIN nodes p ON n.d > 0 AND p.key = n.up AND p.d = n.d - 1
"""
