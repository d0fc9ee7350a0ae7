"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut into halves, each half has its own codebook, and a vector lies
in the cell of its two nearest codes. A search visits cells in the order of the
sum of its two distances (the multi-sequence order) until as many are visited
as reach the wanted recall for neighbours exactly at the threshold, and every
vector of a visited cell is verified by its cosine in double precision.

All vectors search, so a pair is missed only if both searches miss it. Vectors
meet by label and first code: a search is sent once for each first code among
its cells. There one product verifies it against all cells of that code, those
beyond the visited ones included; no link that is verified is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lendwell.llm.common import attach, settle
from lendwell.llm.graph import components

THRESHOLD = 0.93
#: Share of neighbours at the threshold that one search reaches.
RECALL = 0.95
#: Vectors that codebooks are fitted on, and searches that set the number of visits.
SAMPLE, SEARCHES = 20_000, 1_000
#: Wanted mean number of vectors in a cell of the grid, over all labels.
OCCUPANCY = 16
CODES_MOST = 512
#: Members and searches of one block.
MEMBERS, QUERIES = 4096, 8192
_CODES = T.StructType(
    [T.StructField("i", T.IntegerType()), T.StructField("firsts", T.ArrayType(T.IntegerType()))]
)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = _distances(x, centres).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))


class Grid:
    """Two codebooks and the number of cells a search visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits

    @classmethod
    def fit(cls, sample: np.ndarray, vectors: int, threshold: float, recall: float) -> Grid:
        """Codebooks from a sample; `vectors`, the number of all, sets their size.

        The number of visits comes from made-up neighbours: for some sample
        vectors a direction is drawn, and the neighbour at exactly the threshold
        in that direction must lie in a visited cell in `recall` of the cases.
        """
        rng = np.random.default_rng(11)
        want = 2 ** math.ceil(math.log2(max(2.0, math.sqrt(vectors / OCCUPANCY))))
        codes = max(1, min(want, CODES_MOST, len(sample)))
        half = sample.shape[1] // 2
        grid = cls(_kmeans(sample[:, :half], codes, rng), _kmeans(sample[:, half:], codes, rng))
        at = sample[rng.choice(len(sample), min(SEARCHES, len(sample)), replace=False)]
        off = rng.normal(size=at.shape)
        off -= (off * at).sum(1)[:, None] * at
        off /= np.maximum(np.linalg.norm(off, axis=1), 1e-12)[:, None]
        other = threshold * at + math.sqrt(1 - threshold**2) * off
        ranks = []
        for a, b in zip(np.array_split(at, len(at) // 50 + 1), np.array_split(other, len(at) // 50 + 1), strict=True):
            da, db = grid.distances(a)
            ea, eb = grid.distances(b)
            row = np.arange(len(a))
            goal = da[row, ea.argmin(1)] + db[row, eb.argmin(1)]
            ranks.append((da[:, :, None] + db[:, None, :] <= goal[:, None, None]).sum((1, 2)))
        grid.visits = int(np.quantile(np.concatenate(ranks), recall, method="higher"))
        return grid

    @property
    def codes(self) -> int:
        return len(self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector visits, nearest first; the first one is its own.

        Among sorted distances, the pair at places (a, b) comes after all pairs
        at places up to a and b, so only pairs with (a + 1) * (b + 1) <= visits
        can be among the nearest.
        """
        d1, d2 = self.distances(x)
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        most = min(self.visits, self.codes**2)
        a, b = np.array([(p, q) for p in range(self.codes) for q in range(min(self.codes, most // (p + 1)))]).T
        row = np.arange(len(x))[:, None]
        sums = d1[row, o1[:, a]] + d2[row, o2[:, b]]
        picked = sums.argsort(1, kind="stable")[:, :most]
        return o1[row, a[picked]] * self.codes + o2[row, b[picked]]


def unit(vectors: pa.Array) -> np.ndarray:
    """Vectors of one dimension as unit rows in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _usable(v: Column, label: Column) -> Column:
    """Not null, of two components or more, all finite, not all zero."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(
        label.isNotNull() & (F.size(v) > 1) & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0), F.lit(False)
    )


def _block(members: pa.Table, searches: pa.Table, codes: int, threshold: float) -> pd.DataFrame:
    """Links between the members of a first code and the searches that visit it.

    A link that the other side's search also finds, since it visits this side's
    first code, is counted there for the other vector; else it is counted here
    for both. `root` names the least
    vector connected within the block.
    """
    m, q = unit(members["v"].combine_chunks()), unit(searches["v"].combine_chunks())
    m_cls, q_cls = members["cls"].to_numpy(), searches["cls"].to_numpy()
    m_copies, q_copies = members["copies"].to_numpy(), searches["copies"].to_numpy()
    at_q, at_m = [], []
    for low in range(0, len(q), 512):
        a, b = np.nonzero(q[low : low + 512] @ m.T >= threshold)
        at_q.append(a + low)
        at_m.append(b)
    a, b = np.concatenate(at_q), np.concatenate(at_m)
    other = q_cls[a] != m_cls[b]
    a, b = a[other], b[other]
    lists = members["firsts"].combine_chunks()
    owner = np.repeat(np.arange(len(m)), np.diff(lists.offsets))
    known = np.sort(owner * codes + lists.flatten().to_numpy())
    asked = b * codes + searches["i"].to_numpy()[a]
    both = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked if len(known) else np.zeros(len(a), bool)
    q_links, m_links = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64)
    np.add.at(q_links, a, m_copies[b])
    np.add.at(m_links, b[~both], q_copies[a[~both]])
    q_root, m_root = q_cls.copy(), m_cls.copy()
    while True:
        low = np.minimum(q_root[a], m_root[b])
        if (low == q_root[a]).all() and (low == m_root[b]).all():
            break
        np.minimum.at(q_root, a, low)
        np.minimum.at(m_root, b, low)
    q_some, m_some = np.zeros(len(q), bool), np.zeros(len(m), bool)
    q_some[a] = m_some[b] = True
    return pd.DataFrame(
        {
            "cls": np.concatenate([q_cls[q_some], m_cls[m_some]]),
            "links": np.concatenate([q_links[q_some], m_links[m_some]]),
            "root": np.concatenate([q_root[q_some], m_root[m_some]]),
        }
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Equal vectors of one label form a class, whose members link; classes search
    once. Codebooks are fitted on the `SAMPLE` classes of least hash; every
    class is indexed. Blocks hold at most about `MEMBERS` x `QUERIES` vectors and
    give counts and a forest, not pairs.

    Null labels, null or zero vectors, vectors of fewer than two components, and
    null or non-finite components: linked with nothing. Vectors of different
    dimensions never meet. Null vec_id: linked like any other, never the name of
    a component. Repeated rows: each is a vector. Empty table: empty result.
    Further columns are ignored.
    """
    rows = vectors.select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("v")
    ).withColumn("usable", _usable(F.col("v"), F.col("label")))
    rows = rows.withColumn("cls", F.when(F.col("usable"), F.xxhash64("label", F.size("v"), "v")))
    rows = settle(rows, "vectors")
    spark = rows.sparkSession
    classes = rows.filter("usable").groupBy("cls").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("label", "v")).alias("one")
    )
    classes = settle(classes.select("cls", "first", "copies", "one.*", F.size("one.v").alias("dim")), "vector-classes")

    found = None
    for dim, count in classes.groupBy("dim").agg(F.count(F.lit(1))).orderBy("dim").collect():
        part = _search(classes.filter(F.col("dim") == dim), count, threshold, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "cls long, links long, root long")
    found = settle(found, "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("cls", "first", "copies").join(roots, F.col("cls") == F.col("node"), "left")
    named = named.join(links, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(
        named.join(names, "root").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "names",
    )
    out = attach(rows.select("vec_id", "cls"), named, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _search(classes: DataFrame, count: int, threshold: float, recall: float) -> DataFrame:
    """(cls, links, root) from the blocks of one dimension."""
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("v").toArrow()
    grid = Grid.fit(unit(sample["v"].combine_chunks()), count, threshold, recall)
    codes = grid.codes

    @arrow_udf(_CODES)
    def coded(v: pa.Array) -> pa.Array:
        own, firsts, bounds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for at in range(0, len(v), 2048):
            cells = grid.cells(unit(v.slice(at, 2048)))
            own.append(cells[:, 0] // codes)
            rows = np.sort(cells // codes, axis=1)
            fresh = np.c_[np.ones(len(rows), bool), rows[:, 1:] != rows[:, :-1]]
            firsts.append(rows[fresh])
            bounds.append(bounds[-1][-1] + np.cumsum(fresh.sum(1)))
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(np.concatenate(firsts).astype(np.int32))
        )
        return pa.StructArray.from_arrays([pa.array(np.concatenate(own).astype(np.int32)), lists], fields=pa_fields)

    pa_fields = [pa.field("i", pa.int32()), pa.field("firsts", pa.list_(pa.int32()))]
    placed = settle(classes.select("cls", "label", "copies", "v", coded("v").alias("c")).select("cls", "label", "copies", "v", "c.*"), "coded")
    asked = placed.select("cls", "label", F.explode("firsts").alias("code"))
    # How many blocks each label and first code needs.
    size = placed.groupBy("label", F.col("i").alias("code")).agg(F.count(F.lit(1)).alias("m"))
    load = asked.groupBy("label", "code").agg(F.count(F.lit(1)).alias("q"))
    plan = size.join(load, ["label", "code"]).select(
        "label", "code", F.ceil(F.col("m") / MEMBERS).cast("int").alias("ms"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qs")
    )
    plan = settle(plan, "grid")
    members = attach(placed.withColumn("code", F.col("i")), plan, ["label", "code"])
    members = members.withColumn("mb", F.pmod(F.xxhash64("cls"), "ms")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    members = members.select("label", "code", "mb", F.col("qb").cast("long").alias("qb"), "cls", "copies", "v", "firsts")
    searches = attach(placed.withColumn("code", F.explode("firsts")), plan, ["label", "code"])
    searches = searches.withColumn("qb", F.pmod(F.xxhash64("cls", F.lit(1)), "qs")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    # Columns of their own, since both sides come from one frame.
    searches = searches.select(F.col("mb").cast("long").alias("mb"), *[F.col(c).alias(c) for c in ("label", "code", "qb", "cls", "copies", "v", "i")])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        return pa.Table.from_pandas(_block(left, right, codes, threshold), preserve_index=False)

    key = ["label", "code", "mb", "qb"]
    return members.groupBy(*key).cogroup(searches.groupBy(*key)).applyInArrow(block, "cls long, links long, root long")
