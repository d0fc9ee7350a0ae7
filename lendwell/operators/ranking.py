"""Exact order statistics without a one-task window.

A plain window over one global order, or over a class that holds a third of the
rows, sorts all of them in one task. Here rows are first put into many ordered
buckets; the small table of bucket totals is summed up, and only rows of one
bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isfinite
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwell.session import shared_folder, task_slots, written

HEX_DIGITS = 4  # 65,536 hash buckets


def hash_order(seed: int, key: Column) -> Column:
    """Reproducible pseudo-random order of a unique key, as md5 text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(h: Column, digits: int = HEX_DIGITS) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def _sum_before(totals: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Exclusive running sum over the buckets of each group."""
    window = (
        Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.withColumn("_before", F.coalesce(F.sum(value).over(window), F.lit(0)))


def quantile_buckets(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """Add `_bucket`, rising with `order` and of about equal size.

    The cuts are approximate quantiles; only the cuts (a bounded list) come to
    the driver, and the result of any exact operator does not depend on them.
    """
    as_double = df.withColumn("_order", F.col(order).cast("double"))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = as_double.approxQuantile("_order", probs, 1.0 / (4 * buckets)) if probs else []
    splits = [-float("inf"), *sorted({c for c in cuts if isfinite(c)}), float("inf")]
    if len(splits) == 2:
        return df.withColumn("_bucket", F.lit(0.0))
    cutter = Bucketizer(
        splits=splits, inputCol="_order", outputCol="_bucket", handleInvalid="keep"
    )
    return cutter.transform(as_double).drop("_order")


def running_sum(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    values: dict[str, str],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums of `values` (column -> output name) by a numeric order.

    `order` must be unique within a group; aggregate ties first. The input is
    written to the checkpoint folder once, because it is read for the cuts, the
    bucket totals and the sums. One bucket is for inputs of a known small size.
    """
    if buckets != 1:
        shared_folder(df.sparkSession)
        df = df.checkpoint()
        buckets = buckets or 4 * task_slots(df.sparkSession)
    df = quantile_buckets(df, order, buckets)
    if descending:
        df = df.withColumn("_bucket", -F.col("_bucket"))
    keys = [*groups, "_bucket"]
    before = {v: f"_before_{i}" for i, v in enumerate(values)}
    totals = df.groupBy(*keys).agg(*(F.sum(v).alias(b) for v, b in before.items()))
    earlier = (
        Window.partitionBy(*groups or [F.lit(0)])
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(
        *keys, *(F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before.values())
    )
    by = F.col(order).desc() if descending else F.col(order).asc()
    inside = (
        Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    )
    sums = {out: F.col(before[v]) + F.sum(v).over(inside) for v, out in values.items()}
    return df.join(totals, keys).withColumns(sums).drop("_bucket", *before.values())


def hash_rank(df: DataFrame, groups: Sequence[str], h: str, key: str, out: str) -> DataFrame:
    """Exact 1-based rank by (hash, key) within each group; null is a group too."""
    rows = df.withColumn("_bucket", hash_bucket(F.col(h)))
    keys = [*groups, "_bucket"]
    totals = _sum_before(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), groups, "_n")
    totals = totals.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(h, key)
    ranked = rows.join(totals, reduce(and_, same))
    return ranked.withColumn(out, F.col("_before") + F.row_number().over(inside)).drop(
        "_bucket", "_before", *(f"_of_{k}" for k in keys)
    )


def first_by_hash(
    df: DataFrame, group: str, h: str, key: str, quota: Column, flag: str
) -> DataFrame:
    """Flag the first rows by (hash, key) of each group, up to the group's quota.

    `quota` is an expression over `_total`, the group's row count. Group, hash
    and key are written once; two aggregates of them find the last accepted
    (hash, key) of each group, and every row is compared with its group's. Only
    the rows of the bucket in which a quota ends are put in order. Null is a
    group like any other.
    """
    narrow = written(
        df.select(group, h, key).withColumn("_bucket", hash_bucket(F.col(h))), "hash-order"
    )
    counts = narrow.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cells = _sum_before(counts, [group], "_n")
    cells = cells.withColumn("_total", F.sum("_n").over(Window.partitionBy(group)))
    cells = cells.withColumn("_quota", quota.cast("bigint"))
    used_up = (F.col("_before") < F.col("_quota")) & (
        F.col("_before") + F.col("_n") >= F.col("_quota")
    )
    limits = written(
        cells.groupBy(F.col(group).alias("_of")).agg(
            (F.max("_quota") >= F.max("_total")).alias("_all_in"),
            F.max("_quota").alias("_quota"),
            F.max(F.when(used_up, F.struct("_bucket", "_before"))).alias("_edge"),
        ),
        "hash-limits",
    )
    own = F.col(group).eqNullSafe(F.col("_of"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    last = (
        narrow.join(limits, own & (F.col("_bucket") == F.col("_edge._bucket")))
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_quota") - F.col("_edge._before"))
        .select(F.col("_of").alias("_last_of"), F.col(h).alias("_last_h"), F.col(key).alias("_last_key"))
    )
    cuts = written(
        limits.join(last, F.col("_of").eqNullSafe(F.col("_last_of")), "left").select(
            "_of", "_all_in", "_last_h", "_last_key"
        ),
        "hash-cuts",
    )
    upto = (F.col(h) < F.col("_last_h")) | (
        (F.col(h) == F.col("_last_h")) & (F.col(key) <= F.col("_last_key"))
    )
    accept = F.col("_all_in") | F.coalesce(upto, F.lit(False))
    return (
        df.join(cuts, own, "left")
        .withColumn(flag, F.coalesce(accept, F.lit(False)))
        .drop("_of", "_all_in", "_last_h", "_last_key")
    )


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], error: float = 0.001
) -> DataFrame:
    """Exact interpolated percentiles, one row per (column, prob).

    A first pass brackets each wanted position by approximate quantiles. In the
    second pass all values below a bracket count as one, values above it are
    dropped, and only distinct values inside it are put in order.
    """
    spark = df.sparkSession
    probs = list(probs)
    numbers = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
    points = [min(1.0, max(0.0, p + side * 2 * error)) for p in probs for side in (-1, 1)]
    seen = numbers.agg(
        *(
            F.struct(
                F.count(c).alias("n"),
                F.min(c).alias("lo"),
                F.max(c).alias("hi"),
                F.percentile_approx(c, points, int(2 / error)).alias("cuts"),
            ).alias(c)
            for c in columns
        )
    ).first()
    cells = []
    for c in columns:
        n, cuts = seen[c]["n"], seen[c]["cuts"]
        if not n:
            continue
        for i, p in enumerate(probs):
            low = int(p * (n - 1))
            # Short columns: the bracket may miss a neighbour, so take all values.
            short = n * error < 2
            lo = seen[c]["lo"] if short else cuts[2 * i]
            hi = seen[c]["hi"] if short else cuts[2 * i + 1]
            v = F.col(f"`{c}`")
            cells.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(float(p)).alias("prob"),
                    F.lit(low).cast("long").alias("low"),
                    F.lit(float(p * (n - 1) - low)).alias("part"),
                    F.when(v < F.lit(lo), -float("inf")).when(v <= F.lit(hi), v).alias("v"),
                )
            )
    if not cells:
        return spark.createDataFrame([], "column string, prob double, value double")
    # The brackets stand in the row as constants, so the values meet no join.
    counts = (
        numbers.select(F.inline(F.array(*cells)))
        .where(F.col("v").isNotNull())
        .groupBy("column", "prob", "low", "part", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    summed = running_sum(counts, ["column", "prob"], "v", {"n": "upto"})
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1

    def at_position(position: Column) -> Column:
        return F.max(F.when(position.between(first, last), F.col("v")))

    return (
        summed.groupBy("column", "prob")
        .agg(
            at_position(F.col("low")).alias("a"),
            at_position(F.col("low") + 1).alias("b"),
            F.max("part").alias("part"),
        )
        .select(
            "column",
            "prob",
            F.when(F.col("part") == 0, F.col("a"))
            .otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
            .alias("value"),
        )
    )
