"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendwell.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
#: Mean rows of one range in which rows are numbered.
RANGE_ROWS = 10_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and
    what is used several times is computed once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_draw(*parts: Column | str) -> Column:
    """A reproducible draw in (0, 1): the first 52 bits of an MD5 over the parts."""
    text = F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def key_text(c: Column) -> Column:
    """An identifier as text; null has a text of its own."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def numbered(rows: DataFrame, group: str, by: list[Column], name: str, settled: list | None = None) -> DataFrame:
    """`name`: a gapless number from 0 in each `group`, without ordering a whole group in one task.

    Rows fall into hash ranges whose number follows the table's size, the counts
    of the ranges give their offsets, and rows are numbered inside their range.
    The rows are written once first; `settled` receives the written frame.
    """
    cut = settle(rows.withColumn("_hash", F.xxhash64(*by)), "numbered")
    if settled is not None:
        settled.append(cut)
    cut = cut.withColumn("_range", F.pmod("_hash", F.lit(1 + cut.count() // RANGE_ROWS)))
    counts = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(W.partitionBy(group).orderBy("_range")) - F.col("n")
    offsets = counts.select(group, "_range", offset.alias("_offset"))
    inside = F.row_number().over(W.partitionBy(group, "_range").orderBy(*by))
    return (
        cut.withColumn("_inside", inside)
        .join(offsets, [group, "_range"])
        .withColumn(name, (F.col("_offset") + F.col("_inside") - 1).cast("long"))
        .drop("_hash", "_range", "_inside", "_offset")
    )


#: A side of at most this many short rows is sent to all tasks; a larger one is joined by shuffling.
SMALL_ROWS = 50_000


def attach(rows: DataFrame, small: DataFrame, condition, how: str = "inner", limit: int = SMALL_ROWS) -> DataFrame:
    """Join `rows` with a settled frame whose size is counted first.

    A frame of few rows goes to every task, so that a key with a third of all
    rows moves nothing; beyond `limit` rows Spark shuffles and splits as usual.
    """
    if small.count() <= limit:
        small = F.broadcast(small)
    return rows.join(small, condition, how)
