"""Register and curated-table files: CSV in, curated table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwell import fixed_values as fv

REQUIRED_COLUMNS = tuple(
    dict.fromkeys(
        [fv.REGISTER_NAME.get(c, c) for c in (*fv.PREDICTORS, *fv.AUDIT_ONLY)]
        + list(fv.FILTER_COLUMNS)
    )
)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file line; only that line is read."""
    return [
        name.lstrip("﻿")
        for name in spark.read.option("header", True).csv(path, enforceSchema=False).columns
    ]


def require_columns(names: Sequence[str], required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"register lacks required columns: {missing}")


def scan_register(
    spark: SparkSession,
    path: str,
    extra: Sequence[str] = (),
    spread: int | None = None,
) -> DataFrame:
    """All-text scan of a CSV register (plain or gzip), required columns only.

    A gzip file is one split, so `spread` redistributes the rows right after
    the read; leave it out for splittable input.
    """
    header = csv_header(spark, path)
    require_columns(header)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)  # every file's header must be the first one's
        .option("encoding", "UTF-8")
        .option("emptyValue", "")
        .csv(path)
        .select(*(F.col(f"`{c}`") for c in (*extra, *REQUIRED_COLUMNS)))
    )
    return rows.repartition(spread) if spread else rows


CURATED_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.DoubleType()
            if name in fv.NUMERIC_COLUMNS
            else T.ByteType()
            if name == fv.TARGET
            else T.StringType(),
        )
        for name in fv.CURATED_COLUMNS
    ]
)


def scan_curated(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Curated table with the contract's types; nothing is inferred."""
    reader = spark.read.schema(CURATED_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Total length of the files below a path, as the file system reports it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(target).getLength())


def write_table(df: DataFrame, path: str) -> None:
    """Any cleaned table as CSV, its own columns in their order."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_curated(
    df: DataFrame, path: str, fmt: str = "parquet", limit_bytes: int | None = None
) -> int:
    """Write the curated table; fail where it exceeds a size limit. Returns the size."""
    writer = df.select(*fv.CURATED_COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("lineSep", "\n").csv(path)
    else:
        writer.parquet(path)
    size = written_bytes(df.sparkSession, path)
    if limit_bytes is not None and size >= limit_bytes:
        raise ValueError(f"curated table has {size} bytes, limit is {limit_bytes}")
    return size
