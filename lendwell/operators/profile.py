"""Profiles of a table: missing values, distributions, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwell.functions.cleaning import col
from lendwell.operators.ranking import exact_percentiles


def _is_missing(c: str, dtype: T.DataType) -> Column:
    missing = col(c).isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(col(c))
    return missing


def _unpivot(columns: dict[str, Column], value: str) -> Column:
    cells = [F.struct(F.lit(n).alias("column_name"), v.alias(value)) for n, v in columns.items()]
    return F.inline(F.array(*cells))


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing values per column; all columns in one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(columns or df.columns)
    seen = df.agg(
        *(F.avg(_is_missing(c, types[c]).cast("int")).alias(c) for c in columns)
    )
    return seen.select(_unpivot({c: F.round(col(c), 6) for c in columns}, "missing_share"))


def missingness_by(df: DataFrame, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """`missingness` within each value of `by`."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(columns or df.columns)
    seen = df.groupBy(F.col(by).alias("group_value")).agg(
        *(F.avg(_is_missing(c, types[c]).cast("int")).alias(c) for c in columns)
    )
    return seen.select(
        "group_value", _unpivot({c: F.round(col(c), 6) for c in columns}, "missing_share")
    )


def null_counts(df: DataFrame) -> DataFrame:
    seen = df.agg(
        *(F.count_if(_is_missing(f.name, f.dataType)).alias(f.name) for f in df.schema.fields)
    )
    return seen.select(_unpivot({c: col(c) for c in df.columns}, "null_count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Extra copies of whole rows; only row fingerprints are shuffled."""
    row = F.to_json(F.struct(*(col(c) for c in df.columns)), {"ignoreNullFields": "false"})
    copies = df.select(F.sha2(row, 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share (six decimals) of each value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # The input is read once; the window sees one row for each value.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("value", "n", F.round(F.col("n") / total, 6).alias("proportion"))


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value); the rows are unpivoted and pre-aggregated per task."""
    cells = {c: col(c).cast("string") for c in columns}
    return (
        df.select(_unpivot(cells, "value"))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    numbers = df.select(*(col(c).cast("double").alias(c) for c in columns))
    moments = numbers.agg(
        *(
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(c)
            for c in columns
        )
    ).select(_unpivot({c: F.col(f"`{c}`") for c in columns}, "m"))
    quartiles = (
        exact_percentiles(numbers, columns, [0.25, 0.5, 0.75])
        .withColumnRenamed("column", "column_name")
        .groupBy("column_name")
        .agg(
            *(
                F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
                for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
            )
        )
    )
    return moments.join(quartiles, "column_name", "left").select(
        "column_name",
        F.col("m.n").alias("n"),
        F.round("m.mean", 6).alias("mean"),
        F.round("m.std", 6).alias("std"),
        F.col("m.min").alias("min"),
        F.round("q1", 6).alias("q1"),
        F.round("median", 6).alias("median"),
        F.round("q3", 6).alias("q3"),
        F.col("m.max").alias("max"),
    )


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    seen = df.agg(*(F.count_if(col(c) < 0).alias(c) for c in columns))
    return seen.select(_unpivot({c: col(c) for c in columns}, "negative_count"))


def invalidate_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative values become null (the first-generation cleaning rule)."""
    return df.withColumns({c: F.when(~(col(c) < 0), col(c)) for c in columns})


def repair_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative values lose their sign (the exploratory cleaning rule)."""
    return df.withColumns({c: F.abs(col(c)) for c in columns})


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form; one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def both(x: str, y: str) -> Column:
        return F.when(col(x).isNotNull() & col(y).isNotNull(), col(x).cast("double"))

    seen = df.agg(*(F.corr(both(a, b), both(b, a)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    cells = [
        F.struct(
            F.lit(x).alias("column_a"),
            F.lit(y).alias("column_b"),
            F.round(F.col(f"r{i}"), 6).alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
        for x, y in dict.fromkeys([(a, b), (b, a)])
    ]
    return seen.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins from minimum to maximum; the last bin is closed."""
    value = df.select(col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    edge = value.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins or 1.0
    bin_of = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = value.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        F.round(lo + F.col("bin") * width, 6).alias("lower"),
        F.round(lo + (F.col("bin") + 1) * width, 6).alias("upper"),
        "n",
    )


def type_census(df: DataFrame) -> DataFrame:
    """Number of columns per type, with the table's row count."""
    kinds: dict[str, int] = {}
    for _, kind in df.dtypes:
        kinds[kind] = kinds.get(kind, 0) + 1
    cells = [
        F.struct(F.lit(k).alias("data_type"), F.lit(n).cast("bigint").alias("n_columns"))
        for k, n in sorted(kinds.items())
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(F.array(*cells)))


def low_information_audit(
    df: DataFrame,
    columns: Sequence[str],
    max_missing: float = 0.9,
    rare_share: float = 0.01,
) -> DataFrame:
    """Finding per column: constant, mostly missing, one value nearly everywhere, or keep."""
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = (
        df.select(_unpivot({c: F.when(~_is_missing(c, types[c]), col(c).cast("string")) for c in columns}, "value"))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    value_n = F.when(F.col("value").isNotNull(), F.col("n"))
    seen = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(value_n), F.lit(0)).alias("present"),
        F.coalesce(F.max(value_n), F.lit(0)).alias("top"),
    )
    missing = 1 - F.col("present") / F.col("rows")
    other = F.when(F.col("present") > 0, 1 - F.col("top") / F.col("present"))
    finding = (
        F.when(missing > max_missing, "mostly_missing")
        .when(F.col("distinct_values") <= 1, "constant")
        .when(other < rare_share, "rare_values")
        .otherwise("retain")
    )
    return seen.select(
        "column_name",
        "distinct_values",
        F.round(missing, 6).alias("missing_share"),
        F.round(other, 6).alias("other_share"),
        finding.alias("finding"),
    )
