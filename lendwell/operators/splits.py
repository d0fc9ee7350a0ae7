"""Stratified holdout and folds by hash order within each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.operators.ranking import first_by_hash, hash_order, hash_rank


def stratified_holdout(
    df: DataFrame,
    key: str,
    target: str = fv.TARGET,
    share: float = fv.HOLDOUT_SHARE,
    seed: int = fv.SAMPLE_SEED,
) -> DataFrame:
    """Add `is_holdout`: the first `share` of each class by hash order."""
    rows = df.withColumn("_h", hash_order(seed, F.col(key)))
    quota = F.round(F.col("_total") * F.lit(share))
    return first_by_hash(rows, target, "_h", key, quota, "is_holdout").drop("_h")


def stratified_folds(
    df: DataFrame,
    key: str,
    target: str = fv.TARGET,
    k: int = fv.CV_FOLDS,
    seed: int = fv.SAMPLE_SEED,
) -> DataFrame:
    """Add `fold` in 0..k-1; class counts of two folds differ by at most one."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    rows = df.withColumn("_h", hash_order(seed, F.col(key)))
    ranked = hash_rank(rows, [target], "_h", key, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank")


def fold_split(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training rows and validation rows of one fold."""
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
