"""Classification and ranking metrics of any (group, label, prediction, score) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.operators.ranking import running_sum

METRICS = ("precision", "recall", "f1", "roc_auc", "average_precision")


def _ratio(num: Column, den: Column) -> Column:
    """num/den, and 0 where the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(0.0)


def confusion_cells(df: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """tn, fp, fn, tp per group in one aggregate."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*groups).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row per (actual, predicted), labels 0 and 1, empty cells included."""
    names = ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    cells = [
        F.struct(
            F.lit(a).cast("int").alias("actual"),
            F.lit(p).cast("int").alias("predicted"),
            F.col(c).alias("n"),
        )
        for a, p, c in names
    ]
    return confusion_cells(df, [], label, pred).select(F.inline(F.array(*cells)))


def classification_metrics(
    df: DataFrame, groups: Sequence[str], label: str, pred: str
) -> DataFrame:
    """Precision, recall, F1 of class 1 and accuracy; 0 on an empty denominator."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return confusion_cells(df, groups, label, pred).select(
        *groups,
        "tn", "fp", "fn", "tp",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )


def ranking_curve(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Per distinct score: its positives and rows, and both summed from the top score down.

    Ties are merged by a pre-aggregated groupBy first; the running sums are then
    taken per score bucket, so no global order meets in one task.
    """
    scores = df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    return running_sum(scores, groups, "score", {"pos": "tps", "n": "seen"}, descending=True)


def ranking_metrics(curve: DataFrame, groups: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties at half) and average precision from `ranking_curve`.

    A score group with p positives and q negatives adds q * (positives above +
    p / 2) to the area and p * precision to the average precision.
    """
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    tps, seen = F.col("tps").cast("double"), F.col("seen").cast("double")
    sums = curve.groupBy(*groups).agg(
        F.sum((n - pos) * (tps - pos / 2)).alias("area"),
        F.sum(pos * tps / seen).alias("ap"),
        F.sum(pos).alias("p"),
        F.sum(n - pos).alias("q"),
    )
    p, q = F.col("p"), F.col("q")
    return sums.select(
        *groups,
        F.when((p > 0) & (q > 0), F.col("area") / (p * q)).alias("roc_auc"),
        F.when(p > 0, F.col("ap") / p).alias("average_precision"),
    )


def _totals(curve: DataFrame) -> DataFrame:
    return curve.agg(F.max("tps").alias("_p"), F.max("seen").alias("_all"))


def roc_points(curve: DataFrame) -> DataFrame:
    """(score, fpr, tpr) per distinct score, and the origin with a null score."""
    t = _totals(curve).first()
    p, q = float(t["_p"] or 0), float((t["_all"] or 0) - (t["_p"] or 0))
    rows = curve.select(
        "score",
        _ratio(F.col("seen") - F.col("tps"), F.lit(q)).alias("fpr"),
        _ratio(F.col("tps"), F.lit(p)).alias("tpr"),
    )
    start = curve.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "score double, fpr double, tpr double"
    )
    return rows.unionByName(start)


def pr_points(curve: DataFrame) -> DataFrame:
    """(score, recall, precision) per distinct score, and the point (0, 1)."""
    p = float(_totals(curve).first()["_p"] or 0)
    rows = curve.select(
        "score",
        _ratio(F.col("tps"), F.lit(p)).alias("recall"),
        (F.col("tps") / F.col("seen")).alias("precision"),
    )
    start = curve.sparkSession.createDataFrame(
        [(None, 0.0, 1.0)], "score double, recall double, precision double"
    )
    return rows.unionByName(start)


def scored_metrics(
    df: DataFrame, groups: Sequence[str], label: str, pred: str, score: str
) -> DataFrame:
    """The five selection metrics per group."""
    by_threshold = classification_metrics(df, groups, label, pred)
    by_rank = ranking_metrics(ranking_curve(df, groups, label, score), groups)
    if not groups:
        one = F.lit(1).alias("_one")
        joined = by_threshold.select("*", one).join(by_rank.select("*", one), "_one")
        return joined.select(*METRICS)
    return by_threshold.join(by_rank, list(groups)).select(*groups, *METRICS)


def cv_summary(
    folds: DataFrame, groups: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean and population deviation of each metric over the folds of a run."""
    return folds.groupBy(*groups).agg(
        *(
            f
            for m in metrics
            for f in (F.avg(m).alias(f"cv_{m}_mean"), F.stddev_pop(m).alias(f"cv_{m}_std"))
        )
    )


def select_champion(runs: DataFrame) -> DataFrame:
    """The run with the best (F1, average precision, ROC-AUC); the smallest name on ties."""
    order = [F.col(c).desc() for c in ("cv_f1_mean", "cv_average_precision_mean", "cv_roc_auc_mean")]
    return runs.orderBy(*order, "run_name").limit(1)


def require_runs(runs: DataFrame) -> DataFrame:
    if runs.isEmpty():
        raise ValueError("no cross-validated runs to choose from")
    return runs


def robustness_delta(runs: DataFrame) -> DataFrame:
    """Robustness run minus baseline run of each family that has both; one pass."""
    names = ("cv_f1_mean", "cv_average_precision_mean", "cv_roc_auc_mean")

    def of(stage: str, c: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(c)))

    table = runs.groupBy("model_family").agg(
        of("baseline", "run_name").alias("full_run"),
        of("robustness", "run_name").alias("robust_run"),
        *((of("robustness", n) - of("baseline", n)).alias(f"delta_{n}") for n in names),
    )
    return table.where(F.col("full_run").isNotNull() & F.col("robust_run").isNotNull())
