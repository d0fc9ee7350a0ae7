import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lendwell.operators import importance, metrics, profile
from lendwell.operators.ranking import (
    exact_percentiles,
    first_by_hash,
    hash_order,
    hash_rank,
    running_sum,
)


def test_percentiles_match_numpy(spark):
    rng = random.Random(3)
    big = [rng.choice([5.0, rng.gauss(0, 1e4)]) for _ in range(6000)]
    rows = [(big[i], float(i % 7) if i % 3 else None, 1.5 if i < 2 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = {(r[0], r[1]): r[2] for r in exact_percentiles(df, ["a", "b", "c"], [0, 0.25, 0.5, 0.9, 1]).collect()}
    for i, c in enumerate("abc"):
        values = [r[i] for r in rows if r[i] is not None]
        for p in (0, 0.25, 0.5, 0.9, 1):
            assert got[(c, p)] == pytest.approx(np.percentile(values, 100 * p), abs=1e-9)


def test_percentiles_with_large_columns_in_buckets(spark):
    df = spark.range(1, 5001).select(F.col("id").cast("double").alias("v"))
    assert exact_percentiles(df, ["v"], [0.5]).first()["value"] == 2500.5


def test_running_sum_with_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 5).alias("v"),
    )
    for down in (False, True):
        order = F.col("o").desc() if down else F.col("o")
        want = df.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy(order)))
        got = running_sum(df, ["g"], "o", {"v": "s"}, descending=down)
        assert got.select("g", "o", "s").exceptAll(want.select("g", "o", "s")).count() == 0
        assert got.count() == 3000


def test_hash_rank_and_quota(spark):
    df = spark.range(2000).select(
        F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("c")
    ).withColumn("h", hash_order(42, F.col("k")))
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("h", "k")))
    got = hash_rank(df, ["c"], "h", "k", "r")
    assert got.select("k", "r").exceptAll(want.select("k", "r")).count() == 0
    flagged = first_by_hash(df, "c", "h", "k", F.lit(150), "f").where("f")
    assert flagged.select("k").exceptAll(want.where("r <= 150").select("k")).count() == 0
    assert flagged.count() == 300


def brute(labels, scores):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, seen_pos = 0.0, 0
    for t in sorted(set(scores), reverse=True):
        hits = sum(1 for s, y in zip(scores, labels) if s >= t and y)
        total = sum(1 for s in scores if s >= t)
        ap += (hits - seen_pos) / len(pos) * hits / total
        seen_pos = hits
    return auc, ap


def test_ranking_metrics_match_pairs(spark):
    rng = random.Random(5)
    rows = [(g, rng.random() < 0.4, round(rng.random(), 1 if g else 3)) for g in (0, 1) for _ in range(300)]
    df = spark.createDataFrame([(g, int(y), float(s)) for g, y, s in rows], "g int, y int, s double")
    got = metrics.ranking_metrics(metrics.ranking_curve(df, ["g"], "y", "s"), ["g"]).collect()
    for r in got:
        mine = [(y, s) for g, y, s in rows if g == r["g"]]
        auc, ap = brute([y for y, _ in mine], [s for _, s in mine])
        assert r["roc_auc"] == pytest.approx(auc) and r["average_precision"] == pytest.approx(ap)


def test_classification_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = metrics.classification_metrics(df, [], "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_champion_ignores_holdout(spark):
    df = spark.createDataFrame(
        [("a", 0.80, 0.5, 0.5, 0.99), ("b", 0.85, 0.5, 0.5, 0.01), ("c", 0.85, 0.4, 0.9, 0.5)],
        "run_name string, cv_f1_mean double, cv_average_precision_mean double, cv_roc_auc_mean double, holdout_f1 double",
    )
    assert metrics.select_champion(df).first()["run_name"] == "b"
    with pytest.raises(ValueError):
        metrics.require_runs(df.limit(0))


def test_importance_counts_absent_features_as_zero(spark):
    df = spark.createDataFrame(
        [(0, "loan_type_1", 1.0), (0, "loan_type_2", 1.0), (0, "income", 2.0), (1, "income", 5.0)],
        "fold int, encoded_name string, importance double",
    )
    rows = {r["feature"]: r for r in importance.importance_by_feature(df, ["loan_type", "loan", "income"]).collect()}
    assert rows["income"]["importance_mean"] == pytest.approx(0.75)
    assert rows["loan_type"]["importance_mean"] == pytest.approx(0.25)
    assert rows["loan_type"]["importance_std"] == pytest.approx(0.25)
    assert rows["income"]["rank"] == 1


def test_histogram_and_duplicates(spark):
    df = spark.createDataFrame([(float(i),) for i in range(81)], "v double")
    rows = {r["bin"]: r["n"] for r in profile.histogram(df, "v").collect()}
    assert len(rows) == 40 and rows[39] == 3 and sum(rows.values()) == 81
    dup = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("a", None)], "x string, y int")
    assert profile.duplicate_rows(dup).first()[0] == 2
