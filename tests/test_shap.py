import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendwell.operators import shap


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    x[:, 3] = (x[:, 3] > 0).astype(float)
    y = ((x[:, 0] + x[:, 1] * x[:, 3] > 0) ^ (rng.random(400) < 0.1)).astype(float)
    df = spark.createDataFrame(
        [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
        "id int, a double, b double, c double, d double, label double",
    )
    df = VectorAssembler(inputCols=list("abcd"), outputCol="encoded").transform(df)
    model = GBTClassifier(featuresCol="encoded", maxIter=4, maxDepth=3, seed=1).fit(df)
    return df, model, x


def tree_value(leaves_by_tree, x, known):
    """Expected margin when only `known` features are given: cold branches weighted by cover."""
    total = 0.0
    for leaf in leaves_by_tree:
        w = 1.0
        for f, lo, hi, cold in zip(leaf.features, leaf.lo, leaf.hi, leaf.cold):
            w *= float(lo < x[f] <= hi) if f in known else cold
        total += leaf.value * w
    return total


def test_values_are_shapley_values_and_additive(spark, fitted):
    df, model, x = fitted
    leaves, base = shap.read_leaves(model, spark)
    assert tree_value(leaves, x[0], set()) == pytest.approx(base)
    rows = shap.tree_shap(model.transform(df).select("id", "encoded", "probability", "rawPrediction"), model)
    got = {r["id"]: r for r in rows.collect()}
    margin = {
        r["id"]: r["m"] for r in model.transform(df).select("id", (2 * vector_to_array("rawPrediction")[1]).alias("m")).collect()
    }
    for i in range(400):
        assert base + sum(got[i]["shap"]) == pytest.approx(margin[i], abs=1e-9)
    for i in (0, 7, 31):
        for j in range(4):
            others = [k for k in range(4) if k != j]
            value = 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    value += w * (tree_value(leaves, x[i], {*s, j}) - tree_value(leaves, x[i], set(s)))
            assert got[i]["shap"][j] == pytest.approx(value, abs=1e-9)


def test_grouping_sums_before_the_absolute_value(spark):
    slots = shap.make_slots([("loan_type_1", "loan_type", "1"), ("loan_type_2", "loan_type", "2"), ("income", "income", None)])
    df = spark.createDataFrame([([1.0, -1.0, 0.5],), ([2.0, -2.0, 0.5],)], "shap array<double>")
    grouped = {r["model_feature"]: r for r in shap.grouped_importance(df, slots).collect()}
    assert grouped["loan_type"]["mean_abs_shap"] == 0.0 and grouped["loan_type"]["encoded_columns"] == 2
    assert grouped["income"]["mean_abs_shap"] == 0.5 and grouped["income"]["rank"] == 1
    encoded = shap.encoded_importance(df, slots).collect()
    assert sum(r["mean_abs_shap"] for r in encoded if r["model_feature"] == "loan_type") == 3.0


def test_top_factors(spark):
    slots = shap.make_slots([("loan_type_1", "loan_type", "1"), ("loan_type_9", "loan_type", "9"), ("income", "income", None)])
    df = spark.createDataFrame(
        [(0.2, [1.0, 0.0, 7.0], [0.5, -0.1, 0.5]), (0.3, [0.0, 1.0, 7.0], [0.0, 0.0, -2.0])],
        "income double, encoded_values array<double>, shap array<double>",
    ).withColumn("loan_type", F.lit("1"))
    rows = shap.with_top_factors(df, slots, 2, {c: F.col(c) for c in ("income", "loan_type")}).collect()
    up, down = rows[0]["top_positive_factors"], rows[0]["top_negative_factors"]
    assert [f["feature"] for f in up] == ["Loan type = Conventional (present)", "Annual income (USD thousands)"]
    assert down[0]["feature"] == "Loan type = unknown (code 9) (absent)" and down[0]["shap_value"] == -0.1
    assert up[1]["category_active"] is None and up[1]["application_value"] == "0.2"
    assert rows[1]["top_positive_factors"] == [] and len(rows[1]["top_negative_factors"]) == 1
    with pytest.raises(AssertionError):
        shap.make_slots([("derived_sex_x", "derived_sex", "x")])


def test_top_factors_of_odd_rows(spark):
    slots = shap.make_slots([("loan_type_1", "loan_type", "1"), ("income", "income", None)])
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, None, [0.0, 1.0]), (2, [nan, None], [0.0, 1.0]), (3, [0.5, 0.5], [None, 2.0]), (4, [-1.0, -2.0], [1.0, 2.0])],
        "id int, shap array<double>, encoded_values array<double>",
    ).withColumns({"loan_type": F.lit("1"), "income": F.lit(None).cast("double")})
    rows = shap.with_top_factors(df, slots, 1, {c: F.col(c) for c in ("income", "loan_type")})
    got = {r["id"]: (r["top_positive_factors"], r["top_negative_factors"]) for r in rows.collect()}
    assert got[1] == (None, None) and got[2] == ([], [])
    (tie,), none = got[3]
    assert none == [] and tie["slot"] == 0 and tie["encoded_value"] is None and tie["category_active"] is None
    assert tie["feature"].endswith("(absent)") and tie["application_value"] == "1" and tie["raw_code"] == "1"
    assert got[4][1][0]["slot"] == 1 and got[4][1][0]["application_value"] is None
