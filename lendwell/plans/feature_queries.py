"""Engineered features, imputation, scaling and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import to_number
from lendwell.functions.features import dti_band, safe_ratio
from lendwell.operators import encode
from lendwell.operators.features import engineer, feature_columns
from lendwell.operators.splits import stratified_folds
from lendwell.plans.register_queries import normalized
from lendwell.plans.sql import FEATURE_LIST, with_ctes

CATEGORICAL = fv.FEATURE_CATEGORICAL


def features(spark, d):
    """Key, 20 features and target of every eligible application."""
    rows = normalized(spark, d).select("lar_id", *fv.PREDICTORS, fv.TARGET)
    return engineer(rows, ("lar_id", fv.TARGET))


def engineer_features(spark, d):
    return features(spark, d).drop(fv.TARGET)


def dti_bands(spark, d):
    text = F.col("debt_to_income_ratio")
    rows = normalized(spark, d).select("lar_id", text, to_number(text).alias("number"))
    return rows.select("lar_id", text, dti_band(text, F.col("number")).alias("dti_category"))


def safe_ratios(spark, d):
    rows = normalized(spark, d)
    return rows.select(
        "lar_id",
        safe_ratio(F.col("loan_amount"), F.col("income")).alias("by_income"),
        safe_ratio(F.col("loan_amount"), F.col("property_value")).alias("by_property"),
    )


def features_without_workflow(spark, d):
    numeric, text = feature_columns("without_workflow_features")
    return features(spark, d).select("lar_id", *numeric, *text)


def impute_median(spark, d):
    rows = features(spark, d)
    fill = {r[0]: r[1] for r in encode.medians(rows, fv.FEATURE_NUMERIC).collect()}
    return rows.select(
        "lar_id", *(F.coalesce(F.col(c), F.lit(fill[c])).alias(c) for c in fv.FEATURE_NUMERIC)
    )


def impute_mode(spark, d):
    rows = features(spark, d)
    fill = {r[0]: r[1] for r in encode.modes(rows, CATEGORICAL).collect()}
    return rows.select(
        "lar_id", *(F.coalesce(F.col(c), F.lit(fill[c])).alias(c) for c in CATEGORICAL)
    )


def category_vocabulary(spark, d):
    return encode.vocabulary(features(spark, d), CATEGORICAL)


SCALED = ("loan_amount", "property_value", "loan_term_years")


def standardize(spark, d):
    """Parameters from fold 1..4, applied to all rows."""
    rows = stratified_folds(features(spark, d), "lar_id")
    train = rows.where(F.col("fold") != 0)
    scaled = encode.standardize(train, rows, SCALED)
    return scaled.select("lar_id", *(F.round(c, 6).alias(c) for c in SCALED))


def one_hot_long(spark, d):
    return encode.one_hot_long(features(spark, d), "lar_id", CATEGORICAL)


DUMMIES = ("loan_purpose", "loan_type", "occupancy_type")


def dummies_drop_first(spark, d):
    return encode.dummies_drop_first(features(spark, d), "lar_id", DUMMIES)


QUERIES = {
    f.__name__: f
    for f in (
        engineer_features, safe_ratios, features_without_workflow, impute_median, impute_mode,
        category_vocabulary, standardize, one_hot_long, dummies_drop_first,
    )
}
QUERIES["dti_band"] = dti_bands

_NUMERIC, _TEXT = feature_columns("without_workflow_features")
_WORDS = {
    "loan_purpose": ("2", "31", "32", "4"),
    "loan_type": ("2", "3", "4"),
    "occupancy_type": ("2", "3"),
}

SQL = {
    "engineer_features": with_ctes("feat", f"SELECT lar_id, {FEATURE_LIST} FROM feat"),
    "dti_band": with_ctes(
        "norm feat",
        "SELECT n.lar_id, n.debt_to_income_ratio, f.dti_category FROM norm n JOIN feat f USING (lar_id)",
    ),
    "safe_ratios": with_ctes("norm", """
SELECT lar_id, CASE WHEN income > 0 THEN loan_amount / income END AS by_income,
  CASE WHEN property_value > 0 THEN loan_amount / property_value END AS by_property FROM norm"""),
    "features_without_workflow": with_ctes(
        "feat", f"SELECT lar_id, {', '.join((*_NUMERIC, *_TEXT))} FROM feat"),
    "impute_median": with_ctes("feat", "SELECT lar_id, " + ", ".join(
        f"coalesce({c}, (SELECT median({c}) FROM feat)) AS {c}" for c in fv.FEATURE_NUMERIC
    ) + " FROM feat"),
    "impute_mode": with_ctes("feat", "SELECT lar_id, " + ", ".join(
        f"coalesce({c}, (SELECT {c} FROM feat WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in CATEGORICAL
    ) + " FROM feat"),
    "category_vocabulary": with_ctes("long", """
SELECT model_feature AS column_name, category,
  CAST(row_number() OVER (PARTITION BY model_feature ORDER BY category) - 1 AS INTEGER) AS position
FROM (SELECT DISTINCT model_feature, category FROM long WHERE category IS NOT NULL)"""),
    "standardize": with_ctes("folded", "SELECT lar_id, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM folded WHERE fold <> 0)) / "
        f"(SELECT stddev_pop({c}) FROM folded WHERE fold <> 0), 6) AS {c}" for c in SCALED
    ) + " FROM folded"),
    "one_hot_long": with_ctes("long", """
SELECT lar_id, model_feature, model_feature || '_' || category AS encoded_name
FROM long WHERE category IS NOT NULL"""),
    "dummies_drop_first": with_ctes("feat", "SELECT lar_id, " + ", ".join(
        f"CAST({c} = '{w}' AS INTEGER) AS {c}_{w}" for c in DUMMIES for w in _WORDS[c]
    ) + " FROM feat"),
}
