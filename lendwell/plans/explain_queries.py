"""Contribution and factor queries over an additive scorecard.

The scorecard gives each category the approval rate of its rows minus the
overall rate; the contribution of an encoded column is weight * (value - share).
These are the exact Shapley values of an additive model, so every table built
from them can be checked by SQL. `model_queries` explains boosted trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.operators import evidence, shap
from lendwell.operators.encode import one_hot_long
from lendwell.plans.feature_queries import features
from lendwell.plans.sql import with_ctes
from lendwell.session import written


def scorecard(rows: DataFrame) -> list[tuple[str, str, float, float]]:
    """(feature, category, share, weight) per encoded column, from one aggregate.

    One row per category of a code column comes back, a bounded list.
    """
    cells = [
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(c).alias("category"))
        for i, c in enumerate(fv.FEATURE_CATEGORICAL)
    ]
    counts = (
        rows.select(fv.TARGET, F.inline(F.array(*cells)))
        .groupBy("place", "feature", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(fv.TARGET).cast("bigint")).alias("pos"))
        .orderBy("place", "category")
        .collect()
    )
    first = [r for r in counts if r["place"] == 0]
    total, pos = sum(r["n"] for r in first), sum(r["pos"] for r in first)
    return [
        (r["feature"], r["category"], r["n"] / total, r["pos"] / r["n"] - pos / total)
        for r in counts
        if r["category"] is not None
    ]


def sql_text(value: str) -> str:
    """A SQL literal of any text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contributions(spark, d, rows: DataFrame | None = None) -> tuple[DataFrame, list[shap.Slot]]:
    """Applications (`rows`, where their features are written already) with
    `encoded_values` and `shap` arrays over the encoded columns."""
    rows = features(spark, d) if rows is None else rows
    card = scorecard(rows)
    slots = shap.make_slots([(f"{f}_{c}", f, c) for f, c, _, _ in card])
    on = [f"if(`{f}` <=> {sql_text(c)}, 1.0D, 0.0D)" for f, c, _, _ in card]
    rows = rows.select("*", F.expr(f"array({', '.join(on)})").alias("encoded_values"))
    values = ", ".join(f"{w!r}D * (encoded_values[{i}] - {p!r}D)" for i, (_, _, p, w) in enumerate(card))
    return rows.withColumn("shap", F.expr(f"array({values})")), slots


def shap_global_encoded(spark, d):
    rows, slots = contributions(spark, d)
    table = shap.encoded_importance(rows, slots)
    return table.withColumn("mean_abs_shap", F.round("mean_abs_shap", 9))


def shap_global_grouped(spark, d):
    rows, slots = contributions(spark, d)
    table = shap.grouped_importance(rows, slots)
    return table.withColumn("mean_abs_shap", F.round("mean_abs_shap", 9))


def explained(spark, d) -> DataFrame:
    """Applications with their five strongest factors of each sign."""
    # The scorecard and the contributions both read these rows, which are computed once.
    rows, slots = contributions(spark, d, written(features(spark, d), "features"))
    values = {s.model_feature: F.col(s.model_feature) for s in slots}
    return shap.with_top_factors(rows, slots, 5, values).select(
        "lar_id", "top_positive_factors", "top_negative_factors"
    )


def local_top_factors(spark, d):
    def numbered(side, c):
        label = F.lit(side).alias("side")
        return F.transform(c, lambda f, i: F.struct(label, (i + 1).alias("place"), f.alias("f")))

    sides = [
        numbered("positive", "top_positive_factors"), numbered("negative", "top_negative_factors")
    ]
    both = explained(spark, d).select("lar_id", F.inline_outer(F.concat(*sides)))
    both = both.where(F.col("side").isNotNull())
    return both.select(
        "lar_id", "side", "place", "f.feature", "f.model_feature",
        "f.category", "f.category_label", "f.category_active", "f.shap_value",
    )


def all_factors() -> Column:
    return F.concat("top_positive_factors", "top_negative_factors")


def evidence_queries(spark, d):
    rows = explained(spark, d).select("lar_id", evidence.policy_queries(all_factors()).alias("q"))
    rows = rows.select("lar_id", F.posexplode_outer("q").alias("pos", "q"))
    return rows.where(F.col("pos").isNotNull()).select(
        "lar_id", (F.col("pos") + 1).alias("query_no"), "q.origin_feature", "q.query"
    )


def factor_labels(spark, d):
    """Encoded columns of each application with their display name."""
    rows = features(spark, d)
    slots = shap.make_slots([(f"{f}_{c}", f, c) for f, c, _, _ in scorecard(rows)])
    long = one_hot_long(rows, "lar_id", fv.FEATURE_CATEGORICAL)
    named = long.withColumn("_name", F.element_at(shap.slot_names(spark, slots), F.col("encoded_name")))
    return named.where(F.col("_name").isNotNull()).select("*", "_name.*").drop("_name")


QUERIES = {
    f.__name__: f
    for f in (
        shap_global_encoded, shap_global_grouped, local_top_factors, evidence_queries,
        factor_labels,
    )
}

_BUSINESS = ", ".join(
    f"('{c}', '{fv.BUSINESS_NAME[c]}', '{'|'.join(fv.FEATURE_SOURCES.get(c, (c,)))}', {c in fv.CODE_LABEL})"
    for c in fv.FEATURE_CATEGORICAL
)
_LABELS = ", ".join(
    f"('{f}', '{k}', '{v}')" for f, codes in fv.CODE_LABEL.items() for k, v in codes.items()
)
NAMED = f"""
, business(model_feature, business_feature, source_features, coded) AS (VALUES {_BUSINESS}),
labels(model_feature, category, label) AS (VALUES {_LABELS}),
named AS (SELECT v.*, b.business_feature, b.source_features,
    CASE WHEN b.coded THEN coalesce(l.label, 'unknown') END AS category_label,
    b.business_feature || ' = ' || CASE WHEN b.coded AND l.label IS NULL THEN 'unknown (code ' || v.category || ')'
      ELSE coalesce(l.label, v.category) END AS display_feature,
    v.model_feature || '_' || v.category AS encoded_name
  FROM vocab v JOIN business b USING (model_feature) LEFT JOIN labels l USING (model_feature, category))"""

SQL = {
    "shap_global_encoded": with_ctes("contrib", NAMED + """
, m AS (SELECT slot, avg(abs(shap_value)) AS v FROM contrib GROUP BY slot)
SELECT n.encoded_name, n.display_feature, n.model_feature, n.business_feature, n.source_features, n.category,
  n.category_label, round(m.v, 9) AS mean_abs_shap,
  row_number() OVER (ORDER BY m.v DESC, n.encoded_name) AS rank
FROM m JOIN named n USING (slot)"""),
    "shap_global_grouped": with_ctes("contrib", NAMED + """
, g AS (SELECT lar_id, model_feature, sum(shap_value) AS v FROM contrib GROUP BY ALL),
m AS (SELECT model_feature, avg(abs(v)) AS v FROM g GROUP BY ALL)
SELECT m.model_feature, b.business_feature, b.source_features,
  CAST((SELECT count(*) FROM vocab WHERE vocab.model_feature = m.model_feature) AS INTEGER) AS encoded_columns,
  round(m.v, 9) AS mean_abs_shap, row_number() OVER (ORDER BY m.v DESC, m.model_feature) AS rank
FROM m JOIN business b USING (model_feature)"""),
    "local_top_factors": with_ctes("factors feat", NAMED + """
SELECT f.lar_id, f.side, f.place,
  n.display_feature || CASE WHEN c.encoded_value = 1 THEN ' (present)' ELSE ' (absent)' END AS feature,
  f.model_feature, f.category, n.category_label, c.encoded_value = 1 AS category_active, f.shap_value
FROM factors f JOIN named n USING (slot) JOIN contrib c USING (lar_id, slot)"""),
    "evidence_queries": with_ctes("wanted", "SELECT lar_id, query_no, origin_feature, query FROM wanted"),
    "factor_labels": with_ctes("long vocab", NAMED + """
SELECT l.lar_id, l.model_feature, n.encoded_name, n.display_feature, n.business_feature, n.source_features
FROM long l JOIN named n USING (model_feature, category)"""),
}
