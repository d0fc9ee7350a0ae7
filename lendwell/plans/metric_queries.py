"""Metrics, curves, summaries and selection over scored applications.

The scores are six transparent scorecards computed from the features, so that
every metric can be checked by SQL; the same operators serve fitted models in
`model_queries`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.operators import importance, metrics
from lendwell.operators.splits import stratified_folds
from lendwell.operators.training import RUN_KEYS
from lendwell.plans.feature_queries import features
from lendwell.plans.sql import with_ctes
from lendwell.sources.tables import table

FULL, REDUCED = "full", "without_workflow_features"
SCORECARDS = (
    ("amount_full", "amount", FULL, "baseline", "1.0D / (1.0D + floor(loan_amount / 10000.0D))", "0.03D"),
    ("amount_reduced", "amount", REDUCED, "robustness",
     "1.0D / (1.0D + floor(loan_amount / 100000.0D))", "0.2D"),
    ("income_full", "income", FULL, "baseline",
     "greatest(coalesce(income, 0.0D), 0.0D) / (greatest(coalesce(income, 0.0D), 0.0D) + 50.0D)", "0.1D"),
    ("income_reduced", "income", REDUCED, "robustness", "double(loan_type) / 5.0D", "0.3D"),
    ("ratio_full", "ratio", FULL, "baseline",
     "1.0D / (1.0D + coalesce(loan_to_property_value, 0.0D))", "0.1D"),
    ("ratio_reduced", "ratio", REDUCED, "robustness",
     "1.0D / (1.0D + coalesce(loan_term_years, 0.0D))", "0.035D"),
)


def folded(spark, d):
    return stratified_folds(features(spark, d), "lar_id")


def scored(spark, d):
    """One row per application and scorecard: label, score and decision."""
    cards = ", ".join(
        f"struct('{name}' AS run_name, '{family}' AS model_family, '{config}' AS feature_config, "
        f"'{stage}' AS stage, {score} AS score, {cut} AS cut)"
        for name, family, config, stage, score, cut in SCORECARDS
    )
    rows = folded(spark, d).selectExpr(
        "lar_id", "fold", f"int({fv.TARGET}) AS label", f"inline(array({cards}))"
    )
    return rows.withColumn("pred", (F.col("score") >= F.col("cut")).cast("int")).drop("cut")


def one_card(spark, d):
    return scored(spark, d).where(F.col("run_name") == "ratio_full")


def confusion_matrix(spark, d):
    return metrics.confusion_matrix(one_card(spark, d), "label", "pred")


def classification_metrics(spark, d):
    rows = metrics.classification_metrics(scored(spark, d), ["run_name", "fold"], "label", "pred")
    return rows.select(
        "run_name", "fold", "tn", "fp", "fn", "tp",
        *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1", "accuracy")),
    )


def _ranking(spark, d):
    curve = metrics.ranking_curve(scored(spark, d), ["run_name", "fold"], "label", "score")
    return metrics.ranking_metrics(curve, ["run_name", "fold"])


def roc_auc(spark, d):
    return _ranking(spark, d).select("run_name", "fold", F.round("roc_auc", 8).alias("roc_auc"))


def average_precision(spark, d):
    return _ranking(spark, d).select(
        "run_name", "fold", F.round("average_precision", 8).alias("average_precision")
    )


def _event_curve(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "value AS score", "int(event_type = 'purchase') AS label"
    )
    return metrics.ranking_curve(rows, [], "label", "score")


def roc_points(spark, d):
    return metrics.roc_points(_event_curve(spark, d))


def pr_points(spark, d):
    return metrics.pr_points(_event_curve(spark, d))


def runs(spark, d):
    """Cross-validation summary of the scorecards."""
    folds = metrics.scored_metrics(scored(spark, d), [*RUN_KEYS, "fold"], "label", "pred", "score")
    return metrics.cv_summary(folds, RUN_KEYS)


def _rounded(df, digits=8):
    return df.select(
        *(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)
    )


def cv_summary(spark, d):
    return _rounded(runs(spark, d), 7)


def champion_select(spark, d):
    return _rounded(metrics.select_champion(runs(spark, d)), 7)


def robustness_delta(spark, d):
    return _rounded(metrics.robustness_delta(runs(spark, d)), 7)


def column_importance(spark, d):
    """|sum of label signs| per encoded column and fold: a plain importance to aggregate."""
    rows = folded(spark, d)
    cells = [
        F.struct(
            F.concat(F.lit(f"{c}_"), F.col(c)).alias("encoded_name"), F.lit(1).alias("x")
        )
        for c in fv.FEATURE_CATEGORICAL
    ] + [
        F.struct(F.lit(c).alias("encoded_name"), (F.col(c) > 0).cast("int").alias("x"))
        for c in fv.FEATURE_NUMERIC
    ]
    long = rows.select("fold", fv.TARGET, F.inline(F.array(*cells)))
    return (
        long.where(F.col("encoded_name").isNotNull() & (F.col("x") == 1))
        .groupBy("fold", "encoded_name")
        .agg(F.abs(F.sum(2 * F.col(fv.TARGET) - 1)).cast("double").alias("importance"))
    )


NAMES = (*fv.FEATURE_NUMERIC, *fv.FEATURE_CATEGORICAL)


def base_feature_name(spark, d):
    return column_importance(spark, d).select(
        "fold", "encoded_name", "importance",
        importance.base_feature(F.col("encoded_name"), NAMES).alias("feature"),
    )


def importance_by_feature(spark, d):
    rows = importance.importance_by_feature(column_importance(spark, d), NAMES)
    return rows.select(
        "feature", "rank", F.round("importance_mean", 8).alias("importance_mean"),
        F.round("importance_std", 6).alias("importance_std"),
    )


def top_features(spark, d):
    rows = importance.importance_by_feature(column_importance(spark, d), NAMES)
    return rows.orderBy("rank").limit(10).select(
        "rank", "feature", F.round("importance_mean", 8).alias("importance_mean")
    )


def feature_signal(spark, d):
    rows = column_importance(spark, d).withColumn(
        "model_family", F.when(F.col("fold") < 2, "early").otherwise("late")
    )
    shares = importance.importance_by_feature(rows, NAMES, ["model_family"])
    return _rounded(importance.tracked_importance(shares))


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, classification_metrics, roc_auc, average_precision, roc_points,
        pr_points, cv_summary, champion_select, robustness_delta, base_feature_name,
        importance_by_feature, top_features, feature_signal,
    )
}

_SUMMARY = ", ".join(
    f"round(cv_{m}_{s}, 7) AS cv_{m}_{s}"
    for m in metrics.METRICS for s in ("mean", "std")
)
_EVENTS = """
WITH c AS (SELECT value AS score, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  count(*) AS n FROM events GROUP BY value),
k AS (SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tps, CAST(sum(n) OVER w AS BIGINT) AS seen,
  CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(n) OVER () AS BIGINT) AS total
  FROM c WINDOW w AS (ORDER BY score DESC))"""
_NAMES = "[" + ", ".join(f"'{c}'" for c in NAMES) + "]"
_COLS = "".join(
    f" UNION ALL SELECT fold, LoanApproved, '{c}' FROM folded WHERE {c} > 0" for c in fv.FEATURE_NUMERIC
)
_WEIGHTS = f"""
, cols AS (SELECT f.fold, f.LoanApproved, l.model_feature || '_' || l.category AS encoded_name
  FROM folded f JOIN long l USING (lar_id) WHERE l.category IS NOT NULL{_COLS}),
weights AS (SELECT fold, encoded_name, CAST(abs(sum(2 * CAST(LoanApproved AS INTEGER) - 1)) AS DOUBLE) AS importance
  FROM cols GROUP BY ALL),
named AS (SELECT w.*, coalesce(
    (SELECT max(n) FROM (SELECT unnest({_NAMES}) AS n) WHERE n = w.encoded_name),
    (SELECT arg_max(n, length(n)) FROM (SELECT unnest({_NAMES}) AS n) WHERE starts_with(w.encoded_name, n || '_')),
    w.encoded_name) AS feature FROM weights w)"""


def _importance(group: str) -> str:
    """Dense (fold, feature) shares and their mean and deviation, per `group` if given."""
    lead = f"{group}, " if group else ""
    same = f"f.{group} = g.{group}" if group else "true"
    match = f"s.{group} = g.{group} AND " if group else ""
    out = f"g.{group}, " if group else ""
    weights = _WEIGHTS
    if group:
        split = f"SELECT w.*, CASE WHEN w.fold < 2 THEN 'early' ELSE 'late' END AS {group},"
        weights = weights.replace("SELECT w.*,", split)
    return f"""{weights},
shares AS (SELECT {lead}fold, feature,
    sum(importance) / sum(sum(importance)) OVER (PARTITION BY {lead}fold) AS v
  FROM named GROUP BY {lead}fold, feature),
imp AS (SELECT {out}f.feature, avg(coalesce(s.v, 0)) AS importance_mean,
    stddev_pop(coalesce(s.v, 0)) AS importance_std
  FROM (SELECT DISTINCT {lead}fold FROM named) g
  JOIN (SELECT DISTINCT {lead}feature FROM named) f ON {same}
  LEFT JOIN shares s ON {match}s.fold = g.fold AND s.feature = f.feature
  GROUP BY {out}f.feature)"""


SQL = {
    "confusion_matrix": with_ctes("scored", """
SELECT a.v AS actual, p.v AS predicted, count(s.lar_id) AS n
FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) p(v)
LEFT JOIN (SELECT * FROM scored WHERE run_name = 'ratio_full') s ON s.label = a.v AND s.pred = p.v
GROUP BY ALL"""),
    "classification_metrics": with_ctes("foldm", """
SELECT run_name, fold, tn, fp, fn, tp, round(precision, 8) AS precision, round(recall, 8) AS recall,
  round(f1, 8) AS f1, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 8) AS accuracy FROM foldm"""),
    "roc_auc": with_ctes("ranked", "SELECT run_name, fold, round(roc_auc, 8) AS roc_auc FROM ranked"),
    "average_precision": with_ctes(
        "ranked", "SELECT run_name, fold, round(average_precision, 8) AS average_precision FROM ranked"),
    "roc_points": _EVENTS + """
SELECT score, (seen - tps) / CAST(total - p AS DOUBLE) AS fpr, tps / CAST(p AS DOUBLE) AS tpr FROM k
UNION ALL SELECT NULL, 0.0, 0.0""",
    "pr_points": _EVENTS + """
SELECT score, tps / CAST(p AS DOUBLE) AS recall, tps / CAST(seen AS DOUBLE) AS precision FROM k
UNION ALL SELECT NULL, 0.0, 1.0""",
    "cv_summary": with_ctes(
        "runs", f"SELECT run_name, model_family, feature_config, stage, {_SUMMARY} FROM runs"),
    "champion_select": with_ctes(
        "runs", f"SELECT run_name, model_family, feature_config, stage, {_SUMMARY} FROM runs "
        "ORDER BY runs.cv_f1_mean DESC, runs.cv_average_precision_mean DESC, runs.cv_roc_auc_mean DESC, run_name LIMIT 1"),
    "robustness_delta": with_ctes("runs", """
SELECT f.model_family, f.run_name AS full_run, r.run_name AS robust_run,
  round(r.cv_f1_mean - f.cv_f1_mean, 7) AS delta_cv_f1_mean,
  round(r.cv_average_precision_mean - f.cv_average_precision_mean, 7) AS delta_cv_average_precision_mean,
  round(r.cv_roc_auc_mean - f.cv_roc_auc_mean, 7) AS delta_cv_roc_auc_mean
FROM runs f JOIN runs r USING (model_family) WHERE f.stage = 'baseline' AND r.stage = 'robustness'"""),
    "base_feature_name": with_ctes(
        "folded long", _WEIGHTS + "\nSELECT fold, encoded_name, importance, feature FROM named"),
    "importance_by_feature": with_ctes("folded long", _importance("") + """
SELECT feature, row_number() OVER (ORDER BY importance_mean DESC, feature) AS rank,
  round(importance_mean, 8) AS importance_mean, round(importance_std, 6) AS importance_std FROM imp"""),
    "top_features": with_ctes("folded long", _importance("") + """
SELECT row_number() OVER (ORDER BY importance_mean DESC, feature) AS rank, feature,
  round(importance_mean, 8) AS importance_mean FROM imp QUALIFY rank <= 10"""),
    "feature_signal": with_ctes("folded long", _importance("model_family") + """
SELECT model_family, """ + ", ".join(
        f"round(coalesce(sum(importance_mean) FILTER (feature = '{t}'), 0.0), 8) AS {t}"
        for t in fv.TRACKED_FEATURES) + "\nFROM imp GROUP BY model_family"),
}
