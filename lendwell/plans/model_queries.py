"""Fitted models: run grid, cross-validation, holdout, scoring, explanation, evidence run.

Trained are the small models of `training.session_specs`, under names that tell
their sizes; `run_specs` lists the published runs. Every query trains on, and
answers for, all eligible applications of the given tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.operators import contracts, evidence, shap, training, workflow
from lendwell.operators.encode import ClassNames
from lendwell.operators.ledger import Ledger
from lendwell.operators.splits import stratified_folds, stratified_holdout
from lendwell.plans.evidence_queries import ALLOWED_HOSTS, applications, policy_results
from lendwell.plans.register_queries import normalized
from lendwell.plans.sql import HASH, with_ctes
from lendwell.session import compiled, keep_compiled, scratch_path, shared_folder, written
from lendwell.sources import reports

SPECS = training.session_specs()
#: Raised when the training code, or the curated table, changes.
MODEL_VERSION, DATASET_VERSION = "3", "curated-v2"
#: What a saved scoring pipeline must hold, whatever was saved.
STAGES = (
    "FeatureEngineer", "ValueImputerModel", "StringIndexerModel", "OneHotEncoderModel",
    "VectorAssembler", "ClassNames", "GBTClassificationModel",
)
CHAMPION = next(s for s in SPECS if s.run_name == "boosted_8x3_full")


@cache
def population(spark, d) -> DataFrame:
    """All eligible applications, written once per session and scale."""
    with compiled(spark):
        return written(normalized(spark, d), "population")


@cache
def split(spark, d) -> tuple[DataFrame, DataFrame]:
    """Training rows with folds, and holdout rows; written once per session and scale."""
    shared_folder(spark)
    rows = training.with_label(
        stratified_holdout(population(spark, d), "lar_id").drop(*fv.AUDIT_ONLY)
    )
    train = stratified_folds(rows.where(~F.col("is_holdout")), "lar_id", k=fv.CV_FOLDS)
    train = train.drop(fv.TARGET).checkpoint()
    return train, rows.where(F.col("is_holdout")).drop(fv.TARGET).checkpoint()


@cache
def champion(spark, d):
    """The champion configuration fitted on all training rows, saved and loaded back."""
    model = training.fit(CHAMPION, split(spark, d)[0])
    path = scratch_path(spark, "champion")
    reports.save_pipeline(model, path)
    return reports.load_pipeline(path, STAGES)


@cache
def _benchmark(spark, d):
    train, holdout = split(spark, d)
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    return training.benchmark(SPECS, train, holdout, fv.CV_FOLDS, ledger, DATASET_VERSION)


def inputs(spark, d) -> DataFrame:
    return contracts.select_predictors(population(spark, d), ("lar_id",))


def run_table(spark, d):
    """The run grid with the rows each run is trained on."""
    counts = split(spark, d)[0].groupBy("fold").agg(F.count(F.lit(1)).alias("validation_rows"))
    listed = F.transform(
        F.array_sort(F.map_entries("params")),
        lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"].cast("string"), F.lit("none"))),
    )
    specs = training.run_spec_frame(spark, training.run_specs())
    specs = specs.withColumn("params", F.array_join(listed, ";"))
    one = F.lit(1).alias("_one")
    return specs.select("*", one).join(counts.select("*", one), "_one").drop("_one")


def train_families(spark, d):
    """One small model per family, balanced forest and logistic regression included."""
    train, holdout = split(spark, d)
    encoder, encoded = training.fit_encoder(train)
    keep = ("label", "encoded")
    encoded = encoded.select(*keep).checkpoint()
    held_out = encoder.transform(holdout).select(*keep).checkpoint()
    classes, table = ClassNames(classes=training.label_classes(train)), None
    for spec in training.family_specs():
        weight = "weight" if spec.params.get("balanced") else None
        estimator = training.make_estimator(spec.model_family, spec.params, weight)
        fitted = training.detached(estimator.fit(training.balanced_weights(encoded) if weight else encoded))
        part = training.holdout_metrics(PipelineModel([classes, fitted]), held_out, spec)
        table = part if table is None else table.unionByName(part)
    return table


def encoded_applications(train: DataFrame, holdout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All applications (lar_id, encoded), and the training rows among them (label, encoded).

    Both parts of the split hold every application between them, so features and
    vectors are computed once; the encoder is fitted on the training rows only.
    """
    features = training.engineered(train.unionByName(holdout, allowMissingColumns=True))
    encoder, _ = training.fit_encoder(features.where(~F.col("is_holdout")))
    encode = PipelineModel(encoder.stages[1:])
    with compiled(train.sparkSession):
        rows = encode.transform(features).select("lar_id", "is_holdout", "label", "encoded").checkpoint()
    return rows.select("lar_id", "encoded"), rows.where(~F.col("is_holdout")).select("label", "encoded")


def shap_additivity(spark, d):
    """A model of each kind, explained over all applications: do the contributions add up?"""
    train, holdout = split(spark, d)
    rows, encoded = encoded_applications(train, holdout)
    classes, table = ClassNames(classes=training.label_classes(train)), None
    for family, params in (("random_forest", {"trees": 5, "depth": 4}), ("boosted_trees", {"trees": 4, "depth": 3}), ("logistic", {})):
        fitted = training.detached(training.make_estimator(family, params).fit(encoded))
        scored = training.score(PipelineModel([classes, fitted]), rows).select("lar_id", "encoded", "probability")
        part = shap.additivity(shap.explain_rows(scored, fitted, encoded), fitted)
        part = part.select(F.lit(family).alias("model_family"), F.lit(shap.shap_scale(fitted)).alias("scale"), "rows", "additive")
        table = part if table is None else table.unionByName(part)
    return table


def run_ledger(spark, d):
    """What the grid's ledger holds: every run and fold, trained once."""
    return _benchmark(spark, d)["ledger"].select("run_name", "model_family", "feature_config", "stage", "fold", "status")


def grid_champion(spark, d):
    """The grid's champion by its ledger, with what it must beat."""
    best = _benchmark(spark, d)["champion"]
    return best.select("run_name", "model_family", "cv_f1_mean", "cv_average_precision_mean", "cv_roc_auc_mean")


def cv_metrics(spark, d):
    folds = training.encode_folds(split(spark, d)[0], fv.CV_FOLDS)
    return training.cross_validate(CHAMPION, folds)[0]


def benchmark_summary(spark, d):
    """All runs with their summary, through the JSON report sink."""
    path = scratch_path(spark, "summary")
    reports.write_json_report(_benchmark(spark, d)["summary"], path)
    return spark.read.schema(_benchmark(spark, d)["summary"].schema).json(path)


def holdout_metrics(spark, d):
    return _benchmark(spark, d)["holdout"]


def model_importance(spark, d):
    return _benchmark(spark, d)["importance"]


def batch_score(spark, d):
    scored = training.score(champion(spark, d), inputs(spark, d))
    return scored.select(
        "lar_id", "prediction", "prediction_label", "probability",
        F.lit(CHAMPION.run_name).alias("model_name"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(DATASET_VERSION).alias("dataset_version"),
        F.lit(CHAMPION.feature_config).alias("selected_configuration"),
        F.lit(fv.PREDICTION_NOTE).alias("warning"),
    )


def prediction_contract(spark, d):
    return contracts.prediction_contract(batch_score(spark, d))


def shap_long(spark, d):
    """Contributions of every application and encoded column that moved it."""
    rows, slots = workflow.explain(champion(spark, d), inputs(spark, d))
    long = rows.select(
        "lar_id", "probability", "base_value", F.posexplode_outer("shap").alias("slot", "shap_value")
    )
    # One name for each encoded column, known from the model: constants, no join.
    names = F.array(*(F.struct(F.lit(s.encoded_name).alias("e"), F.lit(s.model_feature).alias("m")) for s in slots))
    name = F.get(names, F.col("slot"))
    return long.where(F.col("shap_value") != 0).select(
        "lar_id", "probability", "base_value", "shap_value",
        name["e"].alias("encoded_name"), name["m"].alias("model_feature"),
    )


def model_shap_global(spark, d):
    """Grouped importance over all training rows, as CSV and JSON."""
    train = split(spark, d)[0].select("lar_id", *fv.PREDICTORS)
    rows, slots = workflow.explain(champion(spark, d), train)
    path = scratch_path(spark, "importance")
    reports.write_table_report(shap.grouped_importance(rows, slots), path)
    return spark.read.json(f"{path}/json")


def local_evidence(spark, d):
    rows = workflow.local_evidence(champion(spark, d), inputs(spark, d))
    return rows.withColumns(
        {c: F.to_json(c) for c in ("top_positive_factors", "top_negative_factors")}
    ).drop("shap")


def prediction_xai_agree(spark, d):
    """Stored scores against what base value and contributions add up to."""
    stored = written(batch_score(spark, d), "scores")
    rows, _ = workflow.explain(champion(spark, d), inputs(spark, d))
    total = F.col("base_value") + F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("probability", 1.0 / (1.0 + F.exp(-total)))
    rows = rows.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    return evidence.prediction_agreement(stored, rows, "lar_id")


def _evidence(spark, d):
    # Validation, features and scores are run by whoever reads the result, in one long stage.
    keep_compiled(spark)
    requests = applications(spark, d, population(spark, d))
    return workflow.evidence_run(
        champion(spark, d), requests, policy_results(spark, d), hosts=ALLOWED_HOSTS
    )


def evidence_batch(spark, d):
    """What every stage of the run found, with the prompt or the abstention it ends in."""
    rows = _evidence(spark, d)
    return rows.select(
        "lar_id", "prediction_label", "probability", "insufficient_evidence", "generation_status",
        F.concat_ws(" | ", "errors").alias("errors"),
        F.concat_ws("; ", "reasons").alias("reasons"),
        F.to_json("sources").alias("sources"),
        "final_response",
        F.to_json("policy_evidence").alias("policy_evidence"),
        "prompt",
        F.concat_ws(" | ", "response_warnings").alias("warnings"),
    )


def prompt_table(spark, d):
    return _evidence(spark, d).select("lar_id", "generation_status", "prompt")


def workflow_counters(spark, d):
    return evidence.workflow_counters(_evidence(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        train_families, shap_additivity, run_ledger, grid_champion, cv_metrics, benchmark_summary, holdout_metrics, model_importance,
        batch_score, prediction_contract, shap_long, model_shap_global, local_evidence,
        prediction_xai_agree, evidence_batch, prompt_table, workflow_counters,
    )
}
QUERIES["run_specs"] = run_table

def _listed(params: dict) -> str:
    return ";".join(f"{k}={'none' if v is None else float(v)}" for k, v in sorted(params.items()))


_RUNS = ", ".join(
    f"('{s.run_name}', '{s.model_family}', '{s.feature_config}', '{s.stage}', '{_listed(s.params)}')"
    for s in training.run_specs()
)

_TRAINED = ", ".join(
    f"('{s.run_name}', '{s.model_family}', '{s.feature_config}', '{s.stage}')" for s in SPECS
)

SQL = {
    "shap_additivity": with_ctes("norm", """
SELECT k.*, (SELECT count(*) FROM norm) AS rows, true AS additive FROM (VALUES ('random_forest', 'probability'),
  ('boosted_trees', 'log_odds'), ('logistic', 'log_odds')) k(model_family, scale)"""),
    "prediction_xai_agree": with_ctes("norm", "SELECT lar_id, true AS agrees FROM norm"),
    "run_ledger": f"""
SELECT s.*, CAST(f.fold AS INTEGER) AS fold, 'done' AS status
FROM (VALUES {_TRAINED}) s(run_name, model_family, feature_config, stage), range({fv.CV_FOLDS}) f(fold)""",
    "run_specs": with_ctes("norm", f"""
, held AS (SELECT lar_id, LoanApproved FROM (
  SELECT lar_id, LoanApproved, count(*) OVER (PARTITION BY LoanApproved) AS n,
    row_number() OVER (PARTITION BY LoanApproved ORDER BY {HASH}, lar_id) AS r FROM norm) WHERE r > round(n * {fv.HOLDOUT_SHARE})),
folds AS (SELECT CAST((row_number() OVER (PARTITION BY LoanApproved ORDER BY {HASH}, lar_id) - 1) % {fv.CV_FOLDS} AS INTEGER) AS fold FROM held),
rows AS (SELECT fold, count(*) AS validation_rows FROM folds GROUP BY fold)
SELECT * FROM (VALUES {_RUNS}) s(run_name, model_family, feature_config, stage, params), rows"""),
}
