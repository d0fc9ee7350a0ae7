"""Classes by name, the run ledger, explanations by kind of model."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.operators import dataset, encode, shap, training
from lendwell.operators import ledger as ledgers
from lendwell.operators.encode import ClassNames
from lendwell.operators.features import CONFIGURATIONS, FeatureEngineer
from lendwell.plans import model_queries, stream_queries
from lendwell.session import COMPILED_BYTES, compiled
from lendwell.sources.tables import REGISTER_RULES


def rows(spark, n=300):
    df = spark.range(n).select(
        "id", F.rand(3).alias("a"), F.rand(4).alias("b"), (F.rand(5) > 0.5).cast("double").alias("c")
    )
    df = df.withColumn("target", F.when(F.col("a") + F.col("c") > 0.9, 1).otherwise(0))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="encoded").transform(df)


@pytest.mark.parametrize("classes", [("0", "1"), ("1", "0")])
def test_the_positive_class_is_found_by_its_name(spark, tmp_path, classes):
    """Labels in either order give the same scores, before and after saving."""
    df = training.with_label(rows(spark), "target", classes).cache()
    assert training.label_classes(df) == list(classes)
    stages = [ClassNames(classes=training.label_classes(df)), LogisticRegression(featuresCol="encoded")]
    Pipeline(stages=stages).fit(df).write().overwrite().save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    assert training.positive_index(model) == classes.index("1")
    scored = training.scored_classes(model, df)
    got = scored.agg(
        F.avg((F.col("prediction") == F.col("target")).cast("int")), F.corr("probability", "target"),
        F.count_if(F.col("label") != F.col("target")),
    ).first()
    assert got[0] > 0.9 and got[1] > 0.7 and got[2] == 0


def test_other_classes_are_refused(spark):
    df = rows(spark, 20).withColumn("target", F.col("id") % 3)
    with pytest.raises(Exception, match="unknown class: 2"):
        training.with_label(df, "target").agg(F.sum("label")).collect()
    with pytest.raises(ValueError, match="names? its classes"):
        training.label_classes(rows(spark).withColumn("label", F.lit(1.0)))
    model = PipelineModel([LogisticRegression(featuresCol="encoded", labelCol="target").fit(rows(spark))])
    with pytest.raises(ValueError, match="classes"):
        training.positive_index(model)
    for names in (["0", "1", "2"], ["0", "2"], ["1", "1"]):
        with pytest.raises(ValueError):
            training.positive_index(PipelineModel([ClassNames(classes=names), *model.stages]))


def test_a_ledger_trains_only_what_is_missing(spark, tmp_path, monkeypatch):
    book, seen = ledgers.Ledger(spark, str(tmp_path / "ledger")), []
    folds = [training.EncodedFold(k, [("x", "x", None)], ["0", "1"], None, None) for k in range(3)]
    monkeypatch.setattr(training, "encode_folds", lambda train, numbers, config: [folds[k] for k in numbers])

    def result(spec, fold):
        seen.append((spec.run_name, fold.number))
        if spec.run_name == "bad" and "fixed" not in spec.params:
            raise RuntimeError("no memory")
        return {"f1": 0.5 + fold.number, "encoded_names": ["x"], "importances": [1.0]}

    monkeypatch.setattr(training, "train_fold", result)
    train = spark.range(1)
    one, two = (training.RunSpec(n, "logistic", "full", "baseline", {}) for n in ("one", "two"))
    assert book.done() == set()
    assert ledgers.train_runs([one], train, 2, book).count() == 2
    assert sorted(seen) == [("one", 0), ("one", 1)]
    again = ledgers.Ledger(spark, str(tmp_path / "ledger"))
    assert ledgers.train_runs([one, two], train, 3, again).count() == 6
    assert sorted(seen[2:]) == [("one", 2), ("two", 0), ("two", 1), ("two", 2)]
    bad = training.RunSpec("bad", "logistic", "full", "baseline", {})
    with pytest.raises(RuntimeError, match="bad, fold 0: no memory"):
        ledgers.train_runs([bad, one], train, 2, again)
    assert again.frame().where("status = 'failed'").count() == 2
    count = len(seen)
    with pytest.raises(RuntimeError):
        ledgers.train_runs([bad], train, 1, again)
    assert len(seen) == count + 1  # the failed one is tried again
    assert ledgers.train_runs([one], train, 2, again, data="other").count() == 2  # other data, other rows
    assert ledgers.importances(again.frame().where("status = 'done'")).count() == 8


def test_published_runs_have_trainable_counterparts():
    for spec in map(training.spark_spec, training.run_specs()):
        training.make_estimator(spec.model_family, spec.params)
    assert {s.stage for s in training.session_specs()} == {"baseline", "robustness", "tuning"}


@pytest.mark.parametrize("positive", [0, 1])
def test_forest_values_add_up_to_the_probability(spark, positive):
    df = rows(spark)
    model = RandomForestClassifier(featuresCol="encoded", labelCol="target", numTrees=7, maxDepth=4, seed=2).fit(df)
    scored = model.transform(df).select("id", "encoded", vector_to_array("probability")[positive].alias("probability"))
    out = shap.additivity(shap.explain_rows(scored, model, positive=positive), model).first()
    assert (out["rows"], out["additive"]) == (300, True)


def test_linear_values_are_weights_times_distances(spark):
    df = rows(spark)
    model = LogisticRegression(featuresCol="encoded", labelCol="target").fit(df)
    means = shap.vector_means(df)
    got = shap.explain_rows(model.transform(df).select("id", "encoded"), model, df).collect()
    for r in got[:20]:
        want = [w * (x - m) for w, x, m in zip(model.coefficients, r["encoded_values"], means)]
        assert r["shap"] == pytest.approx(want)
        total = r["base_value"] + sum(r["shap"])
        assert total == pytest.approx(float(model.intercept) + sum(w * x for w, x in zip(model.coefficients, r["encoded_values"])))


def test_other_kinds_are_refused(spark):
    df = rows(spark)
    model = LinearSVC(featuresCol="encoded", labelCol="target", maxIter=2).fit(df)
    with pytest.raises(TypeError, match="LinearSVCModel"):
        shap.explain_rows(df, model)
    with pytest.raises(TypeError):
        shap.read_leaves(LogisticRegression(featuresCol="encoded", labelCol="target").fit(df), spark)


@pytest.mark.parametrize("family", ["random_forest", "logistic"])
def test_models_score_in_a_session_that_observed_a_query(spark, family):
    """A training summary holds the session, which can't travel once a query was observed."""
    watched, seen = spark.newSession(), Observation()
    watched.range(5).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 5}
    df = rows(watched).withColumn("label", F.col("target").cast("double"))
    fitted = training.make_estimator(family, {"trees": 3, "depth": 2}).fit(df)
    model = training.detached(fitted)
    assert not model.hasSummary
    assert training.encoded_importances(model) == pytest.approx(training.encoded_importances(fitted))
    assert model.transform(df).agg(F.avg("prediction")).first()[0] == pytest.approx(df.agg(F.avg("label")).first()[0], abs=0.2)
    with pytest.raises(Exception, match="not serializable"):
        fitted.transform(df).agg(F.avg("prediction")).first()


def test_building_a_dataset_leaves_the_session_fit_for_scoring(spark, tmp_path):
    fixed = {"activity_year": "'2023'", "action_taken": "if(id % 2 = 0, '1', '3')", "total_units": "'1'", "lar_id": "id"}
    columns = (REGISTER_RULES | dict.fromkeys(REGISTER_RULES, "'2'") | fixed).items()
    register = spark.range(40).selectExpr(*(f"{rule} AS {name}" for name, rule in columns))
    built = dataset.build_dataset(register, str(tmp_path / "built"))
    assert built.population == {"source_rows": 40, "eligible_rows": 40, "eligible_denied": 20, "eligible_approved": 20}
    df = rows(spark)
    model = RandomForestClassifier(featuresCol="encoded", labelCol="target", numTrees=3, maxDepth=2, seed=2).fit(df)
    assert 0 < model.transform(df).agg(F.avg("prediction")).first()[0] < 1


def test_features_are_computed_once_for_all_folds(spark, monkeypatch):
    calls, transform = [], FeatureEngineer._transform
    monkeypatch.setattr(FeatureEngineer, "_transform", lambda self, df: calls.append(1) or transform(self, df))
    values = {c: F.lit("1") for c in fv.PREDICTORS} | {c: F.col("id") + 1.0 for c in fv.NUMERIC_COLUMNS}
    train = spark.range(40).withColumns({c: v for c, v in values.items() if c in fv.PREDICTORS})
    train = train.withColumns({"target": F.col("id") % 2, "fold": (F.col("id") % 4).cast("int")})
    train = training.with_label(train.withColumnRenamed("id", "lar_id"), "target").drop("target")
    folds = training.encode_folds(train, 4)
    assert len(calls) == 1
    assert [f.number for f in folds] == [0, 1, 2, 3]
    assert [(f.train.count(), f.validation.count()) for f in folds] == [(30, 10)] * 4
    assert training.label_classes(folds[0].train) == ["0", "1"]
    once = training.engineered(train)
    assert training.engineered(once) is once and len(calls) == 2


def test_pattern_tables_give_the_values_of_every_leaf():
    """Tabled leaves and deep ones agree; the kernel moves Arrow batches."""
    rng = np.random.default_rng(1)
    x = rng.random((50, 12))
    leaves = [
        shap.Leaf(v, np.array(f, dtype=np.int64), np.full(len(f), 0.3), np.full(len(f), 0.8), np.full(len(f), 0.4))
        for v, f in ((1.0, [0, 3]), (-2.0, [1, 3, 5, 7]), (0.5, list(range(12))), (3.0, []))
    ]
    tables = [shap.pattern_values(leaf) for leaf in leaves]
    assert [t is None for t in tables] == [False, False, True, True]
    assert tables[1].shape == (16, 4)
    got = shap.shap_matrix(x, leaves, tables)
    assert np.allclose(got, shap.shap_matrix(x, leaves, [None] * len(leaves)))
    inside = (x > 0.3) & (x <= 0.8)
    total = sum(
        leaf.value * (inside[:, leaf.features].all(axis=1) - 0.4 ** len(leaf.features)) for leaf in leaves
    )
    assert np.allclose(got.sum(axis=1), total)


def test_explained_rows_pass_as_arrow(spark):
    df = training.with_label(rows(spark), "target").select("id", "label", "encoded")
    model = RandomForestClassifier(featuresCol="encoded", numTrees=2, maxDepth=2, seed=1).fit(df)
    plan = shap.tree_shap(df, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_a_landed_register_is_read_in_few_triggers():
    assert [stream_queries.files_per_trigger(n) for n in (1, 4, 16, 17, 800)] == [2, 2, 2, 3, 100]


def test_additivity_computes_the_features_of_every_application_once(spark, monkeypatch):
    calls, transform = [], FeatureEngineer._transform
    limit, limits = "spark.sql.codegen.hugeMethodLimit", []

    def engineer(self, df):
        calls.append(1)
        limits.append(int(spark.conf.get(limit)))
        return transform(self, df)

    monkeypatch.setattr(FeatureEngineer, "_transform", engineer)
    values = {c: F.lit("1") for c in fv.PREDICTORS} | {c: F.col("id") + 1.0 for c in fv.NUMERIC_COLUMNS}
    everyone = spark.range(60).withColumns({c: v for c, v in values.items() if c in fv.PREDICTORS})
    # Keys repeat and are null.
    everyone = everyone.withColumn("lar_id", F.when(F.col("id") > 3, F.col("id") % 40))
    marked = training.with_label(everyone.withColumn("target", F.col("id") % 2), "target").drop("target")
    marked = marked.withColumn("is_holdout", F.col("id") % 3 == 0)
    train = marked.where("NOT is_holdout").withColumn("fold", (F.col("id") % 5).cast("int")).drop("id")
    holdout = marked.where("is_holdout").drop("id")
    monkeypatch.setattr(model_queries, "split", lambda spark, d: (train, holdout))
    monkeypatch.setattr(model_queries, "population", lambda spark, d: everyone.drop("id"))
    before = spark.conf.get(limit)
    got = model_queries.shap_additivity(spark, "").collect()
    assert [(r["rows"], r["additive"]) for r in got] == [(60, True)] * 3
    assert len(calls) == 1 and limits == [COMPILED_BYTES]
    rows, encoded = model_queries.encoded_applications(train, holdout)
    assert (rows.count(), encoded.count()) == (60, 40)
    assert spark.conf.get(limit) == before


def test_a_plan_runs_compiled_and_the_session_keeps_its_own_limit(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    with pytest.raises(RuntimeError), compiled(spark):
        assert spark.conf.get(limit) == str(COMPILED_BYTES)
        raise RuntimeError
    assert spark.conf.get(limit) == before


def test_configurations_share_the_encoders_of_a_fold(spark, monkeypatch, tmp_path):
    """A fold's encoder is fitted once; a narrower configuration gets the vectors of its own fit."""
    fits, fit = [], encode.ValueImputer._fit
    monkeypatch.setattr(encode.ValueImputer, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    values = {c: F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")) for c in fv.PREDICTORS}
    values |= {c: F.when(F.col("id") % 4 > 0, F.col("id") + 1.0) for c in fv.NUMERIC_COLUMNS}
    train = spark.range(60).withColumns({c: v for c, v in values.items() if c in fv.PREDICTORS})
    train = train.withColumns({"target": F.col("id") % 2, "fold": (F.col("id") % 2).cast("int")})
    train = training.engineered(training.with_label(train.withColumnRenamed("id", "lar_id"), "target").drop("target"))
    full, reduced = CONFIGURATIONS
    specs = [training.RunSpec(f"t_{c}", "boosted_trees", c, "baseline", {"trees": 1, "depth": 1}) for c in (reduced, full)]
    ledgers.train_runs(specs, train, 2, ledgers.Ledger(spark, f"{tmp_path}/ledger"))
    assert len(fits) == 2
    wide = {f.number: f.encoder for f in training.encode_folds(train, 2, full)}
    own, shared = training.encode_folds(train, 2, reduced), training.encode_folds(train, 2, reduced, fitted=wide)
    for a, b in zip(own, shared):
        assert a.names == b.names
        for x, y in ((a.train, b.train), (a.validation, b.validation)):
            assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
