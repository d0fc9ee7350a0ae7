import pytest
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.features import code_label, code_label_by
from lendwell.operators import encode
from lendwell.operators.features import engineer, feature_columns

ROWS = [
    (100.0, 250000.0, 360.0, "1", "1", "1", "2", "30%-<36%", 80.0, 310000.0, "1", "1", "1", "1", "1", "2"),
    (None, 180000.0, 180.0, "2", "2", "1", "2", "42", None, 220000.0, "1", "1", "2", "2", "2", "2"),
    (0.0, 180000.0, 180.0, "2.0", "2", "1", "2", ">60%", 1.0, 0.0, "1", "1", "2", "2", "2", None),
]
SCHEMA = ", ".join(
    f"{c} {'double' if c in fv.NUMERIC_COLUMNS else 'string'}" for c in fv.PREDICTORS
)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_engineered_values(raw):
    rows = engineer(raw).collect()
    assert tuple(rows[0].asDict()) == (*fv.FEATURE_NUMERIC, *fv.FEATURE_CATEGORICAL)
    assert rows[0]["loan_to_income"] == 2.5
    assert rows[0]["property_value_to_income"] == 3.1
    assert rows[0]["loan_to_property_value"] == 250 / 310
    assert rows[0]["loan_term_years"] == 30
    assert rows[0]["dti_category"] == "30_to_35"
    assert rows[0]["non_amortizing_feature_count"] == 1
    assert rows[1]["dti_category"] == "36_to_42" and rows[1]["loan_to_income"] is None
    assert rows[2]["loan_to_income"] is None and rows[2]["loan_to_property_value"] is None
    assert rows[2]["non_amortizing_feature_count"] is None
    assert rows[2]["loan_purpose"] == "2" and rows[2]["dti_category"] == "gt_60"
    with pytest.raises(ValueError, match="inesperadas"):
        engineer(raw.withColumn("x", F.lit(1)))


def test_configurations():
    full, reduced = feature_columns(), feature_columns("without_workflow_features")
    dropped = set(full[0] + full[1]) - set(reduced[0] + reduced[1])
    assert dropped == set(fv.WORKFLOW_FEATURES)
    with pytest.raises(ValueError):
        feature_columns("other")


def test_code_labels(spark):
    cases = [("loan_type", "3", "VA"), ("loan_purpose", "32", "Cash-out refinancing"),
             ("lien_status", "2", "Subordinate lien"), ("occupancy_type", "1.0", "Principal residence"),
             ("construction_method", "2", "Manufactured home"), ("loan_type", "999", "unknown"),
             ("preapproval", "1", None)]
    for feature, code, label in cases:
        df = spark.createDataFrame([(code,)], "c string")
        assert df.select(code_label(feature, "c")).first()[0] == label


def test_label_by_feature_spells_the_code_once(spark):
    names = [*fv.CODE_LABEL, "other", None]
    df = spark.createDataFrame([(f, c) for f in names for c in ("1", " 2.0", "x", None)], "f string, c string")
    df = df.withColumn("label", code_label_by(F.col("f"), F.col("c")))
    for name in fv.CODE_LABEL:
        own = df.where(F.col("f") == name)
        assert own.where(~F.col("label").eqNullSafe(code_label(name, "c"))).count() == 0
    assert df.where(~F.coalesce(F.col("f"), F.lit("")).isin(*fv.CODE_LABEL)).where("label is not null").count() == 0
    lookups = df._jdf.queryExecution().analyzed().toString().count("element_at")
    assert lookups == 2


def test_imputer_and_unknown_categories(spark, tmp_path):
    train = spark.createDataFrame(
        [(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None)], "x double, c string"
    )
    from pyspark.ml import Pipeline, PipelineModel

    model = Pipeline(stages=encode.encoder_stages(["x"], ["c"])).fit(train)
    assert model.stages[0].fill_values() == {"x": 2.5, "c": "a"}
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    new = spark.createDataFrame([(None, "zzz"), (4.0, None)], "x double, c string")
    rows = [r["encoded"].toArray().tolist() for r in again.transform(new).collect()]
    assert rows == [[2.5, 0.0, 0.0], [4.0, 1.0, 0.0]]


def test_dummies_and_modes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "c"), (6, "b")], "k int, c string")
    rows = encode.dummies_drop_first(df, "k", ["c"]).orderBy("k").collect()
    assert rows[0].asDict() == {"k": 1, "c_b": 1, "c_c": 0}
    assert rows[2].asDict() == {"k": 3, "c_b": 0, "c_c": 0}
    assert encode.modes(df, ["c"]).first()["fill_value"] == "b"
