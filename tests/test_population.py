import pytest
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import category, clean_marker, plain_code, target_of, to_number
from lendwell.operators import contracts, population, splits
from lendwell.sources import register as files


USABLE = dict(
    activity_year="2023", action_taken="2", reverse_mortgage="2", business_or_commercial_purpose="2",
    total_units="2", loan_amount="480000", loan_term="180", loan_to_value_ratio="61.5",
    property_value="725000", debt_to_income_ratio="41", applicant_age="55-64",
    derived_race="A", derived_ethnicity="B", derived_sex="C",
)


def raw_row(i, **changes):
    """An eligible row of the register; `changes` replace its values."""
    row = dict.fromkeys(files.REQUIRED_COLUMNS, "1")
    row.update(USABLE, income=str(i), id=i)
    row[fv.OPEN_END] = "2"
    row.update(changes)
    return row


def frame(spark, rows):
    names = ["id", *files.REQUIRED_COLUMNS]
    schema = "id bigint, " + ", ".join(f"`{c}` string" for c in files.REQUIRED_COLUMNS)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_target_map(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), (" 2 ",)], "a string")
    assert [r[0] for r in df.select(target_of("a")).collect()] == [1, 1, 0, 1]
    with pytest.raises(Exception, match="outside the binary target"):
        spark.createDataFrame([("4",)], "a string").select(target_of("a")).collect()


def test_markers_numbers_and_codes(spark):
    df = spark.createDataFrame(
        [(" na ",), ("Exempt",), ("",), (None,), (" x y ",), ("n/a",), ("nan",), ("1e3",), ("inf",)],
        "a string",
    )
    got = [r[0] for r in df.select(clean_marker("a")).collect()]
    assert got == [None, None, None, None, "x y", None, "nan", "1e3", "inf"]
    assert [r[0] for r in df.select(to_number("a")).collect()] == [None] * 7 + [1000.0, None]
    codes = spark.createDataFrame([("1.0",), ("31",), (" 4 ",), ("1.5",), ("x",), (None,)], "a string")
    assert [r[0] for r in codes.select(plain_code("a")).collect()] == ["1", "31", "4", "1.5", "x", None]
    assert [r[0] for r in codes.select(category("a")).collect()] == ["1", "31", "4", "1.5", "x", None]


def test_population_and_missing_values(spark):
    rows = [
        raw_row(1), raw_row(2, action_taken="4"), raw_row(3, total_units="5"),
        raw_row(4, activity_year="2022"),
        raw_row(5, income="NA", debt_to_income_ratio="Exempt", loan_to_value_ratio="NA",
                property_value="NA", submission_of_application="1111", applicant_age="8888"),
    ]
    df = frame(spark, rows)
    stats = population.population_stats(df).first()
    assert (stats["source_rows"], stats["eligible_rows"], stats["eligible_approved"]) == (5, 2, 2)
    out = population.normalize(population.eligible_population(df), ("id",)).orderBy("id").collect()
    assert [r["id"] for r in out] == [1, 5]
    for c in ("income", "debt_to_income_ratio", "combined_loan_to_value_ratio", "property_value",
              "submission_of_application", "applicant_age"):
        assert out[1][c] is None
    assert out[0]["combined_loan_to_value_ratio"] == 61.5


def test_bad_numbers_are_found(spark):
    df = frame(spark, [raw_row(1), raw_row(2, income="many"), raw_row(3, income="NA")])
    rejects = population.numeric_rejects(df, "id", population.REGISTER_NUMBERS).collect()
    assert [(r["id"], r["column_name"], r["raw_value"]) for r in rejects] == [(2, "income", "many")]
    with pytest.raises(ValueError, match="income"):
        population.require_numbers(df)
    with pytest.raises(Exception, match="not a number"):
        population.normalize(df, strict=True).collect()


def test_sample_is_exact_and_independent_of_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    first = sorted(r[0] for r in population.uniform_sample(df, "k", 300).collect())
    again = df.repartition(13).orderBy(F.rand(1))
    assert len(first) == 300
    assert first == sorted(r[0] for r in population.uniform_sample(again, "k", 300).collect())
    assert first != sorted(r[0] for r in population.uniform_sample(df, "k", 300, seed=7).collect())
    with pytest.raises(Exception, match="only 5000"):
        population.uniform_sample(df, "k", 5001).collect()
    with pytest.raises(ValueError):
        population.uniform_sample(df, "k", 0)


def test_holdout_and_folds_are_stratified(spark):
    df = spark.range(1000).select(
        F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("tinyint").alias(fv.TARGET)
    )
    held = splits.stratified_holdout(df, "k").groupBy(fv.TARGET).agg(
        F.count_if("is_holdout").alias("h"), F.count("*").alias("n")).collect()
    assert {r[fv.TARGET]: (r["h"], r["n"]) for r in held} == {0: (133, 666), 1: (67, 334)}
    folds = splits.stratified_folds(df, "k", k=4).groupBy(fv.TARGET, "fold").count().collect()
    for target in (0, 1):
        sizes = [r["count"] for r in folds if r[fv.TARGET] == target]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_dataset_contract(spark):
    df = frame(spark, [raw_row(i, action_taken="3" if i % 3 == 0 else "1") for i in range(9)])
    good = population.normalize(df)
    contracts.require_dataset(good, 9)
    with pytest.raises(ValueError, match="row_count"):
        contracts.require_dataset(good, 10)
    with pytest.raises(ValueError, match="no_leakage"):
        contracts.require_dataset(good.withColumn("interest_rate", F.lit(1)))
    with pytest.raises(ValueError, match="target_binary"):
        contracts.require_dataset(good.where(F.col(fv.TARGET) == 1))
    xy = contracts.predictors_and_target(good)
    assert set(xy.columns) == {*fv.PREDICTORS, fv.TARGET}


def test_predictor_contract_messages():
    names = list(fv.PREDICTORS)
    contracts.require_predictors(reversed(names))
    with pytest.raises(ValueError, match="duplicadas"):
        contracts.require_predictors([*names, names[0]])
    with pytest.raises(ValueError, match=r"faltan columnas: \['income'\]; columnas inesperadas: \['x'\]"):
        contracts.require_predictors(["x", *names[1:]])
    with pytest.raises(ValueError):
        contracts.require_v1_training_columns(fv.V1_PREDICTORS)
    contracts.require_v1_training_columns([*fv.V1_PREDICTORS, fv.TARGET])


def test_csv_scan_drops_byte_order_mark(spark, tmp_path):
    header = ",".join(files.REQUIRED_COLUMNS)
    row = raw_row(1)
    path = tmp_path / "lar.csv"
    path.write_text("﻿" + header + "\n" + ",".join(row[c] for c in files.REQUIRED_COLUMNS) + "\n",
                    encoding="utf-8")
    assert files.scan_register(spark, str(path)).first()["income"] == "1"
    path2 = tmp_path / "short.csv"
    path2.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="income"):
        files.scan_register(spark, str(path2))


def test_curated_size_guard(spark, tmp_path):
    good = population.normalize(frame(spark, [raw_row(1), raw_row(2)]))
    path = str(tmp_path / "out")
    assert files.write_curated(good, path, "csv") > 0
    assert files.scan_curated(spark, path, "csv").count() == 2
    with pytest.raises(ValueError, match="limit"):
        files.write_curated(good, path, "csv", limit_bytes=10)


def test_every_application_value_is_looked_up_once(spark):
    df = spark.range(1).select(F.concat(F.lit('{"income": '), F.col("id").cast("string"), F.lit("}")).alias("j"))
    rows = contracts.validate_applications(df, "j").select("errors")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") + plan.count("variant_get(") <= 2 * 2 * len(fv.PREDICTORS)


def test_applications_fail_closed(spark):
    import json

    base = {c: 1 for c in fv.PREDICTORS}
    cases = [
        base, base | {"derived_sex": "x"}, {k: v for k, v in base.items() if k != "income"},
        base | {"income": "abc"}, base | {"loan_type": 1.5}, base | {"income": None}, [1],
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string")
    out = {r["i"]: r for r in contracts.validate_applications(df, "j").collect()}
    assert out[0]["errors"] == [] and out[0]["application"]["income"] == "1"
    assert out[1]["errors"][0] == "atributos audit-only/target prohibidos: ['derived_sex']"
    assert out[1]["application"] is None
    assert "faltan columnas: ['income']" in out[2]["errors"][0]
    assert out[3]["errors"] == ["income: invalid value"]
    assert out[4]["errors"] == ["loan_type: invalid value"]
    assert out[5]["errors"] == []
    assert out[6]["errors"] == [fv.MSG_NOT_OBJECT]
