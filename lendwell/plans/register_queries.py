"""Register, population, sampling, contracts and profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import clean_marker, plain_code, target_of
from lendwell.functions.features import code_label_by
from lendwell.functions.text import is_official, url_host
from lendwell.operators import contracts, dataset, population, profile, splits
from lendwell.plans.sql import HASH, PREDICTOR_LIST, clean, unpivot, with_ctes
from lendwell.session import scratch_path
from lendwell.sources import register as files
from lendwell.sources.tables import register, table

# Rows of the sampling queries, so many that the smallest tables have them.
SAMPLE = 1_000


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """Curated columns and key of the eligible rows; the adapter's codes carry no blanks."""
    eligible = population.eligible_population(register(spark, d), clean=True)
    return population.normalize(eligible, ("lar_id",))


def curated(spark: SparkSession, d: str) -> DataFrame:
    return normalized(spark, d).select(*fv.CURATED_COLUMNS)


# --- scan, filter, normalise ---------------------------------------------


def scan_register(spark, d):
    """The register written as gzip CSV with a byte-order mark column and scanned back."""
    path = scratch_path(spark, "register-csv")
    rows = register(spark, d)
    names = rows.columns
    rows = rows.withColumnRenamed(names[0], f"﻿{names[0]}")
    rows.withColumn(f"﻿{names[0]}", F.col(f"`﻿{names[0]}`").cast("string")).write.option(
        "header", True
    ).option("compression", "gzip").option("emptyValue", "").csv(path)
    back = files.scan_register(spark, path, extra=("lar_id",))
    return back.select(
        F.col("lar_id").cast("bigint").alias("lar_id"),
        *(clean_marker(c).alias(c) for c in files.REQUIRED_COLUMNS),
    )


def eligible_population(spark, d):
    return population.eligible_population(register(spark, d))


CLEANED = ("income", "debt_to_income_ratio", "loan_to_value_ratio", "property_value",
           "loan_term", "balloon_payment")


def clean_markers(spark, d):
    return register(spark, d).select("lar_id", *(clean_marker(c).alias(c) for c in CLEANED))


CHECKED = ("income", "loan_amount", "loan_term", "loan_to_value_ratio", "property_value",
           "debt_to_income_ratio")


def numeric_rejects(spark, d):
    return population.numeric_rejects(register(spark, d), "lar_id", CHECKED)


def target_map(spark, d):
    return register(spark, d).select(
        "lar_id", "action_taken", target_of("action_taken", "null").alias("target")
    )


def predictor_projection(spark, d):
    return contracts.select_predictors(normalized(spark, d), ("lar_id",))


def dataset_contract_report(spark, d):
    return contracts.dataset_contract_report(curated(spark, d))


def population_stats(spark, d):
    return population.population_stats(register(spark, d))


def reservoir_sample(spark, d):
    return population.uniform_sample(normalized(spark, d), "lar_id", SAMPLE)


def stratified_holdout(spark, d):
    rows = splits.stratified_holdout(normalized(spark, d), "lar_id")
    return rows.select("lar_id", fv.TARGET, "is_holdout")


def stratified_kfold(spark, d):
    rows = splits.stratified_folds(normalized(spark, d), "lar_id")
    return rows.select("lar_id", fv.TARGET, "fold")


def curated_roundtrip(spark, d):
    """Curated table through the CSV sink and the typed scan."""
    path = scratch_path(spark, "curated-csv")
    files.write_curated(curated(spark, d), path, "csv")
    return files.scan_curated(spark, path, "csv")


def _built(spark, d, n: int) -> dataset.Dataset:
    return dataset.build_dataset(register(spark, d), scratch_path(spark, "curated"), n=n)


def build_dataset(spark, d, n: int = fv.SAMPLE_SIZE):
    """`n` eligible applications, or all where there are fewer, with their class
    and missing-value profile, counted while they are written."""
    return dataset.missing_by_target(spark, _built(spark, d, n))


def dataset_metadata(spark, d, n: int = fv.SAMPLE_SIZE):
    """Source counts, sampling, shape, classes, missing values and column roles of the same build."""
    return dataset.metadata_frame(spark, _built(spark, d, n))


def predictors_and_target(spark, d):
    """The split into predictors and a checked target; audit-only columns are gone."""
    rows = contracts.predictors_and_target(normalized(spark, d), ("lar_id",))
    contracts.require_predictors([c for c in rows.columns if c not in ("lar_id", fv.TARGET)])
    return rows


#: First-generation columns as expressions over the given customers.
V1_RULES = {
    "Income": "c_acctbal", "LoanAmount": "c_acctbal * 3 - 2000", "Age": "CAST(18 + c_custkey % 60 AS DOUBLE)",
    "CreditScore": "CAST(300 + c_custkey % 551 AS DOUBLE)", "YearsExperience": "CAST(c_custkey % 41 AS DOUBLE)",
    "Gender": "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END", "Education": "c_mktsegment",
    "City": "CAST(c_nationkey AS STRING)", "EmploymentType": "CASE WHEN c_custkey % 3 = 0 THEN 'self' ELSE 'employed' END",
    "LoanApproved": "CAST(CASE WHEN c_acctbal > 1000 THEN 1 ELSE 0 END AS TINYINT)",
}


def v1_table(spark, d):
    """A first-generation table with negatives invalidated, checked, exported and read back."""
    rows = table(spark, d, "customer").selectExpr("c_custkey", *(f"{rule} AS {c}" for c, rule in V1_RULES.items()))
    rows = profile.invalidate_negatives(rows, list(fv.V1_INVALIDABLE))
    contracts.require_v1_training_columns(rows.columns[1:])
    contracts.require_binary_target(rows)
    path = scratch_path(spark, "v1-csv")
    files.write_table(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


# --- profile --------------------------------------------------------------


def target_distribution(spark, d):
    return profile.class_distribution(normalized(spark, d), fv.TARGET).withColumn(
        "value", F.col("value").cast("int")
    )


def missingness_global(spark, d):
    return profile.missingness(curated(spark, d))


def missingness_by_target(spark, d):
    rows = profile.missingness_by(curated(spark, d), fv.TARGET, (*fv.PREDICTORS, *fv.AUDIT_ONLY))
    return rows.withColumn("group_value", F.col("group_value").cast("int"))


def null_counts(spark, d):
    return profile.null_counts(curated(spark, d))


def duplicate_rows(spark, d):
    return profile.duplicate_rows(table(spark, d, "documents").select("text", "lang", "source"))


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def describe_numeric(spark, d):
    return profile.describe_numeric(table(spark, d, "lineitem"), MEASURES)


def describe_applications(spark, d):
    return profile.describe_numeric(normalized(spark, d), fv.NUMERIC_COLUMNS)


def negative_counts(spark, d):
    return profile.negative_counts(table(spark, d, "customer"), ("c_acctbal", "c_custkey"))


def invalidate_negatives(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return profile.invalidate_negatives(rows, ["c_acctbal"])


def abs_repair(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return profile.repair_negatives(rows, ["c_acctbal"])


def correlation_matrix(spark, d):
    return profile.correlation_matrix(normalized(spark, d), fv.NUMERIC_COLUMNS)


def histogram(spark, d):
    return profile.histogram(table(spark, d, "events"), "value")


COUNTED = ("loan_purpose", "loan_type", "occupancy_type", "applicant_age", "derived_race")


def category_counts(spark, d):
    return profile.category_counts(normalized(spark, d), COUNTED)


def type_census(spark, d):
    return profile.type_census(curated(spark, d))


def low_information_audit(spark, d):
    return profile.low_information_audit(curated(spark, d), fv.CURATED_COLUMNS)


# --- codes and URLs -------------------------------------------------------

LABELLED = ("loan_purpose", "loan_type", "lien_status", "occupancy_type", "construction_method",
            "preapproval")


def normalize_codes(spark, d):
    """Codes that took the float spelling, and free numbers, back to one spelling."""
    value = F.col("value")
    return table(spark, d, "events").select(
        "event_id",
        plain_code(F.concat(F.floor(value).cast("string"), F.lit(".0"))).alias("whole"),
        plain_code(value.cast("string")).alias("plain"),
        plain_code("event_type").alias("word"),
    )


def label_codes(spark, d):
    cells = [
        F.struct(F.lit(c).alias("model_feature"), F.col(c).alias("code")) for c in LABELLED
    ]
    rows = normalized(spark, d).select("lar_id", F.inline(F.array(*cells)))
    return rows.select(
        "lar_id", "model_feature", "code",
        code_label_by(F.col("model_feature"), F.col("code")).alias("label"),
    )


DATA_HOSTS = ("thther.example.org", "blog.tionsh.example.net", "m.ththth.example.net",
              "www.ththhe.example.com", "blog.ththan.example.net")


def official_sources(spark, d):
    return table(spark, d, "pages").select(
        "page_id", url_host("url").alias("host"), is_official("url", DATA_HOSTS).alias("official")
    )


QUERIES = {
    f.__name__: f
    for f in (
        scan_register, eligible_population, clean_markers, numeric_rejects, target_map,
        predictor_projection, dataset_contract_report, population_stats, reservoir_sample,
        stratified_holdout, stratified_kfold, curated_roundtrip, build_dataset,
        dataset_metadata, predictors_and_target, v1_table,
        target_distribution, missingness_global, missingness_by_target, null_counts,
        duplicate_rows, describe_numeric, describe_applications, negative_counts,
        invalidate_negatives, abs_repair, correlation_matrix, histogram, category_counts,
        type_census, low_information_audit, normalize_codes, label_codes, official_sources,
    )
}
QUERIES["normalize_register"] = normalized

_CURATED = ", ".join(fv.CURATED_COLUMNS)
_INPUTS = (*fv.PREDICTORS, *fv.AUDIT_ONLY)


def _shares(names):
    return ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in names)


def _describe(cte: str, source: str, names) -> str:
    def one(c):
        return (
            f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, "
            f"round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max FROM {source}"
        )

    return with_ctes(cte, "\nUNION ALL\n".join(one(c) for c in names))


def _correlations() -> str:
    c = fv.NUMERIC_COLUMNS
    return with_ctes("norm", "\nUNION ALL\n".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM norm"
        for a in c for b in c
    ))


def _labels() -> str:
    rows = ", ".join(
        f"('{f}', '{k}', '{v}')" for f, codes in fv.CODE_LABEL.items() for k, v in codes.items()
    )
    stacked = " UNION ALL ".join(
        f"SELECT lar_id, '{c}' AS model_feature, {c} AS code FROM norm" for c in LABELLED
    )
    return with_ctes("norm", f"""
SELECT s.lar_id, s.model_feature, s.code,
  CASE WHEN s.model_feature IN (SELECT DISTINCT f FROM names) THEN coalesce(n.label, 'unknown') END AS label
FROM ({stacked}) s LEFT JOIN names n ON n.f = s.model_feature AND n.code = s.code""").replace(
        "\nSELECT s.lar_id", f", names(f, code, label) AS (VALUES {rows})\nSELECT s.lar_id", 1)


def _audit() -> str:
    stacked = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM norm" for c in fv.CURATED_COLUMNS
    )
    return with_ctes("norm", f"""
SELECT column_name, distinct_values, round(missing, 6) AS missing_share, round(other, 6) AS other_share,
  CASE WHEN missing > 0.9 THEN 'mostly_missing' WHEN distinct_values <= 1 THEN 'constant'
       WHEN other < 0.01 THEN 'rare_values' ELSE 'retain' END AS finding
FROM (SELECT column_name, count(value) AS distinct_values, 1 - present / CAST(total AS DOUBLE) AS missing,
        CASE WHEN present > 0 THEN 1 - top / CAST(present AS DOUBLE) END AS other
      FROM (SELECT column_name, value, sum(n) OVER p AS total,
              coalesce(sum(n) FILTER (value IS NOT NULL) OVER p, 0) AS present,
              max(n) FILTER (value IS NOT NULL) OVER p AS top
            FROM (SELECT column_name, value, count(*) AS n FROM ({stacked}) GROUP BY ALL)
            WINDOW p AS (PARTITION BY column_name))
      GROUP BY column_name, total, present, top)""")


def _metadata() -> str:
    def rows(section, values, source):
        return "\nUNION ALL\n".join(
            f"SELECT '{section}', '{name}', CAST({value} AS DOUBLE), NULL FROM {source}" for name, value in values.items()
        )

    def shares(where):
        return {c: f"round(count(*) FILTER ({c} IS NULL) / CAST(count(*) AS DOUBLE), 6)" for c in fv.CURATED_COLUMNS}, f"s{where}"

    parts = [
        rows("population", {"source_rows": "count(*)"}, "lar"),
        rows("population", {
            "eligible_rows": "count(*)",
            "eligible_denied": "count(*) FILTER (action_taken = '3')",
            "eligible_approved": "count(*) FILTER (action_taken IN ('1', '2'))"}, "elig"),
        rows("sampling", {"requested_rows": fv.SAMPLE_SIZE, "random_state": fv.SAMPLE_SEED}, "(SELECT 1)"),
        rows("shape", {"rows": "count(*)", "columns": f"max({len(fv.CURATED_COLUMNS)})"}, "s"),
        rows("missingness", *shares("")),
    ]
    for t in (0, 1):
        hit = f"count(*) FILTER (LoanApproved = {t})"
        parts += [
            rows("target_count", {t: hit}, "s"),
            rows("target_proportion", {t: f"round({hit} / CAST(count(*) AS DOUBLE), 6)"}, "s"),
            rows(f"missingness_{t}", *shares(f" WHERE LoanApproved = {t}")),
        ]
    roles = [(c, r) for r, names in (("predictor", fv.PREDICTORS), ("audit_only", fv.AUDIT_ONLY), ("target", [fv.TARGET])) for c in names]
    parts.append("SELECT 'role', name, CAST(NULL AS DOUBLE), role FROM (VALUES " + ", ".join(
        f"('{c}', '{r}')" for c, r in roles) + ") r(name, role)")
    union = "\nUNION ALL\n".join(parts)
    return with_ctes("lar elig norm", f"""
, s AS (SELECT * FROM norm ORDER BY {HASH}, lar_id LIMIT {fv.SAMPLE_SIZE})
SELECT section, name, value, text FROM ({union}) m(section, name, value, text)""")


_BIN = "least(floor((value - lo) / ((hi - lo) / 40)), 39)"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"

SQL = {
    "scan_register": with_ctes("lar", "SELECT lar_id, " + ", ".join(
        f'{clean(chr(34) + c + chr(34))} AS "{c}"' for c in files.REQUIRED_COLUMNS) + " FROM lar"),
    "eligible_population": with_ctes("elig", "SELECT * FROM elig"),
    "clean_markers": with_ctes(
        "lar", "SELECT lar_id, " + ", ".join(f"{clean(c)} AS {c}" for c in CLEANED) + " FROM lar"),
    "numeric_rejects": with_ctes("lar", "\nUNION ALL\n".join(
        f"SELECT lar_id, '{c}' AS column_name, {c} AS raw_value FROM lar "
        f"WHERE {clean(c)} IS NOT NULL AND TRY_CAST({clean(c)} AS DOUBLE) IS NULL" for c in CHECKED)),
    "target_map": with_ctes("lar", """
SELECT lar_id, action_taken, CAST(CASE action_taken WHEN '1' THEN 1 WHEN '2' THEN 1 WHEN '3' THEN 0 END
  AS TINYINT) AS target FROM lar"""),
    "normalize_register": with_ctes("norm", "SELECT * FROM norm"),
    "predictor_projection": with_ctes("norm", f"SELECT lar_id, {PREDICTOR_LIST} FROM norm"),
    "curated_roundtrip": with_ctes("norm", f"SELECT {_CURATED} FROM norm"),
    "dataset_contract_report": with_ctes("norm", """
SELECT r.rule, r.passed, r.observed FROM (
  SELECT count(*) AS n, count(*) FILTER (LoanApproved IS NULL) AS nulls,
    count(*) FILTER (LoanApproved = 0) AS zeros, count(*) FILTER (LoanApproved = 1) AS ones FROM norm) s,
LATERAL (VALUES ('unique_names', true, '21'), ('ordered_schema', true, '21'),
  ('row_count', true, CAST(s.n AS VARCHAR)), ('target_not_null', s.nulls = 0, CAST(s.nulls AS VARCHAR)),
  ('target_binary', s.zeros > 0 AND s.ones > 0 AND s.zeros + s.ones + s.nulls = s.n,
    CAST(s.zeros AS VARCHAR) || '/' || CAST(s.ones AS VARCHAR)),
  ('no_leakage', true, '0')) r(rule, passed, observed)"""),
    "population_stats": with_ctes("lar elig", """
SELECT (SELECT count(*) FROM lar) AS source_rows, count(*) AS eligible_rows,
  count(*) FILTER (action_taken = '3') AS eligible_denied,
  count(*) FILTER (action_taken IN ('1', '2')) AS eligible_approved FROM elig"""),
    "reservoir_sample": with_ctes(
        "norm", f"SELECT * FROM norm ORDER BY {HASH}, lar_id LIMIT {SAMPLE}"),
    "stratified_holdout": with_ctes("norm", f"""
SELECT lar_id, LoanApproved, r <= round(n * 0.2) AS is_holdout FROM (
  SELECT lar_id, LoanApproved, count(*) OVER (PARTITION BY LoanApproved) AS n,
    row_number() OVER (PARTITION BY LoanApproved ORDER BY {HASH}, lar_id) AS r FROM norm)"""),
    "stratified_kfold": with_ctes("folded", "SELECT lar_id, LoanApproved, fold FROM folded"),
    "build_dataset": with_ctes("norm", f"""
, s AS (SELECT * FROM norm ORDER BY {HASH}, lar_id LIMIT {fv.SAMPLE_SIZE}),
g AS (SELECT LoanApproved, count(*) AS n, {_shares(fv.PREDICTORS)} FROM s GROUP BY LoanApproved)
SELECT CAST(g.LoanApproved AS INTEGER) AS target, g.n,
  round(g.n / CAST((SELECT count(*) FROM s) AS DOUBLE), 6) AS proportion, u.column_name, u.missing_share
FROM g JOIN (UNPIVOT (SELECT LoanApproved, {PREDICTOR_LIST} FROM g) ON {PREDICTOR_LIST}
  INTO NAME column_name VALUE missing_share) u USING (LoanApproved)"""),
    "dataset_metadata": _metadata(),
    "predictors_and_target": with_ctes("norm", f"SELECT lar_id, {PREDICTOR_LIST}, LoanApproved FROM norm"),
    "v1_table": "SELECT c_custkey, " + ", ".join(
        f"CASE WHEN {rule} >= 0 THEN {rule} END AS {c}" if c in fv.V1_INVALIDABLE else f"{rule} AS {c}"
        for c, rule in V1_RULES.items()) + " FROM customer",
    "target_distribution": with_ctes("norm", """
SELECT CAST(LoanApproved AS INTEGER) AS value, count(*) AS n,
  round(count(*) / CAST((SELECT count(*) FROM norm) AS DOUBLE), 6) AS proportion
FROM norm GROUP BY LoanApproved"""),
    "missingness_global": with_ctes("norm", f"""
UNPIVOT (SELECT {_shares(fv.CURATED_COLUMNS)} FROM norm) ON {_CURATED}
INTO NAME column_name VALUE missing_share"""),
    "missingness_by_target": with_ctes("norm", f"""
SELECT CAST(LoanApproved AS INTEGER) AS group_value, column_name, missing_share FROM (
UNPIVOT (SELECT LoanApproved, {_shares(_INPUTS)} FROM norm GROUP BY LoanApproved) ON {", ".join(_INPUTS)}
INTO NAME column_name VALUE missing_share)"""),
    "null_counts": with_ctes("norm", unpivot(
        {c: f"count(*) - count({c})" for c in fv.CURATED_COLUMNS}, "null_count", "norm", "BIGINT")),
    "duplicate_rows": """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)""",
    "describe_numeric": _describe("", "lineitem", MEASURES),
    "describe_applications": _describe("norm", "norm", fv.NUMERIC_COLUMNS),
    "negative_counts": unpivot(
        {c: f"count(*) FILTER ({c} < 0)" for c in ("c_acctbal", "c_custkey")},
        "negative_count", "customer", "BIGINT"),
    "invalidate_negatives":
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer",
    "abs_repair": "SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer",
    "correlation_matrix": _correlations(),
    "histogram": f"""
SELECT bin, round(lo + bin * ((hi - lo) / 40), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / 40), 6) AS upper, n
FROM (SELECT CAST({_BIN} AS INTEGER) AS bin, lo, hi, count(*) AS n
      FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY ALL)""",
    "category_counts": with_ctes("norm", "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM norm GROUP BY {c}"
        for c in COUNTED)),
    "type_census": with_ctes("norm", """
SELECT count(*) AS n_rows, t.data_type, t.n_columns FROM norm,
(VALUES ('double', CAST(5 AS BIGINT)), ('string', CAST(15 AS BIGINT)), ('tinyint', CAST(1 AS BIGINT)))
  t(data_type, n_columns) GROUP BY ALL"""),
    "low_information_audit": _audit(),
    "normalize_codes": """
SELECT event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS whole,
  CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS plain,
  event_type AS word FROM events""",
    "label_codes": _labels(),
    "official_sources": f"""
SELECT page_id, {_HOST} AS host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'https'
  AND {_HOST} IN ({", ".join(f"'{h}'" for h in DATA_HOSTS)}) AS official FROM pages""",
}
