"""SQL twins are assembled from named common table expressions."""

from __future__ import annotations

from lendwell import fixed_values as fv

MARKERS = ", ".join(f"'{m}'" for m in fv.MISSING_MARKERS)


def clean(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) IN ({MARKERS}) THEN NULL ELSE trim({c}) END"


def _register() -> str:
    return """
SELECT o.o_orderkey AS lar_id,
  CASE WHEN k % 29 = 0 THEN '2022' ELSE '2023' END AS activity_year,
  CASE WHEN k % 17 = 0 THEN '4'
       WHEN tot_c >= 40000000 OR bal_c <= 0 OR k % 11 = 0 THEN '3'
       WHEN o_orderstatus = 'O' THEN '2' ELSE '1' END AS action_taken,
  CASE WHEN k % 41 = 0 THEN '1' ELSE '2' END AS reverse_mortgage,
  CASE WHEN k % 31 = 0 THEN '1' ELSE '2' END AS "open-end_line_of_credit",
  CASE WHEN k % 23 = 0 THEN '1' WHEN k % 97 = 0 THEN '1111' ELSE '2' END
    AS business_or_commercial_purpose,
  CASE WHEN k % 37 = 0 THEN 'NA' ELSE CAST(bal_c // 5000 AS VARCHAR) END AS income,
  CAST(tot_c // 100 AS VARCHAR) AS loan_amount,
  CASE WHEN n_li IS NULL THEN 'Exempt' WHEN qty >= 100 THEN '360' WHEN qty >= 50 THEN '240'
       ELSE '180' END AS loan_term,
  CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2' WHEN 'HOUSEHOLD' THEN '31'
       WHEN 'FURNITURE' THEN '32' ELSE '4' END AS loan_purpose,
  CAST(1 + c_nationkey % 4 AS VARCHAR) AS loan_type,
  CASE WHEN o_orderpriority = '5-LOW' THEN '2' ELSE '1' END AS lien_status,
  CASE WHEN k % 43 = 0 THEN '1111' WHEN k % 2 = 0 THEN '1' ELSE '2' END AS preapproval,
  CASE WHEN k % 53 = 0 THEN ' na ' WHEN k % 71 < 20 THEN '<20%' WHEN k % 71 < 30 THEN '20%-<30%'
       WHEN k % 71 < 36 THEN '30%-<36%' WHEN k % 71 < 50 THEN CAST(k % 71 AS VARCHAR)
       WHEN k % 71 <= 60 THEN '50%-60%' ELSE '>60%' END AS debt_to_income_ratio,
  CASE WHEN k % 13 = 0 THEN 'NA' ELSE CAST(40 + k % 67 AS VARCHAR) END AS loan_to_value_ratio,
  CASE WHEN ext_c IS NULL THEN 'NA' ELSE CAST(ext_c // 100 AS VARCHAR) END AS property_value,
  CAST(1 + k % 3 AS VARCHAR) AS occupancy_type,
  CASE WHEN k % 19 = 0 THEN '2' ELSE '1' END AS construction_method,
  CASE WHEN n_li >= 8 THEN '5' WHEN n_li IS NULL THEN '1' ELSE CAST(1 + n_li % 4 AS VARCHAR) END
    AS total_units,
  CASE WHEN k % 59 = 0 THEN '1111' WHEN k % 5 = 0 THEN '2' ELSE '1' END
    AS submission_of_application,
  CASE WHEN k % 61 = 0 THEN '1111' WHEN k % 7 = 0 THEN '1' ELSE '2' END AS interest_only_payment,
  CASE WHEN k % 67 = 0 THEN '' WHEN k % 9 = 0 THEN '1' ELSE '2' END AS balloon_payment,
  CASE WHEN k % 47 = 0 THEN '8888' WHEN c_nationkey < 8 THEN '25-34'
       WHEN c_nationkey < 16 THEN '35-44' ELSE '45-54' END AS applicant_age,
  CASE WHEN c_nationkey % 3 = 0 THEN 'A' ELSE 'B' END AS derived_race,
  'X' AS derived_ethnicity,
  'Joint' AS derived_sex
FROM (SELECT *, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS tot_c FROM orders) o
JOIN (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS bal_c FROM customer) c
  ON c.c_custkey = o.o_custkey
LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_li, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS ext_c
  FROM lineitem GROUP BY l_orderkey
) l ON l.l_orderkey = o.o_orderkey"""


def _eligible() -> str:
    return f"""
SELECT * FROM lar
WHERE {clean('activity_year')} = '2023' AND {clean('action_taken')} IN ('1', '2', '3')
  AND {clean('reverse_mortgage')} = '2' AND {clean('"open-end_line_of_credit"')} = '2'
  AND {clean('business_or_commercial_purpose')} = '2'
  AND {clean('total_units')} IN ('1', '2', '3', '4')"""


def normal_columns() -> str:
    out = []
    for c in (*fv.PREDICTORS, *fv.AUDIT_ONLY):
        source = clean(fv.REGISTER_NAME.get(c, c))
        if c in fv.NUMERIC_COLUMNS:
            source = f"CAST({source} AS DOUBLE)"
        elif c in fv.NOT_REPORTED_CODE:
            source = f"nullif({source}, '{fv.NOT_REPORTED_CODE[c]}')"
        out.append(f"{source} AS {c}")
    target = "CAST(CASE WHEN trim(action_taken) IN ('1', '2') THEN 1 ELSE 0 END AS TINYINT)"
    return ",\n  ".join([*out, f"{target} AS {fv.TARGET}"])


DTI_CASE = """CASE WHEN d = '<20%' THEN 'lt_20' WHEN d = '20%-<30%' THEN '20_to_29'
  WHEN d = '30%-<36%' THEN '30_to_35' WHEN d = '50%-60%' THEN '50_to_60' WHEN d = '>60%' THEN 'gt_60'
  WHEN x < 20 THEN 'lt_20' WHEN x < 30 THEN '20_to_29' WHEN x < 36 THEN '30_to_35'
  WHEN x < 43 THEN '36_to_42' WHEN x < 50 THEN '43_to_49' WHEN x <= 60 THEN '50_to_60'
  WHEN x > 60 THEN 'gt_60' END"""


def _features() -> str:
    codes = ",\n  ".join(
        f"{DTI_CASE} AS dti_category" if c == "dti_category" else c for c in fv.FEATURE_CATEGORICAL
    )
    return f"""
SELECT lar_id, income, loan_amount, combined_loan_to_value_ratio, property_value,
  loan_term / 12.0 AS loan_term_years,
  CASE WHEN income * 1000.0 > 0 THEN loan_amount / (income * 1000.0) END AS loan_to_income,
  CASE WHEN income * 1000.0 > 0 THEN property_value / (income * 1000.0) END
    AS property_value_to_income,
  CASE WHEN property_value > 0 THEN loan_amount / property_value END AS loan_to_property_value,
  CAST(CASE interest_only_payment WHEN '1' THEN 1 WHEN '2' THEN 0 END
     + CASE balloon_payment WHEN '1' THEN 1 WHEN '2' THEN 0 END AS DOUBLE)
    AS non_amortizing_feature_count,
  {codes}, LoanApproved
FROM (SELECT *, debt_to_income_ratio AS d, TRY_CAST(debt_to_income_ratio AS DOUBLE) AS x FROM norm)"""


HASH = "md5('42:' || CAST(lar_id AS VARCHAR))"

_CATEGORICAL = ", ".join(fv.FEATURE_CATEGORICAL)
_ORDER = "[" + ", ".join(f"'{c}'" for c in fv.FEATURE_CATEGORICAL) + "]"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lar": ((), _register()),
    "elig": (("lar",), _eligible()),
    "norm": (("elig",), f"\nSELECT lar_id, {normal_columns()}\nFROM elig"),
    "feat": (("norm",), _features()),
    "folded": (
        ("feat",),
        f"""
SELECT *, CAST((row_number() OVER (PARTITION BY LoanApproved ORDER BY {HASH}, lar_id) - 1) % 5
  AS INTEGER) AS fold FROM feat""",
    ),
    "scored": (
        ("folded",),
        """
SELECT f.lar_id, f.fold, CAST(f.LoanApproved AS INTEGER) AS label, r.run_name, r.model_family,
  r.feature_config, r.stage, r.score, CASE WHEN r.score >= r.cut THEN 1 ELSE 0 END AS pred
FROM folded f, LATERAL (VALUES
  ('amount_full', 'amount', 'full', 'baseline', 1.0 / (1.0 + floor(f.loan_amount / 10000.0)), CAST(0.03 AS DOUBLE)),
  ('amount_reduced', 'amount', 'without_workflow_features', 'robustness',
    1.0 / (1.0 + floor(f.loan_amount / 100000.0)), CAST(0.2 AS DOUBLE)),
  ('income_full', 'income', 'full', 'baseline',
    greatest(coalesce(f.income, 0.0), 0.0) / (greatest(coalesce(f.income, 0.0), 0.0) + 50.0), CAST(0.1 AS DOUBLE)),
  ('income_reduced', 'income', 'without_workflow_features', 'robustness',
    CAST(f.loan_type AS DOUBLE) / 5.0, CAST(0.3 AS DOUBLE)),
  ('ratio_full', 'ratio', 'full', 'baseline',
    1.0 / (1.0 + coalesce(f.loan_to_property_value, 0.0)), CAST(0.1 AS DOUBLE)),
  ('ratio_reduced', 'ratio', 'without_workflow_features', 'robustness',
    1.0 / (1.0 + coalesce(f.loan_term_years, 0.0)), CAST(0.035 AS DOUBLE))
) r(run_name, model_family, feature_config, stage, score, cut)""",
    ),
    "cells": (
        ("scored",),
        """
SELECT run_name, model_family, feature_config, stage, fold,
  count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp
FROM scored GROUP BY ALL""",
    ),
    "curve": (
        ("scored",),
        """
SELECT run_name, fold, score, pos, n,
  CAST(sum(pos) OVER w AS BIGINT) AS tps, CAST(sum(n) OVER w AS BIGINT) AS seen
FROM (SELECT run_name, fold, score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n
      FROM scored GROUP BY ALL)
WINDOW w AS (PARTITION BY run_name, fold ORDER BY score DESC)""",
    ),
    "ranked": (
        ("curve",),
        """
SELECT run_name, fold,
  sum(CAST(n - pos AS DOUBLE) * (tps - pos / 2.0)) / (sum(pos) * CAST(sum(n - pos) AS DOUBLE)) AS roc_auc,
  sum(pos * (tps / CAST(seen AS DOUBLE))) / CAST(sum(pos) AS DOUBLE) AS average_precision
FROM curve GROUP BY ALL""",
    ),
    "foldm": (
        ("cells", "ranked"),
        """
SELECT c.*, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1,
  r.roc_auc, r.average_precision
FROM cells c JOIN ranked r USING (run_name, fold)""",
    ),
    "runs": (
        ("foldm",),
        "\nSELECT run_name, model_family, feature_config, stage,\n  "
        + ",\n  ".join(
            f"avg({m}) AS cv_{m}_mean, stddev_pop({m}) AS cv_{m}_std"
            for m in ("precision", "recall", "f1", "roc_auc", "average_precision")
        )
        + "\nFROM foldm GROUP BY ALL",
    ),
    "long": (
        ("feat",),
        f"""
SELECT lar_id, LoanApproved, name AS model_feature, category
FROM (SELECT lar_id, LoanApproved, {_CATEGORICAL} FROM feat)
UNPIVOT INCLUDE NULLS (category FOR name IN ({_CATEGORICAL}))""",
    ),
    "vocab": (
        ("long", "feat"),
        f"""
SELECT model_feature, category,
  row_number() OVER (ORDER BY list_position({_ORDER}, model_feature), category) - 1 AS slot,
  CAST(n1 AS DOUBLE) / total AS p, pos1 / CAST(n1 AS DOUBLE) - pos / CAST(total AS DOUBLE) AS w
FROM (SELECT model_feature, category, count(*) AS n1, CAST(sum(LoanApproved) AS BIGINT) AS pos1
      FROM long WHERE category IS NOT NULL GROUP BY ALL),
     (SELECT count(*) AS total, CAST(sum(LoanApproved) AS BIGINT) AS pos FROM feat)""",
    ),
    "contrib": (
        ("long", "vocab"),
        """
SELECT l.lar_id, v.slot, v.model_feature, v.category,
  CASE WHEN l.category = v.category THEN 1.0 ELSE 0.0 END AS encoded_value,
  v.w * (CASE WHEN l.category = v.category THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END - v.p)
    AS shap_value
FROM long l JOIN vocab v USING (model_feature)""",
    ),
    "factors": (
        ("contrib",),
        """
SELECT lar_id, side, place, slot, model_feature, category, shap_value FROM (
  SELECT *, 'positive' AS side,
    row_number() OVER (PARTITION BY lar_id ORDER BY shap_value DESC, slot) AS place
  FROM contrib WHERE shap_value > 0
  UNION ALL
  SELECT *, 'negative' AS side,
    row_number() OVER (PARTITION BY lar_id ORDER BY shap_value, slot) AS place
  FROM contrib WHERE shap_value < 0) WHERE place <= 5""",
    ),
    "searches": (
        (),
        "\nSELECT * FROM (VALUES "
        + ", ".join(f"('{f}', '{q}')" for f, q in fv.POLICY_QUERY.items())
        + ") t(model_feature, query)",
    ),
    "wanted": (
        ("factors", "searches"),
        """
SELECT lar_id, query, arg_min(model_feature, pos) AS origin_feature,
  row_number() OVER (PARTITION BY lar_id ORDER BY min(pos)) AS query_no
FROM (SELECT f.lar_id, f.model_feature, s.query,
        CASE WHEN f.side = 'positive' THEN f.place ELSE 100 + f.place END AS pos
      FROM factors f JOIN searches s USING (model_feature))
GROUP BY lar_id, query QUALIFY query_no <= 5""",
    ),
}


def with_ctes(names: str, body: str) -> str:
    """`body` preceded by the named expressions and everything they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, text = CTES[name]
        for n in needs:
            add(n)
        done.setdefault(name, text)

    for name in names.split():
        add(name)
    inner = ",\n".join(f"{n} AS ({t}\n)" for n, t in done.items())
    return f"WITH {inner}\n{body}" if done else body


PREDICTOR_LIST = ", ".join(fv.PREDICTORS)
FEATURE_LIST = ", ".join((*fv.FEATURE_NUMERIC, *fv.FEATURE_CATEGORICAL))


def unpivot(columns: dict[str, str], value: str, source: str, kind: str, keep: str = "") -> str:
    """UNION ALL of (column_name, value) rows from a one-row relation of aggregates."""
    lead = f"{keep}, " if keep else ""
    return "\nUNION ALL\n".join(
        f"SELECT {lead}'{name}' AS column_name, CAST({expr} AS {kind}) AS {value} FROM {source}"
        for name, expr in columns.items()
    )
