"""The given Parquet tables, and a mortgage register derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell.session import task_slots


# Tables that feed costly row work, and their unique key.
SPREAD_BY = {"orders": "o_orderkey", "documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table.

    A file that is smaller than one split per core would be worked on by one
    task; only such a table is spread over the cores by its unique key. Larger
    tables keep the partitions of their scan and are not shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SPREAD_BY and df.rdd.getNumPartitions() < task_slots(spark):
        df = df.repartition(task_slots(spark), SPREAD_BY[name])
    return df


# Register column -> Spark SQL over one order (k, cents, line-item sums, customer).
REGISTER_RULES = {
    "activity_year": "CASE WHEN k % 29 = 0 THEN '2022' ELSE '2023' END",
    "action_taken": """CASE WHEN k % 17 = 0 THEN '4'
        WHEN tot_c >= 40000000 OR bal_c <= 0 OR k % 11 = 0 THEN '3'
        WHEN status = 'O' THEN '2' ELSE '1' END""",
    "reverse_mortgage": "if(k % 41 = 0, '1', '2')",
    "`open-end_line_of_credit`": "if(k % 31 = 0, '1', '2')",
    "business_or_commercial_purpose": (
        "CASE WHEN k % 23 = 0 THEN '1' WHEN k % 97 = 0 THEN '1111' ELSE '2' END"
    ),
    "income": "if(k % 37 = 0, 'NA', string(bal_c div 5000))",
    "loan_amount": "string(tot_c div 100)",
    "loan_term": """CASE WHEN n_li IS NULL THEN 'Exempt' WHEN qty >= 100 THEN '360'
        WHEN qty >= 50 THEN '240' ELSE '180' END""",
    "loan_purpose": """CASE segment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2'
        WHEN 'HOUSEHOLD' THEN '31' WHEN 'FURNITURE' THEN '32' ELSE '4' END""",
    "loan_type": "string(1 + nat % 4)",
    "lien_status": "if(priority = '5-LOW', '2', '1')",
    "preapproval": "CASE WHEN k % 43 = 0 THEN '1111' WHEN k % 2 = 0 THEN '1' ELSE '2' END",
    "debt_to_income_ratio": """CASE WHEN k % 53 = 0 THEN ' na ' WHEN k % 71 < 20 THEN '<20%'
        WHEN k % 71 < 30 THEN '20%-<30%' WHEN k % 71 < 36 THEN '30%-<36%'
        WHEN k % 71 < 50 THEN string(k % 71) WHEN k % 71 <= 60 THEN '50%-60%' ELSE '>60%' END""",
    "loan_to_value_ratio": "if(k % 13 = 0, 'NA', string(40 + k % 67))",
    "property_value": "coalesce(string(ext_c div 100), 'NA')",
    "occupancy_type": "string(1 + k % 3)",
    "construction_method": "if(k % 19 = 0, '2', '1')",
    "total_units": "CASE WHEN n_li >= 8 THEN '5' WHEN n_li IS NULL THEN '1' ELSE string(1 + n_li % 4) END",
    "submission_of_application": (
        "CASE WHEN k % 59 = 0 THEN '1111' WHEN k % 5 = 0 THEN '2' ELSE '1' END"
    ),
    "interest_only_payment": "CASE WHEN k % 61 = 0 THEN '1111' WHEN k % 7 = 0 THEN '1' ELSE '2' END",
    "balloon_payment": "CASE WHEN k % 67 = 0 THEN '' WHEN k % 9 = 0 THEN '1' ELSE '2' END",
    "applicant_age": """CASE WHEN k % 47 = 0 THEN '8888' WHEN nat < 8 THEN '25-34'
        WHEN nat < 16 THEN '35-44' ELSE '45-54' END""",
    "derived_race": "if(nat % 3 = 0, 'A', 'B')",
    "derived_ethnicity": "'X'",
    "derived_sex": "'Joint'",
}


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One all-text register row per order, keyed by `lar_id`.

    Line items are summed per order before the join, so only one row per order
    meets the other two tables.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.expr("count(*) AS n_li"),
            F.expr("sum(bigint(l_quantity)) AS qty"),
            F.expr("sum(bigint(round(l_extendedprice * 100))) AS ext_c"),
        )
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "o_custkey AS cust",
        "o_orderstatus AS status",
        "o_orderpriority AS priority",
        "bigint(round(o_totalprice * 100)) AS tot_c",
    )
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS cust",
        "bigint(round(c_acctbal * 100)) AS bal_c",
        "c_nationkey AS nat",
        "c_mktsegment AS segment",
    )
    base = orders.join(lines, "k", "left").join(customers, "cust")
    return base.selectExpr(
        "k AS lar_id", *(f"{rule} AS {name}" for name, rule in REGISTER_RULES.items())
    )
