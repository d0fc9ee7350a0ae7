"""Rows, columns and searches that must not get lost."""

import pytest
from pyspark.sql import functions as F

from lendwell import session
from lendwell.operators import ranking, splits, vectors
from lendwell.plans import explain_queries
from lendwell.sources import register
from lendwell.sources.register import REQUIRED_COLUMNS


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    names = list(REQUIRED_COLUMNS)
    for i, order in enumerate((names, names[::-1])):
        (tmp_path / f"{i}.csv").write_text(",".join(order) + "\n" + ",".join(f"v_{c}" for c in order) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        register.scan_register(spark, str(tmp_path)).collect()
    row = register.scan_register(spark, str(tmp_path / "1.csv")).first()
    assert all(row[c] == f"v_{c}" for c in names)


def test_null_is_a_class(spark):
    df = spark.range(300).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("int").alias("c")
    )
    folds = splits.stratified_folds(df, "k", "c", k=4).groupBy("c", "fold").count().collect()
    assert sum(r["count"] for r in folds) == 300 and {r["count"] for r in folds} == {25}
    held = splits.stratified_holdout(df, "k", "c", 0.2).where("is_holdout").groupBy("c").count().collect()
    assert sorted((r["c"] or 0, r["count"]) for r in held) == [(0, 20), (1, 20), (2, 20)]


def test_quota_for_many_classes(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % 2000).alias("c"))
    rows = df.withColumn("h", ranking.hash_order(1, F.col("k")))
    taken = ranking.first_by_hash(rows, "c", "h", "k", F.lit(1), "f").where("f")
    assert taken.groupBy("c").count().where("count = 1").count() == 2000


@pytest.mark.parametrize("text", ["it's", "a\\b", "'; drop", "plain", "\\'"])
def test_any_category_can_stand_in_sql(spark, text):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.where(F.expr(f"c <=> {explain_queries.sql_text(text)}")).count() == 1


def test_blank_searches_are_refused(spark):
    class Words:
        def embed(self, df, text):
            return df.select("query_id", F.array(F.length(text).cast("double"), F.lit(1.0)).alias("embedding"))

    rows = [("a", [1.0, 2.0], *["x"] * 7)]
    table = spark.createDataFrame([("c1", [1.0, 2.0])], "chunk_id string, embedding array<double>")
    for name in vectors.fv.CHUNK_FIELDS:
        if name != "chunk_id":
            table = table.withColumn(name, F.lit(rows[0][2]))
    good = spark.createDataFrame([("q1", "rate")], "query_id string, query string")
    assert vectors.retrieve(good, table, Words(), 1).count() == 1
    for blank in ("  ", "\t", None):
        bad = spark.createDataFrame([("q1", "rate"), ("q2", blank)], "query_id string, query string")
        with pytest.raises(Exception, match="q2"):
            vectors.retrieve(bad, table, Words(), 1).collect()


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Spark:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_folder(Spark())
