"""Written tables: the dataset with its metadata, vector tables, versions, manifests."""

import hashlib
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.operators import dataset, vectors
from lendwell.sources import corpus
from lendwell.sources.tables import register
from lendwell.streaming import register as streams

FOLDER = os.environ.get("LENDWELL_TEST_TABLES", "/root/testdata/sf0.001")


def test_a_dataset_is_built_and_described_in_one_pass(spark, tmp_path):
    rows = register(spark, FOLDER)
    built = dataset.build_dataset(rows, str(tmp_path / "all"))
    assert built.rows == built.population["eligible_rows"] < built.requested_rows
    assert built.population["source_rows"] == rows.count()
    data = spark.read.parquet(built.path)
    assert dataset.column_roles(data) == {
        "predictor": list(fv.PREDICTORS), "audit_only": list(fv.AUDIT_ONLY), "target": [fv.TARGET]
    }
    assert built.profile["missing income"] == data.where("income is null").count() > 0
    files = sorted(Path(built.path).glob("*.parquet"))
    digests = sorted(hashlib.sha256(f.read_bytes()).hexdigest() for f in files)
    assert dataset.checksum(spark, built.path) == hashlib.sha256("".join(digests).encode()).hexdigest()
    assert built.size_bytes >= sum(f.stat().st_size for f in files)
    small = dataset.build_dataset(rows, str(tmp_path / "some"), n=100)
    assert small.rows == 100 == small.profile["rows 0"] + small.profile["rows 1"]


def test_a_dataset_refuses_broken_registers(spark, tmp_path):
    rows = register(spark, FOLDER)
    with pytest.raises(ValueError, match="income"):
        bad = rows.withColumn("income", F.when(F.col("lar_id") % 100 == 0, "much").otherwise(F.col("income")))
        dataset.build_dataset(bad, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="no eligible"):
        dataset.build_dataset(rows.withColumn("activity_year", F.lit("1999")), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="both classes"):
        dataset.build_dataset(rows.withColumn("action_taken", F.lit("1")), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="limit"):
        dataset.build_dataset(rows, str(tmp_path / "d"), n=100, limit_bytes=10)


class Lengths:
    dimension = 2

    def embed(self, df, text):
        return df.withColumn("embedding", F.array(F.length(text).cast("double"), F.lit(1.0)))


def chunks(spark, texts):
    rows = [(k, *["x"] * 5, t) for k, t in texts.items()]
    return spark.createDataFrame(rows, "chunk_id string, source_id string, source_title string, institution string, source_url string, page_or_section string, text string")


def test_a_refresh_leaves_other_partitions_alone(spark, tmp_path):
    path, old = str(tmp_path / "table"), {f"c{i}": f"text {i}" for i in range(60)}
    vectors.write_vector_table(vectors.build_vectors(chunks(spark, old), Lengths()), path, 16)
    stamp = lambda: {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    before = stamp()
    assert vectors.refresh_vector_table(spark, path, chunks(spark, old), Lengths(), 16) == {"unchanged": 60}
    assert stamp() == before
    where = {r["chunk_id"]: r["bucket"] for r in spark.read.parquet(path).collect()}
    lonely = where["c5"]
    new = {k: t for k, t in old.items() if where[k] != lonely} | {"c7": "a longer text"}
    if where["c7"] == lonely:
        new.pop("c7")
    status = vectors.refresh_vector_table(spark, path, chunks(spark, new), Lengths(), 16)
    assert status["removed"] == sum(b == lonely for b in where.values())
    got = {r["chunk_id"]: (r["text"], r["embedding"][0]) for r in spark.read.parquet(path).collect()}
    assert got == {k: (t, float(len(f"x\nx\n{t}"))) for k, t in new.items()}
    touched = {where["c7"], lonely}
    kept = {f: m for f, m in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(stamp().get(f) == m for f, m in kept.items())


def test_very_many_searches_stay_off_the_driver(spark):
    """100,000 searches against a small table, in blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(64, 4))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    angle = F.col("id") * F.lit(0.001)
    qs = spark.range(100_000).select(
        F.col("id").alias("query_id"), F.array(F.cos(angle), F.sin(angle), F.cos(angle * 3), F.lit(0.5)).alias("embedding")
    )
    got = vectors.cosine_topk(vec, qs, 2, key="vec_id", vector_block=40, query_block=30_000)
    seen = got.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("q")).collect()
    assert sorted((r["rank"], r["n"], r["q"]) for r in seen) == [(1, 100_000, 100_000), (2, 100_000, 100_000)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for r in got.where("rank = 1 and query_id in ('0', '777', '99999')").collect():
        a = int(r["query_id"]) * 0.001
        q = np.array([np.cos(a), np.sin(a), np.cos(a * 3), 0.5])
        assert r["vec_id"] == int((unit @ q).argmax())
    assert vectors.cosine_topk(vec.limit(0), qs.limit(5), 2, key="vec_id").count() == 0


def test_versions_are_written_once_and_read_whole(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert streams.versions(spark, folder) == []
    with pytest.raises(FileNotFoundError):
        streams.latest_version(spark, folder)
    streams.commit_version(spark.range(3), folder, 0)
    streams.commit_version(spark.range(99), folder, 0)  # a replayed batch
    streams.commit_version(spark.range(5), folder, 1)
    (tmp_path / "v" / "version=2").mkdir()  # a write that never finished
    (tmp_path / "v" / "version=2" / "part-0.parquet").write_bytes(b"half")
    assert streams.versions(spark, folder) == [0, 1]
    assert streams.latest_version(spark, folder).count() == 5
    assert spark.read.parquet(f"{folder}/version=0").count() == 3
    streams.commit_version(spark.range(7), folder, 2)
    assert streams.latest_version(spark, folder).count() == 7


def test_manifest_status(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "source_id string, sha256 string")
    listed = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4")], "source_id string, sha256 string")
    got = {r["source_id"]: r["status"] for r in corpus.manifest_status(files, listed).collect()}
    assert got == {"a": "match", "b": "mismatch", "c": "new", "d": "missing"}
