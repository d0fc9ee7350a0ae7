"""Incremental forms of normalising, counting, sampling and scoring.

All four run on a file stream with a checkpoint, so a restarted query goes on
where it stopped; each gives what the batch operator gives over the same rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import target_of
from lendwell.operators.population import eligible_population, is_eligible, normalize
from lendwell.operators.ranking import first_by_hash, hash_order
from lendwell.operators.training import score


def register_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _finish(writer, checkpoint: str) -> None:
    """Run to the end of the available input."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_normalized(register: DataFrame, key: str, out: str, checkpoint: str) -> None:
    """Eligible, normalised rows appended to a Parquet table."""
    rows = normalize(eligible_population(register), keep=(key,))
    _finish(rows.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions of a versioned table: those whose write is marked as finished."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    marked = [
        n for n in names
        if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    ]
    return sorted(int(n.removeprefix("version=")) for n in marked)


def commit_version(rows: DataFrame, folder: str, version: int) -> None:
    """Write one version beside the others. A committed one is never touched
    again, so a replayed batch changes nothing and no reader loses its files."""
    if version not in versions(rows.sparkSession, folder):
        rows.write.mode("overwrite").parquet(f"{folder}/version={version}")


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest committed version."""
    found = versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"no committed version in {folder}")
    return spark.read.parquet(f"{folder}/version={found[-1]}")


def stream_counts(register: DataFrame, out: str, checkpoint: str) -> None:
    """Running eligible rows per target, a version of the table for every trigger."""
    ok = F.coalesce(is_eligible(), F.lit(False))
    counts = (
        register.where(ok)
        .groupBy(target_of("action_taken", "null").alias(fv.TARGET))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def commit(batch: DataFrame, batch_id: int) -> None:
        commit_version(batch, out, batch_id)

    _finish(counts.writeStream.outputMode("complete").foreachBatch(commit), checkpoint)


def stream_sample(
    register: DataFrame, key: str, n: int, state: str, checkpoint: str, seed: int = fv.SAMPLE_SEED
) -> None:
    """Uniform sample of `n` eligible rows over everything seen so far.

    Version i of the sample is made from version i-1 and batch i alone, and is
    written once, so a replayed batch changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            kept = batch.sparkSession.read.parquet(f"{state}/version={batch_id - 1}")
            rows = kept.unionByName(batch).dropDuplicates([key])
        rows = rows.withColumns({"_all": F.lit(1), "_h": hash_order(seed, F.col(key))})
        quota = F.least(F.col("_total"), F.lit(n))
        best = first_by_hash(rows, "_all", "_h", key, quota, "_take").where("_take")
        commit_version(best.drop("_all", "_h", "_take"), state, batch_id)

    eligible = normalize(eligible_population(register), keep=(key,))
    _finish(eligible.writeStream.foreachBatch(merge), checkpoint)


def stream_scores(
    register: DataFrame, key: str, model: PipelineModel, out: str, checkpoint: str
) -> None:
    """Scores of eligible applications appended to a Parquet table."""
    rows = normalize(eligible_population(register), keep=(key,)).select(key, *fv.PREDICTORS)
    scored = score(model, rows).select(key, "prediction", "prediction_label", "probability")
    _finish(
        scored.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint
    )
