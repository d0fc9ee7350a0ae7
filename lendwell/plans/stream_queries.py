"""Streaming forms, run to the end of the register; each must equal its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.plans.model_queries import champion
from lendwell.plans.register_queries import SAMPLE, SQL as REGISTER_SQL
from lendwell.plans.sql import with_ctes
from lendwell.session import scratch_path
from lendwell.sources.tables import register
from lendwell.streaming import register as streams


#: Triggers that read a landed register at most; each has a cost of its own.
TRIGGERS = 8


def files_per_trigger(files: int) -> int:
    """Two files, or as many as leave no more than `TRIGGERS` triggers."""
    return max(2, -(-files // TRIGGERS))


def _source(spark, d):
    """The register landed as several files, read in several triggers."""
    landed = scratch_path(spark, "landed")
    rows = register(spark, d)
    rows.write.parquet(landed)
    files = len(spark.read.schema(rows.schema).parquet(landed).inputFiles())
    return streams.register_stream(spark, landed, rows.schema, files_per_trigger(files))


def _paths(spark):
    return scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")


def stream_normalize(spark, d):
    out, checkpoint = _paths(spark)
    streams.stream_normalized(_source(spark, d), "lar_id", out, checkpoint)
    return spark.read.parquet(out)


def stream_counts(spark, d):
    out, checkpoint = _paths(spark)
    streams.stream_counts(_source(spark, d), out, checkpoint)
    return streams.latest_version(spark, out).select(F.col(fv.TARGET).cast("int").alias("target"), "n")


def stream_sample(spark, d):
    state, checkpoint = _paths(spark)
    streams.stream_sample(_source(spark, d), "lar_id", SAMPLE, state, checkpoint)
    return streams.latest_version(spark, state)


def stream_scores(spark, d):
    out, checkpoint = _paths(spark)
    streams.stream_scores(_source(spark, d), "lar_id", champion(spark, d), out, checkpoint)
    return spark.read.parquet(out)


QUERIES = {f.__name__: f for f in (stream_normalize, stream_counts, stream_sample, stream_scores)}

SQL = {
    "stream_normalize": REGISTER_SQL["normalize_register"],
    "stream_counts": with_ctes(
        "norm", "SELECT CAST(LoanApproved AS INTEGER) AS target, count(*) AS n FROM norm GROUP BY LoanApproved"),
    "stream_sample": REGISTER_SQL["reservoir_sample"],
}
