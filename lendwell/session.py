"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "lendwell") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LENDWELL_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session, whose tasks share one machine, may name none; a
    temporary folder is then made and set for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lendwell-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return f"{shared_folder(spark).rstrip('/')}/lendwell/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path's own file system knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def task_slots(spark: SparkSession) -> int:
    """Shuffle width of the session; bucket counts scale with it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the longest method that the JVM compiles; longer ones are interpreted, row by row.
COMPILED_BYTES = 8000
_LONGEST = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Plans executed within it run compiled: a stage whose fused code is too long for
    the JVM's compiler is run operator by operator, each in short methods."""
    before = spark.conf.get(_LONGEST)
    spark.conf.set(_LONGEST, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(_LONGEST, before)


def keep_compiled(spark: SparkSession) -> None:
    """`compiled` for plans that the caller runs: the session keeps the limit, or a lower one of its own."""
    spark.conf.set(_LONGEST, str(min(int(spark.conf.get(_LONGEST)), COMPILED_BYTES)))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: computed once, its
    lineage cut, its size known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
