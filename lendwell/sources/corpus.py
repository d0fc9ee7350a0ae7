"""Corpus files and documents: manifests, fingerprints, page rows, chunk files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell.functions.cleaning import col
from lendwell.functions.text import tidy_text
from lendwell.session import task_slots

MANIFEST_SCHEMA = (
    "corpus_id string, document_count long, official_hosts array<string>, "
    "documents array<struct<source_id:string, title:string, institution:string, "
    "source_url:string, document_date:string, document_version:string, "
    "local_filename:string, media_type:string, retrieved_at:string, "
    "sha256:string, bytes:long>>"
)

EVAL_SCHEMA = (
    "queries array<struct<query_id:string, evaluation_group:string, query_type:string, "
    "query:string, expected_source_ids:array<string>, expected_concepts:array<string>, "
    "expected_no_relevant_source:boolean>>"
)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a corpus manifest."""
    docs = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return docs.select(F.explode("documents").alias("d")).select("d.*")


def manifest_status(actual: DataFrame, manifest: DataFrame, key: str = "source_id") -> DataFrame:
    """match / mismatch / new / missing for every document of the files or the manifest.

    `actual` and `manifest` have `key` and `sha256`; only these meet in the join.
    """
    seen = actual.select(key, F.col("sha256").alias("_seen"), F.lit(True).alias("_here"))
    listed = manifest.select(key, F.col("sha256").alias("_listed"), F.lit(True).alias("_known"))
    status = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_here").isNull(), "missing")
        .when(F.col("_listed") == F.col("_seen"), "match")
        .otherwise("mismatch")
    )
    return seen.join(listed, key, "full_outer").select(key, status.alias("status"))


def write_documents(rows: DataFrame, path: str, member: str, fields: Column, bucket: Column) -> None:
    """JSON files that each hold a list of objects under `member`, a file per bucket."""
    lists = rows.groupBy(bucket.alias("bucket")).agg(F.collect_list(fields).alias(member))
    lists.select("bucket", F.to_json(F.struct(member)).alias("value")).write.partitionBy("bucket").text(path)


def scan_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """One row per evaluation query, with the defaults of optional fields filled."""
    rows = spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path)
    rows = rows.select(F.explode("queries").alias("q")).select("q.*")
    no_names = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "evaluation_group": F.coalesce("evaluation_group", F.lit("directed")),
            "query_type": F.coalesce("query_type", F.lit("directed")),
            "expected_source_ids": F.coalesce("expected_source_ids", no_names),
            "expected_concepts": F.coalesce("expected_concepts", no_names),
            "expected_no_relevant_source": F.coalesce(
                "expected_no_relevant_source", F.lit(False)
            ),
        }
    )


def fingerprint(content: Column | str) -> list[Column]:
    """SHA-256 and byte length of a text or binary column."""
    data = col(content).cast("binary")
    return [F.sha2(data, 256).alias("sha256"), F.length(data).cast("bigint").alias("bytes")]


def land_files(rows: DataFrame, path: str, key: str) -> None:
    """Texts as files, a folder for every key. Tasks move their files into place
    themselves; by default the driver would move all of them, one after another."""
    writer = rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(key).text(path)


_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def listed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files below a folder with their content, listed when this is called.

    A task of the listing takes many folders; by default every folder is a task's own.
    """
    before = spark.conf.get(_LISTERS)
    spark.conf.set(_LISTERS, str(min(int(before), task_slots(spark))))
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    finally:
        spark.conf.set(_LISTERS, before)


def scan_files(
    spark: SparkSession, path: str, pattern: str = "*", files: DataFrame | None = None
) -> DataFrame:
    """Path, SHA-256 and size of every file (`files`, where they are listed already); the bytes stay in the tasks."""
    files = listed_files(spark, path, pattern) if files is None else files
    return files.select("path", *fingerprint("content"))


def scan_html(
    spark: SparkSession, path: str, pattern: str = "*.html", files: DataFrame | None = None
) -> DataFrame:
    """One row per HTML file (`files`, where they are listed already) with its whole text."""
    files = listed_files(spark, path, pattern) if files is None else files
    return files.select("path", F.decode("content", "UTF-8").alias("html"))


def page_sections(
    docs: DataFrame, doc_id: str, text: str, separator: str = "\f", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One section per non-empty page of a paged text, labelled `page N` from 1."""
    pages = F.split(F.col(text), f"\\Q{separator}\\E", -1)
    return (
        docs.select(doc_id, *keep, F.posexplode_outer(pages).alias("pos", "raw"))
        .select(
            F.col(doc_id),
            *keep,
            (F.col("pos") + 1).cast("bigint").alias("page_no"),
            F.concat(F.lit("page "), (F.col("pos") + 1).cast("string")).alias("page_or_section"),
            tidy_text("raw").alias("text"),
        )
        .where(F.length("text") > 0)
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "chunk_id string, source_id string, source_title string, institution string, "
        "source_url string, page_or_section string, text string"
    )
    return spark.read.schema(schema).json(path)
