"""Corpus, chunk, embedding, search and grading queries."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.text import point_id, tidy_text, url_host
from lendwell.operators import retrieval_eval, sections, vectors
from lendwell.plans.sql import with_ctes
from lendwell.session import scratch_path
from lendwell.sources import corpus, reports
from lendwell.sources.tables import table

SYLLABLES = (("in", "on"), ("an", "en"), ("re", "er"))
TOP = 5


def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tidy_text("text").alias("text"))


def content_fingerprint(spark, d):
    return table(spark, d, "pages").select("page_id", *corpus.fingerprint("html"))


def page_sections(spark, d):
    return corpus.page_sections(table(spark, d, "documents"), "doc_id", "text", "\n")


def section_union(spark, d):
    """Line sections of the documents and whole-text sections of the benchmark items."""
    lines = corpus.page_sections(table(spark, d, "documents"), "doc_id", "text", "\n").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        "page_or_section", "text",
    )
    items = table(spark, d, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("source_id"),
        F.lit("whole text").alias("page_or_section"),
        tidy_text("text").alias("text"),
    )
    return sections.union_sections(lines, items)


def html_sections(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("host", url_host("url"))
    return sections.html_sections(pages, "page_id", "html", "url", ("url", "host"))


def chunk_documents(spark, d):
    """Documents as sections of their source, chunked with running ids."""
    docs = table(spark, d, "documents")
    return sections.make_chunks(docs, "source", "doc_id", "text", ("lang",))


def chunk_ids(spark, d):
    """Lines of each document as given parts, numbered through the document's source."""
    docs = table(spark, d, "documents").select(
        "source", "doc_id", F.split("text", "\n").alias("parts")
    )
    return sections.number_parts(docs, "source", "doc_id", "parts")


def point_ids(spark, d):
    return chunk_ids(spark, d).select("chunk_id", point_id("chunk_id").alias("point_id"))


def corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    parts = F.size(F.filter(F.split("text", "\n"), lambda p: F.length(F.trim(p)) > 0))
    first = docs.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.sum(parts.cast("bigint")).alias("section_count"),
        F.count_distinct("source").alias("source_count"),
    )
    size = table(spark, d, "embeddings").agg(
        F.count(F.lit(1)).alias("vector_count"), F.max(F.size("embedding")).alias("vector_dimension")
    )
    one = F.lit(1).alias("_one")
    return first.select("*", one).join(size.select("*", one), "_one").drop("_one")


def manifest_check(spark, d):
    """Stored hash of each document against its content.

    The manifest was made from cleaned texts before the German documents came.
    """
    docs = table(spark, d, "documents")
    actual = docs.select("doc_id", *corpus.fingerprint("text"))
    listed = docs.where(F.col("lang") != "de").select("doc_id", *corpus.fingerprint(tidy_text("text")))
    return corpus.manifest_status(actual, listed, "doc_id")


#: Members of one landed JSON file, about.
FILE_MEMBERS = 500


def _file(rows: DataFrame, key: str):
    """Which of the landed files a row goes to; their number follows the table's size."""
    return F.pmod(F.xxhash64(key), F.lit(1 + rows.count() // FILE_MEMBERS))


def manifest_scan(spark, d):
    """Pages as the documents of landed manifests, scanned back."""
    pages = table(spark, d, "pages")
    fields = F.struct(
        F.col("page_id").cast("string").alias("source_id"), url_host("url").alias("institution"),
        F.col("url").alias("source_url"), F.lit("text/html").alias("media_type"), *corpus.fingerprint("html"),
    )
    path = scratch_path(spark, "manifests")
    corpus.write_documents(pages, path, "documents", fields, _file(pages, "page_id"))
    return corpus.scan_manifest(spark, path).select(
        "source_id", "institution", "source_url", "media_type", "sha256", "bytes", "title"
    )


def eval_set_scan(spark, d):
    """Benchmark items as landed evaluation sets in which every third leaves optional fields out."""
    items = table(spark, d, "benchmark")
    bare = F.col("item_id") % 3 == 0
    fields = F.struct(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"),
        F.when(~bare, "additional").alias("evaluation_group"),
        F.when(~bare, F.array(F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")))).alias("expected_source_ids"),
        F.when(F.col("item_id") % 3 == 1, F.lit(True)).alias("expected_no_relevant_source"),
    )
    path = scratch_path(spark, "eval-sets")
    corpus.write_documents(items, path, "queries", fields, _file(items, "item_id"))
    return corpus.scan_eval_set(spark, path).select(
        "query_id", "query", "evaluation_group", "query_type",
        F.concat_ws(",", "expected_source_ids").alias("expected_source_ids"),
        F.size("expected_concepts").alias("concepts"), "expected_no_relevant_source",
    )


def html_files(spark, d):
    """Pages landed as one file each: digest and text as the two file scans see them."""
    path = scratch_path(spark, "html")
    corpus.land_files(table(spark, d, "pages").select("page_id", "html"), path, "page_id")
    number = F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("long").alias("page_id")
    files = corpus.listed_files(spark, path, "*.txt")
    texts = corpus.scan_html(spark, path, files=files).select(number, F.length("html").alias("n_chars"))
    return corpus.scan_files(spark, path, files=files).select(number, "sha256", "bytes").join(texts, "page_id")


def run_summary_scan(spark, d):
    """A nested report over line items, return flags standing for runs, scanned back to rows."""
    runs = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.max("l_quantity").cast("double").alias("most")
    )
    fields = F.struct(
        F.col("l_returnflag").alias("run_name"), F.lit("baseline").alias("stage"),
        F.create_map(F.lit("rows"), "n", F.lit("most"), "most").alias("metrics"),
    )
    path = scratch_path(spark, "summaries")
    corpus.write_documents(runs, path, "cv_runs", fields, F.pmod(F.xxhash64("l_returnflag"), F.lit(3)))
    return reports.scan_run_summary(spark, path).select(
        "run_name", "stage", "model_family", F.col("metrics")["rows"].alias("n"), F.col("metrics")["most"].alias("most")
    )


def json_safe_numbers(spark, d):
    """Event values with infinities and NaN among them, through the JSON report sink."""
    bad = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
    value = bad.otherwise(F.col("value").cast("double"))
    rows = table(spark, d, "events").select("event_id", value.alias("x"), F.array(value, F.lit(1.0)).alias("xs"))
    path = scratch_path(spark, "numbers")
    reports.write_json_report(rows, path)
    return spark.read.schema(rows.schema).json(path).select("event_id", "x", F.get("xs", F.lit(0)).alias("x0"), F.size("xs").alias("n"))


def index_reconcile(spark, d):
    """An index of the raw texts without German against cleaned texts without one source."""
    docs = table(spark, d, "documents")
    old = docs.where(F.col("lang") != "de").select("doc_id", "text")
    new = docs.where(F.col("source") != "src7").select("doc_id", tidy_text("text").alias("text"))
    return vectors.reconcile(old, new, "doc_id", "text")


def keyword_embed(spark, d):
    rows = vectors.KeywordEmbedder(SYLLABLES).embed(
        table(spark, d, "documents").select("doc_id", "text"), "text"
    )
    return rows.select(
        "doc_id", *(F.round(F.col("embedding")[i], 9).alias(f"v{i}") for i in range(3))
    )


def hashed_embed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = vectors.HashedTermEmbedder(64).fit(docs, "text").embed(docs, "text")
    return rows.select("doc_id", "embedding")


def vector_table_check(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.vector_table_check(rows, "vec_id", "embedding", None, 64)


def label_queries(spark, d) -> DataFrame:
    """One search per label: the mean vector of the label's rows, summed per task first."""
    rows = table(spark, d, "embeddings")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    means = rows.groupBy("label").agg(mean.alias("m"))
    return means.select(
        F.concat(F.lit("q"), F.col("label").cast("string")).alias("query_id"),
        "label",
        F.transform(vector_to_array("m"), lambda x: F.round(x, 9)).alias("embedding"),
    )


def _topk(spark, d):
    return vectors.cosine_topk(
        table(spark, d, "embeddings").select("vec_id", "embedding"),
        label_queries(spark, d), TOP, key="vec_id",
    )


def cosine_topk(spark, d):
    return _topk(spark, d)


def _graded(spark, d):
    label = F.col("label")
    topic = lambda x: F.concat(F.lit("topic"), x.cast("string"))
    queries = label_queries(spark, d).select(
        "query_id",
        F.when(label % 2 == 0, "directed").otherwise("additional").alias("evaluation_group"),
        F.array(topic(label), topic((label + 1) % 10)).alias("expected_source_ids"),
        F.array(F.concat(F.lit("label "), label.cast("string"))).alias("expected_concepts"),
        (label == 9).alias("expected_no_relevant_source"),
    )
    info = table(spark, d, "embeddings").select("vec_id", "label")
    results = _topk(spark, d).join(info, "vec_id").select(
        "query_id", "rank", topic(label).alias("source_id"),
        F.concat(F.lit("Passage of Label "), label.cast("string")).alias("text"), "score",
    )
    return retrieval_eval.grade_queries(queries, results)


METRICS = ("source_hit_at_k", "source_recall_at_k", "concept_hit_at_k", "mrr_at_k",
           "mean_top_score", "min_top_score")


def retrieval_metrics(spark, d):
    rows = retrieval_eval.retrieval_metrics(_graded(spark, d))
    return rows.select("query_group", "query_count", *(F.round(c, 8).alias(c) for c in METRICS))


def retrieval_ood_metrics(spark, d):
    rows = retrieval_eval.out_of_domain_metrics(_graded(spark, d))
    return rows.withColumns(
        {c: F.round(c, 8) for c in ("mean_top_score", "max_top_score")}
    )


def policy_chunks(spark, d) -> DataFrame:
    """Every page as one policy passage with its metadata."""
    number = F.col("page_id").cast("string")
    return table(spark, d, "pages").select(
        F.format_string("page:%04d", "page_id").alias("chunk_id"),
        url_host("url").alias("source_id"),
        F.concat(F.lit("Page "), number).alias("source_title"),
        F.regexp_extract(url_host("url"), r"([^.]+\.[^.]+)$", 1).alias("institution"),
        F.col("url").alias("source_url"),
        F.concat(F.lit("page "), number).alias("page_or_section"),
        F.col("html").alias("text"),
    )


def benchmark_retrieval(spark, d):
    """Benchmark items as searches over all pages, with keyword vectors."""
    embedder = vectors.KeywordEmbedder(SYLLABLES)
    table_path = scratch_path(spark, "vectors")
    vectors.build_vectors(policy_chunks(spark, d), embedder).write.parquet(table_path)
    queries = table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )
    hits = vectors.retrieve(queries, spark.read.parquet(table_path), embedder, 3)
    return hits.select("query_id", "rank", "chunk_id", "source_id", F.round("score", 7).alias("score"))


def _text_chunks(docs: DataFrame) -> DataFrame:
    """Documents as one chunk each."""
    empty = [F.lit("").alias(c) for c in ("institution", "source_url")]
    return docs.select(
        F.format_string("doc:%06d", "doc_id").alias("chunk_id"), F.col("source").alias("source_id"),
        F.col("source").alias("source_title"), *empty, F.col("lang").alias("page_or_section"), "text",
    )


def refresh_vectors(spark, d):
    """A vector table of the raw texts without German, brought up to cleaned texts without one source."""
    docs = table(spark, d, "documents")
    embedder = vectors.KeywordEmbedder(SYLLABLES)
    path = scratch_path(spark, "vector-table")
    old = _text_chunks(docs.where(F.col("lang") != "de"))
    vectors.write_vector_table(vectors.build_vectors(old, embedder), path)
    new = _text_chunks(docs.where(F.col("source") != "src7").withColumn("text", tidy_text("text")))
    vectors.refresh_vector_table(spark, path, new, embedder)
    return spark.read.parquet(path).select(
        "chunk_id", F.sha2("text", 256).alias("sha256"), *(F.round(F.col("embedding")[i], 9).alias(f"v{i}") for i in range(3))
    )


def chunk_sink(spark, d):
    """Chunks of the HTML sections through the JSON-lines sink and back."""
    parts = html_sections(spark, d).select(
        F.format_string("p%d", "page_id").alias("source_id"), "section_no",
        F.col("url").alias("source_url"), F.col("host").alias("institution"),
        F.col("page_or_section"), "text",
    )
    chunks = sections.make_chunks(
        parts, keep=("source_url", "institution", "page_or_section")
    ).withColumn("source_title", F.col("institution"))
    path = scratch_path(spark, "chunks")
    corpus.write_chunks(chunks.select(
        "chunk_id", "source_id", "source_title", "institution", "source_url", "page_or_section", "text"
    ), path)
    return corpus.scan_chunks(spark, path)


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, content_fingerprint, page_sections, section_union, html_sections,
        manifest_scan, eval_set_scan, html_files, run_summary_scan, json_safe_numbers, refresh_vectors,
        chunk_documents, chunk_ids, point_ids, corpus_stats, manifest_check, index_reconcile,
        keyword_embed, hashed_embed, vector_table_check, cosine_topk, retrieval_metrics,
        retrieval_ood_metrics, benchmark_retrieval, chunk_sink,
    )
}

_BLANK = r"[ \t\x{00a0}]+"


def tidy(c: str) -> str:
    collapsed = f"regexp_replace(regexp_replace({c}, '{_BLANK}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({collapsed}, '^\\s+', ''), '\\s+$', '')"


def _hits(text: str, words) -> str:
    return " + ".join(
        f"(length({text}) - length(replace({text}, '{w}', ''))) / {len(w)}.0" for w in words
    )


def keyword_sql(text: str) -> str:
    """Three keyword counts a, b, c with the all-zero rule."""
    a, b, c = (f"({_hits(f'lower({text})', g)})" for g in SYLLABLES)
    return (
        f"CAST(CASE WHEN {a} = 0 AND {b} = 0 AND {c} = 0 THEN 0.01 ELSE {a} END AS DOUBLE) AS a, "
        f"CAST({b} AS DOUBLE) AS b, CAST({c} AS DOUBLE) AS c"
    )


_LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents"
_QUERIES = """
means AS (SELECT label, list(round(m, 9) ORDER BY i) AS q FROM (
  SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label),
hits AS (SELECT 'q' || m.label AS query_id, m.label AS qlabel, e.vec_id, e.label,
    round(list_cosine_similarity(m.q, CAST(e.embedding AS DOUBLE[])), 9) AS score FROM means m, embeddings e),
topk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM hits QUALIFY rank <= 5),
graded AS (SELECT query_id, qlabel, qlabel = 9 AS ood,
  CASE WHEN qlabel % 2 = 0 THEN 'directed' ELSE 'additional_in_domain' END AS g,
  CAST(count(*) FILTER (label IN (qlabel, (qlabel + 1) % 10)) > 0 AS DOUBLE) AS hit,
  count(DISTINCT label) FILTER (label IN (qlabel, (qlabel + 1) % 10)) / 2.0 AS recall,
  CAST(count(*) FILTER (label = qlabel) > 0 AS DOUBLE) AS concept,
  coalesce(1.0 / min(rank) FILTER (label IN (qlabel, (qlabel + 1) % 10)), 0.0) AS rr,
  max(score) AS top, count(*) AS n FROM topk GROUP BY query_id, qlabel)"""

SQL = {
    "clean_text": f"SELECT doc_id, {tidy('text')} AS text FROM documents",
    "content_fingerprint":
        "SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes FROM pages",
    "page_sections": f"""
SELECT doc_id, n AS page_no, 'page ' || n AS page_or_section, text FROM (
  SELECT doc_id, n, {tidy('raw')} AS text FROM ({_LINES})) WHERE length(text) > 0""",
    "section_union": f"""
SELECT 'doc-' || doc_id AS source_id, 'page ' || n AS page_or_section, text FROM (
  SELECT doc_id, n, {tidy('raw')} AS text FROM ({_LINES})) WHERE length(text) > 0
UNION ALL SELECT 'item-' || item_id, 'whole text', {tidy('text')} FROM benchmark""",
    "chunk_ids": f"""
SELECT printf('%s:%04d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id, n) - 1) AS chunk_id,
  source, doc_id, CAST(n - 1 AS INTEGER) AS part_no, raw AS text FROM ({_LINES})""",
    "point_ids": f"""
SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INTEGER % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT chunk_id, sha1(unhex('{uuid.UUID(fv.POINT_NAMESPACE).hex}') || encode('{fv.POINT_PREFIX}' || chunk_id)) AS h
  FROM (SELECT printf('%s:%04d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id, n) - 1) AS chunk_id
    FROM ({_LINES})))""",
    "corpus_stats": """
SELECT (SELECT count(*) FROM documents) AS document_count,
  (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) > 0) AS section_count,
  (SELECT count(DISTINCT source) FROM documents) AS source_count,
  (SELECT count(*) FROM embeddings) AS vector_count,
  (SELECT CAST(max(len(embedding)) AS INTEGER) FROM embeddings) AS vector_dimension""",
    "manifest_check": f"""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'new' WHEN sha256({tidy('text')}) = sha256(text) THEN 'match'
  ELSE 'mismatch' END AS status FROM documents""",
    "index_reconcile": f"""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'added' WHEN source = 'src7' THEN 'removed'
  WHEN {tidy('text')} = text THEN 'unchanged' ELSE 'changed' END AS status
FROM documents WHERE lang <> 'de' OR source <> 'src7'""",
    "keyword_embed": f"""
SELECT doc_id, round(a / sqrt(a*a + b*b + c*c), 9) AS v0, round(b / sqrt(a*a + b*b + c*c), 9) AS v1,
  round(c / sqrt(a*a + b*b + c*c), 9) AS v2 FROM (SELECT doc_id, {keyword_sql('text')} FROM documents)""",
    "manifest_scan": r"""
SELECT CAST(page_id AS VARCHAR) AS source_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS institution,
  url AS source_url, 'text/html' AS media_type, sha256(html) AS sha256, strlen(html) AS bytes, CAST(NULL AS VARCHAR) AS title
FROM pages""",
    "eval_set_scan": """
SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query,
  CASE WHEN item_id % 3 = 0 THEN 'directed' ELSE 'additional' END AS evaluation_group, 'directed' AS query_type,
  CASE WHEN item_id % 3 = 0 THEN '' ELSE 'src' || (item_id % 7) END AS expected_source_ids,
  CAST(0 AS INTEGER) AS concepts, item_id % 3 = 1 AS expected_no_relevant_source FROM benchmark""",
    "html_files": """
SELECT page_id, sha256(html || chr(10)) AS sha256, strlen(html) + 1 AS bytes, CAST(length(html) + 1 AS INTEGER) AS n_chars FROM pages""",
    "run_summary_scan": """
SELECT l_returnflag AS run_name, 'baseline' AS stage, CAST(NULL AS VARCHAR) AS model_family,
  CAST(count(*) AS DOUBLE) AS n, CAST(max(l_quantity) AS DOUBLE) AS most FROM lineitem GROUP BY l_returnflag""",
    "json_safe_numbers": """
SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(value AS DOUBLE) END AS x,
  CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(value AS DOUBLE) END AS x0, CAST(2 AS INTEGER) AS n FROM events""",
    "refresh_vectors": f"""
SELECT chunk_id, sha256(text) AS sha256, round(a / sqrt(a*a + b*b + c*c), 9) AS v0, round(b / sqrt(a*a + b*b + c*c), 9) AS v1,
  round(c / sqrt(a*a + b*b + c*c), 9) AS v2 FROM (
  SELECT chunk_id, text, {keyword_sql("(source || chr(10) || lang || chr(10) || text)")} FROM (
    SELECT printf('doc:%06d', doc_id) AS chunk_id, source, lang, {tidy('text')} AS text FROM documents WHERE source <> 'src7'))""",
    "vector_table_check": """
SELECT r.rule, r.observed = 0 OR r.rule = 'row_count' AS passed, r.observed FROM (
  SELECT (SELECT count(*) FROM embeddings) AS n,
    (SELECT count(*) FROM (SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1)) AS repeated,
    (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS bad_size,
    (SELECT count(DISTINCT vec_id) FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)
      WHERE x IS NULL OR isnan(x)) AS bad_value) s,
LATERAL (VALUES ('row_count', s.n), ('unique_keys', s.repeated), ('dimension', s.bad_size),
  ('finite_values', s.bad_value)) r(rule, observed)""",
    "cosine_topk": f"WITH {_QUERIES}\nSELECT query_id, rank, vec_id, score FROM topk",
    "retrieval_metrics": f"""
WITH {_QUERIES},
member AS (SELECT g AS query_group, * FROM graded WHERE NOT ood
  UNION ALL SELECT 'all_in_domain', * FROM graded WHERE NOT ood)
SELECT n.query_group, count(m.query_id) AS query_count, round(avg(hit), 8) AS source_hit_at_k,
  round(avg(recall), 8) AS source_recall_at_k, round(avg(concept), 8) AS concept_hit_at_k,
  round(avg(rr), 8) AS mrr_at_k, round(avg(top), 8) AS mean_top_score, round(min(top), 8) AS min_top_score
FROM (VALUES ('directed'), ('additional_in_domain'), ('all_in_domain')) n(query_group)
LEFT JOIN member m USING (query_group) GROUP BY n.query_group""",
    "retrieval_ood_metrics": f"""
WITH {_QUERIES}
SELECT count(*) AS query_count, count(*) FILTER (n > 0) AS returned_results_count, CAST(0 AS BIGINT) AS rejected_count,
  coalesce(avg(CAST(n = 0 AS DOUBLE)), 0.0) AS avoidance_rate, round(avg(top), 8) AS mean_top_score,
  round(max(top), 8) AS max_top_score FROM graded WHERE ood""",
    "benchmark_retrieval": f"""
WITH q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {keyword_sql('text')} FROM benchmark),
p AS (SELECT printf('page:%04d', page_id) AS chunk_id,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS source_id,
  {keyword_sql("'Page ' || page_id || chr(10) || 'page ' || page_id || chr(10) || html")} FROM pages)
SELECT query_id, rank, chunk_id, source_id, round(score, 7) AS score FROM (
  SELECT q.query_id, p.chunk_id, p.source_id,
    round((q.a*p.a + q.b*p.b + q.c*p.c) / (sqrt(q.a*q.a + q.b*q.b + q.c*q.c) * sqrt(p.a*p.a + p.b*p.b + p.c*p.c)), 9) AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, p.chunk_id) AS rank FROM q, p)
WHERE rank <= 3""",
}
