"""Grading of ranked passages against expected sources and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grade_queries(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row per evaluation query with hit, recall, rank, concepts and top score.

    Results are (query_id, rank, source_id, text, score) with at most k rows per
    query, so the rows gathered per query are bounded by k.
    """
    hits = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source_id", "text", "score"))).alias("hits")
    )
    rows = queries.join(hits, "query_id", "left").withColumn(
        "hits", F.coalesce("hits", F.expr("array()").cast(hits.schema["hits"].dataType))
    )
    expected = F.array_distinct("expected_source_ids")
    found = F.array_distinct(F.transform("hits", lambda h: h["source_id"]))
    relevant = F.filter("hits", lambda h: F.array_contains(expected, h["source_id"]))
    first = F.array_min(F.transform(relevant, lambda h: h["rank"]))
    text = F.lower(F.concat_ws(" ", F.transform("hits", lambda h: h["text"])))
    ood = F.col("expected_no_relevant_source")
    recall = F.when(
        F.size(expected) > 0, F.size(F.array_intersect(expected, found)) / F.size(expected)
    ).otherwise(0.0)
    concepts = F.forall("expected_concepts", lambda c: F.contains(text, F.lower(c)))
    return rows.select(
        "query_id",
        "evaluation_group",
        ood.alias("out_of_domain"),
        F.when(~ood, first.isNotNull().cast("double")).alias("source_hit"),
        F.when(~ood, recall).alias("source_recall"),
        F.when(~ood, concepts.cast("double")).alias("concept_hit"),
        first.alias("first_relevant_rank"),
        F.when(~ood, F.coalesce(1.0 / first, F.lit(0.0))).alias("reciprocal_rank"),
        F.get(F.col("hits"), F.lit(0))["score"].alias("top_score"),
        F.size("hits").alias("result_count"),
    )


GROUPS = ("directed", "additional_in_domain", "all_in_domain")


def retrieval_metrics(graded: DataFrame) -> DataFrame:
    """Means over the directed, the additional and all in-domain queries."""
    group = F.col("evaluation_group")
    labels = F.array_compact(
        F.array(
            F.when(group == "directed", GROUPS[0]),
            F.when(group == "additional", GROUPS[1]),
            F.lit(GROUPS[2]),
        )
    )
    rows = graded.where(~F.col("out_of_domain")).withColumn("query_group", F.explode(labels))
    sums = rows.groupBy("query_group").agg(
        F.avg("source_hit").alias("source_hit_at_k"),
        F.avg("source_recall").alias("source_recall_at_k"),
        F.avg("concept_hit").alias("concept_hit_at_k"),
        F.avg("reciprocal_rank").alias("mrr_at_k"),
        F.avg("top_score").alias("mean_top_score"),
        F.min("top_score").alias("min_top_score"),
        F.count(F.lit(1)).alias("query_count"),
    )
    names = graded.sparkSession.createDataFrame([(g,) for g in GROUPS], "query_group string")
    return names.join(sums, "query_group", "left").withColumn(
        "query_count", F.coalesce("query_count", F.lit(0))
    )


def out_of_domain_metrics(graded: DataFrame) -> DataFrame:
    """Out-of-domain queries: how many got results, and how high they scored."""
    empty = F.col("result_count") == 0
    return graded.where("out_of_domain").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.count_if(~empty).alias("returned_results_count"),
        F.lit(0).cast("bigint").alias("rejected_count"),
        F.coalesce(F.avg(empty.cast("double")), F.lit(0.0)).alias("avoidance_rate"),
        F.avg("top_score").alias("mean_top_score"),
        F.max("top_score").alias("max_top_score"),
    )
