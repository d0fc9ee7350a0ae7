"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendwell.llm import (
    lines,
    mixing,
    multiindex,
    packing,
    partenum,
    phrase_index,
    pii,
    prefix_trie,
    quality,
    sharding,
    spelling,
    toxicity,
    warc,
)
from lendwell.llm.common import load


def op1_warc_normaliser(spark, d):
    """Every page written as a WARC record, normalised and read back by index."""
    return warc.archive_round_trip(load(spark, d, "pages")).drop("payload", "url")


def op2_partenum_join(spark, d):
    """Every document of the table: its component under Jaccard 0.8 of 5-word shingles."""
    return partenum.jaccard_groups(load(spark, d, "documents"))


def op3_inverted_multi_index(spark, d):
    """Every vector of the table: links and component at cosine 0.93 within its label."""
    return multiindex.near_duplicates(load(spark, d, "embeddings"))


def op4_personal_data(spark, d):
    """Every whole text of the table."""
    return pii.digest(pii.find_personal_data(load(spark, d, "documents")))


def op5_noisy_channel_toxicity(spark, d):
    """Every document of the table, scored by its restored text."""
    return toxicity.score_toxicity(load(spark, d, "documents"), load(spark, d, "labels"))


def op6_robust_outliers(spark, d):
    """Every document of the table, judged in its language and source."""
    return quality.judge(load(spark, d, "documents"))


def op7_source_mixing(spark, d):
    """Every document of the table, mixed with weights 1, 2, 3 and a cap of three epochs."""
    return mixing.mix(load(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_minimum_bin_slack(spark, d):
    """Every document of the table, cut and packed into sequences of 1024 tokens."""
    return packing.pack(load(spark, d, "documents"))


def op9_line_site_spread(spark, d):
    """Every document of the table without the lines that eight or more sources share, or fewer where there are few."""
    docs = load(spark, d, "documents")
    out = lines.dedup_lines(docs, sites=lines.sites_wanted(docs))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def op10_hash_tree_sharding(spark, d):
    """Every document of the table, placed on eight shards."""
    return sharding.shard_documents(load(spark, d, "documents"))


def op11_positional_index(spark, d):
    """Every document of the table against all windows of ten words of the benchmark."""
    return phrase_index.contamination(load(spark, d, "documents"), load(spark, d, "benchmark")).drop("items")


def op12_spelling_variants(spark, d):
    """Every word of the documents table with the frequent spelling it varies."""
    return spelling.spelling_variants(load(spark, d, "documents"))


def op13_prefix_trie(spark, d):
    """Every conversation of the table, rebuilt with the shared first turns of its group of five."""
    return prefix_trie.trie(load(spark, d, "conversations")).drop("node")


QUERIES = {
    "op1_warc_normaliser": op1_warc_normaliser,
    "op2_partenum_join": op2_partenum_join,
    "op3_inverted_multi_index": op3_inverted_multi_index,
    "op4_personal_data": op4_personal_data,
    "op5_noisy_channel_toxicity": op5_noisy_channel_toxicity,
    "op6_robust_outliers": op6_robust_outliers,
    "op7_source_mixing": op7_source_mixing,
    "op8_minimum_bin_slack": op8_minimum_bin_slack,
    "op9_line_site_spread": op9_line_site_spread,
    "op10_hash_tree_sharding": op10_hash_tree_sharding,
    "op11_positional_index": op11_positional_index,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op1_warc_normaliser": warc.SQL,
    "op7_source_mixing": mixing.SQL,
    "op9_line_site_spread": lines.SQL,
    "op11_positional_index": phrase_index.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
