"""Cross-site line dedup by sketches of the sites that each line is seen on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import attach, settle

#: Distinct sites from which on a line is boilerplate.
SITES = 8
#: Lines of fewer words are left alone; a line without a word says nothing.
LEAST_WORDS = 1
#: log2 of the sketch's registers; the relative error is about 1.04 / sqrt(2^12) = 1.6 %.
PRECISION = 12
#: Estimates within this share of the threshold are settled by an exact count: six errors wide.
BAND = 0.1


def line_key(line: Column) -> Column:
    """What makes lines equal: the text without blanks at its ends."""
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _has_words(line: Column, least: int) -> Column:
    """Whether a line has at least `least` words; one pass from its start."""
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return line.rlike(rf"\A{blank}*+(?:{word}++{blank}++){{{least - 1}}}{word}")


def _hashes(text: Column, least_words: int) -> Column:
    """Distinct hashes of a text's lines that are long enough to be judged."""
    judged = F.filter(F.split(text, "\n", -1), lambda x: _has_words(x, least_words))
    return F.array_distinct(F.transform(judged, lambda x: F.xxhash64(line_key(x))))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes (`line`) that occur on at least `sites` distinct sites, from (line, site).

    A sketch per line is built where the line is read and merged by the
    aggregation, so a line on every page travels as a few small sketches. Lines
    whose estimate lies within `BAND` of the threshold are counted exactly,
    from distinct (line, site) pairs, again combined before they are moved. A
    null site is a site of its own.
    """
    place = F.coalesce(F.concat(F.lit("="), F.col("site").cast("string")), F.lit("null"))
    marked = lines.select("line", place.alias("site"))
    sketched = marked.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(PRECISION)).alias("sketch"))
    spread = settle(
        sketched.select("line", F.hll_sketch_estimate("sketch").alias("about")).filter(F.col("about") >= sites * (1 - BAND)),
        "spread",
    )
    near = spread.filter(F.col("about") <= sites * (1 + BAND)).select("line")
    exact = (
        marked.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    ).filter(F.col("n") >= sites)
    sure = spread.filter(F.col("about") > sites * (1 + BAND)).select("line")
    return settle(sure.unionByName(exact.select("line")), "boilerplate")


def sites_wanted(docs: DataFrame, site: str = "source") -> int:
    """`SITES`, or in a table of fewer than 20 sites two fifths of them, three at least; a null site is one.

    Two sites say too little: a line of one document and its copy is on two.
    """
    place = F.col(site).cast("string")
    found = docs.agg(F.count_distinct(place).alias("n"), F.coalesce(F.max(place.isNull().cast("int")), F.lit(0)).alias("null"))
    row = found.first()
    return min(SITES, max(3, -(-2 * (row["n"] + row["null"]) // 5)))


def dedup_lines(
    docs: DataFrame, site: str = "source", sites: int = SITES, least_words: int = LEAST_WORDS, keep_rows: bool = False
) -> DataFrame:
    """The texts without the lines that `sites` or more sites share.

    Lines are compared without blanks at their ends; those of fewer than
    `least_words` words always stay. Returns doc_id, n_lines, n_removed, text
    (the rest, lines joined as they were), and with `keep_rows` the struct `row`.

    Rows meet their boilerplate hashes by a hash of doc_id and text, so copies of
    one text spread out; rows that share that hash share their lines too.

    Null text: no lines, stays null. Empty text: one empty line, stays. Null
    site: a site of its own. Null doc_id and repeated rows: each treated alike.
    Very long texts are split in their task; a line is a line at any length.
    Empty table: empty result. Further columns are ignored.
    """
    key = F.xxhash64("doc_id", "text")
    found = docs.select(key.alias("key"), F.col(site).alias("site"), _hashes(F.col("text"), least_words).alias("hashes"))
    found = settle(found.filter(F.size("hashes") > 0), "line-hashes")
    bad = boilerplate(found.select(F.explode("hashes").alias("line"), "site"), sites)
    hits = attach(found.select("key", F.explode("hashes").alias("line")), bad, "line")
    hits = hits.groupBy("key").agg(F.collect_set("line").alias("bad"))

    rows = docs.select(
        key.alias("key"), "doc_id", "text", *([F.struct("*").alias("row")] if keep_rows else [])
    ).join(hits, "key", "left")
    lines = F.split("text", "\n", -1)
    rest = F.filter(lines, lambda x: ~F.array_contains("bad", F.xxhash64(line_key(x))))
    rows = rows.withColumn("rest", F.when(F.col("bad").isNotNull(), rest))
    n_lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0))
    return rows.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(n_lines - F.size("rest"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("rest").isNull(), F.col("text")).otherwise(F.array_join("rest", "\n")).alias("text"),
        *(["row"] if keep_rows else []),
    )


def deduped_documents(docs: DataFrame, **options) -> DataFrame:
    """All documents with their remaining text; n_chars, where there is one, follows it."""
    out = dedup_lines(docs, keep_rows=True, **options)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = """
WITH l AS (
  SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM documents
), bad AS (
  SELECT line FROM l
  WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 1
  GROUP BY line HAVING count(DISTINCT coalesce('=' || source, 'null')) >= (
    SELECT least(8, greatest(3, ceil(2 * count(DISTINCT coalesce('=' || source, 'null')) / 5.0))) FROM documents)
), b AS (
  SELECT coalesce(list(line), []) AS lines FROM bad
), r AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts, list_filter(string_split(text, chr(10)),
    lambda x: NOT list_contains(b.lines, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS rest
  FROM documents, b
)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - len(rest), 0)::BIGINT AS n_removed,
  length(array_to_string(rest, chr(10)))::BIGINT AS kept_chars,
  sha256(encode(array_to_string(rest, chr(10)))) AS kept_sha256
FROM r
"""
