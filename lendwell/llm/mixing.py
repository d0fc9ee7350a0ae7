"""Mixing sources to target weights by exponential sampling keys (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendwell.llm.common import WORD, attach, key_text, settle, unit_draw

#: Key ranges per source. Only the range in which a source's budget ends is ordered row by row.
RANGES = 1 << 16
#: A key of 4 units fills 63 % of the ranges, so that ranges stay narrow for the smallest weight too.
KEY_SCALE = 4.0


def quality_weight(text: Column) -> Column:
    """1 for a document without symbols, down to 1/5 where there are as many symbols as words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    share = F.least(F.lit(1.0), symbols / F.greatest(F.lit(1), F.regexp_count(text, F.lit(WORD))))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * share)


def targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Target words of every source: (source, source_size) -> + target.

    Sources are taken by code point, null last, and weigh `weights`, repeating.
    A target is the smaller of `cap` times the source and its weight's share of
    what the capped sources leave; capped sources are those with the least
    room for their weight, so one pass over the sources in that order finds the
    share. The frame has one row per source, which bounds the ordered pass.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, len(weights)) + 1,
    )
    whole = W.orderBy("room", "source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(cap)
    filled = (
        sources.withColumn("weight", weight)
        .withColumn("room", limit / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("open", limit * F.col("rest_weight") > F.col("rest") * F.col("weight"))
    )
    # The first source with room to spare fixes the share of all that follow it.
    first = F.min(F.when(F.col("open"), F.struct("room", F.col("source").isNull().alias("last"), "source", "rest", "rest_weight"))).over(whole)
    share = F.col("weight") * F.col("first.rest") / F.col("first.rest_weight")
    return filled.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull(), limit.cast("double"))
        .otherwise(F.least(limit.cast("double"), share))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix",
    keep_rows: bool = False,
) -> DataFrame:
    """Words taken of every document so that sources come to their targets.

    Efraimidis-Spirakis sampling: every document draws u from its doc_id and
    gets the key -ln(u) / quality. A source first contributes whole epochs,
    floor(target / source size) of them; what is left of its budget goes to its
    documents in the order of their keys, summed up; the last of them gives
    only its first words. The running sum is never taken over a whole source:
    key ranges are summed by a plain aggregate, and only the range in which the
    budget ends is ordered row by row.

    Returns doc_id, source, size, source_size, target, taken, epochs, and with
    `keep_rows` the struct `row` of all columns of the input.

    Null or empty text: size 0, takes 0. Null source: a source of its own.
    Null doc_id: drawn as "null". Repeated rows: each counts; equal keys are
    ordered by doc_id, text checksum and size, rows equal in all of these are
    interchangeable. Empty table: empty result. Further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.crc32(text).alias("tie"),
        (-F.log(unit_draw(seed, key_text(F.col("doc_id")))) / quality_weight(text)).alias("key"),
        *([F.struct("*").alias("row")] if keep_rows else []),
    )
    bucket = F.floor(F.lit(RANGES) * (F.lit(1.0) - F.exp(-F.col("key") / F.lit(KEY_SCALE))))
    rows = settle(rows.withColumn("bucket", F.least(bucket, F.lit(RANGES - 1)).cast("int")), "mix")

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    size = F.greatest(F.col("source_size"), F.lit(1))
    goal = goal.withColumn("epochs", F.floor(F.col("target") / size)).withColumn(
        "rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    )
    # The range in which the rest of the budget ends, and the words before it.
    g, s = goal.alias("g"), sums.alias("s")
    ends = (F.col("s.before") < F.col("g.rest")) & (F.col("s.before") + F.col("s.n") >= F.col("g.rest"))
    goal = g.join(s, F.col("g.source").eqNullSafe(F.col("s.source")) & ends, "left").select(
        "g.*", F.col("s.bucket").alias("edge"), F.col("s.before").alias("before")
    )

    # A row for each source: a source with a third of all rows moves nothing.
    goal = settle(goal.withColumnRenamed("source", "of"), "mix-goal")
    drawn = attach(rows, goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    on_edge = F.col("edge").isNotNull() & (F.col("bucket") == F.col("edge"))
    order = W.partitionBy("source").orderBy("key", "doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    left = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    part = drawn.filter(on_edge).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    whole = drawn.filter(~on_edge).withColumn(
        "part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0))
    )
    out = part.unionByName(whole)
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.col("epochs").cast("int").alias("epochs"),
        *(["row"] if keep_rows else []),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the input's columns: a document appears
    once per epoch, and once more where it was drawn; the drawn copy on the edge
    of a budget holds its first words only, joined by single spaces."""
    m = mix(docs, keep_rows=True, **options)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})")), 1, part.cast("int")), " ")
    copies = F.array_repeat(F.col("size"), F.col("epochs"))
    copies = F.when(part > 0, F.concat(copies, F.array(part))).otherwise(copies)
    one = m.withColumn("words", F.explode(copies)).select("row", "size", "words", "taken", "epochs")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("row.text"))
    return one.select(
        *[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
        / {float(2**52)!r})
    / (1.0 / (1.0 + 4.0 * least(1.0,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::DOUBLE / greatest(1, size)::DOUBLE))) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size / weight AS room,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
      ORDER BY 3 * source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (
      ORDER BY 3 * source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM s
), o AS (
  SELECT rest::DOUBLE AS rest, rest_weight FROM f
  WHERE 3 * source_size * rest_weight > rest * weight
  ORDER BY room, source NULLS LAST LIMIT 1
), g AS (
  SELECT source, source_size, coalesce(
    least((3 * source_size)::DOUBLE, weight * (SELECT rest FROM o) / (SELECT rest_weight FROM o)),
    (3 * source_size)::DOUBLE) AS target
  FROM f
), p AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
    floor(g.target / greatest(g.source_size, 1))::BIGINT AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size,
    floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
