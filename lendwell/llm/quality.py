"""Quality rules: counts of each text and robust multivariate outliers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lendwell.llm import words
from lendwell.llm.common import attach, settle

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct")


def _counts(chunk: words.Chunk) -> dict[str, np.ndarray]:
    data, n = chunk.data, chunk.count
    space = words.SPACE[data]
    starts, ends = chunk.spans(space)
    text = chunk.text_of(starts)
    out = {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": chunk.per_text(~space & ((data & 0xC0) != 0x80)),
        "n_symbols": chunk.per_text(_SYMBOL[data]),
        "n_upper": chunk.per_text(_UPPER[data]),
        "n_punct": chunk.per_text(_PUNCT[data]),
    }
    # Lines with a word that equal an earlier line of their text.
    low, high = chunk.spans(data == 0x0A)
    filled = np.zeros(len(space) + 1, np.int64)
    np.cumsum(~space, out=filled[1:])
    worded = filled[high] > filled[low]
    low, high = low[worded], high[worded]
    line_text = chunk.text_of(low)
    distinct = np.unique(words.mix(chunk.hashes(low, high) + line_text.astype(words.U) * words._BASE), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_text, minlength=n) - np.bincount(line_text[distinct], minlength=n)
    # Words inside windows of three that occur twice or more.
    at, value = words.grams(text, chunk.hashes(starts, ends), 3)
    key = words.mix(value + text[at].astype(words.U) * words._BASE)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    return out


def count_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """`COUNTS` of every text of an Arrow column without nulls."""
    parts = [_counts(c) for c in words.chunks(texts)]
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in COUNTS}


@arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    counts = count_batch(texts)
    return pa.StructArray.from_arrays([pa.array(counts[k]) for k in COUNTS], names=list(COUNTS))


#: Coordinates of the statistic vector: SQL over the counts, and the least spread
#: that counts as one unit, so that a coordinate that hardly varies in a group
#: (no symbols at all) doesn't make every small deviation an outlier.
FEATURES = (
    ("ln(1 + n_words)", 0.5),
    ("ln(1 + word_chars / greatest(n_words, 1))", 0.03),
    ("sqrt(n_symbols / greatest(n_words, 1))", 0.05),
    ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.1),
    ("sqrt(n_upper / greatest(word_chars, 1))", 0.03),
)
P = len(FEATURES)
FLOOR = np.array([f for _, f in FEATURES])
#: Share of a group that the determinant is minimised over.
CORE = 0.75
STEPS = 6
#: Groups of fewer documents use the estimate of their language, or of all documents.
LEAST_GROUP = 50
#: Squared distance beyond which a document goes: 2.4 times the 0.99999 quantile
#: of chi-square with 5 degrees, since clean statistics have heavier tails.
CUTOFF = 75.0
_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = ["n", *_X, *[f"x{i}x{j}" for i, j in _PAIRS]]
_PARAMS = [*[f"m{i}" for i in range(P)], *[f"p{i}{j}" for i, j in _PAIRS]]
DISTANCE = " + ".join(f"{1 if i == j else 2} * p{i}{j} * (x{i} - m{i}) * (x{j} - m{j})" for i, j in _PAIRS)
_SCHEMA = "gid string, " + ", ".join(f"{c} double" for c in _PARAMS)


def _gid(*parts: str) -> Column:
    return F.concat_ws("\x1f", F.lit(len(parts)), *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts])


def _groups() -> dict[str, Column]:
    return {"fine": _gid("lang", "source"), "coarse": _gid("lang"), "all": _gid()}


def core_scale() -> float:
    """By how much the covariance of the central `CORE` of a normal sample is too small."""

    def cdf(x: float, k: int) -> float:  # of chi-square, by its series
        term = total = math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        for i in range(1, 400):
            term *= x / (k + 2 * i)
            total += term
        return total

    low, high = 1e-6, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, P) < CORE else (low, mid)
    return CORE / cdf(low, P + 2)


def _start(rows: DataFrame) -> DataFrame:
    """Median and quartile spread of every coordinate, from counts at 1/64 unit."""
    cells = rows.select("gid", F.posexplode(F.array(*_X)).alias("i", "x"))
    cells = cells.groupBy("gid", "i", F.floor(F.col("x") * 64).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("gid", "i").orderBy("cell")
    whole = W.partitionBy("gid", "i")
    share = (F.sum("n").over(order) - F.col("n") / 2) / F.sum("n").over(whole)
    spots = cells.withColumn("share", share)
    at = lambda q: F.min_by("cell", F.abs(F.col("share") - q)) / 64 + 1 / 128
    spread = spots.groupBy("gid", "i").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    floor = F.element_at(F.array(*[F.lit(float(f)) for f in FLOOR]), F.col("i") + 1)
    by_axis = spread.groupBy("gid").agg(
        *[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)],
        *[
            F.max(F.when(F.col("i") == i, 1 / F.pow(F.greatest("spread", floor), 2))).alias(f"p{i}{i}")
            for i in range(P)
        ],
    )
    return by_axis.select("gid", *[F.col(c) if c[0] == "m" or c[1] == c[2] else F.lit(0.0).alias(c) for c in _PARAMS])


def _estimate(batches):
    """Mean and inverse covariance of each group from its sums."""
    scale = core_scale()
    for b in batches:
        n = b["n"].to_numpy(float)
        mean = b[_X].to_numpy(float) / n[:, None]
        cov = np.zeros((len(b), P, P))
        for i, j in _PAIRS:
            cov[:, i, j] = cov[:, j, i] = b[f"x{i}x{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
        inverse = np.linalg.inv(cov * scale + np.diag(FLOOR**2))
        out = {"gid": b["gid"], **{f"m{i}": mean[:, i] for i in range(P)}}
        yield pd.DataFrame(out | {f"p{i}{j}": inverse[:, i, j] for i, j in _PAIRS})


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One step: distances under `params`, then the estimate over the nearest `CORE` of each group.

    The nearest are told by counts of distances in steps of 1/16 octave, so no
    group is ordered; a step's last cell is taken whole.
    """
    near = attach(rows, params, "gid").withColumn("cell", F.floor(F.log2(F.expr(DISTANCE) + F.lit(2.0**-10)) * 16))
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"x{i}x{j}") for i, j in _PAIRS]
    sums = near.groupBy("gid", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in _X], *products)
    before = F.sum("n").over(W.partitionBy("gid").orderBy("cell")) - F.col("n")
    total = F.sum("n").over(W.partitionBy("gid"))
    core = sums.withColumn("before", before).withColumn("total", total).filter(F.col("before") < CORE * F.col("total"))
    core = core.groupBy("gid").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return settle(core.mapInPandas(_estimate, _SCHEMA), "mcd")


def judge(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Base counts, squared robust distance and verdict of every document.

    Documents that pass the base rules give statistic vectors; per language and
    source the mean and covariance of least determinant over `CORE` of them are
    found by concentration steps from medians and quartile spreads. A document
    beyond `CUTOFF` under its group's estimate is rejected. Estimates rest on all
    documents; groups below `LEAST_GROUP` documents use their language's
    estimate, or that of all documents.

    Null and empty texts: no words, so the base rules reject them. Null language
    or source: a group of its own. Repeated rows: each counts and is judged
    alike. Empty table: empty result. Further columns are ignored, or carried in
    the struct `row` with `keep_rows`.
    """
    rows = docs.select(
        "doc_id",
        "lang",
        "source",
        text_counts(F.coalesce(F.col("text"), F.lit(""))).alias("c"),
        *([F.struct("*").alias("row")] if keep_rows else []),
    )
    failed = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    counted = rows.select("doc_id", "lang", "source", "c.*", *(["row"] if keep_rows else []))
    counted = counted.withColumn("base_failed", F.expr(failed))
    counted = settle(counted.selectExpr("*", *[f"double({e}) AS x{i}" for i, (e, _) in enumerate(FEATURES)]), "quality")

    sound = counted.filter("NOT base_failed")
    groups = _groups()
    sizes = settle(sound.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    by_lang = F.sum("n").over(W.partitionBy("lang"))
    home = (
        F.when(F.col("n") >= LEAST_GROUP, groups["fine"])
        .when(F.col("in_lang") >= LEAST_GROUP, groups["coarse"])
        .otherwise(groups["all"])
    )
    homes = settle(
        sizes.withColumn("in_lang", by_lang).select(groups["fine"].alias("fine"), home.alias("home")), "quality-homes"
    )
    # The members of every group that serves somebody; mostly one group a document.
    wanted = settle(homes.select(F.col("home").alias("gid")).distinct(), "quality-wanted")
    member = sound.select(F.explode(F.array(*groups.values())).alias("gid"), *_X)
    member = settle(attach(member, wanted, "gid", "left_semi"), "quality-members")
    params = settle(_start(member), "mcd")
    for _ in range(STEPS):
        params = _concentrate(member, params)

    homes = settle(homes.join(params, F.col("home") == F.col("gid"), "left").drop("gid", "home"), "quality-params")
    scored = attach(counted, homes, groups["fine"] == F.col("fine"), "left")
    distance = F.when(~F.col("base_failed"), F.expr(DISTANCE))
    return scored.select(
        "doc_id",
        *COUNTS[:5],
        "base_failed",
        distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"),
        *(["row"] if keep_rows else []),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the input's columns."""
    kept = judge(docs, keep_rows=True).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
