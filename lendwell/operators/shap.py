"""Shapley values for whole tables, by kind of model, and the importance tables built from them.

Boosted trees are explained on the log-odds scale, bagged trees on the scale of
the probability, both by Tree SHAP; logistic regression by its closed form, on
the log-odds scale. Other models are refused.

Contributions stay one array per row. Grouping encoded columns to features and
picking the strongest factors happen inside the row, so explaining a table
needs no shuffle; only the global averages do one small aggregate.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from lendwell import fixed_values as fv
from lendwell.operators.encode import encoded_names
from lendwell.session import scratch_path


# --- reading the trees ---------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """One leaf of the ensemble as a box: per split feature an interval (lo, hi]."""

    value: float
    features: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    cold: np.ndarray  # share of training rows that follow the path on that feature


def _tree_nodes(model, spark) -> pd.DataFrame:
    """Nodes of all trees, from the model's own saved table."""
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    weights = spark.read.parquet(f"{path}/treesMetadata")
    node = F.col("nodeData")
    return (
        nodes.select(
            F.col("treeID").alias("tree"),
            node["id"].alias("id"),
            node["prediction"].alias("prediction"),
            node["impurityStats"].alias("classes"),
            node["rawCount"].alias("cover"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"),
            node["split"]["leftCategoriesOrThreshold"].alias("thresholds"),
            node["split"]["numCategories"].alias("categories"),
        )
        .join(weights.toDF("tree", "metadata", "weight").drop("metadata"), "tree")
        .toPandas()
    )


def _split_sides(row: dict) -> tuple[int, tuple[int, float], int]:
    """Feature, (child at or below the cut, cut) and child above it.

    A 0/1 column may be split as a category; its cut is 0.5, and the left child
    takes whichever of the two values the split names.
    """
    j, values = int(row["feature"]), [float(v) for v in row["thresholds"]]
    if row["categories"] < 0:
        return j, (row["left"], values[0]), row["right"]
    if row["categories"] > 2 or len(values) != 1:
        raise ValueError("only 0/1 columns may be split as categories")
    low, high = row["left"], row["right"]
    return (j, (low, 0.5), high) if values[0] == 0.0 else (j, (high, 0.5), low)


def shap_scale(model) -> str:
    """What the values of a model of this kind add up to; other kinds are refused."""
    if isinstance(model, RandomForestClassificationModel):
        return "probability"
    if isinstance(model, (GBTClassificationModel, LogisticRegressionModel)):
        return "log_odds"
    raise TypeError(f"no explanation for {type(model).__name__}")


def _leaf_values(model, positive: int):
    """(leaf, weight of its tree) -> what the leaf adds to the model's output."""
    scale = shap_scale(model)
    if model.numClasses != 2 or positive not in (0, 1):
        raise ValueError(f"two classes are needed, found {model.numClasses}")
    if scale == "probability":
        # The forest averages its trees' class shares.
        trees = model.getNumTrees
        return lambda leaf, _: float(leaf["classes"][positive]) / float(sum(leaf["classes"])) / trees
    if not isinstance(model, GBTClassificationModel):
        raise TypeError(f"{type(model).__name__} has no trees")
    # Margin 2 * sum(weight * tree) is the log-odds of class 1.
    sign = 2.0 if positive == 1 else -2.0
    return lambda leaf, weight: sign * weight * float(leaf["prediction"])


def read_leaves(model, spark, positive: int = 1) -> tuple[list[Leaf], float]:
    """Leaves of boosted or bagged trees on the model's scale, and the base value.

    The size of the ensemble is a training parameter, not a function of the data,
    so it is read on the driver and shipped to the tasks.
    """
    value_of = _leaf_values(model, positive)
    leaves: list[Leaf] = []
    base = 0.0
    for _, tree in _tree_nodes(model, spark).groupby("tree"):
        rows = tree.set_index("id").to_dict("index")
        weight = float(next(iter(rows.values()))["weight"])
        root_cover = float(rows[0]["cover"])
        stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while stack:
            node_id, box = stack.pop()
            row = rows[node_id]
            if row["left"] < 0:
                f, value = sorted(box), value_of(row, weight)
                leaves.append(
                    Leaf(
                        value,
                        np.array(f, dtype=np.int64),
                        np.array([box[i][0] for i in f]),
                        np.array([box[i][1] for i in f]),
                        np.array([box[i][2] for i in f]),
                    )
                )
                base += value * float(row["cover"]) / root_cover
                continue
            j, below, above = _split_sides(row)
            lo, hi, cold = box.get(j, (-math.inf, math.inf, 1.0))
            cut = below[1]
            for child, interval in (
                (below[0], (lo, min(hi, cut))),
                (above, (max(lo, cut), hi)),
            ):
                share = float(rows[child]["cover"]) / float(row["cover"])
                stack.append((child, {**box, j: (*interval, cold * share)}))
    return leaves, base


# --- the kernel ----------------------------------------------------------


def _shapley_of_leaf(hot: np.ndarray, cold: np.ndarray) -> np.ndarray:
    """Shapley values of the game prod(hot or cold) for a batch of hot patterns.

    For player j the value is (hot_j - cold_j) times the weighted sum over
    coalitions of the others; the coalition sizes are the coefficients of the
    polynomial prod(cold_i + hot_i * t).
    """
    n, d = hot.shape
    weight = np.array(
        [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
    )
    phi = np.empty((n, d))
    for j in range(d):
        poly = np.zeros((n, d))
        poly[:, 0] = 1.0
        for step, i in enumerate(k for k in range(d) if k != j):
            shifted = poly[:, : step + 1] * hot[:, i : i + 1]
            poly[:, : step + 1] *= cold[i]
            poly[:, 1 : step + 2] += shifted
        phi[:, j] = (hot[:, j] - cold[j]) * (poly @ weight)
    return phi


#: Leaves of at most so many features have the values of all their patterns computed beforehand.
TABLED = 8


def pattern_values(leaf: Leaf) -> np.ndarray | None:
    """Values of a leaf's features for every pattern of hot features; none for deeper leaves."""
    d = len(leaf.features)
    if not 0 < d <= TABLED:
        return None
    hot = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    return leaf.value * _shapley_of_leaf(hot.astype(float), leaf.cold)


def shap_matrix(
    x: np.ndarray, leaves: Sequence[Leaf], tables: Sequence[np.ndarray | None] | None = None
) -> np.ndarray:
    """Path-dependent Tree SHAP values of each row of an encoded matrix.

    `tables` holds the `pattern_values` of the leaves, for callers with many matrices.
    """
    columns = np.ascontiguousarray(x.T)
    out = np.zeros_like(columns, dtype=float)
    for leaf, table in zip(leaves, map(pattern_values, leaves) if tables is None else tables):
        d = len(leaf.features)
        if d == 0:
            continue
        hot = [(columns[j] > lo) & (columns[j] <= hi) for j, lo, hi in zip(leaf.features, leaf.lo, leaf.hi)]
        code = np.zeros(len(x), dtype=np.int64)
        for i, h in enumerate(hot):
            code |= h.astype(np.int64) << i
        if table is None:
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            patterns = np.stack([h[first] for h in hot], axis=1).astype(float)
            table = leaf.value * _shapley_of_leaf(patterns, leaf.cold)
        for i, j in enumerate(leaf.features):
            out[j] += table[:, i][code]
    return np.ascontiguousarray(out.T)


def tree_shap(
    scored: DataFrame, model, vector: str = "encoded", output: str = "shap", positive: int = 1
) -> DataFrame:
    """Add the SHAP array of each row and `base_value`; rows keep their partitions.

    Rows pass through as Arrow batches: only the encoded values are read.
    """
    spark = scored.sparkSession
    leaves, base = read_leaves(model, spark, positive)
    shared = spark.sparkContext.broadcast(
        [(x.value, x.features, x.lo, x.hi, x.cold) for x in leaves]
    )
    vectors = [f.name for f in scored.schema.fields if isinstance(f.dataType, VectorUDT)]
    rows = scored.withColumn("_x", vector_to_array(vector)).drop(*vectors)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Leaf(*parts) for parts in shared.value]
        tables = [pattern_values(leaf) for leaf in trees]
        for batch in batches:
            n, lists = batch.num_rows, batch.column("_x")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
            values = shap_matrix(x, trees, tables) if n else x
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1], pa.int32())
            found = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, output])

    added = T.StructField(output, T.ArrayType(T.DoubleType()))
    return (
        rows.mapInArrow(kernel, T.StructType([*rows.schema.fields, added]))
        .withColumn("base_value", F.lit(base))
        .withColumnRenamed("_x", f"{vector}_values")
    )


def vector_means(df: DataFrame, vector: str = "encoded") -> list[float]:
    """Mean of every encoded column, from one aggregate."""
    mean = df.agg(Summarizer.mean(F.col(vector)).alias("m")).first()["m"]
    if mean is None:
        raise ValueError("no rows to compare with")
    return [float(x) for x in mean.toArray()]


def linear_shap(
    scored: DataFrame, model, means: Sequence[float], vector: str = "encoded", output: str = "shap",
    positive: int = 1,
) -> DataFrame:
    """The same columns as `tree_shap` for a logistic model: weight * (value - mean).

    These are the Shapley values of a linear model over independent columns
    with the given means; built-in array expressions only.
    """
    if model.numClasses != 2 or len(means) != model.numFeatures:
        raise ValueError(f"{model.numClasses} classes, {len(means)} means for {model.numFeatures} columns")
    sign = 1.0 if positive == 1 else -1.0
    weights = [sign * float(w) for w in model.coefficients.toArray()]
    base = sign * float(model.intercept) + sum(w * m for w, m in zip(weights, means))
    vectors = [f.name for f in scored.schema.fields if isinstance(f.dataType, VectorUDT)]
    rows = scored.withColumn(f"{vector}_values", vector_to_array(vector)).drop(*vectors)
    centred = F.zip_with(f"{vector}_values", F.array(*map(F.lit, means)), lambda x, m: x - m)
    values = F.zip_with(centred, F.array(*map(F.lit, weights)), lambda x, w: w * x)
    return rows.withColumn(output, values).withColumn("base_value", F.lit(base))


def explain_rows(
    scored: DataFrame, model, background: DataFrame | None = None, vector: str = "encoded", positive: int = 1
) -> DataFrame:
    """Add `shap` and `base_value` by the model's kind.

    A linear model is compared with the means of `background`, by default of the
    explained rows themselves; trees know their training rows.
    """
    shap_scale(model)
    if isinstance(model, LogisticRegressionModel):
        return linear_shap(scored, model, vector_means(background or scored, vector), vector, positive=positive)
    return tree_shap(scored, model, vector, positive=positive)


def additivity(explained: DataFrame, model, probability: str = "probability") -> DataFrame:
    """Rows, and whether base value and contributions add up to the model's output on each."""
    total = F.col("base_value") + F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    given = F.col(probability)
    if shap_scale(model) == "log_odds":
        total = 1.0 / (1.0 + F.exp(-total))
    return explained.agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(F.abs(total - given) > 1e-9) == 0).alias("additive")
    )


# --- descriptors ---------------------------------------------------------


class Slot(NamedTuple):
    """Place and name of an encoded column, the feature and category it encodes."""

    index: int
    encoded_name: str
    model_feature: str
    category: str | None


def make_slots(names: Sequence[tuple[str, str, str | None]]) -> list[Slot]:
    slots = [Slot(i, *n) for i, n in enumerate(names)]
    for s in slots:
        if set(fv.FEATURE_SOURCES.get(s.model_feature, (s.model_feature,))) & set(fv.AUDIT_ONLY):
            raise AssertionError(f"audit-only column reached the model: {s.encoded_name}")
    return slots


def model_slots(model: PipelineModel, scored: DataFrame, config: str = "full") -> list[Slot]:
    """Slots of a fitted pipeline, checked against the encoded vector's own metadata."""
    slots = make_slots(encoded_names(model, config))
    attrs = scored.schema["encoded"].metadata.get("ml_attr", {})
    if attrs.get("num_attrs") not in (None, len(slots)):
        raise ValueError(f"vector has {attrs['num_attrs']} columns, mapping has {len(slots)}")
    named = {a["idx"]: a["name"] for group in attrs.get("attrs", {}).values() for a in group}
    for s in slots:
        given = named.get(s.index, s.encoded_name).replace("__onehot", "")
        if given != s.encoded_name:
            raise ValueError(f"column {s.index} is {given!r}, mapping says {s.encoded_name!r}")
    return slots


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def slot_frame(spark, slots: Sequence[Slot]) -> DataFrame:
    """The encoded columns with their names in words, from the fixed tables."""
    feature, category = F.col("model_feature"), F.col("category")
    codes = {f"{f}={c}": text for f, table in fv.CODE_LABEL.items() for c, text in table.items()}
    business = F.coalesce(_lookup(fv.BUSINESS_NAME, feature), feature)
    sources = _lookup({f: "|".join(s) for f, s in fv.FEATURE_SOURCES.items()}, feature)
    known = F.coalesce(_lookup(codes, F.concat_ws("=", feature, category)), F.lit(fv.UNKNOWN_LABEL))
    label = F.when(category.isNotNull() & feature.isin(*fv.CODE_LABEL), known)
    unknown = F.format_string("%s = unknown (code %s)", business, category)
    display = (
        F.when(category.isNull(), business)
        .when(label == fv.UNKNOWN_LABEL, unknown)
        .otherwise(F.concat_ws(" = ", business, F.coalesce(label, category)))
    )
    rows = spark.createDataFrame(
        [tuple(s) for s in slots],
        "slot int, encoded_name string, model_feature string, category string",
    )
    return rows.select(
        "slot", "encoded_name", display.alias("display_feature"), "model_feature",
        business.alias("business_feature"), F.coalesce(sources, feature).alias("source_features"),
        "category", label.alias("category_label"),
    )


NAMES = ("display_feature", "business_feature", "source_features")


def slot_names(spark, slots: Sequence[Slot]) -> Column:
    """Encoded name -> `NAMES`, as one constant map; a model has few encoded columns."""
    rows = slot_frame(spark, slots).select("encoded_name", *NAMES).collect()
    table = {r["encoded_name"]: {n: r[n] for n in NAMES} for r in rows}
    fields = ",".join(f"{n}:string" for n in NAMES)
    return F.from_json(F.lit(json.dumps(table)), f"map<string,struct<{fields}>>")


# --- global importance ---------------------------------------------------


def encoded_importance(df: DataFrame, slots: Sequence[Slot], shap: str = "shap") -> DataFrame:
    """Mean absolute contribution per encoded column, ranked."""
    # The outer form keeps the optimizer from repeating the array in a filter below.
    cells = df.select(F.posexplode_outer(shap).alias("slot", "v")).where(F.col("slot").isNotNull())
    sums = cells.groupBy("slot").agg(
        F.avg(F.abs("v")).alias("mean_abs_shap")
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("mean_abs_shap").desc(), "encoded_name")
    table = sums.join(slot_frame(df.sparkSession, slots), "slot")
    return table.withColumn("rank", F.row_number().over(order)).drop("slot")


def _feature_spans(slots: Sequence[Slot]) -> dict[str, list[int]]:
    spans: dict[str, list[int]] = {}
    for s in slots:
        spans.setdefault(s.model_feature, []).append(s.index)
    return spans


def grouped_values(slots: Sequence[Slot], shap: Column) -> Column:
    """Array of contributions summed per feature, in the order of first appearance."""
    spans = _feature_spans(slots)
    places = F.array(*(F.array(*(F.lit(i) for i in idx)) for idx in spans.values()))
    return F.transform(
        places, lambda idx: F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + F.get(shap, i))
    )


def grouped_importance(df: DataFrame, slots: Sequence[Slot], shap: str = "shap") -> DataFrame:
    """Sum per (row, feature) first, then the mean of the absolute sums, ranked."""
    spans = _feature_spans(slots)
    names = df.sparkSession.createDataFrame(
        [
            (i, f, fv.BUSINESS_NAME.get(f, f), "|".join(fv.FEATURE_SOURCES.get(f, (f,))), len(idx))
            for i, (f, idx) in enumerate(spans.items())
        ],
        "place int, model_feature string, business_feature string, source_features string, "
        "encoded_columns int",
    )
    sums = (
        df.select(F.posexplode_outer(grouped_values(slots, F.col(shap))).alias("place", "v"))
        .where(F.col("place").isNotNull())
        .groupBy("place")
        .agg(F.avg(F.abs("v")).alias("mean_abs_shap"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("mean_abs_shap").desc(), "model_feature")
    return sums.join(names, "place").withColumn("rank", F.row_number().over(order)).drop("place")


# --- local factors -------------------------------------------------------

_FACTOR = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("feature", T.StringType()),
            ("model_feature", T.StringType()),
            ("source_features", T.ArrayType(T.StringType())),
            ("category", T.StringType()),
            ("raw_code", T.StringType()),
            ("category_label", T.StringType()),
            ("category_active", T.BooleanType()),
            ("application_value", T.StringType()),
            ("encoded_value", T.DoubleType()),
            ("shap_value", T.DoubleType()),
            ("slot", T.IntegerType()),
        )
    ]
)


def _slot_table(spark, slots: Sequence[Slot]) -> list[dict]:
    """The fixed descriptions of the encoded columns, in their order."""
    places = {f: i for i, f in enumerate(_feature_spans(slots))}
    return [
        {
            "feature": r["display_feature"],
            "model_feature": r["model_feature"],
            "source_features": r["source_features"].split("|"),
            "category": r["category"],
            "category_label": r["category_label"],
            "place": places[r["model_feature"]],
        }
        for r in slot_frame(spark, slots).orderBy("slot").collect()
    ]


def _rectangle(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros; nulls and NaN are zeros too."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    out = np.zeros((len(lists), max(int(lengths.max(initial=0)), 1)))
    flat = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return np.nan_to_num(out, copy=False, nan=0.0, posinf=np.inf, neginf=-np.inf)


def _top_factors(table: Sequence[dict], n: int):
    """Arrow kernel of `with_top_factors`: (shap, encoded values, own values) to both lists."""
    column = lambda name, kind=pa.string(): pa.array([r[name] for r in table], kind)
    # Names of each column: as such, absent, present.
    shown = [x for r in table for x in (
        (r["feature"],) * 2 if r["category"] is None else (f"{r['feature']} (absent)", f"{r['feature']} (present)"))]
    coded = np.array([r["category"] is not None for r in table], bool)
    place = np.array([r["place"] for r in table], np.int64)
    kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in _FACTOR.fields]

    def kernel(shap: pa.Array, values: pa.Array, own: pa.Array) -> pa.Array:
        known, matrix = np.asarray(shap.is_valid()), _rectangle(shap)
        x, x_at, own_at = values.flatten(), values.offsets.to_numpy(), own.offsets.to_numpy()
        x_base, own_base = int(x_at[0]), int(own_at[0])

        def side(strength: np.ndarray) -> pa.Array:
            slot = np.argsort(-strength, axis=1, kind="stable")[:, :n]
            row, rank = np.nonzero(np.take_along_axis(strength, slot, axis=1) > 0)
            slot = slot[row, rank]
            encoded = x.take(pa.array(x_at[row] - x_base + slot))
            on = pc.equal(encoded, 1.0)
            state = np.asarray(pc.fill_null(on, False)).astype(np.int64)
            at = pa.array(slot)
            columns = [
                pa.array(shown, pa.string()).take(pa.array(2 * slot + state)),
                column("model_feature").take(at),
                column("source_features", pa.list_(pa.string())).take(at),
                column("category").take(at),
                column("category").take(at),
                column("category_label").take(at),
                pc.if_else(pa.array(coded[slot], pa.bool_()), on, pa.scalar(None, pa.bool_())),
                own.flatten().take(pa.array(own_at[row] - own_base + place[slot])).cast(pa.string()),
                encoded,
                pa.array(matrix[row, slot], pa.float64()),
                pa.array(slot.astype(np.int32)),
            ]
            ends = np.searchsorted(row, np.arange(len(known) + 1)).astype(np.int32)
            columns = [c.cast(k.type) for c, k in zip(columns, kinds, strict=True)]
            items = pa.StructArray.from_arrays(columns, fields=kinds)
            return pa.ListArray.from_arrays(pa.array(ends), items, mask=pa.array(~known))

        return pa.StructArray.from_arrays([side(matrix), side(-matrix)], names=["up", "down"])

    lists = T.ArrayType(_FACTOR)
    return arrow_udf(kernel, T.StructType([T.StructField("up", lists), T.StructField("down", lists)]))


def with_top_factors(
    df: DataFrame,
    slots: Sequence[Slot],
    n: int,
    application: dict[str, Column],
    shap: str = "shap",
    values: str = "encoded_values",
) -> DataFrame:
    """Add the n strongest factors of each sign; the earlier column wins a tie.

    Batches of contributions are sorted as one matrix; the few picks are then
    described from the constant slot table and the application's own values.
    """
    if n < 1:
        raise ValueError("at least one factor must be asked for")
    own = F.array(*(application[f].cast("string") for f in _feature_spans(slots)))
    pick = _top_factors(_slot_table(df.sparkSession, slots), n)
    rows = df.withColumn("_top", pick(F.col(shap), F.col(values), own))
    return rows.withColumns(
        {"top_positive_factors": F.col("_top.up"), "top_negative_factors": F.col("_top.down")}
    ).drop("_top")
