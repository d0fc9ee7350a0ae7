"""Imputation, scaling and one-hot encoding, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import col
from lendwell.operators.features import FeatureEngineer, feature_columns
from lendwell.operators.ranking import exact_percentiles


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact interpolated median per column; columns without values are absent."""
    return exact_percentiles(df, columns, [0.5]).select(
        F.col("column").alias("column_name"), F.col("value").alias("fill_value")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value"))
        for c in columns
    ]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column_name").agg(F.max("n").alias("n"))
    return (
        counts.join(best, ["column_name", "n"])
        .groupBy("column_name")
        .agg(F.min("value").alias("fill_value"))
    )


def scale_parameters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column; a zero deviation scales by one."""
    seen = df.agg(
        *(
            F.struct(F.avg(col(c)).alias("mean"), F.stddev_pop(col(c)).alias("std")).alias(c)
            for c in columns
        )
    )
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"`{c}`.mean").alias("mean"),
            F.when(F.col(f"`{c}`.std") == 0, 1.0).otherwise(F.col(f"`{c}`.std")).alias("std"),
        )
        for c in columns
    ]
    return seen.select(F.inline(F.array(*cells)))


def standardize(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, with parameters from `train`."""
    p = {r["column_name"]: r for r in scale_parameters(train, columns).collect()}
    return df.withColumns({c: (col(c) - p[c]["mean"]) / p[c]["std"] for c in columns})


class ValueImputer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median for numeric columns and mode for text columns."""

    numericCols = Param(Params._dummy(), "numericCols", "filled by median", TypeConverters.toListString)
    textCols = Param(Params._dummy(), "textCols", "filled by mode", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numericCols: Sequence[str] = (), textCols: Sequence[str] = ()):
        super().__init__()
        self._set(numericCols=list(numericCols), textCols=list(textCols))

    def _fit(self, dataset: DataFrame) -> ValueImputerModel:
        numeric = self.getOrDefault(self.numericCols)
        text = self.getOrDefault(self.textCols)
        number = {r[0]: r[1] for r in medians(dataset, numeric).collect()} if numeric else {}
        value = {r[0]: r[1] for r in modes(dataset, text).collect()} if text else {}
        empty = [c for c in (*numeric, *text) if c not in number and c not in value]
        if empty:
            raise ValueError(f"columns without any training value: {empty}")
        return ValueImputerModel(
            numericCols=numeric,
            numericValues=[number[c] for c in numeric],
            textCols=text,
            textValues=[value[c] for c in text],
        )


class ValueImputerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    numericCols = Param(Params._dummy(), "numericCols", "", TypeConverters.toListString)
    numericValues = Param(Params._dummy(), "numericValues", "", TypeConverters.toListFloat)
    textCols = Param(Params._dummy(), "textCols", "", TypeConverters.toListString)
    textValues = Param(Params._dummy(), "textValues", "", TypeConverters.toListString)

    @keyword_only
    def __init__(
        self,
        *,
        numericCols: Sequence[str] = (),
        numericValues: Sequence[float] = (),
        textCols: Sequence[str] = (),
        textValues: Sequence[str] = (),
    ):
        super().__init__()
        self._set(
            numericCols=list(numericCols),
            numericValues=list(numericValues),
            textCols=list(textCols),
            textValues=list(textValues),
        )

    def fill_values(self) -> dict[str, float | str]:
        get = self.getOrDefault
        return dict(zip(get(self.numericCols), get(self.numericValues))) | dict(
            zip(get(self.textCols), get(self.textValues))
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {c: F.coalesce(col(c), F.lit(v)) for c, v in self.fill_values().items()}
        )


class ClassNames(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Carries the names of the classes, in the order of their label numbers, in a
    saved pipeline; rows pass unchanged."""

    classes = Param(Params._dummy(), "classes", "class names by label", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, classes: Sequence[str] = ()):
        super().__init__()
        self._set(classes=list(classes))

    def names(self) -> list[str]:
        return self.getOrDefault(self.classes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset


def encoder_stages(
    numeric: Sequence[str], text: Sequence[str], output: str = "encoded", drop_first: bool = False
) -> list:
    """Imputer, indexer, one-hot and assembler; unseen categories become all zeros.

    The indexer's extra slot for unseen values is the last one, and the one-hot
    step drops the last slot. With `drop_first` see `dummies_drop_first`.
    """
    index = StringIndexer(
        inputCols=list(text),
        outputCols=[f"{c}__index" for c in text],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    one_hot = OneHotEncoder(
        inputCols=[f"{c}__index" for c in text],
        outputCols=[f"{c}__onehot" for c in text],
        dropLast=True,
    )
    assemble = VectorAssembler(
        inputCols=[*numeric, *(f"{c}__onehot" for c in text)], outputCol=output
    )
    return [ValueImputer(numericCols=list(numeric), textCols=list(text)), index, one_hot, assemble]


def encoder_pipeline(config: str = "full", keep: Sequence[str] = (), estimator=None) -> Pipeline:
    """Feature engineering, encoding and an injected estimator."""
    numeric, text = feature_columns(config)
    stages = [FeatureEngineer(keepCols=list(keep)), *encoder_stages(numeric, text)]
    if estimator is not None:
        if not hasattr(estimator, "fit"):
            raise TypeError("a pyspark.ml estimator is needed")
        stages.append(estimator)
    return Pipeline(stages=stages)


def narrowed(model: PipelineModel, config: str) -> list:
    """Stages that encode a configuration by the fitted steps of a wider one: every column
    is imputed and indexed by itself, so no row is read again. Other columns aren't assembled."""
    numeric, text = feature_columns(config)
    imputer = next(s for s in model.stages if isinstance(s, ValueImputerModel))
    indexer = next(s for s in model.stages if type(s).__name__ == "StringIndexerModel")
    return [imputer, indexer, *encoder_stages(numeric, text)[2:]]


def v1_pipeline(estimator=None) -> Pipeline:
    """First-generation encoding of the nine raw predictors (negatives are invalidated before)."""
    numeric = (*fv.V1_INVALIDABLE, *fv.V1_NUMERIC)
    stages = encoder_stages(numeric, fv.V1_CATEGORICAL)
    return Pipeline(stages=stages if estimator is None else [*stages, estimator])


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct categories per column with their position from 0."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("category"))
        for c in columns
    ]
    found = (
        df.select(F.inline(F.array(*cells))).where(F.col("category").isNotNull()).distinct()
    )
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("category")) - 1
    return found.withColumn("position", place)


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The ones of the one-hot matrix: (key, feature, encoded column name)."""
    cells = [
        F.struct(F.lit(c).alias("model_feature"), col(c).cast("string").alias("category"))
        for c in columns
    ]
    return (
        df.select(key, F.inline(F.array(*cells)))
        .where(F.col("category").isNotNull())
        .select(
            key,
            "model_feature",
            F.concat_ws("_", "model_feature", "category").alias("encoded_name"),
        )
    )


def dummies_drop_first(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One 0/1 column per category but the first of each column."""
    words: dict[str, list[str]] = {c: [] for c in columns}
    for r in vocabulary(df, columns).orderBy("column_name", "position").collect():
        words[r["column_name"]].append(r["category"])
    dummies = [
        F.coalesce((col(c).cast("string") == w).cast("int"), F.lit(0)).alias(f"{c}_{w}")
        for c in columns
        for w in words[c][1:]
    ]
    return df.select(key, *dummies)


def encoded_names(model: PipelineModel, config: str = "full") -> list[tuple[str, str, str | None]]:
    """(encoded name, feature, category) of every slot of the encoded vector, in order."""
    numeric, text = feature_columns(config)
    indexer = next(s for s in model.stages if type(s).__name__ == "StringIndexerModel")
    labels = dict(zip(indexer.getInputCols(), indexer.labelsArray))
    names: list[tuple[str, str, str | None]] = [(c, c, None) for c in numeric]
    for c in text:
        names += [(f"{c}_{w}", c, w) for w in labels[c]]
    return names
