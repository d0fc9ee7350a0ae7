"""The 16 raw predictors to 20 model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import category, number_of, strip, to_number
from lendwell.functions.features import dti_band, flag_value, safe_ratio
from lendwell.operators.contracts import require_predictors


DTI_TEXT, DTI_NUMBER = "_dti_text", "_dti_number"


def with_parsed(df: DataFrame) -> DataFrame:
    """Parsed numbers as columns of their own, so each value is parsed once."""
    types = dict(df.dtypes)
    dti = F.col("debt_to_income_ratio").cast("string")
    parsed = {f"_{c}": number_of(c, types[c]) for c in fv.NUMERIC_COLUMNS}
    return df.withColumns({**parsed, DTI_TEXT: strip(dti), DTI_NUMBER: to_number(dti)})


def feature_expressions() -> dict[str, Column]:
    """Nine numeric and eleven categorical features of a frame from `with_parsed`."""
    number = {c: F.col(f"_{c}") for c in fv.NUMERIC_COLUMNS}
    annual = number["income"] * 1000.0
    numeric = {
        "income": number["income"],
        "loan_amount": number["loan_amount"],
        "combined_loan_to_value_ratio": number["combined_loan_to_value_ratio"],
        "property_value": number["property_value"],
        "loan_term_years": number["loan_term"] / 12.0,
        "loan_to_income": safe_ratio(number["loan_amount"], annual),
        "property_value_to_income": safe_ratio(number["property_value"], annual),
        "loan_to_property_value": safe_ratio(number["loan_amount"], number["property_value"]),
        "non_amortizing_feature_count": (
            flag_value("interest_only_payment") + flag_value("balloon_payment")
        ),
    }
    band = dti_band(F.col(DTI_TEXT), F.col(DTI_NUMBER))
    codes = {
        name: band if name == "dti_category" else category(name)
        for name in fv.FEATURE_CATEGORICAL
    }
    return {c: numeric[c] for c in fv.FEATURE_NUMERIC} | codes


def engineer(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 20 features of each row; projections only, no shuffle."""
    require_predictors([c for c in df.columns if c not in keep])
    features = feature_expressions()
    return with_parsed(df).select(*keep, *(c.alias(name) for name, c in features.items()))


def with_engineered(df: DataFrame, output: str = "engineered") -> DataFrame:
    """Add the 20 features as one struct beside the raw predictors."""
    features = F.struct(*(c.alias(name) for name, c in feature_expressions().items()))
    return with_parsed(df).select(*df.columns, features.alias(output))


CONFIGURATIONS = ("full", "without_workflow_features")


def feature_columns(config: str = "full") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Numeric and categorical feature names of a configuration."""
    if config not in CONFIGURATIONS:
        raise ValueError(f"unknown feature configuration: {config!r}")
    hidden = () if config == "full" else fv.WORKFLOW_FEATURES
    return (
        tuple(c for c in fv.FEATURE_NUMERIC if c not in hidden),
        tuple(c for c in fv.FEATURE_CATEGORICAL if c not in hidden),
    )


class FeatureEngineer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """`engineer` as a stateless pipeline stage; `keepCols` pass through."""

    keepCols = Param(Params._dummy(), "keepCols", "passed through", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, keepCols: Sequence[str] = ()):
        super().__init__()
        self._setDefault(keepCols=[])
        self._set(keepCols=list(keepCols))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = [c for c in self.getOrDefault(self.keepCols) if c in dataset.columns]
        return engineer(dataset, keep)
