"""Underwriting features of one application, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import category, finite, plain_code


def dti_band(text: Column, value: Column) -> Column:
    """Published band of a debt-to-income value: by its text, else by its number.

    Both inputs are used several times, so give columns, not long expressions.
    """
    band = None
    for published, name in fv.DTI_BANDS.items():
        hit = text == published
        band = F.when(hit, name) if band is None else band.when(hit, name)
    for edge, name in fv.DTI_EDGES:
        band = band.when(value < edge, name)
    edge, name = fv.DTI_CLOSED_EDGE
    return band.when(value <= edge, name).when(value > edge, fv.DTI_ABOVE)


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den where the denominator is positive and the result finite, else null."""
    return finite(F.when(den > 0, num / den))


def flag_value(c: Column | str) -> Column:
    """Yes/no code as 1/0; other codes are unknown."""
    values = F.create_map(F.lit("1"), F.lit(1.0), F.lit("2"), F.lit(0.0))
    return F.element_at(values, category(c))


def code_label(feature: str, c: Column | str) -> Column:
    """Official label of a code; null for features without a code list."""
    labels = fv.CODE_LABEL.get(feature)
    if labels is None:
        return F.lit(None).cast("string")
    return F.coalesce(lookup(labels, plain_code(c)), F.lit(fv.UNKNOWN_LABEL))


def code_label_by(feature: Column, code: Column) -> Column:
    """`code_label` with the feature name in a column: one lookup for all features,
    so that the code's plain spelling is worked out once and not in a branch for each."""
    known = {f"{name}={c}": label for name, labels in fv.CODE_LABEL.items() for c, label in labels.items()}
    found = lookup(known, F.concat(feature, F.lit("="), plain_code(code)))
    return F.coalesce(found, lookup(dict.fromkeys(fv.CODE_LABEL, fv.UNKNOWN_LABEL), feature))


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null where the key is absent."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def prediction_label(prediction: Column) -> Column:
    return F.when(prediction == 1, fv.APPROVED_LABEL).otherwise(fv.DENIED_LABEL)
