"""Column, table and application contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.text import quoted_list


def _contract_error(names: Sequence[str], expected: Sequence[str]) -> str | None:
    if len(names) != len(set(names)):
        return fv.MSG_DUPLICATE
    parts = []
    missing = sorted(set(expected) - set(names))
    unexpected = sorted(set(names) - set(expected))
    if missing:
        parts.append(f"{fv.MSG_MISSING}{missing}")
    if unexpected:
        parts.append(f"{fv.MSG_UNEXPECTED}{unexpected}")
    return "; ".join(parts) or None


def require_predictors(names: Sequence[str], expected: Sequence[str] = fv.PREDICTORS) -> None:
    """Exactly the allowed predictor columns, in any order."""
    error = _contract_error(list(names), expected)
    if error:
        raise ValueError(fv.MSG_CONTRACT + error)


def require_v1_training_columns(names: Sequence[str]) -> None:
    """First-generation training table: its predictors and one target column."""
    names = list(names)
    if names.count(fv.TARGET) != 1:
        raise ValueError(f"exactly one {fv.TARGET} column is required")
    require_predictors([n for n in names if n != fv.TARGET], fv.V1_PREDICTORS)


def select_predictors(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Allow-list projection to the 16 predictors."""
    missing = sorted(set(fv.PREDICTORS) - set(df.columns))
    if missing:
        raise ValueError(f"predictors are missing: {missing}")
    return df.select(*keep, *fv.PREDICTORS)


def target_report(df: DataFrame, target: str = fv.TARGET) -> DataFrame:
    """Null count and distinct classes of a target, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(target).isNull()).alias("nulls"),
        F.count_if(F.col(target) == 0).alias("zeros"),
        F.count_if(F.col(target) == 1).alias("ones"),
    )


def require_binary_target(df: DataFrame, target: str = fv.TARGET, both: bool = False) -> None:
    """No nulls and only 0/1; with `both`, each class must occur."""
    if target not in df.columns:
        raise ValueError(f"target {target} is missing")
    r = target_report(df, target).first()
    if r["nulls"] or r["zeros"] + r["ones"] != r["n"]:
        raise ValueError(f"{target} must be binary without nulls")
    if both and not (r["zeros"] and r["ones"]):
        raise ValueError(f"{target} must hold both classes")


def predictors_and_target(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predictors and a checked byte target; audit-only columns are gone."""
    require_binary_target(df)
    predictors = select_predictors(df, [*keep, fv.TARGET])
    return predictors.withColumn(fv.TARGET, F.col(fv.TARGET).cast("tinyint"))


def _check(rule: str, passed: Column, observed: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.cast("string").alias("observed"),
    )


def dataset_contract_report(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """One row per rule of the curated table: schema rules and one aggregate."""
    names = df.columns
    leaked = sorted(set(names) & set(fv.LEAKAGE_COLUMNS))
    target = F.col(fv.TARGET) if fv.TARGET in names else F.lit(None).cast("tinyint")
    seen = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(target.isNull()).alias("nulls"),
        F.count_if(target == 0).alias("zeros"),
        F.count_if(target == 1).alias("ones"),
    )
    n, zeros, ones = F.col("n"), F.col("zeros"), F.col("ones")
    wanted = n if expected_rows is None else F.lit(expected_rows)
    checks = [
        _check("unique_names", F.lit(len(names) == len(set(names))), F.lit(len(names))),
        _check("ordered_schema", F.lit(tuple(names) == fv.CURATED_COLUMNS), F.lit(len(names))),
        _check("row_count", n == wanted, n),
        _check("target_not_null", F.col("nulls") == 0, F.col("nulls")),
        _check(
            "target_binary",
            (zeros > 0) & (ones > 0) & (zeros + ones + F.col("nulls") == n),
            F.concat(zeros.cast("string"), F.lit("/"), ones.cast("string")),
        ),
        _check("no_leakage", F.lit(not leaked), F.lit(len(leaked))),
    ]
    return seen.select(F.inline(F.array(*checks)))


def require_dataset(df: DataFrame, expected_rows: int | None = None) -> None:
    """Raise on the first broken rule of `dataset_contract_report`."""
    broken = [r for r in dataset_contract_report(df, expected_rows).collect() if not r["passed"]]
    if broken:
        raise ValueError(
            "dataset contract: " + "; ".join(f"{r['rule']} ({r['observed']})" for r in broken)
        )


# --- applications as JSON text -------------------------------------------

_NUMBER_TYPES = ("DOUBLE", "FLOAT", "BIGINT", "DECIMAL")
_TEXT_COLUMNS = ("debt_to_income_ratio",)


def _value_type(variant: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))


def _value_parts(variant: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Type and text of every predictor, each looked up once, and the numbers that
    `_type_errors` needs: a text is cast by compiled code, a variant by an expression made for every value."""
    kinds = {f"_kind_{c}": _value_type(variant, c) for c in fv.PREDICTORS}
    texts = {f"_text_{c}": F.try_variant_get(variant, f"$.{c}", "string") for c in fv.PREDICTORS}
    numbers = {
        f"_number_{c}": F.col(f"_text_{c}").try_cast("double") for c in fv.PREDICTORS if c not in _TEXT_COLUMNS
    }
    return kinds | texts, numbers


def _type_errors() -> Column:
    """One message per predictor whose JSON type the request contract refuses."""
    checks = []
    for name in fv.PREDICTORS:
        kind, value = F.col(f"_kind_{name}"), F.col(f"_number_{name}")
        number = F.lit(False)
        for t in _NUMBER_TYPES:
            number = number | kind.startswith(t)
        if name in fv.NUMERIC_COLUMNS:
            finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
            ok = (number | (kind == "STRING")) & F.coalesce(finite, F.lit(False))
        elif name in _TEXT_COLUMNS:
            ok = number | (kind == "STRING")
        else:
            ok = (kind == "STRING") | (number & (value == F.floor(value)))
        bad = kind.isNotNull() & (kind != "VOID") & ~F.coalesce(ok, F.lit(False))
        checks.append(F.when(bad, F.lit(f"{name}: invalid value")))
    # Not array_compact: what a higher-order function holds is interpreted and not
    # compiled. Messages differ, so taking nulls away is all this does.
    return F.array_except(F.array(*checks), F.array(F.lit(None).cast("string")))


def validate_applications(df: DataFrame, json_col: str) -> DataFrame:
    """Add `errors` and `application`; invalid rows stay, with a null application.

    `errors` holds the forbidden-key, exact-key and value-type messages in that
    order. `application` is a struct of the 16 predictors as text.
    """
    variant = F.try_parse_json(F.col(json_col))
    keys = F.json_object_keys(F.col(json_col))
    # Only an object has keys, and only valid JSON is a variant.
    is_object = F.col("_v").isNotNull() & F.col("_keys").isNotNull()
    allowed = F.array(*(F.lit(c) for c in fv.PREDICTORS))
    protected = F.array(*(F.lit(c) for c in (*fv.AUDIT_ONLY, fv.TARGET)))
    rows = df.withColumns({"_v": variant, "_keys": keys}).withColumns(
        {
            "_object": is_object,
            "_forbidden": F.sort_array(F.array_intersect("_keys", protected)),
            "_missing": F.sort_array(F.array_except(allowed, F.col("_keys"))),
            "_extra": F.sort_array(F.array_except(F.col("_keys"), allowed)),
        }
    )
    parts, numbers = _value_parts(F.col("_v"))
    rows = rows.withColumns(parts).withColumns(numbers)

    def named(prefix: str, names: str) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(prefix), quoted_list(F.col(names))))

    repeated = F.size(F.array_distinct("_keys")) < F.size("_keys")
    named_keys = F.concat_ws("; ", named(fv.MSG_MISSING, "_missing"), named(fv.MSG_UNEXPECTED, "_extra"))
    contract = F.when(repeated, F.lit(fv.MSG_CONTRACT + fv.MSG_DUPLICATE)).when(
        F.length(named_keys) > 0, F.concat(F.lit(fv.MSG_CONTRACT), named_keys)
    )
    found = F.concat(
        F.array_compact(F.array(named(fv.MSG_FORBIDDEN, "_forbidden"), contract)),
        _type_errors(),
    )
    errors = F.when(F.col("_object"), found).otherwise(F.array(F.lit(fv.MSG_NOT_OBJECT)))
    fields = [F.col(f"_text_{c}").alias(c) for c in fv.PREDICTORS]
    return (
        rows.withColumn("errors", errors)
        .withColumn("application", F.when(F.size("errors") == 0, F.struct(*fields)))
        .drop("_v", "_object", "_keys", "_forbidden", "_missing", "_extra", *parts, *numbers)
    )


def prediction_contract(df: DataFrame) -> DataFrame:
    """Violations of the output contract, one row per rule."""
    p, label, prediction = F.col("probability"), F.col("prediction_label"), F.col("prediction")
    labels = (fv.APPROVED_LABEL, fv.DENIED_LABEL)
    rules = {
        "probability_in_unit_interval": p.between(0.0, 1.0),
        "prediction_binary": prediction.isin(0, 1),
        "label_known": label.isin(*labels),
        "label_matches_prediction": (label == fv.APPROVED_LABEL) == (prediction == 1),
    }
    scored = prediction.isNotNull()
    seen = df.agg(
        *(
            F.count_if(scored & ~F.coalesce(rule, F.lit(False))).alias(name)
            for name, rule in rules.items()
        )
    )
    checks = [_check(name, F.col(name) == 0, F.col(name)) for name in rules]
    return seen.select(F.inline(F.array(*checks)))
