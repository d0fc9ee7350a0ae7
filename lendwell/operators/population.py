"""From raw register rows to the curated application table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import (
    clean_marker,
    col,
    is_bad_number,
    strict_number,
    target_of,
    to_number,
)
from lendwell.operators.ranking import first_by_hash, hash_order


def is_eligible(clean: bool = False) -> Column:
    """The six population conditions.

    With `clean` the codes are known to carry no blanks, and the plain
    comparisons reach the file scan as pushed filters.
    """
    code = col if clean else clean_marker
    return (
        (code("activity_year") == fv.POPULATION_YEAR)
        & code("action_taken").isin(*fv.APPROVED_ACTIONS, fv.DENIED_ACTION)
        & (code("reverse_mortgage") == fv.NO_FLAG)
        & (code(fv.OPEN_END) == fv.NO_FLAG)
        & (code("business_or_commercial_purpose") == fv.NO_FLAG)
        & code("total_units").isin(*fv.ELIGIBLE_UNITS)
    )


def eligible_population(register: DataFrame, clean: bool = False) -> DataFrame:
    return register.where(is_eligible(clean))


def normalize(register: DataFrame, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Curated columns of eligible rows: renamed, cleaned, typed, with the target.

    Text in a numeric column becomes null; `require_numbers` and `numeric_rejects`
    find it beforehand, and `strict` makes the task fail on it. Eligible rows have one of the mapped
    actions; other rows get a null target, which the table contract refuses.
    """
    columns = []
    eligible = is_eligible() if strict else None
    for name in (*fv.PREDICTORS, *fv.AUDIT_ONLY):
        source = fv.REGISTER_NAME.get(name, name)
        if name in fv.NUMERIC_COLUMNS:
            value = strict_number(source, name, eligible) if strict else to_number(source)
        else:
            value = clean_marker(source)
            if name in fv.NOT_REPORTED_CODE:
                value = F.nullif(value, F.lit(fv.NOT_REPORTED_CODE[name]))
        columns.append(value.alias(name))
    target = target_of("action_taken", "null").alias(fv.TARGET)
    return register.select(*keep, *columns, target)


def numeric_rejects(register: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Quarantine: every present value of a numeric column that is no number."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), col(c).alias("raw_value"), is_bad_number(c).alias("bad"))
        for c in columns
    ]
    return (
        register.select(key, F.inline(F.array(*cells)))
        .where("bad")
        .select(key, "column_name", "raw_value")
    )


REGISTER_NUMBERS = tuple(fv.REGISTER_NAME.get(c, c) for c in fv.NUMERIC_COLUMNS)


def require_numbers(register: DataFrame, columns: tuple[str, ...] = REGISTER_NUMBERS) -> None:
    """Raise where a numeric column of the register holds text; one aggregate."""
    bad = register.agg(*(F.count_if(is_bad_number(c)).alias(c) for c in columns)).first()
    found = {c: bad[c] for c in columns if bad[c]}
    if found:
        raise ValueError(f"values that are no numbers: {found}")


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = fv.SAMPLE_SEED) -> DataFrame:
    """Exactly `n` rows, each equally likely, the same for any partitioning.

    `key` must be unique. Fails where fewer than `n` rows exist.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    rows = df.withColumns({"_all": F.lit(1), "_h": hash_order(seed, F.col(key))})
    short = F.concat(F.lit(f"sample of {n} from only "), F.col("_total").cast("string"))
    quota = F.when(F.col("_total") < n, F.raise_error(short)).otherwise(F.lit(n))
    taken = first_by_hash(rows, "_all", "_h", key, quota, "_take").where("_take")
    return taken.drop("_all", "_h", "_take")


def population_stats(register: DataFrame) -> DataFrame:
    """Rows seen, eligible rows and eligible rows per target, in one pass."""
    ok = F.coalesce(is_eligible(), F.lit(False))
    target = target_of("action_taken", "null")
    return register.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(ok).alias("eligible_rows"),
        F.count_if(ok & (target == 0)).alias("eligible_denied"),
        F.count_if(ok & (target == 1)).alias("eligible_approved"),
    )
