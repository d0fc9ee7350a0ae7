"""Missing markers, codes and numbers of a raw register, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendwell import fixed_values as fv

# Every character str.strip() removes.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# One number, blanks around it allowed; group 1 is the number.
NUMBER = r"(?U)^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"

INFINITY = float("inf")


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def _found(c: Column | str, pattern: str) -> Column:
    """Group 1 of a pattern, null where it does not match; the input is used once.

    Long cleaning chains stay small in generated code this way. Names take the
    SQL form, which spares the many calls of building it piece by piece.
    """
    if isinstance(c, str):
        return F.expr(f"nullif(regexp_extract(`{c}`, r'{pattern}', 1), '')")
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def clean_marker(c: Column | str) -> Column:
    """Stripped text, or null where it is one of the missing markers."""
    text = strip(c)
    return F.when(~F.upper(text).isin(*fv.MISSING_MARKERS), text)


def finite(c: Column) -> Column:
    """Null for NaN and infinities, so comparisons behave like SQL."""
    number = F.nullif(F.nullif(c, F.lit(INFINITY)), F.lit(-INFINITY))
    return F.nullif(number, F.lit(float("nan")))


def to_number(c: Column | str) -> Column:
    """A finite double from text, or null; never raises."""
    number = _found(c, NUMBER).try_cast("double")
    return F.nullif(F.nullif(number, F.lit(INFINITY)), F.lit(-INFINITY))


def number_of(c: Column | str, dtype: str) -> Column:
    """`to_number` for text columns, `finite` for columns that are numeric already."""
    return to_number(c) if dtype == "string" else finite(col(c).cast("double"))


def is_bad_number(c: Column | str) -> Column:
    """True where a value is present but is no number."""
    return clean_marker(c).isNotNull() & to_number(c).isNull()


def strict_number(c: Column | str, name: str, where: Column) -> Column:
    """Number, or null for a missing marker; the task fails on anything else.

    The failure is tied to `where`, because the optimizer may evaluate the
    expression before a filter that stands in front of it.
    """
    wrong = F.raise_error(F.concat(F.lit(f"{name}: not a number: "), col(c))).cast("double")
    return F.coalesce(to_number(c), F.when(clean_marker(c).isNotNull() & where, wrong))


def target_of(action: Column | str, on_other: str = "raise") -> Column:
    """1 for the approved actions, 0 for a denial; other codes raise or become null."""
    code = clean_marker(action)
    target = F.when(code.isin(*fv.APPROVED_ACTIONS), F.lit(1)).when(
        code == fv.DENIED_ACTION, F.lit(0)
    )
    if on_other == "raise":
        shown = F.coalesce(col(action), F.lit("null"))
        target = target.otherwise(
            F.raise_error(F.concat(F.lit("action outside the binary target: "), shown)).cast("int")
        )
    return target.cast("tinyint")


def plain_code(c: Column | str) -> Column:
    """One spelling per code: integral numbers lose their fraction, `1.0` -> `1`."""
    text = strip(col(c).cast("string"))
    value = to_number(text)
    integral = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(integral, value.cast("bigint").cast("string")).otherwise(text)


# An integer with optional sign, leading zeros and zero fraction.
INTEGRAL = r"^\s*\+?(-?)0*([0-9]+?)(?:\.0*)?\s*$"


def category(c: Column | str) -> Column:
    """`plain_code` for ordinary code columns, as one replacement per value.

    Exponents are left as they are.
    """
    if isinstance(c, str):
        return F.expr(f"regexp_replace(string(`{c}`), r'{INTEGRAL}', '$1$2')")
    return F.regexp_replace(c.cast("string"), INTEGRAL, "$1$2")
