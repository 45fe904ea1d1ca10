"""Numbers as Python reads and rounds them, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INT = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
_FLOAT = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"


def is_integer_text(c: Column) -> Column:
    return c.rlike(_INT)


def integer_value(c: Column) -> Column:
    """Whole number of a text, null if it is none or exceeds 64 bits."""
    return F.when(is_integer_text(c), F.replace(c, F.lit("_"), F.lit("")).try_cast("bigint"))


def float_value(c: Column) -> Column:
    """Double of a text incl. ``nan`` and ``inf``; null if it is no number. Java's suffixes (``1d``) are refused."""
    low = F.lower(c)
    # What the cast accepts is right but for its suffixes and hexadecimal forms; the pattern is for what it refuses.
    plain = F.right(c, F.lit(1)).between("0", "9") & ~F.contains(low, F.lit("x"))
    return (
        F.when(plain & c.try_cast("double").isNotNull() & ~F.contains(c, F.lit(" ")), c.try_cast("double"))
        .when(c.rlike(_FLOAT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))
        .when(low.rlike("^[+-]?nan$"), F.lit(float("nan")))
        .when(low.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(low.rlike("^-inf(inity)?$"), F.lit(float("-inf")))
    )


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def whole_double(v: Column) -> Column:
    """Integer of a double that has no fraction, else null."""
    return F.when(is_finite(v) & (v == F.floor(v)) & (F.abs(v) < 9e18), v.cast("bigint"))


def half_even(c: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.rint(c).cast("bigint")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def first_error(*rules: tuple[Column, Column | str]) -> Column:
    """Message of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in rules])


def general_format(c: Column, digits: int = 12) -> Column:
    """``%.<digits>g``: significant digits, trailing zeros stripped, exponent form outside 1e-4 .. 10^digits."""
    text = F.format_string(f"%.{digits - 1}e", c)
    exponent = F.regexp_extract(text, r"e([+-][0-9]+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(text, r"e[+-][0-9]+$", ""), r"\.?0+$", "")
    rounded = text.cast("decimal(38,18)").cast("string")
    fixed = F.regexp_replace(F.regexp_replace(rounded, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(mantissa, F.format_string("e%s%02d", F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent)))
    return F.when(c == 0, "0").when((exponent < -4) | (exponent >= digits), scientific).otherwise(fixed)


def fixed_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row.

    Projections are merged and filters pushed down by copying expressions; where each stage uses the one
    before several times, the copies multiply. A generator of one row stops that.
    """
    row = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], row)
