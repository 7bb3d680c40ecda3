"""Forgiving casts and small numeric helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logrisk.config import FALSE_LABELS, TRUE_LABELS

RESOURCE = T.StructType([
    T.StructField("cpus", T.StringType()),
    T.StructField("memory", T.StringType()),
])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(_col(c).cast("string")).try_cast("double"), F.lit(default))


def safe_int(c, default: int = 0) -> Column:
    """Through double, cut toward zero."""
    number = F.trim(_col(c).cast("string")).try_cast("double")
    return F.coalesce(number.try_cast("int"), F.lit(default))


def number(df: DataFrame, name: str, kind: str = "double") -> Column:
    """A column as DOUBLE or INT, 0 where it holds no number.

    Text is cast leniently; columns that are numbers already skip the way through text.
    """
    if isinstance(df.schema[name].dataType, T.NumericType):
        zero = F.lit(0).cast(kind)
        return F.coalesce(F.col(name).try_cast(kind), zero)
    return safe_double(name) if kind == "double" else safe_int(name)


def label_flag(c) -> Column:
    """1, 0 or NULL for unknown text."""
    text = F.lower(F.trim(_col(c)))
    return F.when(text.isin(TRUE_LABELS), 1).when(text.isin(FALSE_LABELS), 0)


def resource_struct(c) -> Column:
    """`{'cpus': 1, 'memory': None}` as a struct; anything else gives NULL fields."""
    return F.from_json(F.regexp_replace(_col(c), r"\bNone\b", "null"), RESOURCE)


def clipped_ratio(value, scale) -> Column:
    """value/scale held inside [0, 1]; 0 for a scale that is not positive."""
    value = _col(value).cast("double")
    if not isinstance(scale, Column):
        if scale <= 0:
            return F.lit(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / F.lit(float(scale))))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / scale))
    return F.when(scale <= 0, F.lit(0.0)).otherwise(ratio)


def rounded(value, digits: int = 0) -> Column:
    """Decimal rounding of the exact binary value, exact ties to even.

    The product with 10^digits is itself rounded. Only if it lands on a half
    does its error matter, which is found by splitting the value in two parts
    whose products are exact.
    """
    x = _col(value).cast("double")
    scale = F.lit(float(10 ** digits))
    product = x * scale
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * scale - product) + (x - high) * scale
    at_half = F.abs(product - F.rint(product)) == 0.5
    corrected = F.when(at_half & (error != 0), product + F.signum(error) * F.lit(0.5))
    return corrected.otherwise(F.rint(product)) / scale


def share(count, total) -> Column:
    """count/total with a guard against no rows."""
    return _col(count) / F.greatest(_col(total), F.lit(1))


def rounded_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Rounds columns in place. They are plain references here, which keeps the
    expression small: it mentions its value several times."""
    return df.withColumns({name: rounded(F.col(name), n) for name, n in digits.items()})


def flag(condition: Column) -> Column:
    """0/1 as INT; NULL conditions count as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")
