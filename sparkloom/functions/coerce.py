"""Numeric coercion, rounding and null-safe statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number in a string; rejects suffixes, hexadecimal, separators and words such as inf.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when((c > float("-inf")) & (c < float("inf")), c)


def num(df: DataFrame, name: str) -> Column:
    """A column as double; what isn't a finite number is null. Times, dates and nested types have no numeric value."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        text = F.trim(c)
        return finite(F.when(text.rlike(NUMBER), text.try_cast("double")))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return finite(c.cast("double"))
    return F.lit(None).cast("double")


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(finite(c), digits)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are there; null if either is constant (corr() would raise)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), r)


def skew(c: Column) -> Column:
    """Bias-adjusted skewness; null below 3 values, 0 without variance."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.when(F.min(c) == F.max(c), 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)))


def kurt(c: Column) -> Column:
    """Unbiased excess kurtosis; null below 4 values, 0 without variance."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, F.when(F.min(c) == F.max(c), 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)))


def role(df: DataFrame, name: str) -> str:
    """datetime or other, by type alone; numeric or categorical needs values."""
    return "datetime" if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)) else "other"


DTYPES = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32", "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]"}


def dtype_name(df: DataFrame, name: str) -> str:
    return DTYPES.get(df.schema[name].dataType.simpleString(), "object")
