"""Table sources: CSV and Parquet scans, row limits, the time column."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = (".csv", ".parquet")
TIME = "Date"
#: What a CSV cell may say for missing.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>")


def check_path(path: str) -> str:
    """The suffix; other than .csv and .parquet raises ValueError."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported input format {suffix or path!r}; expected one of {', '.join(SUFFIXES)}")
    return suffix


def positive(text: str | int) -> int:
    """A row limit: a positive integer."""
    n = int(text)
    if n <= 0:
        raise ValueError("must be a positive integer")
    return n


def read_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A CSV (header, types inferred) or Parquet table; ``limit`` first rows; a column Date as timestamp."""
    if check_path(path) == ".csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        for name, kind in df.dtypes:
            if kind == "string":
                c = F.col(f"`{name}`")
                df = df.withColumn(name, F.when(~F.trim(c).isin(*MISSING), c))
    else:
        df = spark.read.parquet(path)
    if limit is not None:
        df = df.limit(positive(limit))
    return parse_time(df)


def parse_time(df: DataFrame, name: str = TIME) -> DataFrame:
    """What can't be read as a time is null."""
    if name not in df.columns or isinstance(df.schema[name].dataType, T.TimestampType):
        return df
    return df.withColumn(name, F.try_to_timestamp(F.col(name).cast("string")))


def first_rows(df: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first rows by a stated order: tables have none of their own."""
    return df.orderBy(*order).limit(positive(limit))
