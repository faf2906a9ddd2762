"""Reproducible pseudo-random choices: rows in the order of md5(seed|id), the same on any partitioning.

Fixed-size choices use a limit (a bounded top-n in each task), splits by share a count and a running
count over ranges of the hash, so no order is made on one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.align import numbered
from sparkloom.session import cut


def digest(seed: int | str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def sample(df: DataFrame, most: int | None, rid: str, seed: int = 42) -> DataFrame:
    """At most ``most`` rows: those that come first by md5; all rows without a bound."""
    if most is None:
        return df
    return df.withColumn("__h", digest(seed, F.col(rid))).orderBy("__h", rid).limit(most).drop("__h")


def split(df: DataFrame, rid: str, share: float = 0.2, seed: int = 42, classes: str | None = None) -> DataFrame:
    """df with is_test: the first ceil(share * n) rows by md5, of each class if classes are given."""
    group = F.col(f"`{classes}`").cast("string") if classes else F.lit("")
    marked = df.withColumn("__g", group).withColumn("__h", digest(seed, F.col(rid)))
    placed = numbered(marked, ["__g", "__h", rid])
    told = cut(placed.groupBy(F.col("__g").alias("__k")).agg(F.count(F.lit(1)).alias("__n"), F.min("__rid").alias("__first")))
    joined = placed.join(told, F.col("__g").eqNullSafe(F.col("__k")))
    return joined.withColumn("is_test", F.col("__rid") - F.col("__first") < F.ceil(F.lit(share) * F.col("__n"))).drop("__g", "__h", "__n", "__first", "__k", "__rid")


def permute(df: DataFrame, column: str, rid: str, seed: int = 42) -> DataFrame:
    """df with perm_<column>: the column's values in the order of md5(seed|column|id)."""
    by_id = numbered(df, [rid])
    shuffled = numbered(df.select(F.col(column).alias(f"perm_{column}"), digest(seed, F.lit(column), F.col(rid)).alias("__h"), F.col(rid).alias("__r")), ["__h", "__r"])
    return by_id.join(shuffled.drop("__h", "__r"), "__rid").drop("__rid")


def permute_bounded(df: DataFrame, column: str, rid: str, seed: int = 42) -> DataFrame:
    """id, perm_<column> by the same order, through windows: for rows that a fold or a cap bounds."""
    by_id = df.select(rid, F.row_number().over(Window.orderBy(rid)).alias("__k"))
    shuffled = df.select(F.col(column).alias(f"perm_{column}"), F.row_number().over(Window.orderBy(digest(seed, F.lit(column), F.col(rid)), rid)).alias("__k"))
    return by_id.join(shuffled, "__k").drop("__k")


def permuted_places(ids: Iterable, column: str, seed: int = 42) -> np.ndarray:
    """permute() for rows in memory, in the order of their ids: the place from which each row gets its value."""
    digests = b"".join(hashlib.md5(f"{seed}|{column}|{x}".encode()).digest() for x in ids)
    high, low = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64).T
    return np.lexsort((low, high))


def resamples(df: DataFrame, rid: str, n: int, times: int, seed: int = 42, share: float = 0.7, least: int = 20) -> DataFrame:
    """resample, id: for each resample the first max(least, floor(share * n)) rows by md5(seed|resample|id). n: rows of df, bounded by the caller."""
    size = min(n, max(least, math.floor(share * n)))
    spread = df.select(rid, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("resample")).withColumn("__h", digest(seed, F.col("resample"), F.col(rid)))
    order = Window.partitionBy("resample").orderBy("__h", rid)
    return spread.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= size).select("resample", rid)
