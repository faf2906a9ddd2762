"""Column profiles of a stream, as an aggregate in update mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num, rnd
from sparkloom.operators.profile import value


def streaming_profile(df: DataFrame, names: list[str], time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """column, rows, missing, mean, std, min, max over all rows so far; or by event-time window, with a watermark.

    The state is a row a column (and open window).
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(df, c).isNull().alias("missing"), num(df, c).alias("x")) for c in names])
    if time:
        df = df.withWatermark(time, late)
    keys = [F.window(time, window).alias("window")] if time and window else []
    long = df.select(*[F.col(time)] if keys else [], F.explode(cells).alias("c")).select(*[F.col(time)] if keys else [], "c.*")
    return long.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("missing").cast("long")).alias("missing"), rnd(F.avg("x")).alias("mean"), rnd(F.stddev_samp("x")).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
