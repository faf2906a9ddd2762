"""Session helpers: shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set and the master is local."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"/tmp/sparkloom-{uuid.uuid4().hex}")
    return context.getConf().get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Keys that hold over 1 / HOT_SHARE of all rows are broadcast: fewer than HOT_SHARE rows.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, by_key: DataFrame, key: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with by_key, a stored table of one row a key, whose column n says how many of the ``total`` rows have it. Frequent keys are joined where the rows are, so none waits for one task. Column n goes."""
    hot = by_key.where(F.col("n") * HOT_SHARE > total).drop("n")
    near = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    rest = near.where("__hot is null").select(*rows.columns).join(by_key.where(F.col("n") * HOT_SHARE <= total).drop("n"), key, how)
    return near.where("__hot").drop("__hot").unionByName(rest)
