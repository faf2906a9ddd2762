"""Exact deduplication by a heavy-hitter split. DataFrame operations only.

A frequent-items sketch of the Misra-Gries family (``approx_top_k_*``, built per partition, merged in
two levels) names digests that may be frequent. Their exact counts and winners are verified by a
partially aggregated pass, and these at most ``candidates`` rows are broadcast, so that rows of a hot
group are settled where they are read. What remains has no group above about 1/300 of the rows and
takes the ordinary shuffle.

Defined results: null text counts as empty; texts are equal byte for byte; the row with the largest
id stays (null ids are smallest), and of ties between rows the one that is read last; of repeated rows with
the same id and text exactly one stays; very long texts are hashed where they are read; an empty table
gives an empty result; other columns of the input, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Counters of the sketch, and how many of its items are verified and broadcast at most.
TRACKED, CANDIDATES, FAN_IN = 1024, 256, 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (hex)."""
    rows = cut(
        docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id())
    )  # the row numbers are fixed by the checkpoint
    top = (F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("size"))
    sketches = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("part").agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("s"))
    likely = (
        sketches.groupBy(F.pmod("part", F.lit(1))).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))  # grouped, as the function can't merge the empty state of a partition without rows
        .select(F.explode(F.expr(f"approx_top_k_estimate(s, {candidates})")).alias("x"))
        .where("x.count > 1").select(F.col("x.item").alias("digest"))
    )
    winners = cut(rows.join(F.broadcast(likely), "digest", "left_semi").groupBy("digest").agg(*top).where("size > 1"))
    told = rows.join(F.broadcast(winners), "digest", "left")
    rest = told.where("top is null").select("id", "digest", "row")
    groups = rest.groupBy("digest").agg(*top).where("size > 1")
    found = told.where("top is not null").unionByName(rest.join(groups, "digest", "left"))
    return found.select(
        F.col("id").alias(id_col), F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("top").isNull() | (F.col("top.row") == F.col("row"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )
