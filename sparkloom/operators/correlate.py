"""Feature by label relations: pairs, Pearson and Spearman, correlation matrices."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num, rnd, safe_corr
from sparkloom.session import cut, spread_join

#: Pairs that one aggregate computes; more take further passes over the columns.
WIDE = 400


def pair_corr(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """feature, label, r, samples of complete pairs; wide form: one row a pair from one aggregate, without a shuffle of data."""
    out = None
    for chunk in itertools.batched(pairs, WIDE):
        cells = []
        for i, (a, b) in enumerate(chunk):
            x, y = num(df, a), num(df, b)
            cells += [safe_corr(x, y).alias(f"r{i}"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{i}")]
        once = df.agg(*cells)
        rows = F.array(*[F.struct(F.lit(a).alias("feature"), F.lit(b).alias("label"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("samples")) for i, (a, b) in enumerate(chunk)])
        part = once.select(F.explode(rows).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "feature string, label string, r double, samples long")


def correlations(df: DataFrame, features: list[str], labels: list[str], digits: int = 6) -> DataFrame:
    """feature, label, pearson_correlation, abs_correlation, samples; strongest first."""
    found = pair_corr(df, [(f, y) for f in features for y in labels]).where((F.col("samples") >= 2) & F.col("r").isNotNull())
    return found.select("feature", "label", rnd(F.col("r"), digits).alias("pearson_correlation"), rnd(F.abs("r"), digits).alias("abs_correlation"), "samples").orderBy(F.desc("abs_correlation"), F.desc("samples"), "feature", "label")


def correlation_matrix(df: DataFrame, names: list[str], most: int = 80, digits: int = 6) -> DataFrame:
    """column_1, column_2, correlation over complete pairs, 0 if there is none; both halves and the diagonal."""
    names = names[:most]
    found = pair_corr(df, list(itertools.combinations_with_replacement(names, 2))).select(F.col("feature").alias("column_1"), F.col("label").alias("column_2"), F.coalesce(rnd(F.col("r"), digits), F.lit(0.0)).alias("correlation"))
    return found.unionByName(found.where("column_1 <> column_2").select(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"), "correlation"))


def long_pairs(df: DataFrame, features: list[str], labels: list[str], keys: list[str] = [], numeric_label: bool = True) -> DataFrame:  # noqa: B006
    """keys (names), feature, label, x, y (double, or string): a row a complete pair."""
    fs = F.array(*[F.struct(F.lit(c).alias("feature"), num(df, c).alias("x")) for c in features])
    ls = F.array(*[F.struct(F.lit(c).alias("label"), (num(df, c) if numeric_label else F.col(f"`{c}`").cast("string")).alias("y")) for c in labels])
    spread = df.select(*keys, F.explode(fs).alias("f"), ls.alias("ls")).where("f.x is not null").select(*keys, "f.*", F.explode("ls").alias("l"))
    return spread.where("l.y is not null").select(*keys, "feature", "x", "l.*")


def running_count(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """counts: group, order, n (one row a value). Adds before: the rows of the group with a smaller value.

    Values are dealt by range, so a large group is many tasks' work; what the tasks hold of each group is a
    small table, summed in order.
    """
    keys = [F.col(c) for c in (*group, order)]
    parts = cut(counts.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy(*group, "part").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.withColumn("shift", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    here = Window.partitionBy(*group, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("local", F.coalesce(F.sum("n").over(here), F.lit(0)))
    return local.join(shift, [*group, "part"]).withColumn("before", F.col("local") + F.col("shift")).drop("local", "shift", "part")


def average_ranks(rows: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """Adds the average rank of ``column`` in its group (ties share the mean of their places). Ranks of frequent values are broadcast."""
    counts = rows.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
    ranks = cut(running_count(counts, group, column).select(*group, column, "n", (F.col("before") + (F.col("n") + 1) / 2).alias(out)))
    total = ranks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return spread_join(rows, ranks, [*group, column], total)


def spearman(pairs: DataFrame, group: list[str]) -> DataFrame:
    """group, rho, samples over rows with x and y; average ranks within the group."""
    ranked = average_ranks(average_ranks(pairs, group, "x", "rx"), group, "y", "ry")
    return ranked.groupBy(*group).agg(safe_corr(F.col("rx"), F.col("ry")).alias("rho"), F.count(F.lit(1)).alias("samples"))


def windowed_ranks(rows: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """Average ranks by a window: for groups that are small by construction, such as folds."""
    w = Window.partitionBy(*group).orderBy(column)
    same = Window.partitionBy(*group, column)
    return rows.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)

