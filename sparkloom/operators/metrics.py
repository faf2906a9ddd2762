"""Metrics of predictions and clusterings, from small grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.coerce import rnd


def regression_metrics(df: DataFrame, actual: Column, predicted: Column, group: list[str] = []) -> DataFrame:  # noqa: B006
    """group, r2, mae, rmse, samples."""
    e = actual - predicted
    return df.groupBy(*group).agg(
        rnd(1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(actual))).alias("r2"), rnd(F.avg(F.abs(e))).alias("mae"), rnd(F.sqrt(F.avg(e * e))).alias("rmse"), F.count(e).alias("samples"),
    )


def classification_metrics(df: DataFrame, actual: Column, predicted: Column, group: list[str] = []) -> DataFrame:  # noqa: B006
    """group, accuracy, balanced_accuracy (mean recall of the classes that occur), f1_weighted, samples; from the confusion counts."""
    counts = df.select(*group, actual.cast("string").alias("a"), predicted.cast("string").alias("p")).where("a is not null").groupBy(*group, "a", "p").agg(F.count(F.lit(1)).alias("n"))
    actuals = counts.groupBy(*group, F.col("a").alias("class")).agg(F.sum("n").alias("na"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    guesses = counts.where("p is not null").groupBy(*group, F.col("p").alias("class")).agg(F.sum("n").alias("np"))
    by = actuals.join(guesses, [*group, "class"], "left").withColumn("np", F.coalesce("np", F.lit(0)))
    total = F.sum("na")
    return by.groupBy(*group).agg(
        rnd(F.sum("hit") / total).alias("accuracy"), rnd(F.avg(F.col("hit") / F.col("na"))).alias("balanced_accuracy"), rnd(F.sum(F.col("na") * 2 * F.col("hit") / (F.col("na") + F.col("np"))) / total).alias("f1_weighted"), total.alias("samples"),
    )


def agreement(df: DataFrame, cluster: Column, label: Column, group: list[str] = []) -> DataFrame:  # noqa: B006
    """group, adjusted_rand, normalized_mutual_info, homogeneity, completeness, v_measure, samples; from the contingency counts."""
    counts = df.select(*group, cluster.cast("string").alias("c"), label.cast("string").alias("l")).where("c is not null and l is not null").groupBy(*group, "c", "l").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    pairs, log = n * (n - 1) / 2, n * F.log(n)
    one = lambda c: counts.groupBy(*group, c).agg(F.sum("n").alias("n")).groupBy(*group).agg(F.sum(pairs).alias(f"{c}_pairs"), F.sum(log).alias(f"{c}_log"), F.sum("n").alias(f"{c}_n"))
    cells = counts.groupBy(*group).agg(F.sum(pairs).alias("pairs"), F.sum(log).alias("log"))
    joined = one("c").join(one("l"), group).join(cells, group) if group else one("c").crossJoin(one("l")).crossJoin(cells)  # one row each
    t = F.col("c_n").cast("double")
    hc, hl = F.log(t) - F.col("c_log") / t, F.log(t) - F.col("l_log") / t
    mi = F.log(t) + (F.col("log") - F.col("c_log") - F.col("l_log")) / t
    expected = F.try_divide(F.col("c_pairs") * F.col("l_pairs"), t * (t - 1) / 2)
    half = (F.col("c_pairs") + F.col("l_pairs")) / 2
    hom, com = F.when(hl > 1e-15, mi / hl).otherwise(1.0), F.when(hc > 1e-15, mi / hc).otherwise(1.0)
    return joined.select(
        *group, rnd(F.when(half == expected, 1.0).otherwise(F.try_divide(F.col("pairs") - expected, half - expected))).alias("adjusted_rand"),
        rnd(F.when(hc + hl > 1e-15, 2 * mi / (hc + hl)).otherwise(1.0)).alias("normalized_mutual_info"), rnd(hom).alias("homogeneity"), rnd(com).alias("completeness"),
        rnd(F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0)).alias("v_measure"), F.col("c_n").alias("samples"),
    )


def cluster_labels(df: DataFrame, cluster: Column, label: Column, group: list[str] = []) -> DataFrame:  # noqa: B006
    """group, cluster, label_value, count, cluster_pct."""
    counts = df.select(*group, cluster.alias("cluster"), label.cast("string").alias("label_value")).groupBy(*group, "cluster", "label_value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*group, "cluster").agg(F.sum("count").alias("held"))
    return counts.join(totals, [*group, "cluster"]).select(*group, "cluster", "label_value", "count", rnd(F.col("count") * 100.0 / F.col("held")).alias("cluster_pct"))


def silhouette(df: DataFrame, rid: str, coordinates: list[str], cluster: str, most: int = 20_000) -> DataFrame:
    """silhouette (euclidean) of a bounded sample, over all its pairs; null with one cluster, or as many as rows. More than ``most`` rows raise ValueError."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"the silhouette of more than {most} rows needs a sample")
    row = F.struct(rid, cluster, *coordinates)
    points = df.select(row.alias("a"))
    far = F.sqrt(sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in coordinates), F.lit(0.0)))
    blocks = df.agg(F.collect_list(row).alias("bs"))  # the sample, a row, broadcast to its points
    by = points.join(F.broadcast(blocks)).select("a", F.explode("bs").alias("b")).groupBy(F.col(f"a.{rid}").alias("id"), F.col(f"a.{cluster}").alias("own"), F.col(f"b.{cluster}").alias("other")).agg(F.sum(far).alias("d"), F.count(F.lit(1)).alias("n"))
    near = by.groupBy("id", "own").agg(F.max(F.when(F.col("own") == F.col("other"), F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1)))).alias("inner"), F.min(F.when(F.col("own") != F.col("other"), F.col("d") / F.col("n"))).alias("outer"))
    s = F.when(F.col("inner").isNull(), 0.0).otherwise(F.try_divide(F.col("outer") - F.col("inner"), F.greatest("outer", "inner")))
    told = near.agg(F.avg(s).alias("s"), F.count_distinct("own").alias("k"), F.count(F.lit(1)).alias("n"))
    return told.select(rnd(F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.col("s"))).alias("silhouette"))
