"""Order-sensitive operators: positions, quantile cuts, bins, rolling means, regimes, walk-forward folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num, rnd, safe_corr
from sparkloom.operators.correlate import long_pairs, windowed_ranks
from sparkloom.session import cut

#: Walk-forward defaults: rows to train on at first, rows tested, step, folds at most; and the same within regimes.
WALK, REGIME_WALK = (100, 50, 50, 20), (50, 25, 25, 20)


def folds(n: int, train: int = WALK[0], test: int = WALK[1], step: int = WALK[2], most: int = WALK[3]) -> list[tuple[int, int, int, int]]:
    """(train_start, train_end, test_start, test_end) of expanding splits."""
    if min(train, test, step, most) <= 0:
        raise ValueError("walk-forward sizes must be positive integers")
    starts = range(train, max(train, n - test + 1), step)
    return [(0, s, s, s + test) for s in starts[:most]]


def fold_rows(params: tuple[int, int, int, int] = WALK) -> int:
    """Rows from the beginning that folds can touch."""
    train, test, step, most = params
    return train + step * (most - 1) + test


def first_in_order(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """pos from 0 of the first rows in order. A limit before the numbering: no more than ``rows`` go to one task."""
    head = df.orderBy(*order).limit(rows)
    return head.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def with_folds(df: DataFrame, n: int, params: tuple[int, int, int, int] = WALK) -> DataFrame:
    """A row for each fold that tests the row: fold from 0. df: pos."""
    made = folds(n, *params)
    if not made:
        return df.withColumn("fold", F.lit(0)).limit(0)
    table = df.sparkSession.createDataFrame([(i, f[2], f[3]) for i, f in enumerate(made)], "fold int, test_start int, test_end int")
    return df.join(F.broadcast(table), (F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end"))).drop("test_start", "test_end")


def fold_scores(df: DataFrame, features: list[str], labels: list[str], group: list[str] = ["fold"], least: int = 20) -> DataFrame:  # noqa: B006
    """group, feature, label, score_name (pearson_ic, rank_ic), score, samples. Folds are small, so ranks are windows."""
    pairs = long_pairs(df, features, labels, group)
    keys = [*group, "feature", "label"]
    ranked = windowed_ranks(windowed_ranks(pairs, keys, "x", "rx"), keys, "y", "ry")
    found = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), safe_corr(F.col("x"), F.col("y")).alias("pearson_ic"), safe_corr(F.col("rx"), F.col("ry")).alias("rank_ic"))
    long = found.where(F.col("samples") >= least).unpivot([*keys, "samples"], ["pearson_ic", "rank_ic"], "score_name", "score")
    return long.where("score is not null").select(*keys, "score_name", "score", "samples")


def information_coefficients(df: DataFrame, features: list[str], labels: list[str], order: list[str], params: tuple[int, int, int, int] = WALK, least: int = 20) -> DataFrame:
    """Fold scores of the walk-forward splits; a single fold over everything if there are too few rows for a split."""
    head = first_in_order(df, order, fold_rows(params))
    n = head.count()
    placed = with_folds(head, n, params) if folds(n, *params) else head.withColumn("fold", F.lit(0))
    return fold_scores(placed, features, labels, ["fold"], least)


def score_summary(scores: DataFrame, digits: int = 6) -> DataFrame:
    """feature, label, score_name, mean_score, mean_abs_score, score_std, valid_folds, positive_fold_ratio, samples; strongest first."""
    s = F.col("score")
    return scores.groupBy("feature", "label", "score_name").agg(
        rnd(F.avg(s), digits).alias("mean_score"), rnd(F.avg(F.abs(s)), digits).alias("mean_abs_score"), F.coalesce(rnd(F.stddev_samp(s), digits), F.lit(0.0)).alias("score_std"),
        F.count(s).alias("valid_folds"), rnd(F.avg((rnd(s) > 0).cast("double")), digits).alias("positive_fold_ratio"), F.sum("samples").alias("samples"),
    ).orderBy(F.desc("mean_abs_score"), F.desc("valid_folds"), "feature", "label", "score_name")


def combined_scores(summary: DataFrame) -> DataFrame:
    """feature, label, combined_score, mean_abs_score, component_count, valid_folds, samples: means of components, each divided by its largest of a label."""
    top = F.max("mean_abs_score").over(Window.partitionBy("label", "score_name"))
    scaled = summary.withColumn("part", F.when(top > 0, F.col("mean_abs_score") / top).otherwise(0.0))
    return scaled.groupBy("feature", "label").agg(
        rnd(F.avg("part")).alias("combined_score"), rnd(F.avg("mean_abs_score")).alias("mean_abs_score"), F.count_distinct("score_name").alias("component_count"), F.sum("valid_folds").alias("valid_folds"), F.sum("samples").alias("samples"),
    ).orderBy(F.desc("combined_score"), F.desc("component_count"), F.desc("valid_folds"), "feature", "label")


# Quantiles ------------------------------------------------------------------------------------


def edge_places(n: int, q: int) -> list[tuple[int, float]]:
    """(index, fraction) of the q + 1 linear quantile edges of n sorted values, with the rounding of the percentages kept."""
    out = []
    for k in range(q + 1):
        h = (n - 1) * ((k / q * 100) / 100)
        low = min(int(math.floor(h)), n - 1)
        out.append((low, h - low))
    return out


def quantile_edges(df: DataFrame, name: str, q: int) -> list[float]:
    """Distinct edges of the numeric values. Only the values at the places that edges need reach the driver."""
    from sparkloom.operators.correlate import running_count

    x = df.select(num(df, name).alias("x")).where("x is not null")
    n = x.count()
    if not n:
        return []
    places = edge_places(n, q)
    need = sorted({i for low, _ in places for i in (low, min(low + 1, n - 1))})
    counts = running_count(x.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0)), ["g"], "x")
    table = df.sparkSession.createDataFrame([(i,) for i in need], "i long")
    at = {r.i: r.x for r in counts.join(F.broadcast(table), (F.col("i") >= F.col("before")) & (F.col("i") < F.col("before") + F.col("n"))).select("i", "x").collect()}
    edges = []
    for low, t in places:
        a, b = at[low], at[min(low + 1, n - 1)]
        edges.append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return sorted(set(edges))


def bucket(x: Column, edges: list[float]) -> Column:
    """From 0; intervals are closed on the right, the lowest edge belongs to the first; null outside."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    above = sum(((x > F.lit(e)).cast("int") for e in edges[1:]), F.lit(0))
    return F.when((x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), F.least(above, F.lit(len(edges) - 2)))


def label_quantile_means(df: DataFrame, label: str, features: list[str], digits: int = 6) -> DataFrame:
    """label, bucket, lo, hi, feature, mean: feature means by quantile bucket (up to four) of a numeric label."""
    df = cut(df.select(f"`{label}`", *[f"`{f}`" for f in dict.fromkeys(features) if f != label]))  # read four times
    y = num(df, label)
    distinct = df.agg(F.count_distinct(y)).first()[0]
    edges = quantile_edges(df, label, min(4, distinct)) if distinct else []
    return _bucket_means(df, label, features, edges, digits)


def _bucket_means(df: DataFrame, label: str, features: list[str], edges: list[float], digits: int) -> DataFrame:
    cut_points = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    marked = df.select(bucket(num(df, label), edges).alias("bucket"), *[num(df, f).alias(f"f{i}") for i, f in enumerate(features)]).where("bucket is not null")
    means = marked.groupBy("bucket").agg(*[F.avg(f"f{i}").alias(f"f{i}") for i in range(len(features))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), rnd(F.col(f"f{i}"), digits).alias("mean")) for i, f in enumerate(features)])
    return means.select(F.lit(label).alias("label"), "bucket", rnd(F.get(cut_points, F.col("bucket")), digits).alias("lo"), rnd(F.get(cut_points, F.col("bucket") + 1), digits).alias("hi"), F.explode(rows).alias("x")).select("label", "bucket", "lo", "hi", "x.*")


def first_rank(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rank from 1 of the numeric values, ties by order; rows without value have none. Values are dealt by range."""
    from sparkloom.operators.align import numbered

    marked = df.withColumn("__x", num(df, name))
    placed = numbered(marked.where("__x is not null"), ["__x", *order]).withColumn("rank", F.col("__rid") + 1).drop("__rid", "__x")
    return placed.unionByName(marked.where("__x is null").drop("__x").withColumn("rank", F.lit(None).cast("long")))


def rank_bucket(rank: Column, n: int, q: int) -> Column:
    """Quantile bucket of ranks 1..n; edges by the same rule, of the values 1..n."""
    if n < 2:
        return F.when(rank.isNotNull(), 0)
    edges = [(low + 1) + t if t < 0.5 else (low + 2) - (1 - t) for low, t in edge_places(n, q)]
    return bucket(rank.cast("double"), sorted(set(edges)))


def quantile_bins(df: DataFrame, names: list[str], order: list[str], bins: int = 10) -> DataFrame:
    """df with b_<name> (smallint): bins of first ranks, 255 for missing; constant columns get none."""
    for c in names:
        told = df.agg(F.count(num(df, c)).alias("n"), F.count_distinct(num(df, c)).alias("d")).first()
        if told.d >= 2:
            df = first_rank(df, c, order).withColumn(f"b_{c}", F.coalesce(rank_bucket(F.col("rank"), told.n, min(bins, told.d)), F.lit(255)).cast("smallint")).drop("rank")
    return df


def purity(df: DataFrame, bins: dict[str, str], labels: list[str]) -> DataFrame:
    """feature, label, samples, score: how much the largest class's share in the bins exceeds its share overall, at least 0. bins: feature to bin column."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(y).alias("label"), F.col(b).alias("bin"), F.col(f"`{y}`").cast("string").alias("class")) for f, b in bins.items() for y in labels])
    counts = df.select(F.explode(cells).alias("c")).select("c.*").where("class is not null and bin <> 255").groupBy("feature", "label", "bin", "class").agg(F.count(F.lit(1)).alias("n"))
    by_bin = counts.groupBy("feature", "label", "bin").agg(F.sum("n").alias("held"), F.max("n").alias("top"))
    prior = counts.groupBy("feature", "label", "class").agg(F.sum("n").alias("n")).groupBy("feature", "label").agg((F.max("n") / F.sum("n")).alias("prior"))
    shares = by_bin.groupBy("feature", "label").agg(F.sum("held").alias("samples"), (F.sum("top") / F.sum("held")).alias("share"))
    return shares.join(prior, ["feature", "label"]).select("feature", "label", "samples", rnd(F.greatest(F.col("share") - F.col("prior"), F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "feature", "label")


def candidate_features(scores: DataFrame, top: int = 16, most: int = 24, seed: int = 42) -> DataFrame:
    """feature, place: the best by score, then others by the order of md5(seed|feature)."""
    best = scores.groupBy("feature").agg(F.max("score").alias("score"))
    placed = best.withColumn("by_score", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))  # a row a feature
    order = F.when(F.col("by_score") <= top, F.lpad(F.col("by_score").cast("string"), 8, "0")).otherwise(F.concat(F.lit("x"), F.md5(F.concat(F.lit(f"{seed}|"), F.col("feature")))))
    return placed.withColumn("place", F.row_number().over(Window.orderBy(order, "feature"))).where(F.col("place") <= most).select("feature", "place")


# Regimes --------------------------------------------------------------------------------------


def rolling_abs_change(df: DataFrame, name: str, order: list[str], width: int = 20, partition: list[str] = [], out: str = "volatility") -> DataFrame:  # noqa: B006
    """Mean over the last ``width`` rows of |y - previous y|, missing ones skipped. Unpartitioned, it is for bounded rows; rolling_by_blocks is for all."""
    w = Window.partitionBy(*partition).orderBy(*order)
    y = num(df, name)
    return df.withColumn("__change", F.abs(y - F.lag(y).over(w))).withColumn(out, F.avg("__change").over(w.rowsBetween(1 - width, 0))).drop("__change")


#: Rows whose sum SQL engines keep for moving windows.
SUMMED = 16


def _sum_in_steps(held: Column, last: Column) -> Column:
    """Sum of the values ``held`` of the rows up to position ``last``, in the order of a tree of sums of SUMMED rows: the rows before the first whole block, the blocks, then the rows after them one by one.

    Means that are equal but for rounding have the order that DuckDB's avg() over rows gives them, bit by bit
    (checked for windows of 20 rows).
    """
    plus = lambda a, b: a + b
    total = lambda x, start: F.aggregate(x, start, plus)
    size, zero = F.size(held), F.lit(0.0)
    begin = last - size + 1
    before = (F.pmod(-begin, F.lit(SUMMED))).cast("int")
    blocks = F.floor((size - before) / SUMMED).cast("int")
    sums = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: total(F.slice(held, before + 1 + k * SUMMED, F.lit(SUMMED)), zero))
    stepped = total(F.slice(held, before + 1 + blocks * SUMMED, size), total(sums, total(F.slice(held, F.lit(1), before), zero)))
    return F.when((size >= before) & (blocks > 0), stepped).otherwise(total(held, zero))


def rolling_by_blocks(df: DataFrame, name: str, width: int = 20, out: str = "volatility", block: int = 50_000) -> DataFrame:
    """rolling_abs_change over pos, which has no gaps, by blocks of rows; a block also gets the ``width`` rows before it. Sums are made in one order, wherever blocks begin."""
    if block < width:
        raise ValueError("a block must hold the rows of a window")
    own = F.floor(F.col("pos") / block).cast("long")
    carried = F.when(F.col("pos") % block >= block - width, F.array(own, own + 1)).otherwise(F.array(own))
    w, y = Window.partitionBy("__block").orderBy("pos"), num(df, name)
    frame = w.rowsBetween(1 - width, 0)
    moved = df.withColumn("__block", F.explode(carried)).withColumn("__change", F.abs(y - F.lag(y).over(w)))
    rolled = moved.withColumns({"__held": F.collect_list(F.coalesce("__change", F.lit(0.0))).over(frame), "__n": F.count("__change").over(frame)}).where(F.col("__block") == own)
    return rolled.withColumn(out, F.when(F.col("__n") > 0, _sum_in_steps(F.col("__held"), F.col("pos")) / F.col("__n"))).drop("__block", "__change", "__held", "__n")


def next_by_blocks(df: DataFrame, name: str, out: str, block: int = 50_000) -> DataFrame:
    """out: the value of the next row by pos, which has no gaps; by blocks of rows, and a block also gets the row after it."""
    own = F.floor(F.col("pos") / block).cast("long")
    carried = F.when((F.col("pos") % block == 0) & (F.col("pos") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    w = Window.partitionBy("__block").orderBy("pos")
    return df.withColumn("__block", F.explode(carried)).withColumn(out, F.lead(name).over(w)).where(F.col("__block") == own).drop("__block")


def regime_source(features: list[str], numeric_counts: dict[str, int], labels: list[str], least: int) -> tuple[str, str | None]:
    """('feature', name) of the first that sounds like volatility, else ('label', name), else ('position', None)."""
    for c in features:
        if any(k in c.lower() for k in ("volatility", "atr", "range")) and numeric_counts.get(c, 0) >= least:
            return "feature", c
    for c in labels:
        if numeric_counts.get(c, 0) >= least:
            return "label", c
    return "position", None


def regime_names(n: int) -> list[str]:
    return ["low", "mid", "high"][:n] if n <= 3 else [f"regime_{i}" for i in range(n)]


def regimes(head: DataFrame, source: tuple[str, str | None], n_regimes: int = 3) -> DataFrame:
    """head (pos from 0, without gaps) with regime, by terciles of the first ranks of the source; rows without source value drop out."""
    from sparkloom.operators.align import numbered

    kind, name = source
    if kind == "label":
        head, name = rolling_by_blocks(head, name, 20, "__source"), "__source"
    elif kind == "position":
        head, name = head.withColumn("__source", F.col("pos").cast("double")), "__source"
    else:
        head, name = head.withColumn("__source", num(head, name)), "__source"
    ranked = numbered(head.where("__source is not null"), ["__source", "pos"]).withColumn("rank", F.col("__rid") + 1).drop("__rid")
    n = ranked.count()
    names = F.array(*[F.lit(x) for x in regime_names(n_regimes)])
    return ranked.withColumn("regime", F.get(names, rank_bucket(F.col("rank"), n, n_regimes))).drop("rank", "__source")


def regime_scores(df: DataFrame, features: list[str], labels: list[str], order: list[str], source: tuple[str, str | None], n_regimes: int = 3, params: tuple[int, int, int, int] = REGIME_WALK, least: int = 10) -> DataFrame:
    """Fold scores with splits anew within each regime. Regimes are of all rows; folds bound the rows read in each."""
    from sparkloom.operators.align import numbered

    named = cut(regimes(numbered(df, order).withColumn("pos", F.col("__rid")).drop("__rid"), source, n_regimes))
    sizes = {r[0]: r[1] for r in named.groupBy("regime").count().collect()}
    first = named.withColumn("__k", F.row_number().over(Window.partitionBy("regime").orderBy("pos"))).where(F.col("__k") <= fold_rows(params))
    within = first.withColumn("pos", F.col("__k") - 1).drop("__k")
    parts = [with_folds(within.where(F.col("regime") == g), n, params) for g, n in sorted(sizes.items()) if folds(n, *params)]
    if not parts:
        return fold_scores(within.withColumn("fold", F.lit(0)), features, labels, ["regime", "fold"], least).limit(0)
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    return fold_scores(placed, features, labels, ["regime", "fold"], least)


def regime_summary(scores: DataFrame) -> DataFrame:
    """score_summary with regime_count and regime = 'all'."""
    counts = scores.groupBy("feature", "label", "score_name").agg(F.count_distinct("regime").alias("regime_count"))
    return score_summary(scores).join(counts, ["feature", "label", "score_name"], "left").withColumn("regime", F.lit("all")).orderBy(F.desc("mean_abs_score"), F.desc("valid_folds"), "feature", "label", "score_name")
