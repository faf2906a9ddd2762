"""Hypothesis tests per feature and label, from grouped aggregates; p-values are computed on the small result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import special
from sparkloom.functions.coerce import num
from sparkloom.operators.correlate import average_ranks, pair_corr, spearman
from sparkloom.operators.profile import ColumnStats

PAIRWISE = "feature string, label string, test string, statistic double, p_value double, effect_size double, effect_name string, samples long, feature_type string, label_type string, note string"
TWO_FEATURE = "feature_1 string, feature_2 string, label string, test string, r_squared double, adjusted_r_squared double, f_statistic double, p_value double, samples long, note string"


# Names of the tests and of their effects.
PEARSON, WELCH, ANOVA, CHI2, OLS_F = "pearsonr", "welch_ttest", "one_way_anova", "chi2_contingency", "scipy_lstsq_ols_f_test"
ABS_R, ABS_D, NO_EFFECT, CRAMERS_V = "abs_pearson_r", "abs_cohens_d", "not_computed", "cramers_v"
#: With a group of so many rows at most and no ties, the law of U is exact.
EXACT_ROWS = 8


def route(f: ColumnStats, y: ColumnStats) -> str | None:
    """Which test a pair gets, by the columns' values."""
    if f.all_numeric and y.all_numeric:
        return "pearson"
    f_numeric, y_numeric = f.numeric == f.non_null and f.non_null > 0, y.numeric == y.non_null and y.non_null > 0
    if f_numeric and y.distinct == 2:
        return "two_groups"
    if f_numeric and 3 <= y.distinct <= 50 and not y_numeric:
        return "groups"
    if not f_numeric and not y_numeric and f.distinct >= 2 and y.distinct >= 2:
        return "chi2"
    return None


def group_moments(df: DataFrame, features: list[str], label: str, order: list[str] | None = None) -> DataFrame:
    """feature, class, n, mean, var, first: moments of each class; first orders the classes as they appear (by class without an order)."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), num(df, f).alias("x")) for f in features])
    first = F.struct(*order) if order else F.col(f"`{label}`").cast("string")
    long = df.select(F.col(f"`{label}`").cast("string").alias("class"), first.alias("at"), F.explode(cells).alias("c")).select("class", "at", "c.*").where("x is not null and class is not null")
    return long.groupBy("feature", "class").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.min("at").alias("first"))


def two_groups(moments: DataFrame) -> DataFrame:
    """feature, t, dof, cohens_d, samples of features with two classes of at least two rows each; the first class minus the second."""
    placed = moments.where("n >= 2").withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("first", "class")))
    a, b = (placed.where(F.col("k") == k).select("feature", *[F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "var")]) for k in (1, 2))
    s1, s2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    pooled = F.sqrt((F.col("var1") + F.col("var2")) / 2)
    return a.join(b, "feature").select(
        "feature", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2)).alias("t"),
        F.try_divide((s1 + s2) * (s1 + s2), s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1)).alias("dof"),
        F.coalesce(F.abs(F.try_divide(F.col("mean1") - F.col("mean2"), pooled)), F.lit(0.0)).alias("cohens_d"), (F.col("n1") + F.col("n2")).alias("samples"),
    )


def anova(moments: DataFrame) -> DataFrame:
    """feature, f, groups, samples over classes of at least two rows."""
    used = moments.where("n >= 2")
    means = used.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("samples"))
    joined = used.join(means, "feature")
    sums = joined.groupBy("feature", "groups", "samples").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("m"), 2)).alias("between"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"))
    return sums.where("groups >= 2").select("feature", F.try_divide(F.col("between") / (F.col("groups") - 1), F.col("within") / (F.col("samples") - F.col("groups"))).alias("f"), "groups", "samples")


def rank_sums(df: DataFrame, features: list[str], label: str, order: list[str] | None = None) -> DataFrame:
    """feature, class, n, rank_sum, first, total, ties: rank sums of each class, with the tie term of the feature."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), num(df, f).alias("x")) for f in features])
    first = F.struct(*order) if order else F.col(f"`{label}`").cast("string")
    long = df.select(F.col(f"`{label}`").cast("string").alias("class"), first.alias("at"), F.explode(cells).alias("c")).select("class", "at", "c.*").where("x is not null and class is not null")
    n = F.col("n").cast("double")
    ties = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.sum("n").alias("total"), F.sum(n * n * n - n).alias("ties"))
    sums = average_ranks(long, ["feature"], "x", "rank").groupBy("feature", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank_sum"), F.min("at").alias("first"))
    return sums.join(ties, "feature")


def mann_whitney(sums: DataFrame) -> DataFrame:
    """feature, u, z, samples, n1, n2, ties: U of the first class; z by the normal approximation with ties and continuity."""
    placed = sums.withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("first", "class")))
    a = placed.where("k = 1").select("feature", F.col("n").alias("n1"), F.col("rank_sum").alias("r1"), "total", "ties")
    both = a.join(placed.where("k = 2").select("feature", F.col("n").alias("n2")), "feature")
    n1, n2, total = (F.col(c).cast("double") for c in ("n1", "n2", "total"))
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    return both.select("feature", u.alias("u"), F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread).alias("z"), F.col("total").alias("samples"), "n1", "n2", "ties")


def mann_whitney_p(u: float, z: float | None, n1: int, n2: int, ties: float) -> float | None:
    """Two-sided: exact for a small group without ties, else by z."""
    if min(n1, n2) <= EXACT_ROWS and not ties:
        return special.mann_whitney_two_sided(u, n1, n2)
    return None if z is None else min(1.0, 2 * special.norm_sf(z))


def kruskal(sums: DataFrame) -> DataFrame:
    """feature, h, groups, samples."""
    total = F.col("total").cast("double")
    by = sums.groupBy("feature", "total", "ties").agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("groups"))
    h = 12 / (total * (total + 1)) * F.col("s") - 3 * (total + 1)
    return by.select("feature", F.try_divide(h, 1 - F.try_divide(F.col("ties"), total * total * total - total)).alias("h"), "groups", F.col("total").alias("samples"))


def contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """feature, label, a, b, n: counts of complete pairs of values, in long form."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(y).alias("label"), F.col(f"`{f}`").cast("string").alias("a"), F.col(f"`{y}`").cast("string").alias("b")) for f, y in pairs])
    return df.select(F.explode(cells).alias("c")).select("c.*").where("a is not null and b is not null").groupBy("feature", "label", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def chi_square(table: DataFrame) -> DataFrame:
    """feature, label, chi2 (continuity-corrected at one degree of freedom), dof, cramers_v, samples; tables of at least 2 x 2.

    Cells that never occur count too: their sum of expectations is what the occurring ones leave.
    """
    key = ["feature", "label"]
    rows = table.groupBy(*key, "a").agg(F.sum("n").alias("ra"))
    cols = table.groupBy(*key, "b").agg(F.sum("n").alias("cb"))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("total")).join(cols.groupBy(*key).agg(F.count(F.lit(1)).alias("c")), key).where("r >= 2 and c >= 2")
    grid = rows.join(sizes, key).join(cols, key).join(table, [*key, "a", "b"], "left")  # values by values, of one pair of columns
    e = F.col("ra").cast("double") * F.col("cb") / F.col("total")
    gap = F.abs(F.coalesce("n", F.lit(0)) - e)
    gap = F.when((F.col("r") == 2) & (F.col("c") == 2), F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))).otherwise(gap)
    found = grid.groupBy(*key, "r", "c", "total").agg(F.sum(gap * gap / e).alias("chi2"))
    return found.select(*key, "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.sqrt(F.col("chi2") / (F.col("total") * (F.least("r", "c") - 1))).alias("cramers_v"), F.col("total").alias("samples"))


def two_regressors(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """feature_1, feature_2, label, r_squared, adjusted_r_squared, f_statistic, samples of the least-squares fit on two features; F is null for a perfect fit."""
    out = None
    for y in labels:
        x1, x2, z = num(df, a), num(df, b), num(df, y)
        full = df.select(x1.alias("p"), x2.alias("q"), z.alias("z")).where("p is not null and q is not null and z is not null")
        c = lambda u, v: F.covar_samp(u, v)
        m = full.agg(F.count(F.lit(1)).alias("n"), c("p", "p").alias("pp"), c("q", "q").alias("qq"), c("p", "q").alias("pq"), c("p", "z").alias("pz"), c("q", "z").alias("qz"), c("z", "z").alias("zz"))
        det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
        r2 = F.try_divide(F.try_divide(F.col("qq") * F.col("pz") - F.col("pq") * F.col("qz"), det) * F.col("pz") + F.try_divide(F.col("pp") * F.col("qz") - F.col("pq") * F.col("pz"), det) * F.col("qz"), F.col("zz"))
        m = m.withColumn("r2", F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2))).where("n >= 5 and r2 is not null")
        part = m.select(
            F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.lit(y).alias("label"), F.col("r2").alias("r_squared"), (1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 3)).alias("adjusted_r_squared"),
            F.when(F.col("r2") < 1, (F.col("r2") / 2) / ((1 - F.col("r2")) / (F.col("n") - 3))).alias("f_statistic"), F.col("n").alias("samples"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# Whole tables ---------------------------------------------------------------------------------


def _round(x: float | None) -> float | None:
    return None if x is None or isinstance(x, float) and not math.isfinite(x) else round(float(x), 6)


def pairwise(df: DataFrame, stats: dict[str, ColumnStats], features: list[str], labels: list[str], order: list[str] | None = None) -> DataFrame:
    """All tests that apply, smallest p first. What is collected are the statistics, a row a pair."""
    spark, out = df.sparkSession, []
    kinds = {(f, y): route(stats[f], stats[y]) for f in features for y in labels}
    corr = [p for p, k in kinds.items() if k == "pearson"]
    if corr:
        from sparkloom.operators.correlate import long_pairs

        fs, ys = list(dict.fromkeys(f for f, _ in corr)), list(dict.fromkeys(y for _, y in corr))
        rho = {(r.feature, r.label): r.rho for r in spearman(long_pairs(df, fs, ys), ["feature", "label"]).collect()}
        for r in pair_corr(df, corr).where("samples >= 3 and r is not null").collect():
            dof = r.samples - 2
            p = lambda v: special.t_two_sided(v * math.sqrt(dof / (1 - v * v)) if abs(v) < 1 else math.inf, dof)  # noqa: B023, E731
            s = rho.get((r.feature, r.label))
            out.append((r.feature, r.label, PEARSON, _round(r.r), _round(p(r.r)), _round(abs(r.r)), ABS_R, r.samples, "numeric", "numeric", f"spearman_r={_round(s)}, spearman_p={_round(p(s)) if s is not None else None}"))
    for y in labels:
        both = [f for f in features if kinds[f, y] == "two_groups"]
        if both:
            welch = two_groups(group_moments(df, both, y, order)).collect()
            u = {r.feature: r for r in mann_whitney(rank_sums(df, both, y, order)).collect()}
            for r in welch:
                m = u.get(r.feature)
                note = f"mannwhitney_u={_round(m.u)}, mannwhitney_p={_round(mann_whitney_p(m.u, m.z, m.n1, m.n2, m.ties))}" if m else ""
                out.append((r.feature, y, WELCH, _round(r.t), _round(special.t_two_sided(r.t, r.dof)), _round(r.cohens_d), ABS_D, r.samples, "numeric", "binary", note))
        many = [f for f in features if kinds[f, y] == "groups"]
        if many:
            rows = anova(group_moments(df, many, y, order)).collect()
            h = {r.feature: r for r in kruskal(rank_sums(df, many, y, order)).collect()}
            for r in rows:
                k = h.get(r.feature)
                note = f"kruskal_h={_round(k.h)}, kruskal_p={_round(special.chi2_sf(k.h, k.groups - 1))}" if k and k.h is not None else ""
                out.append((r.feature, y, ANOVA, _round(r.f), _round(special.f_sf(r.f, r.groups - 1, r.samples - r.groups)), None, NO_EFFECT, k.samples if k else r.samples, "numeric", "categorical", note))
    chi = [p for p, k in kinds.items() if k == "chi2"]
    if chi:
        for r in chi_square(contingency(df, chi)).where("samples >= 3").collect():
            out.append((r.feature, r.label, CHI2, _round(r.chi2), _round(special.chi2_sf(r.chi2, r.dof)), _round(r.cramers_v), CRAMERS_V, r.samples, "categorical", "categorical", f"dof={r.dof}"))
    return spark.createDataFrame(out, PAIRWISE).orderBy(F.asc_nulls_last("p_value"), F.desc_nulls_last("effect_size"), F.desc("samples"), "feature", "label")


def two_feature(df: DataFrame, stats: dict[str, ColumnStats], features: list[str], labels: list[str]) -> DataFrame:
    """Only where exactly two features are numeric; labels are numeric with two values at least."""
    spark = df.sparkSession
    numeric = [f for f in features if stats[f].all_numeric]
    ys = [y for y in labels if stats[y].all_numeric]
    rows = two_regressors(df, *numeric, ys).collect() if len(numeric) == 2 and ys else []
    out = [(r.feature_1, r.feature_2, r.label, OLS_F, _round(r.r_squared), _round(r.adjusted_r_squared), _round(r.f_statistic), _round(special.f_sf(r.f_statistic, 2, r.samples - 3)) if r.f_statistic is not None else 0.0, r.samples, "") for r in rows]
    return spark.createDataFrame(out, TWO_FEATURE).orderBy(F.asc_nulls_last("p_value"), F.desc_nulls_last("r_squared"), "label")


__all__ = ["pairwise", "two_feature"]
