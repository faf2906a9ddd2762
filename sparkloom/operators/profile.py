"""Column statistics, type roles, gates, profiles and summaries.

One aggregate counts and sums for all columns. Distinct counts and quantiles come from a table of values
(a row a different value of a column, with its count), which is aggregated before it is shuffled; quantiles
deal it by range, so no task holds all values of a column. The driver sees a row a column. Gates and
dispatch are decisions on those rows.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.coerce import dtype_name, kurt, num, rnd, role, skew
from sparkloom.operators.correlate import running_count
from sparkloom.session import cut
from sparkloom.sources.tables import TIME


@dataclasses.dataclass(frozen=True)
class ColumnStats:
    name: str
    rows: int
    non_null: int
    numeric: int
    distinct: int
    numeric_distinct: int

    @property
    def all_numeric(self) -> bool:
        return self.numeric == self.non_null and self.numeric_distinct >= 2


def value(df: DataFrame, name: str) -> Column:
    """A column's value, a NaN as missing."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if df.schema[name].dataType.simpleString() in ("double", "float") else c


def _cells(df: DataFrame, names: Iterable[str], cell) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *cell(c)) for c in names])).alias("c")).select("c.*")


def value_table(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """column, value (string; null for finite doubles), x (the number it stands for, if it does), n: a row a different value, missing ones left out."""

    def cell(c: str) -> list[Column]:
        v, x = value(df, c), num(df, c)
        if df.schema[c].dataType.simpleString() in ("double", "float"):
            return [F.when(x.isNull(), v.cast("string")).alias("value"), (x + F.lit(0.0)).alias("x")]  # -0.0 is 0.0
        return [v.cast("string").alias("value"), x.alias("x")]

    return _cells(df, names, cell).where("value is not null or x is not null").groupBy("column", "value", "x").agg(F.count(F.lit(1)).alias("n"))


def number_table(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """column, x, n: a row a different number."""
    return _cells(df, names, lambda c: [(num(df, c) + F.lit(0.0)).alias("x")]).where("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(values: DataFrame) -> DataFrame:
    """column, distinct, numeric_distinct of a value_table()."""
    by_number = values.groupBy("column", F.col("x")).agg(F.count(F.lit(1)).alias("d"))
    return by_number.groupBy("column").agg(F.sum("d").alias("distinct"), F.count("x").alias("numeric_distinct"))


def quantiles(counts: DataFrame, at: list[float]) -> DataFrame:
    """column, q0, q1, ...: exact linear quantiles of a number_table()."""
    counts = cut(counts)
    placed = running_count(counts, ["column"], "x")
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    rows = placed.join(F.broadcast(total), "column")  # a row a column
    held = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("x")))
    parts, out = [], []
    for i, q in enumerate(at):
        h = (F.col("total") - 1) * F.lit(q)
        parts += [held(F.floor(h)).alias(f"a{i}"), held(F.least(F.floor(h) + 1, F.col("total") - 1)).alias(f"b{i}")]
        a, b, t = F.col(f"a{i}"), F.col(f"b{i}"), h - F.floor(h)
        out.append(F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t)).alias(f"q{i}"))
    return rows.groupBy("column", "total").agg(*parts).select("column", *out)


def column_stats(df: DataFrame, names: Iterable[str]) -> dict[str, ColumnStats]:
    names = list(names)
    if not names:
        return {}
    exprs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        exprs += [F.count(value(df, c)).alias(f"n{i}"), F.count(num(df, c)).alias(f"m{i}")]
    row = df.agg(*exprs).first()
    found = {r["column"]: r for r in distinct_counts(value_table(df, names)).collect()}
    d = lambda c, k: found[c][k] if c in found else 0
    return {c: ColumnStats(c, row["rows"], row[f"n{i}"], row[f"m{i}"], d(c, "distinct"), d(c, "numeric_distinct")) for i, c in enumerate(names)}


# Gates ----------------------------------------------------------------------------------------


def not_time(names: Iterable[str]) -> list[str]:
    return [c for c in names if c.lower() != TIME.lower()]


def numeric_features(stats: dict[str, ColumnStats], least: int = 10) -> list[str]:
    """At least ``least`` numeric values, two different ones."""
    return [c for c, s in stats.items() if s.numeric >= least and s.numeric_distinct >= 2]


def matrix_features(stats: dict[str, ColumnStats], exclude: Iterable[str] = ()) -> list[str]:
    return [c for c in numeric_features(stats, 1) if c not in set(exclude)]


def fully_numeric(stats: dict[str, ColumnStats]) -> list[str]:
    """All values that are there are numbers, two different ones."""
    return [c for c, s in stats.items() if s.all_numeric]


def categorical_labels(stats: dict[str, ColumnStats], most: int = 50) -> list[str]:
    return [c for c, s in stats.items() if 2 <= s.distinct <= most]


def exclusions(stats: dict[str, ColumnStats]) -> dict[str, str | None]:
    """Why a column can't be a feature, by the first reason that holds; None for those that can."""
    out = {}
    for c, s in stats.items():
        missing = 1 - s.numeric / s.rows if s.rows else 1.0
        out[c] = (
            "date_column" if c.lower() == TIME.lower() else "non_numeric" if s.numeric == 0 else "too_many_missing" if missing > 0.5 or s.numeric < 10
            else "constant_or_too_few_values" if s.numeric_distinct < 2 else None
        )
    return out


def task_by_values(s: ColumnStats) -> str:
    """Regression if there are ten numeric values and more than 50 different ones."""
    return "regression" if s.numeric >= 10 and s.numeric_distinct > 50 else "classification"


def task_by_distinct(s: ColumnStats) -> str:
    """Classification without numeric values or with up to ten different ones."""
    return "classification" if s.numeric == 0 or s.distinct <= 10 else "regression"


def inferred_type(df: DataFrame, s: ColumnStats) -> str:
    return "datetime" if role(df, s.name) == "datetime" else "numeric" if s.numeric else "categorical"


# Relations ------------------------------------------------------------------------------------


def _stacked(df: DataFrame, per_column: list[tuple[list[Column], list[Column]]], names: list[str]) -> DataFrame:
    """One aggregate over all columns, its row turned into a row a column. per_column: (aggregates, constants)."""
    if not per_column:
        return df.sparkSession.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    flat = list(itertools.chain.from_iterable(a for a, _ in per_column))
    once = df.agg(*[c.alias(f"a{i}") for i, c in enumerate(flat)])
    rows, at = [], 0
    for aggregates, constants in per_column:
        cells = [*constants, *(F.col(f"a{at + k}") for k in range(len(aggregates)))]
        rows.append(F.struct(*[c.alias(n) for c, n in zip(cells, names, strict=True)]))
        at += len(aggregates)
    return once.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_profile(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """column, dtype, rows, missing, missing_pct, unique, mean, std, min, median, max."""
    names, parts = list(names or df.columns), []
    for c in names:
        v, x = value(df, c), num(df, c)
        n, k = F.count(F.lit(1)), F.count(v)
        parts.append(([n, n - k, rnd(F.try_divide((n - k) * 100.0, n)), rnd(F.avg(x)), rnd(F.stddev_samp(x)), rnd(F.min(x)), rnd(F.max(x))], [F.lit(c), F.lit(dtype_name(df, c))]))
    told = _stacked(df, parts, ["column", "dtype", "rows", "missing", "missing_pct", "mean", "std", "min", "max"])
    values = cut(value_table(df, names))
    joined = told.join(F.broadcast(distinct_counts(values)), "column", "left").join(F.broadcast(quantiles(values.where("x is not null").groupBy("column", "x").agg(F.sum("n").alias("n")), [0.5])), "column", "left")  # a row a column
    return joined.select("column", "dtype", "rows", "missing", "missing_pct", F.coalesce("distinct", F.lit(0)).cast("long").alias("unique"), "mean", "std", "min", rnd(F.col("q0")).alias("median"), "max")


def overview(df: DataFrame, dataset: str, stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """One row: rows, columns, duplicate_rows, total_missing(_pct) and columns by type."""
    stats = stats or column_stats(df, df.columns)
    kinds = [inferred_type(df, stats[c]) for c in df.columns]
    cells = len(df.columns) * next(iter(stats.values())).rows if stats else 0
    missing = sum(s.rows - s.non_null for s in stats.values())
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")).select(
        F.lit(dataset).alias("dataset"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "duplicate_rows", F.lit(missing).cast("long").alias("total_missing"),
        rnd(F.lit(100.0 * missing / cells if cells else 0.0)).alias("total_missing_pct"), *[F.lit(kinds.count(k)).cast("long").alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime")],
    )


def eda_columns(df: DataFrame, dataset: str) -> DataFrame:
    """dataset, column, dtype, inferred_type, rows, non_null, missing, missing_pct, unique, unique_pct, zero_count, negative_count."""
    parts = []
    for c in df.columns:
        v, x = value(df, c), num(df, c)
        n, k, m = F.count(F.lit(1)), F.count(v), F.count(x)
        kind = F.lit("datetime") if role(df, c) == "datetime" else F.when(m > 0, "numeric").otherwise("categorical")
        count = lambda cond: F.when(F.count(x) > 0, F.count(F.when(cond, 1)))  # noqa: B023, E731
        parts.append(([kind, n, k, n - k, rnd(F.try_divide((n - k) * 100.0, n)), count(x == 0), count(x < 0)], [F.lit(dataset), F.lit(c), F.lit(dtype_name(df, c))]))
    told = _stacked(df, parts, ["dataset", "column", "dtype", "inferred_type", "rows", "non_null", "missing", "missing_pct", "zero_count", "negative_count"])
    unique = F.coalesce("distinct", F.lit(0)).cast("long")
    joined = told.join(F.broadcast(distinct_counts(value_table(df, df.columns))), "column", "left")  # a row a column
    return joined.select("dataset", "column", "dtype", "inferred_type", "rows", "non_null", "missing", "missing_pct", unique.alias("unique"), rnd(F.try_divide(unique * 100.0, F.col("rows"))).alias("unique_pct"), "zero_count", "negative_count")


def missingness(columns: DataFrame) -> DataFrame:
    return columns.select("dataset", "column", "missing", "missing_pct", "non_null", "rows").orderBy(F.desc("missing_pct"), F.desc("missing"), "column")


def numeric_summary(df: DataFrame, dataset: str, names: Iterable[str], digits: int = 6) -> DataFrame:
    """dataset, column, count, mean, std, min, q25, median, q75, max, skew, kurtosis. Quantiles are exact and linear."""
    names, parts = list(names), []
    for c in names:
        x = num(df, c)
        parts.append(([F.count(x), *[rnd(v, digits) for v in (F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), skew(x), kurt(x))]], [F.lit(dataset), F.lit(c)]))
    shown = ["dataset", "column", "count", "mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis"]
    if not names:
        return _stacked(df, [], shown)
    told = _stacked(df, parts, ["dataset", "column", "count", "mean", "std", "min", "max", "skew", "kurtosis"])
    found = quantiles(number_table(df, names), [0.25, 0.5, 0.75]).select("column", *[rnd(F.col(f"q{i}"), digits).alias(n) for i, n in enumerate(("q25", "median", "q75"))])
    return told.join(F.broadcast(found), "column", "left").select(*shown)  # a row a column


def long_values(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """column, value (string): a row a cell."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(df, c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*")


def value_counts(df: DataFrame, names: Iterable[str], most: int | None = 10) -> DataFrame:
    """column, value, n: the most frequent values, missing ones included; ties by value, missing last."""
    counts = long_values(df, list(names)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return counts
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def top_values(df: DataFrame, names: Iterable[str], most: int = 10) -> DataFrame:
    """column, top_values: 'value=n; ...'."""
    shown = F.concat_ws("=", F.coalesce("value", F.lit("nan")), F.col("n").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("place", shown.alias("shown"))))
    return value_counts(df, names, most).groupBy("column").agg(F.array_join(F.transform(listed, lambda x: x["shown"]), "; ").alias("top_values"))


def categorical_summary(df: DataFrame, dataset: str, names: Iterable[str], most: int = 10) -> DataFrame:
    """dataset, column, unique, top_values."""
    names = list(names)
    counts = value_counts(df, names, None)
    unique = counts.groupBy("column").agg(F.count("value").alias("unique"))
    return unique.join(top_values(df, names, most), "column").select(F.lit(dataset).alias("dataset"), "column", "unique", "top_values")


def label_distribution(df: DataFrame, label: str, most: int = 20) -> DataFrame:
    """label, value, count: of labels with up to ``most`` values; else none."""
    counts = value_counts(df, [label], None)
    total = counts.groupBy("column").agg(F.count("value").alias("unique"))
    return counts.join(F.broadcast(total), "column").where(F.col("unique") <= most).select(F.col("column").alias("label"), F.coalesce("value", F.lit("nan")).alias("value"), F.col("n").alias("count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """duplicate_rows: rows that equal an earlier one, missing equal to missing."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))

