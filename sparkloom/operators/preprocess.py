"""Fit-and-apply steps before models: imputation, standardisation, label codes, interactions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num
from sparkloom.operators import profile

PRODUCT_BASES, PRODUCT_PAIRS, SMALL = 12, 80, 1e-12


def medians(df: DataFrame, names: list[str], where: Column | None = None) -> dict[str, float]:
    """Exact medians, of the rows where ``where`` holds; 0 without values."""
    if not names:
        return {}
    rows = (df if where is None else df.where(where)).select(*[num(df, c).alias(c) for c in names])
    found = {r["column"]: r["q0"] for r in profile.quantiles(profile.number_table(rows, names), [0.5]).collect()}  # a row a column
    return {c: found.get(c, 0.0) for c in names}


def impute(df: DataFrame, names: list[str], where: Column | None = None) -> DataFrame:
    """Numeric columns with medians for missing values, fitted on the rows where ``where`` holds."""
    found = medians(df, names, where)
    return df.withColumns({c: F.coalesce(num(df, c), F.lit(found[c])) for c in names})


def scales(df: DataFrame, names: list[str], where: Column | None = None) -> dict[str, tuple[float, float]]:
    """(mean, population deviation, 1 if it is 0)."""
    if not names:
        return {}
    x = lambda c: num(df, c) if where is None else F.when(where, num(df, c))
    row = df.agg(*[a for i, c in enumerate(names) for a in (F.avg(x(c)).alias(f"m{i}"), F.stddev_pop(x(c)).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(names)}


def standardize(df: DataFrame, names: list[str], where: Column | None = None) -> DataFrame:
    found = scales(df, names, where)
    return df.withColumns({c: (num(df, c) - F.lit(found[c][0])) / F.lit(found[c][1]) for c in names})


def label_codes(df: DataFrame, label: str, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """df with <label>__code by the order of the classes as text, and the classes. More than ``most`` classes raise ValueError."""
    text = F.col(f"`{label}`").cast("string")
    classes = sorted(r[0] for r in df.select(text.alias("c")).where("c is not null").distinct().limit(most + 1).collect())
    if len(classes) > most:
        raise ValueError(f"{label} has more than {most} classes")
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), text) - 1 if classes else F.lit(None)
    return df.withColumn(f"{label}__code", code.cast("int")), classes


def interactions(df: DataFrame, bases: list[str], most_bases: int = PRODUCT_BASES, most_pairs: int = PRODUCT_PAIRS) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """df with products, differences and ratios of pairs of features, and (interaction, left_feature, right_feature, operation) of each."""
    made = []
    for a, b in itertools.islice(itertools.combinations(list(dict.fromkeys(bases))[:most_bases], 2), most_pairs):
        made += [(f"{a}__{op}__{b}", a, b, op) for op in ("product", "difference", "ratio")]
    cell = {
        "product": lambda x, y: x * y,
        "difference": lambda x, y: x - y,
        "ratio": lambda x, y: F.when(F.abs(y) > SMALL, x / y),
    }
    return df.select("*", *[cell[op](num(df, a), num(df, b)).alias(name) for name, a, b, op in made]), made
