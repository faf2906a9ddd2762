"""Align a feature table and a label table row by row."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import cut
from sparkloom.sources.tables import TIME

SUFFIX = "__label"


@dataclasses.dataclass(frozen=True)
class Aligned:
    df: DataFrame
    features: list[str]
    labels: list[str]
    strategy: str
    time: str | None = None


def _rename(labels: DataFrame, taken: list[str], key: str | None) -> tuple[DataFrame, list[str]]:
    """Labels whose names the features have get a suffix."""
    new = {c: f"{c}{SUFFIX}" if c in taken else c for c in labels.columns if c != key}
    return labels.select(*([F.col(f"`{key}`").alias("__key")] if key else []), *[F.col(f"`{c}`").alias(n) for c, n in new.items()]), list(new.values())


def join_on(features: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """Inner join; missing keys match missing keys. Plans as a hash or merge join on the coalesced key and its nullness."""
    for side, df in (("feature", features), ("label", labels)):
        if key not in df.columns:
            raise ValueError(f"join key {key!r} is not in the {side} table")
    renamed, names = _rename(labels, features.columns, key)
    return features.join(renamed, F.col(f"`{key}`").eqNullSafe(F.col("__key"))).drop("__key"), names


def numbered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """__rid from 0 without gaps: by the order given, else as the files are read. Partition sizes are summed, no row goes to a single task."""
    if order:
        df = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    marked = cut(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = sorted((r[0], r[1], r[2]) for r in marked.groupBy("__part").agg(F.count("*"), F.min("__at")).collect())  # a row a partition
    starts, total = [], 0
    for part, n, first in sizes:
        starts.append((part, total - first))
        total += n
    told = df.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __shift long")
    return marked.join(F.broadcast(told), "__part").withColumn("__rid", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def join_by_position(features: DataFrame, labels: DataFrame, order: tuple[list[str], list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    n, m = features.count(), labels.count()
    if n != m:
        raise ValueError(f"no common column, and {n} feature rows can't be aligned with {m} label rows by position")
    renamed, names = _rename(labels, features.columns, None)
    left, right = numbered(features, order and order[0]), numbered(renamed, order and order[1])
    return left.join(right, "__rid"), names


def align(features: DataFrame, labels: DataFrame, key: str | None = None) -> Aligned:
    """By the explicit key, else by time, else by the first common column in feature order, else by position."""
    has_time = TIME in features.columns and TIME in labels.columns
    common = [c for c in features.columns if c in labels.columns and c != TIME]
    if key:
        df, names, strategy = *join_on(features, labels, key), f"inner join on {key}"
    elif has_time:
        df, names, strategy = *join_on(features, labels, TIME), f"inner join on common index {TIME}"
        key = TIME
    elif common:
        key = common[0]
        df, names, strategy = *join_on(features, labels, key), f"inner join on common column {key}"
    else:
        df, names, strategy = *join_by_position(features, labels), "positional alignment"
    keep = [c for c in features.columns if c != key and c.lower() != TIME.lower()]
    return Aligned(df, keep, [c for c in names if c.lower() not in (TIME.lower(), f"{TIME}{SUFFIX}".lower())], strategy, TIME if TIME in df.columns else None)


def choose_targets(labels: list[str], targets: list[str] | None) -> list[str]:
    """The targets in the user's order; an unknown one raises ValueError."""
    if not targets:
        return labels
    if missing := [t for t in targets if t not in labels]:
        raise ValueError(f"unknown targets {', '.join(missing)}; available: {', '.join(labels)}")
    return list(targets)


def explode_arrays(df: DataFrame) -> DataFrame:
    """Arrays of numbers become columns name_0, name_1, ...; other nested columns raise ValueError. One pass finds the lengths."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
    if nested := [f.name for f in df.schema if f.name not in arrays and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]:
        raise ValueError(f"nested columns can't be profiled: {', '.join(nested)}")
    if not arrays:
        return df
    sizes = df.agg(*[F.max(F.size(f"`{c}`")).alias(c) for c in arrays]).first()
    parts = {c: [F.get(F.col(f"`{c}`"), F.lit(k)).alias(f"{c}_{k}") for k in range(max(0, sizes[c] or 0))] for c in arrays}
    return df.select(*[x for c in df.columns for x in parts.get(c, [F.col(f"`{c}`")])])
