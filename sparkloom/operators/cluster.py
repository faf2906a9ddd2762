"""k-means on every pair of features against every categorical label."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num, rnd
from sparkloom.operators import metrics, sampling
from sparkloom.session import cut

LEAST, CLASSES = 20, 50
#: Test rows of which the GPU variant takes the silhouette.
SILHOUETTE_ROWS = 5000
ASSIGNED = "feature_1 string, feature_2 string, label string, rid string, x double, y double, cluster int, is_test boolean, label_value string, status string, note string, classes long, train_inertia double"


def lloyd(x: np.ndarray, k: int, inits: int, rng: np.random.Generator, steps: int = 100) -> tuple[np.ndarray, float]:
    """Best of several k-means++ starts."""
    best, least = x[:k], np.inf
    for _ in range(inits):
        c = x[rng.integers(len(x))][None]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(steps):
            a = assign(x, c)
            new = np.array([x[a == i].mean(0) if (a == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c, atol=1e-10):
                break
            c = new
        inertia = float(((x - c[assign(x, c)]) ** 2).sum())
        if inertia < least:
            best, least = c, inertia
    return best, least


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def pairs_by_labels(df: DataFrame, features: list[str], labels: list[str], rid: str, cap: int = 50_000, inits: int = 10, seed: int = 42) -> DataFrame:
    """A row for each clustered row: coordinates (scaled by the training rows), cluster, split and label; or one row with why a combination is skipped.

    A combination is a task; its rows are two columns of the capped sample.
    """
    sampled = sampling.sample(df, cap, rid, seed)
    combos = [(a, b, y) for a, b in itertools.combinations(features, 2) for y in labels]
    if not combos:
        return df.sparkSession.createDataFrame([], ASSIGNED)
    cells = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.lit(y).alias("label"), num(df, a).alias("x"), num(df, b).alias("y"), F.col(f"`{y}`").cast("string").alias("label_value")) for a, b, y in combos])
    long = sampled.select(F.col(rid).cast("string").alias("rid"), sampling.digest(seed, F.col(rid)).alias("h"), F.explode(cells).alias("c")).select("rid", "h", "c.*")

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["x", "y", "label_value"]).sort_values(["h", "rid"], kind="stable")
        classes = rows["label_value"].value_counts()
        k, n = len(classes), len(rows)
        made = lambda note: pd.DataFrame({"feature_1": [key[0]], "feature_2": [key[1]], "label": [key[2]], "rid": [None], "x": [None], "y": [None], "cluster": [None], "is_test": [None], "label_value": [None], "status": ["skipped"], "note": [note], "classes": [k], "train_inertia": [None]})
        if n < LEAST:
            return made("not_enough_samples")
        if k < 2:
            return made("label_has_less_than_2_classes")
        if k > CLASSES:
            return made("label_has_too_many_classes")
        size = int(np.ceil(0.2 * n))
        if classes.min() >= 2 and size >= k and n - size >= k:
            place = rows.groupby("label_value").cumcount()
            test = (place < np.ceil(0.2 * rows["label_value"].map(classes))).to_numpy()
        else:
            test = np.arange(n) < size
        x = rows[["x", "y"]].to_numpy(float)
        train = x[~test]
        if len(train) < k:
            return made("not_enough_train_samples_for_clusters")
        spread = train.std(0)
        x = (x - train.mean(0)) / np.where(spread == 0, 1, spread)
        if len(np.unique(x[~test], axis=0)) < k:
            return made("not_enough_distinct_points_for_clusters")
        c, inertia = lloyd(x[~test], k, inits, np.random.default_rng(seed))
        return pd.DataFrame({"feature_1": key[0], "feature_2": key[1], "label": key[2], "rid": rows["rid"].to_numpy(), "x": x[:, 0], "y": x[:, 1], "cluster": assign(x, c).astype("int32"), "is_test": test, "label_value": rows["label_value"].to_numpy(), "status": "ok", "note": "", "classes": k, "train_inertia": inertia})

    return cut(long.groupBy("feature_1", "feature_2", "label").applyInPandas(work, ASSIGNED))


def results(assigned: DataFrame, sample: int | None = None, note: str = "", seed: int = 42) -> DataFrame:
    """A row a combination: agreement of clusters and labels on training and test rows, silhouette of all test rows, or of ``sample`` of them by md5; best first."""
    key = ["feature_1", "feature_2", "label"]
    ok = assigned.where("status = 'ok'")
    train = metrics.agreement(ok.where(~F.col("is_test")), F.col("cluster"), F.col("label_value"), key).select(*key, F.col("adjusted_rand").alias("train_adjusted_rand"), F.col("normalized_mutual_info").alias("train_normalized_mutual_info"))
    test = metrics.agreement(ok.where("is_test"), F.col("cluster"), F.col("label_value"), key).select(*key, F.col("adjusted_rand").alias("test_adjusted_rand"), F.col("normalized_mutual_info").alias("test_normalized_mutual_info"), F.col("homogeneity").alias("test_homogeneity"), F.col("completeness").alias("test_completeness"), F.col("v_measure").alias("test_v_measure"))
    base = assigned.groupBy(*key, "status").agg(F.count("rid").alias("samples"), F.count(F.when(~F.col("is_test"), 1)).alias("train_samples"), F.count(F.when(F.col("is_test"), 1)).alias("test_samples"), F.max("classes").alias("label_classes"), rnd(F.max("train_inertia")).alias("train_inertia"), F.max("note").alias("note"))

    def shape(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "rid"], kind="stable").head(sample or len(rows))
        x, c = rows[["x", "y"]].to_numpy(float), rows["cluster"].to_numpy()
        return pd.DataFrame({"feature_1": [k[0]], "feature_2": [k[1]], "label": [k[2]], "test_silhouette": [silhouette(x, c)]})

    shapes = ok.where("is_test").withColumn("h", sampling.digest(seed, F.col("rid"))).groupBy(*key).applyInPandas(shape, "feature_1 string, feature_2 string, label string, test_silhouette double")
    joined = base.join(train, key, "left").join(test, key, "left").join(shapes, key, "left").withColumn("clusters", F.when(F.col("status") == "ok", F.col("label_classes")))
    told = joined.withColumn("note", F.when(F.col("status") == "ok", F.lit(note)).otherwise(F.col("note")))
    return ordered(told.select(
        *key, "status", "samples", "train_samples", "test_samples", "label_classes", "clusters", "train_adjusted_rand", "test_adjusted_rand", "train_normalized_mutual_info", "test_normalized_mutual_info",
        "test_homogeneity", "test_completeness", "test_v_measure", "test_silhouette", "train_inertia", "note",
    ))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc_nulls_last("test_adjusted_rand"), F.desc_nulls_last("test_normalized_mutual_info"), F.desc("samples"), "feature_1", "feature_2", "label")


def silhouette(x: np.ndarray, c: np.ndarray) -> float | None:
    labels, code, size = np.unique(c, return_inverse=True, return_counts=True)
    if not 2 <= len(labels) < len(x):
        return None
    total = 0.0
    for i in range(0, len(x), 512):
        d = np.sqrt(((x[i : i + 512, None] - x) ** 2).sum(2))
        sums = np.stack([d[:, code == k].sum(1) for k in range(len(labels))], 1)
        own = code[i : i + 512]
        rows = np.arange(len(own))
        inner = sums[rows, own] / np.maximum(size[own] - 1, 1)
        mean = sums / size
        mean[rows, own] = np.inf
        outer = mean.min(1)
        top = np.maximum(inner, outer)
        total += np.where((size[own] > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0).sum()
    return round(float(total / len(x)), 6)


def distribution(assigned: DataFrame) -> DataFrame:
    """feature_1, feature_2, label, cluster, label_value, count, cluster_pct of the clustered rows."""
    return metrics.cluster_labels(assigned.where("status = 'ok'"), F.col("cluster"), F.col("label_value"), ["feature_1", "feature_2", "label"])


def skip_reasons(found: DataFrame) -> DataFrame:
    """note, count of skipped combinations."""
    return found.where("status <> 'ok'").groupBy("note").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "note")
