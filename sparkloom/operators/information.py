"""Mutual information by nearest neighbours, redundancy-aware ranking, stability selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num
from sparkloom.operators import preprocess, profile, sampling
from sparkloom.operators.correlate import long_pairs, spearman
from sparkloom.session import cut

NEIGHBOURS, LEAST, LEAST_ROWS, MRMR = 3, 20, 30, 50
#: Points of a leaf, leaves of a group.
LEAF, GROUP = 32, 64
MI = "feature string, label string, score_name string, score double, samples long"


def _digamma(n: np.ndarray) -> np.ndarray:
    """At integers: harmonic numbers."""
    n = np.maximum(n.astype(int), 1)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, int(n.max()) + 1))])
    return harmonic[n - 1] - 0.5772156649015329


def _spread(x: np.ndarray, seed: int) -> np.ndarray:
    """Scaled to deviation 1, with noise far below the data's resolution to break ties."""
    x = x / (x.std() or 1.0)
    return x + 1e-10 * max(1.0, float(np.abs(x).mean())) * np.random.default_rng(seed).standard_normal(len(x))


def _closer(ordered: np.ndarray, x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many values are closer to x than r, itself included; the margin keeps out the neighbour at r in spite of rounding."""
    r = np.maximum(0, r - np.maximum(r * 1e-9, 4 * np.spacing(np.abs(x) + r)))
    return np.searchsorted(ordered, x + r, "right") - np.searchsorted(ordered, x - r, "left")


def _leaves(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Points halved along the longer side of their box until a leaf holds LEAF; near leaves are near in the list."""
    out, left = [], [np.arange(len(x))]
    while left:
        at = left.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        side = x if np.ptp(x[at]) >= np.ptp(y[at]) else y
        order = at[np.argpartition(side[at], len(at) // 2)]
        left += [order[len(at) // 2 :], order[: len(at) // 2]]
    return out


def kth_distance(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Distance (the larger of both sides) of each point to its k-th nearest other point. Leaves whose boxes are farther than that aren't looked at."""
    leaves = _leaves(x, y)
    box = np.array([(x[at].min(), x[at].max(), y[at].min(), y[at].max()) for at in leaves])
    starts = np.arange(0, len(leaves), GROUP)
    groups = np.column_stack([np.minimum.reduceat(box[:, 0], starts), np.maximum.reduceat(box[:, 1], starts), np.minimum.reduceat(box[:, 2], starts), np.maximum.reduceat(box[:, 3], starts)])
    gap = lambda a, b: np.maximum(np.maximum(a[:, 0] - b[1], b[0] - a[:, 1]), np.maximum(a[:, 2] - b[3], b[2] - a[:, 3]))
    out = np.empty(len(x))

    def kth(at: np.ndarray, others: np.ndarray) -> np.ndarray:
        d = np.maximum(np.abs(x[at, None] - x[others]), np.abs(y[at, None] - y[others]))
        d[at[:, None] == others] = np.inf
        return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(at), np.inf)

    for n, at in enumerate(leaves):
        near = kth(at, at).max()
        close = np.flatnonzero(gap(groups, box[n]) <= near)
        close = (starts[close][:, None] + np.arange(GROUP)).ravel()
        close = close[close < len(leaves)]
        close = close[gap(box[close], box[n]) <= near]
        out[at] = kth(at, np.concatenate([leaves[c] for c in close]))
    return out


def mi_continuous(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS, seed: int = 42) -> float:
    """Kraskov, Stoegbauer, Grassberger (2004), first estimator; memory is linear in the rows."""
    n = len(x)
    x, y = _spread(x, seed), _spread(y, seed + 1)
    r = kth_distance(x, y, min(k, n - 1))
    nx, ny = _closer(np.sort(x), x, r), _closer(np.sort(y), y, r)
    return max(0.0, float(_digamma(np.array([n]))[0] + _digamma(np.array([k]))[0] - _digamma(nx).mean() - _digamma(ny).mean()))


def mi_discrete(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS, seed: int = 42) -> float:
    """Ross (2014): neighbours within the class, counted in all; classes of one row are left out."""
    x = _spread(x, seed)
    classes, code, size = np.unique(y, return_inverse=True, return_counts=True)
    keep = size[code] > 1
    x, code = x[keep], code[keep]
    if not len(x):
        return 0.0
    every, radius, ks, ns = np.sort(x), np.empty(len(x)), np.empty(len(x), int), np.empty(len(x), int)
    for c in np.unique(code):
        own = np.flatnonzero(code == c)
        order = own[np.argsort(x[own], kind="stable")]
        v, kk = x[order], min(k, len(own) - 1)
        best = np.full(len(v), np.inf)
        for left in range(kk + 1):  # the kk nearest of sorted values lie in a window of kk + 1
            low, high = np.arange(len(v)) - left, np.arange(len(v)) - left + kk
            ok = (low >= 0) & (high < len(v))
            best[ok] = np.minimum(best[ok], np.maximum(v[ok] - v[low[ok]], v[high[ok]] - v[ok]))
        radius[order], ks[order], ns[order] = best, kk, len(own)
    m = _closer(every, x, radius)
    return max(0.0, float(_digamma(np.array([len(x)]))[0] + _digamma(ks).mean() - _digamma(ns).mean() - _digamma(m).mean()))


def mutual_information(df: DataFrame, features: list[str], labels: list[str], rid: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    """feature, label, score_name, score, samples; features median-imputed. All rows count, in time n log n; a pair of columns is a task's work. cap: rows by md5 at most, for tables whose columns don't fit a task."""
    spark = df.sparkSession
    stats = profile.column_stats(df, labels)
    sampled = df if cap is None else sampling.sample(df, cap, rid, seed)
    filled = preprocess.impute(sampled, features).withColumnRenamed(rid, "rid")
    kinds = {y: profile.task_by_distinct(s) for y, s in stats.items() if s.distinct >= 2}
    if not kinds or not features:
        return spark.createDataFrame([], MI)
    parts = []
    for kind in ("classification", "regression"):
        ys = [y for y, k in kinds.items() if k == kind]
        if ys:
            parts.append(long_pairs(filled, features, ys, ["rid"], numeric_label=kind == "regression").where("feature <> label").withColumn("y", F.col("y").cast("string")).withColumn("kind", F.lit(kind)))
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid", kind="stable")
        x, n = rows["x"].to_numpy(float), len(rows)
        if n < LEAST or rows["y"].nunique() < 2:
            return pd.DataFrame(columns=["feature", "label", "score_name", "score", "samples"])
        s = mi_discrete(x, rows["y"].to_numpy(), seed=seed) if key[2] == "classification" else mi_continuous(x, rows["y"].to_numpy(float), seed=seed)
        return pd.DataFrame({"feature": [key[0]], "label": [key[1]], "score_name": ["mutual_info_classif" if key[2] == "classification" else "mutual_info_regression"], "score": [round(s, 6)], "samples": [n]})

    return pairs.groupBy("feature", "label", "kind").applyInPandas(score, MI).orderBy(F.desc("score"), F.desc("samples"), "feature", "label")


def redundancy(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, label (another feature), rho: Spearman's over complete pairs."""
    pairs = long_pairs(df, features, features).where("feature < label")
    return spearman(pairs, ["feature", "label"])


def mrmr(relevance: list[tuple[str, str, float, int]], rho: dict[tuple[str, str], float], most: int = MRMR) -> list[tuple]:
    """Greedy: relevance minus the mean |rho| with those chosen. relevance: (feature, label, score, samples). Rows: feature, label, score_name, score, relevance, redundancy, mrmr_score, samples."""
    out = []
    for y in dict.fromkeys(r[1] for r in relevance):
        left = {r[0]: (r[2], r[3]) for r in relevance if r[1] == y}
        chosen: list[str] = []
        while left and len(chosen) < most:
            red = {f: float(np.mean([abs(rho.get((min(f, c), max(f, c))) or 0.0) for c in chosen])) if chosen else 0.0 for f in left}
            f = min(left, key=lambda f: (-(left[f][0] - red[f]), f))  # noqa: B023
            rel, n = left.pop(f)
            chosen.append(f)
            out.append((f, y, "mrmr", rel - red[f], rel, red[f], rel - red[f], n))
    return sorted(out, key=lambda r: (-r[3], r[0], r[1]))


# Stability selection --------------------------------------------------------------------------


def lasso(gram: np.ndarray, xy: np.ndarray, n: float, alpha: float, steps: int = 500) -> np.ndarray:
    """Coordinate descent on the Gram matrix (covariance updates) for squares / 2n + alpha * |b|_1."""
    b = np.zeros(len(xy))
    for _ in range(steps):
        moved = 0.0
        for j in range(len(b)):
            if gram[j, j] <= 0:
                continue
            r = xy[j] - gram[j] @ b + gram[j, j] * b[j]
            new = math.copysign(max(abs(r) - n * alpha, 0.0), r) / gram[j, j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < 1e-8:
            break
    return b


def newton_step(h: np.ndarray, g: np.ndarray, w: np.ndarray, c: float, steps: int = 200) -> np.ndarray:
    """Coordinate descent on the quadratic model at w of C * loss + |w|_1, with a free intercept (last). h, g: curvature and gradient of the loss."""
    h, g, new = c * h + 1e-9 * np.eye(len(w)), c * g, w.copy()
    slope = g.copy()  # of the model at new
    for _ in range(steps):
        moved = 0.0
        for j in range(len(w)):
            z = new[j] - slope[j] / h[j, j]
            to = z if j == len(w) - 1 else math.copysign(max(abs(z) - 1 / h[j, j], 0.0), z)
            if to != new[j]:
                slope += h[:, j] * (to - new[j])
                moved, new[j] = max(moved, abs(to - new[j])), to
        if moved < 1e-9:
            break
    return new


def _summed(rows: DataFrame, part, schema: str) -> dict[int, list[np.ndarray]]:
    """part(y, x) gives arrays for the rows of a resample; they are summed over all its rows, in tasks first. rows: resample, y (double), x."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            r, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1)
            for k in np.unique(r).tolist():
                found = part(k, y[r == k], x[r == k])
                total[k] = [a + b for a, b in zip(total[k], found, strict=True)] if k in total else list(found)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([v[i].ravel().tolist() for v in total.values()], pa.list_(pa.float64())) for i in range(len(fields)))], ["resample", *fields])

    def add(table: pa.Table) -> pa.Table:
        sums = [np.sum(np.array(table[c].to_pylist()), axis=0) for c in fields]
        return pa.table({"resample": table["resample"].slice(0, 1).combine_chunks(), **{c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in zip(fields, sums, strict=True)}})

    made = rows.mapInArrow(held, "resample int, " + schema).groupBy("resample").applyInArrow(add, "resample int, " + schema)
    return {r[0]: [np.array(v) for v in r[1:]] for r in made.collect()}  # a row a resample


def select_by_lasso(rows: DataFrame, size: int, alpha: float = 0.01) -> dict[int, np.ndarray]:
    """Which features each resample selects: from the Gram matrix of its standardised columns."""

    def part(_: int, y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        z = np.column_stack([x, y, np.ones(len(y))])
        return [z.T @ z]

    out = {}
    for k, (gram,) in _summed(rows, part, "gram array<double>").items():
        gram = gram.reshape(size + 2, size + 2)
        n, sums = gram[-1, -1], gram[-1, :-1]
        inner = gram[:-1, :-1] - np.outer(sums, sums) / n
        d = np.sqrt(np.maximum(np.diag(inner)[:size], 0) / n)
        d[d < 1e-12] = np.inf  # constant columns
        out[k] = np.abs(lasso(inner[:size, :size] / np.outer(d, d), inner[:size, size] / d, n, alpha)) > 1e-9
    return out


def select_by_logistic(rows: DataFrame, size: int, classes: int, c: float = 0.2, passes: int = 25) -> dict[int, np.ndarray]:
    """Which features each resample selects by L1 logistic regression, one class against the rest (y: number of the class). A pass over the rows is a Newton step of all resamples and classes."""
    ones = range(1, 2) if classes == 2 else range(classes)
    moments = _summed(rows, lambda _, y, x: [x.sum(0), (x * x).sum(0), np.array([float(len(y))]), np.bincount(y.astype(int), minlength=classes).astype(float)], "s array<double>, q array<double>, n array<double>, held array<double>")
    scale = {}
    for k, (s, q, n, held) in moments.items():
        if (held > 0).sum() > 1:
            d = np.sqrt(np.maximum(q / n[0] - (s / n[0]) ** 2, 0))
            scale[k] = (s / n[0], np.where(d < 1e-12, np.inf, d))
    weights = {k: np.zeros((len(ones), size + 1)) for k in scale}
    last = {k: (weights[k].copy(), np.full(len(ones), np.inf)) for k in scale}

    def part(k: int, y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        if k not in scale:
            return [np.zeros((len(ones), size + 1, size + 1)), np.zeros((len(ones), size + 1)), np.zeros(len(ones))]
        z = np.column_stack([(x - scale[k][0]) / scale[k][1], np.ones(len(y))])
        h, g, loss = [], [], []
        for w, one in zip(weights[k], ones, strict=True):
            t, m = (y == one).astype(float), z @ w
            p = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
            h.append((z * (p * (1 - p))[:, None]).T @ z)
            g.append(z.T @ (p - t))
            loss.append(float((np.logaddexp(0, m) - t * m).sum()))
        return [np.array(h), np.array(g), np.array(loss)]

    for _ in range(passes):
        moved = 0.0
        for k, (h, g, loss) in _summed(rows, part, "h array<double>, g array<double>, loss array<double>").items():
            if k not in scale:
                continue
            h, g = h.reshape(len(ones), size + 1, size + 1), g.reshape(len(ones), size + 1)
            before, least = last[k]
            for i in range(len(ones)):
                value = c * loss[i] + np.abs(weights[k][i, :-1]).sum()
                if value > least[i] + 1e-9 * abs(least[i]):  # too far: half the way back
                    weights[k][i] = (weights[k][i] + before[i]) / 2
                    moved = max(moved, np.abs(weights[k][i] - before[i]).max())
                    continue
                new = newton_step(h[i], g[i], weights[k][i], c)
                moved = max(moved, np.abs(new - weights[k][i]).max())
                before[i], least[i], weights[k][i] = weights[k][i].copy(), value, new
        if moved < 1e-7:
            break
    return {k: (np.abs(w[:, :-1]).max(0) > 1e-9) for k, w in weights.items()}


def stability_selection(df: DataFrame, features: list[str], labels: list[str], rid: str, times: int = 30, seed: int = 42) -> list[tuple]:
    """Share of 70 % resamples that select a feature: (feature, label, score_name, score, selection_frequency, samples, valid_resamples). All rows count; what leaves the tasks are sums by resample."""
    out = []
    filled = preprocess.impute(df, features)
    for y in labels:
        use = [f for f in features if f != y]
        known = filled.where(F.col(f"`{y}`").isNotNull())
        task = profile.task_by_distinct(profile.column_stats(known, [y])[y])
        classes = 0
        if task == "regression":
            known = known.withColumn("__y", num(known, y))
        else:
            known, names = preprocess.label_codes(known, y)
            known, classes = known.withColumn("__y", F.col(f"{y}__code").cast("double")), len(names)
        rows = cut(known.where("__y is not null").select(F.col(rid).alias("rid"), F.col("__y").alias("y"), F.array(*[F.col(f"`{f}`") for f in use]).alias("x")))
        n = rows.count()
        if n < LEAST_ROWS or not use or (task != "regression" and classes < 2):
            continue
        drawn = cut(sampling.resamples(rows, "rid", n, times, seed).join(rows, "rid").select("resample", "y", "x"))
        picked = select_by_lasso(drawn, len(use)) if task == "regression" else select_by_logistic(drawn, len(use), classes)
        for f, share in zip(use, np.mean(list(picked.values()), axis=0) if picked else [], strict=False):
            out.append((f, y, "selection_frequency", float(share), float(share), n, len(picked)))
    return sorted(out, key=lambda r: (-r[3], r[0], r[1]))
