"""Toxicity: a linear classifier over character n-grams, their presence scaled by naive Bayes log-count ratios.

Every n-gram counts: it belongs to one of 2^BITS buckets by its hash, and the buckets are the features.
Training reads a bounded sample of labelled rows: up to ``max_toxic`` and ``max_clean`` ids with the
smallest hashes, one row each. It is counted in how many sampled texts of each class each bucket
occurs; r_f is the log of the ratio of its smoothed shares of the two classes, 0 for buckets that no
sampled text has. A text's feature f is r_f / sqrt(its number of different buckets) if the text has the
bucket, else 0. A logistic regression over them is fitted by L-BFGS, in one task of an executor, which
holds at most 32 kB for each sampled text, however long. The driver gets its table of weights, of
1 MB, which scoring needs; every text is scored whole, in blocks.

N-grams are of lower-cased characters, with one space put before and after each text. Scores depend on
the text alone, so repeated rows and ties get equal scores. Defined results: null text counts as empty and, as
every text without n-grams, gets the score of the bias alone; very long texts are scored whole, one at a
time; rows with null ids or labels, or labels other than 0 and 1, teach nothing; of rows that repeat an
id the one with the smallest text teaches, an id with both labels teaches both; with no rows of one
class the model has no features and scores the share of class 1 (0.5 without any rows); empty tables get
no scores. Columns are taken by name and kept; a column that has the name of the score is replaced.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, mix, stash, text_buffer, trim
from .unit_cache import blocks

ORDERS = (3, 4, 5)
#: Bounds of the sample, and bits of a bucket's number.
MAX_TOXIC, MAX_CLEAN, BITS = 4000, 8000, 18
#: Tasks that cut the sample into buckets, buckets that are gone through at once, pseudo-count, ridge and steps of L-BFGS.
TASKS, HELD, ALPHA, RIDGE, STEPS = 8, 2_000_000, 1.0, 0.03, 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclasses.dataclass(frozen=True)
class Model:
    """weights: of each bucket, r included."""

    bias: float
    weights: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        """buckets: the different ones of a text."""
        z = self.bias + (float(self.weights[buckets].sum(dtype=np.float64)) / len(buckets) ** 0.5 if len(buckets) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the 64-bit hashes of all n-grams of the texts, end to end, and the text of each."""
    padded = [" " + t.lower() + " " for t in texts]
    sizes = np.array([len(t) for t in padded], np.int64)
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    h = chars + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        if len(chars) < n:
            return
        h = h[:-1] * _STEP + chars[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            inside = owner[: len(h)] == owner[n - 1 :]
            yield mix(h[inside] + np.uint64(n)), owner[: len(h)][inside]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in blocks of bounded size."""
    data, offsets = text_buffer(batch.column(column))
    for i, j in blocks(offsets):
        yield i, [data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in blocks of bounded size."""
    data, offsets = text_buffer(batch.column(column))
    for i, j in blocks(offsets):
        yield i, [data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)]


def presence(texts: list[str], seen: np.ndarray) -> Iterator[np.ndarray]:
    """The different buckets of each text, unsorted. seen: 2^BITS numbers of any content, to write on."""
    found = []
    for h, owner in ngrams(texts):
        found.append(((h >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()))
    for k in range(len(texts)):
        b = np.concatenate([x[at[k] : at[k + 1]] for x, at in found]) if found else np.zeros(0, np.int32)
        places = np.arange(len(b), dtype=np.int32)
        seen[b] = places
        yield b[seen[b] == places]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """label, text of the sampled rows: max_toxic + max_clean at most. So many ids are broadcast."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    by_hash = [F.xxhash64(F.col("id").cast("string")), F.col("id"), F.col("label")]
    ids = known.where("label = 1").orderBy(*by_hash).limit(max_toxic).unionByName(known.where("label = 0").orderBy(*by_hash).limit(max_clean))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    bound_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for first, texts in _texts(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([_hold(b) for b in presence(texts, seen)], pa.binary())], ["label", "buckets"])
        trim()

    rows = sample(docs, labels, id_col, text_col, label_col, max_toxic, max_clean).repartition(TASKS)
    stored = stash(rows.mapInArrow(extract, "label int, buckets binary"))
    bias, table = stored.coalesce(1).mapInArrow(_fit_rows, "bias double, weights binary").first()  # of at most max_toxic + max_clean rows
    return Model(bias, np.frombuffer(table, np.float32))


def _hold(buckets: np.ndarray) -> bytes:
    """A text's buckets, as marks if that is shorter: 2^BITS / 8 bytes at most."""
    if 32 * len(buckets) < 1 << BITS:
        return np.sort(buckets).astype(np.int32).tobytes()
    marks = np.zeros(1 << BITS, bool)
    marks[buckets] = True
    return np.packbits(marks).tobytes()


def _held(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32) if 8 * len(data) < 1 << BITS else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((y, b) for batch in batches for y, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))  # in an order that no schedule changes
    model = fit(np.array([y for y, _ in rows], float), [b for _, b in rows])
    del rows
    trim()
    yield pa.RecordBatch.from_pydict({"bias": [model.bias], "weights": pa.array([model.weights.tobytes()], pa.binary())})


def fit(y: np.ndarray, texts: list[bytes]) -> Model:
    """y: 0 or 1; texts: their buckets, by _hold()."""
    size, n = 1 << BITS, np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        share = (n[1] + 0.5) / (n.sum() + 1)
        return Model(float(np.log(share / (1 - share))), np.zeros(size, np.float32))

    def parts() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(texts, their buckets end to end, how many each has), of about HELD buckets."""
        i, held, total = 0, [], 0
        for k, data in enumerate(texts):
            held.append(_held(data))
            total += len(held[-1])
            if total >= HELD or k + 1 == len(texts):
                yield slice(i, k + 1), np.concatenate(held), np.array([len(x) for x in held])
                i, held, total = k + 1, [], 0

    ones, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for at, flat, sizes in parts():
        every += np.bincount(flat, minlength=size)
        ones += np.bincount(flat[np.repeat(y[at] == 1, sizes)], minlength=size)
    r = ratios(ones, every - ones, n)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log loss, both classes of equal weight, + ridge / 2n * |x|^2, and its gradient; the bias, last, is free."""
        table, value, grad, by_bias = x[:-1] * r, RIDGE / (2 * n.sum()) * float(x[:-1] @ x[:-1]), np.zeros(size), 0.0
        for at, flat, sizes in parts():
            scale = 1 / np.sqrt(np.maximum(sizes, 1))
            sums, ends = np.append(0, np.cumsum(table[flat])), np.cumsum(sizes)
            z = (sums[ends] - sums[ends - sizes]) * scale + x[-1]
            e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[at]) * share[at]
            value += float(share[at] @ (np.logaddexp(0, z) - y[at] * z))
            by_bias += float(e.sum())
            grad += np.bincount(flat, np.repeat(e * scale, sizes), size)
        return value, np.append(grad * r + RIDGE / n.sum() * x[:-1], by_bias)

    x = minimise(loss, np.zeros(size + 1))
    return Model(float(x[-1]), (x[:-1] * r).astype(np.float32))


def ratios(ones: np.ndarray, zeros: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log ratios of the smoothed shares of n[1] and n[0] texts; 0 for what no text has."""
    return np.log((ones + ALPHA * n[1] / n.sum()) / n[1]) - np.log((zeros + ALPHA * n[0] / n.sum()) / n[0])


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = STEPS, memory: int = 6) -> np.ndarray:
    """L-BFGS with halving steps."""
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = grad.copy(), []
        for s, t, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d -= alphas[-1] * t
        if past:
            s, t, _ = past[-1]
            d *= (s @ t) / (t @ t)
        for (s, t, rho), a in zip(past, reversed(alphas), strict=True):
            d += (a - rho * (t @ d)) * s
        slope, rate = -(grad @ d), 1.0 if past else 1 / max(1e-12, float(np.abs(grad).sum()))
        for _ in range(30):
            new, new_grad = loss(x - rate * d)
            if new <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        s, t = -rate * d, new_grad - grad
        if value - new < 1e-6 * max(1, abs(value)):
            break
        x, value, grad = x + s, new, new_grad
        if s @ t > 1e-12:
            past = [*past[1 - memory :], (s, t, 1 / (s @ t))]
    return x


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with their score; every other column is kept."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, texts in _texts(batch, at):
                out[first : first + len(texts)] = [model.score(b) for b in presence(texts, seen)]
            yield batch.append_column(name, pa.array(out))
        trim()

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(id_col: Column, remainder: int = 0) -> Column:
    """crc32 of the id as text, mod 5, is the remainder."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == remainder
