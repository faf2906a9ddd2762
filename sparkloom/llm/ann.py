"""Nearest neighbours by inner product through an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own centroids, about half the square root
of the number of vectors (at most CENTROIDS), fitted on a bounded sample (the PER_CENTROID vectors a
centroid with the smallest hashes of their ids). A pair of centroids is a cell; every vector is indexed. A query sorts the
centroids of either half by inner product and walks the pairs by descending sum with a heap, until the
cells taken hold ``reach`` vectors. The entries of those cells are ranked by their inner products on the
original vectors.

``reach`` is a number of vectors, measured on all of them: the true neighbours of TRIALS vectors are found
by brute force in one pass, and reach is the least that finds RECALL of them. It depends on the
structure of the data, not on how many there are: clustered vectors need few cells, vectors without any
structure need a large share (the README has figures).

Centroids are numbered so that near ones have near numbers, and cells are packed by both numbers' bits
in turn into blocks, so a query reaches few blocks. Cells larger than a block are split, and a block's
queries are cut into chunks of CHUNK, so no task holds more than one of each however common a vector is.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
with null id; vectors of different lengths are searched among those of their own length, of one
component on; scores are sums in order of the components, in double precision; ties go to the smaller id; a repeated row is
a candidate of its own, and only the query's own row is left out, so repeated rows of a query id give
its result once each; with fewer candidates than k all are returned; without vectors the result is empty.
Columns are taken by name; extra ones don't matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, partitions, stash

#: Centroids of a half at most, sampled vectors for each, rounds of k-means, recall and trials of the calibration.
CENTROIDS, PER_CENTROID, ROUNDS, RECALL, TRIALS = 1024, 32, 12, 0.95, 200
#: Vectors of a block at least and at most, queries of a chunk.
LEAST_BLOCK, BLOCK, CHUNK = 256, 8192, 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c[_by_nearness(c)]


def _by_nearness(c: np.ndarray) -> np.ndarray:
    """Numbers of the rows, halved again and again along their main direction."""
    if len(c) < 3 or not c.shape[1]:
        return np.arange(len(c))
    d = c - c.mean(0)
    order = np.argsort(d @ np.linalg.svd(d, full_matrices=False)[2][0], kind="stable")
    low, high = order[: len(c) // 2], order[len(c) // 2 :]
    return np.concatenate([low[_by_nearness(c[low])], high[_by_nearness(c[high])]])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By blocks of rows, so that the table of distances stays small."""
    norms = (c * c).sum(1)
    return np.concatenate([np.argmin(norms - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def packed(counts: np.ndarray, size: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell, and how many it is split over: cells in the order of the bits of both numbers in turn, up to ``block`` vectors."""
    i, j = np.divmod(np.arange(size * size, dtype=np.int64), size)
    key = np.zeros(size * size, np.int64)
    for b in range(max(1, int(size - 1).bit_length())):
        key |= (i >> b & 1) << (2 * b + 1) | (j >> b & 1) << (2 * b)
    first, pieces, at, held = np.zeros(size * size, np.int64), np.maximum(1, -(-counts // block)), 0, 0
    order = np.argsort(key, kind="stable")
    for c in order[counts[order] > 0].tolist():
        if held and held + counts[c] > block:
            at, held = at + 1, 0
        first[c] = at
        if pieces[c] > 1:
            at, held = at + int(pieces[c]), 0
        else:
            held += int(counts[c])
    return first, pieces


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells (i * len(b) + j) by descending a[i] + b[j] until they hold ``want`` vectors."""
    x, y, width = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable"), len(b)
    u, v, n = (-a[x]).tolist(), (-b[y]).tolist(), counts[np.ix_(x, y)].tolist()
    heap, reach, out, held = [(u[0] + v[0], 0, 0)], [0] * len(u), [], 0  # reach: how far each row has been taken
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        if n[i][j]:
            out.append(int(x[i]) * width + int(y[j]))
            held += n[i][j]
        reach[i] = j + 1
        if j + 1 < width and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
        if i + 1 < len(u) and reach[i + 1] == j:
            heapq.heappush(heap, (u[i + 1] + v[j], i + 1, j))
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of the components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _usable(v: Column, dim: int) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(ok, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), id, score of the k nearest rows found of each row for which is_query holds."""
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    lengths = [r["n"] for r in vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").collect()]  # a row a length
    found = [x for x in (_search(vectors, is_query, k, id_col, vector_col, recall, dim) for dim in lengths) if x is not None]
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


class Index:
    """Centroids, how many vectors each cell holds, and the stored vectors: id, v, query, cell, row."""

    def __init__(self, usable: DataFrame, dim: int) -> None:
        self.dim, self.half = dim, (dim + 1) // 2
        n = usable.count()
        wanted = 2 ** round(np.log2(max(1.0, n**0.5 / 2)))
        size = max(min(8, n), min(CENTROIDS, wanted))
        taken = usable.select("id", "v").orderBy(F.xxhash64(F.col("id").cast("string")), "id", "v").limit(max(TRIALS, PER_CENTROID * size)).toPandas()
        self.sample, self.sample_ids, rng = np.array(taken["v"].tolist(), float).reshape(-1, dim), taken["id"].tolist(), np.random.default_rng(7)
        self.size = size = min(size, len(self.sample))
        if not size:
            return
        half, left, right = self.half, _kmeans(self.sample[:, : self.half], size, rng), _kmeans(self.sample[:, self.half :], size, rng)
        self.left, self.right = left, right

        def index(batches):
            for batch in batches:
                x = _matrix(batch.column(1), dim)
                yield batch.append_column("cell", pa.array(nearest(x[:, :half], left) * size + nearest(x[:, half:], right), pa.int32()))

        numbered = usable.withColumn("row", F.monotonically_increasing_id())
        self.stored = stash(numbered.mapInArrow(index, T.StructType([*numbered.schema.fields, T.StructField("cell", T.IntegerType())])))
        self.counts = np.zeros(size * size, np.int64)
        for r in self.stored.groupBy("cell").count().toLocalIterator():  # CENTROIDS ** 2 rows at most
            self.counts[r[0]] = r[1]

    def reach(self, k: int, recall: float) -> int:
        """How many vectors a walk has to take to find this share of the true neighbours: of TRIALS vectors, by brute force over all."""
        trials, ids = self.sample[:TRIALS], np.array(self.sample_ids[:TRIALS], dtype=object)
        dim, half, size, left, right, counts = self.dim, self.half, self.size, self.left, self.right, self.counts

        def nearby(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.array(batch.column(0).to_pylist(), dtype=object)
                s = np.where(ids[:, None] == own[None, :], -np.inf, trials @ _matrix(batch.column(1), dim).T)
                most = min(k, s.shape[1])
                at = np.argpartition(-s, most - 1, axis=1)[:, :most]
                trial = np.repeat(np.arange(len(trials)), most)
                yield pa.RecordBatch.from_arrays([pa.array(trial, pa.int32()), pa.array(s[trial, at.ravel()]), batch.column(2).take(pa.array(at.ravel()))], ["trial", "score", "cell"])

        def places(table: pa.Table) -> pa.Table:
            """In the walk of the trial, how many vectors have been taken when the cell of each true neighbour has."""
            score, cell, t = table["score"].to_numpy(), table["cell"].to_numpy(), table["trial"][0].as_py()
            best = np.argsort(-score, kind="stable")[:k]
            best = best[np.isfinite(score[best])]
            held = np.flatnonzero(counts)
            sums = (left @ trials[t, :half])[held // size] + (right @ trials[t, half:])[held % size]
            order = np.argsort(-sums, kind="stable")
            taken = np.empty(size * size, np.int64)
            taken[held[order]] = np.cumsum(counts[held[order]])
            return pa.table({"place": taken[cell[best]]})

        found = self.stored.select("id", "v", "cell").mapInArrow(nearby, "trial int, score double, cell int").groupBy("trial").applyInArrow(places, "place long")
        place = found.toPandas()["place"].to_numpy()  # TRIALS * k numbers
        return int(np.quantile(place, recall, method="higher")) if len(place) else int(counts.sum())


def _search(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, recall: float, dim: int) -> DataFrame | None:
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    index = Index(vectors.where(_usable(v, dim) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")), dim)
    if not index.size:
        return None
    size, half, left, right, counts, indexed = index.size, index.half, index.left, index.right, index.counts, index.stored
    want = index.reach(k, recall)
    first, pieces = packed(counts, size, int(np.clip(counts.sum() // (2 * partitions(spark)), LEAST_BLOCK, BLOCK)))

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), dim)
            a, b, table = q[:, :half] @ left.T, q[:, half:] @ right.T, counts.reshape(size, size)
            at, blocks, cells = [], [], []
            for n in range(len(q)):
                taken = np.array(walk(a[n], b[n], table, want), np.int64)
                many = pieces[taken]
                block = np.repeat(first[taken], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                taken = np.repeat(taken, many)
                order = np.argsort(block, kind="stable")
                own, starts = np.unique(block[order], return_index=True)
                at += [n] * len(own)
                blocks += own.tolist()
                cells += np.split(taken[order], starts[1:])
            take = pa.array(at, pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.array(np.concatenate(cells) if cells else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column(0).take(take), batch.column(2).take(take), batch.column(1).take(take), listed], ["block", "id", "row", "v", "cells"])

    probes = stash(indexed.where("query").select("id", "v", "row").mapInArrow(probe, f"block long, id {kind}, row long, v array<double>, cells array<int>"))
    chunks = cut(probes.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")))

    def place(batches):
        for batch in batches:
            cell, row = batch.column(3).to_numpy(), batch.column(1).to_numpy()
            yield batch.append_column("block", pa.array(first[cell] + row % pieces[cell], pa.int64()))

    entries = indexed.select("id", "row", "v", "cell").mapInArrow(place, f"id {kind}, row long, v array<double>, cell int, block long").join(chunks, "block")
    entries = entries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    asked = probes.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks"))).drop("chunks")

    def rank(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not len(queries) or not len(found):
            return pa.table({"query_id": found["id"].slice(0, 0).combine_chunks(), "query_row": pa.array([], pa.int64()), "id": found["id"].slice(0, 0).combine_chunks(), "score": pa.array([], pa.float64())})
        found = found.sort_by([("id", "ascending"), ("row", "ascending")])
        queries = queries.sort_by([("row", "ascending")])
        x, cell, rows = _matrix(found["v"], dim), found["cell"].to_numpy(), found["row"].to_numpy()
        q, own = _matrix(queries["v"], dim), queries["row"].to_numpy()
        asked, at, best = queries["cells"].combine_chunks(), np.full(size * size, -1), []
        present = np.unique(cell)
        at[present] = np.arange(len(present))
        column = at[cell]
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            takes = np.zeros((len(part), len(present)), bool)
            for n in range(len(part)):
                takes[n, at[asked[i + n].values.to_numpy()]] = True
            ok = takes[:, column] & (rows[None] != own[i : i + 256, None])
            s = np.where(ok, part @ x.T, -np.inf)
            if s.shape[1] > k:  # the product of matrices may round differently for equal vectors, so all that is close stays
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                ok &= s >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None]
            n, m = np.nonzero(ok)
            score = exact(part[n], x[m])
            order = np.lexsort((m, -score, n))
            n, m, score = n[order], m[order], score[order]
            starts = np.searchsorted(n, np.arange(len(part)))
            keep = np.arange(len(n)) - starts[n] < k
            best.append((n[keep] + i, m[keep], score[keep]))
        n, m, score = (np.concatenate(c) for c in zip(*best, strict=True))
        return pa.table({"query_id": queries["id"].take(pa.array(n)).combine_chunks(), "query_row": own[n], "id": found["id"].take(pa.array(m)).combine_chunks(), "score": score})

    scored = asked.groupBy("block", "chunk").cogroup(entries.groupBy("block", "chunk")).applyInArrow(rank, f"query_id {kind}, query_row long, id {kind}, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
