"""Language-model scoring by deleted interpolation.

With h1 the token before w, h2 the one before that, and ORDER 3:

    P1(w)       = l1 * c(w) / N           + (1 - l1) / (V + 1)
    P2(w|h1)    = l2 * c(h1 w) / c(h1)    + (1 - l2) * P1(w)
    P3(w|h2 h1) = l3 * c(h2 h1 w) / c(h2 h1) + (1 - l3) * P2(w|h1)

Each l is a weight by bucket of the context's count (powers of two), 0 for contexts that weren't seen, and
is learned by expectation-maximisation on held-out counts: a twentieth of the training documents ("dev")
is set aside, the estimates come from the others, and the dev tokens are counted by cell (bucket, and
the ratio of the two estimates in eighths of an octave), a table of bounded size that EM runs on, from
the lowest order up. Final estimates count all training documents. Every P sums to 1 over the V known
tokens and one unknown.

No count table is broadcast or joined row by row. Documents are read into chunks of tokens. A chunk
asks for the counts of its different n-grams: requests are sorted hashes, as differences, with the
chunk's own counts, cut into ranges of the hash space, of which there are as many as the size of the
input asks for. A range adds up all chunks and replies to each in the order of its request, so the
replies of a chunk, end to end, align with its sorted hashes. A frequent word is one entry a chunk, so
no key weighs more than another. Counts are 64 bits wide. Words are known by 64-bit hashes, longer
n-grams by so many bits (64 at most) that one in about 2^17 is taken for another, at any size of input.

Defined results: null text counts as empty and is its end token alone; null ids belong to the training
documents; repeated rows are counted and scored as rows of their own; there are no ties to break; a very
long text is read whole, in one chunk, whatever CHUNK says, so it has to fit a worker; an empty table
gives an empty result; without training documents N and V are 0 and every token has probability 1, by the base and by the model;
without dev documents all weights are one half. Columns are taken by name; extra ones don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, input_bytes, mix, pack, partitions, release, squeeze, stash, text_buffer, trim, unpack, unsqueeze, word_hashes
from .toxicity import held_out

#: The remainder of crc32(id) mod 5 that is held out, and one in how many training documents is dev.
HELD_OUT, DEV_EVERY = 1, 20
#: Tokens of a chunk, about; bytes of text whose n-grams make a range; the longest n-gram.
CHUNK, RANGE, ORDER = 500_000, 4 << 20, 3
#: Hashes of the end of a text and of its start; the start occurs as a context only.
END, START = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x8CB92BA72F3D8DD7)
BUCKETS, STEPS = 64, 8
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chunk, kind (1: dev), ids, held, sizes (tokens with the end), words (sorted hashes, as differences), at (place of each token's word)."""
    held = F.coalesce(held_out(F.col(id_col), HELD_OUT), F.lit(False))
    dev = ~held & F.coalesce((F.crc32(F.concat(F.lit("dev"), F.col(id_col).cast("string")).cast("binary")) % DEV_EVERY == 0), F.lit(False))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held"), dev.cast("int").alias("kind"))
    id_type = slim.schema["id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        waiting: list[list] = [[], []]

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal made
            ids, held, sizes, hashes = zip(*waiting[kind], strict=True)
            waiting[kind] = []
            words, at = np.unique(np.concatenate(hashes), return_inverse=True)
            ids, held, sizes = pa.concat_arrays(ids), pa.concat_arrays(held), np.concatenate(sizes)
            made += 1
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([kind], pa.int32()), listed(ids), listed(held), pa.array([pack(sizes.astype(np.uint32))]), pa.array([pack(np.diff(words, prepend=np.uint64(0)))]), pa.array([squeeze(at)])], ["chunk", "kind", "ids", "held", "sizes", "words", "at"])

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            hashes, counts = word_hashes(data, offsets)
            sizes = counts + 1
            tokens = np.full(int(sizes.sum()), END)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(sizes) - 1] = False
            tokens[inner] = hashes
            kinds = batch.column(3).to_numpy()
            for kind in (0, 1):
                rows = np.flatnonzero(kinds == kind)
                if len(rows):
                    own = tokens[np.repeat(kinds == kind, sizes)]
                    waiting[kind].append((batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), sizes[rows], own))
                    if sum(len(x[3]) for x in waiting[kind]) >= CHUNK:
                        yield flush(kind)
        for kind in (0, 1):
            if waiting[kind]:
                yield flush(kind)
        trim()

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("at", T.BinaryType())])
    return slim.mapInArrow(read, schema)


def _words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(unpack(row["words"], np.uint64), dtype=np.uint64), unsqueeze(row["at"]), unpack(row["sizes"], np.uint32).astype(np.int64)


def _grams(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order: the different hashes, sorted, and the place of each token's n-gram (which ends with it) among them. Longer n-grams have ``bits`` bits, in the high ones."""
    yield words, at
    token, firsts, gram = words[at], np.cumsum(sizes) - sizes, words[at]
    for n in range(2, ORDER + 1):
        before = np.empty_like(token)  # the token n - 1 places before, or the start
        before[n - 1 :] = token[: len(token) - n + 1]
        for k in range(n - 1):
            before[(firsts + k)[k < sizes]] = START
        gram = mix(gram * _A + before * _B)
        keys, place = np.unique(gram >> np.uint64(64 - bits), return_inverse=True)
        yield keys << np.uint64(64 - bits), place


def _bits(docs: DataFrame) -> int:
    return min(64, 15 + max(24, input_bytes(docs).bit_length()))


def _requests(chunks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """group: the order and the range of hashes; chunk, kind, keys (differences), counts (in the training documents of the chunk)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(ranges, dtype=np.uint64) * np.uint64(2**64 // ranges)
        for batch in batches:
            for row in batch.to_pylist():
                words, at, sizes = _words(row)
                training = np.repeat(~np.array(row["held"], bool), sizes)
                for order, (keys, place) in enumerate(_grams(words, at, sizes, bits)):
                    counts = np.bincount(place[training], minlength=len(keys))
                    low = np.uint64(64 - bits if order else 0)
                    cuts = np.append(np.searchsorted(keys, edges), len(keys))
                    use = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(use + order * ranges, pa.int32()), pa.array([row["chunk"]] * len(use), pa.int64()), pa.array([row["kind"]] * len(use), pa.int32()),
                        pa.array([pack(np.diff(keys[cuts[b] : cuts[b + 1]] >> low, prepend=np.uint64(0))) for b in use], pa.binary()), pa.array([squeeze(counts[cuts[b] : cuts[b + 1]]) for b in use], pa.binary()),
                    ], ["group", "chunk", "kind", "keys", "counts"])
        trim()

    return chunks.select("chunk", "kind", "held", "sizes", "words", "at").mapInArrow(ask, "group int, chunk long, kind int, keys binary, counts binary")


def _reply(table: pa.Table) -> pa.Table:
    """all: counts over all training documents; core: without dev, for dev chunks. Chunk -1: how many n-grams were seen, in all and in core."""
    keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table["keys"].to_pylist()]
    sizes, kinds = [len(x) for x in keys], table["kind"].to_numpy()
    counts = np.concatenate([unsqueeze(x) for x in table["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    of_dev = np.repeat(kinds == 1, sizes)
    core, both = (np.zeros(int(place.max()) + 1, np.int64) for _ in range(2))
    np.add.at(core, place[~of_dev], counts[~of_dev])
    np.add.at(both, place, counts)
    ends = np.cumsum(sizes)
    parts = [(place[e - n : e], kind) for e, n, kind in zip(ends, sizes, kinds, strict=True)]
    del keys, counts, of_dev
    group = table["group"][0].as_py()
    return pa.table({
        "group": pa.array([group] * (len(parts) + 1), pa.int32()), "chunk": pa.concat_arrays([pa.array(table["chunk"].to_numpy()), pa.array([-1], pa.int64())]),
        "kind": pa.concat_arrays([pa.array(kinds, pa.int32()), pa.array([-1], pa.int32())]), "seen": pa.array([0] * len(parts) + [int((both > 0).sum())], pa.int64()), "seen_core": pa.array([0] * len(parts) + [int((core > 0).sum())], pa.int64()),
        "all": pa.array([squeeze(both[p]) for p, _ in parts] + [b""], pa.binary()), "core": pa.array([squeeze(core[p]) if kind else b"" for p, kind in parts] + [b""], pa.binary()),
    })


_REPLY = "group int, chunk long, kind int, seen long, seen_core long, all binary, core binary"


def _estimates(row: dict, replies: pa.Table, ranges: int, bits: int, column: str, total: int, docs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order, for each token: the context's count, the n-gram's share of it, and its count."""
    words, at, sizes = _words(row)
    told: list[list[bytes]] = [[] for _ in range(ORDER)]
    for group, packed in sorted(zip(replies["group"].to_pylist(), replies[column].to_pylist(), strict=True)):
        told[group // ranges].append(packed)
    first, before = np.cumsum(sizes) - sizes, np.full(len(at), float(total))
    for packed, (_, place) in zip(told, _grams(words, at, sizes, bits), strict=True):
        own = np.concatenate([unsqueeze(x) for x in packed])[place].astype(np.float64)
        packed.clear()
        yield before, np.divide(own, before, out=np.zeros(len(at)), where=before > 0), own
        before = np.append(0.0, own[:-1])  # the n-gram before is the context of the next order
        before[first] = docs


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + the floor of log2."""
    return np.minimum(BUCKETS - 1, np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0)).astype(np.int64)


def mix_in(p: np.ndarray, before: np.ndarray, share: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """P of an order from that of the order below."""
    part = weights[bucket(before)]
    return part * share + (1 - part) * p


def em(at: np.ndarray, ratio: np.ndarray, n: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights by bucket of the higher of two estimates, of which ratios are given. One pseudo-count each keeps weights off 0 and 1; bucket 0 has weight 0."""
    w = np.full(BUCKETS, 0.5)
    size = np.bincount(at, n, BUCKETS)
    for _ in range(steps):
        part = w[at]
        new = (np.bincount(at, n * part * ratio / (part * ratio + 1 - part), BUCKETS) + 1) / (size + 2)
        done, w = np.abs(new - w).max() < 1e-7, new
        if done:
            break
    w[0] = 0
    return w


def _cells(before: np.ndarray, share: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bucket and ratio of the estimates, of tokens whose context was seen."""
    use = before > 0
    ratio = share[use] / lower[use]
    step = np.where(ratio > 0, np.rint(np.log2(np.clip(ratio, 2.0**-100, 2.0**100)) * STEPS) + 1000, 0).astype(np.int64)
    return (bucket(before[use]) << 20) + step


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score; log10 throughout."""
    return model_and_score(docs, id_col, text_col)[1]


def model_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], DataFrame]:
    """The weights by order and bucket, and score()."""
    spark = docs.sparkSession
    bound_batches(spark)
    ranges = min(1 << 20, 4 * max(partitions(spark), -(-input_bytes(docs) // RANGE)))
    bits = _bits(docs)
    chunks = stash(_chunks(docs, id_col, text_col))
    replies = stash(_requests(chunks, ranges, bits).groupBy("group").applyInArrow(_reply, _REPLY))
    release(spark)  # the requests have been answered
    seen = replies.where(f"chunk = -1 and group < {ranges}").agg(F.sum("seen"), F.sum("seen_core")).first()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, held, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                sizes, use = unpack(packed, np.uint32).astype(np.int64), ~np.array(held, bool)
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "tokens": [int(sizes[use].sum())], "docs": [int(use.sum())]})

    known = {r["kind"]: r for r in chunks.select("kind", "held", "sizes").mapInArrow(tally, "kind int, tokens long, docs long").groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).collect()}
    core, core_docs = (known[0]["tokens"], known[0]["docs"]) if 0 in known else (0, 0)
    total, total_docs = core + (known[1]["tokens"] if 1 in known else 0), core_docs + (known[1]["docs"] if 1 in known else 0)
    distinct, distinct_core = seen[0] or 0, seen[1] or 0

    def count_cells(order: int, lower: list[np.ndarray]):
        def cells(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [np.zeros(0, np.int64)]
            for row in left.to_pylist():
                p = 1 / (distinct_core + 1)
                for k, (before, share, _) in enumerate(_estimates(row, right, ranges, bits, "core", core, core_docs)):
                    if k == order:
                        found.append(_cells(before, share, np.broadcast_to(p, len(before))))
                        break
                    p = mix_in(p, before, share, lower[k])
            cell, n = np.unique(np.concatenate(found), return_counts=True)
            trim()
            return pa.table({"cell": cell, "n": n.astype(np.int64)})

        return cells

    weights: list[np.ndarray] = []
    dev = chunks.where("kind = 1").groupBy("chunk").cogroup(replies.where("kind = 1").select("chunk", "group", "core").groupBy("chunk"))
    for order in range(ORDER):
        counted = dev.applyInArrow(count_cells(order, list(weights)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        cell = counted["cell"].to_numpy(np.int64)
        weights.append(em(cell >> 20, np.where(cell & 0xFFFFF, 2.0 ** (((cell & 0xFFFFF) - 1000) / STEPS), 0), counted["n"].to_numpy(float)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, ids, held in zip(left.drop_columns(["ids", "held"]).to_pylist(), left["ids"].combine_chunks(), left["held"].combine_chunks(), strict=True):
            sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            by = lambda x: np.bincount(owner, x, len(sizes))  # noqa: B023, E731
            p = 1 / (distinct + 1)
            for k, (before, share, own) in enumerate(_estimates(row, right, ranges, bits, "all", total, total_docs)):
                if not k:
                    known, base = by(own > 0).astype(np.int64), by(np.log10((own + 0.5) / (total + 0.5 * (distinct + 1))))
                p = mix_in(p, before, share, weights[k])
            out.append(pa.table({"id": ids.values, "held_out": held.values, "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(sizes), total, np.int64), "base_score": base, "score": by(np.log10(p))}))
        trim()
        return pa.concat_tables(out).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    arrow = to_arrow_schema(schema)
    joined = chunks.select("chunk", "ids", "held", "sizes", "words", "at").groupBy("chunk").cogroup(replies.where("chunk >= 0").select("chunk", "group", "all").groupBy("chunk"))
    return weights, joined.applyInArrow(finish, schema).withColumnRenamed("id", id_col)
