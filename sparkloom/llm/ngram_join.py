"""Jaccard join of documents on word n-grams, exact, by size bands and bitmap signatures.

A document's set holds its different n-word shingles, by 64-bit hash. Linked sets have sizes in the same
or neighbouring bands and differ in at most d shingles, d following from the band. So if the hash space is
cut into d + 1 + slack intervals, linked sets agree in more than slack of them; the hash of an interval's
shingles is a key. A set leaves out its lightest intervals, those with less than w shingles, for the
largest w that leaves out no more than slack: then linked sets agree in one that both send. Keys are
several shingles each, and the most frequent shingles (a table of bounded size) are left out of all sets
before, so passages that many documents share hardly make groups. Where more intervals than slack are
empty, the set also sends the first of its hashes, frequent ones last (prefix filter); two such sets that
link share one. No link is lost: candidates are
compared in size-banded tiles, where bit counts of bitmaps bound the overlap, and then exactly.

Size bands are used twice: keys hold the band, and clusters of more than a tile are cut by bands.

Defined results: null text, empty texts and texts without words have no set and are linked with nothing;
with fewer words than n, the whole sequence is the one shingle; very long texts are read whole, one at a
time, so a text has to fit a worker; rows with null id are linked with nothing and have no component;
repeated rows are in one component; a component's name is its least id, so there are no ties; an empty
table gives an empty result. Columns are taken by name; extra ones, whatever their names, don't matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, counted, cut, mix, spread_join, stash, trim, word_hashes
from .similarity import KEYS, SEND, Items, Method, bands, block_texts, clusters, linked, read_keys, signed

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PART = 4, 85
#: Intervals with so many shingles are always sent.
HEAVIEST = 6
#: Shingles that keys leave out: at most HOT, each in at least HOT_LEAST sets.
HOT, HOT_LEAST = 65_536, 50
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def items(texts: list[bytes], level: int, words: int = WORDS) -> Items:
    """One item a text; every level needs its sorted set."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    w, counts = word_hashes(data, np.cumsum([0, *map(len, texts)]))
    ends = np.cumsum(counts)
    h = w.copy()
    for k in range(1, min(words, len(w))):
        h[: len(w) - k] = h[: len(w) - k] * _A + w[k:]
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= words:
            sets.append(np.unique(mix(h[end - n : end - words + 1])))
        elif n:
            one = np.array([n], np.uint64)
            for x in w[end - n : end]:
                one = mix(one * _B + x)
            sets.append(one)
        else:
            sets.append(w[:0])
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, ends = (np.concatenate(sets) if sets else w[:0]), np.cumsum(sizes)
    node = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        node[full] = mix(np.add.reduceat(mix(flat ^ _B), (ends - sizes)[full]) + sizes[full].astype(np.uint64))
    return Items(np.arange(len(sets)), node, sizes, flat, ends)


@functools.lru_cache(maxsize=4)
def _bands(part: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes, and how many shingles linked sets of a band and the next can differ by."""
    starts = bands(part, 100, 1 << 40)
    most = starts[2:] - 1  # the largest size in a band or the next
    return starts[:-2], (100 - part) * 2 * most // (100 + part)


def read_sets(docs: DataFrame, words: int, id_col: str, text_col: str, least: int = HOT_LEAST, most: int = HOT) -> tuple[DataFrame, np.ndarray]:
    """Of one pass: a stored table of id, digest (of the text), n_shingles and node of each row; and the shingles of the most different sets: at most ``most`` hashes, of at least ``least`` sets each. Counted in blocks of sets, so that rare ones go nowhere."""

    def work(batches):
        sent: set[int] = set()
        waiting: list[np.ndarray] = []

        def made(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, fields.field(c).type) for c in names], names)

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return made(h=pa.array(signed(h[n >= 5])), n=pa.array(n[n >= 5].astype(np.int64)))

        from pyspark.sql.pandas.types import to_arrow_schema

        fields, names = to_arrow_schema(schema), schema.names
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, texts in block_texts(batch, 1):
                found = items(texts, KEYS, words)
                yield made(id=batch.column(0).slice(first, len(texts)), digest=batch.column(2).slice(first, len(texts)), n_shingles=pa.array(found.size), node=pa.array(signed(found.node)))
                use = np.flatnonzero((found.size > 0) & known[first : first + len(texts)])
                for k in use[np.unique(found.node[use], return_index=True)[1]].tolist():
                    if int(found.node[k]) not in sent:
                        sent.add(int(found.node[k]))
                        waiting.append(found.flat[found.ends[k] - found.size[k] : found.ends[k]])
                if sum(map(len, waiting)) >= SEND:
                    yield flush()
            if len(sent) > 1_000_000:
                sent.clear()
        if waiting:
            yield flush()
        trim()

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    of_row = [slim.schema["id"], *(T.StructField(c, T.LongType()) for c in ("digest", "n_shingles", "node"))]
    schema = T.StructType([*of_row, *(T.StructField(c, T.LongType()) for c in ("h", "n"))])
    stored = stash(slim.mapInArrow(work, schema))
    top = stored.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most)
    return stored.where("h is null").select([f.name for f in of_row]), np.sort(np.array([r.h for r in top.collect()], np.int64).view(np.uint64))


def keys(found: Items, part: int = PART, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets without hot shingles. Linked sets differ in no more shingles without than with them, so all that is said above holds."""
    starts, differ = _bands(part)
    own = np.searchsorted(starts, found.size, "right") - 1
    out = []
    begin = found.ends - found.size
    if hot is not None and len(hot):
        common = hot[np.minimum(np.searchsorted(hot, found.flat), len(hot) - 1)] == found.flat
    else:
        common = np.zeros(len(found.flat), bool)
    sets = [found.flat[a:b][~common[a:b]] for a, b in zip(begin.tolist(), found.ends.tolist(), strict=True)]
    for shift in (1, 0):
        window = own - shift
        use = np.flatnonzero((window >= 0) & (differ[np.maximum(window, 0)] > 0))
        if not len(use):
            continue
        window, d, size = window[use], differ[window[use]], np.array([len(sets[k]) for k in use.tolist()], np.int64)
        slack = d // 4 + 1
        parts = d + 1 + slack
        flat = np.concatenate([sets[k] for k in use.tolist()])
        item = np.repeat(np.arange(len(use)), size)
        interval = (flat >> np.uint64(32)) * parts[item].astype(np.uint64) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, (interval[1:] != interval[:-1]) | (item[1:] != item[:-1]))) if len(flat) else np.zeros(0, np.int64)
        total = np.add.reduceat(mix(flat ^ _A), first) if len(flat) else flat
        at, load = item[first], np.diff(np.append(first, len(flat))).astype(np.int64)
        light = parts - np.bincount(at, minlength=len(use))  # intervals with less than ``least`` shingles
        odd, least = np.flatnonzero(light > slack), np.ones(len(use), np.int64)
        for more in range(2, HEAVIEST + 1):
            light = light + np.bincount(at[load == more - 1], minlength=len(use))
            least[light <= slack] = more
        send = load >= least[at]
        key, at = mix(total + interval[first] * _B + window[item[first]].astype(np.uint64) * _A)[send], at[send]
        out.append((key, use[at]))
        for k in odd.tolist():
            a, b = begin[use[k]], found.ends[use[k]]
            n = b - a
            prefix = np.concatenate([sets[use[k]], found.flat[a:b][common[a:b]]])[: n - (part * n + 99) // 100 + 1]  # hot ones last
            out.append((mix(prefix * _B + mix(np.array([window[k]], np.uint64) + np.uint64(0x0DD))), np.full(len(prefix), use[k])))
    if not out:
        return found.flat[:0], np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in out]), np.concatenate([i for _, i in out])


def forms(text: bytes, nodes: set[int]) -> Iterator[tuple[int, bytes]]:
    """A text is one item, so the one node asked for is its own."""
    for node in nodes:
        yield node, text


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, part: int = PART) -> DataFrame:
    """Per row: id, digest (xxhash64 of the text), n_shingles, root (the component's node) and component (its least id). Rows without a set have neither, rows without id are in none."""
    rows, hot = read_sets(docs, words, id_col, text_col)
    method = Method(functools.partial(items, words=words), functools.partial(keys, part=part, hot=hot), forms, part)
    takes = F.coalesce((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.lit(False))
    # copies are one row from each task from here on
    nodes = cut(rows.where(takes).groupBy("node").agg(F.first("n_shingles").alias("size"), F.min("id").alias("least"), F.min(F.struct("id", "digest")).alias("at"), F.count("*").alias("n")))
    roots = linked(docs, nodes, cut(clusters(read_keys(docs, method, id_col, text_col))), method, id_col, text_col)
    some = nodes.select("node", "least", "n").join(roots, "node", "left").where("n > 1 or root is not null")
    rooted = cut(some.select("node", "least", F.col("n").alias("uses"), F.coalesce("root", "node").alias("root")))
    least, n = counted(rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")), F.sum("n"))
    told, n = counted(spread_join(rooted.select("root", "node", "uses"), least, "root", n).select("node", "root", "component", F.col("uses").alias("n")), F.sum("n"))
    joined = spread_join(rows.where(takes), told, "node", n, "left")
    alone = rows.where(~takes).select("id", "digest", "n_shingles", F.lit(None).cast("long").alias("root"), F.lit(None).cast(rows.schema["id"].dataType).alias("component"))
    return joined.select("id", "digest", "n_shingles", F.coalesce("root", "node").alias("root"), F.coalesce("component", "id").alias("component")).unionByName(alone)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, part: int = PART) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id of the component)."""
    out = members(docs, id_col, text_col, words, part)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))

