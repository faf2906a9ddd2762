"""Fuzzy line deduplication: MinHash, banding, exact Jaccard, distributed union-find.

Lines are compared by the character shingles of their normalised form (lower case, runs of white space
as one space, none at the ends); a form shorter than a shingle is its own one shingle. Equal forms are
one node. Signatures of BANDS * ROWS minima send a key for each band: lines of similarity 0.8 share one
with probability 0.998. Lines that share a key are candidates if their sketches, two bits of each of 64
minima, agree as those of such lines do. Candidates are compared exactly, linked from 0.8 on, and of each component the
line that comes first, by document id, digest of the text and place, stays. Blank lines take no part and
stay. ``min_chars`` spares lines with shorter forms, if wanted; without it none is.

Defined results: null text has no lines; an empty text has one, which is blank; rows with null id take
no part and get no dropped lines; repeated rows (same id and text) each get the result of one of them;
two texts of one id are two documents, ordered by digest; ties can't occur beyond that; empty tables give empty
results; very long texts and lines are read whole, a text in one piece, so one text has to fit a worker.
Columns are taken by name: extra ones, whatever their names, are kept by line_dedup() and ignored by
line_verdicts(); only names that begin with two underscores are reserved.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, mix, spread_join
from .similarity import NODES, SETS, SKETCH, Items, Method, clusters, hash_sets, linked, maybe_in, read_items

SHINGLE, PART, BANDS, ROWS, MIN_CHARS = 6, 80, 16, 5, 1
_RNG = np.random.default_rng(917)
_MULTIPLY = _RNG.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that are hashed at once: they stay in the processor's cache.
_BLOCK = 1 << 15


#: Fills short forms up to a shingle; no character of text.
_FILL = "\U0010ffff"


def normal_form(line: str) -> str:
    return " ".join(line.lower().split())


def _node(form: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(form, digest_size=8).digest(), "little") or 1


def items(texts: list[bytes], level: int, min_chars: int = MIN_CHARS) -> Items:
    """The lines of the texts. Without SETS, size counts shingles with their repetitions."""
    owner, node, kept, sizes = [], [], [], []
    for k, text in enumerate(texts):
        lines = text.decode("utf-8", "replace").lower().split("\n")
        owner.append(len(lines))
        for line in lines:
            form = " ".join(line.split())
            if len(form) < max(1, min_chars):
                node.append(0)
                sizes.append(0)
            else:
                node.append(_node(form.encode("utf-8", "replace")))
                sizes.append(max(1, len(form) - SHINGLE + 1))
                kept.append(form.ljust(SHINGLE, _FILL))
    owner, node, size = np.repeat(np.arange(len(texts)), owner), np.array(node, np.uint64), np.array(sizes, np.int64)
    if level == NODES:
        return Items(owner, node, size, np.zeros(0, np.uint64), np.zeros(len(size), np.int64))
    ends, flat = np.cumsum(size), np.zeros(int(size.sum()), np.uint64)
    lengths = np.array([len(x) for x in kept], np.int64)
    at, i = 0, 0
    until = np.cumsum(lengths)
    while i < len(kept):  # in blocks that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + _BLOCK, "right")))
        chars = np.frombuffer("".join(kept[i:j]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        h = chars[: len(chars) - SHINGLE + 1] + np.uint64(1)
        for k in range(1, SHINGLE):
            h *= _STEP
            h += chars[k : len(chars) - SHINGLE + 1 + k]
        whole = np.ones(len(h), bool)  # shingles that lie in one line
        edges = (until[i : j - 1] - (until[i - 1] if i else 0))[:, None] - np.arange(1, SHINGLE)
        whole[edges.ravel()] = False
        h = mix(h[whole])
        flat[at : at + len(h)] = h
        at, i = at + len(h), j
    if level == SETS:
        flat, ends = hash_sets(flat, ends)
        size = np.diff(np.append(0, ends))
    return Items(owner, node, size, flat, ends)


def forms(text: bytes, nodes: set[int]) -> Iterator[tuple[int, bytes]]:
    """(node, normal form) of the lines whose nodes are asked for, each once."""
    left = set(nodes)
    for line in text.decode("utf-8", "replace").lower().split("\n"):
        form = " ".join(line.split()).encode("utf-8", "replace")
        node = _node(form)
        node -= (node >= 1 << 63) << 64
        if node in left:
            left.remove(node)
            yield node, form
            if not left:
                return


def keys(found: Items) -> tuple[np.ndarray, np.ndarray]:
    return keys_and_sketches(found)[:2]


def keys_and_sketches(found: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys(), and two words of each item: a bit each of SKETCH minima."""
    starts = found.ends - found.size
    base = (found.flat >> np.uint64(32)).astype(np.uint32)
    lows = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    i, n = 0, len(starts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(found.ends, starts[i] + _BLOCK, "right"))))
        part, at = base[starts[i] : found.ends[j - 1]], starts[i:j] - starts[i]
        h = np.empty_like(part)
        for k in range(BANDS * ROWS):  # hashes of hashes: an odd multiplier permutes them
            np.multiply(part, _MULTIPLY[k], out=h)
            np.minimum.reduceat(h, at, out=lows[k, i:j])
        i = j
    out = []
    for b in range(BANDS):
        key = np.full(n, b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * _STEP + lows[b * ROWS + r])
        out.append(key)
    two = (lows[:SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(30)
    halves = [np.ascontiguousarray(np.packbits((two >> np.uint32(k) & np.uint32(1)).astype(np.uint8), axis=0).T).view(np.uint64).reshape(n) for k in range(2)]
    sketch = np.stack(halves, axis=1)
    return np.concatenate(out) if n else found.flat[:0], np.tile(np.arange(n), BANDS), sketch


def _dropped(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(rows of read_items(), id, digest and dropped of the texts that have lines to drop)."""
    method = Method(functools.partial(items, min_chars=min_chars), keys_and_sketches, forms, PART, sized=False, sketched=True)
    rows, blocks = read_items(docs, method, id_col, text_col)
    lines = rows.where("id is not null").select("id", "digest", F.posexplode(F.arrays_zip("nodes", "sizes")).alias("line", "x")).where("x.sizes > 0").select("id", "digest", "line", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("size"))
    # a frequent line is one row from each task from here on
    nodes = cut(lines.groupBy("node").agg(F.first("size").alias("size"), F.min(F.struct("id", "digest", "line")).alias("first"), F.count("*").alias("n")))
    roots = linked(docs, nodes.select("node", "size", F.struct("first.id", "first.digest").alias("at")), cut(clusters(blocks, method.sketched)), method, id_col, text_col)
    some = nodes.select("node", "first", "n").join(roots, "node", "left").where("n > 1 or root is not null")
    rooted = cut(some.select("node", "first", F.col("n").alias("uses"), F.coalesce("root", "node").alias("root")))
    keeper, n = counted(rooted.groupBy("root").agg(F.min("first").alias("keeper"), F.count("*").alias("n")), F.sum("n"))
    told, n = counted(spread_join(rooted.select("root", "node", "uses"), keeper, "root", n).select("node", "keeper", F.col("uses").alias("n")), F.sum("n"))
    gone = spread_join(lines.drop("size"), told, "node", n).where(F.struct("id", "digest", "line") != F.col("keeper"))
    return rows, gone.groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("line", F.col("keeper.id").alias("keeper")))).alias("dropped"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: id, digest (xxhash64 of the text), n_lines, dropped: structs of line (from 0) and keeper, the id of the document whose line stays."""
    rows, told = _dropped(docs, id_col, text_col, min_chars)
    none = F.array().cast(told.schema["dropped"].dataType)
    return rows.select("id", "digest", F.size("nodes").cast("long").alias("n_lines")).join(told, ["id", "digest"], "left").withColumn("dropped", F.coalesce("dropped", none)).withColumnRenamed("id", id_col)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the dropped lines. A document all of whose lines go is dropped; one that had none that take part stays."""
    told = _dropped(docs, id_col, text_col, min_chars)[1]
    gone, n = counted(told.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.transform("dropped", lambda x: x["line"]).alias("__gone")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("__id", F.col(id_col)).withColumn("__digest", F.xxhash64(text))
    maybe, rest = maybe_in(marked, gone, ["__id", "__digest"], n)  # most texts aren't shuffled
    joined = maybe.join(gone, ["__id", "__digest"], "left")
    lines = F.split(text, "\n", -1)
    stay = F.filter(lines, lambda _, i: ~F.array_contains(F.col("__gone"), i))
    kept = joined.where(F.col("__gone").isNull() | F.exists(stay, lambda x: F.trim(x) != ""))
    return kept.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))).select(*docs.columns).unionByName(rest.select(*docs.columns))
