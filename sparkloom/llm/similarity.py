"""Similar sets of hashes in a corpus: candidate groups, distributed components, exact tiles.

Both similarity joins are made of the same steps. They differ in how a text is cut into items (one set
of hashes each) and in the keys of an item.

1. Texts are read once. Each item gets a node number, the hash of its set or line, so equal items are
   one node however often they occur. A task sends the keys of a node once, in sorted blocks by range of
   keys; there are as many ranges as the size of the input asks for.
2. In a range, nodes with a common key form a group; a group is kept as a star, never as pairs, and the
   stars of a range are merged before they leave it. With sketches of the nodes, groups of bounded size
   are judged by these first, so chance doesn't connect them.
3. Connected components over the stars give clusters. Every linked pair lies within one.
4. The clusters' nodes are cut out of their texts, as text, and compared in tiles, which make the sets.
   Small clusters are one tile. Large ones are split by bands of set size and then by hash. In a tile
   only sets of sizes that can link meet: a bitmap of each bounds overlaps from above, pairs that are
   already connected are skipped, and the rest are intersected exactly.
5. A tile of a large cluster also meets about PIVOTS nodes of its band and of each band next to it. That
   connects nearly all of a group of copies, however large, at one copy of each node. What isn't in the
   cluster's largest component then (the rest) meets the tiles of its band and those next to it, so no
   link is lost: a node is copied once for each tile of the rest. Only a cluster most of which doesn't
   hang together costs more than in proportion to its size.
6. Components over the links found.

Nothing of this is collected by the driver. Joins on nodes and roots broadcast the few that hold a
thousandth of all rows or more and shuffle the rest.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, bound_batches, counted, cut, discard, input_bytes, mix, pack, partitions, spread_join, stash, stashed, text_buffer, trim, unpack
from .unit_cache import blocks

#: Members of a tile, those of a band that all its tiles meet, least words of a bitmap, keys that a task gathers before it sends them, hashes in a task of tiles.
TILE, PIVOTS, WORDS, SEND, TASK = 4096, 256, 16, 1_000_000, 4_000_000
#: Bytes of text whose keys make a range, and edges that one task connects (16 bytes each).
RANGE, ONE_TASK = 8 << 20, 1_000_000
#: Bits of a key that stay behind.
DROPPED = np.uint64(16)
#: Minima of a sketch, of which linked sets agree in AGREE at least, but for one pair in some ten million at the threshold; members of a group up to which its pairs are judged by their sketches, and such that a task judges.
SKETCH, AGREE, JUDGED, JUDGE = 64, 36, 16_384, 1_000_000
#: What items() is asked for: node and size of each item; hashes for keys too; sorted different hashes.
NODES, KEYS, SETS = 0, 1, 2


@dataclasses.dataclass
class Items:
    """Items of a block of texts, in order. size 0: an item that takes no part. ends: of its hashes in flat."""

    owner: np.ndarray
    node: np.ndarray
    size: np.ndarray
    flat: np.ndarray
    ends: np.ndarray


@dataclasses.dataclass(frozen=True)
class Method:
    """items(texts, level) -> Items, by NODES, KEYS or SETS; keys(Items) -> (keys, item of each key), and sketches (two words an item) if ``sketched``.

    forms(text, nodes) gives (node, form) of the asked nodes that the text has; a form is a text whose
    one item of SETS is the node's. Two sets link when whole * intersection >= part * union.
    """

    items: Callable[[list[bytes], int], Items]
    keys: Callable[[Items], tuple[np.ndarray, ...]]
    forms: Callable[[bytes, set[int]], Iterator[tuple[int, bytes]]]
    part: int
    whole: int = 100
    sized: bool = True  # sizes are those of the sets already by NODES
    sketched: bool = False

    def needed(self, total: np.ndarray) -> np.ndarray:
        """Least intersection of linked sets whose sizes add up to total."""
        return -(-self.part * total // (self.part + self.whole))


def bands(part: int, whole: int, most: int) -> np.ndarray:
    """First sizes of bands so wide that linked sets are in the same or neighbouring bands."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, whole * (out[-1] - 1) // part + 1))
    return np.array(out, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# Components -----------------------------------------------------------------------------------


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) over edges of arrays."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, root: the least node of its component, for every node of an edge between two.

    Up to ONE_TASK counted edges are connected by one task, beyond that by rounds of large-star and small-star
    over tables, until a round changes nothing. The result is the same.
    """
    stars, n = counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    if n <= ONE_TASK:
        return stars.coalesce(1).mapInArrow(_connect, "node long, root long")
    kept, stars, state = stashed(), stash(stars.distinct()), None
    while True:
        told = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (told.n, told.x) == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (told.n, told.x)
        least = stash(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n"))
        large = stash(spread_join(stars, least, "v", 2 * told.n).select("u", F.col("m").alias("v")).where("u <> v").distinct())
        least = stash(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, least, "u", told.n)
        stars = stash(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        discard(stars.sparkSession, kept, 1)


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if found:
        node, root = local_roots(*(np.concatenate(x) for x in zip(*found, strict=True)))
        for i in range(0, len(node), SEND):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + SEND]), pa.array(root[i : i + SEND])], ["node", "root"])


# Reading --------------------------------------------------------------------------------------


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def block_texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in blocks of bounded size."""
    data, offsets = text_buffer(batch.column(column))
    for i, j in blocks(offsets):
        yield i, [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]


_OF_KEYS = [T.StructField("group", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("keys", "members", "places"))]


def read_items(docs: DataFrame, method: Method, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two stored tables of one pass. Of each row: id, digest (of the text), nodes and sizes of its items. Of keys: see read_keys()."""
    slim = _slim(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    of_row = [slim.schema["id"], T.StructField("digest", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType()))]
    stored = stash(_keyed(docs, slim, method, of_row))
    return stored.where("group is null").select([f.name for f in of_row]), stored.where("group is not null").select([f.name for f in _OF_KEYS])


def read_keys(docs: DataFrame, method: Method, id_col: str, text_col: str) -> DataFrame:
    """group (a range of keys), keys, members, places (of the keys' nodes among the members; none if each key has its own); group -1: sketches (keys) of members. Not stored: for one reader, whose shuffle is then their only copy on disk.

    A task sends the keys of a node once; rows without id send none. The low bits of keys stay behind: keys only name candidates.
    """
    return _keyed(docs, _slim(docs, id_col, text_col).where("id is not null"), method, [])


def _keyed(docs: DataFrame, slim: DataFrame, method: Method, of_row: list[T.StructField]) -> DataFrame:
    """Rows of the columns of_row, if there are any, and of keys, in one pass over slim, the columns of docs that it takes."""
    bound_batches(docs.sparkSession)
    ranges = min(1 << 20, 4 * max(partitions(docs.sparkSession), -(-input_bytes(docs) // RANGE)))  # several to a task, so that tasks are even
    schema = T.StructType([*of_row, *_OF_KEYS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields, names = to_arrow_schema(schema), schema.names
        edges = np.arange(ranges, dtype=np.uint64) * np.uint64(2**64 // ranges)
        sent: set[int] = set()
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        drawn: list[tuple[np.ndarray, np.ndarray]] = []

        def made(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, fields.field(c).type) for c in names], names)

        def flush() -> pa.RecordBatch:
            keys, nodes = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            order = np.argsort(keys)
            keys, nodes = keys[order], nodes[order]
            cuts = np.append(np.searchsorted(keys, edges), len(keys))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                part, at = nodes[cuts[b] : cuts[b + 1]], keys[cuts[b] : cuts[b + 1]] >> DROPPED
                own, place = np.unique(part, return_inverse=True)
                alone = 2 * len(own) > len(part)
                rows.append((int(b), pack(at), pack(part if alone else own), b"" if alone else pack(place.astype(np.uint32))))
            return made({c.name: pa.array(x, fields.field(c.name).type) for c, x in zip(_OF_KEYS, zip(*rows, strict=True), strict=True)})

        def sketches() -> pa.RecordBatch:
            nodes, words = (np.concatenate(x) for x in zip(*drawn, strict=True))
            drawn.clear()
            return made({c.name: pa.array([x], fields.field(c.name).type) for c, x in zip(_OF_KEYS, (-1, words.tobytes(), nodes.tobytes(), b""), strict=True)})

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, texts in block_texts(batch, 1):
                items, n = method.items(texts, KEYS), len(texts)
                if of_row:
                    held = pa.array(np.searchsorted(items.owner, np.arange(n + 1)), pa.int32())
                    listed = lambda x: pa.ListArray.from_arrays(held, pa.array(x, pa.int64()))  # noqa: B023, E731
                    yield made({"id": batch.column(0).slice(first, n), "digest": batch.column(2).slice(first, n), "nodes": listed(signed(items.node)), "sizes": listed(items.size)})
                use = np.flatnonzero((items.size > 0) & known[first + items.owner])
                use = np.sort(use[np.unique(items.node[use], return_index=True)[1]])
                use = np.array([k for k, x in zip(use.tolist(), items.node[use].tolist(), strict=True) if x not in sent], np.int64)
                if len(use):
                    sent.update(items.node[use].tolist())
                    keys, place, *sketch = method.keys(_take(items, use))
                    if len(keys):
                        waiting.append((keys, items.node[use][place]))
                    if sketch:
                        drawn.append((items.node[use], sketch[0]))
                    if sum(len(x[0]) for x in waiting) >= SEND:
                        yield flush()
                        if drawn:
                            yield sketches()
            if len(sent) > 1_000_000:
                sent.clear()
        if waiting:
            yield flush()
        if drawn:
            yield sketches()
        trim()

    return slim.mapInArrow(work, schema)


def _take(items: Items, use: np.ndarray) -> Items:
    starts = np.append(0, items.ends[:-1])
    sizes = (items.ends - starts)[use]
    ends = np.cumsum(sizes)
    flat = items.flat[np.repeat(starts[use] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return Items(items.owner[use], items.node[use], items.size[use], flat, ends)


def clusters(rows: DataFrame, sketched: bool = False) -> DataFrame:
    """node, root over the groups of nodes with a common key; rows: those of read_keys().

    Sets that have little in common share keys by chance. The number of such pairs grows with the square of the
    corpus, until they connect nearly all of it. With sketches, a group of up to JUDGED nodes connects those
    whose sketches agree as those of linked sets do.
    """

    def groups(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x, np.uint64) for x in table["keys"].to_pylist()])
        nodes = np.concatenate([unpack(m, np.uint64)[unpack(p, np.uint32)] if p else unpack(m, np.uint64) for m, p in zip(table["members"].to_pylist(), table["places"].to_pylist(), strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], signed(nodes[order])
        same = keys[1:] == keys[:-1]
        shared = np.append(False, same) | np.append(same, False)
        keys, nodes = keys[shared], nodes[shared]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]  # several tasks may have sent a node
        keys, nodes = keys[fresh], nodes[fresh]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        held = np.diff(np.append(first, len(keys)))
        root = np.repeat(nodes[first], held)
        stars = np.repeat(held > JUDGED if sketched else held > 1, held) & (root != nodes)
        node, root = local_roots(nodes[stars], root[stars]) if stars.any() else (nodes[:0], nodes[:0])
        a, b = nodes[:0], nodes[:0]
        if sketched and len(keys):
            name = np.add.reduceat(mix(nodes.view(np.uint64)), first)  # groups of the same members are one
            once = np.zeros(len(first), bool)
            once[np.unique(name, return_index=True)[1]] = True
            use = np.repeat(once & (held > 1) & (held <= JUDGED), held)
            a, b = nodes[use], signed(np.repeat(name, held)[use])
        del keys, nodes, order, shared, fresh
        trim()
        return pa.table({"a": np.append(node[node != root], a), "b": np.append(root[node != root], b), "judge": np.repeat([False, True], [int((node != root).sum()), len(a)])})

    found = rows.where("group >= 0").groupBy("group").applyInArrow(groups, "a long, b long, judge boolean")
    if not sketched:
        return components(found.select("a", "b"))
    found = stash(found)
    judged = _agreeing(found.where("judge").select(F.col("a").alias("node"), F.col("b").alias("name")).distinct(), rows.where("group = -1"))
    return components(found.where("not judge").select("a", "b").unionByName(judged))


def agreeing(name: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, another one) that connect the nodes of each group, in order of name, that hang together by agreeing sketches."""
    x, y = x.view(np.uint64), y.view(np.uint64)  # of signed numbers, only the bits of the absolute value count
    near = lambda i, j: np.bitwise_count((x[i] ^ x[j]) | (y[i] ^ y[j])) <= SKETCH - AGREE
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
    held = np.diff(np.append(first, len(name)))
    a, b = [node[:0]], [node[:0]]
    most = 8
    few = np.repeat(held <= most, held)
    for k in range(1, most):
        at = np.flatnonzero((name[k:] == name[:-k]) & few[k:])
        at = at[near(at, at + k)]
        a.append(node[at])
        b.append(node[at + k])
    for start, n in zip(first[held > most].tolist(), held[held > most].tolist(), strict=True):
        left, ready = np.arange(start + 1, start + n), [start]
        while len(left):
            at = ready.pop() if ready else left[0]
            left = left[left != at]
            hit = near(at, left)
            a.append(node[left[hit]])
            b.append(np.full(int(hit.sum()), node[at]))
            ready += left[hit].tolist()
            left = left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _agreeing(members: DataFrame, drawn: DataFrame) -> DataFrame:
    """a, b: agreeing() over members (node, name of the group); drawn: rows of sketches."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, words in zip(batch.column(0), batch.column(1), strict=True):
                two = np.frombuffer(words.as_py(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes.as_py(), np.int64)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["node", "x", "y"])
        trim()

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("name", "ascending"), ("node", "ascending")])
        name, node, x, y = (table[c].to_numpy() for c in ("name", "node", "x", "y"))
        a, b = agreeing(name, node, x, y)
        del table, name, node, x, y
        trim()
        return pa.table({"a": a, "b": b})

    members, n = counted(members)
    if not n:
        return members.select(F.col("node").alias("a"), F.col("name").alias("b"))
    asked = cut(members.select("node").distinct())
    told = maybe_in(drawn.select("members", "keys").mapInArrow(spread, "node long, x long, y long"), asked, ["node"])[0].groupBy("node").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    tasks = max(partitions(members.sparkSession), -(-n // JUDGE))
    return members.join(told, "node").withColumn("task", F.pmod(F.xxhash64("name"), F.lit(tasks))).groupBy("task").applyInArrow(judge, "a long, b long")


# Tiles ----------------------------------------------------------------------------------------


def _bitmaps(flat: np.ndarray, ends: np.ndarray, words: int = WORDS) -> np.ndarray:
    sizes, width, maps = np.diff(np.append(0, ends)), words * 64, []
    step = max(1, (8 << 20) // width)
    for i in range(0, len(ends), step):
        own = sizes[i : i + step]
        bits = np.zeros((len(own), width), bool)
        bits[np.repeat(np.arange(len(own)), own), (flat[ends[i] - own[0] : ends[i + len(own) - 1]] >> np.uint64(17)) % np.uint64(width)] = True
        maps.append(np.packbits(bits, axis=1).view(np.uint64))
    return np.concatenate(maps)


def link(sets: list[np.ndarray], side: np.ndarray, method: Method) -> np.ndarray:
    """The least position connected with each set, over exact links between sets of different sides, or of side 0.

    Bitmaps have as many bits as the sets have hashes or more: full ones rule nothing out.
    """
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    ordered, sides = size[order], side[order]
    reach = np.searchsorted(ordered, method.whole * ordered // method.part, "right")
    words = np.maximum(WORDS, 1 << np.ceil(np.log2(np.maximum(ordered, 1) / 64)).astype(np.int64).clip(0))
    for begin in np.unique(words, return_index=True)[1].tolist():
        end = int(np.searchsorted(words, words[begin], "right"))
        among = [sets[k] for k in order[begin : reach[end - 1]]]
        maps = _bitmaps(np.concatenate(among), np.cumsum([len(x) for x in among]), int(words[begin]))
        held = np.bitwise_count(maps).sum(1, dtype=np.int64)
        for i in range(begin, end):
            if reach[i] <= i + 1:
                continue
            others, at = slice(i + 1, reach[i]), slice(i + 1 - begin, reach[i] - begin)
            need = method.needed(ordered[i] + ordered[others])
            both = np.bitwise_count(maps[i - begin] & maps[at]).sum(1, dtype=np.int64)
            short = np.minimum(ordered[i] - held[i - begin], ordered[others] - held[at]) + both
            near = np.flatnonzero((short >= need) & ((sides[others] != sides[i]) | (sides[i] == 0)))
            x = order[i]
            for k in near.tolist():
                y = order[i + 1 + k]
                if label[x] != label[y]:
                    a, b = sets[x], sets[y]
                    at_b = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    if int((b[at_b] == a).sum()) >= need[k]:
                        low, high = sorted((label[x], label[y]))
                        label[label == high] = low
    return label


def linked(docs: DataFrame, nodes: DataFrame, found: DataFrame, method: Method, id_col: str, text_col: str) -> DataFrame:
    """node, root: exact components of nodes with a link. nodes: one row a node, with size and at (struct of id and digest) of a text that holds it; found: clusters()."""
    where, total = counted(nodes.select("node", "size", "at").join(found, "node"), F.sum("size"))
    if not total:
        return found.limit(0)
    tasks = max(partitions(docs.sparkSession), -(-total // TASK))
    compared = lambda units: _tiles(_forms(docs, units, method, id_col, text_col), tasks, method)
    large, n = counted(where.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > TILE), F.sum("n"))
    alone = F.array(F.struct(F.col("root").alias("unit"), F.lit(0).alias("side")))
    if not n:
        return components(compared(where.select("node", "at", alone.alias("units"))))
    frequent = F.broadcast(large.where(F.col("n") * HOT_SHARE > n).select("root"))  # fewer than HOT_SHARE rows
    small = where.join(frequent, "root", "left_anti").join(large.select("root"), "root", "left_anti")
    dealt, plan = _deal(where, large, n, method)
    first = dealt.select("node", "at", _first_units(dealt).alias("units"))
    edges = cut(compared(small.select("node", "at", alone.alias("units")).unionByName(first)))
    rest, m = counted(_rest_units(dealt, plan, components(edges), n))
    return components(edges.unionByName(compared(rest)) if m else edges)


def _forms(docs: DataFrame, units: DataFrame, method: Method, id_col: str, text_col: str) -> DataFrame:
    """unit, side, node, form of the nodes; units: node, at, units (where the node goes, and on which side)."""
    wanted, n = counted(units.groupBy("at").agg(F.collect_list(F.struct("node", "units")).alias("wanted")).select("at.id", "at.digest", "wanted"))  # within one text
    texts = maybe_in(_slim(docs, id_col, text_col).withColumn("digest", F.xxhash64("text")), wanted, ["id", "digest"], n)[0].join(wanted, ["id", "digest"]).select("text", "wanted")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            for first, texts in block_texts(batch, 0):
                for k, text in enumerate(texts):
                    want = {x["node"]: x["units"] for x in asked[first + k].as_py()}
                    out = [(u["unit"], u["side"], node, form) for node, form in method.forms(text, set(want)) for u in want[node]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["unit", "side", "node", "form"])
        trim()

    return texts.mapInArrow(extract, "unit long, side int, node long, form binary")


_UNITS = "array<struct<unit:long,side:int>>"


def _deal(where: DataFrame, large: DataFrame, n: int, method: Method) -> tuple[DataFrame, DataFrame]:
    """Of the nodes of large clusters: node, at, root, band, tile, pivot, and how many tiles the band (tiles), the next (after) and the one before have; and the bands: root, band, n."""
    of = spread_join(where.select("root", "node", "size", "at"), large, "root", n).select("root", "node", "at", (_band(F.col("size"), method) if method.sized else F.lit(0)).alias("band"))
    count = cut(of.groupBy("root", "band").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("long")))
    plan = cut(_beside(count, "tiles"))
    dealt = spread_join(of, plan, ["root", "band"], n).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    return dealt.withColumn("pivot", F.pmod(F.xxhash64("node", F.lit(1)), F.col("many")) == 0), plan


def _beside(count: DataFrame, tiles: str) -> DataFrame:
    """count (root, band, n, tiles) with the tiles of the next band and the one before, and many: one in how many nodes is a pivot."""
    after = count.select("root", (F.col("band") - 1).alias("band"), F.col(tiles).alias("after"))
    before = count.select("root", (F.col("band") + 1).alias("band"), F.col(tiles).alias("before"))
    return count.join(after, ["root", "band"], "left").join(before, ["root", "band"], "left").na.fill(0, ["after", "before"]).withColumn("many", F.ceil(F.col("n") / PIVOTS))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))


def _first_units(dealt: DataFrame) -> Column:
    """A node's own tile, side 0; a pivot also meets all other tiles of its band and of those next to it, on side 2."""
    unit = lambda b, t, side: F.struct(F.xxhash64("root", b, t).alias("unit"), F.lit(side).alias("side"))
    band = F.col("band")
    others = F.concat(
        F.transform(F.filter(_upto(F.col("tiles")), lambda t: t != F.col("tile")), lambda t: unit(band, t, 2)),
        F.transform(_upto(F.col("after")), lambda t: unit(band + 1, t, 2)), F.transform(_upto(F.col("before")), lambda t: unit(band - 1, t, 2)),
    )
    return F.concat(F.array(unit(band, F.col("tile"), 0)), F.when(F.col("pivot"), others).otherwise(F.array().cast(_UNITS)))


def _rest_units(dealt: DataFrame, plan: DataFrame, exact: DataFrame, n: int) -> DataFrame:
    """node, at, units: the nodes of the rest, in tiles of their own (side 1), meet all nodes of their band and of those next to it (side 2)."""
    told = cut(dealt.join(exact.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")).select("node", "at", "root", "band", "tile", "tiles", "after", "before", "label"))
    parts = told.groupBy("root", "label").agg(F.count("*").alias("size"))
    main = cut(parts.groupBy("root").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.sum("size").alias("n")))
    marked = cut(spread_join(told, main, "root", n).withColumn("rest", F.col("label") != F.col("main")))
    count = cut(marked.where("rest").groupBy("root", "band").agg(F.count("*").alias("left")).withColumn("own", F.ceil(F.col("left") / TILE).cast("long")))
    # the rest's tiles in each band, the next and the one before; bands without a rest too
    every = cut(_beside(plan.select("root", "band", "n").join(count.select("root", "band", "own"), ["root", "band"], "left").na.fill(0, ["own"]), "own").select("root", "band", "n", "own", F.col("after").alias("own_after"), F.col("before").alias("own_before")))
    placed = spread_join(marked, every, ["root", "band"], n)
    unit = lambda b1, j, b2, t, side: F.struct(F.xxhash64("root", b1, j, b2, t, F.lit(7)).alias("unit"), F.lit(side).alias("side"))
    band, tile = F.col("band"), F.col("tile")
    every_of = lambda c, use: F.transform(_upto(F.col(c)), use)
    asked = F.concat(every_of("own", lambda j: unit(band, j, band, tile, 2)), every_of("own_after", lambda j: unit(band + 1, j, band, tile, 2)), every_of("own_before", lambda j: unit(band - 1, j, band, tile, 2)))
    j = F.pmod(F.xxhash64("node", F.lit(2)), F.greatest("own", F.lit(1)))
    asks = F.concat(every_of("tiles", lambda t: unit(band, j, band, t, 1)), every_of("after", lambda t: unit(band, j, band + 1, t, 1)), every_of("before", lambda t: unit(band, j, band - 1, t, 1)))
    units = F.concat(asked, F.when(F.col("rest"), asks).otherwise(F.array().cast(_UNITS)))
    return placed.select("node", "at", units.alias("units")).where(F.size("units") > 0)


def maybe_in(df: DataFrame, keys: DataFrame, on: list[str], n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their key among ``keys``, rows that surely haven't), without a shuffle: by a bit set of at most 16 MB, of one hash, sixteen bits a key up to 8 million keys. With more keys it lets more rows through to the exact join that follows, at the worst all. n: the number of keys, if it's known."""
    n = keys.count() if n is None else n
    bits = min(1 << 27, max(1 << 15, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    sets = keys.select(place.alias("p")).select(F.expr("p div 32768").alias("__b"), (F.col("p") % 32768).alias("p")).groupBy("__b").agg(F.expr("bitmap_construct_agg(p)").alias("__bits"))
    marked = df.withColumn("__p", place).withColumn("__b", F.expr("__p div 32768")).join(F.broadcast(sets), "__b", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast((__p % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    told = marked.withColumn("__in", F.coalesce(F.getbit(byte, (F.col("__p") % 8).cast("int")) == 1, F.lit(False)))
    return told.where("__in").select(*df.columns), told.where("not __in").select(*df.columns)


def _tiles(units: DataFrame, tasks: int, method: Method) -> DataFrame:
    """a, b: links within units of forms, whose sets are made here."""

    def compare(table: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        table = table.sort_by([("unit", "ascending"), ("node", "ascending")])
        unit, node, side = (table[c].to_numpy() for c in ("unit", "node", "side"))
        fresh = np.append(True, (unit[1:] != unit[:-1]) | (node[1:] != node[:-1]))  # a text that is there twice gives its sets twice
        rows = np.flatnonzero(fresh)
        low, high = np.minimum.reduceat(side, rows), np.maximum.reduceat(side, rows)
        unit, node, side = unit[rows], node[rows], np.where(low == high, low, 0)  # a node on both sides meets all
        forms = table["form"].take(pa.array(rows))
        a, b = [], []
        firsts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        for i, j in zip(firsts.tolist(), [*firsts[1:].tolist(), len(unit)], strict=True):
            if j > i + 1:
                items = method.items(forms[i:j].to_pylist(), SETS)
                label = link(np.split(items.flat, items.ends[:-1]), side[i:j], method)
                use = label != np.arange(j - i)
                a.append(node[i:j][use])
                b.append(node[i:j][label[use]])
        return pa.table({"a": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64()), "b": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64), pa.int64())})

    return units.withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(tasks))).groupBy("task").applyInArrow(compare, "a long, b long")


def _band(size: Column, method: Method) -> Column:
    """The number of a size's band, by the rule of bands()."""
    starts = bands(method.part, method.whole, 1 << 26).tolist()
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in starts]), lambda s: s <= size)) - 1


def hash_sets(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes of each run, and the new ends."""
    starts = np.append(0, ends[:-1])
    sets = [np.unique(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return (np.concatenate(sets) if sets else flat[:0]), np.cumsum([len(x) for x in sets], dtype=np.int64) if sets else ends[:0]


__all__ = ["Items", "Method", "bands", "clusters", "components", "hash_sets", "linked", "maybe_in", "mix", "read_items", "read_keys", "signed"]
