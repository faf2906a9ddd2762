"""Pack documents into sequences of fixed length by best-fit decreasing.

Documents are tokenised where they are read; only (id, start, length, checksum) rows go on. Full windows
are cut first and are sequences of their own. The rests are dealt at random into groups of about
``GROUP`` pieces, packed independently: each piece, longest first, goes into the open sequence with the
least remaining room that fits, found by a segment tree over remaining capacities.

A tokenizer maps words between ASCII white space independently of each other (its pre-tokenizer drops
white space, and composition and lower-casing don't reach across it), so words are encoded once each.
Words of Latin letters with or without signs behind, of which normaliser and pre-tokenizer make one or
two plain parts, go to the tokenizer's merges directly, part by part; all others take its whole path.
That holds for tokenizer files of those steps, which is checked; of other files whole texts are encoded.

Defined results: null text counts as empty, and an empty document is its end id alone; very long texts
are encoded whole and cut into as many windows as they fill; repeated rows are documents of their own;
pieces of equal length are packed in the order of their rows; an empty table gives an empty result;
columns are taken by name, and extra ones don't matter.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import bound_batches, stash, text_buffer
from .unit_cache import UnitCache, blocks

WINDOW, END_ID = 2048, 1
#: Pieces that one task packs, on average.
GROUP = 50_000
#: Letters that composition leaves alone and that have one letter as lower case, then signs.
_PLAIN = re.compile(r"""([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?$%&*#|()"-]*)""")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _words(path: str) -> UnitCache:
    tokenizer = _tokenizer(path)
    merge, table = tokenizer.model.tokenize, dict(enumerate(byte_characters()))
    parts: dict[str, list[int]] = {}
    plain, known = _PLAIN.fullmatch, parts.get

    def ids(part: str) -> list[int]:
        # ASCII letters and signs stand for themselves
        parts[part] = found = [x.id for x in merge(part if part.isascii() else part.encode().decode("latin-1").translate(table))]
        return found

    def many(words: list[bytes]) -> list[list[int]]:
        if len(parts) > 300_000:
            parts.clear()
        texts = [w.decode("utf-8", "replace") for w in words]
        out: list[list[int] | None] = []
        for x in texts:
            if (m := plain(x)) is None:
                out.append(None)
                continue
            letters, signs = m.groups()
            letters = letters.lower()
            found = known(letters) or ids(letters)
            out.append(found + (known(signs) or ids(signs)) if signs else found)
        rest = [k for k, x in enumerate(out) if x is None]
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for k, x in zip(some, tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = x.ids
        return out

    return UnitCache(many, 600_000)


@functools.lru_cache(maxsize=8)
def _splits_plainly(path: str) -> bool:
    """Whether the file's steps are those that the direct way stands for: composition and lower case, runs of letters and of signs, bytes as characters."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = lambda x, name: [(s["type"], s.get("pattern")) for s in (x or {}).get(name, [])]
    split = steps(made.get("pre_tokenizer"), "pretokenizers")
    return [t for t, _ in steps(made.get("normalizer"), "normalizers")] == ["NFC", "Replace", "Lowercase"] and [t for t, _ in split] == ["Split", "ByteLevel"] and (split[0][1] or {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def token_ids(path: str, data: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of each text."""
    if not _splits_plainly(path):
        for i, j in blocks(offsets):
            texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)]
            for k, x in zip(range(i, j), _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False), strict=True):
                yield k, np.append(np.array(x.ids, np.uint32), np.uint32(end_id)).astype("<u4")
        return
    cache = _words(path)
    for i, j in blocks(offsets):
        split = [data[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(i, j)]
        ids, sizes = cache.encode([w for words in split for w in words])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, split)])]
        for k in range(i, j):
            part = ids[ends[k - i] : ends[k - i + 1]]
            yield k, np.append(part, np.uint32(end_id)).astype("<u4")


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens. All but a document's last piece fill a window."""
    spark = docs.sparkSession
    bound_batches(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            row, rest = [], []
            for k, ids in token_ids(path, data, offsets, end_id):
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    row.append(k)
                    rest.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            cols = np.array(rest, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(cols[:, c]) for c in range(4))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return slim.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


class _Tree:
    """Counts of open sequences by remaining room; finds the least room of at least a size that some sequence has."""

    def __init__(self, most: int) -> None:
        self.n = 1 << most.bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, room: int, by: int) -> None:
        i = self.n + room
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, size: int) -> int:
        """-1 if there is none."""
        count, i = self.count, self.n + size
        if count[i]:
            return size
        while i > 1 and (i & 1 or not count[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.n:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.n


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ties go by position. The sequence opened last with a given room is used first."""
    tree, open_with = _Tree(window), [[] for _ in range(window + 1)]
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        room = tree.least(size)
        if room < 0:
            room, at, made = window, made, made + 1
        else:
            at = open_with[room].pop()
            tree.add(room, -1)
        sequence[k], offset[k] = at, window - room
        if room > size:
            open_with[room - size].append(at)
            tree.add(room - size, 1)
    return sequence, offset


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequence ids are unique, not gapless."""
    made = stash(pieces(docs, path, id_col, text_col, window, end_id)).withColumn("row", F.monotonically_increasing_id())  # stable: the files are fixed
    rest = made.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))
    full = made.where(F.col("length") == window).select("*", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending")])  # whatever order the shuffle gave
        sequence, offset = best_fit_decreasing(table["length"].to_numpy(), window)
        first = table["part"][0].as_py() << 32
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array((first + sequence) * 2 + 1)).append_column("offset", pa.array(offset))

    packed = rest.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("part").applyInArrow(fill, full.schema)
    return full.unionByName(packed).drop("row").withColumnRenamed("id", id_col)
