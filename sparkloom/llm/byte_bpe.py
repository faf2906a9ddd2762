"""Byte-level BPE encoding and decoding through a sentencepiece model built from the rank file.

Every rank becomes a piece: its bytes are mapped to printable characters, one each, and its score is
minus its rank, so that sentencepiece's merges by best score are the merges by lowest rank. The model
has the identity normaliser and no dummy prefix; it is serialised here, field by field. Texts are split
into pre-tokens; a pre-token that is itself a rank is that id, any other is merged. Decoding maps ids to the
model's pieces and the pieces' characters back to bytes; what each id gives is looked up in a table made so.

Defined results: null text counts as empty and has no ids; texts of any length are encoded whole, one at
a time; merges of equal rank are made from the left, as by the library; repeated rows each get their
result; an empty table gives an empty result; columns are taken by name, and extra ones don't matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_buffer
from .unit_cache import UnitCache, blocks

#: Unicode's White_Space, which the library's own pattern engine takes for \s.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: White space before a space: there a text can't be split at its spaces.
_RUN = rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80) "


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is one, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out, n = b"", n & (2**64 - 1)
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """A serialised BPE model; piece k has score -k. The unknown piece, which no text needs, comes last."""
    table = byte_characters()
    out = [_field(1, _field(1, "".join(table[b] for b in p).encode()) + _field(2, float(-k)) + _field(3, 1)) for k, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by one rank file and one pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import re

        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        pieces = sorted(self.ranks, key=self.ranks.get)
        self.id_of = np.array([self.ranks[p] for p in pieces], np.uint32).tolist()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(pieces))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.table.items()}
        self.bytes_of = {i: bytes(map(back.__getitem__, self.model.id_to_piece(k))) for k, i in enumerate(self.id_of)}
        self.pattern = regex.compile(pattern.replace(r"\S", f"[^{_SPACE}]").replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]"))
        self.run = re.compile(_RUN)
        self.bare, self.spaced, self.single = UnitCache(self._texts), UnitCache(lambda u: self._texts([b" " + x for x in u])), UnitCache(self._pretokens)

    def _pretokens(self, tokens: list[bytes]) -> list[list[int]]:
        ranks = self.ranks
        out = [[ranks[t]] if t in ranks else None for t in tokens]
        todo = [k for k, x in enumerate(out) if x is None]
        found = self.model.encode([tokens[k].decode("latin-1").translate(self.table) for k in todo], out_type=int, num_threads=1) if todo else []
        for k, ids in zip(todo, found, strict=True):
            out[k] = [self.id_of[i] for i in ids]
        return out

    def _texts(self, texts: list[bytes]) -> list[list[int]]:
        split = [[t.encode() for t in self.pattern.findall(x.decode("utf-8", "replace"))] for x in texts]
        flat = iter(self._pretokens([t for x in split for t in x]))
        return [[i for _ in x for i in next(flat)] for x in split]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Where no white space stands before a space, a text falls into units at its spaces, each encoded alone."""
        first, later, counts, whole = [], [], [], []
        for x in texts:
            if self.run.search(x):
                units = [t.encode() for t in self.pattern.findall(x.decode("utf-8", "replace"))]
                ids = [self.single.encode(units[k : k + 100_000])[0] for k in range(0, len(units), 100_000)]
                whole.append(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
                x = b""
            else:
                whole.append(None)
            units = x.split(b" ")
            first.append(units[0])
            later += units[1:]
            counts.append(len(units) - 1)
        a, na = self.bare.encode(first)
        b, nb = self.spaced.encode(later)
        a_at, b_at = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])[np.cumsum([0, *counts])]
        return [w if w is not None else np.concatenate([a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]]]) for k, w in enumerate(whole)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (if asked for), ids_sha256 of little-endian 32-bit ids, decoded_sha256 of the decoded bytes."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in blocks(offsets):
                found = own.encode([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)])
                cols = [batch.column(0).slice(i, j - i), pa.array([len(x) for x in found], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                cols += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    ids = "ids array<int>, " if with_ids else ""
    return slim.mapInArrow(work, f"id {kind}, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def decode_table(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``, the bytes of their ids; null ids give null."""
    bound_batches(encoded.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = [None if x is None else own.decode(np.array(x, np.uint32)) for x in batch.column(ids_col).to_pylist()]
            yield batch.append_column("decoded", pa.array(found, pa.binary()))

    from pyspark.sql import types as T

    return encoded.mapInArrow(work, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
