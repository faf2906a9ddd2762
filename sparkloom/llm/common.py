"""What the operators share: shared storage, Arrow batch bounds, hashing of words."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import HOT_SHARE, spread_join

#: Rows and bytes that one Arrow batch may hold, so that very long texts can't fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it where the driver does."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any(x.endswith("sparkloom.zip") for x in spark.sparkContext._python_includes):
        return
    if spark.sparkContext.master.startswith("local") and Path.cwd() == root:
        return
    path = f"{tempfile.mkdtemp()}/sparkloom.zip"  # the driver serves it to the workers as long as it runs
    with zipfile.ZipFile(path, "w") as out:
        for f in (root / "sparkloom").rglob("*.py"):
            out.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes; workers get this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/sparkloom-{uuid.uuid4().hex}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table: checkpoint() to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """cut(df), and its number of rows, or another sum over them, taken as it is written."""
    what, seen = F.count(F.lit(1)) if what is None else what, Observation()
    out = cut(df.observe(seen, what.alias("n")))
    found = seen.get
    n = found["n"] if "n" in found else out.agg(what).first()[0]
    return out, int(n or 0)


def input_bytes(df: DataFrame) -> int:
    """What the plan says of the size of df, from that of its files; 0 where it doesn't know."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 50 else 0


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again; the files go when the JVM ends. Unlike a checkpoint it forgets what the plan thought of its size, which joins of joins multiply."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    _stashes.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, keep: int, last: int) -> None:
    """Of the paths that stash() has written from number ``keep`` on, delete all but the ``last`` ones."""
    for path in _stashes[keep : len(_stashes) - last]:
        delete(spark, path)
    del _stashes[keep : len(_stashes) - last]


def stashed() -> int:
    """How many paths stash() has written since the last sweep()."""
    return len(_stashes)


#: Paths of stash() since the last sweep().
_stashes: list[str] = []


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_at_exit(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.deleteOnExit(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete all that stash() has written, once no result that reads it is still to be computed."""
    while _stashes:
        delete(spark, _stashes.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to any more: it does once the driver's garbage is collected, which else may be much later."""
    for _ in range(3):  # Python lets go of its handles first, then the JVM of what they held
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory of a worker back: workers live on between tasks, beside those of other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """Have the executors collect their garbage, so that their JVMs give unused heap back: one that has grown to its limit else keeps the room that workers need. A task a core, which reaches every executor while no other job runs; no result depends on it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).agg(F.count("x")).collect()


# Hashing -------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_STEP = 0x9E3779B97F4A7C15 | 1
#: Bytes that are hashed at once.
_BLOCK = 1 << 20


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(256)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, end to end, and the n + 1 offsets; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and the number of words of each text."""
    hashes, counts, i, n = [], np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1
        j = min(n, max(i + 1, j))
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part):
            h, starts = _block(part, at)
            hashes.append(h)
            counts[i:j] = np.diff(np.searchsorted(starts, at))
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def _block(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[part]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = at[:-1][at[:-1] < len(part)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    ends = np.append(starts[1:], len(part))
    place = np.arange(len(part), dtype=np.int64) - np.repeat(starts, ends - starts) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(part), dtype=np.int64)
        place[starts[0] :] -= np.repeat(starts, ends - starts)
        place[: starts[0]] = 0
    longest = int(place.max()) + 1
    power = _POWER if longest <= len(_POWER) else _powers(longest)
    terms = _BYTE[_FOLD[part]] * power[place]
    return mix(np.add.reduceat(terms, starts)), starts


def pack(values: np.ndarray) -> bytes:
    """An integer array by planes of bytes: high bytes of small numbers are runs of zeros, which any codec removes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def squeeze(values: np.ndarray) -> bytes:
    """Integers from 0 on, most of them small: planes of as few bytes as the largest needs, compressed."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + zlib.compress(pack(values.astype(f"<u{width}")), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    return unpack(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


__all__ = ["HOT_SHARE", "spread_join"]
