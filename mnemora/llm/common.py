"""What the operators share: shared-folder tables, byte kernels, connected components.

The byte kernels work on one chunk of documents at a time: the chunk is one
uint8 array plus offsets, and words, lines and windows are found and hashed by
numpy over the whole chunk, so no Python code runs per word. A chunk holds
``CHUNK`` bytes or one document, whichever is larger.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: The words of the contracts: runs of bytes that are none of these (as bytes.split()).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.default_rng(0x5EED)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, x in (("up", BASE), ("down", INV)):
            out = np.full(size, x, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Sums of powers modulo 2**64 of certain texts of a thousand bytes and more are equal, whatever the base (as where letters
#: follow the Thue-Morse sequence); spans from here on are hashed by themselves.
LONG_SPAN = 512


class Prefix:
    """Hashes of any [start, end) of a byte array, in constant time each but for long ones."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start, end) -> np.ndarray:
        size = np.asarray(end) - np.asarray(start)
        out = mix(self.raw(start, end) + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        if size.ndim and size.size and size.max() >= LONG_SPAN:
            for k in np.flatnonzero(size >= LONG_SPAN):
                out[k] = xxhash.xxh3_64_intdigest(self.data[start[k] : end[k]])
        return out


def ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the document of every word; words end where documents end."""
    inside = ~space[data]
    start, end = ranges(inside)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]
    if len(cut):
        start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def per_doc(weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of weights between offsets."""
    total = np.concatenate(([0], np.cumsum(weights)))
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n entries from each position on (positions near the end wrap; the caller drops them)."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        out = out * BASE + np.roll(hashes, -k)
    return mix(out)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of groups of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, len(texts))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


# --- shared folder -----------------------------------------------------------

#: Folders that stored() made, by application, oldest first.
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and Spark is local (tests), below a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = context._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="mnemora-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/mnemora-{context.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts lineage, survives lost executors.

    The folder goes when the driver's process ends, or before by drop_stored() or scratch().
    """
    path = own_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    """A new shared folder, not made yet, that goes like those of stored()."""
    path = shared_folder(spark)
    if not _MADE:
        atexit.register(_drop_all)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _MADE.pop(spark.sparkContext.applicationId, ()) if spark is not None else ():
        _delete(spark, path)


def drop_stored(df: DataFrame) -> None:
    """Removes the folder of a table made by stored(); only for tables that no later plan reads."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _delete(spark, f)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes what stored() wrote inside the block, but for the tables that the block appends to the list."""
    name = spark.sparkContext.applicationId
    before, keep = len(_MADE.get(name, ())), []
    yield keep
    kept = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
    for path in _MADE.get(name, [])[before:]:
        if path.rpartition("/")[2] not in kept:
            _delete(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT_KEYS = 20_000


def skewed_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with the columns of table, which has each key once and in n how many of the `total` rows have it.

    Keys of more than one row in HOT_KEYS are that many at most: they are joined by
    broadcast, so their rows meet in no task.
    """
    limit = max(1000, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(n) > limit).drop(n))
    usual = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) <= limit).drop(n), key)
    return usual.unionByName(rows.join(hot, key))


# --- connected components ----------------------------------------------------


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), by alternating large and small stars.

    Each round is two aggregations over the links and is written to the shared
    folder, so no lineage grows; the number of rounds is logarithmic in the
    longest chain, and more than `rounds` of them raise an error. The star of a large
    component is one key of the joins: minima are taken before the shuffle, and the
    rows of such a key are split by Spark's skew join. Nodes without links are not
    returned.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stored(small)
        seen = after.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        before, now = now, after
        drop_stored(before)
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
