"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

Texts are lower-cased; words are runs of letters, digits and non-ASCII bytes. An
item is the set of its 5-word shingles (of all its words, if it has fewer). Items are
partitioned by size into classes (U/2, U], U a power of two. For each class a
document is read in windows of 1.5 U shingles, one every U/2, so every run of
U shingles lies in some window whatever the document's length, and a copy's
similarity to its window is bounded below whatever surrounds it. Items of ``EXACT``
shingles or fewer, too small for signatures, are looked up by each of their shingles,
which misses none. Windows and
items have MinHash signatures of ``HASHES`` values; one equal value makes a
candidate (an item that the document contains to 0.8 is missed with a
probability of 1e-4 at most, verbatim copies of 1e-6), and every
candidate is verified by the exact share of the item's shingles in the document.

Scale: documents are read once and never shuffled; windows are blocks' minima
merged, over a whole chunk of documents at once, so a signature costs one
multiplication per shingle and hash whatever the number of classes. Items are the stated query set: they are taken in blocks of
at most ``BLOCK_SHINGLES`` shingles, each broadcast in turn (its size is counted
first), so any number of items works in bounded memory, with one pass over the
documents per block. Only matches are returned.

Defined cases: items and texts that are null or have no word match nothing; an item of
fewer than five words matches where its words follow each other; repeated items and
rows are searched each on its own; empty tables give an empty result; extra
columns are ignored by ``search`` and passed through by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Prefix, chunks, drop_stored, own_folder, read_table, stored, windows, words_of

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 32
#: Items of so many shingles or fewer are looked up by their shingles.
EXACT = 4
SMALLEST = 2 * EXACT
BLOCK_SHINGLES = 1 << 20
TABLE_BITS = 20

#: ASCII that is neither a letter nor a digit.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_NONE = np.uint64(2**64 - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.random.default_rng(3).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word of a chunk."""
    low = _LOWER[data]
    start, end, doc = words_of(low, offsets, SEPARATOR)
    return Prefix(low).of(start, end), doc


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    return windows(words, n)[: max(0, len(words) - n + 1)] if n else np.zeros(0, np.uint64)


def class_of(size: int) -> int:
    """The power of two U with U/2 < size <= U, at least SMALLEST."""
    return max(SMALLEST, 1 << (size - 1).bit_length())


@dataclass
class Items:
    """A block of items: ids, word counts of their shingles, shingles. Only these are broadcast."""

    ids: list
    widths: list[int]
    sets: list[np.ndarray]


class Lookup:
    """For each class and hash: which leading bits some item's signature value has, and those values in order with their items.

    Built by each worker from the broadcast items; a table has some 64 bits an item.
    """

    def __init__(self, items: Items):
        self.items = items
        self.by_class: dict[tuple[int, int], list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.exact: dict[int, tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        small: dict[int, list[int]] = {}
        for k, s in enumerate(items.sets):
            if len(s) <= EXACT:
                small.setdefault(items.widths[k], []).append(k)
            else:
                groups.setdefault((items.widths[k], class_of(len(s))), []).append(k)
        for key, members in groups.items():
            self.by_class[key] = [self.table(np.array([(items.sets[k] * a).min() for k in members]), np.array(members)) for a in _ODD]
        for width, members in small.items():
            sizes = [len(items.sets[k]) for k in members]
            self.exact[width] = self.table(np.concatenate([items.sets[k] for k in members]), np.repeat(members, sizes))
        self.widths = sorted({w for w, _ in groups} | set(small))

    @staticmethod
    def table(values: np.ndarray, members: np.ndarray) -> tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]:
        bits = min(TABLE_BITS, max(10, (64 * len(values) - 1).bit_length()))
        shift = np.uint64(64 - bits)
        order = np.argsort(values, kind="stable")
        hit = np.zeros(1 << bits, bool)
        hit[values >> shift] = True
        return shift, hit, values[order], members[order]


_LOOKUPS: dict[int, tuple[Items, Lookup]] = {}


def lookup(items: Items) -> Lookup:
    """The worker's look-up of the block it holds (one block at a time)."""
    held = _LOOKUPS.get(0)
    if held is None or held[0] is not items:
        _LOOKUPS[0] = held = (items, Lookup(items))
    return held[1]


def block_minima(hashed: np.ndarray, size: int) -> np.ndarray:
    n = -(-len(hashed) // size)
    out = np.full(n * size, _NONE, np.uint64)
    out[: len(hashed)] = hashed
    return out.reshape(n, size).min(axis=1)


def candidates(found: np.ndarray, broken: np.ndarray, doc: np.ndarray, width: int, items: Lookup) -> set[tuple[int, int]]:
    """(document, item) pairs with a signature value in common in a window of a chunk's shingles.

    found: the shingle that begins at each word of the chunk, broken: those that
    reach over a document's end, doc: the words' documents. A window may hold
    shingles of neighbouring documents; it is a candidate for each of them.
    """
    classes = sorted(u for w, u in items.by_class if w == width)
    first, last, item = [], [], []

    def collect(values: np.ndarray, table: tuple, size: int, reach: int) -> None:
        shift, hit, known, members = table
        at = np.flatnonzero(hit[values >> shift])
        lo, hi = np.searchsorted(known, values[at], "left"), np.searchsorted(known, values[at], "right")
        for p, x, y in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for m in members[x:y].tolist():
                first.append(p * size)
                last.append(min((p + reach) * size, len(found)) - 1)
                item.append(m)

    if width in items.exact and len(found):
        whole = found.copy()
        whole[broken] = _NONE
        collect(whole, items.exact[width], 1, 1)
    for j, a in enumerate(_ODD if classes and len(found) else ()):
        size = SMALLEST // 2
        hashed = found * a
        hashed[broken] = _NONE
        low = block_minima(hashed, size)
        for u in classes:
            while size < u // 2:  # blocks of half a class
                low = block_minima(low, 2)
                size *= 2
            window = low.copy()
            np.minimum(window[:-1], low[1:], out=window[:-1])
            np.minimum(window[:-2], low[2:], out=window[:-2])
            collect(window, items.by_class[(width, u)][j], size, 3)
    pairs = set(zip(doc[first].tolist(), doc[last].tolist(), item, strict=True)) if first else ()
    return {(d, i) for x, y, i in pairs for d in range(x, y + 1)}


def _search(shared, threshold: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        table = lookup(items)
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for a, b, data, offsets in chunks(batch.column(1)):
                words, doc = word_hashes(data, offsets)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                for width in table.widths:
                    found = windows(words, width)
                    broken = np.ones(len(words), bool)
                    broken[: max(0, len(words) - width + 1)] = doc[width - 1 :] != doc[: max(0, len(doc) - width + 1)]
                    held = (-1, found)
                    for k, i in sorted(candidates(found, np.flatnonzero(broken), doc, width, table)):
                        if held[0] != k:
                            held = (k, np.unique(found[cut[k] : max(cut[k], cut[k + 1] - width + 1)]))
                        there, s = held[1], items.sets[i]
                        if not len(there):
                            continue
                        at = np.minimum(np.searchsorted(there, s), len(there) - 1)
                        share = float((there[at] == s).mean())
                        if share >= threshold:
                            rows.append((ids[a + k].as_py(), items.ids[i], len(s), share))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (ids.type, item_type, pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "n_shingles", "containment"])

    return run


def item_shingles(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item_id, width, shingles (sorted array) of every item with a word, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                words, doc = word_hashes(data, offsets)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                own = [words[cut[k] : cut[k + 1]] for k in range(b - a)]
                widths = [min(shingle, len(w)) for w in own]
                sets = [np.unique(shingles(w, n)).view(np.int64) for w, n in zip(own, widths, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(widths, pa.int32()), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], names=["item_id", "width", "shingles"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    lowered = benchmark.select("item_id", F.lower("text").alias("text"))
    return stored(lowered.mapInArrow(run, f"item_id {kind}, width int, shingles array<long>").where("width > 0"))


def item_blocks(items: DataFrame, most: int = BLOCK_SHINGLES) -> Iterator[Items]:
    """The items in blocks of at most `most` shingles (or one larger item); one block is on the driver at a time."""
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        mine = items.where(F.expr(f"pmod(xxhash64(item_id, shingles), {n}) = {k}")) if n > 1 else items
        held, size = Items([], [], []), 0
        for r in mine.toLocalIterator():
            held.ids.append(r.item_id)
            held.widths.append(r.width)
            held.sets.append(np.array(r.shingles, np.int64).view(np.uint64))
            size += len(r.shingles)
            if size >= most:
                yield held
                held, size = Items([], [], []), 0
        if held.ids:
            yield held


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, most: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shingles, containment of every item that a document contains to the threshold.

    Where there are several blocks of items, what each finds is written before the next is read, so that
    executors hold one block at a time, and the driver two.
    """
    spark = docs.sparkSession
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, n_shingles long, containment double"
    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    items = item_shingles(benchmark, shingle)
    blocks = item_blocks(items, most)
    block, out = next(blocks, None), None
    while block is not None:
        shared, after = spark.sparkContext.broadcast(block), next(blocks, None)
        found = lowered.mapInArrow(_search(shared, threshold, to_arrow_type(item)), schema)
        if out is None and after is None:
            drop_stored(items)
            return found  # the usual case: one block, nothing to write
        out = out or own_folder(spark)
        found.write.mode("append").parquet(out)
        shared.unpersist()
        block = after
    drop_stored(items)
    return spark.read.schema(schema).parquet(out) if out else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item to the threshold."""
    # The rows travel as one column, so that no name of theirs can clash; rows equal in id and text are judged alike.
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id").alias("check"))
    named = whole.select(F.struct("key", "check").alias("doc_id"), F.col("doc.text").alias("text"))
    hits = stored(search(named, benchmark, threshold).select("doc_id.key", "doc_id.check").distinct())
    return whole.join(hits, ["key", "check"], "left_anti").select("doc.*")


def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
with words as (
  select 'd' as side, doc_id as id, regexp_extract_all(lower(text), '[^\x00-/:-`{-\x7f]+') as w from documents where text is not null
  union all select 'q', item_id, regexp_extract_all(lower(text), '[^\x00-/:-`{-\x7f]+') from benchmark where text is not null
), grams as (
  select distinct side, id, n, array_to_string(w[i:i + n - 1], ' ') as g from (
    select side, id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from words, (select distinct least(5, len(w)) as n from words where side = 'q' and len(w) > 0) where len(w) >= n and (side = 'd' or n = least(5, len(w))))
), sizes as (
  select id, n, count(*) as size from grams where side = 'q' group by all
)
select d.id as doc_id, q.id as item_id, any_value(size) as n_shingles, count(*) * 1.0 / any_value(size) as containment
from grams q join grams d on q.side = 'q' and d.side = 'd' and q.n = d.n and q.g = d.g join sizes s on s.id = q.id and s.n = q.n
group by 1, 2 having count(*) * 1.0 / any_value(size) >= 0.8
"""
