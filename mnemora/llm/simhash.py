"""SimHash near-duplicates by segment-popcount embedding (operator 8).

Fingerprint: bit b of a text is 1 if it is set in over half of the XXH64 hashes
(seed 42) of its word shingles. Two fingerprints link at ``max_bits`` or fewer
differing bits.

Search. A fingerprint is embedded as the vector of the bit counts of its 16
four-bit segments. Flipping one bit moves one coordinate by one, so the
Manhattan distance of two vectors is a lower bound of the number of differing
bits. The integer grid is joined by range: every vector is put into the cells
within ``ceil(max_bits / 2)`` steps of it, and two vectors within ``max_bits``
steps of each other meet in a cell half way. Candidates of a cell are verified
by exact bit differences.

Scale: texts are reduced to 8 bytes where they are read; equal fingerprints are
merged before the search (copies are never paired); a cell's members come
together by one shuffle of 16-byte rows. Within a cell only a spanning forest of
its links is kept, found in blocks of ``BLOCK`` members, so a dense cell emits
fewer links than it has members. A cell of over ``HOT`` members is dealt out
again by the pieces of its fingerprints (some piece of max_bits + 1 is equal in
a linked pair), so no cell has to fit one task. Components come from star
contraction over the links in the shared folder.

Defined cases: a null or blank text has fingerprint 0 and is linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows
share a component; a null doc_id is carried and never names a component unless
all of it is null; an empty table gives an empty result; further columns are
ignored by ``fingerprints`` and passed through by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, read_table, scratch, skewed_join, stored

SEED = 42
SEGMENTS = 16
BLOCK = 2048
HOT = 20_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(n, 8)
    if n < 256:
        ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def steps(dimensions: int, radius: int) -> np.ndarray:
    """All integer vectors within the radius, by Manhattan distance."""
    out = {(0,) * dimensions}
    edge = set(out)
    for _ in range(radius):
        edge = {v[:k] + (v[k] + d,) + v[k + 1 :] for v, k, d in product(edge, range(dimensions), (-1, 1))} - out
        out |= edge
    return np.array(sorted(out), np.int64)


def cell_keys(fps: np.ndarray, radius: int) -> np.ndarray:
    """The cells of each fingerprint, four bits a coordinate (shifted by the radius so that none is negative)."""
    x = fps.view(np.uint64)
    counts = np.stack([np.bitwise_count((x >> np.uint64(4 * k)) & np.uint64(15)) for k in range(SEGMENTS)], axis=1).astype(np.uint64)
    place = np.uint64(1) << (np.uint64(4) * np.arange(SEGMENTS, dtype=np.uint64))
    shift = ((steps(SEGMENTS, radius) + radius).astype(np.uint64) * place).sum(axis=1, dtype=np.uint64)
    return ((counts * place).sum(axis=1, dtype=np.uint64)[:, None] + shift[None, :]).view(np.int64)


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the exact links between these distinct fingerprints connect, fewer than fingerprints."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    x = fps.view(np.uint64)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            near = np.bitwise_count(x[a : a + BLOCK, None] ^ x[None, b : b + BLOCK]) <= max_bits
            i, j = np.nonzero(near)
            keep = i + a < j + b
            for p, q in zip((i[keep] + a).tolist(), (j[keep] + b).tolist(), strict=True):
                r, s = find(p), find(q)
                if r != s:
                    root[max(r, s)] = min(r, s)
                    left.append(p)
                    right.append(q)
    return fps[left], fps[right]


def _cell_links(max_bits: int):
    """Rows (key, fp), sorted by key within the partition, to links (a, b)."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(cut)
        a, b = [], []
        two = cut[:-1][size == 2]  # by far most cells
        near = np.bitwise_count(fps[two].view(np.uint64) ^ fps[two + 1].view(np.uint64)) <= max_bits
        a.append(fps[two][near])
        b.append(fps[two + 1][near])
        for s, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            p, q = forest(fps[s : s + n], max_bits)
            a.append(p)
            b.append(q)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on in the next batch
            if cut:
                held.append((keys[:cut], fps[:cut]))
                yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within max_bits."""
    radius = -(-max_bits // 2)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                keys = cell_keys(fps, radius)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(cells, "key long, fp long")
    together = lambda df: df.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_cell_links(max_bits), "a long, b long")
    crowded = stored(keyed.groupBy("key").count().where(F.col("count") > hot).select("key"))
    if crowded.isEmpty():
        return together(keyed).distinct()
    # Pieces: of max_bits + 1 disjoint runs of bits, a linked pair agrees in one at least.
    cuts = [round(64 * k / (max_bits + 1)) for k in range(max_bits + 2)]
    pieces = F.array(*[F.xxhash64(F.col("key"), F.lit(k), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    rest = together(keyed.join(crowded, "key", "left_anti"))
    dealt = together(keyed.join(crowded, "key", "left_semi").select(F.explode(pieces).alias("key"), "fp"))
    return rest.union(dealt).distinct()


def cluster(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of every row."""
    with scratch(docs.sparkSession) as keep:
        prints = stored(fingerprints(docs, shingle))
        first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
        roots = components(links(first, max_bits))
        members = first.join(roots, first.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
        # Two steps, so that a large component is reduced before its members meet.
        least = members.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
        named = stored(skewed_join(members, least, "root", "prints", first.count()).select("fp", "component_id", "n"))
        keep += [prints, named]
    return skewed_join(prints, named, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, that of the smallest doc_id (then of the smallest text hash); all columns kept.

    Of rows that repeat both id and text, one stays.
    """
    with scratch(docs.sparkSession) as keep:
        prints = stored(with_hash(docs, shingle))
        first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
        roots = components(links(first, max_bits))
        members = first.join(roots, first.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
        # Two steps, so that a large component is reduced before its members meet.
        of_print = prints.groupBy("fp").agg(F.min(order).alias("w"))
        winners = stored(of_print.join(members, "fp").groupBy("root").agg(F.min("w").alias("w")).select("w.doc_id", "w.h"))
        keep += [prints, winners]
    return only(docs, prints, winners)


def only(docs: DataFrame, prints: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of docs named by winners (doc_id, h), each once; prints: with_hash(docs)."""
    times = prints.groupBy("doc_id", "h").agg(F.count("*").alias("n")).toDF("id", "text_hash", "n")
    chosen = winners.join(times, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash"))).select("id", "text_hash", "n")
    # The rows travel as one column, so that no name of theirs can clash.
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    kept = whole.join(chosen, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")))
    single = kept.where("n = 1").select("doc")
    repeats = kept.where("n > 1").dropDuplicates(["id", "text_hash"]).select("doc")
    return single.union(repeats).select("doc.*")


def with_hash(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h (hash of the text), fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["doc_id", "h", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(run, f"doc_id {kind}, h long, fp long")


def op8_simhash_components(spark, sf_dir: str) -> DataFrame:
    out = cluster(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
