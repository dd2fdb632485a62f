"""Hard negatives by blocked dense products (operator 11).

Vectors become whole numbers, floor(scale * x). A block of anchors, bounded in
bytes, goes to all tasks; each task multiplies it with its candidates, batch by batch, in float64
(exact, as sums stay below 2^53; batches whose sums might not are multiplied as
integers), and keeps for each anchor the best few rows. What tasks kept is merged by a ranked
window. The first pass finds each anchor's positives: the highest products among
rows of its label. The second looks, for each positive, for the highest products
among rows of other labels inside a window that the positive's own product sets:
``low * p <= 100 * n <= high * p``.

Scale: the product of all anchors and all candidates is what is asked for, in blocks; per block
the candidates are read twice, nothing but anchors (``BLOCK_BYTES``) is broadcast, and a
task shuffles no more than the rows it keeps. Labels are compared inside a block and are never a
key, so a label that holds a third of all rows costs what any other does. Every block's rows are
written to the shared folder before the next begins, so the driver holds one block.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; an
anchor is a row, so rows that repeat an id are anchors each and positives of each other;
equal products are ordered by id; vectors of different lengths count as filled up with zeros, and an empty vector's
products are 0; an anchor without positives, or a positive without negatives, has no rows; a
product beyond 64 bits is an error; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_folder, read_table, stored

BLOCK_BYTES = 16 << 20
#: Anchors and candidates of one product.
TILE = 1024
EXACT = 2.0**53


def prepared(vectors: DataFrame, anchors: Column, scale: int = 256) -> DataFrame:
    """row, id, label, anchor, v (whole numbers) of the rows of vectors (vec_id, label, embedding) that take part, written."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    # Beyond 2^53 a double is whole already (and floor would end at 2^63).
    floored = lambda y: F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y)
    quantised = F.transform(x, lambda c: floored(c * F.lit(float(scale))))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), quantised.alias("v")))


def matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of a list column as float64, short ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, a_rows: np.ndarray, b_rows: np.ndarray) -> np.ndarray:
    """a @ b.T as int64, exactly; an error where it does not fit, but for a row with itself, which nobody asks for."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT and bound < 2.0**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    out = whole(a) @ whole(b).T
    out[a_rows[:, None] == b_rows[None, :]] = 0
    if out.size and (out.max() >= 2**63 or out.min() < -(2**63)):
        raise OverflowError("a product of two vectors does not fit 64 bits; use a smaller scale")
    return out.astype(np.int64)


class Best:
    """The first k of each slot by (product descending, id), merged batch by batch."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, np.iinfo(np.int64).min)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot) == 0:
            return
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -1 - score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = self.slot[rank[keep] == self.k - 1]
        self.floor[full] = self.score[rank[keep] == self.k - 1]


class Block:
    """Anchors in memory: rows, ids, labels, vectors; what a pass looks for among candidates."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.row, self.id, self.label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        v = table.column("v")
        self.v = matrix(v.chunk(0) if v.num_chunks else pa.array([], pa.list_(pa.float64())))

    def positives(self, batches: Iterator[pa.RecordBatch], k: int) -> Best:
        best = Best(len(self.row), k)
        for row, ids, label, at, scores in self.scored(batches):
            part = slice(at, at + len(scores))
            hit = (self.label[part, None] == label[None, :]) & (scores >= best.floor[part, None]) & (self.row[part, None] != row[None, :])
            a, c = np.nonzero(hit)
            best.add(a + at, scores[a, c], ids[c])
        return best

    def negatives(self, batches: Iterator[pa.RecordBatch], anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Best:
        """Slots are windows [low, high] of products with an anchor (its number)."""
        best = Best(len(anchor), k)
        for _, ids, label, at, scores in self.scored(batches):
            mine = np.flatnonzero((anchor >= at) & (anchor < at + len(scores)))
            other = self.label[at : at + len(scores), None] != label[None, :]
            for slots in np.array_split(mine, max(1, len(mine) // TILE)):
                s, a = scores[anchor[slots] - at], anchor[slots] - at
                hit = other[a] & (s <= high[slots, None]) & (s >= np.maximum(low, best.floor)[slots, None])
                x, c = np.nonzero(hit)
                best.add(slots[x], s[x, c], ids[c])
        return best

    def scored(self, batches: Iterator[pa.RecordBatch]):
        """Rows, ids, labels of some candidates, the first of some anchors, and their products."""
        for batch in batches:
            row, ids, label = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
            v = matrix(batch.column("v"))
            for c in range(0, len(row), TILE):
                part = slice(c, c + TILE)
                for at in range(0, len(self.row), TILE):
                    yield row[part], ids[part], label[part], at, products(self.v[at : at + TILE], v[part], self.row[at : at + TILE], row[part])


_KEPT = "slot long, score long, id long"


def _found(best: Best) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], names=["slot", "score", "id"])


def _ranked(kept: DataFrame, k: int) -> DataFrame:
    """The first k of what all tasks kept, with their rank."""
    place = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor (a condition on the rows of vectors)."""
    spark = vectors.sparkSession
    rows = prepared(vectors, anchors, scale)
    n, width = rows.where("anchor").agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if n == 0:
        return spark.createDataFrame([], schema)
    size = max(1, block_bytes // (8 * (width + 3)))
    # A file holds so many anchors at most: a block is a file.
    folder, blocks = own_folder(spark), -(-n // size)
    rows.where("anchor").select("row", "id", "label", "v").repartition(blocks).write.option("maxRecordsPerFile", size).parquet(folder)
    candidates = rows.select("row", "id", "label", "v")
    out = own_folder(spark)
    for file in sorted(spark.read.parquet(folder).inputFiles()):
        block = Block(spark.read.schema("row long, id long, label long, v array<double>").parquet(file).toArrow())
        shared = spark.sparkContext.broadcast(block)
        first = _ranked(candidates.mapInArrow(lambda it, shared=shared: _found(shared.value.positives(it, positives)), _KEPT), positives)
        best = first.orderBy("slot", "rank").toArrow()  # a few of each anchor of the block
        anchor, score, found = (best.column(c).to_numpy() for c in ("slot", "score", "id"))
        # Whole bounds of low * p <= 100 * n <= high * p; hundreds apart from the rest, so that nothing overflows.
        q, r = np.divmod(score, 100)
        low_at, high_at = low * q - (-(low * r) // 100), high * q + (high * r) // 100
        windows = spark.sparkContext.broadcast((anchor, low_at, high_at))
        second = _ranked(candidates.mapInArrow(lambda it, shared=shared, windows=windows: _found(shared.value.negatives(it, *windows.value, negatives)), _KEPT), negatives)
        told = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": block.id[anchor], "positive_id": found, "positive_score": score}))
        second.join(F.broadcast(told), "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        windows.unpersist()
        shared.unpersist()
    return spark.read.schema(schema).parquet(out)


def op11_blocked_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 50 == 0)


SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, rank::int as rank, id as negative_id, positive_score, score as negative_score from (
  select p.anchor_id, positive_id, id, positive_score, score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank
  from positives p join pairs n on p.anchor_id = n.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
) where rank <= 3
"""
