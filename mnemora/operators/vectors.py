"""A stored vector index: lists of coded vectors, refined by the vectors themselves.

A model is fitted once on a bounded sample: centroids of lists, and for each of some stretches of a vector a
codebook of 256 pieces, so that a vector is a list's number and a byte for each stretch. Rows are added in parts, as
codes (dealt by list) and as vectors (dealt by id), without fitting again. A query reads the codes of
its nearest lists, sums the products of its stretches with the codebooks' pieces, keeps a number of
candidates a task, and scores only those by their vectors. Every row is indexed; what is approximate is the
choice of candidates, and recall() measures it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embed
from ..streaming.log import STEPS, Log
from . import ann, retrieval
from .retrieval import ranked

CODES, VECTORS, GONE, MODEL = "id long, list int, code binary", "id long, embedding array<float>", "id long", "name string, rows int, numbers array<float>"
PIECES, ROUNDS = 256, 8
#: Queries of a block: each takes 4 bytes for every stretch and piece in every task.
QUERY_BLOCK = 1024


def pieces(x: np.ndarray, seed: int) -> np.ndarray:
    """A codebook of at most PIECES rows by k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), min(PIECES, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class VectorIndex:
    """The index of rows (id long, embedding) in a log's tables; `stretches` bytes a vector."""

    def __init__(self, log: Log, name: str = "vectors", stretches: int = 16, lists: int | None = None, buckets: int = 16):
        self.log, self.name, self.stretches, self.lists, self.buckets = log, name, stretches, lists, buckets

    def _rows(self, name: str, schema: str) -> DataFrame | None:
        return self.log.rows(f"{self.name}.{name}", schema)

    def model(self) -> tuple[np.ndarray, list[np.ndarray]] | None:
        """Centroids and codebooks; None: not fitted yet."""
        rows = self._rows("model", MODEL)
        if rows is None:
            return None
        of = {r.name: np.array(r.numbers, float).reshape(r.rows, -1) for r in rows.collect()}  # as large as its parameters say
        return of["lists"], [of[f"book{k}"] for k in range(len(of) - 1)]

    def fit(self, corpus: DataFrame, sample: int = ann.SAMPLE) -> None:
        """Fits the model on at most `sample` rows of the smallest hash."""
        n = corpus.count()
        lists = self.lists or min(ann.MOST_LISTS, max(16, int(n**0.5)))
        centroids = ann.fit(corpus, lists, sample)
        taken = corpus.where("embedding is not null").select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        x = ann._unit(np.array([r.embedding for r in taken], float))
        books = [pieces(part, k) for k, part in enumerate(np.array_split(x, min(self.stretches, x.shape[1]), axis=1))]
        named = [("lists", centroids), *((f"book{k}", b) for k, b in enumerate(books))]
        rows = [(name, len(m), m.ravel().tolist()) for name, m in named]
        with self.log.transaction():
            self.log.put(f"{self.name}.model", self.log.spark.createDataFrame(rows, MODEL).withColumn("bucket", F.lit(0)), instead=True)

    def update(self, gone: DataFrame, new: DataFrame) -> None:
        """Rows of the ids in gone are replaced by new (id, embedding); the first update fits the model."""
        with self.log.transaction() as mine:
            if self.model() is None:
                if new.where("embedding is not null").isEmpty():
                    return
                self.fit(new)
            shared = self.log.spark.sparkContext.broadcast(self.model())

            def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                centroids, books = shared.value
                for batch in batches:
                    if batch.num_rows:
                        x = ann._unit(retrieval.vectors_of(batch.column(1), centroids.shape[1]))
                        near = (x @ centroids.T).argmax(1).astype(np.int32)
                        parts = np.array_split(x, len(books), axis=1)
                        code = np.column_stack([(2 * p @ b.T - (b * b).sum(1)).argmax(1).astype(np.uint8) for p, b in zip(parts, books, strict=True)])
                        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "list", "code"])

            mine["steps"] += 1
            at = lambda df: df.withColumn("seq", F.lit((mine["number"] + 1) * STEPS + mine["steps"]).cast("long"))
            rows = new.where("embedding is not null").select("id", F.col("embedding").cast("array<float>").alias("embedding"))
            codes = rows.mapInArrow(coded, CODES).withColumn("bucket", F.pmod("list", F.lit(self.buckets)).cast("int"))
            self.log.put(f"{self.name}.codes", at(codes.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "list")))
            self.log.put(f"{self.name}.vectors", at(rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "id")))
            self.log.put(f"{self.name}.gone", at(gone.select("id").distinct().withColumn("bucket", F.lit(0))))

    def _alive(self, rows: DataFrame) -> DataFrame:
        gone = self._rows("gone", GONE)
        if gone is None:
            return rows
        last = gone.groupBy("id").agg(F.max("seq").alias("__gone"))
        return rows.join(last, "id", "left").where("__gone is null or seq >= __gone").drop("__gone")

    def candidates(self, queries: DataFrame, most: int, probes: int | None = None) -> DataFrame:
        """qid, id: the `most` rows of the highest coded products of each query (qid long, embedding), from its `probes` nearest lists (None: four fifths, which vectors without clusters need for a recall of 0.99; 0.93 with three)."""
        spark, model = self.log.spark, self.model()
        out = spark.createDataFrame([], "qid long, id long, score double, rank int")
        if model is None:
            return out.select("qid", "id")
        centroids, books = model
        probes = min(len(centroids), probes or -(-4 * len(centroids) // 5))
        total = queries.count()
        blocks = -(-total // QUERY_BLOCK)
        for n in range(blocks):
            mine = queries if blocks == 1 else queries.where(F.expr(f"pmod(xxhash64(qid), {blocks}) = {n}"))
            rows = mine.where("embedding is not null").select("qid", "embedding").collect()  # a block
            if not rows:
                continue
            q = ann._unit(np.array([r.embedding for r in rows], float))
            tables = np.stack([np.pad(p @ b.T, ((0, 0), (0, PIECES - len(b)))) for p, b in zip(np.array_split(q, len(books), axis=1), books, strict=True)], 1).astype(np.float32)
            near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]
            asks = np.zeros((len(centroids), len(q)), bool)
            asks[near.ravel(), np.repeat(np.arange(len(q)), probes)] = True
            shared = spark.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), tables, asks))

            def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                qids, tables, asks = shared.value
                kept = [(np.zeros(0, np.int64), np.zeros(0, np.float32)) for _ in qids]
                for batch in batches:
                    ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.uint8)
                    for k in np.flatnonzero(asks[np.unique(lists)].any(axis=0)) if len(ids) else ():
                        own = np.flatnonzero(asks[lists, k])
                        score = tables[k][np.arange(code.shape[1]), code[own]].sum(1)
                        i, s = np.concatenate((kept[k][0], ids[own])), np.concatenate((kept[k][1], score))
                        top = np.lexsort((i, -s))[:most]
                        kept[k] = i[top], s[top]
                found = [np.full(len(i), x) for x, (i, _) in zip(qids, kept, strict=True)]
                columns = np.concatenate(found), np.concatenate([i for i, _ in kept]), np.concatenate([s for _, s in kept]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "id", "score"])

            wanted = sorted({int(x) for x in near.ravel()})
            codes = self._rows("codes", CODES).where(F.col("bucket").isin(sorted({x % self.buckets for x in wanted}))).where(F.col("list").isin(wanted))
            found = ranked(self._alive(codes).select("id", "list", "code").mapInArrow(best, "qid long, id long, score double")).where(F.col("rank") <= most)
            out = out.unionByName(found)
        return out.select("qid", "id")

    def topk(self, queries: DataFrame, k: int, probes: int | None = None, refine: int = 10) -> DataFrame:
        """qid, id, score, rank: nearly the k rows of highest cosine of each query; refine * k are scored by their vectors."""
        pairs = self.candidates(queries, refine * k, probes)
        rows = self._rows("vectors", VECTORS)
        if rows is None:
            return self.log.spark.createDataFrame([], "qid long, id long, score double, rank int")
        wanted = self._alive(rows.join(pairs.select("id").distinct(), "id", "left_semi")).select("id", F.col("embedding").alias("v"))
        both = pairs.join(wanted, "id").join(queries.select("qid", F.col("embedding").alias("q")), "qid")
        return ranked(both.select("qid", "id", embed.cosine(F.col("v"), F.col("q")).alias("score"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: the share of the exact answers (qid, id) that were found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg(F.count_distinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
