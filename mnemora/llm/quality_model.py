"""Quality classifier of supervised subword embeddings (operator 2).

Every word, every pair of neighbouring words and every character n-gram of a word
(with the spaces around the word as its marks) is hashed to one of ``BUCKETS``
vectors. As no hash says that a word repeats the one before it, a run of 2, 3, ...
``RUN`` equal words is a feature too, each length with a vector of its own that is
learned as the others are. A document is the average of its features' vectors, and a softmax layer
over it gives the classes. Vectors and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of the labelled rows: the ``SAMPLE``
labelled ids of the smallest hash, each with its whole text. Nothing else is
sampled: scoring reads every whole text.

The logit is linear in the features, so for scoring each bucket's vector is
folded into one number (its product with the softmax layer), and a text's logit is
the mean of its features' numbers: one table look-up per feature, by numpy over a
chunk of documents, no shuffle, a 1 MB model in the broadcast. The features of the
training rows are counted where the texts are and written to the shared folder; the
driver holds ``PART_BYTES`` of them at a time, whatever the texts' length.

Defined cases: a null or blank text has no features and gets the score of the
layer's bias; labels that are null, or of ids without a document, teach nothing;
with no or one class of labels the score is that class's (0.5 without any);
repeated ids teach once; an empty table gives an empty result; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Prefix, chunks, mix, per_doc, powers, read_table, stored, words_of

BUCKETS = 1 << 18
DIMENSIONS = 16
GRAMS = (3, 4, 5)
EPOCHS = 3
RATE = 0.5
SAMPLE = 4000
PART_BYTES = 32 << 20
#: Longest run of equal words that has a vector of its own, and the rows of the table.
RUN = 5
ROWS = BUCKETS + RUN - 1
THRESHOLD = 0.3
_SHIFT = np.uint64(64 - 18)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the rows, float32
    bias: float


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n-gram length the bucket of the n-gram at each character and whether it counts (no space inside, all in one text); the texts' offsets in characters."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets] if len(chars) != len(data) else offsets
    low = np.minimum(chars, 255).astype(np.uint8)
    word = ~SPACE[low] | (chars > 255)
    # The letters' own hashes, with powers of a base by position: as in Prefix, over characters.
    up, down = powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(np.where(word, chars, 32).astype(np.uint64)) * up[: len(chars)], out=sums[1:])
    out = []
    for n in GRAMS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        ok = word[1 : m + 1].copy()
        for k in range(2, n - 1):
            ok &= word[k : m + k]
        over = (begins[1:-1, None] - np.arange(1, n)[None, :]).ravel()
        ok[over[(over >= 0) & (over < m)]] = False
        out.append((((sums[n:] - sums[:m]) * down[:m] * np.uint64(2 * n + 1) * np.uint64(0x9E3779B97F4A7C15) >> _SHIFT).astype(np.int32), ok))
    return out, begins


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and documents of the words, of the pairs of neighbours and of the runs of equal words that end at each."""
    start, end, doc = words_of(data, offsets)
    hashes = Prefix(data).of(start, end)
    if not len(hashes):
        return np.zeros(0, np.int32), doc
    near = doc[1:] == doc[:-1]
    pairs = mix(hashes[:-1] * np.uint64(0xA24BAED4963EE407) + hashes[1:])[near]
    rows, docs = [(np.concatenate((hashes, pairs)) >> _SHIFT).astype(np.int32)], [doc, doc[1:][near]]
    run = np.concatenate(([False], near & (hashes[1:] == hashes[:-1])))
    for k in range(RUN - 1):
        at = np.flatnonzero(run)
        rows.append(np.full(len(at), BUCKETS + k, np.int32))
        docs.append(doc[at])
        run[1:] &= run[:-1].copy()  # one word longer
        run[0] = False
    return np.concatenate(rows), np.concatenate(docs)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of a text, how often each occurs, and the number of features."""
    data = np.frombuffer(text, np.uint8)
    offsets = np.array([0, len(data)])
    parts = [_words(data, offsets)[0], *(b[ok] for b, ok in _grams(data, offsets)[0])]
    all_ = np.concatenate(parts)
    counts = np.bincount(all_, minlength=ROWS) if len(all_) > 50_000 else None
    if counts is not None:
        found = np.flatnonzero(counts).astype(np.int32)
        return found, counts[found].astype(np.float32), len(all_)
    found, counts = np.unique(all_, return_counts=True)
    return found, counts.astype(np.float32), len(all_)


#: A training row: packed buckets and how often each occurs, number of features, label 0 or 1.
Row = tuple[bytes, int, int]


def train(parts: Sequence[Callable[[], list[Row]]], labels: set[int], total: int, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    """parts: each gives its training rows, when called; total: rows of all parts; labels: those that occur."""
    if len(labels) < 2:
        return Model(np.zeros(ROWS, np.float32), {frozenset(): 0.0, frozenset({0}): -20.0, frozenset({1}): 20.0}[frozenset(labels)])
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (ROWS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    done = 0
    for _ in range(epochs):
        for part in rng.permutation(len(parts)):
            rows = parts[part]()
            for k in rng.permutation(len(rows)):
                made, n, y = rows[k]
                found, counts = unpacked(made)
                lr = np.float32(rate * (1 - done / (epochs * total)))
                done += 1
                share = counts / max(n, 1)
                vectors = e[found]
                h = share @ vectors
                z = h @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = w @ p
                w -= lr * np.outer(h, p)
                b -= lr * np.float32(0.1) * p
                e[found] = vectors - lr * np.outer(share * np.float32(min(n, 1000)), back) / np.float32(20)
    layer = w[:, 1] - w[:, 0]
    return Model(e @ layer, float(b[1] - b[0]))


def train_texts(rows: list[tuple[bytes, int]], **options) -> Model:
    """rows: (text, label 0 or 1), all in memory."""
    made = [(packed(found, counts), n, y) for (found, counts, n), y in ((features(t), y) for t, y in rows)]
    return train([lambda: made], {y for _, y in rows}, len(rows), **options)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, column: str = "quality") -> DataFrame:
    """doc_id, y, features (see packed), n of the training rows, stored; labels is filtered by the caller."""
    ids = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias("y"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found, counts, n = features((batch.column(2)[k].as_py() or "").encode())
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:2]), pa.array([packed(found, counts)]), pa.array([n])], names=["doc_id", "y", "features", "n"])

    return stored(one.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, features binary, n long"))


def packed(found: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets and their counts, compressed (some two bytes a feature)."""
    steps = np.diff(found, prepend=np.int32(0)).astype(np.int32)
    return zlib.compress(np.concatenate((steps, counts.astype(np.int32))).tobytes(), 1)


def unpacked(made: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(made), np.int32)
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int32), both[half:].astype(np.float32)


def fit_rows(rows: DataFrame, part_bytes: int = PART_BYTES, **options) -> Model:
    """Trains on the rows of labelled(), in parts that the driver reads one at a time."""
    size, total = rows.agg(F.sum(F.length("features")), F.count("*")).first()
    n = max(1, -(-int(size or 0) // part_bytes))
    held: list[list[Row]] = []

    def part(k: int) -> list[Row]:
        if held:
            return held[0]
        mine = rows.where(F.expr(f"pmod(xxhash64(doc_id), {n}) = {k}")).select("doc_id", "y", "features", "n").collect()
        made = [(bytes(r.features), r.n, r.y) for r in sorted(mine, key=lambda r: r.doc_id)]
        if n == 1:
            held.append(made)
        return made

    return train([partial(part, k) for k in range(n)], {r.y for r in rows.select("y").distinct().collect()}, total, **options)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score of every row, with the columns named in keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value.weights, shared.value.bias
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(0)):
                bucket, doc = _words(data, offsets)
                total = np.bincount(doc, weights=weights[bucket], minlength=b - a)
                count = np.bincount(doc, minlength=b - a).astype(float)
                made, begins = _grams(data, offsets)
                for grams, ok in made:
                    pad = np.zeros(begins[-1] - len(ok))
                    total += per_doc(np.concatenate((np.where(ok, weights[grams], 0).astype(np.float64), pad)), begins)
                    count += per_doc(np.concatenate((ok, pad)), begins)
                z = np.clip(total / np.maximum(count, 1) + bias, -30, 30)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names[1:], "score"])

    names = ["doc_id", *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select("text", *names).mapInArrow(run, f"{kinds}, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(spark, docs: DataFrame, sf_dir: str) -> Model:
    return fit_rows(labelled(docs, read_table(spark, sf_dir, "labels").where(~held_out())))


def op2_subword_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(spark, docs, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(spark, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score the threshold or more."""
    model = fit(spark, docs, sf_dir)
    # One pass: the row goes through the scorer with its text, under names that cannot clash.
    own = {f"__{k}": c for k, c in enumerate(docs.columns)}
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for n, c in own.items()])
    scored = score(renamed, model, tuple(own))
    return scored.where(F.col("score") >= threshold).select(*[F.col(n).alias(c) for n, c in own.items()])
