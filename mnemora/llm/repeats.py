"""Removal of repeated strings of LENGTH bytes by prefix-free parsing (operator 9).

Parse. Rolling hashes of ``GRAM`` bytes trigger phrases: a string of LENGTH
bytes belongs to the position of the smallest rolling hash among its first ``span``
(the first of equals), so strings that are equal have their trigger at the same place
whatever surrounds them, and every string has one. The strings of one trigger start next to
each other, at lo..hi, and lie in the phrase [lo, hi + LENGTH). A phrase's
strings all hold the core, the LENGTH - span + 1 bytes from its trigger on; so strings of
two phrases can only be equal if the phrases' cores are.

Parse level. Cores are counted over the corpus. A core that occurs once makes
its phrase unique; where all phrases of a core are equal, each is repeated as a
whole. Both are settled by hashes of 64 bits for the core and 64 for the phrase, which is all
that highly repetitive text needs.

Dictionary level. What is left, one copy of each distinct phrase that shares its
core with a different one, is the dictionary. The phrases of a core are sorted twice by
their bytes, by what follows the trigger (the dictionary's suffixes) and by what
precedes it, read backwards; the bytes that neighbours have in common say at which
distances from the trigger a string can have an equal (two phrases that agree in l
bytes before and r bytes after share the strings at distances LENGTH - r to l). Where
neighbours alone do not settle a phrase, strings are told apart by their classes in both
orders at each distance. No hash decides here.

A core whose phrases hold over ``SORT_BYTES`` is not sorted: its phrases are split by
distance into blocks of ``BLOCKS`` distances, whose strings share a longer core, and are
counted and sorted as before; blocks of one distance are strings, equal if their cores are.

Scale: texts are written once, bucketed by row, so neither the join that cuts the
dictionary's phrases nor the one that cuts the result shuffles them. Parse rows
are some 30 bytes for 128 bytes of text. Counts are pre-aggregated. Cores or phrases that make up
more than one in ``HOT_KEYS`` of the rows, at most so many, are joined by broadcast;
their rows are not shuffled, and their runs are merged within a text first.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing, nor are
parts of characters kept whole (bytes are judged); equal rows repeat each other;
a null doc_id is carried; an empty table gives an empty result; columns besides
doc_id and text are ignored. Rows are told apart by their place in docs, which must
be the same when a task runs again (as that of a table read from files is).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, chunks, drop_stored, mix, read_table, stored

LENGTH = 400
#: What op9 reports as shared passages beside: some fifty words of few letters.
PASSAGE = 200
GRAM = 32
HOT_KEYS = 20_000
SORT_BYTES = 8 << 20
BLOCKS = (32, 4, 1)
SORTED = 1 << 21
PHRASE = "row long, lo int, hi int, t int, core long, phrase long"
_ODD = np.uint64(0xA24BAED4963EE407)


def span_of(length: int) -> int:
    """The largest power of two below two thirds of the length."""
    return 1 << ((2 * length // 3).bit_length() - 1)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, lo, hi, trigger - lo, core, phrase hash) of every trigger; lo and hi count from the chunk's start."""
    n, span = len(data), span_of(length)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length:
        return none
    edges = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= length
    edges[offsets[:-1][long]] += 1
    edges[offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(edges[: n - length + 1]) > 0
    prefix = Prefix(data)
    grams = mix((prefix.sums[GRAM:] - prefix.sums[:-GRAM]) * prefix.down[: n - GRAM + 1])
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    trigger = (low[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new & valid)
    if not len(lo):
        return none
    last = np.ones(len(trigger), bool)
    last[:-1] = new[1:] | ~valid[1:]
    hi = np.flatnonzero(last & valid)
    q = trigger[lo]
    core = prefix.of(q, q + length - span + 1)
    whole = mix(prefix.of(lo, hi + length) + (q - lo).astype(np.uint64) * _ODD)
    return np.searchsorted(offsets, lo, side="right") - 1, lo, hi, q - lo, core.view(np.int64), whole.view(np.int64)


def _parse(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                doc, lo, hi, t, core, whole = phrases(data, offsets, length)
                if len(doc):
                    rows = batch.column(0).slice(a, b - a).take(pa.array(doc))
                    small = [pa.array(x.astype(np.int32)) for x in (lo - offsets[doc], hi - offsets[doc], t)]
                    yield pa.RecordBatch.from_arrays([rows, *small, pa.array(core), pa.array(whole)], names=["row", "lo", "hi", "t", "core", "phrase"])

    return run


def agreement(data: np.ndarray, q: np.ndarray, before: np.ndarray, after: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and from their triggers on the phrases x and y have in common."""
    left, right = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    reach = int(before.max(initial=0))
    on, back = np.arange(length), np.arange(1, reach + 1)
    top = len(data) - 1
    for at in range(0, len(x), 1024):
        p, r = x[at : at + 1024], y[at : at + 1024]
        for steps, room, out in ((on, np.minimum(after[p], after[r]), right), (-back, np.minimum(before[p], before[r]), left)):
            differ = data[np.clip(q[p][:, None] + steps, 0, top)] != data[np.clip(q[r][:, None] + steps, 0, top)]
            found = np.where(differ.any(axis=1), differ.argmax(axis=1), len(steps)) if len(steps) else np.zeros(len(p), np.int64)
            out[at : at + 1024] = np.minimum(found, room)
    return left, right


def repeated_distances(core: list[int], texts: list[bytes], t: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """For each phrase (its trigger at t, so many strings) and distance from the trigger, whether the string there equals one of another phrase of its core."""
    n, sizes = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    q = np.cumsum(sizes) - sizes + t
    far, near = t, t - strings + 1  # the distances of the first and the last string
    width = int(far.max()) + 1
    named = np.unique(np.array(core, np.int64), return_inverse=True)[1]
    suffixes = np.array(sorted(range(n), key=lambda i: (core[i], texts[i][t[i] :])))
    prefixes = np.array(sorted(range(n), key=lambda i: (core[i], texts[i][: t[i]][::-1])))
    out = np.zeros((n, width + 1), np.int32)
    best = np.zeros((2, n), np.int64)  # most bytes in common with any phrase of the core: after, before
    common = []
    for k, order in enumerate((suffixes, prefixes)):
        x, y = order[:-1], order[1:]
        same = np.flatnonzero(named[x] == named[y])
        left, right = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
        left[same], right[same] = agreement(data, q, far, sizes - t, x[same], y[same], length)
        common.append(left if k else right)
        x, y, l, r = x[same], y[same], left[same], right[same]  # noqa: E741
        for one in (x, y):
            np.maximum.at(best[k], one, l if k else r)
        a, b = np.maximum.reduce([length - r, near[x], near[y]]), np.minimum.reduce([l, far[x], far[y]])
        met = a <= b
        for one in (x[met], y[met]):
            np.add.at(out, (one, a[met]), 1)
            np.add.at(out, (one, b[met] + 1), -1)
    found = np.cumsum(out[:, :width], axis=1) > 0
    # What neighbours have not settled: distances that both orders allow and no neighbour shares.
    distance = np.arange(width)
    allowed = (distance >= np.maximum(length - best[0], near)[:, None]) & (distance <= np.minimum(best[1], far)[:, None])
    open_ = np.flatnonzero((allowed & ~found).any(axis=1))
    if len(open_):
        of_core = np.isin(named, named[open_])
        mine = np.flatnonzero(of_core)
        for at in range(0, width, 16):
            d = distance[at : at + 16]
            classes = []
            for order, shared, need in ((suffixes, common[0], length - d), (prefixes, common[1], d)):
                border = np.ones((n, len(d)), np.int64)
                border[1:] = (named[order[1:]] != named[order[:-1]])[:, None] | (shared[:, None] < need)
                names = np.empty((n, len(d)), np.int64)
                names[order] = np.cumsum(border, axis=0)
                classes.append(names[mine])
            key = classes[0] * (n + 1) + classes[1]
            outside = (d < near[mine][:, None]) | (d > far[mine][:, None])
            key = np.where(outside, -1 - np.arange(len(mine))[:, None], key)
            rank = np.argsort(key, axis=0, kind="stable")
            in_order = np.take_along_axis(key, rank, axis=0)
            twin = np.zeros(key.shape, bool)
            twin[1:] = in_order[1:] == in_order[:-1]
            twin[:-1] |= twin[1:]
            hit = np.empty(key.shape, bool)
            np.put_along_axis(hit, rank, twin, axis=0)
            found[mine, at : at + 16] |= hit
    return found


def _sort_dictionary(length: int):
    """Rows (core, row, lo, hi, t, once, text), sorted by core: the covered runs of the phrases that occur once."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        core, row, lo, hi, t, once, texts = zip(*held, strict=True)
        lo, t = np.array(lo, np.int64), np.array(t, np.int64)
        found = repeated_distances(list(core), list(texts), t, np.array(hi, np.int64) - lo + 1, length)
        found &= np.array(once)[:, None]
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        k, first = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        q = lo + t
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(row, np.int64)[k]), pa.array((q[k] - stop + 1).astype(np.int32)), pa.array((q[k] - first + length).astype(np.int32))], names=["row", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and size >= SORTED:
                    yield from settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield from settle(held)

    return run


def _split(length: int, block: int):
    """Phrases of crowded cores, in parts of `block` distances each, as rows of a parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for core, row, lo, hi, t, once, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix = Prefix(np.frombuffer(text, np.uint8))
                near = t - (hi - lo)
                k = np.arange(near // block, t // block + 1)
                d0, d1 = np.maximum(near, k * block), np.minimum(t, k * block + block - 1)
                inner = mix(prefix.of(t - k * block, t - k * block + length - block + 1) + k.astype(np.uint64) * _ODD + np.uint64(core % 2**64))
                whole = mix(prefix.of(t - d1, t - d0 + length) + d1.astype(np.uint64) * _ODD)
                out.append([np.full(len(k), row), lo + t - d1, lo + t - d0, d1, inner.view(np.int64), whole.view(np.int64), np.full(len(k), once)])
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "lo", "hi", "t", "core", "phrase", "once"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            out = []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or b""
                out += [(p["core"], p["row"], p["lo"], p["hi"], p["t"], p["alone"], text[p["lo"] : p["hi"] + length]) for p in batch.column(1)[k].as_py()]
                if len(out) >= 4096:
                    yield _cuts(out)
                    out = []
            if out:
                yield _cuts(out)

    return run


def _cuts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["core", "row", "lo", "hi", "t", "once", "text"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (row, a, b) that touch the one before them in the same row joined with it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (a[1:] > b[:-1]) | (a[1:] < a[:-1])))
        first = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(a[first]), pa.array(np.maximum.reduceat(b, first))], names=["row", "a", "b"])


def _level(texts: DataFrame, rows: DataFrame, length: int, tables: list[DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """(runs that hashes settle, dictionary of the rest) of the rows of a parse (row, lo, hi, t, core, phrase, once)."""
    keep = lambda df: tables.append(stored(df)) or tables[-1]
    covered = lambda df: df.select("row", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    limit = max(1000, rows.count() // HOT_KEYS)
    cores = keep(rows.groupBy("core").agg(F.count("*").alias("n"), (F.min("phrase") == F.max("phrase")).alias("same")).where("n > 1"))
    # Cores of more rows than the limit are HOT_KEYS at most: their rows are told by broadcast and stay where they are.
    hot = F.broadcast(cores.where(F.col("n") > limit).select("core", F.col("same").alias("hot_same")))
    seen = rows.join(hot, "core", "left")
    columns = ["row", "lo", "hi", "t", "core", "phrase", "once"]
    usual = seen.where("hot_same is null").join(cores.where(F.col("n") <= limit).select("core", "same"), "core").select(*columns, "same")
    shared = keep(usual.union(seen.where("hot_same is not null and not hot_same").select(*columns, F.lit(False))))
    runs = [covered(shared.where("same and once")), covered(seen.where("hot_same and once")).mapInArrow(_merged, "row long, a int, b int")]
    mixed = shared.where("not same").drop("same")
    distinct = keep(mixed.groupBy("core", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi", "t")).alias("at"), F.min("once").alias("once")))
    frequent = F.broadcast(distinct.where(F.col("n") > limit).select("core", "phrase", F.lit(True).alias("hot")))
    marked = mixed.where("once").join(frequent, ["core", "phrase"], "left")
    copies = marked.where("hot is null").join(distinct.where((F.col("n") > 1) & (F.col("n") <= limit)).select("core", "phrase"), ["core", "phrase"])
    runs += [covered(copies), covered(marked.where("hot")).mapInArrow(_merged, "row long, a int, b int")]
    alone = (F.col("once") & (F.col("n") == 1)).alias("alone")
    wanted = distinct.select(F.col("at.row").alias("r"), F.struct("core", "at.row", "at.lo", "at.hi", "at.t", alone).alias("p")).groupBy("r").agg(F.collect_list("p").alias("ps"))
    cut = texts.join(wanted.hint("shuffle_hash"), texts.row == wanted.r).select("text", "ps").mapInArrow(_cut(length), "core long, row long, lo int, hi int, t int, once boolean, text binary")
    return runs, keep(cut)


def spans(texts: DataFrame, length: int = LENGTH, sort_bytes: int = SORT_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(row, a, b): bytes to remove from the text of each row, runs that may overlap; and the tables they are read from.

    texts: row (long, unique), text.
    """
    tables: list[DataFrame] = []
    runs: list[DataFrame] = []
    rows = stored(texts.select("row", "text").mapInArrow(_parse(length), PHRASE)).withColumn("once", F.lit(True))
    tables.append(rows)
    for block in (*BLOCKS, 0):
        settled, dictionary = _level(texts, rows, length, tables)
        runs += settled
        crowded = stored(dictionary.groupBy("core").agg(F.sum(F.length("text")).alias("size")).where(F.col("size") > sort_bytes).select("core"))
        tables.append(crowded)
        more = block and not crowded.isEmpty()
        usual = dictionary.join(crowded, "core", "left_anti") if more else dictionary
        runs.append(usual.repartition("core").sortWithinPartitions("core").mapInArrow(_sort_dictionary(length), "row long, a int, b int"))
        if not more:
            break
        rows = stored(dictionary.join(crowded, "core", "left_semi").mapInArrow(_split(length, block), f"{PHRASE}, once boolean"))
        tables.append(rows)
    out = runs[0]
    for more in runs[1:]:
        out = out.union(more)
    return out, tables


def coverage(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Runs {a, b} in any order as disjoint ones in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in runs or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _apply(names: list[str], with_text: bool, passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(0).cast(pa.binary()), batch.column(1)
            removed, count, digests, kept, sizes, shared = [], [], [], [], [], []
            for k in range(batch.num_rows):
                text, at, parts = texts[k].as_py() or b"", 0, []
                gone = coverage(runs[k].as_py())
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                left = b"".join([*parts, text[at:]])
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left)
                if passages:
                    found = coverage(batch.column(2)[k].as_py())
                    shared.append((len(found), sum(b - a for a, b in found)))
            tail = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests)]
            if with_text:
                tail.append(pa.array(kept, pa.binary()))
            if passages:
                tail += [pa.array([x for x, _ in shared], pa.int64()), pa.array([x for _, x in shared], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2 + passages :], *tail], names=names)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, passage: int | None = None, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row; stored, its tables dropped.

    With `passage`, n_passages and passage_bytes too: the runs that strings of so many bytes
    cover that start anywhere else (found in the same way, not removed).
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"mnemora_{uuid.uuid4().hex}"
    # Rows are told apart by their place, so that equal rows are occurrences of their own.
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    keyed.repartition(n, "row").write.option("compression", "zstd").bucketBy(n, "row").saveAsTable(name)
    try:
        texts = spark.table(name)
        joined, tables = texts, []
        lists = []
        for k, size in enumerate([length, *([passage] if passage else [])]):
            runs, made = spans(texts, size, sort_bytes)
            tables += made
            by_row = runs.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias(f"runs_{k}")).withColumnRenamed("row", f"r_{k}")
            joined = joined.join(by_row.hint("shuffle_hash"), F.col("row") == F.col(f"r_{k}"), "left")
            lists.append(f"runs_{k}")
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []), *(["n_passages", "passage_bytes"] if passage else [])]
        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "") + (", n_passages long, passage_bytes long" if passage else "")
        out = stored(joined.select("text", *lists, "doc_id").mapInArrow(_apply(names, with_text, bool(passage)), schema))
        for t in tables:
            drop_stored(t)
        return out
    finally:
        spark.sql(f"drop table if exists {name}")


def op9_prefix_free_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"), passage=PASSAGE)
