"""Near copies by SimHash of bags of shingles (the wide form of operator 8).

Two bits of a whole text's fingerprint hold only the closest copies: at a shingle
similarity of 0.8 two fingerprints differ in some ten of 64 bits, where bit counts
of segments no longer bound anything. So a text's distinct 5-word shingles are dealt
by hash into bags of two to four (fewer in short texts), and each bag is
fingerprinted. A copy changes
few bags and leaves the fingerprints of the others as they are (0 bits apart, the
grid's own cell). The first ``BAGS`` bags of a text are kept; texts that share one are
candidates, and each candidate pair is verified by the exact Jaccard similarity
of the two texts' shingles. A pair at 0.8 shares none of its bags with a
probability under one in a thousand.

Links of the whole fingerprints (operator 8's own, two bits) are added, so no
group of that operator is split. One document of each component stays.

Scale: a text gives at most 2 * BAGS rows of 28 bytes; copies of a text are one
member. First each member is compared with two others of its bag: the smallest text
hash (the same text in all bags that it leads) and the member whose bags are
largest, which in a group of copies is the one nearest to what they were copied
from. Texts of bags that this leaves in several components are then searched for all
pairs that reach the threshold. Shingles that texts of different components share are
found by one aggregation; only they can be common to a pair, so a text that has fewer
than 0.8 of its own goes. In any one order of all shingles two sets of n and m
shingles, of which p and q are shared, can only reach the threshold if they have one in
common among the first p - 0.8 n + 1 and q - 0.8 m + 1; rare shingles come first, so a
phrase that many texts share brings no pairs. Pairs of one component are left out. Where over
``FEW`` texts share such a shingle no pairs are made: texts are put in blocks, alike ones together,
and blocks that share one are compared by matrix products in one task for each two, which
gives no more links than join them. Only the texts of candidate pairs are
read again, with their shingles; components are found in the shared folder.
Texts that many others resemble to nearly 0.8, in shingles that all of them share, and that no
link joins, still cost the square of their number in arithmetic (512 by 512 at a time), not in rows.

Defined cases: as in simhash; a text with fewer than five words is one shingle of all
its words, and texts without a word are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Prefix, chunks, components, scratch, skewed_join, stored, windows, words_of

SHINGLE = 5
THRESHOLD = 0.8
BAGS = 16
#: Short texts have 16 bags too, of fewer shingles.
LEAST_LEVEL = 4
BROADCAST_ROWS = 500_000
#: A shingle of more texts is compared in blocks, of so many shingles together; a text counts as LEAST_WEIGHT of them at least.
FEW = 32
LEAST_WEIGHT = 2048
BLOCK_WEIGHT = 512 * LEAST_WEIGHT


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk (ASCII letters lower-cased)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, doc = words_of(low, offsets)
    hashes = Prefix(low).of(start, end)
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    whole = windows(hashes, n) if len(hashes) else hashes
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(windows(hashes[a:b], b - a)[:1] if b > a else np.zeros(1, np.uint64))
    return out


def bags(shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(level, bag, fingerprint) of the first bags of a text's shingles, at the level of its size and of a size 1.25 times that."""
    n = len(shingles)
    for level in sorted({max(LEAST_LEVEL, int(np.log2(n / 2))), max(LEAST_LEVEL, int(np.log2(n * 1.25 / 2)))} if n > 1 else {LEAST_LEVEL}):
        top = shingles >> np.uint64(64 - level)
        kept = shingles[: int(np.searchsorted(top, BAGS))]
        ends = np.searchsorted(top[: len(kept)], np.arange(min(BAGS, 1 << level) + 1))
        bits = np.unpackbits(kept.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for bag, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if b > a:
                ones = bits[a:b].sum(axis=0, dtype=np.int64)
                yield level, bag, int(np.packbits(2 * ones > b - a).view(">i8")[0])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, text) to (h, level, bag, fp), each text once per batch."""
    for batch in batches:
        seen: set[int] = set()
        h = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in chunks(batch.column(1)):
            rows = []
            for key, shingles in zip(h[a:b].tolist(), shingle_sets(data, offsets), strict=True):
                if key not in seen:
                    seen.add(key)
                    rows += [(key, *x) for x in bags(shingles)]
            if rows:
                kinds = (pa.int64(), pa.int8(), pa.int8(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "level", "bag", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            made = [s.tobytes() for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made, pa.binary())], names=["h", "s"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (2, 3))
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = both >= threshold * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, root, s) to a row (t, h, root, n) for each shingle of each set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            which = pa.array(np.repeat(np.arange(len(sets)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), part.column(0).take(which), part.column(1).take(which), pa.array(np.repeat(sizes, sizes))], names=["t", "h", "root", "n"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, root, n, s) of a partition, in order, with the partition and the weight of the rows before: a row weighs its shingles, at least LEAST_WEIGHT."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        weight = np.maximum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64), LEAST_WEIGHT)
        upto = before + np.cumsum(weight)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(upto - weight), pa.array(upto), *batch.columns], names=["part", "before", "upto", "h", "root", "n", "s"])
        before = int(upto[-1]) if batch.num_rows else before


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each set of left has in common with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        token = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        sides.append((token, np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for token, row in sides:
        at = np.minimum(np.searchsorted(both, token), max(len(both) - 1, 0))
        hit = both[at] == token if len(both) else np.zeros(len(token), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], row[hit][order]))
    for begin in range(0, len(both), columns):
        width = min(columns, len(both) - begin)
        matrix = []
        for (at, row), sets in zip(placed, (left, right), strict=True):
            lo, hi = np.searchsorted(at, (begin, begin + width))
            m = np.zeros((len(sets), width), np.float32)
            m[row[lo:hi], at[lo:hi] - begin] = 1
            matrix.append(m)
        out += matrix[0] @ matrix[1].T
    return out


def _block_links(threshold: float):
    """Rows (block, other, side, h, root, n, s), sorted by block and other, to links (a, b) that reach the threshold between different roots: as many as join what they join, no more."""

    def settle(held: list[dict]) -> pa.RecordBatch:
        same = held[0]["block"] == held[0]["other"]
        left = [r for r in held if same or r["side"] == 0]
        right = left if same else [r for r in held if r["side"] == 1]
        column = lambda rows, name: np.array([r[name] for r in rows], np.int64)
        found = overlaps([np.array(r["s"], np.int64) for r in left], [np.array(r["s"], np.int64) for r in right])
        size = column(left, "n")[:, None] + column(right, "n")[None, :] - found
        near = (found >= threshold * size - 1e-6) & (column(left, "root")[:, None] != column(right, "root")[None, :])
        if same:
            near &= np.tri(len(left), k=-1, dtype=bool)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        out = []
        for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
            p, q = find(left[i]["root"]), find(right[j]["root"])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((left[i]["h"], right[j]["h"]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if held and (row["block"], row["other"]) != (held[0]["block"], held[0]["other"]):
                        yield settle(held)
                        held = []
                    held.append(row)
        if held:
            yield settle(held)

    return run


def unlinked_pairs(live: DataFrame, threshold: float, few: int = FEW, weight: int = BLOCK_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) to be verified, links (a, b) that are) of rows (h, root, s) with different roots: together they join all that the threshold joins.

    Only shingles that texts of different roots share can be common to a pair; a text with fewer of
    them than the threshold asks for has no partner. Texts that share one of their first shingles
    with at most `few` others are paired with them; where there are more, blocks of texts that share one are
    compared whole, in one task for each two blocks, and give no more links than join them.
    """
    rows = stored(live.select("h", "root", "s").mapInArrow(_tokens, "t long, h long, root long, n long"))
    kinds = rows.groupBy("t").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    common = stored(kinds.select("t", "c", F.col("c").alias("often")))
    shared = skewed_join(rows, common, "t", "c", rows.count())
    need = F.ceil(threshold * F.col("n") - 1e-9)
    counted = stored(shared.withColumn("m", F.count("*").over(Window.partitionBy("h"))).where(F.col("m") >= need))
    # Rare shingles first, in the one order of all texts.
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("often", "t")))
    first = stored(ranked.where(F.col("k") <= F.col("m") - need + 1).select("t", "h", "root", "n", "m"))
    several = stored(first.groupBy("t").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t", "c"))
    rare = first.join(several.where(F.col("c") <= few).select("t"), "t")
    other = rare.select("t", F.col("h").alias("o"), F.col("root").alias("other"), F.col("n").alias("size"), F.col("m").alias("most"))
    asked = f"{threshold} / (1 + {threshold}) * (n + size) - 1e-6"  # shingles in common at the threshold
    near = rare.join(other, "t").where(f"h > o and root <> other and least(n, size) >= {threshold} * greatest(n, size) - 1e-6 and least(m, most) >= {asked}")
    pairs = stored(near.select(F.col("h").alias("a"), F.col("o").alias("b")).distinct())

    frequent = stored(first.join(several.where(F.col("c") > few).select("t"), "t").select("t", "h"))
    sets = counted.join(frequent.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.sort_array(F.collect_list("t")).alias("s"))
    # Texts alike stand together in the order of their least shingle by hash, so few blocks share anything.
    least = F.array_min(F.transform("s", lambda x: F.xxhash64(x)))
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sets.withColumn("key", least).repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h").select("h", "root", "n", "s")
    numbered = stored(ordered.mapInArrow(_numbered, "part int, before long, upto long, h long, root long, n long, s array<long>"))
    # Blocks go on over the partitions' ends: the driver adds up one number for each partition.
    spark, start, starts = live.sparkSession, 0, []
    for r in numbered.groupBy("part").agg(F.max("upto").alias("upto")).orderBy("part").collect():
        starts.append((r.part, start))
        start += r.upto
    placed = numbered.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    blocks = stored(placed.select(F.expr(f"(start + before) div {weight}").alias("block"), "h", "root", "n", "s"))
    in_block = frequent.join(blocks.select("h", "block"), "h").select("t", "block").distinct()
    # Most shingles of a group lie in the same blocks: each set of blocks counts once.
    met = in_block.groupBy("t").agg(F.sort_array(F.collect_set("block")).alias("bs")).select("bs").distinct()
    two = stored(met.select(F.explode("bs").alias("block"), "bs").select("block", F.explode("bs").alias("other")).where("block <= other").distinct())
    left = two.join(blocks, "block").select("block", "other", F.lit(0).alias("side"), "h", "root", "n", "s")
    right = two.where("block < other").join(blocks.withColumnRenamed("block", "other"), "other").select("block", "other", F.lit(1).alias("side"), "h", "root", "n", "s")
    together = left.union(right).repartition("block", "other").sortWithinPartitions("block", "other")
    return pairs, stored(together.mapInArrow(_block_links(threshold), "a long, b long"))


def similar_texts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) of text hashes whose components are those of all pairs of texts that share a bag and reach the threshold (hubs first, then every pair that they leave apart)."""
    keyed = docs.select(text_hash().alias("h"), "text")
    sketch = stored(keyed.mapInArrow(_sketch, "h long, level byte, bag byte, fp long").distinct())
    bag = ["level", "bag", "fp"]
    sizes = sketch.groupBy(*bag).agg(F.count("*").alias("n")).where("n > 1")
    met = stored(sketch.join(sizes, bag))
    weight = met.groupBy("h").agg(F.sum("n").alias("w"))
    heads = met.join(weight, "h").groupBy(*bag).agg(F.min("h").alias("lo"), F.max(F.struct("w", "h")).alias("top")).select(*bag, "lo", F.col("top.h").alias("hi"))
    near = met.join(heads, bag).select(F.explode(F.array(F.struct("h", F.col("lo").alias("o")), F.struct("h", F.col("hi").alias("o")))).alias("p")).where("p.h <> p.o")
    pairs = stored(near.select(F.greatest("p.h", "p.o").alias("a"), F.least("p.h", "p.o").alias("b")).distinct())
    # One row of each text in a pair is read again.
    named = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    first = docs.select(text_hash().alias("h"), "doc_id").join(named, "h").groupBy("h").agg(F.min("doc_id").alias("id"))
    wanted = stored(first)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # 16 bytes a row: 8 MB at most
    texts = docs.select(text_hash().alias("h"), "text", "doc_id").join(wanted.withColumnRenamed("h", "k"), (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = stored(texts.select("h", "text").mapInArrow(_sets, "h long, s binary").dropDuplicates(["h"]))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a long, b long")

    links = stored(verified(pairs))
    # Texts of bags that hold several components, against each other.
    rooted = met.join(components(links).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    split = rooted.groupBy(*bag).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*bag)
    live = stored(rooted.join(split, bag).select("h", "root").distinct().join(sets, "h"))
    pairs, found = unlinked_pairs(live, threshold)
    return links.union(verified(pairs)).union(found)


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, max_bits: int = 2) -> DataFrame:
    """One document of each group of copies and near copies, that of the smallest doc_id; all columns kept.

    Groups: equal texts, texts within max_bits of each other's fingerprints (3-word
    shingles), texts of a 5-word shingle similarity of the threshold or more.
    """
    with scratch(docs.sparkSession) as keep:
        prints = stored(simhash.with_hash(docs, 3))
        first = stored(prints.groupBy("fp").agg(F.min("h").alias("h")))
        bits = simhash.links(first, max_bits)
        of = first.withColumnRenamed("fp", "f")
        whole = bits.join(of.select(F.col("f").alias("a"), F.col("h").alias("ha")), "a").join(of.select(F.col("f").alias("b"), F.col("h").alias("hb")), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
        equal = prints.select("fp", "h").distinct().join(of, F.col("fp") == F.col("f")).select(prints.h.alias("a"), of.h.alias("b")).where("a <> b")
        roots = components(whole.union(equal).union(similar_texts(docs, threshold)))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
        # Two steps, so that many copies of a text are reduced before its group meets.
        texts = prints.groupBy("h").agg(F.min(order).alias("w"))
        grouped = texts.join(roots, texts.h == roots.node, "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("w").alias("w"))
        winners = stored(grouped.select("w.doc_id", "w.h"))
        keep += [prints, winners]
    return simhash.only(docs, prints, winners)
