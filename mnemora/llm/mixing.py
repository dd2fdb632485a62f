"""Mixing sources to target weights by entropy balancing (operator 1).

Every document i of source s gets a rate r_i that minimises
sum r_i (log r_i - 1) under sum_{i in s} r_i size_i = target_s and
0 <= r_i <= 2. The convex dual has one multiplier per source and
r_i = min(2, exp(lambda_s * size_i / mean_s)); its gradient and Hessian are sums
over the source's documents, computed as one distributed aggregation per Newton
step over the (source, size) histogram. The rates are then rounded into 0, 1 or
2 copies, first of each size of a source, then of its documents. A dual that
does not converge raises an error.

Scale: documents are read once for their word counts; every iteration and the
rounding of sizes work on the histogram (one row per source and distinct size, however
many documents there are). Documents of one source and size beyond ``STRATUM``
rows, or one in ``HOT_SIZES`` of all, are split by a hash of the document, so
neither a hot source nor a hot group of copies lands in one task. The driver
sees only one row per source (checked: at most ``MAX_SOURCES``).

Defined cases: a null or blank text has size 0, target as its source and takes
no words; a null source is one source, last in order; rows repeated in full or in
their id are separate documents; an empty table gives an empty result; further
columns of any name are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, read_table, stored

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
STRATUM = 4096
MAX_SOURCES = 200_000
HOT_SIZES = 20_000
NEWTON_STEPS = 200
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def word_count(text: str = "text"):
    return F.expr(f"coalesce(regexp_count({text}, '{WORD}'), 0)").cast("long")


def targets(sizes: pd.DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> pd.DataFrame:
    """sizes: source, total; adds target. Sources by code point, null last; what exceeds a cap is reshared by weight until none is above."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes.source[i] is None, sizes.source[i] or ""))
    out = sizes.iloc[order].reset_index(drop=True)
    w = np.array([weights[i % len(weights)] for i in range(len(out))], float)
    size = out.total.to_numpy(float)
    cap, target = most * size, np.zeros(len(out))
    free, left = np.ones(len(out), bool), share * float(size.sum())
    while free.any():
        want = left * w / w[free].sum()
        over = free & (want >= cap)
        if not over.any():
            target[free] = want[free]
            break
        target[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    out["target"] = target
    return out


def solve(histogram: DataFrame, goal: pd.DataFrame, most: float = MOST_COPIES, steps: int = NEWTON_STEPS, tolerance: float = 1e-9) -> pd.DataFrame:
    """Safeguarded Newton on the dual, all sources at once; histogram: source_no, size, n. Adds lam and mean to goal."""
    spark = histogram.sparkSession
    out = goal.copy()
    total, count = out.total.to_numpy(float), np.maximum(out.n_words_docs.to_numpy(float), 1)
    mean = np.maximum(total / count, 1.0)
    target = out.target.to_numpy(float)
    full = target >= most * total * (1 - 1e-12)
    lam = np.log(np.clip(target / np.maximum(total, 1), 1e-9, most))
    low, high = np.full(len(out), -1e3), np.full(len(out), 1e3)
    todo = ~full & (total > 0) & (target > 0)
    for _ in range(steps):
        if not todo.any():
            break
        now = spark.createDataFrame(pd.DataFrame({"source_no": np.flatnonzero(todo), "lam": lam[todo], "mean": mean[todo]}))
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
        capped = rate >= most
        sums = (
            histogram.join(F.broadcast(now), "source_no")  # one row per source, at most MAX_SOURCES
            .groupBy("source_no")
            .agg(F.sum(F.col("n") * F.least(rate, F.lit(float(most))) * F.col("size")).alias("g"), F.sum(F.when(capped, 0.0).otherwise(F.col("n") * rate * z * F.col("size"))).alias("h"))
            .toPandas()
            .set_index("source_no")
        )
        i = sums.index.to_numpy()
        gap = sums.g.to_numpy() - target[i]
        low[i] = np.where(gap < 0, lam[i], low[i])
        high[i] = np.where(gap > 0, lam[i], high[i])
        with np.errstate(divide="ignore", invalid="ignore"):
            step = lam[i] - gap / sums.h.to_numpy()
        inside = np.isfinite(step) & (step > low[i]) & (step < high[i])
        lam[i] = np.where(inside, step, (np.maximum(low[i], -50) + np.minimum(high[i], 50)) / 2)
        todo[i] = (np.abs(gap) > tolerance * np.maximum(target[i], 1) + 1e-6) & (high[i] - low[i] > 1e-13)
    if todo.any():
        raise RuntimeError(f"{int(todo.sum())} sources are not balanced after {steps} steps")
    lam[full] = 1e3
    lam[~full & (target <= 0)] = -1e3
    return out.assign(lam=lam, mean=mean)


def _round(most: int):
    """Copies of each (source, size) of one source: rounding errors are carried on, large documents first, so the source's words end within half of its smallest document's size."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False, kind="stable")
        size, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        z = np.minimum(group["lam"].to_numpy() * size / group["mean"].to_numpy(), 700.0)
        want = np.minimum(np.exp(z), most) * n * size
        copies, carry = np.zeros(len(group), np.int64), 0.0
        for k in range(len(group)):
            if size[k]:
                carry += want[k]
                copies[k] = min(most * n[k], max(0, math.floor(carry / size[k] + 0.5)))
                carry -= copies[k] * size[k]
        group["copies"] = copies
        return group[["source_no", "size", "n", "copies"]]

    return run


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES, stratum: int = STRATUM) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies): one row per document with the copies the mix takes.

    ``row`` is a hash of the whole row's content, which orders equal sizes.
    """
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("row")))
    per_size = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = per_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_words_docs"), F.sum("n").alias("n_docs"))
    if sources.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of sources instead")
    found = sources.collect()
    listed = [(r.source, int(r.total), int(r.n_words_docs)) for r in found]
    goal = targets(pd.DataFrame(listed, columns=["source", "total", "n_words_docs"]).astype({"source": object}).where(lambda d: d.notna(), None), weights, share, most)
    goal["source_no"] = range(len(goal))
    schema = "source_no long, source string, source_size long, target double, lam double, mean double"
    plain = spark.createDataFrame([(int(r.source_no), r.source) for r in goal.itertuples()], "source_no long, source string")
    histogram = stored(per_size.join(F.broadcast(plain), per_size.source.eqNullSafe(plain.source)).select("source_no", "size", "n"))
    goal = solve(histogram, goal, most)
    table = F.broadcast(spark.createDataFrame([(int(r.source_no), r.source, int(r.total), float(r.target), float(r.lam), float(r.mean)) for r in goal.itertuples()], schema))
    quota = stored(histogram.join(table.select("source_no", "lam", "mean"), "source_no").groupBy("source_no").applyInPandas(_round(most), "source_no long, size long, n long, copies long"))

    drop_stored(per_size)
    drop_stored(histogram)
    numbered = sized.join(table.select("source_no", "source", "source_size", "target"), sized.source.eqNullSafe(table.source)).select("source_no", sized.source, "doc_id", "size", "row", "source_size", "target")
    # Strata of over `limit` documents are split; there are HOT_SIZES of them at most, so their list is broadcast.
    limit = max(stratum, sum(int(r.n_docs) for r in found) // HOT_SIZES)
    large = quota.where(F.col("n") > limit).select("source_no", "size", F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    salted = numbered.join(F.broadcast(large), ["source_no", "size"], "left").withColumn("salt", F.expr("pmod(xxhash64(row, 7), coalesce(salts, 1))").cast("int")).drop("salts")
    # The copies of a stratum are dealt to its salts in proportion, by differences of a rounded running share.
    strata = salted.groupBy("source_no", "size", "salt").agg(F.count("*").alias("here"))
    upto = F.expr("sum(here) over (partition by source_no, size order by salt)")
    shared = strata.join(quota, ["source_no", "size"]).withColumn("upto", upto).withColumn("extra", F.expr("cast(copies % n as decimal(38, 0))"))
    dealt = shared.select("source_no", "size", "salt", F.expr("copies div n as base"), F.expr("cast(extra * upto div n - extra * (upto - here) div n as long) as extra"))
    ranked = salted.join(dealt, ["source_no", "size", "salt"]).withColumn("k", F.expr("row_number() over (partition by source_no, size, salt order by row, doc_id) - 1"))
    return ranked.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("base") + F.when(F.col("k") < F.col("extra"), 1).otherwise(0)).cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, in the columns of docs."""
    plan = mix(docs.select("doc_id", "text", "source"), **options)
    # Rows equal in id and text are interchangeable: their copies are summed and dealt out evenly.
    share = plan.groupBy("row", F.col("doc_id").alias("id")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    # The rows travel as one column, so that no name of theirs can clash.
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("own"))
    joined = whole.join(share, (F.col("own") == F.col("row")) & F.col("doc.doc_id").eqNullSafe(F.col("id")))
    alone = joined.where("n = 1").select("doc", F.col("copies").alias("take"))
    again = joined.where("n > 1").withColumn("j", F.expr("row_number() over (partition by own, id order by doc.source) - 1")).select("doc", F.expr("copies div n + if(j < copies % n, 1, 0)").alias("take"))
    return alone.union(again).select("doc", F.explode(F.expr("array_repeat(0, cast(take as int))"))).select("doc.*")


def op1_entropy_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast(T.LongType()).alias("taken"), "copies", "source")
