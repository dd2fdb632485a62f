"""Operator 11 against plain loops over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row int, id string, v string, anchor string"


def plain(rows, positives=5, kept=3):
    """rows: (vec_id, vector, label). Every row on its own, so rows of one id are different rows."""
    usable = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(usable):
        if i % 50:
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, w, _ in usable]  # the shorter counts as filled up with zeros
        order = sorted((-s, usable[b][0], b) for b, s in enumerate(score) if b != a)
        same = [(j, -s) for s, j, b in order if usable[b][2] == c][:positives]
        for j, p in same:
            for rank, (s, n, _) in enumerate([x for x in order if usable[x[2]][2] != c and 50 * p <= -100 * x[0] <= 95 * p][:kept], 1):
                out.append((i, j, rank, n, p, -s))
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, c, 0, "x", "y", "z") for i, v, c in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **kw).collect())


def f32(x):
    return [None if y is None else float(np.float32(y)) for y in x]


@pytest.mark.parametrize("block_bytes", [1, 700, 1 << 20])
def test_blocks_and_ties_equal_plain_loops(spark, block_bytes):
    rng = np.random.default_rng(5)
    rows = [(k, f32(rng.integers(-3, 4, 6) / 256), int(rng.integers(0, 3))) for k in range(220)]  # few values: many ties
    rows += [(50, rows[50][1], rows[50][2]), (50, f32(rng.integers(-3, 4, 6) / 256), 1), (7, rows[7][1], rows[7][2])]
    rows += [(None, f32([1.0] * 6), 1), (300, None, 1), (350, f32([1.0] * 6), None), (400, [1.0, None], 1), (401, [float("nan")] * 6, 0), (450, [float("inf")] * 6, 0), (500, [], 1), (501, f32([1.0]), 0), (550, f32([1.0] * 9), 2)]
    assert mined(spark, rows, block_bytes=block_bytes) == plain(rows)


def test_large_numbers_are_exact_or_an_error(spark):
    rng = np.random.default_rng(6)
    rows = [(k, f32(rng.uniform(-1, 1, 4) * 2.0**22), k % 2) for k in range(0, 130, 5)]  # products beyond 2^53
    assert any(abs(p) > 2**53 for *_, p, _ in plain(rows)) and mined(spark, rows) == plain(rows)
    assert mined(spark, [(0, [1e30, 0.0], 0), (1, [0.0, 1.0], 0)]) == []
    with pytest.raises(Exception, match="does not fit 64 bits"):
        mined(spark, [(0, [1e30], 0), (1, [1e30], 0)])


def test_no_anchor_no_positive_no_row(spark):
    assert mined(spark, []) == mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == mined(spark, [(0, [1.0], 0), (2, [1.0], 1)]) == []
    # A product of 0 has the window [0, 0]; a negative one has an empty window.
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 2.0], 1), (50, [-1.0, 0.0], 1)]
    assert mined(spark, rows) == plain(rows) == [(0, 1, 1, 2, 0, 0), (50, 2, 1, 1, 0, 0)]


def test_query_equals_plain_loops(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table if r.label is not None]
    assert sorted(tuple(r) for r in negatives.op11_blocked_negatives(spark, "/root/testdata/sf0.001").collect()) == plain(rows)
