"""The stored index against a scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import fulltext, retrieval
from mnemora.streaming import log
from mnemora.streaming.log import Log

ROW = "id long, source_id string, title string, text string"


def made(seed, ids):
    rng = random.Random(seed)
    words = [f"run{'ning' * (k % 2)}{'abcdefgh'[k % 8]}{k % 40}" for k in range(120)]
    weights = [1 / (1 + k) for k in range(120)]
    return [(i, f"s{i % 3}", " ".join(rng.choices(words, weights, k=rng.randrange(3))), " ".join(rng.choices(words, weights, k=rng.randrange(60)))) for i in ids]


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    words = sorted({w for r in made(1, range(300)) for w in r[3].split()})
    return spark.createDataFrame([(q, rng.sample(words, 4) + ["nowhere"]) for q in range(25)], "qid long, terms array<string>")


def same(index, spark, rows, queries, stemming, sources=None):
    docs = spark.createDataFrame([r for r in rows if sources is None or r[1] in sources], ROW)
    want = retrieval.bm25_topk(docs, queries, 8, stemming=stemming)
    shown = lambda df: sorted((r.qid, r.id, round(r.score, 6), r.rank) for r in df.collect())
    assert shown(index.topk(queries, 8, sources)) == shown(want)


@pytest.mark.parametrize("stemming", [False, True])
def test_updates_merges_and_scopes_equal_a_scan(spark, tmp_path, queries, monkeypatch, stemming):
    monkeypatch.setattr(fulltext, "RANGE", 16)
    monkeypatch.setattr(fulltext, "MOST_PARTS", 1)
    index = fulltext.Index(Log(spark, str(tmp_path)), buckets=4, stemming=stemming)
    assert index.topk(queries, 8).count() == 0
    now = {r[0]: r for r in made(1, range(600))}
    index.update(spark.createDataFrame([], ROW), spark.createDataFrame(list(now.values()), ROW))
    same(index, spark, now.values(), queries, stemming)
    assert index.merge(force=True) == "all"
    for turn in (2, 3):
        gone = [now.pop(i) for i in range(turn, 600, 37) if i in now]
        new = made(turn, [g[0] for g in gone[::2]] + [1000 * turn])
        index.update(spark.createDataFrame(gone, ROW), spark.createDataFrame(new, ROW))
        now |= {r[0]: r for r in new}
    same(index, spark, now.values(), queries, stemming, ("s0", "s2"))
    assert index.merge() == "tail"
    same(index, spark, now.values(), queries, stemming)
    assert index.merge(force=True) == "all" and not index.log.snapshot()["parts"].get("index.gone")
    same(index, spark, now.values(), queries, stemming)


def test_ranges_under_the_bound_are_not_scored(spark, tmp_path, monkeypatch):
    """Few documents say a word often and shortly; ranges without them cannot reach the k-th score."""
    monkeypatch.setattr(fulltext, "RANGE", 8)
    rows = [(i, "s", "", "apple " * (9 if i % 200 == 0 else 1) + "filler " * (1 if i % 200 == 0 else 50)) for i in range(2000)]
    index = fulltext.Index(Log(spark, str(tmp_path)), buckets=2, stemming=False)
    index.update(spark.createDataFrame([], ROW), spark.createDataFrame(rows, ROW))
    asked = spark.createDataFrame([(1, ["apple"])], "qid long, terms array<string>")
    exploded = []
    real = fulltext.Index._exploded
    monkeypatch.setattr(fulltext.Index, "_exploded", lambda self, blocks: exploded.append(blocks.agg(F.sum(F.size("ids"))).first()[0]) or real(self, blocks))
    found = index.topk(asked, 5).collect()
    assert sorted(r.id % 200 for r in found) == [0] * 5 and exploded[-1] < 400  # of 2,000 postings
    plan = index.topk(asked, 5)._jdf.queryExecution().toString()
    assert "text" not in plan.lower().replace("plaintext", "").replace("context", "") and log.MOST_PARTS > 0
