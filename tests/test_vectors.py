"""The stored vector index against exact search."""

from pyspark.sql import functions as F

from mnemora.operators import retrieval, vectors
from mnemora.streaming.log import Log


def pairs(df):
    return {(r.qid, r.id) for r in df.collect()}


def test_recall_on_the_embeddings_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").where("embedding is not null")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    index = vectors.VectorIndex(Log(spark, str(tmp_path)), buckets=4)
    first = rows.where("id % 3 > 0")
    index.update(first.select("id").limit(0), first)
    model = index.log.snapshot()["parts"]["vectors.model"]
    index.update(rows.select("id").limit(0), rows.where("id % 3 = 0"))  # inserts fit nothing again
    assert index.log.snapshot()["parts"]["vectors.model"] == model
    exact = retrieval.dense_topk(rows, asked, 10)
    got = vectors.recall(index.topk(asked, 10), exact).first()
    assert got.queries == asked.count() and got.recall >= 0.9
    n = rows.count()
    assert index.candidates(asked, 100).groupBy("qid").count().agg(F.max("count")).first()[0] <= n / 10  # scored by their vectors
    # All candidates of all lists: exact.
    assert pairs(index.topk(asked.limit(5), 3, probes=10**6, refine=n)) == pairs(retrieval.dense_topk(rows, asked.limit(5), 3))
    gone = rows.where("id % 50 = 0").select("id")
    index.update(gone, rows.where("id = 100").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    top = index.topk(asked, 10, probes=10**6, refine=20)
    assert {r.id % 50 for r in top.where("id <> 100").collect()}.isdisjoint({0}) and (100, 100) not in pairs(top)


def test_an_empty_index_answers_nothing(spark, tmp_path):
    index = vectors.VectorIndex(Log(spark, str(tmp_path)))
    none = spark.createDataFrame([], "id long, embedding array<float>")
    index.update(none, none)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    assert index.topk(asked, 3).count() == 0
    two = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, None)], "id long, embedding array<double>")
    index.update(none, two)
    assert [(r.id, round(r.score, 6)) for r in index.topk(asked, 3, probes=2).orderBy("rank").collect()] == [(7, 1.0), (8, 0.0)]
