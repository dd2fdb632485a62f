import json

import numpy as np
from pyspark.sql import functions as F

from mnemora.functions import embed
from mnemora.operators import ann, graph, retrieval, settings
from mnemora.streaming import ingest
from mnemora.streaming.store import Memory


def test_ann_recall(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    corpus = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    asked = corpus.where("id % 50 = 0").withColumnRenamed("id", "qid")
    got = {(r.qid, r.id) for r in ann.topk(corpus, asked, 10, 32, 8, exact_below=1).collect()}
    want = {(r.qid, r.id) for r in retrieval.dense_topk(corpus, asked, 10).collect()}
    assert len(got & want) / len(want) >= 0.9
    assert ann.topk(corpus.limit(50), asked, 3).count() == asked.count() * 3


def test_the_index_recalls_the_embeddings_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "qid")
    exact = {(r.qid, r.id) for r in retrieval.dense_topk(rows, asked, 10).collect()}
    found = {(r.qid, r.id) for r in ann.topk(rows, asked, 10, exact_below=1).collect()}  # lists and probes by default
    assert len(exact & found) >= 0.9 * len(exact)


def test_settings():
    base = {"a": 1, "r": {"k": 8, "m": 0.5}}
    assert settings.sparse({"a": 1, "r": {"k": 9, "m": 0.5}}, base) == {"r": {"k": 9}}
    assert settings.full({"r": {"k": 9}, "old": 1}, base) == {"a": 1, "r": {"k": 9, "m": 0.5}}
    assert settings.reconciled({"a": 2, "r": {"k": 4}}, {"r.k": [4, 6], "x.y": [1]}) == {"a": 2}


def test_compact(spark, tmp_path):
    table = ingest.Table(spark, str(tmp_path / "t"), "id long")
    for k in range(2):
        table.write(spark.range(k, 100).repartition(6))
    assert ingest.compact(table, 2) and len(table.read().inputFiles()) == 2 and table.read().count() == 99
    assert table.versions() == [2] and not ingest.compact(table, 2)


def test_watermarked_windows(spark, tmp_path):
    rows = spark.sql("select timestamp'2026-01-01 00:10:00' + make_interval(0,0,0,0,0,m) as ts, 'a' as event_type, 1.0D as value from values (0), (5), (70), (200) as t(m)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").select(F.col("n")).collect()) in ([1, 2], [1, 1, 2])


def test_near_names_miss_none_of_the_like_ones(spark):
    """Every pair of a cosine of 0.9 or more is found, and nothing else."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    said = lambda: [" ".join(rng.choice(words, rng.integers(1, 7))) for _ in range(300)]
    one = [(f"{t}:a{k}", t, n) for k, n in enumerate(said()) for t in ("person", "module")] + [("person:none", "person", None), ("person:blank", "person", " ")]
    other = [(f"person:b{k}", "person", n) for k, n in enumerate(said())] + [("person:c0", "person", one[0][2].upper() + "  "), ("team:c1", "team", one[0][2])]
    make = lambda rows: spark.createDataFrame(rows, "id string, type string, name string")
    got = {(r.id, r.other): r.score for r in graph.near_names(make(one), make(other)).collect()}
    v = lambda n: np.array(embed._hashed(n))
    least = {}
    for i, t, n in other:
        least[(t, n)] = min(i, least.get((t, n), i))
    want = {(a, least[(t, n)]): float(v(m) @ v(n)) for a, s, m in one if s == "person" and m for b, t, n in other if t == s and n and float(v(m) @ v(n)) >= 0.9}
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_memory_merges_near_exact_names_without_a_model(spark, tmp_path):
    memory = Memory(spark, str(tmp_path), buckets=2)
    schema = "source_id string, uri string, title string, kind string, text string, updated_at string, graph_json string"
    for n, name in enumerate(("Ana Ruiz", "ana  ruiz")):
        said = {"entities": [[f"person:{name.lower()}", name, "person"]], "aliases": [], "edges": [[f"person:{name.lower()}", "works_on", f"project:{n}", ""]]}
        memory.ingest(spark.createDataFrame([("wiki:w", f"u{n}", "T", "doc", "text", "1", json.dumps(said))], schema))
    assert {r.id for r in memory.entities.read().where("type = 'person'").collect()} == {"person:ana ruiz"}
    assert {(r.src, r.dst) for r in memory.edges.read().collect()} == {("person:ana ruiz", "project:0"), ("person:ana ruiz", "project:1")}
    assert ("ana  ruiz", "person:ana ruiz") in {(r.alias, r.entity_id) for r in memory.aliases.read().collect()}
