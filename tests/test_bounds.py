"""What a task holds, and what is moved, stays bounded while results stay whole."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.functions import chunk, classify, embed
from mnemora.operators import ann, catalog, fulltext, graph, retrieval
from mnemora.plans import model
from mnemora.sources import pages
from mnemora.streaming.log import Log
from mnemora.streaming.store import Memory, assembled


def _logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_search_makes_no_row_for_a_query_and_a_document(spark):
    words = "red green blue grey pink teal gold".split()
    rows = [(n, " ".join(words[(n * j) % 7] for j in range(1, 3 + n % 9)), words[n % 3]) for n in range(300)]
    rows += [(5, "red red gold", None), (900, None, "teal"), (901, "", None)]  # an id twice, no text, nothing
    docs = spark.createDataFrame(rows, "id long, text string, title string").repartition(5)
    asked = spark.createDataFrame([(q, [words[q % 7], words[(q * 3 + 1) % 7], "none"]) for q in range(40)] + [(77, None), (78, ["never"])], "qid long, terms array<string>")
    full = retrieval.bm25(docs, asked).withColumn("score", F.round("score", 9))
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    expected = {(r.qid, r["rank"]): (r.id, r.score) for r in full.withColumn("rank", first).where("rank <= 6").collect()}
    for options in ({}, {"block": 7}, {"broadcast_terms": 0}):
        found = retrieval.bm25_topk(docs, asked, 6, **options)
        assert "Aggregate [qid" not in _logical(found)
        assert {(r.qid, r["rank"]): (r.id, r.score) for r in found.collect()} == expected


def _edges(spark):
    rows = [(f"s{n % 9}", ("provides", "part_of")[n % 2], f"p{n % 17}", f"d{n}") for n in range(60)] + [("s1", "part_of", "p3", "")]
    docs = spark.createDataFrame([(f"d{n}", f"src{n % 3}", f"t{n % 5}", "doc", "u") for n in range(60)], "doc_id string, source_id string, title string, kind string, uri string")
    return spark.createDataFrame(rows, "src string, rel string, dst string, evidence_doc_id string"), docs


def test_edges_are_read_once_for_both_ends(spark):
    edges, docs = _edges(spark)
    read = lambda df: _logical(df).count("LogicalRDD [src")
    both = graph.totals(edges, None, docs, ("src1",))
    seen = [r for r in edges.collect() if not r.evidence_doc_id or int(r.evidence_doc_id[1:]) % 3 == 1]
    assert read(both) == 2  # with evidence, and without
    assert tuple(both.first()) == (len(seen), len({r.src for r in seen} | {r.dst for r in seen}))
    assert tuple(graph.totals(edges.limit(0), None, docs, ("src1",)).first()) == (0, 0)
    touched = catalog.entities_touched(edges, docs.where("source_id = 'src2'"))
    assert read(touched) == 1 and {r.id for r in touched.collect()} == {x for r in edges.where("evidence_doc_id like 'd%' and cast(substr(evidence_doc_id, 2) as int) % 3 = 2").collect() for x in (r.src, r.dst)}


def test_titles_meet_edges_before_these_are_taken_apart(spark):
    edges, docs = _edges(spark)
    ids = spark.createDataFrame([("s1",), ("p3",), ("gone",)], "id string")
    found = graph.evidence_titles(edges, docs, ids, 2, ("src0", "src1"))
    assert _logical(found).count("Aggregate [") == 2
    own = {i: sorted({f"t{int(r.evidence_doc_id[1:]) % 5}" for r in edges.collect() if i in (r.src, r.dst) and r.evidence_doc_id and int(r.evidence_doc_id[1:]) % 3 < 2})[:2] for i in ("s1", "p3")}
    assert sorted((r.id, r.title) for r in found.collect()) == sorted((i, t) for i, ts in own.items() for t in ts)


def test_signatures_need_no_documents(spark):
    edges, _ = _edges(spark)
    entities = spark.createDataFrame([(f"s{n}", "nation") for n in range(9)] + [(f"p{n}", "region" if n % 2 else "part") for n in range(17)], "id string, type string")
    as_type = lambda c: F.when(F.col(c).isin("nation", "region"), "project").otherwise(F.col(c))
    found = graph.signed(edges, entities, as_type)
    docs = spark.createDataFrame([], "doc_id string, title string, uri string, kind string, source_id string")
    named = graph.edge_view(edges, entities.withColumn("name", F.col("id")), docs)
    expected = named.where(classify.signature_allows(as_type("src_type"), F.col("rel"), as_type("dst_type"))).select("src", "rel", "dst", "src_type", "dst_type")
    assert expected.count() and sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_path_searches_store_an_edge_once(spark, monkeypatch):
    edges, docs = _edges(spark)
    stored, n = [], edges.select("src", "rel", "dst").distinct().count()
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (stored.append(df.count()), real(df))[1])
    found = graph.paths(edges, "s1", "p3", 1).collect()
    assert [(r.nodes, r.rels) for r in found] == [(["s1", "p3"], [rel]) for rel in sorted({r.rel for r in edges.where("src = 's1' and dst = 'p3'").collect()})]
    assert max(stored) <= n


def test_equal_lines_go_before_names_are_made(spark):
    assert "Aggregate [src" not in _logical(model.edges(spark, "/root/testdata/sf0.001"))


def test_postings_are_counted_where_their_texts_are(spark, tmp_path):
    """One exchange, of texts; equal to a plain count."""
    rows = spark.createDataFrame([(n, f"s{n % 2}", "a title", "a b a c" if n % 3 else "b b") for n in range(20)], "id long, source_id string, title string, text string")
    post = fulltext.Index(Log(spark, str(tmp_path)), stemming=False).postings(rows)
    plan = post._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "term" not in plan[plan.index("Exchange hashpartitioning") :].split("\n")[0]
    got = {(r.id, r.term): (r.tf, r.dl) for r in post.collect()}
    assert got[(1, "a")] == (4.0, 6) and got[(3, "b")] == (2.0, 4) and got[(3, "")] == (0.0, 4) and len(got) == 13 * 5 + 7 * 4
    parts = rows.select(F.col("id").cast("string").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), "source_id", "text")
    posted = Memory._posted(None, parts)
    assert posted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.doc_id, r.term, r.tf, r.dl) for r in posted.where("doc_id in ('1', '3')").collect()} == {("1", "a", 2, 4), ("1", "b", 1, 4), ("1", "c", 1, 4), ("3", "b", 2, 2)}


def test_a_page_is_read_once_and_few_at_a_time(spark, monkeypatch):
    rows = [(n, f"http://h/{n}", f"<title>t{n}</title><p>{'word ' * 40}</p><a href='/x{n % 3}'>x</a>" if n % 4 else "<p>short</p>") for n in range(40)] + [(40, "http://h/40", None), (41, None, "word " * 30)]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for most in (100, 4_000_000):
        monkeypatch.setattr(pages, "READ_AT_ONCE", most)
        found = pages.documents(given)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
        plain = {r.page_id: r for r in given.select("page_id", pages.parsed("url", "html").alias("p")).collect()}
        assert sorted((r.page_id, r.title, r.text) for r in found.collect()) == sorted((i, r.p.title, r.p.text) for i, r in plain.items() if len(r.p.text) >= pages.MIN_TEXT)
        assert sorted(map(tuple, pages.links(given).collect())) == sorted((i, x) for i, r in plain.items() for x in r.p.links)


def test_heads_hold_what_they_keep(monkeypatch):
    """Equal to a sort of everything, with ties, in memory of the kept rows."""
    r = np.random.default_rng(3)
    scores, ids = r.integers(0, 40, (7, 9000)).astype(float), r.permutation(9000)
    scores[0, 5], scores[1] = np.inf, -np.inf
    heads, held = retrieval.Heads(7, 3), []
    for at in range(0, 9000, 50):
        heads.add(scores[:, at : at + 50], ids[at : at + 50])
        held.append(sum(len(x[0]) for x in heads.waiting))
    assert max(held) < heads.most + 7 * 50
    batch = heads.batch(np.arange(7))
    assert len(heads.waiting) == 0
    expected = [(q, ids[n], scores[q, n]) for q in range(7) if q != 1 for n in np.lexsort((ids, -scores[q]))[:3]]
    assert [(q, i, np.inf if np.isnan(s) else s) for q, i, s in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True)] == expected


def test_dense_search_holds_a_small_part_of_queries_times_rows(spark, monkeypatch):
    import tracemalloc

    r = np.random.default_rng(5)
    vectors = r.normal(size=(3000, 8)).round(1)
    vectors[7] = 0
    corpus = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)] + [(9000, None), (9001, [float("nan")] * 8)], "id long, embedding array<double>").coalesce(1)
    asked = corpus.where("id % 5 = 0").selectExpr("id as qid", "embedding")
    task = []
    real = type(corpus).mapInArrow
    monkeypatch.setattr(type(corpus), "mapInArrow", lambda self, f, schema: (task.append(f), real(self, f, schema))[1])
    found = {(x.qid, x["rank"]): (x.id, x.score) for x in retrieval.dense_topk(corpus, asked, 4).collect()}
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for q in (0, 5, 1500, 2995):
        score = unit @ unit[q]
        assert found[q, 1][0] == 9001 and np.isnan(found[q, 1][1])  # as in SQL
        best = np.lexsort((np.arange(3000), -score))[:3]
        assert np.allclose([found[q, n][1] for n in (2, 3, 4)], score[best])
    batch = corpus.where("embedding is not null").toArrow().to_batches()
    monkeypatch.setattr(retrieval, "CELLS", retrieval.CELLS // 10)
    tracemalloc.start()
    got = list(task[0](iter(batch)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 600 * 4 and peak < 10_000_000  # 600 queries by 3,001 rows are 14 MB


def test_lists_are_searched_without_a_row_for_a_candidate(spark):
    """Equal to a join of rows and queries on the list."""
    r = np.random.default_rng(9)
    corpus = spark.createDataFrame([(n, r.normal(size=6).tolist()) for n in range(500)] + [(900, None), (901, [0.0] * 6)], "id long, embedding array<double>").repartition(3)
    asked = corpus.where("id % 9 = 0").selectExpr("id as qid", "embedding")
    centroids = ann.fit(corpus, 8)
    index = ann.assigned(corpus, centroids, 1, "id")
    pairs = index.join(ann.assigned(asked, centroids, 3, "qid").withColumnRenamed("embedding", "q"), "list")
    unit = {x.id: ann._unit(np.array([x.embedding]))[0] for x in corpus.where("embedding is not null").collect()}
    of = {}
    for x in pairs.select("qid", "id").collect():
        of.setdefault(x.qid, []).append((-round(float(unit[x.qid] @ unit[x.id]), 9), x.id))
    for block in (4096, 10):
        found = ann.scored(index, asked, centroids, 5, 3, block)
        assert "Join" not in _logical(found)
        got = {}
        for x in found.orderBy("rank").collect():
            got.setdefault(x.qid, []).append((-round(x.score, 9), x.id))
        assert len(got) == 56 and got == {q: sorted(c)[:5] for q, c in of.items()}
    assert ann.topk(corpus, asked, 5, 8, 3, exact_below=1).count() == 56 * 5


def test_sources_of_an_edge_are_counted_in_one_step(spark, monkeypatch):
    edges, docs = _edges(spark)
    edges = edges.union(edges.limit(9)).union(spark.createDataFrame([("s1", "provides", "p3", "missing"), ("s2", "provides", "p3", "none")], edges.schema))
    docs = docs.union(spark.createDataFrame([("none", None, "t", "doc", "u"), ("d4", "zzz", "t", "doc", "u")], docs.schema))  # a document of two rows
    for visible in (None, ("src1",), ("src0", "zzz")):
        monkeypatch.setattr(graph, "SOURCES", 60)
        found = graph.corroboration(edges, docs, visible)
        assert _logical(found).count("Aggregate [src") == 1
        monkeypatch.setattr(graph, "SOURCES", 0)
        plain = graph.corroboration(edges, docs, visible)
        assert found.schema.simpleString() == plain.schema.simpleString()
        assert found.count() and sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_equal_titles_of_several_documents_count_once(spark):
    edges = spark.createDataFrame([("a", "r", "b", f"d{n}") for n in range(12)] * 2, "src string, rel string, dst string, evidence_doc_id string")
    docs = spark.createDataFrame([(f"d{n}", f"t{n // 4}", "doc", "s") for n in range(12)], "doc_id string, title string, kind string, source_id string")
    found = graph.evidence_titles(edges, docs, spark.createDataFrame([("a",), ("a",)], "id string"), 2)
    assert "DENSE_RANK" in found._jdf.queryExecution().optimizedPlan().toString().upper()
    assert sorted(map(tuple, found.collect())) == [("a", "t0", "doc"), ("a", "t1", "doc")]


def test_a_page_keeps_the_whole_text_of_its_tables(monkeypatch):
    long = " ".join(f"w{n}" for n in range(400))
    rows = "".join(f"<tr><td>r{n}</td><td>{long if n == 640 else 'x|y'}</td></tr>" for n in range(700))
    said, _, _ = pages.read_page(f"<table><caption>Of all\nhosts</caption><tr><th>A</th><th>B</th></tr>{rows}</table>")
    assert f"| r640 | {long} |" in said and "| r699 | x\\|y |" in said
    assert said.split("\n")[0] == "Of all hosts" and len(said.split("\n")) == 703
    ragged = [[["td", 1, [f"c{k}"]] for k in range(n)] for n in (1, 3, 2)]
    assert pages.pipe_table(ragged) == "| c0 |  |  |\n| --- | --- | --- |\n| c0 | c1 | c2 |\n| c0 | c1 |  |"
    monkeypatch.setattr(pages, "FILL", 2)  # wide and long tables are not filled up, but for their heads
    assert pages.pipe_table(ragged) == "| c0 |  |  |\n| --- | --- | --- |\n| c0 | c1 | c2 |\n| c0 | c1 |"


def test_an_ingest_reads_a_text_once(spark):
    """Code is split into lines once a text, not once a block, and not sent to the prose chunker; what a text asserts is read once for entities, aliases and edges."""
    said = "\n".join(f"line{n}" for n in range(200))
    docs = spark.createDataFrame([("a", "git:r", "x.py", "T", "code", f"import os\n{said}", ""), ("b", "wiki:w", "u", "T", None, "OPS-1\n| Team | Service |\n| --- | --- |\n| Blue | Shop |", "")], "doc_id string, source_id string, uri string, title string, kind string, text string, graph_json string")
    made = docs.select("doc_id", F.posexplode(chunk.chunks(F.col("text"), F.col("kind"))).alias("k", "body"))
    plan = _logical(made)
    assert plan.count("split(") == 1 and "prose_chunks(CASE WHEN" in plan
    got = {(r.doc_id, r.k): r.body for r in made.collect()}
    lines = f"import os\n{said}".split("\n")
    assert [got[("a", k)] for k in range(4)] == ["\n".join(lines[52 * k : 52 * k + 60]) for k in range(4)] and ("b", 0) in got and len(got) == 5
    entities, aliases, edges = assembled(docs)
    assert all("typed_rows" not in _logical(x) and "regexp_extract_all" not in _logical(x) for x in (entities, aliases, edges))
    assert {(r.doc_id, r.src, r.rel, r.dst) for r in edges.collect()} == {("a", "repo:r", "imports", "module:os"), ("b", "source:w", "references", "ticket:ops-1"), ("b", "team:blue", "owns", "service:shop")}


def test_an_index_update_stores_no_row_for_a_posting(spark, tmp_path, monkeypatch):
    stored, real = [], fulltext.cut
    monkeypatch.setattr(fulltext, "cut", lambda df: (stored.append(df.count()), real(df))[1])
    monkeypatch.setattr(fulltext, "RANGE", 16)
    rows = spark.createDataFrame([(n, f"s{n % 3}" if n % 5 else None, "a title", " ".join(f"w{(n * k) % 11}" for k in range(30))) for n in range(200)], "id long, source_id string, title string, text string")
    index = fulltext.Index(Log(spark, str(tmp_path)), buckets=2, stemming=False)
    index.update(rows.limit(0), rows)
    index.update(rows.where("id < 20"), rows.where("id < 10"))
    assert max(stored, default=0) <= 4 * (11 + 2 + 1)  # a row for a source and a term, not for a posting
    plain = index.postings(rows.where("id >= 20 or id < 10"))
    sizes = {r.source_id: (r.n, r.dl) for r in index._read("sizes", fulltext.SIZES).groupBy("source_id").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).collect()}
    assert sizes == {r.source_id: (r.n, r.dl) for r in plain.where("term = ''").groupBy("source_id").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()}
    blocks = index._read("blocks", fulltext.BLOCKS)
    held = index._alive(index._exploded(blocks.select("term", "source_id", "seq", "ids", "tfs", "dls")))
    want = {(r.term, r.source_id, r.id): (r.tf, r.dl) for r in plain.where("term <> ''").collect()}
    assert {(r.term, r.source_id, r.id): (r.tf, r.dl) for r in held.collect()} == want and held.count() == len(want)
    heads = blocks.select("n", "max_tf", "min_dl", F.size("ids").alias("m"), F.array_max("tfs").alias("t"), F.array_min("dls").alias("d"))
    assert heads.where("n <> m or max_tf <> t or min_dl <> d").isEmpty()


def test_hashed_vectors_are_counts_of_md5_places():
    import hashlib

    said = "a b a " + "x" * 80 + " É b\u2003c a"
    v = np.zeros(embed.WIDTH)
    for word in said.lower().split():
        v[int(hashlib.md5(word.encode()).hexdigest(), 16) % embed.WIDTH] += 1
    embed._known_place.cache_clear()
    assert embed._hashed(said) == (v / np.linalg.norm(v)).tolist() and embed._hashed(None) == embed._hashed(" ") == [0.0] * embed.WIDTH
    assert embed._known_place.cache_info().hits >= 3 and embed._known_place.cache_info().currsize == 4  # a word is hashed once


def test_many_queries_of_the_index_make_no_row_for_a_query_and_a_posting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "RANGE", 16)
    words = "red green blue grey pink teal gold".split()
    row = lambda n, s: (n, f"s{n % 3}", words[(n + s) % 7] if n % 4 else None, " ".join(words[(n * j + s) % 7] for j in range(n % 9)))
    frame = lambda rows: spark.createDataFrame(rows, "id long, source_id string, title string, text string")
    first, again = [row(n, 0) for n in range(300)], [row(n, 1) for n in range(0, 300, 3) if n % 2]
    index = fulltext.Index(Log(spark, str(tmp_path)), buckets=2, stemming=False)
    index.update(frame(first).limit(0), frame(first))
    index.update(frame([r for r in first if r[0] % 3 == 0]), frame(again))
    now = frame([r for r in first if r[0] % 3] + again)
    asked = spark.createDataFrame([(q, [words[q % 7], words[(q * 3 + 1) % 7], "none"]) for q in range(90)], "qid long, terms array<string>")
    shown = lambda df: sorted((r.qid, r.id, round(r.score, 6), r["rank"]) for r in df.collect())
    expected, some = shown(retrieval.bm25_topk(now, asked, 6)), shown(retrieval.bm25_topk(now.where("source_id <> 's1'"), asked, 6))
    found = index.topk(asked, 6)
    assert "Aggregate [qid" not in _logical(found) and "Generate explode" not in _logical(found)
    assert shown(found) == expected and shown(index.topk(asked, 6, ("s0", "s2"))) == some
    for name, module, value in (("GONE_AT_ONCE", fulltext, 0), ("QUERY_BLOCK", retrieval, 7), ("CELLS", retrieval, 500)):
        monkeypatch.setattr(module, name, value)
        assert shown(index.topk(asked, 6)) == expected
