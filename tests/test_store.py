"""The memory's tables, runs, seams and pushed sources."""

import gzip
import hashlib
import hmac
import io
import json
import pathlib
import random
import threading
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from mnemora.engine import BACKLOG, Engine
from mnemora.functions import embed, stem
from mnemora.operators import evals, graph, lineage, retrieval
from mnemora.sources import export, files, pdf, push
from mnemora.sources.registry import TransientError, instance
from mnemora.streaming import log, runs
from mnemora.streaming.log import Conflict, Log, Table
from mnemora.streaming.store import Memory

DOC = "source_id string, uri string, title string, kind string, text string, updated_at string, graph_json string"


def docs_of(spark, *rows):
    return spark.createDataFrame([(*r, *([None] * (7 - len(r)))) for r in rows], DOC)


def parts_of(table):
    return table.log.snapshot()["parts"].get(table.name)


@pytest.fixture
def numbers(spark, tmp_path):
    return Table(Log(spark, str(tmp_path / "t")), "numbers", "doc_id string, n int", buckets=8)


def stored_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_commit_writes_what_changed(spark, numbers, tmp_path):
    rows = spark.range(40_000).selectExpr("concat('d', id) as doc_id", "cast(id as int) as n")
    numbers.replace(rows, rows)
    before = stored_bytes(tmp_path)
    some = rows.where("n % 100 = 7").withColumn("n", F.lit(-1))
    numbers.replace(some, some)
    assert stored_bytes(tmp_path) - before < before / 20
    assert numbers.read().count() == 40_000 and numbers.read().where("n = -1").count() == 400
    numbers.replace(some.where("n > 0"), some.limit(0))  # nothing: no commit
    assert len(numbers.log.commits()) == 2
    numbers.replace(rows.where("n < 100"), rows.limit(0))
    assert numbers.compact(force=True) == "all" and numbers.read().count() == 39_900
    assert 0 < numbers.read(numbers.touched(some.limit(1))).count() < 10_000  # of buckets only what is asked for


def test_compaction_changes_no_row_and_old_snapshots_stay(spark, numbers, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(log, "MOST_PARTS", 3)
    now, done = {}, []
    for turn in range(14):
        keys = range(2000) if turn == 0 else rng.sample(range(2100), 40)
        gone, new = [f"d{k}" for k in keys if f"d{k}" in now], [(f"d{k}", turn) for k in keys if turn == 0 or k % 3]
        for k in gone:
            del now[k]
        now |= dict(new)
        numbers.replace(spark.createDataFrame([(k,) for k in gone], "doc_id string"), spark.createDataFrame(new, "doc_id string, n int"))
        with numbers.log.transaction():
            done.append(numbers.compact())
        assert {r.doc_id: r.n for r in numbers.read().collect()} == now
    assert {"all", "tail"} <= set(done)
    assert numbers.log.vacuum() == 0  # nothing is old enough
    assert numbers.log.vacuum(keep=1, hours=0) > 0 and len(numbers.log.commits()) == 1
    assert {r.doc_id: r.n for r in numbers.read().collect()} == now


def test_of_two_writers_the_second_begins_again(spark, numbers):
    one = spark.createDataFrame([("a", 1)], "doc_id string, n int")
    with pytest.raises(Conflict), numbers.log.transaction():
        numbers.replace(one.limit(0), one)
        other = Table(Log(spark, numbers.log.path), "numbers", numbers.schema, buckets=8)
        other.replace(one.limit(0), one.withColumn("n", F.lit(2)))
    assert [r.n for r in numbers.read().collect()] == [2]
    errors = []

    def add(k):
        try:
            mine = Table(Log(spark, numbers.log.path), "numbers", numbers.schema, buckets=8)
            mine.log.retried(lambda: mine.replace(one.limit(0), spark.createDataFrame([(f"w{k}", k)], "doc_id string, n int")), times=20)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors and {r.doc_id for r in numbers.read().collect()} == {"a", "w0", "w1", "w2", "w3"}


def test_a_replayed_batch_changes_nothing_and_readers_see_one_snapshot(spark, memory):
    first = docs_of(spark, ("wiki:w", "u1", "T", "doc", "OPS-1", "1"))
    assert memory.ingest(first, ("s", 0)).count() == 1
    again = docs_of(spark, ("wiki:w", "u1", "T", "doc", "OPS-2", "2"))
    assert memory.ingest(again, ("s", 0)).count() == 0 and edges_of(memory) == {("source:w", "references", "ticket:ops-1")}
    commits = len(memory.log.commits())
    assert memory.ingest(again, ("s", 1)).count() == 1 and len(memory.log.commits()) == commits + 1  # all tables at once
    assert edges_of(memory) == {("source:w", "references", "ticket:ops-2")}
    folders = [p for p in pathlib.Path(lineage.shared_root(spark)).glob("mnemora-*") if p.is_dir()]
    memory.ingest(docs_of(spark, ("wiki:w", "u2", "T", "doc", "x", "1")))
    assert len([p for p in pathlib.Path(lineage.shared_root(spark)).glob("mnemora-*") if p.is_dir()]) <= len(folders) + 1  # the returned actions


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "m"), buckets=4)


def edges_of(memory):
    return {(r.src, r.rel, r.dst) for r in memory.edges.read().collect()}


def test_bridges_follow_ingests_and_deletes(spark, memory):
    said = lambda *rows: json.dumps({"entities": rows, "aliases": [], "edges": [[r[0], "part_of", "project:x", ""] for r in rows]})
    bridges = lambda: {(s, d) for s, r, d in edges_of(memory) if r == "same_as"}
    memory.private_sources, told = ("notes:ana",), []
    memory.progress = lambda stage, counts: told.append((stage, counts))
    memory.ingest(docs_of(spark, ("wiki:w", "u1", "T", "doc", "one", "1", said(["service:conn", "Acme Connector", "service"]))))
    assert bridges() == set()
    counts = dict(told)
    assert list(counts) == ["documents", "actions", "chunks", "entities", "aliases", "edges"]
    assert counts["documents"] == {"rows": 1} and counts["actions"] == {"rows": 1, "skipped": 0} and counts["chunks"] == {"rows": 1, "characters": 3} and counts["aliases"] == {"rows": 0}
    memory.ingest(docs_of(spark, ("git:g", "u2", "T", "doc", "two", "1", said(["repo:conn", "acme-connector", "repo"])), ("notes:ana", "u3", "T", "doc", "own", "1", said(["pipeline:conn", "acme.connector", "pipeline"]))))
    assert bridges() == {("repo:conn", "service:conn")}
    memory.delete(memory.documents.read().where("uri = 'u1'"))
    assert bridges() == set() and memory.entities.read().where("id = 'service:conn'").count() == 0


def test_ingest_replaces_what_changed(spark, memory):
    payload = json.dumps({"entities": [["service:pay", "Pay", "service"]], "aliases": [["payments", "service:pay"]], "edges": [["service:pay", "part_of", "project:x", "said"]]})
    first = docs_of(spark, ("git:shop", "a.py", "A", "code", "import os\ndef run():\n    pass\n", "1"), ("git:shop", "b.md", "B", "doc", "see PAY-7", "1", payload), ("git:shop", "b.md", "B", "doc", "older", "0"))
    assert sorted(r.action for r in memory.ingest(first).collect()) == ["added", "added"]
    assert edges_of(memory) == {("repo:shop", "imports", "module:os"), ("repo:shop", "defines", "symbol:run"), ("repo:shop", "references", "ticket:pay-7"), ("service:pay", "part_of", "project:x")}
    assert {r.term: r.tf for r in memory.postings.read().collect()}["pay"] == 1 and memory.chunks.read().count() == 2
    assert {(r.alias, r.entity_id) for r in memory.aliases.read().collect()} == {("payments", "service:pay")}
    manifest = parts_of(memory.chunks)
    assert {r.action for r in memory.ingest(first).collect()} == {"skipped"} and parts_of(memory.chunks) == manifest
    again = memory.ingest(docs_of(spark, ("git:shop", "a.py", "A", "code", "def other():\n    pass\n", "2")))
    assert [r.action for r in again.collect()] == ["updated"]
    assert edges_of(memory) == {("repo:shop", "defines", "symbol:other"), ("repo:shop", "references", "ticket:pay-7"), ("service:pay", "part_of", "project:x")}
    assert "run" not in {r.term for r in memory.postings.read().collect()}
    memory.delete(memory.documents.read().where("uri = 'a.py'"))
    assert edges_of(memory) == {("repo:shop", "references", "ticket:pay-7"), ("service:pay", "part_of", "project:x")}
    assert "symbol:other" not in {r.id for r in memory.entities.read().collect()} and memory.documents.read().count() == 1
    assert memory.ingest(first.limit(0)).count() == 0


def test_a_stream_fills_the_memory_and_search_reads_its_index(spark, memory, tmp_path):
    def deliver(n, *rows):
        docs_of(spark, *rows).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(DOC).json(str(tmp_path / "in"))
        memory.stream(stream, str(tmp_path / "state"), "wiki").awaitTermination()
        assert memory.log.snapshot()["batches"] == {"wiki": n}

    deliver(0, ("wiki:w", "u1", "Deploying", "doc", "the portal runs on blue hosts", "1"), ("wiki:w", "u2", "Other", "doc", "nothing of interest", "1"))
    deliver(1, ("wiki:w", "u1", "Deploying", "doc", "the portal runs on green hosts", "2"), ("git:g", "u3", "G", "doc", "green hosted portals", "1"))
    assert memory.documents.read().count() == 3
    asked = spark.createDataFrame([(1, "blue"), (2, "greens host"), (3, "deployed")], "qid long, query string").withColumn("terms", F.split("query", " "))
    found = lambda sources=None: {(r.qid, r.uri) for r in memory.index.topk(asked, 5, sources).join(memory.chunks.read().select(F.xxhash64("doc_id", "chunk_index").alias("id"), "uri"), "id").collect()}
    assert found() == {(2, "u1"), (2, "u3"), (3, "u1")} and found(("git:g",)) == {(2, "u3")}
    memory.delete(memory.documents.read().where("uri = 'u1'"))
    assert found() == {(2, "u3")} and memory.backfill_index() == 0
    assert "all" in memory.maintain(force=True).values() and found() == {(2, "u3")}
    engine = Engine(memory, min_score=-1.0, rerank=2, reranker=lambda: lambda q, texts: [len(t) for t in texts])
    assert engine.search(asked.drop("terms").where("qid = 2")).count() == 2
    sparse = memory.index.topk(asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in sparse and "crumb" not in sparse  # no scan of the chunks


def test_contexts_and_stored_texts(spark, tmp_path):
    memory = Memory(spark, str(tmp_path), buckets=2, contextual=True)
    memory.ingest(docs_of(spark, ("wiki:w", "u1", "Title", "doc", "First words.\n\nMore.", "1")))
    chunk = memory.chunks.read().first()
    assert chunk.text == "[wiki:w · Title · u1]\nFirst words.\n\nMore." and len(chunk.embedding) == embed.WIDTH
    assert memory.stored_texts(memory.documents.read()).first().text == "First words.\n\nMore."
    memory.postings.replace(memory.postings.read(), memory.postings.read().limit(0))
    assert memory.backfill_postings() == 1 and memory.backfill_postings() == 0 and memory.postings.read().count() > 0


def long_text(said):
    return said + " and so on" * 60


def test_deferred_work_is_drained(spark, tmp_path):
    lines = lambda: lambda text, title: ["service: shop | depends_on | service: pay", "nonsense"] if "PAY-7" in text else 1 / 0
    memory = Memory(spark, str(tmp_path), buckets=2, extractor=lines)
    payload = json.dumps({"entities": [], "aliases": [], "edges": [["a:1", "part_of", "b:2", "x"]]})
    memory.ingest(docs_of(spark, ("wiki:w", "u1", "T", "doc", long_text("PAY-7"), "1", payload), ("wiki:w", "u2", "T", "doc", "short OPS-1", "1"), ("wiki:w", "u3", "T", "doc", long_text("no model for this"), "1"), ("git:w", "package.json", "T", "doc", long_text("{}"), "1")))
    assert edges_of(memory) == {("source:w", "references", "ticket:ops-1")} and memory.pending.read().count() == 2
    gone = spark.createDataFrame([("gone", "wiki:w", "")], "doc_id string, source_id string, graph_json string")
    memory.pending.replace(gone, gone)
    counts = memory.drain().first()
    assert (counts.documents, counts.missing_text, counts.orphans) == (2, 0, 1) and memory.pending.read().count() == 0
    assert edges_of(memory) == {("source:w", "references", "ticket:ops-1"), ("source:w", "references", "ticket:pay-7"), ("a:1", "part_of", "b:2"), ("service:shop", "depends_on", "service:pay")}


def test_rebuild_keeps_what_it_cannot_know(spark, memory):
    payload = json.dumps({"entities": [], "aliases": [], "edges": [["a:1", "part_of", "b:2", "x"]]})
    memory.ingest(docs_of(spark, ("wiki:w", "u1", "T", "doc", "OPS-1", "1", payload), ("wiki:w", "u2", "T", "doc", "OPS-2", "1"), ("wiki:w", "u3", "T", "doc", "OPS-3", "1")))
    extra = memory.edges.read().where("dst = 'ticket:ops-2'").withColumn("dst", F.lit("ticket:claimed"))
    wrong = memory.edges.read().where("dst = 'ticket:ops-1'").withColumn("dst", F.lit("ticket:wrong"))
    memory.edges.replace(extra.union(wrong).select("doc_id"), memory.edges.read().join(extra.union(wrong).select("doc_id"), "doc_id", "left_semi").unionByName(extra).unionByName(wrong))
    lost = memory.documents.read().where("uri = 'u3'").select("doc_id")
    memory.chunks.replace(lost, memory.chunks.read().limit(0))
    counts = memory.rebuild().first()
    assert (counts.documents, counts.faithful, counts.preserved, counts.missing_text) == (2, 1, 1, 1)
    assert edges_of(memory) == {("source:w", "references", f"ticket:{x}") for x in ("ops-1", "ops-2", "ops-3", "claimed")} | {("a:1", "part_of", "b:2")}


def test_a_stale_graph_is_refreshed_without_new_chunks(spark, memory):
    memory.ingest(docs_of(spark, ("wiki:w", "u1", "T", "doc", "OPS-1", "1")))
    old = memory.documents.read().withColumn("graph_version", F.lit(1))
    memory.documents.replace(old, old)
    manifest = parts_of(memory.chunks)
    payload = json.dumps({"edges": [["a:1", "part_of", "b:2", "x"]]})
    acted = memory.ingest(docs_of(spark, ("wiki:w", "u1", "T", "doc", "OPS-1", "1", payload)))
    assert [r.action for r in acted.collect()] == ["graph_refreshed"] and parts_of(memory.chunks) == manifest
    assert ("a:1", "part_of", "b:2") in edges_of(memory) and memory.documents.read().first().graph_json == payload


def test_watermarks_are_committed_after_success(spark, memory):
    seen = []

    def pull(state):
        seen.append(dict(state))
        state["cursor"] = f"c{len(seen)}"
        if len(seen) == 2:
            raise OSError("down")
        return docs_of(spark, ("wiki:w", "u", "T", "doc", f"text {len(seen)}", "1"))

    memory.sync("wiki:w", pull)
    first = memory.watermark("wiki:w")
    assert first and memory.watermark("wiki:w", "cursor") == "c1"
    with pytest.raises(OSError):
        memory.sync("wiki:w", pull)
    assert memory.watermark("wiki:w") == first and memory.watermark("wiki:w", "cursor") == "c1" and memory.watermark("other") is None
    memory.sync("wiki:w", pull)
    assert seen[1] == seen[2] == {"cursor": "c1", "since": first} and memory.watermark("wiki:w", "cursor") == "c3"


def test_engine_answers_as_one_reader(spark, memory):
    memory.ingest(docs_of(
        spark, ("wiki:w", "u1", "Pay", "doc", "the payments service uses stripe for PAY-7", "1", json.dumps({"entities": [["service:pay", "Payments", "service"]], "aliases": [["pay", "service:pay"]], "edges": [["service:pay", "depends_on", "service:stripe", "x"]]})),
        ("notes:ana", "u2", "Secret", "note", "the payments service is secret for PAY-7", "1"), ("wiki:w", "u3", "Other", "doc", "meeting notes of monday", "1"),
    ))
    ask = spark.createDataFrame([(1, "payments service stripe")], "qid long, query string")
    everyone, reader = Engine(memory, min_score=0.3), Engine(memory, ("wiki:w",), min_score=0.3)
    assert {r.title for r in everyone.search(ask).collect()} == {"Pay", "Secret"} and {r.title for r in reader.search(ask).collect()} == {"Pay"}
    assert [r.title for r in everyone.search(ask, sources=("notes:ana",)).collect()] == ["Secret"] and reader.search(ask, documents=("x",)).count() == 0
    assert Engine(memory, min_score=0.99).search(ask).count() == 0
    assert reader.search(spark.createDataFrame([(1, "what is pay")], "qid long, query string"), expand=True).count() >= 0
    hits = everyone.search(ask)
    assert {r.title for r in everyone.related(hits.where("title = 'Pay'")).join(memory.documents.read().select("doc_id", "title"), "doc_id").collect()} <= {"Secret", "Other"}
    assert [(r.source_id, r.documents) for r in reader.sources().collect()] == [("wiki:w", 2)] and everyone.stats().first().documents == 3
    assert [(r.rel, r.names) for r in reader.neighbors("service:pay").collect()] == [("depends_on", ["service:stripe"])]
    assert [r.names for r in reader.relations("depends_on").collect()] == [["Payments"]]
    assert reader.paths("service:pay", "service:stripe").first().hops == 1
    assert reader.resolve(spark.createDataFrame([("PAY",)], "needle string")).first().id == "service:pay"
    assert reader.snapshot().count() == 1 and reader.dates(spark.createDataFrame([("yesterday",)], "phrase string")).count() == 1
    assert reader.gap_clusters(spark.createDataFrame([(1, "q one", "h", 0.1, "[]", "", "open", "", "1", None)], BACKLOG)).count() == 1
    facts = spark.createDataFrame([("Deploys are on friday", "Deploys", "bob", False)], "fact string, topic string, user string, share boolean")
    assert [r.action for r in everyone.remember(facts).collect()] == ["added"] and [r.action for r in everyone.remember(facts).collect()] == ["skipped"]
    assert memory.documents.read().where("source_id = 'notes:bob'").count() == 1
    talk = spark.createDataFrame([("c1", None, "Talk")], "id string, project_id string, title string")
    said = spark.createDataFrame([("c1", "SUMMARY:\nWe spoke.\nRELATIONSHIPS:\n- service: A | depends_on | service: B\n")], "id string, said string")
    everyone.learn_conversations(talk, said)
    assert ("service:a", "depends_on", "service:b") in edges_of(memory)


def test_exports(spark, tmp_path):
    said = "# Head\nText **bold** `c<d`\n\n- one\n- two\n\n| A | B |\n| --- | --- |\n| 1 | x,y |\n```\n<raw> **x**\n```\n| C | D |\n| 2 | 3 |\n"
    page = export.to_html(said, "T & t")
    for part in ("<title>T &amp; t</title>", "<h1>Head</h1>", "<p>Text <strong>bold</strong> <code>c&lt;d</code></p>", "<ul><li>one</li><li>two</li></ul>", "<tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x,y</td></tr>", "<pre>&lt;raw&gt; **x**</pre>"):
        assert part in page
    assert export.tables_csv(said) == 'A,B\n1,"x,y"\n\nC,D\n2,3\n'
    export.write_report(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().s == "a"
    assert instance(["prod-east", "Prod"], "prod") == "Prod" and instance(["prod-east", "x"], "east") == "prod-east" and instance(["only"], "") == "only"
    with pytest.raises(KeyError):
        instance(["a1", "a2"], "a")


# --- graph writes ------------------------------------------------------------


def test_entity_upserts(spark):
    old = spark.createDataFrame([("a", "Harbour", "service", "org", ""), ("b", "loader", "repo", "org", "test"), ("c", "Old Name", "x", "org", "service"), ("d", "Keep", "x", "org", "vendor")], "id string, name string, type string, source_id string, layer string")
    new = [
        ("a", "harbour", "repo", "org", "", 1, False), ("a", "HARBOUR", "repo", "org", "", 2, False), ("b", "Loader", "repo", "org", "data", 1, False), ("b", "LOADER", "repo", "org", "api", 2, False),
        ("c", "New Name", "x", "org", "test", 1, False), ("c", "new name", "x", "org", "", 2, False), ("d", "Renamed", "x", "notes:u", "api", 1, True), ("e", "mine", "x", "notes:u", "", 1, True), ("e", "Mine", "x", "org", "", 2, False),
    ]
    got = {r.id: r for r in graph.upsert_entities(old, spark.createDataFrame(new, "id string, name string, type string, source_id string, layer string, seq long, private boolean")).collect()}
    assert {k: (r.name, r.type, r.source_id, r.layer) for k, r in got.items()} == {
        "a": ("Harbour", "repo", "org", ""), "b": ("Loader", "repo", "org", "data"), "c": ("New Name", "x", "org", "service"), "d": ("Keep", "x", "org", "vendor"), "e": ("Mine", "x", "notes:u", ""),
    }


def test_resolution_and_its_seam(spark):
    old = spark.createDataFrame([("service:web connector", "web connector", "service"), ("service:pay", "pay", "service"), ("repo:web connector", "web connector", "repo")], "id string, name string, type string")
    new = spark.createDataFrame([("service:some other web connector", "some other web connector", "service", "said"), ("service:connector web", "connector web", "service", ""), ("repo:connector web", "connector web", "repo", ""), ("service:pay", "pay", "service", "")], "id string, name string, type string, context string")
    assert {(r.id, r.canonical) for r in graph.resolutions(new, old).collect()} == {("service:connector web", "service:web connector")}
    evidence = spark.createDataFrame([("service:web connector", "AGENTS.md", "doc")], "id string, title string, kind string")

    def judge(kind, name, names, context, contexts):
        if name == "connector web":
            raise ValueError
        return names[0].upper() if context == "said" and contexts[0] == '"AGENTS.md" (doc)' else None

    assert {(r.id, r.canonical) for r in graph.resolutions(new, old, judge, evidence).collect()} == {("service:some other web connector", "service:web connector")}


def test_branch_families(spark):
    entities = spark.createDataFrame([("repo:connector", "Connector", "repo"), ("repo:x", "x", "repo"), *((f"branch:{b}", b, "branch") for b in ("connector/a/b", "acme.connector/a/b", "x/a/b", "connector/c"))], "id string, name string, type string")
    aliases = spark.createDataFrame([("Acme.Connector", "repo:connector")], "alias string, entity_id string")
    assert [tuple(r) for r in graph.branch_bridges(entities, aliases).collect()] == [("branch:acme.connector/a/b", "branch:connector/a/b", "a/b")]
    chain = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(40)], "a string, b string")
    assert {r.root for r in graph.smallest_reachable(chain).collect()} == {"n00"}


# --- seams of retrieval ------------------------------------------------------


def test_porter_stems():
    pairs = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert {w: stem.stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert stem.stem("été") == "été" and stem.stem("is") == "is" and stem.stem("a1s") == "a1s"


def test_titles_and_stems_count(spark):
    docs = spark.createDataFrame([(1, "the deploying pipeline", "other"), (2, "meeting notes", "Deploys"), (3, "nothing here at all", "x"), (4, "more words", "y"), (5, "again", "z")], "id long, text string, title string")
    asked = spark.createDataFrame([(0, ["deployed"])], "qid long, terms array<string>")
    assert retrieval.bm25(docs, asked).count() == 0
    for small in (0, 1000):
        got = {r.id: r.score for r in retrieval.bm25(docs, asked, stemming=True, broadcast_terms=small).collect()}
        assert set(got) == {1, 2} and got[2] > got[1]


def test_embedder_and_reranker_seams(spark):
    model = embed.Embedder("bge-small", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    assert model.dim == 2 and model.prefixes()[0].startswith("Represent")
    rows = spark.createDataFrame([("abc",), (None,)], "text string").coalesce(1)
    assert [list(r.embedding) for r in model.passages(rows).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    assert model.queries(rows.withColumnRenamed("text", "query")).first().embedding[0] == 3.0 + len(model.prefixes()[0])
    scored = spark.createDataFrame([(0, k, 0.5, 0.1, k) for k in (1, 2, 3)], "qid long, id long, score double, fused double, rank int")
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id long, text string")
    asked = spark.createDataFrame([(0, "q", ["a"])], "qid long, query string, terms array<string>")
    order = lambda **o: [r.id for r in retrieval.rerank_head(scored, docs, asked, 2, **o).orderBy("rank").collect()]
    assert order(reranker=lambda: lambda q, texts: [len(t) for t in texts]) == [2, 1, 3]
    assert order(reranker=lambda: 1 / 0) == [1, 2, 3] and order(reranker=lambda: lambda q, texts: 1 / 0) == [1, 2, 3]
    assert evals.embed_throughput(spark, model, "some text", 4, 2, 0).first().batch == 4


def test_packs_and_measured_runs(spark, tmp_path):
    pack = tmp_path / "set.json"
    pack.write_text(json.dumps({"name": "s", "cases": [{"question": "Q one?", "expect": {"uris": ["u"], "refusal": True}}, {"id": 7, "question": "Two"}]}))
    got = evals.load_cases(spark, str(pack)).collect()
    assert [(r.id, r.uris, r.refusal) for r in got] == [("Q one?", ["u"], True), ("7", [], False)]
    queries = evals.load_queries(spark, str(pack))
    assert [r.query for r in queries.orderBy("place").collect()] == ["Q one?", "Two"]
    timed = evals.measured(spark, {"all": lambda q: q, "none": lambda q: q.limit(0), "never": lambda q: q}, queries, repeats=2).collect()
    assert [r["repeat"] for r in timed] == [0, 1] and all(set(r.stages) == {"all", "none"} for r in timed)
    pack.write_text("{}")
    with pytest.raises(ValueError):
        evals.load_cases(spark, str(pack))


# --- runs --------------------------------------------------------------------


def test_runs_are_retried_held_and_resumed(spark):
    clock, waits, calls = [0.0], [], []

    def sleep(run, seconds):
        waits.append(seconds)
        clock[0] += seconds

    def work(run):
        calls.append(run.state)
        if len(calls) < 10:
            raise TransientError("down")
        run.stage("documents", 5, 10)

    held = threading.Event()
    manager = runs.Runs(clock=lambda: clock[0], sleep=sleep, listen=lambda run: held.set() if run.state == "paused" else None)
    run = manager.start("wiki:w", work)
    assert held.wait(10)
    assert waits == [20, 40, 80, 160, 320, 640, 1280, 1060] and run.state == "paused"
    with pytest.raises(RuntimeError, match="already running"):
        manager.start("wiki:w", work)
    manager.resume(run)
    for _ in range(500):
        if run.ended_at:
            break
        threading.Event().wait(0.01)
    assert run.state == "done" and run.line() == "documents 5/10 · 50%"
    bad = manager.start("wiki:w", lambda r: 1 / 0, wait=True)
    assert bad.state == "failed" and "division" in bad.error
    paused = manager.start("git:g", lambda r: (manager.pause(r), manager.stop(r), r.check()), wait=True)
    assert paused.state == "stopped"
    events = manager.events(spark)
    assert {(r.source, r.state) for r in events.collect()} == {("wiki:w", "done"), ("wiki:w", "failed"), ("git:g", "stopped")}
    left = spark.createDataFrame([("1", "a:a", "paused", "sync", False, "", "", "t", None), ("2", "b:b", "running", "sync", False, "", "", "t", None)], runs.EVENT)
    again = manager.revive(left, lambda source: lambda r: None)
    assert [r.source for r in again] == ["a:a"]


def test_every_does_not_catch_up():
    now, stop, seen = [0.0], threading.Event(), []

    def tick():
        seen.append(now[0])
        now[0] += 25
        if len(seen) == 3:
            stop.set()

    assert runs.every(10, tick, stop, clock=lambda: now[0]) == 3 and seen == [0.0, 25.0, 50.0]


# --- pushed sources and files ------------------------------------------------


def test_webhooks(spark):
    body = b'{"ref": "refs/heads/main"}'
    sign = hmac.new(b"s", body, hashlib.sha256).hexdigest()
    assert push.signed("s", body, {"X-Hub-Signature-256": f"sha256={sign}"}) and push.signed("s", body, {"x-gitlab-token": "s"}) and push.signed("s", body, {"X-Webhook-Signature": sign}) and push.signed("s", body, {}, "s")
    assert not push.signed("s", body, {}) and not push.signed("s", body, {"x-gitlab-token": "t"}, "s")
    hook = push.Hook("s", lambda p: None, push.branch_pushed("main"))
    assert hook.receive(body, {"x-gitlab-token": "s"}, list, lambda: "synced") == (200, "synced")
    assert hook.receive(b"{", {"x-gitlab-token": "s"}, list, list)[0] == 400 and hook.receive(body, {}, list, list)[0] == 403
    assert push.Hook(None, lambda p: None).receive(body, {"x-gitlab-token": "s"}, list, list)[0] == 403
    assert push.Hook("s", lambda p: p["n"]).receive(b'{"n": 3}', {"x-gitlab-token": "s"}, lambda n: n + 1, list) == (200, 4)


def test_uploads_keep_each_other(spark):
    schema = "name string, content binary"
    old = spark.createDataFrame([("a.txt", bytearray(b"1"))], schema)
    new = spark.createDataFrame([("x/a.txt", bytearray(b"1")), ("a.txt", bytearray(b"2")), ("b", bytearray(b"3")), ("../..", bytearray(b"4"))], schema)
    got = {r.name: bytes(r.content) for r in push.stored_uploads(old, new).collect()}
    assert got == {"a.txt": b"1", f"a-{hashlib.sha256(b'2').hexdigest()[:8]}.txt": b"2", "b": b"3", "upload": b"4"}


def test_checkouts(spark, tmp_path):
    asked = []

    class Done:
        returncode, stderr = 0, ""

    push.checkout("r", str(tmp_path / "new"), "main", run=lambda c, **k: asked.append(c) or Done)
    (tmp_path / "old" / ".git").mkdir(parents=True)
    push.checkout("r", str(tmp_path / "old"), run=lambda c, **k: asked.append(c) or Done)
    assert asked[0][:4] == ["git", "clone", "--depth", "200"] and asked[1][3:] == ["pull", "--ff-only"]
    (tmp_path / "old" / "package.json").write_text('{"name": "shop"}')
    (tmp_path / "old" / "src").mkdir()
    (tmp_path / "old" / "src" / "m.py").write_text("import os\n")
    got = {r.uri: r for r in push.repository(spark, str(tmp_path / "old"), "git://x", "shop").collect()}
    assert set(got) == {"git://x::package.json", "git://x::src/m.py", "git://x::dependency-map"} and got["git://x::src/m.py"].title == "src/m.py"


def test_wiki_pages_and_inventories(spark):
    pages = spark.createDataFrame([("1", "page", "T", "<p>Said <b>so</b></p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "/x/1", 3, "now"), ("2", "page", "E", "", "/x/2", 1, None)], push.PAGE)
    got = push.wiki_documents(pages, "http://w/").collect()
    assert [(r.uri, r.title) for r in got] == [("http://w/x/1", "T")] and "Said\nso" in got[0].text and "| 1 | 2 |" in got[0].text
    rows = spark.createDataFrame([(f"i{k:03}",) for k in range(250)], "name string")
    made = push.inventory_document(rows, "es://x", "Indices", F.col("name")).orderBy("uri").collect()
    assert [(r.uri, r.text.count("- ")) for r in made] == [("es://x", 200), ("es://x#1", 50)]


def test_fetch_policy(monkeypatch):
    now, waits, served = [0.0], [], {"http://h/robots.txt": [(200, "User-agent: *\nDisallow: /no")], "http://h/a": [(503, ""), (200, "<p>a</p>")], "http://h/b": [(200, "<div> </div>")], "http://h/c": [(404, "")]}

    def sleep(s):
        waits.append(s)
        now[0] += s

    f = push.Fetcher(lambda u: served[u].pop(0), 2.0, lambda u: "rendered", clock=lambda: now[0], sleep=sleep)
    assert f.fetch("http://h/no/x") is None and f.fetch("http://h/a") == "<p>a</p>" and f.fetch("http://h/b") == "rendered" and f.fetch("http://h/c") is None
    assert waits == [1.0, 1.0, 2.0, 2.0]
    monkeypatch.setenv("W", "900")
    assert push.read_workers("W") == 64 and push.read_workers("NONE", 3) == 3 and push.read_workers("NONE", 99) == 8


def test_pdf_and_damaged_files():
    content = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w\\366rld) Tj 0 -14 Td [(Sec) -20 (ond) -400 (line)] TJ T* <0041> Tj ET"
    table = b"begincmap 1 beginbfchar <0041> <00410301> endbfchar 1 beginbfrange <0050> <0052> <0061> endbfrange endcmap"
    body = b"%PDF-1.4\n1 0 obj <</Length 9 /Filter /FlateDecode>> stream\n" + zlib.compress(content) + b"\nendstream\n2 0 obj <</Length 3>>stream\n" + table + b"\nendstream\n"
    assert pdf.pdf_text(body) == "Hello (big) wörld\nSecond line\nÁ" or pdf.pdf_text(body) == "Hello (big) wörld\nSecond line\nA\u0301"
    assert pdf.pdf_text(b"no") is None and pdf.pdf_text(body + b"/Encrypt") is None
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>Slide</a:t></a:p></p:sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<R><r Target="../charts/chart1.xml"/><r Target="../diagrams/data1.xml"/></R>')
        z.writestr("ppt/charts/chart1.xml", '<c:c xmlns:c="c"><c:ser><c:tx><c:v>Sales</c:v></c:tx><c:cat><c:v>Q1</c:v><c:v>Q2</c:v></c:cat><c:val><c:v>5</c:v><c:v>7</c:v></c:val></c:ser></c:c>')
        z.writestr("ppt/diagrams/data1.xml", '<d xmlns:a="a"><a:p><a:t>Step</a:t></a:p></d>')
    whole = held.getvalue()
    want = "Slide\nSales: Q1: 5, Q2: 7\nStep"
    assert files.decode("a.pptx", whole) == want
    assert files.decode("a.pptx", whole[: whole.rindex(b"PK\x01\x02", 0, whole.rindex(b"PK\x01\x02"))]) == want
    box = '<w:d xmlns:w="w" xmlns:m="m"><w:p><w:t>Out</w:t><m:AlternateContent><m:Choice><w:p><w:t>In</w:t></w:p></m:Choice><m:Fallback><w:p><w:t>In</w:t></w:p></m:Fallback></m:AlternateContent></w:p></w:d>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", box)
    assert files.decode("a.docx", held.getvalue()) == "Out\nIn"
    assert files.decoded_or_reason("a.png", b"x") == (None, "images are not supported") and files.decoded_or_reason("a.png", b"x", lambda p, d: "seen") == ("seen", None)
    assert files.decoded_or_reason("a.zip", b"x")[1] == "damaged" and files.decoded_or_reason("a.bin", gzip.compress(b"a") + b"\0")[1] == "binary"
