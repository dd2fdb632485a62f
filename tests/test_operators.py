import pytest
from pyspark.sql import functions as F

from mnemora.operators import catalog, evals, gaps, graph, mining, retrieval, scope
from mnemora.sources import files, manifests, pages, registry
from mnemora.streaming import ingest

EDGE = "src string, rel string, dst string, evidence_doc_id string"
ENTITY = "id string, name string, type string, layer string"
DOC = "doc_id string, source_id string, uri string, title string, kind string"


def docs(spark, *rows):
    return spark.createDataFrame([(d, s, f"u/{d}", d.upper(), "doc") for d, s in rows], DOC)


def ents(spark, *ids):
    return spark.createDataFrame([(i, i.split(":")[1], i.split(":")[0], "") for i in ids], ENTITY)


def leg(spark, *ids):
    return spark.createDataFrame([(0, i, k) for k, i in enumerate(ids, 1)], "qid long, id string, rank int")


@pytest.mark.parametrize(("a", "b", "want"), [(("a", "b"), ("c", "b"), ["b", "a", "c"]), (("x",), ("y",), ["x", "y"]), (("y",), ("x",), ["y", "x"])])
def test_rrf(spark, a, b, want):
    got = retrieval.rrf_fuse(leg(spark, *a), leg(spark, *b)).orderBy("rank").collect()
    assert [r.id for r in got] == want


def test_gate_is_dense_only(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, 0.1, 2), (0, 2, 0.4, 0.9, 1)], "qid long, id long, score double, fused double, rank int")
    assert [r.id for r in retrieval.gate(rows, 0.55, 8).collect()] == [1]
    assert retrieval.gate(rows, 0.95, 8).count() == 0


def test_dense_ties_nulls_and_blocks(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(5)], "qid long, embedding array<double>")
    for block in (2, 100):
        got = retrieval.dense_topk(corpus, q, 2, block).collect()
        assert sorted((r.qid, r.id, r["rank"]) for r in got) == [(k, i, i) for k in range(5) for i in (1, 2)]
    assert retrieval.dense_topk(corpus.limit(0), q, 2).count() == 0
    assert retrieval.dense_topk(corpus, q.limit(0), 2).count() == 0


def test_path_and_hops(spark):
    e = spark.createDataFrame([("repo:a", "depends_on", "package:x", "d1"), ("repo:b", "provides", "package:x", "d2"), ("repo:b", "references", "ticket:t-1", "d3")], EDGE)
    paths = graph.paths(e, "repo:a", "ticket:t-1", 3).collect()
    assert [r.rels for r in paths] == [["depends_on", "provides", "references"]]
    assert graph.paths(e, "repo:a", "ticket:t-1", 2).count() == 0
    assert {r.id: r.hops for r in graph.hops(e, "repo:a", 3).collect()} == {"repo:a": 0, "package:x": 1, "repo:b": 2, "ticket:t-1": 3}


def test_path_candidates(spark):
    e = spark.createDataFrame([("c", "depends_on", "n", "d1"), ("c", "depends_on", "s", "d2"), ("n", "depends_on", "s", "d2"), ("c", "depends_on", "n", "d9")], EDGE)
    assert [r.hops for r in graph.paths(e, "c", "n", 3).collect()] == [1, 2]
    assert graph.paths(e, "c", "n", 3, 1).count() == 1 and graph.paths(e, "c", "n", 1).count() == 1


def test_visibility(spark):
    d = docs(spark, ("d1", "s1"), ("d2", "s2"))
    e = spark.createDataFrame([("a", "r", "b", ""), ("a", "r", "c", "d1"), ("a", "r", "e", "d2"), ("a", "r", "f", "gone")], EDGE)
    seen = lambda v: {r.dst for r in scope.evidence_visible(e, d, v).collect()}
    assert seen(["s1"]) == {"b", "c"} and seen([]) == set() and seen(None) == {"b", "c", "e", "f"}
    view = graph.edge_view(e, ents(spark, "x:a"), d, ["s1"])
    assert {r.dst for r in view.collect()} == {"b", "c"}


def test_scope_predicate(spark):
    rows = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c")], "s string, d string")
    pick = lambda sc: {r.d for r in rows.where(sc.predicate(F.col("s"), F.col("d"))).collect()}
    assert pick(scope.Scope(("s1",), ("c",))) == {"a", "c"}
    assert pick(scope.Scope(("s1",), ("c",), ("s3",))) == {"c"}
    assert pick(scope.Scope(visible=())) == set() and pick(scope.Scope()) == {"a", "b", "c"}


def test_different_paths(spark):
    docs = spark.createDataFrame([("d", "Overview", "file:///x.txt", "w"), ("m", "Jan 6, 2026", "file:///x.txt", "w")], "doc_id string, title string, uri string, source_id string")
    edge = "src string, rel string, dst string, evidence_doc_id string"
    e = spark.createDataFrame([("a", "r", "b", "d"), ("a", "r", "b", "m"), ("a", "s", "b", "d"), ("a", "r", "c", "d"), ("c", "r", "b", ""), ("b", "r", "b", "d"), ("c", "r", "b", "d")], edge)
    got = [(r.hops, r.rels, r.classes) for r in graph.different_paths(e, docs, "a", "b", 3, 9).collect()]
    assert got == [(1, ["r"], ["generic"]), (1, ["r"], ["meeting-notes"]), (1, ["s"], ["generic"]), (2, ["r", "r"], ["generic", "generic"])]
    assert [r.hops for r in graph.different_paths(e, docs, "a", "b", 3, 1).collect()] == [1]
    assert graph.different_paths(e, docs, "a", "a").count() == 0 and graph.different_paths(e, docs, "a", "nobody").count() == 0 and graph.different_paths(e.limit(0), docs, "a", "b").count() == 0
    # A hub between many: each hop keeps no more than the budget, and the path is found all the same.
    hub = spark.range(300).select(F.lit("hub").alias("src"), F.lit("r").alias("rel"), F.format_string("n%03d", "id").alias("dst"), F.lit("d").alias("evidence_doc_id"))
    far = hub.select(F.col("dst").alias("src"), "rel", F.lit("far").alias("dst"), "evidence_doc_id")
    wide = hub.union(far).union(spark.createDataFrame([("a", "r", "hub", "d"), ("far", "r", "z", "d"), ("hub", "r", "long", "d"), ("long", "r", "way", "d"), ("way", "r", "z", "d")], edge))
    assert [r.nodes for r in graph.different_paths(wide, docs, "a", "z", 4, 1, budget=1).collect()] == [["a", "hub", "long", "way", "z"]]
    assert [r.nodes[2] for r in graph.different_paths(wide, docs, "a", "z", 4, 2).collect()] == ["long", "n000"]


def test_refreshed_bridges_equal_a_full_rebuild(spark):
    names = "id string, name string, type string"
    state = {"repo:a": ("Acme.Connector", "repo"), "service:a": ("acme connector", "service"), "repo:b": ("billing", "repo"), "branch:acmeconnector/main": ("m", "branch"), "branch:crane/main": ("m", "branch"), "branch:other/x/y": ("m", "branch")}
    said = {("crane", "repo:a")}

    def frames():
        rows = [(k, *v) for k, v in state.items()]
        return spark.createDataFrame(rows, names), spark.createDataFrame([(a, e) for a, e in said if e in state], "alias string, entity_id string")

    def full():
        e, al = frames()
        return {(r.src, r.dst, r.norm) for r in graph.same_as(e, al).collect()} | {(r.src, r.dst, r.branch) for r in graph.branch_bridges(e, al).collect()}

    held = full()
    assert len(held) == 2
    steps = (
        ({"pipeline:a": ("ACME-connector", "pipeline"), "service:c": ("Crane", "service")}, set(), ()),  # arrivals
        ({}, {("other", "repo:b"), ("crane", "repo:b")}, ()),  # aliases that make two families one
        ({"service:a": ("Provision", "service")}, set(), ()),  # a name is no more
        ({}, set(), ("repo:b", "pipeline:a")),  # a family falls apart
    )
    for arrived, spoken, gone in steps:
        changed = set(arrived) | {e for _, e in spoken} | set(gone)
        former = [(k, *state[k]) for k in changed if k in state]
        said |= spoken
        state.update(arrived)
        for k in gone:
            del state[k]
        all_said = spark.createDataFrame([(a, e) for a, e in said if e in changed], "alias string, entity_id string")
        e, al = frames()
        ids, new = graph.refreshed_bridges(e, al, spark.createDataFrame(former, names), all_said, spark.createDataFrame([(c,) for c in changed], "id string"))
        touched = {r.id for r in ids.collect()}
        held = {b for b in held if b[0] not in touched} | {(r.src, r.dst, r.detail) for r in new.collect()}
        assert held == full()


def test_labels_are_looked_up_by_prefix(spark):
    docs = spark.createDataFrame([(1, "s", "file:///a/b.md"), (2, "s", "file:///c"), (3, "t", "file:///a/b.md"), (4, "s", None), (5, "s", "")], "doc_id long, source_id string, uri string")
    rows = [("s", "file:///a/", "tag", "x"), ("s", "", "aka", "all"), ("s", "file:///c", "aka", "c"), ("s", "file:///cc", "aka", "cc"), ("s", None, "aka", "never"), ("t", "file:///a_", "tag", "y"), ("s", "file:///a/", "tag", "x")]
    labels = spark.createDataFrame(rows, "source_id string, uri_prefix string, kind string, value string")
    assert sorted((r.doc_id, r.value) for r in scope.with_labels(docs, labels).collect()) == [(1, "all"), (1, "x"), (2, "all"), (2, "c"), (5, "all")]
    assert sorted((r.doc_id, r.value) for r in scope.aka_terms(docs, labels, docs.where("doc_id < 3").select("doc_id")).collect()) == [(1, "all"), (2, "all"), (2, "c")]
    assert scope.with_labels(docs, labels.limit(0)).count() == 0 and scope.with_labels(docs.limit(0), labels).count() == 0
    many = spark.range(20_000).select(F.lit("s").alias("source_id"), F.format_string("file:///a/%05d", "id").alias("uri_prefix"), F.lit("tag").alias("kind"), F.col("id").cast("string").alias("value"))
    crowd = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source_id"), F.format_string("file:///a/%05d/x", "id").alias("uri"))
    assert scope.with_labels(crowd, many).where("cast(value as long) = doc_id").count() == 20_000  # 4e8 pairs of one source, not made


def test_bridge_entities(spark):
    d = docs(spark, ("d1", "git:a"), ("d2", "confluence:b"))
    e = spark.createDataFrame([("repo:r", "defines", "service:shared", "d1"), ("team:t", "owns", "service:shared", "d2")], EDGE)
    got = graph.bridge_entities(e, ents(spark, "service:shared", "repo:r", "team:t"), d).collect()
    assert [(r.id, r.source_count, r.degree) for r in got] == [("service:shared", 2, 2)]


def test_snapshot_keeps_every_type(spark):
    names = [f"branch:b{k}" for k in range(40)] + ["repo:r", "service:s", "package:p", "environment:e"]
    rows = [(f"branch:b{k}", "belongs_to", "repo:r", "d") for k in range(40)] + [("service:s", "depends_on", "package:p", "d"), ("service:s", "deploys", "environment:e", "d"), ("repo:r", "provides", "package:p", "d")]
    got = graph.snapshot(spark.createDataFrame(rows, EDGE), ents(spark, *names), docs(spark, ("d", "s")), 20).collect()
    kinds = {x.split(":")[0] for r in got for x in (r.src, r.dst)}
    assert kinds == {"branch", "repo", "service", "package", "environment"}


def test_expand(spark):
    e = spark.createDataFrame([("repo:x", "defines", "symbol:a", "d1"), ("repo:x", "defines", "symbol:b", "d2"), ("repo:z", "defines", "symbol:c", "d3")], EDGE)
    d = docs(spark, ("d1", "s"), ("d2", "s"), ("d3", "s"))
    got = lambda *ids: {r.doc_id for r in graph.expand(e, d, d.where(F.col("doc_id").isin(*ids) if ids else F.lit(False))).collect()}
    assert got("d1") == {"d2"} and got() == set() and got("nobody") == set()


def test_same_as(spark):
    none = spark.createDataFrame([], "alias string, entity_id string")

    def bridges(*rows, al=none):
        return {(r.src, r.dst) for r in graph.same_as(spark.createDataFrame([(f"{t}:{n.lower()}", n, t, "") for t, n in rows], ENTITY), al).collect()}

    assert bridges(("service", "Connector"), ("repo", "connector")) == {("repo:connector", "service:connector")}
    assert len(bridges(("repo", "Acme.Connector"), ("pipeline", "acme-connector"))) == 1
    assert not bridges(("repo", "Connector"), ("repo", "connector2"))
    assert not bridges(("repo", "API"), ("service", "api")) and not bridges(("repo", "Core API"), ("service", "core.api"))
    assert not bridges(("ticket", "Connector"), ("repo", "connector"))
    crowd = spark.createDataFrame([(f"{t}:{k}", "crowded", t, "") for k in range(4) for t in ("repo", "service")][:7], ENTITY)
    assert graph.same_as(crowd, none).count() == 0
    al = spark.createDataFrame([("acme.provisioning", "repo:crane")], "alias string, entity_id string")
    assert bridges(("repo", "Crane"), ("service", "acme.provisioning"), al=al) == {("repo:crane", "service:acme.provisioning")}


@pytest.mark.parametrize(("first", "then", "want"), [("Harbor", "harbor", "Harbor"), ("crane", "Crane", "Crane"), ("Old Name", "New Name", "New Name")])
def test_entity_upsert(spark, first, then, want):
    rows = spark.createDataFrame([("e", first, "repo", "", 0), ("e", then, "repo", "data", 1), ("e", then, "repo", "", 2)], ENTITY + ", seq int")
    got = graph.upsert_entities(ents(spark, "x:y").limit(0), rows).first()
    assert (got["name"], got["layer"]) == (want, "data")


def test_membership_split(spark):
    rows = [("team:t", "s:one", "Ana"), ("team:t", "s:one", "X\\Bob"), ("team:t", "s:two", "ana"), ("team:u", "s:one", "Z"), ("team:u", "s:two", "org/z"), ("team:t", "", "Q")]
    view = spark.createDataFrame([(d, s, m, m) for d, s, m in rows], "dst string, evidence_source_id string, src_name string, src string")
    assert sorted((r.dst, r.source, tuple(r.members)) for r in graph.membership_split(view).collect()) == [("team:t", "one", ("Ana", "X\\Bob")), ("team:t", "two", ("ana",))]


def test_ingest_actions_and_table(spark, tmp_path):
    table = ingest.Table(spark, str(tmp_path / "docs"), ingest.SCHEMA)

    def arrive(*rows):
        df = spark.createDataFrame([("src", u, u, "doc", t, at) for u, t, at in rows], "source_id string, uri string, title string, kind string, text string, updated_at string")
        return sorted(r.action for r in ingest.ingest(table, df).collect())

    assert arrive(("a", "one", "1"), ("b", "two", "1")) == ["added", "added"]
    assert arrive(("a", "one ", "2"), ("b", "TWO", "2"), ("c", "x", "2"), ("c", "y", "3")) == ["added", "skipped", "updated"]
    assert {r.uri: r.text for r in table.read().collect()} == {"a": "one", "b": "TWO", "c": "y"}
    for n in range(3):
        arrive(("a", f"again {n}", "9"))
    assert len(table.versions()) == 2


def test_stream_ingest_resumes(spark, tmp_path):
    schema = "source_id string, uri string, title string, kind string, text string, updated_at string"
    table = ingest.Table(spark, str(tmp_path / "docs"), ingest.SCHEMA)

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest.stream_ingest(spark, stream, table, str(tmp_path / "state")).awaitTermination()
        return {r.uri: r.text for r in table.read().collect()}

    spark.createDataFrame([("s", "a", "t", "doc", "one", "1")], schema).write.mode("append").json(str(tmp_path / "in"))
    assert run() == {"a": "one"}
    spark.createDataFrame([("s", "a", "t", "doc", "two", "2"), ("s", "b", "t", "doc", "x", "2")], schema).write.mode("append").json(str(tmp_path / "in"))
    assert run() == {"a": "two", "b": "x"} and run() == {"a": "two", "b": "x"}


def test_upsert_keeps_columns(spark):
    old = spark.createDataFrame([("a", "ana", 1), ("b", None, 1)], "id string, owner string, n int")
    new = spark.createDataFrame([("a", "bob", 2), ("b", "bob", 2), ("c", "bob", 2)], "id string, owner string, n int")
    got = {r.id: (r.owner, r.n) for r in catalog.upsert(old, new, ["id"], keep=["owner"]).collect()}
    assert got == {"a": ("ana", 2), "b": ("bob", 2), "c": ("bob", 2)}


def results(spark, hits, refusals):
    rows = [(1, True, None, None, s, s) for s in hits] + [(None, False, s < 0.55, None, s, None) for s in refusals]
    return spark.createDataFrame(rows, "hit_rank int, cleared boolean, refusal_correct boolean, hop_coverage double, top_score double, hit_score double")


@pytest.mark.parametrize(
    ("hits", "refusals", "want"),
    [((0.70, 0.75), (0.40, 0.45), (0.58, 0.46, 0.70, True)), ((0.80,), (0.30,), (0.55, 0.31, 0.80, True)), ((0.6,), (0.95,), (0.80, 0.80, 0.80, False))],
)
def test_calibration(spark, hits, refusals, want):
    got = evals.calibrate(results(spark, hits, refusals)).first()
    assert (got.threshold, got.plateau_low, got.plateau_high, got.floor_met) == want and got.thin


def test_percentiles_and_throughput(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40)], "k string, v double")
    got = evals.percentiles(rows, "v", ["k"]).first()
    assert (got.samples, got.p50, got.p95, got["min"], got["max"]) == (4, 25.0, 40.0, 10.0, 40.0)
    runs = spark.sql("select 's' as source, n as ingested, timestamp'2026-01-01 00:00:00' as started_at, timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, sec) as ended_at from values (120, 120), (30, 30), (5, 0) as t(n, sec)")
    overall, per = evals.throughput(runs)
    assert tuple(overall.first()) == (2, 150, 60.0) and per.first().docs_per_min == 60.0


def test_gap_clusters(spark):
    def sizes(threshold, *rows):
        df = spark.createDataFrame([(k, q, h, k) for k, (q, h) in enumerate(rows)], "id long, query string, query_hash string, created_at long")
        return sorted((r["count"] for r in gaps.records(df, gaps.clusters(df, threshold)).collect()), reverse=True)

    assert sorted(sizes(0.8, ("", "h1"), ("", "h2"), ("", "h2"))) == [1, 2]
    assert sizes(0.8, ("where is it", "a"), ("where is it", "b"), ("who owns payments", "c")) == [2, 1]
    pair = (("harbour deploy failed", "a"), ("harbour deploy timeout", "b"))
    assert sizes(0.8, *pair) == [1, 1] and sizes(0.6, *pair) == [2]


def test_code_and_channels(spark):
    rows = [
        ("a", "x/m.py", "import os.path\nfrom .near import z\nfrom json import loads\nclass C:\n    def __init__(self): pass\n    async def run(self): pass\n", "git:r"),
        ("b", "x/f.cs", '[ServiceBusTrigger("order-events")]\n[return: ServiceBus("done")]\nnew QueueClient(cs, "both");', "git:r"),
        ("c", "n.md", "class X", "git:r"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, uri string, text string, source_id string")
    code = {(r.doc_id, r.rel, r.dst) for r in mining.code_edges(df).collect()}
    assert {x for x in code if x[0] == "a"} == {("a", "defines", "symbol:c"), ("a", "defines", "symbol:run"), ("a", "imports", "module:os"), ("a", "imports", "module:json")}
    assert not any(x[0] == "c" for x in code)
    assert {(r.rel, r.dst) for r in mining.channel_edges(df).collect()} == {("subscribes_to", "topic:order-events"), ("publishes_to", "topic:done")}


def test_more_code(spark):
    rows = [
        ("js", "x/a.ts", "import 'side/effects';\nimport a from './near';\nimport {b} from '@scope/pkg/deep';\nconst c = require('lib/x');\nexport default class K {}\nasync function f() {}\n"),
        ("java", "x/A.java", "import com.acme.util.Helper;\nimport com.acme.core.*;\npublic final class A {}\n"),
        ("go", "x/a.go", 'import (\n  "fmt"\n  x "net/http"\n)\nimport "os"\nfunc (s *S) Run() {}\ntype S struct {}\n'),
        ("cs", "x/a.cs", "using System.Text;\ninternal record R(int x);\n"),
    ]
    df = spark.createDataFrame([(*r, "git:r") for r in rows], "doc_id string, uri string, text string, source_id string")
    got = {}
    for r in mining.code_edges(df).collect():
        got.setdefault(r.doc_id, set()).add((r.rel, r.dst_name))
    assert got["js"] == {("imports", "side"), ("imports", "@scope/pkg"), ("imports", "lib"), ("defines", "K"), ("defines", "f")}
    assert got["java"] == {("imports", "com.acme.util"), ("imports", "com.acme.core"), ("defines", "A")}
    assert got["go"] == {("imports", "fmt"), ("imports", "net/http"), ("imports", "os"), ("defines", "Run"), ("defines", "S")}
    assert got["cs"] == {("imports", "System.Text"), ("defines", "R")}
    kinds = spark.createDataFrame([("code", "x"), ("doc", "a/b.PY?x"), ("doc", "a.b/c"), (None, "appsettings.Dev.json")], "kind string, uri string")
    assert [tuple(r) for r in kinds.select(mining.looks_like_code(F.col("kind"), F.col("uri")), mining.looks_like_config(F.col("uri"))).collect()] == [(True, False), (True, False), (False, False), (False, True)]


def test_channels_need_the_quotes_of_their_language(spark):
    rows = [("a", "x/f.cs", "CreateSender('single'); CreateSender(\"double\");"), ("b", "x/s.yml", "service: shop\nprovider:\n  name: aws\nresources:\n  TopicName: orders\n"), ("c", "x/appsettings.json", '{"QueueName": "q1", "SubscriptionName": "s", "Db": "Server=x;Database=shop;"}')]
    df = spark.createDataFrame([(*r, "git:r") for r in rows], "doc_id string, uri string, text string, source_id string")
    assert {(r.doc_id, r.rel, r.dst) for r in mining.channel_edges(df).collect()} == {("a", "publishes_to", "topic:double"), ("b", "references", "topic:orders"), ("c", "subscribes_to", "topic:q1"), ("c", "stores_in", "datastore:shop")}


def test_tables(spark):
    said = "Members\n| Name | Email | Team |\n| --- | --- | --- |\n| Ana B | ana@x.org | Movers |\n| Cy D |  | Movers |\n"
    alone = "Teams:\n| Name | Note |\n| Blue | yes |\n"
    df = spark.createDataFrame([(1, said, "http://x/?project=Big%20One&id=45"), (2, alone, "http://x/?service=Shop"), (3, None, None), (4, "| Team | Service |\n| a\\|b | x y |", "")], "doc_id long, text string, uri string")
    edges = {(r.doc_id, r.src, r.rel, r.dst) for r in mining.table_edges(df).collect()}
    assert edges == {
        (1, "person:ana b", "works_on", "team:movers"), (1, "person:cy d", "works_on", "team:movers"), (1, "person:ana b", "works_on", "project:big one"), (1, "person:cy d", "works_on", "project:big one"),
        (1, "team:movers", "owns", "project:big one"), (2, "team:blue", "owns", "service:shop"), (4, "team:a|b", "owns", "service:x y"),
    }
    assert [tuple(r) for r in mining.table_aliases(df).collect()] == [(1, "ana@x.org", "person:ana b")]
    assert mining.pipe_tables("a | b") == []


def test_pages():
    html = "<html><head><title>Site</title></head><body><nav>menu</nav><table><tr><td><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr></table></td></tr></table><h1>Head</h1><p>x &amp; y</p></body></html>"
    said, title, _ = pages.read_page(html)
    assert title == "Head" and "menu" not in said and "| A | B |" in said and "| 1 | |" in said and "x & y" in said
    assert pages.canonical("HTTP://Ex.org:80//a//b?utm_source=1&b=2&a=1#f") == "http://ex.org/a/b?a=1&b=2"


def test_canonical_column(spark):
    df = spark.createDataFrame([("HTTP://Ex.org:80//a//b?utm_source=1&b=2&a=1#f",), ("https://x.org",)], "u string")
    assert [r[0] for r in df.select(pages.canonical_url(F.col("u"))).collect()] == ["http://ex.org/a/b?a=1&b=2", "https://x.org/"]


def test_manifests():
    assert ("needs", "npm", "left-pad", "^1") in manifests.facts("a/package.json", '{"name": "n", "dependencies": {"left-pad": "^1"}}')
    pom = "<project><groupId>g</groupId><artifactId>a</artifactId><properties><v>2</v></properties><dependencies><dependency><groupId>o</groupId><artifactId>b</artifactId><version>${v}</version></dependency></dependencies></project>"
    assert manifests.facts("pom.xml", pom) == [("provides", "Maven artifact", "g:a", ""), ("needs", "Maven", "o:b", "2")]
    assert ("needs", "NuGet", "X", "1.0") in manifests.facts("p/A.csproj", '<Project><ItemGroup><PackageReference Include="X" Version="1.0"/></ItemGroup></Project>')
    assert manifests.facts("go.mod", "module m/x\nrequire (\n\ta.b/c v1 // indirect\n)\n") == [("provides", "Go module", "m/x", ""), ("needs", "Go", "a.b/c", "v1")]
    assert ("needs", "Gradle", "g:a", "1") in manifests.facts("build.gradle", "testImplementation 'g:a:1'")
    assert ("needs", "Python", "requests", "[socks]>=2; python_version > '3'") in manifests.facts("pyproject.toml", '[project]\nname = "p"\ndependencies = ["requests[socks]>=2; python_version > \'3\'"]')
    assert manifests.facts("pom.xml", "<broken") == [] and manifests.facts("x.txt", "a") == []
    assert manifests.facts("a/b.csproj", '<P><PropertyGroup><PackageId>Pkg</PackageId><RootNamespace>Ns</RootNamespace></PropertyGroup><ProjectReference Include="..\\c\\c.csproj"/><Reference Include="Lib, Version=1"/></P>') == [
        ("provides", "NuGet package id", "Pkg", ""), ("refers", "", "../c/c.csproj", ""), ("needs", "assembly", "Lib", ""), ("provides", "project/assembly", "Ns", ""),
    ]
    poetry = '[tool.poetry]\nname="q"\n[tool.poetry.dependencies]\npython="^3"\na="*"\nb={version="2"}\n[tool.poetry.dev-dependencies]\nc="1"\n[tool.poetry.group.x.dependencies]\nd="4"\n'
    assert manifests.facts("pyproject.toml", poetry) == [("provides", "Python package", "q", ""), ("needs", "Python", "a", ""), ("needs", "Python", "b", "2"), ("needs", "Python", "c", "1"), ("needs", "Python", "d", "4")]
    assert manifests.facts("x/requirements-dev.txt", "# c\n-r a.txt\n  flask==2 # x\n\n") == [("needs", "Python", "flask", "==2 # x")]
    assert manifests.facts("setup.cfg", "[metadata]\nname = s\n[options]\ninstall_requires =\n  a>1\n  b\n") == [("provides", "Python package", "s", ""), ("needs", "Python", "a", ">1"), ("needs", "Python", "b", "")]
    assert manifests.facts("setup.py", "setup(name='s', install_requires=['a>=1', 'b'])") == [("provides", "Python package", "s", ""), ("needs", "Python", "a", ">=1"), ("needs", "Python", "b", "")]
    assert manifests.facts("go.mod", "module m\nrequire github.com/a/b v2 // x\n") == [("provides", "Go module", "m", ""), ("needs", "Go", "github.com/a/b", "v2")]
    catalog = '[versions]\nk="1.9"\n[libraries]\na="g:n:2"\nb={module="g:m", version={ref="k"}}\nc={group="h", name="o", version="3"}\n'
    assert manifests.facts("gradle/libs.versions.toml", catalog) == [("needs", "Gradle", "g:n", "2"), ("needs", "Gradle", "g:m", "1.9"), ("needs", "Gradle", "h:o", "3")]
    assert manifests.facts("settings.gradle", "rootProject.name = 'r'\ninclude ':a', ':b:c'\n") == [("provides", "project/assembly", x, "") for x in ("r", "a", "b:c")]
    assert manifests.facts("build.gradle.kts", 'api(project(":core"))\nimplementation("g:a")') == [("needs", "Gradle", "g:a", ""), ("refers", "", ":core", "")]
    assert manifests.facts("package.json", '{"name": "n", "workspaces": {"packages": ["p/*"]}}') == [("provides", "npm package", "n", ""), ("refers", "", "workspace p/*", "")]
    assert manifests.facts("angular.json", '{"projects": {"web": {}}}') == [("provides", "project/assembly", "web", "")]
    assert manifests.facts("packages.config", '<packages><package id="A" version="1"/></packages>') == [("needs", "NuGet", "A", "1")]
    assert manifests.facts("x.nuspec", "<p><metadata><id>I</id><dependencies><dependency id='D' version='2'/></dependencies></metadata></p>") == [("provides", "NuGet package id", "I", ""), ("needs", "NuGet", "D", "2")]
    assert manifests.facts("Pipfile", '[packages]\na="*"\n[dev-packages]\nb="1"\n') == [("needs", "Python", "a", ""), ("needs", "Python", "b", "1")]


def test_dependency_map(spark):
    files = [("package.json", '{"name": "@org/shop-web", "dependencies": {"@org/pay-core-lib": "1", "left": "2"}}'), ("a/package.json", '{"dependencies": {"left": "2"}}'), ("b.csproj", "<P/>")]
    scanned = manifests.scan(spark.createDataFrame(files, "path string, text string"))
    page = manifests.map_document(scanned, "shop-web", "git://x").first()
    assert page.uri == "git://x::dependency-map" and page.title == "shop-web: dependencies & packages"
    assert page.text == (
        "# shop-web — dependency & package map\n\nshop-web is also referred to as: shop web.\n\n"
        "## Packages and modules this repo provides\n- @org/shop-web — npm package (package.json) — also referred to as: shop web\n\n"
        "## Projects and assemblies built here\n- b (b.csproj)\n\n"
        "## Dependencies\n### npm\n- shop-web depends on @org/pay-core-lib 1 — also referred to as: pay core lib — referenced by package.json\n- shop-web depends on left 2 — referenced by a/package.json, package.json\n"
    )
    edges, aliases = manifests.graph(scanned, "shop-web")
    assert {(r.rel, r.dst) for r in edges.collect()} == {("provides", "package:@org/shop-web"), ("provides", "project:b"), ("depends_on", "package:@org/pay-core-lib"), ("depends_on", "package:left")}
    assert {(r.alias, r.entity_id) for r in aliases.collect()} == {("shop web", "package:@org/shop-web"), ("shop web", "repo:shop-web"), ("pay core lib", "package:@org/pay-core-lib")}
    assert manifests.map_document(scanned.limit(0), "r", "u").count() == 0


def test_read_tree(spark, tmp_path):
    import zipfile

    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.md").write_text("hello")
    (tmp_path / "src" / "empty.md").write_text("")
    (tmp_path / "src" / "p.png").write_bytes(b"\x89PNG")
    (tmp_path / "node_modules" / "b.md").write_text("hidden")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.txt", "inside")
        z.writestr("deep.zip", b"PK")
    got = {r.title: r.text for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "hello", "z.zip": "--- in.txt ---\ninside\n\n--- deep.zip ---\n(nested archive)"}


def test_retry_and_registry():
    tries, slept = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise registry.TransientError
        return "done"

    assert registry.with_retry(call, sleep=slept.append) == "done" and slept == [1.0, 2.0]
    with pytest.raises(KeyError):
        registry.create("nobody")


def test_data_source(spark):
    class Two(registry.Connector):
        def pages(self):
            return [1, 2]

        def fetch(self, page, since):
            yield (f"u{page}", "t", "x", "doc", f"2026-01-0{page}")

    assert sorted(r.uri for r in registry.read(spark, "two", Two()).collect()) == ["u1", "u2"]
    assert [r.uri for r in registry.read(spark, "two", Two(), since="2026-01-02").collect()] == ["u2"]
