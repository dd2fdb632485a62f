import json

import pytest
from pyspark.sql import functions as F

from mnemora.operators import answers
from mnemora.sources import feeds


def test_references(spark):
    said = "[source: A | uri: u1 | kind: doc | score: 0.81]\n[git:x · A · u1]\nFirst words here.\n\n---\n\n[evidence: B | uri: u2] [evidence: A | uri: u1] rest"
    df = spark.createDataFrame([(0, said), (1, None), (2, "[source: A | uri: u] " + "word " * 100), (3, "[source: A | uri: ] " + "x" * 400), (4, "[source: A | uri: u | score: 1.2.3]")], "k long, t string")
    got = {r.k: r.r for r in df.select("k", answers.references(F.col("t")).alias("r")).collect()}
    assert [(r["label"], r["uri"], r["kind"], r["score"], r["snippet"]) for r in got[0]] == [("A", "u1", "doc", 0.81, "First words here."), ("B", "u2", None, None, "rest")]
    assert got[1] == [] and got[4][0].score is None
    assert len(got[2][0].snippet) <= 221 and got[2][0].snippet.endswith("word…") and got[3][0].snippet == "x" * 220 + "…"


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("https://gitlab.x.org/g/p.git::src/a b.py", "https://gitlab.x.org/g/p/-/blob/HEAD/src/a%20b.py"), ("git@github.com:o/r.git::x.md", "https://github.com/o/r/blob/HEAD/x.md"),
        ("https://u:t@bitbucket.org/o/r::x", "https://bitbucket.org/o/r/src/HEAD/x"), ("https://dev.azure.com/o/p/_git/r::x.cs", "https://dev.azure.com/o/p/_git/r?path=/x.cs"),
        ("https://wiki/x", "https://wiki/x"), ("file:///x", None), ("https://unknown.org/o/r::x", None),
    ],
)
def test_web_links(spark, uri, want):
    assert spark.createDataFrame([(uri,)], "u string").select(answers.web_link(F.col("u"))).first()[0] == want


def test_suggestions(spark):
    entities = spark.createDataFrame([("service:portal", "Portal", "service", 9, None), ("repo:customer-portal", "customer-portal", "repo", 5, None), ("team:x", "X", "team", 99, "portal people")], "id string, name string, type string, degree int, alias string")
    past = spark.createDataFrame([("Where is Portal hosted?",), ("is the portal where we deploy",)], "question string")
    starters = spark.createDataFrame([("What can you help me with?",)], "question string")
    got = [r.question for r in answers.suggestions("where is portal dep", entities, past, starters).collect()]
    assert got[0] == "Where is Portal deployed?" and "What are the dependencies of customer-portal?" in got
    assert answers.suggestions("where is portal", entities, past, starters).first().question == "Where is Portal hosted?"
    assert [r.question for r in answers.suggestions("", entities.limit(0), past.limit(0), starters).collect()] == ["What can you help me with?"]


def test_roles(spark):
    routes = spark.createDataFrame([("GET", "/api/sessions/{id}", "sessions:read", 0), ("DELETE", "/api/sessions/{id}", "sessions:write", 1)], "method string, template string, capability string, place int")
    asked = spark.createDataFrame([("get", "/api/sessions/7?x=1"), ("DELETE", "/api/sessions/7/"), ("POST", "/api/unknown")], "method string, path string")
    got = {r.method: r for r in answers.route_capability(asked, routes).select("method", "capability", *[answers.may(F.lit(x), F.col("capability")).alias(x) for x in ("viewer", "editor", "admin")]).collect()}
    assert (got["get"].capability, got["get"].viewer) == ("sessions:read", True)
    assert (got["DELETE"].viewer, got["DELETE"].editor) == (False, True)
    assert got["POST"].capability is None and not got["POST"].admin


def test_sessions(spark):
    said = "Intro line.\nFACTS:\n- one fact\n-  two\nRELATIONSHIPS:\n- service: a | depends_on | service: b\n"
    got = spark.createDataFrame([(said,)], "t string").select(answers.session_sections(F.col("t")).alias("s")).first().s
    assert (got.summary, got.facts, got.relationships) == ("Intro line.", ["one fact", "two"], ["service: a | depends_on | service: b"])
    turns = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"line {k}\nmore") for k in range(8)], "conv_id long, turn long, role string, text string")
    assert answers.sessions_to_compress(turns, 5).first().split_turn == 4 and answers.sessions_to_compress(turns, 500).count() == 0
    assert answers.digest(turns).first().note.split("\n")[:2] == ["user: line 0", "assistant: line 1"]


def test_grouped_neighbors(spark):
    view = spark.createDataFrame([("a", "r", f"b{k:03}", "A", f"B{k:03}") for k in range(70)] + [("c", "s", "a", "C", "A")], "src string, rel string, dst string, src_name string, dst_name string")
    got = {(r.rel, r.direction): (r.n, len(r.names)) for r in answers.grouped_neighbors(view, "a").collect()}
    assert got == {("r", "out"): (70, 8), ("s", "in"): (1, 1)}


def test_ledger(spark):
    hits = spark.createDataFrame([("d1", "git:a", "README.md", "r/README.md"), ("d2", "git:a", "Jan 6, 2026", "u"), ("d3", "wiki:b", "", "w")], "doc_id string, source_id string, title string, uri string")
    assert {r.key: r.score for r in answers.ledger(hits).collect()} == {"readme.md": 0.82, "jan 6, 2026": 0.53, "w": 0.65}


def test_work_items(spark):
    url = "https://x/_apis/wit/workItems/"
    rows = [(7, "Story", [(feeds.PARENT, url + "3", None), (feeds.RELATED, url + "9", None), ("ArtifactLink", "vstfs:///Git/Ref/p%2Fg-1%2FGBmain", "Branch"), ("ArtifactLink", "vstfs:///Git/Commit/p%2Funknown%2Fabc", "Commit")]), (3, "Epic", [(feeds.CHILD, url + "8", None)])]
    items = spark.createDataFrame(rows, feeds.WORK_ITEM)
    repos = spark.createDataFrame([("G-1", "Shop")], "guid string, name string")
    got = {(r.src, r.rel, r.dst) for r in feeds.work_item_links(items, repos).collect()}
    assert got == {("ticket:#7", "part_of", "ticket:#3"), ("ticket:#7", "related_to", "ticket:#9"), ("ticket:#7", "implemented_in", "repo:shop"), ("ticket:#7", "on_branch", "branch:shop/main"), ("branch:shop/main", "belongs_to", "repo:shop")}
    assert sorted(r.id for r in feeds.next_items(items, items).collect()) == [8]


def test_issues_and_requests(spark):
    issues = spark.createDataFrame([("PAY-1", "Sum", "PAY-9", ["OPS-2"]), ("PAY-2", None, None, None)], feeds.ISSUE)
    assert {(r.src, r.rel, r.dst) for r in feeds.issue_links(issues).collect()} == {
        ("ticket:pay-1", "part_of", "project:pay"), ("ticket:pay-1", "part_of", "ticket:pay-9"), ("ticket:pay-1", "related_to", "ticket:ops-2"), ("ticket:pay-2", "part_of", "project:pay"),
    }
    mrs = spark.createDataFrame([("Shop", 4, "title", "123-fix"), ("Shop", 5, "Ends 77-x", ""), ("", 6, "t", "b")], feeds.MERGE_REQUEST)
    got = {(r.src, r.rel, r.dst) for r in feeds.merge_request_links(mrs, r"\b(\d+)-").collect()}
    assert ("merge_request:shop/!4", "implements", "ticket:#123") in got and ("branch:shop/123-fix", "for_ticket", "ticket:#123") in got
    assert ("merge_request:shop/!5", "implements", "ticket:#77") in got and len(got) == 7


def test_iterations(spark):
    rows = [("a", "s1", "2026-01-01", "2026-01-14", "past"), ("a", "s2", "2026-01-15", "2026-01-28", "current"), ("a", "s3", "2026-02-01", "2026-02-14", "future"), ("a", "s0", None, None, None), ("b", "f", "2026-05-01", "2026-05-10", "future")]
    its = spark.createDataFrame(rows, "team string, path string, s string, e string, time_frame string").select("team", "path", F.to_timestamp("s").alias("start_date"), F.to_timestamp("e").alias("finish_date"), "time_frame")
    assert sorted(r.path for r in feeds.recent_iterations(its, 1).collect()) == ["f", "s2"]
    assert sorted(r.path for r in feeds.recent_iterations(its, 0).collect()) == ["f", "s1", "s2"]
    assert [r.team for r in feeds.dormant_teams(its, F.lit("2026-04-01").cast("timestamp"), 30).collect()] == ["a"]


def test_drive_items(spark):
    rows = [("d", "1", "a.md", 5, False, False, "/drive/root:/P/A", "2026-01-01"), ("d", "1", "b.md", 5, False, False, "/drive/root:", "2026-02-01"), ("d", "2", "x.png", 5, False, False, None, None), ("d", "3", "x.exe", 5, False, False, None, None), ("d", "4", "f", None, True, False, None, None), ("d", "5", "x.md", 10**9, False, False, None, None), ("d", "6", "x", 1, False, True, None, None)]
    df = spark.createDataFrame([(*r[:7], r[7]) for r in rows], feeds.DRIVE_ITEM.replace("modified_at timestamp", "m string")).withColumn("modified_at", F.to_timestamp("m")).drop("m")
    merged = feeds.merge_manifest(df.limit(1), df)
    got = {r.item_id: (r["name"], r.reason) for r in feeds.skip_reason(merged).collect()}
    assert got["1"] == ("b.md", None) and got["2"][1] == "image" and got["3"][1] == "unsupported type (exe)" and got["4"][1] == "folder" and got["5"][1] == "larger than 30 MB" and got["6"][1] == "deleted"
    assert sorted(r[0] for r in df.select(feeds.folder_path(F.col("parent_path"))).distinct().collect()) == ["", "P/A"]


def test_rich_text(spark):
    doc = {"type": "doc", "content": [{"type": "heading", "content": [{"type": "text", "text": "Head"}]}, {"type": "paragraph", "content": [{"type": "text", "text": 'a "b" '}, {"type": "text", "text": "c", "marks": []}]}]}
    got = spark.createDataFrame([(json.dumps(doc),)], "t string").select(feeds.rich_text(F.col("t"))).first()[0]
    assert got == 'Head\na "b" c'
    said = lambda *texts: {"type": "paragraph", "content": [{"type": "text", "text": t} for t in texts]}
    tree = {"type": "doc", "content": [said("see [1] and {x} here"), {"type": "bulletList", "content": [{"type": "listItem", "content": [said("one\\n", ' "text": "no"')]}, {"type": "listItem", "content": [said("two")]}]}, {"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "mention", "attrs": {"text": "@ana"}}]}]}
    deep = {"type": "text", "text": "deep"}
    for _ in range(300):
        deep = {"type": "x", "content": [deep]}
    rows = [(0, json.dumps(tree)), (1, "plain [text]"), (2, None), (3, json.dumps(deep)), (4, "17"), (5, "[]"), (6, "{}")]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k int, t string").select("k", feeds.rich_text(F.col("t")).alias("v")).collect()}
    assert got == {0: 'see [1] and {x} here\none\\n "text": "no"\ntwo\na\n@ana', 1: "plain [text]", 2: None, 3: "deep", 4: "17", 5: "", 6: ""}


def test_deployments(spark):
    items = spark.createDataFrame([("p1", "e1", "1.0", "Success"), ("p1", "gone", "1", "x")], "project_id string, environment_id string, version string, state string")
    p, e = spark.createDataFrame([("p1", "Shop")], "id string, name string"), spark.createDataFrame([("e1", "Prod")], "id string, name string")
    assert [tuple(r) for r in feeds.deployment_links(items, p, e).collect()] == [("service:shop", "deploys", "environment:prod", "1.0 — Success")]
