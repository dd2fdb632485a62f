from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from mnemora.functions import chunk, classify, dates, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_normalize(spark):
    said = "It’s the “deploy”  guide – read​ it \r\nnow\n\n\n\nplease \x07"
    want = 'It\'s the "deploy" guide - read it\nnow\n\nplease'
    assert one(spark, text.normalize_text(F.col("t")), t=said) == want
    assert one(spark, text.normalize_text(F.col("t")), t=want) == want
    assert one(spark, text.normalize_text(F.col("t")), t=None) == ""
    assert one(spark, text.normalize_query(F.col("t")), t="  ﬁne\n print ") == "fine print"


def test_ticket_keys(spark):
    said = "Fixed HARB-123 and PAY-7 after the UTF-8 regression; see CVE-2024-1234, HARB-123 again, and SHA-256 hashing notes."
    assert one(spark, text.ticket_keys(F.col("t")), t=said) == ["HARB-123", "PAY-7"]


@pytest.mark.parametrize(("source", "id_"), [("git:proj-a", "repo:proj-a"), ("files:proj-a", "repo:proj-a"), ("notes:user-taught", "source:user-taught"), ("plain", "source:plain")])
def test_source_entity(spark, source, id_):
    assert one(spark, text.source_entity(F.col("s"))["id"], s=source) == id_


def test_aliases(spark):
    assert one(spark, text.aliases(F.col("s")), s="Acme.Harbor.Models") == ["harbor models", "harbor.models", "acme harbor models"]
    assert one(spark, text.aliases(F.col("s"), False), s="proj-a-service") == ["proj a service"]
    assert one(spark, text.aliases(F.col("s")), s="single") == []


def test_context_prefix(spark):
    crumb = text.breadcrumb(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, crumb, a="src", b="Title", c="uri") == "src · Title · uri"
    assert one(spark, crumb, a="src", b="src", c="") == "src"
    assert one(spark, text.without_context(crumb, text.with_context(crumb, F.col("b"))), a="src", b="body", c="u") == "body"


def test_labels_have_no_wildcards(spark):
    for uri, prefix, want in (("a/b", "", True), ("a/b", "a/", True), ("ab", "a_", False), ("axb", "a%", False), ("a%b", "a%", True)):
        assert one(spark, text.label_applies(F.col("u"), F.col("p")), u=uri, p=prefix) is want


def test_edge_scores(spark):
    cases = [("authored-doc", 3, 2, 0.90), ("meeting-notes", 1, 1, 0.25), ("generic", 1, 1, 0.45), ("dependency-map", 3, 2, 0.95), ("dependency-map", 1, 1, 0.60), ("authored-doc", 2, 1, 0.62), ("meeting-notes", 3, 2, 0.60), ("unknown", 1, 1, 0.45), ("meeting-notes", 0, 0, 0.25)]
    rows = spark.createDataFrame(cases, "k string, d int, s int, want double")
    got = rows.select("want", classify.edge_score(F.col("k"), F.col("d"), F.col("s")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


@pytest.mark.parametrize(
    ("title", "uri", "want"),
    [
        ("x", "git://r::dependency-map", "dependency-map"), ("Jan 6, 2026", "u", "meeting-notes"), ("2026-01-06", "u", "meeting-notes"), ("01/06/26", "u", "meeting-notes"),
        ("Weekly sync - infra", "u", "meeting-notes"), ("x", "r/AGENTS.md", "authored-doc"), ("x", "README.md?ref=main", "authored-doc"), ("x", "design.rst", "authored-doc"),
        ("x", "adr-012-queues.md", "authored-doc"), ("Seen on Jan 6, 2026 there", "other.md", "generic"), (None, None, "generic"),
    ],
)
def test_evidence_class(spark, title, uri, want):
    assert one(spark, classify.evidence_class(F.col("t"), F.col("u"), F.lit("git:x")), t=title, u=uri) == want


def test_personal_notes(spark):
    kind = classify.evidence_class(F.lit("t"), F.lit("u"), F.col("s"))
    assert one(spark, kind, s="notes:ana") == "personal-note"
    assert one(spark, kind, s="notes:user-taught") == "generic"


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("CustomerAccountRepository.cs", "data"), ("src/Controllers/AccountThing.cs", "api"), ("Api.Tests/AccountControllerTests.cs", "test"), ("Contest/ScoreRepository.cs", "data"),
        ("web/node_modules/x/index.js", "vendor"), ("Pricing/QuoteCalculation.cs", None), ("a/App.tsx", "ui"), ("Dockerfile", "infra"), ("", None), ("scripts/jquery-3.1.js", "vendor"),
    ],
)
def test_layers(spark, path, want):
    assert one(spark, classify.layer(F.col("p")), p=path) == want


def test_triples(spark):
    lines = F.array(F.lit("service: checkout | depends_on | service: payments"), F.lit("The service depends on it."), F.lit("planet: x | depends_on | service: y"), F.lit("environment: prod | owns | person: bob"))
    got = one(spark, classify.triples(lines), x="")
    assert [tuple(t) for t in got] == [("service", "checkout", "depends_on", "service", "payments")]


def test_plain_chunks(spark):
    said = " ".join(f"Sentence number {k} ends here." for k in range(2000))
    got = one(spark, chunk.chunks(F.col("t"), F.lit("doc")), t=said)
    assert max(map(len, got)) <= 1610 and got[0].startswith("Sentence number 0 ") and got[-1].endswith("number 1999 ends here.")
    assert one(spark, chunk.chunks(F.col("t"), F.lit("doc")), t="") == []


def test_markdown_chunks_repeat_headings(spark):
    said = "intro\n## Deployments\n" + "We deploy often. " * 300
    got = one(spark, chunk.chunks(F.col("t"), F.lit("doc")), t=said)
    assert got[0] == "intro" and len(got) > 2 and all(c.startswith("## Deployments") for c in got[1:])


def test_code_chunks(spark):
    lines = [f"line_{k}" for k in range(200)]
    got = one(spark, chunk.chunks(F.col("t"), F.lit("code")), t="\n".join(lines))
    want, at = [], 0
    while True:
        want.append("\n".join(lines[at : at + 60]))
        if at + 60 >= 200:
            break
        at += 52
    assert got == want
    assert one(spark, chunk.chunks(F.col("t"), F.lit("code")), t="") == []


NOW = datetime(2026, 8, 10, 12, tzinfo=UTC)


@pytest.mark.parametrize(
    ("phrase", "start", "end"),
    [
        ("last friday", (2026, 8, 7), (2026, 8, 8)), ("last week", (2026, 8, 3), (2026, 8, 10)), ("last monday", (2026, 8, 3), (2026, 8, 4)), ("last sunday", (2026, 8, 9), (2026, 8, 10)),
        ("next friday", (2026, 8, 14), (2026, 8, 15)), ("last weekend", (2026, 8, 8), (2026, 8, 9 + 1)), ("today?", (2026, 8, 10), (2026, 8, 11)), ("from 2026-02-03 to 2026-02-01", (2026, 2, 1), (2026, 2, 4)),
        ("last month", (2026, 7, 1), (2026, 8, 1)), ("3 days ago", (2026, 8, 7), (2026, 8, 8)),
    ],
)
def test_dates(phrase, start, end):
    w = dates.resolve(phrase, NOW)
    assert (w.start, w.end) == (datetime(*start, tzinfo=UTC), datetime(*end, tzinfo=UTC))


def test_rolling_dates_and_none():
    assert dates.resolve("last 7 days", NOW).end == NOW
    assert dates.resolve("last friday", datetime(2026, 8, 7, 9, tzinfo=UTC)).start.day == 31
    assert dates.resolve("soonish", NOW) is None and dates.resolve(None, NOW) is None
    berlin = dates.resolve("2026-03-29", NOW, dates.zone("Europe/Berlin"))
    assert (berlin.end - berlin.start).total_seconds() == 23 * 3600
