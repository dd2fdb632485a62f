"""Queries of the catalog's tables, the memory's ingest and what surrounds an answer, over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, catalog, evals, fulltext, graph, mining, retrieval, scope
from ..operators.lineage import cut, folder
from ..sources import manifests, push
from ..streaming.log import Log
from ..streaming.store import Memory
from . import model
from .memory import _FUSED, query
from .model import table

# --- counts and queues -------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    uri = F.concat(F.lit("file:///"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_id"), uri.alias("uri"), F.col("lang").alias("title"), F.lit("doc").alias("kind"), F.when(F.col("n_chars") % 3 == 0, "").otherwise("{}").alias("graph_json"), "n_chars")


@query("select source as source_id, count(*) as documents, count(*) filter (n_chars % 3 = 0) as without_payload from documents group by grouping sets ((source), ()) having grouping(source) = 1 or source is not null")
def document_counts(spark, d):
    return catalog.document_counts(_documents(spark, d))


def _pending(spark, d) -> DataFrame:
    """Orders as deferred documents; every seventh document is gone."""
    return table(spark, d, "orders").select(F.concat(F.lit("order:"), F.when(F.col("o_orderkey") % 7 == 0, "gone").otherwise(F.col("o_orderkey").cast("string"))).alias("doc_id"), F.col("o_orderpriority").alias("source_id"), F.lit("").alias("graph_json"))


@query("select o_orderpriority as source_id, count(*) as n from orders group by 1")
def pending_by_source(spark, d):
    return catalog.pending_by_source(_pending(spark, d))


@query("select 'order:' || o_orderkey as doc_id, o_orderpriority as source_id, '' as graph_json, 'file:///orders/' || o_orderstatus || '/' || o_orderkey || '.md' as uri, 'Order ' || o_orderkey as title, 'ticket' as kind from orders where o_orderkey % 7 <> 0")
def pending_documents(spark, d):
    return catalog.pending_documents(_pending(spark, d), model.evidence(spark, d))


@query("select c_custkey as doc_id, 'n' || c_nationkey as source_id, n_name as source_name, case when n_name is not null then 'nation' end as source_type, case when n_regionkey = 1 then 'ana' end as source_owner from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3 where c_mktsegment = 'BUILDING'")
def promotion_queue(spark, d):
    """Customers as documents, those of one segment as offered; nations of three regions as registered sources."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_id"), F.when(F.col("c_mktsegment") == "BUILDING", "requested").otherwise("").alias("promotion_status"))
    sources = table(spark, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.when(F.col("n_regionkey") == 1, "ana").alias("owner"))
    return catalog.promotion_queue(docs, sources).drop("promotion_status")


@query("select n_nationkey as project_id, count(c_custkey) as sessions from nation left join customer on c_nationkey = n_nationkey and c_mktsegment = 'BUILDING' group by 1")
def project_sessions(spark, d):
    sessions = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("project_id"))
    return catalog.counted(table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id")), sessions, "project_id", "sessions")


@query("select id, title, kind from (select *, row_number() over (partition by id order by title, kind) as n from (select distinct e.id, title, kind from ends e join evidence on doc_id = evidence_doc_id where evidence_doc_id <> '')) where n <= 3", "graph")
def evidence_titles(spark, d):
    return graph.evidence_titles(model.edges(spark, d), model.evidence(spark, d), model.entities(spark, d))


@query("select 'branch:org.repo-' || s_suppkey || '/main' as src, 'branch:repo ' || s_suppkey || '/main' as dst, 'main' as branch from supplier")
def branch_bridges(spark, d):
    """Suppliers as repositories of two spellings, each with a branch main and one of its own."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    name, spoken = F.concat(F.lit("Org.Repo-"), "k"), F.concat(F.lit("repo "), "k")
    repos = s.select(F.concat(F.lit("repo:"), F.lower(name)).alias("id"), name.alias("name"), F.lit("repo").alias("type"))
    branches = s.select(F.explode(F.array(F.concat(F.lit("branch:"), F.lower(name), F.lit("/main")), F.concat(F.lit("branch:"), spoken, F.lit("/main")), F.concat(F.lit("branch:"), F.lower(name), F.lit("/own/x")))).alias("id")).select("id", F.col("id").alias("name"), F.lit("branch").alias("type"))
    return graph.branch_bridges(repos.union(branches), s.select(spoken.alias("alias"), F.concat(F.lit("repo:"), F.lower(name)).alias("entity_id")))


@query("select count(*) filter (doc_id % 4 = 0) as added, count(*) filter (doc_id % 4 = 1) as updated, count(*) filter (doc_id % 4 >= 2) as skipped, count(*) filter (doc_id % 4 = 2) as graph_refreshed, count(*) as documents from documents")
def action_counts(spark, d):
    k = F.col("doc_id") % 4
    action = F.when(k == 0, "added").when(k == 1, "updated").when(k == 2, "graph_refreshed").otherwise("skipped")
    return catalog.action_counts(table(spark, d, "documents").select("doc_id", action.alias("action")))


@query("""select count(*) as answers, round(median(value), 6) as answer_ms_p50, round(median(case when event_id % 4 > 0 then value / 2 end), 6) as first_token_ms_p50, count(case when event_id % 4 > 0 then value end) as streamed,
  round(avg(event_id % 5), 2) as rounds_per_answer, round(avg(event_id % 3), 2) as tool_calls_per_answer, round(median(user_id + event_id % 100), 6) as tokens_p50, sum(user_id)::bigint as prompt_tokens_total, sum(event_id % 100)::bigint as completion_tokens_total,
  sum(user_id // 2)::bigint as cached_tokens_total, round(sum(user_id // 2) * 1.0 / sum(user_id), 3) as cache_hit_rate from events""")
def agent_summary(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("value").alias("answer_ms"), F.when(F.col("event_id") % 4 > 0, F.col("value") / 2).alias("first_token_ms"), (F.col("event_id") % 5).alias("rounds"), (F.col("event_id") % 3).alias("tool_calls"), F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), F.expr("user_id div 2").alias("cached_tokens"))
    out = evals.agent_summary(rows)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_p50") else F.col(c) for c in out.columns])


@query("select row_number() over (order by part, type, place, question) as place, question from (select lower(question) as k, min(part) as part, min(type) as type, min(place) as place, min(question) as question from (select 0 as part, n_name as type, 0 as place, 'What is new in region ' || n_regionkey || '?' as question from nation union all select 1, '', 0, 'What can you help me with?') group by 1)")
def starter_questions(spark, d):
    n = table(spark, d, "nation")
    offered = n.select(F.col("n_name").alias("type"), F.lit(0).alias("place"), F.concat(F.lit("What is new in region "), F.col("n_regionkey").cast("string"), F.lit("?")).alias("question"))
    return answers.starters(n.select(F.col("n_name").alias("type")), offered, ["What can you help me with?"])


# --- writes ------------------------------------------------------------------


@query("select distinct trim(lower(p_type)) as alias, 'part:' || p_partkey as entity_id from part")
def alias_upsert(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("alias"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"))
    return graph.upsert_aliases(p, p.withColumn("alias", F.concat(F.lit(" "), F.upper("alias"), F.lit(" "))))


@query("select 'nation:' || n_nationkey as id, case when n_regionkey = 1 then n_name else 'Land ' || n_nationkey end as name from nation")
def private_renames(spark, d):
    """Nations named again by documents; those of one region come from a private source and rename nothing."""
    old = model.entities(spark, d).where("type = 'nation'").withColumn("source_id", F.lit("org"))
    n = table(spark, d, "nation")
    named = n.select(F.lit("d").alias("doc_id"), F.when(F.col("n_regionkey") == 1, "notes:ana").otherwise("org").alias("source_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("name"), F.lit("nation").alias("type"), F.lit("").alias("layer"), F.lit(0).alias("seq"))
    none = spark.sql("select '' as doc_id, '' as source_id, '' as alias, '' as entity_id where false")
    no_edges = spark.sql("select '' as doc_id, '' as source_id, '' as src, '' as rel, '' as dst, '' as detail where false")
    kept, _, _ = graph.guarded(named, none, no_edges, old, spark.sql("select 'notes:ana' as source_id"))
    return graph.upsert_entities(old, kept).select("id", "name")


@query("select source_id, uri_prefix, kind, value from tags where value <> 'closed' union select '9-NEW', '', 'tag', 'new'", "graph")
def label_writes(spark, d):
    """Labels after one was set twice, one that is there set again, and one removed."""
    labels = model.labels(spark, d)
    added = spark.sql("select * from values ('9-NEW', '', 'tag', ' new '), ('9-NEW', '', 'tag', 'new'), ('1-URGENT', '', 'tag', 'urgent') as t(source_id, uri_prefix, kind, value)")
    return catalog.remove_labels(catalog.set_labels(labels, added), labels.where("value = 'closed'"))


@query("select item_id as id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as query_hash, case when item_id % 2 = 0 then 'resolved' else 'open' end as status, case when item_id % 2 = 0 then 'synced' else '' end as resolution from benchmark")
def gap_backlog(spark, d):
    """Benchmark items as refused questions, of which only the hash is kept; every second one is resolved."""
    b = table(spark, d, "benchmark")
    empty = spark.createDataFrame([], "id long, query string, query_hash string, best_score double, nearest_json string, session_id string, status string, resolution string, created_at string, resolved_at string")
    rows = b.select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.lit(0.3).alias("best_score"), F.lit("[]").alias("nearest_json"), F.lit("").alias("session_id"))
    logged = catalog.log_gaps(empty, rows, F.lit("2026-01-01"), keep_query=False)
    return catalog.resolve_gaps(logged, b.where("item_id % 2 = 0").select(F.col("item_id").alias("id")), "synced", F.lit("2026-01-02")).select("id", "query_hash", "status", "resolution")


@query("select item_id as id from benchmark where item_id % 2 <> 0")
def open_gaps(spark, d):
    b = table(spark, d, "benchmark")
    return catalog.open_gaps(b.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "resolved").otherwise("open").alias("status"))).select("id")


@query("select conv_id as id, min(turn) as created_at, max(turn) as updated_at, arg_max(text, turn) as title from conversations group by 1")
def session_saves(spark, d):
    """Every turn saves its session; the first one's time stays its beginning."""
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("id"), F.col("text").alias("title"), F.col("turn").alias("created_at"), F.col("turn").alias("updated_at"))
    first = rows.groupBy("id").agg(F.min_by(F.struct("title", "created_at", "updated_at"), "updated_at").alias("s")).select("id", "s.*")
    return catalog.save_sessions(first, rows).select("id", "created_at", "updated_at", "title")


@query("select event_id as id, case when event_id % 3 = 0 then 's1' when event_id % 5 = 0 then 's0' end as session_id, event_id % 4 = 0 and ts < timestamp '2024-01-15 00:00:00' and event_id % 7 > 0 as expired from events where event_id % 4 = 0 or event_id % 4 <> 0")
def attachment_links(spark, d):
    """Events as attachments: some are bound to a session already, some now; old ones that are not deleted expire."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") % 3 != 0), "s0").alias("session_id"), F.when((F.col("event_id") % 4 == 0) & (F.col("event_id") % 7 > 0), F.lit(None).cast("string")).otherwise("x").alias("deleted_at"), F.col("ts").cast("timestamp_ntz").alias("uploaded_at"))
    linked = catalog.link_attachments(rows, e.where("event_id % 3 = 0").select(F.col("event_id").alias("id")), "s1")
    gone = catalog.expired_attachments(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", F.lit(True).alias("e"))
    return linked.join(gone, "id", "left").select("id", "session_id", F.coalesce("e", F.lit(False)).alias("expired"))


@query("select 'n' || n_nationkey as source_id, 'new ' || n_name as name, case when n_regionkey = 1 then 'ana' end as owner, n_regionkey as shared from nation union all select 'fresh', 'fresh', null, 0")
def source_registration(spark, d):
    n = table(spark, d, "nation")
    source = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id")
    old = n.select(source, F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.lit("{}").alias("config_json"), F.when(F.col("n_regionkey") == 1, "ana").alias("owner"), F.col("n_regionkey").alias("shared"), F.lit(1).alias("configured"), F.lit(None).cast("int").alias("sync_interval_minutes"), F.lit("then").alias("created_at"))
    seen = n.select(source, F.concat(F.lit("new "), "n_name").alias("name"), F.lit("nation").alias("type"), F.lit("{}").alias("config_json"), F.lit("now").alias("created_at"))
    fresh = spark.sql("select 'fresh' as source_id, 'fresh' as name, 'x' as type, '{}' as config_json, 'now' as created_at")
    return catalog.register_sources(old, seen.union(fresh)).select("source_id", "name", "owner", "shared")


@query("select distinct 'repo:n' || n_nationkey as entity_id, unnest([lower(n_name), 'land ' || n_nationkey]) as alias from nation")
def declared_aliases(spark, d):
    said = F.to_json(F.struct(F.concat("n_name", F.lit(" , Land "), F.col("n_nationkey").cast("string"), F.lit(",")).alias("aka")))
    return catalog.declared_aliases(table(spark, d, "nation").select(F.concat(F.lit("git:n"), F.col("n_nationkey").cast("string")).alias("source_id"), said.alias("config_json")))


@query("select doc_id, case when doc_id % 3 = 0 then 7 else n_chars end as n_chars, lang from documents")
def column_writes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return catalog.set_columns(docs, docs.where("doc_id % 3 = 0").select("doc_id", F.lit(7).cast("long").alias("n_chars")))


@query("select 'n' || n_nationkey as source_id, key, value from nation, (values ('since', '2026-02-01'), ('cursor', 'a')) t(key, value)")
def state_writes(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"))
    old = n.select("source_id", F.explode(F.create_map(F.lit("since"), F.lit("2026-01-01"), F.lit("cursor"), F.lit("a"))).alias("key", "value"))
    new = n.select("source_id", F.explode(F.create_map(F.lit("since"), F.lit("2026-02-01"), F.lit("cursor"), F.lit(None).cast("string"))).alias("key", "value"))
    return catalog.set_state(old, new)


@query("select event_id as id, case when event_id % 5 = 0 and event_id % 10 > 0 then 'interrupted' when event_id % 5 = 0 then 'running' else 'done' end as state from events where ts >= timestamp '2024-01-15 00:00:00'")
def run_history(spark, d):
    """Events as runs: every fifth says that it runs, of which every second is live."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 5 == 0, "running").otherwise("done").alias("state"), F.col("ts").cast("timestamp_ntz").alias("started_at"))
    live = rows.where("id % 10 = 0")
    since = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    dead = catalog.run_history(rows.join(live, "id", "left_anti"), since)
    return dead.union(live.where(F.col("started_at") >= since)).select(F.col("id").cast("long").alias("id"), "state")


@query("select event_id as id from events where event_id % 5 = 0")
def unfinished_runs(spark, d):
    return catalog.unfinished(table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ended_at"))).select("id")


@query("select p_partkey as name, 'new' as path, p_size as scope from part")
def skill_registration(spark, d):
    """Skills found again at another place keep what an administrator set."""
    old = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.lit("old").alias("path"), F.col("p_size").alias("scope"))
    return catalog.register_skills(old, old.select("name", F.lit("new").alias("path"), F.lit(0).alias("scope")))


@query("select c_mktsegment as key, min(case when c_nationkey % 2 = 0 then 'ana' else '' end) as dummy from customer group by 1 having false union all select key, owner from (select 'k' || (c_custkey % 50) as key, case when bool_or(c_nationkey % 3 = 0) then 'ana' else '' end as owner from customer where c_nationkey % 3 < 2 group by 1)")
def skill_secrets(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.concat(F.lit("k"), (F.col("c_custkey") % 50).cast("string")).alias("key"), F.when(F.col("c_nationkey") % 3 == 0, "ana").when(F.col("c_nationkey") % 3 == 1, "").otherwise("bob").alias("owner"), F.lit("x").alias("value_enc"))
    return catalog.secrets_of(rows, ("ana", "")).select("key", F.col("owner").alias("dummy"))


@query("select (select count(*) from evidence where source_id <> '1-URGENT') as documents, (select count(*) from edges e left join evidence d on d.doc_id = e.evidence_doc_id where e.evidence_doc_id = '' or d.source_id <> '1-URGENT') as edges, (select count(*) from orders where o_orderkey % 7 = 0 or o_orderpriority <> '1-URGENT') as pending", "graph")
def delete_cascade(spark, d):
    """The graph without the documents of one source."""
    tables = {"documents": model.evidence(spark, d), "edges": model.edges(spark, d), "pending": _pending(spark, d)}
    left = catalog.delete_documents(tables, model.evidence(spark, d).where("source_id = '1-URGENT'"))
    return left["documents"].agg(F.count("*").alias("documents")).crossJoin(left["edges"].agg(F.count("*").alias("edges"))).crossJoin(left["pending"].agg(F.count("*").alias("pending")))  # one row each


@query("select 0::bigint as documents, 0::bigint as edges, (select count(*) from nation where n_regionkey = 1) as sources")
def memory_reset(spark, d):
    sources = table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") == 1).cast("int").alias("configured"))
    left = catalog.reset({"documents": model.evidence(spark, d), "edges": model.edges(spark, d), "sources": sources})
    return left["documents"].agg(F.count("*").alias("documents")).crossJoin(left["edges"].agg(F.count("*").alias("edges"))).crossJoin(left["sources"].agg(F.count("*").alias("sources")))  # one row each


# --- the memory's ingest -----------------------------------------------------

_AS_CODE = r"""with d as (select doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') as words from documents),
c as (select doc_id, array_to_string(words[i * 52 + 1 : i * 52 + 60], chr(10)) as body from (select *, unnest(generate_series(0, greatest(len(words) - 9, 0) // 52)) as i from d where words[1] <> ''))"""


def _as_code(spark, d, changed: bool) -> DataFrame:
    """Documents as code with a word a line; of the first delivery every fourth has another text, and every fifth is missing."""
    docs = table(spark, d, "documents")
    words = F.replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit(" "), F.lit("\n"))
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("before\n"), words)).otherwise(words) if changed else words
    rows = docs.where("doc_id % 5 <> 0") if changed else docs
    uri = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    return rows.select(F.col("source").alias("source_id"), uri.alias("uri"), F.col("lang").alias("title"), F.lit("code").alias("kind"), said.alias("text"), F.lit("2026-01-0" + ("1" if changed else "2")).alias("updated_at"))


def _ingested(spark, d) -> tuple[Memory, DataFrame]:
    """A memory after two deliveries, and what the second did."""
    memory = Memory(spark, folder(spark), buckets=8)
    memory.ingest(_as_code(spark, d, True))
    return memory, memory.ingest(_as_code(spark, d, False))


def _doc(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("number"), text.doc_id(F.col("source"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))).alias("doc_id"))


@query("select doc_id as number, case when doc_id % 5 = 0 then 'added' when doc_id % 4 = 0 then 'updated' else 'skipped' end as action from documents")
def memory_actions(spark, d):
    return _ingested(spark, d)[1].join(_doc(spark, d), "doc_id").select("number", "action")


@query(_AS_CODE + " select doc_id as number, count(*) as chunks, sum(length(body))::bigint as chars, 32 as width from c group by 1")
def memory_chunks(spark, d):
    """Chunks after the second delivery: of every document those of its present text alone."""
    chunks = _ingested(spark, d)[0].chunks.read()
    each = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.size("embedding")).alias("width"))
    return each.join(_doc(spark, d), "doc_id").groupBy("number").agg(F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"), F.max("width").alias("width"))


@query(_AS_CODE + ", w as (select doc_id, unnest(regexp_extract_all(lower(body), '[a-z0-9_]+')) as term from c) select term, count(distinct doc_id) as documents, count(*) as tf from w group by 1")
def memory_postings(spark, d):
    postings = _ingested(spark, d)[0].postings.read()
    return postings.groupBy("term").agg(F.count_distinct("doc_id").alias("documents"), F.sum("tf").alias("tf"))


# --- answers -----------------------------------------------------------------


@query("select conv_id, turn, 1 as rank, 'Option ' || turn as summary, case when turn % 2 = 0 then 0.5 end as confidence from conversations where turn % 3 > 0")
def candidate_blocks(spark, d):
    """Turns as answers with a block of one good line, one of another form and one that cites what was not retrieved."""
    c = table(spark, d, "conversations")
    n = F.col("turn").cast("string")
    turn = F.struct("conv_id", "turn")
    block = F.concat(F.lit("Prose.\n```candidates\n1. Option "), n, F.lit(" | confidence=0.9 | sources: Page "), n, F.lit("\nnot a line\n2. Other | confidence=0.9 | sources: Nowhere\n```"))
    said = c.select(turn.alias("turn"), block.alias("text"))
    refs = answers.known_citations(c.where("turn % 3 > 0").select(turn.alias("turn"), F.concat(F.lit("[source: Page "), n, F.lit(" | uri: u]")).alias("content")))
    scores = c.where("turn % 2 = 0").select(turn.alias("turn"), F.concat(F.lit("page "), n).alias("key"), F.lit(0.5).alias("score"))
    return answers.scored_candidates(said, refs, scores).select("turn.conv_id", "turn.turn", "rank", "summary", "confidence")


@query("select conv_id, turn, 'Page ' || turn as label, 'u' || conv_id as uri, 0.25 as score, 'First words of ' || turn as snippet from conversations")
def citation_parsing(spark, d):
    n = F.col("turn").cast("string")
    said = F.concat(F.lit("[source: Page "), n, F.lit(" | uri: u"), F.col("conv_id").cast("string"), F.lit(" | kind: doc | score: 0.25]\n[git:x · Page · u]\nFirst   words\nof "), n, F.lit("\n\n---\n\nmore"))
    refs = table(spark, d, "conversations").select("conv_id", "turn", F.explode(answers.references(said)).alias("r"))
    return refs.select("conv_id", "turn", "r.label", "r.uri", "r.score", "r.snippet")


@query("select conv_id, 'conversation://default/' || conv_id as uri, 'Conversation memory (' || conv_id || '):' || chr(10) || 'Talk of ' || count(*) || chr(10) || chr(10) || 'Durable facts learned:' || chr(10) || '- one' || chr(10) || chr(10) || 'Relationships noted:' || chr(10) || '- shop (service) depends_on pay (service)' as text from conversations group by 1")
def conversation_notes(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    said = F.concat(F.lit("SUMMARY:\nTalk of "), F.col("n").cast("string"), F.lit("\nFACTS:\n- one\nRELATIONSHIPS:\n- service: shop | depends_on | service: pay\n- person: ana | owns\n"))
    sessions = c.select(F.col("conv_id").cast("string").alias("id"), F.lit("").alias("project_id"), F.lit("").alias("title"))
    notes = answers.conversation_notes(sessions, c.select(F.col("conv_id").cast("string").alias("id"), said.alias("said")))
    return notes.select(F.substring_index("uri", "/", -1).cast("long").alias("conv_id"), "uri", "text")


@query("select c_custkey as id, case when c_nationkey < 10 then 'Active project: ' || n_name || '. Prefer knowledge and memories related to this project.' || case when c_custkey % 2 = 0 then chr(10) || chr(10) else '' end else '' end || case when c_custkey % 2 = 0 then 'Summary of this conversation so far (older turns were compressed):' || chr(10) || c_name else '' end as context from customer left join nation on n_nationkey = c_nationkey")
def system_contexts(spark, d):
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("summary"))
    projects = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("description"))
    return answers.system_context(sessions, projects)


@query("select conv_id as id, coalesce(arg_min(substr(text, 1, 80), turn) filter (role = 'user'), '') as title, sum(length(text)) // 4 as est_tokens from conversations group by 1")
def recorded_sessions(spark, d):
    none = spark.sql("select 0L as id, '' as title, '' as summary where false")
    return answers.recorded(table(spark, d, "conversations"), none)


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'notes:user-taught' else 'notes:u' || s_nationkey end as source_id, 'note://supplier-' || lpad(s_suppkey::varchar, 9, '0') || '-' || substr(sha256(s_name || chr(10) || 'Fact ' || s_suppkey), 1, 10) as uri from supplier")
def taught_notes(spark, d):
    s = table(spark, d, "supplier")
    facts = s.select("s_suppkey", F.concat(F.lit("Fact "), F.col("s_suppkey").cast("string")).alias("fact"), F.col("s_name").alias("topic"), F.concat(F.lit("u"), F.col("s_nationkey").cast("string")).alias("user"), (F.col("s_suppkey") % 2 == 0).alias("share"))
    return answers.taught_notes(facts).select(F.substring_index("text", " ", -1).cast("long").alias("s_suppkey"), "source_id", "uri")


@query("select p_partkey, 'a_b' || p_partkey || '.txt' as name, sha256('t' || p_partkey) as hash from part")
def upload_names(spark, d):
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select("p_partkey", text.upload_name(F.concat(F.lit("c:\\x/../a#b"), k, F.lit(".txt "))).alias("name"), text.token_hash(F.concat(F.lit("t"), k)).alias("hash"))


@query("select s_suppkey as doc_id, lower(s_name) || '@x.org' as alias, 'person:' || lower(s_name) as entity_id from supplier")
def table_aliases(spark, d):
    said = F.concat(F.lit("| Name | Email | Team |\n| --- | --- | --- |\n| "), "s_name", F.lit(" | "), "s_name", F.lit("@x.org | Blue "), F.col("s_nationkey").cast("string"), F.lit(" |\n"))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), said.alias("text"), F.lit("").alias("uri"))
    return mining.table_aliases(docs)


@query("select '# shop — dependency & package map' as title, count(*) as provided, (select count(distinct s_nationkey) from supplier) as needed from supplier")
def dependency_map(spark, d):
    from .workflows import _manifests

    page = manifests.map_document(manifests.scan(_manifests(spark, d)), "shop", "git://x")
    lines = page.select(F.split("text", "\n").alias("l"))
    has = lambda part: F.size(F.filter("l", lambda x: F.contains(x, F.lit(part)))).cast("long")
    return lines.select(F.element_at("l", 1).alias("title"), has("— npm package").alias("provided"), has("- shop depends on lib-").alias("needed"))


@query("select 'page://' || page_id as uri, 'a: ' || page_id || chr(10) || 'url: ' || url as tail from pages where url <> ''")
def inventory_items(spark, d):
    p = table(spark, d, "pages")
    docs = push.item_documents(p, F.concat(F.lit("page://"), F.col("page_id").cast("string")), F.lit("Page"), {"a": F.col("page_id"), "none": F.lit(None), "url": F.col("url")})
    return docs.select("uri", F.trim(F.substring_index("text", "# Page\n\n", -1), F.lit("\n")).alias("tail"))


# --- retrieval ---------------------------------------------------------------

_TITLED = model.CORPUS_SQL.replace("regexp_extract_all(lower(text), '[a-z0-9_]+') as words", "regexp_extract_all(lower(text), '[a-z0-9_]+') as words, regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9_]+') as title")
_TITLED = _TITLED.replace("select id, len(words) as dl, unnest(words) as term from corpus", "select id, len(words) + len(title) as dl, unnest(list_concat(words, title)) as term, unnest(list_concat([1.0 for x in words], [2.0 for x in title])) as weight from corpus")
_TITLED = _TITLED.replace("count(*) as tf from post", "sum(weight) as tf from post").replace("avg(len(words)) as avgdl from corpus", "avg(len(words) + len(title)) as avgdl from corpus").replace("list_distinct(words[1:8]) as terms", "list_distinct(list_append(words[1:8], title[1])) as terms")


@query(f"with {_TITLED} select qid, id, round(score, 6) as score, rank from sparse where rank <= 8")
def bm25_titles(spark, d):
    """Titles (source and language) count twice; every question also names its source."""
    docs = model.corpus(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").withColumn("title", F.concat("source_id", F.lit(" "), "lang"))
    asked = model.asked(spark, d).join(docs.select(F.col("id").alias("qid"), "source_id"), "qid").withColumn("terms", F.array_distinct(F.array_append("terms", F.lower("source_id"))))
    return retrieval.bm25_topk(docs, asked, 8).withColumn("score", F.round("score", 6))


@query(f"with {_TITLED} select qid, id, round(score, 6) as score, rank from sparse where rank <= 8")
def index_topk(spark, d):
    """As bm25_titles, from a stored index: filled with a first delivery, of which every fourth document has another text and every fifth is missing, then with what changed."""
    docs = model.corpus(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").withColumn("title", F.concat("source_id", F.lit(" "), "lang"))
    docs = cut(docs.select("id", "source_id", "title", "text"))  # five readers, one join of all texts
    asked = docs.where("id % 50 = 0").select(F.col("id").alias("qid"), F.array_distinct(F.array_append(text.match_terms(F.col("text"), 8), F.lower("source_id"))).alias("terms"))
    index = fulltext.Index(Log(spark, folder(spark)), buckets=8, stemming=False)
    rows = docs
    old = rows.withColumn("text", F.when(F.col("id") % 4 == 0, F.concat(F.lit("before "), "text")).otherwise(F.col("text")))
    index.update(rows.limit(0), old.where("id % 5 <> 0"))
    index.update(old.where("id % 4 = 0 and id % 5 <> 0"), rows.where("id % 4 = 0 or id % 5 = 0"))
    return index.topk(asked, 8).withColumn("score", F.round("score", 6))


@query(_FUSED + """, scored as (select o.qid, o.id, o.fused, o.rank, d.score from ordered o join dense d using (qid, id)
), told as (select s.*, len(list_intersect(list_distinct(c.words), a.terms)) * 1.0 / greatest(len(a.terms), 1) as overlap from scored s join corpus c using (id) join asked a using (qid)
), again as (select qid, id, score, fused, case when rank <= 16 then row_number() over (partition by qid, rank <= 16 order by overlap desc, rank) else rank end as rank from told
) select qid, id, round(score, 6) as score, round(fused, 9) as fused, rank from again where rank <= 8""", "corpus")
def rerank_overlap(spark, d):
    out = retrieval.hybrid_search(model.corpus(spark, d), model.asked(spark, d), 8, -1.0, rerank=16)
    return out.select("qid", "id", F.round("score", 6).alias("score"), F.round("fused", 9).alias("fused"), "rank")


@query("select count(*) filter (owner is null or shared = 1 or owner = 'ana') as visible, count(*) filter (owner = 'ana') as managed from (select case when c_nationkey % 3 = 0 then null when c_custkey % 7 = 0 then 'ana' else 'bob' end as owner, case when c_mktsegment = 'BUILDING' then 1 else 0 end as shared from customer)")
def row_permissions(spark, d):
    rows = table(spark, d, "customer").select(F.when(F.col("c_nationkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, "ana").otherwise("bob").alias("owner"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("shared"))
    visible = scope.visible_sources(rows, "ana").agg(F.count("*").alias("visible"))
    return visible.crossJoin(rows.agg(F.count_if(scope.can_manage(F.col("owner"), "ana")).alias("managed")))  # one row each
