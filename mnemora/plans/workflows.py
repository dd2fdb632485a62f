"""Queries of pages, mining, evaluation, gaps, dates and streams over the driver tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, dates, embed, text
from ..operators import ann, answers, catalog, evals, gaps, graph, mining, retrieval
from ..sources import feeds, manifests, pages
from . import model
from .memory import ORACLE_SQL, query
from .model import table

# --- pages -------------------------------------------------------------------


@query(r"""select page_id, scheme || '://' || host || case when path = '' then '/' else path end || case when q = '' then '' else '?' || q end as uri from (
  select page_id, lower(regexp_extract(bare, '^([a-z]+)://', 1)) as scheme, lower(regexp_extract(bare, '^[a-z]+://([^/?]*)', 1)) as host,
    regexp_replace(regexp_extract(bare, '^[a-z]+://[^/?]*([^?]*)', 1), '/+', '/', 'g') as path,
    array_to_string(list_sort([p for p in string_split(regexp_extract(bare, '\?(.*)$', 1), '&') if p <> '' and not starts_with(p, 'utm_') and not starts_with(p, 'gclid=') and not starts_with(p, 'fbclid=')]), '&') as q
  from (select page_id, split_part(url, '#', 1) as bare from pages))""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", pages.canonical_url(F.col("url")).alias("uri"))


@query()
def page_documents(spark, d):
    return pages.documents(table(spark, d, "pages"))


@query()
def page_links(spark, d):
    return pages.links(table(spark, d, "pages"))


@query(f"select uri, floor(log2(page_id + 1))::int as level from ({ORACLE_SQL['canonical_url'].strip()}) where page_id < 15")
def crawl_levels(spark, d):
    """Pages as a tree: each links to two others, and three levels below the first are read."""
    p = table(spark, d, "pages").select("page_id", "url", F.concat("html", F.col("page_id").cast("string")).alias("html"))
    place = p.select(F.col("page_id").alias("to"), F.col("url").alias("target"))
    links = p.select("page_id", F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("to")).join(place, "to")
    listed = links.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), "target", F.lit('">x</a>')))), "").alias("links"))
    linked = p.join(listed, "page_id", "left").withColumn("html", F.concat("html", F.coalesce("links", F.lit("")))).drop("links")
    start = [r.url for r in p.where("page_id = 0").select("url").collect()]  # the one address to begin with
    return pages.crawl(linked, start, 3)


@query(r"""with u as (select [x for x in string_split(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://', ''), '/') if x <> ''] as p from pages),
s as (select p, unnest(generate_series(1, len(p) - 1)) as i from u where len(p) > 1)
select distinct array_to_string(p[1:i], '/') as parent, array_to_string(p[1:i+1], '/') as child from s""")
def site_map(spark, d):
    return pages.site_map(table(spark, d, "pages"))


@query("select doc_id, 'a' || doc_id || '.txt,b.md' as members from documents")
def archive_manifest(spark, d):
    said = F.concat(F.lit("--- a"), F.col("doc_id").cast("string"), F.lit(".txt ---\n"), F.replace("text", F.lit("---"), F.lit("")), F.lit("\n\n--- b.md ---\nx"))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.archive_members(said), ",").alias("members"))


@query(r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as plain from pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


# --- mining ------------------------------------------------------------------


def _code(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    said = F.concat(F.lit("import os\nfrom json import loads\nfrom .x import y\n\nclass C"), F.col("p_partkey").cast("string"), F.lit(":\n    def run"), F.col("p_size").cast("string"), F.lit("(self):\n        s = client.get_topic_sender(topic_name='orders-"), F.col("p_size").cast("string"), F.lit("')\n"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("uri"), said.alias("text"), F.lit("git:shop").alias("source_id"))


@query("""select p_partkey as doc_id, 'repo:shop' as src, rel, dst from (
  select p_partkey, unnest([{'rel': 'defines', 'dst': 'symbol:c' || p_partkey}, {'rel': 'defines', 'dst': 'symbol:run' || p_size}, {'rel': 'imports', 'dst': 'module:os'}, {'rel': 'imports', 'dst': 'module:json'}], recursive := true) from part)""")
def code_graph(spark, d):
    return mining.code_edges(_code(spark, d)).select("doc_id", "src", "rel", "dst")


@query("select p_partkey as doc_id, 'repo:shop' as src, 'publishes_to' as rel, 'topic:orders-' || p_size as dst from part")
def channel_graph(spark, d):
    return mining.channel_edges(_code(spark, d)).select("doc_id", "src", "rel", "dst")


@query("select o_orderkey as doc_id, 'source:desk' as src, 'references' as rel, 'ticket:ord-' || (o_orderkey % 100000) as dst from orders")
def ticket_graph(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("concat('see ORD-', o_orderkey % 100000, ' and UTF-8')").alias("text"), F.lit("mail:desk").alias("source_id"))
    return mining.ticket_edges(o).select("doc_id", "src", "rel", "dst")


@query("select s_suppkey as doc_id, 'team:' || lower(s_name) as src, 'owns' as rel, 'service:svc ' || s_nationkey as dst from supplier")
def table_graph(spark, d):
    said = F.concat(F.lit("Ownership\n\n| Team | Service | Active |\n| --- | --- | --- |\n| "), "s_name", F.lit(" | svc "), F.col("s_nationkey").cast("string"), F.lit(" | true |\n"))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), said.alias("text"), F.lit("http://x/").alias("uri"))
    return mining.table_edges(docs)


@query("select s_suppkey as doc_id, 'service:' || lower(s_name) as src, 'depends_on' as rel, 'datastore:db' || s_nationkey as dst from supplier")
def triple_graph(spark, d):
    lines = F.array(F.concat(F.lit("service: "), "s_name", F.lit(" | depends_on | datastore: db"), F.col("s_nationkey").cast("string")), F.lit("environment: prod | owns | person: bob"), F.lit("just a sentence"))
    return mining.triple_edges(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), lines.alias("lines"))).select("doc_id", "src", "rel", "dst")


def _manifests(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    said = F.concat(F.lit('{"name": "shop-'), F.col("s_suppkey").cast("string"), F.lit('", "dependencies": {"lib-'), F.col("s_nationkey").cast("string"), F.lit('": "^1.0"}}'))
    return s.select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit("/package.json")).alias("path"), said.alias("text"))


@query("select 'npm' as kind, 'lib-' || s_nationkey as name, '^1.0' as version, array_to_string(list_sort(list('p' || s_suppkey || '/package.json')), ',') as referenced_by from supplier group by s_nationkey")
def manifest_dependencies(spark, d):
    return manifests.dependencies(manifests.scan(_manifests(spark, d))).withColumn("referenced_by", F.array_join("referenced_by", ","))


@query("select 'repo:shop' as src, rel, dst from (select distinct 'provides' as rel, 'package:shop-' || s_suppkey as dst from supplier union select distinct 'depends_on', 'package:lib-' || s_nationkey from supplier)")
def manifest_graph(spark, d):
    return manifests.graph(manifests.scan(_manifests(spark, d)), "shop")[0]


# --- evaluation --------------------------------------------------------------


def _results(spark, d) -> DataFrame:
    """Each labelled document as a case: toxic ones should be refused; its number of characters plays the scores."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    score = (F.col("n_chars") % 1000) / 1000
    refusal = F.col("toxic") == 1
    return docs.select(
        F.when(~refusal & (F.col("doc_id") % 5 != 0), F.col("doc_id") % 5).alias("hit_rank"),
        (score >= 0.5).alias("cleared"),
        F.when(refusal, score < 0.5).alias("refusal_correct"),
        F.lit(None).cast("double").alias("hop_coverage"),
        score.alias("top_score"),
        F.when(~refusal, score).alias("hit_score"),
    )


_RESULTS = "(select doc_id, toxic = 1 as refusal, (n_chars % 1000) / 1000.0 as score from documents join labels using (doc_id))"


@query(f"""select count(*) as cases, count(*) filter (not refusal) as answerable, count(*) filter (refusal) as refusal_cases,
  round(avg(case when not refusal then case when doc_id % 5 <> 0 then 1.0 else 0 end end), 6) as recall_at_k, round(avg(case when not refusal then case when score >= 0.5 then 1.0 else 0 end end), 6) as grounded_recall,
  round(avg(case when not refusal then case when doc_id % 5 <> 0 then 1.0 / (doc_id % 5) else 0 end end), 6) as mrr, round(avg(case when refusal then case when score < 0.5 then 1.0 else 0 end end), 6) as refusal_accuracy from {_RESULTS}""")
def retrieval_metrics(spark, d):
    out = evals.retrieval_metrics(_results(spark, d)).drop("hop_coverage")
    return out.select("cases", "answerable", "refusal_cases", *[F.round(c, 6).alias(c) for c in ("recall_at_k", "grounded_recall", "mrr", "refusal_accuracy")])


@query(f"""select t, round(avg(case when not refusal then case when score >= t / 100.0 then 1.0 else 0 end end), 3) as gr, round(avg(case when refusal then case when score < t / 100.0 then 1.0 else 0 end end), 3) as ra
  from {_RESULTS}, (select unnest(generate_series(30, 80))::int as t) group by t""")
def calibration_curve(spark, d):
    return evals.calibration_curve(_results(spark, d)).select("t", "gr", "ra")


@query(f"""with curve as (select t, round(avg(case when not refusal then case when score >= t / 100.0 then 1.0 else 0 end end), 3) as gr, round(avg(case when refusal then case when score < t / 100.0 then 1.0 else 0 end end), 3) as ra
  from {_RESULTS}, (select unnest(generate_series(30, 80))::int as t) group by t),
o as (select *, ra >= 0.5 as ok, round((ra + gr) / 2, 6) as objective from curve), best as (select max(objective) filter (ok) as best from o), plateau as (select t from o, best where ok and abs(objective - best) < 1e-9),
edges as (select min(t) as low, max(t) as high from plateau), safe as (select t from o order by ra desc, t desc limit 1), middle as (select t from plateau, edges order by abs(2 * t - low - high), t limit 1)
select coalesce((select t from middle), safe.t) / 100.0 as threshold, coalesce(low, safe.t) / 100.0 as plateau_low, coalesce(high, safe.t) / 100.0 as plateau_high, best is not null as floor_met,
  (select count(*) filter (not refusal) < 10 or count(*) filter (refusal) < 10 from {_RESULTS}) as thin from edges, safe, best""")
def threshold_calibration(spark, d):
    return evals.calibrate(_results(spark, d), 0.5)


@query("""select event_type, count(*) as samples, round(median(value), 6) as p50, round(max(case when k = least(n - 1, round_even(0.95 * (n - 1), 0)) then value end), 6) as p95, round(avg(value), 6) as mean, min(value) as min, max(value) as max
  from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null) group by 1""")
def percentile_summary(spark, d):
    out = evals.percentiles(table(spark, d, "events").select("event_type", "value"), "value", ["event_type"])
    return out.select("event_type", "samples", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")], "min", "max")


@query("""select user_id as source, round(median(value / (60 * (1 + event_id % 7) / 60.0)), 6) as docs_per_min, count(*) as samples from events where value > 0 and event_id % 3 <> 0 group by 1""")
def sync_throughput(spark, d):
    """Events as runs: 1 to 7 minutes long, a third unfinished."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    runs = e.select(F.col("user_id").alias("source"), F.col("value").alias("ingested"), F.col("t").alias("started_at"), F.when(F.col("event_id") % 3 != 0, F.timestamp_micros(F.unix_micros("t") + 60_000_000 * (1 + F.col("event_id") % 7))).alias("ended_at"))
    return evals.throughput(runs)[1].withColumn("docs_per_min", F.round("docs_per_min", 6))


@query("select event_type as metric, round(avg(value), 6) as old, round(avg(value) + (case when event_type < 'm' then 0.01 else -0.1 end), 6) as new, case when event_type < 'm' then 0.01 else -0.1 end as delta, event_type >= 'm' as regressed from events group by 1")
def report_compare(spark, d):
    old = table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    new = old.select("metric", F.round(F.col("value") + F.when(F.col("metric") < "m", 0.01).otherwise(-0.1), 6).alias("value"))
    return evals.compare(old, new)


# --- gaps, expansion, dates --------------------------------------------------


def _gaps(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.sha2("text", 256).alias("query_hash"), F.col("item_id").alias("created_at"))


_JACCARD = """with w as (select item_id as id, item_id % 4 as cluster_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from benchmark),
s as (select a.cluster_id, a.id, round(coalesce(sum(len(list_intersect(a.t, b.t)) * 1.0 / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))), 0), 9) as s
  from w a left join w b on a.cluster_id = b.cluster_id and a.id <> b.id and len(list_intersect(a.t, b.t)) > 0 group by all)
select cluster_id, id from (select *, row_number() over (partition by cluster_id order by s desc, id) as rn from s) where rn = 1"""


@query(_JACCARD)
def gap_medoid(spark, d):
    return gaps.medoids(_gaps(spark, d).select((F.col("id") % 4).alias("cluster_id"), "id", "query", F.col("id").alias("order")))


@query()
def gap_clusters(spark, d):
    g = _gaps(spark, d)
    return gaps.records(g, gaps.clusters(g, 0.6)).withColumn("samples", F.array_join("samples", " / ")).withColumn("connectors", F.array_join("connectors", ","))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'octopus' when 1 then 'jira' else 'grafana,datadog,elastic' end as connectors from orders")
def connector_suggestions(spark, d):
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, "When did we deploy?").when(k == 1, "which SPRINT is it").otherwise("an error in the logs")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(gaps.suggested_connectors(said), ",").alias("connectors"))


@query("select c_custkey as qid, 'orders of n' || n_nationkey || ' last year ' || n_name as expanded from customer join nation on c_nationkey = n_nationkey")
def query_expansion(spark, d):
    n = table(spark, d, "nation")
    spoken = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    q = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("qid"), F.concat(F.lit("orders of "), spoken, F.lit(" last year")).alias("query"))
    names = n.select(spoken.alias("key"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return gaps.expand_queries(q, names, text.GENERIC_TOKENS)


@query("""select * from (values ('last friday', timestamp '2026-08-07', timestamp '2026-08-08'), ('last week', timestamp '2026-08-03', timestamp '2026-08-10'), ('last month', timestamp '2026-07-01', timestamp '2026-08-01'),
  ('yesterday', timestamp '2026-08-09', timestamp '2026-08-10'), ('2026-01-05 to 2026-01-07', timestamp '2026-01-05', timestamp '2026-01-08'), ('3 days ago', timestamp '2026-08-07', timestamp '2026-08-08')) t(phrase, start_at, end_at)""")
def relative_dates(spark, d):
    said = spark.sql("select * from values ('last friday'), ('last week'), ('last month'), ('yesterday'), ('2026-01-05 to 2026-01-07'), ('3 days ago') as t(phrase)")
    w = dates.window(F.col("phrase"), datetime(2026, 8, 10, 12, tzinfo=UTC))
    return said.select("phrase", w.alias("w")).select("phrase", F.col("w.start").cast("timestamp_ntz").alias("start_at"), F.col("w.end").cast("timestamp_ntz").alias("end_at"))


@query()
def hash_embed_topk(spark, d):
    """Dense search with the hash embedder: benchmark items as queries over all documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), embed.hash_embed("text").alias("embedding"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), embed.hash_embed("text").alias("embedding"))
    return retrieval.dense_topk(docs, q, 8).withColumn("score", F.round("score", 6))


@query("select n_nationkey, n_name as name, 'data' as layer from nation")
def entity_upsert(spark, d):
    """Nations arrive again in lower case (the capitals stay) and with a layer."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.lit("").alias("layer"))
    new = n.select("id", F.lower("name").alias("name"), "type", F.lit("data").alias("layer"), F.lit(1).alias("seq"))
    return graph.upsert_entities(n, new).select(F.col("id").cast("int").alias("n_nationkey"), "name", "layer")


@query("select l.role, count(*) as n from (select role, row_number() over (partition by lower(text) order by conv_id, turn) as rn from conversations where role = 'user') l where rn = 1 group by 1")
def past_questions(spark, d):
    w = Window.partitionBy(F.lower("text")).orderBy("conv_id", "turn")
    return table(spark, d, "conversations").where("role = 'user'").withColumn("rn", F.row_number().over(w)).where("rn = 1").groupBy("role").agg(F.count("*").alias("n"))


@query(f"select src, rel, dst, src_type, dst_type from (select e.*, s.type as src_type, t.type as dst_type from edges e join entities s on s.id = e.src join entities t on t.id = e.dst) where rel = 'part_of'", "graph")
def signature_filter(spark, d):
    """Relations of entities whose types the vocabulary allows: nations and regions stand for projects."""
    as_type = lambda c: F.when(F.col(c).isin("nation", "region"), "project").otherwise(F.col(c))
    return graph.signed(model.edges(spark, d), model.entities(spark, d), as_type).select("src", "rel", "dst", "src_type", "dst_type")


@query("select dst, array_to_string(list_sort(list(distinct name)), ',') as names from edges join entities on id = src where rel = 'part_of' group by 1", "graph")
def grouped_relations(spark, d):
    view = graph.relations(model.edges(spark, d), model.entities(spark, d), model.evidence(spark, d), "part_of")
    return answers.grouped_relations(view).withColumn("names", F.array_join("names", ","))


@query("select conv_id, sum(length(text)) // 4 as tokens, max(case when role = 'user' and back >= 4 then turn end) as split_turn from (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) group by 1 having sum(length(text)) // 4 > 500 and max(case when role = 'user' and back >= 4 then turn end) is not null")
def sessions_to_compress(spark, d):
    return answers.sessions_to_compress(table(spark, d, "conversations"), 500)


@query("select conv_id, string_agg(role || ': ' || substr(split_part(text, chr(10), 1), 1, 160), chr(10) order by turn) as note from conversations where role in ('user', 'assistant') and text <> '' group by 1")
def session_notes(spark, d):
    return answers.digest(table(spark, d, "conversations"))


@query("select s_suppkey, 'https://github.com/org/r' || s_nationkey || '/blob/HEAD/src/f%20' || s_suppkey || '.py' as link from supplier")
def web_links(spark, d):
    uri = F.concat(F.lit("git@github.com:org/r"), F.col("s_nationkey").cast("string"), F.lit(".git::src/f "), F.col("s_suppkey").cast("string"), F.lit(".py"))
    return table(spark, d, "supplier").select("s_suppkey", answers.web_link(uri).alias("link"))


@query("select role, sum(allowed) as n from (select role, case when role = 'admin' then 1 when method = 'GET' then 1 when role = 'editor' then 1 else 0 end as allowed from (values ('viewer'), ('editor'), ('admin')) r(role), (select case when o_orderkey % 2 = 0 then 'GET' else 'DELETE' end as method from orders)) group by 1")
def role_permissions(spark, d):
    routes = spark.sql("select * from values ('GET', '/api/sessions/{id}', 'sessions:read', 0), ('DELETE', '/api/sessions/{id}', 'sessions:write', 1) as t(method, template, capability, place)")
    asked = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "GET").otherwise("DELETE").alias("method"), F.concat(F.lit("/api/sessions/"), F.col("o_orderkey").cast("string"), F.lit("?x=1")).alias("path"))
    roles = F.explode(F.array(*map(F.lit, ("viewer", "editor", "admin")))).alias("role")
    got = answers.route_capability(asked, routes).select("capability", roles)
    return got.groupBy("role").agg(F.sum(answers.may(F.col("role"), F.col("capability")).cast("long")).alias("n"))


@query("select 'ticket:#' || l_orderkey as src, 'part_of' as rel, 'ticket:#' || min(l_partkey) as dst from lineitem where l_linenumber = 1 group by l_orderkey")
def work_item_links(spark, d):
    """Orders as work items whose first line's part is the parent."""
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    link = F.struct(F.lit(feeds.PARENT).alias("rel"), F.concat(F.lit("https://x/_apis/wit/workItems/"), F.col("p").cast("string")).alias("url"), F.lit(None).cast("string").alias("name"))
    items = lines.select(F.col("l_orderkey").alias("id"), F.lit("Story").alias("type"), F.array(link).alias("relations"))
    none = spark.sql("select '' as guid, '' as name where false")
    return feeds.work_item_links(items, none).select("src", "rel", "dst")


@query("select path, team from (select event_id::varchar as path, user_id::varchar as team, row_number() over (partition by user_id order by ts desc, event_id::varchar desc) as n from events) where n <= 2")
def recent_iterations(spark, d):
    e = table(spark, d, "events")
    its = e.select(F.col("user_id").cast("string").alias("team"), F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("start_date"), F.col("ts").cast("timestamp").alias("finish_date"), F.lit("past").alias("time_frame"))
    return feeds.recent_iterations(its, 2).select("path", "team")


@query("select doc_id, 'rehomed' as source from documents where doc_id % 10 = 0 union all select doc_id, source from documents where doc_id % 10 <> 0")
def move_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"))
    moved = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("rehomed").alias("to_source"))
    return catalog.move_documents(docs, moved).withColumnRenamed("source_id", "source")


@query("select conv_id, array_to_string(list(text order by turn), '|') as texts from conversations group by 1")
def ordered_chunks(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    return catalog.ordered_chunks(c).select(F.col("doc_id").alias("conv_id"), F.array_join("texts", "|").alias("texts"))


@query()
def ann_topk(spark, d):
    """The inverted file over all vectors, whatever their number."""
    return ann.topk(model.corpus(spark, d), model.asked(spark, d), 8, lists=32, probes=12, exact_below=1).withColumn("score", F.round("score", 6))


@query("select count(*) as cases, round(avg(case when toxic = 0 and quality = 1 then case when doc_id % 3 = 0 then 1.0 else 0 end end), 6) as citation_rate, round(avg(case when toxic = 0 and quality = 1 and doc_id % 4 > 0 then 1.0 * least(doc_id % 2, doc_id % 4) / (doc_id % 4) end), 6) as keyword_coverage, round(avg(case when toxic = 0 then case when quality = 0 then 1.0 else 0 end end), 6) as false_refusal_rate, round(avg(case when toxic = 1 then case when quality = 0 then 1.0 else 0 end end), 6) as refusal_accuracy from labels")
def agent_metrics(spark, d):
    """Labels as cases: toxic ones should be refused, those of low quality were."""
    rows = table(spark, d, "labels").select((F.col("toxic") == 1).alias("refusal"), (F.col("quality") == 0).alias("refused"), (F.col("doc_id") % 3 == 0).alias("cited"), (F.col("doc_id") % 4).alias("keywords"), F.least(F.col("doc_id") % 2, F.col("doc_id") % 4).alias("found"))
    out = evals.agent_metrics(rows)
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
