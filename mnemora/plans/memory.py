"""The engine's queries over the driver tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunk, classify, text
from ..operators import catalog, graph, retrieval, scope
from . import model
from .model import aliases, asked, corpus, edges, entities, evidence, labels, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VISIBLE = ("1-URGENT", "2-HIGH")


def query(sql: str | None = None, model_: str | None = None):
    """Registers a query by its function's name; sql may use the common tables of model_."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = {None: "", "graph": f"with {model.SQL}", "corpus": f"with {model.CORPUS_SQL}"}[model_]
            ORACLE_SQL[f.__name__] = f"{head}\n{sql}"
        return f

    return add


# --- retrieval ---------------------------------------------------------------


@query("select qid, id, round(score, 6) as score, rank from dense where rank <= 8", "corpus")
def dense_topk(spark, d):
    return retrieval.dense_topk(corpus(spark, d), asked(spark, d), 8).withColumn("score", F.round("score", 6))


@query("select qid, id, round(score, 6) as score, rank from sparse where rank <= 8", "corpus")
def bm25_topk(spark, d):
    return retrieval.bm25_topk(corpus(spark, d), asked(spark, d), 8).withColumn("score", F.round("score", 6))


_FUSED = """, fused as (
  select qid, id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) as fused, a.rank as r1, b.rank as r2
  from (select * from dense where rank <= 32) a full join (select * from sparse where rank <= 32) b using (qid, id)
), ordered as (
  select *, row_number() over (partition by qid order by fused desc, r1 nulls last, r2 nulls last, id) as rank from fused
)"""


@query(_FUSED + " select qid, id, round(fused, 9) as fused, rank from ordered", "corpus")
def rrf_fuse(spark, d):
    docs, q = corpus(spark, d), asked(spark, d)
    out = retrieval.rrf_fuse(retrieval.dense_topk(docs, q, 32), retrieval.bm25_topk(docs, q, 32))
    return out.select("qid", "id", F.round("fused", 9).alias("fused"), "rank")


_GATED = """, scored as (
  select o.qid, o.id, o.fused, o.rank, d.score from ordered o join dense d using (qid, id)
), gated as (
  select qid, id, score, fused, row_number() over (partition by qid order by rank) as rank from scored where score >= {least}
) select qid, id, round(score, 6) as score, round(fused, 9) as fused, rank from gated where rank <= 8"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("score", 6).alias("score"), F.round("fused", 9).alias("fused"), "rank")


@query(_FUSED + _GATED.format(least="-1"), "corpus")
def hybrid_search(spark, d):
    return _rounded(retrieval.hybrid_search(corpus(spark, d), asked(spark, d), 8, -1.0))


@query(_FUSED + _GATED.format(least="0.15"), "corpus")
def grounding_gate(spark, d):
    return _rounded(retrieval.hybrid_search(corpus(spark, d), asked(spark, d), 8, 0.15))


_SCOPED = (
    model.CORPUS_SQL.replace("\ncorpus as (", "\nevery_doc as (")
    .replace("from corpus where id % 50 = 0", "from every_doc where id % 50 = 0")
    .replace("), dense as (", "), corpus as (\n  select * from every_doc where source_id in ('src0', 'src1', 'src2', 'src5')\n), dense as (", 1)
)


@query(f"with {_SCOPED}" + _FUSED + _GATED.format(least="-1"))
def hybrid_search_scoped(spark, d):
    """All questions, over what a reader of four sources may see."""
    docs = corpus(spark, d)
    return _rounded(retrieval.hybrid_search(docs, asked(spark, d), 8, -1.0, scope=scope.Scope(visible=("src0", "src1", "src2", "src5"))))


@query()
def hybrid_search_reranked(spark, d):
    return _rounded(retrieval.hybrid_search(corpus(spark, d), asked(spark, d), 8, -1.0, rerank=16))


@query("select qid, id, round(score, 6) as score from (select * from sparse where rank <= 32) s(qid, id, s, rank) join dense d using (qid, id)", "corpus")
def sparse_rescore(spark, d):
    docs, q = corpus(spark, d), asked(spark, d)
    return retrieval.dense_scores(retrieval.bm25_topk(docs, q, 32).select("qid", "id"), docs, q).select("qid", "id", F.round("score", 6).alias("score"))


@query("select count(*) as n from documents where false")
def scope_empty_allowlist(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(scope.Scope(visible=()).predicate(F.col("source"), F.col("doc_id"))).agg(F.count("*").alias("n"))


@query("select doc_id, source from documents where (source = 'src1' or doc_id in (2, 7)) and source in ('src1', 'src2', 'src3')")
def scope_predicate(spark, d):
    s = scope.Scope(("src1",), (2, 7), ("src1", "src2", "src3"))
    return table(spark, d, "documents").where(s.predicate(F.col("source"), F.col("doc_id"))).select("doc_id", "source")


# --- text --------------------------------------------------------------------

_FOLD = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'), ' (\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(f"select doc_id, sha256({_FOLD}) as content_hash from documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(text.normalize_text(F.col("text"))).alias("content_hash"))


@query("select sha256(text) as h, min(doc_id) as first_id, count(*) as copies from documents group by 1 having count(*) > 1")
def content_hash_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(text.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@query("select doc_id, substr(sha256(source || '|file:///' || lang || '/' || doc_id || '.md'), 1, 24) as id from documents")
def doc_id_hash(spark, d):
    uri = F.concat(F.lit("file:///"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", text.doc_id(F.col("source"), uri).alias("id"))


@query("""select doc_id, source || case when trim(text[1:60]) <> '' and trim(text[1:60]) <> source then ' · ' || trim(text[1:60]) else '' end || ' · file:///' || source || '/' || doc_id || '.md' as crumb from documents""")
def breadcrumb(spark, d):
    uri = F.concat(F.lit("file:///"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", text.breadcrumb(F.col("source"), F.substring("text", 1, 60), uri).alias("crumb"))


@query("select doc_id, text as back from documents")
def context_prefix_round_trip(spark, d):
    crumb = text.breadcrumb(F.col("source"), F.col("lang"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.without_context(crumb, text.with_context(crumb, F.col("text"))).alias("back"))


@query("select o_orderkey, 'ORD-' || (o_orderkey % 100000) || ',CUST-' || o_custkey as keys from orders")
def ticket_keys(spark, d):
    o = table(spark, d, "orders")
    said = F.expr("concat('ORD-', o_orderkey % 100000, ' then UTF-8 and ', o_orderpriority, ', ORD-', o_orderkey % 100000, ' and CUST-', o_custkey, ' by SHA-256')")
    return o.select("o_orderkey", F.array_join(text.ticket_keys(said), ",").alias("keys"))


@query("select p_partkey, regexp_replace(lower(p_brand || '.' || p_type), '[^a-z0-9]+', '', 'g') as norm, lower(p_brand || '.' || p_type) in ('api.core') as generic from part")
def normalized_names(spark, d):
    name = F.concat("p_brand", F.lit("."), "p_type")
    return table(spark, d, "part").select("p_partkey", text.normalize_name(name).alias("norm"), text.all_generic(name).alias("generic"))


@query("""select p_partkey, case when len(p) < 2 then '' else array_to_string([x for x in [array_to_string(p[2:], ' '), case when array_to_string(p[2:], '.') <> array_to_string(p[2:], ' ') then array_to_string(p[2:], '.') else '' end, array_to_string(p, ' ')] if x <> ''], '|') end as forms
from (select p_partkey, [x for x in regexp_split_to_array(lower('Org.' || p_brand || '-' || p_size), '[.\\-_]') if x <> ''] as p from part)""")
def identifier_aliases(spark, d):
    name = F.concat(F.lit("Org."), "p_brand", F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.aliases(name), "|").alias("forms"))


@query("select doc_id, 'repo:' || source as entity from documents where doc_id % 2 = 0 union all select doc_id, 'source:' || source from documents where doc_id % 2 <> 0")
def source_entity(spark, d):
    source = F.concat(F.when(F.col("doc_id") % 2 == 0, "git:").otherwise("notes:"), "source")
    return table(spark, d, "documents").select("doc_id", text.source_entity(source)["id"].alias("entity"))


@query("select doc_id, array_to_string(list_distinct(list_sort(regexp_extract_all(lower(text), '[a-z0-9_]+')[1:32])), ' ') as terms from documents".replace("list_distinct(list_sort(", "list_sort(list_distinct("))
def match_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.match_terms(F.col("text"))), " ").alias("terms"))


@query("""select doc_id, i as chunk, trim(array_to_string(words[i * 52 + 1 : i * 52 + 60], chr(10)), ' ') as body from (
  select doc_id, words, unnest(generate_series(0, greatest(len(words) - 9, 0) // 52)) as i from (select doc_id, string_split(trim(text), ' ') as words from documents))""")
def chunk_code_lines(spark, d):
    """Every document as code with a word a line."""
    lines = F.regexp_replace(F.replace(F.trim("text"), F.lit("\n"), F.lit("\x01")), " ", "\n")
    out = table(spark, d, "documents").select("doc_id", F.posexplode(chunk.code_chunks(lines)).alias("chunk", "body"))
    return out.withColumn("body", F.replace("body", F.lit("\x01"), F.lit("\n")))


@query()
def chunk_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunk.chunks(F.col("text"), F.lit("doc"))).alias("chunk", "body"))


@query("select conv_id, sum(length(text)) // 4 as tokens from conversations group by 1")
def session_tokens(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("sum(length(text)) div 4").alias("tokens"))


@query("select conv_id, turn, substr(split_part(text, chr(10), 1), 1, 160) as line from conversations where role in ('user', 'assistant')")
def session_digest(spark, d):
    return table(spark, d, "conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", F.substring(F.substring_index("text", "\n", 1), 1, 160).alias("line"))


@query("""select conv_id, coalesce(max(case when role = 'user' and back >= 4 then turn end), -1) as split_turn from (
  select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) group by 1""")
def session_recent_split(spark, d):
    """The last user turn that leaves four turns or more after compression."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, d, "conversations").withColumn("back", F.row_number().over(w))
    return rows.groupBy("conv_id").agg(F.coalesce(F.max(F.when((F.col("role") == "user") & (F.col("back") >= 4), F.col("turn"))), F.lit(-1)).alias("split_turn"))


# --- classification ----------------------------------------------------------


@query("""select doc_id, case doc_id % 5 when 0 then 'meeting-notes' when 1 then 'authored-doc' when 2 then 'dependency-map' when 3 then 'personal-note' else 'generic' end as kind from documents""")
def evidence_class(spark, d):
    k = F.col("doc_id") % 5
    title = F.when(k == 0, "Jan 6, 2026").otherwise("Overview")
    uri = F.when(k == 1, "file:///x/README.md?ref=main").when(k == 2, "git://x::dependency-map").otherwise("file:///x/y.txt")
    source = F.when(k == 3, "notes:ana").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", classify.evidence_class(title, uri, source).alias("kind"))


_SCORES_SQL = "(values " + ", ".join(f"('{n}', {a}, {b}, {v})" for n, a, b, v in classify.score_table()) + ") as s(kind, docs, sources, score)"


@query(f"select g.src, g.rel, g.dst, doc_count, source_count, s.score from (select src, rel, dst, count(distinct evidence_doc_id) as doc_count, count(distinct source_id) as source_count from edges join evidence on doc_id = evidence_doc_id where evidence_doc_id <> '' group by all) g join {_SCORES_SQL} on s.kind = 'generic' and s.docs = least(doc_count, 3) and s.sources = least(source_count, 2)", "graph")
def edge_score(spark, d):
    c = graph.corroboration(edges(spark, d), evidence(spark, d))
    return c.withColumn("score", classify.edge_score(F.lit("generic"), F.col("doc_count"), F.col("source_count")))


@query("select p_partkey, case p_partkey % 4 when 0 then 'data' when 1 then 'test' when 2 then 'vendor' else null end as layer from part")
def architecture_layer(spark, d):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, "src/CustomerRepository.cs").when(k == 1, "Api.Tests/AccountController.cs").when(k == 2, "web/node_modules/x/index.js").otherwise("Pricing/QuoteCalculation.cs")
    return table(spark, d, "part").select("p_partkey", classify.layer(path).alias("layer"))


@query("select page_id, length(trim(html)) <= 1500 and (lower(html) like '%service unavailable%' or lower(html) like '%runtime error%' or lower(html) like '%internal server error%' or lower(html) like '%500 - %' or lower(html) like '%503 - %') as failed from pages")
def error_pages(spark, d):
    return table(spark, d, "pages").select("page_id", classify.is_error_page(F.col("html"), F.lit("")).alias("failed"))


@query("select doc_id, lang in ('en', 'de') and length(text) >= 400 as eligible from documents")
def mining_eligible(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.mining_eligible(F.col("lang"), F.col("text"), F.lit("x.md"), ("en", "de")).alias("eligible"))


# --- graph -------------------------------------------------------------------


@query("select id, count(*) as degree from ends group by 1", "graph")
def entity_degree(spark, d):
    return graph.degrees(edges(spark, d))


@query("select src, rel, dst, count(distinct evidence_doc_id) as doc_count, count(distinct source_id) as source_count from edges left join evidence on doc_id = evidence_doc_id where evidence_doc_id <> '' group by all", "graph")
def edge_corroboration(spark, d):
    return graph.corroboration(edges(spark, d), evidence(spark, d))


_VIEW = """(select e.*, s.name as src_name, s.type as src_type, t.name as dst_name, t.type as dst_type, d.title as evidence_title, d.source_id as evidence_source_id
  from edges e left join entities s on s.id = e.src left join entities t on t.id = e.dst left join evidence d on d.doc_id = e.evidence_doc_id)"""
_VIEW_COLUMNS = ("src", "rel", "dst", "evidence_doc_id", "src_name", "src_type", "dst_name", "dst_type", "evidence_title", "evidence_source_id")


@query(f"select {', '.join(_VIEW_COLUMNS)} from {_VIEW} where src = 'supplier:1' or dst = 'supplier:1'", "graph")
def graph_neighbors(spark, d):
    return graph.neighbors(edges(spark, d), entities(spark, d), evidence(spark, d), "supplier:1").select(*_VIEW_COLUMNS)


@query(f"select {', '.join(_VIEW_COLUMNS)} from {_VIEW} where rel = 'provides' and src_type = 'supplier' and dst_type = 'part' and (evidence_doc_id = '' or evidence_source_id in ('1-URGENT', '2-HIGH'))", "graph")
def graph_relations(spark, d):
    return graph.relations(edges(spark, d), entities(spark, d), evidence(spark, d), "provides", "supplier", "part", VISIBLE).select(*_VIEW_COLUMNS)


_SEEN = "(select e.* from edges e left join evidence d on d.doc_id = e.evidence_doc_id where e.evidence_doc_id = '' or d.source_id in ('1-URGENT', '2-HIGH'))"


@query("select (select count(*) from edges) as edges, (select count(*) from entities) as entities", "graph")
def graph_totals(spark, d):
    return graph.totals(edges(spark, d), entities(spark, d), evidence(spark, d))


@query(f"select (select count(*) from {_SEEN}) as edges, (select count(*) from (select src from {_SEEN} union select dst from {_SEEN})) as entities", "graph")
def graph_totals_visible(spark, d):
    return graph.totals(edges(spark, d), entities(spark, d), evidence(spark, d), VISIBLE)


@query("select n.id, e.name, e.type, count(distinct source_id) as source_count, count(*) as degree from ends n join evidence on doc_id = evidence_doc_id join entities e on e.id = n.id group by all having count(distinct source_id) > 1", "graph")
def bridge_entities(spark, d):
    return graph.bridge_entities(edges(spark, d), entities(spark, d), evidence(spark, d))


@query("select id, type, degree, rn from (select *, row_number() over (partition by type order by degree desc, id) as rn from (select id, count(*) as degree from ends group by 1) join entities using (id)) where rn <= 6", "graph")
def core_topk_per_type(spark, d):
    return graph.core(edges(spark, d), entities(spark, d), 6)


@query(""", types as (select count(distinct type) as n from edges join entities on id = src),
core as (select id from (select id, row_number() over (partition by type order by degree desc, id) as rn from (select id, count(*) as degree from ends group by 1) join entities using (id)) where rn <= (select greatest(6, 400 // n) from types)),
picked as (select src, rel, dst, evidence_doc_id, type as src_type, row_number() over (partition by src order by rel, dst, evidence_doc_id) as rn_src,
  row_number() over (partition by type order by src, rel, dst, evidence_doc_id) as rn_type from edges left join entities on id = src where src in (from core) and dst in (from core))
select src, rel, dst, evidence_doc_id from (select * from picked where rn_src <= (select greatest(3, 400 // (n * 2)) from types) and rn_type <= (select greatest(5, 400 // n) from types) order by src_type, rn_type limit 400)""", "graph")
def graph_snapshot(spark, d):
    return graph.snapshot(edges(spark, d), entities(spark, d), evidence(spark, d)).select("src", "rel", "dst", "evidence_doc_id")


@query(""", own as (select distinct id from ends where evidence_doc_id in ('order:1', 'order:2', 'order:3')),
cited as (select * from edges where evidence_doc_id <> '' and evidence_doc_id not in ('order:1', 'order:2', 'order:3') and (src in (from own) or dst in (from own)))
select evidence_doc_id as doc_id, rel, src, dst from (select *, row_number() over (partition by evidence_doc_id order by rel, dst, src) as rn from cited) where rn = 1""", "graph")
def graph_expand(spark, d):
    seeds = evidence(spark, d).where("doc_id in ('order:1', 'order:2', 'order:3')")
    return graph.expand(edges(spark, d), evidence(spark, d), seeds)


@query(""", both_ways as (select distinct src as a, dst as b from edges union select distinct dst, src from edges),
h1 as (select distinct b as id from both_ways where a = 'nation:3' and b <> 'nation:3'),
h2 as (select distinct b as id from both_ways where a in (from h1) and b <> 'nation:3' and b not in (from h1))
select 'nation:3' as id, 0 as hops union all select id, 1 from h1 union all select id, 2 from h2""", "graph")
def graph_path_hops(spark, d):
    return graph.hops(edges(spark, d), "nation:3", 2)


@query(""", both_ways as (select distinct src as a, rel, dst as b from edges union select distinct dst, rel, src from edges),
p1 as (select 1 as hops, ['supplier:1', b] as n, [rel] as r, b as z from both_ways where a = 'supplier:1'),
p2 as (select 2 as hops, list_append(n, b) as n, list_append(r, rel) as r, b as z from p1 join both_ways on a = z where z <> 'nation:5' and not list_contains(n, b)),
p3 as (select 3 as hops, list_append(n, b) as n, list_append(r, rel) as r, b as z from p2 join both_ways on a = z where z <> 'nation:5' and b = 'nation:5' and not list_contains(n, b))
select hops, array_to_string(n, ' > ') as nodes, array_to_string(r, ' > ') as rels from (from p1 union all from p2 union all from p3) where z = 'nation:5' order by hops, n, r limit 5""", "graph")
def graph_path_candidates(spark, d):
    out = graph.paths(edges(spark, d), "supplier:1", "nation:5", 3)
    return out.select("hops", F.array_join("nodes", " > ").alias("nodes"), F.array_join("rels", " > ").alias("rels"))


_WAY = "qualify row_number() over (partition by z order by n, r, k) <= 6"


@query(f""", told as (select distinct src, rel, dst, case when evidence_doc_id = '' then 'generic' when substr(evidence_doc_id, 7)::bigint % 3 = 0 then 'meeting-notes' when substr(evidence_doc_id, 7)::bigint % 3 = 1 then 'authored-doc' else 'generic' end as class from edges where src <> dst),
both_ways as (select src as a, rel, dst as b, class from told union select dst, rel, src, class from told),
l0 as (select 'nation:5' as id), l1 as (select id from l0 union select b from both_ways where a in (from l0)), l2 as (select id from l1 union select b from both_ways where a in (from l1)),
p1 as (select ['supplier:1', b] as n, [rel] as r, [class] as k, b as z from both_ways where a = 'supplier:1' and b in (from l2)),
w1 as (select * from p1 where z <> 'nation:5' {_WAY}),
p2 as (select list_append(n, b) as n, list_append(r, rel) as r, list_append(k, class) as k, b as z from w1 join both_ways on a = z where not list_contains(n, b) and b in (from l1)),
w2 as (select * from p2 where z <> 'nation:5' {_WAY}),
p3 as (select list_append(n, b) as n, list_append(r, rel) as r, list_append(k, class) as k, b as z from w2 join both_ways on a = z where not list_contains(n, b) and b in (from l0)),
arrived as (select len(r) as hops, n, r, k, list_sort(n[2:-2]) as inner_nodes, list_sort(list_distinct(r)) as related, list_sort(list_distinct(k)) as classes from (from p1 union all from p2 union all from p3) where z = 'nation:5'),
alone as (select * from arrived qualify row_number() over (partition by inner_nodes, related, classes order by hops, n, r, k) = 1)
select hops, array_to_string(n, ' > ') as nodes, array_to_string(r, ' > ') as rels, array_to_string(k, ' > ') as classes from alone order by alone.hops, n, r, k limit 6""", "graph")
def graph_different_paths(spark, d):
    """Orders play, by their numbers, meeting notes, written documents and others."""
    kind = F.expr("cast(substr(doc_id, 7) as bigint) % 3")
    docs = evidence(spark, d).withColumn("title", F.when(kind == 0, "Jan 6, 2026").otherwise("Overview")).withColumn("uri", F.when(kind == 1, "file:///x/README.md").otherwise("file:///x/y.txt"))
    out = graph.different_paths(edges(spark, d), docs, "supplier:1", "nation:5", 3, 6)
    return out.select("hops", *[F.array_join(c, " > ").alias(c) for c in ("nodes", "rels", "classes")])


@query("select id, name, type from entities where id not in (select id from ends where rel not in ('belongs_to', 'depends_on'))", "graph")
def orphan_entities(spark, d):
    """Entities that neither provide nor hold anything: what belongs or depends plays the part of bridges."""
    e = edges(spark, d).withColumn("rel", F.when(F.col("rel").isin("belongs_to", "depends_on"), "same_as").otherwise(F.col("rel")))
    return graph.orphans(entities(spark, d), e).select("id", "name", "type")


_PLAYED = """, played as (select case type when 'customer' then 'service' else 'repo' end as type, id, case when type = 'supplier' then 'Customer' || substr(name, 9) else name end as name from entities where type in ('customer', 'supplier')
), said as (select id, type, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as norm from played union select 'supplier:' || s_suppkey, 'repo', 'customer' || lpad((s_suppkey + 1)::varchar, 9, '0') from supplier
), sized as (select norm from said group by 1 having count(*) between 2 and 6)"""


@query(_PLAYED + " select a.id as src, b.id as dst, min(norm) as norm from said a join said b using (norm) where norm in (from sized) and a.id < b.id and a.type <> b.type group by 1, 2", "graph")
def same_as_bridges(spark, d):
    """Customers as services; suppliers as repos that carry a customer's name, and the next customer's as an alias."""
    e = entities(spark, d).where("type in ('customer', 'supplier')")
    named = e.select("id", F.expr("if(type = 'supplier', concat('Customer', substr(name, 9)), name)").alias("name"), F.expr("if(type = 'customer', 'service', 'repo')").alias("type"))
    spoken = table(spark, d, "supplier").select(F.expr("concat('customer ', lpad(s_suppkey + 1, 9, '0'))").alias("alias"), F.expr("concat('supplier:', s_suppkey)").alias("entity_id"))
    return graph.same_as(named, spoken)


@query(""", m as (select e.dst, d.source_id, lower(s.name) as key, min(s.name) as member from edges e join entities s on s.id = e.src join evidence d on d.doc_id = e.evidence_doc_id where e.rel = 'provides' group by 1, 2, 3),
sets as (select dst, source_id, array_to_string(list_sort(list(key)), ',') as keys, array_to_string(list_sort(list(member)), ',') as members from m group by 1, 2)
select dst, source_id as source, members from sets where dst in (select dst from sets group by 1 having count(*) >= 2 and count(distinct keys) >= 2)""", "graph")
def membership_by_source(spark, d):
    view = graph.relations(edges(spark, d), entities(spark, d), evidence(spark, d), "provides")
    return graph.membership_split(view).withColumn("members", F.array_join("members", ","))


@query("select needle, min(id) as id from (values ('PERU'), ('nation:4'), ('fran'), ('nobody')) q(needle) join (select id, id as k from entities union all select id, lower(name) from entities union all select entity_id, alias from aliases) on k = lower(needle) group by 1", "graph")
def resolve_entities(spark, d):
    names = spark.sql("select * from values ('PERU'), ('nation:4'), ('fran'), ('nobody') as t(needle)")
    return graph.resolve(entities(spark, d), aliases(spark, d), names)


@query("select id, name, type, (select count(*) from ends n where n.id = e.id) as degree from entities e where lower(name) like '%an%' or id in (select entity_id from aliases where alias like '%an%') order by degree desc, id limit 10", "graph")
def autocomplete_entities(spark, d):
    return graph.autocomplete(entities(spark, d), aliases(spark, d), edges(spark, d), "an")


@query(f"select id, name, type from entities where id in (select src from {_SEEN} union select dst from {_SEEN})", "graph")
def reachable_entities(spark, d):
    return graph.reachable(entities(spark, d), edges(spark, d), evidence(spark, d), VISIBLE).select("id", "name", "type")


# --- catalog -----------------------------------------------------------------


@query("select source, count(*) as documents from documents group by 1")
def sources_doc_count(spark, d):
    docs = table(spark, d, "documents")
    return catalog.counted(docs.select("source").distinct(), docs, "source", "documents")


@query("select count(*) as documents, coalesce(sum(n_chars // 1600 + 1), 0)::bigint as chunks, count(distinct source) as sources from documents")
def corpus_stats(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.expr("n_chars div 1600 + 1").alias("chunk_count"))
    return catalog.corpus_stats(docs)


@query("select distinct e.doc_id, t.kind as label_kind, t.value from evidence e join tags t on t.source_id = e.source_id and starts_with(e.uri, t.uri_prefix)", "graph")
def label_prefix_join(spark, d):
    return scope.with_labels(evidence(spark, d), labels(spark, d)).select("doc_id", "label_kind", "value")


@query("select distinct e.doc_id, t.value from evidence e join tags t on t.source_id = e.source_id and starts_with(e.uri, t.uri_prefix) where t.kind = 'aka' and substr(e.doc_id, 7)::bigint % 2 = 0", "graph")
def aka_terms(spark, d):
    """Of the orders of even numbers."""
    docs = evidence(spark, d)
    return scope.aka_terms(docs, labels(spark, d), docs.where("cast(substr(doc_id, 7) as bigint) % 2 = 0").select("doc_id"))


@query("select 'source' as kind, source_id as id from tags where kind = 'tag' and uri_prefix = '' and value in ('urgent', 'done') union select 'doc', doc_id from evidence e join tags t on t.source_id = e.source_id and t.uri_prefix <> '' and t.kind = 'tag' and t.value in ('urgent', 'done') and starts_with(e.uri, t.uri_prefix)", "graph")
def resolve_scope(spark, d):
    return scope.resolve_tags(evidence(spark, d), labels(spark, d), ("urgent", "done"))


@query("select c_custkey from customer where c_nationkey % 3 = 0 or c_mktsegment = 'BUILDING' or c_custkey % 7 = 0")
def scope_visibility(spark, d):
    c = table(spark, d, "customer")
    sources = c.select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, "me").otherwise("other").alias("owner"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("shared"))
    return scope.visible_sources(sources, "me").select("c_custkey")


@query("""select doc_id, case when doc_id % 4 = 0 then 'added' when doc_id % 4 = 1 then 'updated' when doc_id % 4 = 2 then 'graph_refreshed' else 'skipped' end as action from documents""")
def ingest_diff_actions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    k = F.col("doc_id") % 4
    stored = docs.where(k != 0).select("doc_id", F.when(k == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(k == 2, 5).otherwise(6).alias("graph_version"))
    return catalog.ingest_actions(stored, docs, 6)


@query("select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source from documents")
def upsert_document(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    changed = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"))
    return catalog.upsert(docs, changed.union(changed), ["doc_id"], F.col("source"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber >= 3)")
def pending_anti(spark, d):
    pending = table(spark, d, "orders").select("o_orderkey")
    gone = table(spark, d, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.without(pending, gone, ["o_orderkey"])


@query("select distinct id from ends where evidence_doc_id in (select doc_id from evidence where source_id = '5-LOW')", "graph")
def rehome_entities(spark, d):
    return catalog.entities_touched(edges(spark, d), evidence(spark, d).where("source_id = '5-LOW'"))


@query("select lower(p_brand) as name, p_size as version, count(distinct p_type) as n_referrers, min(p_type) as first_referrer from part group by 1, 2")
def dep_merge(spark, d):
    deps = table(spark, d, "part").select(F.lower("p_brand").alias("name"), F.col("p_size").alias("version"), "p_type")
    return deps.groupBy("name", "version").agg(F.size(F.collect_set("p_type")).cast("long").alias("n_referrers"), F.min("p_type").alias("first_referrer"))


@query("select id, round(max(score), 6) as score from dense where rank <= 32 group by 1", "corpus")
def brief_context_union(spark, d):
    hits = retrieval.dense_topk(corpus(spark, d), asked(spark, d), 32).join(corpus(spark, d).select("id", "text"), "id")
    return catalog.best_hits(hits.withColumnRenamed("id", "doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.round(F.max("score"), 6).alias("score"))


@query("select event_id, ts, event_type from events where ts >= timestamp '2024-01-15 00:00:00' - interval 90 minutes and ts < timestamp '2024-01-15 00:00:00' order by ts desc, event_id limit 50")
def live_log_window(spark, d):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp_ntz"))
    return e.where((F.col("t") >= now - F.expr("interval 90 minutes")) & (F.col("t") < now)).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "event_type")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling_extension(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""select user_id, min(ts) as first_ts, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as new from events)) group by user_id, s""")
def event_session_extension(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "n")
