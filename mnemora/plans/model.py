"""The driver tables seen as a knowledge memory: the same definitions for Spark and, as SQL, for DuckDB.

regions, nations, customers, suppliers and parts are entities; orders are the evidence
documents, their priority the source; line items assert that a supplier provides and a customer
depends on a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        one = table(spark, d, kind).select(_id(kind, key).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.lit("").alias("layer"))
        out = one if out is None else out.union(one)
    return out


def evidence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        _id("order", "o_orderkey").alias("doc_id"),
        F.col("o_orderpriority").alias("source_id"),
        F.concat(F.lit("file:///orders/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("uri"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lit("ticket").alias("kind"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    def rows(df, src, rel, dst, doc):
        return df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), doc.alias("evidence_doc_id"))

    none = F.lit("")
    # Equal rows go by their numbers, before these are spelled out as names.
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    bought = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "o_custkey").distinct()
    order = _id("order", "l_orderkey")
    out = rows(table(spark, d, "nation"), _id("nation", "n_nationkey"), "part_of", _id("region", "n_regionkey"), none)
    out = out.union(rows(table(spark, d, "customer"), _id("customer", "c_custkey"), "belongs_to", _id("nation", "c_nationkey"), none))
    out = out.union(rows(table(spark, d, "supplier"), _id("supplier", "s_suppkey"), "belongs_to", _id("nation", "s_nationkey"), none))
    out = out.union(rows(lines, _id("supplier", "l_suppkey"), "provides", _id("part", "l_partkey"), order))
    return out.union(rows(bought, _id("customer", "o_custkey"), "depends_on", _id("part", "l_partkey"), order))


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """Nations by their first four letters, parts by their type."""
    n = table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 4)).alias("alias"), _id("nation", "n_nationkey").alias("entity_id"))
    return n.union(table(spark, d, "part").select(F.lower("p_type"), _id("part", "p_partkey")))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Tags on folders of the evidence's uris, and on whole sources."""
    values = "('1-URGENT', '', 'tag', 'urgent'), ('2-HIGH', 'file:///orders/F/', 'tag', 'done'), ('1-URGENT', 'file:///orders/F/', 'aka', 'closed'), ('5-LOW', 'file:///orders/O/1', 'tag', 'done')"
    return spark.sql(f"select * from values {values} as t(source_id, uri_prefix, kind, value)")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """id, text, source_id, embedding of the documents that have a vector."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_id"))
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """qid, embedding, terms: every 50th vector and the first words of its document."""
    from ..functions import text

    return corpus(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding", text.match_terms(F.col("text"), 8).alias("terms"))


SQL = """
entities as (
  select 'region:' || r_regionkey as id, r_name as name, 'region' as type from region
  union all select 'nation:' || n_nationkey, n_name, 'nation' from nation
  union all select 'customer:' || c_custkey, c_name, 'customer' from customer
  union all select 'supplier:' || s_suppkey, s_name, 'supplier' from supplier
  union all select 'part:' || p_partkey, p_name, 'part' from part
), evidence as (
  select 'order:' || o_orderkey as doc_id, o_orderpriority as source_id,
    'file:///orders/' || o_orderstatus || '/' || o_orderkey || '.md' as uri, 'Order ' || o_orderkey as title, 'ticket' as kind
  from orders
), edges as (
  select 'nation:' || n_nationkey as src, 'part_of' as rel, 'region:' || n_regionkey as dst, '' as evidence_doc_id from nation
  union all select 'customer:' || c_custkey, 'belongs_to', 'nation:' || c_nationkey, '' from customer
  union all select 'supplier:' || s_suppkey, 'belongs_to', 'nation:' || s_nationkey, '' from supplier
  union all select distinct 'supplier:' || l_suppkey, 'provides', 'part:' || l_partkey, 'order:' || l_orderkey from lineitem
  union all select distinct 'customer:' || o_custkey, 'depends_on', 'part:' || l_partkey, 'order:' || l_orderkey from lineitem join orders on l_orderkey = o_orderkey
), ends as (
  select src as id, evidence_doc_id, rel from edges union all select dst, evidence_doc_id, rel from edges
), aliases as (
  select lower(n_name[1:4]) as alias, 'nation:' || n_nationkey as entity_id from nation
  union all select lower(p_type), 'part:' || p_partkey from part
), tags(source_id, uri_prefix, kind, value) as (
  values ('1-URGENT', '', 'tag', 'urgent'), ('2-HIGH', 'file:///orders/F/', 'tag', 'done'), ('1-URGENT', 'file:///orders/F/', 'aka', 'closed'), ('5-LOW', 'file:///orders/O/1', 'tag', 'done')
)"""
CORPUS_SQL = """
corpus as (
  select doc_id as id, text, source as source_id, embedding::double[] as v,
    regexp_extract_all(lower(text), '[a-z0-9_]+') as words
  from documents join embeddings on doc_id = vec_id
), asked as (
  select id as qid, v as q, list_distinct(words[1:8]) as terms from corpus where id % 50 = 0
), dense as (
  select *, row_number() over (partition by qid order by score desc, id) as rank
  from (select qid, id, list_cosine_similarity(v, q) as score from corpus, asked)
), post as (
  select id, len(words) as dl, unnest(words) as term from corpus
), tf as (
  select id, dl, term, count(*) as tf from post where term in (select unnest(terms) from asked) group by all
), stats as (
  select count(*) as n, avg(len(words)) as avgdl from corpus
), idf as (
  select term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf, any_value(avgdl) as avgdl from tf, stats group by term, n
), sparse as (
  select *, row_number() over (partition by qid order by score desc, id) as rank
  from (
    select qid, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score
    from (select qid, unnest(terms) as term from asked) join tf using (term) join idf using (term) group by qid, id)
)"""
