"""The backlog of refused questions: clusters, medoids, suggestions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embed

# Words of a question and the connectors that would likely learn its answer.
TERM_HINTS = {
    "octopus": ("deploy", "deployment", "deployed", "release", "rollback"),
    "jira": ("ticket", "sprint", "epic", "backlog", "issue", "story"),
    "confluence": ("wiki", "runbook", "doc", "docs", "documentation", "page"),
    "grafana": ("log", "logs", "error", "trace", "metric", "metrics", "alert"),
    "datadog": ("log", "logs", "error", "trace", "metric", "metrics", "alert"),
    "elastic": ("log", "logs", "error", "trace"),
    "azure_devops": ("pipeline", "build", "ci", "cd"),
    "git": ("repo", "repository", "code", "commit", "branch"),
    "github": ("pipeline", "build", "ci", "cd", "repo", "repository", "code", "commit", "branch"),
}


def words(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def suggested_connectors(query: Column) -> Column:
    has = words(query)
    named = F.array(*[F.when(F.arrays_overlap(has, F.array(*map(F.lit, terms))), name) for name, terms in TERM_HINTS.items()])
    return F.array_compact(named)


def clusters(gaps: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id, cluster_id (its earliest gap) of open gaps (id, query, query_hash, created_at).

    First fit against running means is sequential by definition; the backlog of one
    shard (column shard, if there) is one group. Gaps without text cluster by hash alone.
    """
    shard = F.col("shard") if "shard" in gaps.columns else F.lit(0)
    vectors = gaps.withColumn("shard", shard).withColumn("v", embed.hash_embed("query"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["created_at", "id"], kind="stable")
        heads, sums, counts, by_hash, out = [], [], [], {}, []
        for r in rows.itertuples():
            if not (r.query or "").strip():
                out.append(by_hash.setdefault(r.query_hash, r.id))
                continue
            v = np.asarray(r.v, float)
            near = np.array([])
            if heads:
                means = np.array(sums) / np.array(counts)[:, None]
                near = means @ v / np.maximum(np.linalg.norm(means, axis=1) * (np.linalg.norm(v) or 1), 1e-12)
            hit = np.flatnonzero(near >= threshold - 1e-9)
            if len(hit):
                k = hit[0]
                sums[k] = sums[k] + v
                counts[k] += 1
            else:
                k = len(heads)
                heads.append(r.id)
                sums.append(v)
                counts.append(1)
            out.append(heads[k])
        return pd.DataFrame({"id": rows["id"].tolist(), "cluster_id": out})

    kind = gaps.schema["id"].dataType.simpleString()
    return vectors.select("shard", "id", "query", "query_hash", "created_at", "v").groupBy("shard").applyInPandas(fit, f"id {kind}, cluster_id {kind}")


def medoids(members: DataFrame) -> DataFrame:
    """cluster_id, id: the member with the highest mean Jaccard similarity of words to the others, the first of equals.

    members: cluster_id, id, query, order. Pairs are made by shared words and only
    their counts are kept, so a cluster's members are not paired where they share nothing.
    """
    sized = members.select("cluster_id", "id", "order", words(F.col("query")).alias("w")).withColumn("n", F.size("w"))
    each = sized.select("cluster_id", "id", "n", F.explode("w").alias("t"))
    # Sum over others of |a and b| / |a or b|: pairs grouped by equal word sets would be cheaper still for copies.
    pair = each.alias("a").join(each.alias("b"), (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.id") != F.col("b.id")))
    both = pair.groupBy(F.col("a.cluster_id").alias("cluster_id"), F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count("*").alias("c"))
    scored = both.groupBy("cluster_id", "id").agg(F.sum(F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("s"))
    all_ = sized.join(scored, ["cluster_id", "id"], "left").withColumn("s", F.round(F.coalesce("s", F.lit(0.0)), 9))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("s"), "order", "id")
    return all_.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cluster_id", "id")


def records(gaps: DataFrame, placed: DataFrame) -> DataFrame:
    """cluster_id, label, count, samples, connectors, largest first."""
    members = gaps.join(placed, "id").withColumn("order", F.col("created_at"))
    told = members.where("trim(coalesce(query, '')) <> ''")
    label = medoids(told).join(gaps.select("id", "query"), "id").select("cluster_id", F.col("query").alias("label"))
    grouped = members.groupBy("cluster_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("created_at", "id", "query"))).alias("m"))
    said = F.filter(F.transform("m", lambda x: x["query"]), lambda q: F.trim(F.coalesce(q, F.lit(""))) != "")
    return grouped.join(label, "cluster_id", "left").select("cluster_id", F.coalesce("label", F.lit("(private refusals)")).alias("label"), "count", F.slice(said, 1, 3).alias("samples"), suggested_connectors(F.array_join(said, " ")).alias("connectors")).orderBy(F.desc("count"), "cluster_id")


def expand_queries(queries: DataFrame, names: DataFrame, generic: tuple[str, ...], most: int = 3, longest: int = 4) -> DataFrame:
    """qid, expanded: queries with the canonical names of the spoken forms in them; names: key (lower case), id, name.

    Windows of words are looked up by an equi-join; which of the overlapping finds count
    (longer first, then from the left, each position once) is settled per query.
    """
    tokens = F.regexp_extract_all(F.lower("query"), F.lit(r"[a-z0-9][a-z0-9.\-_]*"), F.lit(0))
    split = queries.select("qid", "query", tokens.alias("t"))
    windows = None
    for n in range(longest, 0, -1):
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(0), F.size("t") - n)).otherwise(F.array().cast("array<int>"))
        one = split.select("qid", F.lit(n).alias("n"), F.explode(starts).alias("at"), "t").select("qid", "n", "at", F.slice("t", F.col("at") + 1, n).alias("w"))
        told = one.where(~F.forall("w", lambda x: x.isin(*generic))).select("qid", "n", "at", F.array_join("w", " ").alias("key"))
        windows = told if windows is None else windows.union(told)
    found = windows.join(names, "key").groupBy("qid", "n", "at", "key").agg(F.min(F.struct("id", "name")).alias("e"))
    per_query = found.groupBy("qid").agg(F.collect_list(F.struct("n", "at", "key", "e.id", "e.name")).alias("f"))
    joined = queries.select("qid", "query").join(per_query, "qid", "left")

    @F.pandas_udf(queries.schema["query"].dataType)
    def settle(query: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for q, f in zip(query, found, strict=True):
            used, seen, added = set(), set(), []
            for x in sorted(f if f is not None else [], key=lambda x: (-x["n"], x["at"])):
                span = set(range(x["at"], x["at"] + x["n"]))
                if len(added) >= most or span & used:
                    continue
                used |= span
                if x["id"] not in seen:
                    seen.add(x["id"])
                    if x["name"].lower() != x["key"] and x["name"].lower() not in q.lower():
                        added.append(x["name"])
            out.append(" ".join([q, *added]))
        return pd.Series(out)

    return joined.select("qid", settle("query", "f").alias("expanded"))
