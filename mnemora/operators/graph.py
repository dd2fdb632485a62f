"""The evidence graph: entities (id, name, type, layer), edges (src, rel, dst, evidence_doc_id, detail), documents.

Reads are joins and windows; path searches advance one frontier by one join a
hop, keep only the first arrival at each node, and stop at the hop limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from . import scope
from .lineage import cut

BRIDGE_TYPES = ("service", "repo", "project", "pipeline")
MIN_NAME, MAX_GROUP, MAX_BRANCH_GROUP = 5, 6, 8
#: Sources that are counted as bits of a long; more are counted as names.
SOURCES = 60


def edge_view(edges: DataFrame, entities: DataFrame, docs: DataFrame, visible: Sequence[str] | None = None) -> DataFrame:
    """Edges with the names and types of their ends and their evidence's title, uri, kind and source."""
    s = entities.select(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("type").alias("src_type"))
    t = entities.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    d = docs.select(F.col("doc_id").alias("evidence_doc_id"), F.col("title").alias("evidence_title"), F.col("uri").alias("evidence_uri"), F.col("kind").alias("evidence_kind"), F.col("source_id").alias("evidence_source_id"))
    out = edges.join(s, "src", "left").join(t, "dst", "left").join(d, "evidence_doc_id", "left")
    if visible is None:
        return out
    return out.where((F.col("evidence_doc_id") == "") | F.coalesce(scope.allowed(F.col("evidence_source_id"), visible), F.lit(False)))


def signed(edges: DataFrame, entities: DataFrame, as_type=F.col) -> DataFrame:
    """Edges with their ends' types, where the vocabulary allows these; as_type maps a column of types to the vocabulary's.

    Relations and types that no signature names go before anything is joined.
    """
    typed = lambda end, side: entities.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type")).where(as_type(f"{end}_type").isin(*{t for s in classify.SIGNATURES.values() for t in s[side]}))
    known = edges.where(F.col("rel").isin(*classify.SIGNATURES))
    return known.join(typed("src", 0), "src").join(typed("dst", 1), "dst").where(classify.signature_allows(as_type("src_type"), F.col("rel"), as_type("dst_type")))


def neighbors(edges: DataFrame, entities: DataFrame, docs: DataFrame, entity: str, visible=None) -> DataFrame:
    return edge_view(edges.where((F.col("src") == entity) | (F.col("dst") == entity)), entities, docs, visible)


def relations(edges: DataFrame, entities: DataFrame, docs: DataFrame, rel: str, src_type: str | None = None, dst_type: str | None = None, visible=None) -> DataFrame:
    out = edge_view(edges.where(F.col("rel") == rel), entities, docs, visible)
    if src_type:
        out = out.where(F.col("src_type") == src_type)
    return out.where(F.col("dst_type") == dst_type) if dst_type else out


def ends(edges: DataFrame) -> DataFrame:
    """id, evidence_doc_id: each edge once for either end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "evidence_doc_id")


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def corroboration(edges: DataFrame, docs: DataFrame, visible=None) -> DataFrame:
    """src, rel, dst, doc_count, source_count over edges that cite a document."""
    names = [r.source_id for r in docs.where("source_id is not null").select("source_id").distinct().limit(SOURCES + 1).collect()]
    if 0 < len(names) <= SOURCES:
        return _by_places(edges, docs, sorted(names), visible)
    cited = edges.where("evidence_doc_id <> ''").join(docs.select(F.col("doc_id").alias("evidence_doc_id"), "source_id"), "evidence_doc_id", "left")
    if visible is not None:
        cited = cited.where(F.coalesce(scope.allowed(F.col("source_id"), visible), F.lit(False)))
    # Two steps, so that no row is copied for each distinct count: documents of an edge's source, then its sources.
    per_source = cited.groupBy("src", "rel", "dst", "evidence_doc_id").agg(F.max("source_id").alias("source_id")).groupBy("src", "rel", "dst", "source_id").agg(F.count("*").alias("docs"))
    return per_source.groupBy("src", "rel", "dst").agg(F.sum("docs").alias("doc_count"), F.count("source_id").alias("source_count"))


def _by_places(edges: DataFrame, docs: DataFrame, names: list, visible) -> DataFrame:
    """corroboration() where all sources have a bit of a long: one exchange for an edge's documents and its sources.

    Edges meet documents by a hash beside the id, as names that begin alike are slow to sort by.
    """
    seen = docs if visible is None else docs.where(scope.allowed(F.col("source_id"), visible))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("source_id"))
    of_doc = seen.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("evidence_doc_id"), place.alias("place")).groupBy("h", "evidence_doc_id").agg(F.max("place").alias("place"))
    cited = edges.where("evidence_doc_id <> ''").select(F.xxhash64("evidence_doc_id").alias("h"), "evidence_doc_id", "src", "rel", "dst")
    each = cited.join(of_doc, ["h", "evidence_doc_id"], "left" if visible is None else "inner").distinct()
    bits = F.bit_or(F.expr("coalesce(shiftleft(1L, int(place)), 0L)"))
    return each.groupBy("src", "rel", "dst").agg(F.count("*").alias("doc_count"), F.bit_count(bits).cast("long").alias("source_count"))


def bridge_entities(edges: DataFrame, entities: DataFrame, docs: DataFrame, visible=None) -> DataFrame:
    """id, name, type, source_count, degree of entities with evidence from more than one source."""
    seen = docs.where(scope.allowed(F.col("source_id"), visible)) if visible is not None else docs
    touched = ends(edges).join(seen.select(F.col("doc_id").alias("evidence_doc_id"), "source_id"), "evidence_doc_id")
    # Two steps: the few sources of an entity are merged before they are counted.
    per_source = touched.groupBy("id", "source_id").agg(F.count("*").alias("n"))
    counted = per_source.groupBy("id").agg(F.count("source_id").alias("source_count"), F.sum("n").alias("degree")).where("source_count > 1")
    return counted.join(entities.select("id", "name", "type"), "id").select("id", "name", "type", "source_count", "degree")


def totals(edges: DataFrame, entities: DataFrame, docs: DataFrame, visible=None) -> DataFrame:
    """edges, entities: how large the graph is that a reader can see."""
    if visible is None:
        return edges.agg(F.count("*").alias("edges")).crossJoin(entities.agg(F.count("*").alias("entities")))  # one row each
    seen = scope.evidence_visible(edges, docs, visible)
    # Every edge is two ends, so one pass counts both.
    per_entity = ends(seen).groupBy("id").agg(F.count("*").alias("n"))
    return per_entity.agg(F.expr("coalesce(sum(n), 0) div 2").alias("edges"), F.count("*").alias("entities"))


def resolve(entities: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """needle, id: names (column needle) by id or name, else by alias; the first id of several."""
    n = names.select("needle", F.lower(F.trim("needle")).alias("key")).where("key <> ''")
    own = entities.select("id", F.explode(F.array_distinct(F.array("id", F.lower("name")))).alias("key"), F.lit(0).alias("way"))
    other = aliases.select(F.col("entity_id").alias("id"), F.lower(F.trim("alias")).alias("key"), F.lit(1).alias("way"))
    return n.join(own.union(other), "key").groupBy("needle").agg(F.min(F.struct("way", "id")).alias("f")).select("needle", F.col("f.id").alias("id"))


def reachable(entities: DataFrame, edges: DataFrame, docs: DataFrame, visible) -> DataFrame:
    """Entities with an edge the reader can see."""
    return entities.join(ends(scope.evidence_visible(edges, docs, visible)).select("id").distinct(), "id", "left_semi")


def autocomplete(entities: DataFrame, aliases: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Entities whose name or an alias holds the query, best connected first."""
    needle = query.strip().lower()
    by_alias = aliases.where(F.contains(F.lower("alias"), F.lit(needle))).select(F.col("entity_id").alias("id"))
    by_name = entities.where(F.contains(F.lower("name"), F.lit(needle))).select("id")
    found = entities.join(by_name.union(by_alias).distinct(), "id", "left_semi")
    return found.join(degrees(edges), "id", "left").select("id", "name", "type", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(limit)


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no edge other than a same_as bridge touches."""
    return entities.join(ends(edges.where("rel <> 'same_as'")).select("id").distinct(), "id", "left_anti")


def collect_orphans(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) without orphans and the bridges that would dangle."""
    kept = entities.join(orphans(entities, edges).select("id"), "id", "left_anti")
    ids = kept.select("id")
    bridges = edges.where("rel = 'same_as'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, edges.where("rel <> 'same_as'").unionByName(bridges)


def core(edges: DataFrame, entities: DataFrame, per_type: int) -> DataFrame:
    """id, type, degree, rn: the best connected entities of each type."""
    w = Window.partitionBy("type").orderBy(F.desc("degree"), "id")
    return degrees(edges).join(entities.select("id", "type"), "id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_type)


def snapshot(edges: DataFrame, entities: DataFrame, docs: DataFrame, limit: int = 400, visible=None) -> DataFrame:
    """Edges within the connected core, capped per source entity and per type, at most `limit`.

    Degrees are counted once and stored; the core, a few rows for each type, is
    broadcast; an entity's edges are capped before they are joined with anything, and a type's
    first edges are taken per entity before they meet.
    """
    typed = cut(degrees(edges).join(entities.select("id", "type"), "id"))
    types = edges.select(F.col("src").alias("id")).distinct().join(typed.select("id", "type"), "id").agg(F.count_distinct("type")).first()[0] or 1
    top = Window.partitionBy("type").orderBy(F.desc("degree"), "id")
    ids = typed.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= max(6, limit // types)).select("id", "type")
    src_cap, type_cap = max(3, limit // (types * 2)), max(5, limit // types)
    src = F.broadcast(ids.select(F.col("id").alias("src"), F.col("type").alias("core_type")))  # max(6, limit / types) a type
    dst = F.broadcast(ids.select(F.col("id").alias("dst")))
    inside = scope.evidence_visible(edges, docs, visible).join(src, "src").join(dst, "dst", "left_semi")
    by_src = Window.partitionBy("src").orderBy("rel", "dst", "evidence_doc_id")
    by_type = Window.partitionBy("core_type").orderBy("src", "rel", "dst", "evidence_doc_id")
    # Of a type's first edges an entity gives no more than src_cap, so the others go before the types meet.
    capped = inside.withColumn("rn_src", F.row_number().over(by_src)).where(F.col("rn_src") <= type_cap)
    picked = capped.withColumn("rn_type", F.row_number().over(by_type)).where((F.col("rn_src") <= src_cap) & (F.col("rn_type") <= type_cap))
    return edge_view(picked.orderBy("core_type", "rn_type").limit(limit).drop("core_type", "rn_src"), entities, docs)


def snapshot_totals(shown: DataFrame, edges: DataFrame, entities: DataFrame, docs: DataFrame, visible=None) -> DataFrame:
    """shown, edges, entities, truncated: whether a snapshot leaves anything out."""
    return totals(edges, entities, docs, visible).crossJoin(shown.agg(F.count("*").alias("shown"))).withColumn("truncated", F.col("shown") < F.col("edges"))  # one row each


def evidence_titles(edges: DataFrame, docs: DataFrame, ids: DataFrame, most: int = 3, visible=None) -> DataFrame:
    """id, title, kind: the first `most` distinct documents behind the edges of each entity (column id), by title."""
    seen = docs if visible is None else docs.where(scope.allowed(F.col("source_id"), visible))
    told = edges.where("evidence_doc_id <> ''").join(seen.select(F.col("doc_id").alias("evidence_doc_id"), "title", "kind"), "evidence_doc_id")
    # An entity once for each document, where edges and documents meet; then what a task cannot rule out, by a hash beside the id, as ids begin alike.
    each = told.select("evidence_doc_id", F.explode(F.array("src", "dst")).alias("id"), "title", "kind").distinct().select(F.xxhash64("id").alias("h"), "id", "title", "kind")
    n = F.dense_rank().over(Window.partitionBy("h", "id").orderBy("title", "kind"))
    first = each.withColumn("n", n).where(F.col("n") <= most).select("h", "id", "title", "kind").distinct().drop("h")
    return first.join(ids.select("id"), "id", "left_semi")


def expand(edges: DataFrame, docs: DataFrame, seeds: DataFrame, limit: int | None = None, visible=None) -> DataFrame:
    """doc_id, rel, src, dst: documents one hop from the seed documents (column doc_id), over same_as bridges too; the first edge of each."""
    s = seeds.select(F.col("doc_id").alias("evidence_doc_id")).distinct()
    own = ends(edges.join(s, "evidence_doc_id", "left_semi")).select("id").distinct()
    bridge = edges.where("rel = 'same_as'")
    partners = bridge.select("src", "dst").union(bridge.select("dst", "src")).toDF("id", "other").join(own, "id", "left_semi").select(F.col("other").alias("id"))
    ids = own.union(partners).distinct()
    cited = scope.evidence_visible(edges, docs, visible).where("evidence_doc_id <> ''").join(s, "evidence_doc_id", "left_anti")
    at_src = cited.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    at_dst = cited.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    first = at_src.unionByName(at_dst).groupBy("evidence_doc_id").agg(F.min(F.struct("rel", "dst", "src")).alias("e"))
    out = first.select(F.col("evidence_doc_id").alias("doc_id"), "e.rel", "e.src", "e.dst")
    return out.orderBy("rel", "dst", "doc_id").limit(limit) if limit else out


def hops(edges: DataFrame, start: str, max_hops: int = 3) -> DataFrame:
    """id, hops: the fewest undirected edges from `start` to every entity within the limit."""
    one = cut(edges.select("src", "dst").distinct())
    both = one.toDF("id", "to").union(one.select("dst", "src"))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    frontier = seen
    for n in range(1, max_hops + 1):
        step = both.join(_few(frontier.select("id")), "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = step.withColumn("hops", F.lit(n))
        frontier = cut(frontier)
        seen = seen.union(frontier)
    return seen


#: Rows of a frontier that are broadcast, so that the edges need not be moved for it.
FRONTIER = 100_000


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast where they are few; they are stored, or cheap."""
    return F.broadcast(rows) if rows.limit(FRONTIER + 1).count() <= FRONTIER else rows


def paths(edges: DataFrame, start: str, end: str, max_hops: int = 3, most: int = 5) -> DataFrame:
    """hops, nodes, rels: up to `most` simple undirected paths with different relations or nodes, shortest first.

    Only nodes that can still reach the end in the hops left are followed.
    """
    one = cut(edges.select("src", "rel", "dst").distinct())
    both = one.toDF("at", "rel", "to").union(one.select("dst", "rel", "src"))
    left = hops(one, end, max_hops).withColumnRenamed("id", "to").withColumnRenamed("hops", "left")
    spark = edges.sparkSession
    walk = spark.createDataFrame([(start, [start], [])], "at string, nodes array<string>, rels array<string>")
    found = None
    for n in range(1, max_hops + 1):
        step = both.join(_few(walk), "at").where(~F.array_contains("nodes", F.col("to"))).join(left.where(F.col("left") <= max_hops - n), "to")
        walk = cut(step.select(F.col("to").alias("at"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels")).distinct())
        arrived = walk.where(F.col("at") == end).select(F.lit(n).alias("hops"), "nodes", "rels")
        found = arrived if found is None else found.union(arrived)
        walk = walk.where(F.col("at") != end)
    return found.orderBy("hops", "nodes", "rels").limit(most)


def different_paths(edges: DataFrame, docs: DataFrame, start: str, end: str, max_hops: int = 3, most: int = 3, budget: int = 20_000) -> DataFrame:
    """hops, nodes, rels, classes: up to `most` materially different simple undirected paths, shortest first, of equals by nodes, rels and classes.

    Paths are the same where their inner nodes, their relations and their classes of evidence (see
    classify.evidence_class) are equal as sets. The search goes from both ends: nodes that the end reaches in fewer
    hops than max_hops are found first, and only edges between them are walked. After each hop a node is
    kept by its first `most` ways, and of all ways the `budget` that are nearest to the end, so a hub costs no more than
    any other node. A shortest path is never cut by that: its nodes are first reached on it, and no other way is
    nearer to the end. `start` and `end` alike: none.
    """
    spark = edges.sparkSession
    shape = "hops int, nodes array<string>, rels array<string>, classes array<string>"
    if start == end or max_hops < 1:
        return spark.createDataFrame([], shape)
    left = hops(edges, end, max_hops - 1).withColumnRenamed("id", "to").withColumnRenamed("hops", "left")
    ids = left.select("to").union(spark.createDataFrame([(start,)], "to string")).distinct()
    near = edges.select("src", "rel", "dst", "evidence_doc_id").where("src <> dst")
    ids = _few(cut(ids))
    for side in ("src", "dst"):
        near = near.join(ids.withColumnRenamed("to", side), side, "left_semi")
    cited = docs.select(F.col("doc_id").alias("evidence_doc_id"), classify.evidence_class(F.col("title"), F.col("uri"), F.col("source_id")).alias("class"))
    told = near.join(cited, "evidence_doc_id", "left").select("src", "rel", "dst", F.coalesce("class", F.lit("generic")).alias("class"))
    both = cut(told.union(told.select("dst", "rel", "src", "class")).toDF("at", "rel", "to", "class").distinct())
    way = F.struct("nodes", "rels", "classes")
    walk, found = spark.createDataFrame([(start, [start], [], [])], "at string, nodes array<string>, rels array<string>, classes array<string>"), []
    for n in range(1, max_hops + 1):
        step = both.join(_few(walk), "at").where(~F.array_contains("nodes", F.col("to"))).join(left.where(F.col("left") <= max_hops - n), "to")
        gone = step.select(F.col("to").alias("at"), "left", F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("classes", F.col("class")).alias("classes"))
        found.append(gone.where(F.col("at") == end).select(F.lit(n).alias("hops"), "nodes", "rels", "classes"))
        if n < max_hops:
            first = Window.partitionBy("at").orderBy(way)
            kept = gone.where(F.col("at") != end).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most)
            walk = cut(kept.orderBy("left", way).limit(budget).drop("left", "rn"))
    arrived = reduce(DataFrame.union, found)
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    signature = (F.array_sort(F.slice("nodes", 2, F.col("hops") - 1)).alias("inner"), as_set("rels").alias("related"), as_set("classes").alias("told"))
    alone = arrived.groupBy(*signature).agg(F.min(F.struct("hops", "nodes", "rels", "classes")).alias("p"))
    return alone.select("p.*").orderBy("hops", "nodes", "rels", "classes").limit(most)


def names_of(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """norm, id, type: the telling names and aliases of entities that bridges may join."""
    kept = entities.where(F.col("type").isin(*BRIDGE_TYPES)).select("id", "name", "type")
    named = kept.select("id", "type", F.col("name").alias("said")).union(kept.join(aliases.select(F.col("entity_id").alias("id"), "alias"), "id").select("id", "type", "alias"))
    return named.withColumn("norm", text.normalize_name(F.col("said"))).where((F.length("norm") >= MIN_NAME) & ~text.all_generic(F.col("said"))).select("norm", "id", "type").distinct()


def same_as(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """src, dst, norm: bridges between entities of different types that share a telling name; groups of 2 to MAX_GROUP only."""
    return _bridged(names_of(entities, aliases))


def _bridged(members: DataFrame) -> DataFrame:
    # A group is bounded by MAX_GROUP before its members meet.
    sized = members.groupBy("norm").agg(F.count("*").alias("n")).where(F.col("n").between(2, MAX_GROUP)).select("norm")
    small = members.join(sized, "norm").groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("id", "type"))).alias("m"))
    pairs = small.select("norm", F.explode("m").alias("a"), "m").select("norm", "a", F.explode("m").alias("b")).where("a.id < b.id and a.type <> b.type")
    return pairs.groupBy(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).agg(F.min("norm").alias("norm"))


def refreshed_bridges(entities: DataFrame, aliases: DataFrame, former: DataFrame, spoken: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, bridges) after some entities arrived, changed or went: bridges (src, dst, detail) that begin at ids are to be replaced by these; all others stand.

    entities and aliases: all, as they are now; changed: id; former: id, name, type that changed ones had; spoken: their
    aliases (alias, entity_id), those that went included. A bridge can change only where a changed entity has or had
    the name it rests on, so only such names' entities are looked at, and of branches the families that a
    changed repository's or branch's names reach. Equal to same_as and branch_bridges over everything.
    """
    now = entities.join(changed, "id", "left_semi").select("id", "name", "type")
    was = cut(former.select("id", "name", "type").unionByName(now).distinct())
    said = was.select("id", "type", F.col("name").alias("said")).union(was.join(spoken.select(F.col("entity_id").alias("id"), "alias"), "id").select("id", "type", "alias"))
    norms = cut(said.select("type", text.normalize_name(F.col("said")).alias("norm")).where("norm <> ''").distinct())
    members = names_of(entities, aliases)
    ids = cut(changed.select("id").union(members.join(norms.select("norm"), "norm", "left_semi").select("id")).distinct())
    theirs = members.join(ids, "id", "left_semi").select("norm").distinct()
    bridges = _bridged(members.join(theirs, "norm", "left_semi")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", F.col("norm").alias("detail"))
    if was.where("type in ('repo', 'branch')").isEmpty():
        return ids, bridges
    repo = text.normalize_name(F.expr("substring_index(substr(id, 8), '/', 1)"))
    branches = entities.where("type = 'branch' and startswith(id, 'branch:')").withColumn("norm", repo)
    repos = entities.where("type = 'repo'").select("id", F.col("name").alias("said"))
    spelled = cut(repos.union(repos.join(aliases.select(F.col("entity_id").alias("id"), "alias"), "id").select("id", "alias")).select("id", text.normalize_name(F.col("said")).alias("norm")).where("norm <> ''").distinct())
    reached = cut(norms.where("type = 'repo'").select("norm").union(was.where("type = 'branch' and startswith(id, 'branch:')").select(repo.alias("norm"))).distinct())
    for _ in range(60):
        grown = cut(reached.union(spelled.join(spelled.join(reached, "norm", "left_semi").select("id").distinct(), "id", "left_semi").select("norm")).distinct())
        done = grown.join(reached, "norm", "left_anti").isEmpty()
        reached = grown
        if done:
            break
    else:
        raise RuntimeError("the families of branches are not found after 60 rounds")
    family = cut(branches.join(reached, "norm", "left_semi").select("id", "name", "type"))
    owners = entities.where("type = 'repo'").join(spelled.join(reached, "norm", "left_semi").select("id").distinct(), "id", "left_semi").select("id", "name", "type")
    linked = branch_bridges(family.unionByName(owners), aliases).select("src", "dst", F.col("branch").alias("detail"))
    return ids.union(family.select("id")).distinct(), bridges.unionByName(linked)


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after arrivals (id, name, type, layer, seq, and perhaps source_id and private), in the order of seq.

    Name: a materially different one replaces the former; of spellings that differ only in case, the first with a
    capital stays. Type: the last. Layer: one of production over test over vendor over none, the
    first of equals. The source is that of the first arrival. Arrivals from a private source add entities
    but never rename or relabel one. Every step is an aggregation with map-side combine, so an entity
    that all documents name is no one task's rows.
    """
    columns = ["id", "name", "type", "source_id", "layer"]
    had = old.columns
    with_source = lambda df: df if "source_id" in df.columns else df.withColumn("source_id", F.lit(""))
    base = with_source(old).select(*columns, F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("private"))
    arrived = with_source(new).select(*columns, F.col("seq").cast("long").alias("seq"), (F.col("private") if "private" in new.columns else F.lit(False)).alias("private"))
    rows = base.unionByName(arrived).withColumn("layer", F.coalesce("layer", F.lit("")))
    order = F.struct("seq", "name", "type", "layer")
    first = rows.groupBy("id").agg(F.min(order).alias("f"), F.min_by("source_id", order).alias("source_id"))
    # The first arrival counts whatever its source; of the others only the public ones.
    counted = rows.join(first.select("id", "f"), "id").where(~F.col("private") | (order == F.col("f"))).drop("f")
    last = counted.groupBy("id").agg(F.max(order).alias("last"))
    spelling = counted.groupBy("id", F.lower("name").alias("low")).agg(F.max("seq").alias("until"))
    final = last.select("id", F.lower("last.name").alias("low"), F.col("last.type").alias("type"))
    former = spelling.join(final.withColumnRenamed("low", "own"), "id").where("low <> own").groupBy("id").agg(F.max("until").alias("since"))
    run = counted.join(final.drop("type"), "id").where(F.lower("name") == F.col("low")).join(former, "id", "left").where(F.col("seq") > F.coalesce("since", F.lit(-2)))
    named = run.groupBy("id").agg(F.coalesce(F.min_by("name", F.when(F.col("name") != F.lower("name"), F.struct("seq", "name"))), F.min("low")).alias("name"))
    production = F.when(~F.col("layer").isin("", "test", "vendor"), F.struct("seq", "layer"))
    layered = counted.groupBy("id").agg(F.min_by("layer", production).alias("own"), F.max((F.col("layer") == "test").cast("int")).alias("test"), F.max((F.col("layer") == "vendor").cast("int")).alias("vendor"))
    layer = F.coalesce("own", F.when(F.col("test") == 1, "test"), F.when(F.col("vendor") == 1, "vendor"), F.lit(""))
    out = final.drop("low").join(named, "id").join(layered.select("id", layer.alias("layer")), "id").join(first.select("id", "source_id"), "id")
    return out.select(*[c for c in (had if set(had) <= set(columns) else columns)])


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """alias (trimmed, lower case), entity_id of both, each once."""
    clean = lambda df: df.select(F.lower(F.trim("alias")).alias("alias"), "entity_id")
    return clean(old).union(clean(new)).where("alias <> ''").distinct()


def replace_edges(old: DataFrame, new: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges after documents (column evidence_doc_id) restated theirs."""
    return old.join(evidence.select("evidence_doc_id").distinct(), "evidence_doc_id", "left_anti").unionByName(new.dropDuplicates(["src", "rel", "dst", "evidence_doc_id"]))


def membership_split(view: DataFrame) -> DataFrame:
    """dst, source, members: groups whose sources list different members (compared by folded name)."""
    named = view.where("coalesce(trim(evidence_source_id), '') <> ''").select("dst", F.trim("evidence_source_id").alias("source_id"), F.coalesce("src_name", "src").alias("member"))
    folded = named.withColumn("key", text.fold_member(F.col("member"))).groupBy("dst", "source_id", "key").agg(F.min("member").alias("member"))
    sets = folded.groupBy("dst", "source_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_list("member")).alias("members"))
    split = sets.groupBy("dst").agg(F.count("*").alias("n"), F.count_distinct("keys").alias("k")).where("n >= 2 and k >= 2")
    return sets.join(split.select("dst"), "dst").select("dst", text.source_label(F.col("source_id")).alias("source"), "members")


#: Types within which one name may stand for another, and how alike names must be.
RESOLVABLE, CANDIDATE_FLOOR, MERGE_CUTOFF, MOST_CANDIDATES = ("person", "team", "service"), 0.55, 0.90, 5


def candidates(entities: DataFrame, others: DataFrame | None = None, least: float = CANDIDATE_FLOOR, most: int = MOST_CANDIDATES, types: tuple[str, ...] = RESOLVABLE, embedder=None) -> DataFrame:
    """id, other, score: the `most` likeliest of the others (id, type, name) of each entity's type, by the cosine of their names' vectors.

    Every pair of a type is scored, in blocks of entities against the others, and `most` are kept in each task.
    Without others, entities are compared with those of smaller id.
    """
    from ..functions import embed
    from . import retrieval

    model, out = embedder or embed.Embedder(), None
    pool = entities if others is None else others
    for kind in types:
        asked = cut(model.passages(entities.where(F.col("type") == kind).select("id", "name"), "name").withColumn("qid", F.monotonically_increasing_id()))
        known = cut(model.passages(pool.where(F.col("type") == kind).select("id", "name"), "name").withColumn("row", F.monotonically_increasing_id()))
        # An entity is its own nearest, and larger ids are left out: where there are no others more must be kept.
        near = retrieval.dense_topk(known.select(F.col("row").alias("id"), "embedding"), asked, most + 1 if others is not None else 4 * most).select("qid", F.col("id").alias("row"), "score")
        named = near.join(asked.select("qid", "id"), "qid").join(known.select("row", F.col("id").alias("other")), "row")
        kept = named.where((F.col("score") >= least - 1e-9) & (F.col("id") != F.col("other")))
        if others is None:
            kept = kept.where("other < id")
        out = kept if out is None else out.union(kept)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("id", "other", "score")


#: Random planes of a signature's band, and bands: two names of a cosine of MERGE_CUTOFF (26 degrees) share a band with a probability of 0.9998.
PLANES, BANDS = 8, 24


def near_names(entities: DataFrame, others: DataFrame, least: float = MERGE_CUTOFF, types: tuple[str, ...] = RESOLVABLE, embedder=None, bands: int = BANDS) -> DataFrame:
    """id, other, score: others (id, type, name) whose names' vectors have a cosine of `least` or more with an entity's of the same type.

    Names that share a band of their signatures are compared, so the work follows the likely pairs, not all of a
    type. Ids of one name are taken once: the smallest of the others stands for all, and an entity's ids share its name's answer.
    """
    from ..functions import embed
    from . import retrieval

    model = embedder or embed.Embedder()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = retrieval.vectors_of(batch.column(2), len(batch.column(2)[0]))
            planes = np.random.default_rng(7).standard_normal((v.shape[1], bands * PLANES))
            bits = ((v @ planes) > 0).reshape(len(v), bands, PLANES)
            sign = (bits * (1 << np.arange(PLANES))).sum(2) + (np.arange(bands) << PLANES)
            there = np.flatnonzero(np.abs(v).sum(1) > 0)  # a name without a word is like no other
            rows = batch.take(pa.array(there))
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], rows.column(2).cast(pa.list_(pa.float64())), pa.array(sign[there].tolist(), pa.list_(pa.int64()))], names=["type", "name", "v", "signs"])

    def names(df: DataFrame) -> DataFrame:
        known = df.where(F.col("type").isin(*types) & F.col("name").isNotNull()).select("type", "name").distinct()
        vectors = model.passages(known, "name").select("type", "name", F.col("embedding").cast("array<double>").alias("embedding"))
        return cut(vectors.mapInArrow(signed, "type string, name string, v array<double>, signs array<long>"))

    a, b = names(entities), names(others)
    left = a.select("type", "name", F.explode("signs").alias("sign"))
    right = b.select("type", F.col("name").alias("other_name"), F.explode("signs").alias("sign"))
    pairs = left.join(right, ["type", "sign"]).select("type", "name", "other_name").distinct()
    both = pairs.join(a.drop("signs"), ["type", "name"]).join(b.select("type", F.col("name").alias("other_name"), F.col("v").alias("w")), ["type", "other_name"])
    scored = both.withColumn("score", embed.cosine(F.col("v"), F.col("w"))).where(F.col("score") >= least - 1e-9).select("type", "name", "other_name", "score")
    standing = others.where(F.col("type").isin(*types)).groupBy("type", F.col("name").alias("other_name")).agg(F.min("id").alias("other"))
    return entities.select("id", "type", "name").join(scored, ["type", "name"]).join(standing, ["type", "other_name"]).where("id <> other").select("id", "other", "score")


def resolutions(new: DataFrame, old: DataFrame, adjudicator=None, evidence: DataFrame | None = None, embedder=None) -> DataFrame:
    """id, canonical: new entities (id, name, type, and perhaps context) that are entities of old under another name.

    adjudicator, the seam for a model, is a function of (type, name, candidate names, context, candidate contexts) to
    the matching name or None, called in the workers; where it fails nothing is merged. Without
    one, the likeliest is taken from a cosine of MERGE_CUTOFF on. evidence: id, title, kind.
    """
    fresh = new.where(F.col("type").isin(*RESOLVABLE)).join(old.select("id"), "id", "left_anti")
    if adjudicator is None:
        best = F.struct((-F.round("score", 9)).alias("s"), F.col("other").alias("canonical"))
        near = near_names(fresh.select("id", "name", "type"), old.select("id", "name", "type"), embedder=embedder)
        return near.groupBy("id").agg(F.min(best).alias("b")).select("id", "b.canonical")
    pairs = candidates(fresh.select("id", "name", "type"), old.select("id", "name", "type"), embedder=embedder)
    said = F.concat(F.lit('"'), "title", F.lit('" ('), "kind", F.lit(")"))
    told = evidence.groupBy(F.col("id").alias("other")).agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("context")) if evidence is not None else old.limit(0).select(F.col("id").alias("other"), F.lit("").alias("context"))
    named = pairs.join(old.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other").join(told, "other", "left")
    offer = F.struct((-F.col("score")).alias("s"), "other", "other_name", F.coalesce("context", F.lit("")).alias("context"))
    grouped = named.groupBy("id").agg(F.array_sort(F.collect_list(offer)).alias("offers"))  # MOST_CANDIDATES at most
    own = fresh.select("id", "name", "type", (F.coalesce("context", F.lit("")) if "context" in fresh.columns else F.lit("")).alias("said"))

    @F.pandas_udf("string")
    def chosen(kind: pd.Series, name: pd.Series, context: pd.Series, offers: pd.Series) -> pd.Series:
        def pick(t, n, c, found):
            try:
                match = adjudicator(t, n, [o["other_name"] for o in found], c, [o["context"] for o in found])
            except Exception:  # no answer: nothing is merged
                return None
            return next((o["other"] for o in found if match and o["other_name"].lower() == match.strip().lower()), None)

        return pd.Series([pick(*row) for row in zip(kind, name, context, offers, strict=True)], dtype=object)

    return own.join(grouped, "id").select("id", chosen("type", "name", "said", "offers").alias("canonical")).where("canonical is not null")


def guarded(entities: DataFrame, aliases: DataFrame, edges: DataFrame, old: DataFrame, private_sources: DataFrame, adjudicator=None, embedder=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, edges) of documents, as they may be written (columns source_id and, of entities, seq).

    Names of public sources are resolved: a merged entity becomes an alias of its canonical one, and edges follow.
    A private source (column source_id) may attach edges to any entity, but resolves nothing, renames nothing
    (its entities are marked private) and gives aliases only to entities of its own.
    """
    mark = private_sources.select("source_id", F.lit(True).alias("private")).distinct()
    flagged = lambda df: df.join(F.broadcast(mark), "source_id", "left").withColumn("private", F.coalesce("private", F.lit(False)))  # noqa: E731  a row per private source
    said = flagged(entities)
    merged = cut(resolutions(said.where("not private").dropDuplicates(["id"]), old, adjudicator, embedder=embedder))
    kept = said.join(merged, "id", "left").where(F.col("canonical").isNull() | F.col("private")).drop("canonical")
    spoken = said.where("not private").join(merged, "id").select(F.col("name").alias("alias"), F.col("canonical").alias("entity_id"))
    to = merged.select(F.col("id").alias("from_id"), "canonical")
    moved = lambda df, column: df.join(to, F.col(column) == F.col("from_id"), "left").withColumn(column, F.when(F.col("canonical").isNotNull() & ~F.col("private"), F.col("canonical")).otherwise(F.col(column))).drop("from_id", "canonical")
    told = moved(flagged(aliases), "entity_id")
    minted = old.select(F.col("id").alias("entity_id"), F.col("source_id").alias("minted_by"))
    allowed = told.join(minted, "entity_id", "left").where(~F.col("private") | F.col("minted_by").isNull() | (F.col("minted_by") == F.col("source_id")))
    all_aliases = allowed.select("alias", "entity_id").union(spoken).distinct()
    remapped = moved(moved(flagged(edges), "src"), "dst").drop("private")
    return kept, all_aliases, remapped.select(*edges.columns)


def branch_bridges(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """src, dst, branch: branches (branch:<repository>/<name>) of one name whose repositories are spellings of one; groups of 2 to MAX_BRANCH_GROUP.

    Spellings of a repository are linked by its names and aliases; families are connected components over
    normalised names, whose rounds are written to the shared folder.
    """
    repos = entities.where("type = 'repo'").select("id", F.col("name").alias("said"))
    spelled = repos.union(repos.join(aliases.select(F.col("entity_id").alias("id"), "alias"), "id").select("id", "alias")).select("id", text.normalize_name(F.col("said")).alias("norm")).where("norm <> ''").distinct()
    families = smallest_reachable(spelled.join(spelled.groupBy("id").agg(F.min("norm").alias("least")), "id").select(F.col("norm").alias("a"), F.col("least").alias("b")))
    rest = F.expr("substr(id, 8)")
    named = entities.where("type = 'branch' and startswith(id, 'branch:')").select("id", F.substring_index(rest, "/", 1).alias("repo"), F.regexp_extract(rest, r"^[^/]*/(.+)$", 1).alias("branch")).where("repo <> '' and branch <> ''")
    placed = named.withColumn("norm", text.normalize_name(F.col("repo"))).join(families.withColumnRenamed("node", "norm"), "norm", "left").withColumn("family", F.coalesce("root", "norm"))
    sized = placed.groupBy("family", "branch").agg(F.count("*").alias("n")).where(F.col("n").between(2, MAX_BRANCH_GROUP)).select("family", "branch")
    groups = placed.join(sized, ["family", "branch"]).groupBy("family", "branch").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return groups.select("branch", F.explode("ids").alias("src"), "ids").select("branch", "src", F.explode("ids").alias("dst")).where("src < dst").select("src", "dst", "branch")


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable over links (a, b); each round halves the way left, and not ending is an error."""
    both = cut(links.where("a <> b").union(links.where("a <> b").select("b", "a")).toDF("node", "other").distinct())
    at = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    for _ in range(rounds):
        near = both.join(at.withColumnRenamed("node", "other"), "other").select("node", "root")
        far = at.join(at.select(F.col("node").alias("root"), F.col("root").alias("beyond")), "root").select("node", F.col("beyond").alias("root"))
        now = cut(at.union(near).union(far).groupBy("node").agg(F.min("root").alias("root")))
        if now.join(at, ["node", "root"], "left_anti").isEmpty():
            return now
        at = now
    raise RuntimeError(f"components are not found after {rounds} rounds")
