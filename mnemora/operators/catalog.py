"""Catalog reads and writes: counts, listings, upserts and deletes as DataFrame programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """left with the number of right's rows of its key (0 without any)."""
    return left.join(right.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count_distinct("source_id").alias("sources"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """old with new's rows in place of those of the same key; of new rows of one key the last by `order` counts. Columns in `keep` stay as they were where they were set."""
    last = new
    if order is not None:
        last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__n = 1").drop("__n")
    if keep:
        was = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        last = last.join(was, list(keys), "left")
        last = last.select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last.select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def move_documents(docs: DataFrame, moved: DataFrame) -> DataFrame:
    """docs with source_id from moved (doc_id, to_source)."""
    return docs.join(moved.select("doc_id", "to_source"), "doc_id", "left").withColumn("source_id", F.coalesce("to_source", "source_id")).select(*docs.columns)


def entities_touched(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """id: entities on an edge that one of these documents (doc_id) evidences."""
    mine = edges.join(docs.select(F.col("doc_id").alias("evidence_doc_id")).distinct(), "evidence_doc_id", "left_semi")
    return mine.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, texts in chunk order."""
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c")).select("doc_id", F.col("c.text").alias("texts"))


def ingest_actions(stored: DataFrame, arrived: DataFrame, version: int) -> DataFrame:
    """doc_id, action: added, updated (hash differs), graph_refreshed (same text, older graph) or skipped."""
    old = stored.select("doc_id", F.col("content_hash").alias("old_hash"), F.col("graph_version").alias("old_version"))
    action = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("old_hash") != F.col("content_hash"), "updated")
        .when(F.coalesce("old_version", F.lit(0)) < version, "graph_refreshed")
        .otherwise("skipped")
    )
    return arrived.select("doc_id", "content_hash").join(old, "doc_id", "left").select("doc_id", action.alias("action"))


def best_hits(hits: DataFrame, prefix: int = 80) -> DataFrame:
    """The best-scored hit of each (doc_id, beginning of its text) over many queries."""
    key = F.substring("text", 1, prefix)
    return hits.groupBy("doc_id", key.alias("head")).agg(F.max(F.struct("score", F.col("text"))).alias("b")).select("doc_id", F.col("b.score").alias("score"), F.col("b.text").alias("text"))


def pruned_events(events: DataFrame, now: Column, days: int) -> DataFrame:
    """Events that started within the window, and all that have not ended."""
    return events.where(F.col("ended_at").isNull() | (F.col("started_at") >= now - F.make_dt_interval(F.lit(days))))


# --- counts, queues and listings ---------------------------------------------


def document_counts(docs: DataFrame) -> DataFrame:
    """source_id (null: all of them), documents, without_payload: documents of each source, and how many have no stored graph payload. One pass, by grouping sets."""
    missing = F.count_if(F.coalesce("graph_json", F.lit("")) == "")
    return docs.rollup("source_id").agg(F.count("*").alias("documents"), missing.alias("without_payload"), F.grouping("source_id").alias("total")).where("total = 1 or source_id is not null").drop("total")


def pending_documents(pending: DataFrame, docs: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    """doc_id, source_id, graph_json, uri, title, kind: deferred graph work whose document is still there, by source and address."""
    kept = pending if source is None else pending.where(F.col("source_id") == source)
    out = kept.select("doc_id", "source_id", "graph_json").join(docs.select("doc_id", "uri", "title", "kind"), "doc_id")
    return out if limit is None else out.orderBy("source_id", "uri").limit(limit)


def pending_by_source(pending: DataFrame) -> DataFrame:
    """source_id, n, most first."""
    return pending.groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id")


def mark_pending(pending: DataFrame, marked: DataFrame) -> DataFrame:
    """The queue after documents (doc_id, source_id, graph_json) were deferred; the newer payload counts."""
    return upsert(pending, marked, ["doc_id"])


def promotion_queue(docs: DataFrame, sources: DataFrame, status: str = "requested") -> DataFrame:
    """Documents offered to everyone, with the name, type and owner of their source (null where it is not registered)."""
    s = sources.select("source_id", F.col("name").alias("source_name"), F.col("type").alias("source_type"), F.col("owner").alias("source_owner"))
    return docs.where(F.col("promotion_status") == status).join(s, "source_id", "left")


def promoted(docs: DataFrame, offers: DataFrame) -> DataFrame:
    """docs after offers (doc_id, status, by, note, at); an empty status withdraws, and forgets when."""
    o = offers.select("doc_id", F.col("status").alias("__status"), F.col("by").alias("__by"), F.col("note").alias("__note"), F.when(F.col("status") != "", F.col("at")).otherwise("").alias("__at"))
    joined = docs.join(o, "doc_id", "left")
    fields = {"promotion_status": "__status", "promotion_by": "__by", "promotion_note": "__note", "promotion_at": "__at"}
    return joined.select(*[F.when(F.col("__status").isNotNull(), F.col(fields[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in docs.columns])


def set_columns(docs: DataFrame, values: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs with the further columns of values in place of their own, for the rows that values has (each key once)."""
    changed = [c for c in values.columns if c not in keys]
    v = values.select(*keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in changed])
    joined = docs.join(v, list(keys), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in docs.columns])


def edges_of(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The edges that documents (doc_id) evidence."""
    return edges.join(docs.select(F.col("doc_id").alias("evidence_doc_id")).distinct(), "evidence_doc_id", "left_semi")


def action_counts(actions: DataFrame) -> DataFrame:
    """added, updated, skipped, graph_refreshed, documents of an ingest; a refreshed graph is of a skipped document."""
    of = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(of("added").alias("added"), of("updated").alias("updated"), of("skipped", "graph_refreshed").alias("skipped"), of("graph_refreshed").alias("graph_refreshed"), F.count("*").alias("documents"))


def open_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.where("status = 'open'")


def unfinished(events: DataFrame) -> DataFrame:
    """Runs without an end: paused ones can go on, others were cut off."""
    return events.where("ended_at is null")


def run_history(events: DataFrame, since: Column, live: Sequence[str] = ()) -> DataFrame:
    """Events from a time on; a run that is not live and says that it runs was interrupted."""
    stale = F.col("state").isin("running", "paused", "stopping", "retrying") & ~(F.col("id").isin(*live) if live else F.lit(False))
    return events.where(F.col("started_at") >= since).withColumn("state", F.when(stale, "interrupted").otherwise(F.col("state")))


def expired_attachments(attachments: DataFrame, cutoff: Column) -> DataFrame:
    """Attachments uploaded before the cutoff that are not deleted."""
    return attachments.where(F.col("deleted_at").isNull() & (F.col("uploaded_at") < cutoff))


def link_attachments(attachments: DataFrame, ids: DataFrame, session: str) -> DataFrame:
    """attachments with those of ids (id) bound to a session, if they have none."""
    mine = F.broadcast(ids.select("id", F.lit(True).alias("__hit")).distinct())  # the attachments of one message
    return attachments.join(mine, "id", "left").withColumn("session_id", F.when(F.col("__hit") & F.col("session_id").isNull(), session).otherwise(F.col("session_id"))).select(*attachments.columns)


# --- deletes -----------------------------------------------------------------


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without documents (doc_id) and what hangs on them: documents, chunks, postings, pending by doc_id, edges by their evidence. Entities stay for the orphan sweep, as other documents may cite them."""
    ids = gone.select("doc_id").distinct()
    out = {}
    for name, df in tables.items():
        key = "evidence_doc_id" if name == "edges" else "doc_id"
        out[name] = df.join(ids.withColumnRenamed("doc_id", key), key, "left_anti").select(*df.columns) if key in df.columns else df
    return out


def reset(tables: dict[str, DataFrame], include_gaps: bool = True) -> dict[str, DataFrame]:
    """The tables as if nothing had been ingested: configured sources, settings, sessions and histories stay."""
    emptied = {"documents", "chunks", "postings", "edges", "entities", "aliases", "pending", "state"} | ({"gaps"} if include_gaps else set())
    return {name: df.limit(0) if name in emptied else df.where("configured = 1") if name == "sources" else df for name, df in tables.items()}


# --- small writes ------------------------------------------------------------


def set_labels(labels: DataFrame, added: DataFrame) -> DataFrame:
    """Labels (source_id, uri_prefix, kind, value) after more were set; one that is there stays as it is."""
    trimmed = added.withColumn("value", F.trim("value"))
    return labels.unionByName(trimmed.join(labels, ["source_id", "uri_prefix", "kind", "value"], "left_anti").dropDuplicates(["source_id", "uri_prefix", "kind", "value"]).select(*labels.columns))


def remove_labels(labels: DataFrame, removed: DataFrame) -> DataFrame:
    return without(labels, removed.withColumn("value", F.trim("value")), ["source_id", "uri_prefix", "kind", "value"]).select(*labels.columns)


def log_gaps(gaps: DataFrame, refused: DataFrame, now: Column, keep_query: bool = True) -> DataFrame:
    """gaps with refused questions (id, query, best_score, nearest_json, session_id); without keep_query only their hash is stored."""
    from ..functions import text

    rows = refused.select(
        "id", (F.col("query") if keep_query else F.lit("")).alias("query"), text.query_hash(F.col("query")).alias("query_hash"), F.col("best_score").cast("double").alias("best_score"),
        "nearest_json", "session_id", F.lit("open").alias("status"), F.lit("").alias("resolution"), now.alias("created_at"), F.lit(None).cast(gaps.schema["resolved_at"].dataType).alias("resolved_at"),
    )
    return gaps.unionByName(rows.select(*gaps.columns))


def resolve_gaps(gaps: DataFrame, ids: DataFrame, resolution: str, now: Column) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = gaps.join(hit, "id", "left")
    new = {"status": F.lit("resolved"), "resolution": F.lit(resolution), "resolved_at": now}
    return joined.select(*[F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in gaps.columns])


def save_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions (id, project_id, title, summary, messages_json, est_tokens, created_at, updated_at) after turns were saved; the beginning stays."""
    return upsert(sessions, turns, ["id"], order=F.col("updated_at"), keep=("created_at",))


def register_sources(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """sources after a sync saw them (source_id, name, type, config_json, created_at): who owns one, whether it is shared or configured, and since when it is there are not changed by a sync."""
    owned = ("owner", "shared", "configured", "sync_interval_minutes", "created_at")
    filled = seen.select(*[F.col(c) if c in seen.columns else F.lit(0 if c in ("shared", "configured") else None).cast(sources.schema[c].dataType).alias(c) for c in sources.columns])
    return upsert(sources, filled, ["source_id"], keep=owned)


def declared_aliases(sources: DataFrame) -> DataFrame:
    """alias, entity_id: the other names (option aka, a list or separated by commas) of each source."""
    from ..functions import text

    aka = F.get_json_object("config_json", "$.aka")
    listed = F.coalesce(F.from_json(aka, "array<string>"), F.split(aka, ","))
    rows = sources.where(aka.isNotNull()).select(text.source_entity(F.col("source_id"))["id"].alias("entity_id"), F.explode(F.when(F.startswith(aka, F.lit("[")), listed).otherwise(F.split(aka, ","))).alias("alias"))
    return rows.select(F.lower(F.trim("alias")).alias("alias"), "entity_id").where("alias <> ''").distinct()


def set_state(state: DataFrame, values: DataFrame) -> DataFrame:
    """state (source_id, key, value) after values; null values change nothing."""
    return upsert(state, values.where("value is not null"), ["source_id", "key"])


def register_skills(skills: DataFrame, found: DataFrame) -> DataFrame:
    """skills after a discovery (name, path, origin, scope, required_env, enabled): what an administrator sets stays, only the place follows."""
    return upsert(skills, found, ["name"], keep=tuple(c for c in ("scope", "required_env", "enabled", "installed_by", "created_at") if c in skills.columns))


def secrets_of(secrets: DataFrame, owners: Sequence[str]) -> DataFrame:
    """key, owner, value_enc: of each key the value of the first of the owners that has one."""
    rank = F.create_map(*[x for k, o in enumerate(owners) for x in (F.lit(o), F.lit(k))])
    kept = secrets.where(F.col("owner").isin(*owners))
    return kept.groupBy("key").agg(F.min(F.struct(rank[F.col("owner")].alias("r"), "owner", "value_enc")).alias("s")).select("key", "s.owner", "s.value_enc")
