"""The memory's tables: documents, chunks with vectors, postings, graph, deferred work, state.

All of them lie in one log: an ingest appends, for each table, the new rows and the keys that they
replace, and becomes visible as a whole. A run that dies before has changed nothing, one whose batch is known
changes nothing, and of two writers the second begins again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import chunk, classify, embed, text
from ..operators import catalog, fulltext, graph, mining, retrieval
from ..operators.lineage import cut
from ..sources import manifests
from .ingest import EXTRACTOR_VERSION, prepared
from .log import Conflict, Log, Table

DOCUMENTS = "doc_id string, source_id string, uri string, title string, kind string, content_hash string, graph_version int, updated_at string, chunk_count long, graph_json string"
CHUNKS = "doc_id string, chunk_index int, source_id string, uri string, title string, kind string, updated_at string, crumb string, text string, embedding array<float>"
POSTINGS = "doc_id string, chunk_index int, source_id string, term string, tf long, dl int"
EDGES = "doc_id string, src string, rel string, dst string, evidence_doc_id string, detail string"
PENDING = "doc_id string, source_id string, graph_json string"
ENTITIES = "id string, name string, type string, source_id string, layer string"
ALIASES = "alias string, entity_id string"
STATE = "source_id string, key string, value string"
#: A connector's own claims about a document, as they are stored.
PAYLOAD = "entities array<array<string>>, aliases array<array<string>>, edges array<array<string>>"


# --- assertions of documents -------------------------------------------------


def assembled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, edges) that documents assert: the connector's own payload, tickets, code, channels, tables.

    docs: doc_id, source_id, uri, title, kind, text, graph_json. The source's own entity is added for documents in which
    anything was found. Entities have doc_id and source_id, edges doc_id and detail.
    """
    told = docs.select("doc_id", "source_id", F.from_json("graph_json", PAYLOAD).alias("p")).where("p is not null")
    of = lambda name: told.select("doc_id", "source_id", F.explode(f"p.{name}").alias("x"))
    at = lambda k: F.coalesce(F.try_element_at("x", F.lit(k)), F.lit(""))
    own_entities = of("entities").select("doc_id", "source_id", at(1).alias("id"), at(2).alias("name"), at(3).alias("type"), at(4).alias("layer"))
    own_aliases = of("aliases").select("doc_id", "source_id", at(1).alias("alias"), at(2).alias("entity_id"))
    own_edges = of("edges").select("doc_id", "source_id", at(1).alias("src"), at(2).alias("rel"), at(3).alias("dst"), at(4).alias("detail"))

    code = docs.where(mining.looks_like_code(F.col("kind"), F.col("uri")))
    place = docs.select("doc_id", "source_id", F.substring(F.coalesce("title", F.lit("")), 1, 80).alias("title80"), F.expr("right(substring_index(substring_index(coalesce(uri, ''), '?', 1), '#', 1), 80)").alias("path"), classify.layer(F.col("uri")).alias("layer"))
    found = None
    for kind, rows in (("ticket", mining.ticket_edges(docs)), ("code", mining.code_edges(code)), ("channel", mining.channel_edges(docs))):
        one = rows.select("doc_id", "src", "rel", "dst", "dst_name", "dst_type", F.lit(kind).alias("from"))
        found = one if found is None else found.unionByName(one)
    named = cut(found.join(place, "doc_id"))
    detail = F.when(F.col("from") == "ticket", F.concat(F.lit("mentioned in "), "title80")).when(F.col("rel") == "imports", F.concat(F.lit("from "), "path")).otherwise(F.concat(F.lit("in "), "path"))
    told_tables = cut(mining.table_assertions(docs).where(F.size("edges") > 0))
    tables = mining.asserted_edges(told_tables).join(place, "doc_id")
    mined = named.select("doc_id", "source_id", "src", "rel", "dst", detail.alias("detail")).unionByName(tables.select("doc_id", "source_id", "src", "rel", "dst", F.concat(F.lit("table in "), F.substring("title80", 1, 60)).alias("detail")))
    source = text.source_entity(F.col("source_id"))
    sources = mined.select("doc_id", "source_id").distinct().select("doc_id", "source_id", source["id"].alias("id"), source["name"].alias("name"), source["type"].alias("type"), F.lit("").alias("layer"))
    targets = named.select("doc_id", "source_id", F.col("dst").alias("id"), F.col("dst_name").alias("name"), F.col("dst_type").alias("type"), F.when(F.col("rel") == "defines", F.coalesce("layer", F.lit(""))).otherwise("").alias("layer"))
    ends = tables.select("doc_id", "source_id", F.explode(F.array("src", "dst")).alias("id"))
    cells = ends.select("doc_id", "source_id", "id", F.expr("substr(id, instr(id, ':') + 1)").alias("name"), F.substring_index("id", ":", 1).alias("type"), F.lit("").alias("layer"))
    entities = own_entities.unionByName(sources).unionByName(targets).unionByName(cells).where("id <> ''").distinct()
    aliases = own_aliases.unionByName(mining.asserted_aliases(told_tables).join(place.select("doc_id", "source_id"), "doc_id")).distinct()
    edges = own_edges.unionByName(mined).groupBy("doc_id", "source_id", "src", "rel", "dst").agg(F.min("detail").alias("detail"))
    return entities, aliases, edges


def payloads(entities: DataFrame, aliases: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, source_id, graph_json: what was asserted for each of docs (doc_id, source_id), in the form of a stored payload."""
    pack = lambda df, name, *columns: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.array(*columns))).alias(name))
    out = docs.select("doc_id", "source_id")
    for rows, name, columns in ((entities, "entities", ("id", "name", "type", "layer")), (aliases, "aliases", ("alias", "entity_id")), (edges, "edges", ("src", "rel", "dst", "detail"))):
        out = out.join(pack(rows, name, *columns), "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<array<string>>")))
    return out.select("doc_id", "source_id", F.to_json(F.struct("entities", "aliases", "edges")).alias("graph_json"))


def mined_lines(extractor: Callable) -> Callable:
    """The seam for a model that reads relationships: called once in each worker, it gives a function of (text, title) to a list of lines; where it fails there are none."""

    @F.pandas_udf("array<string>")
    def lines(said: pd.Series, title: pd.Series) -> pd.Series:
        model = extractor()

        def of(x, t):
            try:
                return list(model(x or "", t or ""))
            except Exception:  # a document without an answer has no relationships
                return []

        return pd.Series([of(x, t) for x, t in zip(said, title, strict=True)], dtype=object)

    return lines


# --- the memory --------------------------------------------------------------


@dataclass
class Memory:
    """All tables below a folder, and what writes them."""

    spark: SparkSession
    path: str
    buckets: int = 16
    contextual: bool = False
    embedder: embed.Embedder = field(default_factory=embed.Embedder)
    extractor: Callable | None = None
    adjudicator: Callable | None = None
    private_sources: tuple[str, ...] = ()
    #: Called with a stage's name and its counts as soon as the stage of a running ingest is written.
    progress: Callable[[str, dict], None] | None = None

    def __post_init__(self):
        self.log = Log(self.spark, self.path)
        table = lambda name, schema, key="doc_id": Table(self.log, name, schema, key, self.buckets)
        self.documents, self.chunks, self.postings = table("documents", DOCUMENTS), table("chunks", CHUNKS), table("postings", POSTINGS)
        self.edges, self.pending = table("edges", EDGES), table("pending", PENDING)
        #: Stems of chunks and, twice, of their titles; see Engine.search.
        self.index = fulltext.Index(self.log, "index", self.buckets)
        self.entities, self.aliases, self.state = table("entities", ENTITIES, "id"), table("aliases", ALIASES, "entity_id"), table("state", STATE, "source_id")

    def _stage(self, name: str, rows: DataFrame, *counts: Column) -> DataFrame:
        """rows, cut; what progress is told was counted while they were written."""
        if self.progress is None:
            return cut(rows)
        seen = Observation()
        out = cut(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
        self.progress(name, seen.get)
        return out

    # -- ingest

    def ingest(self, documents: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Takes in documents (source_id, uri, title, kind, text, updated_at, and perhaps graph_json) and returns doc_id, action of each.

        Unchanged ones are skipped (their graph is built again where its extractors changed or its work was deferred); of
        documents given twice the last updated counts. batch is (a stream's name, the number of a batch): one that was taken in
        already changes nothing.
        """
        out = self.log.retried(lambda: self._ingest(documents, batch))
        self.maintain()
        return out

    def _ingest(self, documents: DataFrame, batch: tuple[str, int] | None) -> DataFrame:
        known = self.log.current()["batches"]
        if batch is not None and batch[1] <= known.get(batch[0], -1):
            return self.spark.createDataFrame([], "doc_id string, action string")
        payload = F.coalesce("graph_json", F.lit("")) if "graph_json" in documents.columns else F.lit("")
        rows = prepared(documents.withColumn("graph_json", payload), keep=("graph_json",))
        latest = self._stage("documents", rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), F.struct(F.coalesce("updated_at", F.lit("")), "content_hash")).alias("r")).select("doc_id", "r.*"))
        old = self.documents.read(self.documents.touched(latest))
        acted = catalog.ingest_actions(old, latest, EXTRACTOR_VERSION)
        waiting = self.pending.read().select("doc_id", F.lit(True).alias("waits"))
        refreshed = F.when((F.col("action") == "skipped") & F.col("waits"), "graph_refreshed").otherwise(F.col("action"))
        skipped = F.count_if(F.col("action") == "skipped").alias("skipped")
        actions = self._stage("actions", acted.join(waiting, "doc_id", "left").select("doc_id", refreshed.alias("action")), skipped)
        placed = cut(latest.join(actions, "doc_id").where("action <> 'skipped'"))
        if not placed.isEmpty():
            changed = placed.where("action in ('added', 'updated')")
            updated = changed.where("action = 'updated'").select("doc_id")
            parts = self._stage("chunks", self._chunked(changed), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
            self.index.update(self._indexed(updated), self.index_rows(parts))
            self.chunks.replace(updated, parts)
            self.postings.replace(updated, self._posted(parts))
            self._write_graph(placed.drop("action"), placed.where("action <> 'added'").select("doc_id"))
            counted = changed.join(parts.groupBy("doc_id").agg(F.count("*").alias("chunk_count")), "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            # An unchanged document keeps its row but for its graph's version and the payload, if the connector gave one.
            again = old.join(placed.where("action = 'graph_refreshed'").select("doc_id", F.col("graph_json").alias("given"), F.lit(EXTRACTOR_VERSION).alias("version")), "doc_id")
            kept = again.withColumn("graph_json", F.when(F.col("given") != "", F.col("given")).otherwise(F.col("graph_json"))).withColumn("graph_version", F.col("version"))
            columns = self.documents.columns
            self.documents.replace(placed.where("action <> 'added'"), counted.select(*columns).unionByName(kept.select(*columns)))
        if batch is not None:
            known[batch[0]] = batch[1]
        return actions

    def tables(self) -> tuple[Table, ...]:
        return self.documents, self.chunks, self.postings, self.edges, self.pending, self.entities, self.aliases, self.state

    def maintain(self, force: bool = False) -> dict[str, str]:
        """Compacts the tables that have many appended parts; what was done. A writer that comes first wins, and the next call tries again."""
        done = {}
        try:
            with self.log.transaction():
                for table in self.tables():
                    if what := table.compact(force):
                        done[table.name] = what
                if what := self.index.merge(force):
                    done[self.index.name] = what
        except Conflict:
            return {}
        return done

    def _chunked(self, docs: DataFrame) -> DataFrame:
        crumb = text.breadcrumb(F.col("source_id"), F.col("title"), F.col("uri"))
        each = docs.select("doc_id", "source_id", "uri", "title", "kind", "updated_at", (crumb if self.contextual else F.lit("")).alias("crumb"), F.posexplode(chunk.chunks(F.col("text"), F.col("kind"))).alias("chunk_index", "body"))
        said = F.when(F.col("crumb") != "", text.with_context(F.col("crumb"), F.col("body"))).otherwise(F.col("body"))
        return self.embedder.passages(each.withColumn("text", said).drop("body"))

    @staticmethod
    def index_rows(parts: DataFrame) -> DataFrame:
        """id, source_id, title, text of chunks."""
        return parts.select(F.xxhash64("doc_id", "chunk_index").alias("id"), "source_id", "title", "text")

    def _indexed(self, docs: DataFrame) -> DataFrame:
        """What is indexed of the stored chunks of docs (doc_id), written apart."""
        return cut(self.index_rows(self.chunks.read(self.chunks.touched(docs)).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")))

    def _posted(self, parts: DataFrame) -> DataFrame:
        # Chunks are dealt out as texts: their terms are counted where they are, without a row for a word.
        dealt = parts.select("doc_id", "chunk_index", "source_id", "text").repartition("doc_id", "chunk_index")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (piece for batch in batches for piece in retrieval.pieces(batch, 3, retrieval.CHARACTERS)):
                words = retrieval.words_of(part.column(4))
                vocabulary, row, term, tf = retrieval.term_counts([(words, 1.0)])
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = (vocabulary.take(pa.array(term)), pa.array(tf.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], words.value_lengths(), *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=["doc_id", "chunk_index", "source_id", "dl", "terms", "tfs"])

        said = dealt.select("doc_id", "chunk_index", "source_id", F.length("text").alias("n"), F.lower("text").alias("text"))
        counted = said.mapInArrow(count, "doc_id string, chunk_index int, source_id string, dl int, terms array<string>, tfs array<long>")
        each = counted.select("doc_id", "chunk_index", "source_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
        return each.select("doc_id", "chunk_index", "source_id", F.col("t.terms").alias("term"), "dl", F.col("t.tfs").alias("tf"))

    # -- graph

    def _write_graph(self, docs: DataFrame, known: DataFrame) -> None:
        """Assertions of docs (written apart), of which some are known (doc_id); those that a model should read first are deferred with theirs as a payload."""
        entities, aliases, edges = (self._stage(name, x) for name, x in zip(("entities", "aliases", "edges"), assembled(docs), strict=True))
        code = mining.looks_like_code(F.col("kind"), F.col("uri"))
        manifest = F.lit(False)
        for pattern, _ in manifests.FORMATS:
            manifest = manifest | F.lower(F.regexp_replace(F.col("uri"), "::", "/")).rlike(pattern)
        waits = classify.mining_eligible(F.col("kind"), F.col("text"), F.col("uri")) & ~code & ~manifest if self.extractor is not None else F.lit(False)
        deferred = docs.where(waits).select("doc_id", "source_id")
        ready = docs.select("doc_id", "source_id").join(deferred.select("doc_id"), "doc_id", "left_anti")
        self.pending.replace(known, payloads(entities, aliases, edges, deferred))
        only = lambda df: df.join(ready.select("doc_id"), "doc_id", "left_semi")
        self._persist(ready.join(known, "doc_id", "left_semi"), only(entities), only(aliases), only(edges))

    def _persist(self, docs: DataFrame, entities: DataFrame, aliases: DataFrame, edges: DataFrame) -> None:
        """Writes what documents assert; of those in docs what they asserted before goes."""
        old = self.entities.read(self.entities.touched(entities))
        private = self.spark.createDataFrame([(s,) for s in self.private_sources], "source_id string")
        # All entities are candidates for another name, and say who made them; only those of the buckets that are written are read again below.
        pool = self.entities.read()
        kept, all_aliases, remapped = graph.guarded(entities.withColumn("seq", F.lit(0)), aliases, edges, pool, private, self.adjudicator, self.embedder)
        arrived = cut(kept.withColumn("seq", F.xxhash64("doc_id").bitwiseAND(F.lit(2**62 - 1))))
        there = cut(old.join(arrived.select("id").distinct(), "id", "left_semi"))
        merged = cut(graph.upsert_entities(there, arrived))
        self.entities.replace(there, merged)
        spoken = cut(all_aliases)
        said = cut(self.aliases.read(self.aliases.touched(spoken)).join(spoken.select("entity_id").distinct(), "entity_id", "left_semi"))
        self.aliases.replace(said, graph.upsert_aliases(said, spoken))
        self.edges.replace(docs, remapped.select("doc_id", "src", "rel", "dst", F.col("doc_id").alias("evidence_doc_id"), "detail"))
        told = catalog.without(spoken.select(F.lower(F.trim("alias")).alias("alias"), "entity_id").where("alias <> ''"), said, ["alias", "entity_id"])
        changed = cut(merged.join(there, ["id", "name", "type"], "left_anti").select("id").union(told.select("entity_id")).distinct())
        if not changed.isEmpty():
            self._bridge(changed, there, self.aliases.read(self.aliases.touched(changed.withColumnRenamed("id", "entity_id"))))

    def _bridge(self, changed: DataFrame, former: DataFrame, spoken: DataFrame) -> None:
        """Bridges of names after entities (id) arrived, changed or went; see graph.refreshed_bridges. Those that a private source made take part in none, as a bridge cites no document."""
        named = self.entities.read()
        open_ = named.where(~F.coalesce(F.col("source_id").isin(*self.private_sources), F.lit(False))) if self.private_sources else named
        joinable = lambda df: df.where(F.col("type").isin(*graph.BRIDGE_TYPES, "branch"))
        mine = cut(joinable(former.select("id", "type").union(named.select("id", "type"))).join(changed, "id", "left_semi").select("id").distinct())
        if mine.isEmpty():
            return
        ids, bridges = graph.refreshed_bridges(open_, self.aliases.read(), joinable(former).join(mine, "id", "left_semi"), spoken, mine)
        keys = ids.select(F.concat(F.lit("same_as:"), "id").alias("doc_id"))
        there = cut(self.edges.read().where("rel = 'same_as'").select("doc_id").join(keys, "doc_id", "left_semi").distinct())
        self.edges.replace(there, cut(bridges.select(F.concat(F.lit("same_as:"), "src").alias("doc_id"), "src", F.lit("same_as").alias("rel"), "dst", F.lit("").alias("evidence_doc_id"), "detail")))

    def stored_texts(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, ...) with the text that was indexed: their chunks without what was put before them, in order."""
        parts = self.chunks.read(self.chunks.touched(docs)).join(docs.select("doc_id"), "doc_id", "left_semi")
        bare = parts.select("doc_id", F.struct("chunk_index", F.when(F.col("crumb") != "", text.without_context(F.col("crumb"), F.col("text"))).otherwise(F.col("text")).alias("body")).alias("c"))
        joined = bare.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["body"]), "\n\n").alias("text"))
        return docs.join(joined, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))

    def drain(self, extractor: Callable | None = None) -> DataFrame:
        """Finishes deferred documents from their stored text; counts: documents, missing_text, orphans. Those without text stay deferred."""
        return self.log.retried(lambda: self._drain(extractor))

    def _drain(self, extractor: Callable | None) -> DataFrame:
        waiting = cut(self.pending.read())
        docs = self.documents.read()
        orphans = catalog.without(waiting, docs, ["doc_id"])
        n_orphans = orphans.count()
        there = self.stored_texts(catalog.pending_documents(waiting, docs))
        ready = cut(there.where("trim(text) <> ''"))
        n, missing = ready.count(), there.where("trim(text) = ''").count()
        if n:
            entities, aliases, edges = assembled(ready.withColumn("text", F.lit("")))  # the payload holds what the text says
            lines = ready.select("doc_id", "source_id", F.substring("title", 1, 60).alias("t"), mined_lines(extractor or self.extractor)("text", "title").alias("lines"))
            told = mining.triple_edges(lines).join(lines.select("doc_id", "source_id", "t"), "doc_id")
            stated = told.select("doc_id", "source_id", "src", "rel", "dst", F.concat(F.lit("stated in "), "t").alias("detail"))
            ends = told.select("doc_id", "source_id", F.explode(F.array("src", "dst")).alias("id"))
            said = ends.select("doc_id", "source_id", "id", F.expr("substr(id, instr(id, ':') + 1)").alias("name"), F.substring_index("id", ":", 1).alias("type"), F.lit("").alias("layer")).distinct()
            all_edges = edges.unionByName(stated).groupBy("doc_id", "source_id", "src", "rel", "dst").agg(F.min("detail").alias("detail"))
            self._persist(ready.select("doc_id", "source_id"), cut(entities.unionByName(said).distinct()), cut(aliases), cut(all_edges))
        self.pending.replace(cut(ready.select("doc_id").union(orphans.select("doc_id"))), self.spark.createDataFrame([], PENDING))
        return self.spark.createDataFrame([(n, missing, n_orphans)], "documents long, missing_text long, orphans long")

    def rebuild(self, source: str | None = None) -> DataFrame:
        """Builds the graph again from what is stored; counts: documents, faithful, preserved, missing_text.

        With a stored payload a document's edges are replaced; without one its own edges are kept beside what
        its text says, as nothing else knows what the connector claimed. Without text it is left as it is.
        """
        return self.log.retried(lambda: self._rebuild(source))

    def _rebuild(self, source: str | None) -> DataFrame:
        docs = self.documents.read()
        docs = docs if source is None else docs.where(F.col("source_id") == source)
        read = cut(self.stored_texts(docs))
        usable = read.where("trim(text) <> ''")
        bare = usable.where("graph_json = ''").select("doc_id")
        before = catalog.edges_of(self.edges.read(), bare)
        was = before.groupBy(F.col("evidence_doc_id").alias("doc_id")).agg(F.collect_list(F.array("src", "rel", "dst", F.coalesce("detail", F.lit("")))).alias("edges"))
        empty = F.array().cast("array<array<string>>")
        kept = was.select("doc_id", F.to_json(F.struct(empty.alias("entities"), empty.alias("aliases"), "edges")).alias("held"))
        carried = usable.join(kept, "doc_id", "left").withColumn("graph_json", F.when(F.col("graph_json") != "", F.col("graph_json")).otherwise(F.coalesce("held", F.lit(""))))
        self._persist(usable.select("doc_id", "source_id"), *(cut(x) for x in assembled(cut(carried.drop("held")))))
        columns = [f.split()[0] for f in DOCUMENTS.split(", ")]
        self.documents.replace(usable, cut(usable.withColumn("graph_version", F.lit(EXTRACTOR_VERSION)).select(*columns)))
        return cut(read.agg(F.count_if(F.expr("trim(text) <> ''")).alias("documents"), F.count_if(F.expr("trim(text) <> '' and graph_json <> ''")).alias("faithful"), F.count_if(F.expr("trim(text) <> '' and graph_json = ''")).alias("preserved"), F.count_if(F.expr("trim(text) = ''")).alias("missing_text")))

    # -- deletes, state, indexes

    def delete(self, gone: DataFrame) -> None:
        """Documents (doc_id) with their chunks, postings, edges and deferred work; then entities that nothing cites any more."""
        self.log.retried(lambda: self._delete(gone))

    def _delete(self, gone: DataFrame) -> None:
        gone = cut(gone.select("doc_id").distinct())
        was = self._indexed(gone)
        self.index.update(was, was.limit(0))
        for table in (self.chunks, self.postings, self.edges, self.pending, self.documents):
            table.replace(gone, self.spark.createDataFrame([], table.schema))
        was = cut(graph.orphans(self.entities.read(), self.edges.read()).select("id", "name", "type"))
        left = was.select("id")
        unsaid = left.withColumnRenamed("id", "entity_id")
        spoken = cut(self.aliases.read(self.aliases.touched(unsaid)).join(unsaid, "entity_id", "left_semi"))
        self.aliases.replace(left.withColumnRenamed("id", "entity_id"), self.spark.createDataFrame([], ALIASES))
        self.entities.replace(left, self.spark.createDataFrame([], ENTITIES))
        if not was.isEmpty():
            self._bridge(left, was, spoken)

    def backfill_postings(self) -> int:
        """Builds postings of chunks that have none (of a memory that was filled before there were any); the number of documents."""
        missing = cut(self.chunks.read().join(self.postings.read().select("doc_id").distinct(), "doc_id", "left_anti"))
        self.postings.replace(missing.limit(0), self._posted(missing))
        return missing.select("doc_id").distinct().count()

    def backfill_index(self) -> int:
        """Builds the full-text index of a memory that was filled before there was one; the number of chunks."""
        if self.log.current()["parts"].get(f"{self.index.name}.sizes"):
            return 0
        rows = self.index_rows(self.chunks.read())
        self.log.retried(lambda: self.index.update(rows.limit(0), rows))
        return rows.count()

    def stream(self, source: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
        """Takes in what is there of a stream of documents and stops; restarts go on from the checkpoint. A batch that is replayed changes nothing, as its number is committed with it."""

        def batch(rows: DataFrame, number: int) -> None:
            self.ingest(rows, (name, number))

        return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def watermark(self, source: str, key: str = "since") -> str | None:
        row = self.state.read(self.state.touched(self.spark.createDataFrame([(source,)], "source_id string"))).where((F.col("source_id") == source) & (F.col("key") == key)).first()
        return row.value if row else None

    def commit(self, source: str, values: dict[str, str]) -> None:
        """A source's cursors, each in place of the former one of its name."""
        new = self.spark.createDataFrame([(source, k, v) for k, v in values.items() if v is not None], STATE)
        old = self.state.read(self.state.touched(new)).where(F.col("source_id") == source)
        self.state.replace(new, cut(catalog.set_state(old, new)))

    def sync(self, source: str, pull: Callable[[dict[str, str]], DataFrame], now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> DataFrame:
        """Pulls documents from a source's stored cursors on, ingests them, and only then commits where it started and what the pull wrote into its cursors."""
        started = now().isoformat()
        state = {r.key: r.value for r in self.state.read().where(F.col("source_id") == source).collect()}  # a few cursors
        actions = self.ingest(pull(state))
        self.commit(source, state | {"since": started})
        return actions

    def search_rows(self) -> DataFrame:
        """id, doc_id, source_id, title, text, embedding of the chunks, for retrieval."""
        return self.chunks.read().select(F.xxhash64("doc_id", "chunk_index").alias("id"), "doc_id", "source_id", "title", "text", "embedding")
