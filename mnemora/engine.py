"""The questions that a reader asks of a memory, each as a DataFrame.

An engine reads a memory's tables as one reader: sources outside `visible` (None: all) are in no answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dates, text
from .operators import answers, catalog, gaps, graph, retrieval, scope
from .streaming.store import Memory

REGISTERED = "source_id string, name string, type string, config_json string, owner string, shared int, configured int, sync_interval_minutes int, created_at string"
BACKLOG = "id long, query string, query_hash string, best_score double, nearest_json string, session_id string, status string, resolution string, created_at string, resolved_at string"


@dataclass
class Engine:
    memory: Memory
    visible: tuple[str, ...] | None = None
    top_k: int = 8
    min_score: float = 0.55
    rerank: int = 0
    #: The seam for a model that orders the first `rerank` answers; see retrieval.rerank_head.
    reranker: Callable | None = None
    expansion_limit: int = 8
    now: datetime = field(default_factory=lambda: datetime.now(UTC))

    def _documents(self) -> DataFrame:
        docs = self.memory.documents.read()
        return docs.where(scope.allowed(F.col("source_id"), self.visible))

    def _graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(edges, entities, documents); which edges are seen is the operators' part."""
        return self.memory.edges.read().select("src", "rel", "dst", "evidence_doc_id", "detail"), self.memory.entities.read(), self.memory.documents.read()

    def search(self, questions: DataFrame, sources: tuple[str, ...] = (), documents: tuple[str, ...] = (), expand: bool = False) -> DataFrame:
        """qid, doc_id, source_id, title, text, score, rank: chunks that answer questions (qid, query), grounded by min_score.

        With expand, questions are searched with the canonical names of what they mention.
        """
        entities, aliases = self.memory.entities.read(), self.memory.aliases.read()
        asked = questions
        if expand:
            names = aliases.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select(F.col("alias").alias("key"), F.col("entity_id").alias("id"), "name")
            asked = gaps.expand_queries(questions, names, text.GENERIC_TOKENS).withColumnRenamed("expanded", "query")
        ready = self.memory.embedder.queries(asked).withColumn("terms", text.match_terms(F.col("query")))
        rows = self.memory.search_rows()
        wanted = rows.where(scope.Scope(sources, documents, self.visible).predicate(F.col("source_id"), F.col("doc_id")))
        # Chosen documents are few: their texts are read. Else the sparse leg reads the index alone.
        sparse = None if documents else lambda q, k: self.memory.index.topk(q, k, self._searched(sources))
        found = retrieval.hybrid_search(wanted, ready, self.top_k, self.min_score, self.rerank, reranker=self.reranker, sparse=sparse)
        return found.join(rows.select("id", "doc_id", "source_id", "title", "text"), "id").select("qid", "doc_id", "source_id", "title", "text", "score", "rank")

    def _searched(self, sources: tuple[str, ...]) -> tuple[str, ...] | None:
        """The sources of a search (None: all): those asked for that are seen."""
        if not sources:
            return self.visible
        return sources if self.visible is None else tuple(s for s in sources if s in self.visible)

    def related(self, hits: DataFrame) -> DataFrame:
        """doc_id, rel, src, dst: documents one hop in the graph from the hits' documents."""
        edges, _, docs = self._graph()
        return graph.expand(edges, docs, hits.select("doc_id"), self.expansion_limit, self.visible)

    def sources(self) -> DataFrame:
        """source_id, documents, most first."""
        return self._documents().groupBy("source_id").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "source_id")

    def stats(self) -> DataFrame:
        return catalog.corpus_stats(self._documents())

    def neighbors(self, entity: str) -> DataFrame:
        edges, entities, docs = self._graph()
        return answers.grouped_neighbors(graph.neighbors(edges, entities, docs, entity, self.visible), entity)

    def relations(self, rel: str, src_type: str | None = None, dst_type: str | None = None) -> DataFrame:
        edges, entities, docs = self._graph()
        return answers.grouped_relations(graph.relations(edges, entities, docs, rel, src_type, dst_type, self.visible))

    def paths(self, start: str, end: str, max_hops: int = 3, most: int = 5) -> DataFrame:
        """hops, nodes, rels, classes: materially different paths between two entities, every hop on evidence that is seen."""
        edges, _, docs = self._graph()
        return graph.different_paths(scope.evidence_visible(edges, docs, self.visible), docs, start, end, max_hops, most)

    def resolve(self, names: DataFrame) -> DataFrame:
        """needle, id of names (needle) that are seen."""
        edges, entities, docs = self._graph()
        seen = entities if self.visible is None else graph.reachable(entities, edges, docs, self.visible)
        return graph.resolve(seen, self.memory.aliases.read(), names)

    def snapshot(self, limit: int = 400) -> DataFrame:
        edges, entities, docs = self._graph()
        return graph.snapshot(edges, entities, docs, limit, self.visible)

    def dates(self, phrases: DataFrame) -> DataFrame:
        """phrase, start, end of relative dates (phrase)."""
        w = dates.window(F.col("phrase"), self.now)
        return phrases.select("phrase", w.alias("w")).select("phrase", F.col("w.start").alias("start"), F.col("w.end").alias("end"))

    def gap_clusters(self, backlog: DataFrame, threshold: float = 0.8) -> DataFrame:
        """Open refused questions of a backlog (see BACKLOG), in clusters."""
        waiting = catalog.open_gaps(backlog)
        return gaps.records(waiting, gaps.clusters(waiting, threshold))

    def remember(self, facts: DataFrame) -> DataFrame:
        """Takes in taught facts (fact, topic, user, share); doc_id, action of each."""
        return self.memory.ingest(answers.taught_notes(facts).drop("owner").withColumn("updated_at", F.lit(self.now.isoformat())))

    def learn_conversations(self, sessions: DataFrame, parts: DataFrame) -> DataFrame:
        """Takes in notes of compressed conversations, with the relationships that they state."""
        notes = answers.conversation_notes(sessions, parts)
        entity = lambda t, side: F.array(F.concat(t[f"{side}_type"], F.lit(":"), F.lower(t[f"{side}_name"])), t[f"{side}_name"], t[f"{side}_type"])
        said = F.concat(F.lit("said in conversation: "), F.substring(F.regexp_replace("title", "^Conversation: ", ""), 1, 60))
        edges = F.transform("triples", lambda t: F.array(entity(t, "src")[0], t["rel"], entity(t, "dst")[0], said))
        ends = F.array_distinct(F.flatten(F.transform("triples", lambda t: F.array(entity(t, "src"), entity(t, "dst")))))
        payload = F.when(F.size("triples") > 0, F.to_json(F.struct(ends.alias("entities"), F.array().cast("array<array<string>>").alias("aliases"), edges.alias("edges")))).otherwise("")
        rows = notes.select(F.lit("conversations:learned").alias("source_id"), "uri", "title", "kind", "text", F.lit(self.now.isoformat()).alias("updated_at"), payload.alias("graph_json"))
        return self.memory.ingest(rows)
