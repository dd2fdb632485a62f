"""Visibility and scope: what a reader may search. None means no restriction, an empty list means nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    source_ids: tuple[str, ...] = ()
    doc_ids: tuple = ()
    visible: tuple[str, ...] | None = None

    def predicate(self, source: Column, doc: Column) -> Column:
        """(source picked or document picked, if any is) and source visible."""
        out = F.lit(True)
        if self.source_ids or self.doc_ids:
            picked = F.lit(False)
            if self.source_ids:
                picked = picked | source.isin(*self.source_ids)
            if self.doc_ids:
                picked = picked | doc.isin(*self.doc_ids)
            out = picked
        return out & allowed(source, self.visible)


def allowed(source: Column, visible: Sequence[str] | None) -> Column:
    if visible is None:
        return F.lit(True)
    return source.isin(*visible) if visible else F.lit(False)


def visible_sources(sources: DataFrame, user: str | None) -> DataFrame:
    """Sources that are ownerless, shared or the user's."""
    mine = F.col("owner") == user if user is not None else F.lit(False)
    return sources.where(F.col("owner").isNull() | (F.col("shared") == 1) | mine)


def is_private(owner: Column, shared: Column) -> Column:
    return F.coalesce(owner.isNotNull() & (F.coalesce(shared, F.lit(0)) != 1), F.lit(False))


def can_manage(owner: Column, user: str, admin: bool = False) -> Column:
    return F.lit(admin) | F.coalesce(owner == user, F.lit(False))


def note_bucket(user: Column, share: Column) -> Column:
    return F.when(share | user.isNull(), "notes:user-taught").otherwise(F.concat(F.lit("notes:"), user))


def evidence_visible(edges: DataFrame, docs: DataFrame, visible: Sequence[str] | None) -> DataFrame:
    """Edges without evidence, and those whose evidence is of a visible source; evidence that is missing is not visible."""
    if visible is None:
        return edges
    if not visible:
        return edges.limit(0)
    seen = docs.where(allowed(F.col("source_id"), visible)).select(F.col("doc_id").alias("evidence_doc_id"))
    return edges.where("evidence_doc_id = ''").unionByName(edges.where("evidence_doc_id <> ''").join(seen, "evidence_doc_id", "left_semi"))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source_id, uri, label_kind, value): every label that covers a document.

    A uri is cut at each length that a prefix of its source has, and the pieces are looked up, so the work
    follows documents and the lengths of prefixes, not a source's documents times its labels.
    """
    l = labels.select("source_id", "uri_prefix", F.col("kind").alias("label_kind"), "value").where("uri_prefix is not null").distinct()  # noqa: E741
    lengths = l.groupBy("source_id").agg(F.collect_set(F.length("uri_prefix")).alias("lengths"))  # no more than a uri has characters
    d = docs.select("doc_id", "source_id", "uri").join(lengths, "source_id")
    fitting = F.filter("lengths", lambda n: n <= F.length("uri"))
    pieces = d.select("doc_id", "source_id", "uri", F.explode(F.transform(fitting, lambda n: F.substr(F.col("uri"), F.lit(1), n))).alias("uri_prefix"))
    return pieces.join(l, ["source_id", "uri_prefix"]).select("doc_id", "source_id", "uri", "label_kind", "value").distinct()


def aka_terms(docs: DataFrame, labels: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, value: the other names (labels of kind aka) that cover each of the documents in ids (doc_id)."""
    asked = docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return with_labels(asked, labels.where("kind = 'aka'")).select("doc_id", "value").distinct()


def resolve_tags(docs: DataFrame, labels: DataFrame, values: Sequence[str]) -> DataFrame:
    """Scope of tags: (kind, id) with whole sources (prefix '') as sources and other labels as their documents."""
    wanted = labels.where((F.col("kind") == "tag") & F.col("value").isin(*values))
    sources = wanted.where("uri_prefix = ''").select(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("id"))
    of_docs = with_labels(docs, wanted.where("uri_prefix <> ''")).select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    return sources.union(of_docs).distinct()
