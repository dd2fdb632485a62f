"""The corpus pipeline: STAGES over documents, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. What a stage rejects is gone for the next.

Defined cases, for every stage: an empty table gives an empty result; further columns, whatever
their names, are passed on (the last stage ignores them). A null or blank text is scored as the
classifier's bias; such texts are copies of each other; none holds an item; the mix leaves them out, as they have
no words; as tokens they would be the end id alone. A null doc_id is last among the ids of a group, so
it stays only where all are null, and first in the token order. Rows that repeat id and text stay once after the
near copies went. A null source is one source, last in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import decontaminate, mixing, quality_model, similar, tokens
from mnemora.llm.common import drop_stored, read_table, scratch, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that score under 0.3 go."""
    return quality_model.accepted(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, with bags of shingles: one document of each group of copies and near copies (five words, 0.8) stays, that of the smallest doc_id."""
    return similar.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents are repeated or left out so that sources meet their target words."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids in Simple-8b shards; doc_id, start, n_tokens, ids_crc32 read back from them."""
    return tokens.tokenized(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mixture),
    ("token-ID output", token_ids),
]

#: A trained classifier and fingerprints cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage wrote for itself, and its input, goes once its result is written."""
    docs, written = read_table(spark, sf_dir, "documents"), False
    for _, stage in STAGES:
        with scratch(spark) as keep:
            made = stored(stage(spark, docs, sf_dir))
            keep.append(made)
        if written:
            drop_stored(docs)
        docs, written = made, True
    return docs
