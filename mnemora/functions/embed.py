"""Vectors: cosine, and a deterministic hash embedder for use without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 32
# What instruction-tuned models want before a query and a passage, by part of the model's name.
INSTRUCTIONS = (
    ("bge", "Represent this sentence for searching relevant passages: ", ""),
    ("nomic-embed", "search_query: ", "search_document: "),
    ("e5-", "query: ", "passage: "),
)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embed(text: pd.Series) -> pd.Series:
    """Counts of the words' md5 modulo WIDTH, to unit length."""

    return text.map(_hashed)


def _place(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()) % WIDTH


_known_place = lru_cache(maxsize=200_000)(_place)


def _hashed(x: str | None) -> list[float]:
    places = [_known_place(word) if len(word) <= 64 else _place(word) for word in (x or "").lower().split()]
    v = np.bincount(np.array(places, np.int64), minlength=WIDTH)
    return (v / (np.linalg.norm(v) or 1)).tolist()


@dataclass(frozen=True)
class Embedder:
    """The seam for a model: `load` is called once in each worker and gives a function of a list of texts to a list of vectors.

    Passages and queries get the model's own prefixes (instruct=False: none). The default needs no model.
    """

    model: str = "hash"
    load: Callable[[], Callable[[list[str]], list[list[float]]]] = lambda: lambda texts: [_hashed(t) for t in texts]
    instruct: bool = True
    batch: int = 256

    def prefixes(self) -> tuple[str, str]:
        """Before a query, before a passage."""
        found = next(((q, p) for part, q, p in INSTRUCTIONS if part in self.model.lower()), ("", ""))
        return found if self.instruct else ("", "")

    @cached_property
    def dim(self) -> int:
        return len(self.load()(["probe"])[0])

    def _column(self, prefix: str):
        load, size = self.load, self.batch

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def embedded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for part in parts:
                texts = [prefix + (t or "") for t in part]
                vectors = [v for at in range(0, len(texts), size) for v in model(texts[at : at + size])]
                yield pd.Series([np.asarray(v, np.float32) for v in vectors], dtype=object)

        return embedded

    def passages(self, rows: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
        """rows with the vectors of a column of passages."""
        return rows.withColumn(name, self._column(self.prefixes()[1])(F.col(text)))

    def queries(self, rows: DataFrame, text: str = "query", name: str = "embedding") -> DataFrame:
        return rows.withColumn(name, self._column(self.prefixes()[0])(F.col(text)))
