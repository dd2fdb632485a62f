"""Language identification by hyperdimensional profiles (operator 10).

Each letter, whatever its script, has a random bipolar vector of ``DIMENSIONS``
entries, made from its number by a hash. A trigram is bound by multiplying the vectors
of its letters, the first permuted twice and the second once; a text or a language is
the sum (bundle) of its trigrams' vectors, and a text takes the language whose
prototype has the highest cosine with it.

Learning is one pass over all learning rows: every task bundles its rows into one
partial prototype per language, and those are summed by language, so the driver
gets ``DIMENSIONS`` numbers per language. Bundling is linear, so a text's dot
product with a prototype is the sum over its trigrams of the trigram's own dot
product; a worker computes that once for each trigram that it meets and keeps it
in a table of at most ``TABLE_BYTES``, whatever the number of languages and letters.
A text's norm is the same for every language and is taken from its trigram counts
(random vectors are nearly orthogonal); it does not change which language wins.

Defined cases: a null text, or one without a letter, gets ``und`` and score 0;
rows with a null lang or null text teach nothing; with no learning rows at all
every text gets ``und``; equal scores go to the first language by code point;
repeated rows are scored alike; a text beyond ``CHARS`` characters is read in parts,
cut at blanks, whose counts are added up; an empty table gives an empty result;
columns besides doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, read_table

DIMENSIONS = 1024
#: A letter's number has so many bits, a trigram's code three times as many; the rest of 64 name the text within a group.
LETTER = np.uint64(18)
CODE = np.uint64(54)
TEXTS = 1 << 10
MAX_LANGUAGES = 1000
CHARS = 1 << 18
TABLE_BYTES = 64 << 20
BLOCK = 2048
_MASK = np.uint64((1 << 18) - 1)
_CACHE: dict = {}


def symbols() -> np.ndarray:
    """Number of every code point: 0 for what is no letter, letters counted from 1."""
    if "symbols" not in _CACHE:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _CACHE["symbols"] = np.where(letter, np.cumsum(letter), 0).astype(np.uint64)
    return _CACHE["symbols"]


def letter_bits(numbers: np.ndarray) -> np.ndarray:
    """The letters' vectors as bits (1 stands for -1), a row each."""
    seeds = numbers[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    return np.unpackbits(mix(seeds).view(np.uint8), axis=1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """The trigrams' bound vectors, float32, a row each."""
    numbers, which = np.unique(np.concatenate((codes >> (LETTER + LETTER), (codes >> LETTER) & _MASK, codes & _MASK)), return_inverse=True)
    bits, n = letter_bits(numbers), len(codes)
    bound = np.roll(bits, 2, axis=1)[which[:n]] ^ np.roll(bits, 1, axis=1)[which[n : 2 * n]] ^ bits[which[2 * n :]]
    return 1 - 2 * bound.astype(np.float32)


def profile(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram code, count) of the trigrams around a letter of at most TEXTS texts, in order; runs of non-letters count as one."""
    low = [t.lower() for t in texts]
    joined = "\n" + "\n\n".join(low) + "\n"
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    sym = symbols()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(lengths + 2)
    keep = np.empty(len(sym), bool)
    keep[0] = True
    np.logical_or(sym[1:] != 0, sym[:-1] != 0, out=keep[1:])
    keep[ends[:-1]] = True  # the boundary that begins each text
    kept = np.concatenate(([0], np.cumsum(keep)))
    s = sym[keep]
    edges = kept[np.concatenate(([0], ends))]
    of = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(edges))
    inside = (s[1:-1] != 0) & (of[:-2] == of[2:])  # the middle is a letter, all in one text
    key = np.sort(((of[:-2] << CODE) | (s[:-2] << (LETTER + LETTER)) | (s[1:-1] << LETTER) | s[2:])[inside])
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return (key[cut] >> CODE).astype(np.int64), key[cut] & ((np.uint64(1) << CODE) - np.uint64(1)), np.diff(np.append(cut, len(key))).astype(np.float64)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with its counts added up."""
    found, which = np.unique(codes, return_inverse=True)
    return found, np.bincount(which, weights=counts, minlength=len(found))


def long_profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of a text of any length, in parts that end at blanks."""
    codes, counts, at = np.zeros(0, np.uint64), np.zeros(0), 0
    while at < len(text):
        to = at + CHARS
        if to < len(text):
            back = max(text.rfind(" ", at + 1, to), text.rfind("\n", at + 1, to))
            on = text.find(" ", to)
            to = back if back > 0 else on if on > 0 else len(text)
        _, c, n = profile([text[at:to]])
        codes, counts = summed(np.concatenate((codes, c)), np.concatenate((counts, n)))
        at = to
    return codes, counts


def profiles(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last + 1, text from first on, code, count) of runs of texts of CHARS characters together, or of one longer text."""
    at = size = 0
    for k, t in enumerate([*texts, None]):
        if k > at and (t is None or size + len(t) > CHARS or k - at == TEXTS):
            if k - at == 1 and size > CHARS:
                codes, counts = long_profile(texts[at])
                yield at, k, np.zeros(len(codes), np.int64), codes, counts
            else:
                yield at, k, *profile(texts[at:k])
            at, size = k, 0
        size += len(t or "")


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' vectors."""
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(codes), BLOCK):
        out += counts[at : at + BLOCK] @ vectors(codes[at : at + BLOCK])
    return out


class Table:
    """Dot products of trigrams' vectors with the prototypes, for the trigrams met so far."""

    def __init__(self, prototypes: np.ndarray, most_bytes: int = TABLE_BYTES):
        self.prototypes = prototypes.astype(np.float32).T
        self.most = max(1, most_bytes // (8 + 4 * len(prototypes)))
        self.codes, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(prototypes)), np.float32)

    def made(self, codes: np.ndarray) -> np.ndarray:
        parts = [vectors(codes[at : at + BLOCK]) @ self.prototypes for at in range(0, len(codes), BLOCK)]
        return np.concatenate(parts) if parts else self.rows[:0]

    def dots(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        new = np.unique(codes[self.codes[at] != codes] if len(self.codes) else codes)
        if not len(new):
            return self.rows[at]
        if len(self.codes) + len(new) > self.most:  # what it held goes
            self.codes, self.rows = new[: self.most], self.made(new[: self.most])
            if len(new) > self.most or not np.isin(codes, self.codes).all():
                out = np.empty((len(codes), self.rows.shape[1]), np.float32)
                for k in range(0, len(codes), BLOCK):
                    own, which = np.unique(codes[k : k + BLOCK], return_inverse=True)
                    out[k : k + BLOCK] = self.made(own)[which]
                return out
        else:
            self.codes, self.rows = np.concatenate((self.codes, new)), np.concatenate((self.rows, self.made(new)))
            order = np.argsort(self.codes)
            self.codes, self.rows = self.codes[order], self.rows[order]
        return self.rows[np.searchsorted(self.codes, codes)]


def table(prototypes: np.ndarray) -> Table:
    """The worker's table for these prototypes."""
    key = prototypes.tobytes()
    if _CACHE.get("key") != key:
        _CACHE.update(key=key, table=Table(prototypes))
    return _CACHE["table"]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their prototypes (language by dimension, unit length), from all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sums: dict[str, np.ndarray] = {}
        held = 0
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, _, _, codes, counts in profiles(texts):
                    seen.setdefault(lang, []).append(summed(codes, counts))
                    held += len(seen[lang][-1][0])
            if held > 500_000:
                seen = {lang: [summed(*map(np.concatenate, zip(*parts, strict=True)))] for lang, parts in seen.items()}
                held = sum(len(parts[0][0]) for parts in seen.values())
                if held > 250_000:
                    for lang, parts in seen.items():
                        sums[lang] = sums.get(lang, 0) + bundle(*parts[0])
                    seen, held = {}, 0
        for lang, parts in seen.items():
            sums[lang] = sums.get(lang, 0) + bundle(*summed(*map(np.concatenate, zip(*parts, strict=True))))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    vectors_ = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    rows = sorted(vectors_.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r.lang)
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = np.array([r.v for r in rows]).reshape(len(rows), DIMENSIONS).round(3)
    return [r.lang for r in rows], found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (share of the best cosine in the sum of the positive ones), margin (best less second cosine)."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, protos = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score, margin = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b, of, codes, counts in profiles(texts) if names else ():
                n = b - a
                has = np.bincount(of, minlength=n) > 0
                dots = np.stack([np.bincount(of, weights=col * counts, minlength=n) for col in table(protos).dots(codes).T], axis=1)
                norm = np.sqrt(DIMENSIONS * np.bincount(of, weights=counts**2, minlength=n))
                cosine = dots / np.maximum(norm, 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                plus = np.maximum(cosine, 0)
                share = np.divide(plus.max(axis=1), plus.sum(axis=1), out=np.zeros(n), where=plus.sum(axis=1) > 0)
                second = np.partition(cosine, -2, axis=1)[:, -2] if len(names) > 1 else np.zeros(n)
                pred[a:b] = np.where(has, np.array(names, object)[best], "und")
                score[a:b], margin[a:b] = np.where(has, share, 0), np.where(has, cosine.max(axis=1) - second, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(margin)], names=["doc_id", "lang_pred", "score", "margin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_hyperdimensional_language(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return predict(docs, *model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "margin")
