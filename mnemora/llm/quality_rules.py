"""Line-first quality rules (operator 4).

Every line is judged on its own (punctuation, navigation, boilerplate, symbols,
capitals, repeats); failing lines go, and a document that loses too large a share of
its words goes with them. All counts are taken by numpy over the bytes of a
chunk of documents; nothing is shuffled, so the operator is one pass over the
input and its memory is bounded by a chunk or the longest document.

Defined cases: a null or blank text has no words, fails the base rules and is
not kept; repeated rows are judged alike, each on its own; an empty table gives
an empty result; further columns, whatever their names, are ignored by
``judge`` and passed through unchanged by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Prefix, chunks, per_doc, read_table, windows, words_of

SYMBOLS = "#*$%&|<>"
TERMINAL = b".!?:;\"')]}"
#: Endings of several bytes: ellipsis, closing quotes, full-width stops.
TERMINAL_UTF8 = ("…", "”", "’", "»", "。", "！", "？")
#: Whole words only; the same text is the SQL twin's pattern. Letters with marks stand in both cases, as bytes are compared.
BOILERPLATE = (
    r"\b(licen[sc]ed under|all rights reserved|terms of (use|service)|privacy policy|(use|uses|accept|accept all) cookies|cookie (policy|settings|preferences|notice|consent)|"
    r"enable javascript|click here|sign (in|up)|log ?in|subscribe (now|to our)|share (this|on)|read more|copyright [0-9]+|powered by|skip to content|"
    r"general public license|creative commons|permission is hereby granted|"
    r"tous droits r(é|É)serv(é|É)s|mentions l(é|É)gales|conditions (d'|d’)utilisation|cliquez ici|lire la suite|se connecter|"
    r"alle rechte vorbehalten|datenschutzerkl(ä|Ä)rung|nutzungsbedingungen|impressum|hier klicken|weiterlesen|jetzt anmelden|"
    r"todos los derechos reservados|pol(í|Í)tica de privacidad|aviso legal|t(é|É)rminos de uso|leer m(á|Á)s)\b|"
    r"\bcopyright (\(c\)|©)|\bpolitique de confidentialit(é|É)|\bha(z|ga) clic aqu(í|Í)|\biniciar sesi(ó|Ó)n"
)
_BOILERPLATE = re.compile(BOILERPLATE.encode(), re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: A line fails the punctuation rule with this many words or more, no closing mark and no sentence mark inside.
    unpunctuated_words: int = 6
    #: Shares within a line.
    max_symbols_per_word: float = 0.5
    max_upper_share: float = 0.7
    #: A line of navigation has at least so many separators, one for every so many words.
    nav_separators: int = 3
    nav_words_each: float = 3.0
    #: A document goes if its removed lines hold more than this share of its words.
    max_removed_share: float = 0.5


_IS = {k: np.zeros(256, bool) for k in ("symbol", "terminal", "upper", "lower", "nav", "sentence")}
for _k, _chars in (("symbol", SYMBOLS.encode()), ("terminal", TERMINAL), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("nav", b"|>"), ("sentence", b".!?")):
    _IS[_k][list(_chars)] = True


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the \\n-split lines; every document has one at least."""
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate((offsets[:-1], breaks + 1))
    doc = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.where(last, offsets[doc + 1], np.append(start[1:], 0) - 1)
    return start, end, doc


def repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the key occurs elsewhere in its document, whether it does so earlier)."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    d, k = doc[order], key[order]
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    again = np.zeros(len(key), bool)
    again[order[1:]] = same
    any_ = again.copy()
    any_[order[:-1]] |= same
    return any_, again


def judge_chunk(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and verdicts of the documents of a chunk, and the verdict on every line."""
    n = len(offsets) - 1
    start, end, doc = words_of(data, offsets)
    prefix = Prefix(data)
    n_words = np.bincount(doc, minlength=n)
    points = ((data & 0xC0) != 0x80) & ~SPACE[data]
    out = {"n_words": n_words, "word_chars": per_doc(points, offsets), "n_symbols": per_doc(_IS["symbol"][data], offsets)}

    hashes = prefix.of(start, end)
    w = rules.window
    inside = np.zeros(len(hashes), bool)
    if len(hashes) >= w:
        inside[: len(hashes) - w + 1] = doc[w - 1 :] == doc[: len(doc) - w + 1]
        at = np.flatnonzero(inside)
        twice, _ = repeated(doc[at], windows(hashes, w)[at])
        edges = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edges, at[twice], 1)
        np.add.at(edges, at[twice] + w, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(edges[:-1]) > 0], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)

    ls, le, ld = line_table(data, offsets)
    line_words = np.searchsorted(start, le) - np.searchsorted(start, ls)
    has = line_words > 0
    earlier = np.zeros(len(ls), bool)
    _, again = repeated(ld[has], prefix.of(ls[has], le[has]))
    earlier[has] = again
    out["n_dup_lines"] = np.bincount(ld[earlier], minlength=n)
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)

    def count(name: str) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(_IS[name][data])))
        return total[le] - total[ls]

    last_word = np.maximum(np.searchsorted(start, le) - 1, 0)
    tail = np.where(has, end[last_word] if len(end) else 0, 1)
    closed = np.ones(len(ls), bool)
    if len(data):
        closed = _IS["terminal"][data[tail - 1]]
        for mark in TERMINAL_UTF8:
            code = mark.encode()
            closed |= (tail >= len(code)) & np.logical_and.reduce([data[np.maximum(tail - len(code) + k, 0)] == c for k, c in enumerate(code)])
    upper, lower = count("upper"), count("lower")
    boiler = np.zeros(len(ls), bool)
    # Texts are told apart by a line break, which no rule matches, so that none reads its neighbour.
    apart = np.insert(data, offsets[1:-1], 10).tobytes()
    found = np.array([m.start() for m in _BOILERPLATE.finditer(apart)], np.int64)
    if len(found):
        found -= np.searchsorted(offsets[1:-1] + np.arange(1, n), found, side="right")
        boiler[np.searchsorted(ls, found, side="right") - 1] = True
    fails = {
        "unpunctuated": ~closed & (line_words >= rules.unpunctuated_words) & (count("sentence") == 0),
        "navigation": (count("nav") >= rules.nav_separators) & (count("nav") * rules.nav_words_each >= line_words),
        "boilerplate": boiler & (line_words <= 40),
        "symbols": count("symbol") > rules.max_symbols_per_word * line_words,
        "capitals": (upper > rules.max_upper_share * (upper + lower)) & (upper >= 20),
        "duplicate": earlier,
    }
    removed = np.logical_or.reduce(list(fails.values())) & has
    out["n_lines"] = np.bincount(ld[has], minlength=n)
    out["n_removed_lines"] = np.bincount(ld[removed], minlength=n)
    out["n_removed_words"] = np.bincount(ld, weights=np.where(removed, line_words, 0), minlength=n).astype(np.int64)
    out["kept"] = ~out["base_failed"] & (out["n_removed_words"] <= rules.max_removed_share * n_words)
    out["lines"] = (ls, le, ld, removed)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines", "n_removed_words")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, offsets in chunks(texts):
                got = judge_chunk(data, offsets, rules)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(got[k].astype(np.int64)) for k in COUNTS), pa.array(got["base_failed"]), pa.array(got["kept"])], names=["doc_id", *COUNTS, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, kept boolean")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents without their failing lines, all columns kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at)):
                got = judge_chunk(data, offsets, rules)
                ls, le, ld, removed = got["lines"]
                parts: list[list[bytes]] = [[] for _ in range(b - a)]
                for s, e, d in zip(ls[~removed], le[~removed], ld[~removed], strict=True):
                    parts[d].append(data[s:e].tobytes())
                columns = [c.slice(a, b - a) for c in batch.columns]
                columns[at] = pa.array([b"\n".join(p) for p in parts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(got["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op4_line_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", F.col("n_removed_words"))


SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), win as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as win from (select doc_id, words, unnest(generate_series(1, len(words) - 7)) as i from w where len(words) >= 8)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from win) where n > 1
), repeats as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + 7)) as p from twice) group by 1
), lines as (
  select doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words from (
    select doc_id, generate_subscripts(l, 1) as i, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from w))
), judged as (
  select doc_id, line, len(words) as n, row_number() over (partition by doc_id, line order by i) > 1 as dup,
    not regexp_matches(words[len(words)], '([.!?:;")}''\]]|…|”|’|»|。|！|？)$') and len(words) >= 6 and not regexp_matches(line, '[.!?]') as unpunctuated,
    len(regexp_extract_all(line, '[|>]')) as nav, len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols,
    len(regexp_extract_all(line, '[A-Z]')) as upper, len(regexp_extract_all(line, '[a-z]')) as lower,
    regexp_matches(line, '(?i)@boilerplate') and len(words) <= 40 as boiler
  from lines where len(words) > 0
), failed as (
  select *, dup or unpunctuated or (nav >= 3 and nav * 3.0 >= n) or boiler or symbols > 0.5 * n or (upper > 0.7 * (upper + lower) and upper >= 20) as fails from judged
), by_doc as (
  select doc_id, count(*) as n_lines, count(*) filter (dup) as n_dup_lines, count(*) filter (fails) as n_removed_lines, coalesce(sum(n) filter (fails), 0) as n_removed_words from failed group by 1
), counted as (
  select w.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_removed_lines, 0) as n_removed_lines, coalesce(n_removed_words, 0)::bigint as n_removed_words
  from w left join repeats r on r.doc_id = w.doc_id left join by_doc b on b.doc_id = w.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_removed_words <= 0.5 * n_words as kept, n_lines, n_removed_lines, n_removed_words
from counted
""".replace("@boilerplate", BOILERPLATE.replace("'", "''"))
