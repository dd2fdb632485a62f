"""License scans by fuzzy search for short notices (operator 13).

A text is reduced to its lower-case words, joined by single spaces. A notice is a short
text of which some words, in braces, must stand exactly (names and versions: one edit would make
another license of them); each stretch between them may have one edit (a character put in,
left out or changed) for every ``EDIT_EACH`` characters, ``MOST_EDITS`` at most. A stretch with k edits, cut
into k + 1 pieces, has at least one piece untouched, so every occurrence holds one
of the pieces of the notice's best stretch (that whose shortest piece is longest). One pass of an
automaton finds all pieces and all phrases; a piece says where its notice would begin,
and the regex library's bounded-error matching judges the few characters there. It
finds the occurrence of the fewest edits and its span.

Scale: one pass over the rows, nothing is shuffled or broadcast; memory holds a chunk of
texts or the longest text. A text full of notices is searched in windows of a notice's length, so
the work follows its length.

Defined cases: null and blank texts have no words, no labels and the score 0; repeated
rows are scanned each on its own; an empty table gives an empty result; doc_id may be of any type
or null; further columns, whatever their names, are ignored by ``scan``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, read_table

#: Word bytes are kept, A-Z in lower case; all other bytes part words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
EDIT_EACH, MOST_EDITS = 9, 3

#: The phrases that are labelled wherever their words stand.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label and words of the short notices; words in braces stand exactly.
NOTICES = (
    ("mit", "released under the {mit} license"),
    ("mit", "licensed under the {mit} license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the {apache} license version {2}"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-3", "gnu general public license version {3}"),
    ("gpl-2", "gnu general public license version {2}"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "gnu {lesser} general public license"),
    ("agpl", "gnu {affero} general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("mpl-2", "subject to the terms of the mozilla public license v {2}"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under {cc by nc}"),
    ("cc-by-sa", "licensed under {cc by sa}"),
    ("cc-by-nc", "creative commons attribution {noncommercial}"),
    ("cc-by-sa", "creative commons attribution {sharealike}"),
    ("cc0", "creative commons {zero} public domain dedication"),
    ("all-rights-reserved", "all rights reserved"),
)


@dataclass(frozen=True)
class Notice:
    """A label and its words; see the module."""

    label: str
    words: str

    @cached_property
    def parts(self) -> list[tuple[str, bool, int]]:
        """(text, exact, edits) of the stretches in order."""
        out = []
        for k, said in enumerate(re.split(r"[{}]", self.words)):
            if said:
                out.append((said, k % 2 == 1, 0 if k % 2 else min(MOST_EDITS, len(said) // EDIT_EACH)))
        return out

    @property
    def size(self) -> int:
        return sum(len(t) for t, _, _ in self.parts)

    @property
    def edits(self) -> int:
        return sum(k for _, _, k in self.parts)

    def seeds(self) -> list[tuple[str, int]]:
        """(piece, its place in the notice) of the stretch whose shortest piece is longest."""
        at, best = 0, []
        for said, _, k in self.parts:
            cuts = [len(said) * i // (k + 1) for i in range(k + 2)]
            pieces = [(said[a:b], at + a) for a, b in zip(cuts, cuts[1:], strict=False)]
            if not best or min(len(p) for p, _ in pieces) > min(len(p) for p, _ in best):
                best = pieces
            at += len(said)
        return best

    @cached_property
    def pattern(self) -> regex.Pattern:
        each = (regex.escape(t) if not k else f"(?:{regex.escape(t)}){{e<={k}}}" for t, _, k in self.parts)
        return regex.compile("".join(each), regex.BESTMATCH)

    @cached_property
    def musts(self) -> list[bytes]:
        return [t.encode() for t, exact, _ in self.parts if exact]


class Scanner:
    """The automaton of all phrases and pieces, and the judgement of where they stand."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES):
        self.phrases, self.notices = [(p.encode(), label) for p, label in phrases], [Notice(*n) for n in notices]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (p, _) in enumerate(self.phrases):
            found.setdefault(f" {p.decode('latin-1')} ", []).append((-1 - k, 0))
        for k, n in enumerate(self.notices):
            for piece, at in n.seeds():
                found.setdefault(piece.encode().decode("latin-1"), []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for said, of in found.items():
            self.automaton.add_word(said, (len(said), of))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(place of the first word, phrase) of phrases, and (place, notice, place in the notice) of pieces, in bytes."""
        places, pieces = [], []
        if len(self.automaton):
            for end, (size, of) in self.automaton.iter(text.decode("latin-1")):
                for k, at in of:
                    if k < 0:
                        places.append((end - size + 2, -1 - k))
                    else:
                        pieces.append((end - size + 1, k, at))
        return places, pieces

    def judged(self, text: bytes, notice: Notice, begins: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of a notice's occurrences; of those that overlap the one of the fewest edits, then the first."""
        k, found = notice.edits, []
        slack = 4 * k  # an edit is one code point: up to four bytes
        begins = sorted(set(begins))
        at = 0
        while at < len(begins):
            to = at
            while to + 1 < len(begins) and begins[to + 1] <= begins[at] + k:
                to += 1
            a, b = max(0, begins[at] - slack), min(len(text), begins[to] + notice.size + slack)
            while a > 0 and text[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(text) and text[b] & 0xC0 == 0x80:
                b += 1
            window = text[a:b]
            if all(m in window for m in notice.musts):
                said = window.decode("utf-8", "replace")
                if m := notice.pattern.search(said):
                    found.append((sum(m.fuzzy_counts), a + len(said[: m.start()].encode()), a + len(said[: m.end()].encode())))
            at = to + 1
        out: list[tuple[int, int, int]] = []
        for edits, start, end in sorted(set(found), key=lambda x: (x[1], x[2])):
            if out and start < out[-1][1]:
                if edits < out[-1][2]:
                    out[-1] = (start, end, edits)
            else:
                out.append((start, end, edits))
        return out

    def document(self, text: bytes, places: list[tuple[int, int]], begins: dict[int, list[int]]) -> dict:
        """What one text, as " words ", says."""
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        word = lambda p: int(np.searchsorted(spaces, p, side="right")) - 1
        spans = [(self.phrases[k][1], word(p), word(p + len(self.phrases[k][0]) - 1), 0) for p, k in places]
        base, score = sorted({s[0] for s in spans}), 1.0 if spans else 0.0
        firsts = [s[1] for s in spans]
        for k, starts in begins.items():
            notice = self.notices[k]
            for start, end, edits in self.judged(text, notice, starts):
                spans.append((notice.label, word(max(1, start)), word(max(1, end - 1)), edits))
                score = max(score, 1 - edits / notice.size)
        return {
            "n_base": len(places), "first_word": min(firsts, default=None), "last_word": max(firsts, default=None),
            "base_labels": ",".join(base), "labels": ",".join(sorted({s[0] for s in spans})), "score": score,
            "spans": sorted(set(spans), key=lambda s: (s[1], s[2], s[0], s[3])),
        }

    def texts(self, data: bytes, offsets: np.ndarray) -> Iterator[tuple[int, dict]]:
        """(number of words, what it says) of each text of a chunk."""
        low = data.translate(_WORDS)
        split = [low[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        each = [b" " + b" ".join(w) + b" " for w in split]
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in each])))
        places, pieces = self.hits(b"\n".join(each))
        of: dict[int, tuple[list, dict]] = {}
        held = lambda at: of.setdefault(int(np.searchsorted(starts, at, side="right")) - 1, ([], {}))
        own = lambda at: at - int(starts[np.searchsorted(starts, at, side="right") - 1])
        for p, k in places:
            held(p)[0].append((own(p), k))
        for p, k, at in pieces:
            held(p)[1].setdefault(k, []).append(own(p) - at)
        for d, words in enumerate(split):
            yield len(words), self.document(each[d], *of[d]) if d in of else NOTHING


NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
_COLUMNS = (("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, last_word: bigint, edits: int>>"


@lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    """One for each worker."""
    return Scanner(phrases, notices)


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """Of every row: doc_id, n_words, the phrases' places (n_base, first_word, last_word, base_labels), labels, score, spans.

    score is the largest share of a notice that stands unedited: 1 where a phrase or a whole notice
    stands, 0 where nothing does. spans are label, first and last word, edits.
    """
    phrases, notices = tuple(map(tuple, phrases)), tuple(map(tuple, notices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(phrases, notices)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, offsets in chunks(texts):
                said = list(found.texts(data.tobytes(), offsets))
                of = [x for _, x in said]
                spans = pa.array([[dict(zip(("label", "first_word", "last_word", "edits"), s, strict=True)) for s in x["spans"]] for x in of], _SPANS)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([n for n, _ in said], pa.int64()), *(pa.array([x[c] for x in of], t) for c, t in _COLUMNS), spans], names=["doc_id", "n_words", *(c for c, _ in _COLUMNS), "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op13_fuzzy_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long"))
