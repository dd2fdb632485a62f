"""Operator 13 against a search of every place by a table of edit costs."""

import random
import re

import pytest

from mnemora.llm import licenses
from mnemora.llm.licenses import NOTICES, PHRASES, Notice, Scanner

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FAR = 10**6


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def fewest_edits(notice, text):
    """The smallest number of edits with which the notice stands anywhere in text; None: too many. By dynamic programming, each stretch within its own edits."""
    n = len(text)
    best = [0] * (n + 1)
    for said, _, k in notice.parts:
        rows = [[best[j - c] + c if j >= c else FAR for j in range(n + 1)] for c in range(k + 1)]
        for ch in said:
            after = [[FAR] * (n + 1) for _ in range(k + 1)]
            for c in range(k + 1):
                for j in range(n + 1):
                    ways = [rows[c][j - 1]] if j and text[j - 1] == ch else []
                    if c:
                        ways.append(rows[c - 1][j] + 1)
                        if j:
                            ways += [rows[c - 1][j - 1] + 1, after[c - 1][j - 1] + 1]
                    after[c][j] = min(ways, default=FAR)
            rows = after
        best = [min(rows[c][j] for c in range(k + 1)) for j in range(n + 1)]
    return min(best) if min(best) < FAR else None


def plain(text):
    """What the query returns for one text, from words and fewest_edits."""
    words = words_of(text)
    places = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    joined = f" {' '.join(words)} "
    found = {label for _, label in places}
    score = 1.0 if places else 0.0
    for n in (Notice(*x) for x in NOTICES):
        if (edits := fewest_edits(n, joined)) is not None:
            found.add(n.label)
            score = max(score, 1 - edits / n.size)
    firsts = [i for i, _ in places]
    return len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(found)), score


CASES = [
    None, "", " \n\t.", "MIT", "cc by nc", "CC-BY-NC 4.0; cc by nc cc by nc", "Under the MIT License. under the mit license", "under the mitlicense, xunder the mit license",
    "Apache License,\x0bVersion\x1c2.0", "apache license version 20", "Licensed under the Apache Licence, Version 2.0", "Licensed under the Apache Lisense Version 1.1",
    "Released undr the MIT license", "released under the mat license", "All right reserved", "naïve écrit cc by ncé cc by nc", "GNU Lesser General Public Licence",
    "Permission is hereby granted, fre of charge, to any persn obtaining a copy of this software", "you may not use this file exept in compliance with the licence",
]


def shown(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def test_cases_equal_a_plain_search(spark):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate([*CASES, CASES[6]])], "doc_id long, text string, labels string, score string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(CASES) + 1
    for k, t in enumerate([*CASES, CASES[6]]):
        want = plain(t)
        assert shown(got[k])[:6] == want[:6] and got[k].score == pytest.approx(want[6]), t


def test_mutated_notices_equal_a_plain_search():
    rng, scan = random.Random(11), Scanner()
    for _ in range(250):
        notice = rng.choice(scan.notices)
        said = list("".join(t for t, _, _ in notice.parts))
        for _ in range(rng.randint(0, notice.edits + 2)):
            at, kind = rng.randrange(len(said)), rng.choice("sid")
            said[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("abcdeé9 ")]
        text = f" {' '.join(('foo bar ' * rng.randint(0, 2) + ''.join(said) + ' baz' * rng.randint(0, 2)).split())} ".encode()
        _, pieces = scan.hits(text)
        k = scan.notices.index(notice)
        found = scan.judged(text, notice, [p - at for p, n, at in pieces if n == k])
        assert min((e for _, _, e in found), default=None) == fewest_edits(notice, text.decode()), (notice.words, text)
        assert all(text[a:b].decode("utf-8") for a, b, _ in found)


def test_long_texts_full_of_notices(spark):
    n = 3000
    text = "Lorem Licensed under the Apache License, Verzion 2.0. " * n
    got = licenses.scan(spark.createDataFrame([(None, text)], "doc_id string, text string")).first()
    assert got.labels == "apache-2" and got.n_base == 0 and len(got.spans) == n
    assert [s.first_word for s in got.spans[:3]] == [1, 10, 19] and {s.edits for s in got.spans} == {1}
    filled = licenses.scan(spark.createDataFrame([(1, "word " * 400_000 + "under the MIT license")], "doc_id long, text string")).first()
    assert (filled.n_words, filled.first_word, filled.last_word) == (400_004, 400_000, 400_000)


def test_empty_table_and_other_notices(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "this is a private memorandum of ours"), (2, "a public one")], "doc_id long, text string")
    got = licenses.scan(docs, phrases=[("public one", "p")], notices=[("secret", "this is a private memorandun")])
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "secret", 2: "p"}
    assert {r.labels for r in licenses.scan(docs, phrases=[], notices=[]).collect()} == {""}


def test_query_over_the_table(spark):
    got = licenses.op13_fuzzy_licenses(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = got.collect()
    assert len(found) == len(docs)
    for r in found:
        words = words_of(docs[r.doc_id])
        places = [i for p, _ in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
