"""The corpus pipeline against a plain version of each stage's decision."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from mnemora.llm import common, similar, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = re.compile(r"[^\x00-/:-`{-\x7f]+")
VOCABULARY = ["".join(np.random.default_rng(70 + k).choice(list("abcdefghijklmnoé"), 2 + k % 6)) for k in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def changed(text, seed, at):
    words = text.split()
    for k in at:
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    items = [(k, prose(25, 9000 + k)) for k in range(5)] + [(5, "one two three"), (6, None)]
    said = {k: prose(80 + k % 50, k) for k in range(240)}
    junk = {k: " ".join(w for x in prose(10, k).split() for w in [x] * 9) for k in range(240, 330)}
    copies = {330 + k: said[k] for k in range(20)} | {350 + k: changed(said[k], k, (20, 60)) for k in range(40)} | {390 + k: changed(said[7], k, (3 + k % 60,)) for k in range(30)}
    leaks = {420 + k: f"{prose(60, 500 + k)} {items[k % 5][1].upper()} {prose(60, 800 + k)}" for k in range(15)}
    texts = said | junk | copies | leaks | {440: None, 441: "", 442: "tiny"}
    rows = [(k, t, "en", [None, "a", "b", "hot", "hot"][k % 5], len(t or "")) for k, t in texts.items()] + [(5, said[5], "en", "a", 1), (None, prose(90, 4000), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k not in junk), 0) for k in texts if k < 330], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def shingles(text):
    return set(similar.shingle_sets(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0].tolist())


def leaks(text, items):
    w = CLEAN.findall((text or "").lower())
    for q in items:
        q = CLEAN.findall((q or "").lower())
        n = min(5, len(q))
        grams = lambda x, n=n: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        if n and len(grams(q) & grams(w)) >= 0.8 * len(grams(q)):
            return True
    return False


def test_every_stage_decides_as_its_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    at = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder))
        at.append(docs.collect())
        assert docs.columns == columns or len(at) == 5
    good, single, clean, mixed, ids = at
    # 1: repeated-word junk goes, all others stay.
    kept = {r.doc_id for r in good}
    assert not kept & set(range(240, 330)) and kept >= set(range(240)) | set(range(330, 435))
    # 2: one text of each group of similar ones, that of the smallest id.
    groups: list[list] = []
    for r in sorted(good, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        own = shingles(r.text)
        near = [g for g in groups if any(len(own & s) >= 0.8 * len(own | s) for _, s in g)]
        merged = [x for g in near for x in g] + [(r.doc_id, own)]
        groups = [g for g in groups if g not in near] + [merged]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single) == sorted(min((d is None, d or 0) for d, _ in g) for g in groups)
    # 3: texts that hold an item go.
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not leaks(r.text, items)} and len(clean) < len(single)
    # 4: whole documents, each at most twice, near the targets.
    size = lambda r: len(WORD.findall(r.text or ""))
    want = 1.5 * sum(map(size, clean))
    assert abs(sum(map(size, mixed)) - want) <= 4 * max(map(size, clean))
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in clean}
    # 5: the ids of every text of the mix, in order.
    whole = tokens.pieces(tokens.vocabulary_path()).whole
    order = sorted(mixed, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    made = [np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in order]
    got = sorted(ids, key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(r.doc_id, len(x), zlib.crc32(x.tobytes())) for r, x in zip(order, made, strict=True)]


def test_run_gives_the_same_rows_and_leaves_one_table(spark, folder):
    name = spark.sparkContext.applicationId
    before = len(common._MADE.get(name, ()))
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) for _ in range(2))
    assert first == second and first
    fs = spark._jvm.org.apache.hadoop.fs.Path(common._MADE[name][-1]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = [p for p in common._MADE[name][before:] if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert len(left) == 2


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
