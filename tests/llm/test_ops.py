"""The operators against brute force, on small tables that hold the hard cases."""

import gzip
import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemora.llm import chat, decontaminate, language, mixing, quality_model, quality_rules, repeats, similar, simhash, tokens, warc
from mnemora.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(7)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnoé"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def texts():
    """Nulls, blanks, one word, copies, near copies, a long text, repeated lines, symbols, shared passages."""
    base, passage = prose(300, 1), prose(150, 2)
    near = base.split()
    near[100] = "changed"
    out = [None, "", " \n\t", "one", "one", base, base, " ".join(near), base.upper(), prose(20_000, 3)]
    out += [f"{prose(60, 10 + k)}\n{passage}\n{prose(40, 50 + k)}" for k in range(6)]
    out += ["same line here.\n" * 40, "ab " * 600, "x#$% | y " * 30, "naïve ÉCOLE straße.\x0b\x0cü\x1cq", "tiny text of five words", "tiny text of five words"]
    out += [prose(120, 100 + k) for k in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    said = texts()
    rows = [(k, t, [None, "en", "fr"][k % 3], [None, "b", "a", "a"][k % 4], len(t or ""), "x", k, k) for k, t in enumerate(said)]
    rows += [(3, "one", "en", "a", 3, "x", 0, 0), (None, "no id", "en", None, 5, "x", 0, 0), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


#: Names that the operators use inside, and some that look like it.
CLASHING = ("doc", "id", "row", "own", "h", "n", "j", "take", "copies", "key", "check", "fp", "root", "own_hash", "text_hash", "__row", "__n", "__x", "__id", "score", "size", "held_out", "col")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.drop("fp", "row", "h").select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("none"))).alias(c) for c in CLASHING])


def untouched(df):
    """Every further column still says its name and the row's text."""
    found = df.collect()
    for r in found:
        assert all(r[c] == f"{c}:{'none' if r.text is None else r.text}" for c in CLASHING)
    return found


def test_other_columns_are_ignored_or_passed_on(spark, clashing):
    n = clashing.count()
    assert mixing.mix(clashing).count() == simhash.cluster(clashing).count() == tokens.tokenized(clashing).count() == n
    assert repeats.without_repeats(clashing, passage=200).count() == quality_rules.judge(clashing).count() == n
    kept = quality_rules.clean(clashing)
    assert kept.columns == clashing.columns and all(r.doc.startswith("doc:") for r in kept.collect())
    items = spark.createDataFrame([(1, "no such item in any text")], "item_id long, text string")
    assert decontaminate.search(clashing, items).count() == 0
    extra = [F.lit("x").alias(c) for c in CLASHING]
    said = spark.createDataFrame([(1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string").select("*", *extra)
    assert chat.render(chat.fold(chat.as_events(said))).count() == 2
    pages = spark.createDataFrame([(1, "http://h/", "<p>a"), (None, None, None)], "page_id long, url string, html string").select("*", *extra)
    assert warc.read_images(warc.write_images(warc.responses(pages))).count() == 4


# --- 1 -----------------------------------------------------------------------


def test_targets_share_and_cap():
    sizes = pd.DataFrame({"source": ["b", None, "a", "c"], "total": [100, 50, 10, 40], "n_words_docs": [1, 1, 1, 1]})
    got = mixing.targets(sizes)
    assert got.source.tolist() == ["a", "b", "c", None]
    assert got.target.sum() == pytest.approx(300) and (got.target <= 2 * got.total + 1e-9).all()


def test_mix(docs):
    got = pd.DataFrame(rows(mixing.mix(docs)))
    sizes = [len(WORD.findall(r.text or "")) for r in docs.collect()]
    assert sorted(got["size"]) == sorted(sizes) and got["copies"].between(0, 2).all()
    for _, g in got.groupby(got.source.fillna("\U0010ffff")):
        assert g.source_size.iloc[0] == g["size"].sum()
        # Documents are whole: a source of one dominant document misses by up to half of it.
        assert abs((g["size"] * g["copies"]).sum() - g.target.iloc[0]) <= g["size"].max() / 2
    again = pd.DataFrame(rows(mixing.mix(docs.repartition(5), stratum=1)))
    assert sorted(again["size"]) == sorted(got["size"])
    same = pd.DataFrame(rows(mixing.mix(docs.repartition(1))))
    key = ["doc_id", "size", "row", "copies"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), same[key].sort_values(key).reset_index(drop=True))


def test_mixed_rows(docs, empty):
    plan = mixing.mix(docs)
    want = plan.agg(F.sum("copies")).first()[0]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == want
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(3)
    sizes = [(s, int(x)) for s in range(4) for x in rng.integers(1, 4000, 300)]
    histogram = spark.createDataFrame(sizes, "source_no long, size long").groupBy("source_no", "size").agg(F.count("*").alias("n"))
    total = [sum(x for s, x in sizes if s == k) for k in range(4)]
    goal = pd.DataFrame({"source": list("abcd"), "total": total, "n_words_docs": [300] * 4, "target": [total[0] * 2.0, total[1] * 1.99, total[2] * 1.0, total[3] * 0.01]})
    got = mixing.solve(histogram, goal)
    for k in range(1, 4):
        own = np.array([x for s, x in sizes if s == k], float)
        low, high = -200.0, 200.0
        for _ in range(200):  # the words taken grow with the multiplier
            mid = (low + high) / 2
            taken = (np.minimum(np.exp(np.minimum(mid * own / own.mean(), 700)), 2) * own).sum()
            low, high = (mid, high) if taken < goal.target[k] else (low, mid)
        assert got.lam[k] == pytest.approx(low, abs=1e-6)
    with pytest.raises(RuntimeError, match="not balanced"):
        mixing.solve(histogram, goal, steps=1)


def test_mix_meets_targets_with_hot_sizes(spark):
    rng = np.random.default_rng(9)
    said = [(k, prose(30, 1) if k % 3 == 0 else prose(int(rng.integers(1, 60)), k), "hot" if k % 3 < 2 else ["a", "b", None][k % 7 % 3]) for k in range(3000)]
    df = spark.createDataFrame(said, "doc_id long, text string, source string")
    for stratum in (4096, 50):
        got = pd.DataFrame(rows(mixing.mix(df, stratum=stratum)))
        assert len(got) == 3000 and got.copies.between(0, 2).all()
        for _, g in got.groupby(got.source.fillna("none")):
            # Large documents first: what is left is at most half of the smallest document.
            assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= max(1, g["size"][g["size"] > 0].min())
    assert got[got["size"] == 30].copies.nunique() <= 2 + 1


def test_mixed_keeps_clashing_columns(clashing):
    assert len(untouched(mixing.mixed(clashing))) > 0


# --- 2 -----------------------------------------------------------------------


def test_classifier_learns_and_scores_like_features(spark):
    good = [prose(80, k) for k in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(60, 500 + k).split()) if k % 2 else " ".join(w for x in prose(9, 900 + k).split() for w in [x] * 8) for k in range(40)]
    train = [(t.encode(), 1) for t in good[:40]] + [(t.encode(), 0) for t in bad[:25]]
    model = quality_model.train_texts(train * 4)
    held = spark.createDataFrame([(k, t) for k, t in enumerate(good[40:] + bad[25:] + ["", None])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_model.score(held, model).collect()}
    assert all(got[k] >= 0.3 for k in range(20)) and all(got[k] < 0.3 for k in range(20, 35)) and got[35] == got[36]
    for k, t in enumerate(good[40:] + bad[25:]):
        found, counts, n = quality_model.features(t.encode())
        z = float((counts.astype(float) * model.weights[found]).sum()) / n + model.bias
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_classifier_without_labels(spark, docs, empty):
    assert {r.score for r in quality_model.score(docs, quality_model.train_texts([])).collect()} == {0.5}
    assert quality_model.score(empty, quality_model.train_texts([(b"a", 1)])).count() == 0
    labels = spark.createDataFrame([(5, 1), (5, 1), (None, 1), (99999, 0), (6, None)], "doc_id long, quality int")
    assert [r.y for r in quality_model.labelled(docs, labels).collect()] == [1]


def test_grams_are_of_characters():
    grams, begins = quality_model._grams(np.frombuffer("éé aéé".encode(), np.uint8), np.array([0, 4, 10]))
    assert begins.tolist() == [0, 2, 6]
    again, _ = quality_model._grams(np.frombuffer(b"zz azz", np.uint8), np.array([0, 2, 6]))
    assert [ok.tolist() for _, ok in grams] == [ok.tolist() for _, ok in again]


def test_features_of_a_chunk_are_those_of_its_texts(spark):
    said = ["one two two two", "", "é" * 50 + " é", "x", "two two", None, "a b\nc"]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1)
    model = quality_model.Model(np.random.default_rng(0).normal(size=quality_model.ROWS).astype(np.float32), 0.25)
    got = {r.doc_id: r.score for r in quality_model.score(df, model).collect()}
    for k, t in enumerate(said):
        found, counts, n = quality_model.features((t or "").encode())
        z = float((counts.astype(float) * model.weights[found]).sum()) / max(n, 1) + model.bias
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


@pytest.fixture(scope="module")
def quality_tables(spark, tmp_path_factory):
    """Documents of two kinds, and labels; those of held-out rows are turned round in the second folder."""
    said = [(k, prose(60, k) if k % 3 else " ".join(w for x in prose(8, k).split() for w in [x] * 7)) for k in range(400)] + [(400, None), (401, ""), (None, "no id")]
    folders = []
    for turned in (False, True):
        d = str(tmp_path_factory.mktemp("quality"))
        spark.createDataFrame(said, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        marks = [(k, int(k % 3 > 0) ^ (turned and zlib.crc32(str(k).encode()) % 5 == 0)) for k in range(400)]
        spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
        folders.append(d)
    return folders


def test_held_out_labels_teach_nothing(spark, quality_tables):
    one, two = ({r.doc_id: (r.held_out, r.score, r.predicted) for r in quality_model.op2_subword_quality(spark, d).collect()} for d in quality_tables)
    assert one == two and all(one[k][0] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400))
    assert all(one[k][2] == int(k % 3 > 0) for k in range(400)) and one[400][1:] == one[401][1:] and not one[None][0]


def test_training_in_parts_learns_too(spark, quality_tables):
    docs, labels = (spark.read.parquet(f"{quality_tables[0]}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_model.labelled(docs, labels)
    model = quality_model.fit_rows(found, part_bytes=20_000, epochs=6)
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    assert sum((got[k] >= 0.3) == (k % 3 > 0) for k in range(400)) >= 390


def test_accepted_keeps_whole_rows(spark, clashing, quality_tables):
    kept = quality_model.accepted(spark, clashing, quality_tables[0])
    assert kept.columns == clashing.columns
    all_ = quality_model.score(clashing.select("doc_id", "text"), quality_model.fit(spark, clashing.select("doc_id", "text"), quality_tables[0]))
    assert len(untouched(kept)) == all_.where("score >= 0.3").count()
    assert quality_model.accepted(spark, clashing.limit(0), quality_tables[0]).count() == 0


# --- 3 -----------------------------------------------------------------------


def clean_words(t):
    return re.findall(r"[^\x00-/:-`{-\x7f]+", (t or "").lower())


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_containment(spark, docs, empty, most):
    said = texts()
    long = said[9].split()
    items = [" ".join(long[5000:5030]), " ".join(long[15000:15070]).upper(), "  ", None, "tiny text", " ".join([*long[40:60], "a", "b", "c"]), prose(30, 999), " ".join(prose(60, 10).split()[:8]), "one"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.search(docs, bench, most=most).collect()}
    want = {}
    for r in docs.collect():
        w = clean_words(r.text)
        for k, t in enumerate(items):
            q = clean_words(t)
            n = min(5, len(q))
            if n and (share := len(grams(q, n) & grams(w, n)) / len(grams(q, n))) >= 0.8:
                want[(r.doc_id, k)] = share
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {(9, 0), (9, 1), (9, 5)} <= set(got)
    assert decontaminate.search(empty, bench).count() == 0 and decontaminate.search(docs, bench.limit(0)).count() == 0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_small_items_are_never_missed(spark):
    said = [f"{prose(40, k)} zz{k} yy{k} xx{k} {prose(900, k + 500)}" for k in range(300)]
    docs_ = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    items = [(k, f"ZZ{k} yy{k}, xx{k}") for k in range(300)] + [(1000 + k, " ".join(said[k].split()[30 : 30 + n])) for k, n in enumerate((5, 6, 7, 8))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(docs_, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got >= {(k, k) for k in range(300)} | {(k, 1000 + k) for k in range(4)}


def test_decontaminate_keeps_clashing_columns(spark, clashing):
    bench = spark.createDataFrame([(1, prose(60, 10)), (None, None), (2, "")], "item_id long, text string")
    out = decontaminate.decontaminate(clashing, bench)
    assert out.columns == clashing.columns and len(untouched(out)) == clashing.count() - 1


# --- 4 -----------------------------------------------------------------------


def test_line_rules_counts(docs, empty):
    got = Counter(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows(quality_rules.judge(docs)))
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(win)
        covered = {p for i, x in enumerate(win) if n[x] > 1 for p in range(i, i + 8)}
        want[(r.doc_id, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
    assert got == want
    assert quality_rules.judge(empty).count() == 0 and quality_rules.clean(empty).count() == 0


def test_line_rules_sql(spark, docs):
    known = docs.where("doc_id is not null and doc_id <> 3 and doc_id <> 19")  # SQL tells rows by id; \x1c is no line break there
    documents = known.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(quality_rules.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules.judge(known).toPandas().sort_values("doc_id").reset_index(drop=True)[want.columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_clean_keeps_good_lines(spark):
    good = "\n".join(prose(25, k) + "." for k in range(9))
    df = spark.createDataFrame([(1, good + "\nHOME | NEWS | ABOUT | LOGIN | MORE\n" + good.split("\n")[0], "kept"), (2, "a | b | c | d\n" * 9, "gone")], "doc_id long, text string, note string")
    got = rows(quality_rules.clean(df))
    assert got == [{"doc_id": 1, "text": good, "note": "kept"}]


def test_neighbours_in_a_chunk_do_not_matter():
    said = ["Read the log", "in the morning they left.", "Please log", "", "in. Sign", "in now to all of it", "cookie policy", "all rights\nreserved", "copyright", " 2020 by us", "Mentions légales", "POLÍTICA de privacidad", "the catalog in prose, with cookies", *[prose(30, k) for k in range(4)]]
    rng = np.random.default_rng(2)
    for _ in range(30):
        order = rng.permutation(len(said))
        data = [said[k].encode() for k in order]
        together = quality_rules.judge_chunk(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))), quality_rules.Rules())
        for at, x in enumerate(data):
            alone = quality_rules.judge_chunk(np.frombuffer(x, np.uint8), np.array([0, len(x)]), quality_rules.Rules())
            assert all(together[c][at] == alone[c][0] for c in (*quality_rules.COUNTS, "kept", "base_failed"))
    boiler = {k for k, t in enumerate(said) if quality_rules._BOILERPLATE.search(t.encode())}
    assert {said[k] for k in boiler} == {"in. Sign", "cookie policy", "Mentions légales", "POLÍTICA de privacidad"} - {"in. Sign"}


def test_line_rules_of_a_very_long_text():
    lines = [f"{prose(12, k)}." for k in range(3000)]
    text = "\n".join([*lines, "HOME | NEWS | ABOUT | LOGIN", lines[0]] * 2).encode()
    got = quality_rules.judge_chunk(np.frombuffer(text, np.uint8), np.array([0, len(text)]), quality_rules.Rules())
    assert got["n_lines"][0] == 6004 and got["n_dup_lines"][0] == 3003 and got["n_removed_lines"][0] == 3004


# --- 5 -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 59, 60, 240, 1023, 1024, 1025, 3000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.zeros(n), rng.integers(0, 2, n), rng.integers(0, 2**63, n), (rng.random(n) < 0.05) * rng.integers(0, 2**63, n), 2.0 ** rng.integers(0, 63, n)):
        ids = ids.astype(np.uint64)
        assert (tokens.decode(*tokens.encode(ids), n) == ids).all()
    assert tokens.unpack(tokens.pack([(None, np.arange(n)), (5, np.arange(0))]))[0] == [None, 5]


def encoded(said, vocabulary, size=tokens.AT_ONCE):
    return [x.tolist() for x in tokens.token_ids(pa.array(said, pa.string()), vocabulary, size)]


ODD = ["Hello, WORLD's it's 12a <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é é İstanbul ẞ ΑΣ Σ", "a b c\x1cd \x85e ́x", "'tis ''s $$$5 ~~~ `x` a_b-c", "日本語 ñÑ ªº µ ÿŸ ﬁ", "a\xa0b c　d", "x" * 5000 + " " + "y" * 3000, "É×é÷ß.", None, ""]


@pytest.mark.parametrize("size", [1 << 20, 40, 3])
def test_tokens_of_odd_texts(size):
    vocabulary = tokens.pieces(tokens.vocabulary_path())
    rng = np.random.default_rng(5)
    letters = ["a", "B", "é", "É", "ß", "×", "à", "İ", "Σ", "'", "'s", "'LL", "1", "23", "<", "|", ">", "!", "...", "-", "—", "…", "́", " ", "\x1c", "\x85", "　", "日", "ﬁ", "ª", " ", "  ", "\n", "\t", "\x0b", "\r", "The", "word"]
    said = ODD + ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(500)]
    assert encoded(said, vocabulary, size) == [vocabulary.whole.encode(t or "", add_special_tokens=False).ids for t in said]


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    vocabulary = tokens.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    said = [*ODD, "Hello  World\n x"]
    assert not vocabulary.cuttable and encoded(said, vocabulary) == [vocabulary.whole.encode(t or "", add_special_tokens=False).ids for t in said]


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "one two"), (None, "x"), ("ä", None), ("a", "")], "doc_id string, text string")
    got = sorted(tokens.tokenized(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, "a", "b", "ä"] and [r.n_tokens for r in got] == [2, 1, 3, 1]


def test_tokens_equal_the_library(docs, empty):
    path = tokens.vocabulary_path()
    whole = tokens.pieces(path).whole
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_shards(tokens.write_shards(docs, path, partitions=3, shard_ids=500)).collect()]
    kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in kept]
    by_start = sorted(got, key=lambda x: x[1])
    assert [x[0] for x in by_start] == [d for d, _ in kept]
    assert [x[1] for x in by_start] == [0, *np.cumsum([x[2] for x in by_start])[:-1].tolist()]
    assert Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(kept, ids, strict=True)) == Counter((d, n, c) for d, _, n, c in got)
    assert tokens.tokenized(empty).count() == 0


# --- 6 -----------------------------------------------------------------------


def test_warc_records(spark):
    page = '<html><head><title>T &amp; t</title></head><body><nav>menu</nav><p>One<br>two &lt;3</p><a href="/x#y">go</a><a href="http://o.org/">o</a><script>no()</script></body></html>'
    df = spark.createDataFrame([(1, "http://h.org/a/b", page), (1, "http://h.org/a/b", page), (2, None, "plain"), (3, "http://e.org/", None)], "page_id long, url string, html string")
    made = rows(warc.derivatives(warc.responses(df)))
    assert len(made) == 8 and Counter(r["type"] for r in made) == {"metadata": 4, "conversion": 4}
    source = dict(warc.read_record(warc.response(1, "http://h.org/a/b", page))[0])
    for r in made:
        headers, block = warc.read_record(bytes(r["record"]))
        h = dict(headers)
        assert h["WARC-Block-Digest"] == warc.digest(block) and h["WARC-Refers-To"] == r["refers_to"] and h["WARC-Record-ID"] == r["record_id"]
        if r["page_id"] == 1:
            assert h["WARC-Refers-To"] == source["WARC-Record-ID"] and h["WARC-Target-URI"] == "http://h.org/a/b" and r["n_links"] == 2
            if r["type"] == "conversion":
                assert block.decode() == "One\ntwo <3\ngoo"
            else:
                assert b"outlink: http://h.org/x#y" in block and b"title: T & t" in block and source["WARC-Payload-Digest"].encode() in block
        if r["page_id"] == 2:
            assert "WARC-Target-URI" not in h
    broken = spark.createDataFrame([(9, bytearray(b"junk")), (8, None)], "page_id long, record binary")
    assert [r["type"] for r in rows(warc.derivatives(broken))] == ["error", "error"]
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_unclosed_elements_hide_nothing_after_them():
    assert warc.plain_text("<html><head><title>T</title><script>a('<p>')</script><meta charset=x><body><p>one</p>two") == "one\ntwo"
    for tag in ("nav", "footer", "noscript", "svg", "template"):
        assert warc.plain_text(f"<p>a</p><{tag} class='x'>b<p>c") == "a\nb\nc"
    assert warc.plain_text("<nav>x</nav>a<!-- b --><style>c</style>d<script>e") == "a d"


def test_source_headers_are_kept():
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("warc-payload-digest", "sha1:A"), ("WARC-Profile", "p"), ("X-Own", "o"), ("warc-date", warc.DATE)]
    record = warc.write_record(headers, b"HTTP/1.1 200 OK\r\n\r\nhello")
    _, info = warc.read_record(warc.derive(record)[0][-1])
    assert [x for x in info.decode().split("\r\n") if x.startswith("source-")] == ["source-warc-payload-digest: sha1:A", "source-warc-profile: p", "source-x-own: o"]


HOSTILE = ["<a ", '<a ">', '=">" <a ', "<!--", "<script>", "<nav>", "<title>", "&", "<a ='\">", " \n", "<a href=", '<a href="', "<", "</title", "<td></td>", "a<b>c", '<a href="/a.b/c?">', "<a x='"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    page = piece * (10_000_000 // len(piece) // (10 if piece == "&" else 1))
    began = time.perf_counter()
    read = warc.Page(page)
    read.text(), read.title(), read.links("http://h.org/")
    assert time.perf_counter() - began < 30


def test_long_links_take_linear_time():
    for target in ("/" + "a" * 200_000 + "?", "/" + "a/" * 100_000 + "?", "/" + "a." * 100_000 + ";"):
        assert len(warc.Page(f'<a href="{target}">x</a>').links("http://h.org/b")) == 1
    page = '<a href="/a/b/">1</a><a href="/./c">2</a><a href="//o/x">3</a><a href="/d//e">4</a><a href="/f?g#h">5</a><a href="/">6</a>'
    assert warc.Page(page).links("https://h.org/z/") == ["https://h.org/a/b/", "https://h.org/c", "https://o/x", "https://h.org/d//e", "https://h.org/f?g#h", "https://h.org/"]


def test_quotes_and_unfinished_tags():
    assert warc.plain_text('<p title="a>b">one</p><b x=\'>\'>two') == "one\ntwo"
    assert warc.plain_text('a<b x="1>two <c') == "atwo <c"
    assert warc.plain_text("1 < 2 <3 &amp; <p>4") == "1 < 2 <3 &\n4"
    assert warc.Page('<a href=x>1</a><nav><a HREF = "/y">2</a></nav><!--<a href=z>--><script>"<a href=w>"</script>').links("http://h/") == ["http://h/x", "http://h/y"]


def test_http_encodings():
    page = "<p>ok é</p>".encode()
    packed = gzip.compress(page)
    cut = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(x), x) for x in (packed[:7], packed[7:])) + b"0\r\n\r\n"

    def text_of(http, body):
        block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body
        record = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>")], block)
        return warc.read_record(warc.derive(record)[1][-1])[1].decode()

    assert text_of(b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", cut) == "ok é"
    assert text_of(b"content-encoding: deflate", zlib.compress(page)) == "ok é"
    assert text_of(b"content-encoding: deflate", zlib.compress(page)[2:-4]) == "ok é"
    assert text_of(b"X: y", page) == "ok é"
    for http, body in ((b"Content-Encoding: gzip", page), (b"Content-Encoding: br", page), (b"Transfer-Encoding: chunked", page), (b"Transfer-Encoding: chunked", b"ff\r\nab")):
        with pytest.raises(ValueError):
            text_of(http, body)


@pytest.mark.parametrize("image_bytes", [1, 1 << 20])
def test_images_are_read_back(spark, image_bytes):
    said = [(k, f"http://h.org/{k}", f"<title>t{k}</title><p>{prose(30, k)}<a href=/l{k}>x</a>") for k in range(20)] + [(20, None, None), (21, "http://h.org/", "")]
    pages = warc.responses(spark.createDataFrame(said, "page_id long, url string, html string")).unionByName(spark.createDataFrame([(30, bytearray(b"junk")), (31, None), (32, bytearray(warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<u>")], b"")))], "page_id long, record binary"))
    images = warc.write_images(pages, image_bytes)
    key = lambda r: (r["page_id"], r["type"], bytes(r["record"] or b""), r["error"])
    got, want = sorted(map(key, rows(warc.read_images(images)))), sorted(map(key, rows(warc.derivatives(pages))))
    assert got == want and sum(k[1] == "error" for k in got) == 3
    for r in images.collect():  # a .warc.gz file of its own
        raw = gzip.decompress(r.image)
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(b"WARC-Refers-To: ") == sum(e.error is None for e in r.entries)
    for r in rows(warc.read_images(images)):
        if r["type"] == "conversion":
            assert "WARC-Concurrent-To" not in dict(warc.read_record(bytes(r["record"]))[0])
    assert warc.read_images(warc.write_images(pages.limit(0))).count() == 0


# --- 7 -----------------------------------------------------------------------


def test_chat_folds_events(spark):
    log = [
        ("c", 1, "message", 1, "user", "hi"), ("c", 2, "message", 2, "assistant", ""), ("c", 4, "delta", 2, None, "b"), ("c", 3, "delta", 2, None, "a"),
        ("c", 5, "message", 3, "user", "more"), ("c", 6, "edit", 1, None, "hello"), ("c", 7, "regenerate", 2, None, None), ("c", 8, "delta", 2, None, "new"),
        ("c", 9, "delta", 9, None, "never opened"), (None, 1, "message", 1, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id string, seq long, kind string, msg long, role string, text string")
    got = sorted(((r.conv_id, r.msg, r.role, r.text) for r in chat.fold(df).collect()), key=str)
    assert got == sorted([("c", 1, "user", "hello"), ("c", 2, "assistant", "new"), (None, 1, "", "")], key=str)


def test_chat_round_trip(spark):
    odd = [None, "", "\\", "\\s\\h", "###", "####", "</turn>", "<</turn>\n### User: x", "a\\### b</turn", ": \\c", "é😀 ### "]
    said = spark.createDataFrame([(k % 3, k, ["user", "assistant", "ro:le</turn>"][k % 3], t) for k, t in enumerate(odd * 3)] + [(0, 0, "user", None), (0, None, "assistant", "first"), (0, None, None, None)], "conv_id long, turn long, role string, text string")
    kinds = {r.kind: r["count"] for r in chat.as_events(said).groupBy("kind").count().collect()}
    n = sum(r.role == "assistant" for r in said.collect())
    assert kinds["regenerate"] == n and kinds["edit"] == said.count() - n and kinds["message"] == said.count()
    back = chat.read_back(chat.render(chat.fold(chat.as_events(said)))).collect()
    for r in back:
        own = sorted((x for x in said.collect() if x.conv_id == r.conv_id), key=lambda x: (x.turn is not None, x.turn or 0, x.role or "", x.text is not None, x.text or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x.role or "", x.text or "") for x in own]
        assert r.loss_text == "".join(x.text or "" for x in own if x.role == "assistant")
    assert chat.render(chat.fold(chat.as_events(said.limit(0)))).count() == 0


# --- 8 -----------------------------------------------------------------------


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, empty):
    kept = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in kept]
    root = roots_of(len(kept), [(i, j) for i in range(len(kept)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for r, k in zip(kept, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, fps[i] - (fps[i] >> 63 << 64), least.get(root[i])) for i, r in enumerate(kept))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.cluster(docs).collect()) == want
    assert simhash.cluster(empty).count() == 0 and simhash.deduplicate(empty).count() == 0 and similar.deduplicate(empty).count() == 0


@pytest.mark.parametrize(("bits", "hot"), [(2, 20_000), (2, 3), (1, 20_000), (3, 20_000)])
def test_grid_join_finds_every_link(spark, bits, hot):
    rng = np.random.default_rng(bits)
    fps = set()
    for c in rng.integers(-(2**63), 2**63, 12):
        for _ in range(25):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            x &= 2**64 - 1
            fps.add(x - (x >> 63 << 64))
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, bits, hot).collect()}
    near = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= bits
    assert all(near(*p) for p in got)
    at = {x: i for i, x in enumerate(fps)}
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if near(fps[i], fps[j])]
    assert roots_of(len(fps), [(at[a], at[b]) for a, b in got]) == roots_of(len(fps), brute)


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}


def test_deduplicate_keeps_clashing_columns(clashing):
    for out in (simhash.deduplicate(clashing), similar.deduplicate(clashing)):
        assert out.columns == clashing.columns and len(untouched(out)) > 0


@pytest.mark.parametrize("many", [2, 3, 10, 50, 200])
def test_families_of_near_copies(spark, many):
    # Three families; each member has seven words of its original changed, so reaches 0.8 with the original.
    bases = [prose(400, 7000 + f).split() for f in range(3)]
    said = [t for f, b in enumerate(bases) for t in (" ".join(b), *variants(b, many - 1, 7, 10_000 * f + 777))]
    order = np.random.default_rng(many).permutation(len(said))
    df = spark.createDataFrame([(int(k), said[k], "s") for k in order], "doc_id long, text string, source string").repartition(4)
    sets = [shingle_set(t) for t in said]
    assert all(jaccard(sets[f * many], sets[f * many + k]) >= 0.8 for f in range(3) for k in range(1, many))
    assert sorted(r.doc_id for r in similar.deduplicate(df).collect()) == [0, many, 2 * many]


def test_near_copies_go(spark):
    base = prose(400, 5).split()
    rows_ = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:50], "new", *base[51:]])), (3, " ".join([*base[:30], "x", *base[31:200], "y", *base[201:330], "z", *base[331:]])), (4, prose(400, 6)), (5, prose(9, 7)), (6, None), (7, "")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows_], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in similar.deduplicate(df).collect()) == [0, 4, 5, 6]
    repeated = df.union(df)
    assert sorted(r.doc_id for r in similar.deduplicate(repeated).collect()) == [0, 4, 5, 6]


def shingle_set(text):
    return similar.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]


def jaccard(x, y):
    return len(np.intersect1d(x, y)) / len(np.union1d(x, y))


def variants(base, many, changed, seed):
    out = []
    for k in range(many):
        words = list(base)
        for j, at in enumerate(np.random.default_rng(seed + k).choice(np.arange(5, len(base) - 5, 6), changed, replace=False)):
            words[at] = f"v{k}x{j}"
        out.append(" ".join(words))
    return out


def test_copies_of_one_original_go(spark):
    # 100 variants at 0.85 to the original and under 0.8 to nearly all others.
    base = prose(304, 21).split()
    said = [" ".join(base), *variants(base, 100, 5, 1000)]
    sets = [shingle_set(t) for t in said]
    assert all(0.83 < jaccard(sets[0], s) < 0.87 for s in sets[1:])
    assert sum(jaccard(x, y) >= 0.8 for k, x in enumerate(sets[1:]) for y in sets[1 : k + 1]) < 500
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(said)], "doc_id long, text string, source string")
    assert [r.doc_id for r in similar.deduplicate(df).collect()] == [0]


@pytest.mark.parametrize(("few", "texts"), [(1000, 512), (1, 512), (1, 7), (6, 3)])
def test_unlinked_pairs_are_all_found(spark, few, texts):
    bases = [prose(n, 40 + n).split() for n in (20, 60, 150)]
    said = [t for k, b in enumerate(bases) for c in range(5) for t in variants(b, 8, min(c, (len(b) - 10) // 6), 100 * k + 10 * c)]
    sets = {int(k): s for k, s in enumerate(map(shingle_set, sorted(set(said))))}
    rows_ = [(k, k % 11, bytearray(s.tobytes())) for k, s in sets.items()]
    pairs, links = similar.unlinked_pairs(spark.createDataFrame(rows_, "h long, root long, s binary"), 0.8, few, texts * similar.LEAST_WEIGHT)
    got = {(max(r), min(r)) for r in pairs.collect() if jaccard(sets[r.a], sets[r.b]) >= 0.8}
    linked = {(max(r), min(r)) for r in links.collect()}
    want = {(a, b) for a in sets for b in sets if a > b and a % 11 != b % 11 and jaccard(sets[a], sets[b]) >= 0.8}
    assert want and got | linked <= want and (few == 1000) == (not linked)
    # Roots stand for what is linked already; both join the same ones.
    of_roots = lambda found: roots_of(11, [(a % 11, b % 11) for a, b in found])
    assert of_roots(got | linked) == of_roots(want)


def test_overlaps_by_matrix():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200))) for _ in range(40)]
    assert similar.overlaps(sets[:15], sets[15:], 7).tolist() == [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]
    assert similar.overlaps([], sets).shape == (0, 40) and similar.overlaps(sets[:1], [np.zeros(0, np.int64)]).tolist() == [[0]]


# --- 9 -----------------------------------------------------------------------


def brute_repeats(said, size=400):
    n = Counter(b[i : i + size] for b in said for i in range(len(b) - size + 1))
    out = []
    for b in said:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if n[b[i : i + size]] > 1:
                gone[i : i + size] = True
        starts = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("sort_bytes", [1 << 23, 1000, 1])
def test_repeats(docs, empty, sort_bytes):
    some = docs.where("doc_id is null or doc_id <> 9")
    kept = some.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(kept, brute_repeats([(r.text or "").encode() for r in kept]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(some, sort_bytes=sort_bytes).collect()) == want
    assert repeats.without_repeats(empty, passage=200).count() == 0


def test_passages_and_kept_text(docs):
    some = docs.where("doc_id is null or doc_id <> 9")
    kept = some.select("doc_id", "text").collect()
    short = brute_repeats([(r.text or "").encode() for r in kept], 200)
    got = repeats.without_repeats(some, with_text=True, passage=200).collect()
    assert Counter((r.doc_id, r.n_passages, r.passage_bytes) for r in got) == Counter((r.doc_id, x[2], x[1]) for r, x in zip(kept, short, strict=True))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


@pytest.mark.parametrize("sort_bytes", [1 << 23, 20_000])
def test_repeats_around_one_frequent_passage(spark, sort_bytes):
    # One core with many phrases: the same passage between contexts that some documents share in part.
    rng = np.random.default_rng(8)
    core = prose(40, 77)
    befores, afters = ([prose(60, 5000 + k) for k in range(9)] for _ in range(2))
    said = [f"{befores[int(rng.integers(9))][-int(rng.integers(1, 330)):]} {core} {afters[int(rng.integers(9))][: int(rng.integers(1, 330))]} {k}" for k in range(150)]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    want = dict(enumerate(brute_repeats([s.encode() for s in said])))
    assert sum(x[1] > 0 for x in want.values()) > 20
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, sort_bytes=sort_bytes).collect()} == want


def test_repeats_of_simple_texts(spark):
    rng = np.random.default_rng(4)
    said = ["a" * 399, "a" * 400, "b" * 401, "xy" * 450]
    for k in range(12):  # few letters, shared pieces at odd offsets
        parts = ["".join(np.random.default_rng(int(s)).choice(list("ab"), 390 + 30 * int(s))) for s in rng.integers(0, 4, 3)]
        said.append(f"{k}".join(parts))
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    want = {k: x for k, x in enumerate(brute_repeats([s.encode() for s in said]))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()}
    assert got == want


# --- 10 ----------------------------------------------------------------------


def test_language(spark, empty):
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éèçab"}
    rng = np.random.default_rng(1)

    def said(lang, n):
        chain = list(letters[lang])
        return " ".join("".join(rng.choice(chain, rng.integers(2, 7))) for _ in range(n))

    train = [(k, said(k_lang, 60), k_lang) for k, k_lang in enumerate(["aa", "bb", "cc"] * 10)] + [(90, "zz", None), (91, None, "aa")]
    model = language.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model[0] == ["aa", "bb", "cc"]
    test = [(k, said(lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 8)] + [(50, None, "aa"), (51, "12 !", "aa"), (52, "", "aa"), (53, "İ", "aa")]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(test, "doc_id long, text string, lang string"), *model).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in test if k < 50)
    assert [got[k].lang_pred for k in (50, 51, 52)] == ["und"] * 3 and got[53].lang_pred != "und"
    assert {r.lang_pred for r in language.predict(spark.createDataFrame(test, "doc_id long, text string, lang string"), *language.learn(empty)).collect()} == {"und"}


def brute_trigrams(text):
    """Trigrams around a letter, over runs of letters with one boundary between them."""
    out = Counter()
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    shown = " " + " ".join(low.split(" ")) + " "
    shown = re.sub(" +", " ", shown)
    for i in range(1, len(shown) - 1):
        if shown[i] != " ":
            out[shown[i - 1 : i + 2]] += 1
    return out


def code_of(gram):
    a, b, c = (int(language.symbols()[ord(x)]) if x != " " else 0 for x in gram)
    return (a << 36) | (b << 18) | c


def test_profiles_and_dot_products_equal_brute_force(monkeypatch):
    said = ["Abc dé", "", "..", "xyz", "Ελλάς και ελλάς", "日本語の文", "İx", "a1b2c3 abc abc", " "]
    found = {k: {} for k in range(len(said))}
    for a, _, of, codes, counts in language.profiles(said):
        for d, c, n in zip(of.tolist(), codes.tolist(), counts.tolist(), strict=True):
            found[a + d][c] = n
    want = [{code_of(g): n for g, n in brute_trigrams(t).items()} for t in said]
    assert [found[k] for k in range(len(said))] == want
    # The bundle of a text, letter by letter.
    bits = lambda x: 1.0 - 2.0 * language.letter_bits(np.array([x], np.uint64))[0]
    codes = np.array(sorted(want[4]), np.uint64)
    counts = np.array([want[4][int(c)] for c in codes], float)
    slow = sum(n * np.roll(bits(int(c) >> 36), 2) * np.roll(bits(int(c) >> 18 & 0x3FFFF), 1) * bits(int(c) & 0x3FFFF) for c, n in zip(codes, counts, strict=True))
    assert language.bundle(codes, counts) == pytest.approx(slow)
    protos = np.random.default_rng(0).normal(size=(2, language.DIMENSIONS))
    for most in (64 << 20, 16 * 3, 16):
        table = language.Table(protos, most)
        for _ in range(2):
            assert (table.dots(codes) * counts[:, None]).sum(axis=0) == pytest.approx(protos @ slow, rel=1e-3, abs=1e-2)
    # A long text is read in parts.
    long = prose(3000, 4) + "\n" + prose(3000, 5)
    monkeypatch.setattr(language, "CHARS", 1000)
    assert dict(zip(*(x.tolist() for x in language.long_profile(long)), strict=True)) == {code_of(g): n for g, n in brute_trigrams(long).items()}


def test_language_ignores_other_columns(clashing):
    model = language.learn(clashing)
    got = language.predict(clashing, *model)
    assert got.columns == ["doc_id", "lang_pred", "score", "margin"] and got.count() == clashing.count()
