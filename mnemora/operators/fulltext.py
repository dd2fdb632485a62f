"""A stored full-text index that queries read by term.

Postings lie in blocks: of one term, one source and one range of documents, with the number of postings, the
largest frequency and the smallest length beside them. From these alone a bound on the score of any
document of a range follows, whatever the corpus grows to. A query

1. reads the heads of its terms' blocks (no postings), and from them document frequencies and, for each range, a bound;
2. scores the few ranges of the highest bounds, which gives a score that the k-th answer reaches at least;
3. scores the ranges whose bound reaches it, and no others.

So results equal those of a scan of all texts (retrieval.bm25_topk), while neither texts nor most postings are read.
Files are dealt by the term's hash and sorted by term: partition filters and the files' own statistics
keep other terms' blocks unread.

Of many queries at once nearly every range is reached by some, so their terms' blocks are dealt out by
range, and each task scores its ranges against blocks of queries and keeps k a query: no row is made for a query and a range or a posting.

An update moves the new rows' texts to the tasks of their ranges, where their blocks are made, and appends these; for the rows that
it replaces it appends their ids and, as negative counts, what they had added to frequencies and lengths. merge() drops them for good without reading a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.log import MOST_PARTS, STEPS, TAIL_SHARE, Log
from . import retrieval
from .lineage import cut
from .retrieval import B, K1, TITLE_WEIGHT, ranked

BLOCKS = "term string, source_id string, rng long, n long, max_tf double, min_dl int, ids array<long>, tfs array<double>, dls array<int>"
MINUS = "term string, source_id string, n long"
SIZES = "source_id string, n long, dl long"
GONE = "id long"
#: Documents of a range, about; ranges that are scored first for each query.
RANGE, PROBES = 256, 4
#: Queries for which single ranges are chosen; replaced ids that tasks hold as a whole.
FEW, GONE_AT_ONCE = 64, 2_000_000
#: The partition of the blocks of the term '', one for each range, that hold the lengths of its rows.
LENGTHS = -2


class Index:
    """The index of rows (id long, source_id, text and perhaps title) in a log's tables."""

    def __init__(self, log: Log, name: str = "index", buckets: int = 16, stemming: bool = True, title_weight: float = TITLE_WEIGHT):
        self.log, self.name, self.buckets, self.stemming, self.title_weight = log, name, buckets, stemming, title_weight

    def _bucket(self):
        return F.expr(f"case when term = '' then {LENGTHS} else cast(pmod(xxhash64(term), {self.buckets}) as int) end")

    def _read(self, name: str, schema: str) -> DataFrame:
        rows = self.log.rows(f"{self.name}.{name}", schema)
        rows = self.log.spark.createDataFrame([], f"{schema}, seq long, part string, bucket int") if rows is None else rows
        return rows.where(F.col("bucket") >= 0) if name == "blocks" else rows

    def postings(self, rows: DataFrame) -> DataFrame:
        """id, source_id, dl, term, tf of rows, and one with the term '' for each row.

        Rows are dealt out by id as texts, so that their terms are counted where they are and no posting is moved for that.
        """
        words = retrieval.search_words(rows.repartition("id"), self.stemming, ("source_id",))
        said = F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w"))), F.transform("words", lambda x: F.struct(x.alias("term"), F.lit(1.0).alias("w"))), F.transform("title_words", lambda x: F.struct(x.alias("term"), F.lit(self.title_weight).alias("w"))))
        each = words.select("id", F.coalesce("source_id", F.lit("")).alias("source_id"), (F.size("words") + F.size("title_words")).alias("dl"), F.explode(said).alias("t"))
        return each.groupBy("id", "source_id", "dl", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))

    def _blocked(self, post: DataFrame, rows: int, salt: int) -> DataFrame:
        """Blocks of postings; a range is of one part (salt) and source."""
        one = F.array_sort(F.collect_list(F.struct("id", "tf", "dl")))
        blocks = post.where("term <> ''").groupBy("term", "source_id", self._range(rows, salt).alias("rng")).agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), one.alias("p"))
        return self._dealt(blocks.select("term", "source_id", "rng", "n", "max_tf", "min_dl", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls")), rows)

    @staticmethod
    def _range(rows: int, salt: int):
        return F.xxhash64("source_id", F.pmod("id", F.lit(max(1, rows // RANGE))), F.lit(salt))

    def _dealt(self, blocks: DataFrame, rows: int) -> DataFrame:
        spread = F.pmod(F.when(F.col("term") == "", F.hash("rng")).otherwise(F.hash("term")), F.lit(16))
        return blocks.withColumn("bucket", self._bucket()).repartition(max(self.buckets, min(rows // 20_000, 16 * self.buckets)), "bucket", spread).sortWithinPartitions("bucket", "term")

    def _made(self, rows: DataFrame, total: int, salt: int, lists: bool = True) -> DataFrame:
        """Blocks of rows (without lists: their counts only), made where the rows of a range are: their texts are moved, their postings are not. The block of the term '' has the lengths of all rows of its range."""
        stemming, weight = self.stemming, self.title_weight

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in retrieval.runs(batches, 2, 3, retrieval.CHARACTERS):
                ids, source, rng = part.column(0).to_numpy(), part.column(1), part.column(2).to_numpy()
                words, title = (retrieval.words_of(part.column(n)) for n in (4, 5))
                dls = (words.value_lengths().to_numpy() + title.value_lengths().to_numpy()).astype(np.int64)
                changes = np.r_[True, (np.diff(rng) != 0) | (np.diff(source.dictionary_encode().indices.to_numpy()) != 0)]
                group = np.cumsum(changes) - 1
                order = np.lexsort((dls, ids, group))  # rows of one id and length are one
                first = np.r_[True, (np.diff(group[order]) != 0) | (np.diff(ids[order]) != 0) | (np.diff(dls[order]) != 0)]
                number = np.empty(len(ids), np.int64)
                number[order] = np.cumsum(first) - 1
                ids, dls, group = ids[order][first], dls[order][first], group[order][first]
                vocabulary, row, term, tf = retrieval.term_counts([(words, 1.0), (title, weight)], stemming)
                key, place = np.unique((group[number[row]] * max(len(vocabulary), 1) + term) * len(ids) + number[row], return_inverse=True)
                tf, row, key = np.bincount(place, tf, len(key)), key % len(ids), key // len(ids)
                begins = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, np.int64)
                n, of_range = np.diff(np.r_[begins, len(key)]), np.bincount(group)
                most = np.maximum.reduceat(tf, begins) if len(key) else np.zeros(0)
                least = np.minimum.reduceat(dls[row], begins) if len(key) else np.zeros(0, np.int64)
                at = pa.array(np.flatnonzero(changes)[np.r_[np.arange(len(of_range)), group[row[begins]]]])
                said = pa.concat_arrays([pa.array([""] * len(of_range), pa.string()), vocabulary.take(pa.array(key[begins] % max(len(vocabulary), 1)))])
                held = n if lists else np.zeros_like(n)
                offsets, lengths = (pa.array(np.r_[0, np.cumsum(x)].astype(np.int32)) for x in (np.r_[np.zeros_like(of_range), held], np.r_[of_range, held]))
                row, tf = (row, tf) if lists else (row[:0], tf[:0])
                columns = {
                    "term": said, "source_id": source.take(at), "rng": part.column(2).take(at), "n": pa.array(np.r_[of_range, n]),
                    "max_tf": pa.array(np.r_[np.zeros(len(of_range)), most]), "min_dl": pa.array(np.r_[np.minimum.reduceat(dls, np.flatnonzero(np.r_[True, np.diff(group) != 0])), least].astype(np.int32)),
                    "ids": pa.ListArray.from_arrays(offsets, pa.array(ids[row])), "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf)), "dls": pa.ListArray.from_arrays(lengths, pa.array(np.r_[dls, dls[row]].astype(np.int32))),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        of = rows.withColumn("source_id", F.coalesce("source_id", F.lit(""))).withColumn("rng", self._range(total, salt))
        title = F.lower("title") if "title" in rows.columns else F.lit(None).cast("string")
        dealt = of.repartition("rng").sortWithinPartitions("source_id", "rng")
        return dealt.select("id", "source_id", "rng", F.length("text").alias("n"), F.lower("text").alias("text"), title.alias("title")).mapInArrow(blocks, BLOCKS)

    def update(self, gone: DataFrame, new: DataFrame) -> None:
        """Rows of gone (as they were indexed) are replaced by those of new, of other or the same ids."""
        with self.log.transaction() as mine:
            mine["steps"] += 1
            step = (mine["number"] + 1) * STEPS + mine["steps"]
            at = lambda df: df.withColumn("seq", F.lit(step).cast("long"))
            flat = lambda df: at(df.withColumn("bucket", F.lit(0)))
            put = lambda name, df: self.log.put(f"{self.name}.{name}", df)
            total = new.count()
            if put("blocks", at(self._dealt(self._made(new, total, step), total))):
                part = mine["parts"][f"{self.name}.blocks"][-1][0]
                lengths = self.log.rows(f"{self.name}.blocks", BLOCKS).where((F.col("part") == part) & (F.col("bucket") == LENGTHS))
                put("sizes", flat(self._sizes(self._summed(lengths), 1)))
            if put("gone", flat(gone.select("id").distinct())):
                was = cut(self._summed(self._made(gone, gone.count(), step, lists=False)).groupBy("term", "source_id").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")))
                put("sizes", flat(self._sizes(was, -1)))
                put("minus", flat(was.where("term <> ''").select("term", "source_id", "n")))

    @staticmethod
    def _summed(blocks: DataFrame) -> DataFrame:
        """term, source_id, n of blocks, and of those of the term '' dl, the sum of their rows' lengths."""
        return blocks.select("term", "source_id", "n", F.when(F.col("term") == "", F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x)).alias("dl"))

    @staticmethod
    def _sizes(summed: DataFrame, sign: int) -> DataFrame:
        return summed.where("term = ''").groupBy("source_id").agg((F.sum("n") * sign).alias("n"), (F.sum("dl") * sign).cast("long").alias("dl"))

    def _alive(self, post: DataFrame) -> DataFrame:
        """Postings (id, seq, ...) of rows that were not replaced since."""
        if not self.log.current()["parts"].get(f"{self.name}.gone"):
            return post
        last = self._read("gone", GONE).groupBy("id").agg(F.max("seq").alias("__gone"))
        return post.join(last, "id", "left").where("__gone is null or seq >= __gone").drop("__gone")

    def _exploded(self, blocks: DataFrame) -> DataFrame:
        names = [c for c in blocks.columns if c not in ("ids", "tfs", "dls")]
        return blocks.select(*names, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select(*names, F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))

    def merge(self, force: bool = False) -> str | None:
        """Writes the blocks of many parts anew as one, without replaced rows: the appended ones, or all where those are many."""
        name = f"{self.name}.blocks"
        parts = self.log.current()["parts"].get(name, [])
        base, tail = sum(n for _, n, b in parts if b), sum(n for _, n, b in parts if not b)
        if not parts or (not force and sum(not b for *_, b in parts) <= MOST_PARTS):
            return None
        whole = force or tail > TAIL_SHARE * base
        with self.log.transaction() as mine:
            mine["steps"] += 1
            step = (mine["number"] + 1) * STEPS + mine["steps"]
            rows = self._read("blocks", BLOCKS)
            kept = [] if whole else [p for p in parts if p[2]]
            if not whole:
                rows = rows.where(~F.col("part").isin([p for p, *_ in kept]))
            post = self._alive(self._exploded(rows.select("term", "source_id", "seq", "ids", "tfs", "dls")))
            total = self._read("sizes", SIZES).agg(F.sum("n")).first()[0] or 0
            sizes = self._read("sizes", SIZES).groupBy("source_id").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n <> 0")
            self.log.put(name, self._blocked(post.select("id", "source_id", "dl", "term", "tf"), total, step).withColumn("seq", F.lit(step).cast("long")), bucketed=whole, instead=True)
            mine["parts"][name] = [*kept, *mine["parts"][name]]
            self.log.put(f"{self.name}.sizes", sizes.withColumn("bucket", F.lit(0)), instead=True)
            if whole:
                for x in ("gone", "minus"):
                    mine["parts"].pop(f"{self.name}.{x}", None)
            else:  # replaced rows of the appended blocks have left, those of the others not yet
                left = self._alive(self._exploded(self._read("blocks", BLOCKS).where(F.col("part").isin([p for p, *_ in kept])).select("term", "source_id", "seq", "ids", "tfs", "dls")))
                was = self._read("blocks", BLOCKS).where(F.col("part").isin([p for p, *_ in kept])).groupBy("term", "source_id").agg(F.sum("n").alias("n"))
                now = left.groupBy("term", "source_id").agg(F.count("*").alias("m"))
                minus = was.join(now, ["term", "source_id"], "left").select("term", "source_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
                self.log.put(f"{self.name}.minus", minus.withColumn("bucket", F.lit(0)), instead=True)
        return "all" if whole else "tail"

    def topk(self, queries: DataFrame, k: int, sources: tuple[str, ...] | None = None, probes: int = PROBES) -> DataFrame:
        """qid, id, score, rank: the k best rows for each query (qid, terms) of the given sources (None: all), as retrieval.bm25_topk finds them."""
        spark = self.log.spark
        terms = retrieval.stem.stemmed("terms") if self.stemming else F.col("terms")
        asked = queries.select("qid", F.explode(F.array_distinct(terms)).alias("term")).distinct()
        number = asked.agg(F.count("*").alias("terms"), F.count_distinct("qid").alias("queries")).first()
        asked = asked if number.queries <= FEW else cut(asked)
        small = F.broadcast if number.terms <= retrieval.BROADCAST_TERMS else lambda df: df
        seen = (lambda df: df) if sources is None else lambda df: df.where(F.col("source_id").isin(list(sources)))
        size = seen(self._read("sizes", SIZES)).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
        if not size.n:
            return spark.createDataFrame([], "qid long, id long, score double, rank int")
        avgdl = size.dl / size.n
        buckets = [r.bucket for r in asked.select(self._bucket().alias("bucket")).distinct().collect()]  # a number for each bucket at most
        wanted = small(asked.select("term").distinct())
        mine = seen(self._read("blocks", BLOCKS)).where(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi")
        heads = mine.select("term", "rng", "n", "max_tf", "min_dl")
        minus = seen(self._read("minus", MINUS)).join(wanted, "term", "left_semi").select("term", (-F.col("n")).alias("n"))
        df = heads.select("term", "n").unionByName(minus).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        idf = F.greatest(F.log((F.lit(float(size.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        weighted = asked.join(df, "term").select("qid", "term", idf.alias("idf"))
        if number.queries > FEW:
            return self._topk_of_many(mine.select("rng", "term", "seq", "ids", "tfs", "dls"), cut(weighted), float(avgdl), int(size.n), k)
        part = lambda tf, dl: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))
        bounds = heads.join(small(weighted), "term").groupBy("qid", "rng").agg(F.sum(part(F.col("max_tf"), F.col("min_dl"))).alias("bound"))

        def scored(ranges: DataFrame) -> DataFrame:
            """qid, id, score of the rows of ranges (qid, rng)."""
            near = mine.join(ranges.select("rng").distinct(), "rng", "left_semi")
            post = self._alive(self._exploded(near.select("term", "rng", "seq", "ids", "tfs", "dls"))).join(small(weighted), "term")
            return post.join(ranges.select("qid", "rng"), ["qid", "rng"], "left_semi").groupBy("qid", "id").agg(F.round(F.sum(part(F.col("tf"), F.col("dl"))), 9).alias("score"))

        first = bounds.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "rng"))).where(F.col("at") <= probes)
        least = ranked(scored(first)).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        reach = bounds.join(least, "qid", "left").where("least is null or bound >= least - 1e-8")
        return ranked(scored(reach)).where(F.col("rank") <= k)

    def _topk_of_many(self, blocks: DataFrame, weighted: DataFrame, avgdl: float, total: int, k: int) -> DataFrame:
        """qid, id, score, rank for the queries of weighted (qid, term, idf): tasks score whole ranges against blocks of queries and keep k a query."""
        spark = self.log.spark
        gone = self._read("gone", GONE).groupBy("id").agg(F.max("seq").alias("seq"))
        dead = spark.sparkContext.broadcast(None)
        if gone.count() > GONE_AT_ONCE:
            one = F.array_sort(F.collect_list(F.struct("id", "tf", "dl")))
            left = self._alive(self._exploded(blocks)).groupBy("rng", "term").agg(one.alias("p"))
            blocks = left.select("rng", "term", F.lit(0).cast("long").alias("seq"), F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
        else:
            said = gone.orderBy("id").toPandas()  # GONE_AT_ONCE at most
            dead = spark.sparkContext.broadcast((said["id"].to_numpy(np.int64), said["seq"].to_numpy(np.int64)))
        dealt = blocks.withColumn("n", F.size("ids")).repartition(max(2 * spark.sparkContext.defaultParallelism, total // retrieval.DEALT), "rng").sortWithinPartitions("rng")
        out = None
        for shared in retrieval.query_blocks(weighted, avgdl, retrieval.QUERY_BLOCK):

            def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                asked = shared.value
                known, head = pa.array(asked.terms, pa.string()), retrieval.Heads(len(asked.qids), k)
                rows_at_once = max(1, retrieval.CELLS // len(asked.qids))
                for part in retrieval.runs(batches, 0, 6):
                    column = part.column(3)
                    of = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
                    term = pc.index_in(part.column(1), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[of]
                    own, tf, dl = (pc.list_flatten(part.column(n)).to_numpy(zero_copy_only=False) for n in (3, 4, 5))
                    if dead.value is not None and len(dead.value[0]):
                        ids, until = dead.value
                        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                        alive = (ids[at] != own) | (part.column(2).to_numpy()[of] >= until[at])
                        term, own, tf, dl = term[alive], own[alive], tf[alive], dl[alive]
                    ids, row = np.unique(own, return_inverse=True)
                    order = np.argsort(row, kind="stable")
                    for a in range(0, len(ids), rows_at_once):
                        z = min(a + rows_at_once, len(ids))
                        mine = order[slice(*np.searchsorted(row[order], (a, z)))]
                        head.add(asked.scores(term[mine], row[mine] - a, tf[mine], dl[mine].astype(float), z - a), ids[a:z])
                yield head.batch(asked.qids)

            found = dealt.mapInArrow(best, "qid long, id long, score double")
            out = found if out is None else out.union(found)
        if out is None:
            return spark.createDataFrame([], "qid long, id long, score double, rank int")
        return ranked(out).where(F.col("rank") <= k)
