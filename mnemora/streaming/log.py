"""Tables that grow by appended Parquet parts and are read merged.

A commit appends, for each table that it changes, one part of new rows and one of the keys that they replace;
nothing that lies there is rewritten, so a batch of one in a hundred keys writes about a hundredth
of the table. A row counts unless a later part names its key: reading is one scan of the parts and a
join with the replaced keys. Compaction merges the small parts into one or, where they have grown past a quarter of
the rest, everything into buckets by the key's hash.

All tables of a log become visible together by one manifest, a small file whose name is its number. It is
put in place only if that name is free (a rename that does not overwrite; a conditional put on S3), so of two
writers who began at the same commit one is told to begin again. Readers see the manifest they opened; what no kept
manifest names goes only by vacuum().
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import scratch

#: Appended parts of a table before they are merged; share of the bucketed rows that they may reach before all is.
MOST_PARTS, TAIL_SHARE = 16, 0.25
FILE_ROWS = 1_000_000
#: A commit's parts are numbered inside it.
STEPS = 1000
_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)


class Conflict(RuntimeError):
    """Another writer committed first."""


class Log:
    """The manifests below a folder: {"parts": {table: [[folder, rows, bucketed]]}, "batches": {stream: last id}}."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._open = spark, path.rstrip("/"), threading.local()

    def hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def listed(self, path: str) -> list[str]:
        at, fs = self.hadoop(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.listed(f"{self.path}/commits") if n.endswith(".json") and n[0] != ".")

    def snapshot(self, number: int | None = None) -> dict:
        """The manifest of a commit (None: the last one)."""
        known = self.commits() if number is None else [number]
        if not known:
            return {"number": -1, "parts": {}, "batches": {}}
        said = self.spark.read.text(f"{self.path}/commits/{known[-1]}.json", wholetext=True).first()[0]
        return {"number": known[-1], **json.loads(said)}

    def current(self) -> dict:
        """What is read now: inside a transaction with what it has written."""
        return getattr(self._open, "manifest", None) or self.snapshot()

    @contextmanager
    def transaction(self) -> Iterator[dict]:
        """Everything that is written inside becomes visible together; an inner one is part of the outer one. Conflict: another writer was first."""
        if getattr(self._open, "manifest", None) is not None:
            yield self._open.manifest
            return
        began = self.snapshot()
        mine = {"number": began["number"], "parts": {k: list(v) for k, v in began["parts"].items()}, "batches": dict(began["batches"]), "steps": 0}
        self._open.manifest = mine
        try:
            yield mine
        finally:
            self._open.manifest = None
        if mine["parts"] != began["parts"] or mine["batches"] != began["batches"]:
            self._publish(mine["number"] + 1, {"parts": mine["parts"], "batches": mine["batches"]})

    def _publish(self, number: int, manifest: dict) -> None:
        at, fs = self.hadoop(f"{self.path}/commits/{number}.json")
        said = bytearray(json.dumps(manifest).encode())
        with _LOCKS[self.path]:  # a local file system's rename does not ask, and its writers are threads of one driver
            if fs.exists(at):
                raise Conflict(f"commit {number} of {self.path} is there already")
            if (at.toUri().getScheme() or "").startswith("s3"):
                try:
                    out = fs.createFile(at).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
                    out.write(said)
                    out.close()
                except Exception as error:
                    raise Conflict(f"commit {number} of {self.path} is there already") from error
                return
            hidden = self.hadoop(f"{self.path}/commits/.{uuid.uuid4().hex}")[0]
            out = fs.create(hidden, False)
            out.write(said)
            out.close()
            if not fs.rename(hidden, at):
                fs.delete(hidden, False)
                raise Conflict(f"commit {number} of {self.path} is there already")

    def put(self, name: str, rows: DataFrame, bucketed: bool = False, instead: bool = False) -> int:
        """Writes rows (with column bucket, and seq unless they are new) as a part of a table in the open transaction; their number."""
        mine = self._open.manifest
        part = uuid.uuid4().hex
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit((mine["number"] + 1) * STEPS + mine["steps"]).cast("long"))
        at = f"{self.path}/{name}/part={part}"
        rows.write.partitionBy("bucket").parquet(at)
        n = self.spark.read.schema(rows.drop("bucket").schema).parquet(at).count()  # from the files' footers
        parts = [] if instead else mine["parts"].get(name, [])
        mine["parts"][name] = [*parts, [part, n, bucketed]] if n else parts
        if not n:
            at, fs = self.hadoop(at)
            fs.delete(at, True)
        return n

    def rows(self, name: str, schema: str) -> DataFrame | None:
        """All rows of a table's parts, with seq and bucket; None: there are none."""
        parts = self.current()["parts"].get(name, [])
        if not parts:
            return None
        reader = self.spark.read.schema(f"{schema}, seq long, part string, bucket int").option("basePath", f"{self.path}/{name}")
        return reader.parquet(*[f"{self.path}/{name}/part={p}" for p, *_ in parts])

    def retried(self, work: Callable[[], object], times: int = 5):
        """work() as one transaction, begun again where another writer was first; what work cut goes, but for a frame that it returns."""
        for left in range(times - 1, -1, -1):
            try:
                with scratch(self.spark) as keep, self.transaction():
                    out = work()
                    if isinstance(out, DataFrame):
                        keep.append(out)
                return out
            except Conflict:
                if not left:
                    raise

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> int:
        """Removes parts that none of the last `keep` manifests names and that are older than so many hours (what runs now may be writing the others); their number."""
        known = self.commits()
        used = {p for n in known[-keep:] for parts in self.snapshot(n)["parts"].values() for p, *_ in parts}
        gone, before = 0, (time.time() - hours * 3600) * 1000
        for n in known[:-keep]:
            at, fs = self.hadoop(f"{self.path}/commits/{n}.json")
            fs.delete(at, False)
        for name in self.listed(self.path):
            for part in self.listed(f"{self.path}/{name}") if name != "commits" else ():
                at, fs = self.hadoop(f"{self.path}/{name}/{part}")
                if part.removeprefix("part=") not in used and fs.getFileStatus(at).getModificationTime() <= before:
                    fs.delete(at, True)
                    gone += 1
        return gone


class Table:
    """A table of a log whose rows are replaced by key. Rows of appended parts have bucket -1."""

    def __init__(self, log: Log, name: str, schema: str, key: str = "doc_id", buckets: int = 16):
        self.log, self.name, self.schema, self.key, self.buckets = log, name, schema, key, buckets
        self.columns = [f.split()[0] for f in schema.split(", ")]
        self.key_schema = next(f for f in schema.split(", ") if f.split()[0] == key)

    def bucket(self):
        return F.expr(f"cast(pmod(xxhash64({self.key}), {self.buckets}) as int)")

    def touched(self, *rows: DataFrame) -> list[int]:
        """Buckets of the keys of rows: no more numbers than there are buckets."""
        out: set[int] = set()
        for df in rows:
            out |= {r.bucket for r in df.select(self.bucket().alias("bucket")).distinct().collect()}
        return sorted(out)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows that count; with `only`, of these buckets' keys (and perhaps others)."""
        rows = self._live(only)
        return self.log.spark.createDataFrame([], self.schema) if rows is None else rows.select(*self.columns)

    def _live(self, only: list[int] | None = None, bucketed: bool | None = None) -> DataFrame | None:
        rows, gone = self.log.rows(self.name, self.schema), self.log.rows(f"{self.name}.gone", self.key_schema)
        if rows is None:
            return None
        if only is not None:
            rows = rows.where(F.col("bucket").isin([*only, -1]))
        if bucketed is not None:
            rows = rows.where(F.col("bucket") >= 0 if bucketed else F.col("bucket") < 0)
        if gone is None:
            return rows
        last = gone.groupBy(self.key).agg(F.max("seq").alias("__gone"))
        return rows.join(last, self.key, "left").where("__gone is null or seq >= __gone").drop("__gone")

    def replace(self, gone: DataFrame, new: DataFrame) -> None:
        """Rows of the keys in gone are replaced by new; keys without rows should be left out of gone, as each is kept until the next compaction."""
        with self.log.transaction() as mine:
            mine["steps"] += 1
            step = F.lit((mine["number"] + 1) * STEPS + mine["steps"]).cast("long")
            flat = F.lit(-1).alias("bucket")
            if self.log.current()["parts"].get(self.name):
                self.log.put(f"{self.name}.gone", gone.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", flat).withColumn("seq", step))
            self.log.put(self.name, new.select(*self.columns).withColumn("bucket", flat).withColumn("seq", step))

    def sizes(self) -> tuple[int, int, int]:
        """Rows in buckets, rows and number of appended parts."""
        parts = self.log.current()["parts"].get(self.name, [])
        return sum(n for _, n, b in parts if b), sum(n for _, n, b in parts if not b), sum(not b for *_, b in parts)

    def compact(self, force: bool = False) -> str | None:
        """Merges appended parts where there are many; what was done: None, 'tail' or 'all'."""
        base, tail, parts = self.sizes()
        if not force and parts <= MOST_PARTS:
            return None
        with self.log.transaction() as mine:
            if force or tail > TAIL_SHARE * base:
                rows = self._live()
                if rows is None:
                    return None
                split = max(1, -(-(base + tail) // (self.buckets * FILE_ROWS)))
                dealt = rows.drop("part").withColumn("bucket", self.bucket()).repartition(self.buckets * split, "bucket", F.pmod(F.hash(self.key), F.lit(split)))
                self.log.put(self.name, dealt.sortWithinPartitions("bucket", self.key), bucketed=True, instead=True)
                mine["parts"].pop(f"{self.name}.gone", None)
                return "all"
            kept = [p for p in mine["parts"][self.name] if p[2]]
            rows = self._live(bucketed=False).drop("part")
            gone = self.log.rows(f"{self.name}.gone", self.key_schema)
            self.log.put(self.name, rows.coalesce(max(1, tail // FILE_ROWS)), instead=True)
            mine["parts"][self.name] = [*kept, *mine["parts"][self.name]]
            if gone is not None:
                self.log.put(f"{self.name}.gone", gone.groupBy(self.key, "bucket").agg(F.max("seq").alias("seq")), instead=True)
            return "tail"
