"""Incremental ingest: watermarks, content-hash change detection, idempotent upserts, streams.

Tables are Parquet folders of numbered versions; readers take the newest that its
writer completed, so they see the old rows or the new ones, and a micro-batch
that runs twice upserts the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import catalog
from ..operators.lineage import cut

EXTRACTOR_VERSION = 6
SCHEMA = "doc_id string, source_id string, uri string, title string, kind string, text string, content_hash string, graph_version int, updated_at string"


class Table:
    """A versioned Parquet table."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first: those with the writer's success mark."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]}")

    def write(self, rows: DataFrame, version: int | None = None, keep: int = 2) -> int:
        """Writes the next version (or the given one) and drops all but the last `keep`."""
        n = version if version is not None else (self.versions() or [-1])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in self.versions()[:-keep]:
            self._fs().delete(path(f"{self.path}/v{old}"), True)
        return n


def compact(table: Table, files: int, most_versions: int = 500) -> bool:
    """Rewrites a table into `files` files where it has more, or has grown past a number of versions; whether it did."""
    now = table.read()
    if len(now.inputFiles()) <= files and (table.versions() or [0])[-1] % most_versions:
        return False
    table.write(now.repartition(files), keep=1)
    return True


def prepared(documents: DataFrame, version: int = EXTRACTOR_VERSION, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents (source_id, uri, title, kind, text, updated_at) with their id, normalised text, hash and graph version, and the further columns in keep."""
    said = documents.withColumn("text", text.normalize_text(F.col("text")))
    return said.select(
        text.doc_id(F.col("source_id"), F.col("uri")).alias("doc_id"), "source_id", "uri", "title", "kind", "text",
        text.content_hash(F.col("text")).alias("content_hash"), F.lit(version).alias("graph_version"), F.col("updated_at").cast("string").alias("updated_at"), *keep,
    )


def ingest(table: Table, documents: DataFrame, version: int | None = None) -> DataFrame:
    """Upserts documents and returns doc_id, action of each; of documents given twice the last updated counts."""
    rows = prepared(documents)
    latest = rows.groupBy("doc_id").agg(F.max_by(F.struct(*rows.columns), F.struct("updated_at", "content_hash")).alias("r")).select("r.*")
    old = table.read()
    actions = catalog.ingest_actions(old, latest, EXTRACTOR_VERSION)
    changed = cut(actions)  # what the old version said, before it is replaced
    table.write(catalog.upsert(old, latest, ["doc_id"]), version)
    return changed


def since(documents: DataFrame, watermark: str | None) -> DataFrame:
    """Documents updated at or after the watermark (the start of the last run that succeeded)."""
    return documents if watermark is None else documents.where(F.col("updated_at") >= F.lit(watermark))


def stream_ingest(spark: SparkSession, source: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Ingests what is there of a stream of documents and stops; restarts go on from the checkpoint."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        if not rows.isEmpty():
            ingest(table, rows)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, event_type, n, total of an event stream (extension: event time with a watermark)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def seen_once(stream: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The first of rows that repeat keys; with `within`, state is dropped after the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys) if within else stream.dropDuplicates(keys)
