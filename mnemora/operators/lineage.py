"""Cutting the lineage of iterative programs, and folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()
_SCOPES = threading.local()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set and Spark is local (tests), a temporary folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="mnemora-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.discard(path)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_MADE) if spark is not None else ():
        remove(spark, path)


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one; it goes when the driver's process ends."""
    path = f"{shared_root(spark)}/mnemora-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_all)
    _MADE.add(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written to a shared folder and read back; see scratch()."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What cut() writes inside goes at the end, but for the frames that the block appends to the list."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    mine, keep = [], []
    _SCOPES.open.append(mine)
    try:
        yield keep
    finally:
        _SCOPES.open.remove(mine)
        kept = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
        for path in mine:
            if path.rpartition("/")[2] not in kept:
                remove(spark, path)
            elif _SCOPES.open:
                _SCOPES.open[-1].append(path)
