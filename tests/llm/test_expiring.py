"""Operator 12 against a plain fold, event by event."""

import datetime as dt
import hashlib
import math
import random
import zlib

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from mnemora.llm import expiring


def plain(batches, hold=48, late=24):
    """batches: lists of (key, hour, hash as hex). Windows as the query returns them."""
    out, top, held = [], None, {}
    for b, rows in enumerate(batches):
        for k, h, x in sorted(r for r in rows if top is None or r[1] >= top - late):
            if k in held and h <= held[k][0] + hold:
                w = held[k]
                w[2] += 1
                w[3] += x != w[1]
                w[4] += zlib.crc32(x.encode()) if x != w[1] else 0
            else:
                if k in held:
                    w = held.pop(k)
                    out.append((k, w[0], b, *w[2:], w[1]))
                held[k] = [h, x, 0, 0, 0]
        top = max([*([top] if top is not None else []), *(h for _, h, _ in rows)], default=None)
        for k in [k for k, w in held.items() if b == len(batches) - 1 or (top is not None and w[0] + hold < top - late)]:
            w = held.pop(k)
            out.append((k, w[0], b, *w[2:], w[1]))
    return sorted(out)


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def made(seed, keys, n, batches=4, spread=90, values=3, low=0):
    rng = random.Random(seed)
    return [[(rng.randrange(keys) - 2, low + 60 * b + rng.randrange(-spread, spread), digest(rng.randrange(values))) for _ in range(rng.randrange(n))] for b in range(batches)]


def folded(batches, hold=48, late=24):
    """The two folds on one bucket, without Spark, each batch packed in two tasks."""
    out, first, second, top = [], None, None, None
    for b, rows in enumerate(batches):
        floor = None if top is None else top - late
        top = max([*([top] if top is not None else []), *(h for _, h, _ in rows)], default=None)
        after = None if b == len(batches) - 1 else -(2**62) if top is None else top - late
        events = [(0, k, h, bytes.fromhex(x), 1, zlib.crc32(x.encode()), b, None, None) for k, h, x in rows]
        names = ["bucket", "key", "hour", "hash", "n", "crc", "batch", "floor", "next_floor"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
        packs = []
        for part in (events[::2], [(0, None, None, None, 0, 0, b, floor, after), *events[1::2]]):
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], names=names)
            packs += [p.to_pandas() for p in expiring.packed(iter([batch]))]
        tagged, first = expiring.tag(iter(packs), first, hold)
        if tagged:
            done, second = expiring.count(iter(tagged), second)
            for p in done:
                out += [(r.key, r.start_hour, r.closed_batch, r.n_repeats, r.n_conflicts, r.conflict_crc, r.hash.hex()) for r in p.itertuples()]
    assert first is None and second is None  # nothing stays open
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_folds_equal_a_plain_fold(seed):
    batches = made(seed, keys=1 + seed % 7, n=3 + 4 * seed, values=1 + seed % 4, low=-200 if seed % 2 else 470_000)
    assert folded(batches) == plain(batches)


def test_packing_keeps_every_event(monkeypatch):
    monkeypatch.setattr(expiring, "PACK_ROWS", 7)
    rows = [(k % 5, k, 100 + k, bytes([k] * 32), 1, k, 0, None, None) for k in range(50)] + [(b, None, None, None, 0, 0, 0, 1, 2) for b in range(5)]
    names = ["bucket", "key", "hour", "hash", "n", "crc", "batch", "floor", "next_floor"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
    got = pa.Table.from_batches(list(expiring.packed(batch.slice(i, 4) for i in range(0, 55, 4))))
    assert pc.sum(pc.binary_length(got.column("keys"))).as_py() == 8 * 50 and pc.sum(got.column("control").cast(pa.int32())).as_py() == 5


def test_stream_with_a_hot_key_equals_a_plain_fold(spark):
    batches = made(3, keys=40, n=300, batches=3, values=50)
    rng = random.Random(4)
    # One key with most events, of many different hashes; a batch without any other event.
    hot = [(7, 60 * b + rng.randrange(-60, 60), digest(rng.randrange(400))) for b in (0, 1, 1, 2) for _ in range(600)]
    for k, h, x in hot:
        batches[max(0, min(2, (h + 60) // 60))].append((k, h, x))
    rows = [(k, h, bytearray(bytes.fromhex(x)), zlib.crc32(x.encode()), b) for b, part in enumerate(batches) for k, h, x in part]
    events = spark.createDataFrame(rows, "key long, hour long, hash binary, crc long, batch long").repartition(5)
    merged = expiring.merged_hot(events, len(rows))
    assert merged.agg(F.sum("n")).first()[0] == len(rows) and merged.count() < len(rows)
    assert merged.where("hash is null").count() > 0
    got = sorted((r.key, r.start_hour, r.closed_batch, r.n_repeats, r.n_conflicts, r.conflict_crc, bytes(r.hash).hex()) for r in expiring.windows(events, batches=3).collect())
    assert got == plain(batches)


def test_empty_table(spark):
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
    assert expiring.copies(spark.createDataFrame([], schema)).count() == 0
    assert expiring.windows(spark.createDataFrame([], "key long, hour long, hash binary, crc long, batch long")).count() == 0


def copied(rows):
    """(key, hour, hash, L) of the copies of clicks, plainly."""
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    out = []
    for click, ts, came, client, kind, value, props in rows:
        for j in range(click % 3 + 1) if click is not None and came is not None else ():
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(came) // 3_600_000_000 + 6 * j * (c % 10)
            whole = "" if value is None or math.isnan(value) else math.floor(100 * value + 0.5)
            said = (client if client is not None else "", kind or "", whole, micros(ts) if ts else "", props or "", c % 3)
            out.append((click, hour, digest("|".join(map(str, said))), hour + c // 10 % 200))
    return out


def test_copies_equal_a_plain_version_whatever_the_zone(spark):
    t = dt.datetime
    rows = [
        (0, t(2024, 3, 10, 2, 30, 0, 1), t(2024, 3, 10, 2, 59, 59, 999999), 1, "a", 1.005, "{}"), (1, None, t(1969, 12, 31, 23, 59, 59), None, None, None, None),
        (2, t(2024, 1, 1), t(2024, 1, 1), 1, "a|b", float("nan"), "x"), (-4, t(2024, 1, 1), t(2024, 1, 1), 1, "é", -0.005, ""), (None, t(2024, 1, 1), t(2024, 1, 1), 1, "a", 1.0, "x"),
        (5, t(2024, 1, 1), None, 1, "a", 1.0, "x"), (5, t(2024, 1, 1), t(2024, 1, 1, 1), 1, "a", 1e15, "x"), (5, t(2024, 1, 1), t(2024, 1, 1, 1), 1, "a", 1e15, "x"),
    ]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string").withColumn("hash", F.lit(1)).withColumn("key", F.lit(2))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = sorted((r.key, r.hour, bytes(r.hash).hex(), r.L) for r in expiring.copies(clicks).collect())
            assert got == sorted(copied(rows))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sql_equals_the_plain_fold():
    db = duckdb.connect()
    db.sql("create view clicks as select * from '/root/testdata/sf0.001/clicks.parquet'")
    rows = copied(db.sql("select click_id, ts, arrived_at, client_id, kind, value, props from clicks").fetchall())
    low, high = min(r[3] for r in rows), max(r[3] for r in rows)
    batches = [[] for _ in range(10)]
    for k, h, x, at in rows:
        batches[(at - low) * 10 // (high - low + 1)].append((k, h, x))
    assert sorted(db.sql(expiring.SQL).fetchall()) == plain(batches)
