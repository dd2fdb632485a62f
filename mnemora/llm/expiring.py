"""Expiring deduplication of clicks by chained stateful operators (operator 12).

A stream of events (key, hour, hash) is cut into windows for each key: an event opens one, repeats
of the key up to ``hold`` hours later belong to it, the next event after that closes it and
opens another, and so does time. Two stateful operators follow one another:

- the first holds, for each key with an open window, its opener and its deadline, and tags every event with
  the window it belongs to; where a window ends it sends a control event on;
- the second holds, for each window, the opener's hash and counters; a control event makes it send
  the window's row out.

Spark takes one operator of this kind in a streaming query (two need a store of state that keeps
megabytes on disk for each partition, used or not), so the chain is two queries: the second reads
the stream that the first has written, by its log, so every event comes once.

Time moves by control rows in the input, one for each state bucket and batch: what is older than
``floor`` is dropped, and windows whose deadline lies before ``next_floor`` end with the batch.

Events are packed by bucket of the key's hash, some ten thousand of a batch each, before they are shuffled, and a
bucket's events and state are read and written whole with numpy, so no Python code runs per key. Only open windows
have state. A key with more
than one in ``HOT_KEYS`` rows would fill one bucket: of such keys, events whose hash cannot
open a window (it is not the smallest of its key, batch and hour) are merged by hour before they
are written, as each can only be a repeat unlike its opener; so such a key has rows for its hours and possible
openers, not for its events. Batches are written below spark.checkpoint.dir; the query starts anew
for each, on one checkpoint, and a start that dies is done again from its batch.

Defined cases: rows without a key or without a time take no part; a negative key's remainder is taken as
positive, so every row has a copy; repeated rows are events each; a null value, time or text of a hash is
empty, and so is a value that is no number; a value beyond a long counts as the largest; an empty table gives an empty result; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import HOT_KEYS, own_folder, read_table, stored

HOLD, LATE, BATCHES = 48, 24, 10
#: Rows of a bucket over all batches; at least LEAST_BUCKETS buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 128

#: n events; without a hash they are unlike any opener, and crc is the sum of theirs. Without a key: a control row.
EVENTS = "bucket int, key long, hour long, hash binary, n long, crc long, batch long, floor long, next_floor long"
#: The same, the events of a bucket as packed arrays.
PACKED = "bucket int, keys binary, hours binary, hashes binary, ns binary, crcs binary, control boolean, batch long, floor long, next_floor long"
#: kind 0 opens a window (hashes are those of openers), 1 repeats, 2 repeats unlike its opener, 3 closes.
TAGGED = "bucket int, keys binary, starts binary, kinds binary, hashes binary, ns binary, crcs binary, batch long"
WINDOWS = "key long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
_NEVER = 2**62
#: Rows that a task packs at once.
PACK_ROWS = 200_000
#: The state of a bucket as packed arrays; None: nothing is open.
Held = tuple[bytes, ...] | None
_LONG, _HASH = np.dtype(np.int64), np.dtype("S32")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EVENTS as PACKED: what lies together in a task goes on together."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "hours", "hashes", "ns", "crcs")), ("control", pa.bool_()), *((c, pa.int64()) for c in ("batch", "floor", "next_floor"))])

    def of(rows: pa.Table) -> pa.RecordBatch:
        out = {c: [] for c in schema.names}
        control = rows.filter(pc.is_null(rows.column("key")))
        for c in ("bucket", "batch", "floor", "next_floor"):
            out[c] += control.column(c).to_pylist()
        for c in ("keys", "hours", "hashes", "ns", "crcs"):
            out[c] += [b""] * control.num_rows
        out["control"] += [True] * control.num_rows
        events = rows.filter(pc.is_valid(rows.column("key"))).sort_by("bucket").combine_chunks()
        if events.num_rows:
            bucket = events.column("bucket").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            arrays = [events.column(c).to_numpy() for c in ("key", "hour")]
            arrays += [np.array([h or b"" for h in events.column("hash").to_pylist()], _HASH), *(events.column(c).to_numpy() for c in ("n", "crc"))]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for c, x in zip(("keys", "hours", "hashes", "ns", "crcs"), arrays, strict=True):
                    out[c].append(x[a:b].tobytes())
            out["bucket"] += bucket[cuts[:-1]].tolist()
            out["control"] += [False] * (len(cuts) - 1)
            out["batch"] += events.column("batch").to_numpy()[cuts[:-1]].tolist()
            for c in ("floor", "next_floor"):
                out[c] += [None] * (len(cuts) - 1)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield of(pa.Table.from_batches(waiting))
            waiting, n = [], 0
    if n:
        yield of(pa.Table.from_batches(waiting))


def _unpacked(rows: list[pd.DataFrame], **kinds: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(bytes(x) for r in rows for x in r[c]), k) for c, k in kinds.items()]


def tag(parts: Iterator[pd.DataFrame], held: Held, hold: int) -> tuple[list[pd.DataFrame], Held]:
    """First operator, for a bucket and a batch: what it sends, and its state: keys, starts, deadlines, openers of open windows."""
    parts = list(parts)
    bucket, batch, floor, next_floor = next((int(r.bucket), int(r.batch), r.floor, r.next_floor) for p in parts for r in p[p.control.astype(bool)].itertuples())
    ids, hour, hashes, ns, crcs = _unpacked(parts, keys=_LONG, hours=_LONG, hashes=_HASH, ns=_LONG, crcs=_LONG)
    keys, starts, ends, openers = (np.frombuffer(x, k) for x, k in zip(held or (b"",) * 4, (_LONG, _LONG, _LONG, _HASH), strict=True))
    # By key, hour, hash; merged rows after the hashes of their hour, which hold its smallest.
    order = np.lexsort((hashes, hashes == b"", hour, ids))
    if not pd.isna(floor):
        order = order[hour[order] >= floor]
    ids, hour, hashes, ns, crcs = (x[order] for x in (ids, hour, hashes, ns, crcs))
    own, first = np.unique(ids, return_index=True)
    last = np.append(first[1:], len(ids)) if len(own) else first
    # The open windows of the batch's keys, if there are any.
    at = np.searchsorted(keys, own)
    there = keys[np.minimum(at, len(keys) - 1)] == own if len(keys) else np.zeros(len(own), bool)
    start, end = np.zeros(len(own), np.int64), np.full(len(own), -_NEVER)
    opener = np.zeros(len(own), _HASH)
    start[there], end[there], opener[there] = starts[at[there]], ends[at[there]], openers[at[there]]
    window, kind = np.zeros(len(ids), np.int64), np.ones(len(ids), np.int8)
    closed = []
    low = hour.min() if len(hour) else 0
    span = hour.max() - low + 2 if len(hour) else 1
    line = np.repeat(np.arange(len(own)), last - first) * span + (hour - low)
    live, place = np.arange(len(own)), first.copy()
    while len(live):
        # Up to the first event past the deadline all belong to the open window.
        to = np.minimum(np.maximum(place[live], np.searchsorted(line, live * span + np.clip(end[live] - low, -1, span - 2), side="right")), last[live])
        n = to - place[live]
        rows = np.repeat(place[live] - np.cumsum(n) + n, n) + np.arange(n.sum())
        window[rows] = np.repeat(start[live], n)
        kind[rows] = 1 + (hashes[rows] != np.repeat(opener[live], n))
        more = to < last[live]
        live, to = live[more], to[more]
        was = live[there[live]]
        closed.append((own[was], start[was]))
        start[live], end[live], opener[live], there[live] = hour[to], hour[to] + hold, hashes[to], True
        window[to], kind[to] = hour[to], 0
        place[live] = to + 1
    # What is open after the batch; then time.
    stay = ~np.isin(keys, own)
    keys, starts, ends, openers = (np.concatenate((x[stay], y)) for x, y in ((keys, own), (starts, start), (ends, end), (openers, opener)))
    over = np.ones(len(keys), bool) if pd.isna(next_floor) else ends < next_floor
    closed.append((keys[over], starts[over]))
    order = np.flatnonzero(~over)[np.argsort(keys[~over])]
    gone, since = (np.concatenate(x) for x in zip(*closed, strict=True))
    out = []
    if len(ids) + len(gone):
        zero = np.zeros(len(gone), np.int64)
        columns = {"keys": (ids, gone), "starts": (window, since), "kinds": (kind, np.full(len(gone), 3, np.int8)), "hashes": (hashes[kind == 0],), "ns": (ns, zero), "crcs": (np.where(kind == 2, crcs, 0), zero)}
        out.append(pd.DataFrame({"bucket": [bucket], **{c: [np.concatenate(x).tobytes()] for c, x in columns.items()}, "batch": [batch]}))
    return out, tuple(x[order].tobytes() for x in (keys, starts, ends, openers)) if len(order) else None


def count(parts: Iterator[pd.DataFrame], held: Held) -> tuple[list[pd.DataFrame], Held]:
    """Second operator, for a bucket and a batch: what it sends, and its state: keys, starts, hashes and three counters of windows."""
    parts = list(parts)
    batch = int(parts[0].batch.iloc[0])
    ids, since, kind, hashes, n, crc = _unpacked(parts, keys=_LONG, starts=_LONG, kinds=np.dtype(np.int8), hashes=_HASH, ns=_LONG, crcs=_LONG)
    kinds = (_LONG, _LONG, _HASH, _LONG, _LONG, _LONG)
    opened, again, unlike, ends = kind == 0, (kind == 1) | (kind == 2), kind == 2, kind == 3
    fresh = (ids[opened], since[opened], hashes, *(np.zeros(opened.sum(), np.int64),) * 3)
    keys, starts, openers, *counts = (np.concatenate((np.frombuffer(x, k), y)) for x, k, y in zip(held or (b"",) * 6, kinds, fresh, strict=True))
    order = np.lexsort((starts, keys))
    keys, starts, openers, counts = keys[order], starts[order], openers[order], [c[order] for c in counts]
    # A key's windows are in order of their starts: the place of (key, start) is that of its key and rank.
    both = np.lexsort((np.concatenate((np.zeros(len(keys)), np.ones(len(ids)))), np.concatenate((starts, since)), np.concatenate((keys, ids))))
    place = np.empty(len(both), np.int64)
    place[both] = np.cumsum(both < len(keys)) - 1
    place = place[len(keys) :]
    # An opener's event is no repeat; where equal events came merged, the rest of them are.
    np.add.at(counts[0], place, np.where(again, n, np.where(opened, n - 1, 0)))
    np.add.at(counts[1], place[unlike], n[unlike])
    np.add.at(counts[2], place[unlike], crc[unlike])
    done = place[ends]
    out = []
    if len(done):
        out.append(pd.DataFrame({"key": keys[done], "start_hour": starts[done], "closed_batch": batch, "n_repeats": counts[0][done], "n_conflicts": counts[1][done], "conflict_crc": counts[2][done], "hash": [h.ljust(32, b"\0") for h in openers[done]]}))
    left = np.ones(len(keys), bool)
    left[done] = False
    return out, (keys[left].tobytes(), starts[left].tobytes(), openers[left].tobytes(), *(c[left].tobytes() for c in counts)) if left.any() else None


def _folded(rows: DataFrame, fold: Callable, schema: str, names: str) -> DataFrame:
    """A stateful operator by bucket, around a function of a batch's rows and the bucket's state."""

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, after = fold(parts, state.get if state.exists else None)
        if after is not None:
            state.update(after)
        elif state.exists:
            state.remove()
        yield from out

    return rows.groupBy("bucket").applyInPandasWithState(run, schema, ", ".join(f"{n} binary" for n in names.split()), "append", GroupStateTimeout.NoTimeout)


def tagged(events: DataFrame, hold: int = HOLD) -> DataFrame:
    """The first operator over a stream of EVENTS."""
    return _folded(events.mapInArrow(packed, PACKED), lambda rows, held: tag(rows, held, hold), TAGGED, "keys starts deadlines openers")


def counted(events: DataFrame) -> DataFrame:
    """The second operator over a stream of TAGGED."""
    return _folded(events, count, WINDOWS, "keys starts openers repeats conflicts crcs")


def step(made: DataFrame, root: str, name: str) -> None:
    """Runs a streaming query over what has come, to its end, on the checkpoint of its name."""
    out = made.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/checkpoints/{name}").option("compression", "zstd")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def merged_hot(events: DataFrame, total: int) -> DataFrame:
    """events (key, hour, hash, crc, batch) as rows with n: those of keys with very many of them merged; see the module."""
    limit = max(1000, total // HOT_KEYS)
    hot = stored(events.groupBy("key").count().where(F.col("count") > limit).select("key"))  # HOT_KEYS at most
    one = events.withColumn("n", F.lit(1).cast("long"))
    if hot.isEmpty():
        return one
    usual = one.join(F.broadcast(hot), "key", "left_anti")
    many = one.join(F.broadcast(hot), "key", "left_semi")
    # Possible openers: the smallest hash of a key, batch and hour; in later hours and batches events may equal them.
    first = many.groupBy("key", "batch", "hour").agg(F.min("hash").alias("hash")).select("key", "hash").distinct().withColumn("opens", F.lit(True))
    known = many.groupBy("key", "batch", "hour", "hash").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).join(first, ["key", "hash"], "left")
    short = known.groupBy("key", "batch", "hour", F.when(F.col("opens"), F.col("hash")).alias("hash")).agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    return usual.unionByName(short)


def windows(events: DataFrame, batches: int = BATCHES, late: int = LATE, hold: int = HOLD) -> DataFrame:
    """The windows of events (key, hour, hash, crc, batch from 0), fed batch by batch to the streaming query."""
    spark = events.sparkSession
    known = {r.batch: r for r in events.groupBy("batch").agg(F.max("hour").alias("top"), F.count("*").alias("n")).collect()}  # one row a batch
    if not known:
        return spark.createDataFrame([], WINDOWS)
    total = sum(r.n for r in known.values())
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    # What ends before floor is too late in a batch; before the first rows there is none. After the last batch all ends.
    limits, top = [], None
    for b in range(batches):
        floor = None if top is None else top - late
        top = max(x for x in (top, known[b].top if b in known else None) if x is not None) if top is not None or b in known else None
        limits.append((b, floor, None if b == batches - 1 else -_NEVER if top is None else top - late))
    control = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).crossJoin(F.broadcast(spark.createDataFrame(limits, "batch long, floor long, next_floor long")))
    place = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    placed = merged_hot(events, total).withColumn("bucket", place).unionByName(control, allowMissingColumns=True)
    names = [c.split()[0] for c in EVENTS.split(", ")]
    root = own_folder(spark)
    placed.select(*names, F.col("batch").alias("part")).write.option("compression", "zstd").partitionBy("part").parquet(f"{root}/batches")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(f"{root}/arrived"))
    for b in range(batches):
        fs.rename(at(f"{root}/batches/part={b}"), at(f"{root}/arrived/part={b}"))
        step(tagged(spark.readStream.schema(EVENTS).parquet(f"{root}/arrived/part=*"), hold), root, "tagged")
        step(counted(spark.readStream.schema(TAGGED).parquet(f"{root}/tagged")), root, "windows")
    return spark.read.schema(WINDOWS).parquet(f"{root}/windows")


# --- the query ---------------------------------------------------------------


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; of one without a zone as if it were UTC, whatever the session's zone is."""
    if df.schema[name].dataType.simpleString() == "timestamp":
        return F.unix_micros(name)
    x = F.col(name)
    return F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + (F.hour(x) * 60 + F.minute(x)).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("long")


def copies(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """key, hour, hash, crc, batch of all copies of rows of clicks."""
    rows = clicks.select("click_id", "client_id", "kind", "value", "props", epoch_micros(clicks, "ts").alias("us"), epoch_micros(clicks, "arrived_at").alias("came"))
    rows = rows.where("click_id is not null and came is not null").withColumn("at", F.expr("(came - pmod(came, 3600000000)) div 3600000000"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("click_id", F.lit(3)))))
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    rows = rows.withColumn("hour", F.col("at") + 6 * F.col("j") * (F.col("c") % 10)).withColumn("L", F.col("hour") + F.floor(F.col("c") / 10) % 200)
    whole = F.when(~F.isnan("value"), F.floor(F.col("value") * 100 + 0.5))
    said = [F.coalesce(x.cast("string"), F.lit("")) for x in (F.col("client_id"), F.col("kind"), whole, F.col("us"), F.col("props"), F.col("c") % 3)]
    hexed = F.sha2(F.concat_ws("|", *said).cast("binary"), 256)
    return rows.select(F.col("click_id").alias("key"), "hour", F.unhex(hexed).alias("hash"), F.crc32(hexed.cast("binary")).alias("crc"), "L")


def op12_expiring_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies(read_table(spark, sf_dir, "clicks"))
    low, high = rows.agg(F.min("L"), F.max("L")).first()
    cut = rows.withColumn("batch", F.floor((F.col("L") - F.lit(low)) * BATCHES / F.lit((high or 0) - (low or 0) + 1))).drop("L")
    return windows(cut).select(F.col("key").alias("click_id"), "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))


#: crc32 has no function in DuckDB: a table of 256 values and a fold over the bytes of ASCII texts.
SQL = """
with t as (
  select list(v order by i) as t from (
    select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i))
), copies as (
  select *, click_id || ':' || j as said from (select *, unnest(range((click_id % 3 + 3) % 3 + 1)) as j from clicks where click_id is not null and arrived_at is not null)
), numbered as (
  select *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(said, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as c
  from copies, t
), timed as (
  select *, floor(epoch_us(arrived_at) / 3600000000)::bigint + 6 * j * (c % 10) as hour,
    sha256(concat_ws('|', coalesce(client_id::varchar, ''), coalesce(kind, ''), coalesce(floor(100 * value + 0.5)::bigint::varchar, ''), coalesce(epoch_us(ts)::varchar, ''), coalesce(props, ''), c % 3)) as hash
  from numbered
), placed as (
  select click_id, hour, hash, floor((l - min(l) over ()) * 10 / (max(l) over () - min(l) over () + 1))::bigint as batch from (select *, hour + c // 10 % 200 as l from timed)
), tops as (
  select b as batch, (select max(hour) from placed where placed.batch < b) as m, (select max(hour) from placed where placed.batch <= b) as next_m from (select unnest(range(10)) as b)
), events as materialized (
  select p.*, row_number() over (partition by click_id order by p.batch, hour, hash) as n from placed p join tops using (batch) where p.batch = 0 or hour >= m - 24
), folded as (
  with recursive f as (
    select click_id, n, batch, hash, hour as start_hour, hash as opener, batch as opened from events where n = 1
    union all
    select e.click_id, e.n, e.batch, e.hash,
      case when stays then f.start_hour else e.hour end, case when stays then f.opener else e.hash end, case when stays then f.opened else e.batch end
    from (select f.*, e.n as n2, e.hour <= f.start_hour + 48 and not exists (select 1 from tops where tops.batch >= f.batch and tops.batch < e.batch and f.start_hour + 48 < next_m - 24) as stays
      from f join events e on e.click_id = f.click_id and e.n = f.n + 1) f join events e on e.click_id = f.click_id and e.n = f.n2
  )
  select * from f
), counted as (
  select click_id, start_hour, opener, max(batch) as last_batch, min(n) as first_n, max(n) as last_n, count(*) - 1 as n_repeats, count(*) filter (hash <> opener) as n_conflicts,
    coalesce(sum(crc) filter (hash <> opener), 0)::bigint as conflict_crc
  from (select f.*, case when hash <> opener then xor(list_reduce(list_concat([4294967295], list_transform(string_split(hash, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) end as crc from folded f, t)
  group by 1, 2, 3
)
select c.click_id, start_hour, least(
    coalesce((select min(tops.batch) from tops where tops.batch >= last_batch and start_hour + 48 < next_m - 24), 9),
    coalesce((select e.batch from events e where e.click_id = c.click_id and e.n = last_n + 1), 9)) as closed_batch,
  n_repeats, n_conflicts, conflict_crc, opener as hash
from counted c
"""
