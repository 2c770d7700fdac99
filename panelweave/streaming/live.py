"""Live forms of the viewport operators: keyed state with transformWithState, timers where nothing may arrive any more.

Each takes the rows its batch form takes, as a stream, and gives the same rows however the stream is cut into
micro-batches and wherever it is stopped and started again, as long as batches follow the clock of the rows; inside a
batch rows come in any order. What a key holds is bounded: a position, the last row kept, requests not yet answered, a
ring. Timers run on processing time, so a still page settles and a lost answer times out without another event.

State needs the RocksDB store: ``state_store(spark)`` once for a session, before a query starts.
"""

from __future__ import annotations

import uuid
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import web
from . import viewport as v

POLL_MS, IDLE_MS = 200, 3_600_000
Rows = Iterator[Row]


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """Made without a session: state is set up in workers."""
    return T.StructType([T.StructField(n, _TYPES[kind]) for n, kind in (c.split() for c in text.split(", "))])


# ---------------------------------------------------------------- many rows of a key in one

HELD_ROWS, LIST_ROWS, BUCKETS = 1 << 19, 256, 8192


def _listed(batches: list[pa.RecordBatch], key: str, order: list[str]) -> pa.RecordBatch:
    """The rows of a key, in order, as lists of at most LIST_ROWS."""
    rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in (key, *order)]).combine_chunks()
    column = {c: pa.concat_arrays(rows[c].chunks) for c in rows.column_names}
    ends = pc.run_end_encode(column[key]).run_ends.to_numpy()
    sizes = np.diff(ends, prepend=0)
    low = np.flatnonzero((np.arange(rows.num_rows) - np.repeat(ends - sizes, sizes)) % LIST_ROWS == 0)
    cuts = pa.array([*low, rows.num_rows], pa.int32())
    lists = {c: pa.ListArray.from_arrays(cuts, x) for c, x in column.items() if c != key}
    return pa.RecordBatch.from_pydict({key: column[key].take(pa.array(low)), **lists})


def gathered(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``stream`` with the rows of a key in few: a list for each other column. A row costs the worker of a stateful step
    some fifty times what an entry of a list does. Of a task at most HELD_ROWS rows are held."""
    names = [key, *(c for c in stream.columns if c != key)]
    rows = stream.select(names)
    schema = T.StructType([rows.schema[key], *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in names[1:])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield _listed(held, key, order)
                held, n = [], 0
        if n:
            yield _listed(held, key, order)

    return rows.repartition(key).mapInArrow(work, schema)


class _Apart(StatefulProcessor):
    """A step over ``gathered`` rows: it gets them one by one, as named tuples without the key."""

    def __init__(self, step: StatefulProcessor, names: list[str]):
        self.step, self.names = step, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.one = namedtuple("One", self.names, rename=True)._make
        self.step.init(handle)

    def handleInputRows(self, key: Any, rows: Rows, timerValues: Any) -> Rows:
        one = (self.one(x) for r in rows for x in zip(*(r[c] for c in self.names), strict=True))
        return self.step.handleInputRows(key, one, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Rows:
        return self.step.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.step.handleInitialState(key, initialState, timerValues)

    def close(self) -> None:
        self.step.close()


class _Kept:
    """A value state of each key of a bucket, as a list state: read once a batch, and written once if it changed."""

    def __init__(self, state: Any):
        self.state, self.rows, self.changed = state, None, False

    def get(self) -> tuple | None:
        if self.rows is None:
            self.rows = {x[0]: tuple(x[1:]) for x in self.state.get()}
        return self.rows.get(self.key)

    def update(self, value: tuple) -> None:
        self.get()
        self.rows[self.key], self.changed = tuple(value), True

    def write(self) -> None:
        if self.changed:
            self.state.put([(k, *x) for k, x in self.rows.items()])
        self.rows, self.changed = None, False


class _Bucket(_Apart):
    """A step for all keys of a bucket, which keeps nothing but values of a key: three messages to the executor for a
    bucket, where keys of their own take three each."""

    def __init__(self, step: StatefulProcessor, names: list[str], key: T.StructField):
        super().__init__(step, names)
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, []
        self.one = namedtuple("One", self.names, rename=True)._make
        self.step.init(self)

    def getValueState(self, name: str, schema: T.StructType, ttl: None = None) -> _Kept:
        """What the step takes for its handle's."""
        self.kept.append(_Kept(self.handle.getListState(name, T.StructType([self.key, *schema]))))
        return self.kept[-1]

    def _turn(self, key: Any) -> tuple:
        for x in self.kept:
            x.key = key
        return (key,)

    def _write(self) -> None:
        for x in self.kept:
            x.write()

    def handleInputRows(self, key: Any, rows: Rows, timerValues: Any) -> Rows:
        held: dict = {}
        for r in rows:
            held.setdefault(r[self.key.name], []).append(r)
        for k, mine in held.items():
            yield from super().handleInputRows(self._turn(k), mine, timerValues)
        self._write()

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        super().handleInitialState(self._turn(initialState[self.key.name]), initialState, timerValues)
        self._write()


def _through(step: StatefulProcessor, rows: DataFrame, key: str, order: list[str], out: T.StructType, time: str = "none", initial: DataFrame | None = None, together: bool = False) -> DataFrame:
    """With timers a batch holds what came since a moment ago, so rows go to the step as they are, without another shuffle.
    ``together``: keys share the state of their bucket, so the step may have values only, without timers or TTL. A
    checkpoint stands for its BUCKETS."""
    if time != "none":
        return rows.groupBy(key).transformWithState(step, out, "append", time)
    names = [c for c in rows.columns if c != key]
    lists = gathered(rows, key, order)
    if not together:
        return lists.groupBy(key).transformWithState(_Apart(step, names), out, "append", time, None if initial is None else initial.groupBy(key))
    dealt = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket")
    return dealt(lists).transformWithState(_Bucket(step, names, rows.schema[key]), out, "append", time, None if initial is None else dealt(initial))


# ---------------------------------------------------------------- positions: settling, early triggers, reads


class _Positions(StatefulProcessor):
    """Emits early triggers, settled positions and fresh reads of a tab. A timer stands for the polls that don't come: it
    fires when the position has been still for a poll, or for the settling time, since its last event. The last one forgets
    the tab; a TTL would forget it before what is due is told, if a batch takes longer than that."""

    HELD = "top long, img_key string, since long, last long, seen long, ticks int, early boolean, settled boolean"

    def __init__(self, settle: int, poll: int, idle: int, tolerance: float | None, timers: bool):
        self.settle, self.poll, self.idle, self.tolerance, self.timers = settle, poll, idle, tolerance, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", _schema(self.HELD))
        self.read = handle.getValueState("read", _schema("ts_ms long, seq long, top long, img_key string"))

    def _judge(self, tab: Any, held: dict, ts: int, ticks: int) -> Rows:
        """What a position says that has been there from ``since`` to ``ts``, for so many polls more."""
        if held["img_key"] is None:
            return
        here = {"tab_id": tab, "top": held["top"], "img_key": held["img_key"], "at_ms": ts}
        if ticks >= 1 and not held["early"]:
            held["early"] = True
            yield Row(kind="early", **here)
        if ts - held["since"] >= self.settle and not held["settled"]:
            held["settled"] = True
            yield Row(kind="settled", **here)
            if self.tolerance is not None:
                last, new = self.read.get(), (ts, 0, held["top"], held["img_key"])
                if last is None or v.moved(self.tolerance)(last, new):
                    self.read.update(new)
                    yield Row(kind="read", **here)

    def handleInputRows(self, key: Any, rows: Rows, timerValues: Any) -> Rows:
        old = self.at.get()
        held = dict(zip(self.HELD.replace(",", "").split()[::2], old, strict=True)) if old is not None else None
        now = timerValues.getCurrentProcessingTimeInMs() if self.timers else 0
        if self.timers and held is not None and now - held["seen"] >= self.idle:  # a late batch: its timers haven't fired yet
            yield from self._judge(key[0], held, held["last"] + self.idle, held["ticks"] + (self.idle >= self.poll))
            self.read.clear()
            held = None
        for r in sorted(rows, key=lambda r: (r.ts_ms, r.seq)):
            if held is None or (r.top, r.img_key) != (held["top"], held["img_key"]):
                held = {"top": r.top, "img_key": r.img_key, "since": r.ts_ms, "last": r.ts_ms, "seen": now, "ticks": 0, "early": False, "settled": False}
            else:
                held |= {"last": r.ts_ms, "seen": now, "ticks": held["ticks"] + 1}
                yield from self._judge(key[0], held, r.ts_ms, held["ticks"])
        self.at.update(tuple(held.values()))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held["img_key"] is not None and not held["settled"]:
                if not held["early"]:
                    self.handle.registerTimer(now + self.poll)
                self.handle.registerTimer(now + max(0, self.settle - (held["last"] - held["since"])))
            self.handle.registerTimer(now + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Rows:
        old = self.at.get()
        if old is None:
            return
        held = dict(zip(self.HELD.replace(",", "").split()[::2], old, strict=True))
        still = expiredTimerInfo.getExpiryTimeInMs() - held["seen"]
        yield from self._judge(key[0], held, held["last"] + still, held["ticks"] + (still >= self.poll))
        if still >= self.idle:
            self.at.clear()
            self.read.clear()
        else:
            self.at.update(tuple(held.values()))

    def close(self) -> None:
        pass


POSITION = "kind string, tab_id long, top long, img_key string, at_ms long"


def positions(stream: DataFrame, settle: int = v.SETTLE_MS, viewport_h: float | None = None, poll: int = POLL_MS, idle: int = IDLE_MS, timers: bool = True) -> DataFrame:
    """stream: tab_id, ts_ms, seq, top, img_key. kind `early` once a position (its first unchanged poll), `settled` once it
    stayed long enough, `read` (with a viewport_h) if it then isn't the last read again. Tabs without events for ``idle``
    are forgotten. Without timers, only polls decide, as in the batch forms."""
    tolerance = None if viewport_h is None else v.DEDUP_RATIO * viewport_h
    step = _Positions(settle, poll, idle, tolerance, timers)
    rows = stream.select("tab_id", "ts_ms", "seq", "top", "img_key")
    return _through(step, rows, "tab_id", ["ts_ms", "seq"], _schema(POSITION), "processingTime" if timers else "none", together=not timers)


# ---------------------------------------------------------------- walks: fresh reads, throttling, single flight


class _LastKept(StatefulProcessor):
    """Lets rows pass that ``keep`` does, asked with the last one kept and each next; a batch run may hand over its last."""

    def __init__(self, key: str, columns: list[str], schema: T.StructType, keep: Callable[[tuple, tuple], bool]):
        self.key, self.columns, self.schema, self.keep = key, columns, schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key: Any, rows: Rows, timerValues: Any) -> Rows:
        before = last = self.last.get()
        for x in sorted(rows, key=lambda x: x[:2]):
            if last is None or self.keep(tuple(last), x):
                last = x
                yield Row(**{self.key: key[0]}, **dict(zip(self.columns, x, strict=True)))
        if last is not before:
            self.last.update(tuple(last))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.last.update(tuple(initialState[c] for c in self.columns))

    def close(self) -> None:
        pass


def walk(stream: DataFrame, key: str, columns: list[str], keep: Callable[[tuple, tuple], bool], kept_before: DataFrame | None = None) -> DataFrame:
    """``kept_before``: rows that a batch run kept; each key goes on from its last."""
    rows = stream.select(key, *columns)
    held = T.StructType([rows.schema[c] for c in columns])
    initial = None
    if kept_before is not None:
        last = F.max_by(F.struct(*columns), F.struct(*columns[:2])).alias("_last")
        initial = kept_before.groupBy(key).agg(last).select(key, "_last.*")
    return _through(_LastKept(key, columns, held, keep), rows, key, columns[:2], rows.schema, initial=initial, together=True)


def fresh_positions(stream: DataFrame, viewport_h: float, kept_before: DataFrame | None = None) -> DataFrame:
    return walk(stream, "tab_id", ["ts_ms", "seq", "top", "img_key"], v.moved(v.DEDUP_RATIO * viewport_h), kept_before)


def throttled(stream: DataFrame, least: int = v.PROBE_MS, kept_before: DataFrame | None = None) -> DataFrame:
    return walk(stream, "tab_id", ["ts_ms", "seq"], v.apart(least), kept_before)


def single_flight(stream: DataFrame, kept_before: DataFrame | None = None) -> DataFrame:
    return walk(stream, "tab_id", ["ts_ms", "seq", "took_ms"], v.landed, kept_before)


# ---------------------------------------------------------------- requests: stale results, deadlines


class _Requests(StatefulProcessor):
    """A tab's position and its requests that have no answer yet, by id."""

    ORDER = {"position": 0, "dispatch": 1, "result": 2}

    def __init__(self, limit: int, timers: bool):
        self.limit, self.timers = limit, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", _schema("top long, img_key string"))
        self.open = handle.getMapState("open", _schema("request_id long"), _schema("top long, img_key string, sent long, due long"))

    def handleInputRows(self, key: Any, rows: Rows, timerValues: Any) -> Rows:
        # Each look at state is a message to the executor: what a batch opens and answers itself never gets there.
        now = timerValues.getCurrentProcessingTimeInMs() if self.timers else 0
        before = at = self.at.get()
        opened = {}
        for r in sorted(rows, key=lambda r: (r.ts_ms, self.ORDER[r.kind], r.seq)):
            if r.kind == "position":
                at = (r.top, r.img_key)
            elif r.kind == "dispatch":
                opened[r.request_id] = (r.top, r.img_key, r.ts_ms, now + self.limit)
                if self.timers:
                    self.handle.registerTimer(now + self.limit)
            else:
                request = opened.pop(r.request_id, None)
                if self.open.containsKey((r.request_id,)):
                    request = request or self.open.getValue((r.request_id,))
                    self.open.removeKey((r.request_id,))
                if request is None:
                    continue
                top, img_key, sent, _ = request
                same = at is not None and tuple(at) == (top, img_key)
                yield Row(tab_id=key[0], request_id=r.request_id, status="timeout" if r.ts_ms - sent > self.limit else "ok" if same else "stale", at_ms=r.ts_ms)
        if at is not before:
            self.at.update(at)
        for request_id, request in opened.items():
            self.open.updateValue((request_id,), request)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Rows:
        over = [(k[0], x) for k, x in self.open.iterator() if x[3] <= expiredTimerInfo.getExpiryTimeInMs()]
        for request_id, x in sorted(over):
            self.open.removeKey((request_id,))
            yield Row(tab_id=key[0], request_id=request_id, status="timeout", at_ms=x[2] + self.limit)

    def close(self) -> None:
        pass


ANSWER = "tab_id long, request_id long, status string, at_ms long"
_TOLD = ("tab_id", "kind", "ts_ms", "seq", "request_id", "top", "img_key")


def answers(events: DataFrame, dispatches: DataFrame, results: DataFrame, limit: int = v.TIMEOUT_MS, timers: bool = True) -> DataFrame:
    """Three streams by tab: events (ts_ms, seq, top, img_key), dispatches (request_id, ts_ms, top, img_key at dispatch),
    results (request_id, done_ms). A row for each request: `ok`, `stale` (the tab isn't where it was at dispatch) or
    `timeout` (no result within ``limit``; one that comes later counts for nothing)."""
    none = F.lit(None)
    e = events.select("tab_id", F.lit("position").alias("kind"), "ts_ms", "seq", none.cast("long").alias("request_id"), "top", "img_key")
    d = dispatches.select("tab_id", F.lit("dispatch").alias("kind"), "ts_ms", F.col("request_id").alias("seq"), "request_id", "top", "img_key")
    r = results.select("tab_id", F.lit("result").alias("kind"), F.col("done_ms").alias("ts_ms"), F.col("request_id").alias("seq"), "request_id", none.cast("long").alias("top"), none.cast("string").alias("img_key"))
    return judged(e.unionByName(d).unionByName(r), limit, timers)


def judged(told: DataFrame, limit: int = v.TIMEOUT_MS, timers: bool = True) -> DataFrame:
    """The same of one stream that holds all three, told apart by kind: position, dispatch, result."""
    return _through(_Requests(limit, timers), told.select(*_TOLD), "tab_id", ["ts_ms", "seq"], _schema(ANSWER), "processingTime" if timers else "none")


# ---------------------------------------------------------------- log ring


class _Ring(StatefulProcessor):
    """The last lines of a session. Lines are appended and cut back when there are twice as many as kept, so a line costs
    the same however full the ring is."""

    def __init__(self, size: int, schema: T.StructType):
        self.size, self.schema = size, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", self.schema)
        self.held = handle.getValueState("held", _schema("n long"))

    def handleInputRows(self, key: Any, rows: Rows, timerValues: Any) -> Rows:
        n = self.held.get()
        n = 0 if n is None else n[0]
        new = []  # of a batch, the last lines alone can stay: no more of them are held or written
        for r in rows:
            new.append(tuple(r[f.name] for f in self.schema))
            if len(new) > 2 * self.size:
                new = sorted(new, key=lambda x: x[0])[-self.size :]
        new = sorted(new, key=lambda x: x[0])[-self.size :]
        for low in range(0, len(new), self.size):
            part = new[low : low + self.size]
            if n + len(part) > 2 * self.size:
                kept = [*map(tuple, self.lines.get()), *part][-self.size :]
                self.lines.put(kept)
                n = len(kept)
            else:
                self.lines.appendList(part)
                n += len(part)
        self.held.update((n,))
        for x in [*map(tuple, self.lines.get())][-self.size :]:
            yield Row(session_id=key[0], **dict(zip(self.schema.names, x, strict=True)))

    def close(self) -> None:
        pass


def log_ring(stream: DataFrame, size: int = v.LOG_ROWS) -> DataFrame:
    """stream: session_id, line_ix and other columns. Update mode: each batch gives the whole ring of the sessions it has
    lines of; ``ring_sink`` keeps the latest of each."""
    held = T.StructType([stream.schema["line_ix"], *(f for f in stream.schema if f.name not in ("session_id", "line_ix"))])
    out = T.StructType([stream.schema["session_id"], *held])
    return stream.select(out.names).groupBy("session_id").transformWithState(_Ring(size, held), out, "update", "none")


# ---------------------------------------------------------------- speech queue


class _Queue(StatefulProcessor):
    """When each line of a session begins: what was spoken and paused before it."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", _schema("ms long"))

    def handleInputRows(self, key: Any, rows: Rows, timerValues: Any) -> Rows:
        end = self.end.get()
        end = None if end is None else end[0]
        for r in sorted(rows, key=lambda r: r.turn):
            pause = 0 if end is None else v.PAUSE_NEW_MS if r.new_bubble else v.PAUSE_SAME_MS
            start = (end or 0) + pause
            end = start + (r.spoken_ms or 0)
            yield Row(**{n: r[n] for n in self.names}, pause_ms=pause, start_ms=start)
        self.end.update((end or 0,))

    def close(self) -> None:
        pass


def schedule(queue: DataFrame, key: str) -> DataFrame:
    """queue: key, turn, new_bubble, spoken_ms and other columns. Adds pause_ms and start_ms."""
    out = T.StructType([*queue.schema, T.StructField("pause_ms", T.LongType()), T.StructField("start_ms", T.LongType())])
    return queue.groupBy(key).transformWithState(_Queue(queue.columns), out, "append", "none")


def playback(scheduled: DataFrame) -> DataFrame:
    """Timing rows of a scheduled queue that has clip_id, synth_ms, rms_before, rms_after and applied_volume."""
    return web.playback_rows(scheduled.withColumn("play_start_ms", F.col("start_ms").cast("double")))


# ---------------------------------------------------------------- images, sites, sinks


def new_images(pages: DataFrame, clock: str = "seen_at", forget_after: str = "1 day") -> DataFrame:
    """Images of a stream of pages (page_id, html, and when it was seen), each source once a page, however often the page
    or the file that holds it comes again within ``forget_after``."""
    tags = web.image_tags(pages.withWatermark(clock, forget_after), clock)
    return tags.dropDuplicatesWithinWatermark(["page_id", "src"])


Sink = Callable[[DataFrame, int], None]


def once_per_batch(path: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    """A foreachBatch sink: a batch is its own folder, so one that is written again replaces itself and adds no row."""

    def put(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return put


def resumed_sink(sites_path: str, path: str) -> Sink:
    """Completed page loads of enabled sites: the sites are read anew for each batch, so a change takes effect with the
    next."""

    def pick(loads: DataFrame) -> DataFrame:
        return v.resumed(loads, loads.sparkSession.read.schema("origin string").parquet(sites_path))

    return once_per_batch(path, pick)


def latest(written: DataFrame, key: str) -> DataFrame:
    """Of rows written with their batch: those of each key's last batch."""
    last = written.groupBy(key).agg(F.max("batch").alias("batch"))
    return written.join(last, [key, "batch"], "left_semi").drop("batch")


def replay(rows: DataFrame, live: Callable[[DataFrame], DataFrame], clock: str, folder: str, parts: int = 2, mode: str = "append", sink: Callable[[str], Sink] = once_per_batch) -> DataFrame:
    """A live form over a table as if it arrived: rows come in ``parts`` slices of their clock, and the stream is stopped
    after each slice and started again from its checkpoint. Gives what the sink holds at the end, with the batch."""
    spark = rows.sparkSession
    state_store(spark)
    at = f"{folder}/replay-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(clock), F.max(clock)).first()
    name = "_slice"
    slices = rows.withColumn(name, F.coalesce(F.floor((F.col(clock) - F.lit(low)) * parts / (F.lit(high) - F.lit(low) + 1)), F.lit(0)).cast("int")) if low is not None else rows.withColumn(name, F.lit(0))
    for k in range(parts if low is not None else 1):
        slices.where(F.col(name) == k).drop(name).write.mode("append").parquet(f"{at}/arrived")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/arrived")
        query = live(stream).writeStream.outputMode(mode).foreachBatch(sink(f"{at}/out")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    held = live(spark.readStream.schema(rows.schema).parquet(f"{at}/arrived")).schema
    schema = T.StructType([*held, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{at}/out")
