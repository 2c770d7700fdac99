"""Live forms: equal to their batch forms under any cut into micro-batches and across restarts; timers; sinks."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from panelweave.streaming import live, viewport as v

EVENT = "tab_id long, ts_ms long, seq long, top long, img_key string, took_ms long"


@pytest.fixture(scope="module")
def events(spark):
    rng, rows = random.Random(8), []
    for tab in range(4):
        t, top, key = 0, 0, "a"
        for _ in range(120):
            t += rng.choice((100, 200, 200, 300))
            if rng.random() < 0.3:
                top, key = rng.randrange(0, 1000, 50), rng.choice(("a", "b", None))
            rows.append((tab, t, len(rows), top if key else None, key, rng.randrange(50, 2500)))
    return spark.createDataFrame(rows, EVENT).cache()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(params=[3])
def played(request, tmp_path):
    def run(rows, form, clock="ts_ms", **options):
        return live.replay(rows, form, clock, str(tmp_path), request.param, **options)

    return run


def test_positions(events, played):
    got = played(events, lambda s: live.positions(s, viewport_h=1000.0, timers=False)).cache()
    own = ("tab_id", "top", "img_key")
    settled = v.settled(events).select(*own, F.col("settled_at").alias("at_ms"))
    assert rows_of(got.where("kind = 'settled'"), *own, "at_ms") == rows_of(settled, *own, "at_ms")
    assert rows_of(got.where("kind = 'early'"), *own, "at_ms") == rows_of(v.early(events), *own, "fired_at")
    reads = v.fresh_positions(settled.selectExpr("*", "at_ms as ts_ms", "0L as seq"), 1000.0)
    assert rows_of(got.where("kind = 'read'"), *own, "at_ms") == rows_of(reads, *own, "ts_ms")


def test_walks(events, played):
    own = ("tab_id", "ts_ms", "seq")
    assert rows_of(played(events, live.throttled), *own) == rows_of(v.throttled(events), *own)
    assert rows_of(played(events, live.single_flight), *own) == rows_of(v.single_flight(events), *own)
    assert rows_of(played(events, lambda s: live.fresh_positions(s, 1000.0)), *own) == rows_of(v.fresh_positions(events, 1000.0), *own)


def test_a_stream_goes_on_where_a_batch_run_ended(events, tmp_path):
    half = events.agg(F.max("ts_ms")).first()[0] // 2
    before, after = events.where(F.col("ts_ms") <= half), events.where(F.col("ts_ms") > half)
    for form, batch, columns in ((live.throttled, v.throttled, ("tab_id", "ts_ms", "seq")), (live.single_flight, v.single_flight, ("tab_id", "ts_ms", "seq", "took_ms"))):
        done = batch(before)
        got = live.replay(after, lambda s, form=form, done=done: form(s, kept_before=done), "ts_ms", str(tmp_path), 2)
        assert sorted(rows_of(done, *columns) + rows_of(got, *columns)) == sorted(rows_of(batch(events), *columns))


def told(events):
    """Events, a request at every third of them, and its result after took_ms, in one table."""
    e = events.select("tab_id", F.lit("position").alias("kind"), "ts_ms", "seq", F.lit(None).cast("long").alias("request_id"), "top", "img_key")
    asked = events.where("seq % 3 = 0 and img_key is not null")
    d = asked.select("tab_id", F.lit("dispatch").alias("kind"), "ts_ms", "seq", F.col("seq").alias("request_id"), "top", "img_key")
    r = asked.select("tab_id", F.lit("result").alias("kind"), (F.col("ts_ms") + F.col("took_ms")).alias("ts_ms"), "seq", F.col("seq").alias("request_id"), F.lit(None).cast("long").alias("top"), F.lit(None).cast("string").alias("img_key"))
    return e.unionByName(d).unionByName(r), asked


def test_answers(events, played):
    both, asked = told(events)
    got = played(both, lambda s: live.judged(s, limit=2000, timers=False)).cache()
    results = asked.select("tab_id", F.col("seq").alias("result_id"), (F.col("ts_ms") + F.col("took_ms")).alias("done_ms"), "top", "img_key")
    late = {r.seq for r in asked.where("took_ms > 2000").collect()}
    fresh = {(r.tab_id, r.result_id) for r in v.discard_stale(results, events).collect()}
    assert got.count() == asked.count() and late and fresh
    for r in got.collect():
        assert r.status == ("timeout" if r.request_id in late else "ok" if (r.tab_id, r.request_id) in fresh else "stale")


def test_log_ring(spark, played):
    log = spark.createDataFrame([(s, i, f"line {i}") for s in range(3) for i in range(10 + 60 * s)], "session_id int, line_ix int, line string")
    got = live.latest(played(log, lambda s: live.log_ring(s, 25), "line_ix", mode="update"), "session_id")
    assert rows_of(got, "session_id", "line_ix", "line") == rows_of(v.last_rows(log, 25), "session_id", "line_ix", "line")


def queue_rows(spark):
    rows = [(c, t, t % 3 != 1, 40 * t + c, 1000 * c + t, 12.34567, 0.5, 0.1, 1.0) for c in range(4) for t in range(20)]
    return spark.createDataFrame(rows, "session_id int, turn int, new_bubble boolean, spoken_ms long, clip_id long, synth_ms double, rms_before double, rms_after double, applied_volume double")


def test_queue(spark, played):
    queue = queue_rows(spark)
    got = played(queue, lambda s: live.playback(live.schedule(s, "session_id")), "turn")
    want = live.playback(v.schedule(queue, "session_id", ["turn"]))
    columns = ("clip_id", "synth_ms", "play_start_ms", "rms_before", "rms_after", "applied_volume")
    assert rows_of(got, *columns) == rows_of(want, *columns) and set(columns) < set(got.columns)


def test_a_batch_written_again_adds_no_row(spark, tmp_path):
    put, rows = live.once_per_batch(str(tmp_path / "out")), queue_rows(spark)
    put(rows, 0)
    put(rows.limit(3), 1)
    put(rows, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 83


def test_new_images(spark, played):
    html = '<img src="/a.png"><p><IMG class=x src=\'/b.png\'><img src="/a.png">'
    pages = spark.createDataFrame([(p, html + f'<img src="/{p}-{t}.png">', t) for p in range(3) for t in range(4)], "page_id int, html string, t int")
    pages = pages.withColumn("seen_at", F.timestamp_seconds(F.col("t") + 10_000_000))
    again = pages.unionByName(pages)  # every page comes twice
    got = played(again, live.new_images, "t")
    assert rows_of(got, "page_id", "src") == sorted([(p, s) for p in range(3) for s in ("/a.png", "/b.png", *(f"/{p}-{t}.png" for t in range(4)))], key=str)


def test_a_site_added_between_batches_takes_effect(spark, tmp_path):
    at = str(tmp_path)
    add = lambda o: spark.createDataFrame([(o,)], "origin string").write.mode("append").parquet(f"{at}/sites")
    load = lambda n: spark.createDataFrame([(n, o, True) for o in "ab"] + [(n, "a", False)], "n int, origin string, complete boolean").coalesce(1).write.mode("append").parquet(f"{at}/loads")
    add("a")
    load(1)
    stream = spark.readStream.schema("n int, origin string, complete boolean").option("maxFilesPerTrigger", 1).parquet(f"{at}/loads")
    for _ in range(2):
        stream.writeStream.foreachBatch(live.resumed_sink(f"{at}/sites", f"{at}/out")).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
        if _ == 0:
            add("b")
            load(2)
    assert rows_of(spark.read.parquet(f"{at}/out"), "n", "origin") == [(1, "a"), (2, "a"), (2, "b")]


def wait_for(query, done, seconds=60):
    end = time.time() + seconds
    while not done():
        assert time.time() < end and query.isActive, query.exception()
        time.sleep(0.2)


def test_timers_fire_without_another_event(spark, tmp_path):
    live.state_store(spark)
    at, columns = str(tmp_path), "tab_id long, ts_ms long, seq long, top long, img_key string"
    spark.createDataFrame([(1, 1000, 1, 100, "a"), (2, 1000, 2, 5, None)], columns).coalesce(1).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(columns).parquet(f"{at}/in")
    form = live.positions(stream, viewport_h=800.0, idle=4000)
    query = form.writeStream.format("memory").queryName("still").option("checkpointLocation", f"{at}/cp").trigger(processingTime="100 milliseconds").start()
    try:
        wait_for(query, lambda: spark.table("still").count() == 3)
        got = {r.kind: r for r in spark.table("still").collect()}
        assert set(got) == {"early", "settled", "read"} and all(r.tab_id == 1 and r.top == 100 for r in got.values())
        assert got["early"].at_ms >= 1200 and got["settled"].at_ms >= 1350
        # The same position after the tab was forgotten is a new one.
        time.sleep(5)
        spark.createDataFrame([(1, 9000, 3, 100, "a")], columns).coalesce(1).write.mode("append").parquet(f"{at}/in")
        wait_for(query, lambda: spark.table("still").where("kind = 'read'").count() == 2)
    finally:
        query.stop()


def test_a_request_without_an_answer_times_out(spark, tmp_path):
    live.state_store(spark)
    at = str(tmp_path)
    columns = "tab_id long, kind string, ts_ms long, seq long, request_id long, top long, img_key string"
    rows = [(1, "position", 0, 0, None, 100, "a"), (1, "dispatch", 1, 1, 7, 100, "a"), (1, "dispatch", 2, 2, 8, 100, "a"), (1, "result", 3, 3, 8, None, None)]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(columns).parquet(f"{at}/in")
    start = lambda: live.judged(stream, limit=500).writeStream.foreachBatch(live.once_per_batch(f"{at}/out")).option("checkpointLocation", f"{at}/cp").trigger(processingTime="100 milliseconds").start()
    seen = lambda: {r.request_id: r.status for r in spark.read.schema(live.ANSWER).parquet(f"{at}/out").collect()}
    query = start()
    try:
        wait_for(query, lambda: query.lastProgress is not None and seen().get(8) == "ok")
        query.stop()  # the deadline outlives the query
        query = start()
        wait_for(query, lambda: seen().get(7) == "timeout")
        # An answer after the deadline counts for nothing.
        spark.createDataFrame([(1, "result", 600, 4, 7, None, None)], columns).coalesce(1).write.mode("append").parquet(f"{at}/in")
        wait_for(query, lambda: any(x["numInputRows"] for x in query.recentProgress))  # the only rows since the start
        assert seen() == {7: "timeout", 8: "ok"} and spark.read.schema(live.ANSWER).parquet(f"{at}/out").count() == 2
    finally:
        query.stop()


def test_a_late_batch_tells_what_was_due(spark, tmp_path):
    """The tab is idle before the next batch begins: what its position had to say by then isn't lost."""
    live.state_store(spark)
    at, columns = str(tmp_path), "tab_id long, ts_ms long, seq long, top long, img_key string"
    spark.createDataFrame([(1, 1000, 1, 100, "a")], columns).coalesce(1).write.parquet(f"{at}/in")
    form = live.positions(spark.readStream.schema(columns).parquet(f"{at}/in"), viewport_h=800.0, idle=400)
    query = form.writeStream.format("memory").queryName("late").option("checkpointLocation", f"{at}/cp").trigger(processingTime="1 second").start()
    try:
        wait_for(query, lambda: spark.table("late").count() == 3, 30)
        assert sorted((r.kind, r.at_ms) for r in spark.table("late").collect()) == [("early", 1200), ("read", 1350), ("settled", 1350)]
    finally:
        query.stop()
