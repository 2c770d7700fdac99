"""The live forms, run as streams over whole tables: rows arrive in slices of time, and the stream is stopped and started
again between slices. Each has the SQL of its batch form, whose rows it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import synth
from ..sources.scratch import shared_folder
from ..streaming import live, viewport as v
from .queries import SQL, query
from .stream_queries import HOUR


@query(SQL["settled_positions"].replace("SELECT tab_id, run, top", "SELECT tab_id, top").replace("GROUP BY 1, 2, 3, 4", "GROUP BY tab_id, run, top, img_key"))
def live_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 as a stream, by polls."""
    e = synth.viewport_events(spark, sf_dir)
    got = live.replay(e, lambda s: live.positions(s, HOUR, timers=False), "ts_ms", shared_folder(spark))
    return got.where("kind = 'settled'").select("tab_id", "top", "img_key", F.col("at_ms").alias("settled_at"))


@query(SQL["fresh_reads"])
def live_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 as a stream."""
    e = synth.viewport_events(spark, sf_dir).where("img_key is not null")
    return live.replay(e, lambda s: live.fresh_positions(s, 800.0), "ts_ms", shared_folder(spark)).drop("batch")


@query(SQL["throttled_probes"])
def live_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6 as a stream."""
    e = synth.viewport_events(spark, sf_dir)
    return live.replay(e, lambda s: live.throttled(s, 24 * HOUR), "ts_ms", shared_folder(spark)).drop("batch")


@query(SQL["single_flight"])
def live_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 ST12 as a stream."""
    e = synth.viewport_events(spark, sf_dir).withColumn("took_ms", F.lit(HOUR) * (1 + F.col("seq") % 40))
    return v.with_timeout(live.replay(e, live.single_flight, "ts_ms", shared_folder(spark)).drop("batch"), limit=30 * HOUR)


@query(SQL["stale_results"])
def live_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 ST12 as a stream of positions, dispatches and results."""
    e = synth.viewport_events(spark, sf_dir)
    none = F.lit(None)
    asked = e.select("tab_id", F.lit("dispatch").alias("kind"), "ts_ms", "seq", F.col("seq").alias("request_id"), "top", "img_key")
    done = e.select("tab_id", F.lit("result").alias("kind"), (F.col("ts_ms") + F.lit(HOUR) * (F.col("seq") % 30)).alias("ts_ms"), "seq", F.col("seq").alias("request_id"), none.cast("long").alias("top"), none.cast("string").alias("img_key"))
    told = e.select("tab_id", F.lit("position").alias("kind"), "ts_ms", "seq", none.cast("long").alias("request_id"), "top", "img_key").unionByName(asked).unionByName(done)
    got = live.replay(told, lambda s: live.judged(s, 40 * HOUR, timers=False), "ts_ms", shared_folder(spark))
    return got.where("status = 'ok'").select("tab_id", F.col("request_id").alias("result_id"))


@query(SQL["last_log_rows"])
def live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 W7 as a stream: the ring after the last batch."""
    log = synth.viewport_events(spark, sf_dir).select((F.col("tab_id") % 2).alias("session_id"), F.col("seq").alias("line_ix"), F.coalesce("img_key", F.lit("ERROR")).alias("kind"))
    return live.latest(live.replay(log, live.log_ring, "line_ix", shared_folder(spark), mode="update"), "session_id")


@query(r"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''>]+)["'']', 1) AS m FROM pages)
SELECT DISTINCT page_id, unnest(m) || '.webp' AS src FROM m
""")
def live_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 as a stream: image tags made of the pages' links; every page comes twice, in different slices."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    tagged = pages.select("page_id", F.regexp_replace("html", r"(?i)href\s*=\s*[\"']([^\"'>]+)[\"']", '<img src="$1.webp">').alias("html"))
    seen = lambda t: tagged.withColumn("seen", F.lit(t) + F.col("page_id") % 1000).withColumn("seen_at", F.timestamp_seconds(F.lit(10_000_000) + F.col("seen")))
    got = live.replay(seen(0).unionByName(seen(2000)), live.new_images, "seen", shared_folder(spark), parts=3)
    return got.select("page_id", "src")


@query("""
WITH q AS (SELECT conv_id, turn, turn % 3 <> 1 AS new_bubble, length(text) * 55 AS spoken_ms FROM conversations),
p AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN new_bubble THEN 380 ELSE 120 END AS pause_ms FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id * 1000000 + turn AS clip_id, floor(spoken_ms / 7.0::DOUBLE * 1000 + 0.5) / 1000 AS synth_ms,
  CAST(coalesce(sum(spoken_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(pause_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS play_start_ms,
  floor(turn / 9.0::DOUBLE * 1000 + 0.5) / 1000 AS rms_before, floor(least(4.0::DOUBLE, turn / 3.0::DOUBLE) * 1000 + 0.5) / 1000 AS rms_after, (turn % 5) / 4.0::DOUBLE AS applied_volume FROM p
""")
def live_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9 K1 as a stream: the queue's start times are carried in state, timing rows written once a batch."""
    spoken = (F.length("text") * 55).cast("long")
    queue = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", F.col("turn").cast("int").alias("turn"), (F.col("turn") % 3 != 1).alias("new_bubble"), spoken.alias("spoken_ms"),
        (F.col("conv_id") * 1000000 + F.col("turn")).cast("long").alias("clip_id"), (spoken / 7.0).alias("synth_ms"), (F.col("turn") / 9.0).alias("rms_before"),
        F.least(F.lit(4.0), F.col("turn") / 3.0).alias("rms_after"), (F.col("turn") % 5 / 4.0).alias("applied_volume"),
    )
    return live.replay(queue, lambda s: live.playback(live.schedule(s, "conv_id")), "turn", shared_folder(spark)).drop("batch")
