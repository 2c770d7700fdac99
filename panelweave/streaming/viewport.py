"""Viewport and speech stream operators in batch form: windows or walks over one tab's ordered events. live.py keeps the
same folds in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SETTLE_MS, DEDUP_RATIO, PROBE_MS = 350, 0.15, 700
PAUSE_NEW_MS, PAUSE_SAME_MS, LOW_CONFIDENCE, RECHECK_MS = 380, 120, 78.0, 1200
TIMEOUT_MS, LOG_ROWS = 20000, 3000


def islands(events: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Runs of equal position: adds run (number), run_start and tick (0 for the run's first poll)."""
    w = W.partitionBy("tab_id").orderBy(ts, "seq")
    same = F.col("top").eqNullSafe(F.lag("top").over(w)) & F.col("img_key").eqNullSafe(F.lag("img_key").over(w))
    first = F.row_number().over(w) == 1
    runs = events.withColumn("_new", (first | ~same).cast("int")).withColumn("run", F.sum("_new").over(w))
    r = W.partitionBy("tab_id", "run").orderBy(ts, "seq")
    return runs.withColumn("run_start", F.first(ts).over(r)).withColumn("tick", F.row_number().over(r) - 1).drop("_new")


def settled(events: DataFrame, settle: int = SETTLE_MS, ts: str = "ts_ms") -> DataFrame:
    """One row per run that stayed long enough: the poll that saw it. A null position never settles."""
    ok = islands(events, ts).where(F.col("img_key").isNotNull() & (F.col(ts) - F.col("run_start") >= settle))
    return ok.groupBy("tab_id", "run", "top", "img_key").agg(F.min(ts).alias("settled_at"))


def early(events: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """One speculative trigger per run: its first unchanged poll."""
    return islands(events, ts).where((F.col("tick") == 1) & F.col("img_key").isNotNull()).select("tab_id", "run", "top", "img_key", F.col(ts).alias("fired_at"))


def positions_match(top_a: Column, key_a: Column, top_b: Column, key_b: Column, tolerance: Column) -> Column:
    return (key_a == key_b) & (F.abs(top_a - top_b) <= tolerance)


def _walk(df: DataFrame, key: str, columns: list[str], keep: Callable[[tuple, tuple], bool]) -> DataFrame:
    """``columns`` (the first two give the order) of the rows that ``keep`` lets pass, asked with the last one kept of
    their key and each next. Rows come sorted, and only the last kept one is held: no group is ever in memory whole."""
    ordered = df.select(key, *columns).repartition(key).sortWithinPartitions(key, *columns[:2])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, begun = None, None, False
        for batch in batches:
            kept = []
            for i, (k, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if not begun or k != at or keep(last, row):
                    at, last, begun = k, row, True
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return ordered.mapInArrow(work, ordered.schema)


def moved(tolerance: float) -> Callable[[tuple, tuple], bool]:
    """Rows (ts, seq, top, img_key): another image, or further away than the tolerance."""

    def differs(last: tuple, x: tuple) -> bool:
        return None in (*last[2:], *x[2:]) or x[3] != last[3] or abs(x[2] - last[2]) > tolerance

    return differs


def apart(least: int) -> Callable[[tuple, tuple], bool]:
    """Rows (ts, seq): at least so long after the last one kept."""
    return lambda last, x: x[0] - last[0] >= least


def landed(last: tuple, x: tuple) -> bool:
    """Rows (ts, seq, took_ms): the last one kept is over."""
    return last[2] is not None and x[0] >= last[0] + last[2]


def fresh_positions(reads: DataFrame, viewport_h: float, ts: str = "ts_ms") -> DataFrame:
    """Reads whose position differs from the last kept read only; an older position may come again."""
    return _walk(reads, "tab_id", [ts, "seq", "top", "img_key"], moved(DEDUP_RATIO * viewport_h))


def throttled(events: DataFrame, least: int = PROBE_MS, ts: str = "ts_ms") -> DataFrame:
    """Events at least ``least`` after the last one let through."""
    return _walk(events, "tab_id", [ts, "seq"], apart(least))


def single_flight(requests: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Requests (with took_ms) that start when the last accepted one is over."""
    return _walk(requests, "tab_id", [ts, "seq", "took_ms"], landed)


def discard_stale(results: DataFrame, events: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """results: tab_id, result_id, done_ms, top, img_key at dispatch. Kept if the position at completion is the same:
    an as-of join by one window over both streams, no pairs."""
    e = events.select("tab_id", F.col(ts).alias("t"), F.col("seq").alias("s"), F.lit(0).alias("kind"), F.struct("top", "img_key").alias("now"))
    r = results.select("tab_id", F.col("done_ms").alias("t"), F.col("result_id").alias("s"), F.lit(1).alias("kind"), F.lit(None).alias("now"), "result_id", F.col("top").alias("r_top"), F.col("img_key").alias("r_key"))
    w = W.partitionBy("tab_id").orderBy("t", "kind", "s").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = e.unionByName(r, allowMissingColumns=True).withColumn("now", F.last("now", True).over(w))
    same = F.col("now.top").eqNullSafe(F.col("r_top")) & F.col("now.img_key").eqNullSafe(F.col("r_key"))
    return both.where((F.col("kind") == 1) & same).select("tab_id", "result_id")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """attempts: capture_id, attempt, kept, dropped, avg_confidence. Fewer dropped, then surer, then earlier."""
    best = F.min_by(F.struct("attempt", "kept", "dropped", "avg_confidence"), F.struct("dropped", -F.col("avg_confidence"), "attempt"))
    return attempts.groupBy("capture_id").agg(best.alias("b")).select("capture_id", "b.*")


def needs_retry(kept: Column, dropped: Column, avg: Column, force: Column) -> Column:
    return ~force & (((kept > 0) & (avg < LOW_CONFIDENCE)) | (dropped > 0))


def repeats_last(reads: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``recheck``: the joined text equals the previous read's."""
    w = W.partitionBy("tab_id").orderBy(*order)
    return reads.withColumn("recheck", F.coalesce((F.col("joined") == F.lag("joined").over(w)) & (F.col("joined") != ""), F.lit(False)))


def schedule(queue: DataFrame, key: str, order: list[str]) -> DataFrame:
    """queue: new_bubble, spoken_ms. Adds start_ms: what is spoken and paused before each line."""
    w = W.partitionBy(key).orderBy(*order)
    pause = F.when(F.row_number().over(w) == 1, 0).when(F.col("new_bubble"), PAUSE_NEW_MS).otherwise(PAUSE_SAME_MS)
    before = F.coalesce(F.sum("spoken_ms").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return queue.withColumn("pause_ms", pause).withColumn("start_ms", before + F.sum("pause_ms").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def with_timeout(requests: DataFrame, took: str = "took_ms", limit: int = TIMEOUT_MS) -> DataFrame:
    return requests.withColumn("status", F.when(F.col(took).isNull() | (F.col(took) > limit), "timeout").otherwise("ok"))


def resumed(loads: DataFrame, sites: DataFrame) -> DataFrame:
    """Completed page loads of enabled sites."""
    return loads.where("complete").join(sites.select("origin"), "origin", "left_semi")


def last_rows(log: DataFrame, n: int = LOG_ROWS, key: str = "session_id", order: str = "line_ix") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def topmost(images: DataFrame) -> DataFrame:
    """images: tab_id, img, top, those that count. The position signal of each tab: images are met in order, and one
    replaces the best if its top, as it is, is less than the best's rounded one."""
    ordered = images.groupBy("tab_id").agg(F.array_sort(F.collect_list(F.struct("img", F.col("top").cast("double").alias("top")))).alias("rows"))
    none = F.struct(F.lit(None).cast("bigint").alias("top"), F.lit(None).cast(images.schema["img"].dataType).alias("img"))

    def meet(best: Column, x: Column) -> Column:
        higher = best["top"].isNull() | (x["top"] < best["top"])
        return F.when(higher, F.struct(F.floor(x["top"] + 0.5).alias("top"), x["img"].alias("img"))).otherwise(best)

    return ordered.select("tab_id", F.aggregate("rows", none, meet).alias("b")).select("tab_id", "b.*")
