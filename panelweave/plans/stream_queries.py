"""Registered queries of viewport streams, speech queues, pages and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import audio, geometry as g, predicates as p, text as t
from ..sources import synth, web
from ..sources.synth import EVENTS_SQL, table
from ..streaming import viewport as v
from .queries import _r, query

HOUR = 3_600_000
_ISLANDS_SQL = f"""{EVENTS_SQL},
i0 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR top IS DISTINCT FROM lag(top) OVER w OR img_key IS DISTINCT FROM lag(img_key) OVER w THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY tab_id ORDER BY ts_ms, seq)),
i1 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY tab_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM i0),
isl AS (SELECT *, min(ts_ms) OVER (PARTITION BY tab_id, run) AS run_start, row_number() OVER (PARTITION BY tab_id, run ORDER BY ts_ms, seq) - 1 AS tick FROM i1)"""


@query(f"WITH {_ISLANDS_SQL} SELECT tab_id, run, top, img_key, min(ts_ms) AS settled_at FROM isl WHERE img_key IS NOT NULL AND ts_ms - run_start >= {HOUR} GROUP BY 1, 2, 3, 4")
def settled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 W6 A15, with the threshold scaled to the table's gaps."""
    return v.settled(synth.viewport_events(spark, sf_dir), HOUR)


@query(f"WITH {_ISLANDS_SQL} SELECT tab_id, run, top, img_key, ts_ms AS fired_at FROM isl WHERE img_key IS NOT NULL AND tick = 1")
def early_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3."""
    return v.early(synth.viewport_events(spark, sf_dir))


@query(f"""
WITH {EVENTS_SQL}, o AS (SELECT tab_id, list({{'ts_ms': ts_ms, 'seq': seq, 'top': top, 'img_key': img_key}} ORDER BY ts_ms, seq) AS l FROM ev WHERE img_key IS NOT NULL GROUP BY 1),
f AS (SELECT tab_id, list_reduce(list_prepend([l[1]], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN x[1].img_key = acc[len(acc)].img_key AND abs(x[1].top - acc[len(acc)].top) <= 0.15 * 800 THEN acc ELSE list_concat(acc, x) END) AS k FROM o)
SELECT tab_id, q.ts_ms, q.seq, q.top, q.img_key FROM (SELECT tab_id, unnest(k) AS q FROM f)
""")
def fresh_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2."""
    return v.fresh_positions(synth.viewport_events(spark, sf_dir).where("img_key is not null"), 800.0)


@query(f"""
WITH {EVENTS_SQL}, o AS (SELECT tab_id, list([ts_ms, seq] ORDER BY ts_ms, seq) AS l FROM ev GROUP BY 1),
f AS (SELECT tab_id, list_reduce(list_prepend([l[1]], list_transform(l[2:], lambda x: [x])), lambda acc, x: CASE WHEN x[1][1] - acc[len(acc)][1] >= {24 * HOUR} THEN list_concat(acc, x) ELSE acc END) AS k FROM o)
SELECT tab_id, q[1] AS ts_ms, q[2] AS seq FROM (SELECT tab_id, unnest(k) AS q FROM f)
""")
def throttled_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, scaled."""
    return v.throttled(synth.viewport_events(spark, sf_dir), 24 * HOUR)


@query(f"""
WITH {EVENTS_SQL}, o AS (SELECT tab_id, list([ts_ms, seq, 3600000 * (1 + seq % 40)] ORDER BY ts_ms, seq) AS l FROM ev GROUP BY 1),
f AS (SELECT tab_id, list_reduce(list_prepend([l[1]], list_transform(l[2:], lambda x: [x])), lambda acc, x: CASE WHEN x[1][1] >= acc[len(acc)][1] + acc[len(acc)][3] THEN list_concat(acc, x) ELSE acc END) AS k FROM o)
SELECT tab_id, q[1] AS ts_ms, q[2] AS seq, q[3] AS took_ms, CASE WHEN q[3] > {30 * HOUR} THEN 'timeout' ELSE 'ok' END AS status FROM (SELECT tab_id, unnest(k) AS q FROM f)
""")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 ST12, scaled."""
    e = synth.viewport_events(spark, sf_dir).withColumn("took_ms", F.lit(HOUR) * (1 + F.col("seq") % 40))
    return v.with_timeout(v.single_flight(e), limit=30 * HOUR)


@query(f"""
WITH {EVENTS_SQL}, r AS (SELECT tab_id, seq AS result_id, ts_ms + 3600000 * (seq % 30) AS done_ms, top, img_key FROM ev)
SELECT r.tab_id, r.result_id FROM r ASOF JOIN (SELECT tab_id, ts_ms, arg_max(top, seq) AS top, arg_max(coalesce(img_key, '~'), seq) AS img_key FROM (SELECT tab_id, ts_ms, seq, coalesce(top, -1) AS top, img_key FROM ev) GROUP BY 1, 2) e
  ON r.tab_id = e.tab_id AND r.done_ms >= e.ts_ms WHERE r.top = e.top AND coalesce(r.img_key, '~') = e.img_key
""")
def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: results whose position is still the same when they are done."""
    e = synth.viewport_events(spark, sf_dir)
    results = e.select("tab_id", F.col("seq").alias("result_id"), (F.col("ts_ms") + F.lit(HOUR) * (F.col("seq") % 30)).alias("done_ms"), "top", "img_key")
    return v.discard_stale(results, e)


@query("""
WITH q AS (SELECT conv_id, turn, text, turn % 3 <> 1 AS new_bubble, length(text) * 55 AS spoken_ms FROM conversations),
p AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN new_bubble THEN 380 ELSE 120 END AS pause_ms, coalesce(text = lag(text) OVER w AND text <> '', false) AS recheck FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, pause_ms, recheck, CAST(coalesce(sum(spoken_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(pause_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_ms FROM p
""")
def speech_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8 ST9 A16."""
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 3 != 1).alias("new_bubble"), (F.length("text") * 55).cast("bigint").alias("spoken_ms"))
    again = v.repeats_last(q.withColumnRenamed("conv_id", "tab_id").withColumn("joined", F.col("text")), ["turn"]).withColumnRenamed("tab_id", "conv_id")
    return v.schedule(again, "conv_id", ["turn"]).select("conv_id", "turn", "pause_ms", "recheck", F.col("start_ms").cast("bigint").alias("start_ms"))


@query("""
WITH a AS (SELECT o_custkey AS capture_id, o_orderkey AS attempt, o_orderkey % 5 AS kept, o_orderkey % 3 AS dropped, CAST(40 + o_orderkey % 60 AS DOUBLE) AS avg_confidence FROM orders)
SELECT capture_id, attempt, kept, dropped, avg_confidence, NOT (capture_id % 4 = 0) AND ((kept > 0 AND avg_confidence < 78) OR dropped > 0) AS retry FROM a
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY dropped, avg_confidence DESC, attempt) = 1
""")
def best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7 A12."""
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("capture_id"), k.alias("attempt"), (k % 5).alias("kept"), (k % 3).alias("dropped"), (40 + k % 60).cast("double").alias("avg_confidence"))
    return v.best_attempt(a).withColumn("retry", v.needs_retry(F.col("kept"), F.col("dropped"), F.col("avg_confidence"), F.col("capture_id") % 4 == 0))


@query(f"""
WITH {EVENTS_SQL}, l AS (SELECT tab_id % 2 AS session_id, seq AS line_ix, ts_ms, coalesce(img_key, 'ERROR') AS kind FROM ev)
SELECT session_id, line_ix, kind FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY line_ix DESC) <= 3000
""")
def last_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring's last rows of two sessions that share the events."""
    log = synth.viewport_events(spark, sf_dir).select((F.col("tab_id") % 2).alias("session_id"), F.col("seq").alias("line_ix"), F.coalesce("img_key", F.lit("ERROR")).alias("kind"))
    return v.last_rows(log)


_LOG_SQL = """
l AS (SELECT user_id AS session_id, CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'ERROR: ' WHEN 1 THEN '2 bubbles dropped as garbage-shaped ' ELSE 'FATAL ' END
  WHEN 'view' THEN 'FINAL READING ORDER: ' WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'speaking: ' WHEN 1 THEN 'speaking (piper): ' ELSE 'speaking (attempt 2): ' END ELSE 'idle ' END || event_id AS line FROM events),
s AS (SELECT session_id, count(*) FILTER (contains(line, 'FINAL READING ORDER:')) AS captures, count(*) FILTER (contains(line, 'speaking:') OR contains(line, 'speaking (piper):')) AS spoken,
  count(*) FILTER (contains(line, 'speaking (attempt')) AS fallbacks, count(*) FILTER (regexp_matches(line, 'ERROR|FATAL')) AS errors, count(*) FILTER (contains(line, 'dropped as garbage-shaped')) AS dropped_garbage FROM l GROUP BY 1)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id") % 3
    error = F.when(k == 0, "ERROR: ").when(k == 1, "2 bubbles dropped as garbage-shaped ").otherwise("FATAL ")
    spoken = F.when(k == 0, "speaking: ").when(k == 1, "speaking (piper): ").otherwise("speaking (attempt 2): ")
    line = F.concat(F.when(kind == "error", error).when(kind == "view", "FINAL READING ORDER: ").when(kind == "click", spoken).otherwise("idle "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), line.alias("line"))


@query(f"WITH {_LOG_SQL} SELECT * FROM s")
def log_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per session."""
    return web.log_summary(_log(spark, sf_dir))


@query(f"""
WITH {_LOG_SQL}, n AS (SELECT session_id, session_id % 11 <> 0 AS ok, session_id % 4 AS page_errors, session_id % 13 = 0 AS hit_cap FROM s),
t AS (SELECT count(*) AS sessions, count(*) FILTER (ok) AS started, count(*) FILTER (ok AND hit_cap) AS capped, sum(captures) FILTER (ok)::bigint AS captures, sum(spoken) FILTER (ok)::bigint AS spoken,
  sum(fallbacks) FILTER (ok)::bigint AS fallbacks, sum(errors) FILTER (ok)::bigint AS errors, sum(dropped_garbage) FILTER (ok)::bigint AS dropped_garbage, sum(page_errors) FILTER (ok)::bigint AS page_errors FROM n JOIN s USING (session_id))
SELECT *, started = sessions AND errors = 0 AND page_errors = 0 AND capped = 0 AS passes FROM t
""")
def suite_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and the pass rule over all sessions."""
    found = web.log_summary(_log(spark, sf_dir))
    k = F.col("session_id")
    return web.suite_result(found.select(k, (k % 11 != 0).alias("ok"), (k % 4).alias("page_errors"), (k % 13 == 0).alias("hit_cap")), found)


# ---------------------------------------------------------------- pages and sites


_ORIGIN = r"""lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')),
  CASE WHEN url ILIKE 'https:%' THEN ':443$' ELSE ':80$' END, '')"""


@query(f"SELECT page_id, {_ORIGIN} AS origin FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://me:pw@') WHEN 1 THEN upper(url) ELSE url END AS url FROM pages)")
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16."""
    url = F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit("://"), F.lit("://me:pw@"))).when(F.col("page_id") % 4 == 1, F.upper("url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", g.origin_of(url).alias("origin"))


_HREFS = r"""hr AS (SELECT page_id, m, unnest(m) AS href, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''>]+)["'']', 1) AS m FROM pages))"""


@query(f"WITH {_HREFS}, b AS (SELECT href, min({{'page_id': page_id, 'pos': pos}}) AS f FROM hr WHERE regexp_matches(href, '/[^/]+$') GROUP BY href) SELECT href, f.page_id AS page_id, CAST(f.pos AS INT) AS pos FROM b")
def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 D6, with a pattern these pages have."""
    return web.first_links(web.links(table(spark, sf_dir, "pages")), r"/[^/]+$")


@query(f"""
WITH {_HREFS}, im AS (SELECT page_id, href || '/p' || (pos % 3) || CASE WHEN pos % 7 = 0 THEN '-logo' ELSE '' END || '.webp' AS src, pos FROM hr),
im2 AS (SELECT page_id, src, min(pos) AS pos FROM im GROUP BY 1, 2),
per AS (SELECT page_id, regexp_extract(src, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n, min(pos) AS first, arg_max(src, pos) AS last_src FROM im2 WHERE NOT contains(lower(src), 'logo') AND NOT contains(lower(src), 'icon') AND NOT contains(lower(src), 'avatar') AND NOT contains(lower(src), 'banner') GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT page_id, dir, n, last_src FROM per QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) = 1
""")
def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tags made of the pages' links."""
    src = F.concat("href", F.lit("/p"), (F.col("pos") % 3).cast("string"), F.when(F.col("pos") % 7 == 0, "-logo").otherwise(""), F.lit(".webp"))
    tags = web.links(table(spark, sf_dir, "pages")).select("page_id", "pos", F.concat(F.lit('<img class="a" src="'), src, F.lit('">')).alias("tag"))
    html = tags.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), "").alias("html"))
    return web.main_image_group(web.images(html))


@query(f"""
WITH o AS (SELECT page_id, {_ORIGIN} AS origin FROM pages),
s AS ((SELECT origin FROM o WHERE page_id % 3 = 0 UNION SELECT origin FROM o WHERE page_id % 5 = 1) EXCEPT SELECT origin FROM o WHERE page_id % 7 = 2)
SELECT origin, (SELECT count(*) FROM o WHERE o.origin = s.origin AND page_id % 2 = 0) AS n_resumed FROM s
""")
def enabled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 U1 U2 S10 ST13."""
    o = table(spark, sf_dir, "pages").select("page_id", g.origin_of(F.col("url")).alias("origin"))
    pick = lambda m, r: o.where(F.col("page_id") % m == r).select("origin")
    sites = web.disable_sites(web.enable_sites(pick(3, 0), pick(5, 1)), pick(7, 2))
    loads = v.resumed(o.withColumn("complete", F.col("page_id") % 2 == 0), sites).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    return sites.join(loads, "origin", "left").select("origin", F.coalesce("n", F.lit(0)).alias("n_resumed"))


@query("""
WITH d(key, value) AS (VALUES ('enabled', 'true'), ('direction', 'rtl'), ('ttsEngine', 'piper'), ('piperVoiceId', 'en_US-hfc_female-medium'), ('kokoroVoiceId', 'af_heart'), ('autoScrollSpeed', '140'), ('volume', '100')),
st AS (SELECT DISTINCT r_name AS key, lower(r_name) AS value FROM region UNION ALL SELECT 'volume', '55'), ov AS (SELECT 'ttsEngine' AS key, 'kokoro' AS value)
SELECT key, coalesce(ov.value, st.value, d.value) AS value FROM d FULL JOIN st USING (key) FULL JOIN ov USING (key)
""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, stored, overrides."""
    stored = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.lower("r_name").alias("value")).unionByName(spark.range(1).select(F.lit("volume").alias("key"), F.lit("55").alias("value")))
    return web.settings(stored, spark.range(1).select(F.lit("ttsEngine").alias("key"), F.lit("kokoro").alias("value")))


@query("""
SELECT event_id, CAST(floor(CAST(value AS DOUBLE) * 100 + 0.5) AS BIGINT) || '::' || event_type || '::x' AS key, CAST(floor(CAST(value AS DOUBLE) * 100 + 0.5) AS BIGINT) AS top, event_type || '::x' AS img_key,
  round(floor(value * 1000.0::DOUBLE / 3 + 0.5) / 1000, 6) AS synth_ms, round(floor(value * 1000.0::DOUBLE + 0.5) / 1000, 6) AS play_start_ms,
  round(floor(value / 7.0::DOUBLE * 1000 + 0.5) / 1000, 6) AS rms_before, round(floor(value / 11.0::DOUBLE * 1000 + 0.5) / 1000, 6) AS rms_after, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END, 100) / 100)) AS applied_volume FROM events
""")
def positions_and_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17 K1."""
    x = F.col("value").cast("double")
    e = table(spark, sf_dir, "events").select("event_id", t.position_key(x * 100, F.concat("event_type", F.lit("::x"))).alias("key"), x.alias("value"))
    clips = e.select(
        F.col("event_id").alias("clip_id"), (x / 3).alias("synth_ms"), x.alias("play_start_ms"), (x / 7).alias("rms_before"), (x / 11).alias("rms_after"),
        audio.volume(F.when(F.col("event_id") % 6 != 0, x)).alias("applied_volume"),
    )
    rows = web.playback_rows(clips).select(F.col("clip_id").alias("event_id"), *(_r(c).alias(c) for c in ("synth_ms", "play_start_ms", "rms_before", "rms_after")), "applied_volume")
    return e.select("event_id", "key", t.parse_position(F.col("key")).alias("p")).select("event_id", "key", "p.top", "p.img_key").join(rows, "event_id")


@query("""
WITH a AS (SELECT conv_id, turn, text, 'ocr' AS source FROM conversations WHERE role <> 'user' UNION ALL SELECT conv_id, turn, text, 'selection' FROM conversations WHERE role = 'user')
SELECT conv_id, turn, text, source, row_number() OVER (PARTITION BY conv_id ORDER BY turn, source, text) || '. ' || text AS numbered FROM a
""")
def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 W5 U3."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    both = web.with_selection(c.where("role <> 'user'").drop("role"), c.where("role = 'user'").drop("role"))
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "source", "text"))
    return both.withColumn("numbered", F.concat(k.cast("string"), F.lit(". "), F.col("text")))


@query("""
WITH e AS (SELECT user_id AS tab_id, event_id AS img, CAST(value AS DOUBLE) * 9.7 - 120 AS top, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 200 + event_id % 300 END AS nw, 200 + event_id % 290 AS nh, 250 + event_id % 200 AS lw FROM events),
f AS (SELECT * FROM e WHERE (CASE WHEN nw <> 0 THEN nw ELSE lw END) >= 320 AND nh >= 320 AND top + nh > 0 AND top < 800),
l AS (SELECT tab_id, list([top, img]::DOUBLE[] ORDER BY img) AS l FROM f GROUP BY 1),
b AS (SELECT tab_id, list_reduce(list_prepend([1e300, -1]::DOUBLE[], l), lambda acc, x: CASE WHEN x[1] < acc[1] THEN [floor(x[1] + 0.5), x[2]] ELSE acc END) AS b FROM l)
SELECT tab_id, CAST(b[1] AS BIGINT) AS top, CAST(b[2] AS BIGINT) AS img FROM b
""")
def topmost_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tab's topmost image of those large enough (layout size where there is no natural one) and in view."""
    i, x = F.col("event_id"), F.col("value").cast("double")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tab_id"), i.alias("img"), (x * 9.7 - 120).alias("top"),
        F.when(i % 3 == 0, 0).otherwise(200 + i % 300).alias("natural_w"), (200 + i % 290).alias("natural_h"), (250 + i % 200).alias("layout_w"),
    )
    fine = p.is_eligible_image(F.col("natural_w"), F.col("natural_h"), F.col("layout_w"), F.col("natural_h"))
    seen = p.in_viewport(F.lit(0), F.col("top"), F.lit(390), F.col("top") + F.col("natural_h"), F.lit(390), F.lit(800))
    return v.topmost(e.where(fine & seen))


@query(
    "WITH v(engine, voice_id, label, ix) AS (VALUES " + ", ".join("('{}', '{}', '{}', {})".format(*row, i) for i, row in enumerate(web.VOICES)) + """),
u AS (SELECT conv_id % 20 AS ix, count(*) AS turns, sum(length(text))::BIGINT AS characters FROM conversations WHERE role <> 'system' GROUP BY 1)
SELECT engine, voice_id, label, coalesce(turns, 0) AS turns, coalesce(characters, 0) AS characters FROM v LEFT JOIN u USING (ix)
"""
)
def voice_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each voice of the registry would speak, conversations being dealt to voices by turns."""
    numbered = [(*row, i) for i, row in enumerate(web.VOICES)]
    ix = spark.createDataFrame([(i, v) for _, v, _, i in numbered], "ix long, voice_id string")
    used = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy((F.col("conv_id") % 20).alias("ix")).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("characters"))
    spoken = web.voices(spark).join(ix, "voice_id").join(used, "ix", "left")
    return spoken.select("engine", "voice_id", "label", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("characters", F.lit(0)).alias("characters"))
