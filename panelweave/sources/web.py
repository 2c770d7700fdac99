"""Sources and sinks: images and links of pages, sites, settings, sessions' logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import directory, is_page_image

CHAPTER = r"(?i)/manga/[^/]+/chapter-\d+$"
# --- fixed values ---
DEFAULTS = {
    "enabled": "true",
    "direction": "rtl",
    "ttsEngine": "piper",
    "piperVoiceId": "en_US-hfc_female-medium",
    "kokoroVoiceId": "af_heart",
    "autoScrollSpeed": "140",
    "volume": "100",
}
VOICES = [
    ("piper", "en_US-hfc_female-medium", "HFC Female (default)"),
    ("piper", "en_US-amy-medium", "Amy (female)"),
    ("piper", "en_US-kathleen-low", "Kathleen (female)"),
    ("piper", "en_US-kristin-medium", "Kristin (female)"),
    ("piper", "en_US-ljspeech-high", "LJSpeech (female, high quality — slower)"),
    ("piper", "en_US-hfc_male-medium", "HFC Male"),
    ("piper", "en_US-ryan-medium", "Ryan (male)"),
    ("piper", "en_US-joe-medium", "Joe (male)"),
    ("piper", "en_US-danny-low", "Danny (male)"),
    ("piper", "en_US-bryce-medium", "Bryce (male)"),
    ("kokoro", "af_heart", "Heart (US female, default)"),
    ("kokoro", "af_bella", "Bella (US female)"),
    ("kokoro", "af_nicole", "Nicole (US female)"),
    ("kokoro", "af_sarah", "Sarah (US female)"),
    ("kokoro", "af_kore", "Kore (US female)"),
    ("kokoro", "am_fenrir", "Fenrir (US male)"),
    ("kokoro", "am_michael", "Michael (US male)"),
    ("kokoro", "am_puck", "Puck (US male)"),
    ("kokoro", "bf_emma", "Emma (UK female)"),
    ("kokoro", "bm_george", "George (UK male)"),
]
# --- end of fixed values ---


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Screenshots as binary files."""
    return spark.read.format("binaryFile").load(path)


def image_tags(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, pos, src of every image tag, and ``more`` columns."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<img[^>]*?\ssrc\s*=\s*[\"']([^\"'>]+)[\"']"), F.lit(1))
    return pages.select("page_id", *more, F.posexplode(tags).alias("pos", "src"))


def images(pages: DataFrame) -> DataFrame:
    """page_id, pos, src, each source once a page (repeated discovery changes nothing)."""
    return image_tags(pages).groupBy("page_id", "src").agg(F.min("pos").alias("pos"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']([^\"'>]+)[\"']"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def first_links(found: DataFrame, pattern: str = CHAPTER, n: int | None = None) -> DataFrame:
    """Matching links in order of first appearance, each once."""
    place = F.min(F.struct("page_id", "pos"))
    out = found.where(F.col("href").rlike(pattern)).groupBy("href").agg(place.alias("first")).select("href", "first.page_id", "first.pos")
    return out if n is None else out.orderBy("page_id", "pos").limit(n)


def main_image_group(found: DataFrame) -> DataFrame:
    """The last image of each page's largest directory of page images (two or more; the first directory wins ties)."""
    own = found.where(is_page_image(F.col("src"))).withColumn("dir", directory(F.col("src")))
    per = own.groupBy("page_id", "dir").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max_by("src", "pos").alias("last_src")).where("n >= 2")
    best = F.max_by(F.struct("dir", "n", "last_src"), F.struct("n", -F.col("first")))
    return per.groupBy("page_id").agg(best.alias("b")).select("page_id", "b.*")


def add_site(sites: Column, origin: Column) -> Column:
    return F.array_union(sites, F.array(origin))


def remove_site(sites: Column, origin: Column) -> Column:
    return F.array_except(sites, F.array(origin))


def enable_sites(sites: DataFrame, more: DataFrame) -> DataFrame:
    return sites.select("origin").union(more.select("origin")).distinct()


def disable_sites(sites: DataFrame, gone: DataFrame) -> DataFrame:
    return sites.select("origin").distinct().join(gone.select("origin"), "origin", "left_anti")


def settings(stored: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """key, value: defaults, then what is stored, then overrides."""
    spark = stored.sparkSession
    out = spark.createDataFrame(list(DEFAULTS.items()), "key string, value string")
    for layer in (stored, *([override] if override is not None else [])):
        new = layer.select("key", F.col("value").alias("new"))
        out = out.join(new, "key", "full").select("key", F.coalesce("new", "value").alias("value"))
    return out


def voices(spark: SparkSession, rows: list[tuple[str, str, str]] = VOICES) -> DataFrame:
    return spark.createDataFrame(rows, "engine string, voice_id string, label string")


def with_selection(bubbles: DataFrame, selected: DataFrame) -> DataFrame:
    """Recognised text and selected text (which skips every repair step), tagged by source."""
    return bubbles.withColumn("source", F.lit("ocr")).unionByName(selected.withColumn("source", F.lit("selection")), allowMissingColumns=True)


def log_summary(log: DataFrame) -> DataFrame:
    """log: session_id, line. What each session's log says."""
    line = F.col("line")
    return log.groupBy("session_id").agg(
        F.count_if(line.contains("FINAL READING ORDER:")).alias("captures"),
        F.count_if(line.contains("speaking:") | line.contains("speaking (piper):")).alias("spoken"),
        F.count_if(line.contains("speaking (attempt")).alias("fallbacks"),
        F.count_if(line.rlike("ERROR|FATAL")).alias("errors"),
        F.count_if(line.contains("dropped as garbage-shaped")).alias("dropped_garbage"),
    )


def suite_result(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """sessions: session_id, ok (it started), page_errors, hit_cap. One row: the totals, and whether the suite passes: every
    session started, no error lines in those that did, no page errors, none stopped by the safety cap."""
    both = sessions.join(summaries, "session_id", "left")
    own = lambda c: F.sum(F.when(F.col("ok"), F.coalesce(F.col(c).cast("bigint"), F.lit(0))).otherwise(0))
    totals = both.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("ok").alias("started"), F.count_if(F.col("ok") & F.col("hit_cap")).alias("capped"),
        *(F.coalesce(own(c), F.lit(0)).alias(c) for c in ("captures", "spoken", "fallbacks", "errors", "dropped_garbage", "page_errors")),
    )
    clean = (F.col("started") == F.col("sessions")) & (F.col("errors") == 0) & (F.col("page_errors") == 0) & (F.col("capped") == 0)
    return totals.withColumn("passes", clean)


def playback_rows(clips: DataFrame) -> DataFrame:
    """Timing rows of the speech sink, rounded to three places."""
    r = lambda c: F.floor(F.col(c) * 1000 + 0.5) / 1000
    return clips.select("clip_id", r("synth_ms").alias("synth_ms"), r("play_start_ms").alias("play_start_ms"), r("rms_before").alias("rms_before"), r("rms_after").alias("rms_after"), "applied_volume")


def save(df: DataFrame, path: str) -> None:
    """Overwriting sink (last capture, settings)."""
    df.write.mode("overwrite").parquet(path)
