"""The registered queries of the layout, text and stream operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g, predicates as p, text as t
from ..operators import lexicon_repair
from ..sources import synth
from ..sources.synth import CANVAS_H, CANVAS_W, LINES_SQL, VIEWPORT_H, VIEWPORT_W, WORDS_SQL, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


# ---------------------------------------------------------------- geometry


@query(f"""
WITH {WORDS_SQL}
SELECT capture_id, word_ix, x1 - x0 AS width, y1 - y0 AS height, (y0 + y1) / 2 AS center_y,
  round(y0 * 120 / 150, 6) AS css_y, round(x0 * 520 / 390, 6) AS canvas_x0, round(y1 * 150 / 120, 6) AS canvas_y1,
  greatest(0, floor(x0 - 12)) AS crop_x0, greatest(0, floor(y0 - 12)) AS crop_y0, least(520, ceil(x1 + 12)) AS crop_x1, least(150, ceil(y1 + 12)) AS crop_y1,
  least(520, ceil(x1 + 12)) - greatest(0, floor(x0 - 12)) >= 4 AND least(150, ceil(y1 + 12)) - greatest(0, floor(y0 - 12)) >= 4 AS crop_ok,
  x0 + 5 AS page_x0, y1 + 7 AS page_y1 FROM words
""")
def geom_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 G4 G6 G7 G11 G12."""
    b, w = g.box(), synth.words(spark, sf_dir)
    c = g.css_rect_to_canvas(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(CANVAS_W), F.lit(CANVAS_H), F.lit(VIEWPORT_W), F.lit(VIEWPORT_H))
    crop, ok = g.crop(b, F.col("canvas_w"), F.col("canvas_h"))
    moved = g.shift(b, F.lit(5.0), F.lit(7.0))
    return w.select(
        "capture_id", "word_ix", g.width(b).alias("width"), g.height(b).alias("height"), g.center_y(b).alias("center_y"),
        _r(g.device_to_css_y(b.y0, F.col("canvas_h"), F.lit(VIEWPORT_H))).alias("css_y"), _r(c.x0).alias("canvas_x0"), _r(c.y1).alias("canvas_y1"),
        *(x.cast("double").alias(n) for n, x in (("crop_x0", crop.x0), ("crop_y0", crop.y0), ("crop_x1", crop.x1), ("crop_y1", crop.y1))),
        ok.alias("crop_ok"), moved.x0.alias("page_x0"), moved.y1.alias("page_y1"),
    )


_PAIR_SQL = """
  greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS ix, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS iy,
  least(a.x1 - a.x0, b.x1 - b.x0) AS mw, least(a.y1 - a.y0, b.y1 - b.y0) AS mh,
  greatest(0, CASE WHEN a.x0 <= b.x0 THEN b.x0 - a.x1 ELSE a.x0 - b.x1 END) AS h_gap,
  greatest(0, CASE WHEN a.y0 <= b.y0 THEN b.y0 - a.y1 ELSE a.y0 - b.y1 END) AS v_gap
"""


@query(f"""
WITH {WORDS_SQL},
n AS (SELECT capture_id, word_ix, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS a, lead({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}, 8) OVER (PARTITION BY capture_id ORDER BY word_ix) AS b FROM words),
pr AS (SELECT capture_id, word_ix, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas, {_PAIR_SQL} FROM n WHERE b IS NOT NULL)
SELECT capture_id, word_ix, round(ix / mw, 6) AS x_ratio, round(iy / mh, 6) AS v_ratio, h_gap, v_gap,
  round(ix * iy / (areas - ix * iy + 1e-9), 6) AS iou, ix > 0 AND iy > 0 AS overlap FROM pr
""")
def geom_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 G3 G5 G8, each word with the one below: eight further in its capture."""
    sides, order = ("x0", "y0", "x1", "y1"), W.partitionBy("capture_id").orderBy("word_ix")
    w = synth.words(spark, sf_dir).select("capture_id", "word_ix", *sides, *(F.lead(c, 8).over(order).alias(f"b_{c}") for c in sides))
    a, b = g.box(), g.box("b_")
    return w.where(F.col("b_x0").isNotNull()).select(
        "capture_id", "word_ix", _r(g.x_overlap_ratio(a, b)).alias("x_ratio"), _r(g.v_overlap_ratio(a, b)).alias("v_ratio"),
        g.h_gap(a, b).alias("h_gap"), g.v_gap(a, b).alias("v_gap"), _r(g.iou(a, b)).alias("iou"), g.boxes_overlap(a, b).alias("overlap"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 140.0 ELSE least(280.0, greatest(60.0, value)) END AS speed,
  least(160.0, greatest(60.0, round(value * 4 * 0.12, 6))) AS margin, round(value * 4 * 0.75, 6) AS advance,
  CASE WHEN event_id % 3 = 0 THEN CASE WHEN floor(value - least(160.0, greatest(60.0, value * 4 * 0.12)) + 0.5) > 0
      THEN CAST(floor(value - least(160.0, greatest(60.0, value * 4 * 0.12)) + 0.5) AS BIGINT) END
    WHEN value * 2 > value * 4 * 0.35 THEN CAST(floor(value * 2 - least(160.0, greatest(60.0, value * 4 * 0.12)) + 0.5) AS BIGINT) END AS delta
FROM (SELECT event_id, CAST(value AS DOUBLE) AS value FROM events)
""")
def scroll_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13 G14 G15 ST11."""
    x, h = F.col("value").cast("double"), F.col("value").cast("double") * 4
    raw = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(x)
    cutoff = F.when(F.col("event_id") % 3 == 0, x)
    return table(spark, sf_dir, "events").select(
        "event_id", g.scroll_speed(raw).alias("speed"), _r(g.reposition_margin(h)).alias("margin"), _r(g.min_advance(h)).alias("advance"),
        g.reposition_delta(cutoff, x * 2, h).cast("bigint").alias("delta"),
    )


@query("""
SELECT part, w, h, round(scale, 9) AS scale, CAST(floor((1024 - floor(w * scale + 0.5)) / 2) AS BIGINT) AS pad_left, CAST(floor((1024 - floor(h * scale + 0.5)) / 2) AS BIGINT) AS pad_top,
  CAST(least(255, greatest(0, round_even(w % 256 * 0.299 + h % 256 * 0.587 + part % 256 * 0.114, 0))) AS INT) AS gray
FROM (SELECT part, w, h, least(1024.0::DOUBLE / w, 1024.0::DOUBLE / h) AS scale
      FROM (SELECT p_partkey AS part, CAST(300 + p_partkey * 37 % 1500 AS DOUBLE) AS w, CAST(200 + p_partkey * 53 % 2500 AS DOUBLE) AS h FROM part))
""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 G10."""
    k = F.col("p_partkey")
    sized = table(spark, sf_dir, "part").select(k.alias("part"), (300 + k * 37 % 1500).cast("double").alias("w"), (200 + k * 53 % 2500).cast("double").alias("h"))
    scale, left, top = g.letterbox(F.col("w"), F.col("h"))
    return sized.select("part", "w", "h", _r(scale, 9).alias("scale"), left.cast("bigint").alias("pad_left"), top.cast("bigint").alias("pad_top"), g.gray(F.col("w") % 256, F.col("h") % 256, F.col("part") % 256).alias("gray"))


# ---------------------------------------------------------------- predicates


_LETTERS = "regexp_replace(tr, '[^a-zA-Z]', '', 'g')"
_TRIM = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
CHROME_SQL = " OR ".join("regexp_matches(shown, '" + x.replace("'", "''") + "')" for x in p.CHROME_PATTERNS)
_PREDICATES_SQL = rf"""
{LINES_SQL},
b1 AS (SELECT *, {_TRIM} AS tr, trim(regexp_replace(upper(text), '\s+', ' ', 'g')) AS shown FROM lines),
b2 AS (SELECT *, {_LETTERS} AS lt, regexp_split_to_array(tr, '\s+') AS w, lower(regexp_replace(tr, '\s+', '', 'g')) AS packed FROM b1),
b3 AS (SELECT *, length(lt) AS n, lower(lt) AS low, list_transform(w, lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g'))) AS wl,
  regexp_replace(lower(w[1]), '[^a-z]', '', 'g') AS fw,
  list_max(list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: length(lt) - length(replace(lower(lt), c, '')))) AS top FROM b2),
judged AS (SELECT *,
  CASE WHEN low IN ('i', 'a') THEN false WHEN length(tr) < 2 THEN true WHEN regexp_matches(packed, '{p.INTERJECTION}') THEN false
    WHEN n / length(tr) < 0.55 AND NOT (len(w) >= 2 AND n >= 5) THEN true WHEN n > 3 AND NOT regexp_matches(lt, '[aeiouAEIOU]') THEN true
    WHEN regexp_matches(tr, '(?i)' || '{p.CODE_LIKE}') THEN true
    WHEN len(list_filter(wl, lambda k: k > 18)) > 0 THEN true WHEN len(w) >= 2 AND len(list_filter(wl, lambda k: k > 1)) = 0 THEN true
    WHEN n > 4 AND top / n > 0.7 THEN true ELSE false END AS garbage,
  {CHROME_SQL} AS chrome, regexp_matches(tr, '(?i){p.URL_ONLY}') AS url_only,
  CASE WHEN len(w) = 1 AND fw IN ('i', 'a') THEN false WHEN len(w) <= 2 AND confidence < 80 THEN true
    WHEN len(w) <= 4 AND (fw IN ({", ".join(f"'{x}'" for x in p.SFX_TOKENS)}) OR {" OR ".join(f"starts_with(fw, '{x}')" for x in p.SFX_PREFIXES)}) THEN true ELSE false END AS sound
  FROM b3)
"""


@query(rf"""
WITH {_PREDICATES_SQL}
SELECT doc_id, ix, garbage, chrome, url_only, sound, confidence >= 45 AND NOT garbage AND NOT chrome AND NOT url_only AND NOT sound AS kept,
  confidence >= 45 AND garbage AND len(w) >= 2 AS suspicious, NOT regexp_matches(text, '{p.CHAPTER_LABEL}') AND NOT chrome AS real_content,
  regexp_matches(text, '[A-Za-z0-9]') AS speakable, tr <> '' AND regexp_matches(text, '[A-Za-z]') AS is_word FROM judged
""")
def noise_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F7 F13 F14 A11 X13 on all lines."""
    x = F.col("text")
    return p.with_noise(synth.noisy_lines(spark, sf_dir)).select(
        "doc_id", "ix", *p.NOISE, "kept", "suspicious", p.is_real_content(x, F.col("chrome")).alias("real_content"),
        p.is_speakable(x).alias("speakable"), p.is_word(x).alias("is_word"),
    )


@query(rf"""
WITH {_PREDICATES_SQL}, k AS (SELECT *, confidence >= 45 AND NOT garbage AND NOT chrome AND NOT url_only AND NOT sound AS kept FROM judged)
SELECT doc_id, count(*) FILTER (kept) AS n_kept, count(*) FILTER (confidence >= 45 AND garbage AND len(w) >= 2) AS n_suspicious,
  round(coalesce(avg(confidence) FILTER (kept), 0), 6) AS avg_confidence,
  count(*) FILTER (NOT regexp_matches(text, '{p.CHAPTER_LABEL}') AND NOT chrome) AS n_real, count(*) FILTER (NOT regexp_matches(text, '{p.CHAPTER_LABEL}') AND NOT chrome) <= 1 AS needs_rescue
FROM k GROUP BY doc_id
""")
def capture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and dropped counts, mean confidence, rescue gate."""
    real = F.count_if(p.is_real_content(F.col("text"), F.col("chrome")))
    return p.with_noise(synth.noisy_lines(spark, sf_dir)).groupBy("doc_id").agg(
        F.count_if("kept").alias("n_kept"), F.count_if("suspicious").alias("n_suspicious"),
        _r(F.coalesce(F.avg(F.when(F.col("kept"), F.col("confidence"))), F.lit(0.0))).alias("avg_confidence"), real.alias("n_real"), (real <= 1).alias("needs_rescue"),
    )


# ---------------------------------------------------------------- text


@query(rf"""
WITH {LINES_SQL}, s AS (SELECT doc_id, ix, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM lines)
SELECT doc_id, ix, c AS collapsed, translate(c, '/\', 'ii') AS slashes, regexp_replace(c, ',([A-Za-z])', ', \1', 'g') AS comma,
  regexp_replace(c, '([A-Za-z]{{3,}})-\s*([A-Za-z]{{3,}})', '\1 \2', 'g') AS hyphen, lower(split_part(c, '''', 1)) AS core,
  trim(regexp_replace(regexp_replace(c, '[\x{{3000}}-\x{{303F}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', ' ', 'g'), '\s+', ' ', 'g')) AS no_cjk,
  length(regexp_replace(c, '[^a-zA-Z]', '', 'g')) AS n_letters, len(regexp_split_to_array(c, '\s+')) AS n_words FROM s
""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 X2 X4 X6 X8 X9 X13."""
    c = F.col("collapsed")
    return synth.noisy_lines(spark, sf_dir).withColumn("collapsed", t.collapsed_trimmed(F.col("text"))).select(
        "doc_id", "ix", c, t.replace_slashes(c).alias("slashes"), t.space_after_comma(c).alias("comma"), t.join_hyphenated(c).alias("hyphen"),
        t.core_word(c).alias("core"), t.strip_cjk(c).alias("no_cjk"), F.length(p.letters(c)).alias("n_letters"), F.size(p.words(c)).alias("n_words"),
    )


@query(rf"""
WITH {LINES_SQL}, s AS (SELECT doc_id, ix, text, regexp_extract_all(text, '[A-Za-z'']+') AS f, regexp_split_to_array(text, '[A-Za-z'']+') AS b FROM lines)
SELECT doc_id, ix, array_to_string(list_transform(list_zip(b, f), lambda z: z[1] || coalesce(CASE WHEN length(z[2]) > 1 AND z[2] = upper(z[2]) THEN lower(z[2]) ELSE z[2] END, '')), '') AS spoken FROM s
""")
def text_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12."""
    return synth.noisy_lines(spark, sf_dir).select("doc_id", "ix", t.normalize_case(F.col("text")).alias("spoken"))


_LAUGH = "regexp_full_match(lower(w), '(ha|he|ho|ah){2,}')"
_SYLLABLES = "array_to_string(list_transform(range(0, least(5, length(x) // 2)), lambda k: substr(x, CAST(2 * k + 1 AS INT), 2)), '-')"


@query(rf"""
WITH m AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS m FROM conversations),
w AS (SELECT conv_id, turn, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM m),
k AS (SELECT *, CASE WHEN {_LAUGH} THEN 0 ELSE (i + turn) % 4 END AS k, repeat(CASE i % 4 WHEN 0 THEN 'ha' WHEN 1 THEN 'he' WHEN 2 THEN 'ho' ELSE 'ah' END, CAST(2 + i % 6 AS INT)) AS laugh FROM w),
x AS (SELECT conv_id, turn, i, w, k, CASE k WHEN 3 THEN upper(laugh) WHEN 2 THEN laugh ELSE w END AS x FROM k),
y AS (SELECT conv_id, turn, i, CASE WHEN k >= 2 OR {_LAUGH} THEN {_SYLLABLES}
  WHEN k = 1 AND length(w) >= 2 THEN array_to_string(list_transform(range(0, 1 + i % 3), lambda q: substr(w, 1, CAST(q + 2 AS INT))), '-') || '-' || w
  WHEN k = 1 THEN repeat(w || '-', CAST(1 + i % 3 AS INT)) || w ELSE w END AS s FROM x)
SELECT conv_id, turn, string_agg(s, ' ' ORDER BY i) AS spoken FROM y GROUP BY 1, 2
""")
def speech_normalising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10 X11 over every turn's words, of which half become laughter and a quarter stutter."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))

    def said(w, at):
        i = at + 1
        k = F.when(F.lower(w).rlike("^(ha|he|ho|ah){2,}$"), 0).otherwise((i + F.col("turn")) % 4)
        laugh = F.repeat(F.element_at(F.array(*(F.lit(x) for x in ("ha", "he", "ho", "ah"))), (i % 4 + 1).cast("int")), (2 + i % 6).cast("int"))
        stutter = F.concat(F.repeat(F.concat(F.substring(w, 1, 1), F.lit("-")), (1 + i % 3).cast("int")), w)
        return F.when(k == 1, stutter).when(k == 2, laugh).when(k == 3, F.upper(laugh)).otherwise(w)

    made = table(spark, sf_dir, "conversations").where(F.size(words) > 0).select("conv_id", "turn", F.array_join(F.transform(words, said), " ").alias("s"))
    return made.select("conv_id", "turn", t.normalize_stutter(t.normalize_laughter(F.col("s"))).alias("spoken"))


@query(r"""
WITH f AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^.!?]+[.!?]*') AS m FROM conversations),
pc AS (SELECT conv_id, turn, list_filter(list_transform(CASE WHEN len(m) > 0 THEN m ELSE [text] END, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS ps FROM f),
folded AS (SELECT conv_id, turn, list_reduce(list_prepend([''], list_transform(ps, lambda x: [x])),
  lambda acc, x: CASE WHEN length(CASE WHEN acc[1] = '' THEN x[1] ELSE acc[1] || ' ' || x[1] END) >= 4
    THEN list_concat([''], acc[2:], [CASE WHEN acc[1] = '' THEN x[1] ELSE acc[1] || ' ' || x[1] END])
    ELSE list_concat([CASE WHEN acc[1] = '' THEN x[1] ELSE acc[1] || ' ' || x[1] END], acc[2:]) END) AS a FROM pc),
closed AS (SELECT conv_id, turn, CASE WHEN a[1] = '' THEN a[2:] WHEN len(a) > 1 THEN list_concat(a[2:len(a) - 1], [a[len(a)] || ' ' || a[1]]) ELSE [a[1]] END AS c FROM folded)
SELECT conv_id, turn, CAST(generate_subscripts(c, 1) - 1 AS INT) AS seq, unnest(c) AS chunk FROM closed
""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(t.sentences(F.col("text"))).alias("seq", "chunk"))


_TRIM = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
_PUSHED = f"CASE WHEN {_TRIM('acc[1]')} <> '' THEN list_concat(acc[2:], [{_TRIM('acc[1]')}]) ELSE acc[2:] END"


@query(rf"""
WITH d AS (SELECT doc_id, {_TRIM("text")} AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[^.!?…\n]+[.!?…]*\s*') AS m FROM d),
u AS (SELECT doc_id, t, flatten(list_transform(CASE WHEN len(m) > 0 THEN m ELSE [t] END, lambda p:
  CASE WHEN length(p) > 400 THEN list_concat([['f', '']], list_transform(regexp_split_to_array(p, '\s+'), lambda w: ['w', w])) ELSE [['p', p]] END)) AS u FROM m),
r AS (SELECT doc_id, t, list_reduce(list_prepend([''], u), lambda acc, x: CASE
  WHEN x[1] = 'f' THEN list_concat([''], {_PUSHED})
  WHEN x[1] = 'p' THEN CASE WHEN length(acc[1] || x[2]) > 400 THEN list_concat([x[2]], {_PUSHED}) ELSE list_concat([acc[1] || x[2]], acc[2:]) END
  WHEN length({_TRIM("CASE WHEN acc[1] = '' THEN x[2] ELSE acc[1] || ' ' || x[2] END")}) > 400 THEN list_concat([x[2]], {_PUSHED})
  ELSE list_concat([CASE WHEN acc[1] = '' THEN x[2] ELSE acc[1] || ' ' || x[2] END], acc[2:]) END) AS acc FROM u),
c AS (SELECT doc_id, CASE WHEN t = '' THEN []::VARCHAR[] WHEN length(t) <= 400 THEN [t] ELSE {_PUSHED} END AS c FROM r)
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS seq, unnest(c) AS chunk FROM c
""")
def tts_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15 on whole documents."""
    docs = synth.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(t.tts_chunks(F.col("text"))).alias("seq", "chunk"))


# ---------------------------------------------------------------- lexicon


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two to nine letters in the documents, as a stand-in lexicon."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.where(F.length("word").between(2, 9)).distinct()


_LEXICON_SQL = "lexicon AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) BETWEEN 2 AND 9)"


@query(rf"""
WITH {_LEXICON_SQL}, {LINES_SQL},
s AS (SELECT doc_id, ix, translate(text, '/\', 'ii') AS text FROM lines),
parts AS (SELECT doc_id, ix, regexp_extract_all(text, '[A-Za-z0-9]+') AS f, regexp_split_to_array(text, '[A-Za-z0-9]+') AS b FROM s),
tk AS (SELECT doc_id, ix, unnest(b) AS gap, generate_subscripts(b, 1) AS k, f FROM parts),
t2 AS (SELECT doc_id, ix, k, gap, f[k] AS token FROM tk),
t3 AS (SELECT *, CASE WHEN regexp_matches(token, '[0158]') AND regexp_matches(token, '[A-Za-z]') THEN translate(lower(token), '0158', 'oisb') END AS s1,
  CASE WHEN regexp_matches(token, '[A-Za-z]') AND contains(token, '1') THEN translate(lower(token), '0158', 'olsb') END AS s2 FROM t2),
t4 AS (SELECT doc_id, ix, k, gap, CASE WHEN l1.word IS NOT NULL THEN CASE WHEN token = upper(token) THEN upper(s1) ELSE s1 END
  WHEN l2.word IS NOT NULL THEN CASE WHEN token = upper(token) THEN upper(s2) ELSE s2 END ELSE token END AS new
  FROM t3 LEFT JOIN lexicon l1 ON s1 = l1.word LEFT JOIN lexicon l2 ON s2 = l2.word)
SELECT doc_id, ix, string_agg(gap || coalesce(new, ''), '' ORDER BY k) AS fixed FROM t4 GROUP BY doc_id, ix
""")
def fix_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 J10."""
    return lexicon_repair.fix_digits(synth.noisy_lines(spark, sf_dir), ["doc_id", "ix"], _lexicon(spark, sf_dir))


_SAFE = ", ".join(f"'{w}'" for w in lexicon_repair.SAFE_SHORT)
_FUSED = "MAP {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), x.replace("'", "''")) for k, x in lexicon_repair.FUSED_WORDS.items()) + "}"
_PREFIX = "CASE " + " ".join(f"WHEN starts_with(core, '{x}') AND length(core) > {len(x)} THEN {len(x)}" for x in lexicon_repair.SHORT_PREFIXES) + " END"


@query(rf"""
WITH {_LEXICON_SQL}, {LINES_SQL},
src AS (SELECT doc_id, ix, replace(replace(text, ' so ', ' so'), ' is ', ' is') || ' itwas OfThe WHYARE' AS text FROM lines),
parts AS (SELECT doc_id, ix, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?') AS f, regexp_split_to_array(text, '[A-Za-z]+(?:''[A-Za-z]+)?') AS b FROM src),
t1 AS (SELECT doc_id, ix, unnest(b) AS gap, generate_subscripts(b, 1) AS k, f FROM parts),
t2 AS (SELECT doc_id, ix, k, gap, f[k] AS token, lower(split_part(f[k], '''', 1)) AS core FROM t1),
t3 AS (SELECT *, {_FUSED}[lower(token)] AS exact, {_PREFIX} AS pl, CASE WHEN starts_with(lower(token), 'it''s') AND length(token) > 4 THEN substr(lower(token), 5) END AS its FROM t2),
t4 AS (SELECT *, substr(core, pl + 1) AS rest FROM t3),
t5 AS (SELECT t4.*, c.word IS NOT NULL AS in_core, CASE WHEN length(rest) <= 3 THEN rest IN ({_SAFE}) ELSE r.word IS NOT NULL END AS ok_rest,
  CASE WHEN length(its) <= 3 THEN its IN ({_SAFE}) ELSE i.word IS NOT NULL END AS ok_its
  FROM t4 LEFT JOIN lexicon c ON core = c.word LEFT JOIN lexicon r ON rest = r.word LEFT JOIN lexicon i ON its = i.word),
t6 AS (SELECT doc_id, ix, k, gap, CASE WHEN exact IS NOT NULL THEN CASE WHEN token = upper(token) THEN upper(exact) ELSE exact END
  WHEN its IS NOT NULL AND ok_its THEN substr(token, 1, 4) || ' ' || substr(token, 5) WHEN in_core THEN token
  WHEN pl IS NOT NULL AND ok_rest THEN substr(token, 1, pl) || ' ' || substr(token, pl + 1) ELSE token END AS new FROM t5)
SELECT doc_id, ix, string_agg(gap || coalesce(new, ''), '' ORDER BY k) AS fixed FROM t6 GROUP BY doc_id, ix
""")
def split_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 X8 J10 J12 W8."""
    joined = F.concat(F.replace(F.replace("text", F.lit(" so "), F.lit(" so")), F.lit(" is "), F.lit(" is")), F.lit(" itwas OfThe WHYARE"))
    return lexicon_repair.split_fused(synth.noisy_lines(spark, sf_dir).withColumn("text", joined), ["doc_id", "ix"], _lexicon(spark, sf_dir))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respellings, as a stand-in: of nations, and of one frequent word."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lower("n_name").alias("word"), F.concat(F.lower("r_name"), F.lit("y")).alias("respelling"))
    return names.unionByName(spark.range(1).select(F.lit("the").alias("word"), F.lit("thee").alias("respelling")))


@query(rf"""
WITH {LINES_SQL}, names AS (SELECT lower(n_name) AS word, lower(r_name) || 'y' AS respelling FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'the', 'thee'),
parts AS (SELECT doc_id, ix, regexp_extract_all(text, '[A-Za-z]+') AS f, regexp_split_to_array(text, '[A-Za-z]+') AS b FROM lines),
t1 AS (SELECT doc_id, ix, unnest(b) AS gap, generate_subscripts(b, 1) AS k, f FROM parts),
t2 AS (SELECT doc_id, ix, k, gap, f[k] AS token FROM t1)
SELECT doc_id, ix, string_agg(gap || coalesce(CASE WHEN respelling IS NULL THEN token WHEN token = upper(token) THEN upper(respelling) ELSE respelling END, ''), '' ORDER BY k) AS fixed
FROM t2 LEFT JOIN names ON lower(token) = word GROUP BY doc_id, ix
""")
def respell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 J11."""
    return lexicon_repair.respell(synth.noisy_lines(spark, sf_dir), ["doc_id", "ix"], _names(spark, sf_dir))
