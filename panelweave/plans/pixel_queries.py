"""Queries over rasters whose pixels are the bytes of whole texts, of as many sizes as there are texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels
from ..sources.synth import spread, table
from .queries import _r, query

SIZE = 32


@query(f"""
WITH t AS MATERIALIZED (SELECT doc_id AS capture_id, regexp_extract_all(hex(encode(text)), '..') AS p, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
d AS (SELECT capture_id, p, n, CAST(1 + floor(sqrt(n) * (1 + capture_id % 3)) AS BIGINT) AS w FROM t),
e AS MATERIALIZED (SELECT capture_id, list_transform(p, lambda x: CAST('0x' || x AS INT)) AS p, n, w, (n + w - 1) // w AS h FROM d),
s AS (SELECT capture_id, w, h, least({SIZE}::DOUBLE / w, {SIZE}::DOUBLE / h) AS scale FROM e),
z AS (SELECT *, greatest(1, CAST(floor(w * scale + 0.5) AS BIGINT)) AS nw, greatest(1, CAST(floor(h * scale + 0.5) AS BIGINT)) AS nh FROM s),
g AS (SELECT capture_id, scale, ({SIZE} - nw) // 2 AS pad_left, ({SIZE} - nh) // 2 AS pad_top, nw, nh, w, h FROM z),
xy AS (SELECT g.*, i // {SIZE} AS y, i % {SIZE} AS x, i FROM g, range({SIZE * SIZE}) r(i)),
c AS (SELECT *, x >= pad_left AND x < pad_left + nw AND y >= pad_top AND y < pad_top + nh AS inside,
  least(w - 1::DOUBLE, greatest(0::DOUBLE, (x - pad_left + 0.5::DOUBLE) * w / nw - 0.5::DOUBLE)) AS sx, least(h - 1::DOUBLE, greatest(0::DOUBLE, (y - pad_top + 0.5::DOUBLE) * h / nh - 0.5::DOUBLE)) AS sy FROM xy),
q AS (SELECT c.*, CAST(floor(sx) AS BIGINT) AS x0, CAST(floor(sy) AS BIGINT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM c),
v AS (SELECT q.capture_id, scale, pad_left, pad_top, i, CASE WHEN NOT inside THEN 114 ELSE CAST(floor(
   (coalesce(e.p[y0 * q.w + x0 + 1], 0) * (1 - fx) + coalesce(e.p[y0 * q.w + least(x0 + 1, q.w - 1) + 1], 0) * fx) * (1 - fy)
 + (coalesce(e.p[least(y0 + 1, q.h - 1) * q.w + x0 + 1], 0) * (1 - fx) + coalesce(e.p[least(y0 + 1, q.h - 1) * q.w + least(x0 + 1, q.w - 1) + 1], 0) * fx) * fy + 0.5) AS BIGINT) END AS b FROM q JOIN e USING (capture_id))
SELECT capture_id, round(any_value(scale), 9) AS scale, CAST(any_value(pad_left) AS INT) AS pad_left, CAST(any_value(pad_top) AS INT) AS pad_top, CAST(3 * sum(b) AS BIGINT) AS total,
  CAST(sum(b * (i + 1)) * 3 + sum(b) * {3 * SIZE * SIZE} AS BIGINT) AS checksum FROM v GROUP BY capture_id
""")
def letterbox_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10 whole: resampled, padded, channels first, 0 to 1; digests of the tensor in bytes."""
    n = F.octet_length("text")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(n > 0)
    sized = d.select(F.col("doc_id").alias("capture_id"), "text", (1 + F.floor(F.sqrt(n) * (1 + F.col("doc_id") % 3))).cast("int").alias("width"))
    whole = sized.withColumn("height", F.ceil(n / F.col("width")).cast("int"))
    pad = F.expr("rpad(cast(text as binary), width * height, X'00')")
    found = pixels.letterbox_tensors(whole.select("capture_id", "width", "height", pad.alias("pixels")), SIZE, as_array=True)
    b = F.transform("tensor", lambda v, i: F.struct(F.floor(v * F.lit(255.0) + 0.5).alias("b"), i.alias("i")))
    total = lambda f: F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return found.withColumn("b", b).select("capture_id", _r("scale", 9).alias("scale"), "pad_left", "pad_top", total(lambda x: x["b"]).alias("total"), total(lambda x: x["b"] * (x["i"] + 1)).alias("checksum"))
