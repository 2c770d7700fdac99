"""SQL names for the scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, body). SQL functions of the session, inlined by Catalyst; no Python runs.
FUNCTIONS = {
    "box_overlap_ratio": ("a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "DOUBLE", "CASE WHEN least(a1 - a0, b1 - b0) > 0 THEN greatest(0D, least(a1, b1) - greatest(a0, b0)) / least(a1 - a0, b1 - b0) ELSE 0D END"),
    "box_gap": ("a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "DOUBLE", "greatest(0D, CASE WHEN a0 <= b0 THEN b0 - a1 ELSE a0 - b1 END)"),
    "repair_slashes": ("t STRING", "STRING", "translate(t, '/\\\\', 'ii')"),
    "space_after_comma": ("t STRING", "STRING", "regexp_replace(t, ',([A-Za-z])', ', $1')"),
    "core_word": ("w STRING", "STRING", "lower(substring_index(w, chr(39), 1))"),
    "js_round": ("x DOUBLE", "BIGINT", "cast(floor(x + 0.5D) AS BIGINT)"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
