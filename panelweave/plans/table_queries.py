"""Queries through the SQL names of the table functions; they must give the rows of the operators they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import register_tables
from ..sources import synth
from ..sources.synth import table
from . import layout_queries  # noqa: F401  registers the SQL
from .queries import SQL, query


@query(SQL["sentence_chunks"])
def sql_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14 as a table function."""
    register_tables(spark)
    return spark.sql("SELECT c.conv_id, c.turn, s.seq, s.chunk FROM {c} c, LATERAL sentence_chunks(c.text) s", c=table(spark, sf_dir, "conversations"))


@query(SQL["word_columns"])
def sql_word_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D0 J1 as a table function over a table argument."""
    register_tables(spark)
    box = F.transform("rows", lambda w: F.struct(w["word_ix"].alias("ix"), *(w[c].alias(c) for c in ("x0", "y0", "x1", "y1"))))
    boxes = synth.captures(spark, sf_dir).select("capture_id", box.alias("rows"))
    return spark.sql(f"SELECT capture_id, ix AS word_ix, label, n FROM stacked_captures(TABLE(SELECT * FROM {{b}}), {synth.CANVAS_H}D)", b=boxes)
