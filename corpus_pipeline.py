"""A corpus pipeline: language ID, line deduplication, near-duplicate removal, decontamination, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import _shared, decontamination, jaccard_join, language_id, line_dedup, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; letterless texts and narrow margins go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    judged = language_id.identify(docs, model)
    return _shared.unpacked(judged.where(~F.col("rejected")), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them repeat."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return jaccard_join.one_of_each(docs, written=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with benchmark passages cut out."""
    return decontamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _shared.documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = _shared.new_path(spark, f"pipeline-{name}")
        with _shared.scratch(spark):  # what a stage wrote for itself goes once its result is written
            docs = _shared.materialise(stage(spark, docs, sf_dir), name, path=path)
        if before:
            _shared.discard(spark, before)
        before = path
    return docs
