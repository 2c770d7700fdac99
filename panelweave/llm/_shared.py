"""What several corpus operators need: the shared folder, written tables, case folding."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary
    folder of its own, which on a cluster would be each machine's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="panelweave-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class _Scopes(threading.local):
    """Open scopes of this thread; another's queries keep their tables."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None, batch_rows: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files,
    so lost executors cost nothing upstream and no branch computes it twice. ``batch_rows``: rows in an Arrow batch
    while it is written, where rows are large."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, batch_rows)
    try:
        writer.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def ascii_lower(c: Column) -> Column:
    """A-Z only. Text without multi-byte characters takes the fast path; for it, lower() is the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


INPUTS = ("doc_id", "text")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text as they are (as far as there), all other columns inside the struct _row (absent if there are
    none): nothing an operator adds can clash with them."""
    inputs, rest = [c for c in INPUTS if c in docs.columns], [c for c in docs.columns if c not in INPUTS]
    return docs.select(*inputs, *([F.struct(*rest).alias("_row")] if rest else []))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns again, some of them replaced."""
    return df.select(*(new.get(c, F.col(c) if c in INPUTS else F.col("_row").getField(c)).alias(c) for c in columns))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end: what is kept must have been written outside or read."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            discard(spark, path)
