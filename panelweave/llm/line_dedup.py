"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of (line hash, its keeper), bucketed and sorted by hash. Documents arrive in batches by falling
doc_id; each batch is reduced to one row a hash and merge-anti-joined with every run (co-bucketed, so no exchange), and
only hashes that no run has are added, as a run of level 0: each hash stands in one run, with the largest doc_id that
holds it. Numbers of documents are kept beside the runs, one sorted table a batch. When a level has ``fanout`` runs they
are compacted into one of the next level.

A text is split once: every line that is long enough is a row of (hash, place in the document). Which lines go comes
back as places, so a document's lines are never compared with its dropped keys one by one.

Lines are identified by two 64-bit hashes (128 bits), rows by doc_id and a hash of the text (rows equal in both lose
the same lines). Everything is DataFrame expressions.

Nulls and ties: a null or empty text is one empty line; each row counts as a document, repeated rows too; a null
doc_id is below every other, and all rows with the keeper's doc_id keep their lines. An empty table gives an empty
result. Long texts are one row each, their work linear in their lines. Other columns come back inside _row, untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BLANKS, ascii_lower, discard, documents, materialise, new_path, packed, unpacked

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2


def _text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def line_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t, h1, h2, place, first: each line that is long enough; ``first`` of its key in its document."""
    keys = F.transform(_lines(_text()), lambda line, i: F.struct(_key(line).alias("key"), i.alias("place")))
    long = F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(0x5EED), x["key"]).alias("h2"), x["place"].alias("place")))

    def mark(a: Column) -> Column:  # equal keys are neighbours
        def one(x: Column, i: Column) -> Column:
            before = F.get(a, i - 1)
            again = (before["h1"] == x["h1"]) & (before["h2"] == x["h2"])
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["place"].alias("place"), (~F.coalesce(again, F.lit(False))).alias("first"))

        return F.transform(a, one)

    marked = F.transform(F.array(F.array_sort(hashed)), mark)[0]
    # First the text's hash, once, then the rows.
    return docs.select("doc_id", F.xxhash64(_text()).alias("t"), marked.alias("a")).select("doc_id", "t", F.explode("a").alias("x")).select("doc_id", "t", "x.*")


class LineRuns:
    """Levels of runs (h1, h2, keeper) and of counts (h1, h2, n_docs). Tables lie in the shared folder; the session's
    catalog only knows their bucketing."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.runs, self.counts, self.schema = spark, fanout, {}, {}, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _store(self, table: DataFrame, levels: dict, level: int) -> DataFrame:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        table.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.schema[id(levels)] = table.schema
        levels.setdefault(level, []).append((name, path))
        return self.spark.table(name)

    def _all(self, levels: dict) -> DataFrame:
        """By path, not by table: a union of bucketed scans may be taken as partitioned when it isn't."""
        return self.spark.read.schema(self.schema[id(levels)]).parquet(*[path for _, tables in sorted(levels.items()) for _, path in tables])

    def _drop(self, tables: list[tuple[str, str]]) -> None:
        for name, path in tables:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, path)

    def _compact(self, levels: dict) -> None:
        level = 0
        while len(levels.get(level, [])) >= self.fanout:
            spent = {level: levels[level]}
            self.schema[id(spent)] = self.schema[id(levels)]
            both = self._all(spent)
            if levels is self.counts:
                both = both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
            del levels[level]
            self._store(both, levels, level + 1)
            self._drop(spent[level])
            level += 1

    def absorb(self, pairs: DataFrame) -> None:
        """Take in one batch of pairs. Later batches must hold smaller doc_ids."""
        batch = pairs.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        batch = self._store(batch, self.counts, 0)
        fresh = batch.select("h1", "h2", "keeper")
        for _, tables in sorted(self.runs.items()):
            for name, _ in tables:
                fresh = fresh.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._store(fresh, self.runs, 0)
        self._compact(self.runs)
        self._compact(self.counts)

    def common(self, min_docs: int) -> DataFrame:
        """h1, h2, keeper of the hashes that stand in ``min_docs`` documents or more."""
        many = self._all(self.counts).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        return self._all(self.runs).join(many.select("h1", "h2"), ["h1", "h2"])

    def close(self) -> None:
        for levels in (self.runs, self.counts):
            for tables in levels.values():
                self._drop(tables)
            levels.clear()


def dropped_lines(docs: DataFrame, min_chars=MIN_CHARS, min_docs=MIN_DOCS, batches=BATCHES, fanout=FANOUT) -> DataFrame:
    """doc_id, t, dropped: the places of the lines each document loses."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(F.col("doc_id") <= c, 1).otherwise(0)
    number = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(number).cast("int")
    pairs = materialise(line_pairs(docs, min_chars).withColumn("batch", number), "line-pairs", ["batch"])
    runs = LineRuns(spark, fanout)
    for b in range(len(cuts) + 1):
        runs.absorb(pairs.where(F.col("batch") == b).drop("batch"))
    common = materialise(runs.common(min_docs), "common-lines")
    runs.close()
    lost = pairs.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "t").agg(F.collect_set("place").alias("dropped"))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """doc_id, text, _row (all other columns), n_lines (before), n_dropped, kept_text."""
    lost = dropped_lines(docs.select("doc_id", "text"), **params).select(F.col("doc_id").alias("lost_id"), "t", "dropped")
    marked = packed(docs).withColumn("t", F.xxhash64(_text()))
    joined = marked.join(lost, marked["doc_id"].eqNullSafe(lost["lost_id"]) & (marked["t"] == lost["t"]), "left").drop("lost_id", "t")

    def left(lines: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")), lambda i: F.get(lines, i))

    kept = F.array_join(F.transform(F.array(_lines(_text())), left)[0], "\n")
    return (
        joined.withColumn("n_lines", F.size(_lines(_text())).cast("long"))
        .withColumn("n_dropped", F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long"))
        .withColumn("kept_text", F.when(F.col("dropped").isNull(), _text()).otherwise(kept))
        .drop("dropped")
    )


def without_repeated_lines(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with repeated lines dropped from text (a null text stays null), n_chars kept right if there is one."""
    out = dedup_lines(docs, **params)
    fewer = F.col("n_dropped") > 0
    new = {"text": F.when(fewer, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(fewer, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return unpacked(out, docs.columns, **new)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, r, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, r, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT r, doc_id, key FROM lines WHERE length(key) >= 40)
        GROUP BY key HAVING count(*) >= 5),
marked AS (SELECT l.*, h.key IS NOT NULL AND l.doc_id IS DISTINCT FROM h.keeper AS lost FROM lines l LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
