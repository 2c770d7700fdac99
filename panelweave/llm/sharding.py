"""Sharding by fixed virtual slots.

Every record hashes to one of ``n_slots`` slots that never change. Bytes are aggregated per slot, and a
versioned slot-to-shard map says where each slot lives. Maps are stored, one folder a version that is never written
again; rebalancing loads the latest, edits it (whole slots move, as few as it takes) and publishes the next, and ``moves``
tells what has to be carried where. Everything is DataFrame expressions; only tables of ``n_slots`` (times SUBS) rows are
ever brought together or broadcast.

Equal texts aren't kept in one shard: a group of them may hold a third of all bytes, which no law of near equal sizes
allows. They are dealt by doc_id like all others, and so evenly.

Nulls: a null text has no bytes (size 1); rows with a null doc_id are dealt by size and checksum. Repeated rows are
separate records: they are numbered among their equals and dealt by that number, too, so they can't gather in one slot,
and get separate places; ties in a slot are placed in any order.
Long texts are only measured. An empty table gives an empty result and an empty map. Columns beyond doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import documents, materialise, new_path

N_SLOTS, SUBS, COPIES = 4096, 4, 1024
RECORD = ("doc_id", "size", "text_crc32")
MAP_SCHEMA = "version int, slot int, shard int, bytes bigint, rows bigint, first_place bigint"


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy, vslot, sub: what placing needs of each record (no text). Equal rows are counted
    first (so a group of any size is a row a task in the shuffle) and told out again with their number among their equals,
    large groups in blocks of COPIES that are dealt out; a row that has no equal keeps its slot whatever else comes. ``sub``
    splits a slot where its records are ranked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = materialise(each.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n")), "shard-groups")
    few = groups.where(F.col("n") <= COPIES).select(*RECORD, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1), F.lit(COPIES).cast("long")))
    blocks = groups.where(F.col("n") > COPIES).select(*RECORD, "n", block.alias("low")).repartition(*RECORD, "low")
    many = blocks.select(*RECORD, F.explode(F.sequence("low", F.least(F.col("n"), F.col("low") + COPIES) - 1)).alias("copy"))
    known = [*RECORD, F.when(F.col("copy") > 0, F.col("copy"))]
    return few.unionByName(many).select(
        *RECORD, "copy",
        F.pmod(F.xxhash64(*known), F.lit(n_slots)).cast("int").alias("vslot"),
        F.pmod(F.xxhash64(*known, F.lit("sub")), F.lit(SUBS)).cast("int").alias("sub"),
    )


def slot_sizes(recs: DataFrame) -> DataFrame:
    """At most n_slots rows: slot, bytes, rows."""
    return recs.groupBy(F.col("vslot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def edit_map(sizes: DataFrame, n_shards: int, old: DataFrame | None = None, slack: float = 0.002) -> DataFrame:
    """The next version of the map. Slots go by falling size: one stays on its old shard while that shard is within
    ``slack`` of the mean, else it goes to the least loaded shard. Without an old map this is longest-processing-time
    placement. One fold over at most n_slots structs."""
    if old is None:
        cur = sizes.withColumn("shard", F.lit(None).cast("int")).withColumn("version", F.lit(0))
    else:
        cur = sizes.join(F.broadcast(old.select("slot", "shard")), "slot", "left").withColumn("version", F.lit(old.agg(F.max("version")).first()[0]))
    item = F.struct((-F.col("bytes")).alias("neg"), F.col("slot"), F.col("shard"), F.col("rows"))
    one = cur.agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.sum("bytes").alias("total"),
        F.max("version").alias("version"),
    )
    limit = F.ceil(F.col("total") / F.lit(n_shards) * F.lit(1 + slack))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), n_shards).alias("loads"),
        F.expr("cast(array() as array<int>)").alias("plan"),
    )

    def place(acc, x):
        b = -x["neg"]
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        fits = x["shard"].isNotNull() & (x["shard"] < n_shards) & (F.get(acc["loads"], x["shard"]) + b <= limit)
        to = F.when(fits, x["shard"]).otherwise(least)
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == to, v + b).otherwise(v)).alias("loads"),
            F.concat(acc["plan"], F.array(to)).alias("plan"),
        )

    placed = one.select(
        "version",
        F.explode(F.arrays_zip(F.col("items").alias("x"), F.aggregate("items", start, place)["plan"].alias("shard"))).alias("z"),
    )
    flat = placed.select(
        (F.col("version") + 1).cast("int").alias("version"),
        F.col("z.x.slot").alias("slot"),
        F.col("z.shard").alias("shard"),
        (-F.col("z.x.neg")).alias("bytes"),
        F.col("z.x.rows").alias("rows"),
    )
    before = W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return flat.withColumn("first_place", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("bigint"))


def publish(slot_map: DataFrame, path: str) -> DataFrame:
    """Store a map as its version; a version that is there stays as it is (an error)."""
    version = slot_map.agg(F.max("version")).first()[0] or 1
    slot_map.drop("version").coalesce(1).write.parquet(f"{path}/version={version}")
    return load(slot_map.sparkSession, path, version)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored map, the latest version by default."""
    every = spark.read.parquet(path).select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in MAP_SCHEMA.split(", ")))
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """slot, from_shard (null: a new slot), to_shard, bytes: what must be carried to get from one map to the next."""
    before = old.select("slot", F.col("shard").alias("from_shard"))
    both = new.join(F.broadcast(before), "slot", "left").where(~F.col("shard").eqNullSafe(F.col("from_shard")))
    return both.select("slot", "from_shard", F.col("shard").alias("to_shard"), "bytes")


def apply_map(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and place (gapless from 0 in each shard): the first place of a slot's part plus the rank inside the part,
    so no window is larger than one part. The parts are n_slots times SUBS rows at most and broadcast."""
    before = W.partitionBy("vslot").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    parts = recs.groupBy("vslot", "sub").count().withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0)))
    m = slot_map.select(F.col("slot").alias("vslot"), "shard", "first_place", "version")
    firsts = parts.join(F.broadcast(m), "vslot").select("vslot", "sub", "shard", "version", (F.col("first_place") + F.col("ahead")).alias("first_place"))
    inside = W.partitionBy("vslot", "sub").orderBy("doc_id", "text_crc32", "size", "copy")
    ranked = recs.withColumn("r", F.row_number().over(inside)).join(F.broadcast(firsts), ["vslot", "sub"])
    return ranked.withColumn("place", F.col("first_place") + F.col("r") - 1).drop("r", "first_place", "sub", "copy")


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed records, the map). With a ``map_path`` that holds maps, the latest is edited and published as the next
    version; else version 1 is made and published (in a folder of its own, if no path is given)."""
    spark = docs.sparkSession
    recs, old = materialise(records(docs, n_slots), "shard-records"), None
    if map_path and _exists(spark, map_path):
        old = load(spark, map_path)
    slot_map = publish(edit_map(slot_sizes(recs), n_shards, old), map_path or new_path(spark, "slot-map"))
    return apply_map(recs, slot_map), slot_map


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: 8 shards of near equal size."""
    placed, _ = shard_documents(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard"),
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version",
    )
