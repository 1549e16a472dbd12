"""Sharding by fixed virtual slots and a versioned slot-to-shard map; DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternloom.llm.common import read, save

SLOTS, SHARDS = 4096, 16
#: A group of equal texts above this part of a shard's share is dealt over slots row by row instead of kept in one slot.
WHOLE_GROUP = 0.5
#: Rows of one slot are numbered in so many lots, which any tasks may take.
LOTS = 16


def slot_of(hashed: F.Column, slots: int = SLOTS) -> F.Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> list[tuple[int, int]]:
    """(virtual slot, bytes): at most one for each slot, however many rows there are."""
    return [(r.vslot, r.b) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()]


def assign(sizes: list[tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: the largest slots first, each to the shard with fewest bytes; empty slots by turns."""
    load, out = [0] * shards, [k % shards for k in range(slots)]
    for slot, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = min(range(shards), key=lambda k: (load[k], k))
        out[slot], load[best] = best, load[best] + size
    return out


def rebalance(current: list[int], sizes: list[tuple[int, int]], shards: int) -> list[int]:
    """The next version of a map: as few slots as needed move from shards above the mean to those below (new ones too)."""
    size, out = dict(sizes), list(current)
    load = [0] * max(shards, max(out, default=0) + 1)
    for slot, shard in enumerate(out):
        load[shard] += size.get(slot, 0)
    mean = sum(load) / shards
    over = lambda k: k >= shards or load[k] > mean
    for slot in sorted(range(len(out)), key=lambda s: (-size.get(s, 0), s)):
        here, n = out[slot], size.get(slot, 0)
        to = min(range(shards), key=lambda k: (load[k], k))
        if here >= shards or (over(here) and n and load[to] + n <= mean + max(0, load[here] - mean - n)):
            out[slot] = to
            load[here] -= n
            load[to] += n
    return out


def map_table(spark: SparkSession, version: int, assigned: list[int]) -> DataFrame:
    """(version, vslot, shard): a version of the map as it is stored, one row for each slot."""
    return spark.createDataFrame([(version, s, k) for s, k in enumerate(assigned)], "version int, vslot int, shard int")


def last_version(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The number and the map of the latest version stored in a folder; 0 and an empty map where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0, []
    stored = spark.read.schema("version int, vslot int, shard int").parquet(path)
    version = stored.agg(F.max("version")).first()[0] or 0
    return version, [r.shard for r in stored.where(F.col("version") == version).orderBy("vslot").collect()]  # a row for each slot


def next_map(spark: SparkSession, path: str | None, sizes: list[tuple[int, int]], shards: int, slots: int) -> DataFrame:
    """The map to use for slots of these sizes: the stored one, edited where it no longer fits, as the next version.

    Versions are appended to the folder and never rewritten; without a folder the map is version 1 of one of its own. A map
    that needs no edit stays the version that it is.
    """
    version, held = last_version(spark, path) if path else (0, [])
    if held and len(held) != slots:
        raise ValueError(f"the stored map has {len(held)} slots, not {slots}")
    assigned = rebalance(held, sizes, shards) if held else assign(sizes, shards, slots)
    if assigned == held:
        return spark.read.schema("version int, vslot int, shard int").parquet(path).where(F.col("version") == version)
    made = map_table(spark, version + 1, assigned)
    if not path:
        return save(made, "slot-map")
    made.coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path).where(F.col("version") == version + 1)


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes of the text and 1; a null text has none), crc (of the text), th (hash of the text), row (a number
    for each row, to be written down with it)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id}`").alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"), F.xxhash64(t).alias("th"), F.monotonically_increasing_id().alias("row"))


def place(rows: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """rows with vslot: equal texts share a slot unless they would fill half a shard alone, where each row gets its own; and
    the slots' bytes. Rows that agree in id and text, or lack an id, are rows like any other."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = int(total * WHOLE_GROUP / shards)
    # at most shards / WHOLE_GROUP groups are larger than the limit
    large = [r.th for r in rows.groupBy("th").agg(F.sum("size").alias("b")).where(F.col("b") > limit).select("th").collect()] if total else []
    split = F.col("th").isin(large) if large else F.lit(False)
    named = rows.withColumn("vslot", slot_of(F.when(split, F.xxhash64("th", "row")).otherwise(F.xxhash64("th")), slots))
    return named, slot_sizes(named)


def shard(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """docs(id, text) -> id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Every row, repeated ones and those with nulls too, goes to one shard; sizes of shards are near equal (`bytes`). slot is
    the row's place in its shard, gapless from 0, in no particular order. Equal texts share a shard unless together they
    would fill half of one. Records are hashed into fixed virtual slots, whose bytes alone reach the driver; the map from
    slots to shards is small, versioned and stored. With map_path the last version in that folder is rebalanced, and what
    that changes is appended as the next one: a grown table, or another number of shards, moves as few slots as it needs.
    """
    spark = docs.sparkSession
    rows = save(sized(docs, id, text), "sharding")
    named, sizes = place(rows, shards, slots)
    stored = next_map(spark, map_path, sizes, shards, slots)
    # rows that agree in all that is returned are numbered as one, then dealt out again
    kinds = named.groupBy("vslot", "id", "size", "crc", "th").agg(F.count("*").alias("n")).withColumn("lot", F.pmod(F.xxhash64("id", "th"), F.lit(LOTS)).cast("int"))
    order = Window.partitionBy("vslot", "lot").orderBy("id", "th", "size")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = kinds.withColumn("before", before)
    lots = named.withColumn("lot", F.pmod(F.xxhash64("id", "th"), F.lit(LOTS)).cast("int")).groupBy("vslot", "lot").agg(F.count("*").alias("m"))
    lots = lots.join(F.broadcast(stored), "vslot")  # slots rows
    # at most slots * LOTS rows, numbered within each shard
    within = Window.partitionBy("shard").orderBy("vslot", "lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.withColumn("base", F.coalesce(F.sum("m").over(within), F.lit(0))).select("vslot", "lot", "shard", "version", "base")
    out = kinds.join(F.broadcast(lots), ["vslot", "lot"])  # at most slots * LOTS rows
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard"), (F.col("base") + F.col("before") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
