"""Sharding over fixed virtual slots with a versioned slot-to-shard map (DataFrame functions only).

Rows hash by key into a fixed number of virtual slots; bytes are summed per slot (partial sums before
the shuffle); slots go to shards largest first, each to the shard that is lightest so far. The map is a
stored table (version, vslot, shard, bytes, rows). The first call writes version 1; a later one reads the latest
version and, where loads have changed or shards were added, writes an edited next one that moves few slots.
Law `bytes`: shard sizes near equal. Equal texts are dealt like any others: the law is on bytes, not on groups.

A key of HOT rows that hold more than a quarter of a slot's mean spreads over all slots by row number; at most
4 * SLOTS keys can. Null text counts as empty (size 16); a null key hashes with the rest of its row; other repeated
rows share a slot; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ._io import Workspace, exists

SLOTS = 4096
ROW_BYTES = 16
#: Rows of a slot that are ranked together; a fuller slot has more parts.
PART = 1_000_000
#: Rows from which a key may spread.
HOT = 1000
#: A map is edited once a shard's bytes exceed the mean by this share.
SLACK = 0.01


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the hash of its key and a row number of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    # A hash of the key only; null keys fall back on their contents.
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(-1), crc)).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), crc.cast("long").alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("row"))


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows with their virtual slots; rows must be written, so that their numbers stay."""
    # Keys beyond a quarter of a slot's mean: 4 * slots at most.
    total = rows.agg(F.sum("size")).first()[0] or 0
    hot = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= HOT) & (F.col("bytes") * 4 * slots > total)).select("key", F.lit(True).alias("hot"))
    spread = rows.join(F.broadcast(hot), "key", "left")
    return spread.withColumn("vslot", F.pmod(F.when(F.col("hot"), F.xxhash64("key", "row")).otherwise(F.col("key")), F.lit(slots)).cast("int")).drop("hot")


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _lightest(load: Column) -> Column:
    return F.array_position(load, F.array_min(load)).cast("int")


def slot_map(totals: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The first map. The fold runs over at most SLOTS slots, whatever the number of rows."""
    order = F.sort_array(F.collect_list(F.struct("bytes", "vslot", "rows")), asc=False)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("shard"))

    def give(acc: Column, slot: Column) -> Column:
        at = _lightest(acc["load"])
        grown = F.transform(acc["load"], lambda x, i: F.when(i + 1 == at, x + slot["bytes"]).otherwise(x))
        return F.struct(grown.alias("load"), F.concat(acc["shard"], F.array(at - 1)).alias("shard"))

    one = totals.groupBy().agg(order.alias("slots")).select("slots", F.aggregate("slots", zero, give)["shard"].alias("shards"))
    return one.select(F.explode(F.arrays_zip("slots", "shards")).alias("x")).select(F.lit(version).alias("version"), F.col("x.slots.vslot").alias("vslot"), F.col("x.shards").alias("shard"), F.col("x.slots.bytes").alias("bytes"), F.col("x.slots.rows").alias("rows"))


def rebalance(old: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version for new totals or more shards: overfull shards give up their smallest slots.

    A shard keeps its largest slots while they fit in the mean load; what is beyond goes, largest
    first, to the lightest shards. Slots that stay are not touched.
    """
    now = totals.join(F.broadcast(old.select("vslot", "version", F.col("shard").alias("was"))), "vslot", "left")
    mean = now.groupBy().agg((F.sum("bytes") / shards).alias("mean"))
    held = F.sum("bytes").over(Window.partitionBy("was").orderBy(F.desc("bytes"), "vslot"))
    now = now.crossJoin(F.broadcast(mean)).withColumn("stays", F.coalesce((F.col("was") < shards) & (held <= F.col("mean")), F.lit(False)))
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    kept = F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("was", "bytes"))))
    start = F.aggregate(kept, zero, lambda load, x: F.transform(load, lambda v, i: F.when(i == x["was"], v + x["bytes"]).otherwise(v)))
    moving = F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "vslot", "rows"))), asc=False)

    def give(acc: Column, slot: Column) -> Column:
        at = _lightest(acc["load"])
        grown = F.transform(acc["load"], lambda x, i: F.when(i + 1 == at, x + slot["bytes"]).otherwise(x))
        return F.struct(grown.alias("load"), F.concat(acc["shard"], F.array(at - 1)).alias("shard"))

    one = now.groupBy().agg(start.alias("load"), moving.alias("slots"), (F.max("version") + 1).alias("version"))
    moved = one.select("version", "slots", F.aggregate("slots", F.struct("load", F.array().cast("array<int>").alias("shard")), give)["shard"].alias("shards"))
    moved = moved.select("version", F.explode(F.arrays_zip("slots", "shards")).alias("x")).select("version", F.col("x.slots.vslot").alias("vslot"), F.col("x.shards").alias("shard"), F.col("x.slots.bytes").alias("bytes"), F.col("x.slots.rows").alias("rows"))
    stay = now.filter("stays").crossJoin(F.broadcast(one.select(F.col("version").alias("next")))).select(F.col("next").alias("version"), "vslot", F.col("was").alias("shard"), "bytes", "rows")
    return stay.unionByName(moved)


class SlotMaps:
    """The versions of a slot map, stored side by side below a folder that all executors share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> DataFrame | None:
        """The map of the highest version, or None."""
        if not exists(self.spark, f"{self.path}/version=1"):
            return None
        every = self.spark.read.parquet(self.path)
        return every.filter(F.col("version") == every.agg(F.max("version")).first()[0])

    def store(self, table: DataFrame) -> DataFrame:
        """Write a map of one new version and read it back."""
        table.select("version", "vslot", "shard", "bytes", "rows").coalesce(1).write.mode("append").partitionBy("version").parquet(self.path)
        return self.latest()


def current_map(maps: SlotMaps, totals: DataFrame, shards: int) -> DataFrame:
    """The stored map that serves these totals: the latest version, an edited next one, or the first."""
    old = maps.latest()
    if old is None:
        first = slot_map(totals, shards)
        stored = maps.store(first)
        return first if stored is None else stored  # no rows, no map
    load = totals.join(F.broadcast(old.select("vslot", "shard")), "vslot", "left").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    got = load.agg(F.max("bytes").alias("most"), F.sum("bytes").alias("all"), F.count("shard").alias("used"), F.count(F.lit(1)).alias("groups"), F.max("shard").alias("last")).first()
    fits = got["groups"] and got["groups"] == got["used"] and got["last"] < shards and got["most"] <= (1 + SLACK) * got["all"] / shards
    # Nothing to place, or all slots are placed and no shard is overfull.
    return old if fits or not got["groups"] else maps.store(rebalance(old, totals, shards))


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Each row's size, checksum, virtual slot, shard and place in the shard, gapless from 0.

    The map is stored at path, by default in a folder of this call, and edited if it is already there. A row's place
    is its rank in its part of the virtual slot plus the rows of the shard's earlier parts, so no task handles a
    whole shard.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    rows = slotted(work.save(sized(docs), "rows"), slots)
    totals = work.save(slot_totals(rows), "totals")
    table = current_map(SlotMaps(spark, path or f"{work.root}/map"), totals, shards)
    # Parts grow with the rows; a slot within PART rows has one.
    most = totals.agg(F.max("rows")).first()[0] or 0
    parts = -(-most // PART) or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")) if parts > 1 else totals.select("vslot", F.lit(0).alias("part"), F.col("rows").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1))
    # The map has at most `slots` rows, so it may be broadcast; so may the places while parts are few.
    places = sizes.join(F.broadcast(table.select("vslot", "shard", "version")), "vslot").select("vslot", "part", "shard", "version", F.coalesce(before, F.lit(0)).alias("before"))
    places = F.broadcast(places) if slots * parts <= 1 << 18 else places
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "row"))
    return rows.withColumn("rank", rank).join(places, ["vslot", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
