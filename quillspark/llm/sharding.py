"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots, and a versioned map sends each slot to a shard. The number of slots
never changes; adding a shard or evening out bytes edits the map alone, so that few slots, hence few rows, move. The map
and the per-slot totals have one row per virtual slot (a parameter, 4096 here): both are small whatever the data.

Cases: a null text has no bytes; a null id hashes like any value; equal ids share a slot, so repeated rows stay
together; an empty table gives an empty result. Other columns pass through, those of the names added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def grow(shard_of: list[int], shards: int) -> list[int]:
    """The map with one shard more: each old shard hands its last slots above the new fair share to the new one."""
    fair, out, held = -(-len(shard_of) // (shards + 1)), list(shard_of), [0] * shards
    for slot, shard in enumerate(shard_of):
        held[shard] += 1
        if held[shard] > fair:
            out[slot] = shards
    return out


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map for so many shards: one shard grown again and again, so that it depends on the two counts alone."""
    out = [0] * slots
    for n in range(1, shards):
        out = grow(out, n)
    return out


def rebalance(shard_of: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.02) -> list[int]:
    """The map edited until no shard holds over (1 + tolerance) times the mean bytes, or no move of a slot helps."""
    out, load = list(shard_of), [0] * shards
    for slot, shard in enumerate(out):
        load[shard] += slot_bytes.get(slot, 0)
    mean = sum(load) / shards
    for _ in range(len(out)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        room = load[high] - load[low]
        movable = [(slot_bytes.get(s, 0), s) for s, shard in enumerate(out) if shard == high and 0 < slot_bytes.get(s, 0) < room]
        if load[high] <= mean * (1 + tolerance) or not movable:
            break
        size, slot = min(movable, key=lambda x: (abs(x[0] - room / 2), x[1]))
        out[slot] = low
        load[high] -= size
        load[low] += size
    return out


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """One folder per version; older versions stay readable, and a version that exists is never written again."""
    rows = spark.createDataFrame(list(enumerate(shard_of)), "virtual_slot int, map_shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, map_shard int").parquet(f"{path}/version={version}")


def slot_totals(docs: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot; at most one row per slot."""
    return docs.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def place(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs with size, text_crc32, virtual_slot, slot_bytes, shard and slot: the row's place in its shard, gapless from 0.

    maps: virtual_slot, map_shard and whatever else goes with a slot. A row's place is its rank in its virtual slot behind the
    rows of the shard's earlier slots, so that no task handles a whole shard.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.withColumns({"size": F.octet_length(raw).cast("long") + 8, "text_crc32": F.crc32(raw), "virtual_slot": virtual_slot(F.col(id_col), slots)})
    starts = slot_totals(rows).join(maps, "virtual_slot").withColumn(
        "__start", F.sum("slot_rows").over(Window.partitionBy("map_shard").orderBy("virtual_slot")) - F.col("slot_rows")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size"))
    return (
        rows.withColumn("__rank", rank.cast("long"))
        .join(F.broadcast(starts), "virtual_slot")  # one row per virtual slot: bounded by the parameter
        .withColumns({"shard": F.col("map_shard"), "slot": F.col("__start") + F.col("__rank") - 1})
        .drop("map_shard", "__rank", "__start", "slot_rows")
    )


def sharded(docs: DataFrame, map_path: str, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Every document's shard under map version 1, and under version 2, which has one shard more."""
    spark = docs.sparkSession
    first = slot_map(shards, slots)
    save_map(spark, map_path, 1, first)
    save_map(spark, map_path, 2, grow(first, shards))
    maps = load_map(spark, map_path, 1).join(load_map(spark, map_path, 2).withColumnRenamed("map_shard", "grown_shard"), "virtual_slot")
    out = place(docs.select("doc_id", "text"), maps, slots=slots)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes")
