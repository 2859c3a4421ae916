"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

Law `key`: a row's shard depends on its doc_id and the number of shards alone, so appending a shard moves rows
only into the new one. The key of the hash is the integer id, as in the paper; a null id counts as key 0.
Null text counts as empty (size 1, crc32 0). Rows that are equal in id, size and crc are counted before
the shuffle and given consecutive slots, so a row repeated many times does not land in one task. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the linear congruential generator in the paper.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64
#: Slices of a shard numbered independently; the table of their sizes has shards * SLICES rows at most.
SLICES = 256


def jump_hash(key: Column, shards: int) -> Column:
    """The bucket of a 64-bit key among `shards`. Each step leaps ahead by at least one bucket, so `shards` steps suffice.

    The generator's product needs 128 bits, so it is kept in decimals; the leap itself is in doubles, as published.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    word = F.lit(str(WORD)).cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"), F.pmod(F.coalesce(key, F.lit(0)).cast("decimal(20,0)"), word).cast("decimal(20,0)").alias("state"))

    def leap(s: Column, _: Column) -> Column:
        state = ((s["state"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % word).cast("decimal(20,0)")
        high = F.floor(state / F.lit(1 << 33).cast("decimal(10,0)")).cast("double") + F.lit(1.0)
        ahead = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / high)).cast("long")
        go = s["next"] < F.lit(shards)
        return F.struct(F.when(go, s["next"]).otherwise(s["at"]).alias("at"), F.when(go, ahead).otherwise(s["next"]).alias("next"), F.when(go, state).otherwise(s["state"]).alias("state"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, leap, lambda s: s["at"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    placed = alike.withColumns({"shard": jump_hash(F.col("doc_id"), shards), "slice": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SLICES)).cast("int")})
    sizes = placed.groupBy("shard", "slice").agg(F.sum("times").alias("rows"))
    before = sizes.select("shard", "slice", (F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows")).alias("before"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = placed.withColumn("end", F.sum("times").over(within)).join(F.broadcast(before), ["shard", "slice"])
    slots = F.explode(F.sequence(F.col("before") + F.col("end") - F.col("times"), F.col("before") + F.col("end") - F.lit(1)))
    return first.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots.alias("slot"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"))
