"""Jump consistent hashing: stable keys to shards without a table of the ring.

A key's generator state is multiplied and added to in 64 bits with wrap-around; as column
arithmetic may not overflow, the state is two halves of 32 bits and the factor four parts of 16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.store import kept

#: Fixed values of the published algorithm.
FACTOR = 2862933555777941757
#: Rounds that are tried before the round count that surely suffices.
ROUNDS = 24
#: Bits of a monotonically increasing id that count the rows of a partition.
IN_RANGE = 33


def _advanced(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of state * FACTOR + 1, mod 2**64."""
    parts = [F.lit((FACTOR >> (16 * k)) & 0xFFFF) for k in range(4)]
    low, half = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    p0, p1 = lo * parts[0], lo * parts[1]
    small = p0 + F.shiftleft(p1.bitwiseAND(half), 16) + F.lit(1)
    big = F.shiftright(small, 32) + F.shiftright(p1, 16) + lo * parts[2] + hi * parts[0]
    big = big + F.shiftleft((lo * parts[3] + hi * parts[1]).bitwiseAND(half), 16)
    return big.bitwiseAND(low), small.bitwiseAND(low)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key, from 0 to shards - 1. A null key is hashed as 0.

    A round moves on to a later shard, so `shards` rounds always suffice; as few are needed on
    average (the logarithm of `shards`), the rest run only for a key that needs them."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next")
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advanced(s["hi"], s["lo"])
        to = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(s["next"] >= shards, s).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), s["next"].alias("at"), to.cast("long").alias("next")))

    def rounds(state: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, step)

    few = min(shards, ROUNDS)
    state = F.transform(F.array(rounds(start, few)), lambda s: F.when(s["next"] >= shards, s).otherwise(rounds(s, shards)) if few < shards else s)
    return F.get(state, 0)["at"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of (doc_id, text).

    The law is `key`: doc_id and the number of shards decide; grown_shard is the shard with one
    more, and differs from shard only where it is the new one. A null doc_id goes where 0 goes; a
    null text has size 8 and the CRC of no bytes; repeated rows go to one shard and get slots of
    their own; other columns are ignored.

    Slots count from 0 in each shard without a gap, in the order of doc_id (null first), CRC and size.
    The rows are sorted by ranges over all shards and written with their place in the range, so a
    hot shard or source is many tasks; a range starts where the ones before it end, and a shard where
    its first row is. Rows that agree in all of it are told apart by a hash of their place in the
    input, so that repeated rows are no range of their own."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    placed = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        jump_hash(F.col("doc_id"), shards).alias("shard"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    order = ["shard", "doc_id", "text_crc32", "size", "tie"]
    written = kept(kept(placed, "shard-rows").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-slots")
    part = F.shiftright("at", IN_RANGE)
    sizes = written.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a shard
    first = sizes.select("shard", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return written.withColumn("part", part).join(first, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - F.col("low")).cast("long").alias("slot"), "grown_shard"
    )
