"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's number starts a sequence of ever larger jumps; its shard among n is the last jump below n. So with one shard more, a
key either keeps its shard or goes to the new one, and no table of shards is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path

# The generator of the published algorithm, over unsigned 64-bit numbers.
MULTIPLIER, MODULUS, SHIFT = 2862933555777941757, 1 << 64, 1 << 33

#: Jumps worked out for every row at once; the few rows that need more take up to one for each shard.
FIRST_JUMPS = 48


def _next(k: Column) -> Column:
    """The generator's next number. The product has 126 bits at most, which 38 decimal digits hold."""
    return ((k * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")


def _jumps(state: Column, n: int, most: int) -> Column:
    """state (k, b, j) after up to most jumps more, as long as j is below n: b is the last jump, j the next, k the number for the one after."""

    def step(s: Column, _: Column) -> Column:
        share = F.lit(float(1 << 31)) / (F.call_function("div", s["k"], F.lit(SHIFT).cast("decimal(20,0)")) + 1)
        return F.when(s["j"] >= n, s).otherwise(F.struct(_next(s["k"]).alias("k"), s["j"].alias("b"), F.floor((s["j"] + 1) * share).alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step)


def jump_shard(number: Column, n: int) -> Column:
    """The shard, 0 to n - 1, of a 64-bit number; a null number is taken as 0."""
    if n < 1:
        raise ValueError("there must be a shard")
    wide = F.coalesce(number.cast("long"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(wide < 0, (wide + F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)
    state = F.struct(_next(unsigned).alias("k"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    state = _jumps(state, n, min(n, FIRST_JUMPS))
    if n > FIRST_JUMPS:
        state = F.when(state["j"] >= n, state).otherwise(_jumps(state, n, n))
    return state["b"].cast("int")


def key_number(df: DataFrame, key: str) -> Column:
    """An integer key as it is, any other by its hash."""
    return F.col(f"`{key}`") if df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64(F.col(f"`{key}`"))


def shard_documents(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: key, size, text_crc32, law, shard, slot and grown_shard.

    law is "key": key and shard count alone decide the shard, and grown_shard is the shard with one shard more, which takes rows
    only into the new one. Integer keys are used as they are, others by their hash; a null key goes where 0 does. size is
    the text's UTF-8 bytes plus 1, text_crc32 the unsigned CRC-32 of those bytes; a null text counts as an empty one. slot is the
    row's place within its shard, gapless from 0, in order of key, text_crc32, size; repeated rows each have one. Equal texts
    under different keys are spread like any other rows. An empty table gives no rows. Other columns don't matter.

    Slots without one task for each shard: narrow rows are range-partitioned in slot order (with a row number as the last part,
    so that a key that repeats can be split too) and written with their partition's number; counts by partition and shard give each
    group's first slot; numbering within a group takes one partition's rows at most.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = df.select(F.col(f"`{key}`").alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    number = key_number(narrow, "key")
    path = shared_path(df.sparkSession, "shards")
    order = ("key", "text_crc32", "size", "row")
    dealt = narrow.repartitionByRange(*order).withColumns({"part": F.spark_partition_id(), "shard": jump_shard(number, shards), "grown_shard": jump_shard(number, shards + 1)})
    dealt.write.parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order)))
    slots = placed.join(firsts, ["part", "shard"])
    return slots.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """df in Parquet, a folder for each shard (shard=0 ...). Tasks write what they have; nothing is moved to one task for a shard."""
    df.drop("shard").withColumn("shard", jump_shard(key_number(df, key), shards)).write.partitionBy("shard").parquet(path)
