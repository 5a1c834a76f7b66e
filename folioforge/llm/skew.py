"""Joins and searches that a frequent key doesn't make slow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import checkpointed

#: A key is frequent if it holds more than this part of the rows; so at most as many keys as its inverse are.
FREQUENT = 0.001


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join of many rows (a table or a checkpoint, read three times) with facts, one a key at most.

    The facts of frequent keys, at most 1 / FREQUENT of them, go to the rows; only the rows of the other keys are
    shuffled, so no key makes a task large.  ``how`` is left or inner.
    """
    counts = rows.groupBy(*keys).count()  # combined before its shuffle
    least = max(1.0, rows.count() * FREQUENT)
    facts = facts.withColumn("_known", F.lit(True))
    often = checkpointed(counts.where(F.col("count") > least).select(*keys).join(facts, keys, "left"))
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(facts, keys, how)
    both = rows.join(F.broadcast(often), keys).unionByName(rest)
    return (both if how == "left" else both.where("_known")).drop("_known")


#: Bits of the bitmap that ``sifted`` sends out, at most: 8 MB.
BITS = 1 << 26
_BUCKET = 32_768  # bits of one bitmap of bitmap_construct_agg


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among the keys (a table or a checkpoint, each once): a filter before a join.

    The keys' hashes are marked in a bitmap of bounded size that all executors get.  No row with one of the keys is lost;
    how many others stay depends on how full the bitmap is.
    """
    bits = min(BITS, max(_BUCKET, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = keys.select(place.alias("place")).groupBy(F.expr(f"place div {_BUCKET}").alias("_bucket")).agg(F.bitmap_construct_agg(F.col("place") % _BUCKET).alias("_map"))
    near = rows.withColumn("_place", place).withColumn("_bucket", F.expr(f"_place div {_BUCKET}")).join(F.broadcast(maps), "_bucket")
    byte = F.conv(F.hex(F.expr(f"substring(_map, cast(_place % {_BUCKET} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return near.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0).drop("_place", "_bucket", "_map")
