"""Joins and pair expansion that don't put a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.session import materialize

#: Rows of a key beyond which it is spread, and over how many tasks.
HOT_ROWS = 500_000
SALTS = 64
#: Hot keys that are broadcast at most; more of them are joined as the optimizer sees fit.
MOST_BROADCAST = 1_000_000


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, how: str = "left", hot: DataFrame | None = None, hot_rows: int = HOT_ROWS, salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key); the rows of a hot key are spread over ``salts`` tasks.

    ``hot`` names the hot keys if the caller has counted them; else they are counted here, with partial
    aggregation. They are written and counted, so that their broadcast has a checked size, and only their lookup
    rows are repeated; without any, nothing is. Rows with a null key match nothing and are spread too. ``spread``
    is hashed to choose the salt and must be deterministic per row.
    """
    if hot is None:
        hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows)
    hot = materialize(hot.select(*keys).withColumn("__hot", F.lit(True)), "hot")
    found = hot.count()
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    apart = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    if not found:
        big = rows.withColumn("__salt", F.when(some_null, apart).otherwise(F.lit(0)))
        return big.join(lookup.withColumn("__salt", F.lit(0)), [*keys, "__salt"], how).drop("__salt")
    hot = F.broadcast(hot) if found <= MOST_BROADCAST else hot
    big = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot") | some_null, apart).otherwise(F.lit(0))).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    small = lookup.join(hot, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return big.join(small, [*keys, "__salt"], how).drop("__salt")


def member_chunks(members: DataFrame, key: str, member: str, size: int = 512) -> DataFrame:
    """Members of each key in arrays of about ``size``: (key, chunk, ids). No array grows with its group."""
    counts = members.groupBy(key).agg(F.count("*").alias("__n"))
    counts = materialize(counts.where(F.col("__n") > size), "sizes")  # of larger groups only
    if counts.isEmpty():
        return members.groupBy(key).agg(F.collect_list(member).alias("ids")).select(key, F.lit(0).cast("bigint").alias("chunk"), "ids")
    chunk = F.pmod(F.xxhash64(member), F.ceil(F.col("__n") / F.lit(size)).cast("bigint"))
    tagged = salted_lookup(members, counts, [key], F.col(member), hot=counts.where(F.col("__n") > HOT_ROWS))
    tagged = tagged.withColumn("chunk", F.coalesce(chunk, F.lit(0).cast("bigint")))
    return tagged.groupBy(key, "chunk").agg(F.collect_list(member).alias("ids"))


def expand_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of keys (key_a, key_b) to pairs of members (a, b), through chunks.

    ``left`` and ``right`` are results of :func:`member_chunks` with a column ``key``. A key's chunks meet
    in rows of their own that are spread before the arrays are opened, so that the work per task is
    bounded by the chunk size and not by the group.
    """
    a = left.select(F.col("key").alias("key_a"), F.col("chunk").alias("__ca"), F.col("ids").alias("__a"))
    b = right.select(F.col("key").alias("key_b"), F.col("chunk").alias("__cb"), F.col("ids").alias("__b"))
    grid = pairs.join(a, "key_a").join(b, "key_b").repartition("key_a", "__ca", "key_b", "__cb")
    return grid.withColumn("a", F.explode("__a")).withColumn("b", F.explode("__b")).drop("__a", "__b", "__ca", "__cb")
