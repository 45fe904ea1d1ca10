"""Exact ranks and prefix sums within groups of any size.

A window over a group puts the whole group into one task. Here rows are range-partitioned by group
and order instead, so that a group of any size spans many partitions; each partition adds the sum of
those before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.session import materialize


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` (integers) over the rows of the group up to and including each row, and, if
    ``total`` names a column, the sum over the whole group.

    ``order`` must be total within a group for a repeatable result. Null keys form one group. Null
    values count as 0. An empty table stays empty. Columns named like ``out`` are replaced.
    """
    rows = df.drop(out, *([total] if total else [])).withColumn("__v", F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")))
    ranged = rows.repartitionByRange(*keys, *order).withColumn("__pid", F.spark_partition_id())
    # The bounds of a range partitioning are sampled: write once, so that every reader sees the same ones.
    placed = materialize(ranged, "prefix")
    part_key = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    totals = placed.groupBy(F.col("__pid").alias("__p"), *part_key).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__p")
    whole = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))])
    offsets = totals.withColumn("__before", F.sum("__s").over(before) - F.col("__s")).withColumn("__total", F.sum("__s").over(whole)).drop("__s")
    inside = Window.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("__in", F.sum("__v").over(inside))
    same = F.col("__pid") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = summed.join(offsets, same).withColumn(out, F.col("__in") + F.col("__before"))
    more = [F.col("__total").alias(total)] if total else []
    return joined.select(*[c for c in df.columns if c not in (out, total)], out, *more)


def null_safe_join(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key), null keys being equal to each other."""
    if not keys:
        one = lookup.first()  # the single row of a whole table
        return rows.withColumns({c: F.lit(one[c] if one else None).cast(lookup.schema[c].dataType) for c in lookup.columns})
    renamed = lookup.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in lookup.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return rows.join(renamed, same).drop(*[f"__r{i}" for i in range(len(keys))])


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], also: dict[str, tuple[str, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """(keys, a column per name of ``wanted``: the percentile of a column, linear between neighbouring ranks).

    Values are ranked over range partitions, so that a group of any size spans many tasks; only the two rows
    beside each percentile are aggregated. ``also`` names aggregates of columns that come out of the same pass. Nulls
    don't count; a group without values has no row.
    """
    also = also or {}
    columns = sorted({c for c, _ in [*wanted.values(), *also.values()]})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("__m"), F.col(c).cast("double").alias("__value")) for c in columns]))
    values = df.select(*keys, each.alias("__e")).select(*keys, "__e.*").where(F.col("__value").isNotNull())
    rows = exact_rank(values, [*keys, "__m"], ["__value"], "__i", "__n")
    place = lambda p: F.lit(p) * (F.col("__n") - 1)
    near = lambda p: (F.col("__i") - 1 == F.floor(place(p))) | (F.col("__i") - 1 == F.ceil(place(p)))
    some = F.lit(False)
    for p in {p for _, p in wanted.values()}:
        some = some | near(p)
    kept = rows if also else rows.where(some)

    def value(column: str, p: float) -> Column:
        own = (F.col("__m") == column) & near(p)
        low, high = F.min(F.when(own, F.col("__value"))), F.max(F.when(own, F.col("__value")))
        part = F.max(F.when(own, place(p) - F.floor(place(p))))
        return low * (1 - part) + high * part

    more = [of(F.when(F.col("__m") == c, F.col("__value"))).alias(name) for name, (c, of) in also.items()]
    return kept.groupBy(*keys).agg(*[value(c, p).alias(name) for name, (c, p) in wanted.items()], *more)


def exact_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank", total: str | None = None) -> DataFrame:
    """Rank from 1 within ``keys`` by ``order``, and the group's rows as ``total``; the order must be total for a
    repeatable result."""
    return prefix_sum(df, keys, order, F.lit(1), out, total)
