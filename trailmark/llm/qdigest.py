"""Percentiles of very large numeric columns by q-digests (Shrivastava et al., 2004).

Values are quantized to a bounded ordered universe of ``2 ** LEVELS`` leaves; a digest is a set of
(node, count) of the dyadic tree above it. Nodes too light for their level are merged into their parent.
Digests merge by adding the counts of equal nodes. With compression factor k a quantile's rank is off by
at most ``LEVELS / k`` of the count, always, however the data was split and in whatever order merged.

The universe is logarithmic: 512 leaves to each power of two between 2**-40 and 2**23.9, for either sign,
and zero. A leaf is thus narrower than 0.14 % of its value; smaller and larger values take the end leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LEVELS = 16
_HALF = 1 << (LEVELS - 1)
_PER_OCTAVE = 512
_LOWEST = -40


def leaf(value: Column) -> Column:
    """The leaf of a double, monotone in it."""
    size = F.floor((F.log2(F.abs(value)) - F.lit(_LOWEST)) * F.lit(_PER_OCTAVE))
    size = F.least(F.greatest(size, F.lit(0)), F.lit(_HALF - 2)).cast("int") + 1
    size = F.when(F.abs(value) == F.lit(float("inf")), F.lit(_HALF - 1)).otherwise(size)
    return F.when(value == 0, F.lit(_HALF)).when(value > 0, F.lit(_HALF) + size).otherwise(F.lit(_HALF) - size).cast("int")


def leaf_value(leaf_index: Column) -> Column:
    """The middle of a leaf on the logarithmic scale."""
    return _within(leaf_index, 0.5)


def leaf_edge(leaf_index: Column) -> Column:
    """The edge of a leaf towards zero: values of the leaf are at least as far from it."""
    return _within(leaf_index, 1.0)


def _within(leaf_index: Column, back: float) -> Column:
    size = F.abs(leaf_index - F.lit(_HALF))
    middle = F.pow(F.lit(2.0), (size - F.lit(back)) / F.lit(_PER_OCTAVE) + F.lit(_LOWEST))
    return F.when(size == 0, F.lit(0.0)).when(leaf_index > _HALF, middle).otherwise(-middle)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress many digests at once; a node is numbered as in a heap (root 1, leaves from ``2 ** LEVELS``).

    Bottom up, two siblings and their parent that together hold at most ``n // k`` become the parent.
    """
    if len(group) == 0:
        return group, node, count
    n = np.bincount(group, weights=count).astype(np.int64)
    limit = n // k
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = np.frexp(node.astype(np.float64))[1] - 1
    live_g, live_n, live_c = (x[depth == LEVELS] for x in (group, node, count))
    for level in range(LEVELS, 0, -1):
        # Nodes of this level with those that came up from below, equal ones added.
        key = (live_g.astype(np.int64) << (LEVELS + 1)) | live_n
        key, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, weights=live_c, minlength=len(key)).astype(np.int64)
        g, v = key >> (LEVELS + 1), key & ((1 << (LEVELS + 1)) - 1)
        parent = (g << (LEVELS + 1)) | (v >> 1)
        up = depth == level - 1
        own_key = (group[up].astype(np.int64) << (LEVELS + 1)) | node[up]
        own_key, own_back = np.unique(own_key, return_inverse=True)
        own_count = np.bincount(own_back, weights=count[up], minlength=len(own_key)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1]))) if len(parent) else np.empty(0, np.int64)
        pair = np.add.reduceat(total, first) if len(first) else np.empty(0, np.int64)
        above = np.zeros(len(first), np.int64)
        if len(own_key) and len(first):
            at = np.minimum(np.searchsorted(own_key, parent[first]), len(own_key) - 1)
            same = own_key[at] == parent[first]
            above[same] = own_count[at[same]]
        light = pair + above <= limit[g[first]] if len(first) else np.empty(0, bool)
        spread = np.repeat(light, np.diff(np.append(first, len(parent)))) if len(first) else np.empty(0, bool)
        done.append((g[~spread], v[~spread], total[~spread]))
        lifted = first[light]
        live_g = np.concatenate((g[lifted], own_key >> (LEVELS + 1)))
        live_n = np.concatenate((v[lifted] >> 1, own_key & ((1 << (LEVELS + 1)) - 1)))
        live_c = np.concatenate((pair[light], own_count))
    if len(live_g):
        key, back = np.unique(live_g, return_inverse=True)
        done.append((key, np.ones(len(key), np.int64), np.bincount(back, weights=live_c).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*done))


def _compress_frames(frames: Iterator[pd.DataFrame], keys: list[str], k: int, flush: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Digests of the rows of a partition; merging is by addition, so they may leave in several pieces."""

    def pack(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        by = rows.groupby(keys, dropna=False, sort=False)
        group, labels = by.ngroup().to_numpy(), by.head(1)[keys].reset_index(drop=True)
        g, v, c = compress(group, rows["node"].to_numpy(), rows["count"].to_numpy(), k)
        return labels.iloc[g].reset_index(drop=True).assign(node=v, count=c)

    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= flush:
            held = [pack(held)]
            size = len(held[0])
            if size > flush // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield pack(held)


def build(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Digests of ``value`` per ``keys``: (keys, node, count).

    Leaves are counted with partial aggregation before any shuffle, so that a hot group sends at most one
    row per leaf and task. Null and NaN values are left out; null keys form groups of their own.
    """
    named = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, (leaf(F.col(value)) + F.lit(1 << LEVELS)).cast("bigint").alias("node"))
    return merge(named.withColumn("count", F.lit(1).cast("bigint")), keys, k)


def merge(digests: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Digests added up over all columns besides ``keys``, ``node`` and ``count``, and compressed again.

    A group has at most ``2 ** (LEVELS + 1)`` distinct nodes after the addition, whatever its count.
    """
    added = digests.groupBy(*keys, "node").agg(F.sum("count").alias("count"))
    schema = StructType([*[f for f in added.select(*keys).schema], StructField("node", LongType()), StructField("count", LongType())])
    return added.repartition(*keys).mapInPandas(lambda frames: _compress_frames(frames, keys, k), schema)


def quantiles(digests: DataFrame, keys: list[str], probabilities: list[float], k: int) -> DataFrame:
    """(keys, n, p, value, edge, rank_error) for each group and probability; ``rank_error`` is the bound as a count and
    ``edge`` the least size of the value's leaf.

    A group's nodes are few (about 3 k), so a window over them is bounded.
    """
    depth = F.floor(F.log2(F.col("node") + F.lit(0.5))).cast("int")
    high = ((F.col("node") + 1) * F.pow(F.lit(2.0), F.lit(LEVELS) - depth)).cast("bigint") - 1 - F.lit(1 << LEVELS)
    nodes = digests.withColumn("__high", high).withColumn("__depth", depth)
    order = Window.partitionBy(*keys).orderBy("__high", F.desc("__depth"))
    whole = Window.partitionBy(*keys)
    summed = nodes.withColumn("__upto", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("count").over(whole))
    asked = summed.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    rank = F.greatest(F.ceil(F.col("p") * F.col("n")), F.lit(1))
    hit = asked.where((F.col("__upto") >= rank) & (F.col("__upto") - F.col("count") < rank))
    bound = F.ceil(F.col("n") * F.lit(LEVELS) / F.lit(k)).cast("bigint")
    return hit.select(*keys, "n", "p", leaf_value(F.col("__high")).alias("value"), leaf_edge(F.col("__high")).alias("edge"), bound.alias("rank_error"))
