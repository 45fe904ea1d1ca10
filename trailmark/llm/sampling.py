"""A sample of images whose shares per category follow targets, spread over the temporal bins of each video.

The quotas form a two-way table (category x temporal bin) with a column for each bin that any image has. Its
fractional cells are rounded by maximum flow with both margins kept (:mod:`rounding`), then each cell takes
exactly its quota of images by random key, one of each video's bin before a second of any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.hashing import video_key
from trailmark.llm.rounding import controlled_rounding
from trailmark.llm.splits import stratum_key
from trailmark.operators.ranking import exact_rank
from trailmark.operators.skew import HOT_ROWS, salted_lookup
from trailmark.session import materialize

_BLOCK = 4096


@dataclass(frozen=True)
class Sample:
    """``sample`` (image_id, subdomain_group, video, temporal_bin), ``groups`` and ``bins`` reports, and the table of
    ``quotas`` (subdomain_group, temporal_bin, supply, fraction, quota; a null bin is none)."""

    sample: DataFrame
    groups: DataFrame
    bins: DataFrame
    quotas: DataFrame


def video_plans(manifest: DataFrame) -> DataFrame:
    """(video, plan, rows): the largest non-null ``target_bins_for_video`` of a video's rows, null if there is none."""
    rows = manifest.select(video_key(F.col("video_filename")).alias("video"), "target_bins_for_video")
    return rows.where(F.col("video").isNotNull()).groupBy("video").agg(F.max("target_bins_for_video").cast("bigint").alias("plan"), F.count("*").alias("rows"))


def planned_bins(plans: DataFrame) -> DataFrame:
    """(video, temporal_bin): bins 0 to plan - 1. Built in blocks, so that a wrong, huge plan makes no huge array."""
    some = plans.where(F.col("plan") > 0)
    blocks = some.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("plan") - 1) / _BLOCK).cast("bigint"))))
    first = F.col("__b") * _BLOCK
    return blocks.select("video", F.explode(F.sequence(first, F.least(first + _BLOCK, F.col("plan")) - 1)).alias("temporal_bin"))


def group_totals(size: int, shares: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whole totals per group that sum to ``size``: the share of it, or the minimum where that is more.

    What the minima take beyond their share is taken from the others in proportion.
    """
    shares = shares / shares.sum()
    fixed = np.zeros(len(shares), bool)
    want = shares * size
    while True:
        low = ~fixed & (want < least)
        if not low.any():
            break
        fixed |= low
        rest = max(size - least[fixed].sum(), 0)
        free = shares[~fixed].sum()
        want = np.where(fixed, least, shares * (rest / free if free else 0))
    return controlled_rounding(want[:, None])[:, 0]


def spread_evenly(total: float, room: np.ndarray) -> np.ndarray:
    """``total`` over cells as evenly as their room allows (water-filling)."""
    given = np.zeros(len(room))
    left = min(float(total), float(room.sum()))
    open_ = np.flatnonzero(room > 0)
    for turn, i in enumerate(open_[np.argsort(room[open_], kind="stable")]):
        given[i] = min(room[i], left / (len(open_) - turn))
        left -= given[i]
    return given


def fractional_quotas(supply: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Quotas per (group, bin) with the groups' totals as row sums; the last column holds images without a planned
    bin and is used last."""
    table = np.zeros(supply.shape)
    for g, total in enumerate(np.minimum(totals, supply.sum(axis=1))):
        table[g, :-1] = spread_evenly(total, supply[g, :-1])
        table[g, -1] = total - table[g, :-1].sum()
    table[np.abs(table) < 1e-9] = 0
    return table


def stratified_sample(manifest: DataFrame, targets: DataFrame, fraction: float = 0.2, size: int | None = None, seed: int = 7) -> Sample:
    """Draw ``size`` images (or ``fraction`` of the distinct images) by ``targets`` (subdomain_group, target_share, min_images).

    Category names are read trimmed, in lower case, with underscores; images of no target category aren't
    drawn. A bin that is null or outside its video's plan counts as none. An image delivered twice counts
    once. A null image id is no image. Where supply is short the group takes what there is and the report
    says how much is missing; other groups keep their totals. Empty inputs give an empty sample and the
    report of the targets. Repeated target rows of a group add up.
    """
    spark = manifest.sparkSession
    plans = materialize(video_plans(manifest), "plans")
    named = targets.where(F.col("target_share") > 0).groupBy(stratum_key(F.col("subdomain_group")).alias("g")).agg(
        F.sum("target_share").alias("share"), F.sum(F.coalesce("min_images", F.lit(0))).alias("least")
    )
    wanted = named.where(F.col("g").isNotNull()).orderBy("g").collect()  # a row per category: the bounded target list
    columns = [stratum_key(F.col("subdomain_group")).alias("g"), video_key(F.col("video_filename")).alias("video"), F.col("temporal_bin").cast("bigint").alias("bin")]
    rows = manifest.where(F.col("image_id").isNotNull()).select("image_id", *columns)
    rows = rows.groupBy("image_id").agg(F.min(F.struct("g", "video", "bin")).alias("r")).select("image_id", "r.*")
    rows = salted_lookup(rows, plans.drop("rows"), ["video"], F.col("image_id"), hot=plans.where(F.col("rows") > HOT_ROWS))
    inside = (F.col("bin") >= 0) & (F.col("bin") < F.col("plan"))
    rows = rows.select("image_id", "g", "video", F.when(inside, F.col("bin")).alias("bin"), F.xxhash64("image_id", F.lit(seed)).alias("key"))
    rows = materialize(rows, "images")

    eligible = rows.where(F.col("g").isin([r.g for r in wanted])) if wanted else rows.limit(0)
    have = eligible.groupBy("g", "bin").count().collect()  # a row per target category and bin that images have
    bins_used = sorted({r.bin for r in have if r.bin is not None})
    column = {b: i for i, b in enumerate(bins_used)} | {None: len(bins_used)}
    supply = np.zeros((len(wanted), len(column)), int)
    place = {r.g: i for i, r in enumerate(wanted)}
    for r in have:
        supply[place[r.g], column[r.bin]] = r["count"]
    images = int(rows.count())
    size = int(images * fraction) if size is None else size
    shares, least = np.array([r.share for r in wanted], float), np.array([r.least for r in wanted], float)
    asked = group_totals(size, shares, least) if wanted else np.zeros(0, int)
    fractions = fractional_quotas(supply, asked)
    quota = controlled_rounding(fractions) if wanted else np.zeros(supply.shape, int)
    used = [(wanted[g].g, ([*bins_used, None])[b], int(supply[g, b]), float(fractions[g, b]), int(quota[g, b])) for g, b in np.argwhere(supply > 0)]
    table = spark.createDataFrame(used, "subdomain_group string, temporal_bin long, supply long, fraction double, quota long")
    cells = table.where(F.col("quota") > 0).select(F.col("subdomain_group").alias("g"), F.coalesce("temporal_bin", F.lit(-1)).alias("cell"), "quota")
    eligible = eligible.withColumn("cell", F.coalesce("bin", F.lit(-1).cast("bigint")))
    turn = exact_rank(eligible, ["g", "video", "bin"], ["key", "image_id"], "turn")
    ranked = exact_rank(turn, ["g", "cell"], ["turn", "key", "image_id"], "place")
    taken = materialize(ranked.join(cells, ["g", "cell"]).where(F.col("place") <= F.col("quota")), "sample")
    sample = taken.select("image_id", F.col("g").alias("subdomain_group"), "video", F.col("bin").alias("temporal_bin"))

    got = taken.groupBy("g").agg(F.count("*").alias("taken"))
    plan_rows = [(r.g, float(r.share), int(r.least), int(asked[i]), int(supply[i].sum())) for i, r in enumerate(wanted)]
    goal = spark.createDataFrame(plan_rows, "g string, target_share double, min_images long, quota long, supply long")
    all_taken = int(quota.sum())
    groups = goal.join(F.broadcast(got), "g", "left").select(
        F.col("g").alias("subdomain_group"),
        "target_share",
        F.when(F.lit(all_taken) > 0, F.coalesce("taken", F.lit(0)) / F.lit(max(all_taken, 1))).otherwise(F.lit(0.0)).alias("reached_share"),
        "min_images",
        "quota",
        "supply",
        F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        (F.col("quota") - F.coalesce("taken", F.lit(0))).alias("missing"),
    )
    # A planned bin without a draw fell short: for want of images, or because quotas went to others.
    drawn = taken.where(F.col("bin").isNotNull()).groupBy("video", F.col("bin").alias("temporal_bin")).agg(F.count("*").alias("taken"))
    there = rows.where(F.col("bin").isNotNull()).groupBy("video", F.col("bin").alias("temporal_bin")).agg(F.count("*").alias("supply"))
    bins = planned_bins(plans).join(drawn, ["video", "temporal_bin"], "left").join(there, ["video", "temporal_bin"], "left").select(
        "video",
        "temporal_bin",
        F.coalesce("supply", F.lit(0).cast("bigint")).alias("supply"),
        F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        F.when(F.col("taken").isNotNull(), "covered").when(F.col("supply").isNull(), "empty").otherwise("not drawn").alias("state"),
    )
    return Sample(sample, groups, bins, table)
