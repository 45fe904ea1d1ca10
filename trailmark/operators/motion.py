"""Motion metrics per stream of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.numeric import half_even
from trailmark.operators.ranking import null_safe_join


def with_warmup(frames: DataFrame, warmup: int, frame: str = "frame_index") -> DataFrame:
    """Warm-up frames keep their row, with no activity; ``scored`` tells them apart."""
    scored = F.col(frame) >= warmup
    return frames.withColumn("scored", scored).withColumn("score", F.when(scored, F.col("score")).otherwise(0.0)).withColumn("regions", F.when(scored, F.col("regions")).otherwise(0))


def motion_summary(frames: DataFrame, stream: str, seconds: str = "seconds") -> DataFrame:
    """Counts, averages, maxima and the time of the earliest highest score of each stream; zeros where nothing scored."""
    score, regions = F.when(F.col("scored"), F.col("score")), F.when(F.col("scored"), F.col("regions"))
    zero = F.lit(0.0)
    top = F.max_by(F.col(seconds), F.when(F.col("scored"), F.struct(F.col("score"), (-F.col("frame_index")).alias("f"))))
    return frames.groupBy(stream).agg(
        F.count("*").alias("processed_frames"),
        F.count_if(~F.col("scored")).alias("warmup_frames"),
        F.count_if("scored").alias("scored_frames"),
        F.round(F.coalesce(F.avg(score), zero), 6).alias("average_score"),
        F.round(F.coalesce(F.max(score), zero), 6).alias("max_score"),
        F.round(F.coalesce(F.avg(regions), zero), 6).alias("average_regions"),
        F.coalesce(F.max(regions), F.lit(0)).alias("max_regions"),
        F.round(F.when(F.max(score) > 0, top).otherwise(zero), 6).alias("peak_seconds"),
    )


def activity_score(set_pixels: Column, pixels: Column) -> Column:
    """Share of set pixels, held between 0 and 1; 0 of nothing."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(set_pixels, pixels))), F.lit(0.0))


def min_motion_area(roi_area: Column, ratio: Column, explicit: Column | None = None) -> Column:
    derived = F.greatest(F.lit(1.0), roi_area * ratio)
    return derived if explicit is None else F.coalesce(F.when(explicit > 0, explicit), derived)


def motion_regions(regions: Column, min_area: Column) -> Column:
    """Regions (structs with ``area``) of at least ``min_area``, largest first, equal ones in their order."""
    numbered = F.transform(regions, lambda r, i: F.struct((-r.area).alias("o"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(F.filter(numbered, lambda n: n.r.area >= min_area)), lambda n: n.r)


def to_global(x: Column, y: Column, w: Column, h: Column, roi_x: Column, roi_y: Column) -> Column:
    """Box within a region of interest to frame coordinates, each value rounded half to even."""
    return F.struct(half_even(x + roi_x).alias("x"), half_even(y + roi_y).alias("y"), half_even(w).alias("width"), half_even(h).alias("height"))


def heatmap(cells: DataFrame, keys: list[str], height: int, width: int, y: str = "y", x: str = "x") -> DataFrame:
    """Times each cell of a grid of ``height`` x ``width`` was set and its level from 0 to 255, of cells that were.

    ``cells`` has a row per set cell and frame. Levels are scaled between the least and the most of the whole grid,
    where cells never set count 0, and cut to whole numbers; a grid of equal cells is 0 everywhere. Cells outside the
    grid are left out.
    """
    inside = F.col(y).between(0, height - 1) & F.col(x).between(0, width - 1)
    counts = cells.where(inside).groupBy(*keys, y, x).agg(F.count("*").alias("hits"))
    ends = counts.groupBy(*keys).agg(F.min("hits").alias("__least"), F.max("hits").alias("__high"), F.count("*").alias("__set"))
    ends = ends.withColumn("__low", F.when(F.col("__set") < height * width, F.lit(0)).otherwise(F.col("__least")))
    joined = null_safe_join(counts, ends, keys)
    scaled = ((F.col("hits") - F.col("__low")) * 255 / (F.col("__high") - F.col("__low"))).cast("float")
    level = F.when(F.col("__high") > F.col("__low"), F.floor(scaled)).otherwise(F.lit(0))
    return joined.withColumn("level", level.cast("int")).drop("__least", "__low", "__high", "__set")


def place_in_frame(mask: DataFrame, x: str = "x", y: str = "y", roi_x: int = 0, roi_y: int = 0) -> DataFrame:
    """Set cells of a mask over a region of interest, at their places in the whole frame."""
    return mask.withColumn(x, F.col(x) + roi_x).withColumn(y, F.col(y) + roi_y)
