"""Dataset statistics over images and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ranking import exact_percentiles


def split_statistics(images: DataFrame, boxes: DataFrame, split: str, image: str) -> DataFrame:
    """Per split: images, annotations, images without one, and average, least and most per image.

    Boxes are counted before the join, so a crowded image costs one row; images without boxes stay.
    """
    counts = boxes.groupBy(image).agg(F.count("*").alias("n"))
    joined = images.select(split, image).join(counts, image, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return joined.groupBy(split).agg(
        F.count("*").alias("images"),
        F.sum("n").alias("annotations"),
        F.count_if(F.col("n") == 0).alias("images_without"),
        F.avg("n").alias("average_per_image"),
        F.min("n").alias("least_per_image"),
        F.max("n").alias("most_per_image"),
    )


def size_percentiles(boxes: DataFrame, keys: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """Exact medians of width, height and area and the area's 25th and 75th percentile (linear between ranks)."""
    rows = boxes.select(*keys, F.col(width).alias("__w"), F.col(height).alias("__h"), (F.col(width) * F.col(height)).alias("__a"))
    wanted = {"median_width": ("__w", 0.5), "median_height": ("__h", 0.5), "median_area": ("__a", 0.5), "p25_area": ("__a", 0.25), "p75_area": ("__a", 0.75)}
    return exact_percentiles(rows, keys, wanted)


def scale_summary(boxes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, extremes, mean and percentiles of one measure, in one pass; a group without values has no row."""
    ranks = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    plain = {"boxes": F.count, "least": F.min, "most": F.max, "mean": F.avg}
    return exact_percentiles(boxes.select(*keys, value), keys, {n: (value, p) for n, p in ranks.items()}, {n: (value, of) for n, of in plain.items()})


def class_audit(boxes: DataFrame, class_id: str = "class_id", image: str = "image_id") -> DataFrame:
    return boxes.groupBy(class_id).agg(F.count("*").alias("annotations"), F.count_distinct(image).alias("images"))


def density_by_source(boxes: DataFrame, source: str, image: str) -> DataFrame:
    """Objects per image of each source: images, mean, median and most."""
    # A picture's count is a small number, so the counts of counts are few whatever the images.
    per = boxes.groupBy(source, image).agg(F.count("*").alias("n")).groupBy(source, "n").agg(F.count("*").alias("k"))
    return per.groupBy(source).agg(
        F.sum("k").alias("images"), (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean_objects"), F.percentile("n", F.lit(0.5), F.col("k")).alias("median_objects"), F.max("n").alias("most_objects")
    )


def density_class(mean_objects: Column, limits: dict[str, float]) -> Column:
    """Name of the first limit (by rising value) that the mean stays below, the last name beyond all."""
    ordered = sorted(limits.items(), key=lambda x: x[1])
    out = F.lit(ordered[-1][0])
    for name, limit in reversed(ordered[:-1]):
        out = F.when(mean_objects < limit, name).otherwise(out)
    return F.when(mean_objects.isNotNull(), out)
