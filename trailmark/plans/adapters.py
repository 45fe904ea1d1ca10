"""The test tables in the shapes that the operators take. Every row of a table is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.session import read_table, spread

_LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: Fixed values of the adapters: streams of events and sequences of images, and the size of tracked images.
STREAMS = 8
IMAGE_W, IMAGE_H = 1920, 1080


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames (stream, frame_index, seconds, score, regions) from events."""
    e = read_table(spark, folder, "events").withColumn("stream", F.col("user_id") % STREAMS)
    i = F.row_number().over(Window.partitionBy("stream").orderBy("ts", "event_id")) - 1
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500))
    regions = F.get_json_object("props", "$.k").cast("int") % 10
    return e.select("stream", i.cast("bigint").alias("frame_index"), (i / 30).alias("seconds"), score.alias("score"), regions.alias("regions"))


def order_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of images (orders) from line items; odd ones are truth, even ones predictions."""
    rows = read_table(spark, folder, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    w, h = F.lit(20.0) + F.col("l_quantity").cast("bigint") % 20, F.lit(20.0) + F.col("l_linenumber")
    box = rows.withColumn("n", number).withColumn("w", w).withColumn("h", h).withColumn("x", x).withColumn("y", y)
    return box.select(
        (F.col("l_orderkey") % STREAMS).alias("seq"), F.col("l_orderkey").alias("image"), "n", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"),
        (F.col("y") + F.col("h")).alias("y2"), (1 - F.col("l_discount")).alias("confidence"),
    )


def truth(boxes: DataFrame) -> DataFrame:
    return boxes.where(F.col("n") % 2 == 1).select("seq", "image", ((F.col("n") - 1) / 2).cast("int").alias("gt_id"), "x1", "y1", "x2", "y2")


def predictions(boxes: DataFrame) -> DataFrame:
    return boxes.where(F.col("n") % 2 == 0).select("seq", "image", (F.col("n") / 2 - 1).cast("int").alias("pred_id"), "x1", "y1", "x2", "y2", "confidence")


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Polygon label lines (line_id, line) from line items; some with a broken rule."""
    rows = spread(read_table(spark, folder, "lineitem"))
    part = lambda c: F.concat(F.lit("0."), F.lpad(c.cast("string"), 3, "0"))
    a, b, q = F.col("l_partkey") % 500, F.col("l_suppkey") % 500, F.col("l_quantity").cast("bigint")
    points = [part(a), part(b), part(a + q), part(b + 7), part(a + 3), part(b + q)]
    extra = F.when(F.col("l_linenumber") == 6, " 0.5").when(F.col("l_linenumber") == 5, " 1.5 0.5").when(F.col("l_linenumber") == 4, " x 0.5").otherwise("")
    cls = F.when(F.col("l_linenumber") == 7, "1").otherwise("0")
    return rows.select(F.concat_ws(" ", cls, *points).alias("p"), extra.alias("e")).select(F.concat("p", "e").alias("line"))


def distinct_images(spark: SparkSession, folder: str) -> DataFrame:
    """One row per image of the manifest (first delivery)."""
    rows = read_table(spark, folder, "frame_manifest")
    return rows.dropDuplicates(["image_id"])


def distinct_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per box (deliveries of a box are equal but for their loading time)."""
    return read_table(spark, folder, "boxes").drop("loaded_at").dropDuplicates(["box_id"])
