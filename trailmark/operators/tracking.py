"""Tracking ground truth: parsing with the first error per line, checks, and conversion to normalized boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.numeric import first_error, fixed_columns, float_value, is_finite, whole_double
from trailmark.operators.labels import FIELDS, box_error

GT_FIELDS = ("frame", "track_id", "x", "y", "width", "height", "flag")
_WHOLE = ("frame", "track_id", "flag")
#: What the errors say.
COUNT = "must contain exactly 7 comma-separated values; found %d."
NUMERIC, FINITE, INTEGER = "must be numeric.", "must be finite.", "must be an integer."
FRAME, POSITIVE = "frame must be greater than or equal to 1.", "must be greater than 0."


def parse_ground_truth(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add typed fields and ``error`` to lines; blank and null lines are left out, fields of bad lines null."""
    rows = lines.where(F.trim(F.regexp_replace(line, r"\s", " ")) != "")
    parts = F.transform(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    rows = fixed_columns(rows, {"__p": parts})
    rows = fixed_columns(rows, {f"__{name}": float_value(F.get("__p", F.lit(i))) for i, name in enumerate(GT_FIELDS)})
    raw = {name: F.col(f"__{name}") for name in GT_FIELDS}
    value = {name: whole_double(raw[name]) if name in _WHOLE else raw[name] for name in GT_FIELDS}
    rules: list = [(F.size("__p") != 7, F.format_string(COUNT, F.size("__p")))]
    for name in GT_FIELDS:
        number = raw[name]
        rules.append((number.isNull(), f"{name} {NUMERIC}"))
        rules.append((~is_finite(number), f"{name} {FINITE}"))
        if name in _WHOLE:
            rules.append((value[name].isNull(), f"{name} {INTEGER}"))
    rules += [
        (value["frame"] < 1, FRAME),
        (value["width"] <= 0, f"width {POSITIVE}"),
        (value["height"] <= 0, f"height {POSITIVE}"),
    ]
    rows = fixed_columns(rows, {"error": first_error(*rules)})
    keep = [c for c in lines.columns if c not in (*GT_FIELDS, "error")]
    return rows.select(*keep, *[F.when(F.col("error").isNull(), value[n]).alias(n) for n in GT_FIELDS], "error")


def duplicate_tracks(rows: DataFrame, sequence: str) -> DataFrame:
    """(sequence, frame, track_id, copies) of ids that stand more than once in a frame."""
    counts = rows.groupBy(sequence, "frame", "track_id").agg(F.count("*").alias("copies"))
    return counts.where(F.col("copies") > 1)


def to_normalized(rows: DataFrame, image_w: Column, image_h: Column) -> DataFrame:
    """Add the normalized centre box; ``error`` names boxes outside the image."""
    box = {
        "x_center": (F.col("x") + F.col("width") / 2) / image_w,
        "y_center": (F.col("y") + F.col("height") / 2) / image_h,
        "width": F.col("width") / image_w,
        "height": F.col("height") / image_h,
    }
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("width") > image_w) | (F.col("y") + F.col("height") > image_h)
    none = F.lit(None).cast("double")
    error = F.coalesce(
        first_error(((image_w <= 0) | (image_h <= 0), "image dimensions must be greater than 0."), (outside, "box extends outside image bounds.")),
        box_error(F.lit(0), box, none, none),
    )
    keep = [c for c in rows.columns if c not in ("x", "y", "width", "height", "error")]
    picked = rows.withColumn("__e", error)
    return picked.select(*keep, *[F.when(F.col("__e").isNull(), box[k]).alias(f"norm_{k}") for k in FIELDS], F.col("__e").alias("error"))


def sequence_summary(rows: DataFrame, sequence: str) -> DataFrame:
    """Rows, tracks, frame range and flags of each sequence."""
    return rows.groupBy(sequence).agg(
        F.count("*").alias("annotations"),
        F.count_distinct("track_id").alias("tracks"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count_distinct("frame").alias("frames"),
        F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"),
    )


def frame_gaps(rows: DataFrame, sequence: str) -> DataFrame:
    """(sequence, frame, state): frames from 1 to a sequence's last without annotation.

    The frame list is built per sequence from its last frame in blocks, then both directions are anti-joins.
    """
    last = rows.groupBy(sequence).agg(F.max("frame").alias("n"))
    blocks = last.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 4096))))
    frames = blocks.select(sequence, F.explode(F.sequence(F.col("b") * 4096 + 1, F.least(F.col("n"), (F.col("b") + 1) * 4096))).alias("frame"))
    return frames.join(rows.select(sequence, "frame").distinct(), [sequence, "frame"], "left_anti")
