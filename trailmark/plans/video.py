"""Pipelines over frames of videos: motion analysis, frame extraction and detection.

Frames are tables (stream, frame_index, height, width, pixels), read by :mod:`trailmark.sources.frames` or brought by
the caller; decoding of compressed videos and drawing stay outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import motion, pixels, temporal
from trailmark.plans.pipelines import Report
from trailmark.session import materialize
from trailmark.sources.frames import png

ROI = tuple[int, int, int, int]


def _checked_roi(frames: DataFrame, roi: ROI | None) -> tuple[ROI, int, int]:
    """The region of interest, by default the frame, and the frame's height and width."""
    first = frames.select("height", "width").first()
    if first is None:
        raise ValueError("the video has no readable frames")
    x, y, w, h = roi or (0, 0, first.width, first.height)
    if min(x, y) < 0 or min(w, h) <= 0:
        raise ValueError("the region of interest must have a size and no negative corner")
    if x + w > first.width or y + h > first.height:
        raise ValueError("the region of interest exceeds the frame")
    return (x, y, w, h), first.height, first.width


def analyze(
    frames: DataFrame, fps: float, roi: ROI | None = None, warmup: int = 25, min_area: float = 0.0, min_area_ratio: float = 1e-5, detector: Callable[[], pixels.Detector] = pixels.MotionDetector, total_frames: int = 0
) -> Report:
    """Motion metrics of streams of frames: tables ``frames`` (metrics and regions), ``summary`` per stream and ``heatmap``.

    ``min_area`` of 0 derives it from the region of interest by ``min_area_ratio``. Regions and heatmap cells have
    their places in the whole frame.
    """
    region, height, width = _checked_roi(frames, roi)
    if min_area < 0 or min_area_ratio <= 0:
        raise ValueError("min_area must not be negative and min_area_ratio must be above 0")
    least = min_area if min_area > 0 else max(1.0, region[2] * region[3] * min_area_ratio)
    seen = pixels.motion_frames(frames, max(0, warmup), least, detector, region)
    seconds = temporal.frame_seconds(F.col("frame_index"), F.lit(float(fps)), "analyze")
    seen = materialize(seen.withColumn("seconds", seconds), "motion")
    cells = seen.select("stream", F.explode("cells").alias("c")).select("stream", "c.y", "c.x")
    summary = motion.motion_summary(seen, "stream").withColumn("duration_seconds", temporal.duration_seconds(F.lit(total_frames), F.lit(float(fps))))
    heat = motion.heatmap(cells, ["stream"], height, width)
    return Report({"min_area": least, "roi": list(region), "width": width, "height": height}, [], {"frames": seen.drop("cells"), "summary": summary, "heatmap": heat})


def extract_frames(frames: DataFrame, fps: float, every: int | None = None, count: int | None = None, seconds: float | None = None, roi: ROI | None = None, extension: str = ".png") -> DataFrame:
    """(stream, frame_index, seconds, image, data): chosen frames as PNG, cropped to the region of interest.

    Chosen are every ``every``-th frame, or one per ``seconds``, or ``count`` spread evenly; just one of the three.
    """
    if sum(v is not None for v in (every, count, seconds)) != 1:
        raise ValueError("give one of every, count and seconds")
    (x, y, w, h), *_ = _checked_roi(frames, roi)
    if count is not None:
        if count < 1:
            raise ValueError("count must be at least 1")
        chosen = temporal.sample_positions(frames, "stream", lambda n: temporal.fixed_positions(n, count))
    else:
        chosen = temporal.sample_interval(frames, every if every is not None else temporal.every_frames(fps, seconds))

    @F.pandas_udf("binary")
    def crop(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        image = lambda d, a, b: np.frombuffer(d, np.uint8).reshape(a, b, -1).squeeze()[y : y + h, x : x + w]
        return pd.Series([png(image(*row)) for row in zip(data, height, width)])

    time = temporal.frame_seconds(F.col("frame_index"), F.lit(float(fps)), "extract")
    stem = F.regexp_replace(F.col("stream").cast("string"), r"\.[^.]*$", "")
    return chosen.select("stream", "frame_index", F.round(time, 6).alias("seconds"), temporal.frame_name(stem, F.col("frame_index"), time, extension).alias("image"), crop("pixels", "height", "width").alias("data"))


def detect(frames: DataFrame, load: Callable[[], Callable[[np.ndarray], list]], classes: dict[int, str], fps: float, roi: ROI | None = None) -> DataFrame:
    """(stream, frameIndex, timestampSeconds, detections): a row per frame, frames without any included.

    ``load`` runs once per task and gives a function from an image to (class, confidence, x1, y1, x2, y2) within the
    region of interest. Boxes come out in the whole frame with whole numbers, halves to even. A class that ``classes``
    doesn't name fails the query.
    """
    (x, y, w, h), *_ = _checked_roi(frames, roi)
    kind = frames.schema["stream"].dataType.simpleString()
    found = "array<struct<c: int, confidence: double, x1: double, y1: double, x2: double, y2: double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = []
            for height, width, data in zip(batch["height"], batch["width"], batch["pixels"]):
                image = np.frombuffer(data, np.uint8).reshape(height, width, -1).squeeze()[y : y + h, x : x + w]
                out.append([dict(zip(("c", "confidence", "x1", "y1", "x2", "y2"), map(float, d))) | {"c": int(d[0])} for d in model(image)])
            yield pd.DataFrame({"stream": batch["stream"], "frame_index": batch["frame_index"], "found": out})

    predicted = frames.select("stream", "frame_index", "height", "width", "pixels").mapInPandas(run, f"stream {kind}, frame_index bigint, found {found}")
    names = F.create_map(*[F.lit(v) for k, name in classes.items() for v in (k, name)])

    def detection(d):
        known = F.coalesce(F.try_element_at(names, d.c), F.raise_error(F.concat(F.lit("unexpected class "), d.c.cast("string"))).cast("string"))
        box = motion.to_global(d.x1, d.y1, d.x2 - d.x1, d.y2 - d.y1, F.lit(x), F.lit(y))
        return F.struct(d.c.alias("classId"), known.alias("className"), d.confidence.alias("confidence"), box.alias("bbox"))

    time = temporal.frame_seconds(F.col("frame_index"), F.lit(float(fps)), "detect")
    return predicted.select("stream", F.col("frame_index").alias("frameIndex"), time.alias("timestampSeconds"), F.transform("found", detection).alias("detections"))
