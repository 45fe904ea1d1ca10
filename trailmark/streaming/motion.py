"""Live motion metrics: frames arrive as a stream, state is kept per stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = (
    "stream bigint, processed_frames bigint, warmup_frames bigint, scored_frames bigint, average_score double, max_score double, "
    "average_regions double, max_regions bigint, peak_seconds double"
)
_STATE = "frames bigint, scored bigint, score_sum double, score_max double, region_sum bigint, region_max bigint, peak double, peak_frame bigint"


def running_summary(frames: DataFrame, warmup: int) -> DataFrame:
    """Summary of each stream after every batch, from frames (stream, frame_index, seconds, score, regions).

    Frames before ``warmup`` are counted, not scored. State per stream is one row of sums, whatever the number
    of frames. The peak is the earliest frame of the highest score above 0, in whatever order frames arrive.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, scored, total, most, regions, most_regions, peak, peak_frame = state.get if state.exists else (0, 0, 0.0, 0.0, 0, 0, 0.0, -1)
        for f in batches:
            n += len(f)
            f = f[f["frame_index"] >= warmup]
            if f.empty:
                continue
            scored += len(f)
            total += float(f["score"].sum())
            regions += int(f["regions"].sum())
            most_regions = max(most_regions, int(f["regions"].max()))
            top = f.sort_values(["score", "frame_index"], ascending=[False, True]).iloc[0]
            better = top["score"] > most or (top["score"] == most and most > 0 and top["frame_index"] < peak_frame)
            if better:
                most, peak, peak_frame = float(top["score"]), float(top["seconds"]), int(top["frame_index"])
        state.update((n, scored, total, most, regions, most_regions, peak, peak_frame))
        mean = lambda x: x / scored if scored else 0.0
        yield pd.DataFrame([(key[0], n, n - scored, scored, mean(total), most, mean(regions), most_regions, peak)], columns=[c.split()[0] for c in _OUT.split(", ")])

    return frames.groupBy("stream").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def activity_windows(frames: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Event-time windows of activity per stream, late rows dropped after ``late``. An extension beyond frame order."""
    return (
        frames.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, window), "stream")
        .agg(F.count("*").alias("frames"), F.avg("score").alias("average_score"), F.max("score").alias("max_score"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "stream", "frames", "average_score", "max_score")
    )


def detection_totals(detections: DataFrame) -> DataFrame:
    """Processed frames and detections of a detections stream or table (a row per frame)."""
    return detections.agg(F.count("*").alias("processed_frames"), F.coalesce(F.sum(F.size("detections")), F.lit(0)).alias("total_detections"))
