"""Evaluation of detections from per-image counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.geometry import Corners
from trailmark.functions.numeric import half_even, safe_ratio
from trailmark.operators.matching import Rule, count_matches
from trailmark.operators.ranking import exact_rank, null_safe_join
from trailmark.session import materialize

TERCILES = ("low", "medium", "high")


def frame_evaluation(images: DataFrame, truth: DataFrame, predictions: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts of each image: truth, predictions, matches by centre and by overlap. Images without boxes stay with zeros."""
    counted = count_matches(images, truth, predictions, keys, [Rule(), Rule(threshold)])
    names = ("center", "iou50")
    rows = counted.select(*keys, "gt_count", "prediction_count", *[F.get("matched", F.lit(i)).alias(f"{kind}_matched") for i, kind in enumerate(names)])
    for kind in names:
        rows = rows.withColumn(f"{kind}_missed", F.col("gt_count") - F.col(f"{kind}_matched")).withColumn(f"{kind}_unmatched", F.col("prediction_count") - F.col(f"{kind}_matched"))
    return rows


def totals(frames: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Sums with precision and recall by either rule, and ``more`` aggregates."""
    agg = frames.groupBy(*keys).agg(
        F.count("*").alias("images"), *[F.sum(c).alias(c) for c in ("gt_count", "prediction_count", "center_matched", "iou50_matched")], *more
    )
    for kind in ("center", "iou50"):
        m = F.col(f"{kind}_matched")
        agg = (
            agg.withColumn(f"{kind}_false_positives", F.col("prediction_count") - m)
            .withColumn(f"{kind}_false_negatives", F.col("gt_count") - m)
            .withColumn(f"{kind}_precision", safe_ratio(m, F.col("prediction_count")))
            .withColumn(f"{kind}_recall", safe_ratio(m, F.col("gt_count")))
        )
    return agg


def distinct_truth(totals_: DataFrame, extra_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``distinct_gt_count``: the truth less rows that repeat another of their label file (keys, extra_rows)."""
    extra = extra_rows.groupBy(*keys).agg(F.sum("extra_rows").alias("__x"))
    return totals_.join(extra, keys, "left").withColumn("distinct_gt_count", F.col("gt_count") - F.coalesce("__x", F.lit(0))).drop("__x")


def thirds(rows: DataFrame, keys: list[str], order: list[str], names: tuple[str, str, str], out: str) -> DataFrame:
    """Add ``out``: the first floor(n / 3) rows of each key by ``order`` have the first name, those up to floor(2 n / 3)
    the second, the rest the third. Ranks span partitions, so a key may have any number of rows."""
    ranked = exact_rank(rows, keys, order, "__i", "__n")
    i, n = F.col("__i") - 1, F.col("__n")
    group = F.when(i < F.floor(n / 3), names[0]).when(i < F.floor(n * 2 / 3), names[1]).otherwise(names[2])
    return ranked.withColumn(out, group).drop("__i", "__n")


def density_groups(frames: DataFrame, sequence: list[str], image: str) -> DataFrame:
    """Add ``density``: the first third by truth count and name is low, up to two thirds medium, the rest high."""
    return thirds(frames, sequence, ["gt_count", image], TERCILES, "density")


def density_analysis(frames: DataFrame, sequence: list[str], image: str) -> DataFrame:
    """Counts and rates of the three density groups of each sequence; groups without images come out with zeros."""
    frames = materialize(frames, "frames")  # the matching runs once
    grouped = totals(density_groups(frames, sequence, image), [*sequence, "density"], F.min("gt_count").alias("least_gt"), F.max("gt_count").alias("most_gt"))
    every = frames.select(*sequence).distinct().withColumn("density", F.explode(F.array(*[F.lit(t) for t in TERCILES])))
    return every.join(grouped, [*sequence, "density"], "left").fillna(0)


def macro_average(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Unweighted mean over sources, zeros over none."""
    return rows.agg(F.count("*").alias("sources"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in measures])


def _sweep(images: DataFrame, truth: DataFrame, predictions: DataFrame, keys: list[str], rules: list[Rule], thresholds: list[float]) -> DataFrame:
    """(threshold, matched): matches under each rule, summed over the images of one pass."""
    counted = count_matches(images, truth, predictions, keys, rules)
    sums = counted.agg(*[F.sum(F.get("matched", F.lit(i))).alias(f"m{i}") for i in range(len(rules))])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(f"m{i}", F.lit(0).cast("bigint")).alias("matched")) for i, t in enumerate(thresholds)]))
    return sums.select(each.alias("s")).select("s.*")


def confidence_sweep(images: DataFrame, truth: DataFrame, predictions: DataFrame, keys: list[str], thresholds: list[float], iou: float = 0.5) -> DataFrame:
    """Matches and predictions at each confidence threshold, all of one pass over the images."""
    matched = _sweep(images, truth, predictions, keys, [Rule(iou, t) for t in thresholds], thresholds)
    kept = predictions.agg(*[F.count_if(F.col("confidence") >= t).alias(f"n{i}") for i, t in enumerate(thresholds)])
    steps = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("predictions")) for i, t in enumerate(thresholds)]))
    total = truth.agg(F.count("*").alias("truth")).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return total.join(kept.select(steps.alias("s")).select("s.*"), "threshold").join(matched, "threshold").select("threshold", "truth", "predictions", "matched")


def iou_sweep(truth: DataFrame, predictions: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Maximum matches at each overlap threshold, all of one pass over the images."""
    return _sweep(truth, truth, predictions, keys, [Rule(t) for t in thresholds], thresholds)


def suppress(predictions: DataFrame, keys: list[str], overlap: float) -> DataFrame:
    """Predictions that survive greedy suppression: by falling confidence (ties by id), a box goes if it overlaps a kept
    one by more than ``overlap``. Images are grouped once; a list is bounded by the boxes of a picture."""
    fields = ["pred_id", "confidence", "x1", "y1", "x2", "y2"]
    grouped = predictions.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) if c != "pred_id" else F.col(c).cast("bigint").alias(c) for c in fields])).alias("__p"))

    @F.pandas_udf("array<bigint>")
    def kept(lists: pd.Series) -> pd.Series:
        return pd.Series([_survivors(boxes, overlap) for boxes in lists])

    return grouped.select(*keys, F.explode(kept("__p")).alias("pred_id"))


def _survivors(boxes, overlap: float) -> list[int]:
    rows = sorted((-b["confidence"], b["pred_id"], b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes)
    box = np.array([r[2:] for r in rows])
    area = np.maximum(0.0, box[:, 2] - box[:, 0]) * np.maximum(0.0, box[:, 3] - box[:, 1])
    alive, out = np.ones(len(rows), bool), []
    for i in range(len(rows)):
        if alive[i]:
            out.append(int(rows[i][1]))
            later = box[i + 1 :]
            shared = np.maximum(0.0, np.minimum(box[i, 2], later[:, 2]) - np.maximum(box[i, 0], later[:, 0])) * np.maximum(0.0, np.minimum(box[i, 3], later[:, 3]) - np.maximum(box[i, 1], later[:, 1]))
            union = area[i] + area[i + 1 :] - shared
            alive[i + 1 :] &= ~(np.divide(shared, union, out=np.zeros_like(shared), where=union > 0) > overlap)
    return out


def suppression_sweep(truth: DataFrame, predictions: DataFrame, keys: list[str], overlaps: list[float], iou: float = 0.5) -> DataFrame:
    """(overlap, predictions, matched): what survives suppression at each overlap and its matches."""
    parts = []
    for o in overlaps:  # a short list of settings
        kept = predictions.join(suppress(predictions, keys, o), [*keys, "pred_id"], "left_semi")
        counted = count_matches(truth, truth, kept, keys, [Rule(iou)])
        zero = F.lit(0).cast("bigint")
        parts.append(counted.agg(F.lit(float(o)).alias("overlap"), F.coalesce(F.sum("prediction_count"), zero).alias("predictions"), F.coalesce(F.sum(F.get("matched", F.lit(0))), zero).alias("matched")))
    return reduce(DataFrame.unionByName, parts)


def scale_terciles(truth: DataFrame, keys: list[str], area: Column) -> DataFrame:
    """Add ``scale``: thirds of the boxes of each key by area, ties by box id."""
    return thirds(truth.withColumn("__a", area), keys, ["__a", "gt_id", "image"], ("small", "medium", "large"), "scale").drop("__a")


def crowding(truth: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(keys, gt_id, neighbours, crowding): boxes of the image with a centre within ``radius``, in bins 0, 1-2, 3+."""
    a = truth.select(*keys, "gt_id", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = truth.select(*keys, F.col("gt_id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = Corners.of("a_").center_distance(Corners.of("b_")) <= radius
    n = F.count_if((F.col("other") != F.col("gt_id")) & near)
    counted = a.join(b, keys).groupBy(*keys, "gt_id").agg(n.alias("neighbours"))
    bins = F.when(F.col("neighbours") == 0, "0").when(F.col("neighbours") <= 2, "1-2").otherwise("3+")
    return counted.withColumn("crowding", bins)


def example_frames(frames: DataFrame, sequence: list[str], image: str, count: int = 10) -> DataFrame:
    """Up to ``count`` telling images of each sequence, with the order in which they were chosen.

    Seven extremes (the first image by name wins ties), the middle of each density group, then images
    spread evenly over the names; an image is taken once.
    """
    frames = materialize(frames, "frames")
    named = exact_rank(exact_rank(frames, sequence, ["gt_count", image], "__d"), sequence, [image], "__o")
    named = named.withColumn("__d", F.col("__d") - 1).withColumn("__o", F.col("__o") - 1)
    recall = safe_ratio(F.col("center_matched"), F.col("gt_count"))
    most = [
        [recall, -F.col("center_unmatched")],
        [F.col("center_missed"), F.col("gt_count")],
        [F.col("center_unmatched"), F.col("prediction_count")],
        [F.col("gt_count")],
        [-F.col("gt_count")],
        [F.col("center_matched") - F.col("iou50_matched"), F.col("center_matched")],
        [F.col("gt_count"), F.col("center_missed")],
    ]
    firsts = [F.max_by("__o", F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*criteria, -F.col("__o")])])).alias(f"__f{k}") for k, criteria in enumerate(most)]
    summary = named.groupBy(*sequence).agg(F.count("*").alias("__n"), *firsts)
    rows = null_safe_join(named, summary, sequence)
    n = F.col("__n")
    low, high = F.floor(n / 3), F.floor(n * 2 / 3)
    bounds = ((F.lit(0), low), (low, high), (high, n))
    picks = [F.when(F.col("__o") == F.col(f"__f{k}"), F.lit(k)) for k in range(len(most))]
    picks += [F.when((high_ > low_) & (F.col("__d") == low_ + F.floor((high_ - low_) / 2)), F.lit(7 + k)) for k, (low_, high_) in enumerate(bounds)]
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: half_even(i * (n - 1) / F.lit(count - 1)))
    turn = F.when(n <= count, F.lit(10) + F.col("__o")).when(F.array_contains(spread, F.col("__o")), F.lit(10) + F.array_position(spread, F.col("__o")))
    # Few rows of a sequence are chosen: at most 10 and ``count``.
    chosen = rows.withColumn("__pick", F.least(*picks, turn.cast("int"))).where(F.col("__pick").isNotNull())
    order = F.row_number().over(Window.partitionBy(*sequence).orderBy("__pick"))
    return chosen.withColumn("choice", order).where(F.col("choice") <= count).select(*sequence, image, "choice")


def density_correlation(frames_a: DataFrame, frames_b: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson correlation of an image's truth count and the recall difference of two detectors."""
    a = frames_a.select(*keys, "gt_count", safe_ratio(F.col("iou50_matched"), F.col("gt_count")).alias("ra"))
    b = frames_b.select(*keys, safe_ratio(F.col("iou50_matched"), F.col("gt_count")).alias("rb"))
    return a.join(b, keys).agg(F.corr(F.col("gt_count").cast("double"), F.col("rb") - F.col("ra")).alias("correlation"))
