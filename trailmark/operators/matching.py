"""Ground truth and predictions of an image: candidate pairs and maximum one-to-one matching.

Counts need no identities: all boxes of an image meet in one grouping, and one pass over Arrow batches gives the
sizes of the maximum matchings under any number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from trailmark.functions.geometry import Corners

#: Boxes with candidates up to which an image is solved by bit masks.
MASK_TRUTH = 64
MASK_PREDICTIONS = 8


def _pairs(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> tuple[DataFrame, Corners, Corners]:
    g = truth.select(*keys, "gt_id", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = predictions.select(*keys, "pred_id", "confidence", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    return g.join(p, keys), Corners.of("g_"), Corners.of("p_")


def center_candidates(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose prediction centre lies in the true box; ranked by confidence, then distance."""
    pairs, g, p = _pairs(truth, predictions, keys)
    found = pairs.where(g.holds_center_of(p)).withColumn("distance", p.center_distance(g))
    order = [F.desc("confidence"), F.col("distance"), F.col("pred_id"), F.col("gt_id")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.select(*keys, "pred_id", "gt_id", "confidence", "distance", rank.alias("rank"))


def iou_candidates(truth: DataFrame, predictions: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs with at least that overlap; ranked by overlap, then confidence."""
    pairs, g, p = _pairs(truth, predictions, keys)
    found = pairs.withColumn("iou", g.iou(p)).where(F.col("iou") >= threshold)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("iou"), F.desc("confidence"), "pred_id", "gt_id"))
    return found.select(*keys, "pred_id", "gt_id", "confidence", "iou", rank.alias("rank"))


def augmenting_match(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Maximum matching of (rank, prediction, truth) edges, without recursion.

    Predictions enter in the order of their best rank and try their edges in rank order, so the result is
    the same for the same ranks. Result by rank, prediction and truth.
    """
    ranks: dict[tuple[int, int], int] = {}
    for rank, p, g in sorted(edges):
        ranks.setdefault((p, g), rank)
    options: dict[int, list[int]] = {}
    for p, g in ranks:
        options.setdefault(p, []).append(g)
    holder: dict[int, int] = {}
    for start in sorted(options, key=lambda p: (ranks[p, options[p][0]], p)):
        seen: set[int] = set()
        stack = [(start, iter(options[start]))]
        wants: list[int] = []
        while stack:
            g = next((g for g in stack[-1][1] if g not in seen), None)
            if g is None:
                stack.pop()
                if wants:
                    wants.pop()
                continue
            seen.add(g)
            wants.append(g)
            if g in holder:
                stack.append((holder[g], iter(options[holder[g]])))
                continue
            for (p, _), got in zip(stack, wants):
                holder[got] = p
            break
    return sorted(((p, g) for g, p in holder.items()), key=lambda m: (ranks[m], m))


def match_pairs(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Matched (keys, pred_id, gt_id) of maximum number."""
    images = candidates.groupBy(*keys).agg(F.collect_list(F.struct("rank", F.col("pred_id").cast("int").alias("pred_id"), F.col("gt_id").cast("int").alias("gt_id"))).alias("__e"))

    @F.pandas_udf("array<struct<pred_id: int, gt_id: int>>")
    def solve(edges: pd.Series) -> pd.Series:
        return pd.Series([[{"pred_id": p, "gt_id": g} for p, g in augmenting_match([(e["rank"], e["pred_id"], e["gt_id"]) for e in image])] for image in edges])

    return images.select(*keys, F.explode(solve("__e")).alias("m")).select(*keys, "m.pred_id", "m.gt_id")


@dataclass(frozen=True)
class Rule:
    """When a prediction may be matched to a true box: its centre lies in it (``iou`` null) or they overlap by at least
    ``iou``; predictions below ``confidence`` don't take part."""

    iou: float | None = None
    confidence: float = float("-inf")


_BOX = ("x1", "y1", "x2", "y2")
#: Pairs of boxes that are compared at once.
_PAIRS_AT_ONCE = 1 << 20


def _lists(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lists of structs and the flat values of their fields."""
    flat = column.flatten()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _edges(n_truth: np.ndarray, truth: list[np.ndarray], n_pred: np.ndarray, pred: list[np.ndarray], rules: list[Rule]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per rule the pairs (prediction, true box) that it allows, by their places in the flat arrays."""
    first = np.repeat(np.cumsum(n_truth) - n_truth, n_pred)
    each, out = np.repeat(n_truth, n_pred), [([], []) for _ in rules]
    ends = np.cumsum(each)
    x1, y1, x2, y2, confidence = pred
    area = lambda b: np.maximum(0.0, b[2] - b[0]) * np.maximum(0.0, b[3] - b[1])
    begin = 0
    while begin < len(each):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS_AT_ONCE, "right")))
        n = each[begin:end]
        p = np.repeat(np.arange(begin, end), n)
        g = np.repeat(first[begin:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        a, b = [t[g] for t in truth], [x1[p], y1[p], x2[p], y2[p]]
        cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        inside = (cx >= a[0]) & (cx <= a[2]) & (cy >= a[1]) & (cy <= a[3])
        shared = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
        union = area(a) + area(b) - shared
        iou = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        for (ps, gs), rule in zip(out, rules):
            ok = np.flatnonzero((inside if rule.iou is None else iou >= rule.iou) & (confidence[p] >= rule.confidence))
            ps.append(p[ok])
            gs.append(g[ok])
        begin = end
    none = [np.empty(0, np.int64)]
    return [(np.concatenate(ps or none), np.concatenate(gs or none)) for ps, gs in out]


def matching_sizes(image: np.ndarray, p: np.ndarray, g: np.ndarray, images: int) -> np.ndarray:
    """Size of a maximum matching of each image's edges (prediction ``p``, true box ``g``, sorted by prediction).

    Images of few boxes are solved all at once: |P| - max over subsets S of P of (|S| - |N(S)|) (Koenig and Ore), the
    neighbours N as bit masks. Others go to augmenting paths.
    """
    size = np.zeros(images, np.int64)
    if not len(p):
        return size
    # Number the true boxes within their image's edges.
    order = np.lexsort((g, image))
    new_image = np.append(True, image[order][1:] != image[order][:-1])
    step = np.cumsum(np.append(True, (g[order][1:] != g[order][:-1]) | new_image[1:])) - 1
    starts = np.flatnonzero(new_image)
    local = np.empty(len(p), np.int64)
    local[order] = step - np.repeat(step[starts], np.diff(np.append(starts, len(p))))
    heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    owner = image[heads]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    n_pred = np.diff(np.append(first, len(owner)))
    most = np.zeros(images, np.int64)
    np.maximum.at(most, image, local)
    small = (n_pred <= MASK_PREDICTIONS) & (most[owner[first]] < MASK_TRUTH)
    mask = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), np.minimum(local, 63).astype(np.uint64)), heads)
    for n in np.unique(n_pred[small]):
        rows = first[small & (n_pred == n)]
        met = np.zeros((len(rows), 1), np.uint64)
        for k in range(n):  # neighbours of all subsets of the first k + 1 predictions
            met = np.concatenate([met, met | mask[rows + k, None]], axis=1)
        lacking = np.bitwise_count(np.arange(1 << n, dtype=np.uint64)).astype(np.int64) - np.bitwise_count(met)
        size[owner[rows]] = n - lacking.max(axis=1)
    for i in first[~small]:
        own = image == owner[i]
        size[owner[i]] = len(augmenting_match([(0, a, b) for a, b in zip(p[own].tolist(), g[own].tolist())]))
    return size


def count_matches(images: DataFrame, truth: DataFrame, predictions: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, gt_count, prediction_count, matched): one row per image, ``matched`` with the size of a maximum one-to-one
    matching under each of ``rules``. Images without boxes stay with zeros.

    All three tables meet in one grouping by image, whose lists are bounded by the boxes of a picture.
    """
    none = [F.lit(None).cast("double").alias(c) for c in (*_BOX, "confidence")]
    box = [F.col(c).cast("double").alias(c) for c in _BOX]
    sides = (
        images.select(*keys, F.lit(0).alias("__s"), *none)
        .unionByName(truth.select(*keys, F.lit(1).alias("__s"), *box, none[-1]))
        .unionByName(predictions.select(*keys, F.lit(2).alias("__s"), *box, F.col("confidence").cast("double").alias("confidence")))
    )
    whole = F.struct(*_BOX, "confidence")
    grouped = sides.groupBy(*keys).agg(F.collect_list(F.when(F.col("__s") == 1, whole)).alias("__g"), F.collect_list(F.when(F.col("__s") == 2, whole)).alias("__p"))
    schema = StructType([*[f for f in grouped.schema if f.name in keys], *_counted().fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_truth, truth_boxes = _lists(batch.column("__g"), _BOX)
            n_pred, pred_boxes = _lists(batch.column("__p"), (*_BOX, "confidence"))
            at = np.repeat(np.arange(batch.num_rows), n_pred)
            sizes = [matching_sizes(at[p], p, g, batch.num_rows) for p, g in _edges(n_truth, truth_boxes, n_pred, pred_boxes, rules)]
            matched = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(sizes, axis=1).ravel()), len(rules)).cast(pa.list_(pa.int64()))
            arrays = [*[batch.column(k) for k in keys], pa.array(n_truth), pa.array(n_pred), matched]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "gt_count", "prediction_count", "matched"])

    return grouped.mapInArrow(run, schema)


def _counted() -> StructType:
    return StructType([StructField("gt_count", LongType()), StructField("prediction_count", LongType()), StructField("matched", ArrayType(LongType()))])
