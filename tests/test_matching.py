import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import evaluation, matching

G, P = "image string, gt_id int, x1 double, y1 double, x2 double, y2 double", "image string, pred_id int, x1 double, y1 double, x2 double, y2 double, confidence double"
CASES = {
    "tight": ([(100, 100, 200, 200)], [(135, 135, 165, 165, 0.8)], [(0, 0)], []),
    "confidence": ([(100, 100, 200, 200)], [(130, 130, 150, 150, 0.4), (145, 145, 165, 165, 0.9)], [(1, 0)], None),
    "greedy": ([(0, 0, 3, 1), (0, 0, 2, 1)], [(0, 0, 3, 1, 0.9), (0, 0, 5, 1, 0.8)], None, [(0, 1), (1, 0)]),
    "overlap": ([(0, 0, 10, 10), (4, 0, 10, 10)], [(5, 4.9, 5.2, 5.1, 0.9), (1.9, 4.9, 2.1, 5.1, 0.8)], [(0, 1), (1, 0)], None),
    "none": ([(0, 0, 1, 1)], [(10, 10, 11, 11, 0.9)], [], []),
    "two predictions": ([(0, 0, 10, 10)], [(1, 1, 2, 2, 0.7), (3, 3, 4, 4, 0.9)], [(1, 0)], None),
    "two truths": ([(0, 0, 10, 10), (4, 0, 10, 10)], [(5, 4.9, 5.2, 5.1, 0.9)], [(0, 0)], None),
    "independent": ([(0, 0, 2, 2), (10, 10, 12, 12)], [(0, 0, 2, 2, 0.8), (10, 10, 12, 12, 0.7)], [(0, 0), (1, 1)], [(0, 0), (1, 1)]),
}


def tables(spark):
    g = [(k, i, *map(float, b)) for k, (gt, *_) in CASES.items() for i, b in enumerate(gt)]
    p = [(k, i, *map(float, b)) for k, (_, pr, *_) in CASES.items() for i, b in enumerate(pr)]
    return spark.createDataFrame(g, G), spark.createDataFrame(p, P)


def test_fixture_pairs(spark):
    gt, pred = tables(spark)
    for column, cand in ((2, matching.center_candidates(gt, pred, ["image"])), (3, matching.iou_candidates(gt, pred, ["image"], 0.5))):
        pairs = matching.match_pairs(cand, ["image"]).collect()
        counted = matching.count_matches(gt, gt, pred, ["image"], [matching.Rule() if column == 2 else matching.Rule(0.5)])
        counts = {r.image: r.matched[0] for r in counted.collect()}
        for name, case in CASES.items():
            if case[column] is not None:
                assert sorted((r.pred_id, r.gt_id) for r in pairs if r.image == name) == sorted(case[column]), name
                assert counts.get(name, 0) == len(case[column])


def brute(edges):
    preds = sorted({p for _, p, _ in edges})

    def best(i, used):
        if i == len(preds):
            return 0
        return max([best(i + 1, used)] + [1 + best(i + 1, used | {g}) for _, p, g in edges if p == preds[i] and g not in used])

    return best(0, frozenset())


def test_random_graphs_against_brute_force(spark, monkeypatch):
    random.seed(3)
    rows, want = [], {}
    for k in range(150):
        edges = [(r, random.randrange(6), random.randrange(6)) for r in range(random.randrange(1, 14))]
        edges = list({(p, g): (r, p, g) for r, p, g in edges}.values())
        want[k] = brute(edges)
        assert len(matching.augmenting_match(edges)) == want[k]
        rows += [(k, p, g, r) for r, p, g in edges]
    df = spark.createDataFrame(rows, "k int, pred_id int, gt_id int, rank int")
    pairs = matching.match_pairs(df, ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in pairs} == want
    for most in (matching.MASK_PREDICTIONS, 2):
        monkeypatch.setattr(matching, "MASK_PREDICTIONS", most)
        edges = np.array(sorted({(k, k * 10 + p, k * 10 + g) for k, p, g, _ in rows}))
        assert matching.matching_sizes(*edges.T, len(want)).tolist() == [want[k] for k in range(len(want))]


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_crowded_images_in_slices(spark, monkeypatch, pairs):
    monkeypatch.setattr(matching, "_PAIRS_AT_ONCE", pairs)
    n = 70  # more boxes than a mask has bits
    truth = spark.createDataFrame([("a", i, 10.0 * i, 0.0, 10.0 * i + 8, 8.0) for i in range(n)], G)
    pred = spark.createDataFrame([("a", i, 10.0 * (i // 2), 0.0, 10.0 * (i // 2) + 8, 8.0, 0.5 + 0.4 * (i % 2)) for i in range(n)] + [("b", 0, 0.0, 0.0, 1.0, 1.0, 0.5)], P)
    images = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "image string")
    rules = [matching.Rule(), matching.Rule(0.9), matching.Rule(0.9, 0.6)]
    got = {r.image: (r.gt_count, r.prediction_count, r.matched) for r in matching.count_matches(images, truth, pred, ["image"], rules).collect()}
    assert got == {"a": (n, n, [35, 35, 35]), "b": (0, 1, [0, 0, 0]), "c": (0, 0, [0, 0, 0]), None: (0, 0, [0, 0, 0])}
    assert matching.count_matches(images.limit(0), truth.limit(0), pred.limit(0), ["image"], rules).count() == 0


def test_suppression(spark):
    boxes = [("a", 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("a", 1, 1.0, 0.0, 11.0, 10.0, 0.8), ("a", 2, 2.0, 0.0, 12.0, 10.0, 0.7), ("b", 0, 0.0, 0.0, 0.0, 0.0, 0.9), ("b", 1, 0.0, 0.0, 0.0, 0.0, 0.9)]
    df = spark.createDataFrame(boxes, P)
    kept = lambda o: sorted((r.image, r.pred_id) for r in evaluation.suppress(df, ["image"], o).collect())
    assert kept(0.5) == [("a", 0), ("b", 0), ("b", 1)] and kept(0.7) == [("a", 0), ("a", 2), ("b", 0), ("b", 1)] and len(kept(0.9)) == 5


def test_density_groups(spark):
    rows = [("s", f"{i:06d}", i, i + 1, i - 1, max(0, i - 2)) for i in range(1, 10)]
    schema = "seq string, image string, gt_count bigint, prediction_count bigint, center_matched bigint, iou50_matched bigint"
    df = spark.createDataFrame(rows, schema)
    got = {r.density: r for r in evaluation.density_analysis(df, ["seq"], "image").collect()}
    assert [got[d].images for d in evaluation.TERCILES] == [3, 3, 3] and got["low"].gt_count == 6 and got["high"].gt_count == 24
    one = {r.density: r.images for r in evaluation.density_analysis(df.limit(1), ["seq"], "image").collect()}
    assert one == {"low": 0, "medium": 0, "high": 1}
    four = {r.density: r.images for r in evaluation.density_analysis(df.orderBy("image").limit(4), ["seq"], "image").collect()}
    assert four == {"low": 1, "medium": 1, "high": 2}


def test_macro_average_and_examples(spark):
    rows = [("s", f"{i:02d}", i % 5, 3, i % 3, i % 2, i % 5 - i % 3, 3 - i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "seq string, image string, gt_count bigint, prediction_count bigint, center_matched bigint, iou50_matched bigint, center_missed bigint, center_unmatched bigint")
    got = evaluation.example_frames(df, ["seq"], "image").collect()
    assert len(got) == 10 and len({r.image for r in got}) == 10
    m = spark.createDataFrame([("a", 0.8), ("b", 0.8)], "v string, precision double")
    assert evaluation.macro_average(m, ["precision"]).first().macro_precision == 0.8
    assert evaluation.macro_average(m.limit(0), ["precision"]).first().macro_precision == 0.0


def test_crowding_and_scale(spark):
    gt, _ = tables(spark)
    got = {(r.image, r.gt_id): r.neighbours for r in evaluation.crowding(gt, ["image"], 5.0).collect()}
    assert got["overlap", 0] == 1 and got["tight", 0] == 0
    scaled = evaluation.scale_terciles(gt, [], (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    n = gt.count()
    assert scaled.where("scale = 'small'").count() == n // 3
