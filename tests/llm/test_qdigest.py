import math
import random

import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import boxes, qdigest


def rank_errors(values, got, width=1.003):
    """How far each returned value's rank range lies from the asked rank, with the leaf's width allowed."""
    v = np.sort(np.asarray(values))
    for r in got:
        lo, hi = sorted((r.value / width, r.value * width)) if r.value else (-1e-12, 1e-12)
        first, last = np.searchsorted(v, lo, "left") + 1, np.searchsorted(v, hi, "right")
        want = max(1, math.ceil(r.p * len(v)))
        yield max(first - want, want - last, 0), r


def test_rank_bound_holds_for_any_merge_order(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(-4, 2, 6000), -rng.lognormal(-3, 1, 500), np.zeros(300), np.full(2500, 0.25), rng.uniform(300, 2000, 200)])
    rng.shuffle(values)
    rows = [(int(i % 7), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "day int, v double").withColumn("g", F.lit("a"))
    for k in (64, 800):
        daily = qdigest.build(df, ["g", "day"], "v", k)
        whole = qdigest.merge(daily, ["g"], k)
        assert whole.agg(F.sum("count")).first()[0] == len(values)
        assert whole.count() <= 3 * k + 2 * qdigest.LEVELS
        for how in (whole, qdigest.merge(daily.where("day < 3").unionByName(qdigest.merge(daily.where("day >= 3"), ["g"], k).withColumn("day", F.lit(9))), ["g"], k)):
            got = qdigest.quantiles(how, ["g"], [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], k).collect()
            assert len(got) == 7
            for error, r in rank_errors(values, got):
                assert error <= r.rank_error, (k, error, r)


def test_leaves_are_monotone_and_narrow(spark):
    values = sorted([0.0, 1e-300, 1e-12, 1e-3, 0.1, 0.100001, 0.5, 1.0, 1728.0, 1e30, math.inf, -0.1, -5.0, -math.inf])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", qdigest.leaf(F.col("v")).alias("l")).select("v", "l", qdigest.leaf_value(F.col("l")).alias("m")).orderBy("v").collect()
    leaves = [r.l for r in rows]
    assert leaves == sorted(leaves) and min(leaves) >= 0 and max(leaves) < 1 << qdigest.LEVELS
    for r in rows:
        if 1e-12 <= abs(r.v) <= 1e6:
            assert abs(r.m / r.v - 1) < 0.0014


def test_boxes_edge_cases(spark):
    schema = "box_id bigint, source_name string, split_name string, width double, height double, labelled_at timestamp, loaded_at timestamp, value double, measure string, node int"
    rows = [(1, "s", None, 0.5, 0.5), (1, "s", None, 0.5, 0.5), (2, None, "t", 0.25, 0.5), (3, "s", None, float("nan"), 0.5), (4, "s", None, None, 0.5), (None, "s", None, 0.1, 0.1), (5, "s", None, -0.5, 0.0), (6, "i", "t", float("inf"), 0.0)]
    df = spark.createDataFrame([(*r, None, None, 1.0, "x", 3) for r in rows], schema)
    got = {(r.measure, r.source_name, r.split_name): r.n for r in boxes.percentiles(df, [0.5]).collect()}
    assert got == {("width", "s", None): 2, ("area", "s", None): 2, ("width", None, "t"): 1, ("area", None, "t"): 1, ("width", "i", "t"): 1}
    assert boxes.percentiles(df.limit(0)).count() == 0


def test_stored_days_are_replaced_by_later_loads(spark, tmp_path):
    schema = "box_id bigint, source_name string, split_name string, width double, height double, labelled_at timestamp_ntz, loaded_at timestamp_ntz"
    rows = spark.range(60).selectExpr(
        "id box_id", "'s' source_name", "null split_name", "0.1D + id / 100D width", "0.5D height", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(int(id % 3)) labelled_at", "timestamp_ntz'2026-02-01 00:00:00' loaded_at"
    ).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")])
    late = rows.where("box_id % 3 = 1").unionByName(rows.where("box_id % 3 = 1 and box_id < 30").withColumn("box_id", F.col("box_id") + 1000))
    boxes.store_days(rows.where("box_id < 31"), str(tmp_path), 0)
    boxes.store_days(rows, str(tmp_path), 1)
    boxes.store_days(late, str(tmp_path), 2)  # one of the days once more, with ten boxes that came late
    got = {(r.measure, r.n) for r in boxes.stored_percentiles(spark, str(tmp_path), [0.5]).collect()}
    assert got == {("width", 70), ("area", 70)}
    check = boxes.rank_check(rows, [0.1, 0.5, 0.9]).collect()
    assert len(check) == 6 and all(r.within for r in check)


def test_small_groups_are_exact_to_a_leaf(spark):
    random.seed(4)
    values = [random.random() for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("g", F.lit(1))
    r = qdigest.quantiles(qdigest.build(df, ["g"], "v", 3200), ["g"], [0.5], 3200).first()
    assert abs(r.value / sorted(values)[50] - 1) < 0.0015
