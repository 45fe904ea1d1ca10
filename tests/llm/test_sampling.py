import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import sampling
from trailmark.llm.rounding import controlled_rounding


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 8), st.integers(0, 10**6))
def test_controlled_rounding_keeps_margins(rows, columns, seed):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 40, (rows, columns)) / rng.choice([1, 2, 3, 8])
    got = controlled_rounding(table)
    up = lambda x, y: bool(np.all((np.floor(x + 1e-7) <= y) & (y <= np.ceil(x - 1e-7))))
    assert up(table, got) and up(table.sum(0), got.sum(0)) and up(table.sum(1), got.sum(1)) and up(table.sum(), got.sum())


def test_totals_and_spread():
    got = sampling.group_totals(100, np.array([0.5, 0.48, 0.02]), np.array([5, 5, 10]))
    assert got.sum() == 100 and got[2] == 10 and abs(got[0] - 46) <= 1
    assert list(sampling.spread_evenly(10, np.array([1, 100, 0, 100]))) == [1, 4.5, 0, 4.5]
    assert sampling.spread_evenly(10, np.array([2, 3])).sum() == 5


SCHEMA = "image_id bigint, subdomain_group string, video_filename string, temporal_bin int, target_bins_for_video int, quota string, g int, key int"


def manifest(spark, rows):
    return spark.createDataFrame([(*r, "q", 1, 2) for r in rows], SCHEMA)


def test_shares_quotas_and_report(spark):
    rows, i = [], 0
    for group, videos, per in (("a", 10, 40), ("B ", 5, 20), ("c-d", 1, 3)):
        for v in range(videos):
            for f in range(per):
                rows.append((i, group, f"dir/{group.strip()}{v}.MP4", f % 4, 4))
                i += 1
    rows += [(0, "a", "dir/a0.MP4", 0, 4), (None, "a", "x", 0, 4), (5000, None, None, None, None), (5001, "a", None, 2, 4), (5002, "a", "dir/a0.mp4", 99, None), (5003, "a", "dir/a0.mp4", -1, 3)]
    targets = spark.createDataFrame([("a", 0.5, 5), ("b", 0.4, 5), ("C_D", 0.1, 10), ("none", 0.0, 4)], "subdomain_group string, target_share double, min_images int")
    got = sampling.stratified_sample(manifest(spark, rows), targets, size=100)
    sample = got.sample.collect()
    assert len({r.image_id for r in sample}) == len(sample)
    groups = {r.subdomain_group: r for r in got.groups.collect()}
    assert (groups["a"].quota, groups["a"].taken) == (50, 50) and groups["b"].taken == 40 and (groups["c_d"].quota, groups["c_d"].supply, groups["c_d"].taken, groups["c_d"].missing) == (10, 3, 3, 7)
    bins = [r.temporal_bin for r in sample if r.subdomain_group == "a"]
    assert None not in bins and all(abs(bins.count(b) - 12.5) <= 1 for b in range(4))
    per_cell: dict = {}
    for r in sample:
        per_cell[r.video, r.temporal_bin] = per_cell.get((r.video, r.temporal_bin), 0) + 1
    assert max(n for (v, _), n in per_cell.items() if v.startswith("a")) <= 2  # 50 images over 40 video bins
    again = {r.image_id for r in sampling.stratified_sample(manifest(spark, rows), targets, size=100).sample.collect()}
    assert again == {r.image_id for r in sample}


def test_empty_bins_and_plans(spark):
    rows = [(1, "a", "v.mp4", 0, 2), (2, "a", "V.MP4 ", 2, 4), (3, "a", "w.mp4", None, None), (4, "a", "x.mp4", 7, -3), (5, "a", None, 1, 9), (6, "a", "y.mp4", 0, 5000)]
    targets = spark.createDataFrame([("a", 1.0, 1)], "subdomain_group string, target_share double, min_images int")
    bins = sampling.stratified_sample(manifest(spark, rows), targets, size=2).bins
    empty = {(r.video, r.temporal_bin) for r in bins.where("state = 'empty'").collect()}
    assert empty == {("v.mp4", 1), ("v.mp4", 3)} | {("y.mp4", b) for b in range(1, 5000)}


@pytest.mark.parametrize("which", ["manifest", "targets", "both"])
def test_empty_tables(spark, which):
    targets = spark.createDataFrame([("a", 1.0, 1)], "subdomain_group string, target_share double, min_images int")
    rows = manifest(spark, [(1, "a", "v", 0, 1)])
    got = sampling.stratified_sample(rows.limit(0) if which != "targets" else rows, targets.limit(0) if which != "manifest" else targets, size=3)
    assert got.sample.count() == 0 and got.groups.count() == (1 if which == "manifest" else 0)
    assert got.bins.count() == (1 if which == "targets" else 0)


def test_thousands_of_bins(spark):
    rows = [(i, "ab"[i % 2], f"v{i % 4}.mp4", i // 4, 3000) for i in range(12_000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "subdomain_group string, target_share double, min_images int")
    got = sampling.stratified_sample(manifest(spark, rows), targets, size=7500)
    per = {(r.subdomain_group, r.temporal_bin): r["count"] for r in got.sample.groupBy("subdomain_group", "temporal_bin").count().collect()}
    assert len(per) == 6000 and set(per.values()) == {1, 2} and sum(per.values()) == 7500
    assert got.quotas.where("abs(quota - fraction) >= 1").count() == 0 and got.quotas.count() == 6000
