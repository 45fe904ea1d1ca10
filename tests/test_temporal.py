import pytest
from pyspark.sql import functions as F

from trailmark.operators import motion, statistics, temporal


def split(spark, n, fraction, gap, ts=None):
    rows = [("v", f"f{i + 1}", float(t)) for i, t in enumerate(ts or range(1, n + 1))]
    df = spark.createDataFrame(rows, "v string, f string, ts double")
    got = temporal.temporal_split(df, ["v"], ["ts", "f"], fraction, gap).orderBy("ts").collect()
    return {p: [r.f for r in got if r.part == p] for p in ("train", "gap", "val")}


def test_splits(spark):
    assert split(spark, 5, 0.6, 0, [3, 1, 2, 4, 5]) == {"train": ["f2", "f3", "f1"], "gap": [], "val": ["f4", "f5"]}
    assert split(spark, 6, 0.67, 1) == {"train": ["f1", "f2", "f3", "f4"], "gap": ["f5"], "val": ["f6"]}
    assert split(spark, 1, 0.5, 2)["train"] == ["f1"]
    assert split(spark, 2, 0.5, 3) == {"train": ["f1"], "gap": [], "val": ["f2"]}
    with pytest.raises(ValueError):
        split(spark, 3, 1.0, 0)


def test_split_against_restatement(spark):
    for n in range(1, 11):
        for fraction in (0.3, 0.5, 0.67, 0.9):
            for gap in (0, 1, 2, 5):
                names = [f"f{i + 1}" for i in range(n)]
                if n == 1:
                    want = (names, [], [])
                else:
                    cut = max(1, min(n - 1, round(n * fraction)))
                    if gap and n > 2:
                        g = min(gap, n - 2)
                        te = max(1, cut - g // 2)
                        vs = min(n - 1, te + g)
                        want = (names[:te], names[te:vs], names[vs:])
                    else:
                        want = (names[:cut], [], names[cut:])
                if (n, gap) in ((4, 2), (7, 5), (10, 1), (3, 1), (1, 0), (2, 2)):
                    got = split(spark, n, fraction, gap)
                    assert (got["train"], got["gap"], got["val"]) == want, (n, fraction, gap)


def test_positions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("p")).first().p
    assert get(temporal.fixed_positions(F.lit(10).cast("bigint"), 4)) == [0, 3, 6, 9]
    p = get(temporal.fixed_positions(F.lit(306).cast("bigint"), 20))
    assert p[:3] == [0, 16, 32] and 144 in p and 161 in p and p[-1] == 305 and len(p) == 20
    assert get(temporal.fixed_positions(F.lit(1).cast("bigint"), 4)) == [0] and get(temporal.fixed_positions(F.lit(0).cast("bigint"), 4)) == []
    frames = spark.createDataFrame([(0, i) for i in range(30)], "s int, frame_index int")
    assert temporal.sample_interval(frames, temporal.every_frames(10, 0.5)).count() == 6
    assert temporal.sample_interval(frames.limit(12), 4).count() == 3


def test_names(spark):
    df = spark.createDataFrame([("nest_frame_000007_t0000-234_jpg.rf.x.jpg",), ("x.jpg",), ("a_frame_000012_t0001.500.jpg",)], "n string")
    rows = df.select(temporal.name_frame(F.col("n")).alias("f"), temporal.name_timestamp(F.col("n")).alias("t")).collect()
    assert [(r.f, r.t) for r in rows] == [(7, 0.234), (None, None), (12, 1.5)]
    made = spark.range(1).select(temporal.frame_name(F.lit("source"), F.lit(0), F.lit(0.0)).alias("a"), temporal.sequence_name(F.lit(3)).alias("b")).first()
    assert made.a == "source_frame_000000_t0000.000.jpg" and made.b == "000003.jpg"


def test_motion_summary(spark):
    schema = "stream int, frame_index int, seconds double, score double, regions int"
    df = spark.createDataFrame([(1, 0, 0.0, 0.1, 2), (1, 1, 0.1, 0.5, 4), (1, 2, 0.2, 0.0, 0), (2, 0, 0.0, 0.9, 3)], schema)
    got = {r.stream: r for r in motion.motion_summary(motion.with_warmup(df, 0), "stream").collect()}
    r = got[1]
    assert (r.processed_frames, r.average_score, r.max_score, r.peak_seconds, r.average_regions, r.max_regions) == (3, 0.2, 0.5, 0.1, 2.0, 4)
    warm = {r.stream: r for r in motion.motion_summary(motion.with_warmup(df, 5), "stream").collect()}[2]
    assert (warm.scored_frames, warm.max_score, warm.peak_seconds, warm.max_regions) == (0, 0.0, 0.0, 0)


def test_statistics_fixture(spark):
    images = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "c")], "split string, image string")
    boxes = spark.createDataFrame([("a", 0.25, 0.25), ("c", 0.2, 0.1)], "image string, width double, height double")
    got = {r.split: (r.images, r.annotations, r.images_without) for r in statistics.split_statistics(images, boxes, "split", "image").collect()}
    assert got == {"train": (2, 1, 1), "val": (1, 1, 0)}
    s = statistics.size_percentiles(boxes, []).first()
    assert [round(x, 6) for x in (s.median_width, s.median_height, s.median_area, s.p25_area, s.p75_area)] == [0.225, 0.175, 0.04125, 0.030625, 0.051875]


def test_motion_pieces(spark):
    row = spark.range(1).select(
        motion.activity_score(F.lit(10), F.lit(100)).alias("a"), motion.activity_score(F.lit(0), F.lit(0)).alias("z"), motion.min_motion_area(F.lit(1920 * 1080), F.lit(0.0001)).alias("m"),
        motion.to_global(F.lit(1.5), F.lit(2.5), F.lit(0.5), F.lit(3.5), F.lit(0), F.lit(0)).alias("g"),
    ).first()
    assert row.a == 0.1 and row.z == 0.0 and row.m == pytest.approx(207.36) and tuple(row.g) == (2, 2, 0, 4)
