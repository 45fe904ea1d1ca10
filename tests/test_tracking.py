from pyspark.sql import functions as F

from trailmark.operators import tracking


def test_lines(spark):
    cases = [
        ("4,2,31.5,7.25,12,9,1", None),
        ("4,2,31.5,7.25,12,9", "exactly 7"),
        ("4,2,left,7.25,12,9,1", "x must be numeric"),
        ("0,2,31.5,7.25,12,9,1", "frame must be greater than or equal to 1"),
        ("4,2,1,1,0,9,1", "width must be greater than 0"),
        ("4,2,1,1,12,0,1", "height must be greater than 0"),
        ("4.5,2,1,1,12,9,1", "frame must be an integer"),
        ("4.0,2,1,1,12,9,1", None),
        ("4,inf,1,1,12,9,1", "track_id must be finite"),
    ]
    df = spark.createDataFrame(list(enumerate([c[0] for c in cases] + ["", None])), "i int, line string")
    got = {r.i: r for r in tracking.parse_ground_truth(df).collect()}
    assert len(got) == len(cases)
    for i, (_, error) in enumerate(cases):
        assert (got[i].error is None) == (error is None) and (error is None or error in got[i].error)


def test_normalized_and_summary(spark):
    df = spark.createDataFrame([("s", 1, 7, 100.0, 50.0, 200.0, 100.0, 1), ("s", 3, 7, 900.0, 50.0, 200.0, 100.0, 0), ("s", 3, 7, 1.0, 1.0, 2.0, 2.0, 1)], "seq string, frame bigint, track_id bigint, x double, y double, width double, height double, flag bigint")
    rows = tracking.to_normalized(df, F.lit(1000), F.lit(500)).collect()
    assert (rows[0].norm_x_center, rows[0].norm_y_center, rows[0].norm_width, rows[0].norm_height) == (0.2, 0.2, 0.2, 0.2)
    assert "outside image" in rows[1].error
    s = tracking.sequence_summary(df, "seq").first()
    assert (s.annotations, s.tracks, s.first_frame, s.last_frame, s.flags) == (3, 1, 1, 3, "0,1")
    assert [(r.frame, r.copies) for r in tracking.duplicate_tracks(df, "seq").collect()] == [(3, 2)]
    assert [r.frame for r in tracking.frame_gaps(df, "seq").collect()] == [2]
