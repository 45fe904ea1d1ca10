import math

import pytest
from pyspark.sql import functions as F

from trailmark.functions.numeric import float_value, general_format, half_even, whole_double
from trailmark.operators import labels

SCHEMA = "i int, line string, image_w int, image_h int"


def parse(spark, rows, **kw):
    df = spark.createDataFrame([(i, line, *(dims or (None, None))) for i, (line, dims) in enumerate(rows)], SCHEMA)
    return {r.i: r for r in labels.parse_labels(df, image_w="image_w", image_h="image_h", **kw).collect()}


def box_line(x1, y1, x2, y2):
    return f"0 {(x1 + x2) / 2!r} {(y1 + y2) / 2!r} {x2 - x1!r} {y2 - y1!r}"


def test_detection_lines_and_first_errors(spark):
    cases = [
        ("0 0.5 0.5 0.25 0.25", None, None),
        ("1 0.5 0.5 0.2 0.2", None, "class id must be 0"),
        ("a 0.5 0.5 0.2 0.2", None, "class id must be an integer"),
        ("0 0.5 0.5 x 0.2", None, "non-numeric"),
        ("0 0.95 0.5 0.2 0.2", None, "outside normalized image bounds"),
        ("0 nan 0.5 0.2 0.2", None, "x_center must be finite"),
        ("0 inf 0.5 0.2 0.2", (10, 10), "x_center must be finite"),
        ("0 0.5 1.5 0.2 0.2", None, "y_center must be normalized"),
        ("0 0.5 0.5 0 0.2", None, "greater than 0"),
        (box_line(0.2, 0.2, 1 + 0.49 / 400, 0.8), (400, 472), None),
        (box_line(0.2, 0.2, 1 + 0.51 / 400, 0.8), (400, 472), "more than 0.5 pixels"),
        (box_line(0.2, 0.2, 1 + 0.49 / 400, 0.8), None, "outside normalized image bounds"),
        ("0 0.5 0.5 0.2 0.2", (400, None), "provided together"),
        ("0 1d 0.5 0.2 0.2", None, "non-numeric"),
        ("0 0.5 0.5 0.2", None, "must contain 5 values; found 4"),
        ("0 .1 .1 .2 .2 .3 .3", None, "must contain 5 values; found 7"),
    ]
    got = parse(spark, [c[:2] for c in cases], polygons=False)
    for i, (line, _, error) in enumerate(cases):
        assert (got[i].error is None) == (error is None), (line, got[i].error)
        assert error is None or error in got[i].error, (line, got[i].error)


def test_polygons(spark):
    got = parse(
        spark,
        [
            ("0 0.10 0.20 0.40 0.20 0.40 0.60 0.10 0.60", None),
            ("0 0.2 0.3 0.5 0.4 0.4 0.7", None),
            ("0 0.2 0.3 0.5 0.4 0.4 0.7 0.1", None),
            ("0 0.2 0.3 1.5 0.4 0.4 0.7", None),
            ("0 0.2 0.2 0.4 0.4 0.6 0.6", None),
            ("0 0.2 0.3 0.9", None),
            (f"0 0.2 0.2 {1 + 0.005 / 400!r} 0.2 {1 + 0.005 / 400!r} 0.6 0.2 0.6", (400, 472)),
            ("0 0.2 nan 0.5 0.4 0.4 0.7", None),
            ("   ", None),
        ],
    )
    assert [round(got[0][f], 12) for f in labels.FIELDS] == [0.25, 0.4, 0.3, 0.4] and got[0].format == "segmentation"
    assert [got[1][f] for f in labels.FIELDS] == [0.35, 0.5, 0.3, 0.39999999999999997]
    assert "must be even" in got[2].error and "point 2 x must be normalized" in got[3].error and "degenerate" in got[4].error
    assert "must be even" in got[5].error
    assert got[6].error is None and got[6].width == pytest.approx(0.8 + 0.005 / 400, abs=1e-12)
    assert "point 1 y must be finite" in got[7].error
    assert 8 not in got


def test_policies_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1, "0 .5 .5 .2 .2"), ("a", 2, "bad"), ("a", 3, "1 .5 .5 .2 .2"), ("b", 1, "0 .5 .5 .2 .2"), ("b", 2, " 0 .5 .5 .2 .2 "), ("b", 3, "")], "file string, line_no int, line string")
    parsed = labels.parse_labels(df, polygons=False)
    assert labels.all_errors(parsed).count() == 2
    assert [(r.file, r.line_no) for r in labels.first_errors(parsed, "file").collect()] == [("a", 2)]
    counts = {r.file: (r.detections, r.invalid_lines, r.clean) for r in labels.file_counts(parsed, "file").collect()}
    assert counts == {"a": (1, 2, False), "b": (2, 0, True)}
    assert [(r.file, r.copies, r.extra_rows) for r in labels.duplicate_rows(df, "file").collect()] == [("b", 2, 1)]


def test_numbers_like_python(spark):
    texts = ["1", "1.", ".5", "+1e3", "1_0", "1__0", "1d", "1f", "0x1", "nan", "-Infinity", "1e400", "", "٣"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", float_value(F.col("t")).alias("v")).collect()
    for r in rows:
        try:
            want = float(r.t) if r.t.isascii() else None
        except ValueError:
            want = None
        assert r.v == want or (want is not None and math.isnan(want) and math.isnan(r.v)), r


def test_rounding_and_format(spark):
    values = [0.5, 1.5, 2.5, -0.5, 1e-5, 123456789012345.0, 0.1, 1 / 3, 1.0, 0.0, 1e-4, 0.000123456789012345, 100.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_even(F.col("v")).alias("r"), general_format(F.col("v")).alias("t"), whole_double(F.col("v")).alias("w")).collect()
    for r in rows:
        assert r.r == round(r.v)
        assert r.t == f"{r.v:.12g}", r
        assert r.w == (int(r.v) if r.v == int(r.v) else None)
