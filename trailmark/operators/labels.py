"""Parsing and validation of box and polygon label lines, each line with its first error.

All lines are parsed once; the policies of the different readers are views over that result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.geometry import shoelace
from trailmark.functions.numeric import first_error, fixed_columns, float_value, integer_value, is_finite, is_integer_text

#: Tolerance of normalized bounds, of image bounds in pixels, and the area of a degenerate polygon.
BOUNDS_TOLERANCE = 1e-9
PIXEL_TOLERANCE = 0.5
AREA_TOLERANCE = 1e-12
FIELDS = ("x_center", "y_center", "width", "height")
#: What the errors say.
COUNT = "must contain 5 values; found %d."
NOT_INTEGER = "class id must be an integer."
NOT_ZERO = "class id must be 0 for 'ant'."
NOT_NUMERIC = "contains non-numeric coordinate values."
FINITE = "must be finite."
NORMALIZED = "must be normalized between 0 and 1."
NO_SIZE = "width and height must be greater than 0."
ONE_DIMENSION = "image_width and image_height must be provided together."
BAD_DIMENSION = "image dimensions must be greater than 0."
OUTSIDE = "bounding box extends outside normalized image bounds."
OUTSIDE_PIXELS = "bounding box exceeds image bounds by more than {:g} pixels."
ODD = "segmentation coordinate count must be even."
FEW_POINTS = "segmentation polygon must contain at least 3 points."
DEGENERATE = "segmentation polygon is degenerate."
POINT = "segmentation point %d {} {}"


def box_error(class_id: Column, box: dict[str, Column], image_w: Column, image_h: Column, tolerance: float = PIXEL_TOLERANCE) -> Column:
    """First broken rule of a centre box; with image dimensions the edges are judged in pixels."""
    no_dims = image_w.isNull() & image_h.isNull()
    rules: list = [(class_id != 0, NOT_ZERO)]
    for name in FIELDS:
        v = box[name]
        rules.append((~is_finite(v), f"{name} {FINITE}"))
        rules.append((no_dims & ((v < -BOUNDS_TOLERANCE) | (v > 1.0 + BOUNDS_TOLERANCE)), f"{name} {NORMALIZED}"))
    left, right = box["x_center"] - box["width"] / 2, box["x_center"] + box["width"] / 2
    top, bottom = box["y_center"] - box["height"] / 2, box["y_center"] + box["height"] / 2
    over = F.greatest(-left * image_w, (right - 1.0) * image_w, -top * image_h, (bottom - 1.0) * image_h)
    outside = (F.least(left, top) < -BOUNDS_TOLERANCE) | (F.greatest(right, bottom) > 1.0 + BOUNDS_TOLERANCE)
    rules += [
        ((box["width"] <= 0) | (box["height"] <= 0), NO_SIZE),
        (image_w.isNull() != image_h.isNull(), ONE_DIMENSION),
        ((image_w <= 0) | (image_h <= 0), BAD_DIMENSION),
        (over > tolerance + 1e-12, OUTSIDE_PIXELS.format(tolerance)),
        (no_dims & outside, OUTSIDE),
    ]
    return first_error(*rules)


def _with_polygons(rows: DataFrame, n: Column, w: Column, h: Column) -> DataFrame:
    """Add a polygon's hull to ``__b``, its first point error and its area; other lines make no arrays here."""
    good = (n % 2 == 1) & (n >= 7) & F.col("__numeric")
    at = F.when(good, F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int") - 1))
    xs, ys = F.transform(at, lambda i: F.get("__v", i * 2)), F.transform(at, lambda i: F.get("__v", i * 2 + 1))
    rows = fixed_columns(rows, {"__x": xs, "__y": ys})
    reach_x, reach_y = (F.coalesce(F.lit(PIXEL_TOLERANCE) / d, F.lit(BOUNDS_TOLERANCE)) for d in (w, h))
    out = lambda v, r: ~is_finite(v) | (v < -r) | (v > 1.0 + r)

    def point_error(x: Column, y: Column, i: Column) -> Column:
        name = lambda axis, text: F.format_string(POINT.format(axis, text), i + 1)
        return first_error(
            (~is_finite(x), name("x", FINITE)), (~is_finite(y), name("y", FINITE)), (out(x, reach_x), name("x", NORMALIZED)), (out(y, reach_y), name("y", NORMALIZED))
        )

    low_x, high_x, low_y, high_y = F.array_min("__x"), F.array_max("__x"), F.array_min("__y"), F.array_max("__y")
    hull = F.struct(
        ((low_x + high_x) / 2).alias("x_center"), ((low_y + high_y) / 2).alias("y_center"), (high_x - low_x).alias("width"), (high_y - low_y).alias("height")
    )
    # The extremes tell whether any point is out (NaN counts as largest); only then is the first one looked for.
    some_bad = out(low_x, reach_x) | out(high_x, reach_x) | out(low_y, reach_y) | out(high_y, reach_y)
    each = F.transform("__x", lambda x, i: F.struct(x.alias("x"), F.get("__y", i).alias("y"), i.alias("i")))
    first = F.get(F.filter(each, lambda p: out(p.x, reach_x) | out(p.y, reach_y)), F.lit(0))
    rows = fixed_columns(rows, {"__first": F.when(some_bad, first), "__hull": F.when(good, hull), "__area": F.when(good, F.abs(shoelace(F.col("__x"), F.col("__y"))))})
    point = F.when(F.col("__first").isNotNull(), point_error(F.col("__first.x"), F.col("__first.y"), F.col("__first.i")))
    return fixed_columns(rows, {"__point": point, "__b": F.coalesce("__b", "__hull")})


def _polygon_error(class_id: Column, n: Column, w: Column, h: Column) -> Column:
    return F.coalesce(
        first_error(
            (~F.col("__int"), NOT_INTEGER),
            (class_id != 0, NOT_ZERO),
            (n % 2 == 0, ODD),
            (n < 7, FEW_POINTS),
            (~F.col("__numeric"), NOT_NUMERIC),
            (w.isNull() != h.isNull(), ONE_DIMENSION),
            ((w <= 0) | (h <= 0), BAD_DIMENSION),
        ),
        F.col("__point"),
        first_error((F.col("__area") <= AREA_TOLERANCE, DEGENERATE)),
        box_error(class_id, {k: F.col(f"__b.{k}") for k in FIELDS}, w, h),
    )


def parse_labels(lines: DataFrame, polygons: bool = True, line: str = "line", image_w: str | None = None, image_h: str | None = None) -> DataFrame:
    """Add ``format``, ``class_id``, the box fields and ``error`` to label lines; blank and null lines are left out.

    A line of five tokens is a detection, any other a polygon if ``polygons``, else an error. Box fields are
    null where there is an error.
    """
    w = F.col(image_w).cast("double") if image_w else F.lit(None).cast("double")
    h = F.col(image_h).cast("double") if image_h else F.lit(None).cast("double")
    rows = lines.where(F.trim(F.regexp_replace(line, r"\s", " ")) != "")
    rows = fixed_columns(rows, {"__t": F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+"), "__w": w, "__h": h})
    first = F.get("__t", F.lit(0))
    values = F.transform(F.slice("__t", F.lit(2), F.greatest(F.size("__t") - 1, F.lit(0))), float_value)
    rows = fixed_columns(rows, {"__n": F.size("__t"), "__class": integer_value(first), "__int": is_integer_text(first), "__v": values})
    n, w, h = F.col("__n"), F.col("__w"), F.col("__h")
    class_id = F.coalesce("__class", F.when(F.col("__int"), F.lit(-1)))  # beyond 64 bits: an integer, not 0
    is_box = n == 5
    numeric = ~F.exists("__v", lambda v: v.isNull())
    own = F.struct(*[F.get("__v", F.lit(i)).alias(name) for i, name in enumerate(FIELDS)])
    rows = fixed_columns(rows, {"__numeric": numeric, "__b": F.when(is_box, own)})
    numeric = F.col("__numeric")
    if polygons:
        rows = _with_polygons(rows, n, w, h)

    detection = F.coalesce(
        first_error(
            (n != 5, F.format_string(COUNT, n)),
            (~F.col("__int"), NOT_INTEGER),
            (~numeric, NOT_NUMERIC),
        ),
        box_error(class_id, {k: F.col(f"__b.{k}") for k in FIELDS}, w, h),
    )
    kind, error = F.lit("detection"), detection
    if polygons:
        kind = F.when(is_box, "detection").otherwise("segmentation")
        error = F.when(is_box, detection).otherwise(_polygon_error(class_id, n, w, h))
    rows = fixed_columns(rows, {"format": kind, "error": error})
    fields = [F.when(F.col("error").isNull(), F.col(f"__b.{k}")).alias(k) for k in FIELDS]
    taken = {"format", "error", "class_id", *FIELDS}
    keep = [c for c in lines.columns if c not in taken]
    return rows.select(*keep, "format", F.col("__class").alias("class_id"), *fields, "error")


def all_errors(parsed: DataFrame) -> DataFrame:
    """Reading that keeps good lines and reports every bad one."""
    return parsed.where(F.col("error").isNotNull())


def all_valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull())


def first_errors(parsed: DataFrame, file: str, line_no: str = "line_no") -> DataFrame:
    """Reading that stops at a file's first bad line: (file, line_no, error)."""
    bad = F.min(F.struct(F.col(line_no).alias("line_no"), "error"))
    return all_errors(parsed).groupBy(file).agg(bad.alias("b")).select(file, "b.line_no", "b.error")


def file_counts(parsed: DataFrame, file: str) -> DataFrame:
    """Per file: lines by format that are valid, invalid lines, distinct raw class ids, and whether a fail-first reader keeps it."""
    ok = F.col("error").isNull()
    return parsed.groupBy(file).agg(
        F.count_if(ok & (F.col("format") == "detection")).alias("detections"),
        F.count_if(ok & (F.col("format") == "segmentation")).alias("polygons"),
        F.count_if(~ok).alias("invalid_lines"),
        F.count_distinct("class_id").alias("class_ids"),
        F.bool_and(ok).alias("clean"),
    )


def class_ids(parsed: DataFrame) -> DataFrame:
    """(class_id, lines): every class id that any line names, valid or not."""
    return parsed.where(F.col("class_id").isNotNull()).groupBy("class_id").agg(F.count("*").alias("lines"))


def split_counters(records: DataFrame, parsed: DataFrame, split: str, file: str) -> DataFrame:
    """Per split of ``records`` (a row per image with a label file): images, those with any label line, valid or not, those
    without, annotations by format and invalid lines."""
    counts = file_counts(parsed, file)
    rows = records.select(split, file).join(counts, file, "left")
    zero = F.lit(0).cast("bigint")
    return rows.groupBy(split).agg(
        F.count("*").alias("images"), F.count("clean").alias("labelled"), F.count_if(F.col("clean").isNull()).alias("unlabelled"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("detections", "polygons", "invalid_lines")],
    )


def duplicate_rows(lines: DataFrame, file: str, line: str = "line") -> DataFrame:
    """Label lines that stand more than once in a file, blanks around them aside: (file, line, copies, extra_rows)."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    rows = lines.select(file, text.alias("line")).where(F.col("line") != "")
    counts = rows.groupBy(file, "line").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    return counts.withColumn("extra_rows", F.col("copies") - 1)


def format_label(class_id: Column, box: dict[str, Column]) -> Column:
    """A label line with 12 significant digits."""
    from trailmark.functions.numeric import general_format

    return F.concat_ws(" ", class_id.cast("string"), *[general_format(box[k]) for k in FIELDS])
