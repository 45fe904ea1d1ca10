"""Queries of the table operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.geometry import pixel_corners, roi_within_error
from trailmark.functions.hashing import hash64, name_key, sha_key, video_key
from trailmark.operators import evaluation, identity, labels, matching, motion, statistics, temporal, tracking
from trailmark.plans import adapters, pipelines, provenance
from trailmark.plans.pipelines import roi_from_text
from trailmark.session import read_table, scratch_path, spread
from trailmark.sources import files
from trailmark.sources.files import SequenceInfo
from trailmark.streaming.motion import activity_windows, detection_totals, running_summary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# Motion and sampling --------------------------------------------------------------------------------------------------

_FRAMES = """frames AS (SELECT user_id % 8 AS stream, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS frame_index,
    (row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1) / 30 AS seconds, least(1.0, greatest(0.0, value / 500)) AS score,
    CAST(json_extract_string(props, '$.k') AS INT) % 10 AS regions FROM events)"""


@query(
    f"""WITH {_FRAMES}, s AS (SELECT *, frame_index >= 25 AS scored FROM frames)
    SELECT stream, count(*) AS processed_frames, count(*) FILTER (NOT scored) AS warmup_frames, count(*) FILTER (scored) AS scored_frames,
    round(coalesce(avg(score) FILTER (scored), 0), 6) AS average_score, round(coalesce(max(score) FILTER (scored), 0), 6) AS max_score,
    round(coalesce(avg(regions) FILTER (scored), 0), 6) AS average_regions, coalesce(max(regions) FILTER (scored), 0) AS max_regions,
    round(CASE WHEN max(score) FILTER (scored) > 0 THEN arg_max(seconds, score * 1e9 - frame_index) FILTER (scored) ELSE 0 END, 6) AS peak_seconds FROM s GROUP BY stream"""
)
def motion_summary(spark: SparkSession, folder: str) -> DataFrame:
    return motion.motion_summary(motion.with_warmup(adapters.frames(spark, folder), 25), "stream")


@query(f"WITH {_FRAMES} SELECT stream, frame_index FROM frames WHERE frame_index % 15 = 0")
def sample_interval(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.sample_interval(adapters.frames(spark, folder), temporal.every_frames(30.0, 0.5)).select("stream", "frame_index")


def _sampled(positions: str) -> str:
    return f"WITH {_FRAMES}, t AS (SELECT stream, count(*) AS n FROM frames GROUP BY stream) SELECT DISTINCT stream, unnest({positions})::BIGINT AS frame_index FROM t"


@query(_sampled("list_transform(range(0, least(20, n)), lambda i: round_even(i * (n - 1) / (least(20, n) - 1), 0))"))
def sample_fixed_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.frames(spark, folder)
    return temporal.sample_positions(rows, "stream", lambda n: temporal.fixed_positions(n, 20)).select("stream", "frame_index")


@query(_sampled("list_transform(range(0, 12), lambda i: round_even((floor(i * n / 12) + floor((i + 1) * n / 12) - 1) / 2, 0))"))
def sample_bin_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.frames(spark, folder)
    return temporal.sample_positions(rows, "stream", lambda n: temporal.bin_middles(n, 12)).select("stream", "frame_index")


@query(_sampled("list_transform(range(0, 30), lambda i: floor((i + 0.5) * n / 30))"))
def sample_bin_center(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.frames(spark, folder)
    return temporal.sample_positions(rows, "stream", lambda n: temporal.bin_centers(n, 30)).select("stream", "frame_index")


_IMAGES = "images AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY loaded_at) AS copy FROM frame_manifest) WHERE copy = 1)"
_BLANK = "' ' || chr(9) || chr(13)"
_VIDEO = f"nullif(lower(trim(regexp_extract(video_filename, '[^/]*$'), {_BLANK})), '')"


def _split_sql(gap: int, tail: str) -> str:
    return f"""WITH {_IMAGES}, e AS (SELECT image_id, {_VIDEO} AS video, source_frame_index, timestamp_seconds FROM images WHERE lower(trim(split_name, {_BLANK})) IN ('train', 'valid')),
    o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY timestamp_seconds, source_frame_index, image_id) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM e),
    c AS (SELECT *, greatest(1, least(n - 1, round_even(n * 0.7::DOUBLE, 0)))::BIGINT AS cut, CASE WHEN {gap} > 0 AND n > 2 THEN least({gap}, n - 2) ELSE 0 END AS g FROM o),
    b AS (SELECT *, CASE WHEN g > 0 THEN greatest(1, cut - g // 2) ELSE cut END AS te FROM c),
    s AS (SELECT *, CASE WHEN n = 1 OR i < te THEN 'train' WHEN i < CASE WHEN g > 0 THEN least(n - 1, te + g) ELSE cut END THEN 'gap' ELSE 'val' END AS part FROM b) {tail}"""


def _split(spark: SparkSession, folder: str, gap: int) -> DataFrame:
    rows = adapters.distinct_images(spark, folder).withColumn("video", video_key(F.col("video_filename"))).withColumn("split_name", name_key(F.col("split_name")))
    rows = temporal.eligible(rows).select("image_id", "video", "source_frame_index", "timestamp_seconds")
    return temporal.temporal_split(rows, ["video"], ["timestamp_seconds", "source_frame_index", "image_id"], 0.7, gap)


@query(_split_sql(0, "SELECT image_id, video, part FROM s"))
def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, 0).select("image_id", "video", "part")


@query(_split_sql(3, "SELECT image_id, video, part FROM s"))
def temporal_split_gap(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, 3).select("image_id", "video", "part")


@query(
    _split_sql(
        2,
        """SELECT video, part, count(*) AS "rows", min(timestamp_seconds) AS first_seconds, max(timestamp_seconds) AS last_seconds,
        arg_min(source_frame_index, (timestamp_seconds, source_frame_index)) AS first_frame, arg_max(source_frame_index, (timestamp_seconds, source_frame_index)) AS last_frame FROM s GROUP BY video, part""",
    )
)
def split_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.part_ranges(_split(spark, folder, 2), ["video"], "source_frame_index", "timestamp_seconds")


_NAMED = f"""named AS (SELECT image_id, printf('%s_frame_%06d_t%08.3f', regexp_replace({_VIDEO}, '\\.[^.]*$', ''), source_frame_index, timestamp_seconds) || '.jpg' AS name FROM images)"""


@query(
    f"""WITH {_IMAGES}, {_NAMED} SELECT image_id, name, nullif(regexp_extract(name, '_frame_(\\d+)_t(\\d+)[-.](\\d+)', 1), '')::BIGINT AS frame,
    nullif(concat_ws('.', nullif(regexp_extract(name, '_frame_(\\d+)_t(\\d+)[-.](\\d+)', 2), ''), nullif(regexp_extract(name, '_frame_(\\d+)_t(\\d+)[-.](\\d+)', 3), '')), '')::DOUBLE AS seconds FROM named"""
)
def filename_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    stem = F.regexp_replace(video_key(F.col("video_filename")), r"\.[^.]*$", "")
    name = temporal.frame_name(stem, F.col("source_frame_index"), F.col("timestamp_seconds"))
    rows = adapters.distinct_images(spark, folder).select("image_id", F.when(stem.isNotNull() & F.col("source_frame_index").isNotNull() & F.col("timestamp_seconds").isNotNull(), name).alias("name"))
    return rows.select("image_id", "name", temporal.name_frame(F.col("name")).alias("frame"), temporal.name_timestamp(F.col("name")).alias("seconds"))


# Labels ---------------------------------------------------------------------------------------------------------------

_FLOAT = r"(?i)[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|[+-]?nan|[+-]?inf(?:inity)?"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{_FLOAT}') THEN TRY_CAST(replace({c}, '_', '') AS DOUBLE) END"


_BAD_FIELD = " ".join(f"WHEN NOT isfinite({f}) THEN '{f} must be finite.' WHEN {f} < -1e-9 OR {f} > 1 + 1e-9 THEN '{f} must be normalized between 0 and 1.'" for f in labels.FIELDS)
_LABELS = rf"""tokens AS (SELECT *, regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+') AS t FROM label_lines WHERE regexp_replace(line, '\s', '', 'g') <> ''),
    read AS (SELECT * EXCLUDE (t), t, len(t) AS n, regexp_full_match(t[1], '[+-]?[0-9]+(?:_[0-9]+)*') AS is_int, TRY_CAST(replace(t[1], '_', '') AS BIGINT) AS class_raw,
      {_number('t[2]')} AS x_center, {_number('t[3]')} AS y_center, {_number('t[4]')} AS width, {_number('t[5]')} AS height FROM tokens),
    judged AS (SELECT *, CASE WHEN is_int THEN class_raw END AS class_id, CASE WHEN n <> 5 THEN 'must contain 5 values; found ' || n || '.' WHEN NOT is_int THEN 'class id must be an integer.'
      WHEN x_center IS NULL OR y_center IS NULL OR width IS NULL OR height IS NULL THEN 'contains non-numeric coordinate values.' WHEN coalesce(class_raw, -1) <> 0 THEN 'class id must be 0 for ''ant''.'
      {_BAD_FIELD} WHEN width <= 0 OR height <= 0 THEN 'width and height must be greater than 0.'
      WHEN least(x_center - width / 2, y_center - height / 2) < -1e-9 OR greatest(x_center + width / 2, y_center + height / 2) > 1 + 1e-9 THEN 'bounding box extends outside normalized image bounds.' END AS error FROM read)"""


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return labels.parse_labels(spread(read_table(spark, folder, "label_lines")), polygons=False)


@query(
    f"""WITH {_LABELS} SELECT line_id, class_id, error, CASE WHEN error IS NULL THEN x_center END AS x_center, CASE WHEN error IS NULL THEN y_center END AS y_center,
    CASE WHEN error IS NULL THEN width END AS width, CASE WHEN error IS NULL THEN height END AS height FROM judged"""
)
def label_parse_detection(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("line_id", "class_id", "error", *labels.FIELDS)


@query(f"WITH {_LABELS} SELECT image_id, line_no, error FROM judged WHERE error IS NOT NULL")
def label_errors_all(spark: SparkSession, folder: str) -> DataFrame:
    return labels.all_errors(_parsed(spark, folder)).select("image_id", F.col("line_no"), "error")


@query(f"WITH {_LABELS} SELECT image_id, min((line_no, error))[1] AS line_no, min((line_no, error))[2] AS error FROM judged WHERE error IS NOT NULL GROUP BY image_id")
def label_errors_first(spark: SparkSession, folder: str) -> DataFrame:
    return labels.first_errors(_parsed(spark, folder), "image_id")


@query(
    f"""WITH {_LABELS}, f AS (SELECT image_id, count(*) FILTER (error IS NULL) AS good, count(*) FILTER (error IS NOT NULL) AS bad FROM judged GROUP BY image_id)
    SELECT count(*) AS files, sum(good)::BIGINT AS inspect_annotations, sum(bad)::BIGINT AS inspect_errors, sum(CASE WHEN bad = 0 THEN good ELSE 0 END)::BIGINT AS validate_annotations,
    count(*) FILTER (bad > 0) AS validate_errors FROM f"""
)
def label_policy_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines under the policy that keeps good lines of a bad file and under the one that keeps none."""
    files = labels.file_counts(_parsed(spark, folder), "image_id")
    good = F.col("detections") + F.col("polygons")
    return files.agg(
        F.count("*").alias("files"), F.sum(good).alias("inspect_annotations"), F.sum("invalid_lines").alias("inspect_errors"), F.sum(F.when(F.col("clean"), good).otherwise(0)).alias("validate_annotations"),
        F.count_if(~F.col("clean")).alias("validate_errors"),
    )


@query(
    rf"""WITH t AS (SELECT image_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM label_lines)
    SELECT image_id, line, count(*) AS copies, count(*) - 1 AS extra_rows FROM t WHERE line <> '' GROUP BY ALL HAVING count(*) > 1"""
)
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return labels.duplicate_rows(read_table(spark, folder, "label_lines"), "image_id")


@query("SELECT DISTINCT image_id FROM frame_manifest WHERE image_id NOT IN (SELECT image_id FROM label_lines WHERE image_id IS NOT NULL)")
def missing_labels(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "frame_manifest").select("image_id").distinct().join(read_table(spark, folder, "label_lines").select("image_id").distinct(), "image_id", "left_anti")


@query("SELECT DISTINCT image_id FROM boxes WHERE image_id NOT IN (SELECT image_id FROM frame_manifest UNION ALL SELECT image_id FROM holdout_manifest)")
def orphan_boxes(spark: SparkSession, folder: str) -> DataFrame:
    known = read_table(spark, folder, "frame_manifest").select("image_id").union(read_table(spark, folder, "holdout_manifest").select("image_id"))
    return read_table(spark, folder, "boxes").where(F.col("image_id").isNotNull()).select("image_id").distinct().join(known, "image_id", "left_anti")


_POLYGONS = """lines AS (SELECT l_linenumber AS ln, CASE WHEN l_linenumber = 7 THEN '1' ELSE '0' END AS c, l_partkey % 500 AS a, l_suppkey % 500 AS b, l_quantity::BIGINT AS q FROM lineitem),
    pts AS (SELECT *, [('0.' || lpad(v::VARCHAR, 3, '0'))::DOUBLE FOR v IN [a, a + q, a + 3]] AS xs, [('0.' || lpad(v::VARCHAR, 3, '0'))::DOUBLE FOR v IN [b, b + 7, b + q]] AS ys FROM lines),
    j AS (SELECT *, abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[1] - xs[1] * ys[3]) / 2 AS area FROM pts),
    judged AS (SELECT *, CASE WHEN c = '1' THEN 'class id must be 0 for ''ant''.' WHEN ln = 6 THEN 'segmentation coordinate count must be even.' WHEN ln = 4 THEN 'contains non-numeric coordinate values.'
      WHEN ln = 5 THEN 'segmentation point 4 x must be normalized between 0 and 1.' WHEN area <= 1e-12 THEN 'segmentation polygon is degenerate.'
      WHEN list_max(xs) - list_min(xs) <= 0 OR list_max(ys) - list_min(ys) <= 0 THEN 'width and height must be greater than 0.' END AS error FROM j)"""


@query(
    f"""WITH {_POLYGONS} SELECT round((list_min(xs) + list_max(xs)) / 2, 6) AS x_center, round((list_min(ys) + list_max(ys)) / 2, 6) AS y_center, round(list_max(xs) - list_min(xs), 6) AS width,
    round(list_max(ys) - list_min(ys), 6) AS height, count(*) AS boxes FROM judged WHERE error IS NULL GROUP BY ALL"""
)
def polygon_to_box(spark: SparkSession, folder: str) -> DataFrame:
    got = labels.parse_labels(adapters.polygons(spark, folder)).where(F.col("error").isNull())
    return got.select(*r6(*labels.FIELDS)).groupBy(*labels.FIELDS).agg(F.count("*").alias("boxes"))


@query(f"WITH {_POLYGONS} SELECT error, count(*) AS lines FROM judged GROUP BY error")
def polygon_errors(spark: SparkSession, folder: str) -> DataFrame:
    return labels.parse_labels(adapters.polygons(spark, folder)).groupBy("error").agg(F.count("*").alias("lines"))


_VALID_BOX = "class_id = 0 AND isfinite(x_center) AND isfinite(y_center) AND isfinite(width) AND isfinite(height)"
_BOXES = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY loaded_at) AS copy FROM boxes) WHERE copy = 1)"


@query(f"WITH {_BOXES} SELECT box_id, printf('%d %.12g %.12g %.12g %.12g', class_id, x_center, y_center, width, height) AS line FROM b WHERE {_VALID_BOX}")
def label_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.distinct_boxes(spark, folder)
    finite = F.col("class_id") == 0
    for c in labels.FIELDS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.where(finite).select("box_id", labels.format_label(F.col("class_id"), {c: F.col(c) for c in labels.FIELDS}).alias("line"))


@query(
    f"""WITH {_BOXES}, p AS (SELECT box_id, class_id, x_center, y_center, width, height, CASE WHEN class_id <> 0 THEN 'class id must be 0 for ''ant''.' {_BAD_FIELD.replace('isfinite', 'isfinite')}
      WHEN width <= 0 OR height <= 0 THEN 'width and height must be greater than 0.'
      WHEN least(x_center - width / 2, y_center - height / 2) < -1e-9 OR greatest(x_center + width / 2, y_center + height / 2) > 1 + 1e-9 THEN 'bounding box extends outside normalized image bounds.' END AS error
      FROM b WHERE class_id IS NOT NULL AND x_center IS NOT NULL AND y_center IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL)
    SELECT error, count(*) AS boxes FROM p GROUP BY error"""
)
def box_validation(spark: SparkSession, folder: str) -> DataFrame:
    there = F.col("class_id").isNotNull()
    for c in labels.FIELDS:
        there = there & F.col(c).isNotNull()
    rows = adapters.distinct_boxes(spark, folder).where(there)
    none = F.lit(None).cast("double")
    return rows.select(labels.box_error(F.col("class_id"), {c: F.col(c) for c in labels.FIELDS}, none, none).alias("error")).groupBy("error").agg(F.count("*").alias("boxes"))


@query(
    f"""WITH {_BOXES}, {_IMAGES} SELECT box_id, round(x_center * image_width - width * image_width / 2, 6) AS x1, round(y_center * image_height - height * image_height / 2, 6) AS y1,
    round(x_center * image_width + width * image_width / 2, 6) AS x2, round(y_center * image_height + height * image_height / 2, 6) AS y2 FROM b JOIN images USING (image_id) WHERE {_VALID_BOX}"""
)
def pixel_boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.distinct_boxes(spark, folder).join(adapters.distinct_images(spark, folder).select("image_id", "image_width", "image_height"), "image_id")
    finite = F.col("class_id") == 0
    for c in labels.FIELDS:
        finite = finite & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    box = pixel_corners(*[F.col(c) for c in (*labels.FIELDS, "image_width", "image_height")])
    return rows.where(finite).select("box_id", *[F.round(getattr(box, c), 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


# Tracking -------------------------------------------------------------------------------------------------------------

_GT_NAMES = tracking.GT_FIELDS
_GT_RULES = " ".join(
    f"WHEN v_{n} IS NULL THEN '{n} must be numeric.' WHEN NOT isfinite(v_{n}) THEN '{n} must be finite.'"
    + (f" WHEN v_{n} <> floor(v_{n}) OR abs(v_{n}) >= 9e18 THEN '{n} must be an integer.'" if n in ("frame", "track_id", "flag") else "")
    for n in _GT_NAMES
)
_MOT = rf"""parts AS (SELECT *, list_transform(string_split(regexp_replace(line, '^\s+|\s+$', '', 'g'), ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')) AS p
      FROM gt_lines WHERE regexp_replace(line, '\s', '', 'g') <> ''),
    read AS (SELECT *, {', '.join(f"{_number(f'p[{i + 1}]')} AS v_{n}" for i, n in enumerate(_GT_NAMES))} FROM parts),
    judged AS (SELECT *, CASE WHEN len(p) <> 7 THEN 'must contain exactly 7 comma-separated values; found ' || len(p) || '.' {_GT_RULES} WHEN v_frame < 1 THEN 'frame must be greater than or equal to 1.'
      WHEN v_width <= 0 THEN 'width must be greater than 0.' WHEN v_height <= 0 THEN 'height must be greater than 0.' END AS error FROM read),
    good AS (SELECT line_id, sequence_name, {', '.join(f"v_{n}::BIGINT AS {n}" if n in ('frame', 'track_id', 'flag') else f'v_{n} AS {n}' for n in _GT_NAMES)} FROM judged WHERE error IS NULL)"""


def _tracks(spark: SparkSession, folder: str) -> DataFrame:
    parsed = tracking.parse_ground_truth(spread(read_table(spark, folder, "gt_lines")))
    return parsed.where(F.col("error").isNull())


@query(f"WITH {_MOT} SELECT line_id, error, " + ", ".join(f"CASE WHEN error IS NULL THEN v_{n}{'::BIGINT' if n in ('frame', 'track_id', 'flag') else ''} END AS {n}" for n in _GT_NAMES) + " FROM judged")
def mot_parse(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.parse_ground_truth(spread(read_table(spark, folder, "gt_lines"))).select("line_id", "error", *_GT_NAMES)


@query(f"WITH {_MOT} SELECT sequence_name, frame, track_id, count(*) AS copies FROM good GROUP BY ALL HAVING count(*) > 1")
def mot_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.duplicate_tracks(_tracks(spark, folder), "sequence_name")


@query(
    f"""WITH {_MOT}, n AS (SELECT line_id, x < 0 OR y < 0 OR x + width > 1920 OR y + height > 1080 AS out, (x + width / 2) / 1920 AS a, (y + height / 2) / 1080 AS b, width / 1920 AS c, height / 1080 AS d FROM good)
    SELECT line_id, CASE WHEN out THEN 'box extends outside image bounds.' END AS error, CASE WHEN NOT out THEN a END AS norm_x_center, CASE WHEN NOT out THEN b END AS norm_y_center,
    CASE WHEN NOT out THEN c END AS norm_width, CASE WHEN NOT out THEN d END AS norm_height FROM n"""
)
def mot_to_normalized(spark: SparkSession, folder: str) -> DataFrame:
    got = tracking.to_normalized(_tracks(spark, folder), F.lit(adapters.IMAGE_W), F.lit(adapters.IMAGE_H))
    return got.select("line_id", "error", *[f"norm_{c}" for c in labels.FIELDS])


@query(
    f"""WITH {_MOT} SELECT sequence_name, count(*) AS annotations, count(DISTINCT track_id) AS tracks, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame) AS frames,
    array_to_string(list_sort(list_distinct(list(flag))), ',') AS flags FROM good GROUP BY sequence_name"""
)
def sequence_summary(spark: SparkSession, folder: str) -> DataFrame:
    return tracking.sequence_summary(_tracks(spark, folder), "sequence_name")


@query(
    f"""WITH {_MOT}, own AS (SELECT DISTINCT track_id % 97 AS track, frame FROM good),
    last AS (SELECT track, max(frame) AS n FROM own GROUP BY track), f AS (SELECT track, unnest(range(1, n + 1)) AS frame FROM last)
    SELECT f.track, f.frame FROM f WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.track = f.track AND own.frame = f.frame)"""
)
def frame_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Frames without a row of each group of tracks: whole sequences have a row in every frame, groups of tracks don't."""
    rows = _tracks(spark, folder).withColumn("track", F.col("track_id") % 97)
    return tracking.frame_gaps(rows, "track")


@query(
    f"""WITH {_MOT}, c AS (SELECT sequence_name, floor((x + width / 2) / 40)::BIGINT AS x, floor((y + height / 2) / 40)::BIGINT AS y, count(*) AS hits FROM good GROUP BY ALL),
    n AS (SELECT s.sequence_name, y, x FROM (SELECT DISTINCT sequence_name FROM good) s, range(27) r(y), range(48) q(x)),
    g AS (SELECT sequence_name, y, x, coalesce(hits, 0) AS v FROM n LEFT JOIN c USING (sequence_name, y, x)),
    e AS (SELECT *, min(v) OVER (PARTITION BY sequence_name) AS low, max(v) OVER (PARTITION BY sequence_name) AS high FROM g)
    SELECT sequence_name, y, x, v AS hits, CASE WHEN high > low THEN floor(((v - low) * (255.0::DOUBLE / (high - low)))::FLOAT)::INT ELSE 0 END AS level FROM e WHERE v > 0"""
)
def heatmap_cells(spark: SparkSession, folder: str) -> DataFrame:
    t = _tracks(spark, folder)
    cells = t.select("sequence_name", F.floor((F.col("x") + F.col("width") / 2) / 40).alias("x"), F.floor((F.col("y") + F.col("height") / 2) / 40).alias("y"))
    return motion.heatmap(cells, ["sequence_name"], adapters.IMAGE_H // 40, adapters.IMAGE_W // 40)


# Statistics -----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_IMAGES}, {_BOXES}, c AS (SELECT image_id, count(*) AS n FROM b GROUP BY image_id), j AS (SELECT lower(trim(split_name, {_BLANK})) AS split_name, coalesce(n, 0) AS n FROM images LEFT JOIN c USING (image_id))
    SELECT split_name, count(*) AS images, sum(n)::BIGINT AS annotations, count(*) FILTER (n = 0) AS images_without, round(avg(n), 6) AS average_per_image, min(n) AS least_per_image, max(n) AS most_per_image FROM j GROUP BY split_name"""
)
def dataset_stats(spark: SparkSession, folder: str) -> DataFrame:
    images = adapters.distinct_images(spark, folder).withColumn("split_name", F.lower(F.btrim(F.col("split_name"), F.lit(" \t\r"))))
    return statistics.split_statistics(images, adapters.distinct_boxes(spark, folder), "split_name", "image_id").withColumn("average_per_image", F.round("average_per_image", 6))


_SIZED = f"{_BOXES}, v AS (SELECT * FROM b WHERE isfinite(width) AND isfinite(height))"


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    both = F.lit(True)
    for c in ("width", "height"):
        both = both & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return adapters.distinct_boxes(spark, folder).where(both)


@query(
    f"""WITH {_SIZED} SELECT split_name, round(quantile_cont(width, 0.5), 6) AS median_width, round(quantile_cont(height, 0.5), 6) AS median_height, round(quantile_cont(width * height, 0.5), 6) AS median_area,
    round(quantile_cont(width * height, 0.25), 6) AS p25_area, round(quantile_cont(width * height, 0.75), 6) AS p75_area FROM v GROUP BY split_name"""
)
def box_size_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    got = statistics.size_percentiles(_sized(spark, folder), ["split_name"])
    return got.select("split_name", *r6(*[c for c in got.columns if c != "split_name"]))


@query(
    f"""WITH {_SIZED} SELECT source_name, count(*) AS boxes, round(min(width), 6) AS least, {', '.join(f"round(quantile_cont(width, {p}), 6) AS {n}" for n, p in (('p10', .1), ('p25', .25), ('p50', .5), ('p75', .75), ('p90', .9)))},
    round(max(width), 6) AS most, round(avg(width), 4) AS mean FROM v GROUP BY source_name"""
)
def scale_by_source(spark: SparkSession, folder: str) -> DataFrame:
    got = statistics.scale_summary(_sized(spark, folder), ["source_name"], "width")
    return got.select("source_name", "boxes", *r6("least", "p10", "p25", "p50", "p75", "p90", "most"), F.round("mean", 4).alias("mean"))


@query(f"WITH {_BOXES} SELECT class_id, count(*) AS annotations, count(DISTINCT image_id) AS images FROM b GROUP BY class_id")
def class_audit(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.class_audit(adapters.distinct_boxes(spark, folder))


@query(
    f"""WITH {_BOXES}, p AS (SELECT source_name, image_id, count(*) AS n FROM b GROUP BY ALL)
    SELECT source_name, count(*) AS images, round(avg(n), 6) AS mean_objects, quantile_cont(n, 0.5) AS median_objects, max(n) AS most_objects FROM p GROUP BY source_name"""
)
def density_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.density_by_source(adapters.distinct_boxes(spark, folder), "source_name", "image_id").withColumn("mean_objects", F.round("mean_objects", 6))


# Matching and evaluation ----------------------------------------------------------------------------------------------

_ORDER_BOXES = """o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
      (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1 FROM lineitem),
    ob AS (SELECT l_orderkey % 8 AS seq, l_orderkey AS image, n, x1, y1, x1 + (20.0 + l_quantity::BIGINT % 20)::DOUBLE AS x2, y1 + (20.0 + l_linenumber)::DOUBLE AS y2, 1 - l_discount AS confidence FROM o),
    gt AS (SELECT seq, image, ((n - 1) // 2)::INT AS gt_id, x1 AS gx1, y1 AS gy1, x2 AS gx2, y2 AS gy2 FROM ob WHERE n % 2 = 1),
    pr AS (SELECT seq, image, (n // 2 - 1)::INT AS pred_id, x1 AS px1, y1 AS py1, x2 AS px2, y2 AS py2, confidence FROM ob WHERE n % 2 = 0),
    both_ AS (SELECT *, greatest(0.0, least(gx2, px2) - greatest(gx1, px1)) * greatest(0.0, least(gy2, py2) - greatest(gy1, py1)) AS inter, (gx2 - gx1) * (gy2 - gy1) AS ga, (px2 - px1) * (py2 - py1) AS pa FROM gt JOIN pr USING (seq, image)),
    scored AS (SELECT *, inter / (ga + pa - inter) AS iou, (px1 + px2) / 2 BETWEEN gx1 AND gx2 AND (py1 + py2) / 2 BETWEEN gy1 AND gy2 AS inside,
      sqrt(((px1 + px2) / 2 - (gx1 + gx2) / 2) ** 2 + ((py1 + py2) / 2 - (gy1 + gy2) / 2) ** 2) AS distance FROM both_)"""


def _matched(name: str, condition: str, extra: str = "") -> str:
    """CTEs that count maximum matchings by the deficiency of all prediction subsets."""
    keys = f"seq, image{', ' + extra if extra else ''}"
    return f"""{name}_m AS (SELECT {keys}, pred_id, bit_or(1::BIGINT << gt_id) AS m FROM {condition} GROUP BY {keys}, pred_id),
    {name}_l AS (SELECT {keys}, list(m) AS ms FROM {name}_m GROUP BY {keys}),
    {name} AS (SELECT {keys}, len(ms) - list_max(list_transform(range(0, 1 << len(ms)), lambda s: bit_count(s) - bit_count(list_reduce(list_transform(range(0, len(ms)), lambda i: CASE WHEN (s >> i) & 1 = 1 THEN ms[i + 1] ELSE 0::BIGINT END), lambda a, b: a | b)))) AS matched FROM {name}_l)"""


_KEYS = ["seq", "image"]


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    boxes = adapters.order_boxes(spark, folder)
    return boxes, adapters.truth(boxes), adapters.predictions(boxes)


@query(f"WITH {_ORDER_BOXES} SELECT seq, image, pred_id, gt_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY seq, image ORDER BY confidence DESC, distance, pred_id, gt_id) AS rank FROM scored WHERE inside")
def center_candidates(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, pred = _sides(spark, folder)
    return matching.center_candidates(gt, pred, _KEYS).select(*_KEYS, "pred_id", "gt_id", *r6("distance"), "rank")


@query(f"WITH {_ORDER_BOXES} SELECT seq, image, pred_id, gt_id, round(iou, 6) AS iou, row_number() OVER (PARTITION BY seq, image ORDER BY iou DESC, confidence DESC, pred_id, gt_id) AS rank FROM scored WHERE iou >= 0.3")
def iou_candidates(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, pred = _sides(spark, folder)
    return matching.iou_candidates(gt, pred, _KEYS, 0.3).select(*_KEYS, "pred_id", "gt_id", *r6("iou"), "rank")


def _counts(gt: DataFrame, pred: DataFrame, rule: matching.Rule) -> DataFrame:
    """Images with a match and the size of their matching."""
    counted = matching.count_matches(gt, gt, pred, _KEYS, [rule])
    return counted.select(*_KEYS, F.get("matched", F.lit(0)).alias("matched")).where(F.col("matched") > 0)


@query(f"WITH {_ORDER_BOXES}, {_matched('mc', 'scored WHERE inside')} SELECT seq, image, matched FROM mc")
def match_count_center(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, pred = _sides(spark, folder)
    return _counts(gt, pred, matching.Rule())


@query(f"WITH {_ORDER_BOXES}, {_matched('mi', 'scored WHERE iou >= 0.3')} SELECT seq, image, matched FROM mi")
def match_count_iou(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, pred = _sides(spark, folder)
    return _counts(gt, pred, matching.Rule(0.3))


@query(f"WITH {_ORDER_BOXES}, {_matched('mi', 'scored WHERE iou >= 0.3')} SELECT sum(matched)::BIGINT AS pairs, count(*) AS images FROM mi")
def match_pair_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the matching with identities, which goes by augmenting paths."""
    _, gt, pred = _sides(spark, folder)
    pairs = matching.match_pairs(matching.iou_candidates(gt, pred, _KEYS, 0.3), _KEYS)
    one_to_one = pairs.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.count_distinct("gt_id").alias("g"), F.count_distinct("pred_id").alias("p"))
    return one_to_one.agg(F.sum(F.least("n", "g", "p")).alias("pairs"), F.count("*").alias("images"))


@query(
    f"""WITH {_ORDER_BOXES}, c AS (SELECT seq, image, pred_id, gt_id FROM scored WHERE iou >= 0.3),
    one AS (SELECT *, count(*) OVER (PARTITION BY seq, image, pred_id) AS a, count(*) OVER (PARTITION BY seq, image, gt_id) AS b FROM c),
    plain AS (SELECT seq, image FROM one GROUP BY ALL HAVING max(a) = 1 AND max(b) = 1) SELECT seq, image, pred_id, gt_id FROM c JOIN plain USING (seq, image)"""
)
def match_pairs_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Matched identities of images where no box has two candidates, so that there is one maximum matching only."""
    _, gt, pred = _sides(spark, folder)
    candidates = matching.iou_candidates(gt, pred, _KEYS, 0.3)
    tied = candidates.groupBy(*_KEYS, "pred_id").count().where("count > 1").select(*_KEYS).union(candidates.groupBy(*_KEYS, "gt_id").count().where("count > 1").select(*_KEYS))
    return matching.match_pairs(candidates, _KEYS).join(tied, _KEYS, "left_anti").select(*_KEYS, "pred_id", "gt_id")


@query()
def match_pairs(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, pred = _sides(spark, folder)
    return matching.match_pairs(matching.iou_candidates(gt, pred, _KEYS, 0.3), _KEYS)


_EVAL = f"""{_ORDER_BOXES}, {_matched('mc', 'scored WHERE inside')}, {_matched('mi', 'scored WHERE iou >= 0.3')},
    ev AS (SELECT i.seq, i.image, coalesce(g.n, 0) AS gt_count, coalesce(p.n, 0) AS prediction_count, coalesce(mc.matched, 0) AS center_matched, coalesce(mi.matched, 0) AS iou50_matched
      FROM (SELECT DISTINCT seq, image FROM ob) i LEFT JOIN (SELECT seq, image, count(*) AS n FROM gt GROUP BY ALL) g USING (seq, image)
      LEFT JOIN (SELECT seq, image, count(*) AS n FROM pr GROUP BY ALL) p USING (seq, image) LEFT JOIN mc USING (seq, image) LEFT JOIN mi USING (seq, image))"""
_RATES = """sum(prediction_count)::BIGINT - sum(center_matched)::BIGINT AS center_false_positives, sum(gt_count)::BIGINT - sum(center_matched)::BIGINT AS center_false_negatives,
    round(coalesce(sum(center_matched) / nullif(sum(prediction_count), 0), 0), 6) AS center_precision, round(coalesce(sum(center_matched) / nullif(sum(gt_count), 0), 0), 6) AS center_recall,
    sum(prediction_count)::BIGINT - sum(iou50_matched)::BIGINT AS iou50_false_positives, sum(gt_count)::BIGINT - sum(iou50_matched)::BIGINT AS iou50_false_negatives,
    round(coalesce(sum(iou50_matched) / nullif(sum(prediction_count), 0), 0), 6) AS iou50_precision, round(coalesce(sum(iou50_matched) / nullif(sum(gt_count), 0), 0), 6) AS iou50_recall"""
_SUMS = "count(*) AS images, sum(gt_count)::BIGINT AS gt_count, sum(prediction_count)::BIGINT AS prediction_count, sum(center_matched)::BIGINT AS center_matched, sum(iou50_matched)::BIGINT AS iou50_matched"
_RATE_NAMES = ["center_precision", "center_recall", "iou50_precision", "iou50_recall"]


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    boxes, gt, pred = _sides(spark, folder)
    return evaluation.frame_evaluation(boxes, gt, pred, _KEYS, 0.3)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    f"""WITH {_EVAL} SELECT *, gt_count - center_matched AS center_missed, prediction_count - center_matched AS center_unmatched, gt_count - iou50_matched AS iou50_missed,
    prediction_count - iou50_matched AS iou50_unmatched FROM ev"""
)
def frame_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder)


@query(f"WITH {_EVAL} SELECT seq, {_SUMS}, {_RATES} FROM ev GROUP BY seq")
def eval_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.totals(_evaluated(spark, folder), ["seq"]), _RATE_NAMES)


_DENSITY = "d AS (SELECT *, CASE WHEN i < n // 3 THEN 'low' WHEN i < n * 2 // 3 THEN 'medium' ELSE 'high' END AS density FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY gt_count, image) - 1 AS i, count(*) OVER (PARTITION BY seq) AS n FROM ev))"


@query(f"WITH {_EVAL}, {_DENSITY} SELECT seq, density, {_SUMS}, {_RATES}, min(gt_count) AS least_gt, max(gt_count) AS most_gt FROM d GROUP BY seq, density")
def density_terciles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.density_analysis(_evaluated(spark, folder), ["seq"], "image"), _RATE_NAMES)


@query(
    f"""WITH {_EVAL}, t AS (SELECT seq, coalesce(sum(iou50_matched) / nullif(sum(prediction_count), 0), 0) AS p, coalesce(sum(iou50_matched) / nullif(sum(gt_count), 0), 0) AS r FROM ev GROUP BY seq)
    SELECT count(*) AS sources, round(coalesce(avg(p), 0), 6) AS macro_iou50_precision, round(coalesce(avg(r), 0), 6) AS macro_iou50_recall FROM t"""
)
def macro_average(spark: SparkSession, folder: str) -> DataFrame:
    names = ["iou50_precision", "iou50_recall"]
    got = evaluation.macro_average(evaluation.totals(_evaluated(spark, folder), ["seq"]), names)
    return _rounded(got, [f"macro_{n}" for n in names])


@query(
    f"""WITH {_ORDER_BOXES}, steps AS (SELECT * FROM (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) s(threshold)),
    c AS (SELECT * FROM scored JOIN steps ON iou >= threshold), {_matched('ms', 'c', 'threshold')} SELECT threshold, sum(matched)::BIGINT AS matched FROM ms GROUP BY threshold"""
)
def iou_sweep(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, pred = _sides(spark, folder)
    return evaluation.iou_sweep(gt, pred, _KEYS, [0.3, 0.4, 0.5, 0.7])


@query(
    f"""WITH {_ORDER_BOXES}, steps AS (SELECT * FROM (VALUES (0.92::DOUBLE), (0.95::DOUBLE), (0.98::DOUBLE)) s(threshold)),
    c AS (SELECT * FROM scored JOIN steps ON confidence >= threshold WHERE iou >= 0.3), {_matched('ms', 'c', 'threshold')}, m AS (SELECT threshold, sum(matched)::BIGINT AS matched FROM ms GROUP BY threshold),
    k AS (SELECT threshold, count(*) AS predictions FROM pr JOIN steps ON confidence >= threshold GROUP BY threshold)
    SELECT threshold, (SELECT count(*) FROM gt) AS truth, coalesce(predictions, 0) AS predictions, coalesce(matched, 0) AS matched FROM steps LEFT JOIN k USING (threshold) LEFT JOIN m USING (threshold)"""
)
def confidence_sweep(spark: SparkSession, folder: str) -> DataFrame:
    boxes, gt, pred = _sides(spark, folder)
    return evaluation.confidence_sweep(boxes, gt, pred, _KEYS, [0.92, 0.95, 0.98], 0.3)


@query(
    f"""WITH {_ORDER_BOXES}, p AS (SELECT a.seq, a.image, a.gt_id, count(*) FILTER (b.gt_id <> a.gt_id AND
      sqrt(((a.gx1 + a.gx2) / 2 - (b.gx1 + b.gx2) / 2) ** 2 + ((a.gy1 + a.gy2) / 2 - (b.gy1 + b.gy2) / 2) ** 2) <= 12.25) AS neighbours FROM gt a JOIN gt b ON a.seq = b.seq AND a.image = b.image GROUP BY ALL)
    SELECT *, CASE WHEN neighbours = 0 THEN '0' WHEN neighbours <= 2 THEN '1-2' ELSE '3+' END AS crowding FROM p"""
)
def crowding_bins(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, _ = _sides(spark, folder)
    return evaluation.crowding(gt, _KEYS, 12.25)


@query(
    f"""WITH {_ORDER_BOXES}, s AS (SELECT seq, image, gt_id, row_number() OVER (PARTITION BY seq ORDER BY (gx2 - gx1) * (gy2 - gy1), gt_id, image) - 1 AS i, count(*) OVER (PARTITION BY seq) AS n FROM gt)
    SELECT seq, CASE WHEN i < n // 3 THEN 'small' WHEN i < n * 2 // 3 THEN 'medium' ELSE 'large' END AS scale, count(*) AS boxes FROM s GROUP BY ALL"""
)
def scale_terciles(spark: SparkSession, folder: str) -> DataFrame:
    _, gt, _ = _sides(spark, folder)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return evaluation.scale_terciles(gt, ["seq"], area).groupBy("seq", "scale").agg(F.count("*").alias("boxes"))


_EXAMPLES = f"""WITH {_EVAL}, r AS (SELECT *, coalesce(center_matched / nullif(gt_count, 0), 0) AS recall, row_number() OVER (PARTITION BY seq ORDER BY image) - 1 AS o,
      row_number() OVER (PARTITION BY seq ORDER BY gt_count, image) - 1 AS d, count(*) OVER (PARTITION BY seq) AS n FROM ev),
    extremes AS (
      SELECT seq, image, 0 AS turn FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY recall DESC, prediction_count - center_matched, o) = 1
      UNION ALL SELECT seq, image, 1 FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY gt_count - center_matched DESC, gt_count DESC, o) = 1
      UNION ALL SELECT seq, image, 2 FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY prediction_count - center_matched DESC, prediction_count DESC, o) = 1
      UNION ALL SELECT seq, image, 3 FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY gt_count DESC, o) = 1
      UNION ALL SELECT seq, image, 4 FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY gt_count, o) = 1
      UNION ALL SELECT seq, image, 5 FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY center_matched - iou50_matched DESC, center_matched DESC, o) = 1
      UNION ALL SELECT seq, image, 6 FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY gt_count DESC, gt_count - center_matched DESC, o) = 1),
    middles AS (
      SELECT seq, image, 7 AS turn FROM r WHERE n // 3 > 0 AND d = (n // 3) // 2
      UNION ALL SELECT seq, image, 8 FROM r WHERE n * 2 // 3 > n // 3 AND d = n // 3 + (n * 2 // 3 - n // 3) // 2
      UNION ALL SELECT seq, image, 9 FROM r WHERE d = n * 2 // 3 + (n - n * 2 // 3) // 2),
    evenly AS (SELECT seq, image, 10 + k AS turn FROM r, range(10) t(k) WHERE o = CASE WHEN n <= 10 THEN k ELSE round_even(k * (n - 1) / 9, 0)::BIGINT END),
    chosen AS (SELECT seq, image, min(turn) AS turn FROM (FROM extremes UNION ALL FROM middles UNION ALL FROM evenly) GROUP BY ALL)
    SELECT seq, image, row_number() OVER (PARTITION BY seq ORDER BY turn) AS choice FROM chosen QUALIFY choice <= 10"""


@query(_EXAMPLES)
def example_frames(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.example_frames(_evaluated(spark, folder), ["seq"], "image")


@query(
    f"""WITH {_EVAL}, {_matched('hi', 'scored WHERE iou >= 0.3 AND confidence >= 0.95')}
    SELECT round(corr(gt_count::DOUBLE, coalesce(coalesce(hi.matched, 0) / nullif(gt_count, 0), 0) - coalesce(iou50_matched / nullif(gt_count, 0), 0)), 6) AS correlation FROM ev LEFT JOIN hi USING (seq, image)"""
)
def density_recall_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of truth count and recall change when only confident predictions are kept."""
    boxes, gt, pred = _sides(spark, folder)
    counted = matching.count_matches(boxes, gt, pred, _KEYS, [matching.Rule(0.3), matching.Rule(0.3, 0.95)])
    every, sure = (counted.select(*_KEYS, "gt_count", F.get("matched", F.lit(i)).alias("iou50_matched")) for i in range(2))
    return _rounded(evaluation.density_correlation(every, sure, _KEYS), ["correlation"])


# Identity -------------------------------------------------------------------------------------------------------------

_SHA = "nullif(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(13))), '^sha256:', ''), '')"
_HASH_DIGITS = "regexp_extract(lower(trim(phash, ' ' || chr(9) || chr(13))), '^(?:0x)?([0-9a-f]{1,16})$', 1)"
_HASH = f"nullif(CASE WHEN {_HASH_DIGITS} <> '' THEN CAST('0x' || {_HASH_DIGITS} AS UBIGINT) END, 0)"


@query("SELECT sha256(text) AS sha256, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def sha_identity(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").where(F.col("text").isNotNull()).groupBy(identity.content_sha(F.col("text")).alias("sha256")).agg(F.count("*").alias("copies"))


@query(
    f"""WITH r AS (SELECT {_SHA.format('imagesha256')} AS s, min(filename) AS identity FROM holdout_manifest GROUP BY s), m AS (SELECT DISTINCT {_SHA.format('image_sha256')} AS sha FROM frame_manifest)
    SELECT sha, coalesce(identity, 'CUSTOM / UNREGISTERED') AS identity FROM m LEFT JOIN r ON m.sha = r.s"""
)
def registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    models = read_table(spark, folder, "frame_manifest").select(sha_key(F.col("image_sha256")).alias("sha")).distinct()
    registry = read_table(spark, folder, "holdout_manifest").select(sha_key(F.col("imagesha256")).alias("sha"), "filename")
    return identity.identify(models, registry, "sha", "filename")


@query(
    f"""WITH s AS (SELECT DISTINCT {_SHA.format('image_sha256')} AS sha FROM frame_manifest), h AS (SELECT DISTINCT source_name, {_SHA.format('imagesha256')} AS sha FROM holdout_manifest)
    SELECT source_name, count(*) AS hashes, count(s.sha) AS leaked FROM h LEFT JOIN s USING (sha) WHERE h.sha IS NOT NULL GROUP BY source_name"""
)
def leakage_overlap(spark: SparkSession, folder: str) -> DataFrame:
    own = read_table(spark, folder, "frame_manifest").select(sha_key(F.col("image_sha256")).alias("sha"))
    held = read_table(spark, folder, "holdout_manifest").select("source_name", sha_key(F.col("imagesha256")).alias("sha"))
    return identity.leakage(own, held, "sha", "source_name")


_SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN ({0}::HUGEINT - 18446744073709551616)::BIGINT ELSE {0}::BIGINT END"
_PAIRS = f"""h AS (SELECT DISTINCT {_HASH} AS u FROM frame_manifest), v AS (SELECT u, {_SIGNED.format('u')} AS s FROM h WHERE u IS NOT NULL),
    p AS (SELECT a.s AS hash_a, b.s AS hash_b, bit_count(xor(a.u, b.u))::INT AS distance FROM v a JOIN v b ON a.s < b.s AND bit_count(xor(a.u, b.u)) <= 4)"""


def _near(spark: SparkSession, folder: str) -> DataFrame:
    return identity.hamming_pairs(read_table(spark, folder, "frame_manifest").select(hash64(F.col("phash")).alias("h")), "h", 4)


@query(f"WITH {_PAIRS} SELECT * FROM p")
def near_duplicate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder)


@query(f"WITH {_PAIRS} SELECT distance, count(*) AS pairs FROM p GROUP BY distance")
def phash_distance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).groupBy("distance").agg(F.count("*").alias("pairs"))


@query(
    f"""WITH i AS (SELECT DISTINCT {_VIDEO} AS video, {_SHA.format('image_sha256')} AS sha FROM frame_manifest),
    b AS (SELECT video, substr(sha256(sha), 1, 3) AS bucket, count(*) AS n, sha256(string_agg(sha, chr(10) ORDER BY sha)) AS h FROM i WHERE sha IS NOT NULL GROUP BY ALL)
    SELECT video, sum(n)::BIGINT AS files, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS content_hash FROM b GROUP BY video"""
)
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "frame_manifest").select(video_key(F.col("video_filename")).alias("video"), sha_key(F.col("image_sha256")).alias("sha"))
    return identity.set_hash(rows, ["video"], "sha")


@query(
    f"""WITH i AS (SELECT DISTINCT {_VIDEO} AS video, nullif(lower(trim(split_name, {_BLANK})), '') AS s FROM frame_manifest)
    SELECT video, string_agg(s, ',' ORDER BY s) AS splits FROM i WHERE video IS NOT NULL AND s IS NOT NULL GROUP BY video HAVING count(*) > 1"""
)
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "frame_manifest").select(video_key(F.col("video_filename")).alias("video"), name_key(F.col("split_name")).alias("split"))
    return identity.split_overlap(rows, "split", "video")


# Checks, reports and provenance ---------------------------------------------------------------------------------------


@query(
    f"""WITH {_FRAMES} SELECT stream, frame_index, round(frame_index / CASE WHEN f <= 0 THEN 30 ELSE f END, 9) AS analyze_seconds, round(CASE WHEN f > 0 THEN frame_index / f ELSE 0 END, 9) AS extract_seconds,
    round(frame_index / CASE WHEN f = 0 THEN 30 ELSE f END, 9) + 0.0::DOUBLE AS detect_seconds, CASE WHEN frame_index > 0 AND f > 0 THEN round(frame_index / f, 6) ELSE 0 END AS duration
    FROM (SELECT stream, frame_index, (stream - 2) * 12.5::DOUBLE AS f FROM frames)"""
)
def frame_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times of frames under the three rules for a rate that isn't above 0, and durations."""
    fps = (F.col("stream") - 2) * F.lit(12.5)
    rows = adapters.frames(spark, folder).withColumn("fps", fps)
    times = [F.round(temporal.frame_seconds(F.col("frame_index"), F.col("fps"), p), 9).alias(f"{p}_seconds") for p in ("analyze", "extract", "detect")]
    return rows.select("stream", "frame_index", *times, temporal.duration_seconds(F.col("frame_index"), F.col("fps")).alias("duration"))


_ROI = """r AS (SELECT image_id, image_width AS w, image_height AS h, (image_id * 7) % 2600 - 20 AS x, (image_id * 11) % 1500 - 10 AS y, (image_id * 13) % 900 AS rw, (image_id * 17) % 700 AS rh FROM images)"""


def _rois(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("image_id")
    values = ((i * 7) % 2600 - 20, (i * 11) % 1500 - 10, (i * 13) % 900, (i * 17) % 700)
    rows = adapters.distinct_images(spark, folder).select("image_id", F.col("image_width").alias("w"), F.col("image_height").alias("h"), *[v.alias(n) for v, n in zip(values, ("x", "y", "rw", "rh"))])
    return rows


@query(
    f"""WITH {_IMAGES}, {_ROI} SELECT image_id, CASE WHEN x < 0 OR y < 0 THEN 'roi x and y must be non-negative' WHEN rw <= 0 OR rh <= 0 THEN 'roi width and height must be greater than 0'
    WHEN x + rw > w OR y + rh > h THEN 'roi exceeds the frame' END AS error FROM r"""
)
def roi_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of interest read from text and held against their frame."""
    rows = _rois(spark, folder).withColumn("r", roi_from_text(F.concat_ws(",", "x", "y", "rw", "rh")))
    own = [F.col(f"r.{c}") for c in ("x", "y", "width", "height")]
    return rows.select("image_id", F.coalesce("r.error", roi_within_error(*own, F.col("w"), F.col("h"))).alias("error"))


@query(
    f"""WITH {_IMAGES}, {_ROI}, {_BOXES} SELECT box_id, round_even(b.x_center * 100 + r.x, 0)::BIGINT AS gx, round_even(b.y_center * 100 + r.y, 0)::BIGINT AS gy, round_even(b.width * 100, 0)::BIGINT AS gw,
    round_even(b.height * 100, 0)::BIGINT AS gh FROM b JOIN r USING (image_id) WHERE {_VALID_BOX}"""
)
def global_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes within a region of interest at their place in the frame, halves to even."""
    rows = _valid_boxes(spark, folder).join(_rois(spark, folder).select("image_id", "x", "y"), "image_id")
    placed = motion.to_global(*[F.col(c) * 100 for c in labels.FIELDS], F.col("x"), F.col("y"))
    return rows.select("box_id", placed.alias("g")).select("box_id", *[F.col(f"g.{c}").alias(f"g{c[0]}") for c in ("x", "y", "width", "height")])


def _valid_boxes(spark: SparkSession, folder: str) -> DataFrame:
    good = F.col("class_id") == 0
    for c in labels.FIELDS:
        good = good & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return adapters.distinct_boxes(spark, folder).where(good)


@query(
    f"""WITH {_IMAGES}, {_BOXES}, a AS (SELECT image_id, image_width * image_height AS pixels, sum(image_width * width * image_height * height) AS moving FROM b JOIN images USING (image_id) WHERE {_VALID_BOX} GROUP BY ALL)
    SELECT image_id, round(CASE WHEN pixels = 0 THEN 0 ELSE least(1.0, greatest(0.0, moving / pixels)) END, 6) AS score, CASE WHEN image_id % 3 = 0 THEN 7.0 ELSE round(greatest(1.0, pixels * 1e-5), 6) END AS least_area FROM a"""
)
def activity_and_least_area(spark: SparkSession, folder: str) -> DataFrame:
    """Share of moving pixels, boxes standing for motion, and the least area of a region, given for every third image."""
    sizes = adapters.distinct_images(spark, folder).select("image_id", "image_width", "image_height")
    w, h = F.col("image_width"), F.col("image_height")
    rows = _valid_boxes(spark, folder).join(sizes, "image_id").groupBy("image_id", (w * h).alias("pixels")).agg(F.sum(w * F.col("width") * h * F.col("height")).alias("moving"))
    explicit = F.when(F.col("image_id") % 3 == 0, F.lit(7.0))
    score = motion.activity_score(F.col("moving"), F.col("pixels"))
    return rows.select("image_id", F.round(score, 6).alias("score"), F.round(motion.min_motion_area(F.col("pixels"), F.lit(1e-5), explicit), 6).alias("least_area"))


@query(
    f"""WITH {_BOXES}, a AS (SELECT image_id, box_id, width * height AS area FROM b WHERE {_VALID_BOX} AND width * height >= 0.001)
    SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, box_id) - 1 AS place FROM a"""
)
def region_order(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of at least an area, largest first, of each image."""
    regions = F.sort_array(F.collect_list(F.struct("box_id", (F.col("width") * F.col("height")).alias("area"))))
    grouped = _valid_boxes(spark, folder).groupBy("image_id").agg(regions.alias("r"))
    kept = grouped.select("image_id", F.posexplode(motion.motion_regions(F.col("r"), F.lit(0.001))).alias("place", "r"))
    return kept.select("image_id", F.col("r.box_id").alias("box_id"), F.col("place").cast("bigint").alias("place"))


_EDGE = "greatest(-(x_center - width / 2) * w, (x_center + width / 2 - 1) * w, -(y_center - height / 2) * h, (y_center + height / 2 - 1) * h)"


@query(
    f"""WITH {_IMAGES}, s AS (SELECT image_id, image_width::DOUBLE AS w, image_height::DOUBLE AS h FROM images), {_LABELS},
    j AS (SELECT line_id, CASE WHEN error LIKE 'must contain%' OR error LIKE 'class id%' OR error LIKE 'contains%' THEN error
      WHEN NOT isfinite(x_center) THEN 'x_center must be finite.' WHEN NOT isfinite(y_center) THEN 'y_center must be finite.' WHEN NOT isfinite(width) THEN 'width must be finite.' WHEN NOT isfinite(height) THEN 'height must be finite.'
      WHEN width <= 0 OR height <= 0 THEN 'width and height must be greater than 0.' WHEN {_EDGE} > 0.5 + 1e-12 THEN 'bounding box exceeds image bounds by more than 0.5 pixels.' END AS error FROM judged JOIN s USING (image_id))
    SELECT error, count(*) AS lines FROM j GROUP BY error"""
)
def image_edge_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Label lines judged in pixels of their image."""
    sizes = adapters.distinct_images(spark, folder).select("image_id", F.col("image_width").cast("double").alias("w"), F.col("image_height").cast("double").alias("h"))
    lines = spread(read_table(spark, folder, "label_lines")).join(sizes, "image_id")
    return labels.parse_labels(lines, polygons=False, image_w="w", image_h="h").groupBy("error").agg(F.count("*").alias("lines"))


_DATASET = f"""i AS (SELECT DISTINCT lower(trim(split_name, {_BLANK})) AS split, image_id::VARCHAR AS stem, CASE WHEN image_id % 50 <> 7 THEN image_width END AS image_w FROM images WHERE lower(trim(split_name, {_BLANK})) IN ('train', 'valid', 'test')),
    f AS (SELECT DISTINCT s.split, image_id::VARCHAR AS stem FROM label_lines, (VALUES ('train'), ('valid'), ('test')) s(split)),
    p AS (SELECT i.split, judged.image_id::VARCHAR AS stem, line_no, error FROM judged JOIN i ON i.stem = judged.image_id::VARCHAR),
    whole AS (SELECT split, stem, NULL::INT AS line_no, 'Missing label for image' AS error FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.split = i.split AND f.stem = i.stem)
      UNION ALL SELECT split, stem, NULL, 'Label without image' FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE f.split = i.split AND f.stem = i.stem)
      UNION ALL SELECT split, stem, NULL, 'Image could not be read' FROM i WHERE image_w IS NULL AND EXISTS (SELECT 1 FROM f WHERE f.split = i.split AND f.stem = i.stem))"""


def _dataset_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = adapters.distinct_images(spark, folder).withColumn("split", name_key(F.col("split_name"))).where(F.col("split").isin("train", "valid", "test"))
    images = rows.select("split", F.col("image_id").cast("string").alias("stem"), F.when(F.col("image_id") % 50 != 7, F.col("image_width")).alias("image_w"))
    lines = spread(read_table(spark, folder, "label_lines")).withColumn("stem", F.col("image_id").cast("string"))
    splits = F.explode(F.array(F.lit("train"), F.lit("valid"), F.lit("test"))).alias("split")
    files = lines.select("stem").distinct().select("stem", splits)
    return images, files, labels.parse_labels(lines.join(images.select("split", "stem"), "stem"), polygons=False)


@query(
    f"""WITH {_IMAGES}, {_LABELS}, {_DATASET} SELECT split, stem, line_no, error FROM whole
    UNION ALL SELECT split, stem, min((line_no, error))[1], min((line_no, error))[2] FROM p WHERE error IS NOT NULL GROUP BY split, stem"""
)
def dataset_errors(spark: SparkSession, folder: str) -> DataFrame:
    """All errors of a dataset under the policy that reports a file's first bad line."""
    return pipelines.dataset_errors(*_dataset_tables(spark, folder), every_line=False)


@query(f"WITH {_IMAGES}, {_LABELS}, {_DATASET} SELECT split, stem, line_no, error FROM whole UNION ALL SELECT split, stem, line_no, error FROM p WHERE error IS NOT NULL")
def export_errors(spark: SparkSession, folder: str) -> DataFrame:
    """All errors of an export, with every bad line."""
    return pipelines.dataset_errors(*_dataset_tables(spark, folder), every_line=True)


@query(
    f"""WITH {_IMAGES}, {_LABELS}, l AS (SELECT image_id, count(*) FILTER (error IS NULL) AS good, count(*) FILTER (error IS NOT NULL) AS bad FROM judged GROUP BY image_id)
    SELECT nullif(lower(trim(split_name, {_BLANK})), '') AS split, count(*) AS images, count(l.image_id) AS labelled, count(*) FILTER (l.image_id IS NULL) AS unlabelled, coalesce(sum(good), 0)::BIGINT AS detections,
    0::BIGINT AS polygons, coalesce(sum(bad), 0)::BIGINT AS invalid_lines FROM images LEFT JOIN l USING (image_id) GROUP BY ALL"""
)
def export_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of an export per split."""
    records = adapters.distinct_images(spark, folder).withColumn("split", name_key(F.col("split_name")))
    return labels.split_counters(records, _parsed(spark, folder), "split", "image_id")


@query(f"WITH {_LABELS} SELECT class_id, count(*) AS lines FROM judged WHERE class_id IS NOT NULL GROUP BY class_id")
def label_class_ids(spark: SparkSession, folder: str) -> DataFrame:
    return labels.class_ids(_parsed(spark, folder))


@query(
    f"""WITH {_LABELS} SELECT (SELECT count(DISTINCT image_id) FROM frame_manifest WHERE image_id NOT IN (SELECT image_id FROM label_lines WHERE image_id IS NOT NULL)) AS missing_labels,
    (SELECT count(DISTINCT image_id) FROM label_lines WHERE image_id NOT IN (SELECT image_id FROM frame_manifest)) AS extra_labels,
    count(*) FILTER (error LIKE '%class id%') AS invalid_class_ids, count(*) FILTER (error LIKE '%normalized between 0 and 1%' OR error LIKE '%outside normalized image bounds%') AS out_of_range,
    count(*) FILTER (error LIKE '%width and height must be greater than 0%') AS zero_or_negative,
    count(*) FILTER (error NOT LIKE '%class id%' AND error NOT LIKE '%normalized%' AND error NOT LIKE '%width and height must be greater than 0%') AS other FROM judged"""
)
def label_revalidation(spark: SparkSession, folder: str) -> DataFrame:
    """Check of written labels: stems on either side and lines by kind of error."""
    stem = F.col("image_id").cast("string").alias("stem")
    lines = read_table(spark, folder, "label_lines")
    return pipelines.revalidate_labels(read_table(spark, folder, "frame_manifest").select(stem), spread(lines), lines.select(stem))


@query(
    f"""WITH {_LABELS}, g AS (SELECT image_id, line_no, line_id, printf('%d %.12g %.12g %.12g %.12g', class_id, x_center, y_center, width, height) AS l FROM judged WHERE error IS NULL)
    SELECT i.image_id, coalesce(t.text, '') AS text FROM (SELECT DISTINCT image_id FROM label_lines) i LEFT JOIN (SELECT image_id, string_agg(l, chr(10) ORDER BY line_no, line_id) AS text FROM g GROUP BY image_id) t USING (image_id)"""
)
def label_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of label files, written anew from their valid lines."""
    good = labels.all_valid(_parsed(spark, folder)).withColumn("text_line", labels.format_label(F.col("class_id"), {c: F.col(c) for c in labels.FIELDS}))
    return files.label_texts(read_table(spark, folder, "label_lines").select("image_id"), good, "image_id", "text_line", ["line_no", "line_id"])


@query(
    f"""WITH {_MOT}, f AS (SELECT DISTINCT frame FROM good), n AS (SELECT unnest(range(1, 251)) AS frame)
    SELECT 'missing images' AS "check", printf('%06d.jpg', frame) AS name, frame FROM n WHERE frame NOT IN (SELECT frame FROM f)
    UNION ALL SELECT 'extra images', printf('%06d.jpg', frame), NULL FROM f WHERE frame > 250"""
)
def sequence_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a sequence of 250 frames by name: those that lack and those that shouldn't be there."""
    names = _tracks(spark, folder).select(F.concat(F.format_string("%06d", "frame"), F.lit(".jpg")).alias("name")).distinct().withColumn("file", F.col("name"))
    return pipelines.sequence_images(names, SequenceInfo("s", "img", 30, 250, adapters.IMAGE_W, adapters.IMAGE_H, ".jpg"))[1]


@query(
    f"""WITH {_EVAL}, t AS (SELECT seq, sum(gt_count)::BIGINT AS gt_count FROM ev GROUP BY seq), d AS (SELECT seq, image, gx1, gy1, gx2, gy2, count(*) - 1 AS x FROM gt GROUP BY ALL)
    SELECT t.seq, t.gt_count, (t.gt_count - (SELECT sum(x) FROM d WHERE d.seq = t.seq))::BIGINT AS distinct_gt_count, r_name AS baseline FROM t LEFT JOIN region ON r_regionkey = t.seq"""
)
def distinct_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Truth of each sequence less repeated rows, beside a baseline that not every sequence has."""
    boxes, gt, pred = _sides(spark, folder)
    baseline = read_table(spark, folder, "region").select(F.col("r_regionkey").cast("bigint").alias("seq"), F.col("r_name").alias("baseline"))
    got = pipelines.evaluate_benchmark(boxes, gt, pred, "seq", "image", baseline)["comparison"]
    extra = gt.groupBy("seq", "image", "x1", "y1", "x2", "y2").agg((F.count("*") - 1).alias("extra_rows"))
    return evaluation.distinct_truth(got, extra, ["seq"]).select("seq", "gt_count", "distinct_gt_count", "baseline")


@query(f"WITH {_ORDER_BOXES} SELECT count(DISTINCT image) AS processed_frames, (SELECT count(*) FROM pr) AS total_detections FROM ob")
def detection_run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Frames and detections of a run, frames without any included."""
    boxes, _, pred = _sides(spark, folder)
    found = pred.groupBy("image").agg(F.collect_list("pred_id").alias("detections"))
    rows = boxes.select("image").distinct().join(found, "image", "left").withColumn("detections", F.coalesce("detections", F.array().cast("array<int>")))
    return detection_totals(rows)


@query(
    f"""WITH {_ORDER_BOXES}, met AS (SELECT a.seq, a.image, a.pred_id AS a, b.pred_id AS b, greatest(0.0, least(a.px2, b.px2) - greatest(a.px1, b.px1)) * greatest(0.0, least(a.py2, b.py2) - greatest(a.py1, b.py1)) AS i,
      (a.px2 - a.px1) * (a.py2 - a.py1) + (b.px2 - b.px1) * (b.py2 - b.py1) AS s FROM pr a JOIN pr b ON a.seq = b.seq AND a.image = b.image AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.pred_id < b.pred_id))),
    steps AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.4::DOUBLE)) t(overlap)), hit AS (SELECT overlap, seq, image, a, b FROM met JOIN steps ON i / (s - i) > overlap),
    k1 AS (SELECT overlap, seq, image, pred_id FROM pr, steps WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.overlap = steps.overlap AND hit.seq = pr.seq AND hit.image = pr.image AND hit.b = pr.pred_id)),
    k2 AS (SELECT overlap, seq, image, pred_id FROM pr, steps WHERE NOT EXISTS (SELECT 1 FROM hit JOIN k1 ON k1.overlap = hit.overlap AND k1.seq = hit.seq AND k1.image = hit.image AND k1.pred_id = hit.a
      WHERE hit.overlap = steps.overlap AND hit.seq = pr.seq AND hit.image = pr.image AND hit.b = pr.pred_id)),
    k3 AS (SELECT overlap, seq, image, pred_id FROM pr, steps WHERE NOT EXISTS (SELECT 1 FROM hit JOIN k2 ON k2.overlap = hit.overlap AND k2.seq = hit.seq AND k2.image = hit.image AND k2.pred_id = hit.a
      WHERE hit.overlap = steps.overlap AND hit.seq = pr.seq AND hit.image = pr.image AND hit.b = pr.pred_id)),
    c AS (SELECT scored.*, k3.overlap FROM scored JOIN k3 USING (seq, image, pred_id) WHERE iou >= 0.3), {_matched('ms', 'c', 'overlap')}
    SELECT overlap, (SELECT count(*) FROM k3 WHERE k3.overlap = steps.overlap) AS predictions, (SELECT sum(matched)::BIGINT FROM ms WHERE ms.overlap = steps.overlap) AS matched FROM steps"""
)
def suppression_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions that survive suppression at two overlaps, and their matches; images have three predictions at most."""
    _, gt, pred = _sides(spark, folder)
    return evaluation.suppression_sweep(gt, pred, _KEYS, [0.2, 0.4], 0.3)


@query(
    f"""WITH {_BOXES}, p AS (SELECT source_name, image_id, count(*) AS n FROM b GROUP BY ALL), d AS (SELECT source_name, avg(n) AS m FROM p GROUP BY source_name)
    SELECT source_name, CASE WHEN m < 5 THEN 'sparse' WHEN m < 15 THEN 'medium' ELSE 'dense' END AS density FROM d"""
)
def density_classes(spark: SparkSession, folder: str) -> DataFrame:
    got = statistics.density_by_source(adapters.distinct_boxes(spark, folder), "source_name", "image_id")
    return got.select("source_name", statistics.density_class(F.col("mean_objects"), {"sparse": 5.0, "medium": 15.0, "dense": float("inf")}).alias("density"))


@query(
    f"""WITH {_IMAGES}, n AS (SELECT lower(regexp_extract(image_filename, '[^/]*$')) AS name, image_filename AS path, nullif(lower(trim(split_name, {_BLANK})), '') AS split, source_name FROM images),
    names AS (SELECT name, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM n WHERE name IS NOT NULL AND split IS NOT NULL GROUP BY name HAVING count(DISTINCT split) > 1)
    SELECT 'name in several splits' AS finding, name AS value, splits, NULL::BIGINT AS copies FROM names
    UNION ALL SELECT 'path stands twice', path, split, count(*) FROM n WHERE path IS NOT NULL GROUP BY path, split HAVING count(*) > 1
    UNION ALL SELECT 'forbidden source', source_name, split, count(*) FROM n WHERE source_name IN ('cellar_cam2', 'formicarium_cam2') GROUP BY source_name, split"""
)
def leakage_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Names in several splits, paths that stand twice, and rows of sources that mustn't be there."""
    rows = adapters.distinct_images(spark, folder).withColumn("split", name_key(F.col("split_name")))
    return identity.path_report(rows, "split", "image_filename", "source_name", ["cellar_cam2", "formicarium_cam2"])


@query(
    f"""WITH m AS (SELECT DISTINCT family_id, image_id, {_HASH} AS h FROM frame_manifest WHERE family_id IS NOT NULL), r AS (SELECT family_id, min(image_id) AS representative, arg_min(h, image_id) AS rh FROM m WHERE h IS NOT NULL GROUP BY family_id)
    SELECT family_id, representative, image_id, bit_count(xor(h, rh))::INT AS distance FROM m LEFT JOIN r USING (family_id)"""
)
def family_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the curators' families with their distance from the representative."""
    rows = read_table(spark, folder, "frame_manifest").where(F.col("family_id").isNotNull()).select("family_id", "image_id", hash64(F.col("phash")).alias("h")).distinct()
    got = identity.families(rows, "family_id", "image_id", "h")
    return got.select("family_id", "representative", "image_id", F.col("distance").cast("int").alias("distance"))


@query(
    f"""WITH {_IMAGES}, s AS (SELECT image_id, {_SHA.format('image_sha256')} AS sha FROM images), h AS (SELECT image_id % 5000 AS k, upper({_SHA.format('imagesha256')}) AS sha FROM holdout_manifest)
    SELECT s.image_id, coalesce(bool_and(s.sha = h.sha_low), false) AS matches FROM s LEFT JOIN (SELECT DISTINCT {_SHA.format('imagesha256')} AS sha_low FROM holdout_manifest) h ON s.sha = h.sha_low GROUP BY s.image_id"""
)
def manifest_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the file of an image is at hand with its hash, case aside; the held-out hashes stand for files at hand."""
    own = adapters.distinct_images(spark, folder).select("image_id", sha_key(F.col("image_sha256")).alias("sha256"))
    held = read_table(spark, folder, "holdout_manifest").select(F.upper(sha_key(F.col("imagesha256"))).alias("sha256")).distinct()
    at_hand = own.join(held.select(F.col("sha256").alias("s")), F.upper("sha256") == F.col("s"), "left_semi").select("image_id", F.upper("sha256").alias("sha256"))
    return files.verify_manifest(own, at_hand, "image_id", "sha256")


@query(f"""WITH m AS (SELECT DISTINCT {_SHA.format('image_sha256')} AS sha FROM frame_manifest) SELECT count(*) AS checked, count(DISTINCT sha) AS hashes FROM m WHERE sha IS NOT NULL""")
def sha_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes held against themselves in capitals; a difference would fail the query."""
    own = read_table(spark, folder, "frame_manifest").select(sha_key(F.col("image_sha256")).alias("sha")).where(F.col("sha").isNotNull()).distinct()
    checked = own.select(identity.check_sha(F.col("sha"), F.upper("sha")).alias("sha"))
    return checked.agg(F.count("sha").alias("checked"), F.count_distinct("sha").alias("hashes"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity <> 10 AS changed_quantity, l_discount <> 0.05 AS changed_discount, l_quantity = 10 AND l_discount = 0.05 AS canonical FROM lineitem"""
)
def parameter_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters that aren't the canonical ones."""
    rows = read_table(spark, folder, "lineitem")
    number = lambda v: (F.col(v) if isinstance(v, str) else F.lit(v)).cast("double")
    values = F.create_map(F.lit("quantity"), number("l_quantity"), F.lit("discount"), number("l_discount"))
    standard = F.create_map(F.lit("quantity"), number(10), F.lit("discount"), number(0.05))
    found = F.map_keys(identity.overrides(values, standard))
    return rows.select(
        "l_orderkey", "l_linenumber", F.array_contains(found, "quantity").alias("changed_quantity"), F.array_contains(found, "discount").alias("changed_discount"), (F.size(found) == 0).alias("canonical")
    )


_QUOTA = f"""v AS (SELECT image_id, {_VIDEO} AS video, {_HASH} AS h, row_number() OVER (PARTITION BY {_VIDEO} ORDER BY source_frame_index NULLS FIRST, image_id) - 1 AS i, count(*) OVER (PARTITION BY {_VIDEO}) AS n FROM images),
    o AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.3::DOUBLE), (2, 0.7::DOUBLE), (3, 0.1::DOUBLE), (4, 0.9::DOUBLE)) t("offset", part)),
    w AS (SELECT video, b AS bin, "offset", floor((b + part) / 8 * n)::BIGINT AS at FROM (SELECT DISTINCT video, n FROM v WHERE video IS NOT NULL), range(8) r(b), o),
    c AS (SELECT w.video, bin, "offset", image_id, h FROM w JOIN v ON v.video = w.video AND v.i = w.at)"""


@query(
    f"""WITH {_IMAGES}, {_QUOTA} SELECT c.video, c.bin::INT AS bin, min(c."offset") AS "offset", arg_min(c.image_id, c."offset") AS image_id FROM c LEFT JOIN c p ON p.video = c.video AND p.bin = c.bin - 1 AND p."offset" = 0
    WHERE NOT coalesce(bit_count(xor(c.h, p.h)) < 20, false) GROUP BY c.video, c.bin"""
)
def quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One frame per video and eighth of it, of five candidates, unlike the eighth before."""
    rows = adapters.distinct_images(spark, folder).select("image_id", video_key(F.col("video_filename")).alias("video"), "source_frame_index", hash64(F.col("phash")).alias("h"))
    got = temporal.quota_sample(rows, "video", ["source_frame_index", "image_id"], "h", 8, (0.5, 0.3, 0.7, 0.1, 0.9), 20)
    return got.select("video", "bin", "offset", "image_id")


# Files ----------------------------------------------------------------------------------------------------------------

_FILE_TEXT = "SELECT image_id, string_agg(regexp_replace(replace(coalesce(line, ''), chr(13), ''), '\n', ' ', 'g'), chr(10) ORDER BY line_no, line_id) AS text FROM label_lines WHERE image_id IS NOT NULL GROUP BY image_id"


def _label_folder(spark: SparkSession, folder: str) -> str:
    """The label lines as files of a folder, one per image; line feeds and carriage returns within a line taken out."""
    place = scratch_path(spark, "label-files")
    line = F.replace(F.replace(F.coalesce("line", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    rows = read_table(spark, folder, "label_lines").where(F.col("image_id").isNotNull()).withColumn("text", line)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))), lambda x: x["text"])
    texts = rows.groupBy("image_id").agg(F.array_join(ordered, "\n").alias("text"))
    files.write_text_files(texts.select(F.concat(F.col("image_id").cast("string"), F.lit(".txt")).alias("name"), "text"), place, "name", "text").count()
    return place


@query(f"WITH t AS ({_FILE_TEXT}) SELECT image_id::VARCHAR || '.txt' AS name, image_id::VARCHAR AS stem, strlen(text) AS bytes FROM t")
def label_file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Label files as the file system lists them after they were written, empty ones included."""
    return files.list_files(spark, _label_folder(spark, folder), ("txt",)).select("name", "stem", F.col("length").alias("bytes"))


@query(
    f"""WITH t AS ({_FILE_TEXT}), l AS (SELECT image_id::VARCHAR AS stem, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n, text FROM t)
    SELECT stem, line_no, line FROM l WHERE text <> '' AND NOT (line = '' AND line_no = n AND n > 1)"""
)
def label_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of label files with their numbers, after they were written."""
    return files.read_line_files(spark, _label_folder(spark, folder)).select("stem", F.col("line_no").cast("int").alias("line_no"), "line")


@query(
    f"""WITH {_ORDER_BOXES} SELECT image AS "frameIndex", round(image / 25, 6) AS seconds, count(pred_id) AS detections, round(coalesce(sum(confidence), 0), 6) AS confidence, coalesce(sum(round_even(px2 - px1, 0)), 0)::BIGINT AS widths
    FROM (SELECT DISTINCT image FROM ob) LEFT JOIN pr USING (image) GROUP BY image"""
)
def detections_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Detections written as lines of JSON, a frame each, and read again; frames without any are kept."""
    boxes, _, pred = _sides(spark, folder)
    box = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    each = F.collect_list(F.struct(F.lit(0).alias("classId"), F.lit("ant").alias("className"), "confidence", box.alias("bbox")))
    found = pred.groupBy("image").agg(each.alias("detections"))
    frames = boxes.select("image").distinct().join(found, "image", "left")
    none = F.array().cast(found.schema["detections"].dataType)
    place = scratch_path(spark, "detections")
    files.write_json_lines(frames.select(F.col("image").alias("frameIndex"), (F.col("image") / 25).alias("timestampSeconds"), F.coalesce("detections", none).alias("detections")), place)
    again = files.read_detections(spark, place)
    total = lambda of: F.aggregate("detections", F.lit(0.0), lambda acc, d: acc + of(d))
    return again.select(
        "frameIndex", F.round("timestampSeconds", 6).alias("seconds"), F.size("detections").cast("bigint").alias("detections"), F.round(total(lambda d: d.confidence), 6).alias("confidence"),
        total(lambda d: F.rint(d.bbox.width)).cast("bigint").alias("widths"),
    )


@query(
    f"""WITH {_IMAGES} SELECT image_id, len(string_split(subdomain_group, ' ')) AS pieces, upper(split_name) AS split_upper, temporal_bin IS NOT NULL AS has_bin, image_width AS w, image_height AS h FROM images"""
)
def manifest_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest as CSV with a list, a flag and a nested cell, written and read again."""
    rows = adapters.distinct_images(spark, folder)
    size = F.to_json(F.struct(F.col("image_width").alias("w"), F.col("image_height").alias("h")))
    pieces = F.array_join(F.split("subdomain_group", " "), ";")
    cells = rows.select("image_id", pieces.alias("pieces"), F.col("split_name").alias("split"), F.initcap(F.col("temporal_bin").isNotNull().cast("string")).alias("has_bin"), size.alias("size"))
    place = scratch_path(spark, "manifest")
    cells.write.csv(place, header=True, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    again = files.read_manifest(spark, place, lists=("pieces",), flags=("has_bin",), nested={"size": "struct<w: int, h: int>"})
    return again.select(F.col("image_id").cast("bigint").alias("image_id"), F.size("pieces").cast("bigint").alias("pieces"), F.upper("split").alias("split_upper"), "has_bin", F.col("size.w").alias("w"), F.col("size.h").alias("h"))


@query(
    f"""WITH {_IMAGES} SELECT image_id::VARCHAR AS stem, CASE WHEN image_id % 20 <> 3 THEN image_width END AS image_w, CASE WHEN image_id % 20 <> 3 THEN image_height END AS image_h FROM images"""
)
def image_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes from the headers of image files that were written before; every twentieth can't be read."""
    place = scratch_path(spark, "image-files")
    number = lambda c: F.lpad(F.hex(F.col(c)), 8, "0")
    start = F.when(F.col("image_id") % 20 != 3, F.lit("89504E470D0A1A0A0000000D49484452")).otherwise(F.lit("00" * 16))
    content = F.unhex(F.concat(start, number("image_width"), number("image_height"), F.lit("0800000000")))
    rows = adapters.distinct_images(spark, folder).select(F.concat(F.col("image_id").cast("string"), F.lit(".PNG")).alias("name"), content.alias("content"))
    files.write_text_files(rows, place, "name", "content").count()
    listed = files.list_images(spark, place)
    return listed.join(files.image_sizes(listed), "file").select("stem", "image_w", "image_h")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'e' || s_nationkey ELSE 'CUSTOM / UNREGISTERED' END AS experiment, s_suppkey % 3 = 2 AND s_suppkey % 5 <> 0 AS canonical,
    CASE WHEN s_suppkey % 3 <> 2 THEN 0.5 + (s_suppkey % 3) / 10 END AS iou, s_suppkey % 5 = 0 AS other_size, s_acctbal AS result FROM supplier"""
)
def run_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of runs, read back: the registered model, whether parameters were canonical, and what differed."""
    rows = read_table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    runs = rows.select(
        "s_suppkey", F.lit("v").alias("source_path"), F.lit("0").alias("source_sha256"), F.lit("m").alias("model_path"), F.upper(F.sha2(F.col("s_name"), 256)).alias("model_sha256"),
        F.create_map(F.lit("0"), F.lit("ant")).alias("classes"), F.struct("s_acctbal").alias("result"), F.lit("2026-01-01").cast("timestamp").alias("created_at"),
        F.lit(0.25).alias("confidence"), F.round(F.lit(0.5) + (k % 3) / 10, 6).alias("iou"), F.when(k % 5 == 0, 960).otherwise(640).alias("imageSize"), F.lit(False).alias("end2end"),
    )
    registry = rows.where(k % 2 == 0).select(F.sha2(F.col("s_name"), 256).alias("sha256"), F.concat(F.lit("e"), "s_nationkey").alias("experiment"), F.lit("s").alias("status"))
    canonical = spark.createDataFrame([(0.25, 0.7, 640, False)], "confidence double, iou double, imageSize int, end2end boolean")
    read = lambda path: F.get_json_object("document", path)
    return provenance.run_documents(runs, registry, canonical).select(
        "s_suppkey", read("$.model.experiment").alias("experiment"), (read("$.inference.canonicalInference") == "true").alias("canonical"), read("$.inference.overrides.iou.actual").cast("double").alias("iou"),
        read("$.inference.overrides.imageSize").isNotNull().alias("other_size"), read("$.result.s_acctbal").cast("double").alias("result"),
    )


# Streams --------------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, source: DataFrame, build, mode: str, name: str) -> DataFrame:
    """Run a streaming plan over a table written to the shared folder until all of it is read; its last state per key."""
    path = scratch_path(spark, name)
    source.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    out = f"{path}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    running = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


@query(SQL["motion_summary"])
def stream_motion(spark: SparkSession, folder: str) -> DataFrame:
    """The motion summary by a stateful stream; the last update of each stream."""
    rows = _streamed(spark, adapters.frames(spark, folder).repartition(6, "frame_index"), lambda s: running_summary(s, 25), "update", "motion")
    last = rows.groupBy("stream").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("stream", "batch")]), "batch").alias("l")).select("stream", "l.*")
    return _rounded(last, ["average_score", "max_score", "average_regions", "peak_seconds"]).withColumn("max_regions", F.col("max_regions").cast("int"))


@query(
    f"""WITH e AS (SELECT user_id % 8 AS stream, date_trunc('day', ts) AS day, least(1.0, greatest(0.0, value / 500)) AS score FROM events)
    SELECT CAST(day AS DATE) AS day, stream, count(*) AS frames, round(avg(score), 6) AS average_score, round(max(score), 6) AS max_score FROM e GROUP BY ALL"""
)
def stream_activity_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily activity by event-time windows; the last update of each window."""
    events = read_table(spark, folder, "events").select("ts", (F.col("user_id") % 8).alias("stream"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500)).alias("score"))
    rows = _streamed(spark, events.repartition(4, "stream"), lambda s: activity_windows(s, late="3650 days"), "update", "windows")
    last = rows.groupBy(F.to_date("start").alias("day"), "stream").agg(F.max_by(F.struct("frames", "average_score", "max_score"), "batch").alias("l")).select("day", "stream", "l.*")
    return _rounded(last, ["average_score", "max_score"])


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
