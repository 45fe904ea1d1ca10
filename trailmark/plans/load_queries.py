"""Queries of problem 1: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.reject_load import GT_FORMAT, LABEL_FORMAT, load_lines, loaded_rows
from trailmark.session import read_table, spread


def _rejects(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for fmt in (GT_FORMAT, LABEL_FORMAT):
        got = load_lines(spread(read_table(spark, folder, fmt.name)), fmt).where(F.col("reason").isNotNull())
        parts.append(got.select(F.lit(fmt.name).alias("table_name"), "line_id", "reason"))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that don't load."""
    return _rejects(spark, folder).select("table_name", "line_id")


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that don't load, with the reason."""
    return _rejects(spark, folder)


def p1_loaded_gt(spark: SparkSession, folder: str) -> DataFrame:
    return loaded_rows(load_lines(spread(read_table(spark, folder, "gt_lines")), GT_FORMAT), GT_FORMAT)


def p1_loaded_labels(spark: SparkSession, folder: str) -> DataFrame:
    return loaded_rows(load_lines(spread(read_table(spark, folder, "label_lines")), LABEL_FORMAT), LABEL_FORMAT)


def p1_damage_by_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded and refused lines of each sequence."""
    lines = read_table(spark, folder, "gt_lines")
    got = load_lines(lines, GT_FORMAT).select("line_id", "reason")
    joined = lines.select("line_id", "sequence_name").join(got, "line_id")
    return joined.groupBy("sequence_name").agg(
        F.count_if(F.col("reason").isNull()).alias("loaded"), F.count_if(F.col("reason").isNotNull()).alias("refused")
    )


_NUM = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_B = r"[ \t\r]*"
_GT_VALUE = rf'{_B}(?:({_NUM})|"{_B}({_NUM}){_B}"){_B}'
_GT_LINE = ",".join([_GT_VALUE] * 7)
_GT = f"""
WITH lines AS (SELECT line_id, sequence_name, line FROM gt_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
parts AS (SELECT *, regexp_full_match(line, '{_GT_LINE}') AS fits,
  {', '.join(f"TRY_CAST(regexp_extract(line, '^{','.join([_GT_VALUE.replace('(' + _NUM, '(?:' + _NUM)] * k + [_GT_VALUE])}', 1) || regexp_extract(line, '^{','.join([_GT_VALUE.replace('(' + _NUM, '(?:' + _NUM)] * k + [_GT_VALUE])}', 2) AS DOUBLE) AS v{k}" for k in range(7))}
  FROM lines),
judged AS (SELECT *, coalesce(fits AND isfinite(v0) AND isfinite(v1) AND isfinite(v2) AND isfinite(v3) AND isfinite(v4) AND isfinite(v5) AND isfinite(v6)
  AND v0 = floor(v0) AND v1 = floor(v1) AND v6 = floor(v6) AND v0 >= 1 AND v4 > 0 AND v5 > 0, false) AS ok FROM parts)
"""
_LABEL = f"""
WITH lines AS (SELECT line_id, trim(line, ' ' || chr(9) || chr(13)) AS t FROM label_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
parts AS (SELECT line_id, regexp_split_to_array(t, '[ \\t\\r]+') AS p FROM lines),
parsed AS (SELECT line_id, len(p) = 5 AND regexp_full_match(p[1], '[+-]?[0-9]+') AND regexp_full_match(p[2], '{_NUM}') AND regexp_full_match(p[3], '{_NUM}')
  AND regexp_full_match(p[4], '{_NUM}') AND regexp_full_match(p[5], '{_NUM}') AS fits, TRY_CAST(p[1] AS DOUBLE) AS c, TRY_CAST(p[2] AS DOUBLE) AS x,
  TRY_CAST(p[3] AS DOUBLE) AS y, TRY_CAST(p[4] AS DOUBLE) AS w, TRY_CAST(p[5] AS DOUBLE) AS h FROM parts),
judged AS (SELECT *, coalesce(fits AND c = 0 AND least(x, y, w, h, x - w / 2, y - h / 2) >= -1e-9
  AND greatest(x, y, w, h, x + w / 2, y + h / 2) <= 1 + 1e-9 AND w > 0 AND h > 0, false) AS ok FROM parsed)
"""


_FIELD = r"(?:[^\",]*|[ \t\r]*\"(?:[^\"]|\"\")*\"[ \t\r]*)"
_GT_NAMES, _LABEL_NAMES = GT_FORMAT.columns, LABEL_FORMAT.columns


def _number_reasons(names: tuple[str, ...]) -> str:
    return " ".join(f"WHEN NOT coalesce(regexp_full_match(v[{i + 1}], '{_NUM}') AND isfinite(TRY_CAST(v[{i + 1}] AS DOUBLE)), false) THEN '{n} not a number'" for i, n in enumerate(names))


_REASONS = f"""
WITH gt AS (SELECT line_id, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS fits, regexp_extract_all(line || ',', '({_FIELD}),', 1) AS raw FROM gt_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
gv AS (SELECT line_id, fits, list_transform(raw, lambda f: CASE WHEN trim(f, ' ' || chr(9) || chr(13)) LIKE '"%' THEN trim(replace(regexp_replace(trim(f, ' ' || chr(9) || chr(13)), '^"|"$', '', 'g'), '""', '"'), ' ' || chr(9) || chr(13))
  ELSE trim(f, ' ' || chr(9) || chr(13)) END) AS v FROM gt),
gd AS (SELECT *, list_transform(v, lambda x: TRY_CAST(x AS DOUBLE)) AS d FROM gv),
lv AS (SELECT line_id, contains(line, '"') AS quoted, regexp_split_to_array(trim(line, ' ' || chr(9) || chr(13)), '[ \t\r]+') AS v FROM label_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
ld AS (SELECT *, list_transform(v, lambda x: TRY_CAST(x AS DOUBLE)) AS d FROM lv),
r AS (SELECT 'gt_lines' AS table_name, line_id, CASE WHEN NOT fits THEN 'broken quoting' WHEN len(v) < 7 THEN 'missing columns' WHEN len(v) > 7 THEN 'too many columns' {_number_reasons(_GT_NAMES)}
    WHEN d[1] <> floor(d[1]) THEN 'frame not integral' WHEN d[2] <> floor(d[2]) THEN 'track_id not integral' WHEN d[7] <> floor(d[7]) THEN 'flag not integral'
    WHEN d[1] < 1 THEN 'frame below 1' WHEN d[5] <= 0 THEN 'width not above 0' WHEN d[6] <= 0 THEN 'height not above 0' END AS reason FROM gd
  UNION ALL SELECT 'label_lines', line_id, CASE WHEN len(v) < 5 THEN 'missing columns' WHEN len(v) > 5 THEN 'too many columns' {_number_reasons(_LABEL_NAMES)}
    WHEN NOT regexp_full_match(v[1], '[+-]?[0-9]+') THEN 'class not an integer' WHEN d[1] <> 0 THEN 'class not 0'
    {' '.join(f"WHEN d[{i}] < -1e-9 OR d[{i}] > 1 + 1e-9 THEN '{n} outside 0 to 1'" for i, n in enumerate(_LABEL_NAMES[1:], 2))} WHEN d[4] <= 0 THEN 'width not above 0' WHEN d[5] <= 0 THEN 'height not above 0'
    WHEN d[2] - d[4] / 2 < -1e-9 OR d[2] - d[4] / 2 > 1 + 1e-9 THEN 'left edge outside' WHEN d[2] + d[4] / 2 < -1e-9 OR d[2] + d[4] / 2 > 1 + 1e-9 THEN 'right edge outside'
    WHEN d[3] - d[5] / 2 < -1e-9 OR d[3] - d[5] / 2 > 1 + 1e-9 THEN 'top edge outside' WHEN d[3] + d[5] / 2 < -1e-9 OR d[3] + d[5] / 2 > 1 + 1e-9 THEN 'bottom edge outside' END FROM ld)
SELECT table_name, line_id, reason FROM r WHERE reason IS NOT NULL"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_rejects, p1_loaded_gt, p1_loaded_labels, p1_damage_by_sequence)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_rejects": _REASONS,
        "p1_found": f"SELECT 'gt_lines' AS table_name, line_id FROM ({_GT} SELECT line_id FROM judged WHERE NOT ok) "
        f"UNION ALL SELECT 'label_lines' AS table_name, line_id FROM ({_LABEL} SELECT line_id FROM judged WHERE NOT ok)",
        "p1_loaded_gt": f"{_GT} SELECT line_id, v0::BIGINT AS frame, v1::BIGINT AS track_id, v2 AS x, v3 AS y, v4 AS width, v5 AS height, v6::BIGINT AS flag FROM judged WHERE ok",
        "p1_loaded_labels": f"{_LABEL} SELECT line_id, c::BIGINT AS class_id, x AS x_center, y AS y_center, w AS width, h AS height FROM judged WHERE ok",
        "p1_damage_by_sequence": f"{_GT} SELECT sequence_name, count(*) FILTER (ok) AS loaded, count(*) FILTER (NOT ok) AS refused FROM judged GROUP BY sequence_name",
    }
