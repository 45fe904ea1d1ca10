"""Queries of problems 2 to 9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import boxes, checks, leakage, mixing, neardup, overlaps, repetition, sampling, splits
from trailmark.session import read_table, spread


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of width and area per source and split, merged from the digests of labelling days."""
    return boxes.percentiles(read_table(spark, folder, "boxes"))


def p2_batch_check(spark: SparkSession, folder: str) -> DataFrame:
    """Area percentiles per batch beside the published ones."""
    return boxes.batch_check(read_table(spark, folder, "boxes"), read_table(spark, folder, "dataset_statistics"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Values behind each group of p2_percentiles, as the digests have them."""
    return boxes.percentiles(read_table(spark, folder, "boxes"), probabilities=[0.5]).select("measure", "source_name", "split_name", "n")


def _sample(spark: SparkSession, folder: str) -> sampling.Sample:
    return sampling.stratified_sample(read_table(spark, folder, "frame_manifest"), read_table(spark, folder, "sampling_targets"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Planned bins that no image can fill, from the sample's report."""
    return _sample(spark, folder).bins.where(F.col("state") == "empty").select("video", "temporal_bin")


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).sample


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each category."""
    return _sample(spark, folder).groups


def p3_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Planned bins that are empty or weren't drawn."""
    return _sample(spark, folder).bins.where(F.col("state") != "covered")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.tied_videos(read_table(spark, folder, "frame_manifest"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.group_splits(read_table(spark, folder, "frame_manifest"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_report(read_table(spark, folder, "frame_manifest"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = p5_overlaps(spark, folder)
    return pairs.select(F.least("train_id", "evaluation_id").alias("image_a"), F.greatest("train_id", "evaluation_id").alias("image_b"))


def p5_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.overlapping_images(read_table(spark, folder, "frame_manifest"), read_table(spark, folder, "holdout_manifest"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.overlap_counts(read_table(spark, folder, "frame_manifest"), read_table(spark, folder, "holdout_manifest"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_images(read_table(spark, folder, "frame_manifest"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.image_groups(read_table(spark, folder, "frame_manifest"))


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.mix_sources(spread(read_table(spark, folder, "documents")), read_table(spark, folder, "mixing_targets"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mixture with their copies."""
    return _mixture(spark, folder).copies


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached and missed per source."""
    return _mixture(spark, folder).report


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents holding passages with up to a fifth of their words edited, or windows of them with small edits."""
    return leakage.find_leaks(spread(read_table(spark, folder, "documents")), read_table(spark, folder, "eval_passages"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(spread(read_table(spark, folder, "documents")), read_table(spark, folder, "eval_passages"))


def p9_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated shares of every document."""
    got = repetition.measure(spread(read_table(spark, folder, "documents")))
    return got.withColumns({c: F.round(c, 6) for c in ("sentence_share", "paragraph_share", "run_share")})


def p9_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents at or above a threshold of their language and source: of runs, sentences or paragraphs."""
    return repetition.flag(spread(read_table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of at least 20 words with a repeated share of at least 0.3.

    The query asks for a share that is large in any group: it gives the adaptive filter a ceiling of 0.3, so that no
    group's threshold loses such a document, and then compares the share in whole numbers.
    """
    found = repetition.flag(spread(read_table(spark, folder, "documents")), ceiling=0.3, min_words=20, measures=("run_share",))
    return found.where(F.col("repeated_runs") * 10 >= F.col("runs") * 3).select("doc_id")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def queries() -> dict:
    own = (
        p2_percentiles, p2_batch_check, p2_counts, p3_found, p3_sample, p3_groups, p3_bins, p4_found, p4_splits, p4_report, p5_found, p5_overlaps,
        p5_counts, p6_found, p6_groups, p7_found, p7_leaks, p8_mixture, p8_report, p9_found, p9_repetition, p9_flagged,
    )
    return {f.__name__: f for f in own} | checks.queries()


_BLANKS = "' ' || chr(9) || chr(13)"


def _name(column: str) -> str:
    return f"nullif(lower(trim({column}, {_BLANKS})), '')"


def _video(column: str) -> str:
    return _name(f"regexp_extract({column}, '[^/]*$')")


def _hash(column: str) -> str:
    digits = f"regexp_extract(lower(trim({column}, {_BLANKS})), '^(?:0x)?([0-9a-f]{{1,16}})$', 1)"
    return f"nullif(CASE WHEN {digits} <> '' THEN CAST('0x' || {digits} AS UBIGINT) END, 0)"


def _sha(column: str) -> str:
    return f"nullif(regexp_replace(lower(trim({column}, {_BLANKS})), '^sha256:', ''), '')"


def oracle_sql() -> dict[str, str]:
    distinct_boxes = "SELECT box_id, any_value(source_name) AS source_name, any_value(split_name) AS split_name, any_value(width) AS width, any_value(height) AS height FROM boxes GROUP BY box_id"
    runs = f"""WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        runs AS (SELECT doc_id, len(w) AS n_words, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS r FROM words)"""
    checked = checks.oracle_sql(_WORDS.replace("lower(text)", "lower(coalesce(text, ''))"), _name)
    pieces = lambda pattern: f"regexp_split_to_array(coalesce(text, ''), '{pattern}')"
    share = lambda p: f"CASE WHEN len(array_to_string({p}, '')) > 0 THEN 1 - len(array_to_string(list_distinct({p}), '')) / len(array_to_string({p}, '')) ELSE 0 END"
    return checked | {
        "p5_overlaps": f"""WITH i AS (SELECT image_id, CASE WHEN {_name('split_name')} = 'train' THEN 't' WHEN {_name('split_name')} IN ('valid', 'val', 'test') THEN 'e' END AS side,
              {_sha('image_sha256')} AS sha, {_hash('phash')} AS h FROM frame_manifest
              UNION ALL SELECT image_id, 'e', {_sha('imagesha256')}, {_hash('phash')} FROM holdout_manifest),
            p AS (SELECT a.image_id AS train_id, b.image_id AS evaluation_id, coalesce(a.sha = b.sha, false) AS same, bit_count(xor(a.h, b.h)) AS d FROM (SELECT DISTINCT * FROM i WHERE side = 't') a
              JOIN (SELECT DISTINCT * FROM i WHERE side = 'e') b ON a.image_id <> b.image_id AND (a.sha = b.sha OR bit_count(xor(a.h, b.h)) <= 2))
            SELECT train_id, evaluation_id, bool_or(same) AS same_sha, min(CASE WHEN d <= 2 THEN d END)::INT AS bits FROM p GROUP BY ALL""",
        "p6_groups": f"""WITH RECURSIVE i AS (SELECT DISTINCT image_id, {_hash('phash')} AS p, {_hash('dhash64')} AS d FROM frame_manifest),
            n AS (SELECT image_id, p, d, format('{{:016x}}-{{:016x}}', p, d) AS k FROM i WHERE p IS NOT NULL AND d IS NOT NULL AND image_id IS NOT NULL), h AS (SELECT DISTINCT p, d, k FROM n),
            e AS (SELECT a.k AS x, b.k AS y FROM h a JOIN h b ON a.k <> b.k AND bit_count(xor(a.p, b.p)) <= 3 AND bit_count(xor(a.d, b.d)) <= 5),
            reach(x, y) AS (SELECT k, k FROM h UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
            g AS (SELECT y AS k, min(x) AS group_id FROM reach GROUP BY y), l AS (SELECT x AS k, count(*) AS links FROM e GROUP BY x),
            f AS (SELECT image_id, min(family_id) AS family_id FROM frame_manifest GROUP BY image_id), s AS (SELECT group_id, count(DISTINCT image_id) AS group_images FROM n JOIN g USING (k) GROUP BY group_id)
            SELECT image_id, group_id, group_images, coalesce(links, 0) AS links, family_id FROM n JOIN g USING (k) JOIN s USING (group_id) LEFT JOIN l USING (k) JOIN f USING (image_id)""",
        "p9_repetition": f"""{runs.replace('FROM documents', 'FROM docs').replace('WITH words', "WITH docs AS (SELECT row_number() OVER () AS doc_id, text FROM documents), words")},
            d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, {pieces("[.!?\n]+[ \t\r\n\f]*")} AS s, {pieces("\n[ \t\r\n\f]*\n")} AS p FROM documents)
            SELECT d.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(len(r), 0) AS runs, coalesce(len(r) - len(list_distinct(r)), 0) AS repeated_runs, round({share('s')}, 6) AS sentence_share,
            round({share('p')}, 6) AS paragraph_share, round(CASE WHEN len(r) > 0 THEN (len(r) - len(list_distinct(r))) / len(r) ELSE 0 END, 6) AS run_share FROM d JOIN runs ON runs.doc_id = d.row""",
        "p2_counts": f"""WITH b AS ({distinct_boxes}), v AS (SELECT * FROM b WHERE width IS NOT NULL AND height IS NOT NULL AND NOT isnan(width) AND NOT isnan(height))
            SELECT m.measure, source_name, split_name, count(*) AS n FROM v, (VALUES ('width'), ('area')) m(measure) GROUP BY ALL""",
        "p3_found": f"""WITH r AS (SELECT {_video('video_filename')} AS video, temporal_bin, target_bins_for_video AS t FROM frame_manifest),
            plan AS (SELECT video, max(t) AS n FROM r WHERE video IS NOT NULL GROUP BY video),
            cells AS (SELECT video, unnest(range(0, n)) AS temporal_bin FROM plan)
            SELECT * FROM cells EXCEPT SELECT video, temporal_bin FROM r""",
        "p4_found": f"""WITH RECURSIVE r AS (SELECT DISTINCT {_video('video_filename')} AS v, CASE WHEN {_name('session_group')} <> 'unknown' THEN {_name('session_group')} END AS s FROM frame_manifest),
            tie AS (SELECT DISTINCT a.v AS x, b.v AS y FROM r a JOIN r b ON a.s = b.s WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
            reach(x, y) AS (SELECT x, y FROM tie UNION SELECT reach.x, tie.y FROM reach JOIN tie ON reach.y = tie.x),
            least_one AS (SELECT y, min(x) AS x FROM reach GROUP BY y)
            SELECT x AS video_a, y AS video_b FROM least_one WHERE x <> y""",
        "p5_found": f"""WITH i AS (SELECT image_id, CASE WHEN {_name('split_name')} = 'train' THEN 't' WHEN {_name('split_name')} IN ('valid', 'val', 'test') THEN 'e' END AS side,
              {_sha('image_sha256')} AS sha, {_hash('phash')} AS h FROM frame_manifest
              UNION ALL SELECT image_id, 'e', {_sha('imagesha256')}, {_hash('phash')} FROM holdout_manifest)
            SELECT DISTINCT least(a.image_id, b.image_id) AS image_a, greatest(a.image_id, b.image_id) AS image_b FROM (SELECT DISTINCT * FROM i WHERE side = 't') a
            JOIN (SELECT DISTINCT * FROM i WHERE side = 'e') b ON a.image_id <> b.image_id AND (a.sha = b.sha OR bit_count(xor(a.h, b.h)) <= 2)""",
        "p5_counts": f"""WITH i AS (SELECT DISTINCT * FROM (SELECT image_id, CASE WHEN {_name('split_name')} = 'train' THEN 't' WHEN {_name('split_name')} IN ('valid', 'val', 'test') THEN 'e' END AS side,
              {_name('split_name')} AS split, source_name, {_sha('image_sha256')} AS sha, {_hash('phash')} AS h FROM frame_manifest
              UNION ALL SELECT image_id, 'e', 'holdout', source_name, {_sha('imagesha256')}, {_hash('phash')} FROM holdout_manifest)),
            t AS (SELECT * FROM i WHERE side = 't'), e AS (SELECT * FROM i WHERE side = 'e'),
            same AS (SELECT DISTINCT e.image_id FROM e JOIN t ON e.sha = t.sha), near AS (SELECT DISTINCT e.image_id FROM e JOIN t ON bit_count(xor(e.h, t.h)) <= 2)
            SELECT split, source_name, count(*) AS images, count(same.image_id) AS exact, count(near.image_id) AS near FROM e LEFT JOIN same USING (image_id) LEFT JOIN near USING (image_id) GROUP BY ALL""",
        "p6_found": f"""WITH i AS (SELECT DISTINCT image_id, {_hash('phash')} AS p, {_hash('dhash64')} AS d FROM frame_manifest)
            SELECT DISTINCT a.image_id AS image_a, b.image_id AS image_b FROM i a JOIN i b ON a.image_id < b.image_id
            AND bit_count(xor(a.p, b.p)) <= 3 AND bit_count(xor(a.d, b.d)) <= 5""",
        "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT item_id, {_WORDS} AS w FROM eval_passages),
            dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS k FROM d),
            pw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS k FROM p)
            SELECT DISTINCT doc_id, item_id FROM dw JOIN pw USING (k)""",
        "p9_found": f"{runs} SELECT doc_id FROM runs WHERE n_words >= 20 AND (len(r) - len(list_distinct(r))) * 10 >= len(r) * 3",
    }
