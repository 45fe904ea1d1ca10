"""Queries that hold results to their guarantees: each has a determined answer, so that SQL can state it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.hashing import video_key
from trailmark.llm import boxes, leakage, mixing, repetition, sampling, splits
from trailmark.session import materialize, read_table, scratch_path


def _counts(spark: SparkSession, violations: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): rows of each table."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in violations.items()]
    return reduce(DataFrame.unionByName, parts)


def p2_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Every stated percentile of p2_percentiles held against the exact ranks of all values."""
    return boxes.rank_check(read_table(spark, folder, "boxes"))


def p2_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Values behind each group after loads of odd days, of even days, and of days that came again."""
    rows, place = read_table(spark, folder, "boxes"), scratch_path(spark, "digests")
    day = F.coalesce(F.dayofyear("labelled_at"), F.lit(0))
    for load, some in enumerate((day % 2 == 1, day % 2 == 0, day % 10 == 3)):
        boxes.store_days(rows.where(some), place, load)
    return boxes.stored_percentiles(spark, place, [0.5]).select("measure", "source_name", "split_name", "n")


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The sample against its quotas: both margins, every cell, one image of each video before a second."""
    manifest = read_table(spark, folder, "frame_manifest")
    targets = read_table(spark, folder, "sampling_targets")
    got = sampling.stratified_sample(manifest, targets)
    cells = got.quotas
    off = lambda df: df.where((F.col("q") < F.floor(F.col("f") + 1e-7)) | (F.col("q") > F.ceil(F.col("f") - 1e-7)))
    margin = lambda *by: off(cells.groupBy(*by).agg(F.sum("quota").alias("q"), F.sum("fraction").alias("f")))
    name = ["subdomain_group", "temporal_bin"]
    drawn = got.sample.groupBy(*name).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"_{c}") for c in name], "n")
    same = (F.col("subdomain_group") == F.col("_subdomain_group")) & F.col("temporal_bin").eqNullSafe(F.col("_temporal_bin"))
    unlike = cells.where(F.col("quota") > 0).join(drawn, same, "full").where(~F.col("quota").eqNullSafe(F.col("n")))
    rows = manifest.select("image_id", video_key(F.col("video_filename")).alias("video"), splits.stratum_key(F.col("subdomain_group")).alias("subdomain_group"), F.col("temporal_bin").cast("bigint").alias("temporal_bin")).distinct()
    planned = got.sample.where(F.col("temporal_bin").isNotNull())
    taken = planned.groupBy("video", *name).agg(F.count("*").alias("taken"))
    # Only bins of a video's own plan are cells; its other images stand in none.
    inside = rows.join(sampling.video_plans(manifest), "video").where((F.col("temporal_bin") >= 0) & (F.col("temporal_bin") < F.col("plan")))
    have = inside.groupBy("video", *name).agg(F.count_distinct("image_id").alias("supply"))
    most = taken.groupBy(*name).agg(F.max("taken").alias("most"))
    uneven = have.join(most, name).join(taken, ["video", *name], "left").where(F.coalesce("taken", F.lit(0)) < F.least("supply", F.col("most") - 1))
    foreign = got.sample.join(rows.select("image_id", "subdomain_group"), ["image_id", "subdomain_group"], "left_anti")
    group = got.groups
    return _counts(
        spark,
        {
            "cell rounded by more than one": off(cells.withColumn("q", F.col("quota")).withColumn("f", F.col("fraction"))),
            "group margin not kept": margin("subdomain_group"),
            "bin margin not kept": margin("temporal_bin"),
            "cell not drawn as its quota": unlike,
            "group short of its quota with images left": group.where((F.col("missing") > 0) & (F.col("taken") < F.col("supply"))),
            "group below its minimum with images left": group.where((F.col("taken") < F.col("min_images")) & (F.col("taken") < F.col("supply"))),
            "image drawn twice": got.sample.groupBy("image_id").count().where("count > 1"),
            "image of another group": foreign,
            "video drawn again before another": uneven,
        },
    )


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The splits against their rules: nothing spread, nothing lost, every stratum near its proportions."""
    manifest = read_table(spark, folder, "frame_manifest")
    got = materialize(splits.group_splits(manifest), "splits")
    rows = splits.entity_rows(manifest).select("image_id", "__video", "__session").join(got.select("image_id", "split"), "image_id")
    spread = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).where("n > 1")
    ids = manifest.select("image_id").distinct()
    report = splits.split_report(manifest)
    sizes = report.groupBy("stratum").agg(F.sum("images").alias("all"))
    # A group can't be cut: what one of it weighs in its stratum is the tolerance, and 2 % at least.
    parts = got.join(manifest.groupBy("image_id").agg(F.coalesce(splits.stratum_key(F.min("subdomain_group")), F.lit("")).alias("stratum")), "image_id")
    largest = parts.groupBy("stratum", "component").agg(F.count("*").alias("n")).groupBy("stratum").agg(F.max("n").alias("largest"))
    off = report.join(sizes, "stratum").join(largest, "stratum").where(F.abs(F.col("share") - F.col("target")) > F.greatest(F.lit(0.02), F.col("largest") / F.col("all")))
    return _counts(
        spark,
        {
            "video over two splits": spread("__video"),
            "session over two splits": spread("__session"),
            "image without a split": ids.join(got, "image_id", "left_anti"),
            "image with two splits": got.groupBy("image_id").count().where("count > 1"),
            "stratum off its proportions": off,
        },
    )


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Whole items in documents within a fifth of their words as edits, with the fewest edits."""
    hits = leakage.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_passages"))
    return hits.where(F.col("item_edits").isNotNull()).select("doc_id", "item_id", "item_edits")


_KINDS = ("replaced", "inserted", "dropped", "two replaced", "two inserted", "two dropped", "inserted and dropped")


def p7_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, cases, reached): the first 12 words of every item of 12 or more, edited and put between words of their own,
    and whether nine in ten or more are found as windows of their item."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    items = read_table(spark, folder, "eval_passages").select("item_id", words.alias("w")).where(F.size("w") >= 12)
    new = lambda k: F.array(F.concat(F.lit(f"new{k}x"), F.col("item_id").cast("string")))
    at = F.pmod(F.xxhash64("item_id"), F.lit(5)).cast("int")  # places 1 to 5 and 7 to 11

    def edit(w: Column, kind: str, place: Column, k: int) -> Column:
        head, rest = F.slice(w, F.lit(1), place), F.slice(w, place + (1 if kind == "inserted" else 2), F.size(w))
        return F.concat(head, rest) if kind == "dropped" else F.concat(head, new(k), rest)

    parts = []
    first = F.slice("w", 1, 12)
    for kind in _KINDS:
        one, two = (kind.split(" ")[0], kind.split(" ")[-1]) if " and " in kind else (kind.split(" ")[-1], kind.split(" ")[-1])
        w = edit(first, one, at + 1, 1)
        if " " in kind:
            w = edit(w, two, at + 6, 2)
        pad = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("pad"), i.cast("string"), F.lit("y"), F.col("item_id").cast("string")))
        parts.append(items.select(F.lit(kind).alias("kind"), F.col("item_id").alias("own"), F.array_join(F.concat(pad, w, pad), " ").alias("text")))
    planted = materialize(reduce(DataFrame.unionByName, parts).withColumn("doc_id", F.xxhash64("kind", "own")), "planted")
    source = items.select("item_id", F.array_join("w", " ").alias("text"))
    hits = leakage.find_leaks(planted, source, item_edits=None).where(F.col("windows") > 0).select("doc_id", F.col("item_id").alias("own")).distinct().withColumn("hit", F.lit(1))
    counted = planted.join(hits, ["doc_id", "own"], "left").groupBy("kind").agg(F.count("*").alias("cases"), F.count("hit").alias("found"))
    return counted.select("kind", "cases", (F.col("found") >= 0.9 * F.col("cases")).alias("reached"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture against its rules: copies of each document and source, caps, and tokens near their goals."""
    got = mixing.mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mixing_targets"))
    report = materialize(got.report, "report")
    due = report.where(F.col("source").isNotNull()).select("source", "expected_copies", "max_repeats", "documents", "at_cap")
    copies = got.copies.join(due, "source")
    e = F.col("expected_copies")
    per = copies.groupBy("source", "expected_copies", "documents").agg(F.sum("copies").alias("n"), F.count("*").alias("used"))
    # Documents are taken at even steps along their lengths, so that a source misses its goal by its longest at most,
    # besides what the unit of expected copies rounds off.
    slack = F.col("tokens_in") / F.lit(float(mixing.UNIT))
    return _counts(
        spark,
        {
            "copies not next to their expectation": copies.where((F.col("copies") < F.floor(e - 1e-6)) | (F.col("copies") > F.ceil(e + 1e-6))),
            "copies above the cap": copies.where(F.col("copies") > F.col("max_repeats")),
            "document left out that is due one": per.where((e >= 1) & (F.col("used") < F.col("documents"))),
            "source's copies off by one or more": per.where(F.abs(F.col("n") - e * F.col("documents")) >= 1 + 1e-6 * F.col("documents")),
            "source off its goal though not at its cap": report.where((F.col("documents") > 0) & ~F.col("at_cap") & (F.col("target_share") > 0) & (F.abs("tokens_beyond_goal") > F.col("longest") + slack)),
            "source below its goal though not at its cap": report.where((F.col("tokens_beyond_goal") < -F.col("longest") - slack) & ~F.col("at_cap") & (F.col("documents") > 0)),
        },
    )


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the mixture's report with their documents, targets and caps."""
    report = mixing.mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mixing_targets")).report
    return report.select("source", "documents", F.round("target_share", 6).alias("target_share"), "max_repeats")


def p9_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Every threshold of p9_flagged held against the exact ranks of all shares."""
    return repetition.threshold_check(read_table(spark, folder, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_ranks, p2_stored, p3_checks, p4_checks, p7_whole, p7_recall, p8_checks, p8_sources, p9_thresholds)}


def _none(*names: str) -> str:
    return 'SELECT "check", 0::BIGINT AS violations FROM (VALUES ' + ", ".join(f"('{n}')" for n in names) + ') t("check")'


def oracle_sql(words: str, name) -> dict[str, str]:
    values = """b AS (SELECT box_id, any_value(source_name) AS source_name, any_value(split_name) AS split_name, any_value(width) AS width, any_value(height) AS height FROM boxes GROUP BY box_id),
        v AS (SELECT * FROM b WHERE width IS NOT NULL AND height IS NOT NULL AND NOT isnan(width) AND NOT isnan(height)),
        c AS (SELECT m.measure, source_name, split_name, count(*) AS n FROM v, (VALUES ('width'), ('area')) m(measure) GROUP BY ALL)"""
    steps = ", ".join(f"({p}::DOUBLE)" for p in boxes.PROBABILITIES)
    source = name("source")
    return {
        "p2_ranks": f"WITH {values} SELECT c.*, p, true AS within FROM c, (VALUES {steps}) s(p)",
        "p2_stored": f"WITH {values} SELECT * FROM c",
        "p3_checks": _none(
            "cell rounded by more than one", "group margin not kept", "bin margin not kept", "cell not drawn as its quota", "group short of its quota with images left",
            "group below its minimum with images left", "image drawn twice", "image of another group", "video drawn again before another",
        ),
        "p4_checks": _none("video over two splits", "session over two splits", "image without a split", "image with two splits", "stratum off its proportions"),
        # The edit distance row by row over a document's words, an item's prefixes in a list; items share at least the runs
        # of three words that the edits must leave.
        "p7_whole": f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents), p AS (SELECT item_id, {words} AS w FROM eval_passages),
            dg AS (SELECT doc_id, array_to_string(g, ' ') AS k, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM d) GROUP BY ALL),
            pg AS (SELECT item_id, array_to_string(g, ' ') AS k, count(*) AS n FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM p) GROUP BY ALL),
            met AS (SELECT doc_id, item_id, sum(least(dg.n, pg.n)) AS n FROM dg JOIN pg USING (k) GROUP BY doc_id, item_id),
            near AS (SELECT doc_id, item_id FROM met JOIN p USING (item_id) WHERE n >= len(w) - 2 - 3 * floor(len(w) * 0.2::DOUBLE)),
            pairs AS (SELECT doc_id, item_id, d.w AS t, p.w AS q FROM near JOIN d USING (doc_id) JOIN p USING (item_id)),
            step(doc_id, item_id, i, row, best) AS (
              SELECT doc_id, item_id, 0, range(0, len(q) + 1), len(q) FROM pairs
              UNION ALL
              SELECT doc_id, item_id, i + 1, new_row, least(best, new_row[-1]) FROM (
                SELECT *, list_transform(range(0, len(a)), lambda j: (j + list_min(list_transform(a[1:j + 1], lambda x, k: x - (k - 1))))::BIGINT) AS new_row FROM (
                  SELECT step.*, list_concat([0::BIGINT], list_transform(range(1, len(q) + 1), lambda j: least(row[j] + CASE WHEN q[j] = t[i + 1] THEN 0 ELSE 1 END, row[j + 1] + 1))) AS a
                  FROM step JOIN pairs USING (doc_id, item_id) WHERE i < len(t))))
            SELECT doc_id, item_id, min(best)::INT AS item_edits FROM step JOIN p USING (item_id) GROUP BY doc_id, item_id, len(w) HAVING min(best) <= floor(len(w) * 0.2::DOUBLE)""",
        "p7_recall": f"""WITH p AS (SELECT item_id, {words} AS w FROM eval_passages) SELECT kind, (SELECT count(*) FROM p WHERE len(w) >= 12) AS cases, true AS reached FROM (VALUES {", ".join(f"('{k}')" for k in _KINDS)}) t(kind)""",
        "p8_checks": _none(
            "copies not next to their expectation", "copies above the cap", "document left out that is due one", "source's copies off by one or more".replace("'", "''"),
            "source off its goal though not at its cap", "source below its goal though not at its cap",
        ),
        "p8_sources": f"""WITH t AS (SELECT {source} AS source, coalesce(sum(target_weight), 0) AS w, coalesce(max(max_repeats), 0) AS c FROM mixing_targets WHERE {source} IS NOT NULL GROUP BY ALL),
            d AS (SELECT {source} AS source, count(*) AS n FROM documents GROUP BY ALL)
            SELECT t.source, coalesce(d.n, 0) AS documents, round(w / (SELECT sum(w) FROM t), 6) AS target_share, c::INT AS max_repeats FROM t LEFT JOIN d USING (source)
            UNION ALL SELECT NULL, sum(n)::BIGINT, 0.0, 0 FROM d WHERE source IS NULL OR source NOT IN (SELECT source FROM t) HAVING count(*) > 0""",
        "p9_thresholds": f"""WITH w AS (SELECT lang, source, len({words}) AS n FROM documents) SELECT lang, source, measure, count(*) AS n, true AS within FROM w,
            (VALUES ('run_share'), ('sentence_share'), ('paragraph_share')) m(measure) WHERE w.n >= 5 GROUP BY ALL""",
    }
