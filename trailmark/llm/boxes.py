"""Percentiles of box sizes with digests that combine over days and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import qdigest
from trailmark.session import materialize, scratch_path

#: Compression of the digests: a rank is off by at most 16 / 3200 = 0.5 % of the group's count.
K = 3200
PROBABILITIES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def distinct_boxes(boxes: DataFrame, *columns: str) -> DataFrame:
    """One row per box: its first delivery (by ``loaded_at``; ties by the values). A null ``box_id`` is no box."""
    picked = F.min(F.struct("loaded_at", *columns))
    return boxes.where(F.col("box_id").isNotNull()).groupBy("box_id").agg(picked.alias("b")).select("b.*")


def _measured() -> Column:
    return F.col("width").isNotNull() & F.col("height").isNotNull() & ~F.isnan("width") & ~F.isnan("height")


def measures(boxes: DataFrame, *columns: str) -> DataFrame:
    """Width and area as rows (measure, value, columns) of boxes whose width and height are there and not NaN."""
    pairs = F.array(
        F.struct(F.lit("width").alias("measure"), F.col("width").alias("value")),
        F.struct(F.lit("area").alias("measure"), (F.col("width") * F.col("height")).alias("value")),
    )
    return boxes.where(_measured()).select(*columns, F.explode(pairs).alias("m")).select("m.measure", "m.value", *columns)


KEYS = ["measure", "source_name", "split_name"]


def daily_digests(boxes: DataFrame, k: int = K) -> DataFrame:
    """Digests per labelling day, source, split and measure: the stored form that later days are added to.

    Between tasks go a number for the group, a node and a count; the names come back at the end.
    """
    group = ["day", "source_name", "split_name"]
    rows = boxes.where(F.col("box_id").isNotNull()).withColumn("day", F.to_date("labelled_at"))
    names, number = _numbered(rows.select(*group).distinct(), group)
    width, area = F.col("width"), F.col("width") * F.col("height")
    # An area is no number where one measure is infinite and the other 0: no value then.
    own = (F.col("loaded_at"), number.alias("g"), F.when(_measured(), qdigest.leaf(width)).alias("w"), F.when(_measured() & ~F.isnan(area), qdigest.leaf(area)).alias("a"))
    first = rows.select("box_id", F.struct(*own).alias("b")).groupBy("box_id").agg(F.min("b").alias("b"))
    each = F.explode(F.array(F.struct(F.lit(False).alias("m"), F.col("b.w").alias("leaf")), F.struct(F.lit(True).alias("m"), F.col("b.a").alias("leaf")))).alias("e")
    found = first.select(F.col("b.g").alias("__g"), each).where(F.col("e.leaf").isNotNull())
    nodes = found.select("__g", F.col("e.m").alias("__m"), (F.col("e.leaf") + F.lit(1 << qdigest.LEVELS)).cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("count"))
    packed = qdigest.merge(nodes, ["__g", "__m"], k).join(names, "__g")
    return packed.select("day", F.when(F.col("__m"), "area").otherwise("width").alias("measure"), "source_name", "split_name", "node", "count")


def _numbered(groups: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """(groups with ``__g``, the number as an expression): a hash of the columns, taken anew until no two groups share one."""
    seed = 0
    while True:
        number = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
        names = materialize(groups.withColumn("__g", number), "groups")
        if names.groupBy("__g").count().where("count > 1").isEmpty():
            return names, number
        seed += 1


def store_days(boxes: DataFrame, folder: str, load: int, k: int = K) -> None:
    """Write the digests of the labelling days of ``boxes`` as a numbered load below ``folder``.

    A load has whole days: a day that comes again, with late boxes say, is built from all its boxes and takes the place
    of what earlier loads have of it.
    """
    daily_digests(boxes, k).write.mode("overwrite").parquet(f"{folder}/load={load}")


def stored_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all stored days, of each day the latest load."""
    every = spark.read.parquet(folder)
    latest = every.groupBy(F.col("day").alias("__day")).agg(F.max("load").alias("__load"))
    return every.join(latest, F.col("day").eqNullSafe(F.col("__day")) & (F.col("load") == F.col("__load"))).drop("__day", "__load", "load")


def stored_percentiles(spark: SparkSession, folder: str, probabilities: list[float] | None = None, k: int = K) -> DataFrame:
    """(measure, source_name, split_name, n, p, value, rank_error) from stored digests alone, all days merged.

    Every value has a rank within ``rank_error`` of p * n, up to the width of a leaf (0.14 % of the value).
    """
    return qdigest.quantiles(qdigest.merge(stored_digests(spark, folder), KEYS, k), KEYS, probabilities or PROBABILITIES, k).drop("edge")


def percentiles(boxes: DataFrame, probabilities: list[float] | None = None, k: int = K) -> DataFrame:
    """:func:`stored_percentiles` of the days of ``boxes``, stored in the shared folder first.

    Null names form groups of their own; an empty table gives no groups.
    """
    spark = boxes.sparkSession
    folder = scratch_path(spark, "digests")
    store_days(boxes, folder, 0, k)
    return stored_percentiles(spark, folder, probabilities, k)


def rank_check(boxes: DataFrame, probabilities: list[float] | None = None, k: int = K) -> DataFrame:
    """(measure, source_name, split_name, p, n, within): whether the rank of each stated value is within its bound, by
    counting all values below and within its leaf."""
    stated = materialize(percentiles(boxes, probabilities, k), "stated")
    columns = ["source_name", "split_name"]
    values = measures(distinct_boxes(boxes, *columns, "width", "height"), *columns).withColumn("__leaf", qdigest.leaf(F.col("value")))
    counts = values.groupBy("__leaf", *KEYS).agg(F.count("*").alias("__c"))
    asked = stated.select(*[F.col(c).alias(f"__{c}") for c in KEYS], "p", "n", "rank_error", qdigest.leaf(F.col("value")).alias("__at"))
    same = (F.col("measure") == F.col("__measure")) & F.col("source_name").eqNullSafe(F.col("__source_name")) & F.col("split_name").eqNullSafe(F.col("__split_name"))
    sums = counts.join(asked, same).groupBy(*KEYS, "p", "n", "rank_error").agg(
        F.coalesce(F.sum(F.when(F.col("__leaf") < F.col("__at"), F.col("__c"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("__leaf") <= F.col("__at"), F.col("__c"))), F.lit(0)).alias("upto")
    )
    rank = F.greatest(F.ceil(F.col("p") * F.col("n")), F.lit(1))
    within = (F.col("below") + 1 - F.col("rank_error") <= rank) & (rank <= F.col("upto") + F.col("rank_error"))
    return sums.select(*KEYS, "p", "n", within.alias("within"))


def batch_check(boxes: DataFrame, published: DataFrame, k: int = K) -> DataFrame:
    """Median and 25th percentile of the area per batch beside the published values, with their ratio."""
    rows = measures(distinct_boxes(boxes, "batch_id", "width", "height"), "batch_id").where(F.col("measure") == "area")
    got = qdigest.quantiles(qdigest.build(rows, ["batch_id"], "value", k), ["batch_id"], [0.25, 0.5], k)
    wide = got.groupBy("batch_id").agg(
        F.first("n").alias("n"),
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("p25_area"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median_area"),
    )
    stated = published.select("batch_id", "median_box_area_ratio", "p25_box_area_ratio")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return (
        stated.join(wide, "batch_id", "left")
        .withColumn("median_to_published", ratio("median_area", "median_box_area_ratio"))
        .withColumn("p25_to_published", ratio("p25_area", "p25_box_area_ratio"))
    )
