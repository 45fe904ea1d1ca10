"""Splits that keep related records together.

Records tied by a shared entity, directly or over others, form a group (:mod:`components`). Groups are
then assigned to splits so that the counts of every stratum come close to the proportions. The greedy
assignment sees a bounded number of units: every group that is large against the whole table, and the
small ones in hash buckets per main stratum, of each stratum as many. Every stratum has its own proportions,
however rare it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.hashing import name_key, video_key
from trailmark.llm.components import components
from trailmark.operators.skew import salted_lookup
from trailmark.session import materialize

#: Groups above 1 / LARGE of all rows are units of their own; there are fewer than LARGE of them.
LARGE = 4000
#: Buckets per stratum for all others.
BUCKETS = 128


@dataclass(frozen=True)
class Proportions:
    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1

    def items(self) -> list[tuple[str, float]]:
        return [("train", self.train), ("validation", self.validation), ("test", self.test)]


def stratum_key(c: Column) -> Column:
    """A category's name: trimmed, lower case, blanks and hyphens as underscores; null if empty."""
    return F.regexp_replace(name_key(c), "[ \\-]+", "_")


def entity_rows(manifest: DataFrame, video: str = "video_filename", session: str = "session_group") -> DataFrame:
    """``manifest`` with ``__video`` and ``__session`` as entities (``0`` and ``1`` before the name), null if none.

    The session name ``unknown`` names none. The prefix keeps the two kinds apart and sorts videos first.
    """
    own = name_key(F.col(session))
    return manifest.withColumn("__video", F.concat(F.lit("0"), video_key(F.col(video)))).withColumn(
        "__session", F.concat(F.lit("1"), F.when(own != "unknown", own))
    )


def ties(rows: DataFrame) -> DataFrame:
    """Distinct edges (record, entity); a record stands for all rows with the same video and session."""
    pairs = rows.select("__video", "__session").distinct()
    record = F.concat_ws("\x01", F.coalesce("__video", F.lit("")), F.coalesce("__session", F.lit("")))
    return pairs.select(record.alias("record"), F.explode(F.array("__video", "__session")).alias("entity")).where(F.col("entity").isNotNull())


def tied_videos(manifest: DataFrame) -> DataFrame:
    """(video_a, video_b): each video that isn't the first of its tied set, with that first one."""
    got = components(ties(entity_rows(manifest)))
    videos = got.where(F.col("entity").startswith("0") & (F.col("entity") != F.col("component")))
    return videos.select(F.substring("component", 2, 1 << 30).alias("video_a"), F.substring("entity", 2, 1 << 30).alias("video_b"))


def assign_units(units: list[tuple[np.ndarray, np.ndarray]], strata: int, shares: np.ndarray) -> np.ndarray:
    """Split of each unit (its strata and its rows of each), least squared deviation from the targets.

    Units go in order of size to the split where the deviation, each stratum weighted by its size, falls
    most; then single moves are made as long as one helps. A unit costs as much as it has strata.
    """
    # One more stratum stands for all rows, so that the whole keeps its proportions too.
    wide = [(np.append(i, strata), np.append(n, n.sum()).astype(float)) for i, n in units]
    total = np.zeros(strata + 1)
    for i, n in wide:
        total[i] += n
    w = 1.0 / np.maximum(total, 1) ** 2
    w[strata] *= strata
    target = shares[:, None] * total[None, :]
    filled, chosen = np.zeros_like(target), np.zeros(len(units), int)
    order = np.argsort([-n[-1] for _, n in wide], kind="stable")
    for u in order:
        i, n = wide[u]
        gap = filled[:, i] - target[:, i]
        chosen[u] = int(np.argmin(((gap + n) ** 2 - gap**2) @ w[i]))
        filled[chosen[u], i] += n
    for _ in range(20):
        moved = False
        for u in order:
            (i, n), own = wide[u], chosen[u]
            gap = filled[:, i] - target[:, i]
            cost = ((gap[own] - n) ** 2 - gap[own] ** 2) @ w[i] + ((gap + n) ** 2 - gap**2) @ w[i]
            cost[own] = 0.0
            best = int(np.argmin(cost))
            if cost[best] < -1e-15:
                filled[own, i] -= n
                filled[best, i] += n
                chosen[u], moved = best, True
        if not moved:
            break
    return chosen


def group_splits(manifest: DataFrame, image_id: str = "image_id", stratum: str = "subdomain_group", proportions: Proportions | None = None) -> DataFrame:
    """(image_id, component, split), a row per distinct image id and one for each row with a null id.

    No video and no session is spread over two splits; an id that is delivered under several ties them. A row
    with neither is a group of its own by its id. Repeated deliveries of an image count once. Null strata form a
    stratum. An empty table gives an empty result.
    """
    return _assigned(manifest, image_id, stratum, proportions or Proportions()).drop("stratum")


def _assigned(manifest: DataFrame, image_id: str, stratum: str, proportions: Proportions) -> DataFrame:
    """:func:`group_splits` with the stratum of each row."""
    spark = manifest.sparkSession
    rows = entity_rows(manifest.select(image_id, stratum, "video_filename", "session_group"))
    rows = rows.select(F.col(image_id).alias("image_id"), F.coalesce(stratum_key(F.col(stratum)), F.lit("")).alias("stratum"), "__video", "__session")
    # Repeated deliveries are equal; should they differ, the ties of all of them hold and the id ties them too.
    edges, own = ties(rows), F.struct("__video", "__session")
    named = rows.where(F.col("image_id").isNotNull())
    reduced = named.groupBy("image_id").agg(F.min(F.struct("__video", "__session", "stratum")).alias("r"), (~F.min(own).eqNullSafe(F.max(own))).alias("differs"))
    reduced = materialize(reduced.select("image_id", "r.*", "differs"), "images")
    differing = reduced.where("differs").select("image_id")
    if not differing.isEmpty():
        again = named.join(differing, "image_id", "left_semi")
        record = F.concat(F.lit("\x02id:"), F.col("image_id").cast("string"))
        edges = edges.unionByName(again.select(record.alias("record"), F.explode(F.array("__video", "__session")).alias("entity")).where(F.col("entity").isNotNull()).distinct())
    rows = reduced.drop("differs").unionByName(rows.where(F.col("image_id").isNull()))
    graph = materialize(components(edges), "components")
    own = F.concat(F.lit("2"), F.coalesce(F.col("image_id").cast("string"), F.lit("")))
    rows = rows.withColumn("entity", F.coalesce("__video", "__session", own))
    grouped = salted_lookup(rows, graph, ["entity"], F.col("image_id")).withColumn("component", F.coalesce("component", "entity"))
    grouped = materialize(grouped.select("image_id", "stratum", "component"), "grouped")

    cells = grouped.groupBy("component", "stratum").agg(F.count("*").alias("n"))
    total = grouped.count()
    sizes = cells.groupBy("component").agg(F.sum("n").alias("size"), F.max_by("stratum", F.struct("n", "stratum")).alias("main"))
    bucket = F.concat_ws("\x02", F.lit("small"), "main", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("string"))
    unit = F.when(F.col("size") * LARGE > total, F.concat(F.lit("large\x02"), "component")).otherwise(bucket)
    units = materialize(sizes.select("component", unit.alias("unit")), "units")
    counts = cells.join(units, "component").groupBy("unit", "stratum").agg(F.sum("n").alias("n")).orderBy("unit", "stratum").collect()
    column = {name: i for i, name in enumerate(sorted({r.stratum for r in counts}))}
    units_of: dict[str, list] = {}
    for r in counts:
        units_of.setdefault(r.unit, []).append((column[r.stratum], r.n))
    names = sorted(units_of)
    parts = [tuple(np.array(x) for x in zip(*units_of[u])) for u in names]
    chosen = assign_units(parts, len(column), np.array([p for _, p in proportions.items()]))
    labels = [s for s, _ in proportions.items()]
    decided = spark.createDataFrame([(u, labels[c]) for u, c in zip(names, chosen)], "unit string, split string")
    lookup = units.join(decided, "unit").select("component", "split")
    found = salted_lookup(grouped, lookup, ["component"], F.col("image_id"))
    return found.select("image_id", "component", "split", "stratum")


def split_report(manifest: DataFrame, proportions: Proportions | None = None) -> DataFrame:
    """(stratum, split, images, share, target): how close each stratum came."""
    proportions = proportions or Proportions()
    got = _assigned(manifest, "image_id", "subdomain_group", proportions)
    counts = got.groupBy("stratum", "split").agg(F.count("*").alias("images"))
    target = F.coalesce(*[F.when(F.col("split") == s, F.lit(p)) for s, p in proportions.items()])
    share = F.col("images") / F.sum("images").over(Window.partitionBy("stratum"))
    return counts.withColumn("share", share).withColumn("target", target)
