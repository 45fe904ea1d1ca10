"""Connected components by iterative minimum-label propagation over a bipartite record-entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.session import materialize, release

#: An entity with more records than this is cut into parts that a hub record ties together again.
HOT = 20_000


def _without_hot_entities(edges: DataFrame, hot: int) -> DataFrame:
    """(record, node, entity): ``node`` is the entity or a part of it; the same components, every group bounded."""
    counts = edges.groupBy("entity").agg(F.count("*").alias("__n")).where(F.col("__n") > hot)
    parts = F.ceil(F.col("__n") / F.lit(hot)).cast("bigint")
    tagged = edges.join(counts, "entity", "left").withColumn("__part", F.pmod(F.xxhash64("record"), parts))
    node = F.when(F.col("__part").isNull(), F.col("entity")).otherwise(F.concat_ws("\x02", "entity", F.col("__part").cast("string")))
    own = tagged.select("record", node.alias("node"), "entity")
    hubs = counts.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    tied = hubs.select(
        F.concat(F.lit("\x02hub:"), "entity").alias("record"), F.concat_ws("\x02", "entity", F.col("__part").cast("string")).alias("node"), "entity"
    )
    return own.unionByName(tied)


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(entity, component) for distinct ``edges`` (record, entity): the component is its least entity in byte order.

    In each round records take the least label of their entities and entities that of their records, then
    labels jump to the label of their label, so that chains of length d end in about log d rounds. Each
    round is written to the shared folder. Rows with a null record or entity are left out.
    """
    clean = edges.where(F.col("record").isNotNull() & F.col("entity").isNotNull()).select("record", "entity").distinct()
    last = materialize(clean, "edges")
    state = _without_hot_entities(last, hot).withColumn("label", F.col("entity"))
    by_record, by_node = Window.partitionBy("record"), Window.partitionBy("node")
    while True:
        pushed = state.withColumn("new", F.min("label").over(by_record)).withColumn("new", F.min("new").over(by_node))
        pushed = materialize(pushed, "labels")
        release(last)
        last = pushed
        if pushed.where(F.col("new") < F.col("label")).limit(1).count() == 0:
            break
        moved = pushed.groupBy("entity").agg(F.min("new").alias("root")).where(F.col("root") < F.col("entity"))
        used = pushed.select(F.col("new").alias("entity")).distinct()
        # Labels that have a smaller label themselves; one row per label, repeated for salts against a giant component.
        jumps = moved.join(used, "entity", "left_semi").select(F.col("entity").alias("new"), "root")
        jumps = jumps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
        salted = pushed.withColumn("salt", F.pmod(F.xxhash64("record", "node"), F.lit(8)).cast("int")).join(jumps, ["new", "salt"], "left")
        state = salted.select("record", "node", "entity", F.coalesce("root", "new").alias("label"))
    return pushed.groupBy("entity").agg(F.min("new").alias("component"))
