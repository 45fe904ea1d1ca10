"""Weighted cosine join of two sets of term-weight vectors over inverted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.skew import HOT_ROWS, salted_lookup
from trailmark.session import materialize

#: A list where more pairs than this would meet is cut by its members' ``parts``.
HOT_PAIRS = 1_000_000


def _postings(vectors: DataFrame) -> DataFrame:
    return vectors.select("key", F.explode("terms").alias("t")).select("key", "t.term", "t.weight", "t.parts")


def _statistics(left: DataFrame, right: DataFrame) -> DataFrame:
    """(term, n_left, n_right, max_left, max_right) of the terms that both sides have, in one aggregation."""
    sides = left.select("term", "weight", F.lit(True).alias("l")).unionByName(right.select("term", "weight", F.lit(False).alias("l")))
    here, there = F.col("l"), ~F.col("l")
    counted = sides.groupBy("term").agg(
        F.count_if(here).alias("n_left"), F.count_if(there).alias("n_right"),
        F.max(F.when(here, F.col("weight"))).alias("max_left"), F.max(F.when(there, F.col("weight"))).alias("max_right"),
    )
    return counted.where((F.col("n_left") > 0) & (F.col("n_right") > 0))


def _prefix(terms: Column, threshold: float) -> Column:
    """The terms that must be indexed: from the end, terms go as long as what is left out can't reach the threshold.

    What a left-out suffix can add to a dot product is at most the sum of weight times the other side's largest
    weight of the term, and at most its norm (the other vector is a unit vector).
    """
    start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square"), F.lit(0).alias("cut"))

    def step(acc: Column, t: Column) -> Column:
        dot, square = acc.dot + t.weight * t.other, acc.square + t.weight * t.weight
        out = F.least(dot, F.sqrt(square)) < threshold - 1e-9
        return F.struct(dot.alias("dot"), square.alias("square"), F.when(out, acc.cut + 1).otherwise(acc.cut).alias("cut"))

    cut = F.aggregate(F.reverse(terms), start, step, lambda acc: acc.cut)
    # A vector whose whole bound stays below the threshold is cut entirely.
    return F.slice(terms, F.lit(1), F.size(terms) - cut)


def _indexed(postings: DataFrame, both: DataFrame, other: str, threshold: float) -> DataFrame:
    """(key, vector, term, parts, hot): prefix postings of the vectors that can reach the threshold at all."""
    live = salted_lookup(postings, both, ["term"], F.col("key"), how="inner", hot=both.where(F.col("n_left") + F.col("n_right") > HOT_ROWS))
    entry = F.struct((F.col("n_left") + F.col("n_right")).alias("n"), "term", "weight", F.col(other).alias("other"), "parts", "hot")
    vectors = live.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("terms"))
    vector = F.transform("terms", lambda t: F.struct(t.term.alias("term"), t.weight.alias("weight")))
    return vectors.select("key", vector.alias("vector"), F.explode(_prefix(F.col("terms"), threshold)).alias("t")).select("key", "vector", "t.term", "t.parts", "t.hot")


def _dot(a: Column, b: Column) -> Column:
    """Exact dot product of two arrays of (term, weight)."""
    matched = lambda t: F.aggregate(b, F.lit(0.0), lambda s, u: s + F.when(u.term == t.term, u.weight).otherwise(0.0))
    return F.aggregate(a, F.lit(0.0), lambda s, t: s + t.weight * matched(t))


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key, cosine) of all pairs with a cosine of at least ``threshold``, each once.

    Both sides: ``key`` (distinct), ``terms`` array<struct<term bigint, weight double, parts array<bigint>>>, unit
    vectors of non-negative weights with distinct terms. Terms that one side lacks have the largest weight 0
    there and are dropped, then vectors that can't reach the threshold, then the suffix of each vector in the
    order of rising list length. The pair's first common term in that order lies in both prefixes.

    Of a list where more than ``HOT_PAIRS`` would meet only members that agree in one of ``parts`` are
    compared. The caller guarantees that every wanted pair that shares the term agrees in a part; a term
    whose parts are empty has no such guarantee and keeps its list. Pairs are verified within the join.
    """
    lp, rp = _postings(left), _postings(right)
    both = _statistics(lp, rp)
    both = materialize(both.withColumn("hot", F.col("n_left") * F.col("n_right") > HOT_PAIRS), "lists")

    def keyed(postings: DataFrame, other: str) -> DataFrame:
        rows = _indexed(postings, both, other, threshold)
        cut = F.col("hot") & (F.size("parts") > 0)
        spots = F.when(cut, F.transform("parts", lambda p: F.xxhash64(F.col("term"), p))).otherwise(F.array("term"))
        return rows.select("key", "vector", F.explode(spots).alias("spot"))

    a = keyed(lp, "max_right").select(F.col("key").alias("left_key"), F.col("vector").alias("left_vector"), "spot")
    b = keyed(rp, "max_left").select(F.col("key").alias("right_key"), F.col("vector").alias("right_vector"), "spot")
    dot = _dot(F.col("left_vector"), F.col("right_vector"))
    met = a.join(b, "spot").select("left_key", "right_key", dot.alias("cosine")).where(F.col("cosine") >= threshold - 1e-9)
    return met.distinct()
