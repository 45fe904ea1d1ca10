"""Identity of files and images by hash: checks, leakage, near duplicates."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.hashing import hamming
from trailmark.session import materialize

UNKNOWN_MODEL = "CUSTOM / UNREGISTERED"
#: Cost of writing a join key against that of comparing a pair.
KEY_COST = 10.0


def content_sha(content: Column) -> Column:
    return F.sha2(content, 256)


def check_sha(actual: Column, expected: Column) -> Column:
    """The actual hash if it equals the expected one, case aside; else the query fails."""
    return F.when(F.lower(actual) == F.lower(expected), actual).otherwise(F.raise_error(F.concat(F.lit("sha256 mismatch: "), F.coalesce(actual, F.lit("null")))))


def identify(models: DataFrame, registry: DataFrame, sha: str, name: str) -> DataFrame:
    """Add the registered name of a hash, case aside; others are custom. The registry is a table of models (few rows)."""
    known = registry.groupBy(F.lower(sha).alias("__s")).agg(F.min(name).alias("identity"))
    joined = models.join(known, F.lower(models[sha]) == F.col("__s"), "left").drop("__s")
    return joined.withColumn("identity", F.coalesce("identity", F.lit(UNKNOWN_MODEL)))


def overrides(actual: Column, canonical: Column) -> Column:
    """Map of parameters whose value isn't the canonical one: name to (canonical, actual)."""
    both = F.map_zip_with(canonical, actual, lambda k, c, a: F.struct(c.alias("canonical"), a.alias("actual")))
    return F.map_filter(both, lambda k, v: ~v.canonical.eqNullSafe(v.actual))


def leakage(selected: DataFrame, reference: DataFrame, sha: str, group: str) -> DataFrame:
    """Per reference group: its hashes, and those that stand in ``selected`` too."""
    own = selected.select(sha).where(F.col(sha).isNotNull()).distinct().withColumn("__hit", F.lit(1))
    groups = reference.select(group, sha).where(F.col(sha).isNotNull()).distinct()
    return groups.join(own, sha, "left").groupBy(group).agg(F.count("*").alias("hashes"), F.count("__hit").alias("leaked"))


def _blocks(n: int, max_bits: int, bits: int) -> tuple[int, int]:
    """(blocks, how many of them a key has) of least expected cost for ``n`` hashes: keys to write and rows to compare."""
    def cost(equal: int) -> float:
        blocks = max_bits + equal
        return comb(blocks, equal) * (KEY_COST + n / 2 ** (bits * equal / blocks))

    equal = min(range(1, 5), key=cost)
    return max_bits + equal, equal


def hamming_pairs(hashes: DataFrame, key: str, max_bits: int, bits: int = 64) -> DataFrame:
    """Pairs of distinct hash values within ``max_bits``: (hash_a, hash_b, distance).

    Values are cut into ``max_bits`` + r blocks, of which at least r are equal in any such pair; every choice of r
    blocks is a join key, r growing with the number of values so that lists stay short. The distance is part of the
    join, so nothing else leaves it. A pair comes out under its first r equal blocks only, which saves a distinct.
    Works on distinct values: copies don't multiply.
    """
    value = materialize(hashes.where(F.col(key).isNotNull()).select(F.col(key).alias("h")).distinct(), "values")
    m, equal = _blocks(value.count(), max_bits, bits)
    edges = [bits * i // m for i in range(m + 1)]

    def block(h: Column, i: int) -> Column:
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1).cast("bigint"))

    h = F.col("h")
    choices = list(combinations(range(m), equal))
    keys = F.array(*[F.struct(F.lit(c).alias("i"), F.xxhash64(*[block(h, i) for i in chosen]).alias("v")) for c, chosen in enumerate(choices)])
    keyed = value.select("h", F.explode(keys).alias("b")).select("h", "b.i", "b.v")
    a, b = keyed.select(F.col("h").alias("hash_a"), "i", "v"), keyed.select(F.col("h").alias("hash_b"), "i", "v")
    same = F.lit(0)
    for i in range(m):
        same = same.bitwiseOR(F.when(block(F.col("hash_a"), i) == block(F.col("hash_b"), i), F.lit(1 << i)).otherwise(F.lit(0)))
    # The first r equal blocks are the key's: up to its last block nothing else is equal.
    masks = F.array(*[F.lit(sum(1 << i for i in chosen)) for chosen in choices])
    upto = F.array(*[F.lit((2 << chosen[-1]) - 1) for chosen in choices])
    first = same.bitwiseAND(F.get(upto, F.col("i"))) == F.get(masks, F.col("i"))
    distance = hamming(F.col("hash_a"), F.col("hash_b"))
    met = a.join(b, ["i", "v"]).where((F.col("hash_a") < F.col("hash_b")) & (distance <= max_bits)).where(first)
    return met.select("hash_a", "hash_b", distance.cast("int").alias("distance"))


def families(members: DataFrame, family: str, item: str, hash_: str) -> DataFrame:
    """(family, representative, item, distance) of each member of a family, its representative being the least item with
    a hash; members without a hash have no distance."""
    first = members.where(F.col(hash_).isNotNull()).groupBy(family).agg(F.min_by(F.struct(F.col(item).alias("r"), F.col(hash_).alias("h")), F.col(item)).alias("__f"))
    joined = members.join(first, family, "left")
    return joined.select(family, F.col("__f.r").alias("representative"), item, hamming(F.col(hash_), F.col("__f.h")).alias("distance"))


def set_hash(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One SHA-256 over the distinct values of each key, and their number.

    Values are put into 4,096 buckets by the first digits of their own hash; each bucket's sorted values are hashed,
    then the buckets' hashes in order. So no task holds more than a small part of a key's values.
    """
    text = F.col(value).cast("string")
    placed = rows.where(F.col(value).isNotNull()).select(*keys, text.alias("__v"), F.substring(F.sha2(text, 256), 1, 3).alias("__b"))
    buckets = placed.groupBy(*keys, "__b").agg(F.sort_array(F.collect_set("__v")).alias("__s"))
    buckets = buckets.select(*keys, "__b", F.size("__s").cast("bigint").alias("__n"), F.sha2(F.array_join("__s", "\n"), 256).alias("__h"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__b", "__h"))), lambda s: s["__h"])
    return buckets.groupBy(*keys).agg(F.sum("__n").alias("files"), F.sha2(F.array_join(ordered, "\n"), 256).alias("content_hash"))


def split_overlap(rows: DataFrame, split: str, name: str) -> DataFrame:
    """Names that stand in more than one split: (name, splits)."""
    groups = rows.where(F.col(name).isNotNull() & F.col(split).isNotNull()).groupBy(name).agg(F.sort_array(F.collect_set(split)).alias("__s"))
    return groups.where(F.size("__s") > 1).select(name, F.array_join("__s", ",").alias("splits"))


def path_report(rows: DataFrame, split: str, path: str, source: str, forbidden: list[str]) -> DataFrame:
    """(finding, value, splits, copies): names in several splits, relative paths that stand twice in a split, and rows of
    forbidden sources. Empty where a dataset leaks nothing."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    names = split_overlap(rows.withColumn("__name", name), split, "__name").select(F.lit("name in several splits").alias("finding"), F.col("__name").alias("value"), "splits", F.lit(None).cast("bigint").alias("copies"))
    twice = rows.where(F.col(path).isNotNull()).groupBy(F.col(split).alias("splits"), F.col(path).alias("value")).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    found = rows.where(F.col(source).isin(forbidden)).groupBy(F.col(source).alias("value"), F.col(split).alias("splits")).agg(F.count("*").alias("copies"))
    return names.unionByName(twice.select(F.lit("path stands twice").alias("finding"), "value", "splits", "copies")).unionByName(found.select(F.lit("forbidden source").alias("finding"), "value", "splits", "copies"))
