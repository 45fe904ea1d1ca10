"""Images that stand in training and in evaluation, exactly or nearly.

A SHA is a vector of one term. A perceptual hash is cut into five blocks of 12 or 13 bits and is a unit vector
over its ten pairs of blocks: two hashes that differ in at most 2 bits agree in three blocks at least, hence in
three pairs, so that their cosine is at least 0.3. The residual norm then leaves out two terms of a hash whose
terms all stand on the other side, and a hash with fewer than three such terms altogether. The cosine join runs
over distinct hashes; images come in at the end.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.hashing import hamming, hash64, name_key, sha_key
from trailmark.llm.cosine import cosine_join
from trailmark.operators.skew import expand_pairs, member_chunks
from trailmark.session import materialize

EVALUATION = ("valid", "val", "test")
_TERM = "array<struct<term: bigint, weight: double, parts: array<bigint>>>"


def images(manifest: DataFrame, holdout: DataFrame) -> DataFrame:
    """(image_id, side, split, source_name, sha, phash) of all rows; ``side`` is train or evaluation, holdout's split is holdout.

    Images of other splits and null ids are left out; an image stands as often as it was delivered.
    """
    split = name_key(F.col("split_name"))
    side = F.when(split == "train", "train").when(split.isin(*EVALUATION), "evaluation")
    own = manifest.where(split.isin("train", *EVALUATION)).select(
        "image_id", side.alias("side"), split.alias("split"), "source_name", sha_key(F.col("image_sha256")).alias("sha"), hash64(F.col("phash")).alias("phash")
    )
    held = holdout.select(
        "image_id", F.lit("evaluation").alias("side"), F.lit("holdout").alias("split"), "source_name", sha_key(F.col("imagesha256")).alias("sha"), hash64(F.col("phash")).alias("phash")
    )
    return own.unionByName(held).where(F.col("image_id").isNotNull())


#: Blocks of a hash by their first bit, and their end.
_EDGES = (0, 12, 25, 38, 51, 64)
_PAIRS = tuple(combinations(range(5), 2))
#: Cosine of hashes that agree in three blocks, hence in three of the ten pairs.
LEAST_COSINE = 0.3


def _block(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, _EDGES[i]).bitwiseAND((1 << (_EDGES[i + 1] - _EDGES[i])) - 1)


def phash_terms(h: Column) -> Column:
    """Ten terms; the parts of a term are its three other blocks, one of which at least is equal for near hashes."""
    terms = []
    for n, (i, j) in enumerate(_PAIRS):
        # Pair and bits in one number: the pairs are told apart by the bits above.
        term = F.lit(n << 26).cast("bigint") + F.shiftleft(_block(h, i), 13) + _block(h, j)
        parts = [F.lit(k << 13).cast("bigint") + _block(h, k) for k in range(5) if k not in (i, j)]
        terms.append(F.struct(term.alias("term"), F.lit(len(_PAIRS) ** -0.5).alias("weight"), F.array(*parts).alias("parts")))
    return F.array(*terms).cast(_TERM)


def vectors(rows: DataFrame) -> DataFrame:
    """(key, terms) of the distinct SHAs and hashes."""
    sha = rows.where(F.col("sha").isNotNull()).select(F.concat(F.lit("s"), "sha").alias("key")).distinct()
    one = F.struct(F.xxhash64("key").alias("term"), F.lit(1.0).alias("weight"), F.array().cast("array<bigint>").alias("parts"))
    near = rows.where(F.col("phash").isNotNull()).select("phash").distinct()
    return sha.select("key", F.array(one).cast(_TERM).alias("terms")).unionByName(
        near.select(F.concat(F.lit("p"), F.col("phash").cast("string")).alias("key"), phash_terms(F.col("phash")).alias("terms"))
    )


def members(rows: DataFrame) -> DataFrame:
    """(key, image_id and its columns): an image stands under its SHA and its hash."""
    keys = F.array_compact(F.array(F.concat(F.lit("s"), "sha"), F.concat(F.lit("p"), F.col("phash").cast("string"))))
    return rows.select(F.explode(keys).alias("key"), "image_id", "split", "source_name")


def key_pairs(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """(key_a of training, key_b of evaluation, bits): equal SHAs (bits null) and hashes within ``max_bits`` (at most 2)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the terms guarantee hashes within 2 bits only")
    train, evaluation = rows.where(F.col("side") == "train"), rows.where(F.col("side") == "evaluation")
    met = cosine_join(vectors(train), vectors(evaluation), LEAST_COSINE)
    near = F.col("left_key").startswith("p") & F.col("right_key").startswith("p")
    number = lambda c: F.substring(c, 2, 32).cast("bigint")
    bits = F.when(near, hamming(number("left_key"), number("right_key")))
    exact = F.col("left_key").startswith("s") & (F.col("left_key") == F.col("right_key"))
    return met.withColumn("bits", bits).where(exact | (F.col("bits") <= max_bits)).select(F.col("left_key").alias("key_a"), F.col("right_key").alias("key_b"), "bits")


def overlapping_images(manifest: DataFrame, holdout: DataFrame, max_bits: int = 2) -> DataFrame:
    """(train_id, evaluation_id, same_sha, bits): every pair once, ``bits`` the distance of the hashes if they are near.

    Null, empty and unusable hashes match nothing; repeated deliveries count once; empty tables give no pair.
    """
    rows = materialize(images(manifest, holdout), "images")
    pairs = materialize(key_pairs(rows, max_bits), "pairs")

    def chunks(side: str, key: str) -> DataFrame:
        # Only images whose SHA or hash stands in a pair go on.
        own = members(rows.where(F.col("side") == side)).select("key", "image_id").join(pairs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
        return member_chunks(own.distinct(), "key", "image_id")

    out = expand_pairs(pairs, chunks("train", "key_a"), chunks("evaluation", "key_b")).where(F.col("a") != F.col("b"))
    return out.groupBy(F.col("a").alias("train_id"), F.col("b").alias("evaluation_id")).agg(F.bool_or(F.col("bits").isNull()).alias("same_sha"), F.min("bits").alias("bits"))


def overlap_counts(manifest: DataFrame, holdout: DataFrame, max_bits: int = 2) -> DataFrame:
    """(split, source_name, images, exact, near): evaluation images, those with the SHA and those with a near hash in training.

    Counted over hashes; no pair of images is made.
    """
    rows = materialize(images(manifest, holdout), "images")
    pairs = key_pairs(rows, max_bits)
    hit = pairs.select(F.col("key_b").alias("key")).distinct()
    held = members(rows.where(F.col("side") == "evaluation"))
    found = held.join(hit, "key", "left_semi").groupBy("image_id", "split", "source_name").agg(
        F.bool_or(F.col("key").startswith("s")).alias("exact"), F.bool_or(F.col("key").startswith("p")).alias("near")
    )
    per = found.groupBy("split", "source_name").agg(F.count_if("exact").alias("exact"), F.count_if("near").alias("near"))
    every = rows.where(F.col("side") == "evaluation").select("image_id", "split", "source_name").distinct().groupBy("split", "source_name").agg(F.count("*").alias("images"))
    per = per.select(F.col("split").alias("s"), F.col("source_name").alias("n"), "exact", "near")
    joined = every.join(per, (F.col("split") == F.col("s")) & F.col("source_name").eqNullSafe(F.col("n")), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("split", "source_name", "images", F.coalesce("exact", zero).alias("exact"), F.coalesce("near", zero).alias("near"))
