"""Temporal sampling and splitting of frames, per stream and without a single global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.numeric import half_even
from trailmark.operators.ranking import exact_rank
from trailmark.session import materialize

#: Fixed value: frame number and time in the names of extracted frames.
_NAME = r"_frame_(\d+)_t(\d+)[-.](\d+)"


def name_frame(name: Column) -> Column:
    """Frame number in a file name; null if the pattern isn't in it."""
    return F.nullif(F.regexp_extract(name, _NAME, 1), F.lit("")).cast("bigint")


def name_timestamp(name: Column) -> Column:
    """Seconds in a file name, whole and fraction apart."""
    return F.nullif(F.concat_ws(".", F.nullif(F.regexp_extract(name, _NAME, 2), F.lit("")), F.nullif(F.regexp_extract(name, _NAME, 3), F.lit(""))), F.lit("")).cast("double")


def frame_name(stem: Column, frame: Column, seconds: Column, extension: str = ".jpg") -> Column:
    return F.concat(F.format_string("%s_frame_%06d_t%08.3f", stem, frame, seconds), F.lit(extension))


def sequence_name(frame: Column, extension: str = ".jpg") -> Column:
    if not extension.startswith("."):
        raise ValueError("the extension must start with a dot")
    return F.when(frame >= 1, F.concat(F.format_string("%06d", frame), F.lit(extension)))


def frame_seconds(frame: Column, fps: Column, policy: str) -> Column:
    """frame / fps; ``analyze`` takes 30 fps where fps <= 0, ``extract`` gives 0 there, ``detect`` takes 30 only for fps = 0."""
    if policy == "extract":
        return F.when(fps > 0, frame / fps).otherwise(F.lit(0.0))
    bad = fps <= 0 if policy == "analyze" else fps == 0
    return frame / F.when(bad, F.lit(30.0)).otherwise(fps)


def every_frames(fps: float, seconds: float) -> int:
    if fps <= 0:
        raise ValueError("fps is unknown; give the interval in frames")
    return max(1, round(fps * seconds))


def sample_interval(frames: DataFrame, every: int, frame: str = "frame_index") -> DataFrame:
    if every < 1:
        raise ValueError("every must be at least 1")
    return frames.where(F.pmod(F.col(frame), F.lit(every)) == 0)


def fixed_positions(total: Column, count: int) -> Column:
    """Positions that cover first to last evenly; all of them where there are no more than ``count``."""
    n = F.least(F.lit(count).cast("bigint"), total)
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: half_even(i * (total - 1) / (n - 1)))
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(n == 1, F.array(F.lit(0).cast("bigint"))).otherwise(spread)


def bin_middles(total: Column, bins: int) -> Column:
    """Middle of each of ``bins`` equal ranges: ends floor(i N / b) and floor((i + 1) N / b) - 1, ties to even."""
    i = F.sequence(F.lit(0), F.lit(bins - 1))
    return F.transform(i, lambda k: half_even((F.floor(k * total / bins) + F.floor((k + 1) * total / bins) - 1) / 2))


def bin_centers(total: Column, bins: int) -> Column:
    """floor((i + 0.5) N / bins)."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.floor((k + F.lit(0.5)) * total / bins))


def sample_positions(frames: DataFrame, stream: str, positions, frame: str = "frame_index") -> DataFrame:
    """Frames of each stream at ``positions(total)``, total being the stream's frame count."""
    totals = frames.groupBy(stream).agg(F.count("*").alias("__n"))
    wanted = totals.select(stream, F.explode(positions(F.col("__n"))).alias(frame)).distinct()
    return frames.join(wanted, [stream, frame], "left_semi")


def temporal_split(rows: DataFrame, stream: list[str], order: list[str], train_fraction: float, gap: int = 0) -> DataFrame:
    """Add ``part`` (train, gap or val) by time within each stream.

    Of n rows the first rint(n * fraction), at least 1 and at most n - 1, are train; a gap takes rows on either
    side of that boundary where n > 2. A single row is train.
    """
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must be between 0 and 1")
    if gap < 0:
        raise ValueError("gap must not be negative")
    # Ranks span partitions: a stream may have any number of rows.
    rows = exact_rank(rows, stream, order, "__i", "__n").withColumn("__i", F.col("__i") - 1)
    cut = F.greatest(F.lit(1), F.least(F.col("__n") - 1, half_even(F.col("__n") * F.lit(train_fraction))))
    g = F.when((F.lit(gap) > 0) & (F.col("__n") > 2), F.least(F.lit(gap).cast("bigint"), F.col("__n") - 2)).otherwise(F.lit(0).cast("bigint"))
    train_end = F.when(g > 0, F.greatest(F.lit(1), cut - F.floor(g / 2))).otherwise(cut)
    val_start = F.when(g > 0, F.least(F.col("__n") - 1, train_end + g)).otherwise(cut)
    part = F.when((F.col("__n") == 1) | (F.col("__i") < train_end), "train").when(F.col("__i") < val_start, "gap").otherwise("val")
    return rows.withColumn("part", part).drop("__i", "__n")


def quota_sample(frames: DataFrame, video: str, order: list[str], hash_: str, bins: int, offsets: tuple[float, ...], least_bits: int) -> DataFrame:
    """At most one frame per video and temporal bin: (video, bin, offset, the frame's columns).

    A bin's candidates stand at ``offsets`` (parts of the bin) and are tried in that order; one is passed over if its
    hash is within ``least_bits`` - 1 bits of the first candidate of the bin before. A bin may stay empty. Frames
    without a hash are never near.
    """
    placed = materialize(exact_rank(frames, [video], order, "__i", "__n").withColumn("__i", F.col("__i") - 1), "placed")
    totals = placed.where(F.col("__i") == 0).select(video, "__n")
    placed = placed.drop("__n")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(k).alias("offset"), F.lit((b + o) / bins).alias("part")) for b in range(bins) for k, o in enumerate(offsets)]))
    wanted = totals.where(F.col(video).isNotNull()).select(F.col(video).alias("__v"), "__n", each.alias("w")).select("__v", "w.bin", "w.offset", F.floor(F.col("w.part") * F.col("__n")).alias("__at"))
    found = placed.join(wanted, (F.col(video) == F.col("__v")) & (F.col("__i") == F.col("__at"))).drop("__v", "__at", "__i")
    before = found.where(F.col("offset") == 0).select(F.col(video).alias("__v"), (F.col("bin") + 1).alias("__b"), F.col(hash_).alias("__h"))
    joined = found.join(before, (F.col(video) == F.col("__v")) & (F.col("bin") == F.col("__b")), "left")
    near = F.coalesce(F.bit_count(F.col(hash_).bitwiseXOR(F.col("__h"))) < least_bits, F.lit(False))
    rest = [c for c in found.columns if c not in (video, "bin", "offset")]
    chosen = joined.where(~near).groupBy(video, "bin").agg(F.min(F.struct("offset", *rest)).alias("c"))
    return chosen.select(video, "bin", "c.*")


def duration_seconds(frames: Column, fps: Column) -> Column:
    """frames / fps to 6 places where both are above 0, else 0."""
    return F.when((frames > 0) & (fps > 0), F.round(frames / fps, 6)).otherwise(F.lit(0.0))


def part_ranges(split: DataFrame, keys: list[str], frame: str, seconds: str) -> DataFrame:
    """First and last frame and time of each part."""
    pair = F.struct(seconds, frame)
    return split.groupBy(*keys, "part").agg(
        F.count("*").alias("rows"), F.min_by(frame, pair).alias("first_frame"), F.max_by(frame, pair).alias("last_frame"), F.min(seconds).alias("first_seconds"), F.max(seconds).alias("last_seconds")
    )


def eligible(rows: DataFrame, split: str = "split_name", allow_test: bool = False) -> DataFrame:
    """Source splits that may be split again: train and valid, test only if asked for."""
    return rows.where(F.col(split).isin("train", "valid", *(["test"] if allow_test else [])))
