"""Groups of images that show nearly the same picture, by two perceptual hashes.

Adaptive multi-match prefixes (after AdaptJoin, Wang, Li and Feng, 2012): a phash is cut into tokens (a block's
place and bits), and hashes within 3 bits differ in at most 3 of T tokens. With tokens in an order from rare to
frequent, two such sets share at least m tokens among the first 3 + m of each. A larger m lengthens the prefix,
yet asks for more shared tokens, so its lists are shorter. Each hash takes the m at which its keys and lists
are expected to cost least; every choice of m tokens of the prefix is a key. A hash is also written under the
keys of smaller m that others chose, and a pair meets at the smaller m of the two.

A key's rows are sorted together and its pairs are formed and verified there. Keys with more rows than that
allows are counted before, and their rows go on under longer keys, with tokens of the second hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.hashing import hash64
from trailmark.functions.numeric import fixed_columns
from trailmark.llm.components import components
from trailmark.llm.words import mix
from trailmark.operators.skew import HOT_ROWS, expand_pairs, member_chunks, salted_lookup
from trailmark.session import materialize

PHASH_BITS, DHASH_BITS = 3, 5
#: Tokens of a phash for tables of up to so many hashes, and of a dhash.
TOKENS = ((5, 1 << 29), (6, 1 << 33), (8, 1 << 62))
DHASH_TOKENS = 8
#: A list longer than this goes on under longer keys.
HOT = 4096
#: Cost of writing a key against that of comparing a candidate.
KEY_COST = 150.0
_KEYED = "key bigint, probe boolean, phash bigint, dhash bigint"
_PAIR = "phash_a bigint, dhash_a bigint, phash_b bigint, dhash_b bigint"


def fingerprints(manifest: DataFrame) -> DataFrame:
    """(image_id, phash, dhash) of images with both hashes, distinct."""
    rows = fixed_columns(manifest.select("image_id", F.col("phash").alias("p"), F.col("dhash64").alias("d")), {"phash": hash64(F.col("p")), "dhash": hash64(F.col("d"))}).drop("p", "d")
    return rows.where(F.col("image_id").isNotNull() & F.col("phash").isNotNull() & F.col("dhash").isNotNull()).distinct()


class Prefixes:
    """Keys of 64-bit hashes cut into ``size`` tokens; near hashes differ in at most ``differ`` of them.

    ``counts`` says how many of ``rows`` hashes have each token (``size`` times ``width`` of them).
    """

    def __init__(self, size: int, differ: int, counts: np.ndarray | None = None, rows: int = 1):
        self.size, self.differ = size, differ
        self.edges = [64 * i // size for i in range(size + 1)]
        self.width = 1 << -(-64 // size)
        counts = np.zeros(size * self.width) if counts is None else counts
        self.rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
        self.share, self.rows = counts / max(rows, 1), rows
        self.levels = range(1, size - differ + 1)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers (place * width + bits) of signed 64-bit hashes."""
        values = hashes.astype(np.int64).view(np.uint64)
        cut = [(values >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(self.edges, self.edges[1:])]
        return np.stack(cut, axis=1).astype(np.int64) + self.width * np.arange(self.size)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        return np.bincount(self.tokens(hashes).ravel(), minlength=self.size * self.width)

    def ordered(self, hashes: np.ndarray) -> np.ndarray:
        tokens = self.tokens(hashes)
        return np.take_along_axis(tokens, np.argsort(self.rank[tokens], axis=1), axis=1)

    def choose(self, tokens: np.ndarray) -> np.ndarray:
        """The level of least expected cost: keys to write and members of their lists."""
        costs = []
        for level in self.levels:
            p = self.share[tokens[:, : self.differ + level]]
            # Sum over all choices of `level` tokens of the product of their shares.
            e = np.zeros((len(tokens), level + 1))
            e[:, 0] = 1
            for i in range(p.shape[1]):
                e[:, 1:] += e[:, :-1] * p[:, i : i + 1]
            costs.append(comb(self.differ + level, level) * KEY_COST + e[:, level] * self.rows)
        return 1 + np.argmin(np.array(costs), axis=0)

    def keys(self, tokens: np.ndarray, level: int) -> np.ndarray:
        """One key per choice of ``level`` tokens of the prefix."""
        picks = np.array(list(combinations(range(self.differ + level), level)))
        chosen = np.sort(tokens[:, picks], axis=2).astype(np.uint64)
        key = np.full(chosen.shape[:2], np.uint64(level) * np.uint64(0x9E3779B97F4A7C15 >> 3), np.uint64)
        for i in range(level):
            key = (key ^ chosen[:, :, i]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(31)
        return mix(key).view(np.int64)


def _summed(rows: DataFrame, column: str, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of an array of ``size`` numbers per batch of a column: a bounded table on the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for f in frames:
            total += of(f[column].to_numpy())
        some = np.flatnonzero(total)
        yield pd.DataFrame({"slot": some, "n": total[some]})

    total = np.zeros(size, np.int64)
    summed = rows.select(column).mapInPandas(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total[summed["slot"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return total


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    p, d = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) for x, y in zip(a, b))
    return (p <= PHASH_BITS) & (d <= DHASH_BITS)


def _pairs_in_lists(frames: Iterator[pd.DataFrame], least: int = 200_000) -> Iterator[pd.DataFrame]:
    """Verified pairs of rows of equal keys, rows coming sorted by key and probes first; no pair without a probe.

    A list that goes on in the next batch waits for it; lists are bounded, as longer ones don't get here.
    """

    def pairs(key: np.ndarray, probe: np.ndarray, phash: np.ndarray, dhash: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
        at, found, away = np.flatnonzero(probe), [], 0
        while len(at):
            away += 1
            at = at[at + away < end[at]]
            near = at[_near((phash[at], dhash[at]), (phash[at + away], dhash[at + away]))]
            found.append(np.stack([near, near + away]))
        i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        swap = (phash[i] > phash[j]) | ((phash[i] == phash[j]) & (dhash[i] > dhash[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = pd.DataFrame({"phash_a": phash[i], "dhash_a": dhash[i], "phash_b": phash[j], "dhash_b": dhash[j]})
        return out[(phash[i] != phash[j]) | (dhash[i] != dhash[j])].drop_duplicates()

    held, size = [], 0
    for f in frames:
        held.append([f[c].to_numpy() for c in ("key", "probe", "phash", "dhash")])
        size += len(f)
        if size >= least:
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            yield pairs(*[c[:cut] for c in columns])
            held, size = [[c[cut:] for c in columns]], len(columns[0]) - cut
    if size:
        yield pairs(*[np.concatenate(c) for c in zip(*held)])


def _grid(rows: DataFrame) -> DataFrame:
    """Rows of long lists cut into chunks that meet by twos, each meeting a list of bounded length."""
    chunk = F.pmod(F.xxhash64("phash", "dhash", F.lit(1)), F.col("__c"))
    placed = rows.withColumn("__c", F.ceil(F.col("__n") * 2 / F.lit(HOT)).cast("bigint")).withColumn("__i", chunk)
    met = placed.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__c") - 1)))
    key = F.xxhash64("key", F.least("__i", "__j"), F.greatest("__i", "__j"), F.lit("grid"))
    return met.select(key.alias("key"), F.lit(True).alias("probe"), "phash", "dhash")


def _met(postings: DataFrame, longer: list[Callable]) -> DataFrame:
    """Verified pairs of postings (key, probe, phash, dhash): rows of hot keys go on under the first of ``longer``."""
    lists = postings
    hot = postings.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") > HOT)
    hot = materialize(hot, "hot")
    more = None
    if not hot.isEmpty():
        marked = materialize(salted_lookup(postings, hot, ["key"], F.col("phash"), hot=hot.where(F.col("__n") > HOT_ROWS)), "marked")
        lists = marked.where(F.col("__n").isNull()).drop("__n")
        rest = marked.where(F.col("__n").isNotNull())
        if longer:
            more = _met(rest.drop("__n").mapInPandas(longer[0], _KEYED), longer[1:])
        else:
            lists = lists.unionByName(_grid(rest))
    met = lists.repartition("key").sortWithinPartitions("key", F.desc("probe")).mapInPandas(_pairs_in_lists, _PAIR)
    return met if more is None else met.unionByName(more)


def near_prints(distinct: DataFrame) -> DataFrame:
    """Pairs of ``distinct`` (phash, dhash) within the bounds: (phash_a, dhash_a, phash_b, dhash_b), a before b."""
    n = distinct.count()
    size = next(size for size, most in TOKENS if n <= most)
    plain = Prefixes(size, PHASH_BITS)
    first = Prefixes(size, PHASH_BITS, _summed(distinct, "phash", size * plain.width, plain.count), n)
    plain = Prefixes(DHASH_TOKENS, DHASH_BITS)
    second = Prefixes(DHASH_TOKENS, DHASH_BITS, _summed(distinct, "dhash", DHASH_TOKENS * plain.width, plain.count), n)

    # How many hashes chose each level, and which tokens stand in the prefixes of those of level 1.
    top = len(first.levels)

    def chosen(hashes: np.ndarray) -> np.ndarray:
        tokens = first.ordered(hashes)
        own = first.choose(tokens)
        live = np.bincount(tokens[own == 1, : PHASH_BITS + 1].ravel(), minlength=size * first.width)
        return np.concatenate([np.bincount(own, minlength=top + 1), live])

    seen = _summed(distinct, "phash", top + 1 + size * first.width, chosen)
    used, live = np.flatnonzero(seen[: top + 1]).tolist(), seen[top + 1 :] > 0

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            phash, dhash = f["phash"].to_numpy(), f["dhash"].to_numpy()
            tokens = first.ordered(phash)
            own = first.choose(tokens)
            for level in used:
                rows = np.flatnonzero(own >= level)
                got = first.keys(tokens[rows], level)
                # A hash of a higher level looks at level 1 only where one of that level may be met.
                there = (live[tokens[rows, : PHASH_BITS + 1]] | (own[rows] == 1)[:, None]) if level == 1 else np.ones(got.shape, bool)
                at = np.repeat(rows, got.shape[1])[there.ravel()]
                yield pd.DataFrame({"key": got[there], "probe": own[at] == level, "phash": phash[at], "dhash": dhash[at]})

    def longer(level: int) -> Callable:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # The list's key goes on with so many shared tokens of the second hash's prefix.
            for f in frames:
                for k in range(0, len(f), 10_000):
                    part = f.iloc[k : k + 10_000]
                    got = second.keys(second.ordered(part["dhash"].to_numpy()), level)
                    at = np.repeat(np.arange(len(part)), got.shape[1])
                    key = mix(part["key"].to_numpy().view(np.uint64)[at] ^ got.ravel().view(np.uint64))
                    yield pd.DataFrame({"key": key.view(np.int64), "probe": part["probe"].to_numpy()[at], "phash": part["phash"].to_numpy()[at], "dhash": part["dhash"].to_numpy()[at]})

        return run

    return _met(distinct.mapInPandas(keys, _KEYED), [longer(2), longer(3)]).distinct()


def _name(phash: str, dhash: str):
    return F.concat(F.lpad(F.lower(F.hex(phash)), 16, "0"), F.lit("-"), F.lpad(F.lower(F.hex(dhash)), 16, "0"))


def near_images(manifest: DataFrame) -> DataFrame:
    """(image_a, image_b), image_a < image_b: every pair of images within the bounds once, copies included.

    Null and unusable hashes match nothing; repeated deliveries count once; an empty table gives no pair.
    """
    prints = materialize(fingerprints(manifest), "hashes")
    hashes = materialize(prints.groupBy("phash", "dhash").agg(F.count("*").alias("n")), "prints")
    pairs = near_prints(hashes.select("phash", "dhash"))
    key = lambda suffix: F.struct(F.col(f"phash{suffix}").alias("p"), F.col(f"dhash{suffix}").alias("d"))
    copies = hashes.where(F.col("n") > 1).select(key("").alias("key_a"), key("").alias("key_b"))
    pairs = materialize(pairs.select(key("_a").alias("key_a"), key("_b").alias("key_b")).unionByName(copies), "pairs")
    # Only images of hashes that stand in a pair go on.
    own = prints.select(key("").alias("key"), "image_id").join(pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct(), "key", "left_semi")
    chunks = materialize(member_chunks(own, "key", "image_id"), "chunks")
    out = expand_pairs(pairs, chunks, chunks).where(F.col("a") != F.col("b"))
    inside = (F.col("key_a") != F.col("key_b")) | (F.col("a") < F.col("b"))
    return out.where(inside).select(F.least("a", "b").alias("image_a"), F.greatest("a", "b").alias("image_b")).distinct()


def image_groups(manifest: DataFrame) -> DataFrame:
    """(image_id, group_id, group_images, links, family_id), a row per image with both hashes.

    A group is a connected set of near hashes; ``links`` counts the other hashes near the image's own, and the
    curator's ``family_id`` (the least of the image's rows) stands beside.
    """
    prints = materialize(fingerprints(manifest), "hashes")
    near = near_prints(materialize(prints.select("phash", "dhash").distinct(), "prints"))
    pairs = materialize(near.select(_name("phash_a", "dhash_a").alias("key_a"), _name("phash_b", "dhash_b").alias("key_b")), "pairs")
    edge = F.concat_ws("\x01", "key_a", "key_b")
    ends = pairs.select(edge.alias("record"), F.explode(F.array("key_a", "key_b")).alias("entity"))
    roots = components(ends).select(F.col("entity").alias("key"), F.col("component").alias("root"))
    links = ends.groupBy(F.col("entity").alias("key")).agg(F.count("*").alias("links"))
    looked = salted_lookup(prints.select("image_id", _name("phash", "dhash").alias("key")), roots.join(links, "key"), ["key"], F.col("image_id"))
    group = F.coalesce("root", "key")
    rows = materialize(looked.select("image_id", group.alias("group_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links")), "groups")
    sizes = rows.groupBy("group_id").agg(F.count_distinct("image_id").alias("group_images"))
    family = manifest.groupBy("image_id").agg(F.min("family_id").alias("family_id"))
    return salted_lookup(rows, sizes, ["group_id"], F.col("image_id")).join(family, "image_id").select("image_id", "group_id", "group_images", "links", "family_id")
