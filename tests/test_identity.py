import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions.hashing import hash64, sha_key, video_key
from trailmark.operators import identity, motion, ranking, skew


def test_keys(spark):
    cases = {"ff": 255, " 0xFF\t": 255, "ffffffffffffffff": -1, "8000000000000000": -(1 << 63), "0": None, "0x0000": None, "": None, None: None, "n/a": None, "1" * 17: None, "-1": None}
    rows = spark.createDataFrame([(c,) for c in cases], "h string").select("h", hash64(F.col("h")).alias("v")).collect()
    assert {r.h: r.v for r in rows} == cases
    r = spark.createDataFrame([("sha256:AB ", "x/Y.MP4\r")], "s string, v string").select(sha_key(F.col("s")).alias("s"), video_key(F.col("v")).alias("v")).first()
    assert (r.s, r.v) == ("ab", "y.mp4")


@pytest.mark.parametrize("equal", [1, 2, 3, 4])
def test_hamming_pairs_against_brute_force(spark, monkeypatch, equal):
    monkeypatch.setattr(identity, "_blocks", lambda n, max_bits, bits: (max_bits + equal, equal))
    random.seed(1)
    base = [random.getrandbits(64) for _ in range(60)]
    values = base + [b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(5))) for b in base]
    signed = [v - (1 << 64) if v >> 63 else v for v in values] + [None, 5, 5]
    df = spark.createDataFrame([(v,) for v in signed], "h bigint")
    rows = identity.hamming_pairs(df, "h", 4).collect()
    got = {(r.hash_a, r.hash_b): r.distance for r in rows}
    assert len(got) == len(rows)
    distinct = sorted({v for v in signed if v is not None})
    want = {(a, b): d for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 4}
    assert got == want


def test_blocks_grow_with_the_number_of_hashes():
    assert [identity._blocks(n, 4, 64)[1] for n in (10**4, 10**7, 10**9, 10**11)] == sorted(identity._blocks(n, 4, 64)[1] for n in (10**4, 10**7, 10**9, 10**11))
    assert identity._blocks(10**3, 4, 64) == (5, 1) and identity._blocks(10**10, 4, 64)[1] >= 3


def test_percentiles_and_thirds(spark):
    random.seed(6)
    rows = [(random.choice(["a", None, "c"]), random.choice([None, random.random(), 0.5])) for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p50, r.p90) for r in ranking.exact_percentiles(df, ["k"], {"p50": ("v", 0.5), "p90": ("v", 0.9)}).collect()}
    import numpy as np

    for k in ("a", None, "c", "one"):
        values = [v for g, v in rows if g == k and v is not None]
        assert got[k] == pytest.approx((np.percentile(values, 50), np.percentile(values, 90)))
    assert "none" not in got and ranking.exact_percentiles(df.limit(0), ["k"], {"p": ("v", 0.5)}).count() == 0
    whole = ranking.exact_percentiles(df, [], {"p": ("v", 0.25)}).first().p
    assert whole == pytest.approx(np.percentile([v for _, v in rows if v is not None], 25))


def test_registry_and_leakage(spark):
    models = spark.createDataFrame([("AB",), ("zz",)], "sha string")
    registry = spark.createDataFrame([("ab", "m1")], "sha string, name string")
    assert {r.sha: r.identity for r in identity.identify(models, registry, "sha", "name").collect()} == {"AB": "m1", "zz": identity.UNKNOWN_MODEL}
    held = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", None)], "g string, sha string")
    assert [tuple(r) for r in identity.leakage(spark.createDataFrame([("x",)], "sha string"), held, "sha", "g").collect()] == [("g", 2, 1)]
    changed = spark.sql("select map('a', 1, 'b', 2) c, map('a', 1, 'b', 3) v").select(identity.overrides(F.col("v"), F.col("c")).alias("o")).first().o
    assert list(changed) == ["b"] and tuple(changed["b"]) == (2, 3)
    with pytest.raises(Exception, match="sha256 mismatch"):
        spark.sql("select 'a' x").select(identity.check_sha(F.col("x"), F.lit("b"))).collect()


def test_prefix_sums_and_ranks(spark):
    random.seed(2)
    rows = [(random.choice(["a", "b", None]), i, random.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {r.o: (r.total, r.rank) for r in ranking.exact_rank(ranking.prefix_sum(df, ["k"], ["o"], F.col("v"), "total"), ["k"], ["o"]).collect()}
    seen: dict = {}
    for k, o, v in rows:
        total, rank = seen.get(k, (0, 0))
        seen[k] = (total + v, rank + 1)
        assert got[o] == seen[k]
    assert ranking.exact_rank(df.limit(0), ["k"], ["o"]).count() == 0


def test_hot_lookup_and_chunks(spark):
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(400)] + [(None, 999)], "k string, i int")
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    got = {r.i: r.v for r in skew.salted_lookup(rows, lookup, ["k"], F.col("i"), hot_rows=50, salts=7).collect()}
    assert len(got) == 401 and got[1] == 1 and got[0] == 2 and got[2] is None and got[999] is None
    assert skew.salted_lookup(rows, lookup, ["k"], F.col("i"), how="inner", hot_rows=50, salts=7).count() == 201
    chunks = skew.member_chunks(rows, "k", "i", size=16)
    assert chunks.agg(F.max(F.size("ids"))).first()[0] < 60 and chunks.where("k = 'hot'").count() > 5
    named = chunks.withColumnRenamed("k", "key")
    pairs = spark.createDataFrame([("hot", "k0")], "key_a string, key_b string")
    assert skew.expand_pairs(pairs, named, named).count() == 200


def test_regions_and_heatmap(spark):
    regions = spark.sql("select array(named_struct('id', 1, 'area', 5.0), named_struct('id', 2, 'area', 9.0), named_struct('id', 3, 'area', 5.0), named_struct('id', 4, 'area', 1.0)) r")
    assert [x.id for x in regions.select(motion.motion_regions(F.col("r"), F.lit(2.0)).alias("r")).first().r] == [2, 1, 3]
    cells = spark.createDataFrame([(1, *c) for c in [(0, 0), (0, 0), (0, 0), (0, 1), (0, 1), (1, 1)]], "s int, y int, x int")
    levels = lambda df, h, w: {(r.y, r.x): r.level for r in motion.heatmap(df, ["s"], h, w).collect()}
    # One cell was never set, so 0 is the least; a full grid scales from its own least; equal cells are 0.
    assert levels(cells, 2, 2) == {(0, 0): 255, (0, 1): 170, (1, 1): 85}
    assert levels(cells.where("y = 0"), 1, 2) == {(0, 0): 255, (0, 1): 0}
    assert levels(cells.where("y = 1"), 2, 2) == {(1, 1): 255} and levels(cells.distinct().where("y = 0"), 1, 2) == {(0, 0): 0, (0, 1): 0}
