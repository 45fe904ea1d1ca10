import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trailmark.llm import cosine, neardup, overlaps

FRAME = "image_id bigint, split_name string, source_name string, image_sha256 string, phash string, dhash64 string, family_id string, key string, side string"
HELD = "image_id bigint, source_name string, imagesha256 string, phash string, terms int"


def flip(h, bits):
    for b in random.sample(range(64), bits):
        h ^= 1 << b
    return h


def make(n=260, seed=1):
    random.seed(seed)
    base = [(random.getrandbits(64), random.getrandbits(64)) for _ in range(30)]
    out = []
    for i in range(n):
        p, d = random.choice(base)
        out.append((i, flip(p, random.choice([0, 0, 1, 2, 3, 4])), flip(d, random.choice([0, 2, 3, 6]))))
    return out


def frames(spark, rows):
    return spark.createDataFrame([(i, random.choice(["train", " Train", "val", "TEST", None]), "s", sha, p, d, None, "k", "x") for i, sha, p, d in rows], FRAME)


def text(h):
    return random.choice(["%016x", "0x%016X", " %x\t"]) % h


def bits(a, b):
    return bin(a ^ b).count("1")


def test_near_images_against_brute_force(spark, monkeypatch):
    data = make()
    rows = [(i, None, text(p), text(d)) for i, p, d in data] + [(900, None, "0", "1"), (901, None, None, "1"), (902, None, "zz", "1"), (None, None, "1", "1")]
    want = {(a[0], b[0]) for a, b in combinations(data, 2) if bits(a[1], b[1]) <= 3 and bits(a[2], b[2]) <= 5}
    df = frames(spark, rows + rows[:20])
    usual = (neardup.HOT, neardup.KEY_COST, neardup.TOKENS)
    for hot, cost, tokens in (usual, (3, *usual[1:]), (usual[0], 0.0, usual[2]), (usual[0], 3.0, usual[2]), (2, 0.0, ((6, 1 << 62),)), (usual[0], 2.0, ((8, 1 << 62),))):
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "KEY_COST", cost)
        monkeypatch.setattr(neardup, "TOKENS", tokens)
        got = [(r.image_a, r.image_b) for r in neardup.near_images(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert neardup.near_images(df.limit(0)).count() == 0


def test_many_copies(spark):
    df = frames(spark, [(i, None, "ff", "ee") for i in range(1200)])
    assert neardup.near_images(df).count() == 1200 * 1199 // 2
    groups = neardup.image_groups(df)
    assert groups.count() == 1200 and groups.select("group_id").distinct().count() == 1 and groups.first().group_images == 1200


def test_groups(spark):
    rows = [(1, None, "1", "1"), (2, None, "3", "1"), (3, None, "ff00000000000003", "1"), (4, None, "1f", "1"), (5, None, "7", "ffff000000000000")]
    got = {r.image_id: (r.group_id, r.links) for r in neardup.image_groups(frames(spark, rows)).collect()}
    assert got[1][0] == got[2][0] == got[4][0] and got[3][0] != got[1][0] and got[5][0] != got[1][0]
    assert got[2][1] == 2 and got[3][1] == 0


@pytest.mark.parametrize("hot", [cosine.HOT_PAIRS, 1])
def test_overlaps_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(cosine, "HOT_PAIRS", hot)
    data = make(200, 2)
    random.seed(9)
    shas = [random.choice(["sha256:AA", "aa ", "bb", "cc", "", None, "dd"]) for _ in data]
    split = [random.choice(["train", " Train", "val", "TEST", "valid\r", None, "other"]) for _ in data]
    rows = [(i, sp, "s", sha, text(p), None, None, "k", "x") for (i, p, _), sha, sp in zip(data, shas, split)]
    held = [(1000 + i, None, sha, text(p), 1) for (i, p, _), sha in zip(data[:40], shas)]
    frame, hold = spark.createDataFrame(rows + rows[:9], FRAME), spark.createDataFrame(held, HELD)
    key = lambda s: (s or "").strip().lower().removeprefix("sha256:") or None
    kind = lambda s: {"train": "t", "val": "e", "valid": "e", "test": "e"}.get((s or "").strip().lower())
    every = [(i, kind(sp), key(sha), p) for (i, p, _), sha, sp in zip(data, shas, split)] + [(1000 + i, "e", key(sha), p) for (i, p, _), sha in zip(data[:40], shas)]
    want = {(a[0], b[0]) for a in every for b in every if a[1] == "t" and b[1] == "e" and ((a[2] and a[2] == b[2]) or bits(a[3], b[3]) <= 2)}
    got = [(r.train_id, r.evaluation_id) for r in overlaps.overlapping_images(frame, hold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = overlaps.overlap_counts(frame, hold).collect()
    assert sum(r.images for r in counts) == sum(e[1] == "e" for e in every)
    exact = {b[0] for a in every for b in every if a[1] == "t" and b[1] == "e" and a[2] and a[2] == b[2]}
    assert sum(r.exact for r in counts) == len(exact)
    assert overlaps.overlapping_images(frame.limit(0), hold.limit(0)).count() == 0


def test_residual_norm_leaves_terms_out(spark):
    # Ten equal terms, three of which must be shared: two may be left out, and all of a vector with two live terms.
    entry = "named_struct('weight', {w}D, 'other', {w}D)".format(w=10**-0.5)
    for n, left in ((10, 8), (3, 1), (2, 0), (1, 0)):
        terms = spark.sql(f"select array({', '.join([entry] * n)}) t")
        assert terms.select(F.size(cosine._prefix(F.col("t"), overlaps.LEAST_COSINE)).alias("n")).first().n == left


def test_cosine_join_against_brute_force(spark):
    random.seed(4)

    def vectors(n):
        out = []
        for k in range(n):
            terms = random.sample(range(25), random.randrange(1, 7))
            w = [random.random() + 0.05 for _ in terms]
            norm = sum(x * x for x in w) ** 0.5
            out.append((f"k{k}", [(t, x / norm, []) for t, x in zip(terms, w)]))
        return out

    schema = "key string, terms array<struct<term: bigint, weight: double, parts: array<bigint>>>"
    a, b = vectors(90), vectors(110)
    dot = lambda x, y: sum(w * dict((t, v) for t, v, _ in y).get(t, 0) for t, w, _ in x)
    for threshold in (0.2, 0.6, 0.9):
        want = {(k, m) for k, x in a for m, y in b if dot(x, y) >= threshold}
        got = cosine.cosine_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), threshold)
        assert {(r.left_key, r.right_key) for r in got.collect()} == want
    assert got.count() == got.select("left_key", "right_key").distinct().count()
    assert cosine.cosine_join(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), 0.5).agg(F.count("*")).first()[0] == 0
