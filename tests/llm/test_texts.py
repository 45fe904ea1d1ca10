import random
import re
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import leakage, mixing, repetition
from trailmark.llm.words import Words

DOC = "doc_id bigint, text string, lang string, source string, edits int, n_words string, threshold string"
ITEM = "item_id bigint, text string, windows int"


def docs(spark, rows, **kw):
    return spark.createDataFrame([(i, t, kw.get("lang", "en"), s, 1, "w", "t") for i, t, s in rows], DOC)


def plain(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_words():
    texts = ["Hello, World_x 12!", "", "Ünïcode ß ½ 日本語-x", "a" * 5000, "  ", "tail"]
    w = Words(texts)
    got = [[w.word(i) for i in range(w.offsets[k], w.offsets[k + 1])] for k in range(len(texts))]
    assert got == [plain(t) for t in texts]
    flat = [x for t in texts for x in plain(t)]
    assert len({int(h) for h in w.hashes}) == len(set(flat))
    assert Words(["b a"]).hashes[1] == Words(["xx a"]).hashes[1]


def test_window_edits():
    random.seed(1)
    rows = [([random.randrange(4) for _ in range(8)], [random.randrange(4) for _ in range(12)]) for _ in range(200)]
    a, b = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
    want = [least_edits(x, y) for x, y in rows]
    assert leakage.least_window_edits(a, b).tolist() == want
    x, y = [1, 2, 3, 4, 5, 6, 7, 8], [0, 0, 1, 2, 9, 3, 4, 6, 7, 8, 0, 0]  # one word more, one less
    assert leakage.may_be_near(np.array([x]), np.array([y]), 2).all() and not leakage.may_be_near(np.array([x]), np.array([y[:4] + [0] * 8]), 2).any()


def with_edits(words, kinds, rng):
    out = list(words)
    for kind, at in zip(kinds, sorted(rng.sample(range(len(words)), len(kinds)), reverse=True)):
        new = {"r": [f"new{rng.randrange(999)}"], "i": [f"new{rng.randrange(999)}", out[at]], "d": []}
        out[at : at + 1] = new[kind]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("kinds", ["r", "i", "d", "rr", "ii", "dd", "id", "rd", "ri"])
def test_recall_of_edited_windows(seed, kinds):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(12))) for i in range(800)]
    around = lambda: [rng.choice(vocab) for _ in range(6)]
    edited = [(i, " ".join(around() + with_edits(t.split(), kinds, rng) + around())) for i, t in items]
    got = leakage._search_chunk(edited, leakage.ItemIndex(items, leakage.Search(seed=seed)))
    assert len(got[got.doc_id == got.item_id]) / len(items) >= 0.95
    assert got.edits.max() <= 2 and (got.windows == 1).all()


def test_passage_with_an_insertion_in_every_window():
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(24))) for i in range(300)]
    edited = [(i, "a b c " + " ".join(with_edits(t.split(), "iiii", rng)) + " d e f") for i, t in items]
    got = leakage._search_chunk(edited, leakage.ItemIndex(items, leakage.Search()))
    assert len(got[got.doc_id == got.item_id]) / len(items) >= 0.9


def test_repeated_words_stay_bounded():
    import resource

    items = [(i, "same " * 400) for i in range(60)] + [(60 + i, "same " * i) for i in range(3, 40)]
    index = leakage.ItemIndex(items, leakage.Search())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = leakage._search_chunk([(1, "same " * 3000)], index, leakage.WholeItems(index.words, 0.2))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert len(got) == 97 and (got[got.item_id < 60].exact_run == 400).all() and (got.item_edits == 0).all() and got.windows.max() == 1


def test_leaks_against_brute_force(spark):
    random.seed(2)
    vocab = [f"w{i}" for i in range(400)]
    sentence = lambda n: [random.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(sentence(40))) for i in range(20)] + [(100, "short passage"), (101, None), (102, ""), (None, " ".join(sentence(30)))]
    items.append((103, items[0][1]))  # two items with the same words
    rows = []
    for k in range(200):
        words = sentence(60)
        if k % 2:
            i, t = random.choice(items[:20])
            start, n = random.randrange(25), random.choice([8, 11, 12, 13, 15])
            words[20:20] = t.split()[start : start + n]
        rows.append((k, ", ".join(words).upper() if k % 3 else "\n".join(words), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (None, items[3][1], "s"), (502, ("x " * 60_000) + items[4][1], "s"), (502, items[4][1], "s")]

    def grams(t):
        w = plain(t or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    index = [(i, grams(t)) for i, t in items]
    want = Counter((d, i) for d, own in [(d, grams(t)) for d, t, _ in rows] for i, g in index if g & own)
    df, passages = docs(spark, rows), spark.createDataFrame([(*x, 1) for x in items], ITEM)
    got = Counter((r.doc_id, r.item_id) for r in leakage.leaked_passages(df, passages).collect())
    assert got == want
    assert leakage.leaked_passages(df.limit(0), passages).count() == 0 and leakage.leaked_passages(df, passages.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_WINDOWS", 50)
    monkeypatch.setattr(leakage, "TABLE_BITS", 20)
    text = " ".join(f"a{i}" for i in range(30))
    passages = spark.createDataFrame([(i, f"b{i} " * 3 + text, 1) for i in range(6)] + [(9, "tiny", 1)], ITEM)
    rows = docs(spark, [(1, text, "s"), (2, "nothing of it", "s"), (3, "x tiny y", "s")])
    assert leakage.leaked_passages(rows, passages).count() == 6
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(rows, passages).collect()} == {(1, i) for i in range(6)} | {(3, 9)}


def test_exact_run_is_measured(spark):
    text = " ".join(f"a{i}" for i in range(50))
    hit = leakage.find_leaks(docs(spark, [(1, f"x y {text} z", "s")]), spark.createDataFrame([(9, text, 1)], ITEM)).first()
    assert (hit.doc_id, hit.item_id, hit.edits, hit.exact_run) == (1, 9, 0, 50)


def edited(words, every, rng):
    """Each ``every``-th word replaced, removed or preceded by a new one."""
    out = []
    for i, w in enumerate(words):
        kind = rng.randrange(3) if i % every == every - 1 else None
        out += {None: [w], 0: [f"new{rng.randrange(99)}"], 1: [], 2: ["more", w]}[kind]
    return out


def least_edits(item, text):
    """Least edit distance of ``item`` to any stretch of ``text``."""
    row = list(range(len(item) + 1))
    least = row[-1]
    for x in text:
        new = [0]
        for j, y in enumerate(item):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row, least = new, min(least, new[-1])
    return least


def test_whole_items_with_edits(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(vocab) for _ in range(n)]) for i, n in enumerate([36, 39, 69, 120, 260, 12, 7, 3, 1] * 4)]
    rows = []
    for k in range(240):
        own = [rng.choice(vocab) for _ in range(rng.randrange(80))]
        i, words = items[k % len(items)]
        own[len(own) // 2 : len(own) // 2] = edited(words, rng.choice([4, 5, 6, 8, 11]), rng)
        rows.append((k, own))
    want = {}
    for d, own in rows:
        for i, words in items:
            n = least_edits(words, own)
            if n <= len(words) // 5:
                want[d, i] = n
    passages = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items], ITEM)
    got = leakage.find_leaks(docs(spark, [(d, " ".join(w), "s") for d, w in rows]), passages).collect()
    assert {(r.doc_id, r.item_id): r.item_edits for r in got if r.item_edits is not None} == want
    assert sum(r.windows == 0 and r.edits is None for r in got) > 50 and sum(1 for d, i in want if len(items[i][1]) >= 36) > 60
    assert all(r.windows > 0 or r.item_edits is not None for r in got)


def share(text):
    w = plain(text or "")
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len(w), len(runs), len(runs) - len(set(runs))


def test_repetition_against_brute_force(spark):
    random.seed(3)
    rows = []
    for k in range(150):
        phrase = [random.choice("abcdefghijkl") for _ in range(random.randrange(1, 9))]
        words = [f"u{random.randrange(500)}" for _ in range(random.randrange(0, 60))]
        rows.append((k, " ".join(words + phrase * random.randrange(0, 12)), random.choice(["s", None])))
    rows += [(200, None, "s"), (201, "", "s"), (202, "one two three four", None), (203, "spam ham " * 50_000, "s"), (203, "spam ham " * 40, "s")]
    df = docs(spark, rows)
    got = Counter((r.doc_id, r.n_words, r.runs, r.repeated_runs) for r in repetition.measure(df).collect())
    assert got == Counter((i, *share(t)) for i, t, _ in rows)
    flagged = {r.doc_id for r in repetition.flag(df, ceiling=0.3).where("repeated_runs * 10 >= runs * 3").collect()}
    assert flagged == {i for i, t, _ in rows if share(t)[0] >= 20 and share(t)[2] * 10 >= share(t)[1] * 3}
    assert repetition.flag(df.limit(0)).count() == 0


def test_thresholds_adapt(spark):
    random.seed(4)
    clean = [(i, " ".join(f"u{random.randrange(10**6)}" for _ in range(60)), "clean") for i in range(300)]
    spam = [(1000 + i, " ".join([f"u{i}"] + "buy now cheap ants today".split() * 10), "spam") for i in range(300)]
    odd = [(5000, " ".join([f"u{random.randrange(10**6)}" for _ in range(60)] + "a b c d e f g h i j".split() * 2), "clean")]
    got = {r.doc_id: r.threshold for r in repetition.flag(docs(spark, clean + spam + odd), ceiling=0.3).collect()}
    assert 5000 in got and got[5000] < 0.3 and sum(k >= 1000 and k < 2000 for k in got) == 300 and got[1000] == 0.3
    # Without a ceiling the quantile of the group decides, and equal shares reach it.
    alone = {r.doc_id: r.threshold for r in repetition.flag(docs(spark, clean + spam + odd)).collect()}
    assert 5000 in alone and alone[5000] < 0.3 and alone[1000] > 0.8 and sum(1000 <= k < 2000 for k in alone) == 300
    check = repetition.threshold_check(docs(spark, clean + spam + odd)).collect()
    assert len(check) == 6 and all(r.within for r in check)


def test_repeated_sentences_and_paragraphs_are_flagged(spark):
    random.seed(7)
    words = lambda n: [f"u{random.randrange(10**6)}" for _ in range(n)]
    clean = [(i, " ".join(words(60)) + ".", "s") for i in range(200)]
    sentence = ["Buzz hum wing leg."] * 8  # 4 words between others: no run of 5 words twice
    rows = [(1000, " ".join(" ".join(words(3)) + ". " + t for t in sentence), "s")]
    paragraph = "Antennae touch softly tonight"
    rows += [(1001, "\n\n".join(p for _ in range(6) for p in (" ".join(words(5)), paragraph)), "s"), (1002, "Short ant. Short ant.", "s")]
    got = {r.doc_id: r for r in repetition.flag(docs(spark, clean + rows)).collect()}
    assert set(got) == {1000, 1001} and all(r.run_share == 0 == r.threshold for r in got.values())  # no run repeats, so none is flagged for runs
    assert got[1000].sentence_share >= got[1000].sentence_threshold and got[1001].paragraph_share >= got[1001].paragraph_threshold
    assert repetition.flag(docs(spark, clean + rows), measures=("run_share",)).count() == 0


def test_sentences_and_paragraphs(spark):
    r = repetition.measure(docs(spark, [(1, "One ant. One ant. Two ants.\n\nPara here.\n\nPara here.", "s")])).first()
    assert 0 < r.sentence_share < 1 and 0.2 < r.paragraph_share < 0.4


def test_mixture(spark):
    random.seed(5)
    rows = [(i, "ant " * random.randrange(1, 60), s) for i, s in enumerate(["big"] * 900 + [" Small "] * 40 + ["mid"] * 200 + [None] * 30 + ["other"] * 30)]
    rows += [(5000, None, "mid"), (5001, "", "mid"), (5000, "ant", "mid")]
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.3, 3), ("mid", 0.3, 4), ("gone", 0.1, 2), (None, 0.1, 2)], "source string, target_weight double, max_repeats int")
    got = mixing.mix_sources(docs(spark, rows), targets)
    report = {r.source: r for r in got.report.collect()}
    copies = got.copies.collect()
    assert {r.source for r in copies} == {"big", "small", "mid"} and max(r.copies for r in copies if r.source == "big") == 1
    assert report["small"].at_cap and all(r.copies == 3 for r in copies if r.source == "small") and report["small"].tokens_beyond_goal < 0
    assert report["gone"].tokens_out == 0 and report[None].documents == 60 and report[None].target_share == 0
    for s in ("big", "mid"):
        n = sum(r.copies for r in copies if r.source == s)
        assert abs(n - report[s].expected_copies * report[s].documents) < 1
        assert abs(report[s].tokens_beyond_goal) < 0.02 * report[s].tokens_out
        low = int(report[s].expected_copies)
        assert {r.copies for r in copies if r.source == s} <= {low, low + 1}
    again = {(r.doc_id, r.n_tokens, r.copies) for r in mixing.mix_sources(docs(spark, rows), targets).copies.collect()}
    assert again == {(r.doc_id, r.n_tokens, r.copies) for r in copies}


def test_mixture_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    some = docs(spark, [(1, "ant", "a")])
    assert mixing.mix_sources(some.limit(0), targets).copies.count() == 0
    empty = mixing.mix_sources(some, targets.limit(0))
    assert empty.copies.count() == 0 and empty.report.count() == 1


@pytest.mark.parametrize("text", ["<|endoftext|> ants", "naïve café 日本", "a" * 20_000])
def test_token_counts(spark, text):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.TOKENIZER, "rb"))}
    want = len(tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))
    assert mixing.token_counts(docs(spark, [(1, text, "s")])).first().n_tokens == want
