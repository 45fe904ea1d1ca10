"""Evaluation passages in training text.

Items are cut into windows of ``window`` consecutive words. A window stands in a text if a stretch of the
text is within ``max_edits`` word edits of it, insertions and deletions included. By the q-gram lemma such a
stretch keeps w - q + 1 - k q of the window's runs of q words; places of the corpus without that many runs of
any item are passed over, which loses nothing. The windows at the others are embedded by the CGK random walk
(Chakraborty, Goldenberg and Koucky, 2016): at each step the current word is emitted, and a random bit of
(word, walk, step) says whether to advance. Windows at a small edit distance have embeddings at a small
Hamming distance, so that keys of a few sampled positions agree often; several walks, half of them from the
window's end backwards, and several samples of each reach the target recall. Candidates are verified by their
exact edit distance. Equal windows have equal embeddings and thus always meet: for them the recall is 1.

Whole items are looked for besides, with an edit budget in proportion to their length, insertions and
deletions included. An edit changes at most q runs of q words, so a passage within k edits of an item of n
words shares n - q + 1 - k q runs with it, all within n + k words: where fewer stand, no match is possible.
The other places are verified by their exact edit distance (Myers' bit vectors, one number of n bits), so
that no match within the budget is lost, whatever its edits.

Windows that stand several times, in items or in a chunk of texts, are compared once, and candidate lists are
opened in slices of bounded size, so that repeated words don't multiply into pairs held at once.

The items are the stated query set: their index goes to the executors, in blocks of at most ``MAX_WINDOWS``
windows. The corpus is never shuffled. Where there are several blocks, one pass with a bit table of all items
sets apart the documents that can hold any, and the blocks are compared with those alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.words import Words, in_chunks, mix
from trailmark.session import materialize

#: Item windows of a block: about 12 bytes each and key, so that an index stays below 100 MB.
MAX_WINDOWS = 500_000
#: Bits of the table that all blocks share, and the parts that it is put together from.
TABLE_BITS, TABLE_PARTS = 27, 1024
#: Entries of a list of candidates or places that are held at once.
SLICE = 1 << 20
#: Items whose runs are compared at once: bounds the pairs held, even if a run stands in all of them.
_ITEMS = 64


@dataclass(frozen=True)
class Search:
    """``walks`` independent walks with ``samples`` keys of ``sampled`` positions each.

    As set, a window of 12 words and a stretch at up to two edits share a key with probability above 0.95,
    whether words are replaced, inserted or dropped (tests hold it to 0.9 and the README has the figures).
    """

    window: int = 12
    max_edits: int = 2
    walks: int = 8
    samples: int = 2
    sampled: int = 5
    seed: int = 17

    @property
    def steps(self) -> int:
        return max(self.sampled, self.window * 4 // 3)

    def positions(self) -> list[list[list[int]]]:
        rng = np.random.default_rng(self.seed)
        pick = lambda: sorted(int(x) for x in rng.choice(self.steps, self.sampled, replace=False))
        return [[pick() for _ in range(self.samples)] for _ in range(self.walks)]

    def runs(self) -> list[tuple[int, int]]:
        """(q, n): a stretch within ``max_edits`` of a window keeps at least n of its runs of q words."""
        longest = max(1, self.window // (self.max_edits + 1))
        kept = lambda q: self.window - q + 1 - self.max_edits * q
        return [(q, kept(q)) for q in sorted({longest, max(1, longest - 1)}) if kept(q) > 0]


class BitTable:
    """A set of 64-bit keys that may say yes to others, never no to its own; sized by the number of keys."""

    def __init__(self, keys: np.ndarray):
        self.mask = np.uint64((1 << min(max(len(keys).bit_length() + 4, 12), 26)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[keys & self.mask] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[keys & self.mask]


def cgk_keys(windows: np.ndarray, search: Search) -> Iterator[np.ndarray]:
    """One key per walk and sample for the rows of ``windows`` (hashes of ``window`` words each)."""
    n, w = windows.shape
    forward = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    backward = np.concatenate([windows[:, ::-1], np.zeros((n, 1), np.uint64)], axis=1)
    for walk, samples in enumerate(search.positions()):
        words = (backward if walk % 2 else forward).ravel()
        keys = [np.full(n, np.uint64(0xA0761D6478BD642F ^ (walk << 8 | r)), np.uint64) for r in range(len(samples))]
        first = np.arange(n) * (w + 1)
        at, end = first.copy(), first + w
        for step in range(max(p[-1] for p in samples) + 1):
            if step % 60 == 0:  # a word's mixed hash gives the bits of 60 steps, for all places at once
                bits = mix(words + np.uint64(1 + walk + (step << 8)))
            if any(step in p for p in samples):
                symbol = words[at]
                for r, chosen in enumerate(samples):
                    if step in chosen:
                        keys[r] = (keys[r] ^ symbol) * np.uint64(0x9FB21C651E98DF25)
                        keys[r] ^= keys[r] >> np.uint64(29)
            at += ((bits[at] >> np.uint64(step % 60)) & np.uint64(1)).astype(np.int64)
            if step >= w - 1:  # not before, as a step moves by one at most
                np.minimum(at, end, out=at)
        yield from (mix(k) for k in keys)


def window_starts(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window that lies within one text, and the text."""
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    firsts = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return (firsts + np.arange(len(text))).astype(np.int64), text


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one after the other."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum())) if len(first) else np.empty(0, np.int64)


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of rows whose sizes sum up to at most ``most``; a larger row is alone."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(begin, end)
        begin = end


class ItemIndex:
    """Sorted keys of the distinct item windows with tables that refuse most places of the corpus at once."""

    def __init__(self, items: list[tuple], search: Search):
        self.search = search
        self.words = Words([t for _, t in items])
        self.ids = [i for i, _ in items]
        w = search.window
        starts, item = window_starts(self.words.offsets, w)
        _, first, own = np.unique(run_keys(self.words.hashes, starts, w), return_index=True, return_inverse=True)
        self.windows = self.words.hashes[starts[first, None] + np.arange(w)]
        # The items of each distinct window, as ranges of one array.
        pairs = np.unique(own * max(len(items), 1) + item)
        self.items = pairs % max(len(items), 1)
        self.first_item = np.searchsorted(pairs // max(len(items), 1), np.arange(len(first) + 1))
        self.keys, self.order, self.tables = [], [], []
        for k in cgk_keys(self.windows, search):
            order = np.argsort(k, kind="stable")
            self.keys.append(k[order])
            self.order.append(order.astype(np.int32))
            self.tables.append(BitTable(k))
        self.runs = [(q, n, BitTable(run_keys(self.words.hashes, window_starts(self.words.offsets, q)[0], q))) for q, n in search.runs()]

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(start, text) of the windows of ``words`` around which enough runs of items stand."""
        w, k = self.search.window, self.search.max_edits
        starts, text = window_starts(words.offsets, w)
        low, high = np.maximum(starts - k, words.offsets[text]), np.minimum(starts + w + k, words.offsets[text + 1])
        for q, needed, table in self.runs:
            at, _ = window_starts(words.offsets, q)
            hit = np.zeros(len(words.hashes) + 1, np.int64)
            hit[at[table.has(run_keys(words.hashes, at, q))] + 1] = 1
            before = np.cumsum(hit)
            good = before[np.maximum(high - q + 1, low)] - before[low] >= needed
            starts, text, low, high = starts[good], text[good], low[good], high[good]
        return starts, text

    def near(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item window, edits) of verified candidates, in slices; a pair may come in several."""
        w, k = self.search.window, self.search.max_edits
        starts, text = self.places(words)
        if not len(starts) or not len(self.windows):
            return
        span = starts[:, None] + np.arange(-k, w + k)
        inside = (span >= words.offsets[text, None]) & (span < words.offsets[text + 1, None])
        regions = np.where(inside, words.hashes[np.clip(span, 0, len(words.hashes) - 1)], np.uint64(0))
        key = np.full(len(starts), np.uint64(w))
        for column in regions.T:
            key = (key ^ column) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(31)
        _, first, own = np.unique(key, return_index=True, return_inverse=True)
        regions = regions[first]
        # The texts of each distinct region, as ranges of one array.
        pairs = np.unique(own * (len(words.offsets) - 1) + text)
        texts, first_text = pairs % (len(words.offsets) - 1), np.searchsorted(pairs // (len(words.offsets) - 1), np.arange(len(first) + 1))
        lows, counts = [], []
        for r, key in enumerate(cgk_keys(regions[:, k : k + w], self.search)):
            low, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            some = np.flatnonzero(self.tables[r].has(key))
            low[some] = np.searchsorted(self.keys[r], key[some], "left")
            n[some] = np.searchsorted(self.keys[r], key[some], "right") - low[some]
            lows.append(low)
            counts.append(n)
        for part in _slices(np.sum(counts, axis=0), SLICE):
            found = []
            for order, low, n in zip(self.order, lows, counts):
                rows = part.start + np.flatnonzero(n[part])
                found.append(np.repeat(rows, n[rows]) * len(self.windows) + order[_ranges(low[rows], n[rows])])
            met = np.unique(np.concatenate(found))
            for i in range(0, len(met), SLICE // 8):
                here, there = met[i : i + SLICE // 8] // len(self.windows), met[i : i + SLICE // 8] % len(self.windows)
                x, y = self.windows[there], regions[here]
                good = np.flatnonzero(may_be_near(x, y, k))
                edits = least_window_edits(x[good], y[good])
                good, edits = good[edits <= k], edits[edits <= k]
                here, there = here[good], there[good]
                n = first_text[here + 1] - first_text[here]
                for piece in _slices(n, SLICE):
                    yield texts[_ranges(first_text[here[piece]], n[piece])], np.repeat(there[piece], n[piece]), np.repeat(edits[piece], n[piece])

    def hits(self, words: Words) -> pd.DataFrame:
        """(doc, item, windows, edits): distinct windows of each item that stand in a text and their fewest edits."""
        kept = pd.DataFrame({"doc": [], "window": [], "edits": []}, dtype="int64")
        held = [kept]
        for doc, window, edits in self.near(words):
            held.append(pd.DataFrame({"doc": doc, "window": window, "edits": edits}))
            if sum(map(len, held)) > 2 * len(held[0]) + SLICE:
                held = [pd.concat(held).groupby(["doc", "window"], as_index=False)["edits"].min()]
        found = pd.concat(held).groupby(["doc", "window"], as_index=False)["edits"].min().sort_values("doc", kind="stable")
        window = found["window"].to_numpy()
        n = self.first_item[window + 1] - self.first_item[window]
        out = []
        for piece in _slices(n, SLICE):
            item = self.items[_ranges(self.first_item[window[piece]], n[piece])]
            opened = pd.DataFrame({"doc": np.repeat(found["doc"].to_numpy()[piece], n[piece]), "item": item, "edits": np.repeat(found["edits"].to_numpy()[piece], n[piece])})
            out.append(opened.groupby(["doc", "item"], as_index=False).agg(windows=("edits", "size"), edits=("edits", "min")))
        if not out:
            return pd.DataFrame({"doc": [], "item": [], "windows": [], "edits": []}, dtype="int64")
        return pd.concat(out).groupby(["doc", "item"], as_index=False).agg(windows=("windows", "sum"), edits=("edits", "min"))


def may_be_near(windows: np.ndarray, regions: np.ndarray, edits: int) -> np.ndarray:
    """Rows that can be within ``edits``: all but so many words of the window stand in its region, ``edits`` places or
    less from where they would without any. A region begins ``edits`` words before the window's place."""
    w = windows.shape[1]
    near = np.zeros(windows.shape, bool)
    # A match may begin anywhere in the region, so a word may be off by up to twice the edits.
    for s in range(regions.shape[1] - w + 1):
        near |= windows == regions[:, s : s + w]
    return near.sum(axis=1) >= w - edits


def least_window_edits(windows: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Row-wise least edit distance of a window to any stretch of its region (dynamic programme over all rows at once)."""
    row = np.zeros((len(windows), regions.shape[1] + 1), np.int16)
    for i in range(windows.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        change = np.minimum(row[:, :-1] + (windows[:, i : i + 1] != regions), row[:, 1:] + 1)
        for j in range(regions.shape[1]):
            new[:, j + 1] = np.minimum(new[:, j] + 1, change[:, j])
        row = new
    return row.min(axis=1)


def longest_run(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(length, end in ``text``, end in ``item``) of the longest run of equal words."""
    best, runs = (0, 0, 0), np.zeros(len(text) + 1, np.int64)
    for j, word in enumerate(item):
        runs[1:] = np.where(text == word, runs[:-1] + 1, 0)
        at = int(runs.argmax())
        if runs[at] > best[0]:
            best = int(runs[at]), at, j + 1
    return best


def run_keys(hashes: np.ndarray, starts: np.ndarray, run: int) -> np.ndarray:
    """A key for the run of ``run`` words at each of ``starts``."""
    key = np.full(len(starts), np.uint64(run))
    for i in range(run):
        key = (key ^ hashes[starts + i]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(31)
    return mix(key)


class WholeItems:
    """Runs of each item, of 3 words where the edit budget of ``rate`` per word leaves one in common, else of fewer."""

    def __init__(self, words: Words, rate: float):
        if not 0 <= rate < 1:
            raise ValueError("the edits per word must be at least 0 and below 1")
        self.words, self.lengths = words, words.counts().astype(np.int64)
        self.budgets = np.floor(self.lengths * rate).astype(np.int64)
        self.needed = np.zeros(len(self.lengths), np.int64)
        self.parts: list[tuple[int, BitTable, list[tuple[np.ndarray, np.ndarray]]]] = []
        for q in (3, 2, 1):
            shared = self.lengths - q + 1 - self.budgets * q
            own = np.flatnonzero((self.needed == 0) & (shared > 0))
            self.needed[own] = shared[own]
            starts, item = window_starts(words.offsets, q)
            keys, blocks = run_keys(words.hashes, starts, q), []
            for k in range(0, len(own), _ITEMS):
                inside = np.isin(item, own[k : k + _ITEMS])
                pairs = np.unique(np.rec.fromarrays([keys[inside], item[inside]], names="key,item"))
                blocks.append((pairs["key"].copy(), pairs["item"].astype(np.int64)))
            if blocks:
                self.parts.append((q, BitTable(np.concatenate([k for k, _ in blocks])), blocks))

    def places(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end): all stretches of ``words`` that can hold a match, with all their matches."""
        for q, table, blocks in self.parts:
            starts, text = window_starts(words.offsets, q)
            keys = run_keys(words.hashes, starts, q)
            some = np.flatnonzero(table.has(keys))
            keys, starts, text = keys[some], starts[some], text[some]
            for own_keys, own_items in blocks:
                low = np.searchsorted(own_keys, keys, "left")
                n = np.searchsorted(own_keys, keys, "right") - low
                if n.sum() <= SLICE:
                    yield from self._stretches(q, own_items[_ranges(low, n)], np.repeat(starts, n), np.repeat(text, n), words)
                    continue
                for one in np.unique(own_items):  # one item has no more places than the texts have words
                    there = np.isin(keys, own_keys[own_items == one])
                    yield from self._stretches(q, np.full(int(there.sum()), one), starts[there], text[there], words)

    def _stretches(self, q: int, item: np.ndarray, at: np.ndarray, doc: np.ndarray, words: Words) -> Iterator[tuple[int, int, int, int]]:
        order = np.argsort(item, kind="stable")  # places ascend within an item
        item, at, doc = item[order], at[order], doc[order]
        last = np.arange(len(item)) + self.needed[item] - 1
        first = np.flatnonzero(last < len(item))
        last, reach = last[first], (self.lengths + self.budgets)[item[first]]
        near = (item[last] == item[first]) & (doc[last] == doc[first]) & (at[last] + q - at[first] <= reach)
        first, last, reach = first[near], last[near], reach[near]
        if not len(first):
            return
        item, doc = item[first], doc[first]
        begin = np.maximum(at[last] + q - reach, words.offsets[doc])
        end = np.minimum(at[first] + reach, words.offsets[doc + 1])
        new = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1]))
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(new)) - 1
        yield from zip(doc[opens].tolist(), item[opens].tolist(), begin[opens].tolist(), end[closes].tolist())

    def least_edits(self, item: int, text: list[int]) -> int:
        """Least edit distance of the item to any stretch of ``text`` (word hashes)."""
        own = self.words.hashes[self.words.offsets[item] : self.words.offsets[item + 1]].tolist()
        n, masks = len(own), {}
        for i, word in enumerate(own):
            masks[word] = masks.get(word, 0) | 1 << i
        full, high = (1 << n) - 1, 1 << (n - 1)
        plus, minus, edits, least = full, 0, n, n
        for word in text:
            same = masks.get(word, 0)
            across = (((same & plus) + plus) ^ plus) | same
            up, down = minus | (full & ~(across | plus)), plus & across
            if up & high:
                edits += 1
            elif down & high:
                edits -= 1
                least = min(least, edits)
            same |= minus
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | (full & ~(same | up)), up & same
        return least

    def search(self, words: Words) -> pd.DataFrame:
        """(doc, item, item_edits): each item that stands in a text within its budget, with the fewest edits."""
        found: dict[tuple[int, int], int] = {}
        for doc, item, begin, end in self.places(words):
            edits = self.least_edits(item, words.hashes[begin:end].tolist())
            if edits <= self.budgets[item]:
                found[doc, item] = min(edits, found.get((doc, item), edits))
        rows = [(doc, item, edits) for (doc, item), edits in sorted(found.items())]
        return pd.DataFrame(rows, columns=["doc", "item", "item_edits"]).astype("int64")


def _exact_run(words: Words, doc: int, index: ItemIndex, item: int) -> int:
    """Longest run of words that a text and an item have in common, compared by the words themselves."""
    i, j = int(words.offsets[doc]), int(index.words.offsets[item])
    text, own = words.hashes[i : words.offsets[doc + 1]], index.words.hashes[j : index.words.offsets[item + 1]]
    n, end, own_end = longest_run(text, own)
    if all(words.word(i + end - n + k) == index.words.word(j + own_end - n + k) for k in range(n)):
        return n
    numbers: dict[str, int] = {}  # two words with one hash: number the words instead
    number = lambda w, first, count: np.array([numbers.setdefault(w.word(first + k), len(numbers)) for k in range(count)], np.int64)
    return longest_run(number(words, i, len(text)), number(index.words, j, len(own)))[0]


def _search_chunk(chunk: list[tuple], index: ItemIndex, whole: WholeItems | None = None) -> pd.DataFrame:
    """Verified hits of one chunk: per document and item the windows, the fewest edits, the longest common run and,
    with ``whole``, the fewest edits of the whole item."""
    words = Words([t for *_, t in chunk])
    hits = index.hits(words)
    runs = [_exact_run(words, doc, index, item) if edits == 0 else 0 for doc, item, edits in hits[["doc", "item", "edits"]].itertuples(index=False)]
    hits["exact_run"] = pd.Series(runs, dtype="int64")
    found = whole.search(words) if whole else pd.DataFrame(columns=["doc", "item", "item_edits"], dtype="int64")
    hits = hits.merge(found, on=["doc", "item"], how="outer").astype("Int64").fillna({"windows": 0, "exact_run": 0})
    hits.insert(0, "doc_id", pd.array([chunk[i][0] for i in hits.pop("doc")], "Int64"))
    hits.insert(1, "item_id", pd.array([index.ids[i] for i in hits.pop("item")], "Int64"))
    return hits


def _shared_table(queries: DataFrame, search: Search, item_edits: float | None) -> np.ndarray:
    """Bit table of all runs that tell a document with a match from others: of windows and of whole items.

    Each task sets its items' bits in a table of its own; the parts of the tables are united before the driver
    gets them, ``2 ** TABLE_BITS`` bits whatever the items.
    """

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            for chunk in in_chunks((t,) for t in batch["text"]):
                words = Words([t for (t,) in chunk])
                for q in {q for q, _ in search.runs()[:1]} | ({q for q, *_ in WholeItems(words, item_edits).parts} if item_edits is not None else set()):
                    keys = run_keys(words.hashes, window_starts(words.offsets, q)[0], q)
                    table[keys & np.uint64((1 << TABLE_BITS) - 1)] = True
        packed = np.packbits(table).reshape(TABLE_PARTS, -1)
        some = np.flatnonzero(packed.any(axis=1))
        yield pd.DataFrame({"part": some, "bits": [packed[i].tobytes() for i in some]})

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        joined = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group["bits"]])
        return pd.DataFrame({"part": group["part"][:1], "bits": [joined.tobytes()]})

    schema = "part bigint, bits binary"
    table = np.zeros((TABLE_PARTS, (1 << TABLE_BITS) // 8 // TABLE_PARTS), np.uint8)
    for r in queries.select("text").mapInPandas(bits, schema).groupBy("part").applyInPandas(unite, schema).toLocalIterator():
        table[r.part] = np.frombuffer(r.bits, np.uint8)
    return table.ravel()


def _suspects(corpus: DataFrame, queries: DataFrame, search: Search, item_edits: float | None) -> DataFrame:
    """Documents that hold any run of an item: the only ones with matches. One pass over the corpus, written."""
    lengths = {q for q, _ in search.runs()[:1]} | ({1, 2, 3} if item_edits is not None else set())
    shared = corpus.sparkSession.sparkContext.broadcast(_shared_table(queries, search, item_edits))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            for chunk in in_chunks(zip(range(len(batch)), batch["text"])):
                words, some = Words([t for _, t in chunk]), np.zeros(len(chunk), bool)
                for q in lengths:
                    starts, text = window_starts(words.offsets, q)
                    keys = run_keys(words.hashes, starts, q) & np.uint64((1 << TABLE_BITS) - 1)
                    some[text[(table[keys >> np.uint64(3)] >> (np.uint8(7) - (keys & np.uint64(7)).astype(np.uint8))) & 1 > 0]] = True
                yield batch.iloc[[i for (i, _), s in zip(chunk, some) if s]]

    return materialize(corpus.mapInPandas(keep, "doc_id bigint, text string"), "suspects")


def find_leaks(documents: DataFrame, items: DataFrame, search: Search | None = None, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_edits: float | None = 0.2) -> DataFrame:
    """Documents with items or windows of items: (doc_id, item_id, windows, edits, exact_run, item_edits), each pair once.

    ``windows`` counts the distinct windows of the item that stand in the document within ``max_edits``, ``edits``
    is their least distance (null if there are none) and ``exact_run`` the longest run of equal words if an equal
    window stands there (0 if none). The column ``item_edits`` has the least edit distance of the whole item to a
    stretch of the document, null beyond the parameter's edits per word of the item (null: whole items aren't looked
    for). Null and empty texts give no row; items shorter than a window come out only whole, and in documents
    shorter than a window only whole items are found. Texts are read whole, however long. Repeated document ids
    give a row for each of their rows. Null ids stay null. Other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    search = search or Search()
    spark = documents.sparkSession
    queries = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # At most one window starts at each character: an upper bound that a count gives without the texts.
    windows = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, ceil(windows / 2 / MAX_WINDOWS))
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    if blocks > 1:
        corpus = _suspects(corpus, queries, search, item_edits)

    def one(block: int) -> DataFrame:
        own = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in own.toLocalIterator()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(shared.value, search)
            whole = None if item_edits is None else WholeItems(index.words, item_edits)
            for batch in batches:
                for chunk in in_chunks(zip(batch["doc_id"].astype("Int64"), batch["text"])):
                    yield _search_chunk(chunk, index, whole)

        return corpus.mapInPandas(run, "doc_id bigint, item_id bigint, windows bigint, edits int, exact_run int, item_edits int")

    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = 12) -> DataFrame:
    """Pairs where at least ``words`` consecutive words of the item stand in the document: (doc_id, item_id)."""
    hits = find_leaks(documents, items, Search(window=words), item_edits=None)
    return hits.where(F.col("exact_run") >= words).select("doc_id", "item_id")
