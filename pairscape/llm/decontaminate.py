"""Benchmark decontamination by CGK embedding, bit sampling and exact edit distance.

Texts are sequences of normalised words. An item is found in a document where some
stretch of it is within ``tolerance * words of the item`` word edits.

* Item lengths fall into classes (each up to a tenth longer than its shortest),
  windows of a document have the shortest length of a class. A window can only be
  near an item of the class if enough of its pairs of neighbouring words are pairs
  of the class (an edit breaks two at most); this filter has no false negatives and
  drops nearly all windows before any walk.
* The CGK random walk reads a window word by word and stays or moves on by a random
  bit of (walk, step, word). Sequences at a small edit distance soon walk in step
  and agree in most places afterwards: edit distance becomes Hamming distance.
* A key is a sample of places of the walk. Windows and items that share one of the
  keys of all walks are candidates; the number of keys follows from the recall
  wanted at the assumed share of agreeing places.
* Each candidate is decided by its exact edit distance to the best stretch nearby.
* Items under 8 words are found where they stand word for word.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, shared, text_batches, windows
from .substrings import _OUTER

TOLERANCE = 0.2
LEAST_WORDS = 8
#: Items are broadcast in blocks of about so many words (a few MB); more items mean more passes.
BLOCK_WORDS = 200_000
RECALL, AGREEING, PLACES, WALKS = 0.999, 0.4, 2, 5
#: Texts whose windows are worked on together, in characters, and slots of the table of word pairs.
TOGETHER, PAIR_SLOTS = 1 << 23, 1 << 20

_WORD = re.compile(r"\S+")


def normalised(word: str) -> str:
    return word.strip(_OUTER).lower()


def item_words(text: str | None) -> list[str]:
    return [w for w in map(normalised, (text or "").split()) if w]


def keys_per_walk(recall: float = RECALL, agreeing: float = AGREEING, places: int = PLACES, walks: int = WALKS) -> int:
    """Samples of each walk so that all keys together find a pair with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreeing**places) / walks))


@dataclass
class LengthClass:
    shortest: int
    need: int
    items: list[int]
    places: np.ndarray
    #: for each walk and sample the distinct keys, where each one's items begin, and the items
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class ItemIndex:
    """The items of a block: vocabulary, length classes and their key tables."""

    def __init__(self, items: list[tuple[int, str | None]], tolerance: float = TOLERANCE):
        self.tolerance = tolerance
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        #: items under LEAST_WORDS by number of words and key
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for item_id, text in items:
            words = item_words(text)
            if len(words) >= LEAST_WORDS:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                self.items.append((item_id, np.array(ids, np.int64)))
            elif words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
                key = int(self.word_keys(ids, len(ids))[0])
                self.short.setdefault(len(ids), {}).setdefault(key, []).append((item_id, ids))
        self.classes: list[LengthClass] = []
        self.pairs = np.zeros(PAIR_SLOTS, np.uint64)
        order = sorted(range(len(self.items)), key=lambda i: len(self.items[i][1]))
        rng, per_walk = np.random.default_rng(11), keys_per_walk()
        while order:
            shortest = len(self.items[order[0]][1])
            own = [i for i in order if len(self.items[i][1]) <= shortest * 1.1]
            order = order[len(own) :]
            longest = len(self.items[own[-1]][1])
            places = np.sort(rng.integers(0, 2 * shortest, (WALKS, per_walk, PLACES)), axis=2)
            c = LengthClass(shortest, max(1, shortest - 1 - 2 * int(tolerance * longest)), own, places, [])
            bit = np.uint64(1 << len(self.classes) % 64)
            for i in own:
                self.pairs[self.pair_slots(self.items[i][1], np.arange(len(self.items[i][1]) - 1))] |= bit
            starts = np.cumsum([0] + [len(self.items[i][1]) + 1 for i in own])[:-1]
            flat = np.concatenate([np.append(self.items[i][1], 0) for i in own])
            for keys in self.keys(c, flat, starts):
                by_key = np.argsort(keys, kind="stable")
                distinct, cuts = np.unique(keys[by_key], return_index=True)
                c.tables.append((distinct, np.append(cuts, len(keys)), np.array(own, np.int64)[by_key]))
            self.classes.append(c)

    @staticmethod
    def keys(c: LengthClass, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The keys of the windows at ``starts``, one array for each walk and sample."""
        padded = np.append(words, np.zeros(1, words.dtype))
        for walk, samples in enumerate(c.places):
            at, seen = np.zeros(len(starts), np.int64), []
            for step in range(int(samples.max()) + 1):
                inside = at < c.shortest
                symbol = np.where(inside, padded[np.minimum(starts + at, len(words))], -1)
                seen.append(symbol)
                h = mixed(symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((walk + 1) * 1_000_003 + step * 7919))
                at = at + ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
            for sample in samples:
                key = np.zeros(len(starts), np.uint64)
                for place in sample:
                    key = mixed(key * np.uint64(31) + seen[place].astype(np.uint64) + np.uint64(1))
                yield key

    @staticmethod
    def pair_slots(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The slots of the pairs of neighbouring words that begin at ``at``."""
        h = mixed(words[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words[at + 1].astype(np.uint64))
        return (h & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)

    @staticmethod
    def word_keys(words: np.ndarray, n: int) -> np.ndarray:
        """A key of every ``n`` words in a row."""
        return windows(mixed(words.astype(np.uint64)), n)

    def exact(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The first place of each short item in each text of ``words``, as ``matches`` gives them."""
        for n, table in self.short.items():
            if len(words) < n:
                continue
            keys, found = np.array(sorted(table), np.uint64), self.word_keys(words, n)
            at = np.flatnonzero(np.isin(found, keys))
            text = np.searchsorted(ends, at, "right")
            _, first = np.unique(text * len(keys) + np.searchsorted(keys, found[at]), return_index=True)
            for s, t in zip(at[first].tolist(), text[first].tolist(), strict=True):
                a = s - (int(ends[t - 1]) if t else 0)
                for item_id, item in table[int(found[s])]:
                    if np.array_equal(words[s : s + n], item):
                        yield t, item_id, a, a + n, 0

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, start) where a window of ``words`` (vocabulary ids, 0 for other words) shares a key with an item."""
        there = np.flatnonzero((words[:-1] != 0) & (words[1:] != 0))
        bits = self.pairs[self.pair_slots(words, there)]
        there, bits = there[bits != 0], bits[bits != 0]
        found = []
        for number, c in enumerate(self.classes):
            known = there[(bits >> np.uint64(number % 64)) & np.uint64(1) != 0]
            # windows with ``need`` pairs: those that begin at or before a pair and reach the one ``need`` - 1 behind it
            first, last = known[: max(0, len(known) - c.need + 1)], known[c.need - 1 :]
            low = np.maximum(last - c.shortest + 2, 0)
            low[1:] = np.maximum(low[1:], first[:-1] + 1)
            size = np.maximum(first - low + 1, 0)
            starts = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            if len(starts):
                for (known_keys, cuts, items), keys in zip(c.tables, self.keys(c, words, starts), strict=True):
                    place = np.minimum(np.searchsorted(known_keys, keys), len(known_keys) - 1)
                    at = np.flatnonzero(known_keys[place] == keys)
                    count = (cuts[1:] - cuts[:-1])[place[at]]
                    which = np.repeat(cuts[place[at]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    found.append(items[which] * len(words) + np.repeat(starts[at], count))
        if not found:
            return []
        each = np.unique(np.concatenate(found))
        return list(zip((each // len(words)).tolist(), (each % len(words)).tolist(), strict=True))

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, word behind the last, distance) of the nearest stretch of each item found in a text."""
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        gap = np.zeros(1, np.int64)
        near = defaultdict(list)
        flat = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
        for i, s in self.candidates(flat):
            t = int(np.searchsorted(ends, s, "right"))
            near[t, i].append(s - int(ends[t]) + len(texts[t]) + 1)
        out = list(self.exact(flat, ends))
        for (t, i), starts in near.items():
            words, (item_id, item) = texts[t], self.items[i]
            most, best = int(self.tolerance * len(item)), None
            for g in np.split(np.array(starts), np.flatnonzero(np.diff(starts) > len(item)) + 1):
                lo, hi = max(0, g[0] - len(item) // 2), min(len(words), g[-1] + len(item) + len(item) // 2)
                # an edit breaks two pairs of neighbouring words of the item at most
                if kept_pairs(item, words[lo:hi]) < len(item) - 1 - 2 * most:
                    continue
                d, a, b = nearest_stretch(item, words[lo:hi])
                if d <= most and (best is None or (d, lo + a) < best[:2]):
                    best = (d, lo + a, lo + b)
            if best:
                out.append((t, item_id, best[1], best[2], best[0]))
        return sorted(out)


def _last_row(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Edit distance of ``item`` to the best stretch that ends before each place of ``text``."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for w in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - at) + at
    return row


def kept_pairs(item: np.ndarray, text: np.ndarray) -> int:
    """How many pairs of neighbouring words of ``item`` stand in ``text``."""
    return int(np.isin(item[:-1] << 32 | item[1:], text[:-1] << 32 | text[1:]).sum())


def nearest_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The smallest edit distance of ``item`` to a stretch of ``text``, and the first such stretch [start, stop)."""
    row = _last_row(item, text)
    stop = int(np.argmin(row))
    back = _last_row(item[::-1], text[:stop][::-1])
    start = stop - int(np.flatnonzero(back == row[stop])[0])
    return int(row[stop]), start, stop


class Vocabulary(dict):
    """Vocabulary ids of raw words: 0 for words of no item, -1 for words without letters or digits left."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        w = normalised(word)
        value = self[word] = self.known.get(w, 0) if w else -1
        return value


def contaminations(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Where documents hold benchmark items: doc_id, item_id, start, stop, n_words, distance.

    One row for each row of ``docs`` and item: the nearest stretch, the first at
    ties, in code points of the text. Items with fewer than 8 words are
    found word for word only; null and empty ones and texts take no part; repeated items and rows are reported
    each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(words / BLOCK_WORDS))
    kind = "doc_id long, item_id long, start long, stop long, n_words long, distance long"
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = shared(spark, ItemIndex([(r.item_id, r.text) for r in mine.collect()], tolerance))

        def rows(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            seen = Vocabulary(index.value.vocabulary)
            for batch, texts in text_batches(batches, TOGETHER):
                ids = [np.fromiter(map(seen.__getitem__, t.split()), np.int64) for t in texts]
                cols: list[list[int]] = [[] for _ in range(6)]
                spans: dict[int, tuple[list, np.ndarray]] = {}
                for t, item, a, b, d in index.value.matches([x[x >= 0] for x in ids]):
                    if t not in spans:
                        spans[t] = [m.span() for m in _WORD.finditer(texts[t])], np.flatnonzero(ids[t] >= 0)
                    at, place = spans[t]
                    for c, v in zip(cols, (t, item, at[place[a]][0], at[place[b - 1]][1], b - a, d), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0])), *[pa.array(c, pa.int64()) for c in cols[1:]]], [x.split()[0] for x in kind.split(", ")])

        found = docs.mapInArrow(rows, kind)
        out = found if out is None else out.unionByName(found)
    return out
