"""Periodic runs of words, found with an enhanced suffix array.

The words of a piece of many documents become numbers, and equal words of different
documents different numbers, so one suffix array serves the piece and no common prefix
leaves a document. Prefix doubling sorts it; its rank levels also give the common
prefix lengths (LCP) of neighbours by descent.

A run of period q whose last word is e has exactly one *branching tandem repeat*: the
square that starts at i = e + 1 - 2q, where the suffixes i and i + q part after q
words. Both lie in the LCP interval of depth q, in different children of it. So for
each interval, the suffixes of all its children but the largest are taken, and the
inverse suffix array tells whether the suffix ``depth`` words later or earlier lies in
the interval, beyond the child. Intervals are bounds in the arrays; there are no tree
nodes. Squares are rotated to the left as far as words agree, and what has the same
end and a multiple of a shorter period merges into that period's run.

A run of ``LEAST`` = 24 words or more and three periods or more has two suffixes with
at least 16 words in common. Documents without such a pair (told after four doublings,
by the same ranks) are done: they have no run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches

#: A run has so many words and so many periods at least.
LEAST, PERIODS = 24, 3
#: Doublings after which documents without equal ranks are done: 2**4 words.
FIRST_DOUBLINGS = 4
#: Characters of a piece of documents; a longer document is a piece of its own.
PIECE = 1 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def doubled(rank: np.ndarray, by: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice as many words, given those by ``by`` words.

    ``open_`` are the suffixes that share their rank; the others keep theirs. A rank is
    the number of suffixes that are smaller, so ranks stay comparable. Beyond the end
    lies nothing, which is smaller than anything.
    """
    n = len(rank)
    next_ = np.where(open_ + by < n, rank[np.minimum(open_ + by, n - 1)], -1)
    first = rank[open_]
    order = np.argsort(first * (n + 1) + next_ + 1)
    at, first, second = open_[order], first[order], next_[order]
    new_group = np.concatenate([[True], first[1:] != first[:-1]])
    new_pair = new_group | np.concatenate([[True], second[1:] != second[:-1]])
    place = np.arange(len(at))
    group_start = np.maximum.accumulate(np.where(new_group, place, 0))
    pair_start = np.maximum.accumulate(np.where(new_pair, place, 0))
    out = rank.copy()
    out[at] = first + pair_start - group_start
    alone = new_pair & np.concatenate([new_pair[1:], [True]])
    return out, np.sort(at[~alone])


def first_ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by one word, and the suffixes that share theirs."""
    order = np.argsort(codes)
    new = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    alone = new & np.concatenate([new[1:], [True]])
    return rank, np.sort(order[~alone])


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the LCP of each suffix with the one before it (0 for the first)."""
    n = len(codes)
    rank, open_ = first_ranks(codes)
    levels, by = [rank.astype(np.int32)], 1
    while len(open_):
        rank, open_ = doubled(rank, by, open_)
        by *= 2
        levels.append(rank.astype(np.int32))
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 2, -1, -1):  # the last level has no equal ranks
        live = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[live] = levels[k][a[live]] == levels[k][b[live]]
        for x in (a, b, lcp):
            x[same] += 1 << k
    return sa, rank, np.concatenate([[0], lcp])


def nearest(lcp: np.ndarray, at: np.ndarray, below: np.ndarray, step: int, minima: list[np.ndarray]) -> np.ndarray:
    """From each index ``at``, the nearest one in direction ``step`` whose value is under ``below``.

    ``minima[k]`` holds the least of 2**k values from an index on. Outside the array
    values count as under everything.
    """
    n = len(lcp)
    pos = at.copy()  # the values passed lie between ``at`` and ``pos``, ``pos`` excluded to the left, included to the right
    for k in range(len(minima) - 1, -1, -1):
        span = 1 << k
        if step < 0:
            fits = pos - span >= 0
            start = pos - span
        else:
            fits = pos + span < n
            start = pos + 1
        ok = np.zeros(len(pos), bool)
        ok[fits] = minima[k][start[fits]] >= below[fits]
        pos[ok] += step * span
    return pos + step


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat, in no order."""
    n = len(sa)
    minima = [lcp]
    while 1 << len(minima) <= n:
        half, last = 1 << (len(minima) - 1), minima[-1]
        minima.append(np.minimum(last[: len(last) - half], last[half:]))
    edge = np.flatnonzero(lcp > 0)  # where two children of an interval of this depth meet
    if not len(edge):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = lcp[edge]
    left = nearest(lcp, edge, depth, -1, minima)  # the interval's first row: the value there is smaller
    right = nearest(lcp, edge, depth, 1, minima)  # the row behind its last one
    child_end = nearest(lcp, edge, depth + 1, 1, minima)  # the row behind the child that starts here
    before = nearest(lcp, edge, depth + 1, -1, minima)
    first = before == left  # the child on the left is the interval's first one
    low = np.concatenate([edge, left[first]])
    high = np.concatenate([child_end, edge[first]])
    own = [np.concatenate([x, x[first]]) for x in (left, right, depth)]
    # the largest child of each interval is left out
    order = np.lexsort((low - high, own[1], own[0]))
    low, high = low[order], high[order]
    start, end, deep = (x[order] for x in own)
    largest = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    low, high, start, end, deep = (x[~largest] for x in (low, high, start, end, deep))
    size = high - low
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else low, size) + np.arange(size.sum())
    low, high, start, end, deep = (np.repeat(x, size) for x in (low, high, start, end, deep))
    i = sa[rows]
    found_at, found_period = [], []
    for j, square in ((i + deep, i), (i - deep, i - deep)):
        inside = np.flatnonzero((j >= 0) & (j < n))
        at = isa[j[inside]]
        hit = (at >= start[inside]) & (at < end[inside]) & ((at < low[inside]) | (at >= high[inside]))
        found_at.append(square[inside[hit]])
        found_period.append(deep[inside[hit]])
    pairs = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found_period)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def rotated(codes: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The first word of each square's run: rotated to the left while the word before equals the one a period later."""
    start = start.copy()
    live, width = np.arange(len(start)), 4
    while len(live):
        back = np.arange(1, width + 1)
        at = start[live, None] - back
        equal = (at >= 0) & (codes[np.maximum(at, 0)] == codes[np.maximum(at, 0) + period[live, None]])
        steps = np.where(equal.all(1), width, equal.argmin(1))
        start[live] -= steps
        live = live[steps == width]
        width = min(4 * width, max(4, (1 << 22) // max(1, len(live))))
    return start


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal runs with two periods or more, of smallest period each, by end and period."""
    square, period = branching_squares(*suffix_array(codes))
    end = square + 2 * period
    order = np.lexsort((period, end))
    square, period, end = square[order], period[order], end[order]
    done: list[np.ndarray] = []
    while len(square):
        # of each end the shortest period still open is that of a run
        first = np.concatenate([[True], end[1:] != end[:-1]])
        start = rotated(codes, square[first], period[first])
        done.append(np.stack([start, end[first], period[first]], 1))
        run = np.cumsum(first) - 1
        merged = (period % period[first][run] == 0) & (square >= start[run])
        square, period, end = square[~merged], period[~merged], end[~merged]
    out = np.concatenate(done) if done else np.zeros((0, 3), np.int64)
    return out[:, 0], out[:, 1], out[:, 2]


class Numbers(dict):
    """Numbers words from 0 in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def repeating(documents: list[list[bytes]]) -> list[bool]:
    """Which documents may hold two suffixes with 16 words or more in common; told by hashes of words, so one may be named that has none."""
    # a large odd step for each document keeps equal words of different documents apart
    hashes = [np.fromiter(map(hash, words), np.int64, len(words)) + np.int64(i * 0x9E3779B97F4A7C15 % (1 << 63)) for i, words in enumerate(documents)]
    codes = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(documents)), [len(c) for c in documents])
    out = np.zeros(len(documents), bool)
    if len(codes):
        rank, open_ = first_ranks(codes)
        for k in range(FIRST_DOUBLINGS):
            if not len(open_):
                break
            rank, open_ = doubled(rank, 1 << k, open_)
        out[owner[open_]] = True
    return out.tolist()


def coded(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, different ones in different documents."""
    numbers = Numbers()
    out = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in documents]
    step = len(numbers) + 1
    return [c + i * step for i, c in enumerate(out)]


def document_runs(documents: list[list[bytes]], least: int = LEAST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document that have ``least`` words and ``periods`` periods or more, by start and period."""
    # a run of that size has two suffixes with so many words in common
    common = min(max(least, periods * q) - q for q in range(1, least + 1))
    some = repeating(documents) if common >= 1 << FIRST_DOUBLINGS else [True] * len(documents)
    kept = [i for i, x in enumerate(some) if x and documents[i]]
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not kept:
        return out
    base = np.concatenate([[0], np.cumsum([len(documents[i]) for i in kept])])
    start, end, period = runs_of(np.concatenate(coded([documents[i] for i in kept])))
    length = end - start
    good = (length >= least) & (length >= periods * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    owner = np.searchsorted(base, start, "right") - 1
    for d, s, n, q in zip(owner.tolist(), (start - base[owner]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[kept[d]].append((s, n, q))
    return out


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties to the smallest start, then period."""
    best = None
    for run in runs:  # by start and period, so an equal one later does not win
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: those after a run's first period are dropped."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period planted by the id's checksum h: if h % 10 = 0, those from a on repeat the p words at a.

    With g = h // 10 and n words, a = g % n and p = 1 + (n - a) // (3 + g % 8). Null ids plant nothing.
    """
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % len(words)
    n = len(words) - a
    p = 1 + n // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (n // p + 1))[:n]


def periodic_runs(
    docs: DataFrame, least: int = LEAST, periods: int = PERIODS, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), best run, collapsed text of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run is a stretch of words with
    smallest period q that no neighbouring word extends, of ``least`` words and
    ``periods`` * q words or more. ``collapsed`` joins by one space the words that no run
    holds after its first q words. ``best`` has the greatest length / period (ties: the
    smallest start, then period), null without runs. ``prepare`` may change a document's
    words beforehand.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are
    judged one by one: repeated rows and null ids stay; an empty table gives no rows.
    Only doc_id and text are read, so other columns may have any name.
    """
    # squares of any length are found; what is reported has two periods at least
    periods = max(2, periods)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, PIECE):
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
            if prepare is not None:
                words = [prepare(i, w) for i, w in zip(ids, words, strict=True)]
            runs = document_runs(words, least, periods)
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            best = [None if (b := best_run(found)) is None else dict(zip(("start", "length", "period"), b, strict=True)) for found in runs]
            text = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(named, pa.list_(_RUN)),
                    pa.array(best, _RUN), pa.array(text, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)
