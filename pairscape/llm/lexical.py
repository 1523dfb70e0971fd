"""Ranked lexical search, term at a time, with a limited set of accumulators.

Documents are tokenised once into a forward index that keeps the query terms only;
it is written to the shared folder. A block of documents is then inverted in memory
and every item walks through its terms, the rarest first, adding integer scores to
one accumulator for each document. Beside it runs the bound of what the terms still
to come can add. Once that bound is below the k-th highest partial score, a document
without an accumulator can no longer reach the first k: no accumulators are made any
more, and the remaining terms only update those that exist, exactly.

The k-th partial score that every block starts with is that of the whole collection
after each item's rarest terms, found by a first walk over these terms alone; inside
a block it only rises. Blocks send their k best documents for each item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .common import list_column, shared, text_batches

#: Terms (with repeats) of the items of a chunk, about; a chunk's terms are a broadcast.
CHUNK_TERMS = 1 << 18
#: Documents and postings of a block at most (a document is never divided).
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 21
#: Distinct rarest terms of an item that the first walk covers.
HEAD = 4

#: Bytes of terms: digits, letters and all bytes of characters beyond ASCII; A-Z become a-z.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


@dataclass(frozen=True)
class Walk:
    """The terms of a chunk's items, rarest first.

    Item i walks through entries ``start[i]`` to ``start[i + 1]`` of ``term``, ``weight``
    (term weight times its occurrences in the item) and ``rest`` (the most that this
    entry and the ones behind it can add to any document). ``floor`` is the k-th
    highest partial score that is known beforehand.
    """

    items: np.ndarray
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    rest: np.ndarray
    floor: np.ndarray
    size: int
    total_docs: int
    total_terms: int


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, and the numbers and frequencies of the terms of ``vocabulary`` for each row of ``docs``."""
    held = shared(docs.sparkSession, vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = held.value.get, len(held.value) + 1
        for batch, texts in text_batches(batches):
            ids, lengths = [], np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                words = terms_of(text)
                lengths[i] = len(words)
                known = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
                ids.append(known[known >= 0] + i * size)
            keys, tfs = np.unique(np.concatenate(ids), return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(texts) + 1) * size)
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            term = (keys % size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(lengths),
                    list_column([term[a:b] for a, b in spans], pa.int32()),
                    list_column([tfs[a:b].astype(np.int32) for a, b in spans], pa.int32()),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    return docs.select("doc_id", "text").mapInArrow(index, INDEX)


def impacts(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """What a weight is multiplied with: saturated term frequency, with the document's length against the mean."""
    m = 25 + 75 * n * total_docs // total_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, which have one, row, term, frequency of each posting, with the row's length) in bounded pieces of Arrow batches."""
    for batch in batches:
        lists = batch.column("terms")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
        ids = batch.column("doc_id")
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        a = 0
        while a < batch.num_rows:
            b = min(a + BLOCK_DOCS, max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_POSTINGS, "right")) - 1), batch.num_rows)
            own = slice(ends[a], ends[b])
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            yield number[a:b], named[a:b], row, term[own], tf[own], n[a:b]
            a = b


def term_facts(index: DataFrame, size: int, total_docs: int, total_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each term, and its highest impact on any of them; tasks send one row a term that they have seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, _, row, term, tf, n in blocks(batches):
            df += np.bincount(term, minlength=size)
            np.maximum.at(best, term, impacts(tf, n[row], total_docs, total_terms))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen]), pa.array(best[seen])], ["term", "df", "best"])

    rows = index.mapInArrow(count, "term long, df long, best long").groupBy("term").agg(F.sum("df").alias("df"), F.max("best").alias("best")).collect()
    df, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in rows:
        df[r.term], best[r.term] = r.df, r.best
    return df, best


def term_weight(df: int, total_docs: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def walk_of(items: list[tuple[int, list[int]]], df: np.ndarray, best: np.ndarray, total_docs: int, total_terms: int) -> Walk:
    """The walk of (item, numbers of its terms with repeats): terms that no document holds are left out, rarest first."""
    start, term, weight, rest = [0], [], [], []
    for _, numbers in items:
        counts: dict[int, int] = {}
        for t in numbers:
            counts[t] = counts.get(t, 0) + 1
        order = sorted((t for t in counts if df[t]), key=lambda t: (df[t], t))
        gains = [counts[t] * term_weight(int(df[t]), total_docs) for t in order]
        most = [max(0, g) * int(best[t]) for t, g in zip(order, gains, strict=True)]
        left = sum(most)
        for t, g, gain in zip(order, gains, most, strict=True):
            term.append(t)
            weight.append(g)
            rest.append(left)
            left -= gain
        start.append(len(term))
    numbers = (np.array(x, np.int64) for x in (start, term, weight, rest))
    return Walk(np.array([i for i, _ in items], np.int64), *numbers, np.zeros(len(items), np.int64), len(df), total_docs, total_terms)


class BlockIndex:
    """Postings of one block of documents by term: rows and impacts."""

    def __init__(self, block: tuple, w: Walk):
        self.ids, self.named, row, term, tf, n = block
        order = np.argsort(term, kind="stable")
        self.row = row[order]
        self.impact = impacts(tf, n[row], w.total_docs, w.total_terms)[order] if len(row) else np.zeros(0, np.int64)
        self.ends = np.searchsorted(term[order], np.arange(w.size + 1))

    def walk(self, w: Walk, i: int, k: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the accumulators of item ``i`` after its terms (the first ``most`` of them)."""
        score = np.zeros(len(self.ids), np.int64)
        there = np.zeros(len(self.ids), bool)
        kth, growing = int(w.floor[i]), True
        last = w.start[i + 1] if most is None else min(w.start[i + 1], w.start[i] + most)
        for e in range(w.start[i], last):
            if growing and w.rest[e] < kth:
                growing = False
            a, b = self.ends[w.term[e]], self.ends[w.term[e] + 1]
            if a == b:
                continue
            rows, gain = self.row[a:b], self.impact[a:b] * w.weight[e]
            if growing:
                there[rows] = True
                score[rows] += gain
                # the block's own k-th partial score is a lower bound of the final one
                held = np.flatnonzero(there & self.named)
                if len(held) >= k:
                    kth = max(kth, int(np.partition(score[held], len(held) - k)[len(held) - k]))
            else:
                old = there[rows]
                score[rows[old]] += gain[old]
        # what lies below the score that k documents reach anyway is not sent
        held = np.flatnonzero(there & self.named & (score >= max(1, int(w.floor[i]))))
        return held, score[held]

    def best(self, w: Walk, i: int, k: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Doc ids and scores of the ``k`` best rows, ties to the smaller id."""
        rows, score = self.walk(w, i, k, most)
        if len(rows) > k:
            low = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= low], score[score >= low]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]


def _walked(index: DataFrame, walk: Walk, k: int, most: int | None = None) -> DataFrame:
    """(item, doc_id, score): the best ``k`` documents of every block for each item."""
    held = shared(index.sparkSession, walk)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for block in blocks(batches):
            part = BlockIndex(block, w)
            found = [part.best(w, i, k, most) for i in range(len(w.items))]
            items = np.repeat(w.items, [len(ids) for ids, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                ["item", "doc_id", "score"],
            )

    return index.mapInArrow(score, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _term_count(text: Column) -> Column:
    """Number of terms of a text, for sizing chunks."""
    return F.size(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents above score 0 for each item (all, if fewer), ties to the smaller doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not
    read. Null and empty texts have no terms. Every row of ``docs`` counts in the
    statistics; rows without doc_id are not ranked, rows that share a doc_id are
    ranked each. Items without id take no part; of repeated item ids the smallest
    text counts. Items without terms, and empty tables, give no rows.
    """
    spark = docs.sparkSession
    asked = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    size = asked.agg(F.sum(_term_count(F.col("text")))).first()[0] or 0
    chunks, out = max(1, math.ceil(size / CHUNK_TERMS)), None
    for chunk in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk) if chunks > 1 else asked
        found = _chunk(docs, sorted((r.item_id, terms_of(r.text)) for r in mine.collect()), k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _ranked(out, k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _chunk(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame | None:
    """(item, doc_id, score) with the ``k`` best of each item among them; None without terms."""
    vocabulary: dict[bytes, int] = {}
    numbered = [(i, [vocabulary.setdefault(t, len(vocabulary)) for t in terms]) for i, terms in items if terms]
    if not numbered:
        return None
    index = stored(forward_index(docs, vocabulary))
    facts = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not facts.docs:
        return None
    df, best = term_facts(index, len(vocabulary), facts.docs, facts.terms)
    walk = walk_of(numbered, df, best, facts.docs, facts.terms)
    partial = _walked(index, walk, k, HEAD)
    kth = _ranked(partial, k).where(F.col("rank") == k).select("item", "score").collect()
    floor = {r.item: r.score for r in kth}
    known = np.array([floor.get(i, 0) for i in walk.items.tolist()], np.int64)
    return _walked(index, Walk(walk.items, walk.start, walk.term, walk.weight, walk.rest, known, walk.size, walk.total_docs, walk.total_terms), k)
