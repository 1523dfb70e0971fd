"""Substring dedup by hashed units of lines.

A text is cut into lines, a line into units: after a word that ends a sentence and
after words whose own hash says so (one in eight). Cuts depend on the words
beside them alone, so a passage has the same units wherever it stands in a line.
Units are normalised (case, white space and outer punctuation of words do not
count) and hashed to 96 bits. Units of several documents, or of several places in
one, only say where to look: there the sequences of ``min_words`` words or more that
begin or end with such a unit are hashed as well. Over all documents a sequence is
kept where (doc_id, position) is smallest; elsewhere it is a repeat. Overlapping and
neighbouring repeats form a span, which is removed, given by its code-point offsets
in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .common import has_bit, key_bits, mixed, shared, text_batches

MIN_WORDS = 8
CUT_EVERY = 8
#: Characters of texts whose units are worked out together.
TOGETHER = 1 << 19
#: Bits of the filter of repeated units: fixed, 8 MB in a broadcast.
FILTER_BITS = 26

_OUTER = ".,;:!?…\"'`()[]{}<>*#$%&|-–—«»„“”‚‘’"
_SENTENCE_END = (".", "!", "?", "…")
#: Whether a code point is white space; the last entry is for all larger ones.
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Marks(dict):
    """Hashes of normalised words; the lowest bit is set where a unit ends after the word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest((word.strip(_OUTER) or word).lower().encode("utf-8", "surrogatepass"))
        cut = word.endswith(_SENTENCE_END) or (h >> 20) % CUT_EVERY == 0
        value = self[word] = h & ~1 | cut
        return value


@lru_cache(maxsize=4)  # both bases and their inverses, of one size
def _powers(base: int, size: int) -> np.ndarray:
    """Powers 0 to size - 1 of an odd number, modulo 2**64."""
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def digests(h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each stretch [first, stop) of word hashes, the same wherever the stretch stands."""
    size, out = max(4096, 1 << len(h).bit_length()), []
    for base in _BASES:
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, size)[: len(h)])])
        out.append(mixed((upto[stop] - upto[first]) * _powers(pow(base, -1, 2**64), size)[first]))
    return out[0], out[1] >> np.uint64(33)


@dataclass(frozen=True)
class Units:
    """The words and units of several texts, one text behind the other.

    ``hashes`` of the words, ``spans`` of each word in its text (first code point,
    and the one behind the last), ``starts``: the first word of each unit and, as
    the last entry, the number of words; ``text`` of each unit; ``bounds``: the
    first word of each text, and the number of words.
    """

    hashes: np.ndarray
    spans: tuple[np.ndarray, np.ndarray]
    starts: np.ndarray
    text: np.ndarray
    bounds: np.ndarray


def units(texts: list[str | None], marks: Marks) -> Units:
    """The units of ``texts``; each distinct word is marked once."""
    joined = "\n".join([t or "" for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], ~_SPACE[np.minimum(points, len(_SPACE) - 1)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, stop = edges[::2], edges[1::2]
    line = np.cumsum(points == 10)[first]
    words = pa.array(joined.split(), pa.large_string()).dictionary_encode()
    known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    h = np.fromiter(map(marks.__getitem__, known), np.uint64, len(known))[words.indices.to_numpy()]
    last = (h & np.uint64(1)).astype(bool)
    last[:-1] |= line[1:] != line[:-1]  # a text begins a line
    last[-1:] = True
    begin = np.cumsum([0, *[len(t or "") + 1 for t in texts]])
    bounds = np.searchsorted(first, begin)
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])
    base = np.repeat(begin[:-1], np.diff(bounds))
    return Units(mixed(h | np.uint64(1)), (first - base, stop - base), starts, np.searchsorted(bounds, starts[:-1], "right") - 1, bounds)


def sequences(u: Units, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """[first, stop) of the sequences that begin or end with a unit and have ``min_words`` words, or the unit's if it is longer; by position."""
    a, b, n = u.starts[:-1], u.starts[1:], int(u.starts[-1])
    first, stop = np.concatenate([a, np.minimum(a, b - min_words)]), np.concatenate([np.maximum(b, a + min_words), b])
    whole = (first >= np.tile(u.bounds[u.text], 2)) & (stop <= np.tile(u.bounds[u.text + 1], 2))
    both = np.unique(first[whole] * (n + 1) + stop[whole])
    return both // (n + 1), both % (n + 1)


def _first_in_text(a: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each entry, the first one of the same text with its digest."""
    order = np.lexsort((a, text))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(a[order]) != 0)
    out = np.empty(len(a), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


def _repeated_units(docs: DataFrame) -> DataFrame:
    """(a, b, first_doc) of the units that documents of different ids hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for batch, texts in text_batches(batches, TOGETHER):
            u = units(texts, marks)
            a, b = digests(u.hashes, u.starts[:-1], u.starts[1:])
            new = np.flatnonzero(_first_in_text(a, u.text) == np.arange(len(a)))
            ids = batch.column("doc_id").take(pa.array(u.text[new]))
            yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].astype(np.int32)), ids], ["a", "b", "doc_id"])

    found = docs.select("doc_id", "text").where("doc_id is not null or text is not null").mapInArrow(rows, "a long, b int, doc_id long")
    # an absent id ranks behind all others
    ranked = found.select("a", "b", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"))
    return ranked.groupBy("a", "b").agg(F.min("id").alias("first_doc"), F.max("id").alias("last_doc")).where("first_doc <> last_doc").select("a", "b", "first_doc")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """What dedup removes: doc_id, text_hash, start, stop, n_words, first_doc_id.

    ``start`` and ``stop`` are code points of the original text, ``first_doc_id``
    the smallest document that keeps a part of the span (the document itself for
    a repeat within it). Documents rank by doc_id, null last; rows of one id (and
    all rows without one) rank alike and repeat each other only from position to
    position. Every removed word is part of ``min_words`` words in a row, or of a
    longer unit, that stand so in an earlier document, or earlier in the same one
    and apart. Null, empty and white texts have no units. No rows: no spans.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    repeated = stored(_repeated_units(docs))
    bits = shared(spark, key_bits(repeated, "a", FILTER_BITS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for batch, texts in text_batches(batches, TOGETHER):
            u = units(texts, marks)
            first, stop = sequences(u, min_words)
            a, b = digests(u.hashes, first, stop)
            text = np.searchsorted(u.bounds, first, "right") - 1
            again = first >= stop[_first_in_text(a, text)]
            # the units that a sequence holds as a whole have to be repeated ones
            known = np.concatenate([[0], np.cumsum(has_bit(bits.value, digests(u.hashes, u.starts[:-1], u.starts[1:])[0], FILTER_BITS))])
            lo, hi = np.searchsorted(u.starts[:-1], first), np.searchsorted(u.starts[1:], stop, "right")
            hit = np.flatnonzero(again | (known[hi] - known[lo] == hi - lo))
            first, stop, text = first[hit], stop[hit], text[hit]
            i, base = pa.array(text), u.bounds[text]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(i), batch.column("text_hash").take(i), pa.array(first - base), pa.array(stop - base), pa.array(u.spans[0][first]), pa.array(u.spans[1][stop - 1]), pa.array(a[hit].view(np.int64)), pa.array(b[hit].astype(np.int32)), pa.array(again[hit])],
                ["doc_id", "text_hash", "word", "word_stop", "start", "stop", "a", "b", "again"],
            )

    kind = "doc_id long, text_hash long, word long, word_stop long, start long, stop long, a long, b int, again boolean"
    hits = stored(docs.where("text is not null").withColumn("text_hash", F.xxhash64("text")).mapInArrow(rows, kind))
    rank = F.coalesce("doc_id", F.lit(2**63 - 1))
    firsts = hits.groupBy("a", "b").agg(F.min(rank).alias("first_doc"), F.max(rank).alias("last_doc")).where("first_doc <> last_doc")
    repeats = hits.join(firsts, ["a", "b"], "left").where(F.col("again") | (rank > F.col("first_doc")))
    repeats = repeats.select("doc_id", "text_hash", "word", "word_stop", "start", "stop", F.least("first_doc", rank).alias("first_doc")).distinct()
    place = Window.partitionBy("doc_id", "text_hash").orderBy("word", "word_stop")
    covered = F.max("word_stop").over(place.rowsBetween(Window.unboundedPreceding, -1))
    islands = repeats.withColumn("new", F.when(covered >= F.col("word"), 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "text_hash", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("word_stop") - F.min("word")).alias("n_words"), F.min("first_doc").alias("first_doc_id"),
    )
    own = F.when(F.col("first_doc_id") < 2**63 - 1, F.col("first_doc_id"))
    return spans.select("doc_id", "text_hash", "start", "stop", "n_words", own.alias("first_doc_id"))


def without_spans(text: str | None, starts, stops) -> str | None:
    """``text`` less the spans and the white space behind each."""
    if text is None or starts is None:
        return text
    out, at = [], 0
    for a, b in sorted(zip(starts, stops, strict=True)):
        out.append(text[at:a])
        at = b
        while at < len(text) and text[at].isspace():
            at += 1
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; all rows and other columns stay."""
    spans = repeated_spans(docs, min_words).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__spans")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, a, b) for t, a, b in zip(text, starts, stops, strict=True)], dtype=object)

    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut("text", "__spans.start", "__spans.stop"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
