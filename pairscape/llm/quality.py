"""Compression classifier of text quality.

Two zstandard dictionaries are trained from pieces of good and of bad labelled
texts. A whole text is compressed piece by piece with either; how much smaller
one total is, as a share of both (the normalised compressed-size difference), is
the evidence. A logistic calibration on labelled texts that no dictionary has
seen turns it, with the rate at which the text compresses at all, into the
probability of a good text. The rate is there for texts that repeat one word over
and over: either dictionary shrinks them to nothing and the difference is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, kept_dropped, memory_returned, shared

PIECE = 512
DICTIONARY = 65536
#: The model is fitted on at most so many labelled texts of each class, and each
#: dictionary on at most so many of their pieces (2 MB).
SAMPLE, PIECES = 3000, 4000
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of bad and good text, and weights of (1, difference, rate, difference * rate); about 130 KB."""

    dictionaries: tuple[bytes, bytes]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


class Sizes:
    """Compressed sizes of whole texts with the two dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.packers = []
        for data in dictionaries:
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=3)
            self.packers.append(zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, float]:
        """The normalised difference and the compressed share; (0, 0) for a text without bytes."""
        parts = pieces(text)
        if not parts:
            return 0.0, 0.0
        bad, good = (sum(len(p.compress(x)) for x in parts) for p in self.packers)
        return (bad - good) / (bad + good), (bad + good) / (2 * sum(map(len, parts)))


def _terms(f: np.ndarray) -> np.ndarray:
    d, r = np.clip(f[:, 0], -0.5, 0.5), np.clip(f[:, 1], 0, 1.5)
    return np.stack([d, r, d * r, r * r], axis=1)


def probability(model: QualityModel, f: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(f), model.constant)
    x = (_terms(f) - np.array(model.center)) / np.array(model.scale)
    z = np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)
    return 1 / (1 + np.exp(-z))


def fit_quality(labelled: DataFrame, sample: int = SAMPLE, prior: float | None = None) -> QualityModel:
    """A model from ``labelled`` (text, quality 0 or 1, key), fitted on the ``sample`` rows of each class with the smallest key hash.

    ``prior`` is the share of good texts that scores are calibrated for (the
    sample's own share if None). Rows without a text or label are left out. With one class, or too little text
    for a dictionary, every score is the smoothed share of good rows.
    """
    rows = labelled.where("text is not null and quality in (0, 1)")
    taken = [rows.where(f"quality = {q}").orderBy(F.xxhash64("key"), "key").limit(sample) for q in (0, 1)]
    data = [(r.text, r.quality) for r in taken[0].unionByName(taken[1]).select("text", "quality").collect()]
    share = (sum(q for _, q in data) + 1) / (len(data) + 2)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(data))
    first, second = [data[i] for i in order[::2]], [data[i] for i in order[1::2]]
    books = []
    for q in (0, 1):
        parts = [x for t, label in first if label == q for x in pieces(t)]
        parts = [parts[i] for i in rng.permutation(len(parts))[:PIECES]]
        try:
            books.append(zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, parts)) // 4)), parts).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            books.append(b"".join(parts)[-DICTIONARY:])
    if min(map(len, books)) < 8:
        return QualityModel((b"", b""), (), (), (), share)
    if len({q for _, q in second}) < 2:
        return QualityModel((b"", b""), (), (), (), share)
    sizes = Sizes((books[0], books[1]))
    raw = _terms(np.array([sizes.features(t) for t, _ in second]))
    center, scale = raw.mean(0), raw.std(0) + 1e-9
    x = np.column_stack([np.ones(len(raw)), (raw - center) / scale])
    # the classes were sampled apart: their weights restore the share of good texts
    y = np.array([q for _, q in second], float)
    good = y.mean() if prior is None else prior
    w = np.where(y == 1, good / y.mean(), (1 - good) / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - 0.01 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return QualityModel((books[0], books[1]), tuple(center), tuple(scale), tuple(beta))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` from 0 (bad) to 1 (good), from the text alone; null counts as empty."""
    held = shared(docs.sparkSession, model)

    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept_dropped()
        sizes = None if held.value.constant is not None else Sizes(held.value.dictionaries)
        for batch in batches:  # one text at a time is a Python string
            f = np.array([(0.0, 0.0) if sizes is None else sizes.features(t.as_py()) for t in batch], float).reshape(-1, 2)
            yield pa.array(probability(held.value, f))
            memory_returned()

    return docs.withColumn(score, F.arrow_udf(rate, "double")(F.col(text)))


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from the labelled documents that training may use: crc32(doc_id) mod 5 is not 0.

    Ids are sampled before texts are fetched, so at most ``2 * sample`` ids meet
    the documents, in a broadcast of known size. An id with both labels is bad.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    taken = [known.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id")
    return fit_quality(texts.select("text", "quality", F.col("doc_id").alias("key")), sample, prior)
