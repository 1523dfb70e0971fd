"""Language identification with string kernels.

The kernel of two texts is the normalised number of n-grams (1 to 4 bytes of the
lower-cased letters, the blended spectrum) that both contain. Landmark texts give
the Nystroem features of a text, one-versus-rest kernel ridge regression on them
one value for each language. Whole batches are scored by matrix products: n-gram
presence times landmarks, times the Nystroem map and the ridge weights.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .common import crc_mod, shared

#: Longest n-gram, slots of hashed n-grams, n-grams that the kernel counts, landmarks (of each language at least), ridge.
GRAMS, SLOTS, FEATURES, LANDMARKS, LEAST_LANDMARKS, RIDGE = 4, 1 << 18, 8192, 160, 8, 1e-2
#: Texts of each language that are learned from.
SAMPLE = 200
#: Texts in a matrix product, and in one of the training.
ROWS, BLOCK = 64, 2048

_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_slots(text: str) -> np.ndarray:
    """The hash slots of all n-grams of a text, with repetitions."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" ", np.uint8).astype(np.uint32)
    out, code = [], np.zeros(len(data), np.uint32)
    for n in range(1, GRAMS + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        out.append(((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(14))
    return np.concatenate(out)


@dataclass(frozen=True)
class LanguageModel:
    """Feature of each slot (-1: none), landmark presence over their norms, and landmark weights by language; about 6 MB up to 20 languages, 0.3 MB for each beyond."""

    languages: tuple[str, ...]
    feature: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray


def presence(texts: list[str], feature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        f = feature[gram_slots(text)]
        out[i, f[f >= 0]] = 1
    return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised numbers of common n-grams; landmarks come divided by their norms."""
    return (rows @ landmarks.T) / np.sqrt(np.maximum(1, rows.sum(1, keepdims=True)))


def fit_language(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """A model from ``labelled`` (key, lang, text): the ``sample`` rows of each language with the smallest key hash.

    Rows without key, language or text are left out; None if no row is left. All
    languages are learned. The driver reads the n-gram slots of the sample language by
    language, 32 KB a text at most, and keeps 1 KB a text.
    """
    rows = labelled.where("key is not null and lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    ids = rows.select("key", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    taken = rows.select("key", "text").join(F.broadcast(ids.select("key", "lang").dropDuplicates(["key"])), "key").select("lang", "text", F.xxhash64("key").alias("order"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column("text").to_pylist():
                there = np.zeros(SLOTS, bool)
                there[gram_slots(text)] = True
                bits.append(np.packbits(there).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(bits, pa.binary())], ["lang", "order", "bits"])

    texts = stored(taken.mapInArrow(slots, "lang string, order long, bits binary"))

    def by_language() -> Iterator[tuple[str, np.ndarray]]:
        for lang, got in itertools.groupby(texts.orderBy("lang", "order").toLocalIterator(), lambda r: r.lang):
            yield lang, np.stack([np.frombuffer(r.bits, np.uint8) for r in got])

    # the n-grams whose presence differs most between a language and the rest
    most, least, languages, sizes = np.zeros(SLOTS, np.float32), np.ones(SLOTS, np.float32), [], []
    for lang, bits in by_language():
        share = np.unpackbits(bits, axis=1).mean(0, dtype=np.float32)
        most, least = np.maximum(most, share), np.minimum(least, share)
        languages.append(lang)
        sizes.append(len(bits))
    if not languages:
        return None
    spread = most - least if len(languages) > 1 else most
    chosen = np.argsort(-spread, kind="stable")[:FEATURES]
    feature = np.full(SLOTS, -1, np.int32)
    feature[chosen] = np.arange(len(chosen))
    label = np.repeat(np.arange(len(languages)), sizes)
    packed = np.concatenate([np.packbits(np.unpackbits(row)[chosen])[None] for _, bits in by_language() for row in bits])
    each = max(LEAST_LANDMARKS, LANDMARKS // len(languages))
    pick = np.concatenate([np.flatnonzero(label == c)[:each] for c in range(len(languages))])
    x = np.unpackbits(packed[pick], axis=1).astype(np.float32)
    landmarks = x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    value, vector = np.linalg.eigh(kernel(x, landmarks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    nystroem = vector[:, keep] / np.sqrt(value[keep])
    inner, outer = RIDGE * np.eye(nystroem.shape[1]) / 10, np.zeros((nystroem.shape[1], len(languages)))
    for a in range(0, len(packed), BLOCK):
        phi = kernel(np.unpackbits(packed[a : a + BLOCK], axis=1).astype(np.float32), landmarks) @ nystroem
        part = label[a : a + BLOCK]
        weighted = (phi / np.array(sizes)[part][:, None]).T
        inner += weighted @ phi
        outer += weighted @ np.where(part[:, None] == np.arange(len(languages)), 1.0, -1.0)
    beta = np.linalg.solve(inner, outer)
    return LanguageModel(tuple(languages), feature, landmarks.astype(np.float32), (nystroem @ beta).astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the whole text alone.

    ``und`` with score 1 for null texts and texts without a letter; ``und`` with
    score 0 for all others if there is no model.
    """
    held = shared(docs.sparkSession, model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            texts = list(batch)
            has = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
            lang, score = np.array(["und"] * len(texts), dtype=object), np.ones(len(texts))
            if m is None:
                score[has] = 0
            for a in range(0, len(has) if m is not None else 0, ROWS):
                part = has[a : a + ROWS]
                f = kernel(presence([texts[i] for i in part], m.feature), m.landmarks) @ m.weights
                best = f.argmax(1)
                e = np.exp(4 * (f - f.max(1, keepdims=True)))
                lang[part] = np.array(m.languages, dtype=object)[best]
                score[part] = (e / e.sum(1, keepdims=True)).max(1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    out = docs.withColumn("__p", F.pandas_udf(predict, "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)("text"))
    return out.withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")


def training_rows(docs: DataFrame) -> DataFrame:
    """(key, lang, text) of the documents that training may use: crc32(doc_id) mod 3 is not 1."""
    return docs.where(crc_mod("doc_id", 3) != 1).select(F.col("doc_id").alias("key"), "lang", "text")
