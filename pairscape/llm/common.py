"""What several operators of this subpackage share: batches of texts, word hashes, summed tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dense table that travel as one piece.
CHUNK = 1 << 16
#: Texts are worked on in runs of about so many bytes, whatever the Arrow batch holds.
RUN_BYTES = 1 << 21
#: ``malloc_trim`` where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def runs(texts: list[str | None], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Slices (start, stop) of ``texts`` with about ``limit`` characters each; a longer text is a slice of its own."""
    return slices([len(text) if text else 0 for text in texts], limit)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Slices (start, stop) of about ``limit`` in all, each as long as it takes to reach it."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def lower_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """64-bit hashes of words; forgets all of them when it holds too many."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every ``k`` hashes in a row."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : n + i]
    return mixed(out)


def packed_chunks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's dense table as rows (chunk, data); zero chunks are left out."""
    pack = zstandard.ZstdCompressor(level=1)
    for k in range(0, len(table), CHUNK):
        piece = table[k : k + CHUNK]
        if piece.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()), "data": pa.array([pack.compress(piece.tobytes())], pa.binary())})


def summed_table(pieces: DataFrame, size: int, kind: str = "uint32") -> np.ndarray:
    """The sum of all tasks' dense tables, which have ``size`` entries at every size of the input.

    Pieces are dealt by chunk and added one after the other, so a task holds its
    chunks and one piece more, however many tasks made pieces.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                piece = np.frombuffer(unpack.decompress(data.as_py()), kind)
                if k in sums:
                    sums[k] += piece
                else:
                    sums[k] = piece.astype(kind)
        pack = zstandard.ZstdCompressor(level=1)
        for k, piece in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "data": pa.array([pack.compress(piece.tobytes())], pa.binary())})

    unpack, out = zstandard.ZstdDecompressor(), np.zeros(size, kind)
    for row in pieces.repartition("chunk").mapInArrow(add, "chunk int, data binary").collect():
        piece = np.frombuffer(unpack.decompress(row.data), kind)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(piece)] = piece
    return out


def key_bits(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits with the bit of every key (a long) set: a filter without false negatives, of fixed size."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            slot = key_slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            np.bitwise_or.at(table, slot >> 3, np.uint8(128) >> (slot & 7).astype(np.uint8))
        yield from packed_chunks(table)

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, found = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                piece = np.frombuffer(unpack.decompress(data.as_py()), np.uint8)
                found[k] = found[k] | piece if k in found else piece
        for k, piece in found.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "data": pa.array([zstandard.ZstdCompressor(level=1).compress(piece.tobytes())], pa.binary())})

    out, unpack = np.zeros((1 << bits) // 8, np.uint8), zstandard.ZstdDecompressor()
    kind = "chunk int, data binary"
    for row in keys.select(column).mapInArrow(fill, kind).repartition("chunk").mapInArrow(either, kind).collect():
        piece = np.frombuffer(unpack.decompress(row.data), np.uint8)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(piece)] = piece
    return out


def key_slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys) >> np.uint64(64 - bits)).astype(np.int64)


def has_bit(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    slot = key_slot(keys, bits)
    return (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def list_column(parts: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays; None is null."""
    lengths = np.fromiter((0 if p is None else len(p) for p in parts), np.int64, len(parts))
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    full = [p for p in parts if p is not None and len(p)]
    values = pa.array(np.concatenate(full) if full else np.zeros(0, np.int64), kind)
    nulls = pa.array(np.fromiter((p is None for p in parts), bool, len(parts)))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=nulls)


def text_batches(batches: Iterable[pa.RecordBatch], limit: int = RUN_BYTES, keeping: bool = False) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Pieces of Arrow batches with their ``text`` values, each of about ``limit`` characters; only one piece is Python text at a time.

    What :func:`kept` holds is dropped, unless the caller works with it (``keeping``).
    """
    if not keeping:
        kept_dropped()
    for batch in batches:
        for a, b in slices(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), limit):
            piece = batch.slice(a, b - a)
            yield piece, piece.column("text").to_pylist()
        del batch
        memory_returned()


_KEPT: dict = {}


def kept(key, make: Callable):
    """What a worker keeps from one task to the next, until a task of an operator that has no use for it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def kept_dropped() -> None:
    if _KEPT:
        _KEPT.clear()
        memory_returned()


def memory_returned() -> None:
    """Give the system back what Arrow and the C library hold unused: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def crc_mod(column: str, by: int):
    """crc32 of the id as text, modulo ``by``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by)


def shared(spark: SparkSession, value) -> Callable:
    """A broadcast of a value of fixed, documented size."""
    return spark.sparkContext.broadcast(value)
