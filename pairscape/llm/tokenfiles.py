"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A shard file holds a run of documents in ascending doc_id order::

    magic "FRQ1" | n documents, n tokens, n ranks: 3 x uint64
    doc_id of each document: int64 | presence of the id: uint8 | tokens of each document: uint32
    id of each rank: uint32 | control bytes | data bytes

An id is written as its rank by frequency in the whole corpus, in 1 to 4 bytes;
a control byte holds the lengths of four ranks, two bits each. Control and data
bytes lie apart, so a reader finds all lengths by one table lookup for each
control byte and gathers the values with numpy, without a loop over ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder, stored
from .bpe import TOGETHER, WORD_BPE, _loaded
from .common import packed_chunks, shared, summed_table, text_batches

MAGIC = b"FRQ1"
#: Lengths of the four ranks of each control byte.
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
#: Table of id counts: ids of the tokenizers are below 2**18.
ID_SLOTS = 1 << 18
#: Tokens in a shard file, about.
SHARD_TOKENS = 1 << 22


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    r = ranks.astype("<u4")
    length = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.concatenate([length - 1, np.zeros(-len(r) % 4, np.uint8)]).reshape(-1, 4).astype(np.uint8)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < length[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes (uint8 arrays)."""
    length = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < length[:, None]] = data
    return out.view("<u4").reshape(-1)


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, rank_of: np.ndarray, id_of: np.ndarray) -> bytes:
    control, data = pack_ranks(rank_of[ids])
    head = np.array([len(doc_ids), len(ids), len(id_of)], "<u8").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, keys, lengths.astype("<u4").tobytes(), id_of.astype("<u4").tobytes(), control, data])


def read_shard(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens of each document and all ids of a shard."""
    if content[:4] != MAGIC:
        raise ValueError("not a token-id file")
    docs, tokens, ranks = (int(x) for x in np.frombuffer(content, "<u8", 3, 4))
    at = 28

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    keys, there, lengths, id_of = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", ranks)
    control = take("u1", (tokens + 3) // 4)
    ids = id_of[unpack_ranks(control, take("u1", len(content) - at), tokens)]
    return [int(k) if t else None for k, t in zip(keys, there, strict=True)], lengths, ids


def encoded(docs: DataFrame, end_id: int, tokenizer: str = WORD_BPE) -> DataFrame:
    """doc_id and ids of each text as packed 16- or 32-bit integers, with ``end_id`` behind the last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer)
        kind = np.uint16 if max(max(bpe.tokens), end_id) < 1 << 16 else np.uint32
        for batch, texts in text_batches(batches, TOGETHER, keeping=True):
            ids = [np.append(i, end_id).astype(kind) for i in bpe.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.dtype.itemsize for i in ids], pa.int32()), pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "n_tokens", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, width int, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ID_SLOTS, np.uint64)
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width, kind in ((2, np.uint16), (4, np.uint32)):
                data = b"".join(batch.column("ids").filter(pa.array(widths == width)).to_pylist())
                n = np.bincount(np.frombuffer(data, kind))  # all documents of a batch at once
                table[: len(n)] += n.astype(np.uint64)
        yield from packed_chunks(table)

    return summed_table(tokens.select("width", "ids").mapInArrow(count, "chunk int, data binary"), ID_SLOTS, "uint64")


def write_token_files(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str = WORD_BPE, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes ``docs`` and writes shard files to ``folder``, in ascending doc_id order over the names of the files.

    ``folder`` is a URI that executors reach through pyarrow's filesystems. A
    shard is written under another name and then renamed, so a task that runs
    twice leaves one whole file. Rows without an id come first, rows of one id in
    the order of their ids' bytes.
    """
    spark = docs.sparkSession
    tokens = stored(encoded(docs, end_id, tokenizer))
    counts = id_counts(tokens)
    used = np.flatnonzero(counts)
    id_of = used[np.lexsort((used, -counts[used].astype(np.int64)))]
    rank_of = np.zeros(ID_SLOTS, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    shards = max(1, -(-int(counts.sum()) // shard_tokens))
    cuts = tokens.stat.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else []
    bounds = np.array(sorted(set(cuts)))
    tables = shared(spark, (rank_of, id_of))

    @F.pandas_udf("int")
    def shard(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.where(doc_id.isna(), 0, np.searchsorted(bounds, doc_id.fillna(0), "left")).astype(np.int32))

    dealt = tokens.withColumn("shard", shard("doc_id")).repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, known = tables.value
        fs, base = pafs.FileSystem.from_uri(folder)
        held: list[tuple[int | None, np.ndarray]] = []
        current, part = None, 0

        def flush() -> pa.RecordBatch:
            nonlocal part
            name = f"{base}/shard-{current:08d}-{part:06d}.frq"
            part += 1
            data = shard_bytes([d for d, _ in held], np.array([len(i) for _, i in held]), np.concatenate([i for _, i in held]), rank, known)
            rough = f"{base}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(rough) as f:
                f.write(data)
            fs.move(rough, name)
            held.clear()
            return pa.RecordBatch.from_pydict({"file": [name]})

        size = 0
        for batch in batches:
            for s, d, width, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "width", "ids")), strict=True):
                if held and (s != current or size >= 2 * shard_tokens):
                    yield flush()
                    part, size = (part if s == current else 0), 0
                current = s
                ids = np.frombuffer(data, np.uint16 if width == 2 else np.uint32)
                held.append((d, ids))
                size += len(ids)
        if held:
            yield flush()

    pafs_base = pafs.FileSystem.from_uri(folder)
    pafs_base[0].create_dir(pafs_base[1], recursive=True)
    dealt.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the shard files; ``start`` counts the ids of all documents before it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                doc_ids, lengths, ids = read_shard(content.as_buffer().to_pybytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.frq").load(folder).select("path", "content")
    docs = stored(found.mapInArrow(rows, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"))
    # a row for each file, so this window is short
    sizes = docs.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = sizes.select("file", (F.sum("tokens").over(Window.orderBy("file")) - F.col("tokens")).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_index(docs: DataFrame, end_id: int = 2, tokenizer: str = WORD_BPE) -> DataFrame:
    """Writes ``docs`` as token-id files below the shared folder and reads them back (see :func:`read_token_files`).

    Null and empty texts hold the end id alone; no rows: no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    uri = folder if "://" in folder else "file://" + folder
    write_token_files(docs, uri, end_id, tokenizer)
    if not docs.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, uri)
