"""Language-model scores by logistic context mixing.

The text of a document is its lower-cased words, each with a space behind, and an
end mark. Words are spelled byte by byte; a byte is a path of binary decisions in a
code tree of the byte before it. Bit predictors with hashed contexts (the tree node
alone, with one and with two bytes more, with the whole beginning of the word) hold
counts from all training documents. Their logits are combined by weights that a gate
chooses by how well known the longer contexts are; an adaptive map refines the
result. Weights and map are learned online over all training blocks, each word
without its own counts, and averaged.

A word's probability mixes its discounted share among all training tokens and its
spelling, which gets what the discount (estimated from words seen once and twice)
takes away, with its share among all that follows the word before in the training
documents. A gate chooses the weight of that context by how often it was seen; the
weights are learned on the token stream, each token without its own occurrence, as a
training document's contexts are scored, too. All weights then follow the document:
every 32 tokens they move to the share of tokens so far that the context, and the
known words, explain.

Documents travel in blocks of about ``BLOCK_CHARS`` characters, split into words
once: all later passes read a block's distinct words and their counts. A block sends its
distinct words' hashes, dealt by hash, and gets their counts over the whole corpus
back, so no task holds the corpus vocabulary. Pairs of words go the same way.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import lower_words, memory_returned, mixed, packed_chunks, shared, summed_table, text_batches

BLOCK_CHARS = 1 << 22
#: Words whose binary decisions are worked on together (about a million decisions).
TOGETHER = 40_000
#: Slots of the predictors: node; node and 1 byte; node and 2 bytes; node and the word so far. 30 MB of counts in a broadcast.
SLOTS = (1 << 16, 1 << 18, 1 << 19, 1 << 20)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *SLOTS)))
PREDICTORS, GATES, STEPS = len(SLOTS), 16, 24
#: Added to counts, learning rate, events in an online step, strength in tokens of the mixing weight at first, tokens between its updates.
ADDED, RATE, BATCH, STRENGTH, CHUNK = 0.4, 0.02, 1 << 15, 64.0, 32
#: Distinct words of all blocks that one bucket of hashes holds, about.
BUCKET_WORDS = 1 << 20
END = b"\n"
#: Hash of the beginning of a document; bits of the hash of a pair; sizes of a context that the gate tells apart; tokens that the first weights stand for.
START, PAIR_BITS, SEEN, FIRST = np.uint64(0x51A3D2C4B5968778), 48, 16, 50.0

_BLOCK = "block long, doc_ids array<long>, train_docs long, words binary, counts binary, lengths binary, tokens binary, train binary"
_BLOCK_COLUMNS = [c.split()[0] for c in _BLOCK.split(", ")]


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, train) in blocks, split into words once.

    A block has its ids, the number of its training documents, its distinct
    lower-cased words in the order of their hashes with their training counts,
    and the number of words and the words (by number) of each document.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch, texts in text_batches(batches, BLOCK_CHARS):
            docs = [lower_words(t) for t in texts]
            lengths = np.fromiter(map(len, docs), np.int64, len(docs))
            found = pa.array([w for d in docs for w in d], pa.large_binary()).dictionary_encode()
            known = found.dictionary.to_numpy(zero_copy_only=False)
            order = np.argsort(word_hashes(known.tolist()), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            tokens = place[found.indices.to_numpy()]
            train = np.array(batch.column("train").to_pylist(), bool)
            counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(known))
            ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column("doc_id"))
            packed = [packer.compress(x) for x in (b" ".join(known[order].tolist()), counts.astype(np.uint32).tobytes(), lengths.tobytes(), tokens.tobytes(), train.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([int(train.sum())], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], ["block", "doc_ids", "train_docs", "words", "counts", "lengths", "tokens", "train"])
            number += 1

    return stored(docs.select(F.col("doc_id").cast("long"), "text", F.col("train").cast("boolean")).mapInArrow(pack, _BLOCK))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def unpacked(words: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    """A block's distinct words in the order of their hashes, and their training counts."""
    unpacker = zstandard.ZstdDecompressor()
    return unpacker.decompress(words).split(), np.frombuffer(unpacker.decompress(counts), np.uint32)


def packed_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as their differences, byte by byte, and their counts."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel()


def word_keys(words: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's words in order, and their training counts."""
    words, n = unpacked(words, counts)
    return word_hashes(words), n


@dataclass(frozen=True)
class Stream:
    """The tokens of a block's documents with an end mark behind each.

    ``tokens``: words by number, the end mark last; ``of``: the document; ``place``: the place in it;
    ``train``: is it a training document.
    """

    tokens: np.ndarray
    of: np.ndarray
    place: np.ndarray
    train: np.ndarray
    lengths: np.ndarray


def stream_of(words: int, lengths: bytes, tokens: bytes, train: bytes) -> Stream:
    """The stream of a block of so many distinct words."""
    unpacker = zstandard.ZstdDecompressor()
    lengths = np.frombuffer(unpacker.decompress(lengths), np.int64) + 1
    ends_at = np.cumsum(lengths)
    number = np.full(int(ends_at[-1]) if len(lengths) else 0, words, np.int32)
    inner = np.ones(len(number), bool)
    inner[ends_at - 1] = False
    number[inner] = np.frombuffer(unpacker.decompress(tokens), np.int32)
    of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = (np.arange(len(number)) - np.repeat(ends_at - lengths, lengths)).astype(np.int32)
    return Stream(number, of, place, np.frombuffer(unpacker.decompress(train), bool)[of], lengths)


def pairs_of(some: Stream, words: list[bytes]) -> np.ndarray:
    """Hashes of each token with the one before it."""
    own = np.append(word_hashes(words), np.uint64(xxhash.xxh3_64_intdigest(END)))[some.tokens]
    before = np.where(some.place >= 1, np.roll(own, 1), START)
    return mixed(before * np.uint64(_BASE) + own) >> np.uint64(64 - PAIR_BITS)


def pair_keys(words: bytes, counts: bytes, lengths: bytes, tokens: bytes, train: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's pairs in order, and how often they stand in its training documents."""
    words = unpacked(words, counts)[0]
    some = stream_of(len(words), lengths, tokens, train)
    keys, at = np.unique(pairs_of(some, words), return_inverse=True)
    return keys, np.bincount(at, weights=some.train, minlength=len(keys)).astype(np.uint32)


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their words, and those of each token's pair."""
    packer = zstandard.ZstdCompressor(level=1)
    names = _BLOCK_COLUMNS[1:]
    for ids, train_docs, *block, answers, pairs in _rows(batches):
        words = unpacked(*block[:2])[0]
        _, at = np.unique(pairs_of(stream_of(len(words), *block[2:]), words), return_inverse=True)
        found = _counts_of(pairs)[at].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
        packed = [*block, packer.compress(_counts_of(answers).tobytes()), packer.compress(found)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([train_docs], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], [*names, "replies", "pairs"]
        )
        memory_returned()


def pair_counts(data: bytes) -> np.ndarray:
    """The corpus counts of each token's pair."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view(np.uint32).ravel().astype(np.int64)


def word_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


def corpus_counts(blocks: DataFrame, keys=word_keys, columns: tuple[str, ...] = ("words", "counts"), width: int = 64, each: int = 300_000) -> DataFrame:
    """block, bucket, counts of the block's keys in that bucket (in their order), and the bucket's totals once.

    ``keys`` gives a block's ascending hashes of ``width`` bits and their counts from ``columns``, about ``each`` of them.
    """
    number = blocks.count()
    bits = min(16, max(6, math.ceil(math.log2(max(1, number * each / BUCKET_WORDS)))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, *row in _rows(batches):
            hashes, n = keys(*row)
            cuts = np.searchsorted(hashes >> np.uint64(width - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = [k for k in range(1 << bits) if cuts[k] < cuts[k + 1]]
            body = [packed_keys(hashes[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]]) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array(body, pa.binary())], ["bucket", "block", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)

        def flush(bucket: int, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
            raw = [unpacked_keys(d) for _, d in asked]
            hashes, counts = (np.concatenate(x) for x in zip(*raw, strict=True))
            _, at = np.unique(hashes, return_inverse=True)
            total = np.bincount(at, weights=counts).astype(np.int64)
            replies = [packer.compress(x.tobytes()) for x in np.split(total[at], np.cumsum([len(k) for k, _ in raw])[:-1])]
            facts = [[int(f)] + [0] * (len(asked) - 1) for f in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())]
            return pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in asked], pa.int64()), pa.array([bucket] * len(asked), pa.int32()), pa.array(replies, pa.binary()), *[pa.array(f, pa.int64()) for f in facts]],
                ["block", "bucket", "counts", "tokens", "distinct", "once", "twice"],
            )

        current, asked = None, []
        for bucket, number, data in _rows(batches):
            if asked and bucket != current:
                yield flush(current, asked)
                asked = []
            current = bucket
            asked.append((number, data))
        if asked:
            yield flush(current, asked)

    dealt = blocks.select("block", *columns).mapInArrow(ask, "bucket int, block long, data binary").repartition(1 << min(bits, 12), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(answer, "block long, bucket int, counts binary, tokens long, distinct long, once long, twice long")


@dataclass(frozen=True)
class Codes:
    """Binary paths of a byte after another: first entry and length by ``before * 256 + byte``; node and bit of the entries. Under 10 MB."""

    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def code_trees(pairs: np.ndarray) -> Codes:
    """Huffman trees by the counts of byte pairs; every byte has a path after every other."""
    first, length, nodes, bits = np.zeros(65536, np.int64), np.zeros(65536, np.int64), [], []
    for before in range(256):
        heap: list[tuple[int, int, object]] = [(int(n) + 1, s, s) for s, n in enumerate(pairs[before * 256 : before * 256 + 256])]
        heapq.heapify(heap)
        name = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], name, (a[2], b[2])))
            name += 1
        todo, inner = [(heap[0][2], [])], 0
        while todo:
            tree, path = todo.pop()
            if isinstance(tree, int):
                key = before * 256 + tree
                first[key], length[key] = len(nodes), len(path)
                nodes += [n for n, _ in path]
                bits += [b for _, b in path]
            else:
                mine = before * 256 + inner
                inner += 1
                todo += [(tree[0], [*path, (mine, 0)]), (tree[1], [*path, (mine, 1)])]
    return Codes(first, length, np.array(nodes, np.int32), np.array(bits, np.int8))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        make = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        _POWERS[size] = make(_BASE), make(pow(_BASE, -1, 2**64))
    return _POWERS[size]


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, each with a space behind, and the word of each byte."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return flat, np.repeat(np.arange(len(words)), lengths)


def events(words: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each binary decision: its word, its bit, and its slot with each predictor."""
    flat, word = spelled(words)
    n = len(flat)
    start = np.flatnonzero(np.diff(word, prepend=-1))[word]
    at = np.arange(n)
    before = [np.where(at - k >= start, flat[np.maximum(at - k, 0)], 32).astype(np.uint32) for k in (1, 2, 3)]
    power, inverse = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:n])])
    so_far = (((sums[at] - sums[start]) * inverse[start]) >> np.uint64(17)).astype(np.uint32)
    key = before[0].astype(np.int64) * 256 + flat
    length = codes.length[key]
    byte = np.repeat(at, length)
    entry = np.arange(len(byte)) - np.repeat(np.cumsum(length) - length - codes.first[key], length)
    node, bit = codes.node[entry].astype(np.uint32), codes.bit[entry]
    spread = node * np.uint32(0x9E3779B1)
    contexts = (before[1] + np.uint32(1), before[1] + np.uint32(257) * (before[2] + np.uint32(1)), so_far)
    slots = [node.astype(np.int64)]
    for k, context in enumerate(contexts, 1):
        h = (spread ^ (context * np.uint32(0x85EBCA6B))[byte]) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
        slots.append((h >> np.uint32(32 - SLOTS[k].bit_length() + 1)).astype(np.int64) + OFFSETS[k])
    return word[byte], bit, slots


@dataclass(frozen=True)
class Mixer:
    """Gated weights (a row of predictors and a bias for each gate) and the refining map (a logit for each gate and step)."""

    weights: np.ndarray
    map: np.ndarray


def inputs(slots: list[np.ndarray], counts: np.ndarray, own: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the predictors with a bias of 1 behind, and the gate; ``own`` counts of the word itself are left out."""
    x = np.ones((len(bit), PREDICTORS + 1), np.float32)
    gate = np.zeros(len(bit), np.int64)
    pairs = counts.view(np.uint64).ravel()  # both counts of a slot are fetched as one
    own_one = np.where(bit == 1, own, np.float32(0))
    own_zero = own - own_one
    for k, slot in enumerate(slots):
        pair = pairs.take(slot).view(np.float32)
        zero, one = np.maximum(pair[::2] - own_zero, 0), np.maximum(pair[1::2] - own_one, 0)
        x[:, k] = np.log((one + np.float32(ADDED)) / (zero + np.float32(ADDED)))
        if k >= PREDICTORS - 2:
            gate = 4 * gate + _known(one + zero)
    return np.clip(x, -12, 12, out=x), gate


def _known(n: np.ndarray) -> np.ndarray:
    """How well a slot of so many counts is known, 0 to 3."""
    return (n > 0).astype(np.uint8) + (n > 7) + (n > 127)


def slot_values(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logit of every slot, and how well it is known."""
    zero, one = counts[:, 0], counts[:, 1]
    return np.clip(np.log((one + np.float32(ADDED)) / (zero + np.float32(ADDED))), -12, 12), _known(one + zero)


def looked_up(slots: list[np.ndarray], logits: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`inputs` gives where no counts are left out."""
    x = np.ones((len(slots[0]), PREDICTORS + 1), np.float32)
    for k, slot in enumerate(slots):
        x[:, k] = logits.take(slot)
    return x, 4 * known.take(slots[-2]).astype(np.int64) + known.take(slots[-1])


def mixed_logits(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", x, weights.take(gate, axis=0)), -12, 12)


def step_of(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return gate * STEPS + np.clip(np.floor(z + STEPS / 2), 0, STEPS - 1).astype(np.int64)


def refined(z: np.ndarray, gate: np.ndarray, mixer: Mixer) -> np.ndarray:
    """The mean of the mixed logit and the map's."""
    return (z + mixer.map[step_of(z, gate)]) / 2


def start_weights() -> np.ndarray:
    return np.tile(np.array([0.3] * PREDICTORS + [0.0], np.float32), (GATES, 1))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True)


def _counts_of(replies: list[dict] | None) -> np.ndarray:
    unpacker = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unpacker.decompress(r["counts"]), np.int64) for r in replies or ()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, train), learned from the rows with ``train``.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte; the scores are log10 probabilities. Null, empty and white texts
    are the end token alone, a null ``train`` counts as false, repeated rows count and
    are scored each. Without training rows all words are unknown, the counts of the
    predictors are 0 and the scores those of the smoothed empty model.
    """
    spark = docs.sparkSession
    blocks = blocks_of(docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train")))
    replies = stored(corpus_counts(blocks))
    sums = replies.agg(F.sum("tokens"), F.sum("distinct"), F.sum("once"), F.sum("twice")).first()
    ends = blocks.agg(F.sum("train_docs")).first()[0] or 0
    total, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    once, twice = sums[2] or 0, sums[3] or 0
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    reserve = min(0.99, max(0.001, discount * distinct / max(1, total)))
    # a block has one reply for each bucket
    def gathered(some: DataFrame, name: str) -> DataFrame:
        return some.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias(name))

    tokens_of = ("words", "counts", "lengths", "tokens", "train")
    pairs = stored(corpus_counts(blocks, pair_keys, tokens_of, PAIR_BITS, 600_000))
    joined = blocks.join(gathered(replies, "replies"), "block", "left").join(gathered(pairs, "pairs"), "block", "left")
    kind = _BLOCK.partition(", ")[2] + ", replies binary, pairs binary"
    known = stored(joined.select(*_BLOCK_COLUMNS[1:], "replies", "pairs").mapInArrow(resolved, kind))

    def vocabulary(train_docs: int, words: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
        """Distinct words and their training counts in the block, the end mark last."""
        words, n = unpacked(words, counts)
        return [*words, END], np.append(n.astype(np.int64), train_docs)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(65536, np.uint64)
        for row in _rows(batches):
            words, n = vocabulary(*row)
            flat, word = spelled(words)
            key = np.concatenate([[32], flat[:-1]]).astype(np.int64) * 256 + flat
            table += np.bincount(key, weights=n[word], minlength=65536).astype(np.uint64)
        yield from packed_chunks(table)

    narrow = known.select("train_docs", "words", "counts")
    codes = shared(spark, code_trees(summed_table(narrow.mapInArrow(count_pairs, "chunk int, data binary"), 65536, "uint64")))

    def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * OFFSETS[-1], np.uint64)
        for row in _rows(batches):
            words, n = vocabulary(*row)
            there = np.flatnonzero(n)
            for a in range(0, len(there), TOGETHER):
                some = there[a : a + TOGETHER]
                word, bit, slots = events([words[i] for i in some], codes.value)
                weight = n[some][word].astype(np.float64)
                for k, slot in enumerate(slots):
                    own = table[2 * OFFSETS[k] : 2 * OFFSETS[k + 1]]
                    own += np.bincount(2 * (slot - OFFSETS[k]) + bit, weights=weight, minlength=len(own)).astype(np.uint64)
        yield from packed_chunks(table)

    counts = summed_table(narrow.mapInArrow(count_bits, "chunk int, data binary"), 2 * OFFSETS[-1], "uint64")
    counts = shared(spark, counts.astype(np.float32).reshape(-1, 2))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = start_weights(), np.zeros(GATES)
        hits = np.zeros((2, GATES * STEPS))
        for train_docs, words, counted, answers in _rows(batches):
            words, n = vocabulary(train_docs, words, counted)
            there = np.flatnonzero(n)
            whole = np.append(word_counts(answers), n[-1])
            for first in range(0, len(there), TOGETHER):
                some = there[first : first + TOGETHER]
                word, bit, slots = events([words[i] for i in some], codes.value)
                own = whole[some].astype(np.float32)[word]
                for a in range(0, len(bit), BATCH):
                    part = slice(a, a + BATCH)
                    y = bit[part]
                    x, gate = inputs([s[part] for s in slots], counts.value, own[part], y)
                    z = mixed_logits(x, gate, weights)
                    error = (y - 1 / (1 + np.exp(-z))).astype(np.float32)
                    step = step_of(z, gate)
                    hits += np.bincount(2 * step + y, minlength=2 * GATES * STEPS).reshape(-1, 2).T
                    size = np.bincount(gate, minlength=GATES)
                    seen += size
                    rate = RATE * 50 / np.sqrt(1 + seen / BATCH) / np.maximum(size, 50)
                    for k in range(PREDICTORS + 1):
                        weights[:, k] += rate * np.bincount(gate, weights=error * x[:, k], minlength=GATES)
        kind = np.repeat([0, 1], [weights.size, hits.shape[1]])
        place = np.concatenate([np.arange(weights.size), np.arange(hits.shape[1])])
        one = np.concatenate([(weights * seen[:, None]).ravel(), hits[0]])
        two = np.concatenate([np.repeat(seen, PREDICTORS + 1), hits[1]])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(one), pa.array(two)], ["kind", "place", "one", "two"])

    learned = known.select("train_docs", "words", "counts", "replies").mapInArrow(learn, "kind int, place int, one double, two double")
    weights, hits = start_weights().ravel(), np.zeros((2, GATES * STEPS))
    for r in learned.groupBy("kind", "place").agg(F.sum("one").alias("one"), F.sum("two").alias("two")).collect():
        if r.kind == 0 and r.two > 0:
            weights[r.place] = r.one / r.two
        elif r.kind == 1:
            hits[:, r.place] = r.one, r.two
    steps = np.tile(np.arange(STEPS) - STEPS / 2 + 0.5, GATES)
    pull = 1 / (1 + np.exp(-steps))  # a step seen little keeps its own logit
    refine = np.log((hits[1] + 20 * pull) / (hits[0] + 20 * (1 - pull)))
    mixer = shared(spark, Mixer(weights.reshape(GATES, -1).astype(np.float32), np.clip(refine, -12, 12).astype(np.float32)))

    def learn_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = FIRST * start_contexts()
        sums = first.copy()
        for lengths, found, train, answers, pairs in _rows(batches):
            whole = np.append(word_counts(answers), ends)
            some = stream_of(len(whole) - 1, lengths, found, train)
            gate, follows = context_shares(some, whole, pair_counts(pairs), ends)
            there = np.flatnonzero(some.train)
            rest = np.maximum(whole[some.tokens[there]] - 1 - discount, 0) / max(1, total)
            for a in range(0, len(there), BATCH):
                part = there[a : a + BATCH]
                p = np.column_stack([follows[part], rest[a : a + BATCH]])
                p[p.sum(1) == 0, 1] = 1  # a new word is the rest's
                p *= (sums / sums.sum(1, keepdims=True))[gate[part]]
                p /= p.sum(1, keepdims=True)
                for k in range(2):
                    sums[:, k] += np.bincount(gate[part], weights=p[:, k], minlength=len(sums))
        sums -= first
        place = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(sums.ravel()[place])], ["place", "n"])

    sums = FIRST * start_contexts()
    told = known.select("lengths", "tokens", "train", "replies", "pairs").mapInArrow(learn_contexts, "place int, n double")
    for r in told.groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums.ravel()[r.place] += r.n
    contexts = shared(spark, context_weights(sums))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, known_ = slot_values(counts.value)
        for ids, words, n, lengths, found, train, answers, pairs in _rows(batches):
            words = [*unpacked(words, n)[0], END]
            spelling = np.zeros(len(words))
            for a in range(0, len(words), TOGETHER):
                word, bit, slots = events(words[a : a + TOGETHER], codes.value)
                x, gate = looked_up(slots, logits, known_)
                z = refined(mixed_logits(x, gate, mixer.value.weights), gate, mixer.value)
                spelling[a : a + TOGETHER] = np.bincount(word, weights=-np.logaddexp(0, np.where(bit == 1, -z, z)))
                del word, bit, slots, x, gate, z
            some, whole = stream_of(len(words) - 1, lengths, found, train), np.append(word_counts(answers), ends)
            tokens, of, lengths = some.tokens, some.of, some.lengths
            gate, follows = context_shares(some, whole, pair_counts(pairs), ends)
            c = whole[tokens]
            base = np.bincount(of, weights=np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), minlength=len(lengths))
            share, other = np.maximum(c - discount, 0) / (max(1, total) * (1 - reserve)), np.exp(np.maximum(spelling, -700))[tokens]
            bytes_ = np.bincount(of, weights=np.fromiter(map(len, words), np.int64)[tokens] + 1, minlength=len(lengths))
            values = adaptive_scores(share, other, spelling[tokens], lengths, 1 - reserve, contexts.value[gate, 0], follows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(np.bincount(of, weights=c > 0, minlength=len(lengths)).astype(np.int64)), pa.array(base), pa.array(values), pa.array(-values * math.log2(10) / bytes_)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"],
            )
            memory_returned()

    kind = "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    out = known.select("doc_ids", *tokens_of, "replies", "pairs").mapInArrow(score, kind)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def start_contexts() -> np.ndarray:
    """First weights of the context and the rest for each gate; a context never seen has none."""
    return context_weights(np.full((SEEN, 2), 0.5))


def context_weights(sums: np.ndarray) -> np.ndarray:
    """Weights in proportion to what each part explained; 0 for a context never seen."""
    sums = sums.copy()
    sums[0, 0] = 0
    return sums / sums.sum(1, keepdims=True)


def context_shares(some: Stream, whole: np.ndarray, pairs: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """The gate of each token and its share among all that follows the word before it.

    A word was seen as a context as often as it stands in training documents: each has
    something behind it, the end mark at least. Own occurrences of training tokens are left out.
    """
    own = some.train.astype(np.int64)
    seen = np.maximum(np.where(some.place >= 1, np.roll(whole[some.tokens], 1), ends) - own, 0)
    share = np.minimum(np.maximum(pairs - own, 0) / np.maximum(seen, 1), 1)
    return np.minimum(np.frexp(seen.astype(np.float64))[1], SEEN - 1), share


def adaptive_scores(
    share: np.ndarray, spelled_: np.ndarray, log_spelled: np.ndarray, lengths: np.ndarray, prior: float, trust: np.ndarray, follows: np.ndarray
) -> np.ndarray:
    """log10 probability of each run of tokens, with the mixing weights of each run following its tokens chunk by chunk.

    ``trust`` is the weight of each token's context and ``follows`` its share there; the rest mixes the known
    word's share and the spelling.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    left = lengths[order]
    out, explained, by_context, expected = (np.zeros(len(lengths)) for _ in range(4))
    for at in range(0, int(left[0]) if len(left) else 0, CHUNK):
        live = int(np.searchsorted(-left, -at, "left"))  # runs longer than ``at``
        weight = (STRENGTH * prior + explained[:live]) / (STRENGTH + at)
        weight = np.clip(weight, 0.001, 0.999)[:, None]
        factor = ((STRENGTH + by_context[:live]) / (STRENGTH + expected[:live]))[:, None]
        place = starts[:live, None] + at + np.arange(CHUNK)
        there = at + np.arange(CHUNK) < left[:live, None]
        place = np.where(there, place, 0)
        scale = 1 + (factor - 1) * trust[place]  # the context's weight times the factor, both weights divided by their sum
        rest = (1 - trust[place]) / scale
        hint = factor * trust[place] * follows[place] / scale
        a, b = weight * share[place], (1 - weight) * spelled_[place]
        p = hint + rest * (a + b)
        alone = np.log(np.maximum(rest * (1 - weight), 1e-300)) + log_spelled[place]
        logs = np.where(p > 0, np.log(np.maximum(p, 1e-300)), alone)
        out[:live] += np.where(there, logs, 0).sum(1)
        known = there & (a + b > 0)
        explained[:live] += np.where(known, a / np.maximum(a + b, 1e-300), 0).sum(1)
        by_context[:live] += np.where(there & (p > 0), hint / np.maximum(p, 1e-300), 0).sum(1)
        expected[:live] += np.where(there, 1 - rest, 0).sum(1)
    result = np.empty(len(lengths))
    result[order] = out / math.log(10)
    return result
