"""Exact top-k inner-product search by distributed histogram selection.

All rows are scored against a chunk of queries by matrix products. Tasks send only
histograms of scores; their sum says in which bin each query's k-th highest score
lies, and the next round refines that bin, until it holds few scores or one value.
A last pass keeps scores at or above the bin's lower end (of equal ones only the k
smallest ids in each task) and the window over these few rows breaks ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed_chunks, shared, summed_table

#: Queries in a chunk (each chunk is a broadcast of CHUNK_QUERIES vectors and a few passes), bins of a histogram.
CHUNK_QUERIES, BINS = 4096, 256
#: A bin is fine enough when so many times k scores lie in it or above.
SLACK = 8
#: Scores held at once in a task.
BLOCK_SCORES = 1 << 21


@dataclass(frozen=True)
class Round:
    """Queries of a chunk and, for each, the interval [low, high) that is counted in bins of ``width``.

    ``high`` is at most low + BINS * width, and less where the bins reach past the bin
    that they refine: scores from there on are counted as lying above already.
    """

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    width: np.ndarray


def vectors_of(column: pa.Array, dims: int, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) of a list column as a matrix; shorter vectors are filled up with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in lists)])
    out = np.zeros((len(lists), dims))
    if len(flat) == len(lists) * dims:
        out[:] = flat.reshape(-1, dims)
    else:
        for i in range(len(lists)):
            out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return np.floor(scale * out)


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point as long as no partial sum can pass 2**53."""
    most = (np.abs(rows).max(initial=0) + 1) * (np.abs(queries).max(initial=0) + 1) * rows.shape[1]
    if most < 2**53:
        return (rows @ queries.T).astype(np.int64)
    return rows.astype(np.int64) @ queries.astype(np.int64).T


def _blocks(batches: Iterator[pa.RecordBatch], r: Round) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(16, BLOCK_SCORES // max(1, len(r.ids)))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            yield ids, products(vectors_of(part.column("embedding"), r.vectors.shape[1]), r.vectors)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query (all, if fewer), ties to the smaller vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding. Scores are integer inner
    products of floor(256 * x). Null vectors, ids and vectors with null or
    non-finite components take no part. Rows of the query's id are no candidates;
    other repeated rows are candidates each. Of repeated query ids the smallest
    vector counts. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    good = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.where(good).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = queries.where(good).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    length = "aggregate(embedding, double(0), (s, x) -> s + pow(abs(floor(256 * x)), 2))"
    facts = rows.agg(F.max(F.size("embedding")).alias("dims"), F.max(F.expr(length)).alias("norm"), F.count(F.lit(1)).alias("n")).first()
    number = asked.select("vec_id").distinct().count()
    kind = "query_id long, vec_id long, score long"
    if not number or not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks, out = math.ceil(number / CHUNK_QUERIES), None
    for chunk in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        got = sorted((r.vec_id, r.embedding) for r in mine.collect())
        if not got:
            continue
        dims = max(facts.dims, *(len(v) for _, v in got), 1)
        matrix = vectors_of(pa.array([v for _, v in got], pa.list_(pa.float64())), dims)
        low = -np.ceil(np.sqrt((matrix**2).sum(1)) * math.sqrt(facts.norm) + 1).astype(np.int64)
        span, above, taken = 1 - 2 * low, np.zeros(len(got), np.int64), np.zeros(len(got), bool)
        width = np.maximum(1, -(-span // BINS))
        r = Round(np.array([i for i, _ in got]), matrix, low, low + BINS * width, width)
        while not taken.all():
            held = shared(spark, r)

            def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                r = held.value
                n, table = len(r.ids), np.zeros(len(r.ids) * BINS, np.uint64)
                for ids, scores in _blocks(batches, r):
                    bin_ = (scores - r.low) // r.width
                    fits = (scores >= r.low) & (scores < r.high) & (ids[:, None] != r.ids)
                    table += np.bincount((np.arange(n) * BINS + bin_)[fits], minlength=n * BINS).astype(np.uint64)
                yield from packed_chunks(table)

            pieces = rows.mapInArrow(count, "chunk int, data binary")
            counts = summed_table(pieces, len(got) * BINS, "uint64").astype(np.int64).reshape(-1, BINS)
            down = counts[:, ::-1].cumsum(1)[:, ::-1]  # scores in this bin or a higher one of the interval
            enough = (above[:, None] + down) >= k
            best = np.where(enough.any(1), BINS - 1 - enough[:, ::-1].argmax(1), 0)
            at = np.arange(len(got))
            inside = above + down[at, best]
            new_low, new_above = r.low + best * r.width, inside - counts[at, best]
            # a query without k candidates keeps them all
            done = ~enough.any(1) | (inside <= SLACK * k) | (r.width == 1)
            low = np.where(taken, r.low, new_low)
            high = np.where(taken, r.high, np.minimum(r.high, new_low + r.width))
            above = np.where(taken, above, new_above)
            width = np.where(taken | done, r.width, np.maximum(1, -(-r.width // BINS)))
            taken |= done
            r = Round(r.ids, r.vectors, low, high, width)
        held = shared(spark, r)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            r = held.value
            for ids, scores in _blocks(batches, r):
                row, query = np.nonzero((scores >= r.low) & (ids[:, None] != r.ids))
                score = scores[row, query]
                order = np.lexsort((ids[row], -score, query))
                row, query, score = row[order], query[order], score[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1]) if len(query) else np.zeros(0, np.int64)
                place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
                few = place < k
                yield pa.RecordBatch.from_arrays([pa.array(r.ids[query[few]]), pa.array(ids[row[few]]), pa.array(score[few])], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(keep, kind)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
