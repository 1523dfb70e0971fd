"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A shard has ``nodes`` virtual nodes on a ring of ``CELLS`` cells; a document lies at the
cell of its text's checksum, so that equal texts lie together, and belongs to the next
node clockwise. A node with the way to it is an *arc*. A shard takes its own documents
up to its bound; what overflows continues clockwise, first come first served, into the
shards that have room. Bounds add up to all documents, so two turns place everything.

Only counts decide that: one number for each arc (at most shards * nodes of them, at
every size of the input) goes to the driver, which returns spans of ranks in an arc for
each shard. Documents of an arc are ranked by a hash of their id, in ``PARTS`` parts with
known sizes, so an arc is never in one task, not even if a third of all documents are
copies of one text. All work on rows is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import positions
from ..session import stored

#: Cells of the ring (three hexadecimal digits of a hash).
CELLS = 1 << 12
#: Virtual nodes of a shard.
NODES = 64


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(last cell, shard) of each arc, clockwise; of two nodes on one cell the one of the smaller shard counts."""
    found: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            found.setdefault(int(hashlib.md5(f"{shard}|{node}".encode()).hexdigest()[:3], 16), shard)
    return sorted(found.items())


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many documents each shard takes at most: the even share (those that the division leaves go to the first shards), or 1 + slack of it."""
    if slack:
        return [math.ceil(total * (1 + slack) / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def fill(owners: list[int], counts: list[int], bound: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, rank behind the last, shard) of every span, in the order of arcs and ranks.

    ``owners`` has the shard of each arc, ``counts`` its documents.
    """
    room, spans, over = list(bound), [], []
    for arc, (shard, n) in enumerate(zip(owners, counts, strict=True)):
        kept = min(n, room[shard])
        room[shard] -= kept
        if kept:
            spans.append((arc, 0, kept, shard))
        over.append((kept, n))
    waiting: deque[tuple[int, int, int]] = deque()
    for step in range(2 * len(owners)):
        arc = step % len(owners)
        if step < len(owners) and over[arc][0] < over[arc][1]:
            waiting.append((arc, *over[arc]))
        shard = owners[arc]
        while waiting and room[shard]:
            from_arc, first, last = waiting.popleft()
            taken = min(last - first, room[shard])
            room[shard] -= taken
            spans.append((from_arc, first, first + taken, shard))
            if first + taken < last:
                waiting.appendleft((from_arc, first + taken, last))
    return sorted(spans)


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table as a literal of the plan."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(c.replace(" ", ":") for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), F.lit(f"array<struct<{kind}>>"))))


def ring_shards(docs: DataFrame, shards: int = 8, nodes: int = NODES, slack: float = 0.0, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``; with ``carry`` also ``row``, a struct of its columns.

    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` counts a shard's rows from 0 without
    gaps. Without ``slack`` shards differ by one row at most. Null texts lie where empty
    ones lie (size 1, checksum 0). Rows without id and repeated rows are placed like
    others; rows that agree in id and text are interchangeable, and many of them lie in
    one part of an arc. An empty table gives no rows. Only doc_id and text are read (and
    packed columns keep their names inside ``row``), so no name can clash.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    arcs = ring(shards, nodes)
    cells = _rows(spark, "arc int, low int, high int", [
        (i, arcs[i - 1][0] + 1 if i else 0, last) for i, (last, _) in enumerate(arcs)
    ] + ([(0, arcs[-1][0] + 1, CELLS - 1)] if arcs[-1][0] < CELLS - 1 else []))
    placed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)).alias("turn"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    ).withColumn("cell", F.shiftright("text_crc32", 20).cast("int"))
    # CELLS rows at every size of the input
    lookup = F.broadcast(cells.select("arc", F.explode(F.sequence("low", "high")).alias("cell")))
    rows = stored(placed.join(lookup, "cell").drop("cell"))
    counts = {r.arc: r["count"] for r in rows.groupBy("arc").count().collect()}
    number = [counts.get(i, 0) for i in range(len(arcs))]
    spans = fill([s for _, s in arcs], number, bounds(sum(number), shards, slack))
    used, table = [0] * shards, []
    for arc, first, last, shard in spans:
        table.append((arc, first, last, shard, used[shard] - first))
        used[shard] += last - first
    ranked = positions(rows, ["arc"], ["turn", "doc_id", "text_crc32", "size"], [F.shiftright("turn", 24)], "rank")
    # a few more rows than arcs
    where = F.broadcast(_rows(spark, "arc int, first long, last long, shard int, base long", table))
    inside = (ranked["arc"] == where["arc"]) & (ranked["rank"] >= where["first"]) & (ranked["rank"] < where["last"])
    return ranked.join(where, inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("base")).alias("slot"), *(["row"] if carry else [])
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """The rows of ``docs`` as Parquet files at ``path``, a folder for each shard, in the order of slots: slot and ``row``."""
    found = ring_shards(docs, shards, carry=True, **options).select("shard", "slot", "row")
    found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
