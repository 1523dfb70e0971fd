"""Take rows in priority order while every resource they use has capacity left."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..session import cut_lineage, shared_folder, stored

#: Rows of a bucket of the order, about, and at most of what one task decides in sequence.
BUCKET_ROWS = 1 << 16


def _bucketed(rows: DataFrame, order: list[str], folder: str) -> list[int]:
    """Write ``rows`` in buckets that follow each other in ``order``; the size of each.

    The bounds come from a range partitioning by the whole order, which ends in
    the unique key, so equal leading values are divided as well.
    """
    n = rows.count()
    number = max(1, -(-n // BUCKET_ROWS))
    if number == 1:
        rows.withColumn("__bucket", F.lit(0)).write.parquet(folder)
        return [n]
    ranged = rows.repartitionByRange(number, *order).withColumn("__bucket", F.spark_partition_id())
    ranged.write.partitionBy("__bucket").parquet(folder)
    sizes = {r["__bucket"]: r["count"] for r in rows.sparkSession.read.parquet(folder).groupBy("__bucket").count().collect()}
    return [sizes.get(i, 0) for i in range(max(sizes) + 1)]


def _positions(claims: DataFrame, spent: DataFrame, order: list[str]) -> DataFrame:
    """``__pos``, the 1-based place of each claim in its resource, and ``__left``, what the resource has left.

    Claims are ranked inside (resource, bucket) and shifted by the claims of the
    earlier buckets, so a resource that all rows share is not ordered, nor joined
    to what is spent of it, in one task.
    """
    bucket = ["resource", "__bucket"]
    earlier = Window.partitionBy("resource").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = claims.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n"), F.max("cap").alias("__cap"))
    before = counts.join(spent, "resource", "left").select(
        *bucket, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        (F.col("__cap") - F.coalesce("used", F.lit(0))).alias("__left"),
    )
    ranked = claims.withColumn("__r", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)))
    return ranked.join(before, bucket).withColumn("__pos", F.col("__r") + F.col("__before"))


def capped_selection(
    df: DataFrame,
    key: str,
    order: list[str],
    resources: list[tuple[Column, Column]],
    used: DataFrame | None = None,
    total: int | None = None,
) -> DataFrame:
    """The rows a sequential first-come selection in ``order`` would accept.

    ``resources`` are (name, capacity) columns of each row; ``used``
    (resource, used, cap) is capacity spent before; ``order`` ends in the unique
    ``key``. A row is accepted if its place among the open rows of each of its
    resources fits the capacity that is left: no earlier row can block it. A row
    that needs a full resource is refused. The first open row is always
    accepted, so every round makes progress, and the set equals the sequential
    one.

    The rows are written once, in buckets of the order. Buckets are taken up in
    pieces that double in size, and a piece is decided before the next one is
    read. Rounds run in parallel while more than ``BUCKET_ROWS`` rows are open,
    and write only the rows that they leave open; what is left then is decided
    one after the other in one task, with what its resources have left. Accepted
    rows are appended to one table. So no round reads a row that was decided
    before, long chains of few rows cost one step, and capacity that is spent
    early keeps later pieces short.

    ``total`` names the resource that all rows sharing any resource share too
    (the overall target of a split). When all totals are full, the buckets that
    are left are not read at all.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/greedy-{uuid.uuid4().hex}"
    rest = [c for c in order if c != key]
    entries = F.array(*[F.struct(r.cast("string").alias("resource"), c.cast("long").alias("cap")) for r, c in resources])
    # a row whose resource has no name or no capacity can never be taken
    rows = df.select(key, *rest, entries.alias("__entries")).filter(
        F.forall("__entries", lambda e: e["resource"].isNotNull() & F.coalesce(e["cap"] > 0, F.lit(False)))
    )
    # counted, sampled for the bounds and dealt: ``df`` is worked out once for all three
    sizes = _bucketed(stored(rows), [*rest, key], f"{folder}/rows")
    base = spark.read.parquet(f"{folder}/rows")
    kind = base.select(key, *rest, "__entries", "__bucket").schema
    caps = base.select(F.get("__entries", F.lit(total or 0)).alias("e")).groupBy("e.resource").agg(F.max("e.cap").alias("cap"))
    totals = None if total is None or len(sizes) == 1 else cut_lineage(caps)
    ledger = _Ledger(spark, kind, used)
    at, width = 0, 1
    while at < len(sizes):
        live = base.filter(F.col("__bucket").between(at, at + width - 1)).select(*kind.names)
        still = sum(sizes[at:at + width])
        at, width = at + width, 2 * width
        while still > BUCKET_ROWS:
            step = f"{folder}/round-{uuid.uuid4().hex}"
            taken, still = _round(live, key, order, ledger.spent(), step)
            if taken:
                ledger.parts.append(f"{step}/__open=false")
            live = spark.read.schema(kind).parquet(f"{step}/__open=true") if still else live.limit(0)
        if still:
            ledger.parts.append(f"{folder}/last-{uuid.uuid4().hex}")
            _in_sequence(live, key, order, ledger.spent(ledger.parts[:-1])).write.parquet(ledger.parts[-1])
        if totals is not None and at < len(sizes):
            short = totals.join(ledger.spent(), "resource", "left").filter(F.coalesce("used", F.lit(0)) < F.col("cap"))
            if short.isEmpty():
                break
    kept = spark.read.schema(kind).parquet(*ledger.parts).select(key) if ledger.parts else base.select(key).limit(0)
    return df.join(kept, key, "left_semi")


class _Ledger:
    """The accepted rows so far, as a growing list of written tables, and the capacity they use."""

    def __init__(self, spark, kind, used: DataFrame | None):
        self.spark, self.kind, self.parts = spark, kind, []
        self.before = None if used is None else used.select("resource", F.col("used").cast("long").alias("used"))

    def spent(self, parts: list[str] | None = None) -> DataFrame:
        """(resource, used): one row for each resource that something was taken from."""
        parts = self.parts if parts is None else parts
        tables = [] if self.before is None else [self.before]
        if parts:
            claims = self.spark.read.schema(self.kind).parquet(*parts).select(F.explode("__entries").alias("e"))
            tables.append(claims.select("e.resource", F.lit(1).cast("long").alias("used")))
        if not tables:
            return self.spark.range(0).select(F.lit("").alias("resource"), F.lit(0).cast("long").alias("used"))
        whole = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        return whole.groupBy("resource").agg(F.sum("used").alias("used"))


def _round(live: DataFrame, key: str, order: list[str], spent: DataFrame, path: str) -> tuple[int, int]:
    """Write the rows of ``live`` that are accepted and those that stay open; their numbers."""
    rest = [c for c in order if c != key]
    claims = live.select(key, *rest, "__bucket", F.inline("__entries"))
    states = _positions(claims, spent, order).groupBy(key).agg(
        F.every(F.col("__pos") <= F.col("__left")).alias("__fits"), F.min("__left").alias("__least")
    )
    decided = live.join(states, key).filter(F.col("__least") > 0).withColumn("__open", ~F.col("__fits"))
    seen = Observation()
    decided.observe(seen, F.count_if("__fits").alias("taken"), F.count_if("__open").alias("open")).drop(
        "__fits", "__least"
    ).write.partitionBy("__open").parquet(path)
    return seen.get["taken"], seen.get["open"]


def _in_sequence(live: DataFrame, key: str, order: list[str], spent: DataFrame) -> DataFrame:
    """The accepted rows of a ``live`` of at most ``BUCKET_ROWS`` rows, decided one after the other."""
    rest = [c for c in order if c != key]
    claims = live.select(key, *rest, F.inline("__entries")).join(spent, "resource", "left")
    # a row without capacity at the start is refused whatever the others do
    rows = claims.withColumn("__left", F.col("cap") - F.coalesce("used", F.lit(0))).groupBy(key, *rest).agg(
        F.collect_list("resource").alias("__names"), F.collect_list("__left").alias("__lefts"), F.min("__left").alias("__least")
    ).filter(F.col("__least") > 0)

    def take(batches):
        remaining: dict[str, int] = {}
        for batch in batches:
            chosen = []
            for names, lefts in zip(batch.column("__names").to_pylist(), batch.column("__lefts").to_pylist(), strict=True):
                fits = all(remaining.setdefault(r, left) > 0 for r, left in zip(names, lefts, strict=True))
                if fits:
                    for r in names:
                        remaining[r] -= 1
                chosen.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(chosen, pa.bool_()))], [key])

    one = rows.select(key, *rest, "__names", "__lefts").coalesce(1).sortWithinPartitions(*order)
    chosen = one.select(key, "__names", "__lefts").mapInArrow(take, one.select(key).schema)
    return live.join(chosen, key, "left_semi").select(*live.columns)


def diverse_files(inventory: DataFrame, count: int = 3, path: str = "full_path") -> DataFrame:
    """The first files in (district, year, season) order that differ in district and year.

    With fewer than ``count`` of them, the first ``count`` distinct
    (district, year); still fewer is an error.
    """
    order = ["district", "year", "season", path]
    ok = inventory.filter(F.col("parse_status") == "success").dropna(subset=["district", "year"])
    # only a district-year's first file can be chosen
    firsts = cut_lineage(ok.withColumn(
        "__r", F.row_number().over(Window.partitionBy("district", "year").orderBy("season", path))
    ).filter(F.col("__r") <= 1).drop("__r"))
    resources = [
        (F.concat(F.lit("d|"), "district"), F.lit(1)),
        (F.concat(F.lit("y|"), F.col("year").cast("string")), F.lit(1)),
        (F.lit("all"), F.lit(count)),
    ]
    chosen = cut_lineage(capped_selection(firsts, path, order, resources, total=2))
    if chosen.count() < count:
        chosen = firsts.orderBy(*order).limit(count)
        if chosen.count() < count:
            raise ValueError(f"fewer than {count} files can be selected")
    return chosen

