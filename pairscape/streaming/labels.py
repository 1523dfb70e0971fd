"""Labeling as an incremental stream: each run labels only patches it has not seen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.patches import MIN_VALID_RATIO, label_arrays
from ..sources.commits import CommitLog

KEEP = (
    "patch_id", "pair_id", "valid_pixel_count", "changed_pixel_count", "valid_pixel_ratio", "change_ratio",
    "change_class", "label_status", "label_error_message",
)


def labeled_stream(patches: DataFrame, minimum: float = MIN_VALID_RATIO) -> DataFrame:
    """Labels of a (streaming or static) table of patch arrays; row by row, without state."""
    labels = label_arrays(patches, minimum=minimum)
    return labels.select(*[c for c in KEEP if c in labels.columns])


def _generations(spark: SparkSession, out: str) -> tuple[list[int], list[int]]:
    """(generations that were begun, those that are published)."""
    names = CommitLog(spark, f"{out}/_log").entries()
    return [sorted(int(n.split("-")[1]) for n in names if n.startswith(kind)) for kind in ("begun-", "published-")]


def _batches(spark: SparkSession, out: str, generation: int) -> dict[int, str]:
    """The folder of each batch; of a batch that was run again, that of the last run."""
    found: dict[int, str] = {}
    for name, entry in CommitLog(spark, f"{out}/_log/generation-{generation:06d}").entries().items():
        found[int(name.split(".")[0])] = entry["folder"]
    return found


def incremental_labels(
    spark: SparkSession, source: str, checkpoint: str, out: str, schema: StructType, max_files: int = 64,
    minimum: float = MIN_VALID_RATIO, force: bool = False,
):
    """Label every parquet file that arrived in ``source`` since the last run, then stop.

    A micro-batch writes a folder of its own and then an entry that names it, so
    that :func:`read_labels` sees it whole. A run that was interrupted goes on at
    the batch it stopped in: that batch is written again to a new folder, whose
    entry replaces the first one. A patch that cannot be labeled becomes a
    failed row.

    ``force`` labels everything anew, as a new generation with its own
    checkpoint. The old labels stay visible until it has ended; then one entry
    publishes the new ones. An interrupted ``force`` changes nothing.
    """
    begun, published = _generations(spark, out)
    log = CommitLog(spark, f"{out}/_log")
    if force or not published:
        generation = max(begun, default=-1) + 1
        if not force and begun and not published:
            generation = begun[-1]  # the first run of all was interrupted: go on
        else:
            log.add(f"begun-{generation:06d}", {})
    else:
        generation = published[-1]
    batch_log = CommitLog(spark, f"{out}/_log/generation-{generation:06d}")

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{out}/generation-{generation:06d}/batch-{number:08d}-{uuid.uuid4().hex}"
        labeled_stream(batch, minimum).write.parquet(folder)
        again = sum(n.startswith(f"{number:08d}.") for n in batch_log.entries())
        batch_log.add(f"{number:08d}.{again:04d}", {"folder": folder})

    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{checkpoint}/generation-{generation:06d}")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if generation not in published:
        log.add(f"published-{generation:06d}", {})
    return query


def read_labels(spark: SparkSession, out: str, schema: StructType, minimum: float = MIN_VALID_RATIO) -> DataFrame:
    """The labels of the published generation's batches; ``schema`` is that of the patch arrays."""
    _, published = _generations(spark, out)
    kind = labeled_stream(spark.createDataFrame([], schema), minimum).schema
    folders = list(_batches(spark, out, published[-1]).values()) if published else []
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)
