"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairscape", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Shuffle width is left to adaptive execution: start wide, let AQE coalesce
    small partitions and split skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a session on a local master may leave the setting out; it then gets a
    temporary folder. On a cluster a missing setting is an error, because
    executors could not read what another machine wrote to its own disk.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pairscape-ckpt-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the checkpoint folder and forget how it was made.

    The folder is :func:`shared_folder`, so the result survives the loss of
    executors.
    """
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    # The names are changed around the checkpoint: a checkpointed plan can carry
    # constraints on columns it no longer has, and the renaming projection drops
    # them before a later union trips over them.
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.checkpoint(eager=True).toDF(*df.columns)
