"""The sample store: tensors, features and labels as parquet, one folder per split.

A run writes its new samples, their index and its failed rows into folders of its
own and then adds one entry to the store's commit log. Readers follow the log, so
the three become visible together, and what an interrupted run left is not read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import safe_file_name
from ..session import cut_lineage
from .commits import CommitLog

STORED = (
    "patch_id", "pair_id", "district", "split", "change_class", "pair_type", "time_gap_group", "change_ratio",
    "image_t1", "image_t2", "tabular",
)
INDEX = "patch_id string, npz_path string, split string, change_class string, change_ratio double, pair_id string, district string"
ERRORS = "patch_id string, pair_id string, split string, error_message string"


def _live(spark, path: str) -> list[dict]:
    """The entries that count: those from the last run that started anew."""
    entries = list(CommitLog(spark, f"{path}/_log").entries().values())
    start = max((i for i, e in enumerate(entries) if e["anew"]), default=0)
    return entries[start:]


def _read(spark, path: str, table: str, schema, entries: list[dict]) -> DataFrame:
    """A table of the named runs, with the run as ``commit``."""
    if not entries:
        return spark.createDataFrame([], schema).withColumn("commit", F.lit(None).cast("string"))
    folders = [f"{path}/{table}/commit={e['commit']}" for e in entries]
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("commit", T.StringType())])).option(
        "basePath", f"{path}/{table}"
    ).parquet(*folders)


def read_index(spark, path: str) -> DataFrame:
    """(patch_id, npz_path, split, change_class, change_ratio, pair_id, district) of the stored samples."""
    return _read(spark, path, "index", INDEX, _live(spark, path)).drop("commit")


def read_errors(spark, path: str) -> DataFrame:
    """(patch_id, pair_id, split, error_message): the last failure of every patch that no run has stored."""
    failed = _read(spark, path, "errors", ERRORS, _live(spark, path))
    last = failed.groupBy("patch_id", "pair_id", "split").agg(F.max_by("error_message", "commit").alias("error_message"))
    return last.join(read_index(spark, path).select("patch_id"), "patch_id", "left_anti").select("patch_id", "pair_id", "split", "error_message")


def write_samples(samples: DataFrame, errors: DataFrame, path: str, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append new samples; returns (index of the given samples, stored errors, skipped ids).

    Samples that are stored already are skipped by an anti join on their id,
    read from the index, unless ``force``, which starts the store anew: until
    its entry is added, readers see the old one. Each task writes its rows of
    every split, so a split of any size has many writers. ``samples`` is worked
    out once for the skipped ids and once for the write.
    """
    spark = samples.sparkSession
    log = CommitLog(spark, f"{path}/_log")
    number = len(log.entries())
    rows = samples.select(*STORED)
    known = read_index(spark, path).select("patch_id").distinct()
    if force:
        known = known.limit(0)
    # ids of skipped samples are fixed before the log changes
    skipped = cut_lineage(rows.select("patch_id").join(known, "patch_id", "left_semi"))
    commit = f"{number:08d}-{uuid.uuid4().hex}"
    rows.join(known, "patch_id", "left_anti").write.partitionBy("split").parquet(f"{path}/data/commit={commit}")
    entry = {"commit": commit, "anew": force, "schema": json.loads(_stored_schema(rows).json())}
    written = _samples(spark, path, [entry])
    sample_index(written, f"{path}/data/commit={commit}").write.parquet(f"{path}/index/commit={commit}")
    errors.select("patch_id", "pair_id", "split", "error_message").write.parquet(f"{path}/errors/commit={commit}")
    log.add(f"{number:08d}", entry)
    given = written.select("patch_id").unionByName(skipped)
    return read_index(spark, path).join(given, "patch_id", "left_semi"), read_errors(spark, path), skipped


def _stored_schema(rows: DataFrame) -> T.StructType:
    """The columns as read back: the split comes from the folder."""
    return T.StructType([f for f in rows.schema.fields if f.name != "split"] + [rows.schema["split"]])


def sample_index(samples: DataFrame, path: str) -> DataFrame:
    """The index rows of samples that lie at ``path``."""
    place = F.concat(F.lit(f"{path}/split="), F.col("split"), F.lit("/"), safe_file_name("patch_id"))
    return samples.select(
        "patch_id", place.alias("npz_path"), "split", "change_class", F.col("change_ratio").cast("double").alias("change_ratio"),
        "pair_id", "district",
    )


def _samples(spark, path: str, entries: list[dict]) -> DataFrame:
    kind = T.StructType.fromJson(entries[-1]["schema"])
    return _read(spark, path, "data", kind, entries).drop("commit")


def read_samples(spark, path: str, split: str | None = None) -> DataFrame:
    """Stored samples; a split reads only its own folders."""
    entries = _live(spark, path)
    if not entries:
        raise FileNotFoundError(f"no samples at {path}")
    df = _samples(spark, path, entries)
    return df if split is None else df.filter(F.col("split") == split)
