"""Folders of rasters and result files as tables; file contents are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import parse_raster_name
from .tables import path_exists

# Suffixes and experiment names.
RASTERS = ("tif", "tiff")
ARTIFACTS = ("csv", "json", "md", "png")
EXPERIMENTS = ("cnn_regression", "convnext_regression", "swin_regression", "maxvit_regression")


def any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def list_files(spark: SparkSession, root: str, exts) -> DataFrame:
    """(path, size) of all files below ``root`` with one of the suffixes, any letter case.

    A missing root gives an empty table. Only path and length are selected, so
    the scan does not open the files.
    """
    if not path_exists(spark, root):
        return spark.createDataFrame([], "path string, size bigint")
    glob = "*.{" + ",".join(any_case(e.lstrip(".")) for e in exts) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.select(plain.alias("path"), F.col("length").alias("size"))


def scan_files(spark: SparkSession, root: str, exts=RASTERS) -> DataFrame:
    """Raster files in path order."""
    return list_files(spark, root, exts).orderBy("path")


def scan_inventory(spark: SparkSession, root: str, exts=RASTERS) -> DataFrame:
    """Raster inventory: one row per file with its parsed name."""
    files = list_files(spark, root, exts)
    return files.select(F.col("path").alias("full_path"), "size", F.inline(F.array(parse_raster_name("path"))))


def experiment_name(path) -> Column:
    """First known name in the path, else the first adjacent token pair of the stem ending in ``_regression``."""
    col = F.col(path) if isinstance(path, str) else path
    known = F.coalesce(*[F.when(col.contains(n), n) for n in EXPERIMENTS])
    name = F.element_at(F.split(col, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    tokens = F.split(stem, "_")
    pairs = F.transform(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda t, i: F.concat(t, F.lit("_"), F.get(tokens, i + 1)),
    )
    fits = F.filter(pairs, lambda p: p.endswith("_regression"))
    return F.coalesce(known, F.get(fits, F.lit(0)), F.lit("unknown"))


def artifact_rows(files: DataFrame) -> DataFrame:
    """Index rows of listed files, and one ``png_folder`` row per folder holding a png."""
    base = files.select(
        "path", "size",
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("artifact_type"),
        F.regexp_replace("path", "/[^/]*$", "").alias("parent"),
    )
    columns = ("experiment_name", "artifact_type", "path", "parent", "size_bytes")
    rows = base.select(experiment_name("path").alias("experiment_name"), "artifact_type", "path", "parent", F.col("size").alias("size_bytes"))
    folders = base.filter(F.col("artifact_type") == "png").select(F.col("parent").alias("path")).distinct().select(
        experiment_name("path").alias("experiment_name"), F.lit("png_folder").alias("artifact_type"), "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.lit(None).cast("bigint").alias("size_bytes"),
    )
    return rows.select(*columns).unionByName(folders.select(*columns))


def artifact_index(spark: SparkSession, root: str) -> DataFrame:
    return artifact_rows(list_files(spark, root, ARTIFACTS))
