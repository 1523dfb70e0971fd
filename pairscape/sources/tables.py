"""Tables, predictions, metrics and results by file suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

READERS = ("csv", "parquet", "json")
SPLITS = ("train", "val", "test")


def suffix(path: str) -> str:
    name = str(path).rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """csv, parquet or json by suffix; another suffix is an error.

    Give ``schema`` for large csv or json inputs: without it Spark reads the
    files once more to infer one.
    """
    kind = suffix(path)
    if kind not in READERS:
        raise ValueError(f"unsupported table format: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "json":
        return reader.json(path)
    options = {"header": True, "escape": '"', "multiLine": False}
    return reader.options(**options, inferSchema=schema is None).csv(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write by suffix as a folder of part files (json: one record per line)."""
    kind = suffix(path)
    if kind not in READERS:
        raise ValueError(f"unsupported table format: {path}")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.options(header=True, nullValue="", emptyValue="", escape='"').csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)
    return path


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The named file, else its csv/parquet sibling; without suffix parquet, then csv."""
    kind = suffix(path)
    stem = path[: -len(kind) - 1] if kind in ("csv", "parquet") else path
    order = {"csv": ("csv", "parquet"), "parquet": ("parquet", "csv")}.get(kind, ("parquet", "csv"))
    tried = [f"{stem}.{k}" for k in order]
    for candidate in tried:
        if path_exists(spark, candidate):
            return load_table(spark, candidate)
    raise FileNotFoundError(f"no prediction file; tried {tried}")


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value as text) from a JSON object, a (metric, value) csv or a one-row csv; empty if missing."""
    empty = spark.createDataFrame([], "metric string, value string")
    kind = suffix(path)
    if kind not in ("json", "csv") or not path_exists(spark, path):
        return empty
    if kind == "json":
        wide = spark.read.option("multiLine", True).json(path)
    else:
        wide = spark.read.options(header=True).csv(path)
        if {"metric", "value"} <= set(wide.columns):
            return wide.select("metric", F.col("value").cast("string").alias("value"))
    if not wide.columns:
        return empty
    entries = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value")) for c in wide.columns
    ])
    return wide.select(F.inline(entries))


def write_by_split(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One folder per split, so that reading one split reads only its files.

    The whole table is the parent folder. Rows are spread by split and a hash
    of the row, so a split of any size is written by many tasks.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    salted.repartition("split", "__salt").drop("__salt").write.mode(mode).partitionBy("split").parquet(path)
    return path


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)


def save_results(
    predictions: DataFrame, metrics: DataFrame, groups: DataFrame, path: str, parquet: bool = True
) -> dict[str, str]:
    """Predictions as csv (and parquet), metrics as csv and json, one folder per group dimension.

    ``metrics`` is long (metric, value); ``groups`` is the table of
    ``group_summary``. Nulls become empty text and NaN becomes ``nan``.
    """
    csv = {"header": True, "nullValue": "", "emptyValue": "", "nanValue": "nan"}
    out = {"predictions_csv": f"{path}/predictions.csv", "metrics_csv": f"{path}/metrics.csv",
           "metrics_json": f"{path}/metrics.json", "groups": f"{path}/groups"}
    predictions.write.mode("overwrite").options(**csv).csv(out["predictions_csv"])
    if parquet:
        out["predictions_parquet"] = f"{path}/predictions.parquet"
        predictions.write.mode("overwrite").parquet(out["predictions_parquet"])
    metrics.write.mode("overwrite").options(**csv).csv(out["metrics_csv"])
    # a metric table has a few dozen rows: one object per file
    as_map = metrics.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "value")))).alias("value"))
    as_map.write.mode("overwrite").text(out["metrics_json"])
    groups.write.mode("overwrite").partitionBy("dimension").options(**csv).csv(out["groups"])
    return out
