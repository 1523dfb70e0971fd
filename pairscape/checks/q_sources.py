"""Queries over readers, writers and the labeling stream.

Each writes what it derives from the given tables to a fresh folder and reads it
back through the source under test.
"""

import uuid

from pyspark.sql import functions as F

from ..operators import patches as pt
from ..session import shared_folder
from ..sources import files, store, tables
from ..streaming.labels import incremental_labels, read_labels
from .q_evaluation import REG, pred_df
from .q_rasters import ARRAY_LABEL_SQL, CHANNELS, LABEL_COLS, SIDE, class_arrays, sample_parts
from .registry import query


def scratch(t) -> str:
    """A folder all executors can reach, below the session's shared folder."""
    return f"{shared_folder(t.spark)}/pairscape-io-{uuid.uuid4().hex}"


@query("S1_load_save_table", "kind:s district:s year:i season:s price_mean:d",
       " UNION ALL ".join(f"SELECT '{k}' AS kind, district, year, season, price_mean FROM seasonal" for k in ("csv", "parquet", "json")))
def _(t):
    s, root, out = t.view("seasonal").select("district", "year", "season", "price_mean"), scratch(t), None
    for kind in ("csv", "parquet", "json"):
        path = tables.save_table(s, f"{root}/seasonal.{kind}")
        part = tables.load_table(t.spark, path).select(F.lit(kind).alias("kind"), *s.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("S3_load_predictions", "patch_id:s abs_error:d", "SELECT patch_id, abs_error FROM predictions")
def _(t):
    root = scratch(t)
    tables.save_table(pred_df(t), f"{root}/pred.parquet")
    return tables.load_predictions(t.spark, f"{root}/pred.csv")


@query("S4_load_metrics", "metric:s value:d",
       f"SELECT metric, value FROM (SELECT {REG} FROM predictions) r UNPIVOT INCLUDE NULLS (value FOR metric IN (mae, mse, rmse, r2, pearson_corr, mean_pred, mean_target))")
def _(t):
    from ..operators.evaluation import regression_metrics

    path = f"{scratch(t)}/metrics.csv"
    tables.save_table(regression_metrics(pred_df(t)), path)
    return tables.load_metrics(t.spark, path)


@query("S5_write_by_split", "split:s patch_id:s", "SELECT split, patch_id FROM labeled")
def _(t):
    path = tables.write_by_split(t.view("labeled").select("patch_id", "split", "x", "y"), f"{scratch(t)}/by_split")
    parts = [tables.read_split(t.spark, path, s) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ART = "SELECT concat('/out/', CASE page_id % 3 WHEN 0 THEN 'cnn_regression' WHEN 1 THEN 'x' ELSE 'runs' END, '/', CASE WHEN page_id % 5 = 0 THEN 'my_vit_regression_map' ELSE concat('page', CAST(page_id AS STRING)) END, " \
    "CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.CSV' WHEN 2 THEN '.json' ELSE '.md' END) AS path, CAST(page_id AS BIGINT) AS size FROM pages"


@query("S6_artifact_index", "experiment_name:s artifact_type:s path:s parent:s size_bytes:i",
       f"""WITH f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM ({ART}) a)
           SELECT CASE WHEN contains(path, 'cnn_regression') THEN 'cnn_regression' WHEN contains(path, 'my_vit_regression_map') THEN 'vit_regression' ELSE 'unknown' END AS experiment_name,
                  lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS artifact_type, path, parent, size AS size_bytes FROM f
           UNION ALL SELECT CASE WHEN contains(parent, 'cnn_regression') THEN 'cnn_regression' ELSE 'unknown' END, 'png_folder', parent, '/out', NULL
           FROM (SELECT DISTINCT parent FROM f WHERE path LIKE '%.png') g""")
def _(t):
    return files.artifact_rows(t.sql(ART))


@query("S2_scan_files", "folder:s", "SELECT DISTINCT 'year=' || year || '/season=' || season AS folder FROM seasonal")
def _(t):
    root = scratch(t)
    s = t.view("seasonal").select("district", "year", "season")
    s.write.partitionBy("year", "season").text(f"{root}/deep")
    s.write.json(f"{root}/other")  # another suffix, must not be listed
    found = files.scan_files(t.spark, root, ("TXT",)).filter("size > 0")
    return found.select(F.array_join(F.slice(F.split("path", "/"), -3, 2), "/").alias("folder")).distinct()


@query("S7_write_samples", "patch_id:s split:s change_class:s file_name:s state:s",
       f"""SELECT 'P' || vec_id AS patch_id, 'test' AS split, CASE WHEN label / 10e0 < 0.05::DOUBLE THEN 'low' WHEN label / 10e0 < 0.2::DOUBLE THEN 'medium' ELSE 'high' END AS change_class,
           'P' || vec_id || '.npz' AS file_name, CASE WHEN vec_id % 2 = 0 THEN 'skipped' ELSE 'saved' END AS state FROM embeddings WHERE vec_id % 50 < 45""")
def _(t):
    patches, bands, vectors = sample_parts(t)
    samples, errors = pt.build_samples(patches, bands, vectors, CHANNELS, SIDE * SIDE)
    path = f"{scratch(t)}/store"
    even = F.substring("patch_id", 2, 9).cast("int") % 2 == 0
    store.write_samples(samples.filter(even), errors, path)
    index, _, skipped = store.write_samples(samples, errors, path)
    stored = store.read_samples(t.spark, path, "test").select("patch_id", F.lit(True).alias("there"))
    known = skipped.withColumn("old", F.lit(True))
    joined = index.join(stored, "patch_id").join(known, "patch_id", "left")
    return joined.select(
        "patch_id", "split", "change_class", F.element_at(F.split("npz_path", "/"), -1).alias("file_name"),
        F.when(F.col("old"), "skipped").otherwise("saved").alias("state"),
    )


@query("S7_stored_errors", "patch_id:s error_message:s",
       """SELECT 'P' || vec_id AS patch_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS error_message FROM embeddings WHERE NOT (vec_id % 2 = 1 AND vec_id % 50 < 45)""")
def _(t):
    """Failures of two runs: the last one of a patch counts, and none of a patch that a run has stored."""
    patches, bands, vectors = sample_parts(t)
    samples, _ = pt.build_samples(patches, bands, vectors, CHANNELS, SIDE * SIDE)
    number, path = F.substring("patch_id", 2, 9).cast("int"), f"{scratch(t)}/store"
    every = t.table("embeddings").select(F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("patch_id"), F.lit("p").alias("pair_id"), F.lit("test").alias("split"))
    store.write_samples(samples.limit(0), every.withColumn("error_message", F.lit("first")), path)
    store.write_samples(samples.filter(number % 2 == 1), every.filter(number % 3 == 0).withColumn("error_message", F.lit("second")), path)
    return store.read_errors(t.spark, path)


@query("S8_save_results", "kind:s name:s value:d",
       f"""SELECT 'metric' AS kind, metric AS name, value FROM (SELECT {REG} FROM predictions) r UNPIVOT INCLUDE NULLS (value FOR metric IN (mae, mse, rmse, r2, pearson_corr, mean_pred, mean_target))
           UNION ALL SELECT 'group', pair_type, avg(abs_error) FROM predictions GROUP BY pair_type UNION ALL SELECT 'prediction', patch_id, abs_error FROM predictions""")
def _(t):
    from ..operators import evaluation as ev

    p = pred_df(t)
    metrics = ev.as_long(ev.regression_metrics(p))
    out = tables.save_results(p.select("patch_id", "abs_error"), metrics, ev.group_summary(p), scratch(t))
    read = t.spark.read.options(header=True)
    m = read.csv(out["metrics_csv"]).select(F.lit("metric").alias("kind"), F.col("metric").alias("name"), F.col("value").cast("double").alias("value"))
    g = read.csv(out["groups"]).filter("dimension = 'pair_type'").select(F.lit("group").alias("kind"), F.col("value").alias("name"), F.col("mae").cast("double").alias("value"))
    q = read.csv(out["predictions_csv"]).select(F.lit("prediction").alias("kind"), F.col("patch_id").alias("name"), F.col("abs_error").cast("double").alias("value"))
    return m.unionByName(g).unionByName(q)


@query("Q1_incremental_labels", "patch_id:i " + LABEL_COLS, ARRAY_LABEL_SQL)
def _(t):
    root = scratch(t)
    arrays = class_arrays(t).withColumn("pair_id", F.lit("p"))
    half = F.col("patch_id") % 2 == 0
    for condition in (half, ~half):  # two arrivals, two runs
        arrays.filter(condition).write.mode("append").parquet(f"{root}/in")
        incremental_labels(t.spark, f"{root}/in", f"{root}/ckpt", f"{root}/out", arrays.schema)
    return read_labels(t.spark, f"{root}/out", arrays.schema)


@query("Q1_incremental_labels_forced", "patch_id:i " + LABEL_COLS, ARRAY_LABEL_SQL)
def _(t):
    """Labeled under another limit first, then all over again with what has arrived since."""
    root = scratch(t)
    arrays = class_arrays(t).withColumn("pair_id", F.lit("p"))
    third = F.col("patch_id") % 3 == 0
    paths = f"{root}/in", f"{root}/ckpt", f"{root}/out"
    arrays.filter(third).write.parquet(paths[0])
    incremental_labels(t.spark, *paths, arrays.schema, minimum=0.0)
    arrays.filter(~third).write.mode("append").parquet(paths[0])
    incremental_labels(t.spark, *paths, arrays.schema, force=True)
    return read_labels(t.spark, paths[2], arrays.schema)
