"""Data-quality audits of feature tables and repair of stored paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import functions as fn
from ..functions.features import LEAKAGE_WORDS, STATIC_BASES, STATIC_SUFFIXES
from .tabular import long_values, train_stats

# Limits and texts of the audit.
LARGE = 1e9
LARGE_MEAN = 5.0
STATS_TOLERANCE = 1e-8
MSG_STATIC = "Diff/ratio/between features on static or near-static context may be meaningless."
MSG_LEAK = "target-like, identifier-like, or split-like column in tabular feature columns"
SPLITS = ("train", "val", "test")
#: Columns of one grouping, so that it stays one generated method of moderate size.
TOGETHER = 12


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Range, mean and deviation of finite values; missing, zero, infinite and very large counts.

    Columns become rows first, so a wide table needs one small aggregation
    instead of thousands of aggregate expressions.
    """
    v = F.col("value")
    known = long_values(df, cols).withColumn("f", fn.finite("value"))
    return known.groupBy("feature").agg(
        F.min("f").alias("min"), F.max("f").alias("max"), F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"),
        F.count(F.when(v.isNull(), 1)).alias("missing_count"), F.count(F.when(v == 0, 1)).alias("zero_count"),
        F.count(F.when(F.abs(v) == float("inf"), 1)).alias("inf_count"),
        F.count(F.when(F.abs(v) > LARGE, 1)).alias("extremely_large_abs_count"),
    )


def _split_means(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """Facts of every column in every split: one grouping by split for each ``TOGETHER`` columns."""
    def some(names: list[str]) -> DataFrame:
        facts = {}
        for i, c in enumerate(names):
            v = fn.not_nan(c).cast("double")
            facts |= {f"m{i}": F.avg(v), f"s{i}": F.stddev_pop(v), f"t{i}": F.max(F.abs(v))}
        wide = scaled.groupBy("split").agg(F.count(F.lit(1)).alias("__rows"), *[f.alias(n) for n, f in facts.items()])
        return wide.select("split", F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col("__rows").alias("rows"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"t{i}").alias("top"))
            for i, c in enumerate(names)
        ])))

    return reduce(DataFrame.unionByName, [some(cols[a : a + TOGETHER]) for a in range(0, len(cols), TOGETHER)])


def scaled_by_split(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """Per split: rows, mean and largest |column mean|, mean deviation, largest |value|."""
    return _split_means(scaled, cols).groupBy("split").agg(
        F.max("rows").alias("rows"), F.avg(F.abs("mean")).alias("mean_abs_mean"), F.max(F.abs("mean")).alias("max_abs_mean"),
        F.avg("std").alias("mean_std"), F.max("top").alias("max_abs_value"),
    )


def scaled_anomalies(scaled: DataFrame, cols: list[str], limit: float = LARGE_MEAN) -> DataFrame:
    """Columns whose mean in a split is far from 0 after scaling."""
    return _split_means(scaled, cols).filter(F.abs("mean") > limit).select("split", "feature", F.col("mean").alias("scaled_mean"))


def verify_train_stats(raw: DataFrame, stored: DataFrame, cols: list[str], tolerance: float = STATS_TOLERANCE) -> DataFrame:
    """Recomputed against stored statistics per feature; an absent stored value is a mismatch."""
    fresh = train_stats(raw, cols)
    old = stored.select("feature", *[F.col(c).alias(f"saved_{c}") for c in ("median", "mean", "scale")])
    joined = fresh.join(old, "feature", "left")
    errors = {f"{c}_error": F.abs(F.col(f"saved_{c}") - F.col(c)) for c in ("median", "mean", "scale")}
    bad = fn.any_true(*[F.coalesce(F.col(e) > tolerance, F.lit(True)) for e in errors])
    return joined.withColumns(errors).select("feature", *errors, bad.alias("mismatch"))


def feature_names(df: DataFrame, cols: list[str]) -> DataFrame:
    """The column names as rows."""
    names = F.explode(F.array(*[F.lit(c) for c in cols]))
    return df.sparkSession.range(1).select(names.alias("feature"))


def category_table(names: DataFrame) -> DataFrame:
    c = fn.feature_category("feature")
    return names.select(
        "feature", c.alias("category"), (c == "temporal_metadata").alias("is_temporal_metadata"),
        (c == "environmental_dynamic").alias("is_environmental_dynamic"),
    )


def static_warnings(names: DataFrame) -> DataFrame:
    """Difference, ratio and window features of (nearly) constant context."""
    low = F.lower("feature")

    def first(words, test) -> Column:
        return F.coalesce(*[F.when(test(w), w) for w in words])

    base = first(STATIC_BASES, low.contains)
    suffix = first(STATIC_SUFFIXES, low.endswith)
    return names.select(
        "feature", base.alias("base_keyword"), F.regexp_replace(suffix, "^_", "").alias("operation"), F.lit(MSG_STATIC).alias("warning")
    ).filter(F.col("base_keyword").isNotNull() & F.col("operation").isNotNull())


def leakage_columns(names: DataFrame) -> DataFrame:
    """Names that look like targets, identifiers or splits."""
    hits = F.array_compact(F.array(*[F.when(F.lower("feature").contains(w), w) for w in LEAKAGE_WORDS]))
    found = names.withColumn("__h", hits).filter(F.size("__h") > 0)
    return found.select("feature", F.array_join("__h", ";").alias("matched_patterns"), F.lit(MSG_LEAK).alias("risk"))


def missingness(feats: DataFrame, missing_report: DataFrame) -> DataFrame:
    """(metric, value): pair coverage and the missing-data report's totals."""
    from ..plans.reports import as_metrics, long_report, n_rows, n_where

    absent = F.when(F.col("tabular_district_missing"), F.col("district"))
    coverage = as_metrics(long_report(feats, {
        "pairs_total": n_rows(), "pairs_full_tabular_match": n_where(~F.col("tabular_any_missing")),
        "pairs_missing_t1_tabular": n_where(F.col("tabular_t1_missing")),
        "pairs_missing_t2_tabular": n_where(F.col("tabular_t2_missing")),
        "pairs_missing_any_tabular": n_where(F.col("tabular_any_missing")),
        "missing_tabular_district_count": F.count_distinct(absent),
    }, {}))
    season = F.when(F.col("report_type") == "missing_district_year_season", F.col("season"))
    seasons = as_metrics(long_report(missing_report, {"missing_tabular_season_count": F.count_distinct(season)}, {}))
    totals = missing_report.groupBy("report_type").agg(F.sum("count").cast("double").alias("value"))
    return coverage.unionByName(seasons).unionByName(
        totals.select(F.concat(F.lit("report_"), "report_type").alias("metric"), "value")
    )


def audit_status(feats: DataFrame, names: DataFrame, stats_check: DataFrame, anomalies: DataFrame) -> DataFrame:
    """FAIL on leakage or changed statistics, WARNING on gaps, static features or anomalies, else PASS."""
    def some(df: DataFrame, condition: Column | None = None) -> Column:
        chosen = df if condition is None else df.filter(condition)
        return chosen.agg(F.count(F.lit(1)) > 0).scalar()

    fail = some(leakage_columns(names)) | some(stats_check, F.col("mismatch"))
    warn = some(feats, F.col("tabular_any_missing")) | some(static_warnings(names)) | some(anomalies)
    return feats.sparkSession.range(1).select(F.when(fail, "FAIL").when(warn, "WARNING").otherwise("PASS").alias("status"))


# --- paths ---------------------------------------------------------------------------------

def _map_text(col: Column, dtype: T.DataType, change) -> Column:
    """Apply ``change`` to every text inside a value, at any depth; map keys stay."""
    if isinstance(dtype, T.StringType):
        return change(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _map_text(x, dtype.elementType, change))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: _map_text(v, dtype.valueType, change))
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[_map_text(col[f.name], f.dataType, change).alias(f.name) for f in dtype.fields])
        return F.when(col.isNotNull(), inner)
    return col


def _holds(col: Column, dtype: T.DataType, text: str) -> Column:
    """Does any text inside the value contain ``text``?"""
    if isinstance(dtype, T.StringType):
        return F.coalesce(col.contains(text), F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(col, lambda x: _holds(x, dtype.elementType, text)), F.lit(False))
    if isinstance(dtype, T.MapType):
        return F.coalesce(F.exists(F.map_values(col), lambda x: _holds(x, dtype.valueType, text)), F.lit(False))
    if isinstance(dtype, T.StructType):
        return fn.any_true(*[_holds(col[f.name], f.dataType, text) for f in dtype.fields])
    return F.lit(False)


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.StringType)


def rewrite_prefix(df: DataFrame, old: list[str], new: str) -> DataFrame:
    """Replace old path prefixes in every text column, nested ones included."""
    return df.select(*[
        _map_text(F.col(f.name), f.dataType, lambda c: fn.rewrite_text(c, old, new)).alias(f.name) if _has_text(f.dataType) else F.col(f.name)
        for f in df.schema.fields
    ])


def rewrite_report(df: DataFrame, old: list[str], new: str) -> DataFrame:
    """(column, prefix, changed_rows, remaining_rows), both sides counted in one pass."""
    fields = [f for f in df.schema.fields if _has_text(f.dataType)]
    entries = []
    for f in fields:
        after = _map_text(F.col(f.name), f.dataType, lambda c: fn.rewrite_text(c, old, new))
        for prefix in old:
            entries.append(F.struct(
                F.lit(f.name).alias("column"), F.lit(prefix).alias("prefix"),
                F.count(F.when(_holds(F.col(f.name), f.dataType, prefix), 1)).alias("changed_rows"),
                F.count(F.when(_holds(after, f.dataType, prefix), 1)).alias("remaining_rows"),
            ))
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def missing_and_extra(index: DataFrame, listing: DataFrame, path: str = "npz_path") -> tuple[DataFrame, DataFrame]:
    """(index paths not on disk, files on disk not in the index), each distinct."""
    wanted = index.filter(~fn.bad_path(path)).select(F.col(path).alias("path")).distinct()
    found = listing.select("path").distinct()
    return wanted.join(found, "path", "left_anti"), found.join(wanted, "path", "left_anti")


def path_counts(index: DataFrame, listing: DataFrame, path: str = "npz_path") -> DataFrame:
    """(metric, value): distinct index paths, existing, missing, and extra files."""
    wanted = index.filter(~fn.bad_path(path)).select(F.col(path).alias("path")).distinct().withColumn("w", F.lit(1))
    found = listing.select("path").distinct().withColumn("f", F.lit(1))
    both = wanted.join(found, "path", "full_outer")
    counts = {
        "checked_paths": F.count("w"), "existing_paths": F.count(F.when(F.col("w") + F.col("f") == 2, 1)),
        "missing_paths": F.count(F.when(F.col("f").isNull(), 1)), "extra_files": F.count(F.when(F.col("w").isNull(), 1)),
    }
    row = both.agg(*[v.alias(k) for k, v in counts.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in counts])))


def repair_paths(index: DataFrame, listing: DataFrame, root: str, path: str = "npz_path") -> DataFrame:
    """Rebuild bad paths as ``root/split/patch_id.npz`` where that file exists.

    Adds ``path_state``: ``kept``, ``rebuilt`` or ``dropped``; callers filter the
    dropped rows.
    """
    usable = F.col("split").isin(*SPLITS) & ~fn.bad_path("patch_id")
    candidate = F.when(fn.bad_path(path) & usable, F.concat_ws("/", F.lit(root.rstrip("/")), "split", F.concat(fn.strip("patch_id"), F.lit(".npz"))))
    files = listing.select(F.col("path").alias("__candidate"), F.lit(True).alias("__there")).distinct()
    joined = index.withColumn("__candidate", candidate).join(files, "__candidate", "left")
    there = F.coalesce("__there", F.lit(False))
    state = F.when(~fn.bad_path(path), "kept").when(there, "rebuilt").otherwise("dropped")
    return joined.withColumn("path_state", state).withColumn(
        path, F.when(F.col("path_state") == "rebuilt", F.col("__candidate")).otherwise(F.col(path))
    ).drop("__candidate", "__there")


def index_repair_report(index: DataFrame, listing: DataFrame, root: str, path: str = "npz_path") -> DataFrame:
    """(metric, value) of a repair: dropped, rebuilt, missing and extra paths, counts, repeated ids."""
    from ..plans.reports import as_metrics, long_report, n_rows, n_where

    repaired = repair_paths(index, listing, root, path)
    clean = repaired.filter(F.col("path_state") != "dropped")
    states = as_metrics(long_report(repaired, {
        "official_index_row_count": n_rows(), "cleaned_row_count": n_where(F.col("path_state") != "dropped"),
        "missing_path_rows_dropped": n_where(F.col("path_state") == "dropped"),
        "reconstructed_path_count": n_where(F.col("path_state") == "rebuilt"),
        **{f"{s}_count": n_where((F.col("path_state") != "dropped") & (F.col("split") == s)) for s in SPLITS},
        **{f"{c}_count": n_where((F.col("path_state") != "dropped") & (F.col("change_class") == c)) for c in fn.CLASS_NAMES if "change_class" in index.columns},
    }, {}))
    per_id = clean.groupBy("patch_id").agg(n_rows().alias("n"))
    dup = as_metrics(long_report(per_id, {"duplicate_patch_id_count": F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))}, {}))
    # a path may appear in several rows; files are counted once, missing paths per row
    rows = clean.select(F.col(path).alias("path")).join(listing.select("path").distinct(), "path", "left_anti")
    missing = as_metrics(long_report(rows, {"missing_files_count": n_rows()}, {}))
    files = path_counts(clean, listing, path).filter(F.col("metric") == "extra_files").select(
        F.lit("extra_files_on_disk_count").alias("metric"), F.col("value").cast("double").alias("value")
    )
    total = as_metrics(long_report(listing.select("path").distinct(), {"total_files_found": n_rows()}, {}))
    return states.unionByName(dup).unionByName(missing).unionByName(files).unionByName(total)


