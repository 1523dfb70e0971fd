"""Long reports: metrics and value counts of a table in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import functions as fn
from ..operators.ranking import exact_quantiles, top_k
from ..session import stored

SPLIT_COUNTS = ("split", "district", "pair_type", "time_gap_group")


def long_report(
    df: DataFrame, metrics: dict[str, Column], counts: dict[str, object], metric_type: str = "metric",
    weight: str | None = None,
) -> DataFrame:
    """(summary_type, value, count): single-value metrics and value counts.

    ``counts`` maps a summary type to a column (name or expression). Everything
    comes from one scan: a grouping set per count column and the empty set for
    the metrics. Null values are skipped. ``weight`` names a column that says how
    many rows a row stands for.
    """
    dims = [f"__d{i}" for i in range(len(counts))]
    metric_cols = {f"__m{i}": m for i, m in enumerate(metrics.values())}
    cols = [fn.as_col(c).cast("string").alias(d) for d, c in zip(dims, counts.values())]
    base = df.select("*", *cols)
    aggs = [(F.sum(weight) if weight else n_rows()).alias("__n"), *[m.cast("double").alias(a) for a, m in metric_cols.items()]]
    entry = "array<struct<summary_type:string,value:string,count:double>>"
    rows = F.array(*[
        F.struct(F.lit(metric_type).alias("summary_type"), F.lit(n).alias("value"), F.col(a).alias("count"))
        for n, a in zip(metrics, metric_cols)
    ]).cast(entry)
    if not dims:
        return base.agg(*aggs).select(F.inline(rows))
    sets = [[F.col(d)] for d in dims] + ([[]] if metrics else [])
    grouped = base.groupingSets(sets, *[F.col(d) for d in dims]).agg(*aggs, F.grouping_id().alias("__gid"))
    full = (1 << len(dims)) - 1
    chain = F.when(F.col("__gid") == full, rows) if metrics else None
    for i, name in enumerate(counts):
        one = F.array(F.struct(
            F.lit(name).alias("summary_type"), F.col(f"__d{i}").alias("value"), F.col("__n").cast("double").alias("count")
        )).cast(entry)
        hit = F.col("__gid") == (full ^ (1 << (len(dims) - 1 - i)))
        chain = F.when(hit, one) if chain is None else chain.when(hit, one)
    found = grouped.select(F.inline(chain)).filter(F.col("value").isNotNull())
    if not metrics:
        return found
    # an empty table has no row even for the empty grouping set: the metrics of no rows stand in where none came
    blank = df.limit(0).agg(*aggs).select(F.inline(rows))
    both = found.withColumn("__real", F.lit(1)).unionByName(blank.withColumn("__real", F.lit(0)))
    return both.groupBy("summary_type", "value").agg(F.max_by("count", "__real").alias("count"))


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def size_metrics(per_key: DataFrame, count_col: str, names: dict[str, str]) -> DataFrame:
    """min/max/mean of a count column as metric rows; nothing for an empty table."""
    how = {"min": F.min, "max": F.max, "mean": F.avg}
    row = per_key.agg(*[how[k](count_col).cast("double").alias(n) for k, n in names.items()])
    entries = F.array(*[
        F.struct(F.lit("metric").alias("summary_type"), F.lit(n).alias("value"), F.col(n).alias("count"))
        for n in names.values()
    ])
    return row.select(F.inline(entries)).filter(F.col("count").isNotNull())


# --- inventory -----------------------------------------------------------------------------

def inventory_report(inventory: DataFrame) -> DataFrame:
    return long_report(
        inventory,
        {
            "total_files_found": n_rows(),
            "successfully_parsed_files": n_where(F.col("parse_status") == "success"),
            "failed_parsed_files": n_where(F.col("parse_status") == "failed"),
        },
        {f"count_by_{c}": c for c in ("district", "year", "season", "parse_status")},
    )


def quality_report(sentinel: DataFrame, dynamic_world: DataFrame, alignment: DataFrame) -> DataFrame:
    """Unreadable counts and band, CRS and shape distributions of both sensors, alignment states."""
    parts = []
    for source, table in (("sentinel", sentinel), ("dynamic_world", dynamic_world)):
        shape = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
        metrics = {
            "total_rasters_checked": n_rows(),
            "unreadable_count": n_where(~F.coalesce("readable", F.lit(False))),
        }
        if source == "sentinel":
            metrics["band_count_not_13"] = n_where(F.col("readable") & (F.col("band_count") != 13))
        parts.append(long_report(
            table, metrics,
            {f"{source}_band_count": "band_count", f"{source}_crs": "crs", f"{source}_shape": shape},
            f"{source}_metric",
        ))
    parts.append(long_report(alignment, {}, {"alignment_status": "alignment_status"}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def matched_report(matched: DataFrame) -> DataFrame:
    """Metrics, counts per column and per district×year×season (``a|b|c``)."""
    place = F.when(
        F.col("district").isNotNull() & F.col("year").isNotNull() & F.col("season").isNotNull(),
        F.concat_ws("|", "district", F.col("year").cast("string"), "season"),
    )
    return long_report(
        matched,
        {
            "total_images": n_rows(),
            "matched_count": n_where(F.col("is_matched")),
            "valid_for_training_count": n_where(F.col("is_valid_for_training")),
            "missing_sentinel_count": n_where(~F.col("has_sentinel")),
            "missing_dynamic_world_count": n_where(~F.col("has_dynamic_world")),
        },
        {**{c: c for c in ("alignment_status", "district", "year", "season")}, "district_year_season": place},
        "metrics",
    )


def missing_side(matched: DataFrame) -> DataFrame:
    return matched.filter(~F.col("has_sentinel") | ~F.col("has_dynamic_world")).orderBy(
        "district", "year", "season", "image_id"
    )


def alignment_problems(matched: DataFrame) -> DataFrame:
    def not_true(c):
        return ~F.coalesce(F.col(c), F.lit(False))

    bad = not_true("is_aligned") | not_true("sentinel_readable") | not_true("dw_readable")
    return matched.filter(F.col("is_matched") & bad).orderBy("alignment_status", "district", "year", "season")


# --- pairs and features --------------------------------------------------------------------

def pair_report(pairs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    counts = {f"pairs_by_{c}": c for c in ("split", "district", "pair_type", "time_gap_group", "time_gap_years") if c in pairs.columns}
    total = "total_pairs" if images is None else "total_candidate_pairs"
    report = long_report(
        pairs,
        {total: n_rows(), "same_season_count": n_where(F.col("same_season")), "cross_season_count": n_where(F.col("cross_season"))},
        counts,
    )
    if images is None:
        return report
    return report.unionByName(long_report(images, {"total_input_images": n_rows()}, {}))


def missing_tabular_report(pairs: DataFrame, tab: DataFrame, feats: DataFrame) -> DataFrame:
    """Districts without tabular data, missing endpoint seasons, and missing-pair counts."""
    from ..operators.tabular import prepare_tabular

    columns = ["report_type", "split", "pair_type", "district", "year", "season", "timepoint", "count"]
    records = prepare_tabular(tab)
    districts = records.select("district_join_key").dropna().distinct()
    keys = records.select("district_join_key", "year", "season").dropna().distinct()

    def shaped(df: DataFrame, kind: str, **given) -> DataFrame:
        types = {"year": "int", "count": "bigint"}
        return df.select(*[
            F.lit(kind).alias(c) if c == "report_type"
            else (given[c] if c in given else F.lit(None)).cast(types.get(c, "string")).alias(c)
            for c in columns
        ])

    keyed = pairs.withColumn("district_join_key", fn.district_join_key("district"))
    absent = keyed.select("district", "district_join_key").distinct().join(districts, "district_join_key", "left_anti")
    parts = [shaped(absent, "missing_tabular_district", district=F.col("district"), count=F.lit(1))]
    for t in ("t1", "t2"):
        side = keyed.select(
            "split", "pair_type", "district", "district_join_key", F.col(f"year_{t}").cast("int").alias("year"),
            fn.normalize_season(f"season_{t}").alias("season"),
        )
        lacking = side.join(keys, ["district_join_key", "year", "season"], "left_anti")
        grouped = lacking.groupBy("split", "pair_type", "district", "year", "season").agg(n_rows().alias("count"))
        parts.append(shaped(
            grouped, "missing_district_year_season", timepoint=F.lit(t),
            **{c: F.col(c) for c in ("split", "pair_type", "district", "year", "season", "count")},
        ))
    flagged = long_report(
        feats.filter("tabular_any_missing"), {}, {c: c for c in ("district", "split", "pair_type")}
    )
    for c in ("district", "split", "pair_type"):
        parts.append(shaped(
            flagged.filter(F.col("summary_type") == c), f"missing_by_{c}", count=F.col("count"), **{c: F.col("value")}
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_districts(pairs: DataFrame, tab: DataFrame) -> DataFrame:
    """Pair districts without tabular data and how many pairs they have."""
    counted = pairs.groupBy("district").agg(n_rows().alias("pair_count"))
    keyed = counted.withColumn("district_join_key", fn.district_join_key("district"))
    known = tab.select(fn.district_join_key("district").alias("district_join_key")).dropna().distinct()
    return keyed.join(known, "district_join_key", "left_anti").select("district", "district_join_key", "pair_count").orderBy("district")


def feature_summary(feats: DataFrame, scaled: DataFrame, base: list[str]) -> DataFrame:
    """(metric, value): row, column and split counts of the raw and scaled feature tables."""
    from ..operators.tabular import MISSING_FLAGS, model_features

    raw = long_report(feats, {"pair_feature_rows": n_rows()}, {"split": "split"}).select(
        F.when(F.col("summary_type") == "split", F.concat(F.lit("rows_split_"), "value")).otherwise(F.col("value")).alias("metric"),
        F.col("count").alias("value"),
    )
    n_features = len(model_features(feats))
    sizes = {
        "base_tabular_feature_count": len(base),
        "generated_raw_pair_feature_count": n_features,
        "scaled_feature_column_count": n_features,
        "missing_flag_column_count": sum(c in feats.columns for c in MISSING_FLAGS),
    }
    fixed = F.array(
        F.struct(F.lit("scaled_feature_rows").alias("metric"), F.col("n").cast("double").alias("value")),
        *[F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("value")) for k, v in sizes.items()],
    )
    return raw.unionByName(scaled.agg(n_rows().alias("n")).select(F.inline(fixed)))


def schema_summary(df: DataFrame) -> DataFrame:
    """Feature counts by kind and by aggregation, from the column dictionary."""
    from ..operators.tabular import feature_schema

    numeric = F.col("role") == "numeric_feature"
    return long_report(
        feature_schema(df),
        {
            "numeric_feature_count": n_where(numeric),
            "count_sum_feature_count": n_where(F.col("aggregation") == "sum"),
            "mean_feature_count": n_where(F.col("aggregation") == "mean"),
        },
        {"aggregation": F.coalesce("aggregation", F.lit("none"))},
    )


def filter_report(kept: DataFrame, removed: DataFrame) -> DataFrame:
    both = kept.select("split", "pair_type", "district", F.lit(True).alias("k")).unionByName(
        removed.select("split", "pair_type", "district", F.lit(False).alias("k"))
    )
    k = F.col("k")

    def of(flag: Column, c: str) -> Column:
        return F.when(flag, F.col(c))

    return long_report(
        both,
        {"original_pair_count": n_rows(), "kept_pair_count": n_where(k), "removed_pair_count": n_where(~k)},
        {
            "kept_by_split": of(k, "split"), "removed_by_split": of(~k, "split"),
            "kept_by_pair_type": of(k, "pair_type"), "removed_by_pair_type": of(~k, "pair_type"),
            "removed_by_district": of(~k, "district"),
        },
    )


# --- patches and labels --------------------------------------------------------------------

def per_pair_counts(patches: DataFrame, name: str = "patches") -> DataFrame:
    return patches.groupBy("pair_id").agg(n_rows().alias(name))


def storage_gb(n: Column, patch_size: int, channels: int = 13) -> Column:
    """Decimal GB of two half-precision images per patch."""
    return n * float(2 * channels * patch_size * patch_size * 2) / 1e9


def patch_report(pairs: DataFrame, patches: DataFrame, errors: DataFrame, patch_size: int = 128) -> DataFrame:
    body = long_report(
        patches,
        {
            "total_patch_rows": n_rows(),
            "estimated_float16_image_pair_storage_gb": storage_gb(F.nullif(n_rows(), F.lit(0)), patch_size),
        },
        {f"patch_rows_by_{c}": c for c in SPLIT_COUNTS},
    ).filter(F.col("count").isNotNull())
    sizes = size_metrics(per_pair_counts(patches), "patches", {k: f"{k}_patches_per_pair" for k in ("min", "max", "mean")})
    return (
        body.unionByName(sizes)
        .unionByName(long_report(pairs, {"total_input_pairs": n_rows()}, {}))
        .unionByName(long_report(errors, {"pair_error_count": n_rows()}, {}))
    )


def per_pair_sampling(full: DataFrame, sampled: DataFrame) -> DataFrame:
    """Original and sampled patches per pair, 0 for a pair without samples."""
    return _beside_sampled(full, per_pair_counts(sampled, "n"))


def _beside_sampled(full: DataFrame, taken: DataFrame) -> DataFrame:
    meta = [c for c in ("split", "district", "pair_type", "time_gap_group") if c in full.columns]
    before = full.groupBy("pair_id").agg(
        n_rows().alias("original_patch_count"), F.min_by(F.struct(*meta), "patch_id").alias("m")
    )
    joined = before.join(taken, "pair_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "pair_id", "m.*", "original_patch_count", n.alias("sampled_patch_count"),
        (n / F.col("original_patch_count")).alias("sampling_ratio"),
    )


def sampling_report(full: DataFrame, sampled: DataFrame) -> DataFrame:
    """Full against sampled: totals, ratio, patches per pair, and counts by four columns.

    ``sampled`` is worked out once: its numbers by pair and the four columns are
    written and serve both parts.
    """
    counted = stored(sampled.groupBy("pair_id", *SPLIT_COUNTS).agg(n_rows().alias("n")))
    pairs = _beside_sampled(full, counted.groupBy("pair_id").agg(F.sum("n").alias("n")))
    kept = F.when(F.col("sampled_patch_count") > 0, F.col("sampled_patch_count"))
    before = F.col("original_patch_count")
    total, taken = F.coalesce(F.sum(before), F.lit(0)), F.coalesce(F.sum(kept), F.lit(0))
    values = {
        "total_full_patches": total, "total_sampled_patches": taken,
        "reduction_ratio": F.coalesce(F.try_divide(taken, total), F.lit(0.0)),
    }
    for label, col in (("sampled", kept), ("original", before)):
        for how, f in (("min", F.min), ("max", F.max), ("mean", F.avg)):
            values[f"{how}_{label}_patches_per_pair"] = F.coalesce(f(col), F.lit(0))
    return long_report(pairs, values, {}).unionByName(
        long_report(counted, {}, {f"sampled_by_{c}": c for c in SPLIT_COUNTS}, weight="n")
    )


def text_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cols])


def label_report(labeled: DataFrame, label_band: int = 10) -> DataFrame:
    """Status and class counts, mean and median ratio of successes, classes by three columns."""
    ok = F.col("label_status") == "success"
    ratio = F.when(ok, fn.not_nan("change_ratio"))

    def status(s):
        return n_where(F.col("label_status") == s)

    report = long_report(
        labeled,
        {
            "label_band_used": F.max(F.lit(label_band)), "total_patches": n_rows(), "success_count": status("success"),
            "failed_count": status("failed"), "invalid_low_valid_ratio_count": status("invalid_low_valid_ratio"),
            **{f"{c}_count": n_where(F.col("change_class") == c) for c in fn.CLASS_NAMES},
            "mean_change_ratio": F.avg(ratio),
        },
        {f"change_class_by_{c}": text_key(c, "change_class") for c in ("split", "pair_type", "time_gap_group")},
    )
    median = exact_quantiles(labeled.filter(ok).withColumn("__r", fn.not_nan("change_ratio")), [], "__r", {"count": 0.5})
    return report.unionByName(median.select(
        F.lit("metric").alias("summary_type"), F.lit("median_change_ratio").alias("value"), "count"
    ))


def as_metrics(report: DataFrame) -> DataFrame:
    """Metric rows of a long report as (metric, value)."""
    return report.filter(F.col("summary_type") == "metric").select(F.col("value").alias("metric"), F.col("count").alias("value"))


def success_filter_report(labeled: DataFrame) -> DataFrame:
    """(metric, value): input, status and valid counts, valid rows per class."""
    from ..operators.selection import valid_condition

    valid = valid_condition()

    def status(s):
        return n_where(F.col("label_status") == s)

    return as_metrics(long_report(labeled, {
        "total_input_rows": n_rows(), "success_rows": status("success"),
        "invalid_low_valid_ratio_rows": status("invalid_low_valid_ratio"), "failed_rows": status("failed"),
        "valid_successful_rows": n_where(valid),
        **{f"true_successful_{c}_count": n_where(valid & (F.col("change_class") == c)) for c in fn.CLASS_NAMES},
    }, {}))


def label_distribution(labeled: DataFrame) -> DataFrame:
    return long_report(labeled, {}, {f"counts_by_{c}": c for c in (*SPLIT_COUNTS, "change_class")})


def usage_tables(patches: DataFrame) -> DataFrame:
    """Patches per pair, district and raster pair (``path1|path2``)."""
    raster = F.when(
        F.col("dw_path_t1").isNotNull() & F.col("dw_path_t2").isNotNull(), F.concat_ws("|", "dw_path_t1", "dw_path_t2")
    )
    return long_report(patches, {}, {
        "patches_per_pair_id": "pair_id", "patches_per_district": "district", "patches_per_raster_pair": raster,
    })


def describe_stats(df: DataFrame, col: str) -> DataFrame:
    """(statistic, value): count, mean, sample deviation, min, quartiles, max; exact."""
    v = df.select(fn.not_nan(col).alias("v"))
    row = v.agg(F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                F.min("v").alias("min"), F.max("v").alias("max"))
    quart = exact_quantiles(v, [], "v", {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    parts = []
    for t in (row, quart):
        entries = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(f"`{c}`").alias("value")) for c in t.columns])
        parts.append(t.select(F.inline(entries)))
    return parts[0].unionByName(parts[1])


def patches_per_pair_stats(df: DataFrame) -> DataFrame:
    return describe_stats(per_pair_counts(df), "patches")


def dataset_shape(patches: DataFrame) -> DataFrame:
    """(metric, value): raster pairs, patches per raster pair, patches per pair."""
    raster = patches.groupBy("dw_path_t1", "dw_path_t2").agg(n_rows().alias("patches"))
    n, total = n_rows(), F.coalesce(F.sum("patches"), F.lit(0))
    first = as_metrics(long_report(raster, {
        "raster_pair_count": n, "average_patches_per_raster_pair": F.coalesce(F.try_divide(total, n), F.lit(0.0)),
    }, {}))
    sizes = size_metrics(per_pair_counts(patches), "patches", {k: f"{k}_patches_per_pair" for k in ("min", "max", "mean")})
    return first.unionByName(as_metrics(sizes))


def storage_estimate(patches: DataFrame, patch_size: int = 128, files: DataFrame | None = None) -> DataFrame:
    """(metric, value): expected bytes as GB and GiB, and bytes of the files already written."""
    each = float(2 * 13 * patch_size * patch_size * 2)
    out = as_metrics(long_report(patches, {
        "patches": n_rows(), "bytes": n_rows() * each, "decimal_gb": n_rows() * each / 1e9, "gib": n_rows() * each / 1024.0**3,
    }, {}))
    if files is None:
        return out
    return out.unionByName(as_metrics(long_report(files, {"stored_bytes": F.coalesce(F.sum("size"), F.lit(0))}, {})))


# --- selection -----------------------------------------------------------------------------

def selection_summary(original: DataFrame, final: DataFrame) -> DataFrame:
    """(metric, value): sizes, share kept, patches per pair and final rows per split."""
    both = original.select(F.lit(1).alias("o"), F.lit(0).alias("f"), "split", "pair_id").unionByName(
        final.select(F.lit(0).alias("o"), F.lit(1).alias("f"), "split", "pair_id")
    )
    per_pair = both.groupBy("pair_id", "split").agg(F.sum("o").alias("o"), F.sum("f").alias("f"))
    # a pair lies in one split; sum again where it does not
    pairs = per_pair.groupBy("pair_id").agg(F.sum("o").alias("o"), F.sum("f").alias("f"))
    o, f = F.coalesce(F.sum("o"), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0))
    some = F.when(F.col("f") > 0, F.col("f"))
    head = as_metrics(long_report(pairs, {
        "original_valid_patch_count": o, "final_selected_patch_count": f,
        "reduction_ratio": F.coalesce(F.try_divide(f, o), F.lit(0.0)),
        "max_patches_per_pair_final": F.coalesce(F.max(some), F.lit(0)),
        "mean_patches_per_pair_final": F.coalesce(F.avg(some), F.lit(0.0)),
    }, {}))
    splits = per_pair.groupBy("split").agg(F.sum("f").cast("double").alias("value")).filter(F.col("value") > 0)
    return head.unionByName(splits.select(F.concat(F.lit("final_split_"), "split").alias("metric"), "value"))


def distribution_report(original: DataFrame, final: DataFrame, columns=("change_class", "district", "pair_type", "time_gap_group")) -> DataFrame:
    """Original, final and removed counts per value of each column, and the value's final share."""
    from ..operators.evaluation import by_dimension

    both = original.select(*columns, F.lit(1).alias("o"), F.lit(0).alias("f")).unionByName(
        final.select(*columns, F.lit(0).alias("o"), F.lit(1).alias("f"))
    )
    counted = by_dimension(both, columns, ["o", "f"]).filter(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.sum("o").alias("original_count"), F.sum("f").alias("final_count")
    )
    total = F.greatest(F.lit(1), F.sum("final_count").over(Window.partitionBy("dimension")))
    return counted.withColumns({
        "removed_count": F.col("original_count") - F.col("final_count"), "final_ratio": F.col("final_count") / total,
    })


def removed_summary(original: DataFrame, final: DataFrame, top: int = 50) -> DataFrame:
    """Totals and the most frequent values of the removed patches.

    ``final`` is worked out once: its ids are written for both of their readers.
    """
    from ..operators.selection import removed_rows

    kinds = {
        "top_removed_district": "district", "removed_change_class": "change_class", "removed_pair_type": "pair_type",
        "removed_time_gap_group": "time_gap_group", "top_removed_pair_id": "pair_id",
    }
    final = stored(final.select("patch_id"))
    removed = long_report(removed_rows(original, final), {"removed_count": n_rows()}, kinds)
    best = top_k(removed.filter(F.col("summary_type") != "metric"), ["summary_type"], [F.desc("count"), "value"], top)
    return (
        best.unionByName(removed.filter(F.col("summary_type") == "metric"))
        .unionByName(long_report(original, {"valid_original_count": n_rows()}, {}))
        .unionByName(long_report(final, {"final_count": n_rows()}, {}))
    )


def sample_selection_report(selected: DataFrame, top_districts: int = 20) -> DataFrame:
    """(metric, group, value): totals, class/type/gap counts, top districts, error statistics."""
    counts = long_report(
        selected.withColumn("__e", fn.safe_float("abs_error")),
        {"total_selected": n_rows(), "mean_abs_error": F.avg("__e"), "max_abs_error": F.max("__e")},
        {f"{c}_count": F.coalesce(F.col(c), F.lit("")) for c in ("change_class", "pair_type", "time_gap_group", "district")},
    )
    kept = top_k(counts.filter(F.col("summary_type") == "district_count"), ["summary_type"], [F.desc("count"), "value"], top_districts)
    rest = counts.filter(F.col("summary_type") != "district_count")
    median = exact_quantiles(selected.withColumn("__e", fn.safe_float("abs_error")), [], "__e", {"count": 0.5}).select(
        F.lit("metric").alias("summary_type"), F.lit("median_abs_error").alias("value"), "count"
    )
    metric = F.col("summary_type") == "metric"
    return rest.unionByName(kept).unionByName(median).filter(F.col("count").isNotNull()).select(
        F.when(metric, F.col("value")).otherwise(F.col("summary_type")).alias("metric"),
        F.when(~metric, F.col("value")).when(F.col("value") == "total_selected", "all").otherwise("error_stats").alias("group"),
        F.col("count").alias("value"),
    )


def store_report(requested: DataFrame, index: DataFrame, errors: DataFrame, skipped: DataFrame, stored_bytes: DataFrame | None = None) -> DataFrame:
    """Requested, saved, skipped and failed counts of a sample store run, split and class counts."""
    ids = [
        requested.select(F.lit("requested").alias("k")), index.select(F.lit("index").alias("k")),
        errors.select(F.lit("failed").alias("k")), skipped.select(F.lit("skipped").alias("k")),
    ]
    every = ids[0].unionByName(ids[1]).unionByName(ids[2]).unionByName(ids[3])

    def n(kind):
        return n_where(F.col("k") == kind)

    out = long_report(every, {
        "total_requested": n("requested"), "saved_count": n("index") - n("skipped"), "skipped_count": n("skipped"),
        "failed_count": n("failed"), "indexed_count": n("index"),
    }, {}).unionByName(long_report(index, {}, {"split": "split", "change_class": "change_class"}))
    if stored_bytes is None:
        return out
    return out.unionByName(long_report(stored_bytes, {"storage_mb": F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1024.0**2, 3)}, {}))
