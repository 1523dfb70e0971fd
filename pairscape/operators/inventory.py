"""Two sensors' raster inventories: alignment, matching, band roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import finite
from .ranking import first_by_key, top_k

TOLERANCE = 1e-6
BOUNDS = ("bounds_left", "bounds_bottom", "bounds_right", "bounds_top")
RESOLUTION = ("resolution_x", "resolution_y")


def _sides(a: DataFrame, b: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """Full outer join of the first row per image id of each side, as structs ``a`` and ``b``."""
    def one(df: DataFrame, name: str) -> DataFrame:
        present = [c for c in fields if c in df.columns]
        return first_by_key(df, ["image_id"], order).select("image_id", F.struct(*present).alias(name))

    return one(a, "a").join(one(b, "b"), "image_id", "full_outer")


def alignment(a: DataFrame, b: DataFrame, order=("full_path",), tolerance: float = TOLERANCE) -> DataFrame:
    """Compare two quality tables per image id.

    crs, width and height compare null-safe (both unknown is equal); a null in
    a tolerance test is not equal. Flags are null unless both rasters were read.
    """
    fields = ["district", "year", "season", "full_path", "readable", "band_count", "crs", "width", "height", *RESOLUTION, *BOUNDS]
    joined = _sides(a, b, fields, list(order))
    base = F.coalesce("a", "b")

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    def close(cols) -> Column:
        out = F.lit(True)
        for c in cols:
            out = out & F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance, F.lit(False))
        return out

    both = F.col("a").isNotNull() & F.col("b").isNotNull() & yes("a.readable") & yes("b.readable")
    flags = {
        **{f"same_{c}": F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("crs", "width", "height")},
        "same_resolution": close(RESOLUTION),
        "same_bounds_approx": close(BOUNDS),
    }
    equal = F.lit(True)
    for f in flags.values():
        equal = equal & f
    status = (
        F.when(F.col("a").isNull(), "missing_sentinel")
        .when(F.col("b").isNull(), "missing_dynamic_world")
        .when(~both, "unreadable").when(equal, "aligned").otherwise("mismatch")
    )
    return joined.select(
        "image_id", *[base[c].alias(c) for c in ("district", "year", "season")],
        F.col("a.full_path").alias("sentinel_path"), F.col("b.full_path").alias("dw_path"),
        F.col("a.readable").alias("sentinel_readable"), F.col("b.readable").alias("dw_readable"),
        *[F.when(both, f).alias(n) for n, f in flags.items()],
        F.col("a.band_count").alias("sentinel_band_count"), F.col("b.band_count").alias("dw_band_count"),
        status.alias("alignment_status"),
    )


def matched_inventory(a: DataFrame, b: DataFrame, align: DataFrame, order=("full_path",)) -> DataFrame:
    """One row per image id of either inventory or the alignment table."""
    fields = ["district", "year", "season", "full_path", "filename", "parse_status"]
    sides = _sides(a, b, fields, list(order))
    checks = first_by_key(align, ["image_id"], ["sentinel_path", "dw_path"])
    c = checks.select("image_id", F.struct(*[x for x in checks.columns if x != "image_id"]).alias("c"))
    joined = sides.join(c, "image_id", "full_outer")

    def is_true(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit(False))

    has_a = F.coalesce(F.col("a.parse_status") == "success", F.lit(False))
    has_b = F.coalesce(F.col("b.parse_status") == "success", F.lit(False))
    aligned = F.coalesce(F.col("c.alignment_status") == "aligned", F.lit(False))
    valid = has_a & has_b & aligned & is_true("c.sentinel_readable") & is_true("c.dw_readable")
    kept = ("sentinel_band_count", "dw_band_count", "sentinel_readable", "dw_readable", "same_crs", "same_width",
            "same_height", "same_resolution", "same_bounds_approx")
    return joined.select(
        "image_id",
        *[F.coalesce(f"c.{x}", f"a.{x}", f"b.{x}").alias(x) for x in ("district", "year", "season")],
        F.coalesce("c.sentinel_path", "a.full_path").alias("sentinel_path"),
        F.col("a.filename").alias("sentinel_filename"), F.col("a.parse_status").alias("sentinel_parse_status"),
        F.coalesce("c.dw_path", "b.full_path").alias("dw_path"),
        F.col("b.filename").alias("dw_filename"), F.col("b.parse_status").alias("dw_parse_status"),
        has_a.alias("has_sentinel"), has_b.alias("has_dynamic_world"), (has_a & has_b).alias("is_matched"),
        F.col("c.alignment_status").alias("alignment_status"), aligned.alias("is_aligned"),
        valid.alias("is_valid_for_training"), *[F.col(f"c.{x}").alias(x) for x in kept],
    )


def band_stats(pixels: DataFrame, by=("image_id", "band"), nodata: str = "nodata", shown: int = 20) -> DataFrame:
    """min, max, distinct count, integer-like flag and first distinct values per raster and band.

    Values are made distinct first (combined before the shuffle), so a raster of
    any size arrives as its distinct values; only the first ``shown`` are listed.
    """
    by = list(by)
    value = finite("value")
    used = F.when(F.col(nodata).isNull() | (value != F.col(nodata)), value) if nodata in pixels.columns else value
    distinct = pixels.select(*by, used.alias("v")).distinct()
    near_integer = F.abs(F.col("v") - F.rint("v")) <= 1e-8 + 1e-5 * F.abs(F.rint("v"))
    stats = distinct.groupBy(*by).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("unique_count"),
        F.coalesce(F.bool_and(F.when(F.col("v").isNotNull(), near_integer)), F.lit(False)).alias("integer_like"),
    )
    first = top_k(distinct.dropna(subset=["v"]), by, ["v"], shown).groupBy(*by).agg(
        F.array_sort(F.collect_list("v")).alias("__first")
    )
    listed = F.when(F.col("integer_like"), F.col("__first")).otherwise(F.array().cast("array<double>"))
    return stats.join(first, by, "left").withColumn("first_values", listed).drop("__first")


def band_roles(stats: DataFrame, description: str = "description") -> DataFrame:
    """Which bands look like class labels, probabilities or one-hot flags over all rasters.

    ``recommended`` marks the last label candidate.
    """
    named = (
        F.coalesce(F.bool_or(F.lower(F.col(description)).contains("label")), F.lit(False))
        if description in stats.columns else F.lit(False)
    )
    rows = stats.groupBy("band").agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.max("unique_count").alias("max_unique"),
        F.bool_and("integer_like").alias("integers"), named.alias("named"),
    )
    low, high, n, whole = F.col("min"), F.col("max"), F.col("max_unique"), F.col("integers")

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    roles = rows.select(
        "band", "min", "max", "max_unique",
        (F.col("named") | sure(whole & (low >= 0) & (high <= 20) & (n <= 25))).alias("label_candidate"),
        sure((low >= 0) & (high <= 1) & (n > 20)).alias("probability_candidate"),
        sure(whole & low.isin(0.0, 1.0) & high.isin(0.0, 1.0) & (n <= 2)).alias("one_hot_candidate"),
    )
    last = roles.agg(F.max(F.when(F.col("label_candidate"), F.col("band")))).scalar()
    return roles.withColumn("recommended", F.coalesce(F.col("band") == last, F.lit(False)))
