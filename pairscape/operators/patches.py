"""Patch grids, labels from class maps, spatial sampling and sample assembly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import functions as fn

# Default patch geometry, the valid-pixel limit, messages.
PATCH, STRIDE, CHANNELS = 128, 64, 13
MIN_VALID_RATIO = 0.80
MSG_NO_LABEL = "Missing label output for patch, likely due to failed chunk."
MSG_NO_SIZE = "raster size unknown"
MSG_NO_RASTER = "no pixels of raster "
#: Side of a block of pixels that is summed as a whole.
BLOCK = 64
#: Tasks for each shuffle partition where the grids of pairs are made: a grid is many times as long as its pair.
GRID_TASKS = 4
LABEL_COLUMNS = (
    "valid_pixel_count", "changed_pixel_count", "valid_pixel_ratio", "change_ratio", "change_class",
    "label_status", "label_error_message",
)


def _check(patch: int, stride: int) -> None:
    if patch <= 0 or stride <= 0:
        raise ValueError("patch size and stride must be positive")


def _starts(length: Column, patch: int, stride: int) -> Column:
    """0, stride, … while a whole patch fits; an empty array for a smaller raster."""
    last = length - patch
    return F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"), F.lit(stride))).otherwise(
        F.array().cast("array<int>")
    )


def patch_grid(sizes: DataFrame, patch: int = PATCH, stride: int = STRIDE, width="width", height="height") -> DataFrame:
    """Every (x, y) whose patch lies inside the raster."""
    _check(patch, stride)
    rows = sizes.withColumn("y", F.explode(_starts(F.col(height), patch, stride)))
    rows = rows.withColumn("x", F.explode(_starts(F.col(width), patch, stride)))
    return rows.withColumns({"patch_size": F.lit(patch), "stride": F.lit(stride)})


def patch_count(width, height, patch: int = PATCH, stride: int = STRIDE) -> Column:
    """How many patches ``patch_grid`` yields, in closed form."""
    _check(patch, stride)

    def along(n) -> Column:
        n = fn.as_col(n)
        return F.when(n >= patch, F.floor((n - patch) / stride) + 1).otherwise(0)

    return along(width) * along(height)


def out_of_bounds(grid: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Rows whose patch leaves the raster."""
    return grid.filter(
        (F.col("x") < 0) | (F.col("y") < 0)
        | (F.col("x") + F.col("patch_size") > F.col(width)) | (F.col("y") + F.col("patch_size") > F.col(height))
    )


def check_grid(grid: DataFrame, width: str = "width", height: str = "height") -> None:
    n = out_of_bounds(grid, width, height).count()
    if n:
        raise ValueError(f"{n} patches leave their raster")


def patch_index(
    pairs: DataFrame, sizes: DataFrame, patch: int = PATCH, stride: int = STRIDE, by_pair: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(index, errors): the grid of every pair whose two rasters have one known size.

    ``by_pair`` lays equal pair ids together before the grids are made, so what
    groups the patches by pair need not shuffle them.
    """
    sized = pairs
    for t in ("t1", "t2"):
        side = sizes.select(
            F.col("path").alias(f"sentinel_path_{t}"), F.col("width").alias(f"__w_{t}"), F.col("height").alias(f"__h_{t}")
        )
        sized = sized.join(side, f"sentinel_path_{t}", "left")
    unknown = F.col("__w_t1").isNull() | F.col("__w_t2").isNull()
    differ = (F.col("__w_t1") != F.col("__w_t2")) | (F.col("__h_t1") != F.col("__h_t2"))
    message = F.when(unknown, MSG_NO_SIZE).when(
        differ, F.format_string("Sentinel t1/t2 shape mismatch: t1=%dx%d, t2=%dx%d", "__w_t1", "__h_t1", "__w_t2", "__h_t2")
    )
    judged = sized.withColumn("error_message", message)
    good = judged.filter(F.col("error_message").isNull())
    if by_pair:
        good = good.repartition(GRID_TASKS * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id")
    grid = patch_grid(good, patch, stride, "__w_t1", "__h_t1")
    index = grid.withColumn("patch_id", fn.patch_id("pair_id", "x", "y"))
    keep = [c for c in (
        "patch_id", "pair_id", "district", "split", "image_id_t1", "image_id_t2", "year_t1", "season_t1", "year_t2",
        "season_t2", "pair_type", "time_gap_group", "x", "y", "patch_size", "stride", "sentinel_path_t1",
        "sentinel_path_t2", "dw_path_t1", "dw_path_t2",
    ) if c in index.columns]
    errors = judged.filter(F.col("error_message").isNotNull()).select("pair_id", "district", "split", "error_message")
    return index.select(*keep), errors


def spatial_sample(patches: DataFrame, max_per_pair: int = 50, seed: int = 42, named: bool = False) -> DataFrame:
    """At most ``max_per_pair`` patches per pair, round-robin over coarse spatial bins.

    Bins are visited in text order of ``x_y``, hash order inside a bin. The k-th
    row of every bin comes before the (k+1)-th of any, and only the first
    ``max_per_pair`` of a bin can have a turn. The rows are shuffled once by
    pair, for its extent, its bins and its turns alike (a pair's patches are the
    grid of one raster), and the sampled ones once by their id: a repeated patch
    id stops the job. ``patches`` is worked out once and nothing is written.

    ``named`` says that ids are ``fn.patch_id`` of pair, x and y and that a pair has
    one patch size; a row that differs stops the job. Equal ids are then rows of one
    pair and one place, next to each other in its hash order, so that no shuffle by
    id is needed; and patches that lie together by pair are not shuffled at all.
    """
    if max_per_pair <= 0:
        raise ValueError("max_per_pair must be positive")
    per_axis = max(1, math.ceil(math.sqrt(max_per_pair)))
    half = F.col("patch_size").cast("double") / 2
    pair = Window.partitionBy("pair_id")
    centered = patches.filter(F.col("pair_id").isNotNull()).withColumns({
        f"patch_center_{a}": F.col(a).cast("double") + half for a in "xy"
    })
    spanned = centered.withColumns({
        "sampled_from_total_pair_patches": F.count(F.lit(1)).over(pair),
        **{f"__{n}_{a}": f(f"patch_center_{a}").over(pair) for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))},
    })

    def bin_of(a: str) -> Column:
        lo, hi, v = F.col(f"__lo_{a}"), F.col(f"__hi_{a}"), F.col(f"patch_center_{a}")
        scaled = F.try_divide(v - lo, hi - lo) * per_axis
        return F.coalesce(F.least(F.greatest(F.floor(scaled), F.lit(0)), F.lit(per_axis - 1)), F.lit(0)).cast("string")

    def stop(message: str) -> Column:
        return F.raise_error(F.lit(message)).cast("string")

    if named:
        odd = (F.col("patch_id") != fn.patch_id("pair_id", "x", "y")) | (F.col("patch_size") != F.min("patch_size").over(pair))
        spanned = spanned.withColumn("patch_id", F.when(odd, stop("a patch id does not name its pair and place")).otherwise(F.col("patch_id")))
    binned = spanned.withColumns({"__bin": F.concat_ws("_", bin_of("x"), bin_of("y")), "__h": fn.hash_key(seed, "patch_id")})
    order = Window.partitionBy("pair_id", "__bin").orderBy("__h", "patch_id")
    ranked = binned.withColumn("__r", F.row_number().over(order))
    if named:
        ranked = ranked.withColumn("__again", F.col("patch_id") == F.lag("patch_id").over(order))
    firsts = ranked.filter(F.col("__r") <= max_per_pair)
    turn = F.row_number().over(pair.orderBy("__r", "__bin"))
    kept = firsts.withColumn("__turn", turn).filter(F.col("__turn") <= max_per_pair)
    total = F.col("sampled_from_total_pair_patches")
    # a copy has its turn after the row before it, so both are sampled
    twice = F.col("__again") if named else F.row_number().over(Window.partitionBy("patch_id").orderBy("pair_id")) > 1
    checked = kept.select(
        *patches.columns, "patch_center_x", "patch_center_y", "sampled_from_total_pair_patches",
        (F.least(total, F.lit(max_per_pair)) / total).alias("pair_sampling_ratio"), *(["__again"] if named else []),
    ).withColumn(
        "patch_id", F.when(twice, stop("sampled patch ids are not unique")).otherwise(F.col("patch_id"))
    )
    return checked.filter(F.col("patch_id").isNotNull()).drop("__again")


def _labels(valid: Column, changed: Column, total: Column, minimum: float) -> dict[str, Column]:
    ratio = F.try_divide(changed, valid)
    valid_ratio = F.coalesce(F.try_divide(valid, total), F.lit(0.0))
    return {
        "valid_pixel_count": valid.cast("bigint"),
        "changed_pixel_count": changed.cast("bigint"),
        "valid_pixel_ratio": valid_ratio,
        "change_ratio": ratio,
        "change_class": fn.change_class(ratio),
        "label_status": F.when(valid_ratio < minimum, "invalid_low_valid_ratio").otherwise("success"),
        "label_error_message": F.lit(None).cast("string"),
    }


def label_arrays(
    patches: DataFrame, t1: str = "values_t1", t2: str = "values_t2", nodata1: str = "nodata_t1",
    nodata2: str = "nodata_t2", minimum: float = MIN_VALID_RATIO,
) -> DataFrame:
    """Label each row from its two class arrays; no shuffle.

    A pixel counts if it is finite in both and differs from each nodata value.
    Missing arrays or unequal lengths give a failed row, never an exception.
    """
    def valid(v: Column, nodata: str) -> Column:
        nd = fn.not_nan(nodata)
        return fn.is_finite(v) & (nd.isNull() | (v != nd))

    codes = F.zip_with(t1, t2, lambda a, b: F.when(valid(a, nodata1) & valid(b, nodata2), F.when(a != b, 2).otherwise(1)).otherwise(0))
    error = (
        F.when(F.col(t1).isNull() | F.col(t2).isNull(), F.lit("label band is missing"))
        .when(F.size(t1) != F.size(t2), F.format_string("Window shape mismatch: t1=%d, t2=%d", F.size(t1), F.size(t2)))
    )
    coded = patches.withColumns({"__c": F.when(error.isNull(), codes), "__error": error})
    sums = F.aggregate(
        "__c", F.struct(F.lit(0).alias("v"), F.lit(0).alias("c")),
        lambda acc, x: F.struct((acc["v"] + (x > 0).cast("int")).alias("v"), (acc["c"] + (x > 1).cast("int")).alias("c")),
    )
    counted = coded.withColumn("__s", sums)
    good = _labels(F.col("__s.v"), F.col("__s.c"), F.size("__c"), minimum)
    return _with_failures(counted, good).drop("__c", "__s", "__error")


def _pixel_blocks(pixels: DataFrame) -> DataFrame:
    """(image_id, bx, by, p, v): the valid pixels of each square block, by their place in it.

    Of a pixel that occurs more than once the greatest valid value counts. The
    pixels are shuffled once, by block, for both groupings.
    """
    value = F.when(F.col("nodata").isNull() | (F.col("value") != fn.not_nan("nodata")), fn.finite("value"))
    placed = pixels.select(
        "image_id", F.floor(F.col("col") / BLOCK).alias("bx"), F.floor(F.col("row") / BLOCK).alias("by"),
        (F.col("row") % BLOCK * BLOCK + F.col("col") % BLOCK).cast("int").alias("p"), value.alias("v"),
    ).filter(F.col("v").isNotNull())
    block = ["image_id", "bx", "by"]
    once = placed.repartition(*block).groupBy(*block, "p").agg(F.max("v").alias("v"))
    cells = once.groupBy(*block).agg(F.collect_list(F.struct("p", "v")).alias("c"))
    return cells.select(*block, F.col("c.p").alias("p"), F.col("c.v").alias("v"))


def _block_counts(patch: int):
    """Valid and changed pixels of every window's part in a block, from prefix sums over the block."""
    side = BLOCK

    def summed(flags: np.ndarray) -> np.ndarray:
        out = np.zeros((side + 1, side + 1), np.int64)
        out[1:, 1:] = flags.reshape(side, side).cumsum(0).cumsum(1)
        return out

    def dense(places, values) -> np.ndarray:
        out = np.full(side * side, np.nan)
        out[places] = values
        return out

    def count(batches):
        for batch in batches:
            valid, changed, offsets = [], [], batch.column("xs").value_lengths().to_numpy(zero_copy_only=False)
            columns = {c: batch.column(c) for c in ("bx", "by", "p1", "v1", "p2", "v2", "xs", "ys")}
            for i in range(batch.num_rows):
                bx, by, *lists = (columns[c][i].values.to_numpy(zero_copy_only=False) if c not in ("bx", "by") else columns[c][i].as_py() for c in columns)
                a, b = dense(lists[0], lists[1]), dense(lists[2], lists[3])
                ok = ~np.isnan(a) & ~np.isnan(b)
                x, y = lists[4] - bx * side, lists[5] - by * side
                x0, x1, y0, y1 = np.maximum(x, 0), np.minimum(x + patch, side), np.maximum(y, 0), np.minimum(y + patch, side)
                for flags, out in ((ok, valid), (ok & (a != b), changed)):
                    t = summed(flags)
                    out.append(t[y1, x1] - t[y0, x1] - t[y1, x0] + t[y0, x0])
            at = np.repeat(np.arange(batch.num_rows), offsets)
            ids = [batch.column(c).take(pa.array(at)) for c in ("image_id_t1", "image_id_t2")]
            flat = [columns[c].flatten() for c in ("xs", "ys")]
            sums = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in (valid, changed)]
            yield pa.RecordBatch.from_arrays([*ids, *flat, *sums], ["image_id_t1", "image_id_t2", "x", "y", "v", "c"])

    return count


def label_pixels(
    patches: DataFrame, pixels: DataFrame, patch: int = PATCH, stride: int = STRIDE, minimum: float = MIN_VALID_RATIO
) -> DataFrame:
    """Label patches from pixel rows (image_id, row, col, value, nodata).

    Pixels are packed once into blocks of ``BLOCK`` pixels a side, whatever patch
    and stride are. For each image pair, a block that windows overlap gets 2-D
    prefix sums of its valid and its changed pixels, so a window's part of a
    block is four lookups, and a window sums at most ceil(patch / BLOCK) + 1
    blocks a side. ``stride`` is checked only: windows may start anywhere.

    A patch one of whose images has no pixel row at all is a failed row. Of a
    pixel that occurs more than once the greatest valid value counts.
    """
    _check(patch, stride)
    pair = ["image_id_t1", "image_id_t2"]
    window = [*pair, "x", "y"]
    windows = patches.select(*pair, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()

    def over(c: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(c) / BLOCK), F.floor((F.col(c) + patch - 1) / BLOCK)))

    blocks = _pixel_blocks(pixels)
    place = [*pair, "bx", "by"]
    asked = windows.withColumn("bx", over("x")).withColumn("by", over("y")).groupBy(*place).agg(F.collect_list(F.struct("x", "y")).alias("w"))
    asked = asked.select(*place, F.col("w.x").alias("xs"), F.col("w.y").alias("ys"))

    def of(t: str) -> DataFrame:
        return blocks.select(F.col("image_id").alias(f"image_id_{t}"), "bx", "by", F.col("p").alias(f"p{t[1]}"), F.col("v").alias(f"v{t[1]}"))

    both = asked.join(of("t1"), ["image_id_t1", "bx", "by"]).join(of("t2"), ["image_id_t2", "bx", "by"])
    kinds = {f.name: f.dataType.simpleString() for f in patches.schema.fields}
    kind = ", ".join(f"{c} {kinds[c]}" for c in pair) + ", x long, y long, v long, c long"
    counted = both.select(*place, "xs", "ys", "p1", "v1", "p2", "v2").mapInArrow(_block_counts(patch), kind)
    summed = counted.groupBy(*window).agg(F.sum("v").alias("__v"), F.sum("c").alias("__c"))
    there = pixels.select("image_id").distinct()
    out = patches.withColumns({"__x": F.col("x").cast("long"), "__y": F.col("y").cast("long")}).join(
        summed.withColumnsRenamed({"x": "__x", "y": "__y"}), [*pair, "__x", "__y"], "left"
    )
    missing = None
    for c in pair:
        side = there.select(F.col("image_id").alias(c), F.lit(True).alias(f"__has_{c}"))
        out = out.join(side, c, "left")
        absent = F.when(F.col(f"__has_{c}").isNull(), F.concat(F.lit(MSG_NO_RASTER), F.coalesce(F.col(c).cast("string"), F.lit("None"))))
        missing = absent if missing is None else F.coalesce(missing, absent)
    failed = out.withColumn("__error", missing)
    labels = _labels(F.coalesce("__v", F.lit(0)), F.coalesce("__c", F.lit(0)), F.lit(patch * patch), minimum)
    return _with_failures(failed, labels).drop("__v", "__c", "__x", "__y", "__error", *[f"__has_{c}" for c in pair]).select(
        *patches.columns, *[c for c in labels if c not in patches.columns]
    )


def _with_failures(rows: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """``labels`` where ``__error`` is null; elsewhere a failed row with that message."""
    failed = F.col("__error").isNotNull()
    final = {n: F.when(~failed, c) for n, c in labels.items()}
    final["change_class"] = F.when(failed, "invalid").otherwise(labels["change_class"])
    final["label_status"] = F.when(failed, "failed").otherwise(labels["label_status"])
    final["label_error_message"] = F.col("__error")
    return rows.withColumns(final)


def attach_labels(patches: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on (patch_id, pair_id); a patch without a label is a failed one."""
    keys = ["patch_id", "pair_id"]
    joined = patches.join(labels.select(*keys, *[c for c in LABEL_COLUMNS if c in labels.columns]), keys, "left")
    none = F.col("label_status").isNull()
    return joined.withColumns({
        "label_error_message": F.when(none, MSG_NO_LABEL).otherwise(F.col("label_error_message")),
        "change_class": F.when(none, "invalid").otherwise(F.col("change_class")),
        "label_status": F.coalesce("label_status", F.lit("failed")),
    })


def robust_scale(df: DataFrame, col: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each row's array to two of its own percentiles and scale to [0, 1]; no shuffle.

    Missing and non-finite values count as 0. A flat array becomes all 0.
    """
    clean = F.transform(col, lambda v: F.coalesce(fn.finite(v), F.lit(0.0)))
    step1 = df.withColumn("__clean", clean).withColumn("__sorted", F.array_sort("__clean"))

    def at(p: float) -> Column:
        pos = (F.size("__sorted") - 1) * F.lit(p)
        lower = F.get("__sorted", F.floor(pos).cast("int"))
        upper = F.get("__sorted", F.ceil(pos).cast("int"))
        return lower + (upper - lower) * (pos - F.floor(pos))

    step2 = step1.withColumns({"__lo": at(low), "__hi": at(high)})
    lo, hi = F.col("__lo"), F.col("__hi")
    scaled = F.transform(
        "__clean", lambda v: F.when(hi > lo, F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    )
    return step2.withColumn(out, scaled).drop("__clean", "__sorted", "__lo", "__hi")


def min_max_scale(df: DataFrame, col: str, out: str) -> DataFrame:
    """Array scaled by its own minimum and maximum; a flat array becomes all 0."""
    return robust_scale(df, col, out, 0.0, 1.0)


def assemble_vector(df: DataFrame, cols: list[str], name: str = "tabular") -> DataFrame:
    """Ordered columns as one float array; null, NaN and infinities become 0."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise KeyError(f"missing tabular feature columns: {absent[:10]}")
    parts = [F.coalesce(fn.finite(c), F.lit(0.0)).cast("float") for c in cols]
    return df.withColumn(name, F.array(*parts))


def build_samples(
    patches: DataFrame, bands: DataFrame, vectors: DataFrame, channels: int = CHANNELS, cells: int = PATCH * PATCH
) -> tuple[DataFrame, DataFrame]:
    """(samples, errors) of labeled patches.

    ``bands`` holds (patch_id, time, band, values) with time ``t1``/``t2``, one
    band array per row; ``vectors`` holds (pair_id, tabular). A band is scaled
    in its own row and a patch gathers at most 2·channels of them. Wrong band
    counts or lengths, or an unknown pair, become an error row.
    """
    scaled = robust_scale(bands, "values", "scaled").select(
        "patch_id", "time", "band", F.transform("scaled", lambda v: v.cast("float")).alias("scaled"), F.size("values").alias("n")
    )
    per_time = scaled.groupBy("patch_id", "time").agg(
        F.count(F.lit(1)).alias("bands"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("band", "scaled"))), lambda b: b["scaled"])).alias("image"),
    )
    images = per_time.groupBy("patch_id").agg(*[
        F.max_by(F.struct("bands", "low", "high", "image"), F.when(F.col("time") == t, 1)).alias(f"__{t}") for t in ("t1", "t2")
    ])

    def wrong(t: str) -> Column:
        s = F.col(f"__{t}")
        return F.coalesce((s["bands"] != channels) | (s["low"] != cells) | (s["high"] != cells), F.lit(True))

    joined = patches.join(images, "patch_id", "left").join(vectors.select("pair_id", "tabular"), "pair_id", "left")
    error = (
        F.when(wrong("t1") | wrong("t2"), F.lit(f"expected {channels} bands of {cells} values at both times"))
        .when(F.col("tabular").isNull(), F.concat(F.lit("Pair id not found in tabular features: "), "pair_id"))
    )
    judged = joined.withColumn("error_message", error)
    text = ("patch_id", "pair_id", "district", "split", "change_class", "pair_type", "time_gap_group")
    samples = judged.filter(F.col("error_message").isNull()).select(
        *text, F.col("change_ratio").cast("float").alias("change_ratio"),
        F.col("__t1.image").alias("image_t1"), F.col("__t2.image").alias("image_t2"), "tabular",
    )
    return samples, judged.filter(F.col("error_message").isNotNull()).select("patch_id", "pair_id", "split", "error_message")


def tensor_check(samples: DataFrame, cells: int = CHANNELS * PATCH * PATCH) -> DataFrame:
    """(metric, value): wrong image lengths, NaN and infinite values, distinct vector lengths."""
    def count_in(c: str, test) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(c, test))), F.lit(0)).cast("double")

    parts = {"samples": F.count(F.lit(1)).cast("double"), "tabular_lengths": F.count_distinct(F.size("tabular")).cast("double")}
    for c in ("image_t1", "image_t2"):
        parts[f"{c}_wrong_length"] = F.count(F.when(F.size(c) != cells, 1)).cast("double")
    for c in ("image_t1", "image_t2", "tabular"):
        parts[f"{c}_nan"] = count_in(c, lambda v: F.isnan(v))
        parts[f"{c}_inf"] = count_in(c, lambda v: F.abs(v) == float("inf"))
    row = samples.agg(*[v.alias(k) for k, v in parts.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in parts])))
