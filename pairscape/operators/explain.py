"""Model scoring on samples, ablation and occlusion importance, sample choice, case studies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as fn
from ..session import cut_lineage, stored
from .ranking import beside, exact_quantiles, first_by_key, last_by_key, top_k

# Ablation variants, contribution columns, stage values and texts.
VARIANTS = ("full", "no_tabular", "no_image", "no_t1", "no_t2", "same_time", "swapped_time")
CONTRIBUTIONS = {
    "image_contribution": "no_image",
    "tabular_contribution": "no_tabular",
    "t1_contribution": "no_t1",
    "t2_contribution": "no_t2",
    "temporal_difference_contribution": "same_time",
    "temporal_order_sensitivity": "swapped_time",
}
STAGE_GAPS = ("short", "medium", "long", "very_long", "same_year")
SUMMARY_COUNTS = ("dominant_modality", "dominant_time_step", "change_class", "pair_type", "time_gap_group")
INDEX_FIELDS = ("pair_id", "district", "split", "change_class", "pair_type", "time_gap_group")


# --- scoring -------------------------------------------------------------------------------

def score_many(
    samples: DataFrame, model: Callable, variants: Callable[..., Iterator], keep: list[str],
    t1: str = "image_t1", t2: str = "image_t2", tabular: str = "tabular",
) -> DataFrame:
    """Add ``scores``: one prediction per variant of each sample.

    ``model(t1, t2, tabular)`` takes NumPy matrices (one row per sample) and
    returns one number, or one row of logits, per sample. ``variants`` yields
    changed copies of the three matrices. They are made inside the task, batch
    by batch, so a sample crosses to Python once however many variants there are.
    """
    import numpy as np

    fields = [samples.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", scores array<array<double>>"

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a, b, c = (np.stack(pdf[n].to_numpy()).astype("float64") for n in (t1, t2, tabular))
            rows = [np.asarray(model(*v), dtype="float64").reshape(len(pdf), -1) for v in variants(a, b, c)]
            out = pdf[keep].copy()
            out["scores"] = [[r[i].tolist() for r in rows] for i in range(len(pdf))]
            yield out

    need = list(dict.fromkeys([*keep, t1, t2, tabular]))
    return samples.select(*need).mapInPandas(run, schema)


def score(samples: DataFrame, model: Callable, keep: list[str], true: str = "change_ratio") -> DataFrame:
    """One prediction per sample with absolute and squared error."""
    def plain(a, b, c):
        yield a, b, c

    kept = list(dict.fromkeys([*keep, true]))
    scored = score_many(samples, model, plain, kept)
    pred = scored.withColumn("prediction", F.get(F.get("scores", F.lit(0)), F.lit(0))).drop("scores")
    error = F.col("prediction") - F.col(true)
    return pred.withColumns({"abs_error": F.abs(error), "squared_error": error * error})


def score_logits(samples: DataFrame, model: Callable, keep: list[str]) -> DataFrame:
    """One array of logits per sample."""
    def plain(a, b, c):
        yield a, b, c

    return score_many(samples, model, plain, keep).withColumn("logits", F.get("scores", F.lit(0))).drop("scores")


def _importance_rows(scored: DataFrame, keep: list[str], index: str) -> DataFrame:
    """(keep…, full_prediction, index, ablated_prediction, importance) from scores[0] = full."""
    firsts = scored.select(*keep, F.transform("scores", lambda s: F.get(s, F.lit(0))).alias("s"))
    long = firsts.select(*keep, F.get("s", F.lit(0)).alias("full_prediction"), F.posexplode("s").alias("i", "ablated_prediction"))
    return long.filter(F.col("i") > 0).select(
        *keep, "full_prediction", (F.col("i") - 1).alias(index), "ablated_prediction",
        F.abs(F.col("full_prediction") - F.col("ablated_prediction")).alias("importance"),
    )


def ablate_bands(samples: DataFrame, model: Callable, channels: int, keep: list[str]) -> DataFrame:
    """Set one channel of both images to 0 at a time; ``band_index`` counts from 1."""
    def variants(a, b, c):
        yield a, b, c
        size = a.shape[1] // channels
        for k in range(channels):
            x, y = a.copy(), b.copy()
            x[:, k * size:(k + 1) * size] = 0.0
            y[:, k * size:(k + 1) * size] = 0.0
            yield x, y, c

    rows = _importance_rows(score_many(samples, model, variants, keep), keep, "band_index")
    return rows.withColumn("band_index", F.col("band_index") + 1).withColumn(
        "band_name", F.format_string("band_%02d", "band_index")
    )


def ablate_features(samples: DataFrame, model: Callable, names: list[str], keep: list[str]) -> DataFrame:
    """Set one entry of the tabular vector to 0 at a time; ``feature_index`` counts from 0."""
    def variants(a, b, c):
        yield a, b, c
        for k in range(c.shape[1]):
            z = c.copy()
            z[:, k] = 0.0
            yield a, b, z

    rows = _importance_rows(score_many(samples, model, variants, keep), keep, "feature_index")
    known = F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("feature_index"))
    named = rows.withColumn("feature_name", F.coalesce(known, F.format_string("feature_%03d", "feature_index")))
    return named.withColumn("feature_group", fn.feature_group("feature_name"))


def ablate_modalities(samples: DataFrame, model: Callable, keep: list[str]) -> DataFrame:
    """Predictions without tabular data, images or one time, and the contributions they imply."""
    def variants(a, b, c):
        yield a, b, c
        yield a, b, c * 0.0
        yield a * 0.0, b * 0.0, c
        yield a * 0.0, b, c
        yield a, b * 0.0, c
        yield a, a, c
        yield b, a, c

    scored = score_many(samples, model, variants, keep)
    wide = scored.select(*keep, *[
        F.get(F.get("scores", F.lit(i)), F.lit(0)).alias(f"{v}_prediction") for i, v in enumerate(VARIANTS)
    ])
    parts = {c: F.abs(F.col("full_prediction") - F.col(f"{v}_prediction")) for c, v in CONTRIBUTIONS.items()}
    image = F.col("image_contribution") >= F.col("tabular_contribution")
    first = F.col("t1_contribution") >= F.col("t2_contribution")
    return wide.withColumns(parts).withColumns({
        "dominant_modality": F.when(image, "image").otherwise("tabular"),
        "dominant_time_step": F.when(first, "t1").otherwise("t2"),
    })


def window_starts(size: int, window: int, stride: int) -> list[int]:
    """Every ``stride`` while the window fits, plus one start flush with the edge."""
    if window <= 0 or stride <= 0:
        raise ValueError("window size and stride must be positive")
    edge = max(size - window, 0)
    starts = list(range(0, edge + 1, stride))
    return starts if starts[-1] == edge else [*starts, edge]


def occlusion(
    samples: DataFrame, model: Callable, channels: int, height: int, width: int, keep: list[str],
    window: int = 16, stride: int = 16, mask: str = "zero",
) -> DataFrame:
    """Heat map per sample and image: each cell's mean importance over the windows covering it.

    ``heat`` is row-major. The windows are the same for every sample, so the
    map is built inside the row from the window importances, without a shuffle.
    """
    if mask not in ("zero", "channel_mean"):
        raise ValueError("mask must be zero or channel_mean")
    ys, xs = window_starts(height, window, stride), window_starts(width, window, stride)

    def hide(image, y, x):
        cube = image.reshape(len(image), channels, height, width).copy()
        fill = 0.0 if mask == "zero" else cube.mean(axis=(2, 3), keepdims=True)
        cube[:, :, y:y + window, x:x + window] = fill
        return cube.reshape(len(image), -1)

    def variants(a, b, c):
        yield a, b, c
        for y in ys:
            for x in xs:
                yield hide(a, y, x), b, c
        for y in ys:
            for x in xs:
                yield a, hide(b, y, x), c

    scored = score_many(samples, model, variants, keep)
    flat = scored.select(*keep, F.transform("scores", lambda s: F.get(s, F.lit(0))).alias("s"))
    n = len(ys) * len(xs)
    full = F.get("s", F.lit(0))
    sides = F.explode(F.array(*[
        F.struct(F.lit(t).alias("target_image"), F.transform(F.slice("s", start, n), lambda p: F.abs(full - p)).alias("imp"))
        for t, start in (("t1", 2), ("t2", 2 + n))
    ]))
    each = flat.select(*keep, full.alias("full_prediction"), sides.alias("e")).select(*keep, "full_prediction", "e.*")
    corners = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in ys for x in xs])

    def cell(i: Column) -> Column:
        row, col = F.floor(i / width), i % width
        cover = F.zip_with(corners, "imp", lambda w, v: F.when(
            (row >= w["y"]) & (row < w["y"] + window) & (col >= w["x"]) & (col < w["x"] + window), v
        ))
        hit = F.filter(cover, lambda v: v.isNotNull())
        return F.coalesce(F.try_divide(F.aggregate(hit, F.lit(0.0), lambda a, v: a + v), F.size(hit)), F.lit(0.0))

    heat = each.withColumn("heat", F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), cell)).drop("imp")
    mean = F.aggregate("heat", F.lit(0.0), lambda a, v: a + v) / F.size("heat")
    return heat.withColumns({"mean_importance": mean, "max_importance": F.array_max("heat")})


def stitch(
    maps: DataFrame, by: list[str], order: str, width: int, height: int, heat: str = "heat", dense: bool = False
) -> DataFrame:
    """Cells of overlapping maps placed at their patch's (x, y); the later patch in ``order`` wins.

    ``row``/``col`` are relative to the smallest patch coordinate of the mosaic.
    ``dense`` adds the uncovered cells of the extent as null.
    """
    extent = maps.groupBy(*by).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )
    cells = maps.select(*by, "x", "y", order, F.posexplode(heat).alias("i", "v")).select(
        *by, order, (F.col("x") + F.col("i") % width).alias("gx"), (F.col("y") + F.floor(F.col("i") / width)).alias("gy"), "v"
    )
    latest = cells.groupBy(*by, "gx", "gy").agg(F.max_by("v", order).alias("value"))
    if dense:
        grid = extent.withColumn("gy", F.explode(F.sequence("min_y", F.col("max_y") + height - 1)))
        grid = grid.withColumn("gx", F.explode(F.sequence("min_x", F.col("max_x") + width - 1)))
        placed = grid.select(*by, "min_x", "min_y", "gx", "gy").join(latest, [*by, "gx", "gy"], "left")
    else:
        placed = latest.join(extent, by)
    return placed.select(*by, (F.col("gy") - F.col("min_y")).alias("row"), (F.col("gx") - F.col("min_x")).alias("col"), "value")


def mosaic_extent(maps: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Left, right, bottom and top of each mosaic."""
    return maps.groupBy(*by).agg(
        F.min("x").alias("left"), (F.max("x") + width).alias("right"), (F.max("y") + height).alias("bottom"), F.min("y").alias("top")
    )


# --- summaries -----------------------------------------------------------------------------

def importance_summary(rows: DataFrame, keys: list[str], value: str = "importance") -> DataFrame:
    """Count, mean, median and maximum per item over numeric values, highest mean first."""
    clean = rows.select(*keys, fn.safe_float(value).alias("v")).filter(F.col("v").isNotNull())
    stats = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("v").alias("mean_importance"), F.max("v").alias("max_importance")
    )
    medians = exact_quantiles(clean, keys, "v", {"median_importance": 0.5})
    return beside(stats, medians, keys).orderBy(F.desc("mean_importance"), *keys)


def importance_by_group(summary: DataFrame, group: str = "feature_group") -> DataFrame:
    """Feature count, mean and maximum of the item means per feature group."""
    return summary.groupBy(group).agg(
        F.count(F.lit(1)).alias("feature_count"), F.avg("mean_importance").alias("mean_importance"),
        F.max("mean_importance").alias("max_importance"),
    ).orderBy(F.desc("mean_importance"), group)


def ablation_summary(rows: DataFrame) -> DataFrame:
    """(metric, group, value): sample count, mean contributions, value counts."""
    from ..plans.reports import long_report, n_rows

    clean = rows.withColumns({c: fn.safe_float(c) for c in CONTRIBUTIONS})
    report = long_report(
        clean, {"num_samples": n_rows(), **{f"average_{c}": F.avg(c) for c in CONTRIBUTIONS}},
        {f"{c}_count": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SUMMARY_COUNTS if c in rows.columns},
    )
    metric = F.col("summary_type") == "metric"
    return report.select(
        F.when(metric, F.col("value")).otherwise(F.col("summary_type")).alias("metric"),
        F.when(metric, "all").otherwise(F.col("value")).alias("group"), F.col("count").alias("value"),
    )


def occlusion_summary(scores: DataFrame) -> DataFrame:
    """(metric, group, value as text): sample count, mean scores per image, the stronger image."""
    def of(t: str, c: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("target_image") == t, fn.safe_float(c))), F.lit(0.0))

    means = {f"average_{t}_{c}": of(t, c) for c in ("mean_importance", "max_importance") for t in ("t1", "t2")}
    row = scores.agg(
        F.count(F.when(F.col("target_image") == "t1", 1)).alias("number_of_samples"), *[v.alias(k) for k, v in means.items()]
    )
    stronger = F.when(F.col("average_t1_mean_importance") >= F.col("average_t2_mean_importance"), "t1").otherwise("t2")
    wide = row.withColumn("more_spatially_influential", stronger)
    entries = [
        F.struct(F.lit(c).alias("metric"), F.lit("all").alias("group"), F.col(c).cast("string").alias("value")) for c in wide.columns
    ]
    return wide.select(F.inline(F.array(*entries)))


# --- choosing samples ----------------------------------------------------------------------

def merge_predictions(pred: DataFrame, index: DataFrame, order: str = "npz_path") -> DataFrame:
    """Inner join on patch id: prediction value first, then index value; empty text is missing.

    The index keeps its last row per patch id in ``order``.
    """
    last = last_by_key(index.filter(F.col("patch_id") != ""), ["patch_id"], [order])
    side = last.select("patch_id", F.struct(*[c for c in last.columns if c != "patch_id"]).alias("__i"))
    error = fn.prediction_error(pred.columns)
    joined = pred.withColumn("__e", error).join(side, "patch_id")
    have_p, have_i = set(pred.columns), set(last.columns)

    def pick(mine: list[str], theirs: list[str], kind: str = "string") -> Column:
        options = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in mine if c in have_p]
        options += [F.nullif(F.col(f"__i.{c}").cast("string"), F.lit("")) for c in theirs if c in have_i]
        return (F.coalesce(*options) if options else F.lit(None)).try_cast(kind)

    return joined.select(
        "patch_id", *[pick([c], [c]).alias(c) for c in INDEX_FIELDS], pick([], ["npz_path"]).alias("npz_path"),
        pick(["y_true_change_ratio"], ["change_ratio"], "double").alias("y_true_change_ratio"),
        pick(["y_pred_change_ratio", "prediction"], [], "double").alias("y_pred_change_ratio"),
        F.col("__e").alias("abs_error"),
    )


def left_merge_coalesce(a: DataFrame, b: DataFrame, key: str = "patch_id") -> DataFrame:
    """Left join; columns both sides have take a's value, then b's; error and ratio derived if absent."""
    joined = a.join(b.withColumnsRenamed({c: f"{c}__b" for c in b.columns if c != key and c in a.columns}), key, "left")
    both = [c for c in a.columns if c != key and c in b.columns]
    out = joined.withColumns({c: F.coalesce(c, f"{c}__b") for c in both}).drop(*[f"{c}__b" for c in both])
    if "abs_error" not in out.columns and {"y_true_change_ratio", "y_pred_change_ratio"} <= set(out.columns):
        out = out.withColumn("abs_error", F.abs(F.col("y_pred_change_ratio") - F.col("y_true_change_ratio")))
    if "change_ratio" not in out.columns and "y_true_change_ratio" in out.columns:
        out = out.withColumn("change_ratio", F.col("y_true_change_ratio"))
    return out


ORDER = ["stage", "sort_text", "place", "patch_id"]


def _offer(stage, reason, limit, sort_text=None) -> Column:
    """One stage a row stands for: its number, its group, and how many rows the group offers."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        lit(stage).cast("int").alias("stage"), lit(reason).cast("string").alias("reason"), lit(limit).cast("long").alias("k"),
        lit("" if sort_text is None else sort_text).cast("string").alias("sort_text"),
    )


def _by_hash(rows: DataFrame, offers: list[Column], most: int, seed: int) -> DataFrame:
    """Offered rows: per reason the first ``k`` in hash order. All stages share one top-k pass."""
    long = rows.select("patch_id", F.inline(F.array(*offers))).filter(
        F.col("stage").isNotNull() & F.col("reason").isNotNull()
    )
    hashed = long.withColumn("__h", fn.hash_key(seed, "reason", "patch_id"))
    ranked = top_k(hashed, ["reason"], ["__h", "patch_id"], most, "place")
    return ranked.filter(F.col("place") <= F.col("k")).select("patch_id", "stage", "sort_text", "place", "reason")


def _extreme(rows: DataFrame, score: str, k: int) -> dict[str, DataFrame]:
    """The ``k`` rows with the lowest and the highest score, with their place."""
    known = rows.filter(F.col(score).isNotNull()).select("patch_id", score, F.lit(1).alias("__all"))
    return {
        name: top_k(known, ["__all"], [order, "patch_id"], k, "place")
        for name, order in (("low_prediction_error", F.col(score).asc()), ("high_prediction_error", F.col(score).desc()))
    }


def _choose(staged: DataFrame, fill: DataFrame, n: int) -> DataFrame:
    """(patch_id, selection_reason): first ``n`` distinct ids in stage order; fill rows come last."""
    once = staged.groupBy("patch_id").agg(F.min(F.struct("stage", "sort_text", "place", "reason")).alias("s")).select("patch_id", "s.*")
    rest = fill.join(once.select("patch_id"), "patch_id", "left_anti")
    head = once.unionByName(rest).orderBy(*ORDER).limit(n)
    return head.select("patch_id", F.col("reason").alias("selection_reason"))


def representative_samples(rows: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Diverse test samples: classes, extreme errors, pair types, gap groups, districts, then strata.

    Every stage offers its first max(2, n/20) rows whether or not they were
    taken before; the first ``n`` distinct rows in stage order win. Only the
    narrow columns the stages need are materialized, stages are top-k queries,
    and the full rows of the ``n`` winners are fetched at the end.
    """
    per = max(2, int(n) // 20)
    tests = rows.filter(F.col("split") == "test")
    slim = cut_lineage(first_by_key(
        tests.select("patch_id", "pair_id", "change_class", "pair_type", "time_gap_group", "district", fn.prediction_error(rows.columns).alias("__err")),
        ["patch_id"], ["pair_id"],
    ))

    def code(col: str, values, first: int) -> Column:
        chain = F.lit(None).cast("int")
        for i, v in enumerate(values):
            chain = F.when(F.col(col) == v, first + i).otherwise(chain)
        return chain

    district = F.coalesce("district", F.lit(""))
    staged = _by_hash(slim, [
        _offer(code("change_class", fn.CLASS_NAMES, 1), F.concat(F.lit("change_class_"), "change_class"), per),
        _offer(code("pair_type", fn.PAIR_TYPES, 6), F.concat(F.lit("pair_type_"), "pair_type"), per),
        _offer(code("time_gap_group", STAGE_GAPS, 9), F.concat(F.lit("time_gap_group_"), "time_gap_group"), per),
        _offer(14, F.concat(F.lit("district_"), district), 1, district),
    ], per, seed)
    for stage, (reason, best) in zip((4, 5), _extreme(slim, "__err", per).items()):
        staged = staged.unionByName(best.select(
            "patch_id", F.lit(stage).alias("stage"), F.lit("").alias("sort_text"), "place", F.lit(reason).alias("reason")
        ))
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("change_class", "pair_type", "time_gap_group")])
    open_rows = slim.select("patch_id", stratum.alias("sort_text")).join(staged.select("patch_id").distinct(), "patch_id", "left_anti")
    hashed = open_rows.withColumn("__h", fn.hash_key(seed, F.lit("fill"), "patch_id"))
    fill = top_k(hashed, ["sort_text"], ["__h", "patch_id"], int(n), "turn").select(
        "patch_id", (F.col("turn") + 100).alias("stage"), "sort_text", F.lit(0).alias("place"),
        F.lit("stratified_random_fill").alias("reason"),
    )
    chosen = _choose(staged, fill, int(n))
    return first_by_key(tests.join(chosen, "patch_id"), ["patch_id"], ["pair_id"])


def handoff_samples(pred: DataFrame, index: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """Samples to hand over: per class, extreme errors, spread over districts, types and gaps, random fill."""
    per = max(1, int(n) // 12)
    dims = {6: "district", 7: "pair_type", 8: "time_gap_group"}
    used = ("patch_id", "pair_id", "change_class", "abs_error", "y_true_change_ratio", "y_pred_change_ratio", *dims.values())

    def narrow(df: DataFrame, order: str) -> DataFrame:
        return first_by_key(df.select(*dict.fromkeys([c for c in (*used, order) if c in df.columns])), ["patch_id"], [order])

    slim = cut_lineage(left_merge_coalesce(narrow(pred, "pair_id"), narrow(index, "npz_path")))
    class_no = F.nullif(F.array_position(F.array(*[F.lit(c) for c in fn.CLASS_NAMES]), F.col("change_class")), F.lit(0))
    offers = [_offer(class_no, F.concat(F.lit("class_"), "change_class"), min(per, int(n)))]
    present = {stage: c for stage, c in dims.items() if c in slim.columns}
    spread = slim.agg(F.struct(*[F.count_distinct(c).alias(c) for c in present.values()]).alias("s")).scalar()
    counted = slim.withColumn("__values", spread)
    for stage, c in present.items():
        group = F.concat(F.lit(f"diverse_{c}|"), c)
        limit = F.greatest(F.lit(1), F.floor(F.lit(per) / F.greatest(F.lit(1), F.col(f"__values.{c}"))))
        offers.append(_offer(stage, group, limit, group))
    staged = _by_hash(counted, offers, per, seed).withColumn(
        "reason", F.when(F.col("stage") > 5, F.substring_index("reason", "|", 1)).otherwise(F.col("reason"))
    )
    if "abs_error" in slim.columns:
        for stage, (reason, pool) in zip((4, 5), _extreme(slim, "abs_error", per * 2).items()):
            staged = staged.unionByName(_by_hash(pool.drop("place"), [_offer(stage, reason, per)], per, seed))
    # a few rows a stage, read by the choice and by the fill
    staged = stored(staged)
    hashed = slim.select("patch_id", fn.hash_key(seed, F.lit("fill"), "patch_id").alias("sort_text"))
    fill = hashed.join(staged.select("patch_id").distinct(), "patch_id", "left_anti").orderBy("sort_text", "patch_id").limit(int(n)).select(
        "patch_id", F.lit(9).alias("stage"), "sort_text", F.lit(0).alias("place"), F.lit("random_fill").alias("reason")
    )
    chosen = cut_lineage(_choose(staged, fill, int(n)))
    winners = first_by_key(pred.join(chosen, "patch_id"), ["patch_id"], ["pair_id"])
    ids = chosen.select("patch_id")
    return left_merge_coalesce(winners, first_by_key(index.join(ids, "patch_id", "left_semi"), ["patch_id"], ["npz_path"]))


def chosen_predictions(pred: DataFrame, chosen: DataFrame) -> DataFrame:
    return pred.join(chosen.select("patch_id"), "patch_id", "left_semi")


# --- case studies --------------------------------------------------------------------------

def _top_items(rows: DataFrame, name: str, k: int, out: str) -> DataFrame:
    scored = rows.select("patch_id", F.col(name).alias("n"), fn.safe_float("importance", 0.0).alias("v"))
    best = top_k(scored, ["patch_id"], [F.desc("v"), "n"], k, "r")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "n", "v"))), lambda s: F.format_string("%s (%.6f)", F.coalesce(s["n"], F.lit("")), s["v"]))
    return best.groupBy("patch_id").agg(listed.alias(out))


def _paths(rows: DataFrame, columns: list[str], order: str, out: str) -> DataFrame:
    """Distinct non-empty paths per patch, in row order."""
    items = F.posexplode(F.array(*[fn.strip(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    long = rows.select("patch_id", order, items.alias("i", "p")).filter(F.col("p") != "")
    firsts = long.groupBy("patch_id", "p").agg(F.min(F.struct(order, "i")).alias("o"))
    return firsts.groupBy("patch_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda s: s["p"]), "; ").alias(out)
    )


def case_studies(
    selected: DataFrame, ablation: DataFrame, bands: DataFrame, features: DataFrame, occluded: DataFrame, cams: DataFrame,
    order: str = "row_no", max_cases: int | None = 10,
) -> DataFrame:
    """One explained row for each of the first ``max_cases`` selected samples, of all if None.

    The cases are fixed first and everything else is semi-joined to them before
    it is ranked.
    """
    cases = selected if max_cases is None else selected.orderBy(order).limit(max(0, int(max_cases)))
    ids = cases.select("patch_id").distinct()

    def of(df: DataFrame) -> DataFrame:
        return df.join(ids, "patch_id", "left_semi")

    abl = last_by_key(of(ablation), ["patch_id"], ["full_prediction"]).select(
        "patch_id", F.struct("target_change_ratio", "full_prediction", "dominant_modality", "dominant_time_step").alias("m")
    )
    joined = (
        cases.join(abl, "patch_id", "left")
        .join(_top_items(of(bands), "band_name", 3, "bands"), "patch_id", "left")
        .join(_top_items(of(features), "feature_name", 5, "feats"), "patch_id", "left")
        .join(_paths(of(occluded), ["overlay_path", "side_by_side_path"], order, "occlusion_paths"), "patch_id", "left")
        .join(_paths(of(cams), ["overlay_path"], order, "gradcam_paths"), "patch_id", "left")
    )
    true = F.coalesce(fn.safe_float("y_true_change_ratio"), fn.safe_float("m.target_change_ratio"))
    pred = F.coalesce(fn.safe_float("y_pred_change_ratio"), fn.safe_float("m.full_prediction"))
    wide = joined.withColumns({
        "true_change_ratio": true, "predicted_change_ratio": pred, "absolute_error": fn.safe_float("abs_error"),
        "dominant_modality": F.coalesce("m.dominant_modality", F.lit("")),
        "dominant_time_step": F.coalesce("m.dominant_time_step", F.lit("")),
    })
    kind, place = F.coalesce("change_class", F.lit("unknown")), F.coalesce("district", F.lit("unknown district"))
    complete = F.col("true_change_ratio").isNotNull() & F.col("predicted_change_ratio").isNotNull()
    sentences = [
        F.when(complete, F.format_string(
            "For this %s change sample in %s, the model predicted %.3f against a true value of %.3f ",
            kind, place, "predicted_change_ratio", "true_change_ratio",
        )).otherwise(F.format_string("For this %s change sample, the model prediction metadata is incomplete ", kind)),
        F.when(F.col("absolute_error").isNotNull(), F.format_string("with absolute error %.3f. ", "absolute_error")).otherwise(". "),
        F.when(F.col("dominant_modality") != "", F.format_string("The ablation results suggest the %s modality was more influential. ", "dominant_modality")),
        F.when(F.col("dominant_time_step") != "", F.format_string("The %s image contributed more strongly in the temporal comparison. ", "dominant_time_step")),
        F.when(F.col("bands").isNotNull(), F.format_string("Top image bands were %s. ", F.array_join(F.slice("bands", 1, 3), ", "))),
        F.when(F.col("feats").isNotNull(), F.format_string("Top tabular drivers were %s.", F.array_join(F.slice("feats", 1, 3), ", "))),
    ]
    text = F.concat(*[F.coalesce(s, F.lit("")) for s in sentences])
    return wide.select(
        order, "patch_id", "district", "pair_id", "true_change_ratio", "predicted_change_ratio", "absolute_error",
        "dominant_modality", "dominant_time_step",
        F.coalesce(F.array_join("bands", "; "), F.lit("")).alias("top_bands"),
        F.coalesce(F.array_join("feats", "; "), F.lit("")).alias("top_tabular_features"),
        F.coalesce("occlusion_paths", F.lit("")).alias("occlusion_paths"),
        F.coalesce("gradcam_paths", F.lit("")).alias("gradcam_paths"), text.alias("plain_english_explanation"),
    )
