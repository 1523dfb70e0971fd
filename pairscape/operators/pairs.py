"""Forward-time image pairs, their reuse-limited selection, and usage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import functions as fn
from ..session import cut_lineage, stored
from .greedy import capped_selection
from .ranking import first_by_key, hash_positions

# Shares of the pair types in a selection, the default seed and limits.
TYPE_SHARES = {
    "same_season_multiyear": 0.40,
    "cross_season_sameyear": 0.20,
    "cross_season_multiyear": 0.40,
}
PATHS = ("sentinel_path", "dw_path")


#: Images of a (split, district) that meet the others of theirs in one task, about.
PLACE_IMAGES = 2048


def forward_pairs(images: DataFrame) -> DataFrame:
    """Every pair of images of one split and district with a later second time.

    Images are shuffled, pairs are not: a place (split and district) joins itself
    in the task it lies in. A place of more than ``PLACE_IMAGES`` images is cut
    into parts, each of which meets all images of the place in a task of its own.

    Equal ids are numbered in the order of split and both images. An id says its
    district, years and seasons, so the number of a pair follows from the places
    of its images among those of their slots (split, district, year and season).
    """
    timed = images.withColumns({
        "season_order": fn.season_order("season"),
        "time_index": fn.time_index("year", "season"),
    })
    place = ["split", "district"]
    fields = ["image_id", "year", "season", "season_order", *[p for p in PATHS if p in images.columns]]
    known = timed.select(*place, "time_index", *fields).dropna(subset=[*place, "time_index"])
    year = F.col("year").cast("string")
    slot = [*place, year, "season"]
    rows = F.count(F.lit(1))
    counted = known.repartition("district").withColumns({
        "__in_place": rows.over(Window.partitionBy(*place)),
        "__at": F.row_number().over(Window.partitionBy(*place).orderBy(year, "season", "image_id")),
        "__n": rows.over(Window.partitionBy(*slot)),
        "__less": F.rank().over(Window.partitionBy(*slot).orderBy("image_id")) - 1,
        "__same": rows.over(Window.partitionBy(*slot, "image_id")),
        "__k": F.row_number().over(Window.partitionBy(*slot, "image_id").orderBy("image_id")) - 1,
    })
    # the slot's images in every split, if there are several splits
    shared = F.collect_set(F.struct("split", "__n")).over(Window.partitionBy("district", year, "season"))
    marks = ["__n", "__less", "__same", "__k", "__splits"]
    placed = counted.withColumn("__splits", F.when(F.size(shared) > 1, shared)).withColumn(
        "__parts", F.ceil(F.col("__in_place") / PLACE_IMAGES).cast("int")
    )

    def side(t: str, part: Column) -> DataFrame:
        renamed = [F.col(c).alias(f"{c}_{t}") for c in ("time_index", *fields, *marks)]
        return placed.select(*place, part.alias("__part"), *renamed).repartition(*place, "__part")

    first = side("t1", (F.col("__at") % F.col("__parts")).cast("int"))
    second = side("t2", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    joined = first.join(second, [*place, "__part"]).filter(F.col("time_index_t2") > F.col("time_index_t1"))
    same = F.col("season_t1") == F.col("season_t2")
    earlier = F.filter("__splits_t1", lambda a: a["split"] < F.col("split"))
    before = F.aggregate(earlier, F.lit(0).cast("long"), lambda acc, a: F.aggregate(
        F.filter("__splits_t2", lambda b: b["split"] == a["split"]), acc, lambda n, b: n + a["__n"] * b["__n"]
    ))
    number = (
        F.coalesce(before, F.lit(0)) + F.col("__less_t1") * F.col("__n_t2") + F.col("__same_t1") * F.col("__less_t2")
        + F.col("__k_t1") * F.col("__same_t2") + F.col("__k_t2") + 1
    )
    pair = fn.pair_id("district", "year_t1", "season_t1", "year_t2", "season_t2")
    out = joined.withColumns({
        "pair_id": F.when(number > 1, F.concat_ws("_", pair, number.cast("string"))).otherwise(pair),
        "time_gap_years": F.col("year_t2") - F.col("year_t1"),
        "season_gap": F.col("season_order_t2") - F.col("season_order_t1"),
        "same_season": same,
        "cross_season": ~same,
        "pair_type": fn.pair_type("year_t1", "season_t1", "year_t2", "season_t2"),
    }).filter(F.col("pair_type").isNotNull())
    ends = [f"{c}_{t}" for t in ("t1", "t2") for c in fields]
    return out.select(
        *place, "time_index_t2", "time_index_t1", *ends,
        "pair_id", "time_gap_years", "season_gap", "same_season", "cross_season", "pair_type",
    )


def prepare_candidates(pairs: DataFrame) -> DataFrame:
    """First row per pair id, no self-pairs, gap group added."""
    return _cleaned(pairs.withColumn("time_gap_group", fn.time_gap_group("time_gap_years")))


def _cleaned(pairs: DataFrame) -> DataFrame:
    one = first_by_key(pairs, ["pair_id"], ["image_id_t1", "image_id_t2"])
    return one.filter(F.col("image_id_t1") != F.col("image_id_t2"))


def type_quotas(target: int, shares: dict[str, float] = TYPE_SHARES) -> dict[str, int]:
    """Whole-number quota per type; what rounding leaves over goes to the largest share."""
    quotas = {t: int(round(target * s)) for t, s in shares.items()}
    quotas[max(shares, key=shares.get)] += target - sum(quotas.values())
    return quotas


def pair_priority(pairs: DataFrame, targets: dict[str, int], seed: int, shares=TYPE_SHARES, first: float | None = None) -> DataFrame:
    """Static turn order of the candidates of each split.

    Only splits that ``targets`` names have a turn. Inside a type the gap groups take turns (hash rank in the gap group, then
    the group's name); across types the one with the lowest filled share goes
    first. The rank inside a type follows from the sizes of its gap groups by
    arithmetic, so only the hash rank needs a shuffle.

    ``first`` asks for the beginning of the order alone, as far as about so many
    candidates of each gap group, as a share of the split's target, reach: only the
    least hashes are ranked then, and what comes behind a row that was not is left out.
    """
    cell = ["split", "pair_type", "time_gap_group"]
    cells = pairs.filter(F.col("split").isin(*targets)).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("split", "pair_type").agg(
        F.collect_list(F.struct("time_gap_group", "n")).alias("__gaps")  # at most six entries
    )

    def placed(ranked: DataFrame) -> DataFrame:
        # one row for each split and type
        joined = ranked.join(F.broadcast(sizes), ["split", "pair_type"])
        before = F.aggregate(
            "__gaps", F.lit(0).cast("bigint"),
            lambda acc, g: acc + F.least(g["n"], F.col("__r"))
            + ((g["time_gap_group"] < F.col("time_gap_group")) & (g["n"] > F.col("__r"))).cast("bigint"),
        )
        quota = F.lit(None).cast("int")
        for split, target in targets.items():
            for kind, q in type_quotas(target, shares).items():
                here = (F.col("split") == split) & (F.col("pair_type") == kind)
                quota = F.when(here, q).otherwise(quota)
        share = (before + 1) / F.greatest(F.lit(1), F.coalesce(quota, F.lit(0)))
        return joined.withColumns({"type_quota": F.coalesce(quota, F.lit(0)), "priority": share}).drop("__gaps")

    if first is None:
        return placed(hash_positions(pairs, cell, seed, "pair_id", "__r", "__size")).drop("__r", "__size")
    wanted = F.ceil(F.lit(first) * by_split(targets))
    low = pairs.join(F.broadcast(cells), cell).filter(below(fn.hash_key(seed, "pair_id"), wanted, F.col("n"))).drop("n")
    ranked = placed(hash_positions(low, cell, seed, "pair_id", "__r", "__size")).drop("__r", "__size")
    # the first turn that a gap group would have had without the hashes that were left out; types without quota have none
    kept = low.groupBy(*cell).agg(F.count(F.lit(1)).alias("__kept"))
    open_ = cells.join(F.broadcast(kept), cell, "left").withColumn("__r", F.coalesce("__kept", F.lit(0))).filter(F.col("__r") < F.col("n"))
    limits = placed(open_).filter(F.col("type_quota") > 0).groupBy("split").agg(F.min("priority").alias("__limit"))
    return ranked.join(F.broadcast(limits), "split", "left").filter(
        F.col("__limit").isNull() | (F.col("priority") < F.col("__limit"))
    ).drop("__limit")


def by_split(values: dict[str, int]) -> Column:
    """The entry of ``values`` for the row's split, else 0."""
    out = F.lit(0)
    for split, n in values.items():
        out = F.when(F.col("split") == split, n).otherwise(out)
    return out


def below(hash_: Column, wanted: Column, n: Column) -> Column:
    """Is a hexadecimal hash among the least ones, of which ``n`` evenly spread hashes have about ``wanted``?"""
    bound = F.lower(F.lpad(F.hex(F.floor(wanted / n * 2**32).cast("bigint")), 8, "0"))
    return (n <= wanted) | (F.left(hash_, F.lit(8)) < bound)


def _counts(rows: DataFrame, *by: str) -> dict:
    """Numbers of rows by a few values of ``by``."""
    return {(r[0] if len(by) == 1 else tuple(r[:-1])): r["n"] for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()}


#: What a selection looks at first, as a share of the split's target: candidates of each gap group, and of a split in the backfill.
FIRST_OF_CELL, FIRST_OF_SPLIT = 0.5, 4


def _select(pairs: DataFrame, targets: dict[str, int], reuse: int, seed: int, shares) -> DataFrame:
    """One selection run: quotas first, then backfill without type quotas.

    The choice from the beginning of an order is the beginning of the whole
    choice. So a run looks at the beginning alone, and at all candidates only if
    something is left that they could fill.
    """
    here = {s: targets[s] for s in targets if targets[s] > 0}
    image = [(F.concat_ws("|", F.lit("image"), "split", c), F.lit(reuse)) for c in ("image_id_t1", "image_id_t2")]
    whole = (F.concat_ws("|", F.lit("split"), "split"), F.col("split_target"))
    typed = (F.concat_ws("|", F.lit("type"), "split", "pair_type"), F.col("type_quota"))
    number = _counts(pairs, "split", "pair_type")

    for share in (FIRST_OF_CELL, None):
        base = stored(pair_priority(pairs, here, seed, shares, share).withColumn("split_target", by_split(here)))
        first = stored(capped_selection(base, "pair_id", ["priority", "pair_type", "pair_id"], [*image, typed, whole], total=3))
        seen, used = _counts(base, "split", "pair_type"), _counts(first, "split", "pair_type")
        filled = {s: sum(n for (split, _), n in used.items() if split == s) for s in here}
        if all(
            seen.get((s, kind), 0) == n or filled[s] >= here[s] or used.get((s, kind), 0) >= type_quotas(here[s], shares).get(kind, 0)
            for (s, kind), n in number.items()
        ):
            break
    first = first.withColumn(
        "selected_reason", F.concat_ws("_", F.lit("target"), "pair_type", "time_gap_group")
    ).drop("type_quota", "priority")
    taken = first.groupBy(F.concat_ws("|", F.lit("split"), "split").alias("resource")).agg(
        F.count(F.lit(1)).alias("used"), F.max("split_target").alias("cap")
    )
    spent = first.select(F.explode(F.array("image_id_t1", "image_id_t2")).alias("image"), "split")
    spent = spent.groupBy(F.concat_ws("|", F.lit("image"), "split", "image").alias("resource")).agg(
        F.count(F.lit(1)).alias("used"), F.lit(reuse).alias("cap")
    )
    available = {s: sum(n for (split, _), n in number.items() if split == s) for s in here}
    chosen, short = first, [s for s in here if filled[s] < min(here[s], available[s])]
    if short:
        rest = pairs.filter(F.col("split").isin(*short)).join(first.select("pair_id"), "pair_id", "left_anti")
        rest = rest.withColumns({"split_target": by_split(here), "__h": fn.hash_key(seed + 1, "pair_id")})
        for share in (FIRST_OF_SPLIT, None):
            some = rest if share is None else rest.filter(below(F.col("__h"), share * by_split(here), by_split(available)))
            some = stored(some)
            fill = stored(capped_selection(some, "pair_id", ["__h", "pair_id"], [*image, whole], spent.unionByName(taken), total=2))
            seen, more = _counts(some, "split"), _counts(fill, "split")
            if all(filled[s] + more.get(s, 0) >= here[s] or seen.get(s, 0) == available[s] - filled[s] for s in short):
                break
        chosen = first.unionByName(fill.drop("__h").withColumn("selected_reason", F.lit("backfill_reuse_limited")))
    keys = stored(chosen.drop("split_target"))
    usage = image_use(keys)
    for t in ("t1", "t2"):
        side = usage.select("split", F.col("image_id").alias(f"image_id_{t}"), F.col("uses").alias(f"image_use_count_{t}"))
        keys = keys.join(side, ["split", f"image_id_{t}"])
    return stored(keys.withColumn("max_image_use_used", F.lit(reuse)))


#: What a choice reads of a candidate.
KEYS = ["pair_id", "split", "pair_type", "time_gap_group", "image_id_t1", "image_id_t2"]
#: A choice of at most so many pairs is a broadcast.
BROADCAST_PAIRS = 100_000


def constrained_pairs(
    pairs: DataFrame, targets: dict[str, int], reuse: int = 3, fallback: int = 5, seed: int = 42,
    shares: dict[str, float] = TYPE_SHARES,
) -> DataFrame:
    """Select pairs per split with type quotas, gap rotation and an image reuse limit.

    A split that stays below min(target, available) is tried again with the
    fallback limit, and that run is kept if it found more. Turn order is static
    (see ``pair_priority``); the guarantees are: no image above the limit, no
    type above its quota before backfill, targets never exceeded, and no
    further pair could be added.

    The choice works on ``KEYS``, written once; the other columns of ``pairs``
    are read again for the chosen pairs.
    """
    wanted = [s for s, n in targets.items() if n > 0]
    grouped = pairs.withColumn("time_gap_group", fn.time_gap_group("time_gap_years"))
    clean = stored(_cleaned(grouped.select(*KEYS)).filter(F.col("split").isin(*wanted) & F.col("pair_type").isNotNull()))
    available = _counts(clean, "split")
    chosen = _select(clean, targets, reuse, seed, shares)
    got = _counts(chosen, "split")
    short = [s for s in available if got.get(s, 0) < min(targets[s], available[s])]
    chosen = chosen.withColumn("fallback_max_image_use_used", F.lit(False))
    if short:
        again = _select(clean.filter(F.col("split").isin(*short)), {s: targets[s] for s in short}, fallback, seed, shares)
        more = _counts(again, "split")
        relaxed = [s for s in short if more.get(s, 0) > got.get(s, 0)]
        if relaxed:
            chosen = chosen.filter(~F.col("split").isin(*relaxed)).unionByName(
                again.filter(F.col("split").isin(*relaxed)).withColumn("fallback_max_image_use_used", F.lit(True))
            )
    marks = ["selected_reason", "image_use_count_t1", "image_use_count_t2", "max_image_use_used", "fallback_max_image_use_used"]
    side = chosen.select(*KEYS, *marks)
    joined = grouped.join(F.broadcast(side) if sum(targets.values()) <= BROADCAST_PAIRS else side, KEYS)
    rest = [c for c in grouped.columns if c != "pair_id"]
    return cut_lineage(first_by_key(joined, ["pair_id"], ["image_id_t1", "image_id_t2"]).select("pair_id", *rest, *marks))


def coverage_warnings(selected: DataFrame, splits=("train", "val", "test")) -> DataFrame:
    """(split, kind, value): expected pair types and multi-year gap groups a split lacks."""
    expected = [("pair_type", t) for t in fn.PAIR_TYPES] + [
        ("time_gap_group", g) for g in ("short", "medium", "long", "very_long")
    ]
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.lit(k).alias("kind"), F.lit(v).alias("value"))
        for s in splits for k, v in expected
    ]))
    wanted = selected.sparkSession.range(1).select(rows.alias("r")).select("r.*")
    multiyear = F.col("pair_type").isin("same_season_multiyear", "cross_season_multiyear")
    seen = selected.select("split", F.inline(F.array(
        F.struct(F.lit("pair_type").alias("kind"), F.col("pair_type").alias("value")),
        F.struct(F.lit("time_gap_group").alias("kind"), F.when(multiyear, F.col("time_gap_group")).alias("value")),
    ))).distinct()
    return wanted.join(seen, ["split", "kind", "value"], "left_anti")


def image_use(pairs: DataFrame) -> DataFrame:
    """Uses of every image over both endpoints, per split."""
    ids = pairs.select("split", F.explode(F.array("image_id_t1", "image_id_t2")).alias("image_id"))
    return ids.groupBy("split", "image_id").agg(F.count(F.lit(1)).alias("uses"))


def image_usage(pairs: DataFrame) -> DataFrame:
    """Long report: unique images, largest and mean use, and the use distribution."""
    ids = pairs.select(F.explode(F.array("image_id_t1", "image_id_t2")).alias("image_id")).dropna()
    spread = ids.groupBy("image_id").agg(F.count(F.lit(1)).alias("uses")).groupBy("uses").agg(F.count(F.lit(1)).alias("images"))
    total = F.sum("images")
    metrics = spread.agg(F.array(
        F.struct(F.lit("unique_images").alias("value"), F.coalesce(total, F.lit(0)).cast("double").alias("count")),
        F.struct(F.lit("max_image_reuse").alias("value"), F.coalesce(F.max("uses"), F.lit(0)).cast("double").alias("count")),
        F.struct(F.lit("mean_image_reuse").alias("value"),
                 F.coalesce(F.sum(F.col("uses") * F.col("images")) / total, F.lit(0.0)).alias("count")),
    ).alias("m")).select(F.lit("metric").alias("summary_type"), F.inline("m"))
    rows = spread.select(
        F.lit("image_reuse_distribution").alias("summary_type"), F.col("uses").cast("string").alias("value"),
        F.col("images").cast("double").alias("count"),
    )
    return metrics.unionByName(rows)

