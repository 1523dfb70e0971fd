"""Class-balanced selection of labeled patches under pair, district and total caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as fn
from ..session import cut_lineage
from .ranking import even_sample, first_by_key, hash_positions

# Caps per pair by class, high-to-rest ratio, district share.
PAIR_CAPS = {"low": 50, "medium": 40, "high": 20}
HIGH_RATIO = 1.30
DISTRICT_FLOOR, DISTRICT_SHARE = 300, 0.08


def valid_condition() -> Column:
    """Plain conjuncts, so that a filter on status and class reaches the scan."""
    return (
        (F.col("label_status") == "success") & F.col("change_class").isin(*fn.CLASS_NAMES)
        & fn.is_finite(F.col("change_ratio").try_cast("double"))
    )


def valid_labels(df: DataFrame) -> DataFrame:
    """Successful rows with a finite ratio and a real class."""
    return df.filter(valid_condition())


def _tag(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("selection_stage", F.concat(F.col("selection_stage"), F.lit("|" + text)))


def class_pair_cap(df: DataFrame, caps: dict[str, int] = PAIR_CAPS, seed: int = 42) -> DataFrame:
    """Even sample per (split, class, pair) up to the class cap, for all splits and classes at once.

    ``class_sampling_weight`` is the kept share of the (split, class). It is
    computed from group sizes, min(size, cap), without counting the sample.
    """
    cap = fn.lookup(F.col("change_class"), caps)
    rows = df.filter(F.col("change_class").isin(*caps)).withColumn("__cap", cap)
    group = ["split", "change_class", "pair_id"]
    sizes = rows.groupBy(*group, "__cap").agg(F.count(F.lit(1)).alias("n"))
    weights = sizes.groupBy("split", "change_class").agg(
        (F.sum(F.least("n", "__cap")) / F.greatest(F.lit(1), F.sum("n"))).alias("class_sampling_weight")
    )
    sampled = even_sample(rows, group, F.col("__cap"), seed)
    # one entry a split and class: a scalar beside the rows, which are not shuffled for it
    entry = F.struct(F.struct("split", "change_class").alias("key"), F.col("class_sampling_weight").alias("value"))
    shares = weights.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
    weighed = sampled.withColumn("__shares", shares).withColumn(
        "class_sampling_weight", F.try_element_at("__shares", F.struct("split", "change_class"))
    ).drop("__shares")
    return weighed.withColumn(
        "selection_stage", F.concat(F.col("change_class"), F.lit("_pair_cap_"), F.col("__cap").cast("string"))
    ).drop("__cap")


def high_district_cap(df: DataFrame, target, seed: int = 42) -> DataFrame:
    """Even sample per (split, district) up to max(300, round-half-even(8 % of target)).

    ``target`` is a number or a column; a target of 0 or less keeps nothing.
    """
    goal = target if isinstance(target, Column) else F.lit(int(target))
    cap = F.greatest(F.lit(DISTRICT_FLOOR), F.bround(goal * DISTRICT_SHARE).cast("int"))
    rows = df.filter(goal > 0).withColumn("__cap", cap)
    group = ["split", "district"] if "split" in df.columns else ["district"]
    return _tag(even_sample(rows, group, F.col("__cap"), seed, crowded=True).drop("__cap"), "high_district_soft_cap")


def high_targets(low_medium: DataFrame, targets: dict[str, int]) -> DataFrame:
    """(split, high_target): 1.3 × kept low and medium rows, bounded by what the
    split's target leaves, but only where it leaves something."""
    counted = low_medium.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    splits = F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.lit(int(t)).alias("target")) for s, t in targets.items()
    ]))
    goals = low_medium.sparkSession.range(1).select(splits.alias("t")).select("t.*").join(counted, "split", "left")
    n = F.coalesce("n", F.lit(0))
    wanted = F.bround(n * HIGH_RATIO).cast("long")
    rest = F.greatest(F.lit(0), F.col("target") - n)
    return goals.select("split", F.when(rest > 0, F.least(wanted, rest)).otherwise(wanted).alias("high_target"))


def balanced_selection(df: DataFrame, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """Low and medium rows under their pair caps; high rows capped by pair, district and total.

    All splits go through each stage together. The capped rows are
    materialized, because three later stages read them. What is joined by split
    has one row for each entry of ``targets``.
    """
    capped = cut_lineage(class_pair_cap(df.filter(F.col("split").isin(*targets)), seed=seed))
    rest = capped.filter(F.col("change_class") != "high")
    goals = high_targets(rest, targets)
    high = capped.filter(F.col("change_class") == "high").join(F.broadcast(goals), "split")
    spread = cut_lineage(high_district_cap(high, F.col("high_target"), seed))
    over = spread.groupBy("split").agg((F.count(F.lit(1)) > F.max("high_target")).alias("__over"))
    final = even_sample(spread.join(F.broadcast(over), "split"), ["split"], F.col("high_target"), seed, crowded=True)
    tagged = final.withColumn("selection_stage", F.when(
        F.col("__over"), F.concat("selection_stage", F.lit("|high_target_cap"))
    ).otherwise(F.col("selection_stage")))
    return rest.unionByName(tagged.drop("high_target", "__over"))


def final_selection(df: DataFrame, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """Valid labels, balanced per split, one row per patch id."""
    chosen = _tag(balanced_selection(valid_labels(df), targets, seed), "pair_type_checked")
    return first_by_key(chosen, ["patch_id"], ["split", "selection_stage", "pair_id"]).withColumn("final_selected", F.lit(True))


def pair_cap(df: DataFrame, cap: int = 30, seed: int = 42) -> DataFrame:
    """Even sample per pair."""
    return _tag(even_sample(df, ["pair_id"], cap, seed), "pair_diversity")


def district_cap(df: DataFrame, cap: int | None = None, seed: int = 42) -> DataFrame:
    """First ``cap`` rows per district in hash order."""
    if cap is None:
        return df
    placed = hash_positions(df, ["district"], seed, "patch_id", "__pos")
    return _tag(placed.filter(F.col("__pos") < cap).drop("__pos"), "district_diversity")


def removed_rows(original: DataFrame, final: DataFrame) -> DataFrame:
    return original.join(final.select("patch_id").distinct(), "patch_id", "left_anti")


def selection_faults(final: DataFrame) -> DataFrame:
    """(metric, value): repeated ids, bad status, bad class and missing ratios."""
    ids = final.groupBy("patch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.coalesce(F.col("label_status") != "success", F.lit(True)), 1)).alias("s"),
        F.count(F.when(F.coalesce(~F.col("change_class").isin(*fn.CLASS_NAMES), F.lit(True)), 1)).alias("c"),
        F.count(F.when(fn.not_nan("change_ratio").isNull(), 1)).alias("r"),
    )
    names = {
        "duplicate_patch_ids": F.sum(F.col("n") - 1), "non_success_status": F.sum("s"), "invalid_change_class": F.sum("c"),
        "missing_change_ratio": F.sum("r"),
    }
    row = ids.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in names.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in names])))


def check_selection(final: DataFrame) -> None:
    faults = {r["metric"]: r["value"] for r in selection_faults(final).collect() if r["value"]}
    if faults:
        raise ValueError(f"final selection is not valid: {faults}")
