"""District-level train/val/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import hash_positions

SPLITS = ("train", "val", "test")


def split_districts(
    df: DataFrame, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42
) -> DataFrame:
    """(district, split): whole districts in seeded hash order; train first, then val, then test.

    Val and test take max(1, round-half-even(n·ratio)) districts, train the
    rest. Fewer than three districts or an empty train set stops the job.
    """
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("split ratios must add up to 1")
    names = df.select(F.col("district").cast("string")).dropna().distinct().withColumn("__all", F.lit(1))
    placed = hash_positions(names, ["__all"], seed, "district", "__pos", "__n")
    n = F.col("__n")
    val = F.greatest(F.lit(1), F.bround(n * ratios[1]).cast("long"))
    test = F.greatest(F.lit(1), F.bround(n * ratios[2]).cast("long"))
    train = n - val - test
    split = (
        F.when((n < 3) | (train < 1), F.raise_error(F.lit("too few districts for a train/val/test split")).cast("string"))
        .when(F.col("__pos") < train, "train").when(F.col("__pos") < train + val, "val").otherwise("test")
    )
    return placed.select("district", split.alias("split"))


def assign_split(df: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned rows, rows without a district or without an assignment)."""
    joined = df.drop("split").join(split.select("district", "split"), "district", "left")
    return joined.filter(F.col("split").isNotNull()), joined.filter(F.col("split").isNull())


def split_integrity(df: DataFrame) -> DataFrame:
    """District and image counts per split, and the faults that make a split unusable."""
    per_district = df.groupBy("district", "split").agg(F.count(F.lit(1)).alias("n"))
    faults = per_district.groupBy("district").agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS],
        F.sum(F.when(F.col("split").isNull(), F.col("n")).otherwise(0)).alias("null_split"),
        F.sum(F.when(~F.col("split").isin(*SPLITS), F.col("n")).otherwise(0)).alias("bad_split"),
        *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"{s}_images") for s in SPLITS],
    )
    named = F.col("district").isNotNull()
    several = sum((F.coalesce(F.col(s), F.lit(0)) for s in SPLITS), F.lit(0)) > 1
    return faults.agg(
        *[F.sum(F.when(named, F.coalesce(F.col(s), F.lit(0))).otherwise(0)).alias(f"{s}_district_count") for s in SPLITS],
        *[F.sum(f"{s}_images").alias(f"{s}_image_count") for s in SPLITS],
        F.sum((named & several).cast("int")).alias("overlap_count"),
        F.sum("null_split").alias("null_split_count"),
        F.sum("bad_split").alias("unknown_split_count"),
    )


def check_split(df: DataFrame) -> None:
    """Raise when a split value is missing or unknown, or a district is in two splits."""
    row = split_integrity(df).first()
    faults = {k: row[k] for k in ("overlap_count", "null_split_count", "unknown_split_count") if row[k]}
    if faults:
        raise ValueError(f"split is not usable: {faults}")


