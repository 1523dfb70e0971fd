"""Seasons, time indexes and pair kinds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import SEASONS, as_col

# Pair kinds and gap groups.
PAIR_TYPES = ("same_season_multiyear", "cross_season_sameyear", "cross_season_multiyear")
GAP_GROUPS = ("same_year", "short", "medium", "long", "very_long", "other")


def season_order(season) -> Column:
    chain = F.lit(None).cast("int")
    for i, name in enumerate(SEASONS):
        chain = F.when(as_col(season) == name, i).otherwise(chain)
    return chain


def season_of(year, month) -> Column:
    """``struct(season_year, season)``; December belongs to next year's winter."""
    y, m = as_col(year), as_col(month)
    season = (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.between(3, 5), "PreMonsoon")
        .when(m.between(6, 9), "Monsoon")
        .when(m.between(10, 11), "PostMonsoon")
    )
    season_year = F.when(season.isNotNull(), y + F.when(m == 12, 1).otherwise(0))
    return F.struct(season_year.cast("int").alias("season_year"), season.alias("season"))


def time_index(year, season) -> Column:
    """Quarter-like counter, null for an unknown season."""
    return as_col(year).cast("int") * 4 + season_order(season)


def time_gap_group(gap_years) -> Column:
    gap = as_col(gap_years)
    return (
        F.when(gap == 0, "same_year")
        .when(gap == 1, "short")
        .when(gap.between(2, 3), "medium")
        .when(gap.between(4, 6), "long")
        .when(gap.between(7, 9), "very_long")
        .otherwise("other")
    )


def pair_type(year1, season1, year2, season2) -> Column:
    y1, s1, y2, s2 = (as_col(c) for c in (year1, season1, year2, season2))
    same = s1 == s2
    return (
        F.when(same & (y2 > y1), "same_season_multiyear")
        .when(~same & (y2 == y1), "cross_season_sameyear")
        .when(~same & (y2 > y1), "cross_season_multiyear")
    )
