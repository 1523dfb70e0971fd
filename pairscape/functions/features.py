"""Column names of the monthly table: detection, roles and keyword groups."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import as_col

# Accepted key column names and the keyword tables.
KEY_CANDIDATES = {
    "district": ("district", "district_name", "dist_name", "name", "adm2", "admin2"),
    "year": ("year", "yr"),
    "month": ("month", "mon", "month_id", "month_number"),
}
COUNT_WORDS = ("count", "cyclone", "flood", "drought", "event", "disaster", "storm")
GROUP_WORDS = {
    "temperature": ("temp", "dewpoint", "heat"),
    "humidity_rainfall": ("humidity", "rain", "precip"),
    "water_soil": ("water", "soil", "runoff", "flood"),
    "agriculture": ("crop", "rice", "irrigation", "cropping"),
    "terrain": ("elevation", "slope"),
    "coastal_distance": ("coast", "distance"),
    "population_settlement": ("population", "nightlight", "built", "urban"),
    "time": ("time_gap", "year", "season"),
    "ratio_change": ("_diff", "_ratio"),
}
TEMPORAL_PREFIXES = ("season_t1_", "season_t2_", "pair_type_", "time_gap_group_")
CATEGORY_WORDS = {
    "static_geographic": ("district_area", "distance_to_coast", "elevation", "slope"),
    "agricultural": ("crop", "rice", "irrigation", "cropping"),
    "demographic": ("population", "household"),
    "environmental_dynamic": (
        "temp", "dewpoint", "humidity", "rainfall", "wind", "runoff", "soil_water",
        "cyclone", "drought", "flood", "storm", "disaster",
    ),
}
STATIC_BASES = ("district_area", "distance_to_coast", "slope", "population")
STATIC_SUFFIXES = ("_diff", "_ratio", "_mean_between", "_sum_between")
LEAKAGE_WORDS = (
    "change_ratio", "change_class", "split", "patch_id", "pair_id", "target", "label",
    "prediction", "y_true", "y_pred",
)


def standardize_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[standardize_name(c) for c in df.columns])


def detect_keys(df: DataFrame) -> dict[str, str]:
    """The one district, year and month column; none or several is an error."""
    found = {}
    for label, names in KEY_CANDIDATES.items():
        hits = [c for c in df.columns if c in names]
        if not hits:
            raise ValueError(f"no {label} column; expected one of {sorted(names)}")
        if len(hits) > 1:
            raise ValueError(f"several {label} columns: {hits}")
        found[label] = hits[0]
    return found


def check_columns(df: DataFrame, required, strict: bool = True) -> list[str]:
    """Required names the table lacks; an error, or with ``strict=False`` a warning."""
    missing = sorted(set(required) - set(df.columns))
    if missing and strict:
        raise ValueError(f"missing required columns: {missing}")
    if missing:
        warnings.warn(f"missing columns: {missing}", stacklevel=2)
    return missing


def numeric_features(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in table order; booleans do not count as numbers."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def count_features(names) -> list[str]:
    return [n for n in names if any(w in n.lower() for w in COUNT_WORDS)]


def _has_word(text: Column, words) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def _first_hit(text: Column, table: dict, start: Column | None = None) -> Column:
    chain = start
    for label, words in table.items():
        hit = _has_word(text, words)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def feature_group(col) -> Column:
    """Broad theme of a feature name, first keyword table that matches."""
    return _first_hit(F.lower(as_col(col)), GROUP_WORDS).otherwise("other")


def feature_category(col) -> Column:
    name = F.lower(as_col(col))
    temporal = (name == "time_gap_years") | name.rlike("^(" + "|".join(TEMPORAL_PREFIXES) + ")")
    start = F.when(name.endswith("_missing"), "missing_flags").when(temporal, "temporal_metadata")
    return _first_hit(name, CATEGORY_WORDS, start).otherwise("unknown")
