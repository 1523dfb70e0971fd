"""Names, identifiers and text clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# The accepted raster names, seasons, months and null markers.
SEASONS = ("Winter", "PreMonsoon", "Monsoon", "PostMonsoon")
SENSOR_ALIASES = {
    "s2": "S2",
    "sentinel": "Sentinel",
    "sentinel2": "Sentinel2",
    "dw": "DW",
    "dynamicworld": "DynamicWorld",
}
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
FIRST_YEAR, LAST_YEAR = 2016, 2025
NULL_WORDS = ("", "None", "none", "NULL", "null", "NaN", "nan")
UNSAFE_FILE_CHARS = '<>:"/\\|?*'

MSG_EXTENSION = "Invalid extension '%s'. Expected .tif or .tiff."
MSG_FORMAT = "Filename must follow {sensor}_{resolution}_{year}_{season}_{district}.tif format."
MSG_FORMAT_CLASSES = (
    "Filename must follow DW_allclasses_{resolution}_{year}_{season}_{district}.tif format."
)
MSG_SENSOR = (
    "Invalid sensor '%s'. Expected one of: DW, DynamicWorld, S2, Sentinel, Sentinel2."
)
MSG_YEAR_TEXT = "Invalid year '%s'. Expected a four-digit year."
MSG_YEAR = "Invalid year. Expected a year from 2016 to 2025."
MSG_SEASON = "Invalid season. Expected one of: Winter, PreMonsoon, Monsoon, PostMonsoon."
MSG_DISTRICT = "District name is missing."


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(key: Column, table: dict) -> Column:
    """Value of ``key`` in a small constant table, null when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def strip(col) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_col(col), r"^\s+|\s+$", "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def title_case(col) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` only looks at blanks: it leaves ``a-b`` as ``A-b``.
    """
    runs = F.regexp_extract_all(as_col(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(
        runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    )
    return F.array_join(cased, "")


def _underscored(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"\s+", " ")
    joined = F.replace(title_case(spaced), F.lit(" "), F.lit("_"))
    return F.regexp_replace(F.regexp_replace(joined, "_+", "_"), "^_|_$", "")


def normalize_district(col, tabular: bool = False) -> Column:
    """``coxs bazar`` → ``Coxs_Bazar``; the tabular form drops ``'`` and maps empty to null."""
    text = F.replace(strip(col), F.lit("_"), F.lit(" "))
    if not tabular:
        return _underscored(text)
    text = F.replace(text, F.lit("'"), F.lit(""))
    collapsed = F.regexp_replace(text, r"\s+", " ")
    return F.when(collapsed != "", _underscored(text))


def district_join_key(col) -> Column:
    """Letters and digits only, lower case; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(as_col(col)), "[^a-z0-9]+", ""), F.lit(""))


def normalize_season(col) -> Column:
    """Canonical season name, null when the text names no season.

    A canonical name passes without touching a pattern.
    """
    compact = F.regexp_replace(F.lower(strip(col)), "[ _]+", "")
    return F.when(as_col(col).isin(*SEASONS), as_col(col)).otherwise(
        lookup(compact, {s.lower(): s for s in SEASONS})
    )


def normalize_month(col) -> Column:
    """Month number from ``3``, ``03``, ``3.0``, ``March`` or ``mar``; otherwise null."""
    text = strip(as_col(col).cast("string"))
    number = F.when(text.rlike(r"^\d+(\.0+)?$"), text.try_cast("double"))
    month = F.when(number.between(1, 12), number.cast("int"))
    return F.coalesce(month, lookup(F.lower(text), MONTHS))


def image_id(district, year, season) -> Column:
    return F.concat_ws("_", as_col(district), as_col(year).cast("string"), as_col(season))


def pair_id(district, year1, season1, year2, season2) -> Column:
    first = image_id(district, year1, season1)
    second = F.concat_ws("_", as_col(year2).cast("string"), as_col(season2))
    return F.concat(first, F.lit("_to_"), second)


def patch_id(pair, x, y) -> Column:
    return F.concat(
        as_col(pair), F.lit("_x"), as_col(x).cast("string"), F.lit("_y"), as_col(y).cast("string")
    )


def patch_xy(col) -> Column:
    """``struct(x, y)`` read from a patch id, null when it carries no coordinates."""
    found = F.regexp_extract(as_col(col), r"_x(\d+)_y(\d+)(?:$|_)", 0)

    def numbers(text: Column) -> Column:
        part = F.split(text, "_")
        x, y = (F.substr(F.get(part, F.lit(i)), F.lit(2)).cast("int") for i in (1, 2))
        return F.when(text != "", F.struct(x.alias("x"), y.alias("y")))

    return once(found, numbers)


def bad_path(col) -> Column:
    """True for a missing, empty or placeholder path."""
    return as_col(col).isNull() | strip(col).isin(*NULL_WORDS)


def safe_file_name(col, suffix: str = ".npz") -> Column:
    replaced = F.translate(as_col(col), UNSAFE_FILE_CHARS, "_" * len(UNSAFE_FILE_CHARS))
    return F.concat(replaced, F.lit(suffix))


def parse_raster_name(col) -> Column:
    """Read sensor, resolution, year, season and district from a raster file name.

    Nothing raises: the first failing check leaves its message in
    ``error_message`` and the parsed fields null.
    """
    return once(F.element_at(F.split(as_col(col), "/"), -1), _parse_file_name)


def _parse_file_name(name: Column) -> Column:
    dotted = r"^(.+)\.([^.]+)$"
    has_suffix = name.rlike(dotted)
    stem = F.when(has_suffix, F.regexp_extract(name, dotted, 1)).otherwise(name)
    suffix = F.when(
        has_suffix, F.concat(F.lit("."), F.regexp_extract(name, dotted, 2))
    ).otherwise("")
    return once(
        F.struct(name.alias("name"), stem.alias("stem"), suffix.alias("suffix")),
        lambda s: once(_name_parts(s["name"], s["stem"], s["suffix"]), lambda p: once(_name_values(p), lambda v: _checked_name(p, v))),
    )


def _name_parts(name: Column, stem: Column, suffix: Column) -> Column:
    with_classes = F.lower(stem).startswith("dw_allclasses_")
    parts5, parts4 = F.split(stem, "_", 5), F.split(stem, "_", 4)
    complete = F.when(with_classes, F.size(parts5) == 5).otherwise(F.size(parts4) == 4)

    def part(with_class_token: int, plain: int) -> Column:
        return F.when(with_classes, F.get(parts5, F.lit(with_class_token))).otherwise(
            F.get(parts4, F.lit(plain))
        )

    return F.struct(
        name.alias("name"), suffix.alias("suffix"), with_classes.alias("with_classes"), complete.alias("complete"),
        part(0, 0).alias("sensor_text"), part(2, 1).alias("resolution"), part(3, 2).alias("year_text"),
        strip(part(4, 3)).alias("tail"),
    )


def _name_values(p: Column) -> Column:
    season_pattern = r"^(post_?monsoon|pre_?monsoon|monsoon|winter)(_|$)"
    comparable = F.replace(F.lower(p["tail"]), F.lit(" "), F.lit("_"))

    def after_season(season_text: Column) -> Column:
        district_text = F.regexp_replace(F.substr(p["tail"], F.length(season_text) + 1), "^[_ ]+", "")
        return once(district_text, lambda d: F.struct(
            lookup(F.lower(strip(p["sensor_text"])), SENSOR_ALIASES).alias("sensor"),
            p["year_text"].try_cast("bigint").alias("year"), season_text.alias("season_text"),
            normalize_season(season_text).alias("season"), d.alias("district_text"), normalize_district(d).alias("district"),
        ))

    return once(F.regexp_extract(comparable, season_pattern, 1), after_season)


def _checked_name(p: Column, v: Column) -> Column:
    year_ok = F.coalesce(v["year"].between(FIRST_YEAR, LAST_YEAR), F.lit(False))
    checks = [
        (~F.lower(p["suffix"]).isin(".tif", ".tiff"), F.format_string(MSG_EXTENSION, p["suffix"])),
        (~p["complete"], F.when(p["with_classes"], MSG_FORMAT_CLASSES).otherwise(MSG_FORMAT)),
        (v["sensor"].isNull(), F.format_string(MSG_SENSOR, p["sensor_text"])),
        (~p["year_text"].rlike(r"^\d+$"), F.format_string(MSG_YEAR_TEXT, p["year_text"])),
        (~year_ok, F.lit(MSG_YEAR)),
        (v["season_text"] == "", F.lit(MSG_SEASON)),
        ((v["district_text"] == "") | (v["district"] == ""), F.lit(MSG_DISTRICT)),
    ]
    error = reduce(lambda chain, c: chain.when(c[0], c[1]), checks[1:], F.when(*checks[0]))

    def judged(message: Column) -> Column:
        good = message.isNull()

        def parsed(value: Column) -> Column:
            return F.when(good, value)

        return F.struct(
            p["name"].alias("filename"),
            parsed(v["sensor"]).alias("sensor"),
            parsed(p["resolution"]).alias("resolution"),
            parsed(v["year"].cast("int")).alias("year"),
            parsed(v["season"]).alias("season"),
            parsed(v["district"]).alias("district"),
            parsed(image_id(v["district"], v["year"], v["season"])).alias("image_id"),
            F.lower(p["suffix"]).alias("extension"),
            F.when(good, "success").otherwise("failed").alias("parse_status"),
            message.alias("error_message"),
        )

    return once(error, judged)


def rewrite_text(col: Column, old: list[str], new: str) -> Column:
    return reduce(lambda c, o: F.replace(c, F.lit(o), F.lit(new)), old, col)
