"""Queries over column functions."""

from pyspark.sql import functions as F

from .. import functions as fn
from .registry import query

TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, '(\\pL+|[^\\pL]+)', 1), "
    "lambda w: upper(w[1]) || lower(w[2:])), '')"
)


def district_sql(text: str) -> str:
    """Readable district name as SQL text (the input already trimmed, without quotes)."""
    spaced = f"regexp_replace(replace(trim({text}), '_', ' '), '\\s+', ' ', 'g')"
    return f"trim(regexp_replace(replace({TITLE.format(spaced)}, ' ', '_'), '_+', '_', 'g'), '_')"


SEASON_SQL = (
    "CASE regexp_replace(lower(trim({0})), '[ _]+', '', 'g') WHEN 'winter' THEN 'Winter' "
    "WHEN 'premonsoon' THEN 'PreMonsoon' WHEN 'monsoon' THEN 'Monsoon' WHEN 'postmonsoon' THEN 'PostMonsoon' END"
)


@query(
    "F1_parse_raster_name",
    "file_name:s filename:s sensor:s resolution:s year:i season:s district:s image_id:s extension:s "
    "parse_status:s error_message:s",
    f"""
    WITH a AS (
      SELECT file_name, '.' || regexp_extract(file_name, '^(.+)\\.([^.]+)$', 2) AS suffix,
             regexp_extract(file_name, '^(.+)\\.([^.]+)$', 1) AS stem FROM raster_names),
    b AS (SELECT *, lower(stem) LIKE 'dw!_allclasses!_%' ESCAPE '!' AS cls, string_split(stem, '_') AS p FROM a),
    c AS (SELECT *, CASE WHEN cls THEN p[1] ELSE p[1] END AS sensor_text,
                 CASE WHEN cls THEN p[3] ELSE p[2] END AS res_text,
                 CASE WHEN cls THEN p[4] ELSE p[3] END AS year_text,
                 CASE WHEN cls THEN array_to_string(p[5:], '_') ELSE array_to_string(p[4:], '_') END AS tail,
                 CASE WHEN cls THEN len(p) >= 5 ELSE len(p) >= 4 END AS complete FROM b),
    d AS (SELECT *, regexp_extract(replace(lower(trim(tail)), ' ', '_'),
                                   '^(post_monsoon|postmonsoon|pre_monsoon|premonsoon|monsoon|winter)(_|$)', 1) AS season_text FROM c),
    e AS (SELECT *, ltrim(substr(trim(tail), length(season_text) + 1), '_ ') AS district_text,
                 CASE lower(sensor_text) WHEN 's2' THEN 'S2' WHEN 'sentinel' THEN 'Sentinel' WHEN 'sentinel2' THEN 'Sentinel2'
                      WHEN 'dw' THEN 'DW' WHEN 'dynamicworld' THEN 'DynamicWorld' END AS sensor_ok FROM d),
    f AS (SELECT *, CASE
        WHEN lower(suffix) NOT IN ('.tif', '.tiff') THEN 'Invalid extension ''' || suffix || '''. Expected .tif or .tiff.'
        WHEN NOT complete THEN 'format'
        WHEN sensor_ok IS NULL THEN 'Invalid sensor ''' || sensor_text || '''. Expected one of: DW, DynamicWorld, S2, Sentinel, Sentinel2.'
        WHEN NOT regexp_full_match(year_text, '[0-9]+') THEN 'Invalid year ''' || year_text || '''. Expected a four-digit year.'
        WHEN TRY_CAST(year_text AS BIGINT) NOT BETWEEN 2016 AND 2025 THEN 'Invalid year. Expected a year from 2016 to 2025.'
        WHEN season_text = '' THEN 'Invalid season. Expected one of: Winter, PreMonsoon, Monsoon, PostMonsoon.'
        WHEN district_text = '' THEN 'District name is missing.' END AS err,
        {district_sql('district_text')} AS dist, {SEASON_SQL.format('season_text')} AS seas FROM e)
    SELECT file_name, file_name AS filename, CASE WHEN err IS NULL THEN sensor_ok END AS sensor,
           CASE WHEN err IS NULL THEN res_text END AS resolution,
           CASE WHEN err IS NULL THEN TRY_CAST(year_text AS BIGINT) END AS year,
           CASE WHEN err IS NULL THEN seas END AS season, CASE WHEN err IS NULL THEN dist END AS district,
           CASE WHEN err IS NULL THEN dist || '_' || year_text || '_' || seas END AS image_id,
           lower(suffix) AS extension, CASE WHEN err IS NULL THEN 'success' ELSE 'failed' END AS parse_status,
           err AS error_message FROM f""",
)
def _(t):
    names = t.view("raster_names").select("file_name")
    return names.select("file_name", F.inline(F.array(fn.parse_raster_name("file_name"))))


@query(
    "F2_normalize_district", "district_text:s readable:s tabular:s",
    f"""SELECT district_text, {district_sql('district_text')} AS readable,
        nullif({district_sql("replace(district_text, '''', '')")}, '') AS tabular FROM monthly_text""",
)
def _(t):
    return t.view("monthly_text").select(
        "district_text",
        fn.normalize_district("district_text").alias("readable"),
        fn.normalize_district("district_text", tabular=True).alias("tabular"),
    )


@query(
    "F3_district_join_key", "district_text:s join_key:s",
    "SELECT district_text, nullif(regexp_replace(lower(district_text), '[^a-z0-9]+', '', 'g'), '') AS join_key FROM monthly_text",
)
def _(t):
    return t.view("monthly_text").select("district_text", fn.district_join_key("district_text").alias("join_key"))


SEASON_VARIANTS = (
    "SELECT image_id, CASE ti % 5 WHEN 0 THEN upper(season) WHEN 1 THEN concat(' ', lower(season)) "
    "WHEN 2 THEN replace(season, 'Mon', '_mon') WHEN 3 THEN replace(season, 'Mon', ' mon') ELSE concat(season, 'x') END AS season_text FROM images"
)


@query(
    "F4_normalize_season", "image_id:s season_text:s season:s",
    f"SELECT image_id, season_text, {SEASON_SQL.format('season_text')} AS season FROM ({SEASON_VARIANTS}) v",
)
def _(t):
    return t.sql(SEASON_VARIANTS).withColumn("season", fn.normalize_season("season_text"))


MONTH_VARIANTS = (
    "SELECT month_text, year, CASE WHEN year = 1997 THEN concat(' ', upper(substr(month_text, 1, 3))) "
    "WHEN year = 1999 THEN concat(month_text, '?') WHEN year = 2000 THEN concat('1', month_text) ELSE month_text END AS raw FROM monthly_text"
)


@query(
    "F5_normalize_month", "raw:s month:i",
    f"""SELECT raw, CASE WHEN regexp_full_match(trim(raw), '[0-9]+(\\.0+)?') THEN
            CASE WHEN CAST(trim(raw) AS DOUBLE) BETWEEN 1 AND 12 THEN CAST(CAST(trim(raw) AS DOUBLE) AS BIGINT) END
        ELSE CASE lower(trim(raw)) WHEN 'january' THEN 1 WHEN 'jan' THEN 1 WHEN 'february' THEN 2 WHEN 'feb' THEN 2
            WHEN 'march' THEN 3 WHEN 'mar' THEN 3 WHEN 'april' THEN 4 WHEN 'apr' THEN 4 WHEN 'may' THEN 5 WHEN 'june' THEN 6
            WHEN 'jun' THEN 6 WHEN 'july' THEN 7 WHEN 'jul' THEN 7 WHEN 'august' THEN 8 WHEN 'aug' THEN 8 WHEN 'september' THEN 9
            WHEN 'sep' THEN 9 WHEN 'sept' THEN 9 WHEN 'october' THEN 10 WHEN 'oct' THEN 10 WHEN 'november' THEN 11 WHEN 'nov' THEN 11
            WHEN 'december' THEN 12 WHEN 'dec' THEN 12 END END AS month FROM ({MONTH_VARIANTS}) v""",
)
def _(t):
    return t.sql(MONTH_VARIANTS).select("raw", fn.normalize_month("raw").alias("month"))


@query(
    "F6_season_of", "o_orderkey:i season_year:i season:s",
    """SELECT o_orderkey, year(o_orderdate) + (month(o_orderdate) = 12)::INT AS season_year,
       CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) < 6 THEN 'PreMonsoon'
            WHEN month(o_orderdate) < 10 THEN 'Monsoon' ELSE 'PostMonsoon' END AS season FROM orders""",
)
def _(t):
    o = t.table("orders")
    season = fn.season_of(F.year("o_orderdate"), F.month("o_orderdate"))
    return o.select("o_orderkey", F.inline(F.array(season)))


@query(
    "F7_time_index", "image_id:s time_index:i",
    "SELECT image_id, year * 4 + list_position(['Winter', 'PreMonsoon', 'Monsoon', 'PostMonsoon'], season) - 1 AS time_index FROM images",
)
def _(t):
    return t.view("images").select("image_id", fn.time_index("year", "season").alias("time_index"))


@query(
    "F8_identifiers", "image_id_t1:s pair_id:s patch_id:s",
    """SELECT image_id_t1, district || '_' || year_t1 || '_' || season_t1 || '_to_' || year_t2 || '_' || season_t2 AS pair_id,
       district || '_' || year_t1 || '_' || season_t1 || '_to_' || year_t2 || '_' || season_t2 || '_x' || (nk * 64) || '_y' || time_gap_years AS patch_id
       FROM pairs""",
)
def _(t):
    p = t.view("pairs").withColumn(
        "pair_id", fn.pair_id("district", "year_t1", "season_t1", "year_t2", "season_t2")
    )
    return p.select(
        fn.image_id("district", "year_t1", "season_t1").alias("image_id_t1"),
        "pair_id",
        fn.patch_id("pair_id", F.col("nk") * 64, "time_gap_years").alias("patch_id"),
    )


@query(
    "F9_patch_xy", "text:s x:i y:i",
    """SELECT text, CASE WHEN regexp_matches(text, '_x[0-9]+_y[0-9]+(_|$)') THEN CAST(regexp_extract(text, '_x([0-9]+)_y([0-9]+)(_|$)', 1) AS BIGINT) END AS x,
       CASE WHEN regexp_matches(text, '_x[0-9]+_y[0-9]+(_|$)') THEN CAST(regexp_extract(text, '_x([0-9]+)_y([0-9]+)(_|$)', 2) AS BIGINT) END AS y
       FROM (SELECT CASE WHEN x = 0 THEN replace(patch_id, '_y', 'y') ELSE patch_id END AS text FROM labeled) v""",
)
def _(t):
    d = t.sql("SELECT CASE WHEN x = 0 THEN replace(patch_id, '_y', 'y') ELSE patch_id END AS text FROM labeled")
    return d.withColumn("p", fn.patch_xy("text")).select("text", "p.x", "p.y")


@query(
    "F10_time_gap_group", "gap:i n:i time_gap_group:s",
    """SELECT gap, count(*) AS n, CASE WHEN gap = 0 THEN 'same_year' WHEN gap = 1 THEN 'short' WHEN gap IN (2, 3) THEN 'medium'
       WHEN gap IN (4, 5, 6) THEN 'long' WHEN gap IN (7, 8, 9) THEN 'very_long' ELSE 'other' END AS time_gap_group
       FROM (SELECT CAST(l_quantity AS INT) - 3 AS gap FROM lineitem) v GROUP BY gap""",
)
def _(t):
    gaps = t.table("lineitem").groupBy((F.col("l_quantity").cast("int") - 3).alias("gap")).agg(F.count("*").alias("n"))
    return gaps.withColumn("time_gap_group", fn.time_gap_group("gap"))


@query(
    "F11_change_class", "ratio:d change_class:s",
    """SELECT ratio, CASE WHEN ratio IS NULL OR ratio < 0 OR ratio > 1 THEN 'invalid' WHEN ratio < 0.05::DOUBLE THEN 'low'
       WHEN ratio < 0.2::DOUBLE THEN 'medium' ELSE 'high' END AS change_class
       FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 2e1 - l_tax * 1e1 END AS ratio FROM lineitem) v""",
)
def _(t):
    d = t.sql("SELECT CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE l_discount * 2e1 - l_tax * 1e1 END AS raw FROM lineitem")
    return d.select(fn.not_nan("raw").alias("ratio"), fn.change_class("raw").alias("change_class"))


@query(
    "F12_pair_type", "pair_id:s forward:s backward:s",
    """SELECT pair_id, pair_type AS forward, CASE WHEN year_t1 = year_t2 AND season_t1 <> season_t2 THEN 'cross_season_sameyear' END AS backward FROM pairs""",
)
def _(t):
    return t.view("pairs").select(
        "pair_id",
        fn.pair_type("year_t1", "season_t1", "year_t2", "season_t2").alias("forward"),
        fn.pair_type("year_t2", "season_t2", "year_t1", "season_t1").alias("backward"),
    )


@query(
    "F13_safe_ratio", "district:s ti:i ratio:d",
    "SELECT district, ti, CASE WHEN elevation <> 0 THEN price_mean / elevation END AS ratio FROM seasonal",
)
def _(t):
    return t.view("seasonal").select("district", "ti", fn.safe_ratio("price_mean", "elevation").alias("ratio"))


@query(
    "F14_safe_float", "raw:s plain:d finite_only:d",
    """SELECT raw, coalesce(TRY_CAST(trim(raw) AS DOUBLE), -1) AS plain, TRY_CAST(trim(raw) AS DOUBLE) AS finite_only
       FROM (SELECT CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN event_type ELSE event_id || '.5' END AS raw FROM events) v""",
)
def _(t):
    e = t.table("events")
    eid = F.col("event_id").cast("string")
    raw = (
        F.when(F.col("event_id") % 4 == 0, "")
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), eid, F.lit(" ")))
        .when(F.col("event_id") % 4 == 2, F.col("event_type"))
        .otherwise(F.concat(eid, F.lit(".5")))
    )
    return e.select(raw.alias("raw")).select(
        "raw", fn.safe_float("raw", -1).alias("plain"), fn.safe_float("raw", finite_only=True).alias("finite_only")
    )


@query(
    "F15_one_hot",
    "pair_id:s " + " ".join(f"season_t1_{s}:i" for s in fn.SEASONS) + " " + " ".join(f"time_gap_group_{g}:i" for g in fn.GAP_GROUPS),
    "SELECT pair_id, " + ", ".join(f"(season_t1 = '{s}')::INT AS season_t1_{s}" for s in fn.SEASONS) + ", "
    + ", ".join(f"(time_gap_group = '{g}')::INT AS time_gap_group_{g}" for g in fn.GAP_GROUPS) + " FROM pairs",
)
def _(t):
    return t.view("pairs").select(
        "pair_id", *fn.one_hot("season_t1", "season_t1", fn.SEASONS),
        *fn.one_hot("time_gap_group", "time_gap_group", fn.GAP_GROUPS),
    )


@query("F16_standardize_columns", "district_name:s yr:i price_mean:d",
       "SELECT district_text AS district_name, year AS yr, price_mean FROM monthly_text")
def _(t):
    m = t.view("monthly_text").select("district_text", "year", "price_mean")
    return fn.standardize_columns(m.toDF(" District  Name", "YR", "Price-Mean (%)"))


@query("F17_detect_keys", "role:s column_name:s n:i",
       """SELECT * FROM (VALUES ('district', 'district_name'), ('year', 'yr'), ('month', 'month')) v(role, column_name)
          CROSS JOIN (SELECT count(*) AS n FROM monthly_text) c""")
def _(t):
    m = t.view("monthly_text").withColumnsRenamed(
        {"district_text": "district_name", "year": "yr", "month_text": "month"}
    )
    found = fn.detect_keys(m)
    roles = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.lit(v).alias("column_name")) for k, v in found.items()]))
    return m.agg(F.count("*").alias("n")).select("n", roles.alias("r")).select("r.role", "r.column_name", "n")


@query("F18_numeric_features", "feature:s is_count:b non_null:i",
       """SELECT feature, feature IN ('order_count', 'urgent_event_count') AS is_count, non_null FROM (
          SELECT 'price_mean' AS feature, count(price_mean) AS non_null FROM seasonal UNION ALL
          SELECT 'elevation', count(elevation) FROM seasonal UNION ALL SELECT 'order_count', count(order_count) FROM seasonal
          UNION ALL SELECT 'urgent_event_count', count(urgent_event_count) FROM seasonal) v""")
def _(t):
    s = t.view("seasonal")
    names = fn.numeric_features(s, {"year", "ti"})
    counts = set(fn.count_features(names))
    row = s.agg(*[F.count(c).alias(c) for c in names])
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(c in counts).alias("is_count"), F.col(c).alias("non_null")) for c in names
    ])
    return row.select(F.inline(entries))


FEATURE_NAMES = (
    "SELECT concat(p_type, '_', CASE p_partkey % 23 WHEN 0 THEN 'Temp_max' WHEN 1 THEN 'rainfall' WHEN 2 THEN 'soil_water_2m' "
    "WHEN 3 THEN 'rice_area' WHEN 4 THEN 'slope_t1' WHEN 5 THEN 'distance_to_coast_diff' WHEN 6 THEN 'Population_ratio' "
    "WHEN 7 THEN 'year' WHEN 8 THEN 'x_diff' WHEN 9 THEN 'flood_count' WHEN 10 THEN 'household_size' WHEN 11 THEN 'wind' "
    "WHEN 12 THEN 'a_missing' WHEN 13 THEN 'elevation_mean_between' WHEN 14 THEN 'district_area_t1' WHEN 15 THEN 'nightlight' "
    "WHEN 16 THEN 'irrigation' WHEN 17 THEN 'storm' WHEN 18 THEN 'target_label' WHEN 19 THEN 'dewpoint' ELSE 'plain' END) AS feature FROM part "
    "UNION ALL SELECT concat(CASE p_partkey % 4 WHEN 0 THEN 'season_t1_' WHEN 1 THEN 'pair_type_' WHEN 2 THEN 'time_gap_group_' ELSE 'time_gap_years' END, "
    "CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_name END) AS feature FROM part"
)


def _has(*words):
    return "(" + " OR ".join(f"lower(feature) LIKE '%{w.replace('_', '!_')}%' ESCAPE '!'" for w in words) + ")"


@query("F19_feature_group", "feature:s feature_group:s",
       "SELECT feature, CASE " + " ".join(f"WHEN {_has(*w)} THEN '{g}'" for g, w in [
           ("temperature", ["temp", "dewpoint", "heat"]), ("humidity_rainfall", ["humidity", "rain", "precip"]),
           ("water_soil", ["water", "soil", "runoff", "flood"]), ("agriculture", ["crop", "rice", "irrigation"]),
           ("terrain", ["elevation", "slope"]), ("coastal_distance", ["coast", "distance"]),
           ("population_settlement", ["population", "nightlight", "built", "urban"]), ("time", ["time_gap", "year", "season"]),
           ("ratio_change", ["_diff", "_ratio"])]) + f" ELSE 'other' END AS feature_group FROM ({FEATURE_NAMES}) v")
def _(t):
    return t.sql(FEATURE_NAMES).withColumn("feature_group", fn.feature_group("feature"))


@query("F20_feature_category", "feature:s category:s",
       "SELECT feature, CASE WHEN lower(feature) LIKE '%!_missing' ESCAPE '!' THEN 'missing_flags' "
       "WHEN lower(feature) = 'time_gap_years' OR regexp_matches(lower(feature), '^(season_t1_|season_t2_|pair_type_|time_gap_group_)') THEN 'temporal_metadata' "
       f"WHEN {_has('district_area', 'distance_to_coast', 'elevation', 'slope')} THEN 'static_geographic' "
       f"WHEN {_has('crop', 'rice', 'irrigation')} THEN 'agricultural' WHEN {_has('population', 'household')} THEN 'demographic' "
       f"WHEN {_has('temp', 'dewpoint', 'humidity', 'rainfall', 'wind', 'runoff', 'soil_water', 'cyclone', 'drought', 'flood', 'storm', 'disaster')} "
       f"THEN 'environmental_dynamic' ELSE 'unknown' END AS category FROM ({FEATURE_NAMES}) v")
def _(t):
    return t.sql(FEATURE_NAMES).withColumn("category", fn.feature_category("feature"))


@query("F22_bad_path", "patch_id:s is_bad:b",
       "SELECT patch_id, npz_path IS NULL OR trim(npz_path) IN ('', 'None', 'none', 'NULL', 'null', 'NaN', 'nan') AS is_bad FROM path_rows")
def _(t):
    return t.view("path_rows").select("patch_id", fn.bad_path("npz_path").alias("is_bad"))


@query("F24_safe_file_name", "url:s file_name:s",
       "SELECT url, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g') || '.npz' AS file_name FROM pages")
def _(t):
    return t.table("pages").select("url", fn.safe_file_name("url").alias("file_name"))


@query("F25_softmax_argmax", "patch_id:s prob_low:d prob_medium:d prob_high:d pred_id:i pred_name:s correct:b",
       """SELECT patch_id, exp(z0) / (exp(z0) + exp(z1) + exp(z2)) AS prob_low, exp(z1) / (exp(z0) + exp(z1) + exp(z2)) AS prob_medium,
          exp(z2) / (exp(z0) + exp(z1) + exp(z2)) AS prob_high, pred_id,
          CASE pred_id WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS pred_name, pred_id = true_id AS correct FROM predictions""")
def _(t):
    from ..operators.evaluation import class_fields

    p = t.view("predictions").withColumn("logits", F.array("z0", "z1", "z2")).drop("pred_id")
    return class_fields(p, "logits", "true_id").withColumnsRenamed(
        {"y_pred_class_id": "pred_id", "y_pred_class_name": "pred_name"}
    )


ERRORS_SQL = (
    "SELECT patch_id, CASE WHEN x % 3 = 0 THEN CAST(abs_error AS STRING) WHEN x % 3 = 1 THEN '' END AS abs_error, "
    "CASE WHEN y % 128 = 0 THEN y_true END AS y_true_change_ratio, y_pred AS y_pred_change_ratio, "
    "y_true AS change_ratio, CASE WHEN x > 640 THEN y_pred END AS prediction FROM predictions"
)


@query("F26_prediction_error", "patch_id:s error:d absolute_error:d predicted:d truth:d",
       f"""SELECT patch_id, coalesce(abs(TRY_CAST(abs_error AS DOUBLE)), abs(y_true_change_ratio - y_pred_change_ratio), abs(change_ratio - prediction)) AS error,
           coalesce(TRY_CAST(abs_error AS DOUBLE), abs(coalesce(y_pred_change_ratio, prediction) - coalesce(y_true_change_ratio, change_ratio))) AS absolute_error,
           coalesce(y_pred_change_ratio, prediction) AS predicted, coalesce(y_true_change_ratio, change_ratio) AS truth FROM ({ERRORS_SQL}) v""")
def _(t):
    d = t.sql(ERRORS_SQL)
    names = fn.aliased_values(d.columns)
    return d.select(
        "patch_id", fn.prediction_error(d.columns).alias("error"), names["absolute_error"].alias("absolute_error"),
        names["predicted_change_ratio"].alias("predicted"), names["true_change_ratio"].alias("truth"),
    )
