"""Queries over missing-data and feature reports and the audit."""

from pyspark.sql import functions as F

from ..operators import audit as au, tabular as tb
from ..plans import reports as rp
from ..session import cut_lineage, stored
from .q_functions import FEATURE_NAMES
from .q_rasters import REPORT, counts_sql, metrics_sql
from .q_tables import BASE_FEATURES, COUNTS, ENDPOINT_SQL, MODEL_COLS, STATS_SQL, features_df, seasonal_df
from .registry import query

# keys where one endpoint has no seasonal record
LACK_SQL = " UNION ALL ".join(
    f"""SELECT 'missing_district_year_season' AS report_type, p.split, p.pair_type, p.district, p.year_{t} AS year, p.season_{t} AS season, '{t}' AS timepoint, count(*) AS count
        FROM pairs p LEFT JOIN seasonal s ON s.district = p.district AND s.ti = p.time_index_{t} WHERE s.district IS NULL GROUP BY ALL""" for t in ("t1", "t2"))
MISSING_SQL = f"""
    WITH f AS (SELECT p.split, p.pair_type, p.district, e.tabular_any_missing FROM ({ENDPOINT_SQL}) e JOIN pairs p ON p.pair_id = e.pair_id)
    SELECT 'missing_tabular_district' AS report_type, NULL AS split, NULL AS pair_type, district, NULL AS year, NULL AS season, NULL AS timepoint, 1 AS count
    FROM (SELECT DISTINCT district FROM pairs WHERE district NOT IN (SELECT district FROM seasonal)) d
    UNION ALL {LACK_SQL}
    UNION ALL SELECT 'missing_by_district', NULL, NULL, district, NULL, NULL, NULL, count(*) FROM f WHERE tabular_any_missing GROUP BY district
    UNION ALL SELECT 'missing_by_split', split, NULL, NULL, NULL, NULL, NULL, count(*) FROM f WHERE tabular_any_missing GROUP BY split
    UNION ALL SELECT 'missing_by_pair_type', NULL, pair_type, NULL, NULL, NULL, NULL, count(*) FROM f WHERE tabular_any_missing GROUP BY pair_type"""


def flagged_df(t):
    return stored(tb.pair_features(t.view("pairs"), seasonal_df(t)))


@query("R7_missing_tabular_report", "report_type:s split:s pair_type:s district:s year:i season:s timepoint:s count:i", MISSING_SQL)
def _(t):
    return rp.missing_tabular_report(t.view("pairs"), seasonal_df(t), flagged_df(t))


@query("R8_missing_districts", "district:s district_join_key:s pair_count:i",
       """SELECT district, regexp_replace(lower(district), '[^a-z0-9]', '', 'g') AS district_join_key, count(*) AS pair_count FROM pairs
          WHERE district NOT IN (SELECT district FROM seasonal) GROUP BY district""")
def _(t):
    return rp.missing_districts(t.view("pairs"), seasonal_df(t))


@query("R9_feature_summary", "metric:s value:d",
       f"""SELECT 'pair_feature_rows' AS metric, count(*)::DOUBLE AS value FROM pairs UNION ALL SELECT 'scaled_feature_rows', count(*) FROM pairs
           UNION ALL SELECT 'base_tabular_feature_count', 4 UNION ALL SELECT 'generated_raw_pair_feature_count', {len(MODEL_COLS)}
           UNION ALL SELECT 'scaled_feature_column_count', {len(MODEL_COLS)} UNION ALL SELECT 'missing_flag_column_count', 4
           UNION ALL SELECT 'rows_split_' || split, count(*) FROM pairs GROUP BY split""")
def _(t):
    feats = flagged_df(t)
    scaled = tb.impute_scale(feats, tb.train_stats(feats))
    return rp.feature_summary(feats, scaled, BASE_FEATURES)


@query("R9_schema_summary", REPORT,
       f"""SELECT 'metric' AS summary_type, m AS value, CAST(n AS DOUBLE) AS count FROM (VALUES ('numeric_feature_count', 4), ('count_sum_feature_count', {len(COUNTS)}), ('mean_feature_count', 2)) v(m, n)
           UNION ALL SELECT 'aggregation', a, n FROM (VALUES ('none', 3), ('sum', 2), ('mean', 2)) w(a, n) WHERE EXISTS (SELECT 1 FROM seasonal)""")
def _(t):
    return rp.schema_summary(seasonal_df(t))


@query("R10_filter_report", REPORT,
       f"WITH f AS (SELECT p.split, p.pair_type, p.district, e.tabular_any_missing AS miss FROM ({ENDPOINT_SQL}) e JOIN pairs p ON p.pair_id = e.pair_id) "
       + metrics_sql("f", original_pair_count="count(*)", kept_pair_count="count(*) FILTER (WHERE NOT miss)", removed_pair_count="count(*) FILTER (WHERE miss)")
       + " UNION ALL " + counts_sql("f", kept_by_split="CASE WHEN NOT miss THEN split END", removed_by_split="CASE WHEN miss THEN split END",
                                    kept_by_pair_type="CASE WHEN NOT miss THEN pair_type END", removed_by_pair_type="CASE WHEN miss THEN pair_type END",
                                    removed_by_district="CASE WHEN miss THEN district END"))
def _(t):
    pairs = t.view("pairs")
    kept, removed, _ = tb.complete_pairs(pairs, tb.endpoint_features(pairs, seasonal_df(t)))
    return rp.filter_report(kept, removed)


PROFILE = "SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity - 25 END AS q, l_extendedprice / 6997e0 AS e, " \
    "CASE WHEN l_linenumber = 5 THEN l_extendedprice * 1e6 ELSE l_tax END AS big FROM lineitem"


@query("A19_column_profile", "feature:s min:d max:d mean:d3 std:d3 missing_count:i zero_count:i inf_count:i extremely_large_abs_count:i",
       " UNION ALL ".join(
           f"SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_pop({c}) AS std, count(*) - count({c}) AS missing_count, "
           f"count(*) FILTER (WHERE {c} = 0) AS zero_count, 0 AS inf_count, count(*) FILTER (WHERE abs({c}) > 1e9) AS extremely_large_abs_count FROM ({PROFILE}) p" for c in ("q", "e")))
def _(t):
    return au.column_profile(t.sql(PROFILE), ["q", "e"])


@query("A19_column_profile_large", "feature:s missing_count:i zero_count:i inf_count:i extremely_large_abs_count:i",
       f"""SELECT 'big' AS feature, 0 AS missing_count, count(*) FILTER (WHERE big = 0) AS zero_count,
           (SELECT count(*) FROM lineitem WHERE l_linenumber = 7) AS inf_count,
           count(*) FILTER (WHERE abs(big) > 1e9) + (SELECT count(*) FROM lineitem WHERE l_linenumber = 7) AS extremely_large_abs_count
           FROM (SELECT CASE WHEN l_linenumber = 5 THEN l_extendedprice * 1e6 ELSE l_tax END AS big, l_linenumber FROM lineitem) p WHERE l_linenumber <> 7""")
def _(t):
    li = t.table("lineitem")
    big = F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).when(F.col("l_linenumber") == 5, F.col("l_extendedprice") * 1e6).otherwise(F.col("l_tax"))
    return au.column_profile(li.select(big.alias("big")), ["big"])


SCALED_IN = "SELECT split, change_ratio, CAST(x AS DOUBLE) / 64e0 AS px, CAST(y AS DOUBLE) / 640e0 AS py FROM labeled"
SPLIT_MEANS = " UNION ALL ".join(
    f"SELECT split, '{c}' AS feature, count(*) AS rows, avg({c}) AS mean, stddev_pop({c}) AS std, max(abs({c})) AS top FROM ({SCALED_IN}) s GROUP BY split" for c in ("change_ratio", "px", "py"))


@query("A21_scaled_by_split", "split:s rows:i mean_abs_mean:d max_abs_mean:d mean_std:d max_abs_value:d",
       f"SELECT split, max(rows) AS rows, avg(abs(mean)) AS mean_abs_mean, max(abs(mean)) AS max_abs_mean, avg(std) AS mean_std, max(top) AS max_abs_value FROM ({SPLIT_MEANS}) m GROUP BY split")
def _(t):
    return au.scaled_by_split(t.sql(SCALED_IN), ["change_ratio", "px", "py"])


@query("A21_scaled_anomalies", "split:s feature:s scaled_mean:d", f"SELECT split, feature, mean AS scaled_mean FROM ({SPLIT_MEANS}) m WHERE abs(mean) > 5")
def _(t):
    return au.scaled_anomalies(t.sql(SCALED_IN), ["change_ratio", "px", "py"])


@query("A22_verify_train_stats", "feature:s mismatch:b",
       STATS_SQL + "SELECT feature, feature LIKE '%!_ratio' ESCAPE '!' OR feature LIKE '%between' AS mismatch FROM stats")
def _(t):
    feats = stored(features_df(t))
    saved = cut_lineage(tb.train_stats(feats)).filter(~F.col("feature").endswith("between")).withColumn(
        "mean", F.when(F.col("feature").endswith("_ratio"), F.col("mean") + 1).otherwise(F.col("mean"))
    )
    return au.verify_train_stats(feats, saved, tb.model_features(feats))


NAMES = f"SELECT DISTINCT feature FROM ({FEATURE_NAMES}) n"


@query("R18_category_table", "category:s features:i temporal:i environmental:i",
       "SELECT category, count(*) AS features, CASE WHEN category = 'temporal_metadata' THEN count(*) ELSE 0 END AS temporal, CASE WHEN category = 'environmental_dynamic' THEN count(*) ELSE 0 END AS environmental FROM ("
       "SELECT CASE WHEN lower(feature) LIKE '%!_missing' ESCAPE '!' THEN 'missing_flags' WHEN lower(feature) = 'time_gap_years' OR regexp_matches(lower(feature), '^(season_t1_|season_t2_|pair_type_|time_gap_group_)') THEN 'temporal_metadata' "
       "WHEN regexp_matches(lower(feature), 'district_area|distance_to_coast|elevation|slope') THEN 'static_geographic' WHEN regexp_matches(lower(feature), 'crop|rice|irrigation') THEN 'agricultural' "
       "WHEN regexp_matches(lower(feature), 'population|household') THEN 'demographic' WHEN regexp_matches(lower(feature), 'temp|dewpoint|humidity|rainfall|wind|runoff|soil_water|cyclone|drought|flood|storm|disaster') THEN 'environmental_dynamic' "
       f"ELSE 'unknown' END AS category FROM ({NAMES}) d) c GROUP BY category")
def _(t):
    return au.category_table(t.sql(NAMES)).groupBy("category").agg(
        F.count("*").alias("features"), F.sum(F.col("is_temporal_metadata").cast("int")).alias("temporal"),
        F.sum(F.col("is_environmental_dynamic").cast("int")).alias("environmental"),
    )


@query("R18_static_warnings", "feature:s base_keyword:s operation:s",
       f"""SELECT feature, coalesce(CASE WHEN contains(lower(feature), 'district_area') THEN 'district_area' END, CASE WHEN contains(lower(feature), 'distance_to_coast') THEN 'distance_to_coast' END,
           CASE WHEN contains(lower(feature), 'slope') THEN 'slope' END, 'population') AS base_keyword, regexp_extract(lower(feature), '_(diff|ratio|mean_between|sum_between)$', 1) AS operation
           FROM ({NAMES}) n WHERE regexp_matches(lower(feature), 'district_area|distance_to_coast|slope|population') AND regexp_matches(lower(feature), '_(diff|ratio|mean_between|sum_between)$')""")
def _(t):
    return au.static_warnings(t.sql(NAMES))


@query("R18_leakage_columns", "feature:s matched_patterns:s",
       f"""SELECT feature, array_to_string(list_filter(['change_ratio', 'change_class', 'split', 'patch_id', 'pair_id', 'target', 'label', 'prediction', 'y_true', 'y_pred'],
           lambda w: contains(lower(feature), w)), ';') AS matched_patterns FROM ({NAMES}) n WHERE regexp_matches(lower(feature), 'change_ratio|change_class|split|patch_id|pair_id|target|label|prediction|y_true|y_pred')""")
def _(t):
    return au.leakage_columns(t.sql(NAMES))


@query("R18_missingness", "metric:s value:d",
       f"""WITH e AS (SELECT e.*, p.district NOT IN (SELECT district FROM seasonal) AS gone, p.district FROM ({ENDPOINT_SQL}) e JOIN pairs p ON p.pair_id = e.pair_id), r AS ({MISSING_SQL})
           SELECT 'pairs_total' AS metric, count(*)::DOUBLE AS value FROM e UNION ALL SELECT 'pairs_full_tabular_match', count(*) FILTER (WHERE NOT tabular_any_missing) FROM e
           UNION ALL SELECT 'pairs_missing_t1_tabular', count(*) FILTER (WHERE tabular_t1_missing) FROM e UNION ALL SELECT 'pairs_missing_t2_tabular', count(*) FILTER (WHERE tabular_t2_missing) FROM e
           UNION ALL SELECT 'pairs_missing_any_tabular', count(*) FILTER (WHERE tabular_any_missing) FROM e UNION ALL SELECT 'missing_tabular_district_count', count(DISTINCT district) FILTER (WHERE gone) FROM e
           UNION ALL SELECT 'missing_tabular_season_count', count(DISTINCT season) FROM r UNION ALL SELECT 'report_' || report_type, CAST(sum(count) AS DOUBLE) FROM r GROUP BY report_type""")
def _(t):
    feats = flagged_df(t)
    return au.missingness(feats, rp.missing_tabular_report(t.view("pairs"), seasonal_df(t), feats))


@query("R18_audit_status", "status:s",
       f"SELECT CASE WHEN count(*) FILTER (WHERE tabular_any_missing) > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM ({ENDPOINT_SQL}) e")
def _(t):
    feats = stored(features_df(t))
    cols = tb.model_features(feats)
    stats = cut_lineage(tb.train_stats(feats, cols))
    scaled = tb.impute_scale(feats, stats, cols)
    return au.audit_status(feats, au.feature_names(feats, cols), au.verify_train_stats(feats, stats, cols), au.scaled_anomalies(scaled, cols))


# --- paths ---------------------------------------------------------------------------------

OLD, NEW = ["http://", "https://m."], "s3://"


@query("F23_rewrite_prefix", "page_id:i url:s nested:s",
       "SELECT page_id, u AS url, u || ',' || u || '!' AS nested FROM (SELECT page_id, replace(replace(url, 'http://', 's3://'), 'https://m.', 's3://') AS u FROM pages) v")
def _(t):
    p = t.table("pages").select("page_id", "url", F.struct(F.array("url", F.concat("url", F.lit("!"))).alias("a")).alias("deep"))
    return au.rewrite_prefix(p, OLD, NEW).select("page_id", "url", F.array_join("deep.a", ",").alias("nested"))


@query("F23_rewrite_report", "column:s prefix:s changed_rows:i remaining_rows:i",
       """SELECT c AS "column", p AS prefix, (SELECT count(*) FROM pages WHERE contains(url, p)) AS changed_rows, 0 AS remaining_rows
          FROM (VALUES ('url'), ('deep')) a(c), (VALUES ('http://'), ('https://m.')) b(p)""")
def _(t):
    p = t.table("pages").select("page_id", "url", F.create_map(F.lit("k"), F.array("url")).alias("deep"))
    return au.rewrite_report(p, OLD, NEW)


GOOD = "(npz_path IS NOT NULL AND trim(npz_path) NOT IN ('', 'nan', 'NULL'))"


@query("J12_missing_and_extra", "part:s path:s",
       f"""SELECT 'missing' AS part, npz_path AS path FROM path_rows WHERE {GOOD} AND npz_path NOT IN (SELECT path FROM disk_files)
           UNION ALL SELECT 'extra', path FROM disk_files WHERE path NOT IN (SELECT npz_path FROM path_rows WHERE {GOOD})""")
def _(t):
    missing, extra = au.missing_and_extra(t.view("path_rows"), t.view("disk_files"))
    return missing.select(F.lit("missing").alias("part"), "path").unionByName(extra.select(F.lit("extra").alias("part"), "path"))


@query("J12_path_counts", "metric:s value:i",
       f"""WITH w AS (SELECT DISTINCT npz_path AS path FROM path_rows WHERE {GOOD}), f AS (SELECT DISTINCT path FROM disk_files)
           SELECT 'checked_paths' AS metric, count(*) AS value FROM w UNION ALL SELECT 'existing_paths', count(*) FROM w WHERE path IN (SELECT path FROM f)
           UNION ALL SELECT 'missing_paths', count(*) FROM w WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT 'extra_files', count(*) FROM f WHERE path NOT IN (SELECT path FROM w)""")
def _(t):
    return au.path_counts(t.view("path_rows"), t.view("disk_files"))


REPAIR_SQL = f"""SELECT r.patch_id, r.split, CASE WHEN {GOOD} THEN 'kept' WHEN d.path IS NOT NULL AND r.split <> 'other' THEN 'rebuilt' ELSE 'dropped' END AS path_state,
    CASE WHEN {GOOD} THEN npz_path WHEN d.path IS NOT NULL AND r.split <> 'other' THEN d.path ELSE npz_path END AS npz_path
    FROM path_rows r LEFT JOIN disk_files d ON d.path = '/data/' || r.split || '/' || r.patch_id || '.npz'"""


@query("J13_repair_paths", "patch_id:s path_state:s npz_path:s", REPAIR_SQL)
def _(t):
    return au.repair_paths(t.view("path_rows"), t.view("disk_files"), "/data")


# the same repair over rows with classes and repeated ids
CLASSED_REPAIR_SQL = REPAIR_SQL.replace("SELECT r.patch_id,", "SELECT r.patch_id, r.change_class,").replace("path_rows", "classed_rows")


@query("R19_index_repair_report", "metric:s value:d",
       f"""WITH r AS ({CLASSED_REPAIR_SQL}), c AS (SELECT * FROM r WHERE path_state <> 'dropped'), m(metric, value) AS (
           SELECT 'official_index_row_count', count(*)::DOUBLE FROM r UNION ALL SELECT 'cleaned_row_count', count(*) FROM c UNION ALL SELECT 'missing_path_rows_dropped', count(*) FROM r WHERE path_state = 'dropped'
           UNION ALL SELECT 'reconstructed_path_count', count(*) FROM r WHERE path_state = 'rebuilt' UNION ALL SELECT 'train_count', count(*) FROM c WHERE split = 'train'
           UNION ALL SELECT 'val_count', count(*) FROM c WHERE split = 'val' UNION ALL SELECT 'test_count', count(*) FROM c WHERE split = 'test'
           UNION ALL SELECT v.class || '_count', count(c.patch_id) FROM (VALUES ('low'), ('medium'), ('high')) v(class) LEFT JOIN c ON c.change_class = v.class GROUP BY v.class
           UNION ALL SELECT 'duplicate_patch_id_count', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM c GROUP BY patch_id HAVING count(*) > 1) d UNION ALL SELECT 'missing_files_count', count(*) FROM c WHERE npz_path NOT IN (SELECT path FROM disk_files)
           UNION ALL SELECT 'extra_files_on_disk_count', count(*) FROM disk_files WHERE path NOT IN (SELECT npz_path FROM c) UNION ALL SELECT 'total_files_found', count(*) FROM disk_files) SELECT * FROM m""")
def _(t):
    return au.index_repair_report(t.view("classed_rows"), t.view("disk_files"), "/data")


@query("R19_store_report", REPORT,
       """WITH i AS (SELECT * FROM valid_labeled WHERE x > 0), s AS (SELECT * FROM valid_labeled WHERE x > 0 AND y = 0)
          SELECT 'metric' AS summary_type, 'total_requested' AS value, count(*)::DOUBLE AS count FROM valid_labeled UNION ALL SELECT 'metric', 'indexed_count', count(*) FROM i
          UNION ALL SELECT 'metric', 'skipped_count', count(*) FROM s UNION ALL SELECT 'metric', 'saved_count', (SELECT count(*) FROM i) - count(*) FROM s
          UNION ALL SELECT 'metric', 'failed_count', count(*) FROM valid_labeled WHERE x = 0 UNION ALL """
       + counts_sql("i", split="split", change_class="change_class"))
def _(t):
    lab = t.view("valid_labeled")
    index = lab.filter("x > 0")
    return rp.store_report(lab, index, lab.filter("x = 0"), index.filter("y = 0"))




@query("V6_check_columns", "missing:s n:i", "SELECT unnest(['crs', 'district_name']) AS missing, (SELECT count(*) FROM seasonal) AS n")
def _(t):
    from ..functions import check_columns

    s = seasonal_df(t)
    lacking = check_columns(s, {"district", "year", "district_name", "crs"}, strict=False)
    names = F.explode(F.array(*[F.lit(c) for c in lacking]))
    return s.agg(F.count("*").alias("n")).select(names.alias("missing"), "n")
