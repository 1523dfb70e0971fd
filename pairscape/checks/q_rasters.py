"""Queries over inventories, patch grids, labels and samples."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import inventory as inv, patches as pt
from ..operators.greedy import diverse_files
from ..operators.ranking import first_by_key, last_by_key
from ..plans import reports as rp
from .registry import query

FIRST_A = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY full_path, seq) AS rn FROM sensor_a WHERE image_id IS NOT NULL) v WHERE rn = 1)"
FIRST_B = FIRST_A.replace("sensor_a", "sensor_b")
ORDER = ["full_path", "seq"]


def q_sides(t):
    return t.view("sensor_a"), t.view("sensor_b")


@query("J1_first_by_key", "image_id:s seq:i width:i", f"SELECT image_id, seq, width FROM {FIRST_A} f")
def _(t):
    return first_by_key(t.view("sensor_a"), ["image_id"], ORDER)


@query("J1_last_by_key", "o_custkey:i o_orderkey:i",
       "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) v WHERE rn = 1")
def _(t):
    return last_by_key(t.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


ALIGN_SQL = f"""
    SELECT coalesce(a.image_id, b.image_id) AS image_id,
      CASE WHEN a.image_id IS NOT NULL THEN a.district ELSE b.district END AS district,
      CASE WHEN a.image_id IS NOT NULL THEN a.year ELSE b.year END AS year,
      CASE WHEN a.image_id IS NOT NULL THEN a.season ELSE b.season END AS season,
      a.full_path AS sentinel_path, b.full_path AS dw_path, a.readable AS sentinel_readable, b.readable AS dw_readable,
      CASE WHEN a.readable AND b.readable THEN a.crs IS NOT DISTINCT FROM b.crs END AS same_crs,
      CASE WHEN a.readable AND b.readable THEN a.width = b.width END AS same_width,
      CASE WHEN a.readable AND b.readable THEN a.height = b.height END AS same_height,
      CASE WHEN a.readable AND b.readable THEN coalesce(abs(a.resolution_x - b.resolution_x) <= 1e-6 AND abs(a.resolution_y - b.resolution_y) <= 1e-6, false) END AS same_resolution,
      CASE WHEN a.readable AND b.readable THEN coalesce(abs(a.bounds_left - b.bounds_left) <= 1e-6 AND abs(a.bounds_bottom - b.bounds_bottom) <= 1e-6
           AND abs(a.bounds_right - b.bounds_right) <= 1e-6 AND abs(a.bounds_top - b.bounds_top) <= 1e-6, false) END AS same_bounds_approx,
      a.band_count AS sentinel_band_count, b.band_count AS dw_band_count
    FROM {FIRST_A} a FULL OUTER JOIN {FIRST_B} b ON a.image_id = b.image_id"""
STATUS_SQL = f"""
    SELECT *, CASE WHEN sentinel_path IS NULL THEN 'missing_sentinel' WHEN dw_path IS NULL THEN 'missing_dynamic_world'
      WHEN NOT (sentinel_readable AND dw_readable) THEN 'unreadable'
      WHEN same_crs AND same_width AND same_height AND same_resolution AND same_bounds_approx THEN 'aligned' ELSE 'mismatch' END AS alignment_status
    FROM ({ALIGN_SQL}) v"""
ALIGN_COLS = (
    "image_id:s district:s year:i season:s sentinel_path:s dw_path:s sentinel_readable:b dw_readable:b same_crs:b same_width:b "
    "same_height:b same_resolution:b same_bounds_approx:b sentinel_band_count:i dw_band_count:i alignment_status:s"
)


def align_df(t):
    a, b = q_sides(t)
    return inv.alignment(a, b, ORDER)


@query("J2_alignment", ALIGN_COLS, STATUS_SQL)
def _(t):
    return align_df(t)


MATCH_SQL = f"""
    SELECT coalesce(c.image_id, a.image_id, b.image_id) AS image_id, coalesce(c.district, a.district, b.district) AS district,
      coalesce(c.year, a.year, b.year) AS year, coalesce(c.season, a.season, b.season) AS season,
      coalesce(c.sentinel_path, a.full_path) AS sentinel_path, a.filename AS sentinel_filename, a.parse_status AS sentinel_parse_status,
      coalesce(c.dw_path, b.full_path) AS dw_path, b.filename AS dw_filename, b.parse_status AS dw_parse_status,
      coalesce(a.parse_status = 'success', false) AS has_sentinel, coalesce(b.parse_status = 'success', false) AS has_dynamic_world,
      coalesce(a.parse_status = 'success' AND b.parse_status = 'success', false) AS is_matched,
      c.alignment_status, coalesce(c.alignment_status = 'aligned', false) AS is_aligned,
      coalesce(a.parse_status = 'success' AND b.parse_status = 'success' AND c.alignment_status = 'aligned' AND c.sentinel_readable AND c.dw_readable, false) AS is_valid_for_training,
      c.sentinel_readable, c.dw_readable
    FROM {FIRST_A} a FULL OUTER JOIN {FIRST_B} b ON a.image_id = b.image_id
    FULL OUTER JOIN ({STATUS_SQL}) c ON c.image_id = coalesce(a.image_id, b.image_id)"""
MATCH_COLS = (
    "image_id:s district:s year:i season:s sentinel_path:s sentinel_filename:s sentinel_parse_status:s dw_path:s dw_filename:s dw_parse_status:s "
    "has_sentinel:b has_dynamic_world:b is_matched:b alignment_status:s is_aligned:b is_valid_for_training:b"
)


def matched_df(t):
    a, b = q_sides(t)
    return inv.matched_inventory(a, b, align_df(t), ORDER)


@query("J3_matched_inventory", MATCH_COLS, MATCH_SQL)
def _(t):
    return matched_df(t)


REPORT = "summary_type:s value:s count:d"


def counts_sql(source: str, **kinds: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS summary_type, CAST({e} AS VARCHAR) AS value, CAST(count(*) AS DOUBLE) AS count FROM {source} s WHERE ({e}) IS NOT NULL GROUP BY {e}"
        for k, e in kinds.items()
    )


def metrics_sql(source: str, kind: str = "metric", **metrics: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS summary_type, '{k}' AS value, CAST({e} AS DOUBLE) AS count FROM {source} s" for k, e in metrics.items()
    )


def inventory_sql(sensor: str) -> str:
    return f"SELECT '{sensor}' AS sensor, * FROM (" + metrics_sql(
        sensor, total_files_found="count(*)", successfully_parsed_files="count(*) FILTER (WHERE parse_status = 'success')",
        failed_parsed_files="count(*) FILTER (WHERE parse_status = 'failed')",
    ) + " UNION ALL " + counts_sql(sensor, **{f"count_by_{c}": c for c in ("district", "year", "season", "parse_status")}) + ") r"


@query("R2_inventory_report", "sensor:s " + REPORT, inventory_sql("sensor_a") + " UNION ALL " + inventory_sql("sensor_b"))
def _(t):
    parts = [rp.inventory_report(t.view(s)).withColumn("sensor", F.lit(s)) for s in ("sensor_a", "sensor_b")]
    return parts[0].unionByName(parts[1])


@query("R3_quality_report", REPORT,
       metrics_sql("sensor_a", "sentinel_metric", total_rasters_checked="count(*)", unreadable_count="count(*) FILTER (WHERE NOT readable)",
                   band_count_not_13="count(*) FILTER (WHERE readable AND band_count <> 13)") + " UNION ALL "
       + metrics_sql("sensor_b", "dynamic_world_metric", total_rasters_checked="count(*)", unreadable_count="count(*) FILTER (WHERE NOT readable)") + " UNION ALL "
       + counts_sql("sensor_a", sentinel_band_count="band_count", sentinel_crs="crs", sentinel_shape="width || 'x' || height") + " UNION ALL "
       + counts_sql("sensor_b", dynamic_world_band_count="band_count", dynamic_world_crs="crs", dynamic_world_shape="width || 'x' || height") + " UNION ALL "
       + counts_sql(f"({STATUS_SQL})", alignment_status="alignment_status"))
def _(t):
    a, b = q_sides(t)
    return rp.quality_report(a, b, align_df(t))


@query("R4_matched_report", REPORT,
       metrics_sql(f"({MATCH_SQL})", "metrics", total_images="count(*)", matched_count="count(*) FILTER (WHERE is_matched)",
                   valid_for_training_count="count(*) FILTER (WHERE is_valid_for_training)", missing_sentinel_count="count(*) FILTER (WHERE NOT has_sentinel)",
                   missing_dynamic_world_count="count(*) FILTER (WHERE NOT has_dynamic_world)") + " UNION ALL "
       + counts_sql(f"({MATCH_SQL})", alignment_status="alignment_status", district="district", year="year", season="season",
                    district_year_season="district || '|' || year || '|' || season"))
def _(t):
    return rp.matched_report(matched_df(t))


@query("R5_missing_side", "kind:s image_id:s",
       f"""SELECT 'missing' AS kind, image_id FROM ({MATCH_SQL}) m WHERE NOT has_sentinel OR NOT has_dynamic_world
           UNION ALL SELECT 'problem', image_id FROM ({MATCH_SQL}) m WHERE is_matched AND NOT (is_aligned AND coalesce(sentinel_readable, false) AND coalesce(dw_readable, false))""")
def _(t):
    m = matched_df(t)
    return rp.missing_side(m).select(F.lit("missing").alias("kind"), "image_id").unionByName(
        rp.alignment_problems(m).select(F.lit("problem").alias("kind"), "image_id")
    )


# three times the first file whose district and year are not taken yet
DIVERSE_SQL = """
    WITH RECURSIVE ok AS (SELECT *, row_number() OVER (ORDER BY district, year, season, full_path) AS place FROM sensor_b
                WHERE parse_status = 'success' AND district IS NOT NULL AND year IS NOT NULL),
    pick AS (
        SELECT 0 AS step, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS districts, CAST([] AS BIGINT[]) AS years
        UNION ALL
        SELECT step, place, list_append(districts, district), list_append(years, CAST(year AS BIGINT)) FROM (
            SELECT p.step + 1 AS step, o.place, p.districts, p.years, o.district, o.year, row_number() OVER (ORDER BY o.place) AS rn
            FROM pick p, ok o WHERE p.step < 3 AND NOT list_contains(p.districts, o.district) AND NOT list_contains(p.years, CAST(o.year AS BIGINT))) c WHERE rn = 1)
    SELECT o.district, o.year, o.season, o.full_path FROM ok o JOIN pick p ON p.place = o.place WHERE p.step > 0"""


@query("W14_diverse_files", "district:s year:i season:s full_path:s", DIVERSE_SQL)
def _(t):
    return diverse_files(t.view("sensor_b"))


BAND_PIX = (
    "SELECT vec_id AS image_id, b.band, CASE WHEN b.band = 1 THEN c1 WHEN b.band = 2 THEN v + 5e-1 ELSE CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END END AS value, "
    "CASE WHEN b.band = 1 THEN nodata ELSE NULL END AS nodata FROM (SELECT p.vec_id, p.c1, p.nodata, e.v FROM pix p JOIN emb_pix e ON e.vec_id = p.vec_id AND e.pos = p.pos) q "
    "CROSS JOIN (SELECT 1 AS band UNION ALL SELECT 2 UNION ALL SELECT 3) b"
)
BAND_SQL = f"""
    SELECT image_id, band, min(value) AS min, max(value) AS max, count(DISTINCT value) AS unique_count,
           coalesce(bool_and(abs(value - round_even(value, 0)) <= 1e-8 + 1e-5 * abs(round_even(value, 0))), false) AS integer_like,
           list_sort(list(DISTINCT value) FILTER (WHERE value IS NOT NULL))[1:20] AS firsts
    FROM (SELECT image_id, band, CASE WHEN nodata IS NULL OR value <> nodata THEN value END AS value FROM ({BAND_PIX}) a) b GROUP BY image_id, band"""


@query("A25_band_stats", "image_id:i band:i min:d max:d unique_count:i integer_like:b first_values:s",
       f"SELECT *, CASE WHEN integer_like THEN array_to_string(list_transform(firsts, lambda v: CAST(CAST(v AS INT) AS VARCHAR)), ',') ELSE '' END AS first_values FROM ({BAND_SQL}) s")
def _(t):
    s = inv.band_stats(t.sql(BAND_PIX))
    return s.withColumn("first_values", F.array_join(F.transform("first_values", lambda v: v.cast("int").cast("string")), ","))


@query("A26_band_roles", "band:i min:d max:d max_unique:i label_candidate:b probability_candidate:b one_hot_candidate:b recommended:b",
       f"""WITH r AS (SELECT band, min(min) AS min, max(max) AS max, max(unique_count) AS max_unique, bool_and(integer_like) AS w FROM ({BAND_SQL}) s GROUP BY band),
           c AS (SELECT *, w AND min >= 0 AND max <= 20 AND max_unique <= 25 AS label_candidate, min >= 0 AND max <= 1 AND max_unique > 20 AS probability_candidate,
                 w AND min IN (0, 1) AND max IN (0, 1) AND max_unique <= 2 AS one_hot_candidate FROM r)
           SELECT *, band = (SELECT max(band) FROM c WHERE label_candidate) AS recommended FROM c""")
def _(t):
    return inv.band_roles(inv.band_stats(t.sql(BAND_PIX)))


# --- grids and labels ----------------------------------------------------------------------

GRID_SQL = """SELECT path, width, height, 64 * gx AS x, 64 * gy AS y FROM sizes, (SELECT unnest(range(20)) AS gx) a, (SELECT unnest(range(20)) AS gy) b
    WHERE 64 * gx + 128 <= width AND 64 * gy + 128 <= height"""


@query("X1_patch_grid", "path:s x:i y:i", GRID_SQL)
def _(t):
    return pt.patch_grid(t.view("sizes"))


@query("X2_patch_count", "path:s patches:i small:i",
       f"SELECT s.path, (SELECT count(*) FROM ({GRID_SQL}) g WHERE g.path = s.path) AS patches, 0 AS small FROM sizes s")
def _(t):
    return t.view("sizes").select("path", pt.patch_count("width", "height").alias("patches"),
                                  pt.patch_count(F.col("width"), F.lit(100)).alias("small"))


INDEX_SQL = """
    SELECT *, pair_id || '_x' || x || '_y' || y AS patch_id, 128 AS patch_size FROM (
      SELECT *, unnest(range(0, height - 127, 64)) AS y FROM (
        SELECT p.*, a.height, unnest(range(0, a.width - 127, 64)) AS x
        FROM pairs p JOIN sizes a ON a.path = p.sentinel_path_t1 JOIN sizes b ON b.path = p.sentinel_path_t2
        WHERE a.width = b.width AND a.height = b.height) g) h"""


def index_df(t, by_pair=False):
    return pt.patch_index(t.view("pairs"), t.view("sizes"), by_pair=by_pair)[0]


@query("X3_patch_index", "patch_id:s pair_id:s district:s split:s pair_type:s time_gap_group:s x:i y:i dw_path_t1:s", INDEX_SQL)
def _(t):
    return index_df(t)


ERROR_SQL = """SELECT p.pair_id, p.district, p.split, CASE WHEN a.path IS NULL OR b.path IS NULL THEN 'raster size unknown'
    ELSE 'Sentinel t1/t2 shape mismatch: t1=' || a.width || 'x' || a.height || ', t2=' || b.width || 'x' || b.height END AS error_message
    FROM pairs p LEFT JOIN sizes a ON a.path = p.sentinel_path_t1 LEFT JOIN sizes b ON b.path = p.sentinel_path_t2
    WHERE a.path IS NULL OR b.path IS NULL OR a.width <> b.width OR a.height <> b.height"""


@query("X3_patch_index_errors", "pair_id:s district:s split:s error_message:s", ERROR_SQL)
def _(t):
    return pt.patch_index(t.view("pairs"), t.view("sizes"))[1]


@query("V5_check_grid", "path:s x:i y:i",
       "SELECT path, x, y FROM (" + GRID_SQL + ") g WHERE x + 200 > width OR y + 200 > height")
def _(t):
    grid = pt.patch_grid(t.view("sizes"))
    return pt.out_of_bounds(grid.withColumn("patch_size", F.lit(200)))


def class_sql(r: str) -> str:
    return f"CASE WHEN {r} IS NULL THEN 'invalid' WHEN {r} < 0.05::DOUBLE THEN 'low' WHEN {r} < 0.2::DOUBLE THEN 'medium' ELSE 'high' END"


LABEL_COLS = "valid_pixel_count:i changed_pixel_count:i valid_pixel_ratio:d change_ratio:d change_class:s label_status:s"
ARRAY_LABEL_SQL = f"""
    WITH s AS (SELECT vec_id, count(*) FILTER (WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND c1 <> nodata AND c2 <> nodata) AS v,
               count(*) FILTER (WHERE c1 <> c2 AND c1 <> nodata AND c2 <> nodata) AS c, count(*) AS n FROM pix GROUP BY vec_id)
    SELECT vec_id AS patch_id, CASE WHEN vec_id % 31 <> 30 THEN v END AS valid_pixel_count, CASE WHEN vec_id % 31 <> 30 THEN c END AS changed_pixel_count,
           CASE WHEN vec_id % 31 <> 30 THEN CAST(v AS DOUBLE) / n END AS valid_pixel_ratio,
           CASE WHEN vec_id % 31 <> 30 AND v > 0 THEN CAST(c AS DOUBLE) / v END AS change_ratio,
           CASE WHEN vec_id % 31 = 30 THEN 'invalid' ELSE {class_sql('CASE WHEN v > 0 THEN CAST(c AS DOUBLE) / v END')} END AS change_class,
           CASE WHEN vec_id % 31 = 30 THEN 'failed' WHEN CAST(v AS DOUBLE) / n < 0.8::DOUBLE THEN 'invalid_low_valid_ratio' ELSE 'success' END AS label_status
    FROM s"""


def class_arrays(t):
    """Two 8×8 class maps per vector; every 31st second map is cut short."""
    pix = t.view("pix")
    rows = pix.groupBy(F.col("vec_id").alias("patch_id")).agg(
        F.first("nodata").alias("nodata_t1"), F.array_sort(F.collect_list(F.struct("pos", "c1", "c2"))).alias("p")
    )
    t2 = F.transform("p", lambda s: s["c2"])
    return rows.select(
        "patch_id", "nodata_t1", F.col("nodata_t1").alias("nodata_t2"), F.transform("p", lambda s: s["c1"]).alias("values_t1"),
        F.when(F.col("patch_id") % 31 == 30, F.slice(t2, 1, 63)).otherwise(t2).alias("values_t2"),
    )


@query("X4_label_arrays", "patch_id:i " + LABEL_COLS, ARRAY_LABEL_SQL)
def _(t):
    return pt.label_arrays(class_arrays(t))


PIXEL_PATCHES = "SELECT concat('v', CAST(vec_id AS STRING), '_x', CAST(gx * 2 AS STRING), '_y', CAST(gy * 2 AS STRING)) AS patch_id, vec_id, " \
    "concat('a', CAST(vec_id AS STRING)) AS image_id_t1, concat('b', CAST(vec_id AS STRING)) AS image_id_t2, gx * 2 AS x, gy * 2 AS y " \
    "FROM embeddings CROSS JOIN (SELECT 0 AS gx UNION ALL SELECT 1 UNION ALL SELECT 2) a CROSS JOIN (SELECT 0 AS gy UNION ALL SELECT 1 UNION ALL SELECT 2) b"
# every 41st second map is absent; some pixels occur twice, the second time with a smaller or no value
PIXEL_ROWS = "SELECT concat('a', CAST(vec_id AS STRING)) AS image_id, row, col, c1 AS value, nodata FROM pix UNION ALL " \
    "SELECT concat('b', CAST(vec_id AS STRING)) AS image_id, row, col, c2 AS value, nodata FROM pix WHERE vec_id % 41 <> 40 UNION ALL " \
    "SELECT concat('a', CAST(vec_id AS STRING)) AS image_id, row, col, CASE WHEN pos % 2 = 0 THEN c1 - 1 END AS value, nodata FROM pix WHERE pos % 9 = 0"


def pixel_label_sql(patch: int, patches: str) -> str:
    """Labels by comparing every pixel of every window."""
    ratio, area = "CASE WHEN v > 0 THEN CAST(c AS DOUBLE) / v END", float(patch * patch)
    return f"""
        WITH m AS (SELECT image_id, row, col, max(CASE WHEN value <> nodata THEN value END) AS value FROM ({PIXEL_ROWS}) r GROUP BY image_id, row, col),
        s AS (SELECT p.patch_id, any_value(p.vec_id) AS vec_id, count(*) FILTER (WHERE a.value IS NOT NULL AND b.value IS NOT NULL) AS v, count(*) FILTER (WHERE a.value <> b.value) AS c
              FROM ({patches}) p LEFT JOIN m a ON a.image_id = p.image_id_t1 AND a.col >= p.x AND a.col < p.x + {patch} AND a.row >= p.y AND a.row < p.y + {patch}
              LEFT JOIN m b ON b.image_id = p.image_id_t2 AND b.row = a.row AND b.col = a.col GROUP BY p.patch_id),
        g AS (SELECT *, vec_id % 41 <> 40 AS good FROM s)
        SELECT patch_id, CASE WHEN good THEN v END AS valid_pixel_count, CASE WHEN good THEN c END AS changed_pixel_count, CASE WHEN good THEN v / {area} END AS valid_pixel_ratio,
               CASE WHEN good THEN {ratio} END AS change_ratio, CASE WHEN good THEN {class_sql(ratio)} ELSE 'invalid' END AS change_class,
               CASE WHEN NOT good THEN 'failed' WHEN v / {area} < 0.8::DOUBLE THEN 'invalid_low_valid_ratio' ELSE 'success' END AS label_status,
               CASE WHEN NOT good THEN 'no pixels of raster b' || vec_id END AS label_error_message FROM g"""


PIXEL_COLS = "patch_id:s " + LABEL_COLS + " label_error_message:s"


@query("X5_label_pixels", PIXEL_COLS, pixel_label_sql(4, PIXEL_PATCHES))
def _(t):
    return pt.label_pixels(t.sql(PIXEL_PATCHES), t.sql(PIXEL_ROWS), patch=4, stride=2)


# windows of 5 pixels at every third place, partly beyond the raster
ODD_PATCHES = PIXEL_PATCHES.replace("gx * 2", "gx * 3").replace("gy * 2", "gy * 3")


@query("X5_label_pixels_odd_stride", PIXEL_COLS, pixel_label_sql(5, ODD_PATCHES))
def _(t):
    return pt.label_pixels(t.sql(ODD_PATCHES), t.sql(PIXEL_ROWS), patch=5, stride=3)


@query("X6_robust_scale", "vec_id:i pos:i robust:d min_max:d",
       """WITH e AS (SELECT vec_id, pos, CASE WHEN pos = vec_id % 29 THEN 0 ELSE v END AS v FROM emb_pix),
          q AS (SELECT vec_id, quantile_cont(v, 0.01::DOUBLE) AS lo, quantile_cont(v, 0.99::DOUBLE) AS hi, min(v) AS a, max(v) AS b FROM e GROUP BY vec_id)
          SELECT e.vec_id, pos, least(greatest((v - lo) / (hi - lo), 0), 1) AS robust, (v - a) / (b - a) AS min_max FROM e JOIN q ON q.vec_id = e.vec_id""")
def _(t):
    emb = t.table("embeddings").select("vec_id", F.transform(
        "embedding", lambda v, i: F.when(i == F.col("vec_id") % 29, F.lit(float("nan"))).otherwise(v.cast("double"))
    ).alias("v"))
    both = pt.min_max_scale(pt.robust_scale(emb, "v", "r"), "v", "m")
    return both.select("vec_id", F.posexplode(F.arrays_zip("r", "m")).alias("pos", "z")).select(
        "vec_id", "pos", F.col("z.r").alias("robust"), F.col("z.m").alias("min_max")
    )


VECTOR = ["price_mean", "elevation", "order_count", "urgent_event_count"]


@query("X7_assemble_vector", "district:s ti:i pos:i value:d3",
       "SELECT district, ti, pos, value FROM (" + " UNION ALL ".join(
           f"SELECT district, ti, {i} AS pos, CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE) AS value FROM seasonal" for i, c in enumerate(VECTOR)) + ") v")
def _(t):
    v = pt.assemble_vector(t.view("seasonal"), VECTOR)
    return v.select("district", "ti", F.posexplode("tabular").alias("pos", "value"))


CHANNELS, SIDE = 4, 4


def sample_parts(t):
    """Patches, bands (4 of 4×4 cells at two times) and vectors derived from the embeddings."""
    e = t.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"), "label")
    count = e.agg(F.count("*")).scalar()
    nxt = e.select(F.col("vec_id").alias("n"), F.col("v").alias("w"))
    both = e.withColumn("n", (F.col("vec_id") + 1) % count).join(nxt, "n")
    pid = F.concat(F.lit("P"), F.col("vec_id").cast("string"))
    patches = both.select(
        pid.alias("patch_id"), F.concat(F.lit("R"), (F.col("vec_id") % 50).cast("string")).alias("pair_id"),
        F.concat(F.lit("D"), F.col("label").cast("string")).alias("district"), F.lit("test").alias("split"),
        (F.col("label") / 10).alias("change_ratio"), fn.change_class(F.col("label") / 10).alias("change_class"),
        F.element_at(F.array(*[F.lit(x) for x in fn.PAIR_TYPES]), (F.col("vec_id") % 3 + 1).cast("int")).alias("pair_type"),
        F.lit("short").alias("time_gap_group"), "vec_id",
    )
    size = SIDE * SIDE
    sides = F.explode(F.array(*[
        F.struct(F.lit(tt).alias("time"), F.lit(b + 1).alias("band"), F.slice(c, b * size + 1, size).alias("values"))
        for tt, c in (("t1", "v"), ("t2", "w")) for b in range(CHANNELS)
    ]))
    bands = both.select(pid.alias("patch_id"), "vec_id", sides.alias("s")).select("patch_id", "vec_id", "s.*")
    vectors = both.filter(F.col("vec_id") < 45).select(
        F.concat(F.lit("R"), F.col("vec_id").cast("string")).alias("pair_id"), F.slice("v", 1, 8).alias("tabular")
    )
    return patches, bands, vectors


def samples_df(t):
    """Raw samples for the linear scorer: both vectors as images, the first 8 values as features."""
    e = t.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("image_t1"), "label")
    count = e.agg(F.count("*")).scalar()
    nxt = e.select(F.col("vec_id").alias("n"), F.col("image_t1").alias("image_t2"))
    both = e.withColumn("n", (F.col("vec_id") + 1) % count).join(nxt, "n").drop("n")
    return both.withColumns({"tabular": F.slice("image_t1", 1, 8), "change_ratio": F.col("label") / 10})


@query("X8_build_samples", "patch_id:s pair_id:s change_class:s pos:i t1:d4",
       """WITH b AS (SELECT vec_id, pos, CAST(floor(pos / 16) AS INT) AS band, v FROM emb_pix WHERE NOT (vec_id % 37 = 5 AND pos >= 48)),
          q AS (SELECT vec_id, band, quantile_cont(v, 0.01::DOUBLE) AS lo, quantile_cont(v, 0.99::DOUBLE) AS hi FROM b GROUP BY vec_id, band)
          SELECT 'P' || b.vec_id AS patch_id, 'R' || (b.vec_id % 50) AS pair_id, """ + class_sql("(SELECT e.label / 10e0 FROM embeddings e WHERE e.vec_id = b.vec_id)")
       + """ AS change_class, pos, CAST(least(greatest((v - lo) / (hi - lo), 0), 1) AS FLOAT) AS t1
          FROM b JOIN q ON q.vec_id = b.vec_id AND q.band = b.band WHERE b.vec_id % 50 < 45 AND b.vec_id % 37 <> 5""")
def _(t):
    patches, bands, vectors = sample_parts(t)
    broken = bands.filter(~((F.col("vec_id") % 37 == 5) & (F.col("band") == 4) & (F.col("time") == "t1")))
    samples, _ = pt.build_samples(patches, broken, vectors, CHANNELS, SIDE * SIDE)
    return samples.select("patch_id", "pair_id", "change_class", F.posexplode("image_t1").alias("pos", "t1"))


@query("X8_build_samples_errors", "patch_id:s pair_id:s split:s error_message:s",
       """SELECT 'P' || vec_id AS patch_id, 'R' || (vec_id % 50) AS pair_id, 'test' AS split,
          CASE WHEN vec_id % 37 = 5 THEN 'expected 4 bands of 16 values at both times' ELSE 'Pair id not found in tabular features: R' || (vec_id % 50) END AS error_message
          FROM embeddings WHERE vec_id % 37 = 5 OR vec_id % 50 >= 45""")
def _(t):
    patches, bands, vectors = sample_parts(t)
    broken = bands.filter(~((F.col("vec_id") % 37 == 5) & (F.col("band") == 4) & (F.col("time") == "t1")))
    return pt.build_samples(patches, broken, vectors, CHANNELS, SIDE * SIDE)[1]


@query("X9_tensor_check", "metric:s value:d",
       """WITH e AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 3 = 0) AS c, count(*) FILTER (WHERE vec_id % 5 = 0) AS k, count(*) FILTER (WHERE vec_id % 7 = 0) AS f FROM embeddings)
          SELECT unnest(['samples', 'tabular_lengths', 'image_t1_wrong_length', 'image_t2_wrong_length', 'image_t1_nan', 'image_t1_inf', 'image_t2_nan', 'image_t2_inf', 'tabular_nan', 'tabular_inf']) AS metric,
                 unnest([n, 1, c, 0, k, 0, 0, f, 0, 0]) AS value FROM e""")
def _(t):
    s = samples_df(t).withColumns({
        "image_t1": F.when(F.col("vec_id") % 3 == 0, F.slice("image_t1", 1, 60)).otherwise(F.col("image_t1")),
        "image_t2": F.transform("image_t2", lambda v, i: F.when((i == 3) & (F.col("vec_id") % 7 == 0), float("inf")).otherwise(v)),
    })
    s = s.withColumn("image_t1", F.transform("image_t1", lambda v, i: F.when((i == 3) & (F.col("vec_id") % 5 == 0), float("nan")).otherwise(v)))
    return pt.tensor_check(s, 64)


W4_SQL = f"""
    WITH idx AS (SELECT patch_id, pair_id, x, y, x + 64 AS cx, y + 64 AS cy FROM ({INDEX_SQL}) i),
    span AS (SELECT pair_id, count(*) AS n, min(cx) AS lx, max(cx) AS hx, min(cy) AS ly, max(cy) AS hy FROM idx GROUP BY pair_id),
    bin AS (SELECT i.*, s.n, md5('42|' || patch_id) AS h,
            CAST(CASE WHEN hx = lx THEN 0 ELSE least(greatest(floor((CAST(cx AS DOUBLE) - lx) / (hx - lx) * 3), 0), 2) END AS BIGINT) || '_' ||
            CAST(CASE WHEN hy = ly THEN 0 ELSE least(greatest(floor((CAST(cy AS DOUBLE) - ly) / (hy - ly) * 3), 0), 2) END AS BIGINT) AS b
            FROM idx i JOIN span s ON s.pair_id = i.pair_id),
    inb AS (SELECT *, row_number() OVER (PARTITION BY pair_id, b ORDER BY h, patch_id) AS r FROM bin),
    turn AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r, b) AS turn FROM inb)
"""


@query("W4_spatial_sample", "patch_id:s pair_id:s sampled_from_total_pair_patches:i pair_sampling_ratio:d patch_center_x:d",
       W4_SQL + "SELECT patch_id, pair_id, n AS sampled_from_total_pair_patches, least(n, 8) / CAST(n AS DOUBLE) AS pair_sampling_ratio, cx AS patch_center_x FROM turn WHERE turn <= 8 OR n <= 8")
def _(t):
    return pt.spatial_sample(index_df(t, by_pair=True), 8, named=True)


@query("R11_patch_report", REPORT,
       f"""WITH i AS ({INDEX_SQL}), c AS (SELECT count(*) AS n FROM i GROUP BY pair_id)
           SELECT 'metric' AS summary_type, 'total_input_pairs' AS value, count(*)::DOUBLE AS count FROM pairs
           UNION ALL SELECT 'metric', 'total_patch_rows', count(*) FROM i UNION ALL SELECT 'metric', 'pair_error_count', count(*) FROM ({ERROR_SQL}) e
           UNION ALL SELECT 'metric', 'min_patches_per_pair', min(n) FROM c UNION ALL SELECT 'metric', 'max_patches_per_pair', max(n) FROM c
           UNION ALL SELECT 'metric', 'mean_patches_per_pair', avg(n) FROM c
           UNION ALL SELECT 'metric', 'estimated_float16_image_pair_storage_gb', count(*) * 851968e0 / 1e9 FROM i UNION ALL """
       + counts_sql("i", **{f"patch_rows_by_{c}": c for c in ("split", "district", "pair_type", "time_gap_group")}))
def _(t):
    pairs = t.view("pairs")
    index, errors = pt.patch_index(pairs, t.view("sizes"))
    return rp.patch_report(pairs, index, errors)


def sampling_sql() -> str:
    return W4_SQL + """, meta AS (SELECT DISTINCT pair_id, split, district, pair_type, time_gap_group FROM pairs),
        took AS (SELECT pair_id, count(*) AS k FROM turn WHERE turn <= 8 OR n <= 8 GROUP BY pair_id) """


@query("R12_per_pair_sampling", "pair_id:s split:s district:s original_patch_count:i sampled_patch_count:i sampling_ratio:d",
       sampling_sql() + "SELECT s.pair_id, split, district, s.n AS original_patch_count, k AS sampled_patch_count, k / CAST(s.n AS DOUBLE) AS sampling_ratio "
       "FROM span s JOIN meta m ON m.pair_id = s.pair_id JOIN took t ON t.pair_id = s.pair_id")
def _(t):
    full = index_df(t, by_pair=True)
    return rp.per_pair_sampling(full, pt.spatial_sample(full, 8, named=True))


@query("R12_sampling_report", REPORT,
       sampling_sql() + ", smp AS (SELECT m.* FROM turn t JOIN meta m ON m.pair_id = t.pair_id WHERE turn <= 8 OR n <= 8), c AS (SELECT s.n, k FROM span s JOIN took t ON t.pair_id = s.pair_id) "
       + metrics_sql("c", total_full_patches="sum(n)", total_sampled_patches="sum(k)", reduction_ratio="sum(k) / CAST(sum(n) AS DOUBLE)",
                     min_sampled_patches_per_pair="min(k)", max_sampled_patches_per_pair="max(k)", mean_sampled_patches_per_pair="avg(k)",
                     min_original_patches_per_pair="min(n)", max_original_patches_per_pair="max(n)", mean_original_patches_per_pair="avg(n)")
       + " UNION ALL " + counts_sql("smp", **{f"sampled_by_{c}": c for c in ("split", "district", "pair_type", "time_gap_group")}))
def _(t):
    full = index_df(t, by_pair=True)
    return rp.sampling_report(full, pt.spatial_sample(full, 8, named=True))


@query("J14_attach_labels", "patch_id:s label_status:s change_class:s change_ratio:d label_error_message:s",
       """SELECT patch_id, CASE WHEN y = 0 THEN 'failed' ELSE label_status END AS label_status, CASE WHEN y = 0 THEN 'invalid' ELSE change_class END AS change_class,
          CASE WHEN y > 0 THEN change_ratio END AS change_ratio, CASE WHEN y = 0 THEN 'Missing label output for patch, likely due to failed chunk.' END AS label_error_message FROM labeled""")
def _(t):
    lab = t.view("labeled").withColumn("label_error_message", F.lit(None).cast("string"))
    return pt.attach_labels(lab.select("patch_id", "pair_id", "x", "y"), lab.filter("y > 0"))


@query("A27_storage_estimate", "metric:s value:d",
       """WITH i AS (SELECT count(*) AS n FROM labeled) SELECT unnest(['patches', 'bytes', 'decimal_gb', 'gib', 'stored_bytes']) AS metric,
          unnest([CAST(n AS DOUBLE), n * 851968e0, n * 851968e0 / 1e9, n * 851968e0 / 1073741824e0, (SELECT CAST(sum(size) AS DOUBLE) FROM disk_files)]) AS value FROM i""")
def _(t):
    return rp.storage_estimate(t.view("labeled"), 128, t.view("disk_files"))


@query("A28_dataset_shape", "metric:s value:d",
       """WITH c AS (SELECT count(*) AS n FROM labeled GROUP BY pair_id), r AS (SELECT count(*) AS n FROM labeled GROUP BY dw_path_t1, dw_path_t2)
          SELECT 'raster_pair_count' AS metric, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'average_patches_per_raster_pair', avg(n) FROM r
          UNION ALL SELECT 'min_patches_per_pair', min(n) FROM c UNION ALL SELECT 'max_patches_per_pair', max(n) FROM c UNION ALL SELECT 'mean_patches_per_pair', avg(n) FROM c""")
def _(t):
    return rp.dataset_shape(t.view("labeled"))


@query("R13_label_report", REPORT,
       metrics_sql("labeled", label_band_used="max(10)", total_patches="count(*)", success_count="count(*) FILTER (WHERE label_status = 'success')",
                   failed_count="count(*) FILTER (WHERE label_status = 'failed')", invalid_low_valid_ratio_count="count(*) FILTER (WHERE label_status = 'invalid_low_valid_ratio')",
                   low_count="count(*) FILTER (WHERE change_class = 'low')", medium_count="count(*) FILTER (WHERE change_class = 'medium')",
                   high_count="count(*) FILTER (WHERE change_class = 'high')", mean_change_ratio="avg(change_ratio) FILTER (WHERE label_status = 'success')",
                   median_change_ratio="median(change_ratio) FILTER (WHERE label_status = 'success')") + " UNION ALL "
       + counts_sql("labeled", **{f"change_class_by_{c}": f"{c} || '|' || change_class" for c in ("split", "pair_type", "time_gap_group")}))
def _(t):
    return rp.label_report(t.view("labeled"))
