"""Queries over scoring, ablation, occlusion, sample choice and case studies."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import explain as ex
from ..plans import reports as rp
from ..session import cut_lineage
from .q_evaluation import pred_df
from .q_rasters import samples_df
from .registry import query

CHANNELS, SIDE = 4, 4


def make_linear_model():
    """Weighted sum with weights ((i mod 5) − 2)/4 of the first image, minus half the second, plus the features.

    A local function travels to the workers by value; they need not import this module.
    """
    def model(t1, t2, tab):
        import numpy as np

        w = ((np.arange(t1.shape[1]) % 5) - 2) / 4.0
        u = ((np.arange(tab.shape[1]) % 5) - 2) / 4.0
        return t1 @ w - 0.5 * (t2 @ w) + tab @ u

    return model


# contribution of every cell and feature of a sample to the linear score
TERMS = """
    WITH w AS (SELECT vec_id, pos, v, ((pos % 5) - 2) / 4e0 AS w FROM emb_pix), n AS (SELECT count(*) AS n FROM embeddings),
    t AS (SELECT a.vec_id, a.pos, a.v * a.w AS c1, -0.5e0 * b.v * b.w AS c2, CASE WHEN a.pos < 8 THEN a.v * a.w ELSE 0e0 END AS ct, b.v * a.w AS s1, -0.5e0 * a.v * a.w AS s2
          FROM w a JOIN w b ON b.pos = a.pos AND b.vec_id = (a.vec_id + 1) % (SELECT n FROM n)),
    f AS (SELECT vec_id, sum(c1) AS s1, sum(c2) AS s2, sum(ct) AS st, sum(c1) + sum(c2) + sum(ct) AS whole, sum(s1) AS swap1, sum(s2) AS swap2 FROM t GROUP BY vec_id)
"""


@query("X10_score", "vec_id:i prediction:d abs_error:d squared_error:d",
       TERMS + "SELECT f.vec_id, f.whole AS prediction, abs(f.whole - label / 10e0) AS abs_error, (f.whole - label / 10e0) * (f.whole - label / 10e0) AS squared_error FROM f JOIN embeddings e ON e.vec_id = f.vec_id")
def _(t):
    return ex.score(samples_df(t), make_linear_model(), ["vec_id"])


@query("X10_score_logits", "vec_id:i y_pred_class_name:s prob_low:d",
       TERMS + "SELECT vec_id, CASE WHEN s1 >= s2 AND s1 >= st THEN 'low' WHEN s2 >= st THEN 'medium' ELSE 'high' END AS y_pred_class_name, exp(s1) / (exp(s1) + exp(s2) + exp(st)) AS prob_low FROM f")
def _(t):
    from ..operators.evaluation import class_fields

    linear = make_linear_model()

    def model(a, b, c):
        import numpy as np

        zero_a, zero_b, zero_c = a * 0, b * 0, c * 0
        return np.stack([linear(a, zero_b, zero_c), linear(zero_a, b, zero_c), linear(zero_a, zero_b, c)], axis=1)

    scored = ex.score_logits(samples_df(t), model, ["vec_id"])
    return class_fields(scored.withColumn("true_id", F.lit(0)), "logits", "true_id")


@query("X11_ablate_bands", "vec_id:i band_index:i band_name:s full_prediction:d ablated_prediction:d importance:d",
       TERMS + """SELECT t.vec_id, CAST(floor(pos / 16) AS INT) + 1 AS band_index, 'band_0' || (CAST(floor(pos / 16) AS INT) + 1) AS band_name, max(whole) AS full_prediction,
          max(whole) - sum(c1 + c2) AS ablated_prediction, abs(sum(c1 + c2)) AS importance FROM t JOIN f ON f.vec_id = t.vec_id GROUP BY t.vec_id, CAST(floor(pos / 16) AS INT)""")
def _(t):
    return ex.ablate_bands(samples_df(t), make_linear_model(), CHANNELS, ["vec_id"])


NAMES = ["temp_t1", "rain_t1", "soil_t2", "crop_diff", "slope", "coast", "year"]


@query("X11_ablate_features", "vec_id:i feature_index:i feature_name:s feature_group:s importance:d",
       TERMS + """SELECT vec_id, pos AS feature_index, ['temp_t1', 'rain_t1', 'soil_t2', 'crop_diff', 'slope', 'coast', 'year', 'feature_007'][pos + 1] AS feature_name,
          ['temperature', 'humidity_rainfall', 'water_soil', 'agriculture', 'terrain', 'coastal_distance', 'time', 'other'][pos + 1] AS feature_group, abs(ct) AS importance FROM t WHERE pos < 8""")
def _(t):
    return ex.ablate_features(samples_df(t), make_linear_model(), NAMES, ["vec_id"])


MODALITY_SQL = TERMS + """, m AS (SELECT vec_id, whole, abs(s1 + s2) AS image_contribution, abs(st) AS tabular_contribution, abs(s1) AS t1_contribution, abs(s2) AS t2_contribution,
    abs(whole - (s1 + -0.5e0 * s1 + st)) AS temporal_difference_contribution, abs(whole - (swap1 + swap2 + st)) AS temporal_order_sensitivity FROM f)
    SELECT *, whole AS full_prediction, CASE WHEN image_contribution >= tabular_contribution THEN 'image' ELSE 'tabular' END AS dominant_modality,
    CASE WHEN t1_contribution >= t2_contribution THEN 't1' ELSE 't2' END AS dominant_time_step FROM m"""


@query("X12_ablate_modalities", "vec_id:i full_prediction:d " + " ".join(f"{c}:d" for c in ex.CONTRIBUTIONS) + " dominant_modality:s dominant_time_step:s", MODALITY_SQL)
def _(t):
    return ex.ablate_modalities(samples_df(t), make_linear_model(), ["vec_id"])


def heat_df(t, **kw):
    return ex.occlusion(samples_df(t), make_linear_model(), CHANNELS, SIDE, SIDE, ["vec_id"], window=2, stride=1, **kw)


def heat_sql(mask: str) -> str:
    """Cell means over the covering 2×2 windows of both images."""
    delta = "sum(c)" if mask == "zero" else "sum(c) - sum(m * w)"
    return TERMS + f""", cell AS (SELECT t.vec_id, tgt, CAST(floor(t.pos / 16) AS INT) AS ch, CAST(floor((t.pos % 16) / 4) AS INT) AS y, t.pos % 4 AS x,
        CASE tgt WHEN 't1' THEN c1 ELSE c2 END AS c, CASE tgt WHEN 't1' THEN (t.pos % 5 - 2) / 4e0 ELSE -0.5e0 * (t.pos % 5 - 2) / 4e0 END AS w,
        CASE tgt WHEN 't1' THEN a.v ELSE b.v END AS v FROM t CROSS JOIN (SELECT unnest(['t1', 't2']) AS tgt) g JOIN emb_pix a ON a.vec_id = t.vec_id AND a.pos = t.pos
        JOIN emb_pix b ON b.pos = t.pos AND b.vec_id = (t.vec_id + 1) % (SELECT n FROM n)),
      mean AS (SELECT vec_id, tgt, ch, avg(v) AS m FROM cell GROUP BY vec_id, tgt, ch),
      win AS (SELECT c.vec_id, c.tgt, wy, wx, abs({delta}) AS imp FROM cell c JOIN mean n ON n.vec_id = c.vec_id AND n.tgt = c.tgt AND n.ch = c.ch
        JOIN (SELECT unnest([0, 1, 2]) AS wy) a ON c.y BETWEEN wy AND wy + 1 JOIN (SELECT unnest([0, 1, 2]) AS wx) b ON c.x BETWEEN wx AND wx + 1 GROUP BY c.vec_id, c.tgt, wy, wx),
      heat AS (SELECT vec_id, tgt AS target_image, y, x, avg(imp) AS value FROM win JOIN (SELECT unnest(range(4)) AS y) a ON y BETWEEN wy AND wy + 1 JOIN (SELECT unnest(range(4)) AS x) b ON x BETWEEN wx AND wx + 1
        GROUP BY vec_id, tgt, y, x)"""


@query("X13_occlusion", "vec_id:i target_image:s pos:i value:d", heat_sql("zero") + " SELECT vec_id, target_image, y * 4 + x AS pos, value FROM heat")
def _(t):
    return heat_df(t).select("vec_id", "target_image", F.posexplode("heat").alias("pos", "value"))


@query("X13_occlusion_scores", "vec_id:i target_image:s mean_importance:d max_importance:d",
       heat_sql("mean") + " SELECT vec_id, target_image, avg(value) AS mean_importance, max(value) AS max_importance FROM heat GROUP BY vec_id, target_image")
def _(t):
    return heat_df(t, mask="channel_mean")


@query("X14_stitch", "mosaic:i row:i col:i value:d",
       """WITH p AS (SELECT CAST(floor(vec_id / 10) AS INT) AS mosaic, vec_id, 4 * (vec_id % 4) + 10 AS px, 4 * (vec_id % 3) + 20 AS py FROM embeddings),
          b AS (SELECT mosaic, min(px) AS lx, max(px) AS hx, min(py) AS ly, max(py) AS hy FROM p GROUP BY mosaic),
          c AS (SELECT p.mosaic, px + pos % 8 AS gx, py + CAST(floor(pos / 8) AS INT) AS gy, arg_max(v, p.vec_id) AS v FROM p JOIN emb_pix e ON e.vec_id = p.vec_id GROUP BY ALL)
          SELECT b.mosaic, gy.gy AS row, gx.gx AS col, c.v AS value FROM b JOIN (SELECT unnest(range(40)) AS gx) gx ON gx.gx <= hx + 7 - lx JOIN (SELECT unnest(range(40)) AS gy) gy ON gy.gy <= hy + 7 - ly
          LEFT JOIN c ON c.mosaic = b.mosaic AND c.gx = b.lx + gx.gx AND c.gy = b.ly + gy.gy""")
def _(t):
    maps = t.table("embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("int").alias("mosaic"), "vec_id", (F.col("vec_id") % 4 * 4 + 10).cast("int").alias("x"),
        (F.col("vec_id") % 3 * 4 + 20).cast("int").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("heat"),
    )
    return ex.stitch(maps, ["mosaic"], "vec_id", 8, 8, dense=True)


@query("X14_mosaic_extent", "mosaic:i left:i right:i bottom:i top:i",
       """SELECT CAST(floor(vec_id / 10) AS INT) AS mosaic, min(4 * (vec_id % 4)) AS "left", max(4 * (vec_id % 4)) + 8 AS "right", max(4 * (vec_id % 3)) + 8 AS bottom, min(4 * (vec_id % 3)) AS top
          FROM embeddings GROUP BY CAST(floor(vec_id / 10) AS INT)""")
def _(t):
    maps = t.table("embeddings").select(F.floor(F.col("vec_id") / 10).alias("mosaic"), (F.col("vec_id") % 4 * 4).alias("x"), (F.col("vec_id") % 3 * 4).alias("y"))
    return ex.mosaic_extent(maps, ["mosaic"], 8, 8)


# --- summaries -----------------------------------------------------------------------------

@query("A14_importance_summary", "band_index:i band_name:s sample_count:i mean_importance:d median_importance:d max_importance:d",
       "SELECT band_index, band_name, count(*) AS sample_count, avg(importance) AS mean_importance, median(importance) AS median_importance, max(importance) AS max_importance FROM importances GROUP BY band_index, band_name")
def _(t):
    return ex.importance_summary(t.view("importances"), ["band_index", "band_name"])


@query("A15_importance_by_group", "feature_group:s feature_count:i mean_importance:d max_importance:d",
       """SELECT feature_group, count(*) AS feature_count, avg(m) AS mean_importance, max(m) AS max_importance FROM (
          SELECT CASE band_index % 3 WHEN 0 THEN 'terrain' WHEN 1 THEN 'temperature' ELSE 'other' END AS feature_group, avg(importance) AS m FROM importances GROUP BY band_index) v GROUP BY feature_group""")
def _(t):
    i = t.view("importances")
    name = F.element_at(F.array(F.lit("slope"), F.lit("temp"), F.lit("zzz")), (F.col("band_index") % 3 + 1).cast("int"))
    s = ex.importance_summary(i.withColumn("feature_group", fn.feature_group(name)), ["band_index", "feature_group"])
    return ex.importance_by_group(s)


def modality_df(t):
    s = samples_df(t).withColumns({
        "change_class": fn.change_class("change_ratio"), "pair_type": F.lit("cross_season_sameyear"), "time_gap_group": F.lit("short"),
    })
    return ex.ablate_modalities(s, make_linear_model(), ["vec_id", "change_class", "pair_type", "time_gap_group"])


CLASS_OF = "CASE WHEN label = 0 THEN 'low' WHEN label = 1 THEN 'medium' ELSE 'high' END"


@query("A16_ablation_summary", "metric:s group:s value:d",
       f"WITH r AS ({MODALITY_SQL.replace('WITH w AS', 'WITH w AS', 1)}), j AS (SELECT r.*, {CLASS_OF} AS change_class FROM r JOIN embeddings e ON e.vec_id = r.vec_id) "
       + "SELECT 'num_samples' AS metric, 'all' AS \"group\", count(*)::DOUBLE AS value FROM j UNION ALL "
       + " UNION ALL ".join(f"SELECT 'average_{c}', 'all', avg({c}) FROM j" for c in ex.CONTRIBUTIONS)
       + " UNION ALL SELECT 'dominant_modality_count', dominant_modality, count(*) FROM j GROUP BY dominant_modality UNION ALL SELECT 'dominant_time_step_count', dominant_time_step, count(*) FROM j GROUP BY dominant_time_step"
       + " UNION ALL SELECT 'change_class_count', change_class, count(*) FROM j GROUP BY change_class UNION ALL SELECT 'pair_type_count', 'cross_season_sameyear', count(*) FROM j UNION ALL SELECT 'time_gap_group_count', 'short', count(*) FROM j")
def _(t):
    return ex.ablation_summary(modality_df(t))


@query("A17_occlusion_summary", "metric:s number:d text:s",
       heat_sql("zero") + """, s AS (SELECT vec_id, target_image, avg(value) AS a, max(value) AS b FROM heat GROUP BY vec_id, target_image),
          r AS (SELECT count(*) FILTER (WHERE target_image = 't1') AS n, avg(a) FILTER (WHERE target_image = 't1') AS a1, avg(a) FILTER (WHERE target_image = 't2') AS a2,
                avg(b) FILTER (WHERE target_image = 't1') AS b1, avg(b) FILTER (WHERE target_image = 't2') AS b2 FROM s)
          SELECT 'number_of_samples' AS metric, CAST(n AS DOUBLE) AS number, NULL AS text FROM r UNION ALL SELECT 'average_t1_mean_importance', a1, NULL FROM r UNION ALL SELECT 'average_t2_mean_importance', a2, NULL FROM r
          UNION ALL SELECT 'average_t1_max_importance', b1, NULL FROM r UNION ALL SELECT 'average_t2_max_importance', b2, NULL FROM r
          UNION ALL SELECT 'more_spatially_influential', NULL, CASE WHEN a1 >= a2 THEN 't1' ELSE 't2' END FROM r""")
def _(t):
    s = ex.occlusion_summary(heat_df(t))
    number = F.col("value").try_cast("double")
    return s.select("metric", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


# --- sample choice -------------------------------------------------------------------------

MERGE_PRED = "SELECT patch_id, CASE WHEN x % 128 = 0 THEN '' ELSE pair_id END AS pair_id, CASE WHEN y = 0 THEN NULL ELSE district END AS district, split, change_class, pair_type, time_gap_group, " \
    "CASE WHEN x = 64 THEN NULL ELSE y_true END AS y_true_change_ratio, y_pred AS prediction, abs_error FROM predictions"


@query("J10_merge_predictions", "patch_id:s pair_id:s district:s split:s change_class:s npz_path:s y_true_change_ratio:d y_pred_change_ratio:d abs_error:d",
       """SELECT p.patch_id, i.pair_id, i.district, p.split, p.change_class, i.npz_path, CASE WHEN x = 64 THEN i.change_ratio ELSE y_true END AS y_true_change_ratio, y_pred AS y_pred_change_ratio, abs_error
          FROM predictions p JOIN npz_index i ON i.patch_id = p.patch_id""")
def _(t):
    index = t.view("npz_index")
    twice = index.unionByName(index.filter("change_class = 'low'").withColumn("npz_path", F.concat(F.lit("!"), "npz_path")))
    return ex.merge_predictions(t.sql(MERGE_PRED), twice)


@query("J11_left_merge_coalesce", "patch_id:s district:s change_class:s npz_path:s change_ratio:d abs_error:d",
       """SELECT p.patch_id, coalesce(CASE WHEN y > 0 THEN p.district END, i.district) AS district, p.change_class, i.npz_path, coalesce(i.change_ratio, NULL) AS change_ratio, p.abs_error
          FROM predictions p LEFT JOIN (SELECT * FROM npz_index WHERE change_class <> 'low') i ON i.patch_id = p.patch_id""")
def _(t):
    p = pred_df(t).withColumn("district", F.when(F.col("y") > 0, F.col("district"))).drop("abs_error")
    return ex.left_merge_coalesce(p, t.view("npz_index").filter("change_class <> 'low'"))


N16, N17 = 100, 200
TEST = "(SELECT * FROM predictions WHERE split = 'test')"


def stage16(no: str, reason: str, where: str, sort: str = "''") -> str:
    return f"SELECT patch_id, {no} AS stage, {sort} AS sort_text, {reason} AS reason, md5('42|' || {reason} || '|' || patch_id) AS h FROM {TEST} c WHERE {where}"


W16_SQL = "WITH off AS (" + " UNION ALL ".join(
    [stage16("CASE change_class WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END", "'change_class_' || change_class", "change_class <> 'invalid'"),
     stage16("CASE pair_type WHEN 'same_season_multiyear' THEN 6 WHEN 'cross_season_sameyear' THEN 7 ELSE 8 END", "'pair_type_' || pair_type", "pair_type IS NOT NULL"),
     stage16("CASE time_gap_group WHEN 'short' THEN 9 WHEN 'medium' THEN 10 WHEN 'long' THEN 11 WHEN 'very_long' THEN 12 ELSE 13 END", "'time_gap_group_' || time_gap_group",
             "time_gap_group IN ('short', 'medium', 'long', 'very_long', 'same_year')"),
     stage16("14", "'district_' || district", "district IS NOT NULL", "district")]) + f"""),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY h, patch_id) AS place FROM off),
    lo AS (SELECT patch_id, 4 AS stage, '' AS sort_text, row_number() OVER (ORDER BY abs_error, patch_id) AS place, 'low_prediction_error' AS reason FROM {TEST} c),
    hi AS (SELECT patch_id, 5 AS stage, '' AS sort_text, row_number() OVER (ORDER BY abs_error DESC, patch_id) AS place, 'high_prediction_error' AS reason FROM {TEST} c),
    staged AS (SELECT patch_id, stage, sort_text, place, reason FROM ranked WHERE place <= CASE WHEN stage = 14 THEN 1 ELSE 5 END
               UNION ALL SELECT * FROM lo WHERE place <= 5 UNION ALL SELECT * FROM hi WHERE place <= 5),
    once AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY stage, sort_text, place) AS k FROM staged) s WHERE k = 1),
    rest AS (SELECT patch_id, concat_ws('|', coalesce(change_class, ''), coalesce(pair_type, ''), coalesce(time_gap_group, '')) AS stratum FROM {TEST} c WHERE patch_id NOT IN (SELECT patch_id FROM staged)),
    fill AS (SELECT patch_id, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|fill|' || patch_id), patch_id) + 100 AS stage, stratum AS sort_text, 0 AS place, 'stratified_random_fill' AS reason FROM rest),
    head AS (SELECT * FROM (SELECT * FROM once UNION ALL SELECT * FROM fill) u ORDER BY stage, sort_text, place, patch_id LIMIT {N16})
    SELECT h.patch_id, h.reason AS selection_reason, p.district, p.change_class, p.abs_error, p.pair_type, p.time_gap_group FROM head h JOIN predictions p ON p.patch_id = h.patch_id"""


@query("W16_representative_samples", "patch_id:s selection_reason:s district:s change_class:s abs_error:d", W16_SQL)
def _(t):
    return ex.representative_samples(pred_df(t), N16)


@query("R17_sample_selection_report", "metric:s group:s value:d",
       f"""WITH s AS (SELECT * FROM ({W16_SQL}) w), d AS (SELECT coalesce(district, '') AS g, count(*) AS n FROM s GROUP BY ALL ORDER BY n DESC, g LIMIT 20)
           SELECT 'total_selected' AS metric, 'all' AS "group", count(*)::DOUBLE AS value FROM s UNION ALL SELECT 'district_count', g, n FROM d"""
       + "".join(f" UNION ALL SELECT '{c}_count', coalesce({c}, ''), count(*) FROM s GROUP BY coalesce({c}, '')" for c in ("change_class", "pair_type", "time_gap_group"))
       + " UNION ALL SELECT 'mean_abs_error', 'error_stats', avg(abs_error) FROM s UNION ALL SELECT 'median_abs_error', 'error_stats', median(abs_error) FROM s UNION ALL SELECT 'max_abs_error', 'error_stats', max(abs_error) FROM s")
def _(t):
    return rp.sample_selection_report(cut_lineage(ex.representative_samples(pred_df(t), N16)))


def stage17(no: str, reason: str, source: str, limit: str, sort: str = "''", label: str | None = None) -> str:
    return f"""SELECT patch_id, stage, sort_text, place, label AS reason FROM (SELECT patch_id, {no} AS stage, {sort} AS sort_text, {label or reason} AS label,
        row_number() OVER (PARTITION BY {reason} ORDER BY md5('42|' || {reason} || '|' || patch_id), patch_id) AS place, {limit} AS lim FROM {source} c) r WHERE place <= lim"""


PER = N17 // 12
W17_SQL = "WITH m AS (SELECT p.*, i.npz_path FROM predictions p LEFT JOIN npz_index i ON i.patch_id = p.patch_id), staged AS (" + " UNION ALL ".join(
    [stage17("CASE change_class WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END", "'class_' || change_class", "(SELECT * FROM m WHERE change_class <> 'invalid')", str(PER)),
     stage17("4", "'low_prediction_error'", f"(SELECT * FROM m ORDER BY abs_error, patch_id LIMIT {PER * 2})", str(PER)),
     stage17("5", "'high_prediction_error'", f"(SELECT * FROM m ORDER BY abs_error DESC, patch_id LIMIT {PER * 2})", str(PER)),
     *[stage17(str(6 + i), f"('diverse_{c}|' || {c})", f"(SELECT * FROM m WHERE {c} IS NOT NULL)", f"(SELECT greatest(1, {PER} // count(DISTINCT {c})) FROM m)", f"'diverse_{c}|' || {c}", f"'diverse_{c}'")
       for i, c in enumerate(("district", "pair_type", "time_gap_group"))]]) + f"""),
    once AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY stage, sort_text, place) AS k FROM staged) s WHERE k = 1),
    fill AS (SELECT patch_id, 9 AS stage, md5('42|fill|' || patch_id) AS sort_text, 0 AS place, 'random_fill' AS reason FROM m WHERE patch_id NOT IN (SELECT patch_id FROM staged)),
    head AS (SELECT * FROM (SELECT * FROM once UNION ALL SELECT * FROM fill) u ORDER BY stage, sort_text, place, patch_id LIMIT {N17})
    SELECT h.patch_id, h.reason AS selection_reason, m.npz_path, m.district FROM head h JOIN m ON m.patch_id = h.patch_id"""


@query("W17_handoff_samples", "patch_id:s selection_reason:s npz_path:s district:s", W17_SQL)
def _(t):
    return ex.handoff_samples(pred_df(t), t.view("npz_index"), N17)


@query("W17_chosen_predictions", "patch_id:s experiment:s", f"SELECT patch_id, experiment FROM predictions WHERE patch_id IN (SELECT patch_id FROM ({W17_SQL}) w)")
def _(t):
    p = pred_df(t)
    return ex.chosen_predictions(p, ex.handoff_samples(p, t.view("npz_index"), N17))


# --- case studies --------------------------------------------------------------------------

def case_inputs(t):
    e = t.table("embeddings")
    pid = F.concat(F.lit("P"), F.col("vec_id").cast("string"))
    cls = fn.change_class(F.col("label") / 10)
    selected = e.select(
        F.col("vec_id").alias("row_no"), pid.alias("patch_id"), F.concat(F.lit("D"), F.col("label").cast("string")).alias("district"),
        F.concat(F.lit("R"), F.col("vec_id").cast("string")).alias("pair_id"), cls.alias("change_class"),
        F.when(F.col("vec_id") % 3 > 0, F.col("label") / 10).alias("y_true_change_ratio"), F.lit(None).cast("double").alias("y_pred_change_ratio"),
        F.when(F.col("vec_id") % 5 > 0, F.col("label") / 20).alias("abs_error"),
    )
    ablation = e.filter("vec_id % 7 > 0").select(
        pid.alias("patch_id"), (F.col("label") / 10).alias("target_change_ratio"), (F.col("label") / 8).alias("full_prediction"),
        F.lit("image").alias("dominant_modality"), F.lit("t2").alias("dominant_time_step"),
    )
    imp = t.view("importances")
    bands = imp.filter("band_index <= 13")
    feats = imp.filter("band_index > 13").withColumn("feature_name", F.concat(F.lit("f"), F.col("band_index").cast("string")))
    occ = e.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "vec_id").select(
        (F.col("vec_id") * 2 + F.col("k")).alias("row_no"), F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("patch_id"),
        F.concat(F.lit("/o/"), F.col("vec_id").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("overlay_path"),
        F.concat(F.lit("/s/"), F.col("vec_id").cast("string")).alias("side_by_side_path"),
    )
    cams = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("row_no"), pid.alias("patch_id"), F.concat(F.lit("/c/"), F.col("vec_id").cast("string")).alias("overlay_path"))
    return selected, ablation, bands, feats, occ, cams


def best_sql(where: str, prefix: str, k: int) -> str:
    return f"""SELECT patch_id, list(item ORDER BY rn) AS items FROM (SELECT patch_id, format('{prefix}{{}} ({{:.6f}})', band_index, importance) AS item,
        row_number() OVER (PARTITION BY patch_id ORDER BY importance DESC, '{prefix}' || band_index) AS rn FROM importances WHERE {where}) z WHERE rn <= {k} GROUP BY patch_id"""


@query("J16_case_studies",
       "patch_id:s district:s true_change_ratio:d predicted_change_ratio:d absolute_error:d dominant_modality:s top_bands:s top_tabular_features:s occlusion_paths:s gradcam_paths:s plain_english_explanation:s",
       f"""WITH b AS ({best_sql('band_index <= 13', 'band_', 3)}), f AS ({best_sql('band_index > 13', 'f', 5)}),
       v AS (SELECT vec_id, 'P' || vec_id AS patch_id, 'D' || label AS district, {CLASS_OF} AS cls, CASE WHEN vec_id % 3 > 0 OR vec_id % 7 > 0 THEN label / 10e0 END AS tr,
             CASE WHEN vec_id % 7 > 0 THEN label / 8e0 END AS pr, CASE WHEN vec_id % 5 > 0 THEN label / 20e0 END AS er FROM embeddings)
       SELECT v.patch_id, district, tr AS true_change_ratio, pr AS predicted_change_ratio, er AS absolute_error, CASE WHEN vec_id % 7 > 0 THEN 'image' ELSE '' END AS dominant_modality,
         array_to_string(b.items, '; ') AS top_bands, array_to_string(f.items, '; ') AS top_tabular_features,
         '/o/' || vec_id || '_0; /s/' || vec_id || '; /o/' || vec_id || '_1' AS occlusion_paths, CASE WHEN vec_id % 2 = 0 THEN '/c/' || vec_id ELSE '' END AS gradcam_paths,
         CASE WHEN tr IS NOT NULL AND pr IS NOT NULL THEN format('For this {{}} change sample in {{}}, the model predicted {{:.3f}} against a true value of {{:.3f}} ', cls, district, pr, tr)
              ELSE 'For this ' || cls || ' change sample, the model prediction metadata is incomplete ' END
         || CASE WHEN er IS NOT NULL THEN format('with absolute error {{:.3f}}. ', er) ELSE '. ' END
         || CASE WHEN vec_id % 7 > 0 THEN 'The ablation results suggest the image modality was more influential. The t2 image contributed more strongly in the temporal comparison. ' ELSE '' END
         || 'Top image bands were ' || array_to_string(b.items, ', ') || '. ' || 'Top tabular drivers were ' || array_to_string(f.items[1:3], ', ') || '.' AS plain_english_explanation
       FROM v JOIN b ON b.patch_id = v.patch_id JOIN f ON f.patch_id = v.patch_id""")
def _(t):
    return ex.case_studies(*case_inputs(t), max_cases=None)
