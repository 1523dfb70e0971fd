"""Queries over label filters, capped selections and their reports, set operations."""

from pyspark.sql import functions as F

from ..operators import selection as se
from ..operators.greedy import capped_selection
from ..operators.ranking import even_sample, first_by_key, slice_rows, top_k
from ..plans import reports as rp
from .q_rasters import REPORT, counts_sql, metrics_sql
from .registry import query

DIMS = ("split", "district", "pair_type", "time_gap_group")
TARGETS = {"train": 5000, "val": 500, "test": 1700}


def picks(source: str, group: str, keep: str) -> str:
    """Even sample as SQL: rows at round-half-even(i·(n−1)/(m−1)) of the (y, x, hash) order."""
    return f"""(SELECT * FROM (SELECT s.*, {keep} AS m, count(*) OVER (PARTITION BY {group}) AS n,
          row_number() OVER (PARTITION BY {group} ORDER BY y, x, md5('42|' || patch_id), patch_id) - 1 AS pos FROM {source} s) r
        WHERE n <= m OR (m <= 1 AND pos < m) OR (m > 1 AND list_contains(
          list_transform(range(m), lambda i: CAST(round_even(CAST(i * (n - 1) AS DOUBLE) / greatest(m - 1, 1), 0) AS BIGINT)), pos)))"""


CAP = "(CASE change_class WHEN 'low' THEN 50 WHEN 'medium' THEN 40 ELSE 20 END)"
W7_SQL = f"""
    WITH base AS (SELECT * FROM valid_labeled), cnt AS (SELECT split, change_class, count(*) AS all_rows FROM base GROUP BY split, change_class),
    picked AS (SELECT * EXCLUDE (m, n, pos) FROM {picks('base', 'split, change_class, pair_id', CAP)}),
    kept AS (SELECT split, change_class, count(*) AS k FROM picked GROUP BY split, change_class),
    capped AS (SELECT p.*, p.change_class || '_pair_cap_' || {CAP.replace('change_class', 'p.change_class')} AS stage, CAST(k AS DOUBLE) / all_rows AS weight
               FROM picked p JOIN kept k ON k.split = p.split AND k.change_class = p.change_class JOIN cnt c ON c.split = p.split AND c.change_class = p.change_class)
"""


@query("F21_valid_labels", "patch_id:s change_ratio:d change_class:s", "SELECT patch_id, change_ratio, change_class FROM valid_labeled")
def _(t):
    return se.valid_labels(t.view("labeled"))


@query("W5_top_k_per_key", "pair_id:s patch_id:s change_ratio:d rank:i",
       """SELECT * FROM (SELECT pair_id, patch_id, change_ratio, row_number() OVER (PARTITION BY pair_id ORDER BY change_ratio DESC, patch_id) AS rank FROM valid_labeled) v
          WHERE rank <= 3""")
def _(t):
    return top_k(se.valid_labels(t.view("labeled")), ["pair_id"], [F.desc("change_ratio"), "patch_id"], 3, "rank")


@query("W6_even_sample", "patch_id:s district:s x:i y:i", f"SELECT patch_id, district, x, y FROM {picks('labeled', 'district', '700')}")
def _(t):
    return even_sample(t.view("labeled"), ["district"], 700, crowded=True)


@query("W6_even_sample_without_places", "o_orderkey:i o_custkey:i",
       "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM orders) v WHERE rn <= 4")
def _(t):
    return even_sample(t.table("orders"), ["o_custkey"], 4, key="o_orderkey")


@query("W7_class_pair_cap", "patch_id:s split:s change_class:s selection_stage:s class_sampling_weight:d",
       W7_SQL + "SELECT patch_id, split, change_class, stage AS selection_stage, weight AS class_sampling_weight FROM capped")
def _(t):
    return se.class_pair_cap(se.valid_labels(t.view("labeled")))


@query("W8_high_district_cap", "patch_id:s split:s district:s selection_stage:s",
       f"SELECT patch_id, split, district, 'high|high_district_soft_cap' AS selection_stage FROM {picks('(SELECT * FROM valid_labeled WHERE change_class = ' + repr('high') + ')', 'split, district', '400')}")
def _(t):
    high = se.valid_labels(t.view("labeled")).filter("change_class = 'high'").withColumn("selection_stage", F.lit("high"))
    return se.high_district_cap(high, 5000)


W9_SQL = W7_SQL + f""", lm AS (SELECT * FROM capped WHERE change_class <> 'high'),
    goal AS (SELECT t.split, CASE WHEN t.target - coalesce(n, 0) > 0 THEN least(CAST(round_even(coalesce(n, 0) * 1.3::DOUBLE, 0) AS BIGINT), t.target - coalesce(n, 0))
             ELSE CAST(round_even(coalesce(n, 0) * 1.3::DOUBLE, 0) AS BIGINT) END AS goal
             FROM (VALUES ('train', 5000), ('val', 500), ('test', 1700)) t(split, target) LEFT JOIN (SELECT split, count(*) AS n FROM lm GROUP BY split) l ON l.split = t.split),
    high AS (SELECT c.*, g.goal FROM capped c JOIN goal g ON g.split = c.split WHERE c.change_class = 'high' AND g.goal > 0),
    spread AS (SELECT * EXCLUDE (m, n, pos) FROM {picks('high', 'split, district', 'greatest(300, CAST(round_even(goal * 0.08::DOUBLE, 0) AS BIGINT))')}),
    fin AS (SELECT *, n > goal AS over FROM {picks('spread', 'split', 'goal')}),
    chosen AS (SELECT patch_id, split, district, pair_id, pair_type, time_gap_group, change_class, change_ratio, label_status, stage AS selection_stage, weight FROM lm
               UNION ALL SELECT patch_id, split, district, pair_id, pair_type, time_gap_group, change_class, change_ratio, label_status,
               stage || '|high_district_soft_cap' || CASE WHEN over THEN '|high_target_cap' ELSE '' END, weight FROM fin)
"""


@query("W9_balanced_selection", "patch_id:s split:s change_class:s selection_stage:s", W9_SQL + "SELECT * FROM chosen")
def _(t):
    return se.balanced_selection(se.valid_labels(t.view("labeled")), TARGETS)


def final_df(t):
    return se.final_selection(t.view("labeled"), TARGETS)


@query("W10_final_selection", "patch_id:s split:s change_class:s selection_stage:s class_sampling_weight:d final_selected:b",
       W9_SQL + "SELECT *, weight AS class_sampling_weight, selection_stage || '|pair_type_checked' AS selection_stage, true AS final_selected FROM (SELECT * EXCLUDE (selection_stage), selection_stage FROM chosen) c"
       .replace("SELECT *, weight", "SELECT * EXCLUDE (selection_stage), weight"))
def _(t):
    return final_df(t)


@query("W11_pair_cap", "patch_id:s selection_stage:s", f"SELECT patch_id, 'all|pair_diversity' AS selection_stage FROM {picks('labeled', 'pair_id', '30')}")
def _(t):
    return se.pair_cap(t.view("labeled").withColumn("selection_stage", F.lit("all")))


@query("W11_district_cap", "patch_id:s selection_stage:s",
       """SELECT patch_id, 'all|district_diversity' AS selection_stage FROM (SELECT patch_id, row_number() OVER (PARTITION BY district ORDER BY md5('42|' || patch_id), patch_id) AS rn
          FROM labeled) v WHERE rn <= 500""")
def _(t):
    return se.district_cap(t.view("labeled").withColumn("selection_stage", F.lit("all")), 500)


@query("W19_slice_rows", "o_orderkey:i o_custkey:i",
       "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) v WHERE rn >= 1000 AND rn < 6000")
def _(t):
    return slice_rows(t.table("orders"), "o_orderkey", 1000, 9000, 5000)


@query("J15_removed_rows", "patch_id:s", W9_SQL + "SELECT patch_id FROM valid_labeled WHERE patch_id NOT IN (SELECT patch_id FROM chosen)")
def _(t):
    return se.removed_rows(se.valid_labels(t.view("labeled")), final_df(t))


@query("V4_selection_faults", "metric:s value:i",
       """WITH b AS (SELECT * FROM labeled UNION ALL SELECT * FROM labeled WHERE x = 0)
          SELECT unnest(['duplicate_patch_ids', 'non_success_status', 'invalid_change_class', 'missing_change_ratio']) AS metric,
          unnest([count(*) - count(DISTINCT patch_id), count(*) FILTER (WHERE label_status <> 'success'), count(*) FILTER (WHERE change_class = 'invalid'),
                  count(*) FILTER (WHERE change_ratio IS NULL)]) AS value FROM b""")
def _(t):
    lab = t.view("labeled")
    return se.selection_faults(lab.unionByName(lab.filter("x = 0")))


@query("R14_success_filter_report", "metric:s value:d",
       "SELECT value AS metric, count AS value FROM (" + metrics_sql(
           "labeled", total_input_rows="count(*)", success_rows="count(*) FILTER (WHERE label_status = 'success')",
           invalid_low_valid_ratio_rows="count(*) FILTER (WHERE label_status = 'invalid_low_valid_ratio')", failed_rows="count(*) FILTER (WHERE label_status = 'failed')")
       + " UNION ALL " + metrics_sql("valid_labeled", valid_successful_rows="count(*)", **{f"true_successful_{c}_count": f"count(*) FILTER (WHERE change_class = '{c}')" for c in ("low", "medium", "high")}) + ") v")
def _(t):
    return rp.success_filter_report(t.view("labeled"))


@query("R15_label_distribution", REPORT, counts_sql("labeled", **{f"counts_by_{c}": c for c in (*DIMS, "change_class")}))
def _(t):
    return rp.label_distribution(t.view("labeled"))


@query("R15_usage_tables", REPORT, counts_sql("labeled", patches_per_pair_id="pair_id", patches_per_district="district", patches_per_raster_pair="dw_path_t1 || '|' || dw_path_t2"))
def _(t):
    return rp.usage_tables(t.view("labeled"))


@query("A23_describe_stats", "part:s statistic:s value:d",
       " UNION ALL ".join(
           f"""SELECT '{p}' AS part, unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic, unnest([CAST(count(v) AS DOUBLE), avg(v), stddev_samp(v), min(v),
               quantile_cont(v, 0.25::DOUBLE), quantile_cont(v, 0.5::DOUBLE), quantile_cont(v, 0.75::DOUBLE), max(v)]) AS value FROM ({s}) s"""
           for p, s in (("change_ratio", "SELECT change_ratio AS v FROM labeled"), ("patches_per_pair", "SELECT CAST(count(*) AS DOUBLE) AS v FROM labeled GROUP BY pair_id"))))
def _(t):
    lab = t.view("labeled")
    return rp.describe_stats(lab, "change_ratio").withColumn("part", F.lit("change_ratio")).unionByName(
        rp.patches_per_pair_stats(lab).withColumn("part", F.lit("patches_per_pair"))
    )


@query("R16_selection_summary", "metric:s value:d",
       W9_SQL + """, c AS (SELECT count(*) AS n FROM chosen GROUP BY pair_id), o AS (SELECT count(*) AS n FROM valid_labeled), f AS (SELECT count(*) AS n FROM chosen)
       SELECT 'original_valid_patch_count' AS metric, CAST(n AS DOUBLE) AS value FROM o UNION ALL SELECT 'final_selected_patch_count', n FROM f
       UNION ALL SELECT 'reduction_ratio', CAST(f.n AS DOUBLE) / o.n FROM o, f UNION ALL SELECT 'max_patches_per_pair_final', max(n) FROM c
       UNION ALL SELECT 'mean_patches_per_pair_final', avg(n) FROM c UNION ALL SELECT 'final_split_' || split, count(*) FROM chosen GROUP BY split""")
def _(t):
    return rp.selection_summary(se.valid_labels(t.view("labeled")), final_df(t))


@query("R16_distribution_report", "dimension:s value:s original_count:i final_count:i removed_count:i final_ratio:d",
       W9_SQL + " UNION ALL ".join(
           f"""SELECT '{c}' AS dimension, o.{c} AS value, o.n AS original_count, coalesce(f.n, 0) AS final_count, o.n - coalesce(f.n, 0) AS removed_count,
               coalesce(f.n, 0) / CAST((SELECT count(*) FROM chosen) AS DOUBLE) AS final_ratio
               FROM (SELECT {c}, count(*) AS n FROM valid_labeled GROUP BY {c}) o LEFT JOIN (SELECT {c}, count(*) AS n FROM chosen GROUP BY {c}) f ON f.{c} = o.{c}"""
           for c in ("change_class", "district", "pair_type", "time_gap_group")))
def _(t):
    return rp.distribution_report(se.valid_labels(t.view("labeled")), final_df(t))


@query("R16_removed_summary", REPORT,
       W9_SQL + ", rem AS (SELECT * FROM valid_labeled WHERE patch_id NOT IN (SELECT patch_id FROM chosen))  , per_value AS ("
       + counts_sql("rem", top_removed_district="district", removed_change_class="change_class", removed_pair_type="pair_type",
                    removed_time_gap_group="time_gap_group", top_removed_pair_id="pair_id")
       + """) SELECT summary_type, value, count FROM (SELECT *, row_number() OVER (PARTITION BY summary_type ORDER BY count DESC, value) AS rn FROM per_value) r WHERE rn <= 50
           UNION ALL SELECT 'metric', 'removed_count', count(*) FROM rem UNION ALL SELECT 'metric', 'valid_original_count', count(*) FROM valid_labeled
           UNION ALL SELECT 'metric', 'final_count', count(*) FROM chosen""")
def _(t):
    return rp.removed_summary(se.valid_labels(t.view("labeled")), final_df(t))


@query("V1_union_by_name", "district:s year:i season:s price_mean:d source:s",
       """SELECT district, year, season, price_mean, NULL AS source FROM seasonal UNION ALL SELECT district, year, season, NULL, 'image' FROM images""")
def _(t):
    s = t.view("seasonal").select("district", "year", "season", "price_mean")
    i = t.view("images").select("season", "year", "district", F.lit("image").alias("source"))
    return s.unionByName(i, allowMissingColumns=True)


@query("V2_distinct_by_key", "pair_id:s patch_id:s",
       "SELECT pair_id, patch_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY y, x, patch_id) AS rn FROM labeled) v WHERE rn = 1")
def _(t):
    return first_by_key(t.view("labeled"), ["pair_id"], ["y", "x", "patch_id"])


@query("V3_set_difference", "part:s image_id:s",
       """SELECT 'only_images' AS part, image_id FROM (SELECT image_id FROM images EXCEPT SELECT image_id FROM sensor_b) a
          UNION ALL SELECT 'both', image_id FROM (SELECT image_id FROM images INTERSECT SELECT image_id FROM sensor_b) b""")
def _(t):
    i, b = t.view("images").select("image_id"), t.view("sensor_b").select("image_id")
    return i.join(b, "image_id", "left_anti").distinct().select(F.lit("only_images").alias("part"), "image_id").unionByName(
        i.intersect(b).select(F.lit("both").alias("part"), "image_id")
    )


@query("R6_pair_report", REPORT,
       metrics_sql("pairs", total_candidate_pairs="count(*)", same_season_count="count(*) FILTER (WHERE same_season)", cross_season_count="count(*) FILTER (WHERE cross_season)")
       + " UNION ALL " + metrics_sql("images", total_input_images="count(*)") + " UNION ALL "
       + counts_sql("pairs", **{f"pairs_by_{c}": c for c in (*DIMS, "time_gap_years")}))
def _(t):
    return rp.pair_report(t.view("pairs"), t.view("images"))


@query(
    "W12_capped_selection_one", "patch_id:s pair_id:s",
    "SELECT patch_id, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY x, patch_id) AS rn FROM labeled) r WHERE rn <= 7",
)
def _(t):
    rows = t.view("labeled").select("patch_id", "pair_id", "x")
    return capped_selection(rows, "patch_id", ["x", "patch_id"], [(F.col("pair_id"), F.lit(7))])


# every row in turn, against counters of both of its resources
TWO_SQL = """
    WITH RECURSIVE turn AS (SELECT c_custkey, c_nationkey + 1 AS a, c_custkey % 40 + 1 AS b, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS i FROM customer),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS c_custkey, FALSE AS fits, list_transform(range(25), lambda x: CAST(0 AS BIGINT)) AS used_a,
               list_transform(range(40), lambda x: CAST(0 AS BIGINT)) AS used_b
        UNION ALL
        SELECT i, c_custkey, fits, list_transform(used_a, lambda x, k: x + CASE WHEN fits AND k = a THEN 1 ELSE 0 END),
               list_transform(used_b, lambda x, k: x + CASE WHEN fits AND k = b THEN 1 ELSE 0 END)
        FROM (SELECT t.i, t.c_custkey, t.a, t.b, w.used_a, w.used_b, w.used_a[t.a] < 9 AND w.used_b[t.b] < 5 AS fits FROM walk w JOIN turn t ON t.i = w.i + 1) s)
    SELECT c_custkey FROM walk WHERE fits"""


@query("W12_capped_selection_two", "c_custkey:i", TWO_SQL)
def _(t):
    nation, group = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("g"), F.col("c_custkey") % 40)
    rows = t.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return capped_selection(rows, "c_custkey", ["c_mktsegment", "c_custkey"], [(nation, F.lit(9)), (group, F.lit(5))])
