"""Queries over prediction metrics, comparison, ranking and maps."""

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from .registry import query

METRICS = "mae:d mse:d rmse:d r2:d pearson_corr:d mean_pred:d mean_target:d"
REG = """avg(abs(y_pred - y_true)) AS mae, avg((y_pred - y_true) * (y_pred - y_true)) AS mse, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
    CASE WHEN var_pop(y_true) > 0 THEN 1 - avg((y_pred - y_true) * (y_pred - y_true)) / var_pop(y_true) END AS r2,
    CASE WHEN min(y_true) < max(y_true) AND min(y_pred) < max(y_pred) THEN corr(y_pred, y_true) END AS pearson_corr, avg(y_pred) AS mean_pred, avg(y_true) AS mean_target"""


def pred_df(t):
    """Predictions under the operator's column names, with class fields."""
    p = t.view("predictions").withColumnsRenamed({"y_true": "y_true_change_ratio", "y_pred": "y_pred_change_ratio"})
    return p.withColumn("correct", F.col("pred_id") == F.col("true_id"))


@query("A5_regression_metrics", "experiment:s district:s " + METRICS, f"SELECT experiment, district, {REG} FROM predictions GROUP BY experiment, district")
def _(t):
    return ev.regression_metrics(pred_df(t), by=["experiment", "district"])


@query("A5_regression_metrics_constant", "x:i mae:d r2:d pearson_corr:d", "SELECT x, avg(abs(y_pred - 0.5e0)) AS mae, NULL AS r2, NULL AS pearson_corr FROM predictions GROUP BY x")
def _(t):
    return ev.regression_metrics(pred_df(t).withColumn("y_true_change_ratio", F.lit(0.5)), by=["x"])


CM_SQL = """SELECT a.i AS true_class, b.i AS pred_class, count(p.patch_id) AS count FROM (SELECT unnest(range(3)) AS i) a CROSS JOIN (SELECT unnest(range(3)) AS i) b
    LEFT JOIN predictions p ON p.true_id = a.i AND p.pred_id = b.i AND p.x > 0 GROUP BY a.i, b.i"""


def cm_df(t):
    p = pred_df(t).withColumn("pred_id", F.when(F.col("x") == 0, 7).otherwise(F.col("pred_id")))
    return ev.confusion_matrix(p, "pred_id", "true_id")


@query("A6_confusion_matrix", "true_class:i pred_class:i count:i", CM_SQL)
def _(t):
    return cm_df(t)


CLS_SQL = f"""
    WITH cm AS ({CM_SQL}), k AS (SELECT c, CAST(sum(count) FILTER (WHERE true_class = c AND pred_class = c) AS DOUBLE) AS tp, CAST(sum(count) FILTER (WHERE pred_class = c) AS DOUBLE) AS pp,
       CAST(sum(count) FILTER (WHERE true_class = c) AS DOUBLE) AS sup FROM cm, (SELECT unnest(range(3)) AS c) r GROUP BY c),
    s AS (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS r FROM k), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM s)
    SELECT sum(tp) / sum(sup) AS accuracy, avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * sup) / sum(sup) AS weighted_f1,
           max(r) FILTER (WHERE c = 0) AS class_accuracy_low, max(r) FILTER (WHERE c = 1) AS class_accuracy_medium, max(r) FILTER (WHERE c = 2) AS class_accuracy_high FROM f"""
CLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "class_accuracy_low", "class_accuracy_medium", "class_accuracy_high"]


@query("A7_classification_metrics", " ".join(f"{c}:d" for c in CLS), CLS_SQL)
def _(t):
    return ev.classification_metrics(cm_df(t))


@query("A8_multitask_metrics", "metric:s value:d",
       f"""WITH r AS (SELECT {REG} FROM predictions), c AS (SELECT * FROM ({CLS_SQL.replace(' AND p.x > 0', '')}) z)
           SELECT 'reg_' || metric AS metric, value FROM (SELECT * FROM r) UNPIVOT INCLUDE NULLS (value FOR metric IN (mae, mse, rmse, r2, pearson_corr, mean_pred, mean_target))
           UNION ALL SELECT 'cls_' || metric, value FROM (SELECT * FROM c) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(CLS)}))""")
def _(t):
    return ev.multitask_metrics(pred_df(t), "y_pred_change_ratio", "y_true_change_ratio", "pred_id", "true_id")


def ce_sql(weights, eps) -> str:
    lse = "(greatest(z0, z1, z2) + ln(exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))))"
    w = f"CASE true_id WHEN 0 THEN {weights[0]}e0 WHEN 1 THEN {weights[1]}e0 ELSE {weights[2]}e0 END"
    z = "CASE true_id WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END"
    spread = " + ".join(f"{weights[i]}e0 * ({lse} - z{i})" for i in range(3))
    return f"sum({1 - eps}e0 * {w} * ({lse} - {z}) + {eps}e0 / 3 * ({spread})) / sum({w})"


LOSS_KINDS = {
    "mse": "(y_pred - y_true) * (y_pred - y_true)", "mae": "abs(y_pred - y_true)",
    "huber": "CASE WHEN abs(y_pred - y_true) <= 1e-1 THEN 5e-1 * (y_pred - y_true) * (y_pred - y_true) ELSE 1e-1 * (abs(y_pred - y_true) - 5e-2) END",
    "smooth_l1": "CASE WHEN abs(y_pred - y_true) < 1e-1 THEN 5e-1 * (y_pred - y_true) * (y_pred - y_true) / 1e-1 ELSE abs(y_pred - y_true) - 5e-2 END",
}


@query("A9_loss", "experiment:s kind:s regression_loss:d classification_loss:d total_loss:d",
       " UNION ALL ".join(
           f"SELECT experiment, '{k}' AS kind, avg({e}) AS regression_loss, {ce_sql((1, 2, 3), 0.1)} AS classification_loss, avg({e}) * 2 + {ce_sql((1, 2, 3), 0.1)} * 0.5e0 AS total_loss FROM predictions GROUP BY experiment"
           for k, e in LOSS_KINDS.items()))
def _(t):
    p = pred_df(t).withColumn("logits", F.array("z0", "z1", "z2"))
    out = None
    for kind in LOSS_KINDS:
        part = ev.loss(p, "y_pred_change_ratio", "y_true_change_ratio", "logits", "true_id", kind, 0.1, (1, 2, 3), 0.1, 2.0, 0.5,
                       by=["experiment"]).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("A10_group_summary", "dimension:s value:s count:i mae:d rmse:d mean_true_change_ratio:d mean_predicted_change_ratio:d accuracy:d",
       " UNION ALL ".join(
           f"""SELECT '{d}' AS dimension, {d} AS value, count(*) AS count, avg(abs_error) AS mae, sqrt(avg(squared_error)) AS rmse, avg(y_true) AS mean_true_change_ratio,
               avg(y_pred) AS mean_predicted_change_ratio, avg(CASE WHEN pred_id = true_id THEN 1e0 ELSE 0e0 END) AS accuracy FROM predictions GROUP BY {d}""" for d in ev.GROUP_DIMENSIONS))
def _(t):
    return ev.group_summary(pred_df(t))


@query("A11_error_comparison", "experiment:s dimension:s value:s count:i mean_abs_error:d median_abs_error:d rmse:d max_abs_error:d mean_true_change_ratio:d mean_pred_change_ratio:d",
       " UNION ALL ".join(
           f"""SELECT experiment, '{n}' AS dimension, {e} AS value, count(*) AS count, avg(abs_error) AS mean_abs_error, median(abs_error) AS median_abs_error, sqrt(avg(squared_error)) AS rmse,
               max(abs_error) AS max_abs_error, avg(y_true) AS mean_true_change_ratio, avg(y_pred) AS mean_pred_change_ratio FROM predictions GROUP BY experiment, {e}"""
           for n, e in [("overall", "'all'"), *[(d, d) for d in ev.ERROR_DIMENSIONS]]))
def _(t):
    return ev.error_comparison(pred_df(t))


EXPERIMENTS = """SELECT 'cnn_regression' AS experiment UNION ALL SELECT 'swin_regression' UNION ALL SELECT 'maxvit_regression'"""
RESULTS_SQL = f"""SELECT e.experiment, split_part(e.experiment, '_', 1) AS model_name, mae, rmse, r2, pearson_corr, n AS prediction_count, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status
    FROM ({EXPERIMENTS}) e LEFT JOIN (SELECT experiment, count(*) AS n, {REG} FROM predictions GROUP BY experiment) p ON p.experiment = e.experiment"""


def results_df(t):
    p = pred_df(t)
    long = ev.as_long(ev.regression_metrics(p, by=["experiment"]), keys=["experiment"])
    # one experiment reports its metrics under prefixed names
    swin = F.col("experiment") == "swin_regression"
    named = long.withColumn("metric", F.when(swin, F.concat(F.lit("reg_"), "metric")).otherwise(F.col("metric")))
    return ev.collect_results(named.withColumn("value", F.col("value").cast("string")), p, t.sql(EXPERIMENTS))


@query("A12_collect_results", "experiment:s model_name:s mae:d rmse:d r2:d pearson_corr:d prediction_count:i status:s", RESULTS_SQL)
def _(t):
    return results_df(t)


PER_X = f"SELECT CAST(x AS VARCHAR) AS experiment, {REG} FROM predictions GROUP BY x"


def per_x(t):
    return ev.regression_metrics(pred_df(t).withColumn("experiment", F.col("x").cast("string")), by=["experiment"]).withColumn("status", F.lit("ok"))


@query("A13_best_by_metric", "metric:s experiment:s value:d",
       f"""WITH r AS ({PER_X}) SELECT 'rmse' AS metric, arg_min(experiment, rmse) AS experiment, min(rmse) AS value FROM r UNION ALL SELECT 'mae', arg_min(experiment, mae), min(mae) FROM r
           UNION ALL SELECT 'r2', arg_max(experiment, r2), max(r2) FROM r UNION ALL SELECT 'pearson_corr', arg_max(experiment, pearson_corr), max(pearson_corr) FROM r""")
def _(t):
    return ev.best_by_metric(per_x(t))


@query("W1_rank_models", "experiment:s rmse:d rank:i",
       f"""WITH r AS (SELECT experiment, CASE WHEN experiment IN ('0', '64') THEN NULL ELSE rmse END AS rmse FROM ({PER_X}) p)
           SELECT experiment, rmse, CASE WHEN rmse IS NOT NULL THEN row_number() OVER (ORDER BY rmse ASC NULLS LAST, experiment) END AS rank FROM r""")
def _(t):
    r = per_x(t)
    return ev.rank_models(r.withColumn("rmse", F.when(~F.col("experiment").isin("0", "64"), F.col("rmse"))))


@query("R20_prediction_pairs", "district:s pair_id:s patch_count:i", "SELECT district, pair_id, count(*) AS patch_count FROM predictions GROUP BY district, pair_id")
def _(t):
    return ev.prediction_pairs(pred_df(t))


@query("R21_map_report", "district:s pair_id:s patches:i mean_predicted:d max_predicted:d mean_true:d mean_error:d",
       "SELECT district, pair_id, count(*) AS patches, avg(y_pred) AS mean_predicted, max(y_pred) AS max_predicted, avg(CASE WHEN x > 0 THEN y_true END) AS mean_true, avg(abs_error) AS mean_error FROM predictions GROUP BY district, pair_id")
def _(t):
    p = pred_df(t).withColumn("y_true_change_ratio", F.when(F.col("x") > 0, F.col("y_true_change_ratio")).otherwise(float("inf")))
    return ev.map_report(p)


@query("X15_dense_grid", "pair_id:s x:i y:i x_end:i y_end:i value:d",
       """WITH xs AS (SELECT pair_id, x, coalesce(lead(x) OVER (PARTITION BY pair_id ORDER BY x), x + 128) AS x_end FROM (SELECT DISTINCT pair_id, x FROM predictions) a),
          ys AS (SELECT pair_id, y, coalesce(lead(y) OVER (PARTITION BY pair_id ORDER BY y), y + 128) AS y_end FROM (SELECT DISTINCT pair_id, y FROM predictions) b),
          v AS (SELECT pair_id, x, y, arg_max(y_pred, patch_id) AS value FROM predictions GROUP BY pair_id, x, y)
          SELECT xs.pair_id, xs.x, ys.y, x_end, y_end, value FROM xs JOIN ys ON ys.pair_id = xs.pair_id LEFT JOIN v ON v.pair_id = xs.pair_id AND v.x = xs.x AND v.y = ys.y""")
def _(t):
    return ev.dense_grid(pred_df(t), "y_pred_change_ratio")


@query("W18_top_patches", "patch_id:s x:i y:i predicted_change_ratio:d absolute_error:d",
       """SELECT patch_id, x, y, y_pred AS predicted_change_ratio, abs_error AS absolute_error FROM predictions WHERE pair_id = 'P7' AND district = (SELECT min(district) FROM predictions WHERE pair_id = 'P7')
          ORDER BY abs_error DESC, patch_id LIMIT 40""")
def _(t):
    from ..operators.evaluation import top_patches

    p = pred_df(t)
    district = p.filter("pair_id = 'P7'").agg(F.min("district")).first()[0]
    return top_patches(p.drop("x", "y"), district, "P7", 40, "absolute_error")
