"""Physical plans: what must and must not appear in them."""

from pyspark.sql import functions as F

from pairscape.operators import pairs as pr, ranking as rk, selection as se, tabular as tb


def plan(df):
    return df._jdf.queryExecution().toString()


def images(spark):
    return spark.createDataFrame(
        [("d", "train", 2016, "Winter", "i1"), ("d", "train", 2017, "Winter", "i2")],
        "district string, split string, year int, season string, image_id string")


def test_joins_have_keys(spark):
    candidates = pr.forward_pairs(images(spark)).withColumn("time_gap_group", F.lit("short"))
    tab = spark.createDataFrame([("d", 2016, "Winter", 1.0)], "district string, year int, season string, temp double")
    for df in (candidates, tb.pair_features(candidates, tab), tb.between_features(candidates, tab)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert plan(rk.top_k(df, ["g"], ["id"], 2)).count("WindowGroupLimit") >= 2
    assert "WindowGroupLimit" in plan(rk.first_by_key(df, ["g"], ["id"]))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/labeled"
    spark.createDataFrame([("p", "success", 0.5, "high", "x")], "patch_id string, label_status string, change_ratio double, change_class string, other string").write.parquet(path)
    text = plan(se.valid_labels(spark.read.parquet(path)).select("patch_id"))
    assert "EqualTo(label_status,success)" in text or "PushedFilters: [In(change_class" in text
    read = text[text.rindex("ReadSchema"):]
    assert "other" not in read and "patch_id" in read


def test_scaling_does_not_shuffle_the_wide_table(spark):
    df = spark.createDataFrame([("train", 1.0), ("val", 2.0)], "split string, a double")
    stats = spark.createDataFrame([("a", 1.0, 0.0, 2.0)], "feature string, median double, mean double, scale double")
    text = plan(tb.impute_scale(df, stats, ["a"]))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forward_pairs_are_not_shuffled_by_id(spark):
    from pairscape.operators.pairs import forward_pairs

    rows = [("a", "train", 2019 + y, "Winter", f"i{y}{k}") for y in range(3) for k in range(2)]
    images = spark.createDataFrame(rows, "district string, split string, year int, season string, image_id string")
    pairs = forward_pairs(images)
    assert "hashpartitioning(pair_id" not in plan_of(pairs)
    got = sorted(r.pair_id for r in pairs.collect())
    assert len(got) == 12 and len(set(got)) == 12 and "a_2019_Winter_to_2020_Winter_4" in got


def test_dense_grid_and_removed_summary_read_their_input_once(spark):
    from pairscape.operators.evaluation import dense_grid
    from pairscape.plans.reports import removed_summary

    mark = F.concat(F.lit("mark-"), "pair_id")
    kind = "patch_id string, district string, pair_id string, value double, change_class string, pair_type string, time_gap_group string"
    rows = [("a_x0_y0", "d", "p", 1.0, "low", "t", "g"), ("b_x0_y0", "d", "p", None, "low", "t", "g"), ("c_x64_y64", "d", "p", None, "high", "t", "g")]
    df = spark.createDataFrame(rows, kind).withColumn("pair_id", mark)
    grid = dense_grid(df, "value")
    assert "mark-" not in plan_of(grid)
    assert sorted((r.x, r.y, r.x_end, r.y_end, r.value) for r in grid.collect()) == [
        (0, 0, 64, 64, 1.0), (0, 64, 64, 192, None), (64, 0, 192, 64, None), (64, 64, 192, 192, None)]
    removed = removed_summary(df.withColumn("pair_id", F.lit("p")), df.filter("value = 1").withColumn("patch_id", F.concat(F.lit(""), "patch_id")))
    assert "value = 1.0" not in plan_of(removed)
    assert {r["value"]: r["count"] for r in removed.collect() if r.summary_type == "metric"} == {
        "removed_count": 2.0, "valid_original_count": 3.0, "final_count": 1.0}
