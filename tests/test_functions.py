import math

import pytest
from pyspark.sql import functions as F

from pairscape import functions as fn

GOOD = [
    ("S2_30m_2016_Winter_Khulna.tif", "S2", 2016, "Winter", "Khulna"),
    ("DW_30m_2016_PreMonsoon_Khulna.tiff", "DW", 2016, "PreMonsoon", "Khulna"),
    ("DW_allclasses_30m_2016_PostMonsoon_Satkhira.tif", "DW", 2016, "PostMonsoon", "Satkhira"),
    ("Sentinel2_30m_2017_Monsoon_Coxs_Bazar.tif", "Sentinel2", 2017, "Monsoon", "Coxs_Bazar"),
    ("DynamicWorld_30m_2018_PostMonsoon_Coxs Bazar.tif", "DynamicWorld", 2018, "PostMonsoon", "Coxs_Bazar"),
    ("Sentinel_30m_2020_premonsoon_Dhaka.tif", "Sentinel", 2020, "PreMonsoon", "Dhaka"),
    ("S2_30m_2021_monsoon_coxs_bazar.tif", "S2", 2021, "Monsoon", "Coxs_Bazar"),
    ("/deep/er/S2_30m_2021_Pre_Monsoon_a-b c.TIF", "S2", 2021, "PreMonsoon", "A-B_C"),
]
BAD = [
    ("S2_30m_2019_Summer_Khulna.tif", "Invalid season"),
    ("S2_30m_2015_Winter_Khulna.tif", "Invalid year. Expected"),
    ("S2_30m_20x5_Winter_Khulna.tif", "Invalid year '20x5'"),
    ("S2_30m_2016_Winter_Khulna.jpg", "Invalid extension '.jpg'"),
    ("not_a_valid_filename.tif", "Invalid sensor 'not'"),
    ("S2_30m_2016.tif", "Filename must follow {sensor}"),
    ("DW_allclasses_30m_2016.tif", "Filename must follow DW_allclasses"),
    ("S2_30m_2016_Winter_.tif", "District name is missing."),
    ("S2_30m_2016_Winterland_X.tif", "Invalid season"),
    (".tif", "Invalid extension ''"),
]


def one(spark, value, expr, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr.alias("r")).first()[0]


@pytest.mark.parametrize("name,sensor,year,season,district", GOOD)
def test_raster_name(spark, name, sensor, year, season, district):
    r = one(spark, name, fn.parse_raster_name("v"))
    assert (r.sensor, r.year, r.season, r.district, r.parse_status) == (sensor, year, season, district, "success")
    assert r.image_id == f"{district}_{year}_{season}" and r.error_message is None


@pytest.mark.parametrize("name,message", BAD)
def test_bad_raster_name(spark, name, message):
    r = one(spark, name, fn.parse_raster_name("v"))
    assert r.parse_status == "failed" and r.error_message.startswith(message)
    assert r.sensor is None and r.image_id is None


def test_districts(spark):
    rows = ["cox's  bazar", "__A__b ", "a-b c1d", "", None, " _ "]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = df.select("v", fn.normalize_district("v").alias("a"), fn.normalize_district("v", True).alias("b"), fn.district_join_key("v").alias("k")).collect()
    by = {r.v: r for r in got}
    for text in ("cox's  bazar", "a-b c1d"):
        title = " ".join(text.split()).title().replace(" ", "_")
        assert by[text].a == title
    assert by["cox's  bazar"].b == "Coxs_Bazar" and by["cox's  bazar"].k == "coxsbazar"
    assert by["__A__b "].a == "A_B"
    assert by[""].b is None and by[""].k is None and by[None].a is None


@pytest.mark.parametrize("text,month", [("3", 3), ("03", 3), ("3.0", 3), (" Sept ", 9), ("DECEMBER", 12), ("13", None), ("0", None), ("x", None), ("3.5", None), ("", None), (None, None)])
def test_months(spark, text, month):
    assert one(spark, text, fn.normalize_month("v")) == month


@pytest.mark.parametrize("text,season", [("winter", "Winter"), ("Pre Monsoon", "PreMonsoon"), ("POST__MONSOON", "PostMonsoon"), ("summer", None)])
def test_seasons(spark, text, season):
    assert one(spark, text, fn.normalize_season("v")) == season


def test_classes_and_numbers(spark):
    values = [None, float("nan"), -0.1, 0.0, 0.0499, 0.05, 0.2, 1.0, 1.01, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fn.change_class("v")).collect()] == [
        "invalid", "invalid", "invalid", "low", "low", "medium", "high", "high", "invalid", "invalid"
    ]
    assert [r[0] for r in df.select(fn.is_finite("v")).collect()] == [v is not None and math.isfinite(v) for v in values]
    r = spark.createDataFrame([("nan",), ("inf",), (" 1e2 ",), ("",), ("q",)], "t string").select(
        fn.safe_float("t", -1.0).alias("a"), fn.safe_float("t", finite_only=True).alias("b")).collect()
    assert math.isnan(r[0].a) and r[0].b is None and r[1].b is None and r[2].a == 100.0 and r[3].a == -1.0 and r[4].a == -1.0


def test_patch_xy_and_paths(spark):
    assert one(spark, "a_x12_y7", fn.patch_xy("v")).asDict() == {"x": 12, "y": 7}
    assert one(spark, "a_x1_y2_x3_y4", fn.patch_xy("v")).asDict() == {"x": 1, "y": 2}
    assert one(spark, "a_x12_y7z", fn.patch_xy("v")) is None
    assert one(spark, 'a<b>:"/\\|?*c', fn.safe_file_name("v")) == "a_b_________c.npz".replace("_________", "________")
    assert [one(spark, v, fn.bad_path("v")) for v in (None, " nan ", "x")] == [True, True, False]


def test_softmax_ties(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0],), ([-1000.0, 0.0, 1000.0],)], "z array<double>")
    rows = df.select(fn.softmax("z").alias("p"), fn.argmax(fn.softmax("z")).alias("i")).collect()
    assert [r.i for r in rows] == [0, 2] and all(abs(sum(r.p) - 1) < 1e-12 for r in rows)


def test_feature_names(spark):
    df = spark.createDataFrame([], "` A b-(c)` int, `X__y` double, flag boolean")
    assert fn.standardize_columns(df).columns == ["a_b_c", "x_y", "flag"]
    assert fn.numeric_features(df) == [" A b-(c)", "X__y"]
    with pytest.raises(ValueError):
        fn.detect_keys(spark.createDataFrame([], "district int, name int, year int, month int"))
    with pytest.raises(ValueError):
        fn.detect_keys(spark.createDataFrame([], "district int, month int"))


def test_seeded_hash_depends_on_key_only(spark):
    df = spark.range(50).withColumn("h", fn.hash_key(7, "id"))
    again = spark.range(49, -1, -1).repartition(3).withColumn("h", fn.hash_key(7, "id"))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in again.collect()}
    assert df.filter(F.col("h") == fn.hash_key(8, "id")).isEmpty()


def test_required_columns(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert fn.check_columns(df, ["a"]) == []
    with pytest.raises(ValueError, match="c"):
        fn.check_columns(df, ["a", "c"])
    with pytest.warns(UserWarning):
        assert fn.check_columns(df, ["d", "c"], strict=False) == ["c", "d"]


def test_parts_of_a_name_are_worked_out_once(spark):
    """A pattern stands once in the plan, not once in each field that reads its match."""
    names = spark.createDataFrame([("S2_30m_2020_Winter_coxs bazar.tif",), ("P1_x64_y128_o5",), ("none",), (None,)], "n string")

    def patterns(df):
        return df._jdf.queryExecution().analyzed().toString().count("regexp_extract(")

    parsed, places = names.select(fn.parse_raster_name("n").alias("p")), names.select(fn.patch_xy("n").alias("p"))
    assert patterns(places) == 1 and patterns(parsed) == 3
    assert [r.p for r in places.collect()] == [None, (64, 128), None, None]
    first = parsed.first().p
    assert (first.sensor, first.year, first.season, first.district, first.parse_status) == ("S2", 2020, "Winter", "Coxs_Bazar", "success")
