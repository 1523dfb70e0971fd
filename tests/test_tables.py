import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscape.operators import evaluation as ev, inventory as inv, pairs as pr, selection as se, splits as sp, tabular as tb

SEASONS = ["Winter", "PreMonsoon", "Monsoon", "PostMonsoon"]


def images(spark, districts=6, years=(2016, 2017, 2018)):
    rows = [(f"D{d}", "train" if d < 4 else "val", y, s, f"D{d}_{y}_{s}", f"/s/{d}{y}{s}", f"/w/{d}{y}{s}")
            for d in range(districts) for y in years for s in SEASONS]
    return spark.createDataFrame(rows, "district string, split string, year int, season string, image_id string, sentinel_path string, dw_path string")


def test_forward_pairs_bruteforce(spark):
    im = images(spark, 3)
    rows = im.collect()
    order = {s: i for i, s in enumerate(SEASONS)}
    want = {
        (a.image_id, b.image_id) for a in rows for b in rows
        if a.district == b.district and a.split == b.split and b.year * 4 + order[b.season] > a.year * 4 + order[a.season]
    }
    got = pr.forward_pairs(im.repartition(7)).collect()
    assert {(r.image_id_t1, r.image_id_t2) for r in got} == want and len(got) == len(want)
    assert len({r.pair_id for r in got}) == len(got)
    assert pr.forward_pairs(im.limit(1)).count() == 0


def test_two_images_of_one_slot_get_numbered_pairs(spark):
    im = images(spark, 1, (2016,)).filter("season in ('Winter', 'Monsoon')")
    twin = im.withColumn("image_id", F.concat("image_id", F.lit("b")))
    ids = sorted(r.pair_id for r in pr.forward_pairs(im.unionByName(twin)).collect())
    base = "D0_2016_Winter_to_2016_Monsoon"
    assert ids == [base, base + "_2", base + "_3", base + "_4"]


@pytest.mark.parametrize("most", [3, 2048])
def test_pairs_of_repeated_images_and_splits_are_numbered_in_order(spark, monkeypatch, most):
    """Ids repeat inside a slot, in other splits and as whole rows; a place is one part or many."""
    monkeypatch.setattr(pr, "PLACE_IMAGES", most)
    rng = random.Random(5)
    rows = [
        (rng.choice(["D", "D", "E", None]), rng.choice(["train", "val", "test", None]), rng.choice([2016, 2017]), rng.choice([*SEASONS, "Spring", None]),
         rng.choice(["a", "b", "c", None]))
        for _ in range(60)
    ]
    kind = "district string, split string, year int, season string, image_id string"
    order = {s: i for i, s in enumerate(SEASONS)}
    known = [(*r, r[2] * 4 + order[r[3]]) for r in rows if r[0] and r[1] and r[3] in order]
    pairs = sorted(
        (f"{a[0]}_{a[2]}_{a[3]}_to_{b[2]}_{b[3]}", a[1], a[4] or "", b[4] or "")
        for a in known for b in known if a[:2] == b[:2] and b[5] > a[5]
    )
    seen, want = {}, []
    for name, *rest in pairs:
        seen[name] = seen.get(name, 0) + 1
        want.append((name if seen[name] == 1 else f"{name}_{seen[name]}", *rest))
    found = pr.forward_pairs(spark.createDataFrame(rows, kind))
    assert max(seen.values()) > 4 and "hashpartitioning(district#" in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.pair_id, r.split, r.image_id_t1 or "", r.image_id_t2 or "") for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_forward_pairs_shuffle_images_only(spark):
    text = pr.forward_pairs(images(spark, 2))._jdf.queryExecution().executedPlan().toString()
    join = max(text.rfind("SortMergeJoin"), text.rfind("BroadcastHashJoin"), text.rfind("ShuffledHashJoin"))
    assert join >= 0 and "Exchange" not in text[:join]


@pytest.mark.parametrize("targets,reuse,fallback", [({"train": 40, "val": 8}, 3, 5), ({"train": 500, "val": 500}, 2, 4), ({"train": 5, "val": 0}, 1, 1)])
def test_constrained_pairs_invariants(spark, targets, reuse, fallback):
    cand = pr.forward_pairs(images(spark))
    got = pr.constrained_pairs(cand, targets, reuse, fallback).collect()
    available = {r["split"]: r["count"] for r in cand.groupBy("split").count().collect()}
    assert len({r.pair_id for r in got}) == len(got)
    for split, target in targets.items():
        rows = [r for r in got if r.split == split]
        assert len(rows) <= min(target, available[split])
        if not rows:
            assert target == 0
            continue
        cap = rows[0].max_image_use_used
        assert cap == (fallback if rows[0].fallback_max_image_use_used else reuse)
        use = {}
        for r in rows:
            for i in (r.image_id_t1, r.image_id_t2):
                use[i] = use.get(i, 0) + 1
        assert max(use.values()) <= cap
        assert all(r.image_use_count_t1 == use[r.image_id_t1] and r.image_use_count_t2 == use[r.image_id_t2] for r in rows)
        quota = pr.type_quotas(target)
        for kind in quota:
            assert sum(r.pair_type == kind and r.selected_reason.startswith("target_") for r in rows) <= quota[kind]
        chosen = {r.pair_id for r in rows}
        if len(rows) < target:  # maximal: nothing else fits
            for c in cand.filter(F.col("split") == split).collect():
                assert c.pair_id in chosen or max(use.get(c.image_id_t1, 0), use.get(c.image_id_t2, 0)) >= cap


def test_constrained_pairs_do_not_depend_on_input_order(spark):
    cand = pr.forward_pairs(images(spark))
    runs = [{r.pair_id for r in pr.constrained_pairs(cand.repartition(n), {"train": 30}).collect()} for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 30


def test_split_districts(spark):
    df = spark.createDataFrame([(f"d{i}",) for i in range(20)] * 2, "district string")
    got = sp.split_districts(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 14, "val": 3, "test": 3}
    assert sp.split_districts(df, seed=1).collect() != sp.split_districts(df, seed=2).collect()
    with pytest.raises(Exception, match="too few districts"):
        sp.split_districts(df.limit(2)).collect()
    with pytest.raises(ValueError):
        sp.split_districts(df, (0.5, 0.1, 0.1))
    good, bad = sp.assign_split(spark.createDataFrame([("d1",), (None,), ("zz",)], "district string"), sp.split_districts(df))
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(ValueError):
        sp.check_split(spark.createDataFrame([("a", "train"), ("a", "val"), ("b", None)], "district string, split string"))


def test_seasonal_nulls_and_december(spark):
    df = spark.createDataFrame(
        [("a b", "2016", "12", 1.0, None), ("A_B", "2017", "jan", 3.0, None), ("a b", "2017", "3", float("nan"), 2.0), (None, "2017", "3", 5.0, 1.0)],
        "district string, year string, month string, temp double, flood_count double")
    got = {(r.district, r.year, r.season): (r.temp, r.flood_count) for r in tb.monthly_to_seasonal(df).collect()}
    assert got == {("A_B", 2017, "Winter"): (2.0, 0.0), ("A_B", 2017, "PreMonsoon"): (None, 2.0), (None, 2017, "PreMonsoon"): (5.0, 1.0)}


def test_pair_features(spark):
    tab = spark.createDataFrame(
        [("a", 2016, "Winter", 0.0, 1), ("a", 2016, "PreMonsoon", 4.0, 2), ("a", 2017, "Winter", None, 3)],
        "district string, year int, season string, temp double, flood_count int")
    pairs = spark.createDataFrame(
        [("p1", "train", "A", 2016, "Winter", 2017, "Winter", "same_season_multiyear", "short"),
         ("p2", "val", "A", 2016, "PreMonsoon", 2018, "Winter", "cross_season_multiyear", "medium"),
         ("p3", "val", "Q", 2016, "Winter", 2017, "Winter", "same_season_multiyear", "short")],
        "pair_id string, split string, district string, year_t1 int, season_t1 string, year_t2 int, season_t2 string, pair_type string, time_gap_group string")
    r = {x.pair_id: x for x in tb.pair_features(pairs, tab).collect()}
    assert (r["p1"].temp_t1, r["p1"].temp_t2, r["p1"].temp_ratio, r["p1"].temp_mean_between) == (0.0, None, None, 2.0)
    assert (r["p1"].flood_count_sum_between, r["p1"].flood_count_diff, r["p1"].flood_count_ratio) == (6.0, 2.0, 3.0)
    assert (r["p2"].tabular_t1_missing, r["p2"].tabular_t2_missing, r["p2"].tabular_any_missing, r["p2"].tabular_district_missing) == (False, True, True, False)
    assert r["p2"].flood_count_sum_between == 5.0 and r["p2"].time_gap_group_medium == 1
    assert r["p3"].tabular_district_missing and r["p3"].temp_mean_between is None and r["p3"].flood_count_sum_between is None


def test_pairs_are_shuffled_once_for_their_features(spark):
    """F13, F15, F16, F18 to F21: one join, by district, and nothing written on the way."""
    pairs = spark.createDataFrame(
        [("p1", "train", "A", 2016, "Winter", 2017, "Winter", "same_season_multiyear", "short")],
        "pair_id string, split string, district string, year_t1 int, season_t1 string, year_t2 int, season_t2 string, pair_type string, time_gap_group string")
    tab = spark.createDataFrame([("A", 2016, "Winter", 1.0)], "district string, year int, season string, temp double")
    for build in (tb.endpoint_features, tb.between_features, tb.pair_features):
        plan = build(pairs, tab)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1, plan


def test_between_features_against_each_span(spark):
    """Running sums against the records of each span: several records a season, unknown values, infinities, spans beyond the records."""
    rnd = random.Random(6)
    values = [None, float("nan"), float("inf"), float("-inf")]
    tab = [(rnd.choice(["a", "b", "c"]), 2010 + rnd.randrange(6), rnd.choice(["Winter", "PreMonsoon", "Monsoon", "PostMonsoon", None]),
            rnd.choice([rnd.uniform(-5, 5)] * 9 + values), rnd.choice([None, rnd.randrange(9)])) for _ in range(150)]
    order = {"Winter": 0, "PreMonsoon": 1, "Monsoon": 2, "PostMonsoon": 3}
    spans = [(d, y1, s1, y2, s2) for d in ("A", "B", "Z") for y1 in (2008, 2011, 2013) for s1 in order for y2 in (2010, 2013, 2019) for s2 in ("Winter", "Monsoon")]
    pairs = spark.createDataFrame([(f"p{i}", *x) for i, x in enumerate(spans)], "pair_id string, district string, year_t1 int, season_t1 string, year_t2 int, season_t2 string")
    frame = spark.createDataFrame(tab, "district string, year int, season string, temp double, flood_count int")
    got = {r.pair_id: r for r in tb.between_features(pairs, frame.repartition(3)).collect()}
    assert len(got) == len(spans)
    for i, (d, y1, s1, y2, s2) in enumerate(spans):
        inside = [r for r in tab if r[0].upper() == d and r[2] and y1 * 4 + order[s1] <= r[1] * 4 + order[r[2]] <= y2 * 4 + order[s2]]
        temps = [r[3] for r in inside if r[3] is not None and not math.isnan(r[3])]
        x = got[f"p{i}"]
        if temps:
            assert np.allclose(x.temp_mean_between, sum(temps) / len(temps), equal_nan=True)
        else:
            assert x.temp_mean_between is None
        assert x.flood_count_sum_between == (float(sum(r[4] or 0 for r in inside)) if inside else None)


def test_train_stats_and_scaling(spark):
    rng = np.random.default_rng(0)
    rows = [("train" if i % 3 else "val", float(rng.normal()) if i % 5 else None, 7.0, None) for i in range(90)]
    df = spark.createDataFrame(rows, "split string, a double, b double, c double")
    stats = {r.feature: r for r in tb.train_stats(df).collect()}
    train = np.array([r[1] if r[1] is not None else np.nan for r in rows if r[0] == "train"])
    med = np.nanmedian(train)
    filled = np.where(np.isnan(train), med, train)
    assert np.allclose([stats["a"].median, stats["a"].mean, stats["a"].scale], [med, filled.mean(), filled.std()])
    assert (stats["b"].median, stats["b"].scale, stats["c"].median, stats["c"].scale) == (7.0, 1.0, 0.0, 1.0)
    out = tb.impute_scale(df, tb.train_stats(df)).filter("split = 'train'").agg(F.avg("a"), F.stddev_pop("a"), F.max("b"), F.max("c")).first()
    assert np.allclose(list(out), [0, 1, 0, 0], atol=1e-9)
    with pytest.raises(Exception, match="train split"):
        tb.impute_scale(df, tb.train_stats(df.filter("split = 'val'"))).collect()


def test_alignment_states(spark):
    cols = "image_id string, district string, year int, season string, full_path string, readable boolean, band_count int, crs string, width int, height int, " \
        "resolution_x double, resolution_y double, bounds_left double, bounds_bottom double, bounds_right double, bounds_top double"
    row = ("i", "d", 2016, "Winter", "/p", True, 13, None, 10, 10, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0)

    def table(**changes):
        names = [c.split()[0] for c in cols.split(", ")]
        return spark.createDataFrame([tuple(changes.get(n, v) for n, v in zip(names, row))], cols)

    def state(a, b):
        r = inv.alignment(a, b).first()
        return r.alignment_status, r.same_crs

    assert state(table(), table(resolution_x=1.0 + 5e-7)) == ("aligned", True)
    assert state(table(), table(bounds_top=None)) == ("mismatch", True)
    assert state(table(crs="x"), table()) == ("mismatch", False)
    assert state(table(readable=False), table()) == ("unreadable", None)
    assert state(table(), table().limit(0)) == ("missing_dynamic_world", None)
    assert state(table().limit(0), table()) == ("missing_sentinel", None)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(42)
    t, p = rng.random(50), rng.random(50)
    cls, pred = rng.integers(0, 3, 50), rng.integers(0, 3, 50)
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for a, b, c, d in zip(t, p, cls, pred)], "t double, p double, c int, d int")
    m = ev.regression_metrics(df, "p", "t").first()
    assert np.allclose([m.mae, m.mse, m.r2, m.pearson_corr], [abs(p - t).mean(), ((p - t) ** 2).mean(), 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum(), np.corrcoef(p, t)[0, 1]])
    cm = ev.confusion_matrix(df, "d", "c")
    got = {(r.true_class, r.pred_class): r["count"] for r in cm.collect()}
    assert len(got) == 9 and all(got[i, j] == int(((cls == i) & (pred == j)).sum()) for i in range(3) for j in range(3))
    c = ev.classification_metrics(cm).first()
    assert math.isclose(c.accuracy, (cls == pred).mean())
    none = ev.classification_metrics(ev.confusion_matrix(df.filter("c = 1"), "d", "c")).first()
    assert none.class_accuracy_low == 0.0
    one = ev.regression_metrics(df.limit(1), "p", "t").first()
    assert one.r2 is None and one.pearson_corr is None


def test_group_summary_only_complete_groups(spark):
    df = spark.createDataFrame(
        [("a", 0.1, 0.01, 0.2, 0.3, True), ("a", None, 0.01, 0.2, 0.3, None), (None, 0.2, 0.04, 0.1, 0.3, False)],
        "district string, abs_error double, squared_error double, y_true_change_ratio double, y_pred_change_ratio double, correct boolean")
    got = {r.value: r for r in ev.group_summary(df).collect()}
    assert got["a"].mae is None and got["a"].accuracy is None and got["a"]["count"] == 2
    assert got[None].mae == 0.2 and got[None].accuracy == 0.0


def labeled(spark, per_class, pairs=4, split="train"):
    rows = []
    for c, n in per_class.items():
        for i in range(n):
            rows.append((f"{c}{i}", f"p{i % pairs}", f"d{i % pairs % 2}", split, c, {"low": 0.01, "medium": 0.1, "high": 0.5}[c], "success", i % 9, i // 9, "same_season_multiyear", "short"))
    return spark.createDataFrame(rows, "patch_id string, pair_id string, district string, split string, change_class string, change_ratio double, label_status string, x int, y int, pair_type string, time_gap_group string")


@pytest.mark.parametrize("target,high", [(1000, 60), (150, 60), (110, 60), (130, 30), (90, 60)])
def test_balanced_selection_high_target(spark, target, high):
    # 100 low and medium rows stay; without room left the high target is not bounded
    df = labeled(spark, {"low": 60, "medium": 40, "high": 60})
    rest = max(0, target - 100)
    want = min(130, rest) if rest else 130
    got = se.balanced_selection(df, {"train": target})
    counts = {r.change_class: r["count"] for r in got.groupBy("change_class").count().collect()}
    assert counts == {"low": 60, "medium": 40, "high": min(60, want)}
    assert (counts["high"] < 60) == (got.filter("selection_stage like '%|high_target_cap'").count() > 0)


def test_final_selection_is_stable_and_valid(spark):
    df = labeled(spark, {"low": 300, "medium": 300, "high": 300})
    a = {r.patch_id for r in se.final_selection(df, {"train": 400}).collect()}
    b = {r.patch_id for r in se.final_selection(df.repartition(9), {"train": 400}).collect()}
    assert a == b
    per = se.final_selection(df, {"train": 400}).groupBy("pair_id", "change_class").count().collect()
    assert all(r["count"] <= se.PAIR_CAPS[r.change_class] for r in per)
    se.check_selection(se.final_selection(df, {"train": 400}))
    with pytest.raises(ValueError):
        se.check_selection(df.unionByName(df))


def test_medians_and_moments_of_columns(spark, monkeypatch):
    """Against NumPy: signs, zeros, infinities, nulls, wide and narrow values, few and many of them."""
    from pairscape.operators import columns

    monkeypatch.setattr(columns, "LISTED", 50)
    monkeypatch.setattr(columns, "COLUMNS", 4)
    rng = np.random.default_rng(3)
    n = 4001
    data = {
        "normal": rng.normal(5, 2, n), "close": 1 + rng.integers(0, 4000, n) * 2.0**-50, "signs": rng.normal(0, 1, n) ** 9 * 1e30,
        "flags": (rng.random(n) < 0.4).astype(float), "zeros": np.where(rng.random(n) < 0.5, -0.0, 0.0), "inf": np.where(rng.random(n) < 0.2, np.inf, rng.random(n)),
        "tiny": rng.random(n) * 5e-324 * 9, "one": np.where(np.arange(n) == 7, 3.5, np.nan), "none": np.full(n, np.nan),
        "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.integers(-9, 9, n)),
    }
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(zip(*data.values(), strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    got = {r[0]: r[1:] for r in columns.medians_and_moments(df, list(data))}
    assert list(got) == list(data)
    for c, v in data.items():
        known = v[~np.isnan(v)]
        count, k, mean, variance, median = got[c]
        assert (count, k) == (n, len(known)), c
        if not k:
            assert (mean, variance, median) == (None, None, None)
            continue
        assert median == np.median(known), c
        with np.errstate(all="ignore"):
            assert np.isclose(mean, known.mean()) and np.isclose(variance, known.var(), equal_nan=True), c
    assert columns.medians_and_moments(df.limit(0), ["normal"]) == []
    # two middle values of different intervals
    two = spark.createDataFrame([(-4.0,), (-1.0,), (2.0,), (7e200,)], "v double")
    assert columns.medians_and_moments(two, ["v"])[0][-1] == 0.5


def test_split_means_of_many_columns(spark, monkeypatch):
    from pairscape.operators import audit as au

    monkeypatch.setattr(au, "TOGETHER", 2)
    df = spark.createDataFrame([("a", 1.0, -8.0, None), ("a", 3.0, float("nan"), None), (None, 5.0, 9.0, 2.0)], "split string, u double, v double, w double")
    got = {(r.split, r.feature): (r.rows, r.mean, r["std"], r.top) for r in au._split_means(df, ["u", "v", "w"]).collect()}
    assert got == {
        ("a", "u"): (2, 2.0, 1.0, 3.0), ("a", "v"): (2, -8.0, 0.0, 8.0), ("a", "w"): (2, None, None, None),
        (None, "u"): (1, 5.0, 0.0, 5.0), (None, "v"): (1, 9.0, 0.0, 9.0), (None, "w"): (1, 2.0, 0.0, 2.0),
    }
    plan = au._split_means(df, ["u", "v", "w"])._jdf.queryExecution().executedPlan().toString()
    assert not any("feature#" in line.partition("functions=")[0] for line in plan.splitlines() if "Aggregate(keys=[split#" in line)
