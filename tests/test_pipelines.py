import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairscape.operators import greedy, pairs as pair_ops
from pairscape.plans import pipelines

SEASONS = ["Winter", "PreMonsoon", "Monsoon", "PostMonsoon"]


def test_feature_tables_end_to_end(spark):
    images = spark.createDataFrame(
        [(f"D{d}", y, s, f"D{d}_{y}_{s}") for d in range(5) for y in (2016, 2017) for s in SEASONS],
        "district string, year int, season string, image_id string")
    monthly = spark.createDataFrame(
        [(f"d{d}", y, m, float(d + m), d) for d in range(4) for y in (2015, 2016, 2017) for m in range(1, 13)],
        "District string, Year int, Month int, Temp double, `Flood Count` int")
    out = pipelines.feature_tables(images, monthly, {"train": 20, "val": 5, "test": 5})
    assert out["unassigned_images"].count() == 0
    n = {k: out[k].count() for k in ("pairs", "features", "scaled", "complete_pairs", "removed_pairs", "complete_features")}
    assert n["pairs"] == n["features"] == n["scaled"] == n["complete_pairs"] + n["removed_pairs"]
    assert n["complete_features"] == n["complete_pairs"]
    absent = out["removed_pairs"].select("district").distinct().collect()
    assert {r.district for r in absent} <= {"D4"}
    means = out["scaled"].filter("split = 'train'").agg(F.avg("temp_t1"), F.avg("flood_count_sum_between")).first()
    assert all(abs(v) < 1e-9 for v in means)


def test_labeled_selection_end_to_end(spark):
    rng, side, patch, stride = np.random.default_rng(11), 12, 4, 2
    names = [f"D{d}_{t}" for d in range(4) for t in range(3)]
    maps = {n: rng.choice([1.0, 1.0, 1.0, 2.0], (side, side)) for n in names}
    pixels = spark.createDataFrame(
        [(n, r, c, float(m[r, c]), 0.0) for n, m in maps.items() if n != "D3_2" for r in range(side) for c in range(side)],
        "image_id string, row int, col int, value double, nodata double")
    sizes = spark.createDataFrame([(f"/{n}", side + (n == "D2_0"), side) for n in names], "path string, width int, height int")
    rows = [(f"D{d}_{a}{b}", f"D{d}", "train" if d < 2 else "test", f"D{d}_{a}", f"D{d}_{b}", "same_season_multiyear", "short", f"/D{d}_{a}", f"/D{d}_{b}")
            for d in range(4) for a in range(3) for b in range(a + 1, 3)]
    pairs = spark.createDataFrame(rows, "pair_id string, district string, split string, image_id_t1 string, image_id_t2 string, pair_type string, "
                                        "time_gap_group string, sentinel_path_t1 string, sentinel_path_t2 string")
    out = pipelines.labeled_selection(pairs, sizes, pixels, {"train": 40, "test": 30}, 10, patch, stride)
    # the raster of another size leaves its two pairs without patches
    assert {r.pair_id for r in out["index_errors"].collect()} == {"D2_01", "D2_02"}
    labeled = out["labeled"].collect()
    per_pair = {}
    for r in labeled:
        per_pair[r.pair_id] = per_pair.get(r.pair_id, 0) + 1
        a, b = (maps[i][r.y:r.y + patch, r.x:r.x + patch] for i in (r.image_id_t1, r.image_id_t2))
        if "D3_2" in (r.image_id_t1, r.image_id_t2):
            assert (r.label_status, r.label_error_message) == ("failed", "no pixels of raster D3_2")
        else:
            assert (r.valid_pixel_count, r.changed_pixel_count) == (patch * patch, (a != b).sum())
    assert set(per_pair.values()) == {10} and len(per_pair) == 10
    final = out["final"].collect()
    assert final and {r.label_status for r in final} == {"success"} and len({r.patch_id for r in final}) == len(final)
    assert {r.patch_id for r in final} <= {r.patch_id for r in labeled if r.label_status == "success"}


def make_model():
    def model(a, b, c):  # local, so that it reaches the workers by value
        return (b - a).mean(axis=1) + c.sum(axis=1)

    return model


def test_evaluate_and_explain_end_to_end(spark):
    rng, channels, n = np.random.default_rng(3), 2, 30
    rows = []
    for i in range(n):
        a, b, t = rng.random(channels * 4), rng.random(channels * 4), rng.random(2) / 10
        rows.append((f"p{i}", f"q{i % 4}", f"d{i % 3}", "test" if i % 3 else "train", ["low", "medium", "high"][i % 3], "cross_season_sameyear", "short",
                     float(rng.random()), a.tolist(), b.tolist(), t.tolist()))
    samples = spark.createDataFrame(rows, "patch_id string, pair_id string, district string, split string, change_class string, pair_type string, "
                                          "time_gap_group string, change_ratio double, image_t1 array<double>, image_t2 array<double>, tabular array<double>")
    index = samples.select("patch_id", F.concat(F.lit("/"), "patch_id").alias("npz_path"))
    out = pipelines.evaluate_and_explain(samples, index, make_model(), channels, ["temp_t1", "rain_t2"], 6)
    model = make_model()
    want = {r[0]: model(*(np.array([x]) for x in r[8:11]))[0] for r in rows}
    truth = {r[0]: r[7] for r in rows}
    got = {r.patch_id: r.y_pred_change_ratio for r in out["predictions"].collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)
    metrics = out["metrics"].first()
    assert np.isclose(metrics.mae, np.mean([abs(want[k] - truth[k]) for k in want])) and np.isclose(metrics.mse, np.mean([(want[k] - truth[k]) ** 2 for k in want]))
    chosen = {r.patch_id for r in out["selected"].collect()}
    assert len(chosen) == 6 and all(int(k[1:]) % 3 for k in chosen)
    for name, item, number in (("bands", "band_index", channels), ("features", "feature_index", 2)):
        found = out[name].collect()
        assert {r.patch_id for r in found} == chosen and len({r[item] for r in found}) == number
    assert out["band_summary"].count() == channels and out["feature_summary"].count() == 2
    assert {r.patch_id for r in out["modalities"].collect()} == chosen


def constrained_model(rows, targets, reuse, fallback, seed):
    """One pair after the other: quotas and turns first, then backfill, then a second try with the fallback limit."""
    def digest(s, i):
        return hashlib.md5(f"{s}|{i}".encode()).hexdigest()

    def gap(years):
        return "same_year" if years == 0 else "short" if years == 1 else "medium" if years <= 3 else "long" if years <= 6 else "very_long"

    def select(split, limit):
        mine = [(i, kind, gap(y), a, b) for i, s, kind, y, a, b in rows if s == split]
        quota, target = pair_ops.type_quotas(targets[split]), targets[split]
        cells = {}
        for r in mine:
            cells.setdefault((r[1], r[2]), []).append(r[0])
        rank = {i: k for ids in cells.values() for k, i in enumerate(sorted(ids, key=lambda i: (digest(seed, i), i)))}

        def turn(r):
            sizes = {g: len(ids) for (kind, g), ids in cells.items() if kind == r[1]}
            before = sum(min(n, rank[r[0]]) + (g < r[2] and n > rank[r[0]]) for g, n in sizes.items())
            return (before + 1) / max(1, quota.get(r[1], 0)), r[1], r[0]

        images, kinds, out = Counter(), Counter(), {}
        for backfill, order in ((False, turn), (True, lambda r: (digest(seed + 1, r[0]), r[0]))):
            for r in sorted(mine, key=order):
                if r[0] in out or max(images[r[3]], images[r[4]]) >= limit or len(out) >= target or not (backfill or kinds[r[1]] < quota.get(r[1], 0)):
                    continue
                out[r[0]] = "backfill_reuse_limited" if backfill else f"target_{r[1]}_{r[2]}"
                images[r[3]] += 1
                images[r[4]] += 1
                kinds[r[1]] += 1
        return out, images, len(mine)

    chosen = {}
    for split, target in targets.items():
        out, images, available = select(split, reuse)
        relaxed = False
        if len(out) < min(target, available):
            again, more, _ = select(split, fallback)
            if len(again) > len(out):
                out, images, relaxed = again, more, True
        ends = {r[0]: (r[4], r[5]) for r in rows}
        chosen |= {i: (reason, images[ends[i][0]], images[ends[i][1]], relaxed) for i, reason in out.items()}
    return chosen


def test_constrained_pairs_equal_the_sequential_choice(spark, monkeypatch):
    monkeypatch.setattr(greedy, "BUCKET_ROWS", 60)
    r, rows = random.Random(5), []
    kinds = ["same_season_multiyear", "cross_season_sameyear", "cross_season_multiyear"]
    for i in range(330):
        split = "train" if i < 200 else "val" if i < 300 else "test"
        a, b = r.sample(range({"train": 60, "val": 9, "test": 30}[split]), 2)
        rows.append((f"k{i:03d}", split, r.choices(kinds, [5, 1, 3])[0], r.randrange(8), f"{split}{a}", f"{split}{b}"))
    targets = {"train": 60, "val": 20, "test": 100}
    pairs = spark.createDataFrame(rows, "pair_id string, split string, pair_type string, time_gap_years int, image_id_t1 string, image_id_t2 string")
    got = pair_ops.constrained_pairs(pairs.repartition(3), targets, 3, 5, 42).collect()
    want = constrained_model(rows, targets, 3, 5, 42)
    found = {x.pair_id: (x.selected_reason, x.image_use_count_t1, x.image_use_count_t2, x.fallback_max_image_use_used) for x in got}
    assert found == want and {v[3] for v in want.values()} == {True, False}


def test_a_choice_of_few_pairs_looks_at_the_beginning_of_the_order(spark, monkeypatch):
    r, rows = random.Random(8), []
    kinds = ["same_season_multiyear", "cross_season_sameyear", "cross_season_multiyear"]
    for i in range(3000):
        split = "train" if i < 2000 else "val"
        a, b = r.sample(range(500), 2)
        rows.append((f"k{i:04d}", split, r.choices(kinds, [5, 1, 3])[0], r.randrange(8), f"{split}{a}", f"{split}{b}"))
    # the first kind has fewer candidates in val than its quota: the backfill has to find others
    rows = [x for x in rows if x[1] == "train" or x[2] != kinds[0] or x[0] > "k2990"]
    targets = {"train": 40, "val": 30}
    pairs = spark.createDataFrame(rows, "pair_id string, split string, pair_type string, time_gap_years int, image_id_t1 string, image_id_t2 string")
    taken, looked_at = pair_ops.capped_selection, []

    def counted(df, *args, **kwargs):
        looked_at.append(df.count())
        return taken(df, *args, **kwargs)

    monkeypatch.setattr(pair_ops, "capped_selection", counted)
    got = pair_ops.constrained_pairs(pairs, targets, 3, 5, 42).collect()
    want = constrained_model(rows, targets, 3, 5, 42)
    assert {x.pair_id: (x.selected_reason, x.image_use_count_t1, x.image_use_count_t2, x.fallback_max_image_use_used) for x in got} == want
    assert "backfill_reuse_limited" in [v[0] for v in want.values()]
    assert max(looked_at) < len(rows) // 4
