import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscape.operators import explain as ex, patches as pt


def digest(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


@pytest.mark.parametrize("w,h", [(128, 128), (127, 500), (300, 257), (0, 0), (640, 192)])
def test_grid_and_count(spark, w, h):
    sizes = spark.createDataFrame([(w, h)], "width int, height int")
    got = {(r.x, r.y) for r in pt.patch_grid(sizes).collect()}
    want = {(x, y) for y in range(0, h - 127, 64) for x in range(0, w - 127, 64)}
    assert got == want
    assert sizes.select(pt.patch_count("width", "height")).first()[0] == len(want)
    pt.check_grid(pt.patch_grid(sizes))
    with pytest.raises(ValueError):
        pt.patch_grid(sizes, 0)


def sample_model(rows, most, seed=42):
    """Round-robin over spatial bins in text order."""
    if len(rows) <= most:
        return {r[0] for r in rows}
    k = math.ceil(math.sqrt(most))

    def bins(values):
        lo, hi = min(values), max(values)
        return [0 if lo == hi else min(k - 1, max(0, math.floor((v - lo) / (hi - lo) * k))) for v in values]

    boxes = {}
    for r, bx, by in zip(rows, bins([r[1] + 64.0 for r in rows]), bins([r[2] + 64.0 for r in rows])):
        boxes.setdefault(f"{bx}_{by}", []).append(r[0])
    for ids in boxes.values():
        ids.sort(key=lambda i: digest(seed, i))
    out = []
    while len(out) < most:
        for name in sorted(boxes):
            if boxes[name] and len(out) < most:
                out.append(boxes[name].pop(0))
    return set(out)


@pytest.mark.parametrize("most", [1, 4, 10, 50])
def test_spatial_sample(spark, most):
    rows = [(f"{p}_{x}_{y}", x, y, p) for p, nx, ny in (("a", 12, 9), ("b", 1, 30), ("c", 2, 2)) for x in range(0, nx * 64, 64) for y in range(0, ny * 64, 64)]
    df = spark.createDataFrame([(*r, 128) for r in rows], "patch_id string, x int, y int, pair_id string, patch_size int")
    got = pt.spatial_sample(df.repartition(6), most).collect()
    want = set()
    for p in "abc":
        want |= sample_model([r for r in rows if r[3] == p], most)
    assert {r.patch_id for r in got} == want
    total = {p: sum(r[3] == p for r in rows) for p in "abc"}
    assert all(r.sampled_from_total_pair_patches == total[r.pair_id] and math.isclose(r.pair_sampling_ratio, min(most, total[r.pair_id]) / total[r.pair_id]) for r in got)
    if most == 50:  # both copies of an id are sampled
        with pytest.raises(Exception, match="not unique"):
            pt.spatial_sample(df.unionByName(df), most).collect()


def test_spatial_sample_shuffles_patches_twice(spark):
    """Once by pair and once by id, and a copy of a sampled row does not come along."""
    kind = "patch_id string, x int, y int, pair_id string, patch_size int"
    one = spark.createDataFrame([("p", 0, 0, "a", 128)] * 2, kind)
    sampled = pt.spatial_sample(one, 1)
    assert sampled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert [(r.patch_id, r.sampled_from_total_pair_patches) for r in sampled.collect()] == [("p", 2)]


def test_labels_against_numpy_and_pixels(spark):
    rng = np.random.default_rng(3)
    maps = {i: (rng.integers(0, 3, (8, 8)).astype(float), rng.integers(0, 3, (8, 8)).astype(float)) for i in range(5)}
    maps[0][0][2, 3] = np.nan
    maps[4][0][:] = 0.0  # nothing valid
    arrays = spark.createDataFrame(
        [(f"p{i}", a.ravel().tolist(), b.ravel().tolist(), 0.0, None) for i, (a, b) in maps.items()] + [("bad", [1.0], [1.0, 2.0], None, None), ("none", None, [1.0], None, None)],
        "patch_id string, values_t1 array<double>, values_t2 array<double>, nodata_t1 double, nodata_t2 double")
    got = {r.patch_id: r for r in pt.label_arrays(arrays).collect()}
    for i, (a, b) in maps.items():
        ok = np.isfinite(a) & np.isfinite(b) & (a != 0)
        r = got[f"p{i}"]
        assert (r.valid_pixel_count, r.changed_pixel_count) == (ok.sum(), (a[ok] != b[ok]).sum())
        assert r.label_status == ("success" if ok.mean() >= 0.8 else "invalid_low_valid_ratio")
    assert got["p4"].change_ratio is None and got["p4"].change_class == "invalid"
    assert got["bad"].label_status == "failed" and "shape mismatch" in got["bad"].label_error_message
    assert got["none"].label_status == "failed" and got["none"].change_class == "invalid"

    pixels = [(f"{t}{i}", r, c, float(m[r, c]), 0.0 if t == "a" else None)
              for i, pair in maps.items() for t, m in zip("ab", pair) for r in range(8) for c in range(8)]
    patches = spark.createDataFrame([(f"q{i}_{x}_{y}", f"a{i}", f"b{i}", x, y) for i in maps for x in (0, 2, 4) for y in (0, 2, 4)],
                                    "patch_id string, image_id_t1 string, image_id_t2 string, x int, y int")
    table = spark.createDataFrame(pixels, "image_id string, row int, col int, value double, nodata double").repartition(5)
    for r in pt.label_pixels(patches, table, 4, 2).collect():
        i = int(r.image_id_t1[1:])
        a, b = (m[r.y:r.y + 4, r.x:r.x + 4] for m in maps[i])
        ok = np.isfinite(a) & np.isfinite(b) & (a != 0)
        assert (r.valid_pixel_count, r.changed_pixel_count) == (ok.sum(), (a[ok] != b[ok]).sum())


@pytest.mark.parametrize("patch,stride", [(128, 63), (30, 7), (70, 64)])
def test_pixel_labels_of_any_stride(spark, patch, stride):
    """Windows over several blocks of 64 pixels; a repeated pixel, unknown pixels, an absent raster, repeated patches."""
    rng, side = np.random.default_rng(patch), 150
    maps = {n: rng.integers(0, 3, (side, side)).astype(float) for n in ("a", "b")}
    gone = rng.random((side, side)) < 0.1
    rows = [(n, r, c, float(m[r, c]), 0.0) for n, m in maps.items() for r in range(side) for c in range(side) if not (n == "b" and gone[r, c])]
    rows += [("a", 70, 70, 9.0, 0.0), ("a", 70, 70, None, 0.0), ("a", 70, 70, float("nan"), None), ("a", 3, 3, 0.0, 0.0)]
    maps["a"][70, 70] = 9.0
    table = spark.createDataFrame(rows, "image_id string, row int, col int, value double, nodata double").repartition(4)
    starts = range(0, side - patch + 1, stride)
    places = [(f"p{x}_{y}", "a", "b", x, y) for x in starts for y in starts] + [("again", "a", "b", 0, 0), ("lost", "a", "z", 0, 0), ("none", None, "b", 0, 0)]
    patches = spark.createDataFrame(places, "patch_id string, image_id_t1 string, image_id_t2 string, x int, y int")
    got = {r.patch_id: r for r in pt.label_pixels(patches, table, patch, stride).collect()}
    assert len(got) == len(places)
    for name, raster in (("lost", "z"), ("none", "None")):
        assert (got[name].label_status, got[name].change_class, got[name].label_error_message) == ("failed", "invalid", "no pixels of raster " + raster)
        assert got[name].valid_pixel_count is None
    for name, _, second, x, y in places:
        if name not in ("lost", "none"):
            a, b, no = (m[y:y + patch, x:x + patch] for m in (maps["a"], maps["b"], gone))
            ok = (a != 0) & (b != 0) & ~no
            assert (got[name].valid_pixel_count, got[name].changed_pixel_count) == (ok.sum(), (ok & (a != b)).sum())


def test_robust_scale(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=200)
    df = spark.createDataFrame([(v.tolist(),), ([5.0] * 4,), ([float("nan"), 1.0, None],)], "v array<double>")
    got = [r.o for r in pt.robust_scale(df, "v", "o").collect()]
    lo, hi = np.percentile(v, [1, 99])
    assert np.allclose(got[0], np.clip((v - lo) / (hi - lo), 0, 1))
    assert got[1] == [0.0] * 4 and got[2][0] == 0.0 and got[2][1] == 1.0


def test_vectors_and_missing_columns(spark):
    df = spark.createDataFrame([(1.5, None, float("inf"))], "a double, b double, c double")
    assert pt.assemble_vector(df, ["c", "a", "b"]).first().tabular == [0.0, 1.5, 0.0]
    with pytest.raises(KeyError):
        pt.assemble_vector(df, ["zz"])


def make_model():
    def model(a, b, c):  # local, so that it reaches the workers by value
        return a.max(axis=1) + (b ** 2).sum(axis=1) - c.sum(axis=1)

    return model


@pytest.mark.parametrize("window,stride,mask", [(2, 2, "zero"), (3, 2, "channel_mean"), (9, 4, "zero")])
def test_occlusion_bruteforce(spark, window, stride, mask):
    model, rng = make_model(), np.random.default_rng(5)
    c, h, w = 2, 5, 4
    data = [(f"p{i}", rng.normal(size=c * h * w), rng.normal(size=c * h * w), rng.normal(size=3)) for i in range(3)]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist(), t.tolist()) for i, a, b, t in data], "patch_id string, image_t1 array<double>, image_t2 array<double>, tabular array<double>")
    got = {(r.patch_id, r.target_image): r for r in ex.occlusion(df, model, c, h, w, ["patch_id"], window, stride, mask).collect()}
    for pid, a, b, t in data:
        full = model(a[None], b[None], t[None])[0]
        for side in ("t1", "t2"):
            heat, count = np.zeros((h, w)), np.zeros((h, w))
            for y in ex.window_starts(h, window, stride):
                for x in ex.window_starts(w, window, stride):
                    parts = {"t1": a.reshape(c, h, w).copy(), "t2": b.reshape(c, h, w).copy()}
                    fill = 0.0 if mask == "zero" else parts[side].mean(axis=(1, 2), keepdims=True)
                    parts[side][:, y:y + window, x:x + window] = fill
                    heat[y:y + window, x:x + window] += abs(full - model(parts["t1"].reshape(1, -1), parts["t2"].reshape(1, -1), t[None])[0])
                    count[y:y + window, x:x + window] += 1
            heat /= np.maximum(count, 1)
            r = got[pid, side]
            assert np.allclose(np.array(r.heat).reshape(h, w), heat)
            assert math.isclose(r.mean_importance, heat.mean(), abs_tol=1e-12) and math.isclose(r.max_importance, heat.max(), abs_tol=1e-12)


def test_window_starts():
    assert ex.window_starts(128, 16, 16) == list(range(0, 128, 16))
    assert ex.window_starts(10, 4, 4) == [0, 4, 6]
    assert ex.window_starts(3, 5, 2) == [0]
    with pytest.raises(ValueError):
        ex.window_starts(3, 0, 1)


def test_representatives_fill_to_the_target(spark):
    rows = [(f"p{i}", f"q{i % 5}", f"d{i % 7}", "test" if i % 4 else "train", ["low", "medium", "high"][i % 3], "cross_season_sameyear", "short", i / 100) for i in range(200)]
    df = spark.createDataFrame(rows, "patch_id string, pair_id string, district string, split string, change_class string, pair_type string, time_gap_group string, abs_error double")
    got = ex.representative_samples(df.repartition(5), 60).collect()
    assert len(got) == 60 and len({r.patch_id for r in got}) == 60 and {r.split for r in got} == {"test"}
    assert {r.change_class for r in got} == {"low", "medium", "high"} and len({r.district for r in got}) == 7
    assert ex.representative_samples(df, 1000).count() == 150
    again = ex.representative_samples(df.repartition(3), 60)
    assert {(r.patch_id, r.selection_reason) for r in again.collect()} == {(r.patch_id, r.selection_reason) for r in got}
    index = df.select("patch_id", F.concat(F.lit("/"), "patch_id").alias("npz_path"))
    assert ex.handoff_samples(df, index, 50).count() == 50 and ex.handoff_samples(df, index, 900).count() == 200


@pytest.mark.parametrize("most", [1, 4, 10, 50])
def test_spatial_sample_of_named_patches(spark, most):
    """Ids that say pair and place: same rows, and patches that lie together by pair are not shuffled."""
    rows = [(f"{p}_x{x}_y{y}", x, y, p) for p, nx, ny in (("a", 12, 9), ("b", 1, 30), ("c", 2, 2)) for x in range(0, nx * 64, 64) for y in range(0, ny * 64, 64)]
    df = spark.createDataFrame([(*r, 128) for r in rows], "patch_id string, x int, y int, pair_id string, patch_size int")
    laid = df.repartition(6, "pair_id")
    named = pt.spatial_sample(laid, most, named=True)
    assert named._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {tuple(r) for r in pt.spatial_sample(df, most).collect()}
    assert {tuple(r) for r in named.collect()} == want
    twice = laid.unionByName(laid)
    if most == 50:  # both copies of an id are sampled
        with pytest.raises(Exception, match="not unique"):
            pt.spatial_sample(twice, most, named=True).collect()
    if most == 1:  # a copy of a sampled row does not come along
        assert len(pt.spatial_sample(twice, most, named=True).collect()) == 3
    with pytest.raises(Exception, match="does not name"):
        pt.spatial_sample(laid.withColumn("patch_id", F.concat("patch_id", F.lit("a"))), most, named=True).collect()
    with pytest.raises(Exception, match="does not name"):
        pt.spatial_sample(laid.withColumn("patch_size", F.col("x") + 1), most, named=True).collect()
