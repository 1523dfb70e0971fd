import json
import os

import pytest
from pyspark.sql import functions as F

from pairscape.operators import audit as au
from pairscape.plans import reports as rp
from pairscape.sources import files, store, tables
from pairscape.sources import commits
from pairscape.streaming import labels


@pytest.mark.parametrize("kind", ["csv", "parquet", "json"])
def test_tables_by_suffix(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,\"b\"", None), (2, None, 1.5)], "i int, s string, d double")
    path = tables.save_table(df, f"{tmp_path}/t.{kind}")
    back = tables.load_table(spark, path).select("i", "s", "d")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_other_suffix_is_refused(spark, tmp_path):
    for call in (lambda: tables.load_table(spark, f"{tmp_path}/t.xlsx"), lambda: tables.save_table(spark.range(1), f"{tmp_path}/t")):
        with pytest.raises(ValueError):
            call()


def test_prediction_fallback(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_predictions(spark, f"{tmp_path}/p.csv")
    tables.save_table(spark.range(3), f"{tmp_path}/p.csv")
    assert tables.load_predictions(spark, f"{tmp_path}/p.parquet").count() == 3
    tables.save_table(spark.range(5), f"{tmp_path}/p.parquet")
    assert tables.load_predictions(spark, f"{tmp_path}/p").count() == 5
    assert tables.load_predictions(spark, f"{tmp_path}/p.csv").count() == 3


def test_metrics_forms(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"mae": 0.5, "r2": None, "name": "x"}, indent=1))
    (tmp_path / "long.csv").write_text("metric,value\nmae,0.25\nrmse,1\n")
    (tmp_path / "wide.csv").write_text("mae,rmse\n0.1,0.2\n")

    def read(name):
        return {r.metric: r.value for r in tables.load_metrics(spark, f"{tmp_path}/{name}").collect()}

    assert read("m.json") == {"mae": "0.5", "r2": None, "name": "x"}
    assert read("long.csv") == {"mae": "0.25", "rmse": "1"}
    assert read("wide.csv") == {"mae": "0.1", "rmse": "0.2"}
    assert read("absent.json") == {}


def test_split_folders_prune(spark, tmp_path):
    df = spark.createDataFrame([(i, ["train", "val"][i % 2]) for i in range(40)], "i int, split string")
    path = tables.write_by_split(df, f"{tmp_path}/s")
    part = tables.read_split(spark, path, "val")
    assert part.count() == 20 and sorted(d for d in os.listdir(path) if d.startswith("split")) == ["split=train", "split=val"]
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()


def test_scan_and_artifacts(spark, tmp_path):
    assert files.scan_files(spark, f"{tmp_path}/none").count() == 0
    deep = tmp_path / "a" / "cnn_regression"
    deep.mkdir(parents=True)
    for name in ("S2_30m_2016_Winter_Khulna.TIF", "b.tiff", "c.tif.txt", "d.png", "e.Md", "my_vit_regression.json"):
        (deep / name).write_text("12345")
    (tmp_path / "my_vit_regression.json").write_text("{}")
    (tmp_path / "plain.csv").write_text("x")
    found = [r.path for r in files.scan_files(spark, str(tmp_path)).collect()]
    assert [os.path.basename(p) for p in found] == ["S2_30m_2016_Winter_Khulna.TIF", "b.tiff"] and found == sorted(found)
    inventory = {r.filename: r for r in files.scan_inventory(spark, str(tmp_path)).collect()}
    assert inventory["S2_30m_2016_Winter_Khulna.TIF"].parse_status == "success" and inventory["b.tiff"].parse_status == "failed"
    rows = {(r.artifact_type, os.path.basename(r.path)): r for r in files.artifact_index(spark, str(tmp_path)).collect()}
    assert set(rows) == {("png", "d.png"), ("md", "e.Md"), ("json", "my_vit_regression.json"), ("csv", "plain.csv"), ("png_folder", "cnn_regression")} or len(rows) == 5
    assert rows["png", "d.png"].experiment_name == "cnn_regression" and rows["png", "d.png"].size_bytes == 5
    assert rows["csv", "plain.csv"].experiment_name == "unknown"
    assert rows["png_folder", "cnn_regression"].size_bytes is None


def test_experiment_names(spark):
    df = spark.createDataFrame([("/x/my_vit_regression.json",), ("/x/vit_regression_a.png",), ("/x/regression.csv",), ("/maxvit_regression/q.md",)], "p string")
    assert [r[0] for r in df.select(files.experiment_name("p")).collect()] == ["vit_regression", "vit_regression", "unknown", "maxvit_regression"]


def samples(spark, ids):
    rows = [(i, "q", "d", "test" if n % 2 else "train", "low", "t", "g", 0.1, [1.0], [2.0], [3.0]) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "patch_id string, pair_id string, district string, split string, change_class string, pair_type string, "
                                 "time_gap_group string, change_ratio float, image_t1 array<float>, image_t2 array<float>, tabular array<float>")


def failures(spark, rows):
    return spark.createDataFrame([(i, "q", "train", m) for i, m in rows], "patch_id string, pair_id string, split string, error_message string")


def test_sample_store_skips_what_it_has(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.write_samples(samples(spark, "abc"), failures(spark, [("d", "no band"), ("z", "cut short")]), path)
    assert {(r.patch_id, r.error_message) for r in store.read_errors(spark, path).collect()} == {("d", "no band"), ("z", "cut short")}
    index, errors, skipped = store.write_samples(samples(spark, "abcde"), failures(spark, [("z", "gone"), ("y", "new")]), path)
    assert sorted(r.patch_id for r in skipped.collect()) == ["a", "b", "c"] and index.count() == 5
    # d is stored by now, z failed again
    assert {(r.patch_id, r.error_message) for r in errors.collect()} == {("z", "gone"), ("y", "new")}
    assert sorted(r.patch_id for r in store.read_samples(spark, path).collect()) == list("abcde")
    assert store.read_samples(spark, path, "train").count() == 3
    assert {r.patch_id: os.path.basename(os.path.dirname(r.npz_path)) for r in index.collect()} == {c: "split=test" if n % 2 else "split=train" for n, c in enumerate("abcde")}
    store.write_samples(samples(spark, "xy"), failures(spark, []), path, force=True)
    assert sorted(r.patch_id for r in store.read_samples(spark, path).collect()) == ["x", "y"]
    assert store.read_errors(spark, path).count() == 0 and store.read_index(spark, path).count() == 2


def test_store_shows_an_interrupted_run_to_nobody(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    store.write_samples(samples(spark, "ab"), failures(spark, [("e", "bad")]), path)
    with monkeypatch.context() as m:
        m.setattr(store.CommitLog, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.write_samples(samples(spark, "abcd"), failures(spark, [("f", "worse")]), path)
        with pytest.raises(OSError):
            store.write_samples(samples(spark, "x"), failures(spark, []), path, force=True)
    assert sorted(r.patch_id for r in store.read_samples(spark, path).collect()) == ["a", "b"]
    assert [r.patch_id for r in store.read_errors(spark, path).collect()] == ["e"]
    index, _, _ = store.write_samples(samples(spark, "abcd"), failures(spark, []), path)
    assert index.count() == 4 == store.read_index(spark, path).count()
    with pytest.raises(FileNotFoundError):
        store.read_samples(spark, f"{tmp_path}/nothing")
    with pytest.raises(RuntimeError):
        commits.CommitLog(spark, f"{path}/_log").add("00000000", {})


def test_stream_equals_batch_resumes_and_starts_over(spark, tmp_path, monkeypatch):
    rows = [(f"p{i}", "q", [1.0, 2.0, float(i % 3)], [1.0, 2.0, 2.0] if i % 4 else [1.0], None, 9.0) for i in range(12)]
    df = spark.createDataFrame(rows, "patch_id string, pair_id string, values_t1 array<double>, values_t2 array<double>, nodata_t1 double, nodata_t2 double")
    source, ckpt, out = (f"{tmp_path}/{n}" for n in ("in", "ckpt", "out"))

    def shown():
        return sorted(map(tuple, labels.read_labels(spark, out, df.schema).collect()), key=str)

    def run(**options):
        labels.incremental_labels(spark, source, ckpt, out, df.schema, max_files=1, **options)
        return shown()

    def batch(part):
        return sorted(map(tuple, labels.labeled_stream(part).collect()), key=str)

    early = df.filter("patch_id < 'p5'")
    early.write.mode("append").parquet(source)
    assert shown() == [] and run() == batch(early)
    assert run() == batch(early)  # nothing new, nothing labeled twice
    df.filter("patch_id >= 'p5'").write.mode("append").parquet(source)
    # a run that ends between the data of a batch and its entry, then goes on
    with monkeypatch.context() as m:
        m.setattr(labels.CommitLog, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception):
            run()
    assert shown() == batch(early)
    assert run() == batch(df)
    # a forced run shows its labels at its end, and an interrupted one changes nothing
    real = labels.CommitLog.add

    def no_publishing(log, name, entry):
        if name.startswith("published-"):
            raise OSError("lost")
        real(log, name, entry)

    with monkeypatch.context() as m:
        m.setattr(labels.CommitLog, "add", no_publishing)
        with pytest.raises(OSError):
            run(force=True, minimum=1.1)
    assert shown() == batch(df)
    other = run(force=True, minimum=1.1)
    assert other == sorted(map(tuple, labels.labeled_stream(df, 1.1).collect()), key=str) and other != batch(df)
    assert run(minimum=1.1) == other


def test_nested_path_rewrite(spark):
    df = spark.createDataFrame(
        [("C:/old/a", [{"k": "C:/old/b"}], ("D:/old/C:/old/c", 1)), (None, None, None), ("x", [], ("y", 2))],
        "p string, m array<map<string,string>>, s struct<t:string,n:int>")
    out = au.rewrite_prefix(df, ["C:/old", "D:/old"], "/new").collect()
    assert (out[0].p, out[0].m, out[0].s.t, out[0].s.n) == ("/new/a", [{"k": "/new/b"}], "/new//new/c", 1)
    assert (out[1].p, out[1].m, out[1].s) == (None, None, None)
    rep = {(r.column, r.prefix): (r.changed_rows, r.remaining_rows) for r in au.rewrite_report(df, ["C:/old", "D:/old"], "/new").collect()}
    assert rep == {("p", "C:/old"): (1, 0), ("p", "D:/old"): (0, 0), ("m", "C:/old"): (1, 0), ("m", "D:/old"): (0, 0), ("s", "C:/old"): (1, 0), ("s", "D:/old"): (1, 0)}


def test_long_report(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "k string, n int")
    got = {(r.summary_type, r.value): r["count"] for r in rp.long_report(df, {"rows": rp.n_rows(), "top": F.max("n")}, {"by_k": "k", "by_n": "n"}).collect()}
    assert got == {("metric", "rows"): 3.0, ("metric", "top"): 2.0, ("by_k", "a"): 2.0, ("by_n", "1"): 1.0, ("by_n", "2"): 2.0}
    none = {(r.summary_type, r.value): r["count"] for r in rp.long_report(df.limit(0), {"rows": rp.n_rows()}, {"by_k": "k"}).collect()}
    assert none == {("metric", "rows"): 0.0}
