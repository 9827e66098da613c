"""Jobs and reports: audits by stage, data sets, sinks, general resampling, runs of values."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import ranks
from evenhand.operators import hypothesis, quality, resample, splits
from evenhand.operators import summaries as s
from evenhand.plans import audit, datasets, reports, volumes
from evenhand.sources import tables
from evenhand.sources.fixtures import view


@pytest.mark.parametrize("small_rows", [1 << 20, 0])  # a key a task, and run by run
def test_positions_are_those_of_a_plain_order(spark, small_rows):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=60).round(1).tolist(), 1e300, -1e300, 1e-300, 0.0, -0.0, float("inf"), -float("inf"), 5.0, 5.0000001]
    rows = [(k, g, float(v)) for k in ("k", None) for g in ("a", "b", "c") for v in rng.choice(values, 80)]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    f = ranks.counted(df, ["k", "g"], "v")
    got = ranks.positions(f, ["k"], ["g"], "v", small_rows=small_rows).collect()
    assert sum(r["t"] for r in got) == len(rows)
    for r in got:
        pool = [v for k, _, v in rows if k == r["k"]]
        own = [v for k, g, v in rows if (k, g) == (r["k"], r["g"])]
        assert (r["below"], r["same"]) == (sum(v < r["v"] for v in pool), sum(v == r["v"] for v in pool))
        assert (r["before"], r["n"]) == (sum(v < r["v"] for v in own), len(own))


@pytest.mark.parametrize("small_rows", [1 << 20, 0])
def test_rank_family_and_summaries_in_runs(spark, monkeypatch, small_rows):
    monkeypatch.setattr(ranks, "SMALL_ROWS", small_rows)
    rng = np.random.default_rng(5)
    rows = [("k", g, float(v)) for g, m in (("a", 0), ("b", 1), ("c", 1)) for v in rng.normal(m, 1, 70).round(1)]
    df = spark.createDataFrame(rows, "key string, grp string, value double")
    pool = sorted(v for *_, v in rows)
    mid = {v: np.mean([i + 1 for i, x in enumerate(pool) if x == v]) for v in set(pool)}
    for r in hypothesis.rank_sums(df, ["key"]).collect():
        own = [v for _, g, v in rows if g == r["grp"]]
        assert abs(r["rank_sum"] - sum(mid[v] for v in own)) < 1e-9 and abs(r["median"] - np.median(own)) < 1e-12
        assert r["k"] == 3 and r["total"] == 210 and r["ties"] == sum(pool.count(v) ** 3 - pool.count(v) for v in set(pool))
    for r in s.group_summary(df, ["grp"]).collect():
        own = sorted(v for _, g, v in rows if g == r["grp"])
        want = (len(own), np.mean(own), np.median(own), np.std(own, ddof=1), own[round(69 * 0.25)], own[round(69 * 0.75)])
        assert np.allclose([r[c] for c in ("n", "mean", "median", "std", "q25", "q75")], want)
    one = s.group_summary(spark.createDataFrame([("x", 2.0), ("y", None)], "grp string, value double"), ["grp"]).collect()
    assert [tuple(r) for r in one] == [("x", 1, 2.0, 2.0, None, 2.0, 2.0, 0.0)]


def test_large_families_are_adjusted_alike(spark):
    from evenhand.operators import hypothesis as h

    rng = np.random.default_rng(2)
    rows = [(i, "a" if i % 3 else "b", float(p)) for i, p in enumerate(np.round(rng.random(200) ** 3, 3))] + [(900, "a", None), (901, None, 0.5), (902, "a", float("nan"))]
    df = spark.createDataFrame(rows, "i int, f string, p double")
    one = {r["i"]: r["p_fdr"] for r in h.benjamini_hochberg(df, ["f"]).collect()}
    two = {r["i"]: r["p_fdr"] for r in h.benjamini_hochberg(df, ["f"], large=True).collect()}
    assert set(one) == set(two) and all((one[i] is None and two[i] is None) or abs(one[i] - two[i]) < 1e-12 for i in one)


def test_audit_stages_skip_and_reuse(spark, sf_dir, tmp_path):
    scores, exams = view(spark, sf_dir, "scores").filter("series_submitter_id % 5 = 0"), view(spark, sf_dir, "exams")
    for ruler in ("gold", "silver"):
        scores.filter(F.col("ruler") == ruler).drop("ruler").write.parquet(f"{tmp_path}/{ruler}")
    inputs, calls = {r: f"{tmp_path}/{r}" for r in ("gold", "silver")}, []
    evaluate = lambda path: calls.append(path) or spark.read.parquet(path)
    assert audit.run_stage(spark, "biased_ruler", {"gold": inputs["gold"]}, evaluate, exams, f"{tmp_path}/out") is None
    got = audit.run_stage(spark, "biased_ruler", inputs, evaluate, exams, f"{tmp_path}/out", n_boot=500, n_perm=500)
    assert len(calls) == 2 and got["comparison"].count() == 42
    assert {r["status"] for r in got["gaps"].collect()} == {"ok"} and got["regression"].select("score").distinct().count() == 2
    first = {(r["score"], r["grouping"]): r["dir_other"] for r in got["comparison"].collect()}
    again = audit.run_stage(spark, "biased_ruler", inputs, evaluate, exams, f"{tmp_path}/out", n_boot=500, n_perm=500)
    assert len(calls) == 2 and {(r["score"], r["grouping"]): r["dir_other"] for r in again["comparison"].collect()} == first
    with pytest.raises(ValueError):
        audit.run_stage(spark, "nonsense", inputs, evaluate, exams, f"{tmp_path}/out")


def test_splits_are_saved_and_applied(spark, sf_dir, tmp_path):
    exams = view(spark, sf_dir, "exams")
    placed = splits.split_patients(exams)
    datasets.save_splits(placed.select("series_submitter_id", *datasets.SPLIT_COLUMNS), str(tmp_path), "v1")
    schema = "series_submitter_id long, split string, race_bin string, age_bin string, stratum string, annotation_quality string"
    back = datasets.load_splits(spark, str(tmp_path), "v1", schema)
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {r["split"]: r["count"] for r in placed.groupBy("split").count().collect()}
    assert datasets.apply_splits(exams, back).filter("split IS NULL").count() == 0
    with pytest.raises(FileNotFoundError):
        datasets.load_splits(spark, str(tmp_path), "v2", schema)
    by_unit = splits.unit_folds(exams, "annotation_quality", "patient_id", "series_submitter_id")
    assert by_unit.groupBy("patient_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    tables.write_folds(splits.fold_rows(by_unit, "series_submitter_id"), f"{tmp_path}/folds")
    rows = spark.read.json(f"{tmp_path}/folds")
    assert rows.filter("role = 'val'").count() == exams.count() and rows.count() == 5 * exams.count()
    assert [tuple(r) for r in datasets.registry(spark, {2: ("b", "v2"), 1: ("a", "v1")}).collect()] == [(1, "a", "v1"), (2, "b", "v2")]


def test_manifest_and_descriptor(spark, tmp_path):
    rows = [(1, 10, "train"), (2, 10, "train"), (3, 11, "test"), (4, 12, "train"), (5, 13, "val")]
    files = spark.createDataFrame([(1, "x-000010_1.nii.gz"), (2, "x-000010_2.nii.gz"), (3, "x-000011.nii.gz"), (4, "odd.nii.gz")], "series_submitter_id long, filename string")
    made, bad = datasets.manifest(spark.createDataFrame(rows, "series_submitter_id long, patient_id long, split string"), files, r"x-(\d{6})")
    assert sorted((r["case_id"], r["split"]) for r in made.collect()) == [("case_000010_s0", "train"), ("case_000010_s1", "train"), ("case_000011", "test")]
    assert sorted((r["series_submitter_id"], r["problem"]) for r in bad.collect()) == [(4, "no_case_id"), (5, "no_file")]
    datasets.write_dataset(made, str(tmp_path))
    one = spark.read.json(f"{tmp_path}/dataset").first()
    assert (one["num_training"], one["num_test"], one["labels"]["disc"]) == (2, 1, 2)
    folded = spark.createDataFrame([(1, 0), (5, 1)], "series_submitter_id long, fold int")
    assert [tuple(r) for r in datasets.fold_cases(folded, made).collect()] == [(0, "case_000010_s0")]


def test_stats_are_keyed_json(spark, tmp_path):
    tables.write_stats(spark.createDataFrame([("a", 1.5, None), ("b", 2.5, "x")], "stat_key string, p double, note string"), f"{tmp_path}/stats")
    lines = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_path}/stats").collect()]
    assert sorted((x["key"], x["value"]["p"]) for x in lines) == [("a", 1.5), ("b", 2.5)]


def test_metadata_is_renamed_and_masks_are_left_out(spark):
    series = spark.createDataFrame([("s1", "t1", "p1", "Siemens", "x")], "submitter_id string, `imaging_studies.submitter_id` string, case_ids string, manufacturer string, type string").withColumn("_row", F.lit(1))
    studies = spark.createDataFrame([("t1", "p1", "d")], "submitter_id string, case_ids string, type string")
    cases = spark.createDataFrame([("p1", "Female", "c")], "submitter_id string, sex string, type string")
    files = tables.image_files(spark.createDataFrame([("a.nii.gz", "s1"), ("a_SEG.nii.gz", "s1")], "file_name string, series string"))
    got = reports.load_exams(series, studies, cases, files).collect()
    assert [(r["series_submitter_id"], r["patient_id"], r["manufacturer"], r["sex"], r["filename"]) for r in got] == [("s1", "p1", "SIEMENS", "Female", "a.nii.gz")]
    assert spark.createDataFrame([("a.nii.gz",)], "f string").select(tables.mask_name("f")).first()[0] == "a_SEG.nii.gz"


def test_segmentation_job_of_a_small_grid(spark):
    voxels = spark.createDataFrame([(1, 0, 0, 0, 1, 1), (1, 0, 0, 1, 1, 0), (1, 5, 5, 5, 1, 1), (1, 3, 3, 3, 2, 2), (2, 0, 0, 0, 0, 0)], "case_id long, x int, y int, z int, ref int, pred int")
    grid = spark.createDataFrame([(1, 9, 9, 9, 1.0, 1.0, 2.0), (2, 9, 9, 9, 1.0, 1.0, 2.0)], "case_id long, nx int, ny int, nz int, sx double, sy double, sz double")
    table, bad = volumes.segmentation_job(voxels, grid)
    got = {r["case_id"]: r for r in table.collect()}
    assert (got[1]["n_voxels_vb"], got[1]["volume_mm3_vb"], got[1]["n_components_vb"], got[1]["n_components_disc"]) == (3, 6.0, 2, 1)
    assert got[2]["n_voxels_vb"] == 0 and bad.count() == 0
    assert volumes.segmentation_job(voxels, grid, spark.createDataFrame([(1,)], "case_id long"))[0].count() == 1
    with pytest.raises(ValueError):
        quality.require_rows(table.limit(0))


def test_permutations_are_bijections():
    seeds = np.arange(50, dtype=np.uint64)
    for n in (1, 2, 3, 8, 9, 10, 97, 1000):
        got = resample.permuted(np.arange(n), n, seeds)
        assert (np.sort(got, axis=1) == np.arange(n)).all()
        parts = np.concatenate([resample.permuted(np.arange(n)[i::3], n, seeds) for i in range(3) if i < n], axis=1)
        assert (np.sort(parts, axis=1) == np.arange(n)).all()  # rows of different tasks never meet
    many = resample.permuted(np.arange(8), 8, np.arange(40_000, dtype=np.uint64))
    assert len({tuple(x) for x in many.tolist()}) > 20_000 * 0.9  # of 40,320 permutations
    assert abs(np.bincount(many[:, 0], minlength=8) / 40_000 - 1 / 8).max() < 0.01


def test_poisson_weights_are_poisson():
    w = resample.poisson_weights(np.arange(2000), np.arange(50, dtype=np.uint64))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and w.max() < 12


def test_permutation_keeps_group_sizes_and_agrees_with_all_permutations(spark):
    values = {"a": [1.0, 2.5, 3.0], "b": [2.0, 4.0, 5.5, 6.0, 7.0]}
    rows = [(i, k, g, v + (k == "l") * 0.1 * i) for k in "kl" for i, (g, v) in enumerate((g, v) for g, vs in values.items() for v in vs)]
    df = spark.createDataFrame(rows, "row_id long, key string, grp string, value double").repartition(3)
    sums = resample.replicate_sums(df, ["key"], "grp", "row_id", {"x": F.col("value")}, 300, 1, True).collect()
    assert len(sums) == 2 * 300 * 2 and all(r["n"] == len(values[r["grp"]]) for r in sums)
    got = {r["key"]: r for r in resample.general_permutation(df, ["key"], "grp", "value", n_perm=4000).collect()}
    for k in "kl":
        own = [v for _, key, _, v in rows if key == k]
        null = [abs(np.mean(c) - (sum(own) - sum(c)) / 5) for c in itertools.combinations(own, 3)]
        seen = abs(np.mean(own[:3]) - np.mean(own[3:]))
        want = np.mean(np.abs(np.array(null) - np.mean(null)) >= abs(seen - np.mean(null)) - 1e-12)
        assert abs(got[k]["observed"] - seen) < 1e-9
        assert abs(got[k]["p"] - want) < 4 * math.sqrt(0.25 / 4000) and abs(got[k]["null_mean"] - np.mean(null)) < 0.1


def test_resampling_takes_any_metric_of_group_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "k", "ab"[i % 2], float(x), float(2 * x + rng.normal() * (1 + i % 2))) for i, x in enumerate(rng.normal(size=1200))]
    df = spark.createDataFrame(rows, "row_id long, key string, grp string, x double, y double")
    n, x, y, xy, xx, yy = (F.col(c) for c in ("n", "x", "y", "xy", "xx", "yy"))
    sums = {"x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y}
    r = (xy / n - x / n * y / n) / F.sqrt((xx / n - x / n * x / n) * (yy / n - y / n * y / n))
    got = resample.general_bootstrap(df, ["key"], "grp", sums=sums, metric=F.max(r) - F.min(r), n_boot=400).first()
    c = [np.corrcoef([p[3] for p in rows if p[2] == g], [p[4] for p in rows if p[2] == g])[0, 1] for g in "ab"]
    assert abs(got["point"] - abs(c[0] - c[1])) < 1e-9 and got["ci_lo"] < got["point"] < got["ci_hi"]
    assert resample.general_permutation(df, ["key"], "grp", sums=sums, metric=F.max(r) - F.min(r)).first()["p"] < 0.02


def test_general_resampling_agrees_with_theory(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 2 else "b", float(v + (i % 2))) for i, v in enumerate(rng.normal(size=2000))]
    df = spark.createDataFrame(rows, "row_id long, grp string, value double").withColumn("key", F.lit("k"))
    got = resample.general_bootstrap(df, ["key"], "grp", "value").first()
    assert got["method"] == "bca" and got["ci_lo"] < got["point"] < got["ci_hi"] and 0.1 < got["ci_hi"] - got["ci_lo"] < 0.25  # 3.9 standard errors of 0.045
    again = resample.general_bootstrap(df.repartition(7), ["key"], "grp", "value").first()
    assert abs(again["ci_lo"] - got["ci_lo"]) < 1e-9
    far = resample.general_permutation(df, ["key"], "grp", "value").first()
    same = resample.general_permutation(df.withColumn("value", F.col("value") - F.when(F.col("grp") == "a", 1).otherwise(0)), ["key"], "grp", "value").first()
    assert far["p"] < 0.02 and same["p"] > 0.02 and abs(far["observed"] - got["point"]) < 1e-9
    ratio = resample.general_bootstrap(df, ["key"], "grp", F.exp("value"), combine=resample.COMBINE["ratio"]).first()
    assert 0.25 < ratio["point"] < 0.5 and ratio["ci_lo"] < ratio["point"] < ratio["ci_hi"]


def test_charts_and_categories(spark):
    gap = spark.createDataFrame([("r1", "s", "g", 0.7, True), ("r2", "s", "g", 0.9, False)], "ruler string, score string, grouping string, dir double, below_four_fifths boolean")
    assert [(r["ruler"], r["offset"], r["side"]) for r in audit.bars(gap).orderBy("ruler").collect()] == [("r1", -0.2, "below"), ("r2", 0.2, "above")]
    n = spark.createDataFrame([("x", 1), ("y", 5), ("x", 3)], "c string, n long")
    assert {(r["c"], r["total"], r["place"]) for r in s.by_marginal(n, "c").collect()} == {("y", 5, 1), ("x", 4, 2)}
    bins = s.integer_histogram(spark.createDataFrame([(1,), (3,), (3,)], "k int"), ["k"]).orderBy("bin").collect()
    assert [(r["bin"], r["lo"], r["n"]) for r in bins] == [(1, 0.5, 1), (2, 1.5, 0), (3, 2.5, 2)]


def test_medians_of_even_and_odd_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 3.0), ("b", None), ("c", float("inf"))]
    got = {r["k"]: r["median"] for r in s.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": 2.0, "b": 3.0, "c": math.inf}


def test_csv_keeps_infinities(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, None), (4, -float("inf"))], "i int, v double"), f"{tmp_path}/csv")
    got = {r["i"]: r["v"] for r in tables.read_csv(spark, f"{tmp_path}/csv", "i int, v double").collect()}
    assert got[1] == math.inf and math.isnan(got[2]) and got[3] is None and got[4] == -math.inf


def test_run_times_of_logs(spark, tmp_path):
    (tmp_path / "a.out").write_text("x\nRun time :   7200.5 sec\n")
    lines = spark.read.text(str(tmp_path)).withColumn("path", F.input_file_name())
    assert abs(reports.run_times(lines).first()["hours"] - 7200.5 / 3600) < 1e-9


def test_probe_and_its_null_control(spark):
    from pyspark.ml.functions import array_to_vector

    from evenhand.operators import probe

    rng = np.random.default_rng(4)
    rows = [(i, [float(x + 3 * (i % 2) * (j == 0)) for j, x in enumerate(rng.normal(size=4))], "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, kind string").withColumn("features", array_to_vector("v"))
    options = {"costs": (0.1, 10.0), "k": 3, "inner": 2}
    one = probe.probe(df, "id", ["kind"], **options)
    assert one.first()["mean"] > 0.95 and not df.storageLevel.useMemory
    noise = df.withColumn("features", array_to_vector(F.transform("v", lambda x: F.rand(1))))
    delta = probe.null_delta(one, probe.probe(noise, "id", ["kind"], costs=(1.0,), k=3)).first()
    assert delta["delta"] > 0.2
    assert [r[0] for r in spark.createDataFrame([(0.9,), (0.7,), (0.5,)], "x double").select(probe.leakage(F.col("x"))).collect()] == ["strong", "moderate", "weak"]
