"""Formulas against published figures, invariants and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import special as sp
from evenhand.operators import grouping as g
from evenhand.operators import hypothesis as h
from evenhand.operators import metrics as m
from evenhand.operators import probe, quality, regress, resample, splits, summaries, voxels
from evenhand.sources import tables


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (sp.chi2_sf(3.841458820694124, 1), 0.05), (sp.chi2_sf(5.991464547107979, 2), 0.05), (sp.chi2_sf(7.814727903251179, 3), 0.05),
        (sp.t_sf2(2.2281388519649385, 10), 0.05), (sp.t_ppf(0.975, 4), 2.7764451051977987), (sp.f_sf(3.4780496907652276, 4, 10), 0.05),
        (sp.norm_sf(1.959963984540054), 0.025), (sp.mwu_exact_p(0, 3, 3), 0.1), (sp.mwu_p(2.0, 4, 5, 0.0), 0.0635),
    ],
)
def test_tails(got, want):
    assert abs(got - want) < 1e-4


def test_bh_of_three(spark):
    df = spark.createDataFrame([(1, 0.678), (2, 0.490), (3, 0.391), (4, None), (5, float("nan"))], "i int, p double")
    got = {r["i"]: r["p_fdr"] for r in h.benjamini_hochberg(df, []).collect()}
    assert [round(got[i], 3) for i in (1, 2, 3)] == [0.678] * 3 and got[4] is None and got[5] is None


def test_yates(spark):
    cells = spark.createDataFrame([("k", "a", "x", 10), ("k", "a", "y", 20), ("k", "b", "x", 20), ("k", "b", "y", 15), ("one", "a", "x", 3)], "key string, row string, col string, n long")
    got = {r["key"]: r for r in h.chi_squared(cells, ["key"]).collect()}
    n, e = 65, [30 * 30 / 65, 30 * 35 / 65, 35 * 30 / 65, 35 * 35 / 65]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip([10, 20, 20, 15], e, strict=True))
    assert abs(got["k"]["chi2"] - want) < 1e-9 and abs(got["k"]["cramers_v"] - math.sqrt(want / n)) < 1e-9
    assert math.isnan(got["one"]["chi2"])


def test_rank_tests_on_edge_rows(spark):
    rows = [("same", x, 1.0) for x in "aabb"] + [("two", "a", v) for v in (1.0, 2.0, 3.0)] + [("two", "b", v) for v in (4.0, 5.0, 6.0, float("inf"))]
    rows += [("two", "a", None), ("two", "b", float("nan"))]
    ranks = h.rank_sums(spark.createDataFrame(rows, "key string, grp string, value double"), ["key"])
    got = {r["key"]: r for r in h.mann_whitney(ranks, ["key"]).collect()}
    assert math.isnan(got["same"]["u"]) and got["same"]["p"] == 1.0 and got["same"]["rank_biserial"] == 0.0
    assert got["two"]["u"] == 0.0 and got["two"]["n_b"] == 4 and got["two"]["rank_biserial"] == 1.0 and abs(got["two"]["p"] - 2 / 35) < 1e-9
    same = {r["key"]: r for r in h.kruskal(ranks, ["key"], least=2).collect()}
    assert same["same"]["p"] == 1.0 and same["same"]["epsilon_squared"] == 0.0


def gap_of(spark, rows, score="dice_vb"):
    long = spark.createDataFrame([("r", score, "g", a, v) for a, v in rows], "ruler string, score string, grouping string, grp string, value double")
    return m.gaps(m.rates(long, m.policy(spark, [score]))).first()


def test_gap_edges(spark):
    nan = float("nan")
    got = gap_of(spark, [("a", 0.9), ("a", 0.8), ("b", 0.81), ("b", nan), ("b", None), ("c", nan)])
    assert (got["best_group"], got["worst_group"], got["dir"], got["dpd"], got["n"], got["n_groups"], got["n_fail"]) == ("b", "a", 0.5, 0.5, 3, 2, 1)
    assert math.isnan(gap_of(spark, [("a", 0.1), ("b", 0.2)])["dir"])
    assert gap_of(spark, [("a", nan), ("b", None)])["status"] == "no_valid_scores"
    tie = gap_of(spark, [("b", 0.9), ("a", 0.9)])
    assert (tie["best_group"], tie["worst_group"], tie["dir"]) == ("a", "a", 1.0)
    assert gap_of(spark, [("a", float("inf")), ("b", 1.0)], "hd95_vb")["dir"] == 0.0


def test_widening(spark):
    rows = [("gold", "s", "g", 0.8, 0.2), ("silver", "s", "g", 0.7, 0.3), ("gold", "s", "same", 1.0, 0.0), ("silver", "s", "same", 1.0, 0.0), ("gold", "s", "inf", 1.0, 0.0), ("silver", "s", "inf", 0.9, 0.1)]
    got = {r["grouping"]: r for r in m.compare_rulers(spark.createDataFrame(rows, "ruler string, score string, grouping string, dir double, dpd double"), "gold", "silver").collect()}
    assert abs(got["g"]["widening_pct"] - 50) < 1e-9 and got["same"]["widening_pct"] == 0.0 and math.isinf(got["inf"]["widening_pct"])
    assert [got[k]["direction"] for k in ("g", "same", "inf")] == ["wider", "unchanged", "wider"]


def test_nearest_quartiles(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 10.0)] + [("n", float("nan")), ("n", 1.0)], "grp string, value double")
    got = {r["grp"]: r for r in summaries.group_summary(df, ["grp"]).collect()}
    assert (got["g"]["q25"], got["g"]["q75"], got["g"]["median"], got["g"]["n"]) == (2.0, 3.0, 2.5, 4)
    assert math.isnan(got["n"]["mean"]) and math.isnan(got["n"]["std"])


def test_age_labels(spark):
    df = spark.createDataFrame([(52.0, 52.5), (53.0, 52.5), (None, 52.5)], "a double, m double")
    assert [r[0] for r in df.select(g.age_halves(F.col("a"), F.col("m"))).collect()] == ["<52", ">=52", None]
    assert [r[0] for r in spark.createDataFrame([(None,), (39.9,), (40.0,), (60.0,)], "a double").select(g.age_bins(F.col("a"))).collect()] == ["60+", "<40", "40-60", "60+"]


def test_resampling_does_not_depend_on_partitions(spark):
    rates = spark.createDataFrame([("k", "a", 40, 30), ("k", "b", 60, 30), ("k", "c", 0, 0), ("sure", "a", 5, 5), ("sure", "b", 5, 5)], "key string, grp string, n_valid long, n_success long")
    got = [sorted(map(tuple, resample.bootstrap(rates.repartition(p), ["key"], 2000).collect())) for p in (1, 5)]
    assert got[0] == got[1]
    by = {(r[0], r[1]): r for r in got[0]}
    assert by["k", "dpd"][3] < by["k", "dpd"][2] < by["k", "dpd"][4] and by["k", "dir"][5] == "bca"
    assert by["sure", "dir"][2:6] == (1.0, 1.0, 1.0, "percentile")
    perm = {(r["key"], r["metric"]): r for r in resample.permutation(rates, ["key"], 2000).collect()}
    assert perm["sure", "dpd"]["p"] == 1.0 and perm["k", "dpd"]["p"] < 0.05 and perm["k", "dpd"]["n_perm"] == 2000


def test_splits_hold_their_contract(spark):
    rows = [(i, i // 3, "Female" if i // 3 % 3 else "Male", ["White", "Black or African American", "Asian"][i // 3 % 3], float(20 + i % 60)) for i in range(600)]
    exams = spark.createDataFrame(rows, "series_submitter_id long, patient_id long, sex string, race string, age_at_imaging double")
    placed = splits.split_patients(exams).cache()
    assert splits.leaks(placed).count() == 0 and placed.count() == 600
    balanced = splits.downsample(placed, ["split"], "sex", "series_submitter_id").groupBy("split").pivot("sex").count().collect()
    assert all(r["Female"] == r["Male"] for r in balanced)
    kept = splits.downsample(placed, ["split"], "sex", "series_submitter_id", majority="Female").groupBy("sex").count().collect()
    assert {r["sex"]: r["count"] for r in kept}["Male"] == placed.filter("sex = 'Male'").count()
    sizes = [r["count"] for r in splits.folds(exams, "race", "series_submitter_id").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5
    lists = splits.fold_lists(splits.folds(exams, "race", "series_submitter_id"), "series_submitter_id").collect()
    assert all(len(r["train"]) + len(r["val"]) == 600 for r in lists)


def brute_hd95(a, b, s):
    d = np.sqrt((((a[:, None] - b[None]) * s) ** 2).sum(2))
    return max(np.percentile(d.min(1), 95), np.percentile(d.min(0), 95))


def test_voxel_scores(spark):
    rng = np.random.default_rng(0)
    rows, grid = [], {}
    for x in range(6):
        for y in range(5):
            for z in range(4):
                r, p = (int(rng.integers(0, 2)), int(rng.integers(0, 2)))
                grid[x, y, z] = (r, p)
                rows.append((1, x, y, z, r, p))
    rows.append((2, 0, 0, 0, 1, 0))
    vox = spark.createDataFrame(rows, "case_id int, x int, y int, z int, ref int, pred int")
    vol = spark.createDataFrame([(1, 6, 5, 4, 0.5, 1.0, 2.0), (2, 6, 5, 4, 0.5, 1.0, 2.0)], "case_id int, nx int, ny int, nz int, sx double, sy double, sz double")

    def edge(i):
        on = {k for k, v in grid.items() if v[i] == 1}
        steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
        return np.array(sorted(k for k in on if any((k[0] + a, k[1] + b, k[2] + c) not in on for a, b, c in steps)), float)

    got = {(r["case_id"], r["label"]): r["hd95"] for r in voxels.hd95(vox, vol).collect()}
    assert abs(got[1, "vb"] - brute_hd95(edge(0), edge(1), np.array([0.5, 1.0, 2.0]))) < 1e-9
    assert math.isnan(got[1, "disc"]) and math.isinf(got[2, "vb"])
    dice = {(r["case_id"], r["label"]): r["dice"] for r in voxels.dice(voxels.segmentation_counts(vox)).collect()}
    assert dice[2, "vb"] == 0.0 and math.isnan(dice[2, "disc"])
    todo, n = {k for k, v in grid.items() if v[0] == 1}, 0
    while todo:
        n, stack = n + 1, [todo.pop()]
        while stack:
            x, y, z = stack.pop()
            for q in ((x + 1, y, z), (x - 1, y, z), (x, y + 1, z), (x, y - 1, z), (x, y, z + 1), (x, y, z - 1)):
                if q in todo:
                    todo.remove(q)
                    stack.append(q)
    parts = {(r["case_id"], r["label"]): r["n_components"] for r in voxels.connected_components(vox).collect()}
    assert parts[1, "vb"] == n and parts[2, "vb"] == 1
    with pytest.raises(ValueError):
        voxels.case_scores(vox, vol, ("iou",))
    image = vox.select("case_id", "x", "y", (F.col("x") * 10.0).alias("intensity"))
    assert voxels.crop(image).filter("case_id = 1").agg(F.min("x")).first()[0] == 1
    mismatch = voxels.pair_masks(vox.select("case_id", "x", "y", "z", F.col("ref").alias("v")), vox.filter("case_id = 1").select("case_id", "x", "y", "z", F.col("pred").alias("v")))
    assert {r["case_id"]: r["status"] for r in mismatch.select("case_id", "status").distinct().collect()} == {1: "ok", 2: "shape_mismatch"}


def test_ols_matches_lstsq(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), str(c), float(1 + 2 * a + (c == "v") * 3 + e)) for a, c, e in zip(rng.normal(size=200), rng.choice(["u", "v"], 200), rng.normal(size=200) * 0.1, strict=True)]
    got = {r["term"]: r for r in regress.ols(spark.createDataFrame([*rows, (None, "u", 1.0), (1.0, "u", float("nan"))], "a double, c string, y double"), "y", ["c", "a"]).collect()}
    x = np.array([[1, c == "v", a] for a, c, _ in rows], float)
    want = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0]
    assert np.allclose([got[t]["coef"] for t in ("const", "c[v]", "a")], want) and got["a"]["n"] == 200 and got["a"]["p"] < 1e-10


def test_corrected_interval():
    mean, ci, naive = probe.corrected_interval([0.8, 0.82, 0.84, 0.86, 0.88])
    assert abs(mean - 0.84) < 1e-12 and abs(ci / naive - math.sqrt((1 / 5 + 1 / 4) * 5)) < 1e-9


def test_probe_finds_signal(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    rows = [(i, [float(v) for v in rng.normal(size=6) + y[i] * np.array([3, 0, 0, 0, 0, 0])], "ab"[y[i]]) for i in range(200)]
    df = probe.as_vector(spark.createDataFrame(rows, "i int, embedding array<double>, y string"))
    assert np.mean(probe.fold_scores(df, "i", "y", n_pcs=4, k=3, costs=(1.0,))) > 0.9


def test_extract_reports_failures(spark):
    def load():
        def encode(one):
            if int(one["i"].iloc[0]) == 1:
                raise ValueError("broken")
            return np.ones(3)

        return encode

    got = {r["i"]: r for r in probe.extract(spark.range(3).withColumnRenamed("id", "i"), "i", load).collect()}
    assert got[1]["status"] == "ValueError: broken" and got[0]["embedding"] == [1.0, 1.0, 1.0]


def test_validation(spark):
    df = spark.createDataFrame([(1, "x", -1.0), (1, None, 2.0)], "k long, s string, v double")
    spec = quality.Spec(types={"k": "int"}, required=("s", "gone"), unique=("k",), allowed={"s": ("y",)}, positive=("v",))
    got = {(r["rule"], r["column"]): r["n"] for r in quality.validate(df, spec).collect()}
    assert got == {("missing_column", "gone"): 1, ("type", "k"): 1, ("required", "s"): 1, ("allowed", "s"): 1, ("positive", "v"): 1, ("unique", "k"): 1}
    with pytest.raises(ValueError):
        quality.require_rows(df.limit(0))


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", None)], "k string, v double")
    tables.write_csv(df.withColumn("v", F.when(F.col("v") == float("inf"), "inf").otherwise(F.col("v").cast("string"))), f"{tmp_path}/csv")
    got = {r["k"]: r["v"] for r in tables.read_csv(spark, f"{tmp_path}/csv", "k string, v double").collect()}
    assert math.isnan(got["a"]) and math.isinf(got["b"]) and got["c"] is None
    tables.write_tsv(df.select("k"), f"{tmp_path}/tsv")
    assert tables.read_tsv(spark, f"{tmp_path}/tsv", "k string").count() == 3
    (tmp_path / "m.json").write_text('[{"case_id": "x"}, {"case_id": "y"}]')
    assert tables.read_records(spark, f"{tmp_path}/m.json", "case_id string").count() == 2
    built = []
    make = lambda: built.append(1) or df
    for _ in range(2):
        assert tables.materialize(spark, make, f"{tmp_path}/m", [f"{tmp_path}/csv"]).count() == 3
    assert len(built) == 1
    tables.materialize(spark, make, f"{tmp_path}/m", force=True)
    assert len(built) == 2


def test_chi_squared_with_empty_cells(spark):
    tables = {"wide": [[5, 0, 3], [0, 7, 2], [4, 4, 0], [0, 0, 6]], "two": [[3, 0], [2, 9]], "even": [[4, 4], [4, 4]], "row": [[3, 5]]}
    rows = [(k, f"r{i}", f"c{j}", n) for k, t in tables.items() for i, r in enumerate(t) for j, n in enumerate(r) if n or k == "two"]
    got = {r["key"]: r for r in h.chi_squared(spark.createDataFrame(rows, "key string, row string, col string, n long"), ["key"]).collect()}
    for k, t in tables.items():
        o = np.array(t, float)
        e = o.sum(axis=1, keepdims=True) * o.sum(axis=0) / o.sum()
        off = np.abs(o - e)
        if k in ("two", "even"):
            off = off - np.minimum(0.5, off)
        if k == "row":
            assert math.isnan(got[k]["chi2"]) and got[k]["p"] is None
        else:
            assert got[k]["chi2"] == pytest.approx((off**2 / e).sum(), abs=1e-9) and got[k]["n"] == o.sum()


def test_a_failed_build_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.materialize(spark, lambda: spark.range(3), path).count() == 3
    assert tables.materialize(spark, lambda: spark.range(9), path).count() == 3

    def fails():
        return spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))

    with pytest.raises(Exception, match="no"):
        tables.materialize(spark, fails, path, force=True)
    assert spark.read.parquet(path).count() == 3
    assert tables.materialize(spark, lambda: spark.range(9), path, force=True).count() == 9


def test_encoders_by_name(spark):

    items = spark.createDataFrame([(1, [1.0, 3.0]), (2, []), (3, None)], "id long, values array<double>")
    got = {r["id"]: r for r in probe.extract(items, "id", "moments").collect()}
    assert got[1]["embedding"] == [2.0, 1.0, 1.0, 3.0] and got[1]["status"] == "ok" and got[2]["embedding"] is None and got[3]["embedding"] is None
    with pytest.raises(ValueError, match="moments"):
        probe.extract(items, "id", "nobody")
    with pytest.raises(ValueError):
        probe.register_encoder("moments")(lambda: None)


def test_range_rules(spark):

    df = spark.createDataFrame([(1, 5.0, 2.0), (2, float("nan"), 20.0), (3, None, 1.0)], "id long, a double, b double")
    rules = quality.range_rules(spark.createDataFrame([("a", "a", None, 4.0, "critical"), ("sum", "a + b", 8.0, None, "warning"), ("b", "b", 1.5, 10.0, "warning")], "rule string, expression string, low double, high double, severity string"))
    got = sorted((r["id"], r["rule"], r["bound"], r["limit"], r["severity"]) for r in quality.broken_rules(df, "id", rules).collect())
    assert got == [(1, "a", "high", 4.0, "critical"), (1, "sum", "low", 8.0, "warning"), (2, "a", "nan", None, "critical"), (2, "b", "high", 10.0, "warning"), (2, "sum", "nan", None, "warning"), (3, "b", "low", 1.5, "warning")]
    with pytest.raises(ValueError):
        quality.broken_rules(df, "id", [])


def test_distance_transform_takes_few_array_steps(monkeypatch):
    """Short lines go without the lower envelope, whose steps are many small ones; long ones still take it, with the same distances."""
    from evenhand.operators import surfaces

    rng = np.random.default_rng(5)
    envelope, met = surfaces._lower_envelope, []
    monkeypatch.setattr(surfaces, "_lower_envelope", lambda f, step: met.append(f.shape) or envelope(f, step))
    for shape, spacing, long in (((52, 22, 9), (0.5, 0.5, 4.0), 0), ((3, 100, 5), (0.7, 1.1, 2.0), 1), ((100, 3, 70), (0.7, 1.1, 2.0), 1)):
        met.clear()
        sites = rng.random(shape) < 0.03
        got = surfaces.distance_squared(sites, spacing)
        at, grid = np.argwhere(sites) * spacing, np.argwhere(np.ones(shape, bool)) * spacing
        want = np.min([((grid - a) ** 2).sum(axis=1) for a in at], axis=0).reshape(shape)
        assert np.allclose(got, want) and len(met) == long
    assert np.isinf(surfaces.distance_squared(np.zeros((4, 5, 6), bool), (1.0, 1.0, 1.0))).all()


def test_labels_that_span_batches_stay_whole(spark):
    rows = [(c, v, i) for c in (None, "a", "b") for v in (1, 2) for i in range(7)]
    df = spark.createDataFrame(rows, "case_id string, v int, x int").repartition(3)
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = voxels.each_label(df, lambda x: int(x.sum()) * 100 + len(x), ("x",), "s", "long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert sorted((r["case_id"] or "", r["v"], r["s"]) for r in got) == [(c, v, 2107) for c in ("", "a", "b") for v in (1, 2)]
