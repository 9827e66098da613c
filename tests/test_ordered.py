"""Order statistics, component tests and surface distances against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import ranks, special
from evenhand.operators import ordered, resample, surfaces
from evenhand.plans import evaluation


def test_middle_places_are_those_of_resamples():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 6, 7, 30):
        lo, hi = ordered.middle_places(n, 60_000, np.random.default_rng(n))
        brute = np.sort(rng.integers(0, n, (60_000, n)), axis=1)
        for got, want in ((lo, brute[:, (n - 1) // 2]), (hi, brute[:, n // 2]), (lo + hi, brute[:, (n - 1) // 2] + brute[:, n // 2])):
            a, b = np.bincount(got, minlength=2 * n), np.bincount(want, minlength=2 * n)
            assert np.abs(a / 60_000 - b / 60_000).max() < 0.012


def test_left_out_places():
    for n in range(2, 12):
        x = np.arange(n) ** 2.0
        want = sorted(np.median(np.delete(x, i)) for i in range(n))
        assert sorted(v for times, p, q in ordered.left_out_places(n) for v in [(x[p] + x[q]) / 2] * times) == want


@pytest.mark.parametrize("small_rows", [1 << 20, 0])
def test_median_intervals_match_a_plain_bootstrap(spark, monkeypatch, small_rows):
    monkeypatch.setattr(ranks, "SMALL_ROWS", small_rows)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(10, 2, 41).round(1), "b": rng.normal(9, 3, 60).round(1)}
    rows = [("k", g, float(v)) for g, vs in groups.items() for v in vs] + [("k", "a", None), ("k", "b", float("nan")), ("k", None, 3.0), ("lone", "a", 1.0), ("three", "a", 1.0), ("three", "b", 1.0), ("three", "c", 2.0), ("tiny", "a", 1.0), ("tiny", "b", 4.0)]
    df = spark.createDataFrame(rows, "key string, grp string, value double")
    got = {r["key"]: r for r in ordered.median_bootstrap(df, ["key"], n_boot=20_000).collect()}
    assert set(got) == {"k", "tiny"} and got["tiny"]["point"] == -3.0
    reps = np.median(rng.choice(groups["a"], (20_000, 41)), axis=1) - np.median(rng.choice(groups["b"], (20_000, 60)), axis=1)
    jack = [np.median(np.delete(groups["a"], i)) - np.median(groups["b"]) for i in range(41)] + [np.median(groups["a"]) - np.median(np.delete(groups["b"], i)) for i in range(60)]
    point = np.median(groups["a"]) - np.median(groups["b"])
    lo, hi, how = resample.bca(point, reps, np.array(jack), np.ones(len(jack)), 0.05)
    assert abs(got["k"]["point"] - point) < 1e-9 and got["k"]["method"] == how
    assert abs(got["k"]["ci_lo"] - lo) < 0.2 and abs(got["k"]["ci_hi"] - hi) < 0.2
    again = {r["key"]: r for r in ordered.median_bootstrap(df.repartition(5), ["key"], n_boot=20_000).collect()}
    assert again == got
    gap = {r["key"]: r for r in ordered.median_bootstrap(df, ["key"], metric="gap", n_boot=500).collect()}
    assert gap["three"]["point"] == 1.0 and abs(gap["k"]["point"] - abs(point)) < 1e-9 and gap["lone"]["point"] == 0.0
    with pytest.raises(ValueError):
        ordered.median_bootstrap(df, ["key"], metric="mode")


@pytest.mark.parametrize("small_rows", [1 << 20, 0])
def test_ks_distance_and_p(spark, monkeypatch, small_rows):
    monkeypatch.setattr(ranks, "SMALL_ROWS", small_rows)
    rng = np.random.default_rng(6)
    groups = {g: rng.normal(m, 1, n).round(1) for g, m, n in (("a", 0, 30), ("b", 0.7, 47))}
    rows = [("k", g, float(v)) for g, vs in groups.items() for v in vs] + [("k", "a", float("nan")), ("k", "b", None), ("one", "a", 1.0)]
    got = ordered.ks_two_sample(spark.createDataFrame(rows, "key string, grp string, value double"), ["key"]).collect()
    assert len(got) == 1 and (got[0]["n_a"], got[0]["n_b"]) == (30, 47)
    d = max(abs(np.mean(groups["a"] <= x) - np.mean(groups["b"] <= x)) for x in np.concatenate(list(groups.values())))
    assert abs(got[0]["d"] - d) < 1e-12 and abs(got[0]["p"] - special.ks_exact_p(d, 30, 47)) < 1e-12


def test_exact_ks_p_counts_all_arrangements():
    for n1, n2 in ((1, 1), (2, 3), (4, 4), (4, 6), (3, 7)):
        seen = []
        for a in map(set, itertools.combinations(range(n1 + n2), n1)):
            steps = np.cumsum([n2 if k in a else -n1 for k in range(n1 + n2)])
            seen.append(np.abs(steps).max())
        for d in set(seen):
            assert abs(special.ks_exact_p(d / (n1 * n2), n1, n2) - np.mean(np.array(seen) >= d)) < 1e-9
    assert abs(special.ks_p(0.03, 5000, 6000) - special.ks_p(0.03, 5000, 6000, exact_to=1)) < 1e-3


def test_exact_rank_sum_p_has_no_limit_of_size():
    below, above = special.mwu_p(2000.0, 8, 2500, 0), special.mwu_p(2000.8, 8, 2501, 0)
    assert abs(below - above) < 1e-7 and below < 1e-5


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, float("nan"), 0.9]
    got = {r["i"]: r["p_holm"] for r in ordered.holm(spark.createDataFrame([(i, "f", x) for i, x in enumerate(p)], "i int, f string, p double"), ["f"]).collect()}
    assert np.allclose([got[i] for i in (3, 0, 2, 1, 6)], [0.025, 0.04, 0.09, 0.09, 0.9]) and got[4] is None and got[5] is None


def test_auroc_permutation_agrees_with_all_permutations(spark):
    score = [0.1, 0.4, 0.4, 0.5, 0.7, 0.7, 0.7, 0.9]
    label = [False, False, True, False, True, True, False, True]
    rows = [("k", s, y) for s, y in zip(score, label, strict=True)] + [("k", None, True), ("k", float("nan"), False), ("k", 0.3, None), ("one class", 0.2, True)]
    df = spark.createDataFrame(rows, "key string, score double, label boolean")
    got = ordered.auroc_permutation(df, ["key"], "label", "score", n_perm=4000).collect()
    area = lambda pos: np.mean([(score[i] > score[j]) + 0.5 * (score[i] == score[j]) for i in pos for j in range(8) if j not in pos])
    null = np.array([area(c) for c in itertools.combinations(range(8), 4)])
    seen = area([i for i in range(8) if label[i]])
    assert len(got) == 1 and abs(got[0]["auroc"] - seen) < 1e-12 and abs(got[0]["null_mean"] - 0.5) < 0.02
    assert abs(got[0]["p"] - np.mean(np.abs(null - 0.5) >= abs(seen - 0.5) - 1e-12)) < 0.05 and abs(got[0]["null_std"] - null.std()) < 0.02


def test_auroc_permutation_in_many_runs(spark, monkeypatch):
    monkeypatch.setattr(ordered, "DRAWN", 400)  # few replicates a draw
    rng = np.random.default_rng(2)
    rows = [("k", float(s), bool(y)) for s, y in zip(rng.normal(size=3000).round(3), rng.random(3000) < 0.3, strict=True)]
    got = ordered.auroc_permutation(spark.createDataFrame(rows, "key string, score double, label boolean"), ["key"], "label", "score", n_perm=300).first()
    pos = sum(r[2] for r in rows)
    assert got["n_perm"] == 300 and abs(got["null_mean"] - 0.5) < 0.005
    assert abs(got["null_std"] / np.sqrt(3001 / (12 * pos * (3000 - pos))) - 1) < 0.15  # the rank-sum's variance


# Surfaces ---------------------------------------------------------------------------------------------------------------


def test_distance_transform_is_exact():
    rng = np.random.default_rng(1)
    for shape, spacing, share in (((7, 5, 6), (0.5, 1.0, 4.0), 0.05), ((1, 9, 3), (1.0, 0.3, 2.0), 0.2), ((12, 12, 12), (1.0, 1.0, 1.0), 0.01), ((4, 4, 4), (1.0, 1.0, 1.0), 0.0)):
        sites = rng.random(shape) < share
        got = surfaces.distance_squared(sites, spacing)
        at = np.argwhere(sites) * spacing
        for p in np.ndindex(*shape):
            want = ((np.array(p) * spacing - at) ** 2).sum(axis=1).min() if len(at) else np.inf
            assert got[p] == pytest.approx(want)


def test_element_areas():
    unit = surfaces.element_areas((1.0, 1.0, 1.0))
    assert unit[0] == unit[255] == 0 and unit[1] == pytest.approx(np.sqrt(3) / 8)  # a corner is a triangle of three middles
    side = sum(1 << i for i, c in enumerate(surfaces.CORNERS) if c[0] == 0)
    assert unit[side] == pytest.approx(1) and surfaces.element_areas((2.0, 3.0, 5.0))[side] == pytest.approx(15)
    opposite = 1 | 1 << 7
    assert unit[opposite] == pytest.approx(2 * unit[1])
    for code in range(256):  # in and out have one surface, but where two corners of a face are set apart
        if all(len(loop) < 7 for c in (code, 255 - code) for loop in surfaces._polygons(c)) and unit[code] > 0:
            assert 0 < unit[code] < 2
    box = np.zeros((12, 9, 7), bool)
    box[1:-1, 1:-1, 1:-1] = True
    on, area = surfaces.elements(box, (1.0, 2.0, 0.5))
    faces = 2 * (10 * 14 + 10 * 2.5 + 14 * 2.5)
    assert 0.85 * faces < area[on].sum() < faces  # rounded edges


def plain_hausdorff(ref, pred, spacing):
    ends, table = [], surfaces.element_areas(spacing)
    found = []
    for mask in (ref, pred):
        rows = []
        for p in np.ndindex(*[n - 1 for n in mask.shape]):
            code = sum(int(mask[p[0] + c[0], p[1] + c[1], p[2] + c[2]]) << i for i, c in enumerate(surfaces.CORNERS))
            if 0 < code < 255:
                rows.append((*[x * s for x, s in zip(p, spacing, strict=True)], table[code]))
        found.append(np.array(rows))
    for a, b in (found, found[::-1]):
        far = np.sqrt(((a[:, None, :3] - b[None, :, :3]) ** 2).sum(axis=2)).min(axis=1)
        order = np.argsort(far)
        share = np.cumsum(a[order, 3]) / a[:, 3].sum()
        ends.append(far[order][min(np.searchsorted(share, 0.95), len(far) - 1)])
    return max(ends)


def test_weighted_surface_distance_matches_all_pairs():
    rng = np.random.default_rng(3)
    for spacing in ((1.0, 1.0, 1.0), (0.5, 0.5, 4.0)):
        masks = [np.pad(rng.random((6, 7, 5)) < p, 1) for p in (0.3, 0.6)]
        assert surfaces.robust_hausdorff(*masks, spacing) == pytest.approx(plain_hausdorff(*masks, spacing))
    none = np.zeros((4, 4, 4), bool)
    assert np.isnan(surfaces.robust_hausdorff(none, none, (1.0, 1.0, 1.0))) and np.isinf(surfaces.robust_hausdorff(none, ~none, (1.0, 1.0, 1.0)))


def test_masks_to_scores_in_one_job(spark, tmp_path):
    import io

    def save(side, name, grid, spacing=(0.5, 1.0, 2.0)):
        (tmp_path / side).mkdir(exist_ok=True)
        out = io.BytesIO()
        np.savez(out, grid=grid, spacing=np.array(spacing))
        (tmp_path / side / f"{name}.npz").write_bytes(out.getvalue())

    def decode(content):
        import io

        import numpy as np

        f = np.load(io.BytesIO(content))
        return f["grid"], tuple(f["spacing"])

    rng = np.random.default_rng(0)
    grids = {n: (rng.integers(0, 3, (6, 5, 4)), rng.integers(0, 3, (6, 5, 4))) for n in ("a", "b")}
    for n, (r, p) in grids.items():
        save("ref", n, r)
        save("pred", n, p)
    for n, r, p in (("blank", np.zeros((3, 3, 3)), np.zeros((3, 3, 3))), ("shape", np.ones((3, 3, 3)), np.ones((3, 3, 4))), ("flat", np.ones((3, 3)), np.ones((3, 3)))):
        save("ref", n, r)
        save("pred", n, p)
    save("ref", "no_pred", np.ones((2, 2, 2)))
    save("ref", "broken", np.ones((2, 2, 2)))
    (tmp_path / "pred" / "broken.npz").write_bytes(b"no archive")
    (tmp_path / "pred" / "notes.txt").write_text("not a mask")
    names = ["a", "b", "blank", "shape", "flat", "no_pred", "broken", "nowhere"]
    cases = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "case_id string, series long")
    sides = [evaluation.read_masks(spark, str(tmp_path / side), decode, r"/([^/]+)\.npz$") for side in ("ref", "pred")]
    got = {r["case_id"]: r for r in evaluation.evaluate_masks(cases, *sides).collect()}
    assert {n: (got[n]["status"], got[n]["missing"]) for n in names} == {
        "a": ("ok", ""), "b": ("ok", ""), "blank": ("ok", ""), "shape": ("shape_mismatch", ""), "flat": ("unreadable", ""),
        "no_pred": ("missing", "prediction"), "broken": ("unreadable", ""), "nowhere": ("missing", "prediction,reference"),
    }
    assert "prediction unreadable" in got["broken"]["problem"] and got["shape"]["dice_vb"] is None and got["a"]["series"] == 0
    for n, (r, p) in grids.items():
        for name, label in (("vb", 1), ("disc", 2)):
            assert got[n][f"dice_{name}"] == pytest.approx(2 * ((r == label) & (p == label)).sum() / ((r == label).sum() + (p == label).sum()))
            assert got[n][f"hd95_{name}"] == pytest.approx(plain_hausdorff(np.pad(r == label, 1), np.pad(p == label, 1), (0.5, 1.0, 2.0)))
    assert all(np.isnan(got["blank"][f"{m}_{x}"]) for m in ("dice", "hd95", "ndsc") for x in ("vb", "disc"))
    load = np.mean([(grids["a"][0] == 1).mean(), (grids["b"][0] == 1).mean(), 0])
    r, p = (g == 1 for g in grids["a"])
    kappa = (1 - load) * r.sum() / (load * (~r).sum())
    assert got["a"]["ndsc_vb"] == pytest.approx(2 * (r & p).sum() / (kappa * (p & ~r).sum() + 2 * (r & p).sum() + (r & ~p).sum()))
    with pytest.raises(ValueError):
        evaluation.evaluate_masks(cases, *sides, metrics=("iou",))
