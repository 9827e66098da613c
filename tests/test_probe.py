"""Probes against plain versions: the chosen penalty, out-of-fold regression, silhouettes, component tests."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from evenhand.functions import special
from evenhand.operators import ordered, probe


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    n = 150
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 6)) * np.array([3, 2, 1, 1, 0.5, 0.5])
    x[:, 1] += 1.5 * (label == 1)
    x[:, 2] += 1.0 * (label == 2)
    rows = [(i, [float(v) for v in x[i]], "abc"[label[i]], "low" if label[i] < 1 else "high", float(x[i, 0] - 2 * x[i, 1] + rng.normal() * 0.3)) for i in range(n)]
    rows[0] = (*rows[0][:4], None)
    df = spark.createDataFrame(rows, "id long, v array<double>, third string, two string, age double")
    return df.withColumn("features", array_to_vector("v")).cache()


def area(label, score):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))


def plain_fit(x, y, w, reg):
    """Weighted logistic regression of two classes by Newton steps: mean loss + reg / 2 |b|^2, intercept free."""
    z, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = np.r_[0, np.full(x.shape[1], reg)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) / w.sum() + ridge * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(ridge) + 1e-12 * np.eye(len(b))
        b = b - np.linalg.solve(h, g)
    return b


def test_penalty_is_chosen_by_the_score_that_is_reported(spark, points):
    costs, pcs, k, inner = (1e-3, 1e-1, 10.0), 3, 2, 2
    chosen = []
    scores = probe.fold_scores(points, "id", "two", n_pcs=pcs, k=k, costs=costs, inner=inner, chosen=chosen)
    placed, names = probe._placed(points, "id", "two", k, inner, 42)
    t = placed.select("label", "fold", "inner", vector_to_array("features").alias("x")).toPandas()
    x, y, fold, own = np.stack(t["x"]), t["label"].to_numpy(), t["fold"].to_numpy(), t["inner"].to_numpy()
    assert names == ["high", "low"]
    for f in range(k):
        train = fold != f
        centre = x[train].mean(axis=0)
        _, _, axes = np.linalg.svd(x[train] - centre, full_matrices=False)
        p = (x - centre) @ axes[:pcs].T  # as the probe has them: centred by the components' own mean or not is the intercept's
        w = np.where(y == 1, 1 / (2 * (y[train] == 1).mean()), 1 / (2 * (y[train] == 0).mean()))
        means = []
        for c in costs:
            got = []
            for i in range(inner):
                a, b = train & (own != i), train & (own == i)
                beta = plain_fit(p[a], y[a], w[a], 1 / (c * train.sum()))
                got.append(area(y[b], p[b] @ beta[1:]))
            means.append(np.mean(got))
        best = costs[int(np.argmax(np.round(means, 12)))]
        assert chosen[f] == best or abs(max(means) - means[costs.index(chosen[f])]) < 1e-6
        beta = plain_fit(p[train], y[train], w[train], 1 / (chosen[f] * train.sum()))
        assert abs(scores[f] - area(y[~train], p[~train] @ beta[1:])) < 5e-3


def test_probes_of_more_classes_and_layers(points):
    got = {r["attribute"]: r for r in probe.probe(points, "id", ["third", "two"], n_pcs=4, k=2, costs=(0.1, 10.0), inner=2).collect()}
    assert got["third"]["metric"] == "balanced_accuracy" and got["two"]["metric"] == "auroc"
    assert 0.4 < got["third"]["mean"] < 1 and 0.45 < got["two"]["mean"] < 1, got
    net = probe.probe(points, "id", ["two"], n_pcs=4, k=2, hidden=8).first()
    assert 0.45 < net["mean"] <= 1, net


def test_regression_on_components_is_least_squares_out_of_fold(points):
    got = probe.component_regression(points, "id", "age", n_pcs=6, k=3).first()
    rows = probe.folds(points.filter("age IS NOT NULL").withColumn("every", F.lit("all")), "every", "id", 3, "42").select("fold", "v", "age").toPandas()
    x, y, fold = np.c_[np.ones(len(rows)), np.stack(rows["v"])], rows["age"].to_numpy(), rows["fold"].to_numpy()
    out = np.zeros(len(y))
    for f in range(3):
        out[fold == f] = x[fold == f] @ np.linalg.lstsq(x[fold != f], y[fold != f], rcond=None)[0]
    assert got["n"] == 149 and got["r2"] == pytest.approx(1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)
    assert got["r2_folds"] == pytest.approx(np.mean([1 - ((y - out)[fold == f] ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum() for f in range(3)]), abs=1e-6)


def test_silhouettes_match_all_pairs(spark, points):
    some = points.withColumn("alone", F.when(F.col("id") == 7, "x").when(F.col("id") < 100, "y")).withColumn("same", F.lit("s"))
    got = {r["attribute"]: r for r in probe.silhouettes(some, "id", ["third", "alone", "same"]).collect()}
    t = some.select("v", "third", "alone").toPandas()
    x = np.stack(t["v"])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for a in ("third", "alone"):
        g, want = t[a].to_numpy(), []
        known = [i for i in range(len(g)) if g[i] is not None]
        for i in known:
            own = [j for j in known if g[j] == g[i] and j != i]
            if not own:
                want.append(0.0)
                continue
            inner = d[i, own].mean()
            outer = min(d[i, [j for j in known if g[j] == o]].mean() for o in set(g[known]) - {g[i]})
            want.append((outer - inner) / max(inner, outer))
        assert got[a]["silhouette"] == pytest.approx(np.mean(want)) and got[a]["n"] == len(known)
    assert got["same"]["silhouette"] is None and got["same"]["n_groups"] == 1


def test_component_tests(points):
    got = probe.component_tests(points, "id", "third", 4).collect()
    assert len(got) == 12 and {(r["pair_a"], r["pair_b"]) for r in got} == {("a", "b"), ("a", "c"), ("b", "c")}
    t = probe.components(points, "id", 4, ["third"]).toPandas()
    for r in got:
        a, b = (t[(t["component"] == r["component"]) & (t["third"] == r[g])]["value"].to_numpy() for g in ("pair_a", "pair_b"))
        d = max(abs(np.mean(a <= x) - np.mean(b <= x)) for x in np.r_[a, b])
        assert (r["n_a"], r["n_b"]) == (len(a), len(b)) and r["d"] == pytest.approx(d) and r["p"] == pytest.approx(special.ks_p(d, len(a), len(b)))
    p = sorted(r["p"] for r in got)
    holm = np.minimum(1, np.maximum.accumulate([x * (12 - i) for i, x in enumerate(p)]))
    assert np.allclose(sorted(r["p_holm"] for r in got), sorted(holm)) and ordered.holm is not None
