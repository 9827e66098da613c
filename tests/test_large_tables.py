"""Steps whose tasks must not grow faster than their input."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenhand import registry_stats
from evenhand.operators import grouping, probe, regress, splits, summaries, surfaces
from evenhand.operators import hypothesis as h
from evenhand.plans import audit, evaluation, volumes
from evenhand.sources import tables
from evenhand.sources.fixtures import table, view


@pytest.fixture
def large(spark):
    """Plans as for tables above the size that Spark broadcasts by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_grouping_are_not_moved_to_one_task(spark, large):
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("ruler"), (F.col("id") % 7).cast("string").alias("grouping"), (F.col("id") % 2).cast("string").alias("grp"), F.col("id").cast("double").alias("age_at_imaging"))
    for df in (grouping.comparable(rows, ["ruler", "grouping"]), grouping.with_median_age(rows, ["ruler"])):
        assert "SortMergeJoin" not in plan(df) and df.count() == 100


def test_rows_of_a_property_are_not_moved_to_one_task(spark, large):
    rows = spark.range(100).select(F.when(F.col("id") == 99, 1000.0).otherwise(F.col("id") % 7).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    out = summaries.sigma_outliers(rows, ["a", "b"])
    assert "SortMergeJoin" not in plan(out)
    assert {r["property"]: (r["n_2sigma"], r["n_3sigma"]) for r in out.collect()} == {"a": (1, 1), "b": (0, 0)}
    out = summaries.histogram(rows, ["a"], 4)
    assert plan(out).count("SortMergeJoin") <= 1  # of bins with their counts
    assert sorted((r["bin"], r["n"]) for r in out.collect()) == [(0, 99), (1, 0), (2, 0), (3, 1)]


def test_regressions_join_once(spark, sf_dir, monkeypatch):
    fit, plans = regress.ols, []
    monkeypatch.setattr(regress, "ols", lambda df, *a, **k: plans.append(plan(df)) or fit(df, *a, **k))
    got = audit.regressions(view(spark, sf_dir, "scores"), view(spark, sf_dir, "exams"), ("sex", "age_at_imaging"))
    assert len(plans) == 4 and not any("Join" in p for p in plans)
    assert got.select("ruler", "score").distinct().count() == 4
    monkeypatch.undo()
    rows = view(spark, sf_dir, "scores").filter("ruler = 'gold'").join(view(spark, sf_dir, "exams"), "series_submitter_id").withColumn("dice_macro", (F.col("dice_vb") + F.col("dice_disc")) / 2)
    want = {r["term"]: r["coef"] for r in regress.ols(rows, "dice_macro", ["sex", "age_at_imaging"]).collect()}
    assert {r["term"]: r["coef"] for r in got.filter("ruler = 'gold' AND score = 'dice_macro'").collect()} == pytest.approx(want)


def test_segmentation_report_reads_its_table_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    schema = "case_id long, " + ", ".join(f"{c} {'double' if 'mm3' in c else 'long'}" for c in volumes.columns())

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(40).select(F.col("id").alias("case_id"), *[(F.col("id") % (3 + i)).cast("double" if "mm3" in c else "long").alias(c) for i, c in enumerate(volumes.columns())])
    exams = spark.range(40).select(
        F.col("id").alias("series_submitter_id"), F.when(F.col("id") % 2 == 0, "Female").otherwise("Male").alias("sex"), F.lit("White").alias("race"), F.col("id").cast("double").alias("age_at_imaging"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("b").alias("manufacturer"), F.lit(3.0).alias("magnetic_field_strength"),
    )
    table = rows.mapInArrow(counted, schema)
    got = volumes.segmentation_report(table, exams)["tests"].collect()
    assert read.value == 40 and got
    frame = volumes.test_frame(rows, exams)
    two = h.mann_whitney(h.rank_sums(frame.filter("kind = 'mann_whitney'"), ["stat_key"]), ["stat_key"])
    want = {r["stat_key"]: r["u"] for r in two.collect()}
    assert {r["stat_key"]: r["statistic"] for r in got if r["test"] == "mann_whitney"} == pytest.approx(want, nan_ok=True)


def test_rows_of_a_stratum_are_not_moved_to_one_task(spark, large):
    out = splits.folds(spark.range(50).withColumn("every", F.concat(F.lit("all"), F.col("id") % 1)), "every", "id", 5)
    assert "BroadcastHashJoin [every" in plan(out) and sorted(r["n"] for r in out.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()) == [10] * 5


def test_component_regression_deals_folds_before_it_gathers_rows(spark, monkeypatch):
    rng, plans = np.random.default_rng(1), []
    df = probe.as_vector(spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], float(i)) for i in range(60)], "k long, embedding array<double>, y double"))
    predictions = probe.fold_predictions
    monkeypatch.setattr(probe, "fold_predictions", lambda d, *a, **k: plans.append(plan(d)) or predictions(d, *a, **k))
    got = probe.component_regression(df, "k", "y", n_pcs=3, k=3).first()
    assert got["n"] == 60 and "Window" not in plans[0] and "Sort" not in plans[0]


def test_search_index_is_not_broadcast(spark):
    from evenhand.llm import hamming

    index = spark.range(8).select(F.lit(0).alias("segment"), F.col("id").alias("value"), F.col("id").alias("code"), F.col("id").alias("first"), F.lit(1).cast("long").alias("n"))
    queries = spark.range(2).select(F.col("id").alias("query"))
    (met,) = hamming._found(index, queries, [(0, 3)], 1)
    assert "SortMergeJoin" in plan(met) and "BroadcastExchange" not in plan(met)
    assert sorted((r["query"], r["code"], r["distance"]) for r in met.collect()) == [(0, 1, 1), (0, 2, 1), (0, 4, 1), (1, 0, 1), (1, 3, 1), (1, 5, 1)]


def test_plans_do_not_print_the_rank_map(spark, monkeypatch):
    from evenhand.llm import bpe

    pieces = [bytes([i]) for i in range(256)] + [bytes([i, j]) for i in range(97, 123) for j in range(97, 123)]
    printed, cut = [], bpe.cut
    monkeypatch.setattr(bpe, "cut", lambda df, what="step": printed.append(len(df._jdf.queryExecution().executedPlan().toString())) or cut(df, what))
    coder = bpe.ByteBpe(spark, bpe.Vocabulary({p: i for i, p in enumerate(pieces)}, r"\S+|\s+"))
    got = coder.encode(spark.createDataFrame([(1, "abc xyz"), (2, None)], "doc_id long, text string")).collect()
    want = {1: [257, 99, 32, 256 + 23 * 26 + 24, 122], 2: []}
    assert {r["doc_id"]: [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)] for r in got} == want
    assert max(printed) < 10_000


def test_search_makes_fewer_probes_than_codes_are_met(spark, monkeypatch):
    from evenhand.llm import hamming

    rng, made, met = np.random.default_rng(3), [], []
    rows = [(i, "".join(rng.choice(["0", "1"], 32))) for i in range(1000)]
    codes = spark.createDataFrame(rows, "id long, code string")
    flipped, found = hamming.flipped, hamming._found
    monkeypatch.setattr(hamming, "flipped", lambda *a: made.append(flipped(*a).count()) or flipped(*a))
    monkeypatch.setattr(hamming, "_found", lambda *a: met.append(sum(f.count() for f in found(*a))) or found(*a))
    got = {}
    for r in hamming.top_k(codes, codes.filter("id % 100 = 0"), 10, bits=32).collect():
        got.setdefault(r["query"], []).append((r["distance"], r["id"]))
    for q in range(0, 1000, 100):
        assert sorted(got[q]) == sorted((sum(a != b for a, b in zip(rows[q][1], c, strict=True)), i) for i, c in rows)[:10]
    # all radii together: few probes a query, and only near codes leave the joins once ten are known
    assert sum(made) < 10_000 and sum(met) < 2_000, (sum(made), sum(met))


def test_perceptron_is_fitted_in_several_tasks(spark, monkeypatch):
    rng, parts = np.random.default_rng(2), []
    df = probe.as_vector(spark.createDataFrame([(i, [float(x) + 2 * (i % 2) for x in rng.normal(size=4)], "ab"[i % 2]) for i in range(200)], "k long, embedding array<double>, y string"))
    perceptron = probe.perceptron

    def counted(*a):
        fit = perceptron(*a)
        return lambda train, pcs: parts.append(train.rdd.getNumPartitions()) or fit(train, pcs)

    monkeypatch.setattr(probe, "perceptron", counted)
    monkeypatch.setattr(probe, "VALUES_A_PART", 800)  # a logistic regression of these 800 numbers takes 2 partitions
    scores = probe.fold_scores(df, "k", "y", n_pcs=3, k=2, hidden=32)
    assert parts == [5, 5] and min(scores) > 0.9


def test_small_masks_share_batches_and_large_ones_are_cut(monkeypatch):
    grids = [np.random.default_rng(i).integers(0, 3, (4, 5, 6)) for i in range(300)] + [np.zeros((2, 2, 2)), np.ones((50, 40, 6), np.uint8)]

    def decode(content):
        return grids[int(content)], (1.0, 2.0, 3.0)

    files = pa.record_batch({"case_id": [*map(str, range(len(grids))), "bad"], "content": [*[str(i).encode() for i in range(len(grids))], b"x"]})
    small = list(evaluation._decoded(decode)(iter([files, files.slice(0, 0)])))
    assert len(small) == 2  # the masks' rows and their voxels
    monkeypatch.setattr(evaluation, "BATCH", 1000)
    for got in (small, found := list(evaluation._decoded(decode)(iter([files])))):
        rows = pa.Table.from_batches(got).to_pylist()
        heads = {r["case_id"]: r for r in rows if r["status"] is not None}
        assert sorted(heads) == sorted(files["case_id"].to_pylist()) and heads["bad"]["status"].startswith("unreadable") and heads["bad"]["nx"] is None
        assert [heads["301"][c] for c in ("nx", "ny", "nz", "sx", "sy", "sz")] == [50, 40, 6, 1.0, 2.0, 3.0]
        voxels = [(int(r["case_id"]), r["x"], r["y"], r["z"], r["v"]) for r in rows if r["status"] is None]
        assert sorted(voxels) == [(i, *map(int, at), int(g[tuple(at)])) for i, g in enumerate(grids) for at in np.argwhere(g)]
    assert max(map(len, found)) < 2000


def test_small_files_fill_tasks(spark, tmp_path, monkeypatch):
    for i in range(400):
        (tmp_path / f"{i}.mask").write_bytes(b"x")
    tasks = []
    monkeypatch.setattr(evaluation, "cut", lambda df, what: tasks.append(df.rdd.getNumPartitions()) or df)
    heads, _ = evaluation.read_masks(spark, str(tmp_path), lambda content: (np.zeros((1, 1, 1)), (1.0, 1.0, 1.0)), r"/([0-9]+)\.mask$")
    assert tasks == [4] and heads.count() == 400
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "4194304b" and spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        with tables.small_files(spark):
            assert spark.conf.get("spark.sql.files.openCostInBytes") == "1m"
        assert spark.conf.get("spark.sql.files.openCostInBytes") == "1m"
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_mask_files_are_one_file_each(spark, sf_dir):
    """Hadoop's local writer makes a checksum beside each file, and starts processes for both."""
    path = tables.local_path(spark, registry_stats._mask_files(spark, sf_dir))
    found = {os.path.relpath(at, path): names for at, _, names in os.walk(path) if names}
    assert found and all(names == ["part-0.txt"] for names in found.values())
    sides = {(side, s.s_suppkey) for s in table(spark, sf_dir, "supplier").collect() for side in ("ref", "pred") if side == "ref" or s.s_suppkey % 11 != 3}
    assert {f"side={side}/case_id={case}" for side, case in sides} <= set(found)


def test_texts_are_laid_out_as_by_sparks_writer(spark, tmp_path, monkeypatch):
    rows = [(g, k, f"{i} ü" if i % 9 else ("" if i % 2 else None)) for i, (g, k) in enumerate([(g, k) for g in ("a b", "x/y:%", "", None, "{ö}") for k in (1, -2, None)] * 7)]
    lines = spark.createDataFrame(rows, "g string, k int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # files go over several batches
    try:
        tables.write_texts(lines, str(tmp_path / "own"), ["g", "k"], "text")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(tables, "local_path", lambda *_: None)
    tables.write_texts(lines, f"file://{tmp_path}/spark", ["g", "k"], "text")

    def laid_out(where):
        files = [p for p in (tmp_path / where).rglob("part-*")]
        assert len({p.parent for p in files}) == len(files)
        return {str(p.parent.relative_to(tmp_path / where)): sorted(p.read_text().split("\n")) for p in files}

    assert laid_out("own") == laid_out("spark") and len(laid_out("own")) == 12


def test_few_surface_places_meet_in_pairs(monkeypatch):
    rng = np.random.default_rng(0)
    masks = [np.pad(rng.random((30, 20, 7)) < share, 1) for share in (0.02, 0.05, 0.0)]
    cases = [(p, q, spacing) for p in masks for q in masks for spacing in ((0.5, 0.5, 4.0), (0.3, 0.7, 1.1))]
    want = [(np.sqrt(surfaces.distance_squared(q, s)[p]), np.sqrt(surfaces.distance_squared(p, s)[q])) for p, q, s in cases]
    ends = [surfaces.robust_hausdorff(*c, weighted=False) for c in cases]
    with monkeypatch.context() as m:
        m.setattr(surfaces, "PAIRS", 0)
        assert np.array_equal(ends, [surfaces.robust_hausdorff(*c, weighted=False) for c in cases], equal_nan=True)
    monkeypatch.setattr(surfaces, "distance_squared", None)  # the transform of the whole grid is not needed
    for (p, q, s), (a, b) in zip(cases, want, strict=True):
        got = surfaces.distances(p, q, s)
        assert np.array_equal(got[0], a) and np.array_equal(got[1], b)
        surfaces.robust_hausdorff(p, q, s, weighted=False)
