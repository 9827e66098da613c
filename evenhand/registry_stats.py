"""Registered queries of general resampling, order statistics and component tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.operators import hypothesis as h
from evenhand.operators import metrics as m
from evenhand.operators import ordered as od
from evenhand.operators import probe as pr
from evenhand.operators import resample
from evenhand.operators import voxels as v
from evenhand.plans import evaluation as ev
from evenhand.plans import reports as rp
from evenhand.registry import _HD, _LONG, _long, _vectors, query, rounded
from evenhand.sources.fixtures import table, view
from evenhand.sources.scratch import scratch
from evenhand.sources.tables import write_texts

# General metrics ------------------------------------------------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").filter("value IS NOT NULL").select(
        F.col("event_id").alias("row_id"), F.lit("all").alias("key"), F.col("event_type").alias("grp"), F.col("value"), (F.col("user_id") % 100).cast("double").alias("user")
    )


def _sums():
    """What the correlation of value and user within a group takes."""
    x, y = F.col("value"), F.col("user")
    return {"x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y}


def _correlation_gap():
    """The widest difference of two groups' correlations."""
    n, x, y, xy, xx, yy = (F.col(c) for c in ("n", "x", "y", "xy", "xx", "yy"))
    r = (xy / n - x / n * y / n) / F.sqrt((xx / n - x / n * x / n) * (yy / n - y / n * y / n))
    return F.max(r) - F.min(r)


@query("""WITH c AS (SELECT event_type AS grp, count(*)::DOUBLE AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
 SELECT CAST(r AS INTEGER) AS rep, grp, n FROM c CROSS JOIN range(50) t(r)""")
def permutation_sizes(spark, d):
    """Group sizes in each of fifty permuted replicates: the given ones, exactly."""
    got = resample.replicate_sums(_events(spark, d), ["key"], "grp", "row_id", {"x": F.col("value")}, 50, 42, True)
    return got.select(F.col("_rep").alias("rep"), "grp", "n")


@query("""WITH c AS (SELECT event_type AS grp, corr(value, (user_id % 100)::DOUBLE) AS r FROM events WHERE value IS NOT NULL GROUP BY ALL)
 SELECT 'all' AS key, round(max(r) - min(r), 6) AS observed, CAST(200 AS BIGINT) AS n_perm FROM c""")
def correlation_gap(spark, d):
    """A metric that is no mean: the gap of groups' correlations, with its permutation test."""
    got = resample.general_permutation(_events(spark, d), ["key"], "grp", sums=_sums(), metric=_correlation_gap())
    return rounded(got.filter("p BETWEEN 0 AND 1 AND null_std > 0").select("key", "observed", "n_perm"))


@query()
def correlation_gap_interval(spark, d):
    return rounded(resample.general_bootstrap(_events(spark, d), ["key"], "grp", sums=_sums(), metric=_correlation_gap()))


# Medians --------------------------------------------------------------------------------------------------------------

_TWO = f"""{_LONG}, p AS (SELECT ruler, score, grouping, grp, median(value) AS mu FROM l WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
 k AS (SELECT *, count(*) OVER (PARTITION BY ruler, score, grouping) AS k FROM p)"""


@query(f"""{_TWO} SELECT ruler, score, grouping, 'difference' AS metric, round(max_by(-mu, grp) + min_by(mu, grp), 9) AS point, CAST(10000 AS BIGINT) AS n_boot FROM k WHERE k = 2 GROUP BY ALL""")
def median_differences(spark, d):
    """The difference of medians of groupings with two groups; its interval is in median_intervals."""
    return rounded(od.median_bootstrap(_long(spark, d), m.KEY).select(*m.KEY, "metric", "point", "n_boot"), 9)


@query()
def median_intervals(spark, d):
    return rounded(od.median_bootstrap(_long(spark, d), m.KEY), 9)


@query()
def median_gap_intervals(spark, d):
    """The gap of medians over all groups of a grouping."""
    return rounded(od.median_bootstrap(_long(spark, d), m.KEY, metric="gap"), 9)


# Components -----------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT CAST(i AS INTEGER) AS component, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS grp, embedding[i]::DOUBLE AS x FROM embeddings CROSS JOIN range(1, 11) t(i)),
 n AS (SELECT component, count(*) FILTER (grp = 'high') AS na, count(*) FILTER (grp = 'low') AS nb FROM v GROUP BY ALL),
 c AS (SELECT component, sum((grp = 'high')::INT) OVER w AS ca, sum((grp = 'low')::INT) OVER w AS cb FROM v WINDOW w AS (PARTITION BY component ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT c.component, 'high' AS group_a, 'low' AS group_b, na AS n_a, nb AS n_b, round(max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)), 6) AS d FROM c JOIN n ON c.component = n.component GROUP BY ALL""")
def ks_dimensions(spark, d):
    """Kolmogorov-Smirnov distances of the first ten dimensions between two groups of labels."""
    e = table(spark, d, "embeddings").select(F.when(F.col("label") < 5, "low").otherwise("high").alias("grp"), F.posexplode(F.slice("embedding", 1, 10)).alias("i", "value"))
    long = e.select((F.col("i") + 1).cast("int").alias("component"), "grp", F.col("value").cast("double").alias("value"))
    return rounded(od.ks_two_sample(long, ["component"], p_values=False))


@query()
def ks_components(spark, d):
    """Ten principal components, each tested between two groups, with Holm's and Bonferroni's adjustments."""
    return rounded(pr.component_tests(_vectors(spark, d), "vec_id", "binary", 10).drop("group_a", "group_b"))


@query("""WITH e AS (SELECT event_type, value, user_id % 2 = 0 AS label FROM events WHERE value IS NOT NULL),
 r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS rk FROM e),
 s AS (SELECT event_type, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n, sum(rk) FILTER (label) AS rs FROM r GROUP BY ALL)
 SELECT event_type, round((rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 6) AS auroc, 0.5::DOUBLE AS null_mean, CAST(1000 AS BIGINT) AS n_perm FROM s""")
def auroc_null(spark, d):
    """AUROC with the mean of its 1,000 permuted values, which is one half but for chance."""
    e = table(spark, d, "events").withColumn("label", F.col("user_id") % 2 == 0)
    got = od.auroc_permutation(e, ["event_type"], "label", "value")
    near = F.abs(F.col("null_mean") - 0.5) <= 5 * F.col("null_std") / F.sqrt("n_perm")
    return rounded(got.select("event_type", "auroc", F.when(near, 0.5).otherwise(F.col("null_mean")).alias("null_mean"), "n_perm"))


@query()
def auroc_permutation(spark, d):
    e = table(spark, d, "events").withColumn("label", F.col("user_id") % 2 == 0)
    return rounded(od.auroc_permutation(e, ["event_type"], "label", "value"))


@query("""WITH p AS (SELECT lang AS family, doc_id, n_chars / 20001.0::DOUBLE AS p FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS rk, count(*) OVER (PARTITION BY family) AS n FROM p)
 SELECT doc_id, family, round(least(1.0::DOUBLE, max(p * (n - rk + 1)) OVER (PARTITION BY family ORDER BY rk)), 6) AS p_holm FROM r""")
def holm(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("family"), (F.col("n_chars") / 20001.0).alias("p"))
    return rounded(od.holm(rows, ["family"]).select("doc_id", "family", "p_holm"))


# Probes ---------------------------------------------------------------------------------------------------------------


def _attributes(spark, d):
    """Embeddings with the attributes that probes ask for: two of two classes, one of three, and a number."""
    third = F.when(F.col("label") < 3, "a").when(F.col("label") < 6, "b").otherwise("c")
    return _vectors(spark, d).withColumns({"third": third, "odd": F.when(F.col("label") % 2 == 1, "odd").otherwise("even"), "age": F.col("label").cast("double")})


@query()
def probe_table(spark, d):
    """Probes of several attributes, each chosen by the score that it reports."""
    return rounded(pr.probe(_attributes(spark, d), "vec_id", ["third", "odd"]).withColumn("leakage", pr.leakage(F.col("mean"))))


@query()
def perceptron_probe(spark, d):
    """The same with one hidden layer of 128 units."""
    return rounded(pr.probe(_attributes(spark, d), "vec_id", ["binary", "third"], hidden=128))


@query()
def age_on_components(spark, d):
    return rounded(pr.component_regression(_attributes(spark, d), "vec_id", "age"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS b, CASE WHEN label < 3 THEN 'a' WHEN label < 6 THEN 'b' ELSE 'c' END AS t FROM embeddings),
 l AS (SELECT vec_id, x, 'binary' AS attribute, b AS grp FROM v UNION ALL SELECT vec_id, x, 'third', t FROM v),
 w AS (SELECT attribute, grp, i, sum(x[i]) AS s FROM l CROSS JOIN range(1, 65) r(i) GROUP BY ALL), g AS (SELECT attribute, grp, list(s ORDER BY i) AS s FROM w GROUP BY ALL),
 q AS (SELECT attribute, grp, count(*)::DOUBLE AS n, sum(list_inner_product(x, x)) AS q FROM l GROUP BY ALL),
 m AS (SELECT l.attribute, vec_id, l.grp = g.grp AS own, q.n, q.n * list_inner_product(x, x) - 2 * list_inner_product(x, g.s) + q.q AS tot
   FROM l JOIN g ON l.attribute = g.attribute JOIN q ON q.attribute = g.attribute AND q.grp = g.grp),
 p AS (SELECT attribute, vec_id, max(tot / (n - 1)) FILTER (own) AS a, min(tot / n) FILTER (NOT own) AS b, count(*) AS k FROM m GROUP BY ALL)
 SELECT attribute, count(*) AS n, max(k) AS n_groups, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p GROUP BY ALL""")
def attribute_silhouettes(spark, d):
    return rounded(pr.silhouettes(_attributes(spark, d), "vec_id", ["binary", "third"]))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
 SELECT vec_id, round(list_avg(x), 6) AS mean, round(list_stddev_pop(x), 6) AS std, round(list_min(x), 6) AS least, round(list_max(x), 6) AS greatest, 'ok' AS status FROM v""")
def encoder_moments(spark, d):
    """Features of an encoder that is named."""
    items = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    got = pr.extract(items, "vec_id", "moments")
    names = ("mean", "std", "least", "greatest")
    return rounded(got.select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)], "status"))


# Energy ---------------------------------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT l_orderkey % 200 AS job, max(l_quantity * 60.5) AS sec FROM lineitem GROUP BY 1),
 h AS (SELECT CASE WHEN job % 3 = 0 THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END AS kw, sum(sec / 3600.0::DOUBLE) AS hours FROM j WHERE job % 7 <> 0 GROUP BY 1),
 s AS (SELECT unnest(['low', 'central', 'high']) AS scenario, unnest([1.55::DOUBLE, 1.58, 1.67]) AS pue, unnest([0.099::DOUBLE, 0.099, 0.138]) AS ci)
 SELECT scenario, round(sum(hours * kw * pue), 6) AS kwh, round(sum(hours * kw * pue) * ci, 6) AS co2_kg FROM h CROSS JOIN s GROUP BY scenario, ci""")
def energy_from_logs(spark, d):
    """From job logs as text files to energy: the lines are written first; some logs state no run time."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("job"), (F.col("l_quantity") * 60.5).cast("decimal(12,2)").alias("sec"))
    text = F.when(F.col("job") % 7 == 0, F.lit("killed")).otherwise(F.concat(F.lit("    Run time :                 "), F.col("sec").cast("string"), F.lit(" sec.")))
    path = scratch(spark, "logs")
    rows.select("job", F.explode(F.array(F.lit("Resource usage summary:"), text)).alias("line")).repartition("job").write.partitionBy("job").text(path)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.regexp_extract("_metadata.file_path", "job=([0-9]+)", 1).alias("path"))
    jobs = rp.run_times(lines)
    queue = F.when(F.col("path").cast("int") % 3 == 0, "gpua100").otherwise("gpul40s")
    return rounded(rp.energy(jobs.groupBy(queue.alias("queue")).agg(F.sum("hours").alias("hours"))))


# Masks ----------------------------------------------------------------------------------------------------------------


def _decode(content: bytes):
    """The query's mask files: a line of 'grid' with shape and spacing, and a line for each labelled voxel, in any order."""
    import numpy as np

    lines = [line.split() for line in content.decode().splitlines()]
    (head,) = [x[1:] for x in lines if x[0] == "grid"]
    grid = np.zeros([int(n) for n in head[:3]], np.uint8)
    at = np.array([x for x in lines if x[0] != "grid"], np.int64).reshape(-1, 4)
    grid[tuple(at[:, :3].T)] = at[:, 3]
    return grid, [float(s) for s in head[3:]]


def _mask_files(spark, d) -> str:
    """A file for each case and side, written from the voxels by tasks; some are missing, broken, or of another shape."""
    vox, case = view(spark, d, "voxels"), F.col("case_id")
    rows = vox.select("case_id", F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("ref").alias("v")), F.struct(F.lit("pred").alias("side"), F.col("pred").alias("v")))).alias("s"), "x", "y", "z")
    rows = rows.filter("s.v > 0").select("s.side", "case_id", F.concat_ws(" ", "x", "y", "z", "s.v").alias("line"))
    heads = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), F.explode(F.array(F.lit("ref"), F.lit("pred"))).alias("side"))
    wide = F.when((F.col("side") == "pred") & (case % 7 == 2), 52).otherwise(51)
    heads = heads.select("side", "case_id", F.concat_ws(" ", F.lit("grid"), wide, F.lit(20), F.lit(8), F.lit(0.5), F.lit(0.5), F.lit(4.0)).alias("line"))
    lines = heads.unionByName(rows).filter(~((F.col("side") == "pred") & (case % 11 == 3)))
    lines = lines.withColumn("line", F.when((F.col("side") == "ref") & (case % 13 == 5), "garbage").otherwise(F.col("line")))
    path = scratch(spark, "masks")
    write_texts(lines, path, ["side", "case_id"])
    return path


_STATUS = "CASE WHEN s_suppkey % 11 = 3 THEN 'missing' WHEN s_suppkey % 13 = 5 THEN 'unreadable' WHEN s_suppkey % 7 = 2 THEN 'shape_mismatch' ELSE 'ok' END"
_HD_OK = _HD.replace("FROM voxels", "FROM vox")


@query(f"""WITH st AS (SELECT CAST(s_suppkey AS VARCHAR) AS case_id, s_suppkey AS k, {_STATUS} AS status, CASE WHEN s_suppkey % 11 = 3 THEN 'prediction' ELSE '' END AS missing FROM supplier),
 vox AS (SELECT st.case_id, a.x, a.y, a.z, a.ref, a.pred FROM voxels a JOIN st ON a.case_id = st.k WHERE status = 'ok'), {_HD_OK},
 dc AS (SELECT case_id, label, CASE WHEN ref_n + pred_n = 0 THEN 'NaN'::DOUBLE ELSE 2.0::DOUBLE * tp / (ref_n + pred_n) END AS s FROM cnt),
 lo AS (SELECT label, avg(ref_n / 8160.0::DOUBLE) AS r FROM cnt GROUP BY label),
 kp AS (SELECT cnt.*, (1 - r) * ref_n / (r * (8160 - ref_n)) AS kap FROM cnt JOIN lo ON cnt.label = lo.label),
 nd AS (SELECT case_id, label, CASE WHEN tp = 0 AND ref_n = 0 THEN 'NaN'::DOUBLE WHEN tp = 0 OR ref_n = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (kap * fp + 2.0::DOUBLE * tp + fn) END AS s FROM kp),
 u AS (SELECT case_id, 'dice_' || label AS name, s FROM dc UNION ALL SELECT case_id, 'hd95_' || label, hd95 FROM hd UNION ALL SELECT case_id, 'ndsc_' || label, s FROM nd)
 SELECT st.case_id, st.status, st.missing, """ + ", ".join(f"round(max(s) FILTER (name = '{x}_{y}'), 6) AS {x}_{y}" for x in ("dice", "hd95", "ndsc") for y in ("vb", "disc")) + """
 FROM st LEFT JOIN u ON st.case_id = u.case_id GROUP BY ALL""")
def mask_evaluation(spark, d):
    """From mask files to scores and statuses in one job: the files are written first, and some of them are bad."""
    path = _mask_files(spark, d)
    sides = [ev.read_masks(spark, f"{path}/side={side}", _decode, r"/case_id=([0-9]+)/[^/]+$", "part-*") for side in ("ref", "pred")]
    cases = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("case_id"))
    return rounded(ev.evaluate_masks(cases, *sides, weighted=False).drop("problem"))


@query()
def surface_distance(spark, d):
    """Surface distances weighted by area."""
    return rounded(v.hd95(view(spark, d, "voxels"), view(spark, d, "volumes"), weighted=True))
