"""Registered queries of the jobs and reports: the audit as one job, metadata, volumes, data sets, cohorts, charts, general resampling."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from evenhand.operators import hypothesis as h
from evenhand.operators import metrics as m
from evenhand.operators import quality as q
from evenhand.operators import resample
from evenhand.operators import splits as sp
from evenhand.operators import summaries as s
from evenhand.plans import audit as a
from evenhand.plans import datasets as ds
from evenhand.plans import reports as rp
from evenhand.plans import volumes as vo
from evenhand.registry import _AGE, _CC, _GAP, _GAP_OUT, _LONG, _R, _RANKS, _RATE, _RATES, _SWEEP, _V2, _long, _rates, query, rounded
from evenhand.sources import tables
from evenhand.sources.fixtures import table, view

# The audit ------------------------------------------------------------------------------------------------------------

_EFFECTS = f"""{_RANKS}, p AS (SELECT x.ruler, x.score, x.grouping, x.n AS na, y.n AS nb, x.rs - x.n * (x.n + 1) / 2.0::DOUBLE AS u FROM ks x JOIN ks y ON x.ruler = y.ruler AND x.score = y.score AND x.grouping = y.grouping AND x.grp < y.grp WHERE x.k = 2),
 o AS (SELECT ruler, score, grouping, k, total::DOUBLE AS t, all_ties, sum(rs * rs / n) AS ss FROM ks WHERE k >= 3 GROUP BY ALL),
 e AS (SELECT ruler, score, grouping, 'mann_whitney' AS test, u AS statistic, 1 - 2 * u / (na * nb) AS effect, 'rank_biserial' AS effect_name FROM p
   UNION ALL SELECT ruler, score, grouping, 'kruskal', (12 / (t * (t + 1)) * ss - 3 * (t + 1)) / (1 - all_ties / (t * t * t - t)) AS st,
   ((12 / (t * (t + 1)) * ss - 3 * (t + 1)) / (1 - all_ties / (t * t * t - t)) - k + 1) / (t - k), 'epsilon_squared' FROM o)"""


@query(f"""{_EFFECTS} SELECT ruler, score, grouping, test, round(statistic, 6) AS statistic, round(effect, 6) AS effect, effect_name,
 CASE WHEN test = 'kruskal' THEN CASE WHEN abs(effect) < 0.01 THEN 'negligible' WHEN abs(effect) < 0.06 THEN 'small' WHEN abs(effect) < 0.14 THEN 'medium' ELSE 'large' END
 ELSE CASE WHEN abs(effect) < 0.1 THEN 'negligible' WHEN abs(effect) < 0.3 THEN 'small' WHEN abs(effect) < 0.5 THEN 'medium' ELSE 'large' END END AS magnitude FROM e""")
def audit_effects(spark, d):
    """The tests of an audit without their p-values: statistic, effect, magnitude."""
    tests = a.all_tests(h.rank_sums(_long(spark, d), m.KEY), m.KEY).drop("p")
    return rounded(tests.withColumn("magnitude", F.when(F.col("test") == "kruskal", h.magnitude(F.col("effect"), "epsilon_squared")).otherwise(h.magnitude(F.col("effect"), "r"))))


def _renamed(sql: str) -> str:
    """The sweep's steps under names of their own, beside those of the single thresholds."""
    for name in ("l2", "r", "t", "x"):
        sql = re.sub(rf"\b{name} AS \(", f"{name}s AS (", sql)
        sql = re.sub(rf"\bFROM {name}\b", f"FROM {name}s", sql)
    return sql


_PARTS = f"""{_RATES},\n{_GAP}, f AS ({_GAP_OUT}),\n{_renamed(_SWEEP)},\n{_renamed(_R)},\n{_renamed(_RATE)},\n{_renamed(_GAP)}, fs AS ({_renamed(_GAP_OUT)}){_EFFECTS[len(_LONG):]},
 su AS (SELECT ruler, score, grouping, grp, count(value) AS n, avg(value) AS mean, median(value) AS median FROM l GROUP BY ALL),
 cz AS (SELECT coalesce(p.score, q.score) AS score, coalesce(p.grouping, q.grouping) AS grouping, p.dir AS a, q.dir AS b FROM (SELECT * FROM f WHERE ruler = 'gold') p FULL JOIN (SELECT * FROM f WHERE ruler = 'silver') q ON p.score = q.score AND p.grouping = q.grouping)"""


@query(f"""{_PARTS}
 SELECT 'gaps' AS part, ruler, score, grouping, threshold, '' AS grp, dir AS x, dpd AS y, n FROM f UNION ALL SELECT 'rates', ruler, score, grouping, round(threshold, 6), grp, round(rate, 6), NULL, n_valid FROM t
 UNION ALL SELECT 'sweep', ruler, score, grouping, threshold, '', dir, dpd, n FROM fs UNION ALL SELECT 'summary', ruler, score, grouping, NULL, grp, round(mean, 6), round(median, 9), n FROM su
 UNION ALL SELECT 'tests', ruler, score, grouping, NULL, test, round(statistic, 6), round(effect, 6), NULL FROM e UNION ALL SELECT 'significance', ruler, '', '', NULL, '', NULL, NULL, count(*) FROM e GROUP BY ruler
 UNION ALL SELECT 'bootstrap', ruler, score, grouping, NULL, m, CASE m WHEN 'dir' THEN dir ELSE dpd END, NULL, 10000 FROM f CROSS JOIN (SELECT unnest(['dir', 'dpd']) AS m) UNION ALL SELECT 'permutation', ruler, score, grouping, NULL, m, CASE m WHEN 'dir' THEN dir ELSE dpd END, NULL, 10000 FROM f CROSS JOIN (SELECT unnest(['dir', 'dpd']) AS m)
 UNION ALL SELECT 'comparison', '', score, grouping, NULL, '', a, b, NULL FROM cz""")
def audit_all(spark, d):
    """The audit as one job: what SQL can say of nine of its tables in one result. Its regression and post-hoc tests have queries of their own."""
    made = a.audit(view(spark, d, "scores"), view(spark, d, "exams"))
    none, blank = F.lit(None).cast("double"), F.lit("")

    def part(name, ruler=F.col("ruler"), score=F.col("score"), grouping=F.col("grouping"), threshold=none, grp=blank, x=none, y=none, n=F.lit(None).cast("long")):  # noqa: B008
        cells = {"part": F.lit(name), "ruler": ruler, "score": score, "grouping": grouping, "threshold": threshold, "grp": grp, "x": x, "y": y, "n": n.cast("long")}
        return made[name].select(*[c.alias(k) for k, c in cells.items()])

    c = F.col
    rows = [
        part("gaps", threshold=c("threshold"), x=c("dir"), y=c("dpd"), n=c("n")), part("rates", threshold=c("threshold"), grp=c("grp"), x=c("rate"), n=c("n_valid")),
        part("sweep", threshold=c("threshold"), x=c("dir"), y=c("dpd"), n=c("n")), part("summary", grp=c("grp"), x=F.round("mean", 6), y=F.round("median", 9), n=c("n")),
        part("tests", grp=c("test"), x=c("statistic"), y=c("effect")), part("significance", score=blank, grouping=blank, n=c("n_tests")),
        part("bootstrap", grp=c("metric"), x=c("point"), n=c("n_boot")), part("permutation", grp=c("metric"), x=c("observed"), n=c("n_perm")),
        part("comparison", ruler=blank, x=c("dir_base"), y=c("dir_other")),
    ]
    out = reduce(lambda p, q_: p.unionByName(q_), rows)
    return rounded(out.withColumns({k: F.when(F.col("part") == "summary", F.col(k)).otherwise(F.round(k, 6)) for k in ("x", "y")}), 9)


@query()
def audit_posthoc(spark, d):
    """Pairs of groups of the audit's combinations that pass the omnibus test."""
    ranks = h.rank_sums(_long(spark, d), m.KEY)
    return rounded(h.dunn(ranks, m.KEY, h.kruskal(ranks, m.KEY), alpha=0.5))


@query()
def audit_regression(spark, d):
    return rounded(a.regressions(view(spark, d, "scores"), view(spark, d, "exams"), ("sex", "race", "age_at_imaging", "manufacturer")))


@query()
def forest_chart(spark, d):
    return rounded(a.forest(resample.bootstrap(_rates(spark, d), m.KEY)))


@query(f"""{_RATES},\n{_GAP}, f AS ({_GAP_OUT}), u AS (SELECT ruler, row_number() OVER (ORDER BY ruler) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT ruler FROM f))
 SELECT f.ruler, score, grouping, dir, round((i - k / 2.0::DOUBLE + 0.5) * (0.8::DOUBLE / k), 6) AS "offset", CASE WHEN below_four_fifths THEN 'below' ELSE 'above' END AS side FROM f JOIN u ON f.ruler = u.ruler""")
def bar_chart(spark, d):
    return rounded(a.bars(m.gaps(_rates(spark, d))))


@query()
def general_bootstrap(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("grp"), "value", F.lit("value").alias("score"))
    return rounded(resample.general_bootstrap(e, ["score"], "grp", "value"))


@query()
def general_permutation(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("grp"), "value", F.lit("value").alias("score"))
    return rounded(resample.general_permutation(e, ["score"], "grp", "value"))


# Metadata and reports ---------------------------------------------------------------------------------------------------


def _metadata(spark, d):
    """Metadata tables of the driver's orders: a series of each order, its study and case, an image and a mask of each."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    series = orders.select(
        F.col("o_orderkey").alias("submitter_id"), (F.col("o_orderkey") * 10).alias("`imaging_studies.submitter_id`".strip("`")), F.col("o_custkey").alias("case_ids"),
        F.when(F.col("o_orderstatus") == "F", "GE Medical Systems").otherwise("Siemens").alias("manufacturer"), F.lit(3.0).alias("magnetic_field_strength"), F.lit("series").alias("type"), F.lit(1).alias("_id"),
    )
    studies = orders.select((F.col("o_orderkey") * 10).alias("submitter_id"), F.col("o_custkey").alias("case_ids"), F.col("o_orderdate").alias("study_date"), F.lit("study").alias("type"))
    sex = F.when(F.col("c_custkey") % 20 < 11, "Female").otherwise("Male")
    cases = customer.select(F.col("c_custkey").alias("submitter_id"), sex.alias("sex"), F.lit("White").alias("race"), F.lit("Not Reported").alias("ethnicity"), F.lit(40.0).alias("age_at_imaging"), F.lit("case").alias("type"))
    names = F.explode(F.array(F.lit(".nii.gz"), F.lit("_SEG.nii.gz")))
    files = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("series"), names.alias("ending")).select("series", F.concat(F.lit("scan-"), F.col("series").cast("string"), F.col("ending")).alias("file_name"))
    return series, studies, cases, files


@query("""SELECT o.o_orderkey AS series_submitter_id, o.o_custkey AS patient_id, o.o_orderkey * 10 AS study_submitter_id, CASE WHEN o.o_orderstatus = 'F' THEN 'GE MEDICAL SYSTEMS' ELSE 'SIEMENS' END AS manufacturer,
 CASE WHEN o.o_custkey % 20 < 11 THEN 'Female' ELSE 'Male' END AS sex, CASE WHEN o.o_orderkey % 3 <> 0 THEN 'scan-' || o.o_orderkey || '.nii.gz' END AS filename
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE NOT (o.o_orderkey % 100 = 7)""")
def metadata_load(spark, d):
    """Renames, the star join, upper-cased manufacturers, images without masks, exclusions."""
    gone = table(spark, d, "orders").filter("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("series_submitter_id"))
    exams, _ = rp.load_metadata(*_metadata(spark, d), gone)
    return exams.select("series_submitter_id", "patient_id", "study_submitter_id", "manufacturer", "sex", "filename")


@query("""WITH r AS (SELECT o.o_orderkey AS k, o.o_custkey AS c, CASE WHEN o.o_orderkey % 41 = 0 THEN 'PHILIPS' ELSE 'ok' END AS m, CASE WHEN o.o_custkey % 13 = 0 THEN 'Martian' ELSE 'White' END AS race
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey CROSS JOIN (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR (o.o_orderkey % 37 = 0 AND o.o_orderkey % 3 <> 0))
 SELECT * FROM (SELECT 'allowed' AS rule, 'manufacturer' AS "column", count(*) AS n, min(m) AS sample FROM r WHERE m = 'PHILIPS' UNION ALL SELECT 'allowed', 'race', count(*), min(race) FROM r WHERE race = 'Martian'
  UNION ALL SELECT 'unique', 'series_submitter_id', count(DISTINCT k), min(CAST(k AS VARCHAR)) FROM r WHERE k % 37 = 0 AND k % 3 <> 0) WHERE n > 0""")
def metadata_violations(spark, d):
    """Faulty metadata: an unknown manufacturer, a race that is not on the list, and series with two images."""
    series, studies, cases, files = _metadata(spark, d)
    key = F.col("submitter_id")
    series = series.withColumn("manufacturer", F.when(key % 41 == 0, "Philips").otherwise(F.col("manufacturer")))
    cases = cases.withColumn("race", F.when(key % 13 == 0, "Martian").otherwise(F.col("race")))
    again = files.filter(~F.col("file_name").endswith("_SEG.nii.gz") & (F.col("series") % 37 == 0)).select("series", F.concat(F.lit("again-"), "file_name").alias("file_name"))
    return rp.load_metadata(series, studies, cases, files.unionByName(again))[1]


_GEO = """geo AS (SELECT case_id, CAST(nx AS BIGINT) * ny * nz AS total_voxels, nx * sx AS physical_width, ny * sy AS physical_height, nz * sz AS physical_depth FROM grids),
 u AS (SELECT 'total_voxels' AS property, total_voxels::DOUBLE AS v FROM geo UNION ALL SELECT 'physical_width', physical_width FROM geo UNION ALL SELECT 'physical_height', physical_height FROM geo UNION ALL SELECT 'physical_depth', physical_depth FROM geo)"""


_GEO9 = """g1 AS (SELECT case_id, (CAST(nx AS BIGINT) * ny * nz)::DOUBLE AS total_voxels, nx * sx AS physical_width, ny * sy AS physical_height, nz * sz AS physical_depth, nx * sx * ny * sy * (nz * sz) AS physical_volume,
 nx * sx / (ny * sy) AS aspect_ratio_xy, nx * sx / (nz * sz) AS aspect_ratio_xz, ny * sy / (nz * sz) AS aspect_ratio_yz, sz / sqrt(sx * sy) AS anisotropy_factor FROM grids),
 u AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS property, {c}::DOUBLE AS v FROM g1" for c in vo.GEOMETRY) + ")"


@query(f"""WITH {_GEO9}, o AS (SELECT property, count(v) AS n, count(*) - count(v) AS n_missing, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, median(v) AS median, max(v) AS max, list_sort(list(v)) AS s FROM u GROUP BY ALL)
 SELECT property, n, n_missing, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(s[CAST(floor((n - 1) * 0.25::DOUBLE + 0.5) AS BIGINT) + 1], 6) AS q25, round(median, 6) AS median,
 round(s[CAST(floor((n - 1) * 0.75::DOUBLE + 0.5) AS BIGINT) + 1], 6) AS q75, round(max, 6) AS max FROM o""")
def geometry_report(spark, d):
    geo, _ = vo.geometry_job(view(spark, d, "grids"))
    return rounded(vo.geometry_report(geo)["summary"])


@query(f"""WITH {_GEO}, e AS (SELECT property, min(v) AS lo, max(v) AS hi FROM u GROUP BY property), b AS (SELECT e.*, unnest(range(0, 30)) AS bin FROM e),
 n AS (SELECT u.property, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 30)) AS BIGINT), 29) END AS bin, count(*) AS n FROM u JOIN e ON u.property = e.property GROUP BY ALL)
 SELECT b.property, CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * b.bin, 6) AS lo, round(lo + (hi - lo) / 30 * (b.bin + 1), 6) AS hi, coalesce(n.n, 0) AS n FROM b LEFT JOIN n ON b.property = n.property AND b.bin = n.bin""")
def geometry_histograms(spark, d):
    geo, _ = vo.geometry_job(view(spark, d, "grids"))
    return rounded(s.histogram(geo, ["total_voxels", "physical_width", "physical_height", "physical_depth"], 30))


_SEG = f"""{_CC}, lv AS (SELECT case_id, CASE ref WHEN 1 THEN 'vb' ELSE 'disc' END AS label, count(*) AS n_voxels, count(*) * 1.0::DOUBLE AS volume_mm3 FROM voxels WHERE ref IN (1, 2) GROUP BY ALL),
 seg AS (SELECT c.case_id, """ + ", ".join(f"coalesce(max({x}) FILTER (lv.label = '{y}'), 0) AS {x}_{y}" for x in ("n_voxels", "volume_mm3", "n_components") for y in ("vb", "disc")) + """
  FROM (SELECT DISTINCT case_id FROM voxels) c LEFT JOIN lv ON c.case_id = lv.case_id LEFT JOIN cc ON lv.case_id = cc.case_id AND lv.label = cc.label GROUP BY c.case_id)"""


@query(f"WITH RECURSIVE {_SEG} SELECT * FROM seg")
def segmentation_table(spark, d):
    return vo.segmentation_job(view(spark, d, "voxels"), view(spark, d, "volumes"))[0]


@query(f"""WITH RECURSIVE {_SEG} SELECT seg.case_id, n_components_vb, n_components_disc, sex, race, age_at_imaging, upper(manufacturer) AS manufacturer, magnetic_field_strength FROM seg LEFT JOIN exams e ON seg.case_id = e.series_submitter_id
 WHERE n_components_vb > 15 OR n_components_disc > 15""")
def component_outliers(spark, d):
    exams = view(spark, d, "exams").withColumn("manufacturer", F.upper("manufacturer"))
    return vo.component_outliers(vo.segmentation_table(view(spark, d, "voxels"), view(spark, d, "volumes")), exams)


@query(f"""WITH RECURSIVE {_SEG}, p AS (SELECT 'n_components_vb' AS property, n_components_vb AS bin FROM seg UNION ALL SELECT 'n_components_disc', n_components_disc FROM seg),
 e AS (SELECT property, unnest(range(min(bin), max(bin) + 1)) AS bin FROM p GROUP BY property), n AS (SELECT property, bin, count(*) AS n FROM p GROUP BY ALL)
 SELECT e.property, e.bin, e.bin - 0.5::DOUBLE AS lo, e.bin + 0.5::DOUBLE AS hi, coalesce(n.n, 0) AS n FROM e LEFT JOIN n ON e.property = n.property AND e.bin = n.bin""")
def component_histogram(spark, d):
    made = vo.segmentation_table(view(spark, d, "voxels"), view(spark, d, "volumes"))
    return s.integer_histogram(made, ["n_components_vb", "n_components_disc"])


_AGE_BIN = _AGE.replace("age_at", "e.age_at")
_MWU_BY = (("vol", "volume_mm3", "sex", "e.sex"), ("comp", "n_components", "sex", "e.sex"), ("voxels", "n_voxels", "manufacturer", "upper(e.manufacturer)"), ("vol_mm3", "volume_mm3", "manufacturer", "upper(e.manufacturer)"),
           ("vol", "volume_mm3", "race", "CASE e.race WHEN 'White' THEN 'White' WHEN 'Black or African American' THEN 'Black' END"), ("comp", "n_components", "race", "CASE e.race WHEN 'White' THEN 'White' WHEN 'Black or African American' THEN 'Black' END"))
_TEST_ROWS = " UNION ALL ".join(
    [f"SELECT '{name}_by_{by}_{y}' AS stat_key, 'mann_whitney' AS test, {x} AS grp, seg.{c}_{y}::DOUBLE AS value FROM seg JOIN exams e ON seg.case_id = e.series_submitter_id" for name, c, by, x in _MWU_BY for y in ("vb", "disc")]
    + [f"SELECT '{name}_by_age_{y}', 'kruskal', {_AGE_BIN}, seg.{c}_{y}::DOUBLE FROM seg JOIN exams e ON seg.case_id = e.series_submitter_id" for name, c in (("vol", "volume_mm3"), ("comp", "n_components")) for y in ("vb", "disc")]
)


@query(f"""WITH RECURSIVE {_SEG}, f AS ({_TEST_ROWS}), ok AS (SELECT * FROM f WHERE grp IS NOT NULL),
 r AS (SELECT *, rank() OVER (PARTITION BY stat_key ORDER BY value) + (count(*) OVER (PARTITION BY stat_key, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY stat_key, value) AS t FROM ok),
 g AS (SELECT stat_key, test, grp, count(*) AS n, sum(rk) AS rs, sum(t * t - 1.0::DOUBLE) AS ties FROM r GROUP BY ALL),
 k AS (SELECT *, count(*) OVER (PARTITION BY stat_key) AS k, sum(n) OVER (PARTITION BY stat_key)::DOUBLE AS total, sum(ties) OVER (PARTITION BY stat_key) AS all_ties FROM g),
 two AS (SELECT x.stat_key, x.test, x.rs - x.n * (x.n + 1) / 2.0::DOUBLE AS u, x.n AS na, y.n AS nb FROM k x JOIN k y ON x.stat_key = y.stat_key AND x.grp < y.grp WHERE x.test = 'mann_whitney' AND x.k = 2),
 more AS (SELECT stat_key, test, k, total AS t, all_ties, sum(rs * rs / n) AS ss FROM k WHERE test = 'kruskal' AND k >= 2 GROUP BY ALL),
 hh AS (SELECT *, (12 / (t * (t + 1)) * ss - 3 * (t + 1)) / (1 - all_ties / (t * t * t - t)) AS h FROM more)
 SELECT stat_key, test, round(u, 6) AS statistic, round(1 - 2 * u / (na * nb), 6) AS effect FROM two UNION ALL SELECT stat_key, test, round(h, 6), round((h - k + 1) / (t - k), 6) FROM hh""")
def segmentation_effects(spark, d):
    """The sixteen tests of the segmentation report without their p-values."""
    made = vo.segmentation_table(view(spark, d, "voxels"), view(spark, d, "volumes"))
    return rounded(vo.segmentation_effects(made, view(spark, d, "exams"), p_values=False))


@query()
def segmentation_report(spark, d):
    made = vo.segmentation_table(view(spark, d, "voxels"), view(spark, d, "volumes"))
    return rounded(vo.segmentation_report(made, view(spark, d, "exams"))["tests"])


_POOL_SQL = f"""WITH RECURSIVE {_SEG}, pm AS (SELECT seg.*, volume_mm3_vb + volume_mm3_disc AS volume_mm3_total, e.annotation_quality AS grp FROM seg JOIN exams e ON seg.case_id = e.series_submitter_id),
 pl AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, grp, {c}::DOUBLE AS value FROM pm" for c in vo.MORPHOLOGY) + """),
 pr AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM pl),
 pg AS (SELECT feature, grp, count(*) AS n, sum(rk) AS rs, median(value) AS med, min(value) AS lo, max(value) AS hi FROM pr GROUP BY ALL),
 pp AS (SELECT x.feature, x.grp AS group_a, y.grp AS group_b, x.n AS n_a, y.n AS n_b, x.med AS median_a, y.med AS median_b, x.rs - x.n * (x.n + 1) / 2.0::DOUBLE AS u, least(x.lo, y.lo) = greatest(x.hi, y.hi) AS same
  FROM pg x JOIN pg y ON x.feature = y.feature AND x.grp < y.grp)"""


@query(f"""{_POOL_SQL} SELECT feature, group_a, group_b, n_a, n_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(CASE WHEN same THEN 'NaN'::DOUBLE ELSE u END, 6) AS u,
 round(CASE WHEN same THEN 0 ELSE 1 - 2 * u / (n_a * n_b) END, 6) AS rank_biserial FROM pp""")
def pool_morphology(spark, d):
    """Seven features of segmentations between two pools of exams."""
    made = vo.segmentation_table(view(spark, d, "voxels"), view(spark, d, "volumes"))
    return rounded(vo.pool_tests(made, view(spark, d, "exams"), p_values=False).drop("magnitude"))


@query()
def pool_morphology_tests(spark, d):
    made = vo.segmentation_table(view(spark, d, "voxels"), view(spark, d, "volumes"))
    return rounded(vo.pool_tests(made, view(spark, d, "exams")))


@query("""WITH v AS (SELECT DISTINCT 'race' AS property, race AS value FROM exams UNION SELECT DISTINCT 'manufacturer', manufacturer FROM exams UNION SELECT DISTINCT 'patient_id', CAST(patient_id AS VARCHAR) FROM exams)
 SELECT property, row_number() OVER (PARTITION BY property ORDER BY value) AS place, value FROM v WHERE value IS NOT NULL""")
def sorted_values(spark, d):
    return s.sorted_values(view(spark, d, "exams"), ["race", "manufacturer", "patient_id"])


@query("SELECT o_orderkey, 'scan-' || o_orderkey || '_SEG.nii.gz' AS mask FROM orders")
def mask_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tables.mask_name(F.concat(F.lit("scan-"), F.col("o_orderkey").cast("string"), F.lit(".nii.gz"))).alias("mask"))


def _cohorts(spark, d, name, geometry=False):
    exams = view(spark, d, "exams")
    if geometry:  # the grids are the exams' of the same number
        geometry = vo.geometry_job(view(spark, d, "grids"))[0]
    return rp.cohort_reports(exams, sp.split_patients(exams).select("series_submitter_id", "split"), geometry=geometry or None, only=(name,))[name]


@query(_V2 + ", f AS (SELECT 'full' AS cohort, sex, race, ethnicity FROM exams UNION ALL SELECT a.split, e.sex, e.race, e.ethnicity FROM exams e JOIN a ON e.patient_id = a.patient_id) " + " UNION ALL ".join(
    f"SELECT cohort, '{c}' AS attribute, {c} AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY cohort), 1) AS pct FROM f GROUP BY cohort, {c}" for c in ("sex", "race", "ethnicity")))
def cohort_demographics(spark, d):
    return _cohorts(spark, d, "demographics")


@query(_V2 + """, f AS (SELECT 'full' AS cohort, age_at_imaging AS v FROM exams UNION ALL SELECT a.split, e.age_at_imaging FROM exams e JOIN a ON e.patient_id = a.patient_id)
 SELECT cohort, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std FROM f GROUP BY cohort""")
def cohort_ages(spark, d):
    return rounded(_cohorts(spark, d, "ages").select("cohort", "n", "mean", "median", "std"))


_COHORT_AGE = _V2 + ", f AS (SELECT 'full' AS cohort, age_at_imaging AS v FROM exams UNION ALL SELECT a.split, e.age_at_imaging FROM exams e JOIN a ON e.patient_id = a.patient_id)"


@query(_COHORT_AGE + """, e AS (SELECT cohort, min(v) AS lo, max(v) AS hi FROM f GROUP BY cohort), bs AS (SELECT e.*, unnest(range(0, 30)) AS bin FROM e),
 n AS (SELECT f.cohort, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 30)) AS BIGINT), 29) END AS bin, count(*) AS n FROM f JOIN e ON f.cohort = e.cohort WHERE v IS NOT NULL GROUP BY ALL)
 SELECT bs.cohort, 'age_at_imaging' AS property, CAST(bs.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * bs.bin, 6) AS lo, round(lo + (hi - lo) / 30 * (bs.bin + 1), 6) AS hi, coalesce(n.n, 0) AS n
 FROM bs LEFT JOIN n ON bs.cohort = n.cohort AND bs.bin = n.bin""")
def cohort_histograms(spark, d):
    return rounded(_cohorts(spark, d, "age_histogram"))


_COHORT_GEO = _V2 + """, g0 AS (SELECT case_id, (CAST(nx AS BIGINT) * ny * nz)::DOUBLE AS total_voxels, nx * sx AS physical_width, ny * sy AS physical_height, nz * sz AS physical_depth FROM grids),
 g1 AS (SELECT *, physical_width * physical_height * physical_depth AS physical_volume, physical_width / physical_height AS aspect_ratio_xy, physical_width / physical_depth AS aspect_ratio_xz, physical_height / physical_depth AS aspect_ratio_yz FROM g0),
 g2 AS (SELECT g1.*, grids.sz / sqrt(grids.sx * grids.sy) AS anisotropy_factor FROM g1 JOIN grids ON g1.case_id = grids.case_id),
 g3 AS (SELECT 'full' AS cohort, * FROM g2 UNION ALL SELECT a.split, g2.* FROM g2 JOIN exams e ON g2.case_id = e.series_submitter_id JOIN a ON e.patient_id = a.patient_id),
 u AS (""" + " UNION ALL ".join(f"SELECT cohort, '{c}' AS property, {c}::DOUBLE AS v FROM g3" for c in vo.GEOMETRY) + ")"


@query(_COHORT_GEO + """, ds AS (SELECT cohort, property, count(v) AS n, count(*) - count(v) AS n_missing, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, median(v) AS median, max(v) AS max, list_sort(list(v) FILTER (v IS NOT NULL)) AS s FROM u GROUP BY ALL)
 SELECT cohort, property, n, n_missing, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(s[CAST(floor((n - 1) * 0.25::DOUBLE + 0.5) AS BIGINT) + 1], 6) AS q25, round(median, 6) AS median,
 round(s[CAST(floor((n - 1) * 0.75::DOUBLE + 0.5) AS BIGINT) + 1], 6) AS q75, round(max, 6) AS max FROM ds""")
def cohort_geometry(spark, d):
    """All nine geometry columns described by cohort."""
    return rounded(_cohorts(spark, d, "geometry", True))


@query(_COHORT_GEO + """, z AS (SELECT cohort, property, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS n FROM u GROUP BY ALL), zs AS (SELECT u.cohort, u.property, v, mean, std, n FROM u JOIN z ON u.cohort = z.cohort AND u.property = z.property)
 SELECT cohort, property, round(mean, 6) AS mean, round(std, 6) AS std, count(*) FILTER (abs(v - mean) > 2 * std) AS n_2sigma, count(*) FILTER (abs(v - mean) > 3 * std) AS n_3sigma FROM zs GROUP BY ALL""")
def cohort_outliers(spark, d):
    return rounded(_cohorts(spark, d, "geometry_outliers", True).select("cohort", "property", "mean", "std", "n_2sigma", "n_3sigma"))


@query(_COHORT_GEO + """, w AS (SELECT cohort, case_id, round(physical_volume, 6) AS physical_volume, row_number() OVER (PARTITION BY cohort ORDER BY physical_volume, case_id) AS r, count(*) OVER (PARTITION BY cohort) AS n FROM g3)
 SELECT cohort, case_id, physical_volume, CASE WHEN r = 1 THEN 'smallest' WHEN r = n // 2 + 1 THEN 'median' ELSE 'largest' END AS role FROM w WHERE r = 1 OR r = n // 2 + 1 OR r = n""")
def cohort_representatives(spark, d):
    return rounded(_cohorts(spark, d, "representatives", True).select("cohort", "case_id", "physical_volume", "role"))


@query(_V2 + """, f AS (SELECT 'full' AS cohort, e.* FROM exams e UNION ALL SELECT a.split, e.* FROM exams e JOIN a ON e.patient_id = a.patient_id)
 SELECT cohort, 'magnetic_field_strength' AS property, count(*) AS n, min(magnetic_field_strength) AS min, max(magnetic_field_strength) AS max FROM f GROUP BY cohort""")
def cohort_fields(spark, d):
    """Any numeric column can be described by cohort."""
    exams = view(spark, d, "exams")
    rows = rp.by_cohort(exams, sp.split_patients(exams).select("series_submitter_id", "split"), "series_submitter_id")
    return s.describe(rows, ["magnetic_field_strength"], ["cohort"]).select("cohort", "property", "n", "min", "max")


@query("""WITH e AS (SELECT upper(manufacturer) AS m, CASE WHEN magnetic_field_strength = 3 THEN '3.0T' ELSE '1.5T' END AS f FROM exams)
 SELECT 'manufacturer_by_field' AS stat_key, m AS "row", f AS col, count(*) AS n FROM e GROUP BY ALL""")
def scanner_cells(spark, d):
    return rp.scanner_report(view(spark, d, "exams"))["cells"].select("stat_key", "row", "col", "n")


# The expected ranges of a cervical scan
SCAN_RULES = [q.Range("slices", "nz", 10, 50), q.Range("width", "nx", 200, 600), q.Range("slice_spacing", "sz", 2, None, "critical"), q.Range("depth_mm", "nz * sz", None, 26), q.Range("flatness", "nx / ny", 0.5, 2.4)]


@query("""WITH r AS (SELECT case_id, nx, ny, nz, sx, sz FROM grids)
 SELECT case_id, 'slices' AS rule, 'warning' AS severity, nz::DOUBLE AS value, CASE WHEN nz < 10 THEN 'low' ELSE 'high' END AS bound, CASE WHEN nz < 10 THEN 10.0::DOUBLE ELSE 50.0 END AS "limit" FROM r WHERE nz < 10 OR nz > 50
 UNION ALL SELECT case_id, 'width', 'warning', nx::DOUBLE, CASE WHEN nx < 200 THEN 'low' ELSE 'high' END, CASE WHEN nx < 200 THEN 200.0 ELSE 600.0 END FROM r WHERE nx < 200 OR nx > 600
 UNION ALL SELECT case_id, 'slice_spacing', 'critical', sz, 'low', 2.0 FROM r WHERE sz < 2
 UNION ALL SELECT case_id, 'depth_mm', 'warning', nz * sz, 'high', 26.0 FROM r WHERE nz * sz > 26
 UNION ALL SELECT case_id, 'flatness', 'warning', round(nx / ny::DOUBLE, 6), CASE WHEN nx / ny::DOUBLE < 0.5 THEN 'low' ELSE 'high' END, CASE WHEN nx / ny::DOUBLE < 0.5 THEN 0.5 ELSE 2.4 END FROM r WHERE nx / ny::DOUBLE < 0.5 OR nx / ny::DOUBLE > 2.4""")
def broken_range_rules(spark, d):
    """Range rules as data: one pass, one row for each rule that a grid breaks."""
    return rounded(q.broken_rules(view(spark, d, "grids"), "case_id", SCAN_RULES))


@query()
def cohort_consistency(spark, d):
    """Whether the full table and the training cohort decide each cross-cut alike."""
    return rp.consistency(_cohorts(spark, d, "crosscuts"), "full", "train")


@query("""WITH c AS (SELECT race, sex, count(*) AS n FROM exams GROUP BY ALL), t AS (SELECT race, sum(n)::BIGINT AS total FROM c GROUP BY race), p AS (SELECT *, row_number() OVER (ORDER BY total DESC, race) AS place FROM t)
 SELECT c.race, c.sex, c.n, p.total, CAST(p.place AS INTEGER) AS place FROM c JOIN p ON c.race = p.race""")
def ordered_categories(spark, d):
    return s.by_marginal(s.counts(view(spark, d, "exams"), ["race", "sex"]), "race")


@query("""SELECT 'sex' AS property, count(DISTINCT sex) AS n_unique, count(*) FILTER (sex IS NULL) AS n_missing FROM bad_exams UNION ALL SELECT 'ethnicity', count(DISTINCT ethnicity), count(*) FILTER (ethnicity IS NULL) FROM bad_exams
 UNION ALL SELECT 'series_submitter_id', count(DISTINCT series_submitter_id), count(*) FILTER (series_submitter_id IS NULL) FROM bad_exams""")
def distinct_and_missing(spark, d):
    return s.distinct_and_missing(view(spark, d, "bad_exams"), ["sex", "ethnicity", "series_submitter_id"])


_POOL = ("sex", "race", "ethnicity", "manufacturer")


def _cells_sql(rows: str) -> str:
    return f"""c AS (SELECT stat_key, row, col, count(*)::DOUBLE AS n FROM ({rows}) GROUP BY ALL),
 rn AS (SELECT stat_key, row, sum(n) AS rn FROM c GROUP BY ALL), cn AS (SELECT stat_key, col, sum(n) AS cn FROM c GROUP BY ALL),
 z AS (SELECT stat_key, sum(rn) AS t, count(*) AS r FROM rn GROUP BY stat_key), y AS (SELECT stat_key, count(*) AS k FROM cn GROUP BY stat_key),
 f AS (SELECT rn.stat_key, t, r, k, coalesce(c.n, 0) AS n, rn * cn / t AS e FROM rn JOIN cn ON rn.stat_key = cn.stat_key JOIN z ON rn.stat_key = z.stat_key JOIN y ON rn.stat_key = y.stat_key LEFT JOIN c ON c.stat_key = rn.stat_key AND c.row = rn.row AND c.col = cn.col),
 x AS (SELECT stat_key, t, r, k, sum((CASE WHEN (r - 1) * (k - 1) = 1 THEN abs(n - e) - least(0.5, abs(n - e)) ELSE abs(n - e) END) ** 2 / e) AS x FROM f GROUP BY ALL)"""


_POOL_ROWS = " UNION ALL ".join(f"SELECT 'annotation_quality_by_{x}' AS stat_key, annotation_quality AS row, {x} AS col FROM exams" for x in _POOL)


@query(f"WITH {_cells_sql(_POOL_ROWS)} SELECT stat_key, CAST(t AS BIGINT) AS n, CAST((r - 1) * (k - 1) AS BIGINT) AS dof, round(x, 6) AS chi2, round(sqrt(x / (t * (least(r, k) - 1))), 6) AS cramers_v FROM x")
def pool_effects(spark, d):
    """Two pools compared on four attributes, without p-values."""
    cells = rp.attribute_cells(view(spark, d, "exams"), tuple(("annotation_quality", x) for x in _POOL))
    return rounded(h.chi_squared(cells, ["stat_key"], p_values=False))


_CUT = """fr AS (SELECT sex, upper(manufacturer) AS manufacturer, CASE WHEN magnetic_field_strength = 3 THEN '3.0T' ELSE '1.5T' END AS field,
 CASE race WHEN 'White' THEN 'White' WHEN 'Black or African American' THEN 'Black' ELSE 'Other' END AS race_wbo FROM exams)"""
_CUT_ROWS = " UNION ALL ".join(f"SELECT '{x}_by_{y}' AS stat_key, {x} AS row, {y} AS col FROM fr" for x, y in rp.CATEGORICAL)


@query(f"WITH {_CUT}, {_cells_sql(_CUT_ROWS)} SELECT stat_key, CAST(t AS BIGINT) AS n, CAST((r - 1) * (k - 1) AS BIGINT) AS dof, round(x, 6) AS chi2, round(sqrt(x / (t * (least(r, k) - 1))), 6) AS cramers_v FROM x")
def crosscut_effects(spark, d):
    """The categorical cross-cuts without p-values."""
    return rounded(h.chi_squared(rp.attribute_cells(rp.crosscut_frame(view(spark, d, "exams"))), ["stat_key"], p_values=False))


# Data sets ------------------------------------------------------------------------------------------------------------


def _manifest(spark, d):
    placed = sp.split_patients(view(spark, d, "exams"))
    name = F.when(F.col("o_orderkey") % 41 == 0, "scan.nii.gz").otherwise(F.concat(F.lit("593-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(".nii.gz")))
    files = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("series_submitter_id"), name.alias("filename"))
    return ds.manifest(placed, files, r"593-(\d{6})")


_MAN = _V2 + """, f AS (SELECT e.series_submitter_id, e.patient_id, a.split, CASE WHEN e.series_submitter_id % 3 = 0 THEN NULL WHEN e.series_submitter_id % 41 = 0 THEN 'scan.nii.gz' ELSE '593-' || lpad(CAST(e.patient_id AS VARCHAR), 6, '0') || '.nii.gz' END AS filename
  FROM exams e JOIN a ON e.patient_id = a.patient_id),
 i AS (SELECT *, 'case_' || regexp_extract(filename, '593-([0-9]{6})', 1) AS id FROM f WHERE regexp_extract(filename, '593-([0-9]{6})', 1) <> ''),
 man AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY series_submitter_id) - 1 AS r FROM i)"""


@query(_MAN + " SELECT CASE WHEN n > 1 THEN id || '_s' || CAST(r AS VARCHAR) ELSE id END AS case_id, filename AS source_filename, series_submitter_id, patient_id, split FROM man")
def dataset_manifest(spark, d):
    return _manifest(spark, d)[0]


@query(_MAN + " SELECT series_submitter_id, filename, CASE WHEN filename IS NULL THEN 'no_file' ELSE 'no_case_id' END AS problem FROM f WHERE filename IS NULL OR filename = 'scan.nii.gz'")
def manifest_violations(spark, d):
    return _manifest(spark, d)[1]


@query(_MAN + " SELECT count(*) FILTER (split <> 'test') AS num_training, count(*) FILTER (split = 'test') AS num_test, '.nii.gz' AS file_ending FROM man")
def dataset_descriptor(spark, d):
    return ds.descriptor(_manifest(spark, d)[0]).select("num_training", "num_test", "file_ending")


@query(_V2 + " SELECT e.series_submitter_id, e.sex, a.split, a.stratum FROM exams e LEFT JOIN a ON e.patient_id = a.patient_id AND a.split <> 'val'")
def applied_splits(spark, d):
    """Exams with the columns of a saved split; those that it leaves out keep nulls."""
    exams = view(spark, d, "exams")
    return ds.apply_splits(exams, sp.split_patients(exams).filter("split <> 'val'")).select("series_submitter_id", "sex", "split", "stratum")


@query("""WITH u AS (SELECT patient_id, min((series_submitter_id, annotation_quality))[2] AS s FROM exams GROUP BY patient_id), t AS (SELECT s, count(*) AS n FROM u GROUP BY s), b AS (SELECT s, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
 r AS (SELECT patient_id, u.s, row_number() OVER (PARTITION BY u.s ORDER BY md5('42:' || CAST(patient_id AS VARCHAR)), patient_id) - 1 AS r FROM u)
 SELECT e.series_submitter_id, e.patient_id, CAST((r.r + b.before) % 5 AS INTEGER) AS fold FROM exams e JOIN r ON e.patient_id = r.patient_id JOIN b ON r.s = b.s""")
def patient_folds(spark, d):
    """Folds that keep a patient's exams together."""
    return sp.unit_folds(view(spark, d, "exams"), "annotation_quality", "patient_id", "series_submitter_id").select("series_submitter_id", "patient_id", "fold")


@query("""WITH k AS (SELECT c_custkey AS patient_id FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3) SELECT series_submitter_id, patient_id FROM exams WHERE patient_id NOT IN (SELECT patient_id FROM k)""")
def drop_lists(spark, d):
    customer = table(spark, d, "customer").withColumnRenamed("c_custkey", "patient_id")
    gone = ds.drop_ids(customer.filter("c_acctbal < 0"), customer.filter("c_nationkey = 3"))
    return q.exclude(view(spark, d, "exams"), gone, "patient_id").select("series_submitter_id", "patient_id")


@query("SELECT v.vec_id AS series_submitter_id, v.label, e.sex, e.race FROM embeddings v JOIN exams e ON v.vec_id = e.series_submitter_id")
def embedding_demographics(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "series_submitter_id")
    return ds.with_demographics(vectors, view(spark, d, "exams")).select("series_submitter_id", "label", "sex", "race")
