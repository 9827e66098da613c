"""Registered audit queries: a function over (spark, sf_dir) for each, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.exprs import r6, seeded, valid
from evenhand.operators import grouping as g
from evenhand.operators import hypothesis as h
from evenhand.operators import metrics as m
from evenhand.operators import probe as pr
from evenhand.operators import quality as q
from evenhand.operators import regress, resample
from evenhand.operators import splits as sp
from evenhand.operators import summaries as s
from evenhand.operators import voxels as v
from evenhand.plans import audit as a
from evenhand.plans import reports as rp
from evenhand.sources import tables as src
from evenhand.sources.fixtures import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, as the SQL side has them; nine where medians of six-place scores would end in a 5."""
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


# SQL building blocks -------------------------------------------------------------------------------------------

_J = """j AS (SELECT s.*, (dice_vb + dice_disc) / 2 AS dice_macro, (hd95_vb + hd95_disc) / 2 AS hd95_macro,
  e.sex, e.race, e.ethnicity, e.age_at_imaging AS age, median(e.age_at_imaging) OVER (PARTITION BY s.ruler) AS med
  FROM scores s JOIN exams e ON s.series_submitter_id = e.series_submitter_id)"""
_G = """g AS (
 SELECT *, 'sex' AS grouping, sex AS grp FROM j
 UNION ALL SELECT *, 'race_wb', CASE race WHEN 'White' THEN 'White' WHEN 'Black or African American' THEN 'Black' END FROM j
 UNION ALL SELECT *, 'race_wbo', CASE race WHEN 'White' THEN 'White' WHEN 'Black or African American' THEN 'Black' ELSE 'Other' END FROM j
 UNION ALL SELECT *, 'race_wn', CASE race WHEN 'White' THEN 'White' ELSE 'Non-White' END FROM j
 UNION ALL SELECT *, 'age_3bin', CASE WHEN age IS NULL THEN '60+' WHEN age < 40 THEN '<40' WHEN age < 60 THEN '40-60' ELSE '60+' END FROM j
 UNION ALL SELECT *, 'age_median', CASE WHEN age < med THEN '<' || CAST(CAST(round_even(med, 0) AS BIGINT) AS VARCHAR) WHEN age >= med THEN '>=' || CAST(CAST(round_even(med, 0) AS BIGINT) AS VARCHAR) END FROM j
 UNION ALL SELECT *, 'ethnicity', CASE ethnicity WHEN 'Hispanic or Latino' THEN 'Hispanic' WHEN 'Not Hispanic or Latino' THEN 'Non-Hispanic' END FROM j)"""
_L = "l AS (" + " UNION ALL ".join(f"SELECT ruler, grouping, grp, '{c}' AS score, {c} AS value FROM g WHERE grp IS NOT NULL" for c in a.SCORES) + ")"
_R = """r AS (SELECT ruler, score, grouping, threshold, grp, count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS n_valid,
  count(*) FILTER (value IS NOT NULL AND NOT isnan(value) AND CASE WHEN hib THEN value > threshold ELSE value < threshold END) AS n_success
  FROM l2 GROUP BY ALL)"""
_RATE = "t AS (SELECT *, CASE WHEN n_valid > 0 THEN n_success / n_valid::DOUBLE END AS rate FROM r)"
_POLICY = "l2 AS (SELECT l.*, CASE WHEN score LIKE 'hd95%' THEN 5.0::DOUBLE ELSE 0.8::DOUBLE END AS threshold, score NOT LIKE 'hd95%' AS hib FROM l)"
_SWEEP = """l2 AS (SELECT l.*, unnest(CASE WHEN score LIKE 'hd95%' THEN [2.0::DOUBLE, 5.0, 10.0] ELSE [0.7::DOUBLE, 0.75, 0.8, 0.85, 0.9] END) AS threshold,
  score NOT LIKE 'hd95%' AS hib FROM l WHERE score LIKE '%_macro')"""
_GAP = """x AS (SELECT ruler, score, grouping, threshold, max(rate) AS best_rate, min(rate) AS worst_rate,
  min((-rate, grp)) FILTER (rate IS NOT NULL) AS b, min((rate, grp)) FILTER (rate IS NOT NULL) AS w, count(rate) AS n_groups,
  CAST(sum(n_valid) AS BIGINT) AS n, CAST(sum(n_valid - n_success) AS BIGINT) AS n_fail FROM t GROUP BY ruler, score, grouping, threshold)"""
_GAP_OUT = """SELECT ruler, score, grouping, round(threshold, 6) AS threshold, round(best_rate, 6) AS best_rate, round(worst_rate, 6) AS worst_rate, b[2] AS best_group, w[2] AS worst_group,
  n_groups, n, n_fail, round(CASE WHEN best_rate = 0 THEN 'NaN'::DOUBLE ELSE worst_rate / best_rate END, 6) AS dir, round(best_rate - worst_rate, 6) AS dpd,
  coalesce(best_rate > 0 AND worst_rate / best_rate < 0.8, false) AS below_four_fifths, CASE WHEN n_groups > 0 THEN 'ok' ELSE 'no_valid_scores' END AS status FROM x"""
_LONG = f"WITH {_J},\n{_G},\n{_L}"
_RATES = f"{_LONG},\n{_POLICY},\n{_R},\n{_RATE}"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return a.long_table(view(spark, d, "scores"), view(spark, d, "exams"))


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return a.rates_of(view(spark, d, "scores"), view(spark, d, "exams"), a.rules_list(a.SCORES))


# Groupings and fairness metrics -----------------------------------------------------------------------------------


@query(f"{_LONG} SELECT ruler, grouping, grp, count(*) AS n FROM l WHERE score = 'dice_vb' GROUP BY ALL")
def audit_groups(spark, d):
    return _long(spark, d).filter("score = 'dice_vb'").groupBy("ruler", "grouping", "grp").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_RATES} SELECT ruler, score, grouping, threshold, grp, n_valid, n_success, round(rate, 6) AS rate FROM t")
def audit_rates(spark, d):
    return rounded(_rates(spark, d))


@query(f"{_RATES},\n{_GAP} {_GAP_OUT}")
def audit_gap(spark, d):
    return rounded(m.gaps(_rates(spark, d)))


@query(f"{_LONG},\n{_SWEEP},\n{_R},\n{_RATE},\n{_GAP} {_GAP_OUT}")
def audit_sweep(spark, d):
    return rounded(m.gaps(a.rates_of(view(spark, d, "scores"), view(spark, d, "exams"), a.rules_list(a.SCORES, sweep=True))))


@query(f"""{_RATES},\n{_GAP}, y AS (SELECT ruler, score, grouping, CASE WHEN best_rate = 0 THEN 'NaN'::DOUBLE ELSE worst_rate / best_rate END AS dir, best_rate - worst_rate AS dpd FROM x),
 z AS (SELECT score, grouping, p.dir AS dir_base, p.dpd AS dpd_base, o.dir AS dir_other, o.dpd AS dpd_other FROM (SELECT * FROM y WHERE ruler = 'gold') p FULL JOIN (SELECT * FROM y WHERE ruler = 'silver') o USING (score, grouping)),
 c AS (SELECT *, CASE WHEN dir_base = 1 AND dir_other = 1 THEN 0.0::DOUBLE WHEN dir_base = 1 THEN 'Infinity'::DOUBLE ELSE ((1 - dir_other) - (1 - dir_base)) / (1 - dir_base) * 100 END AS wide FROM z)
 SELECT score, grouping, round(dir_base, 6) AS dir_base, round(dpd_base, 6) AS dpd_base, round(dir_other, 6) AS dir_other, round(dpd_other, 6) AS dpd_other,
 round(wide, 6) AS widening_pct, CASE WHEN wide > 0 THEN 'wider' WHEN wide < 0 THEN 'narrower' WHEN wide IS NOT NULL THEN 'unchanged' END AS direction FROM c""")
def ruler_comparison(spark, d):
    return rounded(m.compare_rulers(m.gaps(_rates(spark, d)), "gold", "silver"))


@query(f"""{_LONG}, p AS (SELECT ruler, score, grouping, grp, avg(value) AS mu FROM l WHERE NOT isnan(value) GROUP BY ALL)
 SELECT ruler, score, grouping, round(min(mu) / max(mu), 6) AS dir, round(max(mu) - min(mu), 6) AS dpd FROM p WHERE score LIKE 'dice%' GROUP BY ALL""")
def mean_gap(spark, d):
    return rounded(m.mean_gaps(_long(spark, d).filter("score LIKE 'dice%'")))


@query(f"""{_LONG}, p AS (SELECT ruler, score, grouping, grp, median(value) AS mu FROM l WHERE NOT isnan(value) GROUP BY ALL)
 SELECT ruler, score, grouping, round(min(mu) / max(mu), 9) AS dir, round(max(mu) - min(mu), 9) AS dpd FROM p GROUP BY ALL""")
def median_gap(spark, d):
    return rounded(m.mean_gaps(_long(spark, d), "median"), 9)


@query(f"""{_LONG}, f AS (SELECT ruler, score, grouping, grp, count(value) AS n, avg(value) AS mean, median(value) AS median,
  CASE WHEN bool_or(isnan(value) OR isinf(value)) THEN 'NaN'::DOUBLE ELSE stddev_samp(CASE WHEN isfinite(value) THEN value END) END AS std, list_sort(list(value) FILTER (value IS NOT NULL)) AS o FROM l GROUP BY ALL),
 k AS (SELECT *, o[CAST(floor((n - 1) * 0.25::DOUBLE + 0.5) AS BIGINT) + 1] AS q25, o[CAST(floor((n - 1) * 0.75::DOUBLE + 0.5) AS BIGINT) + 1] AS q75 FROM f)
 SELECT ruler, score, grouping, grp, n, round(mean, 9) AS mean, round(median, 9) AS median, round(std, 9) AS std, round(q25, 9) AS q25, round(q75, 9) AS q75, round(q75 - q25, 9) AS iqr FROM k""")
def group_summary(spark, d):
    return rounded(s.group_summary(_long(spark, d), [*m.KEY, "grp"]), 9)


# Rank, contingency and multiplicity -------------------------------------------------------------------------------

_RANKS = f"""{_LONG}, ok AS (SELECT * FROM l WHERE value IS NOT NULL AND NOT isnan(value)),
 rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY ruler, score, grouping, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY ruler, score, grouping, value) AS t FROM ok WINDOW w AS (PARTITION BY ruler, score, grouping ORDER BY value)),
 gs AS (SELECT ruler, score, grouping, grp, count(*) AS n, sum(rk) AS rs, median(value) AS med, sum(t * t - 1.0::DOUBLE) AS ties FROM rk GROUP BY ALL),
 ks AS (SELECT *, count(*) OVER (PARTITION BY ruler, score, grouping) AS k, sum(n) OVER (PARTITION BY ruler, score, grouping) AS total, sum(ties) OVER (PARTITION BY ruler, score, grouping) AS all_ties FROM gs)"""


@query(f"""{_RANKS}, p AS (SELECT x.ruler, x.score, x.grouping, x.grp AS group_a, y.grp AS group_b, x.n AS n_a, y.n AS n_b, x.med AS median_a, y.med AS median_b, x.rs - x.n * (x.n + 1) / 2.0::DOUBLE AS u
 FROM ks x JOIN ks y ON x.ruler = y.ruler AND x.score = y.score AND x.grouping = y.grouping AND x.grp < y.grp WHERE x.k = 2)
 SELECT ruler, score, grouping, group_a, group_b, n_a, n_b, round(median_a, 9) AS median_a, round(median_b, 9) AS median_b, round(u, 9) AS u, round(1 - 2 * u / (n_a * n_b), 9) AS rank_biserial FROM p""")
def mann_whitney(spark, d):
    return rounded(h.mann_whitney(h.rank_sums(_long(spark, d), m.KEY), m.KEY, p_values=False), 9)


@query(f"""{_RANKS}, p AS (SELECT ruler, score, grouping, k, CAST(total AS BIGINT) AS n, total::DOUBLE AS t, all_ties, sum(rs * rs / n) AS ss FROM ks WHERE k >= 3 GROUP BY ALL),
 o AS (SELECT *, (12 / (t * (t + 1)) * ss - 3 * (t + 1)) / (1 - all_ties / (t * t * t - t)) AS h FROM p)
 SELECT ruler, score, grouping, k, n, round(h, 6) AS h, round((h - k + 1) / (t - k), 6) AS epsilon_squared FROM o""")
def kruskal(spark, d):
    return rounded(h.kruskal(h.rank_sums(_long(spark, d), m.KEY), m.KEY, p_values=False))


@query(f"""{_RANKS} SELECT x.ruler, x.score, x.grouping, x.grp AS group_a, y.grp AS group_b, x.n AS n_a, y.n AS n_b,
 round((x.rs / x.n - y.rs / y.n) / sqrt((x.total * (x.total + 1.0::DOUBLE) / 12 - x.all_ties / (12 * (x.total - 1.0::DOUBLE))) * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)), 6) AS z
 FROM ks x JOIN ks y ON x.ruler = y.ruler AND x.score = y.score AND x.grouping = y.grouping AND x.grp < y.grp WHERE x.k >= 3""")
def dunn(spark, d):
    return rounded(h.dunn(h.rank_sums(_long(spark, d), m.KEY), m.KEY, p_values=False).select(*m.KEY, "group_a", "group_b", "n_a", "n_b", "z"))


@query()
def audit_tests(spark, d):
    tests = a.all_tests(h.rank_sums(_long(spark, d), m.KEY), m.KEY)
    out = h.benjamini_hochberg(tests, ["ruler"])
    return rounded(out.withColumn("magnitude", F.when(F.col("test") == "kruskal", h.magnitude(F.col("effect"), "epsilon_squared")).otherwise(h.magnitude(F.col("effect"), "r"))))


@query("""WITH e AS (SELECT l_linestatus AS stat_key, CASE WHEN l_quantity < 15 THEN 'few' WHEN l_quantity < 35 THEN 'some' ELSE 'many' END AS grp, l_quantity AS value FROM lineitem),
 r AS (SELECT *, rank() OVER (PARTITION BY stat_key ORDER BY value) + (count(*) OVER (PARTITION BY stat_key, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY stat_key, value) AS t FROM e),
 g AS (SELECT stat_key, grp, count(*) AS n, sum(rk) AS rs, sum(t * t - 1.0::DOUBLE) AS ties FROM r GROUP BY ALL),
 k AS (SELECT *, sum(n) OVER (PARTITION BY stat_key)::DOUBLE AS total, sum(ties) OVER (PARTITION BY stat_key) AS all_ties FROM g),
 z AS (SELECT x.stat_key, x.grp AS group_a, y.grp AS group_b, x.n AS n_a, y.n AS n_b,
  (x.rs / x.n - y.rs / y.n) / sqrt((x.total * (x.total + 1.0::DOUBLE) / 12 - x.all_ties / (12 * (x.total - 1.0::DOUBLE))) * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)) AS z
  FROM k x JOIN k y ON x.stat_key = y.stat_key AND x.grp < y.grp)
 SELECT stat_key, group_a, group_b, n_a, n_b, round(z, 6) AS z, CASE WHEN abs(z) > 6 THEN 0.0::DOUBLE END AS p_bonferroni FROM z""")
def dunn_posthoc(spark, d):
    """Quantities by their own thirds: groups so far apart that the omnibus test opens the gate and every p rounds to 0."""
    q_ = F.when(F.col("l_quantity") < 15, "few").when(F.col("l_quantity") < 35, "some").otherwise("many")
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("stat_key"), q_.alias("grp"), F.col("l_quantity").alias("value"))
    ranks = h.rank_sums(rows, ["stat_key"])
    return rounded(h.dunn(ranks, ["stat_key"], h.kruskal(ranks, ["stat_key"])))


@query()
def significance_counts(spark, d):
    tests = a.all_tests(h.rank_sums(_long(spark, d), m.KEY), m.KEY)
    return a.significant(h.benjamini_hochberg(tests, ["ruler"]), ["ruler"])


@query("""WITH c AS (SELECT grp AS row, quality AS col, count(*)::DOUBLE AS n FROM outcomes GROUP BY ALL),
 f AS (SELECT r.row, k.col, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY r.row) AS rn, sum(coalesce(c.n, 0)) OVER (PARTITION BY k.col) AS cn, sum(coalesce(c.n, 0)) OVER () AS t
   FROM (SELECT DISTINCT row FROM c) r CROSS JOIN (SELECT DISTINCT col FROM c) k LEFT JOIN c ON c.row = r.row AND c.col = k.col)
 SELECT 'quality_by_lang' AS stat_key, CAST(max(t) AS BIGINT) AS n, CAST((count(DISTINCT row) - 1) * (count(DISTINCT col) - 1) AS BIGINT) AS dof, round(sum((n - rn * cn / t) ** 2 / (rn * cn / t)), 6) AS chi2,
 round(sqrt(sum((n - rn * cn / t) ** 2 / (rn * cn / t)) / (max(t) * (least(count(DISTINCT row), count(DISTINCT col)) - 1))), 6) AS cramers_v FROM f""")
def chi_squared(spark, d):
    cells = view(spark, d, "outcomes").groupBy(F.lit("quality_by_lang").alias("stat_key"), F.col("grp").alias("row"), F.col("quality").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(h.chi_squared(cells, ["stat_key"], p_values=False))


@query("""WITH c AS (SELECT CAST(quality AS VARCHAR) AS row, CAST(toxic AS VARCHAR) AS col, count(*)::DOUBLE AS n FROM labels GROUP BY ALL),
 f AS (SELECT r.row, k.col, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY r.row) AS rn, sum(coalesce(c.n, 0)) OVER (PARTITION BY k.col) AS cn, sum(coalesce(c.n, 0)) OVER () AS t
   FROM (SELECT DISTINCT row FROM c) r CROSS JOIN (SELECT DISTINCT col FROM c) k LEFT JOIN c ON c.row = r.row AND c.col = k.col),
 x AS (SELECT max(t) AS t, sum((abs(n - rn * cn / t) - least(0.5, abs(n - rn * cn / t))) ** 2 / (rn * cn / t)) AS x FROM f)
 SELECT 'quality_by_toxic' AS stat_key, CAST(t AS BIGINT) AS n, CAST(1 AS BIGINT) AS dof, round(x, 6) AS chi2, round(sqrt(x / t), 6) AS cramers_v FROM x""")
def chi_squared_2x2(spark, d):
    """Two by two: the continuity correction holds."""
    cells = table(spark, d, "labels").groupBy(F.lit("quality_by_toxic").alias("stat_key"), F.col("quality").alias("row"), F.col("toxic").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(h.chi_squared(cells, ["stat_key"], p_values=False))


@query("""WITH p AS (SELECT lang AS family, doc_id, n_chars / 20001.0::DOUBLE AS p FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, doc_id) AS rk, count(*) OVER (PARTITION BY family) AS n FROM p)
 SELECT doc_id, family, round(p, 6) AS p, round(least(1.0::DOUBLE, min(p * n / rk) OVER (PARTITION BY family ORDER BY rk DESC)), 6) AS p_fdr FROM r""")
def benjamini_hochberg(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("family"), (F.col("n_chars") / 20001.0).alias("p"))
    return rounded(h.benjamini_hochberg(rows, ["family"], large=True))


@query("""WITH e AS (SELECT event_type, value, user_id % 2 = 0 AS label FROM events WHERE value IS NOT NULL),
 r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS rk FROM e),
 s AS (SELECT event_type, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n, sum(rk) FILTER (label) AS rs FROM r GROUP BY ALL)
 SELECT event_type, p AS n_pos, n AS n_neg, round((rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 6) AS auroc FROM s""")
def auroc(spark, d):
    e = table(spark, d, "events").withColumn("label", F.col("user_id") % 2 == 0)
    return rounded(h.auroc(e, ["event_type"], "label", "value"))


@query("""WITH e AS (SELECT lang, source, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS pred, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
 r AS (SELECT lang, y, avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0.0 END) AS rec FROM e GROUP BY ALL)
 SELECT lang, round(avg(rec), 6) AS balanced_accuracy, count(*) AS n_classes FROM r GROUP BY ALL""")
def balanced_accuracy(spark, d):
    e = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("pred", (F.col("n_chars") > 2000).cast("int"))
    return rounded(h.balanced_accuracy(e, ["lang"], "quality", "pred"))


# Resampling ---------------------------------------------------------------------------------------------------------


@query()
def bootstrap(spark, d):
    return resample.bootstrap(_rates(spark, d), m.KEY)


@query()
def permutation(spark, d):
    return resample.permutation(_rates(spark, d), m.KEY)


@query()
def poisson_bootstrap(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("grp"), "value", F.lit("value").alias("score"))
    return rounded(resample.poisson_bootstrap(e, ["score"], "grp", "value"))


# Regression and probes ----------------------------------------------------------------------------------------------


@query("""SELECT term, round(coef, 6) AS coef, round(r2, 6) AS r2, n FROM (
 SELECT unnest(['const', 'magnetic_field_strength']) AS term, unnest([regr_intercept(s.dice_disc, e.magnetic_field_strength), regr_slope(s.dice_disc, e.magnetic_field_strength)]) AS coef,
 regr_r2(s.dice_disc, e.magnetic_field_strength) AS r2, CAST(regr_count(s.dice_disc, e.magnetic_field_strength) AS BIGINT) AS n
 FROM scores s JOIN exams e ON s.series_submitter_id = e.series_submitter_id WHERE s.ruler = 'gold')""")
def ols_single(spark, d):
    rows = view(spark, d, "scores").filter("ruler = 'gold'").join(view(spark, d, "exams"), "series_submitter_id")
    return rounded(regress.ols(rows, "dice_disc", ["magnetic_field_strength"]).select("term", "coef", "r2", "n"))


@query()
def ols_adjusted(spark, d):
    rows = view(spark, d, "scores").filter("ruler = 'gold'").join(view(spark, d, "exams"), "series_submitter_id")
    return rounded(regress.ols(rows, "dice_vb", ["sex", "race", "age_at_imaging"]))


def _vectors(spark, d):
    return pr.as_vector(table(spark, d, "embeddings")).withColumn("binary", F.when(F.col("label") < 5, "low").otherwise("high"))


@query()
def pca_scores(spark, d):
    return pr.pca_2d(_vectors(spark, d), "vec_id")[0]


@query()
def pca_variance(spark, d):
    """The first two components' shares of the variance."""
    shares = pr.pca_2d(_vectors(spark, d), "vec_id")[1]
    return rounded(spark.createDataFrame([(i + 1, x) for i, x in enumerate(shares)], "component int, share double"))


@query()
def linear_probe(spark, d):
    return pr.probe(_vectors(spark, d), "vec_id", ["binary"])


@query()
def probe_null_control(spark, d):
    return pr.probe(pr.random_projection(_vectors(spark, d), 64, 64), "vec_id", ["binary"])


@query()
def probe_clusters(spark, d):
    return pr.cluster_agreement(_vectors(spark, d), "label", 10)


# Splits -------------------------------------------------------------------------------------------------------------

_ST = """p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY series_submitter_id) AS rn FROM exams) WHERE rn = 1),
 b AS (SELECT patient_id, sex, CASE race WHEN 'White' THEN 'White' WHEN 'Black or African American' THEN 'Black' ELSE 'Other' END AS race_bin,
   CASE WHEN age_at_imaging IS NULL THEN '60+' WHEN age_at_imaging < 40 THEN '<40' WHEN age_at_imaging < 60 THEN '40-60' ELSE '60+' END AS age_bin FROM p)"""


def _split_sql(strata: str) -> str:
    return f"""WITH {_ST},
 t AS (SELECT *, CASE WHEN race_bin = 'Other' THEN 'Other' ELSE {strata} END AS stratum FROM b),
 o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || CAST(patient_id AS VARCHAR)), patient_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM t),
 a AS (SELECT patient_id, race_bin, age_bin, stratum, CASE WHEN r <= greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS INTEGER)) THEN 'test'
   WHEN r <= greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS INTEGER)) + greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS INTEGER)) THEN 'val' ELSE 'train' END AS split FROM o)"""


_V2 = _split_sql("race_bin || '_' || age_bin || '_' || sex")


@query(_split_sql("race_bin || '_' || age_bin") + " SELECT e.series_submitter_id, e.patient_id, a.stratum, a.split FROM exams e JOIN a ON e.patient_id = a.patient_id")
def split_race_age(spark, d):
    return sp.split_patients(view(spark, d, "exams"), by_sex=False).select("series_submitter_id", "patient_id", "stratum", "split")


@query(_V2 + " SELECT e.series_submitter_id, e.patient_id, a.race_bin, a.age_bin, a.stratum, a.split FROM exams e JOIN a ON e.patient_id = a.patient_id")
def split_race_age_sex(spark, d):
    return sp.split_patients(view(spark, d, "exams")).select("series_submitter_id", "patient_id", "race_bin", "age_bin", "stratum", "split")


_V3 = _V2 + """, e2 AS (SELECT e.*, a.split FROM exams e JOIN a ON e.patient_id = a.patient_id),
 w AS (SELECT *, row_number() OVER (PARTITION BY split, sex ORDER BY md5('42:' || CAST(series_submitter_id AS VARCHAR)), series_submitter_id) AS r FROM e2),
 c AS (SELECT split, min(n) AS least FROM (SELECT split, sex, count(*) AS n FROM e2 GROUP BY ALL) GROUP BY split)"""


@query(_V3 + " SELECT series_submitter_id, patient_id, w.split, sex FROM w JOIN c ON w.split = c.split WHERE r <= least")
def split_balanced(spark, d):
    placed = sp.split_patients(view(spark, d, "exams"))
    return sp.downsample(placed, ["split"], "sex", "series_submitter_id").select("series_submitter_id", "patient_id", "split", "sex")


@query(_V2 + """, e2 AS (SELECT e.*, a.split FROM exams e JOIN a ON e.patient_id = a.patient_id WHERE annotation_quality = 'gold'),
 w AS (SELECT *, row_number() OVER (PARTITION BY split, sex ORDER BY md5('42:' || CAST(series_submitter_id AS VARCHAR)), series_submitter_id) AS r FROM e2),
 c AS (SELECT split, min(n) AS least FROM (SELECT split, sex, count(*) AS n FROM e2 GROUP BY ALL) GROUP BY split)
 SELECT series_submitter_id, patient_id, w.split, sex FROM w JOIN c ON w.split = c.split WHERE r <= least""")
def split_gold_only(spark, d):
    placed = sp.split_patients(view(spark, d, "exams")).filter("annotation_quality = 'gold'")
    return sp.downsample(placed, ["split"], "sex", "series_submitter_id").select("series_submitter_id", "patient_id", "split", "sex")


@query(_V2 + " SELECT patient_id, count(DISTINCT split) AS n_splits FROM (SELECT e.patient_id, a.split FROM exams e JOIN a ON e.patient_id = a.patient_id) GROUP BY patient_id HAVING count(DISTINCT split) > 1")
def split_leaks(spark, d):
    return sp.leaks(sp.split_patients(view(spark, d, "exams")))


@query("""WITH s AS (SELECT sex, count(*) AS n FROM exams GROUP BY sex), b AS (SELECT sex, coalesce(sum(n) OVER (ORDER BY sex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
 r AS (SELECT series_submitter_id, e.sex, row_number() OVER (PARTITION BY e.sex ORDER BY md5('42:' || CAST(series_submitter_id AS VARCHAR)), series_submitter_id) - 1 AS r FROM exams e)
 SELECT series_submitter_id, r.sex, CAST((r.r + b.before) % 5 AS INTEGER) AS fold FROM r JOIN b ON r.sex = b.sex""")
def stratified_folds(spark, d):
    return sp.folds(view(spark, d, "exams"), "sex", "series_submitter_id").select("series_submitter_id", "sex", "fold")


@query("""WITH n AS (SELECT doc_id, 'case_' || CAST(n_chars AS VARCHAR) AS id FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1 AS r FROM n)
 SELECT doc_id, id, CASE WHEN n > 1 THEN id || '_s' || CAST(r AS VARCHAR) ELSE id END AS case_id FROM c""")
def unique_case_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("case_"), F.col("n_chars").cast("string")).alias("id"))
    return sp.unique_ids(docs, "id", "doc_id")


@query("SELECT series_submitter_id, sex FROM exams ORDER BY md5('42:' || CAST(series_submitter_id AS VARCHAR)), series_submitter_id LIMIT 50")
def sample_exams(spark, d):
    return sp.sample_k(view(spark, d, "exams").select("series_submitter_id", "sex"), 50, "series_submitter_id")


@query("""SELECT series_submitter_id, CASE WHEN patient_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN 'gold' ELSE 'silver' END AS annotation_quality FROM exams""")
def provenance_backfill(spark, d):
    gold = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("patient_id"))
    return sp.provenance(view(spark, d, "exams"), gold, "patient_id").select("series_submitter_id", "annotation_quality")


# Voxels -------------------------------------------------------------------------------------------------------------

_LAB = "lab AS (SELECT unnest(['vb', 'disc']) AS label, unnest([1, 2]) AS v)"
_CNT = f"""{_LAB}, cnt AS (SELECT case_id, label, count(*) FILTER (ref = v AND pred = v) AS tp, count(*) FILTER (ref <> v AND pred = v) AS fp,
 count(*) FILTER (ref = v AND pred <> v) AS fn, count(*) FILTER (ref = v) AS ref_n, count(*) FILTER (pred = v) AS pred_n FROM voxels CROSS JOIN lab GROUP BY ALL)"""


@query(f"WITH {_CNT} SELECT * FROM cnt")
def segmentation_counts(spark, d):
    return v.segmentation_counts(view(spark, d, "voxels"))


@query(f"WITH {_CNT} SELECT case_id, label, round(CASE WHEN ref_n + pred_n = 0 THEN 'NaN'::DOUBLE ELSE 2.0::DOUBLE * tp / (ref_n + pred_n) END, 6) AS dice FROM cnt")
def dice(spark, d):
    return rounded(v.dice(v.segmentation_counts(view(spark, d, "voxels"))))


@query(f"""WITH {_CNT}, z AS (SELECT cnt.*, CAST(nx AS BIGINT) * ny * nz AS total FROM cnt JOIN volumes ON cnt.case_id = volumes.case_id), lo AS (SELECT label, avg(ref_n / total::DOUBLE) AS r FROM z GROUP BY label),
 k AS (SELECT z.*, (1 - r) * ref_n / (r * (total - ref_n)) AS kap FROM z JOIN lo ON z.label = lo.label)
 SELECT case_id, label, round(CASE WHEN tp = 0 AND ref_n = 0 THEN 'NaN'::DOUBLE WHEN tp = 0 OR ref_n = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (kap * fp + 2.0::DOUBLE * tp + fn) END, 6) AS ndsc FROM k""")
def ndsc(spark, d):
    return rounded(v.ndsc(v.segmentation_counts(view(spark, d, "voxels")), view(spark, d, "volumes")))


_HD = f"""{_CNT}, inside AS (SELECT case_id, 'ref' AS side, ref AS v, x, y, z FROM voxels WHERE ref IN (1, 2) UNION ALL SELECT case_id, 'pred', pred, x, y, z FROM voxels WHERE pred IN (1, 2)),
 nb AS (SELECT i.case_id, i.side, i.v, i.x, i.y, i.z, count(j.x) AS c FROM inside i LEFT JOIN inside j ON i.case_id = j.case_id AND i.side = j.side AND i.v = j.v
   AND abs(i.x - j.x) + abs(i.y - j.y) + abs(i.z - j.z) = 1 GROUP BY ALL),
 bnd AS (SELECT * FROM nb WHERE c < 6),
 dist AS (SELECT p.case_id, p.v, p.side, p.x, p.y, p.z, min(sqrt(((p.x - q.x) * 0.5::DOUBLE) ** 2 + ((p.y - q.y) * 0.5::DOUBLE) ** 2 + ((p.z - q.z) * 4.0::DOUBLE) ** 2)) AS dd
   FROM bnd p JOIN bnd q ON p.case_id = q.case_id AND p.v = q.v AND p.side <> q.side GROUP BY ALL),
 far AS (SELECT case_id, v, max(q) AS q FROM (SELECT case_id, v, side, quantile_cont(dd, 0.95) AS q FROM dist GROUP BY ALL) GROUP BY ALL),
 hd AS (SELECT cnt.case_id, cnt.label, CASE WHEN ref_n = 0 AND pred_n = 0 THEN 'NaN'::DOUBLE WHEN ref_n = 0 OR pred_n = 0 THEN 'Infinity'::DOUBLE ELSE q END AS hd95
   FROM cnt JOIN lab ON cnt.label = lab.label LEFT JOIN far ON cnt.case_id = far.case_id AND lab.v = far.v)"""


@query(f"WITH {_HD} SELECT case_id, label, round(hd95, 6) AS hd95 FROM hd")
def hd95(spark, d):
    return rounded(v.hd95(view(spark, d, "voxels"), view(spark, d, "volumes")))


@query(f"""WITH {_HD}, dc AS (SELECT case_id, label, CASE WHEN ref_n + pred_n = 0 THEN 'NaN'::DOUBLE ELSE 2.0::DOUBLE * tp / (ref_n + pred_n) END AS s FROM cnt),
 z AS (SELECT cnt.*, CAST(nx AS BIGINT) * ny * nz AS total FROM cnt JOIN volumes ON cnt.case_id = volumes.case_id), lo AS (SELECT label, avg(ref_n / total::DOUBLE) AS r FROM z GROUP BY label),
 k AS (SELECT z.*, (1 - r) * ref_n / (r * (total - ref_n)) AS kap FROM z JOIN lo ON z.label = lo.label),
 nd AS (SELECT case_id, label, CASE WHEN tp = 0 AND ref_n = 0 THEN 'NaN'::DOUBLE WHEN tp = 0 OR ref_n = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (kap * fp + 2.0::DOUBLE * tp + fn) END AS s FROM k),
 u AS (SELECT case_id, 'dice_' || label AS name, s FROM dc UNION ALL SELECT case_id, 'hd95_' || label, hd95 FROM hd UNION ALL SELECT case_id, 'ndsc_' || label, s FROM nd)
 SELECT case_id, """ + ", ".join(f"round(max(s) FILTER (name = '{x}_{y}'), 6) AS {x}_{y}" for x in ("dice", "hd95", "ndsc") for y in ("vb", "disc")) + " FROM u GROUP BY case_id")
def case_scores(spark, d):
    return rounded(v.case_scores(view(spark, d, "voxels"), view(spark, d, "volumes")))


@query("""SELECT v.case_id, CASE ref WHEN 1 THEN 'vb' ELSE 'disc' END AS label, count(*) AS n_voxels, round(count(*) * any_value(sx * sy * sz), 6) AS volume_mm3
 FROM voxels v JOIN grids ON v.case_id = grids.case_id WHERE ref IN (1, 2) GROUP BY ALL""")
def label_volumes(spark, d):
    return rounded(v.label_volumes(view(spark, d, "voxels"), view(spark, d, "grids")))


_CC = """inside AS (SELECT case_id, ref AS v, x * 10000 + y * 100 + z AS c FROM voxels WHERE ref IN (1, 2)),
 edge AS (SELECT a.case_id, a.v, a.c AS p, b.c AS q FROM inside a JOIN inside b ON a.case_id = b.case_id AND a.v = b.v AND abs(a.c - b.c) IN (1, 100, 10000)),
 reach AS (SELECT case_id, v, c AS p, c AS root FROM inside UNION SELECT e.case_id, e.v, e.q, r.root FROM reach r JOIN edge e ON r.case_id = e.case_id AND r.v = e.v AND r.p = e.p AND r.root < e.q),
 least AS (SELECT case_id, v, p, min(root) AS root FROM reach GROUP BY ALL),
 cc AS (SELECT case_id, CASE v WHEN 1 THEN 'vb' ELSE 'disc' END AS label, CAST(count(*) FILTER (p = root) AS BIGINT) AS n_components FROM least GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_CC} SELECT * FROM cc")
def connected_components(spark, d):
    return v.connected_components(view(spark, d, "voxels"))


@query("""SELECT case_id, nx, ny, nz, sx, sy, sz, CAST(nx AS BIGINT) * ny * nz AS total_voxels, nx * sx AS physical_width, ny * sy AS physical_height, nz * sz AS physical_depth,
 (nx * sx) * (ny * sy) * (nz * sz) AS physical_volume, round((nx * sx) / (ny * sy), 6) AS aspect_ratio_xy, round((nx * sx) / (nz * sz), 6) AS aspect_ratio_xz,
 round((ny * sy) / (nz * sz), 6) AS aspect_ratio_yz, round(sz / sqrt(sx * sy), 6) AS anisotropy_factor FROM volumes""")
def geometry(spark, d):
    return rounded(v.geometry(view(spark, d, "volumes")))


def _image(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_quantity").cast("int").alias("x"), (F.col("l_orderkey") % 20).cast("int").alias("y")).agg(F.max("l_extendedprice").alias("intensity"))


_IMG = "im AS (SELECT l_suppkey AS case_id, CAST(l_quantity AS INTEGER) AS x, CAST(l_orderkey % 20 AS INTEGER) AS y, max(l_extendedprice) AS intensity FROM lineitem GROUP BY ALL)"


@query(f"WITH {_IMG}, t AS (SELECT *, max(intensity) OVER (PARTITION BY case_id) AS top FROM im) SELECT case_id, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM t WHERE intensity > 0.05::DOUBLE * top GROUP BY case_id")
def foreground_box(spark, d):
    return v.foreground_box(_image(spark, d))


@query(f"WITH {_IMG} SELECT case_id, x, y, intensity, round((intensity - min(intensity) OVER w) / greatest(max(intensity) OVER w - min(intensity) OVER w, 1e-8), 6) AS scaled FROM im WINDOW w AS (PARTITION BY case_id)")
def rescale(spark, d):
    return rounded(v.rescale(_image(spark, d)))


@query("SELECT x.case_id, x.x, x.y, x.z, x.ref, x.pred FROM voxels x JOIN volumes w ON x.case_id = w.case_id WHERE x.x = w.nx // 2")
def mid_slice(spark, d):
    return v.mid_slice(view(spark, d, "voxels"), view(spark, d, "volumes")).select("case_id", "x", "y", "z", "ref", "pred")


@query(f"WITH {_IMG} SELECT case_id, round(quantile_cont(intensity, 0.01), 6) AS window_lo, round(quantile_cont(intensity, 0.99), 6) AS window_hi FROM im WHERE intensity <> 0 GROUP BY case_id")
def intensity_window(spark, d):
    return rounded(v.intensity_window(_image(spark, d)))


# Quality --------------------------------------------------------------------------------------------------------------


def _validation_sql(spec: q.Spec, t: str) -> str:
    """One row for each broken rule of a specification."""
    one = lambda rule, c, bad: f"SELECT '{rule}' AS rule, '{c}' AS \"column\", count(*) AS n, min(CAST({c} AS VARCHAR)) AS sample FROM {t} WHERE {bad} HAVING count(*) > 0"
    names = lambda v: ", ".join(f"'{x}'" for x in v)
    parts = [one("required", c, f"{c} IS NULL") for c in spec.required] + [one("allowed", c, f"{c} NOT IN ({names(v)})") for c, v in spec.allowed.items()]
    parts += [one("positive", c, f"{c} <= 0") for c in spec.positive]
    parts += [one("unique", c, "true").replace(f"FROM {t}", f"FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)") for c in spec.unique]
    return " UNION ALL ".join(parts)


@query(_validation_sql(q.EXAM_SPEC, "bad_exams"))
def validate_exams(spark, d):
    return q.validate(view(spark, d, "bad_exams"), q.EXAM_SPEC)


@query(_validation_sql(q.VOLUME_SPEC, "bad_volumes"))
def validate_volumes(spark, d):
    return q.validate(view(spark, d, "bad_volumes"), q.VOLUME_SPEC)


@query("SELECT series_submitter_id, sex FROM exams WHERE patient_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def exclude_patients(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("patient_id"))
    return q.exclude(view(spark, d, "exams"), gone, "patient_id").select("series_submitter_id", "sex")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY o_orderstatus")
def status_ledger(spark, d):
    return q.ledger(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""WITH u AS (SELECT 'l_quantity' AS property, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
 z AS (SELECT property, avg(value) AS mean, stddev_samp(value) AS std FROM u GROUP BY property), t AS (SELECT u.property, value, mean, std FROM u JOIN z ON u.property = z.property)
 SELECT property, round(mean, 6) AS mean, round(std, 6) AS std, count(*) FILTER (abs(value - mean) > 2 * std) AS n_2sigma, count(*) FILTER (abs(value - mean) > 3 * std) AS n_3sigma,
 round(100.0::DOUBLE * count(*) FILTER (abs(value - mean) > 2 * std) / count(*), 1) AS pct_2sigma, round(100.0::DOUBLE * count(*) FILTER (abs(value - mean) > 3 * std) / count(*), 1) AS pct_3sigma FROM t GROUP BY property, mean, std""")
def sigma_outliers(spark, d):
    return rounded(s.sigma_outliers(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("SELECT case_id, tp, fp FROM (SELECT case_id, count(*) FILTER (ref = 1 AND pred = 1) AS tp, count(*) FILTER (ref <> 1 AND pred = 1) AS fp FROM voxels GROUP BY case_id) WHERE tp > 150 OR fp > 35")
def threshold_outliers(spark, d):
    return v.segmentation_counts(view(spark, d, "voxels")).filter("label = 'vb' AND (tp > 150 OR fp > 35)").select("case_id", "tp", "fp")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'prediction' ELSE '' END || CASE WHEN l.doc_id IS NULL AND v.vec_id IS NULL THEN ',' ELSE '' END || CASE WHEN v.vec_id IS NULL THEN 'reference' ELSE '' END AS missing
 FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON d.doc_id = v.vec_id WHERE l.doc_id IS NULL OR v.vec_id IS NULL""")
def missing_inputs(spark, d):
    wanted = table(spark, d, "documents").select("doc_id")
    return src.resolve_pairs(wanted, "doc_id", table(spark, d, "labels"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"))[1]


# Reports ----------------------------------------------------------------------------------------------------------------

_VC = "SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM {t} GROUP BY {c}"
_AGE = "CASE WHEN age_at_imaging IS NULL THEN '60+' WHEN age_at_imaging < 40 THEN '<40' WHEN age_at_imaging < 60 THEN '40-60' ELSE '60+' END"


@query(" UNION ALL ".join(_VC.format(c=c, t="exams") for c in ("sex", "race", "ethnicity")))
def demographics(spark, d):
    return rp.value_counts(view(spark, d, "exams"), ["sex", "race", "ethnicity"])


@query("WITH f AS (SELECT *, upper(manufacturer) AS mfr, CASE WHEN magnetic_field_strength = 3 THEN '3.0T' ELSE '1.5T' END AS field FROM exams) " + _VC.format(c="mfr", t="f").replace("'mfr'", "'manufacturer'") + " UNION ALL " + _VC.format(c="field", t="f"))
def scanner(spark, d):
    return rp.value_counts(rp.crosscut_frame(view(spark, d, "exams")), ["manufacturer", "field"])


@query(f"WITH f AS (SELECT *, {_AGE} AS age_bin, age_at_imaging IS NULL AS age_missing FROM exams) " + " UNION ALL ".join(_VC.format(c=c, t="f") for c in ("sex", "race", "ethnicity", "age_bin", "age_missing")))
def composition(spark, d):
    return rp.composition(view(spark, d, "exams"))


@query("""WITH e AS (SELECT min(age_at_imaging) AS lo, max(age_at_imaging) AS hi FROM exams), b AS (SELECT unnest(range(0, 30)) AS bin),
 n AS (SELECT least(CAST(floor((age_at_imaging - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin, count(*) AS n FROM exams, e WHERE age_at_imaging IS NOT NULL GROUP BY 1)
 SELECT 'age_at_imaging' AS property, CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * b.bin, 6) AS lo, round(lo + (hi - lo) / 30 * (b.bin + 1), 6) AS hi, coalesce(n.n, 0) AS n FROM b CROSS JOIN e LEFT JOIN n ON b.bin = n.bin""")
def age_histogram(spark, d):
    return rounded(s.histogram(view(spark, d, "exams"), ["age_at_imaging"], 30))


@query("""SELECT 'age_at_imaging' AS property, count(age_at_imaging) AS n, count(*) - count(age_at_imaging) AS n_missing, round(avg(age_at_imaging), 6) AS mean, round(stddev_samp(age_at_imaging), 6) AS std,
 min(age_at_imaging) AS min, list_sort(list(age_at_imaging) FILTER (age_at_imaging IS NOT NULL))[CAST(floor((count(age_at_imaging) - 1) * 0.25::DOUBLE + 0.5) AS BIGINT) + 1] AS q25, median(age_at_imaging) AS median,
 list_sort(list(age_at_imaging) FILTER (age_at_imaging IS NOT NULL))[CAST(floor((count(age_at_imaging) - 1) * 0.75::DOUBLE + 0.5) AS BIGINT) + 1] AS q75, max(age_at_imaging) AS max FROM exams""")
def age_summary(spark, d):
    return rounded(s.describe(view(spark, d, "exams"), ["age_at_imaging"]))


@query("""WITH c AS (SELECT sex AS "row", annotation_quality AS col, count(*) AS n FROM exams GROUP BY ALL) SELECT "row", col, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY "row"), 1) AS row_pct FROM c""")
def crosstab(spark, d):
    return s.crosstab(view(spark, d, "exams"), "sex", "annotation_quality")


@query("SELECT sex, count(*) FILTER (annotation_quality = 'gold') AS gold, count(*) FILTER (annotation_quality = 'silver') AS silver FROM exams GROUP BY sex")
def pivot_counts(spark, d):
    return s.pivot_counts(view(spark, d, "exams"), "sex", "annotation_quality", ["gold", "silver"])


@query()
def crosscuts(spark, d):
    return rounded(rp.crosscuts(view(spark, d, "exams")))


@query()
def pool_comparability(spark, d):
    return rounded(rp.pool_comparability(view(spark, d, "exams")))


@query(_V2 + f", f AS (SELECT a.split, e.sex, e.race, {_AGE.replace('age_at', 'e.age_at')} AS age_bin FROM exams e JOIN a ON e.patient_id = a.patient_id) " + " UNION ALL ".join(
    f"SELECT split, '{c}' AS attribute, {c} AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY split), 1) AS pct FROM f GROUP BY split, {c}" for c in ("sex", "race", "age_bin")))
def split_balance(spark, d):
    return rp.split_balance(sp.split_patients(view(spark, d, "exams")))


@query()
def cohort_crosscuts(spark, d):
    exams = view(spark, d, "exams")
    placed = sp.split_patients(exams).select("series_submitter_id", "split")
    return rounded(rp.crosscuts(rp.by_cohort(exams, placed, "series_submitter_id"), ["cohort"]))


@query("""WITH c AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (ORDER BY total, l_orderkey) AS r, count(*) OVER () AS n FROM c)
 SELECT l_orderkey, total, CASE WHEN r = 1 THEN 'smallest' WHEN r = n // 2 + 1 THEN 'median' ELSE 'largest' END AS role FROM r WHERE r = 1 OR r = n // 2 + 1 OR r = n""")
def representatives(spark, d):
    return s.representatives(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")), "total", "l_orderkey")


@query(f"""WITH f AS (SELECT s.ruler, {_AGE.replace('age_at', 'e.age_at')} AS age_bin, s.hd95_disc AS v FROM scores s JOIN exams e ON s.series_submitter_id = e.series_submitter_id)
 SELECT ruler, age_bin, count(v) AS n, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(stddev_samp(v), 9) AS std FROM f GROUP BY ALL""")
def age_trend(spark, d):
    rows = view(spark, d, "scores").join(view(spark, d, "exams"), "series_submitter_id").withColumn("age_bin", g.age_bins(F.col("age_at_imaging")))
    return rounded(s.group_summary(rows, ["ruler", "age_bin"], "hd95_disc").select("ruler", "age_bin", "n", "mean", "median", "std"), 9)


@query("""WITH h AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END AS kw, sum(l_quantity) AS hours FROM lineitem GROUP BY 1),
 s AS (SELECT unnest(['low', 'central', 'high']) AS scenario, unnest([1.55::DOUBLE, 1.58, 1.67]) AS pue, unnest([0.099::DOUBLE, 0.099, 0.138]) AS ci)
 SELECT scenario, round(sum(hours * kw * pue), 6) AS kwh, round(sum(hours * kw * pue) * ci, 6) AS co2_kg FROM h CROSS JOIN s GROUP BY scenario, ci""")
def energy(spark, d):
    queue = F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp"), "gpua100").otherwise("gpul40s")
    return rounded(rp.energy(table(spark, d, "lineitem").groupBy(queue.alias("queue")).agg(F.sum("l_quantity").alias("hours"))))


@query("""SELECT page_id, 'page_' || regexp_extract(url, '/([0-9]+)', 1) AS case_id FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> ''""")
def captured_ids(spark, d):
    n = F.regexp_extract("url", r"/([0-9]+)", 1)
    return table(spark, d, "pages").filter(n != "").select("page_id", F.concat(F.lit("page_"), n).alias("case_id"))


from evenhand import registry_reports, registry_stats  # noqa: E402, F401  their queries join these
