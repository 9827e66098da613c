"""Reports over the exam table: composition, confounders, comparability, balance, energy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.operators import hypothesis as h
from evenhand.operators import quality as q
from evenhand.operators import summaries as s
from evenhand.operators.grouping import age_bins
from evenhand.operators.summaries import counts, shares
from evenhand.plans.volumes import segmentation_tests
from evenhand.sources.scratch import cut
from evenhand.sources.tables import image_files

SPLIT_ORDER = ("train", "val", "test")


# How the metadata tables' columns are called in the exam table
RENAMES = {
    "cases": {"submitter_id": "patient_id"},
    "studies": {"submitter_id": "study_submitter_id", "case_ids": "patient_id"},
    "series": {"submitter_id": "series_submitter_id", "imaging_studies.submitter_id": "study_submitter_id", "case_ids": "patient_id"},
}


def renamed(df: DataFrame, kind: str) -> DataFrame:
    """A metadata table with the exam table's column names; columns that begin with '_' and the node's type are left out."""
    out = df.withColumnsRenamed({k: v for k, v in RENAMES[kind].items() if k in df.columns})
    return out.drop("type", *[c for c in out.columns if c.startswith("_")])


def load_exams(series: DataFrame, studies: DataFrame, cases: DataFrame, annotations: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """The exam table of the four metadata tables: left joins from the series, upper-cased manufacturer, exclusions left out."""
    series, studies, cases = renamed(series, "series"), renamed(studies, "studies"), renamed(cases, "cases")
    out = series.join(studies.drop("patient_id"), "study_submitter_id", "left").join(cases, "patient_id", "left").join(annotations, "series_submitter_id", "left")
    out = out.withColumn("manufacturer", F.upper("manufacturer"))
    return out.join(excluded.select("series_submitter_id"), "series_submitter_id", "left_anti") if excluded is not None else out


def load_metadata(series: DataFrame, studies: DataFrame, cases: DataFrame, annotations: DataFrame, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(exam table of the series' images that are not excluded, violations of its specification)."""
    exams = load_exams(series, studies, cases, image_files(annotations), excluded)
    return exams, q.validate(exams, q.EXAM_SPEC)


def value_counts(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, attribute, value, n, pct): several columns' counts in one job."""
    keys = keys or []
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.attribute", "p.value")
    return shares(counts(long, [*keys, "attribute", "value"]), [*keys, "attribute"])


def by_cohort(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Each row in the cohort 'full' and in that of its split."""
    full = df.withColumn("cohort", F.lit("full"))
    return full.unionByName(df.join(splits.select(key, F.col("split").alias("cohort")), key))


# The confounder questions (attribute pairs) that the cross-cut report asks
CONTINUOUS = ("sex", "race_wb", "manufacturer", "field")
CATEGORICAL = (("sex", "race_wbo"), ("race_wbo", "manufacturer"), ("sex", "manufacturer"), ("race_wbo", "field"))


def crosscut_frame(exams: DataFrame) -> DataFrame:
    """Attributes of the cross-cuts: upper-cased manufacturer, field strength as '1.5T', the race groupings."""
    from evenhand.operators.grouping import RACE_WB, RACE_WBO, Grouping

    return exams.withColumns({
        "manufacturer": F.upper("manufacturer"),
        "field": F.concat(F.col("magnetic_field_strength").cast("string"), F.lit("T")),
        "race_wb": Grouping("race_wb", "race", RACE_WB).column(),
        "race_wbo": Grouping("race_wbo", "race", RACE_WBO).column(),
    })


def age_ranks(frame: DataFrame, by: tuple[str, ...] = CONTINUOUS, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    pairs = F.array(*[F.struct(F.concat(F.lit("age_by_"), F.lit(c)).alias("stat_key"), F.col(c).alias("grp")) for c in by])
    long = frame.select(*keys, F.col("age_at_imaging").alias("value"), F.explode(pairs).alias("p")).select(*keys, "value", "p.stat_key", "p.grp")
    return h.rank_sums(long.filter("grp IS NOT NULL"), [*keys, "stat_key"])


def scanner_report(exams: DataFrame, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """counts of manufacturer and field strength (upper-cased, '1.5T'), their cells, and histograms of the numeric columns that are there."""
    frame = crosscut_frame(exams)
    numeric = [c for c in ("slice_thickness", "pixel_spacing", "spacing_between_slices", "echo_time", "repetition_time") if c in exams.columns]
    out = {"counts": value_counts(frame, ["manufacturer", "field"], keys), "cells": attribute_cells(frame, (("manufacturer", "field"),), keys)}
    if numeric:
        out["histograms"] = s.histogram(exams, numeric, 25, keys)
    return out


def cohort_reports(
    exams: DataFrame, splits: DataFrame, segmentations: DataFrame | None = None, key: str = "series_submitter_id", geometry: DataFrame | None = None, only: tuple[str, ...] | None = None,
) -> dict[str, DataFrame]:
    """Every report (or ``only`` some) for the cohort 'full' and for each split at once, keyed by cohort.

    demographics, ages, age_histogram, scanner, scanner_cells, scanner_histograms (of the columns that are there), crosscuts;
    with ``geometry`` (case_id and geometry columns): geometry, geometry_histograms, geometry_outliers and representatives (by
    volume); with ``segmentations``: segmentations (tests), volumes, volume_histograms, component_histograms. Volumes and
    geometry get their cohort by case, as exams do by ``key``.
    """
    from evenhand.plans import volumes as vo

    rows = cut(by_cohort(exams, splits, key), "cohorts")
    of, by_case = ["cohort"], splits.withColumnRenamed(key, "case_id")
    parts: dict[str, Callable[[], DataFrame | None]] = {
        "demographics": lambda: value_counts(rows, ["sex", "race", "ethnicity"], of),
        "ages": lambda: s.group_summary(rows.select("cohort", F.col("age_at_imaging").alias("value")), of),
        "age_histogram": lambda: s.histogram(rows, ["age_at_imaging"], 30, of),
        "scanner": lambda: scanner_report(rows, of)["counts"],
        "scanner_cells": lambda: scanner_report(rows, of)["cells"],
        "scanner_histograms": lambda: scanner_report(rows, of).get("histograms"),
        "crosscuts": lambda: crosscuts(rows, of),
    }
    if geometry is not None:
        grids = by_cohort(geometry, by_case, "case_id")
        parts |= {
            "geometry": lambda: s.describe(grids, vo.GEOMETRY, of),
            "geometry_histograms": lambda: s.histogram(grids, vo.GEOMETRY, 30, of),
            "geometry_outliers": lambda: s.sigma_outliers(grids, vo.GEOMETRY, of),
            "representatives": lambda: s.representatives(grids.filter("physical_volume IS NOT NULL"), "physical_volume", "case_id", of),
        }
    if segmentations is not None:
        cases = by_cohort(segmentations, by_case, "case_id")
        components = [c for c in vo.columns() if c.startswith("n_components")]
        sizes = [c for c in vo.columns() if c not in components]
        parts |= {
            "segmentations": lambda: segmentation_tests(segmentations, rows, of),
            "volumes": lambda: s.describe(cases, sizes, of),
            "volume_histograms": lambda: s.histogram(cases, sizes, 40, of),
            "component_histograms": lambda: s.integer_histogram(cases, components, of),
        }
    made = {name: part() for name, part in parts.items() if only is None or name in only}
    return {name: df for name, df in made.items() if df is not None}


def attribute_cells(frame: DataFrame, pairs: tuple[tuple[str, str], ...] = CATEGORICAL, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    structs = F.array(*[F.struct(F.lit(f"{a}_by_{b}").alias("stat_key"), F.col(a).cast("string").alias("row"), F.col(b).cast("string").alias("col")) for a, b in pairs])
    long = frame.select(*keys, F.explode(structs).alias("p")).select(*keys, "p.*").filter("row IS NOT NULL AND col IS NOT NULL")
    return counts(long, [*keys, "stat_key", "row", "col"])


def crosscuts(exams: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Eight tests (age against four attributes, four pairs of attributes) with one false-discovery family per key."""
    keys = keys or []
    frame = crosscut_frame(exams)
    key = [*keys, "stat_key"]
    ranks = age_ranks(frame, keys=keys)
    two = h.mann_whitney(ranks, key).select(*key, F.lit("mann_whitney").alias("test"), F.col("rank_biserial").alias("effect"), "p")
    more = h.kruskal(ranks, key).select(*key, F.lit("kruskal").alias("test"), F.col("epsilon_squared").alias("effect"), "p")
    chi = h.chi_squared(attribute_cells(frame, keys=keys), key).select(*key, F.lit("chi_squared").alias("test"), F.col("cramers_v").alias("effect"), "p")
    out = h.benjamini_hochberg(two.unionByName(more).unionByName(chi), keys)
    return out.withColumn("reject_h0", F.coalesce(F.col("p_fdr") < 0.05, F.lit(False)))


def composition(exams: DataFrame) -> DataFrame:
    """Counts and shares of sex, race, ethnicity, age bin and missing age."""
    frame = exams.withColumn("age_bin", age_bins(F.col("age_at_imaging"))).withColumn("age_missing", F.col("age_at_imaging").isNull())
    return value_counts(frame, ["sex", "race", "ethnicity", "age_bin", "age_missing"])


def pool_comparability(exams: DataFrame, pool: str = "annotation_quality", attributes: tuple[str, ...] = ("sex", "race", "ethnicity", "manufacturer")) -> DataFrame:
    """Two pools compared on each attribute and on age: effect, p, p_fdr, and comparable where p_fdr >= .05 and |effect| < .1."""
    cells = attribute_cells(exams, tuple((pool, a) for a in attributes))
    chi = h.chi_squared(cells, ["stat_key"]).select("stat_key", F.lit("chi_squared").alias("test"), F.col("cramers_v").alias("effect"), "p")
    ranks = h.rank_sums(exams.select(F.lit(f"{pool}_by_age").alias("stat_key"), F.col(pool).alias("grp"), F.col("age_at_imaging").alias("value")), ["stat_key"])
    age = h.mann_whitney(ranks, ["stat_key"]).select("stat_key", F.lit("mann_whitney").alias("test"), F.col("rank_biserial").alias("effect"), "p")
    out = h.benjamini_hochberg(chi.unionByName(age), [])
    return out.withColumn("comparable", (F.col("p_fdr") >= 0.05) & (F.abs("effect") < 0.1))


def split_balance(placed: DataFrame) -> DataFrame:
    """(split, attribute, value, n, pct within the split), splits in their own order."""
    frame = placed.withColumn("age_bin", age_bins(F.col("age_at_imaging")))
    out = value_counts(frame, ["sex", "race", "age_bin"], ["split"])
    place = F.array_position(F.array(*[F.lit(s) for s in SPLIT_ORDER]), F.col("split"))
    return out.orderBy(place, "attribute", "value")


def consistency(tests: DataFrame, first: str, second: str, key: str = "stat_key", cohort: str = "cohort") -> DataFrame:
    """Whether two cohorts decide each test alike."""
    a = tests.filter(F.col(cohort) == first).select(key, F.col("reject_h0").alias("first"))
    b = tests.filter(F.col(cohort) == second).select(key, F.col("reject_h0").alias("second"))
    return a.join(b, key).withColumn("consistent", F.col("first") == F.col("second"))


# Board power in kW by queue; overhead and grid intensity (kg/kWh) by scenario
BOARD_KW = {"gpua100": 0.25, "gpul40s": 0.35}
SCENARIOS = {"low": (1.55, 0.099), "central": (1.58, 0.099), "high": (1.67, 0.138)}


def energy(hours: DataFrame) -> DataFrame:
    """(scenario, kwh, co2_kg) of hours by queue: hours times board power times overhead, and times grid intensity."""
    spark: SparkSession = hours.sparkSession
    power = spark.createDataFrame(list(BOARD_KW.items()), "queue string, kw double")
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(p).alias("pue"), F.lit(c).alias("ci")) for k, (p, c) in SCENARIOS.items()]))
    rows = hours.join(F.broadcast(power), "queue").select("hours", "kw", cases.alias("s"))  # a row a queue
    kwh = F.sum(F.col("hours") * F.col("kw") * F.col("s.pue"))
    return rows.groupBy(F.col("s.scenario").alias("scenario"), F.col("s.ci").alias("ci")).agg(kwh.alias("kwh")).select("scenario", "kwh", (F.col("kwh") * F.col("ci")).alias("co2_kg"))


def run_times(lines: DataFrame, pattern: str = r"Run time :\s*([0-9.]+) sec") -> DataFrame:
    """(path, hours) of job logs read as text lines with their path: the run time that each states."""
    return lines.withColumn("_s", F.regexp_extract("value", pattern, 1)).filter("_s <> ''").groupBy("path").agg((F.max(F.col("_s").cast("double")) / 3600).alias("hours"))
