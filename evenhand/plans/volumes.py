"""Jobs and reports over volumes: scan geometry, and volumes, voxels and components of segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.operators import hypothesis as h
from evenhand.operators import quality as q
from evenhand.operators import summaries as s
from evenhand.operators import voxels as v
from evenhand.operators.grouping import RACE_WB, Grouping, age_bins
from evenhand.sources.scratch import cut

MEASURES = ("n_voxels", "volume_mm3", "n_components")
# More components than this is an outlier
MOST_COMPONENTS = 15
GEOMETRY = ["total_voxels", "physical_width", "physical_height", "physical_depth", "physical_volume", "aspect_ratio_xy", "aspect_ratio_xz", "aspect_ratio_yz", "anisotropy_factor"]


def columns() -> list[str]:
    return [f"{x}_{label}" for x in MEASURES for label in v.LABELS]


def geometry_job(volumes: DataFrame, excluded: DataFrame | None = None, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(geometry of the valid grids that are not excluded, violations of the others' specification)."""
    rows = q.exclude(volumes, excluded, key) if excluded is not None else volumes
    return v.geometry(rows), q.validate(rows, q.VOLUME_SPEC)


def segmentation_table(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """A row a case: n_voxels, volume_mm3 and n_components of each label, 0 for a label without voxels."""
    voxels = cut(voxels.select("case_id", "x", "y", "z", "ref"), "voxels")  # three steps read it
    both = v.label_volumes(voxels, volumes).join(v.connected_components(voxels), ["case_id", "label"])
    wide = both.groupBy("case_id").pivot("label", list(v.LABELS)).agg(*[F.first(x).alias(x) for x in MEASURES])
    wide = wide.withColumnsRenamed({f"{label}_{x}": f"{x}_{label}" for label in v.LABELS for x in MEASURES})
    return voxels.select("case_id").distinct().join(wide, "case_id", "left").na.fill(0, columns()).select("case_id", *columns())


def segmentation_job(voxels: DataFrame, volumes: DataFrame, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segmentation table of the cases that are not excluded, violations)."""
    rows = q.exclude(voxels, excluded, "case_id") if excluded is not None else voxels
    table = segmentation_table(rows, volumes)
    return table, q.validate(table, q.SEGMENTATION_SPEC)


def geometry_report(geometry: DataFrame, bins: int = 30) -> dict[str, DataFrame]:
    """summary, histograms and sigma outliers of the geometry columns."""
    return {"summary": s.describe(geometry, GEOMETRY), "histograms": s.histogram(geometry, GEOMETRY, bins), "outliers": s.sigma_outliers(geometry, GEOMETRY)}


def test_frame(table: DataFrame, exams: DataFrame, keys: list[str] | None = None, case: str = "series_submitter_id") -> DataFrame:
    """(keys, stat_key, kind, grp, value): sixteen questions of the report, laid out in rows; cases without an exam keep null groups out.

    Volumes and components are asked by sex, race and age, voxels and volumes by manufacturer.
    """
    keys = keys or []
    full = table.join(exams, table["case_id"] == exams[case], "left").withColumns({
        "race_wb": Grouping("race_wb", "race", RACE_WB).column(),
        "age_bin": F.when(F.col(case).isNotNull(), age_bins(F.col("age_at_imaging"))),
        "manufacturer": F.upper("manufacturer"),
    })
    asked = [("vol", "volume_mm3", a) for a in ("sex", "race_wb", "age_bin")] + [("comp", "n_components", a) for a in ("sex", "race_wb", "age_bin")]
    asked += [("voxels", "n_voxels", "manufacturer"), ("vol_mm3", "volume_mm3", "manufacturer")]
    rows = []
    for name, measure, by in asked:
        for label in v.LABELS:
            kind = "kruskal" if by == "age_bin" else "mann_whitney"
            key = f"{name}_by_{by.removesuffix('_wb').removesuffix('_bin')}_{label}"
            rows.append(F.struct(F.lit(key).alias("stat_key"), F.lit(kind).alias("kind"), F.col(by).alias("grp"), F.col(f"{measure}_{label}").cast("double").alias("value")))
    return full.select(*keys, F.explode(F.array(*rows)).alias("_q")).select(*keys, "_q.*").filter("grp IS NOT NULL")


def segmentation_effects(table: DataFrame, exams: DataFrame, keys: list[str] | None = None, p_values: bool = True) -> DataFrame:
    """(keys, stat_key, test, statistic, effect, and p) of the sixteen tests."""
    key = [*(keys or []), "stat_key"]
    frame = test_frame(table, exams, keys)
    every = h.rank_sums(frame, [*key, "kind"])  # a question has one kind
    ranks = lambda kind: every.filter(F.col("kind") == kind).drop("kind")
    p = ["p"] if p_values else []
    two = h.mann_whitney(ranks("mann_whitney"), key, p_values).select(*key, F.lit("mann_whitney").alias("test"), F.col("u").alias("statistic"), F.col("rank_biserial").alias("effect"), *p)
    more = h.kruskal(ranks("kruskal"), key, p_values, least=2).select(*key, F.lit("kruskal").alias("test"), F.col("h").alias("statistic"), F.col("epsilon_squared").alias("effect"), *p)
    return two.unionByName(more)


def segmentation_tests(table: DataFrame, exams: DataFrame, keys: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """The sixteen tests with one false-discovery family for each of ``keys``."""
    out = h.benjamini_hochberg(segmentation_effects(table, exams, keys), keys or [])
    return out.withColumn("reject_h0", F.coalesce(F.col("p_fdr") < alpha, F.lit(False)))


def component_outliers(table: DataFrame, exams: DataFrame, most: int = MOST_COMPONENTS, case: str = "series_submitter_id") -> DataFrame:
    """Cases of which a label has more than ``most`` components, with their exams' attributes."""
    many = " OR ".join(f"n_components_{label} > {most}" for label in v.LABELS)
    attributes = ["sex", "race", "age_at_imaging", "manufacturer", "magnetic_field_strength"]
    return table.filter(many).join(exams, table["case_id"] == exams[case], "left").select("case_id", *[f"n_components_{label}" for label in v.LABELS], *attributes)


def segmentation_report(table: DataFrame, exams: DataFrame, case: str = "series_submitter_id") -> dict[str, DataFrame]:
    """histograms (40 bins), component histograms, outliers, means by manufacturer, tests."""
    table = cut(table, "segmentations")  # each report reads it
    sizes, parts = [c for c in columns() if not c.startswith("n_comp")], [c for c in columns() if c.startswith("n_comp")]
    full = table.join(exams, table["case_id"] == exams[case]).withColumn("manufacturer", F.upper("manufacturer"))
    long = s.unpivot(full, [f"n_voxels_{label}" for label in v.LABELS], ["manufacturer"])
    return {
        "histograms": s.histogram(table, sizes, 40),
        "components": s.integer_histogram(table, parts),
        "outliers": component_outliers(table, exams),
        "by_manufacturer": s.group_summary(long, ["manufacturer", "property"]),
        "tests": segmentation_tests(table, exams),
    }


#: What pools of cases are compared on: both labels' voxels, volumes and components, and the whole volume.
MORPHOLOGY = (*columns(), "volume_mm3_total")


def pool_tests(table: DataFrame, exams: DataFrame, pool: str = "annotation_quality", features: tuple[str, ...] = MORPHOLOGY, case: str = "series_submitter_id", p_values: bool = True) -> DataFrame:
    """Rank-sum tests of a segmentation table's features between two pools of exams: a row a feature, one family of tests.

    (feature, group_a, group_b, n_a, n_b, median_a, median_b, u, rank_biserial, magnitude, and p and p_fdr.)
    """
    whole = table.withColumn("volume_mm3_total", F.col("volume_mm3_vb") + F.col("volume_mm3_disc"))
    rows = whole.join(exams.select(F.col(case).alias("case_id"), F.col(pool).alias("grp")), "case_id").filter("grp IS NOT NULL")
    long = s.unpivot(rows, list(features), ["grp"]).withColumnRenamed("property", "feature")
    out = h.mann_whitney(h.rank_sums(long, ["feature"]), ["feature"], p_values)
    out = out.withColumn("magnitude", h.magnitude(F.col("rank_biserial"), "r"))
    return h.benjamini_hochberg(out, []) if p_values else out
