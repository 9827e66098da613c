"""Validation against a specification, exclusions, ledgers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """What a table must hold. Columns that it does not name are allowed."""

    types: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    allowed: dict[str, tuple] = field(default_factory=dict)
    positive: tuple[str, ...] = ()


# What the exam table may hold
EXAM_SPEC = Spec(
    types={"series_submitter_id": "bigint", "patient_id": "bigint", "age_at_imaging": "double", "magnetic_field_strength": "double"},
    required=("series_submitter_id", "patient_id", "sex", "race", "ethnicity", "manufacturer"),
    unique=("series_submitter_id",),
    allowed={
        "sex": ("Female", "Male"),
        "race": (
            "White", "Black or African American", "Asian", "American Indian or Alaska Native",
            "Native Hawaiian or other Pacific Islander", "Other", "Not Reported",
        ),
        "ethnicity": ("Hispanic or Latino", "Not Hispanic or Latino", "Not Reported"),
        "manufacturer": ("GE MEDICAL SYSTEMS", "SIEMENS"),
    },
)
VOLUME_SPEC = Spec(
    required=("case_id", "nx", "ny", "nz", "sx", "sy", "sz"), unique=("case_id",), positive=("nx", "ny", "nz", "sx", "sy", "sz")
)
SEGMENTATION_SPEC = Spec(required=("case_id", "n_voxels_vb", "n_voxels_disc", "volume_mm3_vb", "volume_mm3_disc", "n_components_vb", "n_components_disc"), unique=("case_id",))


def validate(df: DataFrame, spec: Spec) -> DataFrame:
    """Violations: (rule, column, n, sample), one row for each broken rule; none, if the table is sound."""
    spark = df.sparkSession
    missing = [c for c in dict.fromkeys([*spec.types, *spec.required, *spec.unique, *spec.allowed, *spec.positive]) if c not in df.columns]
    wrong = [(c, k) for c, k in spec.types.items() if c in df.columns and df.schema[c].dataType.simpleString() != k]
    static = [("missing_column", c, 1, None) for c in missing] + [("type", c, 1, k) for c, k in wrong]
    out = spark.createDataFrame(static, "rule string, column string, n long, sample string")
    rules = [("required", c, F.col(c).isNull()) for c in spec.required if c not in missing]
    rules += [("allowed", c, F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in spec.allowed.items() if c not in missing]
    rules += [("positive", c, F.col(c) <= 0) for c in spec.positive if c not in missing]
    if rules:  # one pass for all row rules
        hits = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for r, c, bad in rules])
        found = df.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
        out = out.unionByName(found.groupBy("h.rule", "h.column").agg(F.count(F.lit(1)).alias("n"), F.min("h.value").alias("sample")))
    for c in spec.unique:
        if c not in missing:
            twice = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            row = twice.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(c).cast("string")).alias("sample")).filter("n > 0")
            out = out.unionByName(row.select(F.lit("unique").alias("rule"), F.lit(c).alias("column"), "n", "sample"))
    return out


@dataclass(frozen=True)
class Range:
    """A rule about a number: an expression over a row, and the ends that are allowed (None: open)."""

    rule: str
    expression: str
    low: float | None = None
    high: float | None = None
    severity: str = "warning"


#: Rules that a table of them may have at most: each is an expression of the one pass.
MOST_RULES = 1000


def range_rules(table: DataFrame) -> list[Range]:
    """Rules from a table (rule, expression, low, high, severity), such as a CSV file has."""
    rows = table.select("rule", "expression", F.col("low").cast("double"), F.col("high").cast("double"), "severity").orderBy("rule").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Range(*r) for r in rows]


def broken_rules(df: DataFrame, key: str, rules: list[Range]) -> DataFrame:
    """(key, rule, severity, value, bound, limit): one row for each rule that a row breaks, all rules in one pass.

    ``bound`` is 'low' or 'high', or 'nan'; a null value breaks nothing (``validate`` has required columns).
    """
    def judged(r: Range) -> Column:
        value = F.expr(r.expression).cast("double")
        bound = F.when(F.isnan(value), "nan")
        if r.low is not None:
            bound = bound.when(value < r.low, "low")
        if r.high is not None:
            bound = bound.when(value > r.high, "high")
        limit = F.when(bound == "low", F.lit(r.low).cast("double")).when(bound == "high", F.lit(r.high).cast("double"))
        found = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), value.alias("value"), bound.alias("bound"), limit.alias("limit"))
        return F.when(value.isNotNull() & bound.isNotNull(), found)

    if not rules:
        raise ValueError("no rules")
    hits = F.filter(F.array(*[judged(r) for r in rules]), lambda h: h.isNotNull())
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.*")


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def exclude(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not on the list; null keys stay."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def ledger(df: DataFrame, status: str = "status") -> DataFrame:
    """Items and share by status."""
    n = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all")).withColumn("_k", F.lit(1))
    return n.withColumn("_k", F.lit(1)).join(total, "_k").select(status, "n", F.round(100.0 * F.col("n") / F.col("_all"), 1).alias("pct"))
