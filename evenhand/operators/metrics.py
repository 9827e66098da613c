"""Fairness metrics over the long table (ruler, score, grouping, grp, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.exprs import NAN, valid
from evenhand.operators.summaries import medians

KEY = ["ruler", "score", "grouping"]
# What counts as success, and the grids that probe the threshold
THRESHOLDS = {"dice": (0.8, True), "ndsc": (0.8, True), "hd95": (5.0, False)}
SWEEPS = {"dice": (0.7, 0.75, 0.8, 0.85, 0.9), "ndsc": (0.7, 0.75, 0.8, 0.85, 0.9), "hd95": (2.0, 5.0, 10.0)}
FOUR_FIFTHS = 0.8


def policy(spark: SparkSession, scores: list[str]) -> DataFrame:
    """(score, threshold, higher_is_better, sweep) by the score name's prefix; other prefixes follow 'dice'."""
    rows = []
    for s in scores:
        p = s.split("_")[0]
        rows.append((s, *THRESHOLDS.get(p, THRESHOLDS["dice"]), list(SWEEPS.get(p, SWEEPS["dice"]))))
    return spark.createDataFrame(rows, "score string, threshold double, higher_is_better boolean, sweep array<double>")


def score_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.split("_")[0] in THRESHOLDS]


def with_macro(df: DataFrame) -> DataFrame:
    """Add <metric>_macro, the mean of _vb and _disc, where both are there."""
    for m in THRESHOLDS:
        if {f"{m}_vb", f"{m}_disc"} <= set(df.columns):
            df = df.withColumn(f"{m}_macro", (F.col(f"{m}_vb") + F.col(f"{m}_disc")) / 2)
    return df


def to_long(df: DataFrame, scores: list[str]) -> DataFrame:
    """One row per score: adds score and value, drops the score columns."""
    pairs = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in scores])
    rest = [c for c in df.columns if c not in scores]
    return df.withColumn("_s", F.explode(pairs)).select(*rest, "_s.score", "_s.value")


def rates(long: DataFrame, rules: DataFrame, key: list[str] | None = None) -> DataFrame:
    """n_valid, n_success and rate per group; success is strictly beyond the threshold; rate is null without valid scores."""
    key = key or KEY
    df = long.join(F.broadcast(rules), "score")  # a row a score
    ok = valid(F.col("value"))
    good = F.when(F.col("higher_is_better"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    out = df.groupBy(*key, "threshold", "grp").agg(F.count(F.when(ok, 1)).alias("n_valid"), F.count(F.when(ok & good, 1)).alias("n_success"))
    return out.withColumn("rate", F.when(F.col("n_valid") > 0, F.col("n_success") / F.col("n_valid")))


def gaps(group_rates: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Disparate-impact ratio, parity difference, best and worst group (ties: the smaller name) of each key.

    A key none of whose groups has a valid score gets status 'no_valid_scores' and null figures.
    """
    key = [*(key or KEY), "threshold"]
    seen = F.col("rate").isNotNull()
    out = group_rates.groupBy(*key).agg(
        F.max("rate").alias("best_rate"),
        F.min("rate").alias("worst_rate"),
        F.min(F.when(seen, F.struct((-F.col("rate")).alias("r"), "grp")))["grp"].alias("best_group"),
        F.min(F.when(seen, F.struct(F.col("rate").alias("r"), "grp")))["grp"].alias("worst_group"),
        F.count("rate").alias("n_groups"),
        F.sum("n_valid").alias("n"),
        F.sum(F.col("n_valid") - F.col("n_success")).alias("n_fail"),
    )
    ratio = F.when(F.col("best_rate") == 0, F.lit(NAN)).when(F.col("best_rate") > 0, F.col("worst_rate") / F.col("best_rate"))
    out = out.withColumn("dir", ratio).withColumn("dpd", F.col("best_rate") - F.col("worst_rate"))
    out = out.withColumn("below_four_fifths", F.when(F.col("dir").isNull() | F.isnan("dir"), F.lit(False)).otherwise(F.col("dir") < FOUR_FIFTHS))
    return out.withColumn("status", F.when(F.col("n_groups") > 0, "ok").otherwise("no_valid_scores"))


def sweep(long: DataFrame, rules: DataFrame, suffix: str = "_macro") -> DataFrame:
    """Gaps of the macro scores at every threshold of their grids, in one pass."""
    grid = rules.filter(F.col("score").endswith(suffix)).select("score", F.explode("sweep").alias("threshold"), "higher_is_better")
    return gaps(rates(long, grid))


def mean_gaps(long: DataFrame, basis: str = "mean") -> DataFrame:
    """The earlier definition: ratio and difference of group means or medians of valid scores."""
    some = long.filter(valid(F.col("value")))
    if basis not in ("mean", "median"):
        raise ValueError(f"unknown basis: {basis}")
    per = some.groupBy(*KEY, "grp").agg(F.avg("value").alias("m")) if basis == "mean" else medians(some, [*KEY, "grp"], "value", "m")
    out = per.groupBy(*KEY).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    ratio = F.when(F.col("hi") == 0, F.lit(NAN)).otherwise(F.col("lo") / F.col("hi"))
    return out.select(*KEY, ratio.alias("dir"), (F.col("hi") - F.col("lo")).alias("dpd"))


def compare_rulers(gap: DataFrame, base: str, other: str) -> DataFrame:
    """Gaps of two rulers side by side and how far the ratio's gap widens, in percent; keyed by score and grouping."""
    a = gap.filter(F.col("ruler") == base).select("score", "grouping", F.col("dir").alias("dir_base"), F.col("dpd").alias("dpd_base"))
    b = gap.filter(F.col("ruler") == other).select("score", "grouping", F.col("dir").alias("dir_other"), F.col("dpd").alias("dpd_other"))
    out = a.join(b, ["score", "grouping"], "full")
    ga, gb = 1 - F.col("dir_base"), 1 - F.col("dir_other")
    wide = F.when((ga == 0) & (gb == 0), 0.0).when(ga == 0, F.lit(float("inf"))).otherwise((gb - ga) / ga * 100)
    out = out.withColumn("widening_pct", wide)
    kind = F.when(F.col("widening_pct") > 0, "wider").when(F.col("widening_pct") < 0, "narrower").otherwise("unchanged")
    return out.withColumn("direction", F.when(F.col("widening_pct").isNull(), None).otherwise(kind))
