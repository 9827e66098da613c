"""The audit: every ruler, score and grouping in one long table, and what is computed from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.exprs import valid
from evenhand.functions.ranks import positions

from evenhand.operators import grouping as g
from evenhand.operators import hypothesis as h
from evenhand.operators import metrics as m
from evenhand.operators import regress, resample, summaries
from evenhand.sources.scratch import cut
from evenhand.sources.tables import materialize, missing_paths


ATTRIBUTES = ["sex", "race", "ethnicity", "age_at_imaging"]


def long_table(scores: DataFrame, exams: DataFrame, case: str = "series_submitter_id", ruler: str = "ruler") -> DataFrame:
    """(ruler, grouping, grp, score, value): scores meet attributes, then groupings and scores are laid out in rows.

    The median age is that of the joined rows of a ruler; groupings of a ruler that have fewer than two groups drop out.
    """
    wide = m.with_macro(scores)
    names = m.score_columns(wide)
    joined = cut(wide.select(case, F.col(ruler).alias("ruler"), *names).join(exams.select(case, *ATTRIBUTES), case).drop(case), "joined")
    grouped = g.explode_groups(g.with_median_age(joined, ["ruler"]))
    grouped = g.comparable(grouped.select("ruler", "grouping", "grp", *names), ["ruler", "grouping"])
    return m.to_long(grouped, names)


def rates_of(scores: DataFrame, exams: DataFrame, rules: list[tuple[str, float, bool]], case: str = "series_submitter_id", ruler: str = "ruler") -> DataFrame:
    """``metrics.rates`` of the long table, without it: rows are counted by their attributes first, in one pass over all scores.

    ``rules`` has (score, threshold, higher_is_better). Groupings are laid out on the counts, of which there are as
    many as combinations of attributes, and the median age of a ruler comes from them too.
    """
    wide = m.with_macro(scores)
    joined = wide.select(case, F.col(ruler).alias("ruler"), *m.score_columns(wide)).join(exams, case)
    counts = []
    for i, (score, threshold, higher) in enumerate(rules):
        value = F.col(score).cast("double")
        ok = valid(value)
        good = value > threshold if higher else value < threshold
        counts += [F.count(F.when(ok, 1)).alias(f"_v{i}"), F.count(F.when(ok & good, 1)).alias(f"_s{i}")]
    cells = cut(joined.groupBy("ruler", *ATTRIBUTES).agg(F.count(F.lit(1)).alias("t"), *counts), "cells")
    ages = cells.filter("age_at_imaging IS NOT NULL").groupBy("ruler", F.col("age_at_imaging").alias("age")).agg(F.sum("t").alias("t"))
    ages = positions(ages, ["ruler"], [], "age").groupBy("ruler").agg(summaries.middle("age").alias("age_median"))
    cells = cells.join(ages, "ruler", "left")
    names = [f"_{x}{i}" for i in range(len(rules)) for x in "vs"]
    groups = g.explode_groups(cells).groupBy("ruler", "grouping", "grp").agg(*[F.sum(c).alias(c) for c in names])
    groups = g.comparable(groups, ["ruler", "grouping"])
    laid = [F.struct(F.lit(s).alias("score"), F.lit(float(t)).alias("threshold"), F.col(f"_v{i}").alias("n_valid"), F.col(f"_s{i}").alias("n_success")) for i, (s, t, _) in enumerate(rules)]
    out = groups.select("ruler", "grouping", "grp", F.explode(F.array(*laid)).alias("_r"))
    out = out.select("ruler", "_r.score", "grouping", "_r.threshold", "grp", "_r.n_valid", "_r.n_success")
    return out.withColumn("rate", F.when(F.col("n_valid") > 0, F.col("n_success") / F.col("n_valid")))


def rules_list(scores: list[str], sweep: bool = False) -> list[tuple[str, float, bool]]:
    """(score, threshold, higher_is_better) of each score, or of every threshold of the macro scores' sweeps."""
    out = []
    for s in scores:
        prefix = s.split("_")[0] if s.split("_")[0] in m.THRESHOLDS else "dice"
        threshold, higher = m.THRESHOLDS[prefix]
        if not sweep:
            out.append((s, threshold, higher))
        elif s.endswith("_macro"):
            out += [(s, t, higher) for t in m.SWEEPS[prefix]]
    return out


def rules_of(long: DataFrame, scores: list[str]) -> DataFrame:
    return m.policy(long.sparkSession, scores)


SCORES = ["dice_vb", "dice_disc", "hd95_vb", "hd95_disc", "dice_macro", "hd95_macro"]


@dataclass(frozen=True)
class Tables:
    """What audits start from: the long table, and its rank sums."""

    long: DataFrame
    ranks: DataFrame


def prepare(scores: DataFrame, exams: DataFrame, folder: str | None = None) -> Tables:
    """The long table and its rank sums, each built once: as Parquet below ``folder``, or else in the scratch folder."""
    spark = scores.sparkSession

    def once(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return cut(df, name)
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    long = once(long_table(scores, exams), "long")
    return Tables(long, once(h.rank_sums(long, m.KEY), "ranks"))


def audit(
    scores: DataFrame, exams: DataFrame, n_boot: int = 10_000, n_perm: int = 10_000, seed: int = 42, base: str = "gold", other: str = "silver",
    folder: str | None = None, covariates: tuple[str, ...] = ("sex", "race", "age_at_imaging", "manufacturer"),
) -> dict[str, DataFrame]:
    """All tables of an audit by name: summary, rates, gaps, sweep, tests, posthoc, significance, bootstrap, permutation, comparison, regression.

    The long table and the rank sums are built once (see ``prepare``); rates come from counts of attribute
    combinations, and resampling draws from the rates, never from cases. A combination that has no valid scores keeps a
    row with its status and does not stop the others. ``comparison`` is there where both rulers are; ``regression``
    has a least-squares table for each ruler and macro score.
    """
    names = m.score_columns(m.with_macro(scores))
    made = prepare(scores, exams, folder)
    rates = cut(rates_of(scores, exams, rules_list(names)), "rates")  # a row a group
    gap = m.gaps(rates)
    tests = h.benjamini_hochberg(all_tests(made.ranks, m.KEY), ["ruler"])
    out = {
        "summary": summaries.group_summary(made.long, [*m.KEY, "grp"]),
        "rates": rates,
        "gaps": gap,
        "sweep": m.gaps(rates_of(scores, exams, rules_list(names, sweep=True))),
        "tests": tests,
        "posthoc": h.dunn(made.ranks, m.KEY, h.kruskal(made.ranks, m.KEY)),
        "significance": significant(tests, ["ruler"]),
        "bootstrap": resample.bootstrap(rates, m.KEY, n_boot, seed=seed),
        "permutation": resample.permutation(rates, m.KEY, n_perm, seed=seed),
        "regression": regressions(scores, exams, covariates),
    }
    rulers = {r[0] for r in rates.select("ruler").distinct().collect()}
    if {base, other} <= rulers:
        out["comparison"] = m.compare_rulers(gap, base, other)
    return out


def regressions(scores: DataFrame, exams: DataFrame, covariates: tuple[str, ...], case: str = "series_submitter_id") -> DataFrame:
    """(ruler, score, term, coef, ...) of each ruler's macro scores on the covariates. Scores meet attributes once, in a table that every fit scans."""
    wide = m.with_macro(scores)
    names = [c for c in wide.columns if c.endswith("_macro")]
    joined = cut(wide.join(exams, case).select("ruler", *names, *covariates), "joined")
    rulers = joined.select("ruler").distinct().orderBy("ruler").collect() or wide.select("ruler").distinct().orderBy("ruler").collect()
    out = None
    for (ruler,) in rulers:
        rows = joined.filter(F.col("ruler") == ruler)
        for score in names:
            finite = rows.filter(F.abs(score) < float("inf"))
            one = regress.ols(finite, score, list(covariates)).select(F.lit(ruler).alias("ruler"), F.lit(score).alias("score"), "*")
            out = one if out is None else out.unionByName(one)
    return out


# The rulers that the audit's stages compare; comparison needs the names 'gold' and 'silver'
STAGES = {
    "global": ("global",),
    "biased_ruler": ("gold", "silver"),
    "biased_ruler_v2": ("gold", "silver"),
    "bias_amplification": ("mixed", "gold_trained", "silver_trained"),
}


def run_stage(spark, stage: str, inputs: dict[str, str], evaluate: Callable[[str], DataFrame], exams: DataFrame, folder: str, **options) -> dict[str, DataFrame] | None:
    """The audit of a stage, or None where an input is missing.

    ``inputs`` has a path for each of the stage's rulers; each ruler's case scores are what ``evaluate(path)`` gives,
    unless an earlier run has left them in ``folder``.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    if missing_paths(spark, [inputs.get(r) for r in STAGES[stage]]):
        return None
    parts = [
        materialize(spark, lambda p=inputs[r]: evaluate(p), f"{folder}/scores-{stage}-{r}").withColumn("ruler", F.lit(r)) for r in STAGES[stage]
    ]
    scores = reduce(DataFrame.unionByName, parts)
    return audit(scores, exams, folder=f"{folder}/{stage}", **options)


def forest(intervals: DataFrame, metric: str = "dir") -> DataFrame:
    """Rows of a forest chart: point and error lengths of each combination, whether the four-fifths line is inside, lowest point first."""
    rows = intervals.filter(F.col("metric") == metric)
    at = F.row_number().over(Window.partitionBy("ruler").orderBy("point", "score", "grouping"))  # a row a combination
    inside = (F.col("ci_lo") <= m.FOUR_FIFTHS) & (F.col("ci_hi") >= m.FOUR_FIFTHS)
    return rows.select(*m.KEY, "point", (F.col("point") - F.col("ci_lo")).alias("err_lo"), (F.col("ci_hi") - F.col("point")).alias("err_hi"), inside.alias("crosses"), at.alias("place"))


def bars(gap: DataFrame) -> DataFrame:
    """Rows of bar charts of the ratio by grouping, one bar a ruler: offset of the bar within its group, and its colour class."""
    rulers = gap.select("ruler").distinct()
    at = rulers.withColumn("i", F.row_number().over(Window.orderBy("ruler")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))  # a row a ruler
    rows = gap.join(F.broadcast(at), "ruler")
    offset = (F.col("i") - F.col("k") / 2 + 0.5) * (0.8 / F.col("k"))
    return rows.select(*m.KEY, "dir", F.round(offset, 6).alias("offset"), F.when(F.col("below_four_fifths"), "below").otherwise("above").alias("side"))


def all_tests(ranks: DataFrame, key: list[str]) -> DataFrame:
    """(key, test, statistic, effect, effect_name, p): rank-sum tests for two groups, Kruskal-Wallis for more."""
    two = h.mann_whitney(ranks, key).select(*key, F.lit("mann_whitney").alias("test"), F.col("u").alias("statistic"), F.col("rank_biserial").alias("effect"), F.lit("rank_biserial").alias("effect_name"), "p")
    more = h.kruskal(ranks, key).select(*key, F.lit("kruskal").alias("test"), F.col("h").alias("statistic"), F.col("epsilon_squared").alias("effect"), F.lit("epsilon_squared").alias("effect_name"), "p")
    return two.unionByName(more)


def significant(tests: DataFrame, family: list[str], alpha: float = 0.05) -> DataFrame:
    """Tests and how many have p_fdr below ``alpha``, per family."""
    return tests.groupBy(*family).agg(F.count(F.lit(1)).alias("n_tests"), F.count(F.when(F.col("p_fdr") < alpha, 1)).alias("n_significant"))
