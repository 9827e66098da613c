"""Rank and contingency tests, effect sizes, false-discovery correction; ranks come from frequency tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evenhand.functions import special
from evenhand.functions.exprs import NAN, valid
from evenhand.functions.ranks import counted, positions, rank_in_runs, value_run
from evenhand.operators.summaries import middle
from evenhand.sources.scratch import cut


def rank_sums(df: DataFrame, key: list[str], grp: str = "grp", value: str = "value") -> DataFrame:
    """Per key and group: n, rank_sum (midranks over the key), median; and the key's total, ties = sum(t^3 - t), k groups, and whether all values are ``alike``.

    Only values that are valid count. Rows are counted by (key, group, value) into one table, from which ranks, medians
    and sums all come without a join.
    """
    f = positions(counted(df.filter(valid(F.col(value))), [*key, grp], value), key, [grp], value)
    t, same = F.col("t").cast("double"), F.col("same").cast("double")
    out = f.groupBy(*key, grp, "n").agg(
        F.sum(t * (F.col("below") + (same + 1) / 2)).alias("rank_sum"), middle(value).alias("median"),
        F.sum(t * (same * same - 1)).alias("_ties"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
    )
    w = Window.partitionBy(*key)  # a row a group
    whole = {"total": F.sum("n").over(w), "ties": F.sum("_ties").over(w), "k": F.count(F.lit(1)).over(w), "alike": F.min("_lo").over(w) == F.max("_hi").over(w)}
    return out.withColumns(whole).select(*key, grp, "n", "rank_sum", "median", "total", "ties", "k", "alike")


@F.pandas_udf(DoubleType())
def _mwu_p(u: pd.Series, na: pd.Series, nb: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([special.mwu_p(*x) for x in zip(u, na.astype(int), nb.astype(int), ties, strict=True)])


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([special.chi2_sf(a, int(d)) if d > 0 else float("nan") for a, d in zip(x, dof, strict=True)])


@F.pandas_udf(DoubleType())
def _z_p(z: pd.Series) -> pd.Series:
    return pd.Series([2 * special.norm_sf(abs(a)) for a in z])


def mann_whitney(ranks: DataFrame, key: list[str], p_values: bool = True) -> DataFrame:
    """Keys with two groups: U of the first by name, rank-biserial effect, medians, sizes, two-sided p."""
    two = ranks.filter("k = 2").withColumn("_g", F.struct("grp", "n", "rank_sum", "median"))
    d = two.groupBy(*key, "total", "alike", "ties").agg(F.min("_g").alias("a"), F.max("_g").alias("b"))
    na, nb = F.col("a.n"), F.col("b.n")
    same = F.col("alike")
    u = F.col("a.rank_sum") - na * (na + 1) / 2
    out = d.select(
        *key, "ties", same.alias("_same"), F.col("a.grp").alias("group_a"), F.col("b.grp").alias("group_b"), na.alias("n_a"), nb.alias("n_b"),
        F.col("a.median").alias("median_a"), F.col("b.median").alias("median_b"),
        F.when(same, F.lit(NAN)).otherwise(u).alias("u"), F.when(same, 0.0).otherwise(1 - 2 * u / (na * nb)).alias("rank_biserial"),
    )
    if p_values:
        out = out.withColumn("p", F.when(F.col("_same"), 1.0).otherwise(_mwu_p("u", "n_a", "n_b", "ties")))
    return out.drop("ties", "_same")


def kruskal(ranks: DataFrame, key: list[str], p_values: bool = True, least: int = 3) -> DataFrame:
    """Keys with three groups or more: H with tie correction, epsilon squared, p."""
    d = ranks.filter(F.col("k") >= least).groupBy(*key, "total", "alike", "ties", "k").agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    n, k = F.col("total").cast("double"), F.col("k")
    same = F.col("alike")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, F.lit(3.0)) - n))
    d = d.withColumn("h", F.when(same, F.lit(NAN)).otherwise(h))
    out = d.select(*key, "k", F.col("total").alias("n"), "h", F.when(same, 0.0).otherwise((F.col("h") - k + 1) / (n - k)).alias("epsilon_squared"))
    if p_values:
        out = out.withColumn("p", F.when(F.isnan("h"), 1.0).otherwise(_chi2_p("h", F.col("k") - 1)))
    return out


def dunn(ranks: DataFrame, key: list[str], omnibus: DataFrame | None = None, alpha: float = 0.05, p_values: bool = True) -> DataFrame:
    """Pairs of groups of each key: z of the difference of mean ranks; p times the number of pairs, at most 1.

    With ``omnibus`` (the result of kruskal) only keys with p below ``alpha`` are compared.
    """
    r = ranks.filter("k >= 3 AND NOT alike")
    if omnibus is not None:
        r = r.join(omnibus.filter(F.col("p") < alpha).select(*key), key, "left_semi")
    group = F.struct("grp", "n", (F.col("rank_sum") / F.col("n")).alias("r"))
    every = r.groupBy(*key, "total", "ties", "k").agg(F.sort_array(F.collect_list(group)).alias("g"))  # as many as pairs are of
    ab = every.withColumn("a", F.explode("g")).withColumn("b", F.explode("g")).filter("a.grp < b.grp")
    n = F.col("total").cast("double")
    var = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("a.n") + 1 / F.col("b.n"))
    out = ab.select(
        *key, F.col("a.grp").alias("group_a"), F.col("b.grp").alias("group_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), "k",
        ((F.col("a.r") - F.col("b.r")) / F.sqrt(var)).alias("z"),
    )
    if p_values:
        out = out.withColumn("p_bonferroni", F.least(F.lit(1.0), _z_p("z") * F.col("k") * (F.col("k") - 1) / 2))
    return out.drop("k")


def chi_squared(cells: DataFrame, key: list[str], p_values: bool = True) -> DataFrame:
    """Independence of (row, col) counts n per key, Yates-corrected at one degree of freedom, with Cramér's V.

    Zero cells may be missing: what they add is their expected counts, the total less those of the cells that are there,
    so rows and columns are never crossed. In a two by two table all four cells are equally far from what is expected. A key
    with one row or one column gets NaN.
    """
    cells = cut(cells.groupBy(*key, "row", "col").agg(F.sum("n").alias("n")).filter("n > 0"), "cells")
    rows = cells.groupBy(*key, "row").agg(F.sum("n").alias("rn"))
    cols = cells.groupBy(*key, "col").agg(F.sum("n").alias("cn"))
    size = rows.groupBy(*key).agg(F.sum("rn").alias("total"), F.count(F.lit(1)).alias("r"), F.sum(1 / F.col("rn")).alias("inv_r"))
    size = size.join(cols.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.col("cn")).alias("inv_c")), key)
    met = cells.join(rows, [*key, "row"]).join(cols, [*key, "col"]).join(size, key)
    e = F.col("rn") * F.col("cn") / F.col("total")
    off = F.col("n") - e
    out = met.groupBy(*key, "total", "r", "c", "inv_r", "inv_c").agg(F.sum(off * off / e).alias("seen"), F.sum(e).alias("expected"), F.max(F.abs(off)).alias("off"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    least = F.least("r", "c") - 1
    yates = F.pow(F.col("off") - F.least(F.lit(0.5), F.col("off")), 2) * F.col("total") * F.col("inv_r") * F.col("inv_c")
    x = F.when(dof == 1, yates).otherwise(F.col("seen") + F.col("total") - F.col("expected"))
    out = out.select(
        *key, F.col("total").alias("n"), dof.alias("dof"), F.when(dof > 0, x).otherwise(F.lit(NAN)).alias("chi2"),
        F.when(dof > 0, F.sqrt(x / (F.col("total") * least))).otherwise(F.lit(NAN)).alias("cramers_v"),
    )
    return out.withColumn("p", _chi2_p("chi2", "dof")) if p_values else out


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p", to: str = "p_fdr", large: bool = False) -> DataFrame:
    """Adjusted p within each family: the running minimum of p * n / rank from the largest p down, at most 1. Null and NaN p stay out.

    Families are sorted in one task each, as they are the results of tests. ``large`` families (p-values of rows) are cut
    into runs of near values instead; ``df`` is then computed several times, so it should be a table.
    """
    ok = valid(F.col(p))
    if not large:
        up = Window.partitionBy(*family, ok).orderBy(p)
        ranked = df.withColumn("_rank", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*family, ok)))
        down = Window.partitionBy(*family, ok).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
        q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down))
        return ranked.withColumn(to, F.when(ok, q)).drop("_rank", "_n")
    part = F.when(ok, value_run(F.col(p))).otherwise(-1)  # runs of near values, finer towards 0
    keys = [*family, "_ok", "_part"]
    ranked = rank_in_runs(df.withColumns({"_ok": ok, "_part": part}), [*family, "_ok"], F.col("_part"), [F.col(p)], "_rank")
    sizes = df.withColumn("_ok", ok).groupBy(*family, "_ok").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate([*family, "_ok"])], "_n")
    same = lambda other, mark, names: reduce(lambda x, y: x & y, [ranked[c].eqNullSafe(other[f"{mark}{i}"]) for i, c in enumerate(names)])
    ranked = ranked.join(sizes, same(sizes, "_s", [*family, "_ok"])).withColumn("_q", F.col(p) * F.col("_n") / F.col("_rank"))
    least = ranked.groupBy(*keys).agg(F.min("_q").alias("_least"))
    later = Window.partitionBy(*family, "_ok").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    least = least.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(keys)], F.min("_least").over(later).alias("_later"))
    down = Window.partitionBy(*keys).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("_own", F.min("_q").over(down))
    out = out.join(least, reduce(lambda x, y: x & y, [out[c].eqNullSafe(least[f"_l{i}"]) for i, c in enumerate(keys)]))
    q = F.least(F.lit(1.0), F.col("_own"), F.col("_later"))
    return out.select(*df.columns, F.when(ok, q).alias(to))


def magnitude(effect: Column, kind: str) -> Column:
    """negligible, small, medium or large. Fixed bands: .1/.3/.5 for correlations and V, .01/.06/.14 for epsilon squared."""
    a, b, c = (0.01, 0.06, 0.14) if kind == "epsilon_squared" else (0.1, 0.3, 0.5)
    e = F.abs(effect)
    return F.when(e < a, "negligible").when(e < b, "small").when(e < c, "medium").when(e >= c, "large")


def auroc(df: DataFrame, key: list[str], label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve from midranks; NaN where only one class is there."""
    r = rank_sums(df.withColumn("grp", F.when(F.col(label), "1").otherwise("0")).withColumn("value", F.col(score).cast("double")), key)
    pos = F.sum(F.when(F.col("grp") == "1", F.col("n")))
    out = r.groupBy(*key, "total").agg(pos.alias("n_pos"), F.sum(F.when(F.col("grp") == "1", F.col("rank_sum"))).alias("rs"))
    p, n = F.coalesce("n_pos", F.lit(0)), F.col("total") - F.coalesce("n_pos", F.lit(0))
    return out.select(*key, p.alias("n_pos"), n.alias("n_neg"), F.when((p > 0) & (n > 0), (F.col("rs") - p * (p + 1) / 2) / (p * n)).otherwise(F.lit(NAN)).alias("auroc"))


def balanced_accuracy(df: DataFrame, key: list[str], label: str, predicted: str) -> DataFrame:
    """Mean recall over the classes of ``label``."""
    recall = df.groupBy(*key, label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.groupBy(*key).agg(F.avg("recall").alias("balanced_accuracy"), F.count(F.lit(1)).alias("n_classes"))
