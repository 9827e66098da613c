"""Order statistics of groups from frequency tables: intervals of median differences, Kolmogorov-Smirnov, permuted AUROC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evenhand.functions import special
from evenhand.functions.exprs import valid
from evenhand.functions.ranks import counted, positions
from evenhand.operators.hypothesis import auroc
from evenhand.operators.resample import _seed, bca
from evenhand.sources.scratch import cut

#: Buckets that the places of a group are cut into, where values are looked up by place.
PLACES = 1024
#: What a metric makes of the groups' medians, in the order of the groups' names, along the last axis.
METRICS = {
    "difference": lambda m: m[..., 0] - m[..., 1],
    "gap": lambda m: m.max(axis=-1) - m.min(axis=-1),
    "ratio": lambda m: np.divide(m.min(axis=-1), m.max(axis=-1), out=np.full(m.shape[:-1], np.nan), where=m.max(axis=-1) != 0),
}
#: Draws of a task's array at most, in the permutation of AUROC.
DRAWN = 1 << 24


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def middle_places(n: int, reps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0) of the two middle values of ``reps`` samples of n, drawn with replacement from n sorted values.

    The kth of n uniform numbers is Beta(k, n + 1 - k), and the next one the least of the n - k that are above it; a uniform
    number u stands for the value at place floor(u * n). So a resampled median costs as much for ten values as for 10^9.
    """
    k = (n - 1) // 2
    low = rng.beta(k + 1, n - k, reps)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k - 1, reps)
    at = lambda u: np.minimum((u * n).astype(np.int64), n - 1)
    return at(low), at(high)


def left_out_places(n: int) -> list[tuple[int, int, int]]:
    """(how many, place, place): the two middle places of n sorted values once one is left out, by which one."""
    m = n // 2
    if n < 2:
        return []
    return [(m, m, m + 1), (1, m - 1, m + 1), (m, m - 1, m)] if n % 2 else [(m, m, m), (m, m - 1, m - 1)]


def median_bootstrap(
    df: DataFrame, key: list[str], grp: str = "grp", value: str = "value", metric: str = "difference", n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42,
) -> DataFrame:
    """BCa interval of a metric of the groups' medians: (key, metric, point, ci_lo, ci_hi, method, n_boot).

    The resampling is exact, not a sample of rows: the places of a resample's middle values are drawn (see
    ``middle_places``), and values are looked up by place in the frequency table. Leaving one case out moves a group's
    median to one of three values, so the acceleration is exact too. ``difference`` is of keys with two groups, first
    minus second by name. Null and NaN values are left out; draws depend on (seed, key, group) only.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    both = [*key, grp]
    f = cut(positions(counted(df.filter(valid(F.col(value)) & F.col(grp).isNotNull()), both, value), both, [], value), "places")
    sizes = f.groupBy(*both).agg(F.first("n").alias("n"))  # a row a group
    if metric == "difference":
        sizes = sizes.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter("_k = 2").drop("_k")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [middle_places(int(r["n"]), n_boot, np.random.default_rng(_seed(seed, *[r[k] for k in both]))) for _, r in b.iterrows()]
            yield b.assign(lo=[x[0] for x in got], hi=[x[1] for x in got])

    draws = cut(sizes.mapInPandas(draw, f"{_fields(sizes, both)}, n long, lo array<long>, hi array<long>"), "draws")
    n = F.col("n")
    beside = F.filter(F.array(*[F.floor(n / 2) + d for d in (-1, 0, 1)]), lambda p: (p >= 0) & (p < n))
    need = draws.select(*both, "n", F.explode(F.array_distinct(F.concat("lo", "hi", beside))).alias("place"))
    width = F.greatest(F.lit(1), F.ceil(n / PLACES))
    need = need.withColumn("_bucket", F.floor(F.col("place") / width))
    spread = f.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("t") - 1) / width))))
    spread = spread.select(*both, "_bucket", "before", (F.col("before") + F.col("t")).alias("_after"), F.col(value).cast("double").alias("_value"))
    found = need.join(spread, [*both, "_bucket"]).filter("before <= place AND place < _after")
    found = found.groupBy(*both).agg(F.sort_array(F.collect_list(F.struct("place", "_value"))).alias("f"))  # 2 n_boot + 3 a group
    found = found.select(*both, F.transform("f", lambda x: x["place"]).alias("places"), F.transform("f", lambda x: x["_value"]).alias("values"))
    combine, name = METRICS[metric], metric

    def interval(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(grp)
        at = [lambda p, r=r: np.asarray(r["values"], float)[np.searchsorted(r["places"], p)] for _, r in table.iterrows()]
        reps = np.stack([(v(np.asarray(r["lo"])) + v(np.asarray(r["hi"]))) / 2 for v, (_, r) in zip(at, table.iterrows(), strict=True)], axis=-1)
        count = table["n"].tolist()
        point = np.array([(v((c - 1) // 2) + v(c // 2)) / 2 for v, c in zip(at, count, strict=True)], float)
        jack, weight = [], []
        for g, (v, c) in enumerate(zip(at, count, strict=True)):
            for times, p, q in left_out_places(c):
                own = point.copy()
                own[g] = (v(p) + v(q)) / 2
                jack.append(float(combine(own)))
                weight.append(float(times))
        value_ = float(combine(point))
        lo, hi, how = bca(value_, combine(reps), np.array(jack), np.array(weight), alpha) if jack else (float("nan"), float("nan"), "percentile")
        return pd.DataFrame([(*[table[k].iloc[0] for k in key], name, value_, lo, hi, how, n_boot)], columns=[*key, "metric", "point", "ci_lo", "ci_hi", "method", "n_boot"])

    schema = f"{_fields(draws, key)}, metric string, point double, ci_lo double, ci_hi double, method string, n_boot long"
    return draws.join(found, both).groupBy(*key).applyInPandas(interval, schema)


@F.pandas_udf(DoubleType())
def _ks_p(d: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series([special.ks_p(float(x), int(a), int(b)) for x, a, b in zip(d, na, nb, strict=True)], dtype=float)


def ks_two_sample(df: DataFrame, key: list[str], grp: str = "grp", value: str = "value", p_values: bool = True) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of the keys with two groups: (key, group_a, group_b, n_a, n_b, d, p).

    d is the greatest distance of the two distribution functions: at each value that stands somewhere, both are sums
    of counts that its place tells. p is exact up to 10,000 values a group, else from the limit. Null and NaN values are left out.
    """
    f = positions(counted(df.filter(valid(F.col(value)) & F.col(grp).isNotNull()), [*key, grp], value), key, [grp], value)
    own = F.col("before") + F.col("t")
    per = cut(f.groupBy(*key, grp, "n").agg(F.count(F.lit(1)).alias("_rows")), "sizes")  # a row a group
    pairs = per.groupBy(*key).agg(F.min(F.struct(grp, "n")).alias("a"), F.max(F.struct(grp, "n")).alias("b"), F.count(F.lit(1)).alias("k")).filter("k = 2")
    rows = f.join(pairs, key)
    other = F.when(F.col(grp) == F.col(f"a.{grp}"), F.col("b.n")).otherwise(F.col("a.n"))
    apart = F.abs(own / F.col("n") - (F.col("below") + F.col("same") - own) / other)
    out = rows.groupBy(*key, F.col(f"a.{grp}").alias("group_a"), F.col(f"b.{grp}").alias("group_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).agg(F.max(apart).alias("d"))
    return out.withColumn("p", _ks_p("d", "n_a", "n_b")) if p_values else out


def holm(df: DataFrame, family: list[str], p: str = "p", to: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment within each family of tests: the running maximum of p times the number of tests not yet passed, at most 1. Null and NaN stay out."""
    ok = valid(F.col(p))
    up = Window.partitionBy(*family, ok).orderBy(p)  # a row a test
    left = F.count(F.lit(1)).over(Window.partitionBy(*family, ok)) - F.row_number().over(up) + 1
    ranked = df.withColumn("_q", F.col(p) * left)
    grown = F.max("_q").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(to, F.when(ok, F.least(F.lit(1.0), grown))).drop("_q")


def auroc_permutation(df: DataFrame, key: list[str], label: str, score: str, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """Permutation test of AUROC: (key, auroc, p, null_mean, null_std, n_perm), with labels shuffled over the scores.

    Under shuffled labels, the positives of each block of tied scores are a multivariate hypergeometric draw, and AUROC
    follows from their sum of midranks. Blocks are dealt to runs of about the square root of the cases: first each
    replicate's positives are drawn for each run, then, in the run's own task, for its blocks. Cases are never shuffled.
    """
    rows = df.filter(valid(F.col(score)) & F.col(label).isNotNull()).select(*key, F.col(label).cast("boolean").alias("_y"), F.col(score).cast("double").alias("_s"))
    f = positions(counted(rows, [*key, "_y"], "_s"), key, ["_y"], "_s")
    blocks = cut(f.groupBy(*key, "_s", "below", "same").agg(F.sum(F.when(F.col("_y"), F.col("t")).otherwise(0)).alias("pos")), "blocks")
    whole = blocks.groupBy(*key).agg(F.sum("same").alias("all"), F.sum("pos").alias("pos"))  # a row a key
    wide = whole.withColumn("width", F.greatest(F.lit(1024), F.ceil(F.sqrt("all")))).select(*key, "all", F.col("pos").alias("all_pos"), "width")
    runs = blocks.join(wide, key).withColumn("run", F.floor(F.col("below") / F.col("width")))
    block = F.struct((F.col("below") + (F.col("same") + 1) / 2).alias("rank"), F.col("same").alias("t"))
    runs = cut(runs.groupBy(*key, "run", "all", "all_pos").agg(F.sort_array(F.collect_list(block)).alias("b"), F.sum("same").alias("size")), "runs")
    sizes = runs.groupBy(*key, "all_pos").agg(F.sort_array(F.collect_list(F.struct("run", "size"))).alias("r"))  # a number a run
    chunk = F.greatest(F.lit(1), F.floor(F.lit(DRAWN) / F.size("r"))).cast("long")
    sizes = sizes.withColumn("step", F.least(chunk, F.lit(n_perm).cast("long"))).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_perm - 1).cast("long"), F.col("step"))))
    flat = sizes.select(*key, "all_pos", "step", "first", F.transform("r", lambda x: x["run"]).alias("runs"), F.transform("r", lambda x: x["size"]).alias("sizes"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                rng = np.random.default_rng(_seed(seed, *[r[k] for k in key], "runs", r["first"]))
                reps = min(int(r["step"]), n_perm - int(r["first"]))
                drawn = rng.multivariate_hypergeometric(np.asarray(r["sizes"], np.int64), int(r["all_pos"]), size=reps, method="marginals")
                yield pd.DataFrame({**{k: [r[k]] * len(r["runs"]) for k in key}, "run": r["runs"], "first": int(r["first"]), "m": list(drawn.T)})

    dealt = flat.mapInPandas(deal, f"{_fields(flat, key)}, run long, first long, m array<long>")
    met = dealt.join(runs.select(*key, "run", F.transform("b", lambda x: x["rank"]).alias("rank"), F.transform("b", lambda x: x["t"]).alias("t")), [*key, "run"])

    def sum_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                rng = np.random.default_rng(_seed(seed, *[r[k] for k in key], r["run"], r["first"]))
                rank, t = np.asarray(r["rank"], float), np.asarray(r["t"], np.int64)
                sums = [float(rank @ rng.multivariate_hypergeometric(t, int(m), method="marginals")) for m in r["m"]]
                yield pd.DataFrame({**{k: [r[k]] * len(sums) for k in key}, "rep": int(r["first"]) + np.arange(len(sums)), "s": sums})

    sums = met.mapInPandas(sum_ranks, f"{_fields(flat, key)}, rep long, s double").groupBy(*key, "rep").agg(F.sum("s").alias("s"))
    p, n = F.col("all_pos").cast("double"), (F.col("all") - F.col("all_pos")).cast("double")
    null = sums.join(wide, key).filter((p > 0) & (n > 0)).select(*key, "rep", ((F.col("s") - p * (p + 1) / 2) / (p * n)).alias("x"))
    null = cut(null, "null")
    mean = null.groupBy(*key).agg(F.avg("x").alias("null_mean"), F.stddev_pop("x").alias("null_std"))
    seen = auroc(df.filter(F.col(label).isNotNull()), key, label, score).select(*key, "auroc")
    far = (F.abs(F.col("x") - F.col("null_mean")) >= F.abs(F.col("auroc") - F.col("null_mean"))).cast("double")
    return null.join(mean, key).join(seen, key).groupBy(*key, "auroc", "null_mean", "null_std").agg(F.avg(far).alias("p"), F.count(F.lit(1)).alias("n_perm"))
