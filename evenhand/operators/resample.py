"""Bootstrap intervals and permutation tests of rate metrics, drawn from cell counts in fixed blocks."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.exprs import seeded
from evenhand.functions.ranks import hash_rank
from evenhand.functions.special import norm_cdf, norm_ppf
from evenhand.sources.scratch import cut

BLOCK = 500


def metrics(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratio and difference of rates over the last axis; groups without cases drop out, NaN without any."""
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = np.where(n > 0, s / np.maximum(n, 1), np.nan)
    some = (n > 0).any(axis=-1)
    hi = np.where(some, np.where(np.isnan(rate), -np.inf, rate).max(axis=-1), np.nan)
    lo = np.where(some, np.where(np.isnan(rate), np.inf, rate).min(axis=-1), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = np.where(hi > 0, lo / np.where(hi > 0, hi, 1), np.nan)
    return ratio, hi - lo


def _seed(seed: int, *key) -> int:
    return zlib.crc32("|".join(map(str, (seed, *key))).encode())


def _draw(key: list[str], seed: int, shuffle: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in batches:
            out = []
            for row in table.itertuples():
                name = [getattr(row, k) for k in key]
                rng = np.random.default_rng(_seed(seed, *name, row.block))
                n, s = np.array(row.ns, np.int64), np.array(row.ss, np.int64)
                if shuffle:
                    got = rng.multivariate_hypergeometric(n, int(s.sum()), size=row.size)
                    ratio, diff = metrics(np.broadcast_to(n, got.shape), got)
                else:
                    cells = np.concatenate([s, n - s])
                    got = rng.multinomial(int(n.sum()), cells / n.sum(), size=row.size)
                    ratio, diff = metrics(got[:, : len(n)] + got[:, len(n) :], got[:, : len(n)])
                out.append((*name, row.block, ratio, diff, row.ns, row.ss))
            yield pd.DataFrame(out, columns=[*key, "block", "dir", "dpd", "ns", "ss"])

    return run


def replicates(rates: DataFrame, key: list[str], n: int, seed: int, shuffle: bool) -> DataFrame:
    """Blocks of replicates of each key; a block's draws depend on (seed, key, block) alone, not on partitions."""
    cells = rates.filter("n_valid > 0").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("grp", "n_valid", "n_success"))).alias("cells"))
    blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // BLOCK) - 1))))
    size = F.least(F.lit(BLOCK), F.lit(n) - F.col("block") * BLOCK).cast("int")
    rows = blocks.select(*key, "block", size.alias("size"), F.col("cells.n_valid").alias("ns"), F.col("cells.n_success").alias("ss"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rates.select(*key).schema]
    schema = ", ".join([*fields, "block int, dir array<double>, dpd array<double>, ns array<bigint>, ss array<bigint>"])
    return rows.repartition(*key, "block").mapInPandas(_draw(key, seed, shuffle), schema)


def bca(point: float, reps: np.ndarray, jack: np.ndarray, weight: np.ndarray, alpha: float) -> tuple[float, float, str]:
    """Bias-corrected and accelerated interval; plain percentiles where it is not defined."""
    plain = reps[~np.isnan(reps)]
    if not len(plain):
        return float("nan"), float("nan"), "percentile"
    low = [100 * alpha / 2, 100 * (1 - alpha / 2)]
    if not np.isnan(reps).any() and not np.isnan(point):
        z0 = norm_ppf(float((np.sum(reps < point) + np.sum(reps <= point)) / (2 * len(reps))))
        mean = np.average(jack, weights=weight)
        d = mean - jack
        under = np.sum(weight * d * d) ** 1.5
        if np.isfinite(z0) and under > 0 and np.isfinite(under):
            a = float(np.sum(weight * d**3) / (6 * under))
            ends = []
            for q in (alpha / 2, 1 - alpha / 2):
                z = z0 + norm_ppf(q)
                ends.append(norm_cdf(z0 + z / (1 - a * z)))
            if np.all(np.isfinite(ends)):
                lo, hi = np.percentile(reps, [100 * e for e in ends])
                return float(lo), float(hi), "bca"
    lo, hi = np.percentile(plain, low)
    return float(lo), float(hi), "percentile"


def _intervals(key: list[str], alpha: float):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("block")
        n, s = np.array(table["ns"].iloc[0], np.int64), np.array(table["ss"].iloc[0], np.int64)
        points = metrics(n, s)
        left, weight = [], []
        for g in range(len(n)):  # leaving one case out depends on its cell only
            for hit, count in ((1, s[g]), (0, n[g] - s[g])):
                if count:
                    m, t = n.copy(), s.copy()
                    m[g] -= 1
                    t[g] -= hit
                    left.append(metrics(m, t))
                    weight.append(count)
        out = []
        for i, name in enumerate(("dir", "dpd")):
            reps = np.concatenate(table[name].tolist())
            lo, hi, how = bca(float(points[i]), reps, np.array([x[i] for x in left], float), np.array(weight, float), alpha)
            out.append((*[table[k].iloc[0] for k in key], name, float(points[i]), lo, hi, how, len(reps)))
        return pd.DataFrame(out, columns=[*key, "metric", "point", "ci_lo", "ci_hi", "method", "n_boot"])

    return run


def bootstrap(rates: DataFrame, key: list[str], n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Intervals of the ratio and difference of rates: resampling cases is multinomial over (group, success) cells."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rates.select(*key).schema)
    schema = f"{fields}, metric string, point double, ci_lo double, ci_hi double, method string, n_boot long"
    return replicates(rates, key, n_boot, seed, False).groupBy(*key).applyInPandas(_intervals(key, alpha), schema)


def _permuted(key: list[str]):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        n, s = np.array(table["ns"].iloc[0], np.int64), np.array(table["ss"].iloc[0], np.int64)
        points, out = metrics(n, s), []
        for i, name in enumerate(("dir", "dpd")):
            null = np.concatenate(table.sort_values("block")[name].tolist())
            mean = np.nanmean(null) if not np.isnan(null).all() else np.nan
            with np.errstate(invalid="ignore"):
                far = np.abs(null - mean) >= np.abs(points[i] - mean)  # NaN compares false and still counts below
            std = np.nanstd(null) if not np.isnan(null).all() else np.nan
            out.append((*[table[k].iloc[0] for k in key], name, float(points[i]), float(far.mean()), float(mean), float(std), len(null)))
        return pd.DataFrame(out, columns=[*key, "metric", "observed", "p", "null_mean", "null_std", "n_perm"])

    return run


def permutation(rates: DataFrame, key: list[str], n_perm: int = 10_000, seed: int = 42) -> DataFrame:
    """Label shuffles of the rate metrics: with group sizes and successes fixed, a multivariate hypergeometric draw."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rates.select(*key).schema)
    schema = f"{fields}, metric string, observed double, p double, null_mean double, null_std double, n_perm long"
    return replicates(rates, key, n_perm, seed, True).groupBy(*key).applyInPandas(_permuted(key), schema)


#: What a general metric makes of the groups' means; any other aggregate will do.
COMBINE = {
    "gap": lambda m: F.max(m) - F.min(m),
    "ratio": lambda m: F.when(F.max(m) != 0, F.min(m) / F.max(m)).otherwise(F.lit(float("nan"))),
}
#: Row and replicate pairs that a task draws at once.
DRAWN = 1 << 20
#: Upper ends of the numbers 0, 1, ... of a Poisson(1) variable, to the last that a double tells from 1.
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function: equal inputs give equal, near ones unrelated numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, size: int, seeds: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Places of row ``numbers`` (0 to size - 1) under one permutation of them for each seed: (seeds, numbers).

    A Feistel network on a grid of about sqrt(size) by sqrt(size): each half is moved by a hash of the other, which can be
    undone, so the network is a bijection of the grid, however many tasks hold the rows. What leaves the numbers goes
    through it again until it is back among them.
    """
    a = max(1, math.isqrt(max(0, size - 1)) + 1)
    b = -(-size // a)
    with np.errstate(over="ignore"):
        salt = [_mix(seeds.astype(np.uint64)[:, None] + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(2 * rounds)]

    def network(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        left, right = x % a, x // a
        for k in range(rounds):
            left = (left + (_mix(right.astype(np.uint64) ^ salt[2 * k][rows, 0]) % np.uint64(a)).astype(np.int64)) % a
            right = (right + (_mix(left.astype(np.uint64) ^ salt[2 * k + 1][rows, 0]) % np.uint64(b)).astype(np.int64)) % b
        return left + a * right

    which = np.repeat(np.arange(len(seeds)), len(numbers))
    out = network(np.tile(numbers, len(seeds)), which)
    away = np.flatnonzero(out >= size)
    while len(away):
        out[away] = network(out[away], which[away])
        away = away[out[away] >= size]
    return out.reshape(len(seeds), len(numbers))


def poisson_weights(rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of rows, by a hash of each and of the replicate: (seeds, rows)."""
    u = _mix(_mix(seeds.astype(np.uint64))[:, None] ^ rows.astype(np.uint64)[None, :]) >> np.uint64(11)
    return np.searchsorted(_POISSON, u * 2.0**-53, side="right")


def _partial(key: list[str], sums: list[str], reps: int, seed: int, shuffle: bool):
    """Sums of each replicate over a task's rows: (key, _rep, _i, _n, sums); nothing is laid out by row and replicate outside numpy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = []
            for name, got in held.items():
                rep, at = np.nonzero(got[:, :, 0])
                out.append(pd.DataFrame({**{k: [v] * len(rep) for k, v in zip(key, name, strict=True)}, "_rep": rep, "_i": at, "_n": got[rep, at, 0], **{s: got[rep, at, 1 + j] for j, s in enumerate(sums)}}))
            held.clear()
            return pd.concat(out) if out else pd.DataFrame(columns=[*key, "_rep", "_i", "_n", *sums])

        for batch in batches:
            for name, part in batch.groupby(key, dropna=False, sort=False):
                ends = np.asarray(part["_ends"].iloc[0], np.int64)
                groups = len(ends)
                got = held.setdefault(name, np.zeros((reps, groups, 1 + len(sums))))
                seeds = np.array([_seed(seed, *name, r) for r in range(reps)], np.uint64)
                wide = max(1, DRAWN // len(part))
                for lo in range(0, reps, wide):
                    own = seeds[lo : lo + wide]
                    if shuffle:
                        group, weight = np.searchsorted(ends, permuted(part["_r"].to_numpy(np.int64), int(ends[-1]), own), side="right"), None
                    else:
                        group, weight = np.broadcast_to(part["_i"].to_numpy(np.int64), (len(own), len(part))), poisson_weights(part["_h"].to_numpy(np.int64), own)
                    at = (group + groups * np.arange(len(own))[:, None]).ravel()
                    for j in range(1 + len(sums)):
                        x = np.ones(len(part)) if j == 0 else part[sums[j - 1]].to_numpy(np.float64)
                        x = np.broadcast_to(x, group.shape) if weight is None else weight * x
                        got[lo : lo + len(own), :, j] += np.bincount(at, x.ravel(), len(own) * groups).reshape(len(own), groups)
            if sum(x.size for x in held.values()) > 4 * DRAWN:
                yield rows()
        yield rows()

    return run


def replicate_sums(df: DataFrame, key: list[str], grp: str, row: str, sums: dict[str, Column], reps: int, seed: int, shuffle: bool) -> DataFrame:
    """(key, _rep, grp, n, sums): sums over the rows of each group, in each replicate.

    With ``shuffle`` labels are permuted: a key's rows are numbered densely by a hash of their id, and a replicate is a
    bijection of these numbers, so groups keep their sizes exactly, and rows are neither sorted nor shuffled again. Else
    each row weighs Poisson(1). Draws depend on (seed, key, replicate, row) only, not on partitions.
    """
    rows = df.select(*key, F.col(grp).alias("_grp"), F.col(row).alias("_row"), *[c.cast("double").alias(k) for k, c in sums.items()])
    rows = rows.filter(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in sums]) & F.col("_grp").isNotNull())
    if shuffle:
        rows = hash_rank(rows, key, seeded(str(seed), F.col("_row")), "_row", "_r").withColumn("_r", F.col("_r") - 1)
    rows = cut(rows.withColumn("_h", F.xxhash64("_row")), "rows")
    sizes = rows.groupBy(*key, "_grp").agg(F.count(F.lit(1)).alias("_c")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_grp", "_c"))).alias("_g"))  # a row a key
    ends = F.transform("_g", lambda g, i: F.aggregate(F.slice("_g", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["_c"]))
    sizes = cut(sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.transform("_g", lambda g: g["_grp"]).alias("_groups"), ends.alias("_ends")), "sizes")
    on = lambda a: reduce(lambda x, y: x & y, [a[k].eqNullSafe(sizes[f"_k{i}"]) for i, k in enumerate(key)])
    joined = rows.join(sizes, on(rows)).withColumn("_i", F.array_position("_groups", F.col("_grp")) - 1)
    slim = joined.select(*[rows[k] for k in key], "_h", *(["_r"] if shuffle else []), "_i", "_ends", *sums)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    schema = f"{fields}, _rep int, _i int, _n double, " + ", ".join(f"`{k}` double" for k in sums)
    part = slim.mapInPandas(_partial(key, list(sums), reps, seed, shuffle), schema)
    part = part.groupBy(*key, "_rep", "_i").agg(F.sum("_n").alias("n"), *[F.sum(k).alias(k) for k in sums])
    return part.join(sizes, on(part)).select(*[part[k] for k in key], "_rep", F.col("_groups")[F.col("_i")].alias(grp), "n", *sums)


def _described(value: Column | str | None, combine, sums: dict[str, Column] | None, metric: Column | None) -> tuple[dict[str, Column], Column]:
    if sums is None:
        sums, metric = {"x": F.col(value) if isinstance(value, str) else value}, combine(F.col("x") / F.col("n"))
    return sums, metric


def _observed(df: DataFrame, key: list[str], grp: str, sums: dict[str, Column], metric: Column, to: str) -> DataFrame:
    rows = df.select(*key, grp, *[c.cast("double").alias(k) for k, c in sums.items()]).filter(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in sums]) & F.col(grp).isNotNull())
    return rows.groupBy(*key, grp).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in sums]).groupBy(*key).agg(metric.alias(to))


def general_bootstrap(
    df: DataFrame, key: list[str], grp: str, value: Column | str | None = None, row: str = "row_id", combine=COMBINE["gap"], n_boot: int = 200, seed: int = 42,
    alpha: float = 0.05, sums: dict[str, Column] | None = None, metric: Column | None = None,
) -> DataFrame:
    """BCa interval of a metric of groups: (key, point, ci_lo, ci_hi, method, n_boot).

    By default the metric is ``combine`` of the groups' means of ``value``. In general it is ``metric``, an aggregate over a
    row a group, with the group's ``n`` and ``sums`` of any expressions of a row: moments, products, indicators. Rows weigh
    Poisson(1) in each replicate (see ``replicate_sums``). The acceleration comes from leaving out one hash block of rows at
    a time (100 blocks), the bias from the replicates. Plain percentiles hold where either is not defined.
    """
    sums, metric = _described(value, combine, sums, metric)
    point = _observed(df, key, grp, sums, metric, "point")
    reps = replicate_sums(df, key, grp, row, sums, n_boot, seed, False).groupBy(*key, "_rep").agg(metric.alias("x"))
    rows = df.select(*key, grp, row, *[c.cast("double").alias(k) for k, c in sums.items()]).filter(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in sums]))
    block = F.pmod(F.xxhash64(F.lit(seed), row), F.lit(100)).alias("_block")
    own = cut(rows.groupBy(*key, grp, block).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in sums]), "blocks")
    names = ["n", *sums]
    every = own.groupBy(*key, grp).agg(*[F.sum(c).alias(f"_all_{c}") for c in names])
    blocks = every.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long")))).join(own, [*key, grp, "_block"], "left")
    left = blocks.select(*key, grp, "_block", *[(F.col(f"_all_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in names])
    left = left.filter("n > 0").groupBy(*key, "_block").agg(metric.alias("x"))
    both = reps.groupBy(*key).agg(F.collect_list("x").alias("reps")).join(left.groupBy(*key).agg(F.collect_list("x").alias("jack")), key).join(point, key)  # n_boot and 100 numbers a key
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in both.select(*key).schema]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [bca(float(p), np.array(r, float), np.array(j, float), np.ones(len(j)), alpha) for p, r, j in zip(b["point"], b["reps"], b["jack"], strict=True)]
            yield b[[*key, "point"]].assign(ci_lo=[g[0] for g in got], ci_hi=[g[1] for g in got], method=[g[2] for g in got], n_boot=[len(r) for r in b["reps"]])

    return both.mapInPandas(ends, ", ".join([*fields, "point double, ci_lo double, ci_hi double, method string, n_boot long"]))


def general_permutation(
    df: DataFrame, key: list[str], grp: str, value: Column | str | None = None, row: str = "row_id", combine=COMBINE["gap"], n_perm: int = 200, seed: int = 42,
    sums: dict[str, Column] | None = None, metric: Column | None = None,
) -> DataFrame:
    """Permutation test of a metric of groups: (key, observed, p, null_mean, null_std, n_perm).

    The metric is given as for ``general_bootstrap``. Group sizes are exactly the given ones in every replicate. A NaN
    replicate counts as not far, and stays in the denominator.
    """
    sums, metric = _described(value, combine, sums, metric)
    observed = _observed(df, key, grp, sums, metric, "observed")
    null = cut(replicate_sums(df, key, grp, row, sums, n_perm, seed, True).groupBy(*key, "_rep").agg(metric.alias("x")), "null")  # n_perm rows a key
    some = F.when(~F.isnan("x"), F.col("x"))
    mean = null.groupBy(*key).agg(F.avg(some).alias("null_mean"), F.stddev_pop(some).alias("null_std"))
    far = F.abs(F.col("x") - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean"))
    both = null.join(mean, key).join(observed, key)
    return both.groupBy(*key, "observed", "null_mean", "null_std").agg(F.avg(F.when(~F.isnan("x") & far, 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).alias("n_perm"))


def poisson_bootstrap(df: DataFrame, key: list[str], grp: str, value: str, n_boot: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the gap of group means, by Poisson(1) weights from a hash of ``row_id``."""
    gap = replicate_sums(df, key, grp, "row_id", {"x": F.col(value)}, n_boot, seed, False).groupBy(*key, "_rep").agg(COMBINE["gap"](F.col("x") / F.col("n")).alias("gap"))
    return gap.groupBy(*key).agg(F.percentile("gap", alpha / 2).alias("ci_lo"), F.percentile("gap", 1 - alpha / 2).alias("ci_hi"), F.count("gap").alias("n_boot"))
