"""Ranks and running sums of large groups: groups are cut into runs that follow each other, and only a run is sorted in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.sources.scratch import cut

#: Runs that each doubling of a value is cut into, and a number above all runs of finite values.
RUNS, FAR = 256, 1 << 20


def _same(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[q]) for p, q in zip(left, right, strict=True)])


def _offsets(df: DataFrame, keys: list[str], add: Column) -> DataFrame:
    """(_o0, ..., _past, _all): sums of ``add`` over the runs before each run, and over all; ``keys`` end with the run."""
    sums = df.groupBy(*keys).agg(F.sum(add).alias("_s"))
    group = Window.partitionBy(*keys[:-1])  # a row a run
    past = F.sum("_s").over(group.orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1))
    names = [F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)]
    return sums.select(*names, F.coalesce(past, F.lit(0)).alias("_past"), F.sum("_s").over(group).alias("_all"))


def rank_in_runs(df: DataFrame, group: list[str], run: Column, order: list[Column], to: str) -> DataFrame:
    """Add ``to``, the rank from 1 within ``group`` by ``order``, of which ``run`` is a non-decreasing coarse form."""
    runs = df.withColumn("_run", run)
    keys = [*group, "_run"]
    inner = runs.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    offsets = _offsets(runs, keys, F.lit(1))
    out = inner.join(offsets, _same(inner, offsets, keys, [f"_o{i}" for i in range(len(keys))]))
    return out.withColumn(to, F.col("_at") + F.col("_past")).drop("_run", "_at", "_past", "_all", *[f"_o{i}" for i in range(len(keys))])


def hash_rank(df: DataFrame, group: list[str], hexed: Column, ties: str, to: str) -> DataFrame:
    """``rank_in_runs`` by a string of hex digits, ties by a column."""
    return rank_in_runs(df, group, F.conv(F.substring(hexed, 1, 4), 16, 10).cast("int"), [hexed, F.col(ties)], to)


def value_run(value: Column) -> Column:
    """A number's run, a non-decreasing coarse form of it: null first, then by sign and logarithm, NaN last."""
    v = value.cast("double")
    size = F.log2(F.abs(v)) * RUNS
    run = F.when(v.isNull(), -FAR - 1).when(F.isnan(v), FAR + 1).when(v == float("inf"), FAR).when(v == -float("inf"), -FAR)
    return run.when(v > 0, F.floor(size) + FAR // 2).when(v < 0, -F.ceil(size) - FAR // 2).otherwise(0).cast("int")


#: Frequency tables of up to this many rows are laid out a key a task; larger ones run by run.
SMALL_ROWS = 1 << 20


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, t): how often each value stands, written once. All that concerns order starts from this table."""
    return cut(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("t")), "frequencies")


def positions(f: DataFrame, outer: list[str], inner: list[str], value: str, small_rows: int | None = None) -> DataFrame:
    """Where the rows that a table of frequencies stands for have their places.

    Adds ``below`` and ``same`` (rows of ``outer`` with a smaller, and with the same value), ``before`` (rows of
    ``outer`` and ``inner`` with a smaller value), and ``n`` and ``mean`` of ``outer`` and ``inner``. Large tables are cut
    into runs of near values, with sums of the runs before; a task then holds a run of a key, otherwise a key.
    """
    both, value_sum = [*outer, *inner], F.sum(F.col(value) * F.col("t"))
    if f.count() <= (SMALL_ROWS if small_rows is None else small_rows):
        part, rows, past, past_own = outer, f, F.lit(0), F.lit(0)
        whole = Window.partitionBy(*both)
        n, mean = F.sum("t").over(whole), value_sum.over(whole) / F.sum("t").over(whole)
    else:
        part, rows = [*outer, "_run"], f.withColumn("_run", value_run(F.col(value)))
        runs = cut(rows.groupBy(*both, "_run").agg(F.sum("t").alias("_t"), value_sum.alias("_s")), "runs")  # a row a run and group
        whole, earlier = Window.partitionBy(*both), lambda keys: F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_run").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = runs.select(
            *[F.col(k).alias(f"_o{i}") for i, k in enumerate([*both, "_run"])], earlier(outer).alias("_past"), earlier(both).alias("_own"),
            F.sum("_t").over(whole).alias("n"), (F.sum("_s").over(whole) / F.sum("_t").over(whole)).alias("mean"),
        )
        rows = rows.join(runs, _same(rows, runs, [*both, "_run"], [f"_o{i}" for i in range(len(both) + 1)]))
        past, past_own, n, mean = (F.col(c) for c in ("_past", "_own", "n", "mean"))
    same = F.sum("t").over(Window.partitionBy(*part, value))
    upto = F.sum("t").over(Window.partitionBy(*part).orderBy(value))  # with all rows of the same value
    own = Window.partitionBy(*part, *inner).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"below": past + upto - same, "same": same, "before": past_own + F.coalesce(F.sum("t").over(own), F.lit(0)), "n": n, "mean": mean})
    return out.select(*f.columns, "below", "same", "before", "n", "mean")
