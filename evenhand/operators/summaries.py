"""Counts, shares, summaries, histograms and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.exprs import NAN, nearest_index
from evenhand.functions.ranks import counted, positions, rank_in_runs, value_run
from evenhand.sources.scratch import cut


def frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their counts ``t``, how many smaller ones there are, and the key's ``n`` and ``mean``; nulls are left out."""
    return positions(counted(df.filter(F.col(value).isNotNull()), keys, value), keys, [], value)


def medians(df: DataFrame, keys: list[str], value: str, to: str = "median") -> DataFrame:
    """(keys, ``to``): the mean of the two middle values, from a frequency table."""
    return frequencies(df, keys, value).groupBy(*keys).agg(middle(value).alias(to))


def at_index(value: str, index: Column) -> Column:
    """The value at a 0-based index of the sorted rows that a frequency table stands for."""
    return F.min(F.when(F.col("before") + F.col("t") > index, F.col(value)))


def middle(value: str) -> Column:
    """The median of the sorted rows that a frequency table with ``before``, ``t`` and ``n`` stands for."""
    n = F.col("n")
    return (at_index(value, F.floor((n - 1) / 2)) + at_index(value, F.floor(n / 2))) / 2


def group_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, median, std, q25, q75, iqr per key, from one frequency table.

    Nulls are left out; NaN spreads through mean and std; quartiles are nearest-rank; the std of one value is null.
    """
    n, x = F.col("n"), F.col(value)
    off = x - F.col("mean")
    out = frequencies(df, keys, value).groupBy(*keys, "n").agg(
        F.first("mean").alias("mean"),
        F.max(F.isnan(x) | (F.abs(x) == float("inf"))).alias("odd"),
        F.sum(off * off * F.col("t")).alias("squares"),
        middle(value).alias("median"),
        at_index(value, nearest_index(n, 0.25)).alias("q25"),
        at_index(value, nearest_index(n, 0.75)).alias("q75"),
    )
    std = F.when(F.col("odd"), F.lit(NAN)).when(n > 1, F.sqrt(F.col("squares") / (n - 1)))
    return out.select(*keys, "n", "mean", "median", std.alias("std"), "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def shares(counted: DataFrame, within: list[str], to: str = "pct", digits: int = 1) -> DataFrame:
    """Add each row's percentage of n within ``within`` (all rows, if empty)."""
    total = F.sum("n").over(Window.partitionBy(*within))
    return counted.withColumn(to, F.round(100.0 * F.col("n") / total, digits))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, row_pct), with zero cells: each row's counts by column as a map, laid out over the names of all columns."""
    n = df.groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    names = cut(n, "cells")
    cols = names.agg(F.sort_array(F.collect_set("col")).alias("_cols"), F.max(F.col("col").isNull()).alias("_null"))  # a name a column of the table
    rows = names.groupBy("row").agg(F.map_from_entries(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "n")))).alias("_m"), F.sum(F.when(F.col("col").isNull(), F.col("n"))).alias("_none"))
    wide = rows.crossJoin(F.broadcast(cols))  # one row
    every = F.concat(F.transform("_cols", lambda c: F.struct(c.alias("col"), F.coalesce(F.try_element_at("_m", c), F.lit(0)).alias("n"))), F.when(F.col("_null"), F.array(F.struct(F.lit(None).cast("string").alias("col"), F.coalesce("_none", F.lit(0)).alias("n")))).otherwise(F.array().cast("array<struct<col:string,n:bigint>>")))
    return shares(wide.select("row", F.explode(every).alias("_c")).select("row", "_c.col", "_c.n"), ["row"], "row_pct")


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` by the listed values of ``col``, zeros filled."""
    return df.groupBy(row).pivot(col, values).count().na.fill(0)


def describe(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, property, n, n_missing, mean, std, min, q25, median, q75, max) of several columns; quartiles are nearest-rank.

    One frequency table serves all columns, so no task holds a column's values.
    """
    by = [*(keys or []), "property"]
    f = frequencies(unpivot(df, columns, keys), by, "value")
    n, off = F.col("n"), F.col("value") - F.col("mean")
    out = f.groupBy(*by, "n").agg(
        F.first("mean").alias("mean"), F.sum(off * off * F.col("t")).alias("_s"), F.min("value").alias("min"), at_index("value", nearest_index(n, 0.25)).alias("q25"),
        middle("value").alias("median"), at_index("value", nearest_index(n, 0.75)).alias("q75"), F.max("value").alias("max"),
    )
    total = unpivot(df, columns, keys).groupBy(*by).agg(F.count("value").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"))
    on = reduce(lambda x, y: x & y, [total[k].eqNullSafe(out[k]) for k in by])
    got = total.join(out.drop("n"), on, "left")
    std = F.when(total["n"] > 1, F.sqrt(F.col("_s") / (total["n"] - 1)))
    return got.select(*[total[k] for k in by], total["n"], "n_missing", "mean", std.alias("std"), "min", "q25", "median", "q75", "max")


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.property", "_p.value")


def histogram(df: DataFrame, columns: list[str], bins: int = 30, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins between each column's least and greatest value, by keys: (keys, property, bin, lo, hi, n); the last bin is closed."""
    by = [*(keys or []), "property"]
    long = unpivot(df, columns, keys).filter(F.col("value").isNotNull())
    ends = long.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)))
    n = long.join(F.broadcast(ends), by).groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = all_bins.join(n, [*by, "bin"], "left").na.fill(0, ["n"])
    return out.select(*by, "bin", (F.col("_lo") + width * F.col("bin")).alias("lo"), (F.col("_lo") + width * (F.col("bin") + 1)).alias("hi"), "n")


def integer_histogram(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Bins centred on the whole numbers between each column's least and greatest value, by keys: (keys, property, bin, lo, hi, n)."""
    by = [*(keys or []), "property"]
    long = unpivot(df, columns, keys).filter(F.col("value").isNotNull())
    ends = long.groupBy(*by).agg(F.floor(F.min("value")).alias("_lo"), F.ceil(F.max("value")).alias("_hi"))
    n = long.groupBy(*by, F.round("value").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = ends.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("bin")).join(n, [*by, "bin"], "left").na.fill(0, ["n"])
    return out.select(*by, "bin", (F.col("bin") - 0.5).alias("lo"), (F.col("bin") + 0.5).alias("hi"), "n")


def distinct_and_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(property, n_unique, n_missing) of several columns in one pass; null is not counted among the values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns])
    per = df.select(F.explode(pairs).alias("_p")).select("_p.*").groupBy("property", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("property").agg(F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))


def sorted_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(property, place, value): each column's distinct values, nulls left out, numbered from 1 in order.

    Values are cut into runs by their first characters, so that a column of many values is many tasks.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = cut(df.select(F.explode(pairs).alias("_p")).select("_p.*").filter("value IS NOT NULL").distinct(), "values")
    run = F.conv(F.hex(F.substring(F.col("value").cast("binary"), 1, 3)), 16, 10).cast("long") * F.pow(F.lit(256), 3 - F.least(F.octet_length("value"), F.lit(3))).cast("long")
    return rank_in_runs(rows, ["property"], F.when(F.col("value") == "", -1).otherwise(run), [F.col("value")], "place").select("property", "place", "value")


def by_marginal(counted: DataFrame, category: str) -> DataFrame:
    """Counted rows with their category's total and its place (from 1) by falling total, ties by name."""
    total = counted.groupBy(category).agg(F.sum("n").alias("total"))
    placed = total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), category)))  # a row a category
    return counted.join(placed, category)


def sigma_outliers(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per key and column: mean, std, and how many values lie beyond two and three standard deviations, with percentages of all rows."""
    by = [*(keys or []), "property"]
    long = unpivot(df, columns, keys)
    stats = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))
    far = F.abs(F.col("value") - F.col("mean"))
    out = long.join(F.broadcast(stats), by).groupBy(*by, "mean", "std", "n").agg(
        F.count(F.when(far > 2 * F.col("std"), 1)).alias("n_2sigma"), F.count(F.when(far > 3 * F.col("std"), 1)).alias("n_3sigma")
    )
    return out.withColumns({f"pct_{k}sigma": F.round(100.0 * F.col(f"n_{k}sigma") / F.col("n"), 1) for k in (2, 3)}).drop("n")


def representatives(df: DataFrame, by: str, key: str, keys: list[str] | None = None) -> DataFrame:
    """The smallest, the median (position n div 2) and the largest row by a column, of each of ``keys``; ties by a numeric key.

    The column cuts the rows into runs, and the key cuts them again, so that no task sorts all rows or all of one value.
    """
    keys = keys or []
    rows = df.withColumns({"_by": value_run(F.col(by)), "_key": value_run(F.col(key))})
    own = [*keys, "_by", by, "_key"]
    inner = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*own).orderBy(key)))
    counts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_c"))
    values = counts.groupBy(*keys, "_by", by).agg(F.sum("_c").alias("_c"))
    total = values.groupBy(*keys, "_by").agg(F.sum("_c").alias("_c"))
    past = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*keys)
    total = total.select(*keys, "_by", past(whole.orderBy("_by")).alias("_p0"), F.sum("_c").over(whole).alias("_n"))  # a row a run
    values = values.select(*keys, "_by", by, past(Window.partitionBy(*keys, "_by").orderBy(by)).alias("_p1"))
    counts = counts.select(*own, past(Window.partitionBy(*keys, "_by", by).orderBy("_key")).alias("_p2"))
    d = inner.join(counts, own).join(values, [*keys, "_by", by]).join(total, [*keys, "_by"]).withColumn("_r", F.col("_at") + F.col("_p0") + F.col("_p1") + F.col("_p2"))
    d = d.select(*df.columns, "_r", "_n")
    role = F.when(F.col("_r") == 1, "smallest").when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, "median").when(F.col("_r") == F.col("_n"), "largest")
    return d.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_r", "_n")
