"""Exact top-k search over binary codes: incremental multi-index hashing as joins, radius by radius."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import cut, remove, temporary


#: Codes that a segment's value has on average: a code that is met costs a few bit operations in the join, a probe a row that
#: is made, shuffled and sorted. Segments are no narrower than LEAST_WIDTH, unless asked for.
MET, LEAST_WIDTH = 8, 4


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Signs of the first ``bits`` components as '0' and '1', null for a null vector; missing or null components are 0."""
    bit = lambda i: F.when(F.get(vector, i - 1) > 0, F.lit("1")).otherwise("0")
    return F.when(vector.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(bits)), bit), ""))


def bounds(bits: int, segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; widths differ by one at most."""
    widths = [bits // segments + (i < bits % segments) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def part(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND((1 << width) - 1)


def flipped(rows: DataFrame, radius: int) -> DataFrame:
    """Each row (with a segment's ``width`` and a ``value``) once for every choice of ``radius`` of its bits, which are flipped.

    Bits are chosen one after another, each above the last: nested generators, so that no plan or table names the choices.
    """
    rows = rows.filter(F.col("width") >= radius).withColumn("_bit", F.lit(-1))
    for left in range(radius, 0, -1):
        rows = rows.withColumn("_bit", F.explode(F.sequence(F.col("_bit") + 1, F.col("width") - left)))
        rows = rows.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, _bit)")))
    return rows.drop("_bit")


def _found(index: DataFrame, queries: DataFrame, spans: list[tuple[int, int]], radius: int) -> list[DataFrame]:
    """(query, code, distance, first): codes with a segment at exactly ``radius`` from the query's and none nearer.

    A pair that meets in several segments is taken in the first of them, so no pair comes twice, nor again at a
    larger radius. Where ``queries`` have a ``bound``, pairs farther apart do not leave the join.
    """
    own = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(w).alias("width"), part(F.col("query"), low, w).alias("value")) for s, (low, w) in enumerate(spans)]))
    probes = flipped(queries.select(*queries.columns, own.alias("_s")).select(*queries.columns, "_s.*"), radius).drop("width")
    # A merge join: neither side goes through the driver
    met = probes.join(index.hint("merge"), ["segment", "value"]).withColumn("x", F.col("query").bitwiseXOR(F.col("code")))
    for s, (low, width) in enumerate(spans):
        near = F.bit_count(part(F.col("x"), low, width))
        met = met.filter((F.col("segment") == s) | (near > F.when(F.col("segment") > s, radius).otherwise(radius - 1)))
    if "bound" in queries.columns:
        met = met.filter(F.bit_count("x") <= F.col("bound"))
    return [met.select("query", "code", F.bit_count("x").cast("long").alias("distance"), "first", "n")]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code", bits: int = 64, segments: int | None = None) -> DataFrame:
    """(query, id, distance, rank) of each query's k nearest codes by Hamming distance, ties by smaller id; exact.

    ``codes`` and ``queries`` hold integer ids and codes as strings of ``bits`` (64 at most) '0' and '1'. Each distinct
    code is indexed once, by the values of its ``segments`` segments (by default as many as leave a segment's value
    about MET codes), with its k smallest ids. Each distinct query looks up the values at
    distance r of its own in every segment, for r from 0 on. A code within distance segments * (r + 1) - 1 has a
    segment within r, so once radius r is done all codes that near have been met, and a query whose kth distance is
    no more leaves the search; of other queries, the kth distance so far bounds what the next radius lets through. The
    k best codes by (distance, smallest id) hold the k best ids, so no more are kept.

    A query that is also a code finds itself. Null ids or codes are left out on either side; a repeated row of a code
    counts as often as it is there, a repeated row of a query once; fewer than k codes give shorter lists; an empty
    table gives an empty table. Other columns, whatever their names, are not read.
    """
    if not 1 <= bits <= 64:
        raise ValueError("bits must be from 1 to 64")
    number = F.conv(F.col(code_col), 2, -10).cast("long")
    c = codes.select(F.col(id_col).cast("long").alias("id"), number.alias("code")).dropna()
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), number.alias("query")).dropna()
    with temporary(codes.sparkSession) as keep:
        by = Window.partitionBy("code").orderBy("id")
        least = cut(c.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k).select("code", "id"), "ids")
        q = cut(q.distinct(), "queries")
        distinct = cut(least.groupBy("code").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "codes")
        size = distinct.count()
        spans = bounds(bits, segments or max(1, min(bits, round(bits / log2(max(1 << LEAST_WIDTH, size / MET))))))
        keyed = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), part(F.col("code"), *b).alias("value")) for s, b in enumerate(spans)]))
        index = cut(distinct.select("code", "first", "n", keyed.alias("_k")).select("_k.segment", "_k.value", "code", "first", "n"), "index")
        open_ = cut(q.select("query").distinct(), "open")
        best = open_.limit(0).select("query", *[F.lit(0).cast("long").alias(x) for x in ("code", "distance", "first", "n")])
        done = []
        order = Window.partitionBy("query").orderBy("distance", "first")
        for radius in range(max(w for _, w in spans) + 1):
            both = best
            for found in _found(index, open_, spans, radius):
                both = both.unionByName(found)
            ranked = both.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).withColumn("held", F.sum("n").over(order))
            ranked = cut(ranked.drop("at"), "best")
            kth = cut(ranked.filter(F.col("held") >= k).groupBy("query").agg(F.min("distance").alias("kth")), "kth")
            seen = len(spans) * (radius + 1) - 1
            covered = kth.filter(F.col("kth") <= seen).select("query")
            done.append(cut(ranked.join(covered, "query", "left_semi").drop("held"), "done"))
            last, best = best, cut(ranked.join(covered, "query", "left_anti").drop("held"), "best")
            open_ = open_.select("query").join(kth, "query", "left").select("query", F.coalesce("kth", F.lit(bits)).alias("bound"))
            open_ = cut(open_.filter(F.col("bound") > seen), "open")
            if hasattr(last, "scratch_path"):
                remove(codes.sparkSession, last.scratch_path)
            if open_.isEmpty():
                break
        found = best
        for some in done:
            found = found.unionByName(some)
        ids = found.select("query", "code", "distance").join(least.hint("merge"), "code")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
        ids = cut(ids.select("query", "id", "distance").withColumn("rank", rank).filter(F.col("rank") <= k), "found")
        keep(ids, q)
    return q.join(ids, "query").select(F.col("query_id").alias("query"), "id", "distance", "rank")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = cut(table.select("vec_id", sign_code(F.col("embedding")).alias("code")), "codes")
    return top_k(codes, codes.filter("vec_id % 100 = 0"), 10, "vec_id").select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "distance", "rank")


#: DuckDB SQL of op1_top_k.
SQL = """
WITH c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS b FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(len(list_filter(range(1, 65), lambda i: q.b[i] <> c.b[i])) AS BIGINT) AS distance
      FROM c q, c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10
"""
