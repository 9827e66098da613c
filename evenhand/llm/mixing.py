"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import cut, hash_part, salted_rank, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets of (_src, _null, source_size): ``share`` of all sizes by weight, none above ``cap`` times its size.

    Weights repeat over the sources in code-point order, null last. What capped sources leave over goes to the
    others by weight until none is above its cap; that fixed point is ``least(cap_i, w_i * level)``, and the
    level comes from prefix sums over the sources sorted by cap per weight.
    """
    order = Window.orderBy("_null", "_src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("_per", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    seq = Window.orderBy("_per", "_null", "_src")
    t = t.withColumn("_i", F.row_number().over(seq))
    past = seq.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))
    open_w = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(past), F.lit(0.0))
    t = t.withColumn("_level", left / open_w)
    level = F.min(F.when(F.col("_level") <= F.col("_per"), F.struct("_i", "_level"))).over(every)["_level"]
    t = t.withColumn("target", F.coalesce(F.least("_cap", F.col("_w") * level), F.col("_cap")))
    return t.select("_src", "_null", "source_size", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    salted_rows: int = 1 << 24,
    seed: str = "mix",
) -> DataFrame:
    """Copies of each document that bring every source near its target.

    Each document of a source expects ``target / source_size`` copies. The expected copies are prefix-summed
    over the source's documents (largest power-of-two size first, so that the taken size follows the target
    closely), one random offset per source is added, and a document is emitted once per integer it crosses; no
    document is emitted more than ``ceil(cap)`` times.

    Ranks are salted: a source's documents are cut by size class and hash, 64 ways for each ``salted_rows`` rows, and
    only a cut's rows are sorted together. The offset and hashes come from md5, so reruns agree.

    Returns every input column plus ``size``, ``source_size`` (long), ``target`` (double), ``copies`` and ``taken``
    (long); an input column of one of these names is replaced. Null or empty texts have size 0, no copies, and take nothing;
    null sources are one source of their own, last; repeated rows are each documents; an empty table gives an empty
    table.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    key = docs[source_col]
    measured = word_count(docs[text_col]) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    rows = docs.withColumns({
        "_src": F.coalesce(key.cast("string"), F.lit("")),
        "_null": key.isNull(),
        "_id": docs[id_col],
        "_size": measured,
    })
    rows = rows.drop(*[c for c in made if c in docs.columns])
    slim = cut(rows.select("_src", "_null", "_id", "_size"), "sizes")
    salts = 64 * (1 + slim.count() // salted_rows)
    sizes = slim.groupBy("_src", "_null").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    coarse = [-F.length(F.bin("_size")), hash_part(F.col("_id"), seed, 6) % salts]
    ranked = salted_rank(rows, ["_src", "_null"], coarse, [F.col("_size").desc(), F.col("_id").asc_nulls_last()], "_rank", slim)
    t = targets.withColumnsRenamed({"_src": "_tsrc", "_null": "_tnull"})
    out = ranked.join(t, (F.col("_src") == F.col("_tsrc")) & (F.col("_null") == F.col("_tnull")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (hash_part(F.concat(F.col("_null").cast("string"), F.col("_src")), f"{seed}-offset", 5) + 0.5) / float(16**5)
    out = out.withColumn("_rate", rate).withColumn("_off", offset)
    copies = F.floor(F.col("_off") + F.col("_rate") * F.col("_rank")) - F.floor(F.col("_off") + F.col("_rate") * (F.col("_rank") - 1))
    out = out.withColumn("copies", F.when(F.col("_size") > 0, copies).otherwise(0).cast("long")).withColumn("taken", F.col("copies") * F.col("_size"))
    out = out.withColumnRenamed("_size", "size")
    kept = [c for c in docs.columns if c not in made]
    return out.select(*kept, *made)


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per copy, with ``columns`` only."""
    copies = mixed.filter(F.col("copies") > 0)
    return copies.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    narrow = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "words")
    return mix(narrow, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB SQL of op5_mix.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS nul,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT src, nul, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src, nul),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY nul, src) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
p AS (SELECT *, cap / w AS per, row_number() OVER (ORDER BY cap / w, nul, src) AS i FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS lev FROM p),
t AS (SELECT src, nul, source_size,
             coalesce(least(cap, w * (SELECT lev FROM l WHERE lev <= per ORDER BY i LIMIT 1)), cap) AS target FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY src, nul ORDER BY -length(bin(size)),
             ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6))::BIGINT % (SELECT 64 * (1 + count(*) // 16777216) FROM d), size DESC, doc_id) AS k FROM d),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.k,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             (('0x' || substr(md5('mix-offset:' || CAST(r.nul AS VARCHAR) || r.src), 1, 5))::BIGINT + 0.5::DOUBLE) / 1048576.0::DOUBLE AS off
      FROM r JOIN t ON r.src = t.src AND r.nul = t.nul)
SELECT doc_id, size, source_size, target,
       CAST((floor(off + rate * k) - floor(off + rate * (k - 1))) * size AS BIGINT) AS taken
FROM x
"""
