"""Periodic runs of words within texts, from a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import WORD, lean, small_batches
from evenhand.llm.merkle import crc32_sql

#: Words of texts that are named and sorted together; a longer text is sorted by itself.
CHUNK_WORDS = 1 << 19
RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(names: np.ndarray, ends: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs of several texts laid end to end.

    ``names`` are words as small integers; ``ends[i]`` is where the text of word i ends. The dictionary of basic
    factors names the factors of each power-of-two length ``size``, from the names of their halves. An occurrence's successor
    is the next one of the same name, if within ``2 * size``; consecutive occurrences with one distance are an arithmetic
    progression that proposes this distance as a period, and extends over ``size + period`` words from its last one.

    With exponents of 3 or more, a progression long enough is a whole run: were the stretch to go on at either end,
    the factor there would be followed at the same distance too, or at a shorter one that then held for the whole stretch.
    For the same reason its distance is the smallest period. Each run appears at the length that its period
    rounds up to, and maybe at others: these are dropped. Factors that a text holds once go no further.
    """
    n = len(names)
    at, key, size = np.arange(n), names.astype(np.int64), 1
    full, named = np.full(n, -1, np.int64), at[:0]
    found = [np.zeros((0, 3), np.int64)]
    while len(at):
        order = np.argsort(key, kind="stable")
        place = at[order]
        new = np.ones(len(at), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        step = np.zeros(len(at), np.int64)
        step[:-1] = np.where(new[1:], 0, np.diff(place))
        distance = np.empty_like(step)
        distance[order] = np.where(step <= 2 * size, step, 0)
        group = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(distance) != 0)]))
        stop = np.concatenate([group[1:], [len(at)]])
        period = distance[group]
        length = stop - group - 1 + size + period
        good = (period > 0) & (length >= np.maximum(least, exponent * period))
        found.append(np.stack([at[group], length, period], axis=1)[good])
        # names of what stands more than once; the next factors are pairs of these within one text
        again = ~new
        again[:-1] |= ~new[1:]
        full[named] = -1
        named = left = place[again]
        full[named] = np.cumsum(new)[again]
        left = np.sort(left[left + 2 * size <= ends[left]])
        left = left[full[left + size] >= 0]
        at, key = left, full[left] * (n + 1) + full[left + size]
        size *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _run(exponent: int, least: int):
    def judge(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, ...]], list[bytes]]:
        words = [t.split() for t in texts]  # bytes are split at ASCII white space only
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        number: dict[bytes, int] = {}
        names = np.empty(int(sizes.sum()), np.int64)
        for w, e, n in zip(words, ends.tolist(), sizes.tolist(), strict=True):
            own = dict.fromkeys(w)
            for x in own:
                own[x] = number.setdefault(x, len(number))
            names[e - n : e] = np.fromiter(map(own.__getitem__, w), np.int64, n)
        text = np.repeat(np.arange(len(words)), sizes)
        start, length, period = find_runs(names + text * (len(number) + 1), np.repeat(ends, sizes), exponent, least)
        edge = np.zeros(len(names) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begin = ends - sizes
        bounds = np.searchsorted(start, np.append(begin, len(names)))
        runs, left = [], []
        for i, w in enumerate(words):
            own = slice(bounds[i], bounds[i + 1])
            runs.append((start[own] - begin[i], length[own], period[own]))
            if bounds[i] < bounds[i + 1]:
                w = [w[j] for j in np.flatnonzero(~gone[begin[i] : ends[i]])]
            left.append(b" ".join(w))
        return runs, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            first = 0
            while first < len(batch):
                texts, held, last = [], 0, first
                while last < len(batch) and (not texts or held < 6 * CHUNK_WORDS):
                    texts.append(column[last].as_py() or b"")
                    held += len(texts[-1])
                    last += 1
                runs, left = judge(texts)
                offsets = np.cumsum([0, *[len(r[0]) for r in runs]])
                flat = [pa.array(np.concatenate([r[i] for r in runs]), pa.int64()) for i in range(3)]
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, ["start", "length", "period"]))
                whole = pa.array([x.decode() for x in left], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, last - first) for i in range(batch.num_columns - 1)], spans, whole], [*batch.schema.names[:-1], "runs", "collapsed"])
                first = last

    return run


def periodic_runs(docs: DataFrame, keep: list[str], text: Column, exponent: int = 4, least: int = 6) -> DataFrame:
    """``keep`` columns of every row, with ``runs`` and ``collapsed``.

    A run is a stretch of consecutive words (maximal runs of anything but ASCII white space) with smallest period q,
    of at least ``least`` and ``exponent * q`` words, that no neighbouring word extends; ``runs`` has each run's first word,
    length and period, by start, then length. ``collapsed`` is the text's words without those that some run holds after
    its first period, joined by single spaces.

    Words are compared whole and as they are. Whole texts are read, each in one task: memory is some 20 times the longest
    text. A null or empty text, and one without words, has no runs and is the empty string; repeated rows have
    a row each; input columns named ``runs`` or ``collapsed`` may not be kept; an empty table gives an empty one.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not found by their progressions alone")
    clash = {"runs", "collapsed"} & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)}: the result has columns of these names")
    rows = docs.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    small_batches(docs.sparkSession)
    return rows.mapInArrow(lean(_run(exponent, least)), f"{kinds}, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: of ids whose CRC-32 ends in 0, the words from one place on repeat with one period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def moved(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))), " ")

    # an array of one array, so that the words are split once and not for each of them
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), F.transform(F.array(words), moved)[0]).otherwise(text)


def op12_periods(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(docs, ["doc_id"], planted(F.col("doc_id"), F.col("text")))
    best = F.element_at(F.array_sort("runs", lambda a, b: _longest_first(a, b)), 1)
    best = F.when(F.size("runs") > 0, best)
    listed = F.sort_array(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"])))
    lines = F.transform(listed, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _longest_first(a: Column, b: Column) -> Column:
    out = F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1))
    out = out.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
    return out.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)


#: DuckDB SQL of op12_periods: a run of four periods q holds four equal words at multiples of q; only such (text, q) are spread out.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
                  coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
e AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS MATERIALIZED (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                     THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM f),
q AS (SELECT k, n, w, unnest(range(1, n // 4 + 1)) AS q FROM t),
j AS (SELECT k, n, w, q, unnest(range(0, n - 3 * q, q)) AS j FROM q),
c AS (SELECT DISTINCT k, q FROM j WHERE w[j + 1] = w[j + q + 1] AND w[j + 1] = w[j + 2 * q + 1] AND w[j + 1] = w[j + 3 * q + 1]),
x AS (SELECT c.k, c.q, unnest(range(0, t.n - c.q)) AS i, t.w FROM c JOIN t ON c.k = t.k),
y AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS grp FROM x WHERE w[i + 1] = w[i + q + 1]),
z AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM y GROUP BY k, q, grp),
r AS (SELECT k, s, l, min(q) AS q FROM z WHERE l >= greatest(6, 4 * q) GROUP BY k, s, l),
o AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
             min_by({{'s': s, 'l': l, 'q': q}}, {{'a': -l, 'b': s, 'c': q}}) AS b FROM r GROUP BY k),
v AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM r),
m AS (SELECT v.k, list(i) AS gone FROM v GROUP BY v.k),
u AS (SELECT t.k, CASE WHEN m.k IS NULL THEN array_to_string(t.w, ' ')
                  ELSE array_to_string(list_transform(list_filter(range(0, t.n), lambda i: NOT list_contains(m.gone, i)), lambda i: t.w[i + 1]), ' ') END AS kept
      FROM t LEFT JOIN m ON t.k = m.k)
SELECT t.doc_id, CAST(coalesce(o.n_runs, 0) AS BIGINT) AS n_runs, CAST(o.b.s AS BIGINT) AS start, CAST(o.b.l AS BIGINT) AS length,
       CAST(o.b.q AS BIGINT) AS period, CAST(1000 * o.b.l // o.b.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(o.lines, '')) AS runs_sha256, sha256(coalesce(u.kept, '')) AS collapsed_sha256
FROM t JOIN u ON t.k = u.k LEFT JOIN o ON t.k = o.k
"""
