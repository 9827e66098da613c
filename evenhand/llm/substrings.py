"""Passages that repeat across documents, from suffix trees that are partitioned by prefixes of their suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import cut, lean, small_batches, temporary
from evenhand.llm.textarrays import mix64, slices, word_hashes

#: Contexts of one prefix that form a subtree in memory; a prefix with more is lengthened to the whole window.
GROUP_CONTEXTS = 512
#: Contexts whose subtrees are built together.
CHUNK_CONTEXTS = 8192
SPANS = "array<struct<start:long,length:long>>"


def prefix_words(window: int) -> int:
    """Words of a short prefix: a window then holds at most 62 of them, and one long marks its context's windows."""
    return max(1, window // 3, window - 61)


def anchor_runs(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, over texts laid end to end: (text, first window, last window, anchor, hash).

    A window's anchor is its leftmost prefix-sized factor of the least hash. Equal windows have equal anchors at equal
    places, and the windows of a run share the suffix that begins at their anchor.
    """
    k = prefix_words(window)
    n, wide = len(words), window - k + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, np.zeros(0, np.uint64)
    step = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    factor = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        factor += words[j : n - k + 1 + j] * step[j]
    factor = mix64(factor)
    at, size = np.arange(len(factor)), 1
    while size < wide:  # leftmost places of the least hash among 1, 2, 4 ... factors, and then of ``wide``
        ahead = min(size, wide - size)
        a, b = at[:-ahead], at[ahead:]
        at, size = np.where(factor[b] < factor[a], b, a), size + ahead
    ends = np.repeat(bounds[1:], np.diff(bounds))
    window_at = np.flatnonzero(np.arange(n - window + 1) + window <= ends[: n - window + 1])
    if not len(window_at):
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor = at[window_at]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(window_at) != 1) | (np.diff(anchor) != 0)]))
    stop = np.concatenate([begin[1:], [len(window_at)]]) - 1
    first = window_at[begin]
    return np.searchsorted(bounds, first, side="right") - 1, first, window_at[stop], anchor[begin], factor[anchor[begin]]


def _anchors(window: int):
    """(anchor, doc, h) of every text, each anchor once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(2)):
                words, bounds = word_hashes(data, offsets, lower=False)
                text, _, _, _, hashed = anchor_runs(words, bounds, window)
                pairs = np.unique(np.stack([text.astype(np.uint64), hashed], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.uint64)
                own = pa.array(pairs[:, 0].astype(np.int64))
                docs, h = (batch.column(i).slice(first, last - first).take(own) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64)), docs, h], ["anchor", "doc", "h"])

    return run


def _contexts(window: int):
    """Contexts of a text's marked anchors: all words of a run's windows, where they start, and the anchor's place in them."""
    kinds = [("doc", pa.int64()), ("h", pa.int64()), ("anchor", pa.int64()), ("lead", pa.int32()), ("content", pa.string()), ("starts", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in ((i, *s[1:]) for i in range(len(batch)) for s in slices(batch.column(2).slice(i, 1))):
                words, bounds = word_hashes(data, offsets, lower=False)
                _, first, last, anchor, hashed = anchor_runs(words, bounds, window)
                marked = np.isin(hashed.view(np.int64), batch.column(3)[at].values.to_numpy())
                split, found = data.tobytes().split(), {}
                for x, y, a, f in zip(first[marked].tolist(), last[marked].tolist(), anchor[marked].tolist(), hashed.view(np.int64)[marked].tolist(), strict=True):
                    found.setdefault((f, a - x, b" ".join(split[x : y + window])), []).append(x)
                doc, h = (batch.column(i)[at].as_py() for i in (0, 1))
                rows = [(doc, h, f, lead, content.decode(), starts) for (f, lead, content), starts in found.items()]
                for lo in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo : lo + 4096]], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    return run


def subtrees(group: np.ndarray, lead: np.ndarray, contexts: list[list[bytes]], least: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context the least document that holds each of its windows, among contexts of the same group.

    ``group`` has the prefix, ``lead`` the words before it, ``least`` the least document that holds the context. The
    suffixes that begin at the prefix are sorted, and the longest common prefixes of neighbours are the depths of the
    tree's internal nodes. A window that begins ``o`` words before the prefix is repeated where suffixes meet in a node
    of depth ``window - o`` or more and have the same ``o`` words on their left: both ways extended, a repeat.
    """
    wide = window - prefix_words(window)
    m = len(contexts)
    number: dict[bytes, int] = {}
    grid = np.repeat(-1 - np.arange(m, dtype=np.int64)[:, None], wide + window, axis=1)  # beyond a context, nothing is equal
    for i, c in enumerate(contexts):
        grid[i, wide - lead[i] : wide - lead[i] + len(c)] = [number.setdefault(w, len(number)) for w in c]
    count = np.array([len(c) for c in contexts], np.int64) - window + 1
    order = np.lexsort([*[grid[:, wide + j] for j in reversed(range(window))], group])
    sorted_ = grid[order][:, wide:]
    differ = sorted_[1:] != sorted_[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    common[group[order][1:] != group[order][:-1]] = 0
    out = [np.zeros(n, np.int64) for n in count.tolist()]
    left = np.zeros(m, np.int64)
    node = np.empty(m, np.int64)
    for o in range(wide + 1):
        if o:
            left = np.unique(left * (m + len(number) + 1) + grid[:, wide - o] + m, return_inverse=True)[1]
        node[order] = np.concatenate([[0], np.cumsum(common < window - o)])
        own = np.flatnonzero((lead >= o) & (lead - o < count))
        if len(own):
            _, repeat = np.unique(node[own] * (m + 1) + left[own], return_inverse=True)
            best = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(best, repeat, least[own])
            for i, b in zip(own.tolist(), best[repeat].tolist(), strict=True):
                out[i][lead[i] - o] = b
    return out


def _subtrees(window: int):
    """Contexts sorted by prefix, and so group after group: (ctx, first), the least document of each window."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        group, lead, least = (rows[c].to_numpy() for c in ("anchor", "lead", "least"))
        found = subtrees(group, lead, [c.encode().split(b" ") for c in rows["content"].to_pylist()], least, window)
        return pa.RecordBatch.from_arrays([rows["ctx"].combine_chunks(), pa.array(found, pa.list_(pa.int64()))], ["ctx", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) >= CHUNK_CONTEXTS:
                anchors = held["anchor"].to_numpy()
                whole = int(np.searchsorted(anchors, anchors[-1]))  # the last group may go on
                if whole:
                    yield built(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and len(held):
            yield built(held)

    return run


def _windows(window: int):
    """Contexts of prefixes that were lengthened: (ctx, i, suffix), a digest of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, at, key = [], [], []
            for c, content in zip(batch["ctx"].to_pylist(), batch["content"].to_pylist(), strict=True):
                words = content.encode().split(b" ")
                for i in range(len(words) - window + 1):
                    ctx.append(c)
                    at.append(i)
                    key.append(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ctx, pa.binary()), pa.array(at, pa.int32()), pa.array(key, pa.binary())], ["ctx", "i", "suffix"])

    return run


def repeats(texts: DataFrame, window: int = 50) -> DataFrame:
    """(doc, h, spans): runs of windows of a text that also start in a document with a smaller id.

    ``texts`` has doc (long), h (a hash of the text) and text. Two windows are equal if all their words are. Every window
    is judged. Its anchor, a factor of ``prefix_words`` that its words alone choose, is the prefix that partitions
    suffixes: only prefixes that several documents hold go on; of these, all contexts (the words of a run of windows
    around an anchor) are gathered, equal ones once with their least document. Prefixes with up to GROUP_CONTEXTS contexts
    are subtrees, built in memory; others are lengthened until all their suffixes are one window, which is a
    deep node by itself, and needs its least document only. No task holds a prefix's documents or copies.
    """
    spark = texts.sparkSession
    small_batches(spark)
    rows = texts.filter("doc IS NOT NULL AND text IS NOT NULL").select("doc", "h", "text")
    with temporary(spark) as keep:
        anchors = cut(rows.mapInArrow(lean(_anchors(window)), "anchor long, doc long, h long"), "anchors")
        shared = anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("anchor")
        marks = anchors.join(shared, "anchor", "left_semi").groupBy("doc", "h").agg(F.collect_set("anchor").alias("marks"))
        once = rows.dropDuplicates(["doc", "h"]).join(marks, ["doc", "h"]).select("doc", "h", "text", "marks")
        contexts = once.mapInArrow(lean(_contexts(window)), "doc long, h long, anchor long, lead int, content string, starts array<int>")
        contexts = cut(contexts.withColumn("ctx", F.unhex(F.md5("content"))), "contexts")
        classes = contexts.groupBy("anchor", "lead", "content", "ctx").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        classes = cut(classes, "classes")
        per = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("a"), F.max("most").alias("b"))
        long = cut(per.filter(F.col("n") > GROUP_CONTEXTS).select("anchor"), "lengthened")
        small = classes.join(long, "anchor", "left_anti").select("ctx", "anchor", "lead", "content", "least")
        first = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_subtrees(window)), "ctx binary, first array<long>")
        if not long.isEmpty():
            big = classes.join(long, "anchor", "left_semi").select("ctx", "content", "least")
            suffixes = cut(big.select("ctx", "content").mapInArrow(lean(_windows(window)), "ctx binary, i int, suffix binary"), "suffixes")
            least = suffixes.join(big.select("ctx", "least"), "ctx").groupBy("suffix").agg(F.min("least").alias("least"))
            own = suffixes.join(least, "suffix").groupBy("ctx").agg(F.sort_array(F.collect_list(F.struct("i", "least"))).alias("f"))
            first = first.union(own.select("ctx", F.transform("f", lambda x: x["least"]).alias("first")))
        first = cut(first, "first")
        judged = contexts.select("doc", "h", "ctx", "starts").join(first, "ctx")
        mask = F.expr("aggregate(transform(first, (x, i) -> IF(x < doc, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
        judged = judged.select("doc", "h", "starts", mask.alias("mask")).filter("mask <> 0")
        out = cut(judged.groupBy("doc", "h").agg(F.collect_list(F.struct("starts", "mask")).alias("spans")), "repeats")
        keep(out)
    return out


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            total, gone, kept, removed = [], [], [], []
            for i in range(len(batch)):
                words = (batch.column(n)[i].as_py() or "").encode().split()
                spans = batch.column(n + 1)[i].as_py() or []
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    covered = np.flatnonzero([s["mask"] >> j & 1 for j in range(s["mask"].bit_length())])
                    at = (np.array(s["starts"], np.int64)[:, None] + covered[None, :]).ravel()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                out = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                total.append(len(words))
                gone.append(int(out.sum()))
                removed.append([{"start": a, "length": b - a} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
                kept.append(b" ".join([words[j] for j in np.flatnonzero(~out)] if spans else words).decode())
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*batch.schema.names[:n], "n_words", "n_removed", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``keep`` columns of every row, with n_words, n_removed, ``removed`` (spans of words) and ``kept`` (the text without them).

    Removed is every word (maximal run of anything but ASCII white space, compared as it is) that is covered by a
    ``window`` of consecutive words which also starts in a row with a smaller id. Windows are judged on the input. Kept words
    are joined by single spaces.

    Null and empty texts have no words; rows with a null id lose nothing and take nothing from others; rows that share an id
    take nothing from each other, equal or not; texts shorter than a window stay whole. Whole texts are read, a text in one
    task. Columns that are not kept are ignored, whatever their names; kept ones may not have the result's names. An empty table
    gives an empty one.
    """
    clash = {"n_words", "n_removed", "removed", "kept"} & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)}: the result has columns of these names")
    text = F.col(text_col).cast("string")
    found = repeats(docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text")), window)
    found = found.withColumnsRenamed({"doc": "_doc", "h": "_h"})
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    joined = rows.join(found, (rows["_id"] == found["_doc"]) & (rows["_hash"] == found["_h"]), "left").select(*keep, "_text", "spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    return joined.mapInArrow(lean(_cut_out(window)), f"{kinds}, n_words long, n_removed long, removed {SPANS}, kept string")


def op13_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, ["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL of op13_substrings: every window by its text.
SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
x AS (SELECT k, doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
h AS (SELECT k, doc_id, i, sha256(array_to_string(w[i + 1:i + 50], ' ')) AS s FROM x),
m AS (SELECT k, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS hit FROM h),
g AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS j FROM m WHERE hit),
l AS (SELECT k, list(j) AS gone FROM g GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN l.k IS NULL THEN array_to_string(d.w, ' ')
                   ELSE array_to_string(list_transform(list_filter(range(0, len(d.w)), lambda p: NOT list_contains(l.gone, p)), lambda p: d.w[p + 1]), ' ') END) AS kept_sha256
FROM d LEFT JOIN l ON d.k = l.k
"""
