"""Sharding by Karmarkar-Karp differencing: near-equal bytes for groups that stay whole."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import cut, hash_part, salted_rank

#: Groups that one task differences, and tasks' results that one task of the next round differences again.
PER_BUCKET, FAN = 20_000, 4096
#: Tables of this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of all shards for each of the runs that slots are counted in.
SLOTS_SORTED = 1 << 18


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows: sums of each of k parts) into one by largest differencing.

    The two partitions of largest spread are combined again and again, the larger parts of one with the smaller of
    the other. Returns (part of each row's each part, shape of ``sums``; sums of the parts of the result).
    """
    n, k = sums.shape
    if not n:
        return np.zeros((0, k), np.int64), np.zeros(k, sums.dtype)
    order = np.argsort(-sums, axis=1, kind="stable")
    nodes = list(np.take_along_axis(sums, order, axis=1))
    heap = [(-int(x[0] - x[-1]), i) for i, x in enumerate(nodes)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = nodes[a] + nodes[b][::-1]
        by = np.argsort(-both, kind="stable")
        made.append((a, b, by.astype(np.int16)))
        nodes[a] = nodes[b] = None
        nodes.append(both[by])
        heapq.heappush(heap, (-int(nodes[-1][0] - nodes[-1][-1]), len(nodes) - 1))
    parts: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for i in range(len(made) - 1, -1, -1):
        a, b, by = made[i]
        own = parts.pop(n + i)
        parts[a] = np.empty(k, np.int64)
        parts[b] = np.empty(k, np.int64)
        parts[a][by] = own
        parts[b][k - 1 - by] = own
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = parts[i]
    return out, nodes[heap[0][1]]


def _difference_groups(shards: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["bytes", "h", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        sums = np.zeros((len(table), shards), np.int64)
        sums[:, 0] = table["bytes"]
        part, _ = difference(sums)
        return table.assign(part=part[:, 0])[["bucket", "h", "piece", "bytes", "part"]]

    return run


def _difference_parts(shards: int):
    """Results of several tasks (bucket, part, bytes) differenced into one: where each part of each bucket goes."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(table["bucket"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(names), shards), np.int64)
        sums[at, table["part"].to_numpy()] = table["bytes"]
        final, _ = difference(sums)
        return pd.DataFrame({"up": table["up"].iloc[0], "bucket": np.repeat(names, shards), "part": np.tile(np.arange(shards), len(names)), "to": final.ravel()})

    return run


def combine(placed: DataFrame, buckets: int, shards: int) -> DataFrame:
    """(bucket, part, shard) for every part of every bucket: rounds of differencing, FAN buckets to a task, until one is left."""
    sums = placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    where = None
    while True:
        own = sums.withColumn("up", F.floor(F.col("bucket") / FAN).cast("long"))
        to = cut(own.groupBy("up").applyInPandas(_difference_parts(shards), "up long, bucket long, part long, to long"), "combined")
        if where is None:
            where = to
        else:
            last = where.select(F.col("up").alias("_b"), F.col("to").alias("_p"), F.col("bucket").alias("_b0"), F.col("part").alias("_p0"))
            where = last.join(to, (F.col("_b") == F.col("bucket")) & (F.col("_p") == F.col("part"))).select("up", F.col("_b0").alias("bucket"), F.col("_p0").alias("part"), "to")
        buckets = -(-buckets // FAN)
        if buckets <= 1:
            return where.select("bucket", "part", F.col("to").cast("int").alias("shard"))
        sums = own.join(to.drop("up"), ["bucket", "part"]).groupBy(F.col("up").alias("bucket"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Add ``_copy``: rows with equal ``_k`` are numbered from 0, in any order, as they are alike. Other rows get 0."""
    again = cut(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_k"), "again")
    if again.isEmpty():
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    some = salted_rank(rows.join(again, "_k", "left_semi"), ["_k"], [hash_part(F.col("_row"), "copy", 3)], [F.col("_row")], "_copy")
    return some.withColumn("_copy", F.col("_copy") - 1).unionByName(rows.join(again, "_k", "left_anti").withColumn("_copy", F.lit(0).cast("long")))


def shard(docs: DataFrame, shards: int = 40, text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Every input row, but for its text, with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null).

    A row's size is its text's UTF-8 bytes plus ``overhead``; rows with equal texts are one group, which goes to one
    shard. Only a group of more than a whole shard's mean share is cut, since sizes could not be near equal with it
    whole: into pieces of about half a share. Groups are dealt over tasks by hash; each task differences its groups into
    ``shards`` parts, and the tasks' parts are differenced again, round by round. Slots count from 0 in each shard
    without gaps, in an order of hashes of the rows. What the rows hold decides all, however the input is cut into files
    and partitions.

    A null text has no bytes, like the empty one, and shares its group; null ids are ids like any other; repeated rows
    are each placed, as one group; input columns with an output's name are replaced; an empty table gives an empty
    table.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in made and c != text_col]
    own = {"_h": F.md5(text.cast("binary")), "_size": (F.octet_length(text) + overhead).cast("long"), "_crc": F.crc32(text.cast("binary"))}
    narrow = docs.withColumns(own).select(*keep, *own)
    hashed = [F.col(f"`{c}`") for c in keep if "map<" not in narrow.schema[c].dataType.simpleString()]
    narrow = cut(narrow.withColumns({"_k": F.xxhash64("_h", *hashed), "_row": F.monotonically_increasing_id()}), "sizes")
    narrow = cut(_told_apart(narrow).drop("_row"), "rows")
    total = narrow.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    share = max(1.0, total / shards)
    groups = narrow.groupBy("_h").agg(F.sum("_size").alias("bytes"))
    # groups of over a share: fewer than there are shards
    large = groups.filter(F.col("bytes") > share).select(F.col("_h").alias("_hl"), F.ceil(F.col("bytes") / (share / 2)).cast("long").alias("_n"))
    piece = F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_k", "_copy"), F.col("_n"))).cast("long")
    dealt = narrow.join(F.broadcast(large), narrow["_h"] == F.col("_hl"), "left").withColumn("_piece", piece).drop("_hl", "_n")
    items = cut(dealt.groupBy("_h", "_piece").agg(F.sum("_size").alias("bytes")), "groups")
    buckets = max(1, -(-items.count() // PER_BUCKET))
    items = items.select(F.pmod(F.xxhash64("_h", "_piece"), F.lit(buckets)).alias("bucket"), F.col("_h").alias("h"), F.col("_piece").alias("piece"), "bytes")
    placed = items.groupBy("bucket").applyInPandas(_difference_groups(shards), "bucket long, h string, piece long, bytes long, part long")
    placed = cut(placed, "parts")
    where = combine(placed, buckets, shards)
    where = F.broadcast(where) if buckets * shards <= BROADCAST_ROWS else where
    placed = placed.join(where, ["bucket", "part"]).select(F.col("h").alias("_h"), F.col("piece").alias("_piece"), "shard")
    out = dealt.join(placed, ["_h", "_piece"])
    salts = 1 + narrow.count() // SLOTS_SORTED
    out = salted_rank(out, ["shard"], [hash_part(F.concat_ws(":", "_k", "_copy"), "slot", 7) % salts], [F.col("_k"), F.col("_copy")], "_slot")
    return out.select(
        *keep,
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs)
