"""Merkle manifest of a dataset: nested-interval labels, containment joins and membership proofs, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import cut

#: Nodes that make one parent, and levels that are built in one job: a row holds at most FANOUT ** BAND leaves.
FANOUT, BAND = 3, 6
#: Rows of a range of leaves that is numbered by one task.
RANGE_ROWS = 1 << 17
#: Subroots up to this many are broadcast to their leaves; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def record_hash(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of the columns as strings, each as its UTF-8 byte count, ``:`` and itself; ``-`` for null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to: each step hashes what stands left of a node, the node, and what stands right."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """Hex SHA-256 of a path's siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _join_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_b_{k}"])
    return out


def _ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Number the rows of each group from 0 in ``order`` (``lo``), and add the group's size (``n``).

    Rows are dealt in ranges of (keys, order), so no task holds a group, and even rows alike in all columns are split;
    offsets of ranges are prefix sums with one row for each range and group.
    """
    rows = cut(rows, "leaves")
    parts = max(1, 1 + rows.count() // RANGE_ROWS)
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("_tie")]
    dealt = tie.repartitionByRange(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by).sortWithinPartitions(*by)
    dealt = cut(dealt.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "dealt")
    runs = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(group)})
    runs = runs.drop("_n").withColumnsRenamed({k: f"_b_{k}" for k in [*keys, "_part"]})
    out = dealt.join(runs, _join_on(dealt, runs, [*keys, "_part"]))
    lo = (F.col("_at") - F.col("_first") + F.col("_before")).cast("long")
    return out.select(*[dealt[c] for c in dealt.columns if c not in ("_part", "_at")], lo.alias("lo"), (lo + 1).alias("hi"), "n")


def _band(nodes: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Blocks of nodes of ``level``, BAND levels up: a row for each, with its interval, hash and nested children.

    All levels of a block are grouped under one partitioning by (keys, block). A group whose nodes are down to one is
    not hashed again: its node is handed up as it is.
    """
    block = F.floor(F.col("lo") / F.lit(FANOUT ** (level + BAND))).cast("long")
    extra = [c for c in nodes.columns if c not in (*keys, "n", "lo", "hi", "hash")]
    out = nodes.select(*keys, "n", block.alias("_block"), F.struct("lo", "hi", "hash", *extra).alias("node"))
    out = out.repartition(*keys, "_block")
    for up in range(1, BAND + 1):
        bucket = F.floor(F.col("node.lo") / F.lit(FANOUT ** (level + up))).cast("long")
        kids = F.sort_array(F.collect_list("node")).alias("kids") if up > 1 else F.array_sort(F.collect_list("node"), _by_lo).alias("kids")
        out = out.groupBy(*keys, "n", "_block", bucket.alias("_bucket")).agg(kids)
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256)
        grows = F.col("n") > FANOUT ** (level + up - 1)
        node = F.struct(
            F.col("kids")[0]["lo"].alias("lo"),
            F.element_at("kids", -1)["hi"].alias("hi"),
            F.when(grows, joined).otherwise(F.col("kids")[0]["hash"]).alias("hash"),
            F.col("kids"),
        )
        out = out.select(*keys, "n", "_block", node.alias("node"))
    return out.select(*keys, "n", "node.lo", "node.hi", "node.hash", "node.kids")


def _by_lo(a: Column, b: Column) -> Column:
    return F.when(a["lo"] < b["lo"], -1).when(a["lo"] > b["lo"], 1).otherwise(0)


@dataclass
class Tree:
    """Bands of one forest, lowest first (``keys``, n, lo, hi, hash, kids), and its roots (``keys``, n, root)."""

    keys: list[str]
    bands: list[DataFrame]
    roots: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame, keys: list[str]) -> Tree:
        """From leaves (``keys``, n, lo, hi, hash, further columns): bands are written until every group is one node."""
        bands, roots = [], []
        while True:
            level = BAND * len(bands)
            band = cut(_band(nodes, keys, level), "band")
            bands.append(band)
            top = FANOUT ** (level + BAND)
            roots.append(band.filter(F.col("n") <= top).select(*keys, "n", F.col("hash").alias("root")))
            nodes = band.filter(F.col("n") > top).select(*keys, "n", "lo", "hi", "hash")
            if nodes.isEmpty():
                break
        out = roots[0]
        for r in roots[1:]:
            out = out.union(r)
        return cls(keys, bands, out)

    def paths(self) -> DataFrame:
        """The leaves, each with its ``path``: for each level up to its root, the hashes left and right of its ancestor.

        From the top band down. A block is attached to the node of the band above that covers its interval: both lie
        in one bucket of that level. Within a block, a node's siblings are what its parent's interval holds besides its own.
        """
        above: DataFrame | None = None
        for i in reversed(range(len(self.bands))):
            level = BAND * i
            rows = self.bands[i]
            nothing = F.array().cast("array<struct<left:string,right:string>>")
            if above is None:
                rows = rows.withColumn("path", nothing)
            else:
                bucket = lambda c: F.floor(F.col(c) / F.lit(FANOUT ** (level + BAND))).cast("long")
                rows = rows.withColumn("_bucket", bucket("lo"))
                up = above.select(*[F.col(k).alias(f"_b_{k}") for k in self.keys], bucket("lo").alias("_b__bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "path")
                inside = (up["_lo"] <= rows["lo"]) & (rows["hi"] <= up["_hi"])
                rows = rows.join(up, _join_on(rows, up, [*self.keys, "_bucket"]) & inside, "left")
                rows = rows.select(*self.keys, "n", "kids", F.coalesce("path", nothing).alias("path"))
            for down in reversed(range(BAND)):
                rows = rows.withColumn("kid", F.explode("kids"))
                beside = lambda keep: F.array_join(F.transform(F.filter("kids", keep), lambda k: k["hash"]), "")
                step = F.struct(beside(lambda k: k["hi"] <= F.col("kid.lo")).alias("left"), beside(lambda k: k["lo"] >= F.col("kid.hi")).alias("right"))
                path = F.when(F.col("n") > FANOUT ** (level + down), F.concat(F.array(step), "path")).otherwise(F.col("path"))
                rows = rows.select(*self.keys, "n", path.alias("path"), *([F.col("kid.kids").alias("kids")] if down else ["kid.*"]))
            above = cut(rows.select(*self.keys, "lo", "hi", "path"), "paths") if i else None
        return rows


@dataclass
class Manifest:
    """A dataset's tree: groups' trees of leaves, and the tree of their subroots."""

    groups: Tree
    top: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """Every node of the groups' trees as the manifest table: grp, level, lo, hi, hash (a root once, at its own level)."""
        out = None
        for i, band in enumerate(self.groups.bands):
            rows = band.select("grp", "n", F.explode("kids").alias("node"))
            for down in reversed(range(BAND)):
                level = BAND * i + down
                real = F.lit(True) if level == 0 else F.col("n") > FANOUT ** (level - 1)
                part = rows.filter(real).select("grp", F.lit(level).alias("level"), "node.lo", "node.hi", "node.hash")
                out = part if out is None else out.union(part)
                if down:
                    rows = rows.select("grp", "n", F.explode("node.kids").alias("node"))
            last = BAND * (i + 1)
            if i == len(self.groups.bands) - 1:
                out = out.union(band.filter(F.col("n") > FANOUT ** (last - 1)).select("grp", F.lit(last).alias("level"), "lo", "hi", "hash"))
        return out

    def proofs(self) -> DataFrame:
        """A row for each leaf: id, grp, the columns that travel with it, leaf, subroot, root, and its path from leaf to root."""
        subroots = self.top.paths().select(F.col("grp").alias("_grp"), F.col("hash").alias("subroot"), F.col("path").alias("_path"))
        subroots = cut(subroots, "subroots")
        if subroots.count() <= BROADCAST_GROUPS:
            subroots = F.broadcast(subroots)
        leaves = self.groups.paths()
        out = leaves.join(subroots, leaves["grp"].eqNullSafe(subroots["_grp"]))
        path = F.concat("path", "_path")
        own = [c for c in leaves.columns if c not in ("n", "lo", "hi", "hash", "path")]
        return out.select(*own, F.col("hash").alias("leaf"), "subroot", F.lit(self.root).alias("root"), path.alias("path"))


def build_manifest(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "source", carry: Mapping[str, Column] | None = None) -> Manifest:
    """A Merkle tree over the rows of ``docs``.

    A row is a leaf, the ``record_hash`` of ``columns``. In each group, leaves ascend by id, and every FANOUT consecutive
    nodes become the hash of their hashes until one is left, the subroot; subroots, ordered by group, are combined
    likewise into the root. Nodes are labelled with the interval of leaf ranks that they cover. ``carry`` names
    further columns of a leaf that ``proofs`` returns.

    Whole texts are hashed where they are read; only hashes are shuffled. Null ids come first in their group, null groups
    are one group, the first; a lone leaf is its subroot; rows that share an id are ordered by their hash, and rows alike in
    all columns are leaves of their own; further columns are ignored, whatever their names. An empty table has the root
    None and no leaves.
    """
    own = {"hash": record_hash([F.col(c) for c in columns]), "id": F.col(id_col), **(carry or {})}
    leaves = docs.select(F.col(group_col).cast("string").alias("grp"), *[c.alias(k) for k, c in own.items()])
    groups = Tree.build(_ranked(leaves, ["grp"], [F.col("id").asc_nulls_first(), F.col("hash")]), ["grp"])
    subroots = groups.roots.select("grp", F.col("root").alias("hash"))
    top = Tree.build(_ranked(subroots.withColumn("all", F.lit(0)), ["all"], [F.col("grp").asc_nulls_first()]), ["all"])
    found = top.roots.select("root").first()
    return Manifest(groups, top, found["root"] if found else None)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = record_hash([*[F.col(c) for c in COLUMNS[:-1]], changed])
    proofs = build_manifest(docs, COLUMNS, carry={"tampered": tampered}).proofs()
    out = proofs.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return out.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string in DuckDB: a byte is mixed in, then eight shifts."""
    steps = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, e: {step}), 4294967295::BIGINT)"


def _sql(levels: int = 14, top_levels: int = 6) -> str:
    """DuckDB SQL of op11_merkle for groups of up to 3 ** levels rows and up to 3 ** top_levels groups."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(field(c) for c in ["doc_id", "source", "lang", "n_chars", t]) + ")"
    hit = f"coalesce({crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0, false)"
    parts = [
        f"d AS (SELECT *, CASE WHEN {hit} THEN replace(text, chr(10), '') ELSE text END AS t2 FROM documents)",
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('t2')} AS tampered FROM d)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j FROM l)",
        "n0 AS (SELECT source, j, leaf AS h FROM a0)",
    ]

    def tree(prefix: str, first: str, key: str, depth: int) -> None:
        for k in range(depth):
            parts.append(f"{prefix}c{k} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS m FROM {first if k == 0 else f'{prefix}n{k}'})")
            w = f"OVER (PARTITION BY {key}, j // 3 ORDER BY j ROWS BETWEEN"
            parts.append(
                f"{prefix}s{k} AS (SELECT {key}, j, m > 1 AS real,"
                f" CASE WHEN m > 1 THEN coalesce(string_agg(h, '') {w} 2 PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,"
                f" CASE WHEN m > 1 THEN coalesce(string_agg(h, '') {w} 1 FOLLOWING AND 2 FOLLOWING), '') ELSE '' END AS r FROM {prefix}c{k})"
            )
            parts.append(
                f"{prefix}n{k + 1} AS (SELECT {key}, j // 3 AS j, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY j)) ELSE any_value(h) END AS h"
                f" FROM {prefix}c{k} GROUP BY {key}, j // 3)"
            )

    tree("g", "n0", "source", levels)
    parts.append(f"u0 AS (SELECT source, h, 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM gn{levels})")
    tree("t", "(SELECT one, j, h FROM u0)", "one", top_levels)
    parts.append(f"x0 AS (SELECT a0.doc_id, a0.source, a0.leaf, a0.tampered, a0.j, u0.j AS uj, u0.h AS subroot, (SELECT h FROM tn{top_levels}) AS root, a0.tampered AS f, '' AS p FROM a0 JOIN u0 ON a0.source IS NOT DISTINCT FROM u0.source)")
    at = 0
    for prefix, place, on, depth in (("g", "j", "x.source IS NOT DISTINCT FROM s.source AND ", levels), ("t", "uj", "", top_levels)):
        for k in range(depth):
            parts.append(
                f"x{at + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN s.real THEN sha256(s.l || x.f || s.r) ELSE x.f END AS f, x.p || s.l || s.r AS p)"
                f" FROM x{at} x JOIN {prefix}s{k} s ON {on}x.{place} // {3**k} = s.j)"
            )
            at += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM x{at}"


#: DuckDB SQL of op11_merkle.
SQL = _sql()
