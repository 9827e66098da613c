"""N-gram Jaccard join: prefix filtering under one global order, verified along a prefix tree.

1. Every text becomes its set of 64-bit shingle hashes. The sum of a set's hashes names the set, so copies collapse to
   one node before anything is compared, and rows that repeat an id with different texts are several sets of one id.
2. The global order puts rare shingles first. Its key is (level of the shingle's cell, hash), where the level is the
   logarithm of how many sets of the whole table hold shingles of the cell: a table of fixed size, whatever the
   corpus. Any order gives the same links; a good one gives fewer candidates.
3. Sets that are similar enough share a shingle among their first ``n - ceil(t * n) + 1``. Those prefixes are dealt
   out by hash range, packed, over as many tasks as their number asks for; what only one set has is dropped there.
   Shingles of very many sets are dealt by set as well, so that no task holds all of one.
4. Shingles that the same sets share are one group, weighted by their number. In each group, one member (a hub) is
   compared with the others: linear in the group. In groups that the links so found leave in several components,
   rounds of probes follow: a probe meets the members of other components in all its groups, then leaves them all.
   Groups have an order, small ones first, and the first group that a pair shares must leave both enough shingles in
   it and after it; so in hot groups, which come last, hardly any members meet.
   A round takes as many probes as keep the pairs that pass this test in proportion to the groups' rows: where few
   pass, the next round tests some times as many. Rounds go on, each with the rows that are left, until no group is in
   several components, so no link that could join two components goes unchecked. Pairs that share too few
   prefix shingles to link, given their sizes, are never compared. Links of a round spare later ones pairs; a group
   whose n members do not link still costs n * n / 2 tests over all rounds.
5. A comparison loads candidates of one hub, a bounded block at a time, into a prefix tree in global order and walks
   it once: branches share their overlap with the hub, and a branch is left as soon as its overlap so far plus what
   remains cannot reach the least overlap any of its sets needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import cut, lean, release, remove, small_batches, temporary
from evenhand.llm.components import components
from evenhand.llm.textarrays import mix64, shingle_sets, slices

#: Cells of the level table: one byte each on every worker.
CELLS = 1 << 20
#: Candidates of one hub that one task compares at a time.
BLOCK = 256
#: Document ids up to this many are broadcast to pick texts (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Pairs of a round of probes that pass on: about this many for each row of the groups, or the floor where that is more.
PROBE_RATIO, PROBE_FLOOR = 8, 500_000
#: A round tests so many pairs at first, and up to this many times those of the round before.
PROBE_GROWTH = 8
#: Groups of more bytes hand their memory back when they are compared.
LARGE_GROUP = 1 << 20
#: Cells of the level table that are added up in one row.
CHUNK = 1 << 14
#: Prefix entries a task holds before it passes them on, and how many meet in one task.
FLUSH, ENTRIES = 1 << 18, 1 << 20
#: Shingles of cells of this level (the logarithm of its count) are dealt by set, too.
HOT_LEVEL = 20
#: Copies of the smaller side of a join whose key may be hot, where it is too large to broadcast.
SALTS = 16


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with one row of ``right`` for each key, though a key may hold a third of ``left``."""
    if right.count() <= BROADCAST_IDS:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def _cell(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(44)).astype(np.int64)


def _ordered(u: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A sorted set in global order: by level, then hash."""
    return u[np.argsort(levels[_cell(u)], kind="stable")]


def least_overlap(n: int, m: int, t: float) -> int:
    """The least intersection of sets of n and m members with Jaccard similarity t or more; exact for t in hundredths."""
    pct = round(t * 100)
    return -(-pct * (n + m) // (100 + pct))


def prefix_length(n: int, t: float) -> int:
    pct = round(t * 100)
    return n - -(-pct * n // 100) + 1 if n else 0


def set_name(u: np.ndarray) -> int:
    """The sum of a set's hashes as a signed 64-bit integer."""
    return int(u.sum(dtype=np.uint64).astype(np.int64))


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            ns, names = [], []
            for _, _, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                ns += [len(u) for u in sets]
                names += [set_name(u) for u in sets]
                np.add.at(counts, _cell(np.concatenate(sets)), 1)
            yield _profile_rows(batch.column(0), batch.column(2), ns, names, [None] * len(batch))
        if counts.any():
            yield _profile_rows(pa.array([None], pa.int64()), pa.array([0], pa.int64()), [-1], [0], [zlib.compress(counts.tobytes(), 1)])

    return run


def _profile_rows(ids: pa.Array, h: pa.Array, ns: list, names: list, seen: list) -> pa.RecordBatch:
    cols = [ids, h, pa.array(ns, pa.int64()), pa.array(names, pa.int64()), pa.array(seen, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["id", "h", "n", "s", "seen"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's packed counts, added up and cut into chunks of cells."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            counts += np.frombuffer(zlib.decompress(blob), np.int64)
    if counts.any():
        parts = [counts[a : a + CHUNK].tobytes() for a in range(0, CELLS, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["chunk", "blob"])


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(blob, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "blob"])


def _prefixes(levels, k: int, t: float, ranges: int):
    def pack(tok: np.ndarray, name: np.ndarray, n: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        part = (np.where(hot, mix64(tok ^ name.view(np.uint64)), tok) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, tok, name, n, hot = part[order], tok[order], name[order], n[order], hot[order]
        own, at = np.unique(part, return_index=True)
        ends = [*at[1:].tolist(), len(part)]
        blobs = []
        for a, b in zip(at.tolist(), ends, strict=True):
            blobs.append(b"".join([np.int64(b - a).tobytes(), tok[a:b].tobytes(), name[a:b].tobytes(), n[a:b].astype(np.int32).tobytes(), hot[a:b].tobytes()]))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(blobs, pa.binary())], ["part", "blob"])

    def flush(held: list) -> pa.RecordBatch:
        lens = [len(h[0]) for h in held]
        tok = np.concatenate([h[0] for h in held])
        name, n = (np.repeat(np.array([h[i] for h in held], np.int64), lens) for i in (1, 2))
        return pack(tok, name, n, levels.value[_cell(tok)] >= HOT_LEVEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in slices(batch.column(1)):
                own = ids.slice(first, last - first).is_valid().to_pylist()
                for valid, u in zip(own, shingle_sets(data, offsets, k), strict=True):
                    name = set_name(u)
                    if not valid or not len(u) or name in seen:  # what this task has dealt out already is a copy
                        continue
                    seen.add(name)
                    head = _ordered(u, levels.value)[: prefix_length(len(u), t)]
                    held.append((head, name, len(u)))
                    size += len(head)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the packed prefixes of this partition's hash ranges, the entries of shingles that two or more sets have.

    Hot shingles are dealt by set, so each of their entries goes on as it is.
    """
    tok, doc, n, hot = [], [], [], []
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            size = int(np.frombuffer(blob, np.int64, 1)[0])
            tok.append(np.frombuffer(blob, np.uint64, size, 8))
            doc.append(np.frombuffer(blob, np.int64, size, 8 + 8 * size))
            n.append(np.frombuffer(blob, np.int32, size, 8 + 16 * size))
            hot.append(np.frombuffer(blob, bool, size, 8 + 20 * size))
    if not tok:
        return
    cols = [np.concatenate(tok), np.concatenate(doc), np.concatenate(n), np.concatenate(hot)]
    tok, doc, n, hot, batch, blob = [], [], [], [], None, None
    rows = np.lexsort((cols[1], cols[0]))
    t, d = cols[0][rows], cols[1][rows]
    rows = rows[np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])]  # copies of a set come from several tasks
    t = d = None
    for i in range(len(cols)):  # one after another: a task holds its entries once
        cols[i] = cols[i][rows]
    t, d, m, hot = cols
    cols, rows = [], None
    if hot.any():
        yield from _entries(mix64(t[hot]).view(np.int64), d[hot], m[hot].astype(np.int64), np.ones(int(hot.sum()), np.int64))
        t, d, m = t[~hot], d[~hot], m[~hot]
    if not len(t):
        return
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(start, len(t)))
    many = np.repeat(size > 1, size)
    t, d, m = t[many], d[many], m[many]
    if not len(t):
        return
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(start, len(t)))
    # groups of the same members become one, with the number of their shingles as its weight
    members = np.add.reduceat(mix64(d.view(np.uint64)), start) + size.astype(np.uint64)
    key, at, weight = np.unique(members, return_index=True, return_counts=True)
    rows = np.repeat(start[at] - np.concatenate([[0], np.cumsum(size[at])[:-1]]), size[at]) + np.arange(size[at].sum())
    yield from _entries(np.repeat(key, size[at]).view(np.int64), d[rows], m[rows].astype(np.int64), np.repeat(weight, size[at]))


def _entries(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in columns], ["grp", "rep", "n", "w"])


class Branch:
    """A node of the prefix tree: the run of shingles that leads to it, its children, the sets that end here."""

    __slots__ = ("children", "ends", "least", "longest", "run", "shortest")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.shortest, self.longest = 1 << 62, 0


def build_tree(sets: list[np.ndarray]) -> Branch:
    """A path-compressed trie of sets in global order; each node knows the sizes of the sets below it."""
    root = Branch(np.zeros(0, np.uint64))
    for i, s in enumerate(sets):
        node, at, n = root, 0, len(s)
        node.shortest, node.longest = min(node.shortest, n), max(node.longest, n)
        while at < n:
            head = int(s[at])
            child = node.children.get(head)
            if child is None:
                child = node.children[head] = Branch(s[at:])
                at = n
            else:
                length = min(len(child.run), n - at)
                differ = np.flatnonzero(child.run[:length] != s[at : at + length])
                same = int(differ[0]) if len(differ) else length
                if same < len(child.run):  # split the run
                    upper = Branch(child.run[:same])
                    upper.shortest, upper.longest = child.shortest, child.longest
                    child.run = child.run[same:]
                    upper.children[int(child.run[0])] = child
                    node.children[head] = child = upper
                at += same
            node = child
            node.shortest, node.longest = min(node.shortest, n), max(node.longest, n)
        node.ends.append((i, n))
    return root


def walk_tree(root: Branch, hub: np.ndarray, t: float) -> list[int]:
    """Numbers of the tree's sets whose Jaccard similarity with ``hub`` (a sorted set) is ``t`` or more."""
    h, found = len(hub), []
    pct = round(t * 100)
    stack = [(root, 0, 0)]
    while stack:
        node, depth, overlap = stack.pop()
        if 100 * node.shortest > h * 10000 / pct or 100 * node.longest < pct * h:
            continue
        if len(node.run):
            at = np.minimum(np.searchsorted(hub, node.run), h - 1)
            hits = hub[at] == node.run
            overlap += int(hits.sum())
            depth += len(node.run)
        if overlap + min(node.longest - depth, h - overlap) < least_overlap(h, max(node.shortest, depth), t):
            continue
        for i, n in node.ends:
            if overlap >= least_overlap(h, n, t):
                found.append(i)
        for child in node.children.values():
            stack.append((child, depth, overlap))
    return found


def _compare(levels, k: int, t: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        column = table.column("text")
        hub_name = key[0].as_py()
        names = table.column("s").to_pylist()
        hub, sets, who, at = None, [], {}, 0
        for chunk in column.chunks:
            for first, last, data, offsets in slices(chunk):
                for i, u in zip(range(at + first, at + last), shingle_sets(data, offsets, k), strict=True):
                    if names[i] == hub_name:
                        hub = u
                    elif names[i] not in who:  # a row may be repeated
                        who[names[i]] = None
                        sets.append(_ordered(u, levels.value))
            at += len(chunk)
        who = list(who)
        linked = [who[i] for i in walk_tree(build_tree(sets), hub, t)] if hub is not None and len(hub) and sets else []
        if table.nbytes > LARGE_GROUP:
            hub = sets = None
            release()
        return pa.table({"a": pa.array([hub_name] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


class NgramJoin:
    """The join over one table; ``run`` gives the result."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.75, hubs: int = 3):
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
        self.k, self.t, self.hubs = k, threshold, hubs
        self.spark = docs.sparkSession
        small_batches(self.spark)

    def _levels(self, profile: DataFrame):
        parts = profile.filter("n = -1").select("seen").mapInArrow(lean(_chunks), "chunk long, blob binary")
        counts = np.zeros(CELLS, np.int64)
        for r in parts.repartition(CELLS // CHUNK, "chunk").mapInArrow(lean(_add_chunks), "chunk long, blob binary").collect():  # 8 bytes a cell
            counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["blob"], np.int64)
        table = np.log2(np.maximum(counts, 1)).astype(np.uint8)
        return self.spark.sparkContext.broadcast(table)

    def _pick(self, wanted: DataFrame) -> DataFrame:
        """Texts of ``wanted`` (s, hub, salt): those of the sets' representatives, by id and hash of the text."""
        wanted = cut(wanted.join(self.sets.select("s", "rep", "h"), "s"), "wanted")
        ids = wanted.select(F.col("rep").alias("id"), "h").distinct()
        texts = self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["id", "h"], "left_semi")
        return texts.withColumnRenamed("id", "rep").join(wanted, ["rep", "h"]).select("hub", "salt", "s", "text")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a: hub, b), those that link."""
        sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
        dealt = pairs.join(sizes, "a")
        salt = F.pmod(F.xxhash64("b"), F.col("blocks"))
        members = dealt.select(F.col("b").alias("s"), F.col("a").alias("hub"), salt.alias("salt"))
        own = members.select("hub", "salt").distinct().select(F.col("hub").alias("s"), "hub", "salt")
        return self._pick(members.union(own)).groupBy("hub", "salt").applyInArrow(_compare(self.levels, self.k, self.t), "a long, b long")

    def _may_link(self, n: str, c: str, m: str, d: str):
        """False for pairs of sets (sizes n, m; c, d prefix shingles that others have too) that cannot link.

        Up to where the first of the two prefixes ends, both sets are known, and they share no more than the lesser
        of c and d there; after it, no more than what is left of that set.
        """
        pct = round(self.t * 100)
        n, m = F.col(n), F.col(m)
        return (n * 100 >= m * pct) & (m * 100 >= n * pct) & (F.least(F.col(c), F.col(d)) >= self._least_shared(n, m))

    def _fresh(self, pairs: DataFrame, done: DataFrame | None) -> DataFrame:
        """Distinct pairs (a, b), unordered, that were not compared before."""
        pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti").join(done.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        return cut(pairs, "pairs")

    def _placed(self, groups: DataFrame, comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return groups.withColumn("comp", F.col("rep"))
        return groups.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def _stars(self, placed: DataFrame) -> DataFrame:
        """Pairs of each group's hub with the members of other components.

        The hub is the member outside the group's largest component whose prefix others share most, as what lies
        in the middle of a cluster has fewest shingles of its own.
        """
        score = F.struct((F.col("c") / F.col("n")).alias("s"), (-F.col("rep")).alias("x"), "n", "c", "comp")
        held = placed.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("held"), F.max(score).alias("best"))
        largest = held.groupBy("grp").agg(F.max(F.struct("held", "comp")).alias("main"))
        several = held.join(largest, "grp").filter((F.col("comp") != F.col("main.comp")) | (F.col("main.held") == 1))
        hub = several.groupBy("grp").agg(F.max("best").alias("h"))
        hub = hub.select("grp", (-F.col("h.x")).alias("x"), F.col("h.n").alias("m"), F.col("h.c").alias("d"), F.col("h.comp").alias("hub_comp"))
        return placed.join(hub, "grp").filter("comp <> hub_comp").filter(self._may_link("n", "c", "m", "d")).select("x", F.col("rep").alias("y"))

    def _live(self, placed: DataFrame) -> DataFrame:
        """Rows of groups (with ``r``, the prefix shingles a member has in this group and later ones) that can meet another.

        Sets whose prefixes must share ``least`` shingles have, at the first group they share, ``least`` or more in it
        and later groups. ``least`` falls as sizes part, so the group's extreme sizes give its lowest value.
        """
        pct = round(self.t * 100)
        held = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        after = Window.partitionBy("rep").orderBy("k", "grp").rowsBetween(0, Window.unboundedFollowing)
        rows = placed.join(held, "grp").withColumn("r", F.sum("w").over(after))
        low, high = F.greatest("lo", F.ceil(F.col("n") * pct / 100)), F.least("hi", F.floor(F.col("n") * 100 / pct))
        least = F.least(self._least_shared(F.col("n"), low), self._least_shared(F.col("n"), high))
        rows = cut(rows.filter(F.col("r") >= least).select("grp", "rep", "n", "w", "comp", "r"), "live")
        mixed = rows.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("grp")
        return cut(rows.join(mixed, "grp"), "live")

    def _least_shared(self, n, m):
        pct = round(self.t * 100)
        return F.ceil((n + m) * pct / (100 + pct) - 1e-9) - F.ceil(F.greatest(n, m) * pct / 100) + 1

    def _probes(self, rows: DataFrame, turn: int, limit: int) -> tuple[DataFrame | None, bool]:
        """The members (rep) that this round compares with all others in their groups (None where no group is mixed); if they are the last.

        A member of the largest component of each of its groups is no probe: the others meet it. Of the rest, a hash
        takes the share that tests ``limit`` pairs, and one more, so that every round gets on.
        """
        sizes = rows.select("comp", "rep").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("csize"))
        held = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("held"))
        held = spread_join(held, cut(sizes, "sizes"), "comp")
        whole = held.groupBy("grp").agg(F.sum("held").alias("k"), F.max(F.struct("csize", "comp")).alias("top"))
        below = F.struct("csize", "comp") < F.col("top")
        meets = held.join(whole, "grp").select("grp", "comp", (F.col("k") - F.col("held")).alias("meets"), below.alias("below"))
        cost = rows.select("grp", "rep", "comp").join(meets, ["grp", "comp"]).groupBy("rep").agg(F.sum("meets").alias("cost"), F.max("below").alias("below"))
        cost = cut(cost.filter("below").select("rep", "cost"), "cost")
        total = cost.agg(F.sum("cost")).first()[0]
        if total is None:
            return None, True
        if total <= limit:
            return cost, True
        some = cost.filter(F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 20)) < int(limit / total * (1 << 20)))
        return cut(some.select("rep").union(cost.orderBy("cost", "rep").limit(1).select("rep")).distinct(), "probes"), False

    def _meetings(self, rows: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Pairs of probes with members of other components that may link, by the shingles both have in their prefixes.

        Of the groups that a pair shares, those up to some place in the order pass the filter; after the last of them,
        the pair shares no more than either has left. Also the rows with their part (``probe``), and how often pairs
        passed the filter.
        """
        rows = rows.join(probes.select("rep", F.lit(True).alias("probe")), "rep", "left").withColumn("probe", F.col("probe").isNotNull())
        rows = cut(rows, "probed")
        own = rows.filter("probe").select("grp", F.col("rep").alias("x"), F.col("n").alias("m"), F.col("r").alias("q"), F.col("comp").alias("hub_comp"))
        met = rows.join(own, "grp").filter("comp <> hub_comp AND NOT (probe AND rep < x)").filter(self._may_link("n", "r", "m", "q"))
        both = (F.sum("w") + F.min(F.least("r", "q") - F.col("w"))).alias("both")
        met = cut(met.groupBy("x", F.col("rep").alias("y"), "n", "m").agg(both, F.count(F.lit(1)).alias("times")), "met")
        found = met.filter(F.col("both") >= self._least_shared(F.col("n"), F.col("m"))).select("x", "y")
        return found, rows, met.agg(F.sum("times")).first()[0] or 0

    def _merged(self, comp: DataFrame | None, more: DataFrame) -> DataFrame:
        """Components after more links: those that a link joins take the least label."""
        if comp is None:
            return components(more)
        at = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        joined = more.join(at("a"), "a", "left").join(at("b"), "b", "left")
        joined = cut(joined.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "joined")
        low = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("low"))
        alone = joined.select(F.col("a").alias("node")).union(joined.select("b")).distinct().join(comp, "node", "left_anti")
        every = comp.union(alone.select("node", F.col("node").alias("comp")))
        return cut(spread_join(every, low, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "comps")

    def run(self) -> DataFrame:
        """(id, n, comp) of every input row."""
        with temporary(self.spark) as keep:
            profile = cut(self.docs.mapInArrow(lean(_profile(self.k)), "id long, h long, n long, s long, seen binary"), "profile")
            self.levels = self._levels(profile)
            rows = profile.filter("n >= 0").select("id", "h", "n", "s")
            own = rows.filter("n > 0 AND id IS NOT NULL")
            first = F.min(F.struct("id", "h"))
            self.sets = cut(own.groupBy("s").agg(first.alias("_f"), F.max("n").alias("n")).select("s", "n", "_f.h", F.col("_f.id").alias("rep")), "sets")
            several = own.groupBy("id").agg(F.min("s").alias("a"), F.max("s").alias("z")).filter("a <> z").select("id", "a")
            same = cut(own.select("id", F.col("s").alias("b")).join(several, "id").filter("a <> b").select("a", "b").distinct(), "same")
            links = self._links(self._groups())
            comp = components(same if links is None else links.union(same))
            least = comp.join(self.sets.select(F.col("s").alias("node"), "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
            least = cut(least, "least")
            keep(profile, self.sets, comp, least)
        known = spread_join(comp, least, "comp").select(F.col("node").alias("s"), "least")
        named = self.sets.select("s", "rep").join(known, "s", "left").select("s", F.coalesce("least", "rep").alias("comp"))
        found = rows.filter("n > 0").join(named, "s", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("comp")).alias("comp"))
        bare = rows.filter("n = 0").select("id", "n")
        others = own.select("id", "s").join(bare.select("id").distinct(), "id", "left_semi").join(named, "s").groupBy("id").agg(F.min("comp").alias("comp"))
        return found.union(bare.join(others, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp")))

    def _groups(self) -> DataFrame:
        """(grp, rep, n, w): the sets that share prefix shingles, and how many they share."""
        entries = self.sets.agg(F.sum(self._prefix(F.col("n")))).first()[0] or 0
        tasks = 1 + int(entries) // ENTRIES
        packed = self.docs.select("id", "text").mapInArrow(lean(_prefixes(self.levels, self.k, self.t, 64 * tasks)), "part long, blob binary")
        dealt = packed.repartition(max(tasks, self.spark.sparkContext.defaultParallelism), "part").select("blob")
        shared = dealt.mapInArrow(lean(_shared), "grp long, rep long, n long, w long")
        return cut(shared.groupBy("grp", "rep").agg(F.first("n").alias("n"), F.sum("w").alias("w")), "groups")

    def _links(self, groups: DataFrame) -> DataFrame | None:
        """(a, b): links that connect whatever any links connect; None where there are none."""
        links = done = comp = probed = None
        for turn in count(1):
            with temporary(self.spark) as keep:
                if turn <= self.hubs:
                    if comp is not None:  # only groups in more than one component can still hold a link that matters
                        placed = cut(self._placed(groups, comp), "placed")
                        mixed = placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("grp")
                        old, groups = groups, cut(placed.join(mixed, "grp").select("grp", "rep", "n", "w"), "groups")
                        remove(self.spark, old.scratch_path)
                    keep(groups)
                    counts = groups.groupBy("rep").agg(F.sum("w").alias("c"))
                    placed = cut(self._placed(groups.join(counts, "rep"), comp), "placed")
                last = False
                if turn < self.hubs:
                    found = self._stars(placed)
                else:
                    # what a member has in a group and later ones stays a bound while others leave: rows are laid out once
                    rows = self._live(placed) if probed is None else cut(self._placed(probed.filter("NOT probe").drop("probe", "comp"), comp), "rows")
                    if probed is not None:
                        remove(self.spark, probed.scratch_path)
                    most = max(PROBE_FLOOR, PROBE_RATIO * rows.count())
                    limit = most if probed is None else max(most, min(PROBE_GROWTH * limit, limit * most // max(passed, 1)))
                    probes, last = self._probes(rows, turn, limit)
                    if probes is None:
                        return links
                    found, probed, passed = self._meetings(rows, probes)
                    keep(probed)
                pairs = self._fresh(found, done)
                if not pairs.isEmpty():
                    more = cut(self._verify(pairs), "links")
                    if turn < self.hubs:  # probes leave, so no later round meets them again
                        done = pairs if done is None else done.union(pairs)
                        keep(pairs)
                    if not more.isEmpty():
                        links = more if links is None else links.union(more)
                        keep(more)
                        if not last:
                            comp = self._merged(comp, more)
                            keep(comp)
                if last:
                    return links

    def _prefix(self, n):
        return n - F.ceil(n * round(self.t * 100) / 100 - 1e-9) + 1


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.75) -> DataFrame:
    """(``id_col``, n_shingles, component_id) of every input row, where links are pairs of sets with similarity >= threshold.

    A text's set is its distinct ``k``-word shingles, A-Z lower-cased; a text with fewer words is one shingle. Null
    and empty texts have empty sets and link with nothing. component_id is the smallest id that links reach; equal
    texts share it. Rows that repeat an id are one node with several sets: what any of its texts links with is in its
    component, and each row has the number of its own text. Rows with a null id get a null component and link with
    nothing. Ties have no part in the result; long texts are read in whole; an empty table gives an empty table. Only
    the two named columns are read. Shingles and sets are told apart by 64-bit hashes.
    """
    out = NgramJoin(docs, id_col, text_col, k, threshold).run()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
