"""Byte-level BPE: ranked merges folded with higher-order functions over the byte arrays of distinct words."""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.common import cut, cut_bucketed, lean, remove, small_batches, temporary
from evenhand.llm.textarrays import slices

#: A piece of a word is one long: rank of the pair it begins (20 bits), its first byte's place (26), its id (17).
ID_BITS, RANK_AT = 17, 43
#: Above every rank: this pair makes no piece.
NONE = (1 << 20) - 1
#: Words of more bytes are merged with a heap where they are met: the fold's time grows with the square of a word.
LONG = 1000
#: Words of a block: texts that are encoded together and share one table of their rarer words.
BLOCK_WORDS = 1 << 20
#: Bytes of text for each bucket of the blocks, and for each part that rarer words are dealt over; and most buckets of a table.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 16
#: Distinct words that are folded in one row.
ROW_WORDS = 1024


@dataclass
class Vocabulary:
    """Ranks of byte strings; a piece's id is its rank."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def pairs(self) -> dict[tuple[int, int], int]:
        """Every pair of pieces that make a piece together, and its rank."""
        out = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    out[a, b] = rank
        return out


class RankMap:
    """The literal rank map: a perfect hash of (left id, right id) in the arrays of one local row.

    ``table`` is that row as a struct: ``s`` has a displacement for each bucket, ``e`` a long for each slot (key * 2^20
    + rank), ``b`` the ids of the 256 bytes. Plans take it as a scalar of a local relation, once, and lambdas bind it: a
    constant in the tasks, which no plan prints (spelled out it is 1.7 MB, twice a plan, and the driver keeps what it prints).
    """

    def __init__(self, spark: SparkSession, vocab: Vocabulary):
        pairs = vocab.pairs()
        if max(vocab.ranks.values(), default=0) >= min(1 << ID_BITS, NONE):
            raise ValueError(f"ids must be below {1 << ID_BITS}")
        keys = np.array(list(pairs) or [(0, 0)], np.int64)
        ranks = np.array(list(pairs.values()) or [NONE], np.int64)
        self.slots = 1 << int(np.ceil(np.log2(len(keys) * 1.3)))
        self.buckets = max(1, self.slots // 4)
        for seed in range(100):
            self.factors = tuple(int(x) | 1 for x in np.random.default_rng(seed).integers(1 << 12, 1 << 20, 3))
            f = self.factors
            home = (keys[:, 0] * f[0] + keys[:, 1] * f[1]) & (self.slots - 1)
            bucket = (keys[:, 0] * f[2] + keys[:, 1]) & (self.buckets - 1)
            shifts = self._place(home, bucket, self.slots, self.buckets)
            if shifts is not None:
                break
        else:
            raise ValueError("no perfect hash found")
        entries = np.full(self.slots, -1, np.int64)
        entries[(home + shifts[bucket]) & (self.slots - 1)] = (((keys[:, 0] << ID_BITS) + keys[:, 1]) << 20) + ranks
        of_byte = np.array([vocab.ranks[bytes([i])] for i in range(256)], np.int64)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        row = spark.createDataFrame(pa.table({"s": one(shifts.astype(np.int32)), "e": one(entries), "b": one(of_byte)}))
        self.table = row.select(F.struct("s", "e", "b")).scalar()

    @staticmethod
    def _place(home: np.ndarray, bucket: np.ndarray, slots: int, buckets: int) -> np.ndarray | None:
        """A displacement for each bucket, fullest first, such that all keys get slots of their own."""
        taken, shifts = np.zeros(slots, bool), np.zeros(buckets, np.int64)
        order = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.argsort(-np.diff(start), kind="stable").tolist():
            own = home[order[start[b] : start[b + 1]]]
            if not len(own):
                break
            if len(np.unique(own)) < len(own):
                return None
            for low in range(0, slots, 512):
                at = (own[None, :] + np.arange(low, low + 512)[:, None]) % slots
                free = np.flatnonzero(~taken[at].any(axis=1))
                if len(free):
                    shifts[b] = low + free[0]
                    taken[at[free[0]]] = True
                    break
            else:
                return None
        return shifts

    def rank(self, table: Column, a: Column, b: Column) -> Column:
        """The rank of the piece that ids ``a`` and ``b`` make, or NONE, in a piece's rank bits."""
        f = self.factors
        shift = F.get(table["s"], (a * f[2] + b).bitwiseAND(self.buckets - 1).cast("int"))
        entry = F.get(table["e"], (a * f[0] + b * f[1] + shift).bitwiseAND(self.slots - 1).cast("int"))
        # the slot's entry less this key is the rank, or below 0 or at least 2^20; without its sign bit, at least 2^20
        rest = (entry - F.shiftleft(F.shiftleft(a, ID_BITS) + b, 20)).bitwiseAND((1 << 63) - 1)
        return F.shiftleft(F.least(rest, F.lit(NONE)), RANK_AT)


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, table: Column, ranks: RankMap) -> Column:
    """Ids of one word, given as an array of byte values, by the rank map's ``table``: merge the leftmost pair of lowest rank until none is left.

    The state is one array of longs, a piece each, so its least value is the leftmost pair of lowest rank. A merge
    looks up the two new pairs only.
    """
    end, below = NONE << RANK_AT, (1 << RANK_AT) - 1
    id_of = lambda v: v.bitwiseAND((1 << ID_BITS) - 1)
    gone = F.lit(-1).cast("bigint")

    def first(ids: Column) -> Column:
        pair = lambda x, i: F.coalesce(ranks.rank(table, x, F.get(ids, i + 1)), F.lit(end))
        return F.transform(ids, lambda x, i: pair(x, i) + F.shiftleft(i.cast("bigint"), ID_BITS) + x)

    def merged(v: Column, least: Column, at: Column) -> Column:
        made = F.shiftright(least, RANK_AT)
        after = F.coalesce(ranks.rank(table, made, id_of(F.get(v, at + 1))), F.lit(end))
        both = after + least.bitwiseAND(below - (1 << ID_BITS) + 1) + made
        before = lambda x: ranks.rank(table, id_of(x), made) + x.bitwiseAND(below)
        piece = lambda x, i: F.when(i > at, x).when(i == at, gone).when(i == at - 1, both).when(i == at - 2, before(x)).otherwise(x)
        return F.array_remove(F.transform(v, piece), gone)

    def step(v: Column) -> Column:
        merge = lambda least: bind(F.array_position(v, least).cast("int"), lambda at: merged(v, least, at))
        return bind(F.array_min(v), lambda least: F.when(least >= end, v).otherwise(merge(least)))

    start = bind(F.transform(word, lambda x: F.get(table["b"], x)), first)
    steps = F.slice(word, 2, F.greatest(F.size(word), F.lit(1)))  # as many as merges can happen
    return F.aggregate(steps, start, lambda v, _: step(v), lambda v: F.transform(v, id_of))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: pairs in a heap, lowest rank and then leftmost first."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(a: int) -> None:
        if a >= 0 and ends[a] < n and (r := ranks.get(word[a : ends[ends[a]]])) is not None:
            heapq.heappush(heap, (r, a, ends[a], ends[ends[a]]))

    while heap:
        _, a, b, c = heapq.heappop(heap)
        if ends[a] != b or b < 0 or ends[b] != c:  # one of the two pieces has been merged meanwhile
            continue
        ends[a], ends[b] = c, -1
        before[c] = a
        push(a)
        push(before[a])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def _count_words(pattern: str):
    """Words by ``pattern`` and how often they occur, summed within a partition; long ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, seen = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(find(text.as_py()))
            if len(seen) > 1 << 17:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    return run


def _counted(seen: Counter) -> pa.RecordBatch:
    own = [(latin(x), n) for x, n in seen.items() if len(x.encode()) <= LONG]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], ["w", "n"])


def latin(word: str) -> str:
    """A word as a string of its UTF-8 bytes, a character each."""
    return word if word.isascii() else word.encode().decode("latin-1")


def _in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in their order, ROW_WORDS to a row at most."""
    for batch in batches:
        cuts = [*range(0, len(batch), ROW_WORDS), len(batch)]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(0))], ["w"])


def _pack_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's (w, ids) as one compressed Arrow stream."""
    rows = [b for b in batches if len(b)]
    if rows:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in rows:
                out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blob"])


def _tables(blobs: list[bytes]) -> list[pa.Table]:
    return [pa.ipc.open_stream(blob).read_all() for blob in blobs]


BLOCK = "block long, keys array<{}>, sizes array<int>, planes binary, rare array<struct<part: int, words: binary>>, far array<struct<pos: int, ids: array<int>>>"


def _pack_words(pos: np.ndarray, words: list[bytes]) -> bytes:
    """Places and words as one compressed string of bytes."""
    head = np.array([len(words)], "<u4").tobytes() + np.diff(pos, prepend=0).astype("<u4").tobytes() + np.array([len(w) for w in words], "<u2").tobytes()
    whole = head + b"".join(words)
    return np.array([len(whole)], "<u4").tobytes() + pa.compress(whole, "zstd", asbytes=True)


def _unpack_words(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    whole = pa.decompress(blob[4:], int(np.frombuffer(blob, "<u4", 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(whole, "<u4", 1)[0])
    pos = np.cumsum(np.frombuffer(whole, "<u4", n, 4).astype(np.int64))
    ends = np.cumsum(np.frombuffer(whole, "<u2", n, 4 + 4 * n).astype(np.int64)) + 4 + 6 * n
    return pos, [whole[a:b] for a, b in zip([4 + 6 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _number(pattern: str, known, ranks, parts: int):
    """Texts as blocks of word numbers: known words by their place in the table, others by their place in the block.

    A block has its texts' ids and numbers of words, the word numbers as four planes of bytes, and the rarer words, dealt
    over parts by hash; long words among these come with their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        fixed: dict[str, int] = {}
        for table in _tables(known.value):
            for w in table["w"].to_pylist():
                fixed[w.encode("latin-1").decode()] = len(fixed)
        pa.default_memory_pool().release_unused()
        keys, sizes, numbers, rare, held = [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            every = np.concatenate(numbers)
            planes = b"".join(((every >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24))
            far, dealt = [], {}
            for i, w in enumerate(rare):
                raw = w.encode()
                if len(raw) > LONG:
                    far.append({"pos": i, "ids": merge_long(raw, ranks.value)})
                else:
                    dealt.setdefault(zlib.crc32(raw) % parts, []).append((i, raw))
            words = [{"part": part, "words": _pack_words(np.array([i for i, _ in own], np.int64), [w for _, w in own])} for part, own in dealt.items()]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().int >> 65]), one(pa.concat_arrays(keys)), one(pa.array(np.concatenate(sizes), pa.int32())),
                    pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary()),
                    one(pa.array(words, pa.struct([("part", pa.int32()), ("words", pa.binary())]))),
                    one(pa.array(far, pa.struct([("pos", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
                ],
                ["block", "keys", "sizes", "planes", "rare", "far"],
            )

        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                raw = data.tobytes()
                keys.append(batch.column(0).slice(first, last - first))
                own = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    tokens = find(raw[a:b].decode())
                    got = list(map(fixed.get, tokens))
                    if None in got:
                        got = [len(fixed) + rare.setdefault(w, len(rare)) if n is None else n for n, w in zip(got, tokens, strict=True)]
                    numbers.append(np.array(got, np.uint32))
                    own.append(len(got))
                sizes.append(np.array(own, np.int32))
                held += sum(own)
                if held >= BLOCK_WORDS:
                    yield block()
                    keys, sizes, numbers, rare, held = [], [], [], {}, 0
        if keys:
            yield block()

    return run


def _distinct(table: pa.Table) -> pa.Table:
    """A part's distinct words, ROW_WORDS to a row, each with the blocks and places where it stands."""
    number: dict[bytes, int] = {}
    word, block, place = [], [], []
    for of, blob in zip(table["of"].to_pylist(), table["words"].to_pylist(), strict=True):
        pos, words = _unpack_words(blob)
        word.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
        block.append(np.full(len(pos), of, np.int64))
        place.append(pos)
    word, block, place = np.concatenate(word), np.concatenate(block), np.concatenate(place)
    order = np.argsort(word, kind="stable")
    word, block, place = word[order], block[order], place[order]
    names, rows = [w.decode("latin-1") for w in number], []
    for a in range(0, len(names), ROW_WORDS):
        lo, hi = np.searchsorted(word, [a, a + ROW_WORDS])
        rows.append((names[a : a + ROW_WORDS], (word[lo:hi] - a).astype("<u4").tobytes(), block[lo:hi].tobytes(), place[lo:hi].astype("<u4").tobytes()))
    kinds = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["w", "word", "of", "pos"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded words as they are needed: for each block the places, sizes and ids of some of its rarer words."""
    for batch in batches:
        found: dict[int, list] = {}
        for r in range(len(batch)):
            ids = batch["ids"][r].values
            strings = Strings(*_flat_lists([ids]))
            word, of, pos = (np.frombuffer(batch[c][r].as_py(), k) for c, k in (("word", "<u4"), ("of", np.int64), ("pos", "<u4")))
            order = np.argsort(of, kind="stable")
            own, start = np.unique(of[order], return_index=True)
            for b, at in zip(own.tolist(), np.split(order, start[1:]), strict=True):
                found.setdefault(b, []).append((pos[at], strings.size[word[at]], strings.take(word[at])))
        packs = []
        for own in found.values():
            pos, size = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
            whole = pos.astype("<u4").tobytes() + size.astype("<u2").tobytes() + b"".join(x[2] for x in own)
            packs.append(np.array([len(pos), len(whole)], "<u4").tobytes() + pa.compress(whole, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(packs, pa.binary())], ["of", "pack"])


class Strings:
    """Strings of bytes or ids, numbered and laid end to end; those of many numbers are gathered at once."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size, self.start = flat, size, np.cumsum(size) - size

    @classmethod
    def of_pieces(cls, pieces: list[bytes]) -> Strings:
        return cls(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def take(self, numbers: np.ndarray) -> bytes:
        out = []
        for lo in range(0, len(numbers), 1 << 18):
            own = numbers[lo : lo + (1 << 18)]
            n = self.size[own]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.start[own] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def _flat_lists(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of lists of ids, one after another: the ids and the lists' sizes."""
    flat = [np.zeros(0, "<u4"), *[c.flatten().to_numpy().astype("<u4") for c in columns]]
    return np.concatenate(flat), np.concatenate([np.zeros(0, np.int64), *[np.diff(c.offsets.to_numpy()).astype(np.int64) for c in columns]])


def _rare_ids(packs: list[bytes], far: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each place, sizes, and ids laid end to end, of a block's rarer words."""
    pos, size, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
    for pack in packs:
        n, length = np.frombuffer(pack, "<u4", 2).tolist()
        whole = pa.decompress(pack[8:], length, "zstd", asbytes=True)
        pos.append(np.frombuffer(whole, "<u4", n).astype(np.int64))
        size.append(np.frombuffer(whole, "<u2", n, 4 * n).astype(np.int64))
        flat.append(np.frombuffer(whole[6 * n :], "<u4"))
    for x in far:
        pos.append(np.array([x["pos"]], np.int64))
        size.append(np.array([len(x["ids"])], np.int64))
        flat.append(np.array(x["ids"], "<u4"))
    pos = np.concatenate(pos)
    row_of = np.zeros(len(pos), np.int64)
    row_of[pos] = np.arange(len(pos))
    return row_of, np.concatenate(size), np.concatenate(flat)


def _assemble(known, pieces):
    """Blocks' texts as ids (with ``pieces``, decoded too), from their word numbers and the ids of their rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, fixed_sizes = _flat_lists([c for t in _tables(known.value) for c in t["ids"].chunks])
        letters = Strings.of_pieces(pieces.value) if pieces is not None else None
        for batch in batches:
            for r in range(len(batch)):
                keys, sizes = batch["keys"][r].values, batch["sizes"][r].values.to_numpy()
                row_of, rare_sizes, rare = _rare_ids(batch["packs"][r].as_py() or [], batch["far"][r].as_py())
                strings = Strings(np.concatenate([fixed, rare]), np.concatenate([fixed_sizes, rare_sizes]))
                total, base = int(sizes.sum()), len(fixed_sizes)
                planes = np.frombuffer(pa.decompress(batch["planes"][r].as_py(), 4 * total, "zstd", asbytes=True) if total else b"", np.uint8).reshape(4, total)
                ends = np.cumsum(sizes)
                for lo in range(0, len(sizes), 1000):
                    hi = min(len(sizes), lo + 1000)
                    first = int(ends[lo] - sizes[lo])
                    numbers = sum(planes[i, first : int(ends[hi - 1])].astype(np.int64) << (8 * i) for i in range(4))
                    own = numbers >= base
                    numbers[own] = base + row_of[numbers[own] - base]
                    cuts = (ends[lo:hi] - first).tolist()
                    ids = [strings.take(numbers[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
                    out = [keys.slice(lo, hi - lo), pa.array(ids, pa.binary())]
                    if letters is not None:
                        out.append(pa.array([letters.take(np.frombuffer(x, "<u4")) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, ["key", "ids", "decoded"][: len(out)])

    return run


class ByteBpe:
    """Encoder and decoder of one vocabulary.

    The words of all texts are split off once; each distinct word is folded once. Words that are frequent in a sample of
    about ``sample_texts`` texts come first: at most ``known_words``, shipped to the tasks as a table. Texts are then
    kept as numbers of words, in blocks. What is not in the table is dealt over parts by hash, so that all that blocks
    have of a word meets in one task; there it is folded once, and its ids go back to the blocks that hold it. What
    the sample holds changes no id.
    """

    def __init__(self, spark: SparkSession, vocab: Vocabulary, sample_texts: int = 25_000, known_words: int = 150_000):
        self.spark, self.vocab = spark, vocab
        small_batches(spark)
        self.sample_texts, self.known_words = sample_texts, known_words
        self.ranks = RankMap(spark, vocab)

    def fold(self, rows: DataFrame) -> DataFrame:
        """Rows with ``w``, words in an array, each a string of bytes, a character each: add ``ids``, those of each word."""
        values = lambda word: F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
        ids = lambda table: F.transform("w", lambda word: F.transform(fold_merges(values(word), table, self.ranks), lambda x: x.cast("int")))
        return rows.withColumn("_ranks", self.ranks.table).withColumn("ids", bind(F.col("_ranks"), ids)).drop("_ranks")

    def _known(self, texts: DataFrame, total: int) -> list[bytes]:
        """Frequent words of a sample of (key, t), with their ids, packed by the tasks that fold them."""
        some = texts.filter(F.pmod(F.xxhash64("key", "t"), F.lit(max(1, total // self.sample_texts))) == 0).select("t")
        counts = cut(some.mapInArrow(lean(_count_words(self.vocab.pattern)), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "counts")
        held, least = 0, 1
        for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
            held += r["words"]
            if held > self.known_words:
                least = r["n"] + 1
                break
        # the most frequent come first: small numbers, whose higher bytes compress to little
        top = cut(counts.filter(F.col("n") >= least).repartitionByRange(16, F.desc("n"), "w").sortWithinPartitions(F.desc("n"), "w"), "top")
        rows = self.fold(top.mapInArrow(lean(_in_rows), "w array<string>")).select(F.explode(F.arrays_zip("w", "ids")).alias("_w")).select("_w.*")
        return [r["blob"] for r in rows.mapInArrow(lean(_pack_table), "blob binary").collect()]

    def _pieces(self):
        pieces = [b""] * (max(self.vocab.ranks.values()) + 1)
        for piece, rank in self.vocab.ranks.items():
            pieces[rank] = piece
        return self.spark.sparkContext.broadcast(pieces)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
        """(``id_col``, ids) of every input row: ids are little-endian unsigned 32-bit integers in a binary column.

        With ``decoded``, also the bytes that the ids decode to, made from the ids where they are put together.

        Each match of the pattern is encoded by itself, without special tokens; a null text is empty and has no
        ids. Whole texts are read; rows keep their ids, repeated or null; an empty table gives an empty table; only
        the two named columns are read. Words of more than LONG bytes are merged with a heap, not with the fold.
        """
        texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
        total = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
        context, parts = self.spark.sparkContext, 1 + total["bytes"] // BUCKET_BYTES
        buckets = min(parts, MOST_BUCKETS)
        with temporary(self.spark):
            known = context.broadcast(self._known(texts, total["n"]))
        kind = texts.schema["key"].dataType.simpleString()
        blocks = texts.mapInArrow(lean(_number(self.vocab.pattern, known, context.broadcast(self.vocab.ranks), parts)), BLOCK.format(kind))
        if parts > buckets:  # a bucket holds many blocks: they meet first, so that it is one file
            blocks = blocks.repartition(buckets, "block")
        blocks = cut_bucketed(blocks, "block", buckets, "blocks")
        met = blocks.select(F.col("block").alias("of"), F.inline("rare")).select("of", "part", "words")
        words = cut(met.groupBy("part").applyInArrow(_distinct, "w array<string>, word binary, of binary, pos binary"), "words")
        folded = self.fold(words).select("ids", "word", "of", "pos")
        packs = cut(folded.mapInArrow(lean(_by_block), "of long, pack binary"), "packs")
        remove(self.spark, words.scratch_path)
        packs = packs.repartition(buckets, "of").groupBy("of").agg(F.collect_list("pack").alias("packs"))  # a block's own words
        out = blocks.join(packs.hint("merge"), F.col("block") == F.col("of"), "left").select("keys", "sizes", "planes", "packs", "far")
        schema = f"key {kind}, ids binary" + ", decoded binary" * decoded
        return out.mapInArrow(lean(_assemble(known, self._pieces() if decoded else None)), schema).withColumnRenamed("key", id_col)

    def decode(self, encoded: DataFrame, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
        """Add ``to``, the pieces of ``ids_col`` one after another, as binary. Null stays null; unknown ids are an error."""
        shared = self._pieces()

        @F.arrow_udf("binary")
        def join(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            letters = Strings.of_pieces(shared.value)
            for column in columns:
                yield pa.array([None if x is None else letters.take(np.frombuffer(x, "<u4")) for x in column.to_pylist()], pa.binary())

        return encoded.withColumn(to, join(F.col(ids_col)))


def digests(encoded: DataFrame, id_col: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return encoded.select(
        id_col,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bpe = ByteBpe(spark, public_vocabulary())
    return digests(bpe.encode(docs, decoded=True), "doc_id")
