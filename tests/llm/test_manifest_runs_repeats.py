"""The Merkle manifest, periodic runs and repeated passages against plain versions, and their edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import merkle, periods, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("lo", "hi", "n", "hash", "kids", "path", "grp", "id", "runs", "kept", "spans", "marks", "doc", "h")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """(root, paths): every three consecutive nodes become one until one is left."""
    paths = [[] for _ in nodes]
    level = [(h, [i]) for i, h in enumerate(nodes)]
    while len(level) > 1:
        level, below = [], level
        for a in range(0, len(below), 3):
            run = below[a : a + 3]
            for x, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append(("".join(r[0] for r in run[:x]), "".join(r[0] for r in run[x + 1 :])))
            level.append((sha(*[r[0] for r in run]), [i for r in run for i in r[1]]))
    return level[0][0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, plain_leaf([r[0], r[3], r[2], r[4], r[1]]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            out.append((x[3][0], x[2], trees[g][0], root, tuple(path + up)))
    return sorted(out, key=str)


def test_manifest_matches_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 2)  # three bands for the largest group
    rows = [(i, f"text {i % 7}\nü", "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 9}", i) for i in range(230)]
    rows += [(None, None, None, None, None), (None, "", "de", None, 1), (5, "again", "en", "hot", 2), (5, "again", "en", "hot", 2), (900, "x" * 50_000, "en", "lone", 3)]
    df = spark.createDataFrame(rows, DOCS)
    df = df.withColumns({c: F.lit("clash") for c in CLASH})
    made = merkle.build_manifest(df, merkle.COLUMNS)
    proofs = made.proofs()
    got = proofs.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted([(r["id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"])) for r in got], key=str) == plain_manifest(rows)
    assert all(r["folded"] == r["root"] for r in got)
    nodes = made.nodes().collect()
    for grp, n in made.groups.roots.select("grp", "n").collect():
        own, size, level = [x for x in nodes if x["grp"] == grp], n, 0
        while True:
            at = sorted((x["lo"], x["hi"]) for x in own if x["level"] == level)
            assert at == [(a * 3**level, min(n, (a + 1) * 3**level)) for a in range(size)]
            if size == 1:
                break
            size, level = -(-size // 3), level + 1
        assert len({x["level"] for x in own}) == level + 1


def test_manifest_ignores_the_layout_and_sees_every_change(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}", i) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    root = merkle.build_manifest(df, merkle.COLUMNS).root
    assert merkle.build_manifest(df.repartition(5).orderBy(F.desc("text")), merkle.COLUMNS).root == root
    changed = df.withColumn("text", F.when(F.col("doc_id") == 17, "text 17 ").otherwise(F.col("text")))
    assert merkle.build_manifest(changed, merkle.COLUMNS).root != root
    empty = merkle.build_manifest(df.limit(0), merkle.COLUMNS)
    assert empty.root is None and empty.proofs().count() == 0
    one = merkle.build_manifest(df.limit(1), merkle.COLUMNS).proofs().first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def plain_runs(w, exponent, least):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_match_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.integers(1, 5)):
            w = rng.integers(0, rng.integers(1, 4), rng.integers(0, 60)).tolist()
            unit = rng.integers(0, 5, rng.integers(1, 12)).tolist()
            docs.append(w[:5] + (unit * 8)[: rng.integers(0, 8 * len(unit))] + w[5:])
        sizes = [len(d) for d in docs]
        ends = np.cumsum(sizes)
        exponent, least = int(rng.integers(3, 5)), int(rng.integers(1, 8))
        got = periods.find_runs(np.array([x + 100 * i for i, d in enumerate(docs) for x in d], np.int64), np.repeat(ends, sizes), exponent, least)
        want = [(int(e) - len(d) + s, n, q) for d, e in zip(docs, ends, strict=True) for s, n, q in plain_runs(d, exponent, least)]
        assert list(zip(*[x.tolist() for x in got], strict=True)) == want


def test_runs_of_texts(spark):
    texts = [None, "", " \n ", "a", "a a a a a a", "x " + "go on " * 9 + "end", "A a " * 2, "ü\tü\nü ü\vü\fü\rü", "b c " * 40_000, "           "]
    df = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = periods.periodic_runs(df.withColumn("clash", F.lit(1)), ["doc_id", "text", "clash"], F.col("text")).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        w = (r["text"] or "").encode().split()
        want = [(0, len(w), 2)] if len(w) > 1000 else plain_runs(w, 4, 6)
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert periods.periodic_runs(df.limit(0), ["doc_id"], F.col("text")).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(df.withColumn("runs", F.lit(1)), ["runs"], F.col("text"))
    with pytest.raises(ValueError):
        periods.periodic_runs(df, ["doc_id"], F.col("text"), exponent=2)


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(120)] + [(None, "a b"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in df.select("doc_id", "text", periods.planted(F.col("doc_id"), F.col("text")).alias("t")).collect():
        w, want = (r["text"] or "").split(), r["text"]
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            want = " ".join(x if i < a else w[a + (i - a) % p] for i, x in enumerate(w))
        assert r["t"] == want


def plain_repeats(rows, window):
    first, out = {}, []
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1) if doc is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    for doc, text in rows:
        w, gone = (text or "").encode().split(), set()
        for i in range(len(w) - window + 1) if doc is not None else ():
            if first[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, text, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [4096, 2])  # subtrees, and prefixes that are lengthened to whole windows
@pytest.mark.parametrize("window", [1, 4, 9])
def test_repeats_match_a_plain_search(spark, monkeypatch, limit, window):
    monkeypatch.setattr(substrings, "GROUP_CONTEXTS", limit)
    rng = np.random.default_rng(window)
    rows = []
    for _ in range(70):
        w = [str(x) for x in rng.integers(0, 3 if window < 5 else 2, rng.integers(0, 40))]
        rows.append((int(rng.integers(0, 60)) if rng.random() < 0.95 else None, " ".join(w) if rng.random() < 0.95 else None))
    rows += rows[:5] + [(70, ""), (71, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})
    got = substrings.remove_repeats(df, ["doc_id", "text"], window=window)
    assert sorted([(r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()], key=str) == plain_repeats(rows, window)
    assert got.filter("n_removed <> aggregate(removed, 0L, (a, s) -> a + s.length)").count() == 0


def test_repeats_of_long_and_copied_texts(spark):
    words = [f"w{i}" for i in range(900)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(words[:200])) for i in range(40)]  # copies
    rows += [(100 + i, " ".join([f"x{i}", *passage, f"y{i}", *words[i : i + 49]])) for i in range(30)]  # a shared passage, and 49 words that are too few
    rows += [(200, "same " * 5000), (201, "same " * 300), (202, "Same " * 60), (203, " ".join(words * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(df, ["doc_id", "text"])
    assert sorted([(r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()], key=str) == plain_repeats(rows, 50)
    assert substrings.remove_repeats(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(df.withColumn("kept", F.lit(1)), ["kept"])


@pytest.mark.parametrize("module,name", [(merkle, "op11_merkle"), (periods, "op12_periods"), (substrings, "op13_substrings")])
def test_queries_match_their_sql(spark, sf_dir, module, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = getattr(module, name)(spark, sf_dir)
    want = con.sql(module.SQL)
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({module.SQL})").fetchall(), key=str)
