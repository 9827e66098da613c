"""Edge cases of every corpus operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import bpe, hamming, langid, line_rules, mixing, ngram_join, shards, toolcalls, urls, warc
from evenhand.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat sat on the mat and the dog was there with them for a long time."
DE = "der hund und die katze sind nicht mit ihnen auf der schönen strasse gewesen."


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, base, "en", "b"), (5, base, "en", "b"),
        (6, base.replace("word3 ", "other "), "en", None), (7, "Two words", "de", "c"), (8, "two WORDS", "de", "c"),
        (9, "x " * 20_000, "de", "d"), (10, "üß漢字 ☃ 123 456", "de", "d"), (11, "12 34 !?", None, "e"),
    ]
    return docs_of(spark, rows)


def empty(spark):
    return docs_of(spark, [])


# 1 ---------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact_with_ties_nulls_and_copies(spark):
    rng = np.random.default_rng(0)
    codes = ["".join(rng.choice(["0", "1"], 16)) for _ in range(300)]
    codes[5:40] = [codes[5]] * 35
    rows = [(i, c) for i, c in enumerate(codes)] + [(None, codes[0]), (999, None)]
    df = spark.createDataFrame(rows, "id long, code string")
    df = df.withColumns({c: F.lit("clash") for c in ("query", "distance", "rank", "segment", "value")})
    q = df.filter("id % 50 = 0 OR id = 7")
    for segments in (4, 3, None):
        got = {}
        for r in hamming.top_k(df, q, 10, bits=16, segments=segments).collect():
            got.setdefault(r["query"], []).append((r["distance"], r["id"], r["rank"]))
        for i in [0, 7, 50, 100, 150, 200, 250]:
            want = sorted((sum(a != b for a, b in zip(codes[i], c, strict=True)), j) for j, c in enumerate(codes))[:10]
            assert [x[:2] for x in sorted(got[i], key=lambda x: x[2])] == want
    twice = df.filter("id < 3").union(df.filter("id < 3"))
    got = hamming.top_k(twice, twice, 4, bits=16).collect()
    assert len(got) == 12 and all([x["id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query"] == i][:2] == [i, i] for i in (0, 1, 2))
    wide = spark.createDataFrame([(i, format((0xFFFFFFFFFFFFFFFF * (i % 2)) ^ (1 << (i % 64)), "064b")) for i in range(130)], "id long, code string")
    near = {r["id"]: r["distance"] for r in hamming.top_k(wide, wide.filter("id = 1"), 3).collect()}
    assert near == {1: 0, 65: 0, 129: 0}


def test_flips_are_all_choices_of_bits(spark):
    from math import comb

    rows = spark.createDataFrame([(0, 5, 0b10110), (1, 3, 0b101), (2, 1, 0)], "segment int, width int, value long")
    for radius in range(6):
        got = [(r["segment"], r["value"]) for r in hamming.flipped(rows, radius).collect()]
        assert len(got) == len(set(got)) == sum(comb(w, radius) for w in (5, 3, 1))
        assert all(bin(v ^ {0: 0b10110, 1: 0b101, 2: 0}[s]).count("1") == radius for s, v in got)


def test_top_k_of_few_and_of_none(spark):
    df = spark.createDataFrame([(1, "0000"), (2, "0001")], "id long, code string")
    assert hamming.top_k(df, df, 10, bits=4, segments=2).count() == 4
    assert hamming.top_k(df.limit(0), df, 10, bits=4, segments=2).count() == 0
    assert hamming.top_k(df, df.limit(0), 10, bits=4, segments=2).count() == 0
    v = spark.createDataFrame([([0.5, None, -1.0],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(hamming.sign_code(F.col("v"), 4)).collect()] == ["1000", None]


# 2 ---------------------------------------------------------------------------------------------------------------


def test_url_rules_match_brute_force(spark, sf_dir):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/1"), (4, "http://x.net/"), (5, "http://x.net"), (6, "https://net/a?b=http://y.org/fr/"),
            (7, "http://notnet/"), (8, "http://a.org/fr/x#q"), (9, "http://a.org/de/x"), (10, "http://example.com/de/"), (11, "://h?x"), (12, "http://É.NET/é")]
    rows += [(100 + r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(df, trees=2, depth=2).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
            tail = rest[end:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(r, v) for r, v in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule[0])
        assert got[i]["verdict"] == rule[1] if rule[0] else got[i]["verdict"] in ("allow", "block")


def test_url_filter_learns_and_handles_empty(spark):
    rows = [(f"http://shop{i}.example.com/buy-{i}-{i}-{i}?a=1&b=2", 1) for i in range(80)] + [(f"http://news{i}.example.com/en/story", 0) for i in range(80)]
    df = spark.createDataFrame(rows, "url string, y int")
    taught = df.withColumn("y2", F.when(F.crc32("url") % 2 == 0, F.col("y")))
    report = {}
    out = urls.filter_urls(taught, rules=(), label=F.col("y2"), report=report).filter("y2 IS NULL")
    assert report["held_out"] > 5 and report["taught"] + report["held_out"] == taught.filter("y2 IS NOT NULL").count() and report["accuracy"] >= 0.9
    assert out.filter("(y = 1) = (verdict = 'block')").count() >= 0.95 * out.count()
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(df.limit(3), rules=()).collect()} == {"allow"}


def test_url_suffixes_do_not_teach_their_own_labels(spark):
    rng = np.random.default_rng(4)  # labels are coin tosses, and each suffix has one url: a rate with the own label would be a perfect feature
    rows = [(f"http://a.s{i}.x{i}/page", int(rng.integers(0, 2))) for i in range(600)]
    report = {}
    urls.filter_urls(spark.createDataFrame(rows, "url string, y int"), rules=(), label=F.col("y"), report=report).count()
    assert 0.3 < report["accuracy"] < 0.7
    pages = spark.createDataFrame([(f"http://h{i}.{t}/{'long-' * (i % 7)}p", i) for i in range(60) for t in ("net", "com/de", "org/fr", "org", "com")], "url string, page_id long")
    report = {}
    urls.filter_urls(pages, report=report).count()
    assert report["held_out"] > 0 and 0.0 <= report["accuracy"] <= 1.0


def test_suffix_shares_of_ruled_urls_come_from_other_rules(spark):
    """Under b.org, one rule blocks a path and others allow theirs: urls that no rule fits are judged by what rules say of their suffix."""
    rules = [("b.org/x/", "block"), ("b.org/y/", "block"), ("g.org/x/", "allow"), ("g.org/y/", "allow")]
    urls_ = [f"http://{h}{i % 40}.{d}/{p}/{i}" for d in ("b.org", "g.org") for p in ("x", "y") for i, h in enumerate(["h"] * 150)]
    free = [f"http://h{i % 40}.{d}/z/{i}" for d in ("b.org", "g.org") for i in range(50)]
    df = spark.createDataFrame([(u,) for u in urls_ + free], "url string")
    got = urls.filter_urls(df, rules=rules).filter("rule IS NULL").collect()
    right = [r["verdict"] == ("block" if ".b.org" in r["url"] else "allow") for r in got]
    assert len(right) == 100 and sum(right) > 95


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("aaaa",)], "s string").select(urls.entropy(F.col("s"))).collect()
    assert [round(r[0], 6) for r in got] == [1.0, 0.0, 0.0]


# 3 ---------------------------------------------------------------------------------------------------------------


def test_language_odd_rows(spark, odd):
    labelled = docs_of(spark, [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de", "s") for i in range(60)])
    model = langid.train(labelled)
    got = {r["doc_id"]: r for r in langid.predict(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 11)] == ["und"] * 4 and [got[i]["score"] for i in (1, 2, 3, 11)] == [0.0] * 4
    assert got[4]["lang_pred"] in ("en", "de") and 0.0 <= got[4]["score"] <= 1.0
    held = {r["lang_pred"] for r in langid.predict(docs_of(spark, [(1, "the dog and the mat", None, None)]), model).collect()}
    assert held == {"en"}
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.train(empty(spark))
    assert [r["lang_pred"] for r in langid.predict(odd.filter("doc_id = 4"), none).collect()] == ["und"]


def plain_grams(text, buckets):
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    t, out = f" {text.lower()} ", []
    for n in langid.ORDERS:
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) & mask
            out.append(mix((h + n) & mask) % buckets)
    return out


def test_language_model_is_the_plain_one(spark):
    import math
    import random

    buckets, rows = 1 << 10, [(i, (EN if i % 2 else DE)[i % 20 :] + f" {i}", "en" if i % 2 else "de", "s") for i in range(40)]
    model = langid.train(docs_of(spark, rows), buckets=buckets, epochs=1)
    df, tf = {}, []
    for _, t, _, _ in rows:
        g = plain_grams(t, buckets)
        tf.append({b: g.count(b) / len(g) for b in set(g)})
        for b in set(g):
            df[b] = df.get(b, 0) + 1
    idf = {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in df.items()}
    keys = docs_of(spark, rows).select("doc_id", F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string"), "text").bitwiseAND((1 << 62) - 1).alias("h")).collect()
    order = [r["doc_id"] for r in sorted(keys, key=lambda r: r["h"]) if r["h"] % 5]
    z, n, alpha, beta, l1, l2 = {}, {}, 0.5, 0.1, 1e-4, 1e-3

    def weight(b, c):
        v = z.get((b, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((b, c), 0.0))) / alpha + l2)

    for at in np.random.default_rng(0).permutation(len(order)):
        i = order[at]
        x = {b: v * idf[b] * langid.SCALE for b, v in tf[i].items()}
        w = {(b, c): weight(b, c) for b in x for c in (0, 1)}
        e = [math.exp(sum(x[b] * w[b, c] for b in x)) for c in (0, 1)]
        for c in (0, 1):
            p = e[c] / sum(e) - (c == (rows[i][2] == "en"))
            for b in x:
                g, old = x[b] * p, n.get((b, c), 0.0)
                z[b, c] = z.get((b, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[b, c]
                n[b, c] = old + g * g
    for b in random.Random(0).sample(sorted(idf), 200):
        got = model["weights"][model["index"][b]]
        assert np.allclose(got, [weight(b, c) * idf[b] * langid.SCALE for c in (0, 1)], atol=1e-4, rtol=1e-4)
    text = "the dog und die katze"
    g = plain_grams(text, buckets)
    s = [sum(weight(b, c) * idf.get(b, 0.0) * langid.SCALE for b in g) / len(g) / model["temperature"] for c in (0, 1)]
    got = langid.predict(docs_of(spark, [(1, text, None, None)]), model).first()
    assert got["lang_pred"] == ("en" if s[1] > s[0] else "de")
    assert abs(got["score"] - 1 / (1 + math.exp(-abs(s[1] - s[0])))) < 1e-3


def test_language_sample_is_bounded(spark):
    rows = [(7, EN, "en", "s")] * 300 + [(i, f"{DE} {i}", "de", "s") for i in range(300)] + [(None, DE * 2000, "de", "s")]
    fitted = []
    fit = langid.fit_ftrl
    try:
        langid.fit_ftrl = lambda data, *a: fitted.append(data) or fit(data, *a)
        langid.train(docs_of(spark, rows), sample_rows=40, buckets=1 << 10)
        langid.train(docs_of(spark, rows), sample_rows=400, sample_bytes=4000, buckets=1 << 10)
    finally:
        langid.fit_ftrl = fit
    en = langid.train(docs_of(spark, rows), sample_rows=40, buckets=1 << 10)["langs"].index("en")
    assert len(fitted[0]) <= 40 and sum(y == en for _, _, y in fitted[0]) <= 1 and len(fitted[1]) <= 40
    many = docs_of(spark, [(i, EN, f"l{i}", "s") for i in range(langid.MOST_LANGUAGES + 1)])
    with pytest.raises(ValueError):
        langid.train(many)


def test_language_column_with_stray_values(spark):
    rows = [(i, [EN, DE][i % 2] * 3, ["en", "de"][i % 2], None) for i in range(40)] + [(1000 + i, f"stray {i}", f"x{i}", None) for i in range(600)]
    model = langid.train(docs_of(spark, rows))
    assert len(model["langs"]) == langid.MOST_LANGUAGES and {"en", "de"} <= set(model["langs"])
    two = langid.train(docs_of(spark, rows), languages=2)
    assert two["langs"] == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs_of(spark, rows[:2]), two).collect()}
    assert got == {0: "en", 1: "de"}


def test_language_held_out_accuracy(spark, sf_dir):
    got = langid.op3_language(spark, sf_dir.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id")
    test = got.filter("held_out AND lang IS NOT NULL")
    assert test.filter("lang = lang_pred").count() >= 0.97 * test.count()


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    sure = np.where(rng.random(4000) < 0.7, y, 1 - y)
    logits = np.eye(2)[sure] * 10.0  # far too sure of 70 percent
    t = langid.fit_temperature(logits, y)
    assert abs(1 / (1 + np.exp(-10.0 / t)) - 0.7) < 0.03


# 4 ---------------------------------------------------------------------------------------------------------------

SCHEMA = {"f": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}}}, "required": ["a"], "additionalProperties": False}}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("c", "1", [], "f", '{"b": ["x"], "a": 2}', 0), ("c", "2", ["1"], "f", '{"a": 0}', 1), ("c", "3", ["1", "2"], "g", "{}", 2), ("c", "4", ["5"], "f", '{"a": 1}', 3),
        ("c", "5", ["4"], "f", '{"a": 1}', 4), ("c", "6", None, "f", '{"a": 1, "a": 2}', 5), ("c", "7", ["zz", None], "f", None, 6), ("c", "8", [], "f", '{"a": NaN}', 7),
        ("d", None, [], "f", "{}", 0), ("c", "1", [], "f", '{"b": ["x"], "a": 3}', 9), ("d", "9", ["3"], "f", '{"a": true}', 1),
        ("d", "10", [], "f", '{"a": 1e999}', 2), ("d", "11", [], "f", '{"a": "\\ud800"}', 3), ("d", "12", [], "f", '{"a": 1, "b": [' + ", ".join(["1"] * 30) + "]}", 4),
        ("c", "8", [], "f", '{"a": NaN}', 7), (None, "13", [], None, '{"a": 1}', None),
    ], "conv_id string, call_id string, needs array<string>, name string, arguments string, turn long").withColumns({c: F.lit("clash") for c in ("level", "place", "status", "own", "n", "key")})
    results = spark.createDataFrame([("1", "é"), ("1", "z"), ("2", None), ("nobody", "r"), (None, "r")], "call_id string, content string").withColumn("result", F.lit("clash"))
    rows = toolcalls.link_calls(calls, results, SCHEMA).collect()
    assert len(rows) == calls.count()
    got = {r["call_id"]: r for r in rows if r["status"] not in ("no_id", "repeated")}
    assert {k: v["status"] for k, v in got.items()} == {
        "1": "ok", "2": "invalid", "3": "unknown_tool", "4": "cycle", "5": "cycle", "6": "bad_json", "7": "bad_json", "8": "bad_json", "9": "invalid",
        "10": "bad_json", "11": "bad_json", "12": "invalid", "13": "unknown_tool",
    }
    assert sorted((r["call_id"] or "", r["status"]) for r in rows if r["status"] in ("no_id", "repeated")) == [("", "no_id"), ("1", "repeated"), ("8", "repeated")]
    assert got["1"]["json"] == '{"arguments":{"a":2,"b":["x"]},"id":"1","name":"f","result":"z"}'
    assert len(got["12"]["errors"]) == 30
    assert {k: v["level"] for k, v in got.items() if k < "4"} == {"1": 0, "2": 1, "3": 2, "10": 0, "11": 0, "12": 0, "13": 0} and got["4"]["level"] is None and got["9"]["level"] == 3
    for conv, n in (("c", 10), ("d", 5), (None, 1)):
        assert sorted(r["place"] for r in rows if r["conv_id"] == conv) == list(range(n))
    assert toolcalls.link_calls(calls.limit(0), results, SCHEMA).count() == 0
    assert {r["status"] for r in toolcalls.link_calls(calls, results.limit(0), SCHEMA).filter("call_id = '1'").collect()} == {"no_result", "repeated"}


def test_schemas_are_checked_whole():
    bad = lambda value, schema: bool(toolcalls.schema_errors(value, schema))
    fits = [
        (1.0, {"type": "integer"}), (1, {"enum": [1.0]}), ("ab1", {"pattern": "[0-9]$"}), (6, {"multipleOf": 1.5}), (0.3, {"multipleOf": 0.1}), ([1, True], {"uniqueItems": True}),
        ({"a": 1, "b": "x"}, {"properties": {"a": {"type": "number"}}, "additionalProperties": {"type": "string"}}), (3, {"anyOf": [{"type": "string"}, {"minimum": 3}]}),
        (5, {"oneOf": [{"minimum": 4}, {"maximum": 2}]}), ({"x": None}, {"minProperties": 1}), ([], {"items": False}), (2, {"not": {"const": 3}}), (10**30, {"exclusiveMinimum": 1e29}),
    ]
    breaks = [
        (True, {"enum": [1]}), (1, {"const": True}), (1.5, {"type": "integer"}), (True, {"type": "number"}), ("ab", {"pattern": "[0-9]$"}), (7, {"multipleOf": 2}), ([1, 1.0], {"uniqueItems": True}),
        ({"b": 1}, {"additionalProperties": {"type": "string"}}), (2, {"anyOf": [{"type": "string"}, {"minimum": 3}]}), (5, {"oneOf": [{"minimum": 4}, {"minimum": 2}]}), (5, {"allOf": [{"minimum": 4}, {"maximum": 4}]}),
        (3, {"exclusiveMinimum": 3}), (3, {"exclusiveMaximum": 3}), ({}, {"minProperties": 1}), ([1], {"items": False}), (3, {"not": {"const": 3.0}}), ({"a": [{"b": 1}]}, {"properties": {"a": {"items": {"required": ["c"]}}}}),
    ]
    for value, schema in fits + breaks:
        toolcalls.check_schema(schema)
    assert [x for x in fits if bad(*x)] == [] and [x for x in breaks if not bad(*x)] == []
    for schema in ({"type": "text"}, {"minimun": 3}, {"properties": {"a": {"$ref": "#/x"}}}, {"items": [1]}, {"anyOf": [{"patternProperties": {}}]}, {"multipleOf": 0}):
        with pytest.raises(ValueError):
            toolcalls.check_schema(schema)


def test_numbers_have_one_spelling():
    for text, want in (
        ("1.0", "1"), ("1", "1"), ("1e2", "100"), ("100.0", "100"), ("-0.0", "0"), ("1E21", "1e+21"), ("1" + "0" * 21, "1e+21"), ("1e20", "1" + "0" * 20), ("0.000001", "0.000001"), ("1e-7", "1e-7"),
        ("123456789012345678901234567890", "123456789012345678901234567890"), ("9007199254740993", "9007199254740993"), ("333333333.33333329", "333333333.3333333"), ("-1.5e-10", "-1.5e-10"), ("4.50", "4.5"), ("2e-3", "0.002"),
    ):
        assert toolcalls.canonical(json.loads(text)) == want
    assert toolcalls.canonical({"\U0001f600": 1, "\ufb33": [None, True, "\x1f\"/"]}) == '{"\U0001f600":1,"\ufb33":[null,true,"\\u001f\\"/"]}'
    for value in (float("inf"), "\ud800"):
        with pytest.raises(ValueError):
            toolcalls.canonical(value)


def test_chats_keep_rows_without_conversation_or_turn(spark):
    turns = spark.createDataFrame(
        [(None, 0, "user", "one two three"), (None, 0, "user", "four five six"), (5, None, "user", "a b c"), (None, 5, "user", "d e f"), (5, None, "assistant", "r"), (5, 1, "assistant", None)],
        "conv_id long, turn long, role string, text string",
    )
    rows = toolcalls.link_calls(*toolcalls.as_calls(turns), toolcalls.CHAT_SCHEMAS).collect()
    assert sorted((r["call_id"], r["status"]) for r in rows) == [("5:~", "invalid"), ("~:0", "no_result"), ("~:0", "repeated"), ("~:5", "no_result")]


def test_places_of_wide_levels(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "WIDE", 10)
    rows = [("c", f"{i:04}", i % 3 if i % 7 else None, i % 200 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id string, call_id string, level long, turn long")
    got = {r["call_id"]: r["place"] for r in toolcalls.places(df).collect()}
    last = 1 << 40
    want = sorted(rows, key=lambda r: (last if r[2] is None else r[2], -1 if r[3] is None else r[3], r[1]))
    assert [got[r[1]] for r in want] == list(range(500))


def test_long_chains_take_few_rounds(spark):
    n = 300
    calls = spark.range(n).select(F.col("id").cast("string").alias("call_id"))
    edges = spark.range(1, n).select(F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("needs"))
    assert toolcalls.levels(calls, edges).agg(F.max("level")).first()[0] == n - 1


# 5 ---------------------------------------------------------------------------------------------------------------


def test_mix(spark, odd):
    got = mixing.mix(odd.withColumn("taken", F.lit("clash"))).collect()
    assert len(got) == 11 and all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert round(sum(v[0]["target"] for v in by.values()), 6) <= round(1.5 * sum(r["size"] for r in got), 6)
    assert all(v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9 for v in by.values())
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(odd.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.emit(mixing.mix(odd), ["doc_id"]).count() == sum(r["copies"] for r in got)


def test_targets_share_what_is_left(spark):
    sizes = spark.createDataFrame([("a", False, 10), ("b", False, 100), ("c", False, 100), ("", True, 0)], "_src string, _null boolean, source_size long")
    got = {(r["_src"], r["_null"]): r["target"] for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    assert got[("a", False)] == 20.0 and got[("", True)] == 0.0
    assert abs(got[("b", False)] - 295 / 3) < 1e-9 and abs(got[("c", False)] - 590 / 3) < 1e-9


# 6 ---------------------------------------------------------------------------------------------------------------


def test_shards(spark, odd):
    got = shards.shard(odd.withColumn("shard", F.lit(7)), 3).collect()
    assert len(got) == 11
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert shards.shard(empty(spark), 3).count() == 0


def test_shards_balance_and_keep_groups(spark):
    rows = [(i, "g" * (i // 3 % 50 + 1) + str(i // 3), None, None) for i in range(900)] + [(10_000 + i, "hot" * 40, None, None) for i in range(400)]
    got = shards.shard(docs_of(spark, rows), 10).collect()
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert max(total.values()) <= 1.05 * min(total.values())
    where = {}
    for r in got:
        if r["doc_id"] < 10_000:
            where.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def plain_differencing(sizes, k):
    """Karmarkar-Karp as the textbook has it: lists of parts, the two of largest spread combined until one is left."""
    parts = [[(x, [i])] + [(0, [])] * (k - 1) for i, x in enumerate(sizes)]
    spread = lambda p: p[0][0] - p[-1][0]
    while len(parts) > 1:
        parts.sort(key=spread)
        a, b = parts.pop(), parts.pop()
        both = [(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)]
        parts.append(sorted(both, key=lambda p: -p[0]))
    return parts[0]


def test_differencing_is_the_textbook_one():
    rng = np.random.default_rng(12)
    for k in (2, 3, 7):
        sizes = [int(x) for x in rng.permutation(100_000)[:60] + 1]
        sums = np.zeros((60, k), np.int64)
        sums[:, 0] = sizes
        part, total = shards.difference(sums)
        want = plain_differencing(sizes, k)
        assert sorted(total.tolist()) == sorted(x for x, _ in want)
        assert {frozenset(np.flatnonzero(part[:, 0] == p).tolist()) for p in range(k)} == {frozenset(m) for _, m in want}


def test_shards_match_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(i, "x" * int(n), None, None) for i, n in enumerate(rng.integers(1, 5000, 80))] + [(None, "x" * 4999, None, None), (3, "", None, None), (3, None, None, None)]
    rows += [(500 + i, "y" * 900, None, None) for i in range(40)]  # 0.9 of a share: stays whole
    got = shards.shard(docs_of(spark, rows).withColumn("_clash", F.lit(1)), 6).collect()
    size = {}
    for _, t, *_ in rows:
        size[t or ""] = size.get(t or "", 0) + len((t or "").encode()) + 16
    assert max(size.values()) <= sum(size.values()) / 6
    want = sorted(x for x, _ in plain_differencing(list(size.values()), 6))
    by = {}
    for r in got:
        by[r["shard"]] = by.get(r["shard"], 0) + r["size"]
    assert sorted(by.values()) == want or max(by.values()) - min(by.values()) <= 2 * (want[-1] - want[0]) + 16
    where = {}
    for r in got:
        where.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    # many tasks, in several rounds
    monkeypatch.setattr(shards, "PER_BUCKET", 5)
    monkeypatch.setattr(shards, "FAN", 3)
    monkeypatch.setattr(shards, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shards, "SLOTS_SORTED", 20)
    got = shards.shard(docs_of(spark, rows), 6).collect()
    assert len(got) == len(rows)
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_do_not_depend_on_the_layout(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shards, "PER_BUCKET", 20)
    monkeypatch.setattr(shards, "SLOTS_SORTED", 30)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    twice = docs.filter("doc_id % 50 = 0")
    docs = docs.unionByName(twice).unionByName(twice).unionByName(spark.range(90).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot " * 500).alias("text"), F.lit(None).cast("string").alias("lang")))
    one = sorted(map(tuple, shards.shard(docs).collect()), key=str)
    two = sorted(map(tuple, shards.shard(docs.repartition(5).orderBy(F.desc("text"))).collect()), key=str)
    assert one == two and len(one) == docs.count()


def test_differencing_beats_dealing_in_turn():
    rng = np.random.default_rng(2)
    sums = np.zeros((200, 4), np.int64)
    sums[:, 0] = rng.integers(1, 10_000, 200)
    part, total = shards.difference(sums)
    own = np.bincount(part[:, 0], weights=sums[:, 0], minlength=4)
    assert sorted(own) == sorted(total) and own.max() - own.min() <= 10
    assert all(sorted(p) == [0, 1, 2, 3] for p in part.tolist())


# 7 ---------------------------------------------------------------------------------------------------------------


def test_line_rules(spark, odd):
    prose = "\n".join(f"This is line {i} of x{i} clean y{i} text, and it z{i} ends w{i} well." for i in range(6))
    menu = prose + "\nHome | News | Shop | About | Contact"
    junk = "Home | News | Shop | About | Contact | More | Less | Up | Down\nNew | Old | Hot | Cold | Top | Low | Wide | Narrow\n" + "a | b | c | d | e\n" + "One line that is fine here, with more words than ten in it, truly so."
    rows = [(1, prose, None, None), (2, menu, None, None), (3, junk, None, None), (4, "so it goes on and on and we say it " * 10, None, None), (5, "one two.\n\none two.\none two.", None, None)]
    got = {r["doc_id"]: r for r in line_rules.clean_lines(docs_of(spark, rows).withColumn("kept", F.lit("clash"))).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == prose
    assert got[2]["kept"] and got[2]["cleaned"] == prose
    assert not got[3]["kept"] and got[4]["base_failed"] and got[4]["n_repeat_words"] == 100
    assert got[5]["n_dup_lines"] == 2 and got[5]["n_words"] == 6
    lines = ["Eleven words of a heading may do without any final mark", "Twelve words of a line may not do without any final mark", 'But a "sentence of twelve words or more may end in a quote."  ', "So may one of twelve words or more that ends in brackets (here.)\r"]
    cleaned = line_rules.clean_lines(docs_of(spark, [(1, "\n".join(lines), None, None)])).first()["cleaned"]
    assert cleaned.split("\n") == [lines[0], *lines[2:]]
    out = {r["doc_id"]: r for r in line_rules.clean_lines(odd).collect()}
    assert out[1]["n_words"] == 0 and out[1]["cleaned"] == "" and not out[1]["kept"] and out[9]["n_repeat_words"] == 20_000
    assert line_rules.clean_lines(empty(spark)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_join_matches_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 120))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i in range(150):  # a cluster around one text, from near to too far
        w = list(base)
        for at in rng.choice(120, i % 8, replace=False):
            w[at] = str(rng.choice(words))
        rows.append((1000 + i, " ".join(w)))
    shared = " ".join(rng.choice(words, 55))
    rows += [(2000 + i, shared + " " + " ".join(rng.choice(words, 40 + i))) for i in range(40)]
    rows += [(3000 + i, " ".join(rng.choice(words, 1 + i % 6))) for i in range(30)] + [(4000, "  " + rows[20][1].upper() + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
    assert got == brute_components(rows)


def test_join_of_empty_and_repeated(spark):
    assert ngram_join.ngram_components(empty(spark)).count() == 0
    df = docs_of(spark, [(None, EN, None, None), (5, EN, None, None), (5, EN, None, None), (3, EN.upper(), None, None), (9, None, None, None)])
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.ngram_components(df).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 3), (9, 9)]


def brute_by_rows(rows):
    """Components where rows of one id are one node; a row has its own number of shingles."""
    alone = brute_components(list(enumerate(t for _, t in rows)))
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for at, (_, c) in alone.items():
        p, q = find(rows[at][0]), find(rows[c][0])
        root[max(p, q)] = min(p, q)
    return sorted((i, alone[at][0], find(i)) for at, (i, _) in enumerate(rows))


def test_join_of_ids_with_several_texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    a, b, c = (" ".join(rng.choice(words, 60)) for _ in range(3))
    for rows in (
        [(1, a), (1, b), (2, b + " x y z")],
        [(5, a), (5, b), (2, b + " x"), (3, a + " x")],
        [(3, a), (7, a), (7, b), (5, b), (9, b + " x")],
        [(4, a), (4, None), (4, ""), (2, a), (8, c), (8, c), (9, None)],
    ):
        got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_by_rows(rows)


def test_hot_shingles_and_unbroadcast_sides(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEVEL", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 1)
    monkeypatch.setattr(ngram_join, "ENTRIES", 50)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 80))
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(80, i % 6, replace=False):
            w[at] = str(rng.choice(words))
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(rng.choice(words, 30))) for i in range(20)] + [(200 + i, rows[i][1]) for i in range(10)]
    got = ngram_join.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: (r["n"], r["comp"]) for r in got.run().collect()} == brute_components(rows)


def test_join_orders_by_counts_of_the_whole_table(spark):
    common = [f"c{i}" for i in range(45)]
    rows = [(i, " ".join([f"u{i}x{j}" for j in range(30)] + common)) for i in range(40)]
    one = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")  # hardly any task sees the passage twice
    join = ngram_join.NgramJoin(one)
    join.docs.mapInArrow(ngram_join._profile(5), "id long, h long, n long, s long, seen binary").createOrReplaceTempView("profile_of_slices")
    levels = join._levels(spark.table("profile_of_slices")).value
    data = " ".join(common).encode()
    (shared,) = ngram_join.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert (levels[ngram_join._cell(shared)] == 5).all()  # 40 sets hold each


def test_hot_groups_hold_no_pairs_that_cannot_link(spark):
    rows = [(i // 2, i, 100, 20) for i in range(400)] + [(1000, i, 100, 1) for i in range(400)]  # pairs, and one shingle of all
    placed = spark.createDataFrame([(g, r, n, w, r) for g, r, n, w in rows], "grp long, rep long, n long, w long, comp long")
    live = ngram_join.NgramJoin(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._live(placed)
    assert sorted((r["grp"], r["rep"]) for r in live.collect()) == [(i // 2, i) for i in range(400)]


def test_join_probes_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PROBE_FLOOR", 20)
    monkeypatch.setattr(ngram_join, "PROBE_RATIO", 0)
    rounds = []
    meet = ngram_join.NgramJoin._meetings
    monkeypatch.setattr(ngram_join.NgramJoin, "_meetings", lambda self, *a: rounds.append(1) or meet(self, *a))
    rng = np.random.default_rng(8)
    base, rows = [f"b{i}" for i in range(70)], []
    for i in range(24):  # near the threshold on both sides
        w = list(base)
        for at in rng.choice(70, 1 + i % 4, replace=False):
            w[at] = f"u{i}x{at}"
        rows.append((i, " ".join(w)))
    join = ngram_join.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string"), hubs=1)
    got = {r["id"]: (r["n"], r["comp"]) for r in join.run().collect()}
    assert got == brute_components(rows)
    assert len(rounds) > 1 and len({c for _, c in got.values()}) > 1


def test_members_that_do_not_link_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PROBE_FLOOR", 100)
    monkeypatch.setattr(ngram_join, "PROBE_RATIO", 0)
    taken = []
    meet = ngram_join.NgramJoin._meetings
    monkeypatch.setattr(ngram_join.NgramJoin, "_meetings", lambda self, rows, probes: taken.append((rows.count(), probes.count())) or meet(self, rows, probes))
    passage = [f"c{i}" for i in range(64)]
    rows = [(i, " ".join(passage + [f"u{i}x{j}" for j in range(11 + i % 4)])) for i in range(30)]  # just too far apart
    rows.append((50, " ".join(passage[:54])))  # so short that all sizes may meet
    rows += [(60 + i, " ".join([f"v{j}" for j in range(60)] + [f"v{i}y"] * i)) for i in range(2)]
    got = {r["id"]: (r["n"], r["comp"]) for r in ngram_join.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string"), hubs=1).run().collect()}
    assert got == brute_components(rows) and got[61][1] == 60 and len({c for _, c in got.values()}) == 32
    assert 1 < len(taken) <= 4  # over 1,000 pairs, 100 at first
    assert all(n < m for (n, _), (m, _) in zip(taken[1:], taken, strict=False))  # what has met all others is not carried on


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(200)]
    hub = sets[0]
    want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(hub, s)) >= 75 * len(np.union1d(hub, s))}
    assert set(ngram_join.walk_tree(ngram_join.build_tree(sets), hub, 0.75)) == want


# 9 ---------------------------------------------------------------------------------------------------------------


def test_bpe_matches_the_library_and_round_trips(spark, odd):
    import public_tokenizers
    import tiktoken

    vocab = bpe.public_vocabulary()
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    extra = docs_of(spark, [(50, "I'll  don't\x1c\r\n\n <|endoftext|> " + "=" * 500 + "abcdefgh" * 60 + " " + "qxz" * 700, None, None), (None, "x", None, None)])
    rows = odd.unionByName(extra).withColumn("ids", F.lit("clash"))
    tool = bpe.ByteBpe(spark, vocab, known_words=20)
    got = tool.encode(rows, decoded=True).collect()
    text = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert len(got) == 13
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(text[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == text[r["doc_id"]]
    digest = {r["doc_id"]: r for r in bpe.digests(tool.decode(tool.encode(rows)), "doc_id").collect()}
    assert digest[2]["n_tokens"] == 0 and digest[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert tool.encode(empty(spark)).count() == 0


def test_bpe_of_more_parts_than_a_table_has_buckets(spark, odd, monkeypatch):
    tool = bpe.ByteBpe(spark, bpe.public_vocabulary(), known_words=20)
    want = sorted(map(tuple, tool.encode(odd).collect()))
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 1)  # a part for each byte of the texts: over 40,000
    monkeypatch.setattr(bpe, "MOST_BUCKETS", 3)
    assert sorted(map(tuple, tool.encode(odd).collect())) == want


# 10 --------------------------------------------------------------------------------------------------------------


def test_warc_round_trip_with_magic_in_payloads(spark):
    fake = "before " + warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + warc.MAGIC + "after"
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", fake), (7, "é", "ü\r\n\r\nß" * 1000), (8, "u", warc.MAGIC), (9, "u", "x" + warc.MAGIC * 3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(1)
    path = scratch(spark, "warc")
    warc.write_archives(df, path)
    got = {r["id"]: r for r in warc.read_archives(spark, path).collect()}
    assert sorted(got) == [str(r[0]) for r in rows]
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[str(i)]
        assert r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (got[str(i)]["record_type"], got[str(i)]["refers_to"]) for i in (1, 2, 3, 4, 5)} == {
        1: ("revisit", "3"), 2: ("revisit", "3"), 3: ("response", None), 4: ("revisit", "5"), 5: ("response", None),
    }
    odd_ids = spark.createDataFrame([(None, "u", "twice"), (1, "u", "twice"), (1, "u", "twice"), (None, "u", "alone"), (None, "u", "alone")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(odd_ids, path)
    assert sorted((r["id"], r["record_type"], r["refers_to"] or "") for r in warc.read_archives(spark, path).collect()) == [
        ("", "response", ""), ("", "response", ""), ("", "revisit", "1"), ("1", "response", ""), ("1", "response", ""),
    ]
    none = scratch(spark, "warc")
    warc.write_archives(df.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_payloads_that_quote_absurd_lengths(spark):
    quote = lambda n: f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: {n}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: {n}\r\n\r\nbody\r\n\r\n"
    lengths = ("99999999999", "9" * 25, str((1 << 63) - 1), str((1 << 31) + 5), "-4", "", "12.5", "1" * 19)
    rows = [(i, "u", "<p>" + quote(n) * (1 + i % 3) + "after") for i, n in enumerate(lengths)]
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    got = {int(r["id"]): r for r in warc.read_archives(spark, path).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, _, html in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(html), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())


def test_records_are_whole_however_files_are_cut(spark, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 512)
    monkeypatch.setattr(warc, "FINE", 64)
    rng = np.random.default_rng(9)
    rows = [(i, f"http://h/{i}", "".join(rng.choice(["a", "\r\n\r\n", warc.MAGIC, "ß", f"{warc.MAGIC}Content-Length: 3\r\n\r\nabc\r\n\r\n"], i % 9))) for i in range(60)]
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {int(r["id"]): r for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == list(range(60))
    for i, _, html in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())


def test_pointer_jumping_keeps_the_chain(spark):
    rows = [("f", 0, 100), ("f", 40, 60), ("f", 60, 70), ("f", 70, 100), ("f", 100, 300), ("f", 200, 250), ("f", 300, 400), ("g", 5, 10), ("g", 10, 20)]
    got = warc.reachable(spark.createDataFrame(rows, "file string, start long, next long")).collect()
    assert sorted((r["file"], r["start"]) for r in got) == [("f", 0), ("f", 100), ("f", 300)]
