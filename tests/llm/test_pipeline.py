"""The pipeline's stages on the smallest documents, each against a plain version."""

import hashlib
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from evenhand.llm import bpe  # noqa: E402
from evenhand.llm.common import cut  # noqa: E402
from evenhand.llm.line_rules import BOILERPLATE  # noqa: E402

from .test_small_cases import brute_components  # noqa: E402


def words(text):
    return (text or "").encode().split()


def base_failed(text):
    w = words(text)
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 8))
    return len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_stages(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], sf_dir)))
    first, quality, language, unique, mixed, tokens = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[1:5])

    kept = {r["doc_id"]: r["text"] for r in quality}
    assert set(kept) <= {r["doc_id"] for r in first if not base_failed(r["text"])}
    for r in first:  # what is clean by any reading stays as it is
        if not base_failed(r["text"]) and all(x.rstrip().endswith(".") and "|" not in x and not re.search(BOILERPLATE, x) and x.isascii() for x in r["text"].split("\n") if x.strip()):
            assert kept[r["doc_id"]] == r["text"]

    lang = {r["doc_id"]: r["lang"] for r in first}
    right = [r["lang"] == lang[r["doc_id"]] for r in language if lang[r["doc_id"]]]
    assert np.mean(right) > 0.95 and len(language) >= 0.95 * len(quality)

    groups = brute_components([(r["doc_id"], r["text"]) for r in language])
    assert {r["doc_id"] for r in unique} == {i for i, (_, c) in groups.items() if c == i}

    size, taken = {}, {}
    for r in unique:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    longest = max(len(words(r["text"])) for r in unique)
    level = {s: w for s, w in zip(sorted(size), [3, 1, 2] * len(size), strict=False)}
    total, target, free = 1.5 * sum(size.values()), {}, set(size)
    while free:  # share by weight, cap, share again
        share = {s: total * level[s] / sum(level[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            total -= target[s]
        free -= over
    assert all(abs(taken.get(s, 0) - target[s]) <= 3 * longest for s in size)

    vocab = bpe.public_vocabulary()
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed)
    for r in tokens:
        ids = lib.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    assert docs.count() == 0
