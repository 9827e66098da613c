"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import cut, lean, small_batches
from evenhand.llm.textarrays import mix64, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Term frequencies are shares of a text's n-grams; this brings their vectors to a norm near one.
SCALE = 10.0
UNKNOWN = "und"
#: More languages than this are refused: the regression keeps buckets x languages numbers.
MOST_LANGUAGES = 500


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams at each character of lower-cased texts, by order, and where each text starts.

    Texts are padded with a space on either side. Positions where an n-gram would leave its text hold ``buckets``.
    """
    raw = data.tobytes()
    texts = [f" {raw[a:b].decode('utf-8', 'replace').lower()} " for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(points))
    out, h = [], np.zeros(len(points), np.uint64)
    for n in ORDERS:
        h = h * np.uint64(0x100000001B3)
        h[: len(points) - n + 1] += points[n - 1 :]
        b = (mix64(h + np.uint64(n)) % np.uint64(buckets)).astype(np.int32)
        out.append(np.where(left >= n, b, buckets).astype(np.int32))
    return out, starts


def text_counts(grams: list[np.ndarray], a: int, b: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """One text's buckets and their shares of its n-grams."""
    own = np.concatenate([g[a:b] for g in grams])
    found, n = np.unique(own[own < buckets], return_counts=True)
    return found, n / max(1, n.sum())


def _document_frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(buckets + 1, np.int64), 0
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(0)):
                grams, starts = gram_buckets(data, offsets, buckets)
                for lo in range(0, last - first, 256):
                    hi = min(last - first, lo + 256)
                    mark = np.zeros((hi - lo, buckets + 1), bool)
                    a, b = starts[lo], starts[hi]
                    doc = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
                    for g in grams:
                        mark[doc, g[a:b]] = True
                    seen += mark.sum(axis=0)
                rows += last - first
        held = np.flatnonzero(seen[:buckets])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(seen[held], rows))], ["bucket", "n"])

    return run


def _sample_features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, share = [], []
            for first, last, data, offsets in slices(batch.column(0)):
                grams, starts = gram_buckets(data, offsets, buckets)
                for i in range(last - first):
                    f, s = text_counts(grams, starts[i], starts[i + 1], buckets)
                    idx.append(f.astype(np.int32).tobytes())
                    share.append(s.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(idx, pa.binary()), pa.array(share, pa.binary())], ["lang", "h", "idx", "share"])

    return run


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (buckets, classes) of softmax regression, by follow-the-regularised-leader with elastic-net penalties."""
    z = np.zeros((buckets, classes))
    n = np.zeros((buckets, classes))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            i, x, y = rows[r]
            w = weights(i)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(buckets))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature, between 1/16 and 16, at which held-back rows are likeliest; golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, ratio = -np.log(16.0), np.log(16.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_rows: int = 4000,
    sample_bytes: int = 32 << 20,
    languages: int = MOST_LANGUAGES,
    buckets: int = BUCKETS,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 0.1,
    l1: float = 1e-4,
    l2: float = 1e-3,
) -> dict:
    """Fit the model: {'langs', 'index' (buckets + 1), 'weights' (rows with any weight, langs) times IDF and scale, 'temperature'}.

    Document frequencies are counted over every labelled text. The regression is fitted on at most ``sample_rows``
    labelled rows and about ``sample_bytes`` bytes of text, as many of each language (the lowest hashes of ``id_col``
    and text, so a repeated id or row has no part beyond its own; each language has a row at least); every fifth of
    them only calibrates the temperature. Rows with null text or language teach nothing; null ids are ids like any
    other. Of more than ``languages`` languages, the commonest are learned (ties by name): a column with stray values in it
    bounds the model like a clean one.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("i")).filter("t IS NOT NULL AND lang IS NOT NULL")
    df = rows.select("t").mapInArrow(lean(_document_frequencies(buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(df["bucket"], df["n"], strict=True))
    total = counts.pop(-1, 0)
    idf = np.zeros(buckets)
    idf[list(counts)] = [np.log((1 + total) / (1 + n)) + 1.0 for n in counts.values()]
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    held = {r["lang"]: r["n"] for r in common.collect()}
    langs = sorted(held)
    rows = rows.filter(F.col("lang").isin(*langs)) if langs else rows
    if not langs:
        return {"langs": [], "index": np.zeros(buckets + 1, np.int32), "weights": np.zeros((1, 0), np.float32), "temperature": 1.0}
    quota, share = max(1, sample_rows // len(langs)), sample_bytes // len(langs)
    # rows below a hash that three times the quota of their language is expected below; only these are ranked
    limit = lambda n: (1 << 62) if n <= 4 * quota + 40 else int((1 << 62) * (3 * quota + 30) / n)
    limits = F.create_map(*[F.lit(x) for v in langs for x in (v, limit(held[v]))])
    h = F.xxhash64(F.lit("langid"), "i", "t").bitwiseAND((1 << 62) - 1)
    low = rows.withColumn("h", h).filter(F.col("h") <= F.element_at(limits, F.col("lang")))
    found = cut(low.groupBy("lang", "h").agg(F.max(F.octet_length("t")).cast("long").alias("size")), "hashes")
    by = Window.partitionBy("lang").orderBy("h")
    chosen = found.withColumns({"rank": F.row_number().over(by), "sum": F.sum("size").over(by)}).filter((F.col("rank") == 1) | ((F.col("rank") <= quota) & (F.col("sum") <= share)))
    picked = low.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi")  # at most sample_rows hashes
    picked = picked.groupBy("lang", "h").agg(F.min("t").alias("t"))
    got = picked.select("t", "lang", "h").mapInArrow(lean(_sample_features(buckets)), "lang string, h long, idx binary, share binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["lang"]))
    data = []
    for r in got:
        i = np.frombuffer(r["idx"], np.int32)
        data.append((i, np.frombuffer(r["share"], np.float32) * idf[i] * SCALE, langs.index(r["lang"]), r["h"] % 5 == 0))
    del got
    w = fit_ftrl([d[:3] for d in data if not d[3]], len(langs), buckets, epochs, alpha, beta, l1, l2)
    held = [d for d in data if d[3]]
    t = fit_temperature(np.array([d[1] @ w[d[0]] for d in held]).reshape(len(held), len(langs)), np.array([d[2] for d in held], int))
    some = np.flatnonzero(w.any(axis=1))
    index = np.zeros(buckets + 1, np.int32)  # row 0 has no weight
    index[some] = np.arange(1, len(some) + 1)
    scaled = np.zeros((len(some) + 1, len(langs)), np.float32)
    scaled[1:] = w[some] * idf[some, None] * SCALE
    return {"langs": langs, "index": index, "weights": scaled, "temperature": t}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Every input row with ``lang_pred`` and ``score``, its calibrated probability.

    A text that is null or has no letter, or a model that was taught no language, gives 'und' and 0.0. Whole texts
    are read, in slices. Equal texts get equal results; repeated rows a row each. Input columns named lang_pred or score are replaced; nothing but the text is looked at;
    an empty table gives an empty table.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most buckets x MOST_LANGUAGES floats
    letters = F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False))

    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        langs, index, w, temp = m["langs"], m["index"], m["weights"], m["temperature"]
        for column in texts:
            best, score = np.zeros(len(column), int), np.zeros(len(column))
            for first, last, data, offsets in slices(column):
                if not langs:
                    break
                grams, starts = gram_buckets(data, offsets, len(index) - 1)
                logits, total = np.zeros((last - first, len(langs))), np.zeros(last - first)
                for g in grams:
                    logits += np.add.reduceat(w[index[g]], starts[:-1], axis=0)
                    total += np.add.reduceat(g < len(index) - 1, starts[:-1], dtype=np.int64)
                s = logits / np.maximum(total, 1)[:, None] / temp
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best[first:last], score[first:last] = p.argmax(axis=1), p.max(axis=1)
            names = np.array([*langs, UNKNOWN], object)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    @F.arrow_udf("struct<lang_pred string, score double>")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(judged)(texts)

    out = docs.withColumn("_j", judge(F.col(text_col)))
    return out.select(
        *own,
        F.when(letters, F.col("_j.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.least(F.col("_j.score"), F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def held_out(id_col: str) -> Column:
    """True for the fifth of ids that models are tested on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out("doc_id")).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
