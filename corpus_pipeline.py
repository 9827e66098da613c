"""A corpus pipeline: quality rules, language, near duplicates, mixing, tokens; each stage feeds the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.bpe import ByteBpe, digests, public_vocabulary
from evenhand.llm.common import cut, word_count
from evenhand.llm.langid import UNKNOWN, held_out, predict, train
from evenhand.llm.line_rules import clean_lines
from evenhand.llm.mixing import emit, mix
from evenhand.llm.ngram_join import ngram_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Id tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Texts whose language is less certain than this go.
LEAST_SCORE = 0.5


def _side(ids: DataFrame) -> DataFrame:
    ids = cut(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


# Every stage reads the columns of documents only: other columns are left out, whatever their names. Whole texts are read.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail or lose too much.

    Null and empty texts fail. Rows are judged one by one by their text alone: rows that are repeated or share an id get
    equal or separate verdicts, and nulls in other columns stay. An empty table gives an empty table.
    """
    kept = clean_lines(docs.select(*COLUMNS)).filter("kept")
    return kept.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the predicted language; those without one, or with an uncertain one, go.

    Rows with null texts go; rows with a null language teach nothing and get one; null ids teach and are judged. Equal
    texts are judged alike. Where no row has a language, all rows go; an empty table gives an empty table.
    """
    model = train(docs.filter(~held_out("doc_id")).select("doc_id", "text", "lang"))
    judged = predict(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return judged.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id stays.

    Of rows that repeat an id, the least (text, lang, source, n_chars) stays. Rows with a null id link with nothing and
    stay; so do null and empty texts, each by itself. An empty table gives an empty table.
    """
    groups = cut(ngram_components(docs.select(*COLUMNS)), "components")
    gone = groups.filter("doc_id <> component_id").select("doc_id")
    again = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    again = cut(again, "again")
    rows = docs.select(*COLUMNS).join(_side(gone.union(again)), "doc_id", "left_anti").select(*COLUMNS)
    least = docs.select(*COLUMNS).join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_r"))
    return rows.union(least.select("doc_id", "_r.*"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words are never taken. Null sources are one source; null and repeated ids are rows like any other,
    each with its own copies. An empty table gives an empty table.
    """
    return emit(mix(docs.select(*COLUMNS), size=word_count(F.col("text"))), COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that was taken.

    Null and empty texts have no tokens; repeated rows and ids have a row each; an empty table gives an empty table.
    """
    bpe = ByteBpe(spark, public_vocabulary())
    return digests(bpe.encode(docs.select("doc_id", "text"), decoded=True), "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_join", near_duplicates),
    ("mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The language model is trained by iteration, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
