"""Quality rules, line first: drop failing lines, then reject documents that lose too much. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import SPACE, WORD

#: Phrases that mark a line as page furniture or a notice rather than prose.
BOILERPLATE = (
    r"(?i)all rights reserved|privacy policy|terms of (?:use|service)|cookie(?:s| policy| settings)"
    r"|click here|read more|sign (?:in|up)\b|log in\b|subscribe (?:now|to)|skip to content|back to top"
    r"|share (?:this|on)\b|enable javascript|copyright (?:\(c\)|©|[0-9]{4})|licensed under|spdx-license"
)
#: A line with this many separators is a menu or a table row.
NAVIGATION = r"(?:[|»›•·].*){3}"
#: How a sentence ends: a mark, then closing quotes and brackets, then white space. Longer lines without are fragments.
ENDING = r"[.!?…:;。？！؟][\"'”’»)\]]*[\x20\x09-\x0D]*\z"

WINDOW = 8


def base_columns(text: Column) -> dict[str, Column]:
    """First step of the counts: words as an array, and counts that read the text alone. Null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return {
        "_words": F.filter(F.split(whole, SPACE + "+"), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace(whole, SPACE + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
    }


def repeat_counts(df: DataFrame) -> DataFrame:
    """Add n_words, n_dup_lines and n_repeat_words to rows with _words and _lines.

    Windows of eight words are hashed; sorting (hash, position) puts equal windows side by side, and the words
    that the repeated ones cover are summed from gaps between their positions. Texts whose windows are all
    distinct skip the sort.
    """
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    starts = F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))
    df = df.withColumn("_windows", F.when(F.size("_hashes") > WINDOW, windows))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda s, i: (F.get("_sorted", i - 1)["h"] == s["h"]) | (F.get("_sorted", i + 1)["h"] == s["h"])
    places = F.sort_array(F.transform(F.filter("_sorted", lambda s, i: F.coalesce(near(s, i), F.lit(False))), lambda s: s["i"]))
    # neighbours beyond the ends are null, and null | false is null: coalesce above makes that false
    df = df.withColumn("_places", places)
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("_hashes", "_windows", "_sorted", "_places")


def line_passes(line: Column, long_line: int) -> Column:
    """The rules of one line that has a word: no menu, no notice, and a sentence's end if it has ``long_line`` words."""
    bare = (F.regexp_count(line, F.lit(WORD)) >= long_line) & ~line.rlike(ENDING)
    return ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE) & ~bare


def clean_lines(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5, long_line: int = 12, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """Every input row with its cleaned text, the base counts and the verdict.

    Lines (split at newlines) that fail a rule go; ``cleaned`` joins the others. A document is kept unless it fails
    the base rule (fewer than ``min_words`` words, or more than ``max_repeat_pct`` percent of them in repeated
    8-word windows) or its lines lose more than ``max_loss`` of its word characters.

    Adds cleaned (string), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars (long),
    base_failed, kept (boolean); input columns of these names are replaced. Null and empty texts have no words, so
    they fail the base rule with cleaned ''; rows are judged one by one, so ties and repeated rows get equal
    results; an empty table gives an empty table.
    """
    made = ("cleaned", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept")
    df = docs.withColumn("_text", docs[text_col]).drop(*[c for c in made if c in docs.columns])
    df = repeat_counts(df.withColumns(base_columns(F.col("_text"))))
    blank_or_good = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x, long_line)
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), blank_or_good)
    df = df.withColumn("cleaned", F.array_join(lines, "\n"))
    df = df.withColumn("kept_chars", F.length(F.regexp_replace("cleaned", SPACE + "+", "")).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= (1 - max_loss) * F.col("word_chars")))
    kept = [c for c in docs.columns if c not in made]
    # results come out of a generator of one row each: a filter on them is not pushed down, so that the optimiser does
    # not spell the whole chain out again in the filter
    return df.select(*kept, F.explode(F.array(F.struct(*made))).alias("_o")).select(*kept, *[F.col(f"_o.{c}").alias(c) for c in made])


def op7_line_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return clean_lines(docs).select(*out)


#: DuckDB SQL of op7_line_rules.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, i - prev)) AS n FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r) GROUP BY doc_id),
b AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(array_to_string(list_filter(l, lambda x:
               NOT regexp_matches(x, '{NAVIGATION}') AND NOT regexp_matches(x, '{BOILERPLATE}')
               AND NOT (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 12 AND NOT regexp_matches(x, '{ENDING.replace("'", "''")}'))), chr(10)),
               '[\x20\x09-\x0D]+', '', 'g')) AS kept_chars
      FROM a LEFT JOIN c ON a.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars >= 0.5 * word_chars AS kept
FROM b
"""
