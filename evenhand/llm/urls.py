"""URL filters: host rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import cut

#: (rule, verdict) of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_suffix_rate", "f_suffix_log")
#: Of labelled urls, every fifth by hash is held back; the others' suffix rates leave their own fifth out.
FOLDS = 5
#: Suffixes up to this many are broadcast; more are joined by a shuffle.
BROADCAST_SUFFIXES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null: a rule fits its host and all subdomains, on its path prefix."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # later, longer rules win
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits; 0.0 for the empty string."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    parts = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Add the features that the url alone gives, and its suffix: the host's last two labels."""
    u = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({
        "f_length": F.length(u).cast("double"),
        "f_depth": F.size(F.filter(F.split(F.col(path), "/"), lambda x: x != "")).cast("double"),
        "f_digits": F.regexp_count(u, F.lit("[0-9]")).cast("double") / F.greatest(F.length(u), F.lit(1)),
        "f_entropy": entropy(u),
        "f_params": F.regexp_count(u, F.lit("[?&][^=&#]*=")).cast("double"),
        "f_labels": F.size(F.split(F.col(host), r"\.")).cast("double"),
        "f_hyphens": F.regexp_count(F.col(host), F.lit("-")).cast("double"),
        "_suffix": F.substring_index(F.col(host), ".", -2),
    })


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    label: Column | None = None,
    sample_rows: int = 20_000,
    trees: int = 10,
    depth: int = 4,
    seed: int = 7,
    report: dict | None = None,
) -> DataFrame:
    """Every input row with host, path, rule, verdict ('block' or 'allow') and block_score.

    The rule's verdict holds where one fits. The other urls are judged by gradient-boosted trees trained on labelled
    urls: ``label`` (1 blocks, 0 allows, null teaches nothing), or else what the rules say of the urls they fit. Trees
    are fitted on at most ``sample_rows`` labelled rows (lowest url hashes); suffix statistics are counted over all rows:
    the magnitude of a suffix's number of rows, and the smoothed share that is blocked among its labelled ones. A taught
    row's share leaves its own fifth of the urls out; where the rules made the labels, all that its own rule labelled, so
    that a share tells what other rules say of the suffix, and never repeats the row's.

    One fifth of the sample is held back; ``report``, if given, gets 'taught' and 'held_out' (rows) and 'accuracy' and
    'base_rate' (of the held-out rows: how many are judged right, and the share of the commoner label).

    Null urls and urls without '://' have an empty host and path and are judged by the trees too. Where the labels are
    all alike or absent, that verdict (or 'allow') holds for all. Equal urls get equal verdicts; input columns with an
    output's name are replaced; an empty table gives an empty table.
    """
    made = ("host", "path", "rule", "verdict", "block_score")
    df = pages.withColumn("_url", F.col(url_col)).withColumn("_label0", label if label is not None else F.lit(None).cast("int"))
    df = df.drop(*[c for c in made if c in pages.columns])
    host, path = host_and_path(F.col("_url"))
    df = df.withColumn("host", host).withColumn("path", path).withColumn("_rule", match_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("int"))
    df = df.withColumn("_label", F.coalesce("_label0", own).cast("double"))
    # what a taught row's suffix share leaves out: its fold, or, where rules made the labels, all that its own rule labelled
    parts = FOLDS if label is not None else len(rules)
    fold = lambda: F.pmod(F.xxhash64(F.lit("fold"), "_url"), F.lit(FOLDS)).cast("int")
    leave = fold() if label is not None else (F.array_position(F.array(*[F.lit(r) for r, _ in rules]), F.col("_rule.rule")) - 1).cast("int")
    df = df.withColumn("_leave", leave)
    known = lexical(df.select("_url", "host", "path", "_label", "_leave"), "_url", "host", "path")
    total = known.agg(F.coalesce(F.avg("_label"), F.lit(0.0)).alias("share"), F.countDistinct("_label").alias("kinds")).first()
    share, kinds = total["share"], total["kinds"]
    in_part = lambda v: [F.coalesce(F.sum(F.when(F.col("_leave") == i, v)), F.lit(0.0)) for i in range(parts)]
    suffixes = known.groupBy(F.col("_suffix").alias("_s")).agg(
        F.array(*in_part(F.col("_label"))).alias("_sums"), F.array(*in_part(F.col("_label").isNotNull().cast("double"))).alias("_counts"),
        F.floor(F.log2(F.count(F.lit(1)).cast("double"))).cast("double").alias("f_suffix_log"),
    )
    suffixes = cut(suffixes, "suffixes")
    side = F.broadcast(suffixes) if suffixes.count() <= BROADCAST_SUFFIXES else suffixes
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")

    def featured(rows: DataFrame, left_out: bool) -> DataFrame:
        """With the suffix statistics and the vector of all features."""
        rows = rows.join(side, rows["_suffix"] == side["_s"])
        total = lambda name: F.aggregate(name, F.lit(0.0), lambda a, b: a + b) - (F.coalesce(F.get(F.col(name), F.col("_leave")), F.lit(0.0)) if left_out else F.lit(0.0))
        rate = (total("_sums") + 10.0 * share) / (total("_counts") + 10.0)
        return vectors.transform(rows.withColumn("f_suffix_rate", rate).drop("_s", "_sums", "_counts"))

    if kinds < 2:
        score = df.withColumn("block_score", F.lit(float(share)))
    else:
        h = F.xxhash64(F.lit(seed), "_url")
        sample = known.filter("_label IS NOT NULL").orderBy(h, "_url").limit(sample_rows)
        sample = cut(featured(sample, True).select("_features", "_label", (fold() == 0).alias("_held")), "taught")
        gbt = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3, checkpointInterval=-1)
        some = sample.filter("NOT _held")
        model = gbt.fit(some if some.select("_label").distinct().count() == 2 else sample)
        if report is not None:
            held = model.transform(sample.filter("_held")).agg(
                F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("_label")).cast("double")).alias("right"), F.avg("_label").alias("blocked")
            ).first()
            report.update(taught=some.count(), held_out=held["n"], accuracy=held["right"], base_rate=held["blocked"] and max(held["blocked"], 1 - held["blocked"]))
        judged = model.transform(featured(lexical(df, "_url", "host", "path"), False))
        score = judged.withColumn("block_score", F.element_at(vector_to_array("probability"), 2))
    rule = F.col("_rule.rule")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    kept = [c for c in pages.columns if c not in made]
    return score.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "block_score")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
