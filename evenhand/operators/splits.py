"""Leakage-free stratified splits, balancing, folds and manifests; shuffles are orders of seeded md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.exprs import seeded
from evenhand.functions.ranks import hash_rank
from evenhand.operators.grouping import RACE_WBO, Grouping, age_bins

TEST_SHARE, VAL_SHARE = 0.2, 0.1


def with_strata(exams: DataFrame, by_sex: bool) -> DataFrame:
    """race_bin, age_bin and stratum; people of other races are one stratum."""
    race = Grouping("race_wbo", "race", RACE_WBO).column()
    df = exams.withColumn("race_bin", race).withColumn("age_bin", age_bins(F.col("age_at_imaging")))
    parts = ["race_bin", "age_bin", "sex"] if by_sex else ["race_bin", "age_bin"]
    own = F.when(F.col("race_bin").isin("White", "Black"), F.concat_ws("_", *parts)).otherwise("Other")
    return df.withColumn("stratum", own)


def split_patients(exams: DataFrame, by_sex: bool = True, seed: str = "42", patient: str = "patient_id", exam: str = "series_submitter_id") -> DataFrame:
    """Every exam with its patient's stratum and split. A patient's stratum is that of the first exam; of n patients in
    a stratum, max(1, round(0.2 n)) go to test and max(1, round(0.1 n)) to val, halves rounded to even."""
    df = with_strata(exams, by_sex)
    first = F.min(F.struct(exam, "race_bin", "age_bin", "stratum")).alias("_f")
    patients = df.groupBy(patient).agg(first).select(patient, "_f.race_bin", "_f.age_bin", "_f.stratum")
    sizes = patients.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    patients = hash_rank(patients, ["stratum"], seeded(seed, F.col(patient)), patient, "_r").join(F.broadcast(sizes), "stratum")  # a row a stratum
    n, r = F.col("_n"), F.col("_r")
    test, val = (F.greatest(F.lit(1), F.bround(n * share, 0).cast("int")) for share in (TEST_SHARE, VAL_SHARE))
    split = F.when(r <= test, "test").when(r <= test + val, "val").otherwise("train")
    placed = patients.withColumn("split", split).drop("_n", "_r")
    rest = exams.drop("race_bin", "age_bin", "stratum", "split")
    return rest.join(placed, patient)


def downsample(df: DataFrame, within: list[str], by: str, unit: str, seed: str = "42", majority: str | None = None) -> DataFrame:
    """Equal counts of the values of ``by`` within each cell of ``within``: the surplus of larger ones is dropped at random.

    With ``majority`` only rows of that value may be dropped.
    """
    n = df.groupBy(*within, by).agg(F.count(F.lit(1)).alias("_n"))
    least = n.groupBy(*within).agg(F.min("_n").alias("_least"))
    out = hash_rank(df, [*within, by], seeded(seed, F.col(unit)), unit, "_r").join(least, within)
    keep = F.col("_r") <= F.col("_least")
    if majority is not None:
        keep = keep | (F.col(by) != majority)
    return out.filter(keep).drop("_r", "_least")


def folds(df: DataFrame, stratum: str, unit: str, k: int = 5, seed: str = "42") -> DataFrame:
    """A fold from 0 to k-1 for each unit; sizes differ by one at most, in all and within each stratum.

    A unit's place is its rank within its stratum plus the sizes of the strata before.
    """
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = n.withColumn("_before", before).drop("_n")  # a row a stratum
    ranked = hash_rank(df, [stratum], seeded(seed, F.col(unit)), unit, "_r").withColumn("_r", F.col("_r") - 1)
    return ranked.join(F.broadcast(start), stratum).withColumn("fold", ((F.col("_r") + F.col("_before")) % k).cast("int")).drop("_r", "_before")


def unit_folds(df: DataFrame, stratum: str, unit: str, row: str, k: int = 5, seed: str = "42") -> DataFrame:
    """A fold for each row such that rows of one unit (a patient) share it; a unit's stratum is that of its first row."""
    units = df.groupBy(unit).agg(F.min(F.struct(row, stratum))[stratum].alias(stratum))
    return df.join(folds(units, stratum, unit, k, seed).select(unit, "fold"), unit)


def fold_rows(folded: DataFrame, unit: str, k: int = 5) -> DataFrame:
    """(fold, role, id): each unit in every fold, 'val' in its own and 'train' in the others; what large tables are saved as."""
    rows = folded.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.select(F.col("at").alias("fold"), F.when(F.col("at") == F.col("fold"), "val").otherwise("train").alias("role"), F.col(unit).alias("id"))


def fold_lists(folded: DataFrame, unit: str, k: int = 5) -> DataFrame:
    """(fold, train, val): sorted ids, the form in which a trainer reads them; a fold's ids are one row, so for tables whose ids fit in one."""
    rows = folded.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    is_val = F.col("at") == F.col("fold")
    return rows.groupBy(F.col("at").alias("fold")).agg(
        F.sort_array(F.collect_list(F.when(~is_val, F.col(unit)))).alias("train"), F.sort_array(F.collect_list(F.when(is_val, F.col(unit)))).alias("val")
    )


def leaks(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patients with exams in more than one split; none, if the split is sound."""
    return df.groupBy(patient).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def unique_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Ids that several rows share get the suffix _s0, _s1, ... in the order of ``order``."""
    w = Window.partitionBy(id_col)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn("case_id", F.when(n > 1, F.concat(F.col(id_col), F.lit("_s"), r.cast("string"))).otherwise(F.col(id_col)))


def provenance(df: DataFrame, gold_ids: DataFrame, key: str) -> DataFrame:
    """annotation_quality: gold for ids of the list, silver for the others."""
    gold = gold_ids.select(F.col(key)).distinct().withColumn("_g", F.lit(True))
    out = df.drop("annotation_quality").join(gold, key, "left")
    return out.withColumn("annotation_quality", F.when(F.col("_g"), "gold").otherwise("silver")).drop("_g")


def sample_k(df: DataFrame, k: int, unit: str, seed: str = "42") -> DataFrame:
    """k rows without replacement, the lowest seeded hashes."""
    return df.orderBy(seeded(seed, F.col(unit)), unit).limit(k)
