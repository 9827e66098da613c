"""Data sets for training: saved splits, case ids, manifests, descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.operators.splits import unique_ids
from evenhand.sources.tables import missing_paths, read_tsv, write_json, write_tsv

# The columns of a saved split, and the labels and channels that descriptors name
SPLIT_COLUMNS = ["split", "race_bin", "age_bin", "stratum", "annotation_quality"]
LABELS = {"background": 0, "vertebral_body": 1, "disc": 2}
CHANNELS = {"0": "MRI"}
FILE_ENDING = ".nii.gz"


def registry(spark: SparkSession, datasets: dict[int, tuple[str, str]]) -> DataFrame:
    """(dataset_id, name, split_version) of the data sets that a project trains on."""
    return spark.createDataFrame([(i, *v) for i, v in sorted(datasets.items())], "dataset_id int, name string, split_version string")


def split_path(folder: str, version: str) -> str:
    return f"{folder.rstrip('/')}/{version}.tsv"


def save_splits(splits: DataFrame, folder: str, version: str) -> None:
    write_tsv(splits, split_path(folder, version))


def load_splits(spark: SparkSession, folder: str, version: str, schema: str) -> DataFrame:
    path = split_path(folder, version)
    if missing_paths(spark, [path]):
        raise FileNotFoundError(path)
    return read_tsv(spark, path, schema)


def apply_splits(exams: DataFrame, splits: DataFrame, key: str = "series_submitter_id") -> DataFrame:
    """Exams with the split's columns; exams that it does not know keep nulls, and columns of these names are replaced."""
    own = [c for c in SPLIT_COLUMNS if c in splits.columns]
    return exams.drop(*own).join(splits.select(key, *own), key, "left")


def case_id(filename: Column, pattern: str, prefix: str) -> Column:
    """The prefix and the pattern's first group; null where the pattern is not found."""
    found = F.regexp_extract(filename, pattern, 1)
    return F.when(found != "", F.concat(F.lit(prefix), found))


def manifest(splits: DataFrame, files: DataFrame, pattern: str, prefix: str = "case_", key: str = "series_submitter_id", patient: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """(case_id, source_filename, key, patient, split) of every exam of the split that has a file, and violations.

    Exams that share an id get suffixes in the order of their key. Exams without a file, and files whose name has no
    case id, are violations (key, filename, problem), not rows.
    """
    both = splits.join(files.select(key, "filename"), key, "left").withColumn("_id", case_id(F.col("filename"), pattern, prefix))
    problem = F.when(F.col("filename").isNull(), "no_file").when(F.col("_id").isNull(), "no_case_id")
    good = unique_ids(both.filter("_id IS NOT NULL"), "_id", key)
    return good.select("case_id", F.col("filename").alias("source_filename"), key, patient, "split"), both.withColumn("problem", problem).filter("problem IS NOT NULL").select(key, "filename", "problem")


def descriptor(made: DataFrame, held_out: tuple[str, ...] = ("test",)) -> DataFrame:
    """One row: channels, labels, how many cases train, file ending."""
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    n = made.agg(F.count(F.when(~F.col("split").isin(*held_out), 1)).alias("num_training"), F.count(F.when(F.col("split").isin(*held_out), 1)).alias("num_test"))
    return n.select(as_map(CHANNELS).alias("channel_names"), as_map(LABELS).alias("labels"), "num_training", "num_test", F.lit(FILE_ENDING).alias("file_ending"))


def write_dataset(made: DataFrame, folder: str) -> None:
    """The mapping and the descriptor as JSON lines below ``folder``."""
    write_json(made, f"{folder}/case_id_mapping")
    write_json(descriptor(made), f"{folder}/dataset")


def fold_cases(folded: DataFrame, made: DataFrame, key: str = "series_submitter_id") -> DataFrame:
    """Folds of exams as folds of case ids; exams without a case are left out."""
    return folded.join(made.select(key, "case_id"), key).select("fold", "case_id")


def with_demographics(embeddings: DataFrame, exams: DataFrame, key: str = "series_submitter_id") -> DataFrame:
    """Embeddings with their exams' attributes; those without an exam are left out."""
    return embeddings.join(exams, key)


def drop_ids(*lists: DataFrame, key: str = "patient_id") -> DataFrame:
    """The union of several lists of ids to leave out."""
    out = lists[0].select(key)
    for more in lists[1:]:
        out = out.union(more.select(key))
    return out.distinct()
