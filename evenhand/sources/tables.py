"""Readers and writers of the audit's tables, input resolution, staleness-checked materialisation."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How CSV spells the floats that are no numbers
FLOATS = {"nanValue": "NaN", "positiveInf": "inf", "negativeInf": "-inf"}
IMAGE_SUFFIX, MASK_SUFFIX = ".nii.gz", "_SEG.nii.gz"
#: What Spark's writers put for a folder's null, and the characters that they spell as hexadecimal digits
NO_VALUE, ESCAPED = "__HIVE_DEFAULT_PARTITION__", r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, **FLOATS)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, **FLOATS)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.json(path, schema=schema, multiLine=True)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).csv(path, header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The folder's name for the machine's own calls where it is on a mounted file system, else None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _texts(folder: str, by: list[str]):
    """Writes sorted lines; a file gets its name once it is whole, and one that is there is replaced by its like."""

    def close(key: tuple, parts: list[bytes]) -> None:
        names = [NO_VALUE if k is None else re.sub(ESCAPED, lambda m: f"%{ord(m[0]):02X}", k) for k in key]
        at = os.path.join(folder, *[f"{c}={n}" for c, n in zip(by, names, strict=True)])
        os.makedirs(at, exist_ok=True)
        new = os.path.join(at, f".{uuid.uuid4().hex}")
        with open(new, "wb") as f:
            f.writelines(parts)
        os.replace(new, os.path.join(at, "part-0.txt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made = None, [], 0
        for b in batches:
            if not len(b):
                continue
            codes = [b[c].dictionary_encode("encode").indices.to_numpy() for c in by]
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(b)], pa.int32()), b["line"]), "\n")
            for i, lo in enumerate(starts.tolist()):
                own = tuple(b[c][lo].as_py() for c in by)
                if held and own != key:
                    close(key, held)
                    held, made = [], made + 1
                key = own
                held += [texts[i].as_buffer().to_pybytes(), b"\n"]
        if held:
            close(key, held)
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["files"])

    return run


def write_texts(lines: DataFrame, path: str, by: Sequence[str], line: str = "line") -> None:
    """A text file for each combination of the columns ``by``, in folders of their names and values as Spark's writer lays them out.

    Hadoop's file system of mounted folders starts processes for each file that it makes, to set its rights; there, tasks
    write their files by themselves. Elsewhere Spark's writer does. A task holds one file's lines at a time.
    """
    keys = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    rows = lines.select(*keys, F.coalesce(line, F.lit("")).alias("line")).repartition(*by)
    folder = local_path(lines.sparkSession, path)
    if folder is None:
        rows.write.partitionBy(*by).text(path)
        return
    os.makedirs(folder)
    rows.sortWithinPartitions(*by).mapInArrow(_texts(folder, list(by)), "files long").agg(F.sum("files")).collect()


def write_folds(rows: DataFrame, path: str) -> None:
    """(fold, role, id) as JSON lines, a folder for each fold and role; no fold has to fit in a row."""
    rows.write.mode("overwrite").partitionBy("fold", "role").json(path)


def write_stats(stats: DataFrame, path: str, key: str = "stat_key") -> None:
    """A table of figures as JSON lines {key, value}: one line for each key, with the other columns as an object."""
    rest = [c for c in stats.columns if c != key]
    stats.select(F.col(key).alias("key"), F.struct(*rest).alias("value")).write.mode("overwrite").json(path)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """What is listed and read within the block takes some hundreds of small files a task, where the session still has Spark's defaults.

    These count a file as 4 MB, so 32 of them fill a task, and list each folder in a task of its own.
    """
    fewer = {"spark.sql.files.openCostInBytes": ("4194304b", "256k"), "spark.sql.sources.parallelPartitionDiscovery.parallelism": ("10000", str(8 * spark.sparkContext.defaultParallelism))}
    changed = [k for k, (default, _) in fewer.items() if spark.conf.get(k) == default]
    try:
        for k in changed:
            spark.conf.set(k, fewer[k][1])
        yield
    finally:
        for k in changed:
            spark.conf.unset(k)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))


def image_files(annotations: DataFrame, name: str = "file_name", series: str = "series") -> DataFrame:
    """(series_submitter_id, filename) of images: masks are left out."""
    return annotations.filter(~F.col(name).endswith(MASK_SUFFIX)).select(F.col(series).alias("series_submitter_id"), F.col(name).alias("filename"))


def mask_name(filename):
    return F.regexp_replace(filename, r"\.nii\.gz$", MASK_SUFFIX)


def resolve_pairs(wanted: DataFrame, key: str, predictions: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that both listings have, and the others with what they lack: (work, missing)."""
    p = predictions.select(key).distinct().withColumn("_p", F.lit(True))
    r = references.select(key).distinct().withColumn("_r", F.lit(True))
    both = wanted.join(p, key, "left").join(r, key, "left")
    lack = F.concat_ws(",", F.when(F.col("_p").isNull(), "prediction"), F.when(F.col("_r").isNull(), "reference"))
    out = both.withColumn("missing", lack)
    return out.filter("missing = ''").drop("_p", "_r", "missing"), out.filter("missing <> ''").drop("_p", "_r")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def missing_paths(spark: SparkSession, paths: Sequence[str | None]) -> list[str | None]:
    """Of the paths, those that no file system has; an absent path is missing."""
    return [p for p in paths if p is None or not exists(spark, p)]


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, sources: Sequence[str] = (), force: bool = False) -> DataFrame:
    """The Parquet table at ``path``, built where it is absent or older than any file of ``sources`` (none: never stale)."""

    def newest(where: str):
        return listing(spark, where).agg(F.max("modified")).first()[0]

    made = newest(path) if exists(spark, path) else None
    if force or made is None or any((t := newest(s)) is not None and t > made for s in sources):
        replace_table(spark, build(), path)
    return spark.read.parquet(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and move it there once it is whole: a failed build leaves the old table as it was."""
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(new), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"cannot move {new}")
    fs.delete(at(old), True)
