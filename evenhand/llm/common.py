"""Shared helpers: the word definition, the shared scratch folder, salted ranks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as a character class; words are maximal runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Local sessions without one get a new local folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evenhand-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; ``temporary`` blocks that are open delete it in the end."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for made in _open_blocks():
        made.append(path)
    return path


def _open_blocks() -> list[list[str]]:
    if not hasattr(_LOCAL, "blocks"):
        _LOCAL.blocks = []
    return _LOCAL.blocks


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Scratch tables made in the block are deleted at its end, but for those given to the function it yields.

    Results that leave the block must rest on kept tables only.
    """
    made: list[str] = []
    kept: set[str] = set()
    _open_blocks().append(made)
    try:
        yield lambda *tables: kept.update(t.scratch_path for t in tables if t is not None)
    finally:
        _open_blocks().remove(made)
        for path in made:
            if path not in kept:
                remove(spark, path)


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, lost executors cost nothing earlier."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def cut_bucketed(df: DataFrame, key: str, buckets: int, what: str) -> DataFrame:
    """``cut``, with rows in buckets by ``key``: what is joined or grouped by it afterwards is not shuffled again.

    The table's name goes from the catalog at once; its files stay in the shared folder.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    name = f"{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    spark.sql(f"DROP TABLE {name}")
    return out


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Where the session still has Spark's defaults, set fewer rows and bytes an Arrow batch, as whole texts are long rows.

    Printed plans are cut too: the driver prints each plan again at each of its stages and keeps what it prints, and plans
    here have long literals and many steps. Plans read these settings when they run, so they stay set.
    """
    whole = (str((1 << 63) - 1), str((1 << 31) - 1), str((1 << 31) - 16))
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), rows), "spark.sql.execution.arrow.maxBytesPerBatch": (whole, size), "spark.sql.maxPlanStringLength": (whole, 10_000)}
    for key, (default, most) in limits.items():
        if spark.conf.get(key) in default:
            spark.conf.set(key, str(most))


def lean(run: Callable) -> Callable:
    """A task function over Arrow batches that hands its memory back when it ends.

    Spark keeps Python workers for later tasks, and allocators keep what was freed: beside the JVM's heap, that adds up.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Hand freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def word_count(text: Column) -> Column:
    """Words of ``text`` as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_part(key: Column, seed: str, digits: int = 6) -> Column:
    """The first hex digits of md5(seed:key) as a long; null keys count as the empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def salted_rank(df: DataFrame, group: list[str], coarse: list[Column], fine: list[Column], to: str, counted: DataFrame | None = None) -> DataFrame:
    """Add ``to``, the 1-based rank of each row within ``group``, without one task per group.

    ``coarse`` cuts each group into runs that come one after another (ascending, in this order); only the rows of
    one run are sorted together, by ``fine``. Runs' offsets are sums over their counts, of which there is one row
    a run. ``counted`` may hold the same rows with fewer columns, for the counts.
    """
    names = [f"_run{i}" for i in range(len(coarse))]
    runs = df.withColumns(dict(zip(names, coarse, strict=True)))
    keys = [*group, *names]
    counts = (runs if counted is None else counted.withColumns(dict(zip(names, coarse, strict=True)))).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_before")
    ranked = runs.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*fine)))
    on = [ranked[k].eqNullSafe(offsets[f"_o{i}"]) for i, k in enumerate(keys)]
    on_all = on[0]
    for c in on[1:]:
        on_all = on_all & c
    out = ranked.join(offsets, on_all, "left").withColumn(to, (F.col("_at") + F.col("_before")).cast("long"))
    return out.drop("_at", "_before", *names, *[f"_o{i}" for i in range(len(keys))])
