"""From mask files to case scores in one job: files are listed, decoded where they are read, paired, and scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.operators import voxels as v
from evenhand.sources.scratch import cut
from evenhand.sources.tables import small_files

#: What a decoder makes of a file's bytes: the labels of a grid, and the spacing of its voxels in mm.
Decoder = Callable[[bytes], tuple[np.ndarray, tuple[float, ...]]]
#: Masks and voxels that a decoding task holds before it hands them on.
BATCH = 1 << 18
_KINDS = [("case_id", pa.string()), ("status", pa.string()), *[(c, pa.int32()) for c in ("nx", "ny", "nz")], *[(c, pa.float64()) for c in ("sx", "sy", "sz")], *[(c, pa.int32()) for c in ("x", "y", "z", "v")]]
_SCHEMA = "case_id string, status string, nx int, ny int, nz int, sx double, sy double, sz double, x int, y int, z int, v int"


def _decoded(decode: Decoder):
    def batch(columns: dict[str, object], n: int) -> pa.RecordBatch:
        held = lambda c, k: columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], k)
        return pa.RecordBatch.from_arrays([held(c, k) if c in columns else pa.nulls(n, k) for c, k in _KINDS], [c for c, _ in _KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, cases, parts, held = {}, [], [], 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            """What is held: a row a mask, and its voxels; small masks share a batch."""
            if n := len(heads["case_id"]):
                yield batch(heads, n)
            if parts:
                sizes = [len(p[0]) for p in parts]
                of = pa.array(cases, pa.string()).take(pa.array(np.repeat(np.arange(len(cases)), sizes)))
                yield batch({"case_id": of} | {c: np.concatenate(p) for c, p in zip("xyzv", zip(*parts, strict=True), strict=True)}, sum(sizes))

        def clear() -> None:
            nonlocal heads, cases, parts, held
            heads, cases, parts, held = {c: [] for c, _ in _KINDS[:8]}, [], [], 0

        clear()
        for b in batches:
            for i in range(len(b)):
                case = b["case_id"][i].as_py()
                try:
                    grid, spacing = decode(b["content"][i].as_py())
                    grid, spacing = np.asarray(grid), [float(s) for s in spacing]
                    if grid.ndim != 3 or len(spacing) < 3 or not all(np.isfinite(s) and s > 0 for s in spacing[:3]):
                        raise ValueError(f"not a grid of three axes: shape {grid.shape}, spacing {spacing}")
                    row = [case, "ok", *grid.shape, *spacing[:3]]
                except Exception as e:  # noqa: BLE001  whatever a decoder meets is this file's
                    grid, row = np.zeros((0, 0, 0)), [case, f"unreadable: {type(e).__name__}: {e}"[:200], *[None] * 6]
                for c, x in zip(heads, row, strict=True):
                    heads[c].append(x)
                held += 1
                at = np.nonzero(grid)
                for lo in range(0, len(at[0]), BATCH):
                    own = tuple(a[lo : lo + BATCH] for a in at)
                    cases.append(case)
                    parts.append([a.astype(np.int32) for a in (*own, grid[own])])
                    held += len(own[0])
                    if held >= BATCH:
                        yield from handed_on()
                        clear()
                if held >= BATCH:
                    yield from handed_on()
                    clear()
        if held:
            yield from handed_on()

    return run


def read_masks(spark: SparkSession, folder: str, decode: Decoder, case: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """The masks below a folder: (case_id, status, grid and spacing), and voxels (case_id, x, y, z, v) that are not background.

    One file is one mask and one row; ``case`` is a regular expression whose first group is the case in a path, and files
    that it does not fit are left out. ``decode`` runs where the file is read; a file that it cannot read gets the status
    'unreadable: ...' and stops no other. Of files of one case, all must be readable and alike, or the case is unreadable.
    """
    found = F.regexp_extract("path", case, 1)
    with small_files(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        rows = files.select(found.alias("case_id"), "content").filter("case_id <> ''").mapInArrow(_decoded(decode), _SCHEMA)
        rows = cut(rows, "masks")
    heads = rows.filter("status IS NOT NULL").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("bad"), *[F.first(c, ignorenulls=True).alias(c) for c in ("nx", "ny", "nz", "sx", "sy", "sz")]
    )
    status = F.coalesce("bad", F.when(F.col("n") > 1, "unreadable: several files").otherwise("ok"))
    return heads.select("case_id", status.alias("status"), "nx", "ny", "nz", "sx", "sy", "sz"), rows.filter("status IS NULL").select("case_id", "x", "y", "z", "v")


def evaluate_masks(
    cases: DataFrame, references: tuple[DataFrame, DataFrame], predictions: tuple[DataFrame, DataFrame],
    metrics: tuple[str, ...] = ("dice", "hd95", "ndsc"), weighted: bool = True,
) -> DataFrame:
    """One row for each of ``cases`` (case_id and any further columns): status, what is missing, and <metric>_<label>.

    Status is 'missing' where a side has no file, 'unreadable' where it could not be decoded, 'shape_mismatch' where the
    grids differ, else 'ok'. Only cases that are ok have scores, and only they make the mean load of the normalised Dice. The
    spacing is the reference's. Scores go over labelled voxels; a case without any on either side has NaN scores.
    """
    if unknown := set(metrics) - {"dice", "hd95", "ndsc"}:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    names = ("status", "nx", "ny", "nz", "sx", "sy", "sz")
    side = lambda heads, mark: heads.select("case_id", *[F.col(c).alias(f"{mark}{c}") for c in names])
    both = cases.join(side(references[0], "_r_"), "case_id", "left").join(side(predictions[0], "_p_"), "case_id", "left")
    lack = F.concat_ws(",", F.when(F.col("_p_status").isNull(), "prediction"), F.when(F.col("_r_status").isNull(), "reference"))
    bad = (F.col("_r_status") != "ok") | (F.col("_p_status") != "ok")
    same = (F.col("_r_nx") == F.col("_p_nx")) & (F.col("_r_ny") == F.col("_p_ny")) & (F.col("_r_nz") == F.col("_p_nz"))
    status = F.when(lack != "", "missing").when(bad, "unreadable").when(~same, "shape_mismatch").otherwise("ok")
    why = F.concat_ws("; ", *[F.when(F.col(f"{m}status") != "ok", F.concat(F.lit(f"{n} "), F.col(f"{m}status"))) for m, n in (("_p_", "prediction"), ("_r_", "reference"))])
    judged = cut(both.withColumns({"status": status, "missing": lack, "problem": why}), "judged")
    good = judged.filter("status = 'ok'").select("case_id", *[F.col(f"_r_{c}").alias(c) for c in names[1:]]).distinct()
    of = lambda rows: rows.join(good.select("case_id"), "case_id", "left_semi")
    paired = v.pair_masks(of(references[1]), of(predictions[1]), sparse=True).drop("status")
    blank = good.select("case_id", *[F.lit(0).alias(c) for c in ("x", "y", "z", "ref", "pred")])  # keeps cases without labels
    scores = v.case_scores(paired.unionByName(blank), good, metrics, weighted)
    return judged.select(*cases.columns, "status", "missing", "problem").join(scores, "case_id", "left")
