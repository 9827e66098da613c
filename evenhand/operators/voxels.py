"""Segmentation scores over a voxel table (case_id, x, y, z, ref, pred); grid voxels without a row are background."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.exprs import NAN
from evenhand.operators.surfaces import robust_hausdorff
from evenhand.sources.scratch import cut

# The labels of the two structures
LABELS = {"vb": 1, "disc": 2}


def segmentation_counts(voxels: DataFrame, labels: dict[str, int] = LABELS) -> DataFrame:
    """tp, fp, fn, ref and pred voxels of each case and label."""
    rows = voxels.select("case_id", "ref", "pred", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("v")) for k, v in labels.items()])).alias("l"))
    r, p = F.col("ref") == F.col("l.v"), F.col("pred") == F.col("l.v")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return rows.groupBy("case_id", F.col("l.label").alias("label")).agg(count(r & p, "tp"), count(p & ~r, "fp"), count(r & ~p, "fn"), count(r, "ref_n"), count(p, "pred_n"))


def dice(counted: DataFrame) -> DataFrame:
    """2 |P and R| / (|P| + |R|): NaN where both are empty, so 0 where one is."""
    both = F.col("ref_n") + F.col("pred_n")
    return counted.select("case_id", "label", F.when(both == 0, F.lit(NAN)).otherwise(2.0 * F.col("tp") / both).alias("dice"))


def ndsc(counted: DataFrame, volumes: DataFrame) -> DataFrame:
    """Dice normalised to the data set's mean share of the label; NaN where tp and ref are 0, 0 where either is."""
    full = counted.join(volumes.select("case_id", (F.col("nx") * F.col("ny") * F.col("nz")).alias("total")), "case_id")
    load = full.groupBy("label").agg(F.avg(F.col("ref_n") / F.col("total")).alias("r"))
    d = full.join(F.broadcast(load), "label")  # a row a label
    kappa = (1 - F.col("r")) * F.col("ref_n") / (F.col("r") * (F.col("total") - F.col("ref_n")))
    value = 2.0 * F.col("tp") / (kappa * F.col("fp") + 2.0 * F.col("tp") + F.col("fn"))
    none = (F.col("tp") == 0) & (F.col("ref_n") == 0)
    return d.select("case_id", "label", F.when(none, F.lit(NAN)).when((F.col("tp") == 0) | (F.col("ref_n") == 0), 0.0).otherwise(value).alias("ndsc"))


def each_label(rows: DataFrame, work: Callable[..., float], names: tuple[str, ...], to: str, kind: str) -> DataFrame:
    """(case_id, v, ``to``): ``work`` of the columns ``names`` of each case's label. Cases are sorted within tasks, so a batch serves many small ones."""
    case = rows.schema["case_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, like = None, [], None

        def one():
            return (*key, work(*[np.concatenate(c) for c in zip(*held, strict=True)]))

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            kinds = (like, pa.int32(), pa.float64() if kind == "double" else pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=False) for c, k in zip(columns, kinds, strict=True)], ["case_id", "v", to])

        for b in batches:
            if not len(b):
                continue
            like = b["case_id"].type
            cases, v = b["case_id"].dictionary_encode("encode").indices.to_numpy(), b["v"].to_numpy()
            columns = [b[c].to_numpy(zero_copy_only=False) for c in names]
            starts = np.flatnonzero(np.r_[True, (cases[1:] != cases[:-1]) | (v[1:] != v[:-1])])
            found = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
                own = (b["case_id"][lo].as_py(), int(v[lo]))
                if held and own != key:
                    found.append(one())
                    held = []
                key = own
                held.append([c[lo:hi] for c in columns])
            if found:
                yield batch(found)
        if held:
            yield batch([one()])

    sorted_ = rows.select("case_id", "v", *names).repartition("case_id").sortWithinPartitions("case_id", "v")
    return sorted_.mapInArrow(run, f"case_id {case}, v int, {to} {kind}")


def _surface_distance(weighted: bool):
    def work(x, y, z, in_ref, in_pred, sx, sy, sz) -> float:
        at = np.stack([x, y, z], axis=1).astype(np.int64)
        at = at - at.min(axis=0) + 1  # a border of background on all sides
        masks = []
        for side in (in_ref, in_pred):
            mask = np.zeros(at.max(axis=0) + 2, bool)
            mask[tuple(at[side.astype(bool)].T)] = True
            masks.append(mask)
        return robust_hausdorff(*masks, (float(sx[0]), float(sy[0]), float(sz[0])), weighted=weighted)

    return work


def hd95(voxels: DataFrame, volumes: DataFrame, labels: dict[str, int] = LABELS, weighted: bool = False) -> DataFrame:
    """The 95th percentile symmetric surface distance in mm (see ``surfaces.robust_hausdorff``).

    NaN where a label is empty on both sides, infinity where on one. A task holds one case's voxels of one label,
    which the scan's grid bounds, and works in time linear in the box around them.
    """
    inside = F.explode(F.array(*[F.lit(v) for v in labels.values()]))
    rows = voxels.select("case_id", "x", "y", "z", "ref", "pred", inside.alias("v")).filter("ref = v OR pred = v")
    rows = rows.select("case_id", "v", "x", "y", "z", (F.col("ref") == F.col("v")).alias("in_ref"), (F.col("pred") == F.col("v")).alias("in_pred"))
    rows = rows.join(volumes.select("case_id", "sx", "sy", "sz"), "case_id")
    found = each_label(rows, _surface_distance(weighted), ("x", "y", "z", "in_ref", "in_pred", "sx", "sy", "sz"), "hd95", "double")
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("v")) for k, v in labels.items()]))
    every = voxels.select("case_id").distinct().select("case_id", names.alias("l")).select("case_id", "l.label", "l.v")
    return every.join(found, ["case_id", "v"], "left").select("case_id", "label", F.coalesce("hd95", F.lit(NAN)).alias("hd95"))


def case_scores(voxels: DataFrame, volumes: DataFrame, metrics: tuple[str, ...] = ("dice", "hd95", "ndsc"), weighted: bool = False) -> DataFrame:
    """One row per case with <metric>_<label>; unknown metric names are an error. ``weighted`` is for hd95."""
    if unknown := set(metrics) - {"dice", "hd95", "ndsc"}:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    voxels = cut(voxels.select("case_id", "x", "y", "z", "ref", "pred"), "voxels")  # each metric reads it
    counted = cut(segmentation_counts(voxels), "counts")
    parts = {"dice": lambda: dice(counted), "ndsc": lambda: ndsc(counted, volumes), "hd95": lambda: hd95(voxels, volumes, weighted=weighted)}
    out = voxels.select("case_id").distinct()
    for m in metrics:
        wide = parts[m]().groupBy("case_id").pivot("label", list(LABELS)).agg(F.first(m))
        out = out.join(wide.withColumnsRenamed({k: f"{m}_{k}" for k in LABELS}), "case_id", "left")
    return out


def pair_masks(ref: DataFrame, pred: DataFrame, sparse: bool = False) -> DataFrame:
    """Voxel rows (case_id, x, y, z, ref, pred) of two mask tables (case_id, x, y, z, v), with a status of their case.

    Full tables have a row for each voxel, and a case's status is 'shape_mismatch' where a side lacks some. In ``sparse``
    ones what has no row is background, and grids are compared beforehand.
    """
    both = ref.withColumnRenamed("v", "ref").join(pred.withColumnRenamed("v", "pred"), ["case_id", "x", "y", "z"], "full")
    if sparse:
        return both.na.fill(0, ["ref", "pred"]).withColumn("status", F.lit("ok"))
    bad = both.groupBy("case_id").agg(F.max(F.col("ref").isNull() | F.col("pred").isNull()).alias("_bad"))
    return both.join(bad, "case_id").withColumn("status", F.when(F.col("_bad"), "shape_mismatch").otherwise("ok")).drop("_bad")


def label_volumes(voxels: DataFrame, volumes: DataFrame, column: str = "ref") -> DataFrame:
    """Voxels and mm3 of each label of each case."""
    size = volumes.select("case_id", (F.col("sx") * F.col("sy") * F.col("sz")).alias("mm3"))
    names = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (v, k)])
    n = voxels.filter(F.col(column).isin(*LABELS.values())).groupBy("case_id", names[F.col(column)].alias("label")).agg(F.count(F.lit(1)).alias("n_voxels"))
    return n.join(size, "case_id").select("case_id", "label", "n_voxels", (F.col("n_voxels") * F.col("mm3")).alias("volume_mm3"))


def _components(x, y, z) -> int:
    """Roots by minimum labels over face neighbours with pointer jumping; one case's label at a time."""
    p = np.stack([x, y, z], axis=1).astype(np.int64)
    p -= p.min(axis=0)
    dims = p.max(axis=0) + 2
    code = (p[:, 0] * dims[1] + p[:, 1]) * dims[2] + p[:, 2]
    order = np.argsort(code)
    code = code[order]
    edges = []
    for step in (dims[1] * dims[2], dims[2], 1):
        at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        hit = np.flatnonzero(code[at] == code + step)
        edges.append(np.stack([hit, at[hit]], axis=1))
    e = np.concatenate(edges)
    label = np.arange(len(code))
    while True:
        low = label.copy()
        least = np.minimum(label[e[:, 0]], label[e[:, 1]])
        np.minimum.at(low, e[:, 0], least)
        np.minimum.at(low, e[:, 1], least)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return len(np.unique(label))


def connected_components(voxels: DataFrame, column: str = "ref") -> DataFrame:
    """Face-connected components of each label of each case; a task holds one case's label, which the grid bounds."""
    rows = voxels.filter(F.col(column).isin(*LABELS.values())).select("case_id", F.col(column).alias("v"), "x", "y", "z")
    out = each_label(rows, _components, ("x", "y", "z"), "n_components", "long")
    names = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (v, k)])
    return out.select("case_id", names[F.col("v")].alias("label"), "n_components")


def geometry(volumes: DataFrame) -> DataFrame:
    """Total voxels, physical sizes, aspect ratios and anisotropy of grids with three dimensions and spacings."""
    c = F.col
    whole = volumes.filter("nx > 0 AND ny > 0 AND nz > 0 AND sx > 0 AND sy > 0 AND sz > 0")
    out = whole.withColumns({
        "total_voxels": c("nx").cast("long") * c("ny") * c("nz"),
        "physical_width": c("nx") * c("sx"), "physical_height": c("ny") * c("sy"), "physical_depth": c("nz") * c("sz"),
    })
    return out.withColumns({
        "physical_volume": c("physical_width") * c("physical_height") * c("physical_depth"),
        "aspect_ratio_xy": c("physical_width") / c("physical_height"),
        "aspect_ratio_xz": c("physical_width") / c("physical_depth"),
        "aspect_ratio_yz": c("physical_height") / c("physical_depth"),
        "anisotropy_factor": c("sz") / F.sqrt(c("sx") * c("sy")),
    })


def foreground_box(image: DataFrame, share: float = 0.05) -> DataFrame:
    """Per case the bounds of pixels above ``share`` of the maximum; the whole image where there are none."""
    top = image.groupBy("case_id").agg(F.max("intensity").alias("top"))
    d = image.join(top, "case_id")
    on = F.col("intensity") > share * F.col("top")
    bounds = [f(F.when(on, F.col(a))).alias(f"{a}_{n}") for a in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
    whole = [f(a).alias(f"_{a}_{n}") for a in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
    out = d.groupBy("case_id").agg(*bounds, *whole)
    names = [f"{a}_{n}" for a in ("x", "y") for n in ("lo", "hi")]
    return out.select("case_id", *[F.coalesce(n, f"_{n}").alias(n) for n in names])


def crop(image: DataFrame, share: float = 0.05) -> DataFrame:
    box = foreground_box(image, share)
    inside = F.col("x").between(F.col("x_lo"), F.col("x_hi")) & F.col("y").between(F.col("y_lo"), F.col("y_hi"))
    return image.join(box, "case_id").filter(inside).drop("x_lo", "x_hi", "y_lo", "y_hi")


def rescale(image: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Intensities from 0 to 1 within each case."""
    ends = image.groupBy("case_id").agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
    value = (F.col("intensity") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(eps))
    return image.join(ends, "case_id").withColumn("scaled", value).drop("_lo", "_hi")


def mid_slice(image: DataFrame, volumes: DataFrame) -> DataFrame:
    """The plane x = nx div 2 of each case."""
    return image.join(volumes.select("case_id", F.floor(F.col("nx") / 2).alias("_x")), "case_id").filter("x = _x").drop("_x")


def intensity_window(image: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Linear percentiles of the non-zero intensities of each case."""
    some = image.filter("intensity <> 0").groupBy("case_id")
    return some.agg(F.percentile("intensity", lo).alias("window_lo"), F.percentile("intensity", hi).alias("window_hi"))
