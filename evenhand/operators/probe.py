"""Linear probes of embeddings: PCA inside stratified folds, logistic regression, corrected intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.special import t_ppf
from evenhand.operators.hypothesis import auroc, balanced_accuracy
from evenhand.operators.ordered import holm, ks_two_sample
from evenhand.operators.splits import folds
from evenhand.sources.scratch import cut

#: Classes of an attribute at most, and numbers of the features that make a partition (fewer where a step costs more a number).
MOST_CLASSES, VALUES_A_PART = 1000, 1 << 22
COSTS = tuple(10.0**e for e in np.linspace(-4, 4, 10))


def embedding_columns(df: DataFrame, prefix: str = "emb_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def as_vector(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Add ``features`` from an array column, or from the wide columns emb_*."""
    array = F.col(column) if column in df.columns else F.array(*[F.col(c) for c in embedding_columns(df)])
    return df.withColumn("features", array_to_vector(array.cast("array<double>")))


def pca_2d(df: DataFrame, key: str) -> tuple[DataFrame, list[float]]:
    """(key, pc1, pc2) of centred vectors, and the shares of variance; signs are arbitrary."""
    model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_c", withMean=True, withStd=False), PCA(k=2, inputCol="_c", outputCol="_p")]).fit(df)
    v = vector_to_array("_p")
    return model.transform(df).select(key, v[0].alias("pc1"), v[1].alias("pc2")), [float(x) for x in model.stages[1].explainedVariance]


def components(df: DataFrame, key: str, k: int, keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, component, value): the first k principal components of centred vectors, from 1; signs are arbitrary."""
    model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="_p")]).fit(df)
    rows = model.transform(df).select(key, *(keep or []), F.posexplode(vector_to_array("_p")).alias("_i", "value"))
    return rows.select(key, *(keep or []), (F.col("_i") + 1).alias("component"), "value")


def component_tests(df: DataFrame, key: str, attribute: str, k: int = 10) -> DataFrame:
    """Kolmogorov-Smirnov tests of the first k components between each pair of groups of an attribute, adjusted over all of them.

    (pair_a, pair_b, component, n_a, n_b, d, p, p_holm, p_bonferroni). Groups are few (see MOST_CLASSES); a component's
    rows are laid out once for each pair that their group is in.
    """
    rows = df.filter(F.col(attribute).isNotNull()).withColumn("_y", F.col(attribute).cast("string"))
    names = [r[0] for r in rows.select("_y").distinct().orderBy("_y").limit(MOST_CLASSES + 1).collect()]
    if len(names) > MOST_CLASSES:
        raise ValueError(f"{attribute} has more than {MOST_CLASSES} values")
    long = cut(components(rows, key, k, ["_y"]), "components")
    others = F.filter(F.array(*[F.lit(n) for n in names]), lambda o: o != F.col("_y"))
    pairs = long.withColumn("_o", F.explode(others)).select(F.least("_y", "_o").alias("pair_a"), F.greatest("_y", "_o").alias("pair_b"), "component", F.col("_y").alias("grp"), "value")
    tests = cut(ks_two_sample(pairs, ["pair_a", "pair_b", "component"]), "tests")
    tests = holm(tests, [])
    return tests.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * F.count(F.lit(1)).over(Window.partitionBy())))  # a row a test


def corrected_interval(scores: list[float], level: float = 0.95) -> tuple[float, float, float]:
    """Mean of k fold scores, and half widths of its interval: corrected for overlapping training sets, and naive."""
    k = len(scores)
    if k < 2:
        return float(np.mean(scores)) if k else math.nan, math.nan, math.nan
    var, t = float(np.var(scores, ddof=1)), t_ppf(0.5 + level / 2, k - 1)
    return float(np.mean(scores)), t * math.sqrt((1 / k + 1 / (k - 1)) * var), t * math.sqrt(var / k)


class BalancedAccuracy(Evaluator):
    """Mean recall over the classes that ``label`` has, for cross-validation."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return balanced_accuracy(dataset.withColumn("_k", F.lit(0)), ["_k"], "label", "prediction").first()["balanced_accuracy"]

    def isLargerBetter(self) -> bool:
        return True


def _placed(df: DataFrame, key: str, attribute: str, k: int, inner: int, seed: int) -> tuple[DataFrame, list[str]]:
    """Rows of the attribute with ``label``, ``fold`` (stratified) and, for each fold left out, ``inner{fold}`` of the others; and the classes."""
    rows = df.filter(F.col(attribute).isNotNull()).withColumn("_y", F.col(attribute).cast("string"))
    names = [r[0] for r in rows.select("_y").distinct().orderBy("_y").limit(MOST_CLASSES + 1).collect()]
    if len(names) > MOST_CLASSES:
        raise ValueError(f"{attribute} has more than {MOST_CLASSES} values")
    index = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, float(i))])
    placed = folds(rows.withColumn("label", index[F.col("_y")]), "_y", key, k, str(seed))
    if inner > 1:  # within each fold and class, so that any folds together are dealt evenly
        own = placed.select(key, F.concat_ws(":", "fold", "_y").alias("stratum"))
        placed = placed.join(folds(own, "stratum", key, inner, f"{seed}:inner").select(key, F.col("fold").alias("inner")), key)
    return cut(placed.drop("_y"), "placed"), names


def fold_predictions(df: DataFrame, key: str, fit: Callable[[DataFrame, int], Model], n_pcs: int = 50, fold: str = "fold", part: int = VALUES_A_PART) -> DataFrame:
    """Predictions for every row from a model that has not seen its fold: centred and reduced to ``n_pcs`` components in each fold, then ``fit(train, pcs)``.

    The rows (features, ``fold`` and whatever ``fit`` needs) are placed in folds beforehand. Fits are distributed jobs; the
    loop over a handful of folds is the driver's. A partition holds about ``part`` numbers of the features.
    """
    n, size = df.count(), len(df.select("features").first()[0])
    parts = 1 + n * size // part  # every step of a fit is a job over all partitions: as few as the numbers fill
    rows = (df.coalesce(1) if parts == 1 else df.repartition(parts, key)).persist()
    pcs = max(1, min(n_pcs, size, n - 1))
    try:
        out = None
        for (k,) in sorted(tuple(r) for r in rows.select(fold).distinct().collect()):
            train, test = rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k)
            reduce_ = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_c0", withMean=True, withStd=False), PCA(k=pcs, inputCol="_c0", outputCol="_p")]).fit(train)
            got = fit(reduce_.transform(train), pcs).transform(reduce_.transform(test))
            keep = [c for c in got.columns if c not in ("_c0", "_p")]
            got = cut(got.select(*keep), "predicted")
            out = got if out is None else out.unionByName(got)
        return out
    finally:
        rows.unpersist()


def weighted_classes(train: DataFrame) -> DataFrame:
    """Add ``weight``: rows of all classes weigh the same in sum, and 1 on average."""
    per = train.groupBy("label").agg(F.count(F.lit(1)).alias("_c"))
    total, kinds = train.count(), per.count()
    return train.join(F.broadcast(per), "label").withColumn("weight", F.lit(total) / (kinds * F.col("_c"))).drop("_c")  # a row a class


def logistic(costs: tuple[float, ...], classes: int, inner: int, seed: int, chosen: list[float] | None = None) -> Callable[[DataFrame, int], Model]:
    """Class-balanced L2 logistic regression, whose penalty is the one of the best inner score: AUROC of two classes, balanced accuracy of more.

    The score that a probe reports is the score that it is chosen by; ties go to the stronger penalty. Inner folds are stratified.
    """

    def fit(train: DataFrame, pcs: int) -> Model:
        train = weighted_classes(train)
        total = train.count()
        model = LogisticRegression(featuresCol="_p", labelCol="label", weightCol="weight", maxIter=100, standardization=False)
        grid = ParamGridBuilder().addGrid(model.regParam, [1.0 / (c * total) for c in sorted(costs)]).build()
        if len(grid) == 1:
            return model.copy(grid[0]).fit(train)
        measure = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0) if classes == 2 else BalancedAccuracy()
        fitted = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=measure, numFolds=inner, foldCol="inner", seed=seed, parallelism=8).fit(train)
        best = int(np.argmax(fitted.avgMetrics))
        if chosen is not None:
            chosen.append(sorted(costs)[best])
        return fitted.bestModel

    return fit


def perceptron(classes: int, hidden: int = 128, seed: int = 42) -> Callable[[DataFrame, int], Model]:
    """A perceptron with one hidden layer on standardised components; its loss has no class weights."""

    def fit(train: DataFrame, pcs: int) -> Model:
        scale = StandardScaler(inputCol="_p", outputCol="_z", withMean=True, withStd=True)
        net = MultilayerPerceptronClassifier(featuresCol="_z", labelCol="label", layers=[pcs, hidden, classes], maxIter=100, seed=seed)
        return Pipeline(stages=[scale, net]).fit(train)

    return fit


def _scores_by_fold(predicted: DataFrame, classes: int) -> list[float]:
    if classes == 2:
        scored = predicted.withColumn("_s", vector_to_array("probability")[1]).withColumn("_b", F.col("label") == 1.0)
        rows = auroc(scored, ["fold"], "_b", "_s").select("fold", F.col("auroc").alias("score"))
    else:
        rows = balanced_accuracy(predicted, ["fold"], "label", "prediction").select("fold", F.col("balanced_accuracy").alias("score"))
    return [r["score"] for r in sorted(rows.collect(), key=lambda r: r["fold"])]  # a row a fold


def fold_scores(
    df: DataFrame, key: str, attribute: str, n_pcs: int = 50, k: int = 5, costs: tuple[float, ...] = COSTS, inner: int = 3, seed: int = 42,
    hidden: int | None = None, chosen: list[float] | None = None,
) -> list[float]:
    """Score of each of k stratified folds: AUROC for two classes, else balanced accuracy.

    In each fold the vectors are centred and reduced to ``n_pcs`` components, and a class-balanced L2 logistic regression
    picks its penalty by the same score in inner folds (``chosen`` gets it); with ``hidden``, a perceptron with one
    hidden layer of that size takes its place.
    """
    rows, names = _placed(df, key, attribute, k, inner if hidden is None and len(costs) > 1 else 1, seed)
    fit = logistic(costs, len(names), inner, seed, chosen) if hidden is None else perceptron(len(names), hidden, seed)
    part = VALUES_A_PART // max(1, (hidden or 0) // 8)  # a number costs a hidden layer as many multiplications as it has units
    return _scores_by_fold(fold_predictions(rows, key, fit, n_pcs, part=max(1, part)), len(names))


def probe(df: DataFrame, key: str, attributes: list[str], **options) -> DataFrame:
    """(attribute, metric, n, n_classes, mean, ci95, ci95_naive) of each attribute; those with one class are left out."""
    out = []
    for a in attributes:
        some = df.filter(F.col(a).isNotNull())
        n, kinds = some.count(), some.select(a).distinct().count()
        if kinds < 2:
            continue
        mean, ci, naive = corrected_interval(fold_scores(df, key, a, **options))
        out.append((a, "auroc" if kinds == 2 else "balanced_accuracy", n, kinds, mean, ci, naive))
    return df.sparkSession.createDataFrame(out, "attribute string, metric string, n long, n_classes long, mean double, ci95 double, ci95_naive double")


def component_regression(df: DataFrame, key: str, target: str, n_pcs: int = 50, k: int = 5, seed: int = 42) -> DataFrame:
    """(target, n, r2, r2_folds): a number regressed on components by least squares, out of fold.

    r2 is of all predictions together, each from a model that has not seen its row; r2_folds is the mean over folds.
    Rows without the target are left out.
    """
    rows = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).withColumn("label", F.col(target).cast("double"))
    rows = cut(folds(rows.withColumn("every", F.lit("all")), "every", key, k, str(seed)), "placed")  # few partitions read it: folds are dealt before
    fit = lambda train, pcs: LinearRegression(featuresCol="_p", labelCol="label", solver="normal").fit(train)
    out = fold_predictions(rows, key, fit, n_pcs)
    off = F.col("label") - F.col("prediction")
    r2 = lambda: 1 - F.sum(off * off) / (F.var_pop("label") * F.count(F.lit(1)))
    per = out.groupBy("fold").agg(r2().alias("r")).agg(F.avg("r").alias("r2_folds"))
    return out.agg(F.count(F.lit(1)).alias("n"), r2().alias("r2")).crossJoin(F.broadcast(per)).select(F.lit(target).alias("target"), "n", "r2", "r2_folds")  # one row each


def null_delta(probed: DataFrame, null: DataFrame) -> DataFrame:
    """(attribute, mean, null_mean, delta): how far the probe is above the same probe of random features."""
    control = null.select("attribute", F.col("mean").alias("null_mean"))
    return probed.join(control, "attribute").select("attribute", "mean", "null_mean", (F.col("mean") - F.col("null_mean")).alias("delta"))


def leakage(auc):
    """'strong' from .80, 'moderate' from .65, else 'weak'."""
    return F.when(auc >= 0.8, "strong").when(auc >= 0.65, "moderate").otherwise("weak")


def random_projection(df: DataFrame, size: int, out: int, seed: int = 7) -> DataFrame:
    """The null control: features through a fixed random matrix and a rectifier, as an untrained encoder."""
    w = np.random.default_rng(seed).normal(size=(size, out)) / math.sqrt(size)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.maximum(np.stack(x.to_numpy()) @ w, 0.0)))

    return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


#: Encoders by name: what makes an encoder in a task (see ``extract``). ``register_encoder`` adds to them.
ENCODERS: dict[str, Callable[[], Callable[[pd.DataFrame], np.ndarray]]] = {}


def register_encoder(name: str):
    """Decorator: the function makes the encoder ``name``, once a task."""

    def add(load):
        if name in ENCODERS:
            raise ValueError(f"encoder {name} is registered")
        ENCODERS[name] = load
        return load

    return add


def encoder(name: str):
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name}; there are {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name]


@register_encoder("moments")
def _moments():
    """Mean, standard deviation, least and greatest value of the array in the column ``values``."""

    def encode(item: pd.DataFrame) -> np.ndarray:
        x = np.asarray(item["values"].iloc[0], float)
        if x.ndim != 1 or not len(x) or not np.isfinite(x).all():
            raise ValueError("not an array of numbers")
        return np.array([x.mean(), x.std(), x.min(), x.max()])

    return encode


def extract(items: DataFrame, key: str, load: str | Callable[[], Callable[[pd.DataFrame], np.ndarray]]) -> DataFrame:
    """(key, embedding, status): ``load`` (or the encoder registered under that name) makes the encoder once a task; an item that fails is reported, the others go on."""
    load = encoder(load) if isinstance(load, str) else load
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for b in batches:
            rows = []
            for i in range(len(b)):
                one = b.iloc[i : i + 1]
                try:
                    rows.append((one[key].iloc[0], [float(v) for v in np.asarray(encode(one)).ravel()], "ok"))
                except Exception as e:  # noqa: BLE001  any encoder error is the item's
                    rows.append((one[key].iloc[0], None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[key, "embedding", "status"])

    return items.mapInPandas(run, f"{key} {kind}, embedding array<double>, status string")


def silhouettes(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(attribute, n, n_groups, silhouette): how well the groups of each attribute are set apart, by squared distances.

    A group is its count, vector sum and squared norms: the mean squared distance of a row to a group's rows follows from
    these, so a row meets groups and never other rows. A row alone in its group counts 0; an attribute with one group has
    no silhouette.
    """
    rows = df.select(key, vector_to_array("features").alias("_v"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("grp")) for a in attributes])).alias("_a"))
    rows = rows.select(key, "_v", "_a.*").filter("grp IS NOT NULL")
    sq = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)
    groups = rows.groupBy("attribute", "grp").agg(Summarizer.sum(array_to_vector("_v")).alias("_s"), F.sum(sq).alias("_q"), F.count(F.lit(1)).alias("_n"))
    groups = cut(groups.withColumn("_s", vector_to_array("_s")), "groups")  # a row a group
    met = rows.withColumn("_own", F.col("grp")).drop("grp").join(groups, "attribute")
    dot = F.aggregate(F.zip_with("_v", "_s", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    total = F.col("_n") * sq - 2 * dot + F.col("_q")  # of squared distances to the group's rows
    own = F.col("_own") == F.col("grp")
    others = F.when(own, F.col("_n") - 1).otherwise(F.col("_n"))
    met = met.select("attribute", key, own.alias("own"), "_n", F.try_divide(total, others).alias("d"))
    per = met.groupBy("attribute", key).agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"), F.max(F.when(F.col("own"), F.col("_n"))).alias("n"), F.count(F.lit(1)).alias("k"))
    s = F.when(F.col("k") > 1, F.when((F.col("n") == 1) | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
    return per.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("n_groups"), F.avg(s).alias("silhouette"))


def cluster_agreement(df: DataFrame, attribute: str, k: int, seed: int = 1) -> DataFrame:
    """k-means clusters against an attribute: adjusted Rand index and normalised mutual information from the contingency table."""
    placed = KMeans(k=k, seed=seed, featuresCol="features").fit(df).transform(df)
    cells = placed.groupBy("prediction", attribute).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = cells.groupBy("prediction").agg(F.sum("n").alias("a"))
    c = cells.groupBy(attribute).agg(F.sum("n").alias("b"))
    pairs = lambda v: F.col(v) * (F.col(v) - 1) / 2
    total = cells.agg(F.sum("n").alias("t"), F.sum(pairs("n")).alias("sn")).crossJoin(r.agg(F.sum(pairs("a")).alias("sa"))).crossJoin(c.agg(F.sum(pairs("b")).alias("sb")))
    x = cells.join(r, "prediction").join(c, attribute).crossJoin(total.select("t"))
    p = F.col("n") / F.col("t")
    mi = x.agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    h = lambda d, v: d.crossJoin(total.select("t")).agg((-F.sum(F.col(v) / F.col("t") * F.log(F.col(v) / F.col("t")))).alias(f"h_{v}"))
    expected = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    ari = (F.col("sn") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)
    return total.crossJoin(mi).crossJoin(h(r, "a")).crossJoin(h(c, "b")).select(ari.alias("ari"), (2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))).alias("nmi"))
