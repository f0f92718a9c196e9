"""Classification, validation and fractional cover."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import options
from ..functions import stats
from ..functions.expr import all_present, band, clamp, div, first_largest, first_smallest, lit, total
from ..grid import GridSpec, sample_random, seeded
from . import match, vector

# unsupervised ---------------------------------------------------------------


def centre_distance(b: list[Column], centre: list[float]) -> Column:
    return F.sqrt(total([(x - lit(c)) * (x - lit(c)) for x, c in zip(b, centre)]))


def assign(img: DataFrame, centres: list[list[float]], bands: list[str], keys: list[str] = ("row", "col"), output: str = "classes") -> DataFrame:
    """keys and the 1-based nearest centre as ``class`` (the first of equals), or
    the distances dist_c1 ..; NULL where a band is."""
    b = [band(x) for x in bands]
    d = [centre_distance(b, c) for c in centres]
    if output == "distances":
        return img.select(*keys, *[x.alias(f"dist_c{i + 1}") for i, x in enumerate(d)])
    return img.select(*keys, *[x.alias(f"_d{i}") for i, x in enumerate(d)]).select(*keys, first_smallest([F.col(f"_d{i}") for i in range(len(d))]).alias("class"))


@dataclass(frozen=True)
class Clusters:
    """Centres in the order of their norms, their sizes, and the costs."""

    bands: tuple[str, ...]
    centres: list[list[float]]
    sizes: list[int]
    withinss: list[float]
    cost: float

    def predict(self, img: DataFrame, keys: list[str] = ("row", "col"), output: str = "classes") -> DataFrame:
        return assign(img, self.centres, list(self.bands), keys, output)

    def summary(self) -> str:
        lines = [f"{len(self.centres)} classes, cost {self.cost:.6g}"]
        return "\n".join(lines + [f"  {i + 1}: size {n}, within {w:.6g}, centre {[round(x, 6) for x in c]}" for i, (c, n, w) in enumerate(zip(self.centres, self.sizes, self.withinss))])


def unsupervised(img: DataFrame, bands: list[str], n_classes: int = 5, n_starts: int = 25, n_iter: int = 100, n_samples: int | None = None, norm: bool = False, keys: list[str] = ("row", "col"), seed: int = 1) -> tuple[Clusters, DataFrame]:
    """k-means, the cheapest of ``n_starts`` seeds, and the map. All pixels that
    have all bands are used unless ``n_samples`` bounds them."""
    if norm:
        img = match.normalise(img, bands, list(keys))
    full = img.select(*keys, *[band(b).alias(b) for b in bands]).na.drop(subset=list(bands))
    if n_samples:
        full = sample_random(full, n_samples, [], seed, keys[0])
    data = VectorAssembler(inputCols=list(bands), outputCol="features").transform(full).select("features", *bands).persist()
    try:
        best = None
        for s in range(n_starts):
            m = KMeans(k=n_classes, maxIter=n_iter, seed=seed + s).fit(data)
            if best is None or m.summary.trainingCost < best.summary.trainingCost:
                best = m
        centres = sorted(([float(x) for x in c] for c in best.clusterCenters()), key=lambda c: (sum(x * x for x in c), c))
        d = [centre_distance([band(b) for b in bands], c) for c in centres]
        at = data.select(first_smallest(d).alias("k"), F.array_min(F.array(*d)).alias("d"))
        rows = {r["k"]: r for r in at.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d") * F.col("d")).alias("w")).collect()}
    finally:
        data.unpersist()
    get = lambda i, c: rows[i + 1][c] if i + 1 in rows else 0
    model = Clusters(tuple(bands), centres, [get(i, "n") for i in range(len(centres))], [float(get(i, "w")) for i in range(len(centres))], best.summary.trainingCost)
    return model, model.predict(img, keys)


# maximum likelihood ---------------------------------------------------------


@dataclass(frozen=True)
class MLC:
    """Means, inverse covariances and -log determinants of the classes."""

    bands: tuple[str, ...]
    classes: tuple[str, ...]
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]

    def scores(self) -> list[Column]:
        """Each class's discriminant: constant - (x - m)' I (x - m)."""
        out = []
        for m, inv, d in zip(self.means, self.inverses, self.constants):
            z = [band(b) - lit(x) for b, x in zip(self.bands, m)]
            form = total([z[i] * z[j] * lit(inv[i, j] * (1 if i == j else 2)) for i in range(len(z)) for j in range(i, len(z))])
            out.append(lit(d) - form)
        return out

    def predict(self, img: DataFrame, keys: list[str] = ("row", "col"), output: str = "raw") -> DataFrame:
        """keys and class (1-based), or the scores, or ``prob``: their softmax."""
        names = [f"score_{c}" for c in self.classes]
        df = img.select(*keys, *[s.alias(n) for s, n in zip(self.scores(), names)])
        if output == "score":
            return df
        if output == "prob":
            top = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
            e = [F.exp((F.col(n) - top) / lit(2)) for n in names]
            return df.select(*keys, *[div(x, total(e)).alias(f"prob_{c}") for x, c in zip(e, self.classes)])
        return df.select(*keys, first_largest([F.col(n) for n in names]).alias("class"))


def mlc_fit(samples: DataFrame, bands: list[str], response: str = "response") -> MLC:
    """Means and covariances of all classes in one aggregation. A covariance that
    is singular gets a small ridge, with a warning."""
    b = [band(x) for x in bands]
    rows = samples.na.drop(subset=[*bands, response]).groupBy(response).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(b)], *stats.covariance_columns(b)).orderBy(response).collect()
    if not rows:
        raise ValueError("there are no samples")
    k, means, inv, const = len(bands), [], [], []
    for r in rows:
        s = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
        if np.linalg.matrix_rank(s) < k:
            warnings.warn(f"the covariance of {r[response]} is singular", stacklevel=2)
            s = s + np.eye(k) * max(1e-10, 1e-8 * np.trace(s) / k)
        chol = np.linalg.cholesky(s)
        inv.append(np.linalg.inv(s))
        const.append(-2 * float(np.log(np.diag(chol)).sum()))
        means.append(np.array([r[f"m_{i}"] for i in range(k)]))
    return MLC(tuple(bands), tuple(str(r[response]) for r in rows), means, inv, const)


# supervised -----------------------------------------------------------------

CLASSIFIERS = {
    "rf": (lambda **a: RandomForestClassifier(**a), "maxDepth", [5, 8, 11, 14]),
    "dt": (lambda **a: DecisionTreeClassifier(**a), "maxDepth", [3, 5, 8, 11]),
    "gbt": (lambda **a: OneVsRest(classifier=GBTClassifier(), **{k: v for k, v in a.items() if k != "seed"}), None, []),
    "svm": (lambda **a: OneVsRest(classifier=LinearSVC(), **{k: v for k, v in a.items() if k != "seed"}), None, []),
    "logistic": (lambda **a: LogisticRegression(**{k: v for k, v in a.items() if k != "seed"}), "regParam", [0.0, 0.01, 0.1, 1.0]),
    "mlp": (lambda **a: MultilayerPerceptronClassifier(**a), "maxIter", [50, 100, 200]),
    "nb": (lambda **a: NaiveBayes(modelType="gaussian", **{k: v for k, v in a.items() if k != "seed"}), None, []),
}
REGRESSORS = {
    "rf": (lambda **a: RandomForestRegressor(**a), "maxDepth", [5, 8, 11, 14]),
    "dt": (lambda **a: DecisionTreeRegressor(**a), "maxDepth", [3, 5, 8, 11]),
    "gbt": (lambda **a: GBTRegressor(**a), "maxIter", [10, 20, 40]),
    "lm": (lambda **a: LinearRegression(**{k: v for k, v in a.items() if k != "seed"}), "regParam", [0.0, 0.01, 0.1]),
}


def register_model(name: str, make, parameter: str | None = None, values: list = (), regression: bool = False) -> None:
    """Add a Spark ML estimator (make(featuresCol, labelCol, seed)) to the registry."""
    (REGRESSORS if regression else CLASSIFIERS)[name] = (make, parameter, list(values))


@dataclass
class Supervised:
    """A fitted model with its classes, its cross validation and its map's validation."""

    bands: tuple[str, ...]
    mode: str
    classes: tuple[str, ...]
    model: object
    cv: list[dict] = field(default_factory=list)
    validation: "Validation | None" = None

    def predict(self, img: DataFrame, keys: list[str] = ("row", "col"), pred_type: str = "raw") -> DataFrame:
        """keys and class (1-based number), class probabilities, or the predicted value."""
        keys = list(keys)
        if isinstance(self.model, MLC):
            return self.model.predict(img, keys, pred_type)
        full = img.select(*keys, *[band(b).alias(b) for b in self.bands])
        ok = full.na.drop(subset=list(self.bands))
        out = self.model.transform(VectorAssembler(inputCols=list(self.bands), outputCol="features").transform(ok))
        if self.mode == "regression":
            got, names = out.select(*keys, F.col("prediction").alias("value")), ["value"]
        elif pred_type == "prob":
            if "probability" not in out.columns:
                raise ValueError("this model gives no probabilities")
            p = vector_to_array("probability")
            names = [f"prob_{c}" for c in self.classes]
            got = out.select(*keys, *[p[i].alias(n) for i, n in enumerate(names)])
        else:
            got, names = out.select(*keys, (F.col("prediction") + 1).cast("int").alias("class")), ["class"]
        return full.where(~all_present([F.col(b) for b in self.bands])).select(*keys, *[F.lit(None).cast(got.schema[n].dataType).alias(n) for n in names]).unionByName(got)

    def scores(self, spark, source: str = "testset", metrics: str = "overall") -> DataFrame:
        """The validation's metrics (see ``Validation.frame``), or with source "cv" a
        row for each setting that was tried and its mean score."""
        if source == "testset":
            if self.validation is None:
                raise ValueError("the model was not validated")
            return self.validation.frame(spark, metrics)
        if source != "cv":
            raise ValueError("source is testset or cv")
        if not self.cv:
            raise ValueError("the model was not cross-validated")
        metric = next(k for k in self.cv[0] if k != "parameters")
        return spark.createDataFrame([(str(r["parameters"]), float(r[metric])) for r in self.cv], f"parameters string, `{metric}` double")

    def summary(self) -> str:
        """A report of the model, its cross validation and its validation."""
        lines = [f"{self.mode} by {type(self.model).__name__} over {', '.join(self.bands)}"]
        if self.classes:
            lines.append("classes: " + ", ".join(f"{i + 1} {c}" for i, c in enumerate(self.classes)))
        lines += [f"cross validation: {r}" for r in self.cv]
        return "\n".join(lines + ([self.validation.summary()] if self.validation else []))

    def mapping(self, spark) -> DataFrame:
        """(classID, class)"""
        return spark.createDataFrame([(i + 1, c) for i, c in enumerate(self.classes)], "classID int, class string")


def stratified_split(df: DataFrame, share: float, by: str = "response", unit: str | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(training, rest): of each class the first ceil(share * n) by a seeded hash, of
    pixels or of whole units (features)."""
    key = [unit] if unit else ["row", "col"]
    units = df.select(by, *key).distinct() if unit else df.select(by, *key)
    w = Window.partitionBy(by)
    ranked = units.withColumn("_r", F.row_number().over(w.orderBy(seeded(seed, *key), *key))).withColumn("_n", F.count(F.lit(1)).over(w))
    train = ranked.where(F.col("_r") <= F.ceil(F.col("_n") * share)).select(by, *key)
    if share < 1 and ranked.where(F.col("_r") > F.ceil(F.col("_n") * share)).select(by).distinct().count() < units.select(by).distinct().count():
        raise ValueError("some class would have no validation sample")
    return df.join(train, [by, *key], "left_semi"), df.join(train, [by, *key], "left_anti")


def folds(df: DataFrame, k: int, unit: str | None = None, by: str = "response", seed: int = 1) -> DataFrame:
    """Adds ``fold`` 0 .. k-1, balanced within each class; with ``unit`` the pixels
    of one feature share a fold."""
    key = [unit] if unit else ["row", "col"]
    units = df.select(by, *key).distinct()
    w = Window.partitionBy(by).orderBy(seeded(seed, *key), *key)
    return df.join(units.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int")), [by, *key])


#: Points of a cell of ``nearest``, about, and sampled points that a cell is made from.
_CELL, _TRACE = 2000, 16


def _split(points: np.ndarray, first: int = 0) -> tuple:
    """(k-d tree, next cell) of sampled points: a tree is a cell's number, or (band,
    value, tree of the values up to it, tree of the others)."""
    spread = np.ptp(points, axis=0) if len(points) >= 2 * _TRACE else np.zeros(1)
    j = int(np.argmax(spread))
    if spread[j] <= 0:
        return first, first + 1
    v = np.sort(points[:, j])
    cut = v[(len(v) - 1) // 2]
    cut = cut if cut < v[-1] else v[v < cut][-1]
    low, middle = _split(points[points[:, j] <= cut], first)
    high, last = _split(points[points[:, j] > cut], middle)
    return (j, float(cut), low, high), last


def _cells(tree, x: np.ndarray, reach: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(cell, rows of x) of the cells within each point's reach."""
    if not len(at):
        return []
    if isinstance(tree, int):
        return [(tree, at)]
    j, cut, low, high = tree
    return _cells(low, x, reach, at[x[at, j] - reach[at] <= cut]) + _cells(high, x, reach, at[x[at, j] + reach[at] > cut])


def nearest(df: DataFrame, bands: list[str], by: str = "response") -> DataFrame:
    """(by, bands, ``_next``): for each distinct point of a class (values of the bands)
    the nearest other pixel's point, as a struct v0 .. of the bands; of equally near
    ones that of the first (row, col). Pixels that lack a band are none of them.

    Points of several pixels are their own nearest. The others are compared with
    the points of their cell of a k-d tree, then with those of the cells that are
    nearer than what was found, so that none is missed. The tree comes from a
    sample of points, which decides on the cells' sizes only."""
    nb = len(bands)
    v = [f"v{i}" for i in range(nb)]
    full = all_present([F.col(b) for b in bands]) & F.col(by).isNotNull()
    for b in bands:
        full = full & (F.abs(band(b)) < lit(math.inf))
    px = df.where(full).groupBy(F.col(by).alias("k"), *[(band(b) + lit(0)).alias(n) for b, n in zip(bands, v)])
    points = px.agg(F.min(F.struct("row", "col")).alias("f"), F.max(F.struct("row", "col")).alias("l"))
    points = points.select("k", *v, F.col("f.row").cast("long").alias("r"), F.col("f.col").cast("long").alias("c"), (F.col("f") == F.col("l")).alias("alone"))
    sampled = F.when(F.abs(F.xxhash64(*v)) % (_CELL // _TRACE) == 0, F.array(*v))
    trees, cells = {}, 0
    for k, sample in points.groupBy("k").agg(F.collect_list(sampled)).orderBy("k").collect():
        trees[k], cells = _split(np.array(sorted(map(tuple, sample)), float).reshape(-1, nb), cells)
    kind = points.schema["k"].dataType.simpleString()
    columns = ["k", *v, "r", "c", "alone"]

    def spread(frames, reach=None):
        """The rows with their cell, or with each cell within reach but theirs."""
        for p in frames:
            x = p[v].to_numpy(float)
            d = p[reach].to_numpy(float) if reach else np.zeros(len(p))
            for k, rows in p.groupby("k").indices.items():
                for cell, at in _cells(trees[k], x, d, np.asarray(rows)):
                    part = p.iloc[at].assign(to=np.int64(cell))
                    yield part[part["cell"] != cell].drop(columns="cell") if reach else part

    def search(cell, of, own: bool):
        """(x, d2, r, c, n): of each point that is searched for, the nearest in the cell."""
        cell = cell.sort_values(["r", "c"])
        x = cell[v].to_numpy(float)
        of = cell[cell["alone"]] if own else of
        q, places = of[v].to_numpy(float), np.flatnonzero(cell["alone"]) if own else None
        best, least = np.zeros(len(q), int), np.full(len(q), np.inf)
        step = max(1, 2_000_000 // max(1, len(x)))
        for s in range(0, len(q) if len(x) else 0, step):
            d = sum((q[s : s + step, i, None] - x[:, i]) ** 2 for i in range(nb))
            if own:
                d[np.arange(len(d)), places[s : s + step]] = np.inf
            best[s : s + step] = np.argmin(d, axis=1)
            least[s : s + step] = d[np.arange(len(d)), best[s : s + step]]
        found = np.isfinite(least)
        out = of[["k", *v]].copy()
        out["d2"] = least
        for n in ("r", "c"):
            out[f"{n}2"] = np.where(found, cell[n].to_numpy()[best] if len(x) else 0, 0)
        for i, n in enumerate(v):
            out[f"n{i}"] = np.where(found, x[best, i] if len(x) else 0.0, 0.0)
        return out

    doubles = ", ".join(f"{n} double" for n in v)
    point = f"k {kind}, {doubles}, r long, c long, alone boolean"
    hit = f"k {kind}, {doubles}, d2 double, r2 long, c2 long, " + ", ".join(f"n{i} double" for i in range(nb))
    at_home = points.mapInPandas(lambda frames: spread(frames), f"{point}, to long")
    home = at_home.groupBy("to").applyInPandas(lambda key, p: search(p[columns], None, True).assign(cell=key[0]), f"{hit}, cell long")
    # sqrt and the squares are rounded: reach a little farther
    visits = home.select("k", *v, "cell", (F.sqrt("d2") * lit(1 + 1e-9)).alias("reach")).mapInPandas(lambda frames: spread(frames, "reach"), f"k {kind}, {doubles}, reach double, to long")
    away = at_home.groupBy("to").cogroup(visits.groupBy("to")).applyInPandas(lambda p, q: search(p[columns], q, False), hit)
    hits = home.drop("cell").unionByName(away).where(F.col("d2") < lit(math.inf))
    hits = hits.groupBy("k", *v).agg(F.min_by(F.struct(*[F.col(f"n{i}").alias(n) for i, n in enumerate(v)]), F.struct("d2", "r2", "c2")).alias("_next"))
    several = points.where("NOT alone").select("k", *v, F.struct(*v).alias("_next"))
    return hits.unionByName(several).select(F.col("k").alias(by), *[F.col(n).alias(b) for b, n in zip(bands, v)], "_next")


def balance(df: DataFrame, how: str, by: str = "response", bands: list[str] = (), seed: int = 1) -> DataFrame:
    """Classes of equal size: ``down`` to the smallest, ``up`` by repetition to the
    largest, ``smote`` by points between a pixel and its nearest neighbour in
    the class (see ``nearest``), ``rose`` by repetition with noise of a quarter deviation."""
    if how not in ("up", "down", "smote", "rose"):
        raise ValueError("sampling is one of up, down, smote, rose")
    w = Window.partitionBy(by)
    df = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(seeded(seed, "row", "col"), "row", "col")))
    most, least = df.agg(F.max("_n"), F.min("_n")).first()
    if how == "down":
        return df.where(F.col("_r") <= least).drop("_n", "_r")
    copies = F.floor((F.lit(most) - F.col("_r")) / F.col("_n")) + 1  # of the r-th of n, so that all add up to the largest
    if how == "smote":
        df = df.join(nearest(df, bands, by), [by, *bands], "left").withColumns({f"_next_{b}": F.coalesce(F.col(f"_next.v{i}"), F.col(b)) for i, b in enumerate(bands)}).drop("_next")
    for b in bands if how == "rose" else ():
        df = df.withColumn(f"_sd_{b}", F.coalesce(F.stddev_samp(b).over(w), lit(0)))
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    for i, b in enumerate(bands):
        if how == "smote":
            u = F.abs(F.xxhash64(F.lit(seed), "row", "col", "_k") % 1000) / lit(1000)
            df = df.withColumn(b, F.when(F.col("_k") == 0, F.col(b)).otherwise(F.col(b) + (F.col(f"_next_{b}") - F.col(b)) * u)).drop(f"_next_{b}")
        elif how == "rose":
            u = (F.xxhash64(F.lit(seed + i), "row", "col", "_k") % 1000) / lit(1000)
            df = df.withColumn(b, F.when(F.col("_k") == 0, F.col(b)).otherwise(F.col(b) + u * F.col(f"_sd_{b}") * 0.25)).drop(f"_sd_{b}")
    return df.drop("_n", "_r", "_k")


def fit(samples: DataFrame, bands: list[str], model: str = "rf", mode: str = "classification", tune_length: int = 3, k_folds: int = 5, polygon_cv: bool = False, sampling: str | None = None, seed: int = 1, **args) -> Supervised:
    """Tune a model by cross validation on samples (row, col, feature, response,
    bands) and fit it. Constant bands are dropped with a warning; a constant
    response is an error. Without tuning values, or with tune_length 1, the
    model is only cross-validated."""
    values = samples.agg(*[F.count_distinct(b).alias(b) for b in bands], F.count_distinct("response").alias("_response")).first()
    if values["_response"] < 2:
        raise ValueError("the response is constant")
    constant = [b for b in bands if values[b] < 2]
    if constant:
        warnings.warn(f"constant bands are dropped: {constant}", stacklevel=2)
    bands = [b for b in bands if b not in constant]
    if not bands:
        raise ValueError("all bands are constant")
    if sampling and mode == "classification":
        samples = balance(samples, sampling, bands=bands, seed=seed)
    if mode == "classification":
        classes = tuple(r[0] for r in samples.select("response").distinct().orderBy("response").collect())
        code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("response")).cast("double") - 1
    else:
        classes, code = (), F.col("response").cast("double")
    if model == "mlc":
        if mode != "classification":
            raise ValueError("mlc classifies only")
        return Supervised(tuple(bands), mode, classes, mlc_fit(samples, bands))
    registry = CLASSIFIERS if mode == "classification" else REGRESSORS
    if model not in registry:
        raise ValueError(f"model is one of {sorted(registry) + ['mlc'] * (mode == 'classification')}")
    make, parameter, grid_values = registry[model]
    if model == "mlp":
        args.setdefault("layers", [len(bands), 2 * len(bands) + 2, len(classes)])
    est = make(featuresCol="features", labelCol="label", seed=seed, **args)
    data = VectorAssembler(inputCols=bands, outputCol="features").transform(folds(samples, k_folds, "feature" if polygon_cv else None, seed=seed).withColumn("label", code)).select("features", "label", "fold").persist()
    try:
        tuned = list(grid_values)[:tune_length] if parameter and parameter not in args else []
        g = ParamGridBuilder()
        if tuned and tune_length > 1:
            g = g.addGrid(est.getParam(parameter), tuned)
        ev = MulticlassClassificationEvaluator(metricName="accuracy") if mode == "classification" else RegressionEvaluator(metricName="rmse")
        cv = CrossValidator(estimator=est, estimatorParamMaps=g.build(), evaluator=ev, numFolds=k_folds, foldCol="fold", parallelism=4).fit(data)
    finally:
        data.unpersist()
    options.say(f"tuned {model} over {len(g.build())} settings: {cv.avgMetrics}")
    scores = [{"parameters": {p.name: v for p, v in m.items()}, ev.getMetricName(): s} for m, s in zip(g.build(), cv.avgMetrics)]
    return Supervised(tuple(bands), mode, classes, cv.bestModel, scores)


def supervised(
    img: DataFrame, train: list[dict], response: str, bands: list[str], grid: GridSpec, val: list[dict] | None = None, n_samples: int = 1000, n_samples_val: int = 1000, train_partition: float | None = None,
    model: str = "rf", mode: str | None = None, tune_length: int = 3, k_folds: int = 5, polygon_cv: bool = False, sampling: str | None = None, min_dist: float = 2.0, predict: bool = True, pred_type: str = "raw", keys: list[str] = ("row", "col"), seed: int = 1, **args,
) -> tuple[Supervised, DataFrame | None]:
    """(model, map) from features (dicts with ``wkt`` and the response).

    Validation takes ``val``'s features, or what ``train_partition`` leaves of the
    training features; pixels within ``min_dist`` of a training pixel are not
    used for it."""
    train = [f for f in vector.select_intersecting(train, grid.extent) if f.get(response) is not None]
    if not train:
        raise ValueError("no training feature has a response")
    numeric = all(isinstance(f[response], float) for f in train)
    mode = mode or ("regression" if numeric else "classification")
    own = vector.sample_pixels(img, train, response, bands, grid, n_samples, seed)
    rest = None
    if train_partition is not None:
        unit = "feature" if vector.parse_wkt(train[0]["wkt"])[0] == "POLYGON" else None
        own, rest = stratified_split(own, train_partition, unit=unit, seed=seed)
    if val is not None:
        rest = vector.sample_pixels(img, vector.select_intersecting(val, grid.extent), response, bands, grid, n_samples_val, seed, exclude=own)
    own = own.persist()
    try:
        out = fit(own, bands, model, mode, tune_length, k_folds, polygon_cv, sampling, seed, **args)
        if rest is not None:
            far = vector.away_from(rest, own, min_dist)
            out.validation = validate(out.predict(img, ["row", "col"]), far, out.classes, mode)
    finally:
        own.unpersist()
    return out, out.predict(img, list(keys), pred_type) if predict else None


# validation -----------------------------------------------------------------


def _betai(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betai(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def _quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _betai(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class Validation:
    """A confusion matrix (rows: prediction, columns: reference) or errors."""

    classes: tuple[str, ...] = ()
    matrix: np.ndarray | None = None
    errors: dict[str, float] = field(default_factory=dict)

    def overall(self) -> dict[str, float]:
        """Accuracy with its 95 % interval, kappa, the no-information rate, and the
        probability of so many hits at that rate."""
        m, n = self.matrix.astype(float), float(self.matrix.sum())
        hits, share = float(np.trace(m)), m.sum(0) / n
        acc, chance, nir = hits / n, float((m.sum(0) * m.sum(1)).sum()) / n**2, float(share.max())
        low = 0.0 if hits == 0 else _quantile(0.025, hits, n - hits + 1)
        high = 1.0 if hits == n else _quantile(0.975, hits + 1, n - hits)
        p = 1.0 if hits == 0 else _betai(nir, hits, n - hits + 1)
        return {"accuracy": acc, "kappa": (acc - chance) / (1 - chance) if chance < 1 else float("nan"), "lower": low, "upper": high, "null": nir, "p_value": p}

    def by_class(self) -> list[dict[str, float]]:
        m, n = self.matrix.astype(float), float(self.matrix.sum())
        out = []
        for i, c in enumerate(self.classes):
            tp, fp, fn = m[i, i], m[i].sum() - m[i, i], m[:, i].sum() - m[i, i]
            tn = n - tp - fp - fn
            r = lambda a, b: a / b if b else float("nan")
            sens, spec = r(tp, tp + fn), r(tn, tn + fp)
            out.append({"class": c, "sensitivity": sens, "specificity": spec, "ppv": r(tp, tp + fp), "npv": r(tn, tn + fn), "prevalence": r(tp + fn, n), "balanced_accuracy": (sens + spec) / 2})
        return out

    def summary(self) -> str:
        """The matrix and the overall metrics, or the errors."""
        if self.matrix is None:
            return ", ".join(f"{k} {v:.6g}" for k, v in self.errors.items())
        rows = [f"  {c}: {' '.join(map(str, r))}" for c, r in zip(self.classes, self.matrix.tolist())]
        return "\n".join(["prediction by reference:", *rows, ", ".join(f"{k} {v:.4f}" for k, v in self.overall().items())])

    def frame(self, spark, metrics: str = "overall") -> DataFrame:
        """overall, classwise or confmat as a DataFrame; the errors of a regression."""
        if self.matrix is None:
            return spark.createDataFrame([tuple(self.errors.values())], ", ".join(f"{k} double" for k in self.errors))
        if metrics == "overall":
            o = self.overall()
            return spark.createDataFrame([tuple(map(float, o.values()))], ", ".join(f"{k} double" for k in o))
        if metrics == "classwise":
            rows = self.by_class()
            return spark.createDataFrame([(r["class"], *[float(v) for k, v in r.items() if k != "class"]) for r in rows], "class string, " + ", ".join(f"{k} double" for k in rows[0] if k != "class"))
        if metrics == "confmat":
            return spark.createDataFrame([(p, r, int(self.matrix[i, j])) for i, p in enumerate(self.classes) for j, r in enumerate(self.classes)], "prediction string, reference string, n long")
        raise ValueError("metrics is one of overall, classwise, confmat")


def confusion(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(reference, prediction, n) of the rows that have both."""
    return df.where(F.col(prediction).isNotNull() & F.col(reference).isNotNull()).groupBy(F.col(reference).alias("reference"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def errors(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """One row: rmse, r2 (squared correlation) and mae."""
    p, o = band(prediction), band(reference)
    r = F.corr(p, o)
    return df.where(p.isNotNull() & o.isNotNull()).agg(stats.rmse(p, o).alias("rmse"), (r * r).alias("r2"), F.avg(F.abs(p - o)).alias("mae"))


def validate(map_: DataFrame, samples: DataFrame, classes: tuple[str, ...], mode: str = "classification", layer: str | None = None) -> Validation:
    """The map (row, col, class or value) against samples (row, col, response)."""
    layer = layer or ("class" if mode == "classification" else "value")
    both = map_.select("row", "col", F.col(layer).alias("_m")).join(samples.select("row", "col", "response"), ["row", "col"])
    if mode == "regression":
        r = errors(both.select(F.col("_m").alias("prediction"), F.col("response").cast("double").alias("reference"))).first()
        return Validation(errors={k: r[k] for k in ("rmse", "r2", "mae")})
    ref = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("response")).cast("int")
    m = np.zeros((len(classes), len(classes)), int)
    for r in confusion(both.select(F.col("_m").alias("prediction"), F.when(ref > 0, ref).alias("reference"))).collect():
        m[r["prediction"] - 1, r["reference"] - 1] += r["n"]
    if not m.sum():
        raise ValueError("no validation sample lies on a classified pixel")
    return Validation(tuple(classes), m)


def validate_map(map_: DataFrame, features: list[dict], response: str, grid: GridSpec, classes: tuple[str, ...] = (), mode: str = "classification", n_samples: int = 500, layer: str | None = None, seed: int = 1) -> Validation:
    """A map against features: pixels are sampled under them."""
    layer = layer or ("class" if mode == "classification" else "value")
    px = vector.sample_pixels(map_, vector.select_intersecting(features, grid.extent), response, [layer], grid, n_samples, seed)
    classes = classes or tuple(sorted({str(f[response]) for f in features}))
    return validate(map_, px.select("row", "col", "response"), classes, mode, layer)


# fractional cover -----------------------------------------------------------


def class_shares(fine: DataFrame, grid: GridSpec, classes: list[int], max_na: float = 0.0, layer: str = "class") -> DataFrame:
    """row, col of the coarse grid and fC_<class>: the class's share of the valid
    fine pixels whose centres lie in it; blocks with more than ``max_na`` of
    missing pixels are left out."""
    at = fine.select(grid.row_of(F.col("y")).alias("row"), grid.col_of(F.col("x")).alias("col"), F.col(layer).alias("k"))
    at = at.where((F.col("row") >= 0) & (F.col("row") < grid.nrow) & (F.col("col") >= 0) & (F.col("col") < grid.ncol))
    valid = F.count("k")
    shares = [div(F.sum((F.col("k") == k).cast("double")), valid.cast("double")).alias(f"fC_{k}") for k in classes]
    got = at.groupBy("row", "col").agg(F.count(F.lit(1)).alias("_all"), valid.alias("_ok"), *shares)
    return got.where((F.col("_ok") > 0) & (lit(1) - F.col("_ok") / F.col("_all") <= lit(max_na))).drop("_all", "_ok")


def fractional_cover(fine: DataFrame, coarse: DataFrame, bands: list[str], grid: GridSpec, classes: list[int], n_samples: int = 1000, max_na: float = 0.0, clamped: bool = True, model: str = "rf", tune_length: int = 3, k_folds: int = 5, keys: list[str] = ("row", "col"), layer: str = "class", seed: int = 1, **args) -> tuple[dict[int, Supervised], DataFrame]:
    """(models, map): a regression of each class's share on the coarse bands, from
    ``n_samples`` pixels that both images cover, and its prediction, in [0, 1] if
    ``clamped``. The sample is a documented bound on what the models are fitted to."""
    shares = class_shares(fine, grid, classes, max_na, layer)
    both = coarse.select("row", "col", *[band(b).alias(b) for b in bands]).na.drop(subset=list(bands)).join(shares, ["row", "col"])
    both = both.orderBy(F.xxhash64(F.lit(seed), "row", "col"), "row", "col").limit(n_samples).withColumn("feature", F.lit(0)).persist()
    models, out = {}, coarse
    try:
        for k in classes:
            models[k] = fit(both.withColumn("response", F.col(f"fC_{k}")), bands, model, "regression", tune_length, k_folds, seed=seed, **args)
    finally:
        both.unpersist()
    feats = coarse.select(*dict.fromkeys([*keys, "row", "col"]), *[band(b).alias(b) for b in bands])
    ok = feats.na.drop(subset=list(bands))
    for k, m in models.items():
        ok = VectorAssembler(inputCols=list(m.bands), outputCol="features").transform(ok)
        ok = m.model.transform(ok).withColumnRenamed("prediction", f"fC_{k}").drop("features")
        if clamped:
            ok = ok.withColumn(f"fC_{k}", clamp(F.col(f"fC_{k}"), 0.0, 1.0))
    cols = [f"fC_{k}" for k in classes]
    rest = feats.where(~all_present([F.col(b) for b in bands])).select(*keys, *[F.lit(None).cast("double").alias(c) for c in cols])
    out = ok.select(*keys, *cols).unionByName(rest)
    return models, out
