"""Statistics of whole images, each in one aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import band, div


def summary(df: DataFrame, bands: list[str]) -> dict[str, dict[str, float]]:
    """min, max, mean, sd (n - 1) and n of each band."""
    aggs = [f(band(b)).alias(f"{n}{i}") for i, b in enumerate(bands) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_samp), ("n", F.count))]
    r = df.agg(*aggs).first()
    return {b: {n: r[f"{n}{i}"] for n in ("min", "max", "mean", "sd", "n")} for i, b in enumerate(bands)}


def summary_frame(df: DataFrame, bands: list[str], prefix: str = "") -> DataFrame:
    """The same as a one-row frame <prefix><stat>_<band>, to cross join lazily."""
    return df.agg(*[f(band(b)).alias(f"{prefix}{n}_{b}") for b in bands for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_samp))])


#: Twice the error in rank of the first pass of ``quantile_frame``, as a share of the rows.
_NEAR, _ACCURACY = 4e-4, 10_000


def quantile_frame(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> DataFrame:
    """A row with an array of the exact quantiles (linear interpolation) of each column.

    Two passes: a sketch of bounded size gives values around each quantile, then
    what lies strictly between them is gathered, less than a thousandth of the
    rows, and what lies below them is counted; no task holds all values."""
    own = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    ends = [float(x) for p in probs for x in (max(p - _NEAR, 0.0), min(p + _NEAR, 1.0))]
    marks = own.agg(*[f(F.col(f"c{i}")).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("q", lambda c: F.percentile_approx(c, F.array(*[F.lit(x) for x in ends]), F.lit(_ACCURACY))), ("n", F.count))])
    both, aggs = own.crossJoin(F.broadcast(marks)), []
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        aggs.append(F.any_value(f"n{i}").alias(f"n{i}"))
        for k in range(len(probs)):
            lo, hi = F.col(f"q{i}")[2 * k], F.col(f"q{i}")[2 * k + 1]
            aggs += [F.any_value(lo).alias(f"lo{i}_{k}"), F.any_value(hi).alias(f"hi{i}_{k}"), F.count_if(c < lo).alias(f"b{i}_{k}"), F.count_if(c == lo).alias(f"e{i}_{k}"), F.array_sort(F.collect_list(F.when((c > lo) & (c < hi), c))).alias(f"m{i}_{k}")]
    out = both.agg(*aggs)

    def at(i: int, k: int, rank: Column) -> Column:
        after = (rank - F.col(f"b{i}_{k}") - F.col(f"e{i}_{k}")).cast("int")
        return F.when(after < 0, F.col(f"lo{i}_{k}")).otherwise(F.coalesce(F.get(F.col(f"m{i}_{k}"), after), F.col(f"hi{i}_{k}")))

    found = []
    for i, name in enumerate(columns):
        values = []
        for k, p in enumerate(probs):
            place = F.lit(float(p)) * (F.col(f"n{i}") - 1)
            low = F.floor(place)
            a, b = at(i, k, low), at(i, k, F.ceil(place))
            values.append(a + (place - low) * (b - a))
        found.append(F.array(*values).alias(name))
    return out.select(*found)


def quantiles(df: DataFrame, bands: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation."""
    r = quantile_frame(df, {f"q{i}": band(b) for i, b in enumerate(bands)}, probs).first()
    return {b: r[f"q{i}"] for i, b in enumerate(bands)}


def frequencies(df: DataFrame, bands: list[str]) -> DataFrame:
    """(band, value, freq) of the values that occur."""
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), band(b).alias("value")) for b in bands])).alias("p")
    return df.select(pairs).where("p.value IS NOT NULL").groupBy(F.col("p.band").alias("band"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def ecdf(freq: DataFrame, by: list[str] = ("band",)) -> DataFrame:
    """Adds ``p``, the share of pixels that are no greater; on the frequency
    table: the window of a band holds its distinct values (of a band of real
    numbers they may be as many as its pixels; bound them by a sample there)."""
    w = Window.partitionBy(*by)
    return freq.withColumn("p", F.sum("freq").over(w.orderBy("value")) / F.sum("freq").over(w))


def covariance_columns(bands: list[Column], corr: bool = False) -> list[Column]:
    f = F.corr if corr else F.covar_samp
    return [f(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(bands) for j, b in enumerate(bands) if j >= i]


def covariance(df: DataFrame, bands: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance matrix) of the pixels that have all bands."""
    cols = [band(b) for b in bands]
    full = df.select(*[c.alias(f"b{i}") for i, c in enumerate(cols)]).na.drop()
    own = [F.col(f"b{i}") for i in range(len(bands))]
    r = full.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(own)], *covariance_columns(own)).first()
    k = len(bands)
    cov = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(i, k):
            x = r[f"c_{i}_{j}"]
            cov[i, j] = cov[j, i] = np.nan if x is None else x
    return r["n"], np.array([np.nan if r[f"m_{i}"] is None else r[f"m_{i}"] for i in range(k)]), cov


def linear_fit(df: DataFrame, y: Column, x: Column, by: list[str] = ()) -> DataFrame:
    """slope and intercept of y ~ x, per group."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def rmse(p: Column, o: Column) -> Column:
    """An aggregate: the root of the mean squared difference."""
    return F.sqrt(F.avg((p - o) * (p - o)))


def entropy_of_counts(df: DataFrame, by: list[str], count: str = "n") -> DataFrame:
    """Shannon entropy (nats) of the counts of each group."""
    w = F.sum(count).over(Window.partitionBy(*by))
    return df.withColumn("p", div(F.col(count).cast("double"), w)).groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))
