"""Topographic correction of illumination."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import band, div, lit
from ..grid import GridSpec, sample_random
from . import focal

METHODS = ("cos", "avgcos", "minnaert", "C", "stat", "illu")
#: Pixels that a stratum's fit needs, and those that a fit takes at most.
LEAST_IN_STRATUM, FIT_PIXELS = 50, 10_000


def sun_angles(elevation: float, azimuth: float) -> tuple[float, float]:
    """(azimuth, zenith) in radians from degrees."""
    return math.radians(azimuth), math.radians(90 - elevation)


def illumination(slope: Column, aspect: Column, azimuth: float, zenith: float) -> Column:
    """The cosine of the angle between the sun and the ground's normal."""
    lean = F.sin(slope) * F.coalesce(F.cos(lit(azimuth) - aspect), F.when(slope == 0, lit(0)))
    return lit(math.cos(zenith)) * F.cos(slope) + lit(math.sin(zenith)) * lean


def with_illumination(img: DataFrame, dem: DataFrame, solar: tuple[float, float], grid: GridSpec | None = None, elevation: str = "dem") -> DataFrame:
    """The image with slope, aspect and illu. ``dem`` has slope and aspect
    (radians), or elevations from which they are computed."""
    if not {"slope", "aspect"} <= set(dem.columns):
        dem = focal.terrain(dem, elevation, grid)
    return img.join(dem.select("row", "col", "slope", "aspect"), ["row", "col"]).withColumn("illu", illumination(F.col("slope"), F.col("aspect"), *solar))


def strata(df: DataFrame, layer: str, n: int, how: str = "equal") -> list[tuple[float, float]]:
    """n bins of a layer, of equal width or of equal counts (``quantile``); those
    of fewer than 50 pixels are merged with the next."""
    if how == "quantile":
        edges = df.agg(F.percentile(band(layer), F.array(*[lit(i / n) for i in range(n + 1)]))).first()[0]
    else:
        lo, hi = df.agg(F.min(band(layer)), F.max(band(layer))).first()
        edges = None if lo is None else [lo + (hi - lo) * i / n for i in range(n + 1)]
    if not edges:
        return []
    edges = sorted(set(edges))
    if len(edges) == 1:
        return [(float("-inf"), float("inf"))]
    counts = df.where(F.col(layer).isNotNull()).groupBy(_bin(band(layer), list(zip(edges, edges[1:]))).alias("b")).count().collect()
    size = {r["b"]: r["count"] for r in counts}
    bins, held, start = [], 0, edges[0]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        held += size.get(i, 0)
        if held >= LEAST_IN_STRATUM:
            bins.append((start, b))
            start, held = b, 0
    if start < edges[-1]:
        if bins:
            bins[-1] = (bins[-1][0], edges[-1])
        else:
            bins = [(edges[0], edges[-1])]
    return bins


def _bin(c: Column, bins: list[tuple[float, float]]) -> Column:
    """The number of the bin (a, b] of c; the first has its lower end too."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(bins))):
        low = (c >= lit(a)) if i == 0 else (c > lit(a))
        out = F.when(low & (c <= lit(b)), F.lit(i)).otherwise(out)
    return out


def _fits(df: DataFrame, bands: list[str], method: str, cos_z: float, sample: int | None, seed: int) -> DataFrame:
    """(_fit, s<i>, i<i>): slope and intercept of each band, a row for each stratum."""
    if sample:
        df = sample_random(df, sample, bands + ["illu"], seed, "_key")
    if method != "stat":
        df = df.where((F.col("slope") > math.radians(2)) & (F.col("illu") >= 0))
    least = lambda c: F.when(c <= 0, lit(1e-32)).otherwise(c)
    aggs = []
    for i, b in enumerate(bands):
        y, x = band(b), F.col("illu")
        if method == "minnaert":
            y, x = F.log(least(y)), F.log(least(div(x, lit(cos_z))))
        aggs += [F.regr_slope(y, x).alias(f"_s{i}"), F.regr_intercept(y, x).alias(f"_i{i}")]
    return df.groupBy(F.col("_stratum").alias("_fit")).agg(*aggs)


def top_cor(
    img: DataFrame,
    dem: DataFrame,
    bands: list[str],
    solar: tuple[float, float],
    method: str = "C",
    grid: GridSpec | None = None,
    elevation: str = "dem",
    stratify_by: str | None = None,
    n_strata: int = 5,
    sample: int | None = None,
    seed: int = 1,
    keys: list[str] = ("row", "col"),
) -> DataFrame:
    """keys and the corrected bands; method ``illu`` gives keys and illu.

    ``solar`` is (azimuth, zenith) in radians. ``minnaert`` fits its exponent per
    stratum of ``stratify_by`` (a layer of the image, or slope), without one over
    all. Fits use all pixels unless ``sample`` bounds them."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    keys, cos_z = list(keys), math.cos(solar[1])
    df = with_illumination(img, dem, solar, grid, elevation)
    if method == "illu":
        return df.select(*keys, "illu")
    illu = F.col("illu")
    if method == "cos":
        return df.select(*keys, *[(band(b) * div(lit(cos_z), illu)).alias(b) for b in bands])
    if method == "avgcos":
        mean = df.agg(F.avg("illu").alias("_mean"))
        return df.crossJoin(F.broadcast(mean)).select(*keys, *[(band(b) + band(b) * div(F.col("_mean") - illu, F.col("_mean"))).alias(b) for b in bands])
    bins = [(float("-inf"), float("inf"))]
    if method == "minnaert" and stratify_by:
        bins = strata(df, stratify_by, n_strata)
    layer = band(stratify_by) if stratify_by else illu
    df = df.withColumn("_stratum", _bin(layer, bins) if len(bins) > 1 else F.lit(0)).withColumn("_key", F.hash("row", "col"))
    # the fits stay in the plan, a row for each stratum, so that the terrain is shuffled once for both uses
    fits = F.broadcast(_fits(df, bands, method, cos_z, sample, seed))
    df = df.join(fits, F.col("_stratum") == F.col("_fit"), "left")
    out = []
    for i, b in enumerate(bands):
        y, slope, intercept = band(b), F.col(f"_s{i}"), F.col(f"_i{i}")
        if method == "minnaert":
            new = y * div(lit(cos_z), F.pow(illu, F.least(F.greatest(slope, lit(0.0)), lit(1.0))))
        elif method == "stat":
            new = y - illu * slope
        else:
            ratio = F.try_divide(intercept, slope)
            new = F.when(F.abs(ratio) < lit(float("inf")), y * div(lit(cos_z) + ratio, illu + ratio)).otherwise(y)
        c = F.when(slope.isNotNull(), new)
        out.append(F.when(~F.isnan(c), c).alias(b))
    return df.select(*keys, *out)
