"""Transforms of pixels: tasseled cap, principal components, angles, change, entropy,
pan sharpening."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.expr import band, clamp, div, dot, first_smallest, lit, no_nan, total
from ..grid import GridSpec, sample_random
from . import focal, match

_LS5 = ((0.2043, 0.4158, 0.5524, 0.5741, 0.3124, 0.2303), (-0.1603, -0.2819, -0.4934, 0.7940, 0.0002, -0.1446), (0.0315, 0.2021, 0.3102, 0.1594, 0.6806, -0.6109))
#: Coefficients of brightness, greenness and wetness over each sensor's bands.
TASSELED_CAP = {
    "landsat4tm": _LS5,
    "landsat5tm": _LS5,
    "landsat7etm": ((0.3561, 0.3972, 0.3904, 0.6966, 0.2286, 0.1596), (-0.3344, -0.3544, -0.4556, 0.6966, -0.0242, -0.2630), (0.2626, 0.2141, 0.0926, 0.0656, -0.7629, -0.5388)),
    "landsat8oli": ((0.3029, 0.2786, 0.4733, 0.5599, 0.5080, 0.1872), (-0.2941, -0.2430, -0.5424, 0.7276, 0.0713, -0.1608), (0.1511, 0.1973, 0.3283, 0.3407, -0.7117, -0.4559)),
    "modis": ((0.4395, 0.5945, 0.2460, 0.3918, 0.3506, 0.2136, 0.2678), (-0.4064, 0.5129, -0.2744, -0.2893, 0.4882, -0.0036, -0.4169), (0.1147, 0.2489, 0.2408, 0.3132, -0.3122, -0.6416, -0.5087)),
    "quickbird": ((0.319, -0.121, 0.652, 0.677), (0.542, -0.331, 0.375, -0.675), (0.490, -0.517, -0.639, 0.292)),
    "spot5": ((0.492, 0.610, 0.416, 0.462), (-0.196, -0.389, 0.896, -0.084), (0.397, 0.260, 0.118, -0.872)),
    "rapideye": ((0.2435, 0.3448, 0.4881, 0.4930, 0.5835), (-0.2216, -0.2319, -0.4622, -0.2154, 0.7981), (-0.7564, -0.3916, 0.5049, 0.1400, 0.0064)),
}


def tasseled_cap(img: DataFrame, bands: list[str], sensor: str, keys: list[str] = ("row", "col")) -> DataFrame:
    """keys, brightness, greenness and wetness, from the sensor's bands in order."""
    try:
        rows = TASSELED_CAP[sensor.lower()]
    except KeyError:
        raise ValueError(f"sensor is one of {sorted(TASSELED_CAP)}") from None
    if len(bands) != len(rows[0]):
        raise ValueError(f"{sensor} needs {len(rows[0])} bands, not {len(bands)}")
    b = [band(x) for x in bands]
    return img.select(*keys, *[dot(b, [lit(w) for w in r]).alias(n) for n, r in zip(("brightness", "greenness", "wetness"), rows)])


@dataclass(frozen=True)
class PCA:
    """Means, scales and loadings (a column for each component)."""

    bands: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    sdev: np.ndarray
    n: int

    def scores(self, img: DataFrame, keys: list[str] = ("row", "col"), n_comp: int | None = None) -> DataFrame:
        """keys and PC1 ..: NULL where a band is."""
        z = [(band(b) - lit(m)) / lit(s) for b, m, s in zip(self.bands, self.mean, self.scale)]
        k = n_comp or self.loadings.shape[1]
        return img.select(*keys, *[dot(z, [lit(w) for w in self.loadings[:, j]]).alias(f"PC{j + 1}") for j in range(k)])

    def back(self, df: DataFrame, keys: list[str], components: list[str] | None = None) -> DataFrame:
        """keys and the bands from the components' columns."""
        pcs = [band(c) for c in (components or [f"PC{j + 1}" for j in range(self.loadings.shape[1])])]
        return df.select(*keys, *[(dot(pcs, [lit(w) for w in self.loadings[i]]) * lit(self.scale[i]) + lit(self.mean[i])).alias(b) for i, b in enumerate(self.bands)])


def pca_fit(img: DataFrame, bands: list[str], standardise: bool = False, n_samples: int | None = None, seed: int = 1, key: str = "cell") -> PCA:
    """Principal components of the pixels that have all bands: one aggregation and
    the eigenvectors of a small matrix. The first loading of each that isn't 0 is
    positive. With ``n_samples`` the divisor is n, as for a sample."""
    df = sample_random(img, n_samples, list(bands), seed, key) if n_samples else img
    n, mean, cov = stats.covariance(df, list(bands))
    if n < 2 or not np.isfinite(cov).all():
        raise ValueError("too few pixels have all bands")
    scale = np.ones(len(bands))
    if standardise:
        scale = np.sqrt(np.diag(cov) * (n - 1) / n)
        if (scale == 0).any():
            raise ValueError("a constant band can't be standardised")
        sd = np.sqrt(np.diag(cov))
        cov = cov / np.outer(sd, sd)
    elif n_samples:
        cov = cov * (n - 1) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    for j in range(vectors.shape[1]):
        first = vectors[np.flatnonzero(np.abs(vectors[:, j]) > 1e-12)[0], j]
        vectors[:, j] *= np.sign(first)
    return PCA(tuple(bands), mean, scale, vectors, np.sqrt(np.maximum(values, 0)), n)


def raster_pca(img: DataFrame, bands: list[str], keys: list[str] = ("row", "col"), n_comp: int | None = None, standardise: bool = False, n_samples: int | None = None) -> tuple[PCA, DataFrame]:
    model = pca_fit(img, bands, standardise, n_samples, key=keys[0])
    return model, model.scores(img, list(keys), n_comp)


def spectral_angle(b: list[Column], spectrum: list[float]) -> Column:
    """Radians between a pixel and a spectrum."""
    e = [lit(x) for x in spectrum]
    norm = sum(float(x) ** 2 for x in spectrum)
    return no_nan(F.acos(clamp(div(dot(b, e), F.sqrt(dot(b, b) * lit(norm))), -1.0, 1.0)))


def sam(img: DataFrame, endmembers: dict[str, list[float]], bands: list[str], keys: list[str] = ("row", "col"), angles: bool = False) -> DataFrame:
    """keys and the 1-based number of the spectrum with the smallest angle (first
    of equals), or with ``angles`` all angles as <name>_sa."""
    for n, e in endmembers.items():
        if len(e) != len(bands):
            raise ValueError(f"{n} has {len(e)} values for {len(bands)} bands")
    b = [band(x) for x in bands]
    cols = {n: spectral_angle(b, e) for n, e in endmembers.items()}
    if angles:
        return img.select(*keys, *[c.alias(f"{n}_sa") for n, c in cols.items()])
    return img.select(*keys, *[c.alias(f"_a{i}") for i, c in enumerate(cols.values())]).select(*keys, first_smallest([F.col(f"_a{i}") for i in range(len(cols))]).alias("class"))


def cva(x: DataFrame, y: DataFrame, bands: tuple[str, str], keys: list[str] = ("row", "col"), nct: float | None = None, tmf: float | None = None, strict_compat: bool = False) -> DataFrame:
    """keys, angle (degrees clockwise from the second band) and magnitude of the
    change from x to y. Changes smaller than ``nct``, or than ``tmf`` times the
    median magnitude, are NULL; with ``strict_compat`` angle and magnitude below
    the threshold are raised to it."""
    a, b = bands
    both = x.select(*keys, band(a).alias("_x1"), band(b).alias("_x2")).join(y.select(*keys, band(a).alias("_y1"), band(b).alias("_y2")), list(keys))
    d1, d2 = F.col("_y1") - F.col("_x1"), F.col("_y2") - F.col("_x2")
    turn = F.degrees(F.atan2(d1, d2))
    df = both.select(*keys, F.when(turn < 0, turn + 360.0).otherwise(turn).alias("angle"), F.sqrt(d1 * d1 + d2 * d2).alias("magnitude"))
    if tmf is None and nct is None:
        return df
    if nct is None:
        df = df.crossJoin(F.broadcast(stats.quantile_frame(df, {"m": F.col("magnitude")}, [0.5]).select((F.col("m")[0] * lit(tmf)).alias("_nct"))))
        limit = F.col("_nct")
    else:
        limit = lit(nct)
    if strict_compat:
        out = [F.when(F.col(c) < limit, limit).otherwise(F.col(c)).alias(c) for c in ("angle", "magnitude")]
    else:
        out = [F.when(F.col("magnitude") >= limit, F.col(c)).alias(c) for c in ("angle", "magnitude")]
    return df.select(*keys, *out)


def entropy(img: DataFrame, bands: list[str], keys: list[str] = ("row", "col")) -> DataFrame:
    """keys and the entropy (nats) of each pixel's values as categories. Missing
    values count for nothing but the divisor."""
    if len(bands) < 2:
        raise ValueError("entropy needs two bands at least")
    n, b = len(bands), [band(x) for x in bands]
    # each band's share of equal values: the sum of -log(share) / n is the entropy
    terms = []
    for x in b:
        same = total([F.coalesce((x == y).cast("int"), F.lit(0)) for y in b]) / lit(n)
        terms.append(F.when(x.isNotNull(), -F.log(same) / lit(n)).otherwise(lit(0)))
    out = F.when(total([y.isNotNull().cast("int") for y in b]) > 0, total(terms))
    return img.select(*keys, out.alias("entropy"))


def pan_sharpen(img: DataFrame, pan: DataFrame, bands: list[str], pan_band: str, grid: GridSpec, rgb: tuple[str, str, str] | None = None, method: str = "brovey", pc: int = 1, norm: bool = True, keys: list[str] = ("row", "col")) -> DataFrame:
    """keys (of the pan image) and the bands <band>_pan at its resolution, by
    ``brovey``, ``ihs`` (both over ``rgb``) or ``pca``. ``grid`` is the coarse image's."""
    keys, own = list(keys), band(pan_band).alias("_pan")
    base = pan.select(*dict.fromkeys([*keys, "row", "col", "x", "y"]), own)
    rgb = rgb or tuple(bands[:3])
    if method == "brovey":
        near = focal.resample_nearest(base, img, grid, bands)
        s = total([band(b) for b in rgb])
        return near.select(*keys, *[(band(b) * div(F.col("_pan"), s)).alias(f"{b}_pan") for b in rgb])
    if method == "ihs":
        r, g, b = (band(x) for x in rgb)
        six, two = 6**0.5, 2**0.5
        v = img.select("row", "col", ((r + g + b) / lit(3)).alias("_i"), ((r + g - b * 2.0) / lit(six)).alias("_v1"), ((r - g) / lit(two)).alias("_v2"))
        up = focal.resample_bilinear(base, v, grid, ["_v1", "_v2"])
        lut = match.hist_lut(base.select("row", "col", F.col("_pan").alias("_i")), v.select("row", "col", "_i"), ["_i"])
        light = match.apply_lut(base.select(*dict.fromkeys([*keys, "row", "col"]), F.col("_pan").alias("_i")), lut, ["_i"], list(dict.fromkeys([*keys, "row", "col"])), complete=True)
        both = light.join(up, ["row", "col"])
        i, v1, v2 = F.col("_i"), F.col("_v1"), F.col("_v2")
        out = (i + v1 / lit(six) + v2 / lit(two), i + v1 / lit(six) - v2 / lit(two), i - v1 * 2.0 / lit(six))
        return both.select(*keys, *[c.alias(f"{n}_pan") for c, n in zip(out, rgb)])
    if method == "pca":
        model = pca_fit(img, bands, key="row")
        names = [f"PC{j + 1}" for j in range(len(bands))]
        near = focal.resample_nearest(base, model.scores(img, ["row", "col"]), grid, names)
        target, id_ = f"PC{pc}", list(dict.fromkeys([*keys, "row", "col"]))
        source = base.select(*id_, F.col("_pan").alias(target))
        if norm:
            pcs = model.scores(img, ["row", "col"]).select("row", "col", target)
            new = match.rescale(source, [target], id_, to=pcs)
        else:
            new = match.hist_match(source, model.scores(img, ["row", "col"]), [target], id_)
        both = near.drop(target).join(new.select("row", "col", target), ["row", "col"])
        return model.back(both, keys, names).select(*keys, *[F.col(b).alias(f"{b}_pan") for b in bands])
    raise ValueError("method is one of brovey, ihs, pca")


