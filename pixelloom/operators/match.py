"""Matching the values of images: rescaling, normalising, histograms, invariant pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.expr import all_present, band, div, dot, lit, no_nan, total


def _limit(x, b: str, i: int):
    return x.get(b) if isinstance(x, dict) else x[i] if isinstance(x, (list, tuple)) else x


def rescale(img: DataFrame, bands: list[str], keys: list[str], xmin=None, xmax=None, ymin=0.0, ymax=1.0, to: DataFrame | None = None) -> DataFrame:
    """keys and the bands, linearly from [xmin, xmax] to [ymin, ymax].

    Limits are one number for all bands, or a list or dict of one for each. The
    image's own range is used where xmin or xmax is missing, that of ``to`` for
    the target if that image is given. A constant band is NULL."""
    own = stats.summary_frame(img, bands, "x_") if xmin is None or xmax is None else None
    df = img if own is None else img.crossJoin(F.broadcast(own))
    if to is not None:
        df = df.crossJoin(F.broadcast(stats.summary_frame(to, bands, "y_")))
    out = []
    for i, b in enumerate(bands):
        end = lambda v, name, src: F.col(f"{src}_{name}_{b}") if v is None else lit(v)  # noqa: E731, B023
        x0, x1 = end(_limit(xmin, b, i), "min", "x"), end(_limit(xmax, b, i), "max", "x")
        y0, y1 = (F.col(f"y_min_{b}"), F.col(f"y_max_{b}")) if to is not None else (lit(_limit(ymin, b, i)), lit(_limit(ymax, b, i)))
        out.append(no_nan((band(b) - x0) * div(y1 - y0, x1 - x0) + y0).alias(b))
    return df.select(*keys, *out)


def normalise(img: DataFrame, bands: list[str], keys: list[str], scale: bool = True) -> DataFrame:
    """keys and the bands, less their mean, and over their sample deviation if ``scale``."""
    df = img.crossJoin(F.broadcast(stats.summary_frame(img, bands)))
    return df.select(*keys, *[(div(band(b) - F.col(f"mean_{b}"), F.col(f"sd_{b}")) if scale else band(b) - F.col(f"mean_{b}")).alias(b) for b in bands])


def freeze(img: DataFrame, bands: list[str]) -> dict[str, dict[str, float]]:
    """Statistics to apply to other images, streams among them; see ``apply_scale``."""
    return stats.summary(img, bands)


def apply_scale(img: DataFrame, frozen: dict, bands: list[str], keys: list[str], how: str = "normalise") -> DataFrame:
    """Rescaling to [0, 1] or normalising by frozen statistics: one projection."""
    a, b_ = ("mean", "sd") if how == "normalise" else ("min", "max")
    out = []
    for b in bands:
        s = frozen[b]
        width = s[b_] if how == "normalise" else s[b_] - s[a]
        out.append((div(band(b) - lit(s[a]), lit(width))).alias(b))
    return img.select(*keys, *out)


def hist_lut(img: DataFrame, ref: DataFrame, bands: list[str], mask: Column | None = None, ref_mask: Column | None = None, n_samples: int | None = None, paired: bool = True, seed: int = 1) -> DataFrame:
    """(band, value, matched): each value's counterpart at the same share of the
    reference's pixels, linear between its distinct values; below the first the
    reference's least, above the last its greatest.

    Windows run over the tables of distinct values. Pixels where a mask is NULL
    are left out. ``n_samples`` bounds the pixels that the shares are taken from
    (with ``paired`` the same cells of both images)."""
    x = img if mask is None else img.where(mask.isNotNull())
    y = ref if ref_mask is None else ref.where(ref_mask.isNotNull())
    if n_samples:
        order = lambda d, s: d.orderBy(F.xxhash64(F.lit(s), *[F.col(c) for c in ("row", "col")])).limit(n_samples)
        x, y = order(x, seed), order(y, seed if paired else seed + 1)
    own = stats.ecdf(stats.frequencies(x, bands)).select("band", "value", "p")
    other = stats.ecdf(stats.frequencies(y, bands))
    w = Window.partitionBy("band").orderBy("value")
    steps = other.select("band", F.col("p").alias("p0"), F.col("value").alias("v0"), F.lead("p").over(w).alias("p1"), F.lead("value").over(w).alias("v1"))
    ends = other.groupBy(F.col("band").alias("b")).agg(F.min("p").alias("low"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    # an as-of lookup: both tables in the order of shares, the last step at or before a share is its own
    both = own.select("band", "p", "value", F.lit(None).cast("struct<p0:double,v0:double,p1:double,v1:double>").alias("s"), F.lit(1).alias("k"))
    both = both.unionByName(steps.select("band", F.col("p0").alias("p"), F.lit(None).cast("double").alias("value"), F.struct("p0", "v0", "p1", "v1").alias("s"), F.lit(0).alias("k")))
    last = F.last("s", ignorenulls=True).over(Window.partitionBy("band").orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("t", last).where("k = 1").join(ends, F.col("band") == F.col("b"))
    inside = F.col("t.v0") + div(F.col("p") - F.col("t.p0"), F.col("t.p1") - F.col("t.p0")) * (F.col("t.v1") - F.col("t.v0"))
    matched = F.when(F.col("t").isNull() | (F.col("p") < F.col("low")), F.col("vmin")).when(F.col("t.p1").isNull(), F.col("vmax")).otherwise(inside)
    return found.select("band", "value", matched.alias("matched"))


def apply_lut(img: DataFrame, lut: DataFrame, bands: list[str], keys: list[str], integer: bool = False, complete: bool = False) -> DataFrame:
    """keys and the bands mapped by the table. Values that it lacks take the entry
    of the largest value below them, or the first one; ``complete`` says that it
    lacks none of the image's values, which saves a scan."""
    if not complete:
        w = Window.partitionBy("band").orderBy("value")
        both = stats.frequencies(img, bands).select("band", "value").join(lut, ["band", "value"], "full_outer")
        last = F.last("matched", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        first = F.first("matched", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        lut = both.select("band", "value", F.coalesce(last, first).alias("matched"))
    df = img
    for i, b in enumerate(bands):
        own = lut.where(F.col("band") == b).select(F.col("value").alias(f"_v{i}"), F.col("matched").alias(f"_e{i}"))
        df = df.join(own, band(b) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    out = [(F.rint(F.col(f"_e{i}")) if integer else F.col(f"_e{i}")).alias(b) for i, b in enumerate(bands)]
    return df.select(*keys, *out)


def hist_match(img: DataFrame, ref: DataFrame, bands: list[str], keys: list[str], integer: bool = False, mask: Column | None = None, ref_mask: Column | None = None, n_samples: int | None = None, intersect_only: bool = False, return_lut: bool = False):
    """The image with each band's histogram matched to the reference's. With
    ``return_lut`` the lookup table instead of the image. ``intersect_only``
    takes the shares from the cells that both images have."""
    x, y = img, ref
    if intersect_only:
        x = img.join(ref.select("row", "col"), ["row", "col"], "left_semi")
        y = ref.join(img.select("row", "col"), ["row", "col"], "left_semi")
    if n_samples or mask is not None or intersect_only:
        # values outside the sample take the share of the largest sampled value below them
        lut = hist_lut(x, y, bands, mask, ref_mask, n_samples)
        lut = fill_lut(lut, stats.frequencies(img, bands), stats.frequencies(y, bands))
    else:
        lut = hist_lut(x, y, bands, None, ref_mask)
    return lut if return_lut else apply_lut(img, lut, bands, keys, integer, complete=True)


def fill_lut(lut: DataFrame, values: DataFrame, ref: DataFrame) -> DataFrame:
    """The table over all of an image's values, from one over some of them."""
    least = ref.groupBy(F.col("band").alias("b")).agg(F.min("value").alias("vmin"))
    both = values.select("band", "value").join(lut, ["band", "value"], "full_outer")
    last = F.last("matched", ignorenulls=True).over(Window.partitionBy("band").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("m", last).join(least, F.col("band") == F.col("b")).select("band", "value", F.coalesce("m", "vmin").alias("matched"))


def similarity(a: list[Column], b: list[Column], method: str = "cor") -> Column:
    """Of two pixels' bands: ``cor`` Pearson's correlation, ``sam`` the negative
    spectral angle, ``ed`` the negative Euclidean distance; larger is more alike."""
    if method == "ed":
        return -F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b)]))
    if method == "sam":
        return -no_nan(F.acos(div(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))))
    if method == "cor":
        n = len(a)
        ma, mb = total(a) / lit(n), total(b) / lit(n)
        da, db = [x - ma for x in a], [y - mb for y in b]
        return div(dot(da, db), F.sqrt(dot(da, da) * dot(db, db)))
    raise ValueError("method is one of cor, sam, ed")


def pif_match(img: DataFrame, ref: DataFrame, bands: list[str], keys: list[str] = ("row", "col"), method: str = "cor", quantile: float = 0.95, strict_compat: bool = False, parts: bool = False):
    """The image matched to the reference by the pixels that changed least: those
    whose similarity is above its quantile give each band's regression.

    With ``parts`` a dict of the image, the similarity, the pixels' flags and the
    models. ``strict_compat`` takes the largest angles with ``sam``."""
    keys = list(keys)
    r = ref.select(*keys, *[band(b).alias(f"_r_{b}") for b in bands])
    both = img.join(r, keys)
    a, b = [band(x) for x in bands], [F.col(f"_r_{x}") for x in bands]
    sim = similarity(a, b, method)
    if strict_compat and method == "sam":
        sim = -sim
    both = both.withColumn("_sim", F.when(all_present(a + b), sim))
    cut = stats.quantile_frame(both, {"cut": F.col("_sim")}, [quantile]).first()[0][0]
    pif = F.col("_sim") > lit(cut) if cut is not None else F.lit(False)
    row = both.where(pif).agg(*[f(F.col(f"_r_{x}"), band(x)).alias(f"{n}{i}") for i, x in enumerate(bands) for n, f in (("s", F.regr_slope), ("i", F.regr_intercept))]).first()
    models = {x: (row[f"s{i}"], row[f"i{i}"]) for i, x in enumerate(bands)}
    model = lambda x: band(x) * lit(models[x][0]) + lit(models[x][1]) if None not in models[x] else F.lit(None).cast("double")
    out = img.select(*keys, *[model(x).alias(x) for x in bands])
    if not parts:
        return out
    return {"img": out, "similarity": both.select(*keys, F.col("_sim").alias("similarity")), "pif": both.select(*keys, pif.alias("pif")), "models": models}
