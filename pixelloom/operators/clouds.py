"""Clouds and their shadows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.expr import band, div, lit, total
from . import focal, register


def ndtci(img: DataFrame, blue: str, tir: str) -> DataFrame:
    """The image with NDTCI, the normalised difference of blue and of the thermal
    band, rescaled to blue's range."""
    ends = img.agg(*[f(band(b)).alias(n) for n, f, b in (("_b0", F.min, blue), ("_b1", F.max, blue), ("_t0", F.min, tir), ("_t1", F.max, tir))])
    c = lambda n: F.col(n)
    warm = (band(tir) - c("_t0")) * div(c("_b1") - c("_b0"), c("_t1") - c("_t0")) + c("_b0")
    df = img.crossJoin(F.broadcast(ends))
    return df.withColumn("NDTCI", div(band(blue) - warm, band(blue) + warm)).drop("_b0", "_b1", "_t0", "_t1")


def cloud_mask(img: DataFrame, threshold: float = 0.2, blue: str | None = None, tir: str | None = None, buffer: int | None = None, keys: list[str] = ("row", "col")) -> DataFrame:
    """keys, CMASK (1 where NDTCI reaches the threshold, else NULL) and NDTCI, which
    is taken from the image if it has it. ``buffer``, odd, grows the clouds."""
    df = img if "NDTCI" in img.columns else ndtci(img, blue, tir)
    out = df.select(*dict.fromkeys([*keys, "row", "col"]), F.when(F.col("NDTCI") >= lit(threshold), lit(1)).alias("CMASK"), "NDTCI")
    if buffer:
        out = focal.dilate(out, "CMASK", buffer)
    return out.select(*keys, "CMASK", "NDTCI")


def cloud_shadow_mask(img: DataFrame, clouds: DataFrame, bands: list[str], shift_estimate: tuple[int, int] | None = None, precise_shift: tuple[int, int] | None = None, quantile: float = 0.2, return_shift: bool = False, resolution: tuple[float, float] = (1.0, 1.0)):
    """row, col and CSMASK: 0 where a cloud's shadow falls, else NULL.

    Shadows are clouds moved by ``precise_shift`` (map units), or by the one of 13
    diagonal offsets around ``shift_estimate`` at which the moved clouds share
    most information with the image's dark pixels. ``return_shift`` gives the shift."""
    xres, yres = resolution
    if precise_shift is None:
        if shift_estimate is None:
            raise ValueError("give shift_estimate or precise_shift")
        sums = img.select("row", "col", total([band(b) for b in bands]).alias("s"))
        cut = stats.quantile_frame(sums, {"cut": F.col("s")}, [quantile]).first()[0][0]
        dark = sums.select("row", "col", F.when(F.col("s") < lit(cut), lit(1)).otherwise(lit(0)).alias("v"))
        cloud = img.select("row", "col").join(clouds.select("row", "col", "CMASK"), ["row", "col"], "left").select("row", "col", F.when(F.col("CMASK").isNotNull(), lit(1)).otherwise(lit(0)).alias("v"))
        steps = [(shift_estimate[0] + k / 2 * xres, shift_estimate[1] + k / 2 * yres) for k in range(-6, 7)]
        cells = [(round(x / xres), round(y / yres)) for x, y in steps]
        precise_shift = register.best_shift(cloud, dark, ["v"], cells, n_bins=2)
        precise_shift = (precise_shift[0] * xres, precise_shift[1] * yres)
    if return_shift:
        return precise_shift
    dc, dr = round(precise_shift[0] / xres), round(precise_shift[1] / yres)
    moved = clouds.where(F.col("CMASK").isNotNull()).select((F.col("row") - F.lit(dr)).alias("row"), (F.col("col") + F.lit(dc)).alias("col"), lit(0).alias("CSMASK"))
    return img.select("row", "col").join(moved, ["row", "col"], "left")
