"""Registering images by mutual information."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import band, lit
from ..grid import seeded


def shift_grid(most: int = 3, step: int = 1) -> list[tuple[int, int]]:
    """All (x, y) shifts of 0, +-step .. +-most pixels."""
    one = sorted({s * k for k in range(0, most + 1, step) for s in (1, -1)})
    return list(product(one, one))


def binned(c: Column, low: Column, high: Column, n: int) -> Column:
    """0-based bin of equal width; right-closed, the lowest value in the first."""
    width = (high - low) / lit(n)
    k = F.ceil(F.try_divide(c - low, width)) - 1
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(k, F.lit(0)))).cast("int")


def mutual_information(moving: DataFrame, fixed: DataFrame, bands: list[str], shifts: list[tuple[int, int]], n_bins: int = 100) -> DataFrame:
    """(shift, dx, dy, mi, n) in nats over all bands, for moving images put (dx, dy)
    pixels to the right and up. One join serves all shifts: each pixel of the
    fixed image is sent to the moving pixels that it would meet."""
    spark = moving.sparkSession
    step = F.broadcast(spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(shifts)], "shift int, dx int, dy int"))
    def bins(df: DataFrame, name: str) -> DataFrame:
        """row, col and the bins of all bands, between the least and greatest value of any."""
        low, high = (f(*[x(band(b)) for b in bands]) if len(bands) > 1 else x(band(bands[0])) for f, x in ((F.least, F.min), (F.greatest, F.max)))
        both = df.crossJoin(F.broadcast(df.agg(low.alias("_lo"), high.alias("_hi"))))
        return both.select("row", "col", F.array(*[F.when(band(b).isNotNull(), binned(band(b), F.col("_lo"), F.col("_hi"), n_bins)) for b in bands]).alias(name))

    sent = bins(fixed, "f").crossJoin(step).select((F.col("row") + F.col("dy")).alias("row"), (F.col("col") - F.col("dx")).alias("col"), "f", "shift", "dx", "dy")
    # bands are taken apart after the join: a row for each pixel and shift is sent, whatever the number of bands
    met = sent.join(bins(moving, "m"), ["row", "col"]).select("shift", "dx", "dy", F.explode(F.arrays_zip("m", "f")).alias("b"))
    joint = met.where("b.m IS NOT NULL AND b.f IS NOT NULL").groupBy("shift", "dx", "dy", F.col("b.m").alias("mb"), F.col("b.f").alias("fb")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shift")
    p = joint.withColumn("t", F.sum("n").over(w)).withColumn("a", F.sum("n").over(Window.partitionBy("shift", "mb"))).withColumn("c", F.sum("n").over(Window.partitionBy("shift", "fb")))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a").cast("double") * F.col("c")))
    return p.groupBy("shift", "dx", "dy").agg(F.sum(term).alias("mi"), F.first("t").alias("n"))


def best_shift(moving: DataFrame, fixed: DataFrame, bands: list[str], shifts: list[tuple[int, int]], n_bins: int = 100) -> tuple[int, int]:
    """The first shift with the most information."""
    r = mutual_information(moving, fixed, bands, shifts, n_bins).orderBy(F.round("mi", 12).desc(), "shift").first()
    if r is None:
        raise ValueError("the images don't overlap")
    return r["dx"], r["dy"]


def coregister(img: DataFrame, ref: DataFrame, bands: list[str], shift: int | list[tuple[int, int]] = 3, step: int = 1, n_samples: int | None = None, n_bins: int = 100, seed: int = 1, report: bool = False, resolution: tuple[float, float] = (1.0, 1.0)):
    """The image moved onto the reference; with ``report`` a dict of it, the best
    shift (pixels), and the information of all shifts.

    All pixels of the reference are compared unless ``n_samples`` bounds them."""
    shifts = shift_grid(shift, step) if isinstance(shift, int) else list(shift)
    fixed = ref
    if n_samples:
        fixed = ref.orderBy(seeded(seed, "row", "col"), "row", "col").limit(n_samples)
    table = mutual_information(img, fixed, bands, shifts, n_bins).persist()
    try:
        r = table.orderBy(F.round("mi", 12).desc(), "shift").first()
        if r is None:
            raise ValueError("the images don't overlap")
        dx, dy = r["dx"], r["dy"]
        moved = img.withColumn("row", F.col("row") - dy).withColumn("col", F.col("col") + dx)
        if {"x", "y"} <= set(img.columns):
            moved = moved.withColumn("x", F.col("x") + lit(dx * resolution[0])).withColumn("y", F.col("y") + lit(dy * resolution[1]))
        if not report:
            return moved
        return {"img": moved, "shift": (dx, dy), "mi": {(x["dx"], x["dy"]): x["mi"] for x in table.collect()}}
    finally:
        table.unpersist()
