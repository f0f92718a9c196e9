"""Pixel tables and their grids.

A pixel table has a row per grid cell: ``cell`` (1-based, row by row), ``row``
and ``col`` (0-based), ``x`` and ``y`` (the cell's centre) and the bands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.expr import band, no_nan

KEYS = ("cell", "row", "col", "x", "y")


@dataclass(frozen=True)
class GridSpec:
    """The geometry of an image."""

    ncol: int
    nrow: int
    xmin: float = 0.0
    ymax: float = 0.0
    xres: float = 1.0
    yres: float = 1.0
    crs: str | None = None

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """(xmin, xmax, ymin, ymax)"""
        return self.xmin, self.xmin + self.ncol * self.xres, self.ymax - self.nrow * self.yres, self.ymax

    def cell(self, row: Column, col: Column) -> Column:
        return (row.cast("long") * self.ncol + col + 1).cast("long")

    def x(self, col: Column) -> Column:
        return F.lit(self.xmin) + (col.cast("double") + 0.5) * self.xres

    def y(self, row: Column) -> Column:
        return F.lit(self.ymax) - (row.cast("double") + 0.5) * self.yres

    def col_of(self, x: Column) -> Column:
        return F.floor((x - self.xmin) / F.lit(float(self.xres))).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(float(self.ymax)) - y) / F.lit(float(self.yres))).cast("int")


def overlap(*extents: tuple[float, float, float, float]) -> tuple[float, float, float, float] | None:
    """The common box of boxes (xmin, xmax, ymin, ymax), or None."""
    lows, highs, bottoms, tops = zip(*extents)
    box = max(lows), min(highs), max(bottoms), min(tops)
    return box if box[0] < box[1] and box[2] < box[3] else None


def centre(extent: tuple[float, float, float, float]) -> tuple[float, float]:
    return (extent[0] + extent[1]) / 2, (extent[2] + extent[3]) / 2


def from_cells(df: DataFrame, grid: GridSpec, cell: str = "cell") -> DataFrame:
    """Adds row, col, x and y to a table that has 1-based cell numbers."""
    zero = F.col(cell).cast("long") - 1
    df = df.withColumn("row", F.floor(zero / F.lit(grid.ncol)).cast("int")).withColumn("col", (zero % grid.ncol).cast("int"))
    return df.withColumn("x", grid.x(F.col("col"))).withColumn("y", grid.y(F.col("row")))


def ingest(df: DataFrame, bands: list[str], keys: list[str] = ("cell", "row", "col")) -> DataFrame:
    """Keys and bands, these as DOUBLE with NaN turned into NULL."""
    return df.select(*keys, *[no_nan(band(b)).alias(b) for b in bands])


def crop(df: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centre lies in the box; a range filter that Parquet can use."""
    x0, x1, y0, y1 = extent
    return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") <= y1))


def shift(df: DataFrame, dx: float, dy: float) -> DataFrame:
    """The image moved by map units; pixel values stay."""
    return df.withColumn("x", F.col("x") + F.lit(float(dx))).withColumn("y", F.col("y") + F.lit(float(dy)))


def sample_regular(df: DataFrame, grid: GridSpec, max_pixels: int | None) -> DataFrame:
    """Every k-th pixel of every k-th row, k the least that keeps to max_pixels;
    all pixels if that is None."""
    if max_pixels is None:
        return df
    k = 1
    while -(-grid.ncol // k) * -(-grid.nrow // k) > max_pixels:
        k += 1
    return df.where((F.col("row") % k == 0) & (F.col("col") % k == 0))


def seeded(seed: int, *cols: str) -> Column:
    """The random order of a seed, from the columns' values."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_random(df: DataFrame, n: int, bands: list[str] = (), seed: int = 1, key: str = "cell") -> DataFrame:
    """n pixels that have all of the bands (all there are, if fewer), the same for
    the same seed: those whose keys hash least."""
    for b in bands:
        df = df.where(F.col(b).isNotNull())
    return df.orderBy(seeded(seed, key), key).limit(n)


def fortify(df: DataFrame, grid: GridSpec, bands: list[str], max_pixels: int = 50_000) -> DataFrame:
    """x, y and the bands of a regular sample."""
    return sample_regular(df, grid, max_pixels).select("x", "y", *bands)
