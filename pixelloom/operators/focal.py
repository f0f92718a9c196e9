"""Neighbourhoods and resampling by arithmetic on row and col."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import band, div, lit
from ..grid import GridSpec

#: Rows and columns of a tile; terrain is computed tile by tile.
TILE = 512


def dilate(df: DataFrame, layer: str, size: int, value: float = 1.0) -> DataFrame:
    """The layer grown by a window of odd size without its four corners. Only
    marked pixels spread; the image itself is joined once."""
    if size % 2 == 0:
        raise ValueError("the window's size must be odd")
    if size == 1:
        return df
    h = size // 2
    steps = [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1) if not (abs(i) == h and abs(j) == h)]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    marked = df.where(F.col(layer).isNotNull()).select("row", "col", near)
    grown = marked.select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col")).distinct().withColumn("_grown", lit(value))
    return df.join(grown, ["row", "col"], "left").withColumn(layer, F.coalesce(F.col("_grown"), F.col(layer))).select(*df.columns)


def neighbours(df: DataFrame, layer: str, tile: int = TILE) -> DataFrame:
    """row, col, the layer and its eight neighbours n_<i>_<j>, NULL at the edges.

    Each pixel is sent to the tiles in whose halo it lies (mostly just its own),
    then windows of one shuffle by tile do the rest: up and down a column, then
    along a row over the results."""
    halo = F.array_distinct(F.flatten(F.array(*[F.array(*[F.struct(F.floor((F.col("row") + i) / lit(tile)).alias("tr"), F.floor((F.col("col") + j) / lit(tile)).alias("tc")) for j in (-1, 0, 1)]) for i in (-1, 0, 1)])))
    cells = df.select("row", "col", band(layer).alias("v"), F.explode(halo).alias("t")).select("row", "col", "v", "t.tr", "t.tc")
    cells = cells.repartition("tr", "tc")
    down = Window.partitionBy("tr", "tc", "col").orderBy("row")
    at = lambda f, w, key, step, c: F.when(f(F.col(key)).over(w) == F.col(key) + step, f(F.col(c)).over(w))
    cells = cells.withColumn("up", at(F.lag, down, "row", -1, "v")).withColumn("dn", at(F.lead, down, "row", 1, "v"))
    along = Window.partitionBy("tr", "tc", "row").orderBy("col")
    cols = [F.col("v").alias(layer)]
    for i, c in ((-1, "up"), (0, "v"), (1, "dn")):
        for j, f in ((-1, F.lag), (0, None), (1, F.lead)):
            if f is None and i == 0:
                continue
            cols.append((F.col(c) if f is None else at(f, along, "col", j, c)).alias(f"n_{i}_{j}"))
    own = (F.floor(F.col("row") / lit(tile)) == F.col("tr")) & (F.floor(F.col("col") / lit(tile)) == F.col("tc"))
    return cells.select("row", "col", "tr", "tc", *cols).where(own).drop("tr", "tc")


def terrain(dem: DataFrame, elevation: str, grid: GridSpec, tile: int = TILE) -> DataFrame:
    """row, col, slope and aspect (radians; aspect clockwise from north) from the
    eight neighbours (Horn). NULL where one is missing; aspect of flat ground is NULL."""
    n = neighbours(dem, elevation, tile)
    v = lambda i, j: F.col(f"n_{i}_{j}")
    gx = ((v(-1, 1) + v(0, 1) * 2 + v(1, 1)) - (v(-1, -1) + v(0, -1) * 2 + v(1, -1))) / lit(8 * grid.xres)
    gy = ((v(-1, -1) + v(-1, 0) * 2 + v(-1, 1)) - (v(1, -1) + v(1, 0) * 2 + v(1, 1))) / lit(8 * grid.yres)
    n = n.withColumn("gx", F.when(F.col(elevation).isNotNull(), gx)).withColumn("gy", F.when(F.col(elevation).isNotNull(), gy))
    # downhill is against the gradient
    turn = F.atan2(-F.col("gx"), -F.col("gy"))
    aspect = F.when((F.col("gx") == 0) & (F.col("gy") == 0), F.lit(None).cast("double")).when(turn < 0, turn + lit(6.283185307179586)).otherwise(turn)
    return n.select("row", "col", F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("slope"), aspect.alias("aspect"))


def coarsen(df: DataFrame, bands: list[str], factor: int, how: str = "mean") -> DataFrame:
    """row, col and the bands of blocks of factor x factor pixels."""
    f = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how]
    return df.groupBy((F.floor(F.col("row") / lit(factor))).cast("int").alias("row"), (F.floor(F.col("col") / lit(factor))).cast("int").alias("col")).agg(*[f(band(b)).alias(b) for b in bands])


def resample_nearest(fine: DataFrame, coarse: DataFrame, grid: GridSpec, bands: list[str], keep: list[str] = ("cell", "row", "col", "x", "y")) -> DataFrame:
    """The coarse image's bands at the fine image's pixels (those it covers): an
    equi-join on the coarse row and col under each fine pixel."""
    own = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *bands)
    at = fine.withColumn("_r", grid.row_of(F.col("y"))).withColumn("_c", grid.col_of(F.col("x")))
    return at.drop(*[b for b in bands if b in fine.columns]).join(own, ["_r", "_c"]).drop("_r", "_c")


def resample_bilinear(fine: DataFrame, coarse: DataFrame, grid: GridSpec, bands: list[str], keys: list[str] = ("row", "col")) -> DataFrame:
    """keys and the coarse image's bands between its pixel centres: a weighted
    sum of the four nearest; at the edges of those that there are."""
    fx = (F.col("x") - lit(grid.xmin)) / lit(grid.xres) - 0.5
    fy = (lit(grid.ymax) - F.col("y")) / lit(grid.yres) - 0.5
    # each coarse pixel gets its three neighbours beside it first, so that the fine ones are joined once
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    sent = F.explode(F.array(*[F.struct((F.col("row") - i).cast("int").alias("r"), (F.col("col") - j).cast("int").alias("c"), F.lit(k).alias("k")) for k, (i, j) in enumerate(corners)])).alias("s")
    values = coarse.select(sent, F.struct(*[band(b).alias(f"v{n}") for n, b in enumerate(bands)]).alias("v"))
    four = values.groupBy(F.col("s.r").alias("_r"), F.col("s.c").alias("_c")).agg(*[F.first(F.when(F.col("s.k") == k, F.col("v")), True).alias(f"_q{k}") for k in range(4)])
    at = fine.select(*keys, fx.alias("_fx"), fy.alias("_fy")).withColumn("_c", F.floor("_fx").cast("int")).withColumn("_r", F.floor("_fy").cast("int"))
    dx, dy = F.col("_fx") - F.col("_c"), F.col("_fy") - F.col("_r")
    w = [(dy if i else lit(1) - dy) * (dx if j else lit(1) - dx) for i, j in corners]
    both = at.join(four, ["_r", "_c"]).where(reduce(or_, [F.col(f"_q{k}").isNotNull() & (w[k] > 0) for k in range(4)]))
    part = lambda k, n, x: F.when((w[k] > 0) & F.col(f"_q{k}.v{n}").isNotNull(), x).otherwise(lit(0.0))
    return both.select(*keys, *[div(sum((part(k, n, w[k] * F.col(f"_q{k}.v{n}")) for k in range(1, 4)), part(0, n, w[0] * F.col(f"_q0.v{n}"))), sum((part(k, n, w[k]) for k in range(1, 4)), part(0, n, w[0]))).alias(b) for n, b in enumerate(bands)])


def focal(df: DataFrame, layer: str, offsets: list[tuple[int, int]], agg, name: str) -> DataFrame:
    """row, col and agg over the layer at the offsets (rows, cols) of each pixel
    that the image has. agg takes a Column and gives an aggregate."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])).alias("s")
    sent = df.select("row", "col", F.col(layer).alias("v"), step).select((F.col("row") - F.col("s.i")).alias("row"), (F.col("col") - F.col("s.j")).alias("col"), "v")
    return df.select("row", "col").join(sent.groupBy("row", "col").agg(agg(F.col("v")).alias(name)), ["row", "col"], "left")


def majority(c: Column) -> Column:
    """An aggregate for majority filters; the smallest of the most frequent values."""
    return F.mode(c, True)
