"""Points and polygons over pixel tables."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import lit
from ..grid import GridSpec, seeded

Ring = list[tuple[float, float]]


def parse_wkt(wkt: str) -> tuple[str, list[list[Ring]]]:
    """("POINT" or "POLYGON", polygons as lists of rings, outer first)."""
    kind = wkt.strip().split("(")[0].strip().upper().split()[0]
    ring = lambda s: [tuple(map(float, p.split()[:2])) for p in s.split(",")]
    if kind in ("POINT", "MULTIPOINT"):
        return "POINT", [[[p]] for s in re.findall(r"[-+\d.eE]+\s+[-+\d.eE]+", wkt) for p in ring(s)]
    if kind == "POLYGON":
        return "POLYGON", [[ring(r) for r in re.findall(r"\(([^()]+)\)", wkt)]]
    if kind == "MULTIPOLYGON":
        return "POLYGON", [[ring(r) for r in re.findall(r"\(([^()]+)\)", p)] for p in re.findall(r"\((\([^()]+\)(?:\s*,\s*\([^()]+\))*)\)", wkt[wkt.index("(") + 1 :])]
    raise ValueError(f"points and polygons only, not {kind}")


def inside(x: np.ndarray, y: np.ndarray, rings: list[Ring]) -> np.ndarray:
    """Whether points lie in a polygon with holes (an odd number of crossings)."""
    odd = np.zeros(len(x), bool)
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return odd


def area(rings: list[Ring]) -> float:
    one = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2
    return one(rings[0]) - sum(map(one, rings[1:]))


def box(polygons: list[list[Ring]]) -> tuple[float, float, float, float]:
    xs, ys = zip(*[p for rings in polygons for r in rings for p in r])
    return min(xs), max(xs), min(ys), max(ys)


def select_intersecting(features: list[dict], extent: tuple[float, float, float, float]) -> list[dict]:
    """The features (dicts with ``wkt``) whose box touches the extent; none is an error."""
    out = []
    for f in features:
        b = box(parse_wkt(f["wkt"])[1])
        if b[0] <= extent[1] and b[1] >= extent[0] and b[2] <= extent[3] and b[3] >= extent[2]:
            out.append(f)
    if not out:
        raise ValueError("no feature touches the image")
    return out


def coverage(polygons: list[list[Ring]], grid: GridSpec, sub: int = 4) -> list[tuple[int, int, float]]:
    """(row, col, share) of the pixels a polygon covers, by sub x sub points each."""
    x0, x1, y0, y1 = box(polygons)
    c0, c1 = max(0, math.floor((x0 - grid.xmin) / grid.xres)), min(grid.ncol - 1, math.floor((x1 - grid.xmin) / grid.xres))
    r0, r1 = max(0, math.floor((grid.ymax - y1) / grid.yres)), min(grid.nrow - 1, math.floor((grid.ymax - y0) / grid.yres))
    if c0 > c1 or r0 > r1:
        return []
    off = (np.arange(sub) + 0.5) / sub
    px = grid.xmin + (np.arange(c0, c1 + 1)[:, None] + off).ravel() * grid.xres
    py = grid.ymax - (np.arange(r0, r1 + 1)[:, None] + off).ravel() * grid.yres
    x, y = (a.ravel() for a in np.meshgrid(px, py))
    hit = np.zeros(len(x), bool)
    for rings in polygons:
        hit |= inside(x, y, rings)
    share = hit.reshape(r1 - r0 + 1, sub, c1 - c0 + 1, sub).mean(axis=(1, 3))
    return [(int(r0 + i), int(c0 + j), float(share[i, j])) for i, j in zip(*np.nonzero(share))]


def features_frame(img: DataFrame, features: list[dict], response: str) -> DataFrame:
    """(feature, response, wkt, box) of the features, distributed."""
    rows = []
    for i, f in enumerate(features):
        b = box(parse_wkt(f["wkt"])[1])
        rows.append((i, str(f[response]) if f[response] is not None else None, f["wkt"], *b))
    return img.sparkSession.createDataFrame(rows, "feature int, response string, wkt string, x0 double, x1 double, y0 double, y1 double")


def covered_pixels(img: DataFrame, features: list[dict], response: str, grid: GridSpec, full: bool = True) -> DataFrame:
    """(feature, response, row, col) of the pixels under each feature: those a
    polygon covers wholly (``full``) or at their centre, and a point's own. The
    features are rasterised in parallel; the image is not touched."""
    df = features_frame(img, features, response).select("feature", "response", "wkt")

    def cells(frames):
        for pdf in frames:
            out = []
            for f, r, wkt in pdf.itertuples(index=False):
                kind, polygons = parse_wkt(wkt)
                if kind == "POINT":
                    for [[(x, y)]] in polygons:
                        i, j = math.floor((grid.ymax - y) / grid.yres), math.floor((x - grid.xmin) / grid.xres)
                        if 0 <= i < grid.nrow and 0 <= j < grid.ncol:
                            out.append((f, r, i, j))
                else:
                    found = coverage(polygons, grid, 4 if full else 1)
                    out += [(f, r, i, j) for i, j, s in found if s >= 1 or not full]
            yield pd.DataFrame(out, columns=["feature", "response", "row", "col"])

    return df.mapInPandas(cells, "feature int, response string, row int, col int")


def sample_pixels(img: DataFrame, features: list[dict], response: str, bands: list[str], grid: GridSpec, n: int = 1000, seed: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """(row, col, feature, response, bands): up to n pixels of each class, spread
    over its polygons by their area; all of them for points. Pixels that lack a
    band or lie in ``exclude`` are left out; a pixel under several features counts
    for the first."""
    kinds = {parse_wkt(f["wkt"])[0] for f in features}
    if len(kinds) > 1:
        raise ValueError("points and polygons can't be mixed")
    under = covered_pixels(img, features, response, grid)
    under = under.groupBy("row", "col").agg(F.min_by(F.struct("feature", "response"), "feature").alias("f")).select("row", "col", "f.feature", "f.response")
    if exclude is not None:
        under = under.join(exclude.select("row", "col"), ["row", "col"], "left_anti")
    px = img.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands]).na.drop(subset=list(bands)).join(under, ["row", "col"])
    if kinds == {"POLYGON"}:
        areas: dict[str, dict[int, float]] = {}
        for i, f in enumerate(features):
            areas.setdefault(str(f[response]), {})[i] = sum(area(r) for r in parse_wkt(f["wkt"])[1])
        share = [(i, math.ceil(n * a / (sum(s.values()) or 1))) for s in areas.values() for i, a in s.items()]
        limits = F.broadcast(img.sparkSession.createDataFrame(share, "feature int, most int"))
        w = Window.partitionBy("feature").orderBy(seeded(seed, "row", "col"), "row", "col")
        px = px.join(limits, "feature").withColumn("_k", F.row_number().over(w)).where("_k <= most").drop("_k", "most")
    return px.select("row", "col", "feature", "response", *bands)


def away_from(samples: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    """Samples (row, col) farther than ``distance`` pixels from all others. Others
    are sent to grid squares of that size, so it is an equi-join with a filter."""
    d = max(1, math.ceil(distance))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    o = others.select(F.col("row").alias("r2"), F.col("col").alias("c2"), near).select("r2", "c2", (F.floor(F.col("r2") / lit(d)) + F.col("s.i")).alias("gr"), (F.floor(F.col("c2") / lit(d)) + F.col("s.j")).alias("gc"))
    s = samples.withColumn("gr", F.floor(F.col("row") / lit(d))).withColumn("gc", F.floor(F.col("col") / lit(d)))
    dr, dc = F.col("row") - F.col("r2"), F.col("col") - F.col("c2")
    return s.join(o, (s["gr"] == o["gr"]) & (s["gc"] == o["gc"]) & (dr * dr + dc * dc <= lit(distance * distance)), "left_anti").drop("gr", "gc")
