"""Queries of radiometric and topographic correction."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import focal, radiometry, topography
from ..sources.metadata import ImageMetaData
from .registry import query
from .views import PART, part_grid, part_pixels, r, read, rounded

META = ImageMetaData(
    satellite="LANDSAT_5", sensor="TM", acquired=datetime(2010, 8, 1, tzinfo=timezone.utc), sun_azimuth=50.0, sun_elevation=41.7, sun_distance=1.0149567, bits=8,
    calrad={"B1_dn": (0.765827, -2.28583), "B3_dn": (1.043976, -2.21398), "B6_dn": (0.055375, 1.18243)}, calbt={"B6_dn": (607.76, 1260.56)},
)
_KEYS = ["l_orderkey", "l_linenumber"]
_COS = "cos(radians(90 - 41.7))"
_DIST = "(pi() * pow(1.0149567, 2))"


def scene(spark, sf_dir):
    """lineitem as digital numbers."""
    return read(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_quantity").alias("B1_dn"), (F.col("l_quantity") + F.col("l_linenumber")).alias("B3_dn"), (F.col("l_extendedprice") / 500 + 40).alias("B6_dn"))


_SCENE = '(SELECT l_orderkey, l_linenumber, l_quantity AS b1, l_quantity + l_linenumber AS b3, l_extendedprice / 500 + 40 AS b6 FROM lineitem)'


def _unit(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


_L1, _L3, _L6 = "(b1 * 0.765827 + -2.28583)", "(b3 * 1.043976 + -2.21398)", "(b6 * 0.055375 + 1.18243)"
_BT = f"1260.56 / ln(607.76 / {_L6} + 1)"


@query("rad_radiance", f"SELECT l_orderkey, l_linenumber, {r(f'greatest({_L1}, 0.0)', 'B1_tra', 4)}, {r(f'greatest({_L3}, 0.0)', 'B3_tra', 4)}, {r(f'greatest({_L6}, 0.0)', 'B6_tra', 4)} FROM {_SCENE}")
def rad_radiance(spark, sf_dir):
    return rounded(radiometry.rad_cor(scene(spark, sf_dir), META, "rad", keys=_KEYS), ["B1_tra", "B3_tra", "B6_tra"], 4)


@query("rad_apparent", f"SELECT l_orderkey, l_linenumber, {r(_unit(f'{_DIST} * {_L1} / (1958 * {_COS})'), 'B1_tre')}, {r(_unit(f'{_DIST} * {_L3} / (1551 * {_COS})'), 'B3_tre')}, {r(_BT, 'B6_bt', 4)} FROM {_SCENE}")
def rad_apparent(spark, sf_dir):
    out = radiometry.rad_cor(scene(spark, sf_dir), META, "apref", keys=_KEYS)
    return rounded(rounded(out, ["B1_tre", "B3_tre"]), ["B6_bt"], 4)


_DARK = lambda e: f"0.01 * {e} * {_COS} / {_DIST}"


@query("rad_sdos", f"""SELECT l_orderkey, l_linenumber, {r(_unit(f'{_DIST} * ({_L1} - greatest(8 * 0.765827 - 2.28583 - {_DARK(1958)}, 0)) / (1958 * {_COS})'), 'B1_sre')},
  {r(_unit(f'{_DIST} * ({_L3} - greatest(5 * 1.043976 - 2.21398 - {_DARK(1551)}, 0)) / (1551 * {_COS})'), 'B3_sre')} FROM {_SCENE}""")
def rad_sdos(spark, sf_dir):
    return rounded(radiometry.rad_cor(scene(spark, sf_dir), META, "sdos", keys=_KEYS, haze_values={"B1_dn": 8, "B3_dn": 5}).drop("B6_bt"), ["B1_sre", "B3_sre"])


def _dos_sql(tau_z: str, tau_v: str, exponent: int = -2) -> str:
    over = f"(8 * 0.765827 - 2.28583 - 0.01 * 1958 * {_COS} * {tau_z} * {tau_v} / {_DIST})"
    bands = []
    for n, e, esun, g, o, w in (("B1_sre", _L1, 1958, 0.765827, -2.28583, 0.485), ("B3_sre", _L3, 1551, 1.043976, -2.21398, 0.66)):
        haze = f"greatest({over} * pow({w} / 0.485, {exponent}) * ({g} / 0.765827) + {o}, 0)"
        bands.append(r(_unit(f"{_DIST} * ({e} - {haze}) / ({tau_v} * {esun} * {_COS} * {tau_z})"), n))
    return f"SELECT l_orderkey, l_linenumber, {', '.join(bands)} FROM {_SCENE}"


@query("rad_dos", _dos_sql("1", "1"))
def rad_dos(spark, sf_dir):
    return rounded(radiometry.rad_cor(scene(spark, sf_dir), META, "dos", keys=_KEYS, haze_values={"B1_dn": 8}, atmosphere="clear").drop("B6_bt"), ["B1_sre", "B3_sre"])


@query("rad_dos_auto", _dos_sql("1", "1", -4))
def rad_dos_auto(spark, sf_dir):
    """The kind of atmosphere follows from the haze."""
    return rounded(radiometry.rad_cor(scene(spark, sf_dir), META, "dos", keys=_KEYS, haze_values={"B1_dn": 8}).drop("B6_bt"), ["B1_sre", "B3_sre"])


@query("rad_costz", _dos_sql(_COS, "cos(radians(1))"))
def rad_costz(spark, sf_dir):
    return rounded(radiometry.rad_cor(scene(spark, sf_dir), META, "costz", keys=_KEYS, haze_values={"B1_dn": 8}, atmosphere="clear").drop("B6_bt"), ["B1_sre", "B3_sre"])


@query("haze_table", "SELECT 'l_quantity' AS band, l_quantity AS value, count(*)::BIGINT AS freq FROM lineitem WHERE l_quantity > 0 GROUP BY l_quantity")
def haze_table(spark, sf_dir):
    return radiometry.haze_tables(read(spark, sf_dir, "lineitem"), ["l_quantity"])


_HAZE = """WITH f AS (SELECT p_size::DOUBLE AS v, count(*) AS n FROM part WHERE p_size > 0 GROUP BY 1),
p AS (SELECT v, n / sum(n) OVER () AS p, row_number() OVER (ORDER BY v) AS rn, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS cum FROM f),
i AS (SELECT coalesce(max(rn) FILTER (WHERE cum < 0.5), 1) AS idx FROM p),
h AS (SELECT idx, idx // 20 AS h FROM i),
s AS (SELECT p.v, p.rn, (SELECT avg(q.p) FROM p q WHERE q.rn BETWEEN p.rn - h AND p.rn + h) AS sm, idx, h FROM p, h WHERE p.rn <= idx),
d AS (SELECT s.rn, t.sm - s.sm AS d, s.idx FROM s JOIN s t ON t.rn = s.rn + 2 WHERE s.rn - s.h >= 1 AND t.rn + s.h <= s.idx),
b AS (SELECT rn FROM d ORDER BY round(d, 12) DESC, rn LIMIT 1)
SELECT (SELECT v FROM p WHERE rn = idx) AS plain, (SELECT v FROM p WHERE rn = least(coalesce((SELECT rn FROM b) + 1, idx), idx)) AS steep FROM i"""


@query("haze_value", _HAZE)
def haze_value(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    tables = radiometry.haze_tables(part, ["p_size"])
    get = lambda steep: float(radiometry.estimate_haze(part, ["p_size"], 0.5, steep, tables)["p_size"])
    return spark.createDataFrame([(get(False), get(True))], "plain double, steep double")


_TERRAIN = f"""WITH p AS (SELECT cell, row, col, price AS val, size AS z FROM {PART}),
n AS (SELECT p.cell, p.row, p.col, p.val, p.z, {', '.join(f"max(q.z) FILTER (WHERE q.row = p.row + {i} AND q.col = p.col + {j}) AS z{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)}, count(*) AS k
  FROM p JOIN p q ON q.row BETWEEN p.row - 1 AND p.row + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY ALL),
g AS (SELECT *, CASE WHEN k = 9 THEN (z02 + 2 * z12 + z22 - z00 - 2 * z10 - z20) / 8 END AS gx, CASE WHEN k = 9 THEN (z00 + 2 * z01 + z02 - z20 - 2 * z21 - z22) / 8 END AS gy FROM n),
t AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS slope, CASE WHEN gx = 0 AND gy = 0 THEN NULL WHEN atan2(-gx, -gy) < 0 THEN atan2(-gx, -gy) + 2 * pi() ELSE atan2(-gx, -gy) END AS aspect FROM g),
u AS (SELECT *, cos(0.8) * cos(slope) + sin(0.8) * sin(slope) * coalesce(cos(1.2 - aspect), 0) AS illu FROM t)"""
SOLAR = (1.2, 0.8)


@query("topo_slope", f"{_TERRAIN} SELECT cell, {r('slope', 'slope')}, {r('aspect', 'aspect')} FROM t")
def topo_slope(spark, sf_dir):
    img = part_pixels(spark, sf_dir)
    t = focal.terrain(img, "size", part_grid(spark, sf_dir), tile=16)
    return rounded(img.select("row", "col", "cell").join(t, ["row", "col"]).select("cell", "slope", "aspect"), ["slope", "aspect"])


def _top_cor(spark, sf_dir, method, **more):
    img = part_pixels(spark, sf_dir)
    # aspect is NULL on flat ground and slope is 0 there
    dem = focal.terrain(img, "size", part_grid(spark, sf_dir))
    band = ["illu"] if method == "illu" else ["price"]
    return rounded(topography.top_cor(img, dem, ["price"], SOLAR, method, keys=["cell"], **more), band, 3 if method != "illu" else 4)


_FIT = "FILTER (WHERE slope > radians(2) AND illu >= 0)"
_K = "greatest(0, least(1, regr_slope(ln(greatest(val, 1e-32)), ln(greatest(illu / cos(0.8), 1e-32)))))"


@query("topo_illu", f"{_TERRAIN} SELECT cell, {r('illu', 'illu', 4)} FROM u")
def topo_illu(spark, sf_dir):
    return _top_cor(spark, sf_dir, "illu")


@query("topo_cos", f"{_TERRAIN} SELECT cell, {r('val * (cos(0.8) / nullif(illu, 0))', 'price', 3)} FROM u")
def topo_cos(spark, sf_dir):
    return _top_cor(spark, sf_dir, "cos")


@query("topo_avgcos", f"{_TERRAIN} SELECT cell, {r('val + val * (m - illu) / m', 'price', 3)} FROM u, (SELECT avg(illu) AS m FROM u)")
def topo_avgcos(spark, sf_dir):
    return _top_cor(spark, sf_dir, "avgcos")


@query("topo_stat", f"{_TERRAIN} SELECT cell, {r('val - illu * kk', 'price', 3)} FROM u, (SELECT regr_slope(val, illu) AS kk FROM u)")
def topo_stat(spark, sf_dir):
    return _top_cor(spark, sf_dir, "stat")


@query("topo_c", f"{_TERRAIN} SELECT cell, {r('val * (cos(0.8) + c) / nullif(illu + c, 0)', 'price', 3)} FROM u, (SELECT regr_intercept(val, illu) {_FIT} / regr_slope(val, illu) {_FIT} AS c FROM u)")
def topo_c(spark, sf_dir):
    return _top_cor(spark, sf_dir, "C")


@query("topo_minnaert", f"{_TERRAIN} SELECT cell, {r('CASE WHEN illu > 0 OR kk = 0 THEN val * (cos(0.8) / pow(illu, kk)) END', 'price', 3)} FROM u, (SELECT {_K} AS kk FROM u WHERE slope > radians(2) AND illu >= 0)")
def topo_minnaert(spark, sf_dir):
    return _top_cor(spark, sf_dir, "minnaert")
