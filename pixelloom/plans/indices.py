"""Queries of spectral indices."""

from pyspark.sql import functions as F

from ..functions import indices as ix
from .registry import query
from .views import LI, VEG, li_pixels, r, rounded, veg_pixels

FOUR = {"blue": "blue", "green": "green", "red": "red", "nir": "nir"}
TEN = {b: b for b in ix.BANDS}
_N = "((nir - red) / nullif(nir + red, 0))"
_ETA = "((2 * (nir * nir - red * red) + 1.5 * nir + 0.5 * red) / nullif(nir + red + 0.5, 0))"
_in = lambda e, lo=-1, hi=1: f"CASE WHEN ({e}) BETWEEN {lo} AND {hi} THEN {e} END"
_root = lambda e: f"CASE WHEN ({e}) >= 0 THEN sqrt(greatest({e}, 0)) END"
#: Each formula written anew in SQL.
SQL = {
    "CLG": "redEdge3 / nullif(green, 0) - 1",
    "CLRE": "redEdge3 / nullif(redEdge1, 0) - 1",
    "CTVI": f"({_N} + 0.5) / nullif(sqrt(abs({_N} + 0.5)), 0)",
    "DVI": "nir - red",
    "EVI": _in("2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)"),
    "EVI2": _in("2.5 * (nir - red) / nullif(nir + 2.4 * red, 0)"),
    "GEMI": f"{_ETA} * (1 - 0.25 * {_ETA}) - (red - 0.125) / nullif(1 - red, 0)",
    "GNDVI": _in("(nir - green) / nullif(nir + green, 0)"),
    "KNDVI": _in(f"tanh({_N} * {_N})", 0, 1),
    "MCARI": "(green - red) * (redEdge1 / nullif(red, 0))",
    "MNDWI": _in("(green - swir2) / nullif(green + swir2, 0)"),
    "MSAVI": f"nir + 0.5 - 0.5 * ({_root('(2 * nir + 1) * (2 * nir + 1) - 8 * (nir - 2 * red)')})",
    "MSAVI2": f"(2 * nir + 1 - ({_root('(2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red)')})) / 2",
    "MTCI": "(redEdge2 - redEdge1) / nullif(redEdge1 - red, 0)",
    "NBRI": _in("(nir - swir3) / nullif(nir + swir3, 0)"),
    "NDREI1": _in("(redEdge2 - redEdge1) / nullif(redEdge2 + redEdge1, 0)"),
    "NDREI2": _in("(redEdge3 - redEdge1) / nullif(redEdge3 + redEdge1, 0)"),
    "NDVI": _in(_N),
    "NDVIC": _in(f"{_N} * (1 - (swir2 - 0.06) / (0.2 - 0.06))"),
    "NDWI": _in("(green - nir) / nullif(green + nir, 0)"),
    "NDWI2": _in("(nir - swir2) / nullif(nir + swir2, 0)"),
    "NRVI": "(red / nullif(nir, 0) - 1) / nullif(red / nullif(nir, 0) + 1, 0)",
    "REIP": "0.705 + 0.35 * (((red + redEdge3) / nullif(2 - redEdge1, 0)) / nullif(redEdge2 - redEdge1, 0))",
    "RVI": "red / nullif(nir, 0)",
    "SATVI": "(swir2 - red) / nullif(swir2 + red + 0.5, 0) * 1.5 - swir3 / 2",
    "SAVI": "(nir - red) * 1.5 / nullif(nir + red + 0.5, 0)",
    "SLAVI": "nir / nullif(red + swir2, 0)",
    "SR": "nir / nullif(red, 0)",
    "TTVI": f"sqrt(abs({_N} + 0.5))",
    "TVI": f"CASE WHEN {_N} + 0.5 >= 0 AND sqrt(greatest({_N} + 0.5, 0)) <= sqrt(1.5) THEN sqrt(greatest({_N} + 0.5, 0)) END",
    "WDVI": "nir - red",
}
COEFFICIENTS = {"swir2ccc": 0.06, "swir2coc": 0.2}
LI_INDICES = [i for i, x in ix.REGISTRY.items() if set(x.bands) <= set(FOUR)]


def _one(name: str):
    def run(spark, sf_dir):
        out = ix.spectral_indices(veg_pixels(spark, sf_dir), TEN, [name], ["vec_id"], coefficients=COEFFICIENTS)
        return rounded(out, [name])

    query(f"idx_{name.lower()}", f"SELECT vec_id, {r(SQL[name], name)} FROM {VEG}")(run)


for _name in ix.REGISTRY:
    _one(_name)


@query("idx_family", f"SELECT l_orderkey, l_linenumber, {', '.join(r(SQL[i], i, 5) for i in LI_INDICES)} FROM {LI}")
def idx_family(spark, sf_dir):
    """All indices that four bands allow, over the large table, in one projection."""
    return rounded(ix.spectral_indices(li_pixels(spark, sf_dir), FOUR, None, ["l_orderkey", "l_linenumber"]), LI_INDICES, 5)


@query("idx_flag_means", f"SELECT l_returnflag, {r('avg(' + SQL['NDVI'] + ')', 'ndvi')}, {r('avg(' + SQL['SAVI'] + ')', 'savi')} FROM (SELECT l_returnflag, l_tax * 12.5 AS red, l_extendedprice / 105000 AS nir FROM lineitem) GROUP BY l_returnflag")
def idx_flag_means(spark, sf_dir):
    """Mean indices by stratum: the projection and a partial aggregation in one stage."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", (F.col("l_tax") * 12.5).alias("red"), (F.col("l_extendedprice") / 105000).alias("nir"))
    v = ix.spectral_indices(li, {"red": "red", "nir": "nir"}, ["NDVI", "SAVI"], ["l_returnflag"])
    return rounded(v.groupBy("l_returnflag").agg(F.avg("NDVI").alias("ndvi"), F.avg("SAVI").alias("savi")), ["ndvi", "savi"])


@query("idx_masked", f"SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_linenumber IS DISTINCT FROM 1 THEN ' + SQL['NDVI'] + ' END', 'NDVI')} FROM {LI}")
def idx_masked(spark, sf_dir):
    return rounded(ix.spectral_indices(li_pixels(spark, sf_dir), FOUR, ["NDVI"], ["l_orderkey", "l_linenumber"], mask=F.col("l_linenumber"), mask_value=1), ["NDVI"])


@query("idx_scaled", f"SELECT l_orderkey, l_linenumber, {r(SQL['SAVI'], 'SAVI')} FROM (SELECT l_orderkey, l_linenumber, red / 4 AS red, nir / 4 AS nir FROM {LI})")
def idx_scaled(spark, sf_dir):
    return rounded(ix.spectral_indices(li_pixels(spark, sf_dir), FOUR, ["SAVI"], ["l_orderkey", "l_linenumber"], scale=4), ["SAVI"])


@query("idx_custom", f"SELECT l_orderkey, l_linenumber, {r('(green - 2 * (red + 0.5)) / nullif(blue, 0)', 'MINE')} FROM {LI}")
def idx_custom(spark, sf_dir):
    ix.register("MINE", "(green - 2 * (red + .5)) / blue")
    try:
        return rounded(ix.spectral_indices(li_pixels(spark, sf_dir), FOUR, ["MINE"], ["l_orderkey", "l_linenumber"]), ["MINE"])
    finally:
        ix.unregister("MINE")


_PUB = {"EVI2": _in("2.5 * (nir - red) / nullif(nir + 2.4 * red + 1, 0)"), "KNDVI": _in(f"pow(tanh({_N}), 2)", 0, 1), "MSAVI2": f"(2 * (nir + 1) - ({_root('pow(2 * nir + 1, 2) - 8 * (nir - red)')})) / 2"}


@query("idx_published", f"SELECT vec_id, {', '.join(r(e, n) for n, e in _PUB.items())} FROM {VEG}")
def idx_published(spark, sf_dir):
    return rounded(ix.spectral_indices(veg_pixels(spark, sf_dir), TEN, list(_PUB), ["vec_id"], published=True), list(_PUB))
