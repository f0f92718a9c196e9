"""Operators against goldens, closed forms and independent calculations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import grid, options
from pixelloom.functions import expr, indices, stats
from pixelloom.grid import GridSpec
from pixelloom.operators import classify, clouds, display, focal, match, qa, radiometry, register, topography, transform, unmix, vector
from pixelloom.sources.metadata import ImageMetaData


def image(spark, ncol, nrow, **bands):
    """Pixels of a grid; a band is a function of (row, col)."""
    rows = [(i * ncol + j + 1, i, j, j + 0.5, -(i + 0.5), *[None if (v := f(i, j)) is None else float(v) for f in bands.values()]) for i in range(nrow) for j in range(ncol)]
    return spark.createDataFrame(rows, "cell long, row int, col int, x double, y double, " + ", ".join(f"{b} double" for b in bands))


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(p in plan for p in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))


# expressions and grids


def test_expr(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (float("nan"), 1.0), (-4.0, 2.0)], "a double, b double")
    got = df.select(expr.div(F.col("a"), F.col("b")).alias("d"), expr.no_nan(F.col("a")).alias("n"), expr.sqrt(F.col("a")).alias("s"), expr.clamp(F.col("a"), 0, 1).alias("c"), expr.within(F.col("a"), -1, 1).alias("w")).collect()
    assert [r.d for r in got][:2] == [None, None] and got[3].d == -2
    assert [r.n for r in got] == [1, None, None, -4]
    assert [got[0].s, got[3].s] == [1, None] and [got[0].c, got[1].c, got[3].c] == [1, None, 0] and [got[0].w, got[3].w] == [1, None]


def test_grid(spark):
    g = GridSpec(4, 3, 10, 50, 2, 5)
    assert g.extent == (10, 18, 35, 50) and grid.centre(g.extent) == (14, 42.5)
    assert grid.overlap((0, 10, 0, 10), (5, 20, -5, 5)) == (5, 10, 0, 5) and grid.overlap((0, 1, 0, 1), (2, 3, 0, 1)) is None
    df = grid.from_cells(spark.range(1, 13).toDF("cell"), g)
    back = df.select("cell", g.cell(g.row_of(F.col("y")), g.col_of(F.col("x"))).alias("again")).collect()
    assert all(r.cell == r.again for r in back)
    assert grid.sample_regular(df, g, 4).count() == 4
    a = [r.cell for r in grid.sample_random(df, 5).collect()]
    assert len(a) == 5 and a == [r.cell for r in grid.sample_random(df, 5).collect()]
    assert grid.ingest(df.withColumn("v", F.lit(float("nan"))), ["v"]).where("v IS NULL").count() == 12


# indices

VALUES = (-1.0, 0.0, 0.5, 1.0, 2.0, None)


def closed(name, b):
    """Each index in plain Python; None where anything is missing or undefined."""
    L, G, C1, C2, s = 0.5, 2.5, 6.0, 7.5, 1.0
    blue, green, red, nir, e1, e2, e3, s2, s3 = (b[k] for k in ("blue", "green", "red", "nir", "redEdge1", "redEdge2", "redEdge3", "swir2", "swir3"))
    n = lambda: (nir - red) / (nir + red)
    eta = lambda: (2 * (nir**2 - red**2) + 1.5 * nir + 0.5 * red) / (nir + red + 0.5)
    f = {
        "CLG": lambda: e3 / green - 1, "CLRE": lambda: e3 / e1 - 1, "CTVI": lambda: (n() + 0.5) / math.sqrt(abs(n() + 0.5)), "DVI": lambda: s * nir - red,
        "EVI": lambda: G * (nir - red) / (nir + C1 * red - C2 * blue + 1), "EVI2": lambda: G * (nir - red) / (nir + 2.4 * red), "GEMI": lambda: eta() * (1 - eta() * 0.25) - (red - 0.125) / (1 - red),
        "GNDVI": lambda: (nir - green) / (nir + green), "KNDVI": lambda: math.tanh(n() ** 2), "MCARI": lambda: (green - red) * (e1 / red), "MNDWI": lambda: (green - s2) / (green + s2),
        "MSAVI": lambda: nir + 0.5 - 0.5 * math.sqrt((2 * nir + 1) ** 2 - 8 * (nir - 2 * red)), "MSAVI2": lambda: (2 * nir + 1 - math.sqrt((2 * nir + 1) ** 2 - 8 * (nir - red))) / 2,
        "MTCI": lambda: (e2 - e1) / (e1 - red), "NBRI": lambda: (nir - s3) / (nir + s3), "NDREI1": lambda: (e2 - e1) / (e2 + e1), "NDREI2": lambda: (e3 - e1) / (e3 + e1), "NDVI": n,
        "NDVIC": lambda: n() * (1 - (s2 - 0.1) / (0.3 - 0.1)), "NDWI": lambda: (green - nir) / (green + nir), "NDWI2": lambda: (nir - s2) / (nir + s2), "NRVI": lambda: (red / nir - 1) / (red / nir + 1),
        "REIP": lambda: 0.705 + 0.35 * ((red + e3) / (2 - e1)) / (e2 - e1), "RVI": lambda: red / nir, "SATVI": lambda: (s2 - red) / (s2 + red + L) * (1 + L) - s3 / 2,
        "SAVI": lambda: (nir - red) * (1 + L) / (nir + red + L), "SLAVI": lambda: nir / (red + s2), "SR": lambda: nir / red, "TTVI": lambda: math.sqrt(abs(n() + 0.5)), "TVI": lambda: math.sqrt(n() + 0.5), "WDVI": lambda: nir - s * red,
    }[name]
    try:
        v = f()
    except (TypeError, ZeroDivisionError, ValueError):
        return None
    lo, hi = {"KNDVI": (0, 1), "TVI": (-9e9, math.sqrt(1.5))}.get(name, (-1, 1) if name in ("EVI", "EVI2", "GNDVI", "MNDWI", "NBRI", "NDREI1", "NDREI2", "NDVI", "NDVIC", "NDWI", "NDWI2") else (-9e9, 9e9))
    return v if lo <= v <= hi else None


def test_all_indices(spark):
    random.seed(0)
    names = ("blue", "green", "red", "nir", "redEdge1", "redEdge2", "redEdge3", "swir1", "swir2", "swir3")
    rows = [tuple(random.choice(VALUES) for _ in names) for _ in range(150)] + [tuple(random.random() for _ in names) for _ in range(30)]
    rows += [tuple(a if k == "red" else b if k == "nir" else 0.3 for k in names) for a in VALUES for b in VALUES]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))
    out = indices.spectral_indices(df, {n: n for n in names}, keys=["id"], coefficients={"swir2ccc": 0.1, "swir2coc": 0.3})
    assert len(indices.REGISTRY) == 31 and set(out.columns) == {"id", *indices.REGISTRY} and no_python(out)
    for r in out.collect():
        b = dict(zip(names, rows[r.id]))
        for n in indices.REGISTRY:
            want = closed(n, b)
            assert (r[n] is None and want is None) or r[n] == pytest.approx(want, rel=1e-9, abs=1e-9), (n, b)


def test_index_arguments(spark):
    df = image(spark, 3, 1, red=lambda i, j: [10, 20, 0][j], nir=lambda i, j: [30, 20, 5][j], m=lambda i, j: [1, 10, None][j])
    b = {"red": "red", "nir": "nir"}
    with pytest.warns(UserWarning):
        assert indices.spectral_indices(df, b, ["NDVI", "GNDVI"], ["cell"]).columns == ["cell", "NDVI"]
    with pytest.warns(UserWarning):
        indices.spectral_indices(df, b, ["NDVI"], coefficients={"Q": 1})
    with pytest.warns(UserWarning):
        assert "EVI2" not in indices.spectral_indices(df, b, ["NDVI", "EVI2"], check_reflectance=True).columns
    for bad in (["LSWI"], ["XX"]):
        with pytest.raises(ValueError):
            indices.spectral_indices(df, b, bad)
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        indices.spectral_indices(df, b, ["GNDVI"])
    with pytest.raises(ValueError):
        indices.spectral_indices(df, b | {"swir2": "m"}, ["NDVIC"], coefficients={"swir2ccc": 0.5, "swir2coc": 0.3})
    get = lambda **k: [r.NDVI for r in indices.spectral_indices(df, b, ["ndvi"], ["cell"], **k).orderBy("cell").collect()]
    assert get(mask=F.col("m"), mask_value=10) == [0.5, None, 1] and get(mask=F.col("m"), mask_value=None) == [0.5, 0, None] and get(scale=10) == [0.5, 0, 1]
    assert [r.SR for r in indices.spectral_indices(df, b, ["SR"], ["cell"], keep_inf=True).orderBy("cell").collect()][2] == float("inf")


def test_custom_formulas(spark):
    df = image(spark, 2, 1, red=lambda i, j: 2 + j, nir=lambda i, j: [3, 0][j])
    indices.register("mine", "(red - 1) * 2.5 / nir + .5")
    indices.register("other", lambda red, nir: red * nir)
    try:
        got = indices.spectral_indices(df, {"red": "red", "nir": "nir"}, ["MINE", "other"]).collect()
        assert got[0].MINE == pytest.approx(2.5 / 3 + 0.5) and got[1].MINE is None and [r.OTHER for r in got] == [6, 0]
    finally:
        indices.unregister("mine"), indices.unregister("other")
    for bad in ("red +", "red ^ 2", "-red", "(red", "red nir", "log(red)", ""):
        with pytest.raises(ValueError):
            indices.parse(bad)
    make, used = indices.parse("1 - 2 - 3 + 8 / 2 / 2")
    assert used == () and spark.range(1).select(make({})).first()[0] == -2


def test_options(capsys):
    with options.options(verbose=True, idxdb={"q": "red / nir"}):
        options.say("hello")
        assert list(indices.CUSTOM) == ["Q"]
    options.say("no more")
    assert capsys.readouterr().err == "hello\n" and not indices.CUSTOM


# radiometry


def test_gain_offset(spark):
    df = image(spark, 4, 1, a=lambda i, j: [None, -100, 100, 0][j], b=lambda i, j: 2)
    get = lambda c, *a: [r[0] for r in df.orderBy("cell").select(radiometry.gain_offset(F.col(c), *a)).collect()]
    assert get("a", 0.1, 0.1) == pytest.approx([None, -9.9, 10.1, 0.1])
    assert get("a", 0.1, 0.1, 0.0) == pytest.approx([None, 0, 10.1, 0.1]) and get("a", 0.1, 0.1, 0.0, 1.0) == pytest.approx([None, 0, 1, 0.1]) and get("a", 0.1, 0.1, None, 1.0) == pytest.approx([None, -9.9, 1, 0.1])
    assert get("b", 0.2, 0.4) == pytest.approx([0.8] * 4)


def test_haze_goldens(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 21) for _ in range(v * v)] + [(0.0,), (None,)], "v double")
    assert radiometry.estimate_haze(df, ["v"], 0.02, max_slope=False) == {"v": 5}
    assert radiometry.estimate_haze(df, ["v"], 0.02) == {"v": 4}
    assert radiometry.estimate_haze(df, ["v"], 0.02, tables=radiometry.haze_tables(df, ["v"])) == {"v": 4}
    with pytest.warns(UserWarning):
        assert radiometry.estimate_haze(df.where("v = 0"), ["v"]) == {}


META = ImageMetaData(satellite="LANDSAT_5", sensor="TM", sun_elevation=60.0, sun_azimuth=120.0, sun_distance=1.0, bits=8, calrad={f"B{i}_dn": (0.5, 1.0) for i in range(1, 8)}, calbt={"B6_dn": (607.76, 1260.56)})


@pytest.mark.parametrize("method", radiometry.METHODS)
def test_rad_cor(spark, method):
    df = image(spark, 10, 2, **{f"B{b}_dn": lambda i, j, b=b: 20 + b + i * 10 + j for b in (1, 3, 6)})
    out = radiometry.rad_cor(df, META, method, keys=["cell"], haze_bands=["B1_dn"], atmosphere="clear")
    suffix = {"rad": "tra", "apref": "tre"}.get(method, "sre")
    assert out.columns == ["cell", f"B1_{suffix}", f"B3_{suffix}", "B6_tra" if method == "rad" else "B6_bt"] and no_python(out)
    r = out.where("cell = 1").first()
    cos_z = math.cos(math.radians(30))
    if method == "rad":
        assert r.B1_tra == 11.5
    if method == "apref":
        assert r.B1_tre == pytest.approx(math.pi * 11.5 / (1958 * cos_z)) and r.B6_bt == pytest.approx(1260.56 / math.log(607.76 / 14 + 1))
    if method == "sdos":
        haze = max(21 * 0.5 + 1 - 0.01 * 1958 * cos_z / math.pi, 0)
        assert r.B1_sre == pytest.approx(math.pi * (11.5 - haze) / (1958 * cos_z))
    with pytest.raises(ValueError):
        radiometry.rad_cor(df, META, "nope")


def test_haze_weights_and_sensors():
    t = radiometry.sensor_table("LANDSAT_5", "TM")
    w = radiometry.haze_weights(t, "B1", "clear")
    assert w["B1"] == 1 and w["B3"] == pytest.approx((0.66 / 0.485) ** -2) and "B6" not in w
    assert radiometry.sensor_table("LANDSAT_7", "ETM+")["B8"][2] == "pan"
    with pytest.raises(ValueError):
        radiometry.sensor_table("LANDSAT_5", "XX")


# quality words


def test_encode_goldens():
    e = qa.encode
    assert e("OLI", cloud="na", cloudShadow="na", snow="na", cirrus="na", cloudMask="no") == [0]
    low = {k: "low" for k in ("cloud", "cloudShadow", "snow", "cirrus")}
    assert e("OLI", cloudMask="no", **low) == [2720]
    assert e("OLI", cloudMask="no", fill="yes", cloud="na", cloudShadow="na", snow="na", cirrus="na") == [1]
    assert e("OLI", cloudMask="no", terrainOcclusion="yes", cloud="na", cloudShadow="na", snow="na", cirrus="na") == [2]
    assert e("TM", cloud="low", cloudShadow="low", snow="low", cloudMask="no") == [672] and e("MSS", cloud="high", cloudMask="yes") == [112]
    assert [e("MSS", cloud="high", cloudMask="yes", radSaturation=s)[0] for s in ("low", "med", "high")] == [116, 120, 124]
    assert e("OLI", "pre_collection", cirrus="high", cloud="high", snow="na", water="na") == [61440] and e("OLI", "pre_collection", cirrus="high", cloud="high", snow="high", water="na") == [64512]
    assert e("OLI", "pre_collection", droppedFrame="yes", cirrus="na", cloud="na", snow="na", water="na") == [2]
    for bad in ({"cloud": "maybe"}, {"nope": "yes"}):
        with pytest.raises(ValueError):
            e("OLI", **bad)
    with pytest.raises(ValueError):
        qa.layout("TM", "pre_collection")


def test_bit_tests_are_the_enumeration(spark):
    df = spark.range(65536).toDF("w")
    for sensor, legacy, flags in (("OLI", "collection1", {"cloud": ["low", "high"], "snow": "med"}), ("MSS", "collection1", {}), ("OLI", "pre_collection", {"water": "high"})):
        got = [r.w for r in df.where(qa.matches(F.col("w"), sensor, legacy, **flags)).orderBy("w").collect()]
        assert got == qa.encode(sensor, legacy, **flags)
    out = df.select("w", qa.decode(F.col("w")).alias("b"), qa.classify(F.col("w")).alias("c"), qa.classify(F.col("w"), strict_compat=True).alias("s"), qa.confidence(F.col("w"), "cloud").alias("f"))
    assert no_python(out)
    rows = out.collect()
    assert all(r.b == format(r.w, "016b") for r in rows)
    assert {r.c for r in rows} == {None, 1, 2, 3, 4} and {r.f for r in rows} == {None, 1, 2, 3}
    assert {r.s for r in rows} == {None, 5}


def test_one_hot(spark):
    df = image(spark, 6, 1, v=lambda i, j: [1, 2, 0, 1, None, -1][j])
    get = lambda **k: [tuple(r) for r in qa.one_hot(df, "v", [1, 2], ["cell"], **k).orderBy("cell").select("c_1", "c_2").collect()]
    assert get() == [(1, 0), (0, 1), (0, 0), (1, 0), (None, None), (0, 0)]
    assert get(background=7, foreground=9, na_rm=True) == [(9, 7), (7, 9), (7, 7), (9, 7), (7, 7), (7, 7)]


# focal, topography, clouds


@pytest.mark.parametrize("tile", [3, 512])
def test_terrain_of_a_plane(spark, tile):
    df = image(spark, 8, 7, z=lambda i, j: 3 * j - 2 * i)
    t = {(r.row, r.col): r for r in focal.terrain(df, "z", GridSpec(8, 7), tile).collect()}
    assert len(t) == 56 and t[0, 0].slope is None and t[3, 7].slope is None
    inner = [t[i, j] for i in range(1, 6) for j in range(1, 7)]
    # it rises to the east by 3 and to the north by 2, so it faces the south-west
    assert all(r.slope == pytest.approx(math.atan(math.hypot(3, 2))) and r.aspect == pytest.approx(math.atan2(-3, -2) % (2 * math.pi)) for r in inner)


def test_topographic_correction(spark):
    df = image(spark, 12, 12, z=lambda i, j: (i * 7 + j * j) % 11, b=lambda i, j: 50 + i - j)
    t = focal.terrain(df, "z", GridSpec(12, 12))
    solar = topography.sun_angles(40, 150)
    illu = {(r.row, r.col): r.illu for r in topography.top_cor(df, t, ["b"], solar, "illu").collect()}
    for m in ("cos", "avgcos", "stat", "C", "minnaert"):
        assert topography.top_cor(df, t, ["b"], solar, m).count() == 144
    flat = t.withColumn("slope", F.lit(0.0)).withColumn("aspect", F.lit(None).cast("double"))
    same = topography.top_cor(df, flat, ["b"], solar, "cos").join(df.select("row", "col", F.col("b").alias("o")), ["row", "col"]).collect()
    assert all(r.b == pytest.approx(r.o) for r in same)
    r = next(x for x in topography.top_cor(df, t, ["b"], solar, "cos").collect() if (x.row, x.col) == (5, 5))
    assert r.b == pytest.approx(50 * math.cos(solar[1]) / illu[5, 5])
    # a band that follows illumination exactly becomes even
    lit = topography.with_illumination(df, t, solar).withColumn("b", F.col("illu") * 40 + 10).select("row", "col", "b").na.drop()
    even = [r.b for r in topography.top_cor(lit, t, ["b"], solar, "C").collect() if r.b is not None]
    assert np.ptp(even) < 1e-6
    bins = topography.strata(df, "b", 3)
    assert bins[0][0] == 39 and bins[-1][1] == 61 and all(a[1] == b[0] for a, b in zip(bins, bins[1:]))
    assert topography.top_cor(df, t, ["b"], solar, "minnaert", stratify_by="slope", n_strata=2).count() == 144


def test_clouds(spark):
    df = image(spark, 9, 9, blue=lambda i, j: 10 if (i, j) == (4, 4) else 1, tir=lambda i, j: 1 if (i, j) == (4, 4) else 10)
    mask = clouds.cloud_mask(df, 0.2, "blue", "tir")
    assert [(r.row, r.col) for r in mask.where("CMASK = 1").collect()] == [(4, 4)]
    grown = {(r.row, r.col) for r in clouds.cloud_mask(df, 0.2, "blue", "tir", 3).where("CMASK = 1").collect()}
    assert grown == {(4, 4), (3, 4), (5, 4), (4, 3), (4, 5)}
    assert clouds.cloud_mask(df, 0.2, "blue", "tir", 1).where("CMASK = 1").count() == 1
    with pytest.raises(ValueError):
        focal.dilate(mask, "CMASK", 2)
    again = clouds.cloud_mask(df.withColumn("NDTCI", F.lit(0.5)), 0.2)
    assert again.where("CMASK = 1").count() == 81


def test_cloud_shadow(spark):
    cloud = {(3, 3), (3, 4), (4, 3), (9, 8), (10, 8)}
    dark = {(i + 2, j + 2) for i, j in cloud}
    df = image(spark, 14, 14, a=lambda i, j: 1 if (i, j) in dark else 50 + (i * 5 + j * 3) % 7)
    cm = image(spark, 14, 14, CMASK=lambda i, j: 1 if (i, j) in cloud else None)
    assert clouds.cloud_shadow_mask(df, cm, ["a"], shift_estimate=(2, -2), return_shift=True, quantile=0.03) in {(2, -2)}
    got = {(r.row, r.col) for r in clouds.cloud_shadow_mask(df, cm, ["a"], precise_shift=(2, -2)).where("CSMASK = 0").collect()}
    assert got == dark
    assert clouds.cloud_shadow_mask(df, cm, ["a"], precise_shift=(1, 1), return_shift=True) == (1, 1)


def test_resampling(spark):
    coarse = image(spark, 3, 3, v=lambda i, j: 10 * i + j)
    fine = image(spark, 6, 6, u=lambda i, j: 0).withColumn("x", F.col("x") / 2).withColumn("y", F.col("y") / 2)
    near = {(r.row, r.col): r.v for r in focal.resample_nearest(fine, coarse, GridSpec(3, 3), ["v"]).collect()}
    assert near == {(i, j): 10 * (i // 2) + j // 2 for i in range(6) for j in range(6)}
    lin = {(r.row, r.col): r.v for r in focal.resample_bilinear(fine, coarse, GridSpec(3, 3), ["v"]).collect()}
    assert lin[2, 2] == pytest.approx(10 * 0.75 + 0.75) and lin[0, 0] == pytest.approx(0) and len(lin) == 36
    assert {(r.row, r.col): r.u for r in focal.coarsen(fine.withColumn("u", F.col("row").cast("double")), ["u"], 2).collect()}[1, 1] == 2.5


# matching


def test_rescale(spark):
    df = image(spark, 5, 1, a=lambda i, j: [0, 5, 10, None, 2][j], c=lambda i, j: 3)
    out = match.rescale(df, ["a", "c"], ["cell"], ymax=100.0).orderBy("cell").collect()
    assert [r.a for r in out] == [0, 50, 100, None, 20] and {r.c for r in out} == {None}
    assert [r.a for r in match.rescale(df, ["a"], ["cell"], xmin=0, xmax={"a": 20}, ymin=1, ymax=2).orderBy("cell").collect()] == pytest.approx([1, 1.25, 1.5, None, 1.1])
    to = match.rescale(df, ["a"], ["cell"], to=image(spark, 2, 1, a=lambda i, j: 7 + j)).agg(F.min("a"), F.max("a")).first()
    assert tuple(to) == (7, 8)


def test_normalise(spark):
    v = [1.0, 4.0, 9.0, None, 2.0]
    df = image(spark, 5, 1, a=lambda i, j: v[j])
    x = np.array([1, 4, 9, 2.0])
    got = [r.a for r in match.normalise(df, ["a"], ["cell"]).orderBy("cell").collect()]
    assert got[3] is None and [g for g in got if g is not None] == pytest.approx(list((x - x.mean()) / x.std(ddof=1)))
    frozen = match.apply_scale(df, match.freeze(df, ["a"]), ["a"], ["cell"]).orderBy("cell").collect()
    assert [r.a for r in frozen] == pytest.approx(got)


def test_hist_match(spark):
    df = image(spark, 10, 10, a=lambda i, j: (i * 3 + j) % 17)
    same = match.hist_match(df, df, ["a"], ["cell"]).join(df.select("cell", F.col("a").alias("o")), "cell").collect()
    assert all(r.a == pytest.approx(r.o) for r in same)
    ref = image(spark, 10, 10, a=lambda i, j: 2 * ((i * 3 + j) % 17) + 5)
    assert all(r.a == pytest.approx(2 * r.o + 5) for r in match.hist_match(df, ref, ["a"], ["cell"], integer=True).join(df.select("cell", F.col("a").alias("o")), "cell").collect())
    part = match.hist_match(df, ref, ["a"], ["cell"], n_samples=40)
    assert part.where("a IS NULL").count() == 0
    lut = match.hist_match(df, ref, ["a"], ["cell"], return_lut=True)
    assert lut.count() == 17
    beyond = image(spark, 3, 1, a=lambda i, j: [-5, 3.5, 99][j])
    assert [r.a for r in match.apply_lut(beyond, lut, ["a"], ["cell"]).orderBy("cell").collect()] == [5, 11, 37]


def test_pif_match(spark):
    random.seed(4)
    val = {(b, i, j): random.random() for b in "abc" for i in range(10) for j in range(10)}
    df = image(spark, 10, 10, **{b: lambda i, j, b=b: val[b, i, j] for b in "abc"})
    ref = df.select("row", "col", *[(F.col(b) * (k + 2) + k).alias(b) for k, b in enumerate("abc")])
    for m in ("cor", "sam", "ed"):
        p = match.pif_match(df, ref, list("abc"), ["row", "col"], m, 0.5, parts=True)
        assert p["models"]["c"] == pytest.approx((4, 2)) and p["pif"].where("pif").count() == 50
        got = p["img"].join(ref.select("row", "col", F.col("b").alias("o")), ["row", "col"]).collect()
        assert all(r.b == pytest.approx(r.o) for r in got)
    with pytest.raises(ValueError):
        match.similarity([F.lit(1.0)], [F.lit(1.0)], "x")


def test_coregister(spark):
    random.seed(6)
    v = {(i, j): random.random() for i in range(-5, 30) for j in range(-5, 30)}
    ref = image(spark, 20, 20, a=lambda i, j: v[i, j])
    img = image(spark, 20, 20, a=lambda i, j: v[i + 1, j - 2])
    got = register.coregister(img, ref, ["a"], 3, n_bins=10, report=True)
    assert got["shift"] == (-2, -1) and len(got["mi"]) == 49
    both = got["img"].select("row", "col", F.col("a").alias("b")).join(ref, ["row", "col"]).collect()
    assert len(both) > 300 and all(r.a == r.b for r in both)
    assert register.coregister(img, ref, ["a"], [(0, 0), (-2, -1)], n_bins=10, n_samples=100, report=True)["shift"] == (-2, -1)


# transforms


def test_tasseled_cap(spark):
    df = image(spark, 2, 1, **{f"b{k}": lambda i, j, k=k: k + j for k in range(6)})
    for sensor in transform.TASSELED_CAP:
        n = len(transform.TASSELED_CAP[sensor][0])
        bands = [f"b{k % 6}" for k in range(n)]
        r = transform.tasseled_cap(df, bands, sensor.upper(), ["cell"]).orderBy("cell").first()
        assert r.brightness == pytest.approx(sum(w * (k % 6) for k, w in enumerate(transform.TASSELED_CAP[sensor][0])))
    with pytest.raises(ValueError):
        transform.tasseled_cap(df, ["b0"], "spot5")
    with pytest.raises(ValueError):
        transform.tasseled_cap(df, ["b0"], "spot9")


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0, 1.0)], "cell long, a double, b double, c double, d double")
    for std in (False, True):
        m, out = transform.raster_pca(df, list("abcd"), ["cell"], standardise=std)
        rows = out.orderBy("cell").collect()
        assert m.n == 200 and rows[-1].PC1 is None and no_python(out)
        got = np.array([[r[f"PC{k}"] for k in range(1, 5)] for r in rows[:-1]])
        z = (x - x.mean(0)) / (x.std(0) if std else 1)
        u = np.linalg.svd(z, full_matrices=False)
        assert np.allclose(np.abs(got), np.abs(z @ u[2].T), atol=1e-8)
        back = m.back(out, ["cell"]).orderBy("cell").limit(200).collect()
        assert np.allclose([[r[b] for b in "abcd"] for r in back], x)
    sampled = transform.pca_fit(df, list("abcd"), n_samples=150)
    assert np.allclose(np.abs(sampled.loadings[:, 0] @ m.loadings[:, 0]), 1, atol=0.3) and sampled.n == 150


def test_sam(spark):
    df = image(spark, 4, 1, a=lambda i, j: [1, 0, 1, None][j], b=lambda i, j: [0, 2, 1, 1][j])
    got = transform.sam(df, {"x": [1, 0], "y": [0, 1]}, ["a", "b"], ["cell"], angles=True).orderBy("cell").collect()
    assert [r.x_sa for r in got] == pytest.approx([0, math.pi / 2, math.pi / 4, None], abs=1e-7)
    assert [r["class"] for r in transform.sam(df, {"x": [1, 0], "y": [0, 1]}, ["a", "b"], ["cell"]).orderBy("cell").collect()] == [1, 2, 1, None]
    with pytest.raises(ValueError):
        transform.sam(df, {"x": [1]}, ["a", "b"])


def test_cva(spark):
    way = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    x = image(spark, 9, 1, a=lambda i, j: 0, b=lambda i, j: 0)
    y = image(spark, 9, 1, a=lambda i, j: way[j][0] if j < 8 else None, b=lambda i, j: way[j][1] if j < 8 else 1)
    got = transform.cva(x, y, ("a", "b"), ["cell"]).orderBy("cell").collect()
    assert [r.angle for r in got] == pytest.approx([0, 45, 90, 135, 180, 225, 270, 315, None])
    assert [r.magnitude for r in got][:2] == pytest.approx([1, math.sqrt(2)])
    assert [r.angle for r in transform.cva(x, y, ("a", "b"), ["cell"], nct=1.1).orderBy("cell").collect()] == [None, 45, None, 135, None, 225, None, 315, None]
    assert [r.magnitude for r in transform.cva(x, y, ("a", "b"), ["cell"], nct=1.1, strict_compat=True).orderBy("cell").collect()][:2] == pytest.approx([1.1, math.sqrt(2)])


def test_entropy(spark):
    random.seed(1)
    rows = [[random.randint(0, 3) for _ in range(5)] for _ in range(40)]
    df = image(spark, 40, 1, **{f"b{k}": lambda i, j, k=k: rows[j][k] for k in range(5)})
    for r in transform.entropy(df, [f"b{k}" for k in range(5)], ["cell"]).collect():
        assert r.entropy == pytest.approx(-sum(n / 5 * math.log(n / 5) for n in Counter(rows[r.cell - 1]).values()))
    with pytest.raises(ValueError):
        transform.entropy(df, ["b0"])


@pytest.mark.parametrize("method", ["brovey", "ihs", "pca"])
def test_pan_sharpen(spark, method):
    coarse = image(spark, 4, 4, r=lambda i, j: 10 + i, g=lambda i, j: 20 + j, b=lambda i, j: 5 + i * j)
    pan = image(spark, 8, 8, p=lambda i, j: 10 + i + j).withColumn("x", F.col("x") / 2).withColumn("y", F.col("y") / 2)
    out = transform.pan_sharpen(coarse, pan, ["r", "g", "b"], "p", GridSpec(4, 4), method=method, keys=["cell"])
    assert out.columns == ["cell", "r_pan", "g_pan", "b_pan"] and out.count() == 64 and out.where("r_pan IS NULL").count() == 0
    if method == "brovey":
        assert out.where("cell = 1").first().r_pan == pytest.approx(10 * 10 / 35)


# unmixing


def test_nnls():
    rng = np.random.default_rng(2)
    e = rng.random((2, 7))
    p = np.array([[k / 10, 1 - k / 10] for k in range(11)])
    v, err = unmix.nnls(p @ e, e, 4000)
    assert np.allclose(v, p, atol=1e-2) and (err < 1e-2).all()
    x = rng.normal(size=(60, 5))
    e = rng.random((3, 5))
    v, _ = unmix.nnls(x, e, 5000, 1e-12)
    grad = v @ (e @ e.T) - x @ e.T
    assert (v >= 0).all() and (grad > -1e-6).all() and np.abs(grad * v).max() < 1e-6  # the optimality conditions


def test_nnls_is_exact():
    e = np.array([[1.0, 0.0, 0.5], [1.0, 1e-4, 0.5]])  # nearly the same
    p = np.array([[0.3, 0.7], [0.9, 0.1], [0.0, 1.0], [1.0, 0.0]])
    v, err = unmix.nnls(p @ e, e)
    assert np.allclose(v, p, atol=1e-9) and (err < 1e-12).all()
    v, _ = unmix.nnls(np.array([[1.0, 1.0]]), np.array([[1.0, 1.0], [2.0, 2.0], [0.0, 0.0]]))
    assert v @ [1, 2, 0] == pytest.approx(1)  # dependent endmembers
    x, soil = np.array([[-0.01375986, -0.14111796, -0.2606487, -0.03066462]]), [[0.2, 0.1, -0.1, 0.3]]
    assert unmix.nnls(x, np.array(soil))[0][0, 0] > 0  # lowers the RMSE, by less than 1e-9
    assert unmix.nnls(x, np.array(soil), digits=9)[0][0, 0] == 0


def test_mesma(spark):
    e = {"a": [0.9, 0.1, 0.2], "b": [0.1, 0.8, 0.3]}
    df = image(spark, 3, 1, **{f"x{k}": lambda i, j, k=k: None if j == 2 else (j + 1) / 4 * e["a"][k] + (3 - j) / 4 * e["b"][k] for k in range(3)})
    got = unmix.mesma(df, list(e.values()), ["x0", "x1", "x2"], ["a", "b"], ["cell"]).orderBy("cell").collect()
    assert got[0].a == pytest.approx(0.25, abs=1e-4) and got[1].b == pytest.approx(0.5, abs=1e-4) and got[2].a is None and got[2].RMSE is None
    multi = unmix.mesma(df, [*e.values(), [0, 0, 1.0], [1, 1, 1.0]], ["x0", "x1", "x2"], ["a", "b", "a", "b"], ["cell"], classes=True, n_models=4).orderBy("cell").collect()
    assert multi[0].RMSE <= got[0].RMSE + 1e-9 and multi[0].a == pytest.approx(0.25, abs=1e-3)
    assert len(unmix.combinations(["a", "b", "a"], 9)) == 2


def test_unmixing_queries_leave_out_what_the_sql_does(spark, tmp_path):
    from pixelloom.plans import catalog

    rows = [(i, 0, v) for i, v in enumerate([[-0.01375986, -0.14111796, -0.2606487, -0.03066462], [0.01793619, 0.04460631, -0.1514594, -0.07729609]])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("nnls", "mesma"):  # as the SQL has them, run by one thread
        got = catalog.queries()[name](spark, str(tmp_path)).orderBy("vec_id").select("soil", "water", "leaf", "RMSE").collect()
        assert [tuple(r) for r in got] == [(None, None, None, 0.149), (None, None, None, 0.088)]


# vectors, classification


def test_vectors(spark):
    kind, polys = vector.parse_wkt("POLYGON ((0 0, 4 0, 4 -4, 0 -4, 0 0), (1 -1, 2 -1, 2 -2, 1 -2, 1 -1))")
    assert kind == "POLYGON" and vector.area(polys[0]) == 15 and vector.box(polys) == (0, 4, -4, 0)
    assert vector.parse_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")[1][1][0][0] == (5, 5)
    assert vector.parse_wkt("POINT (1.5 -2)")[1] == [[[(1.5, -2.0)]]]
    g = GridSpec(6, 6)
    cover = vector.coverage(polys, g)
    assert len(cover) == 15 and all(s == 1 for *_, s in cover) and (1, 1) not in {c[:2] for c in cover}
    with pytest.raises(ValueError):
        vector.parse_wkt("LINESTRING (0 0, 1 1)")
    with pytest.raises(ValueError):
        vector.select_intersecting([{"wkt": "POINT (100 100)"}], g.extent)
    img = image(spark, 6, 6, v=lambda i, j: i + j)
    px = vector.sample_pixels(img, [{"wkt": "POINT (1.5 -2.5)", "k": "a"}, {"wkt": "POINT (4.2 -0.3)", "k": "b"}], "k", ["v"], g).orderBy("feature").collect()
    assert [(r.row, r.col, r.response, r.v) for r in px] == [(2, 1, "a", 3), (0, 4, "b", 4)]
    near = vector.away_from(spark.createDataFrame([(0, 0), (0, 3), (5, 5)], "row int, col int"), spark.createDataFrame([(0, 1)], "row int, col int"), 2).collect()
    assert [(r.row, r.col) for r in near] == [(5, 5)]


def test_kmeans_goldens(spark):
    rows = [[i + 5 * k for k in range(4)] for i in range(1, 6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)] + [(5, None, 1.0, 1.0, 1.0)], "cell int, a double, b double, c double, d double")
    centres = [rows[0], rows[2]]
    assert [r["class"] for r in classify.assign(df, centres, list("abcd"), ["cell"]).orderBy("cell").collect()] == [1, 1, 2, 2, 2, None]
    assert [r.dist_c1 for r in classify.assign(df, centres, list("abcd"), ["cell"], "distances").orderBy("cell").collect()] == [0, 2, 4, 6, 8, None]


def test_unsupervised(spark):
    df = image(spark, 10, 6, a=lambda i, j: (i // 2) * 10 + (j % 3) * 0.1, b=lambda i, j: None if (i, j) == (0, 0) else (i // 2) * 5)
    m, out = classify.unsupervised(df, ["a", "b"], 3, 3)
    assert sorted(m.sizes) == [19, 20, 20] and out.where("class IS NULL").count() == 1 and "3 classes" in m.summary()
    again = m.predict(df).exceptAll(out)
    assert again.count() == 0


def test_mlc(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(4, 2, (60, 2))])
    df = spark.createDataFrame([(i, "ab"[i // 60], *map(float, r)) for i, r in enumerate(x)], "cell long, response string, u double, v double")
    m = classify.mlc_fit(df, ["u", "v"])
    s = m.predict(df, ["cell"], "score").orderBy("cell").collect()
    for k, c in enumerate("ab"):
        own = x[k * 60 : k * 60 + 60]
        cov = np.cov(own.T)
        d = x - own.mean(0)
        want = -np.log(np.linalg.det(cov)) - np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        assert np.allclose([r[f"score_{c}"] for r in s], want)
    p = m.predict(df, ["cell"], "prob").first()
    assert p.prob_a + p.prob_b == pytest.approx(1)
    with pytest.warns(UserWarning):
        classify.mlc_fit(df.withColumn("v", F.col("u")), ["u", "v"])


def squares():
    box = lambda x, y: f"POLYGON (({x} {y}, {x + 5} {y}, {x + 5} {y - 5}, {x} {y - 5}, {x} {y}))"
    return [{"wkt": box(x, y), "k": k} for x, y, k in ((0, 0, "low"), (0, -10, "low"), (12, 0, "high"), (12, -10, "high"))]


def scene(spark):
    return image(spark, 20, 20, a=lambda i, j: (0 if j < 10 else 10) + (i * 7 + j * 3) % 5 / 10, b=lambda i, j: None if (i, j) == (19, 19) else (j * 5 + i) % 7, c=lambda i, j: 1)


@pytest.mark.parametrize("model", ["rf", "mlc", "logistic", "dt", "nb"])
def test_supervised(spark, model):
    img, bands = scene(spark), ["a", "b"]
    m, out = classify.supervised(img, squares(), "k", bands, GridSpec(20, 20), train_partition=0.5, model=model, tune_length=1, k_folds=2, min_dist=1, polygon_cv=False)
    assert m.classes == ("high", "low") and out.count() == 400 and out.where("class IS NULL").count() == 1
    hits = out.join(img, ["row", "col"]).where("class IS NOT NULL AND (class = 1) = (col >= 10)").count()
    assert hits >= 395
    assert m.validation.overall()["accuracy"] >= 0.95
    assert m.scores(spark, metrics="confmat").count() == 4 and "accuracy" in m.summary()
    if model != "mlc":
        assert m.scores(spark, "cv").count() == 1
    p = m.predict(img, ["row", "col"], "prob").na.drop().first()
    assert p.prob_high + p.prob_low == pytest.approx(1, abs=1e-6)


def test_supervised_errors(spark):
    img = scene(spark)
    with pytest.raises(ValueError):
        classify.supervised(img, [{"wkt": "POINT (99 99)", "k": "a"}], "k", ["a"], GridSpec(20, 20))
    px = vector.sample_pixels(img, squares(), "k", ["a", "b", "c"], GridSpec(20, 20))
    with pytest.raises(ValueError):
        classify.fit(px.where("response = 'low'"), ["a"])
    with pytest.raises(ValueError):
        classify.fit(px, ["a"], "nope")
    with pytest.warns(UserWarning):
        assert classify.fit(px, ["a", "c"], "dt", tune_length=1, k_folds=2).bands == ("a",)


@pytest.mark.parametrize("how", ["up", "down", "smote", "rose"])
def test_balance(spark, how):
    df = image(spark, 10, 3, v=lambda i, j: i * 10 + j).withColumn("response", F.when(F.col("row") == 0, "a").otherwise("b"))
    n = {r.response: r["count"] for r in classify.balance(df, how, bands=["v"]).groupBy("response").count().collect()}
    assert n == ({"a": 10, "b": 10} if how == "down" else {"a": 20, "b": 20})


def test_nearest_is_exact_and_compares_no_class_in_pairs(spark):
    rng = np.random.default_rng(5)
    n = 9000  # several cells for the first class
    x, y = rng.integers(0, 40, n).astype(float), np.round(rng.random(n) * 300) / 4  # many copies and equal distances
    x[:3000], y[:3000] = rng.random(3000) * 40, rng.random(3000) * 80
    k = np.where(rng.random(n) < 0.8, "a", "b")
    rows = [(i // 100, i % 100, float(x[i]), float(y[i]), str(k[i])) for i in range(n)]
    rows += [(200, 0, 1.0, 1.0, "alone"), (200, 1, None, 2.0, "a"), (200, 2, 1e300, 0.0, "c"), (200, 3, -1.0, 0.0, "c"), (200, 4, 0.0, 3.0, "c")]
    df = spark.createDataFrame(rows, "row int, col int, x double, y double, response string")
    got = {(r.response, r.x, r.y): tuple(r._next) for r in classify.nearest(df, ["x", "y"]).collect()}
    for c in "ab":
        at = np.flatnonzero(k == c)
        for i in at:
            d = (x[at] - x[i]) ** 2 + (y[at] - y[i]) ** 2
            d[at == i] = np.inf
            j = at[np.argmin(d)]  # the first (row, col) of equally near ones
            assert got[c, x[i], y[i]] == (x[j], y[j])
    assert {g: n for g, n in got.items() if g[0] not in "ab"} == {("c", -1.0, 0.0): (0.0, 3.0), ("c", 0.0, 3.0): (-1.0, 0.0)}
    plan = classify.balance(df, "smote", bands=["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (row" not in plan and "NOT (col" not in plan


def test_folds_keep_features_together(spark):
    df = image(spark, 10, 4, v=lambda i, j: 0).withColumn("response", F.lit("a")).withColumn("feature", F.col("col"))
    f = classify.folds(df, 3, "feature").groupBy("feature").agg(F.count_distinct("fold").alias("n")).collect()
    assert {r.n for r in f} == {1}
    train, rest = classify.stratified_split(df, 0.7)
    assert (train.count(), rest.count()) == (28, 12)


def test_validation_metrics(spark):
    v = classify.Validation(("a", "b"), np.array([[40, 10], [5, 45]]))
    o = v.overall()
    assert o["accuracy"] == 0.85 and o["kappa"] == pytest.approx(0.7) and o["null"] == 0.55
    assert (o["lower"], o["upper"]) == pytest.approx((0.7647, 0.9135), abs=1e-4) and o["p_value"] == pytest.approx(sum(math.comb(100, k) * 0.55**k * 0.45 ** (100 - k) for k in range(85, 101)), rel=1e-6)
    c = v.by_class()[0]
    assert (c["sensitivity"], c["specificity"], c["ppv"], c["npv"]) == pytest.approx((40 / 45, 45 / 55, 0.8, 0.9))
    for m in ("overall", "classwise", "confmat"):
        assert v.frame(spark, m).count() == {"overall": 1, "classwise": 2, "confmat": 4}[m]
    img = scene(spark).withColumn("class", F.when(F.col("col") < 10, 2).otherwise(1))
    assert classify.validate_map(img, squares(), "k", GridSpec(20, 20)).overall()["accuracy"] == 1
    with pytest.raises(ValueError):
        classify.validate(img.limit(0), img.withColumn("response", F.lit("low")), ("high", "low"))


def test_regression_and_fractional_cover(spark):
    fine = image(spark, 40, 40, k=lambda i, j: 1 if (i + j) % 40 < 20 else 2).withColumn("class", F.col("k").cast("int"))
    shares = {(r.row, r.col): r.fC_1 for r in classify.class_shares(fine, GridSpec(8, 8, xres=5.0, yres=5.0), [1, 2]).collect()}
    assert len(shares) == 64 and 0 <= min(shares.values()) and max(shares.values()) <= 1
    coarse = image(spark, 8, 8, a=lambda i, j: shares[i, j] * 3, b=lambda i, j: (i * j) % 3)
    models, out = classify.fractional_cover(fine, coarse, ["a", "b"], GridSpec(8, 8, xres=5.0, yres=5.0), [1], model="lm", tune_length=1, k_folds=2)
    assert all(abs(r.fC_1 - shares[r.row, r.col]) < 1e-6 for r in out.collect())
    gaps = fine.withColumn("class", F.when(F.col("cell") != 1, F.col("class")))
    assert classify.class_shares(gaps, GridSpec(8, 8, xres=5.0, yres=5.0), [1], 0.0).count() == 63 and classify.class_shares(gaps, GridSpec(8, 8, xres=5.0, yres=5.0), [1], 0.1).count() == 64
    e = classify.errors(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 5.0), (None, 1.0)], "prediction double, reference double")).first()
    assert (e.rmse, e.mae) == (1, 1) and e.r2 == pytest.approx(1)


# display


def test_stretches(spark):
    v = [1.0, 2.0, 3.0, 4.0, None]
    df = image(spark, 5, 1, a=lambda i, j: v[j], c=lambda i, j: 0.4)
    get = lambda m, b="a": [r[0] for r in display.stretch(df, [b], m, (0, 1)).orderBy("cell").select(b).collect()]
    assert get("lin") == pytest.approx([0, 1 / 3, 2 / 3, 1, None]) and get("hist") == [0.25, 0.5, 0.75, 1, None]
    assert get("log") == pytest.approx([0, math.log(1.5) / math.log(2.5), math.log(2) / math.log(2.5), 1, None])
    assert get("sqrt")[1] == pytest.approx(math.sqrt(2) - 1) and get("lin", "c") == [0.4] * 5
    with pytest.raises(ValueError):
        display.stretch(df, ["a"], "x")


def test_colours(spark):
    df = image(spark, 2, 2, r=lambda i, j: i * 255, g=lambda i, j: j * 255, b=lambda i, j: None if i * j else 0)
    out = {(r.x, r.y): r.fill for r in display.rgb_frame(df, GridSpec(2, 2), "r", "g", "b", scale=255).collect()}
    assert out == {(0.5, -0.5): "#000000FF", (1.5, -0.5): "#00FF00FF", (0.5, -1.5): "#FF0000FF", (1.5, -1.5): None}
    grey = {(r.x, r.y): r.fill for r in display.grey_frame(df, ["r"], GridSpec(2, 2)).collect()}
    assert grey[0.5, -0.5] == "#000000FF" and grey[0.5, -1.5] == "#FFFFFFFF"
    assert display.grey_frame(df, ["r"], GridSpec(2, 2), categorical=True).where("fill IS NULL").count() == 4
    clip = display.rgb_frame(df, GridSpec(2, 2), "r", None, None, limits=(0, 100), clip_values=(None, None), scale=255).where("fill IS NULL").count()
    assert clip == 2


def test_rgb_frame_takes_every_pixel(spark):
    g = GridSpec(900, 700)
    df = grid.from_cells(spark.range(1, 630_001).withColumnRenamed("id", "cell"), g).withColumn("a", F.col("cell").cast("double"))
    assert display.rgb_frame(df, g, "a", None, None).agg(F.count_distinct("x", "y")).first()[0] == 630_000
    assert display.rgb_frame(df, g, "a", None, None, max_pixels=500_000).count() == 450 * 350


def test_grey_frame_takes_every_pixel(spark):
    g = GridSpec(900, 700)
    df = grid.from_cells(spark.range(1, 630_001).withColumnRenamed("id", "cell"), g).withColumn("a", F.col("cell").cast("double"))
    assert display.grey_frame(df, ["a"], g).agg(F.count_distinct("value")).first()[0] == 630_000
    assert display.grey_frame(df, ["a"], g, max_pixels=500_000).count() == 450 * 350


def test_statistics(spark):
    df = image(spark, 4, 1, a=lambda i, j: [1, 2, 2, None][j], b=lambda i, j: [2, 4, 4, 1][j])
    s = stats.summary(df, ["a"])["a"]
    assert (s["min"], s["max"], s["n"]) == (1, 2, 3)
    n, mean, cov = stats.covariance(df, ["a", "b"])
    assert n == 3 and np.allclose(cov, np.cov([[1, 2, 2], [2, 4, 4]])) and np.allclose(mean, [5 / 3, 10 / 3])
    assert stats.quantiles(df, ["a"], [0.5])["a"] == [2]
    f = stats.linear_fit(df, F.col("b"), F.col("a")).first()
    assert (f.slope, f.intercept) == pytest.approx((2, 0))
    e = stats.entropy_of_counts(spark.createDataFrame([("x", 1), ("x", 1)], "g string, n int"), ["g"]).first()
    assert e.entropy == pytest.approx(math.log(2))
