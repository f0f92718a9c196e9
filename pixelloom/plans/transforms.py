"""Queries of transforms of pixels and of display tables."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import stats
from ..grid import GridSpec, fortify, sample_regular
from ..operators import display, focal, transform, unmix
from .registry import query
from .views import PART, emb, emb_pixels, part_grid, part_pixels, r, rounded

_B6 = [f"b{i}" for i in range(6)]
_TC = transform.TASSELED_CAP["landsat8oli"]


@query("tasseled_cap", "SELECT vec_id, " + ", ".join(r(" + ".join(f"b{i} * {w}" for i, w in enumerate(ws)), n) for n, ws in zip(("brightness", "greenness", "wetness"), _TC)) + f" FROM {emb(6)}")
def tasseled_cap(spark, sf_dir):
    return rounded(transform.tasseled_cap(emb_pixels(spark, sf_dir, 6), _B6, "landsat8oli", ["vec_id"]), ["brightness", "greenness", "wetness"])


_EM = {"soil": [0.2, 0.1, -0.1, 0.3], "water": [-0.1, 0.2, 0.2, -0.2], "leaf": [0.1, -0.3, 0.2, 0.1]}
_B4 = [f"b{i}" for i in range(4)]
_NORM = "sqrt((b0 * b0 + b1 * b1 + b2 * b2 + b3 * b3) * {n})"


def _angle(e):
    n = sum(x * x for x in e)
    return f"acos(least(greatest(({' + '.join(f'b{i} * ({x})' for i, x in enumerate(e))}) / nullif({_NORM.format(n=n)}, 0), -1.0), 1.0))"


@query("sam_angles", "SELECT vec_id, " + ", ".join(r(_angle(e), f"{n}_sa") for n, e in _EM.items()) + f" FROM {emb(4)}")
def sam_angles(spark, sf_dir):
    return rounded(transform.sam(emb_pixels(spark, sf_dir, 4), _EM, _B4, ["vec_id"], angles=True), [f"{n}_sa" for n in _EM])


@query("sam_class", f"SELECT vec_id, list_position([{', '.join(_angle(e) for e in _EM.values())}], list_min([{', '.join(_angle(e) for e in _EM.values())}]))::INT AS class FROM {emb(4)}")
def sam_class(spark, sf_dir):
    return transform.sam(emb_pixels(spark, sf_dir, 4), _EM, _B4, ["vec_id"])


_CVA = """WITH p AS (SELECT user_id, ts::DATE AS day, coalesce(avg(value) FILTER (WHERE event_type = 'click'), 0) AS a, coalesce(avg(value) FILTER (WHERE event_type <> 'click'), 0) AS b FROM events GROUP BY 1, 2),
d AS (SELECT user_id, y.a - x.a AS d1, y.b - x.b AS d2 FROM p x JOIN p y USING (user_id) WHERE x.day = DATE '2024-01-03' AND y.day = DATE '2024-01-04'),
m AS (SELECT user_id, CASE WHEN degrees(atan2(d1, d2)) < 0 THEN degrees(atan2(d1, d2)) + 360 ELSE degrees(atan2(d1, d2)) END AS a, sqrt(d1 * d1 + d2 * d2) AS m FROM d)"""


def _days(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.col("ts").cast("date"))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("value"))), F.lit(0.0))
    return lambda d: e.where(F.col("day") == F.lit(d).cast("date")).groupBy("user_id").agg(mean(F.col("event_type") == "click").alias("a"), mean(F.col("event_type") != "click").alias("b"))


@query("cva", f"{_CVA} SELECT user_id, {r('a', 'angle', 4)}, {r('m', 'magnitude')} FROM m")
def cva(spark, sf_dir):
    day = _days(spark, sf_dir)
    return rounded(rounded(transform.cva(day("2024-01-03"), day("2024-01-04"), ("a", "b"), ["user_id"]), ["magnitude"]), ["angle"], 4)


@query("cva_threshold", f"{_CVA}, t AS (SELECT median(m) * 1.1 AS t FROM m) SELECT user_id, {r('CASE WHEN m >= t THEN a END', 'angle', 4)}, {r('CASE WHEN m >= t THEN m END', 'magnitude')} FROM m, t")
def cva_threshold(spark, sf_dir):
    day = _days(spark, sf_dir)
    return rounded(rounded(transform.cva(day("2024-01-03"), day("2024-01-04"), ("a", "b"), ["user_id"], tmf=1.1), ["magnitude"]), ["angle"], 4)


@query("entropy", f"""WITH l AS (SELECT vec_id, unnest([{', '.join(f"round(b{i} * 10)" for i in range(8))}]) AS v FROM {emb(8)}), n AS (SELECT vec_id, v + 0.0 AS v, count(*) / 8.0::DOUBLE AS p FROM l GROUP BY 1, 2)
SELECT vec_id, {r('-sum(p * ln(p))', 'entropy')} FROM n GROUP BY vec_id""")
def entropy(spark, sf_dir):
    e = emb_pixels(spark, sf_dir, 8)
    e = e.select("vec_id", *[(F.round(F.col(f"b{i}") * 10) + 0.0).alias(f"b{i}") for i in range(8)])
    return rounded(transform.entropy(e, [f"b{i}" for i in range(8)], ["vec_id"]), ["entropy"])


@query("pca_cov", "SELECT " + ", ".join(r(f"covar_samp(b{i}, b{j})", f"c_{i}_{j}") for i in range(4) for j in range(i, 4)) + f" FROM {emb(4)}")
def pca_cov(spark, sf_dir):
    e = emb_pixels(spark, sf_dir, 4)
    out = e.agg(*stats.covariance_columns([F.col(f"b{i}") for i in range(4)]))
    return rounded(out, out.columns)


_XY = "covar_samp(size, price)"
_PCA2 = f"""WITH p AS (SELECT * FROM {PART}), s AS (SELECT avg(size) ms, avg(price) mp, var_samp(size) a, var_samp(price) d, {_XY} b FROM p),
e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1 FROM s), v AS (SELECT *, abs(b) / sqrt(b * b + (l1 - a) * (l1 - a)) AS x, sign(b) * (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS y FROM e)"""


@query("pca_scores", f"{_PCA2} SELECT cell, {r('(size - ms) * x + (price - mp) * y', 'PC1', 4)}, {r('(size - ms) * abs(y) - (price - mp) * x * sign(y)', 'PC2', 4)} FROM p, v")
def pca_scores(spark, sf_dir):
    """Two bands, whose components SQL can solve too."""
    _, out = transform.raster_pca(part_pixels(spark, sf_dir), ["size", "price"], ["cell"])
    return rounded(out, ["PC1", "PC2"], 4)


@query("pca_scores_8")
def pca_scores_8(spark, sf_dir):
    return transform.raster_pca(emb_pixels(spark, sf_dir, 8), [f"b{i}" for i in range(8)], ["vec_id"], standardise=True)[1]


def _unmix_sql(names: list[str], ems: list[list[float]], models: list[list[int]], digits: int) -> str:
    """Least squares over each subset of each model's endmembers; of those without
    a negative fraction the one of the least error is the non-negative solution."""
    labels, tries = list(dict.fromkeys(names)), []
    for m, model in enumerate(models):
        for k in range(2 ** len(model)):
            own = [i for j, i in enumerate(model) if k >> j & 1]
            e = np.array([ems[i] for i in own]).reshape(len(own), 4)
            p = np.linalg.solve(e @ e.T, e) if own else e
            f = {names[i]: "(" + " + ".join(f"b{b} * ({p[j, b]!r})" for b in range(4)).replace("np.float64(", "(") + ")" for j, i in enumerate(own)}
            rest = " + ".join(f"(b{b} - (" + (" + ".join(f"{f[names[i]]} * ({ems[i][b]})" for i in own) or "0") + ")) ** 2" for b in range(4))
            tries.append(f"SELECT vec_id, {m} AS m, {', '.join(f'{f.get(n, 0)}::DOUBLE AS {n}' for n in labels)}, sqrt(({rest}) / 4) AS rmse FROM {emb(4)} WHERE {' AND '.join(f'{x} >= 0' for x in f.values()) or 'true'}")
    best = f"SELECT vec_id, unnest(arg_min({{{', '.join(f"'{n}': {n}" for n in [*labels, 'rmse'])}}}, (round(rmse, 9), m))) FROM ({' UNION ALL '.join(tries)}) GROUP BY vec_id"
    total = " + ".join(labels)
    return f"SELECT vec_id, {', '.join(r(f'CASE WHEN {total} > 0 THEN {n} / ({total}) END', n, digits) for n in labels)}, {r('rmse', 'RMSE', digits)} FROM ({best})"


@query("nnls", _unmix_sql(list(_EM), list(_EM.values()), [[0, 1, 2]], 3))
def nnls(spark, sf_dir):
    e = emb_pixels(spark, sf_dir, 4)
    return rounded(unmix.mesma(e, list(_EM.values()), _B4, list(_EM), ["vec_id"], sweeps=2000, tolerance=1e-10, digits=9), [*_EM, "RMSE"], 3)


_EMS = [*_EM.values(), [0.1, 0.1, 0.1, 0.2], [0.0, -0.2, 0.3, 0.1], [-0.2, 0.1, 0.1, 0.1]]
_KINDS = [*_EM, "soil", "leaf", "water"]


@query("mesma", _unmix_sql(_KINDS, _EMS, unmix.combinations(_KINDS, 4), 3))
def mesma(spark, sf_dir):
    e = emb_pixels(spark, sf_dir, 4)
    return rounded(unmix.mesma(e, _EMS, _B4, _KINDS, ["vec_id"], classes=True, n_models=4, sweeps=2000, tolerance=1e-10, digits=9), [*_EM, "RMSE"], 3)


@query("coarsen", f"SELECT (row // 4)::INT AS row, (col // 4)::INT AS col, {r('avg(size)', 'size')}, {r('avg(price)', 'price')} FROM {PART} GROUP BY 1, 2")
def coarsen(spark, sf_dir):
    return rounded(focal.coarsen(part_pixels(spark, sf_dir), ["size", "price"], 4), ["size", "price"])


def _coarse(spark, sf_dir, k=4):
    g = part_grid(spark, sf_dir)
    return focal.coarsen(part_pixels(spark, sf_dir), ["size", "price"], k), GridSpec(-(-g.ncol // k), -(-g.nrow // k), xres=float(k), yres=float(k))


@query("resample_nearest", f"WITH p AS (SELECT * FROM {PART}), c AS (SELECT row // 4 AS r, col // 4 AS k, avg(size) AS s FROM p GROUP BY 1, 2) SELECT cell, {r('s', 'size')} FROM p JOIN c ON p.row // 4 = r AND p.col // 4 = k")
def resample_nearest(spark, sf_dir):
    c, g = _coarse(spark, sf_dir)
    return rounded(focal.resample_nearest(part_pixels(spark, sf_dir), c, g, ["size"]).select("cell", "size"), ["size"])


_BI = f"""WITH p AS (SELECT *, (col + 0.5) / 4 - 0.5 AS fx, (row + 0.5) / 4 - 0.5 AS fy FROM {PART}), c AS (SELECT row // 4 AS r, col // 4 AS k, avg(size) AS s FROM p GROUP BY 1, 2),
w AS (SELECT cell, s, (1 - abs(fx - k)) * (1 - abs(fy - r)) AS w FROM p JOIN c ON abs(fx - k) < 1 AND abs(fy - r) < 1)"""


@query("resample_bilinear", f"{_BI} SELECT cell, {r('sum(w * s) / sum(w)', 'size')} FROM w GROUP BY cell")
def resample_bilinear(spark, sf_dir):
    c, g = _coarse(spark, sf_dir)
    return rounded(focal.resample_bilinear(part_pixels(spark, sf_dir), c, g, ["size"], ["cell"]), ["size"])


@query("pan_brovey", f"WITH p AS (SELECT * FROM {PART}), c AS (SELECT row // 4 AS r, col // 4 AS k, avg(size) AS a, avg(price) AS b, avg(size) + 10 AS g FROM p GROUP BY 1, 2) SELECT cell, {r('a * price / (a + b + g)', 'size_pan', 4)}, {r('b * price / (a + b + g)', 'price_pan', 4)}, {r('g * price / (a + b + g)', 'third_pan', 4)} FROM p JOIN c ON p.row // 4 = r AND p.col // 4 = k")
def pan_brovey(spark, sf_dir):
    c, g = _coarse(spark, sf_dir)
    c = c.withColumn("third", F.col("size") + 10)
    out = transform.pan_sharpen(c, part_pixels(spark, sf_dir), ["size", "price", "third"], "price", g, keys=["cell"])
    return rounded(out, [x for x in out.columns if x != "cell"], 4)


_IHS = _BI.split(", c AS")[0] + """, c AS (SELECT row // 4 AS r, col // 4 AS k, avg(size) AS a, avg(price) / 50 AS b, avg(size) + 10 AS g FROM p GROUP BY 1, 2),
v AS (SELECT r, k, (a + b + g) / 3 AS i, (a + b - 2 * g) / sqrt(6) AS v1, (a - b) / sqrt(2) AS v2 FROM c),
w AS (SELECT cell, sum(v1 * (1 - abs(fx - k)) * (1 - abs(fy - r))) / sum((1 - abs(fx - k)) * (1 - abs(fy - r))) AS v1, sum(v2 * (1 - abs(fx - k)) * (1 - abs(fy - r))) / sum((1 - abs(fx - k)) * (1 - abs(fy - r))) AS v2 FROM p JOIN v ON abs(fx - k) < 1 AND abs(fy - r) < 1 GROUP BY cell),
x AS (SELECT DISTINCT price, cume_dist() OVER (ORDER BY price) AS q FROM p), y AS (SELECT DISTINCT i, cume_dist() OVER (ORDER BY i) AS q FROM v), z AS (SELECT i, q, lead(i) OVER (ORDER BY i) AS i2, lead(q) OVER (ORDER BY i) AS q2 FROM y),
m AS (SELECT price, coalesce((SELECT CASE WHEN q2 IS NULL THEN z.i ELSE z.i + (x.q - z.q) / (q2 - z.q) * (i2 - z.i) END FROM z WHERE z.q <= x.q ORDER BY z.q DESC LIMIT 1), (SELECT min(i) FROM y)) AS i FROM x)"""


@query("pan_ihs", f"{_IHS} SELECT cell, {r('i + v1 / sqrt(6) + v2 / sqrt(2)', 'size_pan', 2)}, {r('i + v1 / sqrt(6) - v2 / sqrt(2)', 'p50_pan', 2)}, {r('i - 2 * v1 / sqrt(6)', 'third_pan', 2)} FROM p JOIN w USING (cell) JOIN m USING (price)")
def pan_ihs(spark, sf_dir):
    c, g = _coarse(spark, sf_dir)
    c = c.withColumn("third", F.col("size") + 10).withColumn("p50", F.col("price") / 50)
    out = transform.pan_sharpen(c, part_pixels(spark, sf_dir), ["size", "p50", "third"], "price", g, method="ihs", keys=["cell"])
    return rounded(out, [x for x in out.columns if x != "cell"], 2)


@query("pan_pca")
def pan_pca(spark, sf_dir):
    c, g = _coarse(spark, sf_dir)
    return transform.pan_sharpen(c, part_pixels(spark, sf_dir), ["size", "price"], "price", g, method="pca", keys=["cell"])


# display ---------------------------------------------------------------------

_Q = "(SELECT quantile_cont(price, 0.02) AS a, quantile_cont(price, 0.98) AS z FROM p)"
_CUT = "CASE WHEN {e} < 0 THEN 0.0 WHEN {e} > 1 THEN 1.0 ELSE {e} END"


@query("stretch_lin", f"WITH p AS (SELECT * FROM {PART}) SELECT cell, {r(_CUT.format(e='((price - a) / (z - a))'), 'price')} FROM p, {_Q}")
def stretch_lin(spark, sf_dir):
    return rounded(display.stretch(part_pixels(spark, sf_dir).select("cell", "price"), ["price"]), ["price"])


@query("stretch_hist", f"SELECT cell, {r('cume_dist() OVER (ORDER BY size)', 'size')} FROM {PART}")
def stretch_hist(spark, sf_dir):
    return rounded(display.stretch(part_pixels(spark, sf_dir).select("cell", "size"), ["size"], "hist"), ["size"])


@query("stretch_log", f"WITH p AS (SELECT cell, ln(price + 1) AS v FROM {PART}) SELECT cell, {r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())', 'price')} FROM p")
def stretch_log(spark, sf_dir):
    return rounded(display.stretch(part_pixels(spark, sf_dir).select("cell", "price"), ["price"], "log"), ["price"])


@query("stretch_sqrt", f"WITH p AS (SELECT cell, sqrt(price) AS v FROM {PART}) SELECT cell, {r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())', 'price')} FROM p")
def stretch_sqrt(spark, sf_dir):
    return rounded(display.stretch(part_pixels(spark, sf_dir).select("cell", "price"), ["price"], "sqrt"), ["price"])


_HEX = "lpad(printf('%X', round_even({e} * 255, 0)::INT), 2, '0')"


@query("grey_frame", f"""WITH p AS (SELECT col + 0.5::DOUBLE AS x, -(row + 0.5)::DOUBLE AS y, size FROM {PART}), m AS (SELECT min(size) a, max(size) z FROM p)
SELECT x, y, size AS value, 'size' AS "layerName", '#' || H || 'FF' AS fill FROM (SELECT *, repeat({_HEX.format(e='((size - a) / (z - a))')}, 3) AS H FROM p, m)""")
def grey_frame(spark, sf_dir):
    return display.grey_frame(part_pixels(spark, sf_dir), ["size"], part_grid(spark, sf_dir))


@query("rgb_frame", f"""WITH p AS (SELECT col + 0.5::DOUBLE AS x, -(row + 0.5)::DOUBLE AS y, size / 50 AS r, least(greatest(price, 1000), 2000) / 50 AS g FROM {PART}), t AS (SELECT greatest(max(r), max(g)) AS t FROM p)
SELECT x, y, '#' || {_HEX.format(e='(r / t)')} || {_HEX.format(e='(g / t)')} || '00' || 'FF' AS fill FROM p, t""")
def rgb_frame(spark, sf_dir):
    img = part_pixels(spark, sf_dir).withColumn("size", F.col("size") / 50).withColumn("price", F.col("price") / 50)
    return display.rgb_frame(img, part_grid(spark, sf_dir), "size", "price", None, limits={"size": (0, 100), "price": (20, 40)})


@query("fortify", f"SELECT col + 0.5::DOUBLE AS x, -(row + 0.5)::DOUBLE AS y, size FROM {PART} WHERE row % (SELECT min(k) FROM range(1, 99) t(k) WHERE ceil(50 / k) * ceil((SELECT ceil((max(p_partkey) + 1) / 50) FROM part) / k) <= 500) = 0 AND col % (SELECT min(k) FROM range(1, 99) t(k) WHERE ceil(50 / k) * ceil((SELECT ceil((max(p_partkey) + 1) / 50) FROM part) / k) <= 500) = 0")
def fortified(spark, sf_dir):
    return fortify(part_pixels(spark, sf_dir), part_grid(spark, sf_dir), ["size"], 500)


@query("sample_regular", f"SELECT cell FROM {PART} WHERE row % (SELECT min(k) FROM range(1, 99) t(k) WHERE ceil(50 / k) * ceil((SELECT ceil((max(p_partkey) + 1) / 50) FROM part) / k) <= 300) = 0 AND col % (SELECT min(k) FROM range(1, 99) t(k) WHERE ceil(50 / k) * ceil((SELECT ceil((max(p_partkey) + 1) / 50) FROM part) / k) <= 300) = 0")
def regular(spark, sf_dir):
    return sample_regular(part_pixels(spark, sf_dir), part_grid(spark, sf_dir), 300).select("cell")
