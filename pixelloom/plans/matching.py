"""Queries of matching and registration."""

from pyspark.sql import functions as F

from ..grid import crop, shift
from ..operators import match, register
from .registry import query
from .views import PART, emb, emb_pixels, part_pixels, r, rounded

_MM = "min(size) OVER () AS x0, max(size) OVER () AS x1"


@query("rescale_minmax", f"SELECT cell, {r('(size - x0) / (x1 - x0) * 255', 'size')}, {r('(price - y0) / (y1 - y0) * 255', 'price')} FROM (SELECT *, {_MM}, min(price) OVER () AS y0, max(price) OVER () AS y1 FROM {PART})")
def rescale_minmax(spark, sf_dir):
    return rounded(match.rescale(part_pixels(spark, sf_dir), ["size", "price"], ["cell"], ymax=255.0), ["size", "price"])


@query("rescale_to", f"SELECT cell, {r('(size - x0) / (x1 - x0) * (y1 - y0) + y0', 'size')} FROM (SELECT *, {_MM} FROM {PART}), (SELECT min(l_quantity) / 2 AS y0, max(l_quantity) / 2 AS y1 FROM lineitem)")
def rescale_to(spark, sf_dir):
    to = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") / 2).alias("size"))
    return rounded(match.rescale(part_pixels(spark, sf_dir), ["size"], ["cell"], to=to), ["size"])


@query("normalise", f"SELECT cell, {r('(size - m) / s', 'size')} FROM {PART}, (SELECT avg(size) AS m, stddev_samp(size) AS s FROM {PART})")
def normalise(spark, sf_dir):
    return rounded(match.normalise(part_pixels(spark, sf_dir), ["size"], ["cell"]), ["size"])


@query("centre", f"SELECT cell, {r('size - m', 'size')} FROM {PART}, (SELECT avg(size) AS m FROM {PART})")
def centre(spark, sf_dir):
    return rounded(match.normalise(part_pixels(spark, sf_dir), ["size"], ["cell"], scale=False), ["size"])


_HIST = f"""WITH p AS (SELECT * FROM {PART}), q AS (SELECT l_quantity * 1.5 + l_linenumber AS v FROM lineitem),
x AS (SELECT DISTINCT size AS v, cume_dist() OVER (ORDER BY size) AS p FROM p), y AS (SELECT DISTINCT v, cume_dist() OVER (ORDER BY v) AS p FROM q),
z AS (SELECT v, p, lead(v) OVER (ORDER BY v) AS v2, lead(p) OVER (ORDER BY v) AS p2 FROM y),
m AS (SELECT v, coalesce((SELECT CASE WHEN p2 IS NULL THEN z.v ELSE z.v + (x.p - z.p) / (p2 - z.p) * (v2 - z.v) END FROM z WHERE z.p <= x.p ORDER BY z.p DESC LIMIT 1), (SELECT min(v) FROM y)) AS w FROM x)"""


@query("hist_match", f"{_HIST} SELECT cell, {r('w', 'size', 4)} FROM p JOIN m ON p.size = m.v")
def hist_match(spark, sf_dir):
    ref = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") * 1.5 + F.col("l_linenumber")).alias("size"))
    return rounded(match.hist_match(part_pixels(spark, sf_dir), ref, ["size"], ["cell"]), ["size"], 4)


def _pair(spark, sf_dir):
    """Two four-band images of the same cells: eight elements of the embeddings."""
    e = emb_pixels(spark, sf_dir, 8)
    img = e.select("vec_id", *[f"b{i}" for i in range(4)])
    return img, e.select("vec_id", *[(F.col(f"b{i}") * 0.9 + F.col(f"b{i + 4}") * 0.3 + 0.1).alias(f"b{i}") for i in range(4)])


_REF = ", ".join(f"b{i} * 0.9 + b{i + 4} * 0.3 + 0.1 AS r{i}" for i in range(4))
_MB, _MR = "((b0 + b1 + b2 + b3) / 4)", "((r0 + r1 + r2 + r3) / 4)"
_cc = lambda a, ma, b, mb: "(" + " + ".join(f"({a}{i} - {ma}) * ({b}{i} - {mb})" for i in range(4)) + ")"
_COR = f"{_cc('b', _MB, 'r', _MR)} / nullif(sqrt({_cc('b', _MB, 'b', _MB)} * {_cc('r', _MR, 'r', _MR)}), 0)"
_dd = lambda a, b: "(" + " + ".join(f"{a}{i} * {b}{i}" for i in range(4)) + ")"
_SIM = {"cor": _COR, "sam": f"-acos(least(1.0, {_dd('b', 'r')} / nullif(sqrt({_dd('b', 'b')} * {_dd('r', 'r')}), 0)))", "ed": "-sqrt(" + " + ".join(f"(b{i} - r{i}) * (b{i} - r{i})" for i in range(4)) + ")"}


def _pif(method):
    sql = f"""WITH e AS (SELECT *, {_REF} FROM {emb(8)}), s AS (SELECT *, {_SIM[method]} AS s FROM e), c AS (SELECT quantile_cont(s, 0.9) AS c FROM s),
k AS (SELECT {', '.join(f'regr_slope(r{i}, b{i}) AS k{i}, regr_intercept(r{i}, b{i}) AS a{i}' for i in range(4))} FROM s, c WHERE s > c)
SELECT vec_id, {', '.join(r(f'b{i} * k{i} + a{i}', f'b{i}', 5) for i in range(4))} FROM e, k"""

    def run(spark, sf_dir):
        img, ref = _pair(spark, sf_dir)
        return rounded(match.pif_match(img, ref, [f"b{i}" for i in range(4)], ["vec_id"], method, 0.9), [f"b{i}" for i in range(4)], 5)

    query("pif_match" if method == "cor" else f"pif_match_{method}", sql)(run)


for _m in _SIM:
    _pif(_m)


@query("coregister_mi", f"""WITH a AS (SELECT row, col, b0 FROM {emb(1)}), e AS (SELECT min(b0) AS lo, max(b0) AS hi FROM a),
k AS (SELECT row, col, greatest(0, least(9, ceil((b0 - lo) / ((hi - lo) / 10)) - 1))::INT AS k FROM a, e),
s AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
j AS (SELECT dx, dy, m.k AS mb, f.k AS fb, count(*) AS n FROM k f, s, k m WHERE m.row = f.row + dy AND m.col = f.col + 1 - dx GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY dx, dy) AS t, sum(n) OVER (PARTITION BY dx, dy, mb) AS a, sum(n) OVER (PARTITION BY dx, dy, fb) AS c FROM j)
SELECT dx::INT AS dx, dy::INT AS dy, {r('sum(n / t * ln(n * t / (a * c)))', 'mi')} FROM p GROUP BY dx, dy""")
def coregister_mi(spark, sf_dir):
    """The information at each shift of an image against itself moved by a column."""
    e = emb_pixels(spark, sf_dir, 1).select("row", "col", "b0")
    fixed = e.withColumn("col", F.col("col") + 1)
    return rounded(register.mutual_information(e, fixed, ["b0"], register.shift_grid(1), 10).select("dx", "dy", "mi"), ["mi"])


@query("coregister", f"SELECT vec_id, row, (col + 1)::INT AS col FROM {emb(1)}")
def coregister(spark, sf_dir):
    e = emb_pixels(spark, sf_dir, 1).select("vec_id", "row", "col", "b0")
    return register.coregister(e, e.withColumn("col", F.col("col") + 1), ["b0"], 2, n_bins=20).select("vec_id", "row", "col")


@query("shift", f"SELECT cell, (col + 2.0)::DOUBLE AS x, (-(row + 0.5) - 3)::DOUBLE AS y FROM {PART}")
def shifted(spark, sf_dir):
    return shift(part_pixels(spark, sf_dir), 1.5, -3).select("cell", "x", "y")


@query("crop", f"SELECT cell FROM {PART} WHERE col + 0.5 >= 3 AND col + 0.5 < 20 AND -(row + 0.5) > -12 AND -(row + 0.5) <= -2")
def cropped(spark, sf_dir):
    return crop(part_pixels(spark, sf_dir), (3, 20, -12, -2)).select("cell")
