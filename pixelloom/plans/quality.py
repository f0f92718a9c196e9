"""Queries of quality words, one-hot layers and clouds."""

from pyspark.sql import functions as F

from ..operators import clouds, focal, qa
from .registry import query
from .views import PART, part_pixels, r, read, rounded

_W = "(o_orderkey % 65536)::INT"
_WORDS = f"(SELECT o_orderkey, {_W} AS w FROM orders)"


def _words(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 65536).cast("int").alias("w"))


@query("qa_decode", f"SELECT o_orderkey, lpad(bin(w), 16, '0') AS bits FROM {_WORDS}")
def qa_decode(spark, sf_dir):
    return _words(spark, sf_dir).select("o_orderkey", qa.decode(F.col("w")).alias("bits"))


_BASE = "(w & 57344) = 0 AND (w & 15) = 0"


@query("qa_filter_word", f"SELECT o_orderkey FROM {_WORDS} WHERE {_BASE} AND ((w >> 5) & 3) IN (1, 3) AND ((w >> 9) & 3) = 1")
def qa_filter_word(spark, sf_dir):
    return _words(spark, sf_dir).where(qa.matches(F.col("w"), cloud=["low", "high"], snow="low")).select("o_orderkey")


@query("qa_classify", f"""SELECT o_orderkey, CASE WHEN {_BASE} AND ((w >> 9) & 3) = 3 THEN 4 WHEN {_BASE} AND ((w >> 11) & 3) = 3 THEN 3
  WHEN {_BASE} AND ((w >> 5) & 3) = 3 THEN 2 WHEN {_BASE} AND ((w >> 5) & 3) < 2 AND ((w >> 7) & 3) < 2 AND ((w >> 9) & 3) < 2 AND ((w >> 11) & 3) < 2 THEN 1 END::INT AS class FROM {_WORDS}""")
def qa_classify(spark, sf_dir):
    return qa.classify_frame(_words(spark, sf_dir), "w", ["o_orderkey"])


_LEVEL = "CASE WHEN {b} AND ((w >> {s}) & 3) > 0 THEN ((w >> {s}) & 3) END::INT AS \"{n}\""


@query("qa_confidence", f"SELECT o_orderkey, {', '.join(_LEVEL.format(b=_BASE, s=s, n=n) for n, s in (('cloud', 5), ('cloudShadow', 7), ('cirrus', 11), ('snow', 9)))} FROM {_WORDS}")
def qa_confidence(spark, sf_dir):
    return qa.classify_frame(_words(spark, sf_dir), "w", ["o_orderkey"], conf_layers=True)


@query("qa_encode", f"SELECT o_orderkey AS word FROM {_WORDS} WHERE o_orderkey <= 65535 AND (w & 63503) = 0 AND (w & 96) = 96")
def qa_encode(spark, sf_dir):
    """The words that flags allow, listed, among the orders' keys."""
    found = spark.createDataFrame([(w,) for w in qa.encode("TM", cloud="high")], "word long")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("word")).join(F.broadcast(found), "word", "left_semi")


@query("one_hot", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_linenumber = {k} THEN 1 ELSE 0 END::INT AS c_{k}" for k in (1, 2, 3)) + " FROM lineitem")
def one_hot(spark, sf_dir):
    return qa.one_hot(read(spark, sf_dir, "lineitem"), "l_linenumber", [1, 2, 3], ["l_orderkey", "l_linenumber"])


_CLOUD = f"""WITH p AS (SELECT *, size / 50 AS blue, price AS tir FROM {PART}), s AS (SELECT min(blue) b0, max(blue) b1, min(tir) t0, max(tir) t1 FROM p),
t AS (SELECT p.*, (tir - t0) * ((b1 - b0) / nullif(t1 - t0, 0)) + b0 AS warm FROM p, s),
n AS (SELECT cell, row, col, (blue - warm) / nullif(blue + warm, 0) AS v FROM t)"""


@query("ndtci", f"{_CLOUD} SELECT cell, {r('v', 'NDTCI')} FROM n")
def ndtci(spark, sf_dir):
    df = part_pixels(spark, sf_dir).withColumn("blue", F.col("size") / 50)
    return rounded(clouds.ndtci(df, "blue", "price").select("cell", "NDTCI"), ["NDTCI"])


def _clouds(spark, sf_dir, buffer=None):
    df = part_pixels(spark, sf_dir).withColumn("blue", F.col("size") / 50)
    return clouds.cloud_mask(df, 0.6, "blue", "price", buffer, ["cell", "row", "col"])


@query("cloud_mask", f"{_CLOUD} SELECT cell, CASE WHEN v >= 0.6 THEN 1.0::DOUBLE END AS \"CMASK\", {r('v', 'NDTCI')} FROM n")
def cloud_mask(spark, sf_dir):
    return rounded(_clouds(spark, sf_dir).drop("row", "col"), ["NDTCI"])


@query("dilate", f"""{_CLOUD} SELECT cell, CASE WHEN EXISTS (SELECT 1 FROM n m WHERE m.v >= 0.6 AND m.row BETWEEN n.row - 1 AND n.row + 1 AND m.col BETWEEN n.col - 1 AND n.col + 1
  AND NOT (abs(m.row - n.row) = 1 AND abs(m.col - n.col) = 1)) THEN 1.0::DOUBLE END AS "CMASK" FROM n""")
def dilate(spark, sf_dir):
    return _clouds(spark, sf_dir, 3).select("cell", "CMASK")


@query("cloud_shadow", f"{_CLOUD} SELECT n.cell, CASE WHEN c.v >= 0.6 THEN 0.0::DOUBLE END AS \"CSMASK\" FROM n LEFT JOIN n c ON c.row = n.row + 2 AND c.col = n.col - 3")
def cloud_shadow(spark, sf_dir):
    img = part_pixels(spark, sf_dir)
    mask = _clouds(spark, sf_dir)
    out = clouds.cloud_shadow_mask(img, mask, ["size"], precise_shift=(3, 2))
    return out.join(img.select("row", "col", "cell"), ["row", "col"]).select("cell", "CSMASK")


_SHIFTS = [(round(3 + k / 2), round(2 + k / 2)) for k in range(-6, 7)]
_SEARCH = f"""{_CLOUD}, m AS (SELECT cell, row, col, coalesce(v >= 0.6, false)::INT AS v FROM n), f AS (SELECT row, col, (size < (SELECT quantile_cont(size, 0.2) FROM p))::INT AS v FROM p),
x(i, dx, dy) AS (VALUES {', '.join(f'({i}, {x}, {y})' for i, (x, y) in enumerate(_SHIFTS))}),
j AS (SELECT i, dx, dy, m.v AS a, f.v AS b, count(*) AS k FROM x, m JOIN f ON f.row = m.row - dy AND f.col = m.col + dx GROUP BY ALL),
w AS (SELECT i, dx, dy, sum(k / t * ln(k * t / (ka::DOUBLE * kb))) AS mi FROM (SELECT *, sum(k) OVER (PARTITION BY i) AS t, sum(k) OVER (PARTITION BY i, a) AS ka, sum(k) OVER (PARTITION BY i, b) AS kb FROM j) GROUP BY ALL),
best AS (SELECT dx, dy FROM w ORDER BY round(mi, 12) DESC, i LIMIT 1)"""


@query("cloud_shadow_search", f"{_SEARCH} SELECT n.cell, CASE WHEN c.v = 1 THEN 0.0::DOUBLE END AS \"CSMASK\" FROM n CROSS JOIN best LEFT JOIN m c ON c.row = n.row + dy AND c.col = n.col - dx")
def cloud_shadow_search(spark, sf_dir):
    """The shift is searched around an estimate."""
    img = part_pixels(spark, sf_dir)
    out = clouds.cloud_shadow_mask(img, _clouds(spark, sf_dir), ["size"], shift_estimate=(3, 2))
    return out.join(img.select("row", "col", "cell"), ["row", "col"]).select("cell", "CSMASK")


@query("focal_majority", f"SELECT p.cell, (SELECT m.size FROM {PART} m WHERE m.row = p.row AND m.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY m.size ORDER BY count(*) DESC, m.size LIMIT 1) AS major FROM {PART} p")
def focal_majority(spark, sf_dir):
    img = part_pixels(spark, sf_dir)
    out = focal.focal(img, "size", [(0, -1), (0, 0), (0, 1)], focal.majority, "major")
    return out.join(img.select("row", "col", "cell"), ["row", "col"]).select("cell", "major")
