"""URL filters by association rules.

A URL is a set of tokens: host labels, path words, query keys. Spark's
FP-growth mines the token sets that labelled pages share with a bad label; sets
with enough support and confidence become rules, less those that a subset of
them makes superfluous. Rules are matched by an inverted index: a page is
looked up by its tokens, and a rule fires where all of its tokens were found.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, col, spread

MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.001, 0.3, 1.25
#: Rows that FP-growth gets, about; it finds candidates, which are counted over all rows.
FIT_ROWS = 1_000_000


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted: scheme, host labels, directory words
    (no numbers), file extension, query keys, fragment and slash marks. Null for
    null; at least "other" for any text."""
    u = F.lower(F.trim(url))
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    tag = lambda t, x: F.when(x != "", F.concat(F.lit(t + "="), x))
    alone = F.array(
        tag("scheme", F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1)),
        tag("ext", F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)),
        F.when(F.contains(u, F.lit("#")), F.lit("fragment")),
        F.when(F.endswith(path, F.lit("/")), F.lit("slash")),
        F.lit("other"),
    )
    names = F.regexp_extract_all(host, F.lit(r"([^.]+)"), 1)
    dirs = F.regexp_extract_all(path, F.lit(r"/([a-z][a-z_-]*)"), 1)
    keys = F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), 1)
    under = lambda k: lambda t: F.concat(F.lit(k + "="), t)
    named = [F.transform(x, under(k)) for k, x in (("name", names), ("dir", dirs), ("key", keys))]
    return F.when(url.isNotNull(), F.array_sort(F.array_distinct(F.array_compact(F.concat(alone, *named)))))


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, fit_rows: int = FIT_ROWS) -> Table:
    """The written rules (rule, tokens, support, confidence) of labelled pages,
    whose column ``bad`` is boolean. Null labels and null URLs are left out.

    A token set is a rule if it and the bad label occur together in at least
    ``min_support`` of the rows, if the bad share of its rows is at least
    ``min_confidence`` and ``min_lift`` times the share of all rows, and if no
    proper subset that is a rule is as confident; of sets that are equally
    confident the smaller ones stay, and all of the same size. Without labelled
    rows, or without bad ones, there are no rules.

    All rows count. They are grouped by token set and label; with more than
    ``fit_rows`` bad ones FP-growth gets each group's rows in units of several,
    rounded up, so that it misses no set, and what it finds is counted again
    over all groups: the rules are the same for any ``fit_rows``."""
    spark = labelled.sparkSession
    rows = labelled.where(col(bad).isNotNull() & col(url).isNotNull()).select(url_tokens(col(url)).alias("tokens"), col(bad).alias("bad"))
    rows = Table(rows.groupBy("tokens", "bad").agg(F.count(F.lit(1)).alias("n")), "labelled").df
    rows = spread(rows)
    n, n_bad = rows.agg(F.sum("n"), F.sum(F.when(F.col("bad"), F.col("n")))).first()
    none = Table(spark.createDataFrame([], "rule long, tokens array<string>, support double, confidence double"), "rules")
    if not n or not n_bad:
        return none
    # a token of all rows is in no rule: without it the set is in as many, and alone it has no lift
    items = rows.where("bad").select(F.explode("tokens").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("count")).where(F.col("count") >= F.lit(min_support * n))
    if min_lift > 1:
        common = rows.select(F.explode("tokens").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("count")).where(F.col("count") == F.lit(n))
        items = items.join(common, "t", "left_anti")
    items = Table(items.select(F.col("t").alias("item")), "items")
    marked = rows.withColumn("r", F.monotonically_increasing_id()).select("r", "bad", "n", F.explode("tokens").alias("t"))
    basket = marked.join(items.small(), F.col("t") == F.col("item")).groupBy("r", "bad", "n").agg(F.array_sort(F.collect_set("t")).alias("tokens"))
    basket = Table(basket.groupBy("tokens", "bad").agg(F.sum("n").alias("n")), "baskets")
    # of the bad rows all sets that may be frequent; how often they occur is counted by matching
    unit = max(1, n_bad // fit_rows)
    copies = F.ceil(F.col("n") / F.lit(float(unit))).cast("long")
    bad_sets = basket.df.where("bad").select("tokens", copies.alias("copies"))
    total = bad_sets.agg(F.sum("copies")).first()[0]
    if not total:
        return none
    parts = bad_sets.select("tokens", "copies", F.explode(F.expr("sequence(0L, (copies - 1) div 1000)")).alias("part")).repartition(spark.sparkContext.defaultParallelism)
    bad_sets = parts.select("tokens", F.explode(F.expr("sequence(1L, least(1000L, copies - 1000 * part))")).alias("copy")).select("tokens")
    least = min_support * n / unit / total * (1 - 1e-9)  # one less by rounding is no loss
    found = FPGrowth(itemsCol="tokens", minSupport=min(1.0, max(least, 1e-12)), minConfidence=1.0).fit(bad_sets).freqItemsets
    sets = Table(found.select(F.array_sort("items").alias("tokens")).withColumn("rule", F.xxhash64("tokens")), "sets")
    times = match(spread(basket.df).withColumn("of", F.struct("bad", "n")), sets.df, "of").groupBy("rule").agg(F.sum("of.n").alias("all_n"), F.sum(F.when(F.col("of.bad"), F.col("of.n"))).alias("bad_n"))
    frequent = sets.df.join(times, "rule").where(F.col("bad_n") >= F.lit(min_support * n))
    confident = frequent.withColumn("confidence", F.col("bad_n") / F.col("all_n")).where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= F.lit(min_lift * n_bad / n)))
    confident = Table(confident.select("rule", "tokens", (F.col("bad_n") / F.lit(float(n))).alias("support"), "confidence"), "confident")
    c = confident.df
    # subsets are found by the same inverted index, with rules in the place of pages
    inside = match(c.select(F.col("rule").alias("of"), "tokens"), c, "of")
    worse = inside.join(c.select("rule", F.col("confidence").alias("c_small"), F.size("tokens").alias("n_small")), "rule").join(c.select(F.col("rule").alias("of"), F.col("confidence").alias("c_big"), F.size("tokens").alias("n_big")), "of")
    worse = worse.where("n_small < n_big AND c_small >= c_big").select(F.col("of").alias("rule")).distinct()
    return Table(c.join(worse, "rule", "left_anti"), "rules")


def match(pages: DataFrame, rules: DataFrame, name: str, tokens: str = "tokens") -> DataFrame:
    """(name, rule): the rules all of whose tokens a page has. The index holds each
    rule under the one of its tokens that fewest rules have; a page looks its
    tokens up and tests what it finds there, without a shuffle of pages."""
    held = rules.select("rule", F.col("tokens").alias("need"), F.explode("tokens").alias("token"))
    often = held.groupBy(F.col("token").alias("o")).agg(F.count(F.lit(1)).alias("times"))
    held = held.join(often, F.col("token") == F.col("o"))
    index = held.groupBy("rule").agg(F.min(F.struct("times", "token")).alias("least"), F.first("need").alias("need"))
    index = Table(index.select("rule", "need", F.col("least.token").alias("token")), "rule-index").small()
    seen = pages.select(F.col(name), F.col(tokens).alias("has"), F.explode(F.array_distinct(tokens)).alias("t"))
    hits = seen.join(index, F.col("t") == F.col("token"))
    return hits.where(F.size(F.array_except("need", "has")) == 0).select(name, "rule")


def label_pages(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """Pages with the labels of the documents that they show: the number at the
    path's end is the document's id. bad: of low quality or toxic."""
    doc = F.expr(f"try_cast(regexp_extract(`{url}`, '/([0-9]+)(?:[/.?#].*)?$', 1) AS BIGINT)")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    lab = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("shown")).agg(F.max(bad).alias("bad"))
    return pages.select(col(url).alias("url"), doc.alias("doc")).join(lab, F.col("doc") == F.col("shown")).select("url", "bad")


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, rules, confidence) of the pages on which a rule fires: how
    many fire, and the highest confidence.

    Pages are matched by distinct URL: rows of one URL get the same, repeated
    rows stay. Very long URLs are read whole. Null URLs match nothing; ids may be null or repeated. An empty
    table, or no rules, gives no rows. Extra columns are not read."""
    own = pages.where(col(url).isNotNull()).select(col(page_id).alias("page_id"), col(url).alias("url"))
    fired = match(own.select("url").distinct().select("url", url_tokens(F.col("url")).alias("tokens")), rules, "url")
    best = fired.join(rules.select("rule", "confidence"), "rule").groupBy(F.col("url").alias("u")).agg(F.count(F.lit(1)).alias("rules"), F.max("confidence").alias("confidence"))
    return own.join(best, F.col("url") == F.col("u")).select("page_id", "url", "rules", F.round("confidence", 6).alias("confidence"))
