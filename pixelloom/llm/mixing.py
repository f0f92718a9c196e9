"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are
range-sorted by it (key ranges are partitions, sorted locally), token counts
are summed along that order by distributed prefix sums, and the source is cut
where its budget is used up. A budget above the source's tokens repeats whole
epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, col, free_name, prefix_sums, word_count

#: Weights of the production mix by source; others get DEFAULT_WEIGHT.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
SEED = "mix-1"


def _key(seed: str, doc_id: Column, text: Column) -> Column:
    who = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    return F.md5(F.concat(F.lit(seed + "|"), who))


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    w = F.lit(float(default))
    for name, x in weights.items():
        w = F.when(source == F.lit(name), F.lit(float(x))).otherwise(w)
    return w


def _plan(docs: DataFrame, weights: dict, default: float, budget: int | None, seed: str, text: str, doc_id: str, source: str, tokens: Column | None) -> tuple[DataFrame, DataFrame]:
    """(documents' keys and running sums, each source's epochs and cut)."""
    n = word_count(col(text)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    narrow = Table(docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), n.alias("tokens"), _key(seed, col(doc_id), col(text)).alias("key")), "mix").df
    all_ = Window.partitionBy()  # of the sources' table, not of the documents
    w = _weight(F.col("source"), weights, default)
    total = F.sum("total").over(all_) if budget is None else F.lit(int(budget))
    per = (
        narrow.groupBy("source").agg(F.sum("tokens").alias("total"))
        .withColumn("weight", F.when(F.col("total") > 0, w).otherwise(0.0))
        .withColumn("budget", F.floor(total * F.try_divide(F.col("weight"), F.sum("weight").over(all_))).cast("long"))
        .select(F.col("source").alias("s"), F.expr("CASE WHEN total > 0 THEN budget div total ELSE 0 END").alias("epochs"), F.expr("CASE WHEN total > 0 THEN budget % total ELSE 0 END").alias("rest"))
    )
    per = Table(per, "mix-sources").small()
    sums = prefix_sums(narrow, ["source"], "key", ["tokens"], "tokens", "start")
    sums = Table(sums.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-sums").df
    # the documents that begin before the cut; the last of them crosses it
    cut = sums.where("start < rest").groupBy(F.col("source").alias("s")).agg(F.max("key").alias("cut"))
    return sums, Table(per.join(cut.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), "mix-cuts").small()


def mix_plan(docs: DataFrame, weights: dict = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget: int | None = None, seed: str = SEED, text: str = "text", doc_id: str = "doc_id", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, epoch, tokens, used): a row for each time that a document
    is taken. The ``used`` of a source sum to its budget exactly.

    A source's budget is floor(budget * its weight / the weights of all present
    sources that have tokens); budget defaults to the table's tokens. ``used``
    is less than ``tokens`` only in the document that crosses the budget, which
    is taken whole. Null sources form a source, of the default weight. Rows
    that share an id (or, where it is null, a text) share a key: they are taken
    together, fewer tokens first, with used 0 beyond the budget. Null and empty
    texts have 0 tokens and are taken with the keys around them. A source
    without tokens, or an empty table, gives no rows. ``tokens`` is a document's
    token count (words by default, 0 where it is null; ``token_counts.token_count``
    gives a tokenizer's). Very long texts are counted whole. Ids keep their type.
    No columns but the three named and those of ``tokens`` are read, whatever the
    others' names."""
    sums, cuts = _plan(docs, weights, default_weight, budget, seed, text, doc_id, source, tokens)
    cuts = cuts.select("s", "cut")
    taken = sums.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("last", F.col("epochs") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0))
    rows = taken.where("last > 0").select("doc_id", "source", "tokens", "start", "rest", "epochs", F.explode(F.expr("sequence(1L, last)")).alias("epoch"))
    used = F.when(F.col("epoch") <= F.col("epochs"), F.col("tokens")).otherwise(F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("start"))))
    return rows.select("doc_id", "source", "epoch", "tokens", used.cast("long").alias("used"))


def mix(docs: DataFrame, weights: dict = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget: int | None = None, seed: str = SEED, text: str = "text", doc_id: str = "doc_id", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """The documents as ``mix_plan`` takes them, whole and with all their columns:
    a row for each epoch. The texts are not shuffled: a document's key against
    its source's cut tells how often it is taken."""
    _, cuts = _plan(docs, weights, default_weight, budget, seed, text, doc_id, source, tokens)
    names = {n: free_name(docs, n) for n in ("mix_s", "mix_cut", "mix_epochs")}
    cuts = cuts.select(F.col("s").alias(names["mix_s"]), F.col("cut").alias(names["mix_cut"]), F.col("epochs").alias(names["mix_epochs"]))
    times = F.col(names["mix_epochs"]) + F.when(_key(seed, col(doc_id), col(text)) <= F.col(names["mix_cut"]), 1).otherwise(0)
    out = docs.join(cuts, col(source).eqNullSafe(F.col(names["mix_s"])))
    return out.where(times > 0).select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(names["mix_s"])).drop(names["mix_s"])


def mix_sql(weights: dict = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, seed: str = SEED, table: str = "documents") -> str:
    """DuckDB's SQL for ``mix_plan`` over a table, with the table's tokens as budget."""
    from .common import WORD_COUNT_SQL

    cases = " ".join(f"WHEN source = '{k}' THEN {float(v)}" for k, v in weights.items())
    return f"""
WITH d AS (SELECT doc_id, source, {WORD_COUNT_SQL} AS tokens,
        md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))) AS key FROM {table}),
p AS (SELECT source AS s, sum(tokens)::BIGINT AS total, CASE WHEN sum(tokens) = 0 THEN 0.0::DOUBLE {cases} ELSE {float(default_weight)} END::DOUBLE AS weight FROM d GROUP BY source),
b AS (SELECT s, total, floor((sum(total) OVER ())::DOUBLE * (weight / nullif(sum(weight) OVER (), 0)))::BIGINT AS budget FROM p),
e AS (SELECT s, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS epochs, CASE WHEN total > 0 THEN budget % total ELSE 0 END AS rest FROM b),
r AS (SELECT d.*, epochs, rest, sum(tokens) OVER (PARTITION BY source ORDER BY key, tokens ROWS UNBOUNDED PRECEDING) - tokens AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.s),
c AS (SELECT *, max(key) FILTER (WHERE start < rest) OVER (PARTITION BY source) AS cut FROM r),
t AS (SELECT *, epochs + CASE WHEN key <= cut THEN 1 ELSE 0 END AS last FROM c),
x AS (SELECT *, unnest(range(1, last + 1)) AS epoch FROM t WHERE last > 0)
SELECT doc_id, source, epoch::BIGINT AS epoch, tokens,
       CASE WHEN epoch <= epochs THEN tokens ELSE greatest(0, least(tokens, rest - start)) END::BIGINT AS used FROM x"""
