"""The pipeline, stage by stage, and the queries' registration."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pixelloom.llm import mixing, packing, queries
from test_dedup import brute_pairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage over the small table."""
    out, d = [], tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        now = f(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
        now.write.parquet(f"{d}/{k}")
        new = spark.read.parquet(f"{d}/{k}")
        out.append((name, docs.collect(), new.collect()))
        docs = new
    return out


def test_stages(stages):
    assert [s[0] for s in stages] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    for (_, _, a), (_, b, _) in zip(stages, stages[1:]):
        assert Counter(a) == Counter(b)


def test_exact_stage_keeps_the_first_of_each_text(stages):
    _, before, after = stages[1]
    want = {}
    for r in before:
        want[r.text] = min(want.get(r.text, r), r, key=lambda x: x.doc_id)
    assert Counter(after) == Counter(want.values())


def test_near_stage_keeps_one_of_each_group(stages):
    _, before, after = stages[2]
    kept = {r.doc_id for r in after}
    sim = brute_pairs([(r.doc_id, r.text) for r in before])
    near = [p for p, j in sim.items() if j >= 0.65]
    assert not [p for p in near if p[0] in kept and p[1] in kept]
    loose = {i for p, j in sim.items() if j >= 0.45 for i in p}
    assert {r.doc_id for r in before} - kept <= loose
    assert set(after) <= set(before)


def test_mixing_stage_takes_whole_documents(stages, spark):
    _, before, after = stages[3]
    df = spark.createDataFrame(before)
    plan = Counter(r.doc_id for r in mixing.mix_plan(df).collect())
    assert Counter(r.doc_id for r in after) == plan and set(after) <= set(before)


def test_packing_stage_packs_what_mixing_gave(stages):
    _, before, after = stages[4]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    assert sum(r.length for r in after) == sum(len(r.text.split()) + 1 for r in before)
    load = Counter()
    for r in after:
        load[r.pack] += r.length
    assert max(load.values()) <= packing.MAX_LENGTH


def test_run_is_the_stages(stages, spark):
    got = corpus_pipeline.run(spark, SF)
    want = Counter((r.doc_id, r.piece, r.start, r.length) for r in stages[-1][2])
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got.collect()) == want


def test_pipeline_with_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_nulls_and_repeated_rows(spark):
    rows = [(1, "the one of them is here and it was good for all", "en", "a", 47)] * 2 + [(None, None, None, None, None), (2, "", "en", None, 0), (None, "x y z the of", None, None, None), (3, "and the word " * 30000, "en", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in corpus_pipeline.STAGES[1:]:
        f(spark, df, SF).collect()
    docs = df
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} <= {1, None, 3}


def test_stages_with_ids_of_text_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = docs.withColumn("doc_id", F.concat(F.lit("https://x.org/"), "doc_id")).withColumns({c: F.lit(1) for c in ("node", "key", "mix_s", "digest", "first", "near_h", "rank", "n")}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    plain = docs
    for name, f in corpus_pipeline.STAGES[:3]:
        named, plain = f(spark, named, SF), f(spark, plain, SF)
    assert named.columns == docs.columns + ["node", "key", "mix_s", "digest", "first", "near_h", "rank", "n", "tags"]
    # groups are the same ones; which id of a group is the least differs
    assert named.count() == plain.count()
    assert corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, named, SF), SF).count() > 0


def test_ten_queries_are_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert {*names, "pipeline"} <= set(__spark_entry__.queries()) and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert Counter(tuple(r) for r in got.select(*rel.columns).collect()) == Counter(rel.fetchall())
