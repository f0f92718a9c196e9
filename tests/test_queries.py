"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from pixelloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.oracle_sql():
        assert rows
        return
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


EXPRESSIONS = ["idx_family", "idx_custom", "qa_classify", "rad_sdos", "tasseled_cap", "sam_class", "cva", "entropy", "pca_scores", "kmeans_assign", "mlc_scores", "dilate", "topo_cos", "hist_match", "rgb_frame"]


@pytest.mark.parametrize("name", EXPRESSIONS)
def test_no_python_in_the_plan(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"))


def test_only_needed_columns_are_read(spark):
    plan = catalog.queries()["idx_flag_means"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_tax:double,l_returnflag:string>" in plan
