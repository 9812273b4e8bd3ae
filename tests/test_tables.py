"""Each table query against its SQL, on the smallest tables."""

import os

import pytest

from quillstone.plans import table_code, table_drift, table_shapes, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(r[k]) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in tables.QUERIES if n in tables.SQL])
def test_query_matches_sql(spark, duck, name):
    df = tables.QUERIES[name](spark, SF)
    found = duck.sql(tables.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), list(found.columns))


def test_closure_of_real_keys_against_brute_force(spark, tmp_path):
    pairs = [(1000 + k, 7) for k in range(60)] + [(7, 8), (8, 9), (9, 7), (9, 9), (9, 5000), (5000, 1003)]
    spark.createDataFrame(pairs, "l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(a, b) for a, b in pairs if a != b}
    want = {(a, a) for a, _ in edges}
    while more := {(r, b) for r, n in want for a, b in edges if n == a} - want:
        want |= more
    assert sorted(map(tuple, tables.closure_full_keys(spark, str(tmp_path)).collect())) == sorted(want)


def test_entry_imports():
    import __spark_entry__

    assert table_code.table_drift is table_drift and table_shapes.QUERIES is tables.QUERIES and {"path_match", "drift_operations", "contract_shapes"} <= set(tables.QUERIES)
    assert set(tables.QUERIES) <= set(__spark_entry__.queries()) and set(tables.SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_facts_that_sort_are_dealt_by_their_group(spark, monkeypatch):
    facets = ["op", "scheme", "schema_field"]
    assert [table_drift._from(f).split("FROM ")[1].split(" ")[0] for f in facets] == ["{op_key}", "{base}", "{schema}"]
    whole, before = table_drift.facts(spark, SF, facets), spark.conf.get(table_drift.PARTITIONS)
    monkeypatch.setattr(table_drift, "ROWS", 500)
    dealt = table_drift.facts(spark, SF, facets)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert n > 4 and plan.count("RepartitionByExpression") == 2 and f", {n}" in plan
    assert spark.conf.get(table_drift.PARTITIONS) == before and dealt.exceptAll(whole).isEmpty() and whole.exceptAll(dealt).isEmpty()
