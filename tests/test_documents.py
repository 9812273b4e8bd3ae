"""Documents of the plain tables, and what is asked of them document by document."""

import copy
import os
from random import Random

import pytest
from pyspark.sql import functions as F

from quillstone.plans import alternatives, documents, equality, obligations, shapes, table_contracts, table_shapes
from quillstone.sources import nodes as tree
from quillstone.sources.scratch import cut
from tests.test_shapes import documents as written
from tests.test_shapes import schema_documents

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_lines_are_dealt_once_and_documents_are_those_of_sql(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(table_contracts, "LINES", 500)
    docs = table_contracts.written(spark, SF)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    n = max(-(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500), 4)
    assert plan.count("Exchange hashpartitioning") == 1 and f", {n}), REPARTITION_BY_NUM" in plan
    con = duckdb.connect()
    for t in table_contracts.TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    assert sorted(map(tuple, docs.collect())) == sorted(con.sql(table_contracts.in_duckdb("", "SELECT file, side, body FROM documents_")).fetchall())


def two_sided(seed, n):
    """Documents of both sides: schemas that went, changed or moved, with sites in lists, in paths and in mappings."""
    r, out = Random(seed), []
    for f, side, doc in schema_documents(seed, n):
        names = list(doc["components"]["schemas"])
        at = lambda: {"$ref": "#/components/schemas/" + r.choice(names)}  # noqa: E731, B023
        doc["paths"] = {"/a~b": {"get": {"schema": at()}}, "/c": {"parameters": [at(), {"x": 1.50}, at()]}}
        doc["definitions"] = {r.choice(names): at(), "Own/er": {"discriminator": {"mapping": {"m": "#/components/schemas/" + names[0], "n": "elsewhere"}}}}
        new = copy.deepcopy(doc)
        for name in r.sample(names, r.randrange(1, len(names))):
            body = new["components"]["schemas"].pop(name)
            if r.random() < 0.5:
                # what stood behind the name stands at a place that referred to it
                new["paths"]["/c"]["parameters"].insert(0, body)
        out += [(f, side, doc), (f, "new", new)] if r.random() < 0.9 else [(f, side, doc)]
    return [*out, ("broken", "old", "{no json"), ("broken", "new", "{}"), ("null", "old", "null")]


@pytest.fixture(scope="module")
def sides(spark):
    docs = cut(written(spark, two_sided(11, 80)).select("file", "side", "body"))
    return docs, shapes.Graph(tree.node_table(docs))


def rows(df, *columns):
    found = [tuple(x) for x in df.select(*columns).collect()]
    return sorted(found, key=repr)


def test_shapes_of_a_document_are_those_of_the_node_table(sides):
    docs, graph = sides
    got = documents.asked(docs, "schema string, shape string", lambda g: documents.shapes(g, g.objects).items())
    want = rows(shapes.shapes(graph), "file", "side", "schema", "shape")
    assert rows(got, "file", "side", "schema", "shape") == want and len(want) > 2000


def test_obligations_of_a_document_are_those_of_the_node_table(sides):
    docs, graph = sides
    got = documents.asked(docs, "schema string, name string", lambda g: [(p, x) for p, names in documents.obligations(g).items() if p in g.objects for x in names])
    want = rows(obligations.obligations(graph), "file", "side", "schema", "name")
    assert rows(got, "file", "side", "schema", "name") == want and len(want) > 300


def test_alternatives_of_a_document_are_those_of_the_node_table(sides):
    docs, graph = sides
    arms = F.array_sort(F.transform("all_", lambda a: F.to_json(a)))
    want = alternatives.alternatives(graph).select("file", "side", "schema", arms.alias("all_"), F.array_sort(F.transform("least", lambda x: F.array_join(F.array_sort(x), ","))).alias("least"), "undecided")
    got = {}
    for x in docs.select("file", "side", F.to_json(F.try_parse_json("body")).alias("body")).collect():
        for place, a in documents.alternatives(documents.Schemas(documents.read(x.body))).items():
            all_ = None if a.all_ is None else sorted(str((t, sorted(names), [(n, list(v)) for n, v in pins])) for t, names, pins in a.all_)
            got[x.file, x.side, place] = (all_, None if a.least is None else sorted(",".join(sorted(n)) for n in a.least), a.least is None)
    import json

    plain = lambda a: (lambda d: str((d.get("type"), sorted(d["names"]), [(p["name"], p["values"]) for p in d["pins"]])))(json.loads(a))
    there = {(x.file, x.side, x.schema): (None if x.all_ is None else sorted(map(plain, x.all_)), None if x.least is None else sorted(x.least), x.undecided) for x in want.collect()}
    assert got == there and sum(x[2] for x in there.values()) > 10


def test_equal_schemas_of_a_file_are_those_of_the_node_table(sides):
    docs, graph = sides
    pairs = lambda was, now: [(a, b, was[a] == now[b]) for a in was for b in now if a.count("/") == b.count("/") == 3]
    got = documents.asked_by_file(docs, "a string, b string, same boolean", lambda old, new: pairs(*documents.classes(old, new)))
    found = equality.classes(graph)
    of = lambda side, c: found.where((F.col("side") == side) & (F.size(F.split("schema", "/")) == 4)).select("file", F.col("schema").alias(c), F.col("class").alias(side))
    want = rows(of("old", "a").join(of("new", "b"), "file").select("file", "a", "b", (F.col("old") == F.col("new")).alias("same")), "file", "a", "b", "same")
    assert rows(got, "file", "a", "b", "same") == want and 100 < sum(x[3] for x in want) < len(want) - 100


def test_removed_schemas_of_a_file_are_those_of_the_node_table(sides):
    docs, graph = sides
    columns = ["name", "sites", "kept", "inside", "lost"]
    got = documents.asked_by_file(docs, "name string, sites bigint, kept bigint, inside bigint, lost bigint", documents.removed_schemas)
    want = rows(tree.removed_schemas(graph.nodes, graph.refs, graph.ends), "file", *columns)
    assert rows(got, "file", *columns) == want and all(sum(x[k] for x in want) > 10 for k in range(2, 6))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", ["contract_equal_schemas", "contract_promises", "contract_shapes", "contract_obligations", "contract_schema_removals"])
def test_questions_of_documents_take_no_rounds(spark, name):
    spark.sparkContext.setJobGroup(name, "questions of documents")
    table_shapes.QUERIES[name](spark, SF).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) < 10
