"""As-of joins, samples and classes of equal schemas against brute force."""

import datetime
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph, sampling, temporal
from quillstone.plans import equality, shapes
from quillstone.sources import nodes as tree
from tests.test_drift import ref
from tests.test_shapes import all_schemas, at, documents, schema_documents


@pytest.mark.parametrize("hot", [0, 0.9])
def test_as_of_against_brute_force(spark, hot):
    r = Random(3)
    key = lambda: "hot" if r.random() < hot else r.choice(["a", "b", "c", None])
    when = lambda: None if r.random() < 0.03 else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=r.randrange(200))
    left = [(k, key(), when(), "l") for k in range(400)]
    right = [(key(), when(), f"{k:04d}", r.choice([None, "v", "w"]), "r") for k in range(300)]
    a = spark.createDataFrame([*left, left[0]], "id int, k string, t timestamp, value string").repartition(3)
    b = spark.createDataFrame(right, "k string, s timestamp, tie string, found string, value string").repartition(3)
    got = Counter((x.id, x.k, x.t, x.value, x.tie, x.found) for x in temporal.as_of(a, b, "k", "t", "s", ["tie", "found"], "tie").collect())
    want = Counter()
    for i, k, t, v in [*left, left[0]]:
        best = max(((s, tie, f) for rk, s, tie, f, _ in right if k is not None and t is not None and rk == k and s is not None and s <= t), key=lambda x: x[:2], default=(None,) * 3)
        want[i, k, t, v, best[1], best[2]] += 1
    assert got == want
    assert temporal.as_of(a.limit(0), b, "k", "t", "s", ["found"], "tie").count() == 0
    assert temporal.as_of(a, b.limit(0), "k", "t", "s", ["found"], "tie").where("found IS NOT NULL").count() == 0


def test_samples_are_the_same_under_any_partitioning(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("stratum"), F.col("id").alias("name"), F.lit("x").alias("_rank_")).unionByName(spark.range(4).select(F.lit(None).cast("bigint").alias("stratum"), F.col("id").alias("name"), F.lit("x").alias("_rank_")))
    take = lambda d, seed=1: sorted((-1 if x.stratum is None else x.stratum, x.name) for x in sampling.bottom_k(d, ["stratum"], ["name"], 20, seed).collect())
    one = take(rows.coalesce(1))
    assert one == take(rows.repartition(7)) == take(rows.orderBy(F.desc("name")))
    assert Counter(s for s, _ in one) == {0: 20, 1: 20, 2: 20, -1: 4} and one != take(rows, 2)
    draws = {x.name: x.d for x in rows.select("name", sampling.keyed(1, "name").alias("d")).collect()}
    assert {n for s, n in one if s == 1} == set(sorted((n for n in range(5000) if n % 3 == 1), key=draws.get)[:20])
    assert take(rows.limit(0)) == [] and sampling.bottom_k(rows, ["stratum"], ["name"], 0, 1).count() == 0
    # over many seeds every row is as likely as any other
    hits = Counter(x.name for seed in range(40) for x in sampling.bottom_k(spark.range(50).select(F.lit(1).alias("stratum"), F.col("id").alias("name")), ["stratum"], ["name"], 25, seed).collect())
    assert len(hits) == 50 and all(7 <= n <= 33 for n in hits.values())


def unfolds_alike(da, a, db, b, seen=frozenset()):
    """Whether two schemas are the same as deep as one looks."""
    for _ in range(9):
        if isinstance(a, dict) and "$ref" in a:
            a = at(da, a["$ref"][1:])
        if isinstance(b, dict) and "$ref" in b:
            b = at(db, b["$ref"][1:])
    stuck = [not isinstance(x, dict) or "$ref" in x for x in (a, b)]
    if any(stuck):
        return all(stuck)
    if (id(a), id(b)) in seen:
        return True
    seen = seen | {(id(a), id(b))}
    keys = ("type", "nullable", "const")
    norm = lambda x: ([x.get(k) if k != "nullable" else x.get(k) is True for k in keys], sorted(set(x.get("enum", []))), sorted(x.get("properties", {})), sorted(set(x.get("required", []))), [k in x for k in ("allOf", "oneOf", "anyOf", "items")])
    if norm(a) != norm(b):
        return False
    alike = lambda x, y: unfolds_alike(da, x, db, y, seen)
    if not all(alike(v, b["properties"][k]) for k, v in a.get("properties", {}).items()) or ("items" in a and not alike(a["items"], b["items"])):
        return False
    return all(all(any(alike(x, y) for y in b.get(k, [])) for x in a.get(k, [])) and all(any(alike(x, y) for x in a.get(k, [])) for y in b.get(k, [])) for k in ("allOf", "oneOf", "anyOf"))


def test_equal_schemas_circles_included(spark):
    chain = lambda n: {"components": {"schemas": {f"C{k}": {"type": "object", "properties": {"next": ref(f"C{(k + 1) % n}")}} for k in range(n)}}}
    docs = [("ring1", "old", chain(1)), ("ring3", "old", chain(3)), *schema_documents(11, 12)]
    broken = chain(3)
    broken["components"]["schemas"]["C2"]["properties"]["next"] = {"type": "object", "properties": {"next": {"type": "string"}}}
    docs.append(("open", "old", broken))
    graph = shapes.Graph(tree.node_table(documents(spark, docs)))
    got = {(x.file, x.schema): x["class"] for x in equality.classes(graph).collect()}
    rings = {got[f, f"/components/schemas/C{k}"] for f, n in (("ring1", 1), ("ring3", 3)) for k in range(n)}
    assert len(rings) == 1 and not rings & {got["open", f"/components/schemas/C{k}"] for k in range(3)}
    named = [(f, p, d, at(d, p)) for f, _, d in docs for p in all_schemas(d) if p.count("/") == 3]
    assert len(named) > 40
    for f, p, d, a in named:
        for g, q, e, b in named:
            assert (got[f, p] == got[g, q]) == unfolds_alike(d, a, e, b), (f, p, g, q)


def test_two_hops_by_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 2)
    rng = Random(5)
    edges = [(rng.randrange(30), rng.randrange(12)) for _ in range(90)] + [(1, 1), (1, 2), (1, 2)]
    to = {a: {d for s, d in edges if s == a} for a, _ in edges}
    want = {}
    for a in to:
        for node, hops in [(a, 0), *((b, 1) for b in to[a]), *((c, 2) for b in to[a] for c in to.get(b, ()))]:
            want[a, node] = min(hops, want.get((a, node), 9))
    got = graph.two_hops(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert sorted((r.root, r.node, r.hops) for r in got) == sorted((*k, h) for k, h in want.items())


@pytest.mark.parametrize("most", [1, 8])
def test_what_is_reached_through_circles(spark, most, monkeypatch):
    monkeypatch.setattr(graph.circles, "__defaults__", (most,))
    # two circles, the second reached from the first, roots that lead into either, a chain that ends, a loop on itself
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (20, 1), (21, 2), (22, 5), (23, 7), (9, 9)]
    want = set()
    for a, _ in edges:
        seen, todo = set(), [a]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [d for s, d in edges if s == x]
        want |= {(a, x) for x in seen}
    got = [tuple(r) for r in graph.reached(spark.createDataFrame(edges, "src int, dst int")).select("root", "node").collect()]
    assert sorted(got) == sorted(want)


def test_a_circle_is_followed_once(spark, monkeypatch):
    made, closure = [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda roots, edges, max_hops=None: made.append(closure(roots, edges, max_hops)) or made[-1])
    edges = [(k, (k + 1) % 4) for k in range(4)] + [(100 + k, k % 4) for k in range(40)]
    assert graph.reached(spark.createDataFrame(edges, "src int, dst int")).count() == 4 * 4 + 40 * 5
    assert max(x.count() for x in made) <= 85


def test_circles_apart_are_found_in_one_round_and_roots_are_not_followed(spark):
    r = Random(3)
    pairs = [(100 * k + i, 100 * k + (i + 1) % 7) for k in range(10) for i in range(7)]
    pairs += [(100 * k + r.randrange(7), 100 * (k + 1) + r.randrange(7)) for k in range(0, 6, 3)] + [(5000 + i, 100 * r.randrange(10) + r.randrange(7)) for i in range(20)] + [(7, 7), (6001, 3)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    members = {(x.node, x.rep) for x in graph.circles(edges, most=1).collect()}
    assert {(100 * k + i, 100 * k) for k in range(10) if k not in (1, 4) for i in range(7)} <= members
    want = {(a, a) for a, _ in pairs}
    while more := {(a, d) for a, b in want for c, d in pairs if b == c} - want:
        want |= more
    found = graph.reached(edges)
    assert sorted(map(tuple, found.collect())) == sorted(want)
