"""Node tables, shapes, obligations, alternatives and the independent judge against brute force and cases."""

import copy
import json
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from quillstone.plans import adjudicate, alternatives, obligations, shapes
from quillstone.sources import nodes as tree
from quillstone.sources.scratch import cut
from tests.test_drift import base, holds, ref

DOCS = "file string, side string, body string, path string, kind string"


def documents(spark, docs):
    rows = [(f, s, d if isinstance(d, str | None) else json.dumps(d), "x", "y") for f, s, d in docs]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def walk(value, path="", depth=0, key=None):
    """(path, key, kind, text, depth, entry, exit) in the order of a depth-first walk with sorted keys."""
    out = []

    def go(v, path, depth, key):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        text = v if kind == "string" else json.dumps(v) if kind in ("boolean", "number") else None
        me = len(out)
        out.append([path, key, kind, text, depth, me, None])
        kids = sorted(v.items()) if kind == "object" else enumerate(v) if kind == "array" else []
        for k, x in kids:
            go(x, path + "/" + str(k).replace("~", "~0").replace("/", "~1"), depth + 1, str(k))
        out[me][6] = len(out) - 1

    go(value, path, depth, key)
    return [tuple(x) for x in out]


def some_json(r, depth=0):
    kind = r.randrange(8 if depth < 4 else 4)
    if kind >= 6:
        return {r.choice(["a", "b/c", "d~e", "", "é", "$ref", "properties", "A"]) + str(r.randrange(3)): some_json(r, depth + 1) for _ in range(r.randrange(5))}
    if kind >= 4:
        return [some_json(r, depth + 1) for _ in range(r.randrange(12))]
    return r.choice([None, True, False, 0, -7, 12345678901, 1.5, "", "text", "a/b", '"q"\n'])


def test_nodes_against_a_walk(spark):
    r = Random(1)
    docs = [(f"f{k}", side, some_json(r)) for k in range(25) for side in ("old", "new")]
    odd = [("n", "old", None), ("n", "new", "{not json"), ("e", "old", "{}"), ("s", "old", '"one"'), ("d", "old", '{"a":1,"a":2}'), ("same", "old", '{"x":[1,2],"y":null}'), ("same", "new", '{"y":null,"x":[1,2]}')]
    written = [(f, side, json.dumps(d)) for f, side, d in docs]
    nodes = tree.numbered(tree.node_table(documents(spark, [*written, *odd, written[0]])))
    got = Counter((x.file, x.side, x.path, x.key, x.kind, x.text, x.depth, x.entry, x.exit) for x in nodes.collect())
    want = Counter((f, s, *x) for f, s, d in docs for x in walk(d))
    want += Counter((f, s, *x) for f, s, d in odd if f in "es" or f == "same" for x in walk(json.loads(d)))
    want += Counter((f, s, "", None, "unreadable", None, 0, 0, 0) for f, s in [("n", "old"), ("n", "new"), ("d", "old")])
    assert got == want
    same = {(x.side, x.path): x.digest for x in nodes.where("file = 'same'").collect()}
    assert all(same["old", p] == same["new", p] for s, p in same)
    held = tree.holding(nodes.where("depth = 1"), nodes)
    pairs = Counter((x.file, x.side, x.outer, x.inner) for x in held.collect())
    paths = [(f, s, p) for (f, s, p, *_), n in want.items()]
    assert pairs == Counter((f, s, a, b) for f, s, a in paths if a.count("/") == 1 for g, t, b in paths if (f, s) == (g, t) and b.startswith(a + "/"))
    assert tree.node_table(documents(spark, [])).count() == 0


def test_nodes_take_no_round_for_each_level(spark):
    deep = {"k\\": ['"', "\\", '\\"]', "é\t", {}, []], "z": 1}
    for _ in range(60):
        deep = {"down": deep}
    spark.sparkContext.setJobGroup("deep", "nodes of a deep document")
    nodes = tree.node_table(documents(spark, [("f", "old", deep)]))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep")) < 10
    assert sorted((x.path, x.key, x.kind, x.text, x.depth, x.entry, x.exit) for x in nodes.collect()) == sorted(walk(deep), key=lambda x: x[0])


def some_schema(r, names, depth=0):
    """A schema that may refer to others, and in circles."""
    kind = r.randrange(12) if depth < 3 else r.randrange(6)
    inner = lambda: some_schema(r, names, depth + 1)
    out = {}
    if kind == 0:
        out = ref(r.choice(names))
    elif kind == 1:
        out = {"type": r.choice(["string", "integer", "null"])}
    elif kind == 2:
        out = {"type": "string", "enum": r.sample(["a", "b", "c"], r.randrange(1, 4))}
    elif kind == 3:
        out = r.choice([{}, {"description": "d"}, {"pattern": "x"}, {"const": "k"}, {"nullable": False}])
    elif kind in (4, 5, 6, 7):
        props = {n: inner() if depth < 3 else {"type": "string"} for n in r.sample("pqrst", r.randrange(0, 4))}
        out = {"type": "object", "properties": props, "required": r.sample([*"pqrst"], r.randrange(0, 3))}
    elif kind == 8:
        out = {"type": "array", "items": inner()}
    elif kind in (9, 10):
        out = {r.choice(["oneOf", "anyOf"]): [inner() for _ in range(r.randrange(0, 4))]}
    else:
        out = {"allOf": [inner() for _ in range(r.randrange(0, 4))]}
        if r.random() < 0.5:
            out |= {"properties": {"z": {"type": "string"}}, "required": ["z"]}
    if r.random() < 0.15:
        out = {**out, "nullable": True}
    return out


def schema_documents(seed, n):
    r = Random(seed)
    out = []
    for k in range(n):
        names = [f"S{i}" for i in range(r.randrange(2, 7))]
        out.append((f"f{k}", "old", {"components": {"schemas": {x: some_schema(r, [*names, "Missing"]) for x in names}}}))
    return out


def all_schemas(doc):
    return {p: v for p, v in ((p, at(doc, p)) for p, *_ in walk(doc)) if isinstance(v, dict)}


def at(doc, path):
    for step in path.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(doc, dict) and step in doc:
            doc = doc[step]
        elif isinstance(doc, list) and step.isdigit() and int(step) < len(doc):
            doc = doc[int(step)]
        else:
            return None
    return doc


def end_of(doc, node):
    for _ in range(9):
        if not (isinstance(node, dict) and isinstance(node.get("$ref"), str)):
            return node
        node = at(doc, node["$ref"][1:])
    return None


NOTES = set(shapes.ANNOTATIONS)


def brute_merged(doc, node, open_=()):
    """The schema with its arms merged; None where they go around in circles."""
    if not node.get("allOf"):
        return node
    if id(node) in open_:
        return None
    out = {k: v for k, v in node.items() if k != "allOf"}
    props, required = dict(node.get("properties", {})), list(node.get("required", []))
    for arm in node["allOf"]:
        arm = end_of(doc, arm)
        if not isinstance(arm, dict):
            continue
        arm = brute_merged(doc, arm, (*open_, id(node)))
        if arm is None:
            return None
        if "$ref" in arm:
            continue
        props |= arm.get("properties", {})
        required += arm.get("required", [])
        if arm.get("nullable") is True:
            out["nullable"] = True
        for k in ("type", "enum", "items", "oneOf", "anyOf"):
            if k in arm and k not in out:
                out[k] = arm[k]
    if props:
        out["properties"] = props
    if required:
        out["required"] = required
    return out


def brute_shape(doc, node, left):
    if not isinstance(node, dict) or left < 0:
        return "opaque"
    if not set(node) - NOTES:
        return "any"
    if node.get("allOf"):
        node = brute_merged(doc, node)
        if node is None:
            return "unresolved"
        if not set(node) - NOTES:
            return "any"
    if node.get("nullable") is True:
        return f"nullable({brute_shape(doc, {k: v for k, v in node.items() if k != 'nullable'}, left - 1)})"
    if "$ref" in node:
        to = at(doc, node["$ref"][1:])
        return brute_shape(doc, to, left - 1) if isinstance(to, dict) else "unknown-ref"
    if "properties" in node:
        return f"object({','.join(sorted(node['properties']))})"
    if node.get("type") == "array":
        return f"array({brute_shape(doc, node.get('items', {}), left - 1)})"
    for k in ("oneOf", "anyOf"):
        if k in node:
            return f"{k}({'|'.join(sorted(brute_shape(doc, a, left - 1) for a in node[k]))})"
    values = ";" + ",".join(sorted(set(node["enum"]))) if node.get("enum") else ""
    return f"scalar({node.get('type', '')}{values})" if node.get("type") or values else "unresolved"


def brute_duties(doc):
    every = all_schemas(doc)
    found = {p: set() for p in every}
    while True:
        before = {p: set(x) for p, x in found.items()}
        for p, node in every.items():
            if "$ref" in node:
                found[p] |= before.get(node["$ref"][1:], set())
                continue
            found[p] |= {x for x in node.get("required", []) if isinstance(x, str)} if isinstance(node.get("required"), list) else set()
            for k in ("allOf", "oneOf", "anyOf"):
                arms = node.get(k)
                if isinstance(arms, list) and arms:
                    sets = [before.get(f"{p}/{k}/{i}", set()) for i in range(len(arms))]
                    found[p] |= set.union(*sets) if k == "allOf" else set.intersection(*sets)
        if found == before:
            return {(p, x) for p, names in found.items() for x in names}


@pytest.fixture(scope="module")
def schemas(spark):
    docs = schema_documents(5, 60)
    graph = shapes.Graph(tree.node_table(documents(spark, docs)))
    return docs, graph


def test_shapes_against_brute_force(schemas):
    docs, graph = schemas
    got = {(x.file, x.schema): x.shape for x in shapes.shapes(graph).collect()}
    want = {}
    for f, _, doc in docs:
        for p, node in all_schemas(doc).items():
            if p.rsplit("/", 1)[-1] not in ("properties", "schemas", "components", ""):
                want[f, p] = brute_shape(doc, node, shapes.DEPTH)
    differ = {k: (v, got.get(k)) for k, v in want.items() if got.get(k) != v}
    assert not differ
    kinds = Counter(v.split("(")[0] for v in want.values())
    assert min(kinds[k] for k in ("any", "unresolved", "unknown-ref", "nullable", "object", "array", "oneOf", "anyOf", "scalar")) > 3


def test_obligations_against_brute_force(schemas):
    docs, graph = schemas
    got = {(x.file, x.schema, x.name) for x in obligations.obligations(graph).collect()}
    assert got == {(f, p, x) for f, _, doc in docs for p, x in brute_duties(doc)}


def brute_descended(doc, start, steps):
    out, seen, todo = set(), set(), [(start, 0)]
    while todo:
        p, k = todo.pop()
        node = at(doc, p)
        if (p, k) in seen or not isinstance(node, dict):
            continue
        seen.add((p, k))
        if "$ref" in node:
            todo.append((node["$ref"][1:], k))
            continue
        if k == len(steps):
            out.add(p)
            continue
        if steps[k] == "[]" and "items" in node:
            todo.append((p + "/items", k + 1))
        if steps[k] in node.get("properties", {}):
            todo.append((f"{p}/properties/{steps[k]}", k + 1))
        todo += [(f"{p}/{c}/{i}", k) for c in ("allOf", "oneOf", "anyOf") for i in range(len(node.get(c, [])))]
    return out


def test_paths_through_unions_and_circles(spark, schemas):
    docs, graph = schemas
    r = Random(2)
    asked, want = [], set()
    for f, s, doc in docs:
        for k in range(6):
            start = "/components/schemas/" + r.choice(list(doc["components"]["schemas"]))
            steps = r.choices([*"pqrst", "[]"], k=r.randrange(0, 4))
            asked.append((f, s, f"{f}-{k}", start, steps))
            want |= {(f"{f}-{k}", p) for p in brute_descended(doc, start, steps)}
    rows = spark.createDataFrame(asked, "file string, side string, id string, start string, steps array<string>")
    assert {(x.id, x.schema) for x in obligations.descended(graph, rows).collect()} == want


def brute_alternatives(doc, node, open_=()):
    """Name sets of all alternatives of a schema that contains itself nowhere by composition."""
    seen = []
    while isinstance(node, dict) and "$ref" in node:
        if node in seen:
            raise RecursionError
        seen.append(node)
        node = at(doc, node["$ref"][1:])
    if not isinstance(node, dict):
        return set()
    if id(node) in open_:
        raise RecursionError
    inside = (*open_, id(node))
    for k in ("oneOf", "anyOf"):
        if k in node:
            arms = node[k]
            stands = [end_of(doc, a) for a in arms]
            if node.get("type") and stands and all(isinstance(x, dict) and ("const" in x or x.get("enum")) and not x.get("properties") and "items" not in x for x in stands):
                return {frozenset(node.get("properties", {}))}
            return set().union(*[brute_alternatives(doc, a, inside) for a, x in zip(arms, stands, strict=True) if not (isinstance(x, dict) and x.get("type") == "null")])
    out = {frozenset(node.get("properties", {}))}
    for arm in node.get("allOf", []):
        more = brute_alternatives(doc, arm, inside)
        out = {a | b for a in out for b in more} if more else out
    return out


def test_alternatives_against_brute_force(schemas):
    docs, graph = schemas
    got = {(x.file, x.schema): x for x in alternatives.alternatives(graph).select("*", alternatives.promised(F.col("least")).alias("promised")).collect()}
    decided = 0
    for f, _, doc in docs:
        for name, node in doc["components"]["schemas"].items():
            row = got[f, f"/components/schemas/{name}"]
            try:
                sets = brute_alternatives(doc, node)
            except RecursionError:
                assert row.undecided and row.all_ is None and row.promised is None
                continue
            decided += 1
            assert not row.undecided
            assert {frozenset(a.names) for a in row.all_} == sets
            assert {frozenset(a) for a in row.least} == {a for a in sets if not any(b < a for b in sets)}
            assert set(row.promised) == (set.intersection(*map(set, sets)) if sets else set())
    assert decided > 100


def test_too_many_alternatives_are_undecided(spark):
    arm = lambda k: {"oneOf": [{"properties": {f"a{k}": {}}}, {"properties": {f"b{k}": {}}}]}
    doc = {"components": {"schemas": {"Many": {"allOf": [arm(k) for k in range(7)]}, "Some": {"allOf": [arm(k) for k in range(6)]}, "On": {"allOf": [ref("Many")]}, "Free": {"properties": {"x": ref("Many")}}}}}
    graph = shapes.Graph(tree.node_table(documents(spark, [("f", "old", doc)])))
    got = {x.schema.rsplit("/", 1)[-1]: x for x in alternatives.alternatives(graph).collect()}
    assert got["Many"].undecided and got["On"].undecided and not got["Free"].undecided
    assert len(got["Some"].all_) == 64


def test_an_arm_pinned_otherwise_is_not_presented(spark):
    pinned = lambda v: {"type": "object", "properties": {"kind": {"enum": [v]}, "name": {"type": "string"}}}
    doc = {"components": {"schemas": {"A": pinned("x"), "B": pinned("y"), "Wide": {"type": "object", "properties": {"kind": {"enum": ["x", "y"]}, "name": {}, "more": {}}}, "Text": {"type": "string"}, "Either": {"oneOf": [ref("A"), {"type": "null"}]}}}}
    graph = shapes.Graph(tree.node_table(documents(spark, [("f", "old", doc)])))
    rows = alternatives.alternatives(graph).where("schema LIKE '/components/schemas/%' AND NOT schema LIKE '%/properties/%'").select(F.element_at(F.split("schema", "/"), -1).alias("n"), "all_")
    pairs = rows.alias("o").crossJoin(rows.select(F.col("n").alias("m"), F.col("all_").alias("new"))).select("n", "m", alternatives.presents(F.col("new"), F.get("all_", F.lit(0))).alias("ok"))
    ok = {(x.n, x.m) for x in pairs.where("n IN ('A', 'B') AND m IN ('A', 'B', 'Wide', 'Text', 'Either') AND ok").collect()}
    assert ok == {("A", "A"), ("B", "B"), ("A", "Wide"), ("B", "Wide"), ("A", "Either")}


def edited(*edits, doc=None):
    out = copy.deepcopy(doc or base())
    for path, value in edits:
        *way, last = path
        node = out
        for step in way:
            node = node[step]
        if value is None:
            del node[last]
        else:
            node[last] = value
    return out


P, S = "paths", ("components", "schemas")
SCOPES = "/telescopes/{scope}/slots"
GET, POST = f"GET {SCOPES}", f"POST {SCOPES}"
ANSWER = (P, SCOPES, "get", "responses", "200", "content", "application/json", "schema")
BODY = (P, SCOPES, "post", "requestBody", "content", "application/json", "schema")
YES, NO, UNKNOWN = adjudicate.CONFIRMED, adjudicate.REFUTED, adjudicate.UNDECIDABLE
#: What is claimed, of which edit of the old document (and of the base, if it is another), and what is right.
CASES = [
    ("spec_removed", {"subject": "x"}, "gone", YES),
    ("spec_removed", {"subject": "x"}, [], NO),
    ("endpoint_moved", {"old": "GET /1/weather", "new": "GET /2/weather"}, [((P, "/2/weather"), base()["paths"]["/1/weather"]), ((P, "/1/weather"), None)], YES),
    ("endpoint_moved", {"old": "PATCH /slots/{slot}", "new": "PATCH /slots/{id}"}, [((P, "/slots/{id}"), base()["paths"]["/slots/{slot}"]), ((P, "/slots/{slot}"), None)], NO),
    ("endpoint_removed", {"method": "delete", "path": "/slots/{slot}"}, [((P, "/slots/{slot}", "delete"), None)], YES),
    ("endpoint_removed", {"method": "patch", "path": "/slots/{slot}"}, [((P, "/slots/{slot}", "delete"), None)], NO),
    ("endpoint_removed", {"method": "get", "path": "/none"}, [], UNKNOWN),
    ("endpoint_deprecated", {"op_key": GET}, [((P, SCOPES, "get", "deprecated"), True)], YES),
    ("endpoint_deprecated", {"op_key": GET}, [], NO),
    ("endpoint_deprecated", {"op_key": GET}, [((P, SCOPES), None)], UNKNOWN),
    ("response_status_removed", {"op_key": POST, "status": "202"}, [((P, SCOPES, "post", "responses", "202"), None)], YES),
    ("response_status_removed", {"op_key": POST, "status": "202"}, [], NO),
    ("response_status_removed", {"op_key": "GET /x", "status": "200"}, [], UNKNOWN),
    ("request_body_now_required", {"op_key": POST}, [((P, SCOPES, "post", "requestBody", "required"), True)], YES),
    ("request_body_now_required", {"op_key": POST}, [], NO),
    ("request_body_now_required", {"op_key": "PATCH /slots/{id}"}, [], NO),
    ("security_requirement_added", {"op_key": GET}, [((P, SCOPES, "get", "security"), [{"badge": []}])], YES),
    ("security_requirement_added", {"op_key": GET}, [], NO),
    ("security_requirement_added", {"op_key": "GET /x"}, [], UNKNOWN),
    ("server_url_changed", {}, [(("servers",), [{"url": "https://{h}.example.org", "variables": {"h": {"default": "sea"}}}])], YES),
    ("server_url_changed", {}, [(("servers",), [{"url": "https://{h}.example.net/v3", "variables": {"h": {"default": "sky"}}}])], NO),
    ("server_url_changed", {}, [(("servers",), None)], UNKNOWN),
    ("operation_server_changed", {"op_key": GET}, [((P, SCOPES, "servers"), [{"url": "https://o.example.net"}])], YES),
    ("operation_server_changed", {"op_key": GET}, [], NO),
    ("operation_server_changed", {"op_key": GET}, [((P, SCOPES), None)], UNKNOWN),
    ("param_removed", {"op_key": "GET /telescopes", "subject": "mount"}, [((P, "/telescopes", "get", "parameters", 1), None)], YES),
    ("param_removed", {"op_key": "GET /telescopes", "subject": "X-Site"}, [((P, "/telescopes", "get", "parameters", 1), None)], NO),
    ("param_removed", {"op_key": "GET /1/weather", "subject": "x"}, [], UNKNOWN),
    ("param_now_required", {"op_key": "GET /telescopes", "subject": "X-Site"}, [((P, "/telescopes", "parameters", 0, "required"), True)], YES),
    ("param_now_required", {"op_key": "GET /telescopes", "subject": "mount"}, [], NO),
    ("param_added_required", {"op_key": GET, "subject": "q"}, [((P, SCOPES, "get", "parameters"), [{"in": "query", "name": "q", "required": True, "schema": {}}])], YES),
    ("param_added_required", {"op_key": GET, "subject": "q"}, [((P, SCOPES, "get", "parameters"), [{"in": "path", "name": "q", "required": True, "schema": {}}])], NO),
    ("param_type_changed", {"op_key": "GET /telescopes", "subject": "aperture"}, [((P, "/telescopes", "get", "parameters", 0, "schema"), {"type": "string"})], YES),
    ("param_type_changed", {"op_key": "GET /telescopes", "subject": "aperture"}, [((*S, "N"), {"type": "number"}), ((P, "/telescopes", "get", "parameters", 0, "schema"), ref("N"))], NO),
    ("param_type_changed", {"op_key": "GET /telescopes", "subject": "aperture"}, [((P, "/telescopes", "get", "parameters", 0, "schema"), {"pattern": "x"})], UNKNOWN),
    ("param_deprecated", {"op_key": "GET /telescopes", "subject": "aperture"}, [], UNKNOWN),
    ("request_enum_value_removed", {"op_key": "GET /telescopes", "subject": "mount", "root_cause": "mount"}, [((P, "/telescopes", "get", "parameters", 1, "schema", "enum"), ["alt-az"])], YES),
    ("request_enum_value_removed", {"op_key": "GET /telescopes", "subject": "mount", "root_cause": "mount"}, [((P, "/telescopes", "get", "parameters", 1, "schema"), {"type": "string"})], NO),
    ("request_enum_value_removed", {"op_key": POST, "subject": "band", "root_cause": "band"}, [((*BODY, "properties", "band", "enum"), ["U"])], YES),
    ("request_enum_value_added", {"op_key": POST, "subject": "band", "root_cause": "band"}, [((*BODY, "properties", "band", "enum"), ["U", "B", "V", "R"])], YES),
    ("response_enum_value_removed", {"op_key": GET, "subject": "seeing", "root_cause": "seeing"}, [((*ANSWER, "properties", "seeing", "enum"), ["fair"])], YES),
    ("response_enum_value_added", {"op_key": GET, "subject": "seeing", "root_cause": "seeing"}, [], NO),
    ("response_enum_value_added", {"op_key": GET, "subject": "cursor", "root_cause": "cursor"}, [], UNKNOWN),
    ("schema_enum_value_removed", {"subject": "Slot.state", "root_cause": "Slot.state"}, [((*S, "SlotState", "enum"), ["open"])], YES),
    ("schema_enum_value_added", {"subject": "Slot.state", "root_cause": "Slot.state"}, [((*S, "SlotState", "enum"), ["open"])], NO),
    ("schema_field_now_nullable", {"subject": "Slot.begins", "root_cause": "Slot.begins"}, [((*S, "Slot", "properties", "begins"), {"anyOf": [{"type": "string"}, {"type": "null"}]})], YES),
    ("schema_field_now_nullable", {"subject": "Slot.begins", "root_cause": "Slot.begins"}, [((*S, "Slot", "properties", "begins"), {"allOf": [{"type": "string"}, {"nullable": True}]})], YES),
    ("schema_field_now_nullable", {"subject": "Slot.begins", "root_cause": "Slot.begins"}, [], NO),
    ("schema_field_now_nullable", {"subject": "Slot.none", "root_cause": "Slot.none"}, [], UNKNOWN),
    ("schema_field_removed", {"subject": "Telescope.site", "root_cause": "Telescope.site", "affected_ops": ["GET /telescopes"]}, [((*S, "Telescope", "properties", "site"), None)], YES),
    ("schema_field_removed", {"subject": "Telescope.site", "root_cause": "Telescope.site", "affected_ops": ["GET /telescopes"]}, [((*S, "Telescope", "properties", "site"), None), ((*S, "Camera", "properties", "site"), {"type": "string"})], NO),
    ("schema_field_removed", {"subject": "Telescope.site", "root_cause": "Telescope.site"}, [((*S, "Telescope"), {"allOf": [base()["components"]["schemas"]["Telescope"]]})], NO),
    ("schema_field_removed", {"subject": "Nothing.site", "root_cause": "Nothing.site"}, [], UNKNOWN),
    ("schema_field_now_required", {"subject": "SlotChange.reason", "root_cause": "SlotChange.reason"}, [((*S, "SlotChange", "required"), ["begins", "reason"])], YES),
    ("schema_field_now_required", {"subject": "SlotChange.begins", "root_cause": "SlotChange.begins"}, [], NO),
    ("schema_field_added_required", {"subject": "SlotChange.new", "root_cause": "SlotChange.new"}, [((*S, "SlotChange"), {"allOf": [base()["components"]["schemas"]["SlotChange"], {"required": ["new"], "properties": {"new": {}}}]})], YES),
    ("schema_field_type_changed", {"subject": "Camera.pixels", "root_cause": "Camera.pixels"}, [((*S, "Camera", "properties", "pixels"), {"type": "string"})], YES),
    ("schema_field_type_changed", {"subject": "Slot.scope", "root_cause": "Slot.scope"}, [((*S, "Slot", "properties", "scope"), {"allOf": [ref("Telescope"), {"title": "t"}]})], NO),
    ("schema_field_type_changed", {"subject": "Camera.pixels", "root_cause": "Camera.pixels"}, [((*S, "Camera", "properties", "pixels"), {"pattern": "x"})], UNKNOWN),
    ("schema_field_type_changed", {"subject": "Camera.pixels", "root_cause": "Camera.pixels"}, [((*S, "Camera", "properties", "pixels"), {})], YES),
    ("schema_removed", {"subject": "Spectrograph", "root_cause": "Spectrograph"}, [((*S, "Spectrograph"), None), ((*S, "Telescope", "properties", "guide"), ref("Camera"))], YES),
    ("schema_removed", {"subject": "Spectrograph", "root_cause": "Spectrograph"}, [((*S, "Spectrograph"), None), ((*S, "Telescope", "properties", "guide"), {"oneOf": [base()["components"]["schemas"]["Spectrograph"], ref("Camera")]})], NO),
    ("schema_removed", {"subject": "Plate", "root_cause": "Plate"}, [((*S, "Plate"), None)], NO),
    ("schema_removed", {"subject": "Camera", "root_cause": "Camera"}, [((*S, "Camera"), None), ((*S, "Telescope"), None)], NO),
    ("schema_removed", {"subject": "Slot", "root_cause": "Slot"}, [], NO),
    ("request_field_type_changed", {"op_key": POST, "subject": "exposure.frames"}, [((*BODY, "properties", "exposure", "properties", "frames"), {"type": "string"})], YES),
    ("request_field_type_changed", {"op_key": POST, "subject": "exposure.frames"}, [((*S, "E"), base()["paths"][SCOPES]["post"]["requestBody"]["content"]["application/json"]["schema"]["properties"]["exposure"]), ((*BODY, "properties", "exposure"), ref("E"))], NO),
    ("request_field_type_changed", {"op_key": POST, "subject": "none"}, [], UNKNOWN),
    ("response_field_type_changed", {"op_key": GET, "subject": "slots[].begins"}, [((*S, "Slot", "properties", "begins"), {"type": "integer"})], YES),
    ("response_field_type_changed", {"op_key": GET, "subject": "<Page>.cursor"}, [], NO),
    ("response_field_type_changed", {"op_key": "DELETE /slots/{slot}", "subject": "x"}, [], UNKNOWN),
    ("request_field_now_required", {"op_key": POST, "subject": "exposure.frames"}, [((*BODY, "properties", "exposure", "required"), ["seconds", "frames"])], YES),
    ("request_field_now_required", {"op_key": POST, "subject": "exposure.seconds"}, [], NO),
    ("request_field_now_required", {"op_key": POST, "subject": "band"}, [((*BODY, "oneOf"), [{"required": ["band"]}, {}])], UNKNOWN),
    ("request_field_added_required", {"op_key": POST, "subject": "filter"}, [((*BODY, "required"), ["target", "filter"])], YES),
    ("request_field_added_required", {"op_key": POST, "subject": "guard.name"}, [((*BODY, "properties", "guard"), {"type": "object", "properties": {"name": {}}, "required": ["name"]})], NO),
    ("request_field_added_required", {"op_key": POST, "subject": "a.b"}, [], UNKNOWN),
    ("request_field_removed", {"op_key": POST, "subject": "exposure.frames"}, [((*BODY, "properties", "exposure", "properties", "frames"), None)], YES),
    ("request_field_removed", {"op_key": POST, "subject": "exposure.frames"}, [], NO),
    ("request_field_removed", {"op_key": POST, "subject": "none"}, [], UNKNOWN),
    ("response_field_removed", {"op_key": GET, "subject": "moon.phase"}, [((*ANSWER, "properties", "moon", "properties", "phase"), None), ((*ANSWER, "properties", "moon", "properties", "x"), {})], YES),
    ("response_field_removed", {"op_key": GET, "subject": "moon.phase"}, [((*ANSWER, "properties", "moon"), {"type": "object"})], UNKNOWN),
    ("response_field_removed", {"op_key": GET, "subject": "moon.phase"}, [((*ANSWER, "properties", "moon"), {"type": "object", "additionalProperties": False})], YES),
    ("response_field_removed", {"op_key": GET, "subject": "cursor"}, [(ANSWER, {"oneOf": [base()["paths"][SCOPES]["get"]["responses"]["200"]["content"]["application/json"]["schema"], {"properties": {"cursor": {}, "error": {}}}]})], NO),
    ("response_field_removed", {"op_key": GET, "subject": "seeing"}, [(ANSWER, {"oneOf": [base()["paths"][SCOPES]["get"]["responses"]["200"]["content"]["application/json"]["schema"], {"properties": {"cursor": {}, "error": {}}}]})], YES),
    ("response_field_removed", {"op_key": "GET /telescopes", "subject": "[].guide<Camera>"}, [((*S, "Telescope", "properties", "guide"), ref("Spectrograph"))], YES),
    ("response_field_removed", {"op_key": "GET /telescopes", "subject": "[].guide<Camera>"}, [((*S, "Telescope", "properties", "guide"), {"anyOf": [ref("Spectrograph"), {"type": "object", "properties": {"pixels": {}, "cooled": {}, "more": {}}}]})], NO),
    ("security_scheme_removed", {"subject": "badge"}, [], UNKNOWN),
]


def test_every_kind_is_judged_by_its_own_question(spark):
    docs, claims, want = [], [], {}
    for k, (kind, claim, edits, right) in enumerate(CASES):
        old = base()
        docs.append((f"v/{k}", "old", old))
        if edits != "gone":
            docs.append((f"v/{k}", "new", edited(*edits, doc=old)))
        row = {"vendor": "v", "spec_file": str(k), "kind": kind, "affected_ops": [], **claim}
        claims.append(tuple(row.get(c) for c in ["vendor", "spec_file", *adjudicate.CLAIM[1:], "affected_ops"]))
        want[f"v/{k}"] = (kind, right)
    schema = "vendor string, spec_file string, " + ", ".join(f"{c} string" for c in adjudicate.CLAIM[1:]) + ", affected_ops array<string>"
    found = adjudicate.claims(spark.createDataFrame([*claims, claims[0]], schema))
    verdicts = cut(adjudicate.adjudicated(found, tree.node_table(documents(spark, docs))))
    rows = verdicts.collect()
    assert len(rows) == len(CASES)
    wrong = {x.file: (x.kind, x.verdict, x.reason, want[x.file][1], CASES[int(x.file[2:])][1]) for x in rows if (x.kind, x.verdict) != want[x.file]}
    assert not wrong
    assert {kind for kind, right in want.values() if right in (YES, NO)} >= set(adjudicate.ASKED) - {"param_deprecated"}
    table = {x.kind: x for x in adjudicate.agreement(verdicts).collect()}
    assert (table["endpoint_removed"].n, table["endpoint_removed"].precision_milli, table["param_deprecated"].precision_milli) == (3, 500, None)
