"""Rules on the contract of an observatory and a few edits at a time."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import names, paths
from quillstone.plans import drift
from quillstone.sources import contracts


def ref(name):
    return {"$ref": f"#/components/schemas/{name}"}


def holds(schema):
    return {"description": "-", "content": {"application/json": {"schema": schema}}}


def base():
    return {
        "openapi": "3.1.0",
        "info": {"title": "Observatory", "version": "7"},
        "servers": [{"url": "https://sky.example.net/v3/"}],
        "security": [{"badge": []}],
        "paths": {
            "/telescopes": {
                "parameters": [{"in": "header", "name": "X-Site", "schema": {"type": "string"}}],
                "get": {
                    "operationId": "findTelescopes",
                    "parameters": [{"in": "query", "name": "aperture", "schema": {"type": "number"}}, {"in": "query", "name": "mount", "schema": {"type": "string", "enum": ["alt-az", "equatorial", "dobson"]}}],
                    "responses": {"200": holds({"type": "array", "items": ref("Telescope")}), "206": {"description": "some"}},
                },
            },
            "/telescopes/{scope}/slots": {
                "get": {
                    "operationId": "listSlots",
                    "responses": {"200": holds({"properties": {"slots": {"type": "array", "items": ref("Slot")}, "cursor": {"type": "string"}, "seeing": {"type": "string", "enum": ["poor", "fair", "good"]}, "moon": {"type": "object", "properties": {"phase": {"type": "number"}}}}})},
                },
                "post": {
                    "operationId": "bookSlot",
                    "requestBody": {"content": {"application/json": {"schema": {"type": "object", "required": ["target"], "properties": {"target": {"type": "string"}, "band": {"type": "string", "enum": ["U", "B", "V"]}, "exposure": {"type": "object", "required": ["seconds"], "properties": {"seconds": {"type": "integer"}, "frames": {"type": "integer"}}}}}}}},
                    "responses": {"201": holds(ref("Slot")), "202": {"description": "queued"}},
                },
            },
            "/slots/{slot}": {"patch": {"operationId": "moveSlot", "requestBody": {"required": True, "content": {"application/json": {"schema": ref("SlotChange")}}}, "responses": {"200": holds(ref("Slot"))}}, "delete": {"operationId": "dropSlot", "responses": {"204": {"description": "gone"}}}},
            "/1/weather": {"get": {"operationId": "weather", "responses": {"200": holds({"properties": {"wind": {"type": "number"}}})}}},
        },
        "components": {
            "securitySchemes": {"badge": {"type": "apiKey"}, "ticket": {"type": "oauth2"}},
            "schemas": {
                "Telescope": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "site": {"type": "string"}, "guide": {"oneOf": [ref("Camera"), ref("Spectrograph")]}}},
                "Slot": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "begins": {"type": "string"}, "state": ref("SlotState"), "scope": ref("Telescope")}},
                "SlotState": {"type": "string", "enum": ["open", "held", "done"]},
                "SlotChange": {"type": "object", "required": ["begins"], "properties": {"begins": {"type": "string"}, "reason": {"type": "string"}}},
                "Camera": {"type": "object", "properties": {"pixels": {"type": "integer"}, "cooled": {"type": "boolean"}}},
                "Spectrograph": {"type": "object", "properties": {"lines": {"type": "integer"}}},
                "Plate": {"type": "object", "properties": {"emulsion": {"type": "string"}}},
            },
        },
    }


def find(d):
    return d["paths"]["/telescopes"]["get"]


def book(d):
    return d["paths"]["/telescopes/{scope}/slots"]["post"]


def form(d):
    return book(d)["requestBody"]["content"]["application/json"]["schema"]


def listed(d):
    return d["paths"]["/telescopes/{scope}/slots"]["get"]["responses"]["200"]["content"]["application/json"]["schema"]["properties"]


def schemas(d):
    return d["components"]["schemas"]


def rename_schema(d, old, new):
    """The same schema under another name, wherever it is referred to."""
    text = json.dumps(d).replace(f"schemas/{old}\"", f"schemas/{new}\"")
    d.clear()
    d.update(json.loads(text))
    schemas(d)[new] = schemas(d).pop(old)


def inline_to_ref(d):
    schemas(d)["SlotForm"] = form(d)
    book(d)["requestBody"]["content"]["application/json"]["schema"] = ref("SlotForm")


def moved(d, old, new):
    d["paths"][new] = d["paths"].pop(old)


def both(*edits):
    def run(d):
        for e in edits:
            e(d)

    return run


#: Edits and the kinds of findings they must yield, no more and no fewer.
CASES = {
    "same": (lambda d: None, set()),
    "a hole renamed": (lambda d: moved(d, "/slots/{slot}", "/slots/{slotId}"), set()),
    "a body moved to a reference": (inline_to_ref, set()),
    "a root schema renamed": (lambda d: rename_schema(d, "SlotChange", "SlotEdit"), set()),
    "an arm renamed": (lambda d: rename_schema(d, "Camera", "GuideCamera"), set()),
    "an enum inlined": (both(lambda d: schemas(d)["Slot"]["properties"].update(state=schemas(d).pop("SlotState"))), set()),
    "an unused schema gone": (lambda d: schemas(d).pop("Plate"), set()),
    "a value more in a request": (lambda d: find(d)["parameters"][1]["schema"]["enum"].append("fork"), set()),
    "a server with a slash less": (lambda d: d["servers"][0].update(url="https://sky.example.net/v3"), set()),
    "an object with obligations of its own": (lambda d: form(d)["properties"].update(weather={"type": "object", "required": ["limit"], "properties": {"limit": {"type": "number"}}}), set()),
    "another way in": (lambda d: d.update(security=[{"badge": []}, {"ticket": []}]), set()),
    "endpoint_removed": (lambda d: d["paths"]["/slots/{slot}"].pop("delete"), {"endpoint_removed"}),
    "a version moved": (lambda d: moved(d, "/1/weather", "/2/weather"), {"endpoint_moved"}),
    "endpoint_moved": (lambda d: moved(d, "/slots/{slot}", "/bookings/{slot}"), {"endpoint_moved"}),
    "endpoint_added": (lambda d: d["paths"].update({"/slots/{slot}/log": {"get": {"summary": "What happened", "responses": {}}}}), {"endpoint_added"}),
    "endpoint_deprecated": (lambda d: find(d).update(deprecated=True), {"endpoint_deprecated"}),
    "param_removed": (lambda d: find(d)["parameters"].pop(0), {"param_removed"}),
    "a shared param removed": (lambda d: d["paths"]["/telescopes"].pop("parameters"), {"param_removed"}),
    "param_added_required": (lambda d: find(d)["parameters"].append({"in": "query", "name": "sky", "required": True, "schema": {"type": "string"}}), {"param_added_required"}),
    "param_now_required": (lambda d: find(d)["parameters"][0].update(required=True), {"param_now_required"}),
    "param_type_changed": (lambda d: find(d)["parameters"][0].update(schema={"type": "string"}), {"param_type_changed"}),
    "param_deprecated": (lambda d: find(d)["parameters"][0].update(deprecated=True), {"param_deprecated"}),
    "a param's value gone": (lambda d: find(d)["parameters"][1]["schema"]["enum"].pop(), {"request_enum_value_removed"}),
    "response_field_removed": (lambda d: listed(d).pop("cursor"), {"response_field_removed"}),
    "response_field_type_changed": (lambda d: listed(d).update(cursor={"type": "integer"}), {"response_field_type_changed"}),
    "response_field_now_nullable": (lambda d: listed(d).update(cursor={"anyOf": [{"type": "string"}, {"type": "null"}]}), {"response_field_now_nullable"}),
    "nullable as a list of types": (lambda d: listed(d).update(cursor={"type": ["string", "null"]}), {"response_field_now_nullable"}),
    "response values": (lambda d: listed(d)["seeing"].update(enum=["fair", "good", "superb"]), {"response_enum_value_removed", "response_enum_value_added"}),
    "request_field_removed": (lambda d: form(d)["properties"].pop("band"), {"request_field_removed"}),
    "request_field_now_required": (lambda d: form(d).update(required=["target", "band"]), {"request_field_now_required"}),
    "request_field_added_required": (lambda d: (form(d)["properties"].update(priority={"type": "integer"}), form(d)["required"].append("priority")), {"request_field_added_required"}),
    "request_enum_value_removed": (lambda d: form(d)["properties"]["band"]["enum"].pop(), {"request_enum_value_removed"}),
    "a reference and a type": (both(inline_to_ref, lambda d: schemas(d)["SlotForm"]["properties"].update(target={"type": "integer"})), {"request_field_type_changed"}),
    "a reference and an obligation": (both(inline_to_ref, lambda d: schemas(d)["SlotForm"].update(required=["target", "band"])), {"request_field_now_required"}),
    "request_body_now_required": (lambda d: book(d)["requestBody"].update(required=True), {"request_body_now_required"}),
    "response_status_removed": (lambda d: book(d)["responses"].pop("202"), {"response_status_removed"}),
    "security_requirement_added": (lambda d: find(d).update(security=[{"badge": [], "ticket": []}]), {"security_requirement_added"}),
    "server_url_changed": (lambda d: d.update(servers=[{"url": "https://stars.example.net"}]), {"server_url_changed", "operation_server_changed"}),
    "operation_server_changed": (lambda d: find(d).update(servers=[{"url": "https://find.example.net"}]), {"operation_server_changed"}),
    "security_scheme_removed": (lambda d: d["components"]["securitySchemes"].pop("ticket"), {"security_scheme_removed"}),
    "a schema renamed with a field less": (both(lambda d: rename_schema(d, "SlotChange", "SlotEdit"), lambda d: schemas(d)["SlotEdit"]["properties"].pop("reason")), {"request_field_removed", "schema_removed"}),
    "a request body replaced": (both(lambda d: schemas(d).pop("SlotChange"), lambda d: d["paths"]["/slots/{slot}"]["patch"]["requestBody"]["content"]["application/json"].update(schema={"type": "string"})), {"request_field_removed", "schema_removed"}),
    "an arm that changed": (both(lambda d: rename_schema(d, "Camera", "GuideCamera"), lambda d: schemas(d).update(GuideCamera={"type": "object", "properties": {"uuid": {"type": "string"}}})), {"schema_removed"}),
    "schema_field_removed": (lambda d: schemas(d)["Spectrograph"]["properties"].pop("lines"), {"schema_field_removed"}),
    "schema_field_type_changed": (lambda d: schemas(d)["Spectrograph"]["properties"].update(lines={"type": "string"}), {"schema_field_type_changed"}),
    "schema_field_now_nullable": (lambda d: schemas(d)["Camera"]["properties"]["pixels"].update(nullable=True), {"schema_field_now_nullable"}),
    "schema values": (lambda d: schemas(d)["SlotState"].update(enum=["open", "done", "lost"]), {"schema_enum_value_removed", "schema_enum_value_added", "response_enum_value_removed", "response_enum_value_added"}),
    "schema_field_now_required": (lambda d: schemas(d)["SlotChange"].update(required=["begins", "reason"]), {"schema_field_now_required", "request_field_now_required"}),
    "schema_field_added_required": (lambda d: (schemas(d)["SlotChange"]["properties"].update(by={"type": "string"}), schemas(d)["SlotChange"]["required"].append("by")), {"schema_field_added_required", "request_field_added_required"}),
    "schema_field_added": (lambda d: schemas(d)["SlotChange"]["properties"].update(by={"type": "string", "description": "Who"}), {"schema_field_added"}),
    "response_field_added": (lambda d: schemas(d)["Camera"]["properties"].update(gain={"type": "number"}), {"response_field_added"}),
}
DOCUMENTS = "vendor string, spec_file string, side string, body string"
#: Documents that break a rule of their format somewhere.
MALFORMED = [
    {"paths": {"/x": {"get": {"responses": []}}}}, {"paths": {"/x": {"get": {"parameters": {"a": 1}, "responses": {"200": {"content": {"application/json": "no"}}}}}}}, {"paths": {"/x": [1]}, "components": {"schemas": []}},
    {"paths": {"/x": {"post": {"requestBody": {"content": {"application/json": {"schema": {"properties": ["a"], "required": "a", "type": {}, "enum": 3, "oneOf": "x"}}}}}}}, "servers": "x", "security": 1},
    {"paths": {}, "components": {"schemas": {"A": ref("B"), "B": ref("A"), "C": {"properties": {"x": ref("Nowhere"), "y": {"$ref": "other.json#/Z"}, "c": ref("C")}}}}},
]


@pytest.fixture(scope="module")
def found(spark):
    old, rows = json.dumps(base()), []
    for name, (edit, _) in CASES.items():
        new = base()
        edit(new)
        rows += [(name, "sky.json", "old", old), (name, "sky.json", "new", json.dumps(new))]
    rows += [("files", "gone.json", "old", old), ("files", "come.json", "new", old), ("files", "bad.json", "new", "<html>"), ("files", "none.json", "new", None)]
    rows += [("malformed", f"{k}.json", side, json.dumps({"openapi": "3.0.0"} | d)) for k, d in enumerate(MALFORMED) for side in ("old", "new")]
    plain = copy.deepcopy(base())
    plain["components"]["schemas"] = {"Wind": {"type": "object", "properties": {"wind": {"type": "number"}}}, "Lost": {"type": "object", "properties": {"x": {"type": "string"}}}}
    plain["paths"] = {"/w": {"get": {"responses": {"200": holds({"type": "object", "properties": {"now": copy.deepcopy(plain["components"]["schemas"]["Wind"])}})}}}}
    calm = copy.deepcopy(plain)
    del calm["components"]["schemas"]["Lost"]
    rows += [("written out", "w.json", "old", json.dumps(plain)), ("written out", "w.json", "new", json.dumps(calm))]
    facts = contracts.facts(spark.createDataFrame(rows, DOCUMENTS)).cache()
    result = drift.analyse(facts)
    return facts, result.findings.cache(), result.suppressed.collect()


@pytest.fixture(scope="module")
def rows(found):
    return found[1].collect()


@pytest.mark.parametrize("name", list(CASES))
def test_edit(rows, name):
    assert {r.kind for r in rows if r.vendor == name} == CASES[name][1], [(r.kind, r.subject) for r in rows if r.vendor == name]


def test_files_and_what_cannot_be_read(found, rows):
    assert {(r.kind, r.subject) for r in rows if r.vendor == "files"} == {("spec_removed", "gone.json"), ("spec_added", "come.json")}
    come = next(r for r in rows if r.kind == "spec_added")
    assert come.affected_op_count == 6 and len(come.affected_ops) == 6
    assert {r.key for r in found[0].where("vendor = 'files' and facet = 'error'").collect()} >= {"no paths"} or found[0].where("vendor = 'files' and facet = 'error'").count() == 2
    assert not [r for r in rows if r.vendor == "malformed"]
    types = {(r.key, r.type) for r in found[0].where("vendor = 'malformed' and spec_file = '4.json' and facet = 'schema_field' and side = 'old'").collect()}
    assert types == {("x", "->Nowhere"), ("y", "->Z"), ("c", "->C")}
    assert {r.type for r in found[0].where("vendor = 'malformed' and spec_file = '4.json' and facet = 'schema' and key in ('A', 'B')").collect()} == {"__cycle__"}


def test_why_schemas_were_passed_over(found):
    said = {r.vendor: r.reason for r in found[2] if r.vendor != "same"}
    assert said["an unused schema gone"] == "unreachable" and said["a root schema renamed"] == "renamed" and said["an arm renamed"] == "relocated" and said["an enum inlined"] == "relocated"
    assert said["written out"] == "unreachable"


def test_what_a_finding_says(rows):
    by = {(r.vendor, r.kind): r for r in rows}
    r = by["response_field_type_changed", "response_field_type_changed"]
    assert (r.subject, r.old, r.new, r.status, r.op_key, r.path, r.method, r.operation_id, r.resource) == ("cursor", "string", "integer", "200", "GET /telescopes/{scope}/slots", "/telescopes/{scope}/slots", "get", "listSlots", "telescopes")
    r = by["schema_field_removed", "schema_field_removed"]
    assert (r.subject, r.in_request, r.in_response, r.severity) == ("Spectrograph.lines", False, True, "breaking") and r.affected_op_count == 4 and "GET /telescopes" in r.affected_ops
    r = by["endpoint_added", "endpoint_added"]
    assert (r.subject, r.blurb, r.affected_ops) == ("/slots/{slot}/log", "What happened", ["DELETE /slots/{slot}", "PATCH /slots/{slot}"])
    r = by["security_requirement_added", "security_requirement_added"]
    assert (r.old, r.new) == ("badge", "badge+ticket")
    assert by["schema_field_added", "schema_field_added"].blurb == "Who" and by["endpoint_moved", "endpoint_moved"].old.endswith("/slots/{slot}")


def test_places(found):
    got = {(r.op_key, r.part, r.key): (r.type, r.required, r.bare, r.cause) for r in found[0].where("vendor = 'same' and side = 'old' and facet = 'field'").collect()}
    assert got["GET /telescopes", "response/200", "[]<Telescope>"[:2]] == ("object", False, "[]", "[]")
    assert got["POST /telescopes/{scope}/slots", "request", "exposure.seconds"] == ("integer", True, "exposure.seconds", "exposure.seconds")
    assert got["PATCH /slots/{slot}", "response/200", "<Slot>.scope"] == ("object", False, "scope", "Slot.scope")
    assert got["PATCH /slots/{slot}", "response/200", "<Slot>.scope.guide"] == ("oneOf", False, "scope.guide", "Slot.scope.guide")
    assert got["PATCH /slots/{slot}", "response/200", "<Slot>.scope.guide<Camera>"] == ("__truncated__", False, "scope.guide", "Camera")


def test_collapse(found):
    groups = {(r.vendor, r.kind): r for r in drift.collapsed(found[1]).collect()}
    r = groups["schema_field_now_required", "schema_field_now_required"]
    assert (r.subject, r.occurrences, r.affected_ops, r.root_cause) == ("SlotChange.reason", 2, ["PATCH /slots/{slot}"], "SlotChange.reason") and ("schema_field_now_required", "request_field_now_required") not in groups
    assert groups["server_url_changed", "operation_server_changed"].affected_op_count == 6
    first = drift.ordered(drift.collapsed(found[1])).first()
    assert first.severity == "breaking"
    up = {r.vendor: r for r in drift.roll_up(found[0], found[1], drift.collapsed(found[1])).collect()}
    assert (up["endpoint_removed"].ops_old, up["endpoint_removed"].ops_new, up["endpoint_removed"].breaking) == (6, 5, 1)


def test_names_and_paths(spark):
    lit = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    text = F.lit
    assert [lit(f(text("HTTPServer-list.itemID"))) for f in (names.snake, names.camel, names.pascal)] == ["httpserver_list_item_id", "httpserverListItemId", "HttpserverListItemId"]
    assert lit(paths.visible_path(text("GET /2/x/{id}.json?a={b}#c"))) == "GET /2/x/{}.json"
    assert [lit(paths.static_run(text(p))) for p in ("/guild/{g}/auto/rules", "/station/{s}/a", "/{x}", "#/components/x", "/")] == ["/auto/rules", "/station", "", "", ""]
    assert [lit(paths.resource_of(text(p))) for p in ("/api/V2/{x}/slots", "/2010-04-01/calls", "/{x}")] == ["slots", "calls", ""]
    cases = [("/slots/{id}/log", "https://x.net/v3/slots/{}/log", True), ("/slots/{id}/log", "/Slots/7/LOG", True), ("/slots/{id}", "/slots/", False), ("/a/slots/{id}", "slots/{}", False), ("/{a}/{b}", "/x/y", False), ("/slots/log", "/slots/{}", False), ("/slots/%s", "/slots/4?q=1", True)]
    assert [lit(paths.ends_like(text(a), text(b))) for a, b, _ in cases] == [want for *_, want in cases]
    assert lit(paths.canonical(F.array(text("GET /a/{b}/c"), text("PUT /zz/y"), text("GET /a/{b}")), text("/own"))) == "/zz/y"
    assert lit(names.grep(F.array(text('"pixels"'), text("'pixels'"), text("a.b(c"), text("no")))) == "rg -n --hidden -g '!node_modules' -e 'pixels|a\\.b\\(c'"
    assert lit(names.code_search(F.array(text("short"), text("/v1/telescopes")), F.array(text("python"), text("go")))) == "https://github.com/search?type=code&q=%2Fv1%2Ftelescopes+language%3Apython+language%3Ago"
    assert [lit(names.searchability(text(s), text("x"))) for s in ("Slot.begins_at_utc", "type", "", "Camera.pixels")] == [5, -8, -10, 1]
    assert lit(names.subject_tokens(text("<Slot>.scopes[].guide<Camera>"))) == ["<Slot>", "scopes", "[]", "guide", "<Camera>"]
    assert lit(paths.resource_segments(text("/v1/calls/{sid}/log.json"), F.array(text("/v2"), text("/v1")))) == ["calls", "log"]


def test_operations_are_not_followed_one_by_one(spark, monkeypatch):
    document = base()
    for k in range(60):
        document["paths"][f"/copies{k}"] = {"get": {"responses": {"200": holds(ref("Telescope"))}}}
    rows = spark.createDataFrame([("v", "f.json", side, json.dumps(document)) for side in ("old", "new")], "vendor string, spec_file string, side string, body string")
    roots = []
    closure = drift.graph.closure
    monkeypatch.setattr(drift.graph, "closure", lambda r, e, most=None: roots.append(r.distinct().count()) or closure(r, e, most))
    s = drift.Sides(contracts.facts(rows))
    assert s.used("old").where("schema = 'Telescope' and in_response").count() == 1
    s.reach("old", s.used("old").where("schema = 'Telescope'")).where("hops = 0").count()
    assert max(roots) < 60


def test_packed_tables_are_not_taken_for_small_ones(spark):
    from quillstone.sources.scratch import cut

    rows = spark.range(300_000)
    big, other = (cut(rows.select((F.col("id") + k).alias("id"), F.lit("a name that repeats " * 4).alias(f"x{k}"))) for k in (0, 1))
    plan = big.select("x0").distinct().join(other.select("x1"), F.col("x0") == F.col("x1"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_json_needs_no_yaml_reader(monkeypatch):
    def none(body):
        raise AssertionError("read as YAML")

    found = contracts.parse('openapi: "3.0.0"\npaths: {}', "api")
    assert found["paths"] == {}
    monkeypatch.setattr(contracts, "read_yaml", none)
    assert contracts.parse(' {"paths": {"/a": {}}, "n": 1}', "api") == {"paths": {"/a": {}}, "n": 1}
    for body in ('{paths: {}}', '{"paths": {}, "n": NaN}', "paths: {}"):
        with pytest.raises(contracts.NotAContract):
            contracts.parse(body, "api")
