"""Facts of source files, what they prove, and a scan of a small checkout."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillstone.code import facts as code_facts
from quillstone.plans import dependence, drift, prefilter, prospects, report, scan
from quillstone.sources import archive, files

CHECKOUT = "repo string, path string, n_bytes bigint, text string"
VENDOR = ("skyline", "Skyline", ["import skyline", "api.skyline.net", "SKYLINE_KEY"], ["skyline", "skyline-sdk"], "skyline", ["python", "typescript"], "openai", ["/v3"], True)


def facts_of(path, text):
    return code_facts.read(path, text)


def calls(rows):
    return {r["chain"]: r for r in rows if r["fact"] in ("call", "construct")}


def test_python_facts():
    rows = facts_of("a.py", '''
import skyline as sky
from skyline.errors import Late
client = sky.Client("k")
wanted = {"target": "M31", "exposure": {"seconds": 3}}
slot = client.slots.create(**opts, band="B", body=wanted)
late: Late = slot
print(late.scope["guide"].get("pixels"))
requests.request("PATCH", f"{BASE}/v3/slots/{sid}" + "/log", json=wanted)
api_delete("https://api.skyline.net/v3/slots/%s" % sid)
send("/x", data=1)
@app.get("/v3/slots")
def handler(): return 1
''')
    found = calls(rows)
    assert found["client.slots.create"]["keys"] == ["band", "body", "exposure", "seconds", "target"] and found["client.slots.create"]["target"] == "slot"
    assert {"module:skyline", "name:sky"} <= set(found["client.slots.create"]["origins"])
    assert "{}/v3/slots/{}/log" in found["requests.request"]["strings"] and found["requests.request"]["methods"] == ["patch"]
    assert "https://api.skyline.net/v3/slots/%s" in found["api_delete"]["strings"] and found["api_delete"]["methods"] == ["delete"] and found["send"]["methods"] == ["patch", "post", "put"]
    assert found["app.get"]["registers"] and not found["send"]["registers"]
    read = next(r for r in rows if r["fact"] == "read" and r["position"][-1] == "pixels")
    assert (read["chain"], read["position"]) == ("late", ["scope", "guide", "pixels"]) and "module:skyline" in read["origins"]
    assert facts_of("a.py", "def broken(:")[0]["fact"] == "unreadable"


def test_javascript_facts():
    rows = facts_of("a.tsx", '''
import Sky, { Client as C } from "skyline-sdk";
const { book: reserve } = require('skyline-sdk/tools');
const c = new C({ apiVersion: "2024-01-01", key });
const half = total / 2 / 1, tidy = s.replace(/["'`/]+/g, '');   // it's "fine"
const slot = await c.slots.create({ target: "M31", exposure: { seconds: 3 }, band });
const { state, begins: start } = slot;
log(slot.scope?.guide["pixels"], start);
const res = await fetch(`https://api.skyline.net/v3/slots/${id + `-${n.part}`}/log`, { method: 'POST', body: b });
app.get('/v3/slots', handler);
export const View = () => <Card title="a > b" on={() => c.slots.drop(slot.id)}>Don't {slot.name}<br/><>it's</></Card>;
''')
    found = calls(rows)
    assert {r["target"]: r["module"] for r in rows if r["fact"] == "import"} == {"Sky": "skyline-sdk", "C": "skyline-sdk", "reserve": "skyline-sdk/tools"}
    assert found["C"]["fact"] == "construct" and found["c.slots.create"]["keys"] == ["band", "exposure", "seconds", "target"] and "module:skyline-sdk" in found["c.slots.create"]["origins"]
    assert found["fetch"]["methods"] == ["post"] and "https://api.skyline.net/v3/slots/{}/log" in found["fetch"]["strings"] and found["app.get"]["registers"]
    reads = {(r["chain"], tuple(r["position"])) for r in rows if r["fact"] == "read"}
    assert {("slot", ("scope", "guide", "pixels")), ("slot", ("state",)), ("slot", ("begins",)), ("n", ("part",)), ("slot", ("id",)), ("slot", ("name",))} <= reads
    assert [(r["target"], r["module"]) for r in rows if r["fact"] == "pin"] == [("apiVersion", "2024-01-01")]
    assert "module:skyline-sdk" in next(r for r in rows if r["fact"] == "read" and r["position"] == ["begins"])["origins"]
    for text in ("x = 'a", "x = `a${b}", "/* a", "x = <p>a", "x = /ab", "x = <p a={1"):
        assert facts_of("a.js", text)[0]["fact"] == "unreadable", text


def finding(kind, subject, op="POST /v3/slots/{slot}/log", severity="breaking", **more):
    row = {
        "vendor": "skyline", "spec_file": "sky.json", "kind": kind, "severity": severity, "op_key": op, "path": op.split(" ")[1] if " " in op else "", "method": op.split(" ")[0].lower(), "operation_id": "", "subject": subject, "status": "", "old": "", "new": "",
        "detail": kind, "root_cause": subject, "occurrences": 1, "affected_op_count": 1, "direct_op_count": 0, "affected_ops": [op], "leaf_fields": [], "in_request": False, "in_response": False, "resource": "slots", "blurb": "",
    }
    return tuple((row | more)[c] for c in drift.FINDING)


SCHEMA = ", ".join(f"{c} " + {"occurrences": "bigint", "affected_op_count": "bigint", "direct_op_count": "bigint", "affected_ops": "array<string>", "leaf_fields": "array<string>", "in_request": "boolean", "in_response": "boolean"}.get(c, "string") for c in drift.FINDING)
FINDINGS = [
    finding("endpoint_removed", "/v3/slots/{slot}/log"), finding("endpoint_removed", "/v3/domes", "GET /v3/domes"), finding("request_field_added_required", "priority"), finding("response_field_removed", "scope.guide.pixels", "GET /v3/slots/{slot}"),
    finding("request_field_removed", "exposure.seconds"), finding("schema_removed", "Plate", "GET /v3/plates", leaf_fields=["emulsion"]), finding("endpoint_added", "/v3/slots/{slot}/notes", "GET /v3/slots/{slot}/notes", "opportunity", affected_ops=["POST /v3/slots/{slot}/log"]),
]
PY_CALL = "import skyline\nrequests.post(f'https://api.skyline.net/v3/slots/{s}/log', json={'exposure': {'seconds': 3}})\n"
PY_READ = "import skyline\nc = skyline.Client()\nx = c.slots.get_one('a')\nprint(x.scope.guide.pixels)\nprint(other.pixels)\n"
FILES = {
    "app/log.py": PY_CALL, "app/read.py": PY_READ, "app/other.py": "import skyline\nprint(mine.scope.guide.pixels)\nopen_dome('GET', 'https://elsewhere.org/v3/domes')\n", "app/none.py": "print('/v3/slots/1/log')\n",
    "tests/test_log.py": PY_CALL, "web/pay.ts": "import S from 'skyline-sdk';\nconst s = new S();\nawait s.slots.log({priority: 1});\nfetch('https://api.skyline.net/v3/plates').then(r => use(r.emulsion));\n",
    "web/pin.ts": "import S from 'skyline-sdk';\nconst s = new S({apiVersion: '2024-01-01'});\nfetch(`https://api.skyline.net/v3/slots/${id}/log`, {method: 'POST'});\n",
    "go/main.go": "// api.skyline.net\n", "gen/api.py": "# @generated\n" + PY_CALL, "web/broken.ts": "import S from 'skyline-sdk';\n// slots, log\nconst x = 'a\n", "web/package.json": json.dumps({"dependencies": {"skyline-sdk": "^3.1.0", "left": "1"}}),
    "requirements.txt": "other==1\nskyline>=3.0\n", "node_modules/x.py": PY_CALL, "app/migrations/m.py": PY_CALL, "lib/skyline/model/slot.py": PY_CALL, "app/notes.md": "api.skyline.net", "app/SKYLINE_KEYS.py": "SKYLINE_KEYS = 1\n",
}


@pytest.fixture(scope="module")
def scanned(spark):
    vendors = spark.createDataFrame([VENDOR], files.VENDORS)
    found = prospects.annotated(spark.createDataFrame(FINDINGS, SCHEMA), vendors)
    checkout = spark.createDataFrame([("me", p, len(t), t) for p, t in FILES.items()], CHECKOUT)
    return vendors, found, checkout, scan.scan(checkout, found, vendors)


def test_candidates_and_evidence(scanned):
    vendors, _, checkout, _ = scanned
    kept = {r.path for r in checkout.where(files.is_candidate(F.col("path"), F.col("n_bytes"))).collect()}
    assert kept == set(FILES) - {"node_modules/x.py", "app/migrations/m.py", "app/notes.md", "web/package.json", "requirements.txt"}
    sources = checkout.where(files.is_candidate(F.col("path"), F.col("n_bytes")))
    got = {r.path: r.evidence for r in files.detect_vendors(sources, vendors).collect()}
    assert set(got) == kept - {"app/none.py", "app/SKYLINE_KEYS.py", "lib/skyline/model/slot.py"} and got["web/pay.ts"] in ("api.skyline.net", "skyline-sdk") and got["app/read.py"] == "import skyline"


def test_walk(spark, tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "app/latin.py").write_bytes(b"x = '\xe9'")
    (tmp_path / "app/large.py").write_text("#" * (files.MAX_BYTES + 1))
    got = {r.path: r for r in files.walk(spark, str(tmp_path), "me").collect()}
    assert set(got) == set(FILES) - {"node_modules/x.py", "app/migrations/m.py", "app/notes.md"}
    assert got["app/log.py"].text == PY_CALL and got["app/log.py"].n_bytes == len(PY_CALL) and got["app/log.py"].repo == "me"


def test_verdicts(scanned):
    got = {(r.path, r.kind, r.subject): (r.verdict, r.proof, r.line) for r in scanned[3].verdicts.collect()}
    say = lambda p, k: {s: v for (path, kind, s), v in got.items() if path == p and kind == k}
    # what shares no term with a file is not proven against it: it has no row
    assert say("app/log.py", "endpoint_removed") == {"/v3/slots/{slot}/log": ("confirmed", "operation_call", 2)}
    assert say("app/log.py", "request_field_added_required")["priority"] == ("confirmed", "field_missing", 2) and say("app/log.py", "request_field_removed")["exposure.seconds"] == ("confirmed", "field_sent", 2)
    assert say("app/read.py", "response_field_removed")["scope.guide.pixels"] == ("confirmed", "field_read", 4)
    assert say("app/other.py", "response_field_removed")["scope.guide.pixels"][0] == "no_dependence" and say("app/other.py", "endpoint_removed")["/v3/domes"][0] == "no_dependence"
    assert say("web/pay.ts", "schema_removed")["Plate"] == ("confirmed", "operation_call", 4)
    assert {v[0] for v in say("web/pin.ts", "endpoint_removed").values()} == {"pinned"} and not say("go/main.go", "endpoint_removed")
    assert {v[0] for v in say("gen/api.py", "endpoint_removed").values()} == {"generated"} and {v[0] for v in say("web/broken.ts", "endpoint_removed").values()} == {"unreadable"}


def test_scan(scanned, tmp_path):
    s = scanned[3]
    assert {r.path for r in s.impacts.collect()} == {"app/log.py", "app/read.py", "web/pay.ts"} and {r.path for r in s.incidental.collect()} == {"tests/test_log.py"}
    assert [(r.vendor, r.language, r.n) for r in s.unmeasured.collect()] == [("skyline", "Go", 1)]
    assert [(r.repo, r.vendor, r.declared) for r in s.pinned.collect()] == [("me", "skyline", "skyline-sdk@^3.1.0")]
    first = s.opportunities.collect()
    assert [(r.subject, r.path) for r in first] == [("/v3/slots/{slot}/notes", "app/log.py")] and s.dropped == 0 and s.exit_status() == 1 and s.exit_status(True) == 0
    text = report.scan_text(s)
    assert "app/log.py:2: breaking: endpoint removed `/v3/slots/{slot}/log` (skyline): a call names path" in text and "skyline: 1 Go files" in text and "skyline at skyline-sdk@^3.1.0 in me" in text
    assert json.loads(report.scan_json(s))["dropped"] == 0
    page = report.scan_markdown(s, most=1)
    assert page.startswith("# Scan\n\n## Impacts (") and "- app/log.py:2: breaking" in page and " more\n" in page and "## Not measured (1)\n\n- skyline: 1 Go files" in page
    assert report.write_scan(s, "markdown", str(tmp_path / "scan.md")) == 1 and (tmp_path / "scan.md").read_text().startswith("# Scan")


def test_briefs(spark, tmp_path):
    rows = [("a", "breaking", "endpoint_removed", f"/x{k}", "gone", "get /x") for k in (2, 1)] + [("a", "opportunity", "spec_added", "s", None, None), ("b", drift.POTENTIAL, "endpoint_removed", "/y", "gone", "get /y")]
    found = spark.createDataFrame(rows, "vendor string, severity string, kind string, subject string, detail string, op_key string")
    lines = [r.text for r in report.brief_lines(found).where("vendor = 'a'").orderBy("rank").collect()]
    assert lines[0] == "# a" and lines[1].startswith("2 breaking, 0 ") and [x.split("`")[1] for x in lines[2:]] == ["/x1", "/x2", "s"] and lines[-1].endswith("(opportunity)")
    report.write_briefs(found, str(tmp_path / "briefs"))
    read = [line for f in sorted((tmp_path / "briefs" / "vendor=a").glob("part-*.txt")) for line in f.read_text().splitlines()]
    assert read == lines and report.brief_lines(found.limit(0)).count() == 0


def test_first_look_is_sound(spark, scanned, monkeypatch):
    """Without it the same is proven, of more pairs."""
    vendors, found, checkout, s = scanned
    sources = checkout.where(files.is_candidate(F.col("path"), F.col("n_bytes")))
    detected = files.detect_vendors(sources, vendors)
    speaking = sources.join(detected.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    facts = code_facts.facts(speaking)
    breaks = dependence.identified(found).where(F.col("severity") != drift.OPPORTUNITY)
    said = lambda: {(r.path, r.finding_id): r.verdict for r in dependence.verdicts(speaking, facts, breaks, detected, vendors).collect()}
    few = said()
    monkeypatch.setattr(prefilter, "pairs", lambda sources, detected, proven, operations: detected.select("repo", "path", "vendor").join(proven.select("vendor", "finding_id"), "vendor").drop("vendor"))
    every = said()
    assert {k for k, v in few.items() if v == "confirmed"} == {k for k, v in every.items() if v == "confirmed"}
    assert few.items() <= every.items() and len(few) < len(every) / 2


def test_pairs_share_a_term(spark):
    sources = spark.createDataFrame([("r", "a", "client.fetch_slots('/v3/slots/x')"), ("r", "b", "X-Site: 1"), ("r", "c", "site"), ("r", "d", None), ("r", "e", "nothing here")], "repo string, path string, text string")
    terms = prefilter.file_terms(sources)
    assert {r.term for r in terms.where("path = 'a'").collect()} == {"client", "fetchslot", "v3", "slot", "x"}
    held = prefilter.filters(terms).select("path", prefilter.holds(F.col("bloom"), F.array(F.lit("x"), F.lit("site"))).alias("h")).where("h")
    assert "b" in {r.path for r in held.collect()} and held.where("path = 'e'").isEmpty()
    schema = "finding_id string, vendor string, leaf string, by_read boolean, by_send boolean, by_call boolean, by_absence boolean, signatures array<string>"
    proven = spark.createDataFrame([("1", "v", "X-Site", False, True, False, False, []), ("2", "v", "slots", False, False, True, False, []), ("3", "v", "x", False, False, True, False, ["sky.slots.list("]), ("4", "v", "x", False, False, True, False, ["createSlot"])], schema)
    operations = spark.createDataFrame([("2", "v", "/v3/slots/{id}", "get", True), ("1", "v", "/none", "get", True)], "finding_id string, vendor string, op_path string, op_method string, own boolean")
    detected = sources.select("repo", "path", F.lit("v").alias("vendor"))
    got = {(r.path, r.finding_id) for r in prefilter.pairs(sources, detected, proven, operations).collect()}
    # all whole names of an idiom are needed; a finding that names nothing whole meets every file
    assert got == {("b", "1"), ("a", "2")} | {(p, "4") for p in "abcde"}


def test_signatures_and_queries(spark, scanned):
    by = {(r.kind, r.subject): r for r in scanned[1].withColumn("query", prospects.query_text(language="python")).collect()}
    r = by["response_field_removed", "scope.guide.pixels"]
    assert r.signatures[:3] == ["/v3/slots/{slot}", "/slots/{slot}", "/v3/slots"] and '"pixels"' in r.signatures and "client.slots." in r.signatures
    assert r.grep.startswith("rg -n --hidden") and "language%3Apython" in r.github_search and r.query == '"pixels" "/v3/slots" language:python'
    assert by["request_field_added_required", "priority"].query == '"/v3/slots" skyline language:python'
    order = prospects.ranked(scanned[1]).orderBy("rank").collect()
    assert [x.rank for x in order] == list(range(1, len(order) + 1)) and len({x.query for x in order}) == len(order)
    given = spark.createDataFrame([("v", k, t, f) for k, (t, f) in enumerate([(0, False), (5, False), (9999, False), (1, True), (7, False), (8, False)], 1)], "vendor string, rank int, total bigint, failed boolean")
    asked = prospects.until_enough(given, 2, 6).orderBy("rank").collect()
    assert [x.precision for x in asked] == ["none", "usable", "low", "error", "usable"]
    src = spark.createDataFrame([("a/b", "x.py", 'pixels of "/v3/slots"'), ("a/b", "y.py", "pixels")], "repo string, path string, text string")
    hits = prospects.local_search(spark.createDataFrame([("f", '"pixels" "/v3/slots" language:python')], "finding_id string, query string"), src).collect()
    assert [(h.total, [x.path for x in h.hits]) for h in hits] == [(1, ["x.py"])]


def test_classes_of_finds(spark):
    rows = [("me/app", "src/a.py", 1), ("me/app", "src/b.py", 3), ("skyline-labs/x", "a.py", 1), ("you/skyline-sdk", "a.py", 1), ("z/awesome-things", "a.py", 1), ("q/w", "venv/lib/a.py", 1), ("q/v", "dist/a.js", 1)]
    df = spark.createDataFrame([(r, p, list(range(n))) for r, p, n in rows], "repo string, path string, sites array<int>")
    kind = prospects.classified(F.col("repo"), F.col("path"), F.lit("skyline"), F.array(F.lit("skyline-labs")), files.is_copied_path(F.col("path")), files.is_generated_path(F.col("path")), ["hikari"])
    df = df.withColumn("kind", kind["kind"])
    assert {(r.kind, r.n) for r in prospects.bucket_counts(df).collect()} == {("integrator", 2), ("vendor_owned", 1), ("ecosystem", 1), ("corpus", 1), ("vendored", 1), ("generated", 1)}
    assert {r.repo: r.path for r in prospects.one_per_repo(df).collect()}["me/app"] == "src/b.py"
    held, fresh = (spark.createDataFrame(x, "vendor string, n int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert {tuple(r) for r in prospects.merged(held, fresh).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {(r.verdict, r.percent) for r in prospects.survival(spark.createDataFrame([("x",), ("x",), ("y",)], "verdict string")).collect()} == {("x", 66), ("y", 33)}


def test_reports(spark, scanned, tmp_path):
    found = scanned[1].select(*drift.FINDING)
    more = found.unionByName(spark.createDataFrame([finding("param_removed", f"p{k}", severity="potentially_breaking") for k in range(20)], SCHEMA))
    text = report.to_markdown(more, 90)
    assert "| skyline | 6 | 20 | 1 |" in text and "- and 15 more" in text and text.count("\n- **") == 12
    assert {json.loads(r.json)["method"] for r in report.as_json(found).collect()} == {"POST", "GET"}
    doc = json.loads(report.by_vendor(found).first().document)
    assert doc["vendor"] == "skyline" and len(doc["findings"]) == 7
    report.write_by_vendor(found, f"{tmp_path}/out")
    assert sorted(r.subject for r in report.read_findings(spark, f"{tmp_path}/out").collect()) == sorted(r.subject for r in found.collect())


BODIES = "source string, taken_on date, fmt string, body binary"


def test_archive(spark, tmp_path):
    day = lambda n: datetime.date(2024, 1, n)
    doc = lambda **x: json.dumps({"openapi": "3.0.0", "paths": {}} | x).encode()
    first = [("a", day(1), "openapi", doc(example="1")), ("b", day(1), "openapi", b"<html>"), ("c", day(1), "graphql", b"type Q { a: Int }  \n"), ("d", day(1), "openapi", None), ("e", day(1), "openapi", b'["x"]'), ("f", day(1), "discovery", doc())]
    path = str(tmp_path / "archive")
    got = {r.source: (r.status, r.detail) for r in archive.write_changes(spark.createDataFrame(first, BODIES), path).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "stored", "b": "rejected", "c": "stored", "d": "rejected", "e": "rejected", "f": "rejected"} and got["d"][1] == "empty body" and got["b"][1].startswith("HTML")
    same = doc(example="2", paths={}, info={"at": "x"})
    later = [("a", day(2), "openapi", doc(examples=["9"])), ("c", day(2), "graphql", b"type Q { a: Int }\n"), ("a", day(3), "openapi", same)]
    assert {(r.source, r.taken_on.day): r.status for r in archive.write_changes(spark.createDataFrame(later, BODIES), path).collect()} == {("a", 2): "unchanged", ("c", 2): "unchanged", ("a", 3): "stored"}
    spark.createDataFrame([("a", day(4), "openapi", same), ("a", day(5), "openapi", doc(info={"at": "y"}))], BODIES).write.parquet(f"{tmp_path}/in")
    archive.stream_changes(spark.readStream.schema(BODIES).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/cp").awaitTermination()
    index = archive.index(spark, path)
    assert sorted((r.source, r.taken_on.day) for r in index.collect()) == [("a", 1), ("a", 3), ("a", 5), ("c", 1)]
    last = {r.source: r for r in archive.latest(index).collect()}
    assert archive.body_of(spark, path, last["a"].digest) == doc(info={"at": "y"}) and archive.body_of(spark, path, "none") is None
    back = {r.source: (r.too_short, r.first_day.day, r.observable_days) for r in archive.as_of(index, F.lit(day(1))).collect()}
    assert back == {"a": (True, 1, 4), "c": (True, 1, 0)}
    assert {r.source: (r.age_days, r.quiet) for r in archive.liveness(index, F.lit(datetime.date(2024, 2, 5))).collect()} == {"a": (31, True), "c": (35, True)}
    a, b = (json.dumps({"paths": {"x": [k, {"nonce": u, "at": f"2024-01-0{k}T10:00:00Z"}]}}).encode() for k, u in ((1, "6f9619ff-8b86-d011-b42d-00cf4fc964ff"), (1, "7f9619ff-8b86-d011-b42d-00cf4fc964ff")))
    digests = archive.looked_at(spark.createDataFrame([("x", day(1), "openapi", a), ("x", day(1), "openapi", b)], BODIES)).select("digest").distinct()
    assert digests.count() == 1 and archive.index(spark, f"{tmp_path}/nowhere").count() == 0


def test_order_of_names_is_tested_without_working_them_out_for_each(spark):
    rows = spark.createDataFrame([("a b c b d",), ("b a",), ("a",), (None,)], "t string")
    words = F.split("t", " ")
    out = rows.select("t", dependence.in_order(words, F.array(F.lit("b"), F.lit("d"))).alias("x"), dependence.in_order(words, F.array(F.get(words, F.lit(1)), F.get(words, F.lit(0)))).alias("y"))
    assert {r.t: (r.x, r.y) for r in out.collect()} == {"a b c b d": (True, False), "b a": (False, False), "a": (False, False), None: (None, None)}
    plan = rows.select(dependence.in_order(words, F.array(F.upper("t"))).alias("z"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
