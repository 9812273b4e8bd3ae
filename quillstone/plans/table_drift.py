"""The change rules over the plain tables, beside SQL of the same findings.

Rows of lineitem with their order, customer and part are read as what two sets of API descriptions
say, before and from 1998 on: a market segment is a vendor, a brand a file, a part's type and size
with a return flag an operation, and so on (FACETS). All rows count. The same text makes the facts
here and in the SQL; the rules do not share a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans import drift
from quillstone.plans.tables import QUERIES, SQL
from quillstone.sources.scratch import cut, table

BASE = """SELECT c_mktsegment AS vendor, p_brand AS spec_file, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'old' ELSE 'new' END AS side,
CASE WHEN l_linestatus = 'F' THEN 'get' ELSE 'post' END AS method,
concat(CASE WHEN l_linestatus = 'F' THEN 'GET' ELSE 'POST' END, ' /', lower(p_type), '/', CAST(p_size AS STRING), '/{{', lower(l_returnflag), '}}') AS op_key,
concat('S', CAST(l_suppkey AS STRING)) AS schema, concat('S', CAST(p_size AS STRING)) AS target, lower(substr(o_orderpriority, 3)) AS word, CASE WHEN l_linenumber <= 4 THEN 'request' ELSE 'response' END AS direction,
p_type, p_size, l_linenumber, l_quantity, l_discount, l_tax, o_orderstatus, o_orderpriority, c_nationkey
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey"""

_COLUMNS = "op_key part key type required nullable deprecated values shape target".split()


def _facet(group: str, **have: str) -> str:
    """One facet's facts: an aggregation of base rows."""
    plain = {"op_key": "''", "part": "''", "key": "''", "type": "''", "required": "false", "nullable": "false", "deprecated": "false", "values": "NONE()", "shape": "''", "target": "CAST(NULL AS STRING)"}
    columns = ", ".join(f"{(plain | have)[c]} AS {'vals' if c == 'values' else c}" for c in _COLUMNS)
    return f"SELECT vendor, spec_file, side, 'FACET' AS facet, {columns} FROM base GROUP BY vendor, spec_file, side{', ' if group else ''}{group}"


#: NONE() and SET(x) stand for no values and for the sorted distinct ones.
FACETS = {
    "op": _facet("op_key, method", op_key="op_key", key="CASE WHEN max(l_quantity) >= 48 THEN min(o_orderpriority) ELSE '' END", type="method", required="max(l_discount) >= 0.1", deprecated="min(l_tax) >= 0.06"),
    "scheme": _facet("p_type, p_size", key="concat(lower(p_type), CAST(p_size AS STRING))"),
    "param": _facet(
        "op_key, o_orderstatus, CASE WHEN l_linenumber <= 3 THEN 'query' WHEN l_linenumber <= 6 THEN 'header' ELSE 'path' END", op_key="op_key", part="CASE WHEN l_linenumber <= 3 THEN 'query' WHEN l_linenumber <= 6 THEN 'header' ELSE 'path' END",
        key="lower(o_orderstatus)", type="CASE WHEN max(l_quantity) > 25 THEN 'integer' ELSE 'string' END", required="max(l_discount) >= 0.07", deprecated="min(l_tax) >= 0.05", values="SET(o_orderpriority)",
    ),
    "field": _facet(
        "op_key, direction, word", op_key="op_key", part="CASE WHEN direction = 'request' THEN 'request' ELSE 'response/200' END", key="word", type="CASE WHEN max(l_quantity) > 25 THEN 'integer' ELSE 'string' END",
        required="max(l_discount) >= 0.07", nullable="min(l_tax) >= 0.05", values="SET(o_orderstatus)",
    ),
    "response": _facet("op_key, CASE o_orderstatus WHEN 'F' THEN '200' WHEN 'O' THEN '201' ELSE '404' END", op_key="op_key", key="CASE o_orderstatus WHEN 'F' THEN '200' WHEN 'O' THEN '201' ELSE '404' END"),
    "security": _facet("op_key", op_key="op_key", values="SET(CASE WHEN l_linenumber < 4 THEN 'badge' WHEN l_linenumber < 6 THEN 'badge,ticket' ELSE 'ticket' END)"),
    "server": _facet("c_nationkey", key="concat('https://n', CAST(c_nationkey AS STRING), '.example.net')"),
    "op_server": _facet("op_key, o_orderstatus", op_key="op_key", key="concat('https://', lower(o_orderstatus), '.example.net')"),
    "schema": _facet("schema", key="schema", type="'object'", shape="CAST(max(l_linenumber) AS STRING)"),
    "schema_field": _facet(
        "schema, word", part="schema", key="word", type="CASE WHEN max(l_quantity) > 30 THEN 'integer' ELSE 'string' END", required="max(l_discount) >= 0.08", nullable="min(l_tax) >= 0.05", values="SET(o_orderstatus)",
        shape="CASE WHEN max(l_quantity) > 30 THEN 'integer' ELSE 'string' END",
    ),
    "root": _facet("op_key, direction, schema", op_key="op_key", part="direction", key="schema"),
    "ref": _facet("schema, target", part="schema", key="target"),
}
FACETS = {k: v.replace("FACET", k) for k, v in FACETS.items()}
SHOWN = ["vendor", "spec_file", "kind", "severity", "op_key", "subject", "status", "old", "new"]


#: Rows of lineitem to a task that sorts them; there are as many tasks as that takes.
ROWS = 500_000
PARTITIONS = "spark.sql.shuffle.partitions"


def _joined(spark: SparkSession, tables: dict[str, DataFrame], n: int) -> DataFrame:
    """Base rows, as a table of its own; its joins are dealt to n tasks at least."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(max(n, int(before))))
    try:
        return cut(spark.sql(BASE, **tables))
    finally:
        spark.conf.set(PARTITIONS, before)


def _from(facet: str) -> str:
    """Where a facet reads base rows. The least text and sets of values are aggregated by sorting what a task has read, and one that reads a packed file has read millions of rows; so these are dealt by their group first, ROWS to a task."""
    text = FACETS[facet]
    by = next((k for k in ("op_key", "schema") if f"GROUP BY vendor, spec_file, side, {k}" in text), "base")
    return text.replace("FROM base", f"FROM {{{by if 'SET(' in text or 'min(o_' in text else 'base'}}}")


def facts(spark: SparkSession, sf_dir: str, facets: list[str]) -> DataFrame:
    """Facts of the facets, from the tables."""
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part")}
    n = -(-tables["lineitem"].count() // ROWS) or 1
    base = _joined(spark, tables, n)
    dealt = {by: base.repartition(n, "vendor", "spec_file", by) if n > 1 else base for by in ("op_key", "schema")}
    text = " UNION ALL ".join(_from(f) for f in facets).replace("NONE()", "CAST(NULL AS ARRAY<STRING>)").replace("SET(", "sort_array(collect_set(").replace(") AS vals", ")) AS vals").replace("CAST(NULL AS ARRAY<STRING>)) AS vals", "CAST(NULL AS ARRAY<STRING>) AS vals")
    rows = spark.sql(text, **{k: d for k, d in {"base": base, **dealt}.items() if f"{{{k}}}" in text})
    in_body = F.when(F.col("facet") == "field", F.col("key"))
    none = F.array().cast("array<string>")
    return rows.select(
        "vendor", "spec_file", "side", "facet", "op_key", "part", "key", "type", "required", "nullable", "deprecated", F.col("vals").alias("values"), F.lit(0).alias("seq"), in_body.alias("blind"), in_body.alias("bare"),
        none.alias("up"), in_body.alias("cause"), in_body.alias("leaf"), F.lit(1).alias("deep"), F.lit(False).alias("root"), "shape", "target", F.lit("").alias("note"),
    )


def _sql(facets: list[str], rules: str) -> str:
    base = BASE.replace("{{", "{").replace("}}", "}")
    for t in ("lineitem", "orders", "customer", "part"):
        base = base.replace("{" + t + "}", t)
    text = " UNION ALL ".join(FACETS[f] for f in facets).replace("NONE()", "CAST(NULL AS VARCHAR[])").replace("SET(", "list_sort(list(DISTINCT ").replace(") AS vals", ")) AS vals").replace("CAST(NULL AS VARCHAR[])) AS vals", "CAST(NULL AS VARCHAR[]) AS vals")
    return f"""WITH RECURSIVE base AS MATERIALIZED ({base}), f0 AS MATERIALIZED ({text}),
ops AS (SELECT vendor, spec_file, side, op_key AS id, regexp_replace(op_key, '\\{{[^}}]*\\}}', '{{}}', 'g') AS seen, type, key AS oid FROM f0 WHERE facet = 'op'),
lo AS (SELECT * FROM ops o WHERE side = 'old' AND NOT EXISTS (FROM ops n WHERE n.side = 'new' AND n.vendor = o.vendor AND n.spec_file = o.spec_file AND n.id = o.id)),
rn AS (SELECT * FROM ops n WHERE side = 'new' AND NOT EXISTS (FROM ops o WHERE o.side = 'old' AND n.vendor = o.vendor AND n.spec_file = o.spec_file AND n.id = o.id)),
l1 AS (SELECT *, row_number() OVER (PARTITION BY vendor, spec_file, seen ORDER BY id) AS k FROM lo), r1 AS (SELECT *, row_number() OVER (PARTITION BY vendor, spec_file, seen ORDER BY id) AS k FROM rn),
m1 AS (SELECT l1.vendor, l1.spec_file, l1.id AS old_key, r1.id AS new_key FROM l1 JOIN r1 USING (vendor, spec_file, seen, k)),
l2 AS (SELECT *, row_number() OVER (PARTITION BY vendor, spec_file, type, oid ORDER BY id) AS k FROM lo WHERE oid <> '' AND (vendor, spec_file, id) NOT IN (SELECT (vendor, spec_file, old_key) FROM m1)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY vendor, spec_file, type, oid ORDER BY id) AS k FROM rn WHERE oid <> '' AND (vendor, spec_file, id) NOT IN (SELECT (vendor, spec_file, new_key) FROM m1)),
moves AS MATERIALIZED (FROM m1 UNION ALL SELECT l2.vendor, l2.spec_file, l2.id, r2.id FROM l2 JOIN r2 USING (vendor, spec_file, type, oid, k)),
f AS MATERIALIZED (SELECT f0.* REPLACE (coalesce(new_key, op_key) AS op_key) FROM f0 LEFT JOIN moves m ON side = 'old' AND m.vendor = f0.vendor AND m.spec_file = f0.spec_file AND old_key = op_key),
files AS (SELECT vendor, spec_file, bool_or(side = 'old') AS was, bool_or(side = 'new') AS now_, count(*) FILTER (WHERE side = 'new' AND facet = 'op') AS n_new FROM f GROUP BY 1, 2),
o AS (SELECT * FROM f WHERE side = 'old'), n AS (SELECT * FROM f WHERE side = 'new'),
p AS MATERIALIZED (SELECT vendor, spec_file, facet, op_key, part, key, o.side IS NOT NULL AS ho, n.side IS NOT NULL AS hn, o.type AS ot, n.type AS nt, o.required AS oreq, n.required AS nreq, o.nullable AS onul, n.nullable AS nnul, o.deprecated AS odep, n.deprecated AS ndep,
 o.vals AS ov, n.vals AS nv, o.shape AS os, n.shape AS ns, list_sort(list_filter(o.vals, lambda x: NOT list_contains(n.vals, x))) AS lost, list_sort(list_filter(n.vals, lambda x: NOT list_contains(o.vals, x))) AS gained
 FROM o FULL JOIN n USING (vendor, spec_file, facet, op_key, part, key) JOIN files USING (vendor, spec_file) WHERE was AND now_),
kept AS (SELECT vendor, spec_file, op_key FROM p WHERE facet = 'op' AND ho AND hn), i AS MATERIALIZED (SELECT p.* FROM p SEMI JOIN kept USING (vendor, spec_file, op_key)){rules}"""


def _say(rows: str, kind: str, severity: str, when: str, subject: str = "key", old: str = "''", new: str = "''", status: str = "''", op: str = "op_key") -> str:
    quote = lambda x: f"'{x}'" if x.replace("_", "").isalpha() else x
    return f"SELECT vendor, spec_file, {quote(kind)} AS kind, {quote(severity)} AS severity, {op} AS op_key, {subject} AS subject, {status} AS status, {old} AS old, {new} AS new FROM {rows} WHERE {when}"


def _shown(column: str) -> str:
    return f"array_to_string({column}, ',')"


B, PB, OPP = drift.BREAKING, drift.POTENTIAL, drift.OPPORTUNITY
_BOTH, _LOST, _COME = "ho AND hn", "ho AND NOT hn", "hn AND NOT ho"
_FEWER, _MORE = "ho AND hn AND len(lost) > 0", "ho AND hn AND len(gained) > 0"
_RETYPED = "ho AND hn AND ot <> nt"
_turned = lambda c: f"ho AND hn AND NOT o{c} AND n{c}"


def _query(name: str, facets: list[str], make, rules: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(facts(spark, sf_dir, facets))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = _sql(facets, rules)


def _family(rules):
    """The findings of one family of rules."""

    return lambda rows: _said(rules(drift.Sides(rows)))


def _said(parts: list[DataFrame]) -> DataFrame:
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    return found.select(*SHOWN)


def _union(*parts: str) -> str:
    return " " + " UNION ALL ".join(parts)


_query(
    "drift_operations", ["op", "scheme"], _family(drift.files_and_operations),
    """, prior AS (SELECT vendor, spec_file, regexp_replace(op_key, '\\{[^}]*\\}', '{}', 'g') AS seen FROM f0 WHERE facet = 'op' AND side = 'old'),
mv AS (SELECT m.*, n.key AS oid FROM moves m LEFT JOIN n ON n.facet = 'op' AND n.vendor = m.vendor AND n.spec_file = m.spec_file AND n.op_key = m.new_key WHERE regexp_replace(old_key, '\\{[^}]*\\}', '{}', 'g') <> regexp_replace(new_key, '\\{[^}]*\\}', '{}', 'g')),
fresh AS (SELECT * FROM p WHERE facet = 'op' AND hn AND NOT ho AND (vendor, spec_file, regexp_replace(op_key, '\\{[^}]*\\}', '{}', 'g')) NOT IN (SELECT (vendor, spec_file, seen) FROM prior))"""
    + _union(
        _say("files", "spec_removed", B, "was AND NOT now_", "spec_file", op="''"), _say("files", "spec_added", OPP, "now_ AND NOT was", "spec_file", new="CAST(n_new AS VARCHAR)", op="''"),
        _say("mv", "endpoint_moved", B, "true", "coalesce(nullif(oid, ''), old_key)", "old_key", "new_key", op="new_key"), _say("p", "endpoint_removed", B, f"facet = 'op' AND {_LOST}", "regexp_replace(op_key, '^[^ ]* ', '')"),
        _say("fresh", "endpoint_added", OPP, "true", "regexp_replace(op_key, '^[^ ]* ', '')", new="op_key"), _say("p", "endpoint_deprecated", PB, f"facet = 'op' AND {_turned('dep')}", "'<operation>'"),
        _say("p", "request_body_now_required", B, f"facet = 'op' AND {_turned('req')}", "'<body>'"), _say("p", "security_scheme_removed", B, f"facet = 'scheme' AND {_LOST}"),
    ),
)
_query(
    "drift_parameters", ["op", "param"], _family(drift.parameters),
    ", q AS (SELECT * FROM i WHERE facet = 'param')"
    + _union(
        _say("q", "param_removed", PB, f"part <> 'path' AND {_LOST}"), _say("q", "param_added_required", B, f"part <> 'path' AND nreq AND {_COME}"), _say("q", "param_now_required", B, _turned("req")),
        _say("q", "param_type_changed", B, _RETYPED, old="ot", new="nt"), _say("q", "param_deprecated", PB, _turned("dep")), _say("q", "request_enum_value_removed", B, _FEWER, old=_shown("lost")),
    ),
)
_side = "CASE WHEN part = 'request' THEN 'request' ELSE 'response' END"
_code = "CASE WHEN part = 'request' THEN '' ELSE '200' END"
_query(
    "drift_body_fields", ["op", "field"], _family(drift.body_fields),
    ", q AS (SELECT *, bool_or(ho) OVER (PARTITION BY vendor, spec_file, op_key, part) AS any_o FROM i WHERE facet = 'field')"
    + _union(
        _say("q", f"concat({_side}, '_field_removed')", f"CASE WHEN part = 'request' THEN '{PB}' ELSE '{B}' END", _LOST, status=_code), _say("q", f"concat({_side}, '_field_type_changed')", B, _RETYPED, old="ot", new="nt", status=_code),
        _say("q", "request_field_now_required", B, f"part = 'request' AND {_turned('req')}"), _say("q", "response_field_now_nullable", PB, f"part <> 'request' AND {_turned('nul')}", status=_code),
        _say("q", f"concat({_side}, '_enum_value_removed')", f"CASE WHEN part = 'request' THEN '{B}' ELSE '{PB}' END", _FEWER, old=_shown("lost"), status=_code), _say("q", "response_enum_value_added", PB, f"part <> 'request' AND {_MORE}", new=_shown("gained"), status=_code),
        _say("q", "request_field_added_required", B, f"part = 'request' AND any_o AND nreq AND {_COME}"),
    ),
)
_query(
    "drift_statuses", ["op", "response"], _family(drift.statuses),
    ", q AS (SELECT *, bool_or(hn) OVER (PARTITION BY vendor, spec_file, op_key) AS any2 FROM i WHERE facet = 'response' AND key LIKE '2%')"
    + _union(_say("q", "response_status_removed", f"CASE WHEN any2 THEN '{PB}' ELSE '{B}' END", _LOST, status="key")),
)
_query(
    "drift_security", ["op", "security", "scheme"], _family(drift.security),
    """, q AS (SELECT vendor, spec_file, op_key, unnest(ov) AS a, ov, nv FROM i WHERE facet = 'security' AND ho AND hn AND (vendor, spec_file) IN (SELECT (vendor, spec_file) FROM o WHERE facet = 'scheme')),
hit AS (SELECT DISTINCT vendor, spec_file, op_key, ov, nv FROM q WHERE len(list_filter(nv, lambda b: len(list_filter(string_split(b, ','), lambda x: NOT list_contains(string_split(a, ','), x))) = 0)) = 0)"""
    + _union(_say("hit", "security_requirement_added", B, "true", "'<security>'", "array_to_string(list_transform(ov, lambda x: replace(x, ',', '+')), ' OR ')", "array_to_string(list_transform(nv, lambda x: replace(x, ',', '+')), ' OR ')")),
)
_query(
    "drift_servers", ["op", "server", "op_server"], _family(drift.servers),
    """, s AS (SELECT vendor, spec_file, facet, op_key, list_sort(list(DISTINCT key) FILTER (WHERE side = 'old')) AS a, list_sort(list(DISTINCT key) FILTER (WHERE side = 'new')) AS b FROM f WHERE facet IN ('server', 'op_server') GROUP BY 1, 2, 3, 4),
hit AS (SELECT * FROM s WHERE len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) AND (facet = 'server' OR (vendor, spec_file, op_key) IN (SELECT (vendor, spec_file, op_key) FROM kept)))"""
    + _union(_say("hit", "CASE WHEN facet = 'server' THEN 'server_url_changed' ELSE 'operation_server_changed' END", B, "true", "'<server>'", _shown("a"), _shown("b"))),
)
_REACH = """, edges AS (SELECT DISTINCT side, vendor, spec_file, part AS src, key AS dst FROM f WHERE facet = 'ref'),
reach AS (SELECT side, vendor, spec_file, op_key, part, key AS schema FROM f WHERE facet = 'root' UNION SELECT r.side, r.vendor, r.spec_file, r.op_key, r.part, e.dst FROM reach r JOIN edges e ON e.side = r.side AND e.vendor = r.vendor AND e.spec_file = r.spec_file AND e.src = r.schema),
used AS (SELECT vendor, spec_file, schema, bool_or(part = 'request') AS req, bool_or(part = 'response') AS res FROM reach GROUP BY 1, 2, 3)"""


_query(
    "drift_schema_fields", ["op", "root", "ref", "schema", "schema_field"], lambda rows: _schema_fields(rows),
    _REACH
    + f""", both_sides AS (SELECT vendor, spec_file, key AS schema FROM p WHERE facet = 'schema' AND ho AND hn), linked AS (SELECT DISTINCT vendor, spec_file FROM f WHERE facet = 'root'),
q AS (SELECT p.*, part AS schema, coalesce(req, false) AS req, coalesce(res, false) AS res, concat(part, '.', key) AS name,
 concat(nt, CASE WHEN len(nv) > 0 THEN concat(' enum(', array_to_string(nv, '|'), ')') ELSE '' END, CASE WHEN nnul THEN ' nullable' ELSE '' END) AS sig
 FROM p SEMI JOIN both_sides b ON p.vendor = b.vendor AND p.spec_file = b.spec_file AND p.part = b.schema LEFT JOIN used u ON p.vendor = u.vendor AND p.spec_file = u.spec_file AND p.part = u.schema
 WHERE facet = 'schema_field' AND (u.schema IS NOT NULL OR (p.vendor, p.spec_file) NOT IN (SELECT (vendor, spec_file) FROM linked)))"""
    + _union(
        _say("q", "schema_field_removed", f"CASE WHEN res THEN '{B}' ELSE '{PB}' END", _LOST, "name", op="''"), _say("q", "schema_field_type_changed", B, f"{_RETYPED} AND os IS DISTINCT FROM ns AND (ov IS NULL OR nv IS NULL)", "name", "ot", "nt", op="''"),
        _say("q", "schema_enum_value_removed", f"CASE WHEN req THEN '{B}' ELSE '{PB}' END", _FEWER, "name", _shown("lost"), op="''"), _say("q", "schema_enum_value_added", PB, f"{_MORE} AND res", "name", new=_shown("gained"), op="''"),
        _say("q", "schema_field_now_required", B, f"{_turned('req')} AND req", "name", op="''"), _say("q", "schema_field_now_nullable", PB, _turned("nul"), "name", op="''"),
        _say("q", "schema_field_added_required", B, f"{_COME} AND nreq AND req", "name", new="sig", op="''"), _say("q", "schema_field_added", OPP, f"{_COME} AND NOT nreq AND req", "name", new="sig", op="''"),
        _say("q", "response_field_added", OPP, f"{_COME} AND NOT nreq AND NOT req", "name", new="sig", op="''"),
    ),
)


def _schema_fields(rows: DataFrame) -> DataFrame:
    s = drift.Sides(rows)
    # no schema is judged here: drift_schema_removals does that
    none = s.files.select("vendor", "spec_file", F.lit("").alias("schema"), F.lit("").alias("reason")).limit(0)
    return _said(drift.schemas(s, none))


_query(
    "drift_collapsed", ["op", "param", "scheme"], lambda rows: _collapsed(rows),
    """, q AS (SELECT * FROM i WHERE facet = 'param'), all_ AS ("""
    + _union(
        _say("q", "param_removed", PB, f"part <> 'path' AND {_LOST}"), _say("q", "param_now_required", B, _turned("req")), _say("q", "param_deprecated", PB, _turned("dep")), _say("q", "request_enum_value_removed", B, _FEWER, old=_shown("lost")),
    )
    + """), k AS (SELECT *, CASE WHEN kind = 'request_enum_value_removed' THEN 'enum_value_removed' ELSE kind END AS kind_class FROM all_),
d AS (SELECT vendor, kind_class, subject, list_sort(list(DISTINCT op_key)) AS ops FROM k GROUP BY 1, 2, 3)
SELECT k.vendor, k.subject AS root_cause, arg_min(kind, struct_pack(a := length(k.subject), b := op_key, c := spec_file)) AS kind, arg_min(op_key, struct_pack(a := length(k.subject), b := op_key, c := spec_file)) AS op_key, CAST(count(*) AS BIGINT) AS occurrences,
CAST(any_value(len(ops)) AS BIGINT) AS affected_op_count, any_value(array_to_string(list_slice(ops, 1, 200), ',')) AS affected FROM k JOIN d ON k.vendor = d.vendor AND k.kind_class = d.kind_class AND k.subject = d.subject GROUP BY k.vendor, k.kind_class, k.subject""",
)


def _collapsed(rows: DataFrame) -> DataFrame:
    s = drift.Sides(rows)
    some = None
    for part in drift.parameters(s):
        some = part if some is None else some.unionByName(part)
    found = drift.finished(s, some.where("kind in ('param_removed', 'param_now_required', 'param_deprecated', 'request_enum_value_removed')"))
    return drift.collapsed(found).select("vendor", "root_cause", "kind", "op_key", "occurrences", "affected_op_count", F.array_join("affected_ops", ",").alias("affected"))


_query(
    "drift_schema_removals", ["op", "field", "root", "ref", "schema", "schema_field"], lambda rows: drift.removal_reasons(drift.Sides(rows)),
    _REACH.replace("used AS", "used_any AS")
    + """, used AS (SELECT vendor, spec_file, schema, bool_or(part = 'request') AS req, bool_or(part = 'response') AS res FROM reach WHERE side = 'old' GROUP BY 1, 2, 3),
os AS (SELECT vendor, spec_file, key AS schema, type, shape FROM o WHERE facet = 'schema'), ns AS (SELECT vendor, spec_file, key AS schema, type, shape FROM n WHERE facet = 'schema'),
gone AS MATERIALIZED (SELECT os.* FROM os ANTI JOIN ns USING (vendor, spec_file, schema) SEMI JOIN (FROM files WHERE was AND now_) USING (vendor, spec_file)),
direct AS MATERIALIZED (SELECT DISTINCT o.vendor, o.spec_file, o.key AS schema, o.op_key FROM o SEMI JOIN gone g ON g.vendor = o.vendor AND g.spec_file = o.spec_file AND g.schema = o.key WHERE facet = 'root'),
carrying AS MATERIALIZED (SELECT d.*, CASE WHEN req AND res THEN 'all' WHEN req THEN 'request' WHEN res THEN 'response' ELSE 'all' END AS way FROM direct d SEMI JOIN kept USING (vendor, spec_file, op_key) LEFT JOIN used USING (vendor, spec_file, schema)),
par AS (SELECT e.vendor, e.spec_file, e.src AS parent, g.schema, g.shape FROM edges e JOIN gone g ON e.side = 'old' AND e.vendor = g.vendor AND e.spec_file = g.spec_file AND e.dst = g.schema AND e.src <> g.schema),
named AS (SELECT DISTINCT e.vendor, e.spec_file, e.src AS parent, ns.shape FROM edges e JOIN ns ON e.side = 'new' AND e.vendor = ns.vendor AND e.spec_file = ns.spec_file AND e.dst = ns.schema),
judged AS (SELECT par.*, a.schema IS NOT NULL AND b.schema IS NOT NULL AS live, g.schema IS NOT NULL AS removed, named.parent IS NOT NULL OR coalesce(a.shape = b.shape, false) AS same FROM par
 LEFT JOIN os a ON a.vendor = par.vendor AND a.spec_file = par.spec_file AND a.schema = parent LEFT JOIN ns b ON b.vendor = par.vendor AND b.spec_file = par.spec_file AND b.schema = parent
 LEFT JOIN gone g ON g.vendor = par.vendor AND g.spec_file = par.spec_file AND g.schema = par.parent LEFT JOIN named ON named.vendor = par.vendor AND named.spec_file = par.spec_file AND named.parent = par.parent AND named.shape = par.shape),
by_parents AS (SELECT vendor, spec_file, schema, bool_and(removed) AS parents_gone, count(*) FILTER (WHERE live) AS n_live, bool_and(same) FILTER (WHERE live) AS at_parents FROM judged GROUP BY 1, 2, 3),
of_ AS (SELECT vendor, spec_file, part AS schema, key, shape FROM o WHERE facet = 'schema_field'), nf AS (SELECT vendor, spec_file, part AS other, key, shape FROM n WHERE facet = 'schema_field'),
offered AS (SELECT c.*, r.key AS other FROM carrying c JOIN n r ON r.facet = 'root' AND r.vendor = c.vendor AND r.spec_file = c.spec_file AND r.op_key = c.op_key AND (way = 'all' OR way = r.part)),
pr AS (SELECT DISTINCT vendor, spec_file, schema, other, way FROM offered),
kept_f AS (SELECT pr.vendor, pr.spec_file, pr.schema, pr.other, bool_and(of_.shape IS NOT DISTINCT FROM nf.shape) AS fk FROM pr JOIN of_ USING (vendor, spec_file, schema) LEFT JOIN nf ON nf.vendor = pr.vendor AND nf.spec_file = pr.spec_file AND nf.other = pr.other AND nf.key = of_.key GROUP BY 1, 2, 3, 4),
fits AS (SELECT pr.vendor, pr.spec_file, pr.schema, pr.other, os.shape = ns.shape OR (way = 'response' AND os.type = ns.type AND coalesce(fk, true)) AS fits FROM pr JOIN os USING (vendor, spec_file, schema) JOIN ns ON ns.vendor = pr.vendor AND ns.spec_file = pr.spec_file AND ns.schema = pr.other LEFT JOIN kept_f k ON k.vendor = pr.vendor AND k.spec_file = pr.spec_file AND k.schema = pr.schema AND k.other = pr.other),
by_op AS (SELECT o.vendor, o.spec_file, o.schema, o.op_key, bool_or(fits) AS fits FROM offered o JOIN fits USING (vendor, spec_file, schema, other) GROUP BY 1, 2, 3, 4),
by_roots AS (SELECT c.vendor, c.spec_file, c.schema, count(*) AS n_carrying, bool_and(coalesce(fits, false)) AS renamed FROM carrying c LEFT JOIN by_op USING (vendor, spec_file, schema, op_key) GROUP BY 1, 2, 3),
vis AS (SELECT DISTINCT side, vendor, spec_file, op_key, split_part(part, '/', 1) AS d, key AS leaf FROM f WHERE facet = 'field'),
asked AS (SELECT c.*, of_.key AS leaf, EXISTS (FROM vis v WHERE v.side = 'old' AND v.vendor = c.vendor AND v.spec_file = c.spec_file AND v.op_key = c.op_key AND v.leaf = of_.key AND (way = 'all' OR v.d = way)) AS in_old,
 EXISTS (FROM vis v WHERE v.side = 'new' AND v.vendor = c.vendor AND v.spec_file = c.spec_file AND v.op_key = c.op_key AND v.leaf = of_.key AND (way = 'all' OR v.d = way)) AS in_new FROM carrying c JOIN of_ USING (vendor, spec_file, schema)),
by_names AS (SELECT vendor, spec_file, schema, bool_and(NOT some_ OR all_) AS stay FROM (SELECT vendor, spec_file, schema, op_key, bool_or(in_old) AS some_, bool_and(in_new) AS all_ FROM asked GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT g.vendor, g.spec_file, g.schema, CASE WHEN u.schema IS NULL THEN CASE WHEN (g.vendor, g.spec_file) IN (SELECT (vendor, spec_file) FROM reach WHERE side = 'old') THEN 'unreachable' ELSE 'unmeasurable' END
 WHEN d.schema IS NULL AND coalesce(parents_gone, false) THEN 'subsumed' WHEN d.schema IS NULL AND coalesce(n_live, 0) > 0 AND coalesce(at_parents, false) THEN 'relocated' WHEN d.schema IS NOT NULL AND n_carrying IS NULL THEN 'subsumed'
 WHEN d.schema IS NOT NULL AND renamed THEN 'renamed' WHEN d.schema IS NOT NULL AND coalesce(stay, false) THEN 'relocated' ELSE '' END AS reason
FROM gone g LEFT JOIN used u USING (vendor, spec_file, schema) LEFT JOIN (SELECT DISTINCT vendor, spec_file, schema FROM direct) d USING (vendor, spec_file, schema) LEFT JOIN by_parents USING (vendor, spec_file, schema) LEFT JOIN by_roots USING (vendor, spec_file, schema) LEFT JOIN by_names USING (vendor, spec_file, schema)""",
)
