"""API descriptions as JSON text, made of the plain tables: documents of two sides for every supplier and priority.

A supplier's lines of one order priority are a file, those ordered before 1998 the old side, the
others the new one; a part's size names a schema and an operation, and size % 6 the schema's form
(object, alias, allOf, oneOf, enum, array). All lines count. One text makes the documents in Spark and in the SQL beside it; what
is then asked of them does not share a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.scratch import cut, table

TABLES = ("lineitem", "orders", "part")


def _text(template: str, *values: str) -> str:
    """A concat() that fills the %s of a template with SQL expressions."""
    pieces = template.split("%s")
    filled = [f"'{pieces[0]}'"]
    for value, piece in zip(values, pieces[1:], strict=True):
        filled += [value, f"'{piece}'"]
    return f"concat({', '.join(filled)})"


def _schema_ref(size: str) -> str:
    return _text('{"$ref":"#/components/schemas/S%s"}', f"CAST({size} AS STRING)")


def _joined(value: str, order: str) -> str:
    """Values joined by commas in an order; nulls are left out. Of Spark; in_duckdb() writes the other's."""
    return f"JOINED[{value}|{order}]"


def _unless(value: str, when: str) -> str:
    return f"CASE WHEN {when} THEN {value} END"


def _on(when: str, yes: str, no: str = "''") -> str:
    return f"CASE WHEN {when} THEN {yes} ELSE {no} END"


_NULLABLE = _on("t >= 0.04", "'\"nullable\":true,'")
_FIELD = f"""CASE WHEN side = 'new' AND line = 4 THEN '{{"enum":["v4","w"],"type":"string"}}' WHEN q > 42 THEN {_schema_ref("(size + 1) % 50 + 1")} WHEN q > 25 THEN {_text('{%s"type":"integer"}', _NULLABLE)}
 WHEN q > 10 THEN {_text('{"enum":["%s%s"],%s"type":"string"}', "lo", _on("lo = hi", "''", "concat('\",\"', hi)"), _NULLABLE)} ELSE '{{"description":"any"}}' END""".replace("{{", "{").replace("}}'", "}'")
_OBJECT = _text('{"properties":{%s},"required":[%s],"type":"object"}', _joined(_text('"%s":%s', "name", "json"), "name"), _joined(_unless(_text('"%s"', "name"), "d >= 0.06"), "name"))
_FORM = f"""CASE size % 6 WHEN 0 THEN max(json) WHEN 1 THEN {_schema_ref("(size + 6) % 50 + 1")} WHEN 2 THEN {_text('{"allOf":[%s,%s]}', _schema_ref("(size + 3) % 50 + 1"), "max(json)")}
 WHEN 3 THEN {_text('{"oneOf":[%s]}', _joined("json", "unit"))} WHEN 4 THEN {_text('{"enum":["v%s","w"],"type":"string"}', "CAST(max(line) AS STRING)")} ELSE {_text('{"items":%s,"type":"array"}', _schema_ref("(size + 3) % 50 + 1"))} END"""
_PARAM = _text('{"in":"query","name":"%s","required":%s,"schema":{"type":"%s"}}', "word", _on("max(l_discount) >= 0.07", "'true'", "'false'"), _on("max(l_quantity) > 25", "'integer'", "'string'"))
_BODY = _text('{"content":{"application/json":{"schema":%s}}', _schema_ref("size"))
_OPERATION = _text(
    '{%s"parameters":[%s],%s"responses":{"200":%s}%s},"security":[{"%s":[]}]}', _on("min(t) >= 0.05", "'\"deprecated\":true,'"), _joined("param", "word"),
    _on("method = 'post'", _text('"requestBody":%s,"required":%s},', _BODY, _on("max(d) >= 0.07", "'true'", "'false'"))), _BODY, _on("max(q) > 40", "',\"404\":{}'"), _on("min(line) < 2", "'badge'", "'ticket'"),
)
_DOCUMENT = _text('{"components":{"schemas":{%s}},"openapi":"3.0.3","paths":{%s},"servers":[{"url":"https://%s.example.net/"}]}', "s.all_schemas", "p.all_paths", "s.host")
#: Lines, fields, schemas (file, side, size, name, form, json), operations (file, side, size, method, json) and documents (file, side, body).
CTES = f"""base AS (SELECT concat('s', CAST(l_suppkey AS STRING), '-', substr(o_orderpriority, 1, 1)) AS file, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'old' ELSE 'new' END AS side, p_size AS size, CASE WHEN p_size % 6 = 3 THEN l_returnflag ELSE '' END AS unit,
 l_linenumber AS line, l_quantity, l_discount, l_tax, CASE WHEN l_linestatus = 'F' THEN 'get' ELSE 'post' END AS method, o_orderstatus, concat('p', CAST(l_linenumber AS STRING)) AS word FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @part ON l_partkey = p_partkey),
props AS (SELECT file, side, size, unit, line, max(l_quantity) AS q, max(l_discount) AS d, min(l_tax) AS t, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM base GROUP BY file, side, size, unit, line),
fields AS (SELECT *, concat('f', CAST(line AS STRING)) AS name, {_FIELD} AS json FROM props),
objects AS (SELECT file, side, size, unit, max(line) AS line, {_OBJECT} AS json FROM fields GROUP BY file, side, size, unit),
schemas AS (SELECT file, side, size, concat('S', CAST(size AS STRING)) AS name, size % 6 AS form, {_FORM} AS json FROM objects GROUP BY file, side, size),
params AS (SELECT file, side, size, method, word, max(l_quantity) AS q, max(l_discount) AS d, min(l_tax) AS t, min(line) AS line, {_PARAM} AS param FROM base GROUP BY file, side, size, method, word),
operations AS (SELECT file, side, size, method, {_OPERATION} AS json FROM params GROUP BY file, side, size, method),
items AS (SELECT file, side, size, {_text('"/r%s/{id}":{%s}', "CAST(size AS STRING)", _joined(_text('"%s":%s', "method", "json"), "method"))} AS json FROM operations GROUP BY file, side, size),
documents_ AS (SELECT s.file, s.side, {_DOCUMENT} AS body FROM
 (SELECT file, side, {_on("min(size) < 4", "file", "concat(file, side)")} AS host, {_joined(_text('"%s":%s', "name", "json"), "name")} AS all_schemas FROM schemas GROUP BY file, side) s JOIN
 (SELECT file, side, {_joined("json", "concat('/r', CAST(size AS STRING), '/')")} AS all_paths FROM items GROUP BY file, side) p ON s.file = p.file AND s.side = p.side)"""


def _written(text: str, how) -> str:
    """JOINED[value|order] as how(value, order) writes it, innermost first."""
    while "JOINED[" in text:
        a = text.rindex("JOINED[")
        depth, b = 0, a + 6
        while True:
            depth += {"[": 1, "]": -1}.get(text[b], 0)
            if not depth:
                break
            b += 1
        value, order = text[a + 7 : b].rsplit("|", 1)
        text = text[:a] + how(value, order) + text[b + 1 :]
    return text


#: Fixed value: lines that one task makes documents of, about.
LINES = 50_000
_BASE = CTES[: CTES.index(",\nprops AS")]
_ITEM, _MEMBER = _text('"%s":%s', "name", "json"), _text('"%s":%s', "method", "json")
#: What CTES says, level by level for fields (`is_field`) and parameters at once: lines are dealt by file once, every later grouping holds the file.
SPARK = f"""WITH {_BASE},
dealt AS (SELECT /*+ REPARTITION(@n, file) */ file, side, size, unit, line, l_quantity, l_discount, l_tax, method, o_orderstatus FROM base WHERE file IS NOT NULL),
both_ AS (SELECT *, explode(array(true, false)) AS is_field FROM dealt),
leaves AS (SELECT file, side, size, is_field, CASE WHEN is_field THEN unit ELSE method END AS unit, line, max(l_quantity) AS q, max(l_discount) AS d, min(l_tax) AS t, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM both_
 GROUP BY file, side, size, is_field, CASE WHEN is_field THEN unit ELSE method END, line),
named AS (SELECT *, CAST(line AS STRING) AS nth, concat('f', CAST(line AS STRING)) AS name, concat('p', CAST(line AS STRING)) AS word FROM leaves),
told AS (SELECT *, CASE WHEN is_field THEN {_FIELD} ELSE {_PARAM.replace("max(l_discount)", "d").replace("max(l_quantity)", "q")} END AS json FROM named),
joined AS (SELECT file, side, size, is_field, unit, unit AS method, max(q) AS q, max(d) AS d, min(t) AS t, min(line) AS first, max(line) AS line, {_joined(f"CASE WHEN is_field THEN {_ITEM} ELSE json END", "nth")} AS listed,
 {_joined(_unless(_text('"%s"', "name"), "is_field AND d >= 0.06"), "nth")} AS required FROM told GROUP BY file, side, size, is_field, unit),
things AS (SELECT file, side, size, is_field, unit, method, line, CASE WHEN is_field THEN {_text('{"properties":{%s},"required":[%s],"type":"object"}', "listed", "required")} ELSE
 {_OPERATION.replace("JOINED[param|word]", "listed").replace("min(t)", "t").replace("max(d)", "d").replace("max(q)", "q").replace("min(line)", "first")} END AS json FROM joined),
groups AS (SELECT file, side, size, is_field, max(line) AS line, {_joined(f"CASE WHEN is_field THEN json ELSE {_MEMBER} END", "unit")} AS listed FROM things GROUP BY file, side, size, is_field),
parts AS (SELECT file, side, size, is_field, CASE WHEN is_field THEN {_text('"S%s":%s', "CAST(size AS STRING)", "(" + _FORM.replace(_joined("json", "unit"), "listed").replace("max(json)", "listed").replace("max(line)", "line") + ")")}
 ELSE {_text('"/r%s/{id}":{%s}', "CAST(size AS STRING)", "listed")} END AS json FROM groups),
wholes AS (SELECT file, side, {_on("min(size) < 4", "file", "concat(file, side)")} AS host, {_joined(_unless("json", "is_field"), "concat('S', CAST(size AS STRING))")} AS all_schemas,
 {_joined(_unless("json", "NOT is_field"), "concat('/r', CAST(size AS STRING), '/')")} AS all_paths FROM parts GROUP BY file, side)
SELECT file, side, {_DOCUMENT.replace("s.", "").replace("p.", "")} AS body FROM wholes"""


def _in_spark(text: str, n: int) -> str:
    listed = lambda v, o: f"array_join(transform(array_sort(collect_list(CASE WHEN {v} IS NOT NULL THEN struct({o} AS k, {v} AS x) END)), s -> s.x), ',')"
    text = _written(text, listed).replace("{", "{{").replace("}", "}}").replace("@n", str(n))
    for t in TABLES:
        text = text.replace(f"@{t}", "{" + t + "}")
    return text


def in_duckdb(more: str, select: str) -> str:
    return f"WITH RECURSIVE {_written(CTES, lambda v, o: f"coalesce(string_agg({v}, ',' ORDER BY {o}), '')").replace('@', '')}{more} {select}"


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, side, body of each document, once; all documents of a file lie in one partition."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    n = max(-(-tables["lineitem"].count() // LINES), spark.sparkContext.defaultParallelism)
    return spark.sql(_in_spark(SPARK, n), **tables)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, side, body, as a table of its own for drop()."""
    return cut(written(spark, sf_dir))
