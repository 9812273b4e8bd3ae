"""Queries over the documents that table_contracts makes, beside SQL that knows the rows they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.plans import adjudicate, documents, drift, table_contracts
from quillstone.plans.tables import QUERIES, SQL
from quillstone.sources import contracts
from quillstone.sources import nodes as tree
from quillstone.sources.scratch import cut, forget

#: Which schema another refers to, by its form; what each object holds and requires.
ROWS = """, sch AS (SELECT file, side, size, form, CASE form WHEN 1 THEN (size + 6) % 50 + 1 WHEN 2 THEN (size + 3) % 50 + 1 WHEN 5 THEN (size + 3) % 50 + 1 END AS target FROM schemas),
arms AS (SELECT file, side, size, unit, list_sort(list(name)) AS names, coalesce(list_sort(list(name) FILTER (d >= 0.06)), []) AS req FROM fields GROUP BY ALL),
own AS (SELECT sch.*, a.names, a.req FROM sch LEFT JOIN arms a ON a.file = sch.file AND a.side = sch.side AND a.size = sch.size AND form IN (0, 2)),
both_ AS (SELECT o.file, o.side, o.size, o.form, o.target, t.size IS NOT NULL AS found, CASE WHEN o.form = 2 AND t.form = 0 THEN list_sort(list_distinct(list_concat(o.names, t.names))) ELSE o.names END AS names,
 CASE WHEN o.form = 2 AND t.form = 0 THEN list_sort(list_distinct(list_concat(o.req, t.req))) ELSE o.req END AS req FROM own o LEFT JOIN own t ON t.file = o.file AND t.side = o.side AND t.size = o.target)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(
    table_contracts.in_duckdb(
        """, w AS MATERIALIZED (SELECT file, side, t.id, t.parent, t.key, lower(t.type) AS type, row_number() OVER (PARTITION BY file, side ORDER BY t.id) - 1 AS entry FROM documents_, json_tree(documents_.body) t),
up AS (SELECT file, side, id, parent AS above, 1 AS far FROM w WHERE parent IS NOT NULL UNION ALL SELECT up.file, up.side, up.id, w.parent, far + 1 FROM up JOIN w ON w.file = up.file AND w.side = up.side AND w.id = above WHERE w.parent IS NOT NULL),
h AS (SELECT file, side, above AS id, count(*) AS held FROM up GROUP BY ALL), d AS (SELECT file, side, id, max(far) AS depth FROM up GROUP BY ALL)""",
        """SELECT file, side, CAST(w.key AS VARCHAR) AS key, CASE type WHEN 'varchar' THEN 'string' WHEN 'ubigint' THEN 'number' ELSE type END AS kind, entry, entry + coalesce(held, 0) AS exit, CAST(coalesce(depth, 0) AS INTEGER) AS depth
FROM w LEFT JOIN h USING (file, side, id) LEFT JOIN d USING (file, side, id)""",
    )
)
def contract_nodes(spark, sf_dir):
    """Every node of every document, with the interval of the nodes that it holds."""
    return tree.walked(table_contracts.written(spark, sf_dir), ["file", "side", "key", "kind", "entry", "exit", "depth"])


_SITES = """, use AS (SELECT file, side, size AS inside, (size + 1) % 50 + 1 AS target, unit, line, 'field' AS at FROM fields WHERE json LIKE '{"$ref"%' AND size % 6 IN (0, 2, 3) UNION ALL SELECT file, side, size, (size + CASE form WHEN 1 THEN 6 ELSE 3 END) % 50 + 1, '', 0, 'form' FROM schemas WHERE form IN (1, 2, 5)
UNION ALL SELECT file, side, NULL, size, method, CASE method WHEN 'get' THEN 1 ELSE 2 END, 'operation' FROM operations UNION ALL SELECT file, side, NULL, size, method, 3, 'operation' FROM operations WHERE method = 'post'),
gone AS (SELECT file, name, size, form, json FROM schemas s WHERE side = 'old' AND NOT EXISTS (FROM schemas n WHERE n.side = 'new' AND n.file = s.file AND n.size = s.size)),
end1 AS (SELECT g.file, g.size, coalesce(t.json, g.json) AS json, coalesce(t.size, g.size) AS at FROM gone g LEFT JOIN schemas t ON g.form = 1 AND t.side = 'old' AND t.file = g.file AND t.size = (g.size + 6) % 50 + 1),
kept AS (SELECT DISTINCT u.file, u.target, u.inside, u.unit, u.line FROM use u JOIN end1 e ON e.file = u.file AND e.size = u.target JOIN fields f ON f.file = u.file AND f.side = 'new' AND f.size = u.inside AND f.name = 'f' || u.line
 AND (u.inside % 6 <> 3 OR list_position(us.units, u.unit) = list_position(ns.units, f.unit)) LEFT JOIN us ON us.file = u.file AND us.side = 'old' AND us.size = u.inside LEFT JOIN us ns ON ns.file = u.file AND ns.side = 'new' AND ns.size = u.inside
 LEFT JOIN schemas x ON f.json LIKE '{"$ref"%' AND x.file = f.file AND x.side = 'new' AND x.size = (f.size + 1) % 50 + 1 WHERE u.side = 'old' AND u.at = 'field' AND coalesce(x.json, f.json) = e.json
 UNION SELECT u.file, u.target, u.inside, u.unit, u.line FROM use u JOIN end1 e ON e.file = u.file AND e.size = u.target JOIN objects o ON o.file = u.file AND o.side = 'new' AND o.size = u.inside WHERE u.side = 'old' AND u.at = 'form' AND u.inside % 6 = 2 AND o.json = e.json)"""
_SITES = _SITES.replace(
    "kept AS (", "us AS (SELECT file, side, size, list_sort(list(DISTINCT unit)) AS units FROM fields GROUP BY ALL),\nkept AS ("
).replace(
    """JOIN fields f ON f.file = u.file AND f.side = 'new' AND f.size = u.inside AND f.name = 'f' || u.line
 AND (u.inside % 6 <> 3 OR list_position(us.units, u.unit) = list_position(ns.units, f.unit)) LEFT JOIN us ON us.file = u.file AND us.side = 'old' AND us.size = u.inside LEFT JOIN us ns ON ns.file = u.file AND ns.side = 'new' AND ns.size = u.inside
 LEFT JOIN""",
    """JOIN us ON us.file = u.file AND us.side = 'old' AND us.size = u.inside JOIN us ns ON ns.file = u.file AND ns.side = 'new' AND ns.size = u.inside
 JOIN fields f ON f.file = u.file AND f.side = 'new' AND f.size = u.inside AND f.name = 'f' || u.line AND list_position(us.units, u.unit) = list_position(ns.units, f.unit)
 LEFT JOIN""",
)


@query(
    table_contracts.in_duckdb(
        _SITES,
        """SELECT g.file, g.name, count(u.file) AS sites, count(k.file) AS kept, count(*) FILTER (u.file IS NOT NULL AND k.file IS NULL AND i.file IS NOT NULL) AS inside, count(*) FILTER (u.file IS NOT NULL AND k.file IS NULL AND i.file IS NULL) AS lost
FROM gone g LEFT JOIN use u ON u.side = 'old' AND u.file = g.file AND u.target = g.size LEFT JOIN kept k ON k.file = u.file AND k.target = u.target AND k.inside = u.inside AND k.unit = u.unit AND k.line = u.line
LEFT JOIN gone i ON i.file = u.file AND i.size = u.inside GROUP BY g.file, g.name""",
    )
)
def contract_schema_removals(spark, sf_dir):
    """Named schemas that went: what the places that referred to them present now."""
    return documents.asked_by_file(table_contracts.written(spark, sf_dir), "name string, sites bigint, kept bigint, inside bigint, lost bigint", documents.removed_schemas)


def _shape_sql() -> str:
    """Shapes of named schemas, one level of depth after the other."""
    text = ROWS + """, ob AS (SELECT file, side, size, unit, 'object(' || array_to_string(names, ',') || ')' AS o FROM arms), en AS (SELECT file, side, size, 'scalar(string;v' || max(line) || ',w)' AS o FROM fields GROUP BY ALL)"""
    text += ", one AS (SELECT file, side, size, 'oneOf(' || string_agg(o, '|' ORDER BY o) || ')' AS o, 'oneOf(' || string_agg('opaque', '|') || ')' AS dark FROM ob GROUP BY ALL)"
    for k in range(4):
        below = lambda n: f"s{n}.shape" if n >= 0 else "'opaque'"
        joins = "".join(f" LEFT JOIN s{n} ON s{n}.file = b.file AND s{n}.side = b.side AND s{n}.size = b.target" for n in (k - 1, k - 2) if n >= 0)
        text += f""", s{k} AS (SELECT b.file, b.side, b.size, CASE b.form WHEN 1 THEN CASE WHEN found THEN {below(k - 1)} ELSE 'unknown-ref' END WHEN 3 THEN {'one.o' if k else 'one.dark'} WHEN 4 THEN en.o
 WHEN 5 THEN 'array(' || {f"CASE WHEN found THEN {below(k - 2)} ELSE 'unknown-ref' END" if k else "'opaque'"} || ')' ELSE 'object(' || array_to_string(b.names, ',') || ')' END AS shape
 FROM both_ b LEFT JOIN one ON one.file = b.file AND one.side = b.side AND one.size = b.size LEFT JOIN en ON en.file = b.file AND en.side = b.side AND en.size = b.size{joins})"""
    fields = """SELECT f.file, f.side, 'S' || f.size || '.' || f.name AS place, CASE WHEN f.json LIKE '{"$ref"%' THEN coalesce(s2.shape, 'unknown-ref') WHEN f.json LIKE '{"desc%' THEN 'any'
 ELSE CASE WHEN f.json LIKE '%nullable%' THEN 'nullable(' ELSE '' END || CASE WHEN f.json LIKE '%integer%' THEN 'scalar(integer)' ELSE 'scalar(string;' || replace(regexp_extract(f.json, '"enum":\\[([^\\]]*)\\]', 1), '"', '') || ')' END || CASE WHEN f.json LIKE '%nullable%' THEN ')' ELSE '' END END AS shape
 FROM fields f LEFT JOIN s2 ON s2.file = f.file AND s2.side = f.side AND s2.size = (f.size + 1) % 50 + 1 WHERE f.size % 6 = 0"""
    return table_contracts.in_duckdb(text, f"SELECT file, side, 'S' || size AS place, shape FROM s3 UNION ALL {fields}")


@query(_shape_sql())
def contract_shapes(spark, sf_dir):
    """What named schemas, and the properties of plain ones, look like to a reader."""
    def answer(g):
        names = {place: name for name, place in g.named()}
        names |= {f"{place}/properties/{step}": f"{name}.{step}" for place, name in list(names.items()) for step, _ in documents.children(g.get(f"{place}/properties"))}
        return [(names[place], shape) for place, shape in documents.shapes(g, names).items()]

    return documents.asked(table_contracts.written(spark, sf_dir), "place string, shape string", answer, within=True)


_DUTIES = ROWS + """, least AS (SELECT file, side, size, name FROM (SELECT file, side, size, unnest(req) AS name FROM arms WHERE size % 6 = 3) GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM arms a WHERE (a.file, a.side, a.size) = (file, side, size))),
units AS (SELECT file, side, size, count(*) AS n FROM arms WHERE size % 6 = 3 GROUP BY ALL),
common AS (SELECT file, side, size, name FROM (SELECT file, side, size, name, count(*) AS k FROM (SELECT file, side, size, unnest(req) AS name FROM arms WHERE size % 6 = 3) GROUP BY ALL) JOIN units USING (file, side, size) WHERE k = n),
r0 AS (SELECT file, side, size, unnest(req) AS name FROM both_ WHERE form IN (0, 2) UNION ALL FROM common),
r1 AS (SELECT b.file, b.side, b.size, r0.name FROM both_ b JOIN r0 ON r0.file = b.file AND r0.side = b.side AND r0.size = b.target WHERE b.form = 1)"""
_DUTIES = _DUTIES[: _DUTIES.index(", least AS")] + _DUTIES[_DUTIES.index("\nunits AS") :].replace("\nunits", ",\nunits", 1)


@query(table_contracts.in_duckdb(_DUTIES, "SELECT file, side, 'S' || size AS schema, name FROM r0 UNION ALL SELECT file, side, 'S' || size, name FROM r1"))
def contract_obligations(spark, sf_dir):
    """What every instance of a named schema must carry."""

    def answer(g):
        found = documents.obligations(g)
        return [(name, x) for name, place in g.named() for x in found.get(place, ())]

    return documents.asked(table_contracts.written(spark, sf_dir), "schema string, name string", answer, within=True)


_PROMISES = ROWS + """, sets AS (SELECT DISTINCT file, side, size, names FROM arms WHERE size % 6 = 3),
mins AS (SELECT * FROM sets a WHERE NOT EXISTS (FROM sets b WHERE b.file = a.file AND b.side = a.side AND b.size = a.size AND len(b.names) < len(a.names) AND list_has_all(a.names, b.names))),
un AS (SELECT file, side, size, count(*) AS n, list_sort(list_reduce(list(names), lambda x, y: list_intersect(x, y))) AS names FROM mins GROUP BY ALL),
p0 AS (SELECT b.file, b.side, b.size, b.form, b.target, CASE b.form WHEN 1 THEN NULL WHEN 3 THEN un.n ELSE 1 END AS n, CASE b.form WHEN 3 THEN un.names WHEN 4 THEN [] WHEN 5 THEN [] ELSE b.names END AS names FROM both_ b LEFT JOIN un USING (file, side, size))"""


@query(
    table_contracts.in_duckdb(
        _PROMISES,
        "SELECT p.file, p.side, 'S' || p.size AS schema, CAST(CASE WHEN p.form = 1 THEN coalesce(t.n, 0) ELSE p.n END AS INTEGER) AS n_least, array_to_string(CASE WHEN p.form = 1 THEN coalesce(t.names, []) ELSE p.names END, ',') AS promised, false AS undecided FROM p0 p LEFT JOIN p0 t ON p.form = 1 AND t.file = p.file AND t.side = p.side AND t.size = p.target",
    )
)
def contract_promises(spark, sf_dir):
    """The least alternatives of named schemas, and the properties that all of them hold."""

    def answer(g):
        found = documents.alternatives(g)
        for name, place in g.named():
            least = found[place].least
            yield (name, None, None, True) if least is None else (name, len(least), ",".join(sorted(frozenset.intersection(*least))) if least else "", False)

    return documents.asked(table_contracts.written(spark, sf_dir), "schema string, n_least int, promised string, undecided boolean", answer, within=True)


def contract_verdicts(spark, sf_dir):
    """By kind: how many findings of the change rules the independent judge confirms, refutes or cannot decide."""
    docs = table_contracts.documents(spark, sf_dir)
    facts = contracts.facts(docs.select(F.lit("").alias("vendor"), F.col("file").alias("spec_file"), "side", "body"))
    found = cut(adjudicate.claims(drift.findings(facts)).withColumn("file", F.substring("file", 2, 1 << 30)))
    nodes = tree.node_table(docs)
    verdicts = adjudicate.adjudicated(found, nodes)
    out = cut(adjudicate.agreement(verdicts))
    forget(docs, found, nodes, verdicts)
    return out


def contract_equal_schemas(spark, sf_dir):
    """Named schemas of both sides: whether they are the same throughout, references and circles included."""

    def answer(old, new):
        was, now = documents.classes(old, new)
        there = {place for _, place in new.named()}
        return [(name, was[place] == now[place]) for name, place in old.named() if place in there]

    return documents.asked_by_file(table_contracts.written(spark, sf_dir), "schema string, same boolean", answer, within=True)


#: SQL can say neither: the first is tested by cases of every kind, the second against unfolding.
QUERIES["contract_verdicts"] = contract_verdicts
QUERIES["contract_equal_schemas"] = contract_equal_schemas
