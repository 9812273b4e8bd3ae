"""The operators on names, paths, evidence, proofs and the archive over the plain tables, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import names, paths
from quillstone.operators import collapse, sampling, temporal
from quillstone.plans import dependence, drift, prefilter, prospects, quality, table_drift
from quillstone.plans.tables import query
from quillstone.sources import archive, files
from quillstone.sources.scratch import table

#: A name in mixed convention, of columns of part.
_NAME = "concat(replace(p_name, ' ', '-'), 'Of', p_brand)"
_SNAKE = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'))"


@query(f"""WITH s AS (SELECT p_partkey, {_SNAKE.format(x=_NAME)} AS snake FROM part), w AS (SELECT *, list_filter(string_split(snake, '_'), lambda x: x <> '') AS w FROM s)
SELECT p_partkey, snake, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), '') AS camel, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM w""")
def name_conventions(spark, sf_dir):
    name = F.expr(_NAME)
    return table(spark, sf_dir, "part").select("p_partkey", names.snake(name).alias("snake"), names.camel(name).alias("camel"), names.pascal(name).alias("pascal"))


#: Templates of pages: the last two segments of a URL, numbers as holes.
_PATH = "regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+', ''), '[?#].*$', '')"


@query(f"""WITH t AS (SELECT DISTINCT regexp_replace({_PATH}, '/[0-9]+', '/{{id}}', 'g') AS template FROM pages), p AS (SELECT page_id, {_PATH} AS path FROM pages),
a AS (SELECT template, list_reverse(list_transform(list_filter(string_split(template, '/'), lambda s: s <> ''), lambda s: CASE WHEN contains(s, '{{') THEN '*' ELSE lower(s) END)) AS a FROM t),
b AS (SELECT page_id, path, list_reverse(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: lower(s))) AS b FROM p)
SELECT page_id, template FROM a JOIN b ON len(a) > 0 AND len(a) <= len(b) AND NOT ends_with(path, '/') AND len(list_filter(a, lambda x: x <> '*')) > 0 AND len(list_filter(a, lambda x, i: x <> '*' AND x <> b[i])) = 0""")
def path_match(spark, sf_dir):
    """Joined by the template's last literal segment and its place from the end, then compared as a whole."""
    path = F.regexp_replace(paths.url_path(F.col("url")), r"[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    tail = F.reverse(F.transform(paths.segments(F.col("template")), F.lower))
    at = F.array_position(F.transform(tail, lambda s: ~paths.is_hole(s)), True).cast("int")
    templates = pages.select(F.regexp_replace("path", "/[0-9]+", "/{id}").alias("template")).distinct()
    templates = templates.select("template", (at - 1).alias("place"), F.get(tail, at - 1).alias("segment")).where(at > 0)
    written = pages.select("page_id", "path", F.posexplode(F.reverse(F.transform(paths.segments(F.col("path")), F.lower))).alias("place", "segment"))
    return written.join(templates, ["place", "segment"]).where(paths.ends_like(F.col("template"), F.col("path"))).select("page_id", "template")


@query("""WITH n AS (SELECT p_partkey, regexp_replace(p_name, ' ', '_') AS leaf, p_type FROM part)
SELECT p_partkey, CAST(CASE WHEN leaf = '' THEN -10 ELSE (CASE WHEN regexp_matches(leaf, '_|[a-z][A-Z]') THEN 3 ELSE 0 END) + (CASE WHEN length(leaf) >= 14 THEN 3 WHEN length(leaf) >= 9 THEN 2 WHEN length(leaf) >= 6 THEN 1 ELSE 0 END)
 - (CASE WHEN lower(leaf) IN ('small_ring', 'red_box') THEN 6 ELSE 0 END) - (CASE WHEN length(leaf) <= 4 THEN 2 ELSE 0 END) + (CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 0 END) END AS INTEGER) AS score FROM n""")
def searchability_score(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "endpoint_removed").otherwise("param_removed")
    return table(spark, sf_dir, "part").select("p_partkey", names.searchability(F.regexp_replace("p_name", " ", "_"), kind, ["small_ring", "red_box"]).cast("int").alias("score"))


_VENDORS = [("lic", "Licences", ["license", "all rights", "rights"], ["gnu"]), ("mail", "Mail", ["@example.com", "example"], ["mit"])]
_MARKS = ", ".join(f"('{k}', '{m}', {i})" for k, _, e, _ in _VENDORS for i, m in enumerate(e))


@query(f"""SELECT vendor, doc_id, arg_min(mark, rank) AS evidence FROM documents JOIN (VALUES {_MARKS}) v(vendor, mark, rank) ON contains(lower(text), mark) AND regexp_matches(lower(text), replace(mark, '.', '[.]') || '($|[^A-Za-z0-9_])') GROUP BY ALL""")
def vendor_evidence(spark, sf_dir):
    """Which documents speak of a vendor, and the first of its marks that they hold with no word going on after it."""
    vendors = spark.createDataFrame([(k, n, e, p, k, [], "", [], False) for k, n, e, p in _VENDORS], files.VENDORS)
    docs = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("repo"), F.concat("doc_id", F.lit(".txt")).alias("path"), F.lower("text").alias("text"))
    found = files.detect_vendors(docs, vendors).join(vendors.select(F.col("key").alias("vendor"), F.explode("evidence").alias("evidence")), ["vendor", "evidence"])
    return found.select("vendor", F.regexp_replace("path", ".txt$", "").cast("bigint").alias("doc_id"), "evidence")


_SKIP = ", ".join(f"'{d}'" for d in files.SKIPPED)


@query(f"""WITH p AS (SELECT doc_id, concat(lang, '/', CASE WHEN doc_id < 100 THEN 'vendor/' WHEN n_chars > 4000 THEN 'tests/' ELSE 'app/' END, source, '.', CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'ts' WHEN 'de' THEN 'go' ELSE 'md' END) AS path, CAST(strlen(text) AS BIGINT) AS n FROM documents)
SELECT doc_id, path, len(list_intersect(string_split(path, '/')[:-2], [{_SKIP}])) = 0 AND coalesce(n, 0) <= {files.MAX_BYTES} AND n IS NOT NULL AND NOT path LIKE '%.md' AND NOT contains(concat('/', path), 'vendor/') AS candidate, contains(path, '/tests/') AS incidental,
 CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' END AS language FROM p""")
def file_predicates(spark, sf_dir):
    """Documents as files of a checkout: which are walked, which are tests, and their languages."""
    folder = F.when(F.col("doc_id") < 100, "vendor/").when(F.col("n_chars") > 4000, "tests/").otherwise("app/")
    suffix = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "ts").when(F.col("lang") == "de", "go").otherwise("md")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), folder, "source", F.lit("."), suffix).alias("path"), F.octet_length("text").cast("long").alias("n"))
    path = F.col("path")
    return rows.select("doc_id", "path", F.coalesce(files.is_candidate(path, F.col("n")), F.lit(False)).alias("candidate"), files.is_incidental(path).alias("incidental"), files.language(path).alias("language"))


_GEN = " OR ".join(f"contains(h12, '{m}')" for m in files.GENERATED_MARKS)


@query(f"SELECT doc_id, {_GEN} AS generated FROM (SELECT doc_id, lower(array_to_string(list_slice(string_split_regex(text, '\\r\\n|\\r|\\n'), 1, 12), chr(10))) AS h12 FROM documents WHERE text IS NOT NULL)")
def generated_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", files.looks_generated(F.col("text")).alias("generated"))


@query("""WITH w AS (SELECT doc_id, list_slice(string_split(lower(text), ' '), 1, 200) AS w, string_split(lower(text), ' ')[2] AS a, string_split(lower(text), ' ')[5] AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, a IS NOT NULL AND b IS NOT NULL AND list_position(w, b) > 0 AND len(list_filter(w, lambda x, i: x = a AND len(list_filter(w, lambda y, j: y = b AND j > i)) > 0)) > 0 AS in_order FROM w WHERE a <> b""")
def names_in_order(spark, sf_dir):
    """Whether the fifth word of a text stands anywhere behind the second: the test of a position's ancestors."""
    words = F.split(F.lower("text"), " ")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.slice(words, 1, 200).alias("w"), F.get(words, F.lit(1)).alias("a"), F.get(words, F.lit(4)).alias("b")).where("a <> b")
    return rows.select("doc_id", dependence.in_order(F.col("w"), F.array("a", "b")).alias("in_order"))


@query("""WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS rank, CAST(count(*) AS BIGINT) AS total, bool_or(o_orderstatus = 'P') AS failed FROM orders GROUP BY 1),
p AS (SELECT o_custkey % 7 AS vendor, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_custkey) AS rank, o_custkey, CASE WHEN failed THEN 'error' WHEN total = 0 THEN 'none' WHEN total > 2000 THEN 'low' ELSE 'usable' END AS precision FROM c),
u AS (SELECT *, coalesce(sum(CASE WHEN precision = 'usable' THEN 1 ELSE 0 END) OVER (PARTITION BY vendor ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE rank <= 20)
SELECT vendor, CAST(rank AS INTEGER) AS rank, o_custkey, precision FROM u WHERE before < 4""")
def prospects_asked(spark, sf_dir):
    """Seven lists of customers as queries: asked in order until four were usable, twenty at most."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.bool_or(F.col("o_orderstatus") == "P").alias("failed")).withColumn("vendor", F.col("o_custkey") % 7)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vendor").orderBy("o_custkey")))
    return prospects.until_enough(ranked, 4, 20).select("vendor", "rank", "o_custkey", "precision")


@query("SELECT event_type AS verdict, CAST(count(*) AS BIGINT) AS n, CAST(100 * count(*) // (SELECT count(*) FROM events) AS BIGINT) AS percent FROM events GROUP BY 1")
def survival_percent(spark, sf_dir):
    return prospects.survival(table(spark, sf_dir, "events").select(F.col("event_type").alias("verdict")))


@query("""WITH d AS (SELECT CAST(user_id AS VARCHAR) AS source, CAST(ts AS DATE) AS taken_on, max(event_type) AS digest, CAST(count(*) AS BIGINT) AS n_bytes FROM events GROUP BY 1, 2),
c AS (SELECT *, lag(digest) OVER (PARTITION BY source ORDER BY taken_on) AS before FROM d) SELECT source, taken_on, digest, n_bytes FROM c WHERE before IS DISTINCT FROM digest""")
def archive_changes(spark, sf_dir):
    """Days of users as documents of sources: those that an archive keeps."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("source"), F.to_date("ts").alias("taken_on")).agg(F.max("event_type").alias("digest"), F.count(F.lit(1)).alias("n_bytes"))
    return archive.changes(spark.createDataFrame([], archive.INDEX), days)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source, CAST(ts AS DATE) AS d, max(event_type) AS digest FROM events GROUP BY 1, 2)
SELECT source, arg_max(digest, d) FILTER (WHERE d < DATE '2024-01-10') AS digest, count(*) FILTER (WHERE d < DATE '2024-01-10') = 0 AS too_short, min(d) AS first_day, CAST(date_diff('day', min(d), max(d)) AS INTEGER) AS observable_days FROM e GROUP BY 1""")
def as_of_digest(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("source"), F.to_date("ts").alias("taken_on")).agg(F.max("event_type").alias("digest"))
    return archive.as_of(days, F.lit("2024-01-10").cast("date"))


#: An order of arrival that mixes days: unique, and a permutation of all events.
_ARRIVAL = "(event_id % 97) * 1000000000000 + event_id"


@query(f"""WITH o AS (SELECT event_id, ts, max(ts) OVER (ORDER BY {_ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events) SELECT event_id FROM o WHERE ts < seen - INTERVAL 1 DAY""")
def late_events(spark, sf_dir):
    """Events that arrive a day or more behind the latest before them."""
    return temporal.late(table(spark, sf_dir, "events").select("event_id", "ts", F.expr(_ARRIVAL).alias("arrival")), "arrival", "ts", "1 day").select("event_id")


@query("""SELECT user_id, CAST(n AS BIGINT) AS n_distinct, array_to_string(list_slice(v, 1, 5), ',') AS firsts FROM (SELECT user_id, count(DISTINCT event_id) AS n, list_sort(list(DISTINCT event_id)) AS v FROM events GROUP BY 1)""")
def first_distinct(spark, sf_dir):
    return collapse.first_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_id", 5).select("user_id", "n_distinct", F.array_join("firsts", ",").alias("firsts"))


_OPS = ["op", "param", "scheme"]


def _roll_up(spark, sf_dir):
    # every row makes an operation, so files and operations are those of all facets
    facts = table_drift.facts(spark, sf_dir, ["op"])
    s = drift.Sides(facts)
    found = drift.finished(s, drift.files_and_operations(s)[3].where("kind = 'endpoint_removed'"))
    return drift.roll_up(facts, found, drift.collapsed(found)).select("vendor", "ops_old", "ops_new", "ops_both", "raw_findings", "findings", "breaking")


table_drift._query(
    "drift_roll_up", _OPS, lambda rows: rows, """, r AS (SELECT vendor, spec_file, op_key, regexp_replace(op_key, '^[^ ]* ', '') AS subject FROM p WHERE facet = 'op' AND ho AND NOT hn),
b AS (SELECT vendor, count(*) FILTER (WHERE a) AS ops_old, count(*) FILTER (WHERE z) AS ops_new, count(*) FILTER (WHERE a AND z) AS ops_both FROM (SELECT vendor, spec_file, op_key, bool_or(side = 'old') AS a, bool_or(side = 'new') AS z FROM f0 WHERE facet = 'op' GROUP BY 1, 2, 3) GROUP BY 1),
c AS (SELECT vendor, count(*) AS raw, count(DISTINCT subject) AS n FROM r GROUP BY 1)
SELECT vendor, CAST(ops_old AS BIGINT) AS ops_old, CAST(ops_new AS BIGINT) AS ops_new, CAST(ops_both AS BIGINT) AS ops_both, CAST(coalesce(raw, 0) AS BIGINT) AS raw_findings, CAST(coalesce(n, 0) AS BIGINT) AS findings, CAST(coalesce(n, 0) AS BIGINT) AS breaking FROM b LEFT JOIN c USING (vendor)""",
)
table_drift.QUERIES["drift_roll_up"] = _roll_up


_TERMS = "SELECT DISTINCT {id}, regexp_replace(lower(replace(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')), '_', '')), 's$', '') AS term FROM {table}"


@query(f"WITH t AS ({_TERMS.format(id='doc_id', table='documents')}), f AS ({_TERMS.format(id='item_id', table='benchmark')}) SELECT doc_id, item_id, count(*) AS shared FROM t JOIN f USING (term) WHERE length(term) >= 12 GROUP BY ALL")
def scan_pairs(spark, sf_dir):
    """Documents as files and benchmark items as findings: pairs that share a long term, and how many."""
    sources = table(spark, sf_dir, "documents").select(F.lit("").alias("repo"), F.col("doc_id").alias("path"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.lit("").alias("repo"), F.col("item_id").alias("path"), "text")
    wanted = prefilter.file_terms(items).where("length(term) >= 12").select(F.col("path").alias("item_id"), "term")
    return prefilter.sharing(prefilter.file_terms(sources), wanted, ["term"]).groupBy(F.col("path").alias("doc_id"), "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query("""WITH d AS (SELECT CAST(user_id AS VARCHAR) AS source, CAST(ts AS DATE) AS taken_on, max(event_type) AS digest, CAST(count(*) AS BIGINT) AS n_bytes FROM events GROUP BY 1, 2),
k AS (SELECT source, arg_max(digest, taken_on) AS last FROM d WHERE taken_on < DATE '2024-01-15' GROUP BY 1),
n AS (SELECT d.*, coalesce(lag(digest) OVER (PARTITION BY source ORDER BY taken_on), last) AS before FROM d LEFT JOIN k USING (source) WHERE taken_on >= DATE '2024-01-12') SELECT source, taken_on, digest, n_bytes FROM n WHERE before IS DISTINCT FROM digest""")
def archive_changes_known(spark, sf_dir):
    """The same where the archive knows the days before the 15th, and the 12th to the 14th come again, late."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("source"), F.to_date("ts").alias("taken_on")).agg(F.max("event_type").alias("digest"), F.count(F.lit(1)).alias("n_bytes"))
    known = archive.changes(spark.createDataFrame([], archive.INDEX), days.where("taken_on < '2024-01-15'"))
    return archive.changes(known, days.where("taken_on >= '2024-01-12'"))


@query("""SELECT l.event_id, l.user_id, max(r.event_id) FILTER (WHERE r.k = 1) AS view_id, max(r.value) FILTER (WHERE r.k = 1) AS view_value FROM events l
LEFT JOIN (SELECT l.event_id AS id, r.event_id, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, CAST(r.event_id AS VARCHAR) DESC) AS k FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts <= l.ts WHERE l.event_type = 'purchase' AND r.event_type = 'view') r ON r.id = l.event_id AND r.k = 1
WHERE l.event_type = 'purchase' GROUP BY 1, 2""")
def asof_join(spark, sf_dir):
    """Each purchase with the last view of its user."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return temporal.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", ["view_id", "view_value"], "view_id").drop("ts")


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7/' || CAST(o_orderkey AS VARCHAR))) <= 25")
def sampled_orders(spark, sf_dir):
    """25 orders of each priority, by a seeded draw."""
    return sampling.bottom_k(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 25, 7)


_FOUND = """SELECT o_orderpriority AS vendor, CASE l_returnflag WHEN 'R' THEN 'breaking' WHEN 'A' THEN 'potentially_breaking' ELSE 'opportunity' END AS severity, l_linestatus AS method,
CASE WHEN o_orderpriority < '3' THEN concat('/', CAST(l_suppkey AS STRING)) ELSE concat('/', CAST(l_partkey AS STRING)) END AS path, concat(l_linestatus, ' /', CAST(l_partkey AS STRING)) AS op_key, l_quantity, l_linenumber FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
_FOUND_SQL = _FOUND.replace("{", "").replace("}", "")


def _found(spark, sf_dir):
    return spark.sql(_FOUND, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


@query(f"""WITH f AS ({_FOUND_SQL}), o AS (SELECT vendor, count(DISTINCT path) AS old_ops FROM f WHERE method = 'F' GROUP BY 1),
c AS (SELECT vendor, count(*) FILTER (severity = 'breaking') AS breaking, count(*) FILTER (severity = 'potentially_breaking') AS potentially, count(*) FILTER (severity = 'opportunity') AS additions, count(DISTINCT method || path) FILTER (severity = 'breaking') AS breaking_ops_touched FROM f GROUP BY 1),
p AS (SELECT vendor, old_ops, breaking, potentially, additions, breaking_ops_touched, CASE WHEN breaking_ops_touched > 0 THEN round_even(breaking / breaking_ops_touched, 1) ELSE 0 END AS breaking_per_op FROM c JOIN o USING (vendor))
SELECT *, concat_ws('; ', CASE WHEN breaking > old_ops THEN 'implausible: ' || breaking || ' breaking of ' || old_ops || ' operations' END, CASE WHEN breaking_per_op >= 10 THEN 'dense: ' || breaking_per_op || ' breaking an operation' END) AS flags FROM p""")
def vendor_metrics(spark, sf_dir):
    """Priorities as vendors: findings, operations touched, and what cannot be believed."""
    found = _found(spark, sf_dir)
    return quality.vendor_metrics(found, found.where("method = 'F'").groupBy("vendor").agg(F.count_distinct("path").alias("old_ops")))


@query(f"""WITH f AS ({_FOUND_SQL}), t AS (SELECT vendor, op_key, CAST(l_linenumber AS VARCHAR) AS rule FROM f WHERE l_quantity >= 49 AND l_linenumber <> 7)
SELECT vendor, rule, count(*) AS said, count(*) FILTER (NOT EXISTS (SELECT 1 FROM f WHERE f.vendor = t.vendor AND f.op_key = t.op_key AND f.severity = 'breaking')) AS unmatched FROM t GROUP BY 1, 2""")
def tool_disagreement(spark, sf_dir):
    """Lines of large quantities as what another tool says, by its rules, one of them noisy."""
    found = _found(spark, sf_dir)
    return quality.disagreement(found, found.where("l_quantity >= 49").select("vendor", "op_key", F.col("l_linenumber").cast("string").alias("rule")), ["7"])
