"""The library's operators over plain tables, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import paths
from quillstone.operators import collapse, compare, graph, temporal
from quillstone.sources.scratch import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CUT = "timestamp_ntz'1998-01-01 00:00:00'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where(f"o_orderdate < {CUT}"), orders.where(f"o_orderdate >= {CUT}")


@query("SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
def snapshot_added(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return compare.gone(new, old, ["o_custkey", "o_orderpriority"])


@query("SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def snapshot_removed(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return compare.gone(old, new, ["o_custkey", "o_orderpriority"])


@query("""WITH s AS (SELECT o_custkey, o_orderdate >= TIMESTAMP '1998-01-01' AS is_new, md5(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS d FROM orders GROUP BY 1, 2)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.d AS old_digest, b.d AS new_digest FROM (SELECT * FROM s WHERE NOT is_new) a FULL JOIN (SELECT * FROM s WHERE is_new) b ON a.o_custkey = b.o_custkey WHERE a.d IS DISTINCT FROM b.d""")
def snapshot_pairs(spark, sf_dir):
    digest = lambda d: d.groupBy("o_custkey").agg(F.md5(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")).alias("d"))
    return compare.changed_pairs(*map(digest, _sides(spark, sf_dir)), ["o_custkey"], "d")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, bool_or(o_orderdate < TIMESTAMP '1998-01-01') AS o, bool_or(o_orderdate >= TIMESTAMP '1998-01-01') AS n FROM orders GROUP BY 1, 2),
g AS (SELECT o_custkey, coalesce(string_agg(CASE WHEN o AND NOT n THEN o_orderpriority END, ',' ORDER BY o_orderpriority), '') AS lost, coalesce(string_agg(CASE WHEN n AND NOT o THEN o_orderpriority END, ',' ORDER BY o_orderpriority), '') AS gained FROM s GROUP BY 1)
SELECT * FROM g WHERE lost <> '' OR gained <> ''""")
def enum_value_drift(spark, sf_dir):
    return compare.value_drift(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.expr(f"o_orderdate >= {CUT}"))


@query("""WITH s AS (SELECT event_type, ts >= TIMESTAMP '2024-01-15' AS is_new, unnest(json_keys(props)) AS k FROM events)
SELECT event_type, k AS key, CAST(count(*) FILTER (WHERE NOT is_new) AS BIGINT) AS n_old, CAST(count(*) FILTER (WHERE is_new) AS BIGINT) AS n_new FROM s GROUP BY 1, 2""")
def field_presence_drift(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select("event_type", F.expr("ts >= timestamp_ntz'2024-01-15 00:00:00'").alias("is_new"), F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("event_type", "key").agg(F.count_if(~F.col("is_new")).alias("n_old"), F.count_if("is_new").alias("n_new"))


@query("""SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+', ''), '[?#].*$', ''), '\\{[^}]*\\}', '{}', 'g') AS visible, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1""")
def visible_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(paths.visible_path(paths.url_path(F.col("url"))).alias("visible")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.url_host(F.col("url")).alias("host"))


_SEGMENTS = "list_filter(string_split(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+', ''), '[?#].*$', ''), '/'), lambda s: s <> '')"


@query(f"SELECT page_id, coalesce(list_filter({_SEGMENTS}, lambda s: NOT regexp_matches(s, '[{{}}]|^%') AND NOT regexp_matches(lower(s), '^(v[0-9]+|api|2010-04-01)$'))[1], '') AS resource FROM pages")
def resource_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.resource_of(paths.url_path(F.col("url"))).alias("resource"))


#: Numbers as holes, so that pages have several runs.
_HOLED = "regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+', ''), '[?#].*$', ''), '/[0-9]+', '/{}', 'g')"


@query(f"""WITH r AS (SELECT page_id, list_filter(list_transform(string_split(list_aggregate(list_transform(list_filter(string_split({_HOLED}, '/'), lambda s: s <> ''), lambda s: CASE WHEN s[1] = '{{' THEN '{{}}' ELSE s END), 'string_agg', '/'), '{{}}'), lambda r: regexp_replace(r, '^/+|/+$', '', 'g')), lambda r: r <> '') AS runs FROM pages)
SELECT page_id, CASE WHEN coalesce(len(runs), 0) = 0 THEN '' WHEN length(runs[-1]) >= 4 THEN '/' || runs[-1] ELSE '/' || list_filter(runs, lambda r: length(r) = list_max(list_transform(runs, lambda x: length(x))))[1] END AS run FROM r""")
def static_run(spark, sf_dir):
    holed = F.regexp_replace(F.regexp_replace(paths.url_path(F.col("url")), r"[?#].*$", ""), "/[0-9]+", "/{}")
    return table(spark, sf_dir, "pages").select("page_id", paths.static_run(holed).alias("run"))


@query("SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_order FROM orders")
def asof_previous_order(spark, sf_dir):
    return temporal.previous_in_key(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "previous_order").select("o_orderkey", "o_custkey", "previous_order")


@query("""SELECT o_custkey, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS ref, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders GROUP BY 1""")
def asof_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    before = F.expr(f"o_orderdate < {CUT}")
    return orders.groupBy("o_custkey").agg(F.max_by(F.when(before, F.col("o_orderkey")), F.when(before, F.col("at"))).alias("ref"), F.to_date(F.min("o_orderdate")).alias("first_day"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def change_only_archive(spark, sf_dir):
    return temporal.change_only(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id, CAST(date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-01') AS BIGINT) AS age_days FROM events GROUP BY 1")
def days_since_change(spark, sf_dir):
    return temporal.age(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-02-01").cast("date"))


@query("SELECT sha256(trim(regexp_replace(lower(text), '[ \\t\\n]+', ' ', 'g'))) AS digest, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def canonical_digest_dupes(spark, sf_dir):
    digest = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n]+", " ")).cast("binary"), 256)
    return table(spark, sf_dir, "documents").groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""WITH l AS (SELECT * FROM part WHERE p_partkey % 2 = 0), r AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
l1 AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM l), r1 AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM r),
m1 AS (SELECT l1.p_partkey AS left_id, r1.p_partkey AS right_id FROM l1 JOIN r1 USING (p_name, k)),
l2 AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM l WHERE p_partkey NOT IN (SELECT left_id FROM m1)),
r2 AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM r WHERE p_partkey NOT IN (SELECT right_id FROM m1))
SELECT left_id, right_id, 1 AS pass FROM m1 UNION ALL SELECT l2.p_partkey, r2.p_partkey, 2 FROM l2 JOIN r2 USING (p_brand, p_type, k)""")
def rename_match_two_pass(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return compare.match_two_passes(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), "p_partkey", [["p_name"], ["p_brand", "p_type"]])


@query("""WITH j AS (SELECT p_brand, p_type, p_partkey, p_name, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, p_type, arg_min(p_partkey, struct_pack(a := length(p_name), b := p_partkey)) AS p_partkey, arg_min(p_name, struct_pack(a := length(p_name), b := p_partkey)) AS p_name, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_affected,
list_aggregate(list_slice(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), 1, 200), 'string_agg', ',') AS affected FROM j GROUP BY 1, 2""")
def collapse_root_cause(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return collapse.collapse(rows, ["p_brand", "p_type"], [F.length("p_name"), F.col("p_partkey")], ["p_partkey", "p_name"], "l_suppkey")


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("src"), (F.col("l_suppkey") % 37 + 3).alias("dst")).where("src <> dst and (src + dst) % 5 = 0").distinct()


_EDGES = "e AS (SELECT DISTINCT l_partkey % 40 AS src, l_suppkey % 37 + 3 AS dst FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 37 + 3 AND (l_partkey % 40 + l_suppkey % 37 + 3) % 5 = 0)"


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT src AS root, src AS node FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src) SELECT root, node FROM r")
def closure_full(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.closure(e.select(F.col("src").alias("root"), F.col("src").alias("node")), e).select("root", "node")


@query(f"WITH {_EDGES}, n AS (SELECT DISTINCT src AS root, src AS node, 0 AS hops FROM e UNION ALL SELECT src, dst, 1 FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) SELECT root, node, CAST(min(hops) AS INTEGER) AS hops FROM n GROUP BY 1, 2")
def closure_2hop(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.closure(e.select(F.col("src").alias("root"), F.col("src").alias("node")), e, max_hops=2)


@query(f"WITH {_EDGES} SELECT dst, CAST(count(*) AS BIGINT) AS n_src, min(src) AS first_src FROM e GROUP BY 1")
def incoming_refs(spark, sf_dir):
    return graph.incoming(_edges(spark, sf_dir))


def _key_edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).where("src <> dst").distinct()


_KEY_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"


@query(f"WITH RECURSIVE {_KEY_EDGES}, r AS (SELECT DISTINCT src AS root, src AS node FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src) SELECT root, node FROM r")
def closure_full_keys(spark, sf_dir):
    return graph.reached(_key_edges(spark, sf_dir))


@query(f"WITH {_KEY_EDGES}, n AS (SELECT DISTINCT src AS root, src AS node, 0 AS hops FROM e UNION ALL SELECT src, dst, 1 FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) SELECT root, node, CAST(min(hops) AS INTEGER) AS hops FROM n GROUP BY 1, 2")
def closure_2hop_keys(spark, sf_dir):
    return graph.two_hops(_key_edges(spark, sf_dir))


@query(f"WITH {_KEY_EDGES} SELECT dst, CAST(count(*) AS BIGINT) AS n_src, min(src) AS first_src FROM e GROUP BY 1")
def incoming_refs_keys(spark, sf_dir):
    return graph.incoming(_key_edges(spark, sf_dir))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_linenumber >= 6)")
def orphans(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_linenumber >= 6").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(used, "s_suppkey", "left_anti")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'O')")
def subsumed_parents(spark, sf_dir):
    return compare.all_of(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") != "O")


@query("""WITH w AS (SELECT DISTINCT p_brand FROM part WHERE p_size >= 49), h AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40 AND p_size >= 25 AND p_brand IN (SELECT p_brand FROM w))
SELECT l_suppkey FROM h GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w)""")
def relational_division(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    rows = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select("l_suppkey", "l_partkey").join(part.where("p_size >= 25"), F.col("l_partkey") == F.col("p_partkey"))
    return compare.dividing(rows, "l_suppkey", "p_brand", part.where("p_size >= 49").select("p_brand"))


@query("""WITH a AS (SELECT o_custkey, o_orderstatus, o_orderdate < TIMESTAMP '1998-01-01' AS is_old, list_distinct(list(o_orderpriority)) AS alt FROM orders GROUP BY 1, 2, 3),
m AS (SELECT o.o_custkey, o.alt, bool_or(len(list_filter(n.alt, lambda x: NOT list_contains(o.alt, x))) = 0) AS met FROM a o JOIN a n ON o.o_custkey = n.o_custkey AND o.is_old AND NOT n.is_old GROUP BY o.o_custkey, o.o_orderstatus, o.alt)
SELECT DISTINCT o_custkey FROM m WHERE NOT met""")
def security_subset(spark, sf_dir):
    alternatives = lambda d: d.groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("alt"))
    old, new = map(alternatives, _sides(spark, sf_dir))
    return compare.stranded(old, new, "o_custkey")


@query("SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN text LIKE '%!!%' THEN 'shouting' WHEN text LIKE '% | %' THEN 'table' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def suppression_counts(spark, sf_dir):
    reason = F.when(F.col("n_chars") < 200, "short").when(F.col("text").contains("!!"), "shouting").when(F.col("text").contains(" | "), "table").otherwise("kept")
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(array_to_string(list_slice(string_split(text, chr(10)), 1, 40), chr(10))), 'apache license|mit license|general public license|all rights reserved')")
def licence_marker(spark, sf_dir):
    head = F.lower(F.array_join(F.slice(F.split("text", "\n"), 1, 40), "\n"))
    return table(spark, sf_dir, "documents").where(head.rlike("apache license|mit license|general public license|all rights reserved")).select("doc_id")


_MARKS = ["token", "license", "rights", "example.com"]


@query("SELECT m.marker, d.doc_id FROM documents d JOIN (VALUES ('token'), ('license'), ('rights'), ('example.com')) m(marker) ON contains(lower(d.text), m.marker) AND regexp_matches(lower(d.text), replace(m.marker, '.', '[.]') || '($|[^a-z0-9_])')")
def evidence_theta_join(spark, sf_dir):
    marks = F.broadcast(spark.createDataFrame([(m, m.replace(".", "[.]") + "($|[^a-z0-9_])") for m in _MARKS], "marker string, pattern string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    return docs.join(marks, F.expr("contains(low, marker) and low rlike pattern")).select("marker", "doc_id")


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[0-9a-f]{32,}', '<hex>', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<date>', 'g')) AS digest FROM documents WHERE regexp_matches(text, '[0-9a-f]{32,}|[0-9]{4}-[0-9]{2}-[0-9]{2}')")
def stabilise_volatile(spark, sf_dir):
    stable = F.regexp_replace(F.regexp_replace("text", "[0-9a-f]{32,}", "<hex>"), "[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>")
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9a-f]{32,}|[0-9]{4}-[0-9]{2}-[0-9]{2}")).select("doc_id", F.sha2(stable.cast("binary"), 256).alias("digest"))


@query("SELECT page_id, CASE WHEN html IS NULL OR trim(html) = '' THEN 'empty' WHEN length(html) > 20000 THEN 'oversize' WHEN NOT regexp_matches(lower(substr(html, 1, 400)), '<!doctype|<html') THEN 'no head' WHEN NOT contains(lower(html), '</body>') THEN 'cut off' ELSE '' END AS reason FROM pages")
def html_validity(spark, sf_dir):
    low = F.lower("html")
    reason = F.when(F.col("html").isNull() | (F.trim("html") == ""), "empty").when(F.length("html") > 20000, "oversize").when(~F.lower(F.substring("html", 1, 400)).rlike("<!doctype|<html"), "no head").when(~F.contains(low, F.lit("</body>")), "cut off").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN regexp_matches(lower(source), '^src[0-4]$') THEN 'owner' WHEN regexp_matches(lower(source), '^src1[0-9]$') THEN 'ecosystem' WHEN lang <> 'en' THEN 'corpus' ELSE 'integrator' END AS kind FROM documents) GROUP BY 1")
def classify_source(spark, sf_dir):
    s = F.lower("source")
    kind = F.when(s.rlike("^src[0-4]$"), "owner").when(s.rlike("^src1[0-9]$"), "ecosystem").when(F.col("lang") != "en", "corpus").otherwise("integrator")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, regexp_matches(regexp_replace(url, '[?#].*$', ''), '/[^/]+/[0-9]+/*$') AS matches FROM pages""")
def number_tail(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").rlike("/[^/]+/[0-9]+/*$").alias("matches"))


@query("SELECT href, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def href_reads(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_partkey, CAST(rank AS INTEGER) AS rank, CAST(greatest(n - 12, 0) AS BIGINT) AS dropped FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rank <= 12")
def topk_with_drop(spark, sf_dir):
    return collapse.top_k(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 12).select("p_brand", "p_partkey", "rank", "dropped")


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def severity_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedupe_best_row(spark, sf_dir):
    return collapse.best_row(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT b.event_type, CAST(count(e.event_id) AS BIGINT) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) b(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1")
def bucket_zero_fill(spark, sf_dir):
    return collapse.zero_filled(table(spark, sf_dir, "events"), "event_type", ["click", "error", "purchase", "refund", "signup", "view"])


@query("SELECT lang, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE quality = 0) AS BIGINT) AS refuted, CAST(count(*) FILTER (WHERE quality IS NULL) AS BIGINT) AS undecidable, round(count(*) FILTER (WHERE quality = 1) / nullif(count(*) FILTER (WHERE quality IS NOT NULL), 0)::DOUBLE, 6) AS precision FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def precision_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    yes, no = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return rows.groupBy("lang").agg(yes.alias("confirmed"), no.alias("refuted"), F.count_if(F.col("quality").isNull()).alias("undecidable"), F.round(F.try_divide(yes.cast("double"), (yes + no).cast("double")), 6).alias("precision"))


@query("SELECT p_partkey, CAST((CASE WHEN contains(p_name, ' ') OR contains(p_name, '_') THEN 3 ELSE 0 END) + (CASE WHEN length(p_name) >= 16 THEN 3 WHEN length(p_name) >= 12 THEN 2 WHEN length(p_name) >= 8 THEN 1 ELSE 0 END) - (CASE WHEN length(p_name) < 4 THEN 2 ELSE 0 END) AS INTEGER) AS score FROM part")
def searchability_rank(spark, sf_dir):
    n = F.length("p_name")
    score = F.when(F.col("p_name").rlike("[ _]"), 3).otherwise(0) + F.when(n >= 16, 3).when(n >= 12, 2).when(n >= 8, 1).otherwise(0) - F.when(n < 4, 2).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("int").alias("score"))


@query("SELECT user_id, event_id FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usable FROM events) WHERE coalesce(usable, 0) < 5")
def stop_rule_prefix(spark, sf_dir):
    from pyspark.sql import Window

    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(before)
    return table(spark, sf_dir, "events").withColumn("usable", F.coalesce(usable, F.lit(0))).where("usable < 5").select("user_id", "event_id")


@query("SELECT date_trunc('day', ts) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def tumbling_changes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def sessionised_changes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).select("user_id", "started", "n")
