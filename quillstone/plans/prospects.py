"""What to search code for, in what order, and what a search's finds are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import names, paths
from quillstone.operators.collapse import best_row, zero_filled

#: What becomes of a find, and patterns of repositories that are a copy of the world or a wrapper.
BUCKETS = ["vendored", "generated", "vendor_owned", "corpus", "ecosystem", "integrator"]
CORPUS = [
    r"top-pypi", r"sdists", r"pypi-mirror", r"\bmirror\b", r"^awesome-", r"allpythoncontent", r"pyreco", r"-dataset$", r"^dataset-", r"code-corpus", r"the-stack", r"github-crawl", r"^node_modules$", r"^vendor$",
    r"^third_party$", r"^bundled$",
]
ECOSYSTEM = [
    r"\.py$", r"\.js$", r"\.http$", r"-sdk$", r"^sdk-", r"-client$", r"^client-", r"-wrapper$", r"-api$", r"^api-", r"-mock$", r"^mock-", r"local[a-z]+$", r"-proxy$", r"^proxy-", r"-bindings$", r"-api-gen$", r"-codegen$",
    r"^openapi-",
]
#: Hits beyond which a query says little.
TOO_MANY = 2000
EMPTY = lambda: F.array().cast("array<string>")


def sdk_names(style: Column, path: Column, operation_id: Column, prefixes: Column) -> Column:
    """How an operation is written with an SDK, by the style of the vendor's. The names of the styles and what each writes."""
    segs = paths.resource_segments(path, prefixes)
    first, last = F.get(segs, F.lit(0)), F.element_at(segs, -1)
    one = names.pascal(F.regexp_replace(first, "s+$", ""))
    dotted = F.array_join(F.transform(segs, names.snake), ".")
    some = F.size(segs) > 0
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    has_id = operation_id != ""
    by_style = (
        F.when((style == "stripe") & some, F.array(say("stripe.", first, "."), say("stripe.", one, "."), say("Stripe::", one, ".")))
        .when(style == "openai", F.concat(F.when(some, F.array(say("client.", dotted, "."), say("openai.", dotted, "."), say(".", dotted, ".create"))).otherwise(EMPTY()), F.when(has_id, F.array(names.pascal(F.regexp_replace(operation_id, "^create", "")))).otherwise(EMPTY())))
        .when(style == "plaid", F.concat(F.when(has_id, F.array(say(names.snake(operation_id), "("), say(names.camel(operation_id), "("))).otherwise(EMPTY()), F.when(some, F.array(say(names.snake(F.array_join(segs, "_")), "("))).otherwise(EMPTY())))
        .when((style == "twilio") & some, F.array(say("client.", names.snake(last)), say(".", names.camel(last), "(")))
        .when(some, F.array(say(names.snake(last), "(")))
        .otherwise(EMPTY())
    )
    return F.concat(by_style, F.when(has_id, F.array(operation_id, names.snake(operation_id), names.camel(operation_id))).otherwise(EMPTY()))


def annotated(findings: DataFrame, vendors: DataFrame) -> DataFrame:
    """Findings with signatures (texts to search for, ordered, each once), a search command and a code search URL."""
    v = vendors.select(F.col("key").alias("vendor"), F.coalesce("sdk_style", F.lit("")).alias("_style"), F.coalesce("version_prefixes", EMPTY()).alias("_prefixes"), F.coalesce("languages", EMPTY()).alias("_languages"))
    rows = findings.join(v, "vendor", "left")
    path = F.when(F.col("path").startswith("#") | (F.col("path") == "/"), "").otherwise(F.col("path"))
    bare = paths.without_version(path, F.coalesce("_prefixes", EMPTY()))
    head = F.when(path.contains("{"), F.regexp_replace(F.split_part(path, F.lit("{"), F.lit(1)), "/+$", ""))
    schema = F.when(F.col("path").startswith("#") & (F.length(F.element_at(F.split("path", "/"), -1)) > 6), F.element_at(F.split("path", "/"), -1))
    leaf = names.leaf_of(F.col("subject"))
    by_field = F.when(F.col("kind").isin([*names.FIELD_KINDS, *names.ABSENCE_KINDS]) & (leaf != ""), F.array(F.concat(F.lit('"'), leaf, F.lit('"')), F.concat(F.lit("'"), leaf, F.lit("'")), F.concat(leaf, F.lit("=")))).otherwise(EMPTY())
    every = F.concat(F.array(path, bare, head), sdk_names(F.coalesce("_style", F.lit("")), path, F.col("operation_id"), F.coalesce("_prefixes", EMPTY())), F.array(schema), by_field)
    rows = rows.withColumn("signatures", names.ordered_distinct(every))
    return rows.withColumn("grep", names.grep(F.col("signatures"))).withColumn("github_search", names.code_search(F.col("signatures"), F.coalesce("_languages", EMPTY()))).drop("_style", "_prefixes", "_languages")


def query_text(weak: list[str] = names.WEAK, language: str = "") -> Column:
    """The query that says most of a finding: its field and its path together; else its schema, else a signature; one short term alone is joined by the vendor's name. '' if there is nothing to say."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    leaf = names.leaf_of(F.coalesce(F.when(F.col("root_cause") != "", F.col("root_cause")), F.col("subject")))
    usable = ~F.col("kind").isin([*names.ENDPOINT_KINDS, *names.ABSENCE_KINDS]) & (F.length(leaf) >= 3) & ~F.lower(leaf).isin(weak)
    run = paths.static_run(paths.canonical(F.col("affected_ops"), F.col("path")))
    schema = F.split_part(F.coalesce(F.when(F.col("root_cause") != "", F.col("root_cause")), F.col("subject")), F.lit("."), F.lit(1))
    field, place = F.when(usable, quoted(leaf)), F.when(F.length(run) > 6, quoted(run))
    by_schema = F.when(field.isNull() & place.isNull() & (F.length(schema) > 8) & ~F.lower(schema).isin(weak), quoted(schema))
    sig = F.get(F.filter("signatures", lambda s: (F.length(s) > 8) & ~s.contains(" ") & ~s.rlike("^['\"]")), F.lit(0))
    by_sig = F.when(F.coalesce(field, place, by_schema).isNull(), quoted(sig))
    found = F.array_compact(F.array(field, place, by_schema, by_sig))
    anchored = F.when((F.size(found) == 1) & (F.length(F.get(found, F.lit(0))) < 24), F.concat(found, F.array("vendor"))).otherwise(found)
    return F.when(F.size(found) == 0, "").otherwise(F.array_join(F.concat(anchored, F.array(F.lit(f"language:{language}"))) if language else anchored, " "))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with a query, the most findable first, then of the widest reach: rank per vendor; of equal queries the first stays."""
    rows = findings.withColumn("query", query_text()).withColumn("score", names.searchability(F.coalesce(F.when(F.col("root_cause") != "", F.col("root_cause")), F.col("subject")), F.col("kind"))).where("query <> ''")
    order = [F.desc("score"), F.desc("occurrences"), F.asc("subject"), F.asc("kind"), F.asc("spec_file")]
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("vendor", "query").orderBy(*order))).where("_k = 1").drop("_k")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("vendor").orderBy(*order)))


def precision(total: Column, failed: Column) -> Column:
    """What a number of hits is worth."""
    return F.when(failed, "error").when(total == 0, "none").when(total > TOO_MANY, "low").otherwise("usable")


def until_enough(prospects: DataFrame, enough: int, attempts: int) -> DataFrame:
    """The queries of each vendor that are asked, in order of rank: until `enough` were usable, at most `attempts`. total and failed are what each query's search gave."""
    rows = prospects.withColumn("precision", precision(F.col("total"), F.col("failed"))).where(F.col("rank") <= attempts)
    before = Window.partitionBy("vendor").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_u", F.coalesce(F.sum((F.col("precision") == "usable").cast("int")).over(before), F.lit(0))).where(F.col("_u") < enough).drop("_u")


def local_search(prospects: DataFrame, sources: DataFrame) -> DataFrame:
    """finding_id, total, hits: a search of files (repo, path, text) at hand, in place of a hosted one: files that hold all quoted terms of a query."""
    terms = F.regexp_extract_all("query", F.lit('"([^"]+)"'), 1)
    wanted = prospects.select("finding_id", terms.alias("terms")).where("size(terms) > 0").withColumn("first", F.get("terms", F.lit(0)))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), 0))
    # files and queries meet at the longest word of the first term, then all terms are looked for
    wanted = wanted.withColumn("word", F.element_at(F.array_sort(F.transform(words("first"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"])
    held = sources.select("repo", "path", "text", F.explode(words("text")).alias("word")).join(wanted, "word")
    hits = held.where(F.forall("terms", lambda t: F.col("text").contains(t)))
    return hits.groupBy("finding_id").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_set(F.struct("repo", "path"))).alias("hits"))


def _any(column: Column, patterns: list[str]) -> Column:
    return column.rlike("|".join(f"(?:{p})" for p in patterns))


def classified(repo: Column, path: Column, vendor: Column, owners: Column, is_copied: Column, is_generated: Column, known: list[str]) -> Column:
    """kind and reason of a find, by ordered rules: owners are the organisations of the vendor, known the names of projects that wrap it."""
    owner, name = F.lower(F.split_part(repo, F.lit("/"), F.lit(1))), F.lower(F.element_at(F.split(repo, "/"), -1))
    rules = [
        (is_copied, "vendored", "a copy of a package"), (is_generated, "generated", "built or generated"), (F.array_contains(F.transform(owners, F.lower), owner), "vendor_owned", "the vendor's own"),
        (_any(name, CORPUS) | _any(owner, CORPUS), "corpus", "a copy of the world"), (name.isin(known) | _any(name, ECOSYSTEM) | name.contains(vendor), "ecosystem", "wraps the vendor"),
    ]
    out = F.struct(F.lit("integrator").alias("kind"), F.lit("calls the vendor").alias("reason"))
    for when, kind, reason in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def bucket_counts(leads: DataFrame) -> DataFrame:
    """How many leads (kind) are of each kind, none too."""
    return zero_filled(leads, "kind", BUCKETS)


def one_per_repo(leads: DataFrame) -> DataFrame:
    """Of each repository the lead with the most sites, the first of equal ones by path."""
    return best_row(leads, "repo", [F.desc(F.size("sites")), F.asc("path")])


def merged(held: DataFrame, fresh: DataFrame, key: str = "vendor") -> DataFrame:
    """Held rows, but for keys that are fresh, and the fresh ones."""
    return held.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def survival(verdicts: DataFrame) -> DataFrame:
    """verdict, n and percent of all, whole numbers."""
    counts = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("verdict", "n", F.expr("100 * n div sum(n) over (partition by 1)").alias("percent"))
