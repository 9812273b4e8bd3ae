"""Which findings a source file depends on, by joins of its facts with the findings' operations and fields.

A file reaches an operation by a call that writes its path and names its verb, or by a call of the
vendor's SDK that stands for it; it reads a field off a value that came from the vendor, or sends
one in a call that goes there. What a kind of finding needs of these decides (verdicts()).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import names, paths
from quillstone.plans import prefilter
from quillstone.sources import files
from quillstone.sources.scratch import cut

#: Fixed value: operations of a finding that are looked for.
MOST_OPS = 40
ID = "finding_id"
FILE = ["repo", "path"]
ROLE = [*FILE, ID]
CONFIRMED, NO_DEPENDENCE, GENERATED, COPIED, UNPROVEN, UNREADABLE, PINNED = "confirmed", "no_dependence", "generated", "copied", "unproven", "unreadable", "pinned"


def identified(findings: DataFrame) -> DataFrame:
    """Findings with an id of their own."""
    return findings.withColumn(ID, F.sha1(F.concat_ws("\x1f", "vendor", "spec_file", "kind", "subject", "op_key")))


def wire_names(kind: Column, subject: Column) -> Column:
    """Names of a subject as they stand on the wire, in order: without arms and elements, and without the schema that a schema's finding begins with."""
    tokens = F.filter(names.subject_tokens(subject), lambda t: ~t.startswith("<") & (t != "[]"))
    return F.when(kind.startswith("schema_") & (F.size(tokens) > 1), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(1)))).otherwise(tokens)


def in_order(position: Column, wanted: Column) -> Column:
    """Whether the wanted names stand in a position in that order, others between them or not."""
    # the names still wanted go along as the state: an expression inside the lambda is worked out again for every name of the position
    left = F.aggregate(position, wanted, lambda left, p: F.when(F.get(left, F.lit(0)) == p, F.slice(left, F.lit(2), F.size(left))).otherwise(left))
    return F.size(left) == 0


def proves(findings: DataFrame) -> DataFrame:
    """Adds how a finding is proven: by a read, by something sent, by a call, by its absence; and the name and those that must stand before it."""
    kind, wire = F.col("kind"), wire_names(F.col("kind"), F.col("subject"))
    schema = kind.startswith("schema_")
    field = kind.isin(names.FIELD_KINDS)
    return findings.withColumns({
        "by_read": field & (kind.startswith("response_") | schema & (F.col("in_response") | ~F.col("in_request"))), "by_send": field & (kind.startswith("request_") | kind.startswith("param_") | schema & F.col("in_request")),
        "by_call": kind.isin(names.ENDPOINT_KINDS), "by_absence": kind.isin(names.ABSENCE_KINDS), "leaf": F.element_at(wire, -1), "above": F.slice(wire, 1, F.greatest(F.size(wire) - 1, F.lit(0))),
    })


def comes_from_vendor(origins: Column, key: Column, evidence: Column, packages: Column) -> Column:
    """Whether a value's origins lead to a vendor: its name, a package of its SDK, or a host of it written on the way."""
    hosts = F.filter(evidence, lambda e: e.contains(".") & ~e.contains("/"))
    by_package = lambda o: F.exists(packages, lambda p: (o == F.concat(F.lit("module:"), F.lower(p))) | o.startswith(F.concat(F.lit("module:"), F.lower(p), F.lit("/"))) | o.startswith(F.concat(F.lit("module:"), F.lower(p), F.lit("."))))
    by_host = lambda o: o.startswith("text:") & (F.exists(hosts, lambda h: o.contains(F.lower(h))) | o.contains(F.concat(key, F.lit(".com"))) | o.contains(F.concat(F.lit("api."), key)))
    return F.coalesce(F.exists(origins, lambda o: (o == F.concat(F.lit("name:"), key)) | by_package(o) | by_host(o)), F.lit(False))


def operations(findings: DataFrame) -> DataFrame:
    """finding_id, vendor, op_path, op_method, own: the operations of each finding, its own one first."""
    every = F.array_distinct(F.filter(F.concat(F.array("op_key"), F.slice("affected_ops", 1, MOST_OPS)), lambda o: ~names.is_pseudo(o)))
    rows = findings.select(ID, "vendor", F.posexplode(every).alias("k", "op"))
    return rows.select(ID, "vendor", paths.path_of(F.col("op")).alias("op_path"), F.lower(F.split_part("op", F.lit(" "), F.lit(1))).alias("op_method"), (F.col("k") == 0).alias("own"))


def _tail(path: Column) -> Column:
    return F.reverse(F.transform(paths.segments(path), F.lower))


def calls_by_path(calls: DataFrame, ops: DataFrame) -> DataFrame:
    """Calls that write an operation's path: joined by the template's last literal segment and its place from the end, then compared as a whole; a host that is written must be the vendor's, and a verb that is not named is get."""
    tail = _tail(F.col("op_path"))
    literal = F.array_position(F.transform(tail, lambda s: ~paths.is_hole(s)), True).cast("int")
    wanted = ops.select("*", (literal - 1).alias("place"), F.get(tail, literal - 1).alias("segment")).where(literal > 0)
    written = calls.select("*", F.explode("strings").alias("written")).where(F.col("written").contains("/"))
    written = written.select("*", F.posexplode(_tail(F.col("written"))).alias("place", "segment"))
    met = written.join(wanted, ["vendor", "place", "segment"]).where(paths.ends_like(F.col("op_path"), F.col("written")))
    hosts = F.filter(F.transform("strings", paths.written_host), lambda h: h.isNotNull())
    own_host = F.exists(hosts, lambda h: h.contains(F.col("vendor")) | F.exists(F.filter("evidence", lambda e: e.contains(".") & ~e.contains("/")), lambda e: h.contains(F.lower(e))))
    verb = F.when(F.size("methods") > 0, F.array_contains("methods", F.col("op_method"))).otherwise(F.col("op_method") == "get")
    return met.where(((F.size(hosts) == 0) | own_host) & verb).select(*ROLE, "own", "line", "text", F.concat(F.lit("a call names path "), "written", F.lit(" and method "), F.upper("op_method")).alias("why"))


def calls_by_sdk(calls: DataFrame, findings: DataFrame, ops: DataFrame) -> DataFrame:
    """Calls on a value that came from the vendor: in a form that the finding's signatures list, or whose names in the middle are the path's last segments, singular or plural."""
    ours = calls.where("from_vendor")
    idioms = findings.select(ID, "vendor", F.explode(F.transform(F.filter("signatures", lambda s: F.length(s) > 6), lambda s: F.regexp_replace(s, r"[.(]+$", ""))).alias("idiom"))
    # all names of an idiom but its last are whole, so the first one is looked up; of a single name the beginning is compared
    idioms = idioms.withColumn("head", F.when(F.col("idiom").contains("."), F.split_part("idiom", F.lit("."), F.lit(1))))
    headed = ours.withColumn("head", F.split_part("chain", F.lit("."), F.lit(1))).join(idioms.where("head IS NOT NULL"), ["vendor", "head"]).drop("head")
    single_name = ours.join(idioms.where("head IS NULL").drop("head"), "vendor")
    by_idiom = headed.unionByName(single_name).where("startswith(chain, idiom)").withColumn("own", F.lit(True))
    single = lambda a: F.transform(a, lambda s: F.regexp_replace(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", "")), "s$", ""))
    parts = F.split("chain", r"\.")
    middle = single(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))
    statics = single(F.filter(paths.segments(F.col("op_path")), lambda s: ~paths.is_hole(s)))
    chained = ours.where("language <> 'Python'").withColumn("middle", middle).where("size(middle) > 0").withColumn("last", F.element_at("middle", -1))
    routed = ops.withColumn("statics", statics).where("size(statics) > 0").withColumn("last", F.element_at("statics", -1))
    fits = F.slice(F.reverse("statics"), 1, F.size("middle")) == F.reverse("middle")
    by_chain = chained.join(routed, ["vendor", "last"]).where(fits)
    why = F.concat(F.lit("`"), "chain", F.lit("(...)` is the SDK's form of this operation"))
    return by_idiom.select(*ROLE, "own", "line", "text", why.alias("why")).unionByName(by_chain.select(*ROLE, "own", "line", "text", why.alias("why")))


def _first(rows: DataFrame, name: str) -> DataFrame:
    """The first place of each finding in each file."""
    return rows.groupBy(*ROLE).agg(F.min(F.struct("line", "text", "why")).alias(name))


def evidence(facts: DataFrame, findings: DataFrame, detected: DataFrame, vendors: DataFrame) -> DataFrame:
    """repo, path, finding_id and the first place of each kind of evidence: reached, reached_own, traced, positional, sent, leaf_read (null: none)."""
    known = detected.select(*FILE, "vendor").join(vendors.select(F.col("key").alias("vendor"), "evidence", F.coalesce("packages", F.array().cast("array<string>")).alias("packages")), "vendor")
    rows = cut(facts.where("fact in ('call', 'construct', 'read')").join(known, FILE).withColumn("from_vendor", comes_from_vendor(F.col("origins"), F.col("vendor"), F.col("evidence"), F.col("packages"))))
    calls, reads = rows.where("fact <> 'read' and not registers"), rows.where("fact = 'read'")
    found = cut(proves(findings))
    ops = operations(found)
    reached = cut(calls_by_path(calls, ops).unionByName(calls_by_sdk(calls, found, ops)))
    last = reads.withColumn("leaf", F.element_at("position", -1)).withColumn("before", F.slice("position", 1, F.size("position") - 1))
    read = last.join(found.where("by_read").select(ID, "vendor", "leaf", "above"), ["vendor", "leaf"]).where(in_order(F.col("before"), F.col("above")))
    read = read.withColumn("why", F.concat(F.lit("reads `"), F.array_join("position", "."), F.lit("` off `"), "chain", F.lit("`")))
    sends = calls.select("*", F.explode("keys").alias("leaf")).join(found.where("by_send or by_absence").select(ID, "vendor", "leaf"), ["vendor", "leaf"]).withColumn("why", F.concat(F.lit("sends `"), "leaf", F.lit("` with `"), "chain", F.lit("`")))
    leaves = found.where("kind = 'schema_removed'").select(ID, "vendor", F.explode("leaf_fields").alias("leaf")).where(names.is_distinctive(F.col("leaf")))
    leaf_read = last.where("from_vendor or language <> 'Python'").join(leaves, ["vendor", "leaf"]).withColumn("why", F.concat(F.lit("reads `"), "leaf", F.lit("` of the schema")))
    parts = [
        _first(reached, "reached"), _first(reached.where("own"), "reached_own"), _first(read.where("from_vendor"), "traced"), _first(read, "positional"), _first(sends, "sent"), _first(leaf_read, "leaf_read"),
    ]
    return reduce(lambda a, b: a.join(b, ROLE, "full_outer"), parts)


def verdicts(sources: DataFrame, facts: DataFrame, findings: DataFrame, detected: DataFrame, vendors: DataFrame) -> DataFrame:
    """repo, path, finding_id, vendor, kind, subject, severity, verdict, proof (its kind), line, text, chain: one row for each finding of a vendor that a file speaks of and shares a term with.

    Files and findings that share no term (prefilter.pairs) could not be proven, and never meet.

    Gates come first: generated files, copies of packages, languages that cannot be read, files that
    could not be, and files that pin a vendor's version, for which the change has not arrived.
    """
    # a finding has a path of its own, which is none of a file
    proven = cut(proves(findings))
    met = cut(prefilter.pairs(sources, detected, proven, operations(proven)))
    found = proven.select(ID, "vendor", "kind", "subject", "severity", "root_cause", "by_read", "by_send", "by_call", "by_absence")
    gates = sources.select(*FILE, files.language(F.col("path")).alias("language"), files.looks_generated(F.col("text")).alias("is_generated"), "text").join(detected.select(*FILE, "vendor"), FILE)
    gates = gates.join(vendors.select(F.col("key").alias("vendor"), "package_dir"), "vendor").withColumn("is_library", files.looks_like_a_library(F.col("text"), F.col("path"), F.col("package_dir"))).drop("text", "package_dir")
    odd = facts.where("fact in ('unreadable', 'pin')").groupBy(*FILE).agg(F.bool_or(F.col("fact") == "unreadable").alias("unreadable"), F.bool_or(F.col("fact") == "pin").alias("pinned"))
    rows = gates.join(odd, FILE, "left").join(met, FILE).join(found, [ID, "vendor"]).join(evidence(facts, findings, detected, vendors), ROLE, "left")
    has = lambda c: F.col(c).isNotNull()
    js = F.col("language") != "Python"
    # in JavaScript, endpoints and absences are judged by the finding's own operation alone
    arrived = F.when(js & (F.col("by_call") | F.col("by_absence")), has("reached_own")).otherwise(has("reached"))
    arrival = F.when(js & (F.col("by_call") | F.col("by_absence")), F.col("reached_own")).otherwise(F.col("reached"))
    leafy = F.col("kind") == "schema_removed"
    readable = files.is_provable(F.col("path"))
    steps = [
        (F.col("is_generated"), GENERATED, "", None), (F.col("is_library"), COPIED, "", None), (~readable, UNPROVEN, "", None), (F.coalesce("unreadable", F.lit(False)), UNREADABLE, "", None), (js & F.coalesce("pinned", F.lit(False)), PINNED, "", None),
        (F.col("by_absence") & arrived & ~has("sent"), CONFIRMED, "field_missing", arrival), (F.col("by_call") & leafy & arrived & has("leaf_read"), CONFIRMED, "operation_call", arrival),
        (F.col("by_call") & ~leafy & arrived, CONFIRMED, "operation_call", arrival), (F.col("by_read") & has("traced"), CONFIRMED, "field_read", F.col("traced")),
        (F.col("by_read") & has("positional") & has("reached"), CONFIRMED, "field_read", F.col("positional")), (F.col("by_send") & has("sent") & has("reached"), CONFIRMED, "field_sent", F.col("sent")),
    ]
    none = F.struct(F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("why"))
    answer = F.struct(F.lit(NO_DEPENDENCE).alias("verdict"), F.lit("").alias("proof"), none.alias("at"))
    for when, verdict, proof, at in reversed(steps):
        answer = F.when(when, F.struct(F.lit(verdict).alias("verdict"), F.lit(proof).alias("proof"), (none if at is None else at).alias("at"))).otherwise(answer)
    reason = (
        F.when(F.col("by_absence") & arrived, "already sends it").when(F.col("by_read") & has("positional"), "reads a field of that name, not off the vendor's data").when(F.col("by_send") & has("sent"), "sends a field of that name elsewhere")
        .when(arrived, "calls the operation, not with this field").otherwise("reaches neither the operation nor the field")
    )
    rows = rows.withColumn("_a", answer)
    chain = F.array_compact(F.array(F.col("reached.why"), F.when(F.col("_a.at.why") != F.col("reached.why"), F.col("_a.at.why"))))
    return rows.select(
        *ROLE, "vendor", "kind", "subject", "severity", "root_cause", "language", F.col("_a.verdict").alias("verdict"), F.col("_a.proof").alias("proof"), F.col("_a.at.line").alias("line"), F.col("_a.at.text").alias("text"),
        F.when(F.col("_a.verdict") == CONFIRMED, F.when(F.size(chain) > 0, chain).otherwise(F.array("_a.at.why"))).otherwise(F.array(F.when(F.col("_a.verdict") == NO_DEPENDENCE, reason).otherwise(F.col("_a.verdict")))).alias("chain"),
    )


def relevance(facts: DataFrame, additions: DataFrame, detected: DataFrame, vendors: DataFrame) -> DataFrame:
    """finding_id, repo, path, line, text, why: for each addition the one file that would use it first: of those that reach its operations or siblings, one written for production, then by path."""
    hits = evidence(facts, additions, detected, vendors).where("reached is not null")
    order = F.struct(files.is_incidental(F.col("path")).alias("i"), "repo", "path")
    first = hits.groupBy(ID).agg(F.min_by(F.struct("repo", "path", "reached"), order).alias("x"))
    return first.select(ID, "x.repo", "x.path", "x.reached.*")
