"""Which differences between two versions of an API description can break a caller.

Facts of both sides are joined once, by their place; every rule is a condition on the joined row.
What has no partner by its place is matched once more by its blind path, in which the names of
schemas count for nothing: a body moved to a reference, or an arm renamed, has lost no field.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import names, paths
from quillstone.operators import collapse as collapsing
from quillstone.operators import compare, graph
from quillstone.sources.contracts import TRUNCATED
from quillstone.sources.scratch import cut

BREAKING, POTENTIAL, OPPORTUNITY = "breaking", "potentially_breaking", "opportunity"
FILE = ["vendor", "spec_file"]
OP = [*FILE, "op_key"]
PLACE = [*FILE, "facet", "op_key", "part", "key"]
STATE = ["type", "required", "nullable", "deprecated", "values", "seq", "blind", "bare", "up", "cause", "leaf", "deep", "root", "shape", "target", "note"]
#: What a rule says; finished() adds the rest of FINDING.
RAW = [*FILE, "kind", "severity", "op_key", "subject", "status", "old", "new", "root_cause", "leaf_fields", "schema", "blurb"]
FINDING = [
    *FILE, "kind", "severity", "op_key", "path", "method", "operation_id", "subject", "status", "old", "new", "detail", "root_cause", "occurrences", "affected_op_count", "direct_op_count",
    "affected_ops", "leaf_fields", "in_request", "in_response", "resource", "blurb",
]
#: Fixed value: operations listed with a finding.
MOST_OPS = 200


def paired(facts: DataFrame) -> DataFrame:
    """Old and new state of every place (o and n, null where absent), in one full outer join on the place."""
    keyed = facts.select(*[F.coalesce(c, F.lit("")).alias(c) for c in PLACE], "side", F.struct(*STATE).alias("s"))
    old, new = (keyed.where(F.col("side") == side).select(*PLACE, F.col("s").alias(name)) for side, name in (("old", "o"), ("new", "n")))
    return old.join(new, PLACE, "full_outer")


def renamed(facts: DataFrame) -> DataFrame:
    """(vendor, spec_file, old_key, new_key): operations gone and come that are one: first by what callers see of the path, then by method and operationId."""
    ops = facts.where("facet = 'op'").select(*FILE, "side", F.col("op_key").alias("id"), paths.visible_path(F.col("op_key")).alias("seen"), "type", F.col("key").alias("operation_id"))
    old, new = ops.where("side = 'old'"), ops.where("side = 'new'")
    left, right = old.join(new.select(*FILE, "id"), [*FILE, "id"], "left_anti"), new.join(old.select(*FILE, "id"), [*FILE, "id"], "left_anti")
    # ids are of a file each: the id carries it through the passes
    tagged = lambda d: d.withColumn("id", F.struct(*FILE, "id"))
    named = lambda d: d.withColumn("operation_id", F.when(F.col("operation_id") != "", F.col("operation_id")))
    hit = compare.match_two_passes(named(tagged(left)), named(tagged(right)), "id", [[*FILE, "seen"], [*FILE, "type", "operation_id"]])
    return hit.select("left_id.vendor", "left_id.spec_file", F.col("left_id.id").alias("old_key"), F.col("right_id.id").alias("new_key"))


def follow_renames(facts: DataFrame, moves: DataFrame) -> DataFrame:
    """The old side's facts under the new names of their operations."""
    old = facts.where("side = 'old'").join(moves.withColumnRenamed("old_key", "op_key"), OP, "left")
    return old.withColumn("op_key", F.coalesce("new_key", "op_key")).select(*facts.columns).unionByName(facts.where("side <> 'old' or side is null"))


def _gained(a: str, b: str) -> Column:
    return F.array_except(F.col(b), F.col(a))


def _shown(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


class _Changed:
    """Conditions on a joined row, made when they are asked for: columns need a session."""

    _conditions = {
        "both": "o is not null and n is not null", "lost": "o is not null and n is null", "come": "o is null and n is not null", "retyped": "o is not null and n is not null and o.type <> n.type",
        # both sides list their values, and one is missing or new
        "fewer": "size(array_except(o.values, n.values)) > 0", "more": "size(array_except(n.values, o.values)) > 0",
    }

    def __getattr__(self, name: str) -> Column:
        return F.expr(self._conditions[name])

    def turned(self, field: str) -> Column:
        return F.expr(f"o is not null and n is not null and not coalesce(o.{field}, false) and coalesce(n.{field}, false)")


Changed = _Changed()


def _row(rows: DataFrame, kind, severity, subject=None, old=None, new=None, **more) -> DataFrame:
    """Rows of RAW; what is not given is empty."""
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    text = lambda x: F.coalesce(lit(x), F.lit("")).cast("string") if x is not None else F.lit("")
    subject = text(F.col("key") if subject is None else subject)
    have = {
        "kind": lit(kind), "severity": lit(severity), "op_key": F.coalesce("op_key", F.lit("")) if "op_key" in rows.columns else F.lit(""), "subject": subject, "status": text(more.get("status")), "old": text(old), "new": text(new),
        "root_cause": F.coalesce(more["cause"], subject) if "cause" in more else subject, "leaf_fields": more.get("leaves", F.array().cast("array<string>")), "schema": F.lit(more.get("schema")).cast("string"), "blurb": text(more.get("blurb")),
    }
    return rows.select(*FILE, *[have[c].alias(c) for c in RAW[2:]])


def _rule(pairs: DataFrame, facet: str, when: Column, kind, severity, subject=None, old=None, new=None, **more) -> DataFrame:
    return _row(pairs.where((F.col("facet") == facet) & when), kind, severity, subject, old, new, **more)


@dataclass
class Drift:
    """findings: rows of FINDING; suppressed: (vendor, spec_file, reason, n), removals of schemas that no caller can see, by why, and those that could not be judged."""

    findings: DataFrame
    suppressed: DataFrame


def _node(name: str) -> Column:
    return F.struct(*FILE, F.col(name).alias("name"))


class Sides:
    """The facts of two versions, paired, with what several families of rules read; each is written once, when it is first asked for."""

    def __init__(self, facts: DataFrame):
        facts = cut(facts.where("facet <> 'error'"))
        self.moves = cut(renamed(facts))
        self.facts = cut(follow_renames(facts, self.moves))
        files = self.facts.groupBy(*FILE).agg(F.bool_or(F.col("side") == "old").alias("was"), F.bool_or(F.col("side") == "new").alias("is"), F.count_if((F.col("side") == "new") & (F.col("facet") == "op")).alias("n_new"))
        self.files = cut(files)
        self._used: dict[str, DataFrame] = {}

    def _paired(self, facts: DataFrame) -> DataFrame:
        return cut(paired(facts).join(self.files.where("was and `is`").select(*FILE), FILE, "left_semi"))

    @cached_property
    def pairs(self) -> DataFrame:
        return self._paired(self.facts)

    @cached_property
    def kept(self) -> DataFrame:
        """What belongs to an operation counts only where the operation is on both sides."""
        return cut(self._paired(self.facts.where("facet = 'op'")).where(Changed.both).select(*OP))

    @cached_property
    def inside(self) -> DataFrame:
        return cut(self.pairs.where(F.col("facet").isin("param", "field", "response")).join(self.kept, OP, "left_semi"))

    def side(self, name: str, facet: str) -> DataFrame:
        return self.facts.where((F.col("side") == name) & (F.col("facet") == facet))

    def edges(self, side: str) -> DataFrame:
        """(src, dst): which schema refers to which; a schema is its file and name."""
        return self.side(side, "ref").select(_node("part").alias("src"), _node("key").alias("dst"))

    def used(self, side: str) -> DataFrame:
        """(vendor, spec_file, schema, in_request, in_response): schemas that operations reach along references, and in which directions. No operation is followed by itself."""
        if side not in self._used:
            found = graph.closure(self.side(side, "root").select(F.col("part").alias("root"), _node("key").alias("node")), self.edges(side))
            by = found.groupBy("node").agg(F.bool_or(F.col("root") == "request").alias("in_request"), F.bool_or(F.col("root") == "response").alias("in_response"))
            self._used[side] = cut(by.select("node.vendor", "node.spec_file", F.col("node.name").alias("schema"), "in_request", "in_response"))
        return self._used[side]

    def reach(self, side: str, wanted: DataFrame) -> DataFrame:
        """(vendor, spec_file, schema, op_key, hops): the operations that reach each of the wanted schemas (vendor, spec_file, schema), and how near: the way back from the schemas to those that operations name."""
        back = self.edges(side).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = graph.closure(wanted.select(F.col("schema").alias("root"), _node("schema").alias("node")), back)
        named = self.side(side, "root").select(_node("key").alias("node"), "op_key").distinct()
        return found.join(named, "node").groupBy("node.vendor", "node.spec_file", F.col("root").alias("schema"), "op_key").agg(F.min("hops").alias("hops"))

    def visible(self, side: str) -> DataFrame:
        """(vendor, spec_file, op_key, direction, leaf): names of fields that an operation shows."""
        rows = self.side(side, "field").where(F.col("leaf").isNotNull())
        return rows.select(*OP, F.split_part("part", F.lit("/"), F.lit(1)).alias("direction"), "leaf").distinct()


def files_and_operations(s: Sides) -> list[DataFrame]:
    """Files and operations gone, come, moved or deprecated, bodies now required, schemes gone."""
    op = F.col("op_key")
    seen = paths.visible_path(op).alias("seen")
    seen_before = s.side("old", "op").join(s.moves.select(*FILE, F.col("new_key").alias("op_key")), OP, "left_anti").select(*FILE, seen)
    seen_before = seen_before.unionByName(s.moves.select(*FILE, paths.visible_path(F.col("old_key")).alias("seen"))).distinct()
    come = s.pairs.where((F.col("facet") == "op") & Changed.come).withColumn("seen", seen).join(seen_before, [*FILE, "seen"], "left_anti")
    moved = s.moves.where(paths.visible_path(F.col("old_key")) != paths.visible_path(F.col("new_key"))).withColumn("op_key", F.col("new_key"))
    ids = s.side("new", "op").select(*OP, F.col("key").alias("operation_id"))
    moved = moved.join(ids, OP, "left")
    return [
        _row(s.files.where("was and not `is`"), "spec_removed", BREAKING, F.col("spec_file")),
        _row(s.files.where("not was and `is`"), "spec_added", OPPORTUNITY, F.col("spec_file"), None, F.col("n_new")),
        _row(moved, "endpoint_moved", BREAKING, F.coalesce(F.when(F.col("operation_id") != "", F.col("operation_id")), F.col("old_key")), F.col("old_key"), F.col("new_key")),
        _rule(s.pairs, "op", Changed.lost, "endpoint_removed", BREAKING, paths.path_of(op)),
        _row(come, "endpoint_added", OPPORTUNITY, paths.path_of(op), None, op, blurb=F.col("n.note")),
        _rule(s.pairs, "op", Changed.turned("deprecated"), "endpoint_deprecated", POTENTIAL, "<operation>"),
        _rule(s.pairs, "op", Changed.turned("required"), "request_body_now_required", BREAKING, "<body>"),
        _rule(s.pairs, "scheme", Changed.lost, "security_scheme_removed", BREAKING),
    ]


def parameters(s: Sides) -> list[DataFrame]:
    off_path, c = F.col("part") != "path", Changed
    return [
        _rule(s.inside, "param", c.lost & off_path, "param_removed", POTENTIAL),
        _rule(s.inside, "param", c.come & off_path & F.col("n.required"), "param_added_required", BREAKING),
        _rule(s.inside, "param", c.turned("required"), "param_now_required", BREAKING),
        _rule(s.inside, "param", c.retyped, "param_type_changed", BREAKING, None, F.col("o.type"), F.col("n.type")),
        _rule(s.inside, "param", c.turned("deprecated"), "param_deprecated", POTENTIAL),
        _rule(s.inside, "param", c.fewer, "request_enum_value_removed", BREAKING, None, _shown(_gained("n.values", "o.values"))),
    ]


def body_fields(s: Sides) -> list[DataFrame]:
    """Body fields. Truncation is ignorance: nothing deeper than a cut on the other side has gone or come."""
    body = [*OP, "part"]
    fields = s.inside.where("facet = 'field'")
    whole = fields.groupBy(*body).agg(
        F.min(F.when(F.col("o.type") == TRUNCATED, F.col("o.deep"))).alias("cut_o"), F.min(F.when(F.col("n.type") == TRUNCATED, F.col("n.deep"))).alias("cut_n"),
        F.count("o").alias("any_o"), F.count("n").alias("any_n"),
    )
    rows = cut(fields.join(whole, body).where((F.coalesce(F.col("o.type"), F.lit("")) != TRUNCATED) & (F.coalesce(F.col("n.type"), F.lit("")) != TRUNCATED)))
    c, request = Changed, F.col("part") == "request"
    by_blind = lambda side: fields.where(f"{side} is not null").groupBy(*body, F.col(f"{side}.blind").alias("blind")).agg(F.min_by(F.col(side), F.col(f"{side}.seq")).alias("other"))
    lost = rows.where(c.lost & (F.col("cut_n").isNull() | (F.col("o.deep") < F.col("cut_n")))).withColumn("blind", F.col("o.blind")).join(by_blind("n"), [*body, "blind"], "left")
    gone = lost.where(F.col("other").isNull() & ~(F.col("o.root") & (F.col("any_n") > 0)))
    # a reshaped place is compared with the first that looks like it, once
    first = F.row_number().over(Window.partitionBy(*body, "blind").orderBy("o.seq", "key"))
    reshaped = lost.where(F.col("other").isNotNull() & (F.col("other.type") != TRUNCATED)).withColumn("_k", first).where("_k = 1").withColumn("n", F.col("other"))

    come = rows.where(c.come & F.col("n.required") & request & (F.col("any_o") > 0) & (F.col("cut_o").isNull() | (F.col("n.deep") < F.col("cut_o"))))
    come = come.withColumn("blind", F.col("n.blind")).join(by_blind("o").select(*body, "blind"), [*body, "blind"], "left_anti")
    bares = fields.where("o is not null").groupBy(*body, F.col("o.bare").alias("bare")).agg(F.bool_and(F.coalesce("o.required", F.lit(False))).alias("asked"))
    # what came with the object it is in asks nothing of old callers, nor what every old way there asked for
    above = come.select(*body, "key", F.explode("n.up").alias("bare")).join(bares.select(*body, "bare"), [*body, "bare"], "left_anti").select(*body, "key").distinct()
    fresh = come.join(above, [*body, "key"], "left_anti").withColumn("bare", F.col("n.bare")).join(bares.where("asked").select(*body, "bare"), [*body, "bare"], "left_anti")

    direction = F.when(request, "request").otherwise("response")
    said = {"status": F.when(~request, F.split_part("part", F.lit("/"), F.lit(2)))}
    of = lambda side: said | {"cause": F.col(f"{side}.cause"), "leaves": F.array_compact(F.array(F.col(f"{side}.leaf")))}
    kind = lambda tail: F.concat(direction, F.lit(tail))
    out = [_row(gone, kind("_field_removed"), F.when(request, POTENTIAL).otherwise(BREAKING), **of("o")), _row(fresh, "request_field_added_required", BREAKING, **of("n"))]
    for some in (rows.where(c.both), reshaped):
        removed = _shown(_gained("n.values", "o.values"))
        out += [
            _row(some.where(c.retyped), kind("_field_type_changed"), BREAKING, None, F.col("o.type"), F.col("n.type"), **of("o")),
            _row(some.where(c.turned("required") & request), "request_field_now_required", BREAKING, **of("o")),
            _row(some.where(c.turned("nullable") & ~request), "response_field_now_nullable", POTENTIAL, **of("o")),
            _row(some.where(c.fewer), kind("_enum_value_removed"), F.when(request, BREAKING).otherwise(POTENTIAL), None, removed, **of("o")),
            _row(some.where(c.more & ~request), "response_enum_value_added", POTENTIAL, None, None, _shown(_gained("o.values", "n.values")), **of("o")),
        ]
    return out


def statuses(s: Sides) -> list[DataFrame]:
    """Success statuses that went: breaking if none is left."""
    rows = s.inside.where((F.col("facet") == "response") & F.col("key").startswith("2"))
    left = rows.groupBy(*OP).agg(F.bool_or(F.col("n").isNotNull()).alias("left"))
    return [_row(rows.where(Changed.lost).join(left, OP), "response_status_removed", F.when(F.col("left"), POTENTIAL).otherwise(BREAKING), status=F.col("key"))]


def security(s: Sides) -> list[DataFrame]:
    """Operations with an old alternative that no new one is a part of, or that asked for nothing before."""
    declared = s.side("old", "scheme").select(*FILE).distinct()
    rows = s.facts.where("facet = 'security'").join(s.kept, OP, "left_semi").join(declared, FILE, "left_semi")
    shown = rows.groupBy(*OP).agg(*[F.first(F.when(F.col("side") == x, names.security_text(F.col("values"))), ignorenulls=True).alias(x) for x in ("old", "new")])
    each = rows.select("side", F.struct(*OP).alias("id"), F.explode(F.when(F.size("values") > 0, F.col("values")).otherwise(F.array(F.lit("")))).alias("a"))
    each = each.select("side", "id", F.filter(F.split("a", ","), lambda x: x != "").alias("alt"))
    hit = compare.stranded(each.where("side = 'old'"), each.where("side = 'new'"), "id").select("id.*").join(shown, OP)
    return [_row(hit, "security_requirement_added", BREAKING, "<security>", F.col("old"), F.col("new"))]


def servers(s: Sides) -> list[DataFrame]:
    """Documents and operations all of whose servers changed."""
    rows = s.facts.where("facet = 'server' or facet = 'op_server'").withColumn("op_key", F.coalesce("op_key", F.lit("")))
    sides = rows.groupBy("facet", *OP).agg(*[F.collect_set(F.when(F.col("side") == x, F.col("key"))).alias(y) for x, y in (("old", "a"), ("new", "b"))])
    moved = sides.where((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b"))
    out = moved.where("facet = 'server'").unionByName(moved.where("facet = 'op_server'").join(s.kept, OP, "left_semi").select(*moved.columns))
    kind = F.when(F.col("facet") == "server", "server_url_changed").otherwise("operation_server_changed")
    return [_row(out, kind, BREAKING, "<server>", _shown(F.col("a")), _shown(F.col("b")))]


def survived(s: Sides, fields: DataFrame) -> DataFrame:
    """Of fields (vendor, spec_file, schema, leaf), those that an operation showed before and that every one that showed it shows still."""
    old, new = (s.visible(x).select(*OP, "leaf").distinct() for x in ("old", "new"))
    asked = old.join(fields.select(*FILE, "leaf").distinct(), [*FILE, "leaf"], "left_semi")
    shown = asked.join(new.withColumn("still", F.lit(True)), [*OP, "leaf"], "left").withColumn("still", F.coalesce("still", F.lit(False)))
    # what is shown of a name, still or not, goes from the schemas that an operation names to all that they refer to
    roots = s.side("old", "root").select(*OP, "key").join(s.kept, OP, "left_semi").join(shown, OP).select(F.struct("leaf", "still").alias("root"), _node("key").alias("node"))
    found = graph.closure(roots, s.edges("old")).select("node.vendor", "node.spec_file", F.col("node.name").alias("schema"), "root.leaf", "root.still")
    return found.join(fields, [*FILE, "schema", "leaf"], "left_semi").groupBy(*FILE, "schema", "leaf").agg(F.bool_and("still").alias("still")).where("still").drop("still")


def removal_reasons(s: Sides) -> DataFrame:
    """(vendor, spec_file, schema, reason) of every schema gone: why no caller can see it; "" if one can, "unmeasurable" and "truncated" if that cannot be told (and it counts)."""
    key = [*FILE, "schema"]
    of_schema = lambda side: s.side(side, "schema").select(*FILE, F.col("key").alias("schema"), "type", "values", "shape", F.col("up").alias("wanted"))
    old, new = cut(of_schema("old")), cut(of_schema("new"))
    gone = cut(old.join(new.select(*key), key, "left_anti").join(s.files.where("was and `is`").select(*FILE), FILE, "left_semi"))
    live = old.join(new.select(*key), key, "left_semi").select(*key)
    used = s.used("old")
    signal = s.side("old", "root").select(*FILE).distinct().withColumn("signal", F.lit(True))
    roots = lambda side: s.side(side, "root").select(*OP, "part", F.col("key").alias("schema")).distinct()
    direct = cut(roots("old").join(gone.select(*key), key, "left_semi").select(*key, "op_key").distinct())
    carrying = direct.join(s.kept, OP, "left_semi")

    # parents: schemas that refer to it, itself aside
    parents = s.side("old", "ref").select(*FILE, F.col("part").alias("parent"), F.col("key").alias("schema")).where("parent <> schema").join(gone.select(*key, "shape"), key)
    as_parent = lambda d: d.withColumnRenamed("schema", "parent")
    parents = cut(parents.join(as_parent(live).withColumn("live", F.lit(True)), [*FILE, "parent"], "left").join(as_parent(gone.select(*key)).withColumn("removed", F.lit(True)), [*FILE, "parent"], "left"))
    fields = lambda side: s.side(side, "schema_field").select(*FILE, F.col("part").alias("parent"), "key", "shape", "target", "required", "seq")
    pointing = fields("old").select(*FILE, "parent", F.col("target").alias("schema"), "key", F.col("shape").alias("before")).join(fields("new").select(*FILE, "parent", "key", F.col("shape").alias("after")), [*FILE, "parent", "key"], "left")
    by_field = pointing.groupBy(*FILE, "parent", "schema").agg(F.bool_and(F.col("before").eqNullSafe(F.col("after"))).alias("at_fields"))
    named_now = s.side("new", "ref").select(*FILE, F.col("part").alias("parent"), F.col("key").alias("schema")).join(new.select(*key, "shape"), key).select(*FILE, "parent", "shape").distinct().withColumn("at_refs", F.lit(True))
    whole = as_parent(old.select(*key, F.col("shape").alias("before"))).join(as_parent(new.select(*key, F.col("shape").alias("after"))), [*FILE, "parent"])
    judged = parents.join(by_field, [*FILE, "parent", "schema"], "left").join(named_now, [*FILE, "parent", "shape"], "left").join(whole, [*FILE, "parent"], "left")
    # the same shape where it was pointed at; else among what the parent names now; else the parent as a whole
    same = F.coalesce(F.col("at_fields"), F.col("at_refs"), F.col("before").eqNullSafe(F.col("after")) & F.col("before").isNotNull())
    by_parents = judged.groupBy(*key).agg(F.bool_and(F.coalesce("removed", F.lit(False))).alias("parents_gone"), F.count("live").alias("n_live"), F.bool_and(F.when(F.col("live"), same)).alias("at_parents"))

    # renamed: every operation that named it names one of the same shape on the same side, or of more if it is only read
    side_of = used.select(*key, F.when(F.col("in_request") & F.col("in_response"), "all").when(F.col("in_request"), "request").otherwise("response").alias("direction"))
    at_op = carrying.join(side_of, key, "left").withColumn("direction", F.coalesce("direction", F.lit("all")))
    offered = at_op.join(roots("new").select(*OP, "part", F.col("schema").alias("other")), OP).where("direction = 'all' or part = direction")
    pairs = offered.select(*key, "other", "direction").distinct()
    pairs = pairs.join(old, key).join(new.select(*FILE, F.col("schema").alias("other"), *[F.col(x).alias(f"{x}2") for x in ("type", "values", "shape", "wanted")]), [*FILE, "other"])
    in_schema = lambda side, name: fields(side).select(*FILE, F.col("parent").alias(name), "key", F.col("shape").alias(f"{side}_shape"))
    kept = pairs.select(*key, "other").join(in_schema("old", "schema"), key).join(in_schema("new", "other"), [*FILE, "other", "key"], "left")
    kept = kept.groupBy(*key, "other").agg(F.bool_and(F.col("old_shape").eqNullSafe(F.col("new_shape"))).alias("fields_kept"))
    more = (F.col("direction") == "response") & (F.col("type") == F.col("type2")) & F.col("values").eqNullSafe(F.col("values2")) & (F.size(F.array_except("wanted", "wanted2")) == 0) & F.coalesce("fields_kept", F.lit(True))
    fits = pairs.join(kept, [*key, "other"], "left").select(*key, "other", (F.col("shape").eqNullSafe(F.col("shape2")) | more).alias("fits"))
    by_op = offered.join(fits, [*key, "other"]).groupBy(*key, "op_key").agg(F.bool_or("fits").alias("fits"))
    by_roots = carrying.join(by_op, [*key, "op_key"], "left").groupBy(*key).agg(F.count(F.lit(1)).alias("n_carrying"), F.bool_and(F.coalesce("fits", F.lit(False))).alias("renamed"))

    # by names: what it contributed is still visible on each operation that showed any of it
    contributed = cut(fields("old").select(*FILE, F.col("parent").alias("schema"), F.col("key").alias("leaf")).join(gone.select(*key), key, "left_semi"))
    seen = lambda side: s.visible(side).select(*OP, "direction", "leaf")
    asked = at_op.withColumnRenamed("direction", "way").join(contributed, key)
    for side in ("old", "new"):
        there = seen(side).withColumnRenamed("direction", f"d_{side}")
        asked = asked.join(there, [*OP, "leaf"], "left").withColumn(f"in_{side}", F.col(f"d_{side}").isNotNull() & ((F.col("way") == "all") | (F.col("way") == F.col(f"d_{side}"))))
        asked = asked.groupBy(*key, "op_key", "way", "leaf", *(["in_old"] if side == "new" else [])).agg(F.bool_or(f"in_{side}").alias(f"in_{side}"))
    by_names = asked.groupBy(*key, "op_key").agg(F.bool_or("in_old").alias("any"), F.bool_and("in_new").alias("all")).groupBy(*key).agg(F.bool_and(~F.col("any") | F.col("all")).alias("names_stay"))
    nothing = at_op.join(contributed.select(*key).distinct(), key, "left_anti")
    lost_names = seen("old").join(seen("new"), [*OP, "direction", "leaf"], "left_anti").select(*OP, "direction").distinct()
    bare = nothing.join(lost_names.withColumnRenamed("direction", "lost_in"), OP, "left").groupBy(*key).agg(F.bool_and(F.col("lost_in").isNull() | ((F.col("direction") != "all") & (F.col("direction") != F.col("lost_in")))).alias("names_stay"))
    by_names = by_names.unionByName(bare)
    truncated = carrying.join(s.side("old", "field").where(F.col("type") == TRUNCATED).select(*OP).distinct(), OP, "left_semi").select(*key).distinct().withColumn("truncated", F.lit(True))

    every = gone.select(*key).join(used.select(*key, F.lit(True).alias("used")), key, "left").join(signal, FILE, "left").join(direct.groupBy(*key).agg(F.count(F.lit(1)).alias("n_named")), key, "left")
    every = every.join(by_parents, key, "left").join(by_roots, key, "left").join(by_names, key, "left").join(truncated, key, "left")
    named = F.coalesce("n_named", F.lit(0)) > 0
    return every.select(
        *key,
        F.when(F.col("used").isNull(), F.when(F.col("signal"), "unreachable").otherwise("unmeasurable"))
        .when(~named & F.coalesce("parents_gone", F.lit(False)), "subsumed")
        .when(~named & (F.coalesce("n_live", F.lit(0)) > 0) & F.coalesce("at_parents", F.lit(False)), "relocated")
        .when(named & F.col("n_carrying").isNull(), "subsumed")
        .when(named & F.col("renamed"), "renamed")
        .when(named & F.col("truncated"), "truncated")
        .when(named & F.coalesce("names_stay", F.lit(False)), "relocated")
        .otherwise("").alias("reason"),
    )


#: Reasons that leave a finding standing.
STANDING = ("", "unmeasurable", "truncated")


def schemas(s: Sides, reasons: DataFrame) -> list[DataFrame]:
    """Named schemas and their fields; only what an operation reaches counts, unless the document reaches nothing at all."""
    key, c = [*FILE, "schema"], Changed
    both = s.used("new").select(*key, "in_request", "in_response").unionByName(s.used("old").select(*key, "in_request", "in_response"))
    used = both.groupBy(*key).agg(F.bool_or("in_request").alias("in_request"), F.bool_or("in_response").alias("in_response"))
    linked = s.facts.where("facet = 'root'").select(*FILE).distinct().withColumn("linked", F.lit(True))
    there = s.pairs.where((F.col("facet") == "schema") & c.both).select(*FILE, F.col("key").alias("schema"))
    fields = s.pairs.where("facet = 'schema_field'").withColumn("schema", F.col("part")).join(there, key, "left_semi").join(used, key, "left").join(linked, FILE, "left")
    fields = cut(fields.where("linked is null or in_request is not null").drop("linked"))
    subject = F.concat_ws(".", "schema", "key")
    request, response = F.coalesce("in_request", F.lit(False)), F.coalesce("in_response", F.lit(False))
    lost = fields.where(c.lost).withColumn("leaf", F.col("key"))
    lost = lost.join(survived(s, lost.select(*key, "leaf").distinct()), [*key, "leaf"], "left_anti")
    removed = s.pairs.where((F.col("facet") == "schema") & c.lost).withColumn("schema", F.col("key")).join(reasons.where(F.col("reason").isin(*STANDING)).select(*key), key, "left_semi")
    leaves = s.side("old", "schema_field").groupBy(*FILE, F.col("part").alias("schema")).agg(F.array_sort(F.collect_list("key")).alias("leaves"))
    removed = removed.join(leaves, key, "left").withColumn("leaves", F.coalesce("leaves", F.array().cast("array<string>")))
    of = {"schema": F.col("schema"), "leaves": F.array("key")}
    rule = lambda when, kind, severity, old=None, new=None, rows=fields: _row(rows.where(when), kind, severity, subject, old, new, blurb=F.col("n.note"), **of)
    signature = names.signature(F.col("n.type"), F.col("n.values"), F.col("n.nullable"))
    return [
        _row(removed, "schema_removed", BREAKING, F.col("schema"), F.concat(F.size("leaves"), F.lit(" fields")), "<removed>", schema=F.col("schema"), leaves=F.col("leaves")),
        rule(F.lit(True), "schema_field_removed", F.when(response, BREAKING).otherwise(POTENTIAL), rows=lost),
        rule(c.retyped & ~F.col("o.shape").eqNullSafe(F.col("n.shape")) & (F.col("o.values").isNull() | F.col("n.values").isNull()), "schema_field_type_changed", BREAKING, F.col("o.type"), F.col("n.type")),
        rule(c.fewer, "schema_enum_value_removed", F.when(request, BREAKING).otherwise(POTENTIAL), _shown(_gained("n.values", "o.values"))),
        rule(c.more & response, "schema_enum_value_added", POTENTIAL, None, _shown(_gained("o.values", "n.values"))),
        rule(c.turned("required") & request, "schema_field_now_required", BREAKING),
        rule(c.turned("nullable"), "schema_field_now_nullable", POTENTIAL),
        rule(c.come & F.col("n.required") & request, "schema_field_added_required", BREAKING, None, signature),
        rule(c.come & ~F.col("n.required") & request, "schema_field_added", OPPORTUNITY, None, signature),
        rule(c.come & ~F.col("n.required") & ~request, "response_field_added", OPPORTUNITY, None, signature),
    ]


def siblings(s: Sides, most: int = MOST_OPS) -> DataFrame:
    """(vendor, spec_file, op_key, siblings, n_siblings): other operations of the new side on the same resource, the first `most` of them."""
    ops = s.side("new", "op").select(*OP).withColumn("resource", paths.resource_of(paths.path_of(F.col("op_key"))))
    first = ops.withColumn("_k", F.row_number().over(Window.partitionBy(*FILE, "resource").orderBy("op_key"))).where(F.col("_k") <= most + 1)
    of_resource = first.groupBy(*FILE, "resource").agg(F.array_sort(F.collect_list("op_key")).alias("all")).join(ops.groupBy(*FILE, "resource").agg(F.count(F.lit(1)).alias("n")), [*FILE, "resource"])
    others = F.slice(F.filter("all", lambda x: x != F.col("op_key")), 1, most)
    return ops.join(of_resource, [*FILE, "resource"]).select(*OP, others.alias("siblings"), F.least(F.col("n") - 1, F.lit(most)).alias("n_siblings"))


def finished(s: Sides, raw: DataFrame) -> DataFrame:
    """Rows of FINDING: each finding with its operation, the operations that reach its schema, and a sentence."""
    key = [*FILE, "schema"]
    raw = cut(raw)
    wanted = raw.where("schema is not null").select(*key).distinct()
    sides = s.used("new").withColumn("_rank", F.lit(0)).unionByName(s.used("old").withColumn("_rank", F.lit(1))).join(wanted, key, "left_semi")
    ops = cut(s.reach("new", wanted).withColumn("_rank", F.lit(0)).unionByName(s.reach("old", wanted).withColumn("_rank", F.lit(1))))
    numbers = ops.groupBy(*key, "_rank").agg(F.count(F.lit(1)).alias("n_ops"), F.count_if(F.col("hops") <= 2).alias("n_direct"))
    used = sides.join(numbers, [*key, "_rank"], "left").groupBy(*key).agg(*[F.min_by(x, "_rank").alias(x) for x in ("in_request", "in_response", "n_ops", "n_direct")], F.min("_rank").alias("_rank"))
    ops = ops.select(*key, "_rank", "op_key").withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_rank").orderBy("op_key"))).where(F.col("_k") <= MOST_OPS)
    ops = ops.groupBy(*key, "_rank").agg(F.array_sort(F.collect_list("op_key")).alias("reached"))
    used = used.join(ops, [*key, "_rank"], "left").drop("_rank")
    file_ops = s.side("new", "op").select(*OP).withColumn("_k", F.row_number().over(Window.partitionBy(*FILE).orderBy("op_key"))).where(F.col("_k") <= MOST_OPS)
    added = raw.where("kind = 'spec_added'").select(*FILE).join(file_ops, FILE).groupBy(*FILE).agg(F.array_sort(F.collect_list("op_key")).alias("in_file"))
    added = added.join(s.files.select(*FILE, "n_new"), FILE)
    ids = s.facts.where("facet = 'op'").groupBy(*OP).agg(F.min_by(F.col("key"), F.col("side")).alias("operation_id"))
    near = siblings(s).join(raw.where("kind = 'endpoint_added'").select(*OP), OP, "left_semi")
    full = raw.join(used, key, "left").join(ids, OP, "left").join(near, OP, "left").join(added.withColumn("kind", F.lit("spec_added")), [*FILE, "kind"], "left")
    own = F.when(F.col("op_key") != "", F.array("op_key")).otherwise(F.array().cast("array<string>"))
    affected = F.coalesce("siblings", "in_file", "reached", own)
    shown = F.coalesce(F.when(F.col("op_key") != "", F.col("op_key")), F.get(affected, F.lit(0)), F.lit(""))
    number = F.coalesce("n_siblings", "n_new", "n_ops", F.size(own)).cast("long")
    path = paths.path_of(shown)
    change = F.when((F.col("old") != "") & (F.col("new") != ""), F.concat(F.lit(": "), "old", F.lit(" -> "), "new")).when(F.col("old") != "", F.concat(F.lit(": "), "old")).when(F.col("new") != "", F.concat(F.lit(": "), "new")).otherwise("")
    have = {
        "path": path, "method": F.lower(F.split_part(shown, F.lit(" "), F.lit(1))), "operation_id": F.coalesce("operation_id", F.lit("")), "detail": F.concat(names.label(F.col("kind")), F.lit(" `"), "subject", F.lit("`"), change),
        "occurrences": F.when(F.col("kind") == "schema_removed", F.greatest(number, F.lit(1))).otherwise(1).cast("long"), "affected_op_count": number, "direct_op_count": F.coalesce("n_direct", F.lit(0)).cast("long"),
        "affected_ops": affected, "in_request": F.coalesce("in_request", F.lit(False)), "in_response": F.coalesce("in_response", F.lit(False)), "resource": paths.resource_of(path),
    }
    return full.select(*[have.get(c, F.col(c)).alias(c) for c in FINDING])


def analyse(facts: DataFrame) -> Drift:
    """Findings of all rules, and what was suppressed."""
    s = Sides(facts)
    reasons = cut(removal_reasons(s))
    families = [*files_and_operations(s), *parameters(s), *body_fields(s), *statuses(s), *security(s), *servers(s), *schemas(s, reasons)]
    suppressed = reasons.where("reason <> ''").groupBy(*FILE, "reason").agg(F.count(F.lit(1)).alias("n"))
    return Drift(finished(s, reduce(DataFrame.unionByName, families)), suppressed)


def findings(facts: DataFrame) -> DataFrame:
    """Rows of FINDING."""
    return analyse(facts).findings


#: Kinds that are one change seen from a schema, a request or a response.
KIND_CLASS = {
    **dict.fromkeys(["schema_field_removed", "response_field_removed", "request_field_removed"], "field_removed"),
    **dict.fromkeys(["schema_field_type_changed", "response_field_type_changed", "request_field_type_changed"], "field_type_changed"),
    **dict.fromkeys(["schema_field_now_required", "request_field_now_required"], "field_now_required"),
    **dict.fromkeys(["schema_field_added_required", "request_field_added_required"], "field_added_required"),
    **dict.fromkeys(["schema_enum_value_removed", "request_enum_value_removed", "response_enum_value_removed"], "enum_value_removed"),
    **dict.fromkeys(["schema_enum_value_added", "response_enum_value_added"], "enum_value_added"),
    **dict.fromkeys(["schema_field_now_nullable", "response_field_now_nullable"], "field_now_nullable"),
}


def kind_class(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_CLASS.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), kind)


def collapsed(rows: DataFrame) -> DataFrame:
    """One finding for each vendor, class of kinds and root cause: the one seen from a schema, else of the shortest subject; with how many there were and the operations of all."""
    keys = ["vendor", "kind_class", "root_cause"]
    rows = rows.withColumn("kind_class", kind_class(F.col("kind")))
    by_schema = F.col("kind").startswith("schema_") & (F.col("kind") != F.col("kind_class"))
    keep = [c for c in FINDING if c not in ("vendor", "root_cause", "affected_ops")]
    ops = rows.select(*keys, F.explode(F.concat("affected_ops", F.when(F.col("op_key") != "", F.array("op_key")).otherwise(F.array().cast("array<string>")))).alias("op")).where("op <> ''")
    out = collapsing.representatives(rows, keys, [~by_schema, F.length("subject"), F.col("op_key"), F.col("spec_file"), F.col("subject"), F.col("kind")], keep, {"n": F.count(F.lit(1)), "most_ops": F.max("affected_op_count"), "direct": F.max("direct_op_count")})
    out = out.join(collapsing.first_distinct(ops, keys, "op", MOST_OPS), keys, "left")
    n_ops = F.greatest(F.coalesce("n_distinct", F.lit(0)), "most_ops")
    tail = F.when(F.col("direct") > 1, F.concat(F.lit(", directly in "), "direct", F.lit(" operations"))).when(n_ops > 1, F.concat(F.lit(", in "), n_ops, F.lit(" operations"))).when(F.col("n") > 1, F.concat(F.lit(", reached in "), "n", F.lit(" ways"))).otherwise("")
    have = {
        "occurrences": F.greatest("n", "occurrences"), "affected_op_count": n_ops, "direct_op_count": F.col("direct"), "affected_ops": F.coalesce("firsts", F.array().cast("array<string>")), "detail": F.concat("detail", tail),
    }
    return out.select(*[have.get(c, F.col(c)).alias(c) for c in FINDING])


def severity_rank(severity: Column) -> Column:
    return F.when(severity == BREAKING, 0).when(severity == POTENTIAL, 1).otherwise(2)


def ordered(rows: DataFrame) -> DataFrame:
    """Findings as a report lists them."""
    return rows.orderBy(severity_rank(F.col("severity")), "spec_file", "path", "method", "kind", "subject")


def roll_up(facts: DataFrame, found: DataFrame, groups: DataFrame) -> DataFrame:
    """Per vendor: operations on each side and on both, findings before and after collapsing, by severity."""
    ops = facts.where("facet = 'op'").groupBy(*OP).agg(F.bool_or(F.col("side") == "old").alias("o"), F.bool_or(F.col("side") == "new").alias("n"))
    ops = ops.groupBy("vendor").agg(F.count_if("o").alias("ops_old"), F.count_if("n").alias("ops_new"), F.count_if(F.col("o") & F.col("n")).alias("ops_both"))
    raw = found.groupBy("vendor").agg(F.count(F.lit(1)).alias("raw_findings"))
    by = groups.groupBy("vendor").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == x).alias(x) for x in (BREAKING, POTENTIAL, OPPORTUNITY)])
    counts = ["raw_findings", "findings", BREAKING, POTENTIAL, OPPORTUNITY]
    return ops.join(raw, "vendor", "left").join(by, "vendor", "left").select("vendor", "ops_old", "ops_new", "ops_both", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
