"""What a payload may look like, alternative by alternative, and what all of them promise.

An alternative is a type, the names of its properties and the values that some of these are pinned
to. oneOf and anyOf list alternatives; allOf is one thing, so its arms' alternatives are combined,
each with each. Schemas are worked off from the innermost outward, a round for each height. Two sets
are kept for a schema: `all_`, every alternative once, to ask whether one is still presented, and
`least`, the antichain of name sets that contain no other, to ask what is promised: each round
prunes it by containment. A schema with more than MOST alternatives, or that contains itself by
composition, is `undecided`: its sets are null, and so is everything asked of them.

Edge cases: an arm of type null is no alternative; a union whose typed node only lists constants or
enums is a plain value; an object without properties is an alternative without names; arms that
refer to nothing, of a union or of allOf, are left out; an empty table gives no rows.

Skew: a row is a schema with at most MOST alternatives; a schema that many refer to is looked up by
joins keyed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.obligations import links
from quillstone.plans.shapes import SCHEMA, UNIONS, Graph
from quillstone.sources.nodes import DOC
from quillstone.sources.scratch import cut, forget

#: Alternatives of one schema beyond which it is undecided.
MOST = 64
ALTERNATIVE = "struct<type:string,names:array<string>,pins:array<struct<name:string,values:array<string>>>>"
NAMES = "array<array<string>>"


def _combined(a: Column, b: Column) -> Column:
    """One alternative of both; the first type that is known, the second's pins where both pin a name."""
    pinned = F.transform(b["pins"], lambda p: p["name"])
    pins = F.array_sort(F.concat(F.filter(a["pins"], lambda p: ~F.array_contains(pinned, p["name"])), b["pins"]))
    return F.struct(F.coalesce(a["type"], b["type"]).alias("type"), F.array_sort(F.array_union(a["names"], b["names"])).alias("names"), pins.alias("pins"))


def _bounded(sets: Column) -> Column:
    return F.when(F.size(sets) <= MOST, sets)


def antichain(sets: Column) -> Column:
    """The sets that contain no other of them."""
    once = F.array_distinct(sets)
    return F.filter(once, lambda x: ~F.exists(once, lambda y: (F.size(y) < F.size(x)) & (F.size(F.array_except(y, x)) == 0)))


def _types(words: DataFrame) -> DataFrame:
    """words with what type a schema has, from its keywords where none is named."""
    named = F.when(F.size("types") > 0, F.coalesce(F.get(F.filter("types", lambda t: t != "null"), F.lit(0)), F.lit("null"))).otherwise(F.col("type"))
    seen = F.when(F.col("has_properties_") | F.col("has_allOf"), "object").when(F.col("has_items"), "array").when(F.col("has_oneOf"), "oneOf").when(F.col("has_anyOf"), "anyOf").otherwise("any")
    return words.withColumn("has_properties_", F.col("has_names")).withColumn("stands", F.coalesce(named, F.when(F.col("has_properties_"), "object").when(F.col("has_items") & ~F.col("has_allOf"), "array").otherwise(seen))).drop("has_properties_")


def alternatives(graph: Graph) -> DataFrame:
    """file, side, schema, all_ (array of ALTERNATIVE), least (array of sets of names) and undecided; a table of its own."""
    words = _types(graph.words)
    # what properties are pinned to: constants or enums, through references
    pinned = graph.through(graph.lines.where("role = 'property'").select(*SCHEMA, "name", F.col("child").alias("at")), "at")
    values = words.select(*DOC, F.col("schema").alias("at"), F.when(F.col("constant").isNotNull(), F.array("constant")).when(F.size("values") > 0, F.col("values")).alias("v")).where("v IS NOT NULL")
    pins = pinned.join(values, [*DOC, "at"]).groupBy(*SCHEMA).agg(F.array_sort(F.collect_list(F.struct("name", F.col("v").alias("values")))).alias("pins"))
    no_pins = F.array().cast("array<struct<name:string,values:array<string>>>")
    own = words.join(pins, SCHEMA, "left").select(*SCHEMA, "stands", "names", F.coalesce("pins", no_pins).alias("pins"), "type", "types", F.col("ref").isNotNull().alias("is_ref"), "has_allOf", "has_oneOf", "has_anyOf")

    composed = links(graph)
    # of two unions in one schema the first counts
    both = words.where("has_oneOf").select(*SCHEMA, F.lit("anyOf").alias("role"))
    composed = composed.join(both, [*SCHEMA, "role"], "left_anti")
    # arms: null ones are no payload; a typed union of constants is a plain value
    facts = words.select(*DOC, F.col("schema").alias("at"), F.col("stands").alias("arm_stands"), (F.col("constant").isNotNull() | (F.size("values") > 0)).alias("arm_pinned"), (F.col("has_names") | F.col("has_items")).alias("arm_holds"))
    arms = graph.through(composed.where(F.col("role").isin(*UNIONS)).select(*SCHEMA, "role", "child", F.col("child").alias("at")), "at").join(facts, [*DOC, "at"], "left")
    plain = arms.groupBy(*SCHEMA).agg(F.bool_and(F.coalesce(F.col("arm_pinned") & ~F.col("arm_holds"), F.lit(False))).alias("plain")).where("plain")
    plain = cut(plain.join(words.where("type IS NOT NULL").select(*SCHEMA), SCHEMA, "left_semi").select(*SCHEMA))
    nulls = arms.where("arm_stands = 'null'").select(*SCHEMA, "role", "child")
    objects = graph.words.select(*DOC, F.col("schema").alias("child"))
    lines = cut(composed.join(plain, SCHEMA, "left_anti").join(nulls, [*SCHEMA, "role", "child"], "left_anti").join(objects, [*DOC, "child"], "left_semi"))
    fans = lines.groupBy(*SCHEMA).agg(F.count(F.lit(1)).alias("n"))
    waiting = cut(own.join(fans, SCHEMA, "left").withColumn("n", F.coalesce("n", F.lit(0))))

    alone = lambda: F.struct(F.col("stands").alias("type"), "names", "pins").cast(ALTERNATIVE)
    # a reference to nothing, or a union of null alone, has no alternative
    empty = (F.col("is_ref") | ((F.col("has_oneOf") | F.col("has_anyOf")))) & (F.col("n") == 0)
    is_plain = plain.withColumn("is_plain", F.lit(True))
    start = waiting.where("n = 0").join(is_plain, SCHEMA, "left")
    none, no_sets = F.array().cast(f"array<{ALTERNATIVE}>"), F.array().cast(NAMES)
    gone = empty & F.col("is_plain").isNull()
    done = cut(start.select(*SCHEMA, F.when(gone, none).otherwise(F.array(alone())).alias("all_"), F.when(gone, no_sets).otherwise(F.array("names")).alias("least"), F.lit(False).alias("undecided")))
    held = [done]
    left = cut(waiting.where("n > 0"))
    forget(waiting)
    while True:
        below = lines.join(left.select(*SCHEMA), SCHEMA, "left_semi").join(done.select(*DOC, F.col("schema").alias("child"), F.struct("all_", "least", "undecided").alias("w")), [*DOC, "child"])
        met = below.groupBy(*SCHEMA).agg(F.count(F.lit(1)).alias("ready"), F.bool_or("w.undecided").alias("unknown"), F.array_sort(F.collect_list(F.struct("role", "child", F.col("w.all_").alias("all_"), F.col("w.least").alias("least")))).alias("w"))
        now = left.join(met, SCHEMA).where("ready = n")
        arms_of = lambda *roles: F.filter("w", lambda x: x["role"].isin(*roles))
        # the arms of allOf, each alternative with each, then the union's, or the reference's
        one = F.array(F.struct(F.when(F.col("type").isNotNull() | (F.size("types") > 0), F.col("stands")).alias("type"), "names", "pins").cast(ALTERNATIVE))

        def times(sets: Column, more: Column) -> Column:
            # of more than MOST times MOST combinations none is made: the sets before are bounded
            return _bounded(F.array_distinct(F.flatten(F.transform(sets, lambda a: F.transform(more, lambda b: _combined(a, b))))))

        def times_names(sets: Column, more: Column) -> Column:
            return _bounded(antichain(F.flatten(F.transform(sets, lambda a: F.transform(more, lambda b: F.array_sort(F.array_union(a, b)))))))

        folded = F.aggregate(arms_of("allOf"), one, lambda acc, x: F.when(acc.isNull() | (F.size(x["all_"]) == 0), acc).otherwise(times(acc, x["all_"])))
        folded_names = F.aggregate(arms_of("allOf"), F.array("names"), lambda acc, x: F.when(acc.isNull() | (F.size(x["least"]) == 0), acc).otherwise(times_names(acc, x["least"])))
        union = F.array_distinct(F.flatten(F.transform(arms_of(*UNIONS), lambda x: x["all_"])))
        union_names = antichain(F.flatten(F.transform(arms_of(*UNIONS), lambda x: x["least"])))
        is_union = F.col("has_oneOf") | F.col("has_anyOf")
        from_ref = F.get(arms_of("ref"), F.lit(0))
        everything = F.when(F.col("is_ref"), from_ref["all_"]).when(is_union, _bounded(union)).otherwise(F.transform(folded, lambda a: F.struct(F.coalesce(a["type"], F.lit("object")).alias("type"), a["names"].alias("names"), a["pins"].alias("pins"))))
        least = F.when(F.col("is_ref"), from_ref["least"]).when(is_union, _bounded(union_names)).otherwise(folded_names)
        step = cut(now.select(*SCHEMA, "unknown", everything.alias("all_"), least.alias("least")).select(*SCHEMA, F.when(~F.col("unknown"), F.col("all_")).alias("all_"), F.when(~F.col("unknown"), F.col("least")).alias("least"), (F.col("unknown") | F.col("all_").isNull() | F.col("least").isNull()).alias("undecided")))
        held.append(step)
        if step.isEmpty():
            break
        done = done.unionByName(step)
        after = cut(left.join(step.select(*SCHEMA), SCHEMA, "left_anti"))
        forget(left)
        left = after
    # what waits for itself is undecided
    stuck = left.select(*SCHEMA, F.lit(None).cast(f"array<{ALTERNATIVE}>").alias("all_"), F.lit(None).cast(NAMES).alias("least"), F.lit(True).alias("undecided"))
    out = cut(done.unionByName(stuck))
    forget(left, lines, plain, *held)
    return out


def promised(least: Column) -> Column:
    """Names that every alternative holds; none where there is no alternative, null where undecided."""
    first = F.get(least, F.lit(0))
    return F.when(F.size(least) > 0, F.aggregate(least, first, lambda acc, x: F.array_intersect(acc, x))).when(least.isNotNull(), F.array().cast("array<string>"))


def presents(new: Column, old: Column) -> Column:
    """Whether one of the alternatives `new` delivers all that the alternative `old` does: its type, its names, and for a name that both pin, all of its values; null where undecided."""

    def pins_hold(a: Column) -> Column:
        return F.forall(old["pins"], lambda p: F.forall(F.filter(a["pins"], lambda q: q["name"] == p["name"]), lambda q: F.size(F.array_except(p["values"], q["values"])) == 0))

    return F.exists(new, lambda a: (a["type"] == old["type"]) & (F.size(F.array_except(old["names"], a["names"])) == 0) & pins_hold(a))
