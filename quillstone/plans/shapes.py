"""What a value that a schema describes looks like to its reader, folded bottom-up from a node table.

The lattice keeps apart `any` (the document says that every value will do), `unresolved` (its
keywords say nothing that is understood here) and `opaque` (deeper than asked for, or no schema);
`unknown-ref` is a reference to nothing. The last three admit ignorance: they equal nothing, and
differ from nothing. allOf is one schema that merges its arms; references, nullability, items and
the arms of unions cost one level each.

A round computes all shapes one level deeper from those of the round before, by one join along the
edges of the schema graph; DEPTH rounds do. Merging allOf takes as many rounds as allOf are nested.

Edge cases: arms of allOf that lead nowhere, or around in a circle, count as unresolved arms and add
nothing; keywords of the node itself win over those of its arms, arms over later ones; an array
without items holds anything; a union without arms has none; enum values come sorted as text.

Skew: rows are edges of a document's schemas; a schema that all others refer to is one row on the
side that is looked up, and its many users are rows keyed by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.nodes import DOC, followed, references
from quillstone.sources.scratch import cut, forget

#: Fixed value: levels below a schema that its shape shows.
DEPTH = 3
ANY, UNRESOLVED, OPAQUE, UNKNOWN = "any", "unresolved", "opaque", "unknown-ref"
#: Keywords that say nothing about the value.
ANNOTATIONS = ["title", "description", "example", "examples", "deprecated", "readOnly", "writeOnly", "externalDocs", "xml", "default", "$comment"]
UNIONS = ["oneOf", "anyOf"]
SCHEMA = [*DOC, "schema"]


def informative(shape: Column) -> Column:
    """Whether a shape says something that another can be compared with."""
    return shape.isNotNull() & ~shape.isin(UNRESOLVED, OPAQUE, UNKNOWN)


def keywords(nodes: DataFrame) -> DataFrame:
    """What every object says about itself as a schema: file, side, schema, ref, type, values (enum), names (of properties), required, nullable, closed, says (more than annotations and allOf) and says_more (than these and nullable), constant, title, and which composing keywords it has."""
    own = nodes.where("not listed and key is not null").select(
        *DOC, F.col("parent").alias("schema"), "key", "kind", "text", "path", F.lit("own").alias("of"),
    )
    within = nodes.where(F.col("above").isin("properties", "required", "enum", "type") & (F.col("listed") == (F.col("above") != "properties"))).select(
        *DOC, F.col("grand").alias("schema"), "key", "kind", "text", "path", F.col("above").alias("of"),
    )
    is_own, key, kind, text, of = F.col("of") == "own", F.col("key"), F.col("kind"), F.col("text"), F.col("of")
    only = lambda when, value=text: F.max(F.when(when, value))
    has = lambda *names: F.coalesce(F.bool_or(is_own & key.isin(*names)), F.lit(False))
    listed = lambda name, value=text: F.sort_array(F.collect_set(F.when(of == name, value)))
    all_ = own.unionByName(within).groupBy(*SCHEMA).agg(
        only(is_own & (key == "$ref") & (kind == "string")).alias("ref"), only(is_own & (key == "type") & (kind == "string")).alias("one_type"), listed("type").alias("types"), listed("enum").alias("values"),
        listed("properties", key).alias("names"), listed("required", F.when(kind == "string", text)).alias("required"), has("properties").alias("has_names"), has("enum").alias("has_values"),
        F.coalesce(F.bool_or(is_own & (key == "nullable") & (text == "true")), F.lit(False)).alias("nullable"), F.coalesce(F.bool_or(is_own & (key == "additionalProperties") & (text == "false")), F.lit(False)).alias("closed"),
        F.coalesce(F.bool_or(is_own & ~key.isin(*ANNOTATIONS, "allOf")), F.lit(False)).alias("says"), F.coalesce(F.bool_or(is_own & ~key.isin(*ANNOTATIONS, "allOf", "nullable")), F.lit(False)).alias("says_more"),
        only(is_own & (key == "const") & ~kind.isin("object", "array")).alias("constant"), only(is_own & (key == "title")).alias("title"), *[has(k).alias(f"has_{k}") for k in ("allOf", *UNIONS, "items")],
    )
    kind_ = F.when(F.size("types") > 0, F.concat(F.lit("["), F.array_join("types", ","), F.lit("]"))).otherwise(F.col("one_type"))
    # an object without any keyword is a schema too
    empty = nodes.where("kind = 'object'").select(*DOC, F.col("path").alias("schema"))
    out = empty.join(all_, SCHEMA, "left").withColumn("type", kind_)
    flags = [c for c, t in out.dtypes if t == "boolean"]
    lists = ["values", "names", "required", "types"]
    none = F.array().cast("array<string>")
    return out.select(*SCHEMA, "ref", "type", "constant", "title", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], *[F.coalesce(c, none).alias(c) for c in lists])


def edges(nodes: DataFrame) -> DataFrame:
    """file, side, schema, role (property, items, allOf, oneOf, anyOf), name, place, child: which schema is made of which."""
    kept = [*DOC]
    inside = nodes.where("above = 'properties' and not listed").select(*kept, F.col("grand").alias("schema"), F.lit("property").alias("role"), F.col("key").alias("name"), "place", F.col("path").alias("child"))
    arms = nodes.where(F.col("above").isin("allOf", *UNIONS) & F.col("listed")).select(*kept, F.col("grand").alias("schema"), F.col("above").alias("role"), F.lit("").alias("name"), "place", F.col("path").alias("child"))
    items = nodes.where("key = 'items' and not listed").select(*kept, F.col("parent").alias("schema"), F.lit("items").alias("role"), F.lit("").alias("name"), F.lit(0).alias("place"), F.col("path").alias("child"))
    return inside.unionByName(arms).unionByName(items)


class Graph:
    """The schemas of a node table: words (keywords), lines (edges), refs and ends (where references lead), tables that are kept until close()."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self.refs = cut(references(nodes))
        self.ends = followed(nodes, self.refs)
        self.words = cut(keywords(nodes))
        self.lines = cut(edges(nodes))

    def through(self, places: DataFrame, column: str) -> DataFrame:
        """places with `column` replaced by where its references lead; what is no reference stays."""
        to = self.ends.where("kind = 'object'").select(*DOC, F.col("site").alias(column), F.col("path").alias("_end"))
        return places.join(to, [*DOC, column], "left").withColumn(column, F.coalesce("_end", column)).drop("_end")

    def close(self) -> None:
        forget(self.refs, self.ends, self.words, self.lines)


def merged(graph: Graph) -> DataFrame:
    """words with what the arms of allOf add, and lines of the merged schemas (role, place, child) as a column; a table of its own.

    Rounds go from the innermost allOf outward: a schema is merged once all its arms are.
    """
    roles = F.struct("role", "place", "child")
    own_lines = graph.lines.where(F.col("role").isin("items", *UNIONS)).groupBy(*SCHEMA).agg(F.collect_list(roles).alias("kids"))
    no_kids = F.array().cast("array<struct<role:string,place:int,child:string>>")
    base = cut(graph.words.join(own_lines, SCHEMA, "left").withColumn("kids", F.coalesce("kids", no_kids)))
    arms = cut(graph.through(graph.lines.where("role = 'allOf'").select(*SCHEMA, "place", F.col("child").alias("arm")), "arm"))
    done = base.where("not has_allOf")
    waiting = cut(base.where("has_allOf"))
    rounds = []
    while True:
        # arms that are no schema, or still a reference, add nothing and hold nobody up
        about = base.select(*DOC, F.col("schema").alias("arm"), F.col("has_allOf").alias("nested"))
        ready = done.where("ref IS NULL").select(*DOC, F.col("schema").alias("arm"), F.struct("type", "values", "has_values", "names", "has_names", "required", "nullable", "kids", *[f"has_{k}" for k in (*UNIONS, "items")]).alias("w"))
        said = arms.join(waiting.select(*SCHEMA), SCHEMA, "left_semi").join(about, [*DOC, "arm"], "left").join(ready, [*DOC, "arm"], "left")
        first = lambda has, value: F.min_by(F.when(has, value), F.when(has, F.col("place")))
        kids_of = lambda role: F.filter("w.kids", lambda k: k["role"] == role)
        summed = said.groupBy(*SCHEMA).agg(
            F.bool_or(F.coalesce(F.col("nested"), F.lit(False)) & F.col("w").isNull()).alias("open"), first(F.col("w.type").isNotNull(), F.col("w.type")).alias("a_type"), first(F.col("w.has_values"), F.col("w.values")).alias("a_values"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("w.names")))).alias("a_names"), F.coalesce(F.bool_or("w.has_names"), F.lit(False)).alias("a_has_names"), F.flatten(F.collect_list("w.required")).alias("a_required"),
            F.coalesce(F.bool_or("w.nullable"), F.lit(False)).alias("a_nullable"), *[first(F.col(f"w.has_{k}"), kids_of(k)).alias(f"a_{k}") for k in (*UNIONS, "items")],
        )
        now = waiting.join(summed, SCHEMA, "left").where("not coalesce(open, false)")
        none = F.array().cast("array<string>")
        kids = F.col("kids")
        for k in (*UNIONS, "items"):
            kids = F.when(F.col(f"has_{k}"), kids).otherwise(F.concat(kids, F.coalesce(f"a_{k}", no_kids)))
        have = {
            "type": F.coalesce("type", "a_type"), "values": F.when(F.col("has_values"), F.col("values")).otherwise(F.coalesce("a_values", none)), "has_values": F.col("has_values") | F.col("a_values").isNotNull(),
            "names": F.array_sort(F.array_union("names", F.coalesce("a_names", none))), "has_names": (F.size("names") + F.size(F.coalesce("a_names", none))) > 0, "required": F.array_sort(F.array_union("required", F.coalesce("a_required", none))),
            "nullable": F.col("nullable") | F.coalesce("a_nullable", F.lit(False)), "kids": kids, **{f"has_{k}": F.col(f"has_{k}") | F.col(f"a_{k}").isNotNull() for k in (*UNIONS, "items")},
        }
        # keywords that came from the arms count; allOf itself is gone, but for an empty one
        more = F.col("says_more") | F.col("alone") | F.col("type").isNotNull() | F.col("has_values") | F.col("has_names") | F.col("has_items") | F.col("has_oneOf") | F.col("has_anyOf") | F.col("ref").isNotNull() | (F.size("required") > 0)
        step = now.select(*[have.get(c, F.col(c)).alias(c) for c in base.columns], F.col("open").isNull().alias("alone")).withColumn("says_more", more).withColumn("says", F.col("says") | F.col("says_more") | F.col("nullable"))
        step = cut(step.drop("alone"))
        rounds.append(step)
        if step.isEmpty():
            break
        done = done.unionByName(step)
        left = cut(waiting.join(step.select(*SCHEMA), SCHEMA, "left_anti"))
        forget(waiting)
        waiting = left
    # what is left merges itself: it says nothing that can be read
    stuck = waiting.withColumn("says", F.lit(True)).withColumn("says_more", F.lit(True)).withColumn("type", F.lit(None).cast("string")).withColumn("has_values", F.lit(False)).withColumn("has_names", F.lit(False)).withColumn("kids", no_kids)
    out = cut(done.unionByName(stuck.select(*base.columns)))
    forget(base, arms, waiting, *rounds)
    return out


def shapes(graph: Graph, depth: int = DEPTH) -> DataFrame:
    """file, side, schema, shape of every object read as a schema; a table of its own."""
    words = merged(graph)
    is_array = F.coalesce(F.col("type") == "array", F.lit(False)) & ~F.col("has_names")
    # one child for the reference, else items or arms; who has properties has no child that shows
    kids = words.where("ref IS NULL AND NOT has_names").select(*SCHEMA, is_array.alias("is_array"), "has_oneOf", F.explode("kids").alias("k")).select("*", "k.*").drop("k")
    kids = kids.where(F.when(F.col("is_array"), F.col("role") == "items").when(F.col("has_oneOf"), F.col("role") == "oneOf").otherwise(F.col("role") == "anyOf"))
    direct = graph.refs.where("form = 'ref'").select(*DOC, F.col("site").alias("schema"), F.lit("ref").alias("role"), F.col("target").alias("child"))
    lines = cut(kids.select(*SCHEMA, "role", "child").unionByName(direct))
    arms, none = F.col("arms"), F.array().cast("array<string>")

    def plain(below: bool) -> Column:
        """The shape, nullable or not left aside."""
        items = F.when(F.col("has_items"), F.coalesce("items", F.lit(OPAQUE))).otherwise(ANY if below else OPAQUE)
        union = F.concat(F.when(F.col("has_oneOf"), "oneOf(").otherwise("anyOf("), F.array_join(F.coalesce(arms, none), "|"), F.lit(")"))
        scalar = F.concat(F.lit("scalar("), F.coalesce("type", F.lit("")), F.when(F.size("values") > 0, F.concat(F.lit(";"), F.array_join("values", ","))).otherwise(""), F.lit(")"))
        return (
            F.when(F.col("ref").isNotNull(), F.coalesce("to", F.lit(UNKNOWN))).when(F.col("has_names"), F.concat(F.lit("object("), F.array_join("names", ","), F.lit(")"))).when(is_array, F.concat(F.lit("array("), items, F.lit(")")))
            .when(F.col("has_oneOf") | F.col("has_anyOf"), union).when(F.col("type").isNull() & (F.size("values") == 0), UNRESOLVED).otherwise(scalar)
        )

    held, bare, full = [words, lines], None, None
    objects = words.select(*DOC, F.col("schema").alias("child"))
    for level in range(depth + 1):
        if level:
            shown = full.select(*DOC, F.col("schema").alias("child"), "shape")
        else:
            shown = objects.withColumn("shape", F.lit(OPAQUE))
        met = lines.join(shown, [*DOC, "child"], "left").withColumn("shape", F.when(F.col("role") == "ref", F.col("shape")).otherwise(F.coalesce("shape", F.lit(OPAQUE))))
        met = met.groupBy(*SCHEMA).agg(
            F.max(F.when(F.col("role") == "ref", F.col("shape"))).alias("to"), F.max(F.when(F.col("role") == "items", F.col("shape"))).alias("items"),
            F.array_sort(F.collect_list(F.when(F.col("role").isin(*UNIONS), F.col("shape")))).alias("arms"),
        )
        found = words.join(met, SCHEMA, "left").withColumn("bare", F.when(~F.col("says_more"), ANY).otherwise(plain(level > 0)))
        if level:
            found = found.join(bare.select(*SCHEMA, F.col("bare").alias("inner")), SCHEMA)
        else:
            found = found.withColumn("inner", F.lit(OPAQUE))
        shape = F.when(~F.col("says"), ANY).when(F.col("nullable"), F.concat(F.lit("nullable("), "inner", F.lit(")"))).otherwise(F.when(F.col("says_more"), F.col("bare")).otherwise(UNRESOLVED))
        full = bare = cut(found.select(*SCHEMA, "bare", shape.alias("shape")))
        held.append(full)
    forget(*held[:-1])
    return full
