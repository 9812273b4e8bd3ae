"""Which schemas are the same throughout, circles included: partition refinement on the schema graph.

All schemas start in classes by what they say themselves; each round splits a class by the classes of
what its members are made of, references seen through, until a round splits none. Two schemas that
end in one class unfold to the same tree, however deep, and however it is cut into named ones. Arms
count as a set, properties by name. Classes are 128-bit digests, so sides and files can be compared.

Edge cases: a reference to nothing, or only to itself, is a class of its own kind; schemas without
keywords are one class; annotations do not count; no schemas, no classes.

Skew: a round joins edges with the class of their child, keyed by (file, side, place): a schema that
all others name is one row there. The rounds are as many as the longest path that tells two apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.shapes import SCHEMA, Graph
from quillstone.sources.nodes import DOC
from quillstone.sources.scratch import cut, forget

SAYS = ["type", "types", "values", "names", "required", "nullable", "closed", "constant", "has_allOf", "has_oneOf", "has_anyOf", "has_items"]


def classes(graph: Graph) -> DataFrame:
    """file, side, schema, class of every schema; a table of its own."""
    lines = cut(graph.through(graph.lines.select(*SCHEMA, "role", "name", "child"), "child"))
    said = F.when(F.col("ref").isNotNull(), F.md5(F.lit("reference"))).otherwise(F.md5(F.to_json(F.struct(*SAYS), {"ignoreNullFields": "false"})))
    found = cut(graph.words.select(*SCHEMA, said.alias("class")))
    start, n = found, found.agg(F.count_distinct("class")).first()[0]
    while True:
        below = lines.join(found.select(*DOC, F.col("schema").alias("child"), F.col("class").alias("of")), [*DOC, "child"], "left")
        part = F.to_json(F.struct("role", "name", F.coalesce("of", F.lit("none")).alias("of")))
        made = below.groupBy(*SCHEMA).agg(F.array_join(F.array_sort(F.collect_set(part)), ",").alias("made"))
        # its class of before stays part of it: classes only split
        after = cut(found.join(made, SCHEMA, "left").select(*SCHEMA, F.md5(F.concat("class", F.coalesce("made", F.lit("")))).alias("class")))
        forget(found)
        now = after.agg(F.count_distinct("class")).first()[0]
        found, before, n = after, n, now
        if now == before:
            break
    # who refers to a schema is the same as it
    to = graph.ends.where("kind = 'object'").select(*DOC, F.col("site").alias("schema"), F.col("path").alias("end"))
    ends = found.select(*DOC, F.col("schema").alias("end"), F.col("class").alias("of"))
    out = cut(found.join(to, SCHEMA, "left").join(ends, [*DOC, "end"], "left").select(*SCHEMA, F.coalesce("of", "class").alias("class")))
    forget(lines, start, found)
    return out
