"""JSON documents as a table of their nodes: places, containment by intervals, references.

Spark reads a document (file, side) once into a variant, which settles what is JSON, how numbers are
written and the order of keys (by code point), and writes it out; one pass over that text in a task
then makes all nodes of it, so no rows are moved or written level by level. A node's place is its
JSON pointer; `entry` and `exit` are numbers of a depth-first walk of the document: a node holds
those whose entry lies between its entry and exit. `digest` is the same for equal values, whatever
the order of keys.

Edge cases: a body that is null or no JSON (or has a key twice) is one node of kind "unreadable"; a
scalar body is one node; null scalars are nodes of kind "null"; empty containers have no children;
keys with / and ~ are escaped in pointers; repeated documents of one (file, side) count once; an
empty table gives no nodes; other columns are ignored.

Skew: rows are made where the document lies, and a document is at most one variant (Spark's limit).
Joins below are by (file, side, place), which is unique, or by a target within a document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.scratch import cut, forget

DOC = ["file", "side"]
#: Columns of a node, beside its document.
KINDS = {
    "path": pa.string(), "parent": pa.string(), "grand": pa.string(), "key": pa.string(), "above": pa.string(), "place": pa.int32(), "listed": pa.bool_(), "depth": pa.int32(), "kind": pa.string(), "text": pa.string(), "digest": pa.string(),
    "entry": pa.int64(), "exit": pa.int64(),
}
NODE = [*DOC, *KINDS]
#: Hops along references; a chain that goes on is unresolved.
HOPS = 8
#: Documents and bytes that reach a Python worker at once: long texts do not pile up there.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: What stands for a body that is no JSON, and the kinds of values by their first byte.
UNREADABLE = b"?"
KIND = ["number", "object", "array", "string", "null", "boolean", "unreadable"]
KIND_OF, SIGNS = np.zeros(256, np.int8), np.zeros(256, bool)
for _k, _signs in enumerate([b"", b"{", b"[", b'"', b"n", b"tf", UNREADABLE]):
    KIND_OF[list(_signs)] = _k
SIGNS[list(b'"{}[]:,')] = True


def _signs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and bytes of the signs of JSON texts outside strings; of a string, its first quote."""
    at = np.flatnonzero(SIGNS[b])
    sign = b[at]
    quote = sign == ord('"')
    slash = b == ord("\\")
    if slash.any():
        # a quote behind an odd number of backslashes belongs to its string
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
        quote &= (at == 0) | ((at - 1 - plain[np.maximum(at - 1, 0)]) % 2 == 0)
    inside = np.cumsum(quote) % 2 == 1
    kept = quote == inside
    # of the rest, signs within a string are no quotes and inside, last quotes are quotes and outside
    return at[kept], sign[kept]


def _slices(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts from start to end, which are the insides of JSON strings or plain."""
    ends = np.concatenate([[0], np.cumsum(end - start)])
    data = b[np.repeat(start - ends[:-1], end - start) + np.arange(ends[-1])]
    out = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    if not (data == ord("\\")).any():
        return out
    escaped = pc.match_substring(out, "\\")
    return pc.replace_with_mask(out, escaped, pa.array([json.loads(f'"{x}"') for x in out.filter(escaped).to_pylist()], pa.string()))


def nodes_of(texts: pa.Array, wanted: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """Which text each node is of, and the wanted columns of KINDS, for JSON texts as Spark writes them (null: unreadable), in the order of a depth-first walk."""
    texts = pc.fill_null(texts.cast(pa.binary()), UNREADABLE)
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    b = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    at, sign = _signs(b)
    after = np.append(sign[1:], 0)
    is_key = (sign == ord('"')) & (after == ord(":"))
    # a value begins each text, follows each colon, and in arrays each bracket and comma
    begins = (sign == ord(":")) | ((sign == ord("[")) & (b[np.minimum(at + 1, len(b) - 1)] != ord("]"))) | ((sign == ord(",")) & ~np.append(is_key[1:], False))
    level = np.cumsum(np.isin(sign, list(b"{[")).astype(np.int64) - np.isin(sign, list(b"}]")))
    inner = np.flatnonzero(begins)
    start = np.concatenate([bounds[:-1], at[inner] + 1])
    order = np.argsort(start, kind="stable")
    start, depth = start[order], np.concatenate([np.zeros(len(texts), np.int64), level[inner]])[order]
    # the place of a value's key in b, for what follows a colon
    key_at = np.concatenate([np.full(len(texts), -1), np.where(sign[inner] == ord(":"), inner - 1, -1)])[order]
    kind, n = KIND_OF[b[start]], len(start)
    of = np.cumsum(depth == 0) - 1
    # a scalar ends at the next sign that is not its own, or with the text
    following = np.searchsorted(at, start, "right")
    end = np.minimum(np.append(at, len(b))[following], bounds[of + 1])
    end = np.where((kind == 1) | (kind == 2), start + 2, end)

    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    above, place, held, ranks, groups = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
    for over, here in zip(levels, levels[1:], strict=False):
        ranks.append(np.searchsorted(over, here) - 1)
        above[here] = over[ranks[-1]]
        first = np.flatnonzero(np.append(True, ranks[-1][1:] != ranks[-1][:-1]))
        groups.append(first)
        place[here] = np.arange(len(here)) - np.repeat(first, np.diff(np.append(first, len(here))))
    for here, first in zip(reversed(levels[1:]), reversed(groups), strict=True):
        up = above[here[first]]
        held[up] = np.add.reduceat(held[here] + 1, first)
        end[up] = end[here[np.append(first[1:], len(here)) - 1]] + 1
    entry = np.arange(n) - levels[0][of]

    parents = pa.array(above, mask=above < 0)
    listed = (above >= 0) & (key_at < 0)
    named = np.where(key_at >= 0, key_at, 0)
    places = np.append(at, 0)
    key = _slices(b, np.where(key_at >= 0, places[named] + 1, 0), np.where(key_at >= 0, places[named + (len(at) > 0)] - 1, 0))
    key = pc.if_else(pa.array(listed), pc.cast(pa.array(place), pa.string()), pc.if_else(pa.array(depth > 0), key, None))
    columns = {
        "key": key, "place": pa.array(place.astype(np.int32)), "listed": pa.array(listed), "depth": pa.array(depth.astype(np.int32)), "kind": pa.array(KIND, pa.string()).take(pa.array(kind)), "entry": pa.array(entry), "exit": pa.array(entry + held),
    }
    if "above" in wanted:
        columns["above"] = key.take(parents)
    if "text" in wanted:
        quoted, shown = (kind == 3).astype(np.int64), np.isin(kind, [0, 3, 5])
        columns["text"] = pc.if_else(pa.array(shown), _slices(b, np.where(shown, start + quoted, 0), np.where(shown, end - quoted, 0)), None)
    if {"path", "parent", "grand"} & set(wanted):
        step = pc.replace_substring(pc.replace_substring(key, "~", "~0"), "/", "~1")
        paths = [pa.array([""] * len(levels[0]), pa.string())]
        for here, rank in zip(levels[1:], ranks, strict=True):
            paths.append(pc.binary_join_element_wise(paths[-1].take(pa.array(rank)), step.take(pa.array(here)), "/"))
        columns["path"] = pa.concat_arrays(paths).take(pa.array(np.argsort(np.concatenate(levels), kind="stable")))
        columns["parent"] = columns["path"].take(parents)
        columns["grand"] = columns["parent"].take(parents)
    if "digest" in wanted:
        whole = b.tobytes()
        columns["digest"] = pa.array([md5(whole[x:y]).hexdigest() if k != 6 else None for x, y, k in zip(start.tolist(), end.tolist(), kind.tolist(), strict=True)], pa.string())
    return of, [columns[c] for c in wanted]


def walked(docs: DataFrame, columns: list[str] = NODE) -> DataFrame:
    """Columns of NODE, file and side first, of all documents (file, side, body), which are taken to be distinct."""
    spark, wanted = docs.sparkSession, [c for c in columns if c not in DOC]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, made = nodes_of(batch.column(2), wanted)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), *made], [*DOC, *wanted])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    named = {"string": "string", "int32": "int", "int64": "bigint", "bool": "boolean"}
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in DOC), *(f"{c} {named[str(KINDS[c])]}" for c in wanted)])
    return docs.select(*DOC, F.expr("CAST(to_json(try_parse_json(body)) AS BINARY)").alias("body")).mapInArrow(run, schema)


def node_table(docs: DataFrame) -> DataFrame:
    """NODE of all documents (file, side, body). The result is a table of its own, for forget()."""
    return cut(walked(docs.dropDuplicates(DOC)))


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with entry and exit, which node_table() numbers as it walks."""
    return nodes.select(*NODE)


def holding(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of nodes (file, side, outer, inner) where the first holds the second, both numbered: a join of ranges within a document."""
    a = outer.select(*DOC, F.col("path").alias("outer"), F.col("entry").alias("low"), F.col("exit").alias("high"))
    b = inner.select(*DOC, F.col("path").alias("inner"), "entry")
    return a.join(b, DOC).where("entry > low and entry <= high").select(*DOC, "outer", "inner")


def last_step(pointer: Column) -> Column:
    """The name that a pointer ends in."""
    return F.replace(F.replace(F.element_at(F.split(pointer, "/"), -1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def references(nodes: DataFrame) -> DataFrame:
    """file, side, site, target (a pointer within the document; other targets are left out), form: `$ref` objects stand at their own place, values of a discriminator's mapping at theirs."""
    here = nodes.where("kind = 'string' and startswith(text, '#/')")
    objects = here.where("key = '$ref' and not listed").select(*DOC, F.col("parent").alias("site"), F.substring("text", 2, 1 << 30).alias("target"), F.lit("ref").alias("form"))
    mapped = here.where("above = 'mapping' and endswith(parent, '/discriminator/mapping')").select(*DOC, F.col("path").alias("site"), F.substring("text", 2, 1 << 30).alias("target"), F.lit("mapping").alias("form"))
    return objects.unionByName(mapped)


def followed(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file, side, site, path: where each chain of references ends after at most HOPS hops, with the digest and kind of what stands there; chains that end nowhere, or never, are left out."""
    hop = cut(refs.where("form = 'ref'").select(*DOC, "site", F.col("target").alias("path")))
    hops = 1
    held = [hop]
    while hops < HOPS:
        # each round doubles how far a row has come
        on = hop.select(*DOC, F.col("site").alias("path"), F.col("path").alias("further"))
        hop = cut(hop.join(on, [*DOC, "path"], "left").select(*DOC, "site", F.coalesce("further", "path").alias("path")))
        held.append(hop)
        hops *= 2
    ends = hop.join(nodes.select(*DOC, "path", "kind", "digest"), [*DOC, "path"]).join(refs.where("form = 'ref'").select(*DOC, F.col("site").alias("path")), [*DOC, "path"], "left_anti")
    out = cut(ends)
    forget(*held)
    return out


def faces(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """file, side, path, parent, listed, face: the digest of what a reader of each place meets, references followed."""
    to = ends.select(*DOC, F.col("site").alias("path"), F.col("digest").alias("end"))
    return nodes.join(to, [*DOC, "path"], "left").select(*DOC, "path", "parent", "listed", F.coalesce("end", "digest").alias("face"))


#: Places of named schemas.
SCHEMA_PLACES = ["/components/schemas", "/definitions"]


def named_schemas(nodes: DataFrame) -> DataFrame:
    """file, side, name, path, digest of a document's named schemas."""
    return nodes.where(F.col("parent").isin(SCHEMA_PLACES)).select(*DOC, F.col("key").alias("name"), "path", "digest")


def removed_schemas(nodes: DataFrame, refs: DataFrame, ends: DataFrame) -> DataFrame:
    """For each named schema of the old side that the new one lacks: file, name, sites (places that refer to it), kept (of these, places where the new side presents the same shape, at the place itself or elsewhere in the list that holds it), inside (not kept, but within another schema that went) and lost.

    A schema that is referred to nowhere has 0 sites.
    """
    named = named_schemas(nodes)
    new_names = named.where("side = 'new'").select("file", "name")
    gone = cut(named.where("side = 'old'").join(new_names, ["file", "name"], "left_anti"))
    # the shape behind the name, its own references followed
    to = ends.where("side = 'old'").select("file", F.col("site").alias("path"), F.col("digest").alias("end"))
    shaped = gone.join(to, ["file", "path"], "left").select("file", "name", "path", F.coalesce("end", "digest").alias("shape"))
    site = refs.where("side = 'old'").select("file", F.col("target").alias("path"), "site").join(shaped, ["file", "path"]).select("file", "name", "shape", "site")
    places = nodes.where("side = 'old'").select("file", F.col("path").alias("site"), "parent", "listed")
    site = cut(site.join(places, ["file", "site"]))
    seen = faces(nodes.where("side = 'new'"), ends.where("side = 'new'"))
    here = site.join(seen.select("file", F.col("path").alias("site"), F.col("face").alias("shape")), ["file", "site", "shape"], "left_semi")
    members = seen.where("listed").select("file", "parent", F.col("face").alias("shape"))
    among = site.where("listed").join(members, ["file", "parent", "shape"], "left_semi")
    kept = here.select("file", "name", "site").unionByName(among.select("file", "name", "site")).distinct().withColumn("kept", F.lit(True))
    owner = F.regexp_extract("site", "^((?:/components/schemas|/definitions)/[^/]*)", 1)
    owners = gone.select("file", F.col("path").alias("owner"), F.lit(True).alias("inside"))
    judged = site.select("file", "name", "site", owner.alias("owner")).join(kept, ["file", "name", "site"], "left").join(owners, ["file", "owner"], "left")
    is_kept, is_inside = F.coalesce("kept", F.lit(False)), F.coalesce("inside", F.lit(False))
    counts = judged.groupBy("file", "name").agg(F.count(F.lit(1)).alias("sites"), F.count_if(is_kept).alias("kept"), F.count_if(~is_kept & is_inside).alias("inside"), F.count_if(~is_kept & ~is_inside).alias("lost"))
    nought = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("sites", "kept", "inside", "lost")}
    return gone.select("file", "name").join(counts, ["file", "name"], "left").select("file", "name", *nought.values())


def repeated_bodies(nodes: DataFrame) -> DataFrame:
    """For each named schema of the old side that the new one lacks: file, name, sites (places under paths whose value is the schema's own, in documents without references), kept, with_operation (not kept, of an operation that went too), lost, and inlined: how many of the document's named schemas stand under paths at all."""
    named = named_schemas(nodes)
    gone = named.where("side = 'old'").join(named.where("side = 'new'").select("file", "name"), ["file", "name"], "left_anti")
    bodies = nodes.where("kind = 'object' and startswith(path, '/paths/')")
    old = bodies.where("side = 'old'").select("file", "digest", F.col("path").alias("site"))
    inlined = named.where("side = 'old'").join(old.select("file", "digest").distinct(), ["file", "digest"], "left_semi").groupBy("file").agg(F.count_distinct("name").alias("inlined"))
    new = bodies.where("side = 'new'").select("file", F.col("path").alias("site"), F.col("digest").alias("now"))
    operation = F.regexp_extract("site", "^(/paths/[^/]*/(?:get|put|post|delete|options|head|patch|trace))(?:/|$)", 1)
    ops = bodies.where("side = 'new'").select("file", F.col("path").alias("operation"), F.lit(True).alias("stays"))
    at = gone.select("file", "name", "digest").join(old, ["file", "digest"]).select("*", operation.alias("operation"))
    at = at.join(new, ["file", "site"], "left").join(ops, ["file", "operation"], "left")
    kept = F.coalesce(F.col("now") == F.col("digest"), F.lit(False))
    went = ~kept & (F.col("operation") != "") & F.col("stays").isNull()
    counts = at.groupBy("file", "name").agg(F.count(F.lit(1)).alias("sites"), F.count_if(kept).alias("kept"), F.count_if(went).alias("with_operation"), F.count_if(~kept & ~went).alias("lost"))
    out = gone.select("file", "name").join(counts, ["file", "name"], "left").join(inlined, "file", "left")
    return out.select("file", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sites", "kept", "with_operation", "lost", "inlined")])
