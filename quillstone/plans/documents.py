"""The questions of shapes, obligations, alternatives, equality and nodes, answered in one pass over a document where it lies.

A document is at most one variant, so its schema graph is held by the task that reads it: no rounds
of joins over the nodes of all documents. Every rule is that of the module of its name (shapes,
obligations, alternatives, equality, nodes.removed_schemas), which says what it means and does the
same over a node table; tests hold the two against each other. Spark settles what is JSON, how
numbers are written and the order of keys, as for nodes.

Edge cases: those of the modules; what is no JSON has no schemas; a document without the other side
is asked with none there; an empty table gives no rows.

Skew: a task holds a batch of documents (nodes.BATCH_BYTES) and the graph of one, or of a file's two.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.plans.alternatives import MOST
from quillstone.plans.shapes import ANNOTATIONS, ANY, DEPTH, OPAQUE, UNIONS, UNKNOWN, UNRESOLVED
from quillstone.sources.nodes import BATCH_BYTES, BATCH_ROWS, DOC, HOPS, SCHEMA_PLACES

COMPOSING = ["allOf", *UNIONS]
SILENT = {*ANNOTATIONS, "allOf"}


class Number(NamedTuple):
    """A number as it is written; equal to no string."""

    text: str


def read(body: bytes | None):
    """The value of a JSON text; None where there is none."""
    return None if body is None else json.loads(body, parse_int=Number, parse_float=Number, parse_constant=Number)


def text_of(value) -> str | None:
    """A scalar's text; None of null and containers."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else value.text if isinstance(value, Number) else None


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def children(value) -> Iterable[tuple[str, object]]:
    """Steps and values of what a value holds."""
    if isinstance(value, dict):
        return ((escaped(k), v) for k, v in value.items())
    return ((str(k), v) for k, v in enumerate(value)) if isinstance(value, list) else ()


class Words:
    """What an object says about itself as a schema (shapes.keywords)."""

    def __init__(self, node: dict):
        listed = lambda k: [text_of(x) for x in node[k]] if isinstance(node.get(k), list) else []
        own = lambda k: node.get(k) if isinstance(node.get(k), str) else None
        once = lambda texts: sorted({x for x in texts if x is not None})
        self.ref, self.title, self.constant = own("$ref"), text_of(node.get("title")), text_of(node.get("const"))
        self.types, self.values = once(listed("type")), once(listed("enum"))
        self.names = sorted(node["properties"]) if isinstance(node.get("properties"), dict) else []
        self.required = once(x for x in node["required"] if isinstance(x, str)) if isinstance(node.get("required"), list) else []
        self.type = f"[{','.join(self.types)}]" if self.types else own("type")
        self.has_names, self.has_values = "properties" in node, "enum" in node
        self.nullable, self.closed = text_of(node.get("nullable")) == "true", text_of(node.get("additionalProperties")) == "false"
        self.says = any(k not in SILENT for k in node)
        self.says_more = any(k not in SILENT and k != "nullable" for k in node)
        self.has = {k: k in node for k in (*COMPOSING, "items")}
        self.kids: list[tuple[str, str]] = []

    def copy(self) -> Words:
        out = Words.__new__(Words)
        out.__dict__ = {**self.__dict__, "has": dict(self.has)}
        return out


class _Made(dict):
    """Values that are made of their key when first asked for."""

    def __init__(self, make: Callable):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        out = self[key] = self._make(key)
        return out


def _composed(place: str, v: dict) -> list[tuple[str, str, str]]:
    """(role, name, child) of what an object holds as a schema (shapes.edges)."""
    lines = []
    if isinstance(v.get("properties"), dict):
        lines += [("property", k, f"{place}/properties/{escaped(k)}") for k in v["properties"]]
    for role in COMPOSING:
        if isinstance(v.get(role), list):
            lines += [(role, "", f"{place}/{role}/{k}") for k in range(len(v[role]))]
    if "items" in v:
        lines.append(("items", "", f"{place}/items"))
    return lines


class Schemas:
    """The schemas of a document: objects by place, their words and lines (role, name, child), refs (of objects to pointers) and ends (places that references lead to).

    With `within`, only the objects that named schemas are made of or refer to, however far: no answer about these hangs on others.
    """

    def __init__(self, value, within: bool = False):
        self.value, self.empty, self.within = value, value is None, within
        self.found = _Made(self._find)
        self.words = _Made(lambda place: Words(self.objects[place]))
        self.lines = _Made(self._composed)
        self.ends = _Made(self._end)
        self.mappings: list[str] = []

    @cached_property
    def objects(self) -> dict[str, dict]:
        """All that is asked for, walked when first looked at; of the whole document, mappings of discriminators are noted too."""
        out: dict[str, dict] = {}
        todo = [(place, self.get(place)) for _, place in self.named()] if self.within else [] if self.empty else [("", self.value)]
        while todo:
            place, v = todo.pop()
            if place in out:
                continue
            if isinstance(v, dict):
                out[place] = v
            if not self.within:
                todo += [(f"{place}/{step}", x) for step, x in children(v) if isinstance(x, dict | list)]
                if place.endswith("/discriminator/mapping"):
                    self.mappings.append(place)
            elif isinstance(v, dict):
                ref = v.get("$ref")
                below = [*(child for _, _, child in _composed(place, v)), *([ref[1:]] if isinstance(ref, str) and ref.startswith("#/") else [])]
                self.found[place] = (v,)
                todo += [(child, self.get(child)) for child in below]
        return out

    @cached_property
    def refs(self) -> dict[str, str]:
        return {place: v["$ref"][1:] for place, v in self.objects.items() if isinstance(v.get("$ref"), str) and v["$ref"].startswith("#/")}

    def _find(self, place: str) -> tuple:
        """What stands at a place, as a tuple of one; none where nothing does."""
        above, _, last = place.rpartition("/")
        # the place above is often known
        at, steps = (self.found[above], [last]) if place and above in self.found else (() if self.empty else (self.value,), place.split("/")[1:])
        if not at or (place and not place.startswith("/")):
            return ()
        v = at[0]
        for step in steps:
            key = step.replace("~1", "/").replace("~0", "~")
            if isinstance(v, dict) and key in v and escaped(key) == step:
                v = v[key]
            elif isinstance(v, list) and step.isdecimal() and str(int(step)) == step and int(step) < len(v):
                v = v[int(step)]
            else:
                return ()
        return (v,)

    def get(self, place: str):
        """What stands at a place, or None."""
        return next(iter(self.found[place]), None)

    def _composed(self, place: str) -> list[tuple[str, str, str]]:
        return _composed(place, self.objects.get(place, {}))

    def _target(self, place: str) -> str | None:
        """The pointer of a place that is a reference, whether it is among the objects or not."""
        v = self.get(place)
        ref = v.get("$ref") if isinstance(v, dict) else None
        return ref[1:] if isinstance(ref, str) and ref.startswith("#/") else None

    def _end(self, site: str) -> str | None:
        at, to = site, self._target(site)
        if to is None:
            return None
        for _ in range(HOPS):
            if to is None:
                break
            at, to = to, self._target(to)
        return at if self.found[at] and to is None else None

    def through(self, place: str) -> str:
        """Where references of a place lead, if to an object; else the place."""
        end = self.ends[place]
        return end if end is not None and isinstance(self.get(end), dict) else place

    def links(self, place: str) -> list[tuple[str, str]]:
        """(role, child) of what a schema is composed of."""
        if place in self.refs:
            return [("ref", self.refs[place])]
        return [(role, child) for role, _, child in self.lines[place] if role in COMPOSING]

    def named(self) -> list[tuple[str, str]]:
        """Steps and places of named schemas that are objects."""
        return [(step, f"/components/schemas/{step}") for step, v in children(self.get("/components/schemas")) if step and isinstance(v, dict)]


def _by_height(waiting: dict[str, set[str]]) -> Iterator[str]:
    """Keys whose sets are worked off, innermost first; what waits for itself never comes."""
    users, left = defaultdict(list), {k: len(x) for k, x in waiting.items()}
    for k, below in waiting.items():
        for x in below:
            users[x].append(k)
    ready = deque(k for k, n in left.items() if not n)
    while ready:
        at = ready.popleft()
        yield at
        for k in users[at]:
            left[k] -= 1
            if not left[k]:
                ready.append(k)


def merged(g: Schemas) -> dict[str, Words]:
    """Words with what the arms of allOf add, and kids (role, child) of the merged schemas."""
    out: dict[str, Words] = {}
    for place in g.objects:
        w = out[place] = g.words[place].copy()
        w.kids = [(role, child) for role, _, child in g.lines[place] if role in ("items", *UNIONS)]
    waiting = {p for p, w in out.items() if w.has["allOf"]}
    arms = {p: [g.through(child) for role, _, child in g.lines[p] if role == "allOf"] for p in waiting}
    # an arm that is still a reference is never merged, so who holds one with allOf of its own waits for ever
    blocked = {p for p in waiting if any(a in waiting and out[a].ref is not None for a in arms[p])}
    below = {p: {a for a in arms[p] if a in waiting} | ({p} if p in blocked else set()) for p in waiting}
    for p in _by_height(below):
        waiting.discard(p)
        w, said = out[p], [out[a] for a in arms[p] if a in out and out[a].ref is None]
        alone = not arms[p]
        w.type = w.type if w.type is not None else next((a.type for a in said if a.type is not None), None)
        values = next((a.values for a in said if a.has_values), None)
        w.values = w.values if w.has_values else values or []
        w.has_values = w.has_values or values is not None
        w.names = sorted({*w.names, *(x for a in said for x in a.names)})
        w.has_names = bool(w.names)
        w.required = sorted({*w.required, *(x for a in said for x in a.required)})
        w.nullable = w.nullable or any(a.nullable for a in said)
        for k in (*UNIONS, "items"):
            first = next((a for a in said if a.has[k]), None)
            if first is not None and not w.has[k]:
                w.kids = [*w.kids, *(kid for kid in first.kids if kid[0] == k)]
                w.has[k] = True
        w.says_more = w.says_more or alone or w.type is not None or w.has_values or w.has_names or any(w.has[k] for k in (*UNIONS, "items")) or w.ref is not None or bool(w.required)
        w.says = w.says or w.says_more or w.nullable
    for p in waiting:
        w = out[p]
        w.says = w.says_more = True
        w.type, w.has_values, w.has_names, w.kids = None, False, False, []
    return out


def shapes(g: Schemas, places: Iterable[str], depth: int = DEPTH) -> dict[str, str]:
    """The shapes of places that are objects."""
    words, known = merged(g), {}

    def plain(place: str, w: Words, level: int) -> str:
        shown = lambda c: full(c, level - 1) if level and c in words else OPAQUE
        if w.ref is not None:
            to = g.refs.get(place)
            return shown(to) if to in words else UNKNOWN
        if w.has_names:
            return f"object({','.join(w.names)})"
        if w.type == "array":
            items = max((shown(c) for role, c in w.kids if role == "items"), default=OPAQUE)
            return f"array({items if w.has['items'] else ANY if level else OPAQUE})"
        for role in UNIONS:
            if w.has[role]:
                return f"{role}({'|'.join(sorted(shown(c) for r, c in w.kids if r == role))})"
        if w.type is None and not w.values:
            return UNRESOLVED
        return f"scalar({w.type or ''}{';' + ','.join(w.values) if w.values else ''})"

    def bare(place: str, level: int) -> str:
        if (place, level) not in known:
            w = words[place]
            known[place, level] = plain(place, w, level) if w.says_more else ANY
        return known[place, level]

    def full(place: str, level: int) -> str:
        w = words[place]
        if not w.says:
            return ANY
        if w.nullable:
            return f"nullable({bare(place, level - 1) if level else OPAQUE})"
        return bare(place, level) if w.says_more else UNRESOLVED

    return {p: full(p, depth) for p in places if p in words}


def obligations(g: Schemas) -> dict[str, set[str]]:
    """What every instance of a schema must carry, by place."""
    users, arms = defaultdict(list), Counter()
    for place in g.objects:
        for role, child in g.links(place):
            users[child].append((place, role))
            arms[place, role] += 1
    found, met = defaultdict(set), Counter()
    todo = [(p, x) for p in g.objects if g.words[p].ref is None for x in g.words[p].required]
    while todo:
        place, name = todo.pop()
        if name in found[place]:
            continue
        found[place].add(name)
        for user, role in users[place]:
            if role in UNIONS:
                met[user, role, name] += 1
                if met[user, role, name] < arms[user, role]:
                    continue
            todo.append((user, name))
    return found


class Alternatives(NamedTuple):
    """Of a schema: every alternative (type, names, pins) once, and the sets of names that contain no other; None where undecided."""

    all_: list | None
    least: list[frozenset] | None


UNDECIDED = Alternatives(None, None)


def _antichain(sets: Iterable[frozenset]) -> list[frozenset]:
    once = list(dict.fromkeys(sets))
    return [x for x in once if not any(y < x for y in once)]


def _bounded(sets: list) -> list | None:
    return sets if len(sets) <= MOST else None


def _combined(a: tuple, b: tuple) -> tuple:
    pinned = {n for n, _ in b[2]}
    return a[0] if a[0] is not None else b[0], a[1] | b[1], tuple(sorted([p for p in a[2] if p[0] not in pinned] + list(b[2])))


def alternatives(g: Schemas) -> dict[str, Alternatives]:
    """The alternatives of every schema, by place."""
    stands, own = {}, {}
    words = {p: g.words[p] for p in g.objects}
    for p, w in words.items():
        named = next((t for t in w.types if t != "null"), "null") if w.types else w.type
        seen = "object" if w.has["allOf"] else "array" if w.has["items"] else next((k for k in UNIONS if w.has[k]), "any")
        stands[p] = named if named is not None else "object" if w.has_names else seen
    for p, w in words.items():
        pins = []
        for role, name, child in g.lines[p]:
            at = words.get(g.through(child)) if role == "property" else None
            if at and (at.constant is not None or at.values):
                pins.append((name, (at.constant,) if at.constant is not None else tuple(at.values)))
        own[p] = (frozenset(w.names), tuple(sorted(pins)))
    lines, plain = {}, set()
    for p, w in words.items():
        composed = [(r, c) for r, c in g.links(p) if not (r == "anyOf" and w.has["oneOf"])]
        ends = {c: g.through(c) for r, c in composed if r in UNIONS}
        facts = [words.get(e) for e in ends.values()]
        if facts and w.type is not None and all(a and (a.constant is not None or a.values) and not (a.has_names or a.has["items"]) for a in facts):
            plain.add(p)
            composed = []
        lines[p] = [(r, c) for r, c in composed if c in words and not (r in UNIONS and stands.get(ends[c]) == "null")]
    done: dict[str, Alternatives] = {}
    for p in _by_height({p: {c for _, c in x} for p, x in lines.items()}):
        w, (names, pins), fan = words[p], own[p], lines[p]
        is_union = w.has["oneOf"] or w.has["anyOf"]
        if not fan:
            gone = (w.ref is not None or is_union) and p not in plain
            done[p] = Alternatives([], []) if gone else Alternatives([(stands[p], names, pins)], [names])
            continue
        if any(done[c].least is None for _, c in fan):
            done[p] = UNDECIDED
            continue
        if w.ref is not None:
            all_, least = next(((done[c].all_, done[c].least) for r, c in fan if r == "ref"), (None, None))
        elif is_union:
            over = [done[c] for r, c in fan if r in UNIONS]
            all_ = _bounded(list(dict.fromkeys(a for x in over for a in x.all_)))
            least = _bounded(_antichain(a for x in over for a in x.least))
        else:
            all_, least = [(stands[p] if w.type is not None or w.types else None, names, pins)], [names]
            for c in sorted(c for r, c in fan if r == "allOf"):
                if all_ is not None and done[c].all_:
                    all_ = _bounded(list(dict.fromkeys(_combined(a, b) for a in all_ for b in done[c].all_)))
                if least is not None and done[c].least:
                    least = _bounded(_antichain(a | b for a in least for b in done[c].least))
            all_ = all_ and [("object" if a[0] is None else a[0], *a[1:]) for a in all_]
        done[p] = UNDECIDED if all_ is None or least is None else Alternatives(all_, least)
    return {p: done.get(p, UNDECIDED) for p in words}


def classes(*graphs: Schemas) -> list[dict[str, int]]:
    """Numbers of the classes of all schemas of these documents, by place: equal for what is the same throughout."""

    def count(keys: list[dict]) -> tuple[list[dict[str, int]], int]:
        ids: dict = {}
        return [{p: ids.setdefault(x, len(ids)) for p, x in k.items()} for k in keys], len(ids)

    lines = [{p: [(role, name, g.through(c)) for role, name, c in g.lines[p]] for p in g.objects} for g in graphs]
    said = lambda w: "reference" if w.ref is not None else (w.type, *map(tuple, (w.types, w.values, w.names, w.required)), w.nullable, w.closed, w.constant, *w.has.values())
    found, n = count([{p: said(g.words[p]) for p in g.objects} for g in graphs])
    while True:
        made = [{p: (k, frozenset((r, name, of.get(c)) for r, name, c in x[p])) for p, k in of.items()} for of, x in zip(found, lines, strict=True)]
        found, now = count(made)
        if now == n:
            break
        n = now
    return [{p: of[g.through(p)] for p in of} for of, g in zip(found, graphs, strict=True)]


def removed_schemas(old: Schemas, new: Schemas) -> list[tuple[str, int, int, int, int]]:
    """(name, sites, kept, inside, lost) of the old side's named schemas that the new one lacks (nodes.removed_schemas)."""

    def named(g: Schemas) -> list[tuple[str, str]]:
        steps = lambda v: ((k, escaped(k)) for k in v) if isinstance(v, dict) else ((str(k), str(k)) for k in range(len(v))) if isinstance(v, list) else ()
        return [(name, f"{place}/{step}") for place in SCHEMA_PLACES for name, step in steps(g.get(place))]

    here = {name for name, _ in named(new)}
    gone = [(name, place) for name, place in named(old) if name not in here]
    if not gone:
        return []
    sites: dict[str, list[str]] = defaultdict(list)
    for site, target in old.refs.items():
        sites[target].append(site)
    for place in old.mappings:
        for step, x in children(old.get(place)):
            if isinstance(x, str) and x.startswith("#/"):
                sites[x[1:]].append(f"{place}/{step}")
    face = lambda g, place: g.get(place if (end := g.ends[place]) is None else end)
    kept, places = set(), {place for _, place in gone}
    for name, place in gone:
        shape = face(old, place)
        for site in sites[place]:
            above = site.rpartition("/")[0]
            among = new.get(above)
            same = bool(new.found[site]) and face(new, site) == shape
            if not same and site and isinstance(old.get(above), list) and isinstance(among, list):
                same = any(face(new, f"{above}/{k}") == shape for k in range(len(among)))
            if same:
                kept.add((name, site))
    counts: dict[str, Counter] = defaultdict(Counter)
    for name, place in gone:
        for site in sites[place]:
            owner = next(("/".join(site.split("/")[: root.count("/") + 2]) for root in SCHEMA_PLACES if site.startswith(root + "/")), "")
            counts[name]["sites"] += 1
            counts[name]["kept" if (name, site) in kept else "inside" if owner in places else "lost"] += 1
    return [(name, *(counts[name][c] for c in ("sites", "kept", "inside", "lost"))) for name, _ in gone]


def asked(docs: DataFrame, columns: str, answer: Callable[[Schemas], Iterable[tuple]], within: bool = False) -> DataFrame:
    """file, side and columns (as in a schema) of what answer() says of each document (file, side, body), which are taken to be distinct."""
    return _mapped(docs, [*DOC], ["body"], columns, answer, within)


def asked_by_file(docs: DataFrame, columns: str, answer: Callable[[Schemas, Schemas], Iterable[tuple]], within: bool = False) -> DataFrame:
    """file and columns of what answer() says of the old and the new document of each file; a side that is missing has no nodes."""
    body = lambda side: F.max(F.when(F.col("side") == side, F.col("body"))).alias(side)
    return _mapped(docs.groupBy("file").agg(body("old"), body("new")), ["file"], ["old", "new"], columns, answer, within)


def _mapped(docs: DataFrame, keys: list[str], bodies: list[str], columns: str, answer: Callable, within: bool) -> DataFrame:
    spark = docs.sparkSession
    schema = ", ".join([*(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys), columns])
    wanted = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(len(keys) + k) for k in range(len(bodies))]
            of, rows = [], []
            for k in range(batch.num_rows):
                graphs = [Schemas(read(column[k].as_py()), within) for column in at]
                for row in answer(*graphs):
                    of.append(k)
                    rows.append(row)
            made = list(zip(*rows, strict=True)) if rows else [()] * (len(wanted) - len(keys))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of, pa.int32())) for k in range(len(keys))), *(pa.array(m, wanted.field(len(keys) + k).type) for k, m in enumerate(made))], schema=wanted)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(*keys, *[F.expr(f"CAST(to_json(try_parse_json({b})) AS BINARY)").alias(b) for b in bodies]).mapInArrow(run, schema)
