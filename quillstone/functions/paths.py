"""Column functions over paths, URLs and operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible_path(path: Column) -> Column:
    """What a caller sees of a path or operation: no query or fragment, and every named hole as {}."""
    return F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"\{[^}]*\}", "{}")


def path_of(operation: Column) -> Column:
    """The path of "METHOD /path"."""
    return F.regexp_replace(operation, r"^[^ ]* ", "")


def url_host(url: Column) -> Column:
    """The host a URL states, lower-cased; '' if it states none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def written_host(text: Column) -> Column:
    """The host that a text begins with as a URL; null if there is none, or it has holes."""
    host = url_host(F.trim(text))
    return F.when((host != "") & ~host.rlike("[{}%]"), host)


def url_path(url: Column) -> Column:
    return F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", "")


def segments(path: Column) -> Column:
    """Non-empty pieces of a path, without query and fragment."""
    return F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda s: s != "")


def is_hole(segment: Column) -> Column:
    """Whether a segment stands for a value: it has a hole, or is a format mark."""
    return segment.rlike(r"[{}]|^%")


def resource_of(path: Column) -> Column:
    """The first segment that is neither a hole nor a version; '' if there is none. Api and 2010-04-01 count as versions."""
    fixed = lambda s: ~is_hole(s) & ~F.lower(s).rlike(r"^(v[0-9]+|api|2010-04-01)$")
    return F.coalesce(F.get(F.filter(segments(path), fixed), F.lit(0)), F.lit(""))


def static_run(path: Column) -> Column:
    """The last run of segments without holes, led by / and joined by /; the longest one where that has under 5 characters; '' if there is none, or the path is a pointer."""
    marked = F.array_join(F.transform(segments(path), lambda s: F.when(s.startswith("{"), F.lit("{}")).otherwise(s)), "/")
    runs = F.filter(F.transform(F.split(marked, r"\{\}"), lambda r: F.regexp_replace(r, r"^/+|/+$", "")), lambda r: r != "")
    last = F.element_at(runs, -1)
    longest = F.aggregate(runs, F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a))
    run = F.when(F.length(last) >= 4, last).otherwise(longest)
    return F.when((F.size(runs) == 0) | path.startswith("#"), "").otherwise(F.concat(F.lit("/"), run))


def ends_like(template: Column, path: Column) -> Column:
    """Whether a path written in code is that of a template: it ends in the template's segments, whose holes match anything and whose other segments match themselves, in any case.

    A path that ends in / goes on elsewhere and matches nothing, nor does a template of holes alone.
    """
    norm = lambda p: F.reverse(F.transform(segments(p), lambda s: F.when(is_hole(s), F.lit("*")).otherwise(F.lower(s))))
    a, b = norm(template), norm(path)
    same = F.zip_with(a, F.slice(b, 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.coalesce((x == "*") | (x == y), F.lit(False)))
    return (F.size(a) > 0) & (F.size(a) <= F.size(b)) & ~F.rtrim(path).endswith("/") & F.exists(a, lambda s: s != "*") & F.forall(same, lambda x: x)


def without_version(path: Column, prefixes: Column) -> Column:
    """A path without the first of its vendor's version prefixes that it begins with; / if nothing is left."""
    first = F.get(F.filter(prefixes, lambda p: path.startswith(p)), F.lit(0))
    rest = F.substring(path, F.length(first) + 1, F.length(path))
    return F.when(first.isNull(), path).when(rest == "", "/").otherwise(rest)


def resource_segments(path: Column, prefixes: Column) -> Column:
    """Segments without holes of a path without its version, less a tail .json; none of a pointer."""
    parts = F.filter(F.split(without_version(path, prefixes), "/"), lambda s: (s != "") & ~s.startswith("{"))
    return F.when(path.startswith("#"), F.array().cast("array<string>")).otherwise(F.transform(parts, lambda s: F.regexp_replace(s, r"\.json$", "")))


def canonical(operations: Column, own: Column) -> Column:
    """The path, of those of some operations, with the fewest segments, then holes, then characters; its own where there are none ('' if that is a pointer)."""
    found = F.filter(F.transform(operations, path_of), lambda p: (p != "") & ~p.startswith("#"))
    count = lambda p, c: F.length(p) - F.length(F.replace(p, F.lit(c), F.lit("")))
    ranked = F.array_sort(F.transform(found, lambda p: F.struct(count(p, "/").alias("s"), count(p, "{").alias("h"), F.length(p).alias("n"), p.alias("p"))))
    return F.coalesce(F.get(ranked, F.lit(0))["p"], F.when(own.startswith("#"), "").otherwise(own))
