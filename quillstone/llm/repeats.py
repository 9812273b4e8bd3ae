"""Removal of repeated byte strings, exact over all texts.

A string is repeated if it starts anywhere else, in the same text or another. Equal strings have
equal minimizers (the least-hashed GRAM bytes in them, the leftmost of equals) at equal offsets,
so a text's places are cut into segments of starts that share one minimizer occurrence, and only
segments of equal minimizers can hold equal strings. Segments are counted by the hash of their
content: minimizers that occur once are done with, and a content that occurs twice is repeated
throughout. What is left are different contents of one minimizer. They are dealt to shards by
minimizer, and a shard's contents are joined and their suffixes sorted by external induced
sorting (suffixes.py); neighbouring suffixes that agree over the length wanted mark their starts.
Agreement is read off the contents as suffixes leave the sort, rather than carried through it: it
is needed only where two starts are neighbours, and costs one comparison there.

A minimizer with more than HOT different contents would make a shard too large: its starts are
counted singly, by the 128-bit hash of their strings, with a count on the map side.

Edge cases: a null text is empty; texts shorter than the length lose nothing; repeated rows are
occurrences of their own, so two equal rows repeat each other; texts are read whole, in blocks; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ROW, cut, drop, map_arrow, partitions, some_rows, texts_of
from quillstone.llm.shingles import BASE, INVERSE, mix, powers
from quillstone.llm.suffixes import on_disk, sorted_to, suffix_array

GRAM = 64
#: Starts whose minimizers are found at once; a place in a block fits the low bits of a key.
BLOCK, LOW = 1 << 19, 20
HOT = 1000
#: Bytes of a shard, and up to which its suffixes are sorted in memory; one minimizer's contents stay together whatever their size.
SHARD, IN_MEMORY = 1 << 20, 4 << 20


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of data."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(BASE, n)[: n - k + 1])


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring keys."""
    n = len(keys)
    if w == 1:
        return keys
    rows = -(-n // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = keys
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: bytes, length: int) -> list[tuple[int, int, int]]:
    """(minimizer, first start, last start) of the segments of a text's starts."""
    out: list[tuple[int, int, int]] = []
    gram = min(GRAM, length)
    for at in range(0, len(data) - length + 1, BLOCK):
        part = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - at), at)
        hashes = gram_hashes(part, gram)
        keys = (hashes >> np.uint64(LOW) << np.uint64(LOW)) | np.arange(len(hashes), dtype=np.uint64)
        where = (sliding_min(keys, length - gram + 1) & np.uint64((1 << LOW) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        last = np.append(first[1:], len(where)) - 1
        out += zip(hashes[where[first]].view(np.int64).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)
    return out


def _digest(data: memoryview) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(data)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """row, m (minimizer), h1, h2 (content), s, e: every segment of every text."""

    def make():
        def work(batch: pa.RecordBatch):
            at, m, h1, h2, s, e = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None or len(text) < length:
                    continue
                view = memoryview(text)
                for mini, a, b in segments(text, length):
                    x, y = _digest(view[a : b + length])
                    at.append(k), m.append(mini), h1.append(x), h2.append(y), s.append(a), e.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (m, h1, h2, s, e))], ["row", "m", "h1", "h2", "s", "e"])

        return work

    return map_arrow(docs.select(F.expr(ROW).alias("row"), F.col("text").cast("binary").alias("text")), make, "row binary, m bigint, h1 bigint, h2 bigint, s bigint, e bigint")


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending distinct numbers as runs (first, last)."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True))


def repeated_starts(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each content, the starts of strings of the length that start anywhere else in the contents, by sorting suffixes."""
    # contents end in 0, other symbols are one more: no string spans two contents
    joined = b"\0".join(contents) + b"\0"
    sizes = np.array([len(c) + 1 for c in contents])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(joined, np.uint8).astype(np.uint16) + np.uint16(1)
    text[begin[1:] - 1] = 0
    owner = np.repeat(np.arange(len(contents), dtype=np.int32), sizes)
    order = np.frombuffer(suffix_array(on_disk(text)), np.int64) if len(text) > IN_MEMORY else sorted_to(text, length)
    order = order[order + length <= begin[owner[order] + 1] - 1]
    at = order.tolist()
    same = np.fromiter((joined[p : p + length] == joined[q : q + length] for p, q in zip(at, at[1:], strict=False)), bool, max(0, len(at) - 1))
    found = order[np.append(False, same) | np.append(same, False)] if len(at) else order
    found = np.sort(found)
    parts = np.searchsorted(found, begin)
    return [found[a:b] - first for a, b, first in zip(parts, parts[1:], begin, strict=False)]


def _spans(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


SPAN = ["m", "h1", "h2", "a", "b"]
SPAN_SCHEMA = ", ".join(f"{c} bigint" for c in SPAN)


def sort_shards(contents: DataFrame, length: int, shards: int) -> DataFrame:
    """(m, h1, h2, a, b): runs of repeated starts of each content, whole minimizers at a time, up to about SHARD bytes."""
    dealt = contents.repartition(shards, "m").sortWithinPartitions("m")

    def run(batches):
        rows: list[tuple[int, int, int, bytes]] = []
        now, size = None, 0

        def done() -> pa.RecordBatch:
            marks = repeated_starts([r[3] for r in rows], length)
            return _spans([(*r[:3], a, b) for r, x in zip(rows, marks, strict=True) for a, b in runs_of(x)], SPAN)

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= SHARD and r[0] != now:
                    yield done()
                    rows, size = [], 0
                now = r[0]
                rows.append(r)
                size += len(r[3]) + 1
        if rows:
            yield done()

    return dealt.mapInArrow(run, SPAN_SCHEMA)


def spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(row, a, b): bytes a to b - 1 of a text are covered by a repeated string; spans may overlap. A table of its own, for drop()."""
    every = cut(occurrences(docs, length))
    # tables of minimizers are cut, so that a join by them can be split where one is hot
    several = cut(every.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m"))
    held = cut(every.join(several, "m"))
    drop(every, several)
    kinds = cut(held.groupBy("m", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "s", "e")).alias("one")))
    whole = kinds.where("copies > 1").select("m", "h1", "h2", F.lit(0).cast("long").alias("a"), F.expr("one.e - one.s").alias("b"))
    mixed = cut(kinds.groupBy("m").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    open_ = cut(kinds.join(mixed, "m").select("m", "h1", "h2", "copies", "kinds", "one.row", "one.s", "one.e"))
    drop(mixed)
    rows = cut(open_.select("row").distinct())
    texts = texts_of(docs, rows)
    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("m", "h1", "h2", "kinds", "s", "e")).alias("w"))
    loaded = texts.join(wanted, "row").select(F.col("text").cast("binary").alias("text"), "w")

    def cut_contents():
        def work(batch: pa.RecordBatch):
            rows = [(w["m"], w["h1"], w["h2"], w["kinds"], t[w["s"] : w["e"] + length]) for t, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in ws]
            m, h1, h2, kinds_, c = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (m, h1, h2)), pa.array(c, pa.binary()), pa.array(kinds_, pa.int64())], ["m", "h1", "h2", "content", "kinds"])

        return work

    contents = cut(map_arrow(loaded, cut_contents, "m bigint, h1 bigint, h2 bigint, content binary, kinds bigint"))
    sorted_ = sort_shards(contents.where(F.col("kinds") <= HOT).select("m", "h1", "h2", "content"), length, 4 * partitions(docs.sparkSession))

    def single_starts():
        def work(batch: pa.RecordBatch):
            rows = []
            for m, h1, h2, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                view = memoryview(c)
                rows += [(m, h1, h2, a, *_digest(view[a : a + length])) for a in range(len(c) - length + 1)]
            yield _spans(rows, ["m", "h1", "h2", "a", "w1", "w2"])

        return work

    hot = contents.where(F.col("kinds") > HOT).select("m", "h1", "h2", "content")
    starts = cut(map_arrow(hot, single_starts, "m bigint, h1 bigint, h2 bigint, a bigint, w1 bigint, w2 bigint"))
    drop(open_, rows)
    again = cut(starts.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"))
    counted = starts.join(again, ["w1", "w2"]).select("m", "h1", "h2", "a", F.col("a").alias("b"))
    found = cut(whole.unionByName(sorted_).unionByName(counted))
    drop(kinds, contents, starts, again)
    out = cut(held.join(found, ["m", "h1", "h2"]).select("row", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + length).alias("b")).distinct())
    drop(held, found)
    return out


def removed(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs) and kept (the bytes left) of each document."""
    found = spans(docs, length)
    # a text's spans are at most as many as its bytes
    by_row = cut(found.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    touched = cut(by_row.select("row"))
    drop(found)
    named = docs.select("doc_id", F.expr(ROW).alias("row"), F.col("text").cast("binary").alias("text"))
    # only texts that lose something are moved
    rows = named.join(some_rows(touched), "row", "left_semi").join(by_row, "row").select("doc_id", "text", "spans")
    rows = rows.unionByName(named.join(some_rows(touched), "row", "left_anti").select("doc_id", "text", F.lit(None).cast(by_row.schema["spans"].dataType).alias("spans")))

    def make():
        def work(batch: pa.RecordBatch):
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                runs: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in found or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                kept = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in runs], kept))
            n, gone, k, sha, runs_, kept_ = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(runs_, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept_, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

        return work

    return map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:bigint,b:bigint>>, kept binary")
