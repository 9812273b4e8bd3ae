"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised to lower-case words of letters and digits, joined by single
spaces. An item of n characters may be matched with up to e = floor(n / 16) edits. It is split
into e + 1 pieces: whatever e edits do, one piece stays whole, so the exact hits of all pieces
(one Aho-Corasick pass over a document) hold every occurrence. The part of the document around a
hit, as long as the item and e characters on either side, is verified by Myers's bit-parallel
distance between the item and any substring.

Items travel to the workers in blocks of bounded size; the documents are read once per block, one
block after the other, so any number of items is handled and one block at a time is in the driver. Items that normalise to fewer than MIN_CHARS characters are
matched without edits and as whole words only, however common they are.

Edge cases: null and empty texts and items match nothing; equal items give a row each; repeated
documents give repeated results; texts are read whole; ties: of matches of equal distance the first
counts; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, map_arrow

ERRORS = 12
MIN_CHARS = 40
#: UTF-8 bytes of items in a block.
BLOCK_BYTES = 2_000_000
WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def budget(n: int, errors: int = ERRORS) -> int:
    return n // errors


def split_pieces(item: str, e: int) -> list[tuple[int, str]]:
    """e + 1 pieces of nearly equal length, with their starts."""
    n = len(item)
    cuts = [n * k // (e + 1) for k in range(e + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any substring of a text, bit-parallel."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.all = (1 << self.n) - 1
        self.last = 1 << (self.n - 1)
        self.at: dict[str, int] = {}
        for k, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | 1 << k

    def best(self, text: str, most: int) -> tuple[int, int]:
        """(distance, end) of the best match, the first if several; (most + 1, -1) if none is within most."""
        every, last, at = self.all, self.last, self.at
        pv, mv, score, best, end = every, 0, self.n, most + 1, -1
        for k, c in enumerate(text):
            eq = at.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (every & ~(xh | pv))
            mh = pv & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph = ph << 1 & every
            mh = mh << 1 & every
            pv = mh | (every & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, end = score, k + 1
        return best, end


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: int = ERRORS):
        self.items = [(i, normal(t)) for i, t in items if t]
        self.items = [(i, t, budget(len(t), errors) if len(t) >= MIN_CHARS else 0) for i, t in self.items if t]
        uses: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for start, piece in split_pieces(t, e):
                uses.setdefault(piece, []).append((k, start))
        self.machine = ahocorasick.Automaton()
        for piece, found in uses.items():
            self.machine.add_word(piece, (len(piece), found))
        if uses:
            self.machine.make_automaton()
        self.empty = not uses
        self.myers: dict[int, Myers] = {}

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item in a text; places are in the normalised text."""
        if self.empty or not text:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        short: dict[int, int] = {}
        for end, (length, found) in self.machine.iter(text):
            for k, start in found:
                n, e = len(self.items[k][1]), self.items[k][2]
                a = end + 1 - length - start
                if n < MIN_CHARS:
                    if k not in short and text[a - 1 : a] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                        short[k] = a
                    continue
                window = [max(0, a - e), min(len(text), a + n + e)]
                if window[1] - window[0] < n - e:
                    continue
                held = windows.setdefault(k, [])
                if held and window[0] <= held[-1][1] and window[1] >= held[-1][0]:
                    held[-1] = [min(held[-1][0], window[0]), max(held[-1][1], window[1])]
                else:
                    held.append(window)
        out = [(self.items[k][0], 0, a, a + len(self.items[k][1])) for k, a in short.items()]
        for k, held in windows.items():
            item, t, e = self.items[k]
            best = None
            for a, b in held:
                exact = text.find(t, a, b)
                if exact >= 0:
                    best = (0, exact, exact + len(t))
                    break
                if k not in self.myers:
                    self.myers[k] = Myers(t)
                d, end = self.myers[k].best(text[a:b], e)
                if d <= e and (best is None or d < best[0]):
                    back, length = Myers(t[::-1]).best(text[a : a + end][::-1], d)
                    best = (d, a + end - length if back == d else max(a, a + end - len(t)), a + end)
            if best:
                out.append((item, *best))
        return out


def blocks(items: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most size bytes (a larger item alone), one after the other; at least one, which may be empty."""
    held, total, any_ = [], 0, False
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if held and total + n > size:
            yield held
            held, total, any_ = [], 0, True
        held.append((r["item_id"], r["text"]))
        total += n
    if held or not any_:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, errors: int = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, end: the best match of each item in each document that has one."""
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, distance int, start bigint, end bigint"
    kind = pa.int64() if "item_id bigint" in schema else pa.int32() if "item_id int" in schema else pa.string()

    def one(block: list[tuple[int, str]]) -> DataFrame:
        def make():
            matcher = Matcher(block, errors)

            def work(batch: pa.RecordBatch):
                rows = [(k, *m) for k, t in enumerate(batch.column(1).to_pylist()) for m in matcher.find(t)]
                at, item, d, a, b = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(item, kind), pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id", "distance", "start", "end"])

            return work

        return map_arrow(docs, make, schema)

    parts = blocks(items, block_bytes)
    block, following = next(parts), next(parts, None)
    if following is None:
        return one(block)
    # several blocks: each one's finds are written before the next is held
    found = [cut(one(block))]
    while following is not None:
        found.append(cut(one(following)))
        following = next(parts, None)
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, items: DataFrame, errors: int = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item was found, all their columns. Rows with a null doc_id are judged by their text like others."""
    names = docs.columns
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def one(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        def make():
            matcher = Matcher(block, errors)

            def work(batch: pa.RecordBatch):
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

            return work

        return map_arrow(docs, make, schema)

    parts = blocks(items, block_bytes)
    docs, following = one(docs, next(parts)), next(parts, None)
    while following is not None:
        # what is left is written before the next block is held
        left = cut(docs)
        docs, following = one(left, following), next(parts, None)
    return docs
