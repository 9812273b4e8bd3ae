"""Periodic runs of words: stretches that repeat a short sequence at least three times.

A run is a stretch of consecutive words whose smallest period q divides it into at least three
periods and that no neighbouring word extends. All of a text's runs are found on a harmonic grid:
for every period p up to a third of the text, the points 0, g, 2g, ... with g = max(p, LEAST // 3);
any run of period p holds a point i with the g words from i equal to the g words from i + p. How far
both sides agree, forward and backward, is searched for in all (period, point) pairs at once, by
halving over prefix hashes; the search's first probe, the g words themselves, leaves few pairs.
Every run is then verified word by word, and where the hashes erred all runs of its period are found
by comparing words; hashes that err can hide no run, as equal words have equal hashes. A stretch found under
several periods stays under the smallest.

Edge cases: a null or blank text has no words and no runs; the same rows again give the same rows
again; ties of exponent go to the smallest start, then period; an empty table gives no rows; other
columns of the input are ignored. A text's pairs are worked off in blocks of PAIRS, so memory stays
bounded for very long texts beside their words themselves. No rows are moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow
from quillstone.llm.shingles import BASE, mix, powers

#: A run is no shorter, in words.
LEAST = 24
#: Pairs of a period and a point that are searched at once.
PAIRS = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def blocks(n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The harmonic grid of n words: period, point and the g of its period, at most about PAIRS at a time, periods ascending."""
    p = np.arange(1, n // 3 + 1)
    g = np.maximum(p, least // 3)
    # points i with i + p + g <= n
    k = np.maximum(0, (n - p - g) // g + 1)
    upto = np.cumsum(k)
    a = 0
    while a < len(p):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        many, total = k[a:b], int(k[a:b].sum())
        if total:
            point = (np.arange(total) - np.repeat(np.cumsum(many) - many, many)) * np.repeat(g[a:b], many)
            yield np.repeat(p[a:b], many), point, np.repeat(g[a:b], many)
        a = b


class Hashes:
    """Equality of stretches of words by prefix sums, modulo 2 ** 64."""

    def __init__(self, ids: np.ndarray):
        self.power = powers(BASE, len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * self.power[: len(ids)], out=self.sums[1:])

    def same(self, i: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether length words from i equal those from i + p."""
        s = self.sums
        return (s[i + length] - s[i]) * self.power[p] == s[i + p + length] - s[i + p]

    def forward(self, i: np.ndarray, p: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from i + p on; low of them are known to."""
        low, high = low.copy(), len(self.sums) - 1 - i - p
        while np.any(low < high):
            mid = (low + high + 1) >> 1
            good = self.same(i, p, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low

    def backward(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How many words before i equal those before i + p."""
        low, high = np.zeros_like(i), i.copy()
        while np.any(low < high):
            mid = (low + high + 1) >> 1
            good = self.same(i - mid, p, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def compared(ids: np.ndarray, p: int, least: int) -> list[tuple[int, int]]:
    """First and end of every stretch of period p that is long enough, by comparing words."""
    same = np.concatenate([[False], ids[:-p] == ids[p:], [False]])
    first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    return [(a, b + p) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b + p - a >= max(least, 3 * p)]


def find(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a sequence of word numbers, as rows of start, length and period by start and period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    if n < least:
        return np.empty((0, 3), np.int64)
    hashes = Hashes(ids)
    for p, i, g in blocks(n, least):
        hit = np.flatnonzero(hashes.same(i, p, g))
        if not len(hit):
            continue
        p, i, g = p[hit], i[hit], g[hit]
        start, end = i - hashes.backward(i, p), i + hashes.forward(i, p, g) + p
        long_ = np.flatnonzero(end - start >= np.maximum(least, 3 * p))
        # the points of one run give it again and again
        _, once = np.unique(np.stack([p[long_], start[long_], end[long_]]), axis=1, return_index=True)
        for q, a, b in zip(*(x[long_][once].tolist() for x in (p, start, end)), strict=True):
            if (a, b) in found:
                continue  # all that has period q inside a run of a smaller period p is the run itself, where p divides q
            # what agrees has equal hashes, so a stretch is never found too short: it is right if its words agree
            right = np.array_equal(ids[a : b - q], ids[a + q : b])
            for stretch in [(a, b)] if right else compared(ids, q, least):
                found.setdefault(stretch, q)
    out = np.array([(a, b - a, q) for (a, b), q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each of n places once a tail of every tenth document repeats its first words; None where nothing changes, as for a null id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def find_runs(docs: DataFrame, least: int = LEAST, change: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; words from 0, by start and period) and collapsed (the kept words, joined by blanks) of each document. change(doc_id, n) may say which of the n words stands at each place instead."""

    def make():
        def work(batch: pa.RecordBatch):
            counts, ends, runs, texts = [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                at = change(doc_id, len(words)) if change else None
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                if at is not None:
                    ids, words = ids[at], [words[k] for k in at]
                got = find(ids, least)
                if len(got):
                    words = [words[k] for k in np.flatnonzero(kept(len(words), got))]
                counts.append(len(ids))
                ends.append(ends[-1] + len(got))
                runs.append(got)
                texts.append(b" ".join(words))
            flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        return work

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period. Null where there is none."""
    big = lambda x: x.cast("decimal(19,0)")
    better = lambda a, b: (big(b["length"]) * big(a["period"]) > big(a["length"]) * big(b["period"]))
    # runs come by start and period, so a later one has to be better
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | better(best, r), r).otherwise(best))
