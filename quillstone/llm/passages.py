"""Fuzzy repeated passages by collinear chaining.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased in A-Z. A
text's seeds are the least-hashed of every WINDOW neighbouring K-word strings, so any K + WINDOW - 1
words that two texts share hold a shared seed. Texts of equal words are one node, and one text
stands for it.

A seed in more than FEW places is common. Those that very many texts hold are known beforehand, by
lossy counting of all seeds in windows, and are never dealt by key. The places of a seed that is not
common are compared in all pairs. Common seeds are matched with their hub, the place in the least
node that holds them, and joined with the common seeds after them to longer runs, which are
compared in all pairs where they are few. Strings of `least` words that hold no SEEDS seeds in few
places, SPAN words apart, and no seed that occurs once only (but for seeds that may hang on words
outside the string) are hashed whole and matched with a hub each, which shares them all; they are
passages as they stand, also where a chain would not link them, at every place of either text: so
every exact passage is found, however often it or parts of it occur, and no group is compared in all
pairs that grows with the input. Passages that differ in words and whose
shared seeds and runs are all common are found only through hubs.

Matches of two nodes are chained: a Fenwick tree over places in the second gives each match the best
chain before it in both texts, a chain being worth K per seed less GAP for every word skipped in
either. Chains of SEEDS seeds are read from both texts, extended while words go on agreeing (and, if
too short, to the nearest words that agree) and aligned word by word; a passage has at least `least`
words on both sides and agrees in at least `identity` of them.

Both ends of a passage are reported, and all documents of a node. What is reported of a document is
which of its words are in a passage and the least document reachable by passages, neither of which
hangs on the choice of hubs where passages are exact.

Edge cases: null and empty texts and texts of fewer than K words have no passages; copies of a
text of at least `least` words are a passage of each other, repeated rows too; texts are read
whole; a null doc_id takes part, and names a class only where it has no other; ties between chains
go to the one that begins first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import ROW, cut, drop, map_arrow, small_batches, some_rows, texts_of
from quillstone.llm.components import connected
from quillstone.llm.licences import NOT_WORD
from quillstone.llm.shingles import BASE, distinct, mix, word_shingles

K, WINDOW = 4, 3
#: Up to so many places of a seed or run are compared in all pairs; longer runs are tried for seeds of more.
FEW, RUNS = 16, (2, 4, 8)
#: Seeds that a task adds up before it hands on those it met twice; in how many texts a seed must be counted to be known as common beforehand, and how many such seeds are held (8 bytes each).
COUNTED, LEAST_HOT, HOT = 1_000_000, 64, 1 << 20
#: Chains of at least so many seeds, over so many words, are aligned.
SEEDS, SPAN = 2, 8
LEAST, IDENTITY = 50, 0.8
GAP = 0.1
#: Words read beyond the ends of a chain.
MARGIN = 2 * LEAST
PASSAGE = "node bigint, hub bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint, agree bigint"
#: An extension ends when its score falls so far below its best; a word that agrees is 1, one that differs -DIFFER.
DROP, DIFFER = 8, 3


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(NOT_WORD).split() if text else []


def seeds_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's seeds."""
    if len(words) < K:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_shingles(words, K)
    w, step, places = min(WINDOW, len(h)), 1 << 23, []
    for at in range(0, len(h) - w + 1, step):
        part = h[at : at + step + w - 1]
        keys = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        least = reduce(np.minimum, [keys[k : len(keys) - w + 1 + k] for k in range(w)])
        places.append((least & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    places = np.concatenate(places)
    # the least of neighbouring windows never lies further left
    places = places[np.append(True, places[1:] != places[:-1])]
    return h[places], places


def chains(matches: list[tuple[int, int]], k: int = 6, gap: float = GAP) -> list[list[tuple[int, int]]]:
    """Collinear chains of matches (place, hub place), best first; each match is in one at most."""
    matches = sorted(set(matches), key=lambda m: (m[0], -m[1]))
    order = {h: r + 1 for r, h in enumerate(sorted({h for _, h in matches}))}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(order) + 1)
    score, before = [], []
    # places are entered once all matches of one place are asked, as a chain takes one of them
    for i, (p, h) in enumerate(matches):
        best, r = (float("-inf"), -1), order[h] - 1
        while r > 0:
            best = max(best, tree[r])
            r &= r - 1
        value = best[0] - gap * (p + h)
        score.append(k + max(0.0, value))
        before.append(best[1] if value > 0 else -1)
        r, entry = order[h], (score[i] + gap * (p + h), i)
        while r < len(tree):
            tree[r] = max(tree[r], entry)
            r += r & -r
    out, used = [], [False] * len(matches)
    for i in sorted(range(len(matches)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(matches[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def extended(a: list[bytes], b: list[bytes], i: int, j: int, step: int) -> int:
    """By how many words the agreement goes on from a[i], b[j] in the direction of step."""
    score = best = n = done = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - DROP:
        n += 1
        score += 1 if a[i] == b[j] else -DIFFER
        if score > best:
            best, done = score, n
        i, j = i + step, j + step
    return done


def outward(a: list[bytes], b: list[bytes], i: int, j: int, step: int, most: int) -> list[tuple[int, int]]:
    """(words, words that agree) of every extension from a[i], b[j] of at most `most` words that ends in a word that agrees, and (0, 0)."""
    out, n = [(0, 0)], 0
    while 0 <= i < len(a) and 0 <= j < len(b) and n < most:
        n += 1
        if a[i] == b[j]:
            out.append((n, out[-1][1] + 1))
        i, j = i + step, j + step
    return out


def agreeing(a: list[bytes], b: list[bytes]) -> int:
    """Words of the longest common subsequence, bit-parallel."""
    at: dict[bytes, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    every = (1 << len(a)) - 1
    v = every
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def looked_at(docs: DataFrame) -> DataFrame:
    """doc_id, row, num (a number of the row's own), digest (128 bits of the words; null if too short for a seed), n (words), keys and places of the seeds of each document; and, in rows with a token, how often a window's texts hold a seed that more than one holds."""
    docs = docs.select("doc_id", F.expr(ROW).alias("row"), "text")
    names = ["doc_id", "row", "num", "digest", "n", "keys", "places", "token", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        held, seen, total, id_type, num = [], set(), 0, None, (context.partitionId() if context else 0) << 33
        types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def common() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(tokens)))
            out = tokens[first[n > 1]].view(np.int64)
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(out), t) for t in (id_type, *types)), pa.array(out), pa.array(n[n > 1].astype(np.int32))], names)

        for batch in batches:
            digest, n, keys, places, id_type = [], [], [], [], batch.schema.field(0).type
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                s, p = seeds_of(words)
                n.append(len(words)), keys.append(s.view(np.int64)), places.append(p)
                digest.append(blake2b(b" ".join(words), digest_size=16).digest() if len(s) else None)
                if len(s) and digest[-1] not in seen:
                    seen.add(digest[-1])
                    held.append(distinct(s))
                    total += len(held[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.arange(num, num + len(n))), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), lists(keys), lists(places), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32())], names
            )
            num += len(n)
            if total >= COUNTED:
                yield common()
                held, seen, total = [], set(), 0
        if total:
            yield common()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row binary, num bigint, digest binary, n bigint, keys array<bigint>, places array<bigint>, token bigint, count int")


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of numbers as a column."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]).astype(np.int64)))


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """A column of lists of numbers as arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def hot_seeds(counts: DataFrame) -> np.ndarray:
    """The most common seeds of counts (token, count), sorted."""
    top = counts.groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= LEAST_HOT).orderBy(F.desc("n"), "token").limit(HOT)
    return np.sort(top.select("token").toArrow()["token"].to_numpy().view(np.uint64))


def places_of(seeds: DataFrame, hot: np.ndarray, common: bool) -> DataFrame:
    """key, node, p: the seeds of seeds (node, keys, places) that are in hot, or those that are not."""
    shared = seeds.sparkSession.sparkContext.broadcast(hot)

    def make():
        def work(batch: pa.RecordBatch):
            table, keys = shared.value, batch.column(1).flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            s = keys.view(np.uint64)
            is_hot = table[np.minimum(np.searchsorted(table, s), len(table) - 1)] == s if len(table) and len(s) else np.zeros(len(s), bool)
            wanted = is_hot if common else ~is_hot
            yield pa.RecordBatch.from_arrays([pa.array(keys[wanted]), pa.array(node[wanted]), batch.column(2).flatten().filter(pa.array(wanted))], ["key", "node", "p"])

        return work

    return map_arrow(seeds.select("node", "keys", "places"), make, "key bigint, node bigint, p bigint")


def _windows(pairs: DataFrame, texts: DataFrame, side: str) -> DataFrame:
    """Adds w{side}, the words around the chain, and o{side}, the place of the first."""
    names = pairs.columns
    first, last = names.index(f"{side}1"), names.index(f"{side}2")

    def make():
        def work(batch: pa.RecordBatch):
            out, offset, key, words = [], [], None, []
            for row, a, b, text in zip(batch.column(names.index(f"{side}row")).to_pylist(), batch.column(first).to_pylist(), batch.column(last).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if row != key:
                    key, words = row, words_of(text)
                offset.append(max(0, a - MARGIN))
                out.append(b" ".join(words[offset[-1] : b + MARGIN]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.binary()), pa.array(offset, pa.int64())], [*names, f"w{side}", f"o{side}"])

        return work

    joined = pairs.join(texts.select(F.col("row").alias(f"{side}row"), F.col("text").alias("_text")), f"{side}row").select(*names, "_text")
    return map_arrow(joined, make, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + f", w{side} binary, o{side} bigint")


def _dealt_once(keyed: DataFrame) -> DataFrame:
    """key, node, p, c (places of the key, FEW + 1 if more than FEW) of the keys that several nodes hold. Most keys have one place and none very many, so whole rows are dealt by key and sorted, once."""
    of_key = Window.partitionBy("key")
    counted = keyed.select("key", "node", "p", F.count(F.lit(1)).over(of_key).alias("c"), F.min("node").over(of_key).alias("lo"), F.max("node").over(of_key).alias("hi"))
    return cut(counted.where("lo <> hi").select("key", "node", "p", F.least("c", F.lit(FEW + 1)).cast("int").alias("c")))


def _with_hubs(rows: DataFrame) -> DataFrame:
    """rows (key, node, p, ...) with hub, the least node that holds the key and its place there. A join by a table's keys can be split where a key is hot."""
    hubs = cut(rows.groupBy("key").agg(F.min(F.struct("node", "p")).alias("hub")))
    return rows.join(hubs, "key")


def _shared(keyed: DataFrame) -> DataFrame:
    """key, node, p, c, hub, top (the last place of the greatest node) of the keys of a table that several nodes hold; keys are counted where they lie."""
    keys = keyed.groupBy("key").agg(F.min(F.struct("node", "p")).alias("hub"), F.max(F.struct("node", "p")).alias("top"), F.count(F.lit(1)).alias("c")).where("hub.node <> top.node")
    keys = cut(keys.select("key", "hub", "top", F.least("c", F.lit(FEW + 1)).cast("int").alias("c")))
    out = cut(keyed.join(keys, "key"))
    drop(keys)
    return out


def _match(p: Column, h: Column) -> Column:
    return F.shiftleft(p, 32).bitwiseOR(h).alias("m")


def _pairs(few: DataFrame) -> DataFrame:
    """node, hub, m (both places): all pairs of places of different nodes under one key (key, node, p) of at most FEW places."""
    held = few.groupBy("key").agg(F.collect_list(F.struct("node", "p")).alias("places"))
    pairs = held.select("places", F.explode("places").alias("a")).select("a", F.explode(F.filter("places", lambda b: b["node"] < F.col("a.node"))).alias("b"))
    return pairs.select("a.node", F.col("b.node").alias("hub"), _match(F.col("a.p"), F.col("b.p")))


def _star(held: DataFrame, after: int = 0) -> DataFrame:
    """node, hub, m (both places, `after` words further on): each place under a key with the key's hub."""
    return held.where("node <> hub.node").select("node", F.col("hub.node").alias("hub"), _match(F.col("p") + after, F.col("hub.p") + after))


def _exact(whole: DataFrame, least: int) -> DataFrame:
    """node, hub, a1, a2, b1, b2, agree: the strings of `least` words of whole (key, node, p, hub, top) as passages, those that meet on a diagonal as one. A hub's own further places of a string are matched with its top."""
    own = F.col("node") == F.col("hub.node")
    twice = whole.where(~own | (F.col("p") != F.col("hub.p")))
    pairs = twice.select(F.when(own, F.col("top.node")).otherwise(F.col("node")).alias("a"), F.col("hub.node").alias("b"), F.when(own, _match(F.col("top.p"), F.col("p"))).otherwise(_match(F.col("p"), F.col("hub.p"))).alias("m"))

    def make():
        def work(batch: pa.RecordBatch):
            rows = []
            for m in arrays(batch.column(2)):
                p, h = m >> 32, m & ((1 << 32) - 1)
                order = np.lexsort((p, p - h))
                p, h = p[order], h[order]
                first = np.flatnonzero(np.append(True, (np.diff(p - h) != 0) | (np.diff(p) > least)))
                last = np.append(first[1:], len(p)) - 1
                rows.append((p[first], p[last] + least, h[first], h[last] + least, p[last] + least - p[first]))
            n = np.array([len(r[0]) for r in rows], np.int64)
            owners = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n) for k in (0, 1)]
            spans = [np.concatenate([np.empty(0, np.int64), *(r[k] for r in rows)]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*owners, *spans)], ["node", "hub", "a1", "a2", "b1", "b2", "agree"])

        return work

    # a pair's matches are at most the words of both
    return map_arrow(pairs.groupBy("a", "b").agg(F.collect_list("m").alias("m")), make, PASSAGE)


def _runs(common: DataFrame) -> DataFrame:
    """key, node, p: runs of RUNS common seeds of common (node, keys, places) between which are no other seeds."""

    def make():
        def work(batch: pa.RecordBatch):
            # all texts of a batch at once: a text's places begin where the last one's end
            flat = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False)
            text = lambda k: np.repeat(np.arange(batch.num_rows), batch.column(k).value_lengths().to_numpy(zero_copy_only=False))
            s, p, owner = flat(1).view(np.uint64), flat(2), text(2)
            # common seeds parted by another seed have different numbers of these before them, of two texts different owners
            part = np.searchsorted((text(3) << 32) + flat(3), (owner << 32) + p)
            node = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            for length in RUNS:
                m = len(p) - length + 1
                if m > 0:
                    h = np.full(m, length, np.uint64)
                    for k in range(length):
                        h = mix(h * np.uint64(BASE) + s[k : k + m])
                    whole = (part[:m] == part[length - 1 :]) & (owner[:m] == owner[length - 1 :])
                    yield pa.RecordBatch.from_arrays([pa.array(h[whole].view(np.int64)), pa.array(node[:m][whole]), pa.array(p[:m][whole])], ["key", "node", "p"])

        return work

    return map_arrow(common.select("node", "keys", "places", "others"), make, "key bigint, node bigint, p bigint")


def zones(n: int, places: np.ndarray, few: np.ndarray, others: np.ndarray, least: int) -> np.ndarray:
    """Starts of the strings of `least` words, of n, that hold a common seed (at places), no SEEDS of few that span SPAN words, and none at others; but for few and others that hang on words outside."""
    starts = np.arange(max(0, n - least + 1))

    def within(at: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
        # a seed is in a string if it begins there and ends there; WINDOW - 1 strings on either side decide whether it is one
        return np.searchsorted(at, starts + edge), np.searchsorted(at, starts + least - K - edge, "right")

    places, few, others = map(np.sort, (places, few, others))
    (a, b), (c, d), (e, f) = within(places, 0), within(few, WINDOW - 1), within(others, WINDOW - 1)
    found = (d - c >= SEEDS) & (few[np.maximum(d - 1, 0)] - few[np.minimum(c, len(few) - 1)] + K >= SPAN) if len(few) else np.zeros(len(starts), bool)
    return starts[(b > a) & ~found & (e >= f)]


def _whole(common: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """key, node, p: the strings of `least` words that SEEDS seeds in few places need not find, of common (row, node, places, few, others, n)."""

    def make_some():
        def work(batch: pa.RecordBatch):
            found = [bool(len(zones(n, *x, least))) for n, *x in zip(batch.column(2).to_pylist(), *(arrays(batch.column(k)) for k in (3, 4, 5)), strict=True)]
            yield batch.filter(pa.array(found, pa.bool_()))

        return work

    schema = "row binary, node bigint, n bigint, places array<bigint>, few array<bigint>, others array<bigint>"
    some = cut(map_arrow(common.select("row", "node", "n", "places", "few", "others"), make_some, schema))
    texts = texts_of(docs, some.select("row")).join(some, "row").select("text", "node", "places", "few", "others")

    def make():
        def work(batch: pa.RecordBatch):
            key, node, p = [], [], []
            for text, n, places, few, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(arrays(batch.column(k)) for k in (2, 3, 4)), strict=True):
                words = words_of(text)
                at = zones(len(words), places, few, others, least)
                key.append(word_shingles(words, least)[at].view(np.int64)), node.append(np.full(len(at), n, np.int64)), p.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (key, node, p)], ["key", "node", "p"])

        return work

    out = cut(map_arrow(texts, make, "key bigint, node bigint, p bigint"))
    drop(some)
    return out


def aligned(a: list[bytes], b: list[bytes], a1: int, a2: int, b1: int, b2: int, least: int, identity: float) -> tuple[int, int, int, int, int] | None:
    """The passage around words a1 to a2 - 1 of a and b1 to b2 - 1 of b, and how many words agree; None if it is too short or too different."""
    left, right = extended(a, b, a1 - 1, b1 - 1, -1), extended(a, b, a2, b2, 1)
    a1, b1, a2, b2 = a1 - left, b1 - left, a2 + right, b2 + right
    n = agreeing(a[a1:a2], b[b1:b2])
    if min(a2 - a1, b2 - b1) < least:
        left, right = outward(a, b, a1 - 1, b1 - 1, -1, least), outward(a, b, a2, b2, 1, least)
        fits = [(x + y, x, y, n + m + k) for x, m in left for y, k in right if min(a2 - a1, b2 - b1) + x + y >= least and n + m + k >= identity * (max(a2 - a1, b2 - b1) + x + y)]
        if not fits:
            return None
        _, x, y, n = min(fits)
        a1, b1, a2, b2 = a1 - x, b1 - x, a2 + y, b2 + y
    return (a1, a2, b1, b2, n) if n >= identity * max(a2 - a1, b2 - b1) else None


def find(docs: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Members (doc_id, node, n), passages (node, hub, a1, a2, b1, b2, agree): words a1 to a2 - 1 of node against b1 to b2 - 1 of hub; and the tables to drop after use."""
    looked = cut(looked_at(docs))
    every = cut(looked.where("token is null").select("doc_id", "row", "num", "digest", "n"))
    hot = hot_seeds(looked.where("token is not null").select("token", "count"))
    nodes = cut(every.where("digest is not null").groupBy("digest").agg(F.min("num").alias("node"), F.min_by("row", "num").alias("row"), F.first("n").alias("n")))
    copies = cut(every.where("digest is not null").select("num").join(nodes.select(F.col("node").alias("num")), "num", "left_anti"))
    seeds = looked.where("digest is not null").select("num", "keys", "places").join(some_rows(copies), "num", "left_anti").withColumnRenamed("num", "node")

    held = _dealt_once(places_of(seeds, hot, False))
    hot_places = cut(places_of(seeds, hot, True))
    hot_held = _with_hubs(hot_places)

    by_node = held.where(F.col("c") > FEW).select("node", "key", "p").unionByName(hot_places.select("node", "key", "p")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("p", "key"))).alias("common"))
    few_of = held.where(F.col("c") <= FEW).groupBy("node").agg(F.collect_list("p").alias("few"))
    # of the seeds not known as common beforehand, those not held by several nodes part zones and runs
    common = by_node.join(few_of, "node", "left").join(seeds.select("node", "places"), "node").join(nodes.select("node", "row", "n"), "node")
    common = common.select("row", "node", "n", F.col("common.p").alias("places"), F.col("common.key").alias("keys"), F.coalesce("few", F.array().cast("array<bigint>")).alias("few"), F.col("places").alias("own"))
    common = cut(common.select("row", "node", "n", "places", "keys", "few", F.array_except(F.array_except("own", "places"), "few").alias("single")))
    drop(looked, copies)
    single = F.array_sort("single")
    found_runs = cut(_runs(common.select("node", "keys", "places", F.array_sort(F.concat("single", "few")).alias("others"))))
    runs = _shared(found_runs)
    found_whole = _whole(common.select("row", "node", "n", "places", "few", single.alias("others")), docs, least)
    whole = _shared(found_whole)
    drop(found_runs, found_whole)
    few = lambda x: x.where(F.col("c") <= FEW).select("key", "node", "p")
    # the last seed of an exact passage stands for its end
    parts = [_pairs(few(held)), _pairs(few(runs)), _star(_with_hubs(held.where(F.col("c") > FEW))), _star(hot_held), _star(whole), _star(whole, least - K)]
    # a node's matches with a hub are at most its own places times FEW
    pairs = reduce(DataFrame.unionByName, parts).groupBy("node", "hub").agg(F.collect_list("m").alias("m")).where(F.size("m") >= SEEDS)

    def make_chains():
        def work(batch: pa.RecordBatch):
            out = []
            for node, hub, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for c in chains([divmod(x, 1 << 32) for x in m], K):
                    if len(c) >= SEEDS and min(c[-1][0] - c[0][0], c[-1][1] - c[0][1]) + K >= SPAN:
                        out.append((node, hub, c[0][0], c[-1][0] + K, c[0][1], c[-1][1] + K))
            columns = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "hub", "a1", "a2", "b1", "b2"])

        return work

    found = cut(map_arrow(pairs, make_chains, "node bigint, hub bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint"))
    exact = cut(_exact(whole, least))
    drop(held, hot_places, common, runs, whole)
    row_of = lambda node, row: nodes.select(F.col("node").alias(node), F.col("row").alias(row))
    placed = cut(found.join(row_of("node", "arow"), "node").join(row_of("hub", "brow"), "hub").select("node", "hub", "arow", "brow", "a1", "a2", "b1", "b2"))
    wanted = cut(placed.select(F.explode(F.array("arow", "brow")).alias("row")).distinct())
    texts = cut(texts_of(docs, wanted))
    both = _windows(_windows(placed, texts, "a"), texts, "b")
    names = both.columns

    def align():
        get = {c: names.index(c) for c in names}

        def work(batch: pa.RecordBatch):
            rows = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                oa, ob = r[get["oa"]], r[get["ob"]]
                got = aligned(r[get["wa"]].split(), r[get["wb"]].split(), r[get["a1"]] - oa, r[get["a2"]] - oa, r[get["b1"]] - ob, r[get["b2"]] - ob, least, identity)
                if got:
                    rows.append((r[get["node"]], r[get["hub"]], got[0] + oa, got[1] + oa, got[2] + ob, got[3] + ob, got[4]))
            columns = zip(*rows, strict=True) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "hub", "a1", "a2", "b1", "b2", "agree"])

        return work

    # chains of one passage end in the same words
    passages = cut(map_arrow(both, align, PASSAGE).unionByName(exact).distinct())
    members = cut(every.join(nodes.select("digest", "node"), "digest", "left").select("doc_id", "node", "n"))
    drop(found, placed, wanted, texts, every, nodes, exact)
    return members, passages, [members, passages]


def _covered(spans: Column) -> Column:
    """runs, words, end and longest of sorted spans (s, e): maximal runs, the words in them, the last end, the longest span."""
    start = F.struct(F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("longest"))

    def add(x: Column, span: Column) -> Column:
        apart = span["s"] > x["end"]
        return F.struct(
            (x["runs"] + F.when(apart, 1).otherwise(0)).alias("runs"), (x["words"] + F.when(apart, span["e"] - span["s"]).otherwise(F.greatest(span["e"] - x["end"], F.lit(0)))).alias("words"),
            F.greatest(x["end"], span["e"]).alias("end"), F.greatest(x["longest"], span["e"] - span["s"]).alias("longest"),
        )

    return F.aggregate(spans, start, add)


def repeated(docs: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """Documents that hold a repeated passage: doc_id, class_id (least id of equal texts), n_copies, component_id (least id reachable by passages), n_passages (maximal runs of words in passages), n_words (in them), first_word, end_word, longest (words of a passage)."""
    members, passages, made = find(docs, least, identity)
    classes = cut(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n")))
    linked = connected(passages.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    least_of = classes.join(linked, "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    reached = linked.join(least_of, "component").select("node", "component_id")
    ends = passages.select("node", F.col("a1").alias("s"), F.col("a2").alias("e")).unionByName(passages.select(F.col("hub").alias("node"), F.col("b1").alias("s"), F.col("b2").alias("e")))
    # a span at most for each word of the text
    ends = ends.groupBy("node", "s").agg(F.max("e").alias("e")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    ends = ends.select("node", F.col("spans")[0]["s"].alias("first"), _covered(F.col("spans")).alias("x"))
    copied = (F.col("n_copies") > 1) & (F.col("n") >= least)
    flagged = classes.join(ends, "node", "left").join(reached, "node", "left").where(copied | F.col("x").isNotNull())
    whole = lambda of_copy, else_: F.when(copied, of_copy).otherwise(else_).cast("long")
    flagged = flagged.select(
        "node", "class_id", "n_copies", F.coalesce("component_id", "class_id").alias("component_id"), whole(F.lit(1), F.col("x.runs")).alias("n_passages"), whole(F.col("n"), F.col("x.words")).alias("n_words"),
        whole(F.lit(0), F.col("first")).alias("first_word"), whole(F.col("n"), F.col("x.end")).alias("end_word"), whole(F.col("n"), F.col("x.longest")).alias("longest"),
    )
    out = cut(members.select("doc_id", "node").join(flagged, "node").drop("node"))
    drop(*made, classes, linked)
    return out
