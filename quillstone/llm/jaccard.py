"""N-gram Jaccard join by token-combination prefixes, and the classes it links.

A text's tokens are its distinct k-word shingles, hashed. Two texts link when the shingles they
share are at least num / den of those that either has. Texts of equal sets are one node.

Tokens are ordered rare ones first (each class by hash). A token is frequent if it is in the table
of the FREQUENT most common ones, by counts of all tokens of all documents; others are rare.
Counting is lossy: a task adds up windows of WINDOW tokens and hands on those it met twice, so a
token that is missed is in no more documents than there are windows. The table only steers the
order: any table gives the same links. With n tokens a node may miss at most
d = n - ceil(n num / den) of them, and node and partner together at most D = floor(n (den - num) / num).
So if it has more than d rare tokens, its first d + 1 hold one that is shared. If it has only r, and
none is shared, the rest of both has at most D - r that are not shared; among its first
2 (D - r) + 2 frequent tokens, fewer than half the places between neighbours are then disturbed, so
two neighbouring frequent tokens are neighbours in the partner too. Signatures are therefore the
rare tokens of the prefix, singly, and the pairs of neighbouring frequent tokens of the extended
prefix.

Nodes that meet at a rare token are few. A pair of frequent ones may be held by any number of
nodes, but two that meet there and share no rare token (else they meet at that) share at most
m = n - r of either's tokens: the bound that keeps large groups from being compared in all pairs. A
signature's nodes are first compared with its hub, the node with the fewest rare tokens; of what
may link at all, it links most. Links make components, and pairs inside one need no comparing. What
is left are the pairs of one signature in different components that the bound lets through. One of
such a pair lies outside the signature's largest component, so only those outside are joined with
all: a group whose hub linked nearly all of it is no longer compared with itself. Signatures that
the same nodes hold are joined once. Sizes and parity bitmaps that bound the likeness below the
threshold are a condition of that join, so it makes only rows that are then compared, by counting
the shared shingles.

Edge cases: null, empty and blank texts have no shingles, no partners and are components of their
own; a text of fewer than k words is one shingle; texts are read whole; repeated rows are equal
texts; a null doc_id takes part, and is the component's id only where it has no other; ties do not
arise, as classes hang on links alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ROW, cut, drop, map_arrow, small_batches, some_rows, texts_of
from quillstone.llm.components import connected
from quillstone.llm.shingles import distinct, mix, shingle_set

#: Tokens in the table of frequent ones (8 bytes each), and in how many documents they must be.
FREQUENT, LEAST_FREQUENT = 1 << 20, 12
#: Tokens that a task adds up before it hands them on.
WINDOW = 4_000_000
#: Bits of the parity bitmap, kept as longs.
PARITY = 512


@dataclass(frozen=True)
class Rule:
    """k-word shingles; linked if den * shared >= num * all."""

    k: int = 4
    num: int = 85
    den: int = 100

    def __post_init__(self):
        if not 4 * self.den <= 5 * self.num <= 5 * self.den:
            raise ValueError("neighbouring frequent tokens are sure to be shared from a likeness of 0.8")

    def missing(self, n: int) -> int:
        return n - -(-n * self.num // self.den)

    def apart(self, n: int) -> int:
        return n * (self.den - self.num) // self.num


def signatures(tokens: np.ndarray, rule: Rule, frequent: np.ndarray) -> tuple[np.ndarray, int | None]:
    """The signatures of a sorted set of tokens (even: of one rare token; odd: of two frequent ones), and how many tokens are not rare, where that decides.

    frequent is sorted. Sets of few tokens that must be equal to link have no signatures.
    """
    n = len(tokens)
    both, one = rule.apart(n), rule.missing(n) + 1
    if not n or not both:
        return np.empty(0, np.uint64), None
    common = np.zeros(n, bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    rare, low = tokens[~common], np.uint64(1)
    if len(rare) >= one:
        return distinct(rare[:one] & ~low), None
    often = tokens[common][: 2 * (both - len(rare)) + 2]
    return distinct(np.concatenate([rare & ~low, mix(often[:-1] * np.uint64(3) + mix(often[1:])) | low])), n - len(rare)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Each bit says whether an odd number of tokens falls on it."""
    bits = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def count_frequent(docs: DataFrame, k: int) -> np.ndarray:
    """The FREQUENT tokens that most documents hold, of those that a window holds twice, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def common() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            n = np.diff(np.append(first, len(tokens)))
            twice = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[first[twice]].view(np.int64)), pa.array(n[twice].astype(np.int32))], ["token", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(shingle_set(text, k))
                total += len(held[-1])
                if total >= WINDOW:
                    yield common()
                    held, total = [], 0
        if total:
            yield common()

    small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(run, "token bigint, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()["token"].to_numpy()
    return np.sort(top.view(np.uint64))


def sketch(docs: DataFrame, rule: Rule, frequent: np.ndarray) -> DataFrame:
    """doc_id, row, n (set size), node (128-bit hash of the set), m (tokens that are not rare; null: enough are), parity and signatures of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        table = shared.value

        def work(batch: pa.RecordBatch):
            n, node, m, bits, sigs = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, rule.k)
                n.append(len(s))
                node.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bits.append(parity(s))
                x, count = signatures(s, rule, table)
                m.append(count), sigs.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(m, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "row", "n", "node", "m", "parity", "sigs"])

        return work

    docs = docs.select("doc_id", F.expr(ROW).alias("row"), "text")
    return map_arrow(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row binary, n bigint, node binary, m bigint, parity array<bigint>, sigs array<bigint>")


def _fits(rule: Rule, a: str, b: str) -> Column:
    return F.least(a, b) * rule.den >= F.greatest(a, b) * rule.num


def _may_link(rule: Rule, n1: str, m1: str, n2: str, m2: str) -> Column:
    """Whether two nodes that meet at sig may link: there they share at most the tokens that are not rare, if sig is of frequent ones."""
    most = F.least(m1, m2)
    return _fits(rule, n1, n2) & ((F.col("sig").bitwiseAND(F.lit(1)) == 0) | (most * rule.den >= (F.col(n1) + F.col(n2) - most) * rule.num))


def _may_differ(rule: Rule, n1: str, n2: str, differ: Column) -> Column:
    """Whether sets of these sizes may link though their parity bitmaps differ in so many bits."""
    # shared <= (n1 + n2 - differ) / 2, so all >= (n1 + n2 + differ) / 2
    return (F.col(n1) + F.col(n2) - differ) * rule.den >= (F.col(n1) + F.col(n2) + differ) * rule.num


def _bits(name: str) -> list[Column]:
    """The parity bitmap as columns name0, name1, ..., which a join compares in compiled code."""
    return [F.get("parity", F.lit(k)).alias(f"{name}{k}") for k in range(PARITY // 64)]


def _parted(held: DataFrame) -> DataFrame:
    """sig and big: the signatures that nodes of several components c hold, and of these the one with most nodes; of signatures that the same nodes hold, the least of either kind."""
    each = held.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("num")).alias("x"), F.bit_xor(F.xxhash64("num", F.lit(1))).alias("y"))
    whole = each.groupBy("sig").agg(F.max(F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("parts"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("parts > 1")
    return whole.groupBy("x", "y", F.col("sig").bitwiseAND(F.lit(1))).agg(F.min(F.struct("sig", F.col("most.c").alias("big"))).alias("of")).select("of.sig", "of.big")


def by_parity(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sizes and parity bitmaps allow a link, with the rows da and db that hold them."""
    side = lambda x: nodes.select(F.col("num").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"), F.col("row").alias(f"d{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(_fits(rule, "na", "nb") & _may_differ(rule, "na", "nb", differ)).select("a", "b", "da", "db")


def verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, da, db) that link, by counting shared shingles."""
    side = lambda x: texts.select(F.col("row").alias(f"d{x}"), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b"), "db").join(side("a"), "da").select("a", "b", "da", "ta", "tb")

    def make():
        held: dict[int, np.ndarray] = {}

        def tokens(key, text):
            if key not in held:
                if len(held) >= 64:
                    held.clear()
                held[key] = shingle_set(text, rule.k)
            return held[key]

        def work(batch: pa.RecordBatch):
            keep = []
            for a, ta, tb in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                x, y = tokens(a, ta), shingle_set(tb, rule.k)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * rule.den >= (len(x) + len(y) - shared) * rule.num)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return work

    return map_arrow(both, make, "a bigint, b bigint")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, da, db) that link, as a table of its own."""
    rows = cut(pairs.select(F.explode(F.array("da", "db")).alias("row")).distinct())
    texts = cut(texts_of(docs, rows))
    found = cut(verify(pairs, texts, rule))
    drop(rows, texts)
    return found


def link(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, row, n and c, the number of the row's component (null without shingles); a table of its own."""
    sketched = cut(sketch(docs, rule, count_frequent(docs, rule.k)))
    nodes = sketched.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "m", "parity", "sigs")])
    nodes = cut(nodes.withColumn("num", F.monotonically_increasing_id()))
    rows = cut(sketched.select("doc_id", "row", "n", "node"))
    drop(sketched)
    held = nodes.select("num", "n", "m", F.explode("sigs").alias("sig"))
    several = held.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("sig")
    # tables of keys are cut, so that a join by them can be split where a signature is hot
    several = cut(several)
    held = cut(held.join(several, "sig"))
    drop(several)

    rare = F.when(F.col("sig").bitwiseAND(F.lit(1)) == 1, F.col("n") - F.col("m")).otherwise(0)
    hub = held.groupBy("sig").agg(F.min(F.struct(rare.alias("r"), F.xxhash64("num").alias("h"), "num", "n", "m")).alias("hub"))
    hub = cut(hub.select("sig", F.col("hub.num").alias("num2"), F.col("hub.n").alias("n2"), F.col("hub.m").alias("m2")))
    pair = [F.least("num", "num2").alias("a"), F.greatest("num", "num2").alias("b")]
    first = held.join(hub, "sig").where((F.col("num") != F.col("num2")) & _may_link(rule, "n", "m", "n2", "m2")).select(*pair).distinct()
    first = cut(by_parity(first, nodes, rule))
    drop(hub)
    links = _linked(docs, nodes, first, rule)
    stars = connected(links)
    drop(links)

    known = nodes.join(stars.select(F.col("node").alias("num"), F.col("component").alias("c")), "num", "left").select("num", F.coalesce("c", "num").alias("c"), *_bits("p"))
    known = cut(known)
    parted = cut(_parted(held.join(known.select("num", "c"), "num")))
    now = cut(held.join(parted, "sig").join(known, "num"))
    drop(held, parted, known)
    side = [F.col(c).alias(f"{c}2") for c in ("num", "n", "m", "c")] + [F.col(f"p{k}").alias(f"q{k}") for k in range(PARITY // 64)]
    lesser = now.where("c <> big")
    apart = (F.col("c") != F.col("c2")) & ((F.col("c2") == F.col("big")) | (F.col("c") < F.col("c2")))
    near = _may_differ(rule, "n", "n2", reduce(add, [F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(PARITY // 64)]))
    rest = lesser.join(now.select("sig", *side), "sig").where(apart & _may_link(rule, "n", "m", "n2", "m2") & near).select(*pair).distinct()
    rest = cut(by_parity(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), nodes, rule))
    drop(now, first)
    links = _linked(docs, nodes, rest, rule)
    component = connected(links.unionByName(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    named = nodes.select("node", F.col("num").alias("c0")).join(component.select(F.col("node").alias("c0"), "component"), "c0", "left").select("node", F.coalesce("component", "c0").alias("c"))
    out = cut(rows.join(named, "node", "left").select("doc_id", "row", "n", "c"))
    drop(rows, nodes, rest, links, stars, component)
    return out


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    rows = link(docs, rule)
    lowest = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return rows.join(lowest, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row of each class of documents, all columns: of the least doc_id (a null one is the greatest), of equal ids by the hash of the text.

    Rows are told apart by id and text, so rows of one id but different texts are judged by their
    own classes. Of rows repeated with id and text one stays, whichever its other columns; rows
    without shingles are in no class and stay, but for repeats of one id.
    """
    rows = link(docs, rule)
    least = rows.where("c is not null").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("keep")).select("c", F.col("keep.row").alias("keep"))
    each = rows.where("c is not null or doc_id is not null").groupBy("row", "c").agg(F.count(F.lit(1)).alias("copies"))
    each = each.join(least, "c", "left").select("row", "copies", (F.col("c").isNull() | (F.col("row") == F.col("keep"))).alias("stays"))
    each = cut(each.where("not stays or copies > 1"))
    drop(rows)
    named = docs.select(F.expr(ROW).alias("_row"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns)])
    single = named.join(some_rows(each.select(F.col("row").alias("_row"))), "_row", "left_anti")
    again = named.join(some_rows(each.where("stays").select(F.col("row").alias("_row"))), "_row", "left_semi").dropDuplicates(["_row"])
    return single.unionByName(again).select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])
