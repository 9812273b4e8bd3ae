"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A document is the set of its hashed features: words, pairs of neighbouring words, the shapes of
tokens (runs of capitals, small letters and digits, with the signs between), pairs of neighbouring
shapes, and how often a token repeats the one before. Two generative models give each bucket its
rate per document: the raw model counts all documents, the target model the labelled ones of good
quality that are not toxic. Labels are joined from a sample of at most MAX_LABELS labelled documents
(those of the least hashes), so they can be broadcast; a fifth of them is held out.

A bucket's log ratio is ``log((t + C) / (e + C))``, t being its count in the target and e the
count expected if the target were like the raw text; ratios are 0 unless t is more than MIN_SIGMA
deviations away (PAIR_SIGMA for pairs of words, of which there are so many that some lie far off by
chance). A document's importance weight is the sum of its features' negative ratios plus the mean,
over all its features, of the positive ones: those are small and on common words, and summed they
would reward length. The number k of documents to keep is how many reach the cutoff that best splits
the held-out labels; the sample is the k greatest values of ``weight / TEMPERATURE + Gumbel noise``
of the document's id: resampling without replacement, with odds that fall by e for each TEMPERATURE
of weight. Gumbel noise has hardly any lower tail, so texts well above the cutoff stay.

Edge cases: null and empty texts have no features and weight 0; a null doc_id has no label;
several labels of a document count as the worst; without good or without bad labels everything
has weight 0 or the cutoff CUTOFF holds; ties: rows of equal keys (repeated rows) are kept or left
together, so more than k may stay; an empty table gives no rows; columns of the input pass unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop, map_arrow, small_batches
from quillstone.llm.shingles import distinct, mix

#: Buckets of single features and pairs of shapes, and as many beyond them of pairs of words.
BUCKETS = 1 << 18
MAX_LABELS = 20_000
HELD_OUT = 5
C = 2.0
MIN_SIGMA, PAIR_SIGMA = 3.0, 6.0
#: Where the labels do not say.
CUTOFF = -1.0
#: Share of documents that may be lost among the good for one more found among the bad, in choosing the cutoff.
GOOD_COST = 3.0
TEMPERATURE = 0.1
#: Tokens that a worker remembers before it starts anew.
TOKENS = 400_000

_CORE = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def shape(token: str) -> str:
    """Runs of small letters, capitals and digits as a, A and 9 (two capitals or more: AA); other signs as they are, at most 8 in all."""
    out = []
    for c in token[:64]:
        k = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if out and out[-1] == k and k in "a9":
            continue
        if out[-2:] == ["A", "A"] and k == "A":
            continue
        out.append(k)
    return "".join(out[:8])


#: Where the hashes of each kind of feature begin.
KINDS = {k: crc32(k.encode()) for k in ("w", "s", "p", "r")}
W = KINDS["w"]


def bucket(kind: str, value: str) -> int:
    return crc32(value.encode("utf-8", "surrogatepass"), KINDS[kind]) % BUCKETS


@lru_cache(100_000)
def shape_bucket(s: str) -> int:
    return bucket("s", s)


def look_at(token: str) -> tuple[str, tuple[int, ...]]:
    """A token's shape, and the buckets of the shape and of its words."""
    body, sign = (token, "") if token[-1] not in ".,;:" else (token[:-1], token[-1])
    if body.isalpha() and len(body) < 60 and (body.islower() or body[1:].islower() and body[0].isupper()):
        s = ("a" if body.islower() else "Aa") + sign  # what shape() and _CORE find, sooner
        return s, (shape_bucket(s), crc32(body.lower().encode(), W) % BUCKETS)
    s = shape(token)
    return s, (shape_bucket(s), *[bucket("w", w.lower()) for w in _CORE.findall(token)])


def pairs_of(ids: np.ndarray, beyond: int) -> np.ndarray:
    """Buckets of the pairs of neighbouring ids, from `beyond` on."""
    return (mix(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(ids[1:])) % np.uint64(BUCKETS)).astype(np.int64) + beyond


class Features:
    """Sets of buckets of texts. Tokens are numbered as they come, and what is known of each is held in arrays; the table is bounded."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.shapes, self.words, self.many = (np.empty(1 << 12, t) for t in (np.uint64, np.uint64, bool))
        self.more: dict[int, tuple[int, ...]] = {}

    def add(self, token: str) -> None:
        k = self.index[token] = len(self.index)
        if k == len(self.shapes):
            self.shapes, self.words, self.many = (np.concatenate([x, np.empty_like(x)]) for x in (self.shapes, self.words, self.many))
        _, b = look_at(token)
        # the shape's bucket comes first, then those of words; in pairs of words the last one stands, or the shape
        self.shapes[k], self.words[k], self.many[k] = b[0], b[-1] if len(b) > 1 else b[0] + BUCKETS, len(b) > 2
        if len(b) > 2:
            self.more[k] = b[1:-1]

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.empty(0, np.int64)
        index = self.index
        for t in set(tokens).difference(index):
            self.add(t)
        line = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        once = distinct(line)
        shapes, words = self.shapes[line], self.words[line]
        word = self.words[once]
        others = [b for k in once[self.many[once]].tolist() for b in self.more[k]]
        others.append(bucket("r", str(10 * int(np.count_nonzero(line[1:] == line[:-1])) // len(tokens))))
        if len(index) > TOKENS:
            index.clear(), self.more.clear()
        return distinct(np.concatenate([self.shapes[once].view(np.int64), word[word < BUCKETS].view(np.int64), np.array(others, np.int64), pairs_of(shapes, 0), pairs_of(words, BUCKETS)]))


@lru_cache(1)
def held_features() -> Features:
    """One table for all tasks of a worker."""
    return Features()


def sample_labels(labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """doc_id, _good, _held of at most `most` labelled documents, by the hash of their ids."""
    each = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(1))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    h = F.xxhash64("doc_id", F.lit("label"))
    return each.orderBy(h, "doc_id").limit(most).select("doc_id", ((F.col("q") >= 1) & (F.col("t") == 0)).alias("_good"), (F.pmod(F.shiftright(h, 8), F.lit(HELD_OUT)) == 0).alias("_held"))


def count_models(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, raw, target: in how many documents, and labelled good ones not held out, a bucket occurs; bucket -1 counts documents."""
    marked = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left").select("text", F.coalesce(F.col("_good") & ~F.col("_held"), F.lit(False)).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = held_features()
        raw, target, rows, good = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64), 0, 0
        for b in batches:
            for text, is_good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = features.of(text)
                raw[f] += 1
                rows += 1
                if is_good:
                    target[f] += 1
                    good += 1
        at = np.flatnonzero(raw)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(raw[at], rows)), pa.array(np.append(target[at], good))], ["bucket", "raw", "target"])

    small_batches(docs.sparkSession)
    return marked.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket."""

    ratios: np.ndarray

    @classmethod
    def fit(cls, bucket: np.ndarray, raw: np.ndarray, target: np.ndarray) -> Model:
        ratios = np.zeros(2 * BUCKETS, np.float32)
        total = bucket == -1
        n, m = int(raw[total].sum()), int(target[total].sum())
        if n and m:
            at = bucket >= 0
            t, e = target[at].astype(float), raw[at] * (m / n)
            sure = np.abs(e - t) > np.where(bucket[at] < BUCKETS, MIN_SIGMA, PAIR_SIGMA) * np.sqrt(e)
            ratios[bucket[at]] = np.where(sure, np.log((t + C) / (e + C)), 0)
        return cls(ratios)

    def weight(self, features: np.ndarray) -> float:
        r = self.ratios[features]
        return float(np.minimum(r, 0).sum() + (np.maximum(r, 0).mean() if len(r) else 0))


def weigh(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and weight, a double, of the column text."""
    names = [c for c in docs.columns if c != "weight"]
    docs = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model.ratios)
    at = names.index(text)

    def make():
        features, model = held_features(), Model(shared.value)

        def work(batch: pa.RecordBatch):
            found = [model.weight(features.of(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "weight"])

        return work

    return map_arrow(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", weight double")


def gumbel(doc_id: str, seed: int = 0) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12).cast("double") + 0.5) / 2.0**52
    return -F.ln(-F.ln(u))


def best_cutoff(weights: np.ndarray, good: np.ndarray) -> float:
    """The cutoff between held-out weights that keeps good ones and drops bad ones best; CUTOFF if either kind is missing."""
    if good.all() or not good.any():
        return CUTOFF
    values = np.unique(weights)
    cuts = (values[:-1] + values[1:]) / 2 if len(values) > 1 else np.array([CUTOFF])
    found = [(np.mean(weights[~good] < c) - GOOD_COST * np.mean(weights[good] < c), -abs(c - CUTOFF), c) for c in cuts]
    return float(max(found)[2])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column of doubles, exactly: histograms of bounded size narrow its range."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = (hi - lo) / bins
        place = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)) if lo + width > lo else F.when(F.col(column) > lo, 1).otherwise(0)
        inside = df.where(F.col(column).between(lo, hi))
        for r in sorted(inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return hi


@dataclass(frozen=True)
class Choice:
    """What decides: the model, the cutoff, the number to keep and the least key kept (None: none)."""

    model: Model
    cutoff: float
    k: int
    least: float | None
    keys: DataFrame


def key_column(doc_id: str) -> Column:
    return F.col("weight") / F.lit(TEMPERATURE) + gumbel(doc_id)


def choose(docs: DataFrame, labels: DataFrame, whole: bool) -> Choice:
    """Weighs the documents and decides; keys holds doc_id, weight and key, and if whole the columns of docs as _0, _1 and so on: their names may clash."""
    chosen = cut(sample_labels(labels))
    counts = count_models(docs, chosen).toArrow()
    model = Model.fit(*(counts[c].to_numpy() for c in ("bucket", "raw", "target")))
    kept = docs.columns if whole else ["doc_id", "text"]
    own = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(kept)])
    doc_id = f"_{kept.index('doc_id')}"
    weighed = weigh(own, model, f"_{kept.index('text')}")
    keys = cut(weighed.select(*(own.columns if whole else []), F.col(doc_id).alias("doc_id"), "weight", key_column(doc_id).alias("key")))
    held = keys.join(F.broadcast(chosen.where("_held")), "doc_id").select("weight", "_good").toPandas()
    cutoff = best_cutoff(held["weight"].to_numpy(float), held["_good"].to_numpy(bool)) if len(held) else CUTOFF
    drop(chosen)
    k = keys.where(F.col("weight") >= cutoff).count()
    return Choice(model, cutoff, k, kth_largest(keys, "key", k) if k else None, keys)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, weight, key and kept."""
    c = choose(docs, labels, False)
    return c.keys.select("doc_id", "weight", "key", (F.col("key") >= c.least if c.k else F.lit(False)).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents in the sample, all their columns."""
    c = choose(docs, labels, True)
    return c.keys.where(F.col("key") >= c.least if c.k else F.lit(False)).select(*[F.col(f"_{k}").alias(name) for k, name in enumerate(docs.columns)])
