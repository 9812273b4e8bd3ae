"""Best-fit packing: bounded-space online best-fit into sequences of a fixed number of tokens.

Documents are cut only where they are longer than a sequence. Pieces then arrive one by one. A
bitset has a bit for every amount of free space that some open bin has, so the tightest bin that
takes a piece is the lowest set bit at or above its length. At most a fixed number of bins is
open: when a new one is needed beyond that, the fullest open bin closes. Every task packs its own
share of the pieces, dealt by hash, so memory is bounded by the open bins.

Ids: the tokenizer treats the chunks between white space, and the words and signs of a chunk,
independently, so ids of chunks and words are kept as bytes in bounded tables and joined; new
words of a batch are tokenized in one call.

Edge cases: a null or empty text is one piece holding only the end id; repeated rows are packed
as rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow

CAPACITY = 2048
OPEN_BINS = 4096
END = (0).to_bytes(4, "little")
#: Chunks and words kept by a worker; later ones are tokenized again whenever they come.
CHUNKS, WORDS = 900_000, 900_000
#: Documents whose pieces one packing task gets, about.
SHARE = 50_000
#: The tokenizer's own cut of a chunk of normalised text.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Python takes \x1c to \x1f for white space, lower-cases a final sigma by its place, and knows no added tokens: such texts go to the tokenizer whole.
ODD = re.compile("[\x1c-\x1f\u03a3]|<\\|")


class Ids:
    """Token ids of whole texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = {i.to_bytes(4, "little") for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters: one pass over all of them, cut after each token that ends a word."""
        out, held, at = {}, [], 0
        got = self.whole(" ".join(words))
        for k in range(0, len(got), 4):
            token = got[k : k + 4]
            held.append(token)
            if token in self.ends:
                out[words[at]] = b"".join(held)
                held, at = [], at + 1
        if at != len(words) or held:
            return {w: self.whole(w) for w in words}
        return out

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        parts: dict[str, list[str]] = {}
        for c in chunks:
            body, sign = (c, "") if c[-1] not in ".," else (c[:-1], c[-1])
            word = (body if body.isascii() else unicodedata.normalize("NFC", body)).lower()
            if word.isalpha():
                parts[c] = [word, sign] if sign else [word]
            else:
                parts[c] = PARTS.findall(unicodedata.normalize("NFC", c).lower())
        known = self.words
        new = {p for x in parts.values() for p in x if p not in known}
        plain = [w for w in new if w.isalpha()]
        found = self.learn_words(plain) if plain else {}
        for w in new:
            if w not in found:
                found[w] = self.whole(w)
        if len(known) < WORDS:
            known.update(found)
            found = known
        else:
            found = {**{p: known[p] for x in parts.values() for p in x if p in known}, **found}
        return {c: found[x[0]] if len(x) == 1 else b"".join([found[p] for p in x]) for c, x in parts.items()}

    def of(self, texts: list[str]) -> list[bytes]:
        split = [None if ODD.search(t) else t.split() for t in texts]
        known = self.chunks
        new = self.learn({c for x in split if x for c in x if c not in known})
        if len(known) < CHUNKS:
            known.update(new)
            get = known.__getitem__
        else:
            get = lambda c: known[c] if c in known else new[c]
        return [self.whole(t) if x is None else b"".join(map(get, x)) for t, x in zip(texts, split, strict=True)]


@lru_cache(1)
def held_ids(path: str) -> Ids:
    """One table for all tasks of a worker."""
    return Ids(path)


class Packer:
    """Online best-fit with at most `space` open bins."""

    def __init__(self, capacity: int = CAPACITY, space: int = OPEN_BINS):
        self.capacity, self.space = capacity, space
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        held = self.bins[free]
        found = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the place in it for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            found, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if self.open == self.space:
                self._take((self.bits & -self.bits).bit_length() - 1)
            if not self.bins[left]:
                self.bits |= 1 << left
            self.bins[left].append(found)
            self.open += 1
        return found, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document, cut only if longer than capacity."""

    def make():
        ids = held_ids(tokenizer)

        def work(batch: pa.RecordBatch):
            keys, rows = batch.column(0), []
            for k, found in enumerate(ids.of([t or "" for t in batch.column(1).to_pylist()])):
                got = memoryview(found + END)
                n = len(got) // 4
                rows += [(k, p, s, min(capacity, n - s), zlib.crc32(got[4 * s : 4 * (s + capacity)])) for p, s in enumerate(range(0, n, capacity))]
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return work

    docs = docs.select("doc_id", "text")
    return map_arrow(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(rows: DataFrame, tasks: int, capacity: int = CAPACITY, space: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity, dealt to so many tasks by hash."""
    names = rows.columns
    order = [F.xxhash64(*names), *names]
    dealt = rows.repartition(max(1, tasks), F.xxhash64(*names)).sortWithinPartitions(*order)

    def make():
        packer, first = Packer(capacity, space), TaskContext.get().partitionId() << 40

        def work(batch: pa.RecordBatch):
            placed = [packer.place(n) for n in batch.column(names.index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*names, "sequence_id", "offset"])

        return work

    return map_arrow(dealt, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, space: int = OPEN_BINS) -> DataFrame:
    tasks = -(-docs.count() // SHARE)
    return pack(pieces(docs, tokenizer, capacity), tasks, capacity, space)
