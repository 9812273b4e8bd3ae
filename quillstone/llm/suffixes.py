"""External induced sorting of suffixes.

Suffixes that are smaller than the next (type S) and larger (type L) are told apart; an S suffix
after an L one starts a piece. Pieces are sorted by an external merge sort and named; if names
repeat, the string of names is sorted by the same method, recursively. From the sorted starts all
L suffixes are induced in ascending order and then all S suffixes in descending order: a suffix,
as it leaves the priority queue, puts the one before it in. Suffixes of one symbol enter in the
order in which they must leave, so the queue is a heap of symbols, each with a first-in first-out
spool that keeps its head and tail in memory and the rest on disk.

suffix_array() does so one suffix at a time, for strings of any length. sorted_to() does it for
strings that fit memory: all suffixes of a symbol leave at once, as arrays, and pieces are ordered
by doubling their names only as far as a given depth.

Texts, types and spools are files without a name: they go when they are closed or the process
ends. In memory are bounded buffers of the spools and of the sorted runs.
"""

from __future__ import annotations

import heapq
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Numbers that a spool keeps in memory at its tail before it writes them.
SPOOL = 1 << 16
#: Bytes of pieces sorted in memory as one run.
RUN_BYTES = 32 << 20
#: Bytes of an array that is left in memory.
SMALL = 1 << 20


def on_disk(values: np.ndarray) -> np.ndarray:
    """The values in an unnamed file, mapped; as they are if few."""
    if values.nbytes < SMALL:
        return values
    with tempfile.TemporaryFile() as f:
        values.tofile(f)
        f.flush()
        return np.memmap(f, values.dtype, "r", shape=values.shape)


class Spool:
    """First in, first out; what does not fit the buffers is in a file."""

    def __init__(self):
        self.head, self.at = array("q"), 0
        self.tail = array("q")
        self.file, self.read, self.written = None, 0, 0

    def push(self, value: int) -> None:
        self.tail.append(value)
        if len(self.tail) >= SPOOL:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(8 * self.written)
            self.tail.tofile(self.file)
            self.written += len(self.tail)
            self.tail = array("q")

    def __bool__(self) -> bool:
        return self.at < len(self.head) or self.read < self.written or bool(self.tail)

    def pop(self) -> int:
        if self.at >= len(self.head):
            if self.read < self.written:
                n = min(SPOOL, self.written - self.read)
                self.file.flush()
                self.file.seek(8 * self.read)
                self.head = array("q", self.file.read(8 * n))
                self.read += n
            else:
                self.head, self.tail = self.tail, array("q")
            self.at = 0
        self.at += 1
        return self.head[self.at - 1]


class SymbolQueue:
    """A priority queue of suffixes by first symbol (the greatest first if descending), in order of arrival within one."""

    def __init__(self, descending: bool = False):
        self.sign = -1 if descending else 1
        self.heap: list[int] = []
        self.spools: dict[int, Spool] = {}

    def push(self, symbol: int, suffix: int) -> None:
        held = self.spools.get(symbol)
        if held is None:
            held = self.spools[symbol] = Spool()
            heapq.heappush(self.heap, self.sign * symbol)
        held.push(suffix)

    def symbol(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self) -> int:
        symbol = self.sign * self.heap[0]
        held = self.spools[symbol]
        out = held.pop()
        if not held:
            heapq.heappop(self.heap)
            del self.spools[symbol]
        return out


def s_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; the empty suffix after the end is the smallest of all."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    return step[known] > 0


def _runs(pieces: Iterable[tuple[bytes, int]]) -> Iterator[tuple[bytes, int]]:
    """An external merge sort of (piece, start)."""
    files, held, size = [], [], 0

    def spill():
        held.sort()
        f = tempfile.TemporaryFile()
        for piece, start in held:
            f.write(len(piece).to_bytes(4, "little") + start.to_bytes(8, "little") + piece)
        f.seek(0)
        files.append(f)

    def stream(f) -> Iterator[tuple[bytes, int]]:
        while head := f.read(12):
            yield f.read(int.from_bytes(head[:4], "little")), int.from_bytes(head[4:], "little")

    for x in pieces:
        held.append(x)
        size += len(x[0]) + 80
        if size >= RUN_BYTES:
            spill()
            held, size = [], 0
    held.sort()
    return heapq.merge(*map(stream, files), held) if files else iter(held)


def sorted_starts(text: np.ndarray, s: np.ndarray, lms: np.ndarray) -> Iterable[int]:
    """The starts of pieces in the order of their suffixes."""
    n, m = len(text), len(lms)
    if m < 2:
        return lms.tolist()
    marked = on_disk((text.astype(np.int64) * 2 + s).astype(">u4" if int(text.max()) < 1 << 30 else ">u8"))
    # a piece ends with the start of the next; the last one ends with the text, below everything
    pieces = ((marked[a : b + 1].tobytes(), k) for k, (a, b) in enumerate(zip(lms.tolist(), [*lms[1:].tolist(), n], strict=True)))
    names, name, last = np.zeros(m, np.int64), 0, None
    order = array("q")
    for piece, k in _runs(pieces):
        if piece != last:
            name, last = name + 1, piece
        names[k] = name
        order.append(k)
    if name < m:
        order = suffix_array(on_disk(names))
    return (int(lms[k]) for k in order)


def suffix_array(text: np.ndarray) -> array:
    """The suffixes of a string of non-negative integers in ascending order."""
    n = len(text)
    if n < 2:
        return array("q", range(n))
    s = s_types(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    symbols, small = memoryview(np.ascontiguousarray(text)), memoryview(s.view(np.uint8))
    queue, ascending = SymbolQueue(), Spool()
    # the empty suffix precedes all and puts in the last one
    queue.push(symbols[n - 1], n - 1)
    starts = iter(sorted_starts(text, s, lms))
    start = next(starts, None)
    while True:
        c = queue.symbol()
        if start is not None and (c is None or symbols[start] < c):
            here, start = start, next(starts, None)
        elif c is not None:
            here = queue.pop()
            ascending.push(here)
        else:
            break
        if here and not small[here - 1]:
            queue.push(symbols[here - 1], here - 1)
    larger = array("q")
    while ascending:
        larger.append(ascending.pop())
    queue, out, k = SymbolQueue(descending=True), array("q"), len(larger) - 1
    while True:
        c = queue.symbol()
        if k >= 0 and (c is None or symbols[larger[k]] > c):
            here, k = larger[k], k - 1
        elif c is not None:
            here = queue.pop()
        else:
            break
        out.append(here)
        if here and small[here - 1]:
            queue.push(symbols[here - 1], here - 1)
    out.reverse()
    return out


def piece_ranks(text: np.ndarray, s: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at the starts of pieces by their first `depth` symbols at least."""
    wide = (text.astype(np.uint16) * 2 + s).astype(">u2").tobytes()
    at = (2 * lms).tolist()
    pieces = [wide[a : b + 2] for a, b in zip(at, [*at[1:], len(wide)], strict=True)]
    name = {x: k for k, x in enumerate(sorted(set(pieces)))}
    rank = np.fromiter(map(name.__getitem__, pieces), np.int64, len(pieces))
    del pieces, wide
    step, most = 1, len(name)
    # a piece has two symbols at least, the second being the next one's first
    while step < depth and most < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        values, rank = np.unique(rank * (most + 1) + after, return_inverse=True)
        most, step = len(values), 2 * step
    return rank


class BlockQueue:
    """SymbolQueue for arrays of suffixes: a push deals them to their symbols in order, a pop takes all there are."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text = text
        self.held: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def push(self, suffixes: np.ndarray) -> None:
        symbol = self.text[suffixes]
        order = np.argsort(symbol, kind="stable")
        suffixes, symbol = suffixes[order], symbol[order]
        first = np.flatnonzero(np.diff(symbol, prepend=-1))
        for c, a, b in zip(symbol[first].tolist(), first.tolist(), [*first[1:].tolist(), len(symbol)], strict=True):
            self.held[c].append(suffixes[a:b])

    def pop(self, symbol: int) -> np.ndarray | None:
        found, self.held[symbol] = self.held[symbol], []
        return (found[0] if len(found) == 1 else np.concatenate(found)) if found else None


def sorted_to(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a string of small numbers in the order of their first `depth` symbols at least."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int32)
    s, symbols = s_types(text), int(text.max()) + 1
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    starts = lms[np.argsort(piece_ranks(text, s, lms, depth), kind="stable")] if len(lms) > 1 else lms
    bounds = np.searchsorted(text[starts], np.arange(symbols + 1))
    queue = BlockQueue(text, symbols)

    def induce(block: np.ndarray, kind: bool) -> None:
        before = block[block > 0] - 1
        before = before[s[before] == kind]
        if len(before):
            queue.push(before)

    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    queue.push(np.array([n - 1]))
    for c in range(symbols):
        while (block := queue.pop(c)) is not None:
            larger[c].append(block)
            induce(block, False)
        induce(starts[bounds[c] : bounds[c + 1]], False)
    out: list[np.ndarray] = []
    for c in reversed(range(symbols)):
        while (block := queue.pop(c)) is not None:
            out.append(block)
            induce(block, True)
        for block in reversed(larger[c]):
            out.append(block[::-1])
            induce(block[::-1], True)
    return np.concatenate(out)[::-1]
