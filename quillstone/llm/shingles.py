"""Hashed word shingles of texts, vectorised."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a text hashed at once; longer texts are hashed in overlapping parts.
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: one-to-one, every bit of the result hangs on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of an array, sorted: for short arrays several times sooner than np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[starts[i]:ends[i]]."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE, n)[starts])


def words_of(text: str) -> list[bytes]:
    """Words between white space (blank and \\x09 to \\x0D), lower-cased in A-Z only, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_shingles(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; of the whole sequence if it has fewer words; none of no words."""
    if not words:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    out, at = [], 0
    while at + k <= len(words):
        # as many words as fit a block, one shingle at least
        upto = max(at + k, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        data = np.frombuffer(b" ".join(words[at:upto]), np.uint8)
        out.append(span_hashes(data, starts[at : upto - k + 1] - starts[at], ends[at + k - 1 : upto] - starts[at]))
        at = upto - k + 1
    return np.concatenate(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of a text."""
    return distinct(word_shingles(words_of(text), k)) if text else np.empty(0, np.uint64)
