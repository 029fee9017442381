"""Words and rolling hashes of many texts at once, on byte arrays.

Texts are laid end to end; a word's polynomial hash, and Rabin-Karp hashes of runs
of words, come from prefix sums modulo 2**64. Chunks are cut by bytes, never
inside a text, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers, fixed so that all executors agree: two for bytes, two for words, and those of the final mix.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes of text that are worked on at once, unless one text is longer.
CHUNK = 1 << 20

_is_gap = np.zeros(256, dtype=bool)
_is_gap[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        found = tuple(out)
        if n <= 2 * CHUNK:
            _powers[base] = found
    return found


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(MIX[0])
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """First row, row after the last, and the texts in UTF-8; null as empty."""
    held, size, first = [], 0, 0
    for i, x in enumerate(texts):
        b = x.encode() if x else b""
        if held and size + len(b) > limit:
            yield first, i, held
            held, size, first = [], 0, i
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, len(texts), held


class Words:
    """The words of some texts: of text i those from first[i] to first[i + 1], their hashes in `hashes(0 or 1)`."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        self.data = _lower[data] if lower else data
        gap = _is_gap[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        self.begin, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.begin, ends)]).astype(np.int64)

    def hashes(self, which: int = 0) -> np.ndarray:
        n = len(self.data)
        power, inverse = _table(BYTE_BASES[which], n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.begin]) * inverse[self.begin])


def prefix(words: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which `span` takes the hash of any run of words."""
    power, _ = _table(WORD_BASES[which], len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return sums


def span(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    _, inverse = _table(WORD_BASES[which], len(sums))
    return mix((sums[end] - sums[begin]) * inverse[begin])


def windows(sums: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of every run of `size` words; none if there are fewer."""
    n = max(0, len(sums) - size)
    _, inverse = _table(WORD_BASES[which], len(sums))
    return mix((sums[size : size + n] - sums[:n]) * inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    n, w = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[:n], x[width - w : width - w + n])
