"""Words of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import codepoints

_table: np.ndarray | None = None
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_table() -> np.ndarray:
    """Code point -> its lower-case letter or digit, or 0 for what ends a word."""
    global _table
    if _table is None:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x32400):
            c = chr(i)
            if c.isalnum() or 0x300 <= i < 0x370:
                t[i] = ord(c.lower()[0])
        _table = t
    return _table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


#: Powers of the word hash's multiplier and of its inverse, for places within SPAN and for whole spans.
_SPAN = 1 << 12
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, spans: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i for i below SPAN, base**(SPAN * j) for j below at least spans), modulo 2**64."""
    low, high = _powers.get(base, (None, None))
    if high is None or len(high) < spans:
        ones = lambda x, n: np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x, np.uint64))), dtype=np.uint64)
        low = ones(np.uint64(base), _SPAN)
        high = ones(np.uint64(pow(base, _SPAN, 1 << 64)), max(spans, 1024))
        _powers[base] = low, high
    return low, high


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): words of the joined texts; first[i] is text i's first word.

    start and end count code points in the texts joined by one separator each. first has one
    entry more than there are texts.
    """
    return words_and_letters(texts)[:4]


def words_and_letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What words() gives, and the letter of each code point (0: none).

    A word's hash is a sum of its letters times powers of their places in the word. It is taken
    from running sums with powers of the places in all the texts, divided by the first power.
    """
    m = word_table().take(codepoints("\n".join([t or "" for t in texts])))
    inside = np.zeros(len(m) + 2, bool)
    np.not_equal(m, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    first = np.searchsorted(start, begins)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, first, m
    spans = -(-len(m) // _SPAN)
    low, high = _power(int(_M1), spans)
    total = np.zeros(spans * _SPAN + 1, np.uint64)
    x = total[1:]
    x[: len(m)] = m
    x += np.uint64(0x51ED)
    x.reshape(spans, _SPAN)[:] *= low
    x.reshape(spans, _SPAN)[:] *= high[:spans, None]
    np.cumsum(x, dtype=np.uint64, out=x)
    low, high = _power(pow(int(_M1), -1, 1 << 64), spans)
    return mix((total[end] - total[start]) * low[start & (_SPAN - 1)] * high[start >> _SPAN.bit_length() - 1]), start, end, first, m


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n consecutive words, sorted; all words together where there are fewer."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _M1 + h[i : len(h) - k + 1 + i]
    return np.unique(mix(out))
