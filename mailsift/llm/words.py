"""Words of many texts at once, as numpy arrays.

Words are runs of `[^\\x20\\x09-\\x0D]`.  All of these blanks are single bytes below 0x80, so words are cut on UTF-8 bytes.
A word's hash is a polynomial over its bytes modulo 2^64, computed for all words from one running sum, then mixed.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
CHUNK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, for at least `n` places."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK)
        tables = []
        for base in (_FACTOR, _INVERSE):
            t = np.full(size, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[0] = have = (tables[0], tables[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    high = x >> U64(30)
    x = x ^ high
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, U64(27), out=high)
    x *= U64(0x94D049BB133111EB)
    x ^= np.right_shift(x, U64(31), out=high)
    return x


def blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of a byte array."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~blanks(data)
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def running(data: np.ndarray) -> np.ndarray:
    """Sums over the bytes before each place, from which `span_hashes` reads the hash of any span."""
    powers, _ = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    terms = data.astype(U64)
    terms += U64(1)
    terms *= powers[:len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def rolling_hashes(sums: np.ndarray, size: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The hash of the `size` bytes from each place on; equal to `span_hashes` of the same bytes.

    Of all bytes, or of those from `start` to `stop`.
    """
    stop = len(sums) - 1 if stop is None else stop
    n = stop - start - size + 1
    if n <= 0:
        return np.empty(0, U64)
    _, inverse = _power_tables(len(sums))
    out = sums[start + size:stop + 1] - sums[start:start + n]
    out *= inverse[start:start + n]
    return mix(out)


def hashes_between(sums: np.ndarray, start: int, places: np.ndarray, size: int) -> np.ndarray:
    """The hash of the bytes from each of the places (in order, counted from `start`) to the one `size` places on."""
    _, inverse = _power_tables(len(sums))
    there = sums[start:][places]
    out = there[size:] - there[:-size]
    out *= inverse[start:][places[:-size]]
    return mix(out)


def slices(texts: list, limit: int = CHUNK):
    """(from, to) of consecutive texts that hold about `limit` characters together, one text at least."""
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size < limit):
            size += len(texts[upto] or "")
            upto += 1
        yield at, upto
        at = upto


class Texts:
    """The words of a list of texts (str, UTF-8 bytes or None): `hashes` of all words in order, `bounds[i]:bounds[i + 1]` those of text i."""

    def __init__(self, texts, lower: bool = False):
        encoded = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        parts, counts = [], np.zeros(len(encoded), np.int64)
        at = 0
        while at < len(encoded):
            size, upto = 0, at
            while upto < len(encoded) and (upto == at or size + len(encoded[upto]) < CHUNK):
                size += len(encoded[upto]) + 1
                upto += 1
            data = np.frombuffer(b" ".join(encoded[at:upto]), np.uint8)
            if lower:
                data = lower_ascii(data)
            starts, ends = spans(data)
            parts.append(span_hashes(running(data), starts, ends))
            limits = np.cumsum([len(e) + 1 for e in encoded[at:upto]])
            counts[at:upto] = np.diff(np.searchsorted(starts, limits), prepend=0)
            at = upto
        self.hashes = np.concatenate(parts) if parts else np.empty(0, U64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        #: the text of each word
        self.owner = np.repeat(np.arange(len(encoded)), counts)


def window_hashes(hashes: np.ndarray, size: int, factor: int = _FACTOR) -> np.ndarray:
    """The hash of each `size` consecutive words; one entry per start."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out *= U64(factor)
        out += hashes[k:k + n]
    return mix(out)


def same_owner(owner: np.ndarray, size: int) -> np.ndarray:
    """For each start of `size` consecutive words, whether all belong to one text."""
    n = len(owner) - size + 1
    return owner[:n] == owner[size - 1:] if n > 0 else np.empty(0, bool)
