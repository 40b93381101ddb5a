"""Word positions and Rabin-Karp hashes of many texts at once, in NumPy over their UTF-8 bytes.

Words are runs without the six ASCII space characters; those are single bytes in UTF-8, so words can be
found and hashed on bytes. All sums and products wrap at 64 bits; as such sums are weak on very long
sequences, words of more than ``LONG`` bytes are hashed by XXH64. A text of more than ``CHUNK`` bytes is
split in pieces of about that size, so that only its words, not its bytes, take eight-byte arrays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
#: For a second hash of the same words that has nothing to do with the first.
OTHER = np.uint64(0xD1B54A32D192ED03)
#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 20
LONG = 64

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (a multiply-shift finaliser); one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return powers(int(base), 1 << max(10, int(n - 1).bit_length()))[:n]


_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Of one chunk of texts: word hashes, where words start and end, and each text's first word."""

    data: np.ndarray  # the bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1


def _pieces(data: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end before a space or at the end."""
    out, a = [], 0
    while len(data) - a > 2 * CHUNK:
        b = a + CHUNK
        while b < len(data):
            space = np.flatnonzero(_space[data[b : b + CHUNK]])
            if len(space):
                b += int(space[0])
                break
            b = min(len(data), b + CHUNK)
        out.append((a, b))
        a = b
    return [*out, (a, len(data))] if a < len(data) or not out else out


def _words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words; no word goes on across one of ``cuts``."""
    inside = ~_space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] |= inside[cuts]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    number = np.cumsum(begins) - 1
    at = np.flatnonzero(inside)
    number = number[at]
    depth = at - start[number]
    value = _byte[data[at]] * _powers(BASE, LONG + 1)[np.minimum(depth, LONG)]
    edges = np.flatnonzero(np.diff(number, prepend=-1))
    sums = np.add.reduceat(value, edges)
    size = np.diff(np.append(edges, len(at)))
    for i in np.flatnonzero(size > LONG).tolist():
        sums[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return start, start + size, mix(sums ^ size.astype(np.uint64))


def split(data: np.ndarray, bounds: np.ndarray) -> Words:
    """``data``: bytes of texts laid end to end; ``bounds``: where each starts, and the end."""
    cuts = bounds[1:-1]  # a text's first word doesn't go on from the text before
    cuts = cuts[cuts < len(data)]
    parts = []
    for a, b in _pieces(data):
        start, end, h = _words_of(data[a:b], cuts[(cuts >= a) & (cuts < b)] - a)
        parts.append((start + a, end + a, h))
    start, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(data, start, end, h, np.searchsorted(start, bounds))


def chunks(column: pa.Array):
    """(first row, Words) for runs of rows of a string column of about CHUNK bytes each."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        lo, hi = offsets[row], offsets[to]
        yield row, split(data[lo:hi], offsets[row : to + 1] - lo)
        row = to


def rolling(hashes: np.ndarray, n: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hash of each run of n values, whatever texts they are of; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _powers(base, len(hashes) - n + 1))


def second(hashes: np.ndarray, n: int) -> np.ndarray:
    """Another 64-bit hash of the same runs, on word hashes spread anew and with another base."""
    return rolling(mix(hashes ^ OTHER), n, OTHER)
