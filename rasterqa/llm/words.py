"""Words of whole texts as 64-bit hashes, computed on byte buffers with NumPy.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``. Null texts count
as empty. Hashes are equal on every machine and for every batch cut; two different words
share one with probability 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GOLD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
TABLE_DEPTH = 64
#: Bytes of text that are handled at once; bounds the arrays a task holds.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_AT = mix(np.arange(TABLE_DEPTH * 256, dtype=np.uint64))


def encode(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 bytes; ``lower`` folds A-Z only. Lone surrogates survive."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw


def texts(column, lower: bool = False) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column of texts; null texts are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    raw = column.cast(kind).to_pylist()
    return [(b or b"").lower() for b in raw] if lower else [b or b"" for b in raw]


def give_back() -> None:
    """Hands memory that was freed, also by earlier tasks of this worker, back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, rows: int = 1000):
    """The batches in slices of at most ``rows`` rows, so that few texts are unpacked at once."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word of the texts joined by a line feed, and
    the number of words of each text."""
    if not texts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~SPACE[a]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(inside)
    place = at - np.repeat(first, end - first)
    value = BYTE_AT[(place % TABLE_DEPTH) * 256 + a[at]]
    far = place >= TABLE_DEPTH
    if far.any():
        value = np.where(far, mix(value ^ place.astype(np.uint64)), value)
    starts = np.concatenate(([0], np.cumsum(end - first)[:-1])) if len(first) else first
    hashes = mix(np.add.reduceat(value, starts)) if len(first) else np.zeros(0, np.uint64)
    stop = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(first, stop), prepend=0)
    return hashes, first, end, counts


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_BYTES`` each; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each place, for ``len(words) - n + 1`` places."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out ^ words[i:i + m])
    return out


def roll_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """As ``gram_hashes`` for long windows: a polynomial over 2**64 by doubling, mixed last."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    mul = 0xD1342543DE82EF95
    power, width = words, 1
    out, done = None, 0
    while True:
        if n & width:
            part = power[done:]
            out = part[:m].copy() if out is None else out[:m] * np.uint64(pow(mul, width, 1 << 64)) + part[:m]
            done += width
        if done == n:
            return mix(out)
        power = power[:-width] * np.uint64(pow(mul, width, 1 << 64)) + power[width:]
        width *= 2
