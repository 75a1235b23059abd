"""Hashes of words and of stretches of words, for whole slices of documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xBF58476D1CE4E5B9)
C = np.uint64(0x94D049BB133111EB)
#: Base of the polynomial modulo 2**64, and base and modulus (a prime) of the other one.
RADIX, PRIME_RADIX, PRIME = np.uint64(0xD1342543DE82EF95), 1_103_515_245, 2**31 - 1
#: Bytes of text hashed at once; a longer word makes a block of its own.
BLOCK = 1 << 18

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output looks random."""
    with np.errstate(over="ignore"):
        x = (x + A).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * B
        x = (x ^ (x >> np.uint64(27))) * C
        return x ^ (x >> np.uint64(31))


WIDE = mixed(np.arange(256, dtype=np.uint64))
NARROW = (mixed(np.arange(1000, 1256, dtype=np.uint64)) % np.uint64(PRIME)).astype(np.int64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.int64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of both bases."""
    wide, narrow = _powers
    while len(wide) <= n:
        m = len(wide)
        with np.errstate(over="ignore"):
            wide = np.concatenate([wide, wide * (wide[-1] * RADIX)])
        narrow = np.concatenate([narrow, narrow * (int(narrow[-1]) * PRIME_RADIX % PRIME) % PRIME])
        assert len(wide) == 2 * m
    _powers[:] = wide, narrow
    return wide, narrow


def split(text: str) -> list[bytes]:
    """The maximal stretches without the characters U+0020 and U+0009 to U+000D, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _hashed_block(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places of a block: a polynomial of the bytes modulo 2**64 and one modulo a prime, mixed."""
    n = len(data)
    wide, narrow = powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(WIDE[data] * wide[:n], out=sums[1:])
        h = (sums[stop] - sums[start]) * wide[n - start]
        rests = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(NARROW[data] * narrow[:n] % PRIME, out=rests[1:])
        g = (rests[stop] - rests[start]) % PRIME * narrow[n - start] % PRIME
        # both are relative to the block's length, which goes out again: equal words have equal hashes in any block
        h = h * _inverse(n)
        g = g * int(pow(int(narrow[n]), -1, PRIME)) % PRIME
        return mixed(h ^ (g.astype(np.uint64) << np.uint64(33)))


def _inverse(n: int) -> np.uint64:
    return np.uint64(pow(int(RADIX), -n, 1 << 64))


def hashed_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that stand one behind another, and the places among them where each text's words begin and end."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(SEPARATOR[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] |= inside[1:-1][edges]  # a word ends with its text
    last[edges - 1] |= inside[1:-1][edges - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(stop, start[at] + BLOCK, "right")))
        base = start[at]
        out[at:to] = _hashed_block(data[base : stop[to - 1]], start[at:to] - base, stop[at:to] - base)
        at = to
    return out, np.searchsorted(start, offsets)


def hashed_column(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text of an Arrow column; null texts have none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, dtype=np.uint8)
    h, bounds = hashed_bytes(data, offsets - offsets[0]) if len(texts) else (np.empty(0, dtype=np.uint64), [0])
    return (h[a:b] for a, b in zip(bounds, bounds[1:], strict=False))


def hashed(text: str) -> np.ndarray:
    """The hashes of a text's words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return hashed_bytes(data, np.array([0, len(data)]))[0]


def stretches(h: np.ndarray, n: int, factor: np.uint64 = B) -> np.ndarray:
    """A hash of each n words in a row; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * factor + h[k : len(h) - n + 1 + k]
    return mixed(out)
