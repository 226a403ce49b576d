"""Rabin-Karp fingerprints of byte ranges by prefix polynomials, and ranges grouped by their bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from ravelin.llm.packing import ragged

#: An odd multiplier of 64 bits (fixed value), and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Fingerprints:
    """Values of sum (byte + 1) BASE^place modulo 2^64 of ranges of a buffer, each from its own start."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            up, down = np.uint64(pow(BASE, k, 1 << 64)), np.uint64(pow(INVERSE, k, 1 << 64))
            self.powers, self.inverses = np.append(self.powers, self.powers * up), np.append(self.inverses, self.inverses * down)

    def prefix(self, buffer: np.ndarray) -> np.ndarray:
        self.grow(len(buffer) + 1)
        out = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.powers[: len(buffer)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverses[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose upper bits depend on all of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(32))


def gathered(buffer: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The bytes of ranges end to end; the index arrays are made for a block of ranges at a time."""
    parts = [buffer[ragged(start[lo : lo + block], size[lo : lo + block])] for lo in range(0, len(start), block)]
    return np.concatenate(parts) if parts else buffer[:0]


def same_bytes(buffer: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, block: int = 1 << 15) -> bool:
    """Whether each range holds the bytes of the range of its size that begins at ``other``."""
    for lo in range(0, len(start), block):
        s, n, o = start[lo : lo + block], size[lo : lo + block], other[lo : lo + block]
        if not np.array_equal(buffer[ragged(s, n)], buffer[ragged(o, n)]):
            return False
    return True


def grouped(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of equal bytes (and equal ``also``) as groups: one member of each, each range's group, and the groups' sizes.

    ``key`` are fingerprints that depend on ``also`` too. All members are compared with their group's first, byte by byte; should ranges
    of one fingerprint differ, the buffer's ranges are grouped by their bytes instead.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inverse = pd.factorize(key)[0]  # numbered as they appear
    top = np.maximum.accumulate(inverse)
    head = np.append(True, top[1:] != top[:-1])
    first = np.flatnonzero(head)
    a = np.flatnonzero(~head)
    b = first[inverse[a]]
    size = end - start
    if np.array_equal(size[a], size[b]) and (also is None or np.array_equal(also[a], also[b])) and same_bytes(buffer, start[a], size[a], start[b]):
        return first, inverse, np.bincount(inverse)
    names = [(buffer[s:e].tobytes(), 0 if also is None else int(also[k])) for k, (s, e) in enumerate(zip(start, end))]
    seen: dict[tuple[bytes, int], int] = {}
    inverse = np.fromiter((seen.setdefault(n, len(seen)) for n in names), np.int64, len(names))
    return np.unique(inverse, return_index=True)[1], inverse, np.bincount(inverse)


def ended(texts: pa.Array, end: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts (null: empty), each with ``end`` after it, and the places where texts begin, with the last one's end."""
    one = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string()))
    _, offsets, data = one.buffers()
    places = np.frombuffer(offsets, np.int64)[one.offset : one.offset + len(one) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def strings(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, apart: str = " ") -> list[str]:
    """The ranges as strings; none may hold the character ``apart``."""
    if not len(start):
        return []
    size = end - start
    held = gathered(np.append(buffer, np.uint8(ord(apart))), start, size + 1)
    held[np.cumsum(size + 1) - 1] = ord(apart)
    return held[:-1].tobytes().decode().split(apart)
