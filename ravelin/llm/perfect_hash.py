"""Minimal perfect hashing of 64-bit keys: levels of bits that one key alone sets, and the rank of its bit as its place."""

from __future__ import annotations

import numpy as np

from ravelin.llm.fingerprints import mixed

WORD = 64


class PerfectHash:
    """Places 0 to n - 1 of n different keys, by some three to four bits a key; other keys get any place or none, so a table of keys verifies."""

    def __init__(self, levels: list[tuple[int, int]], words: np.ndarray):
        self.levels, self.words = levels, words  # (first word, bits) of each level
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    @staticmethod
    def bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((mixed(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        left, levels, words, at = keys.astype(np.uint64), [], [], 0
        while len(left):
            n = -(-max(int(len(left) * room), WORD) // WORD)
            place = cls.bit(left, len(levels), n * WORD)
            alone = np.bincount(place, minlength=n * WORD) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            levels.append((at, n * WORD))
            at += n
            left = left[~alone[place]]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return cls(levels, np.concatenate(words) if words else np.zeros(0, np.uint64))

    def __len__(self) -> int:
        return int(self.before[-1])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, own = np.arange(len(keys)), keys.astype(np.uint64)
        for level, (first, bits) in enumerate(self.levels):
            place = self.bit(own, level, bits)
            word = first + place // WORD
            shift = (place % WORD).astype(np.uint64)
            held = self.words[word]
            hit = (held >> shift) & np.uint64(1) > 0
            below = np.bitwise_count(held[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[word[hit]] + below
            left, own = left[~hit], own[~hit]
            if not len(left):
                break
        return out

    def packed(self) -> tuple[bytes, bytes]:
        return np.array(self.levels, np.int64).tobytes(), self.words.tobytes()

    @classmethod
    def unpacked(cls, levels: bytes, words: bytes) -> PerfectHash:
        return cls([tuple(map(int, x)) for x in np.frombuffer(levels, np.int64).reshape(-1, 2)], np.frombuffer(words, np.uint64))
