"""Ids of whole texts under a byte-level BPE file, by chunks between spaces.

A text is cut at each single space and before each newline. Where no chunk is empty or ends in white space, every cut lies between a
character that is not white and a run of white space, and no pre-token holds the two: so chunks have ids of their own and each distinct one
is encoded once. Texts with other white space (double, leading, trailing) go through the library whole.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from ravelin.llm.common import WHITE
from ravelin.llm.fingerprints import Fingerprints, ended, grouped, mixed, strings
from ravelin.llm.packing import Merges, ragged
from ravelin.llm.token_counts import PRE_TOKEN, byte_letters, is_plain_byte_level

#: Below this character letters and numbers are the same in all versions of Unicode; above it the library decides.
KNOWN = "ɐ"


class Places:
    """Ids of entries end to end in one array that grows; an entry's number gives its (first, number) there."""

    def __init__(self, kind=np.uint32):
        self.where, self.n = np.zeros((1 << 16, 2), np.int64), 0
        self.flat, self.used = np.zeros(1 << 18, kind), 0

    def store(self, ids: np.ndarray, where: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.n + len(where) > len(self.where):
            self.where = np.append(self.where, np.zeros_like(self.where), axis=0)
        self.flat[self.used : self.used + len(ids)] = ids
        self.where[self.n : self.n + len(where)] = where + (self.used, 0)
        self.used, self.n = self.used + len(ids), self.n + len(where)
        return np.arange(self.n - len(where), self.n)

    def lists(self, ids: list[list[int]]) -> np.ndarray:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return self.store(np.fromiter(itertools.chain.from_iterable(ids), np.int64, size.sum()), np.stack([np.cumsum(size) - size, size], 1))

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries, end to end, and how many each has."""
        first, size = self.where[rows].T
        return self.flat[ragged(first, size)], size


class ByteIds:
    """Ids of surfaces (chunks with the white space before them), as the library gives them."""

    def __init__(self, spec: str, plain_specials: bool = False):
        j = json.loads(spec)
        if not is_plain_byte_level(j):
            raise ValueError("only byte-level BPE files without normalizer, prefix space or options of added tokens are handled")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        self.special = [] if plain_specials else [ord(t["content"][0]) for t in j["added_tokens"]]
        # Every entry of the vocabulary merges back to itself alone, so merging by the ranks of entries is merging by the list of merges.
        raw = {c: b for b, c in byte_letters().items()}
        entries = {bytes(map(raw.__getitem__, v)): i for v, i in j["model"]["vocab"].items() if v not in {t["content"] for t in j["added_tokens"]}}
        ids, where = Merges({"model": j["model"] | {"end_of_word_suffix": ""}}).ids(list(entries))
        if not np.array_equal(ids[where[:, 0]], list(entries.values())) or (where[:, 1] != 1).any() or sorted(entries.values()) != list(range(len(entries))):
            raise ValueError("an entry of the vocabulary does not merge back to itself")
        self.ranks = tiktoken.Encoding("bytes", pat_str=PRE_TOKEN, mergeable_ranks=entries, special_tokens={})
        self.size = np.zeros(max(entries.values()) + 1, np.int64)
        self.size[list(entries.values())] = list(map(len, entries))

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def odd(self, surfaces: list[str]) -> np.ndarray:
        """Which surfaces the library itself shall encode: a special token may be in them, they are long, do not begin with white space, or have letters of later classes."""
        size = np.fromiter(map(len, surfaces), np.int64, len(surfaces))
        code = np.frombuffer("".join(surfaces).encode("utf-32-le"), np.uint32)
        end = np.cumsum(size)
        out = (size >= 64) | ~np.isin(code[end - size], (32, 10))
        out[np.searchsorted(end, np.flatnonzero((code >= ord(KNOWN)) | np.isin(code, self.special)), side="right")] = True
        return out

    def learned(self, surfaces: list[str], out: Places) -> np.ndarray:
        """Entries of ``out`` that hold the surfaces' ids."""
        odd = self.odd(surfaces)
        rows = np.zeros(len(surfaces), np.int64)
        if odd.any():
            rows[odd] = out.lists(self.whole(list(itertools.compress(surfaces, odd))))
            surfaces = list(itertools.compress(surfaces, ~odd))
        if surfaces:  # no pre-token crosses two of them
            ids = np.array(self.ranks.encode_ordinary("".join(surfaces)), np.int64)
            size = np.fromiter(map(len, map(str.encode, surfaces)), np.int64, len(surfaces))
            last = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size)) + 1
            first = np.append(0, last[:-1])
            rows[~odd] = out.store(ids, np.stack([first, last - first], 1))
        return rows


class Chunks:
    """Texts as numbers of their chunks in a table of the distinct ones that this worker has met.

    ``learn`` gets new keys with no irregular one among them and gives their numbers. A key is a chunk without the space before it; that of a
    text's first chunk has a space before it instead, where ``firsts`` asks to tell it apart.
    """

    def __init__(self, learn, firsts: bool):
        self.learn, self.firsts, self.prints, self.row = learn, firsts, Fingerprints(), {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all texts' chunks end to end, how many each text has, how often each of some numbers occurs, and which texts are irregular (they have no chunks)."""
        buffer, places = ended(texts, " ")
        end = np.flatnonzero((buffer == 32) | (buffer == 10))
        start = np.append(0, end[:-1] + (buffer[end[:-1]] == 32)) if len(end) else end
        own = np.searchsorted(end, places[1:] - 1) + 1  # chunks up to the end of each text
        count = np.diff(np.append(0, own))
        text = np.repeat(np.arange(len(texts)), count)
        key = self.prints.of(self.prints.prefix(buffer), start, end)
        first = None
        if self.firsts:
            first = np.zeros(len(start), bool)
            first[own - count] = True
            key = key * np.uint64(2) + first
        some, inverse, times = grouped(buffer, start, end, mixed(key), first)
        names = strings(buffer, start[some], end[some])
        if first is not None:
            for k in np.flatnonzero(first[some]):
                names[k] = " " + names[k]
        rows = np.fromiter(map(self.row.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(rows == -1)
        if len(missing):
            new = list(map(names.__getitem__, missing.tolist()))
            bad = {n for n in new if not n or n[-1] in WHITE}
            self.row.update(zip(bad, itertools.repeat(-2)))
            good = list(itertools.filterfalse(bad.__contains__, new)) if bad else new
            if good:
                self.row.update(zip(good, self.learn(good).tolist()))
            rows[missing] = np.fromiter(map(self.row.__getitem__, new), np.int64, len(new))
        empty = np.diff(places) == 1
        odd = np.zeros(len(texts), bool)
        if (rows < 0).any():
            odd[text[rows[inverse] < 0]] = True
            keep = ~odd[text]
            inverse, count = inverse[keep], np.where(odd, 0, count)
            times = np.bincount(inverse, minlength=len(rows))
        return rows[inverse], count, np.stack([rows, times], 1)[(rows >= 0) & (times > 0)], odd & ~empty


class TextIds:
    """Ids of many texts, each with its end id."""

    def __init__(self, spec: str, end_id: int, most: int = 400_000):
        self.encoder, self.end_id, self.most = ByteIds(spec), end_id, most
        self.chunks = Chunks(self.learn, firsts=True)
        self.clear()

    def clear(self) -> None:
        self.places, self.chunks.row = Places(), {}
        self.end = int(self.places.lists([[self.end_id]])[0])

    def learn(self, keys: list[str]) -> np.ndarray:
        return self.encoder.learned([k[1:] if k[0] == " " else k if k[0] == "\n" else " " + k for k in keys], self.places)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        if len(self.chunks.row) > self.most or self.places.used > 4_000_000:
            self.clear()
        rows, count, _, odd = self.chunks(texts)
        if odd.any():
            at = np.flatnonzero(odd)
            own = self.places.lists(self.encoder.whole([texts[int(k)].as_py() for k in at]))
            rows = np.insert(rows, np.cumsum(count)[at], own)
            count = count + odd
        rows = np.insert(rows, np.cumsum(count), self.end)
        ids, size = self.places.taken(rows)
        ends = np.append(0, np.cumsum(size))
        return ids, np.diff(ends[np.append(0, np.cumsum(count + 1))])
