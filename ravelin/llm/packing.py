"""Packing by concatenate and cut.

The first pass encodes each partition and writes its texts' ids with their places in the partition's own token stream. The prefix sums
of the partitions' totals, one number for each, turn those places into global offsets; the second pass cuts the global stream at
multiples of the window, so a text that crosses an edge becomes two or more pieces. No text is shuffled, and the driver holds
one total for each partition.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import WHITE, cut, ready, shared
from ravelin.llm.token_counts import byte_letters

CHUNK = f"[^{WHITE}]+"
PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Merges:
    """Byte-pair merges of many words at once, in numpy: each round applies every word's merge of lowest rank, leftmost first."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.base = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, len(pairs)).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.never = len(pairs)
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (of a byte at least), end to end in an order of their own, and each word's (first, number) there."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        sym = self.inner[data]
        sym[end - 1] = self.last[data[end - 1]]
        own, done, at = np.arange(len(words)), [], 0  # words that still merge
        where = np.zeros((len(words), 2), np.int64)
        cost = np.full(len(sym), self.never, np.int32)
        cost[:-1] = self.rank(sym[:-1], sym[1:])
        cost[end - 1] = self.never  # no merge crosses words
        while len(own):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(cost, first)
            live = least < self.never
            if not live.all():
                ready, keep = ~live, np.repeat(live, size)
                done.append(sym[~keep])
                where[own[ready], 0], where[own[ready], 1] = at + np.cumsum(size[ready]) - size[ready], size[ready]
                at += len(done[-1])
                sym, cost, own, size, least = sym[keep], cost[keep], own[live], size[live], least[live]
                if not len(own):
                    break
            word = np.repeat(np.arange(len(own)), size)
            hit = np.flatnonzero(cost == least[word])
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]  # the leftmost of each word
            sym[hit] = self.merged[least]
            gone = np.ones(len(sym), bool)
            gone[hit + 1] = False
            sym, cost, size, hit = sym[gone], cost[gone], size - 1, hit - np.arange(len(hit))
            end = np.cumsum(size)
            right, left = hit < end - 1, hit > end - size
            cost[hit] = self.never
            cost[hit[right]] = self.rank(sym[hit[right]], sym[hit[right] + 1])
            cost[hit[left] - 1] = self.rank(sym[hit[left] - 1], sym[hit[left]])
        return np.concatenate(done) if done else sym, where


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] places, then those of the next."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class Ids:
    """Token ids of texts.

    The normalizer and the pre-tokenizer drop white space and never join what it parts, so texts are encoded by their
    white-space separated chunks, each distinct one once. Below U+0130 normalizing is lower-casing, so there a chunk's words can be
    shared as well, and new words of many texts merge together; all other chunks, those that may hold a special token and very
    long ones go through the whole tokenizer. Ids of chunks lie end to end in one array.
    """

    END = "\n"  # no chunk

    def __init__(self, spec: str, end_id: int = 1):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        j = json.loads(spec)
        self.words_of = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = "".join({t["content"][0] for t in j["added_tokens"]})
        self.chunks = re.compile(CHUNK).findall
        self.merges, self.end_id = Merges(j), end_id
        self.clear()

    def clear(self) -> None:
        self.row, self.words = {self.END: 0}, {}  # of chunks and of lower-case words: the number of their ids' place
        self.where, self.n = np.zeros((1 << 16, 2), np.int64), 0
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.store(np.array([self.end_id]), np.array([[0, 1]]))

    def store(self, ids: np.ndarray, where: np.ndarray) -> range:
        """Keep ids with the places (first, number) in them of new entries; the entries' numbers."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.n + len(where) > len(self.where):
            self.where = np.append(self.where, np.zeros_like(self.where), axis=0)
        self.flat[self.used : self.used + len(ids)] = ids
        self.where[self.n : self.n + len(where)] = where + (self.used, 0)
        self.used, self.n = self.used + len(ids), self.n + len(where)
        return range(self.n - len(where), self.n)

    def parts(self, text: str) -> list[str]:
        """Chunks of a text; str.split() also splits at four separators that are not white space here."""
        return self.chunks(text) if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")) else text.split()

    def words_in(self, low: str) -> list[str]:
        """Words of a lower-case chunk that is not all letters."""
        return [low[:-1], low[-1]] if low[-1] in ".,!?:;" and low[:-1].isalpha() else self.words_of(low)

    def learn(self, chunks: list[str]) -> None:
        whole = self.END.join(chunks)
        if max(whole) >= "\u0130" or any(map(whole.__contains__, self.special)) or max(map(len, chunks)) >= 64:
            odd = lambda c: max(c) >= "\u0130" or any(map(c.__contains__, self.special)) or len(c) >= 64
            rest = list(filter(odd, chunks))
            got = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in rest]
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.row.update(zip(rest, self.store(np.fromiter(itertools.chain.from_iterable(got), np.int64, size.sum()), np.stack([np.cumsum(size) - size, size], 1))))
            chunks = [c for c in chunks if not odd(c)]
            whole = self.END.join(chunks)
        if not chunks:
            return
        low = whole.lower().split(self.END)
        alone = list(map(str.isalpha, low))
        more = [self.words_in(w) for w, a in zip(low, alone) if not a]
        new = list(dict.fromkeys(w for w in itertools.chain(itertools.compress(low, alone), itertools.chain.from_iterable(more)) if w not in self.words))
        if new:
            self.words.update(zip(new, self.store(*self.merges.ids([w.encode() for w in new]))))
        word = self.words.__getitem__
        self.row.update(zip(itertools.compress(chunks, alone), map(word, itertools.compress(low, alone))))
        if more:
            n = np.fromiter(map(len, more), np.int64, len(more))
            own = self.where[np.fromiter(map(word, itertools.chain.from_iterable(more)), np.int64, n.sum())]
            ends = np.append(0, np.cumsum(own[:, 1]))
            last = np.cumsum(n)
            first = ends[last - n]
            self.row.update(zip(itertools.compress(chunks, [not a for a in alone]), self.store(self.flat[ragged(own[:, 0], own[:, 1])], np.stack([first, ends[last] - first], 1))))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end id, end to end; and how many each has."""
        if len(self.row) > 400_000 or self.used > 4_000_000:
            self.clear()
        parts = [[*self.parts(t), self.END] for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        rows = np.fromiter(map(self.row.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = list(map(flat.__getitem__, missing.tolist()))
            self.learn(list(dict.fromkeys(new)))
            rows[missing] = np.fromiter(map(self.row.__getitem__, new), np.int64, len(new))
        first, size = self.where[rows].T
        ends = np.append(0, np.cumsum(size))
        last = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        return self.flat[ragged(first, size)], np.diff(ends[np.append(0, last)])


def splits_on_white_space(spec: str) -> bool:
    """Whether the tokenizer file drops white space before it merges, without rules that look across it."""
    j = json.loads(spec)
    steps = (j.get("normalizer") or {}).get("normalizers", [])
    split = (j.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in steps)
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(f"[{WHITE}]", t["content"]) for t in j["added_tokens"])
    return plain and added and split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed"


def slices(batch: pa.RecordBatch, rows: int = 500, most: int = 4_000_000) -> Iterator[list[pa.Array]]:
    """Columns of parts of a batch: a few hundred rows of a few MB of text (the last column), or one larger text."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        end = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right"))
        hi = min(lo + rows, max(end, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo).columns
        lo = hi


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece of a text: where it starts in the text's ids, its length, its sequence and its place there.

    Sequences hold ``window`` ids and only the last may hold fewer; ``padded_to`` is ``window``, or the number of ids if
    that is a power of two. A null or empty text is its end id alone; repeated rows are packed each; a null id stays null; other columns
    are left out; an empty table gives no rows. Texts are laid out in the order in which the first pass read them, which its written
    rows fix: tasks run again later give the same pieces.
    """
    spark = ready(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if not splits_on_white_space(spec):
        raise ValueError("the tokenizer does not drop white space before it merges")
    top = max(end_id, *json.loads(spec)["model"]["vocab"].values(), *(t["id"] for t in json.loads(spec)["added_tokens"]))
    held, stored = spark.sparkContext.broadcast(spec), "<u2" if top < 1 << 16 else "<u4"
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, at = shared("ids", (path, end_id), lambda: Ids(held.value, end_id)), TaskContext.get().partitionId(), 0
        for batch in batches:
            for who, texts in slices(batch):
                found, sizes = ids([t or "" for t in texts.to_pylist()])
                ends = np.append(0, np.cumsum(sizes))
                places, at = at + ends[:-1], at + int(ends[-1])
                data = found.astype(stored)
                data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([who, pa.array(np.full(len(sizes), part, np.int32)), pa.array(places), pa.array(sizes), data], names=["doc_id", "part", "at", "n", "ids"])

    encoded = cut(rows.mapInArrow(encode, f"doc_id {kind}, part int, at long, n long, ids binary"))
    totals = {r.part: r.total for r in encoded.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    before = dict(zip(sorted(totals), itertools.accumulate((totals[p] for p in sorted(totals)), initial=0)))
    whole = sum(totals.values())
    last = whole % window
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = PIECES.format(kind=kind) if with_ids else PIECES.format(kind=kind).removesuffix(", ids binary")
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out = []
                for who, part, at, size, data in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                    b, start, at = np.frombuffer(data, stored).astype("<u4").tobytes(), 0, before[part] + at
                    while start < size:
                        length = min(size - start, window - at % window)
                        bit = b[4 * start : 4 * (start + length)]
                        out.append((who, start, length, zlib.crc32(bit), size, at // window, at % window, bit)[: len(kinds)])
                        start += length
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(zip(*out), kinds)], schema=kinds)

    short = (F.col("sequence_id") == whole // window) & F.lit(bool(last and not last & (last - 1)))
    return encoded.mapInArrow(lay, schema).withColumn("padded_to", F.when(short, last).otherwise(window))
