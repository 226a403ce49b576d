"""Removal of passages that occur earlier, with suffix arrays built in shards.

A byte string of the given length holds a *minimizer*: the k-gram of least hash among its own. Equal strings have equal minimizers at
equal places, so strings can only repeat around minimizers that repeat. The surroundings of those (every
string that holds the minimizer) go to the shard of its hash; equal surroundings are one, kept by its first place. Each shard
sorts the suffixes of what differs by induced sorting, and a common-prefix run of the length marks all but its first place.
"""

from __future__ import annotations

import gc
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import cut, ready, shared, written
from ravelin.llm.induced_sorting import permuted_common_prefixes, suffix_array

K = 32
#: Odd multiplier and its inverse modulo 2^64 for the rolling hash.
BASE = 0x9E3779B97F4A7C15
U = np.uint64


class Anchors:
    """Minimizers of many texts at once: (text number, place, hash, hash of the surroundings)."""

    def __init__(self, length: int, k: int = K):
        self.length, self.k, self.w = length, k, length - k + 1
        self.letters = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.int64).astype(U)
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 18)
            fill = lambda b: np.cumprod(np.concatenate([[U(1)], np.full(n, U(b % 2**64))]), dtype=U)
            self.up, self.down = fill(BASE), fill(pow(BASE, -1, 2**64))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        length, k, w = self.length, self.k, self.w
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        if n < length:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
        self.powers(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(self.letters[data] * self.up[:n], out=sums[1:])
        h = mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        order = (h >> U(32)).astype(np.uint32)
        # Strings must lie inside one text; sizes as seen from each byte.
        left = np.repeat(first + sizes, sizes)  # end of the own text
        inside = left[: n - length + 1] >= np.arange(length, n + 1)
        least = np.where(inside, slide(order, w, np.minimum), 0)
        wide = np.concatenate([np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32)])
        at = np.flatnonzero((slide(wide, w, np.maximum) == order) & (order > 0))
        text = np.searchsorted(first, at, side="right") - 1
        start, end = np.maximum(at - (length - k), first[text]), np.minimum(at + length, first[text] + sizes[text])
        around = mixed((sums[end] - sums[start]) * self.down[start] + (at - start).astype(U) * U(0xD1B54A32D192ED03) + (end - at).astype(U))
        return text, at - first[text], h[at], around


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w."""
    y, s = x, 1
    while 2 * s <= w:
        y, s = f(y[:-s], y[s:]), 2 * s
    return f(y[: len(x) - w + 1], y[w - s : w - s + len(x) - w + 1])


def batches_of(texts: list[bytes], most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, small enough for a processor's cache."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def anchors(docs: DataFrame, length: int, together: int = 300_000) -> DataFrame:
    """Minimizers of all texts: hash, around, row, at.

    Of equal surroundings that one task meets together only the first is sent; the others are decided, which a negative place
    (-1 - at) says, and their hash is the row's own, so that they spread.
    """

    def send(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, around, row, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, row, around, h))
        h, around, row, at = h[order], around[order], row[order], at[order]
        later = np.append(False, (h[1:] == h[:-1]) & (around[1:] == around[:-1]))
        h = np.where(later, mixed(row.astype(U)), h)
        return pa.RecordBatch.from_pydict({"hash": h.view(np.int64), "around": around.view(np.int64), "row": row, "at": np.where(later, -1 - at, at).astype(np.int32)})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, parts, size = shared("anchors", length, lambda: Anchors(length)), [], 0
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 500):
                texts = [(t or "").encode() for t in batch.column(1).slice(lo, 500).to_pylist()]
                for s, e in batches_of(texts):
                    text, at, h, around = finder.of(texts[s:e])
                    parts.append((h, around, rows[lo + s + text], at))
                    size += len(h)
                    if size > together:
                        yield send(parts)
                        parts, size = [], 0
        if size:
            yield send(parts)

    return docs.select("row", "text").mapInArrow(find, "hash long, around long, row long, at int")


def sift(found: DataFrame, length: int, hot: int) -> DataFrame:
    """Of minimizers in the order of their hashes: spans already decided (start, end), and places to look closer at (hash, at, hot).

    A place that has one surrounding only needs no more than its copies' removal. A hash with more than ``hot`` places to look at is hot;
    no more than that many are held at a time.
    """
    back = length - K

    def out(row, start=None, end=None, hash_=None, at=None, hot_=None) -> pa.RecordBatch:
        n = len(row)
        full = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays([pa.array(row), full(start, pa.int32()), full(end, pa.int32()), full(hash_, pa.int64()), full(at, pa.int32()), full(hot_, pa.bool_())], names=["row", "start", "end", "hash", "at", "hot"])

    def span(row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return out(row, np.maximum(at - back, 0).astype(np.int32), (at + length).astype(np.int32))

    def groups(h: np.ndarray, around: np.ndarray, row: np.ndarray, at: np.ndarray, burning: bool) -> Iterator[pa.RecordBatch]:
        new = np.append(True, h[1:] != h[:-1])
        kind = new | np.append(True, around[1:] != around[:-1])
        first = np.flatnonzero(new)
        kinds = np.repeat(np.add.reduceat(kind.astype(np.int64), first), np.diff(np.append(first, len(h))))
        if burning:
            kinds[:] = hot + 1
        if (~kind).any():
            yield span(row[~kind], at[~kind])
        look = kind & (kinds > 1)
        if look.any():
            yield out(row[look], hash_=h[look], at=at[look], hot_=kinds[look] > hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, burning = None, None
        for b in batches:
            h, around, row, at = (c.to_numpy() for c in b.columns)
            if (done := at < 0).any():
                yield span(row[done], -1 - at[done])
                h, around, row, at = h[~done], around[~done], row[~done], at[~done]
            if held is not None:
                h, around, row, at = (np.concatenate(x) for x in zip(held, (h, around, row, at)))
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1]))  # the last hash may go on
            if burning is not None and len(own := np.flatnonzero(h == burning)):
                yield from groups(*(x[own] for x in (h, around, row, at)), True)
                h, around, row, at = (x[len(own) :] for x in (h, around, row, at))
                last = max(0, last - len(own))
            if last:
                yield from groups(h[:last], around[:last], row[:last], at[:last], False)
            held = tuple(x[last:].copy() for x in (h, around, row, at))
            if len(held[0]) > 4 * hot:
                burning = held[0][0]
                yield from groups(*held, True)
                held = None
            elif not len(held[0]):
                held = None
        if held is not None:
            yield from groups(*held, held[0][0] == burning)

    return found.mapInArrow(run, "row long, start int, end int, hash long, at int, hot boolean")


def marked_in(shard: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of strings of ``length`` in the shard's pieces (row, start, bytes) that occur at an earlier place there."""
    data = np.frombuffer(b"\xff".join(p[2] for p in shard) + b"\xff", np.uint8)  # no byte of UTF-8
    sizes = np.array([len(p[2]) for p in shard])
    first = np.cumsum(sizes + 1) - sizes - 1
    piece = np.repeat(np.arange(len(shard)), sizes + 1)
    inside = np.arange(len(data)) - first[piece]
    sa = suffix_array(data)
    sa = sa[(sizes[piece] - inside >= length)[sa]]  # suffixes that hold a string of the length, in their order
    rows, starts = np.array([p[0] for p in shard]), np.array([p[1] for p in shard])
    runs = np.cumsum(permuted_common_prefixes(data, sa, length)[sa] < length)
    row, start = rows[piece[sa]], starts[piece[sa]] + inside[sa]
    order = np.lexsort((start, row, runs))
    row, start, runs = row[order], start[order], runs[order]
    lead = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, np.int64)
    own = np.repeat(lead, np.diff(np.append(lead, len(runs))))
    later = (row != row[own]) | (start != start[own])
    return joined(row[later], start[later], start[later] + length)


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Overlapping or touching spans of a row as one."""
    if not len(row):
        return []
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    span = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(end + (np.cumsum(np.append(False, row[1:] != row[:-1])) * span)) - np.cumsum(np.append(False, row[1:] != row[:-1])) * span
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])))
    return list(zip(row[new].tolist(), start[new].tolist(), reach[np.append(new[1:], len(row)) - 1].tolist()))


def pieces_of(group: list[tuple[int, int, int, bytes]], length: int, k: int, cuts: int = 8) -> tuple[list, list]:
    """Of the surroundings (row, place, start, bytes) of one minimizer: pieces for the suffix array, and spans already decided.

    The strings are dealt into a few ranges by the minimizer's place in them. All strings of a range share the bytes between
    its innermost edges, so a range whose shared bytes occur once holds nothing repeated, and equal ranges are one.
    """
    spread, out, done = length - k + 1, [], []
    step = -(-spread // cuts)
    kinds: dict[tuple[int, bytes], dict[bytes, tuple[int, int]]] = defaultdict(dict)
    for row, at, start, data in group:
        left, right = at - start, start + len(data) - at
        for lo in range(0, spread, step):
            d0, d1 = max(lo, length - right), min(lo + step, spread, left + 1)
            if d0 < d1:
                top = min(lo + step, spread) - 1
                shared = data[left - lo : left - top + length]
                own, place = data[left - d1 + 1 : left - d0 + length], at - d1 + 1
                seen = kinds[lo, shared]
                was = seen.get(own)
                if was is None:
                    seen[own] = (row, place)
                elif was != (row, place):
                    late = max(was, (row, place))
                    seen[own] = min(was, (row, place))
                    done.append((late[0], late[1], late[1] + len(own)))
    for seen in kinds.values():
        if len(seen) > 1:
            out += [(row, place, own) for own, (row, place) in seen.items()]
    return out, done


def repeated_spans(docs: DataFrame, length: int = 100, shard_bytes: int = 2_000_000, hot: int | None = None, part_bytes: int = 256_000_000) -> DataFrame:
    """(row, start, end) of spans whose strings of ``length`` bytes all start earlier too; ``docs`` has unique long rows, in order, and texts.

    Minimizers are sorted in as many partitions as the session names, and more where ``part_bytes`` of text each ask for them.
    """
    spark = ready(docs.sparkSession)
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts, back = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // part_bytes + 1), length - K
    hot = hot or min(50_000, max(2_000, count // 16))
    ordered = anchors(docs, length).repartition(parts, "hash").sortWithinPartitions("hash", "around", "row", "at")
    sifted = written(sift(ordered, length, hot))
    tidy(spark)
    whole = sifted.where("start is not null").select("row", "start", "end")
    places = sifted.where("hash is not null").select("row", "hash", "at", "hot")
    total, anyhot = places.agg(F.count("*"), F.coalesce(F.bool_or("hot"), F.lit(False))).first()
    byrow = places.groupBy("row").agg(F.collect_list(F.struct("hash", "at", "hot")).alias("places"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for row, text, places in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns)):
                    data = text.encode()
                    for p in places:
                        start = max(0, p["at"] - back)
                        out.append((p["hash"], p["hot"], row, p["at"], start, data[start : p["at"] + length]))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(("hash", "hot", "row", "at", "start", "data"), map(list, zip(*out)))), schema=pa.schema([("hash", pa.int64()), ("hot", pa.bool_()), ("row", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("data", pa.binary())]))

    around = docs.select("row", "text").join(byrow, "row").select("row", "text", "places").mapInArrow(cut_out, "hash long, hot boolean, row long, at int, start int, data binary")
    shards = max(parts, int(total * (2 * length - K) // shard_bytes) + 1)

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        """Rows come in the order of their hashes; a shard is a run of whole groups."""
        pieces, size, group, now = [], 0, [], None
        for batch in batches:
            for h, row, at, start, data in zip(*(c.to_pylist() for c in batch.select(["hash", "row", "at", "start", "data"]).columns)):
                if h != now and group:
                    more, done = pieces_of(group, length, K)
                    pieces += more
                    size += sum(len(p[2]) + 1 for p in more)
                    yield from spans(done)
                    group = []
                    if size > shard_bytes:
                        yield from spans(marked_in(pieces, length))
                        pieces, size = [], 0
                now = h
                group.append((row, at, start, data))
        if group:
            more, done = pieces_of(group, length, K)
            pieces += more
            yield from spans(done)
        if pieces:
            yield from spans(marked_in(pieces, length))

    out = whole
    cool = around.where("not hot").select("hash", "row", "at", "start", "data").repartition(shards, "hash").sortWithinPartitions("hash", "row", "at")
    out = out.union(cool.mapInArrow(sort_shards, "row long, start int, end int"))
    if anyhot:
        out = out.union(hot_spans(around.where("hot"), length))
    return out


def spans(found: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        row, start, end = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["row", "start", "end"])


def hot_spans(around: DataFrame, length: int) -> DataFrame:
    """The same for minimizers with too many different surroundings for one task: their strings meet one by one, by digest."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length)
        finder.powers(1 << 12)
        for batch in batches:
            for row, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) - length + 1
                if n > 0:
                    letters = finder.letters[np.frombuffer(data, np.uint8)]
                    two = []
                    for up, down in ((finder.up, finder.down), (finder.down, finder.up)):  # two independent bases
                        sums = np.concatenate([[U(0)], np.cumsum(letters * up[: len(data)], dtype=U)])
                        two.append(pa.array(mixed((sums[length:] - sums[:-length]) * down[:n]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*two, pa.array(np.full(n, row)), pa.array(np.arange(start, start + n, dtype=np.int32))], names=["d", "e", "row", "start"])

    every = around.select("row", "start", "data").mapInArrow(strings, "d long, e long, row long, start int")
    kinds = every.groupBy("d", "e").agg(F.min(F.struct("row", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = every.join(kinds, ["d", "e"]).where("row <> f.row or start <> f.start")
    return later.select("row", "start", (F.col("start") + length).cast("int").alias("end"))


def tidy(spark) -> None:
    """Let Spark drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text); with ``with_text``, kept: the kept
    bytes as text, without fragments of characters that a cut went through.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller id, or before in the same text. Null
    and short texts lose nothing, except that a null text counts as empty. Rows equal in id and text are one document and share
    its result; different texts of one id, null ids (last) and ids that are no integers are ordered by id, then text. Columns named
    in ``carry`` come along; others are left out.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = [f"carried_{k}" for k in range(len(carry))]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(F.col(n).alias(c) for c, n in zip(carried, carry)))
    if kind in ("bigint", "int", "smallint", "tinyint") and not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").take(1):
        rows = rows.withColumn("row", F.col("doc_id").cast("long"))
        base = rows.select("row", "text")
    else:
        sort = [F.col("doc_id").asc_nulls_last(), F.col("text")]
        base = cut(rows.select("doc_id", "text").distinct().repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("row", F.monotonically_increasing_id()))
        own = base.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), "row")
        rows = rows.join(own, rows.doc_id.eqNullSafe(own.i) & (rows.text == own.t)).drop("i", "t")
        base = base.select("row", "text")
    marks = repeated_spans(base, length).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marks = written(marks)
    tidy(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    data, spans_ = text.encode(), []
                    if found:
                        n = len(found)
                        se = np.fromiter((x for f in found for x in (f["start"], f["end"])), np.int64, 2 * n).reshape(n, 2)
                        spans_ = joined(np.zeros(n, np.int64), se[:, 0], np.minimum(se[:, 1], len(data)))
                    keep, at = [], 0
                    for _, s, e in spans_:
                        keep.append(data[at:s])
                        at = e
                    kept = b"".join([*keep, data[at:]])
                    out.append((len(data), len(data) - len(kept), len(spans_), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
                a = list(zip(*out))
                made = [pa.array(c, t) for c, t in zip(a, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made, *(part.column(c) for c in carried)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carried])

    more = "".join(f", {c} {docs.schema[n].dataType.simpleString()}" for c, n in zip(carried, carry))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string{more}"
    done = rows.join(marks, "row", "left").select("doc_id", "text", "spans", *carried).mapInArrow(finish, schema)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text, *(F.col(c).alias(n) for c, n in zip(carried, carry)))
