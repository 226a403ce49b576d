"""Tokens of two tokenizers aligned by bytes, and how often each pair of ids is linked in the whole corpus.

Where tokens of both end they cut a text into groups; the ends of either cut it into the links, each of one token of either side. Chunks between
spaces are cut by both tokenizers, so each distinct chunk is encoded and aligned once. The first pass gives every task's linked pairs
with their counts; distinct pairs get places by minimal perfect hashing, bucket by bucket, and counts add up in a tree as dense vectors
indexed by place. The second pass aligns the texts again and looks the counts up, verified by the keys.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.chunk_ids import ByteIds, Chunks, Places
from ravelin.llm.common import ready, shared, written
from ravelin.llm.fingerprints import mixed
from ravelin.llm.packing import slices
from ravelin.llm.perfect_hash import PerfectHash
from ravelin.llm.token_counts import byte_letters

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """Ids of a SentencePiece BPE model, and the bytes of each."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        normal = [p.piece for p in proto.pieces if p.type == NORMAL]
        plain = not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces and proto.normalizer_spec.add_dummy_prefix
        if not plain or not proto.trainer_spec.byte_fallback or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal) or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces):
            raise ValueError("only models with identity normalization, byte fallback, a space before the text, and no piece across spaces or lines are handled")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.mark = self.library.piece_to_id(SPACE)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"" for p in proto.pieces]

    def learned(self, keys: list[str]) -> list[list[int]]:
        """Ids of chunks: with the mark before them, but for those that begin with a newline."""
        got = self.library.encode(keys, num_threads=1)
        return [g[1:] if k[0] == "\n" else g for k, g in zip(keys, got)]


class Aligner:
    """Aligned chunks: ids of both sides, groups as text, links as pairs of ids. Entries are numbered alike in all of them."""

    def __init__(self, spec: str, model: bytes, most: int):
        self.a, self.b, self.most = ByteIds(spec, plain_specials=True), Pieces(model), most
        raw = {c: b for b, c in byte_letters().items()}
        vocab = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(raw.__getitem__, token)) if set(token) <= set(raw) else token.encode()
        self.n_b = len(self.b.bytes)
        tables = lambda every: (pa.array(every, pa.large_binary()), np.fromiter(map(len, every), np.int64, len(every)))
        (self.a_table, self.a_size), (self.b_table, self.b_size) = tables(self.a_bytes), tables(self.b.bytes)
        # Ids in decimal with what follows them: , | ; or nothing.
        self.names = pa.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(max(len(self.a_bytes), self.n_b))], pa.large_string())
        self.chunks = Chunks(self.learn, firsts=False)
        self.clear()

    def clear(self) -> None:
        self.chunks.row = {}
        self.ids_a, self.ids_b, self.links, self.text = Places(), Places(), Places(np.uint64), []
        self.groups, self.good = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)

    def room(self) -> None:
        if len(self.chunks.row) > self.most or self.links.used > 20 * self.most:
            self.clear()

    def learn(self, keys: list[str]) -> np.ndarray:
        return self.store([k if k[0] == "\n" else " " + k for k in keys], self.b.learned(keys))

    def whole(self, texts: list[str]) -> np.ndarray:
        """Entries of whole texts."""
        return self.store([" " + t for t in texts], self.b.library.encode(texts, num_threads=1))

    def store(self, surfaces: list[str], ids_b: list[list[int]]) -> np.ndarray:
        """Align surfaces, all at once, as if they were one text cut between them."""
        at = self.ids_a.n
        rows = self.a.learned(surfaces, scratch := Places())
        a, n_a = scratch.taken(rows)
        n_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        b = np.fromiter(itertools.chain.from_iterable(ids_b), np.int64, n_b.sum())
        own = [s.encode() for s in surfaces]
        size = np.fromiter(map(len, own), np.int64, len(own))
        data = b"".join(own)
        size_a, size_b = (np.add.reduceat(np.append(s[i], 0), np.append(0, np.cumsum(n))[:-1]) * (n > 0) for s, i, n in ((self.a_size, a, n_a), (self.b_size, b, n_b)))
        good = (size_a == size) & (size_b == size)
        for table, ids, n in ((self.a_table, a, n_a), (self.b_table, b, n_b)):
            use = np.repeat(good, n)
            joined = table.take(pa.array(ids[use])).buffers()[2]
            if (joined.to_pybytes() if joined is not None else b"") != (data if good.all() else b"".join(itertools.compress(own, good))):
                ends = np.append(0, np.cumsum(n))
                lookup = self.a_bytes if table is self.a_table else self.b.bytes
                for k in np.flatnonzero(good):
                    good[k] = b"".join(lookup[i] for i in ids[ends[k] : ends[k + 1]]) == own[k]
        # Surfaces that don't come back from their tokens have none.
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, size = n_a * good, n_b * good, size * good
        end_a, end_b, end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(size)
        both = np.union1d(end_a, end_b)
        pair = a[np.searchsorted(end_a, both)].astype(np.uint64) * np.uint64(self.n_b) + b[np.searchsorted(end_b, both)].astype(np.uint64)
        common = np.intersect1d(end_a, end_b)
        upto = lambda ends: np.searchsorted(ends, end, side="right")
        n_links, n_groups = np.diff(np.append(0, upto(both))), np.diff(np.append(0, upto(common)))
        # a1,a2|b1;a3|b2,b3: tokens in the order of their groups, each with what follows it.
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        closes = np.isin(end_b, end)  # the surface's last token
        width = len(self.names) // 4
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + width * last_a
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + width * np.where(closes, 3, 2 * last_b)
        shown = self.names.take(pa.array(order))
        offsets = np.frombuffer(shown.buffers()[1], np.int64)[shown.offset : shown.offset + len(shown) + 1]
        text, cut = shown.buffers()[2], offsets[np.append(0, np.cumsum(n_a + n_b))]
        text = text.to_pybytes() if text is not None else b""
        self.text += [text[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for places, flat, n in ((self.ids_a, a, n_a), (self.ids_b, b, n_b), (self.links, pair, n_links)):
            places.store(flat, np.stack([np.cumsum(n) - n, n], 1))
        while len(self.groups) < self.ids_a.n:
            self.groups, self.good = np.append(self.groups, np.zeros_like(self.groups)), np.append(self.good, np.zeros_like(self.good))
        self.groups[at : self.ids_a.n], self.good[at : self.ids_a.n] = n_groups, good
        return np.arange(at, self.ids_a.n)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Entries of all texts end to end, and how many each has. Texts with an entry that doesn't come back have none."""
        rows, count, _, odd = self.chunks(texts)
        if odd.any():
            at = np.flatnonzero(odd)
            rows = np.insert(rows, np.cumsum(count)[at], self.whole([texts[int(k)].as_py() for k in at]))
            count = count + odd
        if not self.good[rows].all():
            text = np.repeat(np.arange(len(texts)), count)
            bad = np.zeros(len(texts), bool)
            bad[text[~self.good[rows]]] = True
            rows, count = rows[~bad[text]], count * ~bad
        return rows, count


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(n[order], head)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) >> np.uint64(40)).astype(np.int64) % buckets


def pair_rows(rows: DataFrame, make, buckets: int, held: int = 3_000_000) -> DataFrame:
    """(bucket, keys, n): a task's linked pairs with their counts, dealt over buckets. Counts are of chunks first, so a chunk's links are looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = make()
        keys, n, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        times = np.zeros(0, np.int64)

        def gather() -> None:
            nonlocal keys, n, times
            used = np.flatnonzero(times)
            pairs, size = align.links.taken(used)
            keys, n = summed(np.append(keys, pairs), np.append(n, np.repeat(times[used], size)))
            times = np.zeros(0, np.int64)

        def put() -> Iterator[pa.RecordBatch]:
            own = bucket_of(keys, buckets)
            order = np.argsort(own, kind="stable")
            edge = np.append(np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])), len(order))
            for s, e in zip(edge[:-1], edge[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(own[order[s : s + 1]]), pa.array([keys[order[s:e]].tobytes()], pa.binary()), pa.array([n[order[s:e]].tobytes()], pa.binary())], names=["bucket", "keys", "n"])

        for batch in batches:
            for (texts,) in slices(batch, 4000, 3_000_000):
                if len(align.chunks.row) > align.most or align.links.used > 20 * align.most:
                    gather()
                    align.clear()
                entries, _ = align(texts)
                more = np.bincount(entries, minlength=align.ids_a.n)
                more[: len(times)] += times
                times = more
            if len(keys) > held:
                gather()
                yield from put()
                keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        gather()
        if len(keys):
            yield from put()

    return rows.select("text").mapInArrow(run, "bucket long, keys binary, n binary")


def places_of(pairs: DataFrame) -> DataFrame:
    """(bucket, size, levels, words, keys): a minimal perfect hash of each bucket's distinct keys, and those in the order of their places."""

    def build(t: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in t["keys"].to_pylist()]))
        found = PerfectHash.of(keys)
        laid = np.empty_like(keys)
        laid[found(keys)] = keys
        levels, words = found.packed()
        return pa.table({"bucket": t["bucket"].slice(0, 1), "size": pa.array([len(keys)]), "levels": pa.array([levels], pa.binary()), "words": pa.array([words], pa.binary()), "keys": pa.array([laid.tobytes()], pa.binary())})

    return pairs.select("bucket", "keys").groupBy("bucket").applyInArrow(build, "bucket long, size long, levels binary, words binary, keys binary")


def dense_counts(pairs: DataFrame, places: DataFrame, salts: int = 16) -> DataFrame:
    """(bucket, n): each bucket's counts by place. Rows meet their bucket's hash, become dense vectors, and these add up by salt, then by bucket."""

    def add(t: pa.Table) -> pa.Table:
        found = PerfectHash.unpacked(t["levels"][0].as_py(), t["words"][0].as_py())
        out = np.zeros(len(found), np.int64)
        for keys, n in zip(t["keys"].to_pylist(), t["n"].to_pylist()):
            out[found(np.frombuffer(keys, np.uint64))] += np.frombuffer(n, np.int64)  # a row's keys are distinct
        return pa.table({"bucket": t["bucket"].slice(0, 1), "n": pa.array([out.tobytes()], pa.binary())})

    def both(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": t["bucket"].slice(0, 1), "n": pa.array([np.sum([np.frombuffer(b, np.int64) for b in t["n"].to_pylist()], axis=0).tobytes()], pa.binary())})

    met = pairs.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(salts))).join(places.select("bucket", "levels", "words"), "bucket")
    return met.groupBy("bucket", "salt").applyInArrow(lambda t: add(t), "bucket long, n binary").groupBy("bucket").applyInArrow(lambda t: both(t), "bucket long, n binary")


class Counts:
    """Counts of pairs by place in a table, verified by the pairs themselves."""

    def __init__(self, parts: list[tuple[int, bytes, bytes, bytes, bytes]], buckets: int, n_b: int):
        self.buckets = buckets
        self.hashes = {b: PerfectHash.unpacked(levels, words) for b, levels, words, _, _ in parts}
        self.keys = {b: np.frombuffer(k, np.uint64) for b, _, _, k, _ in parts}
        self.n = {b: np.frombuffer(n, np.int64) for b, _, _, _, n in parts}
        self.best = np.zeros(n_b, np.int64)  # the highest count of each id of B
        for b, keys in self.keys.items():
            np.maximum.at(self.best, (keys % np.uint64(n_b)).astype(np.int64), self.n[b])

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        """Each pair's count; 0 for one that the first pass has not seen."""
        out, own = np.zeros(len(pairs), np.int64), bucket_of(pairs, self.buckets)
        for b in np.unique(own):
            mine = np.flatnonzero(own == b)
            if b in self.hashes:
                place = self.hashes[b](pairs[mine])
                out[mine] = np.where((place >= 0) & (self.keys[b][place] == pairs[mine]), self.n[b][place], 0)
        return out


OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(align: Aligner, entries: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    ends = np.append(0, np.cumsum(count))
    per = lambda v: np.diff(np.append(0, np.cumsum(v))[ends])
    return [per(v[entries]) for v in (align.ids_a.where[:, 1], align.ids_b.where[:, 1], align.groups, align.links.where[:, 1])]


def _digests(align: Aligner, entries: np.ndarray, count: np.ndarray) -> list[str]:
    texts, out, at = list(map(align.text.__getitem__, entries.tolist())), [], 0
    for n in count.tolist():
        out.append(hashlib.sha256(b";".join(texts[at : at + n])).hexdigest() if n else "")
        at += n
    return out


def align_tokens(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = 8_000_000, memory: int = 200_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE file, given a space and the text with special strings as plain text; B a SentencePiece BPE model, given the text. Texts that are null or
    empty, or whose tokens don't come back to a space and the text, have zeros and an empty digest. n_best counts the links whose pair is as frequent in the whole table as any
    of its B id, ties included; count_sum adds up the pairs' counts over the links. Repeated rows count each and give a row each; a null id stays null; very long texts are aligned
    whole; other columns are left out; an empty table gives no rows. The table of counts is sent to the tasks up to ``most_pairs`` distinct pairs; with more, links meet their counts in a
    join. ``memory`` chunks are remembered in a task; more are learned anew.
    """
    spark = ready(docs.sparkSession)
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        held = spark.sparkContext.broadcast((f.read(), g.read()))
    n_b = Aligner(*held.value, 1000).n_b
    make = lambda: shared("aligner", (path_a, path_b, memory), lambda: Aligner(*held.value, memory))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = 1 << max(2, min(20, int(size // 100_000_000).bit_length()))
    pairs = written(pair_rows(rows, make, buckets))
    places = written(places_of(pairs))
    distinct = places.agg(F.sum("size").alias("n")).first().n or 0
    counts = written(dense_counts(pairs, places))
    if distinct > most_pairs:
        return _joined(rows, make, places, counts, n_b, kind)
    parts = [tuple(r) for r in places.join(counts, "bucket").select("bucket", "levels", "words", "keys", "n").collect()]  # some 17 bytes for each of most_pairs
    sent = spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, table = make(), Counts(sent.value, buckets, n_b)
        sums, bests, unseen, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # of the entries so far
        align.clear()
        for batch in batches:
            for who, texts in slices(batch, 4000, 3_000_000):
                if len(align.chunks.row) > align.most or align.links.used > 20 * align.most:
                    align.clear()
                    known = 0
                    sums, bests, unseen = sums[:0], bests[:0], unseen[:0]
                entries, count = align(texts)
                new, own = align.links.taken(np.arange(known, align.ids_a.n))
                c = table(new)
                hit = (c == table.best[(new % np.uint64(n_b)).astype(np.int64)]).astype(np.int64)
                ends = np.append(0, np.cumsum(own))
                sums, bests, unseen = (np.append(old, np.diff(np.append(0, np.cumsum(v))[ends])) for old, v in ((sums, c), (bests, hit), (unseen, (c == 0).astype(np.int64))))
                known = align.ids_a.n
                if unseen[entries].any():  # only entries of texts without tokens may be
                    raise ValueError("a link that the first pass has not seen")
                edge = np.append(0, np.cumsum(count))
                more = [np.diff(np.append(0, np.cumsum(v[entries]))[edge]) for v in (bests, sums)]
                yield pa.RecordBatch.from_arrays([who, *map(pa.array, _sums(align, entries, count)), *map(pa.array, more), pa.array(_digests(align, entries, count))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, {OUT}")


def _joined(rows: DataFrame, make, places: DataFrame, counts: DataFrame, n_b: int, kind: str) -> DataFrame:
    """The second pass where counts are too many to send: each text's distinct pairs meet their counts, then add up by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = make()
        for batch in batches:
            for who, texts in slices(batch, 1000, 1_000_000):
                align.room()
                entries, count = align(texts)
                pair, size = align.links.taken(entries)
                ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
                own = [summed(pair[s:e], np.ones(e - s, np.int64)) for s, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([who, *map(pa.array, _sums(align, entries, count)), pa.array(_digests(align, entries, count)), pa.array([k.view(np.int64) for k, _ in own], pa.list_(pa.int64())), pa.array([n for _, n in own], pa.list_(pa.int64()))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["pair", "n"])

    texts = written(rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
    known = places.join(counts, "bucket").select("keys", "n").mapInArrow(flat, "pair long, n long")
    best = known.groupBy((F.col("pair") % n_b).alias("id")).agg(F.max("n").alias("best"))  # a row for each id of B
    known = known.join(best, F.col("pair") % n_b == F.col("id")).select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("hit"))
    links = texts.select("row", F.inline(F.arrays_zip("pairs", "times"))).select("row", F.col("pairs").alias("pair"), "times").join(known, "pair")
    sums = links.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.col("times") * F.col("hit")).alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return texts.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
