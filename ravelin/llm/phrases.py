"""Collocations: frequent phrases of a language with the score of their weakest cut.

Three passes over the texts. The first counts words. In the second, prefix polynomials over each slice of text give the fingerprint of every pair of
neighbouring words that are frequent themselves; the shuffle adds up 32 bits of them within buckets, which keeps every pair that may be frequent. The third
fingerprints all phrases of two words and more whose pairs may be frequent, aggregates them in the task with pointers to an occurrence each, compares every
occurrence with that one in the text, and materialises the phrases behind the pointers; their counts add up by text. A phrase has only parts that are as
frequent, so all that a score needs is among the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import ready, shared, written
from ravelin.llm.fingerprints import Fingerprints, ended, gathered, grouped, mixed
from ravelin.llm.packing import slices

#: A-Z to a-z (fixed values by rule), bytes that end a piece, bytes that part words.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
BREAKS = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
APART = BREAKS | np.isin(np.arange(256), [32, 9])


class Words:
    """The words of a slice: a buffer in which each is followed by one space, where they begin and end, their piece and their text."""

    def __init__(self, texts: pa.Array):
        raw, places = ended(texts, "\n")
        apart = APART[raw]
        last = np.zeros(len(raw), bool)  # the byte after each word
        last[1:] = apart[1:] & ~apart[:-1]
        keep = ~apart | last
        at = np.flatnonzero(last)
        self.buffer = LOWER[raw[keep]]
        self.end = np.flatnonzero(apart[keep])
        self.buffer[self.end] = 32
        self.start = np.append(0, self.end[:-1] + 1)[: len(self.end)]
        # A break anywhere between two words parts their pieces; a text ends with one.
        breaks = np.flatnonzero(BREAKS[raw])
        self.piece = np.searchsorted(breaks, at)
        self.text = np.searchsorted(places[1:], at, side="right")

    def __len__(self) -> int:
        return len(self.start)


class Reader:
    """Fingerprints of words and phrases, told apart by language, and languages numbered as they are met."""

    def __init__(self):
        self.prints, self.seeds = Fingerprints(), {}

    def seed(self, lang: str) -> int:
        if lang not in self.seeds:
            raw = np.frombuffer(lang.encode(), np.uint8)
            self.seeds[lang] = int(mixed(self.prints.of(self.prints.prefix(raw), np.zeros(1, np.int64), np.full(1, len(raw))))[0])
        return self.seeds[lang]

    def __call__(self, langs: list[str], texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words, each one's language seed, and prefix polynomials of the buffer."""
        words = Words(texts)
        seeds = np.fromiter(map(self.seed, langs), np.uint64, len(langs))
        return words, seeds[words.text], self.prints.prefix(words.buffer)

    def keys(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return mixed(self.prints.of(prefix, start, end) ^ seed)


def reader() -> Reader:
    return shared("phrases", 0, Reader)


def texts_of(words: Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Ranges of the buffer as an Arrow column."""
    size = end - start
    data = gathered(words.buffer, start, size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(data)]).cast(pa.string())


def distinct(words: Words, langs: list[str], start: np.ndarray, end: np.ndarray, key: np.ndarray, seed: np.ndarray, text: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """A row for each distinct phrase of some ranges: lang, phrase, count, and the id of a text that holds it."""
    first, _, n = grouped(words.buffer, start, end, key, seed)
    own = text[first]
    return pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(own)), texts_of(words, start[first], end[first]), pa.array(n, pa.int64()), ids.take(pa.array(own))], names=["lang", "phrase", "f", "doc_id"])


def pieces_of(docs: DataFrame, id_column: str, lang_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, f): the occurrences of each word in each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            for ids, langs, texts in slices(batch, 4000, 1_500_000):
                langs = langs.to_pylist()
                w, seed, prefix = read(langs, texts)
                if len(w):
                    yield distinct(w, langs, w.start, w.end, read.keys(prefix, w.start, w.end, seed), seed, w.text, ids).select(["lang", "phrase", "f"])

    return rows.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Filter:
    """A set of keys as bits: it holds all that were put in, and some others where it is full. Its size has a fixed bound."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - int(np.log2(len(bits) * 8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


SEGMENT = 1 << 16


def filter_of(keys: DataFrame, n: int, most_bits: int) -> Filter:
    """The filter of a table of blocks of keys (binary, 64 bits each): eight bits a key and more, up to ``most_bits``, which is what the driver gathers."""
    bits = 1 << max(19, min(int(np.ceil(np.log2(max(n, 1) * 16))), int(np.log2(most_bits))))
    shift = np.uint64(64 - int(np.log2(bits)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in batch.column(0).to_pylist():
                at = np.unique(np.frombuffer(block, np.uint64) >> shift).astype(np.int64)
                for s in np.unique(at // (8 * SEGMENT)):
                    own = at[at // (8 * SEGMENT) == s] % (8 * SEGMENT)
                    into = held.setdefault(int(s), np.zeros(SEGMENT, np.uint8))
                    np.bitwise_or.at(into, own >> 3, (1 << (own & 7)).astype(np.uint8))
        for s, b in held.items():
            yield pa.RecordBatch.from_pylist([{"segment": s, "salt": 0, "bits": b.tobytes()}], schema=pa.schema([("segment", pa.int32()), ("salt", pa.int32()), ("bits", pa.binary())]))

    def both(t: pa.Table) -> pa.Table:
        return t.slice(0, 1).set_column(t.column_names.index("bits"), "bits", pa.array([np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in t["bits"].to_pylist()]).tobytes()], pa.binary()))

    parts = keys.mapInArrow(put, "segment int, salt int, bits binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = parts.groupBy("segment", "salt").applyInArrow(lambda t: both(t), "segment int, salt int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in once.groupBy("segment").applyInArrow(lambda t: both(t), "segment int, salt int, bits binary").toLocalIterator():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.bits, np.uint8)
    return Filter(out)


def word_keys(words: DataFrame) -> DataFrame:
    """Keys of (lang, phrase) rows, in blocks."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            if batch.num_rows:
                buffer, places = ended(batch.column(1), "")
                seed = np.fromiter(map(read.seed, batch.column(0).to_pylist()), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([read.keys(read.prints.prefix(buffer), places[:-1], places[1:], seed).tobytes()], pa.binary())], names=["keys"])

    return words.select("lang", "phrase").mapInArrow(key, "keys binary")


def likely_pairs(rows: DataFrame, frequent: Filter, least: int, buckets: int, held: int = 1_000_000) -> DataFrame:
    """(keys): blocks of keys of neighbouring frequent words that may occur ``least`` times; none that does is missing.

    A task adds up ``held`` pairs, then sends each bucket's keys (the 32 bits after the bucket's) and counts as two arrays.
    """
    spark = rows.sparkSession
    sent, width = spark.sparkContext.broadcast(frequent), int(np.log2(buckets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, waiting, n = reader(), [], 0

        def sums() -> pa.RecordBatch:
            key = np.sort(np.concatenate(waiting))
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, times = key[head], np.minimum(np.diff(np.append(head, len(key))), 255).astype(np.uint8)
            bucket = (key >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(key), np.int64)
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(key))
            low = (key >> np.uint64(32 - width)).astype(np.uint32)
            cut = list(zip(edge[:-1], edge[1:]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int64()), pa.array([low[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([times[a:b].tobytes() for a, b in cut], pa.binary())], names=["bucket", "low", "times"])

        for batch in batches:
            for _, langs, texts in slices(batch, 4000, 1_500_000):
                w, seed, prefix = read(langs.to_pylist(), texts)
                if len(w) > 1:
                    known = sent.value.has(read.keys(prefix, w.start, w.end, seed))
                    both = np.flatnonzero(known[:-1] & known[1:] & (w.piece[:-1] == w.piece[1:]))
                    waiting.append(read.keys(prefix, w.start[both], w.end[both + 1], seed[both]))
                    n += len(both)
                    if n >= held:
                        yield sums()
                        waiting, n = [], 0
        if n:
            yield sums()

    def often(t: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(b, np.uint32) for b in t["low"].to_pylist()])
        times = np.concatenate([np.frombuffer(b, np.uint8) for b in t["times"].to_pylist()])
        order = np.argsort(low)
        low = low[order]
        head = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        many = low[head][np.add.reduceat(times[order].astype(np.int64), head) >= min(least, 255)].astype(np.uint64)
        top = np.uint64(t["bucket"][0].as_py() << (64 - width)) if width else np.uint64(0)
        return pa.table({"keys": pa.array([(top | many << np.uint64(32 - width)).tobytes()], pa.binary()), "n": pa.array([len(many)])})

    return rows.mapInArrow(count, "bucket long, low binary, times binary").groupBy("bucket").applyInArrow(often, "keys binary, n long")


def phrase_counts(rows: DataFrame, pairs: Filter, longest: int) -> DataFrame:
    """(lang, phrase, f, doc_id) of all phrases of 2 to ``longest`` words whose pairs are in the filter; doc_id is that of a text that holds it."""
    sent = rows.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            for ids, langs, texts in slices(batch, 4000, 1_500_000):
                langs = langs.to_pylist()
                w, seed, prefix = read(langs, texts)
                if len(w) < 2:
                    continue
                good = np.zeros(len(w), bool)  # the pair that begins here may be frequent
                same = np.flatnonzero(w.piece[:-1] == w.piece[1:])
                key = read.keys(prefix, w.start[same], w.end[same + 1], seed[same])
                ok = sent.value.has(key)
                same, key = same[ok], key[ok]
                good[same] = True
                for n in range(2, longest + 1):
                    if n > 2:
                        same = same[same + n - 2 < len(w)]
                        same = same[good[same + n - 2]]
                        key = read.keys(prefix, w.start[same], w.end[same + n - 1], seed[same])
                    if len(same):
                        yield distinct(w, langs, w.start[same], w.end[same + n - 1], key, seed[same], w.text[same], ids)

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(count, f"lang string, phrase string, f long, doc_id {kind}")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("doc_id").alias("doc_id"))


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, most_bits: int = 1 << 28, per_bucket: int = 4_000_000, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Words (lang, phrase, f) and frequent phrases of 2 to ``longest`` words with an occurrence (lang, phrase, f, doc_id), both written."""
    rows = pieces_of(docs, id_column, lang_column, text_column)
    ready(docs.sparkSession)
    words = written(word_counts(rows))
    size = words.agg(F.sum("f").alias("n"), F.count_if(F.col("f") >= least).alias("many")).first()
    known = filter_of(word_keys(words.where(F.col("f") >= least)), size.many, most_bits)
    buckets = 1 << int(np.ceil(np.log2(max((size.n or 0) / per_bucket, 1))))
    likely = written(likely_pairs(rows, known, least, buckets))
    pairs = filter_of(likely.select("keys"), likely.agg(F.sum("n").alias("n")).first().n or 0, most_bits)
    phrases = phrase_counts(rows, pairs, longest).where(F.col("f") >= least)
    return words, written(phrases)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, inside: int = 80, most_bits: int = 1 << 28, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text", salts: int = 32) -> DataFrame:
    """Each language's ``first`` phrases by score: lang, rank, phrase, a, l, r, n, score, doc_id.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and those into words at spaces and tabs. A phrase of 2 to ``longest`` words with
    a >= ``least`` occurrences is a candidate; of its cuts into a first part (l occurrences) and a rest (r) the one of least floor(2000000 a / (l + r)) counts, the
    earliest among equals; candidates inside a longer one with ``inside`` percent of their occurrences or more are left out. Order: score, a, then the phrase's bytes.
    doc_id is that of a text that holds the phrase, a small one. Null texts are empty, a null language is ``und``;
    empty texts and tables give no rows; repeated rows count each; very long texts are read whole, one at a time. Nothing grows with the input in one task: what is
    sent are filters of up to ``most_bits`` bits, and beyond those only more phrases are counted.
    """
    words, phrases = frequent_phrases(docs, least, longest, most_bits, id_column=id_column, lang_column=lang_column, text_column=text_column)
    counts = words.where(F.col("f") >= least).unionByName(phrases.select("lang", "phrase", "f"))
    # Each cut of a candidate meets the counts of both parts, which are unique.
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size(w)).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(CAST(2000000 * CAST(a AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) DIV CAST(CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # The parts of a phrase that are phrases themselves, with its count.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda a: F.array_join(F.slice(w, a, n), " "))))
    longer = phrases.where(F.size(w) > 2).select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("top"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("top").isNull() | (100 * F.col("top").cast("decimal(20,0)") < inside * F.col("a").cast("decimal(20,0)")))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # A language may hold most candidates: the first of each salt, then the first of those.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first).drop("salt")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))  # a row for each language
    out = best.join(total, "lang").join(phrases.select("lang", "phrase", "doc_id"), ["lang", "phrase"])
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "doc_id")
