"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds every id's lowest chunk, level 1 the next chunk of those ids that have one, and so on; a
level's bitmap says which of its chunks go on, and a directory holds the number of bits set before each block of 512. So any single id is
read by one chunk and one rank a level, and no block is decoded for it. Texts lie in ascending order of their ids, cut into files between texts.

File: magic, then as 64-bit numbers ids, texts, levels and each level's chunks; then the texts' ids, a byte for each that is null, the texts' ends;
then for each level its chunks, and for all but the last the bitmap and the directory (32 bits an entry). All little-endian.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.chunk_ids import TextIds
from ravelin.llm.common import ready, shared
from ravelin.llm.packing import slices

MAGIC = b"RVDAC01\n"
BITS, BLOCK = 8, 512


def encoded(ids: np.ndarray, who: np.ndarray, absent: np.ndarray, ends: np.ndarray) -> bytes:
    """A file of texts: their ids end to end, the texts' own ids, which of those are null, and where each text ends."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        chunks = (left & 255).astype(np.uint8)
        left = left >> BITS
        goes_on = left > 0
        levels.append((chunks, goes_on))
        left = left[goes_on]
        if not len(left):
            break
    head = np.array([len(ids), len(who), len(levels), *(len(c) for c, _ in levels)], "<u8")
    out = [MAGIC, head.tobytes(), who.astype("<i8").tobytes(), absent.astype(np.uint8).tobytes(), ends.astype("<u8").tobytes()]
    for k, (chunks, goes_on) in enumerate(levels):
        out.append(chunks.tobytes())
        if k < len(levels) - 1:
            bits = np.packbits(goes_on, bitorder="little")
            bits = np.append(bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8))
            before = np.append(0, np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)))[:-1]
            out += [bits.tobytes(), before.astype("<u4").tobytes()]
    return b"".join(out)


class TokenFile:
    """One file: whole, by text, or by place. ``read(at, size)`` gives bytes, so that single ids are read from storage without the rest."""

    def __init__(self, read):
        self.read = read
        if read(0, 8) != MAGIC:
            raise ValueError("no token file")
        self.n, self.texts, self.levels = (int(v) for v in np.frombuffer(read(8, 24), "<u8"))
        sizes = [int(v) for v in np.frombuffer(read(32, 8 * self.levels), "<u8")]
        self.who_at = 32 + 8 * self.levels
        at, self.parts = self.who_at + 17 * self.texts, []
        for k, n in enumerate(sizes):
            blocks = -(-n // BLOCK) if k < self.levels - 1 else 0
            self.parts.append((n, at, at + n, at + n + blocks * (BLOCK // 8)))
            at += n + blocks * (BLOCK // 8 + 4)

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        return cls(lambda at, size: data[at : at + size])

    def directory(self) -> tuple[list[int | None], np.ndarray]:
        """The texts' ids, and where each ends."""
        n = self.texts
        raw = self.read(self.who_at, 17 * n)
        who, absent, ends = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<u8", n, 9 * n)
        return [None if a else w for w, a in zip(who.tolist(), absent)], ends.astype(np.int64)

    def all(self) -> np.ndarray:
        """All ids in their order."""
        out = np.zeros(self.n, np.uint32)
        place = None  # of the level's chunks among the ids
        for k, (n, chunks, bits, _) in enumerate(self.parts):
            values = np.frombuffer(self.read(chunks, n), np.uint8).astype(np.uint32) << np.uint32(BITS * k)
            if place is None:
                out[:] = values
            else:
                out[place] |= values
            if k < self.levels - 1:
                on = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(bits, -(-n // BLOCK) * (BLOCK // 8)), np.uint8), count=n, bitorder="little"))
                place = on.astype(np.uint32) if place is None else place[on]
        return out

    def at(self, place: int) -> int:
        """The id at one place: a byte, a block of the bitmap and an entry of the directory for each level."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        out = 0
        for k, (_, chunks, bits, before) in enumerate(self.parts):
            out |= self.read(chunks + place, 1)[0] << (BITS * k)
            if k == self.levels - 1:
                break
            block = np.frombuffer(self.read(bits + place // BLOCK * (BLOCK // 8), BLOCK // 8), np.uint8)
            own = np.unpackbits(block, bitorder="little")[: place % BLOCK + 1]
            if not own[-1]:
                break
            place = int(np.frombuffer(self.read(before + 4 * (place // BLOCK), 4), "<u4")[0]) + int(own[:-1].sum())
        return out


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    uri = re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, path: str, store: str | None = None, end_id: int = 2, per_file: int = 4_000_000, per_task: int = 64_000_000, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Encode every whole text by the byte-level BPE file at ``path``, each with ``end_id`` after it, and write token files; their folder.

    Texts are sorted by id, nulls first, and by their text where ids are equal: rows that repeat are written each. A null or empty text is its end id
    alone; very long texts are a file of their own; an empty table gives a folder without texts; other columns are left out. Tasks take some ``per_task`` bytes
    of text and write files of some ``per_file`` ids, first under another name, so a task run again or twice leaves the same files. ``store`` is a new folder that driver and executors share, or
    one in the checkpoint folder.
    """
    spark = ready(docs.sparkSession)
    store = store or f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    TextIds(spec, end_id)  # refuses files that it does not handle
    held = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 1_000_000 + 1), size // per_task + 1)
    target, folder = located(store)
    target.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, at, own = shared("text ids", (path, end_id), lambda: TextIds(held.value, end_id)), TaskContext.get().partitionId(), 0, None
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def commit() -> tuple[int, int, int]:
            nonlocal at, own, waiting
            own = own or located(store)
            who = pa.concat_arrays([w for w, _, _ in waiting])
            found, sizes = np.concatenate([f for _, f, _ in waiting]), np.concatenate([s for _, _, s in waiting])
            waiting = []
            name = f"{own[1]}/part-{part:07d}-{at:015d}.dac"
            early = f"{name}.{uuid.uuid4().hex}"
            with own[0].open_output_stream(early) as f:
                f.write(encoded(found, who.fill_null(0).to_numpy(), who.is_null().to_numpy(zero_copy_only=False), np.cumsum(sizes)))
            own[0].move(early, name)
            row = (part, at, len(found))
            at += len(found)
            return row

        held_ids = 0
        for batch in batches:
            for who, texts in slices(batch, 4000, 1_500_000):
                found, sizes = ids(texts)
                waiting.append((who, found.astype(np.uint32), sizes))
                held_ids += len(found)
                if held_ids >= per_file:
                    held_ids = 0
                    yield pa.RecordBatch.from_pylist([dict(zip(("part", "at", "n"), commit()))], schema=KINDS)
        if waiting:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "at", "n"), commit()))], schema=KINDS)

    laid = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text"), F.rand(17)).sortWithinPartitions("doc_id", "text")
    files = laid.mapInArrow(write, "part int, at long, n long")
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number for each task
    before = list(itertools.accumulate((totals[p] for p in sorted(totals)), initial=0))
    with target.open_output_stream(f"{folder}/parts.json") as f:
        f.write(json.dumps({"part": sorted(totals), "start": before}).encode())
    return store


KINDS = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64())])


def starts(store: str) -> dict[int, int]:
    """Ids before each part, and under -1 all ids."""
    own, folder = located(store)
    with own.open_input_stream(f"{folder}/parts.json") as f:
        known = json.loads(f.read())
    return dict(zip([*known["part"], -1], known["start"]))


def token_files(spark: SparkSession, store: str) -> DataFrame:
    """The store's files: path, part, at (ids before it in its part)."""
    name = F.regexp_extract("path", r"part-(\d+)-(\d+)\.dac$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(store).withColumns({"part": name.cast("int"), "at": F.regexp_extract("path", r"part-(\d+)-(\d+)\.dac$", 2).cast("long")})


def read_tokens(spark: SparkSession, store: str, with_ids: bool = True) -> DataFrame:
    """One row for each text of a store, from its files: doc_id, start (ids of all texts before), n_tokens, ids_crc32 and, if asked for, ids."""
    before = starts(store)
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if len(before) == 1:
        return spark.createDataFrame([], kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, content in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile.of(content)
                ids, (who, ends) = file.all(), file.directory()
                begin = np.append(0, ends[:-1])
                data = memoryview(ids.astype("<u4")).cast("B")
                for lo in range(0, len(who), 2000):
                    hi = min(lo + 2000, len(who))
                    crc = [zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(begin[lo:hi].tolist(), ends[lo:hi].tolist())]
                    out = [pa.array(who[lo:hi], pa.int64()), pa.array(begin[lo:hi] + (before[part] + at)), pa.array(ends[lo:hi] - begin[lo:hi]), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(np.append(begin[lo:hi], ends[hi - 1]) - begin[lo], pa.int32()), pa.array(ids[begin[lo] : ends[hi - 1]].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return token_files(spark, store).select("part", "at", "content").mapInArrow(read, kind)


def tokens_at(spark: SparkSession, store: str, wanted: DataFrame, place: str = "place", width: int = 4_000_000, salts: int = 16) -> DataFrame:
    """Ids at single places of the whole stream: (place, token), read from the files by place, without decoding them.

    Places meet files by blocks of ``width`` places, and a file's places come in up to ``salts`` groups. Places that are null or outside the stream give no row; repeated ones give one each.
    """
    before = starts(store)
    known = spark.createDataFrame([(p, s) for p, s in before.items() if p >= 0], "part int, before long")
    files = token_files(spark, store).select("path", "part", "at", "length").join(known, "part").withColumn("start", F.col("before") + F.col("at"))
    # A file ends where the next one starts; there are as many files as some millions of ids fit into the stream.
    ends = files.select("path", "start", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length")) / width))).alias("block"))  # an id takes a byte at least
    asked = wanted.select(F.col(place).cast("long").alias("place")).where("place >= 0").groupBy("place").agg(F.count("*").alias("times")).withColumn("block", F.floor(F.col("place") / width))
    met = asked.join(ends, "block").where("place >= start").groupBy("place", "times").agg(F.max(F.struct("start", "path")).alias("f")).select("place", "times", "f.start", "f.path")

    def look(table: pa.Table) -> pa.Table:
        own, path = located(re.sub("^file:/+", "/", table["path"][0].as_py()))
        with own.open_input_file(path) as f:

            def read(at: int, size: int) -> bytes:
                f.seek(at)
                return f.read(size)

            file, start = TokenFile(read), table["start"][0].as_py()
            found = [(p, n, file.at(p - start)) for p, n in zip(table["place"].to_pylist(), table["times"].to_pylist()) if p - start < file.n]
        return pa.table({k: pa.array([r[i] for r in found], t) for i, (k, t) in enumerate((("place", pa.int64()), ("times", pa.int64()), ("token", pa.int32())))})

    # A group holds different places of one file: as many as a file has ids, over the salts.
    one = met.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts))).groupBy("path", "salt").applyInArrow(look, "place long, times long, token int")
    return one.select("place", "token", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("place", "token")
