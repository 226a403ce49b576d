"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Equal fingerprints are one point. A node of a tree has a vantage point, one of its own points, and a branch for each distance to it, so
a branch has a vantage point of its own again. A pair within the radius differs by no more than the radius in its distances (the
triangle bound), and all its differences are odd or even together, as each differing bit changes every distance by one. The upper
levels deal the points into shards; a point is stored in its own and asks in the others that these bounds leave open. Inside a shard
the tree goes on until blocks are small enough to compare.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import Memo, by_row, cut, ready, shared, written
from ravelin.llm.components import Forest, components

#: Bits of each byte value, least first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
U = np.uint64


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all shingles; signed, as Spark's long."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not parts:
        return 0
    k, line, digest = min(words, len(parts)), b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist())
    return int(majority(np.fromiter((digest(line[s:e], seed) for s, e in spans), np.uint64, n)).view(np.int64)[0])


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that are set in over half the hashes, as one number."""
    b = h.astype("<u8").view(np.uint8).reshape(len(h), 8)
    ones = np.concatenate([np.bincount(b[:, k], minlength=256) @ BITS for k in range(8)])
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp of every whole text; null and empty texts have fingerprint 0."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return by_row(rows, ["doc_id", "text"], f"doc_id {kind}, fp long", lambda: lambda r: [(r[0], fingerprint(r[1] or "", words, seed))])


def shards(points: DataFrame, levels: int, radius: int, sent: int = 200_000) -> DataFrame:
    """The rows of ``points`` (tree, fp, ...) once in each shard that they ask in, with node and own (whether they live there).

    Each level takes the vantage points of all nodes so far, the least hash of each node's own points, and goes one branch
    down; a row follows its own branch and those that an even or an odd number of differing bits, up to the radius, leave open.
    """
    # turn: 0 for the own branch alone, 2 for pairs that differ in an even number of bits, 1 for an odd number
    turns = sorted({0, *(k % 2 or 2 for k in range(1, radius + 1))}) if levels else [0]
    at = points.withColumn("turn", F.explode(F.array(*map(F.lit, turns)))).withColumns({"node": F.xxhash64("tree"), "moved": F.col("turn") != 2})
    names = points.columns
    ranges = {0: [0], 1: [s * k for k in range(1, radius + 1, 2) for s in (-1, 1)], 2: [0, *(s * k for k in range(2, radius + 1, 2) for s in (-1, 1))]}
    moves = F.when(F.col("turn") == 0, F.array(F.lit(0)))
    for k in turns[1:]:
        moves = moves.when(F.col("turn") == k, F.array(*map(F.lit, ranges[k])))
    for _ in range(levels):
        vantage = cut(at.where("turn = 0").groupBy("node").agg(F.min_by("fp", F.xxhash64("fp", "node")).alias("vantage")))
        met = at.join(F.broadcast(vantage) if vantage.count() <= sent else vantage, "node")  # no node, no points there
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        at = met.withColumn("move", F.explode(moves)).select(*names, "turn", F.xxhash64("node", far + F.col("move")).alias("node"), (F.col("moved") | (F.col("move") != 0)).alias("moved"))
    return at.where("moved").select(*names, "node", (F.col("turn") == 0).alias("own"))


def pairs_in(fps: np.ndarray, own: np.ndarray, radius: int, found: Callable[[np.ndarray, np.ndarray], None], most: int = 2_000_000) -> None:
    """Calls ``found`` with arrays (i, j) of all rows j within the radius of rows i of ``own``; a tree in memory until ``most`` pairs are left."""
    todo = [(own, np.arange(len(fps)))]
    while todo:
        a, b = todo.pop()
        if len(a) * len(b) > most:
            vantage = fps[a[len(a) // 2]]
            da, db = np.bitwise_count(fps[a] ^ vantage).astype(np.int64), np.bitwise_count(fps[b] ^ vantage).astype(np.int64)
            order, order_b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
            da, a, db, b = da[order], a[order], db[order_b], b[order_b]
            branches = np.unique(da)
            edges = np.searchsorted(da, branches), np.searchsorted(da, branches, side="right"), np.searchsorted(db, branches - radius), np.searchsorted(db, branches + radius, side="right")
            work = sum((e - s) * (f - t) for s, e, t, f in zip(*edges))
            if work <= 0.9 * len(a) * len(b):
                todo += [(a[s:e], b[t:f]) for s, e, t, f in zip(*edges) if f > t]
                continue
        step = max(1, most // max(1, len(b)))
        for s in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(fps[a[s : s + step], None] ^ fps[b][None]) <= radius)
            found(a[s : s + step][i], b[j])


def levels_for(points: DataFrame, shard: int, least: int) -> int:
    """Levels after which the largest tree's shards hold some ``shard`` points: a level leaves a node one in eight."""
    n = points.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    return max(least, math.ceil(math.log(max(n, 1) / shard) / math.log(8)))


def divided(visits: DataFrame, block: int, key: list[str], sent: int = 200_000) -> DataFrame:
    """The rows of shards in cells (node, h, q): a block of a shard's points with a block of those that ask there. Small shards are one cell."""
    sizes = visits.groupBy("node").agg(F.count("*").alias("v"), F.count_if("own").alias("o")).where("o > 0 and v > 1")
    sizes = cut(sizes.select("node", F.ceil(F.col("o") / block).cast("int").alias("nh"), F.ceil(F.col("v") / (4 * block)).cast("int").alias("nq")))
    spread = visits.join(F.broadcast(sizes) if sizes.count() <= sent else sizes, "node")
    mine = lambda n, s: F.pmod(F.xxhash64(*key, F.lit(s)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asks = F.transform(every("nh"), lambda h: F.struct(F.lit(False).alias("own"), h.alias("h"), mine("nq", 1).alias("q")))
    owns = F.transform(every("nq"), lambda q: F.struct(F.lit(True).alias("own"), mine("nh", 2).alias("h"), q.alias("q")))
    # What lives in a shard asks there too.
    return spread.withColumn("c", F.explode(F.when(~F.col("own"), asks).when(F.col("nh") > 1, F.concat(owns, asks)).otherwise(owns))).select(*visits.drop("own").columns, "c.*")


def close_pairs(points: DataFrame, radius: int, shard: int = 65_536) -> DataFrame:
    """Edges (a, b) that connect the same points as all pairs of distinct ``fp`` within ``radius`` do.

    Each task compares one block of a shard's points with one block of those that ask there and returns a spanning forest of the pairs
    it finds: no more rows than points.
    """
    ready(points.sparkSession)
    trees = points.select(F.lit(0).alias("tree"), "fp")
    cells = divided(shards(trees, levels_for(trees, shard, 1), radius), shard, ["fp"])

    def compare(cell: pa.Table) -> pa.Table:
        fp, own = cell["fp"].to_numpy().view(U), cell["own"].to_numpy()
        every, own = np.unique(fp), np.unique(fp[own])
        forest = Forest(len(every))
        pairs_in(every, np.searchsorted(every, own), radius, lambda i, j: forest.join(i[i != j], j[i != j]))
        other = np.flatnonzero(forest.label != np.arange(len(every)))
        return pa.table({"a": every[other].view(np.int64), "b": every[forest.label[other]].view(np.int64)})

    return cells.select("fp", "node", "own", "h", "q").groupBy("node", "h", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) of every row.

    Fingerprints of at most ``radius`` differing bits are linked, equal ones too. Null and empty texts have fingerprint zero
    and link like any other; repeated rows give repeated results; a null id is carried through and never names a component that
    holds another id; texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    prints = cut(fingerprints(docs, words, seed, id_column, text_column))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(close_pairs(points, radius))
    roots = points.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = cut(roots)
    names = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(names, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 16_384) -> np.ndarray:
    """How many members sets i and j share, pair by pair; few pairs by merging them, many by bit columns of ``width`` members at a time."""
    if len(i) < 2 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row, member = row[times[member] > 1], column[member[times[member] > 1]]
    order = np.argsort(member, kind="stable")
    row, member = row[order], member[order]
    same = np.zeros(len(i), np.int64)
    for lo in range(0, int(column[-1]) + 1, width):
        s, e = np.searchsorted(member, [lo, lo + width])
        on = np.zeros((len(sets), width), bool)
        on[row[s:e], member[s:e] - lo] = True
        bits = np.packbits(on, axis=1).view(U)
        for k in range(0, len(i), 8192):
            same[k : k + 8192] += np.bitwise_count(bits[i[k : k + 8192]] & bits[j[k : k + 8192]]).sum(axis=1, dtype=np.int64)
    return same


class Shingles:
    """Hashed sets of texts' shingles, and majority bits over them."""

    BUCKETS = 4096

    def __init__(self, words: int, bits: int = 0, seed: int = 42):
        import xxhash

        rng = np.random.default_rng(seed)
        self.mix = rng.integers(0, 1 << 63, words, dtype=U) << U(1) | U(1)
        self.hashes = Memo(200_000, lambda w: xxhash.xxh64_intdigest(w, seed))
        self.signs = rng.integers(0, 2, (self.BUCKETS, bits), dtype=np.int8).astype(np.float32) * 2 - 1

    def set_of(self, text: str) -> np.ndarray:
        """Sorted hashes of the different shingles."""
        parts = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
        self.hashes.room()
        h = np.fromiter(map(self.hashes.__getitem__, parts), U, len(parts))
        k = min(len(self.mix), len(h))
        if not k:
            return h
        out = np.full(len(h) - k + 1, k, U)
        for d in range(k):
            out = (out + h[d : len(out) + d]) * self.mix[d]
            out ^= out >> U(29)
        return np.unique(out)

    def bits_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sets x bits: whether a set's shingles, of random signs and buckets, weigh more on one side; as random hyperplanes would tell."""
        all_, n = np.concatenate(sets), len(sets)
        at = np.repeat(np.arange(n), [len(s) for s in sets]) * self.BUCKETS + (all_ >> U(40)).astype(np.int64) % self.BUCKETS
        v = np.bincount(at, weights=np.where(all_ & U(1), 1.0, -1.0), minlength=n * self.BUCKETS).astype(np.float32)
        return v.reshape(n, self.BUCKETS) @ self.signs > 0


def chances(bits: int, radius: int, differ: float) -> float:
    """The chance that no more than ``radius`` of ``bits`` bits differ, each by the chance ``differ``."""
    return sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(radius + 1))


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 1, missed: float = 0.005, block: int = 500, shard: int = 400_000, joined: int = 200_000) -> DataFrame:
    """doc_id, key (xxhash64 of the text), root (its group), component_id (smallest doc_id that links reach) of every row of ``docs`` (doc_id, text).

    Texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more are linked; a shorter text is one
    shingle. Null and empty texts link with each other alone; a null id never names a component that holds another id; repeated
    rows give repeated results; an empty table gives no rows; other columns are left out.

    One fingerprint cannot tell: of 64 bits some ten differ at 0.8, and within so wide a radius a tree leaves nearly every branch
    open. So there are many vantage-point trees, each over short fingerprints of its own within a narrow ``radius``: bits grow with the
    logarithm of the number of texts, and trees are as many as bring a pair just at ``similarity`` together but for a chance of ``missed``.
    Pairs that a tree finds meet 128 further bits, of which more would differ than are let pass once in 10 million such pairs, then the
    whole sets. First each point meets one of those found for it in each tree, so that large groups join; then all pairs of different groups
    are verified. Pairs are verified in cells: blocks of some ``block`` points alike (or of 250 times as many shingles) with each other, so a
    set moves once for each block that its point has a pair in, not once for each pair. A cell compares all that it holds, a superset of the pairs found.
    Up to ``joined`` edges are joined in one task, more in tasks of as many and then in rounds.
    """
    import xxhash

    spark = ready(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    about = docs.count()
    bits = min(31, math.ceil(math.log2(max(about, 2))) + 4)
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    trees = math.ceil(math.log(missed) / math.log(1 - chances(bits, radius, differ)))
    most = next(k for k in range(129) if chances(128, k, differ) > 1 - 1e-7)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shared("shingles", (words, bits, trees), lambda: Shingles(words, 128 + trees * bits))
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets = [shingles.set_of(t or "") for t in part.column(2).to_pylist()]
                points = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                on = shingles.bits_of(sets)
                w = np.packbits(on[:, :128], axis=1).view(np.int64)
                fps = on[:, 128:].reshape(len(sets), trees, bits) @ (1 << np.arange(bits))
                fps = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, trees), pa.int32()), pa.array(fps.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(points, pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(w[:, 0]), pa.array(w[:, 1]), fps], names=["doc_id", "key", "point", "size", "w0", "w1", "fps"])

    prints = written(keyed.mapInArrow(look, f"doc_id {kind}, key long, point binary, size int, w0 long, w1 long, fps array<int>"))
    # Equal sets are one point, with the text of least id to verify on; numbers for points, as rows are many.
    points = prints.where("size > 0").groupBy("point").agg(F.min(F.struct("doc_id", "key")).alias("text"), *(F.first(c).alias(c) for c in ("size", "w0", "w1", "fps")))
    points = written(points.withColumn("id", F.monotonically_increasing_id()))
    narrow = points.select("id", "w0", "w1", "size", "fps")

    def brought(rows: DataFrame, all_pairs: bool) -> DataFrame:
        """What the trees bring together, of different roots, and 128 bits do not part.

        Either (a, b), each point with its least one by hash; or for all pairs (x, y, id), the points that have a pair across blocks x and y;
        a cell tells them in a row for each two blocks, as most of them are found in nearly every tree.
        """

        def compare(cell: pa.Table) -> pa.Table:
            number, own = cell["id"].to_numpy(), cell["own"].to_numpy()
            order = np.argsort(~own, kind="stable")
            _, first = np.unique(number[order], return_index=True)
            at = order[first]
            number, own, fp, w0, w1, root, size, block = (cell[c].to_numpy()[at] for c in ("id", "own", "fp", "w0", "w1", "root", "size", "block"))
            fp, w0, w1 = fp.view(np.uint32), w0.view(U), w1.view(U)
            blocks, where = np.unique(block, return_inverse=True)
            rank = np.argsort(np.argsort(number.astype(U) * U(0x9E3779B97F4A7C15) >> U(20), kind="stable"))
            least, met = np.full(len(number), len(number)), [np.zeros(0, np.int64)]

            def found(i: np.ndarray, j: np.ndarray) -> None:
                i, j = alike(i, j, root, size, w0, w1)
                if all_pairs:
                    met.append(np.unique(np.concatenate([i * len(blocks) + where[j], j * len(blocks) + where[i]])))
                else:
                    np.minimum.at(least, i, rank[j])
                    np.minimum.at(least, j, rank[i])

            pairs_in(fp, np.flatnonzero(own), radius, found, 500_000)
            if all_pairs:
                i, other = np.divmod(np.unique(np.concatenate(met)), max(1, len(blocks)))
                x, y = np.minimum(block[i], blocks[other]), np.maximum(block[i], blocks[other])
                order = np.lexsort((y, x))
                x, y, ids = x[order], y[order], number[i][order]
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(x)]
                ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), pa.array(ids))
                return pa.table({"x": x[first], "y": y[first], "ids": ids})
            i = np.flatnonzero(least < len(number))
            j = np.argsort(rank)[least[i]]
            ab = np.unique(np.stack([np.minimum(number[i], number[j]), np.maximum(number[i], number[j])], 1), axis=0)
            return pa.table({"a": ab[:, 0], "b": ab[:, 1]})

        rows = rows.select("id", "w0", "w1", "size", "root", "block", F.posexplode("fps").alias("tree", "fp"))
        cells = divided(shards(rows, levels_for(rows, shard, 0), radius), shard, ["id"])
        cells = cells.groupBy("tree", "node", "h", "q").applyInArrow(compare, "x long, y long, ids array<bigint>" if all_pairs else "a long, b long")
        return cells.groupBy("x", "y").applyInArrow(together, "x long, y long, id long") if all_pairs else cells.distinct()

    def together(cell: pa.Table) -> pa.Table:
        """Each point of two blocks once; many trees bring the same ones."""
        ids = np.unique(np.concatenate([c.flatten().to_numpy() for c in cell["ids"].chunks]))
        return pa.table({"x": np.full(len(ids), cell["x"][0].as_py()), "y": np.full(len(ids), cell["y"][0].as_py()), "id": ids})

    def alike(i: np.ndarray, j: np.ndarray, root: np.ndarray, size: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[near], j[near]
        near = np.bitwise_count(w0[i] ^ w0[j]).astype(np.int64) + np.bitwise_count(w1[i] ^ w1[j]) <= most
        return i[near], j[near]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                sets = pa.array([shingles.set_of(t or "").tobytes() for t in part.column(4).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], sets], names=["id", "size", "w0", "w1", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges that connect each cell (x, y) as all its near pairs do; rows of a cell follow each other."""
        rest = None
        for b in batches:
            rows = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
            last = int(np.flatnonzero((x == x[-1]) & (y == y[-1]))[0]) if len(x) else 0
            rest = rows.slice(last)  # its cell may go on in the next batch
            yield from near_pairs(rows.slice(0, last))
        if rest is not None:
            yield from near_pairs(rest)

    def near_pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        x, y, number, root, size, w0, w1 = (rows[c].to_numpy() for c in ("x", "y", "id", "root", "size", "w0", "w1"))
        w0, w1 = w0.view(U), w1.view(U)
        sets = [np.frombuffer(v.as_buffer(), U) for c in rows["shingles"].chunks for v in c]
        edges = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
        got = []
        for s, e in zip(edges, edges[1:]):
            i, j = alike(*(k + s for k in np.triu_indices(e - s, 1)), root, size, w0, w1)
            if not len(i):
                continue
            same = shared_counts(sets[s:e], i - s, j - s)
            near = same >= similarity * (size[i].astype(np.int64) + size[j] - same) - 1e-9
            forest = Forest(e - s)
            forest.join(i[near] - s, j[near] - s)
            other = np.flatnonzero(forest.label != np.arange(e - s))
            got.append(np.stack([number[s:e][other], number[s:e][forest.label[other]]]))
        ab = np.concatenate([np.zeros((2, 0), np.int64), *got], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])

    def in_cells(pairs: DataFrame) -> DataFrame:
        """(x, y, id): the blocks of a pair, and each of its ends."""
        ends = pairs.join(blocks.toDF("a", "p"), "a").join(blocks.toDF("b", "q"), "b")
        return ends.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), F.explode(F.array("a", "b")).alias("id")).distinct()

    def near(cells: DataFrame, roots: DataFrame | None) -> DataFrame:
        rows = rooted(cells.join(sets, "id"), roots).select("x", "y", "id", "root", "size", "w0", "w1", "shingles")
        return cut(rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(verify, "a long, b long"))

    def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("id"))
        return rows.join(roots, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")

    # Points alike meet the same one of least hash, so blocks by it hold points alike, whose sets a cell takes once for all their pairs.
    # Small ones of one component of the pairs go together: a point then has few blocks to meet.
    pairs = cut(brought(rooted(narrow, None).withColumn("block", F.lit(0).cast("long")), False))
    both = pairs.union(pairs.select("b", "a")).toDF("id", "hub")
    hubs = both.union(both.select("id", "id").distinct()).groupBy("id").agg(F.min_by("hub", F.xxhash64("hub")).alias("hub")).join(points.select("id", "size"), "id")
    hubs = cut(hubs.join(components(pairs, block=joined), "id"))
    parts = lambda by, name: hubs.groupBy(by).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / (250 * block))).cast("int").alias(name))
    chunk = F.xxhash64("hub", F.pmod(F.xxhash64("id"), "chunks"))
    blocks = hubs.join(parts("hub", "chunks"), "hub").join(parts("component", "parts"), "component")
    blocks = cut(blocks.select("id", F.xxhash64("component", F.pmod(chunk, "parts")).alias("block")))
    wanted = blocks.select("id").join(points, "id").select("id", F.col("text.doc_id").alias("doc"), "text.key", "size", "w0", "w1")
    text = keyed.join(wanted, keyed.doc_id.eqNullSafe(wanted.doc) & (keyed.key == wanted.key)).groupBy("id", "size", "w0", "w1").agg(F.min("text").alias("text"))
    sets = written(text.mapInArrow(sets_of, "id long, size int, w0 long, w1 long, shingles binary"))
    first = near(in_cells(pairs), None)
    roots = cut(components(first, block=joined))
    rows = written(rooted(narrow.join(blocks, "id"), roots))  # points that were near none have no more to look for
    second = near(brought(rows, True), roots)
    if not second.isEmpty():
        roots = cut(components(first.union(second), block=joined))
    named = points.join(roots, "id", "left").select("point", F.coalesce("component", "id").alias("id"))
    own = prints.join(named, "point", "left").select("doc_id", "key", F.coalesce("id", F.lit(-1)).alias("root"))
    names = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(names, "root").select("doc_id", "key", "root", "component_id")
