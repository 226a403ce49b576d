"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Features are taken from the line and its neighbours; labels of whole documents stand for all of
their lines in training. Forward-backward marginals, weighted by line length, give the document's share of good text, and a
logistic curve fitted on the same training documents turns that share into a probability.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import crc_bucket, ready, shared, written
from ravelin.llm.packing import slices

#: Kinds of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 bar, 6 other ASCII sign, 7 beyond ASCII.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 6
KIND[97:123], KIND[65:91], KIND[48:58], KIND[[9, 10, 11, 12, 13, 32]], KIND[124], KIND[128:] = 1, 2, 3, 4, 5, 7
SIGNS = re.compile(r"[^\w\s]{2,}")
N_OWN = 18


def line_features(line: str, before: set[str]) -> tuple[float, ...]:
    """Shape of one line; ``before`` holds the document's earlier lines."""
    data = line.encode()
    if not data.strip():
        return (0.0,) * (N_OWN - 1) + (1.0,)
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=8).tolist()
    n, words = len(data), line.split()
    w = max(1, len(words))
    letters = max(1, kinds[1] + kinds[2] + kinds[7])
    three = max(1, w - 2)
    return (
        np.log1p(n) / 5, np.log1p(w) / 4, kinds[2] / letters, kinds[3] / n, (kinds[5] + kinds[6]) / n, kinds[5] / w, kinds[7] / n, kinds[0] / n,
        sum(map(eq, words, words[1:])) / w, 1 - len(set(words)) / w, 1 - len(set(zip(words, words[1:], words[2:]))) / three if w > 2 else 0.0,
        min(3.0, len(line) / w / 8), min(1.0, len(SIGNS.findall(line)) / w), float(line.rstrip()[-1:] in ".!?:;\"'"), float(line[:1].isupper()), float(line in before), float(w < 4), 0.0,
    )


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One row of own features for each line, and the lines' weights."""
    lines, seen = text.split("\n"), set()
    own, size = np.empty((len(lines), N_OWN), np.float32), np.empty(len(lines))
    for k, line in enumerate(lines):
        own[k], size[k] = line_features(line, seen), len(line) + 1
        seen.add(line)
    return own, size


def with_neighbours(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the lines ``at``: own, previous and next line's features, first, last, 1."""
    x = np.zeros((len(at), 3 * N_OWN + 3), np.float32)
    first, last = at == 0, at == len(own) - 1
    x[:, :N_OWN] = own[at]
    x[~first, N_OWN : 2 * N_OWN] = own[at[~first] - 1]
    x[~last, 2 * N_OWN : 3 * N_OWN] = own[at[~last] + 1]
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return x


def features(text: str, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and weights of a text's lines; of a text of more than ``most`` lines, of evenly spaced ones."""
    own, size = own_features(text)
    at = np.arange(0, len(own), -(-len(own) // most) if most else 1)
    return with_neighbours(own, at), size[at]


def messages(own: np.ndarray, sizes: np.ndarray, turn: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Forward log sums of chains laid end to end, whose first lines also take ``before``; all step together, longest first."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    a = np.empty_like(own)
    a[first] = own[first] + before[order]
    for t, m in enumerate(running(sizes[order])[1:], 1):
        at = first[:m] + t
        a[at] = own[at] + np.logaddexp(a[at - 1, :1] + turn[0], a[at - 1, 1:] + turn[1])
    return a


def running(sizes: np.ndarray) -> np.ndarray:
    """How many of the chains, longest first, have a line t."""
    return np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")


def marginals(score: np.ndarray, sizes: np.ndarray, turn: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many chains laid end to end: P(good) of each line, log Z of each chain, and expected transitions of each (2 x 2).

    ``score`` is the log-odds that a line's own features give for good. Chains are cut into blocks of ``block`` lines, which all step
    together; what enters a block follows from the 2 x 2 sums over each block's paths, so a chain of a million lines takes some thousand steps.
    """
    own = np.stack([np.zeros(len(score)), score], 1)
    parts = -(-sizes // block)
    chain = np.repeat(np.arange(len(sizes)), parts)
    top = np.cumsum(parts) - parts  # first block of each chain
    size = np.full(len(chain), block)
    size[top + parts - 1] = sizes - (parts - 1) * block
    first, last = np.cumsum(size) - size, np.cumsum(size) - 1
    before, after = np.zeros((2, len(chain), 2))
    cut = np.flatnonzero(parts > 1)
    if len(cut):
        whole = np.stack([messages(own, size, turn, np.broadcast_to(turn[i], (len(size), 2)))[last] for i in (0, 1)], 1)  # sums over a block's paths by the states before and at its end
        start = messages(own, size, turn, before)[last]
        for c in cut:
            lo, hi = top[c], top[c] + parts[c]
            end = start[lo]
            for k in range(lo + 1, hi):
                before[k] = np.logaddexp(end[0] + turn[0], end[1] + turn[1])
                end = np.logaddexp(end[0] + whole[k, 0], end[1] + whole[k, 1])
            for k in range(hi - 1, lo, -1):
                after[k - 1] = np.logaddexp(whole[k, :, 0] + after[k, 0], whole[k, :, 1] + after[k, 1])
    a = messages(own, size, turn, before)
    log_z = np.logaddexp(*a[last[top + parts - 1]].T)
    b = np.empty_like(a)
    b[last] = after
    steps = np.zeros((len(chain), 2, 2))
    order = np.argsort(-size, kind="stable")
    live = running(size[order])
    for t in range(len(live) - 2, -1, -1):
        now = order[: live[t + 1]]
        at = first[now] + t
        onward = (own[at + 1] + b[at + 1])[:, None, :] + turn
        b[at] = np.logaddexp(onward[:, :, 0], onward[:, :, 1])
        steps[now] += np.exp(a[at][:, :, None] + onward - log_z[chain[now], None, None])
    inner = np.flatnonzero(np.diff(chain) == 0) + 1  # blocks that go on from the one before
    at = first[inner]
    steps[inner] += np.exp(a[at - 1][:, :, None] + (own[at] + b[at])[:, None, :] + turn - log_z[chain[inner], None, None])
    return np.exp(a[:, 1] + b[:, 1] - np.repeat(log_z, sizes)), log_z, np.add.reduceat(steps, top)


class Crf:
    def __init__(self, weights: np.ndarray, turn: np.ndarray, mean: np.ndarray, scale: np.ndarray, curve: tuple[float, float]):
        self.weights, self.turn, self.mean, self.scale, self.curve = weights, turn, mean, scale, curve

    def line_scores(self, own: np.ndarray, block: int = 8_192) -> np.ndarray:
        """Log-odds of a text's lines, a block of rows at a time."""
        parts = (with_neighbours(own, np.arange(lo, min(lo + block, len(own)))) for lo in range(0, len(own), block))
        return np.concatenate([((x - self.mean) / self.scale) @ self.weights for x in parts])

    def good_share(self, score: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        good, _, _ = marginals(score, lines, self.turn)
        first = np.cumsum(lines) - lines
        return np.add.reduceat(good * size, first) / np.add.reduceat(size, first)

    def probability(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * odds(share) + self.curve[1])))


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def descend(start: np.ndarray, slope, steps: int, rate: float) -> np.ndarray:
    """Adam on a smooth function."""
    v, m, s = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = slope(v)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return v


def fit(x: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray, steps: int = 250, decay: float = 1e-4) -> Crf:
    """Maximum conditional likelihood of chains whose lines all carry their document's label; each document counts as one line."""
    z, d = x.astype(np.float64), x.shape[1]
    mean, scale = z.mean(0), np.maximum(x.std(0, dtype=np.float64), 1e-3)
    mean[-1], scale[-1] = 0, 1
    z -= mean
    z /= scale
    weight = (1 / lines) / len(lines)
    of_line, y = np.repeat(weight, lines), np.repeat(label, lines)

    def slope(v: np.ndarray) -> np.ndarray:
        turn = np.array([[0.0, v[d]], [v[d + 1], v[d + 2]]])
        good, _, steps_ = marginals(z @ v[:d], lines, turn)
        g = (good - y) * of_line @ z
        expected = (steps_ * weight[:, None, None]).sum(0)
        seen = ((lines - 1) * weight * (label == 1)).sum()
        return np.concatenate([g, [expected[0, 1], expected[1, 0], expected[1, 1] - seen]]) + decay * v

    v = descend(np.zeros(d + 3), slope, steps, 0.05)
    crf = Crf(v[:d], np.array([[0.0, v[d]], [v[d + 1], v[d + 2]]]), mean, scale, (1.0, 0.0))
    o = odds(crf.good_share(z @ crf.weights, size, lines))
    logistic = lambda c: np.array([((p := 1 / (1 + np.exp(-(c[0] * o + c[1])))) - label) @ o, (p - label).sum()]) / len(o)
    c = descend(np.array([1.0, 0.0]), logistic, 1500, 0.02)
    crf.curve = (float(c[0]), float(c[1]))
    return crf


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 6_000, lines: int = 2_000, total: int = 400_000) -> Crf | float:
    """A model from at most ``sample`` labelled documents (the ones of least id hash) outside the held-out fold; a constant if they are all alike.

    Of an id's texts the least counts. A longer document than ``lines`` lines lends evenly spaced ones, with their neighbours'
    features; where the documents have more than ``total`` lines together, each lends as many at most as keeps them below it. So the driver gathers ``total`` rows of 57
    floats at most (91 MB), one line of each document in any case.
    """
    mine = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(crc_bucket("doc_id", folds) != 0)
    mine = mine.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = written(rows.select("doc_id", "quality", "text", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")))
    counts = rows.groupBy(F.least("n", F.lit(lines)).alias("n")).count().toPandas()  # ``lines`` rows at most
    most = room(counts["n"].to_numpy(), counts["count"].to_numpy(), lines, total)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            for i, q, text in zip(*(c.to_pylist() for c in part)):
                x, size = features(text, most)
                yield pa.RecordBatch.from_pydict({"doc_id": [str(i)], "quality": pa.array([q], pa.int32()), "x": [x.tobytes()], "size": [size.tobytes()]})

    got = rows.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(look, "doc_id string, quality int, x binary, size binary").toPandas().sort_values("doc_id")
    if got.quality.nunique() < 2:
        return float(got.quality.iloc[0]) if len(got) else 0.5
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, 3 * N_OWN + 3) for b in got.pop("x")])
    sizes = [np.frombuffer(b, np.float64) for b in got["size"]]
    return fit(x, np.concatenate(sizes), np.array([len(s) for s in sizes]), got.quality.to_numpy(np.float64))


def room(n: np.ndarray, count: np.ndarray, lines: int, total: int) -> int:
    """The most lines a document, up to ``lines``, with which ``count`` documents of ``n`` lines each have ``total`` together; 1 at least."""
    low, high = 1, lines
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if int((np.minimum(n, mid) * count).sum()) <= total else (low, mid - 1)
    return low


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, cut_at: float = 0.3, sample: int = 6_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Only the text decides a score. Held out are the ids whose crc32 in decimal is divisible by ``folds``; their labels are
    never seen. Null texts count as empty, which is one empty line; repeated rows and equal texts give equal results; a null id is not held out; an empty table
    gives no rows; of very long texts every line is read, in blocks, a few MB of text at a time; a score equal to ``cut_at`` is predicted 1; without labels of both kinds every score is the one label's value (0.5 without any). Columns named in ``carry`` come along; others are
    left out.
    """
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(train(docs, labels, folds, sample))
    kind, made = docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared("crf", made, lambda: held.value)
        for b in batches:
            for part in slices(b):
                if isinstance(crf, float):
                    p = np.full(len(part[0]), crf)
                else:
                    found = [own_features(t or "") for t in part[-1].to_pylist()]
                    scores = np.concatenate([crf.line_scores(own) for own, _ in found])
                    p = crf.probability(crf.good_share(scores, np.concatenate([size for _, size in found]), np.array([len(own) for own, _ in found])))
                yield pa.RecordBatch.from_arrays([part[0], pa.array(p), *part[1:-1]], names=["doc_id", "score", *carried])

    carried = [f"carried_{k}" for k in range(len(carry))]
    more = "".join(f", {c} {docs.schema[n].dataType.simpleString()}" for c, n in zip(carried, carry))
    out = docs.select("doc_id", *(F.col(n).alias(c) for c, n in zip(carried, carry)), F.col("text").alias("whole_text")).mapInArrow(run, f"doc_id {kind}, score double{more}")
    return out.select("doc_id", F.coalesce(crc_bucket("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"), *(F.col(c).alias(n) for c, n in zip(carried, carry)))
