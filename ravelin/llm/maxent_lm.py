"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Words fall into 64 classes by their spelling, eight groups of eight: centroids of byte-pair vectors, fitted on the commonest words of
the training counts. The commonest words of each class have a slot of their own, the others share one. A token's probability is that of
its group, of its class in the group, of its slot in the class, and of the word in its slot. The first three are softmaxes over
hashed n-gram and skip features of the tokens before it; in a slot words share out by their counts, a softmax with one feature a word
at its optimum.

Texts are put into numbers once. Training then makes rounds over all of them: every task adds up what the model expects of each feature
under the weights so far, the sums of all tasks add up in a tree, and the weights step along the gradient of the log likelihood, scaled
as in iterative scaling. Rounds see sums over all texts, so partitions have no say in the weights beyond rounding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import crc_bucket, ready, written

END = b"\n"  # no word holds it
WIDTH = 8  # of each softmax: groups, classes of a group, slots of a class
CLASSES = WIDTH * WIDTH
LEVELS, TEMPLATES = 3, 5
NEAR = 12  # words before whose groups make a feature
PAIRS = 1 << 10  # hashed byte pairs
BATCH = 16_384
#: A token in 32 bits: 20 of its spelling's hash, 6 of its class, 3 of its slot.
SLOT, CLASS = 20, 23
U = np.uint32


def parts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of items, in order, of about ``most`` in sum."""
    edges = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most)) + 1).tolist(), len(sizes)]
    return list(zip(edges, edges[1:])) if len(sizes) else []


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is in ``among``; -1 where it is not."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False)


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, end to end, and how many each text has: A-Z lower-cased, cut at the six ASCII white-space characters."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, size = cut.flatten(), cut.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if full.all():
        return words, size
    upto = np.concatenate([[0], np.cumsum(full)])  # white space at either end leaves an empty word there
    return words.filter(pa.array(full)), np.diff(upto[np.concatenate([[0], np.cumsum(size)])])


def text_groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows with their texts' words and numbers of words, about ``most`` bytes of text at a time; the text is the last column."""
    for b in batches:
        last = b.column(b.num_columns - 1)
        for s, e in parts(pc.fill_null(pc.binary_length(last), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1, most):
            yield b.slice(s, e - s), *words_of(last.slice(s, e - s))
            pa.default_memory_pool().release_unused()  # workers are kept, and so is what Arrow has freed


def centres_of(x: np.ndarray, weights: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n weighted means; empty ones, or all where there is nothing to fit, lie far off."""
    out = np.full((n, x.shape[1]), 1e3, np.float32)
    if not len(x):
        return out
    first = rng.choice(len(x), min(n, len(x)), replace=False, p=weights / weights.sum())
    out[: len(first)] = x[first]
    for _ in range(8):
        k = nearest(x, out)
        total = np.bincount(k, weights=weights, minlength=n)
        for c in np.flatnonzero(total):
            out[c] = weights[k == c] @ x[k == c] / total[c]
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


class Classes:
    """The class of a word: the centroid nearest to the mean of its byte pairs. The end of text has the last class alone."""

    def __init__(self, words: list[bytes], weights: np.ndarray, seed: int = 1):
        x, rng = self.vectors(words), np.random.default_rng(seed)
        group = nearest(x, centres_of(x, weights, WIDTH, rng)) if len(x) else np.zeros(0, int)
        parts = [centres_of(x[group == g], weights[group == g], WIDTH - (g == WIDTH - 1), rng) for g in range(WIDTH)]
        self.table = np.ascontiguousarray(np.concatenate(parts).T)
        self.bias = (self.table.astype(float) ** 2).sum(0).astype(np.float32) / 2

    @staticmethod
    def pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed byte pairs of all words, with where each word's begin and how many they are."""
        data = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(sizes) - sizes
        code = (data[:-1] * 31 + data[1:] * 517) % PAIRS
        inside = np.ones(len(data), bool)
        inside[first + sizes - 1] = False
        return code[inside[:-1]], first - np.arange(len(words)), sizes - 1

    def vectors(self, words: list[bytes]) -> np.ndarray:
        x = np.zeros((len(words), PAIRS), np.float32)
        if words:
            code, _, size = self.pairs(words)
            np.add.at(x, (np.repeat(np.arange(len(words)), size), code), 1)
            x /= np.sqrt(size)[:, None]
        return x

    def of(self, words: list[bytes], most: int = 100_000) -> np.ndarray:
        """Classes of words, about ``most`` bytes at a time."""
        out = np.empty(len(words), np.int64)
        for start, stop in parts(np.fromiter(map(len, words), np.int64, len(words)) + 2, most):
            code, first, n = self.pairs(words[start:stop])
            if len(code) > 4 * most:  # a giant word in it
                sums = np.stack([np.bincount(code[f : f + k], minlength=PAIRS) for f, k in zip(first, n)]) @ self.table
            else:
                sums = np.empty((len(n), self.table.shape[1]), np.float32)
                for k in np.unique(n):  # words of one length at a time
                    own = np.flatnonzero(n == k)
                    if k > 100:
                        sums[own] = self.table[code[first[own, None] + np.arange(k)]].sum(1)
                        continue
                    total = self.table.take(code[first[own]], axis=0)
                    more = np.empty_like(total)
                    for d in range(1, k):
                        total += self.table.take(code[first[own] + d], axis=0, out=more, mode="clip")
                    sums[own] = total
            sums /= np.sqrt(n)[:, None]
            sums -= self.bias
            out[start:stop] = sums.argmax(1)
        out[[k for k, w in enumerate(words) if w == END]] = CLASSES - 1
        return out


class Tokens:
    """Numbers and logs of counts of words; the log is NaN if the count is not sent."""

    def __init__(self, classes: Classes, common: pa.Array, logs: np.ndarray, slots: dict[bytes, int]):
        self.classes, self.common, self.logs = classes, common, np.append(logs, np.nan)
        self.taken, self.slots = pa.array([w.decode() for w in slots], pa.string()), np.append(np.fromiter(slots.values(), U, len(slots)), U(WIDTH - 1))

    def slot(self, words: pa.Array) -> np.ndarray:
        return self.slots[places(words, self.taken)]

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        own = as_bytes(words)
        hashes = np.fromiter(map(xxhash.xxh32_intdigest, own), U, len(own)) & U(0xFFFFF)
        return hashes | self.slot(words) << U(SLOT) | self.classes.of(own).astype(U) << U(CLASS), self.logs[places(words, self.common)]


def contexts(number: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes (templates x tokens) of what comes before each token: the word before, the two before, the classes of three, the word before
    the last, skipping one, and the groups that are commonest among the last twelve."""
    back = []
    for d in (1, 2, 3):
        b = np.full(len(number), U(CLASSES << CLASS), U)  # before the text
        b[d:] = np.where(place[d:] >= d, number[:-d] if d < len(number) else number[:0], U(CLASSES << CLASS))
        back.append(b)
    a, b, c = (x >> U(CLASS) for x in back)
    # Of the words just before, in one number: the two groups that hold most of them. Groups are counted in the bytes of a sum.
    sums = np.zeros(len(number) + 1, np.uint64)
    np.cumsum(np.uint64(1) << (number >> U(CLASS + 3) << U(3)).astype(np.uint64), out=sums[1:])
    at = np.arange(len(number))
    near = (sums[:-1] - sums[at - np.minimum(place, NEAR)]).astype("<u8").view(np.uint8).reshape(-1, WIDTH)
    most, next_ = np.zeros((2, len(number)), np.uint8)  # count * 8 + (7 - group): ties to the first group
    for g in range(WIDTH):
        own = near[:, g] * np.uint8(WIDTH) + np.uint8(WIDTH - 1 - g)
        next_ = np.maximum(next_, np.minimum(most, own))
        most = np.maximum(most, own)
    first, second = (np.where(x >= WIDTH, WIDTH - 1 - x % WIDTH, WIDTH).astype(U) for x in (most, next_))
    both = second + U(WIDTH + 1) * first
    keys = (back[0], back[0] * U(0x85EBCA6B) ^ back[1], (a * U(131) + b) * U(131) + c, back[1], both)
    out = np.stack([(k + U(0x9E3779B1 * (t + 1) & 0xFFFFFFFF)) * U(0xC2B2AE35) for t, k in enumerate(keys)])
    return out ^ out >> U(15)


class Model:
    """Weights (levels x templates x rows x 8) and the unigram logits of each level's parent (1, 8 or 64 of them)."""

    def __init__(self, rows: int, priors: list[np.ndarray]):
        self.rows, self.priors, self.blank = rows, [p.astype(np.float32) for p in priors], True
        self.shares = [np.exp(p) / np.exp(p).sum(1, keepdims=True) for p in self.priors]
        self.w = np.zeros((LEVELS * TEMPLATES * rows, WIDTH), np.float32)

    def levels(self, context: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each level: its number, target and parent of each token, and the rows of its features (templates x tokens)."""
        shift = U(33 - self.rows.bit_length())
        k, slot = number >> U(CLASS), number >> U(SLOT) & U(WIDTH - 1)
        for level, (target, parent) in enumerate(((k // WIDTH, np.zeros_like(k)), (k % WIDTH, k // WIDTH), (slot, k))):
            at = ((context ^ parent * U(0x9E3779B1) + U(level)) * U(0x85EBCA6B)) >> shift
            yield level, target, parent, at.astype(np.intp)

    def probabilities(self, level: int, parent: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.blank:  # without weights, what the counts say
            return self.shares[level][parent]
        s = self.priors[level].take(parent, axis=0)
        own = np.empty_like(s)
        for t in range(TEMPLATES):
            first = (level * TEMPLATES + t) * self.rows
            self.w[first : first + self.rows].take(at[t], axis=0, out=own, mode="clip")  # all are inside; "raise" would copy
            s += own
        np.exp(s, out=s)
        s /= (s @ np.ones(WIDTH, np.float32))[:, None]
        return s

    def log10(self, context: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Log probability of each token's group, class and slot together."""
        out = np.zeros(len(number))
        for s in range(0, len(number), BATCH):
            own = slice(s, s + BATCH)
            for level, target, parent, at in self.levels(context[:, own], number[own]):
                p = self.probabilities(level, parent, at)
                out[own] += np.log10(np.maximum(p[np.arange(len(p)), target], 1e-30))
        return out

    def zeros(self) -> np.ndarray:
        return np.zeros((LEVELS * TEMPLATES, WIDTH, self.rows))

    def gather(self, context: np.ndarray, number: np.ndarray, seen: np.ndarray | None, expected: np.ndarray) -> None:
        """Add to each feature's row how often it saw each target, and how often the model expects it; both made by zeros().

        Adding up goes over all rows, so it waits for several tokens a row.
        """
        for start in range(0, len(number), max(BATCH, 4 * self.rows)):
            part = slice(start, start + max(BATCH, 4 * self.rows))
            p = np.empty((WIDTH, len(number[part])))
            for level, target, parent, at in self.levels(context[:, part], number[part]):
                for s in range(0, len(target), BATCH):
                    own = slice(s, s + BATCH)
                    p[:, own] = self.probabilities(level, parent[own], at[:, own]).T
                for t in range(TEMPLATES):
                    k, row = level * TEMPLATES + t, at[t]
                    for c in range(WIDTH):
                        expected[k, c] += np.bincount(row, weights=p[c], minlength=self.rows)
                    if seen is not None:
                        seen[k] += np.bincount(target * self.rows + row, minlength=WIDTH * self.rows).reshape(WIDTH, -1)

    def step(self, seen: np.ndarray, expected: np.ndarray, rate: float, prior: float = 60.0) -> None:
        """Along log(seen / expected), each softened by ``prior`` events shared out as expected."""
        self.blank = False
        share = expected / np.maximum(expected.sum(1, keepdims=True), 1e-9)
        self.w += np.clip(rate * np.log((seen + prior * share + 1e-9) / (expected + prior * share + 1e-9)), -4, 4).astype(np.float32)


def number_groups(batches: Iterator[pa.RecordBatch], most: int = 65_536) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their texts' numbers, contexts and sizes, about ``most`` tokens at a time; the numbers are the last column."""
    for b in batches:
        last = b.column(b.num_columns - 1)
        size = pc.binary_length(last).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        for s, e in parts(size, most):
            own = size[s:e]
            number = np.frombuffer(b"".join(last.slice(s, e - s).to_pylist()), "<u4")
            place = np.arange(len(number)) - np.repeat(np.cumsum(own) - own, own)
            yield b.slice(s, e - s), number, contexts(number, place), own


def counts(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """word and c of all training tokens, ends too; added up in each task first, up to ``most`` words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ends = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for part, words, _ in text_groups(batches):
            seen.append(pa.table(words.value_counts().flatten(), names=["word", "c"]))
            ends += part.num_rows
            if sum(t.num_rows for t in seen) > 2 * most:
                seen = [added()]
                if seen[0].num_rows > most:
                    yield from seen.pop().to_batches(most)
        if ends:
            seen.append(pa.table({"word": [END.decode()], "c": pa.array([ends], pa.int64())}))
            yield from added().to_batches(most)

    return docs.where("not held_out").select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def rows_for(tokens: int, least: int = 12, most: int = 16) -> int:
    """Hashed rows of a template and level: a power of two that grows with the training tokens, 65,536 at most (31 MB of weights in all)."""
    return 1 << min(most, max(least, max(tokens, 1).bit_length() - 12))


def train(numbers: DataFrame, priors: list[np.ndarray], tokens: int, rates: tuple[float, ...]) -> Model:
    """The model after a round over all training texts for each rate.

    A task sees some 256 tokens for each row of a template, so what tasks send stays a share of their input; the sums of all
    tasks add up in two steps, so that no group gathers more than the root of their number.
    """
    spark = numbers.sparkSession
    model = Model(rows_for(tokens), priors)
    tasks = max(8, -(-tokens // (256 * model.rows)))
    texts, merged = numbers.coalesce(tasks), max(1, round(tasks**0.5))
    block, schema = 1 << 12, "salt int, block int, at binary, v binary"
    seen = None
    for rate in rates:
        held, first = spark.sparkContext.broadcast(model), seen is None

        def look(batches: Iterator[pa.RecordBatch], held=held, first=first) -> Iterator[pa.RecordBatch]:
            m = held.value
            expected, seen_ = m.zeros(), m.zeros() if first else None
            for _, number, context, _ in number_groups(batches, most=4 * m.rows):
                m.gather(context, number, seen_, expected)
            salt = TaskContext.get().partitionId() % merged
            for b in range(0, len(m.w), block):
                k, own = b // m.rows, slice(b % m.rows, b % m.rows + block)
                at = np.flatnonzero(expected[k, 0, own])
                if len(at):
                    v = np.hstack([x[k, :, own][:, at].T for x in ((expected, seen_) if first else (expected,))])
                    yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([b // block], pa.int32()), pa.array([at.astype("<i2").tobytes()]), pa.array([v.astype("<f4").tobytes()])], names=["salt", "block", "at", "v"])

        def add(part: pa.Table) -> pa.Table:
            total = None
            for at, v in zip(part["at"], part["v"]):
                at, v = np.frombuffer(at.as_py(), "<i2"), np.frombuffer(v.as_py(), "<f4").reshape(-1, WIDTH * (1 + first))
                total = np.zeros((block, v.shape[1])) if total is None else total
                total[at] += v
            at = np.flatnonzero(total[:, 0])
            return pa.table({"salt": pa.array([0], pa.int32()), "block": part["block"].slice(0, 1), "at": [at.astype("<i2").tobytes()], "v": [total[at].astype("<f4").tobytes()]})

        sums = texts.mapInArrow(look, schema).groupBy("salt", "block").applyInArrow(lambda t: add(t), schema).groupBy("block").applyInArrow(lambda t: add(t), schema)
        expected = np.zeros(model.w.shape)
        seen = np.zeros(model.w.shape) if first else seen
        for r in sums.collect():  # of the model's size, whatever the corpus
            at = r.block * block + np.frombuffer(r["at"], "<i2").astype(np.int64)
            v = np.frombuffer(r.v, "<f4").reshape(len(at), -1)
            expected[at] = v[:, :WIDTH]
            if first:
                seen[at] = v[:, WIDTH:]
        model.step(seen, expected, rate)
    return model


def score(docs: DataFrame, folds: int = 7, fold: int = 2, head: int = 262_144, fitted_words: int = 20_000, rates: tuple[float, ...] = (0.5, 0.5)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Tokens are lower-cased words and one end. Training texts are those whose crc32 of the id in decimal is not ``fold`` modulo
    ``folds``; null ids train. Null and empty texts are one end; texts and words of any length are read whole. Rows equal in id and text
    train each and score alike; other columns, whatever their names, are left out; an empty table gives no rows. If nothing trains, counts are
    zero and the probabilities of groups, classes and slots are even.

    Spelling classes are fitted on the ``fitted_words`` commonest words; every word has one. Only tables of a bounded size go to the
    tasks: the weights, the centroids, and the counts of the ``head`` commonest words. Rarer words meet their counts in a join.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(crc_bucket("doc_id", folds) == fold, F.lit(False)).alias("held_out"), "text")
    table = written(counts(rows))
    n, v = (x or 0 for x in table.agg(F.sum("c"), F.count("*")).first())
    # The least count of which there are no more than ``head`` words, from the few different counts that there are.
    sizes_ = table.groupBy("c").agg(F.count("*").alias("w")).orderBy(F.desc("c")).limit(head).toPandas()
    least = sizes_.c[sizes_.w.cumsum() <= head].min() if len(sizes_) else 0
    top = table.where(F.col("c") >= (int(least) if least == least else 1 << 62)).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    common = pa.array(top.word, pa.string())
    top["word"] = [w.encode() for w in top.word]
    fit = top[top.word != END].head(fitted_words)
    spell = Classes(fit.word.tolist(), np.log1p(fit.c.to_numpy(float)))
    # The commonest words of each class have slots of their own.
    slots: dict[bytes, int] = {}
    taken: Counter = Counter()
    for word, k in zip([END, *fit.word], spell.of([END, *fit.word]).tolist()):
        if taken[k] < WIDTH - 1:
            slots[word] = taken[k]
            taken[k] += 1
    words = spark.sparkContext.broadcast(Tokens(spell, common, np.log10(top.c.to_numpy(float) + 1), slots))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = words.value
        total = np.zeros((2, CLASSES * WIDTH))
        for b in batches:
            own, c = b.column(0), b.column(1).to_numpy()
            k = tokens.classes.of(as_bytes(own)) * WIDTH + tokens.slot(own).astype(np.int64)
            total += np.stack([np.bincount(k, weights=c, minlength=CLASSES * WIDTH), np.bincount(k, minlength=CLASSES * WIDTH)])
        yield pa.RecordBatch.from_pydict({"k": list(range(CLASSES * WIDTH)), "c": total[0].astype(int), "v": total[1].astype(int)})

    seen = np.zeros((2, CLASSES * WIDTH))
    for r in table.mapInArrow(sizes, "k long, c long, v long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        seen[:, r.k] = r.c, r.v
    # One unknown word for each class: in the slot that words share.
    mass = seen.sum(0) + (np.arange(CLASSES * WIDTH) % WIDTH == WIDTH - 1)
    cells = (mass + 0.01 if n else np.ones_like(mass)).reshape(WIDTH, WIDTH, WIDTH)
    priors = [np.log(cells.sum((1, 2)))[None], np.log(cells.sum(2)), np.log(cells.reshape(CLASSES, WIDTH))]
    priors = [p - np.log(np.exp(p).sum(1, keepdims=True)) for p in priors]
    log_mass = np.log10(np.maximum(mass, 1))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, size in text_groups(batches):
            found = found.dictionary_encode()
            different = pa.concat_arrays([found.dictionary, pa.array([END.decode()])])
            at = np.insert(found.indices.to_numpy(zero_copy_only=False), np.cumsum(size), len(different) - 1)  # an end after each text
            size += 1
            first = np.cumsum(size) - size
            numbers, logs = words.value.of(different)
            number, log = numbers[at], logs[at]
            rare = np.isnan(log)
            known, logs = size - np.add.reduceat(rare.astype(np.int64), first), np.add.reduceat(np.where(rare, 0.0, log), first)
            where = np.flatnonzero(rare)
            pairs, times = np.unique(np.repeat(np.arange(len(size)), size)[where] << 32 | at[where].astype(np.int64), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(size) + 1) << 32), pa.int32())
            found = different.take(pa.array(pairs & 0xFFFFFFFF))
            found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([found, pa.array(times, pa.int32())], names=["word", "t"]))
            data = number.astype("<u4").tobytes()
            own = pa.array([data[4 * s : 4 * (s + k)] for s, k in zip(first.tolist(), size.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(known), pa.array(logs), found, own], names=["row", "doc_id", "held_out", "known", "logs", "rare", "numbers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    texts = written(numbered.mapInArrow(put, f"row long, doc_id {kind}, held_out boolean, known long, logs double, rare array<struct<word:string,t:int>>, numbers binary"))
    model = train(texts.where("not held_out").select("numbers"), priors, n, rates) if n else Model(1 << 12, priors)
    held = spark.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, context, size in number_groups(batches):
            each = held.value.log10(context, number) - log_mass[number >> U(SLOT)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(size), pa.array(np.add.reduceat(each, np.cumsum(size) - size))], names=["row", "doc_id", "held_out", "known", "logs", "n", "chain"])

    scored = texts.select("row", "doc_id", "held_out", "known", "logs", "numbers").mapInArrow(look, f"row long, doc_id {kind}, held_out boolean, known long, logs double, n long, chain double")
    met = texts.select("row", F.inline("rare")).join(table, "word")
    rare = met.groupBy("row").agg(F.sum("t").alias("more"), F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    out = scored.join(rare, "row", "left").withColumn("logs", F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)))
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("logs") + F.col("chain")).alias("score"))
