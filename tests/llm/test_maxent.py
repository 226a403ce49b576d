"""op6's work: what a training round clears and adds, words by Arrow, counts that leave a task in parts."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ravelin.llm import maxent_lm as m

ODD = [None, "", " ", "\n \r\n", "a", " A\x0bb\x1cC\x0cÉ\x85x　y\tf ", "z\x00 \x00", "İ ſ K I", "\U0001f600 \U0001f600", "x" * 300_000, "one  two\tone", " ".join(f"w{k % 7000}" for k in range(20_000))]


def tokens(n, seed=3):
    rng = np.random.default_rng(seed)
    place = np.arange(n) % 500
    number = rng.integers(0, 1 << 29, n).astype(np.uint32)
    return number, m.contexts(number, place)


def even(rows):
    return m.Model(rows, [np.log(np.full((k, m.WIDTH), 1 / m.WIDTH)) for k in (1, m.WIDTH, m.CLASSES)])


def test_a_round_goes_over_its_rows_once_for_many_tokens(monkeypatch):
    """Sums of all rows a batch of 16,384 tokens were most of a round's time: 960 cells a token."""
    model = even(1 << 16)
    number, context = tokens(4 * model.rows)
    seen, expected, cells, plain = model.zeros(), model.zeros(), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: (cells.append(len(got := plain(*a, **b))), got)[1])
    model.gather(context, number, seen, expected)
    assert sum(cells) <= 100 * len(number)
    assert (seen.sum((1, 2)) == len(number)).all() and np.allclose(expected.sum((1, 2)), len(number))


def test_a_round_is_the_sum_of_its_parts_in_bounded_memory():
    model = even(1 << 12)
    model.blank, model.w[:] = False, np.random.default_rng(5).normal(size=model.w.shape)
    number, context = tokens(400_000)
    whole, parts = (model.zeros(), model.zeros()), (model.zeros(), model.zeros())
    tracemalloc.start()
    model.gather(context, number, *whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for s in range(0, len(number), 7001):
        model.gather(context[:, s : s + 7001], number[s : s + 7001], *parts)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts)) and peak < 16e6


def test_groups_before_a_token():
    number, context = tokens(3000)
    for i in random.Random(1).sample(range(3000), 300):
        group = [int(x) >> 26 for x in number[max(i - i % 500, i - 12) : i]]
        order = sorted(Counter(group).items(), key=lambda v: (-v[1], v[0]))
        both = (order[1][0] if len(order) > 1 else 8) + 9 * (order[0][0] if order else 8)
        key = (both + 0x9E3779B1 * 5) * 0xC2B2AE35 & 0xFFFFFFFF
        assert context[4, i] == key ^ key >> 15


def test_words_of_texts():
    want = [(t or "").encode().lower().split() for t in ODD]
    words, size = m.words_of(pa.array(ODD).slice(0))
    assert m.as_bytes(words) == [w for ws in want for w in ws] and size.tolist() == [len(ws) for ws in want]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), pa.array(ODD)], names=["k", "text"])
    for most in (1, 50, 1 << 23):  # rows in order, each once, whatever the pieces
        got = list(m.text_groups([batch.slice(0, 3), batch.slice(0, 0), batch.slice(3)], most))
        assert [k for part, _, _ in got for k in part.column(0).to_pylist()] == list(range(len(ODD)))
        assert [w for _, words, _ in got for w in m.as_bytes(words)] == [w for ws in want for w in ws]
        assert [n for _, _, size in got for n in size.tolist()] == [len(ws) for ws in want]


def test_counts_that_leave_a_task_in_parts(spark):
    want = Counter(w.decode() for t in ODD for w in [*(t or "").encode().lower().split(), m.END])
    df = spark.createDataFrame([(t, False) for t in ODD] + [("held", True)], "text string, held_out boolean").repartition(2)
    for most in (2, 500_000):
        assert {r.word: r.c for r in m.counts(df, most).collect()} == want
    assert m.counts(df.where("held_out")).count() == 0


def test_scores_of_odd_texts(spark):
    """Tokens, known words and base score of each row, where a piece holds many texts and rare words are joined."""
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    split = {i: ([*(t or "").encode().lower().split(), m.END], zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(ODD)}
    c = Counter(w for ws, held in split.values() if not held for w in ws)
    n = sum(c.values())
    for r in m.score(df, head=3, fitted_words=50).collect():
        ws, held = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert np.isclose(r.base_score, sum(np.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws)) and np.isfinite(r.score)
