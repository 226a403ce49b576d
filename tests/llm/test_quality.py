"""Document scores against sums over all labellings of their lines, long chains in blocks, and the bounds of training."""

import itertools
import random

import numpy as np
import pytest

from ravelin.llm import quality_crf as qc


def corpus(n=240, seed=5):
    pick = random.Random(seed)
    good = lambda: " ".join(pick.choice("the of and river stone house light walks under".split()) for _ in range(pick.randint(6, 14))) + "."
    bad = lambda: pick.choice(("BUY!! NOW!! ", "win win win ", "|| 12 | 34 || ")) * pick.randint(2, 8)
    return [(k, "\n".join(good() if (k % 2) ^ (pick.random() < 0.15) else bad() for _ in range(pick.randint(1, 6)))) for k in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    pairs = corpus()
    df = spark.createDataFrame([*pairs, (900, None), (901, ""), (902, "\n\n"), (None, pairs[1][1])], "doc_id long, text string")
    return df, spark.createDataFrame([(k, k % 2, 0) for k, _ in pairs], "doc_id long, quality int, toxic int")


def test_marginals_in_blocks():
    rng = np.random.default_rng(1)
    sizes, turn = np.array([1, 5, 1024, 1025, 3000, 2, 64]), np.array([[0.0, 0.7], [-0.4, 1.1]])
    score = 2 * rng.standard_normal(sizes.sum())
    whole = qc.marginals(score, sizes, turn, 10_000)
    for block in (1, 2, 3, 64, 1024):
        for got, want in zip(qc.marginals(score, sizes, turn, block), whole):
            assert np.allclose(got, want, atol=1e-6)
    few = np.array([3, 1, 7, 4])
    score, at = rng.standard_normal(few.sum()), 0
    good, log_z, steps = qc.marginals(score, few, turn, 2)
    for k, n in enumerate(few):
        paths = np.array(list(itertools.product((0, 1), repeat=int(n))))
        w = np.exp(paths @ score[at : at + n] + turn[paths[:, :-1], paths[:, 1:]].sum(1))
        assert np.isclose(log_z[k], np.log(w.sum())) and np.allclose(good[at : at + n], w @ paths / w.sum())
        for i, j in itertools.product((0, 1), repeat=2):
            assert np.isclose(steps[k, i, j], w @ ((paths[:, :-1] == i) & (paths[:, 1:] == j)).sum(1) / w.sum())
        at += n


def test_document_scores_against_all_labellings(tables):
    df, labels = tables
    crf = qc.train(df, labels)
    got = {r.doc_id: r.score for r in qc.score_quality(df, labels).collect()}
    for doc_id, text in [(r.doc_id, r.text or "") for r in df.collect()]:
        lines = text.split("\n")
        own = [qc.line_features(line, set(lines[:k])) for k, line in enumerate(lines)]
        edge = (0.0,) * qc.N_OWN
        x = np.array([[*own[k], *(own[k - 1] if k else edge), *(own[k + 1] if k + 1 < len(own) else edge), k == 0, k + 1 == len(own), 1] for k in range(len(own))])
        score = (x - crf.mean) / crf.scale @ crf.weights
        share = total = 0.0
        for path in itertools.product((0, 1), repeat=len(lines)):
            w = np.exp(sum(s for s, y in zip(score, path) if y) + sum(crf.turn[p] for p in zip(path, path[1:])))
            total += w
            share += w * sum(len(line) + 1 for line, y in zip(lines, path) if y) / (len(text) + 1)
        p = min(max(share / total, 1e-6), 1 - 1e-6)
        want = 1 / (1 + np.exp(-(crf.curve[0] * np.log(p / (1 - p)) + crf.curve[1])))
        assert abs(got[doc_id] - want) < 1e-4, (doc_id, text)


def test_training_holds_a_bounded_number_of_lines(spark, tables):
    assert qc.room(np.array([3, 2000]), np.array([10, 10]), 2000, 400_000) == 2000
    assert qc.room(np.array([3, 50, 2000]), np.array([10, 5, 2]), 2000, 300) == (300 - 10 * 3) // 7 and qc.room(np.array([9]), np.array([50]), 2000, 10) == 1
    assert qc.room(np.array([], int), np.array([], int), 2000, 10) == 2000
    df, labels = tables
    full, same, thin = qc.train(df, labels), qc.train(df, labels, total=10**9), qc.train(df, labels, total=250)
    assert np.allclose(full.weights, same.weights) and not np.allclose(full.weights, thin.weights)


def test_very_long_texts(spark, tables):
    _, labels = tables
    pairs = corpus()
    long = [(1000, "\n".join(t for k, t in pairs if k % 2) * 60), (1001, "BUY!! NOW!!\n" * 60_000), (1002, "word " * 400_000), (1003, "\n" * 100_000)]
    df = spark.createDataFrame(pairs + long, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in qc.score_quality(df, labels).collect()}
    crf = qc.train(df, labels)
    assert len(got) == len(pairs) + 4
    for k, text in long:
        x, size = qc.features(text)
        good, _, _ = qc.marginals((x - crf.mean) / crf.scale @ crf.weights, np.array([len(x)]), crf.turn, 10**9)
        assert abs(got[k] - crf.probability((good * size).sum() / size.sum())) < 1e-6
