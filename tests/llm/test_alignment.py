"""Alignment of two tokenizers against the libraries and loops over tokens, and minimal perfect hashing."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from test_operators import docs, none, texts  # noqa: F401

from ravelin.llm.perfect_hash import PerfectHash
from ravelin.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer
from ravelin.llm.token_alignment import align_tokens


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        found = PerfectHash.of(keys)
        assert len(found) == len(keys) and np.array_equal(np.sort(found(keys)), np.arange(len(keys)))
        again = PerfectHash.unpacked(*found.packed())
        assert np.array_equal(again(keys), found(keys)) and again(rng.integers(0, 1 << 63, 100).astype(np.uint64)).max(initial=-1) < max(n, 1)
    assert 64 * len(found.words) / 50_000 < 5
    with pytest.raises(ValueError):
        PerfectHash.of(np.array([3, 3], np.uint64))


def slow(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer(BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    from ravelin.llm.token_counts import byte_letters

    raw = {c: k for k, c in byte_letters().items()}
    found, pairs = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(raw[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]]
        want = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append((i, [], [], [], ""))
            continue
        own_a = [k for k, x in enumerate(bytes_a) for _ in x]
        own_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = [(ids_a[x], ids_b[y]) for x, y in dict.fromkeys(zip(own_a, own_b))]
        ends_a, ends_b = set(np.cumsum([*map(len, bytes_a)]).tolist()), set(np.cumsum([*map(len, bytes_b)]).tolist())
        groups, start = [], 0
        for cut in sorted(ends_a & ends_b):
            side = lambda own, ids: ",".join(str(ids[k]) for k in dict.fromkeys(own[start:cut]))  # noqa: B023, E731
            groups.append(f"{side(own_a, ids_a)}|{side(own_b, ids_b)}")
            start = cut
        pairs.update(links)
        found.append((i, ids_a, ids_b, links, ";".join(groups)))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i is not None, i, len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, links, g in found), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("options", [{}, {"most_pairs": 1}, {"memory": 50}])
def test_against_loops(spark, docs, none, options):  # noqa: F811
    rng = random.Random(4)
    alphabet = "a b é \t \n 　 x' 's 12 ,. <|endoftext|> <s> ▁ 漢 \x1c \xa0 <0x0A>".split(" ") + [" ", "\n", " "]
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [" ", "a", "\na", "a\n", "x <|endoftext|>", "the  double", "▁", "a" * 5000]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(more)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, pairs int, n int").repartition(3)
    got = align_tokens(df, tokenizer(BYTE_BPE), tokenizer(PIECE_BPE), **options).select(*COLUMNS).collect()
    assert sorted(((r[0] is not None, *r) for r in got), key=str) == slow(rows)
    assert align_tokens(none, tokenizer(BYTE_BPE), tokenizer(PIECE_BPE), **options).count() == 0
