"""Token files: their format, whole stores against the library, and single places."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import docs, none, originals, rows, texts  # noqa: F401

from ravelin.llm.queries import BYTE_BPE, tokenizer


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(BYTE_BPE))


def test_ids_of_odd_texts(lib):
    from ravelin.llm.chunk_ids import TextIds

    rng = random.Random(2)
    alphabet = "a b é ß \t \n   　 x' 's 1 2 ,. <|endoftext|> ʼ 漢 \x1c \x85 A \xa0".split(" ") + [" ", "\n", " "]
    every = texts(60) + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [" ", "a", "\na", "a\n", "<|endoftext|> x", "x <|endoftext|>"]
    with open(tokenizer(BYTE_BPE), encoding="utf-8") as f:
        ids = TextIds(f.read(), 2, most=500)  # so that the memory is cleared on the way
    for lo in range(0, len(every), 700):
        found, sizes = ids(pa.array(every[lo : lo + 700]))
        for t, one in zip(every[lo:], np.split(found, np.cumsum(sizes)[:-1])):
            assert one.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2]


def test_files():
    from ravelin.llm.token_store import TokenFile, encoded

    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 10), (1, 1 << 30), (511, 300), (512, 300), (5000, 70_000), (20_000, 1 << 31)):
        ids = (rng.random(n) ** 4 * top).astype(np.uint32)
        ends = np.append(np.sort(rng.integers(0, n + 1, 3)), n)
        file = TokenFile.of(encoded(ids, np.array([5, 0, 7, -2]), np.array([False, True, False, False]), ends))
        assert file.n == n and np.array_equal(file.all(), ids)
        assert all(file.at(int(k)) == ids[k] for k in rng.integers(0, n, 200 if n else 0))
        assert file.directory()[0] == [5, None, 7, -2] and np.array_equal(file.directory()[1], ends)
        with pytest.raises(IndexError):
            file.at(n)
    with pytest.raises(ValueError):
        TokenFile.of(b"another kind of file, long enough for a head")


@pytest.mark.parametrize("per_file", [8_000_000, 50])
def test_store(spark, docs, none, lib, per_file):  # noqa: F811
    from ravelin.llm.token_store import read_tokens, tokens_at, write_tokens

    store = write_tokens(docs, tokenizer(BYTE_BPE), per_file=per_file, per_task=2_000)
    got = read_tokens(spark, store).orderBy("start").collect()
    own = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1] or 0))
    assert [r.doc_id for r in got] == [i for _, i, _ in own]
    want = {}
    for _, i, t in own:
        want.setdefault(i, []).append([*lib.encode(t, add_special_tokens=False).ids, 2])
    start, stream = 0, []
    for r in got:
        want[r.doc_id].remove(list(r.ids))
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
        stream += r.ids
    assert not any(want.values())
    places = [0, 0, start - 1, start, -1, *random.Random(1).choices(range(start), k=100)]
    asked = spark.createDataFrame([(p,) for p in places] + [(None,)], "place long")
    assert sorted(map(tuple, tokens_at(spark, store, asked, width=700).collect())) == sorted((p, stream[p]) for p in places if 0 <= p < start)
    assert read_tokens(spark, write_tokens(none, tokenizer(BYTE_BPE))).count() == 0
