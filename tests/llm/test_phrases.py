"""Collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ravelin.llm.phrases import Filter, Reader, Words, collocations


def slow(docs, least, longest=4, first=2000, inside=80):
    f, n = Counter(), Counter()
    for _, lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    drop = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= inside * f[lang, p[i : i + k]]}
    out = []
    for lang in n:
        rows = []
        for (own, p), a in found.items():
            if own == lang and (own, p) not in drop:
                score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = "The the of a b c é 漢字 x' \x0b \x85 ﬁne A.b q\ts \xa0 to be or not".split(" ")
    out = [(k, rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words) + rng.choice(["", "", "", " ", ".", ",", "\n", "\r", "\t"]) for _ in range(rng.randint(0, 40)))) for k in range(n)]
    return out + [(None, "en", None), (7, None, ""), (8, "en", "..,, \n"), (3, "en", "to be or not to be " * 3000), (9, "fr", "x")] + out[:40]


KIND = "doc_id long, lang string, text string, phrase string, a int, f int"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_against_plain_counts(spark):
    docs = made(1)
    df = spark.createDataFrame([(*d, "p", 1, 2) for d in docs], KIND).repartition(3)
    for least, first in ((5, 2000), (30, 7)):
        got = collocations(df, least=least, first=first)
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == slow(docs, least, first=first)
    # A filter too small to part anything changes no result.
    assert sorted(map(tuple, collocations(df, least=5, most_bits=1 << 19, longest=3).select(*COLUMNS).collect())) == slow(docs, 5, longest=3)
    by_id = {}
    for i, lang, t in docs:
        by_id.setdefault((i, lang or "und"), []).append("".join(w + " " for p in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for w in re.findall("[^ \t]+", p)).encode())
    for r in collocations(df, least=5).collect():
        assert any(b" " + r.phrase.encode() + b" " in b" " + t for t in by_id[r.doc_id, r.lang])
    assert collocations(df.limit(0)).count() == 0


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(10**13, 3 * 10**13, 10**13)], "a long, l long, r long").select(F.expr("CAST(CAST(2000000 * CAST(a AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) DIV CAST(CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) AS BIGINT)").alias("s")).first().s
    assert got == 2_000_000 * 10**13 // (4 * 10**13)


def test_words_and_collisions():
    w = Words(pa.array(["Ab  c.d", None, "", "e\tf"]))
    assert w.buffer.tobytes() == b"ab c d e f " and w.text.tolist() == [0, 0, 0, 3, 3] and len(set(w.piece.tolist())) == 3
    from ravelin.llm.fingerprints import grouped

    buffer = np.frombuffer(b"aabbaa", np.uint8)
    start, end = np.array([0, 2, 4, 0]), np.array([2, 4, 6, 3])
    for key in (np.zeros(4, np.uint64), np.array([1, 2, 1, 3], np.uint64)):  # all collide; none does
        first, inverse, n = grouped(buffer, start, end, key)
        assert inverse[0] == inverse[2] and len({*inverse.tolist()}) == 3 and sorted(n.tolist()) == [1, 1, 2] and all(inverse[f] == k for k, f in enumerate(first))
    keys = Reader().keys(Reader().prints.prefix(buffer), start[:0], end[:0], start[:0].astype(np.uint64))
    assert len(keys) == 0 and Filter(np.full(1 << 16, 255, np.uint8)).has(np.array([0, 1 << 63], np.uint64)).all()


def test_query_against_sql(spark):
    import duckdb

    from ravelin.llm import queries

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(queries.oracle_sql()["op11_phrases"])
    got = queries.op11_phrases(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 100
