"""Each operator on rows with nulls, empty and long texts, ties, repeats, clashing extra columns, and on empty tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ravelin.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE, tokenizer

DOCS = "doc_id long, text string, n_tokens long, row string, part int, fp string, score double, key long"
LONG = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strange potions near the old harbour wall tonight. "


def texts(n=40, seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta épsilon zeta 漢字 eta's don't I'LL 3.14 100,000 <|endoftext|> <s> ▁x İstanbul naïve  ﬁne 😀 --- ... |".split(" ")
    out = ["", " ", "\n\n", LONG, LONG * 30, "a" * 3000, "\0\x1c", LONG + "x " + LONG]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out += [f"{k} {passage} {k * 7}" for k in range(6)]
    return out + out[3:5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, 1, "r", 2, "f", 0.5, 3) for k, t in enumerate(texts())]
    rows += [(500, None, 1, "r", 2, "f", 0.5, 3), (3, texts()[3], 1, "r", 2, "f", 0.5, 3), (None, "a row without an id", 1, "r", 2, "f", 0.5, 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in df.collect())


def originals(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in df.select("doc_id", "text").collect())


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    from ravelin.llm.token_counts import token_counts

    lib = Tokenizer.from_file(tokenizer(BYTE_BPE))
    want = [(i, len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 512) for i, t in originals(docs)]
    assert rows(token_counts(docs, tokenizer(BYTE_BPE))) == want
    assert token_counts(none, tokenizer(BYTE_BPE)).count() == 0


def test_every_vocabulary_string_is_checked():
    from ravelin.llm.token_counts import merge, merge_long, model

    m = model(tokenizer(BYTE_BPE))
    for v in random.Random(0).sample(sorted(m["whole"]), 2000):
        assert merge(list(v), m["ranks"]) == [v] and merge_long(v, m["ranks"]) == 1


def test_sentence_pieces(docs, none):
    import sentencepiece

    from ravelin.llm.sentence_pieces import encode_digests, encode_texts

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    want = [(i, len(ids := lib.encode(t)), ",".join(map(str, ids)), lib.decode(ids)) for i, t in originals(docs)]
    assert rows(encode_texts(docs, tokenizer(PIECE_BPE))) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows(encode_digests(docs, tokenizer(PIECE_BPE))) == [(i, n, sha(a), sha(b)) for i, n, a, b in want]
    assert encode_texts(none, tokenizer(PIECE_BPE)).count() == 0


@pytest.mark.parametrize("change", ["user_defined", "unused", "unigram"])
def test_other_piece_models_are_refused(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    from ravelin.llm.sentence_pieces import load

    with open(tokenizer(PIECE_BPE), "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if change == "unigram":
        proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    else:
        piece = proto.pieces[-1]
        piece.type = piece.USER_DEFINED if change == "user_defined" else piece.UNUSED
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        load(str(path))


def test_sentence_pieces_of_random_strings():
    import sentencepiece

    from ravelin.llm.sentence_pieces import Encoder, model

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE)), Encoder(model(tokenizer(PIECE_BPE))), random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("aabtheingo ▁ \n.é漢字ß1\t") for _ in range(rng.randint(0, 40)))
        assert own.encode(t) == lib.encode(t) and own.decode(lib.encode(t)) == lib.decode(lib.encode(t))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from ravelin.llm.packing import pack

    lib = Tokenizer.from_file(tokenizer(WORD_BPE))
    pieces = pack(docs, tokenizer(WORD_BPE), window=64).collect()
    at = sorted((p.sequence_id * 64 + p.offset, p) for p in pieces)
    assert [a for a, _ in at] == [0, *itertools.accumulate(p.length for _, p in at)][:-1]
    assert all(p.offset + p.length <= 64 and p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length for p in pieces)
    got, now = [], b""
    for _, p in at:  # pieces of a text follow each other
        assert p.start * 4 == len(now)
        now += p.ids
        if len(now) == 4 * p.doc_tokens:
            got.append(((p.doc_id if p.doc_id is not None else -1), now))
            now = b""
    want = [(i, np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in originals(docs)]
    assert sorted(got) == sorted(want) and not now
    total = sum(len(b) // 4 for _, b in want)
    last = {p.padded_to for p in pieces if p.sequence_id == total // 64}
    assert {p.padded_to for p in pieces if p.sequence_id < total // 64} == {64} and (not last or last == {total % 64 if (total % 64).bit_count() == 1 else 64})
    assert pack(none, tokenizer(WORD_BPE)).count() == 0


def test_simhash(docs, none):
    import xxhash

    from ravelin.llm.simhash_trees import near_duplicates

    def print_of(t):
        w = t.encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, print_of(t)) for i, t in originals(docs)]
    known = {f for _, f in prints}
    group = {f: f for f in known}
    for a, b in itertools.combinations(sorted(known), 2):
        if (a ^ b).bit_count() <= 2:
            old, new = group[a], group[b]
            group = {f: new if g == old else g for f, g in group.items()}
    least = {}
    for i, f in prints:
        if i >= 0:
            least[group[f]] = min(least.get(group[f], i), i)
    got = [(i, f, -1 if c is None else c) for i, f, c in rows(near_duplicates(docs))]
    assert got == sorted((i, f"{f:016x}", least.get(group[f], -1)) for i, f in prints)
    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("shard", [20, 100, 5000])
def test_close_pairs_in_shards(spark, shard):
    from ravelin.llm.components import components
    from ravelin.llm.simhash_trees import close_pairs

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    points = {centre}
    for _ in range(700):
        points.add(rng.choice(sorted(points)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    points |= {rng.getrandbits(64) for _ in range(300)}
    points = sorted(points)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    found = {r.id: r.component for r in components(close_pairs(df, 2, shard=shard)).collect()}
    label = {signed(p): signed(p) for p in points}
    a = np.array(points, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 2
    own = np.array([signed(p) for p in points])
    while True:
        new = {int(o): min(label[int(x)] for x in own[n]) for o, n in zip(own, near)}
        if new == label:
            break
        label = new
    assert {k: v for k, v in label.items() if sum(x == v for x in label.values()) > 1} == found


def covered(items, length):
    """Brute force: bytes under strings that start earlier."""
    seen, out = set(), []
    for _, data in items:
        mask = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                mask[s : s + length] = b"\1" * length
            seen.add(w)
        out.append(mask)
    return out


@pytest.mark.parametrize("plain", [True, False])
def test_suffix_removal(docs, none, plain):
    from ravelin.llm.suffix_dedup import remove_repeats

    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if plain else docs
    items = [(i, t.encode()) for i, t in originals(df)]
    distinct = sorted(dict.fromkeys(items), key=lambda x: (x[0] < 0, x[0], x[1]))
    want = {}
    for (i, data), mask in zip(distinct, covered(distinct, 100)):
        kept = bytes(b for b, m in zip(data, mask) if not m)
        want[i, data] = (i, len(data), sum(mask), sum(1 for k, _ in itertools.groupby(mask) if k), hashlib.sha256(kept).hexdigest())
    assert rows(remove_repeats(df)) == sorted(want[x] for x in items)
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot,part_bytes", [(1, 1 << 30), (3, 500), (100_000, 500), (100_000, 1 << 30)])
def test_hot_passages(spark, hot, part_bytes):
    """Few and many partitions of minimizers, and hashes that are hot or not."""
    from ravelin.llm.suffix_dedup import repeated_spans

    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(260))
    items = [(k, ("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + line[: rng.randint(90, 260)] + str(k * 977)).encode()) for k in range(60)]
    got = [bytearray(len(d)) for _, d in items]
    for r in repeated_spans(spark.createDataFrame([(k, d.decode()) for k, d in items], "row long, text string"), hot=hot, part_bytes=part_bytes).collect():
        end = min(r.end, len(got[r.row]))
        got[r.row][r.start : end] = b"\1" * (end - r.start)
    assert got == covered(items, 100)


def test_suffix_array():
    from ravelin.llm.induced_sorting import permuted_common_prefixes, suffix_array

    rng = np.random.default_rng(0)
    for k in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 80)).astype(np.uint8)
        t = np.tile(t, 3) if k % 3 == 0 else t
        b = t.tobytes()
        sa = suffix_array(t)
        assert list(sa) == sorted(range(len(b)), key=lambda i: b[i:])
        p = permuted_common_prefixes(t, sa, 20)
        for x, y in zip(sa[1:], sa):
            n = next((n for n in range(20) if b[x + n : x + n + 1] != b[y + n : y + n + 1] or not b[x + n : x + n + 1]), 20)
            assert p[x] == n


VECS = "vec_id long, embedding array<float>, label int, point long, weight int, rank int"


def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 8))
    out = []
    for k in range(600):
        v = base[k % 30] + rng.standard_normal(8) * (0.12 if k % 3 else 1.0)
        out.append((k, [float(np.float32(x)) for x in v], int(k % 30 % 3)))
    out += [(600 + k, out[1][1], 1) for k in range(25)] + [(700, [2 * x for x in out[1][1]], 1), (800, out[1][1], None)]
    bad = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [1.0] * 3, []]
    out += [(900 + k, v, 1) for k, v in enumerate(bad)] + [(1000, None, None), (None, out[1][1], 1)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in out], VECS).repartition(3), out


def test_projection_forest(spark):
    from ravelin.llm.projection_forest import near_duplicates

    df, out = vectors(spark)
    got = {r.vec_id: r for r in near_duplicates(df, leaf=64, block=60).collect()}
    good = [(i, np.array(v, float), y) for i, v, y in out if i is not None and i < 900 and y is not None]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    y = np.array([y for *_, y in good])
    near = (x @ x.T >= 0.93) & (y[:, None] == y)
    np.fill_diagonal(near, False)
    links = sum(got[i].n_links for i, *_ in good)
    assert links >= 0.97 * near.sum() and all(got[i].n_links <= n for (i, *_), n in zip(good, near.sum(1)))
    assert len(got) == len(out) and all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (800, 900, 903, 906, 1000))
    assert got[None].n_links == 0 and got[610].component_id == got[1].component_id and all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)
    assert near_duplicates(df.limit(0)).count() == 0


def test_projection_forest_at_depth(spark):
    """Pairs just above the threshold in trees of nine levels and more, a hot label, and levels below the sample's nodes."""
    from ravelin.llm.projection_forest import near_duplicates

    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(rng.standard_normal((3000, 64)))
    way = unit(rng.standard_normal((3000, 64)))
    way = unit(way - (way * a).sum(1)[:, None] * a)
    c = rng.uniform(0.925, 0.95, (3000, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * way]).astype(np.float32)
    label = np.where(np.arange(3000) % 3, 0, np.arange(3000) % 7)
    df = spark.createDataFrame([(k, v.tolist(), int(l)) for k, (v, l) in enumerate(zip(x, np.tile(label, 2)))], "vec_id long, embedding array<float>, label int")
    x = unit(x.astype(float))
    want = {k for k in range(3000) if x[k] @ x[k + 3000] >= 0.93}
    for more in ({"leaf": 12}, {"leaf": 12, "sample_size": 300}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, **more).collect()}
        found = {k for k in range(3000) if got[k + 3000][1] == k}
        assert len(got) == 6000 and found <= want and len(found) >= 0.98 * len(want) and all((got[k][0] == 1) == (k in found) for k in range(3000))


def test_hilbert_search(spark):
    from ravelin.llm.hilbert_search import hilbert_keys, search

    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()
    df, out = vectors(spark)
    good = [(i, np.array(v, float)) for i, v, _ in out if i is not None and i < 900]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    got = {}
    for r in search(df, block=128, least_window=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and np.allclose([d[ids == v][0] for _, v, _ in found], [s for *_, s in found])
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(ids[best]))
    assert hit >= 0.95 * 10 * len(got)
    assert search(df.limit(0)).count() == 0 and search(df.where("vec_id = 100")).count() == 0 and search(df.where("vec_id in (100, 101)")).count() == 1


def test_hilbert_search_in_windows(spark):
    """Recall where windows leave most of the table out, in spite of a row a thousand times as far as the others."""
    from ravelin.llm.hilbert_search import search

    rng = np.random.default_rng(9)
    x = (rng.standard_normal((200, 32))[rng.integers(0, 200, 6000)] + 0.25 * rng.standard_normal((6000, 32))).astype(np.float32)
    x[5] *= 1000
    x[7] = x[8]
    got = {}
    for r in search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), curves=12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x, hit = x.astype(float), 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len({v for _, v in got[q]} & set(np.lexsort((np.arange(6000), d))[:10].tolist()))
    assert len(got) == 60 and all(len(v) == 10 for v in got.values()) and hit >= 0.9 * 600


def test_style_trees(spark):
    from ravelin.llm.style_trees import main_text

    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/a">A</a><li>B</ul></nav><div class="ad">Buy</div><!-- <article>no</article> --><article><h1>Head &amp; more</h1><p><b>One\n two<br>three<p>Fo<i>ur</i></p><aside>side</aside><div class="cookie-notice">ok?</div><form>f</form><section id="comments">c</section></article><footer>&copy; x</footer>'
    want = "Head & more One two three Four"
    no_main = "<body><div class='header'>H</div><div><p>Text {} here</p></div><div class='box'>Same on all</div></body>"
    rows_ = [(1, "http://a.example/1", page, "x"), (2, None, page, "x"), (3, "http://a.example/2", None, "x"), (4, "http://a.example/3", "", "x"), (None, "u", page, "x"), (1, "http://a.example/1", page, "x"), (5, "http://b/", "plain <b>text", "x")]
    rows_ += [(100 + k, f"http://c.example/{k}", no_main.format(k), "x") for k in range(12)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string, text string")
    for sent in (500_000, 0):
        got = {(r.page_id, r.url): (r.text, r.n_chars) for r in main_text(df, most_sent=sent).collect()}
        assert got[1, "http://a.example/1"] == got[2, None] == got[None, "u"] == (want, len(want))
        assert got[3, "http://a.example/2"] == got[4, "http://a.example/3"] == ("", 0) and got[5, "http://b/"] == ("plain text", 10)
        assert all(got[100 + k, f"http://c.example/{k}"][0] == f"Text {k} here" for k in range(12))
    assert main_text(df).count() == len(rows_) and main_text(df.limit(0)).count() == 0


def test_style_trees_inside_and_beside_main_elements(spark):
    from ravelin.llm.style_trees import main_text

    words = [f"w{k} of page {k} says {k * k} and more" for k in range(40)]
    inner = "<body><article><h1>Title {0}</h1><p>{0}</p><div class='x'>Same in every article</div></article></body>"
    teaser = "<body><article><p>Short {0}</p></article><div><p>Whole body of {0}</p><p>goes on here</p></div><div><a href='/'>more from here and there</a></div></body>"
    rows_ = [(k, f"http://in.example/{k}", inner.format(w)) for k, w in enumerate(words)] + [(100 + k, f"http://teaser.example/{k}", teaser.format(w)) for k, w in enumerate(words)]
    rows_ += [(200, "http://one.example/", teaser.format(words[0])), (201, "http://two.example/", inner.format(words[0]))]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string")
    for sent in (500_000, 0):
        got = {r.page_id: r.text for r in main_text(df, most_sent=sent).collect()}
        for k, w in enumerate(words):
            assert got[k] == f"Title {w} {w}" and got[100 + k] == f"Short {w} Whole body of {w} goes on here"
        assert got[200] == got[100] and got[201] == f"{got[0]} Same in every article"


def test_style_trees_on_copies(spark):
    from ravelin.llm.style_trees import main_text

    page = "<html><body><div><p>Text {} here</p></div><div class='box'>Same on all</div></body></html>"
    rows_ = [(k, "http://c.example/", page.format(0)) for k in range(90)] + [(100 + k, "http://c.example/", page.format(k + 1)) for k in range(10)]
    rows_ += [(200 + k, None, "<body><div>Only page</div></body>") for k in range(30)] + [(300, "http://d.example/", page.format(0))]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string").repartition(5)
    for sent in (500_000, 0):
        got = {r.page_id: r.text for r in main_text(df, most_sent=sent).collect()}
        assert all(got[k] == "Text 0 here" for k in range(90)) and all(got[100 + k] == f"Text {k + 1} here" for k in range(10))
        assert all(got[200 + k] == "Only page" for k in range(30)) and got[300] == "Text 0 here Same on all"


def test_maxent_lm(docs, none):
    from ravelin.llm.maxent_lm import score

    split = [(i, t, zlib.crc32(str(i).encode()) % 7 == 2 if i >= 0 else False, [*t.encode().lower().split(), None]) for i, t in originals(docs)]
    c = Counter(w for _, _, held, ws in split if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, _, held, ws in split]
    got = rows(score(docs, head=5, fitted_words=20))
    assert [g[:5] for g in sorted(got)] == [w[:5] for w in sorted(want)] and np.allclose(sorted(g[5] for g in got), sorted(w[5] for w in want))
    assert all(np.isfinite(g[6]) and g[6] < 0 for g in got)
    assert score(none).count() == 0


def slow_scores(items, spell, slots, rates, rows, prior=60.0):
    """The model over again, a token at a time: (chain of log10 of group, class and slot, class and slot of each token) of each text."""
    import xxhash

    from ravelin.llm import maxent_lm as m

    mask, log = 0xFFFFFFFF, np.log
    start = m.CLASSES << m.CLASS
    texts = []
    for held, words in items:
        numbers = [xxhash.xxh32_intdigest(w) & 0xFFFFF | slots.get(w, 7) << 20 | int(spell.of([w])[0]) << 23 for w in words]
        tokens = []
        for i, x in enumerate(numbers):
            one, two, three = (numbers[i - d] if i >= d else start for d in (1, 2, 3))
            near = Counter(y >> 26 for y in numbers[max(0, i - 12) : i]).most_common()
            near.sort(key=lambda v: (-v[1], v[0]))
            both = (near[1][0] if len(near) > 1 else 8) + 9 * (near[0][0] if near else 8)
            keys = (one, one * 0x85EBCA6B & mask ^ two, ((one >> 23) * 131 + (two >> 23)) * 131 + (three >> 23), two, both)
            context = [(k + 0x9E3779B1 * (t + 1)) * 0xC2B2AE35 & mask for t, k in enumerate(keys)]
            k, slot = x >> 23, x >> 20 & 7
            steps = []
            for level, (target, parent) in enumerate(((k // 8, 0), (k % 8, k // 8), (slot, k))):
                at = [(((c ^ c >> 15) ^ parent * 0x9E3779B1 + level & mask) * 0x85EBCA6B & mask) >> 33 - rows.bit_length() for c in context]
                steps.append((level, target, parent, at))
            tokens.append(steps)
        texts.append((held, tokens, numbers))
    return texts


def test_maxent_scores_against_slow_model(spark):
    """Every part of a score by loops over tokens and dictionaries; and the model beats the counts on held-out texts."""
    from ravelin.llm import maxent_lm as m

    rng = random.Random(11)
    tongues = [["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(60)] for a in ("aeioublt", "kzwxyqnr")]
    items = []
    for k in range(220):
        own = tongues[k % 2]
        items.append((k, " ".join(own[int(rng.random() ** 2 * 60)] for _ in range(rng.randint(0, 60)))))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in m.score(df, fitted_words=40).collect()}
    split = [(zlib.crc32(str(i).encode()) % 7 == 2, [*t.encode().split(), m.END]) for i, t in items]
    c = Counter(w for held, ws in split if not held for w in ws)
    order = sorted((w for w in c if w != m.END), key=lambda w: (-c[w], w))[:40]
    spell = m.Classes(order, np.log1p(np.array([c[w] for w in order], float)))
    slots, taken = {}, Counter()
    for w in [m.END, *order]:
        k = int(spell.of([w])[0])
        if taken[k] < 7:
            slots[w] = taken[k]
            taken[k] += 1
    place = lambda w: int(spell.of([w])[0]) * 8 + slots.get(w, 7)
    mass = np.array([float(k % 8 == 7) for k in range(512)])
    for w, n in c.items():
        mass[place(w)] += n + 1
    cells = (mass + 0.01).reshape(8, 8, 8)
    unit = lambda x: x / x.sum(1, keepdims=True)
    priors = [unit(cells.sum((1, 2))[None]), unit(cells.sum(2)), unit(cells.reshape(64, 8))]
    rows = m.rows_for(sum(c.values()))
    texts = slow_scores(split, spell, slots, (0.5, 0.5), rows)
    weights: dict = {}

    def chances(level, parent, at):
        s = np.log(priors[level][parent]) + sum(weights.get((level, t, r), 0) for t, r in enumerate(at))
        return np.exp(s) / np.exp(s).sum()

    seen: dict = {}
    for held, tokens, _ in texts:
        for level, target, _, at in (s for token in tokens for s in token if not held):
            for t, r in enumerate(at):
                seen.setdefault((level, t, r), np.zeros(8))[target] += 1
    for rate in (0.5, 0.5):
        expected: dict = {}
        for held, tokens, _ in texts:
            for level, _, parent, at in (s for token in tokens for s in token if not held):
                p = chances(level, parent, at)
                for t, r in enumerate(at):
                    expected[level, t, r] = expected.get((level, t, r), 0) + p
        new = dict(weights)
        for f, e in expected.items():
            more = 60 * e / e.sum()
            new[f] = weights.get(f, 0) + np.clip(rate * np.log((seen[f] + more + 1e-9) / (e + more + 1e-9)), -4, 4)
        weights = new
    for (i, _), (_, words), (_, tokens, _) in zip(items, split, texts):
        want = sum(np.log10(chances(level, parent, at)[target]) for token in tokens for level, target, parent, at in token)
        want += sum(np.log10(c[w] + 1) - np.log10(max(mass[place(w)], 1)) for w in words)
        assert abs(want - got[i].score) < 1e-3 * max(1, abs(want)), (i, want, got[i].score)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) > 0.1 * sum(r.n_tokens for r in held)
    again = {r.doc_id: r.score for r in m.score(df.repartition(2), fitted_words=40).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-3 for i in again)


def test_quality_crf(spark, docs, none):
    from ravelin.llm.quality_crf import marginals, score_quality

    rng = np.random.default_rng(0)
    sizes, score, turn = np.array([3, 1, 4]), rng.standard_normal(8), np.array([[0.0, 0.4], [-0.3, 0.8]])
    good, log_z, _ = marginals(score, sizes, turn)
    at = 0
    for k, n in enumerate(sizes):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(score[at + i] for i in range(n) if y[i]) + sum(turn[y[i], y[i + 1]] for i in range(n - 1))) for y in paths])
        assert np.isclose(log_z[k], np.log(w.sum())) and np.allclose(good[at : at + n], (w[:, None] * np.array(paths)).sum(0) / w.sum())
        at += n
    pick = random.Random(1)
    pairs = [(k, "\n".join(" ".join(pick.choice("the of and river stone house light".split()) for _ in range(12)) + "." for _ in range(3)) if k % 2 else "\n".join(pick.choice(("BUY!! NOW!! ", "win win win ")) * 8 for _ in range(3))) for k in range(300)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in pairs] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(df, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    edge = score_quality(docs, labels, carry=("row", "fp")).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 and r["row"] == "r" for r in edge)
    assert score_quality(none, labels).count() == 0 and {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_components(spark):
    from ravelin.llm.components import components

    chain = [(k, k + 1) for k in range(200, 260)] + [(1, 5), (5, 1), (7, 7), (None, 3), (9, 5)] + [(50, k) for k in range(51, 90)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 200 for k in range(200, 261)} | {1: 1, 5: 1, 9: 1} | {k: 50 for k in range(50, 90)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs_
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, kept, sf)
        after.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert after.columns == docs_.columns and 0 < after.count() <= kept.count()
        kept = after if k < 3 else kept
    assert after.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in after.dropDuplicates(["doc_id"]).collect())


def test_pipeline_near_copies(spark):
    from corpus_pipeline import near_copies

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, own = [[word() for _ in range(200)] for _ in range(30)], []
    for k, b in enumerate(base):
        own.append((k, b))
        for j in range(4):  # one to four words of 200: five shingles each, similarity 0.81 or more
            t = list(b)
            for at in rng.sample(range(10, 190, 10), j + 1):
                t[at] = word()
            own.append((1000 + 10 * k + j, t))
        own.append((2000 + k, [w if i % 12 else word() for i, w in enumerate(b)]))  # far below 0.8
    hub = [word() for _ in range(300)]
    own += [(5000 + k, [*hub[:k], word(), *hub[k + 1 :]]) for k in range(300)]  # a large group, any two of it near
    rows_ = [(i, " ".join(t), "en", "s", 1) for i, t in own] + [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9002, "two words", "en", "s", 1), (9003, "Two  WORDS", "en", "s", 1)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in own}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same) and label[a] != label[b]:
            label = {i: min(label[a], label[b]) if c in (label[a], label[b]) else c for i, c in label.items()}
    got = sorted(r.doc_id for r in near_copies(spark, df, "").collect())
    assert got == sorted({*label.values(), 9000, 9002}) and len(got) < 70
    assert near_copies(spark, df.limit(0), "").count() == 0


def test_components_joined_in_tasks(spark):
    from ravelin.llm.components import components

    rng = random.Random(4)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000), (2001, None), (5, -9), (5, -9)]
    label: dict[int, int] = {}
    for a, b in edges:
        if b is not None and a != b:
            low, high = sorted((label.setdefault(a, a), label.setdefault(b, b)))
            label = {i: low if c == high else c for i, c in label.items()}
    df = spark.createDataFrame(edges, "a long, b long")
    for parts, block in ((5, 1), (1, 50), (7, 150), (7, 1000)):
        got = [tuple(r) for r in components(df.repartition(parts), block=block).select("id", "component").collect()]
        assert len(got) == len(label) and dict(got) == label, (parts, block)
    assert components(df.limit(0), block=10).count() == 0


def test_similar_texts_of_one_large_group_take_few_stages_and_rows(spark):
    from ravelin.llm.simhash_trees import similar_texts

    rng = random.Random(3)
    base, own = [f"w{k}" for k in range(120)], []
    for i in range(400):  # alike, nearly no pair at 0.8
        t = list(base)
        for at in rng.sample(range(120), 8):
            t[at] = f"x{rng.randrange(4000)}"
        own.append((i, " ".join(t)))
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
    sc, store = spark.sparkContext, spark._jsparkSession.sharedState().statusStore()
    got, stages = {}, {}
    for joined in (200_000, 30):
        seen = store.executionsCount()
        sc.setJobGroup(f"joined in {joined}", "")
        got[joined] = {r.doc_id: r.component_id for r in similar_texts(df, block=20, joined=joined).collect()}
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker = sc.statusTracker()
        stages[joined] = sum(len(tracker.getJobInfo(k).stageIds) for k in tracker.getJobIdsForGroup(f"joined in {joined}"))
        rows = [0]
        for k in range(seen, store.executionsCount()):
            run = store.executionsList().apply(k)
            values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
            for node in (nodes.apply(n) for n in range(nodes.size()) if "FlatMapGroupsInArrow" in nodes.apply(n).name()):
                for m in (node.metrics().apply(n) for n in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        rows.append(int(values.apply(m.accumulatorId()).replace(",", "")))
        assert 1000 < max(rows) < 12_000, max(rows)  # 21,490 with a row for each point and block in each tree
    sc._jsc.clearJobGroup()
    assert got[30] == got[200_000] and stages[200_000] < 150 and stages[200_000] < stages[30]


def test_similar_texts_in_a_group_around_the_threshold(spark):
    from ravelin.llm.simhash_trees import shared_counts, similar_texts

    rng = random.Random(9)
    base, own = [f"w{k}" for k in range(120)], []
    for i in range(300):  # alike, most pairs below 0.8, some above
        t = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
            t[at] = f"x{rng.randrange(40)}"
        own.append((i, t))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in own], "doc_id long, text string").repartition(5)
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in own}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    for block in (20, 500):
        assert {r.doc_id: r.component_id for r in similar_texts(df, block=block).collect()} == label
    assert len(set(label.values())) > 20

    numbers = np.random.default_rng(1)
    some = [np.unique(numbers.integers(0, 900, n)).astype(np.uint64) for n in (1, 40, 300, 500, 700)]
    i, j = np.triu_indices(5, 1)
    want = [len(np.intersect1d(some[a], some[b])) for a, b in zip(i, j)]
    assert shared_counts(some, i, j).tolist() == shared_counts(some, i, j, 64).tolist() == want and shared_counts(some, i[:3], j[:3]).tolist() == want[:3]


def test_pipeline_keeps_texts_that_share_an_id(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows_ = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, b + " more", "en", "s", 1), (3, c, "en", "s", 1), (4, c, "en", "s", 1), (4, a, "en", "s", 1)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, df, "").collect()) == [(1, a), (1, b), (3, c)]


def test_pipeline_writes_between_stages(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    stage = lambda s, docs, _: seen.append(len(docs.inputFiles())) or docs.selectExpr("doc_id + 1 AS doc_id")
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, *_: s.range(3).withColumnRenamed("id", "doc_id"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage) for k in range(4)])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, "").collect()) == [4, 5, 6] and seen[0] == 0 and all(seen[1:])
