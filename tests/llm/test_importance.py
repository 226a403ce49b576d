"""Importance of nodes against loops over parsed pages, the tree without lists of roles, and pages of great depth and length."""

import math
import random
import time
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict

import pytest

from ravelin.llm import style_trees as st


def made(seed=3, hosts=3, pages=14):
    """Well-formed pages of a few hosts: an article of many paragraphs, menus, a footer of half constant words; some copies."""
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = []
    for h in range(hosts):
        for k in range(pages):
            body = "".join(rng.choice(("<p>{}</p>", "<ul><li>{}</li><li>x</li></ul>", "<h2>{}</h2>", "<div class='q'>{}</div>")).format(some(12)) for _ in range(rng.randint(2, 9)))
            out.append((f"h{h}.example", f"<html><body><div class='top'><ul><li>Home {h}</li><li>{some(1)}</li></ul></div><div class='text'>{body}</div><div class='end'>Company of {h} all rights are kept here {some(3)}</div></body></html>"))
    return out + out[:5] + [("one.example", out[0][1]), ("empty.example", "")]


def slow_importance(pages, prior=2.0):
    """(host, name) -> (words, whole, style, speech), by loops; pages without main elements."""
    found = {}
    for host in {h for h, _ in pages}:
        style, content, words, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
        for page in {p for h, p in pages if h == host and p}:
            mine = defaultdict(set)

            def look(node, parent, section, style=style, content=content, mine=mine):
                name = st.hashed(f"{parent}/{node.tag}" + (f".{node.get('class')}" if node.get("class") else ""))
                if node.tag in ("div", "ul"):
                    section = name
                    mine[section] |= set()
                if section and node.text:
                    mine[section] |= set(node.text.split())
                for child in node:
                    look(child, name, section)
                if node.tag not in ("html", "body"):
                    mine[name] |= set()
                    style[name][tuple(c.tag for c in node)] += 1
                    content[name][tuple(t.strip() for t in node.itertext())] += 1

            look(ET.fromstring(page), st.hashed(host), None)
            for name, w in mine.items():
                held[name] += 1
                words[name].update(w)
        for name, m in held.items():
            entropy = lambda c: -sum(n / c.total() * math.log(n / c.total(), c.total()) for n in c.values()) if c.total() > 1 else 1.0
            draw = lambda x, m=m: (m * x + prior) / (m + prior)
            total = words[name].total()
            speech = (1 - sum(n * math.log(n) for n in words[name].values()) / total / math.log(m) if m > 1 else 1.0) if total else None
            found[st.hashed(host), name] = (total, draw(max(entropy(style[name]), entropy(content[name]))), draw(entropy(style[name])), speech if speech is None else draw(speech))
    return found


def table(spark, pages):
    return spark.createDataFrame([(k, f"http://{h}/{k}", p, h, "x") for k, (h, p) in enumerate(pages)], "page_id long, url string, html string, host string, name string").repartition(4)


def test_importance_against_loops(spark):
    pages = made()
    got = {(r.host, r.name): (r.words, r.whole, r.style, r.speech) for r in st.importance_of(table(spark, pages)).collect()}
    want = slow_importance(pages)
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key] == pytest.approx(w), key
    low = set()
    for host in {h for h, _ in want}:
        own = {n: w for (h, n), w in want.items() if h == host}
        mean = lambda w: (w[2] + w[3]) / 2
        top = max((w for w in own.values() if w[0]), key=lambda w: (w[0], mean(w), w[3]))
        low |= {n for n, w in own.items() if w[1] < 0.2 or w[3] is not None and mean(w) < 0.6 * mean(top) and w[3] < 0.9 * top[3]}
    assert {r.name for r in st.low_nodes(table(spark, pages)).collect()} == low and low


def test_footers_of_half_constant_words_go_by_importance_alone(spark):
    pages = made()
    got = {r.page_id: r.text for r in st.main_text(table(spark, pages)).collect()}
    for k, (host, page) in enumerate(pages):
        if host in ("one.example", "empty.example"):
            assert ("Company of" in got[k]) == (host == "one.example")  # one page alone tells nothing
            continue
        text = ET.fromstring(page).find("body/div[@class='text']")
        assert "Company of" not in got[k] and " ".join(" ".join(text.itertext()).split()) in got[k]


def test_tree_alone_on_the_given_pages(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", st.host_of("url"))
    low = frozenset(r.name for r in st.low_nodes(pages).collect())
    rows, seen = pages.collect(), Counter(r.host for r in pages.select("host").collect())
    with_lists = [" ".join(st.walk(r.html or "", r.host, low)[0]) for r in rows]
    for name in ("OTHER", "NEVER", "MAIN"):
        monkeypatch.setattr(st, name, frozenset())
    footers = kept = 0
    for r, article in zip(rows, with_lists):
        alone, plain = (" ".join(st.walk(r.html or "", r.host, names)[0]) for names in (low, frozenset()))
        assert article in alone  # nothing of an article goes
        if seen[r.host] >= 9:
            footers += 1
            kept += plain[-30:] == alone[-30:]
    assert footers > 20 and kept < footers / 2


def test_deep_and_long_pages(spark):
    n = 40_000
    deep = ["<div><b>" * n + "text", "<p><table><tr><td>" + "<i><ul>" * n + "text", "<ul>" + "<b><li></li>" * n + "text", "<nav>" + "<div>" * n + "<main>text", "<article><p>" + "word " * 500_000]
    start = time.time()
    texts = [" ".join(st.walk(p, "h", count=True)[0]) for p in deep]
    assert time.time() - start < 60
    assert [t[:4] for t in texts] == ["text"] * 4 + ["word"] and len(texts[4]) == 5 * 500_000 - 1
    df = spark.createDataFrame([(k, "http://deep.example/", p, "deep.example") for k, p in enumerate(deep)], "page_id long, url string, html string, host string")
    assert {r.page_id: r.text for r in st.main_text(df).collect()} == dict(enumerate(texts))
