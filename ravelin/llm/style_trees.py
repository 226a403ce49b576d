"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of nodes named by their path of tags and classes. A node matters if what it
holds varies over the pages: its presentation (the sequence of its children's tags), its content as a whole, and the words of its content.
Entropies over the host's pages, in shares of the most they could be, give each node's importance; branches of low importance go, inside main
elements too, as do branches whose tag or class names a role that is never the article. A section outside main elements is measured by its words:
the more pages a word stands on in the section, the less it says. Each distinct page of a host counts once, and importance is drawn
towards one where few pages hold a node. Being in a main element speaks for a branch; a branch outside stays if it holds enough prose.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import cut, ready

#: Attributes, quoted or not; an unquoted "<" ends an unfinished tag, which keeps broken pages linear.
INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noembed|noframes|xmp)\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)({INSIDE})>|<[/!?][^<>]*>|[^<]+|<""", re.S | re.I)
ROLE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements without content, elements that begin and end a block, and elements that are never the article (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form head menu button select option dialog noscript template svg canvas audio video object map math input textarea".split())
MAIN = frozenset(("article", "main"))
#: Elements that begin a branch of text of their own; and those that are never of low importance as a whole (fixed values).
BRANCH = frozenset("html body div section article main td th center fieldset".split())
WHOLE = frozenset(("html", "body"))
#: Elements whose words are counted, and elements that a paragraph cannot span (fixed values).
SECTION = frozenset("div section article main td th center fieldset nav footer header aside form menu ul ol dl table".split())
FENCE = ("article", "main", "section", "div", "td", "th", "table", "li", "body", "aside", "nav", "footer", "header", "form")
#: Words in a class, id or role that name such a part (fixed values).
OTHER = frozenset("ad ads adv advert advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget related recommended share sharing social newsletter subscribe subscription signup cookie cookies consent gdpr notice alert popup modal overlay comment comments respond disqus discussion replies form search login pagination pager toolbar skip".split())
#: What an opening tag closes if it is open (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79


def hashed(text: str) -> int:
    """61 bits, which fit a long and the sums below."""
    return xxhash.xxh64_intdigest(text) >> 3


class Node:
    """An open element; ``path`` is a hash of its host and of the tags and classes down to it."""

    __slots__ = ("tag", "path", "main", "other", "low", "link", "branch", "start", "children", "words")

    def __init__(self, tag: str, path: int, main: bool, other: bool, low: bool, link: bool, branch: int, start: int, words: set[str] | None):
        self.tag, self.path, self.main, self.other, self.low, self.link, self.branch, self.start, self.children, self.words = tag, path, main, other, low, link, branch, start, [], words


def named_other(attributes: str, main: bool) -> tuple[str, bool]:
    """The class as it goes into a path, and whether the attributes name a part that is never the article.

    Inside a main element a header is the article's own.
    """
    name, other, words = "", False, OTHER - {"header", "masthead"} if main else OTHER
    for key, a, b, c in ROLE.findall(attributes):
        value = (a or b or c).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            other = True
        elif key in ("class", "id", "role"):
            if key == "class":
                name = "." + ".".join(sorted(value.split()))
            other = other or not words.isdisjoint(re.split(r"[\s_\-]+", value))
    return name, other


def walk(page: str, host: str, low: frozenset[int] = frozenset(), count: bool = False):
    """Read a page: its kept blocks and its nodes (name, presentation, content, whether in a main element, words).

    A word belongs to the innermost section around it; words are listed only if ``count`` is set. Time is linear in the page, however deep it nests.
    """
    root = Node("", hashed(host), False, False, False, False, 0, 0, None)
    stack, nodes, branches = [root], [], 0
    sums = [0]  # hashes of all texts up to each, so that a node's content has one in no time
    open_: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    blocks: list[tuple[str, int, bool, bool, int]] = []
    now: list[str] = []
    where, linked = (False, False, 0), 0

    def flush() -> None:
        nonlocal linked
        if now:
            line = " ".join("".join(now).split())
            if line:
                blocks.append((line, min(linked, len(line)), *where))
            now.clear()
        linked = 0

    def close() -> None:
        node = stack.pop()
        open_[node.tag].pop()
        if node.tag in BLOCK:
            flush()
            content = (sums[-1] - sums[node.start] * pow(BASE, len(sums) - 1 - node.start, PRIME)) % PRIME
            if node.tag not in WHOLE:
                nodes.append((node.path, hashed(",".join(node.children)), content, node.main, node.words if count and node.tag in SECTION else ()))

    def last(tags: Iterable[str]) -> int:
        """The place of the innermost open element of these."""
        return max((open_[t][-1] for t in tags if open_[t]), default=0)

    for m in TOKEN.finditer(page):
        slash, tag = m.group(2), m.group(3)
        if tag is None:
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                text = html.unescape(raw)
                top = stack[-1]
                if text.strip():
                    sums.append((sums[-1] * BASE + hashed(text.strip())) % PRIME)
                    if count and top.words is not None:
                        top.words.update(text.split())
                if not top.other:
                    if where != (top.main, top.low, top.branch):
                        flush()
                        where = (top.main, top.low, top.branch)
                    now.append(text)
                    linked += len(text.strip()) if top.link else 0
            continue
        tag = tag.lower()
        if slash:
            if open_[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag != "br":
                while open_["p"] and last(("p",)) > last(FENCE):
                    close()
        if tag in MAIN:
            while any(open_[t] and not stack[open_[t][0]].main for t in ("nav", "header")):  # left open
                close()
        if tag in CLOSES:
            while (k := last(CLOSES[tag])) and k > last(FENCES.get(tag, ())):
                while len(stack) > k:
                    close()
        parent = stack[-1]
        if tag in BLOCK:
            parent.children.append(tag)
        if tag in VOID:
            continue
        name, other = named_other(m.group(4), parent.main) if m.group(4) else ("", False)
        path = hashed(f"{parent.path}/{tag}{name}") if tag in BLOCK else parent.path
        main = parent.main or tag in MAIN
        other = parent.other or other and tag not in ("html", "body") or tag in NEVER or tag == "header" and not main
        if m.group(4).rstrip().endswith("/") and tag not in BLOCK:
            continue
        open_[tag].append(len(stack))
        branches += tag in BRANCH
        words = set() if count and tag in SECTION else parent.words
        stack.append(Node(tag, path, main, other, parent.low or tag in BLOCK and path in low, parent.link or tag == "a", branches if tag in BRANCH else parent.branch, len(sums) - 1, words))
    while len(stack) > 1:
        close()
    flush()
    return chosen(blocks), nodes


def chosen(blocks: list[tuple[str, int, bool, bool, int]], prose: int = 100) -> list[str]:
    """Lines of a page's blocks (line, characters in links, in a main element, of low importance, branch).

    A page never goes whole: where all is of low importance, all stays. Where main elements hold text, a branch outside must have as
    many characters out of links as they do, or ``prose``, and fewer than a third in links.
    """
    kept = [b for b in blocks if not b[3]] or blocks
    inside = sum(len(line) - links for line, links, main, _, _ in kept if main)
    if not any(b[2] for b in kept):
        return [b[0] for b in kept]
    total: Counter = Counter()
    links_: Counter = Counter()
    for line, links, main, _, branch in kept:
        if not main:
            total[branch] += len(line)
            links_[branch] += links
    return [line for line, _, main, _, branch in kept if main or total[branch] - links_[branch] >= min(prose, inside) and 3 * links_[branch] < total[branch]]


def host_of(url: str) -> Column:
    """The host in a column of urls, in small letters; empty where there is none."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.\-]*:)?//([^/?#\s]*)", 1)
    return F.lower(F.regexp_replace(found, "^.*@", ""))


def node_counts(pages: DataFrame, most_sent: int = 500_000) -> DataFrame:
    """name, main, kind (0 presentation, 1 content, 2 host, 3 word), value, n: on how many pages a host's node had a value; added up in each task first.

    Each of a page's copies on its host counts for its share of one page. Values are hashes, those of words of 40 bits: most of the rows are words, and
    two words of a node in one number would shift its mean entropy by no more than their own share.
    """
    keyed = pages.select("host", "html", F.xxhash64("host", F.coalesce("html", F.lit(""))).alias("key"))
    copies = cut(keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"))
    if copies.count() <= most_sent:
        copies = F.broadcast(copies)
    once = keyed.join(copies, "key", "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            columns = zip(("name", "main", "kind", "value", "n"), (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.float64()), (*zip(*seen), seen.values()))
            out = pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, k, v in columns})
            seen.clear()
            return out

        for b in batches:
            for host, page, copies_ in zip(*(c.to_pylist() for c in b.columns)):
                nodes, part, site = walk(page or "", host, count=True)[1], 1 / copies_, hashed(host)
                for name, style, content, main, _ in nodes:
                    seen[name, main, 0, style] += part
                    seen[name, main, 1, content] += part
                held: defaultdict[tuple[int, bool], set[str]] = defaultdict(set)
                for name, _, _, main, words in nodes:
                    held[name, main].update(words)
                for (name, main), words in held.items():
                    seen[name, main, 2, site] += part
                    for word in words:
                        seen[name, main, 3, hashed(word) >> 21] += part
                if len(seen) > 200_000:
                    yield rows()
        if seen:
            yield rows()

    return once.mapInArrow(count, "name long, main boolean, kind int, value long, n double")


def importance_of(pages: DataFrame, prior: float = 2.0, most_sent: int = 500_000) -> DataFrame:
    """host, name, main, words, whole, style, speech of every node: one row each.

    ``style`` is the entropy of its presentation, ``whole`` the larger of that and of its contents' as wholes. ``speech`` is one less the mean of its
    words' entropies, log n over log m for a word on n of the m pages that hold the node, each word weighed by n; null without words. All are drawn to
    one by ``prior`` pages.
    """
    # Shares of copies add up to whole numbers.
    counts = node_counts(pages, most_sent).groupBy("name", "main", "kind", "value").agg(F.round(F.sum("n")).alias("n"))
    m, log = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    # Entropy over log m, the entropy of m different values; of words the mean log n.
    kinds = counts.groupBy("name", "main", "kind").agg(
        m.alias("m"), F.max("value").alias("value"), F.when(F.col("kind") == 3, log / m).otherwise(F.when(m > 1, (F.log(m) - log / m) / F.log(m)).otherwise(1.0)).alias("entropy")
    )
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    nodes = kinds.groupBy("name", "main").agg(
        of(2, "value").alias("host"), of(2, "m").alias("pages"), F.coalesce(of(3, "m"), F.lit(0.0)).alias("words"), F.max(F.when(F.col("kind") < 2, F.col("entropy"))).alias("whole"),
        of(0, "entropy").alias("style"), F.when(of(2, "m") > 1, 1 - of(3, "entropy") / F.log(of(2, "m"))).when(of(3, "m") > 0, 1.0).alias("speech"),
    )
    drawn = lambda c: ((F.col("pages") * F.col(c) + prior) / (F.col("pages") + prior)).alias(c)
    return nodes.select("host", "name", "main", "words", *map(drawn, ("whole", "style", "speech")))


def low_nodes(pages: DataFrame, least: float = 0.2, prior: float = 2.0, most_sent: int = 500_000, beside: float = 0.6, says: float = 0.9) -> DataFrame:
    """Names of nodes of low importance.

    Those whose presentation and whole content both vary less than ``least`` of what they could (three quarters of it in main elements); and, outside main
    elements, sections in which the mean of presentation and words is below ``beside`` of the same mean of the host's section of most words, and whose words alone are below ``says``
    of that section's. The section of most words (ties: of greatest mean) is never low by the second rule.
    """
    nodes = cut(importance_of(pages, prior, most_sent)).withColumn("mean", (F.col("style") + F.col("speech")) / 2)
    most = nodes.where("words > 0").groupBy("host").agg(F.max(F.struct("words", "mean", "speech")).alias("most"))
    by_words = ~F.col("main") & (F.col("mean") < beside * F.col("most.mean")) & (F.col("speech") < says * F.col("most.speech"))
    by_sameness = F.col("whole") < F.when(F.col("main"), 0.75 * least).otherwise(least)
    return nodes.join(most, "host", "left").where(by_sameness | F.coalesce(by_words, F.lit(False))).select("name").distinct()


def main_text(pages: DataFrame, least: float = 0.2, most_sent: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty pages have the empty text; repeated rows give repeated results; null ids and urls stay, and a null url is a
    host of its own; other columns are left out; very long and deeply nested pages are read whole; an empty table gives no rows. A page keeps its branches that are not of low importance: those in main elements, and
    those outside that hold enough prose, or all if no main element has text; if all are low, all stay. The set of low nodes goes to the tasks if it has ``most_sent`` members at most; beyond that each page is joined with its host's.
    """
    spark = ready(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    low = cut(low_nodes(rows, least, most_sent=most_sent))
    found = [r[0] for r in low.limit(most_sent + 1).collect()]
    kind = pages.schema["page_id"].dataType.simpleString()
    whole = f"page_id {kind}, url string, text string, n_chars long"
    if len(found) > most_sent:
        return _joined(rows, low, whole)
    held = spark.sparkContext.broadcast(frozenset(found))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [" ".join(walk(page or "", host, held.value)[0]) for page, host in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, whole)


def _joined(rows: DataFrame, low: DataFrame, whole: str) -> DataFrame:
    """With too many low nodes to send: each page's nodes meet the low ones by name, and the page gets those it has."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, host, page in zip(*(c.to_pylist() for c in b.columns)):
                own = list({n[0] for n in walk(page or "", host)[1]})
                if own:
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(own), "name": own})

    keyed = rows.withColumn("key", F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    own = keyed.select("key", "host", "html").mapInArrow(names, "key long, name long").distinct().join(low, "name")
    own = own.groupBy("key").agg(F.collect_list("name").alias("low"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, url, page, host, low_ in zip(*(c.to_pylist() for c in b.columns)):
                text = " ".join(walk(page or "", host, frozenset(low_ or ()))[0])
                yield pa.RecordBatch.from_arrays([pa.array([i], b.column(0).type), pa.array([url], pa.string()), pa.array([text], pa.string()), pa.array([len(text)], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return keyed.join(own, "key", "left").select("page_id", "url", "html", "host", "low").mapInArrow(extract, whole)
