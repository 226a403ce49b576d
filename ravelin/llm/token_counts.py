"""Token counts by the whole-token shortcut.

A byte-level BPE vocabulary is examined once, offline: a vocabulary string is *proven* when running the merge rules on
its bytes ends in that one token. A text is cut into pre-tokens; a proven pre-token counts one, and only the rest is merged.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import WHITE, Memo, by_row, shared

#: The pre-tokenizer's pattern (fixed values), with \s written out as Unicode White_Space.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Pieces that can be cut apart before pre-tokenizing: no pre-token holds a white-space character after another one.
PIECE = rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merge of lowest rank, leftmost first, until none applies."""
    never, get = len(ranks), ranks.get
    costs = [get(p, never) for p in zip(parts, parts[1:])]
    while costs and (least := min(costs)) < never:
        i = costs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = get((parts[i], parts[i + 1]), never)
        if i:
            costs[i - 1] = get((parts[i - 1], parts[i]), never)
    return parts


def merge_long(text: str, ranks: dict[tuple[str, str], int]) -> int:
    """Number of parts after all merges, by a heap: for very long pre-tokens."""
    import heapq

    part, nxt, prv = list(text), [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(text, text[1:])) if p in ranks]
    heapq.heapify(heap)
    left = len(part)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if part[i] is not None else -1
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        left -= 1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y >= 0 and (part[x], part[y]) in ranks:
                heapq.heappush(heap, (ranks[part[x], part[y]], x, part[x], part[y]))
    return left


def is_plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the pattern above, no normalizer and no rule that looks beyond a pre-token."""
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec["added_tokens"]
    split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    merges = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return split and merges and not spec.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(WHITE) for t in added)


def load(path: str) -> dict:
    """Merge ranks, the proven strings and the special strings of a byte-level BPE file; its size is the vocabulary's."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not is_plain_byte_level(spec):
        raise ValueError("only byte-level BPE files without normalizer, prefix space or options of added tokens are handled")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ranks = {p: k for k, p in enumerate(pairs)}
    special = [t["content"] for t in spec["added_tokens"]]
    whole = {v for v in spec["model"]["vocab"] if v not in special and len(merge(list(v), ranks)) == 1}
    return {"ranks": ranks, "whole": whole, "special": special}


class Counter:
    """Counts tokens of one text; remembers pieces."""

    def __init__(self, model: dict):
        self.ranks, self.whole, self.special = model["ranks"], model["whole"], model["special"]
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.pieces, self.pre = regex.compile(PIECE).findall, regex.compile(PRE_TOKEN).findall
        self.memo = Memo(1_000_000, lambda piece: sum(map(self.words.__getitem__, self.pre(piece))))
        self.words = Memo(500_000, self.pre_token)
        self.stops = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def pre_token(self, token: str) -> int:
        self.words.room()
        shown = token.encode().decode("latin-1").translate(self.letters)
        if shown in self.whole:
            return 1
        return len(merge(list(shown), self.ranks)) if len(shown) < 64 else merge_long(shown, self.ranks)

    def __call__(self, text: str) -> int:
        self.memo.room()
        parts = self.stops.split(text) if self.stops else [text]
        return sum(sum(map(self.memo.__getitem__, self.pieces(part))) for part in parts) + len(parts) - 1


_models: dict[str, dict] = {}


def model(path: str) -> dict:
    if path not in _models:
        _models[path] = load(path)
    return _models[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text, as the byte-level BPE file at ``path`` gives them without added special tokens.

    Strings equal to a special token count as that one token. A null or empty text has 0 bytes and 0 tokens; repeated
    rows give repeated results; a null id stays null; other columns of ``docs`` are left out. No row moves: the job is
    one pass over the scan. The tables sent to the tasks are the vocabulary's, whatever the input.
    """
    held = docs.sparkSession.sparkContext.broadcast(model(path))

    def make():
        count = shared("counter", path, lambda: Counter(held.value))
        return lambda row: [(row[0], len((row[1] or "").encode()), count(row[1] or ""))]

    kind = docs.schema[id_column].dataType.simpleString()
    source: list[Column] = [F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")]
    out = by_row(docs.select(*source), ["doc_id", "text"], f"doc_id {kind}, n_bytes long, n_tokens long", make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
