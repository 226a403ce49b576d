"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A piece sequence is the merge result exactly when each piece merges back to itself and each neighbouring pair, merged
anew from its characters, ends in that pair. So the longest match at a position is tried first; if it is not compatible with its
left neighbour, shorter ones follow, and a bit field remembers positions from which no way on was found.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import Memo, by_row, shared

SPACE = "▁"
#: Piece kinds of the model file (fixed values).
NORMAL, BYTE = 1, 6
#: No piece holds the space mark after another character (checked in load), so texts are cut before runs of it.
CHUNK = f"{SPACE}*[^{SPACE}]+|{SPACE}+"


def load(path: str) -> dict:
    """Pieces, scores and byte ids of a BPE model with byte fallback; the size is the vocabulary's."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
        raise ValueError("only models with identity normalization and byte fallback are handled")
    if proto.trainer_spec.model_type != proto.trainer_spec.BPE or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces):
        raise ValueError("only BPE models without user-defined or unused pieces are handled")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds the space mark after another character")
    to_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
    dummy = proto.normalizer_spec.add_dummy_prefix
    inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
    stable = {p for p in pieces if len(p) == 1 or remerge(p, pieces) == [p]}
    return {"pieces": pieces, "to_byte": to_byte, "dummy": dummy, "stable": stable, "inside": inside}


def remerge(text: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """Merge from single characters: the best score first, leftmost among equals."""
    parts, none, get = list(text), (0, float("-inf")), pieces.get
    scores = [get(a + b, none)[1] for a, b in zip(text, text[1:])]
    while scores and (best := max(scores)) > none[1]:
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], none)[1]
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], none)[1]
    return parts


class Encoder:
    def __init__(self, model: dict):
        self.pieces, self.to_byte, self.dummy, self.stable = model["pieces"], model["to_byte"], model["dummy"], model["stable"]
        self.inside, self.spans = model["inside"], Memo(600_000)
        self.automaton = ahocorasick.Automaton()
        for p in self.stable:
            if len(p) > 1:
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.pairs, self.memo, self.chunks = Memo(1_000_000), Memo(600_000, self.look), re.compile(CHUNK).findall
        self.surfaces = {i: p for p, (i, _) in self.pieces.items()}
        self.bytes = {i: b for b, i in self.to_byte.items()}

    def compatible(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            self.pairs.room()
            ok = self.pairs[a, b] = remerge(a + b, self.pieces) == [a, b]
        return ok

    def known(self, text: str) -> list[str]:
        """Pieces of a string whose characters are all pieces."""
        n = len(text)
        at = [[c] for c in text]  # matches by start; the ends come in order, so shortest first
        for end, (back, piece) in self.automaton.iter(text):
            at[end - back].append(piece)
        failed = bytearray(n + 1)  # positions from which no way on was found
        compatible, get = self.compatible, self.pairs.get
        done: list[tuple[str, int]] = []  # pieces with the index of their match
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            left = done[-1][0] if done else None
            while k >= 0:
                piece = at[pos][k]
                if not failed[pos + len(piece)] and (left is None or (compatible(left, piece) if (ok := get((left, piece))) is None else ok)):
                    break
                k -= 1
            if k >= 0:
                done.append((piece, k))
                pos += len(piece)
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                failed[pos] = 1
                if not done:
                    raise ValueError("no encoding found")
                piece, k = done.pop()
                pos -= len(piece)
                k -= 1
        return [p for p, _ in done]

    def chunk(self, text: str) -> list[int]:
        if text.startswith(SPACE * 2):
            # Runs of the mark have pieces of one same score, where the leftmost merge goes first and pairs alone don't decide.
            return [i for p in remerge_run(text, self.pieces) for i in self.ids(p)]
        # No piece holds the two characters at a cut side by side, so no merge can cross it; unknown characters merge with nothing.
        ids: list[int] = []
        start, inside = 0, self.inside
        for k in [*[k for k in range(1, len(text)) if text[k - 1 : k + 1] not in inside], len(text)]:
            span = text[start:k]
            start = k
            got = self.spans.get(span)
            if got is None:
                self.spans.room()
                got = [self.pieces[p][0] for p in self.known(span)] if len(span) > 1 else self.ids(span)
                if len(span) < 100:
                    self.spans[span] = got
            ids += got
        return ids

    def ids(self, piece: str) -> list[int]:
        return [self.pieces[piece][0]] if piece in self.pieces else [self.to_byte[b] for b in piece.encode()]

    def surface(self, ids: list[int]) -> str:
        """Pieces as text; bytes that make no UTF-8 become U+FFFD each."""
        if not any(map(self.bytes.__contains__, ids)):
            return "".join(map(self.surfaces.__getitem__, ids))
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(text_of(bytes(raw)))
                raw.clear()
            if i is not None:
                out.append(self.surfaces.get(i, ""))
        return "".join(out)

    def look(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal, and their surface."""
        ids = self.chunk(chunk)
        return len(ids), ",".join(map(str, ids)), self.surface(ids)

    def marked(self, text: str) -> str:
        return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(self.marked(text)) for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        return self.plain(self.surface(ids))

    def plain(self, surface: str) -> str:
        return (surface.removeprefix(SPACE) if self.dummy else surface).replace(SPACE, " ")

    def digest(self, text: str) -> tuple[int, str, str]:
        self.memo.room()
        n, ids, surfaces = zip(*map(self.memo.__getitem__, self.chunks(self.marked(text)))) if text else ((), (), ())
        return sum(n), ",".join(ids), self.plain("".join(surfaces))


def text_of(raw: bytes) -> str:
    """UTF-8 to text, with one U+FFFD for each byte that belongs to no valid character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


def remerge_run(text: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """remerge() by a heap, for texts of any length."""
    import heapq

    part: list[str | None] = list(text)
    nxt, prv = [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
    heap = [(-pieces[a + b][1], i, a, b) for i, (a, b) in enumerate(zip(text, text[1:])) if a + b in pieces]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if part[i] is not None else -1
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y >= 0 and part[x] + part[y] in pieces:
                heapq.heappush(heap, (-pieces[part[x] + part[y]][1], x, part[x], part[y]))
    return [p for p in part if p is not None]


_models: dict[str, dict] = {}


def model(path: str) -> dict:
    if path not in _models:
        _models[path] = load(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text (no begin or end id) and the text that they decode to: doc_id, ids (decimal, comma-joined), n_tokens, decoded.

    A null or empty text has no ids and decodes to the empty text; repeated rows give repeated results; a null id stays
    null; other columns are left out. One pass over the scan, nothing is shuffled.
    """
    return _run(docs, path, id_column, text_column, "n_tokens long, ids string, decoded string", lambda n, ids, text: (n, ids, text))


def encode_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As encode_texts, with SHA-256 digests in place of the ids and the decoded text."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _run(docs, path, id_column, text_column, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, text: (n, sha(ids), sha(text)))


def _run(docs: DataFrame, path: str, id_column: str, text_column: str, out: str, shape) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model(path))

    def make():
        encoder = shared("encoder", path, lambda: Encoder(held.value))
        return lambda row: [(row[0], *shape(*encoder.digest(row[1] or "")))]

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return by_row(rows, ["doc_id", "text"], f"doc_id {kind}, {out}", make)
