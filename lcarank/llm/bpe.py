"""Byte-level BPE: exact encoding by one dynamic program over prefixes, and decoding.

For every prefix of a piece of text, BPE's result has one last token. It is the only token t that
ends the prefix and may stand after the last token of the prefix without t. The tokens that end a
prefix come from a suffix automaton over the vocabulary; two tokens may stand side by side if no
merge across their border would come before the merges that build them. Following the stored last
tokens back from the end gives the exact ids.

Pieces come from the tokenizer's split pattern; special tokens in a text are cut out first and get
their own id. Null and empty texts have no tokens. Pieces met before are looked up in a bounded
cache; very long texts are split piece by piece, and a piece of any length costs time linear in it.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lcarank.llm.common import CACHE_ENTRIES, arrow_rows, id_and_text, worker_state

#: Code points of a text up to which all its pieces are held at once.
WHOLE = 1 << 20
PIECES = 1 << 16
#: Pieces in each of the two generations of a worker's cache, about 200 bytes each.
KNOWN = 600_000
#: Letters of Latin-1 and Latin Extended-A and B. Texts of these, ASCII digits and marks and plain white
#: space are split by the standard library's engine, which is twice as fast on such classes.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Code points that the regex module calls letters or numbers and the tokenizers library,
#: whose Unicode tables are older, calls neither.
LATE = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F
12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
323B0-33479 3D000-3FC3F"""
#: The White_Space property, which \s stands for.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself,
    the other bytes, in order, for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """What the encoder needs of a tokenizers JSON file: a few MB at most, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] \
            or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"vocab": model["vocab"], "merges": merges, "special": special}


def split_pattern(letter: str, number: str) -> regex.Pattern:
    return regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+",
        regex.V1)


class SuffixAutomaton:
    """Of the substrings of the vocabulary's tokens. ``step`` maps state * 256 + byte to a state,
    ``token`` is the token that a state's longest string is (or -1), ``up`` leads to the nearest
    shorter suffix that is a token."""

    def __init__(self, tokens: dict[bytes, int]):
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, t in tokens.items():
            node = 0
            for b in word:
                if b not in trie[node]:
                    trie[node][b] = len(trie)
                    trie.append({})
                node = trie[node][b]
            ends[node] = t
        out: list[dict[int, int]] = [{}]
        link, size, token = [-1], [0], [-1]
        queue = [(0, 0)]
        for node, last in queue:
            for b, child in trie[node].items():
                cur = len(out)
                out.append({})
                size.append(size[last] + 1)
                link.append(0)
                token.append(ends.get(child, -1))
                p = last
                while p >= 0 and b not in out[p]:
                    out[p][b] = cur
                    p = link[p]
                if p >= 0:
                    q = out[p][b]
                    if size[p] + 1 == size[q]:
                        link[cur] = q
                    else:
                        twin = len(out)
                        out.append(dict(out[q]))
                        size.append(size[p] + 1)
                        link.append(link[q])
                        token.append(-1)
                        while p >= 0 and out[p].get(b) == q:
                            out[p][b] = twin
                            p = link[p]
                        link[q] = link[cur] = twin
                queue.append((child, cur))
        self.step = {s * 256 + b: to for s, x in enumerate(out) for b, to in x.items()}
        self.size, self.link, self.token = size, link, token
        self.up = [-1] * len(out)
        for s in sorted(range(1, len(out)), key=size.__getitem__):
            v = link[s]
            self.up[s] = v if token[v] >= 0 else self.up[v]


class Encoder:
    def __init__(self, vocabulary: dict):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {t: raw(s) for s, t in vocabulary["vocab"].items()}
        tokens = {b: t for t, b in self.bytes_of.items()}
        self.rank = [-1] * (max(self.bytes_of) + 1)
        self.left, self.right, self.pair = {}, {}, {}
        for r, (a, b) in enumerate(vocabulary["merges"]):
            x, y = tokens[raw(a)], tokens[raw(b)]
            t = tokens[raw(a) + raw(b)]
            if t in self.left:
                raise ValueError(f"two merges make {a + b!r}: a token's parts must be unique")
            self.rank[t], self.left[t], self.right[t], self.pair[x, y] = r, x, y, r
        self.special = vocabulary["special"]
        self.bytes_of |= {t: s.encode() for s, t in self.special.items()}
        self.automaton = SuffixAutomaton({b: t for b, t in tokens.items() if t in self.left or len(b) == 1})
        late = "".join("-".join(f"\\U{int(c, 16):08x}" for c in x.split("-")) for x in LATE.split())
        self.late = regex.compile(f"[{late}]")
        self.pieces = split_pattern(r"\p{L}", r"\p{N}")
        self.late_pieces = split_pattern(rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]")
        self.other = re.compile(f"[^\t\n\r -~{LATIN}]")
        self.latin_pieces = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\t\n\r {LATIN}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
        self.cuts = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.side: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a, b side by side. Undo merges from the latest on; while both
        neighbours of the border exist, a merge of the two that comes before the next merge on
        either side would have joined them. Of equal merges, the left one comes first."""
        rank, pair = self.rank, self.pair
        before_a = before_b = len(rank) + 1
        while True:
            r = pair.get((a, b))
            if r is not None and r < before_a and r <= before_b:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                before_a, a = ra, self.right[a]
            elif rb >= 0:
                before_b, b = rb, self.left[b]
            else:
                return True

    def piece_ids(self, piece: bytes) -> list[int]:
        """Last token of every prefix, then back from the end."""
        sa, side = self.automaton, self.side
        step, size, link, token, up = sa.step, sa.size, sa.link, sa.token, sa.up
        last, length = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        state = matched = 0
        for i, byte in enumerate(piece, 1):
            to = step.get(state * 256 + byte)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = step.get(state * 256 + byte)
            state, matched = to, matched + 1
            v = state if token[state] >= 0 and size[state] <= matched else up[state]
            while v > 0:
                t, n = token[v], size[v]
                if n == i:
                    last[i], length[i] = t, n
                    break
                a = last[i - n]
                if a >= 0:
                    key = a << 32 | t
                    ok = side.get(key)
                    if ok is None:
                        if len(side) >= CACHE_ENTRIES:
                            side.clear()
                        ok = side[key] = self.compatible(a, t)
                    if ok:
                        last[i], length[i] = t, n
                        break
                v = up[v]
        ids, i = [], len(piece)
        while i:
            ids.append(last[i])
            i -= length[i]
        return ids[::-1]

    def _known(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.older.get(piece) or np.array(self.piece_ids(piece.encode()), "<u4").tobytes()
            if len(self.known) >= KNOWN:  # the last but one generation goes
                self.older, self.known = self.known, {}
            if len(piece) <= 64:
                self.known[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = self.latin_pieces
        if self.other.search(text):
            pieces = self.late_pieces if self.late.search(text) else self.pieces
        if len(text) <= WHOLE:
            return b"".join(map(self._known, pieces.findall(text)))
        found, out = pieces.finditer(text), []
        while some := b"".join(self._known(m.group()) for m in islice(found, PIECES)):
            out.append(some)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not self.cuts or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x)
                        for x in self.cuts.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _encoder(held) -> Encoder:
    """One encoder in a worker, for the vocabulary that it last used."""
    kept = worker_state("encoder", dict)
    if held.value["id"] not in kept:
        kept.clear()
        kept[held.value["id"]] = Encoder(held.value["vocabulary"])
    return kept[held.value["id"]]


def _broadcast(df: DataFrame, path: str):
    vocabulary = read_vocabulary(path)
    mark = hashlib.sha256(json.dumps(vocabulary, sort_keys=True).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast({"id": mark, "vocabulary": vocabulary})


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit)."""
    held = _broadcast(df, path)

    def run(ids: pa.Array, texts: list) -> dict:
        done = list(map(_encoder(held).encode, texts))
        return {"id": ids, "n_tokens": pa.array([len(x) // 4 for x in done], pa.int64()), "ids": pa.array(done, pa.binary())}

    source = id_and_text(df, id_col, text_col, binary=False)
    kind = source.schema["id"].dataType.simpleString()
    return arrow_rows(source, run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text`` of its ids (none: empty)."""
    held = _broadcast(df, path)

    def run(ids: pa.Array, coded: list) -> dict:
        return {"id": ids, "text": pa.array([_encoder(held).decode(x or b"") for x in coded], pa.string())}

    source = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_rows(source, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The registered query's columns. Ids and texts stay in the worker that made them."""
    held = _broadcast(df, path)

    def run(ids: pa.Array, texts: list) -> dict:
        e, n, a, b = _encoder(held), [], [], []
        for t in texts:
            x = e.encode(t)
            n.append(len(x) // 4)
            a.append(hashlib.sha256(x).hexdigest())
            b.append(hashlib.sha256(e.decode(x).encode()).hexdigest())
        return {"id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}

    source = id_and_text(df, id_col, text_col, binary=False)
    kind = source.schema["id"].dataType.simpleString()
    return arrow_rows(source, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string") \
        .withColumnRenamed("id", id_col)
