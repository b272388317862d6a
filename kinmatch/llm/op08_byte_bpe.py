"""Byte-level BPE encoding and decoding with a segment tree.

A segment tree over a piece's byte positions holds, at its root, the leftmost pair of least rank. Each merge takes the
root's pair, joins it to its live neighbours and updates the three positions this changes, each by a walk to the root.
Many short pieces are merged together, one tree a row; a longer piece has a tree by itself, so a piece of n bytes takes
n log n steps whatever its length.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, only
from .unicode_classes import SPACE, ranges

#: Pieces of up to so many bytes are merged many at a time.
SHORT = 32
NONE = np.int64(1) << 62
#: What a text that ``chunks`` cuts at spaces and line ends doesn't hold: white space in a row or of other kinds.
PAIRS = ("  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
WIDE = tuple("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class ByteBpe:
    """The ranks of a vocabulary, the pattern that splits texts, and the ids of at most ``cache`` chunks met so far."""

    def __init__(self, path: str, pattern: str, cache: int = 500_000, longest: int = 48):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in rows}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for at in range(1, len(t)):
                a, b = self.ranks.get(t[:at]), self.ranks.get(t[at:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()] + [0], dtype=np.int64)
        self.keys = np.append(self.keys, NONE)
        # the letters and numbers of the standard library's ``re``, and white space as the pattern means it
        classes = {r"\p{L}": ranges("L"), r"\p{N}": ranges("N"), r"\s": SPACE, r"\S": None}
        self.find = re.compile(translated(pattern, classes)).findall
        self.four = [r.to_bytes(4, "little") for r in range(len(self.tokens))]
        self.known: dict[str, bytes] = {}
        self.cache, self.longest = cache, longest

    @staticmethod
    @lru_cache
    def of(path: str, pattern: str) -> ByteBpe:
        return ByteBpe(path, pattern)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens joined, or NONE."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece, with a tree of its own."""
        n, pairs = len(piece), self.pairs
        token = [int(self.first[b]) for b in piece]
        width = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        place = width.bit_length()
        tree = [none] * (2 * width)

        def value(i: int, j: int) -> int:
            r = pairs.get(token[i] << 20 | token[j]) if j < n else None
            return none if r is None else r << place | i

        for i in range(n - 1):
            tree[width + i] = value(i, i + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, v: int) -> None:
            k = width + i
            tree[k] = v
            k >>= 1
            while k:
                v = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == v:
                    break
                tree[k] = v
                k >>= 1

        while (least := tree[1]) < none:
            i = least & (1 << place) - 1
            gone = after[i]
            token[i] = least >> place
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, value(i, after[i]))
            if before[i] >= 0:
                put(before[i], value(before[i], i))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as ``encode_batch`` has them, of many pieces of up to ``SHORT`` bytes, with a tree for each as a row of one array."""
        longest = max(map(len, pieces))
        width = 1 << max(1, (longest - 1).bit_length())
        n, depth = len(pieces), width.bit_length()
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        token = np.concatenate([self.first[raw], np.zeros((n, 1), np.int64)], axis=1)
        cols = np.arange(width)
        tree = np.full((n, 2 * width), NONE)
        start = self.rank(token[:, :-2], token[:, 1:-1])
        start = np.where((start < NONE) & (cols[:-1] + 1 < sizes[:, None]), start << depth | cols[:-1], NONE)
        tree[:, width : 2 * width - 1] = start
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.minimum(np.tile(cols + 1, (n, 1)), sizes[:, None])
        before = np.tile(np.concatenate([cols - 1, [width - 1]]), (n, 1))
        rows = np.flatnonzero(tree[:, 1] < NONE)

        def put(rows, i, v):
            k = width + i
            tree[rows, k] = v
            k >>= 1
            while k[0]:
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                k >>= 1

        def value(rows, i, j):
            r = self.rank(token[rows, i], token[rows, np.minimum(j, width)])
            return np.where((r < NONE) & (j < sizes[rows]), r << depth | i, NONE)

        while len(rows):
            least = tree[rows, 1]
            i = least & (1 << depth) - 1
            gone = after[rows, i]
            token[rows, i] = least >> depth
            nxt = after[rows, gone]
            after[rows, i] = nxt
            inside = nxt < sizes[rows]
            before[rows[inside], nxt[inside]] = i[inside]
            put(rows, gone, NONE)
            put(rows, i, value(rows, i, nxt))
            prev = before[rows, i]
            has = prev >= 0
            if has.any():
                put(rows[has], prev[has], value(rows[has], prev[has], i[has]))
            rows = rows[tree[rows, 1] < NONE]
        live = np.zeros((n, width), dtype=bool)
        at = np.zeros(n, dtype=np.int64)
        going = np.flatnonzero(sizes > 0)
        while len(going):
            live[going, at[going]] = True
            at[going] = after[going, at[going]]
            going = going[at[going] < sizes[going]]
        flat = token[:, :-1][live].astype("<u4").tobytes()
        stops = [0, *(np.cumsum(live.sum(axis=1)) * 4).tolist()]
        return [flat[a:b] for a, b in zip(stops, stops[1:])]

    def encode_pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece that the pattern has found, as ``encode_batch`` has them."""
        made, rest, ranks, four = {}, {}, self.ranks, self.four
        for p in pieces:
            if (r := ranks.get(p)) is not None:
                made[p] = four[r]
            elif len(p) > SHORT:
                made[p] = b"".join([four[r] for r in self.merge_long(p)])
            else:
                rest.setdefault((len(p) - 1).bit_length(), []).append(p)
        for group in rest.values():
            for at in range(0, len(group), 8192):
                block = group[at : at + 8192]
                made.update(zip(block, self.merge_short(block)))
        return made

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of texts of which each can be split by the pattern alone."""
        find = self.find
        split = [[p.encode("utf-8", "surrogatepass") for p in find(c)] for c in chunks]
        ids = self.encode_pieces({p for s in split for p in s})
        return [ids[s[0]] if len(s) == 1 else b"".join([ids[p] for p in s]) for s in split]

    def chunks(self, text: str) -> list[str]:
        """The text in parts between which the pattern always splits: before a lone space or line end, where it has no others."""
        odd = PAIRS if text.isascii() else PAIRS + WIDE
        if any(s in text for s in odd):
            return self.find(text)
        head, *tail = text.replace("\n", " \n").split(" ")
        return [head, *[c if c[:1] == "\n" else " " + c for c in tail]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit integers one after another."""
        if len(self.known) > self.cache:
            self.known.clear()
        known, rows, new = self.known, [], {}
        for t in texts:
            chunks = self.chunks(t)
            ids = [known.get(c) for c in chunks]
            gaps = [i for i, x in enumerate(ids) if x is None]
            for i in gaps:
                new[chunks[i]] = b""
            rows.append((ids, [(i, chunks[i]) for i in gaps]))
        names = list(new)
        new = dict(zip(names, self.encode_chunks(names)))
        known.update((c, x) for c, x in new.items() if len(c) <= self.longest)
        for ids, gaps in rows:
            for i, c in gaps:
                ids[i] = new[c]
        return [b"".join(ids) for ids, _ in rows]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def translated(pattern: str, classes: dict[str, str | None]) -> str:
    """A pattern with Unicode classes, for ``re``: classes are written out, inside brackets and outside."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            width = 5 if pattern[at + 1] == "p" else 2
            name = pattern[at : at + width]
            if name in classes:
                body = classes[name]
                out.append(f"[^{classes[r'\s']}]" if body is None else body if inside else f"[{body}]")
            else:
                out.append(name)
            at += width
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        at += 1
    return "".join(out)


def encode(docs: DataFrame, ranks: str, pattern: str, decode: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``, a row for each row of ``docs (doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes they stand for (null unless ``decode``).
    A null text counts as empty and has no ids; texts are encoded whole; repeated rows give repeated results; an empty
    table gives an empty one.
    """

    def make():
        bpe = ByteBpe.of(ranks, pattern)

        def each(batch):
            ids = []
            texts = [t or "" for t in batch["text"]]
            for at in range(0, len(texts), 2000):
                ids += bpe.encode_batch(texts[at : at + 2000])
            back = [bpe.decode(i) for i in ids] if decode else [None] * len(ids)
            return {"doc_id": batch["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": back}

        return each

    kinds = {"doc_id": T.LongType(), "n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.BinaryType()}
    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    return map_arrow(only(docs, doc_id="long", text="string"), make, schema)
