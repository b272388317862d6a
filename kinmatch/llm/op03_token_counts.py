"""Token counts by a linear longest-match automaton (Song et al., Fast WordPiece Tokenization, EMNLP 2021).

The vocabulary is a trie of word beginnings and, under a second root, of word continuations. Each node has a failure
link, to where matching goes on once the longest match behind it is taken, and the number of pieces that following the
link pops. A word's pieces are then counted in one pass over its characters, without building any piece.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, only
from .unicode_classes import SPACE

#: A word is a run of letters, digits and underscores, or any other character that isn't white space.
WORDS = re.compile(rf"\w+|[^\w{SPACE}\s]").findall
#: The limit that is usual for word pieces, beyond which a word is one unknown piece; for ``longest``, not taken by default.
MAX_WORD = 100
DEAD = -1


class LongestMatch:
    """The automaton. ``begin`` and ``inner`` are the pieces that words begin and go on with; words over ``longest`` characters are one unknown piece."""

    def __init__(self, begin: set[str], inner: set[str], cache: int = 500_000, longest: int | None = None):
        self.longest = longest
        self.arcs: list[dict[str, int]] = [{}, {}]  # node 0 is where words begin, 1 where they go on
        whole = [False, False]
        for root, pieces in ((0, begin), (1, inner)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.arcs[at]:
                        self.arcs[at][c] = len(self.arcs)
                        self.arcs.append({})
                        whole.append(False)
                    at = self.arcs[at][c]
                if piece:
                    whole[at] = True
        n = len(self.arcs)
        self.fail, self.popped = [DEAD] * n, [0] * n
        queue = [0, 1]
        for at in queue:  # by depth: what a node's link needs is known
            for c, to in self.arcs[at].items():
                if whole[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    link, pops = self.fail[at], self.popped[at]
                    while link != DEAD and c not in self.arcs[link]:
                        pops += self.popped[link]
                        link = self.fail[link]
                    if link != DEAD:
                        self.fail[to], self.popped[to] = self.arcs[link][c], pops
                queue.append(to)
        self.known: dict[str, int] = {}
        self.cache = cache

    def pieces(self, word: str) -> int:
        """How many pieces greedy longest match cuts a word into; one, the unknown piece, if it can't."""
        if self.longest is not None and len(word) > self.longest:
            return 1
        arcs, fail, popped = self.arcs, self.fail, self.popped
        at = n = 0
        for c in word:
            while (to := arcs[at].get(c)) is None:
                if fail[at] == DEAD:
                    return 1
                n += popped[at]
                at = fail[at]
            at = to
        while at != 1:  # what is still held
            if at == DEAD or fail[at] == DEAD:
                return 1
            n += popped[at]
            at = fail[at]
        return n

    def count(self, words: list[str]) -> int:
        """The pieces of all words of a text."""
        known, total = self.known, 0
        if len(known) > self.cache:
            known.clear()
        for word in words:
            if (n := known.get(word)) is None:
                n = self.pieces(word)
                if len(word) < 32:
                    known[word] = n
            total += n
        return total


def vocabulary(path: str, mark: str = "▁") -> tuple[set[str], set[str]]:
    """Beginnings and continuations of words in a sentencepiece model: pieces with and without the mark of a space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    begin = {p[1:] for p in pieces if p.startswith(mark) and mark not in p[1:] and len(p) > 1}
    return begin, {p for p in pieces if mark not in p}


@lru_cache
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of the whole text of each row of ``docs (doc_id, text)``.

    A null or empty text has none of either; repeated rows give repeated results; an empty table gives an empty one.
    """

    def make():
        made = automaton(path)

        def each(batch):
            counts = [(len(w), made.count(w)) for w in (WORDS(t or "") for t in batch["text"])]
            return {"doc_id": batch["doc_id"], "n_words": [w for w, _ in counts], "n_tokens": [n for _, n in counts]}

        return each

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_tokens")])
    return map_arrow(only(docs, doc_id="long", text="string"), make, schema)
