"""Ids of a lower-casing byte-pair vocabulary with word ends, as the ``tokenizers`` library gives them, word by word.

Such a vocabulary treats each word of a text by itself and drops white space; so a text's ids are those of its words
joined, and a word is encoded by the library when it is first met.
"""

from __future__ import annotations

import re
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
from tokenizers import Tokenizer

from .unicode_classes import SPACE, ranges

#: Bytes that have no printable sign of their own get the next ones from 256 on, as byte-level vocabularies have it.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordBpe:
    """Encodes texts; keeps the ids of at most ``cache`` chunks between white space, of at most ``longest`` characters."""

    def __init__(self, path: str, cache: int = 450_000, longest: int = 48):
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.specials = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        letter, number = ranges("L"), ranges("N")
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search  # white space to Python alone
        self.known: dict[str, bytes] = {}
        self.cache, self.longest = cache, longest

    @staticmethod
    @lru_cache
    def of(path: str) -> WordBpe:
        return WordBpe(path)

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, chunk: str) -> bytes:
        """The ids of a chunk, from the vocabulary's own merges of its words; both are kept if they are short."""
        if chunk.isalpha():
            return self.word(chunk)
        if chunk[-1] in ".,!?:;" and chunk[:-1].isalpha():
            words = (chunk[:-1], chunk[-1])
        else:
            words = self.find(chunk)
        known = self.known
        made = b"".join([x if (x := known.get(w)) is not None else self.word(w) for w in words])
        if len(chunk) <= self.longest:
            known[chunk] = made
        return made

    def word(self, word: str) -> bytes:
        signs = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_SIGNS)
        four = self.four
        made = b"".join([four[t.id] for t in self.merge(signs)])
        if len(word) <= self.longest:
            self.known[word] = made
        return made

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit integers one after another."""
        if self.odd(text) or any(s in text for s in self.specials):
            return self.by_library(text)
        if not text.isascii():
            if not is_normalized("NFC", text):
                text = normalize("NFC", text)
            text = text.replace("Σ", "σ")  # the library lower-cases letter by letter
        chunks, known = text.lower().split(), self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) > self.cache:
            known.clear()
        find, learn = known.get, self.learn
        return b"".join([x if (x := find(c)) is not None else learn(c) for c in chunks])
