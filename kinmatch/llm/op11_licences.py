"""Licence scans with a generalised suffix automaton.

The automaton holds all runs of words of the licence texts and of the phrases. A text is streamed through it word by
word, which gives its matching statistics: at each word the longest run ending there that some licence text has too. A
phrase stands where the phrase's state is on the way from the current state to the root. Matches that can't be made
longer and have several words are chained, in the order of both the text and the licence text, over small gaps; a chain
is a covered span of a licence text, and tells its label if it covers most of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, only
from .licence_texts import PHRASES, TEMPLATES

#: Digits, ASCII letters and all characters beyond ASCII, in UTF-8 whose ASCII letters are lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a match that is chained, at least; words that a chain may skip on either side; share of a text that tells its label.
MATCH, GAP, COVERED = 4, 20, 0.7
#: Bytes of a text that are taken apart at a time.
PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that don't cut a word."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and WORD.match(text[end : end + 1]):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class Automaton:
    """A generalised suffix automaton over words; states are numbers, 0 the empty run."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], match: int = MATCH):
        self.templates = [(label, WORD.findall(text.encode().lower())) for label, text in templates]
        self.phrases = [(label, WORD.findall(text.encode().lower())) for label, text in phrases]
        self.match = match
        texts = [words for _, words in self.templates + self.phrases]
        self.word = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in texts:
            state = 0
            for w in words:
                state = self._extend(state, self.word[w])
        self.follows = np.zeros((len(self.word) + 1, len(self.word) + 1), dtype=bool)  # the last row and column: other words
        for words in texts:
            for a, b in zip(words, words[1:]):
                self.follows[self.word[a], self.word[b]] = True
        self.places = self._places()
        self.ends = self._ends()

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, w: int, to: int) -> int:
        """The state of exactly the run of ``state`` and w, which ``to`` holds among longer ones."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(w) == to:
            self.next[state][w] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, w, self.next[last][w])
        return new

    def _walk(self, words: list[bytes]) -> Iterator[int]:
        state = 0
        for w in words:
            state = self.next[state][self.word[w]]
            yield state

    def _places(self) -> dict[int, list[tuple[int, int]]]:
        """(text, end) of the occurrences of each state whose runs can be chained."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words) in enumerate(self.templates):
            for end, state in enumerate(self._walk(words), 1):
                while self.length[state] >= self.match:
                    out[state].append((t, end))
                    state = self.link[state]
        return out

    def _ends(self) -> dict[int, list[tuple[int, int]]]:
        """(phrase, words) of the phrases that end where a state does; where the match has so many words."""
        own = {}
        for i, (_, words) in enumerate(self.phrases):
            *_, state = self._walk(words)
            own.setdefault(state, []).append((i, len(words)))
        out = {}
        for state in range(len(self.next)):
            found, up = [], state
            while up > 0:
                found += own.get(up, [])
                up = self.link[up]
            if found:
                out[state] = found
        return out


@lru_cache(maxsize=4)
def automaton(templates: tuple = tuple(TEMPLATES), phrases: tuple = tuple(PHRASES)) -> Automaton:
    return Automaton(list(templates), list(phrases))


class Scan:
    """One text: words, places of phrases, and chains of matches, fed by parts."""

    def __init__(self, a: Automaton, gap: int = GAP):
        self.a, self.gap = a, gap
        self.words = 0
        self.base: dict[int, list[int]] = {}
        self.first = self.last = None
        self.n_base = 0
        self.before, self.state, self.long = len(a.word), 0, 0
        self.recent: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.spans: dict[tuple[int, int], tuple[int, int]] = {}

    def feed(self, part: bytes) -> None:
        """The words of a further part. Only where two words follow each other in a licence text does the automaton have to run."""
        a, other = self.a, len(self.a.word)
        get = a.word.get
        ids = np.fromiter((get(w, other) for w in WORD.findall(part)), dtype=np.int32)
        if not len(ids):
            return
        joined = a.follows[np.r_[self.before, ids[:-1]], ids]
        at = np.flatnonzero(joined)
        if not len(at) or at[0]:
            self._done(self.words)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            start = int(run[0])
            if start or not self.long:
                w = int(ids[start - 1]) if start else self.before
                self.state, self.long = a.next[0][w], 1
            self._run(self.words + start, ids[start : int(run[-1]) + 1].tolist())
            if run[-1] + 1 < len(ids):
                self._done(self.words + int(run[-1]) + 1)
        self.before = int(ids[-1])
        self.words += len(ids)

    def _done(self, end: int) -> None:
        """The current match can't be made longer: it ends before word ``end``."""
        if self.long >= self.a.match:
            for text, there in self.a.places[self.state]:
                self._chain(text, end - self.long, end, there - self.long, there)
        self.state = self.long = 0

    def _run(self, at: int, ids: list[int]) -> None:
        a, state, long = self.a, self.state, self.long
        for w in ids:
            if w not in a.next[state]:
                self.state, self.long = state, long
                self._done(at)
                while w not in a.next[state]:
                    state = a.link[state]
                    long = a.length[state]
            state, long = a.next[state][w], long + 1
            at += 1
            for phrase, words in a.ends.get(state, ()):
                if long >= words:
                    self._found(phrase, at - words)
        self.state, self.long = state, long

    def _found(self, phrase: int, start: int) -> None:
        self.n_base += 1
        self.base[phrase] = True
        self.first = start if self.first is None else min(self.first, start)
        self.last = start if self.last is None else max(self.last, start)

    def _chain(self, text: int, start: int, end: int, here: int, there: int) -> None:
        """Lengthens the chain, of those near enough before, that then covers most; or begins one."""
        covered, root = end - start, start
        near = [c for c in self.recent[text] if c[0] >= start - self.gap]
        for end0, there0, covered0, root0 in near:
            if end0 < end and there0 < there and here - there0 <= self.gap:
                more = covered0 + min(end - start, end - end0, there - there0)
                if more > covered:
                    covered, root = more, root0
        self.recent[text] = [*near, (end, there, covered, root)]
        if covered > self.spans.get((text, root), (0, 0))[0]:
            self.spans[text, root] = (covered, end)

    def close(self) -> list[dict]:
        """The spans; of those that overlap, the ones that cover most."""
        self._done(self.words)
        found = sorted((start, end, -covered, text) for (text, start), (covered, end) in self.spans.items())
        out: list[dict] = []
        group: list[tuple] = []

        def chosen() -> None:
            taken: list[tuple[int, int]] = []
            for start, end, less, text in sorted(group, key=lambda g: (g[2], len(self.a.templates[g[3]][1]), g[0], g[3])):
                if all(end <= s or e <= start for s, e in taken):
                    taken.append((start, end))
                    label, words = self.a.templates[text]
                    share = min(1.0, -less / len(words))
                    out.append({"label": label, "template": text, "start": start, "end": end, "covered": -less, "coverage": share})

        reach = -1
        for one in found:
            if one[0] >= reach:
                chosen()
                group = []
            group.append(one)
            reach = max(reach, one[1])
        chosen()
        return sorted(out, key=lambda s: (s["start"], s["template"]))


def scan_text(text: bytes | None, a: Automaton) -> dict:
    """The result for one text in UTF-8; see ``scan``."""
    one = Scan(a)
    for part in pieces((text or b"").lower()):
        one.feed(part)
    spans = one.close()
    base = {a.phrases[p][0] for p in one.base}
    told = {s["label"] for s in spans if s["coverage"] >= COVERED}
    return {
        "n_words": one.words,
        "n_base": one.n_base,
        "first_word": one.first,
        "last_word": one.last,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | told)),
        "score": 1.0 if base else max((s["coverage"] for s in spans), default=0.0),
        "spans": spans,
    }


SPAN = T.StructType().add("label", "string").add("template", "integer").add("start", "long").add("end", "long").add("covered", "integer").add("coverage", "double")
SCHEMA = (
    T.StructType()
    .add("doc_id", T.LongType())
    .add("n_words", T.LongType())
    .add("n_base", T.LongType())
    .add("first_word", T.LongType())
    .add("last_word", T.LongType())
    .add("base_labels", T.StringType())
    .add("labels", T.StringType())
    .add("score", T.DoubleType())
    .add("spans", T.ArrayType(SPAN))
)


def scan(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: Iterable[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: words, places of phrases, labels, a score, and the covered spans.

    ``n_base`` counts all places of phrases, ``first_word`` and ``last_word`` are their least and greatest start, null
    without one. ``labels`` are those of phrases and of licence texts of which a chain covers ``COVERED`` or more.
    ``score`` is 1 where a phrase stands, else the largest share of a licence text that a chain covers, 0 without a chain.
    ``spans`` are the chains, in words from 0, ends excluded. A null or empty text has no words; repeated rows and null
    ids give a row each time; an empty table gives an empty one; long texts are taken in parts. A template or phrase
    without words isn't allowed.
    """
    texts = tuple((label, text) for label, text in templates), tuple((label, text) for label, text in phrases)

    def make():
        a = automaton(*texts)

        def each(batch):
            made = [scan_text(t, a) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], **{f.name: [m[f.name] for m in made] for f in SCHEMA[1:]}}

        return each

    return map_arrow(only(docs, doc_id="long", text="binary"), make, SCHEMA)
