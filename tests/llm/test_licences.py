import random
from functools import lru_cache

import pytest

from kinmatch.llm import op11_licences as o
from kinmatch.llm import queries

BASE = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]


def plain_words(text):
    out, now = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def plain_base(words):
    return [(i, label) for label, p in BASE for i in range(len(words)) if words[i : i + len(p)] == p]


@lru_cache(maxsize=2)
def all_runs(texts):
    return {tuple(w[i:j]) for t in texts for w in [plain_words(t)] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}


def plain_scan(text, templates, phrases, match=o.MATCH, gap=o.GAP):
    """Matching statistics by comparing with every run of every template; chains over all earlier matches."""
    words = plain_words(text)
    temps = [(label, plain_words(t)) for label, t in templates]
    runs = all_runs(tuple(t for _, t in [*templates, *phrases]))

    def longest(end):
        n = 0
        while n < end and tuple(words[end - n - 1 : end]) in runs:
            n += 1
        return n

    long = [longest(i) for i in range(len(words) + 1)] + [0]
    chains, spans = {}, {}
    for end in range(1, len(words) + 1):
        n = long[end]
        if n < match or end < len(words) and long[end + 1] == n + 1:
            continue
        for t, (_, temp) in enumerate(temps):
            for there in sorted(e for e in range(n, len(temp) + 1) if temp[e - n : e] == words[end - n : end]):
                best, root = n, end - n
                for e0, t0, c0, r0 in chains.get(t, []):
                    if e0 < end and t0 < there and end - n - e0 <= gap and there - n - t0 <= gap:
                        more = c0 + min(n, end - e0, there - t0)
                        if more > best:
                            best, root = more, r0
                chains.setdefault(t, []).append((end, there, best, root))
                if best > spans.get((t, root), (0, 0))[0]:
                    spans[t, root] = best, end
    left = sorted((-c, len(temps[t][1]), s, t, e) for (t, s), (c, e) in spans.items())
    taken = []
    for less, _, s, t, e in left:
        if all(e <= a or b <= s for _, a, b, *_ in taken):
            taken.append((t, s, e, -less, min(1.0, -less / len(temps[t][1]))))
    return sorted((s, t, e, c, share) for t, s, e, c, share in taken)


@pytest.mark.parametrize("piece", [o.PIECE, 7])
def test_against_plain_scan(monkeypatch, piece):
    monkeypatch.setattr(o, "PIECE", piece)
    rng = random.Random(11)
    for case in range(150):
        words = "a b c d ee".split()[: rng.randint(2, 5)]
        templates = [(f"t{i}", " ".join(rng.choices(words, k=rng.randint(4, 14)))) for i in range(rng.randint(1, 4))]
        phrases = [("p", "a b"), ("q", "b a b")]
        parts = []
        for _ in range(rng.randint(0, 5)):
            t = rng.choice(templates)[1].split()
            i = rng.randrange(len(t))
            parts += t[i : i + rng.randint(1, 12)] + rng.choices(["zz", "a", "b"], k=rng.randint(0, 3))
        text = " ".join(parts)
        got = o.scan_text(text.encode(), o.Automaton(templates, phrases))
        assert [(s["start"], s["template"], s["end"], s["covered"], s["coverage"]) for s in got["spans"]] == plain_scan(text, templates, phrases), case
        w = text.split()
        places = [i for p in (["a", "b"], ["b", "a", "b"]) for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (got["n_base"], got["first_word"], got["last_word"]) == (len(places), min(places, default=None), max(places, default=None))


def test_automaton_holds_exactly_the_runs():
    rng = random.Random(3)
    texts = [("x", " ".join(rng.choices("abc", k=rng.randint(1, 9)))) for _ in range(6)]
    a = o.Automaton(texts[:4], texts[4:])
    runs = {tuple(w[i:j]) for _, t in texts for w in [t.split()] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    found, front = set(), [((), 0)]
    while front:
        run, state = front.pop()
        for word, n in a.word.items():
            if n in a.next[state]:
                assert (longer := (*run, word.decode())) not in found
                found.add(longer)
                front.append((longer, a.next[state][n]))
    assert found == runs


def test_query_on_the_table(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_licence_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    a, some = o.automaton(), 0
    for r in rows:
        words = plain_words(texts[r["doc_id"]])
        base = plain_base(words)
        starts, labels = [i for i, _ in base], sorted({x for _, x in base})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(labels) and set(labels) <= set(r["labels"].split(",")) | {""}
        assert r["score"] == 1.0 if base else r["score"] < 0.7 or r["labels"]
        spans = plain_scan(texts[r["doc_id"]], o.TEMPLATES, o.PHRASES)
        if spans:
            some += 1
            assert r["score"] == (1.0 if base else max(s[4] for s in spans))
            assert [(s["start"], s["template"]) for s in o.scan_text(texts[r["doc_id"]].encode(), a)["spans"]] == [s[:2] for s in spans]
    assert some


def test_whole_and_changed_texts():
    a = o.automaton()
    by = {}
    for label, text in o.TEMPLATES:
        got = o.scan_text(f"// {text.upper()} //".encode(), a)
        assert label in got["labels"].split(",")
        assert got["score"] == 1.0
        by.setdefault(label, text)
    words = by["bsd-3-clause"].split()
    changed = " ".join(w for i, w in enumerate(words) if i % 25)
    assert o.scan_text(f"x y z {changed} and so on".encode(), a)["labels"] == "bsd-3-clause"
    assert o.scan_text(b"the quick brown fox of the software", a)["labels"] == ""
    two = o.scan_text((by["isc"] + " nothing else " * 30 + by["zlib"]).encode(), a)
    assert two["labels"] == "isc,zlib" and [s["label"] for s in two["spans"]] == ["isc", "zlib"]
    assert o.scan_text(b"Licensed under CC BY-NC 4.0.", a)["labels"] == "cc-by-nc"


def test_odd_rows(spark):
    long = "mit license " * 200_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "MIT license", "x"), (3, "MIT-License mit license", None), (3, "MIT-License mit license", None), (4, long, "y"), (5, "Émit license İ", "z"), (6, "mit\nlicense2", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(o.scan(docs).drop("spans").collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert [tuple(r) for r in got] == [
        (None, 2, 1, 0, 0, "mit", "mit", 1.0),
        (1, 0, 0, None, None, "", "", 0.0),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 4, 2, 0, 2, "mit", "mit", 1.0),
        (3, 4, 2, 0, 2, "mit", "mit", 1.0),
        (4, 400_000, 200_000, 0, 399_998, "mit", "mit", 1.0),
        (5, 3, 0, None, None, "", "", 0.0),
        (6, 2, 0, None, None, "", "", 0.0),
    ]
    assert o.scan(docs.limit(0)).count() == 0
