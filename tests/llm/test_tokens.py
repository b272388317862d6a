import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from kinmatch.llm import op02_packing, op03_token_counts, op08_byte_bpe
from kinmatch.llm.word_bpe import WordBpe

ODD = [
    "", " ", "Don't you'll WE'RE 's ''s 12ab3 ½ ²x É é ΣΑΣ İstanbul ǅ", "\x1c\x1f\x85  ab_c __ 你好 \U0001f600‍ ０１ ٣ à b́", "<|endoftext|> x",
    " a", "a ", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "\t\tx", "x" * 3000, "ab" * 2000 + "  \n\n x", " " * 300 + "y", "\xa0nb　x  z", "a b\r\nc", "ſ's ﬁ ß",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    return ODD + [r[0] for r in rows]


def test_word_ids_equal_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, bpe = Tokenizer.from_file(path), WordBpe(path, cache=300)
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_byte_ids_equal_the_library(texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = op08_byte_bpe.ByteBpe(path, public_tokenizers.PATTERN, cache=300)
    for t, ids in zip(texts, bpe.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_both_trees_merge_alike():
    bpe = op08_byte_bpe.ByteBpe.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    pieces = [bytes(rng.choices(b"aehinorst \xc3\xa9\xff", k=rng.randint(1, 32))) for _ in range(400)]
    for p, ids in zip(pieces, bpe.merge_short(pieces)):
        parts = [int(bpe.first[b]) for b in p]
        while True:  # the plain rule: the leftmost pair of least rank
            best = min(((bpe.ranks.get(bpe.tokens[a] + bpe.tokens[b], 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        assert bpe.merge_long(p) == parts == np.frombuffer(ids, "<u4").tolist()


ROWS = [(1, "Ab c", "x"), (2, None, "x"), (2, "", None), (None, "zz", "y"), (4, "w x " * 6000, "y"), (4, "w x " * 6000, "y")]


def test_encode_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    made = op08_byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = made.collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"]).decode()) for r in rows) == sorted((d or -1, t or "") for d, t, _ in ROWS)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert made.limit(0).count() == 0 and op08_byte_bpe.encode(docs.where("false"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "x").count() == 0


def check_pieces(pieces, docs, window):
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append(p)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = defaultdict(list)
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, len(ids)].append(ids)
    assert set(by) == set(want)
    for key, texts in want.items():
        assert len({t.tobytes() for t in texts}) == 1
        seen = np.zeros(key[1], dtype=int)
        for p in by[key]:
            assert bytes(p["ids"]) == texts[0][p["start"] : p["start"] + p["length"]].tobytes()
            seen[p["start"] : p["start"] + p["length"]] += 1
        assert (seen == len(texts)).all()
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


@pytest.mark.parametrize(("window", "most"), [(4096, 1024), (64, 4)])
def test_packing(spark, sf, window, most):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [r[:2] for r in ROWS]
    docs = [(d, t) for d, t in docs if d != 1 and d != 2 and d != 4] + [r[:2] for r in ROWS if r[0] != 1]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    pieces = op02_packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), window=window, max_open=most)
    sequences = check_pieces(pieces.collect(), docs, window)
    total = sum(p["length"] for rows in sequences.values() for p in rows)
    assert len(sequences) <= total / window + 3 * 13
    assert op02_packing.pack(df.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        op02_packing.pack(df, "", window=100)


def plain_packer(sizes, window, most):
    """Sequences of (document, start, length), by trying each window and counting all squares anew."""
    out, windows = [], []

    def squares():
        return sum(n * n for level, n in Counter(sum(x[2] for x in w) for w in windows).items() if level < window)

    def fill(keep):
        windows.sort(key=lambda w: sum(x[2] for x in w))
        while len(windows) > keep and len(windows) > 1:
            to = windows[-1]
            while sum(x[2] for x in to) < window and len(windows) > 1:
                d, start, n = windows[0].pop()
                take = min(n, window - sum(x[2] for x in to))
                to.append((d, start + n - take, take))
                if n > take:
                    windows[0].append((d, start, n - take))
                elif not windows[0]:
                    windows.pop(0)
            if sum(x[2] for x in to) == window:
                out.append(windows.pop())

    for d, n in enumerate(sizes):
        out += [[(d, at, window)] for at in range(0, n // window * window, window)]
        if left := n % window:
            tried = []
            for w in [None, *windows]:
                level = sum(x[2] for x in w) if w else 0
                if level + left <= window:
                    item = (d, n - left, left)
                    before = windows
                    windows = [x for x in windows if x is not w] + [[*(w or []), item]]
                    tried.append((squares(), -level, windows))
                    windows = before
            best = min(t[:2] for t in tried)
            windows = [t[2] for t in tried if t[:2] == best][-1]
            out += [w for w in windows if sum(x[2] for x in w) == window]
            windows = [w for w in windows if sum(x[2] for x in w) < window]
        if len(windows) > most:
            fill(most - most // 4)
    fill(1)
    for w in windows:
        total, ids = sum(x[2] for x in w), [(d, start + i) for d, start, n in w for i in range(n)]
        for b in reversed(range(total.bit_length())):
            if total >> b & 1:
                out.append([(d, at, 1) for d, at in ids[: 1 << b]])
                ids = ids[1 << b :]
    return out


@given(st.lists(st.integers(1, 40), max_size=50), st.sampled_from([2, 5, 100]))
@settings(max_examples=150, deadline=None)
def test_sequences_are_those_of_a_plain_packer(sizes, most):
    made = op02_packing.pack_documents(((d, np.arange(n)) for d, n in enumerate(sizes)), 16, most)
    ids = lambda sequences: [[(d, at + i) for d, at, n in s for i in range(n)] for s in sequences]
    assert ids([(d, at, len(x)) for d, at, x in s] for s in made) == ids(plain_packer(sizes, 16, most))


def test_the_rule_places_nearly_all(spark):
    """Of the ids of the 1,000 documents, nine tenths stay in the window where the rule has put them."""
    bpe = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sizes = [len(bpe.encode(t or "")) // 4 + 1 for t in texts]
    levels = op02_packing.SumOfSquares()
    sequences = list(op02_packing.pack_documents(((d, np.empty(n)) for d, n in enumerate(sizes)), levels=levels))
    assert levels.moved < 0.1 * sum(sizes), levels.moved / sum(sizes)
    assert len(sequences) <= sum(sizes) / 4096 + 13


def test_a_very_long_text_among_many_short_ones():
    sizes = [3] * 50 + [1_000_000] + [5000] * 30
    levels = op02_packing.SumOfSquares()
    made = list(op02_packing.pack_documents(((d, np.arange(n)) for d, n in enumerate(sizes)), max_open=4, levels=levels))
    assert sum(len(x) for s in made for *_, x in s) == sum(sizes) and levels.n_open == 1


@given(st.lists(st.integers(1, 15), max_size=60))
@settings(max_examples=100, deadline=None)
def test_level_is_the_one_of_least_squares(sizes):
    levels = op02_packing.SumOfSquares(16)
    for i, size in enumerate(sizes):
        def cost(at):
            n = levels.counts.copy()
            if at:
                n[at] -= 1
            if at + size < 16:
                n[at + size] += 1
            return int((n[1:16] ** 2).sum())

        choices = [0, *(h for h in range(1, 17 - size) if levels.counts[h])]
        assert cost(levels.level_for(size)) == min(map(cost, choices))
        levels.add(size, i)


def longest_match(word, begin, inner):
    if len(word) > op03_token_counts.MAX_WORD:
        return 1
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (inner if at else begin)), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1), st.sets(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abc", min_size=1, max_size=14), max_size=20))
@settings(max_examples=200, deadline=None)
def test_automaton_is_greedy_longest_match(begin, inner, words):
    made = op03_token_counts.LongestMatch(begin, inner)
    for w in words:
        assert made.pieces(w) == longest_match(w, begin, inner)


def test_counts_equal_the_library(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    begin, inner = op03_token_counts.vocabulary(path)
    ids = {t: i for i, t in enumerate([*sorted(begin), *("##" + t for t in sorted(inner)), "[UNK]"])}
    library = models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=op03_token_counts.MAX_WORD)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = {r["doc_id"]: r["n_tokens"] for r in op03_token_counts.token_counts(docs, path).collect()}
    for r in docs.collect():
        assert made[r["doc_id"]] == sum(len(library.tokenize(w)) for w in op03_token_counts.WORDS(r["text"]))
    odd = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    rows = sorted((r["doc_id"] or -1, r["n_words"]) for r in op03_token_counts.token_counts(odd, path).collect())
    assert rows == [(-1, 1), (1, 2), (2, 0), (2, 0), (4, 12000), (4, 12000)]
    assert op03_token_counts.token_counts(odd.where("false"), path).count() == 0


def test_digest_columns(spark, sf):
    from kinmatch.llm.queries import queries

    rows = {r["doc_id"]: r for r in queries()["op8_byte_bpe"](spark, sf).collect()}
    pieces = queries()["op2_packing"](spark, sf).collect()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert rows[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    bpe = WordBpe.of(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for p in pieces:
        ids = bpe.encode(texts[p["doc_id"]]) + (2).to_bytes(4, "little")
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] * 4 : (p["start"] + p["length"]) * 4])
