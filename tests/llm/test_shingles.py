import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from kinmatch.llm import op05_shingles as o
from kinmatch.llm import op05_simhash as simhash
from tests.llm.test_simhash import brute


def sets(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)} or ({tuple(parts)} if parts else set())


def similar(a, b):
    return a[0] == b[0] or 5 * len(a[0] & b[0]) >= 4 * len(a[0] | b[0])


def near(a, b, radius=26):
    """The stage's links: fingerprints of sets that differ in few bits, and similar sets."""
    return bin(a[1] ^ b[1]).count("1") <= radius and similar(a, b)


def both(text, words=5):
    """The set of shingles and the fingerprint of it, computed bit by bit."""
    own = sets(text, words)
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in own]
    hashes = [h | int(simhash.remixed(np.array([h], "<u8"))[0]) << 64 for h in hashes]
    return own, sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(seed):
    """Originals, and copies on either side of 0.8; some repeat one word, which decides a fingerprint of multisets."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    passage, rows = words(40), ["", None, "one", "ONE", "x " * 300 + "end of a", "x " * 300 + "quite another end"]
    for _ in range(25):
        old = words(rng.randint(30, 200)) + passage * rng.randint(0, 1)
        rows.append(" ".join(old))
        for _ in range(rng.randint(1, 4)):
            new = list(old)
            for _ in range(rng.randint(0, max(1, len(old) // 25))):
                new[rng.randrange(len(new))] = words(1)[0]
            rows.append(" ".join(new + ["w"] * rng.choice([0, 0, 500])))
    return rows


@pytest.mark.parametrize(("share", "block"), [(o.SHARE, o.BLOCK), (8, 2)])
def test_groups_are_those_of_all_pairs(spark, share, block):
    """With the usual sizes, and with ones so small that tables and bundles are cut into blocks."""
    rows = list(enumerate(texts(3)))
    got = o.groups(spark.createDataFrame(rows, "doc_id long, text string"), share=share, block=block).collect()
    least = {}
    for r in got:
        least[r["part"]] = min(r["doc_id"], least.get(r["part"], r["doc_id"]))
    assert {r["doc_id"]: least[r["part"]] for r in got} == brute([(i, *both(t)) for i, t in rows], near)


@pytest.mark.parametrize("least", [0.8, 0.85])
def test_similar_sets_are_caught(spark, least):
    """Held against the true similarity: 0.9 of the pairs of 0.8 or more share a group, and 0.98 from 0.85 on; no others do."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    rows, pairs = [], []
    while len(pairs) < 300:
        old = words(rng.randint(40, 300))
        new = list(old)
        for _ in range(rng.randint(1, max(1, len(old) // 30))):
            new[rng.randrange(len(new))] = words(1)[0]
        a, b = sets(" ".join(old)), sets(" ".join(new))
        if least <= len(a & b) / len(a | b) < least + 0.05:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(old)), (len(rows) + 1, " ".join(new))]
    got = {r["doc_id"]: r["part"] for r in o.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= (0.9 if least == 0.8 else 0.98) * len(pairs)
    assert len(set(got.values())) >= len(pairs)


def test_one_large_group(spark):
    """Copies of one text, each with other words changed, that are mostly not similar to each other but to the text."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    old, rows = [word() for _ in range(120)], []
    for _ in range(300):
        new = list(old)
        for at in rng.sample(range(120), 3):
            new[at] = word()
        rows.append(" ".join(new))
    rows = list(enumerate(rows))
    got = o.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=32).collect()
    least = {}
    for r in got:
        least[r["part"]] = min(r["doc_id"], least.get(r["part"], r["doc_id"]))
    assert {r["doc_id"]: least[r["part"]] for r in got} == brute([(i, *both(t)) for i, t in rows], near)


def test_stage_takes_similar_sets(spark):
    """Fingerprints of repeated words linked texts that only share these, and lost others of 0.8 and more."""
    rows = list(enumerate(texts(4)))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute([(i, *both(t)) for i, t in rows], near).values()))


def test_rows_without_id_bridge(spark):
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(100)]
    a, b, c = (" ".join(words[i : i + 80]) for i in (0, 7, 14))
    rows = [(2, a, "p"), (None, b, "q"), (3, c, "r"), (None, "u v w x y z", "s"), (None, "U v w x y z", "t"), (4, "k", "x"), (4, "k", "x")]
    kept = o.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    got = kept.collect()
    assert kept.columns == ["doc_id", "text", "fp"] and sorted(r["doc_id"] or 0 for r in got) == [0, 2, 4]
