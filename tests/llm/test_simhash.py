import random

import pytest
import xxhash
from pyspark.sql import functions as F

from kinmatch.llm import op05_simhash as o


def plain_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts, now = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            parts, now = parts + [now] * bool(now), ""
        else:
            now += c
    parts += [now] * bool(now)
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "a b c d " * 50, "É É x\x0by\x1cz A", "x" * 9000 + " y z w"])
def test_fingerprint(text):
    assert o.fingerprint(text) == plain_fingerprint(text)


def test_spark_has_the_same_hash(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] == o.signed(xxhash.xxh64_intdigest(b"a b c", 42))


def brute(entries, near):
    root = {i: i for i, *_ in entries}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, *a in entries:
        for j, *b in entries:
            if i < j and near(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def flips(fp, n, rng):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("share", [o.SHARE, 8])
@pytest.mark.parametrize(("radius", "segments", "wide"), [(0, 1, False), (2, 2, False), (1, 3, False), (3, 2, False), (7, 4, True), (11, 5, True)])
def test_links_lose_nothing(spark, radius, segments, wide, share):
    """With shares of the usual size, and with ones so small that all are cut into blocks."""
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {flips(rng.choice(seeds), rng.randint(0, radius), rng) for _ in range(150)} | {0, (1 << 64) - 1}
    entries = [(i, f, rng.getrandbits(3) if wide else 0, rng.randint(70, 130)) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, o.signed(f), m, n) for i, f, m, n in entries], "id long, fp long, more long, size int")
    bits = lambda x: bin(x).count("1")
    near = lambda a, b: bits(a[0] ^ b[0]) + wide * bits(a[1] ^ b[1]) <= radius and min(a[2], b[2]) >= 0.75 * max(a[2], b[2])
    rows = o.links(df, radius, segments, ("fp", "more")[: 1 + wide], 0.75, share).collect()
    linked = brute([(i,) for i, *_ in entries], lambda a, b: False)
    from tests.test_operators import brute_components

    assert {**linked, **brute_components([(r["a"], r["b"]) for r in rows])} == brute(entries, near)


def test_radii_obey_the_pigeonhole_principle():
    for radius, segments, words in [(0, 1, 1), (2, 2, 1), (2, 5, 1), (26, 9, 2), (23, 8, 2), (3, 2, 1)]:
        tables = o.plan_segments(radius, segments, words)
        assert sum(2 * ball + 1 for *_, ball in tables) > radius
        places = [(w, b) for w, shift, width, _ in tables for b in range(shift, shift + width)]
        assert len(places) == len(set(places)) and all(0 <= b < 64 for _, b in places)
    with pytest.raises(ValueError):
        o.plan_segments(26, 8, 2)


@pytest.mark.parametrize("wide", [False, True])
def test_number_of_links_is_linear(spark, wide):
    """A group of n near copies of one fingerprint gives in the order of n links, in small buckets and large ones."""
    rng = random.Random(1)
    radius, segments = (26, 9) if wide else (2, 2)
    made = []
    for n in (500, 1000, 2000, 4000):
        centre, fps = rng.getrandbits(128), set()
        while len(fps) < n:
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(128 if wide else 64), rng.randint(1, 9 if wide else 3))))
        rows = [(i, o.signed(f & (1 << 64) - 1), o.signed(f >> 64), 1) for i, f in enumerate(sorted(fps))]
        df = spark.createDataFrame(rows, "id long, fp long, more long, size int")
        made.append(o.links(df, radius, segments, ("fp", "more")[: 1 + wide], 0.8).count() / n)
    assert max(made) <= segments * (o.LEAST_PREFIX + 1) and made[-1] <= 2 * made[0]


def test_edge_cases(spark):
    rows = [(3, "a b c d", "x"), (1, "A B  c\nd", None), (2, None, "y"), (5, "", "y"), (5, "", "y"), (None, "q r s t u", "z"), (None, None, "z"), (7, "w " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"] or -1) for r in o.near_duplicates(docs).collect())
    assert len(got) == len(rows)
    assert sorted((d, c) for d, _, c in got) == [(-1, -1), (-1, 2), (1, 1), (2, 2), (3, 1), (5, 2), (5, 2), (7, 7)]
    assert all(len(f) == 16 for _, f, _ in got)
    assert o.near_duplicates(docs.where("false")).count() == 0


def test_rows_without_id_bridge(spark, monkeypatch):
    """A fingerprint that only rows without a doc_id have links those on either side of it."""
    made = spark.createDataFrame([(4, 0), (None, 3), (9, 15)], "doc_id long, fp long")
    monkeypatch.setattr(o, "fingerprints", lambda docs, words: made)
    got = {(r["doc_id"], r["fingerprint"][-1], r["component_id"]) for r in o.near_duplicates(made).collect()}
    assert got == {(4, "0", 4), (None, "3", 4), (9, "f", 4)}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in o.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {k: v[0] for k, v in rows.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: v[1] for k, v in rows.items()} == brute(list(prints.items()), lambda a, b: bin(a[0] ^ b[0]).count("1") <= 2)
