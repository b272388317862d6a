import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.llm import op04_iblt as o
from kinmatch.llm.queries import op4_iblt


def parts_of(text):
    """A text's parts, found code point by code point."""
    short = len(text) < o.SHORT
    least, most = o.SHORT_PART if short else o.PART

    def ends(line, i):  # whether a part may end before i
        c = line[i - 1]
        if c in " \t":
            return short or (i > 1 and 32 <= ord(line[i - 2]) < 0x3000 and ord(line[i - 2]) % 32 < 4)
        if short:
            return False
        return c in "。！？" or (c in "0123" and i < len(line) and line[i] in "ABCabc")

    for line in text.split("\n"):
        at = 0
        while at < len(line):
            stop = next((i for i in range(at + least + 1, min(at + most, len(line)) + 1) if ends(line, i)), min(at + most, len(line)))
            yield line[at:stop]
            at = stop


def plain_digests(spark, texts):
    """The digests of each text, made from a list of parts in Python; the hash itself is Spark's."""
    parts = [Counter(parts_of(t)) for t in texts]
    wanted = sorted({(p, i) for c in parts for p, n in c.items() for i in range(n)})
    df = spark.createDataFrame([("", -1), *wanted], "p string, i int")
    hashed = {(r["p"], r["i"]): r["d"] for r in df.select("p", "i", F.xxhash64(F.xxhash64("p"), "i").alias("d")).collect()}
    return [{hashed[p, i] for p, n in c.items() for i in range(n)} for c in parts]


def near(spark, pairs):
    """(likeness, by sets) of pairs of texts, after the digests that differ have been held against the sets'."""
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.withColumn("x", o.digests(F.col("a"))).withColumn("y", o.digests(F.col("b")))
    df = df.withColumn("d", o.differing(F.col("x"), F.col("y"), o.sketch(F.col("x")), o.sketch(F.col("y"))))
    df = df.select("i", "x", "y", "d", o.likeness(F.col("x"), F.col("y"), F.col("d")).alias("l"))
    want = plain_digests(spark, [t for p in pairs for t in p])
    out = []
    for r in df.orderBy("i").collect():
        x, y = want[2 * r["i"] : 2 * r["i"] + 2]
        assert sorted(r["x"]) == sorted(x) and sorted(r["y"]) == sorted(y)
        assert sorted(r["d"]["first"]) == sorted(x - y) and sorted(r["d"]["second"]) == sorted(y - x)
        out.append((r["l"], len(x & y) / len(x | y) if x | y else 1.0))
    return out


LONG = "\n".join(f"line {i} " + "word " * (i % 9) for i in range(900))


def test_likeness_is_exact(spark):
    pairs = [
        ("", ""), ("", "a"), ("a", "a"), ("a\nb\nc" * 30, "a\nb\nd" * 30), ("x\n" * 500, "x\n" * 499), ("x " * 5000, "x " * 4000 + "y"),
        (LONG, LONG[:-4000] + "z"), (LONG, "q" + LONG[5000:]), (LONG, "other\n" * 3), ("é" * 700, "é" * 650),
    ]
    for got, want in near(spark, pairs):
        assert got == pytest.approx(want)


def test_very_long_texts(spark):
    """Of 60,000 paragraphs, all of which differ or some, some repeated very often; in about linear time."""
    many = "\n".join(f"p{i}" for i in range(60_000))
    for got, want in near(spark, [(many, many.replace("7", "8")), ("same\n" * 60_000, "same\n" * 50_000 + many[:9000]), ("x" * 200_000, "y" * 200_000)]):
        assert got == pytest.approx(want)


def test_failing_retries_are_tried_again(spark, monkeypatch):
    """With tables for so many digests that the first of them can't be peeled; and with none that can, there is no result."""
    monkeypatch.setattr(o, "A_TABLE", 16)
    for got, want in near(spark, [(LONG, LONG[:-20_000]), (LONG, "other\n" * 3)]):
        assert got == pytest.approx(want)
    monkeypatch.setattr(o, "ROUNDS", 1)
    with pytest.raises(Exception, match="no table tells apart"):
        near(spark, [(LONG, "other\n" * 3)])


def test_where_an_edit_stands_makes_no_difference(spark):
    lines = [f"paragraph {i} " + "word " * (i % 5) for i in range(60)]
    made = ["\n".join([*lines[:at], "quite another", *lines[at + 1 :]]) for at in (0, 30, 59)]
    assert len({got for got, _ in near(spark, [("\n".join(lines), m) for m in made])}) == 1


@given(st.lists(st.tuples(st.text("ab\n", max_size=60), st.text("ab\n", max_size=60)), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_texts(spark, pairs):
    for got, want in near(spark, pairs):
        assert got == pytest.approx(want)


def words(n, letters="abcdefghijklmnopqrstuvwxyz", blank=" ", often=45):
    """A line of n characters of words that a hash makes."""
    made = hashlib.shake_256(letters.encode()).digest(2 * n)
    return "".join(blank if made[i + n] < often else letters[made[i] % len(letters)] for i in range(n))


@pytest.mark.parametrize("line", [words(17_000), words(17_000, "абвгдежзиклмнопрстуфхцчшщыэюя"), words(17_000, "一二不三的是在我有他这中大来上国个到说们", "。", 8), words(17_000, "ABCDEFGHabcdefgh0123456789+/", "k")])
def test_what_is_put_in_changes_little(spark, line):
    """A character, or a sentence, put before a line, or into its midst."""
    pairs = [(line, "x" + line), (line, "Quite another beginning of it. " + line), (line, line[:8000] + "something else" + line[8000:])]
    for got, want in near(spark, pairs):
        assert got == pytest.approx(want) and got >= 0.9


def test_short_texts_keep_a_likeness(spark):
    """No text of more than 64 characters is wholly unlike itself with another last quarter."""
    texts = [words(n + 26)[26:] for n in range(65, 700, 9)]
    pairs = [(t, t[: len(t) - len(t) // 4] + "Z" * (len(t) // 4)) for t in texts]
    assert all(got == pytest.approx(want) and got > 0 for got, want in near(spark, pairs))


def brute_edit(docs):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        yield d, t, t[: len(t) - q] + after[:q]


def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op4_iblt(spark, sf).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for d, t, e in brute_edit(docs):
        assert (by[d]["n_chars"], by[d]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= by[d]["near_next"] <= 1 and 0 <= by[d]["near_edited"] <= 1
    of_text = {}
    for d, t in docs:
        assert of_text.setdefault(t, by[d]["fingerprint"]) == by[d]["fingerprint"]
    assert len(set(of_text.values())) == len(of_text)
    long = [by[d] for d, t in docs if len(t) > 400]
    assert all(r["near_edited"] > 0.2 + r["near_next"] for r in long) or sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)


def test_edge_cases(spark):
    docs = [(5, "abcdefgh"), (2, None), (None, "null id first"), (9, ""), (7, "éèê" * 10)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, edited string")
    got = {r["doc_id"]: r for r in o.fingerprints(o.edited_pairs(df)).collect()}
    assert {(d, r["text"], r["edited"]) for d, r in got.items()} == set(brute_edit(docs))
    same = o.edited_pairs(spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (1, "bbbb"), (3, "cccc")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in same) == [(1, "aaaa"), (1, "aaaa"), (1, "bbbb"), (3, "cccc")]
    alone = o.edited_pairs(df.where("doc_id = 5")).first()
    assert alone["edited"] == "abcdefab"
    assert o.fingerprints(o.edited_pairs(df.where("false"))).count() == 0


def test_no_python_on_the_main_path(spark, sf):
    plan = op4_iblt(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_ends_of_content_by_code_point(spark):
    """A blank ends a part after one of four code points of each 32 up to U+2FFF; full stops without blanks end one, too."""
    from kinmatch.llm.op04_iblt import ENDS

    every = spark.range(1, 0x11000).where("id < 55296 or id > 57343")
    text = F.concat(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), F.lit(" "))
    want = F.col("id").between(0x20, 0x2FFF) & (F.col("id") % 32 < 4) | F.col("id").isin(0x3002, 0xFF01, 0xFF1F)
    assert every.where(text.rlike(ENDS) != want).count() == 0
