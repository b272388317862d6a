import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import identifiers, schedule, spell, text, uom, vectors


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_clean_str(spark):
    got = one(spark, [None, "NaN", "None", "none", " none ", "\t a ", ""], text.clean_str)
    assert got == ["", "", "", "", "none", "a", ""]


def test_normalize_identifier(spark):
    cases = {"12345-1234567-1": "1234512345671", "0786": "786", "PK36SCBL0000001123456702": "PK36SCBL0000001123456702", "000": "0", "-": "", None: "", "n/a": "NA"}
    assert one(spark, list(cases), identifiers.normalize_identifier) == list(cases.values())


CASES = {
    "IM#445599": "IM # 445599", "IM # 445599": "IM # 445599", "20mm": "20 mm", "20 mm": "20 mm", "@120": "@ 120", "PRONG:100": "PRONG: 100",
    "1,5": "1.5", "1,000": "1,000", "80023220_120C": "80023220 _120C", "40's": "40s", "1015(186GSM)": "1015 186 GSM", "1/2IN": "1/2IN",
    "120/2": "120/2", "10-12": "10-12", "1.5mm": "1.5 mm", "170GSM": "170 GSM", "": "", None: "", "“Big” bolt": "Big bolt", "é's": "és",
    "A – B": "A – B", "ﬁne": "fine",
}


def test_normalize_description(spark):
    assert one(spark, list(CASES), text.normalize_description) == list(CASES.values())


def test_passes_differ(spark):
    assert one(spark, ["1,5,5"], lambda c: text.normalize_description(c, passes=1)) == ["1.5,5"]
    assert one(spark, ["1,5,5"], lambda c: text.normalize_description(c, passes=2)) == ["1.5.5"]


def test_split(spark):
    values = ["120/2,", "BOLT 20mm", "10 20", "20 10", None, ",;"]
    assert one(spark, values, lambda c: text.text_part(text.normalize_description(c))) == ["", "BOLT mm", "", "", "", ""]
    assert one(spark, values, lambda c: text.numeric_part(text.normalize_description(c))) == ["120/2", "20", "10 20", "20 10", "", ""]


UNITS = {
    "kgs": "KILOGRAM", "KG": "KILOGRAM", "Pkt": "PACKET", "packets": "PACKET", "m": "MICRON", "yd": "SQUARE_YARD", "gm": "GSM",
    "foo-bar": "FOOBAR", "%": "", None: "", "metres": "METER", "boxes": "BOX", "inches": "INCH", "sq. metre": "SQUARE_METER", "PCS": "PIECE",
}


def test_canonical_uom(spark):
    assert one(spark, list(UNITS), uom.canonical_uom) == list(UNITS.values())
    strict = one(spark, ["m", "yd", "gm"], lambda c: uom.canonical_uom(c, strict=True))
    assert strict == ["METER", "YARD", "GRAM"]


def test_uom_table_has_each_unit():
    assert set(uom.aliases().values()) == set(uom.UNITS)
    assert len(uom.UNITS) == 74


def test_next_slot(spark):
    day = dt.datetime(2024, 5, 1)
    df = spark.createDataFrame([(day.replace(hour=9, minute=15),), (day.replace(hour=12),), (day.replace(hour=23, minute=59),)], "t timestamp")
    got = [r[0] for r in df.select(schedule.next_slot(F.col("t"))).collect()]
    assert got == [day.replace(hour=12), day.replace(hour=16), day + dt.timedelta(days=1)]


def test_spelling():
    s = spell.Speller([("bolt", 5), ("bold", 9), ("valve", 3)])
    units = spell.uom_tokens()
    assert spell.correct("BOTL valve, 20mm STEEL kgs ab qqqqqq", s, units) == "BOLT valve 20mm STEEL kgs ab qqqqqq"
    assert s.closest("bolx") == ("bold", 1)  # as near as bolt, and more frequent
    assert spell.correct(None, s, units) == ""


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=150, deadline=None)
def test_distance_is_symmetric(a, b):
    assert spell.distance(a, b) == spell.distance(b, a) <= max(len(a), len(b))
    assert (spell.distance(a, b) == 0) == (a == b)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "red bolt"), (2, "BOLT red"), (3, None)], "i int, t string")
    rows = vectors.embed(df, "t", vectors.HashedTokens(64)).orderBy("i").collect()
    assert rows[0]["embedding"] == rows[1]["embedding"]
    assert sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1)
    assert set(rows[2]["embedding"]) == {0.0}


def test_spelling_by_joins_equals_spelling_by_word(spark):
    terms = [("bolt", 5), ("bold", 9), ("valve", 3), ("ab", 1), ("gearwheel", 2)]
    values = ["BOTL valve, 20mm STEEL kgs ab qqqqqq", "bolx", None, "", "  ,; ", "vlve;  gearwhel (bolt)", "x" * 5000 + " boltt", "VALVE. bolt", "bolx"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    made = spell.correct_texts(df, "v", spark.createDataFrame(terms, "term string, frequency long"))
    s, units = spell.Speller(terms), spell.uom_tokens()
    assert [r["corrected"] for r in made.orderBy("i").collect()] == [spell.correct(v, s, units) for v in values]
    none = spell.correct_texts(df, "v", spark.createDataFrame([], "term string, frequency long"))
    assert {r["corrected"] for r in none.where("i = 1").collect()} == {"bolx"}
    assert spell.correct_texts(df.limit(0), "v", spark.createDataFrame(terms, "term string, frequency long")).count() == 0


def test_terms_of_a_table(spark):
    df = spark.createDataFrame([("Red bolt, 20mm",), ("bolt of",), (None,)], "t string")
    assert sorted(map(tuple, spell.term_frequencies(df, "t").collect())) == [("bolt", 2), ("red", 1)]


def test_token_classes(spark):
    values = ["20mm", "1/2IN", "10X20", '3"x4"', "5'", "1,000", "mm", "Kg", "BOLT", "x20", None]
    assert one(spark, values, text.is_dimension) == [True] * 6 + [False] * 5
    assert one(spark, values, text.is_unit) == [False] * 6 + [True, True, False, False, False]
    assert one(spark, ["(w:)", "a#.b,"], text.bare_token) == ["W", "AB"]


def test_halves_where_memory_is_short():
    sizes = []

    def small(texts):
        sizes.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return vectors.HashedTokens(8)(texts)

    texts = ["a", "b c", "d", "e f", "g"]
    assert (vectors.in_halves(small, texts) == vectors.HashedTokens(8)(texts)).all()
    assert sizes == [5, 2, 3, 1, 2]
    with pytest.raises(MemoryError):
        vectors.in_halves(lambda t: (_ for _ in ()).throw(MemoryError()), ["a"])


def test_model_is_loaded_once():
    loads = []
    model = vectors.Model("m", lambda: loads.append(1) or vectors.HashedTokens(8))
    model(["a"]), model(["b"])
    assert loads == [1]


@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9), st.integers(0, 3))
@settings(max_examples=600, deadline=None)
def test_bounded_distance(a, b, most):
    want = spell.distance(a, b)
    assert spell.within(a, b, most) == (want if want <= most else None)


@given(st.lists(st.text(alphabet="abcd", min_size=1, max_size=11), min_size=1, max_size=12), st.text(alphabet="abcd", min_size=1, max_size=11))
@settings(max_examples=300, deadline=None)
def test_beginnings_lose_no_term(terms, word):
    """Terms longer and shorter than the beginning that is taken apart, against all distances."""
    s = spell.Speller([(t, i) for i, t in enumerate(terms)])
    ranked = sorted((spell.distance(word, t), -f, t) for t, f in s.frequency.items())
    want = (ranked[0][2], ranked[0][0]) if ranked[0][0] <= 2 else None
    assert s.closest(word) == want


def test_closest_terms_as_by_all_distances(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 10)))
    terms = {word(): rng.randint(1, 5) for _ in range(60)}
    long = "x" * 100_000
    terms[long] = 9
    words = sorted({word() for _ in range(80)} | {long[1:], long[:-2] + "y", "x" * 50, long + "zzz"} | set(list(terms)[:5]))
    got = spell.closest_terms(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(terms.items()), "term string, frequency int"))
    want = {}
    for w in words:
        near = [(n, -f, t) for t, f in terms.items() for n in [spell.within(w, t, 2)] if n is not None]
        if near:
            want[w] = min(near)[2], min(near)[0]
    assert {r["word"]: (r["term"], r["edits"]) for r in got.collect()} == want
    assert want[long[1:]] == (long, 1) and want[long[:-2] + "y"] == (long, 2) and long + "zzz" not in want


def test_few_rows_a_term(spark):
    rests = spark.createDataFrame([("abcdefghij" * 3000,)], "t string").select(F.size(spell._deletes(F.col("t"), 2, spell.PREFIX)))
    assert rests.first()[0] == 29


def test_rare_words_are_corrected_to_frequent_ones(spark):
    rows = spark.createDataFrame([("bolt steel",)] * 5 + [("blot stel",)], "t string")
    fixed = spell.correct_texts(rows.where("t = 'blot stel'"), "t", spell.term_frequencies(rows, "t", least=3))
    assert fixed.first()["corrected"] == "BOLT STEEL"


def test_hashed_tokens_tell_words_apart(spark, sf):
    """At the default width, all words of the tables and their numbers: none equal, none alike; and sentences' cosines nearly exact."""
    words = {w for c, t in (("p_name", "part"), ("p_type", "part"), ("c_name", "customer"), ("s_name", "supplier"), ("c_mktsegment", "customer")) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).distinct().collect() for w in r[0].lower().split()}
    words = sorted(words | {str(i) for i in range(1200)})
    v = vectors.HashedTokens()(words).astype(float)
    off = np.abs(v @ v.T - np.eye(len(words)))
    assert off.max() < 0.6 and (off ** 2).mean() ** 0.5 < 0.04
    many = vectors.HashedTokens()([f"vendor {i} building" for i in range(800)]).astype(float)
    assert np.abs(many @ many.T - (1 / 3 * np.eye(800) + 2 / 3)).max() < 0.9 - 2 / 3
