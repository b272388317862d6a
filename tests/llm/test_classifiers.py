import zlib

import numpy as np
from pyspark.sql import functions as F

from kinmatch.llm import op07_quality, op09_toxicity
from kinmatch.llm.queries import queries

LARGE = "/root/testdata/sf0.1"
ROWS = [(1, "fine words here", "x"), (2, None, "x"), (2, "", "y"), (None, "ok", None), (3, "you are a stupid idiot. " * 5000, "z"), (3, "a", "z")]


def held_out(spark, name, label):
    rows = queries()[name](spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_held_out_rows(spark):
    score, predicted, label = held_out(spark, "op7_quality", "quality")
    assert (predicted == (score >= 0.3)).all()
    assert (predicted == label).mean() > 0.99 and predicted[label == 1].mean() > 0.99


def test_toxicity_on_held_out_rows(spark):
    score, predicted, label = held_out(spark, "op9_toxicity", "toxic")
    assert (predicted == (score >= 0.5)).all()
    assert predicted[label == 1].mean() > 0.85 and predicted[label == 0].mean() < 0.02


def test_rows_of_all_kinds(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    forest, model = op07_quality.fit(docs, labels), op09_toxicity.fit(docs, labels)
    for got in (op07_quality.score(odd, forest), op09_toxicity.score(odd, model)):
        rows = got.collect()
        assert sorted(r["doc_id"] or -1 for r in rows) == [-1, 1, 2, 2, 3, 3] and all(0 <= r["score"] <= 1 for r in rows)
    assert op07_quality.score(odd.where("false"), forest).count() == op09_toxicity.score(odd.where("false"), model).count() == 0
    kept = op09_toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.where("text like '%stupid%'").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert op07_quality.keep_good(docs, forest).schema == docs.schema


def test_without_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in op07_quality.score(docs, op07_quality.fit(docs, none)).collect()} == {0.5}
    model = op09_toxicity.fit(docs, none)
    odd = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    assert {r["doc_id"]: r["score"] >= 0.5 for r in op09_toxicity.score(odd.where("doc_id = 3 and length(text) > 9 or doc_id = 1"), model).collect()} == {1: False, 3: True}
    twice = spark.createDataFrame([(0, None, None), (0, 1, 0), (0, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    op07_quality.fit(docs, twice), op09_toxicity.fit(docs, twice)


def test_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    forest = op07_quality.train(x, y, np.ones(600), trees=30, depth=3)

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while np.isfinite(forest.threshold[at]):
                at = forest.left[at] + (row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        return total

    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.97


def test_held_out_rows_are_not_learnt_from(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = op07_quality.fit(docs, labels), op07_quality.fit(docs, flipped)
    assert (a.value == b.value).all()


def test_grammar_weighs_clauses():
    g = op09_toxicity.Grammar({"idiot": 4.0}, {"moron": 2.0})
    plain = g.clause("an idiot")
    assert g.clause("idiot") == g.clause("nice day") == 0  # a word by itself is no clause
    assert g.clause("you idiot") > plain > g.clause("she said idiot") > 0
    assert g.clause("idiot that you are") > plain > g.clause("an idiot, he said") > 0  # on either side
    assert g.clause("not an idiot") < plain and g.clause("he is never idiot") < plain
    assert g.clause("kill you") > g.clause("never kill you") > 0 and g.clause("kill time") == g.clause("you kill time") == 0
    assert g.clause("you will be killed") == g.clause("killing you") == 2.0 > g.clause("they said killing you")
    assert g.clause("a moronic one") == 2.0
    assert np.isclose(g.features("An idiot. Another idiot!")[3], np.log(3)) and g.features("idiotic videotape")[3] == 0


def test_whole_clauses_are_read():
    """However far a target, a report or the one threatened is from the word that hits."""
    g = op09_toxicity.Grammar({"idiot": 4.0}, {})
    far = "word " * 50_000
    for text in (f"you {far}idiot", f"idiot {far}you", f"idiot {far}he said", f"i will kill {far}you", f"said {far}idiot {far}you"):
        assert g.features(text)[2] == g.clause(text) == g.clause(text.replace(far, "word ")) > 0
    assert g.features("Idiot! Go away. Fine day.")[2] == 4.0 and g.features("A! idiot! B! C! D.")[2] > 0 and g.features("Idiot!")[2] == 0


def test_clauses_are_a_partition():
    for text in ("", "one", "one. two three. four", "a! b! c! d! e", "...", "a b. . .\n\nc d; e"):
        ends = op09_toxicity.clauses(text)
        assert ends[-1] == len(text) and ends == sorted(set(ends))
        parts = [text[i:j].split() for i, j in zip([0, *ends], ends)]
        assert len(parts) == 1 or all(len(op09_toxicity.WORD.findall(" ".join(p))) > 1 for p in parts)


def test_composed_machine_is_its_machines_one_by_one():
    words = {0: "idiot", 1: "kill", 2: "killed", 3: "you", 4: "not", 5: "said", 6: "the"}
    g = op09_toxicity.Grammar({"idiot": 4.0}, {})
    rng = np.random.default_rng(2)
    for n in [*range(7)] * 100:
        tags = rng.integers(0, 7, n).tolist()
        state = {name: next(iter(m)) for name, m in op09_toxicity.MACHINES.items()}
        insults = 0.0
        for t in tags:
            arcs = {name: m[state[name]].get(op09_toxicity.TAGS[t], (state[name], 1.0)) for name, m in op09_toxicity.MACHINES.items()}
            insults += (t == 0) * 4.0 * np.prod([f for _, f in arcs.values()])
            state = {name: x for name, (x, _) in arcs.items()}
        last = [np.prod([w.get(x, 1.0) for x in state.values()]) for w in (op09_toxicity.LAST_INSULT, op09_toxicity.LAST_THREAT)]
        assert np.isclose(g.clause(" ".join(words[t] for t in tags)), insults * last[0] + last[1])
    assert set(op09_toxicity.MACHINES) == {"insult", "threat", "target", "negation", "report"}
