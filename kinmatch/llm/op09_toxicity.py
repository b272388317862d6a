"""Toxicity by a weighted finite-state grammar of clauses.

Five small machines read a whole clause's words as tags and are composed into one weighted machine: an insult that is
said of something (a word by itself isn't a clause and scores nothing), a target on either side of it, negation before
it, reported speech on either side, and a threat, which needs a target. The weight with which the machine accepts a
clause is its score. Which words insult, and how strongly, is learnt from labelled documents, as whole words and as
beginnings of words; a small list of English ones is known beforehand. A logistic function of a document's clause
scores, fitted with lexicons that haven't seen the document, gives its score.

A clause ends at a sign of EDGE, but not before it has two words: "Idiot! Go away" is one. It is read whole, however
long it is, in time linear in its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod5, filter_arrow, map_arrow, only, stored

#: Labelled rows that are learnt from, at most, of either label.
MAX_TOXIC, MAX_CLEAN = 3000, 5000

INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting")
#: A verb's forms that threaten whom follows, and those that also do so in the passive.
THREATS = {
    "kill": ("kills", "killing"), "hurt": ("hurts", "hurting"), "destroy": ("destroys", "destroying"), "murder": ("murders", "murdering"),
    "strangle": ("strangles", "strangling"), "shoot": ("shoots", "shooting"), "beat": ("beats", "beating"),
}
PASSIVES = frozenset(("killed", "hurt", "destroyed", "murdered", "strangled", "shot", "beaten"))
ACTIVES = frozenset(x for verb, forms in THREATS.items() for x in (verb, *forms))
TARGETS = frozenset("you your u he him she her they them these those people".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't didn't won't can't nobody nicht kein pas nunca".split())
REPORTS = frozenset("said says say told called calls quoted wrote claims claimed alleged reported".split())
KNOWN = 3.0  # weight of a known insult that the labels don't mention
LEAST_WEIGHT, LEAST_DOCS, LEAST_Z = 1.5, 2, 3.5
LEAST_SHARE = 0.01  # of toxic documents that have a learnt word: fewer may be near copies of one
PREFIXES = range(4, 9)
WORD = re.compile(r"\w+(?:'\w+)?")
EDGE = re.compile(r"[.!?;:|\n]+")
TWO_WORDS = re.compile(r"\W*\w+\W+\w")

TAGS = "IHPTNRo"  # insult, threat, threat in the passive, target, negation, report, other
ANY = "HPTNRo"
#: Machines: state -> tag -> (next state, factor on an insult); a tag without an arc keeps the state at factor 1.
MACHINES = {
    "insult": {
        "blank": {"I": ("alone", 1.0), **{t: ("begun", 1.0) for t in ANY}},
        "alone": {t: ("said", 1.0) for t in ANY},
        "begun": {"I": ("said", 1.0)},
        "said": {},
    },
    "target": {
        "none": {"T": ("aimed", 1.0), "I": ("open", 1.0)},
        "aimed": {"I": ("met", 1.0)},
        "open": {"T": ("met", 1.0)},
        "met": {},
    },
    "negation": {
        "plain": {"N": ("near", 1.0)},
        "near": {"I": ("plain", 0.3), "H": ("denied", 1.0), "P": ("denied", 1.0), "o": ("far", 1.0)},
        "far": {"I": ("plain", 0.5), "H": ("denied", 1.0), "P": ("denied", 1.0), "o": ("plain", 1.0)},
        "denied": {"I": ("denied", 0.5)},
    },
    "report": {"own": {"R": ("reported", 1.0)}, "reported": {}},
    "threat": {
        "calm": {"H": ("armed", 1.0), "P": ("armed", 1.0), "T": ("before", 1.0)},
        "before": {"H": ("armed", 1.0), "P": ("threat", 1.0)},
        "armed": {"T": ("threat", 1.0)},
        "threat": {},
    },
}
#: What the states in which a clause ends multiply its insults' weights by, and its threat's; states not named: 1.
LAST_INSULT = {"blank": 0.0, "alone": 0.0, "begun": 0.0, "met": 1.25, "reported": 0.5}
LAST_THREAT = {"calm": 0.0, "before": 0.0, "armed": 0.0, "threat": 2.0, "denied": 0.2, "reported": 0.5}


def compose(machines: dict = MACHINES) -> tuple[list[list[int]], list[list[float]], list[tuple[float, float]]]:
    """The product of all machines as arrays: the next state and the factor by state and tag, the last factors by state."""
    states = list(product(*machines.values()))
    number = {s: i for i, s in enumerate(states)}
    moves, factors, last = [], [], []
    for s in states:
        arcs = [[m[x].get(t, (x, 1.0)) for m, x in zip(machines.values(), s)] for t in TAGS]
        moves.append([number[tuple(x for x, _ in a)] for a in arcs])
        factors.append([math.prod(f for _, f in a) for a in arcs])
        last.append(tuple(math.prod(w.get(x, 1.0) for x in s) for w in (LAST_INSULT, LAST_THREAT)))
    return moves, factors, last


MOVES, FACTORS, LAST = compose()
#: The tags of words other than insults; what is in several lists is the first.
KNOWN_TAGS = {w: tag for tag, words in reversed(list(enumerate((ACTIVES - PASSIVES, PASSIVES, TARGETS, NEGATIONS, REPORTS), 1))) for w in words}


class Grammar:
    """The machine with a lexicon: weights of words and of beginnings of words."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes = words, prefixes
        self.automaton = ahocorasick.Automaton()
        for w in [*(w for w, x in words.items() if x > 0), *prefixes, *ACTIVES, *PASSIVES]:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def weight(self, word: str) -> float:
        if (w := self.words.get(word)) is not None:
            return w
        return next((w for n in reversed(PREFIXES) if len(word) > n and (w := self.prefixes.get(word[:n])) is not None), 0.0)

    def tagged(self, text: str) -> Iterator[tuple[int, float]]:
        """The tag of each word of a text in lower case, and its weight if it is an insult."""
        for word in WORD.findall(text):
            w = self.weight(word)
            yield (0, w) if w > 0 else (KNOWN_TAGS.get(word, len(TAGS) - 1), 0.0)

    def clause(self, text: str) -> float:
        """The weight with which the composed machine accepts a clause, in lower case; 0 if it matches nothing."""
        state, insults = 0, 0.0
        for tag, w in self.tagged(text):
            insults += w * FACTORS[state][tag]
            state = MOVES[state][tag]
        return insults * LAST[state][0] + LAST[state][1]

    def features(self, text: str) -> list[float]:
        """Of a whole text: its distinct clauses' weights in sum, by its length, the largest and their number; its length.

        A clause that a text repeats is no further evidence and counts once.
        """
        low = text.lower()
        hits = [end - n + 1 for end, n in self.automaton.iter(low) if end - n < 0 or not (low[end - n].isalnum() or low[end - n] == "_")]
        scores = []
        if hits:
            ends = clauses(low)
            matched = (low[ends[at - 1] if at else 0 : ends[at]] for at in sorted({bisect_right(ends, h) for h in hits}))
            scores = [x for x in map(self.clause, dict.fromkeys(c.strip() for c in matched)) if x > 0]
        words = low.count(" ") + low.count("\n") + 1
        total = sum(scores)
        return [math.log1p(total), math.log1p(1000 * total / (words + 20)), max(scores, default=0.0), math.log1p(len(scores)), math.log(words)]


def clauses(text: str) -> list[int]:
    """Where each clause of a text ends; the last is the text's end. Each has two words at least, if the text has them."""
    ends, begin = [], 0
    for m in EDGE.finditer(text):
        if TWO_WORDS.match(text, begin, m.start()):
            begin = m.end()
            ends.append(begin)
    if ends and not TWO_WORDS.match(text, begin):
        ends.pop()
    return [*ends, len(text)]


N_FEATURES = 5


def terms(text: str) -> set[str]:
    """The distinct words and, marked by a star, beginnings of words of a text."""
    words = set(WORD.findall(text.lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def count_terms(sample: DataFrame) -> DataFrame:
    """``(term, pos0, neg0, pos1, neg1)``: in how many documents of either fold and label a term occurs."""
    schema = "term string, pos0 long, neg0 long, pos1 long, neg1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]
        for b in batches:
            for text, label, fold in zip(*(b.column(c).to_pylist() for c in ("text", "label", "fold"))):
                counts[2 * fold + (1 - label)].update(terms(text or ""))
        names = list(set().union(*counts))
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in counts)],
                names=["term", "pos0", "neg0", "pos1", "neg1"],
            )

    made = sample.mapInArrow(run, schema)
    return made.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("pos0", "neg0", "pos1", "neg1")])


def lexicon(counts: list[tuple], n_pos: int, n_neg: int) -> Grammar:
    """The grammar for (term, pos, neg) counts of documents, of ``n_pos`` toxic and ``n_neg`` other ones."""
    seen = {t: (p, n) for t, p, n in counts}

    def log_odds(p: float, n: float) -> float:
        return math.log((p + 0.1) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))

    def z(p: int, n: int) -> float:
        a, b, c = p / max(n_pos, 1), n / max(n_neg, 1), (p + n) / max(n_pos + n_neg, 1)
        return (a - b) / math.sqrt(max(c * (1 - c), 1e-9) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)))

    def strong(p: int, n: int, docs: int) -> bool:
        return p >= max(docs, LEAST_SHARE * n_pos) and log_odds(p, n) >= LEAST_WEIGHT and z(p, n) >= LEAST_Z

    begun = Counter(t[:k] for t, (p, _) in seen.items() if t[-1] != "*" and p for k in PREFIXES if len(t) > k)
    prefixes = {
        t[:-1]: log_odds(p, n) for t, (p, n) in seen.items() if t[-1] == "*" and begun[t[:-1]] > 2 and strong(p, n, 2 * LEAST_DOCS)
    }  # one or two words don't make a stem
    words = {w: max(KNOWN, log_odds(*seen.get(w, (0, 0)))) for w in INSULTS}
    for t, (p, n) in seen.items():
        if t[-1] == "*" or t in words:
            continue
        start = next((t[:k] for k in reversed(PREFIXES) if len(t) > k and t[:k] in prefixes), None)
        if start:  # drawn to what its beginning has, the more the rarer it is
            a, b = seen[start + "*"]
            words[t] = max(0.0, log_odds(p + 2 * a / (a + b), n + 2 * b / (a + b)))
        elif strong(p, n, LEAST_DOCS):
            words[t] = log_odds(p, n)
        elif t in prefixes:
            words[t] = 0.0
    return Grammar(words, prefixes)


def evidence_only_adds(x: np.ndarray, y: np.ndarray, weight: np.ndarray, evidence: int) -> np.ndarray:
    """Logistic coefficients of which the first ``evidence`` aren't negative: those that would be are left out in turn."""
    used = list(range(x.shape[1]))
    while True:
        beta = np.zeros(x.shape[1] + 1)
        beta[[*used, -1]] = logistic(x[:, used], y, weight)
        if not (wrong := [j for j in used if j < evidence and beta[j] < 0]):
            return beta
        used.remove(min(wrong, key=lambda j: beta[j]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """``(text, label, fold, weight)`` of at most ``most[label]`` labelled rows, and how many there are of each label.

    Only rows whose crc32(doc_id) modulo 5 isn't 0 are taken, by ascending hash of doc_id; the rest are held out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where(f"label in ({', '.join(map(str, most))})").where(crc_mod5("doc_id") != 0)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))  # a doc_id that is labelled twice counts once
    totals = {int(r[0]): int(r[1]) for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in most.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold")
    # the sample is bounded by the parameters, so it can be sent to all
    joined = only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    return joined.select(F.coalesce("text", F.lit("")).alias("text"), "label", fold), totals


class Model:
    def __init__(self, grammar: Grammar, beta: np.ndarray):
        self.words, self.prefixes, self.beta = grammar.words, grammar.prefixes, beta


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learns from at most ``max_toxic`` and ``max_clean`` labelled rows; without any, known insults alone count."""
    sample, totals = labelled_sample(docs, labels, "toxic", {1: max_toxic, 0: max_clean})
    sample = stored(sample.dropDuplicates(["text", "label"]))  # copies of a document are no further evidence for its words
    sizes = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    counts = stored(count_terms(sample))
    n = lambda label, *folds: sum(sizes.get((f, label), 0) for f in folds)
    n_pos, n_neg = max(1, n(1, 0, 1)), max(1, n(0, 0, 1))
    pos, neg = F.col("pos0") + F.col("pos1"), F.col("neg0") + F.col("neg1")
    share = (pos + neg) / (n_pos + n_neg)
    z = (pos / n_pos - neg / n_neg) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n_pos + 1 / n_neg))
    # only terms that toxic documents have clearly more often come to the driver, and words that begin like those
    marked = counts.where((pos >= LEAST_DOCS) & (z >= LEAST_Z - 0.5) & (pos / n_pos >= 3 * neg / n_neg))
    worth = marked.unionByName(counts.where(F.col("term").isin(*INSULTS)))
    stems = marked.where(F.col("term").endswith("*")).select(F.expr("left(term, length(term) - 1)").alias("stem"))
    near = counts.where(~F.col("term").endswith("*")).withColumn("stem", F.explode(F.transform(F.array(*[F.lit(k) for k in PREFIXES]), lambda k: F.left("term", k))))
    near = near.join(stems, "stem", "left_semi").drop("stem")
    rows = [tuple(r) for r in worth.unionByName(near).distinct().collect()]
    whole = lexicon([(t, a + c, b + d) for t, a, b, c, d in rows], n(1, 0, 1), n(0, 0, 1))
    halves = [lexicon([(t, c, d) for t, a, b, c, d in rows], n(1, 1), n(0, 1)), lexicon([(t, a, b) for t, a, b, c, d in rows], n(1, 0), n(0, 0))]
    given = [(g.words, g.prefixes) for g in halves]

    def make():
        made = [Grammar(*g) for g in given]

        def each(batch):
            rows = [made[f].features(t) for t, f in zip(batch["text"], batch["fold"])]
            return {"label": batch["label"], **{f"x{i}": [r[i] for r in rows] for i in range(N_FEATURES)}}

        return each

    schema = T.StructType([T.StructField("label", T.IntegerType()), *[T.StructField(f"x{i}", T.DoubleType()) for i in range(N_FEATURES)]])
    got = map_arrow(sample, make, schema).toPandas()
    y = got["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return Model(whole, np.array([1.5, 0.0, 0.5, 0.0, -0.2, -3.0]))
    share = {k: totals[k] / max(1, n(k, 0, 1)) for k in totals}
    x = got.drop(columns="label").to_numpy()
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    x, y = x[order], y[order]
    return Model(whole, evidence_only_adds(x, y, np.array([share[int(v)] for v in y]), evidence=4))


def scorer(model: Model):
    """A function of texts that returns their scores; to be made once a task."""
    grammar = Grammar(model.words, model.prefixes)

    def each(texts: list[str | None]) -> list[float]:
        x = np.array([grammar.features(t or "") for t in texts]).reshape(-1, N_FEATURES)
        return (1 / (1 + np.exp(-np.clip(x @ model.beta[:-1] + model.beta[-1], -30, 30)))).tolist()

    return each


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, the probability that a document is toxic, for each row of ``docs (doc_id, text)``.

    A null or empty text has the score of a text that matches nothing; texts are read whole; repeated rows give
    repeated results; an empty table gives an empty one.
    """

    def make():
        of = scorer(model)
        return lambda batch: {"doc_id": batch["doc_id"], "score": of(batch["text"])}

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return map_arrow(only(docs, doc_id="long", text="string"), make, schema)


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores below the threshold."""

    def make():
        of = scorer(model)
        return lambda texts: [s < below for s in of(texts)]

    return filter_arrow(docs, "text", make)
