"""Quality by histogram gradient-boosted trees over document statistics.

The statistics of each whole text are computed in numpy; trees are grown on their histograms, a level at a time, from
a bounded sample of labelled rows, and flattened into arrays (feature, threshold, left child, value) which all rows of
a batch walk down together.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod5, filter_arrow, map_arrow, only

#: Labelled rows that are learnt from, at most, of either label.
MAX_GOOD, MAX_POOR = 8000, 8000

NAMES = (
    "bytes", "words", "lines", "mean_word", "upper", "digit", "space", "high", "symbol", "comma", "stop", "pipe",
    "bang", "symbol_words", "distinct_words", "repeated_next", "commonest_word", "distinct_lines", "mean_line",
    "stop_words", "capital_words", "distinct_bytes", "entropy", "repeated_lines",
)

_KIND = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [
        "A" <= _c <= "Z", "0" <= _c <= "9", _c in " \t\r\n", _b >= 128,
        33 <= _b < 127 and not _c.isalnum() and _c not in ",.'", _c == ",", _c == ".", _c == "|", _c == "!",
    ]


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, by NAMES; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    kinds = counts @ _KIND / n
    share = counts[counts > 0] / n
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    often = Counter(words)
    by_line = Counter(lines)
    same = sum(map(bytes.__eq__, words, words[1:]))
    ends = bytes(x[-1] for x in words)
    starts = bytes(x[0] for x in words)
    k = max(1, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), (n - counts[32]) / w, *kinds.tolist(),
        sum(ends.count(x) for x in b"#$%&*!|~^=+") / w, len(often) / w, same / w, max(often.values(), default=0) / w,
        len(by_line) / k, np.log1p(n / k), sum(ends.count(x) for x in b".!?") / w,
        sum(65 <= x <= 90 for x in starts) / w, float(len(share)), float(-(share * np.log2(share)).sum()),
        1 - len(by_line) / k,
    ]


@dataclass
class Forest:
    """All trees as one set of arrays: at a node, rows with ``x[feature] > threshold`` go to ``left + 1``, others left."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of leaves of each row, over all trees at once."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
    ridge: float = 5.0, least: float = 5.0,
) -> Forest:
    """Grows the trees on histograms of at most ``bins`` bins a feature, by the logistic loss."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    rate_of = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    base = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))  # a leaf goes to itself
        value.append(0.0)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            below = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if d < depth and len(rows) >= 2 * least:
                    flat = (binned[rows] + np.arange(m) * bins).ravel()
                    shape = (m, bins)
                    gh = np.bincount(flat, np.repeat(g[rows], m), m * bins).reshape(shape).cumsum(axis=1)[:, :-1]
                    hh = np.bincount(flat, np.repeat(h[rows], m), m * bins).reshape(shape).cumsum(axis=1)[:, :-1]
                    nn = np.bincount(flat, minlength=m * bins).reshape(shape).cumsum(axis=1)[:, :-1]
                    gain = gh**2 / (hh + ridge) + (gs - gh) ** 2 / (hs - hh + ridge) - gs**2 / (hs + ridge)
                    gain[(nn < least) | (len(rows) - nn < least)] = 0
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-3 and b < len(cuts[j]):
                        best = (int(j), int(b))
                if best is None:
                    value[at] = rate * gs / (hs + ridge)
                    margin[rows] += value[at]
                    continue
                j, b = best
                feature[at], threshold[at] = j, float(cuts[j][b])
                left[at] = node()
                node()
                right = binned[rows, j] > b
                below += [(left[at], rows[~right]), (left[at] + 1, rows[right])]
            level = below
    # a leaf's threshold is infinite, so that its rows stay
    arrays = (np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value))
    return Forest(*arrays, base=base, depth=depth)


def features(docs: DataFrame, *keys: tuple[str, T.DataType]) -> DataFrame:
    """The given columns and ``x``, the statistics of each row's text as one binary value of doubles."""

    def make():
        def each(batch):
            x = [np.array(statistics(t), dtype="<f8").tobytes() for t in batch["text"]]
            return {**{k: batch[k] for k, _ in keys}, "x": x}

        return each

    schema = T.StructType([*[T.StructField(k, t) for k, t in keys], T.StructField("x", T.BinaryType())])
    return map_arrow(docs.select(*[k for k, _ in keys], "text"), make, schema)


def fit(docs: DataFrame, labels: DataFrame, max_good: int = MAX_GOOD, max_poor: int = MAX_POOR) -> Forest:
    """Learns ``quality`` from at most ``max_good`` and ``max_poor`` labelled rows that aren't held out.

    Rows are taken by ascending hash of doc_id; a label's rows weigh as much as all rows of that label. With no rows
    of one label, each text gets the share of good rows (a half, without any).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label in (0, 1)").where(crc_mod5("doc_id") != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {int(r[0]): int(r[1]) for r in known.groupBy("label").count().collect()}
    take = lambda k, n: known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = take(1, max_good).unionByName(take(0, max_poor))
    # the sample is bounded by the parameters, so it can be sent to all
    rows = only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    got = features(rows, ("label", T.IntegerType())).collect()
    y = np.array([r["label"] for r in got], dtype=float)
    x = np.array([np.frombuffer(r["x"], dtype="<f8") for r in got]).reshape(-1, len(NAMES))
    if len(set(y.tolist())) < 2:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        none = np.zeros(1)
        return Forest(none.astype(int), none.astype(int), np.array([np.inf]), none.astype(int), none, float(np.log(share / (1 - share))), 0)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    x, y = x[order], y[order]
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    return train(x, y, weight * len(y) / weight.sum())


def scores(forest: Forest, texts: list[str | None]) -> list[float]:
    x = np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))
    return [p for i in range(0, len(x), 1024) for p in forest.probability(x[i : i + 1024]).tolist()]


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``(doc_id, score)``, the probability that a document is good, for each row of ``docs (doc_id, text)``.

    A null text counts as empty; texts are read whole; repeated rows give repeated results; an empty table gives an
    empty one.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    make = lambda: lambda batch: {"doc_id": batch["doc_id"], "score": scores(forest, batch["text"])}
    return map_arrow(only(docs, doc_id="long", text="string"), make, schema)


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores at least the threshold."""
    return filter_arrow(docs, "text", lambda: lambda texts: [s >= least for s in scores(forest, texts)])
