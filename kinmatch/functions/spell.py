"""Spelling correction of candidates against a dictionary of terms and frequencies."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .uom import UNITS, aliases, key

# Tokens of the domain, which are never corrected.
MATERIALS = {
    "MS", "SS", "GI", "PVC", "PPR", "BRASS", "COPPER", "ALUMINUM", "ALUMINIUM", "STEEL", "IRON", "RUBBER", "PLASTIC", "NYLON",
    "PE", "HDPE", "LDPE", "POLYESTER", "COTTON", "NEOPRENE", "FORGED", "FORGE", "CAST", "STAINLESS", "GALVANIZED", "CHROME",
    "ZINC", "BRONZE", "CERAMIC", "CARBON", "FIBER", "FIBRE", "ACRYLIC", "LEATHER", "FOAM", "SPONGE", "WOOD", "GLASS", "SILICONE",
    "TEFLON", "MILD", "GALV", "CI", "WI", "MONEL", "INCONEL", "TITANIUM", "ALLOY", "COMPOSITE", "SYNTHETIC", "ABS", "PU",
}
COLORS = {
    "RED", "BLUE", "GREEN", "WHITE", "BLACK", "YELLOW", "GREY", "GRAY", "BROWN", "ORANGE", "PURPLE", "PINK", "SILVER", "GOLD",
    "VIOLET", "BEIGE", "NAVY", "MAROON", "IVORY", "CREAM", "TEAL", "CYAN", "MAGENTA", "LIME", "OLIVE", "INDIGO", "TURQUOISE",
    "CORAL", "SALMON", "KHAKI", "TRANSPARENT", "CLEAR", "GLOSSY", "MATTE", "SATIN", "METALLIC",
}
DIMENSIONS = {
    "THICKNESS", "LENGTH", "WIDTH", "HEIGHT", "DIA", "DIAMETER", "OD", "ID", "SIZE", "PITCH", "BORE", "GAUGE", "SCHEDULE", "SCH",
    "WEIGHT", "CAPACITY", "RATING", "PRESSURE", "TEMP", "TEMPERATURE", "VOLTAGE", "CURRENT", "POWER", "FREQ", "FREQUENCY",
    "SPEED", "FLOW", "STROKE", "TRAVEL", "RANGE", "SPAN", "W", "L", "H", "D", "T", "R",
}
MOST_EDITS = 2
#: Letters of a word's beginning that are taken apart; a fixed value.
PREFIX = 7


def distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours (optimal string alignment)."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def within(a: str, b: str, most: int) -> int | None:
    """``distance(a, b)`` if it is at most ``most``, else None; it looks at few columns of each row."""
    if abs(len(a) - len(b)) > most:
        return None
    if a == b:
        return 0
    shared = len(commonprefix((a, b)))
    a, b = a[shared:], b[shared:]
    back = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - back], b[: len(b) - back]
    far = most + 1
    # row i holds columns i - most to i + most; all others are further than most
    two, one = {}, {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            best = min(one.get(j, far) + 1, row.get(j - 1, far) + 1, one.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, two.get(j - 2, far) + 1)
            row[j] = min(best, far)
        if min(row.values()) > most:
            return None
        two, one = one, row
    found = one.get(len(b), far)
    return found if found <= most else None


class Speller:
    """Finds the closest term of a dictionary, by the beginnings of terms with letters left out; ties: the most frequent, then by name.

    Strings with at most ``most`` edits between them have beginnings that leave an equal rest when at most as many letters
    are left out of either, so a term is kept under at most 29 rests, however long it is.
    """

    def __init__(self, terms: Iterable[tuple[str, int]], most: int = MOST_EDITS, prefix: int = PREFIX):
        self.most, self.prefix, self.frequency = most, prefix, dict(terms)
        self.shorter: dict[str, list[str]] = defaultdict(list)
        for t in self.frequency:
            for d in self._deletes(t):
                self.shorter[d].append(t)

    def _deletes(self, word: str) -> set[str]:
        out = layer = {word[: self.prefix]}
        for _ in range(self.most):
            layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
            out = out | layer
        return out

    def closest(self, word: str) -> tuple[str, int] | None:
        if word in self.frequency:
            return word, 0
        found = {t for d in self._deletes(word) for t in self.shorter.get(d, ())}
        near = ((within(word, t, self.most), -self.frequency[t], t) for t in found)
        best = min((n for n in near if n[0] is not None), default=None)
        return (best[2], best[0]) if best else None


@lru_cache
def uom_tokens() -> frozenset[str]:
    """Keys of units, of their labels and of each word of these."""
    parts = {key(p) for unit, labels in UNITS.items() for label in [unit, *labels] for p in [label, *label.split()]}
    return frozenset(parts | set(aliases()))


def correct(text: str | None, speller: Speller, units: frozenset[str]) -> str:
    """A text with unknown words replaced by the closest term in upper case; codes, units and domain words stay."""
    out = []
    for token in (text or "").split():
        t = token.rstrip(",;")
        bare = re.sub(r"[().#,:;]", "", t).upper()
        keep = not t or re.search(r"\d", t) or not bare or bare in MATERIALS | COLORS | DIMENSIONS or len(bare) <= 2
        if keep or re.sub("[^a-z0-9]", "", t.casefold()) in units:
            out += [t] if t else []
            continue
        best = speller.closest(bare.lower())
        out.append(best[0].upper() if best and best[1] else t)
    return " ".join(out)


def correct_spelling(c: Column, terms: Iterable[tuple[str, int]]) -> Column:
    """``correct`` as a column, for a dictionary that fits each worker's memory (it is sent with the function)."""
    given = tuple(terms)
    made: list[Speller] = []

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        if not made:
            made.append(Speller(given))
        units = uom_tokens()
        return s.map({x: correct(x, made[0], units) for x in s.unique()})

    return run(c)


def term_frequencies(rows: DataFrame, text: str, least: int = 1) -> DataFrame:
    """``(term, frequency)``: the lower-case words of a text column that occur ``least`` times or more, those with a digit left out.

    With 1, every word that occurs is a term, and so its own correction; a higher number makes rare words of a large
    column, which are mostly misspelt, be corrected to frequent ones.
    """
    words = rows.select(F.explode(F.split(F.lower(F.col(text)), r"(?U)[\s,;]+")).alias("term"))
    counted = words.where(~F.col("term").rlike(r"(?U)\d") & (F.length("term") > 2)).groupBy("term").agg(F.count("*").alias("frequency"))
    return counted.where(F.col("frequency") >= least) if least > 1 else counted


def _deletes(word: Column, most: int, prefix: int) -> Column:
    """A word's beginning and all that is left of it without up to ``most`` letters."""
    def shorter(w: Column) -> Column:
        at = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    out = F.array(F.substring(word, 1, prefix))
    layer = out
    for _ in range(most):
        layer = F.array_distinct(F.flatten(F.transform(layer, shorter)))
        out = F.array_union(out, layer)
    return out


def _edits(most: int):
    @F.pandas_udf(T.IntegerType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, most) for x, y in zip(a, b)], index=a.index, dtype="Int32")

    return run


def closest_terms(words: DataFrame, terms: DataFrame, most: int = MOST_EDITS, prefix: int = PREFIX) -> DataFrame:
    """``(word, term, edits)`` of distinct ``words (word)`` and the closest of ``terms (term, frequency)``, of any size.

    A word that is a term needs no search. Others meet terms of nearly their length at what is left of the beginnings of
    both without some letters: at most 29 rows a word or term, however long. The bounded Levenshtein distance, in which a
    swap of neighbours counts as two edits, is at most twice the edits; what it leaves is verified with swaps. Ties go to the most frequent term, then by name.
    """
    same = words.join(terms, words["word"] == terms["term"], "left_semi").select("word", F.col("word").alias("term"), F.lit(0).alias("edits"))
    others = words.join(terms, words["word"] == terms["term"], "left_anti")
    left = others.select("word", F.explode(_deletes(F.col("word"), most, prefix)).alias("rest"))
    right = terms.select("term", "frequency", F.explode(_deletes(F.col("term"), most, prefix)).alias("rest"))
    near = (left["rest"] == right["rest"]) & (F.abs(F.length("word") - F.length("term")) <= most)
    pairs = left.join(right, near).select("word", "term", "frequency").distinct()
    pairs = pairs.withColumn("plain", F.levenshtein("word", "term", 2 * most)).where("plain >= 0")
    simple = pairs.where("plain <= 1").withColumn("edits", F.col("plain"))
    rest = pairs.where("plain > 1").withColumn("edits", _edits(most)("word", "term")).where("edits is not null")
    scored = simple.unionByName(rest)
    best = scored.groupBy("word").agg(F.min(F.struct("edits", (-F.col("frequency")).alias("rare"), "term")).alias("b"))
    return best.select("word", "b.term", "b.edits").unionByName(same)


def correct_texts(rows: DataFrame, text: str, terms: DataFrame, to: str = "corrected") -> DataFrame:
    """``rows`` with the corrected text, as ``correct`` has it, for a dictionary ``(term, frequency)`` of any size.

    Each distinct text is taken apart once and each distinct word is looked up once. A null text is empty.
    """
    from ..sources.shared import stored

    given = F.coalesce(F.col(text), F.lit(""))
    tokens = rows.select(given.alias("_text")).distinct().select("_text", F.posexplode(F.split("_text", r"(?U)\s+")).alias("_at", "_token"))
    tokens = tokens.withColumn("_token", F.regexp_replace("_token", "[,;]+$", "")).where("_token <> ''")
    bare = F.upper(F.regexp_replace("_token", "[().#,:;]", ""))
    unit = F.regexp_replace(F.lower("_token"), "[^a-z0-9]", "").isin(*sorted(uom_tokens()))
    keep = F.col("_token").rlike(r"(?U)\d") | (F.length(bare) <= 2) | bare.isin(*sorted(MATERIALS | COLORS | DIMENSIONS)) | unit
    tokens = stored(tokens.withColumn("_word", F.when(~keep, F.lower(bare))))
    found = closest_terms(tokens.where("_word is not null").select(F.col("_word").alias("word")).distinct(), terms)
    changed = tokens.join(found.where("edits > 0"), F.col("_word") == F.col("word"), "left")
    placed = changed.select("_text", F.struct("_at", F.coalesce(F.upper("term"), F.col("_token")).alias("t")).alias("p"))
    made = placed.groupBy("_text").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), " ").alias("_made"))
    joined = rows.withColumn("_text", given).join(made, "_text", "left").withColumn(to, F.coalesce("_made", F.lit("")))
    return joined.drop("_text", "_made")
