"""Normalisation of free-text descriptions, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rewriting rules of descriptions, in the order in which they apply.
QUOTES = (("[‘’`´]", "'"), ("[“”]", '"'))
RULES = (
    (r"(?U)(?<=\w)['’](?=\w)", ""),  # 40's
    (r"['\"`´]", " "),
    (r"[?!;*&|^\\<>~\[\]{}()]+", " "),
    (r"(?U)(?<![\w#@])\s*:\s*(?!\d)", " "),
    (r"(?U)(?<!\d)\s*/\s*(?!\d)", " "),
    (r"(?U)(?<![\d/])\s*-\s*(?!\d)", " "),
    (r"(?U)\s+", " "),
    (r"(?U)^\s+|\s+$", ""),
)
LAYOUT = (
    (r"([A-Za-z]+)#", "$1 #"),  # IM#
    (r"(?U)#\s*:", "# :"),
    (r"(?U)([#@])\s*(\d)", "$1 $2"),  # @120
    (r"(?U)(?<!\d):\s*(\d)", ": $1"),  # PRONG:100
    (r"(?U)(\d),(\d{1,2})(?=[^\d]|$)", "$1.$2"),  # 1,5
    (r"(?U)(\d)(_[A-Za-z0-9])", "$1 $2"),  # 80023220_120C
    (
        r"(?iU)(?<![/~\-])(\d)(INCH|MTR|MFD|KGF|GSM|VDC|VAC|VCA|NOS|YDS|RPM|PSI|BAR|KW|MW|HP|CM|MM|IN|GM|LB|OZ|TEX|MA|UF|NF|PF|KG|FT|M|W|G|V)"
        r"(?=[^a-zA-Z]|$)",
        "$1 $2",
    ),  # 20mm
    (r"(?U)\s+", " "),
    (r"(?U)^\s+|\s+$", ""),
)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_str(c: Column) -> Column:
    """Null, ``nan`` and ``none`` in any case are empty; other texts are stripped."""
    s = c.cast("string")
    return F.when(s.isNull() | F.lower(s).isin("nan", "none"), F.lit("")).otherwise(strip(s))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """The compatibility composition of each text; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_description(c: Column, compose: bool = True, passes: int = 1) -> Column:
    """A description with quotes, punctuation, spacing and units in one form.

    ``compose`` applies NFKC first, in an Arrow function: leave it out for texts that are known to be ASCII. The rules
    are not idempotent (``1,5,5``), so both sides of a comparison need the same number of ``passes``.
    """
    out = c
    for _ in range(passes):
        out = clean_str(out)
        if compose:
            out = nfkc(out)
        for pattern, to in QUOTES + RULES + LAYOUT:
            out = F.regexp_replace(out, pattern, to)
    return out


def _tokens(normalized: Column) -> Column:
    split = F.transform(F.split(normalized, r"(?U)\s+"), lambda t: F.regexp_replace(t, "[,;]+$", ""))
    return F.filter(split, lambda t: t != "")


def text_part(normalized: Column) -> Column:
    """The tokens without a digit of a normalised description, joined by a space."""
    return clean_str(F.array_join(F.filter(_tokens(normalized), lambda t: ~t.rlike(r"(?U)\d")), " "))


def numeric_part(normalized: Column) -> Column:
    """The tokens with a digit, in their order: ``10 20`` and ``20 10`` are different keys."""
    return clean_str(F.array_join(F.filter(_tokens(normalized), lambda t: t.rlike(r"(?U)\d")), " "))


# Units in words and the shapes of dimensions.
UNIT = r"(?:MM|CM|M\b|FT|INCH|IN\b|UF|MFD|NF|PF|VDC|VAC|VCA|MA\b|TEX|GSM|V\b|W\b|KW|MW|HP|BAR|PSI|KGF?|GM|G\b|LB|OZ|RPM|NOS|MTR|YDS|\"|')"
DIMENSION = (
    rf"[\d.,/~\-]+\s*{UNIT}",
    r"[\d.]+[Xx\*][\d.]+(?:[Xx\*][\d.]+)?(?:MM|CM|\"|FT|IN)?",
    r"[\d.]+[\"'](?:[Xx\*][\d.]+[\"'])+",
    r"[\d.,/~\-]+",
    r"[\d.,/~\-]+[\"']",
)


def is_dimension(token: Column) -> Column:
    """Whether a token is a number, a number with a unit, or a product of such."""
    return F.coalesce(token.rlike("(?iU)^(?:" + "|".join(DIMENSION) + ")$"), F.lit(False))


def is_unit(token: Column) -> Column:
    """Whether a token is a unit."""
    return F.coalesce(token.rlike(f"(?iU)^{UNIT}$"), F.lit(False))


def bare_token(token: Column) -> Column:
    """A token in upper case without brackets, dots, commas, colons and number signs."""
    return F.upper(F.regexp_replace(token, "[().#,:]", ""))


def match_key(c: Column) -> Column:
    """What equality of numeric parts and of column values goes by; never null."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
