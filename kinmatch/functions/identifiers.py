"""Normalisation of identifiers: registration numbers, accounts and the like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_identifier(c: Column) -> Column:
    """Letters and digits in upper case; leading zeros go if there are only digits (all zeros: one zero); null is empty."""
    kept = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^a-zA-Z0-9]", "")
    digits = F.regexp_replace(kept, "^0+(?=.)", "")
    return F.when(kept.rlike("^[0-9]+$"), digits).otherwise(F.upper(kept))
