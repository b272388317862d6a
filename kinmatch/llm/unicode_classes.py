"""Character classes that the standard ``re`` lacks, written out once a process."""

from __future__ import annotations

import sys
from functools import lru_cache
from unicodedata import category

#: White_Space of Unicode, as ``\\s`` of the tokenizers' patterns has it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


@lru_cache
def ranges(major: str) -> str:
    """The inside of a bracket expression for all characters whose category begins with ``major``."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and category(chr(c))[0] == major
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}" if c - 1 > first else f"\\U{first:08x}")
            first = None
    return "".join(out)
