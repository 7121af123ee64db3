"""Unicode helpers: normal forms, character classes and case folding.

Spark has no built-in normalisation function, but ICU4J ships with Spark (it
backs the collations), so the normal forms run inside the JVM through the
``reflect`` SQL function: no Python worker, no Arrow hop. Strings that are pure
ASCII skip the call (their byte and character lengths agree).

``reflect`` counts as non-deterministic for the optimizer: filters that can run
before a normalisation should be written before it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexshape import constants as K

_ICU = "com.ibm.icu.text.Normalizer"

# characters that text splitting and stripping treat as white space
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def chars(text: str) -> str:
    """The characters of ``text`` as the inside of a Java regex class (as ranges:
    every member outside Latin-1 costs a test per character)."""
    return _ranges(sorted({ord(c) for c in text}))


def _ranges(points: list[int]) -> str:
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


@lru_cache(maxsize=None)
def combining() -> str:
    """Regex class of characters with a non-zero combining class.

    Written as "marks minus the marks of class zero", so that a letter is ruled
    out by one category test."""
    planes = (range(0x300, 0x20000), range(0xE0100, 0xE01F0))
    zero = [c for plane in planes for c in plane
            if unicodedata.category(chr(c))[0] == "M" and not unicodedata.combining(chr(c))]
    return f"[\\p{{M}}&&[^{_ranges(zero)}]]"


@lru_cache(maxsize=None)
def grapheme() -> str:
    """Regex of one grapheme: a base letter with its marks and attached letters;
    a tie bar pulls the next character in."""
    tie = chars(K.TIE_BARS)
    return f"(?s).(?:[{tie}]+[^{tie}]?|[{chars(K.ATTACHED)}{combining()}])*"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def nfd(c: Column) -> Column:
    """Canonical decomposition, JVM side."""
    return F.when(c.isNull() | is_ascii(c), c).otherwise(
        F.reflect(F.lit(_ICU), F.lit("decompose"), c, F.lit(False)))


def decomposed(c: Column) -> Column:
    """Canonical decomposition without the ASCII shortcut; NULL becomes empty.

    The bare call is non-deterministic to the optimizer, so no filter on its
    result is ever moved below it (see ``operators.rows.canonicalize``)."""
    return F.reflect(F.lit(_ICU), F.lit("decompose"), F.coalesce(c, F.lit("")), F.lit(False))


def nfc(c: Column) -> Column:
    """Canonical composition, JVM side."""
    return F.when(c.isNull() | is_ascii(c), c).otherwise(
        F.reflect(F.lit(_ICU), F.lit("compose"), c, F.lit(False)))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(c, F.lit(WHITESPACE))


def fold(c: Column) -> Column:
    """Case folding: lower case, with the two common letters where they differ."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def slug(c: Column) -> Column:
    """File-name-safe key: ``u`` and the code points in hex, at least 4 digits each."""
    def point(ch: Column) -> Column:
        digits = F.lower(F.hex(F.ascii(ch)))
        return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    letters = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.concat(F.lit("u"), F.array_join(F.transform(letters, point), "-"))
