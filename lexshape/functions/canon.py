"""Transcription rules as column expressions.

All of them are plain regular-expression and string functions, so the hot path
stays in generated JVM code. Segments travel as ONE space-separated string (no
segment can contain a space); ``segment_array`` gives the array view.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions.unicode import WHITESPACE, chars, combining, grapheme, is_ascii

SEP = "\x1f"   # internal boundary; white space in every input, so never inside a token


def is_plain(text: Column, segmented: Column | bool) -> Column:
    """Unsegmented pure-ASCII text without a length colon: every character is a
    grapheme of its own and the key needs no composition. The common case."""
    plain = is_ascii(text) & ~text.contains(":")
    if isinstance(segmented, bool):
        return F.lit(False) if segmented else plain
    return ~segmented & plain


def split_marked(text: Column, segmented: Column | bool) -> Column:
    """NFD text with a boundary character between segments."""
    given = F.regexp_replace(text, f"[{chars(WHITESPACE)}]+", SEP)
    found = F.regexp_replace(text, grapheme(), "$0" + SEP)
    if isinstance(segmented, bool):
        return given if segmented else found
    return F.when(segmented, given).otherwise(found)


def graphemes(text: Column) -> Column:
    """Array of graphemes of an NFD string."""
    return F.regexp_extract_all(text, F.lit(grapheme()), F.lit(0))


def tone(text: Column) -> Column:
    """Tone letters, digits and marks of an NFD string, in order."""
    toneless = F.when(is_ascii(text), ~text.rlike("[0-9]")).otherwise(F.translate(text, K.TONES, "") == text)
    return F.when(toneless, "").otherwise(F.regexp_replace(text, f"[^{chars(K.TONES)}]+", ""))


# The clean-up runs in steps. Every step reads its input more than once, so a
# caller gives each its own column: nested, the input would be computed again for
# each mention (the optimizer does not share work between CASE branches).

def fold_letters(text: Column) -> Column:
    """Fold letters and delete tone, stress and separators, in one ``translate``."""
    return F.translate(text, "".join(K.FOLD_LETTERS) + K.TONES + K.DROPPED, "".join(K.FOLD_LETTERS.values()))


def spell_out(c: Column) -> Column:
    """Ligature letters as two letters, alveolo-palatal letters with their mark."""
    out = c
    for letter, pair in K.FOLD_DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.when(c.rlike(f"[{chars(''.join(K.FOLD_DIGRAPHS))}]"), out).otherwise(c)


def prenasalize(c: Column) -> Column:
    """A nasal and a stop in one segment: the nasal becomes a raised letter."""
    stops = f"(?=[{chars(K.PRENASAL_STOPS)}])"
    out = c
    for nasal, raised in K.PRENASAL.items():
        out = F.regexp_replace(out, f"(^|{SEP}){nasal}{stops}", f"$1{raised}")
    hit = c.rlike(f"(?:^|{SEP})[{chars(''.join(K.PRENASAL))}]{stops}")
    return F.when(hit, out).otherwise(c)


def spaced(c: Column) -> Column:
    """Marked text as space-separated segments, empty ones dropped."""
    tidy = F.btrim(c, F.lit(SEP))
    return F.translate(F.when(c.contains(SEP + SEP), F.regexp_replace(tidy, f"{SEP}+", SEP)).otherwise(tidy), SEP, " ")


def spaced_letters(c: Column) -> Column:
    """Folded plain text as space-separated letters."""
    return F.rtrim(F.array_join(F.split(c, ""), " "))


def segment_array(segments: Column) -> Column:
    return F.when(segments == "", F.array().cast("array<string>")).otherwise(F.split(segments, " "))


@lru_cache(maxsize=None)
def toned_letters() -> dict[str, str]:
    """Letters that decompose to one of a-z with tone marks alone, and that letter."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x2000))}
    return {c: p[0] for c, p in parts.items() if len(p) > 1 and "a" <= p[0] <= "z" and not p[1:].strip(K.TONE_MARKS)}


def bare_letters(word: Column) -> Column:
    """The word without tone marks on its letters. Of letters alone: where a-z is left, each is a segment, and
    words (unsegmented) have equal segments just where these are equal; where not, its segments hold another sign."""
    toned = toned_letters()
    return F.translate(word, "".join(toned) + "\u0261", "".join(toned.values()) + "g")


def has_toned_letter(word: Column) -> Column:
    return F.translate(word, "".join(toned_letters()), "") != word


def is_clean(segmental: Column) -> Column:
    """True where the key holds nothing but letters and marks of the alphabet."""
    quick = segmental.rlike("^[a-z\u0261]+$")
    return quick | segmental.rlike(f"^[^{chars(K.NOT_IPA_SIGNS + K.NOT_IPA_LETTERS)}\\p{{Lu}}\\p{{Co}}]+$")


def loose_key(segmental: Column) -> Column:
    """Length set aside: long mark dropped, doubled letters single."""
    return F.regexp_replace(F.replace(segmental, F.lit("ː"), F.lit("")), "(?s)(.)\\1+", "$1")


def conformance(text: Column) -> Column:
    """Share of the graphemes of an NFD string whose base is a known letter."""
    tie = chars(K.TIE_BARS)
    rest = f"(?:[{tie}]+[^{tie}]?|[{chars(K.ATTACHED)}{combining()}])*"
    bases = F.regexp_replace(text, f"(?s)(.){rest}", "$1")
    known = (K.VOWELS + K.GLIDES + K.ONSET_NASAL + K.ONSET_STOP + K.ONSET_FRICATIVE
             + K.ONSET_LIQUID + K.ONSET_IMPLOSIVE)
    hits = F.length(F.regexp_replace(bases, f"[^{chars(known)}]", ""))
    return F.when(F.length(bases) == 0, F.lit(0.0)).otherwise(hits / F.length(bases))
