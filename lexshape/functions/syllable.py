"""Syllable analysis of space-separated NFD segments, as column expressions.

A segment is a vowel (vowel letter first, no non-syllabic mark), a glide (glide
letter, or a vowel letter with a non-syllabic mark) or a consonant. One CASE
decides the reason; every other verdict column is a function of that reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions.unicode import chars, combining

_V, _GL = chars(K.VOWELS), chars(K.GLIDES)
# ``types`` rewrites vowel letters, glide letters and the two kinds of marks to
# four control characters, so that the rules test single Latin-1 characters
_TV, _TG, _TN, _TS = "\x01", "\x02", "\x03", "\x04"
_START, _END = "(?<![^ ])", "(?![^ ])"
_VOWEL_SEGMENT = f"{_START}{_TV}[^ {_TN}]*{_END}"
_OFFGLIDE = f"(?:{_TG}[^ ]*|{_TV}[^ {_TN}]*{_TN}[^ ]*)"

SYLLABIC, NO_VOWEL, SEVERAL, CODA = "syllabic consonant", "no vowel", "several vowels", "coda"
FINAL_GLIDE, DIPHTHONG, TRIPHTHONG, MONOPHTHONG = (
    "final glide", "diphthong segment", "triphthong segment", "monophthong")
NASAL_FIRST = "; separate nasal before a consonant"
OPEN_REASONS = (FINAL_GLIDE, DIPHTHONG, TRIPHTHONG, MONOPHTHONG)


def types(n: Column) -> Column:
    """Segments with vowels, glides and marks replaced by their type characters."""
    letters = K.VOWELS + K.GLIDES + K.NON_SYLLABIC_MARKS + K.SYLLABIC_MARKS
    kinds = (_TV * len(K.VOWELS) + _TG * len(K.GLIDES) + _TN * len(K.NON_SYLLABIC_MARKS) + _TS * len(K.SYLLABIC_MARKS))
    return F.translate(n, letters, kinds)


def reason(t: Column) -> Column:
    """Why the word is open or not, from its ``types`` string."""
    syllabic = t.contains(_TS) & t.rlike(
        f"{_START}(?:(?=[^ {_TV}])[^ ]*{_TS}|{_TV}(?=[^ ]*{_TN})[^ ]*{_TS})")
    nucleus = F.regexp_extract(t, _VOWEL_SEGMENT, 0)
    vowels = F.length(nucleus) - F.length(F.replace(nucleus, F.lit(_TV), F.lit("")))
    return (
        F.when(syllabic, SYLLABIC)
        .when(~t.contains(_TV) | ~t.rlike(_VOWEL_SEGMENT), NO_VOWEL)
        .when(t.rlike(f"(?s){_VOWEL_SEGMENT}.* {_VOWEL_SEGMENT}"), SEVERAL)
        .when(t.rlike(f"{_VOWEL_SEGMENT}(?: {_OFFGLIDE})* [^ {_TV}{_TG}]"), CODA)
        .when(t.rlike(f"{_VOWEL_SEGMENT} "), FINAL_GLIDE)
        .when(vowels == 2, DIPHTHONG)
        .when(vowels > 2, TRIPHTHONG)
        .otherwise(MONOPHTHONG)
    )


_PLAIN_V = "".join(c for c in K.VOWELS if c.isascii())
_PLAIN_C = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in _PLAIN_V)


def plain(word: Column, segmented: Column) -> Column:
    """Unsegmented lower-case ASCII letters: clean and toneless whatever they are, by the scheme's own canonicalizer."""
    return ~segmented & word.rlike("^[a-z]++\\z")


def plain_reason(word: Column, segmented: Column) -> Column:
    """Reason of a ``plain`` word with two vowel letters or more, before any key is made (each letter is a segment); NULL for others."""
    several = f"^[{_PLAIN_C}]*+[{_PLAIN_V}][{_PLAIN_C}]*+[{_PLAIN_V}][a-z]*+\\z"
    return F.when(~segmented & word.rlike(several), SEVERAL)


def nasal_before_consonant(n: Column) -> Column:
    """A nasal written as its own segment, right before a consonant segment."""
    return n.rlike(f"{_START}{_BARE_NASAL} [^ {_V}{_GL}]")


_BARE_NASAL = f"[{chars(K.NASALS)}][^ \\p{{Ll}}\\p{{Lo}}\\p{{Lu}}]*"


def is_bare_nasal(segment: Column) -> Column:
    """The only full letter of the (NFD) segment is a nasal."""
    return segment.rlike(f"^{_BARE_NASAL}$")


def is_open(why: Column) -> Column:
    return why.isin(*OPEN_REASONS)


def verdict(why: Column, nasal: Column) -> dict[str, Column]:
    """Verdict columns from the reason and from ``nasal_before_consonant`` of open words."""
    return {
        "is_open": is_open(why),
        "confidence": F.when(nasal | why.isin(FINAL_GLIDE, DIPHTHONG, TRIPHTHONG), "medium").otherwise("high"),
        "nucleus_type": F.when(why == FINAL_GLIDE, "diphthong(V+glide)")
        .when(why.isin(DIPHTHONG, TRIPHTHONG), "diphthong")
        .when(why.isin(MONOPHTHONG, CODA), "monophthong").otherwise("none"),
        "contested": nasal | why.isin(FINAL_GLIDE, TRIPHTHONG),
        "reason": F.when(nasal, F.concat(why, F.lit(NASAL_FIRST))).otherwise(why),
    }


def first_letter(n: Column) -> Column:
    """First letter of the word, leading modifier letters skipped (they belong
    to the consonant after them)."""
    return F.regexp_extract(n, "[^\\p{Lm} ]", 0)


def last_vowel(n: Column) -> Column:
    """Last vowel letter that starts a grapheme."""
    tie = chars(K.TIE_BARS)
    untied = F.when(n.rlike(f"[{tie}]"), F.regexp_replace(n, f"[{tie}]+[^{tie}]?", "")).otherwise(n)
    return F.regexp_extract(untied, f"(?s)^.*([{_V}])", 1)


def onset_class(n: Column, letter: Column) -> Column:
    """Manner of the first consonant; ``none`` for a vowel-initial word.

    ``letter`` is ``first_letter(n)``, as a column of its own so that it is
    computed once. A glottal modifier that stands alone before a vowel is a stop."""
    affricate = n.rlike(
        f"^[\\p{{Lm}} ]*[{chars(K.ONSET_STOP)}][\\p{{Lm}}{combining()}]*[{chars(K.ONSET_FRICATIVE)}]")
    lone_glottal = n.contains(K.GLOTTAL_MODIFIER) & n.rlike(f"^(?:\\p{{Lm}}+ )*{K.GLOTTAL_MODIFIER} [{_V}]")

    def among(letters: str) -> Column:
        return F.lit(letters).contains(letter)
    return (
        F.when(lone_glottal, "stop")
        .when((letter == "") | among(K.VOWELS), "none")
        .when(among(K.GLIDES + K.ONSET_APPROXIMANT), "glide")
        .when(among(K.ONSET_NASAL), "nasal")
        .when(among(K.ONSET_IMPLOSIVE), "implosive")
        .when(among(K.ONSET_CLICK), "click")
        .when(among(K.ONSET_STOP), F.when(affricate, "affricate").otherwise("stop"))
        .when(among(K.ONSET_AFFRICATE), "affricate")
        .when(among(K.ONSET_FRICATIVE), "fricative")
        .when(among(K.ONSET_LIQUID), "liquid")
        .otherwise("other")
    )


def nucleus_bucket(vowel: Column, nucleus_type: Column) -> Column:
    """Vowel quality of ``last_vowel``, or ``diphthong``."""
    out = F.when(nucleus_type.startswith("diphthong"), "diphthong").when(vowel == "", "other")
    for name, letters in K.VOWEL_BUCKETS.items():
        out = out.when(F.lit(letters).contains(vowel), name)
    return out.otherwise("other")
