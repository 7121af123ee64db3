"""Spelling, gloss and licence rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions.unicode import WHITESPACE, chars, fold, nfc, nfd, strip

_BRAHMIC = (0x0900, 0x0E00)


def attested_ipa(segments: Column, form: Column, value: Column) -> Column:
    """Transcription of one word-list row, or NULL where the row is no free,
    attested single word.

    Reconstructions, affixes, phrases, boundary tokens and unresolved
    annotations give NULL; ``grapheme/IPA`` tokens keep the right side."""
    raw = strip(F.coalesce(F.nullif(form, F.lit("")), value, F.lit("")))
    seg = F.coalesce(segments, F.lit(""))
    edge = chars(K.AFFIX_EDGES)
    unattested = raw.startswith("*") | raw.rlike(f"^[{edge}]|[{edge}]$")
    tokens = F.filter(F.split(seg, f"[{chars(WHITESPACE)}]+"), lambda t: t != "")
    resolved = F.transform(tokens, lambda t: F.regexp_replace(t, "(?s)^.*/", ""))
    joined = F.array_join(resolved, " ")
    bad_tokens = (
        F.arrays_overlap(tokens, F.array(*[F.lit(b) for b in K.BOUNDARY_TOKENS]))
        | F.exists(resolved, lambda t: t == "")
        | joined.rlike(f"[{chars(K.SEGMENT_ANNOTATIONS)}]")
    )
    plain = F.when(~raw.contains(" ") & (raw != ""), raw)
    return (F.when(unattested, F.lit(None).cast("string"))
            .when(seg != "", F.when(~bad_tokens & (joined != ""), joined))
            .otherwise(plain))


def is_proto(name: Column) -> Column:
    return strip(F.coalesce(name, F.lit(""))).rlike(K.PROTO_LANGUAGE)


def respell(source: Column, form: Column) -> Column:
    """Spelling to transcription for the sources that have rules; others as they are."""
    out = form
    for name, rules in K.RESPELLINGS.items():
        c = form
        if name in K.MACRON_IS_LENGTH:
            c = nfc(F.replace(nfd(form), F.lit(K.MACRON), F.lit("ː")))
        for old, new in rules:
            c = F.replace(c, F.lit(old), F.lit(new))
        out = F.when(source == name, c).otherwise(out)
    return out


def spelling_exclusion(source: Column, segmented: Column, form: Column, respelled: Column) -> Column:
    """Reason an unsegmented row cannot be read as a transcription, or NULL."""
    with_rules = source.isin(*K.RESPELLINGS)
    n = nfd(form)
    vowels = F.length(F.regexp_replace(F.lower(nfd(respelled)), f"[^{chars(K.SPELLING_VOWELS)}]+", ""))
    return (F.when(segmented, F.lit(None).cast("string"))
            .when(~with_rules, "spelling without rules")
            .when(n.rlike(f"[{chars(K.SPELLING_MARKS)}]"), "vowel-quality mark in a spelling")
            .when(n.rlike(f"[{chars(K.ACCENTS)}]") & (vowels == 1), "accent on a one-vowel spelling"))


def _named(part: str) -> str:
    """Regex class of the Brahmic code points whose Unicode name holds ``part``."""
    import unicodedata
    return chars("".join(chr(c) for c in range(*_BRAHMIC) if part in unicodedata.name(chr(c), "")))


def is_noise_word(word: Column) -> Column:
    """Dictionary headwords that are no words: letter pages, acronyms, signs."""
    w = strip(word)
    low, high = (f"\\x{{{p:x}}}" for p in (_BRAHMIC[0], _BRAHMIC[1] - 1))
    brahmic = f"[{low}-{high}]"
    return (
        ~w.rlike("\\p{L}")
        | w.rlike("^[A-Z]{1,4}$")
        | w.rlike(f"^{brahmic}$")
        | (w.rlike(f"^{brahmic}+$") & w.rlike(f"[{_named('VIRAMA')}]") & ~w.rlike(f"[{_named('VOWEL')}]"))
    )


def concise_gloss(gloss: Column) -> Column:
    """Text before the first comma, then before the first semicolon; NULL if blank."""
    head = F.substring_index(F.substring_index(gloss, ",", 1), ";", 1)
    return F.nullif(strip(head), F.lit(""))


def is_letter_sense(gloss: Column) -> Column:
    return gloss.rlike(K.LETTER_SENSE)


def lead_word(gloss: Column) -> Column:
    return F.lower(F.regexp_extract(strip(gloss), r"(?i)^(to|a|an|the)\s+", 1))


def gloss_key(gloss: Column) -> Column:
    """Gloss without its leading article or ``to``, case folded."""
    return fold(strip(F.regexp_replace(strip(gloss), r"(?i)^(?:to|a|an|the)\s+", "")))


def wanted_category(gloss: Column) -> Column:
    lead = lead_word(gloss)
    out = F.lit(None).cast("string")
    for word, category in K.LEAD_CATEGORIES.items():
        out = F.when(lead == word, category).otherwise(out)
    return out


def head_word(concept_gloss: Column) -> Column:
    """Concept gloss without its bracketed qualifier, case folded."""
    return fold(F.regexp_replace(concept_gloss, r"\s*\(.*\)$", ""))


def licence_id(raw: Column) -> Column:
    """Licence URL or id -> id; unknown text stays as it is."""
    text = F.rtrim(strip(F.coalesce(raw, F.lit(""))), F.lit("/"))
    text = F.replace(F.replace(text, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    out = text
    for url, licence in K.LICENCE_URLS.items():
        out = F.when(text == url, licence).otherwise(out)
    return out


def licence_ok(licence: Column) -> Column:
    return licence.isin(*K.ALLOWED_LICENCES)


def concept_key(concepticon_id: Column, gloss: Column) -> Column:
    """Concept id as text, or a hash of the folded gloss."""
    hashed = F.concat(F.lit("g-"), F.substring(F.sha1(fold(strip(gloss))), 1, 16))
    return F.when(concepticon_id.isNotNull() & (concepticon_id != 0),
                  concepticon_id.cast("string")).otherwise(hashed)


def concept_word(concepticon_gloss: Column) -> Column:
    """Concept gloss in lower case, the pronoun kept as ``I``."""
    return F.regexp_replace(F.lower(concepticon_gloss), r"(?<![\p{L}\p{N}_])i(?![\p{L}\p{N}_])", "I")
