"""Phone table of the voice check.

Fixed values: which letters a speech synthesiser's phone set can voice, which it
only approximates, and which modifiers it drops.
"""

# --- fixed values: letter -> phone -------------------------------------------
PHONES = {
    "a": "a", "ɑ": "A:", "e": "e", "ɛ": "E", "i": "i", "ɪ": "I",
    "o": "o", "ɔ": "O", "u": "u", "ʊ": "U", "ə": "@",
    "ɤ": "o-", "ɒ": "0", "ɵ": "@.", "ʌ": "V", "ɐ": 'V"',
    "ɯ": "u-", "ɨ": 'i"', "ɜ": "3",
    "p": "p", "b": "b", "t": "t", "d": "d", "k": "k", "g": "g", "ɡ": "g",
    "ʔ": "?", "c": "c", "ɟ": "J", "q": "q", "ʈ": "t.",
    "m": "m", "n": "n", "ŋ": "N", "ɲ": "n^", "ɳ": "n.",
    "f": "f", "v": "v", "s": "s", "z": "z", "ʃ": "S", "ʒ": "Z",
    "x": "x", "h": "h", "β": "B", "ð": "D", "θ": "T", "ɣ": "Q",
    "ç": "C", "ɕ": "S;", "ʑ": "Z;", "ʂ": "s.", "ʐ": "z.", "ʁ": "R",
    "l": "l", "r": "r", "w": "w", "j": "j", "ɹ": "r\\", "ɻ": "r.",
    "ɭ": "l.", "ʎ": "l^", "ɾ": "*", "ɽ": "*.", "ʋ": "v#",
    "ː": ":",
}
# --- fixed values: letters voiced only by the nearest phone ------------------
APPROXIMATIONS = {
    "æ": "a", "y": "i", "ø": "e", "œ": "E", "ɘ": "@", "ɶ": "a",
    "ɖ": "d", "ɢ": "g", "ħ": "h", "χ": "x",
    "ɓ": "b", "ɗ": "d", "ʄ": "J", "ɠ": "g",
}
DROPPED_MODIFIERS = ("ʰ", "ʱ", "ʲ", "ʷ", "ˠ", "ˤ", "ⁿ", "ˡ", "˞")
GLOTTAL_MARKS = ("'", "ʼ", "ˀ")


def phone_table() -> list[tuple[str, str, bool]]:
    return [(k, v, False) for k, v in PHONES.items()] + [(k, v, True) for k, v in APPROXIMATIONS.items()]
