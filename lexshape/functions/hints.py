"""Plain-language hints for sounds and marks.

Fixed values: the wording is what a reader hears or sees, so it is stated as is.
"""

# --- fixed values: sounds ----------------------------------------------------
SOUND_HINTS = {
    "a": "a as in father", "e": "e as in café", "i": "ee as in see", "o": "o as in go, without the glide",
    "u": "oo as in food", "ə": "a as in about", "ɛ": "e as in bed", "ɔ": "aw as in law", "ɪ": "i as in sit",
    "ʊ": "oo as in book", "æ": "a as in cat", "ɑ": "a as in father, further back", "ɒ": "o as in British hot",
    "ʌ": "u as in cup", "ɐ": "a as in comma", "ɨ": "ee with the tongue pulled back",
    "ʉ": "oo with the tongue pushed forward", "ɯ": "oo with the lips spread",
    "y": "ee with rounded lips, as in French tu", "ø": "eu as in French peu", "œ": "eu as in French peur",
    "ɤ": "o with the lips spread", "ɘ": "a mid central vowel", "ɵ": "a rounded mid central vowel",
    "ɜ": "ir as in British bird", "ɞ": "a rounded open-mid central vowel", "ɶ": "a with rounded lips",
    "m": "m as in map", "n": "n as in no", "ŋ": "ng as in sing", "ɲ": "ny as in canyon",
    "ɳ": "n with the tongue curled back", "ɴ": "n at the back of the throat",
    "ɱ": "m with lip on teeth, as in comfort", "p": "p as in spin", "b": "b as in bad", "t": "t as in stop",
    "d": "d as in day", "k": "k as in skin", "g": "g as in go", "ɡ": "g as in go", "q": "k far back in the throat",
    "ɢ": "g far back in the throat", "c": "between t and k, tongue on the palate",
    "ɟ": "between d and g, tongue on the palate", "ʈ": "t with the tongue curled back",
    "ɖ": "d with the tongue curled back", "ʔ": "the catch in uh-oh", "ɓ": "b with the air pulled in",
    "ɗ": "d with the air pulled in", "ʄ": "a palatal sound with the air pulled in", "ɠ": "g with the air pulled in",
    "ʛ": "a back g with the air pulled in", "f": "f as in fan", "v": "v as in van", "s": "s as in sun",
    "z": "z as in zoo", "h": "h as in hat", "ʃ": "sh as in shoe", "ʒ": "s as in measure", "θ": "th as in thin",
    "ð": "th as in this", "x": "ch as in Scottish loch", "ɣ": "a voiced loch sound", "χ": "a rasping ch far back",
    "ʁ": "r as in French rouge", "ħ": "a strong h from the throat", "ʕ": "a voiced squeeze in the throat",
    "ɸ": "f blown with both lips", "β": "b with the lips not quite closed", "ç": "h as in huge",
    "ʝ": "a voiced huge sound", "ɕ": "a soft sh, as in Mandarin x", "ʑ": "a soft zh",
    "ʂ": "sh with the tongue curled back", "ʐ": "zh with the tongue curled back", "ɬ": "ll as in Welsh Llanelli",
    "ɮ": "a voiced Welsh ll", "ɦ": "a breathy h", "ʍ": "wh as in which, in some accents", "ʦ": "ts as in cats",
    "ʣ": "ds as in beds", "ʧ": "ch as in church", "ʤ": "j as in judge", "ʨ": "a soft ch", "ʥ": "a soft j",
    "l": "l as in let", "r": "a rolled r", "ɾ": "the tt in American butter", "ɹ": "r as in English red",
    "ɻ": "r with the tongue curled back", "ɽ": "a flapped r with the tongue curled back",
    "ʀ": "a rolled r in the throat", "ɭ": "l with the tongue curled back", "ʎ": "lli as in million",
    "ʟ": "l at the back of the mouth", "ɫ": "the dark l in full", "ɺ": "a flapped l", "w": "w as in wet",
    "j": "y as in yes", "ɥ": "a rounded y, as in French huit", "ɰ": "w with the lips spread",
    "ʋ": "between v and w", "ǀ": "a tsk-tsk click", "ǁ": "the click used to urge a horse", "ǃ": "a cork-pop click",
    "ǂ": "a sharp palatal click", "ʘ": "a kissing click",
}
# --- fixed values: marks -----------------------------------------------------
MARK_HINTS = {
    "ʰ": "with a puff of air", "ʱ": "breathy", "ʷ": "with rounded lips", "ʲ": "with a y-glide",
    "ˠ": "with the tongue raised at the back", "ː": "held long", "ˑ": "held a little longer",
    "ʼ": "popped with the throat closed", "ˀ": "with a catch in the throat", "̃": "through the nose",
    "̥": "whispered", "̊": "whispered", "̪": "with the tongue on the teeth", "̤": "breathy",
    "̰": "creaky", "̩": "as a syllable", "̯": "as a glide", "̆": "very short",
    "̟": "further forward", "̠": "further back", "̝": "raised", "̞": "lowered",
    "̹": "more rounded", "ⁿ": "with a short n before it", "ᵐ": "with a short m before it",
    "ᵑ": "with a short ng before it",
}
PREFIX_MARKS = "ⁿᵐᵑ"
NO_MATCH = "a sound with no everyday English match"


def hint_table() -> list[tuple[str, str, str]]:
    return [(k, "sound", v) for k, v in SOUND_HINTS.items()] + [(k, "mark", v) for k, v in MARK_HINTS.items()]
