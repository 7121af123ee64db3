"""Golden rows for the transcription, syllable and wording rules."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexshape.functions import unicode as U
from lexshape.functions import wording as W
from lexshape.operators import quality, rows

CANON = [
    ("ma˥", False, "ma", "˥", "m a"), ("ma˧˥", False, "ma", "˧˥", "m a"), ("ma", False, "ma", "", "m a"),
    ("to²", False, "to", "²", "t o"), ("bá", False, "ba", "́", "b a"), ("kɔ̄", False, "kɔ", "̄", "k ɔ"),
    ("ɔ̃́", False, "ɔ̃", "́", "ɔ̃"), ("ɑ", False, "ɑ", "", "ɑ"), ("aˑ", False, "aː", "", "aː"),
    ("t͡sa", False, "tsa", "", "ts a"), ("ˈma", False, "ma", "", "m a"), ("ga", False, "ɡa", "", "ɡ a"),
    ("ma:", False, "maː", "", "m aː"), ("ma·", False, "maː", "", "m aː"), ("ȵa", False, "ɲ̟a", "", "ɲ̟ a"),
    ("ȡa", False, "ɟ̟a", "", "ɟ̟ a"), ("tsa33", False, "tsa", "33", "t s a"), ("kʰã˥", False, "kʰã", "˥", "kʰ ã"),
    ("wa͡i", False, "wai", "", "w ai"), ("m ai", True, "mai", "", "m ai"), ("z ə ⁵⁵", True, "zə", "⁵⁵", "z ə"),
    ("mb a", True, "ᵐba", "", "ᵐb a"), ("n d a", True, "nda", "", "n d a"), ("ŋg a", True, "ᵑɡa", "", "ᵑɡ a"),
    ("ʥi", False, "dʑi", "", "dʑ i"), (" ma ", False, "ma", "", "m a"), ("", False, "", "", ""), (None, False, "", None, ""),
]


def test_canonicalize(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CANON)], "i int, ipa string, segmented boolean")
    got = {r["i"]: r for r in rows.canonicalize(df).collect()}
    for i, (ipa, _, key, tone, segments) in enumerate(CANON):
        assert (got[i]["segmental"], got[i]["segments"]) == (unicodedata.normalize("NFC", key), unicodedata.normalize("NFC", segments)), ipa
        assert got[i]["tone"] == tone, ipa


def test_canonical_keys_are_a_fixpoint(spark):
    df = spark.createDataFrame([(c[0],) for c in CANON if c[0] and not c[1]], "ipa string")
    once = rows.canonicalize(df, segmented=False).select(F.col("segmental").alias("ipa"))
    twice = rows.canonicalize(once, segmented=False)
    assert twice.where("ipa <> segmental").count() == 0


def test_normal_forms_agree_with_the_arrow_engine(spark):
    texts = ["é", "ɔ̃́", "ma", "ñandú", "Ǻ", "한", "ệ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for form in ("NFD", "NFC"):
        want = sorted(unicodedata.normalize(form, t) for t in texts if t)
        for engine in ("jvm", "arrow"):
            got = [r[0] for r in rows.normalize_unicode(df, "t", form, engine).collect()]
            assert sorted(g for g in got if g is not None) == want and len(got) == len(texts), (form, engine)


@pytest.mark.parametrize("text,want", [
    ("mai", ["m", "a", "i"]), ("t͡sa", ["t͡s", "a"]), ("na͡u", ["n", "a͡u"]), ("kʰã", ["kʰ", "ã"]), ("͡a", ["͡", "a"]), ("ma:", ["m", "a:"]),
])
def test_graphemes(spark, text, want):
    got = rows.split_graphemes(spark.createDataFrame([(text,)], "ipa string")).first()["graphemes"]
    assert got == [unicodedata.normalize("NFD", w) for w in want]


OPEN = [
    ("m a", True, "high", False), ("s t a", True, "high", False), ("k w a", True, "high", False), ("ai", True, "medium", False),
    ("n au", True, "medium", False), ("a i", False, "high", False), ("r u a", False, "high", False), ("aua", True, "medium", True),
    ("a ɪ̯", True, "medium", True), ("b a j", True, "medium", True), ("m b a", True, "medium", True), ("n k u", True, "medium", True),
    ("m dz a", True, "medium", True), ("n n j a", True, "medium", True), ("mb a", True, "high", False), ("ⁿb a", True, "high", False),
    ("m w a", True, "high", False), ("m a t", False, "high", False), ("s t aː k", False, "high", False), ("m̩", False, "high", False),
    ("s", False, "high", False), ("k i s s a", False, "high", False), ("m a j a", False, "high", False), ("k r̩ b a", False, "high", False),
    ("r̩ k ʂ i", False, "high", False), ("l̥ i", True, "high", False), ("m ã", True, "high", False), ("a j t", False, "high", False),
]


def test_openness(spark):
    df = spark.createDataFrame([(o[0],) for o in OPEN], "segments string")
    got = {r["segments"]: r for r in rows.classify_openness(df).collect()}
    for segments, is_open, confidence, contested in OPEN:
        r = got[segments]
        assert (r["is_open"], r["confidence"], r["contested"]) == (is_open, confidence, contested), (segments, r["reason"])


ONSETS = [
    ("ⁿ b a", "stop"), ("ᵐb a", "stop"), ("ʰ k a", "stop"), ("ᶮ j e", "glide"), ("ˀ d a", "stop"), ("ˀ a", "stop"), ("ɕ a", "fricative"),
    ("ɬ a", "fricative"), ("ʍ ɛ", "fricative"), ("ʨ aː", "affricate"), ("tʃ a", "affricate"), ("t ʃ a", "stop"), ("ʋ a", "glide"),
    ("ɹ a", "liquid"), ("ɲ̟ a", "nasal"), ("ɓ a", "implosive"), ("ǀ a", "click"), ("a", "none"), ("ß a", "other"), ("ʰ a", "none"),
]
BUCKETS = [("m a", "monophthong", "a"), ("m i", "monophthong", "i"), ("m ø", "monophthong", "e"), ("m ɨ", "monophthong", "ə"),
           ("m ʊ", "monophthong", "u"), ("m ɤ", "monophthong", "o"), ("m ɚ", "monophthong", "other"), ("m ai", "diphthong", "diphthong"),
           ("s", "none", "other"), ("m ã", "monophthong", "a")]


def test_features(spark):
    df = spark.createDataFrame([(s, "monophthong") for s, _ in ONSETS], "segments string, nucleus_type string")
    assert {r["segments"]: r["onset_class"] for r in rows.annotate_features(df).collect()} == dict(ONSETS)
    df = spark.createDataFrame([(s, t) for s, t, _ in BUCKETS], "segments string, nucleus_type string")
    assert {r["segments"]: r["nucleus_bucket"] for r in rows.annotate_features(df).collect()} == {s: b for s, _, b in BUCKETS}


def test_clean_keys(spark):
    good = ["ma", "tsa", "ɓa", "ʔa", "ǀa", "ɕa", "ⁿba", "ɲ̟a", "ɡo"]
    bad = ["*ha", "h<m>a", "Vwa", "b|a", "wa+ba", "◌jɐ", "đa", "ȥa", "ßɪj", "Ɵe", "ǥo", "ɩŋʌ", "–mu", "ɡo", "ɿu", "Ŋa", "n-ma", "a,b", ""]
    df = spark.createDataFrame([(s,) for s in good + bad], "segmental string")
    assert sorted(r[0] for r in rows.keep_clean(df).collect()) == sorted(good)


def test_loose_and_conformance(spark):
    df = spark.createDataFrame([("maː",), ("maa",), ("kissa",), ("ǀa",), ("",)], "segmental string")
    assert [r["loose"] for r in rows.loose_key(df).collect()] == ["ma", "ma", "kisa", "ǀa", ""]
    assert [r["conformance"] for r in rows.ipa_conformance(df).collect()] == [1.0, 1.0, 1.0, 0.5, 0.0]


ATTESTED = [
    ("tʃ/tɕ a", None, "tɕ a"), ("z ə t ₇/⁵⁵", None, "z ə t ⁵⁵"), ("ˀd a ₁/¹³ + v a n", None, None), ("k a _ m a", None, None),
    ("a x/", None, None), ("b~p a", None, None), ("r u a", "*rua", None), ("t a", "ta-", None), ("t a", "-ta", None),
    ("", "wa ei", None), ("", "ba", "ba"), ("m  ai", None, "m ai"), ("t a", "='u", None), ("", "", None),
]


def test_attested_forms(spark):
    df = spark.createDataFrame([(i, s, f) for i, (s, f, _) in enumerate(ATTESTED)], "i int, s string, f string")
    got = df.orderBy("i").select(W.attested_ipa(F.col("s"), F.col("f"), F.lit(None).cast("string"))).collect()
    assert [r[0] for r in got] == [w for _, _, w in ATTESTED]


def test_spelling_rules(spark):
    words = ["'bayo", "nga", "ʻai", "māta", "mā", "pé", "tò", "ráy", "síbukuʔ", "pe", "bê", "mư", "tǎ", "la"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    df = df.withColumn("r", W.respell(F.lit("abvd"), F.col("w"))).withColumn(
        "x", W.spelling_exclusion(F.lit("abvd"), F.lit(False), F.col("w"), F.col("r")))
    got = {r["w"]: (r["r"], r["x"]) for r in df.collect()}
    assert [got[w][0] for w in words[:5]] == ["ʔbajo", "ŋa", "ʔai", "maːta", "maː"]
    assert {w for w in words if got[w][1]} == {"pé", "tò", "ráy", "bê", "mư", "tǎ"}
    other = df.select(W.respell(F.lit("other"), F.col("w")).alias("r"), "w").where("r <> w").count()
    assert other == 0


def test_names_noise_and_glosses(spark):
    noise = {"A": True, "USA": True, "க": True, "ന്ധ": True, "്യ": True, "12": True, "": True, "ma": False, "ó": False, "कल": False,
             "क्या": False, "हिन्दी": False, "LONGER": False}
    df = spark.createDataFrame([(w,) for w in noise], "w string")
    assert {r[0]: r[1] for r in df.select("w", W.is_noise_word(F.col("w"))).collect()} == noise
    letter = {"The letter (Ẹ) with low tone": True, "letter of the alphabet": True, "you (plural)": False, "letterbox": False}
    df = spark.createDataFrame([(w,) for w in letter], "w string")
    assert {r[0]: r[1] for r in df.select("w", W.is_letter_sense(F.col("w"))).collect()} == letter
    proto = {"Proto-Polynesian": True, "Proto Malagasy": True, "proto-Chamic": True, "Old Chinese": False, "Protogermanicish": False, "Maori": False}
    df = spark.createDataFrame([(w,) for w in proto], "w string")
    assert {r[0]: r[1] for r in df.select("w", W.is_proto(F.col("w"))).collect()} == proto
    df = spark.createDataFrame([("fear, dread; fright",), ("a; b",), (" , x",)], "w string")
    assert [r[0] for r in df.select(W.concise_gloss(F.col("w"))).collect()] == ["fear", "a", None]
    df = spark.createDataFrame([("To Go",), ("the Straße",), ("anchor",)], "w string")
    assert [tuple(r) for r in df.select(W.gloss_key(F.col("w")), W.wanted_category(F.col("w"))).collect()] == [
        ("go", "Action/Process"), ("strasse", "Person/Thing"), ("anchor", None)]


def test_licences_and_slugs(spark):
    df = spark.createDataFrame([("https://creativecommons.org/licenses/by/4.0/",), ("CC0-1.0",), ("http://creativecommons.org/licenses/by-nd/4.0",), ("",), (None,)], "l string")
    df = df.select(W.licence_id(F.col("l")).alias("id"))
    assert [tuple(r) for r in df.select("id", W.licence_ok(F.col("id"))).collect()] == [
        ("CC-BY-4.0", True), ("CC0-1.0", True), ("CC-BY-ND-4.0", False), ("", False), ("", False)]
    df = spark.createDataFrame([("maː",), ("𐐀a",)], "s string")
    assert [r[0] for r in df.select(U.slug(F.col("s"))).collect()] == ["u006d-0061-02d0", "u10400-0061"]


def test_voice_and_readings(spark):
    df = spark.createDataFrame([("ma",), ("ʼma",), ("tʼa",), ("mã",), ("ɓa",), ("ǀa",), ("kʰa",), ("ʰǀa",)], "shape string")
    got = {r["shape"]: (r["phones"], r["lossy"], r["renderable"]) for r in quality.renderability(df).collect()}
    assert got == {"ma": ("m a", False, True), "ʼma": ("? m a", False, True), "tʼa": ("t a", True, True), "mã": ("m a", True, True),
                   "ɓa": ("b a", True, True), "ǀa": (None, False, False), "kʰa": ("k a", True, True), "ʰǀa": (None, True, False)}
    df = spark.createDataFrame([("ma",), ("ⁿdãː",), ("5a",)], "shape string")
    got = {r["shape"]: r["reading"] for r in quality.describe_shapes(df).collect()}
    assert got["ma"] == "m as in map, then a as in father"
    assert got["ⁿdãː"] == "d as in day, with a short n before it, then a as in father, through the nose, held long"
    assert got["5a"].startswith("a sound with no everyday English match, then")
