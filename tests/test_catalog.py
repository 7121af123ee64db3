"""Order rules, exclusions, disagreement, merges, labels, linking, releases."""

import pytest
from pyspark.sql import functions as F

from lexshape import schemas
from lexshape.operators import catalog as C
from lexshape.operators import index as IX
from lexshape.operators import linking as L
from lexshape.operators import quality as Q
from lexshape.operators import typology as TY
from lexshape.streaming import releases as RL

SOURCES = [("c1", "curated", "CC-BY-4.0", "word list"), ("c2", "curated", "CC-BY-NC-4.0", "word list"),
           ("m1", "mined", "CC-BY-SA-3.0", "dictionary"), ("g1", "generated", "CC0-1.0", "dictionary")]


def entries(spark, rows):
    """rows: (language, ipa, source, gloss, concept id, segmented, exclude)"""
    full = []
    for i, r in enumerate(rows):
        g, ipa, src, gloss, cid, seg, exc = tuple(r) + (None,) * (7 - len(r))
        full.append((g, ipa, gloss, cid, None, src, bool(seg), exc, None, i))
    return spark.createDataFrame(full, schemas.ENTRIES)


def sources(spark):
    return spark.createDataFrame(SOURCES, "id string, tier string, license string, kind string")


def forms(spark, rows, **kw):
    return {(r["glottocode"], r["shape"]): r for r in C.build_forms(C.judge_entries(entries(spark, rows), sources(spark)), **kw).collect()}


def test_first_entry_decides_whether_a_form_is_forced_low(spark):
    a = forms(spark, [("x", "ma", "g1"), ("x", "ma", "c1")])[("x", "ma")]
    b = forms(spark, [("x", "ma", "c1"), ("x", "ma", "g1")])[("x", "ma")]
    assert (a["tier_rank"], a["cc_rank"], a["under_review"]) == (0, 2, True)
    assert (b["tier_rank"], b["cc_rank"], b["under_review"]) == (0, 0, False)
    assert a["sources"] == ["g1", "c1"] and b["sources"] == ["c1", "g1"]
    assert a["preferred_source"] == b["preferred_source"] == "c1"


def test_tones_sources_and_worst_confidence(spark):
    f = forms(spark, [("x", "ma˥", "m1"), ("x", "ma", "c2"), ("x", "ma˩", "c1"), ("x", "n k u", "c1", None, None, True), ("x", "nku", "c1")])
    assert f[("x", "ma")]["tones"] == ["˥", "˩"] and f[("x", "ma")]["sources"] == ["m1", "c2", "c1"]
    assert f[("x", "ma")]["preferred_source"] == "c1"
    assert (f[("x", "nku")]["cc_rank"], f[("x", "nku")]["under_review"]) == (1, True)


def test_one_word_that_two_sources_judge_differently_goes_under_review(spark):
    rows = [("x", "maa", "c1", "mother"), ("x", "maː", "c2", "Mother"), ("x", "taa", "c1", "father"), ("x", "taː", "c1", "father")]
    f = forms(spark, rows)
    assert f[("x", "maː")]["disputed"] and f[("x", "maː")]["under_review"]
    assert not f[("x", "taː")]["under_review"], "one source cannot disagree with itself"


def test_words_counts_and_exclusions(spark):
    rows = [("x", "ma", "c1", "mother"), ("x", "ma", "c2", "mother"), ("x", "ma", "c1", "mother"), ("x", "ma˥", "m1", "horse"),
            ("x", "mat", "c1", "mat"), ("x", "*ka", "c1"), ("x", "ê", "c1", None, None, False, "spelling"), ("y", "mat", "m1"), ("y", "*a", "m1"), ("z", "*a", "c1")]
    j = C.judge_entries(entries(spark, rows), sources(spark))
    words = {(r["shape"], r["tone"]): r for r in C.build_words(j).collect()}
    assert words[("ma", "")]["glosses"] == 2 and words[("ma", "")]["sources"] == ["c1", "c2"]
    assert words[("ma", "˥")]["tier_rank"] == 1
    nested = {(r["shape"], r["tone"]): r["gloss_set"] for r in C.nest_glosses(j).collect()}
    assert [g["source_id"] for g in nested[("ma", "")]] == ["c1", "c2"]
    counts = {r["glottocode"]: r for r in C.language_counts(j).collect()}
    assert (counts["x"]["examined"], counts["x"]["sample"], counts["x"]["tone_marked"]) == (2, "mixed", False)
    assert (counts["y"]["examined"], counts["y"]["sample"]) == (1, "dictionary") and "z" not in counts
    assert {r["glottocode"]: r["examined"] for r in C.examined(j).collect()} == {"x": 2, "y": 1}
    assert {r["reason"]: r["rows"] for r in C.excluded_counts(j).collect()} == {"coda": 2, "not clean notation": 3, "spelling": 1}
    langs = spark.createDataFrame([("x",), ("y",), ("z",)], "glottocode string")
    f = C.build_forms(j)
    assert sorted(r[0] for r in C.judged_languages(langs, j).collect()) == ["x", "y"]
    assert [r[0] for r in C.zero_form_languages(C.judged_languages(langs, j), f).collect()] == ["y"]
    full = C.catalog_languages(langs.withColumn("family", F.lit("")), j, f)
    audit = {r["check"]: r["violations"] for r in Q.audit_catalog(f, full, sources(spark)).collect()}
    assert set(audit.values()) == {0}
    safe = {r["shape"] for r in Q.commercial_safe(f, sources(spark)).collect()}
    assert safe == set(), "the only form also cites a non-commercial source"
    assert [r[0] for r in C.missing_sources(entries(spark, [("x", "a", "zz")]), sources(spark)).collect()] == ["zz"]


def test_a_release_equals_a_rebuild(spark):
    rows = [("x", "ma", "g1"), ("x", "ma˥", "c1"), ("x", "ti", "m1"), ("y", "ma", "c2"), ("x", "ti", "c1"), ("x", "ti˩", "m1"), ("y", "ko", "g1")]
    e, s = entries(spark, rows), sources(spark)
    whole = C.build_forms(C.judge_entries(e, s, glosses=False), disagreement=False)
    state = RL.release_state(C.judge_entries(e.where("seq < 3"), s, glosses=False))
    parts = RL.forms_of_release(RL.merge_release(state, e.where("seq >= 3"), s))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_releases_equal_a_rebuild_and_leave_other_buckets_alone(spark, tmp_path):
    rows = [("x", "maa", "c1", "mother"), ("y", "ta", "m1", "horse"), ("y", "mat", "m1", "mat"), ("z", "*a", "c1"),
            ("x", "maː", "c2", "Mother"), ("x", "ma˥", "g1", "horse"), ("x", "ma˥", "g1", "horse"), ("w", "ko", "c1", None, 7)]
    e, s = entries(spark, rows), sources(spark)
    first, second = (C.judge_entries(e.where(part), s) for part in ("seq < 4", "seq >= 4"))
    store = RL.Releases(spark, str(tmp_path / "r"), 64)
    with pytest.raises(ValueError, match="no release"):
        store.forms()
    assert store.add("first", first) and not any(r["disputed"] for r in store.forms().collect())
    assert store.add("second", second) and not store.add("second", second), "a release counts once"

    whole = C.judge_entries(e, s)
    for got, expected in [(store.forms(), C.build_forms(whole)), (store.words(), C.build_words(whole)), (store.language_counts(), C.language_counts(whole)),
                          (store.excluded_counts(), C.excluded_counts(whole))]:
        assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert [r["shape"] for r in store.forms().where("disputed").collect()] == ["maː"]

    bucket = {r["glottocode"]: r["b"] for r in e.select("glottocode", F.expr("pmod(xxhash64(glottocode), 64)").alias("b")).distinct().collect()}
    folders = {p.name for p in (tmp_path / "r" / "forms" / "release=2").iterdir() if p.is_dir()}
    assert folders == {f"bucket={bucket[g]}" for g in "xw"}, "only what the entries touch is rewritten"
    live = {r["bucket"]: r["release"] for r in store._live(2).collect()}
    assert live == {bucket["x"]: 2, bucket["w"]: 2, bucket["y"]: 1, bucket["z"]: 1}


def test_a_failed_release_leaves_no_trace(spark, tmp_path):
    e, s = entries(spark, [("x", "ma", "c1"), ("x", "ma", "c2")]), sources(spark)
    store = RL.Releases(spark, str(tmp_path / "r"), 4, ("forms", "samples"))
    store.add("first", C.judge_entries(e.where("seq = 0"), s))
    # what a writer that died before its log entry leaves behind
    C.form_state(C.judge_entries(e, s)).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(str(tmp_path / "r" / "forms" / "release=2"))
    assert [r["sources"] for r in C.forms_from_state(store.state("forms")).collect()] == [["c1"]]
    assert store.add("second", C.judge_entries(e.where("seq = 1"), s))
    assert [r["sources"] for r in C.forms_from_state(store.state("forms")).collect()] == [["c1", "c2"]]
    assert store.add("nothing", C.judge_entries(e.where("seq > 1"), s)), "a release may be empty"
    assert store.state("forms").agg(F.sum("rows")).first()[0] == 2


def test_merges(spark):
    s = spark.createDataFrame([("a", "curated", "x", "k", 0), ("a", "mined", "y", "k", 1)], "id string, tier string, license string, kind string, dataset_ord int")
    assert [r["tier"] for r in C.merge_sources(s).collect()] == ["mined"]
    langs = spark.createDataFrame([("x", "one", "", 0, 0), ("x", "two", "Fam", 1, 0), ("x", "three", "Late", 2, 0), ("y", "solo", "", 0, 1)],
                                  "glottocode string, name string, family string, dataset_ord int, row int")
    got = {r["glottocode"]: (r["name"], r["family"]) for r in C.merge_languages(langs).collect()}
    assert got == {"x": ("one", "Fam"), "y": ("solo", "")}


LABELS = [
    ({"1209": (1209, "I", {"I": 5, "i": 1})}, {"1209": "I"}),
    ({"948": (948, "WATER", {"water": 30}), "3078": (3078, "IRRIGATE", {"water": 22})}, {"948": "water", "3078": "irrigate"}),
    ({"658": (658, "RAIN (PRECIPITATION)", {"rain": 19}), "1253": (1253, "RAIN (RAINING)", {"rain": 4}), "2108": (2108, "RAINING OR RAIN", {"RAIN": 4})},
     {"658": "rain (precipitation)", "1253": "rain (raining)", "2108": "raining or rain"}),
    ({"1498": (1498, "TWO", {"two": 230}), "g-x": (None, None, {"two": 2})}, {"1498": "two", "g-x": "two (unlinked)"}),
    ({"1446": (1446, "COME", {"to come": 197, "come": 137}), "g-a": (None, None, {"to come": 3}), "g-b": (None, None, {"come": 4})},
     {"1446": "to come", "g-a": "to come (unlinked)", "g-b": "come"}),
    ({"1498": (1498, "TWO", {"Two": 155, "two": 117})}, {"1498": "two"}),
    ({"1": (1, "A", {"x": 2}), "2": (2, None, {"x": 1})}, {"1": "a", "2": "x (2)"}),
]


@pytest.mark.parametrize("concepts,want", LABELS)
def test_labels(spark, concepts, want):
    rows = [(k, g, cid, cg, n) for k, (cid, cg, votes) in concepts.items() for g, n in votes.items()]
    df = spark.createDataFrame(rows, "ckey string, gloss string, concepticon_id bigint, concepticon_gloss string, votes bigint")
    assert {r["ckey"]: r["label"] for r in IX.concept_labels(df).collect()} == want


def test_linking(spark):
    table = spark.createDataFrame(
        [("1", "FIRE", "Person/Thing", ""), ("2", "GO", "Action/Process", None), ("3", "NAIL", "Person/Thing", None), ("4", "NAIL (TOOL)", "Person/Thing", None),
         ("5", "OLD", "Property", "6"), ("7", "SUN", "Person/Thing", None)], "ID string, GLOSS string, ONTOLOGICAL_CATEGORY string, REPLACEMENT_ID string")
    e = entries(spark, [("x", "a", "c1", g, c) for g, c in [
        ("fire", 1), ("go", 2), ("nail", 3), ("The Fire", None), ("to fire", None), ("to go", None), ("nail", None), ("sun", None), ("old", None), (None, None)]])
    got = {(r["gloss"], r["concepticon_id"], r["linked_by"]) for r in L.link_concepts(e, table).where("linked_by is not null").collect()}
    assert got == {("The Fire", 1, "gloss"), ("to go", 2, "gloss")}


def test_names_and_typology(spark):
    gl = spark.createDataFrame([("f1", "Big Family", "family", None), ("a", "Anam", "language", "f1"), ("b", "Lone", "language", None), ("c", "Far", "dialect", "gone")],
                               "ID string, Name string, Level string, Family_ID string")
    assert {r[0]: r[1] for r in L.families_from_parents(gl).select("glottocode", "family").collect()} == {"a": "Big Family", "b": "Lone", "c": ""}
    langs = spark.createDataFrame([("a", "anam", "", "x"), ("b", "Lone", "Lone", ""), ("z", "Zed", "zz", "y")], "glottocode string, name string, alias string, family string")
    got = {r["glottocode"]: (r["name"], r["alias"], r["family"]) for r in L.name_languages(langs, gl).collect()}
    assert got == {"a": ("Anam", "anam", "Big Family"), "b": ("Lone", "", "Lone"), "z": ("Zed", "zz", "y")}
    wl = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "")], "ID string, Glottocode string")
    wv = spark.createDataFrame([("1", "12A", "1"), ("2", "12A", "3"), ("3", "12A", "2"), ("4", "12A", "1"), ("3", "13A", "1")], "Language_ID string, Parameter_ID string, Value string")
    assert [tuple(r) for r in TY.syllable_structure(wl, wv).collect()] == [("b", "moderate")]
    pp = spark.createDataFrame([("m", "consonant"), ("a", "vowel"), ("t", "tone")], "ID string, SegmentClass string")
    pv = spark.createDataFrame([("a", "m", "m"), ("a", "a", "aː"), ("a", "t", "˥"), ("a", "m", "ts"), ("a", "a", "ai"), ("b", "m", "k")], "Language_ID string, Parameter_ID string, Value string")
    inv = {r["glottocode"]: (r["onsets"], r["nuclei"]) for r in TY.inventories(pp, pv).collect()}
    assert inv == {"a": (["affricate", "nasal"], ["a", "diphthong"])}


def test_ranks_of_a_hot_group(spark):
    from lexshape.operators.ranking import rank_within
    rows = [("hot", i % 7, f"s{i}") for i in range(500)] + [("cold", i, f"c{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "g string, n int, s string")
    got = rank_within(df, ["g"], [F.desc("n"), F.asc("s")], parts=6).collect()
    for g in ("hot", "cold"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["n"], r["s"]))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_words_are_judged_once_and_one_without_a_segmented_flag_stays(spark, tmp_path):
    e = entries(spark, [("l0", "ta", "c1"), ("l1", "ta", "m1")])
    e = e.withColumn("segmented", F.expr("if(glottocode = 'l1', cast(null AS boolean), segmented)"))
    for glosses in (True, False):
        j = C.judge_entries(e, sources(spark), glosses)
        assert sorted((r.glottocode, r["shape"], r.is_open) for r in j.collect()) == [("l0", "ta", True), ("l1", "ta", True)]
    e.write.parquet(str(tmp_path / "e"))
    judged = C.judge_entries(spark.read.parquet(str(tmp_path / "e")), sources(spark))
    judged.write.parquet(str(tmp_path / "j"))
    once = C.cross_source_disagreement(spark.read.parquet(str(tmp_path / "j")))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_words_closed_by_their_letters_are_judged_as_by_the_rules(spark):
    import itertools
    letters = ["".join(w) for n in (1, 2, 3) for w in itertools.product("aiybgjmwz", repeat=n)] + ["abe\n", "Abe", "a1e", "abé", "kst ", "", "mb"]
    rows = [(f"l{i % 3}", w, ("c1", "m1")[i % 2], None, None, seg, "spelling" if i % 11 == 0 else None)
            for i, w in enumerate(letters) for seg in (False, True)] + [("l9", "maː˥", "m1"), ("l9", "ma", "c1"), ("l9", "*a", "c1"), ("l9", "tata", "c1")]
    e, s = entries(spark, rows), sources(spark)
    whole, counted, toned = C.judge_entries(e, s, glosses=False), C.judge_for_counts(e, s), C.judge_for_counts(e, s, reasons=False)
    for f, j in ((C.excluded_counts, counted), (C.tone_marked, counted), (C.tone_marked, toned)):
        assert sorted(map(tuple, f(j).collect())) == sorted(map(tuple, f(whole).collect()))
    assert toned.count() < counted.count() < whole.count()
    spoken = whole.where("is_open")
    assert spoken.count() and sorted(map(str, C.judge_open(e, s, glosses=False).select(*spoken.columns).collect())) == sorted(map(str, spoken.collect()))


def test_texts_are_counted_as_their_words_judged_one_by_one(spark):
    import unicodedata
    letters = [chr(c) for c in [*range(0xC0, 0x2C0), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c))[0] == "L"] + ["ʦ", "ː", "ʰ", "ж"]
    texts = []
    for i, c in enumerate(letters):         # a letter beside the one it decomposes to
        b = unicodedata.normalize("NFD", c)[0]
        texts.append((f"t{i}", "c1", [x + w + y for x in ("", "m", "ga") for w in (c, b) for y in ("", "b")] + [c, c + c]))
    texts += [("x", "c1", ["ma", "má", "ma", "ga", "\u0261a"]), ("x", "m1", ["ma", "ta", "tü"]), ("y", "m1", ["e\u0361", "é", "e", "*a", "e˥", " e", "te\n", ""]),
              ("z", "c1", ["*a", "ß"]), ("w", "c1", []), ("v", "c1", ["é", "è", "e"]), ("u", "m1", ["é", "e", "e"]), (None, "c1", ["ma", "má"]), (None, "m1", ["ma"]),
              ("s", "c1", None), ("r", None, ["ma", "tü"])]
    t = spark.createDataFrame(texts, "glottocode string, source string, words array<string>")
    e = t.select("glottocode", "source", F.explode("words").alias("ipa")).withColumns(
        {"segmented": F.lit(False), "exclude": F.lit(None).cast("string"), "seq": F.monotonically_increasing_id()})
    whole, judged = C.judge_entries(e, sources(spark), glosses=False), C.judge_texts(t, sources(spark))
    got = C.text_counts(judged).collect()
    assert sorted(map(str, got)) == sorted(map(str, C.language_counts(whole).collect()))
    assert {r["glottocode"]: r["examined"] for r in got if str(r["glottocode"]) in "rsuvwxyzNone"} == {"r": 2, "u": 1, "v": 1, "x": 4, "y": 2, None: 1}
    langs = t.select("glottocode").distinct()
    assert sorted(map(str, C.judged_languages(langs, judged).collect())) == sorted(map(str, C.judged_languages(langs, whole).collect()))
    assert judged.where("glottocode = 'v'").count() == 1 and judged.where("glottocode = 'x'").count() == 8


def test_words_of_texts_are_counted_before_any_shuffle(spark):
    from lexshape.plans.queries import QUERIES
    for name in ("document_counts", "judged_languages"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate ") == 1 and "array_distinct" in plan, "texts are cut once, each word of a-z leaves with its text"


def test_open_words_are_judged_without_shuffling_the_others(spark):
    e, s = entries(spark, [("x", "ma", "c1", "mother"), ("x", "ma", "c1", "mother"), ("x", "tata", "m1"), ("x", "mat", "m1")]), sources(spark)
    j = C.judge_open(e, s)
    assert [(r["shape"], r["rows"], r["tier_rank"]) for r in j.collect()] == [("ma", 2, 0)]
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan.split("Aggregate")[-1], "closed words leave below the grouping"
    with pytest.raises(Exception, match="unknown source lost"):
        C.judge_open(entries(spark, [("x", "tata", "lost"), ("x", "ma", "c1")]), s).collect()
