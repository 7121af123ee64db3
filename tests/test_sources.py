"""Adapters and sinks on small hand-written inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lexshape.operators import catalog as C
from lexshape.sources import pronunciations as PR
from lexshape.sources import reference as REF
from lexshape.sources import sinks
from lexshape.sources import wordlists as WL


def wordlist(root, name="demo", licence="CC-BY-4.0", source="demo"):
    d = root / name / "cldf"
    d.mkdir(parents=True)
    (d / "metadata.json").write_text(json.dumps({"rdf:ID": source, "dc:license": licence}))
    (d / "languages.csv").write_text("Name,ID,Glottocode,Latitude,Glottolog_Name,Family\nA151,a,aaaa1111,1.5,Nkongho,Fam\nanam,b,bbbb2222,,,\nProto-X,p,pppp3333,,,\nNone,n,,,,\nAgain,a2,aaaa1111,,,\n")
    (d / "parameters.csv").write_text('ID,Name,Concepticon_ID,Concepticon_Gloss\nw,"water, fresh",948,WATER\nx,,oops,SUN\ny,,,\n')
    (d / "forms.csv").write_text('ID,Language_ID,Parameter_ID,Form,Segments\n1,a,w,wai,w ai\n2,b,x,"ma\nma",m a\n3,p,w,ka,k a\n4,n,w,ka,k a\n5,a,y,*ka,k a\n6,a,y,ba,\n7,a2,zz,ta,t a\n')
    return d


def test_read_wordlist(spark, tmp_path):
    ds = WL.read_wordlist(spark, str(wordlist(tmp_path)))
    got = {r["ipa"]: r for r in ds.entries.collect()}
    assert set(got) == {"w ai", "m a", "ba", "t a"}
    assert (got["w ai"]["gloss"], got["w ai"]["concepticon_id"], got["w ai"]["segmented"]) == ("water, fresh", 948, True)
    assert (got["m a"]["gloss"], got["m a"]["concepticon_id"]) == ("SUN", None)
    assert got["ba"]["exclude"] == "spelling without rules" and got["ba"]["gloss"] == "y" and got["t a"]["gloss"] == "zz"
    langs = {r["glottocode"]: r for r in ds.languages.collect()}
    assert set(langs) == {"aaaa1111", "bbbb2222"}
    assert (langs["aaaa1111"]["name"], langs["aaaa1111"]["alias"], langs["aaaa1111"]["latitude"]) == ("Nkongho", "A151", 1.5)
    assert (langs["bbbb2222"]["name"], langs["bbbb2222"]["alias"], langs["bbbb2222"]["doc_status"]) == ("anam", "", "moderate")
    params = WL.read_csv(spark, str(tmp_path / "demo/cldf/parameters.csv"), ("ID", "Concepticon_ID"))
    assert [r["ID"] for r in WL.bad_concept_ids(params).collect()] == ["x"]


def test_licence_gate_and_discovery(spark, tmp_path):
    d = wordlist(tmp_path, "nd", "https://creativecommons.org/licenses/by-nd/4.0/")
    with pytest.raises(WL.LicenceNotCleared):
        WL.read_wordlist(spark, str(d))
    wordlist(tmp_path, "ids")
    wordlist(tmp_path, "bset")
    found = WL.discover_datasets(spark, str(tmp_path))
    assert [f.split("/")[-2] for f in found] == ["bset", "nd"]
    with pytest.raises(FileNotFoundError):
        WL.read_metadata(spark, str(tmp_path))


def test_pronunciations(spark, tmp_path):
    (tmp_path / "tsv").mkdir()
    (tmp_path / "tsv/yor.tsv").write_text("ma\tm a\nA\te\nno tab\n\nba\tb á\textra\nka\t \n")
    (tmp_path / "tsv/zzz.tsv").write_text("ma\tm a\n")
    (tmp_path / "map.json").write_text(json.dumps({"_note": "n", "yor": {"glottocode": "yoru1245", "name": "Yoruba", "latitude": 7.4}, "hau": {"glottocode": "h"}}))
    langs = PR.read_language_map(spark, str(tmp_path / "map.json"))
    assert {r["iso"]: r["glottocode"] for r in langs.collect()} == {"yor": "yoru1245", "hau": "h"}
    glosses = spark.createDataFrame([("yor", "ma", 0, "not; no"), ("yor", "ma", 1, "the letter M"), ("yor", "ma", 2, "do, make")], "iso string, word string, sense int, gloss string")
    got = sorted((r["glottocode"], r["ipa"], r["gloss"] or "") for r in PR.read_pronunciations(spark, str(tmp_path / "tsv"), langs, glosses).collect())
    assert got == [("yoru1245", "b á\textra", ""), ("yoru1245", "m a", "do"), ("yoru1245", "m a", "not")]


def test_gloss_dump(spark, tmp_path):
    lines = [
        {"word": "a", "senses": [{"glosses": ["one", "uno"]}, {"glosses": ["one", "two"]}, {"glosses": ["x"], "form_of": [{"word": "b"}]}]},
        {"word": "a", "senses": [{"glosses": ["y" * 90, " three "]}, {"glosses": ["four"]}]},
        {"word": "b", "senses": [{"glosses": ["one"]}, {"glosses": ["one"]}, {"glosses": []}, {}]}, {"senses": []}, {"word": "c"},
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(x) for x in lines[:2]) + "\n{broken\n" + "\n".join(json.dumps(x) for x in lines[2:]))
    got = sorted((r["word"], r["sense"], r["gloss"]) for r in PR.read_glosses(spark, str(tmp_path / "d.jsonl")).collect())
    assert got == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three"), ("b", 0, "one")]


def test_gloss_lines_are_parsed_once_and_repeats_of_one_gloss_collapse(spark, tmp_path):
    lines = [{"word": "a", "senses": [{"glosses": ["one", "uno"]}, {"glosses": ["one"]}]}, {"word": "a", "senses": [{"glosses": ["one"]}, {"glosses": ["one", "uno"]}]},
             {"word": "a", "senses": [{"glosses": ["one", "uno", "un"]}, {"glosses": ["four"]}]}] + [{"word": "b", "senses": [{"glosses": ["x"]}]}] * 5
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = PR.read_glosses(spark, str(tmp_path / "d.jsonl"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, "one"), ("a", 1, "uno"), ("a", 2, "un"), ("b", 0, "x")]
    assert "from_json" not in got._jdf.queryExecution().optimizedPlan().toString(), "the senses are written"
    raw = spark.read.text(str(tmp_path / "d.jsonl")).selectExpr("value", "'f' AS file", "1 AS line")
    listed = PR.listed_senses(raw)
    assert listed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    kept = []
    PR.parse_glosses(raw, lambda df: kept.append(df) or df).count()
    assert kept[0].where("word = 'b'").count() == 1


def test_seed_and_reference_tables(spark, tmp_path):
    seed = {"sources": [{"id": "s", "tier": "curated", "license": "CC0-1.0"}], "languages": [{"glottocode": "x", "name": "X"}],
            "entries": [{"glottocode": "x", "ipa": "ma", "gloss": "mother", "source": "s"}, {"glottocode": "x", "ipa": "ta", "gloss": "g", "concepticon_id": 5, "source": "s"}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed, indent=1))
    ds = REF.read_seed_json(spark, str(tmp_path / "seed.json"))
    assert ds.sources.first()["kind"] == "word list"
    forms = C.build_forms(C.judge_entries(ds.entries, ds.sources))
    assert sorted(r["shape"] for r in forms.collect()) == ["ma", "ta"]
    (tmp_path / "c.tsv").write_text("ID\tGLOSS\tONTOLOGICAL_CATEGORY\n1\tFIRE\tPerson/Thing\n")
    assert REF.read_concepticon(spark, str(tmp_path / "c.tsv")).first()["REPLACEMENT_ID"] is None


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("ma", "x", 1), ("ma", "y", 2), ("ti", "x", 3)], "shape string, glottocode string, n int")
    path = str(tmp_path / "t")
    sinks.write_partitioned(t, path, "shape", buckets=8)
    hit = sinks.read_key(spark, path, "shape", "ma")
    assert sorted(r["n"] for r in hit.collect()) == [1, 2]
    assert "PartitionFilters: [isnotnull(bucket" in hit._jdf.queryExecution().executedPlan().toString()
    sinks.write_partitioned(t.where("shape = 'ti'").withColumn("n", F.lit(9)), path, "shape", buckets=8, dynamic=True)
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [1, 2, 9]
    sinks.write_partitioned(t.where("shape = 'ti'"), path, "shape", buckets=8)
    assert spark.read.parquet(path).count() == 1, "nothing stale stays"
    sinks.write_index({"a": t, "b": t}, str(tmp_path / "i"), {"a": "shape"}, buckets=4)
    sinks.export_json(t, str(tmp_path / "j"), "shape")
    assert {r["slug"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {"u006d-0061", "u0074-0069"}
    sinks.publish_version(spark, str(tmp_path / "v"), "v1", "builds/v1")
    assert sinks.current_version(spark, str(tmp_path / "v")) == {"version": "v1", "dir": "builds/v1", "chunked": True}
