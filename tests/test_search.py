"""Search through letter triples, family counts, and the order of documents and lines."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexshape.operators import explore, families, search
from lexshape.sources import pronunciations as PR
from lexshape.sources import reference as REF

NAMES = [(0, "Yoruba", None), (1, "yor", "Oru"), (2, "", ""), (3, None, None), (4, "ab", "cab"), (5, "aaaa", "b"), (6, "Éwé Gbe", "x𝐀yz"), (7, "abc", "bcd")]


@pytest.fixture(scope="module")
def names(spark):
    r = random.Random(3)
    more = [(i, "".join(r.choices("abc", k=r.randint(0, 9))), "".join(r.choices("abc ", k=r.randint(0, 6)))) for i in range(8, 300)]
    return spark.createDataFrame(NAMES + more, "id int, name string, alias string").cache()


@pytest.mark.parametrize("text", ["yor", " ORU ", "ab", "", "abc", "abcd", "aaa", "aaaaa", "éwé", "𝐀yz", "abcab", "zzz"])
def test_an_indexed_search_finds_what_a_scan_finds(spark, names, tmp_path_factory, text):
    index = search.gram_index(names, "id", ["name", "alias"])
    low = text.strip().lower()
    want = {r.id for r in names.collect() if low in (r.name or "").lower() or low in (r.alias or "").lower()}
    assert {r.id for r in search.search(names, "id", ["name", "alias"], text, index).collect()} == want
    path = str(tmp_path_factory.mktemp("grams") / "index")
    search.write_gram_index(index, path, 8)
    got = search.search(names, "id", ["name", "alias"], text, path)
    assert {r.id for r in got.collect()} == want
    if len(low) >= 3:
        assert re.search(r"PartitionFilters: \[[^\]]*bucket", got._jdf.queryExecution().executedPlan().toString())


def test_an_index_holds_a_triple_once_and_nothing_of_short_texts(names, spark):
    index = search.gram_index(names.where("id < 8"), "id", ["name", "alias"])
    assert sorted(r.gram for r in index.where("id = 5").collect()) == ["aaa"] and index.where("id IN (2, 3)").count() == 0
    assert search.gram_index(names.limit(0), "id", ["name"]).count() == 0


def test_family_counts_of_families_in_several_regions(spark):
    r = random.Random(8)
    langs = [(f"l{i}", r.choice(["f1", "f2", "f3", "f4", "", None]), r.choice(["A", "B", "", None])) for i in range(60)]
    languages = spark.createDataFrame(langs, "glottocode string, family string, macroarea string")
    uses = sorted({(r.choice(["s1", "s2", "s3"]), f"l{r.randrange(60)}") for _ in range(90)} | {("hot", f"l{i}") for i in range(60)})
    postings = spark.createDataFrame(uses, "shape string, glottocode string")
    facts = families.family_facts(postings, languages)
    rows = lambda df: sorted(tuple(x.asDict()[c] for c in sorted(df.columns)) for x in df.collect())
    assert rows(families.spread(facts)) == rows(explore.family_spread(postings, languages, ["shape"]))
    assert rows(families.spread_elsewhere(facts, postings)) == rows(explore.shape_spread_elsewhere(postings, languages))
    for unit in ("families", "languages"):
        got = rows(families.region_share(facts, postings, languages, unit))
        assert got == rows(explore.region_share(postings, languages, unit)) and len(got) >= 8


def test_family_counts_in_buckets_are_summed_without_a_shuffle_by_shape(spark, tmp_path):
    facts = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 50).alias("shape"), F.concat(F.lit("f"), F.col("id") % 7).alias("fam"),
                                    F.lit("A").alias("region"), F.lit(1).alias("languages"), F.lit(1).alias("named"))
    facts.write.bucketBy(4, "shape").sortBy("shape").option("path", str(tmp_path / "facts")).saveAsTable("facts_in_buckets")
    out = families.spread(spark.table("facts_in_buckets"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 50
    spark.sql("DROP TABLE facts_in_buckets")


def test_seed_documents_of_a_folder_are_read_in_their_order(spark, tmp_path):
    for name, words in (("b", ["ka", "ma"]), ("a", ["ta", "ba", "da"])):
        doc = {"sources": [{"id": name, "tier": "curated", "license": "CC0-1.0"}], "languages": [{"glottocode": f"l{name}", "name": name}],
               "entries": [{"glottocode": f"l{name}", "ipa": w, "source": name} for w in words]}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    seed = REF.read_seed_json(spark, str(tmp_path))
    got = seed.entries.orderBy("seq").collect()
    assert [r.ipa for r in got] == ["ta", "ba", "da", "ka", "ma"] and len({r.seq for r in got}) == 5
    assert [r.glottocode for r in seed.languages.orderBy("row").collect()] == ["la", "lb"]
    one = REF.read_seed_json(spark, str(tmp_path / "b.json"))
    assert [r.ipa for r in one.entries.orderBy("seq").collect()] == ["ka", "ma"]


def test_senses_are_chosen_in_line_order_however_a_dump_is_split(spark, tmp_path):
    lines = [json.dumps({"word": f"w{i % 40}", "senses": [{"glosses": [f"g{i}"]}]}) for i in range(4000)]
    (tmp_path / "dump.jsonl").write_text("\n".join(lines))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {(r.word, r.sense): r.gloss for r in PR.read_glosses(spark, str(tmp_path / "dump.jsonl")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(f"w{k}", s): f"g{k + 40 * s}" for k in range(40) for s in range(3)}
