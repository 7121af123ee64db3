"""Views over a catalog: cells, shares and listings that must also show what is absent."""

import pytest
from pyspark.sql import functions as F

from lexshape.operators import catalog, explore, index, quality, rates
from lexshape.sources import sinks


def languages(spark):
    rows = [(f"{r}{k}", r.upper(), f"f{r}{k}", 5) for r in "ab" for k in range(6)]
    return spark.createDataFrame(rows, "glottocode string, macroarea string, family string, examined long")


def test_regions_without_a_shape_are_listed(spark):
    postings = spark.createDataFrame([(f"{r}{k}", f"s{r}") for r in "ab" for k in range(6)], "glottocode string, shape string")
    got = {(r.region, r["shape"]): (r.hits, r.total, r.share) for r in explore.region_share(postings, languages(spark)).collect()}
    assert got == {("A", "sa"): (6, 6, 1.0), ("A", "sb"): (0, 6, 0.0), ("B", "sa"): (0, 6, 0.0), ("B", "sb"): (6, 6, 1.0)}


def test_unexamined_languages_do_not_count(spark):
    cells = spark.createDataFrame([(f"a{k}", "stop", "a") for k in range(5)], "glottocode string, onset_class string, nucleus_bucket string")
    inventories = spark.createDataFrame([(f"{r}{k}", ["stop"], ["a"]) for r in "ab" for k in range(6)], "glottocode string, onsets array<string>, nuclei array<string>")
    langs = languages(spark).withColumn("examined", F.when(F.col("glottocode").startswith("b"), 0).otherwise(5))
    got = {(r.onset_class, r.nucleus_bucket): (r.use, r.could) for r in explore.observed_share(cells, inventories, langs).collect()}
    assert got == {("stop", "a"): (5, 6)}


def test_the_full_grid_has_the_empty_cells(spark):
    cells = spark.createDataFrame([("stop", "a", 3, 2, 1, 1, 1, -1)], "onset_class string, nucleus_bucket string, languages long, families long, curated long, mined long, generated long, step int")
    grid = explore.heatmap_grid(cells)
    assert grid.columns == cells.columns and grid.count() == explore.heatmap_axes(spark).count()
    assert grid.agg(F.sum("languages"), F.max("step")).first()[:] == (3, -1)


def test_top_shape_of_shapes_that_one_language_has(spark):
    postings = spark.createDataFrame([("l1", "ta"), ("l2", "ma")], "glottocode string, shape string")
    assert explore.top_shape(postings).collect()[0][:] == ("ma", 1)


def test_listings_are_whole_unless_a_limit_is_given(spark):
    langs = spark.range(700).select(F.col("id").cast("string").alias("glottocode"), F.lit("word list").alias("sample"), F.lit(1).alias("form_count"), (F.col("id") + 1).alias("examined"))
    assert rates.rank_languages(langs).count() == 700 and rates.rank_languages(langs, 3).count() == 3
    summary = spark.range(700).select(F.col("id").alias("ckey"), F.lit(1).alias("fam_count"), F.lit(1).alias("shape_count"), F.lit(0).alias("beyond"))
    assert explore.top_meanings(summary).count() == 700


def test_gloss_preview_of_a_large_group(spark):
    g = spark.range(1000).select(F.lit("l").alias("glottocode"), F.lit("s").alias("shape"), F.concat(F.lit("g"), F.col("id")).alias("gloss"), (1000 - F.col("id")).alias("seq"))
    assert explore.gloss_preview(g).collect()[0].asDict() == {"glottocode": "l", "shape": "s", "preview": "g999, g998, g997", "more": 997}


def test_entries_of_unknown_sources_fail(spark):
    entries = spark.createDataFrame([("l", "ta", False, None, "known", 0), ("l", "ma", False, None, "lost", 1)], "glottocode string, ipa string, segmented boolean, exclude string, source string, seq long")
    sources = spark.createDataFrame([("known", "curated", "word list")], "id string, tier string, kind string")
    assert [r.source for r in catalog.missing_sources(entries, sources).collect()] == ["lost"]
    assert catalog.attach_sources(entries.where("seq = 0"), sources).collect()[0].tier_rank == 0
    with pytest.raises(Exception, match="unknown source lost"):
        catalog.attach_sources(entries, sources).collect()


def test_the_union_of_datasets_is_ordered_by_dataset_then_row(spark):
    a, b = (spark.createDataFrame([(x, n) for n, x in enumerate(names)], "name string, seq long") for names in ("xy", "zw"))
    got = catalog.union_datasets(a, b).orderBy("seq").collect()
    assert [r.name for r in got] == ["x", "y", "z", "w"] and len({r.seq for r in got}) == 4


def test_read_key_knows_the_layout(spark, tmp_path):
    table = spark.range(40).select((F.col("id") % 7).cast("int").alias("key"), "id")
    sinks.write_partitioned(table, f"{tmp_path}/t", "key", buckets=5)
    assert sinks.read_key(spark, f"{tmp_path}/t", "key", 3).count() == 6
    assert spark.read.parquet(f"{tmp_path}/t").count() == 40
    with pytest.raises(ValueError):
        sinks.read_key(spark, f"{tmp_path}/t", "id", 3)
    with pytest.raises(ValueError):
        sinks.write_partitioned(table, f"{tmp_path}/t", "key", buckets=6, dynamic=True)


def test_the_audit_finds_planted_violations(spark):
    form = "glottocode string, shape string"
    forms = spark.createDataFrame([("l1", "ta"), ("l1", "ta"), ("l1", "tA"), ("l2", "tak")], form)
    langs = spark.createDataFrame([("l1", 2, 1), ("l2", 5, 9)], "glottocode string, form_count long, examined long")
    sources = spark.createDataFrame([("s", "CC-BY-ND-4.0"), ("t", "CC-BY-4.0")], "id string, license string")
    got = {r.check: r.violations for r in quality.audit_catalog(forms, langs, sources).collect()}
    assert got["form counts add up"] == 3 and got["one form per language and shape"] == 1 and got["examined covers forms"] == 1
    assert got["keys are clean"] == 1 and got["no blocked licence"] == 1 and got["shapes are open"] >= 1


def test_word_order_of_concept_entries(spark):
    glosses = spark.createDataFrame([("l", "s", "", "a", None, None, None, "x", 0, 5), ("l", "s", "", "b", None, None, None, "x", 0, 3)],
                                    "glottocode string, shape string, tone string, gloss string, concepticon_id long, concepticon_gloss string, linked_by string, source string, tier_rank int, seq long")
    forms = spark.createDataFrame([("l", "s", 0, 0, False)], "glottocode string, shape string, tier_rank int, cc_rank int, under_review boolean")
    assert {r.word_seq for r in index.concept_entries(glosses, forms).collect()} == {3}
