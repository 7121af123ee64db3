"""Joins of meanings and languages to reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshape.functions import wording as W


def concept_table(concepticon: DataFrame) -> DataFrame:
    """Current concepts whose head word no other current concept shares."""
    rows = concepticon.where(F.coalesce(F.col("REPLACEMENT_ID"), F.lit("")) == "").select(
        F.col("ID").cast("bigint").alias("concept_id"), F.col("GLOSS").alias("concept_gloss"),
        F.trim(F.coalesce(F.col("ONTOLOGICAL_CATEGORY"), F.lit(""))).alias("category"),
        W.head_word(F.col("GLOSS")).alias("head"), W.fold(F.col("GLOSS")).alias("word"))
    lone = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return rows.join(lone, "head", "left_semi").drop("head")


def link_concepts(entries: DataFrame, concepticon: DataFrame) -> DataFrame:
    """Give unlinked glosses the concept their text names, where that is safe.

    The text must equal one unambiguous current concept, the leading word must
    agree with the concept's category, and some entry must already carry the
    concept from its own source. Matching runs on the distinct glosses."""
    table = concept_table(concepticon)
    own = entries.where("concepticon_id is not null and concepticon_id <> 0").select(
        F.col("concepticon_id").alias("concept_id")).distinct()
    unlinked = entries.where(
        "(concepticon_id is null or concepticon_id = 0) and gloss is not null and gloss <> ''")
    glosses = unlinked.select("gloss").distinct().select(
        "gloss", W.gloss_key(F.col("gloss")).alias("word"), W.wanted_category(F.col("gloss")).alias("wants"))
    hits = (glosses.join(table.join(own, "concept_id", "left_semi"), "word")
            .where("wants is null or wants = category")
            .select("gloss", "concept_id", "concept_gloss"))
    free = F.coalesce(F.col("concepticon_id"), F.lit(0)) == 0
    link = free & F.col("concept_id").isNotNull()
    return (entries.join(hits, "gloss", "left")
            .withColumn("linked_by", F.when(link, "gloss").otherwise(F.col("linked_by")))
            .withColumn("concepticon_gloss", F.when(link, F.col("concept_gloss")).otherwise(F.col("concepticon_gloss")))
            .withColumn("concepticon_id", F.when(link, F.col("concept_id")).otherwise(F.col("concepticon_id")))
            .select(*entries.columns))


def families_from_parents(glottolog: DataFrame) -> DataFrame:
    """Top-level family name per language; an isolate is a family of its own."""
    child = glottolog.where(F.col("Level").isin("language", "dialect"))
    parent = glottolog.select(F.col("ID").alias("Family_ID"), F.col("Name").alias("parent_name"))
    joined = child.join(parent, "Family_ID", "left")
    no_parent = F.coalesce(F.col("Family_ID"), F.lit("")) == ""
    return joined.select(
        F.col("ID").alias("glottocode"),
        F.when(no_parent, F.col("Name")).otherwise(F.coalesce(F.col("parent_name"), F.lit(""))).alias("family"))


def name_languages(languages: DataFrame, glottolog: DataFrame) -> DataFrame:
    """Name and classify languages by the reference list; the old name becomes the alias."""
    names = glottolog.where(F.coalesce(F.col("Name"), F.lit("")) != "").select(
        F.col("ID").alias("glottocode"), F.col("Name").alias("_name"))
    fams = families_from_parents(glottolog).where("family <> ''").withColumnRenamed("family", "_family")
    out = languages.join(names, "glottocode", "left").join(fams, "glottocode", "left")
    renamed = F.col("_name").isNotNull() & (F.col("_name") != F.col("name"))
    name = F.coalesce(F.col("_name"), F.col("name"))
    alias = F.when(renamed, F.coalesce(F.nullif(F.col("alias"), F.lit("")), F.col("name"))).otherwise(F.col("alias"))
    return (out.withColumns({"_alias": alias, "_shown": name})
            .withColumns({"family": F.coalesce(F.col("_family"), F.col("family")),
                          "alias": F.when(F.col("_alias") == F.col("_shown"), "").otherwise(F.col("_alias")),
                          "name": F.col("_shown")})
            .select(*languages.columns))


def disambiguate_names(languages: DataFrame, key: str = "glottocode", name: str = "name") -> DataFrame:
    """Append the code where two languages share a name."""
    shared = languages.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = languages.join(shared, name, "left")
    return out.withColumn(name, F.when(F.col("_n").isNotNull(), F.concat(
        F.col(name), F.lit(" ("), F.col(key), F.lit(")"))).otherwise(F.col(name))).select(*languages.columns)


def clear_sources(sources: DataFrame) -> DataFrame:
    """Normalise licences and mark the sources the allowlist clears."""
    return sources.withColumn("license", W.licence_id(F.col("license"))).withColumn(
        "cleared", W.licence_ok(F.col("license")))


def cleared_entries(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries of cleared sources only; a blocked source drops all of its entries."""
    ok = clear_sources(sources).where("cleared").select(F.col("id").alias("source"))
    return entries.join(ok, "source", "left_semi")
