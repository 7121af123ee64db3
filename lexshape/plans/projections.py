"""Lexicon-shaped views of the star-schema test tables (whole tables, whole texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshape import constants as K

TOKEN = r"\p{L}+"
_PLACES = 10 ** 12    # more than any text has words; ``seq`` is a decimal, so no id is too large either


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal texts out where the scan has fewer splits than the cluster has cores (a small file of one row group); otherwise leave them as scanned.

    Texts grow manifold when they are cut into words. A table of many files is split by its scan and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# --- words: documents -> entries ---------------------------------------------

def document_source(source: str = "source", doc_id: str = "doc_id") -> Column:
    """Six provenance lists per document source."""
    return F.concat(F.col(source), F.lit("/"), (F.col(doc_id) % 6).cast("string"))


def words_of(text: str) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as lists of words, the text itself as language: many small samples."""
    d = table(spark, sf_dir, "documents")
    texts = spread(d.select(F.col("doc_id").cast("string").alias("glottocode"), document_source().alias("source"), "text"))
    return texts.select("glottocode", "source", words_of("text").alias("words"))


def word_entries(spark: SparkSession, sf_dir: str, glosses: bool = True, doc_id: bool = False) -> DataFrame:
    """Every word of every text as an entry of its variety (language and source).

    ``seq`` orders entries by text, then by position in the text. ``doc_id`` keeps the text's id."""
    d = table(spark, sf_dir, "documents")
    group = F.col("doc_id") % 40
    # spelling of the gloss varies by text; four neighbouring groups share a word
    word = F.concat(F.lit("sense "), F.floor(group / 4).cast("string"))
    gloss = F.when(F.col("doc_id") % 3 == 0, F.initcap(word)).otherwise(word)
    linked = group % 2 == 0
    concept_gloss = F.upper(F.when(group % 4 == 0, word).otherwise(F.concat(word, F.lit(" (other)"))))
    # everything that belongs to the text is computed per text, before it is cut up
    per_text = [
        "doc_id", "text", F.concat("lang", F.lit("-"), F.col("source")).alias("glottocode"),
        document_source().alias("source")]
    if glosses:
        per_text += [
            F.when(F.col("doc_id") % 7 != 0, gloss).alias("gloss"),
            F.when(linked, group + 1).alias("concepticon_id"),
            F.when(linked, concept_gloss).alias("concepticon_gloss")]
    texts = spread(d.select(*per_text))
    cut = texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(words_of("text")).alias("pos", "ipa"))
    out = cut.select(
        *[c for c in texts.columns if c not in ([] if doc_id else ["doc_id"]) + ["text"]], "ipa", F.lit(False).alias("segmented"),
        F.lit(None).cast("string").alias("exclude"),
        (F.col("doc_id").cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(13,0)") + F.col("pos")).alias("seq"))
    return out.withColumn("linked_by", F.lit(None).cast("string")) if glosses else out


def word_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    part = F.col("doc_id") % 6
    dictionary = F.when(number % 4 == 3, part % 2 == 1).otherwise(number % 2 == 1)
    licences = F.array(F.lit("CC-BY-4.0"), F.lit("https://creativecommons.org/licenses/by-nc/4.0/"),
                       F.lit("CC-BY-SA-4.0"), F.lit("http://creativecommons.org/licenses/by-nd/4.0"))
    tiers = F.array(*[F.lit(t) for t in K.TIERS])
    return d.select(
        document_source().alias("id"), tiers[((part + number) % 3).cast("int")].alias("tier"), licences[number % 4].alias("license"),
        F.when(dictionary, "dictionary").otherwise("word list").alias("kind")).distinct()


def word_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language per variety; a twentieth of the sources name no family or place."""
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return d.select(
        F.concat("lang", F.lit("-"), F.col("source")).alias("glottocode"),
        F.concat(F.lit("Variety "), F.col("source")).alias("name"), F.concat(F.lit("alias "), F.col("lang")).alias("alias"),
        F.col("lang").alias("macroarea"),
        F.when(number % 20 != 19, F.col("source")).otherwise("").alias("family"),
        F.when(number % 20 != 19, (number * 7 % 120 - 60).cast("double")).alias("latitude"),
        F.when(number % 20 != 19, (number * 13 % 360 - 180).cast("double")).alias("longitude"))


# --- yields: suppliers as languages ------------------------------------------

def yield_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as languages: distinct parts ever returned out of distinct parts sold."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    parts = li.groupBy("l_suppkey", "l_partkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("hit"))
    k = parts.groupBy("l_suppkey").agg(F.sum("hit").alias("form_count"), F.count(F.lit(1)).alias("examined"))
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    facts = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    bal = F.col("s_acctbal")
    return facts.join(k, facts.s_suppkey == k.l_suppkey).select(
        F.col("s_suppkey").alias("glottocode"), F.col("s_name").alias("name"), F.col("n_name").alias("family"),
        F.col("r_name").alias("macroarea"),
        F.when(F.col("s_suppkey") % 2 == 0, "word list").otherwise("dictionary").alias("sample"),
        F.when(bal < 2500, "simple").when(bal < 5500, "moderate").when(bal < 8500, "complex").otherwise("").alias("syllable_structure"),
        (F.col("s_suppkey") % 3 == 0).alias("tone_marked"), "form_count", "examined",
        (F.col("s_suppkey") % 181 - 90).cast("double").alias("latitude"),
        F.when(F.col("s_suppkey") % 10 != 9, (F.col("s_suppkey") * 7 % 361 - 180).cast("double")).alias("longitude"))


# --- sound-meaning words: line items -----------------------------------------

def pair_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words: the supplier's language, the part name as meaning,
    brand and type as shape, the nation as family."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("ckey"), F.concat_ws("/", "p_brand", "p_type").alias("shape"))
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    lang = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("family"))
    return (li.join(p, li.l_partkey == p.p_partkey).join(lang, li.l_suppkey == lang.s_suppkey)
            .select(F.col("s_suppkey").alias("language"), "family", "ckey", "shape"))


# --- inventories: customers as languages, orders as their words --------------

_ONSETS = ("stop", "nasal", "fricative", "liquid", "none")


def order_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as words: onset class from the priority, vowel bucket from the month."""
    o = table(spark, sf_dir, "orders")
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    onset = F.array(*[F.lit(x) for x in _ONSETS])[priority - 1]
    nucleus = F.array(*[F.lit(x) for x in K.NUCLEUS_ORDER[:6]])[F.month("o_orderdate") % 6]
    return o.select(F.col("o_custkey").alias("glottocode"), onset.alias("onset_class"), nucleus.alias("nucleus_bucket"),
                    F.col("o_orderstatus").alias("status"))


def order_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds of a customer's orders as a sound inventory (class names only: short lists)."""
    o = order_sounds(spark, sf_dir)
    return o.groupBy("glottocode").agg(
        F.array_sort(F.collect_set(F.nullif(F.col("onset_class"), F.lit("none")))).alias("onsets"),
        F.array_sort(F.collect_set("nucleus_bucket")).alias("nuclei")).where("size(onsets) > 0 and size(nuclei) > 0")


def customer_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("glottocode"), F.col("c_name").alias("name"), F.col("n_name").alias("family"),
        F.col("c_mktsegment").alias("macroarea"))
