"""Pronunciation dictionaries (``word<TAB>ipa``) and their gloss lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions import wording as W
from lexshape.functions.unicode import strip
from lexshape.session import settle as written
from lexshape.sources.ordering import with_file_order

LANGUAGE_MAP = (
    "iso string, glottocode string, name string, macroarea string, latitude double, longitude double, "
    "doc_status string, prosodic_type string, family string"
)
_FILE = r"([^/=]+)\.tsv(?:/[^/]*)?$"


def read_language_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object ISO code -> language record; keys that start with ``_`` are notes."""
    record = "struct<" + ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in LANGUAGE_MAP.split(", ")[1:]) + ">"
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", F.lit(f"map<string,string>"))
    return raw.select(F.explode(entries).alias("iso", "j")).where(~F.col("iso").startswith("_")).select(
        "iso", F.from_json("j", F.lit(record)).alias("r")).select("iso", "r.*")


def parse_pronunciations(lines: DataFrame) -> DataFrame:
    """Lines (``iso, value, line``) -> words: split at the first tab, noise words dropped."""
    cut = F.instr("value", "\t")
    rows = lines.where(cut > 0).select(
        "iso", "line", strip(F.expr("substring(value, 1, instr(value, '\t') - 1)")).alias("word"),
        strip(F.expr("substring(value, instr(value, '\t') + 1)")).alias("ipa"))
    return rows.where((F.col("ipa") != "") & ~W.is_noise_word(F.col("word")))


def pronunciation_entries(words: DataFrame, languages: DataFrame, glosses: DataFrame | None = None) -> DataFrame:
    """Words of mapped languages as entries, one per gloss; a word without one keeps a single row.

    ``glosses`` are (iso, word, sense, gloss) rows."""
    langs = languages.select("iso", "glottocode")
    out = words.join(langs, "iso")
    if glosses is None:
        out = out.withColumns({"gloss": F.lit(None).cast("string"), "sense": F.lit(0)})
    else:
        g = glosses.where(~W.is_letter_sense(F.col("gloss"))).select(
            "iso", "word", "sense", W.concise_gloss(F.col("gloss")).alias("gloss"))
        out = out.join(g, ["iso", "word"], "left")
    return out.select(
        "glottocode", "ipa", "gloss", F.lit(None).cast("bigint").alias("concepticon_id"),
        F.lit(None).cast("string").alias("concepticon_gloss"), F.lit(K.DICTIONARY_SOURCE["id"]).alias("source"),
        F.lit(True).alias("segmented"), F.lit(None).cast("string").alias("exclude"),
        F.lit(None).cast("string").alias("linked_by"), F.col("line").alias("seq"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the ``*.tsv`` files (or folders) under ``path`` with its file's code."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    return with_file_order(lines, "line", F.regexp_extract("_metadata.file_path", _FILE, 1).alias("iso"), "value").where("iso <> ''")


def read_pronunciations(spark: SparkSession, path: str, languages: DataFrame, glosses: DataFrame | None = None) -> DataFrame:
    return pronunciation_entries(parse_pronunciations(read_lines(spark, path)), languages, glosses)


def dictionary_source(spark: SparkSession) -> DataFrame:
    s = K.DICTIONARY_SOURCE
    return spark.createDataFrame([(s["id"], s["tier"], s["license"], s["kind"])], "id string, tier string, license string, kind string")


_SENSE = "word string, senses array<struct<glosses:array<string>,form_of:string,alt_of:string>>"


def parse_glosses(lines: DataFrame, settle=None) -> DataFrame:
    """Dictionary dump lines (``value, file, line``) -> up to three senses per headword.

    A sense gives its first short gloss that no earlier sense of the headword
    gave; inflected and variant forms give none; broken lines give NULL fields
    and drop out. The limit of three is the format's own rule. The senses are
    written once (by ``settle``, or to the scratch folder), so no line is parsed twice."""
    listed = listed_senses(lines)
    # of equal lists with a single gloss only the first can give it; longer lists may each give another one
    own = F.when(F.size("g") > 1, F.col("order"))
    first = listed.groupBy("word", "g", own.alias("own")).agg(F.min("order").alias("order")).select("word", "order", "g")
    return _choose((settle or written)(first))


def listed_senses(lines: DataFrame) -> DataFrame:
    """(word, order, g): the short glosses of every sense that is a word's own."""
    # a generated row and not a struct: fields of a parsed struct are each parsed for themselves
    e = lines.select("file", "line", F.inline(F.array(F.from_json("value", _SENSE, {"mode": "PERMISSIVE"}))))
    senses = e.where("word is not null and word <> ''").select("word", "file", "line", F.posexplode("senses").alias("at", "s"))
    own = senses.where("coalesce(s.form_of, '') in ('', '[]') and coalesce(s.alt_of, '') in ('', '[]')")
    glosses = F.filter(F.transform("s.glosses", strip), lambda g: (g != "") & (F.char_length(g) <= K.MAX_GLOSS_LENGTH))
    return own.select("word", F.struct("file", "line", "at").alias("order"), glosses.alias("g")).where("size(g) > 0")


def _choose(listed: DataFrame) -> DataFrame:
    """Senses in order, each taking its first gloss not taken yet, three at most.

    Three rounds of "earliest sense that still offers something new": each round
    is an aggregate per headword, so no headword's senses meet in one list."""
    chosen = []
    rest = listed.withColumn("took", F.array().cast("array<string>")).withColumn("after", F.lit(None).cast(listed.schema["order"].dataType))
    for sense in range(K.MAX_GLOSSES):
        fresh = rest.where(F.col("after").isNull() | (F.col("order") > F.col("after"))).withColumn(
            "new", F.array_except("g", "took")).where("size(new) > 0")
        pick = fresh.groupBy("word").agg(F.min(F.struct("order", F.element_at("new", 1).alias("gloss"))).alias("p"))
        chosen.append(pick.select("word", F.lit(sense).alias("sense"), F.col("p.gloss").alias("gloss")))
        rest = fresh.join(pick, "word").select(
            "word", "order", "g", F.array_append("took", F.col("p.gloss")).alias("took"), F.col("p.order").alias("after"))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def read_glosses(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines dictionary dump -> (word, sense, gloss). Lines are ordered by file, block and place in the block."""
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    return parse_glosses(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("line")))
