"""Word-list directories: languages, parameters, forms and metadata.

``languages.csv``, ``parameters.csv`` and ``forms.csv`` may each be a file or a
folder of part files. Everything is read as text with explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexshape import constants as K
from lexshape import schemas
from lexshape.functions import wording as W
from lexshape.functions.unicode import strip
from lexshape.sources.ordering import with_file_order


@dataclass(frozen=True)
class Dataset:
    """One input: sources, languages and entries (with ``seq``)."""
    sources: DataFrame
    languages: DataFrame
    entries: DataFrame


class LicenceNotCleared(ValueError):
    """The declared licence of a word list is not on the allowlist."""


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = ",") -> DataFrame:
    """CSV as text columns; columns a file lacks come back NULL.

    The header row decides the file's own column order, the projection the rest."""
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(**{**options, "header": False}).csv(path).limit(1).first()
    names = [str(v).lstrip("﻿") for v in header if v is not None] if header else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # quoted fields may hold line breaks, so a file is parsed as a whole, by one task per file
    table = spark.read.options(**options, multiLine=True).schema(schema).csv(path)
    return with_file_order(table, "row", *[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns])


def read_metadata(spark: SparkSession, path: str, default_tier: str = "curated") -> DataFrame:
    """Source id, tier and licence out of the metadata file; the id falls back to the folder."""
    folder = path.rstrip("/").split("/")
    fallback = folder[-2] if len(folder) > 1 else folder[-1]
    raw = spark.read.text([f"{path}/{n}" for n in _existing(spark, path, ("metadata.json", "cldf-metadata.json"))[:1]],
                          wholetext=True)

    def pick(*names: str):
        return F.coalesce(*[F.nullif(F.get_json_object("value", f"$['{n}']"), F.lit("")) for n in names])
    return raw.select(
        F.coalesce(pick("id", "rdf:ID"), F.lit(fallback)).alias("id"),
        F.coalesce(pick("tier"), F.lit(default_tier)).alias("tier"),
        W.licence_id(pick("license", "dc:license")).alias("license"), F.lit("word list").alias("kind"))


def _existing(spark: SparkSession, path: str, names: tuple[str, ...]) -> list[str]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(folder, n))]
    if not found:
        raise FileNotFoundError(f"none of {', '.join(names)} in {path}")
    return found


def wordlist_entries(forms: DataFrame, languages: DataFrame, parameters: DataFrame, source: str) -> DataFrame:
    """Forms joined to languages and parameters, row rules applied, reasons kept.

    Rows that are no attested word, or whose language has no code or is a
    reconstruction, are dropped before anything else touches them."""
    langs = languages.where(~W.is_proto(F.col("Name"))).select(
        F.col("ID").alias("Language_ID"), strip(F.coalesce("Glottocode", F.lit(""))).alias("glottocode")
    ).where("glottocode <> ''").dropDuplicates(["Language_ID"])
    params = parameters.select(
        F.col("ID").alias("Parameter_ID"), F.col("Name").alias("_name"), "Concepticon_ID", "Concepticon_Gloss"
    ).dropDuplicates(["Parameter_ID"])
    rows = forms.withColumn("_ipa", W.attested_ipa(F.col("Segments"), F.col("Form"), F.col("Value"))).where("_ipa is not null")
    rows = rows.withColumn("segmented", F.coalesce(F.col("Segments"), F.lit("")) != "")
    rows = rows.withColumn("_respelled", W.respell(F.lit(source), F.col("_ipa")))
    rows = rows.withColumn("exclude", W.spelling_exclusion(F.lit(source), F.col("segmented"), F.col("_ipa"), F.col("_respelled")))
    joined = rows.join(langs, "Language_ID").join(params, "Parameter_ID", "left")

    def given(name: str):
        return F.nullif(F.col(name), F.lit(""))
    return joined.select(
        "glottocode",
        F.when(F.col("segmented") | F.col("exclude").isNotNull(), F.col("_ipa")).otherwise(F.col("_respelled")).alias("ipa"),
        F.coalesce(given("_name"), given("Concepticon_Gloss"), F.col("Parameter_ID")).alias("gloss"),
        F.nullif(given("Concepticon_ID").try_cast("bigint"), F.lit(0)).alias("concepticon_id"),
        given("Concepticon_Gloss").alias("concepticon_gloss"), F.lit(source).alias("source"), "segmented", "exclude",
        F.lit(None).cast("string").alias("linked_by"), F.col("row").alias("seq"))


def bad_concept_ids(parameters: DataFrame) -> DataFrame:
    """Parameters whose concept id is no number: reported, never guessed."""
    return parameters.where("coalesce(Concepticon_ID, '') <> '' and try_cast(Concepticon_ID as bigint) is null")


def wordlist_languages(languages: DataFrame) -> DataFrame:
    """Languages with a code, first row per code, named by the reference list where given."""
    code = strip(F.coalesce("Glottocode", F.lit("")))
    kept = languages.withColumn("glottocode", code).where((F.col("glottocode") != "") & ~W.is_proto(F.col("Name")))
    official = strip(F.coalesce("Glottolog_Name", F.lit("")))
    name = F.coalesce(F.nullif(official, F.lit("")), F.col("Name"))

    def text(column: str, default: str):
        return F.coalesce(F.col(column), F.lit(default))
    shaped = kept.select(
        "glottocode", name.alias("name"),
        F.when((official != "") & (official != F.col("Name")), F.col("Name")).otherwise("").alias("alias"),
        text("Macroarea", "").alias("macroarea"), F.col("Latitude").try_cast("double").alias("latitude"),
        F.col("Longitude").try_cast("double").alias("longitude"), text("Doc_Status", "moderate").alias("doc_status"),
        text("Prosodic_Type", "unknown").alias("prosodic_type"), strip(text("Family", "")).alias("family"), "row")
    columns = [c for c in shaped.columns if c not in ("glottocode", "row")]
    return shaped.groupBy("glottocode").agg(F.min_by(F.struct(*columns), "row").alias("l"), F.min("row").alias("row")).select(
        "glottocode", "l.*", "row")


def read_wordlist(spark: SparkSession, path: str, default_tier: str = "curated") -> Dataset:
    """Read one word-list directory; raises where its licence is not cleared."""
    meta = read_metadata(spark, path, default_tier)
    source = meta.first()   # one metadata document
    if source["license"] not in K.ALLOWED_LICENCES:
        raise LicenceNotCleared(f"licence {source['license']!r} is not cleared for {source['id']}")
    languages = read_csv(spark, f"{path}/languages.csv", schemas.WORDLIST_LANGUAGES)
    parameters = read_csv(spark, f"{path}/parameters.csv", schemas.WORDLIST_PARAMETERS)
    forms = read_csv(spark, f"{path}/forms.csv", schemas.WORDLIST_FORMS)
    return Dataset(meta, wordlist_languages(languages), wordlist_entries(forms, languages, parameters, source["id"]))


def discover_datasets(spark: SparkSession, root: str, exclude: tuple[str, ...] = K.ORTHOGRAPHIC_DATASETS) -> list[str]:
    """Folders under ``root`` (or their ``cldf`` subfolder) with forms and languages,
    spelling-only sets left out: the ``cldf`` ones first, each group sorted."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)

    def is_dataset(p) -> bool:
        return all(fs.exists(jvm.org.apache.hadoop.fs.Path(p, n)) for n in ("forms.csv", "languages.csv"))
    folders = sorted((s.getPath() for s in fs.listStatus(base) if s.isDirectory()), key=lambda p: p.toString())
    nested = [jvm.org.apache.hadoop.fs.Path(p, "cldf") for p in folders]
    out = []
    for p, name in [(n, f.getName()) for n, f in zip(nested, folders)] + [(f, f.getName()) for f in folders]:
        if name not in exclude and is_dataset(p) and p.toString() not in out:
            out.append(p.toString())
    return out
