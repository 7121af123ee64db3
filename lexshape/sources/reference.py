"""Seed documents and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshape.sources.ordering import with_file_order
from lexshape.sources.wordlists import Dataset, read_csv

_SEED = """sources array<struct<id:string,tier:string,license:string,kind:string>>,
 languages array<struct<glottocode:string,name:string,alias:string,macroarea:string,latitude:double,longitude:double,
   doc_status:string,prosodic_type:string,family:string>>,
 entries array<struct<glottocode:string,ipa:string,gloss:string,concepticon_id:bigint,concepticon_gloss:string,
   source:string,segmented:boolean,exclude:string>>"""


def read_seed_json(spark: SparkSession, path: str) -> Dataset:
    """A hand-made dataset in one JSON document, or in a folder of them (one task a document: the format's own unit).

    Rows are ordered by document, then by their place in it."""
    table = spark.read.schema(_SEED).json(path, multiLine=True)

    def rows(field: str, order: str) -> DataFrame:
        doc = with_file_order(table, "_doc", field)
        return doc.select("_doc", F.posexplode(field).alias("_at", "r")).select(
            "r.*", (F.col("_doc") + F.col("_at")).cast("decimal(34,0)").alias(order))
    sources = rows("sources", "row").drop("row").fillna("word list", ["kind"])
    entries = rows("entries", "seq").withColumn(
        "linked_by", F.lit(None).cast("string")).fillna(False, ["segmented"])
    return Dataset(sources, rows("languages", "row").fillna("", ["alias", "family"]), entries)


def read_glottolog(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ("ID", "Name", "Level", "Family_ID")).drop("row")


def read_wals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(languages, values) of the syllable survey."""
    return (read_csv(spark, f"{path}/languages.csv", ("ID", "Glottocode")).drop("row"),
            read_csv(spark, f"{path}/values.csv", ("ID", "Language_ID", "Parameter_ID", "Value")).drop("row"))


def read_phoible(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parameters, values) of the sound inventories."""
    return (read_csv(spark, f"{path}/parameters.csv", ("ID", "SegmentClass")).drop("row"),
            read_csv(spark, f"{path}/values.csv", ("ID", "Language_ID", "Parameter_ID", "Value", "Inventory_ID")).drop("row"))


def read_concepticon(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ("ID", "GLOSS", "ONTOLOGICAL_CATEGORY", "REPLACEMENT_ID"), sep="\t").drop("row")
