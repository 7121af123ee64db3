"""A whole catalog from a folder of word lists: read, report, judge, index, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.operators import catalog as CAT
from lexshape.operators import index as IX
from lexshape.operators import linking as L
from lexshape.operators.schemes import TONE_BLIND, Scheme
from lexshape.session import settle
from lexshape.sources import sinks
from lexshape.sources import wordlists as WL


@dataclass(frozen=True)
class Catalog:
    """Finished tables; ``report`` has a row for each dataset found, read or skipped."""
    report: DataFrame
    sources: DataFrame
    languages: DataFrame
    forms: DataFrame
    words: DataFrame
    excluded: DataFrame
    scheme: str = K.SCHEME_VERSION      # of the keys


def read_datasets(spark: SparkSession, root: str) -> tuple[list[WL.Dataset], DataFrame]:
    """The cleared datasets under ``root`` in their order, and (dataset, path, reason) of all; a blocked licence is a reason, not an error."""
    found, rows = [], []
    for path in WL.discover_datasets(spark, root):
        name = WL.read_metadata(spark, path).first()["id"]
        try:
            found.append(WL.read_wordlist(spark, path))
            rows.append((name, path, None))
        except WL.LicenceNotCleared as why:
            rows.append((name, path, str(why)))
    return found, spark.createDataFrame(rows, "dataset string, path string, reason string")


def build_catalog(spark: SparkSession, root: str, glottolog: DataFrame | None = None, concepticon: DataFrame | None = None,
                  scheme: Scheme | None = None) -> Catalog:
    """Build from every cleared word list under ``root``; entries of unknown sources fail the build.

    What came first (dataset, then row) decides; how files are split does not."""
    datasets, report = read_datasets(spark, root)
    if not datasets:
        raise ValueError(f"no cleared word list under {root}")
    sources = settle(CAT.merge_sources(CAT.union_datasets(*[d.sources for d in datasets])))
    languages = CAT.merge_languages(CAT.union_datasets(*[d.languages for d in datasets]))
    entries = settle(CAT.union_datasets(*[d.entries for d in datasets]).drop("dataset_ord"))
    if concepticon is not None:
        entries = L.link_concepts(entries, concepticon)
    if glottolog is not None:
        languages = L.name_languages(languages, glottolog)
    scheme = scheme or TONE_BLIND
    judged = settle(CAT.judge_entries(entries, sources, canonicalizer=scheme.canonicalizer))
    forms = settle(CAT.build_forms(judged))
    counts = entries.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("entries"))
    return Catalog(report.join(counts, "dataset", "left").fillna(0, ["entries"]), sources, CAT.catalog_languages(languages, judged, forms),
                   forms, CAT.build_words(judged), CAT.excluded_counts(judged), scheme.version)


def publish(catalog: Catalog, path: str, version: str, buckets: int) -> None:
    """Write the catalog and its index under ``path/version``, stamped with the key scheme; readers are pointed at it last."""
    spark, folder = catalog.forms.sparkSession, f"{path}/{version}"
    last = sinks.last_entry(spark, f"{path}/current")      # whoever publishes in between is first
    stamp = spark.createDataFrame([(version, catalog.scheme)], "version string, scheme string")
    tables = {"report": catalog.report, "sources": catalog.sources, "languages": catalog.languages, "forms": catalog.forms, "words": catalog.words, "excluded": catalog.excluded,
              "postings": IX.postings(catalog.forms), "shapes": IX.shape_features(catalog.forms), "build": stamp}
    sinks.write_index(tables, folder, {"forms": "glottocode", "postings": "shape"}, buckets)
    sinks.publish_version(spark, f"{path}/current", version, folder, after=last)


def published(spark: SparkSession, path: str, table: str, scheme: str | None = None) -> DataFrame:
    """A table of the version that readers are pointed at; keys made by another scheme are refused."""
    folder = sinks.current_version(spark, f"{path}/current")["dir"]
    built, wanted = spark.read.parquet(f"{folder}/build").first()["scheme"], scheme or K.SCHEME_VERSION
    if built != wanted:
        raise ValueError(f"{folder} was built with key scheme {built}, not {wanted}")
    out = spark.read.parquet(f"{folder}/{table}")
    return out.drop("bucket") if "bucket" in out.columns else out
