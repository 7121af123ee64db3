"""A published catalog of concepts and forms, and the views that read it.

Tables are Spark tables bucketed by their key: forms, postings and shapes by shape, concept entries, labels and bands by concept.
A view reads them instead of judging texts again; tables of one key join bucket by bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshape.operators import baseline as B
from lexshape.operators import catalog as CAT
from lexshape.operators import explore as X
from lexshape.operators import families as FA
from lexshape.operators import index as IX
from lexshape.session import settle
from lexshape.sources import sinks

KEYS = {"forms": "shape", "postings": "shape", "shapes": "shape", "families": "shape", "concepts": "ckey", "labels": "ckey", "bands": "ckey", "languages": "glottocode"}


def publish_concepts(judged: DataFrame, languages: DataFrame, database: str, path: str, buckets: int, names: list[str] | None = None) -> Published:
    """Write forms, index, family counts, concepts, labels and chance bands of judged entries as tables of ``database``; or only those ``names``.

    Glosses are needed for concepts, labels and bands alone."""
    spoken = settle(judged.where("is_open"))
    forms = settle(CAT.build_forms(spoken, disagreement=False))
    posts = IX.postings(forms)
    tables = {"forms": forms, "postings": posts, "shapes": IX.shape_features(forms), "families": FA.family_facts(posts, languages), "languages": languages}
    if names is None or {"concepts", "labels", "bands"} & set(names):
        concepts = settle(IX.concept_entries(CAT.word_glosses(spoken), forms))
        tables |= {"concepts": concepts, "labels": IX.concept_labels(concepts)}
    if names is None or "bands" in names:
        words = concepts.join(languages.select("glottocode", "family"), "glottocode").select(F.col("glottocode").alias("language"), "family", "ckey", "shape")
        tables["bands"] = B.chance_bands(words, settle=settle)
    sinks.write_tables({k: v for k, v in tables.items() if names is None or k in names}, database, KEYS, buckets, path)
    return Published(judged.sparkSession, database)


@dataclass(frozen=True)
class Published:
    """The tables of a published catalog, and its views."""
    spark: SparkSession
    database: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def heatmap(self) -> DataFrame:
        return X.heatmap(self["shapes"], self["postings"], self["languages"])

    def family_spread(self) -> DataFrame:
        return X.family_spread(self["postings"], self["languages"], ["shape"])

    def spread(self) -> DataFrame:
        """As ``family_spread``, out of the family counts."""
        return FA.spread(self["families"])

    def spread_elsewhere(self) -> DataFrame:
        return FA.spread_elsewhere(self["families"], self["postings"])

    def region_share(self, unit: str = "families") -> DataFrame:
        return FA.region_share(self["families"], self["postings"], self["languages"], unit)

    def rank_shapes(self) -> DataFrame:
        return X.rank_shapes(self["shapes"], self["postings"], self["languages"])

    def concept_summary(self) -> DataFrame:
        return IX.concept_summary(self["concepts"], self["languages"], self["labels"], self["bands"])

    def labelled_bands(self) -> DataFrame:
        """Chance bands with their meanings' labels: both lie in the same buckets."""
        return self["bands"].join(self["labels"], "ckey")
