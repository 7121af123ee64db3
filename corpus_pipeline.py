"""A training corpus from raw documents: judged, without copies and benchmark passages, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes
each result to the shared folder and reads it again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexshape.llm import decontaminate, exact, minhash, packing, quality
from lexshape.llm.queries import table, tokenizer_files
from lexshape.session import settle


NEAR = 80               # percent: the near-dedup stage links at this Jaccard similarity of word shingles; op5 has its own


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text."""
    return exact.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_copies(docs, percent=NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, **tokenizer_files())


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None       # MinHash, edit matching and packing have no SQL; tests hold each stage against brute force

QUERIES = {"pipeline": run}
ORACLES: dict = {}
