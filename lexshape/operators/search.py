"""Search by part of a text through an index of letter triples.

The index holds one row per distinct triple of a row's lower-case texts. A search
reads the lists of its own triples only, keeps the rows that are on all of them, and
confirms these with ``contains``. Texts of under three letters have no triple: they are
searched by a scan, so every search is exact. Null and empty texts are on no list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshape.sources import sinks

SIZE = 3


def wanted(text: str) -> str:
    return text.strip().lower()


def triples(text: str | Column) -> Column:
    """Distinct letter triples of a lower-cased text (none of a shorter or null one)."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    at = F.sequence(F.lit(1), F.char_length(low) - (SIZE - 1))
    grams = F.transform(at, lambda i: F.substring(low, i, F.lit(SIZE)))
    return F.array_distinct(F.when(F.char_length(low) >= SIZE, grams).otherwise(F.array().cast("array<string>")))


def gram_index(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(gram, key) of every row with a unique ``key``, each triple of its columns once."""
    grams = F.array_distinct(F.flatten(F.array(*[triples(c) for c in columns])))
    return rows.select(F.explode(grams).alias("gram"), key)


def write_gram_index(index: DataFrame, path: str, buckets: int) -> None:
    """Write an index in buckets of its triples, so that a search reads those of its own triples."""
    sinks.write_partitioned(index, path, "gram", buckets)


def _grams(text: str) -> list[str]:
    low = wanted(text)
    return sorted({low[i:i + SIZE] for i in range(len(low) - SIZE + 1)})


def search(rows: DataFrame, key: str, columns: list[str], text: str, index: DataFrame | str) -> DataFrame:
    """Rows any of whose columns holds ``text``, whatever the case; ``index`` is of the same rows, as a table or as a written path."""
    low = wanted(text)
    holds = reduce(Column.__or__, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(F.lit(low)) for c in columns])
    if len(low) < SIZE:
        return rows.where(holds)
    grams = _grams(text)
    found = sinks.read_keys(rows.sparkSession, index, "gram", grams) if isinstance(index, str) else index.where(F.col("gram").isin(grams))
    # a key is on a list once; it is counted, and rows on all lists are left
    on_all = found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(key)
    return rows.join(on_all, key, "left_semi").where(holds)
