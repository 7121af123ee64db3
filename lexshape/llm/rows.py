"""Helpers on rows: add computed columns or keep some rows in Arrow batches of the table as it is; leave out judged rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _texts(batch: pa.RecordBatch, at: int):
    return (x.as_py() or "" for x in batch.column(at))


def add_columns(df: DataFrame, text_col: str, added: T.StructType, make: Callable) -> DataFrame:
    """``df`` with the ``added`` columns last. ``make(texts)`` gives one list per added column; null texts come as ''."""
    out = T.StructType([*df.schema.fields, *added.fields])
    arrow, at = to_arrow_schema(out), df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            more = [pa.array(x, f.type) for x, f in zip(make(_texts(batch, at)), list(arrow)[batch.num_columns:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), *more], schema=arrow)

    return df.mapInArrow(run, out)


def keep_rows(df: DataFrame, text_col: str, keep: Callable) -> DataFrame:
    """The rows of ``df`` for which ``keep(texts)`` is true, all columns as they were."""
    arrow, at = to_arrow_schema(df.schema), df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(keep(_texts(batch, at)), pa.bool_()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, arrow)], schema=arrow)

    return df.mapInArrow(run, df.schema)


def text_sha(text: str = "text") -> Column:
    """SHA-256 of a text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the (doc_id, sha) pairs in ``gone``, and with one row for each pair in ``repeated``; all columns as they were."""
    def key(pairs, name):
        side = pairs.select(F.col("doc_id").alias(f"__{name}_id"), F.col("sha").alias(f"__{name}_sha"))
        return side, F.col("doc_id").eqNullSafe(F.col(f"__{name}_id")) & (F.col("__sha") == F.col(f"__{name}_sha"))
    rows = docs.withColumn("__sha", text_sha()).join(*key(gone, "gone"), "left_anti")
    if not repeated.isEmpty():
        rows = rows.join(*key(repeated, "again"), "left_anti").unionByName(
            rows.join(*key(repeated, "again"), "left_semi").dropDuplicates(["doc_id", "__sha"]))
    return rows.drop("__sha")
