"""Row order over files: by file name, then by place in the file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACE = 10 ** 10     # rows that a task numbers within a file block
_FILE = 10 ** 24      # places within a file


def _plain(file: str) -> str:
    """Local files are listed as file:///x and reported as file:/x."""
    return re.sub("^file:/+", "file:/", file)


def with_file_order(table: DataFrame, name: str, *columns) -> DataFrame:
    """Select ``columns`` of a file-based table and number its rows in file order (with gaps).

    The order is the same however the rows are dealt out to tasks, and splitting a file into
    part files with rising names does not change it. The list of file names is the one that
    the reader planned with."""
    spark = table.sparkSession
    ranks = spark.createDataFrame([(_plain(f), i) for i, f in enumerate(sorted(table.inputFiles()))], "_file string, _rank long")
    placed = table.select(*columns, F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                          F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    def part(c: str, times: int, digits: int):
        return (F.col(c).cast(f"decimal({digits},0)") * F.lit(str(times)).cast(f"decimal({34 - digits},0)")).cast("decimal(34,0)")
    seq = (part("_rank", _FILE, 9) + part("_start", _PLACE, 14) + F.col("_place")).cast("decimal(34,0)")
    return placed.join(ranks, "_file").withColumn(name, seq).drop("_file", "_start", "_place", "_rank")
