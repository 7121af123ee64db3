"""Incremental releases: new entries merge into the state of earlier ones.

The reference model is a re-runnable batch build whose later data may raise a
tier and never discards a source; a release therefore equals a full rebuild.

``Releases`` keeps the whole catalog as mergeable rows: open readings, glosses, verdicts
for disagreements, judged samples and exclusions. Each is grouped by its full key, and each
measure is a minimum, a maximum or a sum, so old and new rows merge by one more grouping.
Rows lie in buckets of their language. A release reads and rewrites the buckets
its entries touch; the others keep their files. A release writes a folder of its own and is
then entered in the version log: readers see all of it or nothing, a failed one is
simply run again, and a name that is in the log already is not counted twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexshape.operators import catalog as C
from lexshape.session import settle
from lexshape.sources import sinks


def release_state(judged: DataFrame) -> DataFrame:
    """State to keep between releases (one row per distinct open reading and source)."""
    return C.form_state(judged)


def merge_release(state: DataFrame, new_entries: DataFrame, sources: DataFrame) -> DataFrame:
    """State after a release; ``new_entries`` must carry later ``seq`` values."""
    return _merge(state, C.form_state(C.judge_entries(new_entries, sources, glosses=False)))


def forms_of_release(state: DataFrame) -> DataFrame:
    return C.forms_from_state(state)


# table -> its mergeable rows from judged entries
STATES = {"forms": C.form_state, "glosses": C.word_glosses, "verdicts": C.verdict_state, "samples": C.sample_state,
          "excluded": lambda judged: C.excluded(judged).groupBy("glottocode", "reason").agg(F.sum("rows").alias("rows"))}
_LIVE = "bucket int, release int"
_MEASURES = {"seq": F.min, "rows": F.sum, "toned": F.sum, "lo": F.min, "k0": F.min, "hi": F.max, "k1": F.max}


def _merge(old: DataFrame, new: DataFrame) -> DataFrame:
    measures = [c for c in new.columns if c in _MEASURES]
    return old.unionByName(new).groupBy(*[c for c in new.columns if c not in measures]).agg(*[_MEASURES[c](c).alias(c) for c in measures])


@dataclass(frozen=True)
class Releases:
    """The state of all releases under ``path``. The number of buckets holds for good; ``tables`` may name fewer than all."""
    spark: SparkSession
    path: str
    buckets: int
    tables: tuple[str, ...] = tuple(STATES)

    def add(self, name: str, judged: DataFrame) -> bool:
        """Merge judged entries (with later ``seq`` values, and with glosses for the tables of glosses and verdicts) as release ``name``; False where the log has it already.

        Of two writers that follow the same release one is refused (``sinks.VersionTaken``)."""
        last = sinks.last_entry(self.spark, self._log)
        if name in sinks.versions(self.spark, self._log):
            return False
        judged, number = settle(judged), last + 1
        bucket = F.pmod(F.xxhash64("glottocode"), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in judged.select(bucket.alias("bucket")).distinct().collect()]         # at most `buckets` rows
        for table in self.tables:
            new = STATES[table](judged)
            if last:
                new = _merge(self._read(table, last, touched), new)
            else:
                new.limit(0).write.mode("overwrite").parquet(self._columns(table))
            placed = new.withColumn("bucket", bucket).hint("rebalance", "bucket")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/release={number}")
        kept = self._live(last).where(~F.col("bucket").isin(touched))
        fresh = self.spark.createDataFrame([(b, number) for b in touched], _LIVE)
        kept.unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/entry={number}")
        sinks.publish_version(self.spark, self._log, name, f"{self.path}/live/entry={number}", after=last)
        return True

    def state(self, table: str) -> DataFrame:
        """Rows of a table as of the last release in the log."""
        last = sinks.last_entry(self.spark, self._log)
        if not last:
            raise ValueError(f"no release at {self.path}")
        return self._read(table, last)

    def forms(self) -> DataFrame:
        """Forms, with flags where sources disagree about one word."""
        return C.flag_forms(C.forms_from_state(self.state("forms")), C.disagreement_from_state(self.state("verdicts")))

    def words(self) -> DataFrame:
        return C.words_from_glosses(self.state("glosses"))

    def language_counts(self) -> DataFrame:
        return C.counts_from_state(self.state("samples"))

    def excluded_counts(self) -> DataFrame:
        return self.state("excluded").groupBy("reason").agg(F.sum("rows").alias("rows"))

    @property
    def _log(self) -> str:
        return f"{self.path}/log"

    def _columns(self, table: str) -> str:
        """An empty table beside the data: what a table's columns are, also where it has no rows."""
        return f"{self.path}/columns/{table}"

    def _live(self, last: int) -> DataFrame:
        """(bucket, release): which release last wrote a bucket; at most ``buckets`` rows."""
        if not last:
            return self.spark.createDataFrame([], _LIVE)
        return self.spark.read.schema(_LIVE).parquet(f"{self.path}/live/entry={last}")

    def _read(self, table: str, last: int, touched: list[int] | None = None) -> DataFrame:
        """Live rows of a table, of the ``touched`` buckets only if given: folders are chosen before anything is read."""
        live: dict[int, list[int]] = {}
        for r in self._live(last).collect():
            if touched is None or r["bucket"] in touched:
                live.setdefault(r["release"], []).append(r["bucket"])
        columns = self.spark.read.parquet(self._columns(table)).schema
        placed = StructType([*columns.fields, StructField("release", IntegerType()), StructField("bucket", IntegerType())])
        wanted = F.lit(False)
        for release, buckets in live.items():
            wanted = wanted | ((F.col("release") == release) & F.col("bucket").isin(buckets))
        return self.spark.read.schema(placed).parquet(f"{self.path}/{table}").where(wanted).select(*columns.names)
