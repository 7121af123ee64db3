"""Row rules: normalise, segment, canonicalize, judge and annotate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshape.functions import canon as C
from lexshape.functions import syllable as S
from lexshape.functions import unicode as U


def normalize_unicode(df: DataFrame, column: str, form: str = "NFC", engine: str = "jvm") -> DataFrame:
    """Replace a string column by its canonical form (``NFC`` or ``NFD``).

    ``engine="arrow"`` runs over the distinct strings in Arrow batches and joins
    them back; the default stays in the JVM and needs no shuffle."""
    if engine == "jvm":
        return df.withColumn(column, U.nfd(F.col(column)) if form == "NFD" else U.nfc(F.col(column)))

    def normal(it):
        for batch in it:
            yield batch.assign(_normal=batch["_text"].str.normalize(form))
    texts = df.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    table = texts.mapInPandas(normal, "_text string, _normal string")
    joined = df.join(table, df[column] == table["_text"], "left")
    return joined.select(*[F.col("_normal").alias(c) if c == column else df[c] for c in df.columns])


def split_graphemes(df: DataFrame, column: str = "ipa", output: str = "graphemes") -> DataFrame:
    """Array of graphemes of an unsegmented transcription."""
    return (df.withColumn("_nfd", U.nfd(F.col(column)))
            .withColumn(output, C.graphemes(F.col("_nfd"))).drop("_nfd"))


def canonicalize(
    df: DataFrame, ipa: str = "ipa", segmented: str | bool = "segmented", keep_nfd: bool = False,
    canonicalizer: Callable[[DataFrame], DataFrame] | None = None,
    derive: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Add ``segmental`` (tone-blind key), ``tone`` and ``segments`` (space separated).

    ``canonicalizer`` swaps in another scheme: a function from a DataFrame to a
    DataFrame with these three columns. ``keep_nfd`` also keeps ``segments_nfd``.
    ``derive`` adds columns over the decomposed segments in the projection that
    makes them. Filters on those columns then stay above that projection: moved
    below, they would repeat the whole clean-up inside the filter condition."""
    derive = derive or {}
    if canonicalizer is not None:
        out = canonicalizer(df)
        if keep_nfd or derive:
            ordered = U.decomposed(F.col("segments"))
            out = out.withColumns({"segments_nfd": ordered, **{k: f(ordered) for k, f in derive.items()}})
    else:
        flag = F.col(segmented) if isinstance(segmented, str) else segmented
        n, c, plain = F.col("_nfd"), F.col("_c"), F.col("_plain")
        out = (
            df.withColumn("_nfd", U.nfd(U.strip(F.col(ipa))))
            .withColumns({"tone": C.tone(n), "_plain": C.is_plain(n, flag)})
            .withColumn("_c", C.fold_letters(F.when(plain, n).otherwise(C.split_marked(n, flag))))
            .withColumn("_c", F.when(plain, c).otherwise(C.spell_out(c)))
            .withColumn("_c", F.when(plain, c).otherwise(C.prenasalize(c))))
        ordered = U.decomposed(F.when(plain, C.spaced_letters(c)).otherwise(C.spaced(c)))
        out = out.withColumns({"segments_nfd": ordered, **{k: f(ordered) for k, f in derive.items()}})
        segments = F.when(plain, F.col("segments_nfd")).otherwise(U.nfc(F.col("segments_nfd")))
        out = out.withColumn("segments", segments).withColumn(
            "segmental", F.replace(F.col("segments"), F.lit(" "), F.lit(""))).drop("_nfd", "_plain", "_c")
    return out if keep_nfd else out.drop("segments_nfd")


def keep_clean(df: DataFrame, column: str = "segmental") -> DataFrame:
    """Drop keys with notation that is no part of the alphabet."""
    return df.where(C.is_clean(F.col(column)))


def _with_nfd(df: DataFrame, column: str) -> DataFrame:
    return df if "segments_nfd" in df.columns else df.withColumn("segments_nfd", U.nfd(F.col(column)))


def classify_openness(df: DataFrame, segments: str = "segments") -> DataFrame:
    """Add ``is_open, confidence, nucleus_type, contested, reason``."""
    out = _with_nfd(df, segments)
    if "_why" not in df.columns:
        out = out.withColumn("_types", S.types(F.col("segments_nfd"))).withColumn(
            "_why", S.reason(F.col("_types"))).drop("_types")
    out = out.withColumn("_nasal", S.is_open(F.col("_why")) & S.nasal_before_consonant(F.col("segments_nfd")))
    out = out.withColumns(S.verdict(F.col("_why"), F.col("_nasal"))).drop("_why", "_nasal")
    return out if "segments_nfd" in df.columns else out.drop("segments_nfd")


def annotate_features(
    df: DataFrame, segments: str = "segments", nucleus_type: str = "nucleus_type", where: Column | None = None,
) -> DataFrame:
    """Add ``onset_class`` and ``nucleus_bucket``; only for the rows of ``where`` if given."""
    def only(c: Column) -> Column:
        return c if where is None else F.when(where, c)
    n = F.col("segments_nfd")
    out = _with_nfd(df, segments).withColumns({"_letter": only(S.first_letter(n)), "_vowel": only(S.last_vowel(n))})
    out = out.withColumns({
        "onset_class": only(S.onset_class(n, F.col("_letter"))),
        "nucleus_bucket": only(S.nucleus_bucket(F.col("_vowel"), F.col(nucleus_type))),
    }).drop("_letter", "_vowel")
    return out if "segments_nfd" in df.columns else out.drop("segments_nfd")


def ipa_conformance(df: DataFrame, column: str = "segmental", output: str = "conformance") -> DataFrame:
    return (df.withColumn("_nfd", U.nfd(F.col(column)))
            .withColumn(output, C.conformance(F.col("_nfd"))).drop("_nfd"))


def loose_key(df: DataFrame, column: str = "segmental", output: str = "loose") -> DataFrame:
    return df.withColumn(output, C.loose_key(F.col(column)))


def segment_classes(df: DataFrame, value: str = "value", segment_class: str = "segment_class") -> DataFrame:
    """Inventory segments -> the onset class or vowel bucket each contributes.

    The rules run once per distinct (value, class); tones and unknown letters
    give NULL in both columns."""
    distinct = df.select(value, segment_class).distinct()
    out = canonicalize(distinct, ipa=value, segmented=True, keep_nfd=True)
    vowels = F.length(F.regexp_replace("segmental", f"[^{U.chars(S.K.VOWELS)}]+", ""))
    out = out.withColumn("_type", F.when(vowels > 1, "diphthong").otherwise("monophthong"))
    has = F.col("segmental") != ""
    out = annotate_features(out, nucleus_type="_type")
    onset, bucket = F.col("onset_class"), F.col("nucleus_bucket")
    return out.select(
        value, segment_class,
        F.when(has & (F.col(segment_class) == "consonant") & ~onset.isin("none", "other"), onset).alias("onset"),
        F.when(has & (F.col(segment_class) == "vowel") & (bucket != "other"), bucket).alias("nucleus"),
    )


