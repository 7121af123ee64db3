"""Audits, size checks, licence subsets and pronounceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions import canon as C
from lexshape.functions import unicode as U
from lexshape.functions.hints import NO_MATCH, PREFIX_MARKS, hint_table
from lexshape.functions.phones import DROPPED_MODIFIERS, GLOTTAL_MARKS, phone_table
from lexshape.functions.wording import licence_id
from lexshape.operators import rows


def commercial_safe(forms: DataFrame, sources: DataFrame, licences: tuple[str, ...] = K.COMMERCIAL_LICENCES) -> DataFrame:
    """Forms all of whose sources permit the reuse."""
    blocked = sources.where(~licence_id(F.col("license")).isin(*licences)).select(F.col("id").alias("source"))
    tainted = forms.select("glottocode", "shape", F.explode("sources").alias("source")).join(
        blocked, "source", "left_semi").select("glottocode", "shape").distinct()
    return forms.join(tainted, ["glottocode", "shape"], "left_anti")


def build_tripwires(index: DataFrame, chunk_key: str = "shape") -> DataFrame:
    """Index size in bytes and number of chunks, against their limits."""
    return index.agg(
        F.sum(F.octet_length(F.to_json(F.struct(*index.columns)))).alias("bytes"),
        F.count_distinct(chunk_key).alias("chunks")).select(
        "bytes", "chunks", (F.col("bytes") > K.INDEX_BYTES_LIMIT).alias("too_large"),
        (F.col("chunks") > K.CHUNK_LIMIT).alias("too_many_chunks"))


def audit_catalog(forms: DataFrame, languages: DataFrame, sources: DataFrame) -> DataFrame:
    """Invariants of a finished catalog, one row per check with its violations.

    ``languages`` carry ``form_count`` and ``examined``."""
    def check(name: str, n: DataFrame) -> DataFrame:
        return n.select(F.lit(name).alias("check"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("violations"))
    counted = languages.agg(F.sum("form_count").alias("n"))
    total = forms.agg(F.count(F.lit(1)).alias("n"))
    balance = total.select(F.abs(F.col("n") - counted.scalar()).alias("n"))
    twice = forms.groupBy("glottocode", "shape").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("n"))
    short = languages.agg(F.count_if(F.col("examined") < F.col("form_count")).alias("n"))
    shapes = forms.select("shape").distinct()
    again = rows.canonicalize(shapes, ipa="shape", segmented=False, keep_nfd=False)
    moved = again.agg(
        F.count_if((F.col("segmental") != F.col("shape")) | (F.col("tone") != "")).alias("moved"),
        F.count_if(~C.is_clean(F.col("shape"))).alias("unclean"))
    judged = rows.classify_openness(rows.canonicalize(shapes, ipa="shape", segmented=False, keep_nfd=True))
    closed = judged.agg(F.count_if(~F.coalesce("is_open", F.lit(False))).alias("n"))
    licences = sources.agg(F.count_if(licence_id(F.col("license")).contains("-ND")).alias("n"))
    parts = [
        check("form counts add up", balance), check("one form per language and shape", twice),
        check("examined covers forms", short),
        check("canonical keys stay", moved.select(F.col("moved").alias("n"))),
        check("keys are clean", moved.select(F.col("unclean").alias("n"))),
        check("shapes are open", closed),
        check("no blocked licence", licences)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _literal_map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[c for k, v in pairs.items() for c in (F.lit(k), v)])


def renderability(shapes: DataFrame, column: str = "shape") -> DataFrame:
    """Can a phone table voice each shape? Phones, and whether any is an approximation.

    A glottal mark is a glottal stop at the start of a shape and an unvoiced
    modifier later. Letters that the table lacks make the shape unvoiceable.
    The table is a literal map over the letters of a shape: no join, no shuffle but the distinct."""
    table = _literal_map({letter: F.struct(F.lit(phone).alias("phone"), F.lit(approximate).alias("approximate")) for letter, phone, approximate in phone_table()})

    def place(c: Column, i: Column) -> Column:
        known = F.try_element_at(table, c)
        glottal = c.isin(*GLOTTAL_MARKS)
        modifier = (c.isin(*DROPPED_MODIFIERS) | c.rlike(U.combining())) & known["phone"].isNull()
        return F.struct(i.alias("pos"), glottal.alias("glottal"), modifier.alias("modifier"), known["phone"].alias("phone"),
                        F.coalesce(known["approximate"], F.lit(False)).alias("approximate"))

    def first(condition) -> Column:
        return F.array_min(F.transform(F.filter("_at", condition), lambda x: x["pos"]))

    def real(x: Column) -> Column:
        return ~x["glottal"] & ~x["modifier"]

    def opening(x: Column) -> Column:
        # a glottal mark opens the shape when only silent modifiers stand before it
        return x["glottal"] & (x["pos"] == F.col("_glottal")) & (F.col("_real").isNull() | (F.col("_glottal") < F.col("_real")))

    def lossy(x: Column) -> Column:
        return (x["glottal"] & ~opening(x)) | x["modifier"] | x["approximate"]

    def spoken(x: Column) -> Column:
        return F.when(opening(x), "?").when(~x["glottal"] & ~x["modifier"], x["phone"])

    letters = F.filter(F.split(U.nfd(F.col(column)), ""), lambda c: c != "")
    out = (shapes.select(column).distinct().withColumn("_at", F.transform(letters, place)).where("size(_at) > 0")
           .withColumns({"_real": first(real), "_glottal": first(lambda x: x["glottal"])})
           .withColumns({"_missing": first(lambda x: real(x) & x["phone"].isNull()), "_lossy": first(lossy),
                         "_phones": F.array_join(F.transform("_at", spoken), " ")}))
    # the verdict stops at the first letter without a phone
    voiced = F.col("_missing").isNull() & (F.col("_phones") != "")
    return out.select(
        column, F.when(voiced, F.col("_phones")).alias("phones"),
        F.coalesce(F.col("_lossy") < F.coalesce("_missing", F.lit(2 ** 31 - 1)), F.lit(False)).alias("lossy"), voiced.alias("renderable"))


def describe_shapes(shapes: DataFrame, column: str = "shape") -> DataFrame:
    """A plain-language reading of every shape, segment by segment, from literal maps of sounds and marks."""
    sounds, marks = (_literal_map({letter: F.lit(hint) for letter, role, hint in hint_table() if role == kind}) for kind in ("sound", "mark"))
    prefix = U.chars(PREFIX_MARKS)
    trailing = U.chars("".join(m for m, role, _ in hint_table() if role == "mark" and m not in PREFIX_MARKS))
    one = f"(?s)[{prefix}]*[^{prefix}][\\p{{M}}{trailing}]*"

    def say(seg: Column) -> Column:
        base = F.regexp_extract(seg, f"(?s)^[{prefix}]*([^{prefix}])", 1)
        signs = F.split(F.regexp_replace(seg, f"(?s)^([{prefix}]*)[^{prefix}]", "$1"), "")
        notes = F.transform(signs, lambda m: F.concat(F.lit(", "), F.try_element_at(marks, m)))
        return F.concat(F.coalesce(F.try_element_at(sounds, base), F.lit(NO_MATCH)), F.array_join(notes, ""))

    segments = F.regexp_extract_all(U.nfd(F.col(column)), F.lit(one), F.lit(0))
    return (shapes.select(column).distinct().withColumn("_segments", segments).where("size(_segments) > 0")
            .select(column, F.array_join(F.transform("_segments", say), ", then ").alias("reading")))
