"""License texts in documents by diagonal voting.

All runs of ``K`` words of all texts are hashed and joined by Spark to the places of the
same runs in license templates. Hits vote for (document, template, text place - template
place); neighbouring diagonals, which inserted or lost words part, are merged; what has
enough votes is verified on the words of its span by their edit distance.

Templates are the paragraphs of whole license texts (files ``label.license.txt`` in ``license_texts``) and
a few notices that refer to licenses. A license body thus gives a span for each of its paragraphs, and one
that is cut short, or only its warranty, is found by the paragraphs it has. A paragraph that
licenses of different labels share word by word names none of them; it only outdoes less similar ones at its place. Texts covered:
MIT, ISC, BSD (2 and 3 clauses), zlib, Unlicense, Apache 2.0, GPL 2 and 3, LGPL 2.1 and 3, MPL 2.0, CC0 1.0.

The templates are a fixed list, so the side of the join that every task gets is bounded.
Votes are summed before the shuffle. Diagonals of one document are all a window ever holds.

Defined cases: a null or wordless text has no words, no places and no labels. Rows that
repeat id and text get the same result each. A template that stands several times in a
text is a span each time; of overlapping spans the most similar one stands. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lexshape.llm.rows import add_columns
from lexshape.session import settle

K = 4
PERCENT = 80                # least similarity of a span, in edits a template word
PARAGRAPH = 11              # words; shorter ones are titles, headings and addresses

# fixed values: opening words of common licenses and of the notices that refer to them
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]
# fixed values: phrases whose every place counts
PHRASES = [("mit", (b"mit", b"license")), ("apache", (b"apache", b"license")), ("gpl", (b"general", b"public", b"license"))]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_WORDS).split()


@lru_cache
def standard_templates() -> tuple[tuple[str, str], ...]:
    """(label, text) of the notices and of every paragraph, without a label where several have it; read where the job is planned."""
    found = {tuple(words_of(text)): (label, text) for label, text in TEMPLATES}
    labels: dict[tuple, set[str]] = {words: {label} for words, (label, _) in found.items()}
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        label = file.name.split(".")[0]
        for paragraph in re.split(r"\n\s*\n", file.read_text("utf-8")):
            words = tuple(words_of(paragraph))
            if len(words) >= PARAGRAPH:
                found.setdefault(words, (label, paragraph))
                labels.setdefault(words, set()).add(label)
    return tuple((label if len(labels[words]) == 1 else "", text) for words, (label, text) in found.items())


def budget(n: int) -> int:
    """Edits that a span of a template of ``n`` words may have."""
    return n * (100 - PERCENT) // 100


def needed(n: int, k: int = K) -> int:
    """Runs that a span within its budget keeps at least (an edit breaks ``k`` of them), one in any case."""
    return max(1, n - k + 1 - k * budget(n))


def run_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    codes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64)
    last = max(0, len(codes) - k + 1)
    h = np.zeros(last, np.uint64)
    for j in range(k if last else 0):
        h = (h ^ codes[j:j + last]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def template_places(spark, templates: Sequence[tuple[str, str]], k: int = K) -> DataFrame:
    """(hash, template, at) of every run of every template."""
    rows = [(int(h), t, at) for t, (_, text) in enumerate(templates) for at, h in enumerate(run_hashes(words_of(text), k))]
    return spark.createDataFrame(rows, "hash long, template int, at int")


def diagonals(docs: DataFrame, templates: Sequence[tuple[str, str]], k: int = K) -> DataFrame:
    """(doc_id, tkey, template, first, last, votes) of each merged diagonal with enough votes."""
    hashed = add_columns(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text"), "text",
                         T.StructType([T.StructField("runs", T.ArrayType(T.LongType()))]), lambda texts: [[run_hashes(words_of(t), k) for t in texts]])
    runs = hashed.select("doc_id", "tkey", F.posexplode("runs").alias("pos", "hash"))
    places = F.broadcast(template_places(docs.sparkSession, templates, k))        # the fixed templates' runs
    hits = runs.join(places, "hash").select("doc_id", "tkey", "template", "pos", "at").distinct()
    votes = hits.groupBy("doc_id", "tkey", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    # a span within its budget lies on diagonals that drift by no more than the budget
    facts = docs.sparkSession.createDataFrame([(t, needed(len(words_of(text)), k), budget(len(words_of(text)))) for t, (_, text) in enumerate(templates)],
                                              "template int, needed int, drift int")
    order = Window.partitionBy("doc_id", "tkey", "template").orderBy("diagonal")
    island = F.sum((F.col("diagonal") - F.lag("diagonal").over(order) > F.col("drift")).cast("int")).over(order)
    merged = votes.join(F.broadcast(facts), "template").withColumn("island", F.coalesce(island, F.lit(0))).groupBy("doc_id", "tkey", "template", "needed", "island").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))
    return merged.where(F.col("votes") >= F.col("needed")).select("doc_id", "tkey", "template", "first", "last", "votes")


_EDIT = 1 << 40             # a cell holds its edits and the place where its part starts


def distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn ``a`` into a part of ``b``, with the part's start and end (of equals the first end, then the first start)."""
    steps = np.arange(len(b) + 1, dtype=np.int64) * _EDIT
    row = np.arange(len(b) + 1, dtype=np.int64)
    for x in a:
        new = row + _EDIT
        np.minimum(new[1:], row[:-1] + (b != x) * _EDIT, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps        # words of ``b`` put in
    end = int(np.argmin(row >> 40))
    return int(row[end] >> 40), int(row[end] & (_EDIT - 1)), end


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every phrase, by start."""
    found, at = [], -1
    try:
        while True:
            at = words.index(b"license", at + 1)
            found += [(at - len(p) + 1, label) for label, p in PHRASES if at >= len(p) - 1 and tuple(words[at - len(p) + 1:at + 1]) == p]
    except ValueError:
        return sorted(found)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans; by the standard templates unless others are given.

    ``spans`` has (label, template, first word, end word, similarity) of every verified span; ``score`` is the best similarity, 1 with a base phrase."""
    templates = standard_templates() if templates is None else templates
    spans = settle(diagonals(docs, templates, k).groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_list(F.struct("template", "first", "last"))).alias("__spans")))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__tkey"))
    about = spans.select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__t"), "__spans")
    rows = keyed.join(about, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tkey") == F.col("__t")), "left").select("doc_id", "text", "__spans")
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("first_word", T.LongType()),
                         T.StructField("end_word", T.LongType()), T.StructField("similarity", T.DoubleType())])
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")),
                        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("spans", T.ArrayType(span))])
    code = {w: i for i, w in enumerate(sorted({w for _, text in templates for w in words_of(text)}))}
    arrow, known = to_arrow_schema(out), [(label, np.array([code[w] for w in words_of(text)], np.int32)) for label, text in templates]

    def judge(text: str, candidates: list) -> dict:
        words = words_of(text)
        base = base_places(words)
        verified = []
        codes = np.fromiter((code.get(w, -1) for w in words), np.int32, len(words)) if candidates else None
        for c in candidates or ():
            label, template = known[c["template"]]
            slack = budget(len(template))
            start = max(0, c["first"] - slack)
            edits, a, b = distance(template, codes[start:max(0, c["last"]) + len(template) + slack])
            if edits <= slack:
                verified.append({"label": label, "template": c["template"], "first_word": start + a, "end_word": start + b, "similarity": 1 - edits / len(template)})
        best = []           # of overlapping spans, the one most like its template
        for s in sorted(verified, key=lambda s: (-s["similarity"], s["first_word"] - s["end_word"], s["first_word"], s["template"])):
            if all(s["end_word"] <= b["first_word"] or b["end_word"] <= s["first_word"] for b in best):
                best.append(s)
        verified = sorted((s for s in best if s["label"]), key=lambda s: s["first_word"])
        own = sorted({label for _, label in base})
        return {"n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
                "base_labels": ",".join(own), "labels": ",".join(sorted({*own, *(s["label"] for s in verified)})),
                "score": 1.0 if base else max((s["similarity"] for s in verified), default=0.0), "spans": verified}

    def run(batches):
        for batch in batches:
            made = [judge(t.as_py() or "", s.as_py()) for t, s in zip(batch.column("text"), batch.column("__spans"))]
            cols = [pa.array([m[f.name] for m in made], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field("doc_id").type), *cols], schema=arrow)

    return rows.mapInArrow(run, out)
