"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Training counts runs of ``ORDER`` characters of all words (with their edges) of all labelled
texts: counted per batch, summed by Spark per language. Lower orders are continuation
counts; discounts follow from the counts of counts. Probabilities are joins of one order
with the next. The model keeps all grams, as sorted 64-bit hashes, each with the languages that
have it and their values. It is dealt into parts by the two characters before the predicted one, as many as
hold at most about ``MAX_GRAMS`` entries of an order. Texts are read in
one pass for each part: every character is predicted in one pass, from all of its grams
(single characters and pairs go with every part). A pass leaves a row's id, the hash of its text and its
sums; the passes' sums are added by these keys.

A text's language is the one of least cross-entropy per character over all of its letters.
Scores are computed once for a word and batch. At most about ``CALIBRATION`` distinct texts, and at most a tenth, are left out
of the counts, chosen by a hash, and calibrate rejection: a cross-entropy above all but a thousandth of the language's own
(by rank and by a normal curve, whichever is higher) is rejected; a scale for the softmax of cross-entropies gives the score.

Words are runs of letters in lower case; runs of over ``STRETCH`` letters are read in
stretches. Defined cases: a null or letterless text is ``und`` with score 0. Equal
cross-entropies: the first name. Without labelled texts everything is ``und``. Repeated
rows count and are judged each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexshape.llm.rows import text_sha
from lexshape.session import settle

ORDER = 5
MAX_GRAMS = 1_500_000       # entries (gram and language) of each order that a pass carries, about: 14 bytes each, and 12 for each gram
CALIBRATION = 4_000
FOLD = 0.1                  # of the labelled texts, at most, are left out of the counts for calibration
STRETCH = 24
CACHED_WORDS = 200_000
DENSE = 3                   # cells for each entry up to which a table has a column a language
SCORED = 8_000              # words that are scored at a time
REJECTED, NORMAL = 0.999, 3.09      # the share of own texts within the limit, and where a normal curve has it
OPEN, CLOSE = "\x02", "\x03"
_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; numerals that are no letters part them."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)) and max(map(len, found), default=0) <= STRETCH:
        return found
    parts = (p for w in found for p in ("".join(c if c.isalpha() else " " for c in w).split()))
    return [p[a:a + STRETCH] for p in parts for a in range(0, len(p), STRETCH)]


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c): runs of ``order`` characters over padded words, summed over all texts."""
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            words: dict = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                words[lang].update(words_of(text.as_py() or ""))
            grams = [(lang, *item) for lang, counter in words.items() for item in _grams(counter, order).items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*grams), arrow)] if grams else [pa.array([], f.type) for f in arrow], schema=arrow)

    return labelled.select("lang", "text").mapInArrow(run, out).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _grams(words: dict, order: int) -> dict:
    sums: dict = defaultdict(int)
    for word, n in words.items():
        padded = OPEN * (order - 1) + word + CLOSE
        for i in range(len(word) + 1):
            sums[padded[i:i + order]] += n
    return sums


def kneser_ney(counts: DataFrame, order: int = ORDER) -> list[tuple]:
    """Per order from 1: tables (lang, gram, log p) and (lang, gram, log of what the context leaves to the shorter one)."""
    levels = [settle(counts)]
    for n in range(order - 1, 0, -1):
        levels.insert(0, settle(levels[0].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))))
    made, below = [], None
    for n, level in enumerate(levels, 1):
        n1, n2 = (F.sum((F.col("c") == k).cast("double")) for k in (1, 2))
        d = level.groupBy("lang").agg(F.least(F.greatest(F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.5)), F.lit(0.05)), F.lit(0.95)).alias("d"))
        contexts = settle(level.groupBy("lang", F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
                          .join(d, "lang").withColumn("left", F.col("d") * F.col("kinds") / F.col("total")))
        rows = level.withColumn("context", F.substring("gram", 1, n - 1)).join(contexts, ["lang", "context"])
        if below is None:
            rows = rows.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            rows = rows.withColumn("short", F.substring("gram", 2, n - 1)).join(below.select("lang", F.col("gram").alias("short"), F.col("p").alias("lower")), ["lang", "short"])
        below = settle(rows.select("lang", "gram", "c", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("left") * F.col("lower")).alias("p")))
        shrunk = F.col("left") / (F.col("kinds") + 1) if n == 1 else F.col("left")
        made.append((below.select("lang", "gram", F.log("p").alias("v")), contexts.select("lang", F.col("context").alias("gram"), F.log(shrunk).alias("v"))))
    return made


def part_of(second, last, parts: int):
    """The part of a character, by the code points of the two before it: of columns or of arrays."""
    mixed = (second * 1000003 + last) * 40503 % 1000003
    return mixed % parts


def gram_hashes(codes: list[np.ndarray]) -> np.ndarray:
    """Hash of grams given by their characters' code points, one array a place."""
    h = np.zeros(len(codes[0]) if codes else 1, np.uint64)
    for c in codes:
        h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Model:
    langs: list[str]
    order: int = ORDER
    grams: list = field(default_factory=list)        # per order: sorted hashes, and where their entries start, languages, log p
    contexts: list = field(default_factory=list)     # per order: the same with the log of what is left
    limits: np.ndarray | None = None                 # rejecting cross-entropy by language
    scale: float = 1.0
    part: int = 0                                    # which of the parts ``grams`` and ``contexts`` are
    parts: int = 1
    tables: list | None = None                       # what the other parts are read from; not sent to executors

    @classmethod
    def of(cls, tables: list[tuple], order: int = ORDER, part: int = 0, parts: int = 1) -> Model:
        named = sorted(r["lang"] for r in tables[0][0].select("lang").distinct().collect())
        model = cls(named, order, part=part, parts=parts, tables=tables)
        for n, (grams, contexts) in enumerate(tables, 1):
            model.grams.append(model._sorted(cls._part(grams, n, 0, part, parts).toArrow(), n, np.nan))
            model.contexts.append(model._sorted(cls._part(contexts, n - 1, 1, part, parts).toArrow(), n - 1, 0.0))
        return model

    @staticmethod
    def _part(rows: DataFrame, length: int, is_context: int, part: int, parts: int) -> DataFrame:
        """What one part needs of the grams or contexts of a length."""
        if parts == 1 or length + is_context < 3:
            return rows
        code = lambda at: F.ascii(F.substring("gram", at, 1)).cast("long")
        return rows.where(part_of(code(length - 2 + is_context), code(length - 1 + is_context), parts) == part)

    def each(self):
        """All parts in turn, one in memory at a time beside this one."""
        for k in range(self.parts):
            yield self if k == self.part else replace(Model.of(self.tables, self.order, k, self.parts), limits=self.limits, scale=self.scale)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def _sorted(self, table, length: int, missing: float) -> tuple:
        """Sorted hashes, and their values: by language where that takes no more room, otherwise as entries."""
        where = {lang: i for i, lang in enumerate(self.langs)}
        hashes, langs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16 if len(where) < 1 << 16 else np.uint32)]
        for batch in table.to_batches(max_chunksize=50_000):
            codes = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(batch.num_rows, length)
            hashes.append(gram_hashes(list(codes.T)) if length else np.repeat(gram_hashes([]), batch.num_rows))
            langs.append(np.fromiter(map(where.__getitem__, batch.column("lang").to_pylist()), langs[0].dtype, batch.num_rows))
        hashes, langs, values = np.concatenate(hashes), np.concatenate(langs), table.column("v").to_numpy()
        order = np.lexsort((langs, hashes))
        keys, starts = np.unique(hashes[order], return_index=True)
        if len(keys) * len(where) <= DENSE * len(order):
            dense = np.full((len(keys), len(where)), missing)
            dense[np.repeat(np.arange(len(keys)), np.diff(np.append(starts, len(order)))), langs[order]] = values[order]
            return keys, dense
        return keys, (np.append(starts, len(order)).astype(np.uint32), langs[order], values[order])

    def _look(self, table: tuple, hashes: np.ndarray, missing: float) -> np.ndarray:
        """Values by language of each hash; ``missing`` where a language doesn't have it."""
        keys, held = table
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        if isinstance(held, np.ndarray) and len(keys):
            found = held[at]
            found[keys[at] != hashes] = missing
            return found
        out = np.full((len(hashes), len(self.langs)), missing)
        if not len(keys):
            return out
        starts, langs, values = held
        rows = np.flatnonzero(keys[at] == hashes)
        first = starts[at[rows]].astype(np.int64)
        each = starts[at[rows] + 1] - first
        entry = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
        out[np.repeat(rows, each), langs[entry]] = values[entry]
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word with its edges, by language; of the characters of this part."""
        n, pad = self.order, OPEN * (self.order - 1)
        codes = np.frombuffer("".join([pad + w + CLOSE for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes + n - 1) - sizes
        ends = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())      # places of the predicted characters
        back = [codes[ends - k] for k in range(n)]
        logp = None
        for k in range(1, n + 1):
            seen = self._look(self.grams[k - 1], gram_hashes(back[:k][::-1]), np.nan)
            left = self._look(self.contexts[k - 1], gram_hashes(back[1:k][::-1]) if k > 1 else np.repeat(gram_hashes([]), len(ends)), 0.0)
            logp = np.where(np.isnan(seen), left if logp is None else logp + left, seen)
        if self.parts > 1:
            logp[part_of(back[2].astype(np.int64), back[1].astype(np.int64), self.parts) != self.part] = 0.0
        return np.add.reduceat(logp, np.cumsum(sizes) - sizes, axis=0)

    def entropies(self, texts: list[str], cache: dict) -> np.ndarray:
        """Cross-entropy per character of each text by language, this part's share of it; nan without letters. ``cache`` keeps words' rows."""
        split = [words_of(t) for t in texts]
        if len(cache.setdefault("rows", {})) > CACHED_WORDS:
            cache.clear()
        rows = cache.setdefault("rows", {})
        new = list(set().union(*split) - rows.keys())
        if new:
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            scores = [self.word_scores(new[a:a + SCORED]) for a in range(0, len(new), SCORED)]
            cache["scores"] = np.concatenate([cache["scores"], *scores] if "scores" in cache else scores)
        out = np.full((len(texts), len(self.langs)), np.nan)
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
                out[i] = -cache["scores"][at].sum(axis=0) / (sum(map(len, words)) + len(words))
        return out

    def judge(self, entropies: np.ndarray) -> list[tuple]:
        """(lang, score, cross-entropy, rejected) of each text, from its cross-entropies over all parts."""
        if not self.langs:
            return [("und", 0.0, None, True)] * len(entropies)
        made = []
        for h in entropies:
            if np.isnan(h).any():
                made.append(("und", 0.0, None, True))
                continue
            best = int(np.argmin(h))
            score = 1 / np.exp(-np.minimum((h - h[best]) * self.scale, 700)).sum()
            made.append((self.langs[best], float(score), float(h[best]), bool(self.limits is not None and h[best] > self.limits[best])))
        return made


def calibrate(model: Model, texts: DataFrame) -> Model:
    """Set the model's limits and scale from a bounded number of (lang, text) rows that its counts don't hold."""
    found = entropies_of(texts.where(F.col("lang").isin(model.langs)), model, "lang").toArrow() if model.langs else None
    if not found:
        return model
    h, lang = np.array(found.column("h").to_pylist()), np.array([model.langs.index(x) for x in found.column("id").to_pylist()])
    sound = ~np.isnan(h).any(axis=1)
    h, lang = h[sound], lang[sound]
    if len(h):
        own = h[np.arange(len(h)), lang]
        limit = lambda x: max(np.quantile(x, REJECTED), x.mean() + NORMAL * x.std())
        model.limits = np.array([limit(own[lang == k]) if (lang == k).sum() > 1 else np.inf for k in range(len(model.langs))])
        loss = lambda s: np.mean(np.log(np.exp(-np.minimum((h - own[:, None]) * s, 700)).sum(axis=1)))
        model.scale = min((2.0 ** k for k in range(7)), key=loss)
    return model


def entropies_of(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    """(id, h): the cross-entropies of each row's text by language, summed over the passes of the model's parts.

    A pass writes ids, hashes of texts and sums; rows alike in id and text have equal sums, so any of them serves."""
    keyed = rows.select(F.col(id_col).alias("id"), F.col("text"), text_sha().alias("sha"))
    first, *others = [settle(_pass(keyed, part)) for part in model.each()]

    def add(sums: DataFrame, more: DataFrame) -> DataFrame:
        more = more.dropDuplicates(["id", "sha"]).select(F.col("id").alias("id_"), F.col("sha").alias("sha_"), F.col("h").alias("h_"))
        return sums.join(more, F.col("id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_"))).select("id", "sha", F.zip_with("h", "h_", lambda x, y: x + y).alias("h"))
    return reduce(add, others, first).select("id", "h")


def _pass(keyed: DataFrame, part: Model) -> DataFrame:
    out = T.StructType([keyed.schema["id"], keyed.schema["sha"], T.StructField("h", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                rows = batch.slice(a, 2000)
                h = part.entropies([t or "" for t in rows.column("text").to_pylist()], cache)
                yield pa.RecordBatch.from_arrays([rows.column("id").cast(arrow.field(0).type), rows.column("sha").cast(arrow.field(1).type), pa.array(list(h), arrow.field(2).type)], schema=arrow)

    return keyed.mapInArrow(run, out)


def train(labelled: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, most: int = CALIBRATION) -> Model:
    """A calibrated model of (lang, text) rows; rows without a language or text do not count."""
    known = labelled.where("lang is not null and text is not null").select("lang", "text")
    share = min(FOLD, most / max(1, known.count()))
    left_out = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))
    fold = settle(known.where(left_out).dropDuplicates(["lang", "text"]))
    counted = known.where(~left_out)
    only_there = fold.join(counted.select("lang").distinct(), "lang", "left_anti")         # a language all of whose texts were left out is counted
    tables = kneser_ney(gram_counts(counted.unionByName(only_there), order), order)
    parts = 1 if order < 3 else max(1, -(-max(t.count() for pair in tables[2:] for t in pair) // max_grams))
    return calibrate(Model.of(tables, order, parts=parts), fold)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score, cross_entropy, rejected."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    arrow = to_arrow_schema(out)
    judge = replace(model, grams=[], contexts=[], tables=None)
    rows = entropies_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "doc_id")

    def run(batches):
        for batch in batches:
            made = judge.judge(np.array(batch.column("h").to_pylist(), float).reshape(batch.num_rows, len(judge.langs)))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow.field("doc_id").type), *(pa.array(x, f.type) for x, f in zip(zip(*made), list(arrow)[1:]))], schema=arrow)

    return rows.mapInArrow(run, out)
