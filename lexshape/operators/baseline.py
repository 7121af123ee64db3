"""Exact chance baseline for shared sound-meaning pairs.

Null model: every language's words shuffled among its own meanings. A pair's
family count is then a sum of independent chances, so its tail is exact; the
false-discovery rate is controlled over every pair that enough families could
share. Input everywhere: word rows ``(ckey, language, family, shape)``.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexshape import constants as K
from lexshape.functions import stats as ST
from lexshape.session import settle as written

MEANINGS, SHAPES = 128, 256     # bits of the two sides of a counting block
FAMILIES = 512                  # families of one counting task, and chances of one partial polynomial, about
ROUTED = 1024                   # languages of one task that sums up chances, about


def word_counts(words: DataFrame) -> DataFrame:
    """Words per (language, family, meaning, shape): the only pass over the input.

    Every later table is an aggregate of this one, so a hot language, meaning or
    shape has already shrunk to its distinct combinations."""
    own = F.concat(F.lit("lang:"), F.col("language").cast("string"))
    fam = F.coalesce(F.nullif(F.col("family"), F.lit("")), own)
    return words.groupBy("language", fam.alias("family"), "ckey", "shape").agg(F.count(F.lit(1)).alias("n"))


def meaning_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("language", "family", "ckey").agg(F.sum("n").alias("k"))


def shape_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("language", "family", "shape").agg(F.sum("n").alias("s"))


def item_uses(counts: DataFrame, settle=None) -> tuple[DataFrame, DataFrame]:
    """Words by meaning and by shape, each written once (by ``settle``, or to the scratch folder)."""
    keep = settle or written
    return keep(meaning_counts(counts)), keep(shape_counts(counts))


def pair_families(counts: DataFrame) -> DataFrame:
    """(ckey, shape, family, languages): each pair's families, with their languages that have it."""
    return counts.groupBy("ckey", "shape", "family").agg(F.count(F.lit(1)).alias("languages"))


def observed_pairs(counts: DataFrame, min_families: int = K.MIN_FAMILIES) -> DataFrame:
    """Pairs that at least ``min_families`` families share."""
    return shared_pairs(pair_families(counts), min_families)


def shared_pairs(having: DataFrame, min_families: int = K.MIN_FAMILIES) -> DataFrame:
    return having.groupBy("ckey", "shape").agg(F.count(F.lit(1)).alias("obs")).where(F.col("obs") >= min_families)


def item_leaders(table: DataFrame, item: str) -> DataFrame:
    """(item, families, leader): how many families use an item, and the least hash of its languages: items of the same languages mostly share it."""
    per_family = table.groupBy(item, "family").agg(F.min(F.xxhash64("language")).alias("leader"))
    return per_family.groupBy(item).agg(F.count(F.lit(1)).alias("families"), F.min("leader").alias("leader"))


def place_items(items: DataFrame, item: str, width: int) -> DataFrame:
    """(item, block, bit): distinct items put into blocks and numbered inside; what a block has beyond its width opens another.

    Items of one leader lie together, so a language meets few blocks however many there are. A leader of very many items
    has several homes, so no home holds more than some of them."""
    blocks = items.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (width * 0.8))).alias("b")).scalar()
    led = items.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / (width * 8)).alias("chunks"))
    housed = items.join(led, "leader").select(
        item, "leader", F.pmod(F.xxhash64("leader", F.pmod(F.xxhash64(item), F.col("chunks"))), blocks).alias("home"))
    place = F.row_number().over(Window.partitionBy("home").orderBy("leader", item)) - 1
    return housed.withColumn("place", place).select(
        item, (F.col("home") * (1 << 20) + F.floor(F.col("place") / width)).alias("block"), (F.col("place") % width).alias("bit"))


def item_masks(table: DataFrame, item: str, width: int, min_could: int) -> DataFrame:
    """(language, family, block, mask): which of a block's ``width`` items a language has, as bits of 64-bit words.

    Items too few families have are dropped (exact: no pair of theirs can reach the threshold)."""
    placed = place_items(item_leaders(table, item).where(F.col("families") >= min_could), item, width)
    rows = table.select("language", "family", item).join(placed, item)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, bit)), F.lit(0).cast("bigint")) for w in range(width // 64)]
    return rows.groupBy("language", "family", "block").agg(F.array(*words).alias("mask"))


def block_pairs(counts: DataFrame, min_could: int = K.MIN_COULD, uses: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(m_block, s_block, part, family, m_mask, s_mask): for each language one row per pair of blocks it has items of.

    ``part`` splits a pair of blocks by families. A row is two masks, however many words stand behind it."""
    meanings, shapes = uses or item_uses(counts)
    parts = meanings.select("family").distinct().agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / FAMILIES)).alias("p")).scalar()
    meanings, shapes = item_masks(meanings, "ckey", MEANINGS, min_could), item_masks(shapes, "shape", SHAPES, min_could)
    left = meanings.select("language", "family", F.col("block").alias("m_block"), F.col("mask").alias("m_mask"))
    right = shapes.select("language", "family", F.col("block").alias("s_block"), F.col("mask").alias("s_mask"))
    return left.join(right, ["language", "family"]).select("m_block", "s_block", F.pmod(F.xxhash64("family"), parts).alias("part"), "family", "m_mask", "s_mask")


def count_hypotheses(counts: DataFrame, min_could: int = K.MIN_COULD, uses: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row ``hypotheses``: pairs at least ``min_could`` families COULD share,
    because some language of each has both the meaning and the shape.

    The pairs are never materialised. A task gets the masks of two blocks and some of the families: a boolean
    matrix product tells which pairs each family could share. The tasks' counts, cut off at the threshold (so a
    byte a pair), are added per pair of blocks. ``uses``: the words by meaning and by shape, where they are at hand."""
    def bits(masks, width):
        import numpy as np
        words = np.array(masks.to_list(), dtype="<i8").reshape(len(masks), width // 64)
        return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float32)

    def count_part(rows):
        import numpy as np
        could = np.zeros((MEANINGS, SHAPES), dtype=np.int64)
        for _, of in rows.groupby("family", sort=False):
            shared = np.zeros((MEANINGS, SHAPES), dtype=bool)
            for a in range(0, len(of), 4096):
                some = of.iloc[a:a + 4096]
                shared |= (bits(some["m_mask"], MEANINGS).T @ bits(some["s_mask"], SHAPES)) > 0
            could += shared
        first = rows.iloc[0]
        return pd.DataFrame({"m_block": [first["m_block"]], "s_block": [first["s_block"]], "could": [np.minimum(could, min_could).astype(np.uint8 if min_could < 256 else np.uint32).tobytes()]})

    def add_parts(rows):
        import numpy as np
        kind = np.uint8 if min_could < 256 else np.uint32
        could = sum(np.frombuffer(x, dtype=kind).astype(np.int64) for x in rows["could"])
        return pd.DataFrame({"pairs": [int((could >= min_could).sum())]})

    per_part = block_pairs(counts, min_could, uses).groupBy("m_block", "s_block", "part").applyInPandas(count_part, "m_block bigint, s_block bigint, could binary")
    per_block = per_part.groupBy("m_block", "s_block").applyInPandas(add_parts, "pairs bigint")
    return per_block.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("hypotheses"))


def item_counts(table: DataFrame, placed: DataFrame, item: str, n: str, width: int) -> DataFrame:
    """(language, family, block, items): a language's items of a block with their words, each as one number, words * width + bit."""
    items = F.collect_list(F.col(n) * width + F.col("bit"))         # at most ``width``
    return table.join(placed, item).groupBy("language", "family", "block").agg(items.alias("items"))


def dealt_parts(rows: DataFrame, within: list[str]) -> DataFrame:
    """(*within, family, first, chunks): parts hold some ``ROUTED`` languages, of few families; a larger family has several parts.

    ``rows`` has a row per language, family and pair of blocks ``within`` which it is dealt."""
    sizes = rows.groupBy(*within, "family").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy(*within).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / ROUTED)).alias("groups"))
    first = F.pmod(F.xxhash64("family"), F.col("groups")) * (1 << 32)
    sized = sizes.join(groups, within) if within else sizes.crossJoin(groups)
    return sized.select(*within, "family", first.alias("first"), F.ceil(F.col("n") / ROUTED).alias("chunks"))


def part_number() -> Column:
    return F.col("first") + F.pmod(F.xxhash64("language"), F.col("chunks"))


def dealt_languages(counts: DataFrame) -> DataFrame:
    """(language, family, part): how languages that all meet in one pair of blocks are dealt."""
    spoken = counts.select("language", "family").distinct()
    return spoken.join(dealt_parts(spoken, []), "family").select("language", "family", part_number().alias("part"))


def log_misses(words: int, ks, ss):
    """Matrix of ln C(N-s, k) / C(N, k) for a language of N words; -inf where a hit is certain.

    As ``stats.miss_probability_log``: summed over the smaller of k and s."""
    import numpy as np

    def sums(few, many):
        out = np.full((len(few), len(many)), -np.inf)
        before, top = np.zeros(len(many)), int(min(few[-1], many[-1]))
        for start in range(0, top, 1024):
            i = np.arange(start, min(start + 1024, top))
            with np.errstate(divide="ignore"):
                run = before + np.cumsum(np.log1p(-np.minimum(many / (words - i)[:, None], 1.0)), axis=0)
            here = (few > start) & (few <= start + len(i))
            out[here] = run[few[here] - start - 1]
            before = run[-1]
        return out

    (k, at_k), (s, at_s) = np.unique(ks, return_inverse=True), np.unique(ss, return_inverse=True)
    table = np.where(k[:, None] <= s, sums(k, s), sums(s, k).T)
    return table[at_k][:, at_s]


_CODE = ["m_block", "s_block", "code"]


def place_pairs(pairs: DataFrame, uses: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of the pairs' meanings and of their shapes, and the pairs with their blocks and their ``code`` in them."""
    meanings, shapes = (place_items(item_leaders(table.join(pairs.select(item).distinct(), item, "left_semi"), item), item, width)
                        for table, item, width in zip(uses, ("ckey", "shape"), (MEANINGS, SHAPES)))
    placed = (pairs.join(meanings.select("ckey", F.col("block").alias("m_block"), F.col("bit").alias("m_bit")), "ckey")
              .join(shapes.select("shape", F.col("block").alias("s_block"), F.col("bit").alias("s_bit")), "shape")
              .select(*pairs.columns, "m_block", "s_block", (F.col("m_bit") * SHAPES + F.col("s_bit")).cast("int").alias("code")))
    return meanings, shapes, placed


def block_chances(uses: tuple[DataFrame, DataFrame], meanings: DataFrame, shapes: DataFrame, placed: DataFrame, settle=None) -> DataFrame:
    """(m_block, s_block, code, family, p): per placed pair and family the chance that the shuffle makes the family share it.

    No row is made for a pair and a language. A task gets two blocks of items as some languages use them, and the pairs
    that are asked for among those items: each language adds a matrix of logarithms to its family's. What leaves the task
    is a row for a pair and a family; the parts of a large family are added up. All rows of a pair are dealt together."""
    keep = settle or written
    block = ["m_block", "s_block"]
    words = uses[0].groupBy("language").agg(F.sum("k").alias("words"))
    left = keep(item_counts(uses[0], meanings, "ckey", "k", MEANINGS).join(words, "language").select(
        "language", "family", "words", F.col("block").alias("m_block"), F.col("items").alias("ks")))
    right = keep(item_counts(uses[1], shapes, "shape", "s", SHAPES).select("language", F.col("block").alias("s_block"), F.col("items").alias("ss")))
    met = left.join(right, "language")
    dealt = dealt_parts(met, block)
    rows = met.join(dealt, [*block, "family"]).select("family", "words", part_number().alias("part"), *block, "ks", "ss")
    parts = dealt.select(*block, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("chunks") - 1)).alias("to_part")).distinct()
    asked = placed.groupBy(*block).agg(F.collect_list("code").alias("codes")).join(parts, block)
    width_m, width_s = MEANINGS, SHAPES

    schema = pa.schema([("m_block", pa.int64()), ("s_block", pa.int64()), ("code", pa.int32()), ("family", pa.string()), ("log_miss", pa.float64())])

    def add_up(rows: pa.Table, asked: pa.Table) -> pa.Table:
        import numpy as np
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        wanted = np.zeros(width_m * width_s, dtype=bool)
        wanted[asked["codes"].combine_chunks().flatten().to_numpy()] = True
        wanted = wanted.reshape(width_m, width_s)
        words, (ks, ss) = rows["words"].to_numpy(), (np.split(x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy())[:-1])
                                                     for x in (rows["ks"].combine_chunks(), rows["ss"].combine_chunks()))
        names, of = np.unique(np.array(rows["family"].to_pylist(), dtype=object), return_inverse=True)
        made = []
        for at in np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1]):
            ms, hs = np.unique(np.concatenate([ks[i] for i in at]) % width_m), np.unique(np.concatenate([ss[i] for i in at]) % width_s)
            logs = np.zeros((len(ms), len(hs)))
            for i in at:
                k, s = ks[i], ss[i]
                logs[np.ix_(np.searchsorted(ms, k % width_m), np.searchsorted(hs, s % width_s))] += log_misses(int(words[i]), k // width_m, s // width_s)
            m, s = np.nonzero(wanted[np.ix_(ms, hs)] & (logs < 0))        # less than 0: a language of the family has both
            made.append((ms[m] * width_s + hs[s], logs[m, s]))
        codes, sizes = np.concatenate([c for c, _ in made]), [len(c) for c, _ in made]
        key = [np.full(len(codes), rows[c][0].as_py()) for c in ("m_block", "s_block")]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip([*key, codes, np.repeat(names, sizes), np.concatenate([x for _, x in made])], schema)], schema=schema)

    logs = rows.groupBy(*block, "part").cogroup(asked.groupBy(*block, "to_part")).applyInArrow(
        add_up, "m_block bigint, s_block bigint, code int, family string, log_miss double")
    return logs.repartition(*_CODE).groupBy(*_CODE, "family").agg((-F.expm1(F.sum("log_miss"))).alias("p"))


def family_chances(counts: DataFrame, pairs: DataFrame, settle=None) -> DataFrame:
    """Per pair and family: the chance that the shuffle makes the family share it."""
    uses = item_uses(counts, settle)
    meanings, shapes, placed = map(settle or written, place_pairs(pairs.select("ckey", "shape"), uses))
    return block_chances(uses, meanings, shapes, placed, settle).join(placed, _CODE).select("ckey", "shape", "family", "p")


def tested_pairs(counts: DataFrame, min_families: int = K.MIN_FAMILIES, min_could: int = K.MIN_COULD, settle=None,
                 uses: tuple[DataFrame, DataFrame] | None = None, having: DataFrame | None = None) -> DataFrame:
    """Observed pairs that enough families could share: observed count, 5-95% band, tail.

    A pair's chances become partial polynomials of some ``FAMILIES`` families each, which are then multiplied. Pairs get their
    names back at the end. ``uses``: the words by meaning and by shape, ``having``: ``pair_families``, where they are at hand."""
    keep, uses = settle or written, uses or item_uses(counts, settle)
    meanings, shapes, placed = place_pairs(keep(shared_pairs(having or pair_families(counts), min_families)), uses)
    meanings, shapes, placed = keep(meanings), keep(shapes), keep(placed)
    parts = uses[0].select("family").distinct().agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / FAMILIES)).alias("p")).scalar()
    chances = block_chances(uses, meanings, shapes, placed, settle).withColumn("part", F.pmod(F.xxhash64("family"), parts))
    partial = chances.groupBy(*_CODE, "part").agg(F.collect_list("p").alias("ps")).select(
        *_CODE, F.size("ps").alias("n"), hit_polynomial()(F.col("ps")).alias("d"))
    per_pair = partial.groupBy(*_CODE).agg(F.sum("n").cast("int").alias("could"), F.collect_list("d").alias("ds"))
    tested = per_pair.where(F.col("could") >= min_could).join(placed, _CODE)
    return tested.select("ckey", "shape", "obs", "could", family_count_band()(F.col("ds"), F.col("obs")).alias("b")).select(
        "ckey", "shape", "obs", "could", "b.lo", "b.hi", "b.p")


def _product(polynomials: list):
    """Product of polynomials (distributions of counts), neighbours first; the vanishing top is left out."""
    import numpy as np
    made = sorted(polynomials, key=lambda d: (len(d), d.tolist()))        # one order, so one value
    while len(made) > 1:
        made = [np.convolve(*made[i:i + 2]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
        made = [d[:np.flatnonzero(d > 1e-300)[-1] + 1] for d in made]
    return made[0]


def hit_polynomial():
    """UDF (chances) -> chance of 0, 1, 2, ... hits; equal chances are one binomial, found by squaring."""
    @F.pandas_udf("array<double>")
    def polynomial(ps: pd.Series) -> pd.Series:
        import numpy as np

        def one(chances):
            values, times = np.unique(np.asarray(chances, dtype="float64"), return_counts=True)
            factors = []
            for p, n in zip(values, times):
                base = np.array([1.0 - p, p])
                for bit in range(int(n).bit_length()):
                    if n >> bit & 1:
                        factors.append(base)
                    base = _product([base, base])
            return _product(factors)
        return ps.map(one)
    return polynomial


def family_count_band(low: float = 0.05, high: float = 0.95):
    """UDF (partial polynomials, observed) -> lo, hi, p: band and upper tail of the number of hits.

    The array functions in ``functions.stats`` give the same numbers from all chances at once."""
    @F.pandas_udf("lo int, hi int, p double")
    def band(ds: pd.Series, obs: pd.Series) -> pd.DataFrame:
        import numpy as np
        rows = []
        for polynomials, seen in zip(ds, obs):
            dist = _product([np.asarray(d, dtype="float64") for d in polynomials])
            acc = np.cumsum(dist)
            at = [min(int(np.searchsorted(acc, f - 1e-12)), len(dist) - 1) for f in (low, high)]
            rows.append((*at, min(1.0, float(dist[int(seen):][::-1].sum()))))
        return pd.DataFrame(rows, columns=["lo", "hi", "p"])
    return band


def benjamini_hochberg(tested: DataFrame, hypotheses: DataFrame, p: str = "p") -> DataFrame:
    """Add ``q``, the adjusted p-value over ``hypotheses`` (a one-row table).

    q depends on p alone (ties share the last rank), so it is computed once per
    distinct p. Ranks and the running minimum are taken in three levels: inside
    value buckets (1/4096 of a binade, so a monotone function of p), over the
    buckets of a binade, and over the binades, of which doubles have some 1,100."""
    per_p = tested.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    e = F.floor(F.log2("_p"))
    bucket = F.when(F.col("_p") <= 0, F.lit(-(10 ** 7)).cast("bigint")).otherwise(
        (e * 4096 + F.floor((F.col("_p") / F.pow(F.lit(2.0), e) - 1) * 4096)).cast("bigint"))
    per_p = per_p.withColumn("_b", bucket)
    binade = F.floor(F.col("_b") / 4096)
    totals = per_p.groupBy("_b").agg(F.sum("_n").alias("_bn")).withColumn("_e", binade)
    earlier = Window.orderBy("_e").rowsBetween(Window.unboundedPreceding, -1)
    below = totals.groupBy("_e").agg(F.sum("_bn").alias("_en")).select("_e", F.coalesce(F.sum("_en").over(earlier), F.lit(0)).alias("_below"))
    up = Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_in", F.coalesce(F.sum("_bn").over(up), F.lit(0))).join(below, "_e").select(
        "_b", (F.col("_below") + F.col("_in")).alias("_before"))
    m = F.greatest(hypotheses.scalar(), tested.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(1).cast("bigint"))
    inside = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    raw = per_p.join(before, "_b").withColumn(
        "_raw", F.col("_p") * m / (F.col("_before") + F.sum("_n").over(inside)))
    lows = raw.groupBy("_b").agg(F.min("_raw").alias("_m")).withColumn("_e", binade)
    above = lows.groupBy("_e").agg(F.min("_m").alias("_em")).select(
        "_e", F.min("_em").over(Window.orderBy("_e").rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    later = Window.partitionBy("_e").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    ahead = lows.withColumn("_in", F.min("_m").over(later)).join(above, "_e").select(
        "_b", F.least(F.col("_in"), F.col("_above"), F.lit(1.0)).alias("_ahead"))
    rest = Window.partitionBy("_b").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    q = raw.join(ahead, "_b").select(
        F.col("_p").alias(p), F.least(F.lit(1.0), F.min("_raw").over(rest), F.col("_ahead")).alias("q"))
    return tested.join(q, p)


def _baseline(counts: DataFrame, min_families: int, min_could: int, settle, having: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tested pairs and the number of hypotheses; each is computed once, however many branches read it."""
    keep = settle or written
    uses = item_uses(counts, settle)
    return keep(tested_pairs(counts, min_families, min_could, settle, uses, having)), keep(count_hypotheses(counts, min_could, uses))


def chance_bands(words: DataFrame, min_families: int = K.MIN_FAMILIES, min_could: int = K.MIN_COULD,
                 settle=None) -> DataFrame:
    """Observed families, 5-95% chance band and q (6 digits) per tested pair.

    ``settle`` (``lexshape.session.settle`` where none is given) is applied to the
    tables that several branches read, so a cluster computes them once."""
    return chance_bands_of((settle or written)(word_counts(words)), min_families, min_could, settle)


def chance_bands_of(counts: DataFrame, min_families: int = K.MIN_FAMILIES, min_could: int = K.MIN_COULD, settle=None,
                    having: DataFrame | None = None) -> DataFrame:
    """``chance_bands`` from ``word_counts`` (and ``pair_families``), for a caller that reads these too."""
    return benjamini_hochberg(*_baseline(counts, min_families, min_could, settle, having)).withColumn("q", F.round("q", 6))


def baseline_summary(words: DataFrame, fdr: float = K.FDR, min_families: int = K.MIN_FAMILIES,
                     min_could: int = K.MIN_COULD, settle=None) -> DataFrame:
    """One row: hypotheses, tested pairs, pairs beyond chance, the rate used."""
    tested, hypotheses = _baseline((settle or written)(word_counts(words)), min_families, min_could, settle)
    q = benjamini_hochberg(tested, hypotheses)
    out = q.agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.round("q", 6) <= fdr).alias("beyond"))
    return out.select(hypotheses.scalar().alias("hypotheses"), "tested", "beyond", F.lit(fdr).alias("fdr"))


def beyond_chance(bands: DataFrame, fdr: float = K.FDR) -> DataFrame:
    """Per meaning: shapes beyond chance and the largest excess over the band."""
    return bands.where(F.col("q") <= fdr).groupBy("ckey").agg(
        F.count(F.lit(1)).alias("beyond"), F.max(F.col("obs") - F.col("hi")).alias("gap"))
