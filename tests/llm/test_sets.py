"""Merkle manifests, Jaccard joins and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexshape.llm import importance, jaccard_join, merkle


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- Merkle manifest ---------------------------------------------------------

KIND = "doc_id long, text string, lang string, source string, n_chars long, at string, size int, leaf string, root int, block string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(nodes):
    """All levels of a tree of fanout 8."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[a:a + 8])) for a in range(0, len(last), 8)])
    return levels


def plain_manifest(rows, claims):
    """(doc_id, leaf, subroot, root, proof, folded) in order, by whole trees."""
    def leaf(i, t, lang, source, n):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, t)))
    groups = defaultdict(list)
    for (i, t, lang, source, n), claim in zip(rows, claims):
        groups[lang].append(((i is not None, i), leaf(i, t, lang, source, n), leaf(i, claim, lang, source, n), i))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, (_, own, claim, i) in enumerate(sorted(groups[g])):
            siblings, node = [], claim
            for levels, k in ((trees[g], at), (top, place)):
                for level in levels[:-1]:
                    run = list(level[k // 8 * 8:k // 8 * 8 + 8])
                    siblings += run[:k % 8] + run[k % 8 + 1:]
                    run[k % 8] = node
                    node, k = sha("".join(run)), k // 8
            out.append((i, own, trees[g][-1][0], top[-1][0], sha("".join(siblings)), node))
    return out


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("block", [1, 8, 64, 4096])
def test_manifest_equals_whole_trees(spark, block):
    r = random.Random(3)
    sizes = {"a": 131, "é": 74, None: 65, "b": 9, "c": 1, "d": 8, **{f"g{k}": 1 + k for k in range(6)}}
    rows = [(n, r.choice([None, "", "Text Ä", "plain", "x" * 3000]), g, r.choice([None, "s"]), r.choice([None, 4])) for n, g in enumerate(g for g, k in sizes.items() for _ in range(k))]
    df = spark.createDataFrame([(*x, "z", 1, "l", 2, "b") for x in r.sample(rows, len(rows))], KIND).repartition(3)
    said = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    want = plain_manifest(rows, [lower(x[1]) if x[0] % 3 == 0 else x[1] for x in rows])
    got = rows_of(merkle.manifest(df, said, block=block))
    assert sorted(x[:6] for x in got) == sorted(want)
    assert all(x[6] == (x[5] == x[3]) for x in got) and {x[6] for x in got} == {True, False}


def test_manifest_of_null_and_repeated_ids(spark):
    rows = [(None, "same", "a", "s", 4)] * 30 + [(5, "one", "a", "s", 3), (5, "other", "a", "s", 3), (None, None, None, None, None)]
    df = spark.createDataFrame([(*x, "z", 1, "l", 2, "b") for x in rows], KIND)
    got = rows_of(merkle.manifest(df, block=8))
    assert Counter(x[:6] for x in got) == Counter(plain_manifest(rows, [x[1] for x in rows]))
    assert all(x[6] for x in got)


def test_manifest_of_nothing_and_of_one_row(spark):
    empty = spark.createDataFrame([], KIND)
    assert rows_of(merkle.manifest(empty)) == []
    one = spark.createDataFrame([(7, "T", "en", "s", 1, "z", 1, "l", 2, "b")], KIND)
    (row,) = rows_of(merkle.manifest(one))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha("") and row[6]


# --- Jaccard join ------------------------------------------------------------

def plain_join(rows, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x, a in enumerate(sets):
        for y in range(x):
            both = len(a & sets[y])
            if both and 100 * both >= percent * (len(a) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)].append(i)
    return sorted(((i, len(s), i if not s else min(least[find(x)], default=None)) for x, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.fixture
def copies(prose):
    """Chains and clouds of near copies around the threshold, exact copies, and texts that share passages only."""
    r = random.Random(11)
    texts = []
    for k in range(4):
        base = prose(120, k)
        texts += [edited(base, r, r.randint(0, 5)) for _ in range(12)] + [base] * 3
    shared = prose(90, 77)
    texts += [shared + " " + prose(r.randint(10, 60), 100 + k) for k in range(25)]
    short = prose(12, 55)
    texts += [short, short.upper(), short + " word", "one two", "ONE two", "one", None, "", " \t\n"] + [prose(40, 200 + k) for k in range(20)]
    chain = prose(200, 5)
    for _ in range(12):
        texts.append(chain)
        chain = edited(chain, r, 3)
    return list(enumerate(r.sample(texts, len(texts))))


def test_join_equals_brute_force(spark, frame, copies):
    got = sorted(rows_of(jaccard_join.join_documents(frame(copies).repartition(3))), key=repr)
    assert got == plain_join(copies)


def test_join_of_repeated_and_null_ids(frame, prose):
    base = prose(60, 1)
    rows = [(None, base)] * 20 + [(3, base), (4, base + " more"), (4, base + " more"), (None, None), (9, prose(300, 2)), (None, prose(50, 3))]
    assert sorted(rows_of(jaccard_join.join_documents(frame(rows))), key=repr) == plain_join(rows)


def test_join_of_nothing_and_of_wordless_texts(frame):
    assert rows_of(jaccard_join.join_documents(frame([]))) == []
    assert sorted(rows_of(jaccard_join.join_documents(frame([(1, None), (2, ""), (3, "\n")])))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_prefixes_of_similar_sets_share_what_they_ask_for():
    """For any estimate of the counts, sets at the threshold share at least the smaller number of prefix tokens."""
    import numpy as np
    r = np.random.default_rng(4)
    seen = set()
    for turn in range(400):
        n = int(r.integers(1, 120))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        lost = r.permutation(len(x))[:int(r.integers(0, len(x) // 5 + 1))]
        y = np.unique(np.concatenate([np.delete(x, lost), r.integers(0, 1 << 63, len(lost) // 3).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        counts = r.integers(0, 1 + 10 ** int(r.integers(0, 5)), 1 << 8) * (r.random(1 << 8) < 0.5)
        (k, a), (m, b) = (jaccard_join.prefix(z, counts, 80) for z in (x, y))
        seen |= {k, m}
        assert len(np.intersect1d(a, b)) >= min(k, m)
    assert len(seen) > 2                       # prefixes did adapt


# --- importance resampling ---------------------------------------------------

def plain_resample(docs, target):
    def features(text):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text) or "")
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000
    corpus, goal = (Counter(bucket(f) for _, t in side for f in features(t)) for side in (docs, target))
    s_all, t_all = sum(corpus.values()), sum(goal.values())
    out = []
    for i, text in docs:
        fs = list(map(bucket, features(text)))
        gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10000) / ((corpus[b] + 1) * (t_all + 10000)))) for b in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= 39), key=lambda x: (-x[3], x[0] is None, x[0], x[1]))
    for k, x in enumerate(fit[:25 * len(fit) // 100], 1):
        x[4] = k
    return sorted(map(tuple, out), key=repr)


TARGET = "item_id long, text string, score int"


def test_resampling_equals_the_plain_draw(spark, frame, prose):
    r = random.Random(2)
    docs = [(i, " ".join([prose(r.choice([1, 19, 20, 21, 60]), r.randrange(40)), "Ünï 你好 A1-b"[:r.choice([0, 5, 12])]])) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "--"), (403, prose(30000, 9))]
    target = [(1, prose(50, 3)), (2, None), (3, prose(20, 5))]
    got = importance.resample(frame(docs).withColumn("score", F.lit("x")).withColumn("rank", F.lit("y")).repartition(4), spark.createDataFrame([(*t, 0) for t in target], TARGET))
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(rows_of(got), key=repr) == plain_resample(docs, target)


def test_resampling_of_repeated_rows_and_empty_tables(spark, frame, prose):
    docs = [(None, prose(30, 1))] * 33 + [(2, prose(30, 2))] * 5 + [(2, prose(31, 3)), (7, prose(30, 4))]
    none = spark.createDataFrame([], TARGET)
    assert sorted(rows_of(importance.resample(frame(docs), none)), key=repr) == plain_resample(docs, [])
    assert rows_of(importance.resample(frame([]), none)) == []
    few = [(1, prose(20, 1)), (2, prose(25, 1))]
    assert sorted(rows_of(importance.resample(frame(few), none)), key=repr) == plain_resample(few, [])      # a quarter of two is none


def test_selection_finds_every_rank(spark):
    keyed = importance.with_key(spark.createDataFrame([(i // 2, 50, 0, (i * 7) % 11) for i in range(60)], "doc_id long, n_features long, weight long, score long"))
    order = [r["key"] for r in keyed.orderBy("key").collect()]
    for k in (1, 2, 17, 60):
        assert keyed.where(F.col("key") == importance.kth_key(keyed, k, pivots=3)).first()["key"] == order[k - 1]
