"""Exact dedup, near duplicates and components against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lexshape.llm import exact, graph, minhash

EDGE = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "A"), (6, "a "), (7, "one two three"), (None, "a"), (8, "x" * 70_000), (9, "x" * 70_000),
        (10, "x" * 70_001), (11, "é" * 9_000), (12, "é" * 9_000), (13, " ")]


@pytest.mark.parametrize("block", [7, 64, exact.BLOCK_BYTES])
def test_exact_groups_equal_brute_force(frame, prose, block):
    rows = [(i, t[:3000]) if t else (i, t) for i, t in EDGE] + [(100 + i, prose(30, i % 5)) for i in range(20)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact.exact_decisions(frame(rows), block_bytes=block).collect()
    assert len(got) == len(rows)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)


def test_long_texts_are_named_through_several_levels(frame):
    got = {r.doc_id: r.keep_id for r in exact.exact_decisions(frame(EDGE)).collect() if (r.doc_id or 0) >= 8}
    assert got == {8: 9, 9: 9, 10: 10, 11: 12, 12: 12, 13: 13}


def test_a_stage_keeps_one_row_of_each_text_with_all_columns(frame):
    docs = frame(EDGE)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "" for _, t in EDGE})


def test_empty_tables(frame):
    none = frame([(1, "a")]).limit(0)
    assert exact.exact_decisions(none).count() == exact.drop_exact_copies(none).count() == 0
    assert minhash.near_decisions(none).count() == minhash.drop_near_copies(none).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        ids = [x for x in (low.get(find(k)), i) if x is not None]
        low[find(k)] = min(ids) if ids else None
    return [(i, len(s), low[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def edited(text, every, seed):
    w = text.split()
    for k in range(seed % every, len(w), every):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


def test_near_components_equal_brute_force(frame, prose):
    rows = list(EDGE)
    for g in range(4):
        base = prose(400, g)
        rows += [(1000 * (g + 1) + k, edited(base, every, k)) for k, every in enumerate((500, 150, 130, 90, 60, 45, 300, 200, 101, 77))]
    rows += [(9000 + k, prose(60, 99) + " " + prose(6, 200 + k)) for k in range(12)]
    rows += [(9500, "Few WORDS"), (9501, "few\twords\n"), (9502, "few words,"), (1000, prose(40, 7))]
    got = minhash.near_decisions(frame(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(near_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_a_near_group_stays(frame, prose):
    base = prose(300, 1)
    rows = [(5, base), (5, base), (3, edited(base, 200, 1)), (9, base + " end"), (7, prose(300, 2)), (None, None), (8, "")]
    docs = frame(rows)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 7, None, 8])


def test_a_chain_of_links_is_one_component(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_the_pipelines_stage_links_at_four_fifths(frame, prose, spark):
    rows = []
    for g in range(6):
        base = prose(400, 30 + g)
        rows += [(100 * (g + 1) + k, edited(base, every, 0)) for k, every in enumerate((500, 55, 53, 48, 41))]
    sets = {i: shingles(t) for i, t in rows}
    by = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert any(0.80 <= j < 0.85 for j in by.values()) and any(0.7 < j < 0.80 for j in by.values())
    want = {i for i, _, low in near_components(rows, 80) if i == low}
    assert len(want) < len({low for _, _, low in near_components(rows)})
    kept = corpus_pipeline.without_near_copies(spark, frame(rows), "")
    assert {r.doc_id for r in kept.collect()} == want


def test_bands_follow_from_the_threshold():
    assert (minhash.banding(85), minhash.banding(80), minhash.banding(100)) == ((32, 6), (50, 6), (1, 6))
    for percent in range(1, 100):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISSED and bands * rows <= minhash.SKETCH
