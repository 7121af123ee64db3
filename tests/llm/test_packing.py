"""Shards and packed sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexshape.llm import packing, sharding
from lexshape.llm.queries import tokenizer_files
from lexshape.session import scratch_path

TEXTS = [(1, None), (2, ""), (3, "one two\nthree"), (3, "one two\nthree"), (4, " lead"), (5, "two  blanks "), (6, "a\n\nb\t"), (7, "<|endoftext|> x <|endoftext|>"),
         (8, "it's 12345 don't é\xa0b 　c"), (None, "null id"), (9, "word " * 9000), (10, "\n"), (11, "a<|endoftext|>b")]


def test_pieces_hold_the_tokenizers_ids(frame):
    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pieces(frame(TEXTS), **tokenizer_files()).collect()
    want = []
    for i, text in TEXTS:
        ids = np.array([*codec.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("group", [4, 4096])
def test_sequences_are_full_from_the_front(frame, prose, group):
    docs = frame(TEXTS + [(100 + k, prose(1 + 37 * k % 900, k)) for k in range(60)])
    rows = packing.pack_documents(docs, **tokenizer_files(), group=group).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in packing.pieces(docs, **tokenizer_files()).collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_tournament_tree_is_first_fit_decreasing():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 257):
        lengths = r.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in np.argsort(-lengths, kind="stable").tolist():
            k = next((k for k, x in enumerate(room) if x >= lengths[i]), len(room))
            room += [100] * (k == len(room))
            want[i] = (k, 100 - room[k])
            room[k] -= lengths[i]
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [tuple(map(int, want[i])) for i in range(n)]


def test_empty_table(frame, spark):
    none = frame(TEXTS).limit(0)
    assert packing.pack_documents(none, **tokenizer_files()).count() == 0
    assert sharding.shard_by_bytes(none, 8, scratch_path(spark, "map")).count() == 0


def test_shards_are_even_and_positions_gapless(frame, prose, spark):
    rows = TEXTS + [(100 + k, prose(1 + 37 * k % 900, k)) for k in range(300)]
    path = scratch_path(spark, "map")
    got = sharding.shard_by_bytes(frame(rows), 4, path).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    loads = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) < 0.1 * sum(loads) / 4
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    first, last = sharding.read_map(spark, path, 1), sharding.read_map(spark, path)
    assert first.count() == last.count() == sharding.SLOTS
    moved = first.join(last.withColumnRenamed("shard", "now"), "vslot").where("shard != now").count()
    assert 0 < moved < sharding.SLOTS // 8


def test_a_hot_key_does_not_fill_a_shard(frame, prose, spark):
    text = prose(300, 1)
    rows = [(i, prose(300, i)) for i in range(400)] + [(None, text)] * 400 + [(7, prose(300, 1000 + i)) for i in range(400)]
    path = scratch_path(spark, "map")
    got = sharding.shard_by_bytes(frame(rows), 8, path).collect()
    loads = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert len(got) == len(rows) and max(loads) - min(loads) < 0.02 * sum(loads) / 8
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    opened = {r.vslot for r in sharding.read_map(spark, path).where("opened").collect()}
    key = spark.createDataFrame([(None,), (7,)], "doc_id long").select(sharding.slot_of("doc_id")).collect()
    assert {r[0] for r in key} <= opened and not sharding.read_map(spark, path, 1).where("opened").count()


def test_one_shard_more_takes_rows_only_into_itself():
    sizes = [(7 * k) % 53 for k in range(512)]
    owner = sharding.rebalance(sharding.even_map(4, 512), sizes, 4)
    grown = sharding.grow(owner, sizes, 4)
    assert all(b in (a, 4) for a, b in zip(owner, grown))
    loads = [sum(s for s, o in zip(sizes, grown) if o == k) for k in range(5)]
    assert min(loads) > 0.8 * sum(sizes) / 5
    shrunk = sharding.rebalance(grown, sizes, 4)
    assert set(shrunk) == {0, 1, 2, 3}
