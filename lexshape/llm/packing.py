"""Packing into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents become token ids (a closing id at the end), are cut into pieces of at most one
sequence, and the pieces are dealt at random into groups of about ``GROUP`` pieces. Each
group is packed on its own: pieces in falling length, each into the first bin with room,
which the tree of largest capacities finds in a logarithm of the bins. Groups have a
bounded size and do not depend on keys or sources, so no group is hot.

Defined cases: a null or empty text is the closing id alone. Rows that repeat a document
are packed once each. An empty table gives an empty result. Texts of any length become
as many full pieces as they need. Equal lengths keep the order of the written pieces.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexshape.session import settle

SEQUENCE = 2048
GROUP = 4096
CLOSING_ID = 1
CACHED_BYTES = 48_000_000     # about, of a worker's cache of chunks and their ids; a task's cache ends with it
ENTRY = 200                   # what an entry takes beside its characters and ids


class _Joint(Exception):
    """White space at the edge of a chunk: the cut at blanks isn't exact there."""


class Words(dict):
    """Token ids of chunks, as little-endian 32-bit bytes. A text is cut before each blank and each line feed; chunks whose edges are not
    white space are encoded alone with the same ids as within the text, since the tokenizer's own split
    never joins them. Any other text is encoded whole."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.held = 0
        self.codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> bytes:
        ids = self.codec.encode(text, allowed_special="all") if "<|" in text else self.codec.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        words = chunk[1:] if chunk.startswith("\n") else chunk
        if not words or words[0].isspace() or words[-1].isspace():
            raise _Joint
        if self.held >= CACHED_BYTES:
            self.forget()
        ids = self[chunk] = self.whole(chunk if chunk.startswith("\n") else " " + chunk)
        self.held += ENTRY + len(chunk) + len(ids)
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def encode(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Joint
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except _Joint:
            return self.whole(text)


_codecs: dict = {}


def codec(ranks_path: str, pattern: str, special: tuple) -> Words:
    key = (ranks_path, pattern, special)
    if key not in _codecs:
        _codecs[key] = Words(ranks_path, pattern, dict(special))
    return _codecs[key]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], sequence: int = SEQUENCE,
           closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for each piece of each document."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())])
    arrow, special = to_arrow_schema(out), tuple(special.items())

    def run(batches):
        words, closing = codec(ranks_path, pattern, special), struct.pack("<I", closing_id)
        words.forget()
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = words.encode(text.as_py() or "") + closing
                for a in range(0, len(ids), 4 * sequence):
                    part = ids[a:a + 4 * sequence]
                    row.append(i)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())).cast(arrow.field("doc_id").type),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], schema=arrow)
        words.forget()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. ``tree[1]`` is the largest room of any bin, ``tree[2k], tree[2k + 1]`` those below ``k``."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            top = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == top:
                break
            tree[node] = top
            node //= 2
    return bins, offsets


def pack(parts: DataFrame, sequence: int = SEQUENCE, group: int = GROUP, seed: int = 17) -> DataFrame:
    """Sequence and offset for each piece; ``parts`` has a ``length`` column."""
    parts = settle(parts)
    groups = max(1, -(-parts.count() // group))
    dealt = (parts.withColumn("__row", F.monotonically_increasing_id())
             .withColumn("__group", F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(groups))))
    out = T.StructType([*parts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), sequence)
        ids = table.column("__group").to_numpy() * (1 << 24) + bins
        cols = {"sequence_id": pa.array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64())}
        return pa.Table.from_arrays([cols[f.name] if f.name in cols else table.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return dealt.groupBy("__group").applyInArrow(run, out)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], sequence: int = SEQUENCE, group: int = GROUP, **kw) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(pieces(docs, ranks_path, pattern, special, sequence, **kw), sequence, group)
