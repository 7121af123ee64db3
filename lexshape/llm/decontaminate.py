"""Benchmark passages in documents: pigeonhole pieces, then Myers' bit-parallel distance.

Texts are compared word by word (lower case; punctuation and blanks of any script part words, and a letter of
a script that is written without blanks is a word). An item may
differ from a passage by an error budget of a share of its words (inserted, lost or
changed). It is cut into budget + 1 pieces, one of which must then stand in the passage
unchanged (a short item has a budget of 0 and is one piece); places of pieces are found by the hash of their first words, up to ``WIDEST``, and checked
against the whole piece, and the item is held against the text around them by
bit-parallel approximate matching over the words themselves.

Documents are read in one pass for each ``ITEMS`` benchmark items, the most that a pass
carries to the executors. Nothing is shuffled or joined; no group exists to be hot.

Defined cases: null or wordless texts have no hits, null or wordless items no evidence. Every other item is searched, those of
one word too. An item given twice is found twice.
Equal distances: the first place counts. Repeated documents are reported once each.
Empty tables give no hits.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexshape.llm.rows import add_columns, keep_rows

ERRORS = 0.15
WIDEST = 5              # words of a piece that its hash covers
ITEMS = 20_000
_PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


# scripts without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han), and punctuation and blanks beyond ASCII
_ALONE = re.compile("[\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u1049\u1780-\u17d3\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_BETWEEN = re.compile("[\u0085\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u1680\u2000-\u206f\u3000-\u3004\u3008-\u3020\u3030\u30fb\ufe10-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(text: str) -> list[bytes]:
    if not text.isascii():
        text = _ALONE.sub(r" \g<0> ", _BETWEEN.sub(" ", text))
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64)


def budget(n: int, errors: float = ERRORS) -> int:
    return int(n * errors)


def piece_starts(n: int, k: int) -> list[int]:
    """Starts of ``k`` pieces of nearly equal length, and the end."""
    return [n * i // k for i in range(k + 1)]


def myers(pattern: dict, m: int, text: list) -> tuple[int, int]:
    """Least distance between the pattern and any part of the text, and where that part ends (the first of equals).

    ``pattern`` maps a word to the bits of its places; column differences are kept in two words of m bits."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = mask, 0, m, m, 0
    for j, word in enumerate(text):
        eq = pattern.get(word, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (mask & ~(diagonal | up)), up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1, fall << 1              # row 0 is zero everywhere: a match may start at any word
        up, down = (fall | ~(diagonal | rise)) & mask, rise & diagonal & mask
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """All pieces of a bounded number of items."""

    def __init__(self, items: list, errors: float = ERRORS):
        self.items, by_width = [], defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                places = defaultdict(int)
                for i, w in enumerate(words):
                    places[w] |= 1 << i
                self.items.append((item_id, words, dict(places), budget(len(words), errors)))
        cuts = [piece_starts(len(words), e + 1) for _, words, _, e in self.items]
        for k, ((_, words, _, _), cut) in enumerate(zip(self.items, cuts)):
            codes = word_codes(words)
            for a, b in zip(cut, cut[1:]):
                width = min(b - a, WIDEST)
                by_width[width][int(self.rolled(codes[a:a + width], width)[0])].append((k, a, b))
        self.by_width = {}
        for width, by_key in by_width.items():
            seen = np.zeros(1 << 20, bool)
            seen[np.array([x >> 44 for x in by_key], np.int64)] = True
            self.by_width[width] = dict(by_key), seen

    @staticmethod
    def rolled(codes: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of ``width`` words."""
        last = len(codes) - width + 1
        h = np.zeros(max(0, last), np.uint64)
        for j in range(width if last > 0 else 0):
            h = (h ^ codes[j:j + last]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, text: str) -> list[tuple]:
        """(item_id, distance, first word, end word) of each item within its budget, at its best place."""
        words = words_of(text)
        if not self.items or not words:
            return []
        codes, tried, best = word_codes(words), set(), {}
        for width, (by_key, seen) in self.by_width.items():
            keys = self.rolled(codes, width)
            places = np.flatnonzero(seen[(keys >> np.uint64(44)).astype(np.int64)]).tolist()
            self._try(words, ((at, piece) for at in places for piece in by_key.get(int(keys[at]), ())), tried, best)
        return [best[k] for k in sorted(best)]

    def _try(self, words: list, found, tried: set, best: dict) -> None:
        """Hold the items of found pieces (place, (item, piece's words)) against the text around; ``best`` keeps each item's best place."""
        for at, (k, a, b) in found:
            item_id, item, places, e = self.items[k]
            if (k, at - a) in tried or words[at:at + b - a] != item[a:b]:
                continue
            tried.add((k, at - a))
            start = max(0, at - a - e)
            distance, end = myers(places, len(item), words[start:at - a + len(item) + e])
            if distance <= e and (k not in best or (distance, start + end) < (best[k][1], best[k][3])):
                # the reversed item against the reversed text up to the end: where the part begins
                back = defaultdict(int)
                for i, w in enumerate(reversed(item)):
                    back[w] |= 1 << i
                _, length = myers(back, len(item), words[start:start + end][::-1])
                best[k] = (item_id, distance, start + end - length, start + end)


def _passes(benchmark: DataFrame, items: int, id_col: str, text_col: str):
    """Lists of at most about ``items`` (id, text) items: bounded parts of the benchmark, one at a time."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    parts = -(-rows.count() // items)
    for k in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]


_finders: dict = {}


def _finder(key: str, items: list, errors: float) -> Finder:
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(items, errors)
    return _finders[key]


def _keyed(items: list) -> tuple[str, list]:
    return f"{zlib.crc32(repr(items).encode())}-{len(items)}", items


def leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, items: int = ITEMS, item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word): every item that a document holds within the budget."""
    kind = T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("distance", T.IntegerType()),
                                     T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))
    names, found = [f.name for f in kind.elementType], None
    for key, part in map(_keyed, _passes(benchmark, items, item_id, "text")):
        def make(texts, key=key, part=part):
            return [[[dict(zip(names, hit)) for hit in _finder(key, part, errors).hits(t)] for t in texts]]
        rows = add_columns(docs.select("doc_id", "text"), "text", T.StructType([T.StructField("hits", kind)]), make).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        empty = T.StructType([docs.schema["doc_id"], *kind.elementType.fields])
        found = docs.sparkSession.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in empty]))
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, items: int = ITEMS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, all columns as they were."""
    for key, part in map(_keyed, _passes(benchmark, items, "item_id", "text")):
        docs = keep_rows(docs, "text", lambda texts, key=key, part=part: [not _finder(key, part, errors).hits(t) for t in texts])
    return docs
