"""N-gram Jaccard join by adaptive multi-match prefixes.

All sets are put in one order, tokens that few sets hold first. If two sets overlap in at least o
tokens, then the first ``size - o + m`` tokens of each (its m-fold prefix) share at least m. A longer prefix
is read more often but lets fewer pairs through. Each set chooses its own m: it
lengthens its prefix as long as the estimated cost of its candidates falls (rows of its tokens'
lists, and verifications, of which a list row can cause at most one m-th). Two sets
with prefixes of m and k must share the smaller of the two numbers; only then are the full sets compared.

How many sets hold a token is estimated from counts of hashed tokens over all texts (one array of fixed size), above
their mean. The estimate decides order and length, never the result: every order gives the same links.

No pairs inside a group. Equal sets are one class. In the list of a token each class first meets one
class only, drawn by a few bits of the token, so that copies of one text meet the same few and
count their shared tokens. Where many classes of a list stay outside its largest component, they meet
further classes drawn from that component, for a few turns. Lists whose classes then hang
together are done. In the others every class outside the largest
component meets the rest of the list, the shared tokens are counted whole, and the pairs
verified: no link between different sets is lost. Before, sets are held against each other by the parities of their counts in
``PARITY`` hash ranges: two sets differ by at least as many tokens as parities, so what cannot be a link is passed over, exactly. All joins are on tokens or classes, which Spark can split.

Shingles: A-Z lower-cased, words between ASCII white space, distinct runs of five words; with fewer
words the whole sequence is the one shingle. They are compared by 64-bit hashes, classes by SHA-256.

Defined cases: null or wordless texts have the empty set and are linked with nothing (their component
is their own id). Null ids sort last. Repeated rows are in one component. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexshape.llm.graph import components
from lexshape.llm.rows import text_sha
from lexshape.session import settle

SHINGLE = 5
PERCENT = 80
COUNTED = 18             # bits of a token by which its sets are counted
MOST_MATCHES = 6         # the longest prefix asks for this many shared tokens
VERIFY = 1 / 16          # cost of comparing one token of a full set, in rows of a list
PARITY = 1024            # hash ranges of a set whose odd counts are kept as bits
DRAWS = 6                # different draws of a turn, over all tokens
TURNS = 2                # of drawing anew in crowded lists, before all pairs of different components meet
CROWD = 8                # classes outside the largest component that make a list crowded
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = _mixed(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    runs = len(h) - SHINGLE + 1
    if runs < 1:
        return _mixed((h * _ODD[:len(h)]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h
    total = sum((h[j:j + runs] * _ODD[j] for j in range(1, SHINGLE)), h[:runs] * _ODD[0])
    return np.unique(_mixed(total))


def _one_seed() -> None:
    if not os.environ.get("PYTHONHASHSEED", "").isdigit():      # Spark gives all its Python workers one seed
        raise RuntimeError("word hashes differ between Python workers: PYTHONHASHSEED is not fixed")


def token_counts(texts: DataFrame, text_col: str = "text", bits: int = COUNTED) -> np.ndarray:
    """In how many texts the tokens of each of 2^bits hash ranges stand, above the mean: an array of fixed size.

    A text that a task has just met counts once, so copies that stand together do not make their tokens common."""
    out = T.StructType([T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        _one_seed()
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in set(batch.column(0).to_pylist()):
                found = (shingle_set(text) >> np.uint64(64 - bits)).astype(np.int64)
                if len(found) > len(total) >> 4:
                    total += np.bincount(found, minlength=len(total))
                else:
                    np.add.at(total, found, 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], schema=arrow)

    table = texts.select(text_col).mapInArrow(run, out).groupBy("at").agg(F.sum("n").alias("n")).toArrow()      # at most 2^bits rows
    counts = np.zeros(1 << bits, np.int64)
    counts[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return np.maximum(counts - int(counts.mean()), 0)


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int, most: int = MOST_MATCHES) -> tuple[int, np.ndarray]:
    """(m, the m-fold prefix) of a set: m by the least estimated cost, the prefix from the rarest token on."""
    n = len(tokens)
    others = counts[(tokens >> np.uint64(64 - (len(counts).bit_length() - 1))).astype(np.int64)]
    order = np.lexsort((tokens, others))
    overlap = -(-n * percent // 100)
    longest = n - overlap + min(most, overlap)
    rows = np.cumsum(others[order[:longest]] + 1)[n - overlap:]            # list rows read with m = 1, 2, ...
    m = np.arange(1, len(rows) + 1)
    best = int(np.argmin(rows + rows / m * n * VERIFY))
    return best + 1, tokens[order[:n - overlap + best + 1]]


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether each hash range holds an odd number of tokens, as bits of 64-bit words."""
    return np.packbits((np.bincount((tokens & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def may_link(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """Whether sets of these sizes and parities can be alike: alike sets differ in at most a share of their tokens."""
    differ = sum((F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(1, PARITY // 64)), F.bit_count(bits_a[0].bitwiseXOR(bits_b[0])))
    return (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent) & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))


def prefixes(docs: DataFrame, counts: np.ndarray, percent: int = PERCENT, most: int = MOST_MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha of the text, n_shingles, set digest, matches, parity bits, prefix) of every row."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("sha", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
                        T.StructField("digest", T.BinaryType()), T.StructField("matches", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        _one_seed()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                made = []
                for value in part.column(1):
                    text = value.as_py()
                    tokens = shingle_set(text)
                    m, first = prefix(tokens, counts, percent, most) if len(tokens) else (0, tokens)
                    made.append((hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest(), len(tokens), hashlib.sha256(tokens.tobytes()).digest(), m, parities(tokens), first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *(pa.array(list(x), f.type) for x, f in zip(zip(*made), list(arrow)[1:]))], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def full_sets(texts: DataFrame) -> DataFrame:
    """(node, tokens) of (node, text) rows; of rows that repeat a node a task makes one."""
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        _one_seed()
        seen: set = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            batch = batch.take(pa.array(sorted({n: i for i, n in enumerate(nodes) if n not in seen}.values()), pa.int64()))
            seen.update(nodes)
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py()).view(np.int64) for t in part.column(1)], arrow.field(1).type)], schema=arrow)

    return texts.select("node", "text").mapInArrow(run, out)


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * intersection >= percent * union."""
    one, other = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"of_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(one, "a").join(other, "b")
    common, sizes = F.size(F.array_intersect("of_a", "of_b")).cast("long"), F.size("of_a") + F.size("of_b")
    return both.withColumn("common", common).where(F.col("common") * 100 >= (sizes - F.col("common")) * percent).select("a", "b")


def _drawn(token: str, turn: int) -> Column:
    """A mask by which the classes of a token's list are ordered: anew for each of a few values of the token, and each turn."""
    return F.xxhash64(F.pmod(F.col(token), F.lit(DRAWS)), F.lit(turn)).bitwiseAND(F.lit((1 << 62) - 1))


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b, shared) pairs that share as many prefix tokens as the shorter of their prefixes asks for, and may be a link."""
    one, other = (classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("matches").alias(f"m_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b").where(F.col("shared") >= F.least("m_a", "m_b"))
    return both.where(may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent)).select("a", "b", "shared")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full texts are alike; only texts of the pairs are cut into sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    sets = settle(full_sets(nodes.join(texts, F.col("of") == F.col("node")).select("node", "text")))
    return settle(alike(pairs, sets, percent))


def _with_roots(lists: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Rows of the lists that hold several components: token, node, root, whether the root is a ``minor`` one (not the list's
    largest), and ``minors``, how many such rows the list has. Of equally large components a draw of the token and the turn decides."""
    placed = lists.join(roots, "node", "left").select("token", "node", F.coalesce("component", "node").alias("root"))
    held = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(
        F.max(F.struct("k", F.col("root").bitwiseXOR(_drawn("token", turn)).alias("draw"))).alias("major"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("parts"))
    held = held.where("parts > 1").select("token", F.col("major.draw").bitwiseXOR(_drawn("token", turn)).alias("major"), (F.col("m") - F.col("major.k")).alias("minors"))
    return placed.join(held, "token").select("token", "node", "root", (F.col("root") != F.col("major")).alias("minor"), "minors")


def _met(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, shared): how many tokens' lists brought two classes together."""
    return rows.groupBy(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def link_components(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(node, component) of every class that is linked; ``classes`` has node, n, matches, bits, prefix, ``texts`` node and text."""
    sized = classes.select("node", "n", "matches", "bits")
    listed, mask = classes.select("node", F.explode("prefix").alias("token")), _drawn("token", 0)
    first = listed.groupBy("token").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = settle(listed.join(first.select("token", F.col("hub").bitwiseXOR(mask).alias("hub")), "token"))

    # each class with the class drawn from each of its lists
    done = settle(possible(_met(lists.where("node != hub"), "node", "hub"), sized, percent).select("a", "b"))
    edges = verified(done, texts, percent)
    lists = lists.select("token", "node")

    # where many stay outside the largest component of a list: a few classes of that component, drawn anew each turn
    for turn in range(1, TURNS + 1):
        roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        crowded = settle(_with_roots(lists, roots, turn).where(F.col("minors") >= CROWD))
        if crowded.isEmpty():
            break
        hubs = crowded.where("not minor").groupBy("token").agg(F.min(F.col("node").bitwiseXOR(_drawn("token", turn))).alias("hub")).select(
            "token", F.col("hub").bitwiseXOR(_drawn("token", turn)).alias("hub"))
        met = possible(_met(crowded.where("minor").join(hubs, "token"), "node", "hub"), sized, percent).select("a", "b")
        met = settle(met.join(done, ["a", "b"], "left_anti"))
        found = verified(met, texts, percent)
        done, edges = done.unionByName(met), edges.unionByName(found)
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # the lists that still hold several components: classes outside the largest one with all others there, counted whole
    rows = settle(_with_roots(lists, roots, 0).join(sized.drop("matches"), "node"))
    one, other = rows.where("minor").alias("l"), rows.alias("r")
    met = one.join(other, (F.col("l.token") == F.col("r.token")) & (F.col("l.root") != F.col("r.root")) & (~F.col("r.minor") | (F.col("l.node") < F.col("r.node")))
                   & may_link(F.col("l.n"), F.col("r.n"), F.col("l.bits"), F.col("r.bits"), percent))
    more = settle(possible(_met(met, "l.node", "r.node"), sized, percent).select("a", "b").join(done, ["a", "b"], "left_anti"))
    edges = edges.unionByName(verified(more, texts, percent))
    return components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


def join_documents(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to) of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = settle(prefixes(own, token_counts(own), percent))
    filled = rows.where("n_shingles > 0")
    classes = settle(filled.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha")).alias("rep"), F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("matches").alias("matches"),
        F.first("bits").alias("bits"), F.first("prefix").alias("prefix")).withColumn("node", F.monotonically_increasing_id()))
    reps = classes.select("node", F.col("rep.doc_id").alias("__id"), F.col("rep.sha").alias("__sha"))
    texts = reps.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == text_sha()))
    roots = link_components(classes, texts.select("node", "text"), percent)
    of_class = settle(classes.select("digest", "node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")))
    smallest = of_class.groupBy("root").agg(F.min("id").alias("component_id"))
    named = of_class.join(smallest, "root").select("digest", "component_id")
    linked = filled.select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
