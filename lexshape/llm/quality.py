"""Quality by hierarchical empirical Bayes: evidence of the document, its host and its path.

A logistic model over character-class transitions gives each document a probability of
being good. Hosts and paths are groups of documents: sums of these probabilities over
all documents give each group a mean, and a beta prior, whose strength follows from how
much the groups really differ (method of moments), draws sparse groups to the level
above: paths to their host, hosts to all documents. A document's posterior adds its own
log-likelihood ratio to the log-odds of its path, from which its own share is left out.
Documents below the threshold are rejected.

The model is fitted on at most ``SAMPLE`` labelled rows (a hash of the id decides, a
documented bound); sums and priors cover all documents. Hosts are summed before the
shuffle, and a host with a third of all rows is split by the join.

Defined cases: a null or empty text has no evidence of its own (log-likelihood ratio 0).
Null hosts and paths form groups of their own. Labels that are null do not count, equal
labels of one document count once, and of rows that repeat a labelled id one (the
smallest features) is learned from, so that the fitted rows stay bounded; without labels of both kinds every document
is accepted. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexshape.llm.rows import add_columns
from lexshape.session import settle

SAMPLE = 20_000
THRESHOLD = 0.5
EVIDENCE = 30.0             # largest log-likelihood ratio of a text

# classes of bytes: lower, upper, digit, blank, line end, sentence mark, other ASCII, beyond ASCII
_CLASSES = 8
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
_CLASS[list(b" \t")], _CLASS[list(b"\n\r")], _CLASS[list(b".,;:'-")], _CLASS[128:] = 3, 4, 5, 7


def features(text: str) -> np.ndarray:
    """Shares of the 64 transitions between classes of neighbouring bytes, of distinct words, of distinct lines, and the log length."""
    body = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _CLASS[body]
    pairs = np.bincount(kinds[:-1] * np.uint8(_CLASSES) + kinds[1:], minlength=_CLASSES * _CLASSES) / max(1, len(kinds) - 1)
    words, lines = text.split(), text.split("\n")
    return np.concatenate([np.sqrt(pairs), [len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), math.log1p(len(body))]])


@dataclass
class Model:
    """Log-likelihood ratio of good to bad; ``rate`` is the share of good documents it was fitted on."""
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float

    def evidence(self, text: str) -> float:
        if not text or not len(self.weights):
            return 0.0
        z = float(((features(text) - self.centre) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return max(-EVIDENCE, min(EVIDENCE, z - math.log(self.rate / (1 - self.rate))))


def fit_model(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Ridge logistic regression by Newton steps. Without both kinds of labels: no evidence, all good."""
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.999)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -EVIDENCE, EVIDENCE)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(centre, scale, w, float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality") -> Model:
    """The model of at most about ``sample`` labelled documents."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label_col).cast("double").alias("__y"))
    known = settle(known.distinct())
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))    # about `sample` ids
    made = add_columns(rows, "text", T.StructType([T.StructField("__x", T.ArrayType(T.DoubleType()))]),
                       lambda texts: [[features(t) for t in texts]]).groupBy("__id", "__y").agg(F.min("__x").alias("__x")).toArrow()
    if not made.num_rows:
        return fit_model(np.zeros((0, 1)), np.zeros(0))
    x = made.column("__x").combine_chunks().flatten().to_numpy().reshape(made.num_rows, -1)
    return fit_model(x, made.column("__y").to_numpy())


def with_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__llr``, each text's log-likelihood ratio, and ``__p``, its probability at the fitted rate."""
    added = T.StructType([T.StructField("__llr", T.DoubleType())])
    rows = add_columns(docs, "text", added, lambda texts: [[model.evidence(t) for t in texts]])
    return rows.withColumn("__p", 1 / (1 + F.exp(-(F.col("__llr") + math.log(model.rate / (1 - model.rate))))))


def _strength(groups: DataFrame, mean: Column | float) -> float:
    """How many documents the prior over groups is worth: moments of the group means around ``mean``.

    With m the mean, groups' means vary by m(1 - m) / (k + 1) between groups plus their own sampling variance over n."""
    far = F.col("s") / F.col("n") - mean
    row = groups.agg(F.sum("n"), F.sum("s"), F.sum("ss"), F.sum(F.col("n") * far * far), F.count("*"), F.sum(F.col("n") * F.col("n"))).first()
    n, s, ss, spread, count, squares = row
    if not n or count < 2 or n == count:
        return 1.0
    m = s / n
    within = max(1e-9, (ss / n - m * m - spread / n)) * n / (n - count)            # variance of documents inside groups
    between = max(1e-9, (spread - (count - 1) * within) / (n - squares / n))
    return min(1e6, max(1.0, m * (1 - m) / between))


def site_table(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, tuple[float, float, float]]:
    """Sums per path with its host's sums, the mean of all, and the two prior strengths, over all documents."""
    n, s, ss = F.count("*").cast("double").alias("n"), F.sum("__p").alias("s"), F.sum(F.col("__p") * F.col("__p")).alias("ss")
    paths = settle(scored.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(n, s, ss))
    hosts = settle(paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0] or 0.5
    k_host = _strength(hosts, total)
    both = settle(paths.select(F.col("__host").alias("__h"), "__path", F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("ss").alias("__ss"))
                  .join(hosts.select("__host", F.col("n").alias("__hn"), F.col("s").alias("__hs")), F.col("__h").eqNullSafe(F.col("__host"))).drop("__h"))
    k_path = _strength(both.select(F.col("__n").alias("n"), F.col("__s").alias("s"), F.col("__ss").alias("ss"), (F.col("__hs") / F.col("__hn")).alias("mean")), F.col("mean"))
    return both, (total, k_host, k_path)


def judged(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``__llr``, ``__host_posterior``, ``__path_posterior``, ``__posterior`` and ``__accepted``.

    Texts are scored in both passes rather than written once more (which of the two costs less was not measured)."""
    sums = with_evidence(docs.select(host, path, "text"), model).select(host, path, "__p")
    return _posteriors(with_evidence(docs, model), site_table(sums, host, path), host, path, threshold)


def _posteriors(scored: DataFrame, sites: tuple, host: str, path: str, threshold: float) -> DataFrame:
    sites, (total, k_host, k_path) = sites
    p = F.col("__p")
    host_mean = (k_host * F.lit(total) + F.col("__hs") - p) / (k_host + F.col("__hn") - 1)     # without the document itself
    path_mean = (k_path * F.col("__host_posterior") + F.col("__s") - p) / (k_path + F.col("__n") - 1)
    odds = F.col("__llr") + F.log(F.col("__path_posterior") / (1 - F.col("__path_posterior")))
    near = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    return (scored.join(sites, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")))
            .withColumn("__host_posterior", near(host_mean)).withColumn("__path_posterior", near(path_mean))
            .withColumn("__posterior", 1 / (1 + F.exp(-odds))).withColumn("__accepted", F.col("__posterior") >= threshold))


def quality_decisions(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, evidence, host_posterior, path_posterior, posterior, accepted."""
    scored = settle(with_evidence(docs.select("doc_id", host, path, "text"), train(docs, labels, sample)).drop("text"))
    rows = _posteriors(scored, site_table(scored.select(host, path, "__p"), host, path), host, path, threshold)
    return rows.select("doc_id", F.col("__llr").alias("evidence"), F.col("__host_posterior").alias("host_posterior"),
                       F.col("__path_posterior").alias("path_posterior"), F.col("__posterior").alias("posterior"), F.col("__accepted").alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that are rejected, all columns as they were."""
    return judged(docs, train(docs, labels, sample), host, path, threshold).where("__accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
