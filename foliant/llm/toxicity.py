"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of the table, labelled or not, stand for unlabelled text.
Words that tell the two apart are the features of linear classifiers, which are trained in numpy by Adam on the
estimated risk

    prior * mean(loss(+s) over positives) + max(0, mean(loss(-s) over unlabelled) - prior * mean(loss(-s) over positives))

with the logistic loss; where the second part is negative, the step goes the other way and takes the overfit
back.  The prior is given, or the lesser of two estimates: the share of confirmed toxic documents among all labelled
ones, which is right where labels were given at random, and the bound that the words give (``estimated_prior``),
which holds where toxic documents were labelled by preference.  Several classifiers, each on four fifths of the
sample, are averaged.

The fit sees a sample of rows bounded by ``POSITIVES`` and ``UNLABELLED`` (those of the smallest
hashes of ``doc_id``); the prior is taken over all labels, and every document is scored on its whole text.

Results for odd inputs: a text without a word, an empty or a null one has the score 0
and is never rejected; a null label is no confirmation, several rows of one document confirm it if any does;
without a confirmed document nothing is learned: scores are 0 and nothing is rejected.  A score that equals the
threshold is rejected.  Repeated rows have equal scores, and all rows of an id that was drawn are in the sample.
An empty table gives an empty result; very long texts are scored whole.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.session import cut, small_batches, table
from foliant.llm.text import ragged, slices, words

#: Most documents of the sample that the classifiers are fitted on.
POSITIVES, UNLABELLED = 4000, 12000
#: Of words in at least so many documents of the sample, those stay whose share among the positives differs from
#: the share among the unlabelled by chance with at most this probability for any of them (two-sided, Bonferroni).
#: Rare words would let the classifiers learn single documents by heart, wrongly confirmed ones among them.
LEAST_DOCS, CHANCE = 5, 0.05
CLASSIFIERS, STEPS = 3, 1000
#: Weight of the squared weights in the loss, times the number of positives: it counts like so many of them however many there are.
DECAY = 0.009
#: A prior is at least this far from 0 and from 1, where the loss has no minimum.
LEAST_PRIOR = 1e-4
#: A document is rejected from this probability on.
THRESHOLD = 0.5

U64 = np.uint64


def features(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text, and offsets."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.searchsorted(r[new], np.arange(len(at)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _features(part: pa.Array) -> pa.Array:
    out = []
    for lo, hi in slices(part):
        found, at = features(*words(part.slice(lo, hi - lo)))
        out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.view(np.int64))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def _numbered(known: np.ndarray):
    """Arrow UDF from a text's words to the places of those in ``known``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(part: pa.Array) -> pa.Array:
        if not len(part):
            return pa.array([], pa.list_(pa.int32()))
        h = part.flatten().to_numpy(zero_copy_only=False).view(U64)
        row = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        place = np.searchsorted(known, h)
        hit = place < len(known)
        hit[hit] = known[place[hit]] == h[hit]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(part)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(place[hit].astype(np.int32)))

    return run


def telling(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """Which words are kept, by the number of positives and of unlabelled that hold them."""
    often = in_p + in_u >= LEAST_DOCS
    if not often.any():
        return often
    share = (in_p + in_u) / (n_p + n_u)
    spread = np.sqrt(np.maximum(share * (1 - share) * (1 / n_p + 1 / n_u), 1e-12))
    bound = NormalDist().inv_cdf(1 - CHANCE / 2 / int(often.sum()))
    return often & (np.abs(in_p / n_p - in_u / n_u) / spread >= bound)


def estimated_prior(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> float:
    """The share of positives among unlabelled documents, from the number of both that hold each word.

    Positives are a part of the unlabelled, so for any word the share of unlabelled documents with it is at least the
    prior times that of positives: the least ratio of the two bounds the prior, and reaches it at a word that only
    positives have.  Shares are taken at the far end of their two-sided intervals at ``CHANCE`` over all words.
    """
    bound = NormalDist().inv_cdf(1 - CHANCE / 4 / max(len(in_p), 1))
    p, u = in_p / n_p, in_u / n_u
    low = p - bound * np.sqrt(p * (1 - p) / n_p)
    high = u + bound * np.sqrt(np.maximum(u * (1 - u), 1 / n_u) / n_u)
    fine = low > 0
    return float(min(1.0, (high[fine] / low[fine]).min())) if fine.any() else 1.0


class Rows:
    """Sparse binary rows: feature numbers and offsets."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.flat, self.at = flat, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = self.at[rows + 1] - self.at[rows]
        return Rows(self.flat[ragged(self.at[rows], size)], np.concatenate([[0], np.cumsum(size)]))

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.flat])])
        return total[self.at[1:]] - total[self.at[:-1]] + b

    def back(self, slope: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(slope, np.diff(self.at)), n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk_slopes(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Slopes of the non-negative risk by the scores of positives and unlabelled, and the risk."""
    loss = lambda x: np.logaddexp(0, -x)
    negative = loss(-su).mean() - prior * loss(-sp).mean()
    up = -_sigmoid(-sp) * prior / len(sp)
    rest_p, rest_u = -prior * _sigmoid(sp) / len(sp), _sigmoid(su) / len(su)
    if negative < 0:
        return -rest_p, -rest_u, prior * loss(sp).mean()
    return up + rest_p, rest_u, prior * loss(sp).mean() + negative


def fit(positive: Rows, unlabelled: Rows, prior: float, n: int, seed: int = 0, steps: int = STEPS, rate: float = 0.05, decay: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of one classifier over ``n`` features."""
    rng = np.random.default_rng(seed)
    decay = DECAY / len(positive) if decay is None else decay
    p, u = (rows.take(rng.permutation(len(rows))[: -(-len(rows) * 4 // 5)]) for rows in (positive, unlabelled))
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    average = np.zeros(n + 1)
    for step in range(1, steps + 1):
        by_p, by_u, _ = risk_slopes(p.scores(w[:n], w[n]), u.scores(w[:n], w[n]), prior)
        g = np.append(p.back(by_p, n) + u.back(by_u, n) + decay * w[:n], by_p.sum() + by_u.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if step > steps // 2:
            average += w
    average /= steps - steps // 2
    return average[:n], float(average[n])


class Model:
    """Averaged weights by word; an untrained one scores 0 and rejects nothing."""

    def __init__(self, known: np.ndarray | None, weights: np.ndarray | None = None, intercept: float = 0.0):
        self.known, self.weights, self.intercept = known, weights, intercept
        self.likely = np.zeros(1 << 20, bool)
        if known is not None:
            self.likely[known >> U64(44)] = True

    def probabilities(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.known is None:
            return np.zeros(len(at) - 1)
        some = np.flatnonzero(self.likely[hashes >> U64(44)])
        place = np.searchsorted(self.known, hashes[some])
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == hashes[some[hit]]
        k = max(1, len(self.known))
        both = np.unique((np.searchsorted(at, some[hit], "right") - 1) * k + place[hit])
        return _sigmoid(self.intercept + np.bincount(both // k, self.weights[both % k], len(at) - 1))


def _drawn(ids: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """The ``most`` different ids of ``n`` rows with the smallest hashes; only about twice as many are sorted."""
    scale = 1 << 40
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(scale))
    share = min(1.0, (2 * most + 1000) / max(n, 1))
    return ids.where(place < F.lit(int(share * scale))).distinct().orderBy(place, "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits the classifiers; ``prior`` None takes the lesser of the share among all labels and the words' bound."""
    by_doc = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.coalesce(F.max(F.col(toxic).cast("int")), F.lit(0)).alias("yes"))
    by_doc = cut(by_doc)
    n, yes = by_doc.agg(F.count("*"), F.coalesce(F.sum("yes"), F.lit(0))).head()
    if not yes:
        return Model(None)
    pool = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"))
    p = _drawn(by_doc.where("yes = 1").select("id"), yes, positives, 0).withColumn("p", F.lit(True))
    u = _drawn(pool, pool.count(), unlabelled, 1).withColumn("p", F.lit(False))
    sample = p.unionByName(u).groupBy("id").agg(F.bool_or("p").alias("p"), F.bool_or(~F.col("p")).alias("u"))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = cut(own.join(F.broadcast(sample), "id").select("p", "u", _features("text").alias("f")))
    n_p, n_u = rows.agg(F.count_if("p"), F.count_if("u")).head()
    if not n_p or not n_u:
        return Model(None)
    often = rows.select("p", "u", F.explode("f").alias("w")).groupBy("w").agg(F.count_if("p").alias("in_p"), F.count_if("u").alias("in_u")).where(F.col("in_p") + F.col("in_u") >= LEAST_DOCS).toArrow()
    w, in_p, in_u = (often[c].to_numpy() for c in ("w", "in_p", "in_u"))
    if prior is None:
        prior = min(yes / n, estimated_prior(in_p, n_p, in_u, n_u))
    prior = min(max(prior, LEAST_PRIOR), 1 - LEAST_PRIOR)
    known = np.sort(w[telling(in_p, n_p, in_u, n_u)].view(U64))
    found = rows.select("p", "u", _numbered(known)("f").alias("f")).toArrow()
    lists = found["f"].combine_chunks()
    every = Rows(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]))
    p, u = (every.take(np.flatnonzero(found[c].to_numpy(zero_copy_only=False))) for c in "pu")
    k = len(known)
    fitted = [fit(p, u, prior, k, seed) for seed in range(CLASSIFIERS)]
    return Model(known, np.mean([w for w, _ in fitted], axis=0), float(np.mean([b for _, b in fitted])))


def toxicity(text: Column, model: Model, spark: SparkSession) -> Column:
    """Probability that a text is toxic; 0 for one without a word."""
    shared = spark.sparkContext.broadcast(model)
    small_batches()

    @F.arrow_udf(T.DoubleType())
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = shared.value
        for part in parts:
            out = [np.zeros(0)]
            for lo, hi in slices(part):
                hashes, at = words(part.slice(lo, hi - lo))
                out.append(np.where(np.diff(at) > 0, by.probabilities(hashes, at), 0.0))
            yield pa.array(np.concatenate(out))

    return run(text)


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row of ``docs``."""
    return docs.select(doc_id, toxicity(F.col(text), model, docs.sparkSession).alias("score"))


def rejected(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score`` of every row whose score reaches the threshold."""
    return scores(docs, model, doc_id, text).where(F.col("score") >= threshold)


def filtered(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay as they are."""
    return docs.where(toxicity(F.col(text), model, docs.sparkSession) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rejected(docs, train(docs, table(spark, sf_dir, "labels")))
