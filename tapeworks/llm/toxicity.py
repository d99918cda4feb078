"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, other texts are unlabelled: some of them are toxic too, in a share
(the class prior) that the labelled rows tell. A linear classifier over the words and character n-grams of a
text is fitted by the risk estimator that corrects the unlabelled risk by that prior and never lets the
corrected part fall below zero.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import appended, remainder, written

#: The sample that is fitted: confirmed toxic texts, and unlabelled ones, at most.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 9000
BITS = 18
#: Log of the ratio, of a feature's share of the positives to that of the negatives, from which it takes part.
TELLING = 1.0
_WORD = re.compile(r"[^\W\d_]+")
#: Words that are remembered, and the length from which one isn't.
_CACHE, _LONG = 300_000, 64


def _of_word(word: str) -> list[int]:
    """Hashed features of a word: itself, and its character 3- to 5-grams with word ends marked."""
    marked = f"<{word}>"
    grams = {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for g in grams]


class Words:
    """A cache from words to what a function makes of their features."""

    def __init__(self, make):
        self.make, self.known = make, {}

    def __call__(self, text: str | None) -> list:
        if len(self.known) > _CACHE:
            self.known.clear()
        out = []
        for w in dict.fromkeys(_WORD.findall((text or "").lower())):
            v = self.known.get(w)
            if v is None:
                v = self.make(_of_word(w))
                if len(w) <= _LONG:
                    self.known[w] = v
            out.append(v)
        return out


def features_of(text: str | None, cache: Words) -> np.ndarray:
    """The distinct hashed features of a text."""
    own = cache(text)
    return np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32)


def odds(p, u, positives: int, unlabelled: int, prior: float, m):
    """Log of a feature's share of the positives over its share of the negatives, from the numbers p and u that have it.

    The unlabelled texts are positives in the share of the prior, so the negatives' share is (u - prior * p) / (1 - prior):
    a word of toxic texts alone is told at any prior. Half a standard error is added, as that difference is noisy where
    the prior is high. m: the functions to use, of numpy or of Spark for columns.
    """
    sp, su = (p + 0.5) / (positives + 1), (u + 0.5) / (unlabelled + 1)
    rest = su - prior * sp
    error = m.sqrt(su / unlabelled + prior**2 * sp / positives)
    return m.log(sp) - m.log(((rest + m.abs(rest)) / 2 + error / 2) / (1 - prior))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by hashed feature, and the bias, by the non-negative risk with the sigmoid loss (Adam).

    Only features that are more frequent among the positives take part, with weights of at least 0: a text is
    toxic for what it has, and however long the clean rest is, it doesn't outweigh that.
    """
    size = 1 << BITS
    weights = np.zeros(size, np.float32)
    if not positive or not unlabelled or not 0 < prior < 1:
        return weights, float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    count = lambda docs: np.bincount(np.concatenate(docs), minlength=size)
    cp, cu = count(positive), count(unlabelled)
    chosen = np.flatnonzero((cp >= max(3, len(positive) // 400)) & (odds(cp, cu, len(positive), len(unlabelled), prior, np) > TELLING))
    if not len(chosen):
        return weights, float(np.log(prior / (1 - prior)))
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def rows(docs):
        flat = place[np.concatenate(docs)]
        at = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        return at[flat >= 0], flat[flat >= 0], len(docs)

    P, U = rows(positive), rows(unlabelled)
    w, b = np.zeros(len(chosen)), -1.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        # The loss of margin z is s(-z); its slope by z is -s(z) s(-z).
        zp, zu = (np.bincount(a, weights=w[f], minlength=n) + b for a, f, n in (P, U))
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        gp, gu = (-prior * dp - prior * dp, du) if negative >= 0 else (prior * dp, -du)
        gw = np.bincount(P[1], weights=gp[P[0]], minlength=len(w)) + np.bincount(U[1], weights=gu[U[0]], minlength=len(w))
        g = np.append(gw + 1e-6 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(0, w - step[:-1]), b - step[-1]
    weights[chosen] = w
    return weights, float(b)


class Model:
    """Scores texts by the few features that have a weight."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.cache = Words(lambda ids: tuple(i for i in ids if i in weights))

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        found = {i for own in self.cache(text) if own for i in own}
        z = self.bias + sum(self.weights[i] for i in sorted(found))
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def _counts(batches):
    """(feature, positives, unlabelled) that have it, summed over the task."""
    import pyarrow as pa

    cache = Words(lambda ids: np.array(ids, np.int32))
    n = np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for t, p in zip(b.column("text").to_pylist(), b.column("positive").to_pylist(), strict=True):
            n[1 - p, features_of(t, cache)] += 1
    where = np.flatnonzero(n.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(n[0, where]), pa.array(n[1, where])], names=["feature", "p", "u"])


def learn(docs: DataFrame, labels: DataFrame, train, positives: int = MOST_POSITIVE, unlabelled: int = MOST_UNLABELLED) -> Model:
    """A model from at most so many confirmed toxic texts and about so many unlabelled ones.

    train: a condition on doc_id, for labels and unlabelled texts alike. The prior is the toxic share of the
    labelled rows. Null ids and texts are passed over; of rows that repeat an id the least text and the largest label
    count. Both samples are chosen by a hash of the id: the positives of the least hashes among the documents, and
    the unlabelled whose hash is a multiple of a step, which no order of tasks changes. No labels, or none toxic: a
    model that rejects nothing.
    """
    own = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = own.agg(F.avg("toxic")).first()[0] or 0.0
    texts = docs.select("doc_id", "text").where(train & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    toxic = own.where("toxic = 1").join(texts.select("doc_id"), "doc_id", "left_semi").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    every = max(1, -(-docs.select("doc_id").count() // unlabelled))
    one = lambda rows, flag: rows.groupBy("doc_id").agg(F.min("text").alias("text")).select("text", F.lit(flag).alias("positive"))
    sample = written(one(texts.join(F.broadcast(toxic), "doc_id"), 1).union(one(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), 0)), "toxic-sample")
    n = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, u = n.get(1, 0), n.get(0, 0)
    if not p or not u or prior == 1:
        return Model({}, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    counted = sample.mapInArrow(_counts, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    telling = counted.where((F.col("p") >= max(3, p // 400)) & (odds(F.col("p"), F.col("u"), p, u, prior, F) > TELLING))
    chosen = sorted(r.feature for r in telling.select("feature").collect())  # of 2 ** BITS features
    sent = docs.sparkSession.sparkContext.broadcast(set(chosen))

    def make():
        import pyarrow as pa

        cache, few = Words(lambda ids: tuple(i for i in ids if i in sent.value)), pa.list_(pa.int32())
        return lambda b: [pa.array([sorted({i for w in cache(t.as_py()) if w for i in w}) for t in b.column("text")], few)]

    got = appended(sample, make, "ids array<int>", ["text"], ["positive"]).toArrow()
    sides: tuple[list, list] = ([], [])
    for flag, ids in zip(got.column("positive").to_pylist(), got.column("ids"), strict=True):
        sides[1 - flag].append(np.asarray(ids.values, np.int32))
    weights, bias = fit(*sides, prior)
    return Model({i: float(weights[i]) for i in chosen if weights[i]}, bias)


def with_toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = 0.3, only: bool | None = None) -> DataFrame:
    """docs (text, and any columns) with score, the likelihood of label 1, and predicted (score >= threshold).

    Null and wordless texts get the score of the bias alone; equal texts score alike, repeated rows stay separate rows,
    and an empty table gives no rows. only: instead of adding columns, keep the rows with that prediction.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa

        def run(b):
            score = np.array([sent.value.score(t.as_py()) for t in b.column("text")], np.float64)
            hit = score >= threshold
            return [pa.array(hit if only else ~hit)] if only is not None else [pa.array(score), pa.array(hit.astype(np.int32))]

        return run

    if only is not None:
        return appended(docs, make, "__keep boolean", ["text"], keep, where="__keep")
    return appended(docs, make, "score double, predicted int", ["text"], keep)


def held_out(doc_id):
    """The rows whose labels aren't learnt: crc32 of the id modulo 4 is 2. A null id is not held out."""
    return F.coalesce(remainder(doc_id, 4) == 2, F.lit(False))
