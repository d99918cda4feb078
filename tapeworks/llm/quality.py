"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and the shapes of its tokens (case, digits, symbols, repeats). TF-IDF vectors of
a bounded sample of labelled texts give a latent-semantic projection by truncated SVD; the labelled vectors are
broadcast, the cosines of every document with all of them are computed in blocks, exactly, and the labels of the
nearest are weighted by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import appended, remainder

#: Labelled texts that are fitted and broadcast, at most: of each label in proportion, but a quarter at least where there are so many.
MOST_LABELLED = 4000
SHAPES, WORDS = 1024, 3072
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 4
#: Tokens that are remembered, and the length from which one isn't.
_CACHE, _LONG = 300_000, 64
_RUNS = re.compile(r"(.)\1+", re.S)
_CLASSES = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "x"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X"), **dict.fromkeys("0123456789", "9")})


def _shape(token: str) -> str:
    """Classes of characters without runs: x lower case, X upper case, 9 digits, others as they are."""
    t = token.translate(_CLASSES)
    if not t.isascii():
        t = "".join(c if c < "\x80" else "X" if c.isupper() else "x" if c.isalpha() else c for c in t)
    return _RUNS.sub(r"\1", t)


class Terms:
    """Turns texts into (term ids, weights without idf)."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _of(self, token: str) -> tuple[int, int]:
        crc = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))
        return crc("s" + _shape(token)) % SHAPES, SHAPES + crc("w" + token.lower().strip(".,;:!?\"'()")) % WORDS

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if len(self.known) > _CACHE:
            self.known.clear()
        at = Counter(tokens)
        ids, n = [], []
        for token, k in at.items():
            pair = self.known.get(token)
            if pair is None:
                pair = self._of(token)
                if len(token) <= _LONG:
                    self.known[token] = pair
            ids += pair
            n += (k, k)
        again = sum(a == b for a, b in pairwise(tokens))
        ids.append(zlib.crc32(b"repeat") % SHAPES)
        n.append(again)
        tf = np.bincount(ids, weights=n, minlength=SHAPES + WORDS)
        where = np.flatnonzero(tf)
        return where.astype(np.int32), np.sqrt(tf[where] / len(tokens)).astype(np.float32)


class Space:
    """idf, projection, and the labelled vectors with their labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS):
        n, width = len(rows), SHAPES + WORDS
        df = np.bincount(np.concatenate([i for i, _ in rows] or [np.zeros(0, int)]).astype(int), minlength=width)
        self.idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
        self.idf[df == 0] = 0
        x = np.zeros((n, width), np.float32)
        for k, (ids, w) in enumerate(rows):
            x[k, ids] = w * self.idf[ids]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        k = min(dimensions, max(1, n))
        q = np.random.default_rng(7).standard_normal((width, k + 8)).astype(np.float32)
        for _ in range(3):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.projection = (q @ vt.T)[:, :k].astype(np.float32)
        self.vectors, self.labels = self._unit(x @ self.projection), labels.astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vector(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.projection.shape[1]), np.float32)
        for k, (ids, w) in enumerate(rows):
            if len(ids):
                out[k] = (w * self.idf[ids]) @ self.projection[ids]
        return self._unit(out)

    def vote(self, v: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; the mean label for a zero vector."""
        base = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(v), base)
        if not len(self.labels):
            return out
        k = min(neighbours, len(self.labels))
        for a in range(0, len(v), 512):
            cos = v[a : a + 512] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
            w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** SHARPNESS
            total = w.sum(axis=1)
            out[a : a + 512] = np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), base)
        return np.clip(out, 0, 1)


def shares(n: dict[int, int], most: int) -> dict[int, int]:
    """How many of each label are taken, of n that there are: all if they fit, else in proportion but a quarter of most at least."""
    total = sum(n.values())
    if total <= most:
        return dict(n)
    out = {label: min(k, max(most * k // total, most // 4)) for label, k in n.items()}
    largest = max(n, key=lambda label: n[label])
    out[largest] = most - sum(k for label, k in out.items() if label != largest)
    return out


def learn(docs: DataFrame, labels: DataFrame, train, most: int = MOST_LABELLED) -> Space:
    """The space of at most so many labelled texts, of each label those with the least hashes of their ids.

    train: a condition on doc_id. Null ids and null labels are passed over; of rows that repeat an id the least
    text and the largest label count. Only labels of texts that are there count. The sample's bound is what makes its
    broadcast and collection safe.
    """
    there = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    own = labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__label")).join(there.select("doc_id"), "doc_id", "left_semi")
    n = {r["__label"]: r["n"] for r in own.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}  # 0 and 1
    parts = [own.where(F.col("__label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for label, k in shares(n, most).items()]
    chosen = reduce(DataFrame.union, parts) if parts else own.limit(0)
    texts = there.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))

    def make():
        import pyarrow as pa

        terms = Terms()

        def run(b):
            rows = [terms(t.as_py()) for t in b.column("text")]
            return [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))]

        return run

    got = appended(texts, make, "ids array<int>, weights array<float>", ["text"], ["doc_id", "__label"]).orderBy("doc_id").toArrow()
    pull = lambda c, kind: [np.asarray(x.values, kind) for x in got.column(c)]
    return Space(list(zip(pull("ids", np.int32), pull("weights", np.float32), strict=True)), np.asarray(got.column("__label").to_pylist(), np.float32))


def with_quality(docs: DataFrame, space: Space, keep: list[str] | None = None, threshold: float = 0.3, only: bool | None = None) -> DataFrame:
    """docs (text, and any columns) with score, the likelihood of label 1, and predicted (score >= threshold).

    Null and blank texts have a zero vector and get the labelled texts' mean; equal texts score alike (of equal cosines
    any neighbours vote), repeated rows stay separate rows, and an empty table gives no rows. only: instead of adding
    columns, keep the rows with that prediction.
    """
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def make():
        import pyarrow as pa

        terms, own = Terms(), sent.value

        def run(b):
            score = own.vote(own.vector([terms(t.as_py()) for t in b.column("text")]))
            hit = score >= threshold
            return [pa.array(hit if only else ~hit)] if only is not None else [pa.array(score), pa.array(hit.astype(np.int32))]

        return run

    if only is not None:
        return appended(docs, make, "__keep boolean", ["text"], keep, where="__keep")
    return appended(docs, make, "score double, predicted int", ["text"], keep)


def held_out(doc_id):
    """The rows whose labels aren't learnt: crc32 of the id modulo 5 is 0. A null id is not held out."""
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))
