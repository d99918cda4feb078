"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles, weighted by TF-IDF. Its samples fall in bands; texts that
share a band are candidates, candidates are verified by weighted Jaccard similarity, and verified links are
joined to classes. Equal word sequences are one unit from the start.

The inverse document frequency of a shingle is ln(1 + N / f), f being the number of the N texts that hold it, and
one in a thousand of N at least. All texts are counted: first in a table of counters, whose every counter is an
upper bound for its shingles, then the shingles of the heavy counters one by one, exactly. So what is broadcast has
a bound that depends on the texts' mean length, not on their number.

In a band's bucket that many units share, each is first compared to a few centres, then what is still apart to other
centres. That only saves work: at last all pairs of units of such buckets that are in different components and can
reach the threshold are found exactly, by the prefixes of their rarest shingles, so no bucket is cut short.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import appended, discard, words, written

SHINGLE, THRESHOLD = 5, 0.8
#: Bands and samples in each: a pair at the threshold shares a band with probability 1 - (1 - 0.8 ** 3) ** 15 > 0.9999.
BANDS, ROWS = 15, 3
#: Counters by which the heavy shingles are found; a slice of them travels as one row.
TABLE_BITS, SLICE_BITS = 21, 12
#: From this share of all texts on, a shingle's document frequency tells; rarer ones weigh as much as one at it.
COMMON = 1 / 1000
#: Units of a bucket that are all compared with each other; larger buckets go by centres.
SMALL = 6
#: Rounds of comparisons with centres before the exact step.
ROUNDS = 1
#: Counters by which the shingles of units still apart are ordered (they decide the cost, not the result).
FINE_BITS = 22
#: For sums of floats in other orders.
SLACK = 1e-9
_MASK = (1 << 64) - 1
_CHUNK = 512


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, the same on every machine."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


def shingles(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's shingles and their counts; a shorter text is one shingle."""
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws)) + np.uint64(1)
    n = max(1, len(c) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        h = c[:n] * _POWERS[0]
        for k in range(1, min(SHINGLE, len(c))):
            h += c[k : k + n] * _POWERS[k]
        return np.unique(_mix(h), return_counts=True)


class Weights:
    """TF-IDF weights: the common shingles' sorted hashes with their document frequencies, all of them at least floor."""

    def __init__(self, n: int, floor: float, common: np.ndarray, frequency: np.ndarray):
        self.rare = float(np.log1p(n / max(floor, 1.0)))
        self.common, self.idf = common, np.log1p(n / np.maximum(frequency, 1))

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return tf * self.rare
        at = np.searchsorted(self.common, h)
        at[at == len(self.common)] = 0
        return tf * np.where(self.common[at] == h, self.idf[at], self.rare)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, weights); 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    where = np.searchsorted(b[0], a[0])
    where[where == len(b[0])] = 0
    both = b[0][where] == a[0]
    common = np.minimum(a[1][both], b[1][where[both]]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


class Sampler:
    """Improved consistent weighted samples: for each of k hashes, the element and step with the least value.

    r and c are Gamma(2, 1) and beta uniform, drawn once into tables of 65536 that an element's hash indexes.
    """

    def __init__(self, k: int = BANDS * ROWS, plain: float | None = None):
        """plain: the weight that most elements have; what follows from it is tabulated too, with the same results."""
        g = np.random.default_rng(20240101)
        size = 1 << 16
        self.r = g.gamma(2.0, 1.0, size).astype(np.float32)
        self.inverse = 1 / self.r
        self.beta = g.random(size).astype(np.float32)
        # log a = log c - r (t - beta + 1), and what of that doesn't depend on the weight
        self.fixed = (np.log(g.gamma(2.0, 1.0, size)) - self.r * (1 - self.beta)).astype(np.float32)
        self.mult = g.integers(1, 1 << 62, k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.k, self.plain = k, plain
        if plain is not None:
            self.plain_t = np.floor(self.inverse * np.float32(np.log(plain)) + self.beta)
            self.plain_value = self.fixed - self.r * self.plain_t

    def __call__(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        best, out = np.full(self.k, np.inf, np.float32), np.zeros(self.k, np.uint64)
        usual = w == self.plain if self.plain is not None else np.zeros(len(w), bool)
        for part in np.split(h[usual], range(_CHUNK, int(usual.sum()), _CHUNK)):
            if len(part):
                at = self._places(part)
                self._better(best, out, part, at, self.plain_value.take(at, mode="wrap"), None)
        rest, log_w = h[~usual], np.log(w[~usual]).astype(np.float32)
        for a in range(0, len(rest), _CHUNK):
            part = rest[a : a + _CHUNK]
            at = self._places(part)
            t = self.inverse.take(at, mode="wrap")
            t *= log_w[a : a + _CHUNK]
            t += self.beta.take(at, mode="wrap")
            np.floor(t, out=t)
            value = self.fixed.take(at, mode="wrap")
            value -= self.r.take(at, mode="wrap") * t
            self._better(best, out, part, at, value, t)
        return out

    def _places(self, part: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((part[None, :] * self.mult[:, None]) >> np.uint64(48)).view(np.int64)

    def _better(self, best: np.ndarray, out: np.ndarray, part: np.ndarray, at: np.ndarray, value: np.ndarray, t: np.ndarray | None) -> None:
        """Takes the least values of a part, with their elements and steps, where they are below the best so far."""
        rows, least = np.arange(self.k), value.argmin(axis=1)
        found = value[rows, least]
        step = t[rows, least] if t is not None else self.plain_t[at[rows, least]]
        with np.errstate(over="ignore"):
            key = _mix(part[least] + step.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        better = found < best
        best[better], out[better] = found[better], key[better]

    def bands(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = self(h, w).reshape(BANDS, ROWS)
        with np.errstate(over="ignore"):
            x = np.arange(1, BANDS + 1).astype(np.uint64)
            for j in range(ROWS):
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
        return x.view(np.int64)


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's number of texts (slice -1) and its counters; every text adds 1 for each of its different shingles."""
    n, table = 0, np.zeros(1 << TABLE_BITS, np.int64)
    for b in batches:
        for t in b.column("text"):
            h, _ = shingles(words(t.as_py()))
            n += 1
            np.add.at(table, (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), 1)
    yield from _slices(n, {k: x for k, x in enumerate(table.reshape(-1, 1 << SLICE_BITS)) if x.any()})


def _slices(n: int, parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = [(-1, np.array([n], np.int64)), *parts.items()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in rows], pa.binary())], names=["slice", "counts"])


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(x), np.int64)
            parts[k] = parts[k] + own if k in parts else own
    n = parts.pop(-1, np.zeros(1, np.int64))
    if parts or n[0]:
        yield from _slices(int(n[0]), parts)


def _summed_slices(first: DataFrame) -> DataFrame:
    """Slices of counters added up in two levels, so that no task adds those of all tasks."""
    kind = "slice int, counts binary"
    level = first.repartition("slice", F.pmod(F.spark_partition_id(), F.lit(8))).mapInArrow(_add_slices, kind)
    return level.repartition("slice").mapInArrow(_add_slices, kind)


def frequencies(docs: DataFrame, share: float = COMMON) -> Weights:
    """Weights by the document frequencies of the shingles of all texts.

    The floor is share of the texts, or four times a counter's mean load, which is more only where texts have
    thousands of words each. So at most a quarter as many shingles as there are counters are common.
    """
    table, n = np.zeros(1 << TABLE_BITS, np.int64), 0
    for row in _summed_slices(docs.select("text").mapInArrow(_count_shingles, "slice int, counts binary")).collect():  # one row for each slice
        own = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        if row["slice"] < 0:
            n += int(own[0])
        else:
            table[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] += own
    floor = max(share * n, 4 * table.sum() / len(table))
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(table >= floor))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, held, size = np.unpackbits(sent.value).view(bool), [], 0

        def summed():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "n"])

        for b in batches:
            for t in b.column("text"):
                h, _ = shingles(words(t.as_py()))
                held.append(h[heavy[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]])
                size += len(held[-1])
                if size > 1 << 20:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    exact = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= float(floor)).toArrow()
    h, f = exact.column("h").to_numpy().view(np.uint64), exact.column("n").to_numpy()
    order = np.argsort(h)
    return Weights(n, float(floor), h[order], f[order])


def sketched(docs: DataFrame, weights: Weights, keep: list[str]) -> DataFrame:
    """The kept columns with __row (unique), __unit (equal for equal word sequences) and __bands.

    A null text is a unit of its own; a text without words is one with its exact copies, and has no bands.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        from pyspark import TaskContext

        own, at = sent.value, TaskContext.get().partitionId() << 40
        sampler = Sampler(plain=own.rare)

        def run(b):
            nonlocal at
            units, bands, first = [], [], at
            for t in b.column("text"):
                text = t.as_py()
                ws = words(text)
                if ws:
                    units.append(hashlib.md5(b" ".join(ws)).digest())
                    h, tf = shingles(ws)
                    bands.append(sampler.bands(h, own(h, tf)))
                else:
                    units.append(b"row" + at.to_bytes(8, "big") if text is None else b"raw" + hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                    bands.append(None)
                at += 1
            return [pa.array(np.arange(first, at)), pa.array(units, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

        return run

    return appended(docs, make, "__row long, __unit binary, __bands array<bigint>", ["text"], keep)


def _verified(candidates: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' weighted Jaccard similarity is at least threshold."""
    sent = candidates.sparkSession.sparkContext.broadcast(weights)
    # Merge joins at every size: whether one side could be broadcast would change from size to size.
    pairs = candidates.hint("merge").join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b").hint("merge").join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, held = sent.value, None, None

        def vector(text: str):
            h, tf = shingles(words(text))
            return h, own(h, tf)

        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, held = a, vector(ta.as_py())
                keep.append(similarity(held, vector(tb.as_py())) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(row, component) for each end of links (a, b); component is the least row that it reaches.

    Large-star and small-star steps in turn until all are stars; a step only takes minima by key, which
    are partly aggregated before they are dealt. Each step is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "links")
        discard(before)
        # Stars: whoever has a parent has one, and is nobody's parent.
        ends = edges.select(F.col("u").alias("row"), F.lit(1).alias("parents"), F.lit(0).alias("children")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("row").agg(F.sum("parents").alias("p"), F.max("children").alias("c")).where("p > 1 OR p = 1 AND c = 1").isEmpty():
            break
    return edges.select(F.col("u").alias("row"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("row"), F.col("v").alias("component")).distinct())


def _first_candidates(members: DataFrame) -> DataFrame:
    """Pairs (centre, other): all of a small bucket; else each unit with its buckets' most shared and one other centre."""
    small = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("rows").distinct()
    pairs = small.select(F.explode(F.flatten(F.transform("rows", lambda x: F.transform(F.filter("rows", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = members.where(F.col("n") > SMALL)
    centres = large.groupBy("bucket").agg(F.max_by("row", F.struct("shared", "row")).alias("first"), F.max_by("row", F.xxhash64("row", "bucket")).alias("second"))
    stars = large.join(centres, "bucket").select(F.explode(F.array("first", "second")).alias("a"), F.col("row").alias("b"))
    return pairs.union(stars).where("a <> b").distinct()


def _later_candidates(large: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """For buckets whose units are in several components: those outside the largest, each with a new centre of
    the largest and with a centre among themselves."""
    m = large.join(labels, "row", "left").withColumn("component", F.coalesce("component", "row"))
    per = m.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.max_by("row", F.xxhash64("row", "bucket", F.lit(turn))).alias("centre"), F.max_by("row", F.struct("shared", F.xxhash64("row", F.lit(turn)))).alias("known"))
    main = per.groupBy("bucket").agg(F.max_by(F.struct("component", "centre"), F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("bucket", F.col("main.component").alias("main"), "main.centre")
    rest = m.join(main, "bucket").where("component <> main")
    among = rest.groupBy("bucket").agg(F.max_by(F.struct("row", "component"), F.struct("shared", F.xxhash64("row", F.lit(turn)))).alias("x"))
    return rest.select(F.col("centre").alias("a"), F.col("row").alias("b")).union(rest.join(among, "bucket").where("component <> x.component").select(F.col("x.row"), "row")).where("a <> b").distinct()


def _count_finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << FINE_BITS, np.int64)
    for b in batches:
        for t in b.column("text"):
            table[(shingles(words(t.as_py()))[0] >> np.uint64(64 - FINE_BITS)).astype(np.int64)] += 1
    yield from _slices(0, {k: x for k, x in enumerate(table.reshape(-1, 1 << SLICE_BITS)) if x.any()})


def ranks(texts: DataFrame) -> np.ndarray:
    """Ranks of shingles by how many of the texts have them, by logarithm in a byte each; rare ones come first."""
    counted = texts.select("text").mapInArrow(_count_finely, "slice int, counts binary")
    out = np.zeros(1 << FINE_BITS, np.uint8)
    for row in _summed_slices(counted).where("slice >= 0").collect():
        own = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        out[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] = np.minimum(255, 8 * np.log2(1 + own))
    return out


def prefix(h: np.ndarray, w: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """A text's first shingles in the order of rank, each with the weight from it on, and the whole weight.

    The overlap with any text at the threshold is at least threshold times the whole weight, so what comes after
    the prefix can't hold all of it, and the first shingle that both texts have is in both prefixes.
    """
    order = np.lexsort((h, rank[(h >> np.uint64(64 - FINE_BITS)).astype(np.int64)]))
    rest = np.cumsum(w[order][::-1])[::-1]
    n = int((rest >= threshold * rest[0] * (1 - SLACK)).sum())
    return h[order][:n].view(np.int64), rest[:n], float(rest[0])


def _last_candidates(large: DataFrame, labels: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Every pair that can reach the threshold among the units of large buckets that are in several components.

    Exact, by prefixes: the first shingle T that both have leaves an overlap of at most what either weighs from T
    on, and an overlap of threshold / (1 + threshold) of both weights is needed. For each shingle, those outside
    the component that most units with it are in are compared with all.
    """
    m = large.select("bucket", "row").join(labels, "row", "left").withColumn("component", F.coalesce("component", "row"))
    several = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    apart = written(m.join(several, "bucket").select("row", "component").distinct().hint("merge").join(texts, "row"), "apart")
    sent = large.sparkSession.sparkContext.broadcast((weights, ranks(apart)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rank = sent.value
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                got = []
                for t in part.column("text"):
                    h, tf = shingles(words(t.as_py()))
                    got.append(prefix(h, own(h, tf), rank, threshold))
                n = [len(g[0]) for g in got]
                spread = lambda x: np.repeat(np.asarray(x), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([g[0] for g in got])), pa.array(spread(part.column("row").to_numpy())), pa.array(spread(part.column("component").to_numpy())), pa.array(np.concatenate([g[1] for g in got])), pa.array(spread([g[2] for g in got]))],
                    names=["token", "row", "component", "rest", "total"],
                )

    tokens = written(apart.select("row", "component", "text").mapInArrow(run, "token long, row long, component long, rest double, total double"), "prefixes")
    per = tokens.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "main")
    x = tokens.hint("merge").join(main, "token").where("component <> main").drop("main").alias("x")
    y = tokens.alias("y")
    need = F.lit(threshold / (1 + threshold) * (1 - SLACK)) * (F.col("x.total") + F.col("y.total"))
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & (F.least("x.rest", "y.rest") >= need)
    return x.hint("merge").join(y, met).select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels with more links. Links so far are stars already: only their labels go on."""
    stars = labels.where("row <> component").select(F.col("component").alias("a"), F.col("row").alias("b"))
    return written(components(stars.union(links)), "labels")


def labelled(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The sketch table of docs (kept columns, __row, __unit), and its units' classes (__unit, least __row of
    the unit, label: the class's least row)."""
    weights = frequencies(docs)
    table = written(sketched(docs, weights, list(dict.fromkeys([*keep, "text"]))), "sketch")
    units = written(table.groupBy("__unit").agg(F.min("__row").alias("row"), F.any_value("__bands").alias("bands")), "units")
    exploded = units.select("row", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = exploded.join(shared, "bucket")
    popular = members.groupBy("row").agg(F.sum("n").alias("shared"))
    members = written(members.join(popular, "row"), "members")
    texts = written(table.select(F.col("__row").alias("row"), "text").join(members.select("row").distinct().hint("merge"), "row"), "candidate-texts")
    large = members.where(F.col("n") > SMALL)
    pairs = written(_first_candidates(members), "pairs")
    labels = written(components(_verified(pairs, texts, weights, threshold)), "labels")
    discard(pairs)
    for turn in range(ROUNDS):
        fresh = written(_later_candidates(large, labels, turn), "pairs")
        if fresh.isEmpty():
            break
        found = written(_verified(fresh, texts, weights, threshold), "verified")
        discard(fresh)
        if not found.isEmpty():
            labels = _joined(labels, found)
    fresh = written(_last_candidates(large, labels, texts, weights, threshold), "pairs")
    last = written(_verified(fresh, texts, weights, threshold), "verified")
    if not last.isEmpty():
        labels = _joined(labels, last)
    for used in (fresh, texts, members):
        discard(used)
    classes = units.select("__unit", "row").join(labels, "row", "left").select("__unit", "row", F.coalesce("component", "row").alias("label"))
    return table, classes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size for each row of docs (doc_id, text).

    Rows are in one class if a chain of links leads from one to the other: equal word sequences, or weighted
    Jaccard similarity of five-word shingles of at least threshold. class_id is the least id of the class (null
    if all are null). A null text is alone; texts without words are only like their exact copies.
    """
    table, classes = labelled(docs, ["doc_id"], threshold)
    per = table.groupBy("__unit").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    by_unit = written(classes.join(per, "__unit"), "classes")
    by_label = by_unit.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    unit_class = by_unit.select("__unit", "label").join(by_label, "label").drop("label")
    return table.select("doc_id", "__unit").join(unit_class, "__unit").select("doc_id", "class_id", "class_size")


def without_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with the columns of docs: that with the least doc_id, of equal ids the first read."""
    safe = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"__c{k}") for k, c in enumerate(docs.columns)])
    table, classes = labelled(safe, safe.columns, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    per = table.groupBy("__unit").agg(first.alias("first"))
    stay = classes.join(per, "__unit").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return table.join(stay, "__row", "left_semi").select(*[F.col(s).alias(c) for s, c in zip(safe.columns, docs.columns, strict=True)])
