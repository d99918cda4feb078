"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weight w of total W, its i-th block (from 1) is released at slot
floor((i - 1) W / w) and due by ceil(i W / w); in each slot the released block with the earliest deadline goes
next. So at any slot each source has had less than one block more or less than its share. The schedule repeats
every W slots, so that one period is planned on the driver and a block's slot follows by arithmetic. When a
source has no blocks left, the others share the slots by their weights from there on, in a new phase, which counts
deviations anew: over several phases they may add up, by less than one block a phase.

Weights are taken as the fractions that their decimals say. If no whole numbers in proportion to them sum to
LONGEST_PERIOD or less, the shares are rounded to multiples of 1 / LONGEST_PERIOD by largest remainders, at least one:
then a source's share is off by less than that multiple (more only for shares below it, which are raised to it).
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block, and rows that are ranked together in one task, about.
BLOCK, RANKED = 64, 5_000
#: Sources (beyond: ValueError) and slots of a period, at most: they bound what is planned on the driver.
MOST_SOURCES, LONGEST_PERIOD = 2_000, 100_000

# The target weights of the registered query; sources that aren't listed weigh 1.
TARGETS = {"src0": 3, "src1": 2, "src2": 2}


def period(weights: list[int]) -> list[list[int]]:
    """For each source the slots of one period of sum(weights) slots that are its own."""
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, k) for k in range(len(weights))]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * total // weights[k]), k))
        _, k = heapq.heappop(ready)
        slots[k].append(slot)
        if len(slots[k]) < weights[k]:
            heapq.heappush(waiting, (len(slots[k]) * total // weights[k], k))
    return slots


def whole(weights: list[Fraction]) -> list[int]:
    """Positive whole numbers in proportion; beyond the longest period, that sum to it, by largest remainders."""
    scale = lcm(*(w.denominator for w in weights))
    out = [int(w * scale) for w in weights]
    shared = gcd(*out)
    out = [x // shared for x in out]
    if sum(out) <= LONGEST_PERIOD:
        return out
    # What is below one slot gets one; the others share the rest.
    total, slots = sum(out), LONGEST_PERIOD
    small = [x * slots <= total for x in out]
    rest, left = sum(x for x, s in zip(out, small, strict=True) if not s), slots - sum(small)
    exact = [Fraction(1) if s else Fraction(x * left, rest) for x, s in zip(out, small, strict=True)]
    floors = [max(1, x.numerator // x.denominator) for x in exact]
    order = sorted(range(len(out)), key=lambda k: (floors[k] - exact[k], k))
    for k in order[: max(0, slots - sum(floors))]:
        floors[k] += 1
    return floors


def plan(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(source, first block, block after the last, first slot, period, slots) of every phase and source in it."""
    left, done, start = list(blocks), [0] * len(blocks), 0
    out = []
    while active := [k for k, n in enumerate(left) if n]:
        own = period([weights[k] for k in active])
        total = sum(weights[k] for k in active)
        at = lambda k, s, i: i // weights[k] * total + s[i % weights[k]]
        length = min(at(k, s, left[k] - 1) for k, s in zip(active, own, strict=True)) + 1
        for k, s in zip(active, own, strict=True):
            n = length // total * weights[k] + sum(x < length % total for x in s)
            if n:
                out.append((k, done[k], done[k] + n, start, total, s))
            done[k] += n
            left[k] -= n
        start += length
    return out


def _key(source: Column) -> Column:
    """A source's name with a letter before it, so that null is a source too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def mixed(docs: DataFrame, targets: dict[str, float], block: int = BLOCK, other: float = 1) -> DataFrame:
    """docs (doc_id, text, source, and any columns) with mix_block, mix_slot and mix_place.

    mix_block counts a source's blocks, mix_slot is the block's place among all blocks, mix_place the row's place
    in its block. Every row gets exactly one place; a source's rows are in the order of a hash of id and text.
    Null is a source of its own; sources that targets doesn't list weigh other. A large source is ranked in
    many tasks: by hash range, with the counts of the ranges before; rows that are equal in id and text are ranked in
    one. Columns named as the added ones give way; any other names will do. An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = ("mix_block", "mix_slot", "mix_place")
    kept = [c for c in docs.columns if c not in names]
    own = {c: f"c{k}" for k, c in enumerate(kept)}
    doc_id, text, source = (F.col(own[c]) for c in ("doc_id", "text", "source"))
    docs = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    total = docs.select(source).count()
    ranges = max(1, -(-total // RANKED))
    hashed = docs.withColumns({"key": _key(source), "hash": F.xxhash64(doc_id, text)})
    hashed = hashed.withColumn("range", F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * ranges).cast("int"))
    per = hashed.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("key", "range", (F.sum("n").over(Window.partitionBy("key").orderBy("range")) - F.col("n")).alias("before"))
    counts = sorted((r["key"], r["n"]) for r in per.groupBy("key").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect())
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = [Fraction(str(targets.get(k[1:], other) if k != "n" else other)) for k, _ in counts]
    if any(w <= 0 for w in weights):
        raise ValueError("a target weight is not positive")
    rows = [(counts[k][0], *rest) for k, *rest in plan([-(-n // block) for _, n in counts], whole(weights))] if counts else []
    phases = spark.createDataFrame(rows, "key string, first long, end long, start long, period long, slots array<int>")
    place = F.row_number().over(Window.partitionBy("key", "range").orderBy(F.col("hash"), doc_id))
    ranked = hashed.withColumn("place", place).join(before, ["key", "range"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    ranked = ranked.withColumns({"block": F.floor(F.col("rank") / block).cast("long"), "in_block": (F.col("rank") % block).cast("int")})
    put = ranked.join(phases, (ranked["key"] == phases["key"]) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end")))
    i, w = F.col("block") - F.col("first"), F.size("slots")
    slot = F.col("start") + F.floor(i / w) * F.col("period") + F.element_at("slots", (i % w + 1).cast("int"))
    return put.select(*[F.col(a).alias(c) for c, a in own.items()], F.col("block").alias("mix_block"), slot.cast("long").alias("mix_slot"), F.col("in_block").alias("mix_place"))
