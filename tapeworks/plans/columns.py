"""Operators as SQL expressions over ordered windows, for Spark and, as oracles, for DuckDB.

An operator is a function of a Builder and its parameters that returns its output expressions. The builder
turns nested window expressions into levels of one query. All levels share one partitioning and order, so that
Spark exchanges and sorts the rows once whatever the number of levels or fused operators.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Columns that order the rows of one series and at_ms, for inputs that have them (those made of ticks): microseconds, then number.
TIES = ("us", "seq")

#: Input kinds and their value columns; every input has series and at_ms as well.
INPUTS = {
    "candle": ("o", "h", "l", "c", "v"),
    "scalar": ("x",),
    "pair": ("x", "y"),
    "derivative": ("funding", "mark", "idx", "fut", "oi", "longs", "shorts", "tbuy", "tsell", "lliq", "sliq"),
    "trade": ("price", "size", "side"),
    "quote": ("price", "size", "side", "mid"),
    "book": ("bids", "asks"),
    "section": ("adv", "decl", "advvol", "decvol", "totvol", "nhigh", "nlow", "above", "buysig", "members"),
}


@dataclass(frozen=True)
class Operator:
    """A named computation: what it reads, its parameters with defaults, and how its columns are made."""

    name: str
    reads: str
    params: dict
    make: Callable
    family: str


OPERATORS: dict[str, Operator] = {}


def operator(name: str, reads: str, make: Callable, family: str, **params) -> None:
    if name in OPERATORS:
        raise ValueError(f"{name} is defined twice")
    OPERATORS[name] = Operator(name, reads, params, make, family)


@dataclass
class Builder:
    """Collects the levels of a query. spark tells the dialect; prefix keeps fused operators' names apart; order sorts a series."""

    spark: bool = True
    prefix: str = "v"
    order: str = "at_ms"
    levels: list[dict[str, str]] = field(default_factory=list)
    known: dict[str, str] = field(default_factory=dict)

    def let(self, expression: str) -> str:
        """A column for an expression, at the lowest level where all that it names is there."""
        if expression in self.known:
            return self.known[expression]
        if re.fullmatch(r"\w+", expression):
            return expression
        used = set(re.findall(rf"\b{self.prefix}\d+_\b", expression))
        at = max((k + 1 for k, level in enumerate(self.levels) if used & level.keys()), default=0)
        while len(self.levels) <= at:
            self.levels.append({})
        name = f"{self.prefix}{sum(map(len, self.levels))}_"
        self.levels[at][name] = expression
        self.known[expression] = name
        return name

    def flat(self, x) -> str:
        """x without windows in it, so that another window can take it."""
        x = str(x)
        return self.let(x) if "OVER" in x else x

    def over(self, n: int | None = None, shift: int = 0, keys: str = "series") -> str:
        """The frame of the last n rows (None: all up to here), ending shift rows before the current one."""
        start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 + shift} PRECEDING" if n - 1 + shift else "CURRENT ROW"
        end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
        return f"(PARTITION BY {keys} ORDER BY {self.order} ROWS BETWEEN {start} AND {end})"

    def roll(self, f: str, x, n: int, shift: int = 0) -> str:
        """An aggregate over n rows; null until all of them have a value."""
        x = self.flat(x)
        w = self.over(n, shift)
        return self.let(f"CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END")

    def roll2(self, f: str, x, y, n: int) -> str:
        x, y = self.flat(x), self.flat(y)
        w = self.over(n)
        both = self.flat(self.let(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"))
        return self.let(f"CASE WHEN count({both}) OVER {w} = {n} THEN {f}({x}, {y}) OVER {w} END")

    def avg(self, x, n: int) -> str:
        return self.roll("avg", x, n)

    def sum(self, x, n: int) -> str:
        return self.roll("sum", x, n)

    def max(self, x, n: int) -> str:
        return self.roll("max", x, n)

    def min(self, x, n: int) -> str:
        return self.roll("min", x, n)

    def sd(self, x, n: int) -> str:
        return self.roll("stddev_pop", x, n)

    def sds(self, x, n: int, shift: int = 0) -> str:
        return self.roll("stddev_samp", x, n, shift)

    def var(self, x, n: int) -> str:
        return self.roll("var_pop", x, n)

    def quantile(self, x, q: float, n: int) -> str:
        """Linear interpolation between order statistics."""
        x = self.flat(x)
        w = self.over(n)
        f = f"percentile({x}, {q!r})" if self.spark else f"quantile_cont({x}, {q!r})"
        return self.let(f"CASE WHEN count({x}) OVER {w} = {n} THEN {f} OVER {w} END")

    def lag(self, x, k: int = 1) -> str:
        x = self.flat(x)
        return self.let(f"lag({x}, {k}) OVER (PARTITION BY series ORDER BY {self.order})") if k else x

    def cum(self, x, f: str = "sum", keys: str = "series") -> str:
        return self.let(f"{f}({self.flat(x)}) OVER {self.over(keys=keys)}")

    def held(self, x) -> str:
        """The last value of x that isn't null."""
        x = self.flat(x)
        w = self.over()
        return self.let(f"last({x}, true) OVER {w}" if self.spark else f"last_value({x} IGNORE NULLS) OVER {w}")

    def decay(self, u, q: float) -> str:
        """y = q * y before + u, from the first u that isn't null; u has no later nulls.

        Spark sums q ** (age) * u in blocks of rows, so that powers stay in range. Of the blocks before only the
        last one counts: a block is so long that whatever came before it has faded below double precision.
        """
        u = self.flat(u)
        if not self.spark:
            w = self.over()
            return self.let(f"CASE WHEN {u} IS NOT NULL THEN list_reduce(list({u}) FILTER (WHERE {u} IS NOT NULL) OVER {w}, lambda a_, e_: a_ * {q!r} + e_) END")
        if q <= 0:
            return u
        length = max(8, math.ceil(-42 / math.log(q)))
        at = self.let(f"count({u}) OVER {self.over()} - 1")
        block = self.let(f"CASE WHEN {u} IS NOT NULL THEN CAST(floor({at} / {float(length)!r}) AS BIGINT) ELSE -1 END")
        place = self.let(f"CAST({at} - {block} * {length} AS DOUBLE)")
        scaled = self.let(f"{u} * exp({place} * {-math.log(q)!r})")
        own = self.let(f"sum({scaled}) OVER (PARTITION BY series, {block} ORDER BY {self.order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        before = self.let(f"sum({scaled}) OVER (PARTITION BY series ORDER BY {block} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)")
        return self.let(f"CASE WHEN {u} IS NOT NULL THEN exp({place} * {math.log(q)!r}) * ({own} + coalesce({before}, 0e0) * {q**length!r}) END")

    def smooth(self, x, alpha: float, seed: int) -> str:
        """y moves by alpha towards x; the first y is the mean of the first seed values."""
        x = self.flat(x)
        n = self.let(f"count({x}) OVER {self.over()}")
        mean = self.let(f"avg({x}) OVER {self.over()}") if seed > 1 else x
        return self.decay(f"CASE WHEN {x} IS NULL OR {n} < {seed} THEN NULL WHEN {n} = {seed} THEN {mean} ELSE {alpha!r} * {x} END", 1 - alpha)

    def ema(self, x, n: int) -> str:
        return self.smooth(x, 2 / (n + 1), n)

    def rma(self, x, n: int) -> str:
        """Wilder's average, seeded by a mean."""
        return self.smooth(x, 1 / n, n)

    def rn(self) -> str:
        return self.let(f"CAST(row_number() OVER (PARTITION BY series ORDER BY {self.order}) AS DOUBLE)")

    def div(self, a, b, other="NULL") -> str:
        """a / b; other where b is 0."""
        b = self.let(str(b)) if not re.fullmatch(r"[\w.]+", str(b)) else b
        return f"(CASE WHEN {b} IS NULL THEN NULL WHEN {b} = 0 THEN {other} ELSE ({a}) / {b} END)"

    def array(self, x, n: int) -> str:
        """The last n values, oldest first; null until there are n."""
        x = self.flat(x)
        w = self.over(n)
        return self.let(f"CASE WHEN count({x}) OVER {w} = {n} THEN {'collect_list' if self.spark else 'list'}({x}) OVER {w} END")

    def total(self, array: str, expression: str, var: str = "e") -> str:
        """The sum of an expression of each element e of an array."""
        if self.spark:
            return f"aggregate(transform({array}, {var} -> CAST({expression} AS DOUBLE)), 0e0, (a_, b_) -> a_ + b_)"
        return f"list_sum(list_transform({array}, lambda {var}: CAST({expression} AS DOUBLE)))"

    def sorted(self, array: str, expression: str = "e") -> str:
        """The values of an expression of each element, in order."""
        if self.spark:
            return self.let(f"sort_array(transform({array}, e -> CAST({expression} AS DOUBLE)))")
        return self.let(f"list_sort(list_transform({array}, lambda e: CAST({expression} AS DOUBLE)))")

    def item(self, array: str, k: int) -> str:
        """The k-th element, from 0."""
        return f"{array}[{k if self.spark else k + 1}]"

    def sorted_quantile(self, array: str, q: float, n: int) -> str:
        """Type-7 quantile of a sorted array of n values."""
        h = q * (n - 1)
        lo, hi = math.floor(h), min(math.floor(h) + 1, n - 1)
        return self.let(f"{self.item(array, lo)} + {h - lo!r} * ({self.item(array, hi)} - {self.item(array, lo)})")

    def weighted(self, x, weights: list[float]) -> str:
        """Sum of weights times the last values, the last weight on the current one."""
        x = self.flat(x)
        n = len(weights)
        terms = [f"{w!r} * {self.lag(x, n - 1 - k)}" for k, w in enumerate(weights)]
        return "(" + " + ".join(terms) + ")"

    def ready(self, n: int, x: str) -> str:
        """x from the n-th row on."""
        return f"(CASE WHEN {self.rn()} >= {n} THEN {x} END)"


def order(df: DataFrame) -> str:
    """What sorts the rows of a series: time, then what tells rows of the same time apart."""
    return ", ".join(["at_ms", *(c for c in TIES if c in df.columns)])


def outputs(op: Operator, builder: Builder, params: dict) -> dict[str, str]:
    made = op.make(builder, **(op.params | params))
    made = made if isinstance(made, dict) else {"value": made}
    return {k: builder.let(str(x)) if "OVER" in str(x) else str(x) for k, x in made.items()}


def query(name: str, source: str, spark: bool, digits: int | None = None, **params) -> str:
    """The SQL of an operator over a table with series, at_ms and its inputs. digits: round results."""
    op = OPERATORS[name]
    b = Builder(spark)
    made = outputs(op, b, params)
    return _select(source, b.levels, made, digits)


def rounded(x: str, digits: int) -> str:
    """x without the noise of the order of summation: so many decimals, and a single float's precision."""
    return f"CAST(CAST(round(CAST({x} AS DOUBLE), {digits}) + 0e0 AS FLOAT) AS DOUBLE)"


def _select(source: str, levels: list[dict[str, str]], made: dict[str, str], digits: int | None) -> str:
    at = source
    for level in levels:
        if level:
            at = f"(SELECT *, {', '.join(f'{x} AS {k}' for k, x in level.items())} FROM {at}) q"
    shown = {k: rounded(x, digits) if digits is not None else x for k, x in made.items()}
    return f"SELECT series, at_ms, {', '.join(f'{x} AS {k}' for k, x in shown.items())} FROM {at}"


def _frame(df: DataFrame, levels: list[dict[str, str]], made: dict[str, str], digits: int | None) -> DataFrame:
    """The levels as projections one upon the other, each analysed by itself."""
    for level in levels:
        if level:
            df = df.selectExpr("*", *(f"{x} AS {k}" for k, x in level.items()))
    return df.selectExpr("series", "at_ms", *(f"{rounded(x, digits) if digits is not None else x} AS {k}" for k, x in made.items()))


def compute(df: DataFrame, name: str, digits: int | None = None, **params) -> DataFrame:
    """The operator's columns for every row of df (series, at_ms, the operator's inputs and, for rows of one at_ms, TIES)."""
    b = Builder(order=order(df))
    made = outputs(OPERATORS[name], b, params)
    return _frame(df, b.levels, made, digits)


def fused(df: DataFrame, requests: dict[str, tuple[str, dict]], digits: int | None = None) -> DataFrame:
    """Several operators in one pass: requests maps a label to (operator, parameters); columns are label_output."""
    levels: list[dict[str, str]] = []
    made: dict[str, str] = {}
    for k, (label, (name, params)) in enumerate(requests.items()):
        b = Builder(prefix=f"f{k}v", order=order(df))
        made |= {f"{label}_{key}": x for key, x in outputs(OPERATORS[name], b, params).items()}
        for i, level in enumerate(b.levels):
            while len(levels) <= i:
                levels.append({})
            levels[i] |= level
    return _frame(df, levels, made, digits)
