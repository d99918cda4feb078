"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items.

The automaton's letters are words: a text is normalised once into words, each word becomes a number (0 if no
item has it), and one scan of these finds every window. Word positions map back to offsets in the original.
"""

from __future__ import annotations

import re
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import WORD_BYTES, appended, words

#: Words of benchmark items that one automaton takes (some 100 bytes each in every Python worker). A larger
#: benchmark is dealt to several automata, used in turn on each batch.
WORDS_PER_AUTOMATON = 2_000_000
#: UTF-8 bytes of all items together that are collected and broadcast; a larger benchmark raises.
MOST_BYTES = 512_000_000
#: Automata that a Python worker keeps; with more, they are built again in turn.
KEPT = 4

HITS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


class Automaton:
    """Finds windows of items in a list of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        import ahocorasick

        self.code: dict[bytes, int] = {}
        self.items = [name for name, _ in items]
        owners: dict[tuple[int, ...], list[int]] = {}
        for k, (_, ws) in enumerate(items):
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in ws]
            for i in range(max(1, len(codes) - window + 1) if codes else 0):
                own = owners.setdefault(tuple(codes[i : i + window]), [])
                if not own or own[-1] != k:
                    own.append(k)
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in owners.items():
            self.find.add_word(key, (len(key), own))
        self.any = bool(owners)
        if self.any:
            self.find.make_automaton()
            # A word of no item leads back to the root, so only runs of known words need a scan.
            self.runs = re.compile(b"\x01{%d,}" % min(map(len, owners))).finditer

    def scan(self, ws: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """(first word, word after the last, items) of every occurrence."""
        if not self.any or not ws:
            return []
        codes = tuple(map(self.code.get, ws, repeat(0)))
        return [(r + end - n + 1, r + end + 1, own) for r, e in (m.span() for m in self.runs(bytes(map(bool, codes)))) for end, (n, own) in self.find.iter(codes[r:e])]


def _merged(found: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _spans(text: str, runs: list[list[int]]) -> list[dict]:
    """Runs of words as code point offsets in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD_BYTES.finditer(raw.lower())]
    point = lambda k: len(raw[:k].decode("utf-8", "surrogatepass"))
    return [{"start": point(at[a][0]), "end": point(at[b - 1][1])} for a, b in runs]


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """docs (text, and any columns) with n_words, n_hit, item_ids (sorted strings) and spans of hit text.

    A hit word lies in an occurrence of window consecutive words of an item (item_id, text), or of all of an
    item with fewer. Null or wordless texts have no hits; null or wordless items none either. A null item_id
    is named by the empty string; rows that repeat an item count once. An empty items table hits nothing; an empty
    docs table gives no rows, and repeated rows stay separate rows.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"items of more than {MOST_BYTES} bytes")
    listed = [(str(r[0]) if r[0] is not None else "", words(r[1])) for r in items.select("item_id", "text").where("text is not null").toLocalIterator()]
    listed.sort()
    shards: list[list] = [[]]
    size = 0
    for item in listed:
        if size + len(item[1]) > WORDS_PER_AUTOMATON and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(item)
        size += len(item[1])
    sent = [spark.sparkContext.broadcast(s) for s in shards]

    def make():
        import pyarrow as pa

        kept: dict[int, Automaton] = {}

        def automaton_of(k: int) -> Automaton:
            if k not in kept:
                if len(kept) >= KEPT:
                    kept.pop(next(iter(kept)))
                kept[k] = Automaton(sent[k].value, window)
            return kept[k]

        order = list(range(len(sent)))
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def run(b):
            texts = b.column("text").to_pylist()
            split = [words(t) for t in texts]
            runs, names = [[] for _ in texts], [set() for _ in texts]
            # Forth and back in turn, so that what is kept is used.
            order.reverse()
            for part in order:
                automaton = automaton_of(part)
                for k, ws in enumerate(split):
                    for a, e, own in automaton.scan(ws):
                        runs[k].append((a, e))
                        names[k].update(automaton.items[i] for i in own)
            merged = [_merged(r) for r in runs]
            return [
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([sum(e - a for a, e in m) for m in merged], pa.int64()),
                pa.array([sorted(n) for n in names], pa.list_(pa.string())),
                pa.array([_spans(t, m) if m else [] for t, m in zip(texts, merged, strict=True)], spans_type),
            ]

        return run

    return appended(docs, make, HITS, ["text"], keep)


def leak_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The digest of find_leaks for each row: counts, the items' hash, and whether anything was hit."""
    found = find_leaks(docs, items, window, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_leaks(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs that have no hit, with the columns of docs, whatever their names."""
    safe = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"__{k}") for k, c in enumerate(docs.columns)])
    names = dict(zip(safe.columns, docs.columns, strict=True))
    return find_leaks(safe, items, window).where("n_hit = 0").select(*[F.col(s).alias(c) for s, c in names.items()])
