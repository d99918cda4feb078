"""Token counts without token ids.

Each block of documents is reduced to its distinct pre-tokens and, for each of these, the documents that hold
it and how often. That table is written once. The pre-tokens are dealt by hash, so that all copies of one meet in
one task and its pieces are counted once; the counts go back to their blocks, where they are joined to the
frequencies and summed. What travels is proportional to the blocks' vocabularies, never to documents times tasks,
and a frequent pre-token weighs as much as there are blocks.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import written

#: Characters on which the pattern engine here and the library's agree (checked in the tests); a text with
#: any other goes through the library's own pre-tokeniser.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\u024f\\u2013\\u2014\\u2018\\u2019\\u201c\\u201d\\u2026\\u20ac]")
#: A bucket of pre-tokens for so many bytes of text, and at most so many: that many tasks count pieces.
_BUCKET_BYTES, _LEAST_BUCKETS, _MOST_BUCKETS = 16_000_000, 32, 4096
#: Pre-tokens whose pieces a task remembers; beyond them it forgets and counts again what returns.
_KNOWN = 2_000_000
#: A block is closed at so many (pre-token, document) pairs, documents or characters.
_PAIRS, _DOCS, _CHARS = 1_500_000, 60_000, 24_000_000

#: A row with a bucket: some of a block's pre-tokens (their UTF-8 and lengths). A row without: the block's
#: documents, and for each pre-token in the buckets' order how many pairs it has; pairs are (document, times).
_BLOCKS = "block long, bucket int, pieces binary, sizes binary, at binary, n binary, large binary, doc_id array<{id}>, n_bytes array<bigint>"


class PreTokens:
    """Splits texts as a tokenizer file does, and counts the pieces of pre-tokens."""

    def __init__(self, path: str):
        import json
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only byte-level tokenizer files without a normaliser are supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Fixed value: the public pattern of byte-level pre-tokenisers.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def of(self, text: str) -> list[str]:
        """The pre-tokens of a text; special strings in it are pre-tokens of their own."""
        if self.special and self.special.search(text):
            return [x for k, part in enumerate(self.special.split(text)) for x in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


class _Block:
    """Documents gathered until they are written as rows."""

    def __init__(self):
        self.vocab: dict[str, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.ids, self.freqs, self.each = array("i"), array("i"), array("i")
        self.docs: list = []
        self.lengths: list[int] = []
        self.chars = 0

    def add(self, doc_id, text: str, pieces: list[str]) -> None:
        c = Counter(pieces)
        self.ids.extend(map(self.vocab.__getitem__, c))
        self.freqs.extend(c.values())
        self.each.append(len(c))
        self.docs.append(doc_id)
        self.lengths.append(len(text.encode("utf-8", "surrogatepass")))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.ids) >= _PAIRS or len(self.docs) >= _DOCS or self.chars >= _CHARS

    def rows(self, block: int, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        import xxhash

        raw = [p.encode("utf-8", "surrogatepass") for p in self.vocab]
        home = np.fromiter((xxhash.xxh32_intdigest(p) % buckets for p in raw), np.int32, len(raw))
        order = np.argsort(home, kind="stable")
        place = np.empty(len(raw), np.int32)
        place[order] = np.arange(len(raw), dtype=np.int32)
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        none = dict.fromkeys(schema.names)
        out = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = [raw[k] for k in order[edges[b] : edges[b + 1]]]
            out.append(none | {"block": block, "bucket": b, "pieces": b"".join(own), "sizes": np.fromiter(map(len, own), np.uint32, len(own)).tobytes()})
        where = place[np.frombuffer(self.ids, np.int32)] if self.ids else np.zeros(0, np.int32)
        at = np.repeat(np.arange(len(self.docs), dtype=np.uint16), np.frombuffer(self.each, np.int32))
        n = np.frombuffer(self.freqs, np.int32) if self.freqs else np.zeros(0, np.int32)
        by = np.argsort(where, kind="stable")
        n = n[by]
        out.append(none | {
            "block": block, "sizes": np.bincount(where, minlength=len(raw)).astype(np.uint32).tobytes(), "at": at[by].tobytes(),
            "n": np.minimum(n, 255).astype(np.uint8).tobytes(), "large": n[n >= 255].tobytes(), "doc_id": self.docs, "n_bytes": self.lengths,
        })
        yield pa.RecordBatch.from_pylist(out, schema)


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pre, number, held, schema = PreTokens(path), TaskContext.get().partitionId() << 24, _Block(), None
        for b in batches:
            binary = pa.binary()
            schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("pieces", binary), ("sizes", binary), ("at", binary), ("n", binary), ("large", binary), ("doc_id", pa.list_(b.schema.field("doc_id").type)), ("n_bytes", pa.list_(pa.int64()))])
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = t.as_py() or ""
                held.add(d, text, pre.of(text))
                if held.full():
                    yield from held.rows(number, buckets, schema)
                    number, held = number + 1, _Block()
        if held.docs:
            yield from held.rows(number, buckets, schema)

    return run


def _counted(path: str):
    """Pieces of each pre-token, in the rows' own order. Copies of a pre-token meet in one task, which counts it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known = PreTokens(path), {}
        for b in batches:
            rows = []
            for raw, sizes in zip(b.column("pieces").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
                pieces = [raw[a:e] for a, e in zip([0, *ends], ends, strict=False)]
                fresh = [p for p in pieces if p not in known]
                if len(known) > _KNOWN:
                    known, fresh = {}, list(dict.fromkeys(pieces))
                if fresh:
                    known.update(zip(fresh, pre.counts([p.decode("utf-8", "surrogatepass") for p in fresh]), strict=True))
                rows.append(np.fromiter(map(known.__getitem__, pieces), np.uint32, len(pieces)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(rows, pa.binary())], names=["block", "bucket", "tokens"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of a block: its pre-tokens' pieces times their frequencies."""
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b.column(c)[k] for c in b.schema.names}
            buckets = sorted((x["bucket"], x["tokens"]) for x in row["counts"].as_py() or [])
            tokens = np.frombuffer(b"".join(t for _, t in buckets), np.uint32).astype(np.int64)
            pairs = np.frombuffer(row["sizes"].as_py(), np.uint32)
            n = np.frombuffer(row["n"].as_py(), np.uint8).astype(np.int64)
            n[n == 255] = np.frombuffer(row["large"].as_py(), np.int32)
            at = np.frombuffer(row["at"].as_py(), np.uint16)
            docs = row["doc_id"].values
            sums = np.bincount(at, weights=np.repeat(tokens, pairs) * n, minlength=len(docs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([docs, row["n_bytes"].values, pa.array(sums)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    Null text counts as empty: 0 bytes, 0 tokens. Rows with equal or null ids stay separate rows. Special
    strings inside a text count as the library counts them by default: one token. Texts are never cut. Other columns
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = min(_MOST_BUCKETS, max(_LEAST_BUCKETS, -(-size // _BUCKET_BYTES)))
    blocks = written(docs.select("doc_id", "text").mapInArrow(_blocks(tokenizer_path, buckets), _BLOCKS.format(id=kind)), "token-blocks")
    counted = blocks.where("bucket is not null").select("block", "bucket", "pieces", "sizes").repartition(buckets, "bucket").mapInArrow(_counted(tokenizer_path), "block long, bucket int, tokens binary")
    counts = counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "tokens")).alias("counts"))
    rows = blocks.where("bucket is null").drop("bucket", "pieces").join(counts, "block", "left")
    sums = rows.mapInArrow(_summed, f"doc_id {kind}, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
