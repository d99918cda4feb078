"""WARC archives: written as one gzip stream per file, then normalised to a gzip member per record.

write_archives puts records into files compressed as a whole, as careless tools do. normalise inflates such a
stream once, rewrites every record as a member of its own and writes a sidecar index of offsets, so that
read_records can fetch any record with one seek. Files go to a folder that all executors share; a file's name
holds the task attempt, and only files that a finished task lists are read, so lost executors leave no trace.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import shared_dir, written

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISIT = 1000
#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 64_000_000
#: Archives are normalised and read in so many tasks at most (a task takes several beyond).
MOST_TASKS = 50_000
_CHUNK = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ENTRY = "offset long, length long, archive string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda x: f"<urn:uuid:{uuid.uuid5(_NAMES, f'page/{x}')}>"
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("X-Payload-Length", str(size)),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html with payload_bytes, sha1, record_type, refers_to.

    Of payloads of at least 1000 bytes that are equal, the one with the largest page_id is the response and the
    others revisit it. Rows that repeat that page_id are responses too; in a group of null ids only, all are.
    Groups are made by digest with partial aggregation, and the join may split a large one.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "sha1": F.sha1(F.col("html").cast("binary"))})
    newest = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).where(F.octet_length("html") >= LEAST_REVISIT).groupBy(F.sha1(F.col("html").cast("binary")).alias("sha1")).agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    joined = p.join(newest, "sha1", "left")
    again = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "html", "payload_bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("newest")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as monolithic .warc.gz files under folder and returns their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, top = _fs(folder)
        task = TaskContext.get()
        out, squeeze, size, made = None, None, 0, []

        def close():
            nonlocal out
            if out:
                out.write(squeeze.flush())
                out.close()
                out = None

        for b in batches:
            for r in zip(*(b.column(c) for c in ("page_id", "url", "html", "payload_bytes", "sha1", "record_type", "refers_to")), strict=True):
                page_id, url, html, n, sha1, kind, refers = (x.as_py() for x in r)
                if out is None:
                    fs.create_dir(top, recursive=True)
                    name = f"mono-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made)}.warc.gz"
                    made.append(f"{folder}/{name}")
                    out, squeeze, size = fs.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), n, sha1, kind, refers)
                out.write(squeeze.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return records.mapInArrow(run, "archive string")


def _inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, inflated once in bounded pieces."""
    z = zlib.decompressobj(31)
    while data := source.read(_CHUNK):
        while data:
            yield z.decompress(data, _CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, _CHUNK)
            data = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The WARC records of a byte stream; at most one record and a piece are held."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("truncated record")
                return
        length = next(int(line.split(b":", 1)[1]) for line in bytes(held[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
        total = end + 4 + length + 4
        while len(held) < total:
            if not more():
                raise ValueError("truncated record")
        yield bytes(held[:total])
        del held[:total]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines), raw[end + 4 : -4]


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites archives (archive) record by record beside the originals; returns the index (ENTRY).

    Each file gets a sidecar .idx of JSON lines with every record's offset, length, type, URI and digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        for b in batches:
            for uri in b.column("archive").to_pylist():
                fs, path = _fs(uri)
                renamed = lambda x: x.replace("/mono-", "/norm-").removesuffix(".warc.gz") + f"-{task.taskAttemptId()}.warc.gz"
                to = renamed(path)
                at, entries = 0, []
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(to, compression=None) as out, fs.open_output_stream(to.removesuffix(".warc.gz") + ".idx", compression=None) as side:
                    for raw in split_records(_inflated(source)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        head, _ = parse(raw)
                        side.write((json.dumps({"offset": at, "length": len(member), "type": head["WARC-Type"], "uri": head["WARC-Target-URI"], "digest": head["WARC-Payload-Digest"]}) + "\n").encode())
                        entries.append((at, len(member)))
                        at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in entries], pa.int64()), pa.array([e[1] for e in entries], pa.int64()), pa.array([renamed(uri)] * len(entries), pa.string())], names=["offset", "length", "archive"])

    return archives.mapInArrow(run, ENTRY)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index lists, each fetched by offset and checked against its own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                rows = []
                for uri, at, n in zip(*(b.column(c).to_pylist()[k : k + 1000] for c in ("archive", "offset", "length")), strict=True):
                    if uri != opened:
                        if source:
                            source.close()
                        fs, path = _fs(uri)
                        opened, source = uri, fs.open_input_file(path)
                    source.seek(at)
                    head, block = parse(zlib.decompress(source.read(n), 31))
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    sha1 = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    whole = head["WARC-Type"] == "response"
                    if whole and (hashlib.sha1(payload).hexdigest() != sha1 or len(payload) != int(head["X-Payload-Length"])):
                        raise ValueError(f"damaged record at {at} of {uri}")
                    number = lambda x: int(head[x]) if x in head else None  # noqa: E731, B023
                    rows.append((number("X-Page-ID"), head["WARC-Target-URI"], number("X-Payload-Length"), sha1, head["WARC-Type"], number("X-Refers-To-Page-ID"), payload.decode("utf-8", "surrogatepass") if whole and payloads else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return index.mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, normalises them, and returns the index.

    Null html is an empty payload; a null url an empty one; repeated rows are records of their own. An empty table
    makes no archive. Other columns are ignored.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    mono = written(write_archives(with_revisits(pages), folder), "warc-list")
    return written(normalise(dealt(mono)), "warc-index")


def dealt(archives: DataFrame) -> DataFrame:
    """Rows with an archive column, those of one archive together and in order of offset, in about as many tasks as there are
    archives. The number is given, as paths are so short that adaptive execution would put all in one task."""
    tasks = max(1, min(MOST_TASKS, archives.select("archive").distinct().count()))
    rows = archives.repartition(tasks, "archive")
    return rows.sortWithinPartitions("archive", "offset") if "offset" in archives.columns else rows
