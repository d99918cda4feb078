"""What the corpus operators share: reading tables, shared folders, words and digests."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zlib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the words of a text whose A-Z were lower-cased, as a pattern on UTF-8 bytes.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set by Spark's own reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_folder() -> str:
    """For local sessions without a shared folder, as in tests: a folder that goes with the process."""
    folder = tempfile.mkdtemp(prefix="tapeworks-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster raises."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _local_folder()
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() made for df, once nothing will read it any more."""
    spark, path = df.sparkSession, df._written
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.lower() changes A-Z only."""
    return WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())


def bucket(term: bytes, mask: int) -> int:
    """The hashed feature of a term; crc32 is the same on every machine."""
    return zlib.crc32(term) & mask


def appended(df: DataFrame, make, added: str, inputs: list[str], keep: list[str] | None = None, rows: int = 2000, where: str | None = None) -> DataFrame:
    """df's columns (keep: only these) and those that a Python function computes from its input columns.

    make() is called once per task and gives a function from a RecordBatch of the inputs, of at most so many
    rows, to a list of arrays, one for each column of the DDL string added. A kept column with the name of an
    added one gives way to it. where: the name of an added boolean; only its true rows are passed on, without it.
    Columns travel under names of our own, so theirs may hold dots or clash with anything but the added ones.
    """
    from pyspark.sql.types import StructField, StructType

    new = StructType.fromDDL(added)
    shown = [f for f in new if f.name != where]
    kept = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in shown}]
    travel = [f"k{k}" for k in range(len(kept))]
    under = {c: f"i{k}" for k, c in enumerate(inputs)} | dict(zip(kept, travel, strict=True))
    schema = StructType([*(StructField(t, df.schema[c].dataType) for t, c in zip(travel, kept, strict=True)), *(StructField(f"n{k}", f.dataType) for k, f in enumerate(shown))])

    def run(batches):
        import pyarrow as pa

        f = make()
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                given = pa.RecordBatch.from_arrays([b.column(under[c]) for c in inputs], names=inputs)
                made = dict(zip(new.names, f(given), strict=True))
                mask = made.pop(where) if where else None
                out = pa.RecordBatch.from_arrays([*(b.column(c) for c in travel), *made.values()], names=schema.names)
                yield out.filter(mask) if where else out

    read = [F.col(f"`{c}`").alias(t) for c, t in under.items() if c in kept or c in inputs]
    return df.select(*read).mapInArrow(run, schema).select(*(F.col(t).alias(c) for t, c in zip(schema.names, [*kept, *(f.name for f in shown)], strict=True)))
