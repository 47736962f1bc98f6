"""Shared plumbing of the text operators: scratch tables, row keys, Arrow batches.

Nothing here holds rows on the driver. Intermediate tables are written to the
folder named by ``spark.checkpoint.dir`` (which every executor must be able to
reach), so a lost executor costs a re-read and never a recomputed Python pass.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and tab to carriage return. ``bytes.split()``
#: without arguments splits on exactly these bytes.
SPACE = r"\x20\x09-\x0D"

#: Upper bound of the bytes of text handled at once inside a Python worker.
SLICE_BYTES = 1 << 21

_own_dir: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; if that is unset, under a folder of this machine, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="shoalkv-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to a scratch table and read back: a cut of the lineage that survives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(table: DataFrame, most: int) -> DataFrame:
    """A written table, marked to be sent to all scans if it has at most so many rows; else it will be joined by a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Settings of inner joins of texts with more keys than are sent: a bloom filter of the keys, of 64 MB at most, goes before the shuffle.
FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "64000000",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "8000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "536870912",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "134217728",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Spark's settings while the block runs."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def filtered_joins(spark: SparkSession):
    return settings(spark, FILTER)


def document(df: DataFrame, text: str, key: str) -> DataFrame:
    """Columns ``key`` (long) and ``text`` (string, null as empty) alone, whatever else ``df`` holds."""
    return df.select(
        df[f"`{key}`"].cast("long").alias("doc_id"),
        F.coalesce(df[f"`{text}`"].cast("string"), F.lit("")).alias("text"),
    )


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in zero-copy slices of about ``limit`` bytes, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * limit / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
