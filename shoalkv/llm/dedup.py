"""Operator 2: exact dedup with disk-backed streaming state.

Rows land in a content store (Parquet, in the shared scratch folder) with the
digest of their normalised text. A Structured Streaming query reads the store in
micro-batches and keeps, per digest, the first place (smallest id, then content
locator: file and row of the store) and a count. The state lives in RocksDB, has no
watermark and so never expires; Spark combines equal digests before the shuffle,
so a group of copies of any size sends one row per task.

A digest that was seen twice or more is a hit, and hits are compared by their full
bytes: only their texts are read again and grouped by the bytes themselves. Should a
digest stand for several texts, each text becomes a group of its own. The texts of other rows never
leave their scan: up to ``BROADCAST`` hits are sent to the scans, more are joined, behind the engine's own
bloom filter over their digests.

``state`` names a folder that outlives the call: store, stream checkpoint and states. A later call
(of another session too) with new rows meets the state of all rows before, and returns its own rows with
the first place and the count over all. What an earlier call has returned isn't taken back. Each call lands in a partition
of its own, and their numbers rise, so a locator tells the order of calls, and a call reads back no other's files but for hits.

Defined cases: null text counts as empty; of equal texts the smallest id stays, a
null id comes last, and of repeated rows with one id the first in the store stays, earlier calls before later ones;
an empty table gives no rows; further columns are kept by ``distinct`` and passed
over by ``classes``, whatever their names; texts of any length are one row of the store each. Calls on
one ``state`` folder must follow one another and have the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, filtered_joins, scratch, sent, settings, written

#: Files of the store in one micro-batch.
FILES_PER_BATCH = 1000

#: Settings of the streaming state: on disk, with a bound on its memory, and without files allocated ahead (some
#: megabytes for each state partition, however small).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Rows of hits, some 250 bytes each, that are sent to every scan; more are joined.
BROADCAST = 100_000


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty. Single spaces don't match, which saves most of the work."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def _next(spark: SparkSession, path: str) -> int:
    """The number of a store's next call."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return 1 + max((int(n.removeprefix("call=")) for n in names if n.startswith("call=")), default=0)


class Store:
    """The landed rows: ``row`` (all columns), ``doc_id``, ``digest``, ``norm`` (null where it equals ``text``), partitioned by ``call``."""

    def __init__(self, df: DataFrame, text: str, key: str, digest_bytes: int, folder: str):
        self.spark, self.path = df.sparkSession, f"{folder}/store"
        self.call = _next(self.spark, self.path)
        self.body = F.coalesce("norm", F.col("text"), F.lit(""))
        norm = normalised(df[f"`{text}`"].cast("string"))
        landed = df.select(
            F.struct(*[df[f"`{c}`"] for c in df.columns if c != text]).alias("row"),
            df[f"`{text}`"].cast("string").alias("text"),
            df[f"`{key}`"].cast("long").alias("doc_id"),
            norm.alias("norm"),
        )
        digest = F.unhex(F.sha2("norm", 256))
        landed = landed.select(
            "row", "text", "doc_id",
            (digest if digest_bytes == 32 else F.substring(digest, 1, digest_bytes)).alias("digest"),
            F.when(~F.col("norm").eqNullSafe(F.col("text")), F.col("norm")).alias("norm"),
        )
        landed.write.option("compression", "zstd").parquet(f"{self.path}/call={self.call:010d}")
        self.schema = T.StructType([*landed.schema.fields, T.StructField("call", T.IntegerType())])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select("*", *_PLACE())

    def own(self) -> DataFrame:
        """This call's rows."""
        return self.rows().where(F.col("call") == self.call)

    def stream(self, files: int) -> DataFrame:
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(self.path)
        return rows.select("doc_id", "digest", *_PLACE())


def _PLACE() -> tuple[Column, Column]:
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")


def _first() -> Column:
    """The first place of a group, by id (null last), then locator."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at")).alias("first")


def _states(store: Store, folder: str, files: int) -> DataFrame:
    """Digest and count, as the stream's state has them after the last micro-batch."""
    spark, out = store.spark, f"{folder}/states"
    changed = store.stream(files).groupBy("digest").agg(_first(), F.count(F.lit(1)).alias("n"))

    spark.createDataFrame([], changed.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # for a store without rows

    def keep(batch: DataFrame, number: int) -> None:  # a repeated batch writes over its own folder
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

    with settings(spark, STATE):
        query = changed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    schema = T.StructType([*changed.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out).groupBy("digest").agg(F.max("n").alias("n"))  # a count only rises


def _grouped(df: DataFrame, text: str, key: str, files: int, digest_bytes: int, state: str | None) -> DataFrame:
    """The store's rows of this call, with ``first`` and ``n`` of their group of equal texts, null for a group of one."""
    spark = df.sparkSession
    folder = state.rstrip("/") if state else scratch(spark, "dedup")
    store = Store(df, text, key, digest_bytes, folder)
    hits = _states(store, folder, files).where("n > 1").select("digest")
    if state:  # of all hits so far, those of this call
        hits = hits.join(store.own().select("digest"), "digest", "left_semi")
    hits = written(hits, "hits")
    with filtered_joins(spark):
        texts = store.rows().select("digest", store.body.alias("body"), "doc_id", "file", "at").join(sent(hits, BROADCAST), "digest")
        same = written(texts.groupBy("digest", "body").agg(_first(), F.count(F.lit(1)).alias("n")), "same")
    several = written(same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "several")
    groups = same.where("n > 1").select("digest", "first", "n")
    if several.isEmpty():
        return store.own().join(sent(groups, BROADCAST), "digest", "left")
    split = store.own().join(several, "digest", "left_semi").withColumn("body", store.body)
    split = split.join(same, ["digest", "body"]).drop("body")
    return store.own().join(several, "digest", "left_anti").join(groups, "digest", "left").unionByName(split)


def _kept() -> Column:
    return F.col("first").isNull() | ((F.col("file") == F.col("first.file")) & (F.col("at") == F.col("first.at")))


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", files: int = FILES_PER_BATCH, digest_bytes: int = 32, state: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, digest."""
    rows = _grouped(df, text, key, files, digest_bytes, state)
    keep = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), _kept().alias("kept"), "digest")


def distinct(df: DataFrame, text: str = "text", key: str = "doc_id", files: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    rows = _grouped(df, text, key, files, 32, state).where(_kept())
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])


#: The query's result in SQL.
CLASSES_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
