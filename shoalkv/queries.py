"""The engine's operators as queries over the driver's tables, with the same in SQL.

The tables have no mutations, so they are made: each event is one, in order of its id, keyed by its user; an
``error`` deletes, anything else puts ``props``. Ten flush units cover the log; the first eight are published, the
rest is the log's suffix. ``orders`` is the arm with disjoint key ranges.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import Config
from .functions import bloom, latency, paths
from .operators import cache, memtable
from .plans import flush, views
from .plans.engine import Engine, bootstrap
from .schema import MUTATION, PLAIN, CrashInjected, Op
from .sources import log, objects
from .sources.frames import Record
from .sources.lake import Lake
from .sources.reader import Reader
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Log segments in a flush unit, for the query on segments.
SEGMENTS = 4
FREEZE_BYTES = 64 << 10


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _BASE + sql
        return f

    return add


_BASE = """
WITH muts AS (
  SELECT event_id + 1 AS lsn, 'user' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS pk,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value
  FROM events
), unit AS (SELECT greatest(100, count(*) // 10) AS f FROM events), mark AS (SELECT 8 * f AS w FROM unit),
versions AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY lsn DESC) AS rn FROM muts),
filed AS (
  SELECT * FROM (SELECT m.*, (lsn - 1) // f AS flush_id, row_number() OVER (PARTITION BY pk, (lsn - 1) // f ORDER BY lsn DESC) AS frn
  FROM muts m, unit, mark WHERE lsn <= w) WHERE frn = 1
),
files AS (SELECT flush_id, min(pk) AS pk_min, max(pk) AS pk_max, count(*) AS record_count, max(lsn) AS watermark FROM filed GROUP BY flush_id)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutation log of ``events``, with the lake's columns."""
    deleted = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 8, "0")).cast("binary").alias("pk"),
        (F.col("event_id") + 1).alias("lsn"),
        F.when(deleted, 1).otherwise(0).cast("int").alias("op"),
        F.when(~deleted, F.col("props")).cast("binary").alias("value"),
    )


def unit(spark: SparkSession, sf_dir: str) -> int:
    return max(100, table(spark, sf_dir, "events").count() // 10)


def mark(spark: SparkSession, sf_dir: str) -> int:
    return 8 * unit(spark, sf_dir)


def shown(df: DataFrame) -> DataFrame:
    """Keys and values as text."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published rows: each flush unit collapsed by key."""
    f = unit(spark, sf_dir)
    last = F.max_by(F.struct("op", "value"), "lsn").alias("last")
    rows = mutations(spark, sf_dir).where(F.col("lsn") <= 8 * f).withColumn("flush_id", F.expr(f"(lsn - 1) div {f}"))
    return rows.groupBy("flush_id", "pk").agg(F.max("lsn").alias("lsn"), last).select("flush_id", "pk", "lsn", F.col("last.op").alias("op"), F.col("last.value").alias("value"))


def described(rows: DataFrame) -> DataFrame:
    return rows.groupBy("flush_id").agg(F.min("pk").alias("pk_min"), F.max("pk").alias("pk_max"), F.count(F.lit(1)).alias("record_count"), F.max("lsn").alias("watermark"))


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share; in local mode, where all are one machine, a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/lake-{uuid.uuid4().hex}"


def log_folder(spark: SparkSession) -> str:
    """A fresh folder for a log: in the shared folder if that is mounted, else on the driver's disk, as a log's files are appended to and forced to disk, which other stores don't do."""
    return objects.Client(spark).local(scratch(spark)) or tempfile.mkdtemp(prefix="shoalkv-log-")


def scratch_lake(spark: SparkSession, **more) -> Lake:
    lake = Lake(spark, scratch(spark), **more)
    lake.bootstrap()
    return lake


def published_lake(spark: SparkSession, sf_dir: str, units: int = 8, **more) -> Lake:
    """A real lake with the first units published one after the other."""
    f, lake, rows = unit(spark, sf_dir), scratch_lake(spark, **more), mutations(spark, sf_dir)
    for k in range(1, units + 1):
        flush.publish(lake, rows, upto=k * f)
    return lake


# Log.


@query("SELECT lsn, pk, op, value FROM muts, mark WHERE lsn > w")
def wal_replay_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mutations(spark, sf_dir).where(F.col("lsn") > mark(spark, sf_dir)).select("lsn", "pk", "op", "value"))


@query(f"""SELECT (lsn - 1) // greatest(1, f // {SEGMENTS}) AS segment, min(lsn) AS start_lsn, max(lsn) AS max_lsn, count(*) AS n_rows,
       CAST(sum(25 + strlen(pk) + coalesce(strlen(value), 0)) AS BIGINT) AS n_bytes, max(lsn) <= max(w) AS truncatable
FROM muts, unit, mark GROUP BY 1""")  # fmt: skip
def wal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = unit(spark, sf_dir)
    size = F.lit(25) + F.octet_length("pk") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = mutations(spark, sf_dir).withColumn("segment", F.expr(f"(lsn - 1) div {max(1, f // SEGMENTS)}"))
    found = rows.groupBy("segment").agg(F.min("lsn").alias("start_lsn"), F.max("lsn").alias("max_lsn"), F.count(F.lit(1)).alias("n_rows"), F.sum(size).cast("long").alias("n_bytes"))
    return found.withColumn("truncatable", (F.col("max_lsn") <= 8 * f) & (F.col("max_lsn") > 0))


@query("SELECT lsn, pk, op, value FROM muts")
def wal_frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mutation framed, checksummed, and decoded again."""
    return shown(log.unframed(log.frames_of(mutations(spark, sf_dir))).select("lsn", "pk", "op", "value"))


# Memtables.


@query("SELECT pk, lsn, op, value FROM versions WHERE rn = 1")
def memtable_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(memtable.collapsed(mutations(spark, sf_dir)))


@query("SELECT CAST(sum(strlen(pk) + coalesce(strlen(value), 0) + 64) AS BIGINT) AS approx_bytes, max(lsn) AS max_lsn, count(*) AS n_rows, count(DISTINCT pk) AS n_keys FROM muts")
def memtable_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memtable.accounting(mutations(spark, sf_dir))


@query(f"""SELECT lsn, total FROM (SELECT lsn, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (ORDER BY lsn) AS BIGINT) AS total
FROM (SELECT lsn, strlen(pk) + coalesce(strlen(value), 0) + 64 AS size FROM muts)) WHERE total // {FREEZE_BYTES} > (total - size) // {FREEZE_BYTES}""")
def freeze_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LSNs at which the bytes written pass a multiple of the memtable's size."""
    sized = mutations(spark, sf_dir).select("lsn", paths.heap_size(F.col("pk"), F.col("value")).alias("size"))
    return memtable.filled(sized, FREEZE_BYTES).where(F.expr(f"total div {FREEZE_BYTES} > slot")).select("lsn", "total")


# Files and their index.


@query("SELECT flush_id, pk_min, pk_max, record_count, watermark FROM files")
def flush_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(described(filed(spark, sf_dir)))


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files as catalog tables: data files (one of them superseded), statistics per column as text, filters as text."""
    files = described(filed(spark, sf_dir))
    path = F.concat(F.lit("f"), F.col("flush_id").cast("string"), F.lit(".parquet"))
    data = files.select("flush_id", path.alias("path"), "record_count", F.when(F.col("flush_id") == 0, F.lit(2).cast("long")).alias("end_snapshot"))
    keys = files.select("flush_id", F.lit(1).alias("column_id"), F.hex("pk_min").alias("min_value"), F.hex("pk_max").alias("max_value"))
    lsns = files.select("flush_id", F.lit(2).alias("column_id"), F.lit(None).cast("string").alias("min_value"), F.col("watermark").cast("string").alias("max_value"))
    blooms = files.where("flush_id % 2 = 1").select("flush_id", F.lit(1).alias("column_id"), F.base64(F.lit(bytes(32))).alias("bloom"))
    return data, keys.unionByName(lsns), blooms


@query("""SELECT 's3://warehouse/kv/f' || flush_id || '.parquet' AS location, watermark, pk_min, pk_max, record_count, CASE WHEN flush_id % 2 = 1 THEN 32 END AS bloom_bytes
FROM files WHERE flush_id <> 0""")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files with their bounds and, where there is one, their filter; the newest first."""
    data, stats, blooms = catalog(spark, sf_dir)
    of = lambda n: stats.where(F.col("column_id") == n)
    live = data.where(F.col("end_snapshot").isNull())
    keys = of(1).select("flush_id", paths.decode_hex(F.col("min_value")).alias("pk_min"), paths.decode_hex(F.col("max_value")).alias("pk_max"))
    lsns = of(2).select("flush_id", F.col("max_value").cast("long").alias("watermark"))
    rows = live.join(keys, "flush_id").join(lsns, "flush_id").join(blooms.select("flush_id", "bloom"), "flush_id", "left")
    found = rows.select(
        paths.location(F.lit("s3://warehouse/kv/"), F.col("path")).alias("location"), "watermark", "pk_min", "pk_max", "record_count",
        F.octet_length(paths.decode_base64(F.col("bloom"))).alias("bloom_bytes"),
    )
    return shown(found).orderBy(F.desc("watermark"))


@query("SELECT coalesce(max(watermark), 0) AS watermark FROM files")
def published_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, stats, _ = catalog(spark, sf_dir)
    return stats.where("column_id = 2").join(data, "flush_id").agg(F.coalesce(F.max(F.col("max_value").cast("long")), F.lit(0)).alias("watermark"))


@query("""SELECT flush_id, max_lsn, CASE WHEN max_lsn <= w THEN 'AlreadyPublished' ELSE 'Write' END AS plan
FROM (SELECT (lsn - 1) // f AS flush_id, max(lsn) AS max_lsn FROM muts, unit GROUP BY 1), mark""")
def flush_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = unit(spark, sf_dir)
    units = mutations(spark, sf_dir).groupBy(F.expr(f"(lsn - 1) div {f}").alias("flush_id")).agg(F.max("lsn").alias("max_lsn"))
    return units.withColumn("plan", F.when(F.col("max_lsn") <= 8 * f, "AlreadyPublished").otherwise("Write"))


@query("SELECT k.pk, flush_id FROM (SELECT DISTINCT pk FROM muts) k JOIN files ON k.pk BETWEEN pk_min AND pk_max")
def interval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = mutations(spark, sf_dir).select("pk").distinct()
    return shown(views.candidates(keys, described(filed(spark, sf_dir)).select("flush_id", "pk_min", "pk_max")).select("pk", "flush_id"))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("ord"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).cast("binary")
    return table(spark, sf_dir, "orders").select(key.alias("pk"), (F.col("o_orderkey") + 1).alias("lsn"), F.expr("o_orderkey div 1000").alias("flush_id"))


@query("""SELECT o.pk, flush_id FROM (SELECT 'ord' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS pk FROM orders) o JOIN
(SELECT o_orderkey // 1000 AS flush_id, min('ord' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS pk_min, max('ord' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS pk_max
FROM orders GROUP BY 1) f ON o.pk BETWEEN pk_min AND pk_max""")
def interval_candidates_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With disjoint files, one file is left for each order looked up."""
    rows = order_keys(spark, sf_dir)
    return shown(views.candidates(rows.select("pk"), described(rows).select("flush_id", "pk_min", "pk_max")).select("pk", "flush_id"))


def _filters(rows: DataFrame) -> DataFrame:
    """file, words: a filter per file, built in parts on the executors and merged there. The driver has a count per file."""
    counts = {str(r.flush_id): bloom.blocks_for(r.n) for r in rows.groupBy("flush_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = bloom.partial_blooms(rows.select(F.col("flush_id").cast("string").alias("file"), "pk"), counts)
    return bloom.united(parts)


@query("SELECT count(*) AS n_present, CAST(0 AS BIGINT) AS n_rejected FROM filed")
def bloom_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filed(spark, sf_dir).select("flush_id", "pk")
    kept = bloom.bloom_pruned(rows.select(F.col("flush_id").cast("string").alias("file"), "pk"), _filters(rows))
    counts = rows.agg(F.count(F.lit(1)).alias("n_present"))
    return kept.agg(F.count(F.lit(1)).alias("n_kept")).join(counts, F.lit(True)).select("n_present", (F.col("n_present") - F.col("n_kept")).alias("n_rejected"))


def _filters_sql() -> str:
    """Filters and probes in SQL, for keys of three words of four bytes: murmur3 of both seeds, then block and bits."""
    byte = lambda i: f"CAST(ascii(substr(pk, {i}, 1)) AS UBIGINT)"
    low, rot = 4294967295, lambda x, by: f"((({x}) << {by}) | (({x}) >> {32 - by})) & 4294967295"
    steps = ["s0 AS (SELECT pk, seed, seed AS h, " + ", ".join(f"({byte(4 * w + 1)} | ({byte(4 * w + 2)} << 8) | ({byte(4 * w + 3)} << 16) | ({byte(4 * w + 4)} << 24)) AS k{w}" for w in range(3)) + f" FROM (SELECT DISTINCT pk FROM muts), (VALUES ({bloom.HIGH_SEED}::UBIGINT), ({bloom.LOW_SEED}::UBIGINT)) v(seed))"]
    n = 0

    def step(what: str) -> None:
        nonlocal n
        steps.append(f"s{n + 1} AS (SELECT pk, seed, {what} FROM s{n})")
        n += 1

    def times(x: str, by: int) -> str:
        return f"(({x}) * {by}::UBIGINT) & {low}"

    for w in range(3):
        rest = ", ".join(f"k{v}" for v in range(w + 1, 3))
        tail = f", {rest}" if rest else ""
        step(f"h, {times(f'k{w}', 0xCC9E2D51)} AS k{tail}")
        step(f"h, {rot('k', 15)} AS k{tail}")
        step(f"xor(h, {times('k', 0x1B873593)}) AS h{tail}")
        step(f"{rot('h', 13)} AS h{tail}")
        step(f"(h * 5 + {0xE6546B64}) & {low} AS h{tail}")
    step("xor(h, 12::UBIGINT) AS h")
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        step(f"{times(f'xor(h, h >> {shift})', by)} AS h")
    step("xor(h, h >> 16) AS h")
    salts = ", ".join(f"({i}, {int(s)}::UBIGINT)" for i, s in enumerate(bloom.SALTS))
    return ", " + ", ".join(steps) + f""", hashed AS (SELECT pk, max(h) FILTER (seed = {bloom.HIGH_SEED}) AS high, max(h) FILTER (seed = {bloom.LOW_SEED}) AS low FROM s{n} GROUP BY pk),
bits AS (SELECT pk, high, i, (((low * salt) & {low}) >> 27) AS bit FROM hashed, (VALUES {salts}) t(i, salt)),
sizes AS (SELECT flush_id, pk_min, pk_max, greatest(1, ceil(-8.0 * record_count / ln(1 - pow(0.01, 0.125)) / 256))::UBIGINT AS blocks FROM files),
lit AS (SELECT DISTINCT flush_id, (high * blocks) >> 32 AS block, i, bit FROM filed JOIN sizes USING (flush_id) JOIN bits USING (pk)),
asked AS (SELECT pk, flush_id, (high * blocks) >> 32 AS block, i, bit FROM bits JOIN sizes ON pk BETWEEN pk_min AND pk_max)
SELECT pk, flush_id FROM asked JOIN lit USING (flush_id, block, i, bit) GROUP BY pk, flush_id HAVING count(*) = 8"""


@query(_filters_sql())
def bloom_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every key, the files that interval and filter leave."""
    rows = filed(spark, sf_dir)
    index = described(rows).select(F.col("flush_id").cast("string").alias("file"), "pk_min", "pk_max")
    pairs = views.candidates(mutations(spark, sf_dir).select("pk").distinct(), index).select("file", "pk")
    return shown(bloom.bloom_pruned(pairs, _filters(rows.select("flush_id", "pk"))).select("pk", F.col("file").cast("long").alias("flush_id")))


# Reads.

_EXTREME = "(SELECT {which}(pk) FROM versions WHERE rn = 1 AND op = {op})"


def _point(spark: SparkSession, sf_dir: str, key: Column | None, op: int | None) -> DataFrame:
    rows = mutations(spark, sf_dir)
    if key is None:
        asked = memtable.collapsed(rows).where(F.col("op") == op).agg(F.min("pk").alias("pk")).where("pk is not null")
    else:
        asked = spark.range(1).select(key.cast("binary").alias("pk"))
    return shown(views.multi_get(asked, rows))


@query(f"SELECT pk, 'Found' AS status, value FROM versions WHERE rn = 1 AND pk = {_EXTREME.format(which='min', op=0)}")
def point_get_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(spark, sf_dir, None, 0)


@query(f"SELECT pk, 'Deleted' AS status, CAST(NULL AS VARCHAR) AS value FROM versions WHERE rn = 1 AND pk = {_EXTREME.format(which='min', op=1)}")
def point_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(spark, sf_dir, None, 1)


@query("SELECT 'zzz-no-such-key' AS pk, 'Missing' AS status, CAST(NULL AS VARCHAR) AS value")
def point_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(spark, sf_dir, F.lit("zzz-no-such-key"), None)


@query("""SELECT k.pk, CASE WHEN v.pk IS NULL THEN 'Missing' WHEN v.op = 1 THEN 'Deleted' ELSE 'Found' END AS status, CASE WHEN v.op = 0 THEN v.value END AS value
FROM (SELECT 'user' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS pk FROM customer) k LEFT JOIN versions v ON v.pk = k.pk AND v.rn = 1""")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys looked up among users': found, deleted and missing ones."""
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("user"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).cast("binary").alias("pk"))
    return shown(views.multi_get(keys, mutations(spark, sf_dir)))


@query("SELECT pk, lsn, op, value, flush_id AS file FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY flush_id DESC) AS r FROM filed) WHERE r = 1")
def newest_file_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filed(spark, sf_dir)
    marks = described(rows).select("flush_id", "watermark")
    return shown(views.newest_file_first(rows.join(marks, "flush_id").withColumnRenamed("flush_id", "file")))


@query("SELECT pk, lsn, op, value FROM versions WHERE rn = 1")
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memtable's keys, and below them the files' newest rows for all others."""
    upper = memtable.collapsed(mutations(spark, sf_dir).where(F.col("lsn") > mark(spark, sf_dir)))
    return shown(views.tiered(memtable.collapsed(filed(spark, sf_dir).select(*MUTATION.names)), upper))


# Views.


@query("SELECT pk, lsn, value FROM versions WHERE rn = 1 AND op = 0")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and log suffix as one, resolved by LSN."""
    versions = views.history(filed(spark, sf_dir).select(*MUTATION.names), mutations(spark, sf_dir), mark(spark, sf_dir))
    return shown(views.current(versions))


@query("""SELECT pk, lsn, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY lsn DESC) AS r FROM (SELECT m.* FROM muts m, mark WHERE lsn <= w)) WHERE r = 1 AND op = 0""")
def stale_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.as_of(mutations(spark, sf_dir), mark(spark, sf_dir)))


@query("SELECT pk, lsn FROM versions WHERE rn = 1 AND op = 1")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.tombstones(mutations(spark, sf_dir)))


@query("SELECT pk, lsn, op, value, rn AS depth FROM versions WHERE rn > 1")
def shadowed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(views.shadowed(mutations(spark, sf_dir)).select("pk", "lsn", "op", "value", F.col("depth").cast("long").alias("depth")))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(event_type = 'error' AS INT) AS op, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM events, mark WHERE event_id + 1 <= w GROUP BY ALL")
def stale_olap_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analytic query at the watermark, beside the key-value reads."""
    rows = table(spark, sf_dir, "events").where(F.col("event_id") + 1 <= mark(spark, sf_dir))
    return rows.groupBy(F.to_date("ts").cast("string").alias("day"), (F.col("event_type") == "error").cast("int").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_keys"))


# Publishing, for real: lakes in the scratch folder.


@query("SELECT pk, lsn, value FROM versions WHERE rn = 1 AND op = 0")
def lake_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight units published into a lake; its files and the suffix."""
    lake = published_lake(spark, sf_dir)
    return shown(views.recovered(lake.rows(), mutations(spark, sf_dir), lake.watermark()))


@query("SELECT CAST(0 AS BIGINT) AS n_different")
def recovery_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = published_lake(spark, sf_dir)
    rows = mutations(spark, sf_dir)
    return views.differences(views.recovered(lake.rows(), rows, lake.watermark()), views.current(rows))


@query("SELECT count(*) AS n_rows, max(watermark) AS watermark, 8 AS n_files FROM filed JOIN files USING (flush_id)")
def idempotent_republish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every publish is repeated; the lake holds each unit once."""
    f, lake, rows = unit(spark, sf_dir), scratch_lake(spark), mutations(spark, sf_dir)
    for k in range(1, 9):
        for _ in range(2):
            flush.publish(lake, rows, upto=k * f)
    return lake.rows().agg(F.count(F.lit(1)).alias("n_rows"), F.max("lsn").alias("watermark")).withColumn("n_files", F.lit(len(lake.index())))


@query("SELECT pk, lsn, value FROM versions WHERE rn = 1 AND op = 0")
def compacted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files merged into disjoint ones; tombstones and shadowed versions are gone, the live keys aren't."""
    lake, rows = scratch_lake(spark), mutations(spark, sf_dir)
    f = unit(spark, sf_dir)
    for k in (4, 8, 11):
        flush.publish(lake, rows, upto=k * f)
    lake.compact(files=2)
    return shown(lake.rows().select("pk", "lsn", "value"))


@query("SELECT pk, lsn, value FROM versions WHERE rn = 1 AND op = 0")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files of rising LSNs, streamed and published micro-batch by micro-batch."""
    lake, f = scratch_lake(spark), unit(spark, sf_dir)
    staged = f"{lake.root}/arrivals"
    rows = mutations(spark, sf_dir)
    for k in range(4):
        part = rows.where(F.expr(f"(lsn - 1) div {3 * f}") == k)
        part.coalesce(1).write.mode("append").parquet(staged)
    stream = spark.readStream.schema(PLAIN).option("maxFilesPerTrigger", 1).parquet(staged)
    ingest.ingest(stream, lake, f"{lake.root}/progress").awaitTermination()
    return shown(views.current(lake.rows()))


# Catalog text, latency, bench.


@query("""SELECT path, CASE WHEN path LIKE 's3://%' THEN regexp_extract(path, '^s3://([^/]*)', 1) END AS bucket,
CASE WHEN path LIKE 's3://%' THEN regexp_extract(path, '^s3://[^/]*/?(.*)$', 1) END AS prefix, ltrim(regexp_replace(path, '^s3://[^/]*/?', ''), '/') AS object
FROM (SELECT unnest(['s3://warehouse/kv/', 's3://warehouse/', 's3://warehouse', '/local/path', 's3://b/a/b.parquet']) AS path
UNION ALL SELECT 's3://' || r_name || '/n/' || r_regionkey AS path FROM region)""")
def catalog_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.sql("SELECT explode(array('s3://warehouse/kv/', 's3://warehouse/', 's3://warehouse', '/local/path', 's3://b/a/b.parquet')) AS path")
    made = table(spark, sf_dir, "region").select(F.concat(F.lit("s3://"), "r_name", F.lit("/n/"), F.col("r_regionkey").cast("string")).alias("path"))
    path = F.col("path")
    return fixed.unionByName(made).select("path", paths.bucket_of(path).alias("bucket"), paths.prefix_of(path).alias("prefix"), paths.object_path(path).alias("object"))


@query("""SELECT t.table_id, s.path AS schema_path, t.path AS table_path FROM (SELECT n_nationkey AS table_id, n_regionkey AS schema_id, n_name AS table_name, lower(n_name) || '/' AS path,
CASE WHEN n_nationkey % 5 = 0 THEN 3 END AS end_snapshot FROM nation) t JOIN (SELECT r_regionkey AS schema_id, r_name AS schema_name, lower(r_name) || '/' AS path FROM region) s USING (schema_id) WHERE t.end_snapshot IS NULL""")
def table_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live tables with the paths of their schemas; the catalog's tables are stood in for by nations within regions."""
    tables = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("table_id"), F.col("n_regionkey").alias("schema_id"), F.concat(F.lower("n_name"), F.lit("/")).alias("table_path"), F.when(F.col("n_nationkey") % 5 == 0, 3).alias("end_snapshot"))
    schemas = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("schema_id"), F.concat(F.lower("r_name"), F.lit("/")).alias("schema_path"))
    return tables.where("end_snapshot is null").join(schemas, "schema_id").select("table_id", "schema_path", "table_path")


_LATENCY_ROWS = ", ".join(f"('{p}', '{op}', {a}.0, {b}.0)" for p, ops in latency.PROFILES.items() for op, (a, b) in ops.items())


@query(f"""SELECT profile, op, CAST(p50 AS DOUBLE) AS median, round(CASE WHEN p50 > 0 AND p99 > p50 THEN ln(CAST(p99 AS DOUBLE) / p50) / {latency.Z99} ELSE 0 END, 9) AS sigma
FROM (VALUES {_LATENCY_ROWS}) t(profile, op, p50, p99)""")
def latency_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latency.profiles(spark)
    return rows.select("profile", "op", F.col("p50").alias("median"), F.round(latency.sigma(F.col("p50"), F.col("p99")), 9).alias("sigma"))


@query("SELECT 'get' AS op, true AS median_holds, true AS tail_holds, true AS no_cost_without_profile")
def latency_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of the model come within 1 ms of its p50 and 4 ms of its p99."""
    draws = latency.charged(spark.range(200_000).withColumn("op", F.lit("get")), "s3", 5)
    free = latency.charged(spark.range(10).withColumn("op", F.lit("get")), "none", 5).agg(F.sum("ms").alias("free"))
    got = draws.agg(F.percentile_approx("ms", F.lit(0.5), F.lit(10000)).alias("p50"), F.percentile_approx("ms", F.lit(0.99), F.lit(10000)).alias("p99"))
    return got.join(free, F.lit(True)).select(F.lit("get").alias("op"), (F.abs(F.col("p50") - 26) <= 1).alias("median_holds"), (F.abs(F.col("p99") - 86) <= 4).alias("tail_holds"), (F.col("free") == 0).alias("no_cost_without_profile"))


@query("""SELECT v[CAST(least(floor(n * 0.5), n - 1) AS BIGINT) + 1] AS p50, v[CAST(least(floor(n * 0.99), n - 1) AS BIGINT) + 1] AS p99, v[CAST(least(floor(n * 0.999), n - 1) AS BIGINT) + 1] AS p999
FROM (SELECT list_sort(list(value)) AS v, count(value) AS n FROM events)""")
def bench_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.exact_percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p99": 0.99, "p999": 0.999})


#: Published points of the sweep: arm, working set over cache, p99 in milliseconds.
SWEEP = [("R1", 0.5, 0.7), ("R1", 1.0, 0.6), ("R1", 2.0, 432.4), ("R1", 4.0, 712.8), ("R1", 8.0, 823.4), ("R2", 0.5, 0.9), ("R2", 1.0, 0.8), ("R2", 2.0, 117.4), ("R2", 4.0, 160.5), ("R2", 8.0, 151.9), ("R2", 16.0, 138.7), ("R2", 32.0, 132.3)]
_SWEEP_ROWS = ", ".join(f"('{a}', CAST({r} AS DOUBLE), CAST({p} AS DOUBLE))" for a, r, p in SWEEP)


@query(f"SELECT arm, max(ratio) FILTER (p99 <= 10) AS last_ok, min(ratio) FILTER (p99 > 10) AS first_bad FROM (VALUES {_SWEEP_ROWS}) t(arm, ratio, p99) GROUP BY arm")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.envelope(spark.sql(f"SELECT * FROM VALUES {_SWEEP_ROWS} AS t(arm, ratio, p99)"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a read of a column chunk of its user's row group, through a cache per event type."""
    group = F.col("user_id") % 40
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("path"), (group * 1000).alias("start"), (group * 1000 + 500 + F.col("user_id") % 7).alias("end"))


def _lru_sql(reads: str, points: str) -> str:
    """An LRU cache without one: a range is cached if all that was read since its last read, and itself, fit. ``points``: cache, cap."""
    return f""", reads AS ({reads}), placed AS (
  SELECT cache, cap, size, row_number() OVER o AS i, lag(seq) OVER p AS before, lead(seq) OVER p AS after, seq, size <= cap AS fits FROM reads JOIN ({points}) USING (cache)
  WINDOW o AS (PARTITION BY cache, cap ORDER BY seq), p AS (PARTITION BY cache, cap, path, g, size ORDER BY seq)
), met AS (
  SELECT a.cache, a.cap, a.seq, any_value(a.size) AS size, any_value(a.fits) AS fits, any_value(a.before) AS before, coalesce(sum(b.size), 0) AS since
  FROM placed a LEFT JOIN placed b ON a.cache = b.cache AND a.cap = b.cap AND b.fits AND b.seq > a.before AND b.seq < a.seq AND (b.after IS NULL OR b.after > a.seq) GROUP BY a.cache, a.cap, a.seq
), hit AS (SELECT *, before IS NOT NULL AND fits AND since + size <= cap AS is_hit FROM met),
kept AS (SELECT a.cache, a.cap, a.seq, any_value(a.size) AS size FROM placed a LEFT JOIN placed b ON a.cache = b.cache AND a.cap = b.cap AND b.fits AND b.after IS NULL AND b.seq > a.seq
  WHERE a.after IS NULL AND a.fits GROUP BY a.cache, a.cap, a.seq HAVING coalesce(sum(b.size), 0) + any_value(a.size) <= any_value(a.cap)),
left_ AS (SELECT cache, cap, count(*) AS n, sum(size) AS bytes FROM kept GROUP BY ALL),
told AS (SELECT cache, cap, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses, CAST(coalesce(sum(size) FILTER (NOT is_hit), 0) AS BIGINT) AS bytes_fetched,
  count(*) FILTER (NOT is_hit AND fits) - any_value(coalesce(left_.n, 0)) AS evictions, CAST(any_value(coalesce(left_.bytes, 0)) AS BIGINT) AS resident_bytes FROM hit LEFT JOIN left_ USING (cache, cap) GROUP BY cache, cap)
"""


_READS = "SELECT event_type AS cache, event_id AS seq, user_id % 20 AS path, user_id % 40 AS g, 500 + user_id % 7 AS size FROM events"


@query(_lru_sql(_READS, "SELECT DISTINCT event_type AS cache, 10000 AS cap FROM events") + "SELECT cache, hits, misses, bytes_fetched, evictions, resident_bytes FROM told")
def cache_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.simulated(trace(spark, sf_dir), 10_000)


@query("""SELECT cache, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT event_type AS cache, user_id % 20 AS path, user_id % 40 AS g, 500 + user_id % 7 AS size FROM events) GROUP BY cache""")
def working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.working_set(trace(spark, sf_dir))


@query("SELECT 'key' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS pk, o_orderkey // 10000 AS file, o_orderkey + 1 AS lsn, 256 AS value_bytes FROM orders")
def bench_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bench's table in sequential order: formatted keys, constant values, 10,000 keys to a file."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    value = F.repeat(F.lit("v"), 256)
    return rows.select(paths.bench_key(F.col("o_orderkey")).alias("pk"), F.expr("o_orderkey div 10000").alias("file"), (F.col("o_orderkey") + 1).alias("lsn"), F.octet_length(value).alias("value_bytes"))


@query("SELECT lsn, hex(encode(pk)) AS pk_hex, pk AS pk_back, padded FROM (SELECT lsn, pk, lpad(CAST(lsn AS VARCHAR), 20, '0') AS padded FROM muts)")
def key_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex and back, and padded names."""
    rows = mutations(spark, sf_dir).select("lsn", F.hex("pk").alias("pk_hex"))
    return rows.select("lsn", "pk_hex", paths.decode_hex(F.col("pk_hex")).cast("string").alias("pk_back"), paths.padded(F.col("lsn")).alias("padded"))


@query("""SELECT n_nationkey AS table_id, lower(r_name) || '/' AS schema_path, lower(n_name) || '/' AS table_path FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_name = (SELECT max(n_name) FROM nation) AND r_name = (SELECT max(r_name) FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name = (SELECT max(n_name) FROM nation))""")
def table_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table by schema and name, as bound parameters."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name, home = nation.agg(F.max(F.struct("n_name", "n_regionkey")).alias("m")).select("m.*").first()
    schema = region.where(F.col("r_regionkey") == home).first().r_name
    return spark.sql(
        "SELECT n_nationkey AS table_id, lower(r_name) || '/' AS schema_path, lower(n_name) || '/' AS table_path FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_name = :name AND r_name = :schema",
        args={"name": name, "schema": schema}, nation=nation, region=region,
    )


@query("SELECT pk, ord FROM (SELECT *, row_number() OVER (ORDER BY ord, pk) AS r FROM (SELECT 'key' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS pk, md5('11:' || o_orderkey) AS ord FROM orders)) WHERE r <= 500")
def hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bench's hot set: 500 keys without replacement, in a seeded random order; a top-k, not a sort of the table."""
    rows = table(spark, sf_dir, "orders").select(paths.bench_key(F.col("o_orderkey")).alias("pk"), F.md5(F.concat(F.lit("11:"), F.col("o_orderkey").cast("string")).cast("binary")).alias("ord"))
    return rows.orderBy("ord", "pk").limit(500)


RATIOS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
_POINTS = f"SELECT 'all' AS cache, ratio, CAST(floor(bytes / ratio) AS BIGINT) AS cap FROM (SELECT sum(size) AS bytes FROM (SELECT DISTINCT path, g, size FROM ({_READS}))), (VALUES {', '.join(f'(CAST({r} AS DOUBLE))' for r in RATIOS)}) v(ratio)"


@query(_lru_sql(_READS.replace("event_type AS cache", "'all' AS cache"), _POINTS) + f"""SELECT ratio, hits + misses AS reads, CAST(hits AS DOUBLE) / (hits + misses) AS hit_rate, CAST(misses AS DOUBLE) / (hits + misses) AS fetches_per_read, evictions
FROM told JOIN ({_POINTS}) USING (cache, cap)""")
def cache_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bench's sweep over cache sizes: by working set over cache, the hit rate and the fetches per read. Only measured reads count."""
    reads = trace(spark, sf_dir).withColumn("cache", F.lit("all"))
    whole = cache.working_set(reads).first().bytes
    points = [cache.simulated(reads, int(whole / r)).withColumn("ratio", F.lit(r)) for r in RATIOS]
    out = points[0]
    for p in points[1:]:
        out = out.unionByName(p)
    n = F.col("hits") + F.col("misses")
    return out.select("ratio", n.alias("reads"), (F.col("hits") / n).alias("hit_rate"), (F.col("misses") / n).alias("fetches_per_read"), "evictions")


@query("SELECT * FROM (VALUES ('data', 'parquet', true), ('manifest', 'json', true)) t(part, kind, filled)")
def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake's objects after one publish: one data file, its side files, and the manifest."""
    lake = published_lake(spark, sf_dir, units=1)
    found = objects.listing(spark, lake.root)
    return found.select(F.regexp_extract("path", "/(data|manifest|compaction)/", 1).alias("part"), F.element_at(F.split("path", "[.]"), -1).alias("kind"), (F.col("size") > 0).alias("filled"))


# The engine itself, over real logs and lakes.


def _engine(spark: SparkSession, **more) -> tuple[Config, Engine]:
    config = Config(root=scratch(spark), wal_dir=log_folder(spark), memtable_max_bytes=1 << 30, **more)
    bootstrap(spark, config)
    return config, Engine.open(spark, config)


@query("""SELECT n_name AS pk, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 7 = 0 OR n_nationkey % 5 <> 0 THEN 'Found' ELSE 'Deleted' END AS status,
CASE WHEN n_nationkey % 3 = 0 THEN 'late' WHEN n_nationkey % 7 = 0 THEN 'new' || n_nationkey WHEN n_nationkey % 5 <> 0 THEN 'r' || n_regionkey END AS value,
(SELECT count(*) + count(*) FILTER (n_nationkey % 5 = 0) + count(*) FILTER (n_nationkey % 7 = 0) FROM nation) AS watermark, 2 AS n_files FROM nation
UNION ALL SELECT 'zzz', 'Missing', NULL, (SELECT count(*) + count(*) FILTER (n_nationkey % 5 = 0) + count(*) FILTER (n_nationkey % 7 = 0) FROM nation), 2""")
def engine_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put, flush, delete, a crash after the files are written, recovery, flush, put, recovery: what each key's lookup then finds."""
    rows = [(r.n_nationkey, r.n_name, r.n_regionkey) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").toLocalIterator()]
    config, engine = _engine(spark)
    engine.put_all([(name.encode(), b"r%d" % region) for _, name, region in rows])
    engine.flush()
    for i, name, _ in rows:
        if i % 5 == 0:
            engine.delete(name.encode())
    engine.put_all([(name.encode(), b"new%d" % i) for i, name, _ in rows if i % 7 == 0])
    try:
        engine.flush(flush.CrashAt.AFTER_WRITE)
    except CrashInjected:
        engine.close()
    engine = Engine.open(spark, config)
    engine.flush()
    engine.put_all([(name.encode(), b"late") for i, name, _ in rows if i % 3 == 0])
    engine.close()
    engine = Engine.open(spark, config)
    found = [(key, engine.lookup(key.encode())) for key in [*(name for _, name, _ in rows), "zzz"]]
    mark_, files = engine.watermark, engine.file_count
    engine.close()
    shown_ = [(key, x.kind.value, None if x.value is None else x.value.decode(), mark_, files) for key, x in found]
    return spark.createDataFrame(shown_, "pk string, status string, value string, watermark long, n_files int")


#: Row groups of the lake that the point reads go to, in rows.
GROUP = 16


@query(f"""SELECT k.pk, CASE WHEN f.pk IS NULL THEN 'Missing' WHEN f.op = 1 THEN 'Deleted' ELSE 'Found' END AS status, CASE WHEN f.op = 0 THEN f.value END AS value,
(SELECT count(*) FROM files WHERE k.pk BETWEEN pk_min AND pk_max) AS n_candidates, true AS bounded
FROM (SELECT min(pk) AS pk FROM filed UNION SELECT max(pk) FROM filed UNION SELECT min(pk) FROM filed WHERE op = 1 UNION SELECT min(pk) || 'x' FROM filed UNION SELECT 'zzz') k
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY flush_id DESC) AS r FROM filed) WHERE r = 1) f ON f.pk = k.pk WHERE k.pk IS NOT NULL""")
def file_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys looked up in the published files by interval, filter, footer, row group and column chunk. ``bounded``: two ranges
    a file's footer and three a row group at most, one row group a file, and nothing is fetched again for the same key."""
    lake = published_lake(spark, sf_dir, row_group_rows=GROUP)
    rows = filed(spark, sf_dir)
    ends = rows.agg(F.min("pk").alias("a"), F.max("pk").alias("b"), F.min(F.when(F.col("op") == Op.DELETE, F.col("pk"))).alias("c")).first()
    keys = sorted({bytes(x) for x in ends if x is not None} | {bytes(ends.a) + b"x", b"zzz"})
    index, reader, out = lake.index(), Reader(lake.client, cache.RangeCache(64 << 20)), []
    for key in keys:
        lake.client.reset()
        reader.files = reader.row_groups = 0
        found, fetched = memtable.MISSING, []
        for _ in range(2):
            for entry in index.candidates(key):
                if entry.bloom_may_contain(key) and (found := reader.lookup(entry.location, entry.file_size, key)) is not memtable.MISSING:
                    break
            fetched.append(lake.client.counts["get"])
        bounded = fetched[0] <= 2 * reader.files + 3 * reader.row_groups and reader.row_groups <= reader.files and fetched[0] == fetched[1]
        out.append((key.decode(), found.kind.value, None if found.value is None else found.value.decode(), len(index.candidates(key)), bounded))
    return spark.createDataFrame(out, "pk string, status string, value string, n_candidates long, bounded boolean")


@query("SELECT s_suppkey + 1 AS lsn, 'supp' || s_suppkey AS pk, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS op, CASE WHEN s_suppkey % 4 <> 0 THEN 'n' || s_nationkey END AS value, true AS ordered FROM supplier WHERE s_suppkey + 1 > (SELECT max(s_suppkey) // 3 + 1 FROM supplier)")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers appended to a log of small segments, its first third truncated, its tail torn: opened again above the watermark, and decoded as a DataFrame."""
    folder, shared, client = log_folder(spark), scratch(spark), objects.Client(spark)
    writer, _ = log.Log.open(folder, 512)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").orderBy("s_suppkey")
    highest = 0
    for r in rows.toLocalIterator():
        key, highest = b"supp%d" % r.s_suppkey, r.s_suppkey
        writer.append([Record.delete(key, r.s_suppkey + 1) if r.s_suppkey % 4 == 0 else Record.put(key, r.s_suppkey + 1, b"n%d" % r.s_nationkey)])
    writer.truncate_through(highest // 3 + 1)
    last = writer.active.path
    writer.close()
    with open(last, "ab") as torn:
        torn.write(b"\x01\x02\x03")
    reopened, replay = log.Log.open(folder, 512, highest // 3 + 1)
    starts = [x.start_lsn for x in log.list_segments(reopened.folder)]
    ordered = starts == sorted(starts) and replay.max_lsn == highest + 1 and reopened.size_bytes() == sum(x.path.stat().st_size for x in log.list_segments(reopened.folder))
    reopened.close()
    known = [(r.lsn,) for r in replay.records]
    for segment in log.list_segments(reopened.folder):  # the executors may not reach the log's own folder
        client.put(f"{shared}/{segment.path.name}", segment.path.read_bytes())
    both = log.log_frame(spark, shared, highest // 3 + 1).join(spark.createDataFrame(known, "lsn long"), "lsn")  # what the writer's replay and the executors' decoding agree on
    return shown(both.select("lsn", "pk", "op", "value", F.lit(ordered).alias("ordered")))


@query("SELECT 'r' || r_regionkey || CASE WHEN copied THEN '-copy' ELSE '' END AS name, CAST(strlen(r_name) AS BIGINT) AS size, r_name AS content FROM region, (VALUES (false), (true)) v(copied) WHERE copied OR r_regionkey % 2 = 0")
def object_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects put, read, copied and deleted, and what the store then lists and holds."""
    client, folder = objects.Client(spark), scratch(spark)
    rows = [(r.r_regionkey, r.r_name) for r in table(spark, sf_dir, "region").toLocalIterator()]
    for i, name in rows:
        client.put(f"{folder}/r{i}", name.encode())
        client.copy(f"{folder}/r{i}", f"{folder}/r{i}-copy")
        if i % 2:
            client.delete(f"{folder}/r{i}")
    out = [(name, client.head(f"{folder}/{name}")[0], client.get(f"{folder}/{name}").decode()) for name, _ in client.list(folder)]
    return spark.createDataFrame(out, "name string, size long, content string")


@query("SELECT * FROM (VALUES ('data', 'put', 1), ('manifest', 'put', 1), ('data', 'get', 5)) t(part, op, n)")
def request_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a flush writes, and what a cold and a warm read of it fetch: a data file and a manifest; two ranges of the footer and three chunks."""
    _, engine = _engine(spark)
    engine.put_all([(b"k%04d" % i, b"v" * 64) for i in range(100)])
    with engine.lake.client.trace() as seen:
        engine.flush()
        for _ in range(2):
            engine.get(b"k0050")
    engine.close()
    found = spark.createDataFrame([("manifest" if "/manifest" in path else "data", op) for op, path, *_ in seen], "part string, op string")
    return found.where("op = 'put' or (op = 'get' and part = 'data')").groupBy("part", "op").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('pk', 1, 0, 'BYTE_ARRAY'), ('lsn', 2, 1, 'INT64'), ('op', 3, 2, 'INT32'), ('value', 4, 3, 'BYTE_ARRAY')) t(name, field_id, ord, kind)")
def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a published file in their order, with their field ids, from its footer."""
    lake = published_lake(spark, sf_dir, units=1)
    entry = lake.index().entries[0]
    metadata = Reader(lake.client, cache.RangeCache(1 << 20)).footer(entry.location, entry.file_size).metadata
    fields = metadata.schema.to_arrow_schema()
    rows = [(f.name, int(f.metadata[b"PARQUET:field_id"]), i, metadata.schema.column(i).physical_type) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "name string, field_id int, ord int, kind string").orderBy("ord")


@query("SELECT pk, r // 10000 AS file, lsn FROM (SELECT 'key' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS pk, o_orderkey + 1 AS lsn, row_number() OVER (ORDER BY md5('5:' || o_orderkey), o_orderkey) - 1 AS r FROM orders)")
def bench_table_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bench's table in seeded random order, 10,000 keys to a file. Places are counted within ranges of the hash, and the ranges' counts summed before them."""
    order = F.md5(F.concat(F.lit("5:"), F.col("o_orderkey").cast("string")).cast("binary"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", order.alias("ord")).withColumn("part", F.substring("ord", 1, 3))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # 4,096 rows at most
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("ord", "o_orderkey")) - 1
    placed = rows.join(F.broadcast(before), "part").withColumn("place", place)
    return placed.select(paths.bench_key(F.col("o_orderkey")).alias("pk"), F.expr("place div 10000").alias("file"), (F.col("o_orderkey") + 1).alias("lsn"))
