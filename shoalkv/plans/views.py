"""Views of the store as DataFrames: the published files and the log's suffix as one table.

Every view takes ``lake`` (rows of the published files) and ``suffix`` (mutations above the watermark), and
resolves a key by its highest LSN. Since LSNs are unique, this equals searching the newest tier first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.memtable import collapsed


def history(lake: DataFrame, suffix: DataFrame, watermark: int) -> DataFrame:
    """Every version there is; the suffix counts from above the watermark only."""
    return lake.unionByName(suffix.where(F.col("lsn") > watermark))


def latest(versions: DataFrame) -> DataFrame:
    """The last mutation of each key, tombstones included."""
    return collapsed(versions)


def current(versions: DataFrame) -> DataFrame:
    """The live keys. The operation tells a tombstone, never the value: an empty value is a value."""
    return latest(versions).where("op = 0").select("pk", "lsn", "value")


def tombstones(versions: DataFrame) -> DataFrame:
    return latest(versions).where("op = 1").select("pk", "lsn")


def as_of(mutations: DataFrame, watermark: int) -> DataFrame:
    """The live keys as an external reader of the lake sees them at a watermark."""
    return current(mutations.where(F.col("lsn") <= watermark))


#: LSNs of one window over a key's versions.
LSN_RANGE = 1 << 20


def shadowed(versions: DataFrame, unit: int = LSN_RANGE) -> DataFrame:
    """Versions that a newer one of their key hides, with ``depth``: 1 is the newest, which isn't among them.

    No window holds a hot key: versions are numbered within ranges of ``unit`` LSNs, and to that comes the number of the key's
    versions in later ranges, a row per key and range."""
    ranged = versions.withColumn("slot", F.floor(F.col("lsn") / unit))
    counts = ranged.groupBy("pk", "slot").agg(F.count(F.lit(1)).alias("n"))
    above = counts.select("pk", "slot", (F.sum("n").over(Window.partitionBy("pk").orderBy(F.desc("slot"))) - F.col("n")).alias("above"))
    within = F.row_number().over(Window.partitionBy("pk", "slot").orderBy(F.desc("lsn")))
    placed = ranged.withColumn("place", within).join(above, ["pk", "slot"])
    return placed.select(*versions.columns, (F.col("place") + F.col("above")).alias("depth")).where("depth > 1")


def newest_file_first(files: DataFrame) -> DataFrame:
    """``files`` has rows with ``file`` and ``watermark``: each key's row in the newest file that has it."""
    first = F.max_by(F.struct("lsn", "op", "value", "file"), "watermark").alias("hit")
    return files.groupBy("pk").agg(first).select("pk", "hit.*")


def tiered(lake: DataFrame, memtable: DataFrame) -> DataFrame:
    """Fall through to the lake only for keys the memtable has never met; ``memtable`` is collapsed, with its tombstones."""
    older = lake.join(memtable.select("pk"), "pk", "left_anti")
    return memtable.unionByName(older)


def status(op: Column, met: Column) -> Column:
    return F.when(met.isNull(), "Missing").when(op == 1, "Deleted").otherwise("Found")


def multi_get(keys: DataFrame, versions: DataFrame) -> DataFrame:
    """Each key of ``keys`` (repeats included) with ``status`` and ``value``. The versions are cut down to the keys asked for
    before they are resolved."""
    asked = keys.select("pk")
    last = latest(versions.join(asked.distinct(), "pk", "left_semi"))
    found = asked.join(last.withColumn("met", F.lit(True)), "pk", "left")
    return found.select("pk", status(F.col("op"), F.col("met")).alias("status"), F.when(F.col("op") == 0, F.col("value")).alias("value"))


#: Cuts of the key space (keys on the driver), rows of the cut index that are sent to every scan, and shares that a segment's keys are dealt into beyond that.
CUTS, SENT, SHARES = 255, 1_000_000, 64


def _segment(key: Column, cuts: list[bytes], first: int = 0) -> Column:
    """How many of the ascending cuts are at or below the key, by a tree of comparisons."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(key < F.lit(cuts[half]), _segment(key, cuts[:half], first)).otherwise(_segment(key, cuts[half + 1 :], first + half + 1))


def candidates(keys: DataFrame, index: DataFrame) -> DataFrame:
    """The files whose interval holds each key, for keys in bulk. The index has a row per file; keep filters out of it.

    The key space is cut at lower bounds of files (which of them only tells on the speed), each file stands in all segments that its
    interval meets, and a key meets the files of its own segment: an equality join with the interval as a condition on top. Up to ``SENT`` rows
    of the index are sent to the scans of the keys; beyond that keys and files are shuffled, each segment's keys in ``SHARES`` shares."""
    bounds = index.select("pk_min").where("pk_min is not null").distinct()
    cuts = sorted(bytes(r.pk_min) for r in bounds.orderBy(F.xxhash64("pk_min")).limit(CUTS).collect())
    ends = _segment(F.col("pk_min"), cuts), _segment(F.col("pk_max"), cuts)
    cut = index.where("pk_min <= pk_max").withColumn("segment", F.explode(F.sequence(*ends)))
    asked = keys.withColumn("segment", _segment(F.col("pk"), cuts))
    on = ["segment"]
    if cut.limit(SENT + 1).count() <= SENT:
        cut = F.broadcast(cut)
    else:
        asked = asked.withColumn("share", F.pmod(F.xxhash64("pk"), F.lit(SHARES)))
        cut = cut.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        on.append("share")
    return asked.join(cut, on).where(F.col("pk").between(F.col("pk_min"), F.col("pk_max"))).drop(*on)


def recovered(lake: DataFrame, log: DataFrame, watermark: int) -> DataFrame:
    """What a reopened engine sees: the lake, and the log above its watermark."""
    return current(history(lake, log, watermark))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as one count."""
    both = a.exceptAll(b).unionByName(b.exceptAll(a))
    return both.agg(F.count(F.lit(1)).alias("n_different"))
