"""Memtables: the newest mutation per key, by LSN and not by arrival.

``Memtable`` and ``MemtableSet`` hold the writer's unpublished rows on the driver, bounded by
freezing and back-pressure. ``collapsed`` and ``accounting`` are the same rules over DataFrames of any size.
"""

from __future__ import annotations

import threading
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import heap_size
from ..schema import Op, WriteStalled
from ..sources.frames import Record


class Found(Enum):
    FOUND = "Found"
    DELETED = "Deleted"
    MISSING = "Missing"


@dataclass(frozen=True)
class Lookup:
    """A tombstone ends a search; only a key that was never met falls through to older tiers."""

    kind: Found
    value: bytes | None = None

    @classmethod
    def of(cls, op: int, value: bytes | None) -> Lookup:
        return DELETED if op == Op.DELETE else cls(Found.FOUND, value if value is not None else b"")


DELETED, MISSING = Lookup(Found.DELETED), Lookup(Found.MISSING)


class Memtable:
    def __init__(self):
        self._rows: dict[bytes, Record] = {}
        self._keys: list[bytes] = []
        self.approx_bytes = self.max_lsn = 0

    def insert(self, record: Record) -> None:
        """A lower or equal LSN loses, but still counts in the bytes and the highest LSN."""
        self.approx_bytes += record.heap_size
        self.max_lsn = max(self.max_lsn, record.lsn)
        old = self._rows.get(record.pk)
        if old is None:
            insort(self._keys, record.pk)
        elif old.lsn >= record.lsn:
            return
        self._rows[record.pk] = record

    def get(self, pk: bytes) -> Lookup:
        found = self._rows.get(pk)
        return MISSING if found is None else Lookup.of(found.op, found.value)

    def __iter__(self) -> Iterator[Record]:
        """By key, in byte order."""
        return (self._rows[k] for k in self._keys)

    def __len__(self) -> int:
        return len(self._rows)


@dataclass
class MemtableSet:
    max_bytes: int
    max_frozen: int
    active: Memtable = field(default_factory=Memtable)
    frozen: list[Memtable] = field(default_factory=list)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def insert(self, record: Record) -> None:
        with self._lock:
            self.active.insert(record)

    def get(self, pk: bytes) -> Lookup:
        for table in [self.active, *reversed(self.frozen)]:
            if (found := table.get(pk)) is not MISSING:
                return found
        return MISSING

    @property
    def should_freeze(self) -> bool:
        return self.active.approx_bytes >= self.max_bytes

    @property
    def stalled(self) -> bool:
        return len(self.frozen) >= self.max_frozen

    def freeze(self) -> Memtable | None:
        """The active table, now frozen; None if it was empty. Too many frozen ones stall the writer, empty or not."""
        with self._lock:
            if self.stalled:
                raise WriteStalled(len(self.frozen))
            if not len(self.active):
                return None
            done, self.active = self.active, Memtable()
            self.frozen.append(done)
            return done

    def retire(self, table: Memtable) -> None:
        with self._lock:
            self.frozen = [t for t in self.frozen if t is not table]

    @property
    def approx_bytes(self) -> int:
        return self.active.approx_bytes + sum(t.approx_bytes for t in self.frozen)


def collapsed(mutations: DataFrame) -> DataFrame:
    """One row per key, the one with the highest LSN; tombstones stay. Partial sums before the one shuffle, by key."""
    last = F.max_by(F.struct("op", "value"), "lsn").alias("last")
    return mutations.groupBy("pk").agg(F.max("lsn").alias("lsn"), last).select("pk", "lsn", F.col("last.op").alias("op"), F.col("last.value").alias("value"))


def accounting(mutations: DataFrame) -> DataFrame:
    """Over uncollapsed rows: bytes, the highest LSN, rows, and distinct keys."""
    return mutations.agg(
        F.coalesce(F.sum(heap_size(F.col("pk"), F.col("value"))), F.lit(0)).alias("approx_bytes"),
        F.coalesce(F.max("lsn"), F.lit(0)).alias("max_lsn"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("pk").alias("n_keys"),
    )


def filled(mutations: DataFrame, limit: int, size: str = "size", unit: int = 1 << 20) -> DataFrame:
    """Adds ``total``: the running sum of ``size`` by LSN, and ``slot`` = its multiple of ``limit`` before this row.

    The sum isn't one window over the log: LSN ranges of ``unit`` are summed first, their sums are accumulated (a row
    per range), and each range has its own window."""
    ranged = mutations.withColumn("__range", F.floor(F.col("lsn") / unit))
    sums = ranged.groupBy("__range").agg(F.sum(size).alias("__sum"))
    before = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))
    within = Window.partitionBy("__range").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    total = (F.col("__before") + F.sum(size).over(within)).alias("total")
    rows = ranged.join(before, "__range").select(*mutations.columns, total)
    return rows.withColumn("slot", F.expr(f"(total - {size}) div {int(limit)}"))
