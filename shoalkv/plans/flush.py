"""Publishing: from a range of the log to a committed set of files, once."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import heap_size
from ..operators.memtable import collapsed
from ..schema import MUTATION, CrashInjected
from ..sources.lake import Lake


class CrashAt(Enum):
    BEFORE_WRITE = "BeforeWrite"
    AFTER_WRITE = "AfterWrite"
    AFTER_COMMIT = "AfterCommit"
    AFTER_TRUNCATE = "AfterTruncate"

    def reached(self, at: CrashAt | None) -> None:
        if at is self:
            raise CrashInjected(self.value)


class Plan(Enum):
    WRITE = "Write"
    ALREADY_PUBLISHED = "AlreadyPublished"
    EMPTY = "Empty"


class Outcome(Enum):
    COMMITTED = "Committed"
    ALREADY_PUBLISHED = "AlreadyPublished"
    EMPTY = "Empty"


@dataclass(frozen=True)
class Flushed:
    outcome: Outcome
    watermark: int | None = None
    files: int = 0


def planned(published: int, max_lsn: int, rows: int) -> Plan:
    """Publishing is idempotent by this alone: what the watermark covers isn't written again."""
    if not rows:
        return Plan.EMPTY
    return Plan.ALREADY_PUBLISHED if max_lsn <= published else Plan.WRITE


#: Bytes of keys and values (before compression) that one file takes.
FILE_BYTES = 256 << 20


def publish(lake: Lake, mutations: DataFrame, upto: int | None = None, crash: CrashAt | None = None, files: int | None = None) -> Flushed:
    """Publish the mutations above the lake's watermark (up to ``upto``), collapsed. ``mutations`` must hold every LSN of that
    range: the watermark never passes an unpublished one. Repeating a call, in part or in whole, changes nothing. The number of
    files follows from the bytes unless it is given."""
    last, published = lake.state()
    rows = mutations.select(*MUTATION.names)
    if upto is not None:
        rows = rows.where(F.col("lsn") <= upto)
    fresh = rows.where(F.col("lsn") > published)
    size = F.sum(heap_size(F.col("pk"), F.col("value")))
    highest, count, size = fresh.agg(F.coalesce(F.max("lsn"), F.lit(published)), F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    kind = planned(published, highest, count or int(not rows.isEmpty()))
    if kind is Plan.EMPTY:
        return Flushed(Outcome.EMPTY)
    if kind is Plan.ALREADY_PUBLISHED:
        return Flushed(Outcome.ALREADY_PUBLISHED, published)
    CrashAt.BEFORE_WRITE.reached(crash)
    entries = lake.write(collapsed(fresh), highest, files=files or 1 + size // FILE_BYTES)
    CrashAt.AFTER_WRITE.reached(crash)
    lake.commit(highest, entries, last)
    CrashAt.AFTER_COMMIT.reached(crash)
    return Flushed(Outcome.COMMITTED, highest, len(entries))
