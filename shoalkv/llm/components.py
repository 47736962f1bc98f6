"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations with partial sums and two joins that AQE may split;
links and labels stay in tables in the shared scratch folder, and the driver sees
counts only. ``FOLD`` links or fewer, some ten megabytes, are one task's work instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60
FOLD = 100_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first())


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for s in range(0, len(nodes), 1 << 16):
        part = nodes[s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.array([top(x) for x in part], np.int64))], names=["a", "b"])


def roots(links: DataFrame) -> DataFrame:
    """``links`` has longs ``a`` and ``b``; returns ``node`` and ``root`` (the smallest node it reaches), without the roots' own rows."""
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    if 0 < state[0] <= FOLD:
        now = written(now.repartition(1).mapInArrow(_folded, "a long, b long"), "folded")
    elif state[0]:
        for _ in range(MAX_ROUNDS):
            now = written(_small(_large(now)), "links")
            before, state = state, _state(now)
            if state == before:
                break
        else:
            raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
