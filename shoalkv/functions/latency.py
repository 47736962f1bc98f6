"""The store's latency model and the statistics of a sweep, as columns.

Latencies are lognormal: the median is the p50, and sigma follows from the p99.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 99th percentile of the standard normal distribution.
Z99 = 2.326347874040841

#: p50 and p99 in milliseconds by profile and operation.
PROFILES = {
    "none": {"get": (0, 0), "put": (0, 0), "list": (0, 0), "delete": (0, 0)},
    "s3": {"get": (26, 86), "put": (70, 137), "list": (40, 120), "delete": (50, 100)},
    "express": {"get": (3, 15), "put": (5, 20), "list": (5, 20), "delete": (5, 20)},
}

#: A point read is fast enough below this p99, in milliseconds.
OLTP_P99_MS = 10.0


@dataclass(frozen=True)
class Latency:
    median: float
    sigma: float

    @classmethod
    def fit(cls, p50: float, p99: float) -> Latency:
        import math

        if p50 <= 0:
            return cls(0.0, 0.0)
        return cls(p50, math.log(p99 / p50) / Z99 if p99 > p50 else 0.0)


def profiles(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{name}', '{op}', {p50}D, {p99}D)" for name, ops in PROFILES.items() for op, (p50, p99) in ops.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(profile, op, p50, p99)")


def sigma(p50: Column, p99: Column) -> Column:
    return F.when((p50 > 0) & (p99 > p50), F.log(p99 / p50) / F.lit(Z99)).otherwise(F.lit(0.0))


def draw(median: Column, spread: Column, seed: int) -> Column:
    return F.when(median > 0, median * F.exp(spread * F.randn(seed))).otherwise(F.lit(0.0))


def charged(ops: DataFrame, profile: str, seed: int) -> DataFrame:
    """``ops`` has ``op``; adds ``ms``, an independent draw for each row. Nothing sleeps."""
    fits = {op: Latency.fit(*p) for op, p in PROFILES[profile].items()}
    case = lambda attr: F.coalesce(*[F.when(F.col("op") == op, F.lit(getattr(f, attr))) for op, f in fits.items()], F.lit(0.0))
    return ops.withColumn("ms", draw(case("median"), case("sigma"), seed))


def percentile(values: str, p: float) -> Column:
    """The element at floor(n * p) of the ascending values (the last at most); no interpolation. An aggregate of bounded
    groups, such as a bench run's reads; for whole tables see ``exact_percentiles``."""
    ordered = F.sort_array(F.collect_list(values))
    return F.try_element_at(ordered, F.least(F.floor(F.count(values) * F.lit(p)), F.count(values) - 1).cast("int") + 1)


BINS = 4096
#: Distinct values that one task may order.
ORDERED = 100_000


def exact_percentiles(df: DataFrame, values: str, points: dict[str, float]) -> DataFrame:
    """The same over a table of any size, as doubles. Values are counted, and the interval that holds a rank is cut into bins again and
    again (a row per bin comes to the driver) until few distinct values are left in it; only those are ordered."""
    counted = df.where(F.col(values).isNotNull()).groupBy(F.col(values).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    low, high, total = counted.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    spark = df.sparkSession
    if total is None:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS DOUBLE) AS `{name}`" for name in points))
    found = {name: _ranked(counted, low, high, min(int(total * p), total - 1)) for name, p in points.items()}
    return spark.range(1).select(*[F.lit(v).alias(name) for name, v in found.items()])


def _ranked(counted: DataFrame, low: float, high: float, rank: int) -> float:
    while True:
        inside = counted.where(F.col("v").between(low, high))
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("v") - low) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = inside.groupBy(place.alias("bin")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
        for b in bins:
            if rank < b.n:
                break
            rank -= b.n
        low, high = b.low, b.high
        if b.kinds <= ORDERED or low == high:
            break
    for r in counted.where(F.col("v").between(low, high)).orderBy("v").toLocalIterator():
        if rank < r.n:
            return r.v
        rank -= r.n
    raise AssertionError("the rank lies within the bin")


def envelope(sweep: DataFrame, bar: float = OLTP_P99_MS) -> DataFrame:
    """``sweep`` has ``arm``, ``ratio``, ``p99``: by arm the largest ratio within the bar and the smallest beyond it."""
    return sweep.groupBy("arm").agg(F.max(F.when(F.col("p99") <= bar, F.col("ratio"))).alias("last_ok"), F.min(F.when(F.col("p99") > bar, F.col("ratio"))).alias("first_bad"))
