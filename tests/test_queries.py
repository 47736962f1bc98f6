"""Every query of the engine against its SQL in DuckDB, and streaming ingest under repeated batches."""

import os
import random

import duckdb
import pytest

from shoalkv import queries
from shoalkv.functions import bloom
from shoalkv.plans import flush, views
from shoalkv.schema import PLAIN
from shoalkv.sources.lake import Lake
from shoalkv.streaming.ingest import ingest, publishing, upserted

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def texts(frame):
    names = sorted(frame.columns)
    return sorted(frame[names].astype(object).where(frame[names].notna(), None).astype(str).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        norm = lambda rows: [[x.removesuffix(".0") for x in r] for r in rows]  # noqa: E731  pandas shows nullable integers as floats
        assert norm(texts(got)) == norm(texts(want))
    else:
        assert len(got)


def test_filters_leave_every_file_that_has_the_key(spark):
    kept = {(r.pk, r.flush_id) for r in queries.bloom_prune(spark, DATA).collect()}
    assert kept >= {(bytes(r.pk).decode(), r.flush_id) for r in queries.filed(spark, DATA).collect()}


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_candidates_are_all_files_whose_interval_holds_the_key(spark, monkeypatch, sent):
    """Overlapping, nested, single and empty intervals, keys outside of all and at both ends, repeated keys, few cuts and many."""
    rng = random.Random(3)
    name = lambda: bytes(rng.randrange(4) for _ in range(rng.randrange(4)))
    ends = [tuple(sorted((name(), name()))) for _ in range(60)] + [(b"\x01", b"\x01"), (b"\x03", b"\x01"), (None, None)]
    files = [(f"f{i}", a, b) for i, (a, b) in enumerate(ends)]
    asked = [name() for _ in range(200)] + [b"\xff", None]
    want = sorted((k, f) for k in asked for f, a, b in files if k is not None and a is not None and a <= k <= b)
    monkeypatch.setattr(views, "SENT", sent)
    index, keys = spark.createDataFrame(files, "file string, pk_min binary, pk_max binary"), spark.createDataFrame([(k,) for k in asked], "pk binary")
    for cuts in (1, 7, 255):
        monkeypatch.setattr(views, "CUTS", cuts)
        found = views.candidates(keys, index)
        assert found.columns == ["pk", "file", "pk_min", "pk_max"]
        assert sorted((bytes(r.pk), r.file) for r in found.collect()) == want
    assert views.candidates(keys, index.limit(0)).count() == 0


def test_shadowed_counts_over_ranges(spark):
    rows = [(b"hot", lsn, lsn % 2, None) for lsn in range(1, 40)] + [(b"a", 3, 0, b"x"), (b"a", 50, 0, b"y"), (b"b", 7, 0, b"z")]
    df = spark.createDataFrame(rows, "pk binary, lsn long, op int, value binary")
    want = sorted((b"hot", lsn, 40 - lsn) for lsn in range(1, 39)) + [(b"a", 3, 2)]
    for unit in (1, 8, 1 << 20):
        assert sorted((bytes(r.pk), r.lsn, r.depth) for r in views.shadowed(df, unit).collect()) == sorted(want)


def test_filters_of_many_files_stay_apart(spark):
    """Files with a filter, with a broken one and with none; a key asked of each."""
    held = {f"f{i}": [b"k%d-%d" % (i, j) for j in range(50)] for i in range(6)}
    filters = []
    for file, keys in held.items():
        made = bloom.Bloom.empty(bloom.blocks_for(len(keys)))
        made.add(keys)
        filters.append((file, made.tobytes()))
    filters.append(("broken", b"123"))
    asked = [k for keys in held.values() for k in keys]
    pairs = spark.createDataFrame([(f, k) for f in [*held, "broken", "none"] for k in asked], "file string, pk binary")
    got = {(r.file, bytes(r.pk)) for r in bloom.bloom_pruned(pairs, spark.createDataFrame(filters, "file string, words binary")).collect()}
    assert got == {(f, k) for f in [*held, "broken", "none"] for k in asked if bloom.may_contain(dict(filters).get(f), k)}
    # their own keys, all keys of the two without a filter, and of the 1,500 other pairs 5 % at most
    assert len(got) < 3 * len(asked) + 75 and all((f, k) in got for f, keys in held.items() for k in keys)


def test_a_repeated_batch_publishes_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.bootstrap()
    rows = spark.createDataFrame([(b"k%d" % i, i + 1, 0, b"v") for i in range(10)], PLAIN)
    seen = []
    body = publishing(lake, seen)
    body(rows, 0)
    body(rows, 0)
    assert [s.outcome for s in seen] == [flush.Outcome.COMMITTED, flush.Outcome.ALREADY_PUBLISHED]
    assert len(lake.index()) == 1 and lake.watermark() == 10


def test_a_stream_resumes_where_it_stopped(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.bootstrap()
    arrivals, seen = str(tmp_path / "in"), []
    for k in range(2):
        spark.createDataFrame([(b"k%d" % (i % 4), 10 * k + i + 1, 0, b"%d" % k) for i in range(10)], PLAIN).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(PLAIN).parquet(arrivals)
        ingest(stream, lake, str(tmp_path / "ck"), seen).awaitTermination()
    assert [s.watermark for s in seen] == [10, 20] and len(lake.index()) == 2


def test_state_ignores_late_rows(spark, tmp_path):
    spark.createDataFrame([(b"a", 5, 0, b"new"), (b"a", 3, 1, None), (b"b", 1, 0, b"x"), (b"b", 2, 1, None)], PLAIN).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = upserted(spark.readStream.schema(PLAIN).parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("kept").outputMode("update").trigger(availableNow=True).start()
    running.awaitTermination()
    assert {(bytes(r.pk), r.lsn, r.op) for r in spark.table("kept").collect()} == {(b"a", 5, 0), (b"b", 2, 1)}
