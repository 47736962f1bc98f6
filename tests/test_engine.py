"""End to end: reads over tiers, recovery from crashes at every point, and a random history against a dict."""

import random

import pytest

from shoalkv.operators.memtable import DELETED, MISSING
from shoalkv.plans.engine import bootstrap
from shoalkv.plans.flush import CrashAt, Outcome
from shoalkv.schema import CrashInjected, PublishConflict, StoreError, WriteStalled
from shoalkv.sources.objects import Client


def fill(engine, n=50):
    for i in range(n):
        engine.put(b"key%04d" % i, b"value-%d" % i)


def test_a_flushed_value_reads_back(opened):
    engine = opened()
    fill(engine, 100)
    done = engine.flush()
    assert (done.outcome, done.watermark, done.files) == (Outcome.COMMITTED, 100, 1)
    assert engine.file_count == 1 and engine.watermark == 100
    assert [engine.get(b"key%04d" % i) for i in (0, 57, 99)] == [b"value-0", b"value-57", b"value-99"]
    assert engine.get(b"nonexistent") is None and engine.lookup(b"nonexistent") is MISSING


def test_a_tombstone_in_a_newer_file_beats_the_older_value(opened):
    engine = opened()
    engine.put(b"doomed", b"x")
    engine.put(b"bystander", b"untouched")
    engine.flush()
    engine.delete(b"doomed")
    engine.flush()
    assert engine.file_count == 2
    assert engine.lookup(b"doomed") == DELETED and engine.get(b"doomed") is None
    assert engine.get(b"bystander") == b"untouched"


def test_a_newer_file_shadows_older_ones(opened):
    engine = opened()
    for value in (b"v1", b"v2", b"v3"):
        engine.put(b"k", value)
        engine.flush()
    assert engine.file_count == 3 and engine.get(b"k") == b"v3"


def test_an_unflushed_delete_masks_a_flushed_value(opened):
    engine = opened()
    engine.put(b"k", b"v")
    engine.flush()
    engine.delete(b"k")
    assert engine.get(b"k") is None


def test_empty_keys_and_values_are_values(opened):
    engine = opened()
    engine.put(b"", b"")
    assert engine.get(b"") == b""
    engine.flush()
    assert engine.get(b"") == b""


def test_repeated_reads_come_from_the_cache(opened):
    engine = opened()
    for i in range(500):
        engine.put(b"key%04d" % i, b"v" * 64)
    engine.flush()
    engine.reset_stats()
    engine.get(b"key0250")
    once = engine.store_stats.gets
    for _ in range(20):
        engine.get(b"key0250")
    assert engine.store_stats.gets == once == 5 and engine.cache_stats.hits == 60  # two ranges of the footer, which is kept, and three chunks
    assert (engine.store_stats.files, engine.store_stats.row_groups) == (21, 21)


def test_intervals_rule_files_out(opened):
    engine = opened()
    for f in range(5):
        engine.put_all([(b"f%d-k%03d" % (f, i), b"v" * 32) for i in range(20)])
        engine.flush()
    engine.reset_stats()
    assert engine.get(b"zzz-no-such-key") is None and engine.store_stats.gets == 0
    for f in range(5):
        engine.reset_stats()
        assert engine.get(b"f%d-k007" % f) == b"v" * 32
        assert engine.store_stats.gets <= 8 and engine.store_stats.files == 1


def test_filters_rule_files_out_within_the_interval(opened):
    engine = opened()
    engine.put_all([(b"k%d" % (2 * i), b"v") for i in range(500)])
    engine.flush()
    engine.reset_stats()
    for i in range(60):
        engine.get(b"k%d" % (2 * i + 1))
    assert engine.store_stats.files <= 6


@pytest.mark.parametrize("at", [CrashAt.BEFORE_WRITE, CrashAt.AFTER_WRITE])
def test_a_crash_before_the_commit_leaves_nothing_published(opened, at):
    engine = opened()
    fill(engine)
    with pytest.raises(CrashInjected):
        engine.flush(at)
    engine = opened()
    assert engine.watermark == 0 and engine.file_count == 0
    assert engine.get(b"key0049") == b"value-49"
    assert engine.flush().outcome is Outcome.COMMITTED and engine.file_count == 1
    assert engine.lake.rows().count() == 50


@pytest.mark.parametrize("at", [CrashAt.AFTER_COMMIT, CrashAt.AFTER_TRUNCATE])
def test_a_crash_after_the_commit_publishes_once(opened, at):
    engine = opened()
    fill(engine)
    with pytest.raises(CrashInjected):
        engine.flush(at)
    engine = opened()
    assert engine.watermark == 50 and engine.file_count == 1
    assert engine.flush().outcome in (Outcome.EMPTY, Outcome.ALREADY_PUBLISHED)
    assert engine.file_count == 1 and engine.get(b"key0000") == b"value-0"


def test_the_logs_suffix_survives(opened):
    engine = opened()
    fill(engine)
    engine.flush()
    engine.put(b"late-1", b"a")
    engine.delete(b"key0007")
    engine = opened()
    assert engine.watermark == 50
    assert (engine.get(b"late-1"), engine.get(b"key0007"), engine.get(b"key0008")) == (b"a", None, b"value-8")
    assert engine.put(b"next", b"b") == 53


def test_a_failed_flush_is_made_up_for_in_order(opened):
    """A later flush publishes the range that an earlier one left, and loses nothing over a restart."""
    engine = opened()
    engine.put(b"a", b"1")
    with pytest.raises(CrashInjected):
        engine.flush(CrashAt.BEFORE_WRITE)
    engine.put(b"b", b"2")
    assert engine.flush().watermark == 2
    engine = opened()
    assert (engine.get(b"a"), engine.get(b"b"), engine.file_count) == (b"1", b"2", 2)


def test_back_pressure_comes_before_the_write(spark, settings, monkeypatch):
    from dataclasses import replace

    from shoalkv.plans.engine import Engine

    small = replace(settings, memtable_max_bytes=64, max_frozen=1)
    bootstrap(spark, small)
    engine = Engine.open(spark, small)
    monkeypatch.setattr(engine.lake, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("the store is away")))
    assert engine.put(b"a", b"1") == 1 and isinstance(engine.flush_error, OSError)
    assert engine.put(b"b", b"2") == 2
    with pytest.raises(WriteStalled):
        engine.put(b"c", b"3")
    assert (engine.get(b"a"), engine.get(b"b"), engine.get(b"c")) == (b"1", b"2", None)
    monkeypatch.undo()
    assert engine.put(b"c", b"3") == 3 and engine.watermark >= 2
    engine.close()


def test_opening_without_a_lake_is_an_error(spark, settings):
    from shoalkv.plans.engine import Engine

    with pytest.raises(StoreError):
        Engine.open(spark, settings)


def test_bootstrap_is_idempotent(spark, settings):
    for _ in range(2):
        lake = bootstrap(spark, settings)
        assert lake.watermark() == 0 and len(lake.index()) == 0
        assert lake.rows().count() == 0


def test_two_publishers_cannot_commit_one_watermark(opened, spark, settings):
    engine = opened()
    fill(engine, 5)
    engine.flush()
    with pytest.raises(PublishConflict):
        engine.lake.commit(5, [])
    with pytest.raises(PublishConflict):
        engine.lake.client.put(engine.lake._file("manifest", f"{1:020d}.json"), b"{}", exclusive=True)


def _mutations(spark, first, n, value=b"v"):
    from shoalkv.schema import PLAIN

    return spark.createDataFrame([(b"k%03d" % i, first + i, 0, value) for i in range(n)], PLAIN)


@pytest.mark.parametrize("second", [10, 20])
def test_of_publishers_at_work_at_a_time_one_commits(spark, tmp_path, monkeypatch, second):
    """The second one starts, commits whole while the first has staged its files, and the first is refused, whichever has the higher watermark."""
    from shoalkv.plans import flush
    from shoalkv.sources.lake import Lake

    lake, other = Lake(spark, str(tmp_path / "lake")), Lake(spark, str(tmp_path / "lake"))
    lake.bootstrap()
    write = lake.write

    def staged(*a, **k):
        made = write(*a, **k)
        flush.publish(other, _mutations(spark, 1, second, b"other"))
        return made

    monkeypatch.setattr(lake, "write", staged)
    with pytest.raises(PublishConflict):
        flush.publish(lake, _mutations(spark, 1, 15, b"own"))
    monkeypatch.undo()
    assert lake.watermark() == second and {bytes(r.value) for r in lake.rows().collect()} == {b"other"} and lake.rows().count() == second
    assert len(lake.orphans()) == 1
    done = flush.publish(lake, _mutations(spark, 1, 25, b"own"))
    assert done.watermark == 25 and lake.rows().count() == 25
    assert lake.vacuum(0) == 0 and lake.vacuum(1 << 62) == 1 and lake.rows().count() == 25


def test_a_compaction_and_a_publish_do_not_both_commit(spark, tmp_path, monkeypatch):
    from shoalkv.plans import flush
    from shoalkv.sources.lake import Lake

    lake, other = Lake(spark, str(tmp_path / "lake")), Lake(spark, str(tmp_path / "lake"))
    lake.bootstrap()
    flush.publish(lake, _mutations(spark, 1, 10))
    flush.publish(lake, _mutations(spark, 11, 10))
    write = lake.write
    monkeypatch.setattr(lake, "write", lambda *a, **k: (write(*a, **k), flush.publish(other, _mutations(spark, 21, 5)))[0])
    with pytest.raises(PublishConflict):
        lake.compact()
    monkeypatch.undo()
    assert lake.watermark() == 25 and lake.rows().count() == 25
    lake.compact(files=2)
    assert lake.rows().count() == 10 and lake.index(as_of=20).watermark == 20 and len(lake.index(as_of=20)) == 2


def test_the_number_of_files_follows_from_the_bytes(spark, tmp_path, monkeypatch):
    from shoalkv.plans import flush
    from shoalkv.sources.lake import Lake

    lake = Lake(spark, str(tmp_path / "lake"))
    lake.bootstrap()
    monkeypatch.setattr(flush, "FILE_BYTES", 2000)
    done = flush.publish(lake, _mutations(spark, 1, 100))
    entries = sorted(lake.index().entries, key=lambda e: e.pk_min)
    assert done.files == len(entries) == 4 and all(a.pk_max < b.pk_min for a, b in zip(entries, entries[1:], strict=False))


def test_latency_is_charged_and_operations_are_traced(spark, settings):
    from dataclasses import replace

    from shoalkv.functions.latency import Latency
    from shoalkv.plans.engine import Engine

    slow = replace(settings, latency="s3", get_latency=Latency(5.0, 0.0), put_latency=Latency(7.0, 0.0))
    bootstrap(spark, slow)
    engine = Engine.open(spark, slow)
    engine.put(b"a", b"1")
    engine.reset_stats()
    with engine.lake.client.trace() as trace:
        engine.flush()
    assert [op for op, *_ in trace].count("put") == 2 and trace[-1][0] != "delete"  # a data file and the manifest
    engine.reset_stats()
    assert engine.get(b"a") == b"1"
    stats = engine.store_stats
    assert (stats.gets, stats.charged_ms) == (5, 25.0) and engine.cache_stats.misses == 5
    engine.close()


def test_objects(spark, tmp_path):
    from shoalkv.sources.objects import Store

    client, at = Client(spark), f"file:{tmp_path}/objects"
    client.put(f"{at}/a", b"0123456789")
    assert client.put_parts(f"{at}/b", iter([b"ab", b"cd"])) == 4 and client.get(f"{at}/b") == b"abcd"
    client.copy(f"{at}/a", f"{at}/c")
    assert client.get_ranges(f"{at}/c", [(0, 2), (8, 10)]) == [b"01", b"89"] and client.head(f"{at}/c")[0] == 10
    assert client.delete(f"{at}/a") and not client.delete(f"{at}/a")
    assert client.list(at) == [("b", 4), ("c", 10)] and client.list(f"{at}/none") == []
    with pytest.raises(StoreError):
        client.get_range(f"{at}/c", 5, 20)
    with pytest.raises(PublishConflict):
        client.put(f"{at}/b", b"", exclusive=True)
    assert client.counts == {"put": 6, "get": 4, "delete": 2, "list": 2} and client.bytes_read == 8
    Store("http://host:1", "key", "secret").apply(spark)
    assert spark._jsc.hadoopConfiguration().get("fs.s3a.endpoint") == "http://host:1"


def test_files_have_field_ids_bounds_small_row_groups_and_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    from shoalkv.schema import PLAIN
    from shoalkv.sources.lake import Lake

    lake = Lake(spark, str(tmp_path / "lake"))
    lake.bootstrap()
    rows = [(b"k%06d" % i, i + 1, int(i == 7), None if i == 7 else b"v%d" % i) for i in range(20_000)]
    entries = lake.write(spark.createDataFrame(rows, PLAIN), 20_000)
    lake.commit(20_000, entries)
    (entry,) = lake.index().entries
    assert (entry.pk_min, entry.pk_max, entry.record_count) == (b"k000000", b"k019999", 20_000)
    assert entry.bloom_may_contain(b"k000123") and entry.file_size > 0
    found = pq.ParquetFile(entry.location.removeprefix("file:"))
    assert [found.metadata.row_group(i).num_rows for i in range(found.num_row_groups)] == [8192, 8192, 3616]
    assert [f.metadata[b"PARQUET:field_id"] for f in found.schema_arrow] == [b"1", b"2", b"3", b"4"]
    back = lake.rows().orderBy("pk").collect()
    assert [(bytes(r.pk), r.lsn, r.op, r.value and bytes(r.value)) for r in back] == rows


def test_a_random_history_matches_a_dict(opened):
    rng, model = random.Random(7), {}
    engine = opened()
    for step in range(120):
        key = b"k%02d" % rng.randrange(25)
        what = rng.random()
        if what < 0.6:
            model[key] = b"v%d" % step
            engine.put(key, model[key])
        elif what < 0.85:
            model.pop(key, None)
            engine.delete(key)
        elif what < 0.9:
            engine.flush()
        elif what < 0.94:
            with pytest.raises(CrashInjected):
                engine.put(b"marker", b"m")
                model[b"marker"] = b"m"
                engine.flush(rng.choice(list(CrashAt)))
            engine = opened()
        else:
            assert engine.get(key) == model.get(key)
    live = {bytes(r.pk): bytes(r.value) for r in engine.current().collect()}
    assert live == model
    assert all(engine.get(b"k%02d" % i) == model.get(b"k%02d" % i) for i in range(25))
    engine.flush()
    engine.lake.compact()
    assert {bytes(r.pk): bytes(r.value) for r in engine.lake.rows().collect()} == model


def test_multi_get_tells_found_deleted_and_missing(opened, spark):
    engine = opened()
    engine.put_all([(b"a", b"1"), (b"b", b"2"), (b"c", b"")])
    engine.flush()
    engine.delete(b"b")
    keys = spark.createDataFrame([(b"a",), (b"b",), (b"c",), (b"d",), (b"a",)], "pk binary")
    got = sorted((bytes(r.pk), r.status, r.value and bytes(r.value)) for r in engine.multi_get(keys).collect())
    assert [g[:2] for g in got] == [(b"a", "Found"), (b"a", "Found"), (b"b", "Deleted"), (b"c", "Found"), (b"d", "Missing")]


def test_a_path_without_a_scheme_is_the_default_file_systems(spark):
    client = Client(spark)
    assert client.local("/a/b") == "/a/b" and client.local("file:/a") == "/a" and client.local("hdfs://h/a") is None
    client._plain_is_local = False
    assert client.local("/a/b") is None and client.local("file:/a") == "/a"


@pytest.mark.parametrize("able", [True, False])
def test_a_write_that_fails_is_never_closed(able):
    class Stream:
        def write(self, data):
            raise OSError("no room")

        def hasCapability(self, name):
            return able

        def abort(self):
            self.done.append("abort")

        def close(self):
            self.done.append("close")

    stream = Stream()
    stream.done = []
    with pytest.raises(OSError):
        Client._filled(stream, b"x")
    assert stream.done == (["abort"] if able else [])
