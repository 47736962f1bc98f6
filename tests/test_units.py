"""The pieces: frames, log, memtables, filters, index, cache, latency, config."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoalkv.config import Config
from shoalkv.functions import latency, paths
from shoalkv.functions.bloom import Bloom, blocks_for, may_contain, murmur3
from shoalkv.operators.cache import RangeCache, simulated
from shoalkv.operators.memtable import DELETED, MISSING, Memtable, MemtableSet, collapsed
from shoalkv.plans.flush import Plan, planned
from shoalkv.schema import PLAIN, ConfigError, CorruptLog, Op, WriteStalled, verify_columns
from shoalkv.sources.frames import Record, decode, decode_all, encode, encode_all
from shoalkv.sources.lake import FileEntry, FileIndex
from shoalkv.sources.log import Log, log_frame, segments_frame

#: Fixed value: a filter another implementation wrote over the keys k1 to k100, in four blocks.
GOLDEN = "Nnn6cNXytKRuV6bgWYZPLIshG5s5hjmq3LyWWSp/syXHTLa/r4Y72DeHHRsUtcXOlHN+8trY8uc/prMqtLPI+71l3dz4vf1sa357MjIX1Xw4xdbev/khnOmmlunb2MPLRnbGb925l03TboOqozd8Ng9nN0/5b5KTNTZvKUwrnmc="


# Frames.


def test_frames_round_trip():
    rows = [Record.put(b"alpha", 1, b"one"), Record.delete(b"beta", 2), Record.put(b"", 3, b"")]
    assert [r for r, _ in decode_all(encode_all(rows))] == rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=20), st.integers(1, 2**63 - 1), st.one_of(st.none(), st.binary(max_size=30)))))
def test_any_frames_round_trip(rows):
    records = [Record.delete(k, n) if v is None else Record.put(k, n, v) for k, n, v in rows]
    assert [r for r, _ in decode_all(encode_all(records))] == records


def test_torn_frames_end_the_log_without_an_error():
    data = encode(Record.put(b"k", 1, b"v"))
    assert decode(data[:-1]) is None and decode(data[:-1] + bytes([data[-1] ^ 1])) is None


def test_a_good_checksum_over_bad_content_is_an_error():
    import struct
    import zlib

    for payload in (b"short", struct.pack("<QBI", 1, 9, 0) + bytes(4), struct.pack("<QBI", 1, 0, 99) + bytes(4)):
        with pytest.raises(CorruptLog):
            decode(struct.pack("<II", zlib.crc32(payload), len(payload)) + payload)


# Log.


def puts(low, high):
    return [Record.put(b"k%d" % i, i, b"v%d" % i) for i in range(low, high)]


def test_replay_starts_above_the_watermark(tmp_path):
    log, _ = Log.open(tmp_path / "a", 1 << 20)
    log.append([])
    log.append(puts(1, 50))
    assert [(len(r.records), r.max_lsn) for r in [Log.open(tmp_path / "a", 1 << 20)[1]]] == [(49, 49)]
    log.append(puts(50, 101))
    replay = Log.open(tmp_path / "a", 1 << 20, 60)[1]
    assert (len(replay.records), replay.records[0].lsn, replay.max_lsn) == (40, 61, 100)


def test_a_torn_tail_is_cut_off_and_the_log_goes_on(tmp_path):
    log, _ = Log.open(tmp_path, 1 << 20)
    log.append(puts(1, 21))
    log.close()
    (segment,) = tmp_path.glob("*.wal")
    segment.write_bytes(segment.read_bytes()[:-5])
    log, replay = Log.open(tmp_path, 1 << 20)
    assert len(replay.records) == 19
    log.append(puts(20, 25))
    assert len(Log.open(tmp_path, 1 << 20)[1].records) == 24


def test_rotation_and_truncation(tmp_path, spark):
    log, _ = Log.open(tmp_path, 256)
    for i in range(20):
        log.append(puts(10 * i + 1, 10 * i + 11))
    assert len(log.sealed) > 5 and log.size_bytes() > 0
    assert [r.start_lsn for r in segments_frame(spark, str(tmp_path)).collect()] == [s.start_lsn for s in [*log.sealed, log.active]]
    log.truncate_through(100)
    replay = Log.open(tmp_path, 256, 100)[1]
    assert (len(replay.records), replay.max_lsn) == (100, 200)
    log.truncate_through(1_000_000)
    assert not log.sealed and log.active.path.exists()
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "x.wal").write_text("x")
    assert log_frame(spark, str(tmp_path), 195).count() == 5


def test_damage_before_the_last_segment_is_an_error(tmp_path):
    log, _ = Log.open(tmp_path, 64)
    for i in range(3):
        log.append(puts(5 * i + 1, 5 * i + 6))
    log.sealed[0].path.write_bytes(log.sealed[0].path.read_bytes()[:-2])
    with pytest.raises(CorruptLog):
        Log.open(tmp_path, 64)


# Memtables.


def test_the_lsn_decides_and_not_the_order_of_arrival():
    table = Memtable()
    table.insert(Record.put(b"a", 2, b"new"))
    table.insert(Record.put(b"a", 1, b"old"))
    table.insert(Record.delete(b"a", 0))
    table.insert(Record.put(b"a", 2, b"again"))
    assert table.get(b"a").value == b"new" and table.max_lsn == 2
    assert table.approx_bytes == (1 + 3 + 64) + (1 + 3 + 64) + (1 + 64) + (1 + 5 + 64)


def test_deleted_is_not_missing_and_ends_the_search():
    tables = MemtableSet(1 << 20, 4)
    tables.insert(Record.put(b"a", 1, b"v"))
    tables.freeze()
    tables.insert(Record.delete(b"a", 2))
    assert tables.get(b"a") == DELETED and tables.get(b"b") is MISSING and len(tables.active) == 1


def test_keys_come_in_byte_order():
    table = Memtable()
    for i, k in enumerate([b"\x80", b"", b"\x7f\x00", b"\xff", b"\x7f"]):
        table.insert(Record.put(k, i + 1, b""))
    assert [r.pk for r in table] == [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]


def test_too_many_frozen_tables_stall_before_the_empty_check():
    tables = MemtableSet(64, 2)
    for i in range(2):
        tables.insert(Record.put(b"k", i + 1, b"v"))
        assert tables.freeze() is not None
    with pytest.raises(WriteStalled):
        tables.freeze()
    tables.retire(tables.frozen[0])
    assert tables.freeze() is None


def test_the_threshold_is_inclusive():
    tables = MemtableSet(656, 2)
    for i in range(8):
        assert not tables.should_freeze
        tables.insert(Record.put(b"k%d" % i, i + 1, b"v" * 16))
    assert tables.should_freeze and tables.approx_bytes == 656


def test_collapse_keeps_tombstones(spark):
    rows = [(b"c", 1, 0, b"x"), (b"a", 2, 0, b"y"), (b"b", 3, 1, None), (b"a", 1, 0, b"old")]
    got = collapsed(spark.createDataFrame(rows, PLAIN)).orderBy("pk").collect()
    assert [(bytes(r.pk), r.lsn, r.op, r.value and bytes(r.value)) for r in got] == [(b"a", 2, 0, b"y"), (b"b", 3, 1, None), (b"c", 1, 0, b"x")]


def test_plans():
    assert [planned(5, 5, 1), planned(4, 5, 1), planned(4, 0, 0)] == [Plan.ALREADY_PUBLISHED, Plan.WRITE, Plan.EMPTY]


def test_columns_are_verified(spark):
    verify_columns(spark.createDataFrame([], PLAIN))
    with pytest.raises(ConfigError):
        verify_columns(spark.createDataFrame([], "pk binary, op int, lsn long, value binary"))


# Filters and index.


def test_a_foreign_filter_is_read():
    found = Bloom.from_base64(GOLDEN)
    assert len(found.words) == 4
    assert found.might_contain([b"k%d" % i for i in range(1, 101)]).all()
    assert (~found.might_contain([b"k%d" % i for i in range(100_000, 101_000)])).sum() > 950


def test_own_filters_have_no_false_negatives():
    keys = [b"%d" % (i * i) for i in range(5000)]
    made = Bloom.parse(Bloom.build(keys).tobytes())
    assert made.might_contain(keys).all() and len(made.words) == blocks_for(5000)
    assert made.might_contain([b"x%d" % i for i in range(5000)]).mean() < 0.03


def test_a_malformed_filter_rules_nothing_out():
    assert Bloom.from_base64("not valid base64 !!!") is None and Bloom.from_base64("YWJj") is None
    assert may_contain(None, b"k") and may_contain(b"abc", b"k")


def test_murmur3_of_known_inputs():
    assert murmur3([b"", b"abcd", b"abc", b"hello"], 0).tolist() == [0, 0x43ED676A, 0xB3DD93FA, 0x248BFA47]


def entry(mark, low=b"a", high=b"z"):
    return FileEntry(f"f{mark}", mark, low, high, 1, 1, None)


def test_bounds_are_inclusive_and_the_newest_comes_first():
    one = entry(1, b"b", b"d")
    assert [one.may_contain(k) for k in (b"a", b"b", b"c", b"d", b"e")] == [False, True, True, True, False]
    index = FileIndex([entry(10), entry(30), entry(20), entry(40, b"m", b"z")])
    assert [e.watermark for e in index.candidates(b"c")] == [30, 20, 10] and index.watermark == 40
    assert FileIndex([]).watermark == 0


def test_hex_that_is_not_hex_raises(spark):
    frame = spark.createDataFrame([("6B31",), ("6B393939",)], "x string")
    assert [bytes(r.y) for r in frame.select(paths.decode_hex(F.col("x")).alias("y")).collect()] == [b"k1", b"k999"]
    with pytest.raises(Exception, match="not hex"):
        spark.createDataFrame([("zz",)], "x string").select(paths.decode_hex(F.col("x")).alias("y")).collect()


def test_data_paths():
    assert paths.split_data_path("s3://warehouse/kv/") == ("warehouse", "kv/") and paths.split_data_path("s3://warehouse") == ("warehouse", "")
    with pytest.raises(ConfigError):
        paths.split_data_path("/local/path")


# Cache.


def test_the_least_recently_used_range_goes():
    cache = RangeCache(30)
    for name in "abc":
        cache.insert(name, 10)
    cache.get("a")
    cache.insert("d", 10)
    assert "b" not in cache and all(k in cache for k in "acd") and cache.evictions == 1


def test_the_cache_keeps_its_bound():
    cache = RangeCache(100)
    for i in range(50):
        cache.insert(i, 10)
        assert cache.resident_bytes <= 100
    assert cache.resident_bytes == 100
    assert not cache.insert("large", 101) and 49 in cache
    assert cache.insert("all", 100) and cache.resident_bytes == 100
    cache.insert("all", 100)
    assert cache.resident_bytes == 100


def test_simulation_matches_the_cache(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i % 3}", i, f"p{rng.integers(4)}", int(a), int(a) + 10) for i, a in enumerate(rng.integers(0, 6, 600) * 10)]
    got = {r.cache: (r.hits, r.misses, r.evictions, r.resident_bytes) for r in simulated(spark.createDataFrame(rows, "cache string, seq long, path string, start long, end long"), 100).collect()}
    for name in ("c0", "c1", "c2"):
        cache = RangeCache(100)
        for _, _, p, a, b in (r for r in rows if r[0] == name):
            cache.fetch((p, a, b), b - a)
        assert got[name] == (cache.hits, cache.misses, cache.evictions, cache.resident_bytes)


# Latency and config.


def test_fits():
    fit = latency.Latency.fit(26, 86)
    assert fit.median == 26 and fit.sigma == pytest.approx(math.log(86 / 26) / latency.Z99)
    assert latency.Latency.fit(0, 5) == latency.Latency(0.0, 0.0) and latency.Latency.fit(10, 10).sigma == 0


def test_percentiles_do_not_interpolate(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert rows.agg(latency.percentile("x", 0.5).alias("p")).first().p == 3.0
    many = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    values = sorted(r.x for r in many.collect())
    got = latency.exact_percentiles(many, "x", {"a": 0.5, "b": 0.999, "c": 1.0}).first()
    assert (got.a, got.b, got.c) == (values[10_000], values[19_980], values[-1])
    assert latency.exact_percentiles(many.where("x < 0"), "x", {"a": 0.5}).first().a is None


def test_settings_come_from_the_environment():
    env = {"SHOALKV_CACHE_BYTES": "100", "SHOALKV_MAX_FROZEN": "many", "SHOALKV_LATENCY": "s3", "SHOALKV_LATENCY_GET_P50_MS": "3", "SHOALKV_LATENCY_GET_P99_MS": "15", "SHOALKV_LATENCY_PUT_P50_MS": "1"}
    made = Config.from_env(env)
    assert (made.cache_bytes, made.max_frozen, made.latency, made.get_latency.median, made.put_latency) == (100, 2, "s3", 3.0, None)
    with pytest.raises(ConfigError):
        Config.from_env({"SHOALKV_LATENCY": "lunar"})


def test_operations_have_their_codes():
    assert (Op.PUT, Op.DELETE) == (0, 1)


def test_the_store_is_set_up_and_listed(spark, tmp_path):
    from shoalkv.sources.objects import Store, head, listing

    made = Store("https://store:9000", "a", "b").options()
    assert made["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "true" and made["spark.hadoop.fs.s3a.path.style.access"] == "true"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"12345")
    assert [(r.path[-5:], r.size) for r in listing(spark, str(tmp_path)).collect()] == [("x.bin", 5)]
    assert head(spark, str(tmp_path / "d" / "x.bin"))[0] == 5
    with pytest.raises(Exception, match="FileNotFound"):
        head(spark, str(tmp_path / "none"))


def test_urls(spark):
    row = spark.createDataFrame([("https://h:9000",), ("http://h",)], "u string").select(paths.without_scheme(F.col("u")).alias("h"), paths.uses_tls(F.col("u")).alias("s")).collect()
    assert [(r.h, r.s) for r in row] == [("h:9000", True), ("h", False)]
