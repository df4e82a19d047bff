from __future__ import annotations

import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.model import Corrupt, InvalidValue, TooLarge
from keystrata.sources import manifest, runfile, wal

pairs = st.dictionaries(st.binary(max_size=20), st.one_of(st.none(), st.binary(min_size=1, max_size=200)), max_size=60)


@given(st.lists(st.tuples(st.binary(max_size=10), st.one_of(st.none(), st.binary(min_size=1, max_size=20))), max_size=20), st.integers(0, 400))
def test_wal_round_trip_and_torn_tail(rows, cut):
    data = b"".join(wal.encode(k, v) for k, v in rows)
    assert wal.replay(data) == (rows, 0)
    got, skipped = wal.replay(data[:cut])
    assert got == rows[: len(got)] and skipped <= 1


def test_wal_damage():
    a, b, c = wal.encode(b"a", b"1"), wal.encode(b"b", None), wal.encode(b"c", b"3")
    flipped = a[:-1] + bytes([a[-1] ^ 1])
    assert wal.replay(flipped + b + c) == ([(b"b", None), (b"c", b"3")], 1)
    assert wal.replay(a + b + c[:-1]) == ([(b"a", b"1"), (b"b", None)], 1)
    assert wal.replay(a + b[:5]) == ([(b"a", b"1")], 0)
    assert wal.replay(a + struct.pack("<III", 0, 129, 1) + c) == ([(b"a", b"1")], 1)
    assert wal.replay(b"") == ([], 0)
    with pytest.raises(TooLarge):
        wal.encode(b"k" * 129, b"v")
    with pytest.raises(TooLarge):
        wal.encode(b"k", b"v" * 4097)
    with pytest.raises(InvalidValue):
        wal.encode(b"k", b"")


def test_wal_files(spark, tmp_path):
    rows = [(b"k1", b"v1"), (b"k2", None), (b"\xff\x00", b"\x00")]
    for name in ("active.wal", "active-20.wal", "active-3.wal"):
        (tmp_path / name).write_bytes(b"".join(wal.encode(k, v) for k, v in rows))
    files = wal.read_segments(spark, f"{tmp_path}/*.wal")
    assert [r.name for r in files.orderBy("ts", "path").collect()] == ["active.wal", "active-3.wal", "active-20.wal"]
    got = wal.replay_column(files).where(F.col("path").endswith("active-3.wal")).orderBy("pos").collect()
    assert [(bytes(r.key), None if r.value is None else bytes(r.value)) for r in got] == rows
    spark.dataSource.register(wal.WalDataSource)
    assert spark.read.format("keystrata_wal").option("paths", f"{tmp_path}/active.wal,{tmp_path}/active-3.wal").load().count() == 6
    encoded = spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in rows], "key binary, value binary").select(wal.encode_column(F.col("key"), F.col("value")).alias("r"))
    assert sorted(bytes(r.r) for r in encoded.collect()) == sorted(wal.encode(k, v) for k, v in rows)


@given(pairs, st.booleans())
def test_run_file_round_trip(records, framed):
    rows = sorted(records.items())
    f = runfile.RunFile(runfile.dump(rows, 128, framed))
    assert list(f.records()) == rows
    for k, v in rows:
        assert f.get(k) == (True, v)
    assert f.get(b"\xff" * 21) == (False, None)
    assert f.last_keys == sorted(f.last_keys)


def test_run_file_damage():
    data = runfile.dump([(b"key", b"value")])
    for bad in (b"abcd", data[:-1], data[:8] + b"\xff" + data[9:], data[:-8] + b"\0" * 8):
        with pytest.raises(Corrupt):
            list(runfile.RunFile(bad).records())
    assert list(runfile.RunFile(runfile.dump([])).records()) == []
    assert runfile.RunFile(runfile.dump([])).get(b"k") == (False, None)


def test_bloom_rates():
    keys = [f"present-{i:05d}".encode() for i in range(10_000)]
    b = runfile.Bloom.load(runfile.Bloom.of(keys).dump())
    assert all(b.may_contain(k) for k in keys)
    assert sum(b.may_contain(f"missing-{i:05d}".encode()) for i in range(10_000)) <= 300
    for bad in (b"", struct.pack("<II", 0, 1), struct.pack("<II", 8, 0), struct.pack("<II", 8, 11) + b"\0", struct.pack("<II", 80, 3) + b"\0"):
        with pytest.raises(Corrupt):
            runfile.Bloom.load(bad)


def test_manifest(tmp_path):
    assert manifest.load(tmp_path) == []
    for n in ("a", "b", "b", "c", "d"):
        manifest.publish(tmp_path, n)
    assert manifest.load(tmp_path) == ["a", "b", "c", "d"]
    assert not manifest.swap(tmp_path, ["b", "c"], ["x"])
    assert manifest.swap(tmp_path, ["a", "b"], ["x"])
    assert manifest.load(tmp_path) == ["x", "c", "d"]
    (tmp_path / manifest.NAME).write_text(" x \n\n c\n")
    assert manifest.load(tmp_path) == ["x", "c"]
