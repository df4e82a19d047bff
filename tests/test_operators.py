from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keystrata.functions.hashing import bloom_params
from keystrata.operators import blocks, changelog, latest, ordering, runs, segments

BYTES = "seq long, key binary, value binary"


def log_of(spark, rows):
    return spark.createDataFrame([(i, bytearray(k), None if v is None else bytearray(v)) for i, (k, v) in enumerate(rows)], BYTES)


def state(rows):
    out = {}
    for k, v in rows:
        out[k] = v
    return out


def as_dict(df):
    return {bytes(r.key): None if r.value is None else bytes(r.value) for r in df.collect()}


changes = st.lists(st.tuples(st.binary(max_size=2), st.one_of(st.none(), st.binary(min_size=1, max_size=3))), max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(changes)
def test_latest_live_and_deleted(spark, rows):
    log, s = log_of(spark, rows), state(rows)
    assert as_dict(latest.latest(log)) == s
    assert as_dict(latest.live(log)) == {k: v for k, v in s.items() if v is not None}
    assert {bytes(r.key) for r in latest.deleted(log).collect()} == {k for k, v in s.items() if v is None}
    scan = latest.ordered_scan(log).orderBy("rank").collect()
    assert [bytes(r.key) for r in scan] == sorted(k for k, v in s.items() if v is not None)
    assert [r["rank"] for r in scan] == list(range(1, len(scan) + 1))


def test_update_delete_and_missing(spark):
    log = log_of(spark, [(b"k1", b"v1"), (b"k1", b"v2"), (b"k2", b"x"), (b"k2", None), (b"none", None), (b"", b"empty key")])
    assert as_dict(latest.live(log)) == {b"k1": b"v2", b"": b"empty key"}
    probes = spark.createDataFrame([(bytearray(b"k1"),), (bytearray(b"k2"),), (bytearray(b"k9"),), (bytearray(b"k1"),)], "key binary")
    assert {(bytes(r.key), r.found) for r in latest.multi_get(log, probes).collect()} == {(b"k1", True), (b"k2", False), (b"k9", False)}
    assert latest.get(log, bytearray(b"k1")).count() == 1


def test_limits(spark):
    log = log_of(spark, [(b"k" * 128, b"v" * 4096), (b"k" * 129, b"v"), (b"k", b"v" * 4097), (b"k", b""), (b"", None)])
    got = [r.s for r in log.orderBy("seq").select(changelog.status(log.key, log.value).alias("s")).collect()]
    assert got == ["ok", "key_too_large", "value_too_large", "empty_value", "ok"]
    with pytest.raises(Exception, match="_too_large|empty_value"):
        changelog.validated(log).collect()
    assert changelog.validated(log.where("seq = 0")).count() == 1


def test_layered_tombstone_hides_older_tier(spark):
    new = log_of(spark, [(b"a", None), (b"b", b"new")])
    old = log_of(spark, [(b"a", b"old"), (b"b", b"old"), (b"c", b"old")])
    assert as_dict(runs.layered_get(new, old)) == {b"b": b"new", b"c": b"old"}


def test_layered_runs_has_one_plan_for_any_number_of_runs(spark):
    rows = [(r, f"k{(r * 7 + i) % 400}", (r * 37) % 701, None if (r + i) % 5 == 0 else f"v{r}") for r in range(700) for i in range(3)]  # order of seq is not that of runs
    df = spark.createDataFrame(rows, "run long, key string, seq long, value string")
    want: dict = {}
    for r, k, q, v in sorted(rows, key=lambda x: x[2]):
        want[k] = (v, r)
    got = runs.layered_runs(df)
    assert {r.key: (r.value, r.run) for r in got.collect()} == {k: x for k, x in want.items() if x[0] is not None}
    few = runs.layered_runs(df.where("run < 2"))
    size = lambda f: f._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert size(got) == size(few) <= 2


def test_layered_get_query_reads_runs_as_one_table(spark, tmp_path):
    from keystrata.plans import queries

    rows = [(i, i % 40, ("view", "error", "click")[i % 3], float(i)) for i in range(200_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.layered_get(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 2  # not one for each of some 180 runs
    assert {r.key for r in got.collect()} == {f"user:{u}" for u in range(40) if max(i for i in range(200_000 - 120, 200_000) if i % 40 == u) % 3 != 1}


def test_compaction_many_blocks_and_tombstones(spark):
    rng = random.Random(3)
    rows = [(r, f"k{rng.randrange(400):04d}".encode(), None if rng.random() < 0.2 else bytes([rng.randrange(256)]) * rng.randrange(1, 300)) for r in range(9) for _ in range(150)]
    unique = {(r, k): v for r, k, v in rows}
    df = spark.createDataFrame([(r, bytearray(k), r, None if v is None else bytearray(v)) for (r, k), v in unique.items()], "run long, key binary, seq long, value binary")
    want = state([(k, v) for (r, k), v in sorted(unique.items(), key=lambda x: x[0][0])])
    live = {k: v for k, v in want.items() if v is not None}
    for compacted in (runs.compact_oldest, runs.compact_fixpoint):
        left, order = compacted(df, list(range(9)))
        assert as_dict(latest.live(left, "run")) == live
        assert order == ([3, 4, 5, 6, 7, 8] if compacted is runs.compact_oldest else [6, 7, 8])
    assert runs.compact_oldest(df, [0, 1, 2])[1] == [0, 1, 2]
    ten, order = list(range(10)), list(range(10))
    while len(order) >= 4:
        order = [order[3], *order[4:]]
    assert runs.compact_fixpoint(df, ten)[1] == order
    # deletes stay unless the oldest run is among the inputs
    part = df.where("run BETWEEN 2 AND 5")
    assert runs.compact(part, holds_oldest=False).where("value IS NULL").count() > 0
    blocked = blocks.with_blocks(df, 1024).collect()
    per: dict = {}
    for r in blocked:
        per.setdefault((r.run, r.block), []).append(r)
    assert all(sum(x["size"] for x in b) <= 1024 or len(b) == 1 for b in per.values())


def test_all_tombstones_compact_to_nothing(spark):
    df = spark.createDataFrame([(r, bytearray(b"k"), r, None) for r in range(4)], "run long, key binary, seq long, value binary")
    assert runs.compact_fixpoint(df, [0, 1, 2, 3])[0].count() == 0


def test_rotation(spark):
    rows = [(bytes([65 + i % 3]), b"v" * (i % 7 + 1)) for i in range(60)]
    log = log_of(spark, rows)
    run = {r.seq: r.running for r in segments.running_bytes(log.withColumn("seq", log.seq * 10**12 + 7)).withColumn("seq", segments.F.expr("seq div 1000000000000")).collect()}
    total = 0
    for i, (k, v) in enumerate(rows):
        total += len(k) + len(v)
        assert run[i] == total
    exact = {r.seq: r.segment for r in segments.rotate_exact(log, 12).collect()}
    segment, held = 0, {}
    for i, (k, v) in enumerate(rows):
        assert exact[i] == segment
        held[k] = v
        if sum(len(a) + len(b) for a, b in held.items()) >= 12:
            segment, held = segment + 1, {}


def test_rotate_exact_by_ranges(spark, monkeypatch):
    """Tables that begin in one range and are full in a later one, keys that are overwritten, ranges that fit one table."""
    monkeypatch.setattr(segments, "RANGE_ROWS", 20)
    rng = random.Random(11)
    for keys, limit in ((5, 23), (60, 70), (9, 75), (3, 10**6), (200, 4)):
        hot = [(f"k{rng.randrange(keys)}".encode(), None if rng.random() < 0.2 else b"v" * rng.randrange(1, 12)) for _ in range(260)]
        hot[90:150] = [(b"same", b"v" * (1 + i % 3)) for i in range(60)]  # whole ranges of one key
        exact = {r.seq: r.segment for r in segments.rotate_exact(log_of(spark, hot), limit).collect()}
        segment, held, want = 0, {}, {}
        for i, (k, v) in enumerate(hot):
            want[i], held[k] = segment, v
            if sum(len(a) + len(b or b"") for a, b in held.items()) >= limit:
                segment, held = segment + 1, {}
        assert exact == want


def test_rotate_exact_reads_no_whole_log_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(segments, "RANGE_ROWS", 1000)
    kind = type(spark.range(0))
    single, repartition = [], kind.repartition

    def counted(self, n, *cols):
        if n == 1:
            single.append(self.count())
        return repartition(self, n, *cols)

    monkeypatch.setattr(kind, "repartition", counted)
    log = spark.range(20_000).selectExpr("id AS seq", "concat('user:', (id * 7919) % 500) AS key", "'click|12345' AS value")
    assert segments.rotate_exact(log, 2048).count() == 20_000
    assert sum(single) < 2000


def test_find_block(spark):
    index = spark.createDataFrame([(0, 0, "c"), (0, 1, "f"), (1, 0, "b")], "run long, block long, last_key string")
    probes = spark.createDataFrame([(k,) for k in "acdgz"], "key string")
    got = {(r.run, r.key): r.block for r in blocks.find_block(index, probes).collect()}
    assert got == {(0, "a"): 0, (0, "c"): 0, (0, "d"): 1, (0, "g"): -1, (0, "z"): -1, (1, "a"): 0, (1, "c"): -1, (1, "d"): -1, (1, "g"): -1, (1, "z"): -1}


def test_find_block_in_chunks_and_tasks(spark, monkeypatch):
    rng = random.Random(5)
    entries = [(r, b, k) for r in range(23) for b, k in enumerate(sorted(f"{rng.randrange(1000):03d}" for _ in range(rng.randrange(1, 9))))]
    index = spark.createDataFrame([*entries, (23, 0, None)], "run int, block int, last_key string").repartition(7)
    asked = sorted({f"{rng.randrange(1000):03d}" for _ in range(300)}) + ["999", "", None]
    probes = spark.createDataFrame([(k,) for k in asked * 2], "key string")
    want = sorted((r, k or "", min([b for s, b, last in entries if s == r and k is not None and last >= k], default=-1)) for r in range(24) for k in set(asked))
    for chunk, rows in ((16, 100), (1024, 1_000_000), (7, 10**9)):
        monkeypatch.setattr(blocks, "CHUNK", chunk)
        monkeypatch.setattr(blocks, "TASK_ROWS", rows)
        assert sorted((r.run, r.key or "", r.block) for r in blocks.find_block(index, probes).collect()) == want
    assert blocks.find_block(index.where("false"), probes).count() == 0
    assert blocks.find_block(index, probes.where("false")).count() == 0


def test_find_block_answers_are_not_gathered(spark):
    """Many runs and probes of few bytes: the answer is made row by row in many tasks, not in Python by one."""
    index = spark.range(3000).selectExpr("id AS run", "0L AS block", "'k500' AS last_key")
    found = blocks.find_block(index, spark.range(1000).selectExpr("format_string('k%03d', id) AS key"))
    assert "InArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    per = found.groupBy(segments.F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per) == 3_000_000 and len(per) > 1
    assert found.groupBy("block").count().orderBy("block").collect() == [(-1, 499 * 3000), (0, 501 * 3000)]


def test_placed(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "(id * 7919) % 1000 + 1 AS n")
    for r in ordering.placed(df, "k", "n").collect():
        assert r.place == r.k + 1 and r.running == (r.k + 1) * (r.k + 2) // 2


def test_bloom_params():
    assert bloom_params(1500) == (14384, 6)
    assert bloom_params(0) == bloom_params(1)
    assert bloom_params(100, 2.0) == bloom_params(100)


def test_empty_tables(spark):
    log = log_of(spark, [])
    assert latest.live(log).count() == 0
    assert segments.rotate(log).count() == 0
    assert latest.ordered_scan(log).count() == 0
    assert runs.flush(segments.rotate(log)).count() == 0
