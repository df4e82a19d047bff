"""The pipeline, stage by stage, against what each operator says of the documents that reach it."""

from __future__ import annotations

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from keystrata.llm import common, jaccard_join, mixing, quality, suffix_dedup  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, small):
    """Documents before each stage and after the last."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = [(None, "a b c " * 30, "en", None, 180), (5000, None, "en", "src1", 0), (3, docs.where("doc_id = 3").first().text, "fr", "src3", 1)]
    out = [docs.union(spark.createDataFrame(odd, docs.schema)).withColumnRenamed("lang", "_0").selectExpr("*", "1 AS TEXT2", "2 AS bucket")]
    for _, stage in pipeline.STAGES:
        out.append(common.rewritten(stage(spark, out[-1], small)))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality(stages):
    kept = {r.doc_id for r in quality.judge(stages[0]).where("kept").collect()}
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == kept
    assert 5000 not in kept


def test_near_duplicates(stages):
    named = stages[1].where("doc_id IS NOT NULL")
    groups = {r.component_id for r in jaccard_join.similar_components(named).collect()}
    got = [r.doc_id for r in stages[2].where("doc_id IS NOT NULL").select("doc_id").collect()]
    assert sorted(got) == sorted(groups)


def test_substrings(stages):
    spans = {r.doc_id: r.spans for r in suffix_dedup.repeated_spans(stages[2]).collect()}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    cut = 0
    for i, places in spans.items():
        raw = (before[i] or "").encode()
        kept = b"".join(raw[a:b] for a, b in zip([0, *places[1::2]], [*places[::2], len(raw)], strict=True)).decode(errors="ignore")
        if i not in got:
            assert not kept.strip() and places
        elif not places:
            assert got[i][0] == before[i]
        else:
            cut += 1
            assert len(kept) - 2 * len(places) <= len(got[i][0]) <= len(kept) and got[i][1] == len(got[i][0])
    assert cut


def test_mixing(stages):
    times = {r.doc_id: r.times for r in mixing.mix(stages[3]).collect()}
    got = [r.doc_id for r in stages[4].select("doc_id").collect()]
    assert {i: got.count(i) for i in times} == times


def test_mixing_rows_of_one_id(spark):
    """Rows with one id and different sizes are taken as drawn."""
    from keystrata.llm.stages import mixing_stage

    rows = [(i // 3, " ".join(["w"] * (1 + i * 7 % 40)), "ab"[i % 2]) for i in range(300)] + [(None, "x y", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixing.mix(docs).groupBy("source").sum("taken").collect()
    got = mixing_stage(docs).groupBy("source").agg({"*": "count"}).collect()
    assert len(got) == len(want) == 3
    sized = mixing_stage(docs).selectExpr("source", "size(split(text, ' ')) AS n").groupBy("source").sum("n").collect()
    assert {tuple(r) for r in sized} == {tuple(r) for r in want}


def test_packing(stages):
    pieces = stages[5]
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in stages[4].select("doc_id").distinct().collect()}
    assert pieces.where("piece = 0").count() == stages[4].count()
    assert pieces.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= 4096


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_batches_are_small(spark, small, stages, k):
    """A stage's rows reach Python a few MB at a time, however long the texts; a bound of the session's own stays."""
    import pyarrow as pa

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [len(b)], "n_bytes": [b.nbytes]})

    texts = spark.range(0, 2_000, 1, 1).selectExpr("id", "repeat('some words of a text ', 500) AS text")  # 21 MB
    own = spark.conf.get(common.BATCH_SETTING, None)
    try:
        spark.conf.unset(common.BATCH_SETTING)
        pipeline.STAGES[k][1](spark, stages[k], small)
        got = texts.mapInArrow(seen, "rows long, n_bytes long").collect()
        assert sum(r.rows for r in got) == 2_000
        assert max(r.n_bytes for r in got) <= 1.1 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_SETTING, "1000000")
        pipeline.STAGES[k][1](spark, stages[k], small)
        assert spark.conf.get(common.BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(common.BATCH_SETTING) if own is None else spark.conf.set(common.BATCH_SETTING, own)


def test_batches_change_no_result(spark, small, stages):
    """Stages whose groups come in many batches give what they give in one."""
    own = spark.conf.get(common.BATCH_SETTING, None)
    try:
        for k in (0, 1, 2):  # those that decide by content alone
            got = []
            for size in ("1000", "67108864"):
                spark.conf.set(common.BATCH_SETTING, size)
                got.append(sorted(map(str, pipeline.STAGES[k][1](spark, stages[k], small).collect())))
            assert got[0] == got[1] and got[0]
        for k in (3, 4):
            spark.conf.set(common.BATCH_SETTING, "1000")
            assert pipeline.STAGES[k][1](spark, stages[k], small).count() == stages[k + 1].count()
    finally:
        spark.conf.unset(common.BATCH_SETTING) if own is None else spark.conf.set(common.BATCH_SETTING, own)


def test_run(spark, small):
    assert pipeline.run(spark, small).count() > 0


def test_empty(spark, small, stages):
    docs = stages[0].where("false")
    for _, stage in pipeline.STAGES:
        docs = common.rewritten(stage(spark, docs, small))
        assert docs.count() == 0


def test_one_row(spark, small, stages):
    docs = stages[0].where("doc_id = 6")
    for _, stage in pipeline.STAGES:
        docs = common.rewritten(stage(spark, docs, small))
    assert docs.count() >= 1
