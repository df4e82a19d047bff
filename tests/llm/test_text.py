"""Operators on texts against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import common as C
from keystrata.llm import jaccard_join, keycount, licenses, paragraphs, quality, suffix_dedup
from keystrata.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "doc_id long, text string"


def lower(t: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join(parent: dict, a, b) -> None:
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def docs(spark, small):
    """The small table, with odd rows and clashing columns."""
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    first = table.where("doc_id = 6").first().text
    odd = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "one two"), (1005, "ONE two"), (1006, first), (None, first), (None, "x " * 3), (1007, first[:-40] + " y z"), (1008, "word"), (1009, "é" * 400 + " a " + first)]
    return table.union(spark.createDataFrame(odd, ROWS)).selectExpr("1 AS bucket", "doc_id", "'no' AS TEXT", "text", "2 AS part", "doc_id AS label")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r[1], r[3]) for r in docs.collect()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x85|", max_size=40)), max_size=8))
def test_words(texts):
    data, offsets = C.text_buffers(pa.array(texts, pa.string()))
    w = C.words_of(data, offsets, C.WORD_SPACE, lower=False)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.starts[x:y], w.ends[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [x for words in got for x in words]
    assert len(set(flat)) == len(set(w.hashes.tolist()))
    h, first = C.window_hashes(w, 3)
    assert list(np.diff(first)) == [max(0, len(x) - 2) for x in got]
    windows = [tuple(x[i : i + 3]) for x in got for i in range(len(x) - 2)]
    assert len(set(windows)) == len(set(h.tolist()))


def test_hashes_by_pieces_are_the_same():
    """A very long text is hashed piece by piece; a word may be longer than a piece."""
    text = "x" * 5000 + " " + " ".join(f"wörd{k % 97}" for k in range(3000)) + " " + "y" * 3000
    data, offsets = C.text_buffers(pa.array([text]))
    w = C.words_of(data, offsets, C.WORD_SPACE, lower=False)
    for piece in (1, 100, 1000, 10**6):
        assert (C.span_hashes(w.data, w.starts, w.ends, piece) == w.hashes).all()


def test_very_long_texts(spark):
    """One text of some MB among short ones, in the operators that take a document at once."""
    long = "\n".join(" ".join(f"w{i * 7919 % 1_000_003}" for i in range(k * 50, k * 50 + 50)) for k in range(8000))
    table = spark.createDataFrame([(1, long), (2, "short one"), (3, long[:2000]), (4, long + " more")], ROWS)
    judged = {r.doc_id: r.n_words for r in quality.judge(table).collect()}
    assert judged[1] == 400_000 and judged[4] == 400_001
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(table).collect()}
    assert found[4][1] == 1 and found[3][1] == 3 and abs(found[1][0] - found[4][0]) <= 1
    assert {r.doc_id: r.n_words for r in licenses.scan(table).collect()}[1] == 400_000
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_spans(table).collect()}
    assert gone == {1: 0, 2: 0, 3: 2000, 4: len(long)}
    repeated = {(r.doc_id, r.removed) for r in paragraphs.repeated_paragraphs(table, passage=50, short=True).select("doc_id", "removed").distinct().collect()}
    assert {(1, False), (3, True), (4, True)} <= repeated and 2 not in {i for i, _ in repeated}


def test_quality(docs, rows):
    got = Counter()
    for r in quality.judge(docs).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept)] += 1
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, dup, lines = set(), 0, 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                lines += 1
                seen.add(line)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        symbols, chars = len(re.findall(r"[#*$%&|<>]", t)), sum(map(len, w))
        upper, letters = len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * symbols > len(w) or not 2 * len(w) <= chars <= 20 * len(w) or 2 * dup > lines or 2 * upper > letters
        want[(i, len(w), chars, symbols, dup, len(covered), not bad)] += 1
    assert got == want


def test_quality_order_does_not_matter(docs):
    expected = {(r.doc_id, r.kept) for r in quality.judge(docs, quality.RULES).collect()}
    assert {(r.doc_id, r.kept) for r in quality.judge(docs, tuple(reversed(quality.RULES)), wanted=()).collect()} == expected


def test_cascade_leaves_out_what_is_decided():
    """The rule that comes first spares the others its documents."""
    text = ["too few words", "fine " * 3 + " ".join(f"word{k}" for k in range(80)), None]
    data, offsets = C.text_buffers(pa.array(text))
    looked = []

    def case(batch):
        looked.append(len(batch))
        return quality.case_stats(batch)

    groups = quality.GROUPS | {"case": case}
    rules = (quality.RULES[0], quality.RULES[-1])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "GROUPS", groups)
        _, alive = quality.cascade(quality.Batch(data, offsets), rules)
        assert alive.tolist() == [False, True, False] and looked == [1]
        _, again = quality.cascade(quality.Batch(data, offsets), rules[::-1], ("length",))
        assert again.tolist() == alive.tolist() and looked == [1, 3]


def test_rule_order_is_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "#### " * 90 if i % 5 else " ".join(f"w{k}" for k in range(90))) for i in range(400)], ROWS).repartition(13)
    order = [r.name for r in quality.rule_order(docs)]
    assert sorted(order) == sorted(r.name for r in quality.RULES)
    assert order[-1] in ("few_words", "shouting", "word_length", "dup_lines") and order.index("symbols") < 2
    assert quality.rule_order(docs.where("false")) == quality.RULES


def test_quality_keeps_all_columns(docs):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.judge(docs).where("kept").count()


def shingles(t: str | None) -> frozenset:
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_components(docs, rows):
    parent: dict = {}
    named = [(C.NULL_ID if i is None else i, shingles(t)) for i, t in rows]
    for i, _ in named:
        parent[i] = i
    for a in range(len(named)):
        for b in range(a):
            x, y = named[a][1], named[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                join(parent, named[a][0], named[b][0])
    want = Counter((i, len(shingles(t)), None if find(parent, C.NULL_ID if i is None else i) == C.NULL_ID else find(parent, C.NULL_ID if i is None else i)) for i, t in rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs).collect())
    assert got == want


def test_jaccard_sizes_around_the_bands(spark):
    """Pairs just at and just under the threshold, in every band, with a passage that all share."""
    rows, parent = [], {}
    passage = [f"p{k}" for k in range(30)]
    for n in (5, 8, 20, 62, 63, 64, 65, 84, 85, 127, 128, 129, 255, 256, 300, 341, 511, 512, 700):
        base = [f"w{n}.{k}" for k in range(n)]
        for cut in (0, n // 9, n // 8, n // 7, n // 5):
            rows.append((len(rows), " ".join(passage + base[: n - cut])))
    rows += [(len(rows) + k, " ".join(passage)) for k in range(3)]
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                join(parent, a, b)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {i: find(parent, i) for i in parent}


def test_sketch_bounds():
    """Blocks that differ never exceed members that differ."""
    rng = np.random.default_rng(5)
    bounds = jaccard_join.Bounds(75, 100)
    for n in (70, 150, 400, 900):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[n // 20 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64) * np.uint64(2)]))
        sets = jaccard_join.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        s = jaccard_join.Sketches(sets, np.array([0, 1]), bounds)
        apart = len(np.setxor1d(a, b))
        runs = {(i, bool(r >= 2)): set(s.keys[s.first[r] : s.first[r + 1]].tolist()) for r, i in enumerate(s.set_at)}
        assert len(runs[0, False] - runs[1, False]) <= apart
        assert (np.diff(s.first) > s.apart).all()
        x, y = (np.frombuffer(v, np.uint64) for v in jaccard_join._bit_sketches(sets, np.array([0, 1])))
        assert np.bitwise_count(x ^ y).sum() <= apart


@settings(max_examples=8, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components(spark, edges):
    parent = {i: i for e in edges for i in e}
    for a, b in edges:
        join(parent, a, b)
    linked = {i for a, b in edges if a != b for i in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(parent, i) for i in linked}


def test_long_path_of_components(spark):
    got = {r.node: r.label for r in components(spark.range(60).selectExpr("id AS a", "id + 1 AS b")).collect()}
    assert got == dict.fromkeys(range(61), 0)


def brute_spans(rows):
    """(removed flags, bytes) of each row: strings of 50 bytes that start in a document with a smaller id."""
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, C.NULL_ID), C.NULL_ID if i is None else i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), C.NULL_ID if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < own:
                gone[k : k + 50] = b"\1" * 50
        out.append((bytes(gone), b))
    return out


def test_suffix_dedup(docs, rows):
    want = Counter()
    for (i, _), (gone, b) in zip(rows, brute_spans(rows), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.repeated_spans(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed


def test_suffix_dedup_in_groups_of_buckets(docs, rows, monkeypatch):
    """As on a corpus of many TB: keys and suffixes go through groups of buckets, and ranges are shared out by anchors."""
    want = Counter((i, len(b), sum(gone)) for (i, _), (gone, b) in zip(rows, brute_spans(rows), strict=True))
    real = suffix_dedup._splitters
    monkeypatch.setattr(C, "BUCKET_BYTES", 2e4)
    for fan, sample in ((4, 32_000_000), (2, 30_000)):
        monkeypatch.setattr(keycount, "FAN", fan)
        monkeypatch.setattr(suffix_dedup, "_splitters", lambda d, t, p, sample=sample: real(d, t, p, sample)[:: 1 if sample > 1e6 else 9])
        got = suffix_dedup.repeated_spans(docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got) == want


def test_key_counts_in_groups(spark):
    rng = np.random.default_rng(2)
    keys = {b: rng.choice(rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2), 200) for b in range(13)}
    for k in keys.values():
        k[:3] = [5, 1 << 62, (1 << 64) - 1]
    total = Counter(int(x) for k in keys.values() for x in k)
    for parts, fan in ((16, 64), (64, 8), (64, 4)):
        ranges = keycount.Ranges(parts, min(parts, fan))
        rows = [tuple(r[c] for c in ("bucket", "part", "keys", "counts")) for b, k in keys.items() for r in keycount.request(b, k, ranges)]
        answers = keycount.count(spark.createDataFrame(rows, keycount.REQUEST), ranges).toArrow()
        for b, k in keys.items():
            own = keycount.Answers(answers.filter(pa.array(answers["bucket"].to_numpy() == b)), k, ranges).of(k)
            assert own.tolist() == [(total[int(x)] - 1).bit_length() for x in k]


def test_spread_join(spark):
    rows = spark.createDataFrame([(k if k < 50 else -1, k) for k in range(400)], "u long, v long")
    table = rows.groupBy("u").agg(C.F.max("v").alias("m"), C.F.count("*").alias("n"))
    want = Counter(tuple(r) for r in rows.join(table, "u").collect())
    for share in (1, 2, 10_000):
        got = C.spread_join(rows, table, "u", "v", "n", 400, share=share)
        assert got.columns == ["u", "v", "m", "n"] and Counter(tuple(r) for r in got.collect()) == want


def test_suffix_dedup_periodic_and_shifted(spark):
    base = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [(0, base), (1, "x" + base[10:59]), (2, "x" + base[10:60]), (3, "a" * 200), (4, "a" * 49), (5, "a" * 50), (6, "ab" * 100), (7, "b" + "ab" * 30 + base[100:180] + "é" * 30), (8, "é" * 40), (9, base[40:95] + base[200:260]), (9, base[40:95])]
    want = Counter((i, sum(g)) for (i, _), (g, _) in zip(rows, brute_spans(rows), strict=True))
    assert Counter((r.doc_id, r.n_removed) for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, ROWS)).collect()) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=16, max_size=16), max_size=40), st.lists(st.integers(0, 39), max_size=40))
def test_multikey(rows, copies):
    rows = rows + [rows[c % len(rows)] for c in copies] if rows else rows
    m = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 16)
    order, starts = suffix_dedup.multikey(m)
    assert [rows[k] for k in order] == sorted(rows)
    assert [rows[order[s]] for s in starts] == sorted(set(rows))


def test_long_document_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONGEST", 500)
    monkeypatch.setattr(C, "doc_runs", lambda offsets, size=0: [(i, i + 1) for i in range(len(offsets) - 1)])
    rng = np.random.default_rng(1)
    text = "".join(chr(c) for c in rng.integers(97, 105, 2345))
    t = pa.table({"doc_id": [1], "text": [text], "bucket": [0]})
    pieces = suffix_dedup.Bucket(t)
    found = {}
    for doc, at, _, a in pieces.runs:
        for p, low, high in zip(a.at, a.low, a.high, strict=True):
            for w in range(low, high + 1):
                assert found.get(w + at, p + at) == p + at
                found[w + at] = p + at
    assert sorted(found) == list(range(2345 - 49))


def test_paragraphs(docs, rows):
    units = []
    for i, t in rows:
        lines = [w for w in (WORD.findall(x) for x in lower(t or "").split("\n")) if w]
        for k in range(len(lines)):
            w, j = [], k
            while j < len(lines) and len(w) < 30:
                w += lines[j]
                j += 1
            if len(w) >= 30 or (j == len(lines) and len(w) >= 20):
                units.append((C.NULL_ID if i is None else i, k, frozenset(zip(*(w[q:] for q in range(5)), strict=False))))
    inverted = defaultdict(list)
    for x, (_, _, s) in enumerate(units):
        for q in s:
            inverted[q].append(x)
    parent = {x: x for x in range(len(units))}
    for x, (_, _, s) in enumerate(units):
        for y, n in Counter(y for q in s for y in inverted[q] if y > x).items():
            if 100 * n >= 75 * (len(s) + len(units[y][2]) - n):
                join(parent, x, y)
    groups = defaultdict(list)
    for x in parent:
        groups[find(parent, x)].append(units[x][:2])
    want = {(i, k) for g in groups.values() if len({i for i, _ in g}) > 1 for i, k in g}
    got = paragraphs.repeated_paragraphs(docs).collect()
    found = {(C.NULL_ID if r.doc_id is None else r.doc_id, r.line) for r in got}
    assert found <= want
    assert len(found) >= 0.99 * len(want)
    for r in got:
        assert r.removed == ((r.doc_id, r.line) != (r.first_doc_id, r.first_line))


def test_paragraphs_inside_lines(spark):
    """Any 50 words that two documents share hold a window of both, in long lines and across lines."""
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"f{k}" for k in rng.integers(0, 1 << 40, n)]
    rows, shared = [], []
    for k, (n, before) in enumerate([(50, 75), (50, 1), (57, 9), (61, 33), (120, 40), (50, 0)]):
        passage = fresh(n)
        for way in range(2):
            words = fresh(before + 7 * way) + passage + fresh(80 - before)
            breaks = rng.integers(0, 25, len(words)) == 0 if k % 2 else np.zeros(len(words), bool)
            rows.append((2 * k + way, "".join(w + ("\n" if b else " ") for w, b in zip(words, breaks, strict=True))))
            shared.append(passage)
    rows.append((99, " ".join(["same"] * 200)))
    found = defaultdict(list)
    for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, ROWS), passage=50).collect():
        text = dict(rows)[r.doc_id]
        found[r.doc_id].append((text[r.start : r.start + r.n_bytes].split(), r.removed, r.first_doc_id))
        assert r.line == text[: r.start].count("\n")
    assert set(found) == set(range(12))
    for i, passage in enumerate(shared):
        ends = [k + 30 for k in range(len(passage) - 29) for w, removed, first in found[i] if w == passage[k : k + 30] and removed == bool(i % 2) and first == i - i % 2]
        assert all(any(a + 30 <= e <= a + 50 for e in ends) for a in range(len(passage) - 49))


def test_recall_of_repeated_passages(docs, rows):
    """Of all runs of 50 words or more that another document holds, wherever they begin, nine of ten at least are met."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    own = {i: [(m[0], m.start(), m.end()) for m in word.finditer(lower(t).encode())] for i, t in rows if t and i is not None}
    holders = defaultdict(set)
    for i, words in own.items():
        for k in range(len(words) - 49):
            holders[tuple(w for w, *_ in words[k : k + 50])].add(i)
    found = defaultdict(list)
    for r in paragraphs.repeated_paragraphs(docs, passage=50, short=True).collect():
        found[r.doc_id].append((r.start, r.start + r.n_bytes))
    met = runs = 0
    for i, words in own.items():
        shared = [k for k in range(len(words) - 49) if len(holders[tuple(w for w, *_ in words[k : k + 50])]) > 1]
        for x, k in enumerate(shared):
            if not x or shared[x - 1] != k - 1:
                end = next((shared[y] for y in range(x, len(shared)) if y + 1 == len(shared) or shared[y + 1] != shared[y] + 1), k) + 49
                runs += 1
                met += any(a < words[end][2] and b > words[k][1] for a, b in found[i])
    assert runs > 20 and met >= 0.9 * runs


def test_short_documents_are_paragraphs(spark):
    near = [f"n{k}" for k in range(19)]
    rows = [(0, "one"), (1, " ONE\n"), (2, "one two"), (3, "two one"), (4, "one\ntwo"), (5, "a b c d"), (6, "a b c d e"), (7, "A b c\nd e"), (8, " ".join(near)), (9, " ".join([*near[:-1], "x"])), (10, "alone is not repeated"), (11, "one"), (12, ""), (13, None), (14, "a b c d " + "z " * 20)]
    got = {(r.doc_id, r.line, r.first_doc_id, r.n_words, r.removed) for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, ROWS), short=True).collect()}
    groups = [(1, [0, 1, 11]), (2, [2, 4]), (5, [6, 7]), (19, [8, 9])]
    assert got == {(i, 0, g[0], n, i != g[0]) for n, g in groups for i in g}


def test_bands():
    for recall in (0.9, 0.99, 0.999):
        n = paragraphs.bands(0.75, recall)
        assert 1 - (1 - 0.75**2) ** n >= recall > 1 - (1 - 0.75**2) ** (n - 1)


def test_paragraph_hashes_do_not_depend_on_neighbours():
    texts = ["a b c d e f g h i j k l m n o p q r s t u v\n" + " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(35))]

    def nodes(order):
        data, offsets = C.text_buffers(pa.array([texts[k] for k in order]))
        p = paragraphs.Paragraphs(data, offsets, 8, 30, 20, 5)
        return {(int(n), b.tobytes()) for n, b in zip(p.node, p.bands, strict=True)}

    assert nodes([0, 1]) == nodes([1, 0]) == nodes([1]) | nodes([0])


def test_licenses(spark, docs, rows):
    extra = [
        (2000, "Released under the MIT License.\nCC BY and cc-by; the Apache\nLicense"),
        (2001, "permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files"),
        (2002, "gnu general public licenses; GNU  general-public/license"),
        (2003, "cc cc by by"),
    ]
    table = C.pick(docs, doc_id="doc_id", text="text", labels="label").union(spark.createDataFrame(extra, ROWS).selectExpr("doc_id", "text", "doc_id"))
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t in [*rows, *extra]:
        raw = lower(t or "").encode()
        w = word.findall(raw)
        at, base = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.encode().split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    base.add(label)
        labels, score = set(base), 1.0 if at else 0.0
        for line in raw.split(b"\n"):
            have = set(word.findall(line))
            for q in licenses.templates_of():
                if 100 * len(q.words & have) >= 80 * len(q.words):
                    labels.add(q.label)
                    score = max(score, len(q.words & have) / len(q.words))
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(table).collect())
    assert got == want
    assert any("mit" in x[6] and not x[5] for x in got)


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    rows = [
        (0, mit),
        (1, "Copyright X\n\n" + bsd + "\n1. more"),
        (2, "\n".join(next(t for x, t in licenses.TEMPLATES if x == "mit" and t.endswith("files")).split())),
        (3, " * " + mit.replace("\n", "\r\n *\n * ")),
        (4, mit.replace("\n", "\n" + "between " * 30 + "\n")),
        (5, mit.split("\n")[0]),
        (6, mit.split("\n")[1]),
        (7, "Permission is hereby granted to nobody\n" * 9),
        (8, mit.replace("\n", " ")),
    ]
    got = {r.doc_id: (r.labels, r.score, [tuple(b) for b in r.blocks]) for r in licenses.scan(spark.createDataFrame(rows, ROWS)).collect()}
    whole, none = lambda word, label: (label, 1.0, [(word, label, 1.0)]), ("", 0.0, [])
    want = {0: whole(0, "mit"), 1: whole(2, "bsd"), 2: whole(0, "mit"), 3: whole(0, "mit"), 4: none, 5: none, 6: none, 7: none, 8: whole(0, "mit")}
    assert {i: got[i][:2] for i in got} == {i: want[i][:2] for i in want}
    assert all(want[i][2] == [] or want[i][2][0] in got[i][2] for i in want)


@pytest.mark.parametrize("operator", [quality.judge, jaccard_join.similar_components, suffix_dedup.repeated_spans, paragraphs.repeated_paragraphs, licenses.scan])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], ROWS)).collect() == []
