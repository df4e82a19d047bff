"""Mixing, URLs, GIFs, packing, chats and the pipeline against brute force, properties and round trips."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import chat, gif, mixing, packing, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "doc_id long, text string"


# ---------------------------------------------------------------- mixing


def water_fill(sizes: list[int], cap: float = 3.0) -> list[float]:
    """Targets by the contract, source by source."""
    weights, full = [(5, 2, 1)[i % 3] for i in range(len(sizes))], [False] * len(sizes)
    while True:
        weight = sum(w for w, c in zip(weights, full, strict=True) if not c)
        rest = sum(sizes) - sum(cap * n for n, c in zip(sizes, full, strict=True) if c)
        got = [cap * n if c else w * rest / weight for w, n, c in zip(weights, sizes, full, strict=True)]
        over = [i for i, (t, n) in enumerate(zip(got, sizes, strict=True)) if t > cap * n and not full[i]]
        if not over:
            return got
        for i in over:
            full[i] = True


@pytest.mark.parametrize("sizes", [[5], [0], [0, 0, 9], [1, 1000, 3, 0, 70, 2, 2, 500, 1], [100, 1, 1, 1, 1], [7] * 8, [10**9, 5 * 10**9, 3]])
def test_targets(spark, sizes):
    names = [None if i == len(sizes) - 1 else chr(65 + 300 * i) for i in range(len(sizes))]
    sized = spark.createDataFrame([(n, x) for name, size in zip(names, sizes, strict=True) for n, x in [(name, size // 2), (name, size - size // 2)]], "source string, size long")
    found = mixing.source_targets(sized)
    got = {r.source: r.target for r in found.table.collect()}
    want = water_fill(sizes)
    assert got == pytest.approx(dict(zip(names, want, strict=True))) and sum(want) == pytest.approx(sum(sizes))
    assert all(got[n] <= 3 * x + 1e-6 for n, x in zip(names, sizes, strict=True))
    assert (found.sources, found.rows, found.most) == (len(sizes), 2 * len(sizes), 2)


def test_sources_beyond_a_broadcast(spark):
    """Hot sources and the others join alike, whatever is broadcast."""
    rows = [(i, None if i % 50 == 1 else f"s{i % 200 if i % 3 else 0}", i % 17) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = mixing.source_targets(sized)
    want = Counter(tuple(r) for r in targets.joined(sized).collect())
    assert Counter(tuple(r) for r in targets.joined(sized, small=0, share=20).collect()) == want and sum(want.values()) == 3000


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1)), max_size=40), st.integers(0, 9))
def test_flight_keeps_both_totals(rows, seed):
    rows.sort(reverse=True)
    s, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    q, left = mixing.flight(s, p, random.Random(seed))
    assert len(left) <= 2
    assert all(q[i] in (0.0, 1.0) for i in range(len(q)) if i not in left)
    assert q.sum() == pytest.approx(p.sum(), abs=1e-5)
    assert (q * s).sum() == pytest.approx((p * s).sum(), abs=1e-2)


def test_flight_is_unbiased():
    s, p = np.array([90.0, 70, 50, 30, 10, 10]), np.array([0.3, 0.5, 0.7, 0.2, 0.4, 0.9])
    mean = np.mean([mixing.flight(s, p.copy(), random.Random(k))[0] for k in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.05


def test_mix(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    odd = [(5000, None, "src1"), (5001, "", None), (5002, "a b c", None), (None, "d e f", "src2"), (None, "d e f", "src2"), (5003, "x", "Über"), (5004, "", "zero")]
    docs = table.union(spark.createDataFrame(odd, "doc_id long, text string, source string")).selectExpr("doc_id", "text", "source", "1 AS size", "'x' AS SOURCE_SIZE", "3 AS row")
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes: Counter = Counter()
    for r in docs.collect():
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(order, water_fill([sizes[s] for s in order]), strict=True))
    taken: Counter = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.times * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= max(0.05 * targets[s], 60)
    again = Counter(tuple(r) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == Counter(tuple(r) for r in got)


def test_mix_in_slices(spark):
    """Many slices of a source, merged in rounds, still meet the target."""
    rows = [(i, "w " * (1 + i * 37 % 90), "a" if i % 3 else "b") for i in range(3000)]
    sized = spark.createDataFrame([(i, s, len(t.split())) for i, t, s in rows], "doc_id long, source string, size long")
    targets = mixing.source_targets(sized)
    drawn = mixing.draw(sized, targets, slice_rows=20).collect()
    assert len(drawn) == 3000
    for t in targets.table.collect():
        assert abs(sum(r.times * r["size"] for r in drawn if r.source == t.source) - t.target) < 30


# ---------------------------------------------------------------- URLs


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u[u.index("://") + 3 :]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


URLS = [None, "", "x", "://", "http://", "http://COM/", "http://notcom/x", "http://a.com", "http://a.com/?q=/en/", "http://example.com/en/", "http://www.example.com/en/a", "http://WWW.EXAMPLE.COM/en", "http://x.www.example.com/en/#a", "http://net/es/", "http://a.b.net/fr/x://y", "http://a.net/FR/", "http://anet/es/", "ftp://q?x#y/z", "http://.com/", "http://a..net/es/", "https://É.com/en/"]


def test_urls(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(9000 + i, u) for i, u in enumerate(URLS)] + [(None, "http://a.com/"), (9000, "http://a.com/")], "page_id long, url string"))
    pages = pages.selectExpr("page_id", "url", "'h' AS host", "'v' AS tokens", "0 AS URL")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_rules.judge_urls(pages, labels).collect())
    want = Counter()
    for r in pages.collect():
        host, path = split_url(r[1])
        fit = [(len(x.name), x.name, x.verdict) for x in url_rules.LIST_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, default=(0, None, None))
        want[(r[0], host, path, best[1], best[2])] += 1
    assert got == want


def test_mined_rules(spark):
    rows = [(i, ["dir:ads", "top:org", f"host:{i}"] if i % 2 else ["dir:news", "top:org", f"host:{i}"], "block" if i % 2 else "allow") for i in range(200)]
    mined = url_rules.mine(spark.createDataFrame(rows, "id long, tokens array<string>, label string"), min_support=0.1)
    assert {(r.tokens, r.verdict) for r in mined} == {(("dir:ads",), "block"), (("dir:news",), "allow")}
    index = url_rules.RuleIndex(mined)
    assert index.verdict(["dir:ads", "x"])[0] == "block"
    assert index.verdict(["top:org"]) == ("allow", -1)
    assert url_rules.mine(spark.createDataFrame([], "id long, tokens array<string>, label string")) == ()


def brute_rules(baskets, min_support=0.005, min_confidence=0.8, most=3):
    """Every combination of up to three tokens, counted."""
    counts, labels = Counter(), Counter(label for _, label in baskets)
    for found, label in baskets:
        for n in range(1, most + 1):
            for c in itertools.combinations(sorted(found), n):
                counts[c] += 1
                counts[c, label] += 1
    n, least, rules = len(baskets), math.ceil(len(baskets) * min_support), {}
    for label in labels:
        for c in [c for c in counts if isinstance(c[0], str)]:
            both = counts[c, label]
            if both >= least and both / counts[c] >= min_confidence and both / counts[c] > labels[label] / n:
                rules[c, label] = (both / counts[c], both / n)
    keep = []
    for (c, label), (confidence, support) in rules.items():
        parts = [p for k in range(1, len(c)) for p in itertools.combinations(c, k)]
        if not any((p, label) in rules and rules[p, label][0] >= confidence for p in parts):
            keep.append((confidence, support, -len(c), c, label))
    return sorted(keep, reverse=True)


def test_verdicts_of_the_method(spark, small):
    """Whole verdicts on pages: mined rules and matches against counting all combinations."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 10000", "replace(replace(url, '/en/', '/es/'), '.com', '.net')", "html"))
    # labels that URLs can tell: three of four pages under /es/ are bad, all of www ones, and some by chance
    bad_if = "(url LIKE '%/es/%' AND page_id % 4 > 0) OR url LIKE '%//www.%' OR page_id % 11 = 0"
    labels = pages.where("page_id % 3 > 0").selectExpr("page_id AS doc_id", f"cast({bad_if} AS int) AS toxic", "1 AS quality")
    bad = {}
    for r in labels.collect():
        bad[r.doc_id] = bad.get(r.doc_id, False) or r.toxic == 1 or r.quality == 0
    host, path = url_rules.host_and_path(url_rules.F.col("url"))
    seen = {r.page_id: set(r.tokens) for r in pages.select("page_id", url_rules.tokens(host, path, url_rules.F.col("url")).alias("tokens")).collect()}
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labels).collect()}
    baskets = []
    for i, found in seen.items():
        label = {True: "block", False: "allow"}.get(bad.get(i))
        if label:
            baskets.append((found, label))
    rules = brute_rules(baskets)
    assert rules and any(r[4] == "block" for r in rules)
    mined = blocked = 0
    for i, found in seen.items():
        if not got[i].rule:
            fit = next((r for r in rules if set(r[3]) <= found), None)
            assert (got[i].verdict, got[i].mined) == ((fit[4], " ".join(fit[3])) if fit else ("allow", None))
            mined += fit is not None
            blocked += got[i].verdict == "block"
    assert mined and blocked
    assert {r.verdict for r in url_rules.judge_urls(pages, None).where("rule IS NULL").collect()} == {"allow"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcdef"), min_size=1, max_size=3), st.sampled_from(["allow", "block"]), st.integers(1, 9)), max_size=12), st.sets(st.sampled_from("abcdefg")))
def test_rule_index_equals_scan(rules, have):
    mined = tuple(sorted((url_rules.MinedRule(tuple(sorted(t)), v, c / 10, 0.1, 2.0) for t, v, c in rules), key=url_rules.MinedRule.rank, reverse=True))
    fits = [(k, r.verdict) for k, r in enumerate(mined) if set(r.tokens) <= have]
    want = (fits[0][1], fits[0][0]) if fits else ("allow", -1)
    assert url_rules.RuleIndex(mined).verdict(list(have)) == want


# ---------------------------------------------------------------- GIF


def textbook_lzw(stream: bytes, min_size: int) -> bytes:
    """A decoder bit by bit, to hold the fast one and the encoder against."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    value, bits, at, width = 0, 0, 0, min_size + 1
    table: dict[int, bytes] = {}
    out, previous = b"", None
    while True:
        while bits < width:
            value |= stream[at] << bits
            at, bits = at + 1, bits + 8
        code, value, bits = value & ((1 << width) - 1), value >> width, bits - width
        if code == clear:
            table, width, previous = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            free = clear + 2
        elif code == end:
            return out
        else:
            entry = table[code] if code in table else previous + previous[:1]
            if previous is not None and free < 4096:
                table[free] = previous + entry[:1]
                free += 1
            if free == 1 << width and width < 12:
                width += 1
            out, previous = out + entry, entry


@pytest.mark.parametrize("size", [2, 3, 7, 8])
@pytest.mark.parametrize("n", [0, 1, 300, 5000, 40_000])
def test_lzw(size, n):
    rng = random.Random(n)
    for data in (bytes(rng.randrange(1 << size) for _ in range(n)), bytes(n), bytes((k * k // 7) % (1 << size) for k in range(n))):
        stream = gif.lzw_encode(data, size)
        assert textbook_lzw(stream, size) == data
        assert gif.lzw_decode(stream, size, n) == data


def lzw_with_clears(data: bytes, min_size: int, every: int) -> bytes:
    """A textbook encoder that clears its table after every so many codes, as other encoders may."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    value = bits = 0
    width, table, free = min_size + 1, {bytes([i]): i for i in range(clear)}, clear + 2

    def emit(code: int) -> None:
        nonlocal value, bits
        value |= code << bits
        bits += width

    emit(clear)
    held, since = b"", 0
    for b in data:
        if held + bytes([b]) in table:
            held += bytes([b])
            continue
        emit(table[held])
        since += 1
        if since == every:
            if free < 4096 and free + 1 > 1 << width:
                width = min(width + 1, 12)
            emit(clear)
            width, table, free, since = min_size + 1, {bytes([i]): i for i in range(clear)}, clear + 2, 0
        elif free < 4096:
            table[held + bytes([b])] = free
            free += 1
            if free > 1 << width and width < 12:
                width += 1
        held = bytes([b])
    if held:
        emit(table[held])
        if free < 4096 and free + 1 > 1 << width:
            width = min(width + 1, 12)
    emit(end)
    return value.to_bytes((bits + 7) // 8, "little")


@pytest.mark.parametrize("every", [1, 2, 50, 254, 300, 1000, 3000, 5000])
def test_lzw_with_early_clear_codes(every):
    rng = random.Random(every)
    for size, n in ((8, 20_000), (2, 3_000), (4, 9_000)):
        data = bytes(rng.randrange(1 << size) for _ in range(n))
        stream = lzw_with_clears(data, size, every)
        assert textbook_lzw(stream, size) == data
        assert gif.lzw_decode(stream, size, n) == data


def test_lzw_damage():
    stream = gif.lzw_encode(bytes(range(200)), 8)
    with pytest.raises(gif.GifError):
        gif.lzw_decode(stream[:50], 8, 200)
    with pytest.raises(gif.GifError):
        gif.lzw_decode(b"\xff" * 60, 8, 200)
    with pytest.raises(gif.GifError):
        gif.lzw_decode(stream, 12, 200)


def test_gif_disposal_transparency_interlace():
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    palette = np.array([red, green, blue, [9, 9, 9]], np.uint8)
    full = np.zeros((4, 4), np.uint8)
    dot = np.array([[1, 3], [3, 1]], np.uint8)
    frames = [
        gif.Frame(full, delay=5, disposal=1),
        gif.Frame(dot, 1, 1, delay=7, disposal=3, transparent=3),
        gif.Frame(np.full((2, 2), 2, np.uint8), 2, 2, delay=1, disposal=2),
        gif.Frame(np.array([[0]], np.uint8), 0, 0, delay=2, disposal=0, palette=np.array([[1, 2, 3]], np.uint8)),
        gif.Frame(np.arange(16, dtype=np.uint8).reshape(16, 1)[:4] % 4, 3, 0, interlaced=True),
    ]
    data = gif.encode(gif.Gif(4, 4, palette, 0, frames, loops=3))
    got = gif.decode(data)
    assert got.loops == 3 and [f.delay for f in got.frames] == [5, 7, 1, 2, 0]
    shown = [(t, s) for t, _, s in gif.composed(got)]
    assert [t for t, _ in shown] == [0, 5, 12, 13, 15]
    screens = [s[..., :3].tolist() for _, s in shown]
    assert screens[1][1][1] == green and screens[1][1][2] == red and screens[1][2][2] == green
    assert screens[2][1][1] == red and screens[2][2][2] == blue
    assert shown[3][1][2, 2, 3] == 0 and screens[3][0][0] == [1, 2, 3]
    assert [screens[4][r][3] for r in range(4)] == [red, green, blue, [9, 9, 9]]
    assert gif.histogram(shown[0][1])[3 * 16] == 16
    for bad in (data[:-1], b"PNG", data[:20], data[:13] + b"\x07"):
        with pytest.raises(gif.GifError):
            gif.decode(bad)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_round_trip(data):
    payload = gif.padded(data)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[: len(data)] == data
    assert gif.payload_of(gif.decode(gif.payload_gif(payload))) == payload


def test_text_media(spark):
    rows = [(1, None), (2, ""), (3, "é" * 300), (4, "abc " * 40_000), (5, "é" * 300), (None, "x"), (1, "y"), (6, "a" * 576), (7, "a" * 577)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("text", "doc_id", "1 AS media", "2 AS MEDIA_BYTES")
    got = gif.text_media(docs).collect()
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({r.media_sha256 for r in got if r.doc_id in (3, 5)}) == 1
    for r in got:
        screens = [x for _, _, x in gif.composed(gif.decode(bytes(r.media)))]
        total = np.sum([gif.histogram(x, gif.BINS) for x in screens], axis=0)
        assert r.colours == np.flatnonzero(total).tolist() and r.histogram == total[total > 0].tolist()
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and sum(r.histogram) == r.payload_bytes
    frames = gif.frames(spark.createDataFrame([(1, bytearray(got[3].media)), (2, None)], "id long, media binary")).collect()
    assert len(frames) == got[3].n_frames and [f.time_cs for f in sorted(frames, key=lambda f: f.frame)] == [10 * k for k in range(len(frames))]


# ---------------------------------------------------------------- packing


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    lengths.sort(reverse=True)
    bins = packing.best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fills = [sum(lengths[i] for i in b) for b in bins]
    assert all(f <= 50 for f in fills)
    want: list[int] = []
    for n in lengths:
        room = [(50 - f, k) for k, f in enumerate(want) if 50 - f >= n]
        if room:
            want[min(room)[1]] += n
        else:
            want.append(n)
    assert sorted(want) == sorted(fills)


def test_packing(spark, small):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = [(900, None), (901, ""), (902, " \n\t\u00a0 "), (903, "<|endoftext|> it's\u2028x <|startoftext|>y 3\u0301 \u0130\ta"), (None, "z"), (904, "word, " * 9000), (904, "word, " * 9000), (905, "e\u0301 \u0301x \u03a3\u03a3")]
    docs = table.union(spark.createDataFrame(odd, ROWS)).selectExpr("1 AS slice", "doc_id", "text", "2 AS piece")
    got = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for spans in rows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rows) <= -(-sum(r.length for r in got) // 4096) * 1.05 + 1


def test_tokens_of_letters_with_marks():
    """Every letter that changes when it is composed or lower-cased, and a spread of others, beside every ASCII mark."""
    from tokenizers import Tokenizer

    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    changing = [c for c in letters if len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c]
    assert "\u0130" in changing and "\u0958" in changing
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    texts = ["".join(f"{a}{c}{b}{m}{c} {m}{c}" for m in marks) for c in changing + letters[::40] for a, b in (("", ""), ("e", "e"))]
    alphabet = [*"aE .,'-<|\n\tsS1\u0301\u0307\u0338", *changing]
    rng = random.Random(4)
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(4000)]
    ids, bounds = encoder.encode(pa.array(texts))
    for k, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k]


def test_packing_in_rounds(spark):
    """Many slices; also lengths that cannot share a sequence, where merging has to stop."""
    for lengths, most in (([1 + i * 31 % 90 for i in range(2000)], 1.08), ([60] * 500, 1.7)):
        pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length int, crc long")
        got = packing.pack(pieces, capacity=100, slack=0, slice_rows=40, fan_in=4).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(lengths)))
        assert len({r.sequence_id for r in got}) <= sum(lengths) / 100 * most + 1


# ---------------------------------------------------------------- chats

tricky = st.text(alphabet="ab\\<[/]s>INSTR\n é", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]\\"]), tricky, st.integers(0, 60)), max_size=14), st.integers(0, 3))
def test_windows(rows, history):
    turns = [chat.Turn(r, t, n) for r, t, n in rows]
    got = list(chat.windows(iter(turns), 100, history, 3, 2))
    parsed = [chat.parse(w.text) for w in got]
    assert [(r, t) for w in parsed for r, t, fresh in w if fresh] == [(r, t) for r, t, _ in rows]
    learnt = [chat.unescape(w.text[a:b]) for w in got for a, b in w.spans]
    assert learnt == [t for r, t, _ in rows if r == "assistant"]
    place = 0
    for k, (w, p) in enumerate(zip(got, parsed, strict=True)):
        fresh = sum(f for *_, f in p)
        own = [n for *_, n in rows[place : place + fresh]]
        system = rows[0] if rows[0][0] == "system" and k else None
        assert fresh >= 1 and [f for *_, f in p] == [False] * (len(p) - fresh) + [True] * fresh
        assert w.tokens <= 100 or len(p) == 1
        if place + fresh < len(rows):  # the next turn had no room
            assert w.tokens + rows[place + fresh][2] > 100
        if system and system[2] + 2 <= min(50, 100 - own[0]) - 3:
            assert p[0] == ("system", system[1], False)
        assert sum(not f for *_, f in p) <= history + bool(system)
        place += fresh


def test_windows_keep_to_the_budget(spark):
    """Tokens of the text as it is written, with long system turns and turns that need escapes."""
    rng = random.Random(6)
    rows = [(c, k, "system" if not k else ("user", "assistant")[k % 2], "say [so] <b> " * (rng.randrange(60) if k else c * 12)) for c in range(8) for k in range(12)]
    count = chat._counter("byte_bpe_50k.tiktoken")
    longest = {}
    for w in chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=256).collect():
        turns = chat.parse(w.text)
        tokens = count(chat.BEGIN) + sum(count(chat.mark_of(r)) + count(chat.escape(t)) + count(chat.END_OF_TURN) + (not fresh) * count(chat.REPEATED) for r, t, fresh in turns)
        assert w.tokens == tokens and (tokens <= 256 or len(turns) == 1)
        longest[w.conv_id] = max(longest.get(w.conv_id, 0), tokens)
    assert max(longest.values()) > 200


@given(tricky)
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"(?<!\\)(?:\\\\)*[<\[]", chat.escape(text))


def test_chat_digests(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    odd = [(7000, 1, "assistant", None), (7000, 0, None, "hi"), (7000, None, "user", "first"), (None, 0, "user", "x"), (7001, 0, "assistant", "same"), (7001, 0, "assistant", "same"), (7002, 0, "assistant", "long " * 3000)]
    both = table.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).selectExpr("conv_id", "turn", "role", "text", "1 AS TEXT")
    groups = defaultdict(list)
    for r in both.collect():
        groups[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    want = {}
    for i, rows in groups.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in rows)
        learnt = "".join(t for *_, r, t in rows if r == "assistant")
        want[i] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(both, budget=256).collect()}
    assert got == want
    windows = chat.chat_windows(both, budget=256).collect()
    assert {w.conv_id for w in windows} == set(want)
    assert chat.op9_chat_windows(spark, small).where("conv_id = -1").count() == 1


@pytest.mark.parametrize("what", ["mix", "pack", "media", "urls", "chats"])
def test_empty_tables(spark, what):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    empty = {
        "mix": lambda: mixing.mix(docs),
        "pack": lambda: packing.pack_documents(docs),
        "media": lambda: gif.text_media(docs),
        "urls": lambda: url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string"), None),
        "chats": lambda: chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    }[what]()
    assert empty.collect() == []
