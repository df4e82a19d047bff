"""Jaccard self-join of documents' word n-gram sets by parity sketches.

A set's sketch splits the hash space of n-grams into blocks and keeps of each block the XOR of a random 64-bit word for
every member: a parity, so a pair's common members cancel, and the number of blocks that differ (the sketches' Hamming
distance over blocks) is at most the size of the symmetric difference.  For sets at or above the threshold that size is
at most D, known from their sizes.  So a set with more than D filled blocks has an equal filled block with every
partner (pigeonhole), and even one among its D + 1 rarest: blocks that most documents share, as a common passage
makes them, are passed over without losing a pair.

Sizes fall into bands by powers of two.  The join of a band takes the sets of that band and the larger ones that can
still reach the threshold, all with the band's number of blocks, so that a set takes part in one or two joins.
Up to 63 members, every member is a block of its own.  The filled blocks of larger sets are at least 7.5 standard
deviations above what the argument needs.

Candidates that share a rare block are not paired all with all.  Each block first pairs its members with two pivots;
pairs are verified on the exact sets, and links become components.  Pairs are compared further only across what are
then still different components, and only if their bit sketches (2048 parities) are near enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import keycount
from .components import components

U64 = C.U64
SMALL = 64  # sets below this size: each member is a block


class Sets:
    """Distinct n-gram hashes of each document, sorted, one after the other."""

    def __init__(self, values: np.ndarray, first: np.ndarray):
        self.values, self.first = values, first

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for a, b in zip(first[:-1], first[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    starts = first[:-1]
    keep[starts[starts < len(h)]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], sums[first]


def shingle_sets(column: pa.Array, n: int = 5) -> Sets:
    """Sets of n-word shingles; fewer words are one shingle, none an empty set."""
    data, offsets = C.text_buffers(column)
    values, sizes = [], []
    for a, b in C.doc_runs(offsets):
        words = C.words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], C.WORD_SPACE, lower=True)
        h, first = C.window_hashes(words, n)
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < n))
        h, first = _distinct(h, first)
        size = np.diff(first)
        if len(short):
            own = []
            for i in short:
                w = words.hashes[words.first[i] : words.first[i + 1]]
                own.append(C.mix((w * np.array(C.ORDER[: len(w)], U64)).sum(dtype=U64, keepdims=True) ^ U64(len(w)))[0])
            h = np.insert(h, first[short], own)
            size[short] = 1
        values.append(h)
        sizes.append(size)
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    return Sets(np.concatenate(values) if values else np.empty(0, U64), np.concatenate([[0], np.cumsum(size)]))


class Bounds:
    """What the threshold num/den of Jaccard similarity implies for sizes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def largest(self, n: np.ndarray) -> np.ndarray:
        """The largest partner of a set of n members."""
        return n * self.den // self.num

    def apart(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The most members that only one of two linked sets has."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)


def band(n: np.ndarray) -> np.ndarray:
    return np.where(n < SMALL, 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64))


def band_top(level: np.ndarray) -> np.ndarray:
    return np.where(level == 0, SMALL - 1, (1 << (level + 1)) - 1)


def block_bits(level: np.ndarray) -> np.ndarray:
    """log2 of a band's number of blocks."""
    return np.where(level == 0, 64, np.where(level < 8, level + 1, level))


class Sketches:
    """Block parities of some sets in the joins that they take part in: for each (set, join) a run of keys."""

    def __init__(self, sets: Sets, chosen: np.ndarray, bounds: Bounds):
        n = sets.sizes[chosen]
        own = band(n)
        below = np.where(own == 6, 0, own - 1)  # bands between are all below SMALL
        upper = (own > 0) & (n <= bounds.largest(band_top(below)))
        self.set_at = np.concatenate([chosen, chosen[upper]])
        level = np.concatenate([own, below[upper]])
        size = sets.sizes[self.set_at]
        self.apart = np.where(np.arange(len(level)) < len(chosen), bounds.apart(size, bounds.largest(size)), bounds.apart(size, np.minimum(size, band_top(level))))
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(sets.first[self.set_at] - first[:-1], size) + np.arange(first[-1])
        members = sets.values[at]
        shift = (64 - block_bits(level)).astype(U64)
        block = members >> np.repeat(shift, size)
        new = np.ones(len(members), bool)
        new[1:] = block[1:] != block[:-1]
        new[first[:-1][first[:-1] < len(new)]] = True
        starts = np.flatnonzero(new)
        self.first = np.searchsorted(starts, first)
        filled = np.diff(self.first)
        parity = np.bitwise_xor.reduceat(C.mix(members ^ U64(0xA5A5A5A55A5A5A5A)), starts) if len(starts) else np.empty(0, U64)
        self.keys = C.mix(parity + np.repeat(level, filled).astype(U64) * U64(C.BASE))

    def rare(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each run the keys that are among its apart + 1 rarest and that others hold too: (set, key)."""
        filled = np.diff(self.first)
        alone = np.concatenate([[0], np.cumsum(classes == 0)])
        open_runs = np.flatnonzero(alone[self.first[1:]] - alone[self.first[:-1]] <= self.apart)
        sets, keys = [np.empty(0, np.int64)], [np.empty(0, U64)]
        for r in open_runs:
            a, b = self.first[r], self.first[r + 1]
            take = min(int(self.apart[r]) + 1, int(filled[r]))
            k, c = self.keys[a:b], classes[a:b]
            best = np.lexsort((k, c))[:take]
            best = best[c[best] > 0]
            sets.append(np.full(len(best), self.set_at[r]))
            keys.append(k[best])
        return np.concatenate(sets), np.concatenate(keys)


def _bucket_sets(column: pa.ChunkedArray, ids: np.ndarray, shingle: int) -> tuple[Sets, np.ndarray]:
    """A bucket's sets, and for each document the first (by id) of the bucket with an equal set; itself if empty."""
    sets = shingle_sets(column, shingle)
    first_with: dict[bytes, int] = {}
    same = np.arange(len(ids))
    for i in np.argsort(ids, kind="stable"):
        if sets.first[i] < sets.first[i + 1]:
            same[i] = first_with.setdefault(sets.of(i).tobytes(), i)
    return sets, same


OUT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("same_as", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
OUT_DDL = "kind int, doc_id long, n long, same_as long, keys binary, docs binary"
DOCUMENT, MEMBERS, BLOCKS = 0, 1, 2


def _candidates(docs: DataFrame, total: int, num: int, den: int, shingle: int) -> DataFrame:
    """Rows of three kinds: each document with its set's size and the bucket's first equal one; the sets of the
    documents with rare shared blocks; and those blocks, many (key, document) a row."""
    least = C.shuffle_partitions(docs.sparkSession)
    n_buckets = int(max(total / C.BUCKET_BYTES, least))
    ranges = keycount.ranges_for(total, least)
    bounds = Bounds(num, den)
    dealt = C.bucketed(docs, n_buckets)

    def chosen_of(sets: Sets, same: np.ndarray) -> np.ndarray:
        return np.flatnonzero((same == np.arange(len(same))) & (sets.sizes > 0))

    def ask(t: pa.Table) -> pa.Table:
        sets, same = _bucket_sets(t["text"], C.ids_of(t["doc_id"]), shingle)
        keys = Sketches(sets, chosen_of(sets, same), bounds).keys
        del sets
        rows = list(keycount.request(t["bucket"][0].as_py(), keys, ranges))
        C.trim()
        return keycount.request_table(rows)

    def emit(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return OUT.empty_table()
        ids = C.ids_of(t["doc_id"])
        sets, same = _bucket_sets(t["text"], ids, shingle)
        sketches = Sketches(sets, chosen_of(sets, same), bounds)
        found = keycount.Answers(answers, sketches.keys, ranges)
        at, keys = sketches.rare(found.of(sketches.keys))
        held = np.unique(at)
        n, m = len(ids), len(held)
        C.trim()
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.full(n, DOCUMENT), np.full(m, MEMBERS), [BLOCKS]]).astype(np.int32)),
                "doc_id": pa.array(np.concatenate([ids, ids[held], [0]])),
                "n": pa.array(np.concatenate([sets.sizes, sets.sizes[held], [0]])),
                "same_as": pa.array(np.concatenate([ids[same], ids[held], [0]])),
                "keys": C.binaries([None] * n + [sets.of(i).tobytes() for i in held] + [keys.tobytes()]),
                "docs": C.binaries([None] * n + _bit_sketches(sets, held) + [ids[at].tobytes()]),
            },
            schema=OUT,
        )

    asked = dealt.groupBy("bucket").applyInArrow(ask, keycount.REQUEST)
    return dealt.groupBy("bucket").cogroup(keycount.count(asked, ranges).groupBy("bucket")).applyInArrow(emit, OUT_DDL)


def _unpack_blocks(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for k, d in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(d, np.int64))], ["key", "doc"])

    return rows.where(f"kind = {BLOCKS}").select("keys", "docs").mapInArrow(run, "key long, doc long")


def _verify(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets reach the threshold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            left, right, keep = p.column(2), p.column(3), np.zeros(len(p), bool)
            for i in range(len(p)):
                x, y = (np.frombuffer(c[i].as_buffer(), U64) for c in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([p.column(0).filter(pa.array(keep)), p.column(1).filter(pa.array(keep))], ["a", "b"])

    left = members.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("set_a"))
    right = members.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("set_b"))
    fits = f"{num} * greatest(n_a, n_b) <= {den} * least(n_a, n_b)"
    joined = pairs.join(left, "a").join(right, "b").where(fits)
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _star_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b): a block's members with two of them, the smallest and one by chance.  blocks: key, doc.

    Of a cluster of near copies, which share most blocks, nearly all get linked this way, with a number of pairs in
    proportion to the blocks' rows."""
    pivots = blocks.groupBy("key").agg(F.min("doc").alias("p"), F.min_by("doc", F.xxhash64("doc")).alias("q"), F.count("*").alias("n"))
    pivots = pivots.where("n > 1").select("key", "n", F.explode(F.array_distinct(F.array("p", "q"))).alias("a"))
    met = C.spread_join(blocks, pivots, "key", "doc", "n", blocks.count()).where("a <> doc")
    return met.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct()


def _bit_sketches(sets: Sets, chosen: np.ndarray, bits: int = 2048) -> list[bytes]:
    """Parity of the members that fall on each bit: two sketches differ in no more bits than the sets in members."""
    out = []
    for i in chosen:
        at = (C.mix(sets.of(i) ^ U64(0x3C3C3C3CC3C3C3C3)) % U64(bits)).astype(np.int64)
        out.append(np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def _across(blocks: DataFrame, members: DataFrame, num: int, den: int, small_sets: bool, chunk: int = 4096) -> DataFrame:
    """(a, b): members of one block whose components differ, whose sizes fit and whose bit sketches are no further
    apart than the threshold allows.  With small_sets the sets travel along, and only pairs that reach the threshold
    and join components that no pair before has joined leave a unit of work: fewer than it has members.

    A block's members are dealt into chunks of about ``chunk``, and each pair of chunks is one unit of work, so the
    largest block does not bound a task; only pairs that pass the sketches leave it.  A member travels once for each
    chunk of its block: only blocks that still hold several components come here, few of which have a second chunk."""
    bounds = Bounds(num, den)
    spark = blocks.sparkSession
    total = blocks.count()
    sized = blocks.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("k"), F.count("*").alias("members_here"))
    known = members.select(F.col("doc_id").alias("doc"), F.col("n"), F.col("docs").alias("sketch"), *([F.col("keys").alias("members")] if small_sets else []))
    more = ["members"] if small_sets else []
    dealt = C.spread_join(blocks, sized, "key", "doc", "members_here", total).join(known, "doc").withColumn("c", F.pmod(F.xxhash64("doc"), "k").cast("int"))
    units = dealt.select("key", "doc", "label", "n", "sketch", *more, "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    cells = max(C.shuffle_partitions(spark), int(total / 20_000) + 1)
    units = units.select(F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "key", "doc", "label", "n", "sketch", *more)
    units = units.withColumn("cell", F.pmod(F.xxhash64("key", "i", "j"), F.lit(cells)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        col = {c: t[c].to_numpy() for c in ("i", "j", "c", "key", "doc", "label", "n")}
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), U64).reshape(len(t), -1)
        sets = [np.frombuffer(x, U64) for x in t["members"].to_pylist()] if small_sets else None
        root: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def joins(a: int, b: int) -> bool:
            """Whether rows a and b reach the threshold and their components were apart."""
            x, y = find(int(col["label"][a])), find(int(col["label"][b]))
            pair = (int(col["doc"][a]), int(col["doc"][b]))
            if x == y or pair in tried:
                return False
            if len(tried) > 2_000_000:
                tried.clear()
            tried.add(pair)
            both = np.concatenate([sets[a], sets[b]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if den * common < num * (len(both) - common):
                return False
            root[max(x, y)] = min(x, y)
            return True

        order = np.lexsort((col["j"], col["i"], col["key"]))
        new = np.ones(len(order), bool)
        same = np.ones(len(order) - 1, bool)
        for c in ("key", "i", "j"):
            same &= col[c][order][1:] == col[c][order][:-1]
        new[1:] = ~same
        starts = np.flatnonzero(new)
        found, fresh = [np.empty((0, 2), np.int64)], 0
        seen: set[bytes] = set()
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            rows = order[a:b]
            members_here = np.sort(col["doc"][rows]).tobytes()
            if len(rows) < 2 or members_here in seen:  # many blocks have the same members
                continue
            seen.add(members_here)
            mixed = col["i"][rows[0]] != col["j"][rows[0]]  # two chunks: only pairs across them
            n, label, part = col["n"][rows], col["label"][rows], col["c"][rows]
            step = max(1, (1 << 18) // len(rows))  # rows of the square at a time
            for x in range(0, len(rows), step):
                here = slice(x, x + step)
                small, large = np.minimum(n[here, None], n), np.maximum(n[here, None], n)
                ok = (label[here, None] < label) & (num * large <= den * small)
                if mixed:
                    ok &= part[here, None] != part
                p, q = np.nonzero(ok)
                near = np.empty(len(p), bool)
                for y in range(0, len(p), 1 << 14):
                    u, v = p[y : y + (1 << 14)] + x, q[y : y + (1 << 14)]
                    near[y : y + (1 << 14)] = np.bitwise_count(sketch[rows[u]] ^ sketch[rows[v]]).sum(axis=1) <= bounds.apart(n[u], n[v])
                if small_sets:
                    near = np.array([bool(k) and joins(a, b) for k, a, b in zip(near, rows[p + x], rows[q], strict=True)], bool)
                pairs = np.stack([col["doc"][rows[p[near] + x]], col["doc"][rows[q[near]]]], axis=1)
                pairs.sort(axis=1)
                found.append(pairs)
                fresh += len(pairs)
                if fresh > 500_000:
                    found, fresh = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0)
        C.trim()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return units.groupBy("cell").applyInArrow(compare, "a long, b long").distinct()


def _labelled(blocks: DataFrame, labels: DataFrame, once: bool) -> DataFrame:
    """Blocks whose members are of several components still; with ``once``, of blocks with the same members only one
    (told by 128 bits of XORed hashes and their number)."""
    named = blocks.join(labels, blocks.doc == labels.node, "left").select("key", "doc", F.coalesce("label", "doc").alias("label"))
    ends = [F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")]
    if once:
        ends += [F.bit_xor(F.xxhash64("doc")).alias("h"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("i")]
    mixed = named.groupBy("key").agg(*ends).where("x <> y")
    if once:
        mixed = mixed.groupBy("n", "h", "i").agg(F.min("key").alias("key"))
    return C.spread_join(named, mixed.select("key", "n"), "key", "doc", "n", blocks.count()).drop("n")


def cluster(blocks: DataFrame, members: DataFrame, links: DataFrame, num: int, den: int, files: int, small_sets: bool = False) -> DataFrame:
    """(node, label): components of the sets (members: doc_id, n, keys, docs) that share a block (key, doc) and reach the
    threshold, together with links (a, b) that are known."""
    blocks = C.cut(blocks, files)
    pairs = C.cut(_star_pairs(blocks), files)
    links = C.cut(links.union(_verify(pairs, members, num, den)), files)
    labels = C.cut(components(links, files), files)
    rest = _across(C.cut(_labelled(blocks, labels, small_sets), files), members, num, den, small_sets)
    more = C.cut(rest if small_sets else _verify(rest.join(pairs, ["a", "b"], "left_anti"), members, num, den), files)
    return C.cut(components(links.union(more), files), files) if more.head(1) else labels


def similar_components(docs: DataFrame, num: int = 75, den: int = 100, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): two documents link when den * |A and B| >= num * |A or B|.

    Texts are lower-cased for A-Z.  Null, empty and blank texts have no shingles and link with nothing.  Rows with one
    id are one document as to components, and each row has its own size; null ids count as one document, after all
    others.  Equal texts always link.  An empty table gives no rows."""
    docs = C.pick(docs, doc_id="doc_id", text="text")
    total = C.text_bytes(docs)
    rows = C.cut(_candidates(docs, total, num, den, shingle))
    members = rows.where(f"kind = {MEMBERS}")
    documents = rows.where(f"kind = {DOCUMENT}").select("doc_id", "n", "same_as")
    links = documents.where("doc_id <> same_as").select(F.col("doc_id").alias("a"), F.col("same_as").alias("b"))
    blocks = _unpack_blocks(rows)
    labels = cluster(blocks, members, links, num, den, C.files_for(total, 8e6))
    named = documents.join(labels, documents.doc_id == labels.node, "left")
    real = lambda c: F.when(c != C.NULL_ID, c)
    return named.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("label", "doc_id")).alias("component_id"))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
