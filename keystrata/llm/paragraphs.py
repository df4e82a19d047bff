"""Repeated paragraphs across documents by MinHash bands.

A paragraph begins at each line that holds a word and goes on to the end of the line with which it has 30 words; what
is shorter at a document's end counts from 20 words.  So a passage of several short lines is found from its own first
line, whatever stands before it.  Paragraphs overlap; each is compared by its set of 5-word shingles.

Eight bands of two MinHash values collide for a pair of Jaccard similarity 0.75 with probability 0.9987 (0.9997 at
0.8); ``bands`` computes how many are needed for a recall.  Band values are counted first (keycount): paragraphs of
which no value occurs in another document go no further.  Equal paragraphs are one node.  Nodes that collide are
verified on their exact sets, by pivots first and then across what are still different components, so no bucket is
paired all with all; the components are the clusters, and every paragraph of a cluster but the first (by document and
place) is removed.

Inside lines a window of 30 words also opens at content-chosen words: of every passage of 50 words the first one with
the least shingle hash among those where 30 words still fit.  Equal passages choose equal words, so any 50 words that
two documents share hold a window of both, whatever stands around them.  These windows are compared as wholes: there is
one for about eleven words, and no room for bands of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import keycount
from .jaccard_join import BLOCKS, DOCUMENT, MEMBERS, Sets, _bit_sketches, _unpack_blocks, cluster

U64 = C.U64
ROWS_A_BAND = 2
#: Low bits that hold a place; the high ones hold a hash.
PLACE_BITS = U64(0xFFFFFFFF)


def bands(similarity: float, recall: float, rows: int = ROWS_A_BAND) -> int:
    """Fewest bands of ``rows`` values that find a pair of that similarity with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def chosen(h: np.ndarray, first: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """For each document's first ``counts`` places, the place of the least hash among ``width`` from there on (of equal
    ones the first); each place once."""
    at = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(at):
        return at
    low, span = (h & ~PLACE_BITS) | np.arange(len(h), dtype=U64), 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return np.unique((low[at] & PLACE_BITS).astype(np.int64))


class Paragraphs:
    """Paragraphs of a run of documents: document, line, bytes, words, first shingle and number of shingles.  Only the
    first ones, which begin with a line, have bands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n_bands: int, enough: int, least: int, shingle: int, passage: int = 0, short: bool = False):
        words = C.words_of(data, offsets, C.WORD_SPACE, lower=True)
        self.h, first = C.window_hashes(words, shingle)
        breaks = np.sort(np.concatenate([np.flatnonzero(data == 10), offsets[1:-1] - 1]))
        line = np.searchsorted(breaks, words.starts, side="left")
        doc_of = words.doc_of()
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (doc_of[1:] != doc_of[:-1])
        begin = np.flatnonzero(new)  # first word of each line that has one
        end = np.append(begin[1:], len(line)) if len(begin) else begin
        doc = doc_of[begin]
        last = np.minimum(np.searchsorted(end, begin + enough), len(end) - 1)
        stop = np.minimum(end[last], words.first[doc + 1]) if len(begin) else begin
        keep = stop - begin >= np.where(stop == words.first[doc + 1], least, enough) if len(begin) else np.zeros(0, bool)
        if short and len(begin):
            keep |= (begin == words.first[doc]) & (stop == words.first[doc + 1]) & (stop - begin >= shingle)
        begin_all, begin, stop, self.doc = begin, begin[keep], stop[keep], doc[keep]
        n_lines = len(begin)
        if passage:
            at = chosen(self.h, first, np.maximum(np.diff(words.first) - (passage - 1), 0), passage - enough + 1)
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at - first[doc] + words.first[doc]
            other = ~np.isin(inside, begin[stop - begin == enough])  # a line's own window is there already
            begin, stop = np.append(begin, inside[other]), np.append(stop, inside[other] + enough)
            self.doc = np.append(self.doc, doc[other])
        n_long = len(begin)
        if short:  # too short for a shingle: the words in order
            few = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < shingle))
            begin, stop = np.append(begin, words.first[few]), np.append(stop, words.first[few + 1])
            self.doc = np.append(self.doc, few)
        before = np.searchsorted(begin_all, begin, side="right") - 1  # lines with words before it in the run
        self.line = before - np.searchsorted(begin_all, words.first[self.doc])
        self.start = words.starts[begin] - offsets[self.doc]
        self.n_bytes = words.ends[stop - 1] - words.starts[begin]
        self.n_words = stop - begin
        self.low = begin - words.first[self.doc] + first[self.doc]
        self.high = np.maximum(self.low + self.n_words - (shingle - 1), self.low)
        sums = np.zeros(len(self.h) + 1, U64)
        np.cumsum(self.h, out=sums[1:])
        self.node = C.mix(sums[self.high] - sums[self.low] + self.n_words.astype(U64) * U64(C.BASE)).view(np.int64)
        value = np.zeros(len(begin) - n_long, U64)
        for k in range(shingle - 1):
            here = np.flatnonzero(self.n_words[n_long:] > k)
            value[here] = C.mix(value[here] * U64(C.BASE) + words.hashes[begin[n_long:][here] + k])
        self.node[n_long:] = value.view(np.int64)
        self.bands = np.empty((n_lines, n_bands), U64)
        if n_lines:
            padded = np.append(self.h, U64(0))
            pairs = np.stack([self.low[:n_lines], self.high[:n_lines]], axis=1).ravel()
            for b in range(n_bands):
                value = np.full(n_lines, U64(b + 1))
                for r in range(ROWS_A_BAND):
                    salt = C.mix(np.array([b * ROWS_A_BAND + r + 1], U64))[0]
                    x = (padded ^ salt) * U64(C.ORDER[r] | 1)
                    x ^= x >> U64(29)
                    value = C.mix(value * U64(C.BASE) + np.minimum.reduceat(x * U64(C.ORDER[2]), pairs)[::2])
                self.bands[:, b] = value

    def shingles(self, i: int) -> np.ndarray:
        return np.unique(self.h[self.low[i] : self.high[i]])


OCCURRENCES = DOCUMENT
OUT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
OUT_DDL = "kind int, doc_id long, n long, keys binary, docs binary"
PLACE = np.dtype([("node", "<i8"), ("doc", "<i8"), ("line", "<i8"), ("start", "<i8"), ("n_bytes", "<i8"), ("n_words", "<i8")])


def _candidates(docs: DataFrame, total: int, n_bands: int, enough: int, least_words: int, shingle: int, passage: int, short: bool) -> DataFrame:
    least = C.shuffle_partitions(docs.sparkSession)
    n_buckets = int(max(total / C.BUCKET_BYTES, least))
    ranges = keycount.ranges_for(total, least)
    dealt = C.bucketed(docs, n_buckets)

    def runs(t: pa.Table) -> tuple[np.ndarray, list[tuple[int, Paragraphs]]]:
        data, offsets = C.text_buffers(t["text"])
        return C.ids_of(t["doc_id"]), [(a, Paragraphs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_bands, enough, least_words, shingle, passage, short)) for a, b in C.doc_runs(offsets)]

    def keys_of(p: Paragraphs) -> np.ndarray:
        return np.concatenate([p.node.view(U64), p.bands.ravel()])

    def ask(t: pa.Table) -> pa.Table:
        _, found = runs(t)
        keys = []
        for _, p in found:
            k = keys_of(p)
            doc = np.concatenate([p.doc, np.repeat(p.doc[: len(p.bands)], n_bands)]).astype(U64)
            order = np.lexsort((k, doc))
            once = np.ones(len(k), bool)
            once[1:] = (k[order][1:] != k[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            keys.append(k[order][once])
        rows = list(keycount.request(t["bucket"][0].as_py(), np.concatenate(keys or [np.empty(0, U64)]), ranges))
        C.trim()
        return keycount.request_table(rows)

    def emit(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return OUT.empty_table()
        ids, found = runs(t)
        answered = keycount.Answers(answers, np.concatenate([keys_of(p) for _, p in found] or [np.empty(0, U64)]), ranges)
        places, nodes, sizes, sets, sketches, block_keys, block_nodes, seen = [], [], [], [], [], [], [], set()
        for a, p in found:
            known = answered.of(keys_of(p)) > 0
            shared = known[len(p.node) :].reshape(p.bands.shape)
            any_shared = known[: len(p.node)].copy()
            any_shared[: len(shared)] |= shared.any(axis=1)
            at = np.flatnonzero(any_shared)
            rows = np.empty(len(at), PLACE)
            rows["node"], rows["doc"] = p.node[at], ids[p.doc[at] + a]
            for name in ("line", "start", "n_bytes", "n_words"):
                rows[name] = getattr(p, name)[at]
            places.append(rows)
            for i in at[at < len(shared)]:
                node = int(p.node[i])
                if node in seen:
                    continue
                seen.add(node)
                s = p.shingles(i)
                nodes.append(node)
                sizes.append(len(s))
                sets.append(s)
                keep = shared[i]
                block_keys.append(p.bands[i][keep])
                block_nodes.append(np.full(int(keep.sum()), node, np.int64))
        every = Sets(np.concatenate(sets or [np.empty(0, U64)]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64))
        sketches = _bit_sketches(every, np.arange(len(sets)), 512)
        m = len(nodes)
        C.trim()
        return pa.table(
            {
                "kind": pa.array([OCCURRENCES] + [MEMBERS] * m + [BLOCKS], pa.int32()),
                "doc_id": pa.array([0] + nodes + [0], pa.int64()),
                "n": pa.array([0] + sizes + [0], pa.int64()),
                "keys": C.binaries([np.concatenate(places or [np.empty(0, PLACE)]).tobytes()] + [s.tobytes() for s in sets] + [np.concatenate(block_keys or [np.empty(0, U64)]).tobytes()]),
                "docs": C.binaries([None] + sketches + [np.concatenate(block_nodes or [np.empty(0, np.int64)]).tobytes()]),
            },
            schema=OUT,
        )

    asked = dealt.groupBy("bucket").applyInArrow(ask, keycount.REQUEST)
    return dealt.groupBy("bucket").cogroup(keycount.count(asked, ranges).groupBy("bucket")).applyInArrow(emit, OUT_DDL)


def _places(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                p = np.frombuffer(blob, PLACE)
                yield pa.RecordBatch.from_arrays([pa.array(p[name].copy()) for name in PLACE.names], list(PLACE.names))

    return rows.where(f"kind = {OCCURRENCES}").select("keys").mapInArrow(run, "node long, doc long, line long, start long, n_bytes long, n_words long")


def repeated_paragraphs(docs: DataFrame, num: int = 75, den: int = 100, recall: float = 0.998, enough: int = 30, least_words: int = 20, shingle: int = 5, passage: int = 0, short: bool = False) -> DataFrame:
    """(doc_id, line: among its document's lines that hold words, start, n_bytes, n_words, first_doc_id, first_line,
    removed): every paragraph whose cluster reaches into two documents or more, with the cluster's first paragraph.
    With ``passage``, windows inside lines as well: every passage of so many words that two documents share holds one.

    With ``short``, a document of fewer words than ``least_words`` is one paragraph; under ``shingle`` words only equal
    ones match.

    Null and empty texts have no paragraphs, nor, without ``short``, have short ones.  Repetition inside one document alone is not reported.  A null id
    is one document, after all others; so are rows with one id.  No repetition, or an empty table: no rows."""
    docs = C.pick(docs, doc_id="doc_id", text="text")
    total = C.text_bytes(docs)
    files = C.files_for(total, 8e6)
    rows = C.cut(_candidates(docs, total, bands(num / den, recall), enough, least_words, shingle, passage, short))
    members = rows.where(f"kind = {MEMBERS}").dropDuplicates(["doc_id"])
    blocks = _unpack_blocks(rows).distinct()
    none = rows.where("false").select(F.col("doc_id").alias("a"), F.col("n").alias("b"))
    labels = cluster(blocks, members, none, num, den, files, small_sets=True)
    places = _places(rows)
    named = C.cut(places.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node"), files)
    first = named.groupBy("label").agg(F.min(F.struct("doc", "line", "start")).alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    first = first.where("first.doc <> last").select("label", "n", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"), F.col("first.start").alias("first_start"))
    out = C.spread_join(named, first, "label", "doc", "n", named.count())
    real = lambda c: F.when(F.col(c) != C.NULL_ID, F.col(c))
    removed = (F.col("doc") != F.col("first_doc")) | (F.col("line") != F.col("first_line")) | (F.col("start") != F.col("first_start"))
    return out.select(real("doc").alias("doc_id"), "line", "start", "n_bytes", "n_words", real("first_doc").alias("first_doc_id"), "first_line", removed.alias("removed"))


def op7_paragraph_minhash(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=50, short=True)
