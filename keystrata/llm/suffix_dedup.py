"""Removal of every byte that a 50-byte string covers which also starts in a document with a smaller id.

A suffix array of the whole corpus holds a record for each byte.  Here only sampled suffixes are sorted, those at
anchors: the places where the 24-byte string has the least hash of the 27 that begin inside a 50-byte window.  Equal
windows have the same anchor at the same distance, so comparing windows that share an anchor's suffix loses no match,
and about one byte in 14 is an anchor.  Each window belongs to one anchor; an anchor with its windows is the suffix
from it, up to 26 bytes before it, and the range of its windows.

1.  Buckets of documents send the hashes of their anchors' 24 bytes (keycount) and learn which occur in other
    documents.  Most do not, and go no further.
2.  For the others, suffixes go to ranges of leading bytes, bounded by splitters that a bounded sample gives (where more
    ranges are wanted than it can tell apart, each is shared out by a hash of the anchor); each bucket, and each group
    of buckets, sends equal ones once, with the smallest id.  A range sorts its suffixes by multikey quicksort, eight bytes
    a level, compares neighbours, and answers with the smallest document of each window.  Splitters are 16 bytes and
    anchors 24, so suffixes that share an anchor never lie on two sides of a boundary.
3.  Buckets get the answers back, mark the windows whose smallest document is smaller than their own, and cut.

A passage that a third of all documents share is one suffix a bucket, not one a document, and no step holds more than a
bucket of a few MB, one range, or one document.  Every step can be recomputed: a bucket is always the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import keycount

U64 = C.U64
WINDOW = 50  # bytes that count as a repeat
ANCHOR = 24  # bytes of an anchor
CHOICES = WINDOW - ANCHOR + 1  # places for the anchor in a window
LEFT = CHOICES - 1  # most bytes of a window before its anchor
ROW = 80  # bytes of a suffix record: WINDOW from the anchor, LEFT before it, two counts, filling
LONGEST = 1 << 22  # a longer document is looked at in pieces that overlap


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, first byte, offsets) of runs of documents; a very long one in pieces that share 49 bytes."""
    for a, b in C.doc_runs(offsets):
        if b - a == 1 and offsets[b] - offsets[a] > LONGEST:
            for at in range(int(offsets[a]), int(offsets[b]) - WINDOW + 1, LONGEST):
                yield a, at, np.array([0, min(LONGEST + WINDOW - 1, int(offsets[b]) - at)])
        else:
            yield a, int(offsets[a]), offsets[a : b + 1] - offsets[a]


class Anchors:
    """Anchors of a run of documents: document, place, first and last window, and the hash of the anchor's bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        n = len(data)
        self.doc = self.at = self.low = self.high = np.empty(0, np.int64)
        self.hash = np.empty(0, U64)
        if n < WINDOW or lengths.max() < WINDOW:
            return
        up, down = C.powers(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1]
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        h *= U64(0x94D049BB133111EB)
        place = U64((1 << 24) - 1)
        least = (h & ~place) | np.arange(len(h), dtype=U64)
        width = 1
        while 2 * width <= CHOICES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (CHOICES - width)], least[CHOICES - width :])
        chosen = (least & place).astype(np.int32)  # of the window that begins here
        valid = np.zeros(n + 1, np.int8)
        long = lengths >= WINDOW
        np.add.at(valid, offsets[:-1][long], 1)
        np.add.at(valid, offsets[1:][long] - WINDOW + 1, -1)
        windows = np.flatnonzero(np.cumsum(valid[: len(chosen)], dtype=np.int8))
        chosen = chosen[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
        starts = np.flatnonzero(new)
        self.at = chosen[starts].astype(np.int64)
        self.low = windows[starts]
        self.high = windows[np.append(starts[1:], len(windows)) - 1]
        self.doc = np.searchsorted(offsets, self.low, side="right") - 1
        self.hash = C.mix(h[self.at])

    def rows(self, data: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Records of some anchors, each ROW bytes: what sorts first are the bytes from the anchor on."""
        at, low, high = self.at[keep], self.low[keep], self.high[keep]
        out = np.zeros((len(at), ROW), np.uint8)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(WINDOW, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WINDOW)[at]
        i = np.arange(LEFT + WINDOW)
        view = np.where((i >= (low - at)[:, None] + LEFT) & (i < (high - at)[:, None] + LEFT + WINDOW), view, 0)
        out[:, :WINDOW] = view[:, LEFT:]
        out[:, WINDOW : WINDOW + LEFT] = view[:, :LEFT]
        out[:, WINDOW + LEFT] = at - low
        out[:, WINDOW + LEFT + 1] = at - high
        return out


def multikey(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of byte rows, and the places in it where a row differs from the one before.

    Multikey quicksort, eight bytes a level: a level partitions only the rows that are still equal to others, and runs
    of rows found equal as a whole are finished."""
    n = len(rows)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.ascontiguousarray(rows).view(">u8").astype(U64)
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    finished = np.zeros(n, bool)
    for level in range(1, words.shape[1]):
        run = np.cumsum(new) - 1
        sizes = np.bincount(run)
        open_rows = np.flatnonzero((sizes[run] > 1) & ~finished)
        if not len(open_rows):
            break
        if level in (1, 3, 5):
            differs = np.zeros(n, bool)
            later = open_rows[~new[open_rows]]
            differs[later] = (words[order[later]] != words[order[later - 1]]).any(axis=1)
            mixed = np.bincount(run[later], weights=differs[later], minlength=len(sizes)) > 0
            finished[open_rows] = ~mixed[run[open_rows]]
            open_rows = open_rows[mixed[run[open_rows]]]
            if not len(open_rows):
                break
        rows_here, group = order[open_rows], run[open_rows]
        value = words[rows_here, level]
        by = np.lexsort((value, group))
        order[open_rows] = rows_here[by]
        value = value[by]
        step = np.ones(len(by), bool)
        step[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        new[open_rows] = step
    return order, np.flatnonzero(new)


def least_documents(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of each record, in order, the smallest document with that window."""
    order, starts = multikey(rows)
    unique = rows[order[starts]]
    least = np.minimum.reduceat(docs[order], starts)
    member = np.empty(len(rows), np.int64)
    member[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    counts = unique[:, WINDOW + LEFT].astype(np.int64) - unique[:, WINDOW + LEFT + 1] + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    answer = np.repeat(least, counts)
    # neighbours that share the anchor but not the rest: their windows are compared one by one
    anchor = np.ascontiguousarray(unique[:, :ANCHOR]).view(U64)
    same = np.zeros(len(unique) + 1, bool)
    same[1:-1] = (anchor[1:] == anchor[:-1]).all(axis=1)
    shared = np.flatnonzero(same[1:] | same[:-1])
    group = np.cumsum(~same[:-1])
    for part in np.array_split(shared, np.flatnonzero(np.diff(group[shared]) > 0)[_every(group[shared], counts[shared])] + 1) if len(shared) else []:
        c = counts[part]
        which = np.repeat(part, c)
        back = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)  # 0 for the first window, which reaches furthest left
        left = unique[which, WINDOW + LEFT].astype(np.int64) - back
        text = np.concatenate([unique[part][:, WINDOW : WINDOW + LEFT], unique[part][:, :WINDOW]], axis=1)
        views = np.lib.stride_tricks.sliding_window_view(text, WINDOW, axis=1)
        keys = np.zeros((len(which), 64), np.uint8)
        keys[:, :8] = (group[which].astype(U64) << U64(8) | left.astype(U64)).astype(">u8").view(np.uint8).reshape(-1, 8)
        keys[:, 8 : 8 + WINDOW] = views[np.repeat(np.arange(len(part)), c), LEFT - left]
        o, s = multikey(keys)
        smallest = np.minimum.reduceat(least[which][o], s)
        place = first[which] + back
        answer[place[o]] = np.repeat(smallest, np.diff(np.append(s, len(o))))
    own = counts[member]
    at = np.repeat(first[member] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return answer[at]


def _every(group: np.ndarray, counts: np.ndarray, size: int = 200_000) -> np.ndarray:
    """Which group boundaries to split at, so that parts have about ``size`` windows and groups stay whole."""
    ends = np.cumsum(counts)[np.flatnonzero(np.diff(group) > 0)]
    return np.flatnonzero(np.diff(ends // size, prepend=0) > 0)


ANSWER = "bucket int, kind int, part int, classes binary"
SUFFIXES = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("rows", pa.binary()), ("docs", pa.binary())])
SUFFIXES_DDL = "bucket int, part int, rows binary, docs binary"


class Bucket:
    """A bucket's documents and anchors."""

    def __init__(self, t: pa.Table):
        self.ids = C.ids_of(t["doc_id"])
        self.data, self.offsets = C.text_buffers(t["text"])
        self.runs = []
        for doc, at, offsets in pieces(self.offsets):
            data = self.data[at : at + offsets[-1]]
            self.runs.append((doc, at, data, Anchors(data, offsets)))

    def keys(self) -> np.ndarray:
        """Hashes of anchors, once a document."""
        doc = np.concatenate([a.doc + d for d, _, _, a in self.runs] or [np.empty(0, np.int64)])
        h = np.concatenate([a.hash for *_, a in self.runs] or [np.empty(0, U64)])
        first = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        for a, b in zip(first[:-1], first[1:], strict=True):
            h[a:b].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[keep]

    def suffixes(self, answers: pa.Table, ranges: keycount.Ranges) -> tuple[np.ndarray, ...]:
        """Records of anchors that others have too; document, first window (a byte of the bucket), windows."""
        found = keycount.Answers(answers, np.concatenate([a.hash for *_, a in self.runs] or [np.empty(0, U64)]), ranges)
        rows, ids, low, count = [np.empty((0, ROW), np.uint8)], [], [], []
        for doc, at, data, a in self.runs:
            keep = found.of(a.hash) > 0
            rows.append(a.rows(data, keep))
            ids.append(self.ids[a.doc[keep] + doc])
            low.append(a.low[keep] + at)
            count.append((a.high - a.low)[keep] + 1)
        none = np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(ids or [none]), np.concatenate(low or [none]), np.concatenate(count or [none])


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _windows(rows: np.ndarray) -> np.ndarray:
    """How many windows each suffix record stands for."""
    return rows[:, WINDOW + LEFT].astype(np.int64) - rows[:, WINDOW + LEFT + 1] + 1


def _records(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    rows = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, ROW) for x in t["rows"].to_pylist()]
    return rows, np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for x in t["docs"].to_pylist()])


def _answers(t: pa.Table, counts: list[int], least: np.ndarray) -> pa.Table:
    """least, cut into the answers to each row of t."""
    ends = np.cumsum(counts)
    C.trim()
    return pa.table({"bucket": t["bucket"], "kind": pa.array([1] * len(t), pa.int32()), "part": t["part"], "classes": C.binaries([_pack(least[e - n : e]) for n, e in zip(counts, ends, strict=True)])})


def _answer(t: pa.Table) -> pa.Table:
    rows, docs = _records(t)
    return _answers(t, [int(_windows(r).sum()) for r in rows], least_documents(np.concatenate(rows), docs))


def _answered(sent: DataFrame, n_buckets: int, fan: int | None = None) -> DataFrame:
    """The smallest document of each window of each record sent.

    With more than ``fan`` buckets, records meet in groups of so many first, and each group sends equal ones on once: a
    passage that all documents share is one record a group in its range, not one a bucket."""
    fan = fan or keycount.FAN
    if n_buckets <= fan:
        return sent.groupBy("part").applyInArrow(_answer, ANSWER)

    def distinct(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, docs = _records(t)
        every = np.concatenate(rows)
        order, starts = multikey(every)
        member = np.empty(len(every), np.int64)
        member[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(every))))
        return rows, every, every[order[starts]], member, np.minimum.reduceat(docs[order], starts)

    def gather(t: pa.Table) -> pa.Table:
        _, _, unique, _, smallest = distinct(t)
        return pa.table({"bucket": t["cell"][:1], "part": t["part"][:1], "rows": C.binaries([_pack(unique)]), "docs": C.binaries([_pack(smallest)])}, schema=SUFFIXES)

    def back(t: pa.Table, answers: pa.Table) -> pa.Table:
        rows, every, unique, member, _ = distinct(t)
        least = np.frombuffer(zstandard.decompress(answers["classes"][0].as_py()), np.int64)
        counts = _windows(unique)
        own, first = _windows(every), (np.cumsum(counts) - counts)[member]
        at = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())
        return _answers(t, [int(_windows(r).sum()) for r in rows], least[at])

    cells = sent.withColumn("cell", F.expr(f"bucket div {fan}").cast("int"))
    answered = cells.groupBy("cell", "part").applyInArrow(gather, SUFFIXES_DDL).groupBy("part").applyInArrow(_answer, ANSWER)
    answered = answered.select(F.col("bucket").alias("cell"), "part", "classes")
    return cells.groupBy("cell", "part").cogroup(answered.groupBy("cell", "part")).applyInArrow(back, ANSWER)


def _splitters(docs: DataFrame, total: int, parts: int, sample_bytes: int = 32_000_000) -> np.ndarray:
    """At most parts - 1 strings of 16 bytes that divide the anchors of a bounded sample of documents evenly."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(0))
            for _, at, own in pieces(offsets):
                run = data[at : at + own[-1]]
                a = Anchors(run, own)
                some = a.at[a.hash % U64(64) == 0]
                yield pa.RecordBatch.from_arrays([pa.array([run[p : p + 16].tobytes() for p in some], pa.binary())], ["lead"])

    share = min(1.0, sample_bytes / max(total, 1))
    leads = sorted(bytes(r.lead) for r in docs.select("text").sample(share, seed=1).mapInArrow(lead, "lead binary").collect())
    cuts = [leads[len(leads) * k // parts] for k in range(1, parts)] if leads else []
    return np.array(sorted(set(cuts)), dtype="S16")


def _deduplicated(plain: DataFrame, finish, out) -> DataFrame:
    """plain (doc_id, text, and what else ``finish`` needs): finish(rows of a bucket, Bucket, removed flags of its
    bytes) for every bucket; ``out`` is the schema of what it returns."""
    total = C.text_bytes(plain)
    least = C.shuffle_partitions(plain.sparkSession)
    n_buckets = int(max(total / C.BUCKET_BYTES, least))
    ranges = keycount.ranges_for(total, least)
    cuts = _splitters(plain, total, n_buckets)
    dealt = C.bucketed(plain, n_buckets)
    shares = -(-n_buckets // (len(cuts) + 1))  # of a range, by the anchor: the bounded sample splits only so finely

    def ask(t: pa.Table) -> pa.Table:
        rows = list(keycount.request(t["bucket"][0].as_py(), Bucket(t).keys(), ranges))
        C.trim()
        return keycount.request_table(rows)

    def sorted_suffixes(t: pa.Table, answers: pa.Table):
        """The bucket's distinct suffixes in the order of their parts, and of which of them each record is one."""
        bucket = Bucket(t)
        rows, ids, low, count = bucket.suffixes(answers, ranges)
        order, starts = multikey(rows)
        unique = rows[order[starts]]
        part = np.searchsorted(cuts, np.ascontiguousarray(unique[:, :16]).view("S16").ravel(), side="right").astype(np.int64)
        if shares > 1:
            anchor = np.ascontiguousarray(unique[:, :ANCHOR]).view(U64).reshape(-1, ANCHOR // 8)
            part = part * shares + (C.mix(anchor[:, 0] ^ C.mix(anchor[:, 1] ^ C.mix(anchor[:, 2]))) % U64(shares)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        member = np.empty(len(rows), np.int64)
        member[order] = np.repeat(rank, np.diff(np.append(starts, len(order))))
        smallest = np.minimum.reduceat(ids[order], starts)[by] if len(starts) else ids
        return bucket, ids, low, count, member, unique[by], smallest, part[by]

    def send(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return SUFFIXES.empty_table()
        *_, unique, smallest, part = sorted_suffixes(t, answers)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        spans = [slice(a, b) for a, b in zip(first, [*first[1:], len(part)], strict=True)] if len(first) else []
        C.trim()
        return pa.table(
            {
                "bucket": pa.array([t["bucket"][0].as_py()] * len(first), pa.int32()),
                "part": pa.array(part[first], pa.int32()),
                "rows": C.binaries([_pack(unique[x]) for x in spans]),
                "docs": C.binaries([_pack(smallest[x]) for x in spans]),
            },
            schema=SUFFIXES,
        )

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):  # answers come only to buckets that asked
            return finish(t, Bucket(t), np.empty(0, bool))
        kind = answers["kind"].to_numpy()
        bucket, ids, low, count, member, unique, _, _ = sorted_suffixes(t, answers.filter(pa.array(kind == 0)))
        back = answers.filter(pa.array(kind == 1))
        blobs = [b for _, b in sorted(zip(back["part"].to_pylist(), back["classes"].to_pylist(), strict=True))]
        least = np.frombuffer(b"".join(zstandard.decompress(b) for b in blobs), np.int64)
        of_unique = _windows(unique)
        if len(least) != of_unique.sum():
            raise ValueError("the bucket's suffixes differ from those that were compared")
        first = np.cumsum(of_unique) - of_unique
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = least[np.repeat(first[member], count) + inside] < np.repeat(ids, count)
        steps = np.zeros(len(bucket.data) + 1, np.int32)
        places = (np.repeat(low, count) + inside)[gone]
        steps[: len(bucket.data)] += np.bincount(places, minlength=len(bucket.data)).astype(np.int32)
        steps -= np.bincount(places + WINDOW, minlength=len(steps)).astype(np.int32)
        out_rows = finish(t, bucket, np.cumsum(steps[:-1]) > 0)
        C.trim()
        return out_rows

    classes = keycount.count(dealt.groupBy("bucket").applyInArrow(ask, keycount.REQUEST), ranges)
    sent = dealt.groupBy("bucket").cogroup(classes.groupBy("bucket")).applyInArrow(send, SUFFIXES_DDL)
    answered = _answered(sent, n_buckets)
    both = classes.select("bucket", F.lit(0).alias("kind"), "part", "classes").union(answered)
    return dealt.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(cut, out)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: starts and ends of the removed runs).

    Texts are whole UTF-8 byte strings, null being empty; those under 50 bytes lose nothing.  Only a strictly smaller
    id counts: of rows with one id none is removed because of the other.  A null id is larger than every id and not
    smaller than another null.  An empty table gives no rows."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])

    def finish(_: pa.Table, bucket: Bucket, covered: np.ndarray) -> pa.Table:
        rows = {f.name: [] for f in out}
        for i, (a, b) in enumerate(zip(bucket.offsets[:-1], bucket.offsets[1:], strict=True)) if len(bucket.ids) else ():
            here = covered[a:b]
            kept = bucket.data[a:b][~here].tobytes()
            edges = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0)) if here.any() else np.empty(0, np.int64)
            rows["doc_id"].append(int(bucket.ids[i]) if bucket.ids[i] != C.NULL_ID else None)
            rows["n_bytes"].append(int(b - a))
            rows["n_removed"].append(int(b - a) - len(kept))
            rows["n_spans"].append(len(edges) // 2)
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["spans"].append(edges.tolist())
        return pa.table(rows, schema=out)

    return _deduplicated(C.pick(docs, doc_id="doc_id", text="text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, with texts cut: what ``repeated_spans`` removes is gone, together with what a cut left of a
    character.  A null text stays null; a document that loses all its words goes; n_chars, if there, is counted anew
    for texts that changed."""
    names, places = docs.columns, [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*places)
    at = {c: f"_{names.index(c)}" for c in ("doc_id", "text")}
    chars = f"_{names.index('n_chars')}" if "n_chars" in names else None
    carried = plain.withColumn("doc_id", F.col(at["doc_id"]).cast("long")).withColumnRenamed(at["text"], "text")

    def finish(t: pa.Table, bucket: Bucket, covered: np.ndarray) -> pa.Table:
        texts, keep = t["text"].to_pylist(), np.ones(len(t), bool)
        old = t[chars].to_pylist() if chars else None
        for i, (a, b) in enumerate(zip(bucket.offsets[:-1], bucket.offsets[1:], strict=True)) if len(t) else ():
            if covered[a:b].any():
                texts[i] = _whole_characters(bucket.data[a:b], covered[a:b])
                keep[i] = C.WORD_SPACE[np.frombuffer(texts[i].encode(), np.uint8)].any()
                if old:
                    old[i] = len(texts[i])
        columns = {c: pa.array(texts, pa.string()) if c == at["text"] else pa.array(old, t[c].type) if c == chars else t[c] for c in places}
        return pa.table(columns).filter(pa.array(keep))

    return _deduplicated(carried, finish, plain.schema).toDF(*names)


def _whole_characters(data: np.ndarray, removed: np.ndarray) -> str:
    """What is left as text: a character of which a byte was removed goes as a whole."""
    if not removed.any():
        return data.tobytes().decode("utf-8")
    begins = (data & 0xC0) != 0x80
    character = np.cumsum(begins) - 1
    touched = np.zeros(int(character[-1]) + 1, bool)
    touched[character[removed]] = True
    return data[~touched[character]].tobytes().decode("utf-8")


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
