"""Best-fit packing of token sequences, by hierarchical residual rounds.

Every document is tokenised once, whole; only one longer than a sequence is cut, into full pieces and a rest.  Pieces
are dealt into groups by a hash.  A group packs best-fit decreasing and emits the bins that are (nearly) full; the
others become items of the next round, in which groups merge, until one group is left or merging no longer makes
groups fewer.  A group is bounded in rows, however many documents there are and however badly they fit.

Tokenising splits a text at spaces and line breaks, where the tokenizer's own rules always end a token, and looks
repeated chunks up in a bounded cache; the chunks themselves go through the tokenizer.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 4096
END = 1
#: A piece as it travels inside a bin.
PIECE = np.dtype([("doc", "<i8"), ("start", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("crc", "<u4")])


class ChunkTokenizer:
    """Token ids of texts through a cache of white-space chunks.  Two generations of at most ``most`` chunks each."""

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each worker one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.young, self.old = most, {}, {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for c in chunks:
            if c not in young:
                if c in old:
                    young[c] = old[c]
                else:
                    missing.append(c)
        words = [c for c in missing if c.isalpha()]
        self._encode_each([c for c in missing if not c.isalpha()])
        for at in range(0, len(words), 64 * 64):
            groups = [words[k : k + 64] for k in range(at, min(at + 64 * 64, len(words)), 64)]
            for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                word_of = np.array(e.word_ids)
                if word_of[-1] != len(group) - 1:  # some letters are none to the tokenizer
                    self._encode_each(group)
                    continue
                bounds = (4 * np.searchsorted(word_of, np.arange(len(group) + 1))).tolist()
                raw = np.array(e.ids, "<u4").tobytes()
                for c, a, b in zip(group, bounds[:-1], bounds[1:], strict=True):
                    young[c] = raw[a:b]
        return [young[c] for c in chunks]

    def _encode_each(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.young[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and n + 1 bounds."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # the tokenizer lower-cases and splits letters from marks anyway; doing it first makes chunks repeat more.
            # Only ASCII letters: others may end in a combining mark once lower-cased or composed, which joins the next mark.
            # Its special tokens are looked for in the raw text, so a text that may hold one is left alone
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        spaced = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = spaced.values.dictionary_encode() if not isinstance(spaced.values, pa.ChunkedArray) else spaced.values.combine_chunks().dictionary_encode()
        ids = self._ids(chunks.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.cumsum(sizes) - sizes
        of = chunks.indices.to_numpy()
        size = sizes[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(firsts[of] - ends[:-1], size) + np.arange(ends[-1])
        return flat[at], ends[np.asarray(spaced.offsets)]


@functools.cache
def _encoder(path: str) -> ChunkTokenizer:
    """One for each worker process: its cache serves all of the worker's tasks."""
    return ChunkTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, crc): each document's ids and then ``end``, cut only beyond the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(C.tokenizer_path(tokenizer))
        for batch in batches:
            doc_ids = C.ids_of(batch.column(0))
            texts = batch.column(1).fill_null("")
            _, offsets = C.text_buffers(texts)
            for a, b in C.doc_runs(offsets, 4 << 20):
                ids, bounds = encoder.encode(texts.slice(a, b - a))
                out = []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        out.append((doc_ids[a + i], at, k, len(part), zlib.crc32(part)))
                rows = np.array(out, PIECE)
                yield pa.RecordBatch.from_arrays(
                    [C.id_array(rows["doc"].copy()), pa.array(rows["piece"].copy()), pa.array(rows["start"].copy()), pa.array(rows["length"].copy()), pa.array(rows["crc"].astype(np.int64))],
                    ["doc_id", "piece", "start", "length", "crc"],
                )
            C.trim()

    return C.pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, piece int, start long, length int, crc long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of places) for lengths in descending order, each item into the fullest bin that has room."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # bit r of rooms: some bin has r left
    for item, length in enumerate(lengths):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = with_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        room -= length
        if room:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins


_BINS = "turn int, slice int, number int, fill int, done boolean, members binary"


def _round(items: DataFrame, turn: int, last: bool, capacity: int, slack: int) -> DataFrame:
    """items (slice, fill, members): bins of each slice; those with at most ``slack`` tokens left are done."""

    def pack(t: pa.Table) -> pa.Table:
        fill = t["fill"].to_numpy()
        members = t["members"].to_pylist()
        order = sorted(range(len(fill)), key=lambda i: (-fill[i], members[i]))
        bins = best_fit([int(fill[i]) for i in order], capacity)
        fills = [sum(int(fill[order[i]]) for i in b) for b in bins]
        n = len(bins)
        return pa.table(
            {
                "turn": pa.array([turn] * n, pa.int32()),
                "slice": pa.array([t["slice"][0].as_py()] * n, pa.int32()),
                "number": pa.array(range(n), pa.int32()),
                "fill": pa.array(fills, pa.int32()),
                "done": pa.array([last or f >= capacity - slack for f in fills]),
                "members": C.binaries([b"".join(members[order[i]] for i in b) for b in bins]),
            }
        )

    return items.groupBy("slice").applyInArrow(pack, _BINS)


def _as_items(pieces: DataFrame) -> DataFrame:
    """Each piece as a bin of its own, with the slice it is dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(len(batch), PIECE)
            rows["doc"] = C.ids_of(batch.column(0))
            for k, name in ((1, "piece"), (2, "start"), (3, "length"), (4, "crc")):
                rows[name] = batch.column(k).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(5), batch.column(3), C.binaries([r.tobytes() for r in rows])], ["slice", "fill", "members"])

    return pieces.mapInArrow(run, "slice int, fill int, members binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 4, slice_rows: int = 5_000, fan_in: int = 16) -> DataFrame:
    """pieces (doc_id, piece, start, length, crc) with sequence_id and offset: sequences of at most ``capacity`` tokens
    without gaps.  Equal rows are packed each on its own.  No pieces: no rows."""
    pieces = C.cut(pieces)
    count = pieces.count()
    slices = max(1, -(-count // slice_rows))
    files = C.files_for(count, 100_000)
    # pieces are materialised, so a row's number is stable; it deals equal rows to different slices
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id() % 997), F.lit(slices)).cast("int"))
    items, turn, packed = _as_items(dealt), 0, None
    while True:
        last = slices == 1
        bins = C.cut(_round(items, turn, last, capacity, slack), files)
        done = bins.where("done")
        packed = done if packed is None else packed.union(done)
        if last:
            break
        left = bins.where("NOT done")
        fewer = max(-(-slices // fan_in), -(-left.count() // slice_rows))
        if fewer >= slices:  # what is left does not fit together: merging would only make groups larger
            packed = packed.union(left)
            break
        slices, turn = max(fewer, 1), turn + 1
        items = left.select(F.pmod(F.xxhash64("slice", F.expr("number div 64")), F.lit(slices)).cast("int").alias("slice"), "fill", "members")
    return _placed(packed)


def _placed(bins: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            if not blobs:
                continue
            rows = np.frombuffer(b"".join(blobs), PIECE)
            sizes = np.array([len(b) // PIECE.itemsize for b in blobs])
            ends = np.cumsum(rows["length"], dtype=np.int64)
            first = np.cumsum(sizes) - sizes
            begin = (ends - rows["length"])[first]
            yield pa.RecordBatch.from_arrays(
                [
                    C.id_array(rows["doc"].copy()),
                    pa.array(rows["piece"].copy()),
                    pa.array(rows["start"].copy()),
                    pa.array(rows["length"].astype(np.int64)),
                    pa.array(rows["crc"].astype(np.int64)),
                    pa.array(np.repeat(batch.column(0).to_numpy(), sizes)),
                    pa.array(ends - rows["length"] - np.repeat(begin, sizes)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    number = F.expr("shiftleft(cast(turn as bigint), 58) + shiftleft(cast(slice as bigint), 27) + number").alias("sequence_id")
    return bins.select(number, "members").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Every document of docs (doc_id, text) packed.  A null or empty text is the end token alone; rows with one id,
    or equal rows, are packed each on its own; other columns are ignored; an empty table gives no rows."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
