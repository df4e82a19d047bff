"""Quality rules as a short-circuit cascade.

Each rule rejects documents by one group of statistics.  On a random sample of bounded size the cost of each group and
the share each rule rejects are measured on executors; the rules then run in order of rejections per second, and a
document that one rule has rejected is not looked at by the later ones.  The order changes the cost only, never a
verdict: results hold nothing that depends on it.

Defined results: a null or empty text has no words, symbols or lines and fails ``few_words``; rows with the same id,
or null ids, are judged each by its own text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True


class Batch:
    """Some documents' bytes, with their words found at most once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: C.Words | None = None):
        self.data, self.offsets, self._words = data, offsets, words

    @property
    def words(self) -> C.Words:
        if self._words is None:
            self._words = C.words_of(self.data, self.offsets, C.WORD_SPACE, lower=False)
        return self._words

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def subset(self, keep: np.ndarray) -> Batch:
        lengths = np.diff(self.offsets)
        offsets = np.concatenate([[0], np.cumsum(lengths[keep])])
        data = self.data[np.repeat(keep, lengths)]
        if self._words is None:
            return Batch(data, offsets)
        w, counts = self._words, np.diff(self._words.first)
        shift = np.repeat(self.offsets[:-1][keep] - offsets[:-1], counts[keep])
        kept = np.repeat(keep, counts)
        words = C.Words(data, w.starts[kept] - shift, w.ends[kept] - shift, w.hashes[kept], np.concatenate([[0], np.cumsum(counts[keep])]))
        return Batch(data, offsets, words)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each document."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def length_stats(b: Batch) -> dict[str, np.ndarray]:
    inside = C.WORD_SPACE[b.data] & ((b.data & 0xC0) != 0x80)
    return {"n_words": np.diff(b.words.first), "word_chars": b.count(inside)}


def symbol_stats(b: Batch) -> dict[str, np.ndarray]:
    return {"n_symbols": b.count(SYMBOLS[b.data])}


def case_stats(b: Batch) -> dict[str, np.ndarray]:
    return {"n_upper": b.count(UPPER[b.data]), "n_letters": b.count(LETTER[b.data])}


def line_stats(b: Batch) -> dict[str, np.ndarray]:
    """Lines with a word, and those equal to an earlier line of their document."""
    n = len(b.data)
    breaks = np.flatnonzero(b.data == 10)
    lengths = np.diff(b.offsets)
    starts = np.concatenate([b.offsets[:-1][lengths > 0], breaks + 1])
    starts.sort(kind="stable")
    # a break at a document's end opens an empty line, whose start is the next document's: such lines have no word
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    if len(starts):
        ends[-1] = n
    closed = (ends > starts) & (b.data[np.maximum(ends - 1, 0)] == 10) if n else np.zeros(0, bool)
    ends = ends - closed
    filled = np.searchsorted(b.words.starts, ends) > np.searchsorted(b.words.starts, starts)
    starts, ends = starts[filled], ends[filled]
    doc = np.searchsorted(b.offsets, starts, side="right") - 1
    h = C.span_hashes(b.data, starts, ends)
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return {"n_lines": np.bincount(doc, minlength=len(b)), "n_dup_lines": np.bincount(doc[order][1:][same], minlength=len(b))}


def repeat_stats(b: Batch) -> dict[str, np.ndarray]:
    """Words in 3-word windows that their document holds twice or more."""
    h, first = C.window_hashes(b.words, 3)
    if not len(h):
        return {"n_repeat_words": np.zeros(len(b), np.int64)}
    doc = np.repeat(np.arange(len(b)), np.diff(first))
    key = C.mix(h + doc.astype(C.U64) * C.U64(C.BASE))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    at += b.words.first[doc[at]] - first[doc[at]]
    covered = np.zeros(len(b.words.starts) + 2, bool)
    for i in range(3):
        covered[at + i] = True
    sums = np.concatenate([[0], np.cumsum(covered[: len(b.words.starts)])])
    return {"n_repeat_words": sums[b.words.first[1:]] - sums[b.words.first[:-1]]}


GROUPS: dict[str, Callable[[Batch], dict[str, np.ndarray]]] = {
    "length": length_stats,
    "symbols": symbol_stats,
    "case": case_stats,
    "lines": line_stats,
    "repeats": repeat_stats,
}
COLUMNS = {"length": ["n_words", "word_chars"], "symbols": ["n_symbols"], "case": ["n_upper", "n_letters"], "lines": ["n_lines", "n_dup_lines"], "repeats": ["n_repeat_words"]}


@dataclass(frozen=True)
class Rule:
    """Rejects where test(stats) holds; ``needs`` are the groups of statistics it reads."""

    name: str
    needs: tuple[str, ...]
    test: Callable[[dict[str, np.ndarray]], np.ndarray] = field(compare=False)


BASE_RULES = (
    Rule("few_words", ("length",), lambda s: s["n_words"] < 50),
    Rule("repeats", ("length", "repeats"), lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"]),
)
METHOD_RULES = (
    Rule("symbols", ("length", "symbols"), lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("word_length", ("length",), lambda s: (s["word_chars"] > 20 * s["n_words"]) | (s["word_chars"] < 2 * s["n_words"])),
    Rule("dup_lines", ("lines",), lambda s: 2 * s["n_dup_lines"] > s["n_lines"]),
    Rule("shouting", ("case",), lambda s: 2 * s["n_upper"] > s["n_letters"]),
)
RULES = BASE_RULES + METHOD_RULES


def _fill(batch: Batch, at: np.ndarray, known: dict[str, np.ndarray], done: dict[str, np.ndarray], group: str) -> None:
    """Computes a group for the documents at which it isn't known yet."""
    todo = at & ~done[group]
    if todo.any():
        part = batch if todo.all() else batch.subset(todo)
        for name, values in GROUPS[group](part).items():
            known[name][todo] = values
        done[group] |= todo


def cascade(batch: Batch, rules: tuple[Rule, ...], wanted: tuple[str, ...] = ()) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics, and which documents no rule rejects.  Those of the ``wanted`` groups are known for every document,
    others only where a rule asked for them."""
    n = len(batch)
    known = {c: np.zeros(n, np.int64) for group in COLUMNS.values() for c in group}
    done = {g: np.zeros(n, bool) for g in GROUPS}
    alive = np.ones(n, bool)
    for rule in rules:
        if not alive.any():
            break
        for group in rule.needs:
            _fill(batch, alive, known, done, group)
        alive &= ~rule.test(known)
    for group in wanted:
        _fill(batch, np.ones(n, bool), known, done, group)
    return known, alive


def _batches(column: pa.Array) -> Iterator[Batch]:
    data, offsets = C.text_buffers(column)
    for a, b in C.doc_runs(offsets):
        yield Batch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512, parts: int = 8, seed: int = 11) -> tuple[Rule, ...]:
    """Rules by rejections per second, measured on about ``sample_rows`` documents: equal random shares of ``parts``
    partitions, themselves chosen at random.  Other partitions are not read, and a row a rule and partition comes back."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, rng = -(-sample_rows // parts), np.random.default_rng(seed)
        lots, texts = np.empty(0), pa.array([], pa.string())
        for batch in batches:  # the least of random lots: a sample without replacement of unknown many
            lots = np.concatenate([lots, rng.random(len(batch))])
            least = np.sort(np.argpartition(lots, most)[:most]) if len(lots) > most else np.arange(len(lots))
            old, new = least[least < len(texts)], least[least >= len(texts)] - len(texts)
            texts = pa.concat_arrays([texts.take(pa.array(old)), batch.column(0).take(pa.array(new))])
            lots = lots[least]
        spent, rejected = {g: 0.0 for g in GROUPS}, {r.name: 0 for r in rules}
        for batch in _batches(texts):
            stats: dict[str, np.ndarray] = {}
            for g, f in GROUPS.items():
                began = time.thread_time()
                stats |= f(batch)
                spent[g] += time.thread_time() - began
            for r in rules:
                rejected[r.name] += int(r.test(stats).sum())
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "cost": [sum(spent[g] for g in r.needs) for r in rules], "rejected": [rejected[r.name] for r in rules]})

    texts = C.pick(docs, text="text").select(F.col("text").cast("string").alias("text"))
    measured = texts.mapInArrow(measure, "rule string, cost double, rejected long").rdd
    n = measured.getNumPartitions()
    some = sorted(random.Random(seed).sample(range(n), min(parts, n)))
    rows = docs.sparkSession.sparkContext.runJob(measured, list, some) if some else []
    rate = {}
    for r in rules:
        own = [x for x in rows if x.rule == r.name]
        rate[r.name] = sum(x.rejected for x in own) / (sum(x.cost for x in own) + 1e-9)
    return tuple(sorted(rules, key=lambda r: -rate[r.name]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512, wanted: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """(doc_id, statistics of the ``wanted`` groups, kept)."""
    ordered = rule_order(docs, rules, sample_rows)
    names = [c for group in wanted for c in COLUMNS[group]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            stats: dict[str, list[np.ndarray]] = {c: [] for c in names}
            kept = []
            for batch in _batches(part.column(1)):
                known, alive = cascade(batch, ordered, wanted)
                kept.append(alive)
                for c in names:
                    stats[c].append(known[c])
            if not kept:
                continue
            C.trim()
            columns = {"doc_id": part.column(0).cast(pa.int64())} | {c: pa.array(np.concatenate(v)) for c, v in stats.items()} | {"kept": pa.array(np.concatenate(kept))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, " + "".join(f"{c} long, " for c in names) + "kept boolean"
    return C.pick(docs, doc_id="doc_id", text="text").mapInArrow(run, schema)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """The rows of docs, with all their columns, whose text the rules keep; nothing is shuffled."""
    ordered = rule_order(docs, rules, sample_rows)
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept = [cascade(batch, ordered)[1] for batch in _batches(part.column(at))]
            C.trim()
            if kept:
                yield part.filter(pa.array(np.concatenate(kept)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


#: Groups that the query reports for every document; the others stay with the cascade.
REPORTED = ("length", "symbols", "lines", "repeats")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), wanted=REPORTED)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "n_lines")
