"""Chat formatting in budgeted windows.

A conversation becomes windows of at most ``budget`` tokens, marks and escapes included; a mark and a text are encoded
each on its own.  Prefix sums of the turns' tokens choose for each window the longest run of turns that still fits; the
system turn, if the conversation starts with one, stands first in every window, and up to ``history`` turns before the
run are repeated as far as they fit in half of the budget.  Only text of assistant turns that appear for the first time
is under the loss mask; repeated turns are not.

Turns are never cut.  A turn that alone is longer than the budget has a window of its own, whole, with nothing repeated:
no other window is over the budget.  A system turn of more than half of the budget is not repeated, nor is one beside a
turn that fits only without it.

The template marks turns with control strings and escapes those inside texts reversibly: a backslash is put before any
backslash and before ``<`` and ``[``, so that ``</s>`` or ``[INST]`` inside a text cannot be taken for a mark.

Turns are read in order of (turn, role, text), nulls first, as a stream sorted inside a partition: memory holds the
system turn, the history and one window, however many turns a conversation has.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Marks of the template.
BEGIN, END_OF_TURN = "<s>", "</s>"
SYSTEM, USER, ASSISTANT, OTHER = "[SYS]", "[INST]", "[/INST]", "[ROLE]"
REPEATED = "[R]"
MARKS = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
_ESCAPED = re.compile(r"[\\<\[]")
_PLAIN = re.compile(r"\\(.)", re.S)
#: One turn: a repetition flag, its mark (for other roles with the role's name), its text, the end of turn.
_TURN = re.compile(r"(\[R\])?(?:(\[SYS\])|(\[INST\])|(\[/INST\])|\[ROLE\]((?:[^\\<\[]|\\.)*)\[/ROLE\])((?:[^\\<\[]|\\.)*)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int = 0


@dataclass
class Window:
    """One formatted window; spans are places of text under the loss mask."""

    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    tokens: int = 0


def _render(turns: list[tuple[Turn, bool]], tokens: int) -> Window:
    """turns: with whether each appears for the first time."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for turn, fresh in turns:
        head = ("" if fresh else REPEATED) + mark_of(turn.role)
        body = escape(turn.text)
        if fresh and turn.role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END_OF_TURN]
        at += len(head) + len(body) + len(END_OF_TURN)
    return Window("".join(parts), spans, tokens)


def mark_of(role: str) -> str:
    return MARKS.get(role) or OTHER + escape(role) + "[/ROLE]"


def parse(text: str) -> list[tuple[str, str, bool]]:
    """(role, text, whether it appears for the first time) of a window's turns."""
    if not text.startswith(BEGIN):
        raise ValueError("a window must begin with " + BEGIN)
    out, at = [], len(BEGIN)
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = "system" if m[2] else "user" if m[3] else "assistant" if m[4] else unescape(m[5])
        out.append((role, unescape(m[6]), not m[1]))
        at = m.end()
    return out


def windows(turns: Iterator[Turn], budget: int, history: int, begin: int = 0, again: int = 0) -> Iterator[Window]:
    """Windows over a stream of turns; ``begin`` tokens open a window, ``again`` more mark a repeated turn."""
    system: Turn | None = None
    past: list[Turn] = []  # the last turns of earlier windows
    run: list[tuple[Turn, bool]] = []
    sums = [begin]  # prefix sums of the run's tokens
    fresh, first = 0, True

    def opened(turn: Turn) -> list[tuple[Turn, bool]]:
        """What is repeated before ``turn``, which opens a window."""
        room, half, head, repeat = budget - begin - turn.tokens, budget // 2 - begin, [], []
        if system and system.tokens + again <= min(room, half):
            head = [(system, False)]
            room, half = room - system.tokens - again, half - system.tokens - again
        for t in reversed(past):
            if t.tokens + again > min(room, half):
                break
            repeat.insert(0, (t, False))
            room, half = room - t.tokens - again, half - t.tokens - again
        return head + repeat

    for turn in turns:
        if fresh and sums[-1] + turn.tokens > budget:
            yield _render(run, sums[-1])
            run, sums, fresh = opened(turn), [begin], 0
            for t, _ in run:
                sums.append(sums[-1] + t.tokens + again)
        run.append((turn, True))
        sums.append(sums[-1] + turn.tokens)
        fresh += 1
        if first and turn.role == "system":
            system = turn
        else:
            past = (past + [turn])[-history:] if history else []
        first = False
    if fresh:
        yield _render(run, sums[-1])


@functools.cache
def _counter(name: str):
    import tiktoken

    with open(C.tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    coder = tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


class Costs:
    """Tokens of turns as they are written."""

    def __init__(self, count):
        self.count = count
        self.begin, self.again, self.end = (count(x) for x in (BEGIN, REPEATED, END_OF_TURN))
        self.marks = {role: count(mark) for role, mark in MARKS.items()}

    def turn(self, role: str, text: str) -> Turn:
        mark = self.marks[role] if role in self.marks else self.count(mark_of(role))
        return Turn(role, text, mark + self.count(escape(text)) + self.end)

    def windows(self, turns: Iterator[Turn], budget: int, history: int) -> Iterator[Window]:
        return windows(turns, budget, history, self.begin, self.again)


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = C.pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streams(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """(conversation, its turns) of rows in order; each stream must be read before the next."""

    def rows():
        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                yield c, costs.turn(role, text)

    source = rows()
    held = next(source, None)
    while held is not None:
        current = held[0]

        def own(current=current):
            nonlocal held
            while held is not None and held[0] == current:
                yield held[1]
                held = next(source, None)

        yield current, own()


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 2, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(conv_id, window, text, loss_starts, loss_ends, tokens): formatted windows with the places under the loss mask.

    Null roles and texts are empty; a null conv_id is a conversation; rows alike are turns each; other roles keep their
    name; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(_counter(tokenizer))
        for conv, turns in _streams(batches, costs):
            for k, w in enumerate(costs.windows(turns, budget, history)):
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "window": k, "text": w.text, "loss_starts": [a for a, _ in w.spans], "loss_ends": [b for _, b in w.spans], "tokens": w.tokens}], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("tokens", pa.int32())])
    return _ordered(conversations).mapInArrow(run, "conv_id long, window int, text string, loss_starts array<int>, loss_ends array<int>, tokens int")


def chat_digests(conversations: DataFrame, budget: int = 1024, history: int = 2, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """For each conversation what its windows hold, read back from the formatted text and its loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, costs = {f.name: [] for f in schema}, Costs(_counter(tokenizer))
        for conv, turns in _streams(batches, costs):
            said, learnt = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = formatted = n_windows = 0
            for w in costs.windows(turns, budget, history):
                n_windows += 1
                formatted += len(w.text)
                for role, text, fresh in parse(w.text):
                    if fresh:
                        n_turns += 1
                        said.update(f"{role}\n{text}\n".encode())
                for a, b in w.spans:
                    text = unescape(w.text[a:b])
                    loss_chars += len(text)
                    learnt.update(text.encode())
            for name, value in zip(out, (conv, n_turns, said.hexdigest(), loss_chars, learnt.hexdigest(), formatted, n_windows), strict=True):
                out[name].append(value)
            if len(out["conv_id"]) == 2000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {f.name: [] for f in schema}
        yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op9_chat_windows(spark, sf_dir: str) -> DataFrame:
    """All conversations and one more, number -1, whose texts are made of the template's own marks."""
    table = C.pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="conv_id", turn="turn", role="role", text="text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat_digests(table.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").union(extra))
