"""Chat formatting in budgeted windows with a loss mask, and reading back what was formatted.

Turns of a conversation come in order with prefix sums of their tokens. A window's new turns are the
longest span whose sum, a difference of two prefix sums, fits the budget beside the window's
context; windows end between turns. The context is the conversation's first system turn, then as
many recent turns as a limit allows. The loss mask covers the texts of new assistant turns, so each
is a target once; repeated turns are context.

No window is above the budget, but for a turn that is larger by itself: it's a window of its own. A
system turn is repeated where it leaves half of the budget free; a larger one stands whole in the
window where it's new, and isn't repeated. Where the next turn doesn't fit beside the repeated
turns, the recent ones go first, then the system turn. A turn's tokens are those of its formatted
text; ``tokens`` counts them.

A turn is ``<s>[ROLE]role[/ROLE]text</s>``. Control strings inside roles and texts get a backslash
after their first character and backslashes are doubled, which reading undoes.

Rows are dealt by conversation and sorted within their partition; a task holds one window and the
history that the next may repeat, never a conversation. Null roles and texts are empty, null turns
come first, null conversation ids are one conversation; turns with equal numbers are ordered by
role and text, and repeated rows are turns of their own. Very long texts are turns as any others. An
empty table gives no window. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.sentencepiece_bpe import read_model

BUDGET, HISTORY, TARGET = 1024, 128, "assistant"
# Control strings of the template.
CONTROL = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def shown(role: str, text: str) -> str:
    """A turn as it's formatted."""
    return f"<s>[ROLE]{escape(role)}[/ROLE]{escape(text)}</s>"


def count_words(text: str) -> int:
    """Tokens where no tokenizer is given: parts between white space."""
    return len(text.split())


@cache
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class ModelTokens:
    """Tokens of a text by a SentencePiece model, without begin and end; travels with the task. Only
    their number is asked for, which the library gives without a memory that has to be filled."""

    def __init__(self, path: str):
        self.model = read_model(path)

    def __call__(self, text: str) -> int:
        return len(_processor(self.model).encode(text))


def render(turns: list[tuple[str, str]], new_from: int) -> tuple[str, list[int], list[int]]:
    """Formatted text, and starts and ends of the loss mask in it."""
    parts, at, starts, ends = [], 0, [], []
    for i, (role, text) in enumerate(turns):
        head, body = f"<s>[ROLE]{escape(role)}[/ROLE]", escape(text)
        if i >= new_from and role == TARGET:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class _Windows:
    """One conversation's open window. A turn is held as (role, text, prefix sum before it, after it)."""

    def __init__(self, conv_id, budget: int, history: int, tokens: Callable[[str], int]):
        self.conv_id, self.budget, self.history, self.tokens = conv_id, budget, history, tokens
        self.system: tuple[str, str, int, int] | None = None
        self.recent: deque[tuple[str, str, int, int]] = deque()
        self.context: list[tuple[str, str, int, int]] = []
        self.new: list[tuple[str, str, int, int]] = []
        self.sum = self.number = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, self.sum, self.sum + self.tokens(shown(role, text)))
        self.sum = turn[3]
        if self.new and _size(self.context) + turn[3] - self.new[0][2] > self.budget:
            yield self.close()
        if not self.new:
            recent = self.context[1:] if self.system in self.context else self.context
            for context in (self.context, self.context[: len(self.context) - len(recent)], []):
                if _size(context) + turn[3] - turn[2] <= self.budget or not context:
                    self.context = context
                    break
        self.new.append(turn)
        if role == "system" and self.system is None:
            self.system = turn
        else:
            self.recent.append(turn)
            while self.recent and self.sum - self.recent[0][2] > self.history:
                self.recent.popleft()

    def close(self) -> tuple:
        formatted, starts, ends = render([t[:2] for t in self.context + self.new], len(self.context))
        row = (self.conv_id, self.number, len(self.context), len(self.new), _size(self.context) + _size(self.new), formatted, starts, ends)
        keep = self.system and 2 * (self.system[3] - self.system[2]) <= self.budget
        self.context = ([self.system] if keep else []) + list(self.recent)
        self.new, self.number = [], self.number + 1
        return row


def _size(turns: list[tuple[str, str, int, int]]) -> int:
    return sum(t[3] - t[2] for t in turns)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)


def format_windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_words) -> DataFrame:
    """``(conv_id, window, n_repeated, n_new, n_tokens, formatted, loss_starts, loss_ends)`` from
    ``(conv_id, turn, role, text)``; windows of a conversation follow each other in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows, held = None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if open_ is None or open_.conv_id != conv:
                    if open_ is not None:
                        rows.append(open_.close())
                    open_ = _Windows(conv, budget, history, tokens)
                for row in open_.add(role or "", text or ""):
                    rows.append(row)
                    held += len(row[5])
                if held > 4_000_000 or len(rows) >= 1000:
                    if rows:
                        yield _batch(rows, _SCHEMA)
                    rows, held = [], 0
        if open_ is not None:
            rows.append(open_.close())
        if rows:
            yield _batch(rows, _SCHEMA)

    dealt = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id bigint, window bigint, n_repeated int, n_new int, n_tokens bigint, formatted string, loss_starts array<int>, loss_ends array<int>")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of the turns and targets that the formatted windows hold, one row a conversation.
    Hashes are fed window by window as the partition streams by.

    ``in_order`` says that windows come straight from ``format_windows``; others are dealt and sorted
    first. A window out of its place is an error in either case.
    """
    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []

        def row() -> tuple:
            conv, n, turns, chars, loss, total, count = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, count

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "window", "n_repeated", "formatted", "loss_starts", "loss_ends")]
            for conv, window, repeated, formatted, starts, ends in zip(*columns, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if window != state[6]:
                    raise ValueError(f"window {window} of conversation {conv} came after {state[6]} windows")
                for role, text in parse(formatted)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    target = unescape(formatted[a:b])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(formatted)
                state[6] += 1
            if len(rows) >= 1000:
                yield _batch(rows, _READ)
                rows = []
        if state is not None:
            rows.append(row())
        if rows:
            yield _batch(rows, _READ)

    return windows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
