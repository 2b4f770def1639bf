"""Chat formatting by incremental rendering of a template that is only a function.

A template is any function from turns to a text. Rendering the turns so far
and the turns with one more shows where the new turn's text is: what the
second output adds to the first. A template whose output for more turns
doesn't start with the output for fewer rewrites history and is refused.
Control strings inside texts are escaped, and the formatted text reads back.

Turns stream through a task in order and every prefix is rendered whole, so a
task holds one conversation and its work grows with the square of its turns.
Only a caller who knows that a template treats each turn by itself may give
`spans` a window, of which the older half is left out when it is full.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import renamed

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that mark turns in some template; none of them is left whole inside an escaped text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TO_BREAK = re.compile(r"\\|" + "|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in CONTROL))


def escape(text: str) -> str:
    """A backslash before each backslash, and one after the first sign of each control string."""
    return TO_BREAK.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marked(turns: list[Turn]) -> str:
    """The template of the query: role and text between marks; a role's line ends are escaped too."""
    return "".join(f"<|im_start|>{escape(role).replace('\n', '\\n')}\n{escape(text)}<|im_end|>\n" for role, text in turns)


MARKED = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def read_marked(span: str) -> Turn:
    """Role and text of one turn's span; raises if it isn't one turn."""
    found = MARKED.fullmatch(span)
    if not found or "<|im_start|>" in found[2] or "<|im_end|>" in found[2]:
        raise ValueError("the span isn't one turn")
    role = re.sub(r"\\(\\|n|)", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], found[1])
    return role, unescape(found[2])


class Rewritten(ValueError):
    """The template changes what it has rendered for earlier turns."""


def spans(turns: Iterator[Turn], template: Template, window: int | None = None) -> Iterator[str]:
    """What each turn adds to the output, found by rendering successive prefixes."""
    shown: list[Turn] = []
    before = template(shown)
    for turn in turns:
        if window is not None and len(shown) >= window:
            shown = shown[window // 2 :]
            before = template(shown)
        after = template([*shown, turn])
        if not after.startswith(before):
            raise Rewritten("the output for more turns doesn't start with that for fewer")
        yield after[len(before) :]
        shown.append(turn)
        before = after


def rendered(turns: DataFrame, template: Template = marked, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, place, span, start): one row per turn, where its span starts in the formatted conversation.

    Null texts and roles are empty ones. Turns are ordered by turn, null ones
    first, then by role and text; repeated turns are formatted as often as they
    come. Turns without a conv_id are one conversation.
    """
    rows = renamed(turns, conv_id=conv_id, turn=turn, role=F.coalesce(turns[role].cast("string"), F.lit("")), text=F.coalesce(turns[text].cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list[str | None] = [None]
        state = None
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for key, turn_role, turn_text in zip(ids, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or current[0] != key:
                    current[0], state = key, _Conversation(template)
                out.append(state.add((turn_role, turn_text)))
            place, span, start = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(place, pa.int64()), pa.array(span, pa.string()), pa.array(start, pa.int64())],
                ["conv_id", "turn", "place", "span", "start"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, place long, span string, start long")


class _Conversation:
    """Spans of one conversation, turn by turn."""

    def __init__(self, template: Template) -> None:
        self.waiting: list[Turn] = []
        self.spans = spans(iter(self._next, None), template)
        self.place = self.start = 0

    def _next(self) -> Turn:
        return self.waiting.pop()

    def add(self, turn: Turn) -> tuple[int, str, int]:
        self.waiting.append(turn)
        span = next(self.spans)
        row = (self.place, span, self.start)
        self.place, self.start = self.place + 1, self.start + len(span)
        return row


def digests(formatted: DataFrame, learned: str = "assistant", read: Callable[[str], Turn] = read_marked) -> DataFrame:
    """One row per conversation, read back from the spans: turns, what is learned from, and their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for conv, span in zip(batch.column("conv_id").to_pylist(), batch.column("span").to_pylist(), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append((key, *state.row()))
                    key, state = conv, _Digest()
                role, text = read(span)
                state.add(role, text, role == learned, len(span))
            if done:
                yield _digest_batch(done, batch.schema.field("conv_id").type)
            kind = batch.schema.field("conv_id").type
        if state is not None:
            yield _digest_batch([(key, *state.row())], kind)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    # formatted is dealt by conversation already; the sort is on what its tasks hold
    return formatted.sortWithinPartitions("conv_id", "place").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str, learned: bool, size: int) -> None:
        self.n, self.chars = self.n + 1, self.chars + size
        self.turns.update(f"{role}\n{text}\n".encode())
        if learned:
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
