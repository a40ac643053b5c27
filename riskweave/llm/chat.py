"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads the turns of a conversation in order and emits text segments
with a loss flag; the segments, one after the other, are the formatted
conversation.  Texts are escaped, so that no text can pass for a mark, and
:func:`lexed` takes the formatted text apart again.
"""

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_rows, partitions

ESCAPE = "\\"
SEGMENTS = "conv_id long, turn long, place long, part string, content string, loss boolean, valid boolean"
SUMMARY = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


@dataclass(frozen=True)
class Template:
    """Marks around the turns of a role, the roles that may follow a role, and the roles under the loss.

    Turns of other roles are framed by ``other``, with the role as a text of
    its own between ``role_end`` and the opening mark.  No mark holds the
    escape character.
    """

    marks: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    other: tuple[str, str] = ("<<ROLE>>", "<</ROLE>>")
    role_end: str = "<<:>>"
    # The state is the role of the turn before; None is the start.
    follows: Mapping[str | None, frozenset] = field(
        default_factory=lambda: {
            None: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    loss: frozenset = frozenset({"assistant"})

    def control(self) -> list[str]:
        """All marks, the longest first."""
        found = {m for pair in self.marks.values() for m in pair} | {*self.other, self.role_end}
        return sorted(found, key=lambda m: (-len(m), m))


def escaper(template: Template):
    marks = "|".join(map(re.escape, template.control()))
    pattern = re.compile(f"(?s){re.escape(ESCAPE)}|(?=(?:{marks})).")

    def escape(text: str) -> str:
        """Doubles the escape character and puts one behind the first character of every mark."""
        return pattern.sub(lambda m: m[0] + ESCAPE, text)

    return escape


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, turn, place, part, content, loss, valid) of ``turns`` (conv_id, turn, role, text).

    ``place`` numbers the segments of a conversation; ``part`` is open, role,
    text or close; ``valid`` is false from the first turn on whose role may not
    follow the one before.  Turns come by turn, nulls first, then by role and
    text, so repeated rows have a fixed order.  Null texts and roles are empty,
    rows without conv_id are one conversation, further columns are ignored.

    A task streams its sorted rows and holds one turn at a time: a conversation
    of any length fits, and nothing of it is gathered.
    """
    return map_rows(_ordered(turns), _formatter(template), SEGMENTS)


def summarize(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its segments as they are written.

    The digests chain all turns of a conversation, so its segments pass through
    one task, as a stream.
    """
    return map_rows(format_turns(turns, template), _reader(template), SUMMARY)


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = partitions(turns.sparkSession)
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_START = object()


def _formatter(template: Template):
    def emit(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        escape = escaper(template)
        conversation, state, valid, place = _START, None, True, 0
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in batch:
                if conv_id != conversation:
                    conversation, state, valid, place = conv_id, None, True, 0
                valid = valid and role in template.follows.get(state, ())
                state = role
                parts = []
                if role in template.marks:
                    opening, closing = template.marks[role]
                    parts.append(("open", opening, False))
                else:
                    opening, closing = template.other
                    parts.append(("open", opening, False))
                    parts.append(("role", escape(role) + template.role_end, False))
                parts.append(("text", escape(text), role in template.loss))
                parts.append(("close", closing, False))
                for part, content, loss in parts:
                    rows.append((conv_id, turn, place, part, content, loss, valid))
                    place += 1
            yield rows

    return emit


def lexed(formatted: str, template: Template = Template()) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    control = "|".join(map(re.escape, template.control()))
    opening = {pair[0]: role for role, pair in template.marks.items()}
    role, last = None, ""
    for piece in re.split(f"({control})", formatted):
        if piece in opening:
            role = opening[piece]
        elif piece == template.other[0]:
            role = None
        elif piece == template.role_end:
            role = unescape(last)
        elif piece == template.other[1] or any(piece == pair[1] for pair in template.marks.values()):
            yield role, unescape(last)
        last = piece


class _Summary:
    """Digests of one conversation, fed with its segments."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.chars, self.loss_chars, self.valid = conv_id, 0, 0, 0, True
        self.turns, self.loss, self.turn = hashlib.sha256(), hashlib.sha256(), []

    def add(self, template: Template, part: str, content: str, loss: bool, valid: bool) -> None:
        self.chars += len(content)
        self.valid = valid
        self.turn.append(content)
        if loss:
            text = unescape(content)
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        if part == "close":
            for role, text in lexed("".join(self.turn), template):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.turn = []

    def row(self) -> tuple:
        return (
            self.conv_id,
            self.n,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
            self.valid,
        )


def _reader(template: Template):
    def read(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        open_one = None
        for batch in batches:
            rows = []
            for conv_id, _, place, part, content, loss, valid in batch:
                if place == 0:
                    if open_one is not None:
                        rows.append(open_one.row())
                    open_one = _Summary(conv_id)
                open_one.add(template, part, content, loss, valid)
            yield rows
        if open_one is not None:
            yield [open_one.row()]

    return read
