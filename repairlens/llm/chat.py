"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Rows of a conversation stream through the machine in turn order (ties by role, then text).
Each turn becomes segments of text with a loss flag; the machine marks turns that its
transitions don't allow. Control strings inside a text are broken by a backslash after their
first character, and backslashes are doubled, so a text can always be told from the marks and
restored. Segments are written out, and ``read_back`` parses them with the same template.

A conversation may be of any length: both passes hold one turn at a time. Null text and null
role count as empty; rows with a null conversation id form one conversation. Rows that repeat are
turns of their own; other columns are ignored, whatever their names; an empty table has no
conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared

#: role -> (mark before, mark after, whether its text counts for the loss); other roles are named in their mark.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
OTHER = ("[ROLE ", "[/ROLE]", "[/ROLE]")
#: state (the role before, None at the start) -> roles that may follow.
TRANSITIONS = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}

_CONTROL = re.compile(r"(<)(?=s>|/s>|<SYS>>|</SYS>>)|(\[)(?=INST\]|/INST\]|ROLE |/ROLE\])")
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\")) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def segments_of(role: str, text: str) -> list[tuple[str, bool]]:
    """The segments of one turn, with loss flags; neighbours without loss are one segment."""
    before, after, loss = TEMPLATE.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2], False)
    body = escape(text)
    return [(before, False), (body, True), (after, False)] if loss else [(before + body + after, False)]


def _turns(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)))


def _batches(rows, names: list[str], kinds: list, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _sorted(df: DataFrame, key: str, *order: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key, *order)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, text, loss, valid): segments in order; valid is false from the first turn on that may not follow."""

    def run(batches):
        def rows():
            conv, state, seq, valid, begun = None, None, 0, True, False
            for conv_id, _, role, text in _turns(batches):
                if not begun or conv_id != conv:
                    conv, state, seq, valid, begun = conv_id, None, 0, True, True
                valid &= role in TRANSITIONS.get(state, ())
                state = role
                for body, loss in segments_of(role, text):
                    yield conv_id, seq, body, loss, valid
                    seq += 1

        yield from _batches(rows(), ["conv_id", "seq", "text", "loss", "valid"], [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()])

    empty = F.lit("")
    clean = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return _sorted(clean, "conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, seq long, text string, loss boolean, valid boolean")


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    for role, (before, after, _) in TEMPLATE.items():
        if formatted.startswith(before) and formatted.endswith(after) and len(formatted) >= len(before) + len(after):
            return role, unescape(formatted[len(before) : len(formatted) - len(after)])
    name, _, rest = formatted[len(OTHER[0]) : len(formatted) - len(OTHER[2])].partition(OTHER[1])
    return unescape(name), unescape(rest)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its segments alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and valid."""
    closing = tuple(after for _, after, _ in TEMPLATE.values()) + (OTHER[2],)

    def run(batches):
        def rows():
            conv, begun, held = None, False, ""
            state: dict = {}
            for conv_id, text, loss, valid in _turns(batches):
                if not begun or conv_id != conv:
                    if begun:
                        yield conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["valid"]
                    conv, begun, held = conv_id, True, ""
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "valid": True}
                state["size"] += len(text)
                state["valid"] &= valid
                held += text
                if loss:
                    plain = unescape(text)
                    state["chars"] += len(plain)
                    state["loss"].update(plain.encode())
                elif text.endswith(closing):
                    role, plain = parse_turn(held)
                    state["turns"].update(f"{role}\n{plain}\n".encode())
                    state["n"] += 1
                    held = ""
            if begun:
                yield conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["valid"]

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        yield from _batches(rows(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"], kinds)

    return _sorted(segments, "conv_id", "seq").select("conv_id", "text", "loss", "valid").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def format_and_read(conversations: DataFrame) -> DataFrame:
    return read_back(shared.written(format_conversations(conversations), "segments"))
