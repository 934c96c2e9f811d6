"""Text helpers that keep the line and white-space rules of the logs' producers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


#: Every Unicode line end but the line feed, and a pattern of them.
ENDS = ["\r", "\x0B", "\f", "\x1C", "\x1D", "\x1E", "\x85", "\u2028", "\u2029"]
OTHER_END = f"[{''.join(ENDS)}]"


def lines_nl(col: Column) -> Column:
    """Lines by line feed only; a final empty line is kept."""
    return F.split(col, "\n")


def lines_py(col: Column) -> Column:
    """Lines by every Unicode line end; a final empty line is dropped.

    The lines of a text are made once, and only a text with other line ends than the line feed is rewritten;
    they are sought one by one, which costs a fifth of a pattern.
    """
    plain = F.when(any_of(col, ENDS), F.regexp_replace(col, r"\r\n|" + OTHER_END, "\n")).otherwise(col)
    return let(F.split(plain, "\n"), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def any_of(col: Column, hints: list[str]) -> Column:
    """Whether the column holds one of the hints."""
    out = F.lit(False)
    for hint in hints:
        out = out | F.contains(col, F.lit(hint))
    return out


def first_match(col: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """The name of the first rule of which some pattern is found."""
    out = None
    for name, patterns in rules:
        found = col.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(other)
