"""Blocks of Python sources by one scan: strings, brackets and continuations make logical lines, indentation makes blocks."""

from __future__ import annotations

import re

_MARK = re.compile(r"""#[^\n]*|[fFrRbBuUtT]{0,2}(?:\"\"\"|'''|"|')|[\[({]|[\])}]|\\\n|\n""")
_HEAD = re.compile(r"(?:(async)\s+)?(def|class)\s+(\w+)")
#: Characters given of each logical line, and taken for each line in the first part of a text that is tried.
TEXT, LINE = 400, 40
_CLOSE = {
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+(?:""")?', re.DOTALL),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+(?:''')?", re.DOTALL),
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+"?', re.DOTALL),
    "'": re.compile(r"(?:[^'\\\n]|\\.)*+'?", re.DOTALL),
}


def logical_lines(source: str):
    """(indent, first line, last line, text of the first line from its first letter on) of each logical line; blank lines and comments are none."""
    at, depth, line, n = 0, 0, 1, len(source)
    start, begin = None, 0  # the line and place where the logical line begins
    while at < n:
        if start is None:
            while at < n and source[at] in " \t\f":
                at += 1
            if at == n:
                break
            if source[at] not in "#\n" and source[at : at + 2] != "\\\n":
                start, begin = line, at
        mark = _MARK.search(source, at)
        if mark is None:
            break
        text = mark.group()
        at = mark.end()
        if text == "\n":
            if start is not None and depth == 0:
                yield _indent(source, begin), start, line, source[begin : begin + TEXT]
                start = None
            line += 1
        elif text == "\\\n":
            line += 1
        elif text[0] in "[({":
            depth += 1
        elif text[0] in "])}":
            depth = max(0, depth - 1)
        elif text[0] != "#":
            end = _CLOSE[text.lstrip("fFrRbBuUtT")].match(source, at).end()
            line += source.count("\n", at, end)
            at = end
    if start is not None:
        yield _indent(source, begin), start, line if not source.endswith("\n") else line - 1, source[begin : begin + TEXT]


def _indent(source: str, begin: int) -> int:
    head = source[source.rfind("\n", 0, begin) + 1 : begin]
    return len(head.rpartition("\f")[2].expandtabs(8))


def definitions(source: str, until: int | None = None) -> list[tuple[str, str, str | None, int, int]]:
    """(kind, name, class, first line, last line) of each function and class; class: of which body it is a statement.

    until: only those that begin by this line; the scan ends with the last of their blocks, and
    tries the beginning of the text first, as the logical line in which it ends may be very long.
    """
    size = LINE * max(2, (until or 0) + 2)
    while until is not None and size < len(source):
        found, done = _definitions(source[:size], until)
        if done:
            return found
        size *= 8
    return _definitions(source, until)[0]


def _definitions(source: str, until: int | None) -> tuple[list, bool]:
    """The definitions, and whether the scan ended at a line of which all that counts lies in the source."""
    out, open_blocks, last, done, whole = [], [], 0, False, True

    def close(indent: int) -> None:
        while open_blocks and open_blocks[-1][0] >= indent:
            found = open_blocks.pop()[1]
            if found:
                out.append((*found, last))

    for indent, first, end, text in logical_lines(source.replace("\r\n", "\n").replace("\r", "\n")):
        close(indent)
        if until is not None and first > until and not any(found and found[3] <= until for _, found in open_blocks):
            done = whole and len(text) >= 4
            break
        head = _HEAD.match(text)
        whole = whole and not (head and head.end() == len(text) < TEXT)  # a name on the next line may be cut
        above = open_blocks[-1][1] if open_blocks else None
        found = (("async_" if head[1] else "") + head[2], head[3], above[1] if above and above[0] == "class" else None, first) if head else None
        open_blocks.append((indent, found))
        last = end
    close(-1)
    return sorted((d for d in out if until is None or d[3] <= until), key=lambda x: (x[3], x[4])), done
