"""Replacing spans of a text that were found in what it shows, where they stand in the text itself."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks around a match, and between its name and the match: code points that no text should have.
OPEN, NAMED, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"
#: Code points that are not shown: zero-width characters and the byte order mark.
ZERO_WIDTH = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))
_MARKS = re.compile(f"([{OPEN}{NAMED}{CLOSE}])")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def marked_spans(marked: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the outermost marks, as places in the text without marks."""
    spans, at, depth, start, name, naming = [], 0, 0, 0, "", False
    for part in _MARKS.split(marked):
        if part == OPEN:
            naming = True
            depth += 1
            if depth == 1:
                start, name = at, ""
        elif part == NAMED:
            naming = False
        elif part == CLOSE:
            depth -= 1
            if depth == 0:
                spans.append((start, at, name))
        elif naming:
            name = name or part
        else:
            at += len(part)
    return spans


def shown_places(raw: str, shown: str) -> list[tuple[int, int]] | None:
    """For each character that is shown, where in the raw text it begins and ends; None if that cannot be told."""
    bare = [(k, c) for k, c in enumerate(raw) if c not in ZERO_WIDTH]
    text = "".join(c for _, c in bare)
    places, chars = [(k, k + 1) for k, _ in bare], text
    if text != shown:
        places, parts, at = [], [], 0
        for m in _ESCAPES.finditer(text):
            places += [(bare[i][0], bare[i][0] + 1) for i in range(at, m.start())]
            plain = bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")
            parts += [text[at : m.start()], plain]
            own = [len(c.encode()) * 3 for c in plain]
            if sum(own) != len(m.group()):
                places += [(bare[m.start()][0], bare[m.end() - 1][0] + 1)] * len(plain)
            else:
                i = m.start()
                for n in own:
                    places.append((bare[i][0], bare[i + n - 1][0] + 1))
                    i += n
            at = m.end()
        places += [(bare[i][0], bare[i][0] + 1) for i in range(at, len(text))]
        chars = "".join([*parts, text[at:]])
    return places if chars == shown else None


def replaced(raw: str | None, marked: str, shown: str, marked_shown: str | None, flags: list[dict]) -> str | None:
    """raw with marked matches, matches marked in what it shows and flagged tokens replaced by [NAME]. What cannot be placed is not let
    out: the whole text is then [HIDDEN]."""
    if raw is None:
        return None
    spans = marked_spans(marked)
    names = {}
    for flag in flags:  # the last label of a token counts
        names[flag["token"]] = flag["label"]
    hidden = marked_spans(marked_shown) if marked_shown is not None else []
    hidden += [(m.start(), m.end(), names[m.group()]) for m in _TOKEN.finditer(shown) if m.group() in names]
    if hidden:
        places = shown_places(raw, shown)
        if places is None:
            return "[HIDDEN]"
        spans += [(places[s][0], places[e - 1][1], name) for s, e, name in hidden if e > s]
    out, at = [], 0
    for start, end, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [raw[at:start], f"[{name}]"]
        at = max(at, end)
    return "".join([*out, raw[at:]])


def _batch(*columns: pa.Array) -> pa.Array:
    return pa.array([replaced(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.string())


def replace_spans(raw: Column, marked: Column, shown: Column, marked_shown: Column, flags: Column) -> Column:
    """``replaced`` as a column; NULL where raw is NULL."""
    return F.arrow_udf(_batch, "string")(raw, marked, shown, marked_shown, flags)
