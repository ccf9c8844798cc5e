"""Column helpers for text: line splitting, stripping, literal prefilters, event time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a line, and those a strip removes, in Python's str methods.
_LINE_BREAKS = [0x0A, 0x0D, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]
_SPACES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
LINE_BREAK_RE = "\r\n|[" + "".join(map(chr, _LINE_BREAKS)) + "]"
STRIP_CHARS = "".join(map(chr, _SPACES))


def strip(text: Column) -> Column:
    """Remove Unicode white space on both sides (Spark's ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def split_lines(text: Column) -> Column:
    """Lines of a text as an array; a final line break opens no further line."""
    pieces = F.split(F.coalesce(text, F.lit("")), LINE_BREAK_RE, -1)
    n = F.size(pieces)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, n - 1)).otherwise(pieces)


def contains_any(text: Column, needles: list[str]) -> Column:
    """True if any literal occurs; a cheap test that runs before regexes."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def unicode_regex(pattern: str) -> str:
    r"""Give a pattern Unicode ``\w``, ``\d`` and ``\s`` under Java's engine.

    Java's Unicode white space leaves out the four ASCII separators, so ``\s`` is widened;
    ``d`` makes the newline the only line end for ``.`` and ``$``.
    """
    return "(?Ud)" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def matches_any(text: Column, patterns: list[str]) -> Column:
    """True if any literal pattern is found; each compiles once per task."""
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in patterns])


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, as BIGINT."""
    name = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), name)


def from_micros(us: Column) -> Column:
    """Zone-less timestamp of a microsecond count."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


SECOND = 1_000_000
