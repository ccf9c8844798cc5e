"""T7, T8-T12, T14 in one pass over a text's visits: which names are tainted, and which operands leak them.

What starts taint and which names look like a secret are columns; the fold only follows names, as numbers, through a table of one
flag each. Its time is that of the facts, however long the chain of bindings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of visits as the fold knows them. A loop or comprehension whose value is tainted leaks even if no name can be told.
USE, ASSIGN, LOOP = 0, 1, 2
#: The number of no name.
EXPRESSION = -1

LEAKS = "array<struct<at:int,hits:array<struct<operand:int,name:int>>>>"
TRACES = f"array<struct<tainted:array<int>,leaks:{LEAKS}>>"


class _Lists:
    """A list column's values and where each list begins and ends, as plain numbers."""

    def __init__(self, column: pa.ListArray) -> None:
        self.ends = column.offsets.to_pylist()
        self.inner = column.values

    def values(self) -> list:
        return self.inner.to_numpy(zero_copy_only=False).tolist()


def _numbers(column: pa.ListArray) -> tuple[list[int], list[int]]:
    lists = _Lists(column)
    return lists.ends, lists.values()


def _fold(texts: pa.Array) -> pa.Array:
    per_row = _Lists(texts)
    text = per_row.inner
    given_ends, given = _numbers(text.field("given"))
    secret_ends, secret = _numbers(text.field("secret"))
    visit_lists = _Lists(text.field("visits"))
    visit = visit_lists.inner
    kinds, starts = visit.field("kind").to_pylist(), visit.field("starts").to_pylist()
    target_ends, targets = _numbers(visit.field("targets"))
    plain_ends, plain = _numbers(visit.field("plain"))
    flow_ends, flows = _numbers(visit.field("flows"))
    operand_lists = _Lists(visit.field("operands"))
    operand_ends = operand_lists.ends
    mention_ends, mentions = _numbers(operand_lists.inner)
    tainted_ends, tainted_values, leak_ends, at, hit_ends, hit_operand, hit_name = [], [], [], [], [], [], []
    for k in range(len(text)):
        looks_secret = secret[secret_ends[k] : secret_ends[k + 1]]
        known = bytearray(len(looks_secret))
        order = []

        def taint(names, known=known, order=order):
            for name in names:
                if not known[name]:
                    known[name] = 1
                    order.append(name)

        taint(given[given_ends[k] : given_ends[k + 1]])
        first = visit_lists.ends[k]
        for v in range(first, visit_lists.ends[k + 1]):
            kind = kinds[v]
            fires = False
            if kind != USE:
                fires = starts[v] or any(known[n] for n in flows[flow_ends[v] : flow_ends[v + 1]])
            if (order or fires) and kind != ASSIGN:
                for o in range(operand_ends[v], operand_ends[v + 1]):
                    name = next((n for n in mentions[mention_ends[o] : mention_ends[o + 1]] if known[n]), EXPRESSION if kind == LOOP and fires else None)
                    if name is not None:
                        if len(at) == len(hit_ends):  # the first of this visit
                            at.append(v - first)
                        hit_operand.append(o - operand_ends[v])
                        hit_name.append(name)
                if len(at) > len(hit_ends):
                    hit_ends.append(len(hit_name))
            if kind != USE:
                if fires:
                    taint(targets[target_ends[v] : target_ends[v + 1]])
                if kind == ASSIGN:
                    taint([n for n in plain[plain_ends[v] : plain_ends[v + 1]] if looks_secret[n]])
        tainted_values += order
        tainted_ends.append(len(tainted_values))
        leak_ends.append(len(at))
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)
    numbers = lambda values: pa.array(values, pa.int32())
    hits = lists(hit_ends, pa.StructArray.from_arrays([numbers(hit_operand), numbers(hit_name)], ["operand", "name"]))
    leaks = lists(leak_ends, pa.StructArray.from_arrays([numbers(at), hits], ["at", "hits"]))
    traced = pa.StructArray.from_arrays([lists(tainted_ends, numbers(tainted_values)), leaks], ["tainted", "leaks"])
    return pa.ListArray.from_arrays(pa.array([e - per_row.ends[0] for e in per_row.ends], pa.int32()), traced.slice(per_row.ends[0], per_row.ends[-1] - per_row.ends[0]))


def trace(texts: Column) -> Column:
    """(tainted, leaks) of each text of an array of (given, secret, visits).

    given: names tainted before all; secret: whether each name looks like one; visits: (kind, starts, targets, plain, flows, operands) in
    visiting order, where operands lists the names each mentions. tainted: names in the order in which they are tainted. leaks: by its
    place, each visit with tainted operands, and for each of these the first name that is tainted by then, or EXPRESSION.
    """
    return F.arrow_udf(_fold, TRACES)(texts)
