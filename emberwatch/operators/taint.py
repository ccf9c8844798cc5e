"""Taint tracing over facts (T2-T14, U1-U22) as columns of the snippet's own row.

A name is tainted from the first binding that fires: one whose value starts at a source, or mentions
a name tainted earlier; a use fires if one of the names it mentions was tainted before it. What
starts taint, which names look secret and what a leak means are columns; ``taint_fold`` follows the
names of a snippet in one pass. Snippets never meet, so nothing is shuffled.

``operators.taint_graph`` states the same over edge tables, for facts that are stored as rows.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.rules import (
    ENCODING_CALLS, OUTPUT_SINKS, SEVERITY_RANK, SOURCE_CALLS, SOURCE_METHODS, SOURCE_SUBSCRIPTS,
    is_secret_name, is_sensitive_path,
)
from emberwatch.operators.line_scan import FINDINGS
from emberwatch.operators.taint_fold import ASSIGN, EXPRESSION, LOOP, USE

BINDINGS = ("assign", "loop", "comprehension")


def is_source(atom: Column) -> Column:
    """A call or subscript that yields a secret value."""
    qualified = F.concat_ws(".", atom["owner"], atom["name"])
    method = (atom["kind"] == "method") & (
        atom["name"].isin(SOURCE_METHODS) | (atom["owner"].isNotNull() & qualified.isin(SOURCE_CALLS))
    )
    function = (atom["kind"] == "function") & (
        (atom["name"] == "getenv")
        | ((atom["name"] == "open") & atom["literal"].isNotNull() & is_sensitive_path(atom["literal"]))
    )
    subscript = (atom["kind"] == "subscript") & atom["name"].isin(SOURCE_SUBSCRIPTS)
    return F.coalesce(method | function | subscript, F.lit(False))


def starts_taint(visit: Column) -> Column:
    return F.exists(visit["atoms"], is_source)


def edge_rows(extracted: DataFrame, key: str = "snippet_id") -> DataFrame:
    """Edges of T2-T10 as rows ``key, seq, kind, target, src, origin``; ``src`` is NULL for a source.

    ``origin`` says what starts the taint: ``call``, ``method``, ``function``, ``subscript`` or ``name``.
    """
    visits = _visit_rows(extracted, key).filter(F.col("kind").isin(*BINDINGS))
    of = lambda numbers: F.transform(numbers, lambda n: F.get("names", n))
    # Directly assigned names that look like a secret.
    secret = F.when(F.col("kind") == "assign", F.filter(of(F.col("plain")), is_secret_name)).otherwise(F.slice("names", 1, 0))

    def origin(atom: Column) -> Column:
        by_call = F.concat_ws(".", atom["owner"], atom["name"]).isin(SOURCE_CALLS) & atom["owner"].isNotNull()
        return F.when(is_source(atom), F.when((atom["kind"] == "method") & by_call, "call").otherwise(atom["kind"]))

    def edges(sources: Column, targets: Column) -> Column:
        return F.flatten(F.transform(targets, lambda t: F.transform(
            sources, lambda s: F.struct(t.alias("target"), s["src"].alias("src"), s["origin"].alias("origin"))
        )))

    def flow(name: Column) -> Column:
        return F.struct(name.alias("src"), F.lit("flow").alias("origin"))

    def start(label: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("src"), label.alias("origin"))

    starts = F.transform(F.array_compact(F.transform("atoms", origin)), start)
    named = edges(F.array(start(F.lit("name"))), secret)
    all_edges = F.concat(edges(F.concat(starts, F.transform(of(F.col("flows")), flow)), of(F.col("targets"))), named)
    return visits.select(key, F.col("seq").cast("bigint").alias("seq"), "kind", F.inline(all_edges))


def candidate_rows(extracted: DataFrame, key: str = "snippet_id") -> DataFrame:
    """Names each use mentions, as ``key, seq, kind, role, operand, cand_pos, cand`` rows."""
    operands = _visit_rows(extracted, key).select(key, "names", "seq", "kind", F.posexplode("operands").alias("operand", "o"))
    named = F.transform("o.names", lambda n: F.get("names", n))
    return operands.select(
        key, "seq", "kind", F.col("o.role").alias("role"), "operand", F.posexplode(named).alias("cand_pos", "cand")
    )


def _visit_rows(extracted: DataFrame, key: str) -> DataFrame:
    """Visits of each snippet's first text as rows, with the text's ``names``."""
    fact = extracted.select(key, F.get("_facts", F.lit(0)).alias("fact"))
    return fact.select(key, F.col("fact.names").alias("names"), F.inline("fact.visits"))


def mentions_any(facts: Column, names: Column) -> Column:
    """Whether some text of ``facts`` mentions one of ``names``."""
    return F.exists(facts, lambda fact: F.coalesce(F.arrays_overlap(fact["names"], names), F.lit(False)))


def traceable(facts: Column, extra_names: Column) -> Column:
    """What ``taint_fold.trace`` asks of each text of ``facts`` (T2-T7); ``extra_names`` holds a list of names per text that are
    tainted before all."""

    def followed(visit: Column) -> Column:
        kind = F.when(visit["kind"] == "assign", ASSIGN).when(visit["kind"].isin("loop", "comprehension"), LOOP).otherwise(USE)
        return F.struct(
            kind.alias("kind"), starts_taint(visit).alias("starts"), visit["targets"].alias("targets"), visit["plain"].alias("plain"),
            visit["flows"].alias("flows"), visit["operands"]["names"].alias("operands"),
        )

    def numbered(names: Column, extra: Column) -> Column:
        places = F.transform(extra, lambda x: F.array_position(names, x).cast("int") - 1)
        return F.filter(places, lambda p: p >= 0)

    def text(fact: Column, extra: Column) -> Column:
        return F.struct(
            numbered(fact["names"], extra).alias("given"), F.transform(fact["names"], is_secret_name).alias("secret"),
            F.transform(fact["visits"], followed).alias("visits"),
        )

    def worth(asked: Column) -> Column:
        # Where nothing can start taint there is nothing to follow.
        may = (F.size(asked["given"]) > 0) | F.exists(asked["secret"], lambda s: s) | F.exists(asked["visits"], lambda v: v["starts"])
        visits = F.when(may, asked["visits"]).otherwise(F.slice(asked["visits"], 1, 0))
        return F.struct(asked["given"].alias("given"), asked["secret"].alias("secret"), visits.alias("visits"))

    return F.transform(F.zip_with(facts, extra_names, text), worth)


class UseRule(NamedTuple):
    rule_id: str
    kind: str  # kind of visit
    role: str  # operand that must be tainted
    by: str  # what of the visit is compared with ``values``: any, name, bare, method or tail
    values: list[str]
    severity: str
    leak_type: str
    message: str


# Severity, leak type and message of each use; the order is the order of findings at one node.
USE_RULES = [
    UseRule("U1", "subscript", "value", "name", ["constant"], "CRITICAL", "char_extraction",
            "Indexing tainted '{var}' at position {detail}"),
    UseRule("U2", "subscript", "value", "name", ["slice"], "CRITICAL", "slice_extraction",
            "Slicing tainted '{var}' extracts substring"),
    UseRule("U3", "subscript", "value", "name", ["dynamic"], "HIGH", "char_extraction",
            "Dynamic indexing into tainted '{var}'"),
    UseRule("U4", "compare", "left", "any", [], "HIGH", "comparison_leak",
            "Comparing tainted '{var}' leaks via boolean result"),
    UseRule("U5", "compare", "right", "any", [], "HIGH", "comparison_leak",
            "Comparing against tainted '{var}'"),
    UseRule("U6", "call", "arg", "bare", ["ord"], "CRITICAL", "ord_byte_value",
            "ord() on tainted '{var}' exposes byte value"),
    UseRule("U7", "call", "arg", "bare", ["len"], "MEDIUM", "property_probe",
            "len() on tainted '{var}' leaks secret length"),
    UseRule("U8", "call", "arg", "bare", ["hex", "oct", "bin"], "HIGH", "encoding_transform",
            "{name}() on tainted '{var}' encodes value"),
    UseRule("U9", "call", "arg", "bare", ["repr"], "CRITICAL", "property_probe",
            "repr() on tainted '{var}' may expose full value"),
    UseRule("U10", "call", "arg", "bare", ["hash"], "MEDIUM", "property_probe",
            "hash() on tainted '{var}' enables offline brute-force"),
    UseRule("U11", "call", "arg", "bare", ["type"], "LOW", "property_probe",
            "type() on tainted '{var}'"),
    UseRule("U12", "call", "receiver", "method", ["startswith", "endswith"], "HIGH", "property_probe",
            "'{var}'.{method}() enables binary search of value"),
    UseRule("U13", "call", "receiver", "method", ["find", "rfind", "index", "rindex"], "HIGH", "property_probe",
            "'{var}'.{method}() reveals character positions"),
    UseRule("U14", "call", "receiver", "method", ["count"], "MEDIUM", "property_probe",
            "'{var}'.count() reveals character frequency"),
    UseRule("U15", "call", "receiver", "method", ["encode", "decode", "hex"], "HIGH", "encoding_transform",
            "'{var}'.{method}() transforms secret encoding"),
    UseRule("U16", "call", "receiver", "method", ["split", "partition", "rpartition"], "MEDIUM", "property_probe",
            "'{var}'.{method}() reveals structure"),
    UseRule("U17", "call", "arg", "name", ENCODING_CALLS, "HIGH", "encoding_transform",
            "{name}() on tainted '{var}'"),
    UseRule("U18", "loop", "iter", "any", [], "CRITICAL", "iteration_over_secret",
            "Iterating over tainted '{var}' exposes each element"),
    UseRule("U19", "comprehension", "iter", "any", [], "CRITICAL", "iteration_over_secret",
            "Comprehension iterates over tainted '{var}'"),
    UseRule("U20", "call", "arg", "tail", OUTPUT_SINKS, "HIGH", "indirect_output",
            "Outputting derived data from tainted '{var}' via {name}()"),
    UseRule("U21", "call", "keyword", "tail", OUTPUT_SINKS, "HIGH", "indirect_output",
            "Outputting derived data from tainted '{var}' via {name}()"),
    UseRule("U22", "fstring", "part", "any", [], "HIGH", "format_string_leak",
            "f-string interpolates tainted '{var}'"),
]


def _rule_table() -> Column:
    """The use rules as one literal array, so that a plan holds one expression for all of them."""
    rows = [{**r._asdict(), "sev_rank": SEVERITY_RANK[r.severity], "place": i} for i, r in enumerate(USE_RULES)]
    schema = (
        "array<struct<kind:string,role:string,by:string,values:array<string>,severity:string,sev_rank:int,"
        "leak_type:string,message:string,place:int>>"
    )
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _applies(rule: Column, visit: Column) -> Column:
    """Whether a rule is about this visit; ``tail`` is the last part of a dotted name."""
    compared = (
        F.when(rule["by"] == "bare", visit["bare"]).when(rule["by"] == "method", visit["method"])
        .when(rule["by"] == "tail", F.substring_index(visit["name"], ".", -1)).otherwise(visit["name"])
    )
    named = F.coalesce(F.array_contains(rule["values"], compared), F.lit(False))
    return (rule["kind"] == visit["kind"]) & ((rule["by"] == "any") | named)


def _message(rule: Column, visit: Column, var: Column) -> Column:
    """The rule's message with the tainted name and the visit's own words filled in."""
    text = rule["message"]
    for field, value in [("var", var), ("name", visit["name"]), ("method", visit["method"]), ("detail", visit["detail"])]:
        text = F.replace(text, F.lit("{" + field + "}"), F.coalesce(value, F.lit("")))
    return text


def use_findings(names: Column, visits: Column, leaks: Column, item: Column) -> Column:
    """T14 with U1-U22: findings of one text in visiting order; ``item`` names its place in the snippet."""

    def leaking(leak: Column) -> Column:
        visit = F.get(visits, leak["at"])

        def hit(x: Column) -> Column:
            var = F.when(x["name"] == EXPRESSION, F.lit("tainted_expression")).otherwise(F.get(names, x["name"]))
            return F.struct(F.get(visit["operands"]["role"], x["operand"]).alias("role"), var.alias("var"))

        return F.struct(visit.alias("visit"), F.transform(leak["hits"], hit).alias("hits"))

    with_hits = F.transform(leaks, leaking)

    def of_rule(rule: Column, x: Column) -> Column:
        visit = x["visit"]

        def finding(hit: Column, index: Column) -> Column:
            fields = {
                "part": F.lit(0), "at_line": item["line"], "stage": F.lit(1), "item": item["item"],
                "seq": visit["seq"], "sub": F.shiftleft(rule["place"].cast("bigint"), 32) + index.cast("bigint"),
                "line": F.when(item["line"] > 0, item["line"]).otherwise(visit["line"]), "col": visit["col"],
                "severity": rule["severity"], "sev_rank": rule["sev_rank"], "leak_type": rule["leak_type"],
                "message": F.concat(
                    F.when(item["line"] > 0, "[embedded python] ").otherwise(""), _message(rule, visit, hit["var"])
                ),
                "code_snippet": visit["code"], "tainted_var": hit["var"], "lang": F.lit("python"),
            }
            return F.struct(*[c.alias(n) for n, c in fields.items()])

        return F.transform(F.filter(x["hits"], lambda hit: hit["role"] == rule["role"]), finding)

    def of_visit(x: Column) -> Column:
        rules = F.filter(_rule_table(), lambda r: _applies(r, x["visit"]))
        return F.flatten(F.transform(rules, lambda r: of_rule(r, x)))

    return F.coalesce(F.flatten(F.transform(with_hits, of_visit)), F.array().cast(FINDINGS))
