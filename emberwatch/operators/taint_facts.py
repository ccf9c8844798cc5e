"""Python snippets to flat facts.

The only Python in the scan. It states what each statement mentions and decides nothing about taint:
which calls are sources, which names are secret, what is tainted and what leaks are columns in
``operators.taint``.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ATOM = "struct<kind:string,owner:string,name:string,literal:string>"
_OPERAND = "struct<role:string,names:array<int>>"
# Names are numbers, counted from 0 in ``names`` of the text, so that each is judged once and compared as a number.
VISIT = (
    "struct<seq:int,kind:string,name:string,bare:string,method:string,detail:string,"
    "line:int,col:int,code:string,targets:array<int>,plain:array<int>,"
    f"flows:array<int>,atoms:array<{_ATOM}>,operands:array<{_OPERAND}>>"
)
FACTS = f"array<struct<ok:boolean,names:array<string>,visits:array<{VISIT}>>>"

_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
# What states nothing and has no children: names, constants and plain values of fields.
_LEAVES = {ast.Name, ast.Constant, ast.alias, type(None), str, int, bool}
# Fields that hold no node of interest in any class.
_BARE_FIELDS = {
    "ctx", "op", "ops", "id", "attr", "arg", "name", "names", "module", "level", "kind", "conversion", "simple", "is_async",
    "type_comment", "type_ignores", "rest", "kwd_attrs", "tag",
}
# Fields to go down by class of node, last first; filled as classes are met.
_FIELDS: dict[type, tuple[str, ...]] = {}


def _fields(kind: type) -> tuple[str, ...]:
    _FIELDS[kind] = tuple(f for f in reversed(getattr(kind, "_fields", ())) if f not in _BARE_FIELDS)
    return _FIELDS[kind]


def _dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a name or attribute chain; an attribute of anything else is its bare name."""
    if type(node) is ast.Name:
        return node.id
    tail = []
    while type(node) is ast.Attribute:
        tail.append(node.attr)
        node = node.value
    if type(node) is ast.Name:
        tail.append(node.id)
    return ".".join(reversed(tail)) or None


def _mentions(node: ast.AST) -> list[str]:
    """Names whose taint an expression carries directly, in the order they are looked at, however deep it nests."""
    kind = type(node)
    if kind is ast.Name:
        return [node.id]
    if kind is ast.Constant:
        return []
    names, pending = [], [node]
    while pending:
        node = pending.pop()
        kind = type(node)
        if kind is ast.Name:
            names.append(node.id)
        elif kind is ast.Constant:
            continue
        elif kind is ast.Attribute or kind is ast.Subscript:
            pending.append(node.value)
        elif kind is ast.Call:
            pending += [k.value for k in reversed(node.keywords)]
            pending += reversed(node.args)
        elif kind is ast.BinOp:
            pending += (node.right, node.left)
        elif kind is ast.JoinedStr:
            pending += [v.value for v in reversed(node.values) if type(v) is ast.FormattedValue]
    return names


def _writable(text: str | None) -> str | None:
    """Text that UTF-8 can carry: lone surrogates, which a literal may hold, are shown as escapes."""
    return text if text is None else text.encode("utf-8", "backslashreplace").decode("utf-8")


def _origins(value: ast.AST) -> tuple[list[str], list[tuple]]:
    """All names a value may take taint from, and the calls and subscripts it may start at as (kind, owner, name, literal)."""
    flows, atoms, pending = [], [], [value]
    while pending:
        node = pending.pop()
        kind = type(node)
        if kind is ast.Constant:
            continue
        flows += _mentions(node)
        if kind is ast.Attribute:
            pending.append(node.value)
        elif kind is ast.Subscript:
            atoms.append(("subscript", None, _dotted(node.value), None))
            pending.append(node.value)
        elif kind is ast.Call:
            func, args = node.func, node.args
            if type(func) is ast.Attribute:
                atoms.append(("method", _dotted(func.value), func.attr, None))
                pending.append(func.value)
            elif type(func) is ast.Name:
                first = args[0] if args else None
                literal = first.value if type(first) is ast.Constant and isinstance(first.value, str) else None
                atoms.append(("function", None, func.id, _writable(literal)))
                pending += args
    return list(dict.fromkeys(flows)), atoms


def _bound(target: ast.AST) -> list[str]:
    elements = target.elts if type(target) is ast.Tuple else [target]
    return [e.id for e in elements if type(e) is ast.Name]


# What one node states: place (the node whose position it carries), kind, operands as (role, names), name, bare, method, detail, and
# of a binding targets, plain, flows and atoms. A plain tuple, as there is one for most nodes.
_NO_BINDING = ((), (), (), ())


def _binding(place: ast.AST, kind: str, targets: list[ast.AST], value: ast.AST) -> tuple:
    flows, atoms = _origins(value)
    operands = [] if kind == "assign" else [("iter", _mentions(value))]
    bound = [name for t in targets for name in _bound(t)]
    plain = [t.id for t in targets if type(t) is ast.Name]
    return place, kind, operands, None, None, None, None, (bound, plain, flows, atoms)


def _assign(node: ast.Assign) -> list[tuple]:
    return [_binding(node, "assign", node.targets, node.value)]


def _annotated(node: ast.AnnAssign) -> list[tuple]:
    return [] if node.value is None else [_binding(node, "assign", [node.target], node.value)]


def _loop(node: ast.For) -> list[tuple]:
    return [_binding(node, "loop", [node.target], node.iter)]


def _subscript(node: ast.Subscript) -> list[tuple]:
    index = node.slice
    detail = _writable(str(index.value)) if type(index) is ast.Constant else None
    how = {ast.Constant: "constant", ast.Slice: "slice"}.get(type(index), "dynamic")
    return [(node, "subscript", [("value", _mentions(node.value))], how, None, None, detail, _NO_BINDING)]


def _compare(node: ast.Compare) -> list[tuple]:
    operands = [("left", _mentions(node.left)), *[("right", _mentions(r)) for r in node.comparators]]
    return [(node, "compare", operands, None, None, None, None, _NO_BINDING)]


def _fstring(node: ast.JoinedStr) -> list[tuple]:
    operands = [("part", _mentions(v.value)) for v in node.values if type(v) is ast.FormattedValue]
    return [(node, "fstring", operands, None, None, None, None, _NO_BINDING)]


def _call(node: ast.Call) -> list[tuple]:
    func = node.func
    operands = [("arg", _mentions(a)) for a in node.args]
    if node.keywords:
        operands += [("keyword", _mentions(k.value)) for k in node.keywords]
    bare = method = None
    if type(func) is ast.Name:
        bare = func.id
    elif type(func) is ast.Attribute:
        method = func.attr
        operands.append(("receiver", _mentions(func.value)))
    return [(node, "call", operands, _dotted(func), bare, method, None, _NO_BINDING)]


def _comprehension(node: ast.AST) -> list[tuple]:
    return [_binding(g, "comprehension", [g.target], g.iter) for g in node.generators]


# The facts a node states, by its class.
_STATING = {
    ast.Assign: _assign, ast.AnnAssign: _annotated, ast.For: _loop, ast.Subscript: _subscript, ast.Compare: _compare,
    ast.JoinedStr: _fstring, ast.Call: _call, **dict.fromkeys(_COMPREHENSIONS, _comprehension),
}
_FIXED = ["seq", "kind", "name", "bare", "method", "detail", "line", "col", "code"]
_NUMBERS = ("seq", "line", "col")


def _lists(ends: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def _columns(rows: list[tuple], names: list[str]) -> dict[str, pa.Array]:
    values = zip(*rows, strict=True) if rows else [()] * len(names)
    return {f: pa.array(v, pa.int32() if f in _NUMBERS else pa.string()) for f, v in zip(names, values, strict=True)}


class _Facts:
    """Facts of a batch of texts, gathered flat."""

    def __init__(self) -> None:
        self.ok, self.names, self.name_ends, self.visit_ends = [], [], [], []
        self.visits: list[tuple] = []
        self.numbered: dict[str, tuple[list, list]] = {f: ([], []) for f in ("targets", "plain", "flows")}
        self.atoms, self.atom_ends = [], []
        self.roles, self.operand_ends, self.mentioned, self.mention_ends = [], [], [], []

    def add(self, code: str) -> None:
        """Facts of one snippet in visiting order; ``ok`` is false if the parser does not take it."""
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree = None
        self.ok.append(tree is not None)
        table: dict[str, int] = {}
        pending: list[ast.AST] = [tree] if tree else []
        lines = code.splitlines()
        seq = 0
        while pending:
            node = pending.pop()
            kind = type(node)
            states = _STATING.get(kind)
            for place, what, operands, name, bare, method, detail, bound in states(node) if states else ():
                seq += 1
                if bound is _NO_BINDING:
                    operands = [o for o in operands if o[1]]
                    if not operands:
                        continue
                line = getattr(place, "lineno", 0)
                text = lines[line - 1].strip() if 0 < line <= len(lines) else ""
                self.visits.append((seq, what, name, bare, method, detail, line, getattr(place, "col_offset", 0), text))
                self._lists_of(table, bound, operands)
            for field in _FIELDS.get(kind) or _fields(kind):
                value = getattr(node, field, None)
                if type(value) is list:
                    for child in reversed(value):
                        if type(child) not in _LEAVES:
                            pending.append(child)
                elif type(value) not in _LEAVES:
                    pending.append(value)
        self.names += table
        self.name_ends.append(len(self.names))
        self.visit_ends.append(len(self.visits))

    def _lists_of(self, table: dict[str, int], bound: tuple, operands: list[tuple[str, list[str]]]) -> None:
        *numbered, atoms = bound
        for (values, ends), names in zip(self.numbered.values(), numbered, strict=True):
            if names:
                values += [table.setdefault(name, len(table)) for name in names]
            ends.append(len(values))
        self.atoms += atoms
        self.atom_ends.append(len(self.atoms))
        for role, names in operands:
            self.roles.append(role)
            self.mentioned += [table.setdefault(name, len(table)) for name in names]
            self.mention_ends.append(len(self.mentioned))
        self.operand_ends.append(len(self.roles))

    def column(self, text_ends: list[int]) -> pa.Array:
        atoms = _columns(self.atoms, ["kind", "owner", "name", "literal"])
        atoms = pa.StructArray.from_arrays(list(atoms.values()), list(atoms))
        mentions = _lists(self.mention_ends, pa.array(self.mentioned, pa.int32()))
        operands = pa.StructArray.from_arrays([pa.array(self.roles, pa.string()), mentions], ["role", "names"])
        columns = _columns(self.visits, _FIXED)
        columns |= {f: _lists(ends, pa.array(values, pa.int32())) for f, (values, ends) in self.numbered.items()}
        columns |= {"atoms": _lists(self.atom_ends, atoms), "operands": _lists(self.operand_ends, operands)}
        visits = _lists(self.visit_ends, pa.StructArray.from_arrays(list(columns.values()), list(columns)))
        names = _lists(self.name_ends, pa.array(self.names, pa.string()))
        return _lists(text_ends, pa.StructArray.from_arrays([pa.array(self.ok, pa.bool_()), names, visits], ["ok", "names", "visits"]))


def _facts_batch(codes: pa.Array) -> pa.Array:
    """No texts, and so no facts, where there is no list of them."""
    facts, ends = _Facts(), []
    for texts in codes.to_pylist():
        for code in texts or ():
            facts.add(code)
        ends.append(len(facts.ok))
    return facts.column(ends)


def extract_facts(codes: Column) -> Column:
    """``array<string>`` of Python texts to the facts of each, in the same order."""
    return F.arrow_udf(_facts_batch, FACTS)(codes)
