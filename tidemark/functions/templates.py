"""Text templates over tables, compiled to expressions.

A template is text with actions in double braces: fields (.Name.Part), variables ($x), if / else,
range over lists or tables ($i, $x := .List), and calls of functions; a dash inside the braces takes the
white space beside them. It is compiled against schemas, not run by row: scalars are columns of one
row, a range over a table becomes the table's rows, a range within a row a function of its array. So
a document is a number of pieces, each a column of text over the one row or over a table, in order;
what no table holds is never brought together.

An action that the template's data has no field for, and a template that does not end its blocks,
are errors when it is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, NumericType, StringType, StructType


class TemplateError(ValueError):
    pass


@dataclass
class Text:
    value: str


@dataclass
class Show:
    call: list


@dataclass
class If:
    cond: list
    yes: list = field(default_factory=list)
    no: list = field(default_factory=list)


@dataclass
class Range:
    names: list[str]
    over: list
    body: list = field(default_factory=list)


_ACTION = re.compile(r"\{\{(-(?=\s))?\s*(.*?)\s*((?<=\s)-)?\}\}", re.S)
_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(\$?[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*|\$(?:\.[A-Za-z_]\w*)*)|((?:\.[A-Za-z_]\w*)+|\.)|(\d+)|([()]))')


def _call(text: str) -> list:
    """An expression as nested lists of tokens."""
    stack: list[list] = [[]]
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:]!r}")
        at = m.end()
        t = m.group().strip()
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise TemplateError(f"unbalanced parenthesis in {text!r}")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(t)
    if len(stack) > 1 or not stack[0]:
        raise TemplateError(f"unfinished expression {text!r}")
    return stack[0]


def parse(template: str) -> list:
    """The template's tree."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _ACTION.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if trim else text
        parts += [("text", text.rstrip() if m.group(1) else text), ("action", m.group(2))]
        at, trim = m.end(), bool(m.group(3))
    rest = template[at:]
    if "{{" in rest:
        raise TemplateError("an action does not end")
    parts.append(("text", rest.lstrip() if trim else rest))
    root: list = []
    stack: list[tuple[object, list]] = [(None, root)]
    for kind, value in parts:
        _, into = stack[-1]
        if kind == "text":
            if value:
                into.append(Text(value))
            continue
        word, _, tail = value.partition(" ")
        if word == "if":
            node: If | Range = If(_call(tail))
            into.append(node)
            stack.append((node, node.yes))
        elif word == "range":
            names, eq, over = tail.rpartition(":=")
            node = Range([n.strip() for n in names.split(",")] if eq else [], _call(over))
            into.append(node)
            stack.append((node, node.body))
        elif word == "else":
            open_node, _ = stack.pop()
            if not isinstance(open_node, If):
                raise TemplateError("else without if")
            stack.append((open_node, open_node.no))
        elif word == "end":
            if len(stack) == 1:
                raise TemplateError("end without a block")
            stack.pop()
        else:
            into.append(Show(_call(value)))
    if len(stack) > 1:
        raise TemplateError("a block does not end")
    return _by_lines(root)


def _by_lines(nodes: list) -> list:
    """Where a range's body begins with a line end, has none at its end and is followed by one, the line end before each turn becomes one behind it: the same text, in whole lines."""
    for n in nodes:
        if isinstance(n, If):
            n.yes, n.no = _by_lines(n.yes), _by_lines(n.no)
    out: list = []
    for i, n in enumerate(nodes):
        after = nodes[i + 1] if i + 1 < len(nodes) else None
        if isinstance(n, Range) and n.body and isinstance(n.body[0], Text) and n.body[0].value.startswith("\n") and isinstance(after, Text) and after.value.startswith("\n"):
            last = n.body[-1]
            if not (isinstance(last, Text) and last.value.endswith("\n")):
                out.append(Text("\n"))
                n = Range(n.names, n.over, [Text(n.body[0].value[1:]), *n.body[1:], Text("\n")])
                nodes[i + 1] = Text(after.value[1:])
        out.append(n)
    return out


@dataclass(frozen=True)
class Value:
    """A column with its type; table: the name of a table that it stands for, with its number of rows as the column."""

    column: Column
    type: DataType
    table: str | None = None

    def part(self, name: str) -> Value:
        if not isinstance(self.type, StructType) or name not in self.type.names:
            raise TemplateError(f"no field {name}")
        return Value(self.column[name], self.type[name].dataType)

    def holds(self) -> Column:
        """Whether it is neither empty nor zero nor false."""
        if isinstance(self.type, StringType):
            return F.coalesce(self.column, F.lit("")) != ""
        if isinstance(self.type, BooleanType):
            return F.coalesce(self.column, F.lit(False))
        if isinstance(self.type, ArrayType):
            return F.coalesce(F.size(self.column), F.lit(0)) > 0
        if isinstance(self.type, NumericType):
            return F.coalesce(self.column, F.lit(0)) != 0
        return F.lit(True)  # a struct is never empty

    def text(self) -> Column:
        empty = "0" if isinstance(self.type, NumericType) else "false" if isinstance(self.type, BooleanType) else ""
        return F.coalesce(self.column.cast("string"), F.lit(empty))


def _length(v: Value) -> Value:
    if v.table is not None:
        return Value(v.column, IntegerType())
    if not isinstance(v.type, ArrayType):
        raise TemplateError("len of what is no list")
    return Value(F.greatest(F.coalesce(F.size(v.column), F.lit(0)), F.lit(0)), IntegerType())


def _bool(c: Column) -> Value:
    return Value(c, BooleanType())


FUNCTIONS: Mapping[str, Callable[..., Value]] = {
    "len": _length,
    "inc": lambda v: Value(v.column + 1, v.type),
    "join": lambda v, by: Value(F.coalesce(F.array_join(F.transform(v.column, lambda x: F.coalesce(x, F.lit(""))), by), F.lit("")) if isinstance(by, str) else F.array_join(v.column, ", "), StringType()),
    "not": lambda v: _bool(~v.holds()),
    "or": lambda *vs: _bool(_any([v.holds() for v in vs])),
    "and": lambda *vs: _bool(~_any([~v.holds() for v in vs])),
    "eq": lambda a, b: _bool(a.column.eqNullSafe(b.column if isinstance(b, Value) else F.lit(b))),
}


def _any(cs: list[Column]) -> Column:
    out, *rest = cs
    for c in rest:
        out = out | c
    return out


@dataclass(frozen=True)
class Scope:
    """What names stand for: the dot, the variables, the functions."""

    dot: Value
    names: Mapping[str, Value]
    functions: Mapping[str, Callable[..., Value]]

    def value(self, token) -> Value | str | int:
        if isinstance(token, list):
            return self.run(token)
        if token.startswith('"'):
            return token[1:-1].encode().decode("unicode_escape")
        if token.isdigit():
            return int(token)
        head, *parts = token.split(".")
        if head == "":
            v, parts = self.dot, [p for p in parts if p]
        elif head in self.names:
            v = self.names[head]
        else:
            raise TemplateError(f"unknown name {token}")
        for p in parts:
            v = v.part(p)
        return v

    def run(self, call: list) -> Value:
        first, *rest = call
        if isinstance(first, str) and first in self.functions:
            return self.functions[first](*(self.value(a) for a in rest))
        if rest:
            raise TemplateError(f"no function {first}")
        v = self.value(first)
        return v if isinstance(v, Value) else Value(F.lit(v), StringType() if isinstance(v, str) else IntegerType())


def _joined(columns: list[Column]) -> Column:
    return F.concat(*columns) if columns else F.lit("")


def rendered(nodes: list, scope: Scope) -> Column:
    """Nodes without a range over a table as one column."""
    out: list[Column] = []
    for n in nodes:
        if isinstance(n, Text):
            out.append(F.lit(n.value))
        elif isinstance(n, Show):
            out.append(scope.run(n.call).text())
        elif isinstance(n, If):
            out.append(F.when(scope.run(n.cond).holds(), rendered(n.yes, scope)).otherwise(rendered(n.no, scope)))
        else:
            over = scope.run(n.over)
            if not isinstance(over.type, ArrayType):
                raise TemplateError("range over what is no list")
            out.append(F.coalesce(F.array_join(F.transform(over.column, _turn(n, over.type.elementType, scope)), ""), F.lit("")))
    return _joined(out)


def _turn(n: Range, kind: DataType, scope: Scope) -> Callable[[Column, Column], Column]:
    return lambda x, i: rendered(n.body, within(scope, n.names, Value(x, kind), Value(i, IntegerType())))


def within(scope: Scope, names: list[str], item: Value, index: Value) -> Scope:
    """The scope of a range's body."""
    bound = {names[0]: item} if len(names) == 1 else {names[0]: index, names[1]: item} if names else {}
    return replace(scope, dot=item, names={**scope.names, **bound})


@dataclass
class Piece:
    """A part of a document: text over the one row, or over a table's rows with their index; shown where guard holds in the one row."""

    table: str | None
    guard: Column
    text: Callable[[Value, Value], Column] | Column


def pieces(template: str, one: StructType, tables: Mapping[str, StructType], functions: Mapping[str, Callable[..., Value]] | None = None) -> list[Piece]:
    """The parts of a document in order. one: scalars of the one row, where table T has its number of rows as rows_T; tables: the schemas of their rows."""
    every = {**FUNCTIONS, **(functions or {})}

    class Root(Value):
        def part(self, name: str) -> Value:
            if name in tables:
                return Value(F.col(f"rows_{name}"), IntegerType(), name)
            if name not in one.names:
                raise TemplateError(f"no field {name}")
            return Value(F.col(name), one[name].dataType)

    scope = Scope(Root(F.lit(None), StructType()), {}, every)
    out: list[Piece] = []

    def has_table(nodes: list) -> bool:
        for n in nodes:
            if isinstance(n, If) and (has_table(n.yes) or has_table(n.no)):
                return True
            if isinstance(n, Range) and scope.run(n.over).table is not None:
                return True
        return False

    def walk(nodes: list, guard: Column) -> None:
        held: list = []

        def flush() -> None:
            nonlocal held
            if held:
                out.append(Piece(None, guard, rendered(held, scope)))
            held = []

        for n in nodes:
            if isinstance(n, If) and has_table([n]):
                flush()
                cond = scope.run(n.cond).holds()
                walk(n.yes, guard & cond)
                walk(n.no, guard & ~cond)
            elif isinstance(n, Range) and (t := scope.run(n.over).table) is not None:
                flush()
                body = lambda row, index, n=n: rendered(n.body, within(scope, n.names, row, index))
                body(Value(F.struct(F.lit(1)), tables[t]), Value(F.lit(0), IntegerType()))  # fails now, not when it is shown
                out.append(Piece(t, guard, body))
            else:
                held.append(n)
        flush()

    walk(parse(template), F.lit(True))
    return out
