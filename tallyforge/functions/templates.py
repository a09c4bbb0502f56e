"""Chat templates as expressions: a template's text is compiled on the driver, and rows are rendered by built-in functions.

`compiled` takes a template as model files carry it and gives a Column from a column of messages (role, content). Loops over
messages become a transform and a join of texts, conditions a choice, and what is known when the template is compiled (the
markers, the generation prompt, the frozen date) is decided then. Understood are for (over messages or a slice of them), if,
set, literals, string and integer operators, comparisons, `in`, the tests defined, none and string, the loop variables and
the functions and filters below, with blanks around tags treated as renderers of chat templates do. Anything else, such as
macros or values carried from one turn to the next, is refused by name when the template is compiled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import json_string

TAG = re.compile(r"\{%([-+]?)(.*?)(-?)%\}|\{\{(-?)(.*?)(-?)\}\}|\{#(-?).*?(-?)#\}", re.S)
TEST = re.compile(r"((?:[\w.]|\[[^\]]*\])+)\s+is\s+(not\s+)?(defined|undefined|none|string|true|false)\b")
#: Texts, which stay as they are, and what is written otherwise than in Python.
WORD = re.compile(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|~|\||\b(true|false|none)\b""", re.S)
#: Operators that are written otherwise; a filter binds as strongly as a power does in Python.
OPERATORS = {"~": "+", "|": "**"}
BLANKS = " \t\n\r\x0b\x0c"


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    """What an expression is: known (a Python value), or a column that is a text, flag, number, message or list of messages.

    A text may be null, which stands for one that is false or none.
    """

    kind: str
    of: object

    @property
    def known(self) -> bool:
        return self.kind == "known"

    def text(self) -> Column:
        if self.known:
            return F.lit("" if self.of is None else str(self.of))
        if self.kind not in ("text", "number"):
            raise TemplateError(f"a {self.kind} has no text")
        return F.coalesce(self.of.cast("string"), F.lit(""))

    def flag(self) -> Column | bool:
        """Whether it counts as true; a bool if that is known."""
        if self.known:
            return bool(self.of)
        return {"text": F.coalesce(F.length(self.of) > 0, F.lit(False)), "flag": self.of, "number": self.of != 0, "list": F.size(self.of) > 0}[self.kind] if self.kind != "message" else self.of.isNotNull()

    def column(self) -> Column:
        return F.lit(self.of) if self.known else self.of


def known(x) -> Value:
    return Value("known", x)


def either(flag: Column, a: Value | None, b: Value | None) -> Value:
    """a where the flag holds, else b; false, none and undefined texts are null."""
    a, b = a or known(None), b or known(None)
    if a is b or a.known and b.known and a.of == b.of and type(a.of) is type(b.of):
        return a
    kinds = {x.kind for x in (a, b) if not x.known} or {"text"}
    if len(kinds) > 1:
        raise TemplateError(f"a value is a {' or a '.join(sorted(kinds))}, as rows differ")
    first, second = (None if x.known and (x.of is None or x.of is False) else x.column() for x in (a, b))
    if a.known and b.known and isinstance(a.of, bool) and isinstance(b.of, bool):
        return Value("flag", F.when(flag, F.lit(a.of)).otherwise(F.lit(b.of)))
    out = F.when(flag, F.lit(None) if first is None else first)
    return Value(kinds.pop(), out if second is None else out.otherwise(second))


def negated(flag: Column | bool) -> Column | bool:
    return ~flag if isinstance(flag, Column) else not flag


def stripped(text: Value) -> Value:
    return known(text.of.strip(BLANKS)) if text.known else Value("text", F.btrim(text.of, F.lit(BLANKS)))


def _tojson(x: Value) -> Value:
    return Value("text", json_string(x.text()))


#: Filters, which are also methods of texts where a method has that name.
FILTERS: dict[str, Callable[..., Value]] = {
    "trim": stripped, "strip": stripped, "tojson": _tojson,
    "lower": lambda x: Value("text", F.lower(x.text())), "upper": lambda x: Value("text", F.upper(x.text())),
    "string": lambda x: Value("text", x.text()),
    "length": lambda x: known(len(x.of)) if x.known else Value("number", F.size(x.of) if x.kind == "list" else F.length(x.of)),
    "replace": lambda x, a, b: Value("text", F.replace(x.text(), a.column(), b.column())),
    "default": lambda x, y: y if x.known and x.of is None else x,
    "startswith": lambda x, y: Value("flag", F.startswith(x.text(), y.text())), "endswith": lambda x, y: Value("flag", F.endswith(x.text(), y.text())),
}
FILTERS["count"] = FILTERS["length"]


@dataclass(frozen=True)
class Scope:
    """The names that an expression may use; `date` is what strftime_now says."""

    names: dict[str, Value]
    date: datetime | None = None
    fields: tuple[str, ...] = ("role", "content")

    def with_names(self, **more: Value) -> Scope:
        return replace(self, names=self.names | more)

    def value(self, source: str) -> Value:
        prepared = TEST.sub(lambda m: f"({'not ' if m[2] else ''}_is_{m[3]}({m[1]}))", source.strip())
        prepared = WORD.sub(lambda m: OPERATORS.get(m[0]) or (m[0].capitalize() if m[1] else m[0]), prepared)
        try:
            tree = ast.parse(prepared, mode="eval").body
        except SyntaxError as error:
            raise TemplateError(f"not understood: {source.strip()}") from error
        return self.node(tree)

    def node(self, x: ast.AST) -> Value:
        found = getattr(self, f"_{type(x).__name__.lower()}", None)
        if found is None:
            raise TemplateError(f"not understood: {ast.unparse(x)}")
        return found(x)

    def _constant(self, x: ast.Constant) -> Value:
        return known(x.value)

    def _name(self, x: ast.Name) -> Value:
        return self.names.get(x.id, known(None))

    def _field(self, of: Value, name: str) -> Value:
        if of.kind == "message":
            return Value("text", of.of[name]) if name in self.fields else known(None)
        if of.known and isinstance(of.of, dict):
            return of.of.get(name, known(None))
        if of.known and of.of is None:
            return of
        raise TemplateError(f"no field {name} of a {of.kind}")

    def _attribute(self, x: ast.Attribute) -> Value:
        return self._field(self.node(x.value), x.attr)

    def _subscript(self, x: ast.Subscript) -> Value:
        of = self.node(x.value)
        if isinstance(x.slice, ast.Slice):
            first = self.node(x.slice.lower).of if x.slice.lower else 0
            if of.kind != "list" or x.slice.upper or x.slice.step or not isinstance(first, int) or first < 0:
                raise TemplateError(f"not understood: {ast.unparse(x)}")
            return Value("list", F.slice(of.of, F.lit(first + 1), F.greatest(F.size(of.of) - first, F.lit(0))))
        key = self.node(x.slice)
        if of.kind == "list" and key.known and isinstance(key.of, int):
            return Value("message", F.try_element_at(of.of, F.lit(key.of + 1 if key.of >= 0 else key.of)))
        if key.known and isinstance(key.of, str):
            return self._field(of, key.of)
        raise TemplateError(f"not understood: {ast.unparse(x)}")

    def _boolop(self, x: ast.BoolOp) -> Value:
        both, out = isinstance(x.op, ast.And), None
        for part in x.values:
            flag = self.node(part).flag()
            if isinstance(flag, bool):
                if flag != both:
                    return known(not both)
                continue
            out = flag if out is None else out & flag if both else out | flag
        return known(both) if out is None else Value("flag", out)

    def _unaryop(self, x: ast.UnaryOp) -> Value:
        of = self.node(x.operand)
        if isinstance(x.op, ast.USub) and of.known:
            return known(-of.of)
        if not isinstance(x.op, ast.Not):
            raise TemplateError(f"not understood: {ast.unparse(x)}")
        flag = negated(of.flag())
        return known(flag) if isinstance(flag, bool) else Value("flag", flag)

    def _binop(self, x: ast.BinOp) -> Value:
        if isinstance(x.op, ast.Pow):
            return self._filtered(x)
        a, b = self.node(x.left), self.node(x.right)
        numbers = all(v.kind == "number" or v.known and isinstance(v.of, int) for v in (a, b))
        if isinstance(x.op, ast.Add) and not numbers:
            return known(str(a.of) + str(b.of)) if a.known and b.known else Value("text", F.concat(a.text(), b.text()))
        if not numbers or not isinstance(x.op, ast.Add | ast.Sub | ast.Mod):
            raise TemplateError(f"not understood: {ast.unparse(x)}")
        of = {ast.Add: lambda p, q: p + q, ast.Sub: lambda p, q: p - q, ast.Mod: lambda p, q: p % q}[type(x.op)]
        return known(of(a.of, b.of)) if a.known and b.known else Value("number", of(a.column(), b.column()))

    def _filtered(self, x: ast.BinOp) -> Value:
        """A value and the filters after it, which as powers lie within each other from the right."""
        out, rest = self.node(x.left), x.right
        while rest is not None:
            step, rest = (rest.left, rest.right) if isinstance(rest, ast.BinOp) and isinstance(rest.op, ast.Pow) else (rest, None)
            called = step if isinstance(step, ast.Call) else ast.Call(step, [], [])
            if not isinstance(called.func, ast.Name):
                raise TemplateError(f"not understood: {ast.unparse(x)}")
            out = self._applied(called.func.id, out, [self.node(a) for a in called.args])
        return out

    def _compare(self, x: ast.Compare) -> Value:
        if len(x.ops) != 1:
            raise TemplateError(f"not understood: {ast.unparse(x)}")
        op, a = type(x.ops[0]), self.node(x.left)
        if op in (ast.In, ast.NotIn):
            return self._within(op is ast.In, a, x.comparators[0])
        b = self.node(x.comparators[0])
        if op not in (ast.Eq, ast.NotEq):
            if op in (ast.Is, ast.IsNot):
                raise TemplateError(f"not understood: {ast.unparse(x)}")
            of = {ast.Lt: lambda p, q: p < q, ast.LtE: lambda p, q: p <= q, ast.Gt: lambda p, q: p > q, ast.GtE: lambda p, q: p >= q}[op]
            return known(of(a.of, b.of)) if a.known and b.known else Value("flag", of(a.column(), b.column()))
        if a.known and b.known:
            return known((a.of == b.of) == (op is ast.Eq))
        a, b = (b, a) if a.known else (a, b)
        if b.known and (b.of is None or b.of is False):  # a text that may be false, or a field that may be missing
            equal = ~a.of if a.kind == "flag" else a.of.isNull()
        else:
            equal = a.of.eqNullSafe(b.column())
        return Value("flag", equal if op is ast.Eq else ~equal)

    def _within(self, wanted: bool, a: Value, of: ast.AST) -> Value:
        if isinstance(of, ast.List | ast.Tuple):
            held = [self.node(e) for e in of.elts]
            found = F.coalesce(a.column().isin([v.of for v in held]), F.lit(False))
            return known((a.of in [v.of for v in held]) == wanted) if a.known else Value("flag", found if wanted else ~found)
        b = self.node(of)
        if b.kind == "message" and a.known:
            return known((a.of in self.fields) == wanted)
        if b.known and not isinstance(b.of, str):
            return known(not wanted)
        found = F.contains(b.text(), a.text())
        return Value("flag", found if wanted else ~found)

    def _ifexp(self, x: ast.IfExp) -> Value:
        flag = self.node(x.test).flag()
        if isinstance(flag, bool):
            return self.node(x.body if flag else x.orelse)
        return either(flag, self.node(x.body), self.node(x.orelse))

    def _call(self, x: ast.Call) -> Value:
        given = [self.node(a) for a in x.args]
        if isinstance(x.func, ast.Attribute):
            return self._applied(x.func.attr, self.node(x.func.value), given)
        name = x.func.id if isinstance(x.func, ast.Name) else ""
        if name == "raise_exception":
            return Value("text", F.raise_error(given[0].text()).cast("string"))
        if name == "strftime_now" and self.date:
            return known(self.date.strftime(given[0].of))
        if name.startswith("_is_"):
            return self._tested(name[4:], given[0])
        raise TemplateError(f"no function {ast.unparse(x.func)}")

    def _tested(self, test: str, of: Value) -> Value:
        if of.known:
            return known({"defined": of.of is not None, "undefined": of.of is None, "none": of.of is None, "string": isinstance(of.of, str), "true": of.of is True, "false": of.of is False}[test])
        if test == "string":
            return known(of.kind == "text")
        if test in ("true", "false"):
            return known(False) if of.kind != "flag" else Value("flag", of.of if test == "true" else ~of.of)
        return Value("flag", of.of.isNotNull() if test == "defined" else of.of.isNull())

    def _applied(self, name: str, of: Value, given: list[Value]) -> Value:
        if name not in FILTERS:
            raise TemplateError(f"no filter {name}")
        return FILTERS[name](of, *given)


def pieces(template: str) -> list[tuple[str, str]]:
    """(text, expression or statement, its source) in order. A newline after a tag and the blanks before one at the start of a line go, and all blanks on the side of a dash."""
    out: list[tuple[str, str]] = []
    at, strip = 0, None
    for m in [*TAG.finditer(template), None]:
        text = template[at : m.start() if m else len(template)]
        if strip == "all":
            text = text.lstrip(BLANKS)
        elif strip == "line":
            text = text.removeprefix("\n")
        if m and (m[1] == "-" or m[4] == "-" or m[7] == "-"):
            text = text.rstrip(BLANKS)
        elif m and m[5] is None and m[1] != "+":
            start = text.rfind("\n") + 1
            if not text[start:].strip(" \t") and (start or not at):
                text = text[:start]
        if text:
            out.append(("text", text))
        if m:
            at = m.end()
            strip = "all" if "-" in (m[3], m[6], m[8]) else None if m[5] is not None else "line"
            if m[5] is not None:
                out.append(("expression", m[5]))
            elif m[2] is not None:
                out.append(("statement", m[2].strip()))
    return out


class Body:
    """Renders a list of pieces: from a place to the statement that ends it."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.parts, self.at = parts, 0

    def until(self, *ends: str) -> tuple[list, str]:
        """The nodes up to a statement that begins with one of the words, and that statement."""
        nodes: list = []
        while self.at < len(self.parts):
            kind, source = self.parts[self.at]
            self.at += 1
            word = source.split(None, 1)[0] if kind == "statement" and source else ""
            if kind != "statement":
                nodes.append((kind, source))
            elif word in ends:
                return nodes, source
            elif word == "for":
                inner, _ = self.until("endfor")
                name, _, over = source[3:].partition(" in ")
                nodes.append(("for", name.strip(), over, inner))
            elif word == "if":
                nodes.append(self.branches(source[2:]))
            elif word == "set" and re.match(r"set\s+\w+\s*=", source):
                name, _, value = source[3:].partition("=")
                nodes.append(("set", name.strip(), value))
            elif word not in ("generation", "endgeneration"):
                raise TemplateError(f"not understood: {source}")
        if ends:
            raise TemplateError(f"no {ends[0]}")
        return nodes, ""

    def branches(self, test: str) -> tuple:
        then, end = self.until("elif", "else", "endif")
        if end.startswith("elif"):
            return "if", test, then, [self.branches(end[4:])]
        other = self.until("endif")[0] if end.startswith("else") else []
        return "if", test, then, other


def rendered(nodes: list, scope: Scope) -> tuple[list[Column], Scope]:
    """The texts of the nodes, and the scope after them."""
    out: list[Column] = []
    for node in nodes:
        if node[0] == "text":
            out.append(F.lit(node[1]))
        elif node[0] == "expression":
            out.append(scope.value(node[1]).text())
        elif node[0] == "set":
            scope = scope.with_names(**{node[1]: scope.value(node[2])})
        elif node[0] == "if":
            flag = scope.value(node[1]).flag()
            if isinstance(flag, bool):
                texts, scope = rendered(node[2] if flag else node[3], scope)
                out += texts
                continue
            (a, after_a), (b, after_b) = rendered(node[2], scope), rendered(node[3], scope)
            if a or b:
                out.append(F.when(flag, joined(a)).otherwise(joined(b)))
            changed = {n for n in after_a.names | after_b.names if after_a.names.get(n) is not scope.names.get(n) or after_b.names.get(n) is not scope.names.get(n)}
            scope = scope.with_names(**{n: either(flag, after_a.names.get(n), after_b.names.get(n)) for n in sorted(changed)})
        else:
            out.append(looped(node, scope))
    return out, scope


def looped(node: tuple, scope: Scope) -> Column:
    over = scope.value(node[2])
    if over.known and not over.of:
        return F.lit("")
    if over.kind != "list":
        raise TemplateError(f"no list to loop over: {node[2].strip()}")

    def turn(message: Column, i: Column) -> Column:
        place = {"index0": Value("number", i), "index": Value("number", i + 1), "first": Value("flag", i == 0), "last": Value("flag", i == F.size(over.of) - 1), "length": Value("number", F.size(over.of))}
        return joined(rendered(node[3], scope.with_names(**{node[1]: Value("message", message), "loop": known(place)}))[0])

    return F.array_join(F.transform(over.of, turn), "")


def joined(texts: list[Column]) -> Column:
    return F.concat(*texts) if texts else F.lit("")


def compiled(template: str, messages: Column, *, bos_token: str = "", eos_token: str = "", add_generation_prompt: bool = True, date: str | None = None, **names) -> Column:
    """The prompt of a column of messages (an array of role and content). date: the day that a template that asks for today gets; names: further values that a template asks for, such as enable_thinking=False."""
    given = {"bos_token": bos_token, "eos_token": eos_token, "add_generation_prompt": add_generation_prompt} | names
    scope = Scope({k: known(v) for k, v in given.items()} | {"messages": Value("list", messages)}, datetime.strptime(date, "%Y-%m-%d") if date else None)
    nodes, _ = Body(pieces(template)).until()
    return joined(rendered(nodes, scope)[0])
