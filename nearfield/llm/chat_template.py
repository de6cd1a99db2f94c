"""A sandboxed template language for chat formatting, compiled to Python closures.

Text is literal except for

* ``{{ expression }}``: writes a value;
* ``{% for name in expression %} ... {% endfor %}``, with ``loop.index0``,
  ``loop.index``, ``loop.first`` and ``loop.last``;
* ``{% if e %} ... {% elif e %} ... {% else %} ... {% endif %}``;
* ``{% set name = expression %}``;
* ``{% generation %} ... {% endgeneration %}``: what is written inside belongs
  to the loss mask;
* ``{# remark #}``.

Expressions have string and integer literals, ``true``, ``false``, ``none``,
names, ``a.b`` and ``a['b']`` (keys of mappings only, never attributes of
objects), the filters of ``FILTERS`` by ``|``, ``~`` and ``+``, comparisons,
``in``, ``not``, ``and``, ``or`` and ``x if c else y``. There are no calls, so a
template can reach nothing but its variables. ``compile_template`` parses a
template to a tree, folds what is constant and turns the tree into closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

ESCAPE, CONTROL = "\\", "<|"


def escape_control(text: str) -> str:
    """``text`` without any control string: a backslash goes between ``<`` and ``|``, and before each backslash."""
    return text.replace(ESCAPE, ESCAPE * 2).replace(CONTROL, "<" + ESCAPE + "|")


def escape_line(text: str) -> str:
    """As ``escape_control``, in one line."""
    return escape_control(text).replace("\n", ESCAPE + "n")


def unescape(text: str, line: bool = False) -> str:
    """The inverse of ``escape_control``, or of ``escape_line``."""
    return re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], text, flags=re.S) if ESCAPE in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "control": lambda x: escape_control(_text(x)),
    "line": lambda x: escape_line(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
}


class TemplateError(ValueError):
    """The template isn't in the language, or a value doesn't suit an operation."""


def _text(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


# --- tree -----------------------------------------------------------------


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Get:
    of: Any
    key: Any


@dataclass
class Apply:
    """An operator or filter over its arguments."""

    op: str
    args: list


@dataclass
class Write:
    value: Any


@dataclass
class Loop:
    name: str
    over: Any
    body: list


@dataclass
class Branch:
    cases: list[tuple[Any, list]]
    otherwise: list = field(default_factory=list)


@dataclass
class Assign:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: a % b if isinstance(a, int) else _refuse("% needs integers"),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
LEVELS = [["==", "!=", "<", "<=", ">", ">=", "in"], ["~"], ["+", "-"], ["%"]]
TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>|~+\-%.\[\]()=]))""")


def _refuse(why: str) -> Any:
    raise TemplateError(why)


class Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at) or _refuse(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind != "string" else None

    def take(self, *values: str) -> str | None:
        if self.peek() in values and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        self.take(value) or _refuse(f"{value!r} expected, not {self.peek()!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            _refuse(f"a name expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        out = self.choice()
        return out if self.at == len(self.tokens) else _refuse(f"unexpected {self.tokens[self.at][1]!r}")

    def choice(self) -> Any:
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Apply("choice", [test, out, self.choice()])
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Apply("or", [out, self.both()])
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Apply("and", [out, self.negated()])
        return out

    def negated(self) -> Any:
        return Apply("not", [self.negated()]) if self.take("not") else self.level(0)

    def level(self, n: int) -> Any:
        if n == len(LEVELS):
            return self.filtered()
        out = self.level(n + 1)
        while op := self.take(*LEVELS[n]):
            out = Apply(op, [out, self.level(n + 1)])
        return out

    def filtered(self) -> Any:
        out = self.single()
        while True:
            if self.take("."):
                out = Get(out, Const(self.name()))
            elif self.take("["):
                out = Get(out, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                out = Apply("|" + name, [out]) if name in FILTERS else _refuse(f"no filter {name!r}")
            else:
                return out

    def single(self) -> Any:
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[value]) if value in fixed else Name(value)
        return _refuse(f"a value expected, not {value!r}")


def parse(source: str) -> list:
    """The tree of a template: a list of nodes."""
    root: list = []
    opened: list[tuple[str, Any, list]] = [("", None, root)]
    at = 0
    for m in re.finditer(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", source, re.S):
        if m.start() > at:
            opened[-1][2].append(Write(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            opened[-1][2].append(Write(Expression(m[1]).whole()))
        elif m[2] is not None:
            _statement(m[2].strip(), opened)
    if len(opened) > 1:
        _refuse(f"{opened[-1][0]} isn't closed")
    if at < len(source):
        root.append(Write(Const(source[at:])))
    return root


def _statement(source: str, opened: list[tuple[str, Any, list]]) -> None:
    word, _, rest = source.partition(" ")
    kind, node, body = opened[-1]
    if word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S) or _refuse(f"for {rest!r}")
        new: Any = Loop(m[1], Expression(m[2]).whole(), [])
        body.append(new)
        opened.append((word, new, new.body))
    elif word == "if":
        new = Branch([(Expression(rest).whole(), [])])
        body.append(new)
        opened.append((word, new, new.cases[0][1]))
    elif word in ("elif", "else") and kind == "if":
        opened.pop()
        if word == "elif":
            node.cases.append((Expression(rest).whole(), []))
        opened.append((kind if word == "elif" else "if's else", node, node.cases[-1][1] if word == "elif" else node.otherwise))
    elif word == "generation":
        new = Generation([])
        body.append(new)
        opened.append((word, new, new.body))
    elif word == "set":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S) or _refuse(f"set {rest!r}")
        body.append(Assign(m[1], Expression(m[2]).whole()))
    elif word in ("endfor", "endif", "endgeneration") and kind.partition("'")[0] == word[3:]:
        opened.pop()
    else:
        _refuse(f"unexpected {{% {source} %}}")


# --- constant folding -----------------------------------------------------


def fold(node: Any) -> Any:
    """An expression with its constant parts evaluated."""
    if isinstance(node, Get):
        return Get(fold(node.of), fold(node.key))
    if isinstance(node, Apply):
        args = [fold(x) for x in node.args]
        if node.op in ("and", "or", "choice") and isinstance(args[0], Const):
            if node.op == "choice":
                return args[1] if args[0].value else args[2]
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if all(isinstance(x, Const) for x in args):
            return Const(expression(Apply(node.op, args))({}))
        return Apply(node.op, args)
    return node


def fold_block(nodes: list) -> list:
    """A block with constants folded, dead branches left out and neighbouring literals joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Write):
            value = fold(node.value)
            if isinstance(value, Const):
                value = Const(_text(value.value))
                if not value.value:
                    continue
            out.append(Write(value))
        elif isinstance(node, Loop):
            out.append(Loop(node.name, fold(node.over), fold_block(node.body)))
        elif isinstance(node, Generation):
            out.append(Generation(fold_block(node.body)))
        elif isinstance(node, Assign):
            out.append(Assign(node.name, fold(node.value)))
        else:
            cases, otherwise = [], node.otherwise
            for test, body in node.cases:
                test = fold(test)
                if isinstance(test, Const):
                    if test.value:
                        otherwise = body
                        break
                    continue
                cases.append((test, fold_block(body)))
            out += [Branch(cases, fold_block(otherwise))] if cases else fold_block(otherwise)
    return _joined(out)


def _joined(nodes: list) -> list:
    out: list = []
    for node in nodes:
        if out and all(isinstance(x, Write) and isinstance(x.value, Const) for x in (out[-1], node)):
            out[-1] = Write(Const(out[-1].value.value + node.value.value))
        else:
            out.append(node)
    return out


# --- closures -------------------------------------------------------------

Piece = tuple[str, bool]


def expression(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope[name] if name in scope else _refuse(f"{name!r} isn't defined")
    if isinstance(node, Get):
        of, key = expression(node.of), expression(node.key)
        return lambda scope: _item(of(scope), key(scope))
    args = [expression(x) for x in node.args]
    if node.op.startswith("|"):
        f, (a,) = FILTERS[node.op[1:]], args
        return lambda scope: f(a(scope))
    if node.op == "not":
        (a,) = args
        return lambda scope: not a(scope)
    if node.op == "choice":
        test, a, b = args
        return lambda scope: a(scope) if test(scope) else b(scope)
    a, b = args
    if node.op == "and":
        return lambda scope: a(scope) and b(scope)
    if node.op == "or":
        return lambda scope: a(scope) or b(scope)
    g, op = BINARY[node.op], node.op

    def binary(scope: dict) -> Any:
        try:
            return g(a(scope), b(scope))
        except TypeError as e:
            raise TemplateError(f"{op}: {e}") from e

    return binary


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of[key] if key in of else _refuse(f"no key {key!r}")
    return of[key] if isinstance(of, (list, tuple, str)) and isinstance(key, int) else _refuse(f"no item {key!r}")


def block(nodes: list, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    """A generator function that writes the block's pieces, each with whether it is in the loss mask."""
    steps = [statement(x, loss) for x in nodes]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def statement(node: Any, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            fixed = [(node.value.value, loss)]
            return lambda scope: fixed
        value = expression(node.value)
        return lambda scope: [(_text(value(scope)), loss)]
    if isinstance(node, Generation):
        return block(node.body, True)
    if isinstance(node, Assign):
        name, value = node.name, expression(node.value)

        def assign(scope: dict) -> tuple:
            scope[name] = value(scope)
            return ()

        return assign
    if isinstance(node, Branch):
        cases, otherwise = [(expression(t), block(b, loss)) for t, b in node.cases], block(node.otherwise, loss)
        return lambda scope: next((b for t, b in cases if t(scope)), otherwise)(scope)
    over, body, name = expression(node.over), block(node.body, loss), node.name

    def loop(scope: dict) -> Iterator[Piece]:
        outer, items, i = {k: scope[k] for k in (name, "loop") if k in scope}, iter(over(scope)), 0
        ahead = next(items, items)
        while ahead is not items:  # one item ahead, so that a stream of turns need not be held
            scope[name], ahead = ahead, next(items, items)
            scope["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": ahead is items}
            yield from body(scope)
            i += 1
        for k in (name, "loop"):
            scope.pop(k, None)
        scope.update(outer)

    return loop


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """``render(**variables)`` of a template; it yields pieces of text and whether each is in the loss mask."""
    run = block(fold_block(parse(source)), False)
    return lambda **variables: (p for p in run(variables) if p[0])


def render(source: str, messages: Iterable[dict], **variables: Any) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans of its loss mask (code points, ends exclusive)."""
    out, spans, at = [], [], 0
    for piece, loss in compile_template(source)(messages=messages, **variables):
        if loss:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(piece))
            else:
                spans.append((at, at + len(piece)))
        out.append(piece)
        at += len(piece)
    return "".join(out), spans
