"""Tokens and a precedence parser.

From loosest: pipe, alternative //, or, and, comparison, + -, * / %, postfix.
Operators of one level associate to the left.
"""

from __future__ import annotations

import json
import re

from . import tree as T

#: Deepest nesting of an expression.
MAX_DEPTH = 100

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>//|==|!=|>=|<=|\.\.|[.\[\](){}|,:+\-*/%<>?$@;=]))""")

#: Names that other languages of this family have and this one refuses, with what to write instead.
REFUSED = {
    "reduce": "aggregate with add, min, max or length over a slurped stream",
    "foreach": "aggregate over a slurped stream",
    "def": "functions cannot be defined",
    "import": "modules cannot be imported",
    "include": "modules cannot be included",
    "limit": "use head, or a slice of a slurped stream",
    "recurse": "recursion is not part of the language",
    "walk": "recursion is not part of the language",
    "paths": "path functions are not part of the language",
    "getpath": "path functions are not part of the language",
    "setpath": "use edit",
    "input": "the stream is the input",
    "inputs": "the stream is the input",
    "debug": "debug is not part of the language",
    "try": "wrong types give no value, so nothing is thrown",
    "catch": "wrong types give no value, so nothing is thrown",
    "label": "labels are not part of the language",
}

STRING_FUNCTIONS = {"split", "join", "startswith", "endswith", "contains", "ltrimstr", "rtrimstr", "has", "test"}
BY_FUNCTIONS = {"group_by", "sort_by", "unique_by", "min_by", "max_by"}


class ExpressionError(ValueError):
    """An expression that cannot be read, with the place."""


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        if not text[at:].strip():
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character {text[at:].strip()[:1]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "", len(text))]


class _Parser:
    def __init__(self, text: str):
        self.items, self.at, self.depth = tokens(text), 0, 0

    def peek(self, *values: str) -> bool:
        kind, value, _ = self.items[self.at]
        return kind in ("op", "name") and value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}")

    def fail(self, what: str):
        kind, value, at = self.items[self.at]
        raise ExpressionError(f"{what} but found {value or 'the end'!r} at {at}")

    def pipe(self) -> T.Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ExpressionError(f"nested more than {MAX_DEPTH} deep")
        node = self.alternative()
        while self.take("|"):
            node = T.Pipe(node, self.alternative())
        self.depth -= 1
        return node

    def alternative(self) -> T.Node:
        node = self.either()
        return T.Binary("//", node, self.alternative()) if self.take("//") else node

    def _level(self, ops: tuple[str, ...], below) -> T.Node:
        node = below()
        while op := self.take(*ops):
            node = T.Binary(op, node, below())
        return node

    def either(self) -> T.Node:
        return self._level(("or",), self.both)

    def both(self) -> T.Node:
        return self._level(("and",), self.comparison)

    def comparison(self) -> T.Node:
        if self.peek("not") and self.items[self.at + 1][1] not in ("|", ")", "]", "}", ",", "", "and", "or", "then", "else", "end"):
            self.at += 1
            return T.Not(self.comparison())
        node = self.sum()
        if op := self.take("==", "!=", ">=", "<=", ">", "<"):
            node = T.Binary(op, node, self.sum())
        return node

    def sum(self) -> T.Node:
        return self._level(("+", "-"), self.product)

    def product(self) -> T.Node:
        return self._level(("*", "/", "%"), self.postfix)

    def postfix(self) -> T.Node:
        node = self.primary()
        while True:
            if self.peek(".") and self.items[self.at + 1][0] in ("name", "str"):
                self.at += 1
                node = T.Field(node, self.key())
            elif self.peek(".") and self.items[self.at + 1][1] == "[":
                self.at += 1
            elif self.take("["):
                node = self.bracket(node)
            elif self.take("?"):
                pass  # access never fails, so the mark changes nothing
            else:
                return node

    def key(self) -> str:
        kind, value, _ = self.items[self.at]
        self.at += 1
        return json.loads(value) if kind == "str" else value

    def integer(self) -> int | None:
        minus = self.take("-")
        kind, value, _ = self.items[self.at]
        if kind == "num" and value.isdigit():
            self.at += 1
            return -int(value) if minus else int(value)
        return self.fail("expected a number") if minus else None

    def bracket(self, base: T.Node) -> T.Node:
        if self.take("]"):
            return T.Iterate(base)
        if self.items[self.at][0] == "str":
            node = T.Field(base, self.key())
            self.need("]")
            return node
        start = self.integer()
        if self.take(":"):
            node = T.Slice(base, start, self.integer())
        elif start is None:
            self.fail("expected an index")
        else:
            node = T.Index(base, start)
        self.need("]")
        return node

    def primary(self) -> T.Node:
        kind, value, at = self.items[self.at]
        if kind == "num":
            self.at += 1
            return T.Literal(int(value) if value.isdigit() else float(value))
        if kind == "str":
            self.at += 1
            return T.Literal(json.loads(value))
        if self.take("-"):
            inner = self.postfix()
            return T.Literal(-inner.value) if isinstance(inner, T.Literal) else T.Call("negate_of", (inner,))
        if self.take("("):
            node = self.pipe()
            self.need(")")
            return node
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.pipe())
                if not self.take(",") and not self.peek("]"):
                    self.fail("expected ',' or ']'")
            return T.Array(tuple(items))
        if self.take("{"):
            return self.object()
        if self.take("."):
            kind = self.items[self.at][0]
            if kind in ("name", "str") and self.items[self.at][2] == at + 1:
                return T.Field(T.Identity(), self.key())
            return T.Identity()
        if value in ("$", "@", "..", ";"):
            raise ExpressionError(f"{value!r} at {at}: variables, formats and recursion are not part of the language")
        if kind == "name":
            return self.word()
        return self.fail("expected an expression")

    def object(self) -> T.Node:
        fields: list[tuple[str | T.Node, T.Node]] = []
        while not self.take("}"):
            kind, value, _ = self.items[self.at]
            if self.take("("):
                key: str | T.Node = self.pipe()
                self.need(")")
                self.need(":")
                fields.append((key, self.alternative()))
            elif kind in ("name", "str"):
                key = self.key()
                fields.append((key, self.entry() if self.take(":") else T.Field(T.Identity(), key)))
            else:
                self.fail("expected a key")
            if not self.take(",") and not self.peek("}"):
                self.fail("expected ',' or '}'")
        return T.Object(tuple(fields))

    def entry(self) -> T.Node:
        """A field's value: pipes are allowed, as a comma or brace ends it."""
        return self.pipe()

    def word(self) -> T.Node:
        name = self.key()
        if name in REFUSED:
            raise ExpressionError(f"{name!r} is not supported: {REFUSED[name]}")
        if name in ("true", "false", "null"):
            return T.Literal({"true": True, "false": False, "null": None}[name])
        if name == "if":
            test = self.pipe()
            self.need("then")
            then = self.pipe()
            if self.take("elif"):
                self.at -= 1
                kind, _, at = self.items[self.at]
                self.items[self.at] = (kind, "if", at)
                return T.If(test, then, self.primary())
            self.need("else")
            other = self.pipe()
            self.need("end")
            return T.If(test, then, other)
        if self.take("("):
            args = [self.pipe()]
            while self.take(","):
                args.append(self.pipe())
            self.need(")")
            if name in STRING_FUNCTIONS and not (len(args) == 1 and isinstance(args[0], T.Literal) and (isinstance(args[0].value, str) or name == "has")):
                raise ExpressionError(f"{name}() takes one string literal")
            if name == "split" and args[0].value == "":
                raise ExpressionError("split() by an empty string has no meaning")
            return T.Call(name, tuple(args))
        return T.Call(name)


def parse(text: str) -> T.Node:
    """The tree of an expression; ExpressionError says what is wrong and where."""
    p = _Parser(text)
    try:
        node = p.pipe()
    except RecursionError:
        raise ExpressionError(f"nested more than {MAX_DEPTH} deep") from None
    if p.items[p.at][0] != "end":
        p.fail("expected the end")
    return node
