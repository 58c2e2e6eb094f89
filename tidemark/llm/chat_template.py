"""A compiler for chat templates: source, syntax tree, folded tree, Python closures.

The language: {{ expression }}, {% for x in expression %}, {% if %} / {% elif %} / {% else %}, {% set x = expression %}, {% generation %}
(what a model is to learn), each block closed by its end tag; a dash inside a tag takes the white space beside it. Expressions: strings,
integers, true, false, none, names, a.b, a['b'], a[0], ==, !=, and, or, not, in, +, ~, and filters a | f from `FILTERS`.

It is a sandbox: names and fields are looked up in the given dicts and lists alone, never as attributes of Python objects; there are no
calls but filters, and a loop runs over a given list. What is not in the language is a TemplateError when the template is compiled.
A null field prints as an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|.\[\]()+~]))")


class TemplateError(ValueError):
    pass


def escaped(text: str) -> str:
    """No `<|` is left: each gets a backslash between, and so does one that has backslashes between already."""
    return CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def line_escaped(text: str) -> str:
    """As `escaped`, and in one line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\p")


def line_unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "n": "\n", "p": "|"}[m[1]], text)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda x: escaped(_text(x)), "escape_line": lambda x: line_escaped(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x or "")}


# The syntax tree. A node is a dataclass; bodies are tuples of nodes.


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: b is not None and a in b, "not": lambda a: not a, "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in signs

    def take(self, *signs: str) -> str | None:
        if not self.peek(*signs):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is out of place")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.joined()
        while sign := self.take("==", "!=", "in"):
            out = Op(sign, (out, self.joined()))
        return out

    def joined(self) -> Any:
        out = self.filtered()
        while sign := self.take("+", "~"):
            out = Op(sign, (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.field()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Op(name, (out,))
        return out

    def field(self) -> Any:
        out = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                out = Field(out, Const(self.name()))
            else:
                out = Field(out, self.either())
                self.need("]")
        return out

    def atom(self) -> Any:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(token))
        if kind == "name" and token not in ("and", "or", "not", "in"):
            return Const({"true": True, "false": False, "none": None}[token]) if token in ("true", "false", "none") else Name(token)
        raise TemplateError(f"{token!r} is out of place")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, eat = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if eat else text
        text = text.rstrip() if m[1] or m[4] else text
        pieces += [("text", text), ("print", m[2]) if m[2] is not None else ("tag", m[5].strip())]
        at, eat = m.end(), bool(m[3] or m[6])
    pieces.append(("text", source[at:].lstrip() if eat else source[at:]))
    body, left = _body(pieces, ())
    if left:
        raise TemplateError(f"{left[0][1]!r} closes nothing")
    return body


def _body(pieces: list[tuple[str, str]], ends: tuple[str, ...]) -> tuple[tuple, list]:
    """Nodes up to one of the tags `ends`, and what is left from that tag on."""
    out: list[Any] = []
    while pieces:
        (kind, text), rest = pieces[0], pieces[1:]
        word, _, args = text.partition(" ")
        if kind == "text":
            out.append(Print(Const(text)))
            pieces = rest
        elif kind == "print":
            out.append(Print(_Expression(text).whole()))
            pieces = rest
        elif word in ends:
            return tuple(out), pieces
        elif word == "if":
            made, pieces = _if(args, rest)
            out.append(made)
        elif word == "for":
            e = _Expression(args)
            name = e.name()
            e.need("in")
            over = e.whole()
            body, left = _body(rest, ("endfor",))
            pieces = left[1:]
            out.append(For(name, over, body))
        elif word == "generation":
            body, left = _body(rest, ("endgeneration",))
            pieces = left[1:]
            out.append(Generation(body))
        elif word == "set":
            name, sign, value = args.partition("=")
            if not sign or not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
                raise TemplateError(f"can't set {args!r}")
            out.append(Set(name.strip(), _Expression(value).whole()))
            pieces = rest
        else:
            raise TemplateError(f"no tag {text!r} here")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tuple(out), []


def _if(args: str, rest: list) -> tuple[If, list]:
    test = _Expression(args).whole()
    then, left = _body(rest, ("elif", "else", "endif"))
    word, _, more = left[0][1].partition(" ")
    if word == "elif":
        other, left = _if(more, left[1:])
        return If(test, then, (other,)), left
    if word == "else":
        other, left = _body(left[1:], ("endif",))
        return If(test, then, other), left[1:]
    return If(test, then, ()), left[1:]


def folded(x: Any) -> Any:
    """The tree with what is constant worked out: operations, branches, neighbouring texts, loops over nothing."""
    if isinstance(x, Op):
        args = tuple(map(folded, x.args))
        if x.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.sign == "and") else args[0]
        if x.sign not in ("and", "or") and all(isinstance(a, Const) for a in args):
            try:
                return Const({**OPS, **FILTERS}[x.sign](*[a.value for a in args]))
            except TypeError as wrong:
                raise TemplateError(str(wrong)) from wrong
        return Op(x.sign, args)
    if isinstance(x, Field):
        return Field(folded(x.of), folded(x.key))
    if isinstance(x, Print):
        value = folded(x.value)
        return Print(Const(_text(value.value)) if isinstance(value, Const) else value)
    if isinstance(x, Set):
        return Set(x.name, folded(x.value))
    return x


def folded_body(body: tuple) -> tuple:
    out: list[Any] = []
    for x in map(folded, body):
        if isinstance(x, If):
            test = folded(x.test)
            new = list(folded_body(x.then if test.value else x.other)) if isinstance(test, Const) else [If(test, folded_body(x.then), folded_body(x.other))]
        elif isinstance(x, For):
            over = folded(x.over)
            new = [] if isinstance(over, Const) and not over.value else [For(x.name, over, folded_body(x.body))]
        elif isinstance(x, Generation):
            new = [Generation(folded_body(x.body))]
        else:
            new = [x]
        for y in new:
            if isinstance(y, Print) and isinstance(y.value, Const):
                if not y.value.value:
                    continue
                if out and isinstance(out[-1], Print) and isinstance(out[-1].value, Const):
                    out[-1] = Print(Const(out[-1].value.value + y.value.value))
                    continue
            out.append(y)
    return tuple(out)


class Output:
    """Parts of a rendered text, and the ranges of code points under a generation tag."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)

    def text(self) -> str:
        return "".join(self.parts)


Scope = dict[str, Any]


def _value(x: Any) -> Callable[[Scope], Any]:
    """A closure that works an expression out."""
    if isinstance(x, Const):
        const = x.value
        return lambda scope: const
    if isinstance(x, Name):
        name = x.name
        return lambda scope: scope.get(name)
    if isinstance(x, Field):
        of, key = _value(x.of), _value(x.key)

        def field(scope: Scope) -> Any:
            a, k = of(scope), key(scope)
            if isinstance(a, Mapping):
                return a.get(k)
            return a[k] if isinstance(a, (list, tuple)) and isinstance(k, int) and k < len(a) else None

        return field
    args = [_value(a) for a in x.args]
    if x.sign == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if x.sign == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f = OPS.get(x.sign) or FILTERS[x.sign]
    if len(args) == 1:
        one = args[0]
        return lambda scope: f(one(scope))
    left, right = args
    return lambda scope: f(left(scope), right(scope))


Step = Callable[[Scope, Output], None]


def _steps(body: tuple) -> Step:
    """A closure that renders a body."""
    steps = [_step(x) for x in body]
    if len(steps) == 1:
        return steps[0]

    def run(scope: Scope, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(x: Any) -> Step:
    if isinstance(x, Print) and isinstance(x.value, Const):
        text = x.value.value
        return lambda scope, out: out.add(text)
    if isinstance(x, Print):
        value = _value(x.value)
        return lambda scope, out: out.add(_text(value(scope)))
    if isinstance(x, Set):
        name, value = x.name, _value(x.value)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if isinstance(x, If):
        test, then, other = _value(x.test), _steps(x.then), _steps(x.other)
        return lambda scope, out: then(scope, out) if test(scope) else other(scope, out)
    if isinstance(x, Generation):
        inner = _steps(x.body)

        def mark(scope: Scope, out: Output) -> None:
            start = out.at
            inner(scope, out)
            out.spans.append((start, out.at))

        return mark
    name, over, body = x.name, _value(x.over), _steps(x.body)

    def loop(scope: Scope, out: Output) -> None:
        items = over(scope) or ()
        for i, item in enumerate(items):
            body({**scope, name: item, "loop": loop_fields(i, len(items))}, out)

    return loop


def loop_fields(i: int, n: int) -> dict[str, Any]:
    return {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}


def _names(x: Any) -> set[str]:
    if isinstance(x, Name):
        return {x.name}
    if isinstance(x, tuple):
        return set().union(*map(_names, x)) if x else set()
    return set().union(*[_names(v) for v in vars(x).values()]) if hasattr(x, "__dataclass_fields__") and not isinstance(x, Const) else set()


class Template:
    """A compiled template: `render` for a whole conversation, `turn` for one message of it where the template allows that."""

    def __init__(self, source: str, over: str = "messages"):
        self.tree = folded_body(parse(source))
        self._all = _steps(self.tree)
        at = [i for i, x in enumerate(self.tree) if isinstance(x, For) and x.over == Name(over)]
        # each message can be rendered by itself if nothing outside the one loop looks at the messages, and nothing is carried between turns
        rest = () if not at else self.tree[: at[0]] + self.tree[at[0] + 1 :]
        self.by_turn = len(at) == 1 and over not in _names(rest) | _names(self.tree[at[0]].body) and not any(isinstance(x, Set) for x in self.tree)
        if self.by_turn:
            loop = self.tree[at[0]]
            self._name, self._head, self._body, self._tail = loop.name, _steps(self.tree[: at[0]]), _steps(loop.body), _steps(self.tree[at[0] + 1 :])

    def render(self, given: Scope) -> Output:
        out = Output()
        self._all(dict(given), out)
        return out

    def turn(self, message: Any, i: int, n: int, given: Scope) -> Output:
        """What message i of n adds to the rendered conversation, the parts before the first and after the last included."""
        out, scope = Output(), dict(given)
        if i == 0:
            self._head(scope, out)
        self._body({**scope, self._name: message, "loop": loop_fields(i, n)}, out)
        if i == n - 1:
            self._tail(scope, out)
        return out
