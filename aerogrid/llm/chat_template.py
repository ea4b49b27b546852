"""A small sandboxed template language for chat formats, compiled to Python closures.

    {{ expr }}                       output            {% set name = expr %}      a variable
    {% for m in messages %} ... {% endfor %}           loop.first, loop.last, loop.index0, loop.index
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}           text under the loss mask

Expressions have strings, whole numbers, true, false, none, names, `a.b`, `a['b']`, `==`, `!=`, `in`, `+`,
`and`, `or`, `not`, `x if c else y`, parentheses and the filters of FILTERS.  Nothing can be called and only keys of messages and of `loop`
can be reached, so a template can neither run code nor see its surroundings.

A template is parsed into a syntax tree, constant parts are folded, and the rest becomes closures.
Rendering takes the messages one by one and yields pieces, so a conversation of any length needs the memory of two messages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

#: Strings that mark something in this or other well-known chat formats; fixed values.
CONTROLS = (
    "<|turn|>", "<|text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
)
_AT_CONTROL = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROLS)) + r").", re.S)
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """No control string is left: each has a backslash after its first character; backslashes are doubled."""
    return _AT_CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# --- syntax tree ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    expr: Any


@dataclass(frozen=True)
class Assign:
    name: str
    expr: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body), the last condition may be Const(True)


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser --------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+()\[\]=]))""")
_LITERALS = {"true": True, "false": False, "none": None}
_RESERVED = {"and", "or", "not", "in", "if", "else", *_LITERALS}
_BACKSLASH = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in _RESERVED:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("name expected")

    def whole(self) -> Any:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is not expected")
        return tree

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            return Op("if", (condition, value, self.choice()))
        return value

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.added()
        while op := self.take("==", "!=", "in"):
            left = Op(op, (left, self.added()))
        return left

    def added(self) -> Any:
        left = self.filtered()
        while self.take("+"):
            left = Op("+", (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        value = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Filter(name, value)
        return value

    def reached(self) -> Any:
        value = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                value = Key(value, self.name())
            else:
                key = self.choice()
                self.need("]")
                if not isinstance(key, Const) or not isinstance(key.value, str):
                    raise TemplateError("only text keys can be reached")
                value = Key(value, key.value)
        return value

    def atom(self) -> Any:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, token = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _BACKSLASH.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == "int":
            self.at += 1
            return Const(int(token))
        if token in _LITERALS:
            self.at += 1
            return Const(_LITERALS[token])
        return Name(self.name())


class _Template:
    """Nested blocks of one template."""

    def __init__(self, source: str):
        self.parts, at = [], 0
        for m in _PARTS.finditer(source):
            self.parts += [("text", source[at : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
            at = m.end()
        self.parts.append(("text", source[at:]))
        self.at, self.loops = 0, 0

    def block(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to one of the closing tags, and that tag."""
        nodes: list[Any] = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Out(Const(body)))
            elif kind == "out":
                nodes.append(Out(_Expression(body).whole()))
            else:
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return tuple(nodes), body
                nodes.append(self.tag(word, body[len(word) :]))
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return tuple(nodes), ""

    def tag(self, word: str, rest: str) -> Any:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            self.loops += 1
            if not m or m[1] in _RESERVED or self.loops > 1:
                raise TemplateError("one loop over messages is allowed")
            return For(m[1], self.block("endfor")[0])
        if word == "if":
            branches, condition = [], _Expression(rest).whole()
            while True:
                body, end = self.block("endif", "elif", "else")
                branches.append((condition, body))
                if end.startswith("endif"):
                    return If(tuple(branches))
                if end.startswith("else"):
                    return If((*branches, (Const(True), self.block("endif")[0])))
                condition = _Expression(end[len("elif") :]).whole()
        if word == "generation":
            return Generation(self.block("endgeneration")[0])
        if word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name) or name.strip() in (*_RESERVED, "messages", "loop"):
                raise TemplateError("set needs a name")
            return Assign(name.strip(), _Expression(value).whole())
        raise TemplateError(f"no tag {word!r}")


# --- constant folding ----------------------------------------------------------------------------


def _apply(op: str, args: tuple) -> Any:
    if op == "not":
        return not args[0]
    a, b = args
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return a in b
    return _shown(a) + _shown(b) if isinstance(a, str) or isinstance(b, str) else a + b


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def fold(node: Any) -> Any:
    """The same expression with constant parts worked out."""
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](_shown(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(fold(node.of), node.key)
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        if node.op in ("and", "or", "if") and isinstance(args[0], Const):
            if node.op == "if":
                return args[1] if args[0].value else args[2]
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or", "if") and all(isinstance(a, Const) for a in args):
            return Const(_apply(node.op, tuple(a.value for a in args)))
        return Op(node.op, args)
    return node


def fold_block(nodes: tuple) -> tuple:
    """The same block with constant text joined and branches that cannot be taken left out."""
    out: list[Any] = []

    def put(node: Any) -> None:
        if isinstance(node, Out) and isinstance(node.expr, Const):
            text = _shown(node.expr.value)
            if out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const):
                text = out.pop().expr.value + text
            if text:
                out.append(Out(Const(text)))
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Out):
            put(Out(fold(node.expr)))
        elif isinstance(node, Assign):
            put(Assign(node.name, fold(node.expr)))
        elif isinstance(node, For):
            put(For(node.name, fold_block(node.body)))
        elif isinstance(node, Generation):
            put(Generation(fold_block(node.body)))
        else:
            branches = []
            for condition, body in ((fold(c), fold_block(b)) for c, b in node.branches):
                if not isinstance(condition, Const):
                    branches.append((condition, body))
                elif condition.value:
                    branches.append((Const(True), body))
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    put(inner)
            elif branches:
                put(If(tuple(branches)))
    return tuple(out)


# --- closures ------------------------------------------------------------------------------------

Scope = dict[str, Any]


def _expression(node: Any) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Key):
        of, key = _expression(node.of), node.key
        return lambda scope: v.get(key) if isinstance(v := of(scope), dict) else None
    if isinstance(node, Filter):
        of, change = _expression(node.of), FILTERS[node.name]
        return lambda scope: change(_shown(of(scope)))
    args = tuple(_expression(a) for a in node.args)
    if node.op == "if":
        condition, yes, no = args
        return lambda scope: yes(scope) if condition(scope) else no(scope)
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    op = node.op
    return lambda scope: _apply(op, tuple(a(scope) for a in args))


Pieces = Iterator[tuple[str, bool]]


def _block(nodes: tuple, masked: bool) -> Callable[[Scope], Pieces]:
    steps = [_statement(n, masked) for n in nodes]

    def run(scope: Scope) -> Pieces:
        for step in steps:
            yield from step(scope)

    return run


def _statement(node: Any, masked: bool) -> Callable[[Scope], Pieces]:
    if isinstance(node, Out):
        value = _expression(node.expr)
        return lambda scope: iter(((_shown(value(scope)), masked),))
    if isinstance(node, Assign):
        name, value = node.name, _expression(node.expr)

        def assign(scope: Scope) -> Pieces:
            scope[name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, Generation):
        return _block(node.body, True)
    if isinstance(node, If):
        branches = [(_expression(c), _block(b, masked)) for c, b in node.branches]

        def choose(scope: Scope) -> Pieces:
            return next((body(scope) for condition, body in branches if condition(scope)), iter(()))

        return choose
    name, body = node.name, _block(node.body, masked)

    def loop(scope: Scope) -> Pieces:
        rest = iter(scope["messages"])
        message = next(rest, None)
        i = 0
        while message is not None:
            following = next(rest, None)  # one ahead, for loop.last
            yield from body(scope | {name: message, "loop": {"first": i == 0, "last": following is None, "index0": i, "index": i + 1}})
            message, i = following, i + 1

    return loop


class CompiledTemplate:
    """A template ready to render; `source` is what it was made from, so it can be sent to workers as text."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold_block(_Template(source).block()[0])
        self._run = _block(self.tree, False)

    def __reduce__(self):
        return CompiledTemplate, (self.source,)

    def pieces(self, messages: Iterable[dict[str, Any]], **variables: Any) -> Pieces:
        """Pieces of the output, each with whether it is under the loss mask."""
        return self._run({**variables, "messages": messages})

    def render(self, messages: Iterable[dict[str, Any]], **variables: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole output and the spans under the loss mask, in code points."""
        out, spans, at = [], [], 0
        for text, masked in self.pieces(messages, **variables):
            out.append(text)
            if masked and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            at += len(text)
        return "".join(out), spans
