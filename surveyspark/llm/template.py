"""A small sandboxed template language: syntax tree, constant folding, Python closures.

``{{ expr }}`` prints, ``{% if %} {% elif %} {% else %} {% endif %}`` chooses, ``{% for x in expr %}
{% endfor %}`` repeats, ``{% set x = expr %}`` names a value, and ``{% generation %}
{% endgeneration %}`` marks what a model is to learn. Expressions know strings, integers,
``true false none``, names, ``a.key`` on mappings, ``== != in``, ``and or not``, ``+`` and
``value | filter``. Nothing reaches Python attributes, calls or indices.
"""

from __future__ import annotations

import re
from typing import Any, Callable

TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|().+]))""")
TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
ESCAPES = {"n": "\n", "t": "\t"}
WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


# ---- expressions: nodes are tuples ("const", v) ("name", n) ("get", e, key) ("filter", e, name) ("not", e) (op, l, r)

class _Expr:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in texts

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or (kind and self.tokens[self.at][0] != kind):
            raise TemplateError(f"expected {kind or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.chain(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    LEVELS = (("or",), ("and",), ("==", "!=", "in"), ("+",))

    def chain(self, level: int):
        if level == len(self.LEVELS):
            return self.postfix()
        if level == 2 and self.peek("not"):
            self.take()
            return ("not", self.chain(2))
        node = self.chain(level + 1)
        while self.peek(*self.LEVELS[level]):
            node = (self.take(), node, self.chain(level + 1))
        return node

    def postfix(self):
        node = self.primary()
        while self.peek(".", "|"):
            node = ("get" if self.take() == "." else "filter", node, self.take("name"))
        return node

    def primary(self):
        if self.peek("("):
            self.take()
            node = self.chain(0)
            if not self.peek(")"):
                raise TemplateError("missing )")
            self.take()
            return node
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(text))
        if kind == "name":
            return ("const", WORDS[text]) if text in WORDS else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


# ---- statements: ("text", s) ("print", e) ("set", n, e) ("if", [(e, body)...]) ("for", n, e, body) ("generation", body)

def parse(source: str) -> list:
    parts = [p for p in TAG.split(source) if p]
    at = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("print", _Expr(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                nodes.append(("text", part))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return nodes, f"{word} {rest}".strip()
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return nodes, ""

    def statement(word: str, rest: str):
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq:
                raise TemplateError("set needs =")
            return ("set", name.strip(), _Expr(value).whole())
        if word == "generation":
            return ("generation", body("endgeneration")[0])
        if word == "for":
            name, _, value = rest.partition(" in ")
            return ("for", name.strip(), _Expr(value).whole(), body("endfor")[0])
        if word == "if":
            arms, condition = [], rest
            while True:
                inner, end = body("elif", "else", "endif")
                arms.append((_Expr(condition).whole(), inner))
                if end == "else":
                    arms.append((("const", True), body("endif")[0]))
                    return ("if", arms)
                if end == "endif":
                    return ("if", arms)
                condition = end.partition(" ")[2]
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


def fold(node, filters: dict[str, Callable]):
    """Evaluate what no variable reaches."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind in ("get", "filter"):
        inner = fold(node[1], filters)
        node = (kind, inner, node[2])
        constant = kind == "filter" and inner[0] == "const"
    else:
        inner = tuple(fold(x, filters) for x in node[1:])
        node = (kind, *inner)
        constant = all(x[0] == "const" for x in inner)
    return ("const", compile_expr(node, filters)({})) if constant else node


def fold_body(nodes: list, filters: dict[str, Callable]) -> list:
    out: list = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "print":
            e = fold(node[1], filters)
            add(("text", as_text(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2], filters)))
        elif node[0] == "generation":
            add(("generation", fold_body(node[1], filters)))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2], filters), fold_body(node[3], filters)))
        elif node[0] == "if":
            arms = []
            for condition, inner in node[1]:
                condition = fold(condition, filters)
                if condition[0] == "const" and not condition[1]:
                    continue
                arms.append((condition, fold_body(inner, filters)))
                if condition[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    add(inner)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


def as_text(value: Any) -> str:
    return "" if value is None else str(value)


def compile_expr(node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "get":
        inner, key = compile_expr(node[1], filters), node[2]
        return lambda env: x.get(key) if isinstance(x := inner(env), dict) else None
    if kind == "filter":
        if node[2] not in filters:
            raise TemplateError(f"unknown filter {node[2]!r}")
        inner, f = compile_expr(node[1], filters), filters[node[2]]
        return lambda env: f(as_text(inner(env)))
    if kind == "not":
        inner = compile_expr(node[1], filters)
        return lambda env: not inner(env)
    left, right = compile_expr(node[1], filters), compile_expr(node[2], filters)
    if kind == "or":
        return lambda env: left(env) or right(env)
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "==":
        return lambda env: left(env) == right(env)
    if kind == "!=":
        return lambda env: left(env) != right(env)
    if kind == "in":
        return lambda env: as_text(left(env)) in as_text(right(env))
    if kind == "+":
        def plus(env):
            a, b = left(env), right(env)
            return a + b if isinstance(a, int) and isinstance(b, int) else as_text(a) + as_text(b)
        return plus
    raise TemplateError(f"unknown node {kind!r}")


class Sink:
    """Rendered text and the spans that generation markers cover."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.marks: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.length += len(text)

    def taken(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.parts), self.marks
        self.__init__()
        return out


def compile_body(nodes: list, filters: dict[str, Callable]) -> Callable[[dict, Sink], None]:
    steps = [_compile(n, filters) for n in nodes]

    def run(env, sink):
        for step in steps:
            step(env, sink)
    return run


def _compile(node, filters) -> Callable[[dict, Sink], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, sink: sink.put(text)
    if kind == "print":
        e = compile_expr(node[1], filters)
        return lambda env, sink: sink.put(as_text(e(env)))
    if kind == "set":
        name, e = node[1], compile_expr(node[2], filters)
        return lambda env, sink: env.__setitem__(name, e(env))
    if kind == "generation":
        inner = compile_body(node[1], filters)

        def marked(env, sink):
            start = sink.length
            inner(env, sink)
            if sink.length > start:
                sink.marks.append((start, sink.length))
        return marked
    if kind == "if":
        arms = [(compile_expr(c, filters), compile_body(b, filters)) for c, b in node[1]]

        def choose(env, sink):
            for condition, inner in arms:
                if condition(env):
                    return inner(env, sink)
        return choose
    name, e, inner = node[1], compile_expr(node[2], filters), compile_body(node[3], filters)

    def repeat(env, sink):
        for item in e(env) or ():
            inner({**env, name: item}, sink)
    return repeat


class ChatTemplate:
    """A template with one top-level ``{% for m in messages %}``: a head, a body per message, a tail.

    The body sees ``loop.index`` (from 1), ``loop.first`` and ``loop.last``; head and tail don't see
    the messages. So a conversation renders message by message in the memory of one message.
    """

    def __init__(self, source: str, filters: dict[str, Callable]):
        nodes = fold_body(parse(source), filters)
        loops = [i for i, n in enumerate(nodes) if n[0] == "for" and n[2] == ("name", "messages")]
        if len(loops) != 1:
            raise TemplateError("a chat template loops over messages once")
        i = loops[0]
        self.name = nodes[i][1]
        self.head, self.tail = compile_body(nodes[:i], filters), compile_body(nodes[i + 1:], filters)
        self.body = compile_body(nodes[i][3], filters)

    def piece(self, message: dict, index: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """The text of one message (with the head or tail if it is the first or last) and its marks."""
        sink, env = Sink(), {}
        if index == 1:
            self.head(env, sink)
        self.body({**env, self.name: message, "loop": {"index": index, "first": index == 1, "last": last}}, sink)
        if last:
            self.tail(env, sink)
        return sink.taken()
