"""Conversations rendered by compiled templates, with generation markers.

A small template language is parsed into a syntax tree, constants are folded, and the tree is turned into nested Python
closures; neither ``eval`` nor attribute access on Python objects is ever used, so a template can only reach the values
it is given, by key. Supported::

    {{ expr }}  {# comment #}  {% set x = expr %}
    {% for m in messages %} ... {% endfor %}   with loop.index, loop.index0, loop.first, loop.last
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   marks what is trained on

with ``-`` beside a tag's brace to strip white space, literals, names, ``a.b``, ``a['b']``, ``+ - * // % ~``, comparisons,
``in``, ``and or not``, ``x if c else y`` and the filters trim, upper, lower, length, escape, escape_line, default(x).

``escape`` makes a text safe between control strings, reversibly (see ``escaped``): no control string is left in it, so a
text can't end a turn or begin one.

Edge cases: a null text counts as empty, a null role as ``""``; rows of equal turn are ordered by role, then text; rows
with a null turn come first; a null conv_id is a conversation; repeated rows are turns of their own; an empty table
gives an empty result; other columns are ignored, whatever their names. A conversation is one value and so is held by one
task, with a batch of finished ones of bounded size; its formatted text may have 2 GB at most, as any string of a column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import mapped

# --- escaping ---------------------------------------------------------------

_RISKY = re.compile(r"[|<\[]")
_BROKEN = re.compile(r"\|(.)", re.S)


def escaped(text: str) -> str:
    """``|`` becomes ``|/``; ``<`` and ``[``, which begin every control string, become ``|-`` and ``|:``. Undone by ``unescaped``."""
    return _RISKY.sub(lambda m: {"|": "|/", "<": "|-", "[": "|:"}[m[0]], text)


def unescaped(text: str) -> str:
    return _BROKEN.sub(lambda m: {"/": "|", "-": "<", ":": "[", "n": "\n"}[m[1]], text)


def escaped_line(text: str) -> str:
    """``escaped``, and line ends become ``|n``."""
    return escaped(text).replace("\n", "|n")


# --- lexing and parsing -----------------------------------------------------


class TemplateError(ValueError):
    """The template isn't in the language, or asks for what isn't there."""


@dataclass
class Node:
    kind: str
    value: Any = None
    kids: list[Node] = field(default_factory=list)


_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|//|[-+*%~<>()\[\].,|=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none", "True", "False", "None"}


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(text | print | tag, content), white space stripped where a dash asks for it."""
    at, strip = 0, False
    while at < len(source):
        opening = _TAG.search(source, at)
        text = source[at : opening.start() if opening else len(source)]
        text = text.lstrip() if strip else text
        if opening and opening[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not opening:
            return
        closing = {"{{": "}}", "{%": "%}", "{#": "#}"}[opening[0][:2]]
        end = _closing(source, opening.end(), closing)
        inner = source[opening.end() : end]
        strip = inner.endswith("-")
        inner = inner[:-1] if strip else inner
        if closing != "#}":
            yield "print" if closing == "}}" else "tag", inner.strip()
        at = end + 2


def _closing(source: str, at: int, closing: str) -> int:
    """The place of a closing brace outside string literals."""
    quote = ""
    while at < len(source):
        if quote:
            if source[at] == "\\":
                at += 1
            elif source[at] == quote:
                quote = ""
        elif closing != "#}" and source[at] in "'\"":
            quote = source[at]
        elif source.startswith(closing, at):
            return at
        at += 1
    raise TemplateError(f"{closing} is missing")


class _Expression:
    """Recursive descent over an expression's tokens."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"not understood: {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"not understood: {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.binary(0)
        if self.take("if"):
            condition = self.binary(0)
            other = self.choice() if self.take("else") else Node("const", "")
            node = Node("choice", None, [condition, node, other])
        return node

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def binary(self, level: int) -> Node:
        if level == 2 and self.take("not"):
            return Node("not", None, [self.binary(2)])
        if level == len(self.LEVELS):
            return self.postfix()
        node = self.binary(level + 1)
        while True:
            if level == 2 and self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                node = Node("not", None, [Node("binary", "in", [node, self.binary(level + 1)])])
            elif op := self.take(*self.LEVELS[level]):
                node = Node("binary", op, [node, self.binary(level + 1)])
            else:
                return node

    def postfix(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("item", None, [node, Node("const", self.name())])
            elif self.take("["):
                node = Node("item", None, [node, self.choice()])
                self.need("]")
            elif self.take("|"):
                name, extra = self.name(), []
                if self.take("("):
                    extra = [self.choice()]
                    self.need(")")
                if name not in FILTERS or len(extra) != (name == "default"):
                    raise TemplateError(f"no such filter: {name}")
                node = Node("filter", name, [node, *extra])
            else:
                return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("-"):
            return Node("binary", "-", [Node("const", 0), self.postfix()])
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Node("const", float(value) if "." in value else int(value))
        if kind == "string":
            return Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "name" and value.lower() in ("true", "false", "none"):
            return Node("const", {"true": True, "false": False, "none": None}[value.lower()])
        if kind == "name" and value not in _WORDS:
            return Node("name", value)
        raise TemplateError(f"not understood: {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces = list(_pieces(source))
    place = 0

    def block(ends: tuple[str, ...]) -> tuple[list[Node], str]:
        nonlocal place
        found: list[Node] = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            word = text.partition(" ")[0] if kind == "tag" else ""
            if kind == "text":
                found.append(Node("const", text))
            elif kind == "print":
                found.append(_Expression(text).whole())
            elif word in ends:
                return found, text
            else:
                found.append(statement(word, text))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return found, ""

    def statement(word: str, text: str) -> Node:
        rest = text[len(word) :]
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            source_node = e.whole()
            return Node("for", name, [source_node, Node("list", None, block(("endfor",))[0])])
        if word == "if":
            condition = _Expression(rest).whole()
            body, end = block(("elif", "else", "endif"))
            other: list[Node] = []
            if end.startswith("elif"):
                other = [statement("if", "if" + end[4:])]
            elif end == "else":
                other = block(("endif",))[0]
            return Node("if", None, [condition, Node("list", None, body), Node("list", None, other)])
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            return Node("set", name, [e.whole()])
        if word == "generation":
            return Node("generation", None, [Node("list", None, block(("endgeneration",))[0])])
        raise TemplateError(f"no such tag: {word}")

    return Node("list", None, block(())[0])


# --- folding ----------------------------------------------------------------


def _plain(value: Any) -> str:
    return "" if value is None else str(value)


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: _plain(x).strip(),
    "upper": lambda x: _plain(x).upper(),
    "lower": lambda x: _plain(x).lower(),
    "length": lambda x: len(x or ""),
    "escape": lambda x: escaped(_plain(x)),
    "escape_line": lambda x: escaped_line(_plain(x)),
    "default": lambda x, other: other if x is None else x,
}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "~": lambda a, b: _plain(a) + _plain(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if not (isinstance(a, str) or isinstance(b, str)) else _refuse(),
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b if not isinstance(a, str) else _refuse(),
}


def _refuse() -> Any:
    raise TemplateError("a text can't be multiplied or formatted")


def fold(node: Node) -> Node:
    """The same tree with constant parts computed and neighbouring constant output joined."""
    kids = [fold(k) for k in node.kids]
    node = Node(node.kind, node.value, kids)
    constant = bool(kids) and all(k.kind == "const" for k in kids)
    if node.kind == "binary" and constant and node.value not in ("and", "or"):
        try:
            return Node("const", _BINARY[node.value](kids[0].value, kids[1].value))
        except (TypeError, ZeroDivisionError):
            return node
    if node.kind == "binary" and node.value in ("and", "or") and kids[0].kind == "const":
        return kids[1] if bool(kids[0].value) == (node.value == "and") else kids[0]
    if node.kind == "not" and constant:
        return Node("const", not kids[0].value)
    if node.kind == "filter" and constant:
        return Node("const", FILTERS[node.value](*(k.value for k in kids)))
    if node.kind in ("choice", "if") and kids[0].kind == "const":
        return kids[1] if kids[0].value else kids[2]
    if node.kind == "list":
        flat: list[Node] = []
        for k in kids:
            for x in k.kids if k.kind == "list" else [k]:
                if x.kind == "const" and flat and flat[-1].kind == "const":
                    flat[-1] = Node("const", _plain(flat[-1].value) + _plain(x.value))
                elif x.kind != "const" or _plain(x.value):
                    flat.append(Node("const", _plain(x.value)) if x.kind == "const" else x)
        node.kids = flat
    return node


# --- closures ---------------------------------------------------------------


class Output:
    """Rendered pieces, and the spans (start, end) in code points of what is generated."""

    def __init__(self) -> None:
        self.pieces, self.length, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.pieces)


def _item(container: Any, key: Any) -> Any:
    if isinstance(container, dict):
        return container.get(key)
    if isinstance(container, (list, tuple, str)) and isinstance(key, int):
        return container[key] if -len(container) <= key < len(container) else None
    if container is None:
        return None
    raise TemplateError("only keys of mappings and places of lists can be asked for")


def _value(node: Node) -> Callable[[dict], Any]:
    kids = [_value(k) for k in node.kids]
    if node.kind == "const":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, n=node.value: env.get(n)
    if node.kind == "item":
        return lambda env, a=kids[0], b=kids[1]: _item(a(env), b(env))
    if node.kind == "not":
        return lambda env, a=kids[0]: not a(env)
    if node.kind == "choice":
        return lambda env, c=kids[0], a=kids[1], b=kids[2]: a(env) if c(env) else b(env)
    if node.kind == "filter":
        return lambda env, f=FILTERS[node.value], ks=kids: f(*(k(env) for k in ks))
    if node.value == "and":
        return lambda env, a=kids[0], b=kids[1]: a(env) and b(env)
    if node.value == "or":
        return lambda env, a=kids[0], b=kids[1]: a(env) or b(env)
    return lambda env, f=_BINARY[node.value], a=kids[0], b=kids[1]: f(a(env), b(env))


def _writer(node: Node) -> Callable[[dict, Output], None]:
    if node.kind == "list":
        steps = [_writer(k) for k in node.kids]

        def run_all(env: dict, out: Output) -> None:
            for step in steps:
                step(env, out)

        return run_all
    if node.kind == "const":
        return lambda env, out, text=_plain(node.value): out.put(text)
    if node.kind == "set":
        value = _value(node.kids[0])
        return lambda env, out, n=node.value: env.__setitem__(n, value(env))
    if node.kind == "if":
        condition, yes, no = _value(node.kids[0]), _writer(node.kids[1]), _writer(node.kids[2])
        return lambda env, out: yes(env, out) if condition(env) else no(env, out)
    if node.kind == "generation":
        body = _writer(node.kids[0])

        def marked(env: dict, out: Output) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return marked
    if node.kind == "for":
        source, body, name = _value(node.kids[0]), _writer(node.kids[1]), node.value

        def loop(env: dict, out: Output) -> None:
            items = list(source(env) or ())
            inner = dict(env)
            for i, x in enumerate(items):
                inner |= {name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(items), "length": len(items)}}
                body(inner, out)

        return loop
    value = _value(node)
    return lambda env, out: out.put(_plain(value(env)))


def compiled(source: str) -> Callable[[dict], Output]:
    """A function from variables to output."""
    write = _writer(fold(parse(source)))

    def render(variables: dict) -> Output:
        out = Output()
        write(dict(variables), out)
        return out

    return render


# --- conversations ----------------------------------------------------------

#: Marks roles and texts with control strings; texts and roles are escaped; assistant texts alone are generated.
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' ~ (m.role | escape_line) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
#: Characters of formatted conversations after which a batch is handed on.
BATCH_CHARS = 4_000_000
FORMATTED = "conv_id bigint, formatted string, starts array<bigint>, ends array<bigint>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, and starts and ends of the generated spans in code points; rows of a conversation by turn."""
    render = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal render
        render = render or compiled(template)
        now, messages, done, held = object(), [], [], 0

        def close() -> None:
            nonlocal held
            if messages:
                out = render({"messages": messages})
                done.append((now, out.text(), [a for a, _ in out.spans], [b for _, b in out.spans]))
                held += len(done[-1][1])

        def batch_of() -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], ["conv_id", "formatted", "starts", "ends"])

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    close()
                    now, messages = conv, []
                    if held >= BATCH_CHARS or len(done) >= 1000:
                        yield batch_of()
                        done.clear()
                        held = 0
                messages.append({"role": role, "text": text})
        close()
        if done:
            yield batch_of()

    rows = conversations.select(F.col("conv_id").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.select("conv_id", "role", "text").transform(mapped, run, FORMATTED)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from what ``TEMPLATE`` made."""
    found, at = [], 0
    while at < len(formatted):
        start = formatted.index("\n", at)
        stop = formatted.index("<|im_end|>\n", start)
        if not formatted.startswith("<|im_start|>", at):
            raise ValueError("not a turn")
        found.append((unescaped(formatted[at + 12 : start]), unescaped(formatted[start + 1 : stop])))
        at = stop + 11
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, read back from its text and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns, loss = turns_of(text), "".join(unescaped(text[a:b]) for a, b in zip(starts, ends, strict=True))
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                rows.append((conv, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.transform(mapped, run, DIGESTS)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
