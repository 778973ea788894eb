"""Chat formatting by a template compiler.

A small sandboxed template language (output, ``for``, ``if``, ``generation``; names, attributes, strings, numbers,
comparison, ``and or not +`` and a fixed set of filters, no calls) is parsed into a syntax tree, constants are
folded, and the tree becomes Python closures. Rendering gives ``(text, under the loss mask)`` pieces one after the
other, so a conversation of any number of turns needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import parts

#: Turns are marked by <turn role> and </turn>; a text's own marks are escaped.
TEMPLATE = "{% for m in messages %}{{ '<turn ' + m.role|escape + '>' }}{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}{{ '</turn>' }}{% endfor %}"

_ESCAPED = {"\\": "\\\\", "<": "\\(", ">": "\\)"}
_PLAIN = {v[1]: k for k, v in _ESCAPED.items()}


def escape(text: str) -> str:
    """``text`` without ``<`` and ``>``, so that it holds no control string."""
    return re.sub(r"[\\<>]", lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """``kind`` text, out, for, if, generation, or an expression: const, name, attr, not, filter, ==, !=, +, and, or."""

    kind: str
    value: object = None
    parts: tuple = field(default=())


_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[|+.()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else ""

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Node:
        node = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def level(self, k: int) -> Node:
        operators = (("or",), ("and",), ("==", "!="), ("+",))
        if k == 2 and self.peek() == "not":
            self.take()
            return Node("not", parts=(self.level(2),))
        if k == len(operators):
            return self.postfix()
        node = self.level(k + 1)
        while self.peek() in operators[k]:
            node = Node(self.take()[1], parts=(node, self.level(k + 1)))
        return node

    def postfix(self) -> Node:
        kind, text = self.take()
        if kind == "str":
            node = Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "num":
            node = Node("const", int(text))
        elif kind == "name":
            node = Node("const", text == "true") if text in ("true", "false") else Node("name", text)
        elif text == "(":
            node = self.level(0)
            if self.take()[1] != ")":
                raise TemplateError("a bracket is open")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek() in (".", "[", "|"):
            sign, (kind, name) = self.take()[1], self.take()
            if sign == "[":
                if kind != "str" or self.take()[1] != "]":
                    raise TemplateError("only names in quotes stand in square brackets")
                name = name[1:-1]
            elif kind != "name":
                raise TemplateError(f"unexpected {name!r}")
            if sign == "|" and name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            if sign != "|" and name.startswith("_"):
                raise TemplateError(f"{name!r} is private")
            node = Node("filter" if sign == "|" else "attr", name, (node,))
        return node


def parse(source: str) -> tuple[Node, ...]:
    """The syntax tree of a template."""
    root: list[Node] = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Node("text", source[at : m.start()]))
        at = m.end()
        if m[2] is not None:
            stack[-1][2].append(Node("out", parts=(_Expression(m[2]).whole(),)))
        elif m[1] is not None:
            word, _, rest = m[1].partition(" ")
            if word == "for":
                if not (f := re.fullmatch(r"([A-Za-z]\w*) in (.+)", rest.strip())):
                    raise TemplateError(f"cannot read {m[1]!r}")
                stack.append(("for", (f[1], _Expression(f[2]).whole()), []))
            elif word == "if":
                stack.append(("if", [[_Expression(rest).whole(), []]], []))
                stack[-1] = ("if", stack[-1][1], stack[-1][1][0][1])
            elif word in ("elif", "else"):
                if stack[-1][0] != "if":
                    raise TemplateError(f"{word} stands outside an if")
                stack[-1][1].append([_Expression(rest).whole() if word == "elif" else Node("const", True), []])
                stack[-1] = ("if", stack[-1][1], stack[-1][1][-1][1])
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word.startswith("end") and word[3:] == stack[-1][0] != "":
                kind, value, body = stack.pop()
                if kind == "if":
                    node = Node("if", parts=tuple((test, tuple(inner)) for test, inner in value))
                else:
                    node = Node(kind, value, tuple(body))
                stack[-1][2].append(node)
            else:
                raise TemplateError(f"unexpected tag {m[1]!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        root.append(Node("text", source[at:]))
    return tuple(root)


def _operate(kind: str, a: object, b: object) -> object:
    if kind == "+":
        return f"{a}{b}" if isinstance(a, str) or isinstance(b, str) else a + b
    return (a == b) if kind == "==" else a != b


def fold(node: Node) -> Node:
    """The expression with everything that is constant worked out."""
    if node.kind in ("const", "name"):
        return node
    parts = tuple(map(fold, node.parts))
    fixed = all(p.kind == "const" for p in parts)
    if node.kind == "filter" and fixed:
        return Node("const", FILTERS[node.value](str(parts[0].value)))
    if node.kind == "not" and fixed:
        return Node("const", not parts[0].value)
    if node.kind in ("+", "==", "!=") and fixed:
        return Node("const", _operate(node.kind, parts[0].value, parts[1].value))
    if node.kind in ("and", "or") and parts[0].kind == "const":
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    return Node(node.kind, node.value, parts)


def fold_body(body: Iterable[Node]) -> tuple[Node, ...]:
    """The statements with folded expressions, decided branches taken and neighbouring texts joined."""
    out: list[Node] = []
    for node in body:
        made = [node]
        if node.kind == "out":
            value = fold(node.parts[0])
            made = [Node("text", str(value.value)) if value.kind == "const" else Node("out", parts=(value,))]
        elif node.kind == "for":
            made = [Node("for", (node.value[0], fold(node.value[1])), fold_body(node.parts))]
        elif node.kind == "generation":
            made = [Node("generation", None, fold_body(node.parts))]
        elif node.kind == "if":
            branches = []
            for test, inner in node.parts:
                test = fold(test)
                if test.kind == "const" and not test.value:
                    continue
                branches.append((test, fold_body(inner)))
                if test.kind == "const":
                    break
            made = list(branches[0][1]) if branches and branches[0][0].kind == "const" else [Node("if", parts=tuple(branches))] if branches else []
        for m in made:
            if m.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + m.value)
            elif m.kind != "text" or m.value:
                out.append(m)
    return tuple(out)


Scope = dict[str, object]


def _value(node: Node) -> Callable[[Scope], object]:
    if node.kind == "const":
        return lambda scope, v=node.value: v
    if node.kind == "name":
        return lambda scope, k=node.value: scope.get(k, "")
    first = _value(node.parts[0])
    if node.kind == "attr":
        return lambda scope, k=node.value: v.get(k, "") if isinstance(v := first(scope), dict) else ""
    if node.kind == "filter":
        return lambda scope, f=FILTERS[node.value]: f(str(first(scope)))
    if node.kind == "not":
        return lambda scope: not first(scope)
    second = _value(node.parts[1])
    if node.kind == "and":
        return lambda scope: first(scope) and second(scope)
    if node.kind == "or":
        return lambda scope: first(scope) or second(scope)
    return lambda scope, k=node.kind: _operate(k, first(scope), second(scope))


Render = Callable[[Scope, bool], Iterator[tuple[str, bool]]]


def _body(nodes: tuple[Node, ...]) -> Render:
    made = [_statement(n) for n in nodes]

    def run(scope: Scope, masked: bool) -> Iterator[tuple[str, bool]]:
        for m in made:
            yield from m(scope, masked)

    return run


def _statement(node: Node) -> Render:
    if node.kind == "text":

        def text(scope: Scope, masked: bool, t: str = node.value) -> Iterator[tuple[str, bool]]:
            yield t, masked

        return text
    if node.kind == "out":
        value = _value(node.parts[0])

        def out(scope: Scope, masked: bool) -> Iterator[tuple[str, bool]]:
            yield str(value(scope)), masked

        return out
    if node.kind == "generation":
        inner = _body(node.parts)
        return lambda scope, masked: inner(scope, True)
    if node.kind == "if":
        branches = [(_value(test), _body(inner)) for test, inner in node.parts]

        def choose(scope: Scope, masked: bool) -> Iterator[tuple[str, bool]]:
            for test, inner in branches:
                if test(scope):
                    yield from inner(scope, masked)
                    return

        return choose
    name, items, inner = node.value[0], _value(node.value[1]), _body(node.parts)

    def loop(scope: Scope, masked: bool) -> Iterator[tuple[str, bool]]:
        rest = iter(items(scope) or ())
        item = next(rest, None)
        k = 0
        while item is not None:
            after = next(rest, None)
            yield from inner(scope | {name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": after is None}}, masked)
            item, k = after, k + 1

    return loop


#: What a message and a loop offer.
MESSAGE, LOOP = frozenset(("role", "text")), frozenset(("index", "index0", "first", "last"))


def _named(node: Node, known: dict[str, frozenset], nested: bool) -> Iterator[bool]:
    """For each place that names ``messages`` whether it may be reached more than once; unknown attributes raise."""
    if node.kind == "name" and node.value == "messages" and "messages" not in known:
        yield nested
    elif node.kind == "attr" and node.parts[0].kind == "name" and (there := known.get(node.parts[0].value)) and node.value not in there:
        raise TemplateError(f"{node.parts[0].value} has no {node.value}")
    if node.kind == "for":
        name, items = node.value
        yield from _named(items, known, nested)
        inside = known | {name: MESSAGE if items == Node("name", "messages") else frozenset(), "loop": LOOP}
        for inner in node.parts:
            yield from _named(inner, inside, True)
    elif node.kind == "if":
        for test, body in node.parts:
            for inner in (test, *body):
                yield from _named(inner, known, nested)
    else:
        for inner in node.parts:
            yield from _named(inner, known, nested)


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (``role`` and ``text``) to pieces of output and whether the loss mask covers them.

    A template that goes through the messages once reads them as a stream; one that names them again, or in a loop,
    needs them all at once. An attribute that a message or loop does not have is an error, an unknown name is empty.
    """
    body = fold_body(parse(source))
    places = [again for node in body for again in _named(node, {}, False)]
    once = len(places) < 2 and not any(places)
    render = _body(body)
    return lambda messages: render({"messages": messages if once else list(messages)}, False)


class Reader:
    """Reads turns and the text under the loss mask back from formatted pieces, a turn at a time."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss_chars = 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.open, self.masked = "", ""

    def feed(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        if masked:
            self.masked += text
        elif self.masked:
            self.loss(self.masked)
        self.open += text
        while (end := self.open.find("</turn>")) >= 0:
            head, _, body = self.open[:end].partition(">")
            self.open = self.open[end + len("</turn>") :]
            self.turns += 1
            self.turns_sha.update(f"{unescape(head.removeprefix('<turn '))}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))

    def loss(self, text: str) -> None:
        plain = unescape(text)
        self.loss_chars += len(plain)
        self.loss_sha.update(plain.encode("utf-8", "surrogatepass"))
        self.masked = ""

    def row(self) -> tuple:
        if self.masked:
            self.loss(self.masked)
        return self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def format_conversations(turns: DataFrame, template: str = TEMPLATE, digest: bool = True) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` -> one row for each conversation.

    ``digest``: what is read back from the output, else the output itself as ``formatted`` and the spans
    ``[start, end)`` of the loss mask. Turns come in order of turn, role and text, nulls first; a null role or text
    is empty; repeated rows are turns of their own; a null conv_id is a conversation. Other columns are ignored; an
    empty table gives none. The order of turns makes a conversation one task's work, but its rows are read one after
    the other from a sort that spills and, with ``digest``, never held together, so its size costs time only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def rows() -> Iterator[tuple]:
            for b in parts(batches):
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

        def made() -> Iterator[tuple]:
            for conv, group in groupby(rows(), key=lambda r: r[0]):
                pieces = render({"role": role or "", "text": text or ""} for _, role, text in group)
                if digest:
                    reader = Reader()
                    for text, masked in pieces:
                        reader.feed(text, masked)
                    yield (conv, *reader.row())
                else:
                    parts, spans, at = [], [], 0
                    for text, masked in pieces:
                        parts.append(text)
                        if masked and text:
                            if spans and spans[-1]["end"] == at:
                                spans[-1]["end"] += len(text)
                            else:
                                spans.append({"start": at, "end": at + len(text)})
                        at += len(text)
                    yield conv, "".join(parts), spans

        done: list[tuple] = []
        for row in made():
            done.append(row)
            if len(done) == 256:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    whole, span = pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    if digest:
        schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
        types = (whole, whole, pa.string(), whole, pa.string(), whole)
    else:
        schema = "conv_id bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>"
        types = (whole, pa.string(), span)
    names = [x.split()[0] for x in schema.split(", ")][: len(types)]
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)
