r"""Chat formatting: a small template language compiled to Python closures.

The language: text, ``{{ expression }}``, ``{% for x in messages %}``, ``{% if e %} {% elif e %} {% else %}
{% endif %}``, and ``{% generation %} ... {% endgeneration %}`` around what a model is trained to write.
Expressions: strings, numbers, names, ``a.b``, ``== != + and or not``, parentheses, and filters ``| name`` from a
fixed table. There are no calls, no attribute access beyond a row's fields and no Python names, so a template
cannot reach the interpreter. Templates are parsed to a syntax tree, constants are folded, and each node becomes
a closure that yields (text, is_generation) pieces; a conversation streams through, so its length is no limit.

Control strings inside texts are broken by a backslash after their first character (and backslashes doubled),
so no text can form a marker; ``unescape`` removes it again.

Nulls: a null role or text is empty; a null turn sorts first; rows without a conversation form one
conversation with a null id. Ties of (conversation, turn) are ordered by role and text; repeated rows are
separate turns. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Piece = tuple[str, bool]

#: The marker strings of the default template; broken up inside texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")

DEFAULT = (
    "{% for m in messages %}{{ '<s>' }}{{ m.role | escape_line }}\n"
    "{% if m.role == 'user' %}{{ '[INST]' + ' ' }}{{ m.text | escape }}{{ ' ' + '[/INST]' }}"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '</s>' }}\n{% endfor %}"
)

_CONTROL = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def unescape_line(text: str) -> str:
    return re.sub(r"\\(\\|n\\)?", lambda m: {"\\": "\\", "n\\": "\n"}.get(m[1], ""), text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """A template that does not parse."""


# ---- syntax tree ----


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Put:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+|().]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        at = m.end()
        kind = ("string", "number", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filter, atom."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _lex(source), 0

    def parse(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, below, *signs: str):
        node = below()
        while sign := self.take(*signs):
            node = Op(sign, (node, below()))
        return node

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.chain(self.total, "==", "!=")

    def total(self):
        return self.chain(self.filtered, "+")

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Op(f"|{name}", (node,))
        return node

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def atom(self):
        kind, value = self.next()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            path = [value]
            while self.take("."):
                kind, field = self.next()
                if kind != "name" or field.startswith("_"):
                    raise TemplateError(f"bad field {field!r}")
                path.append(field)
            return Name(tuple(path))
        if value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        body: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                body.append(Put(_Expression(part[2:-2]).parse()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(body), word, rest
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad for: {rest!r}")
                    body.append(For(m[1], _Expression(m[2]).parse(), block("endfor")[0]))
                elif word == "if":
                    branches, word = [], "elif"
                    while word != "endif":
                        condition = Const(True) if word == "else" else _Expression(rest).parse()
                        inner, word, rest = block("endif") if word == "else" else block("elif", "else", "endif")
                        branches.append((condition, inner))
                    body.append(If(tuple(branches)))
                elif word == "generation":
                    body.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {word!r}")
            elif part:
                body.append(Put(Const(part)))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(body), "", ""

    return block()[0]


_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _apply(kind: str, values: list):
    if kind == "not":
        return not values[0]
    return FILTERS[kind[1:]](str(values[0])) if kind[0] == "|" else _BINARY[kind](*values)


def fold(node):
    """The same tree with constant parts worked out and neighbouring constant texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Put) and isinstance(y.value, Const) and out and isinstance(out[-1], Put) and isinstance(out[-1].value, Const):
                    out[-1] = Put(Const(str(out[-1].value.value) + str(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(_apply(node.kind, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(node.kind, args)
    if isinstance(node, Put):
        return Put(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        kept = []
        for condition, body in node.branches:
            condition = fold(condition)
            if isinstance(condition, Const):
                if condition.value:
                    kept.append((condition, fold(body)))
                    break
                continue
            kept.append((condition, fold(body)))
        return kept[0][1] if kept and isinstance(kept[0][0], Const) else If(tuple(kept)) if kept else ()
    return node


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        first, rest = node.path[0], node.path[1:]

        def look(scope: dict) -> object:
            value = scope[first]
            for field in rest:
                value = value[field]
            return "" if value is None else value

        return look
    parts = [_value(a) for a in node.args]
    if node.kind in ("and", "or"):
        a, b = parts
        return (lambda s: a(s) and b(s)) if node.kind == "and" else (lambda s: a(s) or b(s))
    return lambda scope: _apply(node.kind, [p(scope) for p in parts])


def _emit(body: tuple, on: bool) -> Callable[[dict], Iterator[Piece]]:
    steps: list[Callable[[dict], Iterator[Piece]]] = []
    for node in body:
        if isinstance(node, Put):
            steps.append(lambda scope, v=_value(node.value): iter(((str(v(scope)), on),)))
        elif isinstance(node, Generation):
            steps.append(_emit(node.body, True))
        elif isinstance(node, For):

            def loop(scope: dict, name=node.name, over=_value(node.over), inner=_emit(node.body, on)) -> Iterator[Piece]:
                for x in over(scope):
                    yield from inner({**scope, name: x})

            steps.append(loop)
        else:

            def choose(scope: dict, branches=tuple((_value(c), _emit(b, on)) for c, b in node.branches)) -> Iterator[Piece]:
                for condition, inner in branches:
                    if condition(scope):
                        yield from inner(scope)
                        return

            steps.append(choose)

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def compile_template(source: str = DEFAULT) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (dicts with role and text) to pieces (text, is_generation), made lazily."""
    run = _emit(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


# ---- reading back ----


class Reader:
    """Reads the default template's output, piece by piece, into turns and the text under the loss mask."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.rest = ""
        self.masked: list[str] = []

    def feed(self, piece: Piece) -> None:
        text, generated = piece
        self.formatted_chars += len(text)
        if generated:
            self.masked.append(text)
        self.rest += text
        if "</s>\n" in text:
            self.turn()

    def turn(self) -> None:
        if self.masked:  # an escape never spans the mask's edge, and the mask opens and closes inside a turn
            loss = unescape("".join(self.masked))
            self.loss.update(loss.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(loss)
            self.masked.clear()
        while (end := self.rest.find("</s>\n")) >= 0:
            if not self.rest.startswith("<s>"):
                raise ValueError("a turn does not begin with its marker")
            role, _, body = self.rest[3:end].partition("\n")
            role = unescape_line(role)
            if role == "user":
                body = body.removeprefix("[INST] ").removesuffix(" [/INST]")
            self.turns.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            self.rest = self.rest[end + 5 :]

    def row(self) -> dict:
        if self.rest:
            raise ValueError("the output ends inside a turn")
        return {"n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars}


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            yield from batch.slice(lo, 1000).to_pylist()


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Consecutive rows of one conversation, as an iterator that holds one row."""
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        conv = row["conv_id"]

        def own() -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv_id"] == conv:
                yield row
                row = next(rows, None)

        it = own()
        yield conv, it
        for _ in it:
            pass


def _sorted(conversations: DataFrame) -> DataFrame:
    slim = conversations.select("conv_id", "turn", "role", "text")
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(conversations: DataFrame, template: str = DEFAULT) -> DataFrame:
    """conv_id, text, mask: the formatted conversation and [start, end) spans of generated text (code points)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, messages in _conversations(batches):
            parts, spans, at = [], [], 0
            for text, generated in render(messages):
                parts.append(text)
                if generated and text:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "text": "".join(parts), "mask": spans}], schema=shape)

    shape = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return _sorted(conversations).mapInArrow(run, "conv_id long, text string, mask array<struct<start: long, end: long>>")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation what a reader of the default template's output finds again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(DEFAULT), []
        for conv, messages in _conversations(batches):
            reader = Reader()
            for piece in render(messages):
                reader.feed(piece)
            out.append({"conv_id": conv, **reader.row()})
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(table.unionByName(extra))
