"""Chat formatting: a template compiler, from a small sandboxed language to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

# ---- syntax tree


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (test or None, body) each


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class For:
    """The turns of a conversation, one after another."""

    body: tuple


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Name:
    value: str


@dataclass(frozen=True)
class Binary:
    operator: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    value: object


@dataclass(frozen=True)
class Filter:
    name: str
    value: object


class TemplateError(ValueError):
    """A template that does not follow the language."""


#: The names that a template of one turn may use, and those of a turn in a loop; nothing else can be reached from one.
NAMES = ("role", "content", "first", "last", "previous_role")
TURN_NAMES, LOOP_NAMES = ("role", "content"), ("first", "last", "previous_role")
ESCAPE = "\u001b"


def escape(text: str, controls: tuple[str, ...]) -> str:
    """The text with every control string broken up by an escape character; ``unescape`` gives it back.

    The escape character itself is doubled. Inside a control string it is put after the first character, so that no
    control string is left, wherever it begins.
    """
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    if controls:
        text = _controls(controls).sub(lambda m: m[0] + ESCAPE + "-", text)
    return text


@lru_cache(16)
def _controls(controls: tuple[str, ...]) -> re.Pattern:
    """The first character of each control string, overlapping ones too."""
    return re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True)))


_ESCAPED = re.compile(f"{ESCAPE}([{ESCAPE}-])")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == ESCAPE else "", text)


FILTERS: dict[str, Callable] = {"upper": str.upper, "lower": str.lower, "trim": str.strip}

# ---- parser

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*(?:\.\w+)?)|'(?P<single>(?:[^'\\]|\\.)*)'|\"(?P<double>(?:[^\"\\]|\\.)*)\"|(?P<mark>==|!=|[()+|]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """or < and < not < == != < + < | filter; ``names`` has the names that may be used and what each stands for."""

    def __init__(self, source: str, names: dict[str, str]):
        self.names = names
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind in ("single", "double"):
                kind, value = "string", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value)
            self.tokens.append((kind, value))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("name", "mark") and value in wanted:
            self.at += 1
            return value
        return None

    def whole(self):
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self):
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while operator := self.take("==", "!="):
            node = Binary(operator, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.take("+"):
            node = Binary("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in (*FILTERS, "escape"):
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            node = Filter(name, node)
        return node

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "string":
            return Constant(value)
        if kind == "name" and value in ("true", "false"):
            return Constant(value == "true")
        if kind == "name" and value in self.names:
            return Name(self.names[value])
        if kind == "mark" and value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: text, {{ expression }}, {% if %} elif else endif, {% generation %} endgeneration, {% for %} endfor.

    A template either is that of one turn, or has one loop over ``turns`` at its outermost level, inside which
    turn.role, turn.content, loop.first, loop.last and loop.previous_role are known (turn being the loop's own name).
    """
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at: m.start()]))
        if m[1] is not None:
            parts.append(("show", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0
    looped = any(kind == "tag" and value.split(" ")[0] == "for" for kind, value in parts)
    names = {} if looped else {name: name for name in NAMES}
    depth = loops = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place, names, depth, loops
        nodes = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Text(value))
            elif kind == "show":
                nodes.append(Show(_Expression(value, names).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(nodes), value
                depth += 1
                if word == "if":
                    branches, test = [], _Expression(rest, names).whole()
                    while True:
                        inner, end = body("elif", "else", "endif")
                        branches.append((test, inner))
                        if end == "endif":
                            break
                        test = _Expression(end[5:], names).whole() if end.startswith("elif") else None
                    nodes.append(If(tuple(branches)))
                elif word == "generation":
                    nodes.append(Generation(body("endgeneration")[0]))
                elif word == "for" and (head := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+turns", rest.strip())) and head[1] != "loop":
                    loops += 1
                    if depth > 1 or loops > 1:
                        raise TemplateError("a template has one loop, outside of anything else")
                    names = {f"{head[1]}.{n}": n for n in TURN_NAMES} | {f"loop.{n}": n for n in LOOP_NAMES}
                    nodes.append(For(body("endfor")[0]))
                    names = {}
                else:
                    raise TemplateError(f"unknown tag {value!r}")
                depth -= 1
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    return body()[0]


# ---- constant folding


def _fold_expression(node, controls: tuple[str, ...]):
    if isinstance(node, Binary):
        left, right = _fold_expression(node.left, controls), _fold_expression(node.right, controls)
        if isinstance(left, Constant) and isinstance(right, Constant):
            return Constant(_OPERATORS[node.operator](left.value, right.value))
        return Binary(node.operator, left, right)
    if isinstance(node, Not):
        value = _fold_expression(node.value, controls)
        return Constant(not value.value) if isinstance(value, Constant) else Not(value)
    if isinstance(node, Filter):
        value = _fold_expression(node.value, controls)
        return Constant(_filter(node.name, controls)(str(value.value))) if isinstance(value, Constant) else Filter(node.name, value)
    return node


def fold(nodes: tuple, controls: tuple[str, ...] = ()) -> tuple:
    """The tree with constant expressions evaluated, settled branches taken and neighbouring texts joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
        elif not (isinstance(node, Text) and not node.value):
            out.append(node)

    for node in nodes:
        if isinstance(node, Show):
            value = _fold_expression(node.value, controls)
            add(Text(_shown(value.value)) if isinstance(value, Constant) else Show(value))
        elif isinstance(node, (Generation, For)):
            add(type(node)(fold(node.body, controls)))
        elif isinstance(node, If):
            open_ = []
            for test, body in node.branches:
                test = None if test is None else _fold_expression(test, controls)
                if isinstance(test, Constant) and not test.value:
                    continue
                if isinstance(test, Constant):
                    test = None
                open_.append((test, fold(body, controls)))
                if test is None:
                    break
            if open_ and open_[0][0] is None:
                for inner in open_[0][1]:
                    add(inner)
            elif open_:
                add(If(tuple(open_)))
        else:
            add(node)
    return tuple(out)


# ---- closures

_OPERATORS: dict[str, Callable] = {
    "or": lambda a, b: a or b, "and": lambda a, b: a and b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "+": lambda a, b: _shown(a) + _shown(b)}


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower()


def _filter(name: str, controls: tuple[str, ...]) -> Callable[[str], str]:
    return (lambda text: escape(text, controls)) if name == "escape" else FILTERS[name]


def _expression(node, controls: tuple[str, ...]) -> Callable[[dict], object]:
    if isinstance(node, Constant):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.value
        return lambda scope: scope[name]
    if isinstance(node, Not):
        inner = _expression(node.value, controls)
        return lambda scope: not inner(scope)
    if isinstance(node, Filter):
        inner, apply = _expression(node.value, controls), _filter(node.name, controls)
        return lambda scope: apply(_shown(inner(scope)))
    left, right, apply = _expression(node.left, controls), _expression(node.right, controls), _OPERATORS[node.operator]
    return lambda scope: apply(left(scope), right(scope))


#: A rendered turn is a list of (text, whether it is under the loss mask).
Writer = Callable[[dict, list, bool], None]


def _writer(nodes: tuple, controls: tuple[str, ...]) -> Writer:
    steps: list[Writer] = []
    for node in nodes:
        if isinstance(node, Text):
            steps.append(lambda scope, out, mask, value=node.value: out.append((value, mask)))
        elif isinstance(node, Show):
            steps.append(lambda scope, out, mask, value=_expression(node.value, controls): out.append((_shown(value(scope)), mask)))
        elif isinstance(node, Generation):
            steps.append(lambda scope, out, mask, body=_writer(node.body, controls): body(scope, out, True))
        else:
            branches = [(None if t is None else _expression(t, controls), _writer(b, controls)) for t, b in node.branches]

            def choose(scope, out, mask, branches=branches):
                for test, body in branches:
                    if test is None or test(scope):
                        body(scope, out, mask)
                        return

            steps.append(choose)

    def write(scope: dict, out: list, mask: bool) -> None:
        for step in steps:
            step(scope, out, mask)

    return write


def compile_template(source: str, controls: tuple[str, ...]) -> Callable[[dict], list[tuple[str, bool]]]:
    """Parses, folds and compiles a template; controls are what ``escape`` breaks up in texts.

    The closure renders a turn at a time: with a loop, what stands before it comes with the first turn, and what stands
    after it with the last one, so that a conversation's turns one after another are the whole rendered template.
    """
    tree = fold(parse(source), controls)
    loop = next((i for i, node in enumerate(tree) if isinstance(node, For)), None)
    if loop is None:
        before, write, after = None, _writer(tree, controls), None
    else:
        before, write, after = (_writer(nodes, controls) for nodes in (tree[:loop], tree[loop].body, tree[loop + 1:]))

    def render(scope: dict) -> list[tuple[str, bool]]:
        out: list = []
        if before and scope["first"]:
            before(scope, out, False)
        write(scope, out, False)
        if after and scope["last"]:
            after(scope, out, False)
        return [(text, mask) for text, mask in out if text]

    return render


# ---- the shipped template and its reader

CONTROLS = ("<|turn|>", "<|says|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]")
TEMPLATE = ("<s>{% for turn in turns %}<|turn|>{{ turn.role | escape }}<|says|>"
            "{% if turn.role == 'assistant' %}{% generation %}{{ turn.content | escape }}{% endgeneration %}{% else %}{{ turn.content | escape }}{% endif %}"
            "<|end|>{% endfor %}</s>")
_READ = re.compile(r"(?:<s>)?<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>(?:</s>)?", re.S)


def read_turn(segment: str) -> tuple[str, str]:
    """(role, content) of one rendered turn of ``TEMPLATE``, unescaped."""
    m = _READ.fullmatch(segment)
    if not m:
        raise ValueError("not a turn of this template")
    return unescape(m[1]), unescape(m[2])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, first, last, previous_role): what a template knows about each turn.

    Turns are ordered by turn (null last), then role and text, so that ties have one order. Null roles and texts count
    as empty; rows with a null conv_id form one conversation; repeated rows are turns of their own.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "content")
    return rows.select("*", F.row_number().over(order).alias("at"), F.lag("role").over(order).alias("previous_role"),
                       F.lead(F.lit(True)).over(order).isNull().alias("last")).withColumn("first", F.col("at") == 1)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, at, text, masked): each conversation's formatted turns, ordered by at within conv_id in every partition.

    text is the turn's part of the formatted conversation, which is all its parts joined; masked lists the (start,
    length) in code points that are under the loss mask. A turn is rendered at a time, so that a conversation of any
    length needs the memory of one turn.
    """
    source = turns_of(conversations).select("conv_id", "at", "role", "content", "first", "last", "previous_role")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        for batch in batches:
            texts, masks = [], []
            for scope in batch.select(["role", "content", "first", "last", "previous_role"]).to_pylist():
                parts, at, masked = render(scope), 0, []
                for text, mask in parts:
                    if mask:
                        masked.append({"start": at, "length": len(text)})
                    at += len(text)
                texts.append("".join(text for text, _ in parts)), masks.append(masked)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(masks, kind)],
                                             ["conv_id", "at", "text", "masked"])

    return source.mapInArrow(mapped, "conv_id long, at int, text string, masked array<struct<start int, length int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from ``format_conversations``.

    The parts of a conversation follow one another in their partition, as they were rendered; a hash is carried from
    part to part, so that no conversation is gathered.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, begun = None, False
        turns = loss = None
        n = chars = size = 0
        for batch in batches:
            rows = []
            for conv, text, masked in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not begun or conv != now:
                    if begun:
                        rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    now, begun, n, chars, size = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, content = read_turn(text)
                turns.update(f"{role}\n{content}\n".encode())
                for span in masked:
                    plain = unescape(text[span["start"]: span["start"] + span["length"]])
                    loss.update(plain.encode())
                    chars += len(plain)
                n += 1
                size += len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_TYPES)], names)
        if begun:
            row = (now, n, turns.hexdigest(), chars, loss.hexdigest(), size)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, _READ_TYPES)], names)

    return formatted.mapInArrow(mapped, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def op2(spark, sf_dir: str) -> DataFrame:
    """Query: formats the whole ``conversations`` table and conversation -7, and reads all of it back."""
    extra = spark.sql("select -7L conv_id, explode(array(struct(0L t, 'user' r), struct(1L t, 'assistant' r))) x").select(
        "conv_id", F.col("x.t").alias("turn"), F.col("x.r").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(extra)))
