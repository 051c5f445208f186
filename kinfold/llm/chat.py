"""Chat formatting: a compiler for a sandboxed template language.

Templates are parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield
pieces of text, each marked as generated or not. Loops pull their items one by one, so a conversation is rendered
turn by turn whatever its length. The language has text, ``{{ expression }}``, comments, ``if``/``elif``/``else``,
``for``, ``set`` and ``generation`` blocks, ``-`` trims white space; expressions have literals, names, item and
attribute access to mappings only, comparisons, ``in``, ``and``/``or``/``not``, ``+``, ``~`` and filters. Calls,
Python attributes and names that begin with an underscore do not exist.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.plans.runtime import table


class TemplateError(ValueError):
    """A template or a value that the sandbox refuses."""


# Control strings of the built-in template; texts must not bring them in.
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|role", "<|end|>", "</s>", "<s>")
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %} </s>"
    "{% elif m.role == 'system' %}<<SYS>> {{ m.text | escape }} <</SYS>>"
    "{% else %}{{ '<|' ~ 'role' }} {{ m.role | escape }} <|end|> {{ m.text | escape }} <|end|>{% endif %}"
    "{% endfor %}"
)


def escaper(controls: tuple[str, ...] = CONTROLS) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """(escape, unescape): a backslash doubles, control string number n becomes backslash, n, semicolon."""
    ordered = sorted(controls, key=len, reverse=True)
    number = {c: f"\\{controls.index(c)};" for c in ordered} | {"\\": "\\\\"}
    out = re.compile("|".join(map(re.escape, ["\\", *ordered])))
    back = re.compile(r"\\(?:(\\)|(\d+);)")
    return lambda s: out.sub(lambda m: number[m[0]], s), lambda s: back.sub(lambda m: m[1] or controls[int(m[2])], s)


# --- parsing ---------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~|.,()\[\]<>=]))""")
_STRINGS = {"n": "\n", "t": "\t", "r": "\r"}


def lex(source: str) -> list[tuple[str, str]]:
    """('text' | 'expr' | 'tag', content) in order."""
    out, at, trim = [], 0, False
    while at < len(source):
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        trim = False
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end, quote, i = -1, "", m.end()
        while i < len(source):  # the end of a tag, but not inside a string
            c = source[i]
            if quote and close != "#}":
                i += c == "\\"
                quote = "" if c == quote else quote
            elif source.startswith(close, i):
                end = i
                break
            elif c in "'\"" and close != "#}":
                quote = c
            i += 1
        if end < 0:
            raise TemplateError(f"{m[0]} is not closed")
        body = source[m.end() : end]
        if body.endswith("-"):
            body, trim = body[:-1], True
        if close != "#}":
            out.append(("expr" if close == "}}" else "tag", body.strip()))
        at = end + 2
    return out


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "str":
                value = re.sub(r"\\(.)", lambda x: _STRINGS.get(x[1], x[1]), value[1:-1], flags=re.S)
            self.tokens.append((kind, value))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            return self.tokens[self.at][1]
        return None

    def take(self, *values: str) -> str | None:
        found = self.peek(*values)
        self.at += found is not None
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        found = self.tokens[self.at - 1][1]
        if found.startswith("_"):
            raise TemplateError(f"{found} is not allowed")
        return found

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            if op == "not":
                self.need("in")
                node = ("not", ("in", node, self.joined()))
            else:
                node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "~", "-"):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.access()
        while self.take("|"):
            called, args = self.name(), []
            if called not in _FILTERS:
                raise TemplateError(f"there is no filter {called}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    if not self.peek(")"):
                        self.need(",")
            node = ("filter", called, node, *args)
        return node

    def access(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = ("item", node, ("const", self.name()))
            else:
                node = ("item", node, self.either())
                self.need("]")
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "name":
            found = self.name()
            fixed = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return ("const", fixed[found]) if found in fixed else ("name", found)
        self.at += 1
        if kind == "op":
            raise TemplateError(f"unexpected {value!r}")
        return ("const", int(value) if kind == "num" else value)


def parse(source: str) -> tuple:
    """Syntax tree: ('block', nodes) of ('text', s), ('out', e), ('if', [(e, block)], block), ('for', name, e, block), ('set', name, e) and ('generation', block)."""
    tokens = lex(source)
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(tokens):
            kind, body = tokens[at]
            at += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "expr":
                nodes.append(("out", _Expression(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", nodes), body
                if word == "if":
                    cases, other = [], ("block", [])
                    test: tuple | None = _Expression(rest).whole()
                    while True:
                        inner, end = block("elif", "else", "endif") if test is not None else block("endif")
                        if test is None:
                            other = inner
                        else:
                            cases.append((test, inner))
                        if end == "endif":
                            break
                        test = None if end == "else" else _Expression(end.partition(" ")[2]).whole()
                    nodes.append(("if", cases, other))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"for {rest}")
                    inner, _ = block("endfor")
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"set {rest}")
                    nodes.append(("set", m[1], _Expression(m[2]).whole()))
                elif word == "generation":
                    inner, _ = block("endgeneration")
                    nodes.append(("generation", inner))
                else:
                    raise TemplateError(f"there is no tag {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    return block()[0]


# --- values and folding ----------------------------------------------------------------------------------


def _text(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int)):
        return str(x)
    raise TemplateError(f"a {type(x).__name__} cannot be written")


_FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
    "string": _text,
    "default": lambda x, y="": y if x is None else x,
    "replace": lambda x, a, b: _text(x).replace(_text(a), _text(b)),
    "escape": None,  # bound to the control strings when a template is compiled
}
_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b),
}


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions evaluated, decided branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind == "block":
        nodes: list[tuple] = []
        for x in (fold(n, filters) for n in node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + y[1])
                elif y != ("text", ""):
                    nodes.append(y)
        return ("block", nodes)
    if kind == "out":
        e = fold(node[1], filters)
        return ("text", _text(e[1])) if e[0] == "const" else ("out", e)
    if kind == "if":
        cases, other = [], node[2]
        for test, inner in node[1]:
            test = fold(test, filters)
            if test[0] != "const":
                cases.append((test, fold(inner, filters)))
            elif test[1]:
                other = inner
                break
        other = fold(other, filters)
        return ("if", cases, other) if cases else other
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind in ("text", "const", "name"):
        return node
    parts = [fold(x, filters) if isinstance(x, tuple) else x for x in node[1:]]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", expression((kind, *parts), filters)({}))
    if kind == "and" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[0]
    if kind == "or" and parts[0][0] == "const":
        return parts[0] if parts[0][1] else parts[1]
    return (kind, *parts)


def expression(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "item":
        of, key = expression(node[1], filters), expression(node[2], filters)

        def item(env: dict) -> object:
            x, k = of(env), key(env)
            if type(x) is dict:
                return x.get(k)
            if type(x) in (list, tuple, str) and type(k) is int:
                return x[k] if -len(x) <= k < len(x) else None
            if x is None:
                return None
            raise TemplateError(f"no items of a {type(x).__name__}")

        return item
    if kind == "filter":
        f, args = filters[node[1]], [expression(x, filters) for x in node[2:]]
        return lambda env: f(*(a(env) for a in args))
    a = expression(node[1], filters)
    if kind == "not":
        return lambda env: not a(env)
    b = expression(node[2], filters)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    op = _OPS[kind]
    return lambda env: op(a(env), b(env))


Piece = tuple[str, bool]


def closure(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    """A function of names and generation mark that yields pieces."""
    kind = node[0]
    if kind == "block":
        parts = [closure(n, filters) for n in node[1]]

        def block(env: dict, mark: bool) -> Iterator[Piece]:
            for p in parts:
                yield from p(env, mark)

        return block
    if kind == "text":
        text = node[1]

        def fixed(env: dict, mark: bool) -> Iterator[Piece]:
            yield text, mark

        return fixed
    if kind == "out":
        value = expression(node[1], filters)

        def out(env: dict, mark: bool) -> Iterator[Piece]:
            yield _text(value(env)), mark

        return out
    if kind == "if":
        cases, other = [(expression(t, filters), closure(b, filters)) for t, b in node[1]], closure(node[2], filters)

        def choose(env: dict, mark: bool) -> Iterator[Piece]:
            yield from next((b for t, b in cases if t(env)), other)(env, mark)

        return choose
    if kind == "for":
        name, items, inner = node[1], expression(node[2], filters), closure(node[3], filters)

        def loop(env: dict, mark: bool) -> Iterator[Piece]:
            outer = {k: env.get(k) for k in (name, "loop")}
            found = iter(items(env) or ())
            item = next(found, _END)
            i = 0
            while item is not _END:
                after = next(found, _END)
                env[name], env["loop"] = item, {"index0": i, "index": i + 1, "first": i == 0, "last": after is _END}
                yield from inner(env, mark)
                item, i = after, i + 1
            env.update(outer)

        return loop
    if kind == "set":
        name, value = node[1], expression(node[2], filters)

        def assign(env: dict, mark: bool) -> Iterator[Piece]:
            env[name] = value(env)
            yield from ()

        return assign
    inner = closure(node[1], filters)
    return lambda env, mark: inner(env, True)


_END = object()


def compile_template(source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> Callable[..., Iterator[Piece]]:
    """``render(messages=..., **names)`` yields (text, generated); an escaped output is one piece."""
    filters = _FILTERS | {"escape": lambda x, e=escaper(controls)[0]: e(_text(x))}
    run = closure(fold(parse(source), filters), filters)
    return lambda **names: run(dict(names), False)


# --- over tables -----------------------------------------------------------------------------------------

#: Characters after which a conversation's output goes on in a further part.
PART = 1 << 16


def format_conversations(df: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART) -> DataFrame:
    """(conv, part, formatted, loss): the rendered conversation, cut between pieces into parts, and its loss mask.

    ``loss`` holds (start, end) in code points of the part. Rows go by turn, ties by role and text; null texts and
    roles count as empty; rows without a conversation form one of their own; repeated rows are repeated turns. Rows
    are sorted within partitions and streamed, so a conversation of any length needs the memory of one part.
    """
    kind = df.schema[conv].dataType.simpleString()

    def run(batches):
        render = compile_template(template, controls)
        rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for b in batches)
        row = next(rows, None)
        out: list[tuple] = []
        held = 0
        while row is not None:
            key = row[0]

            def turns():
                nonlocal row
                while row is not None and row[0] == key:
                    now, row = row, next(rows, None)
                    yield {"role": now[1], "text": now[2]}

            part, pieces, loss, n = 0, [], [], 0
            for s, mark in render(messages=turns()):
                if mark and s:
                    loss.append((n, n + len(s)))
                pieces.append(s)
                n += len(s)
                if n >= part_chars:
                    out.append((key, part, "".join(pieces), loss))
                    held += n
                    part, pieces, loss, n = part + 1, [], [], 0
                if held > 1 << 22 or len(out) >= 2000:
                    yield _parts(out, conv, kinds)
                    out, held = [], 0
            if n or part == 0:
                out.append((key, part, "".join(pieces), loss))
                held += n
        yield _parts(out, conv, kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(df.schema[conv].dataType)
    picked = df.select(F.col(conv).alias("_conv"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(turn).alias("_turn"))
    dealt = picked.repartition(F.col("_conv")).sortWithinPartitions("_conv", "_turn", "_role", "_text").drop("_turn")
    return dealt.mapInArrow(run, f"`{conv}` {kind}, part int, formatted string, loss array<struct<start:int,end:int>>")


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _parts(rows: list[tuple], conv: str, kind: pa.DataType) -> pa.RecordBatch:
    loss = pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], _SPAN)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), loss], names=[conv, "part", "formatted", "loss"])


_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|<\|role (?P<role>.*?) <\|end\|> (?P<other>.*?) <\|end\|>| (?P<assistant>.*?) </s>", re.S)


def read_turns(buffer: str, start: int = 0) -> Iterator[tuple[str, str, int]]:
    """(role, text, end) of the complete turns in an output of the built-in template from ``start`` on."""
    unescape = escaper()[1]
    at = start
    while m := _TURN.match(buffer, at):
        at = m.end()
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["other"]), at
        else:
            kind = m.lastgroup
            yield kind, unescape(m[kind]), at


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the parts of the built-in template as ``format_conversations`` leaves them (in order, in one partition)."""
    kind = parts.schema[conv].dataType.simpleString()

    def run(batches):
        unescape = escaper()[1]
        rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for b in batches)
        out: list[tuple] = []
        state = None

        def close():
            key, turns, n, loss, n_loss, chars, buffer = state
            if buffer:
                raise ValueError(f"conversation {key}: {buffer[:40]!r} is no turn")
            out.append((key, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))

        for key, part, text, spans in rows:
            if part == 0:
                if state:
                    close()
                state = [key, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, ""]
                begin = len("<s>")
            else:
                begin = 0
            state[5] += len(text)
            for s in spans:
                x = unescape(text[s["start"] : s["end"]])
                state[3].update(x.encode())
                state[4] += len(x)
            buffer, at = state[6] + text[begin:], 0
            for role, said, at in read_turns(buffer):  # noqa: B007
                state[1].update(f"{role}\n{said}\n".encode())
                state[2] += 1
            state[6] = buffer[at:]
            if len(out) >= 5000:
                yield _digests(out, conv, kinds)
                out = []
        if state:
            close()
        yield _digests(out, conv, kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(parts.schema[conv].dataType)
    return parts.mapInArrow(run, f"`{conv}` {kind}, {_DIGEST}")


def _digests(rows: list[tuple], conv: str, kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[conv, *(x.split()[0] for x in _DIGEST.split(", "))])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digest(format_conversations(rows))


def _escaped_length() -> str:
    e = "replace(text, '\\', '\\\\')"
    for c in sorted(CONTROLS, key=len, reverse=True):
        e = f"replace({e}, '{c}', '\\{CONTROLS.index(c)};')"
    return f"length({e})"


OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({_escaped_length()} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE
    24 + {_escaped_length().replace('text', 'role')} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
