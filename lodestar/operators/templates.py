"""Prompt templates: a subset of Jinja, rendered for groups of rows.

Statements: if / elif / else, for (with loop.index, index0, first, last,
length), set. Expressions: literals, names with .attribute and [index],
comparisons, and / or / not, + and ~, filters (length, trim, string, safe,
tojson, default, join, items, upper, lower), tests (defined, iterable, string,
mapping, none, number). An unknown filter passes its value through. Output and
loops are limited.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_OUTPUT, MAX_STEPS = 16_000_000, 1_000_000
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+\.\d+|\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>()\[\].,|~+\-*/%:]))""")


class TemplateError(ValueError):
    pass


class Undefined:
    """The value of a name that isn't set: empty text, false, and not defined."""

    def __str__(self):
        return ""

    def __bool__(self):
        return False

    def __iter__(self):
        return iter(())


MISSING = Undefined()


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"unreadable expression: {text[at:at + 30]!r}")
        for kind, value in zip(("str", "num", "name", "op"), m.groups()):
            if value is not None:
                out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    """Expressions to closures over the variables, by precedence."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, value=None):
        t = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return t if value is None else t[1] == value and t[0] in ("op", "name")

    def take(self, value=None):
        t = self.peek()
        if t[0] is None or (value is not None and t[1] != value):
            raise TemplateError(f"expected {value or 'more'} in an expression")
        self.at += 1
        return t

    def whole(self):
        made = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return made

    def either(self):
        a = self.both()
        while self.peek("or"):
            self.take()
            a = (lambda x, y: lambda v: x(v) or y(v))(a, self.both())
        return a

    def both(self):
        a = self.inverse()
        while self.peek("and"):
            self.take()
            a = (lambda x, y: lambda v: x(v) and y(v))(a, self.inverse())
        return a

    def inverse(self):
        if self.peek("not"):
            self.take()
            return (lambda x: lambda v: not x(v))(self.inverse())
        return self.comparison()

    def comparison(self):
        a = self.sum()
        while True:
            op = self.peek()[1]
            if op in ("==", "!=", "<", "<=", ">", ">=") and self.peek()[0] == "op":
                self.take()
                f = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
                a = (lambda f, x, y: lambda v: f(x(v), y(v)))(f, a, self.sum())
            elif self.peek("in"):
                self.take()
                a = (lambda x, y: lambda v: x(v) in y(v))(a, self.sum())
            elif self.peek("is"):
                self.take()
                no = self.peek("not")
                if no:
                    self.take()
                test = TESTS.get(self.take()[1])
                if test is None:
                    raise TemplateError("unknown test")
                a = (lambda x, t, no: lambda v: t(x(v)) != no)(a, test, bool(no))
            else:
                return a

    def sum(self):
        a = self.product()
        while self.peek()[0] == "op" and self.peek()[1] in "+-~":
            op = self.take()[1]
            f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "~": lambda x, y: _text(x) + _text(y)}[op]
            a = (lambda f, x, y: lambda v: f(x(v), y(v)))(f, a, self.product())
        return a

    def product(self):
        a = self.filtered()
        while self.peek()[0] == "op" and self.peek()[1] in "*/%":
            op = self.take()[1]
            f = {"*": lambda x, y: x * y, "/": lambda x, y: x / y, "%": lambda x, y: x % y}[op]
            a = (lambda f, x, y: lambda v: f(x(v), y(v)))(f, a, self.filtered())
        return a

    def filtered(self):
        a = self.atom()
        while self.peek("|"):
            self.take()
            name, args = self.take()[1], []
            if self.peek("("):
                args = self.arguments()
            f = FILTERS.get(name, lambda x, *_: x)
            a = (lambda f, x, args: lambda v: f(x(v), *[g(v) for g in args]))(f, a, args)
        return a

    def arguments(self):
        self.take("(")
        out = []
        while not self.peek(")"):
            out.append(self.either())
            if self.peek(","):
                self.take()
        self.take(")")
        return out

    def atom(self):
        kind, value = self.take()
        if kind == "str":
            text = value[1:-1].encode().decode("unicode_escape") if "\\" in value and value.isascii() else value[1:-1]
            a = lambda v, x=text: x
        elif kind == "num":
            number = float(value) if "." in value else int(value)
            a = lambda v, x=number: x
        elif kind == "name":
            fixed = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            a = (lambda v, x=fixed[value]: x) if value in fixed else (lambda v, n=value: v.get(n, MISSING))
        elif value == "(":
            a = self.either()
            self.take(")")
        elif value == "[":
            items = []
            while not self.peek("]"):
                items.append(self.either())
                if self.peek(","):
                    self.take()
            self.take("]")
            a = lambda v, xs=items: [x(v) for x in xs]
        elif value == "-":
            a = (lambda x: lambda v: -x(v))(self.atom())
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek()[0] == "op" and self.peek()[1] in (".", "["):
            if self.take()[1] == ".":
                name = self.take()[1]
                a = (lambda x, n: lambda v: _get(x(v), n))(a, name)
            else:
                key = self.either()
                self.take("]")
                a = (lambda x, k: lambda v: _get(x(v), k(v)))(a, key)
        return a


def _get(value, key):
    if isinstance(value, dict):
        return value.get(key, MISSING)
    if isinstance(value, (list, str)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return MISSING


def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is MISSING else str(x)


FILTERS = {
    "length": lambda x: 0 if x is MISSING else len(x), "trim": lambda x: _text(x).strip(), "string": _text, "safe": lambda x: x, "tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "default": lambda x, y="": y if x is MISSING or x is None else x, "join": lambda x, y="": _text(y).join(map(_text, x)), "items": lambda x: [list(p) for p in x.items()],
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
}
TESTS = {
    "defined": lambda x: x is not MISSING, "iterable": lambda x: isinstance(x, (list, dict, str)), "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict),
    "none": lambda x: x is None, "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
}


def _block(parts: list[str], at: int, ends: tuple[str, ...]):
    """Nodes up to a closing statement, the statement, and the place after it."""
    nodes = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if part.startswith("{{"):
            f = _Parser(part[2:-2].strip("-")).whole()
            nodes.append(lambda v, out, s, f=f: out.append(_text(f(v))))
        elif part.startswith("{%"):
            text = part[2:-2].strip("-").strip()
            word = text.split(None, 1)[0]
            if word in ends:
                return nodes, text, at
            if word == "if":
                node, at = _if(parts, at, text[2:])
            elif word == "for":
                node, at = _for(parts, at, text[3:])
            elif word == "set":
                name, _, value = text[3:].partition("=")
                f = _Parser(value).whole()
                node = lambda v, out, s, n=name.strip(), f=f: v.__setitem__(n, f(v))
            else:
                raise TemplateError(f"unknown statement: {word}")
            nodes.append(node)
        elif part and not part.startswith("{#"):
            nodes.append(lambda v, out, s, t=part: out.append(t))
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return nodes, "", at


def _run(nodes, v, out, steps):
    for node in nodes:
        steps[0] += 1
        if steps[0] > MAX_STEPS:
            raise TemplateError("too many steps")
        node(v, out, steps)


def _if(parts, at, test):
    cases = []
    while True:
        f = _Parser(test).whole() if test is not None else None
        nodes, end, at = _block(parts, at, ("elif", "else", "endif") if f else ("endif",))
        cases.append((f, nodes))
        if end.startswith("endif"):
            break
        test = end[4:] if end.startswith("elif") else None

    def node(v, out, steps):
        for f, nodes in cases:
            if f is None or f(v):
                return _run(nodes, v, out, steps)

    return node, at


def _for(parts, at, text):
    names, _, source = text.partition(" in ")
    names = [n.strip() for n in names.split(",")]
    f = _Parser(source).whole()
    nodes, end, at = _block(parts, at, ("else", "endfor"))
    other = []
    if end.startswith("else"):
        other, _, at = _block(parts, at, ("endfor",))

    def node(v, out, steps):
        items = list(f(v))
        inner = dict(v)  # names set inside stay inside
        for i, x in enumerate(items):
            inner.update(zip(names, x) if len(names) > 1 else [(names[0], x)])
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            _run(nodes, inner, out, steps)
        if not items:
            _run(other, v, out, steps)

    return node, at


@lru_cache(maxsize=64)
def compile_template(source: str):
    nodes, _, _ = _block(_TAG.split(source), 0, ())

    def render(values: dict) -> str:
        out, steps = [], [0]
        _run(nodes, dict(values), out, steps)
        text = "".join(out)
        if len(text) > MAX_OUTPUT:
            raise TemplateError("too much output")
        return text

    return render


def render_groups(df: DataFrame, by: list[str], order: list[str], fields: list[str], name: str, source: str, to: str) -> DataFrame:
    """One rendered text a group: its rows, as dicts of the fields in order, are the template's list `name`."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    compile_template(source)  # fails here if it is malformed
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("rows"))
    schema = T.StructType([grouped.schema[b] for b in by] + [T.StructField(to, T.StringType())])
    names = to_arrow_schema(schema)

    def run(batches):
        render = compile_template(source)
        for batch in batches:
            texts = [render({name: [{k: v for k, v in r.items() if k in fields and v is not None} for r in rows]}) for rows in batch.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(texts, pa.string())], schema=names)

    return grouped.mapInArrow(run, schema)
