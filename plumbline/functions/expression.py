"""The field-calculator language, compiled to Spark columns.

Literals, ``true``, ``false``, ``null``, field names (bare or in brackets, case-sensitive),
calls (names in any case), unary ``-``, ``+`` and ``not``, and binary operators, which are
left-associative: ``or`` < ``and`` < comparison < ``+ -`` < ``* / %``.

Values are text, numbers, booleans or null. Types are known when an expression is compiled,
so every expression becomes one Catalyst tree: filters on it reach the scan, and no Python
runs per row. Where operands are of different types the rules are the calculator's, not
SQL's: ``and``/``or`` treat null as false, ``null = null`` is true, division by zero is
null, text that reads as a number compares as one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, TEXT, BOOLEAN, NULL = "number", "text", "boolean", "null"
_NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


class ExpressionError(ValueError):
    """What is wrong with an expression, for people to read."""


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str


@dataclass
class Compiled:
    source: str
    value: Value
    fields: list[str] = field(default_factory=list)

    @property
    def column(self) -> Column:
        return self.value.col

    @property
    def condition(self) -> Column:
        """Never null: whether a row passes a filter of this expression."""
        return truthy(self.value)


def to_number(v: Value) -> Column:
    """A number, or null; booleans are 0 and 1, text must read as a number in whole."""
    if v.kind == NUMBER:
        return F.when(~F.isnan(v.col) & (F.abs(v.col) != float("inf")), v.col)
    if v.kind == BOOLEAN:
        return v.col.cast("double")
    if v.kind == NULL:
        return F.lit(None).cast("double")
    s = F.regexp_replace(v.col, r"^\s+|\s+$", "")
    return F.when(s.rlike(_NUMERIC), s.try_cast("double"))


def to_text(v: Value) -> Column:
    """Text as it is written: whole numbers have no fraction."""
    if v.kind == TEXT:
        return v.col
    if v.kind == NUMBER:
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("bigint").cast("string")).otherwise(v.col.cast("string"))
    return v.col.cast("string")


def truthy(v: Value) -> Column:
    if v.kind == NUMBER:
        return F.coalesce((v.col != 0) & ~F.isnan(v.col), F.lit(False))
    if v.kind == BOOLEAN:
        return F.coalesce(v.col, F.lit(False))
    if v.kind == TEXT:
        return F.coalesce((v.col != "") & (v.col != "false"), F.lit(False))
    return F.lit(False)


def _number(c: Column) -> Value:
    return Value(c.cast("double"), NUMBER)


def _same(*values: Value) -> tuple[list[Column], str]:
    """Values brought to one type: their own if they share it, else text."""
    kinds = {v.kind for v in values} - {NULL}
    if len(kinds) > 1:
        return [to_text(v) for v in values], TEXT
    kind = kinds.pop() if kinds else NULL
    name = {NUMBER: "double", TEXT: "string", BOOLEAN: "boolean", NULL: "string"}[kind]
    return [v.col.cast(name) for v in values], kind


def _filled(v: Value) -> Column:
    """Null where a value is null or empty text."""
    return F.when(v.col != "", v.col) if v.kind == TEXT else v.col


def _rounded(x: Value, digits: Value | None = None) -> Value:
    n, d = to_number(x), to_number(digits) if digits else F.lit(0.0)
    scale = F.pow(F.lit(10.0), F.least(F.greatest(F.floor(d), F.lit(0)), F.lit(15)).cast("double"))
    # Halves go up, also below zero.
    return _number(F.floor(n * scale + 0.5) / scale)


def _least_or_greatest(f: Callable) -> Callable:
    def g(*values: Value) -> Value:
        numbers = [to_number(v) for v in values]
        return _number(numbers[0] if len(numbers) == 1 else f(*numbers))

    return g


def _text(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: Value(f(to_text(v)), TEXT)


def _substr(s: Value, start: Value, n: Value | None = None) -> Value:
    first = F.greatest(F.coalesce(to_number(start), F.lit(1.0)), F.lit(1.0)).cast("int")
    size = F.lit(1 << 30) if n is None else F.greatest(to_number(n), F.lit(0.0)).cast("int")
    return Value(F.substring(to_text(s), first, size), TEXT)


def _if(c: Value, a: Value, b: Value) -> Value:
    (x, y), kind = _same(a, b)
    return Value(F.when(truthy(c), x).otherwise(y), kind)


def _first_filled(*values: Value) -> Value:
    cols, kind = _same(*values)
    return Value(F.coalesce(*[_filled(Value(c, kind)) for c in cols]), kind)


#: Name: (least, most arguments, function). These are the language's functions.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "round": (1, 2, _rounded),
    "floor": (1, 1, lambda x: _number(F.floor(to_number(x)))),
    "ceil": (1, 1, lambda x: _number(F.ceil(to_number(x)))),
    "abs": (1, 1, lambda x: _number(F.abs(to_number(x)))),
    "sqrt": (1, 1, lambda x: _number(F.when(to_number(x) >= 0, F.sqrt(to_number(x))))),
    "min": (1, 32, _least_or_greatest(F.least)),
    "max": (1, 32, _least_or_greatest(F.greatest)),
    "upper": (1, 1, _text(F.upper)),
    "lower": (1, 1, _text(F.lower)),
    "trim": (1, 1, _text(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))),
    "len": (1, 1, lambda s: _number(F.length(to_text(s)))),
    "concat": (1, 32, lambda *v: Value(F.concat(*[F.coalesce(to_text(x), F.lit("")) for x in v]), TEXT)),
    "substr": (2, 3, _substr),
    "replace": (3, 3, lambda s, a, b: Value(F.replace(to_text(s), to_text(a), to_text(b)), TEXT)),
    "isnull": (1, 1, lambda x: Value(_filled(x).isNull(), BOOLEAN)),
    "coalesce": (1, 32, _first_filled),
    "if": (3, 3, _if),
    "number": (1, 1, lambda x: _number(to_number(x))),
    "text": (1, 1, lambda x: Value(to_text(x), TEXT)),
}


def _add(a: Value, b: Value) -> Value:
    x, y = to_number(a), to_number(b)
    if TEXT not in (a.kind, b.kind):
        return _number(x + y)
    joined = F.concat(F.coalesce(to_text(a), F.lit("")), F.coalesce(to_text(b), F.lit("")))
    return Value(F.when(x.isNotNull() & y.isNotNull(), to_text(_number(x + y))).otherwise(joined), TEXT)


def _arithmetic(f: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    return lambda a, b: _number(f(to_number(a), to_number(b)))


def _equal(a: Value, b: Value) -> Column:
    if a.kind == b.kind and a.kind in (NUMBER, BOOLEAN):
        return a.col.eqNullSafe(b.col)
    x, y = to_number(a), to_number(b)
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(to_text(a) == to_text(b))
    return F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(same)


def _ordered(f: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    def g(a: Value, b: Value) -> Value:
        if a.kind == b.kind == NUMBER:
            return Value(f(a.col, b.col), BOOLEAN)
        x, y = to_number(a), to_number(b)
        return Value(F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(f(to_text(a), to_text(b))), BOOLEAN)

    return g


_BINARY: dict[str, Callable[[Value, Value], Value]] = {
    "or": lambda a, b: Value(truthy(a) | truthy(b), BOOLEAN),
    "and": lambda a, b: Value(truthy(a) & truthy(b), BOOLEAN),
    "=": lambda a, b: Value(_equal(a, b), BOOLEAN),
    "<>": lambda a, b: Value(~_equal(a, b), BOOLEAN),
    "<": _ordered(lambda x, y: x < y),
    ">": _ordered(lambda x, y: x > y),
    "<=": _ordered(lambda x, y: x <= y),
    ">=": _ordered(lambda x, y: x >= y),
    "+": _add,
    "-": _arithmetic(lambda x, y: x - y),
    "*": _arithmetic(lambda x, y: x * y),
    "/": _arithmetic(lambda x, y: F.try_divide(x, y)),
    "%": _arithmetic(lambda x, y: F.when(y != 0, x % y)),
}
_ALIASES = {"==": "=", "!=": "<>"}
_LEVELS = [("or",), ("and",), ("=", "<>", "<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%")]

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.?\d*|\.\d+)|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|\[(?P<field>[^\]]*)\]"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<sign><=|>=|==|!=|<>|[-+*/%=<>(),]))""",
    re.VERBOSE,
)


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"cannot read {source[at:].strip()[:12]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(name: str, known: list[str]) -> str | None:
    """The known name within two edits that is nearest, for suggestions."""
    best = min(known, key=lambda k: (_distance(name, k), k), default=None)
    return best if best is not None and _distance(name, best) <= 2 else None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    return NULL if isinstance(t, T.NullType) else TEXT


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], schema: T.StructType):
        self.tokens, self.at, self.schema = tokens, 0, schema
        self.fields: dict[str, None] = {}

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def operator(self) -> str:
        kind, s = self.peek()
        word = s.lower() if kind == "name" else s if kind == "sign" else ""
        return _ALIASES.get(word, word)

    def binary(self, level: int = 0) -> Value:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.operator() in _LEVELS[level]:
            op = self.operator()
            self.take()
            left = _BINARY[op](left, self.binary(level + 1))
        return left

    def unary(self) -> Value:
        op = self.operator()
        if op in ("-", "+", "not"):
            self.take()
            v = self.unary()
            if op == "not":
                return Value(~truthy(v), BOOLEAN)
            return _number(0 - to_number(v) if op == "-" else to_number(v))
        return self.primary()

    def primary(self) -> Value:
        kind, s = self.take()
        if kind == "number":
            return Value(F.lit(float(s)), NUMBER)
        if kind == "text":
            return Value(F.lit(re.sub(r"\\(.)", r"\1", s[1:-1])), TEXT)
        if kind == "field":
            return self.field(s)
        if kind == "sign" and s == "(":
            v = self.binary()
            self.expect(")")
            return v
        if kind == "name":
            if self.peek() == ("sign", "("):
                return self.call(s)
            word = s.lower()
            if word in ("true", "false"):
                return Value(F.lit(word == "true"), BOOLEAN)
            if word == "null":
                return Value(F.lit(None).cast("string"), NULL)
            return self.field(s)
        raise ExpressionError("the expression ends too early" if kind == "end" else f"{s!r} is out of place")

    def expect(self, sign: str) -> None:
        if self.take() != ("sign", sign):
            raise ExpressionError(f"{sign!r} is missing")

    def field(self, name: str) -> Value:
        found = next((f for f in self.schema.fields if f.name == name), None)
        if found is None:
            hint = nearest(name, self.schema.fieldNames())
            raise ExpressionError(f"there is no field {name!r}" + (f"; did you mean {hint!r}?" if hint else ""))
        self.fields[name] = None
        kind = kind_of(found.dataType)
        cast = {NUMBER: "double", TEXT: "string", BOOLEAN: "boolean", NULL: "string"}[kind]
        return Value(F.col(f"`{name}`").cast(cast), kind)

    def call(self, name: str) -> Value:
        self.take()
        args = []
        while self.peek() != ("sign", ")"):
            args.append(self.binary())
            if self.peek() == ("sign", ","):
                self.take()
            elif self.peek() != ("sign", ")"):
                raise ExpressionError("')' is missing")
        self.take()
        if name.lower() not in FUNCTIONS:
            hint = nearest(name.lower(), list(FUNCTIONS))
            raise ExpressionError(f"there is no function {name!r}" + (f"; did you mean {hint!r}?" if hint else ""))
        least, most, f = FUNCTIONS[name.lower()]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} values, not {len(args)}")
        return f(*args)


def compile_expression(source: str, schema: T.StructType) -> Compiled:
    """Compiles for rows of a schema; raises ``ExpressionError``."""
    parser = _Parser(_tokens(source), schema)
    if not parser.tokens:
        raise ExpressionError("the expression is empty")
    value = parser.binary()
    if parser.peek()[0] != "end":
        raise ExpressionError(f"{parser.peek()[1]!r} is out of place")
    return Compiled(source, value, list(parser.fields))


def check_expression(source: str, schema: T.StructType) -> str | None:
    """What is wrong with an expression, or None."""
    try:
        compile_expression(source, schema)
    except ExpressionError as e:
        return str(e)
    return None


def filtered(df: DataFrame, source: str) -> DataFrame:
    """The rows for which the expression is true; none where it can't be read."""
    try:
        return df.where(compile_expression(source, df.schema).condition)
    except ExpressionError:
        return df.where(F.lit(False))
