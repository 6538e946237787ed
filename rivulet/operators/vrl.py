"""A subset of the Vector Remap Language, compiled to column expressions.

Statements: `.a = expr`, `.a, err = expr`, `. = expr`, `x = expr`, `del(.a)`, `if c { } else if c { } else { }`, `abort`, and a last
expression: `.`, an object, or an array, each element of which becomes a row.
Expressions: paths with fields and indexes, literals, arrays, objects, + - * / %, comparisons, && || !, ??, calls of the functions
below; with ! after the name a call that fails is an error. Everything stays a column, so the program is one projection. What the
subset lacks is refused when the program is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.codecs.json import infer
from rivulet.errors import ProcessError, QueryError
from rivulet.functions.formats import java_pattern
from rivulet.schema import VALUE

TOKEN = re.compile(
    r"""(?P<space>[ \t]+|\#[^\n]*)|(?P<end>[\n;]+)|(?P<number>\d+\.\d+|\d+)|(?P<regex>r'(?:[^'\\]|\\.)*')|(?P<string>"(?:[^"\\]|\\.)*"|s?'(?:[^'\\]|\\.)*')|(?P<path>\.[A-Za-z_][\w.]*|\.(?![\w.]))|(?P<word>[A-Za-z_]\w*!?)|(?P<op>\?\?|==|!=|<=|>=|&&|\|\||[-+*/%<>!=(){},:\[\]])""",
    re.X,
)
#: Binding strength of binary operators.
STRENGTH = {"??": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}


@dataclass
class Value:
    """An expression: its column, and what is known of it: a literal, an object's fields, an array's elements, or JSON text parsed to a variant."""

    column: Column
    literal: object = None
    fields: dict[str, Value] | None = None
    items: list[Value] | None = None
    json: Column | None = None


@dataclass
class Function:
    """plain gives null where it fails, strict an error; without strict a null result of other than null arguments is the error."""

    plain: Callable[..., Column]
    strict: Callable[..., Column] | None = None
    literals: tuple[int, ...] = field(default=())  # arguments that must be literals, and come as such


def quote(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def cast(kind: str) -> Function:
    return Function(lambda x: x.try_cast(kind), lambda x: x.cast(kind))


def timed(strict: bool) -> Callable[[Column, str], Column]:
    return lambda s, pattern: F.to_timestamp(s, java_pattern(pattern)) if strict else F.try_to_timestamp(s, F.lit(java_pattern(pattern)))


FUNCTIONS: dict[str, Function] = {name: f if isinstance(f, Function) else Function(f) for name, f in {
    "upcase": F.upper, "downcase": F.lower, "strip_whitespace": F.trim, "length": F.length, "to_string": lambda x: x.cast("string"), "string": lambda x: x.cast("string"), "to_int": cast("bigint"), "int": cast("bigint"), "parse_int": cast("bigint"),
    "to_float": cast("double"), "float": cast("double"), "parse_float": cast("double"), "to_bool": cast("boolean"), "bool": cast("boolean"), "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "contains": lambda s, x: s.contains(x),
    "starts_with": lambda s, x: s.startswith(x), "ends_with": lambda s, x: s.endswith(x), "replace": lambda s, a, b: F.replace(s, a, b), "split": lambda s, d: F.split(s, quote(d), -1), "join": lambda a, d=None: F.array_join(a, "" if d is None else d),
    "match": Function(lambda s, pattern: s.rlike(pattern), literals=(1,)), "is_null": lambda x: x.isNull(), "exists": lambda x: x.isNotNull(), "now": F.current_timestamp, "md5": lambda x: F.md5(x.cast("binary")), "sha1": lambda x: F.sha1(x.cast("binary")),
    "sha2": lambda x: F.sha2(x.cast("binary"), 512), "truncate": lambda s, n: F.substring(s, F.lit(1), n), "slice": lambda s, a, b: F.substring(s, a + 1, b - a), "encode_base64": lambda s: F.base64(s.cast("binary")),
    "decode_base64": Function(lambda s: F.try_to_binary(s, F.lit("base64")).cast("string"), lambda s: F.unbase64(s).cast("string")), "parse_json": Function(F.try_parse_json, F.parse_json), "encode_json": lambda x: F.to_json(x),
    "parse_timestamp": Function(timed(False), timed(True), literals=(1,)), "format_timestamp": Function(lambda t, pattern: F.date_format(t, java_pattern(pattern)), literals=(1,)), "to_unix_timestamp": lambda t: F.unix_seconds(t),
    "from_unix_timestamp": lambda n: F.timestamp_seconds(n), "push": lambda a, x: F.array_append(a, x), "append": lambda a, b: F.concat(a, b), "unique": F.array_distinct, "includes": lambda a, x: F.array_contains(a, x),
}.items()}


class Compiler:
    """Builds the columns of the result from the source's, statement by statement."""

    def __init__(self, text: str, df: DataFrame, zone: str | None = None):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read the program at {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.df, self.zone = 0, df, zone
        self.fields: dict[str, Value] = {f.name: Value(F.col(f"`{f.name}`")) for f in df.schema.fields}
        self.names: dict[str, Value] = {}
        self.within: list[Column] = []  # the conditions of the branches that a statement is in
        self.aborts: list[Column] = []
        self.result: Value | None = None

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if text is not None and got[1] != text:
            raise QueryError(f"expected {text!r}, found {got[1]!r}")
        self.at += 1
        return got

    def skip(self) -> None:
        while self.peek()[0] == "end":
            self.at += 1

    def program(self, stop: str = "") -> None:
        self.skip()
        while self.peek()[1] != stop:
            if not self.peek()[0]:
                raise QueryError("the program ends inside a block")
            self.statement()
            self.skip()

    def statement(self) -> None:
        self.result = None
        kind, text = self.peek()
        if text == "if":
            return self.branch()
        if text == "abort":
            self.take()
            condition = F.lit(True)
            for c in self.within:
                condition = condition & c
            self.aborts.append(condition)
            return None
        if text == "del":
            self.take()
            self.take("(")
            self.fields.pop(self.flat(self.take()[1]), None)
            self.take(")")
            return None
        second, third = self.peek(1), self.peek(3)
        if kind == "path" and text == "." and second[1] != "=":
            self.take()
            return None
        if kind in ("path", "word") and (second[1] == "=" or (second[1] == "," and third[1] == "=")):
            self.take()
            error = None
            if second[1] == ",":
                self.take(",")
                error = self.take()
            self.take("=")
            value = self.expression()
            self.assign(kind, text, value)
            if error is not None:
                self.assign(*error, Value(F.when(value.column.isNull(), F.lit("the expression failed"))))
            return None
        self.result = self.expression()
        return None

    def flat(self, text: str) -> str:
        name = text[1:]
        if "." in name:
            raise QueryError(f"nested path {text}: the result's values are flat")
        return name

    def assign(self, kind: str, text: str, value: Value) -> None:
        if text == ".":
            self.fields = dict(self.object(value))
        elif kind == "path":
            self.fields[self.flat(text)] = value
        else:
            self.names[text] = value

    def object(self, value: Value) -> dict[str, Value]:
        """An object's fields; those of parsed JSON are the first row's, as its schema is inferred."""
        if value.fields is not None:
            return value.fields
        if value.json is None:
            raise ProcessError("only an object can take the event's place")
        kind = infer(self.df.select(value.json.cast("binary").alias(VALUE)))
        parsed = F.from_json(value.json.cast("string"), kind, {"mode": "FAILFAST"})
        return {f.name: Value(parsed[f.name]) for f in T._parse_datatype_string(kind).fields}

    def branch(self) -> None:
        self.take("if")
        condition = F.coalesce(self.expression().column, F.lit(False))
        before, names = dict(self.fields), dict(self.names)
        self.block(condition)
        yes, yes_names = self.fields, self.names
        self.fields, self.names = dict(before), dict(names)
        if self.peek()[1] == "else":
            self.take()
            if self.peek()[1] == "if":
                self.within.append(~condition)
                self.branch()
                self.within.pop()
            else:
                self.block(~condition)
        none = Value(F.lit(None))
        for mine, other in ((self.fields, yes), (self.names, yes_names)):
            for name in [*other, *[n for n in mine if n not in other]]:
                a, b = other.get(name, none), mine.get(name, none)
                if a is not b:
                    mine[name] = Value(F.when(condition, shown(a)).otherwise(shown(b)))

    def block(self, condition: Column) -> None:
        self.within.append(condition)
        self.take("{")
        self.program("}")
        self.take("}")
        self.within.pop()
        self.result = None

    def expression(self, least: int = 0) -> Value:
        left = self.unary()
        while self.peek()[0] == "op" and STRENGTH.get(self.peek()[1], -1) > least:
            op = self.take()[1]
            left = Value(self.binary(op, left.column, self.expression(STRENGTH[op]).column))
        return left

    def binary(self, op: str, a: Column, b: Column) -> Column:
        if op == "??":
            return F.coalesce(a, b)
        if op == "/":
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.try_mod(a, b)
        table = {"||": a | b, "&&": a & b, "==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b} if op in ("||", "&&", "==", "!=", "<", "<=", ">", ">=") else {}
        if op in table:
            return table[op]
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)

    def unary(self) -> Value:
        kind, text = self.take()
        if text == "!":
            return Value(~self.unary().column)
        if text == "-":
            return Value(-self.unary().column)
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if text == "[":
            return self.array()
        if text == "{":
            return self.literal_object()
        if kind == "number":
            number = float(text) if "." in text else int(text)
            return Value(F.lit(number), number)
        if kind == "regex":
            return Value(F.lit(text[2:-1]), text[2:-1])
        if kind == "string":
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[text.index(text[-1]) + 1 : -1])
            return Value(F.lit(body), body)
        if kind == "path":
            return self.indexed(self.path(text))
        if kind == "word":
            if text in ("true", "false"):
                return Value(F.lit(text == "true"), text == "true")
            if text == "null":
                return Value(F.lit(None))
            if self.peek()[1] == "(":
                return self.indexed(self.call(text))
            if text in self.names:
                return self.indexed(self.names[text])
        raise QueryError(f"the subset has no {text!r} here")

    def path(self, text: str) -> Value:
        if text == ".":
            return Value(F.lit(None), fields=dict(self.fields))
        first, *rest = text[1:].split(".")
        value = self.fields.get(first)
        if value is None:
            return Value(F.lit(None))
        for name in rest:
            value = self.inner(value, name)
        return value

    def inner(self, value: Value, key: str | int) -> Value:
        """A field or an element: of an object, of parsed JSON, or of a struct, a map or an array."""
        if isinstance(key, str) and value.fields is not None:
            return value.fields.get(key, Value(F.lit(None)))
        if isinstance(key, int) and value.items is not None:
            return value.items[key] if key < len(value.items) else Value(F.lit(None))
        if value.json is not None:
            at = f"[{key}]" if isinstance(key, int) else f"['{key}']"
            text = F.get_json_object(value.json.cast("string"), "$" + at)
            return Value(text, json=text)
        return Value(F.get(value.column, key) if isinstance(key, int) else value.column[key])

    def indexed(self, value: Value) -> Value:
        while self.peek()[1] == "[" or (self.peek()[0] == "path" and self.peek()[1] != "."):
            if self.take()[1] != "[":
                for name in self.tokens[self.at - 1][1][1:].split("."):
                    value = self.inner(value, name)
                continue
            kind, text = self.take()
            if kind not in ("number", "string") or "." in text and kind == "number":
                raise QueryError("an index is a number or a string")
            self.take("]")
            value = self.inner(value, int(text) if kind == "number" else text[1:-1])
        return value

    def array(self) -> Value:
        items = []
        self.skip()
        while self.peek()[1] != "]":
            items.append(self.expression())
            self.skip()
            if self.peek()[1] == ",":
                self.take()
            self.skip()
        self.take("]")
        return Value(F.array(*[shown(x) for x in items]), items=items)

    def literal_object(self) -> Value:
        fields: dict[str, Value] = {}
        self.skip()
        while self.peek()[1] != "}":
            kind, name = self.take()
            if kind != "string":
                raise QueryError(f"an object's key is a string, not {name!r}")
            self.take(":")
            fields[name[name.index(name[-1]) + 1 : -1]] = self.expression()
            self.skip()
            if self.peek()[1] == ",":
                self.take()
            self.skip()
        self.take("}")
        return Value(F.struct(*[shown(v).alias(k) for k, v in fields.items()]) if fields else F.lit(None), fields=fields)

    def call(self, word: str) -> Value:
        name, strict = word.rstrip("!"), word.endswith("!")
        if name not in FUNCTIONS and name not in ("merge", "object", "array"):
            raise QueryError(f"the subset has no function {name}")
        self.take("(")
        args: list[Value] = []
        while self.peek()[1] != ")":
            if self.peek()[0] == "word" and self.peek(1)[1] == ":":
                self.at += 2
            args.append(self.expression())
            if self.peek()[1] == ",":
                self.take()
        self.take(")")
        if name in ("object", "array"):
            return args[0]
        if name == "merge":
            fields = {k: v for x in args for k, v in self.object(x).items()}
            return Value(F.struct(*[shown(v).alias(k) for k, v in fields.items()]), fields=fields)
        function = FUNCTIONS[name]
        given = [x.literal if k in function.literals else x.column for k, x in enumerate(args)]
        if any(x is None for k, x in enumerate(given) if k in function.literals):
            raise QueryError(f"{name} takes a literal here")
        try:
            if strict and function.strict:
                column = function.strict(*given)
            else:
                column = function.plain(*given)
                if strict:
                    failed = column.isNull()
                    for x in args:
                        failed = failed & x.column.isNotNull()
                    column = F.when(failed, F.raise_error(F.lit(f"{name} failed"))).otherwise(column)
        except TypeError as e:
            raise QueryError(f"{name}: wrong number of arguments ({len(args)})") from e
        if self.zone and name == "parse_timestamp":
            column = F.to_utc_timestamp(column, self.zone)
        elif self.zone and name == "format_timestamp":
            column = function.plain(F.from_utc_timestamp(given[0], self.zone), given[1])
        return Value(column, json=F.when(column.isNotNull(), given[0]) if name == "parse_json" else None)


def shown(value: Value) -> Column:
    """A value as a column of the result: parsed JSON is JSON text again."""
    if value.json is not None:
        return F.when(value.column.isNotNull(), value.json.cast("string"))
    return value.column


def vrl(statement: str, timezone: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A processor that runs the program on every row; the fields it leaves, or its last expression's, are the result's columns.

    timezone: of timestamps without one; an unknown name counts as none. `abort` is an error of the batch.
    """
    if not statement.strip():
        raise QueryError("the program is empty")
    try:
        zone = timezone and str(ZoneInfo(timezone))
    except (ZoneInfoNotFoundError, ValueError):
        zone = None

    def run(df: DataFrame) -> DataFrame:
        compiler = Compiler(statement, df, zone)
        compiler.program()
        result = compiler.result
        for condition in compiler.aborts:
            df = df.where(F.coalesce(F.when(condition, F.raise_error(F.lit("the program aborted")).cast("boolean")), F.lit(True)))
        if result is not None and result.items is not None:
            if not result.items or any(x.fields is None for x in result.items):
                raise ProcessError("an array of the result must have objects")
            names = list(dict.fromkeys(k for x in result.items for k in x.fields))
            none = Value(F.lit(None))
            return df.select(F.explode(F.array(*[F.struct(*[shown(x.fields.get(n, none)).alias(n) for n in names]) for x in result.items])).alias("_r")).select("_r.*")
        if result is not None and result.fields is None and result.json is None:
            raise ProcessError("the program's result must be an object")
        fields = compiler.fields if result is None else compiler.object(result)
        if not fields:
            raise ProcessError("the program leaves no field")
        return df.select(*[shown(c).alias(n) for n, c in fields.items()])

    return run
