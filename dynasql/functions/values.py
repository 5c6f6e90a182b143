"""Values of the dialect: classes, affinity, text and number forms, comparison.

A column here is a Spark Column with a kind: int (long), real (double), text,
blob, time (a timestamp, read as ISO text), or null. Kinds are known when a
query is compiled, so the rules below choose between native expressions once
and nothing dynamic is left in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
REAL_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
INT_PREFIX = r"^\s*([+-]?[0-9]+)"
RANK = {"null": 0, "int": 1, "real": 1, "text": 2, "time": 2, "blob": 3}


@dataclass(frozen=True)
class Value:
    """A typed expression. column: it is a column or CAST, so it has an affinity."""

    c: Column
    kind: str
    column: bool = False
    literal: object = None

    def of(self, c: Column, kind: str | None = None) -> Value:
        return replace(self, c=c, kind=kind or self.kind, column=False, literal=None)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "real"
    if isinstance(t, T.TimestampNTZType | T.TimestampType | T.DateType):
        return "time"
    if isinstance(t, T.BinaryType):
        return "blob"
    return "null" if isinstance(t, T.NullType) else "other" if isinstance(t, T.ArrayType | T.StructType | T.MapType) else "text"


def affinity(declared: str) -> str:
    """Kind for a declared type, by what its name contains, in this order."""
    name = declared.upper().split("(")[0]
    if "INT" in name:
        return "int"
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if not name.strip() or "BLOB" in name:
        return "blob"
    return "real" if any(x in name for x in ("REAL", "FLOA", "DOUB")) else "numeric"


def lit(x: object) -> Value:
    if x is None:
        return Value(F.lit(None), "null")
    if isinstance(x, bool):
        return Value(F.lit(int(x)).cast("long"), "int", literal=int(x))
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), "int", literal=x) if -(1 << 63) <= x < 1 << 63 else Value(F.lit(float(x)), "real", literal=float(x))
    if isinstance(x, float):
        return Value(F.lit(x), "real", literal=x)
    return Value(F.lit(bytearray(x)), "blob", literal=x) if isinstance(x, bytes) else Value(F.lit(str(x)), "text", literal=x)


def real_text(x: Column) -> Column:
    """Text of a double: 15 significant digits, always with a point or exponent."""
    sci = F.format_string("%.14e", x)
    short = sci.cast("double")
    digits = F.regexp_replace(F.regexp_extract(sci, r"^(-?[0-9]\.[0-9]+?)0*e", 1), r"\.$", ".0")
    exponent = F.regexp_replace(F.regexp_extract(sci, r"e([+-][0-9]+)$", 1), r"^([+-])([0-9])$", "$10$2")
    plain = F.regexp_replace(short.cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    size = F.abs(short)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit(None)).when(size == float("inf"), F.when(x > 0, "Inf").otherwise("-Inf")).when((size == 0) | ((size >= 1e-4) & (size < 1e15)), plain).otherwise(F.concat(digits, F.lit("e"), exponent))


def text(v: Value) -> Column:
    if v.kind == "real":
        return real_text(v.c)
    if v.kind == "time":
        return F.date_format(v.c, "yyyy-MM-dd HH:mm:ss")
    return v.c if v.kind == "text" else v.c.cast("string")


def prefix_real(t: Column) -> Column:
    """Number at the front of a text, 0 if none."""
    return F.when(t.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(t, REAL_PREFIX, 1), F.lit("")).try_cast("double"), F.lit(0.0)))


def number(v: Value) -> Value:
    """As an operand of arithmetic."""
    if v.kind in ("int", "real"):
        return v
    if v.kind == "null":
        return Value(F.lit(None).cast("long"), "int")
    if v.literal is not None and str(v.literal).strip().lstrip("+-").isdigit():
        return Value(F.lit(int(str(v.literal))).cast("long"), "int")
    return Value(prefix_real(text(v)), "real")


def integer(v: Value) -> Column:
    """As a 64-bit integer: reals are cut towards zero and held in range, texts by their front."""
    if v.kind == "int":
        return v.c
    if v.kind == "null":
        return F.lit(None).cast("long")
    if v.kind == "real":
        return F.when(v.c >= 9.2233720368547758e18, F.lit((1 << 63) - 1)).when(v.c <= -9.2233720368547758e18, F.lit(-(1 << 63))).otherwise(v.c.try_cast("long"))
    t = text(v)
    return F.when(t.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(t, INT_PREFIX, 1), F.lit("")).try_cast("long"), F.lit(0).cast("long")))


def real(v: Value) -> Column:
    n = number(v)
    return n.c.cast("double")


def truth(v: Value) -> Column:
    """Boolean column, null if the value is null."""
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    n = number(v)
    return (n.c != 0) & ~F.isnan(n.c) if n.kind == "real" else n.c != 0


def flag(condition: Column) -> Value:
    """A condition as 1, 0 or null."""
    return Value(condition.cast("int").cast("long"), "int")


def cast(v: Value, declared: str) -> Value:
    """CAST: never an error; the front of a text counts for numbers."""
    kind = affinity(declared)
    if kind == "text":
        return Value(text(v), "text", True)
    if kind == "int":
        return Value(integer(v), "int", True)
    if kind == "real":
        return Value(real(v), "real", True)
    if kind == "blob":
        return Value(text(v).cast("binary") if v.kind != "blob" else v.c, "blob", True)
    n = number(v)
    return Value(n.c, n.kind, True)


def _order(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "is": a.eqNullSafe(b)}[op]


def compare(op: str, a: Value, b: Value) -> Column:
    """Comparison with affinity, then the order null, numbers, texts, blobs."""
    if "null" in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        return other.c.isNull() if op == "is" else F.lit(None).cast("boolean")
    for x, y, flip in ((a, b, False), (b, a, True)):
        if x.kind == "time" and y.kind == "text" and y.literal is not None:
            when = F.lit(y.literal).try_cast("timestamp_ntz")
            return _order(op, when, x.c) if flip else _order(op, x.c, when)
    if a.kind == b.kind == "time":
        return _order(op, a.c, b.c)
    numeric, texts = ("int", "real"), ("text", "time")
    if a.kind in numeric and b.kind in numeric or a.kind == b.kind == "blob":
        return _order(op, a.c, b.c)
    if a.kind in texts and b.kind in texts:
        return _order(op, text(a), text(b))
    for x, y in ((a, b), (b, a)):
        if x.kind in numeric and y.kind in texts and x.column:  # number column: texts that are numbers whole become numbers
            t = text(y)
            n = F.when(t.rlike(NUMERIC), F.trim(t).try_cast("double"))
            same = _order(op, x.c, n) if x is a else _order(op, n, x.c)
            return F.when(n.isNotNull(), same).otherwise(_by_class(op, a, b))
        if x.kind in texts and x.column and y.kind in numeric and not y.column:  # text column: the other becomes text
            return _order(op, text(a), text(b))
    return _by_class(op, a, b)


def _by_class(op: str, a: Value, b: Value) -> Column:
    x, y = RANK[a.kind], RANK[b.kind]
    sure = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "is": False}[op]
    if op == "is":
        return a.c.isNull() & b.c.isNull()
    return F.when(a.c.isNotNull() & b.c.isNotNull(), F.lit(sure))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    whole = x.kind == y.kind == "int"
    kind = "int" if whole else "real"
    p, q = (x.c, y.c) if whole else (x.c.cast("double"), y.c.cast("double"))
    if op in "+-*":
        return Value({"+": p + q, "-": p - q, "*": p * q}[op], kind)
    if op == "/":
        if whole:
            return Value(F.when(q == -1, -p).when(q != 0, F.call_function("div", p, q)), "int")
        return Value(F.try_divide(p, q), "real")
    i, j = integer(x), integer(y)
    rest = F.when(j == -1, F.lit(0).cast("long")).when(j != 0, i % j)
    return Value(rest if whole else rest.cast("double"), kind)


def bitwise(op: str, a: Value, b: Value) -> Value:
    x, y = integer(a), integer(b)
    if op == "&":
        return Value(x.bitwiseAND(y), "int")
    if op == "|":
        return Value(x.bitwiseOR(y), "int")
    n = F.least(F.greatest(y, F.lit(-64)), F.lit(64)).cast("int")
    if op == ">>":
        n = -n

    def left(k: Column) -> Column:
        return F.when(k >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, k))

    def right(k: Column) -> Column:
        return F.call_function("shiftright", x, F.least(k, F.lit(63)))

    return Value(F.when(x.isNull() | y.isNull(), F.lit(None)).when(n >= 0, left(n)).otherwise(right(-n)), "int")


def concat(a: Value, b: Value) -> Value:
    return Value(F.concat(text(a), text(b)), "text")


def common(values: list[Value]) -> tuple[list[Column], str]:
    """Columns of one type for branches of CASE, COALESCE and the like."""
    kinds = {v.kind for v in values} - {"null"}
    if not kinds:
        return [F.lit(None).cast("long") for _ in values], "int"
    if len(kinds) == 1:
        kind = kinds.pop()
    elif kinds == {"int", "real"}:
        kind = "real"
    else:
        kind = "text"
    form = {"text": text, "real": lambda v: v.c.cast("double"), "int": lambda v: v.c.cast("long")}.get(kind, lambda v: v.c)
    return [F.lit(None) if v.kind == "null" else form(v) for v in values], kind
