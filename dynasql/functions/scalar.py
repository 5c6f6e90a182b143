"""Scalar functions of the dialect, by name, on typed values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .values import NUMERIC, Value, common, compare, integer, number, real, real_text, text, truth

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _numeric(v: Value) -> Column:
    """Operand of a math function: text that is no number, and NaN, are null."""
    x = F.when(text(v).rlike(NUMERIC), F.trim(text(v)).try_cast("double")) if v.kind in ("text", "time") else real(v)
    return F.when(~F.isnan(x), x)


def _math(f: Callable[..., Column]) -> Callable[..., Value]:
    def call(*args: Value) -> Value:
        out = f(*map(_numeric, args))
        return Value(F.when(~F.isnan(out), out), "real")

    return call


def _of_kind(kind: str, f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda *args: Value(f(*args), kind)


def substr(x: Value, start: Value, n: Value | None = None) -> Value:
    """1-based; a negative start counts from the end, and a negative length takes what stands before.

    Positions outside the text take part in the length: from 0, two characters
    are one.
    """
    t = x.c if x.kind == "blob" else text(x)
    size = F.octet_length(t) if x.kind == "blob" else F.length(t)
    s, size = integer(start), size.cast("long")
    begin = F.when(s > 0, s - 1).when(s < 0, size + s).otherwise(F.lit(-1).cast("long"))
    if n is None:
        low, high = begin, size
    else:
        k = integer(n)
        low, high = F.when(k >= 0, begin).otherwise(F.when(s == 0, F.lit(0)).otherwise(begin) + k), F.when(k >= 0, begin + k).otherwise(F.when(s == 0, F.lit(0)).otherwise(begin))
    low, high = F.least(F.greatest(low, F.lit(0)), size), F.least(F.greatest(high, F.lit(0)), size)
    out = F.substring(t, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    return Value(F.when(low.isNotNull() & high.isNotNull(), out), "blob" if x.kind == "blob" else "text")


def _trim(side: str) -> Callable[..., Value]:
    plain = {"trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim}[side]
    return lambda x, chars=None: Value(plain(text(x), F.lit(" ") if chars is None else text(chars)), "text")


def _round(x: Value, d: Value | None = None) -> Value:
    if d is not None and d.literal is None and d.kind != "null":  # digits of each row
        unit = F.pow(F.lit(10.0), F.least(F.greatest(_numeric(d), F.lit(0)), F.lit(30)))
        n = _numeric(x)
        return Value(F.signum(n) * F.floor(F.abs(n) * unit + 0.5) / unit, "real")
    places = 0 if d is None else max(0, int(d.literal or 0))
    return Value(F.round(_numeric(x), min(places, 30)), "real")


def _ceil(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda x: x if x.kind == "int" else Value(f(_numeric(x)).cast("double"), "real")


def _extreme(f: Callable[..., Column]) -> Callable[..., Value]:
    """Of several values: null if any is null, classes in order otherwise."""

    def call(*args: Value) -> Value:
        columns, kind = common(list(args))
        empty = columns[0].isNull()
        for c in columns[1:]:
            empty = empty | c.isNull()
        return Value(F.when(~empty, f(*columns)), kind)

    return call


def coalesce(*args: Value) -> Value:
    columns, kind = common(list(args))
    return Value(F.coalesce(*columns), kind)


def iif(c: Value, a: Value, b: Value | None = None) -> Value:
    from .values import lit

    (x, y), kind = common([a, b or lit(None)])
    return Value(F.when(truth(c), x).otherwise(y), kind)


def nullif(a: Value, b: Value) -> Value:
    return Value(F.when(~F.coalesce(compare("=", a, b), F.lit(False)), a.c), a.kind)


def typeof(v: Value) -> Value:
    name = {"int": "integer", "time": "text"}.get(v.kind, v.kind)
    return Value(F.when(v.c.isNull(), "null").otherwise(name), "text")


def quote(v: Value) -> Value:
    if v.kind == "blob":
        out = F.concat(F.lit("X'"), F.hex(v.c), F.lit("'"))
    elif v.kind in ("int", "real"):
        out = text(v)
    else:
        out = F.concat(F.lit("'"), F.replace(text(v), F.lit("'"), F.lit("''")), F.lit("'"))
    return Value(F.coalesce(out, F.lit("NULL")), "text")


def instr(hay: Value, needle: Value) -> Value:
    if hay.kind == needle.kind == "blob":
        return Value((F.instr(F.hex(hay.c), F.hex(needle.c)) / 2).cast("long"), "int")
    return Value(F.call_function("instr", text(hay), text(needle)).cast("long"), "int")


def char(*codes: Value) -> Value:
    """Text of code points, through their UTF-8 bytes."""

    def one(n: Column) -> Column:
        def byte(x: Column) -> Column:
            return F.lpad(F.hex(x), 2, "0")

        tail = lambda shift: (F.shiftright(n, shift).bitwiseAND(F.lit(63))) + 128
        bytes_ = F.when(n < 0x80, byte(n)).when(n < 0x800, F.concat(byte(F.shiftright(n, 6) + 192), byte(tail(0)))).when(n < 0x10000, F.concat(byte(F.shiftright(n, 12) + 224), byte(tail(6)), byte(tail(0))))
        bytes_ = bytes_.otherwise(F.concat(byte(F.shiftright(n, 18) + 240), byte(tail(12)), byte(tail(6)), byte(tail(0))))
        return F.decode(F.unhex(bytes_), "UTF-8")

    return Value(F.concat(*(one(F.coalesce(integer(c), F.lit(0))) for c in codes)) if codes else F.lit(""), "text")


def length(v: Value) -> Value:
    if v.kind == "blob":
        return Value(F.octet_length(v.c).cast("long"), "int")
    t = text(v)
    return Value(F.length(F.substring_index(t, "\x00", 1)).cast("long"), "int")


def printf(pattern: Value, *args: Value) -> Value:
    """%d %i %u %s %f %e %g %x %X %o %c %q %Q %w %%, with flags, width and precision."""
    import re

    out, rest, last = [], list(args), 0
    source = str(pattern.literal)
    for m in re.finditer(r"%([-+ 0#,]*)(\*|[0-9]+)?(?:\.(\*|[0-9]+))?(?:ll|l)?([a-zA-Z%])", source):
        out.append(F.lit(source[last : m.start()]))
        last = m.end()
        flags, width, precision, verb = m[1], m[2], m[3], m[4]
        if verb == "%":
            out.append(F.lit("%"))
            continue
        if width == "*":
            width = str(rest.pop(0).literal)
        if precision == "*":
            precision = str(rest.pop(0).literal)
        from .values import lit

        arg = rest.pop(0) if rest else lit(0 if verb in "diuxXofeEgG" else "")
        if verb in "diu":
            piece = F.format_string(f"%{flags}{width or ''}d", F.coalesce(integer(arg), F.lit(0).cast("long")))
        elif verb in "xXo":
            piece = F.format_string(f"%{flags.replace('+', '').replace(' ', '').replace(',', '')}{width or ''}{verb}", F.coalesce(integer(arg), F.lit(0).cast("long")))
        elif verb in "feE":
            piece = F.format_string(f"%{flags}{width or ''}.{precision or 6}{verb}", F.coalesce(real(arg), F.lit(0.0)))
            piece = F.upper(piece) if verb == "E" else piece
        elif verb in "gG":
            piece = F.coalesce(real_text(F.format_string(f"%.{max(1, int(precision or 6)) - 1}e", real(arg)).cast("double")), F.lit("0.0"))
            piece = F.regexp_replace(piece, r"\.0$", "")
            piece = F.lpad(piece, max(int(width), 1), " ") if width else piece
        else:
            t = F.coalesce(text(arg), F.lit("NULL" if verb == "Q" else "(NULL)" if verb in "qw" else ""))
            if verb in "qQ":
                t = F.replace(t, F.lit("'"), F.lit("''"))
            if verb == "w":
                t = F.replace(t, F.lit('"'), F.lit('""'))
            if verb == "Q":
                t = F.when(arg.c.isNull(), "NULL").otherwise(F.concat(F.lit("'"), t, F.lit("'")))
            if verb == "c":
                t = F.substring(t, 1, 1)
            if precision is not None:
                t = F.substring(t, 1, int(precision))
            if width:
                pad = F.rpad if "-" in flags else F.lpad
                t = F.when(F.length(t) >= int(width), t).otherwise(pad(t, int(width), " "))
            piece = t
        out.append(piece)
    out.append(F.lit(source[last:]))
    return Value(F.concat(*out), "text")


def _log(a: Value, b: Value | None = None) -> Value:
    if b is None:
        return _math(lambda x: F.when(x > 0, F.log10(x)))(a)
    return _math(lambda base, x: F.when((base > 1) & (x > 0), F.ln(x) / F.ln(base)))(a, b)


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "coalesce": coalesce, "ifnull": coalesce, "nullif": nullif, "iif": iif, "if": iif, "typeof": typeof, "quote": quote,
    "likely": lambda x: x, "unlikely": lambda x: x, "likelihood": lambda x, p: x,
    "length": length, "octet_length": _of_kind("int", lambda x: F.octet_length(x.c if x.kind == "blob" else text(x)).cast("long")),
    "upper": _of_kind("text", lambda x: F.translate(text(x), LOWER, UPPER)), "lower": _of_kind("text", lambda x: F.translate(text(x), UPPER, LOWER)),
    "substr": substr, "substring": substr, "trim": _trim("trim"), "ltrim": _trim("ltrim"), "rtrim": _trim("rtrim"),
    "replace": _of_kind("text", lambda x, a, b: F.when(text(a) == "", text(x)).otherwise(F.replace(text(x), text(a), text(b)))),
    "instr": instr, "concat": _of_kind("text", lambda *a: F.concat_ws("", *map(text, a))),
    "concat_ws": _of_kind("text", lambda s, *a: F.call_function("concat_ws", text(s), *map(text, a))),
    "printf": printf, "format": printf, "char": char,
    "unicode": _of_kind("int", lambda x: F.when(text(x) != "", F.ascii(text(x)).cast("long"))),
    "hex": _of_kind("text", lambda x: F.coalesce(F.hex(x.c if x.kind == "blob" else text(x)), F.lit(""))),
    "unhex": _of_kind("blob", lambda x: F.when(text(x).rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text(x)))),
    "zeroblob": _of_kind("blob", lambda n: F.unhex(F.repeat(F.lit("00"), integer(n).cast("int")))),
    "abs": lambda x: Value(F.abs(number(x).c), number(x).kind), "round": _round,
    "sign": _of_kind("int", lambda x: F.signum(_numeric(x)).cast("long")),
    "ceil": _ceil(F.ceil), "ceiling": _ceil(F.ceil), "floor": _ceil(F.floor),
    "trunc": _ceil(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))),
    "exp": _math(F.exp), "ln": _math(lambda x: F.when(x > 0, F.ln(x))), "log": _log, "log10": _math(lambda x: F.when(x > 0, F.log10(x))), "log2": _math(lambda x: F.when(x > 0, F.log2(x))),
    "sqrt": _math(lambda x: F.when(x >= 0, F.sqrt(x))), "pow": _math(F.pow), "power": _math(F.pow),
    "mod": _math(lambda a, b: F.when(b != 0, F.try_mod(a, b))), "pi": _of_kind("real", lambda: F.lit(math.pi)),
    "sin": _math(F.sin), "cos": _math(F.cos), "tan": _math(F.tan), "asin": _math(F.asin), "acos": _math(F.acos), "atan": _math(F.atan), "atan2": _math(F.atan2),
    "sinh": _math(F.sinh), "cosh": _math(F.cosh), "tanh": _math(F.tanh), "asinh": _math(F.asinh), "acosh": _math(F.acosh), "atanh": _math(F.atanh),
    "degrees": _math(F.degrees), "radians": _math(F.radians),
    "random": _of_kind("int", lambda: ((F.rand() * 2 - 1) * float(1 << 63)).cast("long")),
    "randomblob": _of_kind("blob", lambda n: F.unhex(F.substring(F.repeat(F.replace(F.uuid(), F.lit("-"), F.lit("")), 64), 1, 2 * int(n.literal or 1)))),
    "min": _extreme(F.least), "max": _extreme(F.greatest),
    "current_date": _of_kind("text", lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd")), "current_time": _of_kind("text", lambda: F.date_format(F.current_timestamp(), "HH:mm:ss")),
    "current_timestamp": _of_kind("text", lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")),
} | {n: (lambda *a, n=n: dates.call(n, list(a))) for n in ("date", "time", "datetime", "julianday", "unixepoch", "strftime")}
