"""Date and time functions on ISO texts, Julian days and timestamps.

A time value is a TIMESTAMP_NTZ in UTC. Texts must have whole fields (a month of
one digit is no date); what is no time value is null. Modifiers are literals and
are applied when the query is compiled, each as a native expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Value, real, text

DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
CLOCK = r"[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
STAMP = rf"^\s*({DATE})([ T]+({CLOCK})\s*(Z|[+-][0-9]{{2}}:[0-9]{{2}})?)?\s*$"
TIME = rf"^\s*({CLOCK})\s*(Z|[+-][0-9]{{2}}:[0-9]{{2}})?\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"
SHIFT = re.compile(r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?|[+-]?\.[0-9]+)\s+(second|minute|hour|day|month|year)s?\s*$", re.I)
#: The Julian day of 1970-01-01 00:00, and milliseconds of the units.
EPOCH, DAY_MS = 2440587.5, 86_400_000
UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS}
LEAST_MS, MOST_MS = -62_167_219_200_000, 253_402_300_799_999  # years 0 to 9999


def _stamp(ms: Column) -> Column:
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    inside = F.when((ms >= LEAST_MS) & (ms <= MOST_MS), ms.cast("long"))
    return F.timestamp_add("MILLISECOND", inside, zero)


def millis(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _day_ms(day: Column) -> Column:
    return F.round((day - EPOCH) * DAY_MS).cast("long")


def _of_text(t: Column) -> Column:
    whole = F.regexp_extract(t, STAMP, 1), F.regexp_extract(t, STAMP, 3), F.regexp_extract(t, STAMP, 6)
    alone = F.lit("2000-01-01"), F.regexp_extract(t, TIME, 1), F.regexp_extract(t, TIME, 4)

    def build(day: Column, clock: Column, zone: Column) -> Column:
        ts = F.concat(day, F.lit(" "), F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)).try_cast("timestamp_ntz")
        sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        offset = F.when(F.length(zone) == 6, sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int"))).otherwise(0)
        return F.timestamp_add("MINUTE", -offset, ts)

    days = F.when(t.rlike(NUMBER), _stamp(_day_ms(F.trim(t).try_cast("double"))))
    return F.when(t.rlike(STAMP), build(*whole)).when(t.rlike(TIME), build(*alone)).otherwise(days)


def moment(v: Value, modifiers: list[str]) -> Column:
    """The time value with its modifiers applied, in order."""
    rest = list(modifiers)
    if v.literal is not None and str(v.literal).strip().lower() == "now":
        ts = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSS"))
    elif v.kind == "time":
        ts = v.c.cast("timestamp_ntz")
    elif rest and rest[0].strip().lower() in ("unixepoch", "julianday", "auto") and (v.kind in ("int", "real") or re.match(NUMBER, str(v.literal or ""))):
        n = real(v)
        ts = _stamp(F.round(n * 1000)) if rest.pop(0).strip().lower() == "unixepoch" else _stamp(_day_ms(n))
    elif v.kind in ("int", "real"):
        ts = F.when((v.c >= 0) & (v.c < 5373484.5), _stamp(_day_ms(v.c.cast("double"))))
    else:
        ts = _of_text(text(v))
    for m in rest:
        ts = _modify(ts, m)
    return ts


def _modify(ts: Column, modifier: str) -> Column:
    m = modifier.strip().lower()
    if m in ("utc", "localtime", "subsec"):
        return ts
    if m.startswith("start of ") and m[9:] in ("day", "month", "year"):
        return F.date_trunc(m[9:], ts).cast("timestamp_ntz")
    if re.fullmatch(r"weekday\s+[0-6]", m):
        ahead = F.pmod(F.lit(int(m[-1])) - (F.dayofweek(ts) - 1), F.lit(7))
        return F.timestamp_add("DAY", ahead, ts)
    if found := SHIFT.match(modifier):
        n, unit = float(found[1]), found[2].lower()
        if unit in UNITS:
            return _stamp(millis(ts) + round(n * UNITS[unit]))
        months = int(n) * (12 if unit == "year" else 1)
        total = F.year(ts) * 12 + F.month(ts) - 1 + months
        first = F.make_date(F.floor(total / 12).cast("int"), (F.pmod(total, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
        # a day that the month lacks rolls over into the next one
        within = millis(ts) - millis(F.date_trunc("month", ts).cast("timestamp_ntz"))
        part = round((n - int(n)) * (30 if unit == "month" else 365) * DAY_MS)
        return _stamp(millis(first) + within + part)
    return F.lit(None).cast("timestamp_ntz")


def julian(ts: Column) -> Column:
    return millis(ts) / F.lit(float(DAY_MS)) + EPOCH


def _pad(x: Column, n: int, fill: str = "0") -> Column:
    return F.lpad(x.cast("string"), n, fill)


def _week(ts: Column, first: int) -> Column:
    """Weeks of the year, of which day `first` (0: Sunday) begins one."""
    day = F.pmod(F.dayofweek(ts) - 1 - first, F.lit(7))
    return F.floor((F.dayofyear(ts) - 1 + 7 - day) / 7)


def strftime(pattern: str, ts: Column) -> Column:
    hour = F.hour(ts)
    twelve = F.pmod(hour + 11, F.lit(12)) + 1
    half = F.when(hour < 12, "AM").otherwise("PM")
    two = {"d": F.dayofmonth(ts), "H": hour, "I": twelve, "m": F.month(ts), "M": F.minute(ts), "S": F.second(ts).cast("int"), "V": F.weekofyear(ts), "U": _week(ts, 0), "W": _week(ts, 1)}
    iso_year = F.extract(F.lit("YEAROFWEEK"), ts)
    parts = {k: _pad(x, 2) for k, x in two.items()} | {
        "e": _pad(F.dayofmonth(ts), 2, " "), "k": _pad(hour, 2, " "), "l": _pad(twelve, 2, " "), "f": F.date_format(ts, "ss.SSS"), "F": F.date_format(ts, "yyyy-MM-dd"), "T": F.date_format(ts, "HH:mm:ss"),
        "R": F.date_format(ts, "HH:mm"), "j": _pad(F.dayofyear(ts), 3), "J": julian(ts).cast("string"), "p": half, "P": F.lower(half), "s": F.floor(millis(ts) / 1000).cast("string"),
        "w": (F.dayofweek(ts) - 1).cast("string"), "u": (F.pmod(F.dayofweek(ts) + 5, F.lit(7)) + 1).cast("string"), "Y": _pad(F.year(ts), 4), "G": _pad(iso_year, 4), "g": _pad(F.pmod(iso_year, F.lit(100)), 2), "%": F.lit("%"),
    }
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "%":
            if pattern[i + 1 : i + 2] not in parts:
                return F.lit(None).cast("string")
            out.append(parts[pattern[i + 1]])
            i += 2
        else:
            j = pattern.find("%", i)
            j = len(pattern) if j < 0 else j
            out.append(F.lit(pattern[i:j]))
            i = j
    return F.when(ts.isNotNull(), F.concat(*out) if out else F.lit(""))


def call(name: str, args: list[Value]) -> Value:
    """date, time, datetime, julianday, unixepoch and strftime."""
    from .values import lit

    pattern = None
    if name == "strftime":
        pattern, args = args[0].literal, args[1:]
    v = args[0] if args else lit("now")
    mods = [a.literal for a in args[1:]]
    ts = moment(v, mods) if all(isinstance(m, str) for m in mods) else F.lit(None).cast("timestamp_ntz")
    if name == "strftime":
        return Value(strftime(str(pattern), ts) if pattern is not None else F.lit(None).cast("string"), "text")
    if name == "julianday":
        return Value(julian(ts), "real")
    if name == "unixepoch":
        return Value(F.floor(millis(ts) / 1000).cast("long"), "int")
    return Value(F.date_format(ts, {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}[name]), "text")
