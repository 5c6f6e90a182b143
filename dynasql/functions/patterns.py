"""LIKE and GLOB on literal patterns, as native matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def like(x: Column, pattern: Column | str, escape: str | None = None) -> Column:
    """ASCII letters of either case match each other; % is any text, _ one character."""
    if not isinstance(pattern, str):
        return F.ilike(x, pattern, F.lit(escape)) if escape else F.ilike(x, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))
    if escape is None and not pattern.isascii():
        return _escaped(x, pattern, None)
    if escape is None:
        return x.ilike(pattern.replace("\\", "\\\\"))  # a backslash is an ordinary character
    return _escaped(x, pattern, escape)


def _escaped(x: Column, pattern: str, escape: str | None) -> Column:
    """The pattern as a regular expression, when its escape is not the native one."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return x.rlike(f"(?si)^{out}$")


def glob_regex(pattern: str) -> str | None:
    """A GLOB pattern as a regular expression; None if it can match nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + 1
            invert = pattern[j : j + 1] == "^"
            j += invert
            end = pattern.find("]", j + 1)
            if end < 0:
                return None
            body = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[j:end])
            out += f"[{'^' * invert}{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _glob_by_column(x: Column, pattern: Column) -> Column:
    """GLOB by a pattern of each row: made a regular expression by native replacements."""
    quoted = F.regexp_replace(pattern, r"([\\.$|()+{}]|(?<!\[)\^)", r"\\$1")
    regex = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    unclosed = pattern.rlike(r"\[\^?\]?[^\]]*$")
    return F.when(unclosed, F.when(x.isNotNull(), F.lit(False))).otherwise(F.regexp_like(x, F.concat(F.lit("(?s)^"), regex, F.lit("$"))))


def glob(x: Column, pattern: str | Column) -> Column:
    if not isinstance(pattern, str):
        return _glob_by_column(x, pattern)
    regex = glob_regex(pattern)
    return F.when(x.isNotNull(), F.lit(False)) if regex is None else x.rlike(regex)
