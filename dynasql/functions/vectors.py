"""Vector distances, quantisation and text chunks as native Columns.

Distances are doubles. l2 is squared and not rooted; the cosine distance of a
zero vector is an error; inner product is negated so that less is nearer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "l1", "cosine", "inner_product")


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(metric: str, a: Column, b: Column) -> Column:
    x, y = doubles(a), doubles(b)
    if metric == "l2":
        out = _sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    elif metric == "l1":
        out = _sum(F.zip_with(x, y, lambda p, q: F.abs(p - q)))
    elif metric == "inner_product":
        out = -dot(x, y)
    elif metric == "cosine":
        size = norm(x) * norm(y)
        out = F.when(size == 0, F.raise_error(F.lit("cosine distance of a zero vector")).cast("double")).otherwise(1 - dot(x, y) / size)
    else:
        raise ValueError(f"unknown metric: {metric}")
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(out)


def valid(v: Column, size: int | None = None) -> Column:
    """Not empty, all components finite, and of the given length."""
    fine = (F.size(v) > 0) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine if size is None else fine & (F.size(v) == size), F.lit(False))


def quantize(v: Column) -> Column:
    """struct(scale, codes): bytes from -127 to 127, scale the largest component over 127."""
    scale = F.array_max(F.transform(doubles(v), lambda x: F.abs(x))) / 127
    codes = F.transform(doubles(v), lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.least(F.round(x / scale), F.lit(127)), F.lit(-127))).cast("tinyint"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda x: x.cast("double") * q["scale"])


def chunks(text: Column, size: int, overlap: int) -> Column:
    """array<struct(index, start, end, text)>: windows of `size` characters, each `overlap` into the last.

    start and end are byte offsets; the last window reaches the end of the text.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to less than size")
    step, n = size - overlap, F.length(text)
    count = F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0)) + 1)

    def one(i: Column) -> Column:
        part = F.substring(text, i * step + 1, F.lit(size))
        start = F.octet_length(F.substring(text, F.lit(1), i * step))
        return F.struct(i.alias("index"), start.alias("start"), (start + F.octet_length(part)).alias("end"), part.alias("text"))

    return F.when(F.coalesce(n > 0, F.lit(False)), F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<struct<index:int,start:int,end:int,text:string>>"))
