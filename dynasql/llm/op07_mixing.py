"""Mixing sources to target weights by pivotal dependent rounding (operator 7).

Every document starts with its source's expected number of copies, target over
source size. The whole part is taken; the fraction is a copy probability.
Pairs of fractions of one source exchange mass, measured in words, in a random
direction until one of the two is 0 or 1, so the expected copies of each
document stay as they were and the words of the source stay at their target.
What is left is one fraction at most for each leaf; leaves are combined through
a reduction tree until each source has one, which is rounded at random.

Leaves are hash groups of a bounded size, so a source with a third of all rows
is many leaves; every level is grouped by (source, leaf) and holds few rows for
each. All randomness comes from hashes of the seed, source and leaf, and rows
are put in order first, so reruns agree and a lost task repeats itself.

Defined results: a null text has size 0; documents of size 0 take nothing; a
null source is a source of its own, after all others; a null doc_id is a
document like any other; equal rows are interchangeable. A source of size 0 has
target 0. Extra columns are not read.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .base import cut, documents, word_count

#: Weights by a source's place, repeating; size of the mix; cap.
WEIGHTS, SHARE_PERCENT, CAP = (5, 2, 1), 150, 2
#: Rows of a leaf, about; leaves that meet at each level of the tree.
LEAF_ROWS, FAN_IN = 4096, 64
SEED = 7


def targets(sizes: DataFrame) -> DataFrame:
    """(source, place, source_size, rows, target) from rows (source, size).

    Sharing the excess again and again ends where every source below its cap
    has the same target for each unit of weight. Taken in order of cap over
    weight, a source is at its cap if sharing what earlier ones leave would
    give it more than that. Only this table, of one row for each source, is
    ordered as a whole.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    every = Window.partitionBy()
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    src = src.withColumn("place", place).withColumn("w", weight).withColumn("cap", (CAP * F.col("source_size")).cast("double"))
    order = every.orderBy((F.col("cap") / F.col("w")).asc(), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * (SHARE_PERCENT / 100)
    unit = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    src = src.withColumn("unit", unit).withColumn("full", F.col("unit") * F.col("w") >= F.col("cap"))
    # beyond the first source that is not at its cap, the unit no longer changes
    src = src.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "place", "unit"))).over(every)["unit"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return src.select("source", F.col("place").cast("int").alias("place"), "source_size", "rows", target.alias("target"))


def exchange(p: float, a: int, q: float, b: int, u: float) -> tuple[float, float]:
    """One pivotal step between fractions p and q of sizes a and b; u in [0, 1)."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:  # up with the chance that keeps expectations
        return (1.0 if up == (1 - p) * a else p + up / a), (0.0 if up == q * b else q - up / b)
    return (0.0 if down == p * a else p - down / a), (1.0 if down == (1 - q) * b else q + down / b)


def settle(rows: list[tuple[float, int]], rnd: random.Random, last: bool) -> list[float]:
    """Round fractions of documents of positive size; one may stay unless last."""
    out = [p for p, _ in rows]
    held = -1
    for i, (p, size) in enumerate(rows):
        if p in (0.0, 1.0):
            continue
        if held < 0:
            held = i
            continue
        h = held
        out[h], out[i] = exchange(out[h], rows[h][1], p, size, rnd.random())
        held = h if 0 < out[h] < 1 else i if 0 < out[i] < 1 else -1
    if last and held >= 0:
        out[held] = float(rnd.random() < out[held])
    return out


def _level(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "k"], ascending=[False, True], kind="stable")
        seed = f"{SEED}|{group.place.iloc[0]}|{group.leaf.iloc[0]}|{len(group)}|{last}"
        rnd = random.Random(xxh64_intdigest(seed.encode()))
        return group.assign(p=settle(list(zip(group.p, group["size"], strict=True)), rnd, last))

    return run


def copies(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(k, doc_id, source, size, place, source_size, target, copies) for each row.

    k is a hash of doc_id and key (the row's identity for ties).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    k = F.xxhash64("doc_id", *([key] if key is not None else []))
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), k.alias("k")))
    src = cut(targets(sizes))
    most = src.agg(F.max("rows")).first()[0] or 0
    leaves = 1
    while leaves * LEAF_ROWS < most:
        leaves *= FAN_IN
    s, t = sizes.alias("s"), src.alias("t")
    rows = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.place", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
    rows = rows.withColumns({"p": F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)), "leaf": F.pmod(F.xxhash64("k", "size"), F.lit(leaves))})
    rows = rows.select("k", "doc_id", "source", "size", "place", "source_size", "target", "whole", "p", "leaf")
    schema = f"k long, doc_id {kind}, source string, size long, place int, source_size long, target double, whole int, p double, leaf long"
    done = None
    while True:
        rows = cut(rows.groupBy("place", "leaf").applyInPandas(_level(leaves == 1), schema))
        whole = rows.filter("p in (0.0, 1.0)")
        done = whole if done is None else done.union(whole)
        if leaves == 1:
            break
        leaves //= FAN_IN
        rows = rows.filter("p not in (0.0, 1.0)").withColumn("leaf", F.pmod("leaf", F.lit(leaves)))
    return done.select("k", "doc_id", "source", "size", "place", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, whatever other columns they have.

    Equal rows share their copies; a row is found again by doc_id and a hash of
    text, source and the other columns that can be hashed, and by its number
    among rows equal in these.
    """
    other = F.xxhash64(*(c for c, kind in docs.dtypes if c != "doc_id" and "map<" not in kind and "variant" not in kind))
    ranked = copies(docs, other).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("copies")))).select("k", "n", "copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", other).alias("k"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("k")))
    found = rows.join(ranked.filter("copies > 0"), ["k", "n"])
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
