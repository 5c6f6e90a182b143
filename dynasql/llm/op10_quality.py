"""Quality rules as a bitmask ledger (operator 10), DataFrame functions only.

Every rule is evaluated once: its measurement is stored and its outcome is one
bit of `failed`. Policies are masks over those bits with a version, so a new
policy, or what each rule alone removes, costs no second pass over the texts.

Defined results: a null text has no words and fails the rules on length; a null
doc_id keeps its row; repeated rows each get a row; texts of any length are
measured whole, in time near-linear in their length. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACES, documents, let, text_of, words

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[#*$%&|<>]"

#: Rules in the order of their bits; each is true where a document fails.
RULES = {
    "few_words": lambda: F.col("n_words") < MIN_WORDS,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 15 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > 6 * F.col("n_lines"),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Policy versions: which failed bits reject a document.
POLICIES = {"base": BIT["few_words"] | BIT["repeated_windows"], "v1": sum(BIT.values())}


#: Places that fit beside a shortened hash in one long.
PLACE_BITS = 20
PLACES = (1 << PLACE_BITS) - 1


def _union(placed: Column) -> Column:
    """Words in windows found twice or more, from (hash, place) in order."""
    twice = F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i + 1)["h"]) | (x["h"] == F.get(placed, i - 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    gaps = let(places, lambda p: F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")


def _covered(hashes: Column) -> Column:
    """Words in windows found twice or more, from the windows' hashes.

    Equal hashes meet by sorting. Longs sort much faster than pairs, so the
    upper bits of each hash are sorted with its place below them; what meets
    there is sorted again as pairs of whole hash and place. Texts with more
    windows than places go to the pairs at once.
    """
    high = F.lit(~PLACES).cast("long")

    def near(packed: Column) -> Column:
        met = F.filter(packed, lambda x, i: (x.bitwiseXOR(F.get(packed, i + 1)).bitwiseAND(high) == 0) | (x.bitwiseXOR(F.get(packed, i - 1)).bitwiseAND(high) == 0))
        return F.transform(met, lambda x: let(x.bitwiseAND(F.lit(PLACES)).cast("int"), lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))

    few = let(F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long")))), near)
    every = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    pairs = F.when(F.size(hashes) <= PLACES, few).otherwise(every)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), _union))


def _repeats(ws: Column) -> Column:
    windows = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return let(windows, _covered)


def _lines(text: Column) -> Column:
    held = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(held, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row's measurements, beside the columns named in keep (doc_id)."""
    text = text_of("text")
    ws = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeats(w).alias("n_repeat_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars")))
    out = docs.select(
        *(keep or ["doc_id"]),
        ws.alias("__w"),
        _lines(text).alias("__l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    return out.withColumns({"n_words": F.col("__w.n_words"), "n_repeat_words": F.col("__w.n_repeat_words"), "word_chars": F.col("__w.word_chars"), "n_lines": F.col("__l.n_lines"), "n_dup_lines": F.col("__l.n_dup_lines")}).drop("__w", "__l")


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Measurements and `failed`, the mask of the rules that a row fails."""
    mask = None
    for name, rule in RULES.items():
        bit = F.when(rule(), F.lit(BIT[name])).otherwise(F.lit(0))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return measured(docs, keep).withColumn("failed", mask)


def passes(policy: str = "v1") -> Column:
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows failing it, rows only it rejects.

    One pass of bitwise aggregation over a ledger, combined map-side.
    """
    used = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))
    names = [n for n in RULES if BIT[n] & POLICIES[policy]]
    sums = [F.sum((used.bitwiseAND(F.lit(BIT[n])) != 0).cast("long")).alias(f"f_{n}") for n in names] + [F.sum((used == BIT[n]).cast("long")).alias(f"o_{n}") for n in names]
    got = rows.agg(*sums, F.coalesce(F.bit_or("failed"), F.lit(0)).alias("seen"))
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(f"f_{n}", F.lit(0)).alias("failing"), F.coalesce(f"o_{n}", F.lit(0)).alias("only_this"), (F.col("seen").bitwiseAND(F.lit(BIT[n])) != 0).alias("seen")) for n in names))
    return got.select(F.explode(each).alias("r")).select("r.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(documents(spark, sf_dir))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes().alias("kept"), "failed")


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that a policy passes, whole, whatever the names of their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return ledger(rows, ["row"]).filter(passes(policy)).select("row.*")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy version and rule of it: documents failing the rule, and those only it rejects."""
    rows, out = ledger(documents(spark, sf_dir)).select("failed"), None
    for policy in POLICIES:
        part = ablation(rows, policy).select(F.lit(policy).alias("policy"), "rule", "failing", "only_this")
        out = part if out is None else out.unionByName(part)
    return out
