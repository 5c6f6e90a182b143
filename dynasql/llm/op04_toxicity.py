"""Toxic passages by maximum-scoring segments (operator 4).

Method. Words and their beginnings (features) get log-odds of toxic against
clean documents under an informative Dirichlet prior; a feature with clear
evidence scores its log-odds, every other word a small negative drift. One
linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa,
1999). By Karlin-Altschul statistics of clean text, with rate lambda and factor
K, a chance segment of score S in n words has expectation K n exp(-lambda S);
segments below SIGNIFICANT are toxic passages. A logistic curve over a text's
best segment, number of passages and score turns them into a probability.

What is learnt: labels from rows whose remainder is not held out, at most
FIT_ROWS for each class, those with the smallest hash of their id, so the ids
to look up and the model are of bounded size; part of them gives the log-odds,
the rest the curve. Everything else covers all rows. No text is shuffled.

Defined results: a null text is empty, and an empty text scores as one without
any passage; without toxic or without clean labels every score is 0; repeated
labels of a document count once, as toxic if any says so; null labels do not
count; a row with a null doc_id is scored and not held out. Extra columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .base import BLANKS, SPACES, cut, documents

#: Labelled rows of each class that the model is fitted on, at most.
FIT_ROWS = 20_000
#: Features kept, at most, by strength of evidence; documents a feature needs.
FEATURES, LEAST_DOCS = 50_000, 3
#: Candidate features, at most, by number of toxic documents.
CANDIDATES = 200_000
#: Beginnings of words that are features beside the word.
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the Dirichlet prior in documents; least log-odds of a feature, and least z of a feature's log-odds (more if many are tried).
PRIOR, LEAST_Z, LEAST_ODDS = 2.0, 2.5, 2.5
#: Score of a word without evidence; expected chance segments of a passage.
DRIFT, SIGNIFICANT = -0.05, 0.05
TOXIC_FROM = 0.7
PUNCTUATION = ".,;:!?\"'()[]{}<>*#|`~…«»“”‘’"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    word = word.strip(PUNCTUATION)
    if not word:
        return []
    return [_hash(word)] + [_hash(f"{word[:n]}-") for n in PREFIXES if n < len(word)]


def _hash(feature: str) -> int:
    h = xxh64_intdigest(feature.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def copies(text: Column) -> Column:
    """Two hashes of a text's words in lower case: the fitted documents of a label with equal ones are copies and count as one."""
    words = F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), SPACES)
    return F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit(1), words).alias("b"))


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _count(wanted: frozenset[int] | None):
    """Documents of each class that hold each (wanted) feature, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        known: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            every = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(every, pa.int64()), *(pa.array([seen[i][f] for f in every], pa.int64()) for i in (0, 1))]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays(columns, ["f", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: set[int] = set()
                for word in set(_words(text)):
                    if word not in known:
                        if len(known) >= Weights.MOST:
                            known.clear()
                        known[word] = [f for f in features(word) if wanted is None or f in wanted]
                    held.update(known[word])
                seen[label].update(held)
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield flush()
        yield flush()

    return run


class Weights(dict):
    """Score of each word, worked out once; from features' log-odds and z."""

    MOST = 300_000

    def __init__(self, table: dict[int, tuple[float, float]]):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        best = max((self.table[f][0] for f in features(word) if f in self.table), default=DRIFT)
        if len(self) < self.MOST:
            self[word] = best
        return best


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in time linear in the scores.

    Ruzzo and Tompa: candidates hold the sums before (left) and behind (right)
    them; a new one is merged back to the nearest candidate with a smaller left
    unless that one's right is not smaller. `back` links candidates to it.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[float, float, int, int, int]] = []  # left, right, start, end, back
    for p in places.tolist():
        left, right, start, end = float(sums[p]), float(sums[p + 1]), p, p + 1
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= right:
                held.append((left, right, start, end, j))
                break
            left, start = held[j][0], held[j][2]
            del held[j:]
    return [(r - a, s, e) for a, r, s, e, _ in held]


def facts(text: str | None, weights: Weights) -> tuple[int, list[tuple[float, int, int]]]:
    words = _words(text)
    found = segments(np.fromiter(map(weights.__getitem__, words), np.float64, len(words)))
    return len(words), found


class Model:
    """Features' log-odds, clean text's lambda and K, and the logistic curve."""

    def __init__(self, table: dict[int, tuple[float, float]]):
        self.table, self.rate, self.k, self.curve = table, 1.0, 1e-4, None

    def inputs(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, float, float]:
        """Best segment against chance, number of passages, best score."""
        chance = math.log(self.k * max(n, 1))
        best = max((s for s, _, _ in found), default=0.0)
        over = [self.rate * s - chance for s, _, _ in found]
        passages = sum(x > -math.log(SIGNIFICANT) for x in over)
        return (max(-5.0, min(30.0, max(over, default=-5.0))) / 10, math.log1p(passages), min(best, 50.0) / 10)

    def score(self, n: int, found: list[tuple[float, int, int]]) -> float:
        if self.curve is None:
            return 0.0
        x = float(np.dot(self.curve, (1.0, *self.inputs(n, found))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def log_odds(counts: list[tuple[int, int, int]], toxic_docs: int, clean_docs: int) -> dict[int, tuple[float, float]]:
    """feature -> (cautious log-odds, z) for rows (feature, clean, toxic) with clear evidence."""
    out = []
    least = max(LEAST_Z, math.sqrt(2 * math.log(max(1, len(counts)))))  # what the best of so many would show by chance
    for f, clean, toxic in counts:
        prior = PRIOR * (clean + toxic) / (clean_docs + toxic_docs)  # informative: as frequent as overall
        a, b = toxic + prior, clean + prior + 0.01
        delta = math.log(a / (toxic_docs + PRIOR - min(a, toxic_docs + PRIOR - 0.5))) - math.log(b / (clean_docs + PRIOR - min(b, clean_docs + PRIOR - 0.5)))
        z = delta / math.sqrt(1 / a + 1 / (b + 0.5))
        if z >= least and delta >= LEAST_ODDS:
            out.append((f, min(delta - delta / z, 8.0), z))  # a standard error below the estimate
    out.sort(key=lambda x: (-x[2], x[0]))
    return {f: (d, z) for f, d, z in out[:FEATURES]}


def clean_rate(scores: Counter) -> float:
    """lambda: the positive root of the mean of exp(lambda s) = 1 over clean words."""
    n = sum(scores.values())
    if not n or max(scores) <= 0:
        return 1.0
    mean = lambda x: sum(c * math.exp(min(50.0, x * s)) for s, c in scores.items()) / n
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(0.05, low)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method for a lightly damped logistic regression; the first input is 1."""
    w = np.zeros(x.shape[1])
    damp = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + damp, x.T @ (y - p) - damp @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels (doc_id, toxic) of rows that are not held out."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    few = None
    for label in (0, 1):
        part = own.filter(F.col("label") == label).orderBy(order, "doc_id").limit(FIT_ROWS)
        few = part if few is None else few.union(part)
    ids = docs.sparkSession.createDataFrame(few.toPandas().astype({"label": "int32"}), own.schema)  # 2 FIT_ROWS ids at most
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(copies(F.col("text")).alias("s"), "label").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    rows = cut(rows.drop("s"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)) < 7
    first, second = rows.filter(part).select("text", "label"), rows.filter(~part).select("text", "label")
    sizes = {r.label: r.n for r in rows.filter(part).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({})
    schema = "f long, clean long, toxic long"
    met = first.filter("label = 1").mapInArrow(_count(None), schema).groupBy("f").agg(F.sum("toxic").alias("toxic"))
    top = met.filter(F.col("toxic") >= LEAST_DOCS).orderBy(F.desc("toxic"), "f").limit(CANDIDATES).toPandas()
    toxic = dict(zip(top.f.tolist(), top.toxic.tolist(), strict=True))
    clean = first.filter("label = 0").mapInArrow(_count(frozenset(toxic)), schema).groupBy("f").agg(F.sum("clean").alias("clean")).toPandas()
    counted = dict(zip(clean.f.tolist(), clean.clean.tolist(), strict=True))
    model = Model(log_odds([(f, counted.get(f, 0), n) for f, n in toxic.items()], sizes[1], sizes[0]))
    table = model.table

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(table)
        for batch in batches:
            got = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = facts(text, weights)
                hits = [weights[w] for w in _words(text)] if label == 0 and found else []
                got.append((label, n, [s for s, _, _ in found], [h for h in hits if h > 0]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*got, strict=True)) or [()] * 4, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["label", "n", "found", "hits"])

    seen = second.mapInArrow(measure, "label int, n long, found array<double>, hits array<double>").toPandas()  # 0.6 FIT_ROWS rows, about
    if seen.label.nunique() < 2:
        return model
    plain = seen[seen.label == 0]
    words = int(plain.n.sum())
    scores = Counter(round(float(h), 1) for hits in plain.hits for h in hits)
    scores[DRIFT] = words - sum(scores.values())
    model.rate = clean_rate(scores)
    model.k = (sum(map(len, plain.found)) + 1) / max(1, words)
    x = np.array([(1.0, *model.inputs(n, [(s, 0, 0) for s in found])) for n, found in zip(seen.n, seen.found, strict=True)])
    model.curve = logistic(x, seen.label.to_numpy(float))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for each row of docs.

    passages lists start-end word numbers of the significant segments.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = Weights(m.table)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(2):
                n, found = facts(text.as_py(), weights)
                scores.append(m.score(n, found))
                chance = math.log(m.k * max(n, 1)) - math.log(SIGNIFICANT)
                passages.append(",".join(f"{s}-{e}" for v, s, e in found if m.rate * v > chance))
            predicted = pa.array([int(s >= TOXIC_FROM) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted, pa.array(passages, pa.string())], ["doc_id", "held_out", "score", "predicted", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
