"""Cross-entropy difference of matched language models (operator 3).

Two bigram models, one of the target documents and one of all documents, share
one vocabulary, one set of bigrams and one smoothing (absolute discounting,
interpolated with smoothed unigrams), after Moore and Lewis (2010). Each text's
tokens get both losses; their mean difference scores the text, and the lower it
is, the more the text is like the target.

Counts cover all tokens of all rows, and both models hold every word and every
bigram. No table of them exists as rows, and none is broadcast: texts become
chunks of numbered words, a table; each chunk asks for the totals of its
distinct bigrams, in sorted and packed pieces dealt by ranges of their hash; a
range sums its pieces and answers each in its own order. One of the chunks that
hold a bigram is told to count it for its first word, so that a second round of
the same kind, for words, also gives each word's discounted mass. Then each
chunk has all it needs to score its texts. Work and traffic follow the input;
a hot word or bigram is one entry of each chunk.

Words are known by 63-bit hashes, as are bigrams by 64-bit ones.

Defined results: a null or blank text has no tokens, losses of 0 and difference
0; target ids without a document, null ids and repeats of an id change nothing;
without target documents both target terms are uniform; a null doc_id is scored
as background; repeated rows count and are scored each. Extra columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .base import cut, documents, drop, release

#: Least count of a bigram: every bigram.
LEAST = 1
#: Smoothing: discount of bigrams, added count of unigrams.
DISCOUNT, ADDED = 0.75, 0.5
#: Tokens of a chunk, and distinct bigrams or words of a range, about.
CHUNK, RANGE = 2_000_000, 1_000_000
#: Target ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: What stands for the start of a text; words' hashes are larger.
START = 0

CHUNKS = "chunk long, ids array<{kind}>, size long, own_size long, lengths binary, own binary, words binary, places binary"
ASKED = "r long, chunk long, x array<binary>"
ANSWERS = "chunk long, kind int, r long, x array<binary>, fresh long"


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_hash(word: bytes) -> int:
    return (xxh64_intdigest(word) >> 1) or 1


def pack(a: np.ndarray) -> bytes:
    """An array of numbers, its bytes dealt by significance and compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def bigram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each (previous, word), from their hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class _Places(dict):
    """Number of each word of a chunk, from 1 in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) + 1
        return place


def _chunked(kind: pa.DataType):
    """Texts with their ids to rows of CHUNKS; a chunk's words are numbered by order of their hashes, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, places = TaskContext.get().partitionId() << 32, [], 0, _Places()

        def flush() -> pa.RecordBatch:
            hashes, order = np.unique(np.fromiter(map(word_hash, places), np.uint64, len(places)), return_inverse=True)
            lengths = np.array([len(p) for _, _, p in held], np.int64)
            own = np.array([o for _, o, _ in held], np.uint8)
            every = np.concatenate([p for _, _, p in held])
            at = (order + 1).astype(np.uint32)[every - 1] if len(every) else every.astype(np.uint32)
            row = [number, [i for i, _, _ in held], len(every), int(lengths[own == 1].sum()), pack(lengths), pack(own), pack(np.diff(hashes, prepend=np.uint64(0))), pack(at)]
            types = [pa.int64(), pa.list_(kind), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["chunk", "ids", "size", "own_size", "lengths", "own", "words", "places"])

        for batch in batches:
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = tokens(text.as_py() or b"")
                held.append((i, own, np.fromiter(map(places.__getitem__, words), np.int64, len(words))))
                size += len(words) + 1
                if size >= CHUNK:
                    yield flush()
                    number, size = number + 1, 0
                    held.clear(), places.clear()
        if held:
            yield flush()

    return run


class Chunk:
    """A chunk's words and its distinct bigrams, these in order of their keys."""

    def __init__(self, lengths: bytes, own: bytes, words: bytes, places: bytes):
        self.lengths, self.own = unpack(lengths, np.int64), unpack(own, np.uint8)
        self.words = np.concatenate([[np.uint64(START)], np.cumsum(unpack(words, np.uint64), dtype=np.uint64)])
        self.at = unpack(places, np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = (self.ends - self.lengths)[self.lengths > 0]
        before = np.concatenate([[0], self.at[:-1]]) if len(self.at) else self.at
        before[self.starts] = 0
        self.codes = before * len(self.words) + self.at
        found, first = np.unique(self.codes), len(self.words)
        keys = bigram_keys(self.words[found // first], self.words[found % first])
        order = np.argsort(keys, kind="stable")
        self.found, self.order, self.keys = found, order, keys[order]
        self.before, self.word = found[order] // first, found[order] % first

    def pair_counts(self) -> list[np.ndarray]:
        """How often each bigram occurs, in all texts and in those of the target."""
        marks = np.repeat(self.own, self.lengths).astype(bool)
        out = []
        for codes in (self.codes, self.codes[marks]):
            some, n = np.unique(codes, return_counts=True)
            counts = np.zeros(len(self.found), np.uint32)
            counts[np.searchsorted(self.found, some)] = n
            out.append(counts[self.order])
        return out

    def word_counts(self) -> list[np.ndarray]:
        """How often each word occurs; for the start, how many texts do."""
        marks, full = np.repeat(self.own, self.lengths).astype(bool), self.lengths > 0
        out = [np.bincount(x, minlength=len(self.words)).astype(np.float64) for x in (self.at, self.at[marks])]
        out[0][0], out[1][0] = full.sum(), (full & (self.own == 1)).sum()
        return out


def _chunk_of(table: pa.Table | pa.RecordBatch, i: int = 0) -> Chunk:
    return Chunk(*(table.column(c)[i].as_py() for c in ("lengths", "own", "words", "places")))


def _asked(chunk: int, keys: np.ndarray, bits: int, ranges: int, columns: list[np.ndarray]) -> pa.Table:
    """Rows of ASKED: sorted keys and their columns, cut at the ranges of the keys."""
    r = (keys >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(r, prepend=r[:1] + np.uint64(1))).tolist() + [len(keys)] if len(keys) else []
    rows = [(int(r[a]), chunk, [pack(np.diff(keys[a:b], prepend=np.uint64(0))), *(pack(c[a:b]) for c in columns)]) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.binary())))], ["r", "chunk", "x"])


def _answered(kind: int, columns: int, value: type, answer: Callable) -> Callable[[pa.Table], pa.Table]:
    """A function that answers the pieces of one range, each in its own order.

    answer gets the number of each entry's key and the entries' columns.
    """

    def run(table: pa.Table) -> pa.Table:
        pieces = sorted(zip(table.column("chunk").to_pylist(), table.column("x").to_pylist(), strict=True), key=lambda p: p[0])
        keys = [np.cumsum(unpack(x[0], np.uint64), dtype=np.uint64) for _, x in pieces]
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        out = answer(which, len(every), [np.concatenate([unpack(x[i + 1], value) for _, x in pieces]) for i in range(columns)])
        edges = np.cumsum([0, *map(len, keys)])
        r, fresh = table.column("r")[0].as_py(), int((every != START).sum())
        rows = [(c, kind, r, [pack(o[a:b]) for o in out], fresh if a == 0 else 0) for (c, _), a, b in zip(pieces, edges, edges[1:], strict=False)]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.int64())
        return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["chunk", "kind", "r", "x", "fresh"])

    return run


def _pair_totals(least: int) -> Callable:
    def answer(which: np.ndarray, n: int, counts: list[np.ndarray]) -> list[np.ndarray]:
        """Totals of all and target, and whether the entry's chunk counts the bigram: bit 0 for all, 1 for the target."""
        every, target = (np.bincount(which, c, n).astype(np.uint32) for c in counts)
        target[every < least] = 0
        every[every < least] = 0
        counts_it = np.zeros(len(which), np.uint8)
        for bit, entries in ((1, np.arange(len(which))), (2, np.flatnonzero(counts[1]))):
            counts_it[entries[np.unique(which[entries], return_index=True)[1]]] |= bit
        return [every[which], target[which], counts_it]

    return answer


def _word_totals(which: np.ndarray, n: int, sums: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(which, s, n)[which] for s in sums]


def _parts(answers: pa.Table, kind: int, types: list[type]) -> list[np.ndarray]:
    """The answers of one kind, joined in order of their ranges."""
    rows = sorted((r, x) for k, r, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "r", "x")), strict=True) if k == kind)
    return [np.concatenate([unpack(x[i], t) for _, x in rows]) if rows else np.zeros(0, t) for i, t in enumerate(types)]


PAIR_TYPES, WORD_TYPES = [np.uint32, np.uint32, np.uint8], [np.float64] * 6


def _ask_pairs(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("chunk").to_pylist()):
                c = _chunk_of(batch, i)
                yield from _asked(number, c.keys, 64, ranges, c.pair_counts()).to_batches()

    return run


def _ask_words(ranges: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _asked(0, np.zeros(0, np.uint64), 63, ranges, [])
        c = _chunk_of(chunk)
        every, target, counted = _parts(answers, 0, PAIR_TYPES)
        sums = c.word_counts()
        for n, bit in ((every, 1), (target, 2)):
            mine = (counted & bit) > 0
            for value in (np.maximum(n - DISCOUNT, 0), n.astype(np.float64)):
                sums.append(np.bincount(c.before[mine], value[mine], len(c.words)))
        return _asked(chunk.column("chunk")[0].as_py(), c.words, 63, ranges, sums)

    return run


def _scored(kind: pa.DataType, all_tokens: int, own_tokens: int, vocabulary: int):
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]
    types = [kind, pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        c = _chunk_of(chunk)
        pairs, words = _parts(answers, 0, PAIR_TYPES), _parts(answers, 1, WORD_TYPES)
        place = np.empty(len(c.order), np.int64)
        place[c.order] = np.arange(len(c.order))
        place, full, out = place[np.searchsorted(c.found, c.codes)], c.lengths > 0, []
        for i, total in ((1, own_tokens), (0, all_tokens)):
            one, mass, every = words[i], words[2 + 2 * i], words[3 + 2 * i]
            p = (one + ADDED) / (total + ADDED * (vocabulary + 1))
            of = np.maximum(np.maximum(one, 1), every)
            rest = np.clip(1 - mass / of, 1e-6, 1)
            loss = -np.log(np.maximum(pairs[i] - DISCOUNT, 0) / of[c.before] + rest[c.before] * p[c.word])
            means = np.zeros(len(c.lengths))
            if full.any():
                means[full] = np.add.reduceat(loss[place], c.starts) / c.lengths[full]
            out.append(means)
        ids = chunk.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(c.lengths), *map(pa.array, out), pa.array(out[0] - out[1])], names)

    return run


class Models:
    """Both models, as the answers that each chunk of the texts they were fitted on needs."""

    def __init__(self, chunks: DataFrame, answers: DataFrame, sizes: tuple[int, int, int]):
        self.chunks, self.answers, self.sizes = chunks, answers, sizes


def fit(docs: DataFrame, target_ids: DataFrame) -> Models:
    """Both models from all rows of docs; target_ids (doc_id) names the target."""
    spark = docs.sparkSession
    own = cut(target_ids.select("doc_id").filter("doc_id is not null").distinct().withColumn("own", F.lit(True)))
    few = own.count() <= BROADCAST_IDS
    rows = docs.select("doc_id", "text").join(F.broadcast(own) if few else own, "doc_id", "left").select("doc_id", "text", F.coalesce("own", F.lit(False)).alias("own"))
    kind = docs.schema["doc_id"].dataType
    chunks = cut(rows.mapInArrow(_chunked(_arrow(docs)), CHUNKS.format(kind=kind.simpleString())))
    n, own_n = (x or 0 for x in chunks.agg(F.sum("size"), F.sum("own_size")).first())
    ranges = max(1, math.ceil(n / RANGE))
    asked = chunks.mapInArrow(_ask_pairs(ranges), ASKED)
    pairs = cut(asked.groupBy("r").applyInArrow(_answered(0, 2, np.uint32, _pair_totals(LEAST)), ANSWERS))
    release(spark)
    asked = chunks.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(_ask_words(ranges), ASKED)
    words = cut(asked.groupBy("r").applyInArrow(_answered(1, 6, np.float64, _word_totals), ANSWERS))
    release(spark)
    vocabulary = words.agg(F.sum("fresh")).first()[0] or 0
    drop(own)
    return Models(chunks, pairs.union(words), (n, own_n, vocabulary))


def _arrow(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def lm_scores(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference), means over a text's tokens.

    docs are the texts the models were fitted on, which their chunks hold.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, difference double"
    return models.chunks.groupBy("chunk").cogroup(models.answers.groupBy("chunk")).applyInArrow(_scored(_arrow(docs), *models.sizes), schema)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, against those labelled as of good quality."""
    docs = documents(spark, sf_dir)
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return lm_scores(docs, fit(docs, target))
