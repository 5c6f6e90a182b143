import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from dynasql.llm import op09_simhash as near
from dynasql.llm import op10_quality as quality
from dynasql.llm.components import components
from dynasql.llm.pigeonhole import block_count, hamming_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


TEXTS = [
    None, "", " \n\t ", "One", "one", "a b c", "A b\xa0c d é", "a b c d e f g h i j", "a b c d e f g h i j", "a b c a b c a b c a b c",
    "x\ny\nx\n\nx\n \n", "tail\x0bof\x0cthe text\r\n" * 3, "w " * 70_000, "# $ % & | < > *" * 3, "ẞ İ K ſ word word word",
]


def find(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORDS.findall(low)
    sh = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_groups(spark, sf):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = TEXTS[:12] + TEXTS[13:] + rows[:60]
    docs = table(spark, texts).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r for r in near.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == dict(enumerate(prints))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert [got[i].component_id for i in range(len(texts))] == find(len(texts), pairs)
    assert near.near_duplicates(docs.limit(0)).count() == 0
    kept = near.keep_one(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got.values()})
    assert kept.columns == docs.columns


def test_keep_one_tells_texts_of_one_id_apart(spark):
    one, two = "the first text of this id is about foxes and dogs", "quite another text of it speaks of ships at sea"
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (1, two), (None, one), (3, two)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in near.keep_one(docs).collect())
    assert kept == sorted([(0, one), (1, one), (1, two)])


@pytest.mark.parametrize("k", [1, 3, 4])
def test_hamming_components_chain_and_hot_bucket(spark, k):
    import random

    rnd = random.Random(k)
    base = rnd.getrandbits(63)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(20), rnd.randrange(0, 7))) for _ in range(300)} | {rnd.getrandbits(63) for _ in range(200)}
    x = rnd.getrandbits(63)
    for _ in range(30):
        x ^= sum(1 << b for b in rnd.sample(range(63), k))
        fps.add(x)
    fps = sorted(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= k]
    tops = find(len(fps), pairs)
    want = defaultdict(set)
    for i, t in enumerate(tops):
        want[t].add(fps[i])
    got = defaultdict(set)
    for r in hamming_components(spark.createDataFrame([(f,) for f in fps] + [(None,)], "fp long"), k).collect():
        got[r.root].add(r.fp)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_block_count_grows():
    assert block_count(0, 4) == 5
    assert block_count(10**9, 4) > block_count(10**5, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 400)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_quality(text):
    text = text or ""
    ws = WORDS.findall(text)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(wins)
    marked = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality(spark, sf):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = TEXTS + rows
    docs = table(spark, texts).withColumn("failed", F.lit("clash"))
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    for i, t in enumerate(texts):
        want, r = brute_quality(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert bool(r.failed & quality.POLICIES["base"]) == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    ab = {r.rule: r for r in quality.ablation(quality.ledger(docs)).collect()}
    for name, bit in quality.BIT.items():
        assert ab[name].failing == sum(bool(r.failed & bit) for r in got.values())
        assert ab[name].only_this == sum(r.failed == bit for r in got.values())
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.failed == 0 for r in got.values())
    assert quality.ablation(quality.ledger(docs.limit(0))).count() == len(quality.RULES)


def test_many_windows(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACES", 15)
    monkeypatch.setattr(quality, "PLACE_BITS", 4)
    texts = ["a b c d e a b c x y a b c d e f g", "q " * 30, "a b c a b c"]
    for r in quality.ledger(table(spark, texts)).collect():
        assert r.n_repeat_words == brute_quality(texts[r.doc_id])[4]


def test_ablation_query(spark, sf):
    from dynasql.llm.queries import QUERIES

    failed = [r.failed for r in quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).select("failed").collect()]
    got = {(r.policy, r.rule): (r.failing, r.only_this) for r in QUERIES["quality_ablation"](spark, sf).collect()}
    want = {(p, n): (sum(bool(f & b) for f in failed), sum(f & mask == b for f in failed)) for p, mask in quality.POLICIES.items() for n, b in quality.BIT.items() if b & mask}
    assert got == want
