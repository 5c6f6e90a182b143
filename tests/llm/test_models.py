"""Revisits, language models, toxicity and neighbours against brute force or held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dynasql.llm import op02_revisits as revisits
from dynasql.llm import op03_lm_score as lm
from dynasql.llm import op04_toxicity as toxicity
from dynasql.llm import op08_ann as ann

RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_canonical(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#top", "https://example.com/a?a=1&b=2", "example.com", "", None, " https://m.x.org/p/?ref=q ", "https://x.org/?refer=1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r.c for r in df.orderBy("i").select(revisits.canonical(F.col("u")).alias("c")).collect()]
    assert got == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "example.com", None, None, "m.x.org/p", "x.org?refer=1"]


def brute_revisits(rows):
    out = []
    for r in rows:
        if r[3] == "response":
            continue
        before = [x for x in rows if x[1] == r[1] and x[3] == "response" and (x[2] is None or r[2] is not None and x[2] <= r[2])]
        if r[1] is None:
            out.append((r[0], None, "no_url"))
        elif not before:
            out.append((r[0], None, "no_response"))
        else:
            b = max(before, key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
            pair = next(((x, y) for x, y in ((r[4], b[4]), (r[5], b[5]), (r[6], b[6])) if x is not None and y is not None), None)
            reason = "no_validator" if pair is None else "resolved" if pair[0] == pair[1] else "changed"
            out.append((r[0], b[0] if reason == "resolved" else None, reason))
    return sorted(out)


def test_revisits_with_a_hot_url(spark):
    import random

    rnd, rows = random.Random(4), []
    for i in range(900):
        url = "hot.com" if rnd.random() < 0.4 else rnd.choice(["a.com", "b.com", "c.com", None])
        pick = lambda *xs: rnd.choice(xs)
        rows.append((i, url, pick(*range(50), None), pick("response", "revisit", "revisit"), pick("x", "y", None), pick("m", None), pick("d", "e", None), {"Date": str(i), "date": "again", "X-Own": "1"}))
    df = spark.createDataFrame(rows, RECORDS).withColumn("found", F.lit("clash"))
    got = revisits.resolve(df, ranges=7).collect()
    assert sorted((r.record_id, r.response_id, r.reason) for r in got) == brute_revisits(rows)
    for r in got:
        if r.reason == "resolved":
            assert r.headers == {"date": str(r.record_id), "x-own": "1"}
    assert revisits.resolve(df.limit(0)).count() == 0


def test_language_models(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 1)
    texts = ["a b a b a b c", "a b c d", None, "", "x y x y x y", "x y z", "A B new"] * 3
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "x y", "k")], "doc_id long, text string, key string")
    target = spark.createDataFrame([(0,), (1,), (1,), (None,), (999,)], "doc_id long")
    models = lm.fit(docs, target)
    rows = {r.doc_id: r for r in lm.lm_scores(docs, models).collect()}
    assert len(rows) == len(texts) + 1
    assert rows[0].difference < 0 < rows[4].difference and rows[2].difference == 0 == rows[3].n_tokens
    assert rows[0].difference == rows[7].difference

    vocabulary = {w for t in texts for w in (t or "").lower().split()}
    size = len(vocabulary) + 1

    def brute(own, text):
        one, two, starts = Counter(), Counter(), 0
        for i, t in [*enumerate(texts), (None, "x y")]:
            if own and i not in (0, 1) or not (t or "").split():
                continue
            ws = t.lower().split()
            starts += 1
            one.update(ws)
            two.update(zip(["^", *ws], ws))
        one_all = dict(one) | {"^": starts}
        kept = Counter()
        every = Counter()
        for t in [*texts, "x y"]:
            ws = (t or "").lower().split()
            every.update(zip(["^", *ws], ws))
        total, loss = sum(one.values()), 0.0
        context = Counter()
        for (h, w), n in two.items():
            context[h] += n
        mass = Counter()
        for (h, w), n in two.items():
            mass[h] += max(n - lm.DISCOUNT, 0) / max(one_all.get(h, 0), 1, context[h])
        ws = text.lower().split()
        for h, w in zip(["^", *ws], ws):
            p = (one[w] + lm.ADDED) / (total + lm.ADDED * size)
            rest = min(1, max(1e-6, 1 - mass[h]))
            loss -= math.log(max(two[(h, w)] - lm.DISCOUNT, 0) / max(one_all.get(h, 0), 1, context[h]) + rest * p)
        return loss / len(ws)

    for i in (0, 1, 4, 5, 6):
        assert math.isclose(rows[i].target_loss, brute(True, texts[i]), rel_tol=1e-4)
        assert math.isclose(rows[i].background_loss, brute(False, texts[i]), rel_tol=1e-4)
    empty = docs.limit(0)
    assert lm.lm_scores(empty, lm.fit(empty, target)).count() == 0


def test_language_models_keep_every_word(spark):
    """A bigram of words rarer than 70,000 others has its own loss."""
    many = " ".join(f"w{i}" for i in range(70_000))
    texts = [many] * 4 + ["zeta yota"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in lm.lm_scores(docs, lm.fit(docs, docs.filter("doc_id >= 4"))).collect()}
    p = 3.5 / (4 * 70_000 + 6 + 0.5 * 70_003)
    want = -(math.log(2.25 / 7 + (1 - 5.5 / 7) * p) + math.log(0.75 + 0.25 * p)) / 2
    assert rows[4].n_tokens == 2 and math.isclose(rows[4].background_loss, want, rel_tol=1e-6)
    assert rows[4].difference < 0 < rows[0].difference


def brute_segments(scores):
    """Maximal segments by their definition: best run, then what is left of it and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,) * 4)
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return brute_segments(scores[:a]) + [(a, b)] + [(a2 + b, b2 + b) for a2, b2 in brute_segments(scores[b:])]


def test_segments_match_their_definition():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        scores = rnd.integers(-6, 7, rnd.integers(0, 25)) + rnd.random() / 7
        assert [(s, e) for _, s, e in toxicity.segments(scores)] == brute_segments(list(scores))
    assert toxicity.segments(np.full(200_000, 0.5))[0][1:] == (0, 200_000)


def test_toxicity_fits_on_texts_that_share_common_words(spark):
    common = " ".join(f"c{i}" for i in range(300))
    texts = [f"{common} own{i} {'badword' if i % 2 else 'fineword'}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    table = toxicity.fit(docs, labels).table
    assert toxicity.features("badword")[0] in table and toxicity.features("fineword")[0] not in table
    same = spark.createDataFrame([("A b\n c",), (" a  b c ",), ("a b d",)], "t string").select(toxicity.copies(F.col("t")).alias("k")).collect()
    assert same[0] == same[1] != same[2]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.unionByName(labels))
    rows = toxicity.toxicity(docs.withColumn("score", F.lit("clash")), model).join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out").toPandas()
    assert len(rows) and ((rows.score >= 0) & (rows.score <= 1)).all()
    hit = rows[rows.toxic == 1].predicted.mean()
    false = rows[rows.toxic == 0].predicted.mean()
    assert hit > 0.8 and false < 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 100_000)], "doc_id long, text string")
    got = toxicity.toxicity(odd, model).collect()
    assert len(got) == 3 and all(0 <= r.score < 0.5 for r in got)
    assert all(r.score == 0 for r in toxicity.toxicity(odd, toxicity.fit(docs, labels.limit(0))).collect())


def brute_nearest(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
    return ids[order], d[order]


@pytest.mark.parametrize("where", ["sf0.001", "sf0.1"])
def test_ann_recall(spark, where, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 700)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rows = ann.usable(spark.read.parquet(f"/root/testdata/{where}/embeddings.parquet").withColumn("score", F.lit(1)))
    found = ann.nearest(rows, rows.filter("vec_id % 100 = 0")).toPandas()
    data = rows.toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.v.to_numpy())
    hits = total = 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        want, far = brute_nearest(ids, x, q, 10)
        hits, total = hits + len(set(want) & set(g.vec_id)), total + len(want)
        own = np.sqrt(((x[[int(np.flatnonzero(ids == v)[0]) for v in g.vec_id]] - x[ids == q][0]) ** 2).sum(axis=1))
        assert np.allclose(own, g.score, rtol=1e-12) and list(g["rank"]) == list(range(1, 11)) and (np.diff(g.score) >= 0).all()
    assert hits / total >= 0.9


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, []), (7, [1.0, None]), (8, [0.0, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [1.0, 2.0, 4.0])]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, math.sqrt(2)), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, math.sqrt(2)), (200, 1, 9, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_ann_collisions_filter(where="sf0.1"):
    """At the default block size few vectors are verified, and most of the nearest are found."""
    table = pd.read_parquet(f"/root/testdata/{where}/embeddings.parquet").dropna()
    x = np.stack([v for v in table.embedding if len(v) == 64]).astype(float)
    x = np.concatenate([x + np.random.default_rng(i).normal(0, 0.1, x.shape) for i in range(ann.CANDIDATES // len(x))])
    block, ids = ann.Block(np.arange(len(x)), x), np.arange(len(x))
    asked, hits = range(0, len(x), len(x) // 30), 0
    for q in asked:
        found, _ = block.search(q, x[q], 10)
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(found) & set(ids[np.argsort(far)[:10]]))
    assert hits >= 0.9 * 10 * len(asked)
    assert block.verified <= 0.1 * len(x) * len(asked)


def test_ann_repeats_take_part(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 32)
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 2.0]), (7, [1.0, 1.0]), (8, [3.0, 0.0, 1.0])]
    df = ann.cut(ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), repeats=True))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect())
    one = [(100, 1, 100, 0.0), (100, 2, 7, 1.0), (100, 3, 100, math.sqrt(5))]
    other = [(100, 1, 7, math.sqrt(2)), (100, 2, 100, math.sqrt(5)), (100, 3, 100, math.sqrt(5))]
    assert got == sorted(one + one + other)
