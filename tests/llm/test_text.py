"""Packing, mixing, secrets, lines and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dynasql.llm import op01_packing as packing
from dynasql.llm import op05_secrets as secrets
from dynasql.llm import op06_lines as fuzzy
from dynasql.llm import op07_mixing as mixing
from dynasql.llm.encode import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]


ODD = [None, "", " ", "a", " a b\n\n c", "x\ty  z  q \n", "don't WON'T 123 4567 <|endoftext|> é́ 漢字 😀😀", "b" * 5000, "tail \n", "\r\n\r\n a", "\x1c a\x85b 　c", "q " * 9000]


def test_ids_equal_the_tokenizers(corpus):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    coder = encoder()
    for text in [x or "" for x in ODD] + corpus:
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def check_pieces(rows, whole, tokens, segments, loss, prompts=None):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(whole)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = whole[d][4 * at : 4 * (at + r.length)]
            assert r.start == at and r.length > 0 and r.ids == ids and zlib.crc32(ids) == r.ids_crc32 and r.doc_tokens == len(whole[d]) // 4
            at += r.length
        assert at * 4 == len(whole[d])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(pieces) <= segments and sum(r.loss_tokens for r in pieces) <= loss
        padding += tokens - at if at & (at - 1) else 0
    return padding


def test_packing_round_trip(spark, corpus):
    texts = ODD + corpus
    coder = encoder()
    whole = {i: coder.ids(t or "") + packing.END for i, t in enumerate(texts)}
    rows = packing.pack(table(spark, texts).withColumn("start", F.lit("clash")).repartition(3, "doc_id"), with_ids=True).collect()
    assert check_pieces(rows, whole, 2048, packing.SEGMENTS, 2048) == 0
    assert packing.pack(table(spark, texts).limit(0)).count() == 0


def test_packing_under_three_limits(spark, corpus):
    docs = table(spark, corpus).withColumn("prompt", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("say this "), 40)))
    coder = encoder()
    whole = {i: coder.ids("say this " * 40 if i % 3 == 0 else "") + coder.ids(t) + packing.END for i, t in enumerate(corpus)}
    rows = packing.pack(docs, "prompt", tokens=512, segments=4, loss=300, with_ids=True).collect()
    check_pieces(rows, whole, 512, 4, 300)
    assert sum(r.loss_tokens for r in rows) == sum(len(coder.ids(t)) // 4 + 1 for t in corpus)


def brute_secrets(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets(spark, corpus):
    body = "A" * 30
    good = secrets.base62(zlib.crc32(body.encode()), 6)
    texts = [
        None, "", "Password = 'hunter22' token:x secret:Kelvin", "é password: abcdef😀 API_KEY=\"0123456789abcdef0123456789\"", "passwordpassword=secret=abcdefg token=token=tokens", "AKIA" + "Z" * 16 + " AKIA123 AKIAAKIA" + "9" * 20,
        f"é ghp_{body}{good} ghp_{body}AAAAAA npm_{body}{good}x npm_{body}{good}", "tokentoken = abcdef", "ſecret=abcdefg apikey:::abcdef api__key=abcdef", "f" * 23 + "g" + "0" * 24, "secret=" + "a" * 30, "passwd='\"abcdef",
    ] + corpus
    got = {r.doc_id: r for r in secrets.secrets(table(spark, texts).withColumn("spans", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        want, r = brute_secrets(t), got[i]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")), t[:80]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}
    assert (got[6].n_github, got[6].n_npm) == (1, 1)
    assert secrets.secrets(table(spark, texts).limit(0)).count() == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * unit > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


def test_mixing(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    texts = corpus * 2 + [None, "", " ", "one"]
    sources = [("a" if i % 2 else ["b", None, "", "Z", "é", "src10"][i % 6]) for i in range(len(texts))]
    docs = table(spark, texts, sources).withColumn("copies", F.lit("clash"))
    rows = mixing.copies(docs).collect()
    assert sorted(rows) == sorted(mixing.copies(docs.repartition(7)).collect())
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    sizes = defaultdict(int)
    for i, s in enumerate(sources):
        sizes[s] += n[i]
    want, taken, most = brute_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == n[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1
    out = mixing.mix(docs.unionByName(docs.limit(5)))
    assert out.columns == docs.columns
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_pivotal_step_keeps_mass_and_expectation():
    import random

    rnd, total = random.Random(1), 0.0
    for _ in range(4000):
        p, q = mixing.exchange(0.3, 50, 0.6, 20, rnd.random())
        assert abs(p * 50 + q * 20 - (0.3 * 50 + 0.6 * 20)) < 1e-9 and (p in (0, 1) or q in (0, 1)) and 0 <= p <= 1 and 0 <= q <= 1
        total += p
    assert abs(total / 4000 - 0.3) < 0.02


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark, corpus):
    import xxhash

    base = "the quick brown fox jumps over a lazy dog while many other animals of the forest look on and wonder what this is about " * 3
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in range(0, 60, 5)]
    texts = [None, "", "\n\n", base, base + "\nnew line\n\nnew  LINE\n" + base.upper(), *near, "x\ny", "y\nx\nz", " \t\n" + near[3] + "\n.", "éé ÉÉ\nÉÉ éé"] + corpus[:80]
    docs = table(spark, texts).withColumn("kept", F.lit("clash"))
    out = {r.doc_id: r.text for r in fuzzy.dedup_lines(docs).collect()}

    lines, first = [], {}
    norm = lambda t: " ".join(w for w in re.sub("[\t\r\x0b\x0c]", " ", t).lower().split(" ") if w)
    for i, t in enumerate(texts):
        for j, line in enumerate((t or "").split("\n")):
            if norm(line):
                lines.append((i, j, norm(line)))
                first.setdefault(norm(line), (i, j))

    def fp(t):
        hs = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(t.split(" "))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    distinct = list(first)
    prints = [fp(t) for t in distinct]
    top = list(range(len(distinct)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    linked = 0
    for a in range(len(distinct)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= fuzzy.DISTANCE:
                s, t = distinct[a], distinct[b]
                if brute_distance(s, t) <= 0.2 * max(len(s), len(t)) + 1e-9:
                    linked += 1
                    top[max(find(a), find(b))] = min(find(a), find(b))
    keep = {}
    for i, t in enumerate(distinct):
        r = find(i)
        keep[r] = min(keep.get(r, first[t]), first[t])
    stay = set(keep.values())
    assert linked > 3
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if not norm(x) or (i, j) in stay) if any((i, j) in stay for j in range(t.count("\n") + 1)) else ""
        assert out[i] == want, i
    assert fuzzy.dedup_lines(docs.limit(0)).count() == 0
    assert fuzzy.drop_repeats(docs).columns == docs.columns


def test_lines_whole_recall(spark, corpus):
    """Near copies by ungated edit similarity, of every length, are removed."""
    import random

    rnd = random.Random(4)
    norm = lambda t: " ".join(w for w in re.sub("[\t\r\x0b\x0c]", " ", t).lower().split(" ") if w)
    base = sorted({norm(x) for t in corpus for x in (t or "").split("\n") if 10 <= len(norm(x)) <= 600})
    groups = [[x for x in base if lo <= len(x) < hi] for lo, hi in ((15, 30), (30, 60), (60, 120), (120, 300), (300, 600))]
    chosen = [x for g in groups for x in rnd.sample(g, min(30, len(g)))]

    def letter(x):
        i = rnd.randrange(len(x))
        return x[:i] + "q" + x[i:]

    def word(x):
        w = x.split(" ")
        w[rnd.randrange(len(w))] = "other"
        return " ".join(w)

    pairs = [(x, y) for x in chosen for y in (letter(x), word(x)) if x != y and brute_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9]
    n = len(pairs)
    docs = table(spark, [x for x, _ in pairs] + [y for _, y in pairs])
    kept = {r.doc_id: r.kept for r in fuzzy.kept_lines(docs, whole=True).collect()}
    assert n > 150
    assert sum(n + i in kept for i in range(n)) <= 0.1 * n
    short = [i for i, (x, _) in enumerate(pairs) if len(x) < 60]
    assert sum(n + i in kept for i in short) <= 0.1 * len(short)
    unlike = table(spark, ["alpha beta gamma delta", "one two three four five", "x"])
    assert fuzzy.kept_lines(unlike, whole=True).count() == 3


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == want and 0 < docs.count() and (name == "mix_sources" or docs.count() <= before)
    kept = {}
    for r in docs.collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    coder = encoder()
    rows = corpus_pipeline.run(spark, sf).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.length
    assert dict(total) == {d: sum(len(coder.ids(t)) // 4 + 1 for t in ts) for d, ts in kept.items()}


def test_ids_with_added_tokens_equal_the_tokenizers(spark, corpus):
    """The contract's call as written: a spelt-out added token is one id."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " x <|endoftext|>\n\n y<|endoftext", *corpus[:40]]
    whole = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, x in enumerate(texts)}
    rows = packing.pack(table(spark, texts), with_ids=True, added=True).collect()
    assert check_pieces(rows, whole, 2048, packing.SEGMENTS, 2048) == 0
    assert all(r.doc_tokens == len(whole[r.doc_id]) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)


def test_packer_takes_the_largest_dot_product():
    """Every choice of a bin, replayed from its pieces, is what brute force would choose."""
    import random

    rnd = random.Random(8)
    items = [(rnd.randrange(1, 90), rnd.randrange(0, 90)) for _ in range(60)]  # tokens, prompt tokens
    cap = np.array([100.0, 5.0, 60.0])
    packer = packing.Packer(100, 5, 60, window=1000)
    for i, (n, prompt) in enumerate(items):
        packer.add(i, b"abcd" * n, min(prompt, n))
    waiting = {(k, s): (len(ids) // 4, p) for k, s, ids, p, _ in packer.items}
    packer.fill(0)
    bins = defaultdict(list)
    for key, start, n, *_, sequence, offset in packer.done:
        bins[sequence].append((offset, key, start, n))
    choices = 0
    for _, pieces in sorted(bins.items())[:8]:
        left = cap.copy()
        if sum(p[3] for p in pieces) < 100:
            continue
        for _, key, start, n in sorted(pieces):
            need = {k: np.array([m, 1, packing.Packer.loss_of(k[1], m, p)]) for k, (m, p) in waiting.items()}
            fits = {k: float(v @ (left / cap**2)) for k, v in need.items() if (v <= left).all()}
            m, prompt = waiting.pop((key, start))
            if fits:
                assert m == n and fits[key, start] >= max(fits.values()) - 1e-9
                choices += 1
            elif n < m:
                waiting[key, start + n] = (m - n, prompt)
            left -= (n, 1, packing.Packer.loss_of(start, n, prompt))
    assert choices > 10


def test_conversations_bind_every_limit(spark, sf):
    from dynasql.llm.queries import QUERIES

    rows = QUERIES["packing_conversations"](spark, "/root/testdata/sf0.01").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert all(sum(r.length for r in x) <= 2048 and len(x) <= packing.TURN_SEGMENTS and sum(r.loss_tokens for r in x) <= packing.TURN_LOSS for x in by.values())
    assert any(sum(r.loss_tokens for r in x) == packing.TURN_LOSS for x in by.values())


def test_stages_keep_clashing_columns(spark):
    """Extra columns keep their values, whatever their names."""
    import corpus_pipeline

    text = " ".join(f"word{i} has{i} text{i}" for i in range(40))
    docs = table(spark, [text, text + " more", "x", None, text]).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("failed", "n_words", "n_symbols", "k", "n", "row", "copies", "kept", "th", "h", "id", "fp", "d")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in ("failed", "n_words", "n_symbols", "k", "n", "row", "copies", "kept", "th", "h", "id", "fp", "d")), name
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_take_nulls_and_repeats(spark):
    import corpus_pipeline

    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (None, text + " tail", "en", None, 5), (3, "", "en", "a", 0), (4, "long " * 50_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {name: [tuple(r) for r in stage(spark, docs, "").collect()] for name, stage in corpus_pipeline.STAGES}
    assert sorted(got["quality_rules"], key=str) == sorted((r for r in rows if r[1] and len(set(r[1].split())) > 50), key=str)
    assert (None, text + " tail", "en", None, 5) in got["line_dedup"] and (2, None, None, None, None) in got["line_dedup"]
    assert sum(r[0] == 1 for r in got["near_dedup"]) == 1 and (None, text + " tail", "en", None, 5) in got["near_dedup"]
    assert set(got["mix_sources"]) <= set(rows) and {r[0] for r in got["pack_sequences"]} == {1, 2, None, 3, 4}


def test_lines_sharing_a_passage(spark, monkeypatch):
    """Near copies are found among many lines that share a passage, also where buckets get rarer keys; the others stay."""
    monkeypatch.setattr(fuzzy, "COMMON", 8)
    monkeypatch.setattr(fuzzy, "MANY", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    passage = [word() for _ in range(30)]
    texts = [" ".join([word() for _ in range(25)] + passage) for _ in range(60)]
    copies = [t.replace(t.split()[3], "changed", 1) for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    left = {r.doc_id for r in fuzzy.drop_repeats(docs).collect()}
    assert set(range(60)) <= left
    assert len(left) <= 60 + 2


def families(spark):
    """Pairs of near copies that agree in a passage all pairs share, and by letters, not by words, in a tail of their own."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
    passage = [word() for _ in range(45)]
    tails = [[word() for _ in range(29)] for _ in range(30)]
    texts = [" ".join(passage + [w + end for w in tail]) for tail in tails for end in ("", "q")]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_lines_alike_by_a_passage_and_letters(spark, monkeypatch):
    """Lines of heavy buckets whose own word pairs, a third or more, are all rare and all unlike still meet."""
    monkeypatch.setattr(fuzzy, "COMMON", 8)
    monkeypatch.setattr(fuzzy, "MANY", 4)
    left = {r.doc_id for r in fuzzy.kept_lines(families(spark), whole=True).collect()}
    assert set(range(0, 60, 2)) <= left
    assert len(left) <= 33


def test_line_dedup_stage_drops_no_partners(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(fuzzy, "COMMON", 8)
    monkeypatch.setattr(fuzzy, "MANY", 4)
    left = {r.doc_id for r in corpus_pipeline.line_dedup(spark, families(spark), "").collect()}
    assert set(range(0, 60, 2)) <= left
    assert len(left) <= 33


def test_lines_are_compared_once(spark, monkeypatch):
    """In a group that shares a passage, lines are not compared again with the leads of their buckets."""
    compared = []

    def cut(df, was=fuzzy.cut):
        out = was(df)
        if out.columns == ["ia", "ib"]:
            compared.append(out)
        return out

    monkeypatch.setattr(fuzzy, "cut", cut)
    monkeypatch.setattr(fuzzy, "COMMON", 8)
    monkeypatch.setattr(fuzzy, "MANY", 4)
    assert len({r.doc_id for r in fuzzy.kept_lines(families(spark), whole=True).collect()}) <= 33
    tables = [t.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct().collect() for t in compared]
    pairs = [tuple(r) for t in tables for r in t]
    assert len(pairs) > 60
    assert len(set(pairs)) == len(pairs)


def test_line_dedup_stage_finds_partners_of_every_kind(spark):
    """Near copies on both sides of a length where hashes change kind, of a few long words, or that repeat a word often."""
    import corpus_pipeline

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    sided = [" ".join(word(n) for n in (5, 4, 6, 5, 4, 6, 5, 4, 6, 5)) for _ in range(40)]
    tiny = [" ".join(word(n) for n in (6, 5, 6)) for _ in range(40)]
    kinds = [
        [(x, x + "q") for x in sided],
        [(x, x + "q") for x in tiny],
        [(x, x[:40] + "q" + x[41:]) for x in (word(80) for _ in range(40))],
        [(" ".join([*w, *[w[0] + "x"] * 100]), " ".join([*w[:3], "other", *w[4:], *[w[0] + "x"] * 100])) for w in ([word(4) for _ in range(6)] for _ in range(40))],
    ]
    assert {len(x) for x in sided} == {59} and {len(x) for x in tiny} == {19}
    rows = [(1000 * k + 100 * side + i, pair[side]) for k, pairs in enumerate(kinds) for i, pair in enumerate(pairs) for side in (0, 1)]
    left = {r.doc_id for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for k in range(4):
        assert {1000 * k + i for i in range(40)} <= left, k
        assert sum(1000 * k + 100 + i in left for i in range(40)) <= 4, k


def test_lines_meet_in_one_bucket_and_only_in_reach(spark, monkeypatch):
    """Lines that share several buckets are a pair once, and lines with none of a length near theirs in a bucket are not fetched."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
    passage = [word() for _ in range(24)]
    texts = [" ".join([*passage, *(word() for _ in range(16))]) for _ in range(40)]
    start = " ".join(word() for _ in range(12))
    far = [start, start + " " + " ".join(word() for _ in range(4))]
    docs = spark.createDataFrame(list(enumerate(texts + far)), "doc_id long, text string")
    fetched, pairs, joined = set(), [], []

    def texts_of(docs, some, was=fuzzy._texts):
        fetched.update(r.doc_id for r in some.collect())
        return was(docs, some)

    def cut(df, was=fuzzy.cut):
        out = was(df)
        if df.columns == ["ia", "ib"]:
            pairs.append([tuple(sorted(r)) for r in out.collect()])
            joined.append(df._jdf.queryExecution().optimizedPlan().toString().startswith("Project"))
        return out

    monkeypatch.setattr(fuzzy, "_texts", texts_of)
    monkeypatch.setattr(fuzzy, "cut", cut)
    left = {r.doc_id for r in fuzzy.kept_lines(docs, whole=True).collect()}
    assert left == set(range(42))
    assert fetched and not fetched & {40, 41}
    assert joined[-1], "pairs come from the join as they are, not made distinct after it"
    assert len(pairs[-1]) > 20 and len(set(pairs[-1])) == len(pairs[-1])
