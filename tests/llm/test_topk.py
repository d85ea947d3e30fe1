import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import topk


def brute(docs, queries, k):
    docs = [(d, Counter(topk.terms_of(t or ""))) for d, t in docs if d is not None]
    n, avgdl = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in {(q, t) for q, t in queries if q is not None}:
        terms = sorted(set(topk.terms_of(text or "")))
        scored = []
        for d, c in docs:
            dl = sum(c.values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / avgdl)) for t in terms if c[t])
            if s:
                scored.append((-round(s, 9), d))
        out += [(q, r + 1, d, round(-s, 6)) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(n, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(vocab[min(399, int(rnd.paretovariate(0.6)))] for _ in range(rnd.choice([0, 1, 10, 80, 300])))))
        if i % 9 == 0 and rows:
            rows.append((10_000 + i, rnd.choice(rows)[1]))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_DOCS", 37)
    rows = corpus(500, 1) + [(None, "w1 w2"), (20_000, None), (20_001, "Übung _x W1")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int").repartition(6)
    queries = docs.filter(F.col("doc_id") % 20 == 0)
    got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in topk.search(docs, queries, 7).collect())
    assert got == brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 7)


def test_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_TERMS", 300)
    rows = corpus(150, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = topk.query_terms(docs).cache()
    blocks = [asked.filter(b).collect() for b in topk.query_blocks(asked)]
    assert len(blocks) > 3 and all(sum(r.n for r in b) <= 300 or len(b) == 1 for b in blocks)
    assert sorted(r.doc_id for b in blocks for r in b) == sorted(r.doc_id for r in asked.collect())
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in topk.search(docs, docs.filter("doc_id % 3 = 0"), 5).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 3 == 0], 5)


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b c"), (3, "")], "doc_id long, text string")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in topk.search(docs, docs).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 2, 1), (2, 3, 1)]
    assert topk.search(docs.limit(0), docs.limit(0)).count() == 0
    assert topk.search(docs.limit(0), docs).count() == 0
    assert topk.search(docs, docs.limit(0)).count() == 0


def test_blocks_below_the_threshold_are_not_read():
    """Most postings of the queries' terms in a shard of several topics stay unread, and the best are those of a full scan."""
    rnd, rng = random.Random(4), np.random.default_rng(4)
    texts = [[f"t{i // 100}-{rnd.randrange(60)}" if rnd.random() < 0.5 else f"w{min(2999, int(rnd.paretovariate(0.4)))}" for _ in range(120)] for i in range(2000)]
    own = [Counter(t) for t in texts]
    shard = topk.Shard.build(list(range(2000)), [120] * 2000, [np.array([xxhash.xxh64_intdigest(w) for w in c], np.uint64) for c in own], [np.fromiter(c.values(), np.uint32, len(c)) for c in own])
    shard.prepare(120.0)
    df = Counter(w for c in own for w in c)
    for at in rng.integers(0, 2000, 20):
        words = sorted(own[at], key=xxhash.xxh64_intdigest)
        idf = np.array([math.log(1 + (2000 - df[w] + 0.5) / (df[w] + 0.5)) for w in words])
        top = topk.TopK(10)
        shard.search(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), idf, top)
        scores = [sum(i * c[w] * 2.2 / (c[w] + 1.2) for w, i in zip(words, idf, strict=True) if c[w]) for c in own]
        assert list(top.doc) == sorted(range(2000), key=lambda d: (-round(scores[d], 9), d))[:10]
    assert 0 < shard.read_ < shard.known / 2, (shard.read_, shard.known)


def test_batches_of_queries_over_parts_of_a_shard(spark, monkeypatch):
    """Every document is scored once, whatever part of the batch's queries needs it, and copies in other shards are found each."""
    for name, value in (("SHARD_DOCS", 700), ("BATCH", 9), ("BATCH_POSTS", 3000), ("TILE", 4), ("FIRST", 2), ("COMMON", 20)):
        monkeypatch.setattr(topk, name, value)
    rows = corpus(1100, 3)
    rows += [(30_000 + i, text) for i, (_, text) in enumerate(rows[:40])] + [(40_000 + i, rows[7][1] or "w1 w2") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in topk.search(docs, docs.filter("doc_id % 15 = 0"), 6).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 15 == 0], 6)


def test_copies_are_scored_once(spark):
    """A text that many documents have is in the running best only once, and is found as often as it stands."""
    rows = [(i, "w1 w2 w3") for i in range(40)] + [(40, "w1 w2"), (41, "w4"), (41, "w1 w9"), (42, "w1 w9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same = topk.copies(topk.build_index(docs), 10).collect()
    assert sorted(r.doc_id for r in same if r.number == 1) == [0, 40, 41, 41] and len(same) == 10 + 1 + 1 + 2
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in topk.search(docs, docs.filter("doc_id >= 39"), 10).collect())
    assert {(q, r, d) for q, r, d, _ in got if q in (39, 40)} == {(q, i + 1, d) for q in (39, 40) for i, d in enumerate([40] * (q == 40) + list(range(10 - (q == 40))))}
