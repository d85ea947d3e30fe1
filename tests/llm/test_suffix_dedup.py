import hashlib
import random

import numpy as np
import pytest

from threadloom.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    texts = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, _), (low, b) in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < low:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(n, seed, step=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé漢") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.choice([6, 9, 12, 30]))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rnd.randint(0, 9)], word()]
        if rows and i % 7 == 0:
            parts = [rnd.choice(rows)[1] or ""]
        if i % 11 == 0:
            parts.append("For " * rnd.randint(20, 60))
        rows.append((i * step, " ".join(parts)))
    return rows


def result(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, batch string").repartition(7)
    return sorted(map(tuple, sd.digests(docs).collect()), key=repr)


def test_hashes_follow_the_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    h = sd.grams(data)
    assert len(h) == 400 - sd.GRAM + 1
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(bytes(data[i : i + sd.GRAM]), h[i]) == h[i]
    assert list(sd.least(h, 7)) == [min(h[i : i + 7]) for i in range(len(h) - 6)]


@pytest.mark.parametrize("step", [1, 300])
def test_against_brute_force(spark, step):
    rows = corpus(160, step, step) + [(None, None), (None, "n" * 80), (-5, ""), (10**9, "n" * 120 + "tail"), (3, "short")]
    assert result(spark, rows) == brute(rows)


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_DOCS", 3)
    monkeypatch.setattr(sd, "HOT_BATCHES", 2)
    monkeypatch.setattr(sd, "CHUNK", 1 << 10)
    monkeypatch.setattr(sd, "STEP", 200)
    line = "a line that very many of the documents share, over fifty bytes long"
    rows = [(i, f"{i * 7919} {line} {i * 104729}" + (f" {line[:60]}" if i % 3 else "")) for i in range(0, 4000, 25)] + corpus(60, 9)
    assert result(spark, rows) == brute(rows)


def test_repeated_ids_and_empty(spark):
    text = "the same sentence of more than fifty bytes in two rows of one id. " * 2
    rows = [(4, text), (4, text), (9, text), (2, "x")]
    assert result(spark, rows) == brute(rows)
    assert sd.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(4)
    for length in (3, 8, 9, 16, 50):
        text = rng.integers(97, 99, 600).astype(np.uint8)
        at = np.concatenate([rng.permutation(len(text) - length + 1), rng.integers(0, 40, 30)])
        order, new = sd.ordered(text, at, length)
        strings = [bytes(text[p : p + length]) for p in at]
        assert [strings[k] for k in order] == sorted(strings)
        assert list(new) == [k == 0 or strings[order[k]] != strings[order[k - 1]] for k in range(len(at))]


def test_levels_stay_logarithmic():
    rng = np.random.default_rng(2)
    levels, seen, sizes = sd.SuffixLevels(6), {}, []
    for doc in range(64):
        text = rng.integers(97, 99, 35).astype(np.uint8)
        at = np.arange(30)
        strings = [bytes(text[p : p + 6]) for p in at]
        hit = levels.add(text, at, np.full(30, doc))
        assert [seen.get(s, doc) < doc for s in strings] == list(hit)
        for s in strings:
            seen.setdefault(s, doc)
        sizes.append(len(levels.levels))
    assert sizes == [(k + 1).bit_count() for k in range(64)]
    assert sum(len(level.docs) for _, level in levels.levels) >= len(seen) == len({bytes(x) for _, level in levels.levels for x in level.suffixes})


def test_documents_use_several_levels(monkeypatch):
    """Runs of one bucket go through a family of more than one level, and the spans are those of brute force."""
    monkeypatch.setattr(sd, "STEP", 500)
    rows = [(i, t.encode()) for i, t in corpus(300, 5)]
    text = [b for _, b in rows if len(b) >= 50]
    docs = np.array([i for i, b in rows if len(b) >= 50])
    data, ends = np.frombuffer(b"".join(text), np.uint8), np.cumsum([len(b) for b in text])
    start, count, _, _ = sd.runs(data, ends, ends - [len(b) for b in text])
    owner = np.searchsorted(ends, start, "right")
    levels = sd.SuffixLevels()
    row, a, z = sd.search_bucket(sd.windows(data, start, count + sd.LENGTH - 1), docs[owner], levels)
    assert levels.most > 1
    got = np.zeros(len(data), bool)
    for r, x, y in zip(row, a, z, strict=True):
        got[start[r] + x : start[r] + y] = True
    first, want = {}, np.zeros(len(data), bool)
    for k, b in enumerate(text):
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], k) < k:
                want[ends[k] - len(b) + i : ends[k] - len(b) + i + 50] = True
    assert (got == want).all()


def test_one_range_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_BYTES", (400, 400))
    own = corpus(60, 3)
    rows = [(None, t) for _, t in own[:30]] + [(7, t) for _, t in own[30:]] + [(10**12, own[0][1]), (12, own[31][1])]
    assert result(spark, rows) == brute(rows)
