import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import DATA
from threadloom.llm import simhash
from threadloom.llm.components import connected_components


def brute_fp(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs: (doc_id, fp) -> doc_id: smallest reachable."""
    names = {}
    todo = set(pairs)
    while todo:
        group, stack = [], [todo.pop()]
        while stack:
            x = stack.pop()
            group.append(x)
            near = {y for y in todo if (x[1] ^ y[1]).bit_count() <= 2}
            todo -= near
            stack += near
        for x in group:
            names[x] = min(d for d, _ in group if d is not None)
    return names


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma", "DELTA", "été", "x", "y\t", "\x0bz", "\x85w", " u"]
    out = {}
    for i in range(n):
        if i % 3 and out:
            words = out[rnd.randrange(i)].split(" ")
            if i % 3 == 2 and words:
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            out[i] = " ".join(words)
        else:
            out[i] = " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 30, 300])))
    return out


def test_fingerprints():
    for text in texts(1, 90).values():
        assert simhash.majority_bits(simhash.shingle_hashes(text, 3)) % 2**64 == brute_fp(text, 3)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_masks_cover_all_links(most):
    masks = simhash.key_masks(most)
    rnd = random.Random(2)
    for _ in range(500):
        flips = sum(1 << b for b in rnd.sample(range(64), most))
        assert any(flips & (m % 2**64) == 0 for m in masks)


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(40))]))
    index = simhash.GrayIndex(codes)
    for most in (0, 2, 5):
        got = {(int(index.codes[a]), int(index.codes[b])) for q, f in index.search(most) for a, b in zip(q, f, strict=True)}
        want = {frozenset((int(a), int(b))) for a in codes for b in codes if a < b and (int(a) ^ int(b)).bit_count() <= most}
        assert {frozenset(p) for p in got} == want


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(6)
    codes, group = [], []
    for g, size in enumerate([1, 5, 31, 32, 33, 400]):
        own = {int(x) for x in np.bitwise_xor.accumulate(np.uint64(1) << rng.integers(0, 40, size, dtype=np.uint64))}
        codes += sorted(own)
        group += [g] * len(own)
    a, b = simhash.forest(np.array(group), np.array(codes, np.uint64), 1)
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for x, y in zip(a, b, strict=True):
        up[find(int(x))] = find(int(y))
    at = 0
    for g in range(6):
        own = [c for c, k in zip(codes, group, strict=True) if k == g]
        at += len(own)
        for x in own:
            for y in own:
                if (x ^ y).bit_count() <= 1:
                    assert find(x) == find(y) or g < 0
    assert len(a) < len(codes)


def test_near_duplicates(spark):
    all_texts = texts(3, 150)
    rows = [(i, t, "c") for i, t in all_texts.items()] + [(900, None, None), (901, "", "c"), (5, all_texts[5], "c"), (None, all_texts[7], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    pairs = [(i, brute_fp(t, 3)) for i, t, _ in rows]
    names = brute_components(pairs)
    want = sorted([(i, f"{f:016x}", names[i, f]) for i, f in pairs], key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_large_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rnd.randrange(400)] = f"v{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    names = brute_components([(i, brute_fp(t, 3)) for i, t in rows])
    assert got == {i: n for (i, _), n in names.items()}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(3000, 3000), (None, 4), (5000, 5001), (5001, 5000)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    by = got.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("m")).collect()
    assert sorted((r.m, r.n) for r in by) == [(0, 201), (1000, 51), (5000, 2)]


def test_similar_documents(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, i = [], 0
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([12, 60, 250, 900]))]
        rows.append((i, " ".join(base)))
        for _ in range(rnd.randint(0, 4)):
            i += 1
            words = list(base)
            for _ in range(max(1, len(words) // rnd.choice([60, 90, 20]))):
                words[rnd.randrange(len(words))] = word()
            rows.append((i, " ".join(words)))
        i += 1
    rows += [(9000, None), (9001, ""), (9002, rows[0][1].upper()), (None, rows[3][1])]
    sets = {}
    for d, t in rows:
        words = (t or "").lower().split()
        sets[d] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [d for d in sets if d is not None]
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] == sets[b] or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert len(got) == len(rows)
    # nothing less alike is joined, and all links are found
    assert all(find(d) == find(c) for d, c in got.items() if d is not None)
    assert all(got[a] == got[b] for a, b in linked)
    assert got[9000] == got[9001] == 9000 and got[9002] == got[0]
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_similar_documents_star(spark):
    """Copies alike to one original (0.82), not to each other (about 0.68), beside unlike documents that share its keys."""
    n, rng = 400, np.random.default_rng(9)
    base = [f"w{k}" for k in range(204)]
    rows = [(n, " ".join(base))]
    for i in range(n):
        words = list(base)
        # four words with five shingles each
        for x, at in enumerate(rng.choice(np.arange(5, 200, 5), 4, replace=False) + rng.integers(0, 5)):
            words[at] = f"v{i}-{x}"
        rows.append((i, " ".join(words)))
    of = [{tuple(t.split()[k : k + 5]) for k in range(200)} for _, t in rows]
    assert all(0.8 <= len(s & of[0]) / len(s | of[0]) <= 0.88 for s in of[1:])
    rows += [(1000 + i, " ".join(base[:20] + [f"u{i}-{x}" for x in range(180)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert all(got[i] == got[n] for i in range(n))
    assert all(got[1000 + i] == 1000 + i for i in range(40))


@pytest.mark.parametrize("part_docs", [256, 30])
def test_pairs_of_a_group_stay_in_tasks(spark, monkeypatch, part_docs):
    """A group whose members are nearly alike enough: tables grow with its members, not its pairs, and every link counts."""
    n, rng = 240, np.random.default_rng(11)
    base = [f"w{k}" for k in range(204)]
    rows = []
    for i in range(n):
        words = list(base)
        # three words with five shingles each: two texts have a similarity of about 0.74, more where their places are near
        for x, at in enumerate(rng.choice(np.arange(5, 200, 5), 3, replace=False) + rng.integers(0, 5)):
            words[at] = f"v{i}-{x}"
        rows.append((i, " ".join(words)))
    of = [{tuple(t.split()[k : k + 5]) for k in range(200)} for _, t in rows]
    links = [(a, b) for a in range(n) for b in range(a) if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b])]
    up = np.arange(n)
    simhash._hook(up, *np.array(links).T)
    while not np.array_equal(last := up[up], up):
        up = last
    assert 2 < len(set(up)) < n
    counts, write = [], simhash.stored

    def counted(df):
        out = write(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    monkeypatch.setattr(simhash, "PART_DOCS", part_docs, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == {i: int(up[i]) for i in range(n)}
    keys = sum(len(simhash.prefix_keys(simhash.shingle_set(t, 5), np.zeros(1 << simhash.SLOT_BITS, np.int64), 0.8)) for _, t in rows)
    assert max(counts) <= 2 * keys < n * (n - 1) // 2
    assert max(counts[2:]) <= (1 if part_docs > n else 8) * n


def test_alike_edges_by_brute_force():
    rng = np.random.default_rng(5)
    for similarity in (0.5, 0.8):
        for n in (1, 2, 3, 40):
            pool = np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64))
            sets = [np.sort(rng.choice(pool, int(rng.integers(0, 40)), replace=False)) for _ in range(n)]
            sets += [np.sort(s[rng.random(len(s)) > 0.1]) for s in sets[: n // 2]]
            if len(sets) < 2:
                continue
            alike = lambda p, q: (c := len(np.intersect1d(p, q))) and c >= similarity * (len(p) + len(q) - c) - 1e-9  # noqa: B023, E731
            links = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
            edges = simhash.alike_edges(sets, similarity)
            assert len(edges) < len(sets) and all(alike(sets[a], sets[b]) for a, b in edges)
            roots = []
            for pairs in (links, edges):
                up = np.arange(len(sets))
                simhash._hook(up, *np.array(pairs, np.int64).reshape(-1, 2).T)
                while not np.array_equal(last := up[up], up):
                    up = last
                roots.append(up.tolist())
            assert roots[0] == roots[1]


@pytest.mark.parametrize("part", [4096, 37])
def test_several_clusters_under_one_key(spark, monkeypatch, part):
    """Pairs that are neither first, last nor nearest to the middle of their key meet all the same."""
    rng = np.random.default_rng(3)
    n = 300
    fps = rng.integers(0, 2**63, n // 2, dtype=np.int64)
    rows = [(7, int(f) ^ (1 << int(rng.integers(0, 60))) * k, 2 * i + k) for i, f in enumerate(fps) for k in (0, 1)]
    monkeypatch.setattr(simhash, "PART", part)
    met = simhash.candidate_edges(spark.createDataFrame([(*r, 100) for r in rows], "key long, fp long, node long, size int"))
    members = met.filter("key is not null").selectExpr("key", "a as node", "b as fp", "a as root", "size")
    found = [tuple(r) for r in simhash.open_pairs(members, 0.8).collect()]
    pairs = set(found)
    assert len(found) == len(pairs)
    want = {(x, y) for _, f, x in rows for _, g, y in rows if x < y and ((f ^ g) & (2**64 - 1)).bit_count() <= simhash.SIEVE}
    assert pairs == want and len(want) >= n // 2


def test_index_on_the_documents(spark):
    """The links of whole documents come from the index: it visits nodes, and far fewer than there are pairs of one large group."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    codes = np.array(sorted({r.fp for r in simhash.fingerprints(docs).select("fp").collect()}), np.int64).view(np.uint64)
    pairs, visits = set(), 0
    for mask in simhash.key_masks(2):
        part = codes & np.uint64(mask % 2**64)
        order = np.argsort(part, kind="stable")
        group = np.cumsum(np.r_[0, part[order][1:] != part[order][:-1]])
        index = simhash.GrayIndex(codes[order], group)
        for q, f in index.search(2):
            pairs |= {frozenset((int(index.codes[a]), int(index.codes[b]))) for a, b in zip(q, f, strict=True)}
        visits += index.visits
    assert pairs == {frozenset((int(a), int(b))) for k, a in enumerate(codes) for b in codes[k + 1 :] if (int(a) ^ int(b)).bit_count() <= 2}
    assert visits >= 2 * 15 * len(codes)
    rng = np.random.default_rng(3)
    many = np.unique(rng.integers(0, 2**32, 20_000, dtype=np.uint64))
    index = simhash.GrayIndex(many)
    found = sum(len(q) for q, _ in index.search(2))
    assert 0 < index.visits < len(many) ** 2 / 8 and found >= 0


def test_prefix_keys_meet():
    """Any two sets of similarity 0.8 or more share a key, whatever the sketch holds."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(1, 80))
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.1], rng.integers(0, 2**64, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
        sketch = rng.integers(0, 5, 1 << simhash.SLOT_BITS)
        common = len(np.intersect1d(base, other))
        if common and common >= 0.8 * (len(base) + len(other) - common):
            assert np.intersect1d(simhash.prefix_keys(base, sketch, 0.8), simhash.prefix_keys(other, sketch, 0.8)).size


def test_sketch_counts_all_rows(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7}") for i in range(90)], "doc_id long, text string").repartition(6)
    sketch = simhash.frequency_sketch(docs, 5)
    want = np.zeros(1 << simhash.SLOT_BITS, np.int64)
    for i in range(90):
        for h in simhash.shingle_set(f"one two three four five six {i % 7}", 5):
            want[int(h) >> (64 - simhash.SLOT_BITS)] += 1
    assert (sketch == want).all() and sketch.sum() == 90 * 3


def test_without_near_copies(spark):
    long = " ".join(f"w{k}" for k in range(80))
    near = long.replace("w3 ", "changed ")
    rows = [
        (5, long, "x"), (3, near, "y"), (None, long, "z"), (None, "alone without an id", "z"), (None, "alone without an id", "z"),
        (7, "first text of seven", "a"), (7, long, "a"), (8, "twice the same row", "b"), (8, "twice the same row", "b"), (8, "twice the same row", None),
        (9, None, "n"), (10, "", "n"), (11, long + " " + " ".join(f"more{k}" for k in range(40)), "o"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(4)
    got = sorted(map(tuple, simhash.without_near_copies(docs).collect()), key=str)
    twice = [r for r in got if r[0] == 8]
    assert len(twice) == 1 and twice[0][1] == "twice the same row"
    assert sorted((r for r in got if r[0] != 8), key=str) == sorted([rows[1], rows[3], rows[5], rows[10], rows[12]], key=str)
    assert simhash.without_near_copies(docs.limit(0)).count() == 0
    assert simhash.without_near_copies(docs).columns == docs.columns
