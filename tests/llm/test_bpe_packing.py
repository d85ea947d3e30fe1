import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import bpe, packing

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["'s", "'LL", " ", "   ", "\n\n", "<|endoftext|>", " ", " ", "\x1c", "\x85", "½", "ª", "́", "👍🏽", "‍", "\x00", "漢字", "à la", "naïve,"]


def ids_of(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), max_size=8))
def test_encode_equals_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    coder = bpe.load(PATH)
    assert coder.encode(text) == ids_of(text) == bpe.load(PATH, quick=True).encode(text)
    assert coder.decode(coder.encode(text)) == LIBRARY.decode(LIBRARY.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_long_words():
    for text in ["a" * 3000, "ab" * 2000, "é漢" * 700, " " * 900 + "x", "x" * 257]:
        assert bpe.load(PATH).encode(text) == ids_of(text)


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    coder, text = bpe.RankArrayBPE(PATH), "one two three four five six seven two one"
    assert coder.encode(text) == coder.encode(text) == ids_of(text)


def edge_rows():
    long = " ".join(random.Random(3).choice(["alpha", "beta", "the", "über"]) for _ in range(9000))
    return [(0, "Hello  world\n\n it's <|endoftext|>", "en"), (1, None, None), (2, "", "x"), (None, "no id", "en"), (4, long, "en"), (5, "same", "a"), (5, "same", "a")]


def test_round_trip_rows(spark):
    docs = spark.createDataFrame(edge_rows(), "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip_digests(docs, PATH).collect()), key=str)
    want = []
    for doc, text, _ in edge_rows():
        b = ids_of(text or "")
        want.append((doc, len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe.encode(docs, PATH)
    assert sorted(r.text for r in bpe.decode(encoded, PATH).collect()) == sorted((t or "") for _, t, _ in edge_rows())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip_digests(docs, PATH).count() == 0
    assert packing.pack_documents(docs, PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    bins = packing.best_fit(sizes, 64)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 64 for b in bins)
    naive: list[int] = []
    for s in sizes:
        fits = [r for r in naive if r >= s]
        if fits:
            naive[naive.index(min(fits))] -= s
        else:
            naive.append(64 - s)
    assert len(bins) == len(naive)


def check_packed(rows, texts, capacity):
    seqs = {}
    docs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = ids_of(text or "") + b"\0\0\0\0"
        at = 0
        for k, r in enumerate(sorted(docs[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.length == capacity or k == 0
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at * 4 == len(ids)
    return len(seqs)


def test_pack_documents(spark):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice(["token", "zebra", "a", "Brücke"]) for _ in range(rnd.choice([0, 3, 40, 200, 900, 5000]))) for i in range(300)}
    texts[7], texts[8] = None, ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    rows = packing.pack_documents(docs, PATH).collect()
    n = check_packed(rows, texts, 2048)
    assert n <= len(packing.best_fit(sorted((r.length for r in rows), reverse=True), 2048)) + 2


def test_windows_and_forwarding(spark):
    rows = [(i, 0, 0, 1 + (i * 37) % 100, i) for i in range(2000)]
    pieces = spark.createDataFrame(rows, packing.PIECE).repartition(10)
    got = packing.pack(pieces, capacity=100, nearly_full=0, window=64, forward=4, fan_in=3).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 100
    assert len(used) < 1.05 * sum(used.values()) / 100 + 10


def test_repeated_rows_and_null_id(spark):
    docs = spark.createDataFrame([(None, "x"), (3, "same text"), (3, "same text")], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_partitions_of_one_size_class(spark):
    rnd = random.Random(5)
    sizes = [[rnd.randint(1100, 1300) for _ in range(6000)], [rnd.randint(700, 900) for _ in range(6000)]]
    rows = [(6000 * k + i, 0, 0, n, 7) for k, own in enumerate(sizes) for i, n in enumerate(own)]
    got = packing.pack(spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), packing.PIECE)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert sorted(r.doc_id for r in got) == list(range(12000)) and max(map(sum, by.values())) <= 2048
    assert len(by) <= 1.005 * len(packing.best_fit(sorted(sizes[0] + sizes[1], reverse=True), 2048))
