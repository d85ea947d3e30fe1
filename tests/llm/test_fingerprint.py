import hashlib
import random

from pyspark.sql import functions as F

from threadloom.llm import fingerprint as fp


def sample(n, seed=1):
    rnd = random.Random(seed)
    vocab = ["stone", "river.", "été", "漢字!", "lamp\n", "door\n\n", "x", "why?", "👍"]
    rows = []
    for i in range(n):
        rows.append((i * 7 if i % 5 else i * 1000, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 5, 60, 400])))))
    return rows


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (d, t) in enumerate(rows):
        q = len(t) // 4
        e = t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return out


def test_contract(spark):
    rows = sample(300) + [(None, "no id. at all"), (7, None), (7, "twice. over."), (7, "twice. over."), (10**12, "far away. " * 3000), (3, "no stop " * 4000)]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(6)
    got = fp.fingerprints_with_edits(docs).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(brute(rows), key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 900]
    assert sum(r.near_edited for r in long) / len(long) > 0.6
    assert sum(r.near_next for r in long) / len(long) < sum(r.near_edited for r in long) / len(long)


def test_every_character_is_hashed(spark):
    texts = ["a\n\nb. c!\n \nd", "x" * 500, "...", "\n\n\n", "a b c", "\ta.\r\n\r\nb", "a\n\n\n\nb", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    join = lambda c, p: F.array_join(F.regexp_extract_all(c, F.lit(p), F.lit(0)), "")
    whole = F.transform(F.regexp_extract_all("t", F.lit(fp.SECTION), F.lit(0)), lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(fp.PARAGRAPH), F.lit(0)), lambda p: join(p, fp.SENTENCE)), ""))
    assert [r.w for r in df.select(F.array_join(whole, "").alias("w")).collect()] == texts


def test_equal_and_edits(spark):
    a, b = "One. Two. Three.\nFour. Five.", "One. Two. 3.\nFour. Five."
    row = spark.createDataFrame([(a, b, a, None, "")], "a string, b string, c string, n string, e string")
    f = {c: fp.fingerprint(F.col(c)) for c in "abcne"}
    r = row.select(*[f[c].alias(c) for c in "abcne"], fp.likeness(f["a"], f["b"]).alias("ab"), fp.likeness(f["n"], f["e"]).alias("ne"), fp.likeness(f["a"], f["e"]).alias("ae"), fp.differing_spans(f["a"], f["b"]).alias("d"), fp.differing_spans(f["a"], f["c"]).alias("same")).first()
    assert r.a == r.c != r.b and r.n == r.e
    assert (r.ab, r.ne, r.ae) == (0.8, 1.0, 0.0)
    assert r.d == [2] and r.same == []


def test_single_and_empty(spark):
    docs = spark.createDataFrame([(1, "alone here. now")], "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fp.fingerprints_with_edits(docs).collect()]
    assert got == brute([(1, "alone here. now")])
    assert fp.fingerprints_with_edits(docs.limit(0)).count() == 0


def test_ids_far_apart(spark, monkeypatch):
    """Hash-like ids, each in a range of its own at several levels: still no task orders all ranges."""
    monkeypatch.setattr(fp, "TOP", 4)
    ids = sorted({(k * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for k in range(60)} | {-1, 0, 1, 2**63 - 1, -(2**63)})
    got = dict(map(tuple, fp.following(spark.createDataFrame([(i,) for i in ids], "v long").repartition(5)).collect()))
    assert got == dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    assert fp.following(spark.createDataFrame([], "v long")).count() == 0
    rows = [(i, f"text {i}. of its own.") for i in ids]
    got = fp.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(brute(rows))
