import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import toxicity

BAD = ["grumblefink", "snarkwort", "blatherskite"]


def corpus(n, seed):
    rnd = random.Random(seed)
    plain = ["river", "stone", "harbor", "lantern", "meadow", "copper", "window", "garden", "winter", "paper"]
    texts, toxic = [], []
    for _ in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.choice([5, 40, 400]))]
        bad = rnd.random() < 0.3
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(BAD)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def auc(scores, y):
    rank = np.argsort(np.argsort(scores)) + 1
    pos = np.array(y) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy_and_misspellings():
    model = toxicity.train(*corpus(900, 1))
    texts, y = corpus(300, 2)
    known = {}
    assert auc([model.score(t, known) for t in texts], y) > 0.97
    assert model.score("the grumblefinck stone", {}) > model.score("the granite stone", {})
    assert model.score("GRUMBLEFINK", {}) == model.score("grumblefink", {})


def test_one_kind_of_label():
    assert toxicity.train([], []).score("x", {}) < 1e-6
    assert abs(toxicity.train(["a", "b"], [1, 1]).score("zzz", {}) - 1) < 1e-6
    model = toxicity.train(["", "a b c"], [0, 1])
    assert 0 <= model.score("", {}) <= 1


def test_rows(spark):
    texts, y = corpus(120, 3)
    rows = [(i, t, 0.5) for i, t in enumerate(texts)] + [(500, None, 0.1), (501, "", 0.1), (None, "no id", 0.1), (5, texts[5], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, v, "x") for i, v in enumerate(y)] + [(9999, 1, "x"), (3, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    learn = toxicity.learnable()
    got = {r.doc_id: r.l for r in docs.select("doc_id", learn.alias("l")).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 != 2) for k, v in got.items() if k is not None)
    sample = toxicity.labelled_sample(docs.limit(120), labels, learn)
    assert len(sample[0]) == sum(got[i] for i in range(120))
    assert len(toxicity.labelled_sample(docs, labels, F.lit(True), most=7)[0]) <= 7
    model = toxicity.train(*sample)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_conflicting_labels_and_bounds(spark):
    rows = [(i, f"text {i}") for i in range(20)] + [(3, f"other {k}") for k in range(50)] + [(7, "z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(4, 1), (4, 0), (3, 1)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(docs, labels, F.lit(True))
    assert len(texts) == 20 and y[4] == 1 and y[3] == 1 and texts[3] == "other 0"
    assert toxicity.labelled_sample(docs.repartition(3), labels.repartition(2), F.lit(True)) == (texts, y)
    few, _ = toxicity.labelled_sample(docs, labels, F.lit(True), most_bytes=60)
    assert few and sum(map(len, few)) <= 60
    assert toxicity.labelled_sample(docs, labels, F.lit(True), most_bytes=0) == ([], [])


def test_scores_are_finite_when_most_texts_have_no_words():
    texts = ["grumblefink stone", "river", "snarkwort", "meadow"] + ["", " ", "--", "?!"] * 99
    y = [1, 0, 1, 0] + [k % 2 for k in range(396)]
    model = toxicity.train(texts, y)
    assert np.isfinite(model.bucket_logits).all() and np.isfinite(model.bias)
    assert all(0 <= model.score(t, {}) <= 1 for t in [*texts[:6], "never seen"])


def plain_loss(weights, texts, y, kept_of):
    """The loss by its definition: words one by one, windows one by one."""
    diff = weights["softmax"] @ np.array([-1.0, 1.0])
    total = 0.0
    for text, label in zip(texts, y, strict=True):
        words = toxicity.words_of(text)
        logits = []
        for w in words:
            grams = toxicity.features(w)
            used = [g for g in grams if kept_of(g)]
            logits.append(sum(weights["embedding"][g] @ diff for g in used) / max(len(grams) * (1 - toxicity.LEFT_OUT), 1))
        means = [toxicity.SCALE * np.mean(logits[a : a + toxicity.WINDOW]) for a in range(0, len(logits), toxicity.WINDOW)]
        pool = np.log(np.mean(np.exp(toxicity.SHARP * np.array(means)))) / toxicity.SHARP if means else 0.0
        z = pool + weights["bias"] @ np.array([-1.0, 1.0])
        total += np.log1p(np.exp(z)) - label * z
    return total / len(y)


def test_loss_and_gradients_against_brute_force():
    rng = np.random.default_rng(5)
    texts, y = corpus(12, 9)
    texts, y = [*texts, ""], np.array([*y, 1.0])
    bags = toxicity._Bags(texts)
    weights = {"embedding": rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.DIM)), "softmax": rng.normal(0, 0.3, (toxicity.DIM, 2)), "bias": rng.normal(0, 0.3, 2)}
    part = bags.part(np.arange(len(texts)))
    kept_of = lambda g: g % 5 != 0
    kept = part[3] % 5 != 0
    loss, to_bucket, grads = toxicity.loss_and_gradients(weights, part, y, kept)
    assert abs(loss - plain_loss(weights, texts, y, kept_of)) < 1e-9
    diff, step = weights["softmax"] @ np.array([-1.0, 1.0]), 1e-5
    places = [("embedding", (int(g), 2), to_bucket[g] * diff[2]) for g in rng.choice(np.flatnonzero(to_bucket), 5)]
    places += [(k, at, grads[k][at]) for k, at in (("softmax", (1, 0)), ("softmax", (4, 1)), ("bias", (0,)), ("bias", (1,)))]
    for name, at, want in places:
        held = weights[name][at]
        weights[name][at] = held + step
        up = plain_loss(weights, texts, y, kept_of)
        weights[name][at] = held - step
        down = plain_loss(weights, texts, y, kept_of)
        weights[name][at] = held
        assert abs((up - down) / (2 * step) - want) < 1e-6, (name, at)


def test_model_score_against_brute_force():
    texts, y = corpus(60, 6)
    model = toxicity.train(texts, y)
    for t in [*texts[:10], "", "Über-straße x"]:
        words = [np.mean([model.bucket_logits[g] for g in toxicity.features(w)]) for w in toxicity.words_of(t)]
        means = [toxicity.SCALE * np.mean(words[a : a + toxicity.WINDOW]) for a in range(0, len(words), toxicity.WINDOW)]
        z = (np.log(np.mean(np.exp(toxicity.SHARP * np.array(means)))) / toxicity.SHARP if means else 0) + model.bias
        assert abs(model.score(t, {}) - 1 / (1 + np.exp(-z))) < 1e-9
