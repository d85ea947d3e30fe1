"""Toxicity by subword-bag embeddings and a linear softmax (operator 2).

A word is the bag of its hashed character n-grams (with word-boundary marks)
and of itself; its vector is the mean of their embeddings. A text's word
vectors are averaged and go into a linear softmax over two labels. Embeddings
and softmax are trained jointly, in numpy, on batches of labelled texts
(softmax and bias by Adam, embeddings by gradients over one running scale, with
decay), so an unseen misspelling shares most n-gram vectors with the word that
it hides. Some n-grams are left out at random in each training step, which
keeps the whole word from carrying all the weight.

One insult in a long text would vanish in a single average. A text is
therefore read in windows of ``WINDOW`` words, each averaged on its own, and
the windows' logits are pooled by a soft maximum, in training as in scoring.
Every word of every text takes part, whatever its length.

As the softmax is linear, a word counts by one number, the logit of its
vector; a scoring worker computes it once for each word and keeps it.

Training takes a bounded sample of labelled documents (at most
``MAX_LABELLED``, those with the smallest hashes of doc_id, as far as their
texts have ``MAX_BYTES`` together), collected to the driver; scoring runs over
all rows on the executors, with one trained number for each of ``BUCKETS``
buckets as a broadcast of fixed size. Labels, language, source and doc_id are
never inputs of a score.

Defined results: a null or empty text has no words, so its score is that of
the bias alone; a label of an unknown document and a null label are ignored;
of several labels of one doc_id the highest counts, of several texts of one
doc_id the first in order is learnt from; without labels of both kinds every
text has the share of toxic labels as its score (0 without any); repeated rows
are scored each; scores are finite whatever the labelled texts hold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import text_or_empty

#: Labelled documents that training takes at most, and bytes of their texts.
MAX_LABELLED, MAX_BYTES = 6_000, 1 << 25
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
WINDOW = 16
EPOCHS = 6
BATCH = 128
LEFT_OUT = 0.3
RATE = 0.02
DECAY = 0.1
PUSH, CLIP = 0.15, 20.0
#: Training steps at least; few labelled rows are gone through more often.
STEPS = 200
#: Share of the training texts, and their number at most, that a bucket must occur in; rarer ones keep the zero vector.
LEAST_SHARE, LEAST_TEXTS = 0.01, 40
#: How much the pool of a text's windows favours the strongest.
SHARP = 4.0
#: Times that a window's average is taken before the softmax.
SCALE = 16.0
WORD = re.compile(r"\w+")
#: Words whose logits a scoring worker keeps; a full cache is emptied.
CACHE_WORDS = 400_000


def features(word: str) -> list[int]:
    """Buckets of a word and of its n-grams."""
    marked = f"<{word}>"
    grams = {marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pooled(logits: np.ndarray) -> float:
    """Soft maximum of a text's window logits."""
    top = logits.max()
    return float(top + np.log(np.exp(SHARP * (logits - top)).mean()) / SHARP)


@dataclass
class Model:
    """One logit for each bucket (its embedding through the linear softmax) and the bias."""

    bucket_logits: np.ndarray
    bias: float

    def score(self, text: str, known: dict[str, float]) -> float:
        words = words_of(text)
        logits = np.empty(len(words), np.float64)
        for k, w in enumerate(words):
            x = known.get(w)
            if x is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                x = known[w] = float(self.bucket_logits[features(w)].mean())
            logits[k] = x
        if len(logits):
            starts = np.arange(0, len(logits), WINDOW)
            means = np.add.reduceat(logits, starts) / np.diff(np.append(starts, len(logits)))
            z = pooled(SCALE * means) + self.bias
        else:
            z = self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each row."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class _Bags:
    """Texts as rows of word numbers, words as bags of buckets, in flat arrays."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {}
        rows = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int32) for t in texts]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.word = np.concatenate([*rows, np.empty(0, np.int32)])
        bags = [np.array(features(w), np.int32) for w in numbers]
        self.size = np.array([len(b) for b in bags], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.gram = np.concatenate([*bags, np.empty(0, np.int32)])
        seen = np.zeros(BUCKETS, np.int32)
        for r in rows:
            used = np.unique(r)
            seen[np.unique(self.gram[_ranges(self.at[used], self.size[used])])] += 1
        self.common = seen >= min(LEAST_TEXTS, max(2, LEAST_SHARE * len(texts)))

    def part(self, texts: np.ndarray) -> tuple[np.ndarray, ...]:
        """For a batch: word of each place, window of each place, text of each window, and the words' grams with their words."""
        length = self.length[texts]
        windows = -(-length // WINDOW)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        window = np.repeat(np.cumsum(windows) - windows, length) + place // WINDOW
        used, word = np.unique(self.word[_ranges(self.start[texts], length)], return_inverse=True)
        owner = np.repeat(np.arange(len(used)), self.size[used])
        return word, window, np.repeat(np.arange(len(texts)), windows), self.gram[_ranges(self.at[used], self.size[used])], owner


#: The logit of label 1 against label 0.
SIDES = np.array([-1.0, 1.0])


def loss_and_gradients(weights: dict[str, np.ndarray], part: tuple[np.ndarray, ...], y: np.ndarray, kept: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """Mean loss of a batch, d loss / d (embedding @ softmax @ SIDES) of each bucket, and the gradients of softmax and bias.

    ``part`` is that of ``_Bags.part``; ``kept`` tells which grams take part.
    """
    word, window, text, gram, owner = part
    n, n_words, n_windows = len(y), int(owner.max(initial=-1)) + 1, len(text)
    diff = weights["softmax"] @ SIDES
    share = kept / np.maximum(np.bincount(owner, minlength=n_words) * (1 - LEFT_OUT), 1)[owner]
    word_logit = np.bincount(owner, share * (weights["embedding"] @ diff)[gram], n_words)
    length = np.bincount(window, minlength=n_windows)
    z = SCALE * np.bincount(window, word_logit[word], n_windows) / np.maximum(length, 1)
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, z)
    top = np.where(np.isfinite(top), top, 0)
    e = np.exp(SHARP * (z - top[text]))
    total, count = np.bincount(text, e, n), np.bincount(text, minlength=n)
    logit = np.where(count > 0, top + np.log(np.maximum(total, 1e-300) / np.maximum(count, 1)) / SHARP, 0) + weights["bias"] @ SIDES
    loss = float((np.logaddexp(0, logit) - y * logit).mean())
    error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) / n
    to_window = SCALE * error[text] * e / total[text] / np.maximum(length, 1)
    to_word = np.bincount(word, to_window[window], n_words)
    to_bucket = np.bincount(gram, share * to_word[owner], BUCKETS)
    return loss, to_bucket, {"softmax": np.outer(to_bucket @ weights["embedding"], SIDES), "bias": error.sum() * SIDES}


def train(texts: list[str], toxic: list[int], seed: int = 11) -> Model:
    """Fit embeddings and softmax jointly."""
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    rng = np.random.default_rng(seed)
    bags = _Bags(texts)
    weights = {"embedding": np.zeros((BUCKETS, DIM)), "softmax": rng.normal(0, 0.5, (DIM, 2)), "bias": np.zeros(2)}
    weights["bias"][1] = np.log(y.mean() / (1 - y.mean()))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    order = rng.permutation(len(y))
    batches = np.array_split(order, -(-len(y) // BATCH))
    step, scale, epochs = 0, 0.0, max(EPOCHS, -(-STEPS // len(batches)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            part = bags.part(batches[k])
            kept = (rng.random(len(part[3])) >= LEFT_OUT) & bags.common[part[3]]
            _, to_bucket, grads = loss_and_gradients(weights, part, y[batches[k]], kept)
            diff = weights["softmax"] @ SIDES
            step += 1
            for name, grad in grads.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                weights[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            touched = np.flatnonzero(to_bucket)
            if not len(touched):
                continue
            # one scale for all buckets: what pulls the same way in many texts moves most
            grad = np.outer(to_bucket[touched], diff)
            square = (grad * grad).mean()
            scale = square if not scale else scale + 0.02 * (square - scale)
            weights["embedding"][touched] -= PUSH * rate * np.clip(grad / np.sqrt(scale + 1e-30), -CLIP, CLIP) + rate * DECAY * weights["embedding"][touched]
    return Model(weights["embedding"] @ (weights["softmax"] @ SIDES), float(weights["bias"] @ SIDES))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: F.Column, most: int = MAX_LABELLED, most_bytes: int = MAX_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` labelled documents for which ``learn`` (over doc_id) holds.

    Sizes come first, so no more than ``most_bytes`` of text reach the driver;
    documents are taken by the hash of their id, one that no longer fits is left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    source = docs.select("doc_id", text_or_empty().alias("text"))
    sizes = source.select("doc_id", F.octet_length("text").alias("size")).join(picked, "doc_id").groupBy("doc_id").agg(F.max("size").alias("size"))
    chosen, room = [], most_bytes
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["size"] <= room:
            chosen.append((r["doc_id"],))
            room -= r["size"]
    if not chosen:
        return [], []
    wanted = picked.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema)), "doc_id")
    rows = source.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [min(1, max(0, r.toxic)) for r in rows]


def learnable(doc_id: str = "doc_id") -> F.Column:
    """Whether a document's label may be learnt; the rest are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = held.value, {}
        for batch in batches:
            scores = [own.score(t.as_py(), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(run, "doc_id bigint, score double")


def score_column(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each whole text as one more column; only texts go to the Python workers."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = held.value, {}
        for part in texts:
            yield pd.Series([own.score(t, known) for t in part], dtype="float64")

    return docs.withColumn(name, scores(text_or_empty(text_col)))
