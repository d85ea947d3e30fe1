"""Exact substring dedup by a logarithmic family of suffix arrays (operator 10).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id. All of a text's strings of that length take
part, and each is judged on the input.

The work is dealt so that equal strings meet without all suffixes travelling:

1. Documents are dealt into batches of neighbouring doc_ids, by bytes. A string's anchor
   is the smallest hash among its substrings of ``GRAM`` bytes. It follows
   from the string alone, so equal strings have equal anchors, and runs of
   neighbouring strings share one (about one anchor for 13 bytes). Each batch
   sends 4 bytes for each distinct anchor to the anchor's bucket.
2. A bucket tells each batch which of its anchors other batches have too.
   Strings whose anchor no other document has cannot match.
3. The batch sends the remaining runs, as the bytes that they cover, to their
   buckets; equal runs of a batch go once. Anchors that very many documents
   have (a common line, whose edges differ in each document) send string by
   string, dealt by the whole string, so they fill no single bucket.
4. In a bucket the runs come in the order of doc_id, in batches; equal runs are
   combined. Each new batch gets a suffix array over its text (sorted to
   ``LENGTH`` bytes, as longer matches consist of such); it is merge-scanned
   against the levels, which hold all earlier ones, for equal strings; then it
   becomes a level, and levels of equal class merge, so there are
   logarithmically many. The family lives as long as its bucket's task: kept
   over jobs, it would have to hold all suffixes of the input.
5. Matches return to the documents as byte spans.

Strings are compared byte by byte in steps 3 and 4, hashes only choose
candidates. A document's text is dealt out once and read from that exchange
three times; there is no driver-side state, and all steps are functions of a
batch's or a bucket's rows alone, so a lost executor's part can be recomputed.

Defined results: a null or empty text, or one under ``LENGTH`` bytes, keeps
all; null doc_ids count as smallest; rows of equal doc_id never remove from
each other; repeats within one document stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.llm.common import small_batches, text_or_empty

LENGTH = 50
GRAM = 25
GRAMS = LENGTH - GRAM + 1
#: Strings looked at in one go.
CHUNK = 1 << 19
#: An anchor is hot if so many documents of a batch, or so many batches, have it.
HOT_DOCS = 12
HOT_BATCHES = 1024
#: Strings of one batch of a bucket's family at least, and batches of one bucket at most.
STEP, STEPS = 1 << 14, 16
#: Ranges of bytes of a batch of documents and of a bucket; within them both grow with the root of the input.
BATCH_BYTES, BUCKET_BYTES = (1 << 20, 1 << 24), (1 << 22, 1 << 25)
#: A batch of more than so many times its share is split by text.
OVER = 4
#: Split batches up to which their list is broadcast.
BROADCAST = 50_000
LONGEST = LENGTH + GRAMS - 1
WIDTH = LONGEST + 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64


def power(n: int) -> np.uint64:
    return U(pow(int(BASE), n, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX
    return (h ^ (h >> U(29))) * MIX


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def grams(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of each substring of GRAM bytes, by doubling lengths."""
    parts, size, step = [], 1, BYTE[data]
    done: np.ndarray | None = None
    left, at = GRAM, 0
    while left:
        if left & 1:
            piece = step[at : at + len(data) - GRAM + 1]
            done = piece if done is None else done * power(size) + piece
            at += size
        left >>= 1
        if left:
            step = step[: len(step) - size] * power(size) + step[size:]
            size *= 2
    del parts
    return done


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings of one anchor in the concatenated documents: start, number of strings, anchor, and a hash of the run's bytes."""
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[a : a + CHUNK + LENGTH - 1]
        h = grams(part)
        anchor = least(mixed(h), GRAMS)
        n = len(anchor)
        whole = h[:n] * power(GRAM) + h[GRAM : GRAM + n]
        doc = np.searchsorted(ends, np.arange(a, a + n), "right")
        good = np.arange(a + LENGTH, a + LENGTH + n) <= ends[np.minimum(doc, len(ends) - 1)]
        new = good.copy()
        new[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = good.copy()
        stop[:-1] &= ~good[1:] | new[1:]
        last = np.flatnonzero(stop)
        # a run has at most GRAMS strings unless its text repeats; longer ones are cut
        count = last - first + 1
        if (count > GRAMS).any():
            times = -(-count // GRAMS)
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first, last = np.repeat(first, times) + k * GRAMS, np.repeat(last, times)
            last = np.minimum(last, first + GRAMS - 1)
            count = last - first + 1
        out.append((first + a, count, anchor[first], mixed(whole[first] * MIX + whole[last] * BASE + count.astype(np.uint64))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class Batch:
    """A batch's documents, in the order of doc_id and text, as one array of bytes."""

    def __init__(self, rows: pa.Table):
        ids = [-(1 << 63) if i is None else i for i in rows.column("doc_id").to_pylist()]
        texts = rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.rows = order
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.raw = rows.column("doc_id").to_pylist()
        self.data = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
        self.size = np.array([len(texts[k]) for k in order], np.int64)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size

    def runs(self) -> tuple[np.ndarray, ...]:
        start, count, anchor, whole = runs(self.data, self.ends, self.starts)
        return start, count, anchor, whole, np.searchsorted(self.ends, start, "right")


def keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and the 32 bits that stand for an anchor within it."""
    return ((anchor >> U(32)) % U(buckets) << U(32)) | (anchor & U(0xFFFFFFFF))


def many(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the number of documents that have each."""
    order = np.lexsort((doc, value))
    v, d = value[order], doc[order]
    new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.empty(0, bool)
    other = new | np.r_[True, d[1:] != d[:-1]] if len(v) else new
    at = np.flatnonzero(new)
    return v[at], np.add.reduceat(other.astype(np.int64), at) if len(at) else at


def within(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def windows(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes: the length, then the run's bytes, then zeros."""
    out = np.zeros((len(start), WIDTH), np.uint8)
    if len(start):
        at = np.minimum(start[:, None] + np.arange(LONGEST), len(data) - 1)
        out[:, 0] = length
        out[:, 1:] = data[at] * (np.arange(LONGEST) < length[:, None])
    return out


def split_rows(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(bucket) else []
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(at, [*at[1:], len(order)], strict=True)] if len(at) else []


def ordered(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes that start at ``at``, and which of them (in order) differ from the one before.

    Eight bytes at a time as one number: positions are sorted by the first
    eight, and ties, only those, by the next ones.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    steps = [min(k, max(length - 8, 0)) for k in range(0, length, 8)]

    def word(p: np.ndarray, step: int) -> np.ndarray:
        w = np.ascontiguousarray(words[p + step]).view(">u8").ravel().astype(U)
        return w >> U(8 * (8 - length)) if length < 8 else w

    key = word(at, 0)
    order = np.argsort(key)
    new = np.ones(len(at), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    for step in steps[1:]:
        tied = np.flatnonzero(~new | np.r_[~new[1:], False]) if len(new) else np.empty(0, np.int64)
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        key = word(at[order[tied]], step)
        turn = np.lexsort((key, group))
        order[tied] = order[tied][turn]
        key, same = key[turn], group[1:] == group[:-1]
        new[tied[1:][same & (key[1:] != key[:-1])]] = True
    return order, new


class SuffixArray:
    """The sorted suffixes of a batch's text, cut to the length of a match, each once, and the smallest document of each."""

    def __init__(self, suffixes: np.ndarray, docs: np.ndarray):
        self.suffixes, self.docs = suffixes, docs

    @classmethod
    def of(cls, text: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
        """Suffix array of a batch; also the entry of each of ``at``."""
        order, new = ordered(text, at, length)
        entry = np.empty(len(at), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        if not len(first):
            return cls(np.empty(0, f"S{length}"), docs), entry
        windows_ = np.lib.stride_tricks.sliding_window_view(text, length)[at[order[first]]]
        return cls(np.ascontiguousarray(windows_).view(f"S{length}").ravel(), np.minimum.reduceat(docs[order], first)), entry

    def scan(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of ``other`` that this array has too, and the documents here; both are in order, so each search goes on from the last."""
        if not len(self.suffixes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.suffixes, other.suffixes), len(self.suffixes) - 1)
        hit = np.flatnonzero(self.suffixes[place] == other.suffixes)
        return hit, self.docs[place[hit]]

    def merged(self, other: SuffixArray) -> SuffixArray:
        """Both as one; a stable sort merges two parts that are in order in linear time."""
        both, docs = np.concatenate([self.suffixes, other.suffixes]), np.concatenate([self.docs, other.docs])
        order = np.argsort(both, kind="stable")
        both, docs = both[order], docs[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else order
        return SuffixArray(both[first], np.minimum.reduceat(docs, first) if len(first) else docs)


class SuffixLevels:
    """Logarithmic family: suffix arrays of all earlier batches; a level of class k stands for 2^k batches.

    A new batch is merge-scanned against each level for strings of ``length``
    bytes that it shares with them; then it becomes a level of class 0, and
    two levels of one class merge into one of the next.
    """

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: list[tuple[int, SuffixArray]] = []
        self.most = 0

    def add(self, text: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Take in a batch's strings (start in ``text`` and document; documents not smaller than before); whether each also starts in a smaller document."""
        own, entry = SuffixArray.of(text, at, docs, self.length)
        earliest = own.docs.copy()
        for _, level in self.levels:
            hit, there = level.scan(own)
            earliest[hit] = np.minimum(earliest[hit], there)
        found = docs > earliest[entry] if len(at) else np.zeros(0, bool)
        self.levels.append((0, own))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (k, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((k + 1, a.merged(b)))
        self.most = max(self.most, len(self.levels))
        return found


def search_bucket(ctx: np.ndarray, docs: np.ndarray, levels: SuffixLevels | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, first byte, end byte) of a bucket's runs that also start in smaller documents.

    Equal runs are combined first: only that of the smallest document goes
    through the family, as all strings of the others start in that one too.
    """
    n = len(docs)
    if not n:
        return (np.empty(0, np.int64),) * 3
    by_doc = np.argsort(docs, kind="stable")
    text = ctx.view(f"S{WIDTH}").ravel()
    order = by_doc[np.argsort(text[by_doc], kind="stable")]
    sorted_ = text[order]
    group = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
    head = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
    head_of = np.empty(n, np.int64)
    head_of[order] = group
    length = ctx[:, 0].astype(np.int64)
    full = np.flatnonzero(docs > docs[head[head_of]])
    out = [(full, np.zeros(len(full), np.int64), length[full])]
    # the strings of distinct runs, in the order of documents
    turn = np.argsort(docs[head], kind="stable")
    levels, at = levels or SuffixLevels(), 0
    spans: list[tuple[np.ndarray, ...]] = []
    numbers = length[head[turn]] - LENGTH + 1
    total = np.cumsum(numbers)
    step = max(STEP, -(-int(total[-1]) // STEPS))
    while at < len(turn):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
        rows = head[turn[at:end]]
        many_ = numbers[at:end]
        row = np.repeat(np.arange(len(rows)), many_)
        off = np.arange(len(row)) - np.repeat(np.cumsum(many_) - many_, many_)
        hit = levels.add(ctx[rows, 1:].ravel(), row * LONGEST + off, docs[rows[row]])
        first = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (row[1:] != row[:-1])]) if len(hit) else np.empty(0, np.int64)
        last = np.flatnonzero(hit & np.r_[~hit[1:] | (row[1:] != row[:-1]), True]) if len(hit) else first
        spans.append((turn[at:end][row[first]], off[first], off[last] + LENGTH))
        at = end
    g, a, b = map(np.concatenate, zip(*spans, strict=True))
    if len(g):
        # runs equal to a head and of its own document share its spans
        rest = np.flatnonzero(docs == docs[head[head_of]])
        by = np.argsort(g, kind="stable")
        g, a, b = g[by], a[by], b[by]
        lo, hi = np.searchsorted(g, head_of[rest], "left"), np.searchsorted(g, head_of[rest], "right")
        times = hi - lo
        pick = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out.append((np.repeat(rest, times), a[pick], b[pick]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _joined(col: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype)


MARKS = "bucket int, batch bigint, low binary, hot binary"
ASKED = "bucket int, batch bigint, kind int, doc binary, at binary, start binary, ctx binary"
SPANS = "batch bigint, at binary, start binary, stop binary"


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, cols, types, strict=True)})


def with_batches(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with the ``_batch`` of each row, and the number of buckets, both by bytes.

    A batch is a range of doc_ids. One with far more bytes than its share (rows
    without an id, repeated ids, long texts) is split by the texts' hashes.
    """
    spark, doc_id = docs.sparkSession, F.col("doc_id").cast("bigint")
    size = F.octet_length(text_or_empty()).cast("bigint")
    low, high, total = docs.agg(F.min(doc_id), F.max(doc_id), F.sum(size)).first()
    total = total or 0
    batch_bytes = min(max(BATCH_BYTES[0], 64 * math.isqrt(total)), BATCH_BYTES[1])
    bucket_bytes = min(max(BUCKET_BYTES[0], 256 * math.isqrt(total)), BUCKET_BYTES[1])
    buckets = max(4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-total // bucket_bytes))
    span = (high or 0) - (low or 0) + 1
    bits = min(62, max(0, (batch_bytes * span // max(1, total)).bit_length() - 1))
    ranged = docs.withColumn("_batch", F.shiftright(F.coalesce(doc_id, F.lit(-(1 << 63))), bits))
    large = ranged.groupBy("_batch").agg(F.sum(size).alias("_bytes")).filter(F.col("_bytes") > OVER * batch_bytes).select("_batch", F.ceil(F.col("_bytes") / F.lit(batch_bytes)).alias("_parts"))
    n = large.count()
    if n:
        parted = ranged.join(F.broadcast(large) if n <= BROADCAST else large, "_batch", "left")
        split = F.xxhash64("_batch", F.pmod(F.xxhash64(text_or_empty()), F.col("_parts")))
        ranged = parted.withColumn("_batch", F.when(F.col("_parts").isNull(), F.col("_batch")).otherwise(split)).drop("_parts")
    return ranged, buckets


def covered_spans(docs: DataFrame, others: list[str] | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The dealt-out documents (``batch, doc_id, text`` as bytes, others as ``o_*``) and, by batch, the spans to remove."""
    spark = docs.sparkSession
    small_batches(spark)
    ranged, buckets = with_batches(docs)
    dealt = ranged.select(F.col("_batch").alias("batch"), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("binary").alias("text"), *[F.col(c).alias(f"o_{c}") for c in others])

    def mark(key: tuple, rows: pa.Table) -> pa.Table:
        b = Batch(rows)
        _, _, anchor, _, doc = b.runs()
        value, n = many(keys(anchor, buckets), doc)
        made = []
        for bucket, pos in split_rows((value >> U(32)).astype(np.int64)):
            low = value[pos].astype(np.uint32)
            made.append((bucket, key[0].as_py(), _blob(low), _blob(low[n[pos] >= HOT_DOCS])))
        return _table(made, ["bucket", "batch", "low", "hot"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def shared(key: tuple, rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint32) for x in rows.column("low").to_pylist()]
        value = np.concatenate(blobs)
        kinds, n = np.unique(value, return_counts=True)
        common = kinds[n > 1]
        hot = np.unique(np.concatenate([_joined(rows.column("hot"), np.uint32), kinds[n >= HOT_BATCHES]]))
        made = []
        for batch, low in zip(rows.column("batch").to_pylist(), blobs, strict=True):
            own = low[within(common, low)]
            if len(own):
                made.append((key[0].as_py(), batch, _blob(own), _blob(own[within(hot, own)])))
        return _table(made, ["bucket", "batch", "low", "hot"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def ask(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        b = Batch(rows)
        start, count, anchor, whole, doc = b.runs()
        batch, key_ = key[0].as_py(), keys(anchor, buckets)
        known, hot = [], []
        for bucket, low, hot_ in zip(*(told.column(c).to_pylist() for c in ("bucket", "low", "hot")), strict=True):
            known.append(np.frombuffer(low, np.uint32).astype(U) | U(bucket << 32))
            hot.append(np.frombuffer(hot_, np.uint32).astype(U) | U(bucket << 32))
        value, n = many(key_, doc)
        known = np.unique(np.concatenate([*known, value[n > 1]]))
        hot = np.unique(np.concatenate([*hot, np.empty(0, U)]))
        take = within(known, key_)
        start, count, key_, whole, doc = (x[take] for x in (start, count, key_, whole, doc))
        each = within(hot, key_)
        if each.any():
            c = count[each]
            one = np.repeat(start[each], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            h = np.zeros(len(one), U)
            for k in range(LENGTH):
                h = h * BASE + BYTE[b.data[one + k]]
            h = mixed(h)
            start, count = np.concatenate([start[~each], one]), np.concatenate([count[~each], np.ones(len(one), np.int64)])
            doc, whole = np.concatenate([doc[~each], np.repeat(doc[each], c)]), np.concatenate([whole[~each], h])
            key_ = np.concatenate([key_[~each], keys(h, buckets)])
        length = count + LENGTH - 1
        # equal runs of the batch: the first document's stands for later documents'
        order = np.lexsort((doc, whole))
        first = np.cumsum(np.r_[0, whole[order][1:] != whole[order][:-1]]) if len(order) else order
        head = order[np.flatnonzero(np.r_[True, first[1:] != first[:-1]])][first] if len(order) else order
        later = np.zeros(len(order), bool)
        later[order] = b.ids[doc[order]] > b.ids[doc[head]]
        rep = np.empty(len(order), np.int64)
        rep[order] = head
        at = np.flatnonzero(later)
        for lo in range(0, len(at), CHUNK >> 3):
            some = at[lo : lo + (CHUNK >> 3)]
            same = (windows(b.data, start[some], length[some]) == windows(b.data, start[rep[some]], length[rep[some]])).all(1)
            later[some[~same]] = False
        made = []
        if later.any():
            own = np.flatnonzero(later)
            off = b.starts[doc[own]]
            made.append((int(batch % buckets), batch, 1, b"", _blob(doc[own].astype(np.int32)), _blob(start[own] - off), _blob(start[own] - off + length[own])))
        sent, squeeze = np.flatnonzero(~later), zstandard.ZstdCompressor(level=3)
        for bucket, pos in split_rows((key_[sent] >> U(32)).astype(np.int64)):
            p = sent[pos]
            made.append((bucket, batch, 0, _blob(b.ids[doc[p]]), _blob(doc[p].astype(np.int32)), _blob(start[p] - b.starts[doc[p]]), squeeze.compress(_blob(windows(b.data, start[p], length[p])))))
        return _table(made, ["bucket", "batch", "kind", "doc", "at", "start", "ctx"], [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4])

    def find(key: tuple, rows: pa.Table) -> pa.Table:
        cols = {c: rows.column(c).to_pylist() for c in rows.column_names}
        made = [(cols["batch"][k], cols["at"][k], cols["start"][k], cols["ctx"][k]) for k in range(rows.num_rows) if cols["kind"][k] == 1]
        asked = [k for k in range(rows.num_rows) if cols["kind"][k] == 0]
        if asked:
            asked.sort(key=lambda k: cols["batch"][k])
            for k in asked:
                cols["ctx"][k] = zstandard.decompress(cols["ctx"][k])
            cat = lambda c, t: np.frombuffer(b"".join(cols[c][k] for k in asked), t)
            docs_, at, start, ctx = cat("doc", np.int64), cat("at", np.int32), cat("start", np.int64), cat("ctx", np.uint8).reshape(-1, WIDTH)
            from_ = np.repeat(np.arange(len(asked)), [len(cols["doc"][k]) // 8 for k in asked])
            row, a, z = search_bucket(ctx, docs_)
            for k, pos in split_rows(from_[row]):
                made.append((cols["batch"][asked[k]], _blob(at[row[pos]]), _blob(start[row[pos]] + a[pos]), _blob(start[row[pos]] + z[pos])))
        return _table(made, ["batch", "at", "start", "stop"], [pa.int64(), *[pa.binary()] * 3])

    marks = dealt.groupBy("batch").applyInArrow(mark, MARKS)
    told = marks.groupBy("bucket").applyInArrow(shared, MARKS)
    asked = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(ask, ASKED)
    return dealt, asked.groupBy("bucket").applyInArrow(find, SPANS)


def _gone(b: Batch, found: pa.Table) -> np.ndarray:
    """Whether each byte of a batch is in a removed span."""
    n = len(b.data)
    depth = np.zeros(n + 1, np.int32)
    at, start, stop = _joined(found.column("at"), np.int32), _joined(found.column("start"), np.int64), _joined(found.column("stop"), np.int64)
    np.add.at(depth, b.starts[at] + start, 1)
    np.add.at(depth, b.starts[at] + stop, -1)
    return np.cumsum(depth[:n]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans`` (array of start, stop: maximal removed runs, in bytes) and ``kept`` (binary) of every document."""
    dealt, spans = covered_spans(docs)

    def take(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        b = Batch(rows)
        gone = _gone(b, found)
        out_spans, kept = [], []
        for lo, hi in zip(b.starts, b.ends, strict=True):
            own = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            out_spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(b.data[lo:hi][~own].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"doc_id": pa.array([b.raw[k] for k in b.rows], pa.int64()), "n_bytes": pa.array(b.size, pa.int64()), "spans": pa.array(out_spans, span), "kept": pa.array(kept, pa.binary())})

    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    return dealt.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(take, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (columns of any other names go along) with the repeats cut out of ``text``.

    A character stays whole if one of its bytes does, so the text stays UTF-8;
    a null text becomes empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    dealt, spans = covered_spans(docs, others)
    schema = docs.select("doc_id", "text", *others).schema
    arrow = to_arrow_schema(schema)

    def take(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        b = Batch(rows)
        gone = _gone(b, found)
        lead = (b.data & 0xC0) != 0x80
        lead[b.starts[b.size > 0]] = True
        at = np.flatnonzero(lead)
        whole = np.logical_and.reduceat(gone, at) if len(at) else gone
        keep = ~np.repeat(whole, np.diff(np.append(at, len(b.data)))) if len(at) else ~gone
        texts = [b.data[lo:hi][keep[lo:hi]].tobytes().decode() for lo, hi in zip(b.starts, b.ends, strict=True)]
        cols = {"doc_id": pa.array([b.raw[k] for k in b.rows]), "text": pa.array(texts, pa.string())}
        for c in others:
            cols[c] = rows.column(f"o_{c}").take(pa.array(b.rows, pa.int64()))
        return pa.table(cols).cast(arrow)

    return dealt.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(take, schema)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    done = remove_repeats(docs)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
