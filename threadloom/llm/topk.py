"""Exact top-k search: inverted index and block-max WAND for BM25 (operator 7).

Documents are indexed in shards of a bounded number of documents: for each
term the documents and frequencies, cut into blocks of ``BLOCK`` documents, of
which the largest contribution is known once the global statistics are. The
index is written once to the shared folder.

The queries' terms are written to the shared folder once, and dealt by hash to
blocks of bounded size (``QUERY_TERMS`` terms of all queries together; a block
that is larger by chance is dealt again), so what is sent to all tasks has a
fixed bound. For a block, the shards first give the document frequencies of its
terms; from all of them follow the global statistics. Then each task runs the
queries over its shards and keeps one running top k a query: a block of
documents is skipped if the sum of its terms' block maxima cannot reach the
k-th score so far; blocks are taken from the largest bound down, so that score
rises early. The best of each task go to the shared folder block by block, so
neither the plan nor the driver grows with the queries; they merge exactly, as
all tasks use the same global statistics.

A shard takes its queries in batches. Terms that few of its documents have are
added up first, as their lists are no longer than the list of blocks; a block's
bound is the best such sum in it and the maxima of the common terms. Skipping is
by whole blocks for all common terms at once rather than by a moving pivot, and
no block below every threshold of a batch is read. Common terms are a matrix in
32 bits, and only documents that may still be among the best within its error
are scored in 64 bits.

Equal texts have equal scores: a shard searches only the first document of each
text (by a 128-bit digest), and the first ``k`` documents of a found text take
its place in the end. All of them count in the statistics. ``Shard.known`` and
``Shard.read_`` count postings of the queries' terms, and those that were read.

Scores are rounded to nine decimals, so equal texts have equal scores; ties go
to the smaller doc_id. Only documents that share a term
with the query are found.

Defined results: each distinct word (letters, digits and underscores, in lower
case) of a query counts once; a null or empty query finds nothing, a null or
empty document is never found but counts as one; null doc_ids are neither
queries nor found; repeated rows are found each.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import arrow_rows, cut, ensure_checkpoint_dir, stored, text_or_empty

K1, B = 1.2, 0.75
#: Documents and bytes of text of one shard at most (a single longer text has a shard of its own).
SHARD_DOCS, SHARD_BYTES = 4_096, 1 << 25
BLOCK = 16
#: Distinct terms of all queries of one block at most (a single longer query is a block of its own); each block reads all shards twice, and sends 4 bytes a term of each query and 16 a distinct one to the tasks.
QUERY_TERMS = 4_000_000
#: Tasks a core that a block's search is dealt to at most: in a task, a query's threshold goes on from shard to shard.
TASKS = 4
#: A term that one in so many of a shard's documents has is common; so many of the most frequent at most, the others keep their postings.
DENSE, COMMON = 32, 1_024
#: Terms of the queries that are looked up in a shard at a time.
PART_TERMS = 500_000
#: Queries of a batch, and postings of their rarer terms, at most (a single query with more is a batch of its own).
BATCH, BATCH_POSTS = 256, 2_000_000
#: Queries of a batch whose rarer terms are added up together: their sums stay in the cache.
FEW = 32
#: Blocks of documents that are scored together; and those of each query's best such tile that are taken first, to raise the threshold.
TILE, FIRST = 64, 8
WORD = re.compile(r"\w+")
INDEX = "shard bigint, digests binary, docs binary, lengths binary, terms binary, starts binary, post_doc binary, post_tf binary"
#: Bits of a document's number in its shard; a place is the shard and that number.
PLACE = 15


class Hashes(dict):
    """Word -> hash."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def terms_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Shard:
    """One shard's index; built from term counts, or read from a row."""

    def __init__(self, docs, lengths, terms, starts, post_doc, post_tf):
        self.docs, self.lengths, self.terms, self.starts, self.post_doc, self.post_tf = docs, lengths, terms, starts, post_doc, post_tf
        self.places = np.arange(len(docs))
        self.known = self.read_ = 0

    @classmethod
    def build(cls, docs: list[int], lengths: list[int], hashes: list[np.ndarray], counts: list[np.ndarray]) -> Shard:
        term = np.concatenate([*hashes, np.empty(0, np.uint64)])
        tf = np.concatenate([*counts, np.empty(0, np.uint32)])
        doc = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(h) for h in hashes])
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        return cls(np.array(docs, np.int64), np.array(lengths, np.int64), term[at], np.append(at, len(term)).astype(np.int64), doc, tf)

    def row(self) -> tuple[bytes, ...]:
        return tuple(np.ascontiguousarray(x).tobytes() for x in (self.docs, self.lengths, self.terms, self.starts, self.post_doc, self.post_tf))

    @classmethod
    def read(cls, row: dict) -> Shard:
        kinds = {"docs": np.int64, "lengths": np.int64, "terms": np.uint64, "starts": np.int64, "post_doc": np.uint32, "post_tf": np.uint32}
        return cls(*(np.frombuffer(row[k], t) for k, t in kinds.items()))

    def only(self, alive: np.ndarray, shard: int = 0) -> Shard:
        """The index of some of the documents, which keep their places."""
        kept = self
        if not alive.all():
            some = alive[self.post_doc]
            starts = np.append(0, np.cumsum(some))[self.starts]
            held = np.diff(starts) > 0
            number = (np.cumsum(alive) - 1).astype(np.uint32)
            kept = Shard(self.docs[alive], self.lengths[alive], self.terms[held], np.append(starts[:-1][held], starts[-1]), number[self.post_doc[some]], self.post_tf[some])
        kept.places = np.flatnonzero(alive) + (shard << PLACE)
        return kept

    def prepare(self, avgdl: float) -> None:
        """Contributions (but for the idf), and the common terms' matrix with its maxima by block."""
        norm = K1 * (1 - B + B * self.lengths / avgdl)
        self.df = np.diff(self.starts)
        # half the width stays in the cache
        self.post = self.post_doc.astype(np.uint16) if len(self.docs) <= 1 << 16 else self.post_doc
        tf = self.post_tf.astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + norm[self.post])
        # a rarer term mostly stands once in a document, and its contribution then follows from the document; the others' postings also have what is beyond that
        self.single = np.zeros(-(-len(self.docs) // BLOCK) * BLOCK)
        self.single[: len(norm)] = (K1 + 1) / (1 + norm)
        more = np.flatnonzero(self.post_tf > 1)
        self.more_starts, self.more_doc = np.searchsorted(more, self.starts), self.post[more]
        self.more = self.impact[more] - self.single[self.post[more]]
        self.n_blocks = -(-len(self.docs) // BLOCK)
        # terms that many documents have are columns of a matrix: their postings would be nearly as long
        common = np.flatnonzero(self.df * DENSE >= max(len(self.docs), DENSE * BLOCK))
        if len(common) > COMMON:
            common = np.sort(common[np.argsort(-self.df[common], kind="stable")[:COMMON]])
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((self.n_blocks * BLOCK, len(common)))
        for k, t in enumerate(common):
            lo, hi = self.starts[t], self.starts[t + 1]
            self.dense[self.post[lo:hi], k] = self.impact[lo:hi]
        self.rough = self.dense.astype(np.float32)
        self.rough_max = self.rough.reshape(self.n_blocks, BLOCK, len(common)).max(1)
        # sums of so many positive numbers of 32 bits are right up to this share
        self.slack = (len(common) + 16) * 2.0**-23

    def search(self, terms: np.ndarray, idf: np.ndarray, top: TopK) -> None:
        """Run one query (sorted term hashes) and update its top k."""
        self.search_all(Plan([(0, terms)], terms, idf), top)

    def search_all(self, plan: Plan, top: TopK) -> None:
        """Run all queries of a plan and update their top k, a batch of queries at a time."""
        place = np.full(len(plan.terms), -1, np.int32)
        at = np.minimum(np.searchsorted(plan.terms, self.terms), len(plan.terms) - 1)
        own = np.flatnonzero(plan.terms[at] == self.terms)
        place[at[own]] = own
        a = 0
        while a < len(plan.docs):
            b = max(a + 1, int(np.searchsorted(plan.starts, plan.starts[a] + PART_TERMS, "right")) - 1)
            self._part(plan, place, top, a, b)
            a = b

    def _part(self, plan: Plan, place: np.ndarray, top: TopK, first: int, last: int) -> None:
        ids = plan.ids[plan.starts[first] : plan.starts[last]]
        term = place[ids]
        own = np.flatnonzero(term >= 0)
        query = np.repeat(np.arange(last - first), np.diff(plan.starts[first : last + 1]))[own]
        term, weight = term[own].astype(np.int64), plan.idf[ids[own]]
        self.known += int(self.df[term].sum())
        column = self.column[term]
        some = column >= 0
        common = (query[some], column[some], weight[some])
        query, term, weight = query[~some], term[~some], weight[~some]
        posts = np.cumsum(np.bincount(query, self.df[term], last - first))
        a = 0
        while a < last - first:
            b = min(last - first, a + BATCH, max(a + 1, int(np.searchsorted(posts, (posts[a - 1] if a else 0) + BATCH_POSTS, "right"))))
            r, c = slice(*np.searchsorted(query, (a, b))), slice(*np.searchsorted(common[0], (a, b)))
            self._batch(top, first + a, b - a, (query[r] - a, term[r], weight[r]), (common[0][c] - a, common[1][c], common[2][c]))
            a = b

    def _batch(self, top: TopK, a: int, m: int, rare: tuple, common: tuple) -> None:
        """Queries ``a`` to ``a + m`` of ``top``; ``rare`` (query, term, idf) and ``common`` (query, column, idf) are sorted by query.

        The rarer terms' postings are added up first: their lists are shorter
        than the list of blocks. A block's bound is the best such sum in it and
        the common terms' maxima. Where a bound may reach the k-th score, the
        common terms are added in 32 bits, and documents that may still reach it
        are scored in 64.
        """
        width = self.n_blocks * BLOCK
        if not width or not len(rare[0]) + len(common[0]):
            return
        query, term, weight = rare
        self.read_ += int(self.df[term].sum())

        def added(part: slice, lo: int, hi: int, starts: np.ndarray, doc: np.ndarray, gain: np.ndarray | None = None) -> np.ndarray:
            at = starts[term[part]]
            n = starts[term[part] + 1] - at
            post = np.repeat(at - (np.cumsum(n) - n), n)
            post += np.arange(len(post))
            slot, value = np.repeat((query[part] - lo) * width, n), np.repeat(weight[part], n)
            slot += doc[post]
            if gain is not None:
                value *= gain[post]
            return np.bincount(slot, value, (hi - lo) * width).reshape(hi - lo, width)

        base = np.empty((m, width))
        for lo in range(0, m, FEW):
            hi = min(lo + FEW, m)
            part = slice(*np.searchsorted(query, (lo, hi)))
            np.multiply(added(part, lo, hi, self.starts, self.post), self.single, out=base[lo:hi])
            base[lo:hi] += added(part, lo, hi, self.more_starts, self.more_doc, self.more)
        query, column, weight = common
        asked = np.zeros((m, self.dense.shape[1]), np.float32)
        asked[query, column] = weight
        first = np.searchsorted(query, np.arange(m + 1))
        size = np.diff(first)
        most = short = base.astype(np.float32)
        for _ in range(BLOCK.bit_length() - 1):
            most = np.maximum(most[:, ::2], most[:, 1::2])
        bound = (most + asked @ self.rough_max.T) * (1 + self.slack)
        bound[bound <= 0] = -np.inf
        best = bound.argmax(1) // TILE
        for early in (True, False) if np.isneginf(top.least_of(a, m)).any() else (False,):
            for lo in range(0, self.n_blocks, TILE):
                hi, least = min(lo + TILE, self.n_blocks), top.least_of(a, m)
                part = bound[:, lo:hi]
                live = (part >= least[:, None]) & (part > 0)
                if early:
                    live &= (best == lo // TILE)[:, None]
                    if FIRST < hi - lo:
                        live &= part >= np.partition(part, -FIRST, axis=1)[:, [-FIRST]]
                q = np.flatnonzero(live.any(1))
                if not len(q):
                    continue
                least, live = least[q], np.flatnonzero(live.any(0))
                fresh = part[np.ix_(q, live)] > 0
                bound[np.ix_(q, lo + live)] = -np.inf
                docs = slice(lo * BLOCK, hi * BLOCK) if len(live) == hi - lo else ((lo + live)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                rough = self.rough[docs]
                score = (asked if len(q) == m else asked[q]) @ rough.T
                score += short[:, docs] if len(q) == m else short[:, docs][q]
                self.read_ += int(size[q].sum()) * len(rough)
                need = np.maximum(least, 0)
                new = np.flatnonzero(np.isneginf(least))
                if len(new) and score.shape[1] >= top.k:
                    need[new] = np.partition(score[new], -top.k, axis=1)[:, -top.k] * (1 - self.slack) - 1e-9
                # what is positive stays so in 32 bits
                i, d = np.nonzero(score >= np.maximum(need * (1 - self.slack), 1e-30)[:, None].astype(np.float32))
                new = fresh[i, d // BLOCK]
                i, d = i[new], d[new]
                if not len(i):
                    continue
                n = size[q[i]]
                entry = np.repeat(first[q[i]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                doc = (np.arange(docs.start, docs.stop) if isinstance(docs, slice) else docs)[d]
                total = base[q[i], doc] + np.bincount(np.repeat(np.arange(len(i)), n), self.dense[np.repeat(doc, n), column[entry]] * weight[entry], len(i))
                top.add(a + q[i], total, self.docs[doc], self.places[doc])


class Plan:
    """The queries of a block: ``docs``, and the places in ``terms`` (``ids``) of each one's terms, from ``starts``."""

    def __init__(self, asked: list[tuple[int, np.ndarray]], terms: np.ndarray, idf: np.ndarray):
        self.docs, self.terms, self.idf = np.array([q for q, _ in asked], np.int64), terms, idf
        self.starts = np.cumsum([0, *(len(t) for _, t in asked)])
        self.ids = np.concatenate([np.searchsorted(terms, t).astype(np.int32) for _, t in asked])


class TopK:
    """The best k (score, doc_id) and their places of each of ``n`` queries so far; equal scores: the smaller doc_id."""

    def __init__(self, k: int, n: int = 1):
        self.k, self.scores, self.sums, self.docs, self.places = k, np.full((n, k), -np.inf), np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    @property
    def doc(self) -> np.ndarray:
        return self.docs[np.isfinite(self.scores)]

    @property
    def score(self) -> np.ndarray:
        return self.scores[np.isfinite(self.scores)]

    def least_of(self, a: int, m: int) -> np.ndarray:
        """What a sum must reach to be among the k best once rounded."""
        return self.scores[a : a + m, -1] - 1e-9

    def add(self, query: np.ndarray, total: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
        # sums of equal texts may differ in their last bits; what is returned is rounded once
        score = np.round(total, 9)
        some = score >= self.scores[query, -1]
        own = np.unique(query[some])
        held = np.isfinite(self.scores[own])
        query, score, total, doc, place = (np.concatenate([old, new[some]]) for old, new in ((np.repeat(own, held.sum(1)), query), (self.scores[own][held], score), (self.sums[own][held], total), (self.docs[own][held], doc), (self.places[own][held], place)))
        order = np.lexsort((place, doc, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        at, order = (query[keep], rank[keep]), order[keep]
        self.scores[at], self.sums[at], self.docs[at], self.places[at] = score[order], total[order], doc[order], place[order]


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard."""
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, made = Hashes(), TaskContext.get().partitionId() << 24, 0
        ids, lengths, hashes, counts, digests, size = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            row = (b"".join(digests), *Shard.build(ids, lengths, hashes, counts).row())
            for x in (ids, lengths, hashes, counts, digests):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *(pa.array([v], pa.binary()) for v in row)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                if ids and (len(ids) == SHARD_DOCS or size + len(t) > SHARD_BYTES):
                    yield flush()
                    size, made = 0, made + 1
                size += len(t)
                words = terms_of(t)
                own = Counter(words)
                if len(known) > 1_000_000:
                    known.clear()
                ids.append(doc)
                lengths.append(len(words))
                hashes.append(np.fromiter(map(known.__getitem__, own), np.uint64, len(own)))
                counts.append(np.fromiter(own.values(), np.uint32, len(own)))
                digests.append(hashlib.blake2b(t.encode(), digest_size=16).digest())
        if ids:
            yield flush()

    return source.mapInArrow(run, INDEX)


def copies(index: DataFrame, k: int) -> DataFrame:
    """``digest, doc_id, place, number, first``: the first ``k`` documents of each text by doc_id, and the place of the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs = np.frombuffer(row["docs"], np.int64)
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(docs), [None, pa.py_buffer(row["digests"])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(docs), pa.array((row["shard"] << PLACE) + np.arange(len(docs)))], ["digest", "doc_id", "place"])

    w = W.partitionBy("digest").orderBy("doc_id", "place")
    rows = index.select("shard", "digests", "docs").mapInArrow(run, "digest binary, doc_id bigint, place bigint")
    return stored(rows.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= k).withColumn("first", F.first("place").over(w)))


def query_terms(queries: DataFrame) -> DataFrame:
    """``doc_id, terms`` (sorted hashes) ``, n`` of each distinct query that has words."""
    source = queries.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.array(sorted({xxhash.xxh64_intdigest(w) for w in terms_of(t.as_py())}), np.uint64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in hashes], pa.binary()), pa.array(map(len, hashes), pa.int64())], ["doc_id", "terms", "n"])

    return source.mapInArrow(run, "doc_id bigint, terms binary, n bigint").filter("n > 0").dropDuplicates(["doc_id", "terms"])


def query_blocks(asked: DataFrame, most: int | None = None, own: Column | None = None, total: int | None = None, salt: int = 0) -> Iterator[Column]:
    """Conditions of the blocks of ``query_terms`` rows; each block has at most ``most`` terms, or one query."""
    most, rows = most or QUERY_TERMS, asked if own is None else asked.filter(own)
    total = rows.agg(F.sum("n")).first()[0] if total is None else total
    if not total:
        return
    part = F.pmod(F.xxhash64("doc_id", "terms", F.lit(salt)), F.lit(-(-4 * total // (3 * most))))
    for r in rows.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy("part").collect():
        mine = part == r["part"] if own is None else own & (part == r["part"])
        if r["n"] <= most or r["rows"] == 1:
            yield mine
        else:
            yield from query_blocks(asked, most, mine, r["n"], salt + 1)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score``: the best ``k`` of ``docs`` for each row of ``queries`` (both doc_id, text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    index, all_asked = cut(build_index(docs)), cut(query_terms(queries))
    # a shard at a time: it has tens of megabytes
    arrow_rows(spark, 1)
    same = copies(index, k)
    bits = same.filter("number = 1").groupBy(F.shiftright("place", PLACE).alias("shard")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << PLACE) - 1)).alias("bits"))
    alive = sc.broadcast({r.shard: bytes(r.bits) for r in bits.collect()})
    found = f"{ensure_checkpoint_dir(spark).rstrip('/')}/found-{uuid.uuid4().hex}"
    tasks = TASKS * sc.defaultParallelism
    schema = "query_id bigint, doc_id bigint, place bigint, score double, total double"

    def totals(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"n": [len(x) // 8 for x in pdf["lengths"]], "words": [int(np.frombuffer(x, np.int64).sum()) for x in pdf["lengths"]]})

    n, words = index.select("lengths").mapInPandas(totals, "n bigint, words bigint").agg(F.sum("n"), F.sum("words")).first()
    avgdl = max(words or 0, 1) / (n or 1)
    spark.createDataFrame([], schema).write.parquet(found)
    for block in query_blocks(all_asked) if n else ():
        asked = [(r.doc_id, np.frombuffer(r.terms, np.uint64)) for r in sorted(all_asked.filter(block).collect(), key=lambda r: (r.doc_id, bytes(r.terms)))]
        terms = np.unique(np.concatenate([t for _, t in asked]))
        held = sc.broadcast(terms)

        def local_df(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(held.value), np.int64)
            for batch in batches:
                for row in batch.select(["terms", "starts"]).to_pylist():
                    own, starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int64)
                    at = np.minimum(np.searchsorted(held.value, own), len(held.value) - 1)
                    some = held.value[at] == own
                    df[at[some]] += np.diff(starts)[some]
            hit = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(df[hit], pa.int64())], ["term", "df"])

        counted = stored(index.select("terms", "starts").coalesce(tasks).mapInArrow(local_df, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")))
        arrow_rows(spark, 100_000)
        counted = counted.toArrow()
        arrow_rows(spark, 1)
        df = np.zeros(len(terms), np.float64)
        df[counted["term"].to_numpy()] = counted["df"].to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        plan = sc.broadcast(Plan(asked, terms, idf))

        def run(batches: Iterator[pa.RecordBatch], plan=plan, avgdl=avgdl) -> Iterator[pa.RecordBatch]:
            top = TopK(k, len(plan.value.docs))
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard.read(row)
                    mine = np.unpackbits(np.frombuffer(alive.value.get(row["shard"], b""), np.uint8), bitorder="little").astype(bool)
                    if not mine.any():
                        continue
                    shard = shard.only(mine[: len(shard.docs)], row["shard"])
                    shard.prepare(avgdl)
                    shard.search_all(plan.value, top)
            q = np.repeat(plan.value.docs, np.isfinite(top.scores).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(top.doc), pa.array(top.places[np.isfinite(top.scores)]), pa.array(top.score), pa.array(top.sums[np.isfinite(top.scores)])], ["query_id", "doc_id", "place", "score", "total"])

        index.drop("digests").coalesce(tasks).mapInArrow(run, schema).write.mode("append").parquet(found)
        held.unpersist()
        plan.unpersist()
    alive.unpersist()
    arrow_rows(spark)

    def ranked(df: DataFrame) -> DataFrame:
        w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    others = same.filter("number > 1").groupBy(F.col("first").alias("place")).agg(F.collect_list("doc_id").alias("others"))
    best = ranked(spark.read.schema(schema).parquet(found)).join(others, "place", "left")
    each = F.concat(F.array("doc_id"), F.coalesce("others", F.array().cast("array<bigint>")))
    return ranked(best.select("query_id", "score", "total", F.explode(each).alias("doc_id"))).select("query_id", "rank", "doc_id", F.round("total", 6).alias("score"))


ORACLE = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT d.doc_id, coalesce(l.dl, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, sum(tf) AS dl FROM tfs GROUP BY 1) l USING (doc_id)
), totals AS (
  SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM lengths
), idfs AS (
  SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs, totals GROUP BY term, n
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tfs q JOIN tfs d USING (term) JOIN idfs USING (term) JOIN lengths l ON l.doc_id = d.doc_id, totals
  WHERE q.doc_id % 100 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""
