"""SimHash near-duplicates with a Gray-order hierarchical index (operator 6).

1. Each whole text gets a 64-bit fingerprint of its word shingles.
2. Equal fingerprints are one node: copies are never expanded into pairs.
3. Two fingerprints that differ in at most d bits agree in all but d of d + 4
   blocks of bits. Every distinct fingerprint goes once to each choice of kept
   blocks, so all links meet under some key, and the few free bits bound what
   one key can hold (2 bits: 15 keys, at most 2^22 distinct fingerprints).
4. Under a key the fingerprints are sorted by Gray rank and put in a hierarchy:
   bits that all members of a node share are factored into the node, the key's
   own bits into its root. A search goes down by levels, adds up the
   differences in factored bits, and drops a whole group once they exceed d.
   The hierarchies of all keys of a task are built and searched together. The
   links found become a spanning forest, so what leaves a group grows with its
   members, not its pairs.
5. Components of the forest edges name the groups by their smallest doc_id.

Defined results: a null or empty text has the fingerprint 0, linked like any
other; fewer words than a shingle has give one shingle of them all; a null
doc_id never names a component unless its component has no other; repeated
rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, stored, text_or_empty
from threadloom.llm.components import connected_components

BITS = 64
SEED = 42
#: Children of an index node.
FAN = 16
#: Rows of whole groups that a task works on at a time.
CHUNK = 65_536
#: Queries go down the index together as far as this many members of their groups, each group counted up to LEVEL_COST.
QUERY_COST, LEVEL_COST = 1 << 20, 1 << 12


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z count as a-z."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as bigint) of every whole text."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority_bits(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id bigint, fp bigint")


# -- the index under one key ------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies over distinct codes, one for each group (``group`` ascends), sorted by Gray rank.

    Level 0 are the codes. A node of a higher level has up to ``FAN``
    consecutive nodes of one group below it; ``mask`` are the bits that all
    codes under it share and ``value`` those bits. Bits factored higher up are
    not compared again. The last level has one root a group. ``visits`` counts
    the nodes that searches have looked at.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(codes), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[self.order], group[self.order]
        self.visits = 0
        #: mask and value of each node; first node below and their number
        self.levels = [(np.full(len(codes), ~np.uint64(0)), self.codes, np.arange(len(codes)), np.ones(len(codes), np.int64))]
        self.root = np.zeros(len(codes), np.int64)
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(group)))
            if len(self.levels) > 1 and (sizes == 1).all():
                self.root = np.repeat(np.arange(len(sizes)), self.sizes)
                return
            if len(self.levels) == 1:
                self.sizes = sizes
            place = np.arange(len(group)) - np.repeat(starts, sizes)
            first = np.flatnonzero(place % FAN == 0)
            count = np.diff(np.append(first, len(group)))
            mask, value = self.levels[-1][:2]
            if len(first):
                shared = np.bitwise_and.reduceat(mask & ~(value ^ np.repeat(value[first], count)), first)
                self.levels.append((shared, value[first] & shared, first, count))
            else:
                self.levels.append((mask, value, first, count))
            group = group[first]

    def search(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (position, position) in ``codes`` of all pairs of a group that differ in ``most`` bits or fewer, each once."""
        cost = np.cumsum(np.minimum(np.repeat(self.sizes, self.sizes), LEVEL_COST))
        at = 0
        while at < len(self.codes):
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + QUERY_COST, "right")))
            q = np.arange(at, end)
            node, done, diff = self.root[q], np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, value, first, count = self.levels[depth]
                self.visits += len(node)
                diff = diff + np.bitwise_count((self.codes[q] ^ value[node]) & mask[node] & ~done)
                keep = diff <= most
                q, node, diff = q[keep], node[keep], diff[keep]
                if depth == 0 or not len(q):
                    break
                done, times = mask[node], count[node]
                below = np.repeat(first[node] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                q, diff, done, node = np.repeat(q, times), np.repeat(diff, times), np.repeat(done, times), below
            once = q < node
            yield q[once], node[once]
            at = end


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j in ``label``, where each row points to an earlier one of its tree."""
    while len(i):
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def forest(group: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each group; ``group`` ascends, codes are distinct within one."""
    index = GrayIndex(codes, group)
    label = np.arange(len(codes))
    for q, found in index.search(most):
        _hook(label, q, found)
    while not np.array_equal(up := label[label], label):
        label = up
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[moved], index.codes[label[moved]]


# -- all fingerprints ---------------------------------------------------------


def key_masks(most: int) -> list[int]:
    """Masks (as bigint) of the kept bits: all choices of d + 4 blocks less d."""
    blocks = most + 4
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    own = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(m for k, m in enumerate(own) if k not in gone) for gone in combinations(range(blocks), most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link(nodes: DataFrame, most: int = 2) -> DataFrame:
    """Forest edges ``a, b`` that connect just those of the distinct fingerprints ``fp`` that links connect."""
    keys = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(key_masks(most))])
    dealt = nodes.select("fp", F.explode(keys).alias("key")).select("key.k", "key.part", "fp").repartition("k", "part").sortWithinPartitions("k", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(k: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (part[1:] != part[:-1])]) if len(k) else np.empty(0, np.int64)
            several = np.bincount(group, minlength=1)[group] > 1
            a, b = forest(group[several], fp[several].view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= CHUNK:
                k, part, fp = map(np.concatenate, zip(*held, strict=True))
                # the last group may go on
                new = np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1]))
                if not len(new):
                    held, rows = [(k, part, fp)], 0
                    continue
                end = new[-1] + 1
                yield edges(k[:end], part[:end], fp[:end])
                held, rows = [(k[end:], part[end:], fp[end:])], len(k) - end
        if held:
            yield edges(*map(np.concatenate, zip(*held, strict=True)))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    fps = cut(fingerprints(docs, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(link(nodes.select("fp"), most)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# -- near copies of a given similarity ------------------------------------------

#: Bits of a shingle's hash that name its counter in the sketch of frequencies.
SLOT_BITS = 18
#: Counters of one row of the sketch while it is summed up.
SLOTS = 1 << 14
#: Bits in which the fingerprints of near copies may differ, for sets of fewer than ``FEW_SHINGLES`` shingles and for others; a sieve before the exact similarity.
SIEVE_FEW, SIEVE, FEW_SHINGLES = 28, 22, 32
#: Size of a group up to which neighbours are candidates too.
FEW = 8
#: Size of a group up to which the first round meets all pairs.
WHOLE = 4
#: Pairs of fingerprints that are compared at a time.
BLOCK = 1 << 22
#: Members of one part of a large group; two parts at a time meet in a task.
PART = 4_096
#: A block of candidates is dealt to parts of about so many documents, ``SPREAD`` parts at most, or to more of about so many bytes of shingles.
PART_DOCS, SPREAD, PART_BYTES = 256, 16, 1 << 24


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def frequency_sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Texts that have each shingle, counted in ``2**SLOT_BITS`` counters by hash, over all rows; of fixed size."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(part, np.zeros(SLOTS, np.int64))
                held[part] += np.frombuffer(blob.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            slots = [shingle_set(t.as_py(), width) >> np.uint64(64 - SLOT_BITS) for t in batch.column(0)]
            total += np.bincount(np.concatenate([*slots, np.empty(0, np.uint64)]).astype(np.int64), minlength=1 << SLOT_BITS)
        parts = total.reshape(-1, SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    partial = texts.select("text").mapInArrow(counted, schema)
    # two rounds, so that no task reads the rows of all others
    some = partial.repartition("part", F.spark_partition_id() % 64).mapInArrow(summed, schema)
    whole = np.zeros((1 << SLOT_BITS) // SLOTS * SLOTS, np.int64).reshape(-1, SLOTS)
    for r in some.repartition("part").mapInArrow(summed, schema).collect():
        whole[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return whole.ravel()


def prefix_keys(hashes: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles under which a document meets others: its rarest ones, as many as are needed.

    Two sets of Jaccard similarity t or more share at least t times the larger
    one's size, so each has one of the shared shingles among the first
    n - ceil(t n) + 1 of its n in any fixed order. The order is by the sketch
    (rare first) and then by hash; how good the sketch is decides only how many
    documents meet under a key.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    first = n - int(np.ceil(similarity * n - 1e-9)) + 1
    order = np.lexsort((hashes, sketch[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
    return hashes[order[:first]].view(np.int64)


def may_be_alike(fp_a: np.ndarray, fp_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether fingerprints and sizes allow the similarity.

    Sizes decide for certain. At a similarity of 0.8 fingerprints differ in 10
    of 64 bits on average; of random pairs of just that one in 100,000 is beyond
    the sieve.
    """
    few = np.minimum(size_a, size_b)
    return (np.bitwise_count(fp_a ^ fp_b) <= np.where(few < FEW_SHINGLES, SIEVE_FEW, SIEVE)) & (few >= similarity * np.maximum(size_a, size_b) - 1e-9)


def candidate_edges(keyed: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``a, b, size, key``: the candidates of a first round, linear in the rows, and the members of larger groups.

    Within each key each node meets the first and the last in Gray order, in
    small groups also its neighbours, in others also the node nearest to the
    majority of all bits, which in a group of copies is close to their common
    original; ``key`` is null and ``size`` the number of bits that differ. These
    are not all pairs of a group of more than ``WHOLE``: each row of such a group
    comes out as ``node, fp, size, key``, for ``open_pairs``. A pair comes once
    for each key under which it meets. ``keyed``: ``key, fp, node, size``.
    """
    dealt = keyed.select("key", "fp", "node", "size").repartition("key").sortWithinPartitions("key", "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(key: np.ndarray, fp: np.ndarray, node: np.ndarray, n_shingles: np.ndarray, parted: int | None) -> pa.RecordBatch:
            group = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            order = np.lexsort((gray_rank(fp.view(np.uint64)), group))
            fp, node, n_shingles = fp[order].view(np.uint64), node[order], n_shingles[order]
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(key) else group
            size = np.diff(np.append(start, len(key)))
            head, tail, own = start[group], (start + size - 1)[group], size[group]
            i = np.flatnonzero(own > 1)
            few = i[(own[i] <= FEW) & (i > head[i])]
            met = [np.stack([i, head[i]]), np.stack([i, tail[i]]), np.stack([few, few - 1])]
            many = np.flatnonzero(own > FEW)
            if len(many):
                at = np.flatnonzero(np.r_[True, group[many][1:] != group[many][:-1]])
                n = np.diff(np.append(at, len(many)))
                bits = np.unpackbits(fp[many].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                major = np.packbits(2 * np.add.reduceat(bits, at, axis=0, dtype=np.int32) > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
                nearest = np.lexsort((np.bitwise_count(fp[many] ^ np.repeat(major, n)), group[many]))
                met.append(np.stack([many, np.repeat(many[nearest[at]], n)]))
            a, b = np.concatenate(met, axis=1)
            near = may_be_alike(fp[a], fp[b], n_shingles[a], n_shingles[b], similarity) & (node[a] != node[b])
            ends_ = a[near], b[near]
            a, b = node[ends_[0]], node[ends_[1]]
            large = own > WHOLE
            if parted is not None:
                large |= key == parted
            differ = np.bitwise_count(fp[ends_[0]] ^ fp[ends_[1]]).astype(np.int32)
            pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
            pairs, once = np.unique(pairs, axis=0, return_index=True) if len(a) else (pairs, np.empty(0, np.int64))
            ends = np.concatenate([pairs[:, 0], node[large]]), np.concatenate([pairs[:, 1], fp[large].view(np.int64)])
            edge = np.r_[np.ones(len(pairs), bool), np.zeros(large.sum(), bool)]
            under = pa.array(np.concatenate([np.zeros(len(pairs), np.int64), key[large]]), mask=edge)
            sizes = pa.array(np.concatenate([differ[once], n_shingles[large].astype(np.int32)]))
            return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), sizes, under], ["a", "b", "size", "key"])

        held: list[tuple[np.ndarray, ...]] = []
        rows, parted = 0, None
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= CHUNK:
                columns = list(map(np.concatenate, zip(*held, strict=True)))
                key = columns[0]
                new = np.flatnonzero(key[1:] != key[:-1])
                # a key with more rows than a chunk is worked on in parts that share one row; all its pairs meet in open_pairs
                end = int(new[-1]) + 1 if len(new) else len(key)
                if not len(new):
                    parted = key[0]
                yield edges(*(c[:end] for c in columns), parted)
                at = end if len(new) else end - 1
                held, rows = [tuple(c[at:] for c in columns)], len(key) - at
        if held:
            yield edges(*map(np.concatenate, zip(*held, strict=True)), parted)

    return dealt.mapInArrow(run, "a bigint, b bigint, size int, key bigint")


def spanning_forest(order: np.ndarray, linked: Callable[[int], np.ndarray], group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect just those of the members 0, 1, ... that all their links connect.

    ``linked`` gives the members linked with one, ``group`` those connected
    before. Each member is held against all others, in ``order``, until those
    that are left are of one component: members of the largest component come
    last, so a group around a few originals takes a few steps. No more links come
    out than there are members.
    """
    comp = np.arange(len(order)) if group is None else np.unique(group, return_inverse=True)[1]
    left, out = order, []
    while len(left):
        count = np.bincount(comp[left])
        other = np.flatnonzero(comp[left] != count.argmax())
        if not len(other):
            break
        i = int(left[other[0]])
        left = np.delete(left, other[0])
        met = linked(i)
        apart = met[comp[met] != comp[i]]
        if len(apart):
            joined, first = np.unique(comp[apart], return_index=True)
            out += [(i, int(apart[k])) for k in first]
            comp[np.isin(comp, joined)] = comp[i]
    return out


def open_pairs(members: DataFrame, similarity: float = 0.8, forest: bool = False) -> DataFrame:
    """``a, b``: all pairs under one key that are not connected yet and may be alike, by fingerprint and size.

    ``members``: ``key, fp, node, root, size``. Keys whose members are all
    connected go first. A group is dealt to parts of about ``PART`` members, of
    which two at a time meet in a task, in blocks of at most ``BLOCK`` pairs.
    ``forest``: of all these pairs only as many as connect what they connect, so
    that the rows grow with the members.
    """
    own = members.select("key", "fp", "node", "root", "size")
    live = own.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", F.ceil(F.col("n") / F.lit(PART)).cast("int").alias("parts"))
    parted = own.join(live, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "fp", "node", "root", "size")
    dealt = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "part", "node")

    def pairs(x: np.ndarray, y: np.ndarray, part: np.ndarray, fp: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (root == root[0]).all():
            return
        if forest:
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            major = np.packbits(2 * bits.sum(0) > len(fp), bitorder="little").view(np.uint64)[0]
            near_to = lambda i: np.flatnonzero(may_be_alike(fp[i], fp, size[i], size, similarity))
            ends = np.array(spanning_forest(np.argsort(np.bitwise_count(fp ^ major), kind="stable"), near_to, root), np.int64).reshape(-1, 2)
            a, b = node[ends[:, 0]], node[ends[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            return
        # one part against itself, or the first part against the second
        border = len(part) if x[0] == y[0] else int((part == x[0]).sum())
        start = 0 if x[0] == y[0] else border
        step = max(1, BLOCK // max(1, len(fp) - start))
        for lo in range(0, border, step):
            rows, cols = slice(lo, min(lo + step, border)), slice(max(lo, start) if x[0] == y[0] else start, len(fp))
            near = may_be_alike(fp[rows, None], fp[None, cols], size[rows, None], size[None, cols], similarity) & (root[rows, None] != root[None, cols])
            i, j = np.nonzero(near)
            i, j = i + rows.start, j + cols.start
            i, j = i[i < j], j[i < j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            _, x, y, part, fp, node, root, size = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            yield from pairs(x, y, part, fp.view(np.uint64), node, root, size)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new = np.zeros(batch.num_rows, bool)
            for c in columns[:3]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and any(held[-1][k][0] != columns[k][lo] for k in range(3)):
                    yield from flush()
                held.append(tuple(c[lo:hi] for c in columns))
        if held:
            yield from flush()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def alike_edges(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of Jaccard similarity ``similarity`` or more among sets of distinct hashes."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if common and common >= similarity * (n.sum() - common) - 1e-9 else []
    _, own, df = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), n)
    # shingles that one set alone has link nothing
    shared = df[own] > 1
    own, member = own[shared], member[shared]
    post = member[np.argsort(own, kind="stable")]
    start = np.cumsum(np.where(df > 1, df, 0)) - df
    at = np.searchsorted(member, np.arange(len(sets) + 1))

    def linked(i: int) -> np.ndarray:
        ids = own[at[i] : at[i + 1]]
        times = df[ids]
        common = np.bincount(post[np.repeat(start[ids] - (np.cumsum(times) - times), times) + np.arange(times.sum())], minlength=len(sets))
        return np.flatnonzero((common > 0) & (common >= similarity * (n[i] + n - common) - 1e-9))

    weight = np.bincount(member, df[own], len(sets)) / np.maximum(n, 1)
    return spanning_forest(np.argsort(-weight, kind="stable"), linked)


def verified_forest(sets: DataFrame, blocks: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``a, b``: links that connect just those nodes of each block that the exact similarity connects.

    ``blocks``: ``node, block, size``; ``sets``: ``node, hashes`` (rows of a
    node may repeat). All documents of a block meet with their whole shingle
    sets in a task, or, of a large block, two parts at a time; only a forest
    leaves it.
    """
    sized = blocks.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    spread = F.least(F.lit(SPREAD), F.ceil(F.col("n") / F.lit(PART_DOCS)))
    parts = sized.select("block", F.greatest(spread, F.ceil(F.col("shingles") * 8 / F.lit(PART_BYTES))).cast("int").alias("parts"))
    parted = blocks.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # with several parts each meets every other one; its own documents meet in any of these tasks
    several = F.expr("filter(sequence(0, parts - 1), k -> k <> part)")
    cells = parted.withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(several)))
    cells = cells.select("block", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "node")
    dealt = cells.join(sets, "node").select("block", "x", "y", "node", "hashes").repartition("block", "x", "y").sortWithinPartitions("block", "x", "y", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        nodes: list[int] = []
        cell: tuple[int, ...] | None = None
        made: list[tuple[int, int]] = []

        def rows() -> pa.RecordBatch:
            ends = np.array(made, np.int64).reshape(-1, 2)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        def flush() -> None:
            if len(nodes) > 1:
                made.extend((nodes[i], nodes[j]) for i, j in alike_edges(held, similarity))
            nodes.clear()
            held.clear()

        for batch in batches:
            for *of, node, hashes in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if tuple(of) != cell:
                    flush()
                    cell = tuple(of)
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    held.append(np.frombuffer(hashes.as_py(), np.uint64))
            if made:
                yield rows()
        flush()
        yield rows()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def row_key(columns: list[str]) -> list[Column]:
    """``r1, r2``: 128 bits that stand for a row's values; null is not the empty text."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns] + [F.col(c).isNull() for c in columns]
    return [F.xxhash64(*own).alias("r1"), F.xxhash64(F.lit("second"), *own).alias("r2")]


def similar_rows(docs: DataFrame, width: int = 5, similarity: float = 0.8, most: int = 2) -> DataFrame:
    """``r1, r2, doc_id, root, component_id`` of every row; ``root`` names its group.

    Links join documents whose distinct shingles have a Jaccard similarity of
    ``similarity`` or more. Candidates are pairs of whole fingerprints within
    ``most`` bits (found by the index), and pairs that share one of their
    rarest shingles, of which a link always has one (``prefix_keys``). They never
    leave a task as pairs: each key gives a forest that connects its candidates,
    and the components of all these are blocks, within which every link lies.
    All documents of a block are held against the exact similarity, each with its
    shingle set made once, and again only a forest comes out. So documents that
    are less alike are never joined, and rows grow with the documents whatever
    the size of a group. Documents of equal shingle sets are one node throughout.
    """
    spark = docs.sparkSession
    source = docs.select(*row_key(docs.columns), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(source, width))

    def node_of(hashes: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(3)]
            node = pa.array([node_of(s) for s in sets], pa.int64())
            fps = pa.array([majority_bits(s) for s in sets], pa.int64())
            keys = pa.array([prefix_keys(s, sketch.value, similarity) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], node, fps, pa.array(map(len, sets), pa.int32()), keys], ["r1", "r2", "doc_id", "node", "fp", "size", "keys"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    described = stored(source.mapInArrow(describe, "r1 bigint, r2 bigint, doc_id bigint, node bigint, fp bigint, size int, keys array<bigint>"))
    nodes = cut(described.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("r1", "r2")).alias("row"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    # copies meet here, before the keys are dealt out; all rows of a node have its fingerprint and keys
    keyed = described.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    met = stored(candidate_edges(keyed.select(F.explode("keys").alias("key"), "fp", "node", "size"), similarity))
    members = met.filter("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("fp"), "size")
    # fingerprints within a few bits: the index gives a forest over fingerprints
    ends = link(nodes.select("fp").distinct(), most)
    of = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    by_bits = ends.join(of.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    first = connected_components(met.filter("key is null").select("a", "b").unionByName(by_bits)).toDF("node", "block")
    # large groups: all their pairs, as far as these candidates have not connected them
    rest = open_pairs(members.join(first, "node", "left").select("key", "fp", "node", F.coalesce("block", "node").alias("root"), "size"), similarity, forest=True)
    forest = first.select(F.col("node").alias("a"), F.col("block").alias("b")).unionByName(rest)
    blocks = stored(connected_components(forest).toDF("node", "block").join(nodes.select("node", "size"), "node"))
    rows = nodes.join(blocks.select("node"), "node").select("node", "row.r1", "row.r2")
    sets = stored(source.select("r1", "r2", "text").join(rows, ["r1", "r2"]).select("node", "text").mapInArrow(sets_of, "node bigint, hashes binary"))
    roots = connected_components(verified_forest(sets, blocks, similarity))
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("node", "root", "component_id")
    return described.select("r1", "r2", "doc_id", "node").join(named, "node").select("r1", "r2", "doc_id", "root", "component_id")


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, most: int = 2) -> DataFrame:
    """``doc_id, component_id`` of every row: the smallest doc_id of its group (null if none has one)."""
    return similar_rows(docs, width, similarity, most).select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, most: int = 2) -> DataFrame:
    """One row of each group of near copies, all columns as they are: that of the smallest doc_id (null last).

    Rows are told apart by all their values, so a doc_id that occurs with
    several texts loses only the copies; of rows that are equal throughout, and
    of several rows of the smallest doc_id, one stays.
    """
    rows = cut(similar_rows(docs, width, similarity, most))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("own"))
    chosen = first.select("own.r1", "own.r2")
    gone = rows.select("r1", "r2").distinct().join(chosen, ["r1", "r2"], "left_anti")
    several = cut(rows.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2").join(chosen, ["r1", "r2"], "left_semi"))
    keyed = docs.select("*", *[c.alias(f"_{k}") for k, c in zip(("r1", "r2"), row_key(docs.columns), strict=True)])
    mark = lambda df: df.select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"))
    if several.isEmpty():
        return keyed.join(mark(gone), ["_r1", "_r2"], "left_anti").select(docs.columns)
    once = keyed.join(mark(gone.unionByName(several)), ["_r1", "_r2"], "left_anti").select(docs.columns)
    again = keyed.join(mark(several), ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"]).select(docs.columns)
    return once.unionByName(again)
