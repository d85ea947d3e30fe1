"""Hierarchical residual best-fit packing of token sequences (operator 8).

Every document becomes pieces of at most ``capacity`` tokens; pieces go into
sequences of that size. Each partition packs its pieces by best-fit decreasing
in bounded windows. Sequences with almost no room left are final. All others
become items of the next round: dealt anew over fewer partitions, each packing
whole underfull sequences into one another (or their pieces anew where that
takes fewer sequences). There are ``FAN_IN`` times fewer partitions in each
round, but so many that one has about half a ``WINDOW`` of items; it ends with
one partition, or once a round of such partitions saves less than a thousandth
of the sequences. No row is dropped.

Each round is checkpointed in the shared folder before it is read twice (final
sequences, underfull ones), so both halves stem from the same packing even if
an executor is lost.

Defined results: a null or empty text has the terminator alone; repeated rows
are packed as often as they occur; a document longer than the capacity is cut
from its end, so only its first piece may be shorter; equal sizes are taken in
the order of id, piece and checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.bpe import load
from threadloom.llm.common import cut, text_or_empty

CAPACITY = 2048
#: Room in tokens up to which a sequence counts as full.
NEARLY_FULL = 4
#: Items that a task holds while it packs its partition.
WINDOW = 65_536
#: Partitions that become one in the next round.
FAN_IN = 8

PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)
PLACED = T.StructType([*PIECE.fields, T.StructField("offset", T.LongType())])
BIN = T.StructType([T.StructField("size", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("sequence_id", T.LongType()), T.StructField("pieces", T.ArrayType(PLACED))])
PIECE_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED_ARROW = pa.struct([*PIECE_ARROW, pa.field("offset", pa.int64())])
BIN_ARROW = pa.schema([("size", pa.int64()), ("open", pa.bool_()), ("sequence_id", pa.int64()), ("pieces", pa.list_(PLACED_ARROW))])


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but perhaps the first."""
    head = n % capacity
    return [head] * bool(head) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, vocab_path: str, terminator: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids with the terminator after them."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    end = terminator.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path, quick=True)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, at = memoryview(bpe.encode(text.as_py()) + end), 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append({"doc_id": doc, "piece": k, "start": at, "length": n, "ids_crc32": zlib.crc32(ids[4 * at : 4 * (at + n)])})
                    at += n
            yield pa.RecordBatch.from_struct_array(pa.array(rows, PIECE_ARROW))

    return source.mapInArrow(run, PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin, by position in ``sizes``.

    ``sizes`` fall. Bit r of ``rooms`` tells whether a bin with r room is
    open, so the tightest bin that takes an item is the lowest bit from its
    size up.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0
    for k, size in enumerate(sizes):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _round(bins: DataFrame, stage: int, capacity: int, nearly_full: int, window: int) -> DataFrame:
    """One round in each partition; input columns ``size, pieces``."""

    def order(item: tuple[int, list[dict]]) -> tuple:
        p = item[1][0]
        return (-item[0], p["doc_id"] is None, p["doc_id"] or 0, p["piece"], p["ids_crc32"], len(item[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, out = 0, []
        base = (stage << 53) | (TaskContext.get().partitionId() << 32)

        def put(size: int, pieces: list[dict], open_: bool) -> None:
            nonlocal made
            at = 0
            for p in pieces:
                p["offset"] = at
                at += p["length"]
            out.append({"size": size, "open": open_, "sequence_id": base | made, "pieces": pieces})
            made += 1

        def drain() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=BIN_ARROW)
            out.clear()
            return batch

        def fewest(items: list) -> tuple[list, list[list[int]]]:
            """Whole sequences as items or, where that takes fewer sequences, their pieces anew."""
            items.sort(key=order)
            whole = best_fit([s for s, _ in items], capacity)
            if stage:
                apart = sorted(((p["length"], [p]) for _, pieces in items for p in pieces), key=order)
                anew = best_fit([s for s, _ in apart], capacity)
                if len(anew) < len(whole):
                    return apart, anew
            return items, whole

        def pack(items: list) -> list:
            items, fitted = fewest(items)
            packed = []
            for members in fitted:
                size = sum(items[k][0] for k in members)
                pieces = [p for k in members for p in items[k][1]]
                if capacity - size <= nearly_full:
                    put(size, pieces, False)
                else:
                    packed.append((size, pieces))
            packed.sort(key=lambda x: (x[0], x[1][0]["doc_id"] or 0, x[1][0]["piece"], x[1][0]["ids_crc32"]))
            return packed

        held: list = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= window:
                held = pack(held)
                for size, pieces in held[window // 2 :]:
                    put(size, pieces, True)
                del held[window // 2 :]
            if len(out) >= 1024:
                yield drain()
        for size, pieces in pack(held):
            put(size, pieces, True)
            if len(out) >= 1024:
                yield drain()
        yield drain()

    return bins.select("size", "pieces").mapInArrow(run, BIN)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, window: int = WINDOW, forward: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``pieces`` (those of ``token_pieces``).

    ``forward`` was a cap on what a partition passes on; it has no effect.
    """
    first = pieces.select(F.col("length").alias("size"), F.array(F.struct(*PIECE.fieldNames())).alias("pieces"))
    packed = cut(_round(first, 0, capacity, nearly_full, window))
    rounds, n, stage, left = [], packed.rdd.getNumPartitions(), 0, packed.filter("open").count()
    while left > 1 and (n > 1 or not stage or 2 * left > window):
        fewer, stage = max(-(-n // fan_in), -(-2 * left // window)), stage + 1
        rounds.append(packed.filter(~F.col("open")))
        packed = cut(_round(packed.filter("open").repartition(fewer), stage, capacity, nearly_full, window))
        made = packed.count()
        if fewer >= n and 1000 * (left - made) < left:
            break
        n, left = fewer, packed.filter("open").count()
    for r in rounds:
        packed = packed.unionByName(r)
    return packed.select("sequence_id", F.explode("pieces").alias("p")).select(*[f"p.{f}" for f in PIECE.fieldNames()], "sequence_id", "p.offset")


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(token_pieces(docs, vocab_path, capacity=capacity), capacity)
