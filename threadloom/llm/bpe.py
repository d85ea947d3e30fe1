"""BPE encoding and decoding with a contiguous rank array (operator 9).

A vocabulary file of the ``tokenizers`` library (byte-level BPE, JSON) is read
by path. A word is short, so its parts live in three small arrays: the part
boundaries, the part ids, and the rank of each adjacent pair. The smallest rank
is found by a scan, one boundary is deleted, and the two neighbouring ranks are
refreshed. Words above ``SHORT`` bytes, where repeated scans would be
quadratic, use a heap over the same ranks with the same order of merges.

Defined results: a null text counts as the empty text and gives no ids; an
added token's string inside a text is that token, as in the library; ids are
returned as little-endian unsigned 32-bit integers in one binary value, so a
long text needs no boxed array. Repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import text_or_empty

SHORT = 256
#: Entries of each word cache of a worker; a full cache is emptied.
CACHE_WORDS = 600_000
#: Longest string that a cache keeps.
CACHE_CHARS = 64
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
#: Texts below this character may go to the compiled encoder, where speed is asked for.
QUICK_BELOW = chr(0x250)


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return table


class _Spaced(dict):
    """Ids of a part of a text with the space before it; a missing one is encoded."""

    def __init__(self, span):
        super().__init__()
        self.span = span

    def __missing__(self, part: str) -> bytes:
        found = self.span(" " + part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[part] = found
        return found


class RankArrayBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, quick: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] * self.size + vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])
        self.words = regex.compile(PATTERN)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.quick = None
        if quick:
            import tiktoken

            self.quick = tiktoken.Encoding("threadloom", pat_str=PATTERN, mergeable_ranks={self.token_bytes[i]: i for i in vocab.values()}, special_tokens={})
        self.pieces: dict[str, bytes] = {}
        self.spaced = _Spaced(self._span)

    # -- one word ---------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-tokenized word."""
        if len(word) > SHORT:
            return self._merge_long(word)
        rank, merged, size = self.rank.get, self.merged, self.size
        ids = [self.byte_id[b] for b in word]
        bounds = list(range(len(word) + 1))
        ranks = [rank(a * size + b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = new = merged[least]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + new, NONE)
            if i < len(ranks):
                ranks[i] = rank(new * size + ids[i + 1], NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        rank, merged, size = self.rank.get, self.merged, self.size
        ids, n = [self.byte_id[b] for b in word], len(word)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or rank(ids[i] * size + ids[j], NONE) != r:
                continue
            ids[i], live[j], after[i] = merged[r], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := rank(ids[i] * size + ids[after[i]], NONE)) != NONE:
                    heapq.heappush(heap, (q, i))
            if (k := before[i]) >= 0 and (q := rank(ids[k] * size + ids[i], NONE)) != NONE:
                heapq.heappush(heap, (q, k))
        return [ids[i] for i in range(n) if live[i]]

    # -- whole texts ------------------------------------------------------

    def _piece(self, word: str) -> bytes:
        found = self.pieces.get(word)
        if found is None:
            ids = self.merge(word.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= CACHE_CHARS:
                if len(self.pieces) >= CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[word] = found
        return found

    def _span(self, text: str) -> bytes:
        """Ids of a text, or of a part of it that begins at a safe cut."""
        if self.quick is not None and max(text, default="") < QUICK_BELOW:
            ids = self.quick.encode_ordinary(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        piece = self._piece
        return b"".join([piece(w) for w in self.words.findall(text)])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        A single space between others always begins a new word of the pattern,
        so the text may be cut before it; only runs of spaces need the pattern
        over the whole text.
        """
        if "  " in text:
            return self._span(text)
        first, *rest = text.split(" ")
        return b"".join([self._span(first), *map(self.spaced.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.split_added is None:
            return self._plain(text)
        parts = self.split_added.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return b"".join(struct.pack("<I", self.added[p]) if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self.token_bytes
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str, quick: bool = False) -> RankArrayBPE:
    """One encoder for each vocabulary and worker; ``quick`` leaves new Latin words to tiktoken's compiled one."""
    return RankArrayBPE(path, quick)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col, n_tokens, ids`` (binary) of every whole text, and ``decoded``, the text that its ids give, if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            ids = [bpe.encode(t.as_py()) for t in batch.column(1)]
            cols = [batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = [id_col, "n_tokens", "ids"]
            if decoded:
                cols.append(pa.array([bpe.decode(b) for b in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` of binary ids; null ids give the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    source = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(b.as_py()) for b in batch.column(1)], pa.string())], [id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return encode(docs, vocab_path, decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
