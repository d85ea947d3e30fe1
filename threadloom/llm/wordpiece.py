"""Word-piece token counts by a linear longest-match automaton (operator 1).

Word pieces are taken greedily: the longest vocabulary entry that begins the
rest of the word, entries after the first being continuations. A trie over
both kinds, with failure links and with the number of tokens that following a
link closes, reads each character once: when the trie has no way on, the
node's link gives the node for the rest not yet closed, and the count of the
tokens closed on the way. Pieces are never built.

Links: for a node of string s, drop the longest entry that begins s, and the
link is the continuation node of the rest, if there is one; else entries are
dropped on. The links of a node follow from its parent's, so the table takes
one pass over the trie.

Vocabulary: entries that begin a word, and continuations. From a byte-level
BPE file they follow by rule: tokens with the mark of a space begin words, the
others continue them; all work on UTF-8 bytes. Words are what white space
parts. A word without a way through is one unknown token, as in word-piece
tokenizers. Words of any length go through the automaton, which is linear in
them; a tokenizer's limit on the characters of a word is an option (``longest``).

Defined results: a null or empty text has 0 words and 0 tokens; repeated rows
are counted each.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bpe import byte_alphabet
from threadloom.llm.common import text_or_empty

#: Words whose counts a worker keeps, and the characters of one that is kept; a full cache is emptied.
CACHE_WORDS, CACHED = 500_000, 64
#: Fixed value: the characters of Unicode's White_Space property.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORDS = re.compile(f"[^{WHITE}]+")


class LongestMatch:
    """Automaton over two sets of byte strings."""

    def __init__(self, begin: Iterable[bytes], go_on: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        entry = [False, False]
        for root, words in ((0, begin), (1, go_on)):
            for w in words:
                node = root
                for b in w:
                    child = self.next[node].get(b)
                    if child is None:
                        child = self.next[node][b] = len(self.next)
                        self.next.append({})
                        entry.append(False)
                    node = child
                if w:
                    entry[node] = True
        n = len(self.next)
        #: link and tokens closed; -1 if nothing can be closed
        self.link, self.closed = [-1] * n, [0] * n
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for b, child in self.next[node].items():
                if entry[child]:
                    self.link[child], self.closed[child] = 1, 1
                else:
                    at, closed = self.link[node], self.closed[node]
                    while at >= 0 and b not in self.next[at]:
                        closed += self.closed[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.closed[child] = self.next[at][b], closed
                todo.append(child)

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 0 if there is no way through."""
        step, link, closed, node, total = self.next, self.link, self.closed, 0, 0
        for b in word:
            while (child := step[node].get(b)) is None:
                total += closed[node]
                node = link[node]
                if node < 0:
                    return 0
            node = child
        while node != 1:
            total += closed[node]
            node = link[node]
            if node < 0:
                return 0
        return total


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word beginnings and continuations of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    raw = [bytes(alphabet[c] for c in t) for t in tokens]
    return [t[1:] for t in raw if t.startswith(b" ") and len(t) > 1], [t for t in raw if not t.startswith(b" ")]


class Counter:
    """Counts of whole texts; a word of more than ``longest`` characters is one unknown token (None: no limit)."""

    def __init__(self, automaton: LongestMatch, longest: int | None = None):
        self.automaton, self.longest, self.known = automaton, longest, {}

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = 1 if self.longest is not None and len(word) > self.longest else self.automaton.count(word.encode()) or 1
            if len(word) <= CACHED:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """(words, tokens)."""
        words = WORDS.findall(text)
        return len(words), sum(map(self.word, words))


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(LongestMatch(*vocabulary(path)))


def token_counts(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocab_path)
        for batch in batches:
            counts = [counter.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))], ["doc_id", "n_words", "n_tokens"])

    return source.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
