"""Token counters: a protocol, the estimate, and a compiled byte-pair encoder by path."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import CHARS_PER_TOKEN, col


class TokenCounter(Protocol):
    """Counts the tokens of a text; instances travel to the executors."""

    def count(self, text: str) -> int: ...


class Estimate:
    """Code points by 3.5, rounded up."""

    def count(self, text: str) -> int:
        return math.ceil(len(text) / CHARS_PER_TOKEN)


@lru_cache(maxsize=4)
def _encoder(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Vocabulary:
    """Tokens of a vocabulary file of the tokenizers library, which each executor reads from ``path``."""

    def __init__(self, path: str):
        self.path = path

    def count(self, text: str) -> int:
        return len(_encoder(self.path).encode(text, add_special_tokens=False).ids) if text else 0


def count_tokens(text: Column | str, counter: TokenCounter) -> Column:
    """Tokens of a text, in Arrow batches; 0 for null."""

    @F.pandas_udf("int")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in it:
            yield pd.Series([counter.count(t) if t else 0 for t in part], dtype="int32")

    return count(col(text))


def split_at(text: str, budget: int, counter: TokenCounter) -> tuple[str, str]:
    """The longest prefix within a budget, by bisection over its length, and the rest."""
    if counter.count(text) <= budget:
        return text, ""
    fits, over = 0, len(text)
    while over - fits > 1:
        middle = (fits + over) // 2
        fits, over = (middle, over) if counter.count(text[:middle]) <= budget else (fits, middle)
    return text[:fits], text[fits:]


def split_by_counter(text: Column | str, budget: int, counter: TokenCounter) -> Column:
    """struct<head, tail> as ``split_by_budget`` gives, by any counter."""

    @F.pandas_udf("head string, tail string")
    def split(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in it:
            yield pd.DataFrame([split_at(t or "", budget, counter) for t in part], columns=["head", "tail"])

    return split(col(text))
