"""The tools that a host registers: each answers with one text for one conversation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.operators import expand, search, session

NOT_READY = "No conversation is open yet"


@dataclass(frozen=True)
class Tool:
    """A description for the host's model, its arguments, and the call: (tables, conversation, **arguments) -> text."""

    description: str
    arguments: dict[str, str]
    call: Callable[..., str]


def _own(tables: dict[str, DataFrame], conversation: str) -> dict[str, DataFrame]:
    return tables | {k: tables[k].filter(F.col("conversation_id") == conversation) for k in ("messages", "summaries")}


def _text(rows: DataFrame, otherwise: str) -> str:
    row = rows.select("text").first()
    return row["text"] if row else otherwise


def find(tables: dict[str, DataFrame], conversation: str, query: str, kind: str = "all", limit: int = search.DEFAULT_LIMIT) -> str:
    if not query.strip():
        return "Error: query cannot be empty"
    return _text(search.report(_own(tables, conversation), query, kind, limit), f"No results found for '{query}'. Try different search terms.")


def show(tables: dict[str, DataFrame], conversation: str, target: str, format: str = "full") -> str:
    return _text(expand.expand(tables, conversation, target, format == "condensed"), "")


def describe(tables: dict[str, DataFrame], conversation: str, config: EngineConfig | None = None) -> str:
    return _text(session.report(session.describe(_own(tables, conversation), config or EngineConfig())), NOT_READY)


def registered() -> dict[str, Tool]:
    return {
        "search": Tool("Find earlier messages and summaries of this conversation by words.", {"query": "words, phrases, OR, NOT, NEAR", "kind": "messages, summaries or all", "limit": "hits at most"}, find),
        "expand": Tool("The full text of a summary, of messages N to M, or of the best hits of a search.", {"target": "a summary's id, messages:N-M, or a query", "format": "full or condensed"}, show),
        "describe": Tool("What is stored of this conversation.", {}, describe),
    }
