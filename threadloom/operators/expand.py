"""Expansion of a summary, a range of messages, a stored file, or a search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import iso_from_millis
from threadloom.operators import dag, search

#: Characters of an expansion at most, and of what parts two blocks.
CHARS, GAP = 200_000, 5
SEARCH_LIMIT = 5
SUMMARY_ID = re.compile(r"^(?:[0-9a-f]{64}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|c\d+-d\d+-\d+)$", re.I)


def classify(target: str) -> tuple[str, object]:
    """('summary', id), ('range', (first, last)), ('error', text) or ('search', query)."""
    t = target.strip()
    if SUMMARY_ID.match(t):
        return "summary", t.lower()
    if t.startswith("messages:"):
        m = re.match(r"^messages:\s*(\d+)-\s*(\d+)", t)
        return ("range", (int(m[1]), int(m[2]))) if m else ("error", f'Invalid message range format: "{t}". Expected "messages:N-M".')
    return ("search", t) if t else ("error", "target cannot be empty")


def _joined(sections: F.Column) -> F.Column:
    return F.array_join(sections, "\n\n")


def _fitted(sections: F.Column, chars: int) -> F.Column:
    """struct<left, shown>: of the sections, in order, each that still fits (with a blank line before it); one that does not is left out."""
    start = F.struct(F.lit(chars).cast("bigint").alias("left"), F.array().cast("array<string>").alias("shown"))

    def take(acc: F.Column, section: F.Column) -> F.Column:
        cost = F.length(section) + F.when(F.size(acc["shown"]) > 0, 2).otherwise(0)
        return F.when(cost <= acc["left"], F.struct((acc["left"] - cost).cast("bigint").alias("left"), F.array_append(acc["shown"], section).alias("shown"))).otherwise(acc)

    return F.aggregate(sections, start, take)


def summary_texts(tables: dict[str, DataFrame], ids: DataFrame, condensed: bool = False, chars: int = CHARS) -> DataFrame:
    """``summary_id, text`` for each summary of ``ids`` (id): its head, child summaries and, unless ``condensed``, messages.

    Head and children are taken one by one as far as they fit; messages, by
    number, up to the first that does not, and what is left out is counted.
    """
    num = lambda c: F.col(c).cast("string")
    own = tables["summaries"].join(ids.select("id").distinct(), "id").select(F.col("id").alias("summary_id"), "depth", "content")
    linked = tables["summary_messages"].join(ids.select(F.col("id").alias("summary_id")).distinct(), "summary_id").select("summary_id", "message_id").distinct()
    messages = linked.join(tables["messages"].select(F.col("id").alias("message_id"), "sequence_number", "role", "content"), "message_id")
    covered = messages.groupBy("summary_id").agg(F.min("sequence_number").alias("lo"), F.max("sequence_number").alias("hi"), F.count("*").alias("n"))
    below = dag.children(tables["summaries"], tables["summary_parents"]).join(ids.select(F.col("id").alias("parent_id")).distinct(), "parent_id")
    child = F.concat(F.lit("### Child Summary (depth="), num("depth"), F.lit(", id="), F.col("id"), F.lit(")\n"), F.col("content"))
    kids = below.groupBy(F.col("parent_id").alias("summary_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", child.alias("text")))), lambda x: x["text"]).alias("kids"))
    rows = own.join(covered, "summary_id", "left").join(kids, "summary_id", "left").na.fill(0, ["lo", "hi", "n"])
    head = F.array(
        F.concat(F.lit("=== Expanded: Summary "), F.col("summary_id"), F.lit(" (depth "), num("depth"), F.lit(") ===")),
        F.concat(F.lit("Summary text:\n"), F.col("content")),
        F.concat(F.lit("Covers messages: "), num("lo"), F.lit("-"), num("hi"), F.lit(" ("), num("n"), F.lit(" messages)")),
    )
    empty = F.array().cast("array<string>")
    title = empty if condensed else F.when(F.col("n") > 0, F.array(F.lit("Original message content:"))).otherwise(empty)
    fitted = rows.select("summary_id", "n", _fitted(F.concat(head, F.coalesce("kids", empty), title), chars).alias("f"))
    if condensed:
        return fitted.select("summary_id", _joined(F.col("f.shown")).alias("text"))
    block = F.concat(F.lit("[#"), num("sequence_number"), F.lit(" "), F.col("role"), F.lit("] "), F.col("content"))
    w = W.partitionBy("summary_id").orderBy("sequence_number", "message_id")
    room = fitted.select("summary_id", F.col("f.left").alias("room"), (F.size("f.shown") > 0).alias("after"))
    blocks = messages.select("summary_id", "sequence_number", "message_id", block.alias("text"), F.row_number().over(w).alias("k")).join(room, "summary_id")
    cost = F.length("text") + F.when(F.col("after") | (F.col("k") > 1), 2).otherwise(0)
    within = blocks.withColumn("run", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("run <= room")
    shown = within.groupBy("summary_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("blocks"), F.max("run").alias("used"))
    left = F.col("f.left") - F.coalesce("used", F.lit(0))
    sections = F.concat(F.col("f.shown"), F.coalesce("blocks", empty))
    hidden = F.col("n") - F.size(F.coalesce("blocks", empty))
    note = F.concat(F.lit("... ("), hidden.cast("string"), F.lit(" more messages not shown)"))
    fits = (hidden > 0) & (F.length(note) + F.when(F.size(sections) > 0, 2).otherwise(0) <= left)
    return fitted.join(shown, "summary_id", "left").select("summary_id", _joined(F.when(fits, F.array_append(sections, note)).otherwise(sections)).alias("text"))


def _blocks_within(rows: DataFrame, per: list[str], order: list, header: int, chars: int) -> DataFrame:
    """``text`` of the rows' blocks (column ``block``) up to the first with which header and blocks exceed the limit, parted by rules."""
    w = W.partitionBy(*per).orderBy(*order)
    run = F.lit(header) + F.sum(F.length("block") + GAP).over(w.rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumns({"_run": run, "_k": F.row_number().over(w)}).filter(F.col("_run") <= chars)
    return kept.groupBy(*per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("text"))


def range_texts(messages: DataFrame, first: int, last: int, chars: int = CHARS) -> DataFrame:
    """``conversation_id, text`` of the messages ``first`` to ``last`` of each conversation; the range reaches the scan."""
    header = f"=== Messages {first}-{last} ==="
    rows = messages.filter(F.col("sequence_number").between(first, last))
    block = F.concat(F.lit("[#"), F.col("sequence_number").cast("string"), F.lit(" "), F.col("role"), F.lit(" | "), iso_from_millis(F.unix_millis("created_at")), F.lit("]\n"), F.col("content"))
    shown = _blocks_within(rows.select("conversation_id", "sequence_number", "id", block.alias("block")), ["conversation_id"], ["sequence_number", "id"], len(header), chars)
    every = messages.groupBy("conversation_id").agg(F.count_if(F.col("sequence_number").between(first, last)).alias("n"))
    none = F.lit(f"No messages found in range {first}-{last} for this session.")
    return every.join(shown, "conversation_id", "left").select("conversation_id", F.when(F.col("n") == 0, none).otherwise(F.concat_ws("\n\n", F.lit(header), "text")).alias("text"))


def found(tables: dict[str, DataFrame], query: str, limit: int = SEARCH_LIMIT, per: str | None = None) -> DataFrame:
    """The best hits with the blocks of their full texts."""
    hits = search.search_all(tables["messages"], tables["summaries"], query, limit=limit, per=per)
    time = iso_from_millis(F.unix_millis("created_at"))
    m = F.concat(F.lit("[Message #"), F.col("sequence_number").cast("string"), F.lit(" | "), F.col("role"), F.lit(" | "), time, F.lit("]\n"), F.col("content"))
    s = F.concat(F.lit("[Summary depth="), F.col("depth").cast("string"), F.lit(" | "), time, F.lit("]\n"), F.col("content"))
    texts = tables["messages"].select(F.lit("message").alias("type"), "id", m.alias("block")).unionByName(tables["summaries"].select(F.lit("summary").alias("type"), "id", s.alias("block")))
    return hits.join(texts, ["type", "id"])


def search_texts(tables: dict[str, DataFrame], query: str, limit: int = SEARCH_LIMIT, chars: int = CHARS) -> DataFrame:
    """``conversation_id, text``: the full texts of each conversation's best hits."""
    header = f'=== Full content for: "{query}" ==='
    shown = _blocks_within(found(tables, query, limit, "conversation_id"), ["conversation_id"], ["rank", "type", "id"], len(header), chars)
    every = tables["messages"].select("conversation_id").unionByName(tables["summaries"].select("conversation_id")).distinct()
    none = F.lit(f'No results found for: "{query}"')
    return every.join(shown, "conversation_id", "left").select("conversation_id", F.when(F.col("text").isNull(), none).otherwise(F.concat_ws("\n\n", F.lit(header), "text")).alias("text"))


def expand(tables: dict[str, DataFrame], conversation: str, target: str, condensed: bool = False, chars: int = CHARS) -> DataFrame:
    """One row with the ``text`` that a target stands for within one conversation; others are out of reach."""
    spark = tables["messages"].sparkSession
    text = lambda x: spark.createDataFrame([(x,)], "text string")
    kind, what = classify(target)
    if kind == "error":
        return text(what)
    own = tables | {k: tables[k].filter(F.col("conversation_id") == conversation) for k in ("messages", "summaries")}
    if kind == "summary":
        ids = own["summaries"].filter(F.lower("id") == what).select("id")
        if ids.isEmpty():
            return text(f"Summary not found: {what}")
        return summary_texts(own, ids, condensed, chars).select("text")
    made = range_texts(own["messages"], *what, chars=chars) if kind == "range" else search_texts(own, what, chars=chars)
    none = f"No messages found in range {what[0]}-{what[1]} for this session." if kind == "range" else f'No results found for: "{what}"'
    return text(none) if made.isEmpty() else made.select("text")
