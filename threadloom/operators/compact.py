"""Compaction: levels, chunks, leaf summaries, condensation, truncation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.functions.text import estimate_tokens
from threadloom.operators import dag, ingest
from threadloom.sources.checkpoint import checkpointed

#: (texts, depth, level) -> summary text.
Summarizer = Callable[[Sequence[str], int, str], str]
OVER = Fraction(11, 10)


def first_words(texts: Sequence[str], depth: int, level: str) -> str:
    """Deterministic stand-in for a language model."""
    what = "messages" if depth == 0 else "summaries"
    return f"Summary of {len(texts)} {what} about {' '.join((texts[0] if texts else '').split()[:3])}"


def prompt(texts: Column, roles: Column, times: Column, depth: int, level: str) -> Column:
    """The prompt that a language model gets for a chunk (arrays of texts, roles, times)."""
    goal = {0: "Summarize these messages. Keep decisions, facts, names, paths and open questions.", 1: "Condense these summaries into one. Keep outcomes and what they rest on."}.get(depth, "Condense these summaries to the lasting goals, decisions and state.")
    extra = " Be very brief." if level == "aggressive" else ""
    blocks = F.transform(F.arrays_zip(texts.alias("t"), roles.alias("r"), times.alias("c")), lambda x, i: F.concat(F.lit("[#"), i + 1, F.lit(" | "), x["r"], F.lit(" | "), x["c"].cast("string"), F.lit("]\n"), x["t"]))
    return F.concat(F.lit(f"{goal}{extra}\n\n"), F.array_join(blocks, "\n---\n"))


def hook_status(described: DataFrame) -> DataFrame:
    """``conversation_id, text``: what the host's compaction hook adds to its prompt, from ``session.describe``."""
    parts = [F.lit("Stored: "), F.col("n_messages").cast("string"), F.lit(" messages, "), F.col("n_summaries").cast("string"), F.lit(" summaries, depth "), F.col("max_depth").cast("string"), F.lit("; not summarized: "), F.col("active").cast("string"), F.lit(".")]
    return described.select("conversation_id", F.concat(*parts).alias("text"))


def should_summarize(n_messages: Column, n_tokens: Column, config: EngineConfig) -> Column:
    return (n_messages >= config.summarize_after_messages) | (n_tokens >= config.summarize_after_tokens)


def level_for_depth(depth: Column | int, config: EngineConfig) -> Column:
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(d >= config.max_summary_depth, "deterministic").when(d >= config.aggressive_threshold, "aggressive").otherwise("normal")


def state(tables: dict[str, DataFrame], config: EngineConfig) -> DataFrame:
    """One row a conversation: open messages, token load, depth of roots, compaction level, and whether to summarize."""
    soft, hard = config.thresholds()
    open_ = ingest.unsummarized(tables["messages"], tables["summary_messages"]).groupBy("conversation_id").agg(F.count("*").alias("n_open"), F.sum("token_count").alias("open_tokens"))
    tops = dag.roots(tables["summaries"], tables["summary_parents"]).groupBy("conversation_id").agg(F.sum("token_count").alias("root_tokens"), F.max("depth").alias("root_depth"))
    ids = tables["messages"].select("conversation_id").distinct()
    s = ids.join(open_, "conversation_id", "left").join(tops, "conversation_id", "left").na.fill(0)
    s = s.withColumn("load", F.col("open_tokens") + F.col("root_tokens"))
    level = F.when(F.col("root_depth") >= config.max_summary_depth, "deterministic").when(F.col("load") >= hard, "aggressive").when(F.col("root_depth") >= config.aggressive_threshold, "aggressive").otherwise("normal")
    s = s.withColumn("level", level)
    due = should_summarize(F.col("n_open"), F.col("open_tokens"), config) & (F.col("load") >= soft)
    return s.withColumn("due", (F.col("n_open") > 0) & (F.col("level") != "deterministic") & ((F.col("level") == "aggressive") | due))


def chunk_numbers(costs: Sequence[int], is_user: Sequence[bool], target: int) -> list[int]:
    """Chunk of each message. A chunk goes on until it is over the target by a tenth; it then ends before the
    user message whose prefix within that bound comes nearest to the target, or else as late as the bound
    allows, or else before its last message."""
    n = len(costs)
    if target <= 0:
        return [0] * n
    upper, out, begin, chunk = math.ceil(OVER * target), [0] * n, 0, 0
    at = 0
    while at < n:
        at += 1
        while sum(costs[begin:at]) > upper and at - begin > 1:
            sums, run = [], 0
            for k in range(begin, at):
                sums.append(run)
                run += costs[k]
            fits = [k for k in range(1, at - begin) if sums[k] <= upper]
            users = [k for k in fits if is_user[begin + k]]
            cut = min(users, key=lambda k: abs(sums[k] - target)) if users else max(fits, default=at - begin - 1)
            out[begin : begin + cut] = [chunk] * cut
            begin, chunk = begin + cut, chunk + 1
    out[begin:] = [chunk] * (n - begin)
    return out


def chunks(messages: DataFrame, target: int) -> DataFrame:
    """``conversation_id, id, sequence_number, chunk`` for messages to be summarized.

    The state machine runs over one conversation's rows of numbers; texts stay
    behind.
    """
    rows = messages.select("conversation_id", "id", "sequence_number", F.greatest("token_count", F.lit(1)).alias("cost"), (F.col("role") == "user").alias("is_user"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_number", "id"])
        return pdf.assign(chunk=chunk_numbers(pdf["cost"].tolist(), pdf["is_user"].tolist(), target))[["conversation_id", "id", "sequence_number", "chunk"]]

    return rows.groupBy("conversation_id").applyInPandas(split, "conversation_id string, id string, sequence_number int, chunk int")


def _summary_id(depth: Column, first: Column, last: Column) -> Column:
    return F.sha2(F.concat_ws("|", "conversation_id", depth.cast("string"), first.cast("string"), last.cast("string")), 256)


def _written(grouped: DataFrame, summarizer: Summarizer) -> DataFrame:
    """Adds ``content`` to rows with ``texts, depth, level``."""

    @F.pandas_udf("string")
    def write(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, depth, level in it:
            yield pd.Series([summarizer(list(t), int(d), v) for t, d, v in zip(texts, depth, level, strict=True)], dtype=object)

    return grouped.withColumn("content", write("texts", "depth", "level"))


SUMMARY = ["id", "conversation_id", "depth", "content", "token_count", "created_at", "compaction_level"]


def _leaves(tables: dict[str, DataFrame], config: EngineConfig, summarizer: Summarizer, levels: DataFrame) -> DataFrame:
    """New depth-0 summaries with ``parts``, the ids of their messages, for conversations that are due."""
    due = levels.filter("due").select("conversation_id", "level")
    open_ = ingest.unsummarized(tables["messages"], tables["summary_messages"]).join(due, "conversation_id")
    cut = chunks(open_, config.leaf_summary_budget).select("id", "chunk")
    parts = F.array_sort(F.collect_list(F.struct("sequence_number", "id", "content", "created_at", "token_count")))
    grouped = open_.join(cut, "id").groupBy("conversation_id", "level", "chunk").agg(parts.alias("m")).withColumns({"depth": F.lit(0), "texts": F.transform("m", lambda x: x["content"])})
    made = _written(grouped, summarizer).withColumns({"id": _summary_id(F.col("depth"), F.col("m")[0]["sequence_number"], F.element_at("m", -1)["sequence_number"]), "token_count": estimate_tokens("content"), "created_at": F.array_max(F.transform("m", lambda x: x["created_at"]))})
    return made.withColumnRenamed("level", "compaction_level").select(*SUMMARY, *_sources("m"))


def _sources(column: str) -> list[Column]:
    tokens = F.aggregate(F.transform(column, lambda x: x["token_count"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return [F.transform(column, lambda x: x["id"]).alias("parts"), tokens.alias("source_tokens")]


def _message_links(made: DataFrame) -> DataFrame:
    return made.select(F.col("id").alias("summary_id"), F.posexplode("parts").alias("pos", "message_id")).select("summary_id", "message_id", "pos")


def _edges(made: DataFrame) -> DataFrame:
    return made.select(F.explode("parts").alias("child_id"), F.col("id").alias("parent_id"))


def leaf_summaries(tables: dict[str, DataFrame], config: EngineConfig, summarizer: Summarizer = first_words, levels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New depth-0 summaries and their message links, for conversations that are due."""
    made = _leaves(tables, config, summarizer, levels if levels is not None else state(tables, config))
    return made.select(SUMMARY), _message_links(made)


def _parents(tables: dict[str, DataFrame], depth: int, levels: DataFrame, config: EngineConfig, summarizer: Summarizer) -> DataFrame:
    """One parent, with ``parts``, for all uncondensed summaries of a depth, where there are enough."""
    open_ = dag.uncondensed(tables["summaries"], tables["summary_parents"], depth)
    parts = F.array_sort(F.collect_list(F.struct("created_at", "id", "content", "token_count")))
    grouped = open_.groupBy("conversation_id").agg(parts.alias("s")).filter(F.size("s") >= config.min_condense).join(levels.select("conversation_id", "level"), "conversation_id")
    level = F.when(F.col("level") == "aggressive", "aggressive").otherwise(level_for_depth(depth + 1, config))
    made = _written(grouped.withColumns({"depth": F.lit(depth + 1), "level": level, "texts": F.transform("s", lambda x: x["content"])}), summarizer)
    made = made.withColumns({"id": _summary_id(F.col("depth"), F.col("s")[0]["id"], F.element_at("s", -1)["id"]), "token_count": estimate_tokens("content"), "created_at": F.element_at("s", -1)["created_at"] + F.expr("interval 1 second")})
    return made.withColumnRenamed("level", "compaction_level").select(*SUMMARY, *_sources("s"))


def condense(tables: dict[str, DataFrame], depth: int, levels: DataFrame, config: EngineConfig, summarizer: Summarizer = first_words) -> tuple[DataFrame, DataFrame]:
    """One parent for all uncondensed summaries of a depth, where there are enough; and the edges."""
    made = _parents(tables, depth, levels, config, summarizer)
    return made.select(SUMMARY), _edges(made)


def truncated_leaves(summaries: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """Uncondensed leaves (``id, conversation_id``) that go, the oldest first, until the rest is within the budget."""
    w = W.partitionBy("conversation_id").orderBy("created_at", "id")
    rows = dag.leaves(summaries, edges).withColumns({"_total": F.sum("token_count").over(W.partitionBy("conversation_id")), "_before": F.coalesce(F.sum("token_count").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    return rows.filter(F.col("_total") - F.col("_before") > budget).select("id", "conversation_id")


def truncate(tables: dict[str, DataFrame], budget: int, only: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables without the truncated leaves; their messages are open again."""
    summaries = tables["summaries"] if only is None else tables["summaries"].join(only, "conversation_id", "left_semi")
    gone = truncated_leaves(summaries, tables["summary_parents"], budget).select("id")
    return tables | {
        "summaries": tables["summaries"].join(gone, "id", "left_anti"),
        "summary_messages": tables["summary_messages"].join(gone.withColumnRenamed("id", "summary_id"), "summary_id", "left_anti"),
    }


def compact(tables: dict[str, DataFrame], config: EngineConfig, summarizer: Summarizer = first_words) -> dict[str, DataFrame]:
    """One compaction of all conversations.

    Conversations at the deterministic level are truncated first; levels are
    derived again before leaves are made, for each depth of condensation, and
    before the last truncation. A depth without enough summaries is passed
    over, deeper ones still condense. Only what is new is checkpointed.
    """
    return run(tables, config, summarizer)[0]


def run(tables: dict[str, DataFrame], config: EngineConfig, summarizer: Summarizer = first_words) -> tuple[dict[str, DataFrame], DataFrame]:
    """``compact``, and its result: ``conversation_id, n_created, depth, tokens_processed``."""
    tables = tables | {"summaries": tables["summaries"].select(SUMMARY)}

    def truncated(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        hard = state(now, config).filter("level = 'deterministic'").select("conversation_id")
        if hard.isEmpty():
            return now
        out = truncate(now, config.condensed_summary_budget, checkpointed(hard))
        return out | {k: checkpointed(out[k]) for k in ("summaries", "summary_messages")}

    tables = truncated(tables)
    made = checkpointed(_leaves(tables, config, summarizer, state(tables, config)))
    new = made.select("conversation_id", "source_tokens")
    tables = tables | {"summaries": tables["summaries"].unionByName(made.select(SUMMARY)), "summary_messages": tables["summary_messages"].unionByName(_message_links(made))}
    deepest, depth = tables["summaries"].agg(F.max("depth")).first()[0], 0
    while deepest is not None and depth <= min(deepest, config.max_summary_depth - 1):
        made = checkpointed(_parents(tables, depth, state(tables, config), config, summarizer))
        depth += 1
        if made.isEmpty():
            continue
        deepest, new = max(deepest, depth), new.unionByName(made.select("conversation_id", "source_tokens"))
        tables = tables | {"summaries": tables["summaries"].unionByName(made.select(SUMMARY)), "summary_parents": tables["summary_parents"].unionByName(_edges(made))}
    tables = truncated(tables)
    result = tables["messages"].select("conversation_id").distinct()
    for part in (
        new.groupBy("conversation_id").agg(F.count("*").alias("n_created"), F.sum("source_tokens").alias("tokens_processed")),
        dag.roots(tables["summaries"], tables["summary_parents"]).groupBy("conversation_id").agg(F.max("depth").alias("depth")),
    ):
        result = result.join(part, "conversation_id", "left")
    return tables, result.na.fill(0)
