"""Integrity checks, one row a conversation and check, and repair."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.operators import context, dag
from threadloom.sources.checkpoint import checkpointed

BY = "conversation_id"
SHOWN = 5


def _shown(ids: Column) -> Column:
    """The first few ids and how many more there are."""
    n = F.size(ids)
    return F.concat(F.array_join(F.slice(ids, 1, SHOWN), ", "), F.when(n > SHOWN, F.concat(F.lit(" (+"), (n - SHOWN).cast("string"), F.lit(" more)"))).otherwise(""))


def _check(name: str, conversations: DataFrame, check: Callable[[], DataFrame]) -> DataFrame:
    """``check`` gives conversation_id, item; a conversation without items passes. A check that raises is a warning."""
    try:
        bad = check()
    except Exception as error:  # noqa: BLE001
        return conversations.select(BY, F.lit(name).alias("name"), F.lit("warn").alias("status"), F.lit(0).alias("n_bad"), F.lit(f"check failed: {str(error).splitlines()[0] if str(error) else type(error).__name__}").alias("details"))
    listed = bad.groupBy(BY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = conversations.join(listed, BY, "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    return rows.select(BY, F.lit(name).alias("name"), F.when(n > 0, "fail").otherwise("pass").alias("status"), n.cast("int").alias("n_bad"), F.when(n > 0, _shown(F.col("items"))).otherwise("").alias("details"))


def orphan_links(tables: dict[str, DataFrame]) -> DataFrame:
    """Links to a missing or foreign message, or from a missing summary; with the conversation they belong to."""
    m = tables["messages"].select(F.col("id").alias("message_id"), F.col(BY).alias("m_conv"))
    s = tables["summaries"].select(F.col("id").alias("summary_id"), F.col(BY).alias("s_conv"))
    rows = tables["summary_messages"].select("summary_id", "message_id").distinct().join(m, "message_id", "left").join(s, "summary_id", "left")
    return rows.filter("m_conv is null or s_conv is null or m_conv <> s_conv").select("summary_id", "message_id", F.coalesce("s_conv", "m_conv").alias(BY))


def ordering(tables: dict[str, DataFrame]) -> DataFrame:
    w = W.partitionBy(BY).orderBy("sequence_number", "id")
    rows = tables["messages"].withColumn("_k", F.row_number().over(w)).filter("_k <> sequence_number")
    return rows.select(BY, F.col("id").alias("item"))


def depth_mismatches(tables: dict[str, DataFrame]) -> DataFrame:
    s = tables["summaries"]
    child, parent = s.select(F.col("id").alias("child_id"), F.col("depth").alias("cd"), BY), s.select(F.col("id").alias("parent_id"), F.col("depth").alias("pd"))
    rows = tables["summary_parents"].join(child, "child_id").join(parent, "parent_id").filter("pd <> cd + 1")
    return rows.select(BY, F.concat_ws(">", "child_id", "parent_id").alias("item"))


def cycles(tables: dict[str, DataFrame]) -> DataFrame:
    """Children on cycles. Every cycle has an edge whose parent is not deeper than its child, so without one nothing is walked."""
    depths = tables["summaries"].select("id", "depth")
    edges = tables["summary_parents"]
    both = edges.join(depths.toDF("child_id", "cd"), "child_id", "left").join(depths.toDF("parent_id", "pd"), "parent_id", "left")
    if both.filter("cd is null or pd is null or pd <= cd").isEmpty():
        return tables["summaries"].limit(0).select(BY, F.col("id").alias("item"))
    return dag.on_cycles(edges).join(tables["summaries"].select(F.col("id").alias("child_id"), BY), "child_id").select(BY, F.col("child_id").alias("item"))


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Isolated summaries of conversations with several, and edges to missing summaries."""
    several = tables["summaries"].groupBy(BY).agg(F.count("*").alias("n")).filter("n > 1").select(BY)
    alone = dag.isolated(tables["summaries"], tables["summary_parents"]).join(several, BY, "left_semi").select(BY, F.col("id").alias("item"))
    known = tables["summaries"].select("id", BY)
    e = tables["summary_parents"]
    child = e.join(known.withColumnRenamed("id", "child_id").withColumnRenamed(BY, "c"), "child_id", "left").join(known.withColumnRenamed("id", "parent_id").withColumnRenamed(BY, "p"), "parent_id", "left")
    broken = child.filter("c is null or p is null").select(F.coalesce("c", "p").alias(BY), F.concat_ws(">", "child_id", "parent_id").alias("item"))
    return alone.unionByName(broken)


def over_budget(tables: dict[str, DataFrame], config: EngineConfig, budget: int | None = None) -> DataFrame:
    """Conversations whose assembled context has more tokens than ``budget`` (the configuration's, if none is given)."""
    totals = context.token_totals(context.assemble(tables, config))
    return totals.filter(F.col("tokens") > (config.max_context_tokens if budget is None else budget)).select(BY, F.col("tokens").cast("string").alias("item"))


def index_mismatches(tables: dict[str, DataFrame], indexed: DataFrame) -> DataFrame:
    """Messages and summaries that an index (``id``) lacks, or that it has and the tables lack."""
    docs = tables["messages"].select("id", BY).unionByName(tables["summaries"].select("id", BY))
    both = docs.join(indexed.select("id", F.col(BY).alias("i_conv"), F.lit(True).alias("_i")), "id", "full")
    return both.filter(F.col("_i").isNull() | F.col(BY).isNull()).select(F.coalesce(BY, "i_conv").alias(BY), F.col("id").alias("item"))


def file_mismatches(tables: dict[str, DataFrame]) -> DataFrame:
    f = tables["large_files"].filter("message_id is not null")
    m = tables["messages"].select(F.col("id").alias("message_id"), F.col(BY).alias("m_conv"))
    return f.join(m, "message_id", "left").filter(f"m_conv is null or m_conv <> {BY}").select(BY, F.col("id").alias("item"))


def run_checks(tables: dict[str, DataFrame], config: EngineConfig, indexed: DataFrame | None = None) -> DataFrame:
    """``conversation_id, name, status, n_bad, details`` of all checks."""
    conversations = tables["messages"].select(BY).unionByName(tables["summaries"].select(BY)).distinct()
    links = lambda t: orphan_links(t).select(BY, F.concat_ws(">", "summary_id", "message_id").alias("item"))
    found = [("message-ordering", ordering), ("summary-coverage", links), ("dag-acyclicity", cycles), ("depth-consistency", depth_mismatches), ("orphan-detection", orphans), ("token-budget", lambda t: over_budget(t, config))]
    if indexed is not None:
        found.append(("fts-sync", lambda t: index_mismatches(t, indexed)))
    if "large_files" in tables:
        found.append(("large-file-consistency", file_mismatches))
    out = None
    for name, check in found:
        rows = _check(name, conversations, partial(check, tables))
        out = rows if out is None else out.unionByName(rows)
    return out


def summary_of(report: DataFrame) -> DataFrame:
    return report.groupBy(BY).agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("warn", "warned"))])


def repair(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without orphan links, and the actions taken: ``conversation_id, action, summary_id, message_id``.

    Without orphan links the tables are those given.
    """
    gone = checkpointed(orphan_links(tables))
    actions = gone.select(BY, F.lit("removed link").alias("action"), "summary_id", "message_id")
    if gone.isEmpty():
        return tables, actions
    links = tables["summary_messages"].join(gone.select("summary_id", "message_id"), ["summary_id", "message_id"], "left_anti")
    return tables | {"summary_messages": links}, actions
