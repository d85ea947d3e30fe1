"""Session statistics and the state report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.operators import context, dag, files, ingest

BY = "conversation_id"


def info(tables: dict[str, DataFrame]) -> DataFrame:
    """``conversation_id, n_messages, tokens, last_activity, n_summaries, max_depth``."""
    m = tables["messages"].groupBy(BY).agg(F.count("*").alias("n_messages"), F.sum("token_count").alias("tokens"), F.max("created_at").alias("last_activity"), F.max("sequence_number").alias("last_seq"))
    s = tables["summaries"].groupBy(BY).agg(F.count("*").alias("n_summaries"), F.max("depth").alias("max_depth"))
    return m.join(s, BY, "left").na.fill(0)


def depth_histogram(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["summaries"].groupBy(BY, "depth").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def active_and_condensed(tables: dict[str, DataFrame]) -> DataFrame:
    """Messages that no summary covers, and those that one does."""
    covered = tables["summary_messages"].select(F.col("message_id").alias("id"), F.lit(True).alias("_c")).distinct()
    rows = tables["messages"].join(covered, "id", "left")
    return rows.groupBy(BY).agg(F.count_if(F.col("_c").isNull()).alias("active"), F.count_if(F.col("_c").isNotNull()).alias("condensed"))


def describe(tables: dict[str, DataFrame], config: EngineConfig, query: str | None = None) -> DataFrame:
    """One row a conversation with all that the state report shows."""
    soft, hard = config.thresholds()
    extra = tables["summaries"].groupBy(BY).agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("summary_tokens"), F.max("created_at").alias("last_compaction"))
    tops = dag.roots(tables["summaries"], tables["summary_parents"]).groupBy(BY).agg(F.count("*").alias("n_roots"))
    used = context.token_totals(context.assemble(tables, config, query)).withColumnRenamed("tokens", "context_tokens")
    out = info(tables).join(active_and_condensed(tables), BY).join(extra, BY, "left").join(tops, BY, "left").join(used, BY, "left")
    if "large_files" in tables:
        stats = files.statistics(tables["large_files"]).withColumnRenamed("tokens", "file_tokens")
        out = out.join(stats, BY, "left")
    return out.na.fill(0).withColumns({"soft_threshold": F.lit(soft), "hard_threshold": F.lit(hard)})


def report(described: DataFrame) -> DataFrame:
    """The state report as text."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("never")), F.lit("\n"))
    parts = [("Conversation", BY), ("Messages", "n_messages"), ("Active", "active"), ("Condensed", "condensed"), ("Tokens", "tokens"), ("Summaries", "n_summaries"), ("Depth", "max_depth"), ("Last compaction", "last_compaction"), ("Context tokens", "context_tokens")]
    return described.select(BY, F.concat(*[line(a, b) for a, b in parts]).alias("text"))


def open_messages(tables: dict[str, DataFrame]) -> DataFrame:
    return ingest.unsummarized(tables["messages"], tables["summary_messages"])
