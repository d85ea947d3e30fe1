"""Summary DAG: roots, leaves, trees, coverage, cycles. Edges point from child to parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.checkpoint import checkpointed


def roots(summaries: DataFrame, edges: DataFrame) -> DataFrame:
    """Summaries of any depth without a parent."""
    return summaries.join(edges.select(F.col("child_id").alias("id")), "id", "left_anti")


def leaves(summaries: DataFrame, edges: DataFrame) -> DataFrame:
    """Summaries of depth 0 that no other one condenses."""
    return roots(summaries.filter("depth = 0"), edges)


def uncondensed(summaries: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    return roots(summaries.filter(F.col("depth") == depth), edges)


def isolated(summaries: DataFrame, edges: DataFrame) -> DataFrame:
    """Summaries that are neither child nor parent."""
    return roots(summaries, edges).join(edges.select(F.col("parent_id").alias("id")), "id", "left_anti")


def children(summaries: DataFrame, edges: DataFrame) -> DataFrame:
    """Each summary with a parent, and ``parent_id``."""
    return summaries.join(edges.withColumnRenamed("child_id", "id"), "id")


def with_lists(summaries: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Summaries with ``parent_ids`` and ``message_ids`` (in link order)."""
    parents = edges.groupBy(F.col("child_id").alias("id")).agg(F.array_sort(F.collect_list("parent_id")).alias("parent_ids"))
    ids = links.groupBy(F.col("summary_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message_id"))), lambda x: x["message_id"]).alias("message_ids"))
    empty = F.array().cast("array<string>")
    return summaries.join(parents, "id", "left").join(ids, "id", "left").withColumns({c: F.coalesce(c, empty) for c in ("parent_ids", "message_ids")})


def descendants(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``root_id, id, lvl, path``: each start (column ``id``) and all below it, once for each way down.

    Levels are joined one after the other until none is left, however deep; each
    is checkpointed, so it is made once. A node on its own path is not followed,
    so cycles end.
    """
    level = starts.select(F.col("id").alias("root_id"), "id", F.lit(0).alias("lvl"), F.array("id").alias("path"))
    out, down, k = level, edges.select(F.col("parent_id").alias("id"), "child_id"), 0
    while True:
        k += 1
        level = checkpointed(level.join(down, "id").filter(~F.array_contains("path", F.col("child_id"))).select("root_id", F.col("child_id").alias("id"), F.lit(k).alias("lvl"), F.array_append("path", F.col("child_id")).alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def tree(summaries: DataFrame, edges: DataFrame) -> DataFrame:
    """The forest below all roots, in pre-order by ``path``."""
    return descendants(roots(summaries, edges).select("id"), edges)


def coverage(summaries: DataFrame, edges: DataFrame, links: DataFrame, messages: DataFrame) -> DataFrame:
    """``id, first_seq, last_seq, n_messages`` that a summary covers with all below it.

    Each summary's own range and count go to those above it, once for each of
    them, however many ways lead up; messages do not travel. A walk takes a
    summary to each ancestor once, so it ends on cycles.
    """
    own = links.join(messages.select(F.col("id").alias("message_id"), "sequence_number"), "message_id").groupBy(F.col("summary_id").alias("id")).agg(F.min("sequence_number").alias("lo"), F.max("sequence_number").alias("hi"), F.count("*").alias("n"))
    up = edges.select(F.col("child_id").alias("at"), "parent_id").distinct()
    level = own.select("id", F.col("id").alias("at"))
    seen = level
    while True:
        higher = level.join(up, "at").select("id", F.col("parent_id").alias("at")).distinct()
        level = checkpointed(higher.join(seen, ["id", "at"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    ranges = seen.join(own, "id").groupBy(F.col("at").alias("id")).agg(F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"), F.sum("n").alias("n_messages"))
    return summaries.select("id").join(ranges, "id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges that remain after nodes without children, then those without parents, are taken off again and again.

    Empty just if there is no cycle; what is left are the cycles and what lies
    between two of them.
    """
    left = edges.select("child_id", "parent_id").distinct()
    for near, far in (("child_id", "parent_id"), ("parent_id", "child_id")):
        n = left.count()
        while n:
            left = checkpointed(left.join(left.select(F.col(far).alias(near)).distinct(), near, "left_semi").select("child_id", "parent_id"))
            m = left.count()
            if m == n:
                break
            n = m
    return left
