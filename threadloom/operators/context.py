"""Context assembly: fresh tail, packed summaries, relevance, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.functions.text import covered_label, summary_as_message
from threadloom.operators import ingest, search

#: Relevance of items that a query does not find.
UNFOUND = {"summary": 0.25, "message": 0.5}
BY = "conversation_id"


def fresh_tail(open_messages: DataFrame, size: int, budget: int) -> DataFrame:
    """The last ``size`` messages of each conversation less the oldest ones beyond the token budget."""
    w = W.partitionBy(BY).orderBy(F.col("sequence_number").desc())
    rows = open_messages.withColumns({"_k": F.row_number().over(w), "tail_tokens": F.sum("token_count").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return rows.filter((F.col("_k") <= size) & (F.col("tail_tokens") <= budget)).drop("_k")


def pack_summaries(summaries: DataFrame, edges: DataFrame, budget: Column) -> DataFrame:
    """Summaries within a budget (a column): roots above depth 0 first, then leaves, then the rest, up to the first that does not fit."""
    child = edges.select(F.col("child_id").alias("id"), F.lit(True).alias("_child")).distinct()
    rows = summaries.join(child, "id", "left").withColumn("bucket", F.when((F.col("depth") > 0) & F.col("_child").isNull(), 0).when(F.col("depth") == 0, 1).otherwise(2))
    order = [F.col("bucket"), F.when(F.col("bucket") == 0, -F.col("depth")).otherwise(0), F.col("created_at"), F.col("id")]
    w = W.partitionBy(BY).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"packed_tokens": F.sum("token_count").over(w), "_budget": budget}).filter("_budget > 0 and packed_tokens <= _budget").drop("_child", "_budget")


def assemble(tables: dict[str, DataFrame], config: EngineConfig, query: str | None = None) -> DataFrame:
    """``conversation_id, position, type, id, role, depth, content, token_count, created_at, relevance``: packed summaries by time, then the fresh tail."""
    tail = fresh_tail(ingest.unsummarized(tables["messages"], tables["summary_messages"]), config.fresh_tail_size, config.max_context_tokens)
    used = tail.groupBy(BY).agg(F.sum("token_count").alias("used"))
    room = tables["summaries"].join(used, BY, "left").withColumn("room", F.greatest(F.lit(config.max_context_tokens) - F.coalesce("used", F.lit(0)), F.lit(0)))
    packed = pack_summaries(room, tables["summary_parents"], F.col("room"))
    cols = [BY, "type", "id", "role", "depth", "content", "token_count", "created_at"]
    items = packed.withColumns({"type": F.lit("summary"), "role": F.lit("system"), "_seq": F.lit(0)}).select(*cols, "_seq").unionByName(tail.withColumns({"type": F.lit("message"), "depth": F.lit(None).cast("int"), "_seq": F.col("sequence_number")}).select(*cols, "_seq"))
    place = F.row_number().over(W.partitionBy(BY).orderBy(F.col("type").desc(), "_seq", "created_at", "id"))
    items = items.withColumn("position", place.cast("int")).drop("_seq")
    if not query or not query.strip():
        return items.withColumn("relevance", F.lit(1.0))
    found = search.relevance(search.search_all(tables["messages"], tables["summaries"], query, limit=100, per=BY)).select("type", "id", F.col("score").alias("_score"))
    unfound = F.when(F.col("type") == "summary", UNFOUND["summary"]).otherwise(UNFOUND["message"])
    return items.join(found, ["type", "id"], "left").withColumn("relevance", F.coalesce("_score", unfound)).drop("_score")


def preamble(n_summaries: Column, n_messages: Column, tokens: Column, depth: Column) -> Column:
    return F.concat(F.lit("Earlier parts of this conversation are given as summaries. Summaries: "), n_summaries, F.lit("; messages: "), n_messages, F.lit("; tokens: "), tokens, F.lit("; depth: "), depth, F.lit("."))


def render(items: DataFrame, links: DataFrame, messages: DataFrame) -> DataFrame:
    """``conversation_id, position, role, text`` of an assembled context, with a preamble at position 0."""
    numbers = links.join(messages.select(F.col("id").alias("message_id"), "sequence_number"), "message_id").groupBy(F.col("summary_id").alias("id")).agg(F.array_sort(F.collect_list("sequence_number")).alias("_n"))
    covers = covered_label(F.transform(F.coalesce("_n", F.array().cast("array<int>")), lambda x: x.cast("string")))
    rows = items.join(numbers, "id", "left").withColumn("covers", covers)
    text = F.when(F.col("type") == "summary", summary_as_message(F.struct("depth", "token_count", "covers", "created_at", "content"))).otherwise(F.col("content"))
    role = F.when(F.col("type") == "summary", "system").otherwise(F.when(F.col("role") == "user", "user").otherwise("assistant"))
    is_summary = F.col("type") == "summary"
    stats = items.groupBy(BY).agg(F.count_if(is_summary).alias("s"), F.count_if(~is_summary).alias("m"), F.sum("token_count").alias("t"), F.coalesce(F.max("depth"), F.lit(0)).alias("d"))
    head = stats.select(BY, F.lit(0).alias("position"), F.lit("system").alias("role"), preamble(*[F.col(c).cast("string") for c in "smtd"]).alias("text"))
    return head.unionByName(rows.select(BY, "position", role.alias("role"), text.alias("text")))


def transform_messages(rendered: DataFrame) -> DataFrame:
    """Rendered rows as a chain: ``id``, ``parent_id`` (the row before), and only two roles."""
    w = W.partitionBy(BY).orderBy("position")
    rows = rendered.withColumn("id", F.concat_ws("-", F.lit("ctx"), BY, F.col("position").cast("string")))
    return rows.withColumns({"parent_id": F.lag("id").over(w), "role": F.when(F.col("role") == "user", "user").otherwise("assistant")})


def token_totals(items: DataFrame) -> DataFrame:
    return items.groupBy(BY).agg(F.sum("token_count").alias("tokens"))
