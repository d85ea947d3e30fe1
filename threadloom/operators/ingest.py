"""Ingest: idempotent, gap-free sequence numbers; parts; reset and marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import ROLES, estimate_tokens, host_part_text, join_parts, parse_parts, trimmed


def ensure_conversations(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """New conversation rows (id = session id) of ``wanted`` (conversation_id, created_at) that do not exist yet."""
    new = wanted.groupBy(F.col("conversation_id").alias("id")).agg(F.min("created_at").alias("created_at")).filter("id is not null")
    return new.join(existing.select("id"), "id", "left_anti").select("id", F.col("id").alias("session_id"), "created_at")


def persist_messages(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` (id, conversation_id, role, content, arrival, created_at) that are new, with their sequence numbers.

    The first arrival of an id wins, over all conversations. Rows with a null
    or an unknown role are ignored and take no number. Numbers go on from the
    largest of the conversation, in the order of arrival. The stored content is
    the joined parts, and its tokens are counted.
    """
    valid = batch.filter(F.col("role").isin(*ROLES) & F.col("id").isNotNull() & F.col("conversation_id").isNotNull() & F.col("content").isNotNull())
    first = valid.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("arrival", "conversation_id"))).filter("_k = 1")
    new = first.join(existing.select("id"), "id", "left_anti")
    base = existing.groupBy("conversation_id").agg(F.max("sequence_number").alias("_base"))
    nth = F.row_number().over(W.partitionBy("conversation_id").orderBy("arrival", "id"))
    numbered = new.join(base, "conversation_id", "left").withColumn("sequence_number", (F.coalesce("_base", F.lit(0)) + nth).cast("int"))
    text = join_parts(parse_parts("content"))
    return numbered.withColumn("_text", text).select("id", "conversation_id", "role", F.col("_text").alias("content"), estimate_tokens("_text").alias("token_count"), "sequence_number", "created_at")


def message_parts(batch: DataFrame) -> DataFrame:
    """``message_id, sequence_number`` (from 1), ``part_type, content`` of structured messages (id, content)."""
    return batch.select("id", F.posexplode(parse_parts("content")).alias("at", "p")).select(F.col("id").alias("message_id"), (F.col("at") + 1).cast("int").alias("sequence_number"), F.col("p.type").alias("part_type"), F.col("p.content").alias("content"))


def host_messages(batch: DataFrame) -> DataFrame:
    """``id, content`` of host messages whose ``parts`` are JSON texts: texts that are not blank, parted by blank lines."""
    texts = F.filter(F.transform("parts", lambda p: host_part_text(p)), lambda t: F.length(trimmed(t)) > 0)
    return batch.select("id", trimmed(F.array_join(texts, "\n\n")).alias("content"))


def model_ids(batch: DataFrame) -> DataFrame:
    """``conversation_id, provider_id, model_id`` of host messages (conversation_id, arrival, info as JSON): those of the first message.

    A user's message holds them under ``model``; a conversation without any has the engine's own name.
    """
    at = lambda path: F.get_json_object("info", path)
    own = {c: F.when(at("$.role") == "assistant", at(f"$.{key}")).otherwise(at(f"$.model.{key}")) for c, key in (("provider_id", "providerID"), ("model_id", "modelID"))}
    first = batch.select("conversation_id", "arrival", *[v.alias(c) for c, v in own.items()]).groupBy("conversation_id").agg(F.min_by(F.struct(*own), "arrival").alias("m"))
    return first.select("conversation_id", *[F.coalesce(f"m.{c}", F.lit("threadloom")).alias(c) for c in own])


def lookup(messages: DataFrame, conversation: str, ids: list[str]) -> DataFrame:
    """Messages of one conversation by id; the condition reaches the scan."""
    return messages.filter((F.col("conversation_id") == conversation) & F.col("id").isin(ids))


def new_session(conversations: DataFrame, conversation: str, at: Column | None = None) -> DataFrame:
    """The row of a session that begins anew; none if it exists."""
    wanted = conversations.sparkSession.range(1).select(F.lit(conversation).alias("conversation_id"), (at if at is not None else F.current_timestamp()).alias("created_at"))
    return ensure_conversations(conversations, wanted)


def mark_summarized(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with ``new`` ones (summary_id, message_id, pos) added; those that exist stay as they are."""
    return links.unionByName(new.dropDuplicates(["summary_id", "message_id"]).join(links.select("summary_id", "message_id"), ["summary_id", "message_id"], "left_anti"))


def page(messages: DataFrame, conversation: Column | str, after: int = 0, limit: int | None = None) -> DataFrame:
    """Messages of one conversation after a sequence number, in order."""
    out = messages.filter((F.col("conversation_id") == conversation) & (F.col("sequence_number") > after)).orderBy("sequence_number")
    return out.limit(limit) if limit is not None else out


def pages(messages: DataFrame, after: int, limit: int) -> DataFrame:
    """The same page of every conversation."""
    rows = messages.filter(F.col("sequence_number") > after)
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("conversation_id").orderBy("sequence_number", "id"))).filter(F.col("_k") <= limit).drop("_k")


def unsummarized(messages: DataFrame, links: DataFrame) -> DataFrame:
    return messages.join(links.select(F.col("message_id").alias("id")), "id", "left_anti")


def reset(tables: dict[str, DataFrame], conversations: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the content of ``conversations`` (conversation_id), and the counts of what went, one row each.

    Conversation rows stay.
    """
    gone = conversations.select("conversation_id").distinct()
    out = dict(tables)
    counts = gone
    for name, label in (("messages", "n_messages"), ("summaries", "n_summaries"), ("large_files", "n_files")):
        if name in tables:
            n = tables[name].join(gone, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.count("*").alias(label))
            counts = counts.join(n, "conversation_id", "left")
            out[name] = tables[name].join(gone, "conversation_id", "left_anti")
    summaries, msgs = (tables[t].join(gone, "conversation_id", "left_semi").select("id") for t in ("summaries", "messages"))
    if "message_parts" in tables:
        out["message_parts"] = tables["message_parts"].join(msgs.withColumnRenamed("id", "message_id"), "message_id", "left_anti")
    links = tables["summary_messages"].join(summaries.withColumnRenamed("id", "summary_id"), "summary_id", "left_anti")
    out["summary_messages"] = links.join(msgs.withColumnRenamed("id", "message_id"), "message_id", "left_anti")
    edges = tables["summary_parents"].join(summaries.withColumnRenamed("id", "child_id"), "child_id", "left_anti")
    out["summary_parents"] = edges.join(summaries.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti")
    return out, counts.na.fill(0)
