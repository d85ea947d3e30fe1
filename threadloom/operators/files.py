"""Oversize texts: detection, offload to a file table, lookup, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import detect_path, estimate_tokens


def file_id(conversation: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws("|", conversation, message), 256)


def offload(messages: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Messages with oversize texts (tokens above the threshold) replaced by a reference, and the rows of the file table."""
    big = F.col("token_count") > threshold
    path = detect_path("content")
    reference = F.concat(F.lit("[Large file: "), F.coalesce(path, F.lit("content")), F.lit(" ("), F.col("token_count").cast("string"), F.lit(" tokens) — use expand to retrieve "), file_id(F.col("conversation_id"), F.col("id")), F.lit("]"))
    short = F.when(big, reference).otherwise(F.col("content"))
    kept = messages.withColumn("_text", short).withColumns({"content": F.col("_text"), "token_count": F.when(big, estimate_tokens("_text")).otherwise(F.col("token_count"))}).drop("_text")
    files = messages.filter(big).select(
        file_id(F.col("conversation_id"), F.col("id")).alias("id"),
        "conversation_id",
        F.col("id").alias("message_id"),
        F.concat(F.lit("[file:"), file_id(F.col("conversation_id"), F.col("id")), F.lit("]")).alias("placeholder"),
        path.alias("original_path"),
        "token_count",
        "content",
        "created_at",
    )
    return kept, files


def latest_by_path(files: DataFrame) -> DataFrame:
    """The newest file of each conversation and path."""
    w = W.partitionBy("conversation_id", "original_path").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return files.filter("original_path is not null").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def statistics(files: DataFrame) -> DataFrame:
    return files.groupBy("conversation_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def reference(files: DataFrame, shown: int = 200) -> Column:
    """A short form of a file: its first characters and the tokens left."""
    left = F.greatest(F.col("token_count") - shown, F.lit(0)).cast("string")
    return F.concat(F.substring("content", 1, shown), F.lit("\n... ("), left, F.lit(" more tokens)"))
