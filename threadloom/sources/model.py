"""The tables of the engine: schemas, a Parquet store, and views derived from chat logs."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.errors import EngineError
from threadloom.functions.text import estimate_tokens

#: The tables and their columns.
SCHEMAS = {
    "conversations": "id string, session_id string, created_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, token_count int, sequence_number int, created_at timestamp",
    "message_parts": "message_id string, sequence_number int, part_type string, content string",
    "summaries": "id string, conversation_id string, depth int, content string, token_count int, created_at timestamp, compaction_level string",
    "summary_parents": "child_id string, parent_id string",
    "summary_messages": "summary_id string, message_id string, pos int",
    "postings": "term string, kind string, id string, conversation_id string, length int, positions array<int>",
    "text_lengths": "kind string, id string, conversation_id string, length int",
    "large_files": "id string, conversation_id string, message_id string, placeholder string, original_path string, token_count int, content string, created_at timestamp",
}


#: Version of the schemas above, and what takes a store from a version to the next.
SCHEMA_VERSION = 1
MIGRATIONS: dict[int, Callable[["Store"], dict[str, DataFrame]]] = {}


class Store:
    """Tables as lists of immutable Parquet folders, named by numbered commit files under one folder.

    A commit writes its rows first and then its file, by a rename that fails if
    the number is taken, so several tables change at once or not at all, and of
    two writers one gets an error. A store that is opened again reads the last
    commit; a commit file that cannot be read is put aside (``.corrupt``) and
    the one before it counts. Older schema versions are migrated on opening.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = self._jvm.Path(f"{self.folder}/_commits")
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)
        self.recovered: list[str] = []
        self.open = True
        self.number, state = self._last()
        self.parts: dict[str, list[str]] = state["tables"]
        version = state["schema"]
        if version > SCHEMA_VERSION:
            raise EngineError(f"schema {version} is newer than {SCHEMA_VERSION}", "DB_SCHEMA")
        while version < SCHEMA_VERSION:
            self.commit(MIGRATIONS[version](self), schema=version + 1)
            version += 1

    def _last(self) -> tuple[int, dict]:
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._at)), reverse=True)
        for name in names:
            if not re.fullmatch(r"\d+\.json", name):
                continue
            try:
                state = json.loads(self._text(name))
                if not isinstance(state["schema"], int) or not all(isinstance(v, list) for v in state["tables"].values()):
                    raise ValueError(name)
                return int(name.split(".")[0]), state
            except (ValueError, KeyError, TypeError, AttributeError):
                self._fs.rename(self._jvm.Path(self._at, name), self._jvm.Path(self._at, f"{name}.corrupt"))
                self.recovered.append(name)
        return 0, {"schema": SCHEMA_VERSION, "tables": {}}

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._jvm.Path(self._at, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _needs_open(self) -> None:
        if not self.open:
            raise EngineError("the store is closed", "DB_CLOSED")

    def read(self, name: str) -> DataFrame:
        self._needs_open()
        if not self.parts.get(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/{p}" for p in self.parts[name]])

    def commit(self, whole: dict[str, DataFrame] | None = None, more: dict[str, DataFrame] | None = None, schema: int = SCHEMA_VERSION) -> int:
        """Replace tables by ``whole`` and append ``more``, all at once; the number of the commit."""
        self._needs_open()
        parts = dict(self.parts)
        for kind, tables_ in (("whole", whole or {}), ("more", more or {})):
            for name, df in tables_.items():
                path = f"{name}/{uuid.uuid4().hex}"
                df.select(*[f.split()[0] for f in SCHEMAS[name].split(", ")]).write.parquet(f"{self.folder}/{path}")
                parts[name] = [path] if kind == "whole" else [*parts.get(name, []), path]
        draft, final = self._jvm.Path(self._at, f"draft-{uuid.uuid4().hex}"), self._jvm.Path(self._at, f"{self.number + 1:012d}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps({"schema": schema, "tables": parts}).encode()))
        stream.close()
        sc = self.spark.sparkContext
        files = self._jvm.FileContext.getFileContext(self._at.toUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(files.makeQualified(draft), files.makeQualified(final), sc._gateway.new_array(getattr(self._jvm, "Options$Rename"), 0))
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            raise EngineError("another writer was first", "STORE_CONFLICT", recoverable=True) from error
        self.number, self.parts = self.number + 1, parts
        return self.number

    def write(self, name: str, df: DataFrame) -> None:
        self.commit({name: df})

    def append(self, name: str, df: DataFrame) -> None:
        self.commit(more={name: df})

    def rewrite(self, name: str) -> None:
        """A table of many small folders as one."""
        self.commit({name: self.read(name)})

    def refresh(self) -> None:
        """Go on from the last commit of any writer."""
        self.number, state = self._last()
        self.parts = state["tables"]

    def close(self) -> None:
        self.open = False

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in SCHEMAS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat logs as messages: turn t of conversation c is message c<c>-m<t+1>."""
    c = table(spark, sf_dir, "conversations")
    minutes = (F.col("conv_id") * 100 + F.col("turn")).cast("int")
    return c.select(
        F.concat(F.lit("c"), "conv_id", F.lit("-m"), F.col("turn") + 1).alias("id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        "role",
        F.col("text").alias("content"),
        estimate_tokens("text").alias("token_count"),
        (F.col("turn") + 1).cast("int").alias("sequence_number"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=minutes)).alias("created_at"),
    )


def _digest(n, what: str, text) -> F.Column:
    return F.concat(F.lit("Summary of "), n.cast("string"), F.lit(f" {what} about "), F.array_join(F.slice(F.split(text, " "), 1, 3), " "))


def _summary(df: DataFrame, depth: int) -> DataFrame:
    return df.withColumns({"depth": F.lit(depth), "token_count": estimate_tokens("content"), "compaction_level": F.lit("normal"), "id": F.concat(F.lit("c"), "conversation_id", F.lit(f"-d{depth}-"), F.col("no").cast("string"))})


def dag(msgs: DataFrame) -> dict[str, DataFrame]:
    """A summary DAG over messages: pairs of messages, pairs of those for even conversations, and of those for every fourth."""
    order = F.struct("sequence_number", "content")
    pairs = msgs.withColumn("no", F.floor((F.col("sequence_number") - 1) / 2).cast("int"))
    first = F.min(order)["content"]
    leaves = _summary(pairs.groupBy("conversation_id", "no").agg(_digest(F.count("*"), "messages", first).alias("content"), F.max("created_at").alias("created_at")), 0)
    links = pairs.select(F.concat(F.lit("c"), "conversation_id", F.lit("-d0-"), F.col("no").cast("string")).alias("summary_id"), F.col("id").alias("message_id"), ((F.col("sequence_number") - 1) % 2).cast("int").alias("pos"))
    levels, edges, below = [leaves], [], leaves
    for depth, step in ((1, 2), (2, 4)):
        part = below.filter(F.col("conversation_id").cast("bigint") % step == 0).withColumn("up", F.floor(F.col("no") / 2).cast("int"))
        made = part.groupBy("conversation_id", F.col("up").alias("no")).agg(_digest(F.count("*"), "summaries", F.min(F.struct("no", "content"))["content"]).alias("content"), (F.max("created_at") + F.expr("interval 1 minute")).alias("created_at"))
        edges.append(part.select(F.col("id").alias("child_id"), F.concat(F.lit("c"), "conversation_id", F.lit(f"-d{depth}-"), F.col("up").cast("string")).alias("parent_id")))
        below = _summary(made, depth)
        levels.append(below)
    cols = ["id", "conversation_id", "depth", "content", "token_count", "created_at", "compaction_level"]
    summaries = levels[0].select(cols)
    for level in levels[1:]:
        summaries = summaries.unionByName(level.select(cols))
    return {"messages": msgs, "summaries": summaries, "summary_messages": links, "summary_parents": edges[0].unionByName(edges[1])}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return dag(messages(spark, sf_dir))


#: The same views for DuckDB, as the start of a WITH clause.
SQL = """
messages AS (
  SELECT 'c' || conv_id || '-m' || (turn + 1) AS id, CAST(conv_id AS VARCHAR) AS conversation_id, role, text AS content,
         CAST(ceil(length(text) / 3.5) AS INT) AS token_count, CAST(turn + 1 AS INT) AS sequence_number,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 100 + turn AS INT)) AS created_at
  FROM conversations
), paired AS (
  SELECT *, CAST((sequence_number - 1) // 2 AS INT) AS no FROM messages
), d0 AS (
  SELECT conversation_id, no, 'Summary of ' || count(*) || ' messages about ' || array_to_string(string_split(arg_min(content, sequence_number), ' ')[1:3], ' ') AS content, max(created_at) AS created_at
  FROM paired GROUP BY ALL
), d1 AS (
  SELECT conversation_id, CAST(no // 2 AS INT) AS no, 'Summary of ' || count(*) || ' summaries about ' || array_to_string(string_split(arg_min(content, no), ' ')[1:3], ' ') AS content, max(created_at) + INTERVAL 1 MINUTE AS created_at
  FROM d0 WHERE CAST(conversation_id AS BIGINT) % 2 = 0 GROUP BY conversation_id, no // 2
), d2 AS (
  SELECT conversation_id, CAST(no // 2 AS INT) AS no, 'Summary of ' || count(*) || ' summaries about ' || array_to_string(string_split(arg_min(content, no), ' ')[1:3], ' ') AS content, max(created_at) + INTERVAL 1 MINUTE AS created_at
  FROM d1 WHERE CAST(conversation_id AS BIGINT) % 4 = 0 GROUP BY conversation_id, no // 2
), summaries AS (
  SELECT 'c' || conversation_id || '-d' || depth || '-' || no AS id, conversation_id, CAST(depth AS INT) AS depth, content, CAST(ceil(length(content) / 3.5) AS INT) AS token_count, created_at, 'normal' AS compaction_level
  FROM (SELECT 0 AS depth, * FROM d0 UNION ALL SELECT 1, * FROM d1 UNION ALL SELECT 2, * FROM d2)
), summary_messages AS (
  SELECT 'c' || conversation_id || '-d0-' || no AS summary_id, id AS message_id, CAST((sequence_number - 1) % 2 AS INT) AS pos FROM paired
), summary_parents AS (
  SELECT 'c' || conversation_id || '-d0-' || no AS child_id, 'c' || conversation_id || '-d1-' || (no // 2) AS parent_id FROM d0 WHERE CAST(conversation_id AS BIGINT) % 2 = 0
  UNION ALL
  SELECT 'c' || conversation_id || '-d1-' || no, 'c' || conversation_id || '-d2-' || (no // 2) FROM d1 WHERE CAST(conversation_id AS BIGINT) % 4 = 0
)
"""
