"""The engine's registered queries and the SQL that gives the same rows.

The tables are views derived from the driver's tables (``sources.model``);
checks run on views with planted faults, so that they have something to find.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.functions import text as T
from threadloom.operators import compact, context, dag, expand, files, ingest, integrity, search, search_index, session
from threadloom.sources import checkpoint, model

CONFIG = EngineConfig(max_context_tokens=800, fresh_tail_size=4, leaf_summary_budget=300, soft_token_threshold=400, hard_token_threshold=700, summarize_after_messages=4, summarize_after_tokens=500, large_file_threshold=1_000, min_condense=2)
SOFT, HARD = CONFIG.thresholds()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITH = f"WITH {model.SQL.strip()}"
BY = "conversation_id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def on_tables(sql: str | None = None):
    """A query over the derived tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(model.tables(spark, sf_dir))

        run.__name__ = f.__name__
        query(sql)(run)
        return f

    return add


def half_open(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Links of the first three leaves alone, so later messages are unsummarized."""
    return t | {"summary_messages": t["summary_messages"].filter(~F.col("summary_id").rlike("-d0-[1-9]"))}


HALF = ", half_links AS (SELECT * FROM summary_messages WHERE NOT regexp_matches(summary_id, '-d0-[1-9]')), open AS (SELECT * FROM messages WHERE id NOT IN (SELECT message_id FROM half_links))"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


# -- windows and scans ----------------------------------------------------------

FRESH = f"""{WITH}, tail AS (
  SELECT *, row_number() OVER w AS k, sum(token_count) OVER (w ROWS UNBOUNDED PRECEDING) AS tail_tokens FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY sequence_number DESC)
) SELECT id, conversation_id, sequence_number, token_count, CAST(tail_tokens AS BIGINT) AS tail_tokens FROM tail WHERE k <= 4 AND tail_tokens <= 800"""


@on_tables(FRESH)
def fresh_tail(t):
    return context.fresh_tail(t["messages"], 4, 800).select("id", BY, "sequence_number", "token_count", "tail_tokens")


@on_tables(f"{WITH} SELECT id, conversation_id, sequence_number, content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_number) AS k FROM messages WHERE sequence_number > 2) WHERE k <= 3")
def message_page(t):
    return ingest.pages(t["messages"], 2, 3).select("id", BY, "sequence_number", "content")


@on_tables(f"{WITH} SELECT id, conversation_id, role, content, token_count, created_at FROM messages WHERE sequence_number > 0")
def message_scan(t):
    return ingest.page(t["messages"], F.col(BY)).select("id", BY, "role", "content", "token_count", "created_at")


@on_tables(f"{WITH}, s AS (SELECT conversation_id, count(*) AS n_summaries, max(depth) AS max_depth FROM summaries GROUP BY 1) SELECT m.conversation_id, count(*) AS n_messages, CAST(sum(token_count) AS BIGINT) AS tokens, max(created_at) AS last_activity, max(sequence_number) AS last_seq, coalesce(any_value(n_summaries), 0) AS n_summaries, coalesce(any_value(max_depth), 0) AS max_depth FROM messages m LEFT JOIN s USING (conversation_id) GROUP BY 1")
def conversation_stats(t):
    return session.info(t)


@on_tables(f"{WITH} SELECT conversation_id, depth, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM summaries GROUP BY ALL")
def depth_histogram(t):
    return session.depth_histogram(t)


@on_tables(f"{WITH}{HALF} SELECT id, conversation_id, sequence_number FROM open")
def unsummarised(t):
    return session.open_messages(half_open(t)).select("id", BY, "sequence_number")


@on_tables(f"{WITH}{HALF} SELECT conversation_id, count(*) FILTER (WHERE id NOT IN (SELECT message_id FROM half_links)) AS active, count(*) FILTER (WHERE id IN (SELECT message_id FROM half_links)) AS condensed FROM messages GROUP BY 1")
def active_condensed(t):
    return session.active_and_condensed(half_open(t))


# -- ingest ------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored messages (the first two turns) and a batch with repeats, a foreign repeat, bad roles and structured content."""
    m = model.messages(spark, sf_dir)
    stored = m.filter("sequence_number <= 2")
    rows = m.filter("sequence_number >= 2").withColumn("arrival", F.col("sequence_number").cast("bigint") * 1000000 + F.col(BY).cast("bigint"))
    again = rows.withColumns({"arrival": F.col("arrival") + 10**9, "content": F.concat(F.lit("again "), "content")})
    foreign = rows.filter("sequence_number = 3").withColumns({"arrival": F.col("arrival") + 2 * 10**9, BY: F.lit("999999")})
    bad = rows.filter("sequence_number = 3").withColumns({"id": F.concat("id", F.lit("x")), "role": F.lit("robot"), "arrival": F.col("arrival") - 500000})
    return stored, rows.unionByName(again).unionByName(foreign).unionByName(bad)


@query(
    f"""{WITH}, stored AS (SELECT * FROM messages WHERE sequence_number <= 2), fresh AS (SELECT *, sequence_number * 1000000 + CAST(conversation_id AS BIGINT) AS arrival FROM messages WHERE sequence_number > 2)
SELECT f.id, f.conversation_id, f.role, regexp_replace(regexp_replace(f.content, '^\\s+', ''), '\\s+$', '') AS content, CAST(ceil(length(regexp_replace(regexp_replace(f.content, '^\\s+', ''), '\\s+$', '')) / 3.5) AS INT) AS token_count,
       CAST(2 + row_number() OVER (PARTITION BY f.conversation_id ORDER BY arrival) AS INT) AS sequence_number, f.created_at FROM fresh f"""
)
def ingest_dedupe_seq(spark, sf_dir):
    return ingest.persist_messages(*_arrivals(spark, sf_dir))


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE conv_id % 3 <> 0")
def ensure_conversations(spark, sf_dir):
    m = model.messages(spark, sf_dir)
    known = m.select(F.col(BY).alias("id")).distinct().filter(F.col("id").cast("bigint") % 3 == 0)
    return ingest.ensure_conversations(known, m).select("id", "session_id")


@query(
    """SELECT 'c' || conv_id || '-m' || (turn + 1) AS message_id, CAST(k AS INT) AS sequence_number, CASE k WHEN 1 THEN 'text' ELSE 'tool_result' END AS part_type, CASE k WHEN 1 THEN text ELSE role END AS content
FROM conversations, range(1, 3) AS r(k) WHERE turn % 2 = 0
UNION ALL SELECT 'c' || conv_id || '-m' || (turn + 1), 1, 'text', text FROM conversations WHERE turn % 2 = 1"""
)
def parts_decompose(spark, sf_dir):
    m = model.messages(spark, sf_dir)
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("content"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("content"), F.col("role").alias("text")))
    # elements that are no parts: they are left out one by one
    junk = F.lit('[5, "a", null, {"a": 1}, {"type": 7, "content": "x"}, {"type": "text"}, {"type": "", "text": "x"}, {"type": "text", "content": 3},')
    listed = F.concat(junk, F.substring(F.to_json(parts), F.lit(2), F.length(F.to_json(parts))))
    structured = m.withColumn("content", F.when(F.col("sequence_number") % 2 == 1, listed).otherwise(F.col("content")))
    return ingest.message_parts(structured)


@on_tables(f"{WITH}{HALF} SELECT summary_id, message_id FROM half_links UNION SELECT 'extra', id FROM messages WHERE sequence_number = 1")
def mark_summarised(t):
    new = t["messages"].filter("sequence_number = 1").select(F.lit("extra").alias("summary_id"), F.col("id").alias("message_id"), F.lit(0).alias("pos"))
    known = half_open(t)["summary_messages"]
    return ingest.mark_summarized(known, new.unionByName(new).unionByName(known)).select("summary_id", "message_id")


RESET = f"{WITH}, gone AS (SELECT DISTINCT conversation_id FROM messages WHERE CAST(conversation_id AS BIGINT) % 5 = 0)"


@on_tables(f"{RESET} SELECT conversation_id, (SELECT count(*) FROM messages m WHERE m.conversation_id = g.conversation_id) AS n_messages, (SELECT count(*) FROM summaries s WHERE s.conversation_id = g.conversation_id) AS n_summaries FROM gone g")
def reset_counts(t):
    gone = t["messages"].select(BY).filter(F.col(BY).cast("bigint") % 5 == 0)
    return ingest.reset(t, gone)[1]


@on_tables(f"{RESET} SELECT 'messages' AS name, count(*) AS n FROM messages WHERE conversation_id NOT IN (FROM gone) UNION ALL SELECT 'summaries', count(*) FROM summaries WHERE conversation_id NOT IN (FROM gone) UNION ALL SELECT 'summary_messages', count(*) FROM summary_messages l JOIN messages m ON m.id = l.message_id WHERE m.conversation_id NOT IN (FROM gone) UNION ALL SELECT 'summary_parents', count(*) FROM summary_parents e JOIN summaries s ON s.id = e.child_id WHERE s.conversation_id NOT IN (FROM gone)")
def reset_session(t):
    gone = t["messages"].select(BY).filter(F.col(BY).cast("bigint") % 5 == 0)
    left = ingest.reset(t, gone)[0]
    out = None
    for name in ("messages", "summaries", "summary_messages", "summary_parents"):
        n = left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


KINDS = ["text", "reasoning", "file", "tool", "subtask", "step-start", "step-finish", "snapshot", "patch", "agent", "retry", "compaction", "unknown"]


@query(
    f"""WITH k AS (SELECT 'c' || conv_id || '-m' || (turn + 1) AS id, ({KINDS})[(conv_id + turn) % 13 + 1] AS kind, conv_id % 2 = 0 AS even, role, text FROM conversations)
SELECT id, trim(CASE kind WHEN 'text' THEN text WHEN 'reasoning' THEN text WHEN 'file' THEN CASE WHEN even THEN text ELSE role END
  WHEN 'tool' THEN '[Tool ' || role || ']' || chr(10) || 'Input: ' || CASE WHEN even THEN '{{"b":[1,"x"],"a":null}}' ELSE 'plain' END || CASE WHEN even THEN chr(10) || 'Output: ' || text ELSE chr(10) || 'Error: ' || text END
  WHEN 'subtask' THEN role || chr(10) || text WHEN 'step-start' THEN CASE WHEN even THEN text ELSE '[Step started]' END
  WHEN 'step-finish' THEN role || CASE WHEN even THEN chr(10) || text ELSE '' END WHEN 'snapshot' THEN text WHEN 'patch' THEN 'Patch ' || role || chr(10) || 'a.py' || chr(10) || 'b.py'
  WHEN 'agent' THEN CASE WHEN even THEN text ELSE role END WHEN 'retry' THEN 'Retry 2: ' || text WHEN 'compaction' THEN CASE WHEN even THEN '[Automatic compaction]' ELSE '[Compaction]' END ELSE '' END || chr(10) || chr(10) || 'end', ' ' || chr(10)) AS content FROM k"""
)
def host_parts(spark, sf_dir):
    m = model.messages(spark, sf_dir)
    conv, even = F.col(BY).cast("bigint"), F.col(BY).cast("bigint") % 2 == 0
    kind = F.array(*map(F.lit, KINDS))[((conv + F.col("sequence_number") - 1) % 13).cast("int")]
    text, role, if_even = F.col("content"), F.col("role"), lambda c: F.when(even, c)
    state = F.struct(F.when(even, "completed").otherwise("error").alias("status"), if_even(text).alias("output"), F.when(~even, text).alias("error"))
    struct = F.struct(
        kind.alias("type"), text.alias("text"), F.when(~even, role).alias("filename"), role.alias("tool"), state.alias("state"), role.alias("description"), text.alias("prompt"), role.alias("reason"), role.alias("hash"), role.alias("name"),
        F.when(even | (kind == "snapshot"), text).alias("snapshot"), F.array(F.lit("a.py"), F.lit("b.py")).alias("files"), F.lit(2).alias("attempt"), F.struct(F.struct(text.alias("message")).alias("data")).alias("error"), even.alias("auto"),
        if_even(F.struct(F.struct(text.alias("value")).alias("text"), text.alias("value"))).alias("source"),
    )
    given = F.when(even, F.lit('"state":{"input":{"b":[1,"x"],"a":null},')).otherwise(F.lit('"state":{"input":"plain",'))
    part = F.replace(F.to_json(struct), F.lit('"state":{'), given)
    parts = F.array(part, F.lit('{"type":"text","text":"  "}'), F.lit('{"type":"text","text":"end"}'))
    return ingest.host_messages(m.select("id", parts.alias("parts")))


# -- tokens and levels ----------------------------------------------------------


@query("SELECT doc_id, CAST(ceil(length(text) / 3.5) AS INT) AS tokens, ceil(length(text) / 3.5) > 1000 AS over, left(text, 350) AS head, length(substr(text, 351)) AS rest FROM documents")
def token_estimates(spark, sf_dir):
    tokens, parts = T.estimate_tokens("text"), T.split_by_budget("text", 100)
    return model.table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), T.is_over_budget(tokens, 1000).alias("over"), parts["head"].alias("head"), F.length(parts["tail"]).cast("bigint").alias("rest"))


STATE = f"""{WITH}{HALF}, o AS (SELECT conversation_id, count(*) AS n_open, sum(token_count) AS open_tokens FROM open GROUP BY 1),
r AS (SELECT conversation_id, sum(token_count) AS root_tokens, max(depth) AS root_depth FROM summaries WHERE id NOT IN (SELECT child_id FROM summary_parents) GROUP BY 1),
s AS (SELECT conversation_id, coalesce(n_open, 0) AS n_open, CAST(coalesce(open_tokens, 0) AS BIGINT) AS open_tokens, CAST(coalesce(open_tokens, 0) + coalesce(root_tokens, 0) AS BIGINT) AS load, coalesce(root_depth, 0) AS root_depth
      FROM (SELECT DISTINCT conversation_id FROM messages) LEFT JOIN o USING (conversation_id) LEFT JOIN r USING (conversation_id)),
l AS (SELECT *, CASE WHEN root_depth >= 5 THEN 'deterministic' WHEN load >= {HARD} THEN 'aggressive' WHEN root_depth >= 3 THEN 'aggressive' ELSE 'normal' END AS level FROM s)"""


@on_tables(f"{STATE} SELECT conversation_id, n_open, open_tokens, load, root_depth, level, n_open > 0 AND level <> 'deterministic' AND (level = 'aggressive' OR ((n_open >= 4 OR open_tokens >= 500) AND load >= {SOFT})) AS due FROM l")
def token_load_level(t):
    return compact.state(half_open(t), CONFIG).select(BY, "n_open", "open_tokens", "load", "root_depth", "level", "due")


@on_tables(f"{WITH} SELECT conversation_id, count(*) >= 4 OR sum(token_count) >= 500 AS due FROM messages GROUP BY 1")
def should_summarise(t):
    return t["messages"].groupBy(BY).agg(compact.should_summarize(F.count("*"), F.sum("token_count"), CONFIG).alias("due"))


# -- summary DAG -------------------------------------------------------------


@on_tables(f"{WITH} SELECT id, depth FROM summaries WHERE id NOT IN (SELECT child_id FROM summary_parents)")
def roots(t):
    return dag.roots(t["summaries"], t["summary_parents"]).select("id", "depth")


@on_tables(f"{WITH} SELECT id, conversation_id FROM summaries WHERE depth = 0 AND id NOT IN (SELECT child_id FROM summary_parents)")
def leaves(t):
    return dag.leaves(t["summaries"], t["summary_parents"]).select("id", BY)


@on_tables(f"{WITH} SELECT id FROM summaries WHERE id NOT IN (SELECT child_id FROM summary_parents) AND id NOT IN (SELECT parent_id FROM summary_parents)")
def isolated(t):
    return dag.isolated(t["summaries"], t["summary_parents"]).select("id")


@on_tables(f"{WITH} SELECT id, content FROM summaries WHERE depth = 1 AND id NOT IN (SELECT child_id FROM summary_parents)")
def uncondensed_depth1(t):
    return dag.uncondensed(t["summaries"], t["summary_parents"], 1).select("id", "content")


@on_tables(f"{WITH} SELECT s.id, p.parent_id, s.content FROM summaries s JOIN summary_parents p ON p.child_id = s.id")
def children(t):
    return dag.children(t["summaries"], t["summary_parents"]).select("id", "parent_id", "content")


@on_tables(f"{WITH} SELECT s.id, (SELECT count(*) FROM summary_parents p WHERE p.child_id = s.id) AS n_parents, coalesce((SELECT string_agg(message_id, ',' ORDER BY pos) FROM summary_messages l WHERE l.summary_id = s.id), '') AS messages FROM summaries s")
def summaries_with_lists(t):
    full = dag.with_lists(t["summaries"], t["summary_parents"], t["summary_messages"])
    return full.select("id", F.size("parent_ids").cast("bigint").alias("n_parents"), F.array_join("message_ids", ",").alias("messages"))


DOWN = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, down AS (
  SELECT id AS root_id, id, 0 AS lvl, id AS path FROM summaries WHERE id NOT IN (SELECT child_id FROM summary_parents)
  UNION ALL SELECT d.root_id, p.child_id, d.lvl + 1, d.path || '/' || p.child_id FROM down d JOIN summary_parents p ON p.parent_id = d.id
)"""


@on_tables(f"{DOWN} SELECT root_id, id, CAST(lvl AS INT) AS lvl, path FROM down")
def children_tree(t):
    return dag.tree(t["summaries"], t["summary_parents"]).select("root_id", "id", "lvl", F.array_join("path", "/").alias("path"))


COVER = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, down AS (
  SELECT id AS root_id, id FROM summaries UNION SELECT d.root_id, p.child_id FROM down d JOIN summary_parents p ON p.parent_id = d.id
)"""


@on_tables(f"{COVER} SELECT root_id AS id, min(sequence_number) AS first_seq, max(sequence_number) AS last_seq, count(m.id) AS n_messages FROM down d LEFT JOIN summary_messages l ON l.summary_id = d.id LEFT JOIN messages m ON m.id = l.message_id GROUP BY 1")
def coverage_range(t):
    return dag.coverage(t["summaries"], t["summary_parents"], t["summary_messages"], t["messages"])


# -- search ------------------------------------------------------------------


def _bm25(source: str, columns: str, words: list[str], match: str) -> str:
    """SQL of BM25 over ``source`` (columns and content) for single words."""
    counts = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(words))
    stats = ", ".join(f"count(*) FILTER (WHERE tf{k} > 0) AS df{k}" for k in range(len(words)))
    term = "CASE WHEN tf{k} > 0 THEN greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE 0 END) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END"
    score = " + ".join(term.format(k=k) for k in range(len(words)))
    return f"""counted AS (SELECT *, len(toks) AS dl, {counts} FROM (SELECT {columns}, regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+') AS toks FROM {source})),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM counted), found AS (SELECT {columns}, -({score}) AS rank FROM counted, stats WHERE {match})"""


TWO = ["reating", "thedble"]
ANY2 = "tf0 > 0 OR tf1 > 0"


@on_tables(f"{WITH}, {_bm25('messages', 'id, conversation_id', ['ingth', 'thely'], ANY2)} SELECT id, conversation_id, round(rank, 6) AS rank FROM found ORDER BY found.rank, id LIMIT 20")
def bm25_messages(t):
    return rounded(search.top(search.ranked(t["messages"], "ingth OR thely")).select("id", BY, "rank"), "rank")


@on_tables(f"{WITH}, {_bm25('summaries', 'id, conversation_id, depth', ['messages', 'in'], 'tf0 > 0 AND tf1 > 0')} SELECT id, conversation_id, depth, round(rank, 6) AS rank FROM found ORDER BY found.rank, id LIMIT 20")
def bm25_summaries(t):
    return rounded(search.top(search.ranked(t["summaries"], "messages in")).select("id", BY, "depth", "rank"), "rank")


@query(f"WITH docs AS (SELECT doc_id, text AS content FROM documents), {_bm25('docs', 'doc_id', TWO, ANY2)} SELECT doc_id, round(rank, 6) AS rank FROM found ORDER BY found.rank, doc_id LIMIT 20")
def bm25_documents(spark, sf_dir):
    docs = model.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return rounded(search.top(search.ranked(docs, " OR ".join(TWO)), 20, ties=("doc_id",)).select("doc_id", "rank"), "rank")


PER_TYPE = f"{WITH}, {_bm25('messages', 'id, conversation_id', ['in', 'is'], 'tf0 > 0 AND tf1 = 0')}, m AS (SELECT 'message' AS type, * FROM found)"
ALL2 = f"""{PER_TYPE}, s AS (WITH {_bm25('summaries', 'id, conversation_id', ['in', 'is'], 'tf0 > 0 AND tf1 = 0')} SELECT 'summary' AS type, * FROM found), both_ AS (SELECT * FROM m UNION ALL SELECT * FROM s)"""


@on_tables(f"{ALL2} SELECT type, id, conversation_id, round(rank, 6) AS rank FROM both_ ORDER BY both_.rank, type, id LIMIT 25")
def search_all(t):
    return rounded(search.search_all(t["messages"], t["summaries"], "in NOT is", limit=25), "rank")


@on_tables(f"{ALL2}, k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY rank, type, id) AS k FROM both_), t AS (SELECT * FROM k WHERE k <= 5), w AS (SELECT *, max(rank) OVER p AS worst, min(rank) OVER p AS best FROM t WINDOW p AS (PARTITION BY conversation_id)) SELECT type, id, conversation_id, round(CASE WHEN worst = best THEN 1.0 ELSE (worst - rank) / (worst - best) END, 6) AS score FROM w")
def relevance_normalised(t):
    found = search.search_all(t["messages"], t["summaries"], "in NOT is", limit=5, per=BY)
    return rounded(search.relevance(found), "score").select("type", "id", BY, "score")


@query(
    "WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS s FROM documents) SELECT doc_id FROM t WHERE contains(s, ' of the ') AND NOT contains(s, ' is ')"
)
def search_phrase(spark, sf_dir):
    docs = model.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return search.ranked(docs, '"of the" NOT is').select("doc_id")


@query("WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') AS s FROM documents) SELECT doc_id FROM t WHERE contains(s, ' einver') OR contains(s, ' ciones')")
def search_prefix(spark, sf_dir):
    docs = model.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return search.ranked(docs, "einver* OR ciones*").select("doc_id")


@query(f"{ALL2} SELECT type, id, conversation_id, round(rank, 6) AS rank FROM both_ ORDER BY both_.rank, type, id LIMIT 25")
def search_stored(spark, sf_dir):
    """As ``search_all``, from an index that a store keeps: messages inserted in two parts, then summaries."""
    t = model.tables(spark, sf_dir)
    store = model.Store(spark, f"{checkpoint.folder(spark)}/index-{uuid.uuid4().hex}")
    search_index.insert(store, "message", t["messages"].filter("sequence_number <= 2"))
    search_index.insert(store, "message", t["messages"])
    search_index.insert(store, "summary", t["summaries"])
    return rounded(search_index.search_all(store, "in NOT is", limit=25), "rank")


@on_tables()
def search_snippets(t):
    found = search.top(search.ranked(t["messages"], "ingth OR thely"))
    return found.select("id", search.snippet("content", "ingth OR thely").alias("snippet"))


# -- context --------------------------------------------------------------------

PACK = """ranked AS (SELECT *, CASE WHEN depth > 0 AND id NOT IN (SELECT child_id FROM summary_parents) THEN 0 WHEN depth = 0 THEN 1 ELSE 2 END AS bucket FROM summaries),
packed AS (SELECT *, sum(token_count) OVER (PARTITION BY conversation_id ORDER BY bucket, CASE WHEN bucket = 0 THEN -depth ELSE 0 END, created_at, id ROWS UNBOUNDED PRECEDING) AS packed_tokens FROM ranked)"""


@on_tables(f"{WITH}, {PACK} SELECT id, conversation_id, bucket, CAST(packed_tokens AS BIGINT) AS packed_tokens FROM packed WHERE packed_tokens <= 40")
def pack_summaries(t):
    return context.pack_summaries(t["summaries"], t["summary_parents"], F.lit(40)).select("id", BY, "bucket", "packed_tokens")


ASSEMBLE = f"""{WITH}{HALF}, tail AS (
  SELECT * FROM (SELECT *, row_number() OVER w AS k, sum(token_count) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM open WINDOW w AS (PARTITION BY conversation_id ORDER BY sequence_number DESC)) WHERE k <= 4 AND run <= 800
), used AS (SELECT conversation_id, sum(token_count) AS used FROM tail GROUP BY 1), {PACK}, items AS (
  SELECT conversation_id, 'summary' AS type, id, 'system' AS role, depth, content, token_count, created_at, 0 AS seq FROM packed LEFT JOIN used USING (conversation_id) WHERE packed_tokens <= greatest(800 - coalesce(used, 0), 0)
  UNION ALL SELECT conversation_id, 'message', id, role, NULL, content, token_count, created_at, sequence_number FROM tail
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY type DESC, seq, created_at, id) AS INT) AS position FROM items)"""


@on_tables(f"{ASSEMBLE} SELECT conversation_id, position, type, id, role, depth, token_count, created_at FROM placed")
def assemble_context(t):
    return context.assemble(half_open(t), CONFIG).select(BY, "position", "type", "id", "role", "depth", "token_count", "created_at")


@on_tables(f"{ASSEMBLE} SELECT conversation_id, CAST(sum(token_count) AS BIGINT) AS tokens FROM placed GROUP BY 1")
def context_tokens(t):
    return context.token_totals(context.assemble(half_open(t), CONFIG))


@on_tables()
def assemble_with_query(t):
    return rounded(context.assemble(half_open(t), CONFIG, "in NOT is"), "relevance").select(BY, "position", "type", "id", "relevance")


XML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
RENDER = f"""{ASSEMBLE}, cov AS (SELECT summary_id AS id, CASE WHEN min(sequence_number) = max(sequence_number) THEN '' || min(sequence_number) ELSE min(sequence_number) || '-' || max(sequence_number) END AS covers FROM half_links JOIN messages m ON m.id = message_id GROUP BY 1)
SELECT conversation_id, 0 AS position, 'system' AS role, 'Earlier parts of this conversation are given as summaries. Summaries: ' || count(*) FILTER (WHERE type = 'summary') || '; messages: ' || count(*) FILTER (WHERE type = 'message') || '; tokens: ' || CAST(sum(token_count) AS BIGINT) || '; depth: ' || coalesce(max(depth), 0) || '.' AS text FROM placed GROUP BY 1
UNION ALL
SELECT conversation_id, position, CASE WHEN type = 'summary' THEN 'system' WHEN role = 'user' THEN 'user' ELSE 'assistant' END,
  CASE WHEN type = 'message' THEN content ELSE '<context_summary depth="' || depth || '" tokens="' || token_count || '" covers_messages="' || coalesce(covers, '0 messages') || '" created="' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '">' || chr(10) || content || chr(10) || '</context_summary>' END
FROM placed LEFT JOIN cov USING (id)"""


@on_tables(RENDER)
def render_context(t):
    h = half_open(t)
    return context.render(context.assemble(h, CONFIG), h["summary_messages"], h["messages"])


@on_tables(f"SELECT conversation_id, position, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, 'ctx-' || conversation_id || '-' || position AS id, 'ctx-' || conversation_id || '-' || lag(position) OVER (PARTITION BY conversation_id ORDER BY position) AS parent_id FROM ({RENDER})")
def transform_messages(t):
    h = half_open(t)
    return context.transform_messages(context.render(context.assemble(h, CONFIG), h["summary_messages"], h["messages"])).select(BY, "position", "role", "id", "parent_id")


@query(f"SELECT page_id, {XML.format('url')} AS escaped, {XML.format('html')} AS html FROM pages")
def escape_xml(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", T.escape_xml("url").alias("escaped"), T.escape_xml("html").alias("html"))


# -- compaction ------------------------------------------------------------------


@on_tables(f"{WITH}, l AS (SELECT *, sum(token_count) OVER (PARTITION BY conversation_id) AS total, coalesce(sum(token_count) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM summaries WHERE depth = 0 AND id NOT IN (SELECT child_id FROM summary_parents)) SELECT id, conversation_id FROM l WHERE total - before > 20")
def truncate_leaves(t):
    return compact.truncated_leaves(t["summaries"], t["summary_parents"], 20)


@on_tables()
def chunk_messages(t):
    return compact.chunks(t["messages"], 300)


@on_tables()
def leaf_summaries(t):
    made, links = compact.leaf_summaries(half_open(t), CONFIG)
    return made.join(links.groupBy(F.col("summary_id").alias("id")).agg(F.count("*").alias("n_messages")), "id")


CONDENSE = f"""{STATE}, g AS (
  SELECT conversation_id, count(*) AS n, arg_min(content, struct_pack(c := created_at, i := id)) AS first, max(created_at) + INTERVAL 1 SECOND AS created_at FROM summaries WHERE depth = 0 AND id NOT IN (SELECT child_id FROM summary_parents) GROUP BY 1 HAVING count(*) >= 2)
SELECT g.conversation_id, CAST(1 AS INT) AS depth, 'Summary of ' || n || ' summaries about ' || array_to_string(string_split(first, ' ')[1:3], ' ') AS content, g.created_at, l.level AS compaction_level, n AS n_children FROM g JOIN l USING (conversation_id)"""


@on_tables(CONDENSE)
def condense(t):
    h = half_open(t)
    made, edges = compact.condense(h, 0, compact.state(h, CONFIG), CONFIG)
    n = edges.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return made.join(n, "id").select(BY, "depth", "content", "created_at", "compaction_level", "n_children")


@on_tables()
def compact_all(t):
    empty = t | {k: t[k].limit(0) for k in ("summaries", "summary_messages", "summary_parents")}
    return session.info(compact.compact(empty, CONFIG))


# -- files and expansion ----------------------------------------------------------

# The rule of the original, by hand: a tag; else a "//" comment (after an optional "path:") on the first line of a code block,
# of which the last extension ends the path; else a first line without spaces that has a slash and ends in an extension.
FILES = """texts AS (SELECT 'd' || doc_id AS id, CAST(doc_id % 50 AS VARCHAR) AS conversation_id, CASE doc_id % 7
    WHEN 0 THEN '<file path="src/' || source || '.txt">' || chr(10) || text
    WHEN 1 THEN 'lib/' || lang || '.md' || chr(10) || text
    WHEN 2 THEN '```ts' || chr(10) || '// path: src/' || source || '.ts' || chr(10) || text
    WHEN 3 THEN '```' || chr(10) || '//a/b c/' || lang || '.py rest' || chr(10) || text
    WHEN 4 THEN '```md' || chr(10) || '# v1.0' || chr(10) || text
    WHEN 5 THEN chr(9) || 'win' || chr(92) || lang || chr(9) || 'x.c ' || chr(10) || text
    ELSE text END AS content, doc_id, source, lang, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) AS created_at FROM documents),
sized AS (SELECT *, CAST(ceil(length(content) / 3.5) AS INT) AS token_count, string_split(content, chr(10))[1] AS line FROM texts),
paths AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'src/' || source || '.txt' WHEN 1 THEN 'lib/' || lang || '.md' WHEN 2 THEN 'src/' || source || '.ts'
    WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'win' || chr(92) || lang || chr(9) || 'x.c'
    ELSE CASE WHEN trim(line) NOT LIKE '% %' AND (contains(line, '/') OR contains(line, chr(92))) AND regexp_matches(trim(line), '[.][A-Za-z0-9]{1,10}$') THEN trim(line) END END AS path FROM sized)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.table(spark, sf_dir, "documents")
    heads = [
        F.concat(F.lit('<file path="src/'), "source", F.lit('.txt">\n')),
        F.concat(F.lit("lib/"), "lang", F.lit(".md\n")),
        F.concat(F.lit("```ts\n// path: src/"), "source", F.lit(".ts\n")),
        F.concat(F.lit("```\n//a/b c/"), "lang", F.lit(".py rest\n")),
        F.lit("```md\n# v1.0\n"),
        F.concat(F.lit("\twin\\"), "lang", F.lit("\tx.c \n")),
    ]
    head = F.lit("")
    for k, h in enumerate(heads):
        head = F.when(F.col("doc_id") % 7 == k, h).otherwise(head)
    rows = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), (F.col("doc_id") % 50).cast("string").alias(BY), F.concat(head, "text").alias("content"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"))
    return rows.withColumn("token_count", T.estimate_tokens("content"))


@query(f"WITH {FILES} SELECT id, path FROM paths")
def detect_path(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", T.detect_path("content").alias("path"))


@query(f"WITH {FILES} SELECT id AS message_id, conversation_id, path AS original_path, token_count, content FROM paths WHERE token_count > 1000")
def large_files(spark, sf_dir):
    return files.offload(_texts(spark, sf_dir), 1000)[1].select("message_id", BY, "original_path", "token_count", "content")


@query(f"WITH {FILES} SELECT id, CASE WHEN token_count > 1000 THEN '[Large file: ' || coalesce(path, 'content') || ' (' || token_count || ' tokens) — use expand to retrieve ' || sha256(conversation_id || '|' || id) || ']' ELSE content END AS content FROM paths")
def offloaded_messages(spark, sf_dir):
    return files.offload(_texts(spark, sf_dir), 1000)[0].select("id", "content")


@query(f"WITH {FILES} SELECT conversation_id, path AS original_path, id AS message_id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, path ORDER BY created_at DESC) AS k FROM paths WHERE token_count > 1000 AND path IS NOT NULL) WHERE k = 1")
def latest_by_path(spark, sf_dir):
    return files.latest_by_path(files.offload(_texts(spark, sf_dir), 1000)[1]).select(BY, "original_path", "message_id")


@query(f"WITH {FILES} SELECT conversation_id, count(*) AS n_files, CAST(sum(token_count) AS BIGINT) AS tokens FROM paths WHERE token_count > 1000 GROUP BY 1")
def file_stats(spark, sf_dir):
    return files.statistics(files.offload(_texts(spark, sf_dir), 1000)[1])


NN = "chr(10) || chr(10)"
ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z')"


@on_tables(f"""{WITH}, b AS (SELECT conversation_id, sequence_number, '[#' || sequence_number || ' ' || role || ' | ' || {ISO} || ']' || chr(10) || content AS block FROM messages WHERE sequence_number BETWEEN 5 AND 9),
r AS (SELECT *, 20 + sum(length(block) + 5) OVER (PARTITION BY conversation_id ORDER BY sequence_number ROWS UNBOUNDED PRECEDING) AS run FROM b),
g AS (SELECT conversation_id, string_agg(block, {NN} || '---' || {NN} ORDER BY sequence_number) AS text FROM r WHERE run <= 900 GROUP BY 1)
SELECT c.conversation_id, CASE WHEN c.conversation_id NOT IN (SELECT conversation_id FROM b) THEN 'No messages found in range 5-9 for this session.' ELSE '=== Messages 5-9 ===' || coalesce({NN} || g.text, '') END AS text
FROM (SELECT DISTINCT conversation_id FROM messages) c LEFT JOIN g USING (conversation_id)""")
def expand_range(t):
    return expand.range_texts(t["messages"], 5, 9, 900)


def _expanded(chars: int, condensed: bool) -> str:
    """Sections one by one while they fit, then messages up to the first that does not."""
    title = "" if condensed else f"UNION ALL SELECT summary_id, 3, TIMESTAMP '1970-01-01', '', 'Original message content:' FROM cov WHERE n > 0"
    head = f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, cov AS (SELECT s.id AS summary_id, count(m.id) AS n, coalesce(min(sequence_number), 0) AS lo, coalesce(max(sequence_number), 0) AS hi
  FROM summaries s LEFT JOIN summary_messages l ON l.summary_id = s.id LEFT JOIN messages m ON m.id = l.message_id GROUP BY 1),
raw AS (
  SELECT id AS summary_id, 0 AS kind, created_at, '0' AS id, '=== Expanded: Summary ' || id || ' (depth ' || depth || ') ===' AS s FROM summaries
  UNION ALL SELECT id, 0, created_at, '1', 'Summary text:' || chr(10) || content FROM summaries
  UNION ALL SELECT s.id, 0, created_at, '2', 'Covers messages: ' || lo || '-' || hi || ' (' || n || ' messages)' FROM summaries s JOIN cov ON cov.summary_id = s.id
  UNION ALL SELECT p.parent_id, 2, s.created_at, s.id, '### Child Summary (depth=' || s.depth || ', id=' || s.id || ')' || chr(10) || s.content FROM summaries s JOIN summary_parents p ON p.child_id = s.id
  {title}
), numbered AS (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY kind, created_at, id) AS k FROM raw),
fold AS (
  SELECT DISTINCT summary_id, CAST(0 AS BIGINT) AS k, CAST({chars} AS BIGINT) AS room, CAST(NULL AS VARCHAR) AS text FROM numbered
  UNION ALL
  SELECT f.summary_id, f.k + 1, CASE WHEN length(s) + CASE WHEN text IS NULL THEN 0 ELSE 2 END <= room THEN room - length(s) - CASE WHEN text IS NULL THEN 0 ELSE 2 END ELSE room END,
         CASE WHEN length(s) + CASE WHEN text IS NULL THEN 0 ELSE 2 END <= room THEN coalesce(text || {NN}, '') || s ELSE text END
  FROM fold f JOIN numbered n ON n.summary_id = f.summary_id AND n.k = f.k + 1
), done AS (SELECT summary_id, arg_max(room, k) AS room, list(text ORDER BY k)[-1] AS text FROM fold GROUP BY 1)"""
    if condensed:
        return f"{head} SELECT summary_id, coalesce(text, '') AS text FROM done"
    return f"""{head}, b AS (SELECT l.summary_id, m.sequence_number, '[#' || sequence_number || ' ' || role || '] ' || content AS block FROM summary_messages l JOIN messages m ON m.id = l.message_id),
r AS (SELECT b.*, sum(length(block) + 2) OVER (PARTITION BY summary_id ORDER BY sequence_number ROWS UNBOUNDED PRECEDING) AS run FROM b),
g AS (SELECT r.summary_id, string_agg(block, {NN} ORDER BY sequence_number) AS text, count(*) AS shown, max(run) AS used FROM r JOIN done d USING (summary_id) WHERE run <= room GROUP BY 1),
o AS (SELECT d.summary_id, d.text || coalesce({NN} || g.text, '') AS text, n - coalesce(shown, 0) AS hidden, room - coalesce(used, 0) AS room FROM done d JOIN cov USING (summary_id) LEFT JOIN g USING (summary_id))
SELECT summary_id, CASE WHEN hidden > 0 AND length('... (' || hidden || ' more messages not shown)') + 2 <= room THEN text || {NN} || '... (' || hidden || ' more messages not shown)' ELSE text END AS text FROM o"""


@on_tables(_expanded(420, False))
def expand_summary(t):
    return expand.summary_texts(t, t["summaries"].select("id"), chars=420)


@on_tables(_expanded(330, True))
def expand_condensed(t):
    return expand.summary_texts(t, t["summaries"].select("id"), condensed=True, chars=330)


@on_tables(f"""{ALL2} SELECT f.type, f.id, CASE f.type WHEN 'message' THEN '[Message #' || m.sequence_number || ' | ' || m.role || ' | ' || strftime(m.created_at, '%Y-%m-%dT%H:%M:%S.000Z') || ']' || chr(10) || m.content
  ELSE '[Summary depth=' || s.depth || ' | ' || strftime(s.created_at, '%Y-%m-%dT%H:%M:%S.000Z') || ']' || chr(10) || s.content END AS block
FROM (SELECT * FROM both_ ORDER BY rank, type, id LIMIT 20) f LEFT JOIN messages m ON f.type = 'message' AND m.id = f.id LEFT JOIN summaries s ON f.type = 'summary' AND s.id = f.id""")
def expand_search(t):
    return expand.found(t, "in NOT is", 20).select("type", "id", "block")


# -- session and integrity -----------------------------------------------------------


@on_tables(f"""{ASSEMBLE}, spent AS (SELECT conversation_id, CAST(sum(token_count) AS BIGINT) AS context_tokens FROM placed GROUP BY 1),
info AS (SELECT conversation_id, count(*) AS n_messages, CAST(sum(token_count) AS BIGINT) AS tokens, max(created_at) AS last_activity, max(sequence_number) AS last_seq,
  count(*) FILTER (WHERE id NOT IN (SELECT message_id FROM half_links)) AS active, count(*) FILTER (WHERE id IN (SELECT message_id FROM half_links)) AS condensed FROM messages GROUP BY 1),
sums AS (SELECT conversation_id, count(*) AS n_summaries, max(depth) AS max_depth, CAST(sum(token_count) AS BIGINT) AS summary_tokens, max(created_at) AS last_compaction,
  count(*) FILTER (WHERE id NOT IN (SELECT child_id FROM summary_parents)) AS n_roots FROM summaries GROUP BY 1)
SELECT i.*, coalesce(n_summaries, 0) AS n_summaries, coalesce(max_depth, 0) AS max_depth, coalesce(summary_tokens, 0) AS summary_tokens, last_compaction, coalesce(n_roots, 0) AS n_roots, coalesce(context_tokens, 0) AS context_tokens,
  CAST({SOFT} AS INT) AS soft_threshold, CAST({HARD} AS INT) AS hard_threshold FROM info i LEFT JOIN sums USING (conversation_id) LEFT JOIN spent USING (conversation_id)""")
def describe(t):
    return session.describe(half_open(t), CONFIG)


def faulty(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Faults by rule: a missing second message, a wrong depth, a link to nowhere and a foreign one, a cycle."""
    c = F.col(BY).cast("bigint")
    messages = t["messages"].filter(~((c % 7 == 0) & (F.col("sequence_number") == 2)))
    summaries = t["summaries"].withColumn("depth", F.when((c % 11 == 0) & (F.col("depth") == 1), 3).otherwise(F.col("depth")))
    edges = t["summary_parents"].unionByName(t["summary_parents"].filter(F.col("child_id").rlike("^c[0-9]*8-d0-0$")).select(F.col("parent_id").alias("child_id"), F.col("child_id").alias("parent_id")))
    links = t["summary_messages"].unionByName(t["summaries"].filter((c % 13 == 0) & (F.col("depth") == 0)).select(F.col("id").alias("summary_id"), F.lit("nowhere").alias("message_id"), F.lit(9).alias("pos")))
    return t | {"messages": messages, "summaries": summaries, "summary_parents": edges, "summary_messages": links}


FAULTY = f"""{WITH}, f_messages AS (SELECT * FROM messages WHERE NOT (CAST(conversation_id AS BIGINT) % 7 = 0 AND sequence_number = 2)),
f_summaries AS (SELECT * REPLACE (CASE WHEN CAST(conversation_id AS BIGINT) % 11 = 0 AND depth = 1 THEN 3 ELSE depth END AS depth) FROM summaries),
f_edges AS (SELECT * FROM summary_parents UNION ALL SELECT parent_id, child_id FROM summary_parents WHERE regexp_matches(child_id, '^c[0-9]*8-d0-0$')),
f_links AS (SELECT * FROM summary_messages UNION ALL SELECT id, 'nowhere', 9 FROM summaries WHERE CAST(conversation_id AS BIGINT) % 13 = 0 AND depth = 0)"""


@on_tables(f"{FAULTY}, k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_number) AS k FROM f_messages) SELECT conversation_id, id AS item FROM k WHERE k <> sequence_number")
def integrity_ordering(t):
    return integrity.ordering(faulty(t))


ORPHANS = f"{FAULTY}, orphan AS (SELECT DISTINCT l.summary_id, l.message_id, coalesce(s.conversation_id, m.conversation_id) AS conversation_id FROM f_links l LEFT JOIN f_messages m ON m.id = l.message_id LEFT JOIN f_summaries s ON s.id = l.summary_id WHERE m.id IS NULL OR s.id IS NULL OR m.conversation_id <> s.conversation_id)"


@on_tables(f"{ORPHANS} SELECT * FROM orphan")
def integrity_coverage(t):
    return integrity.orphan_links(faulty(t))


@on_tables(f"{FAULTY} SELECT c.conversation_id, e.child_id || '>' || e.parent_id AS item FROM f_edges e JOIN f_summaries c ON c.id = e.child_id JOIN f_summaries p ON p.id = e.parent_id WHERE p.depth <> c.depth + 1")
def integrity_depth(t):
    return integrity.depth_mismatches(faulty(t))


@on_tables(f"{FAULTY} SELECT c.conversation_id, e.child_id AS item FROM f_edges e JOIN f_edges b ON b.child_id = e.parent_id AND b.parent_id = e.child_id JOIN f_summaries c ON c.id = e.child_id")
def integrity_acyclic(t):
    return integrity.cycles(faulty(t))


@on_tables(f"{FAULTY}, several AS (SELECT conversation_id FROM f_summaries GROUP BY 1 HAVING count(*) > 1) SELECT conversation_id, id AS item FROM f_summaries WHERE conversation_id IN (FROM several) AND id NOT IN (SELECT child_id FROM f_edges) AND id NOT IN (SELECT parent_id FROM f_edges)")
def integrity_orphans(t):
    return integrity.orphans(faulty(t))


@on_tables(f"{WITH}{HALF}, x AS (SELECT conversation_id, id FROM messages UNION ALL SELECT conversation_id, id FROM summaries) SELECT conversation_id, id AS item FROM x WHERE ends_with(id, '-m3')")
def integrity_index(t):
    docs = t["messages"].select("id", BY).unionByName(t["summaries"].select("id", BY))
    return integrity.index_mismatches(t, docs.filter(~F.col("id").endswith("-m3")))


@query(f"WITH {FILES}, big AS (SELECT * FROM paths WHERE token_count > 1000) SELECT conversation_id, sha256(conversation_id || '|' || id) AS item FROM big WHERE id IN (SELECT id FROM paths WHERE conversation_id = '4' OR conversation_id = '5')")
def integrity_files(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    _, rows = files.offload(texts, 1000)
    moved = texts.filter(f"{BY} <> '4'").withColumn(BY, F.when(F.col(BY) == "5", "6").otherwise(F.col(BY)))
    return integrity.file_mismatches({"messages": moved, "large_files": rows})


@on_tables(f"{ASSEMBLE}, s AS (SELECT conversation_id, sum(token_count) AS tokens FROM placed GROUP BY 1) SELECT conversation_id, CAST(CAST(tokens AS BIGINT) AS VARCHAR) AS item FROM s WHERE tokens > 150")
def integrity_budget(t):
    return integrity.over_budget(half_open(t), CONFIG, 150)


@on_tables(f"""{ORPHANS}, k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_number) AS k FROM f_messages), several AS (SELECT conversation_id FROM f_summaries GROUP BY 1 HAVING count(*) > 1), items AS (
  SELECT conversation_id, 'message-ordering' AS name, id AS item FROM k WHERE k <> sequence_number
  UNION ALL SELECT conversation_id, 'summary-coverage', summary_id || '>' || message_id FROM orphan
  UNION ALL SELECT c.conversation_id, 'dag-acyclicity', e.child_id FROM f_edges e JOIN f_edges b ON b.child_id = e.parent_id AND b.parent_id = e.child_id JOIN f_summaries c ON c.id = e.child_id
  UNION ALL SELECT c.conversation_id, 'depth-consistency', e.child_id || '>' || e.parent_id FROM f_edges e JOIN f_summaries c ON c.id = e.child_id JOIN f_summaries p ON p.id = e.parent_id WHERE p.depth <> c.depth + 1
  UNION ALL SELECT conversation_id, 'orphan-detection', id FROM f_summaries WHERE conversation_id IN (FROM several) AND id NOT IN (SELECT child_id FROM f_edges) AND id NOT IN (SELECT parent_id FROM f_edges)
), listed AS (SELECT conversation_id, name, list_sort(list(DISTINCT item)) AS items FROM items GROUP BY ALL),
grid AS (SELECT conversation_id, unnest(['message-ordering', 'summary-coverage', 'dag-acyclicity', 'depth-consistency', 'orphan-detection', 'token-budget']) AS name FROM (SELECT conversation_id FROM f_messages UNION SELECT conversation_id FROM f_summaries))
SELECT conversation_id, name, CASE WHEN items IS NULL THEN 'pass' ELSE 'fail' END AS status, CAST(coalesce(len(items), 0) AS INT) AS n_bad,
  CASE WHEN items IS NULL THEN '' ELSE array_to_string(items[1:5], ', ') || CASE WHEN len(items) > 5 THEN ' (+' || (len(items) - 5) || ' more)' ELSE '' END END AS details FROM grid LEFT JOIN listed USING (conversation_id, name)""")
def integrity_report(t):
    return integrity.run_checks(faulty(t), CONFIG)


@on_tables(f"{ORPHANS} SELECT summary_id, message_id FROM f_links WHERE (summary_id, message_id) NOT IN (SELECT (summary_id, message_id) FROM orphan)")
def repair_links(t):
    return integrity.repair(faulty(t))[0]["summary_messages"].select("summary_id", "message_id")
