"""Chat formatting after cumulative-snapshot collapse (operator 4), in DataFrame operations only.

Chat logs often hold every state of a conversation: one log of two turns, one
of four that begins with the same two, and so on. Each log gets a rolling hash
of its first k turns for every k. A log whose whole hash is the hash of a
proper prefix of another is dropped by an anti-join, equal logs are one log
(the smallest conv_id stays), and only the maximal ones are rendered.

A turn's digest is 128 bits of SHA-256 over role and text; the rolling hash is
the exclusive-or of 128 bits of SHA-256 over each place and digest, so it is a
running aggregate in which chance collisions do not occur in practice.

1. Only digests travel at first. A log is numbered and hashed in blocks of
   ``BLOCK`` turn numbers, whose totals are summed up over the log, so one log
   with very many turns is no single group. The result (a few bytes a turn) is
   written to the shared folder.
2. Prefix hashes are reduced to distinct ones before they are dealt out, so a
   first turn that a third of all logs share is one row a task.
3. Texts travel once, in groups of ``PART`` turn numbers of a log, equal rows
   combined before. In a log whose turns are 0, 1, 2, ... (``plain``) such a
   group is a part of the result; others are dealt out once more by their places.

Defined results: exact repeats of a row count once; other rows of the same
turn are turns of their own, ordered by role and text; null turns come first;
null and empty roles are ``user``; a null text is empty. A null conv_id is a
log like others. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import stored

BLOCK = 256
PART = 64
#: Groups that the turns without a number of one log are dealt to.
LOOSE = 1024
#: Turns of equal number up to which their keys are broadcast.
BROADCAST = 50_000
#: The turn format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A log, and a turn of it; null ids and turns have a mark and the value 0.
LOG = ["c", "cn"]
TURN = [*LOG, "tn", "t"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """``c, cn, tn, t, role, text, digest`` of every row."""
    role = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("user"))
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    rows = conversations.select(F.coalesce(conv, F.lit(0)).alias("c"), conv.isNull().alias("cn"), turn.isNull().alias("tn"), F.coalesce(turn, F.lit(0)).alias("t"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("digest", digest(F.col("role"), F.col("text")))


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def _halves(value: Column) -> list[Column]:
    own = F.sha2(value, 256)
    return [F.conv(F.substring(own, at, 16), 16, -10).cast("bigint") for at in (1, 17)]


def numbered(narrow: DataFrame) -> DataFrame:
    """``c, cn, tn, t, digest, tied, pos`` (from 1), ``n_turns``, ``plain`` and ``h1, h2``, the rolling hash of the turns up to this one.

    ``narrow``: ``c, cn, tn, t, digest`` and ``k``, the order of turns of equal number. ``tied`` marks those.
    """
    blocks = narrow.withColumn("block", F.when(F.col("tn"), F.lit(-(1 << 62))).otherwise(F.floor(F.col("t") / F.lit(BLOCK))))
    key = [*LOG, "block"]
    inner = W.partitionBy(*key).orderBy(F.col("tn").desc(), "t", "k", "digest")
    outer = W.partitionBy(*LOG).orderBy("block")
    before, whole = outer.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*LOG)
    within = blocks.withColumns({"at": F.row_number().over(inner), "tied": F.count("*").over(W.partitionBy(*key, "tn", "t")) > 1})
    sizes = within.groupBy(*key).agg(F.count("*").alias("n"), F.max("tied").alias("any_tied"), F.max("tn").alias("any_null"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    log = sizes.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "n_turns": F.sum("n").over(whole), "bad": F.max(F.col("any_tied") | F.col("any_null")).over(whole), "lo": F.min("lo").over(whole), "hi": F.max("hi").over(whole)})
    placed = log.select(*key, "before", "n_turns", (~F.col("bad") & (F.col("lo") == 0) & (F.col("hi") == F.col("n_turns") - 1)).alias("plain"))
    with_place = within.join(placed, key).withColumn("pos", F.col("before") + F.col("at"))
    one, two = _halves(F.concat(F.encode(F.concat(F.col("pos").cast("string"), F.lit(":")), "UTF-8"), F.col("digest")))
    hashed = with_place.withColumns({"g1": one, "g2": two})
    running = inner.rowsBetween(W.unboundedPreceding, 0)
    rolled = hashed.withColumns({f"h{k}": F.bit_xor(f"g{k}").over(running) for k in (1, 2)})
    totals = hashed.groupBy(*key).agg(*[F.bit_xor(f"g{k}").alias(f"x{k}") for k in (1, 2)])
    earlier = totals.select(*key, *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"y{k}") for k in (1, 2)])
    joined = rolled.join(earlier, key)
    return joined.select(*TURN, "digest", "tied", "pos", "n_turns", "plain", *[F.col(f"h{k}").bitwiseXOR(F.col(f"y{k}")).alias(f"h{k}") for k in (1, 2)])


def ordered_turns(turns: DataFrame) -> DataFrame:
    """The rows of ``numbered``, written to the shared folder; number and digest of a turn only where its log is not plain."""

    def kept(rows: DataFrame) -> DataFrame:
        own = lambda c: F.when(~F.col("plain"), F.col(c)).alias(c)
        return stored(numbered(rows).select(*LOG, own("tn"), own("t"), own("digest"), "tied", "pos", "n_turns", "plain", "h1", "h2"))

    narrow = turns.select(*TURN, "digest").distinct()
    made = kept(narrow.withColumn("k", F.lit(0)))
    tied = made.filter("tied").select(*TURN).distinct()
    n = tied.count()
    if not n:
        return made
    rows = turns.join(F.broadcast(tied) if n <= BROADCAST else tied, TURN, "left_semi").distinct()
    ranks = rows.select(*TURN, "digest", F.row_number().over(W.partitionBy(*TURN).orderBy("role", "text")).alias("k"))
    return kept(narrow.join(ranks, [*TURN, "digest"], "left").withColumn("k", F.coalesce("k", F.lit(0))))


def maximal(ordered: DataFrame) -> DataFrame:
    """``c, cn, n_turns, n_logs, plain`` of the logs that stay; ``n_logs`` counts those equal to each."""
    same = ["n_turns", "h1", "h2"]
    whole = ordered.filter("pos = n_turns").groupBy(*same).agg(F.min(F.struct("cn", "c", "plain")).alias("own"), F.count("*").alias("n_logs"))
    prefixes = ordered.filter("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, same, "left_anti").select("own.c", "own.cn", "n_turns", "n_logs", "own.plain")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, n_logs, text``: the maximal logs, rendered in parts of ``PART`` turns."""
    turns = turns_of(conversations)
    ordered = ordered_turns(turns)
    kept = stored(maximal(ordered))
    place = F.when(F.col("tn"), F.pmod(F.xxhash64("text"), F.lit(LOOSE))).otherwise(F.floor(F.col("t") / F.lit(PART))).cast("bigint")
    group = [*LOG, "tn", "place"]
    texts = turns.withColumn("place", place).groupBy(*group).agg(F.collect_set(F.struct("t", "role", "text")).alias("turns"))
    lines = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: rendered(x["role"], x["text"])), "")
    plain = kept.filter("plain").select(*LOG, F.lit(False).alias("tn"), "n_turns", "n_logs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_turns") - 1) / F.lit(PART)))).alias("place"))
    out = texts.join(plain, group).select(*LOG, F.col("place").cast("int").alias("part"), "n_turns", "n_logs", lines(F.col("turns")).alias("text"))
    if not kept.filter("not plain").isEmpty():
        others = ordered.filter("not plain").join(kept.filter("not plain").select(*LOG, "n_logs"), LOG).select(*TURN, "digest", "pos", "n_turns", "n_logs")
        # turns without a number are in all their log's loose groups
        where = others.select(*LOG, "tn", F.explode(F.when(F.col("tn"), F.sequence(F.lit(0).cast("bigint"), F.lit(LOOSE - 1).cast("bigint"))).otherwise(F.array(F.floor(F.col("t") / F.lit(PART))))).alias("place")).distinct()
        apart = texts.join(where, group, "left_semi").select(*LOG, "tn", F.explode("turns").alias("x")).select(*LOG, "tn", "x.t", "x.role", "x.text").withColumn("digest", digest(F.col("role"), F.col("text")))
        part = F.floor((F.col("pos") - 1) / F.lit(PART)).cast("int")
        again = apart.join(others, [*TURN, "digest"]).groupBy(*LOG, "n_turns", "n_logs", part.alias("part")).agg(F.collect_list(F.struct("pos", "role", "text")).alias("turns"))
        out = out.unionByName(again.select(*LOG, "part", "n_turns", "n_logs", lines(F.col("turns")).alias("text")))
    return out.select(F.when(~F.col("cn"), F.col("c")).alias("conv_id"), "part", "n_turns", "n_logs", "text")


ORACLE = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(trim(role), ''), 'user') AS role, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns
), logs AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(role := role, text := text) ORDER BY pos) AS all_turns FROM numbered GROUP BY conv_id
), kinds AS (
  SELECT all_turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_logs FROM logs GROUP BY all_turns, n_turns
), prefixes AS (
  SELECT DISTINCT all_turns[1:k] AS all_turns FROM (SELECT all_turns, unnest(range(1, n_turns)) AS k FROM logs)
), kept AS (
  SELECT * FROM kinds WHERE all_turns NOT IN (SELECT all_turns FROM prefixes)
)
SELECT k.conv_id, CAST((n.pos - 1) // {PART} AS INT) AS part, k.n_turns, k.n_logs,
       string_agg('{OPEN}' || n.role || chr(10) || n.text || '{CLOSE.strip()}' || chr(10), '' ORDER BY n.pos) AS text
FROM kept k JOIN numbered n ON n.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, part, k.n_turns, k.n_logs
"""
