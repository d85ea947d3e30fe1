"""URL filters by a temporal list join (operator 5), in DataFrame operations only.

A filter list is a log of dated changes: an entry (a host, or a host and a
path prefix) is added to or removed from a category. Changes become validity
intervals [valid_from, valid_to) by looking at the next change of the same
entry and category; dates and timestamps are kept as they are given. A capture
of a URL is held against the entries that were active when it was fetched: its
host and each parent domain, and its path's prefixes under each, as deep as the
deepest entry of the list, are looked up as of the fetch time.

Intervals are cut at the boundaries of ``PERIOD`` days, and captures carry
their period, so the as-of join is an equi-join on (entry, period) with few
intervals a key. It runs once for each distinct entry and fetch time that
captures ask for, so a host with a third of all captures asks once a time. The
answers go back to the captures by entry and time; as every capture asks for
its top-level domain, they are dealt to ``SALTS`` parts, and so are captures.

Defined results: a change without entry, time or category is ignored, one
without action is an addition; repeats change nothing; of several changes of
one entry at one time a removal wins. A URL without host, and a capture
without fetch time, match nothing and are ``allowed``. Repeated captures are
repeated in the result. Entries match without case; a leading ``www.`` of an
entry or host counts as a part like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD = 32
#: Parts that the captures of one entry and time are dealt to.
SALTS = 16
FOREVER = "9999-01-01"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port or final dot; empty if there is none."""
    own = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(own, r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def _timed(df: DataFrame, name: str) -> Column:
    """A date or timestamp as it is, anything else as a timestamp."""
    return F.col(name) if dict(df.dtypes)[name] in ("date", "timestamp") else F.col(name).cast("timestamp")


def validity(changes: DataFrame) -> DataFrame:
    """``entry, category, valid_from, valid_to`` (of the type of ``changed``) from ``entry, category, changed, action``."""
    gone = F.max(F.coalesce(F.lower("action"), F.lit("add")) == "remove")
    states = (
        changes.select(F.lower(F.trim("entry")).alias("entry"), "category", _timed(changes, "changed").alias("changed"), "action")
        .filter("entry is not null and entry <> '' and category is not null and changed is not null")
        .groupBy("entry", "category", "changed")
        .agg(gone.alias("gone"))
    )
    w = W.partitionBy("entry", "category").orderBy("changed")
    turns = states.withColumn("was", F.lag("gone").over(w)).filter("was is null and not gone or was <> gone")
    spans = turns.withColumn("valid_to", F.coalesce(F.lead("changed").over(w), F.lit(FOREVER).cast(states.schema["changed"].dataType)))
    return spans.filter("not gone").select("entry", "category", F.col("changed").alias("valid_from"), "valid_to")


def path_parts(entry: Column) -> Column:
    """Number of path parts of a list entry."""
    return F.size(F.filter(F.slice(F.split(entry, "/"), F.lit(2), F.greatest(F.size(F.split(entry, "/")), F.lit(1))), lambda s: s != ""))


def candidates(url: Column, deepest: int) -> Column:
    """array<string>: the entries of up to ``deepest`` path parts that would match a URL, the most special first."""
    host = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), "."))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    depth = F.least(F.size(steps), F.lit(deepest))
    paths = F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    all_ = F.flatten(F.transform(hosts, lambda h: F.concat(F.transform(paths, lambda p: F.concat(h, p)), F.array(h))))
    return F.when(F.coalesce(host_of(url), F.lit("")) == "", F.array().cast("array<string>")).otherwise(all_)


def period(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(PERIOD)).cast("int")


def filter_captures(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``capture_id, url, fetched, decision, entry, category, n_matches`` for ``captures`` (``capture_id, url, fetched``).

    The most special active entry decides (of equal ones the first category);
    ``decision`` is ``blocked`` if there is one, else ``allowed``.
    """
    fetched = _timed(captures, "fetched")
    latest = F.coalesce(captures.agg(F.max(fetched.cast("date"))).scalar(), F.lit("1970-01-01").cast("date"))
    lists = validity(changes)
    deepest = lists.agg(F.max(path_parts(F.col("entry")))).first()[0] or 0
    shown = lists.withColumns({"first": F.col("valid_from").cast("date"), "until": F.least(F.col("valid_to").cast("date"), latest)}).filter("until >= first")
    by_period = shown.select("entry", "category", "valid_from", "valid_to", F.explode(F.sequence(period(F.col("first")), period(F.col("until")))).alias("period"))
    seen = captures.select("capture_id", "url", fetched.alias("fetched")).groupBy("capture_id", "url", "fetched").agg(F.count("*").alias("copies"))
    asked = seen.select("*", F.posexplode_outer(candidates(F.col("url"), deepest)).alias("rank", "entry"))
    keys = asked.select("entry", "fetched").distinct().withColumn("period", period(F.col("fetched").cast("date")))
    met = keys.join(by_period, ["entry", "period"]).filter("fetched >= valid_from and fetched < valid_to")
    active = met.groupBy("entry", "fetched").agg(F.min("category").alias("category"), F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("capture_id", "url"), F.lit(SALTS)).cast("int")
    held = asked.withColumn("salt", salt).join(active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["entry", "fetched", "salt"], "left")
    best = F.min(F.when(F.col("n") > 0, F.struct("rank", "category", "entry")))
    judged = held.groupBy("capture_id", "url", "fetched", "copies").agg(best.alias("best"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"))
    decided = judged.withColumn("decision", F.when(F.col("n_matches") > 0, "blocked").otherwise("allowed"))
    return decided.select("capture_id", "url", "fetched", "decision", F.col("best.entry").alias("entry"), F.col("best.category").alias("category"), "n_matches", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


# The tables at hand have neither fetch times nor lists: both follow from them by a fixed rule.


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``: fetched on day page_id mod 1461 from 2020-01-01 on."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(1461)).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched"))


def _digits(value: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), at, 4), 16, 10).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """Changes for the hosts of ``pages``: by their MD5 every third host, and every fifth parent domain with a language path, is added once, most are removed later, and some come back."""
    hosts = pages.select(host_of(F.col("url")).alias("entry")).filter("entry <> ''").distinct()
    own = hosts.filter(_digits(F.col("entry"), 1) % 3 == 0)
    parents = hosts.select(F.array_join(F.slice(F.split("entry", r"\."), -3, 3), ".").alias("entry")).distinct().filter(_digits(F.col("entry"), 1) % 5 == 0).select(F.concat("entry", F.lit("/en")).alias("entry"))
    entries = own.unionByName(parents).withColumns({"a": _digits(F.col("entry"), 5) % 1000, "b": _digits(F.col("entry"), 9) % 400 + 1, "c": _digits(F.col("entry"), 13) % 400 + 1})
    category = F.when(F.col("a") % 2 == 0, "spam").otherwise("adult")
    steps = F.array(*[F.struct(F.lit(action).alias("action"), days.alias("days")) for action, days in (("add", F.col("a")), ("remove", F.col("a") + F.col("b")), ("add", F.col("a") + F.col("b") + F.col("c")))])
    wanted = F.slice(steps, 1, F.col("b") % 3 + 1)
    return entries.select("entry", category.alias("category"), F.explode(wanted).alias("s")).select("entry", "category", F.date_add(F.lit("2020-01-01").cast("date"), F.col("s.days")).alias("changed"), "s.action")


ORACLE = r"""
WITH caps AS (
  SELECT page_id AS capture_id, url, DATE '2020-01-01' + CAST(page_id % 1461 AS INT) AS fetched,
         regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS steps
  FROM pages
), hosts AS (
  SELECT DISTINCT host AS entry FROM caps WHERE host <> ''
), entries AS (
  SELECT entry FROM hosts WHERE CAST('0x' || substr(md5(entry), 1, 4) AS INT) % 3 = 0
  UNION ALL
  SELECT entry || '/en' FROM (SELECT DISTINCT array_to_string(string_split(entry, '.')[-3:], '.') AS entry FROM hosts)
  WHERE CAST('0x' || substr(md5(entry), 1, 4) AS INT) % 5 = 0
), drawn AS (
  SELECT entry, CAST('0x' || substr(md5(entry), 5, 4) AS INT) % 1000 AS a, CAST('0x' || substr(md5(entry), 9, 4) AS INT) % 400 + 1 AS b,
         CAST('0x' || substr(md5(entry), 13, 4) AS INT) % 400 + 1 AS c FROM entries
), spans AS (
  SELECT entry, CASE WHEN a % 2 = 0 THEN 'spam' ELSE 'adult' END AS category, DATE '2020-01-01' + a AS valid_from,
         CASE WHEN b % 3 >= 1 THEN DATE '2020-01-01' + (a + b) ELSE DATE '9999-01-01' END AS valid_to FROM drawn
  UNION ALL
  SELECT entry, CASE WHEN a % 2 = 0 THEN 'spam' ELSE 'adult' END, DATE '2020-01-01' + (a + b + c), DATE '9999-01-01' FROM drawn WHERE b % 3 = 2
), matched AS (
  SELECT c.capture_id, c.url, c.fetched, s.entry, s.category,
         length(c.host) - length(string_split(s.entry, '/')[1]) AS up, position('/' IN s.entry) > 0 AS deep, length(s.entry) AS n
  FROM caps c JOIN spans s
    ON (c.host = string_split(s.entry, '/')[1] OR ends_with(c.host, '.' || string_split(s.entry, '/')[1]))
   AND (position('/' IN s.entry) = 0 OR c.steps[1] = string_split(s.entry, '/')[2])
   AND c.fetched >= s.valid_from AND c.fetched < s.valid_to
), best AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, url ORDER BY up, deep DESC, n DESC, category) AS k,
         count(*) OVER (PARTITION BY capture_id, url) AS n_matches FROM matched
)
SELECT c.capture_id, c.url, c.fetched, CASE WHEN b.entry IS NULL THEN 'allowed' ELSE 'blocked' END AS decision, b.entry, b.category, coalesce(b.n_matches, 0) AS n_matches
FROM caps c LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.capture_id = c.capture_id AND b.url = c.url
"""
