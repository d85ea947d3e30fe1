"""Merkle-tree document fingerprints (operator 3), in DataFrame operations only.

A text is a tree: sections (parted by blank lines), paragraphs (lines), and
spans of a paragraph (sentences, cut at ``SPAN`` code points). A span's hash is
the MD5 of its characters; a paragraph's hash is that of its spans' hashes, a
section's that of its paragraphs', and the root is the SHA-256 over the
sections' hashes. Roots are equal just where texts are equal, and walking down
the branches whose hashes differ finds the edited spans.

The fingerprint is a string: the root, a colon, and the tree with 8 hex digits
of each span's hash, paragraphs parted by commas and sections by semicolons.
All separators belong to the span before them, so every character is hashed.

Likeness is the share of equal spans, 2 * common / (all spans of both). Spans
are matched by their place in the unchanged head and tail of the two trees,
and within the differing middle as sets; so repeated lines count as often as
they stand in head and tail.

Defined results: a null or empty text has no spans; two such texts have
likeness 1, one such and another text 0. Null doc_ids sort first. Repeated
rows are documents of their own, in the order of doc_id and text; the order of
fully equal rows makes no difference. Names of other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = 96
#: doc_ids of one bucket of neighbours.
BUCKET = 256
#: Buckets of one bucket of the next level up, and buckets that one task orders at most.
LEVEL, TOP = 1 << 12, 10_000
SECTION = r"(?s).*?\n[ \t\r]*\n\s*|(?s).+"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
SENTENCE = rf"[^.!?\n]{{0,{SPAN - 1}}}[.!?\n]\s*|[^.!?\n]{{1,{SPAN}}}"


def _md5_of(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes, "").cast("binary"))


def tree(text: Column) -> Column:
    """array<array<array<string>>>: span hashes by section and paragraph."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)),
        lambda section: F.transform(
            F.regexp_extract_all(section, F.lit(PARAGRAPH), F.lit(0)),
            lambda paragraph: F.transform(F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0)), lambda span: F.md5(span.cast("binary"))),
        ),
    )


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text."""
    return F.transform(F.array(tree(F.coalesce(text, F.lit("")))), _print)[0]


def _print(hashes: Column) -> Column:
    root = F.sha2(F.array_join(F.transform(hashes, lambda s: _md5_of(F.transform(s, _md5_of))), "").cast("binary"), 256)
    shown = F.array_join(F.transform(hashes, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(F.transform(p, lambda h: F.substring(h, 1, 8)), "")), ",")), ";")
    return F.concat(root, F.lit(":"), shown)


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def spans(print_: Column) -> Column:
    """array<string>: the span codes of a fingerprint, in order."""
    return F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit("[0-9a-f]{8}"), F.lit(0))


def _head(equal: Column) -> Column:
    """Length of the run of true at the start of a boolean array."""
    at = F.array_position(equal, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(equal)).cast("int")


def likeness(one: Column, other: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints, from the strings alone."""
    pair = F.array(F.struct(spans(one).alias("a"), spans(other).alias("b")))

    def of(p: Column) -> Column:
        n = F.least(F.size(p["a"]), F.size(p["b"]))
        eq = F.zip_with(F.slice(p["a"], 1, n), F.slice(p["b"], 1, n), lambda x, y: x == y)
        back = F.zip_with(F.slice(F.reverse(p["a"]), 1, n), F.slice(F.reverse(p["b"]), 1, n), lambda x, y: x == y)
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), n.alias("n"), _head(eq).alias("head"), _head(back).alias("back"))

    def dice(p: Column) -> Column:
        tail = F.least(p["back"], p["n"] - p["head"])
        a = F.slice(p["a"], p["head"] + 1, F.size(p["a"]) - p["head"] - tail)
        b = F.slice(p["b"], p["head"] + 1, F.size(p["b"]) - p["head"] - tail)
        both = F.size(p["a"]) + F.size(p["b"])
        common = p["head"] + tail + F.size(F.array_intersect(a, b))
        return F.when(both == 0, 1.0).otherwise(2.0 * common / both)

    unlike = F.transform(F.transform(pair, of), dice)[0]
    return F.when(one == other, 1.0).otherwise(unlike)


def differing_spans(one: Column, other: Column) -> Column:
    """array<int>: places (from 0) of spans of ``one`` outside the head and tail that it shares with ``other``."""
    a, b = spans(one), spans(other)
    n = F.least(F.size(a), F.size(b))
    head = _head(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y))
    back = _head(F.zip_with(F.slice(F.reverse(a), 1, n), F.slice(F.reverse(b), 1, n), lambda x, y: x == y))
    count = F.size(a) - head - F.least(back, n - head)
    return F.when(count > 0, F.sequence(head, head + count - 1)).otherwise(F.array().cast(T.ArrayType(T.IntegerType())))


def following(values: DataFrame) -> DataFrame:
    """``value, next``: the next larger of the distinct ``values`` (one bigint column; after the last the first).

    Values are ordered within ranges; where a range ends, the next range begins.
    Ranges are found in the same way over ever coarser ones, until there are at
    most ``TOP`` of them, so no task orders more.
    """
    at = values.toDF("value").withColumn("up", F.floor(F.col("value") / F.lit(LEVEL)).cast("bigint"))
    ups = at.groupBy("up").agg(F.min("value").alias("first"))
    if ups.limit(TOP + 1).count() <= TOP:
        after = ups.select("up", F.coalesce(F.lead("first").over(W.orderBy("up")), F.min("first").over(W.partitionBy())).alias("after"))
    else:
        above = following(ups.select("up")).select(F.col("value").alias("up"), F.col("next").alias("next_up"))
        after = above.join(ups.select(F.col("up").alias("next_up"), F.col("first").alias("after")), "next_up").select("up", "after")
    return at.join(after, "up").select("value", F.coalesce(F.lead("value").over(W.partitionBy("up").orderBy("value")), "after").alias("next"))


def with_next(docs: DataFrame, order: list[str], carried: list[str], bucket: int = BUCKET) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows it by ``order`` (a bigint column first; after the last the first).

    Rows are dealt by ranges of the first order column, so no task holds more
    than one range; only the first rows of ranges travel again, to the range
    before theirs, found by ``following``.
    """
    key = order[0]
    place = F.coalesce(F.floor(F.col(key) / F.lit(bucket)), F.lit(-(1 << 62))).cast("bigint")
    dealt = docs.select(*dict.fromkeys([*order, *carried]), place.alias("_at")).repartition("_at")
    asc = [F.col(c).asc_nulls_first() for c in order]
    w = W.partitionBy("_at").orderBy(*asc)
    inside = dealt.withColumns({f"_n_{c}": F.lead(F.struct(c)).over(w) for c in carried} | {"_k": F.row_number().over(w)})
    firsts = inside.filter("_k = 1").select("_at", *[F.struct(c).alias(f"_f_{c}") for c in carried])
    follow = following(dealt.select("_at").distinct()).withColumnRenamed("value", "_at").withColumnRenamed("next", "_next")
    edges = firsts.withColumnRenamed("_at", "_next").join(follow, "_next").drop("_next")
    joined = inside.join(edges, "_at", "left")
    return joined.select(*dict.fromkeys([*order, *carried]), *[F.coalesce(f"_n_{c}", f"_f_{c}")[c].alias(f"next_{c}") for c in carried])


def edited(text: Column, follower: Column) -> Column:
    """The text with its last quarter (code points, rounded down) replaced by as many first ones of its follower."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(follower, F.lit(1), quarter))


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    known = source.withColumn("fingerprint", fingerprint(F.col("text")))
    pairs = with_next(known, ["doc_id", "text"], ["text", "fingerprint"])
    made = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return made.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _sql_hashes(text: str) -> str:
    """Nested hashes of a text in DuckDB: (root, shown) as a struct."""
    section, paragraph, sentence = (p.replace("'", "''") for p in (SECTION, PARAGRAPH, SENTENCE))
    spans_ = f"list_transform(regexp_extract_all(p, '{sentence}'), lambda x: md5(x))"
    paragraph_ = f"list_transform(regexp_extract_all(s, '{paragraph}'), lambda p: {spans_})"
    return f"list_transform(regexp_extract_all({text}, '{section}'), lambda s: {paragraph_})"


def _sql_print(h: str) -> str:
    root_ = f"sha256(array_to_string(list_transform({h}, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))), ''))"
    shown = f"array_to_string(list_transform({h}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda x: left(x, 8)), '')), ',')), ';')"
    return f"{root_} || ':' || {shown}"


def _sql_near(one: str, other: str) -> str:
    return f"""(SELECT CASE WHEN {one} = {other} THEN 1.0 WHEN len(a) + len(b) = 0 THEN 1.0 ELSE
      2.0 * (head + least(back, n - head) + len(list_intersect(a[head + 1:len(a) - least(back, n - head)], b[head + 1:len(b) - least(back, n - head)]))) / (len(a) + len(b)) END
    FROM (SELECT *, coalesce(list_position(list_transform(range(n), lambda i: a[i + 1] = b[i + 1]), false) - 1, n) AS head,
                 coalesce(list_position(list_transform(range(n), lambda i: a[len(a) - i] = b[len(b) - i]), false) - 1, n) AS back
          FROM (SELECT a, b, least(len(a), len(b)) AS n FROM (SELECT regexp_extract_all(split_part({one}, ':', 2), '[0-9a-f]{{8}}') AS a, regexp_extract_all(split_part({other}, ':', 2), '[0-9a-f]{{8}}') AS b))))"""


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), nexts AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM docs WINDOW w AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edits AS (
  SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM nexts
), hashed AS (
  SELECT *, {_sql_hashes("text")} AS h, {_sql_hashes("edited")} AS eh, {_sql_hashes("next_text")} AS nh FROM edits
), prints AS (
  SELECT doc_id, text, edited, {_sql_print("h")} AS fingerprint, {_sql_print("eh")} AS edited_fingerprint, {_sql_print("nh")} AS next_fingerprint FROM hashed
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CAST({_sql_near("fingerprint", "edited_fingerprint")} AS DOUBLE) AS near_edited, CAST({_sql_near("fingerprint", "next_fingerprint")} AS DOUBLE) AS near_next
FROM prints
"""
