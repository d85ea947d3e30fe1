"""A stored full-text index: postings with positions, kept in a ``Store``; searches read only their terms' rows.

Postings are written in the order of terms, so the files' statistics leave few
row groups for a term; those of a very common term spread over several files.
Rows carry the text's length, so a search joins nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import search_tokens
from threadloom.operators import search
from threadloom.sources.model import Store

POSTINGS, LENGTHS = "postings", "text_lengths"


def postings(kind: str, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of texts (id, conversation_id, content)."""
    tokens = docs.select(F.lit(kind).alias("kind"), "id", "conversation_id", search_tokens("content").alias("tokens")).withColumn("length", F.size("tokens"))
    words = tokens.select("kind", "id", "conversation_id", "length", F.posexplode("tokens").alias("at", "term"))
    rows = words.groupBy("term", "kind", "id", "conversation_id", "length").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), tokens.select("kind", "id", "conversation_id", "length")


def insert(store: Store, kind: str, docs: DataFrame) -> None:
    """Index texts whose ids are not indexed yet."""
    known = store.read(LENGTHS).filter(F.col("kind") == kind).select("id")
    rows, lengths = postings(kind, docs.dropDuplicates(["id"]).join(known, "id", "left_anti"))
    store.commit(more={POSTINGS: rows, LENGTHS: lengths})


def rebuild(store: Store, messages: DataFrame, summaries: DataFrame) -> None:
    """The whole index anew."""
    (m, m_len), (s, s_len) = postings("message", messages), postings("summary", summaries)
    rows = m.unionByName(s).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    store.commit({POSTINGS: rows, LENGTHS: m_len.unionByName(s_len)})


def ranked(index: DataFrame, lengths: DataFrame, kind: str, query: str) -> DataFrame:
    """``type, id, conversation_id, rank`` as ``search.ranked`` gives it over the texts."""
    q = search.parse(query)
    wanted = [(p, k) for p in q.phrases for k in range(len(p.tokens))]
    conditions = [p.fits(k, F.col("term")) for p, k in wanted]
    rows = index.filter(F.col("kind") == kind).filter(reduce(lambda a, b: a | b, conditions, F.lit(False)))
    places = rows.groupBy("id", "conversation_id", "length").agg(*[F.flatten(F.collect_list(F.when(c, F.col("positions")))).alias(f"_p{n}") for n, c in enumerate(conditions)])
    starts, n = [], 0
    for p in q.phrases:
        own = F.col(f"_p{n}")
        for k in range(1, len(p.tokens)):
            own = F.array_intersect(own, _shifted(F.col(f"_p{n + k}"), k))
        starts.append(F.filter(own, lambda at: at == 0) if p.first else own)
        n += len(p.tokens)
    counts = [F.size(s) for s in starts] + [F.size(starts[k]) for k in q.grouped()]
    for members, distance in q.groups():
        near = search.near_counts([q.phrases[k] for k in members], [starts[k] for k in members], distance)
        for k, c in zip(members, near, strict=True):
            counts[k] = c
    counted = places.select("id", "conversation_id", F.col("length").alias("_dl"), *[c.alias(f"_tf{k}") for k, c in enumerate(counts)])
    size = lengths.filter(F.col("kind") == kind).agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("avgdl")).alias("s")).scalar()
    df = counted.agg(F.struct(F.lit(0).alias("none"), *q.texts_with([F.col(f"_tf{k}") for k in range(len(counts))])).alias("s")).scalar()
    matched = counted.filter(q.matches([F.col(f"_tf{k}") for k in range(len(counts))])).withColumns({"_n": size, "_df": df})
    stats = F.struct(F.col("_n.n").alias("n"), F.col("_n.avgdl").alias("avgdl"), *[F.col(f"_df.df{k}").alias(f"df{k}") for k in range(len(q.phrases))])
    return search.scored(matched.withColumn("_s", stats).drop("_n", "_df"), q).select(F.lit(kind).alias("type"), "id", "conversation_id", "rank")


def _shifted(places: F.Column, by: int) -> F.Column:
    return F.transform(places, lambda at: at - by)


def search_all(store: Store, query: str, kind: str = "all", limit: int = search.DEFAULT_LIMIT, per: str | None = None) -> DataFrame:
    """``type, id, conversation_id, rank``: as ``search.search_all``, from the stored index."""
    index, lengths = store.read(POSTINGS), store.read(LENGTHS)
    parts = [ranked(index, lengths, name, query) for name in ("message", "summary") if kind in ("all", name)]
    return search.top(reduce(DataFrame.unionByName, parts), limit, per, ("type", "id"))


def indexed_ids(store: Store) -> DataFrame:
    """``id, conversation_id`` of all that is indexed, for ``integrity.index_mismatches``."""
    return store.read(LENGTHS).select("id", "conversation_id")
