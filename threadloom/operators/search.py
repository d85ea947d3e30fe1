"""Full-text search: query language, BM25 over one or two corpora, snippets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import accent_map, col, search_tokens, utc_minute

#: BM25's constants, and the idf of terms that half of all texts have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DEFAULT_LIMIT = 20


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; the last may be a prefix, and ``first`` ones stand at the beginning of a text."""

    tokens: tuple[str, ...]
    prefix: bool = False
    first: bool = False

    def fits(self, k: int, token: Column) -> Column:
        """Whether a token is the phrase's ``k``-th."""
        word = self.tokens[k]
        return token.startswith(word) if self.prefix and k == len(self.tokens) - 1 else token == word

    def starts(self, doc: Column) -> Column:
        """Places (from 0) of a token array at which the phrase begins; null if it is no text's."""
        m = len(self.tokens)
        at = F.array(F.lit(0)) if self.first else F.sequence(F.lit(0), F.greatest(F.size(doc) - m, F.lit(0)))

        def here(i: Column) -> Column:
            out = F.size(doc) >= m
            for k in range(m):
                out = out & F.coalesce(self.fits(k, F.get(doc, i + k)), F.lit(False))
            return out

        present = F.lit(True)
        for word in set(self.tokens[:-1] if self.prefix else self.tokens):
            present = present & F.array_contains(doc, word)
        return F.when(present, F.filter(at, here))

    def count(self, doc: Column) -> Column:
        """Occurrences in a token array."""
        if len(self.tokens) == 1 and not self.first:
            return F.size(F.filter(doc, lambda t: self.fits(0, t)))
        return F.coalesce(F.size(self.starts(doc)), F.lit(0))


def near_counts(phrases: list[Phrase], starts: list[Column], distance: int) -> list[Column]:
    """Occurrences of each phrase that stand in a group of all of them: the last begins at most ``distance`` tokens after the end of the first."""
    places = [F.coalesce(s, F.array().cast("array<int>")) for s in starts]
    within = lambda k, begin, at: (at >= begin) & (at <= begin + len(phrases[k].tokens) + distance)

    def begins(k: int) -> Column:
        def whole(begin: Column) -> Column:
            out = F.lit(True)
            for other in range(len(phrases)):
                if other != k:
                    out = out & F.exists(places[other], lambda at: within(k, begin, at))
            return out

        return F.filter(places[k], whole)

    groups = [begins(k) for k in range(len(phrases))]

    def inside(at: Column) -> Column:
        out = F.lit(False)
        for k in range(len(phrases)):
            out = out | _reached(groups[k], at, lambda begin, at, k=k: within(k, begin, at))
        return out

    return [F.size(F.filter(p, inside)) for p in places]


def _reached(begins: Column, at: Column, test: Callable[[Column, Column], Column]) -> Column:
    return F.exists(begins, lambda begin: test(begin, at))


@dataclass
class Query:
    """A tree over phrases: ('phrase', n), ('near', [n, ...], distance), ('none',), ('and' | 'or' | 'not', left, right)."""

    tree: tuple | None
    phrases: list[Phrase] = field(default_factory=list)

    def groups(self) -> list[tuple[list[int], int]]:
        def walk(node: tuple) -> Iterator[tuple[list[int], int]]:
            if node[0] == "near":
                yield node[1], node[2]
            elif node[0] in ("and", "or", "not"):
                yield from walk(node[1])
                yield from walk(node[2])

        return list(walk(self.tree)) if self.tree else []

    def counts(self, doc: Column) -> list[Column]:
        """Occurrences of each phrase in a token array; those of a NEAR group only where the group stands. Then, for each of a group, all of its occurrences, which decide how many texts have it."""
        out = [p.count(doc) for p in self.phrases]
        own_all = [out[k] for k in self.grouped()]
        for members, distance in self.groups():
            own = [self.phrases[k] for k in members]
            for k, n in zip(members, near_counts(own, [p.starts(doc) for p in own], distance), strict=True):
                out[k] = n
        return out + own_all

    def grouped(self) -> list[int]:
        return [k for members, _ in self.groups() for k in members]

    def texts_with(self, counts: list[Column]) -> list[Column]:
        """Number of rows that have each phrase, from columns as ``counts`` gives them."""
        n = len(self.phrases)
        every = list(counts[:n])
        for at, k in enumerate(self.grouped()):
            every[k] = counts[n + at]
        return [F.count_if(c > 0).alias(f"df{k}") for k, c in enumerate(every)]

    def matches(self, counts: list[Column]) -> Column:
        def walk(node: tuple) -> Column:
            if node[0] == "phrase":
                return counts[node[1]] > 0
            if node[0] == "near":
                return counts[node[1][0]] > 0
            if node[0] == "none":
                return F.lit(False)
            left, right = walk(node[1]), walk(node[2])
            return left & right if node[0] == "and" else left | right if node[0] == "or" else left & ~right

        return walk(self.tree) if self.tree else F.lit(False)


def tokens_of(text: str) -> tuple[str, ...]:
    """The same tokens as of stored texts."""
    table = str.maketrans(*accent_map())
    return tuple(re.findall(r"[^\W_]+", text.lower().translate(table)))


LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*?)|([(){}^,:+-])|([^\s(){}^,:+"-]+))')
#: The one column of a text, and the tokens between the ends of a NEAR group without a number.
COLUMN, NEAR = "content", 10


def parse(text: str) -> Query:
    """Words are joined by AND unless OR or NOT stands between them; quoted phrases (parts joined by +), prefixes
    with *, ^ before what begins a text, NEAR(a b, n), column filters (``content : a``, ``- content : a``), and brackets.

    A text that is not well-formed counts as the AND of its tokens.
    """
    try:
        return _Parser(text).query()
    except ValueError:
        phrases = [Phrase((t,)) for t in tokens_of(text)]
        tree: tuple | None = None
        for k in range(len(phrases)):
            tree = ("phrase", k) if tree is None else ("and", tree, ("phrase", k))
        return Query(tree, phrases)


class _Parser:
    """Precedence rises from OR over AND (written or not) to NOT."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = LEXEME.match(text, at)
            if not m:
                raise ValueError(text)
            quoted, star, bracket, word = m.groups()
            if quoted is not None:
                self.items.append(("phrase*" if star else "phrase", quoted))
            elif bracket:
                self.items.append((bracket, bracket))
            elif word == "NEAR" and text[m.end() : m.end() + 1] == "(":
                self.items.append((word, word))
            elif word in ("AND", "OR", "NOT"):
                self.items.append((word, word))
            elif re.fullmatch(r"\w+\*?", word):
                self.items.append(("phrase*" if word.endswith("*") else "phrase", word.rstrip("*")))
            else:
                raise ValueError(word)
            at = m.end()
        self.at, self.phrases = 0, []

    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else ""

    def query(self) -> Query:
        tree = self.either()
        if self.at < len(self.items):
            raise ValueError("rest")
        return Query(tree, self.phrases)

    def either(self) -> tuple:
        out = self.both()
        while self.kind() == "OR":
            self.at += 1
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.without()
        while self.kind() in ("AND", "phrase", "phrase*", "(", "^", "{", "-", "NEAR"):
            self.at += self.kind() == "AND"
            out = ("and", out, self.without())
        return out

    def without(self) -> tuple:
        out = self.single()
        while self.kind() == "NOT":
            self.at += 1
            out = ("not", out, self.single())
        return out

    def take(self, kind: str) -> None:
        if self.kind() != kind:
            raise ValueError(kind)
        self.at += 1

    def column(self) -> bool | None:
        """A column filter, if one stands here: whether it holds for the texts' column."""
        begin, other = self.at, self.kind() == "-"
        self.at += other
        names = []
        if self.kind() == "{":
            self.at += 1
            while self.kind() == "phrase":
                names.append(self.items[self.at][1])
                self.at += 1
            self.take("}")
        elif self.kind() == "phrase":
            names.append(self.items[self.at][1])
            self.at += 1
        if self.kind() != ":" or not names:
            if other or begin < len(self.items) and self.items[begin][0] == "{":
                raise ValueError("column")
            self.at = begin
            return None
        self.at += 1
        if any(n.lower() != COLUMN for n in names):
            raise ValueError("no such column")
        return not other

    def single(self) -> tuple:
        if (holds := self.column()) is not None:
            kept = len(self.phrases)
            out = self.single()
            if not holds:
                del self.phrases[kept:]
                return ("none",)
            return out
        kind = self.kind()
        if kind == "(":
            self.at += 1
            out = self.either()
            self.take(")")
            return out
        if kind == "NEAR":
            return self.near()
        return ("phrase", self.phrase())

    def near(self) -> tuple:
        self.at += 2
        members, distance = [], NEAR
        while self.kind() in ("phrase", "phrase*", "^"):
            members.append(self.phrase())
        if self.kind() == ",":
            self.at += 1
            if self.kind() != "phrase" or not self.items[self.at][1].isdigit():
                raise ValueError("NEAR")
            distance = int(self.items[self.at][1])
            self.at += 1
        self.take(")")
        if not members:
            raise ValueError("NEAR")
        return ("near", members, distance) if len(members) > 1 else ("phrase", members[0])

    def phrase(self) -> int:
        first = self.kind() == "^"
        self.at += first
        tokens: tuple[str, ...] = ()
        while True:
            kind = self.kind()
            if not kind.startswith("phrase"):
                raise ValueError(kind)
            tokens += tokens_of(self.items[self.at][1])
            self.at += 1
            if self.kind() != "+" or kind == "phrase*":
                break
            self.at += 1
        if not tokens:
            raise ValueError("empty phrase")
        self.phrases.append(Phrase(tokens, kind == "phrase*", first))
        return len(self.phrases) - 1


def scored(rows: DataFrame, q: Query) -> DataFrame:
    """``rank`` of matching rows, the negative BM25 score, from the columns ``_dl``, ``_tf0``... and the struct ``_s`` of statistics."""
    score = F.lit(0.0)
    for k in range(len(q.phrases)):
        tf, df = F.col(f"_tf{k}").cast("double"), F.col(f"_s.df{k}")
        idf = F.ln((F.col("_s.n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_s.avgdl")))).otherwise(0.0)
    return rows.withColumn("rank", -score).drop("_dl", "_s", *[f"_tf{k}" for k in range(len(q.phrases) + len(q.grouped()))])


def ranked(docs: DataFrame, query: str, text_col: str = "content") -> DataFrame:
    """Matching rows of ``docs`` with ``rank``, the negative BM25 score: the best is smallest.

    Statistics are over all of ``docs``; narrow the result down afterwards.
    One pass counts each phrase in each text, another aggregates the counts to
    one row; there is no shuffle of texts or postings.
    """
    q = parse(query)
    # a lambda binds the tokens, so they are made once for each text whatever asks for them
    counts = F.transform(F.array(search_tokens(text_col)), lambda d: F.array(F.size(d), *q.counts(d)))[0]
    tokens = docs.withColumn("_counts", counts)
    n = len(q.phrases) + len(q.grouped())
    counted = tokens.withColumns({"_dl": F.col("_counts")[0]} | {f"_tf{k}": F.col("_counts")[k + 1] for k in range(n)}).drop("_counts")
    stats = counted.agg(F.struct(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *q.texts_with([F.col(f"_tf{k}") for k in range(n)])).alias("s")).scalar()
    return scored(counted.filter(q.matches([F.col(f"_tf{k}") for k in range(len(q.phrases))])).withColumn("_s", stats), q)


def top(found: DataFrame, limit: int = DEFAULT_LIMIT, per: str | None = None, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The best ``limit`` rows, of all or of each value of ``per``."""
    if per is None:
        return found.orderBy("rank", *ties).limit(limit)
    return found.withColumn("_k", F.row_number().over(W.partitionBy(per).orderBy("rank", *ties))).filter(F.col("_k") <= limit).drop("_k")


def search_all(messages: DataFrame, summaries: DataFrame, query: str, kind: str = "all", limit: int = DEFAULT_LIMIT, per: str | None = None) -> DataFrame:
    """``type, id, conversation_id, rank`` over messages and summaries; of equal ranks messages come first."""
    parts = []
    for name, df in (("message", messages), ("summary", summaries)):
        if kind in ("all", name):
            parts.append(ranked(df, query).select(F.lit(name).alias("type"), "id", "conversation_id", "rank"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return top(found, limit, per, ("type", "id"))


def relevance(found: DataFrame, per: str = "conversation_id") -> DataFrame:
    """``score`` from 0 to 1 within each ``per``: the best rank 1, the worst 0; all 1 if they are equal."""
    w = W.partitionBy(per)
    worst, best = F.max("rank").over(w), F.min("rank").over(w)
    return found.withColumn("score", F.when(worst == best, 1.0).otherwise(F.least(F.greatest((worst - F.col("rank")) / (worst - best), F.lit(0.0)), F.lit(1.0))))


def snippet(text: Column | str, query: str, words: int = 10) -> Column:
    """About ``words`` words around the first match, cut ends with '...'; words of a whole phrase are marked with <b>."""
    q = parse(query)
    plain, ascii_ = accent_map()
    shown_words = F.split(F.trim(F.regexp_replace(col(text), r"\s+", " ")), " ")
    norm = lambda w: F.regexp_replace(F.translate(F.lower(w), plain, ascii_), r"[^\p{L}\p{N}]+", " ")

    def made(parts: Column) -> Column:
        # tokens with the place of the word that each comes from
        owned = F.flatten(F.transform(parts, lambda w, i: F.transform(F.filter(F.split(norm(w), " "), lambda t: t != ""), lambda t: F.struct(t.alias("t"), i.alias("i")))))

        def marked(tokens: Column) -> Column:
            doc = F.transform(tokens, lambda x: x["t"])
            hits = [F.array().cast("array<int>")]
            for p in q.phrases:
                own = F.coalesce(p.starts(doc), F.array().cast("array<int>"))
                hits.append(F.flatten(F.transform(own, _span(len(p.tokens)))))
            places = F.flatten(F.array(*hits))
            return F.array_distinct(F.transform(places, lambda k: F.get(tokens, k)["i"]))

        return F.struct(parts.alias("parts"), marked(owned).alias("hits"))

    def windowed(x: Column) -> Column:
        parts, hits = x["parts"], x["hits"]
        start = F.greatest(F.lit(1), F.least(F.array_min(hits) - 1, F.size(parts) - words + 1))
        shown = F.transform(F.slice(parts, start, F.lit(words)), lambda w, i: F.when(F.array_contains(hits, start + i - 1), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
        return F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(start + words <= F.size(parts), "...").otherwise(""))

    # lambdas bind the words and the hits, so each is made once
    return F.transform(F.transform(F.array(shown_words), made), windowed)[0]


def _span(n: int) -> Callable[[Column], Column]:
    return lambda start: F.sequence(start, start + (n - 1))


def report(tables: dict[str, DataFrame], query: str, kind: str = "all", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``conversation_id, text``: the search tool's answer for each conversation, the best hits with what they stand in."""
    every = tables["messages"].select("conversation_id").unionByName(tables["summaries"].select("conversation_id")).distinct()
    if not query.strip():
        return every.withColumn("text", F.lit("Error: query cannot be empty"))
    hits = search_all(tables["messages"], tables["summaries"], query, {"messages": "message", "summaries": "summary"}.get(kind, "all"), limit, "conversation_id")
    num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    m = tables["messages"].select(F.lit("message").alias("type"), "id", F.concat(F.lit("[Message #"), num("sequence_number"), F.lit(" | "), F.col("role"), F.lit(" | "), utc_minute("created_at"), F.lit("]")).alias("head"), "content")
    covered = tables["summary_messages"].join(tables["messages"].select(F.col("id").alias("message_id"), "sequence_number"), "message_id").groupBy(F.col("summary_id").alias("id")).agg(F.min("sequence_number").alias("lo"), F.max("sequence_number").alias("hi"))
    head = F.concat(F.lit("[Summary depth="), num("depth"), F.lit(" | covers #"), num("lo"), F.lit("-"), num("hi"), F.lit(" | "), utc_minute("created_at"), F.lit("]"))
    s = tables["summaries"].join(covered, "id", "left").select(F.lit("summary").alias("type"), "id", head.alias("head"), "content")
    shown = hits.join(m.unionByName(s), ["type", "id"]).withColumn("line", F.concat(F.col("head"), F.lit("\n"), snippet("content", query)))
    lines = shown.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", "id", "line"))), lambda x: x["line"]).alias("lines"))
    none = F.lit(f"No results found for '{query}'. Try different search terms.")
    return every.join(lines, "conversation_id", "left").select("conversation_id", F.coalesce(F.array_join("lines", "\n\n"), none).alias("text"))
