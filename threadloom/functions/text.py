"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a token stands for, and the accepted roles.
CHARS_PER_TOKEN = 3.5
ROLES = ("user", "assistant", "system", "tool")
#: The characters that trimming takes off.
BLANK = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def estimate_tokens(text: Column | str) -> Column:
    """Estimated tokens of a text: code points by 3.5, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(col(text)) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("int")


def is_over_budget(tokens: Column | str, budget: int) -> Column:
    return col(tokens) > F.lit(budget)


def split_by_budget(text: Column | str, budget: int) -> Column:
    """struct<head, tail>: the longest prefix within a token budget and the rest."""
    n = int(CHARS_PER_TOKEN * max(budget, 0))
    return F.struct(F.substring(col(text), 1, n).alias("head"), F.substring(col(text), F.lit(n + 1), F.length(col(text))).alias("tail"))


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(col(text), f"^[{BLANK}]+", ""), f"[{BLANK}]+$", "")


def parse_parts(content: Column | str) -> Column:
    """array<struct<type, content>> of a structured message; plain text is one text part.

    Elements of a JSON array count if they are objects whose type is a string
    that is not empty and whose content (or else whose text) is a string; others
    are left out one by one. A text without any such element is plain.
    """
    items = F.try_variant_get(F.try_parse_json(col(content)), "$", "array<variant>")

    def string_at(item: Column, name: str) -> Column:
        value = F.try_variant_get(item, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))

    read = F.transform(items, lambda i: F.struct(F.nullif(string_at(i, "type"), F.lit("")).alias("type"), F.coalesce(string_at(i, "content"), string_at(i, "text")).alias("content")))
    parts = F.filter(read, lambda p: p["type"].isNotNull() & p["content"].isNotNull())
    plain = F.array(F.struct(F.lit("text").alias("type"), col(content).alias("content")))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, parts).otherwise(plain)


def join_parts(parts: Column | str) -> Column:
    """Trimmed, non-empty part contents, parted by blank lines."""
    return F.array_join(F.filter(F.transform(col(parts), lambda p: trimmed(p["content"])), lambda t: F.length(t) > 0), "\n\n")


#: What stands for parts of a host message.
STEP_STARTED, COMPACTED, COMPACTED_BY_ITSELF = "[Step started]", "[Compaction]", "[Automatic compaction]"


def stringify_unknown(json: Column | str, path: str) -> Column:
    """The value at a path of a JSON text: a string as it is, any other as JSON; 'null' if there is none."""
    return F.coalesce(F.get_json_object(col(json), path), F.lit("null"))


def host_part_text(part: Column | str) -> Column:
    """Text of one host part, given as JSON: one rendering for each of the twelve types, empty for others."""
    at = lambda path: F.get_json_object(col(part), f"$.{path}")
    text = lambda path: F.coalesce(at(path), F.lit(""))
    lines = lambda *rows: F.array_join(F.filter(F.array(*rows), lambda x: F.length(x) > 0), "\n")
    status = at("state.status")
    end = F.when(status == "completed", F.concat(F.lit("Output: "), text("state.output"))).when(status == "error", F.concat(F.lit("Error: "), text("state.error"))).otherwise("")
    tool = lines(F.concat(F.lit("[Tool "), text("tool"), F.lit("]")), F.concat(F.lit("Input: "), stringify_unknown(part, "$.state.input")), end)
    files = F.array_join(F.from_json(at("files"), "array<string>"), "\n")
    by_type = {
        "text": text("text"),
        "reasoning": text("text"),
        "file": F.coalesce(at("source.text.value"), at("filename"), text("url")),
        "tool": tool,
        "subtask": F.concat(text("description"), F.lit("\n"), text("prompt")),
        "step-start": F.coalesce(at("snapshot"), F.lit(STEP_STARTED)),
        "step-finish": lines(text("reason"), text("snapshot")),
        "snapshot": text("snapshot"),
        "patch": F.concat(F.lit("Patch "), text("hash"), F.lit("\n"), F.coalesce(files, F.lit(""))),
        "agent": F.coalesce(at("source.value"), text("name")),
        "retry": F.concat(F.lit("Retry "), text("attempt"), F.lit(": "), text("error.data.message")),
        "compaction": F.when(at("auto") == "true", COMPACTED_BY_ITSELF).otherwise(COMPACTED),
    }
    out = F.lit("")
    for kind, value in by_type.items():
        out = F.when(at("type") == kind, value).otherwise(out)
    return out


#: Where a large text names its file. A tag, a comment at the head of a code block, and the end of a path.
FILE_TAG = rf'<file[{BLANK}]+path="([^"]+)"'
CODE_COMMENT = rf"```[^\n]*\n//[{BLANK}]*(?:path:[{BLANK}]*)?([^{BLANK}]+\.[a-zA-Z0-9]+)"
EXTENSION = r"\.[a-zA-Z0-9]{1,10}\z"


def detect_path(text: Column | str) -> Column:
    """A file path that a large text names: a file tag, a code block's first comment, or a first line without blanks that looks like one; null if none."""
    t = col(text)
    named = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (FILE_TAG, CODE_COMMENT)]
    first = trimmed(F.substring_index(t, "\n", 1))
    looks = ~first.contains(" ") & (first.contains("/") | first.contains("\\")) & first.rlike(EXTENSION)
    return F.coalesce(*named, F.when(looks, first))


def escape_xml(text: Column | str) -> Column:
    out = col(text)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def accent_map() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if b.isascii() and a != b]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def search_tokens(text: Column | str) -> Column:
    """array<string>: runs of letters and digits, lower-case, without diacritics."""
    plain, ascii_ = accent_map()
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(col(text), F.lit(""))), plain, ascii_), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def iso_from_millis(millis: Column | str) -> Column:
    """ISO-8601 text in UTC, with milliseconds, of milliseconds since 1970."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(col(millis)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_minute(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm")


def summary_as_message(s: Column) -> Column:
    """A summary struct (depth, token_count, covers, created_at, content) as a tagged block; content is not escaped."""
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), escape_xml(value.cast("string")), F.lit('"'))
    return F.concat(F.lit("<context_summary"), attr("depth", s["depth"]), attr("tokens", s["token_count"]), attr("covers_messages", s["covers"]), attr("created", F.date_format(s["created_at"], "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(">\n"), s["content"], F.lit("\n</context_summary>"))


def covered_label(ids: Column | str) -> Column:
    """Label of covered message ids: a numeric range, one number, or a count."""
    i = col(ids)
    n = F.coalesce(F.size(i), F.lit(0))
    numeric = F.forall(i, lambda x: x.rlike(r"^-?[0-9]+$"))
    nums = F.transform(i, lambda x: F.try_to_number(x, F.lit("S999999999999999999")).cast("bigint"))
    span = F.when(F.array_min(nums) == F.array_max(nums), F.array_min(nums).cast("string")).otherwise(F.concat_ws("-", F.array_min(nums).cast("string"), F.array_max(nums).cast("string")))
    return F.when(n == 0, "0 messages").when(numeric, span).otherwise(F.concat(n.cast("string"), F.lit(" messages")))
