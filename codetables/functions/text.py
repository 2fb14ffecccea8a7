"""Text columns: lines, clipping, citations, highlighting, tolerant JSON, cleaned answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\n|\r"


def lines(text: Column) -> Column:
    """Lines of a text; a final break adds none, an empty or null text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), LINE_BREAK, -1))


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def decoded(content: Column) -> Column:
    """Bytes as text; invalid UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def clip(text: Column, n: int) -> Column:
    """At most n characters, and how many more there were."""
    text = F.coalesce(text, F.lit(""))
    more = F.concat(F.substring(text, 1, n), F.lit("\n["), (F.length(text) - n).cast("string"), F.lit(" characters left out]"))
    return F.when(F.length(text) <= n, text).otherwise(more)


def citation(path: Column, start: Column, end: Column, kind: Column, name: Column) -> Column:
    """path:start-end [kind name]"""
    place = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(name.isNotNull(), F.concat(place, F.lit(" ["), F.coalesce(kind, F.lit("")), F.lit(" "), name, F.lit("]"))).otherwise(place)


def embedding_text(path: Column, kind: Column, name: Column, start: Column, end: Column, content: Column) -> Column:
    """Header that says where a chunk comes from, an empty line, the chunk."""
    span = F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))
    symbol = F.concat(F.lit("# symbol: "), kind, F.lit(" "), name, F.lit(" ("), span, F.lit(")"))
    return F.concat(F.lit("# file: "), path, F.lit("\n"), F.when(name.isNotNull(), symbol).otherwise(F.concat(F.lit("# section: "), span)), F.lit("\n\n"), content)


def query_terms(query: Column) -> Column:
    """Distinct words of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.trim(query), r"\s+"), lambda w: F.length(w) >= 2))


def highlight(content: Column, query: Column) -> Column:
    """Every term of the query marked, whatever its case."""
    escaped = F.transform(query_terms(query), lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)("), F.array_join(escaped, "|"), F.lit(")"))
    return F.when(F.size(escaped) > 0, F.regexp_replace(content, pattern, F.lit("<mark>$1</mark>"))).otherwise(content)


def id_list(raw: Column) -> Column:
    """Parts of a comma-separated list, blank ones dropped."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")


def json_object(text: Column) -> Column:
    """The JSON object in a text, as text: in a fence, or all of it, or from the first brace to the last; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = F.array(fenced, F.trim(text), braces)
    return F.get(F.filter(tries, lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull()), F.lit(0))


def clean_answer(answer: Column, marker: str = "<|tool_calls") -> Column:
    """Model text up to a leaked tool-call marker, control tokens removed, trimmed."""
    return F.trim(F.regexp_replace(F.substring_index(answer, marker, 1), r"<\|[^|>]*\|>", ""))
