"""SQL text as DataFrame columns: comments and strings told apart from names, all inside the JVM.

The expressions read SQLite-style SQL (four ways of quoting a name, doubled quotes in strings) and also
text that breaks off: an unfinished comment, string or quoted name runs to the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT = r"--[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|$)"
STRING = r"'[^']*+(?:''[^']*+)*+(?:'|$)"
QUOTED = r'"[^"]*+(?:"|$)|`[^`]*+(?:`|$)|\[[^\]]*+(?:\]|$)'
BARE = r"[\p{L}_][\p{L}\p{N}_$]*+"
NUMBER = r"\d++(?:\.\d++)?(?:[eE][+-]?\d++)?"
NAME = f"(?:{BARE}|{QUOTED})"


def without_comments(sql: Column) -> Column:
    """``sql`` with each comment as one blank; comment marks in strings and quoted names stay."""
    return F.regexp_replace(sql, f"({STRING}|{QUOTED})|{COMMENT}", "$1 ")


def source_tables(sql: Column) -> Column:
    """Distinct names after FROM or JOIN: lower case, without quotes and schema prefix; [] for null."""
    # strings and quoted names are tokens of their own, so a FROM inside them starts nothing
    pattern = rf"(?i)\b(?:from|join)\s+{NAME}(?:\s*\.\s*{NAME})*|{STRING}|{QUOTED}|{BARE}"
    hits = F.filter(F.regexp_extract_all(without_comments(sql), F.lit(pattern), F.lit(0)), lambda t: t.rlike(rf"(?is)^(?:from|join)\s+."))
    last = F.transform(hits, lambda t: F.element_at(F.regexp_extract_all(F.regexp_replace(t, r"(?is)^(?:from|join)\s+", ""), F.lit(NAME), F.lit(0)), -1))
    plain = F.transform(last, lambda t: F.lower(F.trim(F.regexp_replace(t, r'^["`\[]|["`\]]$', ""))))
    return F.coalesce(F.array_distinct(F.filter(plain, lambda t: t != "")), F.array().cast("array<string>"))


def constants(sql: Column) -> Column:
    """The sorted set of constants: finished strings (lower case, trimmed) and numbers outside names,
    strings and comments; [] for null."""
    pattern = f"{COMMENT}|{STRING}|{QUOTED}|{BARE}|{NUMBER}"
    tokens = F.filter(F.regexp_extract_all(sql, F.lit(pattern), F.lit(0)), lambda t: t.rlike(r"(?s)^(?:'.*'|\d.*)$") & (t != "'"))
    plain = F.transform(tokens, lambda t: F.when(t.startswith("'"), F.lower(F.trim(t.substr(F.lit(2), F.length(t) - 2)))).otherwise(t))
    return F.coalesce(F.array_sort(F.array_distinct(plain)), F.array().cast("array<string>"))


def letter_words(text: Column, least: int = 3) -> Column:
    """Distinct longest runs of letters in the lower-cased text with at least ``least`` letters; [] for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))
