"""Scores of model answers as columns: format, text match, table use, correction. Null answers score as blank ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.text import matches

# SQL words that are no identifiers of a schema.
SQL_WORDS = (
    "SELECT FROM WHERE AND OR JOIN ON LEFT RIGHT INNER OUTER GROUP BY ORDER ASC DESC HAVING LIMIT DISTINCT AS IN NOT NULL IS LIKE "
    "BETWEEN CASE WHEN THEN ELSE END COUNT SUM AVG MAX MIN CAST UNION ALL EXISTS INSERT UPDATE DELETE INTO VALUES SET CREATE TABLE "
    "DROP ALTER INDEX TRUE FALSE OFFSET EXCEPT INTERSECT"
).split()
BLOCK = r"(?is)```sql\s*(.+?)\s*```"
FULL = r"(?is)<think>.*?</think>\s*```sql\s*.+?\s*```"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def block(answer: Column) -> Column:
    """The first ```sql block, '' without one."""
    return F.trim(F.regexp_extract(text(answer), BLOCK, 1))


def count(c: Column, part: str) -> Column:
    return F.regexp_count(text(c), F.lit(part))


def format_exact(answer: Column) -> Column:
    return F.when(text(answer).rlike(FULL), 3.0).otherwise(0.0)


def format_parts(answer: Column) -> Column:
    """Half a point for one think end, one SQL block and one closing fence each; more than one costs."""
    think, opened = count(answer, "</think>"), count(answer, "```sql")
    closed = count(answer, "```") - opened
    part = lambda n, one, many: F.when(n == 1, one).when(n > 1, many).otherwise(0.0)
    return part(think, 0.5, -1.0) + part(opened, 0.5, -1.0) + part(closed, 0.5, -0.5)


def text_match(answer: Column, gold: Column) -> Column:
    """5 for the same text, 3.5 without case, else by the share of gold words found; -2 without a block."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    p, g = block(answer), F.trim(text(gold))
    share = F.size(F.array_intersect(words(g), words(p))) / F.greatest(F.size(words(g)), F.lit(1))
    return F.when(p == "", -2.0).when(p == g, 5.0).when(F.lower(p) == F.lower(g), 3.5).when(share > 0.7, 1.5).when(share > 0.4, 0.5).otherwise(-1.5)


def tables_valid(answer: Column, tables: Column) -> Column:
    """2 where the block reads only given tables (lower case), -0.5 for each other one; 0 without a block or table."""
    used = F.array_distinct(matches(F.lower(block(answer)), r"\b(?:from|join)\s+([a-z0-9_]+)", 1))
    bad = F.size(F.array_except(used, tables))
    return F.when(F.size(used) == 0, 0.0).when(bad == 0, 2.0).otherwise(-0.5 * bad)


def sql_kind(sql: Column) -> Column:
    """1 for SELECT (or WITH), 0.5 for other text, 0 for blank."""
    s = F.upper(F.trim(text(sql)))
    return F.when(s == "", 0.0).when(s.rlike(r"^(SELECT|WITH)\b"), 1.0).otherwise(0.5)


def schema_use(sql: Column, context: Column) -> Column:
    """Share of the statement's identifiers that occur in the context; 1 without identifiers, 0 where either is blank."""
    found = F.filter(F.array_distinct(matches(F.upper(sql), r"\b([A-Z_][A-Z0-9_]*)\b", 1)), lambda x: ~x.isin(*SQL_WORDS))
    up = F.upper(text(context))
    hit = F.size(F.filter(found, lambda x: up.contains(x)))
    return F.when((F.trim(text(sql)) == "") | (F.trim(text(context)) == ""), 0.0).when(F.size(found) == 0, 1.0).otherwise(hit / F.size(found))


def reasoning_use(reasoning: Column, context: Column) -> Column:
    """Share of the context's tables that the reasoning names; 0.3 for no reasoning, 0.5 for no tables."""
    tables = F.array_distinct(matches(F.upper(context), r"TABLE\s+([A-Z0-9_]+)", 1))
    up = F.upper(text(reasoning))
    return F.when(F.trim(up) == "", 0.3).when(F.size(tables) == 0, 0.5).otherwise(F.size(F.filter(tables, lambda t: up.contains(t))) / F.size(tables))


def composite(execution: Column, form: Column, schema: Column, reasoning: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * execution + 0.2 * form + 0.15 * schema + 0.15 * reasoning))


def improvement(answer: Column, gold: Column, wrong: Column) -> Column:
    """4 for a right correction, 2 for a changed statement, -1 for none."""
    p, w = block(answer), F.trim(text(wrong))
    right = F.lower(p) == F.lower(F.trim(text(gold)))
    return F.when((p == "") | (p == w), -1.0).when(right, 4.0).otherwise(2.0)


def error_addressed(answer: Column, kind: Column) -> Column:
    p = block(answer)
    select, words = F.upper(p).startswith("SELECT"), F.size(F.split(p, r"\s+"))
    return (
        F.when(p == "", 0.0).when(kind == "syntax_error", F.when(sql_kind(p) == 1.0, 1.5).otherwise(0.5))
        .when(kind.isin("no_such_table", "no_such_column"), F.when(select, 1.0).otherwise(0.3))
        .when(kind.isin("wrong_result", "empty_result", "execution_error"), F.when(select & (words > 3), 0.5).otherwise(0.0)).otherwise(0.3)
    )
