"""Records for training: prompts with answers, preferences, corrections, and the schema that a statement needs. Built-in expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions import text as T

# The layout of a prompt and of answers.
PROMPT = ("Given the database schema below, generate SQL to answer the question.\n\nSchema:\n", "\n\nQuestion: ")
BLOCK = ("```sql\n", "\n```")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), _text(context), F.lit(PROMPT[1]), _text(question))


def sft(context: Column, question: Column, sql: Column) -> Column:
    """struct(instruction, response) with the statement alone."""
    return F.struct(prompt(context, question).alias("instruction"), F.concat(F.lit(BLOCK[0]), _text(sql), F.lit(BLOCK[1])).alias("response"))


def sft_thinking(context: Column, question: Column, sql: Column, reasoning: Column, tables: Column) -> Column:
    """The same with a think block: the reasoning where there is any, else a trace from the statement."""
    why = F.when(F.trim(_text(reasoning)) != "", reasoning).otherwise(T.reasoning_from_sql(_text(sql), tables))
    return F.struct(prompt(context, question).alias("instruction"), F.concat(F.lit("<think>\n"), why, F.lit("\n</think>\n\n"), F.lit(BLOCK[0]), _text(sql), F.lit(BLOCK[1])).alias("response"))


def grpo(context: Column, question: Column, sql: Column, tables: Column) -> Column:
    return F.struct(prompt(context, question).alias("prompt"), sql.alias("answer"), F.when(F.size(tables) > 0, tables).alias("schema_tables"))


def dpo(context: Column, question: Column, chosen: Column, rejected: Column) -> Column:
    return F.struct(prompt(context, question).alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


def correction(context: Column, question: Column, wrong: Column, kind: Column, message: Column, hints: dict[str, str]) -> Column:
    """A prompt that asks to correct a statement, with the class of its error and what to look at."""
    pairs = [x for k, v in hints.items() for x in (F.lit(k), F.lit(v))]
    hint = F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("Look at the whole statement again."))
    return F.concat(_text(context), F.lit("\n\nQuestion: "), _text(question), F.lit("\n\nThis statement is wrong:\n"), _text(wrong), F.lit("\n\nError ("), kind, F.lit("): "), F.when(_text(message) != "", message).otherwise("none told"), F.lit("\nHint: "), hint)


def golden_schema(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``id, table_name``: the tables of a row's database (id, db_id, sql) that its statement's words name, or whose columns they name; the first table where there are none.

    ``catalog`` has db_id, table_name, column_name. Names are compared without case; names of several words count as their parts' run.
    """
    low = catalog.select("db_id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()
    tokens = rows.select("id", "db_id", F.explode(F.array_distinct(T.matches(F.lower("sql"), "[a-z_][a-z0-9_]*"))).alias("w"))
    named = tokens.join(low.select("db_id", "table_name", F.col("table_name").alias("w")).distinct(), ["db_id", "w"]).select("id", "table_name")
    by_column = tokens.join(low.select("db_id", "table_name", F.col("column_name").alias("w")).distinct(), ["db_id", "w"]).select("id", "table_name")
    found = named.unionByName(by_column).distinct()
    first = low.groupBy("db_id").agg(F.min("table_name").alias("table_name"))
    return found.unionByName(rows.join(found.select("id").distinct(), "id", "left_anti").join(first, "db_id").select("id", "table_name"))


def batches(rows: DataFrame, by: str, order: list, size: int) -> DataFrame:
    """``rows`` with ``batch``: groups of ``size`` rows in order within each ``by``."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("long"))
