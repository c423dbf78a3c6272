"""What several plan modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querymill.operators.dedupe import latest
from querymill.session import table


def examples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Examples as they were delivered last."""
    return latest(table(spark, d, "sft_examples"), "example_id", "ingested_at", list(columns))


#: The same in DuckDB.
EX = "ex AS (SELECT * FROM sft_examples WHERE example_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY ingested_at DESC) = 1)"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)
