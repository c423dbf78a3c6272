"""Writers of records and indexes, and the fingerprint that tells whether an index is current."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_json_lines(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_statements(df: DataFrame, column: str, path: str) -> None:
    """One statement a line, line breaks as blanks."""
    df.select(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s*[\r\n]+\s*", " ").alias("value")).write.mode("overwrite").text(path)


def fingerprint(*parts: object) -> str:
    """The first 16 digits of the sha256 of the parts joined by '|'."""
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()[:16]


def fingerprint_column(*parts) -> Column:
    """The same for columns, row by row."""
    return F.substring(F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256), 1, 16)


def save_tables(tables: dict[str, DataFrame], path: str, parameters: dict | None = None) -> None:
    """Tables that belong together (nodes and edges of a graph, a matrix) as parquet under one folder, with the parameters they were made with."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    index = {"tables": sorted(tables), "parameters": parameters or {}}
    spark.createDataFrame([(json.dumps(index, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/index")


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, *, skip_existing: bool = False) -> None:
    """Adds rows to a parquet index by key: new rows replace old ones, or only unknown keys are appended."""
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        rows.dropDuplicates([key]).write.parquet(path)
        return
    if skip_existing:
        rows.dropDuplicates([key]).join(old.select(key), key, "left_anti").write.mode("append").parquet(path)
        return
    from querymill.runtime import cut

    merged = cut(old.join(rows.select(key), key, "left_anti").unionByName(rows.dropDuplicates([key])))
    merged.write.mode("overwrite").parquet(path)
