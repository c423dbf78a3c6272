"""Readers of catalogs, examples and record files, and a registry of them by format name.

Missing files are skipped, missing keys take their defaults. JSON arrays are read whole per file; where a file is
large, JSON lines is the format that can be split.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = (
    "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, "
    "primary_keys array<string>, foreign_keys array<array<int>>"
)


def existing(paths: list[str]) -> list[str]:
    """The local paths that exist, with or without 'file:'; paths with another scheme are taken as they are."""
    local = lambda p: re.sub(r"^file:(?://)?(?=/)", "", p)
    return [p for p in paths if "://" in local(p) or os.path.exists(local(p))]


def json_array(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(paths)


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, *, drop_bad: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, and broken ones either dropped or read as nulls."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE").json(paths)


def first_per_file(df: DataFrame, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each input file, the first by ``order``: a cap that the caller asks for."""
    w = Window.partitionBy("_file").orderBy(order)
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n", "_file")


def catalog_columns(raw: DataFrame) -> DataFrame:
    """``db_id, table_name, column_name, ordinal, dtype, is_pk`` of catalog rows; the '*' column (table -1) is left out, a missing type is TEXT.

    Key entries may be numbers or lists of numbers (composite keys).
    """
    # a composite key arrives as text '[1, 2]'
    pk = F.flatten(F.transform(F.coalesce("primary_keys", F.array().cast("array<string>")), lambda k: F.transform(F.regexp_extract_all(k, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))))
    cols = raw.select("db_id", "table_names_original", "column_types", pk.alias("pk"), F.posexplode("column_names_original").alias("i", "c"))
    t = F.col("c")[0].cast("int")
    out = cols.where(t >= 0).select("db_id", F.get("table_names_original", t).alias("table_name"), F.col("c")[1].alias("column_name"), F.col("i").alias("ordinal"), F.coalesce(F.get("column_types", F.col("i")), F.lit("TEXT")).alias("dtype"), F.array_contains("pk", F.col("i")).alias("is_pk"))
    return out.where(F.col("table_name").isNotNull())


def catalog_fks(raw: DataFrame) -> DataFrame:
    """``db_id, from_table, from_column, to_table, to_column``: index pairs turned into names by two joins."""
    cols = catalog_columns(raw).select("db_id", "ordinal", "table_name", "column_name")
    pairs = raw.select("db_id", F.explode("foreign_keys").alias("p")).select("db_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    a = cols.select("db_id", F.col("ordinal").alias("a"), F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"))
    b = cols.select("db_id", F.col("ordinal").alias("b"), F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"))
    return pairs.join(a, ["db_id", "a"]).join(b, ["db_id", "b"]).select("db_id", "from_table", "from_column", "to_table", "to_column")


def _field(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    found = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default).cast("string")


def _examples(spark: SparkSession, paths: list[str], sql_keys: list[str]) -> DataFrame:
    parts = existing(paths)
    schema = "db_id string, question string, query string, sql_text string, difficulty string, evidence string, lang string"
    if not parts:
        return spark.createDataFrame([], schema.replace("sql_text string, ", ""))
    df = None
    for p in parts:
        # keys that differ in case only (SQL, sql) are told apart
        raw = spark.read.option("multiLine", True).text(p, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
        get = lambda *ks, d=None: F.coalesce(*[F.try_element_at(F.col("m"), F.lit(k)) for k in ks], F.lit(d))
        one = raw.select(get("db_id").alias("db_id"), get("question").alias("question"), get(*sql_keys).alias("query"), get("difficulty", d="unknown").alias("difficulty"), get("evidence", d="").alias("evidence"), get("lang", d="en").alias("lang"))
        df = one if df is None else df.unionByName(one)
    return df


def spider(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    raw = json_array(spark, f"{root}/tables.json", CATALOG)
    files = [f"{root}/{f}" for f in ("train_spider.json", "train_others.json", "dev.json")]
    return {"columns": catalog_columns(raw), "fks": catalog_fks(raw), "examples": _examples(spark, files, ["query", "sql"])}


def bird(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The dev or train layout, whichever is there, else plain names; the first example file that exists."""
    tables = (existing([f"{root}/dev_tables.json", f"{root}/train_tables.json", f"{root}/tables.json"]) or [f"{root}/tables.json"])[0]
    files = existing([f"{root}/dev.json", f"{root}/train.json", f"{root}/examples.json"])[:1]
    raw = json_array(spark, tables, CATALOG)
    return {"columns": catalog_columns(raw), "fks": catalog_fks(raw), "examples": _examples(spark, files, ["SQL", "sql", "query"])}


READERS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {"spider": spider, "spider_v1": spider, "bird": bird}


def reader(name: str) -> Callable[[SparkSession, str], dict[str, DataFrame]]:
    """The reader of a format, in any case; unknown names raise KeyError with the known ones."""
    try:
        return READERS[name.lower()]
    except KeyError:
        raise KeyError(f"unknown format {name!r}; known: {', '.join(sorted(READERS))}") from None


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The first ``limit`` distinct non-null values of a column as trimmed text, in order; a missing column gives none."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    return df.select(F.trim(F.col(column).cast("string")).alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


def _saved(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/index", wholetext=True).first()[0])


def saved_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``save_tables`` wrote."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in _saved(spark, path)["tables"]}


def saved_parameters(spark: SparkSession, path: str) -> dict:
    return _saved(spark, path)["parameters"]
