"""Catalog rows (columns and declared references) as chunks, nodes and structural edges.

Catalog tables: ``columns(db_id, table_name, column_name, ordinal, dtype, is_pk, description)`` and
``fks(db_id, from_table, from_column, to_table, to_column)``. Names are compared without case where a reference is resolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type names whose columns hold text.
TEXT_PREFIXES = "TEXT VARCHAR CHAR STRING NVARCHAR CLOB".split()
TEXT_TYPES = "text varchar char string nvarchar name character mediumtext longtext clob".split()


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def is_text_prefix(dtype: Column) -> Column:
    """Whether a declared type starts like a text type; unknown and empty types count as text."""
    up = F.upper(F.trim(dtype))
    return F.coalesce((up == "") | up.rlike("^(" + "|".join(TEXT_PREFIXES) + ")"), F.lit(True))


def is_text_type(dtype: Column) -> Column:
    """Whether the base name before '(' is a text type; null is none."""
    return F.coalesce(F.lower(F.trim(F.substring_index(dtype, "(", 1))).isin(*TEXT_TYPES), F.lit(False))


def chunks(columns: DataFrame, fks: DataFrame, values: DataFrame | None = None, *, max_values: int = 5) -> DataFrame:
    """``db_id, chunk_type, table_name, content`` of tables, columns, references and (db_id, table_name, column_name, sample_values) rows."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]), ", ")
    tables = columns.groupBy("db_id", "table_name").agg(names.alias("n")).select("db_id", F.lit("table").alias("chunk_type"), "table_name", F.concat(F.lit("Table: "), "table_name", F.lit(". Columns: "), "n").alias("content"))
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" Description: "), "description")).otherwise("")
    cols = columns.select("db_id", F.lit("column").alias("chunk_type"), "table_name", F.concat(F.lit("Column: "), "table_name", F.lit("."), "column_name", F.lit(" ("), F.coalesce("dtype", F.lit("")), F.lit(")"), F.when(F.col("is_pk"), " [PK]").otherwise(""), F.lit("."), described).alias("content"))
    refs = fks.select("db_id", F.lit("fk").alias("chunk_type"), F.col("from_table").alias("table_name"), F.concat(F.lit("FK: "), "from_table", F.lit("."), "from_column", F.lit(" → "), "to_table", F.lit("."), "to_column").alias("content"))
    out = [tables, cols, refs]
    if values is not None:
        first = F.array_join(F.slice("sample_values", 1, max_values), ", ")
        out.append(values.where("size(sample_values) > 0").select("db_id", F.lit("value").alias("chunk_type"), "table_name", F.concat(F.lit("Values of "), "table_name", F.lit("."), "column_name", F.lit(": "), first).alias("content")))
    return union(*out)


def nodes(columns: DataFrame) -> DataFrame:
    """``node_id, node_type, db_id, table_name, column_name, dtype, is_pk`` of databases, tables and columns."""
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    rest = [null("string", "dtype"), null("boolean", "is_pk")]
    dbs = columns.select("db_id").distinct().select(F.col("db_id").alias("node_id"), F.lit("database").alias("node_type"), "db_id", null("string", "table_name"), null("string", "column_name"), *rest)
    tables = columns.select("db_id", "table_name").distinct().select(F.concat_ws(".", "db_id", "table_name").alias("node_id"), F.lit("table").alias("node_type"), "db_id", "table_name", null("string", "column_name"), *rest)
    cols = columns.select(F.concat_ws(".", "db_id", "table_name", "column_name").alias("node_id"), F.lit("column").alias("node_type"), "db_id", "table_name", "column_name", "dtype", "is_pk")
    return union(dbs, tables, cols)


def resolved_fks(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """References whose both ends exist in the catalog, with the catalog's spelling and both node ids."""
    ends = columns.select("db_id", "table_name", "column_name", F.lower("table_name").alias("t"), F.lower("column_name").alias("c"), F.concat_ws(".", "db_id", "table_name", "column_name").alias("node"))
    side = lambda p: ends.select("db_id", F.col("t").alias(f"{p}_t"), F.col("c").alias(f"{p}_c"), F.col("table_name").alias(f"{p}_table_name"), F.col("node").alias(f"{p}_node"))
    keyed = fks.select("db_id", F.lower("from_table").alias("from_t"), F.lower("from_column").alias("from_c"), F.lower("to_table").alias("to_t"), F.lower("to_column").alias("to_c"))
    return keyed.join(side("from"), ["db_id", "from_t", "from_c"]).join(side("to"), ["db_id", "to_t", "to_c"])


def structural_edges(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """``src, dst, edge_type, weight`` of containment, primary keys, references and referring tables, both ways where it applies."""
    # Edge types and weights.
    e = lambda s, d, t, w: F.struct(s.alias("src"), d.alias("dst"), F.lit(t).alias("edge_type"), F.lit(w).alias("weight"))
    db, tab, col = F.col("db_id"), F.concat_ws(".", "db_id", "table_name"), F.concat_ws(".", "db_id", "table_name", "column_name")
    has = columns.select("db_id", "table_name").distinct().select(e(db, tab, "db_has_table", 1.0).alias("e"))
    own = columns.select(F.explode(F.array_compact(F.array(e(tab, col, "table_has_column", 1.0), e(col, tab, "column_belongs_to", 1.0), F.when(F.col("is_pk"), e(col, tab, "primary_key_of", 1.0))))).alias("e"))
    fk = resolved_fks(columns, fks)
    ref = fk.select(F.explode(F.array(e(F.col("from_node"), F.col("to_node"), "foreign_key", 0.95), e(F.col("to_node"), F.col("from_node"), "foreign_key_rev", 0.95))).alias("e"))
    f, t = F.concat_ws(".", "db_id", "from_table_name"), F.concat_ws(".", "db_id", "to_table_name")
    pairs = fk.select("db_id", "from_table_name", "to_table_name").distinct().select(F.explode(F.array(e(f, t, "table_fk", 0.85), e(t, f, "table_fk_rev", 0.85))).alias("e"))
    return union(has, own, ref, pairs).select("e.*")


def fk_neighbours(fks: DataFrame) -> DataFrame:
    """``db_id, table_name, neighbours``: tables linked by a reference in either direction, lower case, sorted."""
    a, b = F.lower("from_table"), F.lower("to_table")
    both = fks.select("db_id", F.explode(F.array(F.struct(a.alias("t"), b.alias("n")), F.struct(b.alias("t"), a.alias("n")))).alias("x")).select("db_id", "x.t", "x.n").where("t <> n")
    return both.groupBy("db_id", F.col("t").alias("table_name")).agg(F.array_join(F.array_sort(F.collect_set("n")), " ").alias("neighbours"))


def node_text(n: DataFrame) -> DataFrame:
    """``node_id, content`` of table and column nodes: names, type, key marks, description and three samples."""
    desc = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("— "), "description"))
    sample = F.when(F.size("sample_values") > 0, F.concat(F.lit("[e.g. "), F.array_join(F.transform(F.slice("sample_values", 1, 3), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]")))
    column = F.concat_ws(" ", F.concat(F.lit("Column: "), "table_name", F.lit("."), "column_name"), F.when(F.coalesce("dtype", F.lit("")) != "", F.concat(F.lit("("), "dtype", F.lit(")"))), F.when(F.col("is_pk"), "[PK]"), F.when(F.col("is_fk"), "[FK]"), desc, sample)
    tab = F.concat_ws(" ", F.concat(F.lit("Table: "), "table_name"), desc)
    return n.select("node_id", F.when(F.col("node_type") == "table", tab).when(F.col("node_type") == "column", column).otherwise(F.col("node_id")).alias("content"))


def schema_context(columns: DataFrame, fks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``query_id, context`` for wanted (query_id, db_id, table_name, rank) rows: CREATE TABLE lines in order of rank, then the references of those tables."""
    cols = columns.select("db_id", F.lower("table_name").alias("t"), "table_name", F.struct("ordinal", F.concat("column_name", F.lit(" ("), F.coalesce("dtype", F.lit("")), F.lit(")"), F.when(F.col("is_pk"), " [PK]").otherwise("")).alias("s")).alias("c"))
    w = wanted.select("query_id", "db_id", F.lower("table_name").alias("t"), "rank")
    line = F.concat(F.lit("CREATE TABLE "), F.first("table_name"), F.lit(" ("), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["s"]), ", "), F.lit(")"))
    tables = w.join(cols, ["db_id", "t"]).groupBy("query_id", "rank", "t").agg(line.alias("line"))
    text = tables.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t", "line"))), lambda x: x["line"]), "\n").alias("tables"))
    fk = fks.select("db_id", F.explode(F.array_distinct(F.array(F.lower("from_table"), F.lower("to_table")))).alias("t"), F.concat(F.lit("  "), "from_table", F.lit("."), "from_column", F.lit(" = "), "to_table", F.lit("."), "to_column").alias("ref"))
    refs = w.join(fk, ["db_id", "t"]).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), "\n").alias("refs"))
    return text.join(refs, "query_id", "left").select("query_id", F.concat_ws("\n", "tables", F.when(F.col("refs").isNotNull(), F.concat(F.lit("Foreign Keys:\n"), "refs"))).alias("context"))
