"""Readers and sinks as round trips: a table is written in a format and read back, into a folder of its own beside the checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from querymill.operators import graph as G
from querymill.operators.catalog import union
from querymill.plans.common import EX, examples
from querymill.plans.stats import _NPMI, npmi_matrix
from querymill.runtime import checkpoint_dir
from querymill.session import table
from querymill.sources import readers, sinks


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/source-{name}-{uuid.uuid4().hex[:12]}"


def _catalog_json(spark, d):
    """The catalog in the layout of benchmark files, one object a database: tables, [table, column] pairs after '*', types, keys and reference pairs by place."""
    tabs = table(spark, d, "cat_columns").groupBy("db_id", "table_name").agg(F.min("ordinal").alias("o"))
    w = Window.partitionBy("db_id").orderBy("table_name")
    tabs = tabs.select("db_id", "table_name", (F.row_number().over(w) - 1).alias("t"))
    cols = table(spark, d, "cat_columns").join(tabs, ["db_id", "table_name"])
    cols = cols.select("db_id", "t", "table_name", "column_name", "dtype", "is_pk", F.row_number().over(Window.partitionBy("db_id").orderBy("t", "ordinal", "column_name")).alias("i"))
    low = lambda c: F.lower(c)
    place = cols.select("db_id", low("table_name").alias("tn"), low("column_name").alias("cn"), "i")
    f = table(spark, d, "cat_fks").select("db_id", low("from_table").alias("ft"), low("from_column").alias("fc"), low("to_table").alias("tt"), low("to_column").alias("tc"))
    a = place.select("db_id", F.col("tn").alias("ft"), F.col("cn").alias("fc"), F.col("i").alias("a"))
    b = place.select("db_id", F.col("tn").alias("tt"), F.col("cn").alias("tc"), F.col("i").alias("b"))
    pairs = f.join(a, ["db_id", "ft", "fc"]).join(b, ["db_id", "tt", "tc"]).groupBy("db_id").agg(F.collect_list(F.array("a", "b")).alias("foreign_keys"))
    names = tabs.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "table_name"))), lambda x: x["table_name"]).alias("table_names_original"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "t", "column_name", "dtype", "is_pk")))
    one = cols.groupBy("db_id").agg(ordered.alias("c")).select(
        "db_id", F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), F.transform("c", lambda x: F.array(x["t"].cast("string"), x["column_name"]))).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), F.transform("c", lambda x: F.coalesce(x["dtype"], F.lit("TEXT")))).alias("column_types"), F.transform(F.filter("c", lambda x: x["is_pk"]), lambda x: x["i"].cast("string")).alias("primary_keys"))
    return one.join(names, "db_id").join(pairs, "db_id", "left")


def _benchmark(spark, d, name):
    """The catalog and its examples in one folder, as JSON."""
    at = _folder(spark, name)
    _catalog_json(spark, d).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(f"{at}/tables.json")
    ex = examples(spark, d, "db_id", "question", "sql", "split").where("split in ('train', 'dev') and question is not null")
    for split, file, key in (("train", "train_spider.json", "query"), ("dev", "dev.json", "SQL" if name == "bird" else "sql")):
        rows = ex.where(F.col("split") == split).select("db_id", "question", F.col("sql").alias(key))
        rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("db_id", "question", key)))).alias("value")).coalesce(1).write.text(f"{at}/{file}")
    return at


def catalog_columns(spark, d):
    return readers.reader("Spider")(spark, _benchmark(spark, d, "spider"))["columns"].select("db_id", "table_name", "column_name", "dtype", "is_pk")


def catalog_fks(spark, d):
    return readers.reader("spider_v1")(spark, _benchmark(spark, d, "spider"))["fks"].select("db_id", *[F.lower(c).alias(c) for c in ("from_table", "from_column", "to_table", "to_column")])


def spider_examples(spark, d):
    out = readers.reader("spider")(spark, _benchmark(spark, d, "spider"))["examples"]
    return out.select("db_id", F.md5("question").alias("question"), F.md5(F.coalesce("query", F.lit(""))).alias("query"), "difficulty", "lang")


def bird_examples(spark, d):
    """The first example file that exists alone."""
    out = readers.reader("bird")(spark, _benchmark(spark, d, "bird"))["examples"]
    return out.select("db_id", F.md5("question").alias("question"), F.md5(F.coalesce("query", F.lit(""))).alias("query"), "evidence")


def json_lines(spark, d):
    """Runs written, more appended, one line broken; blank and broken lines are dropped."""
    at, rows = _folder(spark, "lines"), table(spark, d, "eval_rows").select("run_id", "example_id", "ex")
    sinks.write_json_lines(rows.where("ex"), at)
    sinks.write_json_lines(rows.where("not ex"), at, append=True)
    spark.createDataFrame([("",), ("{broken",)], "value string").write.mode("append").text(at)
    return readers.json_lines(spark, at, "run_id string, example_id long, ex boolean", drop_bad=True).where("run_id is not null")


def capped_files(spark, d):
    """The two first rows of each of several files."""
    at, e = _folder(spark, "caps"), table(spark, d, "eval_rows").select("run_id", "example_id").distinct()
    e.repartition(4, "run_id").write.partitionBy("run_id").json(at)
    raw = spark.read.schema("example_id long").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(at)
    return readers.first_per_file(raw, "example_id", 2).groupBy("example_id").agg(F.count("*").alias("n"))


def statements(spark, d):
    """One statement a line; line breaks became blanks."""
    at = _folder(spark, "sql")
    sinks.write_statements(table(spark, d, "eval_rows").where("predicted_sql is not null"), "predicted_sql", at)
    return spark.read.text(at).groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


def upserted(spark, d):
    """An index of nodes: all first, then half of them again with another type, then only unknown keys."""
    at, n = _folder(spark, "index"), G.keep_first(table(spark, d, "kg_nodes"), ["node_id"], [F.col("enriched_at").desc_nulls_last()]).select("node_id", "node_type")
    half = F.substring(F.md5("node_id"), 1, 1) < "8"
    sinks.upsert(spark, at, n.where(half), "node_id")
    sinks.upsert(spark, at, n.where(half & (F.col("node_type") == "column")).withColumn("node_type", F.lit("again")), "node_id")
    sinks.upsert(spark, at, n.withColumn("node_type", F.lit("late")), "node_id", skip_existing=True)
    return spark.read.parquet(at).groupBy("node_type").agg(F.count("*").alias("n"))


def saved_graph(spark, d):
    at = _folder(spark, "graph")
    sinks.save_tables({"nodes": table(spark, d, "kg_nodes").select("node_id", "node_type").distinct(), "edges": G.latest_edges(table(spark, d, "kg_edges"))}, at)
    g = readers.saved_tables(spark, at)
    return g["edges"].join(g["nodes"].select(F.col("node_id").alias("src_id"), "node_type"), "src_id").groupBy("node_type", "edge_type").agg(F.count("*").alias("n"))


def saved_npmi(spark, d):
    at = _folder(spark, "npmi")
    sinks.save_tables({"matrix": npmi_matrix(spark, d)}, at, {"min_count": 3})
    kept = readers.saved_tables(spark, at)
    return kept["matrix"].withColumn("min_count", F.lit(readers.saved_parameters(spark, at)["min_count"]))


def distinct_values(spark, d):
    t = {"customer": "c_mktsegment", "orders": "o_orderpriority", "nation": "n_name"}
    return union(*[readers.distinct_values(table(spark, d, n), c, 4).select(F.lit(c).alias("col"), "value") for n, c in t.items()], readers.distinct_values(table(spark, d, "nation"), "missing", 4).select(F.lit("missing").alias("col"), "value"))


def fingerprints(spark, d):
    """The fingerprint of each database's chunk list, as the driver works it out and as a column does."""
    n = table(spark, d, "cat_columns").groupBy("db_id").agg(F.count("*").alias("n"))
    return n.select("db_id", sinks.fingerprint_column("v1", F.col("db_id"), F.col("n")).alias("fingerprint"), F.lit(sinks.fingerprint("v1", "a", 3)).alias("of_driver"))


QUERIES = {f"source_{f.__name__}": f for f in (
    catalog_columns, catalog_fks, spider_examples, bird_examples, json_lines, capped_files, statements, upserted, saved_graph, saved_npmi, distinct_values, fingerprints,
)}

_NODES = "n AS (SELECT node_id, node_type FROM kg_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY enriched_at DESC) = 1)"
_EXQ = "SELECT db_id, md5(question) AS question, md5(coalesce(sql, '')) AS query"
ORACLE = {
    "source_catalog_columns": "SELECT db_id, table_name, column_name, coalesce(dtype, 'TEXT') AS dtype, is_pk FROM cat_columns",
    "source_catalog_fks": "SELECT db_id, lower(from_table) AS from_table, lower(from_column) AS from_column, lower(to_table) AS to_table, lower(to_column) AS to_column FROM cat_fks f WHERE EXISTS (FROM cat_columns c WHERE c.db_id = f.db_id AND lower(c.table_name) = lower(from_table) AND lower(c.column_name) = lower(from_column)) AND EXISTS (FROM cat_columns c WHERE c.db_id = f.db_id AND lower(c.table_name) = lower(to_table) AND lower(c.column_name) = lower(to_column))",
    "source_spider_examples": f"WITH {EX} {_EXQ}, 'unknown' AS difficulty, 'en' AS lang FROM ex WHERE split IN ('train', 'dev') AND question IS NOT NULL",
    "source_bird_examples": f"WITH {EX} {_EXQ}, '' AS evidence FROM ex WHERE split = 'dev' AND question IS NOT NULL",
    "source_json_lines": "SELECT run_id, example_id, ex FROM eval_rows WHERE ex IS NOT NULL",
    "source_capped_files": "SELECT example_id, count(*) AS n FROM (SELECT run_id, example_id FROM (SELECT DISTINCT run_id, example_id FROM eval_rows) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY example_id) <= 2) GROUP BY 1",
    "source_statements": "SELECT md5(regexp_replace(predicted_sql, '\\s*[\\r\\n]+\\s*', ' ', 'g')) AS line, count(*) AS n FROM eval_rows WHERE predicted_sql IS NOT NULL GROUP BY 1",
    "source_upserted": f"WITH {_NODES} SELECT CASE WHEN md5(node_id)[1] >= '8' THEN 'late' WHEN node_type = 'column' THEN 'again' ELSE node_type END AS node_type, count(*) AS n FROM n GROUP BY 1",
    "source_saved_graph": "WITH e AS (SELECT DISTINCT src_id, dst_id, edge_type FROM kg_edges), k AS (SELECT DISTINCT node_id, node_type FROM kg_nodes) SELECT node_type, edge_type, count(*) AS n FROM e JOIN k ON src_id = node_id GROUP BY ALL",
    "source_saved_npmi": _NPMI + " SELECT *, 3 AS min_count FROM m",
    "source_distinct_values": " UNION ALL ".join(f"(SELECT DISTINCT '{c}' AS col, trim({c}) AS value FROM {t} WHERE {c} IS NOT NULL ORDER BY value LIMIT 4)" for t, c in {"customer": "c_mktsegment", "orders": "o_orderpriority", "nation": "n_name"}.items()),
    "source_fingerprints": "SELECT db_id, sha256('v1|' || db_id || '|' || count(*))[1:16] AS fingerprint, sha256('v1|a|3')[1:16] AS of_driver FROM cat_columns GROUP BY db_id",
}
