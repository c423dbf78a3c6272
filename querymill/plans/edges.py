"""Statistical edges, layers of the schema graph, and texts of its nodes and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.operators import catalog as C
from querymill.operators import graph as G
from querymill.operators import stats as S
from querymill.plans import graph as PG
from querymill.plans import stats as PS
from querymill.plans.common import EX, examples
from querymill.session import table

#: Edge types of items that statements use together, with the largest weight of each (fixed values).
CAPS = {"co_join": 0.5, "co_predicate": 0.75, "co_select": 0.7}


def _columns(spark, d, part):
    """(db_id, example_id, item): columns that a part of a statement names, bare where one table of the database has the name, or with their table."""
    cat = table(spark, d, "cat_columns").select("db_id", F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct()
    sole = cat.groupBy("db_id", "c").agg(F.min("t").alias("t"), F.count("*").alias("k")).where("k = 1").drop("k")
    ex = examples(spark, d, "db_id", "sql").select("db_id", "example_id", part(F.lower("sql")).alias("p"))
    bare = ex.select("db_id", "example_id", F.explode(F.array_distinct(T.matches(F.col("p"), "[a-z_][a-z0-9_]*"))).alias("c")).join(sole, ["db_id", "c"])
    pairs = F.zip_with(T.matches(F.col("p"), r"([a-z_][a-z0-9_]*)\.([a-z_][a-z0-9_]*)", 1), T.matches(F.col("p"), r"([a-z_][a-z0-9_]*)\.([a-z_][a-z0-9_]*)", 2), lambda t, c: F.struct(t.alias("t"), c.alias("c")))
    full = ex.select("db_id", "example_id", F.explode(pairs).alias("x")).select("db_id", "example_id", "x.t", "x.c").join(cat, ["db_id", "t", "c"])
    item = F.concat_ws(".", "db_id", "t", "c").alias("item")
    return bare.select("db_id", "example_id", item).unionByName(full.select("db_id", "example_id", item)).distinct()


def _items(spark, d):
    tables = examples(spark, d, "db_id", "sql").select("db_id", "example_id", F.explode(F.transform(T.sql_tables(F.col("sql")), lambda t: F.concat_ws(".", "db_id", t))).alias("item"))
    return {"co_join": tables.where("db_id is not null"), "co_predicate": _columns(spark, d, T.predicate_part), "co_select": _columns(spark, d, T.select_part)}


def cooccurrence(spark, d):
    """Edges in both directions between items that statements of a database use together: Jaccard of their statements 0.1 at least, capped by type."""
    parts = []
    for kind, rows in _items(spark, d).items():
        j = S.pair_jaccard(rows, group="db_id", key="example_id", item="item", threshold=0.1)
        parts.append(S.both_ways(j.select("item_a", "item_b", F.round(F.least("jaccard", F.lit(CAPS[kind])), 6).alias("weight")), "item_a", "item_b").withColumn("edge_type", F.lit(kind)))
    return C.union(*parts).select("src", "dst", "edge_type", "weight")


_TABLE_OF = {c: t for t, cols in PS.STAR.items() for c in cols}


def value_edges(spark, d):
    """Overlapping columns (weight capped at 0.85), keys inferred from half of the values between tables without a declared key, and one table pair for these."""
    v = PS._values(spark, d).select("db_id", F.concat_ws(".", F.create_map(*[F.lit(x) for kv in _TABLE_OF.items() for x in kv])[F.col("col")], "col").alias("col"), "value")
    o = G.cut(S.value_overlap(v).select("col_a", "col_b", "n_shared", "jaccard"))
    full = lambda c: f"{_TABLE_OF[c]}.{c}"
    fk = spark.createDataFrame([tuple(sorted((full(a), full(b)))) for a, b in PS.STAR_FKS], "col_a string, col_b string")
    t = lambda c: F.substring_index(c, ".", 1)
    inferred = o.where((F.col("jaccard") >= 0.5) & (F.col("n_shared") >= 3) & (t("col_a") != t("col_b"))).join(fk, ["col_a", "col_b"], "left_anti")
    e = lambda df, a, b, kind, w: S.both_ways(df.select(a.alias("a"), b.alias("b"), w.alias("weight")).distinct(), "a", "b").withColumn("edge_type", F.lit(kind))
    a, b = F.col("col_a"), F.col("col_b")
    return C.union(e(o, a, b, "value_overlap", F.round(F.least("jaccard", F.lit(0.85)), 6)), e(inferred, a, b, "inferred_fk", F.lit(0.95)), e(inferred, F.least(t("col_a"), t("col_b")), F.greatest(t("col_a"), t("col_b")), "table_fk", F.lit(0.85))).select("src", "dst", "edge_type", "weight")


def graph_layers(spark, d):
    """The graph of all databases from its layers, by edge type: structure, names, statements."""
    lex = PS.lexical_edges(spark, d).select(F.concat_ws(".", "db_id", "col_a").alias("a"), F.concat_ws(".", "db_id", "col_b").alias("b"), "weight")
    lex = S.both_ways(lex, "a", "b").withColumn("edge_type", F.lit("lexical"))
    all_ = C.union(PG.structural_edges(spark, d), lex.select("src", "dst", "edge_type", "weight"), cooccurrence(spark, d))
    return all_.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("weight"))


def key_flags(spark, d):
    """Column nodes with their flags: key, and end of a reference."""
    cols, fks = PG._cat(spark, d)
    r = C.resolved_fks(cols, fks)
    ends = r.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct().withColumn("is_fk", F.lit(True))
    return C.nodes(cols).where("node_type = 'column'").join(ends, "node_id", "left").select("node_id", "is_pk", F.coalesce("is_fk", F.lit(False)).alias("is_fk"))


def table_links(spark, d):
    """Pairs of tables with the columns that link them."""
    link = F.concat(F.lower("from_column"), F.lit("="), F.lower("to_column"))
    return table(spark, d, "cat_fks").groupBy("db_id", F.lower("from_table").alias("from_table"), F.lower("to_table").alias("to_table")).agg(F.array_join(F.array_sort(F.collect_set(link)), " ").alias("columns"), F.count("*").alias("n"))


def neighbours(spark, d):
    """Of each table node the outgoing edges of some types, and the column nodes under it."""
    n = PG._nodes(spark, d)
    out = PG._edges(spark, d).where(F.col("edge_type").isin("table_has_column", "table_fk", "table_fk_rev")).groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("n_out"))
    cols = n.where("node_type = 'column'").groupBy("db_id", "table_name").agg(F.count("*").alias("n_columns"))
    return n.where("node_type = 'table'").select("node_id", "db_id", "table_name").join(out, "node_id", "left").join(cols, ["db_id", "table_name"], "left").select("node_id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


def node_labels(spark, d):
    """What an embedding of a node reads: label, description and synonyms; and the list of tables of its database."""
    n = PG._nodes(spark, d)
    label = F.concat_ws(".", "table_name", "column_name")
    text = F.concat_ws(" | ", F.when(label != "", label).otherwise(F.col("db_id")), F.when(F.coalesce("description", F.lit("")) != "", F.col("description")), F.when(F.size("synonyms") > 0, F.array_join("synonyms", ", ")))
    tabs = n.where("node_type = 'table'").groupBy("db_id").agg(F.array_join(F.array_sort(F.collect_set("table_name")), ", ").alias("tables"))
    return n.join(tabs, "db_id", "left").select("node_id", F.md5(text).alias("text"), F.md5(F.coalesce("tables", F.lit(""))).alias("tables"))


def enriched(spark, d):
    """Answers about nodes joined back, by id and else by the id's last part where one node of a database has it; here the descriptions of half of them."""
    n = PG._nodes(spark, d).where("node_type = 'column'").select("node_id", "db_id", "column_name", F.md5("node_id").alias("h"))
    said = PG._nodes(spark, d).where("description is not null and node_type = 'column'").select("db_id", F.when(F.substring(F.md5("node_id"), 1, 1) < "8", F.col("node_id")).otherwise(F.col("column_name")).alias("key"), F.length("description").alias("chars"))
    own = said.groupBy("key").agg(F.max("chars").alias("by_id"))
    sole = n.groupBy("db_id", "column_name").agg(F.count("*").alias("k")).where("k = 1").drop("k")
    short = said.join(sole, (said["db_id"] == sole["db_id"]) & (said["key"] == sole["column_name"])).select(sole["db_id"], sole["column_name"], F.col("chars").alias("by_name"))
    return n.join(own, n["node_id"] == own["key"], "left").join(short, ["db_id", "column_name"], "left").select("node_id", F.coalesce("by_id", "by_name").alias("chars"))


_PAIR = r"([a-z_][a-z0-9_]*)\s*=\s*'([^']*)'"


def _said(c):
    return F.array_sort(F.array_distinct(F.zip_with(T.matches(c, _PAIR, 1), T.matches(c, _PAIR, 2), lambda a, v: F.concat(a, F.lit("='"), v, F.lit("'")))))


def value_augmented(spark, d):
    """Questions with the values that are known: into a list that is there already, else into one of their own; and the same as hints."""
    q = F.when(F.pmod("example_id", F.lit(2)) == 0, F.concat("question", F.lit(" [tables: x]"))).otherwise(F.col("question"))
    ex = examples(spark, d, "question", "sql").where("question is not null").select("example_id", q.alias("q"), _said(F.lower("sql")).alias("v"))
    told = F.concat(F.lit("values: "), F.array_join("v", ", "))
    out = F.when(F.size("v") == 0, F.col("q")).when(F.endswith("q", F.lit("]")), F.concat(F.expr("left(q, length(q) - 1)"), F.lit("; "), told, F.lit("]"))).otherwise(F.concat("q", F.lit(" ["), told, F.lit("]")))
    return ex.select("example_id", F.md5(out).alias("question"), F.array_join(F.transform("v", lambda x: F.concat(F.lit("-- "), x)), "\n").alias("hints"))


def json_repaired(spark, d):
    """The JSON object inside a fenced answer with words around it."""
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), "metadata", F.lit("\n```\nDone."))
    return table(spark, d, "kg_edges").where("metadata like '{%}'").select("src_id", "dst_id", F.md5(T.repaired_json(wrapped)).alias("json"))


QUERIES = {f"edge_{f.__name__}": f for f in (cooccurrence, value_edges, graph_layers, key_flags, table_links, neighbours, node_labels, enriched, value_augmented, json_repaired)}

_PARTS = {"co_predicate": "CASE WHEN regexp_extract(lower(sql), '(?s)^.*?\\bwhere\\b(.*)$', 1) <> '' THEN regexp_extract(lower(sql), '(?s)^.*?\\bwhere\\b(.*)$', 1) ELSE regexp_extract(lower(sql), '(?s)^.*?\\bhaving\\b(.*)$', 1) END", "co_select": "regexp_extract(lower(sql), '(?s)^(.*?)\\bfrom\\b', 1)"}


def _co_sql() -> str:
    """CTEs ending in co(src, dst, edge_type, weight)."""
    out = [f"""{EX}, cc AS (SELECT DISTINCT db_id, lower(table_name) AS t, lower(column_name) AS c FROM cat_columns), sole AS (SELECT db_id, c, min(t) AS t FROM cc GROUP BY ALL HAVING count(*) = 1),
    i_co_join AS (SELECT db_id, example_id, db_id || '.' || unnest({PS._TAB}) AS item FROM ex WHERE db_id IS NOT NULL)"""]
    for k, part in _PARTS.items():
        out.append(f"""p_{k} AS (SELECT db_id, example_id, {part} AS p FROM ex), i_{k} AS (SELECT DISTINCT db_id, example_id, concat_ws('.', db_id, t, c) AS item FROM (SELECT db_id, example_id, unnest(list_distinct(regexp_extract_all(p, '[a-z_][a-z0-9_]*'))) AS c FROM p_{k}) JOIN sole USING (db_id, c)
        UNION SELECT db_id, example_id, concat_ws('.', db_id, t, c) FROM (SELECT db_id, example_id, unnest(regexp_extract_all(p, '([a-z_][a-z0-9_]*)\\.([a-z_][a-z0-9_]*)', 1)) AS t, unnest(regexp_extract_all(p, '([a-z_][a-z0-9_]*)\\.([a-z_][a-z0-9_]*)', 2)) AS c FROM p_{k}) JOIN cc USING (db_id, t, c))""")
    for k, cap in CAPS.items():
        out.append(f"""n_{k} AS (SELECT item, count(*) AS n FROM i_{k} GROUP BY 1), e_{k} AS (SELECT a.item AS a, b.item AS b, count(*) AS k FROM i_{k} a JOIN i_{k} b ON a.example_id = b.example_id AND a.item < b.item GROUP BY ALL),
        j_{k} AS (SELECT a, b, round(least(k / (x.n + y.n - k), {cap}), 6) AS weight FROM e_{k} JOIN n_{k} x ON a = x.item JOIN n_{k} y ON b = y.item WHERE k / (x.n + y.n - k) >= 0.1)""")
    both = " UNION ALL ".join(f"SELECT {a} AS src, {b} AS dst, '{k}' AS edge_type, weight FROM j_{k}" for k in CAPS for a, b in (("a", "b"), ("b", "a")))
    return ", ".join(out) + f", co AS ({both})"


_LEX = PS.ORACLE["lexical_edges"]
_FULL = {c: f"{t}.{c}" for c, t in _TABLE_OF.items()}
ORACLE = {
    "edge_cooccurrence": f"WITH {_co_sql()} SELECT * FROM co",
    "edge_value_edges": f"""WITH {PS._VAL}, tb(c, t) AS (VALUES {', '.join(f"('{c}', '{t}')" for c, t in _TABLE_OF.items())}), fk(a, b) AS (VALUES {', '.join(str(tuple(sorted((_FULL[a], _FULL[b])))) for a, b in PS.STAR_FKS)}),
        o AS (SELECT least(x.t || '.' || x.c, y.t || '.' || y.c) AS a, greatest(x.t || '.' || x.c, y.t || '.' || y.c) AS b, n_shared, jaccard FROM j JOIN tb x ON col_a = x.c JOIN tb y ON col_b = y.c WHERE jaccard >= 0.2 AND n_shared >= 2),
        f AS (SELECT * FROM o ANTI JOIN fk ON o.a = fk.a AND o.b = fk.b WHERE jaccard >= 0.5 AND n_shared >= 3 AND split_part(o.a, '.', 1) <> split_part(o.b, '.', 1)),
        e AS (SELECT a, b, 'value_overlap' AS edge_type, round(least(jaccard, 0.85), 6) AS weight FROM o UNION ALL SELECT a, b, 'inferred_fk', 0.95 FROM f UNION ALL SELECT DISTINCT least(split_part(a, '.', 1), split_part(b, '.', 1)), greatest(split_part(a, '.', 1), split_part(b, '.', 1)), 'table_fk', 0.85 FROM f)
        SELECT a AS src, b AS dst, edge_type, weight::DOUBLE AS weight FROM e UNION ALL SELECT b, a, edge_type, weight::DOUBLE FROM e""",
    "edge_graph_layers": f"WITH {_co_sql()}, lx AS ({_LEX}), st AS ({PG.ORACLE['structural_edges']}), al AS (SELECT edge_type, weight FROM co UNION ALL SELECT edge_type, weight FROM st UNION ALL SELECT 'lexical', weight FROM lx UNION ALL SELECT 'lexical', weight FROM lx) SELECT edge_type, count(*) AS n, round(sum(weight), 3) AS weight FROM al GROUP BY 1",
    "edge_key_flags": f"WITH {PG._FK}, ends AS (SELECT fn AS node_id FROM fk UNION SELECT tn FROM fk) SELECT concat_ws('.', db_id, table_name, column_name) AS node_id, is_pk, concat_ws('.', db_id, table_name, column_name) IN (SELECT node_id FROM ends) AS is_fk FROM cat_columns",
    "edge_table_links": "SELECT db_id, lower(from_table) AS from_table, lower(to_table) AS to_table, array_to_string(list_sort(list_distinct(list(lower(from_column) || '=' || lower(to_column)))), ' ') AS columns, count(*) AS n FROM cat_fks GROUP BY ALL",
    "edge_neighbours": f"WITH {PG._N}, {PG._E}, o AS (SELECT src_id, count(*) AS k FROM e WHERE edge_type IN ('table_has_column', 'table_fk', 'table_fk_rev') GROUP BY 1), c AS (SELECT db_id, table_name, count(*) AS k FROM n WHERE node_type = 'column' GROUP BY ALL) SELECT node_id, coalesce(o.k, 0) AS n_out, coalesce(c.k, 0) AS n_columns FROM n LEFT JOIN o ON node_id = src_id LEFT JOIN c ON n.db_id = c.db_id AND n.table_name = c.table_name WHERE node_type = 'table'",
    "edge_node_labels": f"WITH {PG._N}, t AS (SELECT db_id, array_to_string(list_sort(list_distinct(list(table_name))), ', ') AS tables FROM n WHERE node_type = 'table' GROUP BY 1) SELECT node_id, md5(concat_ws(' | ', CASE WHEN concat_ws('.', table_name, column_name) <> '' THEN concat_ws('.', table_name, column_name) ELSE n.db_id END, nullif(description, ''), CASE WHEN len(synonyms) > 0 THEN array_to_string(synonyms, ', ') END)) AS text, md5(coalesce(tables, '')) AS tables FROM n LEFT JOIN t ON n.db_id = t.db_id",
    "edge_enriched": f"""WITH {PG._N}, c AS (SELECT * FROM n WHERE node_type = 'column'), u AS (SELECT db_id, column_name FROM c GROUP BY ALL HAVING count(*) = 1)
        SELECT c.node_id, CASE WHEN description IS NULL THEN NULL WHEN md5(c.node_id)[1] < '8' THEN length(description) WHEN u.db_id IS NOT NULL THEN length(description) END::INT AS chars FROM c LEFT JOIN u ON c.db_id = u.db_id AND c.column_name = u.column_name""",
    "edge_value_augmented": f"""WITH {EX}, q AS (SELECT example_id, CASE WHEN example_id % 2 = 0 THEN question || ' [tables: x]' ELSE question END AS q, list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(coalesce(lower(sql), ''), $p${_PAIR}$p$, 1), regexp_extract_all(coalesce(lower(sql), ''), $p${_PAIR}$p$, 2)), lambda x: x[1] || '=''' || x[2] || ''''))) AS v FROM ex WHERE question IS NOT NULL)
        SELECT example_id, md5(CASE WHEN len(v) = 0 THEN q WHEN q LIKE '%]' THEN q[:-2] || '; values: ' || array_to_string(v, ', ') || ']' ELSE q || ' [values: ' || array_to_string(v, ', ') || ']' END) AS question, array_to_string(['-- ' || x FOR x IN v], chr(10)) AS hints FROM q""",
    "edge_json_repaired": "SELECT src_id, dst_id, md5(metadata) AS json FROM kg_edges WHERE metadata LIKE '{%}'",
}
