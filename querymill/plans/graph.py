"""Catalog chunks, nodes, edges, and retrieval over the schema graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.operators import catalog as C
from querymill.operators import graph as G
from querymill.plans.common import EX, examples
from querymill.session import table


def _cat(spark, d):
    return table(spark, d, "cat_columns"), table(spark, d, "cat_fks")


def _nodes(spark, d):
    """Nodes once, as they were enriched last."""
    return G.keep_first(table(spark, d, "kg_nodes"), ["node_id"], [F.col("enriched_at").desc_nulls_last()])


def _edges(spark, d):
    return G.latest_edges(table(spark, d, "kg_edges"))


def catalog_chunks(spark, d):
    return C.chunks(*_cat(spark, d))


def value_chunks(spark, d):
    n = _nodes(spark, d).where("node_type = 'column'")
    cols, fks = _cat(spark, d)
    return C.chunks(cols.limit(0), fks.limit(0), n).where("chunk_type = 'value'")


def catalog_nodes(spark, d):
    return C.nodes(table(spark, d, "cat_columns"))


def structural_edges(spark, d):
    return C.structural_edges(*_cat(spark, d))


def dangling_fks(spark, d):
    """References per database and how many of them resolve."""
    cols, fks = _cat(spark, d)
    ok = C.resolved_fks(cols, fks).groupBy("db_id").agg(F.count("*").alias("n_resolved"))
    return fks.groupBy("db_id").agg(F.count("*").alias("n_fks")).join(ok, "db_id", "left").select("db_id", "n_fks", F.coalesce("n_resolved", F.lit(0)).alias("n_resolved"))


def fk_neighbours(spark, d):
    return C.fk_neighbours(table(spark, d, "cat_fks"))


def text_columns(spark, d):
    c = table(spark, d, "cat_columns")
    return c.groupBy("db_id").agg(F.count_if(C.is_text_prefix(F.col("dtype"))).alias("n_text_prefix"), F.count_if(C.is_text_type(F.col("dtype"))).alias("n_text_type"))


def node_texts(spark, d):
    return C.node_text(_nodes(spark, d))


def schema_contexts(spark, d):
    """Context of the tables that the gold statement of each dev example reads."""
    from querymill.functions.sqltext import source_tables

    ex = examples(spark, d, "db_id", "sql", "split").where("split = 'dev'").select(F.col("example_id").alias("query_id"), "db_id", F.posexplode(F.array_sort(source_tables(F.col("sql")))).alias("rank", "table_name"))
    return C.schema_context(*_cat(spark, d), ex)


def current_edges(spark, d):
    return _edges(spark, d).select("src_id", "dst_id", "edge_type", "weight", "built_at")


def graph_stats(spark, d):
    e, n = _edges(spark, d), _nodes(spark, d)
    a = e.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight")).select(F.concat(F.lit("edge "), "edge_type").alias("kind"), "n", "mean_weight")
    b = n.groupBy("node_type").agg(F.count("*").alias("n"), F.round(F.count_if(F.coalesce("description", F.lit("")) != "") / F.count("*"), 6).alias("mean_weight")).select(F.concat(F.lit("node "), "node_type").alias("kind"), "n", "mean_weight")
    return a.unionByName(b)


def enrichment_summary(spark, d):
    n = _nodes(spark, d)
    return n.groupBy("db_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.coalesce("description", F.lit("")) != "").alias("n_described"), F.count_if(F.coalesce(F.size("synonyms"), F.lit(0)) > 0).alias("n_with_synonyms"), F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).alias("n_embedded"))


def _seeds(spark, d):
    """For each database the query is its first table; seeds are its five nodes with the most fitting text, here those with the most edges."""
    n = _nodes(spark, d).where("node_type <> 'database'").select("db_id", "node_id")
    deg = _edges(spark, d).groupBy(F.col("src_id").alias("node_id")).agg(F.round(F.sum("weight"), 6).alias("score"))
    return G.personalization(n.join(deg, "node_id").select(F.col("db_id").alias("query_id"), "node_id", "score"))


def _grouped(spark, d, seeds):
    """(transitions, seeds) with their database as group."""
    n = _nodes(spark, d).select(F.col("node_id").alias("src"), F.col("db_id").alias("grp"))
    return G.transitions(_edges(spark, d)).join(n, "src").select("grp", "src", "dst", "p"), seeds.withColumn("grp", F.col("query_id"))


def ppr_fixed_k(spark, d):
    out = G.ppr_by_group(*_grouped(spark, d, _seeds(spark, d)), fixed=8)
    return out.select("query_id", "node_id", F.round("r", 8).alias("score"))


def ppr_converged(spark, d):
    """Ranks after convergence, to five digits."""
    out = G.ppr_by_group(*_grouped(spark, d, _seeds(spark, d)), tol=1e-9)
    return out.select("query_id", "node_id", F.round("r", 5).alias("score")).where("score > 0")


def _hits(spark, d):
    cols = _nodes(spark, d).where("node_type <> 'database'").select("node_id")
    return G.ranked(ppr_fixed_k(spark, d).join(cols, "node_id", "left_semi"), threshold=0.005, cap=15)


def graph_ranked(spark, d):
    return _hits(spark, d).select("query_id", "node_id", "score", "rank")


def gap_prune(spark, d):
    return G.gap_pruned(_hits(spark, d), ratio=1.5).select("query_id", "node_id", "score", "rank")


def _parents(spark, d):
    return _nodes(spark, d).where("node_type = 'column'").select("node_id", F.concat_ws(".", "db_id", "table_name").alias("parent_id"))


def fk_bridge(spark, d):
    fk = _edges(spark, d).where("edge_type = 'foreign_key'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    columns = _parents(spark, d)
    hits = G.cut(_hits(spark, d).join(columns.select("node_id"), "node_id", "left_semi"))
    out = G.bridge_tables(hits, fk, columns)
    return out.select("query_id", "node_id", F.round("score", 8).alias("score"))


def fk_expand(spark, d):
    """Tables within two references of the tables that a dev example reads."""
    from querymill.functions.sqltext import source_tables

    start = examples(spark, d, "db_id", "sql", "split").where("split = 'dev'").select(F.col("example_id").alias("query_id"), F.explode(F.transform(source_tables(F.col("sql")), lambda t: F.concat_ws(".", "db_id", t))).alias("table_id"))
    a, b = F.concat_ws(".", "db_id", F.lower("from_table")), F.concat_ws(".", "db_id", F.lower("to_table"))
    links = table(spark, d, "cat_fks").select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))).alias("x")).select("x.a", "x.b").distinct()
    return G.expand(start, links, depth=2)


QUERIES = {f.__name__: f for f in (
    catalog_chunks, value_chunks, catalog_nodes, structural_edges, dangling_fks, fk_neighbours, text_columns, node_texts, schema_contexts, current_edges,
    graph_stats, enrichment_summary, ppr_fixed_k, ppr_converged, graph_ranked, gap_prune, fk_bridge, fk_expand,
)}

_N = "n AS (SELECT * FROM kg_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY enriched_at DESC) = 1)"
_E = "e AS (SELECT * FROM kg_edges QUALIFY row_number() OVER (PARTITION BY src_id, dst_id, edge_type ORDER BY built_at DESC, weight DESC) = 1)"
_FK = """fk AS (SELECT f.db_id, a.table_name AS ft, b.table_name AS tt, concat_ws('.', a.db_id, a.table_name, a.column_name) AS fn, concat_ws('.', b.db_id, b.table_name, b.column_name) AS tn FROM cat_fks f
    JOIN cat_columns a ON f.db_id = a.db_id AND lower(f.from_table) = lower(a.table_name) AND lower(f.from_column) = lower(a.column_name) JOIN cat_columns b ON f.db_id = b.db_id AND lower(f.to_table) = lower(b.table_name) AND lower(f.to_column) = lower(b.column_name))"""
_NAME = r"""(?:[\p{L}_][\p{L}\p{N}_$]*|"[^"]*(?:"|$)|`[^`]*(?:`|$)|\[[^\]]*(?:\]|$))"""
#: Source tables of dev examples: dev(example_id, db_id, t).
_DEV = EX + rf""", dv AS (SELECT example_id, db_id, unnest(regexp_extract_all(regexp_replace(sql, '(''[^'']*(?:''''[^'']*)*(?:''|$)|"[^"]*(?:"|$)|`[^`]*(?:`|$)|\[[^\]]*(?:\]|$))|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\**(?:\*/|/|$)', '\1 ', 'g'),
    '(?i)\b(?:from|join)\s+{_NAME}(?:\s*\.\s*{_NAME})*|''[^'']*(?:''''[^'']*)*(?:''|$)|"[^"]*(?:"|$)|`[^`]*(?:`|$)|\[[^\]]*(?:\]|$)|[\p{{L}}_][\p{{L}}\p{{N}}_$]*')) AS h FROM ex WHERE split = 'dev'),
    dev AS (SELECT DISTINCT example_id, db_id, lower(trim(regexp_replace(list_last(regexp_extract_all(regexp_replace(h, '(?is)^(?:from|join)\s+', ''), '{_NAME}')), '^["`\[]|["`\]]$', '', 'g'))) AS t FROM dv WHERE regexp_matches(h, '(?is)^(?:from|join)\s+.'))"""


def _ppr_sql(rounds: int, alpha: float = 0.7, own_seeds: bool = False) -> str:
    """Chained CTEs: r0 .. rN(query_id, node_id, r); with ``own_seeds`` nodes, edges and seeds stand before them."""
    p = "w AS (SELECT src_id AS src, dst_id AS dst, sum(weight) AS w FROM e GROUP BY ALL HAVING sum(weight) > 0), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w)"
    out = [f"{p}, r0 AS (SELECT query_id, node_id, s AS r FROM seeds)"] if own_seeds else [f"""{_N}, {_E}, w AS (SELECT src_id AS src, dst_id AS dst, sum(weight) AS w FROM e GROUP BY ALL HAVING sum(weight) > 0), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w),
    c AS (SELECT n.db_id AS query_id, n.node_id, g.score FROM n JOIN (SELECT src_id AS node_id, round(sum(weight), 6) AS score FROM e GROUP BY 1) g USING (node_id) WHERE n.node_type <> 'database'),
    tops AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5),
    seeds AS MATERIALIZED (SELECT query_id, node_id, greatest(score, 1e-9) / sum(greatest(score, 1e-9)) OVER (PARTITION BY query_id) AS s FROM tops), r0 AS (SELECT query_id, node_id, s AS r FROM seeds)"""]
    for i in range(1, rounds + 1):
        out.append(f"""m{i} AS MATERIALIZED (SELECT query_id, dst AS node_id, sum(r * p) AS r FROM r{i - 1} JOIN p ON node_id = src GROUP BY ALL),
    r{i} AS MATERIALIZED (SELECT query_id, node_id, sum(r) AS r FROM (SELECT query_id, node_id, {alpha}::DOUBLE * r AS r FROM m{i} UNION ALL
        SELECT s.query_id, s.node_id, s * (1 - {alpha}::DOUBLE * coalesce(k, 0)) FROM seeds s LEFT JOIN (SELECT query_id, sum(r) AS k FROM m{i} GROUP BY 1) q USING (query_id)) GROUP BY ALL)""")
    return ", ".join(out)


_PPR = f"WITH {_ppr_sql(8)}, f AS (SELECT query_id, node_id, round(r, 8) AS score FROM r8)"
_HITS = _PPR + ", hits AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM f SEMI JOIN (SELECT node_id FROM n WHERE node_type <> 'database') x USING (node_id) WHERE score >= 0.005 QUALIFY rank <= 15)"

ORACLE = {
    "catalog_chunks": """SELECT db_id, 'table' AS chunk_type, table_name, 'Table: ' || table_name || '. Columns: ' || string_agg(column_name, ', ' ORDER BY ordinal) AS content FROM cat_columns GROUP BY db_id, table_name
        UNION ALL SELECT db_id, 'column', table_name, 'Column: ' || table_name || '.' || column_name || ' (' || coalesce(dtype, '') || ')' || CASE WHEN is_pk THEN ' [PK]' ELSE '' END || '.' || CASE WHEN coalesce(description, '') <> '' THEN ' Description: ' || description ELSE '' END FROM cat_columns
        UNION ALL SELECT db_id, 'fk', from_table, 'FK: ' || from_table || '.' || from_column || ' → ' || to_table || '.' || to_column FROM cat_fks""",
    "value_chunks": f"WITH {_N} SELECT db_id, 'value' AS chunk_type, table_name, 'Values of ' || table_name || '.' || column_name || ': ' || array_to_string(sample_values[1:5], ', ') AS content FROM n WHERE node_type = 'column' AND len(sample_values) > 0",
    "catalog_nodes": """SELECT DISTINCT db_id AS node_id, 'database' AS node_type, db_id, NULL AS table_name, NULL AS column_name, NULL AS dtype, NULL AS is_pk FROM cat_columns UNION ALL
        SELECT DISTINCT db_id || '.' || table_name, 'table', db_id, table_name, NULL, NULL, NULL FROM cat_columns UNION ALL SELECT concat_ws('.', db_id, table_name, column_name), 'column', db_id, table_name, column_name, dtype, is_pk FROM cat_columns""",
    "structural_edges": f"""WITH {_FK}, t AS (SELECT DISTINCT db_id, ft, tt FROM fk) SELECT DISTINCT db_id AS src, db_id || '.' || table_name AS dst, 'db_has_table' AS edge_type, 1.0::DOUBLE AS weight FROM cat_columns
        UNION ALL SELECT db_id || '.' || table_name, concat_ws('.', db_id, table_name, column_name), 'table_has_column', 1.0 FROM cat_columns UNION ALL SELECT concat_ws('.', db_id, table_name, column_name), db_id || '.' || table_name, 'column_belongs_to', 1.0 FROM cat_columns
        UNION ALL SELECT concat_ws('.', db_id, table_name, column_name), db_id || '.' || table_name, 'primary_key_of', 1.0 FROM cat_columns WHERE is_pk UNION ALL SELECT fn, tn, 'foreign_key', 0.95 FROM fk UNION ALL SELECT tn, fn, 'foreign_key_rev', 0.95 FROM fk
        UNION ALL SELECT db_id || '.' || ft, db_id || '.' || tt, 'table_fk', 0.85 FROM t UNION ALL SELECT db_id || '.' || tt, db_id || '.' || ft, 'table_fk_rev', 0.85 FROM t""",
    "dangling_fks": f"WITH {_FK} SELECT db_id, count(*) AS n_fks, coalesce(any_value(k), 0) AS n_resolved FROM cat_fks LEFT JOIN (SELECT db_id, count(*) AS k FROM fk GROUP BY 1) USING (db_id) GROUP BY db_id",
    "fk_neighbours": "WITH b AS (SELECT DISTINCT db_id, lower(from_table) AS t, lower(to_table) AS n FROM cat_fks UNION SELECT db_id, lower(to_table), lower(from_table) FROM cat_fks) SELECT db_id, t AS table_name, string_agg(n, ' ' ORDER BY n) AS neighbours FROM b WHERE t <> n GROUP BY ALL",
    "text_columns": f"SELECT db_id, count(*) FILTER (coalesce(trim(dtype) = '' OR regexp_matches(upper(trim(dtype)), '^({'|'.join(C.TEXT_PREFIXES)})'), true)) AS n_text_prefix, count(*) FILTER (lower(trim(string_split(dtype, '(')[1])) IN ({', '.join(repr(t) for t in C.TEXT_TYPES)})) AS n_text_type FROM cat_columns GROUP BY db_id",
    "node_texts": f"""WITH {_N} SELECT node_id, CASE node_type WHEN 'table' THEN concat_ws(' ', 'Table: ' || table_name, '— ' || nullif(description, '')) WHEN 'column' THEN concat_ws(' ', 'Column: ' || table_name || '.' || column_name, '(' || nullif(dtype, '') || ')', CASE WHEN is_pk THEN '[PK]' END, CASE WHEN is_fk THEN '[FK]' END,
        '— ' || nullif(description, ''), CASE WHEN len(sample_values) > 0 THEN '[e.g. ' || array_to_string(['''' || v || '''' FOR v IN sample_values[1:3]], ', ') || ']' END) ELSE node_id END AS content FROM n""",
    "schema_contexts": f"""WITH {_DEV}, l AS (SELECT example_id, t, 'CREATE TABLE ' || any_value(c.table_name) || ' (' || string_agg(column_name || ' (' || coalesce(dtype, '') || ')' || CASE WHEN is_pk THEN ' [PK]' ELSE '' END, ', ' ORDER BY ordinal) || ')' AS line FROM dev JOIN cat_columns c ON dev.db_id = c.db_id AND t = lower(c.table_name) GROUP BY ALL),
        x AS (SELECT example_id, string_agg(line, chr(10) ORDER BY t) AS tables FROM l GROUP BY 1), f AS (SELECT DISTINCT example_id, '  ' || from_table || '.' || from_column || ' = ' || to_table || '.' || to_column AS ref FROM dev JOIN cat_fks k ON dev.db_id = k.db_id AND (t = lower(from_table) OR t = lower(to_table))),
        y AS (SELECT example_id, string_agg(ref, chr(10) ORDER BY ref) AS refs FROM f GROUP BY 1) SELECT example_id AS query_id, concat_ws(chr(10), tables, 'Foreign Keys:' || chr(10) || refs) AS context FROM x LEFT JOIN y USING (example_id)""",
    "current_edges": f"WITH {_E} SELECT src_id, dst_id, edge_type, weight, built_at FROM e",
    "graph_stats": f"WITH {_N}, {_E} SELECT 'edge ' || edge_type AS kind, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM e GROUP BY edge_type UNION ALL SELECT 'node ' || node_type, count(*), round(count(*) FILTER (coalesce(description, '') <> '') / count(*), 6) FROM n GROUP BY node_type",
    "enrichment_summary": f"WITH {_N} SELECT db_id, count(*) AS n_nodes, count(*) FILTER (coalesce(description, '') <> '') AS n_described, count(*) FILTER (coalesce(len(synonyms), 0) > 0) AS n_with_synonyms, count(*) FILTER (len(embedding) > 0) AS n_embedded FROM n GROUP BY db_id",
    "ppr_fixed_k": _PPR + " SELECT query_id, node_id, score FROM f",
    "ppr_converged": f"WITH {_ppr_sql(45)} SELECT query_id, node_id, round(r, 5) AS score FROM r45 WHERE round(r, 5) > 0",
    "graph_ranked": _HITS + " SELECT * FROM hits",
    "gap_prune": _HITS + ", g AS (SELECT *, rank > 2 AND lag(score) OVER (PARTITION BY query_id ORDER BY rank) > 1.5 * score AS gap FROM hits) SELECT query_id, node_id, score, rank FROM g QUALIFY NOT bool_or(coalesce(gap, false)) OVER (PARTITION BY query_id ORDER BY rank)",
    "fk_bridge": _HITS + """, col AS (SELECT node_id, db_id || '.' || table_name AS parent FROM n WHERE node_type = 'column'), h AS (SELECT * FROM hits SEMI JOIN col USING (node_id)), b AS (SELECT query_id, min(score) / 2 AS s FROM h GROUP BY 1),
        t AS (SELECT DISTINCT query_id, parent AS node_id FROM h JOIN e ON h.node_id = e.src_id AND edge_type = 'foreign_key' JOIN col ON col.node_id = e.dst_id), m AS (SELECT t.query_id, t.node_id, s FROM t JOIN b ON t.query_id = b.query_id ANTI JOIN h ON t.query_id = h.query_id AND t.node_id = h.node_id)
        SELECT query_id, node_id, round(s, 8) AS score FROM m UNION ALL SELECT m.query_id, col.node_id, round(s * 0.8, 8) FROM m JOIN col ON m.node_id = col.parent ANTI JOIN h ON m.query_id = h.query_id AND col.node_id = h.node_id""",
    "fk_expand": f"""WITH {_DEV}, s AS (SELECT DISTINCT example_id AS q, db_id || '.' || t AS t FROM dev), l AS (SELECT db_id || '.' || lower(from_table) AS a, db_id || '.' || lower(to_table) AS b FROM cat_fks UNION SELECT db_id || '.' || lower(to_table), db_id || '.' || lower(from_table) FROM cat_fks),
        a1 AS (SELECT q, b AS t FROM s JOIN l ON t = a), a2 AS (SELECT q, b AS t FROM a1 JOIN l ON t = a), u AS (SELECT q, t, 0 AS h FROM s UNION ALL SELECT q, t, 1 FROM a1 UNION ALL SELECT q, t, 2 FROM a2) SELECT q AS query_id, t AS table_id, min(h)::INT AS hops FROM u GROUP BY ALL""",
}
