"""Retrieval over the schema graph and over the catalog's text, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.operators import catalog as C
from querymill.operators import graph as G
from querymill.operators import linking as L
from querymill.operators import retrieval as R
from querymill.operators import stats as S
from querymill.plans.common import EX, examples
from querymill.plans.graph import _E, _N, _edges, _nodes, _parents, _ppr_sql
from querymill.plans.stats import _NPMI, _QTOK, _bm25_sql, _ranked, npmi_matrix
from querymill.session import table


def _usable(spark, d):
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0)
    return _nodes(spark, d).withColumn("vec", F.when(ok, F.col("embedding")))


def _queries(spark, d):
    """Stated queries: of each database the first column with a vector; its name gives the tokens."""
    tok = F.array_distinct(T.name_tokens(F.concat_ws(" ", "table_name", "column_name")))
    one = G.keep_first(_usable(spark, d).where("node_type = 'column' and vec is not null"), ["db_id"], ["node_id"])
    return one.select(F.col("db_id").alias("query_id"), "db_id", "vec", tok.alias("tokens"))


def _points(spark, d):
    return L.entry_points(_queries(spark, d), _usable(spark, d).where("node_type in ('table', 'column')").select("node_id", "db_id", "vec", "synonyms"))


def entry_points(spark, d):
    return _points(spark, d).select("query_id", "node_id", F.round("score", 6).alias("score"))


def first_nodes(spark, d):
    return L.first_nodes(_usable(spark, d).select("node_id", "db_id", "vec"))


def _boosted(spark, d):
    """Columns whose name shares half of its tokens with the query stand for matched values."""
    tok = F.array_distinct(T.name_tokens(F.concat_ws(" ", "table_name", "column_name")))
    cols = _nodes(spark, d).where("node_type = 'column'").select("db_id", "node_id", F.concat_ws(".", "db_id", "table_name").alias("parent_id"), tok.alias("own"))
    hit = _queries(spark, d).select("query_id", "db_id", "tokens").join(cols, "db_id").select("query_id", "node_id", "parent_id", S.set_jaccard(F.col("own"), F.col("tokens")).alias("score")).where("score >= 0.5")
    return L.boosted(_points(spark, d), L.value_boosts(hit))


def boosted_points(spark, d):
    return _boosted(spark, d).select("query_id", "node_id", F.round("score", 6).alias("score"))


def _personal(spark, d):
    fk = _nodes(spark, d).where("node_type = 'column' and is_fk").select("node_id", F.concat_ws(".", "db_id", "table_name").alias("parent_id"))
    return G.personalization(_boosted(spark, d).select("query_id", "node_id", F.round("score", 6).alias("score")), parents=fk)


def personalization(spark, d):
    return _personal(spark, d).select("query_id", "node_id", F.round("s", 6).alias("weight"))


def _found(spark, d):
    n = _nodes(spark, d)
    p = G.transitions(_edges(spark, d)).join(n.select(F.col("node_id").alias("src"), F.col("db_id").alias("grp")), "src").select("grp", "src", "dst", "p")
    n_tables = n.where("node_type = 'table'").groupBy(F.col("db_id").alias("query_id")).agg(F.count("*").alias("n_tables"))
    fk = _edges(spark, d).where("edge_type = 'foreign_key'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return L.retrieved(p, _personal(spark, d).withColumn("grp", F.col("query_id")), n.where("node_type <> 'database'"), n_tables, fk, _parents(spark, d), fixed=8)


def graph_retrieved(spark, d):
    return _found(spark, d)


def retrieved_tables(spark, d):
    return L.retrieved_tables(_found(spark, d), _nodes(spark, d)).select("query_id", "table_name", "score", "place")


def prompt_contexts(spark, d):
    """The schema text of what was retrieved, with the columns that show and their references."""
    hits, n = G.cut(_found(spark, d)), _nodes(spark, d)
    shown = G.cut(L.visible_columns(L.retrieved_tables(hits, n).select("query_id", "db_id", "table_name", "place"), hits, n))
    links = _edges(spark, d).where("edge_type = 'foreign_key'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return L.prompt_context(shown, links)


def _catalog_docs(spark, d):
    text = F.lower(F.concat_ws(" ", "table_name", "column_name", "description"))
    return table(spark, d, "cat_columns").select(F.concat_ws(".", "db_id", "table_name", "column_name").alias("doc_id"), "db_id", T.matches(text, "[a-z0-9]+").alias("terms")).distinct()


def _asked(spark, d):
    return examples(spark, d, "db_id", "question").where("db_id is not null").select(F.col("example_id").alias("query_id"), "db_id", T.matches(F.lower("question"), "[a-z0-9]+").alias("terms"))


def _dense(spark, d, k):
    v = lambda df, i: df.select(i, "db_id", L.hashed_vector(F.col("terms")).alias("vec"))
    return R.cosine_top_k(v(_asked(spark, d), "query_id"), v(_catalog_docs(spark, d), "doc_id"), k=k, same=["db_id"])


def dense_topk(spark, d):
    """Columns of a question's own database by cosine of hashed term vectors."""
    return _dense(spark, d, 5)


def _npmi_list(spark, d, k):
    q = examples(spark, d, "db_id", "question").where("db_id is not null").select(F.col("example_id").alias("query_id"), "db_id", F.explode(T.question_tokens(F.col("question"))).alias("token"))
    cand = table(spark, d, "cat_columns").select("db_id", F.lower("table_name").alias("element"), F.concat_ws(".", "db_id", "table_name", "column_name").alias("candidate_id"))
    # a question's score of a table first, then the columns of that table in its own database
    best = q.join(npmi_matrix(spark, d).select("token", "element", "npmi"), "token").groupBy("query_id", "db_id", "element").agg(F.max("npmi").alias("score")).where("score > 0")
    return R.top_k(best.join(cand, ["db_id", "element"]).select("query_id", F.col("candidate_id").alias("doc_id"), "score"), k)


def hybrid_retrieved(spark, d):
    """BM25, dense and NPMI lists of a question's database, fused by reciprocal ranks."""
    lists = [(R.bm25(_asked(spark, d), _catalog_docs(spark, d), k=30, same=["db_id"]), 1.0), (_dense(spark, d, 30), 1.0), (_npmi_list(spark, d, 30), 1.0)]
    return R.rrf(lists, top=10).select("query_id", "doc_id", "score", "n_lists", "rank")


def expanded_chunks(spark, d):
    """Table chunks that each statement reads and those one reference further, each once."""
    cols, fks = table(spark, d, "cat_columns"), table(spark, d, "cat_fks")
    chunks = C.chunks(cols, fks).where("chunk_type = 'table'").withColumn("table_name", F.lower("table_name"))
    read = examples(spark, d, "db_id", "sql").select(F.col("example_id").alias("query_id"), "db_id", F.explode(T.sql_tables(F.col("sql"))).alias("table_name"))
    found = read.join(chunks, ["db_id", "table_name"]).select("query_id", "chunk_type", "table_name", "content")
    a, b = F.lower("from_table"), F.lower("to_table")
    links = fks.select("db_id", F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))).alias("x")).select("db_id", F.col("x.a").alias("table_name"), F.col("x.b").alias("next")).distinct()
    more = read.join(links, ["db_id", "table_name"]).select("query_id", "db_id", F.col("next").alias("table_name")).distinct()
    return L.with_neighbours(chunks, more, found).select("query_id", "table_name", "content", "first")


QUERIES = {f"link_{f.__name__}": f for f in (
    entry_points, first_nodes, boosted_points, personalization, graph_retrieved, retrieved_tables, prompt_contexts, dense_topk, hybrid_retrieved, expanded_chunks,
)}

_NT = "[x FOR x IN list_distinct(regexp_split_to_array(lower(regexp_replace(table_name || ' ' || column_name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_\\s]+')) IF x <> '']"
_U = "u AS (SELECT *, CASE WHEN len(embedding) = 64 AND list_sum([abs(x) FOR x IN embedding]) > 0 THEN embedding::DOUBLE[] END AS e FROM n)"
_POINTS = f"""{_U}, qs AS (SELECT db_id AS query_id, db_id, e AS vec, {_NT} AS tokens FROM u WHERE node_type = 'column' AND e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY node_id) = 1),
    near AS (SELECT query_id, node_id, synonyms, tokens, round(list_cosine_similarity(vec, e), 6) AS c FROM qs JOIN u USING (db_id) WHERE u.node_type IN ('table', 'column') AND e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, node_id) <= 10),
    bst AS (SELECT query_id, node_id, CASE WHEN len(list_intersect([lower(trim(s)) FOR s IN synonyms], tokens)) > 0 THEN least(c + 0.3::DOUBLE, 1) ELSE c END AS score FROM near),
    points AS (SELECT * FROM bst QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5),
    vm AS (SELECT query_id, node_id, db_id || '.' || table_name AS parent_id, len(list_intersect(own, tokens)) / len(list_distinct(list_concat(own, tokens))) AS score FROM (SELECT query_id, tokens, n.node_id, n.db_id, n.table_name, {_NT.replace('table_name', 'n.table_name').replace('column_name', 'n.column_name')} AS own FROM qs JOIN n USING (db_id) WHERE node_type = 'column')),
    vb AS (SELECT query_id, node_id, max(score) * 0.5 AS boost FROM vm WHERE score >= 0.5 GROUP BY ALL UNION ALL SELECT query_id, parent_id, max(score) * 0.3 FROM vm WHERE score >= 0.5 GROUP BY ALL),
    boosted AS (SELECT query_id, node_id, round(least(coalesce(score, 0) + coalesce(boost, 0), 1), 6) AS score FROM points FULL JOIN vb USING (query_id, node_id)),
    top5 AS (SELECT query_id, node_id, greatest(score, 1e-9) AS s FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5),
    par AS (SELECT query_id, db_id || '.' || table_name AS node_id, max(s) / 2 AS s FROM top5 JOIN (SELECT * FROM n WHERE node_type = 'column' AND is_fk) k USING (node_id) GROUP BY ALL),
    pall AS (SELECT * FROM top5 UNION ALL SELECT * FROM par ANTI JOIN top5 USING (query_id, node_id)),
    seeds AS MATERIALIZED (SELECT query_id, node_id, s / sum(s) OVER (PARTITION BY query_id) AS s FROM pall)"""
_HEAD = f"WITH {_N}, {_E}, {_POINTS}"
_FOUND = f"""{_HEAD}, {_ppr_sql(8, own_seeds=True)}, f AS (SELECT query_id, node_id, round(r, 8) AS score FROM r8), nt AS (SELECT db_id AS query_id, count(*) AS n_tables FROM n WHERE node_type = 'table' GROUP BY 1),
    hits AS MATERIALIZED (SELECT query_id, node_id, score FROM f SEMI JOIN (SELECT node_id FROM n WHERE node_type <> 'database') x USING (node_id) JOIN nt USING (query_id) WHERE score >= 0.005 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= least(15, greatest(6, n_tables))),
    col AS (SELECT node_id, db_id || '.' || table_name AS parent FROM n WHERE node_type = 'column'), h AS (SELECT * FROM hits SEMI JOIN col USING (node_id)), b AS (SELECT query_id, min(score) / 2 AS s FROM h GROUP BY 1),
    t AS (SELECT DISTINCT query_id, parent AS node_id FROM h JOIN e ON h.node_id = e.src_id AND edge_type = 'foreign_key' JOIN col ON col.node_id = e.dst_id), m AS (SELECT t.query_id, t.node_id, s FROM t JOIN b ON t.query_id = b.query_id ANTI JOIN h ON t.query_id = h.query_id AND t.node_id = h.node_id),
    br AS (SELECT query_id, node_id, round(max(score), 8) AS score FROM (SELECT query_id, node_id, s AS score FROM m UNION ALL SELECT m.query_id, col.node_id, s * 0.8::DOUBLE FROM m JOIN col ON m.node_id = col.parent) ANTI JOIN hits USING (query_id, node_id) GROUP BY ALL),
    al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM (SELECT * FROM hits UNION ALL SELECT * FROM br)), g AS (SELECT al.*, rank > 2 AND lag(score) OVER (PARTITION BY query_id ORDER BY rank) > CASE WHEN n_tables >= 10 OR n_tables <= 4 THEN 4.5 ELSE 3.0 END::DOUBLE * score AS gap FROM al JOIN nt USING (query_id)),
    found AS MATERIALIZED (SELECT query_id, node_id, score, rank FROM g QUALIFY NOT bool_or(coalesce(gap, false)) OVER (PARTITION BY query_id ORDER BY rank)),
    ta AS (SELECT query_id, db_id, table_name, max(score) AS score, min(rank) AS r FROM found JOIN n USING (node_id) WHERE table_name IS NOT NULL GROUP BY ALL), tabs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, table_name)::INT AS place FROM ta)"""
_CATDOCS = "SELECT DISTINCT concat_ws('.', db_id, table_name, column_name) AS doc_id, db_id, regexp_extract_all(lower(concat_ws(' ', table_name, column_name, description)), '[a-z0-9]+') AS terms FROM cat_columns"
_ASKED = "SELECT example_id AS query_id, db_id, coalesce(regexp_extract_all(lower(question), '[a-z0-9]+'), []) AS terms FROM ex WHERE db_id IS NOT NULL"
_VEC = "[len([t FOR t IN terms IF ('0x' || md5(t)[1:8])::BIGINT % 64 = i])::DOUBLE FOR i IN range(64)]"
_DENSE = f"dq AS MATERIALIZED (SELECT query_id, db_id, {_VEC} AS v FROM q WHERE len(terms) > 0), dd AS MATERIALIZED (SELECT doc_id, db_id, {_VEC} AS w FROM d WHERE len(terms) > 0), dh AS (SELECT query_id, doc_id, round(list_cosine_similarity(v, w), 6) AS score FROM dq JOIN dd USING (db_id))"

ORACLE = {
    "link_entry_points": _HEAD + " SELECT query_id, node_id, round(score, 6) AS score FROM points",
    "link_first_nodes": f"WITH {_N}, {_U}, bare AS (SELECT db_id FROM u GROUP BY 1 HAVING count(e) = 0) SELECT db_id AS query_id, node_id, 0.0::DOUBLE AS score, row_number() OVER (PARTITION BY db_id ORDER BY node_id)::INT AS rank FROM u SEMI JOIN bare USING (db_id) QUALIFY rank <= 15",
    "link_boosted_points": _HEAD + " SELECT * FROM boosted",
    "link_personalization": _HEAD + " SELECT query_id, node_id, round(s, 6) AS weight FROM seeds",
    "link_graph_retrieved": _FOUND + " SELECT * FROM found",
    "link_retrieved_tables": _FOUND + " SELECT query_id, table_name, score, place FROM tabs",
    "link_prompt_contexts": _FOUND + """, vis AS (SELECT t.query_id, place, t.table_name, column_name, c.node_id, coalesce(is_pk, false) AS is_pk, coalesce(is_fk, false) AS is_fk, f.node_id IS NOT NULL AS hit, bool_or(f.node_id IS NOT NULL) OVER (PARTITION BY t.query_id, t.table_name) AS any_hit FROM tabs t JOIN n c ON c.node_type = 'column' AND c.db_id = t.db_id AND c.table_name = t.table_name LEFT JOIN found f ON f.query_id = t.query_id AND f.node_id = c.node_id),
        shown AS (SELECT * FROM vis WHERE NOT any_hit OR hit OR is_pk OR is_fk), l AS (SELECT query_id, place, 'CREATE TABLE ' || table_name || ' (' || string_agg(column_name || CASE WHEN is_pk THEN ' [PK]' ELSE '' END || CASE WHEN is_fk THEN ' [FK]' ELSE '' END, ', ' ORDER BY column_name) || ');' AS line FROM shown GROUP BY query_id, place, table_name),
        tx AS (SELECT query_id, string_agg(line, chr(10) ORDER BY place) AS tables FROM l GROUP BY 1), rf AS (SELECT DISTINCT query_id, '-- ' || src_id || ' = ' || dst_id AS ref FROM shown JOIN e ON edge_type = 'foreign_key' AND (node_id = src_id OR node_id = dst_id)), ry AS (SELECT query_id, string_agg(ref, chr(10) ORDER BY ref) AS refs FROM rf GROUP BY 1)
        SELECT query_id, concat_ws(chr(10), tables, refs) AS context FROM tx LEFT JOIN ry USING (query_id)""",
    "link_dense_topk": f"WITH {EX}, q AS ({_ASKED}), d AS ({_CATDOCS}), {_DENSE} {_ranked('dh', 5)}",
    "link_hybrid_retrieved": f"""{_NPMI}, {_bm25_sql(_ASKED, _CATDOCS, 'db_id').replace(' n AS', ' nn AS')}, {_DENSE}, l1 AS ({_ranked('hits', 30)}), l2 AS ({_ranked('dh', 30)}), nq AS (SELECT example_id AS query_id, db_id, unnest({_QTOK}) AS token FROM ex WHERE db_id IS NOT NULL), nb AS (SELECT query_id, db_id, element, max(npmi) AS score FROM nq JOIN m USING (token) GROUP BY ALL HAVING max(npmi) > 0),
        nh AS (SELECT query_id, concat_ws('.', c.db_id, table_name, column_name) AS doc_id, score FROM nb JOIN cat_columns c ON nb.db_id = c.db_id AND element = lower(table_name)), l3 AS ({_ranked('nh', 30)}), f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, count(*) AS n_lists FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY ALL) {_ranked('f', 10)}""",
    "link_expanded_chunks": f"""WITH {EX}, c AS (SELECT db_id, lower(table_name) AS t, 'Table: ' || table_name || '. Columns: ' || string_agg(column_name, ', ' ORDER BY ordinal) AS content FROM cat_columns GROUP BY db_id, table_name), r AS (SELECT DISTINCT example_id, db_id, unnest([x FOR x IN regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)', 1)]) AS t FROM ex),
        k AS (SELECT db_id, lower(from_table) AS a, lower(to_table) AS b FROM cat_fks UNION SELECT db_id, lower(to_table), lower(from_table) FROM cat_fks), x AS (SELECT example_id, db_id, t, 0 AS first FROM r UNION ALL SELECT DISTINCT example_id, r.db_id, b, 1 FROM r JOIN k ON r.db_id = k.db_id AND r.t = k.a)
        SELECT example_id AS query_id, x.t AS table_name, content, min(first)::INT AS first FROM x JOIN c ON x.db_id = c.db_id AND x.t = c.t GROUP BY ALL""",
}
