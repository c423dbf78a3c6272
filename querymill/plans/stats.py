"""Statistics and retrieval over examples, catalog, nodes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.operators import retrieval as R
from querymill.operators import stats as S
from querymill.operators.fuzzy import value_matches
from querymill.plans.common import EX, examples, listed
from querymill.session import table


def _tokens(spark, d):
    return examples(spark, d, "question").select(F.col("example_id").alias("id"), F.explode(T.question_tokens(F.col("question"))).alias("token"))


def _elements(spark, d):
    return examples(spark, d, "sql").select(F.col("example_id").alias("id"), F.explode(T.sql_tables(F.col("sql"))).alias("element"))


def npmi_matrix(spark, d):
    return S.npmi(_tokens(spark, d), _elements(spark, d), min_count=3)


def npmi_scored(spark, d):
    """Catalog tables by npmi for the held-out questions."""
    q = examples(spark, d, "question", "split").where("split = 'test'").select(F.col("example_id").alias("query_id"), F.explode(T.question_tokens(F.col("question"))).alias("token"))
    c = table(spark, d, "cat_columns").select(F.lower("table_name").alias("element")).distinct().withColumn("candidate_id", F.col("element"))
    hits = S.npmi_scores(q, c, npmi_matrix(spark, d).select("token", "element", "npmi"))
    return R.top_k(hits, 5, tie="candidate_id").select("query_id", "candidate_id", "score", "rank")


def cooccurring_tables(spark, d):
    rows = examples(spark, d, "db_id", "sql").select("db_id", "example_id", F.explode(T.sql_tables(F.col("sql"))).alias("t"))
    return S.pair_jaccard(rows, group="db_id", key="example_id", item="t", threshold=0.1).select("db_id", "item_a", "item_b", "n_both", F.round("jaccard", 6).alias("jaccard"), F.round(F.least("jaccard", F.lit(0.5)), 6).alias("weight"))


def cooccurring_parts(spark, d):
    """Event types that the same users have."""
    ev = table(spark, d, "events").select(F.lit("all").alias("g"), "user_id", "event_type")
    out = S.pair_jaccard(ev, group="g", key="user_id", item="event_type", threshold=0.1)
    return S.both_ways(out.select("item_a", "item_b", F.round("jaccard", 6).alias("jaccard")), "item_a", "item_b")


#: Key and label columns of the star schema, with the declared references among them.
STAR = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_regionkey", "n_name"], "customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_nationkey"],
        "part": ["p_partkey", "p_brand", "p_size"], "orders": ["o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]}
STAR_FKS = [("n_regionkey", "r_regionkey"), ("c_nationkey", "n_nationkey"), ("s_nationkey", "n_nationkey"), ("c_custkey", "o_custkey"), ("l_partkey", "p_partkey")]


def _values(spark, d):
    """Distinct values of the star schema's columns as text; one scan of each table."""
    out = None
    for t, cols in STAR.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols]))
        part = table(spark, d, t).select(pairs.alias("x")).select(F.lit("star").alias("db_id"), "x.col", "x.value").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def value_overlap(spark, d):
    return S.value_overlap(_values(spark, d)).select("db_id", "col_a", "col_b", "n_shared", F.round("jaccard", 6).alias("jaccard"), "shared")


def inferred_fk(spark, d):
    """Column pairs of different tables with half of their values in common (three at least) and no declared key between them."""
    pairs = S.value_overlap(_values(spark, d), threshold=0.5, min_shared=3)
    out = pairs.where(F.substring("col_a", 1, 1) != F.substring("col_b", 1, 1))
    fk = spark.createDataFrame([tuple(sorted(p)) for p in STAR_FKS], "col_a string, col_b string")
    return out.join(fk, ["col_a", "col_b"], "left_anti").select("db_id", "col_a", "col_b", "n_shared", F.round("jaccard", 6).alias("jaccard"), F.lit(0.95).alias("weight"))


def _names(spark, d):
    cat = table(spark, d, "cat_columns")
    tok = F.array_distinct(T.name_tokens(F.concat_ws(" ", "table_name", "column_name")))
    return cat.select("db_id", F.concat_ws(".", "table_name", "column_name").alias("col"), "table_name", tok.alias("toks")).distinct()


def lexical_edges(spark, d):
    """Columns of different tables of a database whose name tokens overlap; sharing generic tokens alone counts half."""
    n = _names(spark, d)
    ex = n.select("db_id", "col", "table_name", "toks", F.explode("toks").alias("tok"))
    a = ex.select("db_id", "tok", F.col("col").alias("a"), F.col("table_name").alias("ta"), F.col("toks").alias("xa"))
    b = ex.select("db_id", "tok", F.col("col").alias("b"), F.col("table_name").alias("tb"), F.col("toks").alias("xb"))
    pairs = a.join(b, ["db_id", "tok"]).where("a < b and ta <> tb").where(F.element_at(F.array_intersect("xa", "xb"), 1) == F.col("tok"))
    generic = F.size(T.without(F.array_intersect("xa", "xb"), T.IDENTIFIER_STOPWORDS)) == 0
    score = S.set_jaccard(F.col("xa"), F.col("xb"))
    out = pairs.where(score >= 0.4).select("db_id", "a", "b", (score * F.when(generic, 0.5).otherwise(1.0)).alias("s"))
    return out.where("s >= 0.4").select("db_id", F.col("a").alias("col_a"), F.col("b").alias("col_b"), F.round(F.least("s", F.lit(0.7)), 6).alias("weight"))


def synonym_edges(spark, d):
    """Nodes of a database whose synonym tokens overlap: shared without generic tokens / larger bag, 0.3 at least."""
    bag = F.array_sort(F.array_distinct(F.flatten(F.transform("synonyms", T.synonym_tokens))))
    n = table(spark, d, "kg_nodes").where("synonyms is not null").select("db_id", "node_id", bag.alias("x")).where("size(x) > 0").distinct()
    ex = n.select("db_id", "node_id", "x", F.explode(T.without(F.col("x"), T.IDENTIFIER_STOPWORDS)).alias("tok"))
    a, b = ex.select("db_id", "tok", F.col("node_id").alias("a"), F.col("x").alias("xa")), ex.select("db_id", "tok", F.col("node_id").alias("b"), F.col("x").alias("xb"))
    shared = a.join(b, ["db_id", "tok"]).where("a < b").groupBy("db_id", "a", "b").agg(F.count("*").alias("n"), F.max(F.greatest(F.size("xa"), F.size("xb"))).alias("m"))
    return shared.where("n / m >= 0.3").select("db_id", F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.round(F.least(F.col("n") / F.col("m"), F.lit(0.85)), 6).alias("weight"))


def _vectors(spark, d):
    ok = (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0)
    return table(spark, d, "kg_nodes").where("embedding is not null").where(ok).select("db_id", F.col("node_id").alias("doc_id"), F.col("embedding").alias("vec")).distinct()


def embedding_edges(spark, d):
    """Nodes of one database with a cosine of 0.75 or more."""
    out = R.similar_within(_vectors(spark, d), group="db_id", least=0.75)
    return out.select("db_id", F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.least("score", F.lit(0.9)).alias("weight"))


def cosine_topk(spark, d):
    """The stated queries are the vectors with an id divisible by 20."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    q = e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    return R.cosine_top_k(q, e)


def _bm25(spark, d, k=5):
    docs = table(spark, d, "documents").select("doc_id", T.matches(F.lower("text"), "[a-z0-9]+").alias("terms"))
    q = table(spark, d, "bench_items").select(F.col("item_id").alias("query_id"), T.matches(F.lower("text"), "[a-z0-9]+").alias("terms"))
    return R.bm25(q, docs, k=k)


def bm25_topk(spark, d):
    return _bm25(spark, d)


def schema_search(spark, d):
    """BM25 over column chunks of the question's own database, statistics over all chunks."""
    cat = table(spark, d, "cat_columns")
    text = F.concat_ws(" ", "table_name", "column_name", "description")
    docs = cat.select(F.concat_ws(".", "db_id", "table_name", "column_name").alias("doc_id"), "db_id", T.matches(F.lower(text), "[a-z0-9]+").alias("terms")).distinct()
    q = examples(spark, d, "db_id", "question", "split").where("split = 'dev'").select(F.col("example_id").alias("query_id"), "db_id", T.matches(F.lower("question"), "[a-z0-9]+").alias("terms"))
    return R.bm25(q, docs, k=5, same=["db_id"])


def _overlap(spark, d, k):
    """Distinct terms that an item shares with a document."""
    terms = lambda t, i, n: table(spark, d, t).select(F.col(i).alias(n), F.explode(F.array_distinct(T.matches(F.lower("text"), "[a-z]{6,}"))).alias("term"))
    hit = terms("bench_items", "item_id", "query_id").join(terms("documents", "doc_id", "doc_id"), "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    return R.top_k(hit, k)


def rrf_fused(spark, d):
    return R.rrf([(_bm25(spark, d, 20), 1.0), (_overlap(spark, d, 20), 1.0)]).select("query_id", "doc_id", "score", "n_lists", "rank")


def rrf_weighted(spark, d):
    return R.rrf([(_bm25(spark, d, 20), 1.0), (_overlap(spark, d, 20), 0.4)], top=5).select("query_id", "doc_id", "score", "n_lists", "rank")


def multi_query(spark, d):
    """Sentences of an item are its sub-queries."""
    items = table(spark, d, "bench_items").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("subq", "part"))
    q = items.select(F.concat_ws("#", "item_id", "subq").alias("query_id"), T.matches(F.lower("part"), "[a-z0-9]+").alias("terms"))
    docs = table(spark, d, "documents").select("doc_id", T.matches(F.lower("text"), "[a-z0-9]+").alias("terms"))
    hits = R.bm25(q, docs, k=5)
    return R.retrieve_multi(hits.select(F.split("query_id", "#")[0].cast("long").alias("query_id"), "doc_id", "rank"), top=5)


def value_scan(spark, d):
    """Names of the catalog that held-out items mention, fuzzily."""
    q = table(spark, d, "bench_items").select(F.col("item_id").alias("query_id"), F.lit("all").alias("db_id"), T.value_candidates(F.col("text")).alias("candidates"))
    named = F.explode(F.array(F.struct(F.lit("table").alias("col"), F.col("table_name").alias("v")), F.struct(F.lit("column").alias("col"), F.col("column_name").alias("v"))))
    n = table(spark, d, "cat_columns").select(named.alias("x")).select(F.lit("all").alias("db_id"), "x.col", F.lower(F.regexp_replace("x.v", "_", " ")).alias("value")).distinct()
    return value_matches(q, n)


QUERIES = {f.__name__: f for f in (
    npmi_matrix, npmi_scored, cooccurring_tables, cooccurring_parts, value_overlap, inferred_fk, lexical_edges, synonym_edges, embedding_edges,
    cosine_topk, bm25_topk, schema_search, rrf_fused, rrf_weighted, multi_query, value_scan,
)}

_QTOK = f"list_distinct([x FOR x IN regexp_extract_all(lower(question), '[a-z_][a-z0-9_]*') IF length(x) > 1 AND x NOT IN ({listed(T.QUESTION_STOPWORDS)})])"
_TAB = f"list_distinct([t FOR t IN regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)', 1) IF t NOT IN ({listed(T.NO_TABLE)})])"
_NPMI = f"""WITH {EX}, t AS (SELECT example_id AS id, unnest({_QTOK}) AS token FROM ex), e AS (SELECT example_id AS id, unnest({_TAB}) AS element FROM ex),
    b AS (SELECT DISTINCT id FROM t SEMI JOIN e USING (id)), n AS (SELECT count(*)::DOUBLE AS n FROM b), nt AS (SELECT token, count(*) AS a FROM t SEMI JOIN b USING (id) GROUP BY 1), ne AS (SELECT element, count(*) AS c FROM e SEMI JOIN b USING (id) GROUP BY 1),
    m AS (SELECT token, element, k AS n_both, round(ln((k / n) / ((a / n) * (c / n))) / -ln(k / n), 4) AS npmi FROM (SELECT token, element, count(*) AS k FROM t JOIN e USING (id) GROUP BY 1, 2 HAVING count(*) >= 3) JOIN nt USING (token) JOIN ne USING (element), n WHERE k < n)"""
_STAR = " UNION ".join(f"SELECT 'star' AS db_id, '{c}' AS col, {c}::VARCHAR AS value FROM {t} WHERE {c} IS NOT NULL" for t, cols in STAR.items() for c in cols)
_VAL = f"""v AS ({_STAR}),
    n AS (SELECT db_id, col, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT a.db_id, a.col AS col_a, b.col AS col_b, count(*) AS n_shared, list_sort(list(a.value)) AS s FROM v a JOIN v b ON a.db_id = b.db_id AND a.value = b.value AND a.col < b.col GROUP BY ALL),
    j AS (SELECT p.*, n_shared / (x.n + y.n - n_shared) AS jaccard FROM p JOIN n x ON p.db_id = x.db_id AND p.col_a = x.col JOIN n y ON p.db_id = y.db_id AND p.col_b = y.col)"""
_NTOK = "list_distinct([x FOR x IN regexp_split_to_array(lower(regexp_replace(table_name || ' ' || column_name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_\\s]+') IF x <> ''])"


def _bm25_sql(queries: str, docs: str, same: str = "") -> str:
    """CTEs ending in hits(query_id, doc_id, score) for (id, terms) selects."""
    use = f", {same}" if same else ""
    on = f" AND a.{same} = p.{same}" if same else ""
    return f"""q AS ({queries}), d AS ({docs}), l AS (SELECT doc_id, coalesce(len(terms), 0) AS dl FROM d), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l),
    p AS (SELECT doc_id{use}, term, count(*) AS tf FROM (SELECT doc_id{use}, unnest(terms) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM r) ELSE idf END AS idf FROM r),
    a AS (SELECT query_id{use}, term, count(*) AS qf FROM (SELECT query_id{use}, unnest(terms) AS term FROM q) GROUP BY ALL),
    hits AS (SELECT query_id, p.doc_id, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM a JOIN i USING (term) JOIN p ON a.term = p.term{on} JOIN l ON p.doc_id = l.doc_id, st GROUP BY ALL)"""


def _ranked(source: str, k: int, tie: str = "doc_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie})::INT AS rank FROM {source} QUALIFY rank <= {k}"


_DOCS = "SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM documents"
_ITEMS = "SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM bench_items"
_BM25 = _bm25_sql(_ITEMS, _DOCS)
_FUSED = _BM25 + f""", b AS ({_ranked("hits", 20)}), oq AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}'))) AS term FROM bench_items),
    od AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}'))) AS term FROM documents), oh AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM oq JOIN od USING (term) GROUP BY ALL), o AS ({_ranked("oh", 20)})"""


def _rrf_sql(weight: float, top: int) -> str:
    return f"WITH {_FUSED}, f AS (SELECT query_id, doc_id, round(sum(s), 8) AS score, count(*) AS n_lists FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM b UNION ALL SELECT query_id, doc_id, {weight}::DOUBLE / (60 + rank) FROM o) GROUP BY ALL) {_ranked('f', top)}"


ORACLE = {
    "npmi_matrix": _NPMI + " SELECT * FROM m",
    "npmi_scored": _NPMI + f""", q AS (SELECT example_id AS query_id, unnest({_QTOK}) AS token FROM ex WHERE split = 'test'), c AS (SELECT DISTINCT lower(table_name) AS element FROM cat_columns),
        h AS (SELECT query_id, element AS candidate_id, max(npmi) AS score FROM q JOIN m USING (token) SEMI JOIN c USING (element) GROUP BY ALL HAVING max(npmi) > 0) {_ranked("h", 5, "candidate_id")}""",
    "cooccurring_tables": f"""WITH {EX}, t AS (SELECT db_id, example_id, unnest({_TAB}) AS t FROM ex), n AS (SELECT db_id, t, count(*) AS n FROM t GROUP BY ALL),
        p AS (SELECT a.db_id, a.t AS item_a, b.t AS item_b, count(*) AS n_both FROM t a JOIN t b ON a.example_id = b.example_id AND a.t < b.t GROUP BY ALL),
        j AS (SELECT p.*, n_both / (x.n + y.n - n_both) AS j FROM p JOIN n x ON p.db_id = x.db_id AND item_a = x.t JOIN n y ON p.db_id = y.db_id AND item_b = y.t)
        SELECT db_id, item_a, item_b, n_both, round(j, 6) AS jaccard, round(least(j, 0.5), 6) AS weight FROM j WHERE j >= 0.1""",
    "cooccurring_parts": """WITH e AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1), p AS (SELECT a.event_type AS a, b.event_type AS b, count(*) AS k FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL),
        j AS (SELECT a, b, k / (x.n + y.n - k) AS j FROM p JOIN n x ON a = x.event_type JOIN n y ON b = y.event_type) SELECT a AS src, b AS dst, round(j, 6) AS jaccard FROM j WHERE j >= 0.1 UNION ALL SELECT b, a, round(j, 6) FROM j WHERE j >= 0.1""",
    "value_overlap": f"WITH {_VAL} SELECT db_id, col_a, col_b, n_shared, round(jaccard, 6) AS jaccard, array_to_string(s[1:5], '|') AS shared FROM j WHERE jaccard >= 0.2 AND n_shared >= 2",
    "inferred_fk": f"""WITH {_VAL}, fk(col_a, col_b) AS (VALUES {", ".join(str(tuple(sorted(p))) for p in STAR_FKS)})
        SELECT db_id, col_a, col_b, n_shared, round(jaccard, 6) AS jaccard, 0.95::DOUBLE AS weight FROM j ANTI JOIN fk USING (col_a, col_b) WHERE jaccard >= 0.5 AND n_shared >= 3 AND col_a[1] <> col_b[1]""",
    "lexical_edges": f"""WITH n AS (SELECT DISTINCT db_id, table_name, table_name || '.' || column_name AS col, {_NTOK} AS x FROM cat_columns), p AS (SELECT a.db_id, a.col AS col_a, b.col AS col_b, list_intersect(a.x, b.x) AS s, len(a.x) + len(b.x) AS t FROM n a JOIN n b ON a.db_id = b.db_id AND a.col < b.col AND a.table_name <> b.table_name),
        j AS (SELECT db_id, col_a, col_b, len(s) / (t - len(s)) AS j, len([y FOR y IN s IF y NOT IN ({listed(T.IDENTIFIER_STOPWORDS)})]) = 0 AS generic FROM p WHERE len(s) > 0)
        SELECT db_id, col_a, col_b, round(least(j * CASE WHEN generic THEN 0.5 ELSE 1 END, 0.7), 6) AS weight FROM j WHERE j >= 0.4 AND j * CASE WHEN generic THEN 0.5 ELSE 1 END >= 0.4""",
    "synonym_edges": f"""WITH u AS (SELECT DISTINCT db_id, node_id, synonyms, unnest(synonyms) AS s FROM kg_nodes), b AS (SELECT db_id, node_id, list_distinct(flatten(list([x FOR x IN regexp_split_to_array(lower(s), '[^a-z0-9_]+') IF length(x) >= 3 AND x NOT IN ({listed(T.SYNONYM_STOPWORDS)})]))) AS x FROM u GROUP BY ALL),
        c AS (SELECT *, [y FOR y IN x IF y NOT IN ({listed(T.IDENTIFIER_STOPWORDS)})] AS g FROM b), p AS (SELECT a.db_id, a.node_id AS node_a, b.node_id AS node_b, len(list_intersect(a.g, b.g)) AS n, greatest(len(a.x), len(b.x)) AS m FROM c a JOIN c b ON a.db_id = b.db_id AND a.node_id < b.node_id)
        SELECT db_id, node_a, node_b, round(least(n / m, 0.85), 6) AS weight FROM p WHERE n > 0 AND n / m >= 0.3""",
    "embedding_edges": """WITH v AS (SELECT DISTINCT db_id, node_id, embedding::DOUBLE[] AS e FROM kg_nodes WHERE len(embedding) = 64 AND list_sum([abs(x) FOR x IN embedding]) > 0), p AS (SELECT a.db_id, a.node_id AS node_a, b.node_id AS node_b, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.db_id = b.db_id AND a.node_id < b.node_id)
        SELECT db_id, node_a, node_b, least(c, 0.9) AS weight FROM p WHERE c >= 0.75""",
    "cosine_topk": f"WITH h AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) {_ranked('h', 5)}",
    "bm25_topk": f"WITH {_BM25} {_ranked('hits', 5)}",
    "schema_search": f"""WITH {EX}, {_bm25_sql("SELECT example_id AS query_id, db_id, regexp_extract_all(lower(question), '[a-z0-9]+') AS terms FROM ex WHERE split = 'dev'", "SELECT DISTINCT concat_ws('.', db_id, table_name, column_name) AS doc_id, db_id, regexp_extract_all(lower(concat_ws(' ', table_name, column_name, description)), '[a-z0-9]+') AS terms FROM cat_columns", "db_id")} {_ranked("hits", 5)}""",
    "rrf_fused": _rrf_sql(1.0, 10),
    "rrf_weighted": _rrf_sql(0.4, 5),
    "multi_query": f"""WITH s AS (SELECT item_id, generate_subscripts(string_split(text, '. '), 1) AS k, unnest(string_split(text, '. ')) AS part FROM bench_items), {_bm25_sql("SELECT item_id || '#' || k AS query_id, regexp_extract_all(lower(part), '[a-z0-9]+') AS terms FROM s", _DOCS)}, h AS ({_ranked("hits", 5)}),
        f AS (SELECT string_split(query_id, '#')[1]::BIGINT AS query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(rank) AS best_rank FROM h GROUP BY ALL) {_ranked("f", 5)}""",
}
