"""Operators on small fixtures with results worked out by hand."""

import difflib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.functions import sqltext
from querymill.functions import text as T
from querymill.operators import execution as X
from querymill.operators import fuzzy, graph, metrics, retrieval, stats
from querymill.sources import readers, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("name, parts", [("employeeID", ["employee", "id"]), ("order_dateTime", ["order", "date", "time"]), ("a  b__c", ["a", "b", "c"]), ("", []), (None, [])])
def test_name_tokens(spark, name, parts):
    assert one(spark, T.name_tokens(F.col("n")), n=name) == parts


@pytest.mark.parametrize("sql, tables", [
    ("SELECT * FROM main.\"My Rides\" r JOIN [b c] ON 1=1 -- from x\n", ["my rides", "b c"]), ("SELECT 'from z' FROM `t`/* join q */ WHERE [from w] = 1", ["t"]),
    ("select a from t where b in (select c from u", ["t", "u"]), ("SELECT * FROM \"open", ["open"]), (None, []), ("", []),
])
def test_source_tables(spark, sql, tables):
    assert sorted(one(spark, sqltext.source_tables(F.col("s")), s=sql)) == sorted(tables)


@pytest.mark.parametrize("sql, found", [
    ("SELECT T1.a FROM t2 WHERE b = ' X y ' AND c > 3.50 AND [9] = 1 -- 77", ["1", "3.50", "x y"]), ("WHERE a = 'open 5", []), ("LIMIT 5", ["5"]), ("a = 'it''s'", ["it''s"]), (None, []),
])
def test_constants(spark, sql, found):
    assert one(spark, sqltext.constants(F.col("s")), s=sql) == found


def test_very_long_sql_does_not_overflow(spark):
    sql = "SELECT '" + "x" * 300_000 + "' FROM t /* " + "y*" * 100_000 + " */ WHERE a = 5"
    assert one(spark, sqltext.source_tables(F.col("s")), s=sql) == ["t"] and one(spark, F.size(sqltext.constants(F.col("s"))), s=sql) == 2


def test_output_parsing(spark):
    assert one(spark, T.sql_of_output(F.col("t")), t="x\n```sql\nSELECT 1\n```\n```sql\nSELECT 2\n```") == "SELECT 1"
    assert one(spark, T.sql_of_output(F.col("t")), t="why\nSQL: SELECT 3") == "SELECT 3"
    assert one(spark, T.sql_of_output(F.col("t")), t="so SELECT a FROM b\n\nbecause") == "SELECT a FROM b"
    assert one(spark, T.sql_of_output(F.col("t")), t="\nnothing here \n") == "nothing here" and one(spark, T.sql_of_output(F.col("t")), t=None) == ""
    assert one(spark, T.last_block(F.col("t")), t="```sql\nA\n```\nthen\n```sql\nB\n```\nend") == "B"


def test_decomposition(spark):
    f = T.sub_questions(F.col("q"))
    assert one(spark, f, q="Compare the number of rides in Rome and the number of rides in Oslo") == ["What is the number of rides in Rome?", "What is the number of rides in Oslo?"]
    assert one(spark, f, q="How many rides are there and what is their average fare") == ["How many rides are there", "what is their average fare"]
    assert one(spark, f, q="Short and sweet") == ["Short and sweet"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"]), (4, []), (5, None)], "doc_id int, terms array<string>")
    q = spark.createDataFrame([(9, ["c", "zz"])], "query_id int, terms array<string>")
    got = retrieval.bm25(q, docs).collect()
    idf, avg = math.log(5 - 1 + 0.5) - math.log(1.5), 6 / 5
    assert [(r["doc_id"], r["rank"]) for r in got] == [(2, 1)] and got[0]["score"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg)), abs=1e-6)
    assert retrieval.bm25(q.limit(0), docs).count() == 0


def test_rrf_and_multi(spark):
    h = lambda *x: spark.createDataFrame([(1, d, r) for d, r in x], "query_id int, doc_id int, rank int")
    got = {r["doc_id"]: r["score"] for r in retrieval.rrf([(h((5, 1), (6, 2)), 1.0), (h((6, 1)), 0.5)]).collect()}
    assert got == {5: round(1 / 61, 8), 6: round(1 / 62 + 0.5 / 61, 8)}


def test_npmi_range_and_empty(spark):
    t = spark.createDataFrame([(i, w) for i in range(8) for w in ("x", "y" if i % 2 else "z")] + [(99, None)], "id int, token string")
    e = spark.createDataFrame([(i, "p" if i % 2 else "q") for i in range(8)], "id int, element string")
    got = {(r["token"], r["element"]): r["npmi"] for r in stats.npmi(t, e, min_count=2).collect()}
    assert got[("y", "p")] == 1.0 and got[("x", "p")] == 0.0 and all(-1 <= v <= 1 for v in got.values()) and ("y", "q") not in got
    assert stats.npmi(t.limit(0), e).count() == 0


def test_ranking_metrics(spark):
    g, r = F.col("g"), F.col("r")
    row = {"g": ["a", "b"], "r": ["x", "a", "b"]}
    assert one(spark, metrics.ndcg(g, r, 15), **row) == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)))
    assert one(spark, metrics.reciprocal_rank(g, r), **row) == 0.5 and one(spark, metrics.hit_at(g, r, 1), **row) == 0.0 and one(spark, metrics.precision(g, r), **row) == pytest.approx(2 / 3)
    none = {"g": [], "r": []}
    assert one(spark, metrics.recall(g, r), **none) == 1.0 and one(spark, metrics.precision(g, r), **none) == 0.0 and one(spark, metrics.ndcg(g, r, 5), **none) == 1.0


def test_ppr_one_rule_at_every_size(spark):
    p = spark.createDataFrame([("a", "x", "y", 1.0), ("a", "y", "x", 1.0), ("b", "u", "v", 0.5), ("b", "u", "w", 0.5), ("b", "v", "u", 1.0), ("b", "w", "u", 1.0)], "grp string, src string, dst string, p double")
    s = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 2, "u", 1.0), ("b", 3, "w", 0.4), ("b", 3, "v", 0.6)], "grp string, query_id int, node_id string, s double")
    ranks = lambda df: sorted((r["query_id"], r["node_id"], round(r["r"], 12)) for r in df.collect() if r["r"] > 1e-12)
    for options in ({"max_rounds": 12, "tol": 1e-3}, {"max_rounds": 2, "tol": 1e-9}, {"fixed": 3}):
        small = ranks(graph.ppr_by_group(p, s, **options))
        # the larger group alone, and both, by tables
        assert small == ranks(graph.ppr_by_group(p, s, local_edges=4, **options)) == ranks(graph.ppr_by_group(p, s, local_edges=0, **options)), options
    assert ranks(graph.ppr_by_group(p, s, max_rounds=2, tol=1e-9)) == [(1, "x", 1.0), (2, "u", 1.0), (3, "v", 0.6), (3, "w", 0.4)]


def test_ppr_against_numpy(spark):
    rng = np.random.default_rng(0)
    e = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 14, 40), rng.uniform(0.1, 1, 40))]
    p = graph.transitions(spark.createDataFrame(e, "src_id string, dst_id string, weight double"))
    s = spark.createDataFrame([("q", "n1", 0.75), ("q", "n2", 0.25)], "query_id string, node_id string, s double")
    m = np.zeros((14, 14))
    for a, b, w in e:
        m[int(a[1:]), int(b[1:])] += w
    out = m.sum(1)
    m = np.divide(m, out[:, None], where=out[:, None] > 0, out=np.zeros_like(m))
    v = np.zeros(14)
    v[1], v[2] = 0.75, 0.25
    r = v
    for _ in range(200):
        x = r @ m
        r = 0.7 * x + (1 - 0.7 * x.sum()) * v
    p, s = p.withColumn("grp", F.lit("d")), s.withColumn("grp", F.lit("d"))
    for got in (graph.ppr(p, s), graph.ppr_by_group(p, s)):
        found = {x["node_id"]: x["r"] for x in got.collect()}
        assert sum(found.values()) == pytest.approx(1, abs=1e-4) and all(found.get(f"n{i}", 0) == pytest.approx(r[i], abs=1e-4) for i in range(14))


def test_gap_pruning_keeps_two(spark):
    h = spark.createDataFrame([("q", f"n{i}", s, i + 1) for i, s in enumerate([9.0, 1.0, 0.9, 0.1, 0.09])], "query_id string, node_id string, score double, rank int")
    assert sorted(r["rank"] for r in graph.gap_pruned(h).collect()) == [1, 2, 3]


def test_fuzzy_is_sequence_matching(spark):
    pairs = [("rome", "rome"), ("Rome", "romeo"), ("oslo city", "olso city"), ("abc", "xyz"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(fuzzy.similarity(F.col("a"), F.col("b"), least=0.75)).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.8) and got[2] == pytest.approx(difflib.SequenceMatcher(None, *pairs[2]).ratio()) and got[3] is None and got[4] is None


def test_value_matches_lose_no_pair(spark):
    values = ["customer", "sealcode", "stations", "order date", "Été 2024", "id", "", "a b"]
    asked = {1: ["csutomer", "elode", "my order date", None], 2: ["restorations", " ORDER DATE", "ordre dtae", "ete 2024"], 3: ["", "di", "aab", "zzz"], 4: None}
    q = spark.createDataFrame([(k, "d", c) for k, c in asked.items()] + [(9, "e", ["customer"]), (8, None, ["customer"])], "query_id int, db_id string, candidates array<string>")
    v = spark.createDataFrame([("d", "c", x) for x in [*values, values[0], None]], "db_id string, col string, value string")

    def score(a, b):
        a, b = a.strip(" ").lower(), b.strip(" ").lower()
        if a == b:
            return 1.0
        return min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()

    for least in (0.75, 0.4):
        best = {(k, x): max((score(c, x) for c in cs or [] if c is not None), default=0) for k, cs in asked.items() for x in values}
        got = {(r["query_id"], r["value"]): r["score"] for r in fuzzy.value_matches(q, v, top=99, least=least).collect()}
        assert got == {k: pytest.approx(s, abs=1e-6) for k, s in best.items() if s >= least}


def test_retry_stops(spark):
    asked = []
    loop = X.Retry(spark, lambda p: asked.append(p) or "SELECT 1 AS a WHERE 1 = 0")
    assert loop.run("q", "s", "SELECT").kind == X.EMPTY and len(asked) == 2  # the second answer repeats the first
    assert "Hint:" in asked[0]
    assert X.Retry(spark, lambda p: 1 / 0).run("q", "s", "").kind == X.SYNTAX
    assert X.run(spark, "SELECT 1").kind == X.SUCCESS and X.run(spark, None).kind == X.SYNTAX
    spark.range(2).createOrReplaceTempView("two")
    spark.sql("CREATE TABLE written (a BIGINT) USING parquet")
    try:
        for q in ("WITH q AS (SELECT 1 AS a) INSERT INTO written SELECT a FROM q", "FROM two INSERT INTO written SELECT id", "/* SELECT 1 */ INSERT INTO written VALUES (1)", "-- SELECT\nINSERT INTO written VALUES (1)", "FROM two INSERT INTO written SELECT 1 INSERT INTO written SELECT 2",
                  "EXECUTE IMMEDIATE 'INSERT INTO written VALUES (1)'", "BEGIN INSERT INTO written VALUES (1); END", "INSERT OVERWRITE written SELECT 1", "SELECT reflect('java.util.UUID', 'randomUUID')"):
            assert X.run(spark, q).kind == X.FAILED and spark.table("written").count() == 0, q
    finally:
        spark.sql("DROP TABLE written")
    for q in ("(SELECT id FROM two)", "FROM two SELECT id", "/* a */ -- b\n WITH x AS (SELECT id FROM two) SELECT * FROM x", "TABLE two"):
        assert X.run(spark, q).n_rows == 2, q
    assert [o.kind for o in X.run_many(spark, [("SELECT 1", "SELECT 1"), ("SELECT 1", "SELECT 2"), ("SELEC", None), ("SELECT 1", "SELECT 1")])] == [X.SUCCESS, X.WRONG, X.SYNTAX, X.SUCCESS]
    assert X.overlap(spark.sql("SELECT 1 AS a"), spark.sql("SELECT explode(array(1, 2)) AS b")) == 0.25
    assert X.result_hash(spark.sql("SELECT CAST(NULL AS STRING) AS a")).first()["hash"] != X.result_hash(spark.sql("SELECT 'None' AS a")).first()["hash"]


def test_readers(spark, tmp_path):
    cat = [{"db_id": "d", "table_names_original": ["t", "u"], "column_names_original": [[-1, "*"], [0, "id"], [0, "name"], [1, "t_id"]], "column_types": ["text", "number", "text"], "primary_keys": [1, [2, 3]], "foreign_keys": [[3, 1]]}]
    (tmp_path / "tables.json").write_text(json.dumps(cat))
    (tmp_path / "dev.json").write_text(json.dumps([{"db_id": "d", "question": "q", "SQL": "S1", "query": "S2", "difficulty": 3}]))
    out = readers.reader("SPIDER")(spark, str(tmp_path))
    assert [tuple(r) for r in out["columns"].orderBy("ordinal").collect()] == [("d", "t", "id", 1, "number", True), ("d", "t", "name", 2, "text", True), ("d", "u", "t_id", 3, "TEXT", True)]
    assert [tuple(r) for r in out["fks"].collect()] == [("d", "u", "t_id", "t", "id")]
    assert out["examples"].first().asDict() == {"db_id": "d", "question": "q", "query": "S2", "difficulty": "3", "evidence": "", "lang": "en"}
    assert readers.reader("bird")(spark, str(tmp_path))["examples"].first()["query"] == "S1"
    with pytest.raises(KeyError, match="bird"):
        readers.reader("nope")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "SELECT a\n  FROM b"), (2, None)], "k int, s string")
    sinks.write_statements(df, "s", str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "SELECT a FROM b"]
    path = str(tmp_path / "index")
    sinks.upsert(spark, path, df, "k")
    sinks.upsert(spark, path, spark.createDataFrame([(2, "new"), (3, "x")], "k int, s string"), "k")
    sinks.upsert(spark, path, spark.createDataFrame([(3, "no"), (4, "y")], "k int, s string"), "k", skip_existing=True)
    assert {r["k"]: r["s"] for r in spark.read.parquet(path).collect()} == {1: "SELECT a\n  FROM b", 2: "new", 3: "x", 4: "y"}
    assert sinks.fingerprint("a", 1) == sinks.fingerprint("a", 1) != sinks.fingerprint("a", 2)
