"""Preparation of training rows, rewards, and execution of statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.operators import execution as X
from querymill.operators import rewards as W
from querymill.plans.common import EX, examples
from querymill.session import register_views, table

SALT = "42"


def bucket(*parts):
    """A stable number from 0 to 99 of a row's key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SALT), *parts)), 1, 8), 16, 10).cast("long"), F.lit(100))


_B = "(('0x' || substr(md5(concat_ws('|', '42', {})), 1, 8))::BIGINT % 100)"


def valid_thinking(spark, d):
    """Valid rows with their mode: complex statements think, of the others three quarters do."""
    ex = examples(spark, d, "question", "sql").where(F.trim(F.coalesce("question", F.lit(""))) != "").where(F.coalesce("sql", F.lit("")).rlike(r"(?i)^\s*(SELECT|WITH|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b"))
    mode = F.when(T.is_complex_sql(F.col("sql")) | (bucket("example_id") < 75), "thinking").otherwise("direct")
    return ex.select("example_id", mode.alias("mode"))


def shuffled(spark, d):
    """A seeded order: rows sorted by a hash of their key, as a distributed sort."""
    ex = examples(spark, d, "split").where("split = 'dev'")
    return ex.select("example_id", F.md5(F.concat_ws("|", F.lit(SALT), "example_id")).alias("shuffle_key")).orderBy("shuffle_key", "example_id")


def noise_tables(spark, d):
    """Half of the catalog tables that a dev example's statement doesn't read, chosen by hash."""
    ex = examples(spark, d, "db_id", "sql", "split").where("split = 'dev'").select("example_id", "db_id", T.sql_tables(F.col("sql")).alias("gold"))
    t = table(spark, d, "cat_columns").select("db_id", F.lower("table_name").alias("table_name")).distinct()
    rest = ex.join(t, "db_id").where(~F.array_contains("gold", F.col("table_name")))
    w = Window.partitionBy("example_id")
    pick = rest.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(SALT), "example_id", "table_name")), "table_name")))
    return pick.where(F.col("r") <= F.floor(F.col("n") * 0.5)).select("example_id", "table_name")


def multitask(spark, d):
    """Dev rows with corrections at 30 % of the mix, as far as the pool of failed runs goes.

    Each failed run is taken with the wanted share of the pool as its probability, by a hash of its key: no global sort.
    """
    runs = table(spark, d, "eval_rows").where("not coalesce(ex, false) and predicted_sql is not null").select("run_id", "example_id").distinct()
    own = examples(spark, d, "split").where("split = 'dev'")
    wanted = own.agg((F.count("*") * 0.3 / 0.7).alias("k")).join(runs.agg(F.count("*").alias("n"))).select((F.col("k") / F.col("n")).alias("share"))  # one row each
    luck = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SALT), "run_id", "example_id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    picked = runs.join(F.broadcast(wanted)).where(luck < F.col("share"))
    return picked.select(F.lit("correction").alias("task"), "run_id", "example_id").unionByName(own.select(F.lit("sql").alias("task"), F.lit(None).cast("string").alias("run_id"), "example_id"))


def context_fallback(spark, d):
    """Contexts of runs by row key, else by the example's own."""
    runs = table(spark, d, "eval_rows").select("run_id", "example_id", T.row_key(F.col("db_id"), F.col("question")).alias("k"), "schema_context").distinct()
    ex = examples(spark, d, "db_id", "question", "schema_context").select(T.row_key(F.col("db_id"), F.col("question")).alias("k"), F.length("schema_context").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    return runs.join(ex, "k", "left").select("run_id", "example_id", "k", F.coalesce("n", F.length("schema_context")).alias("context_chars"))


def open_examples(spark, d):
    """Dev examples that no run has done yet."""
    done = table(spark, d, "eval_rows").select("example_id")
    return examples(spark, d, "split", "db_id").where("split in ('dev', 'test')").join(done, "example_id", "left_anti").select("example_id", "db_id")


def distributions(spark, d):
    src, mode = F.lower(F.trim(F.coalesce("source", F.lit("")))), F.lower(F.trim(F.coalesce("thinking_mode", F.lit(""))))
    return examples(spark, d, "source", "thinking_mode").groupBy(src.alias("source"), mode.alias("thinking_mode")).agg(F.count("*").alias("n"))


def rewards(spark, d):
    e = table(spark, d, "eval_rows")
    a, g = F.col("raw_output"), F.col("gold_sql")
    tables = F.array_distinct(T.matches(F.lower("schema_context"), r"create table ([a-z0-9_]+)", 1))
    return e.select("run_id", "example_id", W.format_exact(a).alias("exact"), W.format_parts(a).alias("parts"), W.text_match(a, g).alias("match"), W.tables_valid(a, tables).alias("tables"), W.improvement(a, g, F.col("predicted_sql")).alias("improved"), W.error_addressed(a, F.lit("syntax_error")).alias("addressed"))


def composite_reward(spark, d):
    e = table(spark, d, "eval_rows")
    s = W.schema_use(F.col("predicted_sql"), F.col("schema_context"))
    r = W.reasoning_use(F.col("raw_output"), F.col("schema_context"))
    total = W.composite(F.coalesce(F.col("ex").cast("double"), F.lit(0.0)), W.sql_kind(F.col("predicted_sql")), s, r)
    return e.select("run_id", "example_id", F.round(s, 6).alias("schema_use"), F.round(r, 6).alias("reasoning_use"), F.round(total, 6).alias("reward"))


MESSAGES = ["no such table: riders", "no such column: t.nam", 'near "FORM": syntax error', "incomplete input", "unrecognized token: \"#\"", "datatype mismatch", None]


def error_classes(spark, d):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "id int, message string")
    return rows.select("id", X.message_class(F.col("message")).alias("kind"))


#: (name, statement, gold) over the star schema.
STATEMENTS = [
    ("same set", "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC"),
    ("other rows", "SELECT n_name FROM nation WHERE n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    ("no rows", "SELECT n_name FROM nation WHERE n_regionkey = 77", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    ("both empty", "SELECT 1 FROM nation WHERE n_regionkey = 77", "SELECT 2 FROM nation WHERE n_regionkey = 78"),
    ("syntax", "SELEC n_name FROM nation", "SELECT 1"), ("broken", "SELECT n_name FROM nation WHERE (", "SELECT 1"), ("no table", "SELECT a FROM riders", "SELECT 1"), ("no column", "SELECT n_nam FROM nation", "SELECT 1"),
    ("division", "SELECT 1 / (n_regionkey - n_regionkey) FROM nation", "SELECT 1"), ("command", "DROP TABLE nation", "SELECT 1"), ("blank", "  ", "SELECT 1"),
    ("hidden write", "WITH q AS (SELECT 1 AS a) INSERT INTO nation SELECT a FROM q", "SELECT 1"), ("write behind from", "/* SELECT */ FROM nation INSERT INTO nation SELECT *", "SELECT 1"),
]


def executed(spark, d):
    register_views(spark, d, ["nation"])
    return spark.createDataFrame([(n, o.kind) for (n, _, _), o in zip(STATEMENTS, X.run_many(spark, [(s, g) for _, s, g in STATEMENTS]))], "name string, kind string")


#: Candidates of a vote; the last can't be parsed.
CANDIDATES = ["SELECT count(*) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT count(*) FROM nation", "SELECT count(*) + 1 FROM nation", "SELECT count(* FROM nation"]


def voted(spark, d):
    """Majority among candidate statements: (chosen, votes)."""
    register_views(spark, d, ["nation", "region"])
    return spark.createDataFrame([X.vote(spark, CANDIDATES)], "chosen int, votes int")


def retried(spark, d):
    """A correction loop with a stand-in generator."""
    register_views(spark, d, ["nation"])
    answers = iter(["SELECT n_nam FROM nation", "SELECT n_name FROM nation"])
    loop = X.Retry(spark, lambda prompt: next(answers, None))
    loop.run("Which nations?", "nation(n_name)", "SELECT n_name FORM nation")
    return spark.createDataFrame([(i, o.kind, o.n_rows) for i, o in enumerate(loop.history)], "attempt int, kind string, n_rows long")


def hashed_results(spark, d):
    """Set hashes: both orders of the same rows agree, other rows don't."""
    n = table(spark, d, "nation")
    a, b, c = X.result_hash(n.orderBy("n_name")), X.result_hash(n.unionByName(n)), X.result_hash(n.where("n_regionkey = 1"))
    return a.crossJoin(b.select(F.col("hash").alias("h2"))).crossJoin(c.select(F.col("hash").alias("h3"))).select("n_rows", (F.col("hash") == F.col("h2")).alias("same"), (F.col("hash") == F.col("h3")).alias("other"))


QUERIES = {f"train_{f.__name__}": f for f in (
    valid_thinking, shuffled, noise_tables, multitask, context_fallback, open_examples, distributions, rewards, composite_reward,
)} | {f"exec_{f.__name__}": f for f in (error_classes, executed, voted, retried, hashed_results)}

#: Statements that fail fail in any engine; the error's class is the truth of those.
FAILING = {"syntax": X.SYNTAX, "broken": X.SYNTAX, "no table": X.NO_TABLE, "no column": X.NO_COLUMN, "division": X.FAILED, "command": X.FAILED, "blank": X.SYNTAX, "hidden write": X.FAILED, "write behind from": X.FAILED}


def _class_sql(name: str, sql: str, gold: str) -> str:
    """The class of a pair of statements, from their rows."""
    if name in FAILING:
        return f"SELECT '{name}' AS name, '{FAILING[name]}' AS kind"
    n, g = f"(SELECT count(*) FROM ({sql}))", f"(SELECT count(*) FROM ({gold}))"
    differ = f"(SELECT count(*) FROM (({sql} EXCEPT {gold.split(' ORDER')[0]}) UNION ALL ({gold.split(' ORDER')[0]} EXCEPT {sql})))"
    return f"SELECT '{name}' AS name, CASE WHEN {n} = 0 AND {g} = 0 THEN '{X.SUCCESS}' WHEN {n} = 0 THEN '{X.EMPTY}' WHEN {differ} > 0 THEN '{X.WRONG}' ELSE '{X.SUCCESS}' END AS kind"


_BLOCK = "trim(regexp_extract(coalesce({}, ''), '(?is)```sql\\s*(.+?)\\s*```', 1))"
_P = _BLOCK.format("raw_output")
_WORDS = "list_distinct([x FOR x IN regexp_split_to_array(lower({}), '\\s+') IF x <> ''])"
_CNT = "len(regexp_extract_all(coalesce(raw_output, ''), '{}'))"

ORACLE = {
    "train_valid_thinking": f"""WITH {EX} SELECT example_id, CASE WHEN regexp_matches(sql, '{T.COMPLEX_SQL}') OR {_B.format("example_id::VARCHAR")} < 75 THEN 'thinking' ELSE 'direct' END AS mode FROM ex
        WHERE trim(coalesce(question, '')) <> '' AND regexp_matches(coalesce(sql, ''), '(?i)^\\s*(SELECT|WITH|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\\b')""",
    "train_shuffled": f"WITH {EX} SELECT example_id, md5('42|' || example_id) AS shuffle_key FROM ex WHERE split = 'dev'",
    "train_noise_tables": f"""WITH {EX}, g AS (SELECT example_id, db_id, coalesce([t FOR t IN regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)', 1)], []) AS gold FROM ex WHERE split = 'dev'), t AS (SELECT DISTINCT db_id, lower(table_name) AS table_name FROM cat_columns),
        r AS (SELECT example_id, table_name, count(*) OVER (PARTITION BY example_id) AS n, row_number() OVER (PARTITION BY example_id ORDER BY md5('42|' || example_id || '|' || table_name), table_name) AS r FROM g JOIN t USING (db_id) WHERE NOT list_contains(gold, table_name)) SELECT example_id, table_name FROM r WHERE r <= floor(n * 0.5)""",
    "train_multitask": f"""WITH {EX}, c AS (SELECT DISTINCT run_id, example_id FROM eval_rows WHERE NOT coalesce(ex, false) AND predicted_sql IS NOT NULL), k AS (SELECT (SELECT count(*) FROM ex WHERE split = 'dev') * 0.3::DOUBLE / 0.7::DOUBLE / (SELECT count(*) FROM c) AS share)
        SELECT 'correction' AS task, run_id, example_id FROM c, k WHERE ('0x' || substr(md5('42|' || run_id || '|' || example_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < share UNION ALL SELECT 'sql', NULL, example_id FROM ex WHERE split = 'dev'""",
    "train_context_fallback": f"""WITH {EX}, r AS (SELECT DISTINCT run_id, example_id, db_id || '__' || md5(question)[1:8] AS k, schema_context FROM eval_rows), x AS (SELECT db_id || '__' || md5(question)[1:8] AS k, max(length(schema_context)) AS n FROM ex GROUP BY 1)
        SELECT run_id, example_id, r.k, coalesce(n, length(schema_context))::INT AS context_chars FROM r LEFT JOIN x ON r.k = x.k""",
    "train_open_examples": f"WITH {EX} SELECT example_id, db_id FROM ex ANTI JOIN eval_rows USING (example_id) WHERE split IN ('dev', 'test')",
    "train_distributions": f"WITH {EX} SELECT lower(trim(coalesce(source, ''))) AS source, lower(trim(coalesce(thinking_mode, ''))) AS thinking_mode, count(*) AS n FROM ex GROUP BY ALL",
    "train_rewards": f"""WITH e AS (SELECT run_id, example_id, raw_output, trim(gold_sql) AS g, trim(coalesce(predicted_sql, '')) AS w, {_P} AS p, {_CNT.format('</think>')} AS t, {_CNT.format('```sql')} AS o, {_CNT.format('```')} AS f, coalesce(regexp_extract_all(lower(schema_context), 'create table ([a-z0-9_]+)', 1), []) AS tables FROM eval_rows),
        u AS (SELECT *, list_distinct(regexp_extract_all(lower(p), '\\b(?:from|join)\\s+([a-z0-9_]+)', 1)) AS used, len(list_intersect({_WORDS.format('g')}, {_WORDS.format('p')})) / greatest(len({_WORDS.format('g')}), 1) AS share FROM e)
        SELECT run_id, example_id, CASE WHEN regexp_matches(coalesce(raw_output, ''), '(?is)<think>.*?</think>\\s*```sql\\s*.+?\\s*```') THEN 3.0 ELSE 0.0 END::DOUBLE AS exact,
        (CASE WHEN t = 1 THEN 0.5 WHEN t > 1 THEN -1 ELSE 0 END + CASE WHEN o = 1 THEN 0.5 WHEN o > 1 THEN -1 ELSE 0 END + CASE WHEN f - o = 1 THEN 0.5 WHEN f - o > 1 THEN -0.5 ELSE 0 END)::DOUBLE AS parts,
        CASE WHEN p = '' THEN -2 WHEN p = g THEN 5 WHEN lower(p) = lower(g) THEN 3.5 WHEN share > 0.7 THEN 1.5 WHEN share > 0.4 THEN 0.5 ELSE -1.5 END::DOUBLE AS match,
        CASE WHEN len(used) = 0 THEN 0 WHEN len([x FOR x IN used IF NOT list_contains(tables, x)]) = 0 THEN 2 ELSE -0.5 * len([x FOR x IN used IF NOT list_contains(tables, x)]) END::DOUBLE AS tables,
        CASE WHEN p = '' OR p = w THEN -1 WHEN lower(p) = lower(g) THEN 4 ELSE 2 END::DOUBLE AS improved, CASE WHEN p = '' THEN 0 WHEN regexp_matches(upper(p), '^(SELECT|WITH)\\b') THEN 1.5 ELSE 0.5 END::DOUBLE AS addressed FROM u""",
    "train_composite_reward": f"""WITH e AS (SELECT run_id, example_id, coalesce(ex::INT::DOUBLE, 0) AS x, trim(coalesce(predicted_sql, '')) AS p, upper(coalesce(schema_context, '')) AS c, upper(coalesce(raw_output, '')) AS r,
        [t FOR t IN list_distinct(regexp_extract_all(upper(predicted_sql), '\\b([A-Z_][A-Z0-9_]*)\\b', 1)) IF t NOT IN ({", ".join(f"'{w}'" for w in W.SQL_WORDS)})] AS ids, list_distinct(regexp_extract_all(upper(schema_context), 'TABLE\\s+([A-Z0-9_]+)', 1)) AS tabs FROM eval_rows),
        s AS (SELECT *, CASE WHEN p = '' OR trim(c) = '' THEN 0 WHEN coalesce(len(ids), 0) = 0 THEN 1 ELSE len([i FOR i IN ids IF contains(c, i)]) / len(ids) END AS su, CASE WHEN trim(r) = '' THEN 0.3 WHEN coalesce(len(tabs), 0) = 0 THEN 0.5 ELSE len([t FOR t IN tabs IF contains(r, t)]) / len(tabs) END AS ru,
            CASE WHEN p = '' THEN 0 WHEN regexp_matches(upper(p), '^(SELECT|WITH)\\b') THEN 1 ELSE 0.5 END AS f FROM e)
        SELECT run_id, example_id, round(su, 6) AS schema_use, round(ru, 6) AS reasoning_use, round(greatest(0, least(1, 0.5 * x + 0.2 * f + 0.15 * su + 0.15 * ru)), 6) AS reward FROM s""",
    "exec_error_classes": "SELECT * FROM (VALUES (0, 'no_such_table'), (1, 'no_such_column'), (2, 'syntax_error'), (3, 'syntax_error'), (4, 'syntax_error'), (5, 'execution_error'), (6, NULL)) v(id, kind)",
    "exec_executed": " UNION ALL ".join(_class_sql(n, s, g) for n, s, g in STATEMENTS),
    "exec_voted": f"WITH r AS ({' UNION ALL '.join(f'SELECT {i} AS i, ({c})::VARCHAR AS v, {len(c)} AS n' for i, c in enumerate(CANDIDATES[:-1]))}), k AS (SELECT v, count(*) AS votes, min(i) AS i FROM r GROUP BY v ORDER BY votes DESC, i LIMIT 1) SELECT r.i AS chosen, votes::INT AS votes FROM r JOIN k USING (v) ORDER BY n, r.i LIMIT 1",
    "exec_retried": "SELECT * FROM (VALUES (0, 'syntax_error', 0), (1, 'no_such_column', 0)) v(attempt, kind, n_rows) UNION ALL SELECT 2, 'success', count(*) FROM nation",
    "exec_hashed_results": "SELECT count(*) AS n_rows, true AS same, false AS other FROM nation",
}
