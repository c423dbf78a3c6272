"""Training records from examples and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.operators import execution as X
from querymill.operators import records as K
from querymill.operators.catalog import union
from querymill.plans.common import EX, examples
from querymill.plans.metrics import _R, _runs
from querymill.runtime import checkpoint_dir
from querymill.session import table
from querymill.sources import sinks


def _rows(spark, d):
    ex = examples(spark, d, "db_id", "schema_context", "question", "sql", "reasoning").where("sql is not null and question is not null")
    return ex.withColumn("tables", T.sql_tables(F.col("sql")))


def formatted(spark, d):
    """md5 of the fields of each example's four records: plain and thinking answers, reward prompts, and their JSON read back."""
    c, q, s, r, t = (F.col(x) for x in ("schema_context", "question", "sql", "reasoning", "tables"))
    out = _rows(spark, d).select("example_id", K.sft(c, q, s).alias("a"), K.sft_thinking(c, q, s, r, t).alias("b"), K.grpo(c, q, s, t).alias("g"))
    back = F.from_json(F.to_json("b"), "instruction string, response string")
    return out.select("example_id", F.md5("a.instruction").alias("prompt"), F.md5("a.response").alias("plain"), F.md5("b.response").alias("thinking"), F.md5(back["response"]).alias("thinking_json"), F.md5("g.answer").alias("answer"), F.size(F.coalesce("g.schema_tables", T.empty())).alias("n_tables"))


def preferences(spark, d):
    """Failed runs as pairs of gold and predicted statement."""
    r = _runs(spark, d).where("not coalesce(ex, false) and predicted_sql is not null")
    out = r.select("run_id", "example_id", K.dpo(F.col("schema_context"), F.col("question"), F.col("gold_sql"), F.col("predicted_sql")).alias("p"))
    return out.select("run_id", "example_id", F.md5("p.prompt").alias("prompt"), F.md5("p.chosen").alias("chosen"), F.md5("p.rejected").alias("rejected"))


def _failed(spark, d):
    """Failed runs with the class that their text shows: unknown tables, no query, else wrong rows."""
    known = table(spark, d, "cat_columns").groupBy("db_id").agg(F.collect_set(F.lower("table_name")).alias("known"))
    p = F.trim(F.coalesce("predicted_sql", F.lit("")))
    unknown = F.array_except(T.sql_tables(F.col("predicted_sql")), F.coalesce("known", T.empty()))
    kind = F.when(~F.upper(p).rlike(r"^(SELECT|WITH)\b"), X.SYNTAX).when(F.size(unknown) > 0, X.NO_TABLE).otherwise(X.WRONG)
    message = F.when(F.size(unknown) > 0, F.concat(F.lit("no such table: "), F.get(F.array_sort(unknown), 0)))
    return _runs(spark, d).where("not coalesce(ex, false)").join(known, "db_id", "left").withColumns({"kind": kind, "message": message})


def mined(spark, d):
    """Corrections of the target classes, at most 5,000 of them by a hash: the operator samples."""
    f = _failed(spark, d).where(F.col("kind").isin(X.NO_TABLE, X.WRONG)).where("predicted_sql is not null")
    pick = f.orderBy(F.md5(F.concat_ws("|", F.lit("42"), "run_id", "example_id")), "run_id", "example_id").limit(5_000)
    return pick.select("run_id", "example_id", "kind", F.md5(K.correction(F.col("schema_context"), F.col("question"), F.col("predicted_sql"), F.col("kind"), F.col("message"), X.HINTS)).alias("prompt"))


def error_kinds(spark, d):
    return _failed(spark, d).groupBy("run_id", "kind").agg(F.count("*").alias("n"))


def golden_schema(spark, d):
    return K.golden_schema(examples(spark, d, "db_id", "sql").where("db_id is not null").select(F.col("example_id").alias("id"), "db_id", "sql"), table(spark, d, "cat_columns")).select(F.col("id").alias("example_id"), "table_name")


def samples(spark, d):
    """For each example the catalog tables that its question mentions, and where its reasoning comes from."""
    t = table(spark, d, "cat_columns").groupBy("db_id").agg(F.array_sort(F.collect_set(F.lower("table_name"))).alias("known"))
    low = F.lower(F.coalesce("question", F.lit("")))
    said = F.filter(F.coalesce("known", T.empty()), lambda x: low.contains(x))
    why = F.when(F.trim(F.coalesce("reasoning", F.lit(""))) != "", "own").when(F.col("sql").isNotNull(), "from statement").otherwise("none")
    return examples(spark, d, "db_id", "question", "sql", "reasoning").join(t, "db_id", "left").select("example_id", F.array_join(said, " ").alias("tables"), why.alias("reasoning_from"))


def merged(spark, d):
    """Several sets as one with their name: training and held-out examples, and held-out items."""
    ex = examples(spark, d, "question", "split")
    parts = [ex.where("split = 'train'").select(F.lit("train").alias("part"), "question"), ex.where("split in ('dev', 'test')").select(F.lit("held out").alias("part"), "question"), table(spark, d, "bench_items").select(F.lit("items").alias("part"), F.col("text").alias("question"))]
    return union(*parts).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("chars"))


def batched(spark, d):
    """Runs in batches of 32."""
    return K.batches(_runs(spark, d).select("run_id", "example_id"), "run_id", ["example_id"], 32)


def written_records(spark, d):
    """Plain records written as JSON lines and read back."""
    at = f"{checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex[:12]}"
    sinks.write_json_lines(_rows(spark, d).select(K.sft(F.col("schema_context"), F.col("question"), F.col("sql")).alias("r")).select("r.*"), at)
    return spark.read.schema("instruction string, response string").json(at).groupBy(F.md5("instruction").alias("instruction"), F.md5("response").alias("response")).agg(F.count("*").alias("n"))


QUERIES = {f"train_{f.__name__}": f for f in (formatted, preferences, mined, error_kinds, golden_schema, samples, merged, batched, written_records)}

_PROMPT = "'Given the database schema below, generate SQL to answer the question.' || chr(10) || chr(10) || 'Schema:' || chr(10) || coalesce(schema_context, '') || chr(10) || chr(10) || 'Question: ' || coalesce(question, '')"
_TABS = f"list_sort(list_distinct([t FOR t IN regexp_extract_all(lower({{}}), '(?:from|join)\\s+([a-z0-9_]+)', 1) IF t NOT IN ({', '.join(repr(x) for x in T.NO_TABLE)})]))"
_BLOCK = "'```sql' || chr(10) || sql || chr(10) || '```'"
_ROWS = f"{EX}, w AS (SELECT *, {_TABS.format('sql')} AS tables FROM ex WHERE sql IS NOT NULL AND question IS NOT NULL)"
_AUTO = "concat_ws(chr(10), CASE WHEN len(tables) > 0 THEN 'Tables needed: ' || array_to_string(tables, ', ') END, " + ", ".join(f"CASE WHEN contains(upper(sql), '{k}') THEN '{t}' END" for k, t in (("JOIN", "Need JOINs to connect tables via foreign keys"), ("WHERE", "Apply WHERE conditions to filter results"), ("GROUP BY", "Group results for aggregation"), ("ORDER BY", "Order the results"), ("HAVING", "Filter aggregated results with HAVING"), ("LIMIT", "Limit output rows"))) + ")"
_THINK = f"'<think>' || chr(10) || CASE WHEN trim(coalesce(reasoning, '')) <> '' THEN reasoning WHEN {_AUTO} = '' THEN 'Direct query, no complex reasoning needed.' ELSE {_AUTO} END || chr(10) || '</think>' || chr(10) || chr(10) || {_BLOCK}"
_KNOWN = "known AS (SELECT db_id, list(DISTINCT lower(table_name)) AS known FROM cat_columns GROUP BY 1)"
_FAILED = f"""{_R}, {_KNOWN}, f0 AS (SELECT r.*, list_sort([t FOR t IN coalesce({_TABS.format('predicted_sql')}, []) IF NOT list_contains(coalesce(known, []), t)]) AS unknown FROM r LEFT JOIN known USING (db_id) WHERE NOT coalesce(ex, false)),
    failed AS (SELECT *, CASE WHEN NOT regexp_matches(upper(trim(coalesce(predicted_sql, ''))), '^(SELECT|WITH)\\b') THEN '{X.SYNTAX}' WHEN len(unknown) > 0 THEN '{X.NO_TABLE}' ELSE '{X.WRONG}' END AS kind FROM f0)"""
_LOW = "low AS (SELECT DISTINCT db_id, lower(table_name) AS table_name, lower(column_name) AS column_name FROM cat_columns)"

ORACLE = {
    "train_formatted": f"WITH {_ROWS} SELECT example_id, md5({_PROMPT}) AS prompt, md5({_BLOCK}) AS plain, md5({_THINK}) AS thinking, md5({_THINK}) AS thinking_json, md5(sql) AS answer, len(tables)::INT AS n_tables FROM w",
    "train_preferences": f"WITH {_R} SELECT run_id, example_id, md5({_PROMPT}) AS prompt, md5(gold_sql) AS chosen, md5(predicted_sql) AS rejected FROM r WHERE NOT coalesce(ex, false) AND predicted_sql IS NOT NULL",
    "train_mined": f"""WITH {_FAILED} SELECT run_id, example_id, kind, md5(coalesce(schema_context, '') || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || 'This statement is wrong:' || chr(10) || predicted_sql || chr(10) || chr(10) || 'Error (' || kind || '): ' || CASE WHEN len(unknown) > 0 THEN 'no such table: ' || unknown[1] ELSE 'none told' END
        || chr(10) || 'Hint: ' || CASE kind WHEN '{X.NO_TABLE}' THEN $h${X.HINTS[X.NO_TABLE]}$h$ ELSE $h${X.HINTS[X.WRONG]}$h$ END) AS prompt FROM failed WHERE kind IN ('{X.NO_TABLE}', '{X.WRONG}') AND predicted_sql IS NOT NULL ORDER BY md5('42|' || run_id || '|' || example_id), run_id, example_id LIMIT 5000""",
    "train_error_kinds": f"WITH {_FAILED} SELECT run_id, kind, count(*) AS n FROM failed GROUP BY ALL",
    "train_golden_schema": f"""WITH {EX}, {_LOW}, t AS (SELECT example_id, db_id, unnest(list_distinct(regexp_extract_all(lower(sql), '[a-z_][a-z0-9_]*'))) AS w FROM ex WHERE db_id IS NOT NULL), f AS (SELECT DISTINCT example_id, table_name FROM t JOIN low ON t.db_id = low.db_id AND (w = table_name OR w = column_name))
        SELECT * FROM f UNION ALL SELECT example_id, m FROM ex JOIN (SELECT db_id, min(table_name) AS m FROM low GROUP BY 1) USING (db_id) ANTI JOIN f USING (example_id)""",
    "train_samples": f"WITH {EX}, {_KNOWN} SELECT example_id, array_to_string(list_sort([t FOR t IN coalesce(known, []) IF contains(lower(coalesce(question, '')), t)]), ' ') AS tables, CASE WHEN trim(coalesce(reasoning, '')) <> '' THEN 'own' WHEN sql IS NOT NULL THEN 'from statement' ELSE 'none' END AS reasoning_from FROM ex LEFT JOIN known USING (db_id)",
    "train_merged": f"WITH {EX}, p AS (SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'held out' END AS part, question FROM ex WHERE split IN ('train', 'dev', 'test') UNION ALL SELECT 'items', text FROM bench_items) SELECT part, count(*) AS n, sum(length(question))::BIGINT AS chars FROM p GROUP BY 1",
    "train_batched": f"WITH {_R} SELECT run_id, example_id, (row_number() OVER (PARTITION BY run_id ORDER BY example_id) - 1) // 32 AS batch FROM r",
    "train_written_records": f"WITH {_ROWS} SELECT md5({_PROMPT}) AS instruction, md5({_BLOCK}) AS response, count(*) AS n FROM w GROUP BY ALL",
}
