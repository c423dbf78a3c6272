"""Tokenizers, SQL lexing, model output and prompt parsing over examples, catalog and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.plans.common import EX, examples, listed
from querymill.session import table


def joined(c):
    return F.array_join(c, " ")


def identifier_tokens(spark, d):
    return table(spark, d, "cat_columns").select("db_id", "table_name", "column_name", joined(T.name_tokens(F.col("column_name"))).alias("tokens"))


def question_tokens(spark, d):
    return examples(spark, d, "question").select("example_id", joined(T.question_tokens(F.col("question"))).alias("tokens"))


def synonym_tokens(spark, d):
    nodes = table(spark, d, "kg_nodes").select("node_id", F.explode("synonyms").alias("synonym")).distinct()
    return nodes.select("node_id", "synonym", joined(T.synonym_tokens(F.col("synonym"))).alias("tokens"))


def context_tokens(spark, d):
    return examples(spark, d, "schema_context").select("example_id", F.size(T.blank_tokens(F.col("schema_context"))).alias("n_tokens"))


def value_candidates(spark, d):
    return examples(spark, d, "question").select("example_id", F.array_join(T.value_candidates(F.col("question")), "|").alias("candidates"))


def sql_tables(spark, d):
    return examples(spark, d, "sql").select("example_id", joined(T.sql_tables(F.col("sql"))).alias("tables"))


def schema_refs(spark, d):
    return examples(spark, d, "sql").select("example_id", joined(T.schema_refs(F.col("sql"))).alias("refs"))


def sql_aliases(spark, d):
    pairs = examples(spark, d, "sql").select("example_id", F.explode(T.aliases(F.col("sql"))).alias("p"))
    return pairs.select("example_id", "p.alias", F.col("p.table").alias("table_name"))


def gold_columns(spark, d):
    """Qualified columns with their alias resolved to the table."""
    ex = examples(spark, d, "sql").select("example_id", F.lower("sql").alias("low"), F.col("sql"))
    pair = "([a-z0-9_]+)\\.([a-z0-9_]+)"
    refs = ex.select("example_id", F.explode(F.array_distinct(F.arrays_zip(T.matches(F.col("low"), pair, 1).alias("q"), T.matches(F.col("low"), pair, 2).alias("c")))).alias("r")).select("example_id", "r.q", "r.c")
    read = ex.select("example_id", F.explode(T.matches(F.col("low"), r"(?:from|join)\s+([a-z0-9_]+)", 1)).alias("t")).distinct()
    names = ex.select("example_id", F.explode(T.aliases(F.col("sql"))).alias("p")).select("example_id", F.col("p.alias").alias("q"), F.col("p.table").alias("t"))
    names = names.unionByName(read.select("example_id", F.col("t").alias("q"), "t")).distinct()
    found = refs.join(names, ["example_id", "q"]).join(read, ["example_id", "t"], "left_semi")
    return found.select("example_id", F.col("t").alias("table_name"), F.col("c").alias("column_name")).distinct()


def sql_clauses(spark, d):
    return examples(spark, d, "sql").select("example_id", T.select_part(F.col("sql")).alias("select_part"), T.predicate_part(F.col("sql")).alias("predicate_part"))


def sql_complexity(spark, d):
    return examples(spark, d, "sql", "db_id").groupBy("db_id").agg(F.count_if(T.is_complex_sql(F.col("sql"))).alias("n_complex"), F.count("*").alias("n"))


def normal_sql(spark, d):
    return examples(spark, d, "sql").select("example_id", T.normal_sql(F.col("sql")).alias("normal"))


def output_sql(spark, d):
    return table(spark, d, "eval_rows").select("run_id", "example_id", T.sql_of_output(F.col("raw_output")).alias("sql"), T.reasoning_of_output(F.col("raw_output")).alias("reasoning"))


def output_blocks(spark, d):
    return examples(spark, d, "response").select("example_id", T.last_block(F.col("response")).alias("sql"), T.before_last_block(F.col("response")).alias("before"))


def prompt_parts(spark, d):
    i = F.col("instruction")
    schema = F.regexp_extract(i, r"(?s)\n(?:Schema|Schéma|Esquema):\n(.*?)\n+(?:Question|Frage|Pregunta):", 1)
    question = F.regexp_extract(i, r"(?s)\n(?:Question|Frage|Pregunta):\s*(.*?)\s*$", 1)
    return examples(spark, d, "instruction").select("example_id", F.trim(schema).alias("schema_context"), question.alias("question"))


def question_complexity(spark, d):
    score = T.complexity(F.col("question"))
    return examples(spark, d, "question").select("example_id", score.alias("score"), (score >= 0.6).alias("is_complex"))


def decompose(spark, d):
    return examples(spark, d, "question").where("question is not null").select("example_id", F.posexplode(T.sub_questions(F.col("question"))).alias("part_no", "part"))


def keyword_augment(spark, d):
    """Questions with the catalog's table and column names that they mention."""
    ex = examples(spark, d, "db_id", "question").where("question is not null")
    words = ex.select("example_id", "db_id", F.explode(F.array_distinct(T.matches(F.lower("question"), "[a-z_][a-z0-9_]*"))).alias("w"))
    cat = table(spark, d, "cat_columns")
    names = cat.select("db_id", F.lower("table_name").alias("w"), F.lit("t").alias("k")).union(cat.select("db_id", F.lower("column_name"), F.lit("c"))).distinct()
    hits = words.join(names, ["db_id", "w"]).groupBy("example_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("k") == "t", F.col("w")))), ", ").alias("t"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("k") == "c", F.col("w")))), ", ").alias("c")
    )
    hint = F.concat_ws("; ", F.when(F.col("t") != "", F.concat(F.lit("tables: "), "t")), F.when(F.col("c") != "", F.concat(F.lit("columns: "), "c")))
    return ex.join(hits, "example_id", "left").select("example_id", F.when(hint != "", F.concat("question", F.lit(" ["), hint, F.lit("]"))).otherwise(F.col("question")).alias("augmented"))


def evidence_hint(spark, d):
    return table(spark, d, "eval_rows").select("run_id", "example_id", T.with_hint(F.col("question"), F.col("evidence")).alias("prompt"), T.row_key(F.col("db_id"), F.col("question")).alias("row_key"))


def edge_metadata(spark, d):
    obj = T.repaired_json(F.concat(F.lit("```json\n"), "metadata", F.lit("\n```")))
    return table(spark, d, "kg_edges").select("src_id", "dst_id", "edge_type", "weight", F.length(obj).alias("json_chars"), F.size(F.json_object_keys(obj)).alias("n_keys"))


def chat_prompt(spark, d):
    return examples(spark, d, "instruction").select("example_id", F.md5(T.chatml(("system", F.lit("You write SQL.")), ("user", F.col("instruction")))).alias("prompt_md5"))


def reasoning_trace(spark, d):
    return examples(spark, d, "sql").where("sql is not null").select("example_id", T.reasoning_from_sql(F.col("sql"), T.sql_tables(F.col("sql"))).alias("trace"))


QUERIES = {f"text_{f.__name__}": f for f in (
    identifier_tokens, question_tokens, synonym_tokens, context_tokens, value_candidates, sql_tables, schema_refs, sql_aliases, gold_columns,
    sql_clauses, sql_complexity, normal_sql, output_sql, output_blocks, prompt_parts, question_complexity, decompose, keyword_augment,
    evidence_hint, edge_metadata, chat_prompt, reasoning_trace,
)}

_ALIASES = f"""list_distinct([x FOR x IN list_concat(
    list_transform(list_zip(regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)\\s+as\\s+([a-z0-9_]+)', 2), regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)\\s+as\\s+([a-z0-9_]+)', 1)), lambda z: {{'a': z[1], 't': z[2]}}),
    list_transform(list_zip(regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)\\s+([a-z0-9_]+)', 2), regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)\\s+([a-z0-9_]+)', 1)), lambda z: {{'a': z[1], 't': z[2]}})
  ) IF x.a NOT IN ({listed(T.NO_ALIAS)})])"""

_TABLES = f"list_sort(list_distinct([t FOR t IN regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)', 1) IF t NOT IN ({listed(T.NO_TABLE)})]))"
_KEYWORD = " OR ".join(f"contains(lower(question), '{k}')" for k in T.COMPLEX_KEYWORDS)
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

ORACLE = {
    "text_identifier_tokens": "SELECT db_id, table_name, column_name, array_to_string([x FOR x IN regexp_split_to_array(lower(regexp_replace(column_name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_\\s]+') IF x <> ''], ' ') AS tokens FROM cat_columns",
    "text_question_tokens": f"WITH {EX} SELECT example_id, coalesce(array_to_string(list_sort(list_distinct([x FOR x IN regexp_extract_all(lower(question), '[a-z_][a-z0-9_]*') IF length(x) > 1 AND x NOT IN ({listed(T.QUESTION_STOPWORDS)})])), ' '), '') AS tokens FROM ex",
    "text_synonym_tokens": f"WITH s AS (SELECT DISTINCT node_id, unnest(synonyms) AS synonym FROM kg_nodes) SELECT node_id, synonym, coalesce(array_to_string(list_sort(list_distinct([x FOR x IN regexp_split_to_array(lower(synonym), '[^a-z0-9_]+') IF length(x) >= 3 AND x NOT IN ({listed(T.SYNONYM_STOPWORDS)})])), ' '), '') AS tokens FROM s",
    "text_context_tokens": f"WITH {EX} SELECT example_id, coalesce(len([x FOR x IN regexp_split_to_array(lower(schema_context), '\\s+') IF x <> '']), 0)::INT AS n_tokens FROM ex",
    "text_value_candidates": f"""WITH {EX}, a AS (SELECT example_id, list_concat(regexp_extract_all(question, '["'']([^"'']{{2,}})["'']', 1), regexp_extract_all(question, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1),
        [x FOR x IN regexp_extract_all(lower(question), '[a-z_][a-z0-9_]*') IF length(x) >= 3 AND x NOT IN ({listed(T.VALUE_STOPWORDS)})]) AS c FROM ex)
        SELECT example_id, coalesce(array_to_string(list_filter(c, lambda x, i: list_position([lower(y) FOR y IN c], lower(x)) = i), '|'), '') AS candidates FROM a""",
    "text_sql_tables": f"WITH {EX} SELECT example_id, coalesce(array_to_string({_TABLES}, ' '), '') AS tables FROM ex",
    "text_schema_refs": f"""WITH {EX}, p AS (SELECT example_id, regexp_extract_all(lower(sql), '\\b(?:from|join|into|update)\\s+[`"]?([a-z0-9_]+)', 1) AS t, regexp_extract_all(lower(sql), '[`"]?([a-z0-9_]+)[`"]?\\s*\\.\\s*[`"]?([a-z0-9_]+)', 1) AS q,
        regexp_extract_all(lower(sql), '[`"]?([a-z0-9_]+)[`"]?\\s*\\.\\s*[`"]?([a-z0-9_]+)', 2) AS c FROM ex)
        SELECT example_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(t, q, list_transform(list_zip(q, c), lambda z: z[1] || '.' || z[2])))), ' '), '') AS refs FROM p""",
    "text_sql_aliases": f"WITH {EX}, a AS (SELECT example_id, unnest({_ALIASES}) AS p FROM ex WHERE sql IS NOT NULL) SELECT example_id, p.a AS alias, p.t AS table_name FROM a",
    "text_gold_columns": f"""WITH {EX}, a AS (SELECT example_id, unnest({_ALIASES}) AS p FROM ex WHERE sql IS NOT NULL),
        r AS (SELECT DISTINCT example_id, unnest(regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z0-9_]+)', 1)) AS t FROM ex),
        n AS (SELECT example_id, p.a AS q, p.t AS t FROM a UNION SELECT example_id, t, t FROM r),
        c AS (SELECT example_id, unnest(list_zip(regexp_extract_all(lower(sql), '([a-z0-9_]+)\\.([a-z0-9_]+)', 1), regexp_extract_all(lower(sql), '([a-z0-9_]+)\\.([a-z0-9_]+)', 2))) AS z FROM ex)
        SELECT DISTINCT c.example_id, n.t AS table_name, c.z[2] AS column_name FROM c JOIN n ON c.example_id = n.example_id AND c.z[1] = n.q SEMI JOIN r ON n.example_id = r.example_id AND n.t = r.t""",
    "text_sql_clauses": f"""WITH {EX} SELECT example_id, trim(regexp_extract(sql, '(?is)^(.*?)\\bfrom\\b', 1)) AS select_part,
        trim(CASE WHEN regexp_extract(sql, '(?is)^.*?\\bwhere\\b(.*)$', 1) <> '' THEN regexp_extract(sql, '(?is)^.*?\\bwhere\\b(.*)$', 1) ELSE regexp_extract(sql, '(?is)^.*?\\bhaving\\b(.*)$', 1) END) AS predicate_part FROM ex""",
    "text_sql_complexity": f"WITH {EX} SELECT db_id, count(*) FILTER (regexp_matches(sql, '{T.COMPLEX_SQL}')) AS n_complex, count(*) AS n FROM ex GROUP BY db_id",
    "text_normal_sql": f"""WITH {EX}, b AS (SELECT example_id, regexp_replace(trim(regexp_replace(regexp_replace(sql, '(''[^'']*''|"[^"]*"|`[^`]*`)|--[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*\\*+/', '\\1 ', 'g'), '\\s+', ' ', 'g')), '[; ]+$', '') AS s FROM ex)
        SELECT example_id, CASE WHEN s IS NOT NULL THEN coalesce(array_to_string([CASE WHEN lower(t) IN ({listed(T.SQL_KEYWORDS)}) THEN upper(t) ELSE t END FOR t IN regexp_extract_all(s, '(?s)''[^'']*''|"[^"]*"|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]')], ''), '') END AS normal FROM b""",
    "text_output_sql": f"""WITH l AS (SELECT *, [trim(x) FOR x IN string_split(coalesce(raw_output, ''), chr(10)) IF trim(x) <> ''] AS lines FROM eval_rows)
        SELECT run_id, example_id, coalesce(nullif(trim(regexp_extract(raw_output, '(?is)```sql[ \\t\\r\\n]*(.+?)[ \\t\\r\\n]*```', 1)), ''), nullif(trim(substring(list_last([x FOR x IN lines IF starts_with(upper(x), 'SQL:')]), 5)), ''),
            nullif(trim(regexp_extract(regexp_extract(raw_output, '(?is)(SELECT[ \\t\\r\\n]+.+)', 1), '(?s)^(.*?)(?:\\n\\n|\\n[A-Z]|$)', 1)), ''), nullif(list_last(lines), ''), '') AS sql,
        coalesce(CASE WHEN regexp_matches(raw_output, '(?s)<think>.*?</think>') THEN {_STRIP.format("regexp_extract(raw_output, '(?s)<think>(.*?)</think>', 1)")} END,
            CASE WHEN regexp_matches(raw_output, '(?i)\\bSQL\\s*:') THEN {_STRIP.format("regexp_extract(raw_output, '(?is)^(.*?)\\bSQL\\s*:', 1)")} END, '') AS reasoning FROM l""",
    "text_output_blocks": f"""WITH {EX} SELECT example_id, {_STRIP.format("coalesce(list_last(regexp_extract_all(response, '(?s)```[a-zA-Z]*\\n(.*?)```', 1)), '')")} AS sql,
        {_STRIP.format("regexp_replace(regexp_replace(regexp_extract(response, '(?s)^(.*)```[a-zA-Z]*\\n.*?```', 1), '\\n---\\s*$', ''), '(?i)###\\s*(?:Final\\s+)?(?:SQL\\s+)?Query:?\\s*$', '')")} AS before FROM ex""",
    "text_prompt_parts": f"""WITH {EX} SELECT example_id, trim(regexp_extract(instruction, '(?s)\\n(?:Schema|Schéma|Esquema):\\n(.*?)\\n+(?:Question|Frage|Pregunta):', 1)) AS schema_context,
        regexp_extract(instruction, '(?s)\\n(?:Question|Frage|Pregunta):\\s*(.*?)\\s*$', 1) AS question FROM ex""",
    "text_question_complexity": f"""WITH {EX}, m AS (SELECT example_id, len([x FOR x IN regexp_split_to_array(question, '\\s+') IF x <> '']) AS n, ({_KEYWORD}) AS k, len(regexp_extract_all(lower(question), '{T.RELATIVE}')) AS r,
        len(regexp_extract_all(lower(question), '{T.AGGREGATE}')) AS a, len(regexp_extract_all(question, ',')) AS c FROM ex),
        s AS (SELECT example_id, coalesce(CASE WHEN n < 12 THEN 0.0::DOUBLE ELSE least(round(least(n / 40.0::DOUBLE, 0.3::DOUBLE) + CASE WHEN k THEN 0.15 ELSE 0 END + least(r * 0.1::DOUBLE, 0.2::DOUBLE) + CASE WHEN a >= 2 THEN 0.2 WHEN a = 1 THEN 0.05 ELSE 0 END + least(c * 0.05::DOUBLE, 0.15::DOUBLE), 6), 1.0::DOUBLE) END, 0.0::DOUBLE) AS score FROM m)
        SELECT example_id, score, score >= 0.6 AS is_complex FROM s""",
    "text_keyword_augment": f"""WITH {EX}, w AS (SELECT DISTINCT example_id, db_id, unnest(regexp_extract_all(lower(question), '[a-z_][a-z0-9_]*')) AS w FROM ex),
        n AS (SELECT db_id, lower(table_name) AS w, 't' AS k FROM cat_columns UNION SELECT db_id, lower(column_name), 'c' FROM cat_columns),
        h AS (SELECT example_id, string_agg(w, ', ' ORDER BY w) FILTER (k = 't') AS t, string_agg(w, ', ' ORDER BY w) FILTER (k = 'c') AS c FROM w JOIN n USING (db_id, w) GROUP BY example_id),
        g AS (SELECT example_id, concat_ws('; ', 'tables: ' || t, 'columns: ' || c) AS hint FROM h)
        SELECT example_id, CASE WHEN hint <> '' THEN question || ' [' || hint || ']' ELSE question END AS augmented FROM ex LEFT JOIN g USING (example_id) WHERE question IS NOT NULL""",
    "text_evidence_hint": "SELECT run_id, example_id, CASE WHEN trim(evidence) <> '' THEN question || chr(10) || 'Hint: ' || evidence ELSE question END AS prompt, db_id || '__' || md5(question)[1:8] AS row_key FROM eval_rows",
    "text_edge_metadata": "SELECT src_id, dst_id, edge_type, weight, length(metadata)::INT AS json_chars, len(json_keys(metadata))::INT AS n_keys FROM kg_edges",
    "text_chat_prompt": f"WITH {EX} SELECT example_id, md5('<|im_start|>system' || chr(10) || 'You write SQL.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(instruction, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant') AS prompt_md5 FROM ex",
    "text_reasoning_trace": f"""WITH {EX}, t AS (SELECT example_id, concat_ws(chr(10), 'Tables needed: ' || CASE WHEN len({_TABLES}) > 0 THEN array_to_string({_TABLES}, ', ') END,
        CASE WHEN contains(upper(sql), 'JOIN') THEN 'Need JOINs to connect tables via foreign keys' END, CASE WHEN contains(upper(sql), 'WHERE') THEN 'Apply WHERE conditions to filter results' END,
        CASE WHEN contains(upper(sql), 'GROUP BY') THEN 'Group results for aggregation' END, CASE WHEN contains(upper(sql), 'ORDER BY') THEN 'Order the results' END,
        CASE WHEN contains(upper(sql), 'HAVING') THEN 'Filter aggregated results with HAVING' END, CASE WHEN contains(upper(sql), 'LIMIT') THEN 'Limit output rows' END) AS trace FROM ex WHERE sql IS NOT NULL)
        SELECT example_id, CASE WHEN trace = '' THEN 'Direct query, no complex reasoning needed.' ELSE trace END AS trace FROM t""",
}
