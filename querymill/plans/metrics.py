"""Metrics over runs: retrieved tables are those of a run's schema context, gold tables those its gold statement reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.operators import metrics as M
from querymill.operators.dedupe import keep_first
from querymill.session import table


def _means():
    return {"n": F.count("*")} | {c: F.round(F.avg(F.col(c).cast("double")), 6) for c in ("ex", "em", "recall", "precision")}


def _runs(spark, d):
    """Runs once each: repeated rows of a run and example count once, the last one."""
    return keep_first(table(spark, d, "eval_rows"), ["run_id", "example_id"], [F.col("run_at").desc_nulls_last(), F.col("retry_count").desc_nulls_last(), F.md5(F.coalesce("predicted_sql", F.lit(""))), F.md5(F.coalesce("raw_output", F.lit(""))), "ex", "em", "recall", "precision_val", "correction_applied"])


def _rows(spark, d):
    """``run_id, example_id, db_id, gold, got, n_tokens, ex, em`` with sorted gold tables and context tables in their order."""
    gold = F.array_sort(F.array_distinct(T.matches(F.lower("gold_sql"), r"(?:from|join)\s+(?:main\.)?[`\"\[]?([a-z0-9_]+)", 1)))
    got = F.array_distinct(T.matches(F.lower("schema_context"), r"create table ([a-z0-9_]+)", 1))
    return _runs(spark, d).select("run_id", "example_id", "db_id", gold.alias("gold"), got.alias("got"), F.size(T.blank_tokens(F.col("schema_context"))).alias("n_tokens"), "ex", "em", "retry_count", "correction_applied", "run_at")


def _scored(spark, d):
    g, r = F.col("gold"), F.col("got")
    rows = _rows(spark, d).withColumns({"recall": M.recall(g, r), "precision": M.precision(g, r)})
    bucket = F.when(F.size("gold") == 1, "1").when(F.size("gold") == 2, "2").when(F.size("gold") == 3, "3").otherwise("4+")
    return rows.withColumns({"f1": M.f1(F.col("recall"), F.col("precision")), "complexity": bucket})


def run_rows(spark, d):
    return _runs(spark, d).select("run_id", "example_id", "run_at", "ex", "em")


def retrieval_scores(spark, d):
    g, r = F.col("gold"), F.col("got")
    return _scored(spark, d).select(
        "run_id", "example_id", F.array_join("gold", " ").alias("gold_tables"), *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")],
        F.round(M.ndcg(g, r, 15), 6).alias("ndcg15"), F.round(M.reciprocal_rank(g, r), 6).alias("rr"), M.hit_at(g, r, 3).alias("hit3"), M.hit_at(g, r, 5).alias("hit5"),
    )


def missed_extra(spark, d):
    rows = _rows(spark, d)
    part = lambda kind, c: rows.select(F.lit(kind).alias("kind"), F.explode(c).alias("table_name"))
    both = part("missed", F.array_except("gold", "got")).unionByName(part("extra", F.array_except("got", "gold")))
    counts = both.groupBy("kind", "table_name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), "table_name")
    return counts.withColumn("rank", F.row_number().over(order)).where("rank <= 15")


def stratified(spark, d):
    return M.report(_scored(spark, d), [[], ["complexity"], ["db_id"], ["run_id"]], _means())


def f1_by_database(spark, d):
    """F1 of the mean recall and precision, spread of F1, and share of examples without any gold table."""
    g = _scored(spark, d).groupBy("db_id").agg(F.avg("recall").alias("r"), F.avg("precision").alias("p"), F.stddev_pop("f1").alias("sd"), (F.count_if(F.col("recall") == 0) / F.count("*")).alias("z"), (F.count_if((F.col("recall") == 1) & (F.col("precision") == 1)) / F.count("*")).alias("x"))
    return g.select("db_id", F.round(M.f1(F.col("r"), F.col("p")), 6).alias("f1_of_means"), F.round("sd", 6).alias("f1_sd"), F.round("z", 6).alias("zero_recall"), F.round("x", 6).alias("exact"))


def quality_counts(spark, d):
    extra = F.size(F.array_except("got", "gold"))
    return _scored(spark, d).agg(
        F.count_if(F.col("recall") == 1).alias("perfect"), F.count_if((F.col("recall") == 1) & (F.col("precision") == 1)).alias("exact"), F.count_if(F.col("recall") == 0).alias("zero"), F.count_if(F.col("recall") < 1).alias("missed"),
        F.count_if(extra > 3).alias("noisy"), F.count_if(F.col("n_tokens") > 60).alias("long_context"),
    )


def recall_histogram(spark, d):
    r = F.col("recall")
    bin_ = F.when(r == 0, "0").when(r < 0.5, "(0, .5)").when(r < 1, "[.5, 1)").otherwise("1")
    return _scored(spark, d).groupBy("run_id", bin_.alias("bin")).agg(F.count("*").alias("n"))


def context_percentiles(spark, d):
    """Positional percentiles of context sizes per database, from the counts of distinct sizes: no list of a whole group."""
    n = _rows(spark, d).groupBy("db_id", "n_tokens").agg(F.count("*").alias("k"))
    w = Window.partitionBy("db_id")
    run = n.withColumn("upto", F.sum("k").over(w.orderBy("n_tokens"))).withColumn("n", F.sum("k").over(w))
    place = lambda num, den: F.min(F.when(F.col("upto") > F.floor(F.col("n") * num / den), F.col("n_tokens")))
    return run.groupBy("db_id").agg(place(1, 4).alias("p25"), place(3, 4).alias("p75"), place(95, 100).alias("p95"))


def retry_totals(spark, d):
    return _runs(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("retry_count") > 0).alias("n_retried"), F.round(F.avg("retry_count"), 4).alias("mean_retries"), F.count_if(F.col("correction_applied")).alias("n_corrected"))


def running_accuracy(spark, d):
    w = Window.partitionBy("run_id").orderBy("run_at", "example_id")
    x = F.coalesce(F.col("ex").cast("double"), F.lit(0.0))
    return _runs(spark, d).select("run_id", "example_id", F.row_number().over(w).alias("pos"), F.round(F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running_ex"))


def role_recall(spark, d):
    """Recall of gold columns by role (key, referring, other) of the contexts' tables; null where a run has none of a role."""
    cat = table(spark, d, "cat_columns").select("db_id", F.lower("table_name").alias("t"), F.lower("column_name").alias("c"), "is_pk").distinct()
    fk = table(spark, d, "cat_fks").select("db_id", F.lower("from_table").alias("t"), F.lower("from_column").alias("c")).distinct().withColumn("is_fk", F.lit(True))
    role = cat.join(fk, ["db_id", "t", "c"], "left").select("db_id", "t", "c", F.when(F.col("is_pk"), "pk").when(F.col("is_fk"), "fk").otherwise("other").alias("role"))
    runs = _runs(spark, d).select("run_id", "example_id", "db_id", F.lower("gold_sql").alias("g"), F.lower("schema_context").alias("s"))
    gold = runs.select("run_id", "example_id", "db_id", "s", F.explode(F.array_distinct(T.matches(F.col("g"), "[a-z_][a-z0-9_]*"))).alias("c"))
    shown = gold.join(role.groupBy("db_id", "c", "role").agg(F.count("*").alias("k")), ["db_id", "c"]).where("k = 1").withColumn("hit", F.col("s").contains(F.col("c")).cast("double"))
    return shown.groupBy("run_id").agg(*[F.round(F.avg(F.when(F.col("role") == r, F.col("hit"))), 6).alias(f"{r}_recall") for r in ("pk", "fk", "other")])


def fk_coverage(spark, d):
    """References between gold tables, and how many have both ends retrieved; runs without any count as covered."""
    rows = _rows(spark, d)
    fk = table(spark, d, "cat_fks").select("db_id", F.lower("from_table").alias("a"), F.lower("to_table").alias("b")).distinct()
    pairs = rows.join(fk, "db_id").where(F.array_contains("gold", F.col("a")) & F.array_contains("gold", F.col("b")))
    per = pairs.groupBy("run_id", "example_id").agg(F.avg((F.array_contains("got", F.col("a")) & F.array_contains("got", F.col("b"))).cast("double")).alias("c"))
    return rows.join(per, ["run_id", "example_id"], "left").groupBy("run_id").agg(F.round(F.avg(F.coalesce("c", F.lit(1.0))), 6).alias("fk_recall"), F.count("c").alias("n_with_pairs"))


def exact_matches(spark, d):
    """EM anew from the normalised statements."""
    same = F.coalesce(T.normal_sql(F.col("predicted_sql")) == T.normal_sql(F.col("gold_sql")), F.lit(False))
    return _runs(spark, d).groupBy("run_id").agg(F.count_if(same).alias("n_exact"), F.count("*").alias("n"))


def worst_examples(spark, d):
    w = Window.partitionBy("db_id").orderBy("f1", F.col("n_tokens").desc(), "run_id", "example_id")
    return _scored(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("db_id", "rank", "run_id", "example_id", F.round("f1", 6).alias("f1"), "n_tokens")


def run_comparison(spark, d):
    """Accuracy by database with a column per run half (by a hash of the run's name)."""
    x = _runs(spark, d).withColumn("half", F.when(F.substring(F.md5("run_id"), 1, 1) < "8", "a").otherwise("b"))
    return x.groupBy("db_id").pivot("half", ["a", "b"]).agg(F.round(F.avg(F.coalesce(F.col("ex").cast("double"), F.lit(0.0))), 6))


def failure_categories(spark, d):
    p = F.lower(F.coalesce("predicted_sql", F.lit("")))
    kind = F.when(F.trim(p) == "", "blank").when(F.col("ex"), "right").when(p == F.lower("gold_sql"), "same text").when(T.is_complex_sql(F.col("gold_sql")) & ~T.is_complex_sql(F.col("predicted_sql")), "too simple").otherwise("other")
    return _runs(spark, d).groupBy("run_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def _difficulty():
    """Stands for a label that runs don't carry: by gold tables and by what the gold statement uses."""
    n = F.size("gold")
    return F.when((n >= 3) | ((n >= 2) & F.col("complex")), "challenging").when((n >= 2) | F.col("complex"), "moderate").otherwise("simple")


def _labelled(spark, d):
    hard = _runs(spark, d).select("run_id", "example_id", T.is_complex_sql(F.col("gold_sql")).alias("complex"))
    return _scored(spark, d).join(hard, ["run_id", "example_id"]).withColumn("difficulty", _difficulty())


def by_difficulty(spark, d):
    return _labelled(spark, d).groupBy("difficulty").agg(*[v.alias(k) for k, v in _means().items()])


def database_means(spark, d):
    """Means of each database, F1 from the mean recall and precision."""
    g, r = F.col("gold"), F.col("got")
    x = _labelled(spark, d).withColumns({"ndcg15": M.ndcg(g, r, 15), "rr": M.reciprocal_rank(g, r), "hit3": M.hit_at(g, r, 3), "hit5": M.hit_at(g, r, 5), "tokens": F.col("n_tokens").cast("double"), "gold_n": F.size("gold").cast("double"), "extra": F.size(F.array_except("got", "gold")).cast("double")})
    names = ("recall", "precision", "ndcg15", "rr", "hit3", "hit5", "tokens", "gold_n", "extra")
    out = x.groupBy("db_id").agg(F.count("*").alias("n"), *[F.avg(F.col(c)).alias(c) for c in names], F.avg(F.coalesce(F.col("ex").cast("double"), F.lit(0.0))).alias("ex"))
    return out.select("db_id", "n", *[F.round(c, 6).alias(c) for c in (*names, "ex")], F.round(M.f1(F.col("recall"), F.col("precision")), 6).alias("f1"))


def column_scores(spark, d):
    """Recall and precision of (table, column) pairs: gold ones are columns of gold tables that the gold statement names, retrieved ones all of retrieved tables."""
    cat = table(spark, d, "cat_columns").select("db_id", F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct()
    ids = _runs(spark, d).select("run_id", "example_id", T.matches(F.lower("gold_sql"), "[a-z_][a-z0-9_]*").alias("ids"))
    x = _rows(spark, d).join(ids, ["run_id", "example_id"]).join(cat, "db_id")
    gold = F.array_contains("gold", F.col("t")) & F.array_contains("ids", F.col("c"))
    got = F.array_contains("got", F.col("t"))
    per = x.groupBy("run_id", "example_id").agg(F.count_if(gold).alias("g"), F.count_if(got).alias("r"), F.count_if(gold & got).alias("b"))
    share = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    return per.groupBy("run_id").agg(F.round(F.avg(share(F.col("b"), F.col("g"), 1.0)), 6).alias("column_recall"), F.round(F.avg(share(F.col("b"), F.col("r"), 0.0)), 6).alias("column_precision"), F.count("*").alias("n"))


def orphaned_references(spark, d):
    """Of references from a retrieved table to a gold one, the share whose target wasn't retrieved; 0 without any."""
    fk = table(spark, d, "cat_fks").select("db_id", F.lower("from_table").alias("a"), F.lower("to_table").alias("b"))
    x = _rows(spark, d).join(fk, "db_id").where(F.array_contains("got", F.col("a")) & F.array_contains("gold", F.col("b")))
    per = x.groupBy("run_id", "example_id").agg(F.avg((~F.array_contains("got", F.col("b"))).cast("double")).alias("o"))
    return _rows(spark, d).join(per, ["run_id", "example_id"], "left").groupBy("run_id").agg(F.round(F.avg(F.coalesce("o", F.lit(0.0))), 6).alias("orphaned_rate"), F.count("o").alias("n_with_references"))


def context_use(spark, d):
    """How much of the contexts is needed: tokens of a context that holds the gold tables alone / tokens given, and the share of tables that are extra; contexts over 2,000 tokens are counted."""
    cols = table(spark, d, "cat_columns").groupBy("db_id", F.lower("table_name").alias("t")).agg((F.count("*") + 2).alias("k"))
    gold = _rows(spark, d).select("run_id", "example_id", "db_id", F.explode("gold").alias("t")).join(cols, ["db_id", "t"]).groupBy("run_id", "example_id").agg(F.sum("k").alias("need"))
    x = _rows(spark, d).join(gold, ["run_id", "example_id"], "left")
    recall = F.when(F.col("n_tokens") > 0, F.coalesce("need", F.lit(0)) / F.col("n_tokens")).otherwise(1.0)
    extra = F.when(F.size("got") > 0, F.size(F.array_except("got", "gold")) / F.size("got")).otherwise(0.0)
    return x.groupBy("run_id").agg(F.round(F.avg(recall), 6).alias("token_recall"), F.round(F.avg(extra), 6).alias("redundant_ratio"), F.count_if(F.col("n_tokens") > 2000).alias("over_2000"), F.max("n_tokens").alias("largest"))


def extreme_examples(spark, d):
    """The three largest contexts of each run among those with perfect recall, and among the others."""
    part = F.when(F.col("recall") == 1, "perfect").otherwise("missed")
    w = Window.partitionBy("run_id", "part").orderBy(F.col("n_tokens").desc(), "example_id")
    return _scored(spark, d).withColumn("part", part).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("run_id", "part", "rank", "example_id", "n_tokens")


QUERIES = {f"metric_{f.__name__}": f for f in (
    run_rows, retrieval_scores, missed_extra, stratified, f1_by_database, quality_counts, recall_histogram, context_percentiles, retry_totals, running_accuracy,
    role_recall, fk_coverage, exact_matches, worst_examples, run_comparison, failure_categories,
    by_difficulty, database_means, column_scores, orphaned_references, context_use, extreme_examples,
)}

_R = """r AS (SELECT * FROM eval_rows QUALIFY row_number() OVER (PARTITION BY run_id, example_id ORDER BY run_at DESC, retry_count DESC NULLS LAST, md5(coalesce(predicted_sql, '')), md5(coalesce(raw_output, '')), ex NULLS FIRST, em NULLS FIRST, recall NULLS FIRST, precision_val NULLS FIRST, correction_applied NULLS FIRST) = 1)"""
_S = _R + """, t AS (SELECT run_id, example_id, db_id, coalesce(list_sort(list_distinct(regexp_extract_all(lower(gold_sql), '(?:from|join)\\s+(?:main\\.)?[`"\\[]?([a-z0-9_]+)', 1))), []) AS gold,
    coalesce(regexp_extract_all(lower(schema_context), 'create table ([a-z0-9_]+)', 1), []) AS got0, coalesce(len([x FOR x IN regexp_split_to_array(lower(schema_context), '\\s+') IF x <> '']), 0)::INT AS n_tokens, ex, em FROM r),
    u AS (SELECT *, list_filter(got0, lambda x, i: list_position(got0, x) = i) AS got FROM t),
    v AS (SELECT *, CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(gold, got)) / len(gold) END::DOUBLE AS recall, CASE WHEN len(got) = 0 THEN 0.0 ELSE len(list_intersect(gold, got)) / len(got) END::DOUBLE AS precision,
        CASE len(gold) WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '4+' END AS complexity FROM u),
    s AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM v)"""
_COMPLEX = "regexp_matches({}, '" + T.COMPLEX_SQL + "')"


_LAB = _S + f""", hard AS (SELECT run_id, example_id, coalesce({_COMPLEX.format('gold_sql')}, false) AS complex FROM r), lab AS (SELECT s.*, CASE WHEN len(gold) >= 3 OR (len(gold) >= 2 AND complex) THEN 'challenging' WHEN len(gold) >= 2 OR complex THEN 'moderate' ELSE 'simple' END AS difficulty FROM s JOIN hard USING (run_id, example_id))"""
_RANKED = """g AS (SELECT *, list_sum([CASE WHEN list_contains(gold, x) THEN 1 / log2(i + 1) ELSE 0 END FOR x, i IN got[1:15]]) AS dcg, list_sum([1 / log2(i + 1) FOR x, i IN gold[1:15]]) AS ideal, list_min([i FOR x, i IN got IF list_contains(gold, x)]) AS first FROM lab),
    k AS (SELECT *, CASE WHEN len(gold) = 0 THEN 1 ELSE coalesce(dcg, 0) / ideal END AS ndcg15, coalesce(1 / first, 0) AS rr, CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END AS hit3, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END AS hit5, n_tokens AS tokens, len(gold) AS gold_n, len([x FOR x IN got IF NOT list_contains(gold, x)]) AS extra FROM g)"""
_MEANS = ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in ("recall", "precision", "ndcg15", "rr", "hit3", "hit5", "tokens", "gold_n", "extra"))


def _normal(c: str) -> str:
    b = f"""regexp_replace(trim(regexp_replace(regexp_replace({c}, '(''[^'']*''|"[^"]*"|`[^`]*`)|--[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*\\*+/', '\\1 ', 'g'), '\\s+', ' ', 'g')), '[; ]+$', '')"""
    words = ", ".join(f"'{w}'" for w in T.SQL_KEYWORDS)
    return f"""array_to_string([CASE WHEN lower(t) IN ({words}) THEN upper(t) ELSE t END FOR t IN regexp_extract_all({b}, '(?s)''[^'']*''|"[^"]*"|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]')], '')"""


ORACLE = {
    "metric_by_difficulty": f"WITH {_LAB} SELECT difficulty, count(*) AS n, round(avg(ex::INT::DOUBLE), 6) AS ex, round(avg(em::INT::DOUBLE), 6) AS em, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM lab GROUP BY 1",
    "metric_database_means": f"WITH {_LAB}, {_RANKED} SELECT db_id, count(*) AS n, {_MEANS}, round(avg(coalesce(ex::INT::DOUBLE, 0)), 6) AS ex, round(CASE WHEN avg(recall) + avg(precision) > 0 THEN 2 * avg(recall) * avg(precision) / (avg(recall) + avg(precision)) ELSE 0 END, 6) AS f1 FROM k GROUP BY db_id",
    "metric_column_scores": f"""WITH {_S}, i AS (SELECT run_id, example_id, coalesce(regexp_extract_all(lower(gold_sql), '[a-z_][a-z0-9_]*'), []) AS ids FROM r), c AS (SELECT DISTINCT db_id, lower(table_name) AS t, lower(column_name) AS c FROM cat_columns),
        p AS (SELECT run_id, example_id, count(*) FILTER (list_contains(gold, t) AND list_contains(ids, c)) AS g, count(*) FILTER (list_contains(got, t)) AS r, count(*) FILTER (list_contains(gold, t) AND list_contains(ids, c) AND list_contains(got, t)) AS b FROM s JOIN i USING (run_id, example_id) JOIN c USING (db_id) GROUP BY ALL)
        SELECT run_id, round(avg(CASE WHEN g > 0 THEN b / g ELSE 1 END), 6) AS column_recall, round(avg(CASE WHEN r > 0 THEN b / r ELSE 0 END), 6) AS column_precision, count(*) AS n FROM p GROUP BY run_id""",
    "metric_orphaned_references": f"""WITH {_S}, o AS (SELECT run_id, example_id, avg((NOT list_contains(got, lower(to_table)))::INT::DOUBLE) AS o FROM s JOIN cat_fks f USING (db_id) WHERE list_contains(got, lower(from_table)) AND list_contains(gold, lower(to_table)) GROUP BY ALL)
        SELECT run_id, round(avg(coalesce(o, 0)), 6) AS orphaned_rate, count(o) AS n_with_references FROM s LEFT JOIN o USING (run_id, example_id) GROUP BY run_id""",
    "metric_context_use": f"""WITH {_S}, c AS (SELECT db_id, lower(table_name) AS t, count(*) + 2 AS k FROM cat_columns GROUP BY ALL), need AS (SELECT run_id, example_id, sum(k) AS need FROM (SELECT run_id, example_id, db_id, unnest(gold) AS t FROM s) JOIN c USING (db_id, t) GROUP BY ALL)
        SELECT run_id, round(avg(CASE WHEN n_tokens > 0 THEN coalesce(need, 0) / n_tokens ELSE 1 END), 6) AS token_recall, round(avg(CASE WHEN len(got) > 0 THEN len([x FOR x IN got IF NOT list_contains(gold, x)]) / len(got) ELSE 0 END), 6) AS redundant_ratio, count(*) FILTER (n_tokens > 2000) AS over_2000, max(n_tokens) AS largest FROM s LEFT JOIN need USING (run_id, example_id) GROUP BY run_id""",
    "metric_extreme_examples": f"WITH {_S}, x AS (SELECT *, CASE WHEN recall = 1 THEN 'perfect' ELSE 'missed' END AS part FROM s) SELECT run_id, part, row_number() OVER (PARTITION BY run_id, part ORDER BY n_tokens DESC, example_id)::INT AS rank, example_id, n_tokens FROM x QUALIFY rank <= 3",
    "metric_run_rows": f"WITH {_R} SELECT run_id, example_id, run_at, ex, em FROM r",
    "metric_retrieval_scores": f"""WITH {_S}, g AS (SELECT *, list_sum([CASE WHEN list_contains(gold, x) THEN 1 / log2(i + 1) ELSE 0 END FOR x, i IN got[1:15]]) AS dcg, list_sum([1 / log2(i + 1) FOR x, i IN gold[1:15]]) AS ideal, list_min([i FOR x, i IN got IF list_contains(gold, x)]) AS first FROM s)
        SELECT run_id, example_id, array_to_string(gold, ' ') AS gold_tables, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(CASE WHEN len(gold) = 0 THEN 1 ELSE coalesce(dcg, 0) / ideal END, 6) AS ndcg15, round(coalesce(1 / first, 0), 6) AS rr,
        CASE WHEN len(list_intersect(gold, got[1:3])) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit3, CASE WHEN len(list_intersect(gold, got[1:5])) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit5 FROM g""",
    "metric_missed_extra": f"""WITH {_S}, b AS (SELECT 'missed' AS kind, unnest([x FOR x IN gold IF NOT list_contains(got, x)]) AS table_name FROM s UNION ALL SELECT 'extra', unnest([x FOR x IN got IF NOT list_contains(gold, x)]) FROM s), c AS (SELECT kind, table_name, count(*) AS n FROM b GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, table_name)::INT AS rank FROM c QUALIFY rank <= 15""",
    "metric_stratified": f"""WITH {_S} SELECT concat_ws('+', CASE WHEN grouping(complexity) = 0 THEN 'complexity' END, CASE WHEN grouping(db_id) = 0 THEN 'db_id' END, CASE WHEN grouping(run_id) = 0 THEN 'run_id' END) AS grouping, complexity, db_id, run_id, count(*) AS n,
        round(avg(ex::INT::DOUBLE), 6) AS ex, round(avg(em::INT::DOUBLE), 6) AS em, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM s GROUP BY GROUPING SETS ((), (complexity), (db_id), (run_id))""",
    "metric_f1_by_database": f"""WITH {_S}, g AS (SELECT db_id, avg(recall) AS r, avg(precision) AS p, stddev_pop(f1) AS sd, count(*) FILTER (recall = 0) / count(*) AS z, count(*) FILTER (recall = 1 AND precision = 1) / count(*) AS x FROM s GROUP BY db_id)
        SELECT db_id, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1_of_means, round(sd, 6) AS f1_sd, round(z, 6) AS zero_recall, round(x, 6) AS exact FROM g""",
    "metric_quality_counts": f"""WITH {_S} SELECT count(*) FILTER (recall = 1) AS perfect, count(*) FILTER (recall = 1 AND precision = 1) AS exact, count(*) FILTER (recall = 0) AS zero, count(*) FILTER (recall < 1) AS missed,
        count(*) FILTER (len([x FOR x IN got IF NOT list_contains(gold, x)]) > 3) AS noisy, count(*) FILTER (n_tokens > 60) AS long_context FROM s""",
    "metric_recall_histogram": f"WITH {_S} SELECT run_id, CASE WHEN recall = 0 THEN '0' WHEN recall < 0.5 THEN '(0, .5)' WHEN recall < 1 THEN '[.5, 1)' ELSE '1' END AS bin, count(*) AS n FROM s GROUP BY ALL",
    "metric_context_percentiles": f"WITH {_S}, l AS (SELECT db_id, list_sort(list(n_tokens)) AS l, count(*) AS n FROM s GROUP BY 1) SELECT db_id, l[n // 4 + 1] AS p25, l[3 * n // 4 + 1] AS p75, l[95 * n // 100 + 1] AS p95 FROM l",
    "metric_retry_totals": f"WITH {_R} SELECT run_id, count(*) AS n, count(*) FILTER (retry_count > 0) AS n_retried, round(avg(retry_count), 4) AS mean_retries, count(*) FILTER (correction_applied) AS n_corrected FROM r GROUP BY run_id",
    "metric_running_accuracy": f"WITH {_R} SELECT run_id, example_id, row_number() OVER w::INT AS pos, round(avg(coalesce(ex::INT::DOUBLE, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_ex FROM r WINDOW w AS (PARTITION BY run_id ORDER BY run_at, example_id)",
    "metric_role_recall": f"""WITH {_R}, role AS (SELECT DISTINCT c.db_id, lower(c.table_name) AS t, lower(c.column_name) AS c, CASE WHEN is_pk THEN 'pk' WHEN f.db_id IS NOT NULL THEN 'fk' ELSE 'other' END AS role FROM cat_columns c LEFT JOIN (SELECT DISTINCT db_id, lower(from_table) AS t, lower(from_column) AS c FROM cat_fks) f
        ON c.db_id = f.db_id AND lower(c.table_name) = f.t AND lower(c.column_name) = f.c), one AS (SELECT db_id, c, role FROM role GROUP BY ALL HAVING count(*) = 1), g AS (SELECT run_id, db_id, lower(schema_context) AS s, unnest(list_distinct(regexp_extract_all(lower(gold_sql), '[a-z_][a-z0-9_]*'))) AS c FROM r),
        h AS (SELECT run_id, role, contains(s, c)::INT::DOUBLE AS hit FROM g JOIN one USING (db_id, c)) SELECT run_id, round(avg(hit) FILTER (role = 'pk'), 6) AS pk_recall, round(avg(hit) FILTER (role = 'fk'), 6) AS fk_recall, round(avg(hit) FILTER (role = 'other'), 6) AS other_recall FROM h GROUP BY run_id""",
    "metric_fk_coverage": f"""WITH {_S}, k AS (SELECT DISTINCT db_id, lower(from_table) AS a, lower(to_table) AS b FROM cat_fks), p AS (SELECT run_id, example_id, avg((list_contains(got, a) AND list_contains(got, b))::INT::DOUBLE) AS c FROM s JOIN k USING (db_id) WHERE list_contains(gold, a) AND list_contains(gold, b) GROUP BY ALL)
        SELECT run_id, round(avg(coalesce(c, 1.0)), 6) AS fk_recall, count(c) AS n_with_pairs FROM s LEFT JOIN p USING (run_id, example_id) GROUP BY run_id""",
    "metric_exact_matches": f"WITH {_R} SELECT run_id, count(*) FILTER ({_normal('predicted_sql')} = {_normal('gold_sql')}) AS n_exact, count(*) AS n FROM r GROUP BY run_id",
    "metric_worst_examples": f"WITH {_S} SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY f1, n_tokens DESC, run_id, example_id)::INT AS rank, run_id, example_id, round(f1, 6) AS f1, n_tokens FROM s QUALIFY rank <= 3",
    "metric_run_comparison": f"WITH {_R} SELECT db_id, round(avg(coalesce(ex::INT::DOUBLE, 0)) FILTER (md5(run_id)[1] < '8'), 6) AS a, round(avg(coalesce(ex::INT::DOUBLE, 0)) FILTER (md5(run_id)[1] >= '8'), 6) AS b FROM r GROUP BY db_id",
    "metric_failure_categories": f"""WITH {_R} SELECT run_id, CASE WHEN trim(lower(coalesce(predicted_sql, ''))) = '' THEN 'blank' WHEN ex THEN 'right' WHEN lower(coalesce(predicted_sql, '')) = lower(gold_sql) THEN 'same text'
        WHEN coalesce({_COMPLEX.format('gold_sql')}, false) AND NOT coalesce({_COMPLEX.format('predicted_sql')}, false) THEN 'too simple' ELSE 'other' END AS kind, count(*) AS n FROM r GROUP BY ALL""",
}
