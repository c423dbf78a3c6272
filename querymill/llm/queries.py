"""The queries of this subpackage: name -> function of (session, data directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.sqltext import letter_words, source_tables
from querymill.llm import cooccurrence, leakage, mixing, neighbours, overlap, packing, pair_defects, repetition
from querymill.operators.dedupe import latest
from querymill.runtime import bounded_rows, cut
from querymill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.flag_defects(table(spark, d, "sft_examples"), table(spark, d, "documents")).select("example_id", "defect")


def p1_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.flag_defects(table(spark, d, "sft_examples"), table(spark, d, "documents")).groupBy("defect").agg(F.count("*").alias("n_examples"))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    one = latest(table(spark, d, "sft_examples"), "example_id", "ingested_at", ["db_id", "question", "sql"])
    catalog = table(spark, d, "cat_columns").groupBy("db_id").agg(F.collect_set(F.lower("table_name")).alias("known"))
    return one.join(catalog, "db_id", "left").select(
        letter_words(F.col("question")).alias("words"),
        F.array_intersect(source_tables(F.col("sql")), F.coalesce("known", F.array().cast("array<string>"))).alias("tables"),
    )


def p2_word_tables(spark: SparkSession, d: str) -> DataFrame:
    out = cooccurrence.association(_baskets(spark, d), left="words", right="tables", min_count=8)
    return out.select(F.col("left_item").alias("word"), F.col("right_item").alias("table_name"), "n_both", "n_left", "n_right", "n", F.round("lift", 6).alias("lift"))


def p2_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs, the rare ones too, which p2_word_tables leaves out as its DuckDB statement does."""
    out = cooccurrence.association(_baskets(spark, d), left="words", right="tables", min_count=1)
    return out.select(F.col("left_item").alias("word"), F.col("right_item").alias("table_name"), "n_both", "n_left", "n_right", "n", F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = cooccurrence.association(_baskets(spark, d), left="words", right="tables", min_count=8, min_lift=6)
    return out.select(F.col("left_item").alias("word"), F.col("right_item").alias("table_name"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_nodes(table(spark, d, "kg_nodes"), k=5, min_similarity=0.95)
    return neighbours.similar_pairs(near, min_similarity=0.95)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_nodes(table(spark, d, "kg_nodes"), k=5, query_share=20, **neighbours.HIGH_RECALL)
    return near.select(F.col("node").alias("node_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "rank")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    size = F.coalesce(F.length("instruction"), F.lit(0)) + F.coalesce(F.length("response"), F.lit(0))
    rows = table(spark, d, "sft_examples").select("example_id", "ingested_at", "split", "source", "thinking_mode", size.alias("size"))
    train = latest(rows, "example_id", "ingested_at", ["split", "source", "thinking_mode", "size"]).where("split = 'train'")
    return mixing.Mix(train, table(spark, d, "mix_targets"), dims=["source", "thinking_mode"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).cells().where("short").select("source", "thinking_mode")


def p4_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).sample()


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().select("source", "thinking_mode", "target_share", "max_repeats", "n_rows", "size", F.round("uses", 6).alias("uses"), "rows_used", "reached_size", F.round("reached_share", 6).alias("reached_share"), "short")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, d, "sft_examples"), threshold=0.6)
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = overlap.covered_rows(table(spark, d, "sft_examples"), threshold=0.6)
    return out.select("eval_id", "split", "source", "n_words", "n_partners", F.round("best_coverage", 6).alias("best_coverage"), F.round("coverage", 6).alias("coverage"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    out = overlap.overlap_report(overlap.covered_rows(table(spark, d, "sft_examples"), threshold=0.6))
    return out.select("split", "source", "n_pairs", "n_eval_rows", F.round("mean_coverage", 6).alias("mean_coverage"))


def p5_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How much of question and statement of each pair stands in the same order; chains aren't expressed in SQL, the tests hold them against brute force."""
    ex = table(spark, d, "sft_examples")
    out = overlap.alignment(overlap.cross_split_pairs(ex, threshold=0.6), ex)
    return out.select("train_id", "eval_id", "split", "eval_source", *[F.round(c, 6).alias(c) for c in ("jaccard", "question_coverage", "sql_coverage")])


def _packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = {r["pack_id"]: r["capacity_tokens"] for r in bounded_rows(table(spark, d, "pack_sizes").where("pack_id is not null and capacity_tokens > 0"), 1_000, "pack_sizes")}
    return packing.pack(packing.token_sizes(table(spark, d, "documents")), capacities)


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text is placed, none that fits is cut, no bin is over its capacity."""
    return packing.invariants(cut(_packed(spark, d)))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "bench_items"), words=12)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that leak nothing, with their type."""
    docs = table(spark, d, "documents").select("doc_id", "doc_type")
    return leakage.without_leaks(docs, p7_leaks(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that their own or their host's verdict takes out, then the exact check of the document's own share."""
    return repetition.flag_repetition(table(spark, d, "documents")).where("verdict <> 'clean'").where("fails").select("doc_id")


def p8_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return repetition.flag_repetition(table(spark, d, "documents")).select("doc_id", "verdict")


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    out = repetition.repeated_share(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_repeated", F.round("repeated_share", 6).alias("repeated_share"))


def p8_hosts(spark: SparkSession, d: str) -> DataFrame:
    out = repetition.host_rates(repetition.repeated_share(table(spark, d, "documents")))
    return out.select("host", "n_docs", "n_fail", F.round("raw_rate", 6).alias("raw_rate"), F.round("shrunk_rate", 6).alias("shrunk_rate"), "host_fails")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_defect_counts, p2_found, p2_word_tables, p2_all_pairs, p3_found, p3_neighbours, p4_found, p4_mix, p4_shares,
    p5_found, p5_report, p5_coverage, p5_alignment, p6_packing, p6_fill, p6_invariants, p7_found, p7_leaks, p7_clean, p8_found, p8_verdicts, p8_repetition, p8_hosts,
)}
