"""From a question to the part of a schema it needs: entry points, boosts, graph retrieval, and the text of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators import graph as G
from querymill.operators.retrieval import cosine_top_k, top_k


def hashed_vector(terms: Column, dim: int = 64) -> Column:
    """A stand-in embedding without a model: counts of an array's terms by the md5 of each, ``dim`` entries; all zero for no terms."""
    slots = F.transform(terms, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def entry_points(queries: DataFrame, nodes: DataFrame, *, m: int = 5, boost: float = 0.3) -> DataFrame:
    """``query_id, node_id, score``: of each query the ``m`` best nodes of its database.

    ``queries`` has query_id, db_id, vec and tokens, ``nodes`` node_id, db_id, vec and synonyms. The max(2 m, 10) nearest by cosine are fetched; one with a
    synonym that is a token gains ``boost``, up to 1, and the best ``m`` remain. Nodes and queries without a vector have no entry points.
    """
    near = cosine_top_k(queries.select("query_id", "db_id", "vec"), nodes.select(F.col("node_id").alias("doc_id"), "db_id", "vec"), k=max(2 * m, 10), same=["db_id"])
    known = near.withColumnRenamed("doc_id", "node_id").join(nodes.select("node_id", "synonyms"), "node_id").join(queries.select("query_id", "tokens"), "query_id")
    named = F.coalesce(F.arrays_overlap(F.transform("synonyms", lambda s: F.lower(F.trim(s))), "tokens"), F.lit(False))
    boosted = known.select("query_id", "node_id", F.when(named, F.least(F.col("score") + boost, F.lit(1.0))).otherwise(F.col("score")).alias("score"))
    return top_k(boosted, m, tie="node_id").drop("rank")


def first_nodes(nodes: DataFrame, *, cap: int = 15) -> DataFrame:
    """``query_id, node_id, score, rank``: where a database has no vector at all, its first nodes by id, with score 0."""
    bare = nodes.groupBy("db_id").agg(F.count("vec").alias("n")).where("n = 0").select("db_id")
    order = Window.partitionBy("db_id").orderBy("node_id")
    return nodes.join(bare, "db_id", "left_semi").select(F.col("db_id").alias("query_id"), "node_id", F.lit(0.0).alias("score"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= cap)


def value_boosts(matches: DataFrame, *, column: float = 0.5, table: float = 0.3) -> DataFrame:
    """``query_id, node_id, boost`` of matched cell values (query_id, node_id, parent_id, score): half of the score for the column, 0.3 of the best for its table."""
    cols = matches.groupBy("query_id", "node_id").agg((F.max("score") * column).alias("boost"))
    return cols.unionByName(matches.groupBy("query_id", F.col("parent_id").alias("node_id")).agg((F.max("score") * table).alias("boost")))


def boosted(points: DataFrame, boosts: DataFrame) -> DataFrame:
    """Entry points with boosts added, up to 1; nodes with a boost alone are entry points, too."""
    both = points.join(boosts, ["query_id", "node_id"], "full")
    return both.select("query_id", "node_id", F.least(F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)), F.lit(1.0)).alias("score"))


def adaptive(scores: DataFrame, n_tables: DataFrame, *, threshold: float = 0.005, cap: int = 15, least: int = 6) -> DataFrame:
    """Scores at or above the threshold, of each query the best min(``cap``, max(``least``, tables of its database)), with their rank and ``n_tables`` (query_id, n_tables)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    return scores.where(F.col("score") >= threshold).join(n_tables, "query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.least(F.lit(cap), F.greatest(F.lit(least), F.col("n_tables"))))


def retrieved(p: DataFrame, seeds: DataFrame, nodes: DataFrame, n_tables: DataFrame, fk: DataFrame, columns: DataFrame, *, fixed: int | None = None) -> DataFrame:
    """``query_id, node_id, score, rank``: ranks over the graph, the adaptive cap, missing tables of references, and the cut at the first gap.

    The gap is 3, and 4.5 for databases of ten tables or more or of four or fewer.
    """
    scores = G.ppr_by_group(p, seeds, fixed=fixed).select("query_id", "node_id", F.round("r", 8).alias("score"))
    hits = G.cut(adaptive(scores.join(nodes.select("node_id"), "node_id", "left_semi"), n_tables).select("query_id", "node_id", "score", "n_tables"))
    more = G.bridge_tables(hits.join(columns.select("node_id"), "node_id", "left_semi"), fk, columns)
    more = more.join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").groupBy("query_id", "node_id").agg(F.round(F.max("score"), 8).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    all_ = hits.select("query_id", "node_id", "score").unionByName(more).withColumn("rank", F.row_number().over(order)).join(n_tables, "query_id")
    ratio = F.when((F.col("n_tables") >= 10) | (F.col("n_tables") <= 4), 4.5).otherwise(3.0)
    return G.gap_pruned(all_, ratio=ratio).select("query_id", "node_id", "score", "rank")


def retrieved_tables(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, db_id, table_name, score, place``: the tables of retrieved nodes in the order of their best node."""
    best = hits.join(nodes.select("node_id", "db_id", "table_name"), "node_id").where("table_name is not null").groupBy("query_id", "db_id", "table_name").agg(F.max("score").alias("score"), F.min("rank").alias("r"))
    order = Window.partitionBy("query_id").orderBy("r", "table_name")
    return best.withColumn("place", F.row_number().over(order)).drop("r")


def visible_columns(tables: DataFrame, hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, place, table_name, column_name, node_id, is_pk, is_fk`` of retrieved tables: retrieved, key and referring columns where any was retrieved, else all."""
    cols = nodes.where("node_type = 'column'").select("db_id", "table_name", "column_name", "node_id", F.coalesce("is_pk", F.lit(False)).alias("is_pk"), F.coalesce("is_fk", F.lit(False)).alias("is_fk"))
    found = tables.join(cols, ["db_id", "table_name"]).join(hits.select("query_id", "node_id", F.lit(1).alias("hit")), ["query_id", "node_id"], "left")
    w = Window.partitionBy("query_id", "table_name")
    return found.withColumn("any", F.max("hit").over(w)).where(F.col("any").isNull() | F.col("hit").isNotNull() | F.col("is_pk") | F.col("is_fk")).select("query_id", "place", "table_name", "column_name", "node_id", "is_pk", "is_fk")


def prompt_context(shown: DataFrame, links: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``query_id, context``: CREATE TABLE lines of :func:`visible_columns` in order, the references (src, dst node ids) that leave or reach a shown column, and hints (query_id, hint)."""
    name = F.concat("column_name", F.when(F.col("is_pk"), " [PK]").otherwise(""), F.when(F.col("is_fk"), " [FK]").otherwise(""))
    line = F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" ("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_name", name.alias("s")))), lambda x: x["s"]), ", "), F.lit(");"))
    tables = shown.groupBy("query_id", "place", "table_name").agg(line.alias("line")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("tables"))
    ends = links.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"), F.concat(F.lit("-- "), "src", F.lit(" = "), "dst").alias("ref"))
    refs = shown.join(ends, "node_id").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), "\n").alias("refs"))
    out = tables.join(refs, "query_id", "left")
    if hints is None:
        return out.select("query_id", F.concat_ws("\n", "tables", "refs").alias("context"))
    told = hints.groupBy("query_id").agg(F.concat(F.lit("Value hints:\n"), F.array_join(F.array_sort(F.collect_set("hint")), "\n")).alias("hints"))
    return out.join(told, "query_id", "left").select("query_id", F.concat_ws("\n", "tables", "refs", "hints").alias("context"))


def with_neighbours(chunks: DataFrame, expanded: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, chunk_type, table_name, content, first``: retrieved chunks (``found``) and those of expanded tables, each once; the retrieved ones keep their place."""
    key = ["query_id", "chunk_type", "table_name", "content"]
    more = chunks.join(expanded, ["db_id", "table_name"]).select(*key, F.lit(1).alias("first"))
    return found.select(*key, F.lit(0).alias("first")).unionByName(more).groupBy(*key).agg(F.min("first").alias("first"))
