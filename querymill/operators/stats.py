"""Co-occurrence and similarity statistics over (id, token) and (id, element) rows.

Counts are document frequencies: an id counts once per token. Everything is a grouped count and a join on keys; pairs are
made within one id or one shared value only, never by comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def npmi(tokens: DataFrame, elements: DataFrame, *, key: str = "id", min_count: int = 2) -> DataFrame:
    """``token, element, n_both, npmi`` from (key, token) and (key, element) rows.

    N counts the ids that have both a token and an element. Pairs under ``min_count`` and pairs in all ids are left out; npmi is
    rounded to four places. Null tokens and elements are left out; repeated rows count once.
    """
    t = tokens.where("token is not null").select(key, "token").distinct()
    e = elements.where("element is not null").select(key, "element").distinct()
    both = t.select(key).distinct().join(e.select(key).distinct(), key)
    t, e = t.join(both, key, "left_semi"), e.join(both, key, "left_semi")
    pairs = t.join(e, key).groupBy("token", "element").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_count)
    nt, ne = t.groupBy("token").agg(F.count("*").alias("n_token")), e.groupBy("element").agg(F.count("*").alias("n_element"))
    n = both.agg(F.count("*").alias("n"))  # one row
    p = F.col("n_both") / F.col("n")
    score = F.log(p / ((F.col("n_token") / F.col("n")) * (F.col("n_element") / F.col("n")))) / -F.log(p)
    return pairs.join(nt, "token").join(ne, "element").join(F.broadcast(n)).where(F.col("n_both") < F.col("n")).select("token", "element", "n_both", F.round(score, 4).alias("npmi"))


def npmi_scores(queries: DataFrame, candidates: DataFrame, matrix: DataFrame) -> DataFrame:
    """``query_id, candidate_id, score``: the largest npmi of a query token and a candidate element, above 0."""
    hit = queries.join(matrix, "token").join(candidates, "element")
    return hit.groupBy("query_id", "candidate_id").agg(F.max("npmi").alias("score")).where("score > 0")


def pair_jaccard(rows: DataFrame, *, group: str, key: str, item: str, threshold: float) -> DataFrame:
    """``group, item_a, item_b, n_both, jaccard`` (item_a < item_b) of the key sets of items in one group."""
    one = rows.select(group, key, item).where(F.col(item).isNotNull()).distinct()
    n = one.groupBy(group, item).agg(F.count("*").alias("n"))
    a, b = one.withColumnRenamed(item, "item_a"), one.withColumnRenamed(item, "item_b")
    both = a.join(b, [group, key]).where("item_a < item_b").groupBy(group, "item_a", "item_b").agg(F.count("*").alias("n_both"))
    out = both.join(n.select(group, F.col(item).alias("item_a"), F.col("n").alias("n_a")), [group, "item_a"]).join(n.select(group, F.col(item).alias("item_b"), F.col("n").alias("n_b")), [group, "item_b"])
    score = F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return out.select(group, "item_a", "item_b", "n_both", score.alias("jaccard")).where(F.col("jaccard") >= threshold)


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair as two directed rows src, dst."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    ends = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))).alias("e")
    return pairs.select(ends, *rest).select("e.src", "e.dst", *rest)


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared / all elements of two arrays; 0 for two empty ones."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ > 0, F.size(F.array_intersect(a, b)) / all_).otherwise(0.0)


def value_overlap(values: DataFrame, *, threshold: float = 0.2, min_shared: int = 2) -> DataFrame:
    """``db_id, col_a, col_b, n_shared, jaccard, shared`` from (db_id, col, value) rows; ``shared`` lists the five smallest shared values."""
    one = values.where("value is not null").distinct()
    n = one.groupBy("db_id", "col").agg(F.count("*").alias("n"))
    a, b = one.withColumnRenamed("col", "col_a"), one.withColumnRenamed("col", "col_b")
    shared = a.join(b, ["db_id", "value"]).where("col_a < col_b")
    pair = ["db_id", "col_a", "col_b"]
    counts = shared.groupBy(*pair).agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= min_shared)
    first = shared.withColumn("r", F.row_number().over(Window.partitionBy(*pair).orderBy("value"))).where("r <= 5").groupBy(*pair).agg(F.array_sort(F.collect_list("value")).alias("s"))
    both = counts.join(first, pair)
    out = both.join(n.select("db_id", F.col("col").alias("col_a"), F.col("n").alias("n_a")), ["db_id", "col_a"]).join(n.select("db_id", F.col("col").alias("col_b"), F.col("n").alias("n_b")), ["db_id", "col_b"])
    score = F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared"))
    return out.select("db_id", "col_a", "col_b", "n_shared", score.alias("jaccard"), F.array_join("s", "|").alias("shared")).where(F.col("jaccard") >= threshold)


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """An array in double precision and of length 1; null where its length is 0."""
    wide = F.transform(a, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))
