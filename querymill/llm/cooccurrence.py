"""Pairs of items that stand together in a record far more often than chance.

A record is a basket with a left and a right set of items (for pairs within one set, both are the same
set). Ordinary baskets give their pairs where they are read. A basket with more pairs than ``block`` is
split: both sides are cut into chunks, the chunk pairs are spread over the cluster, and each task
multiplies out its chunk pairs only; nothing is capped. Pairs are counted with partial aggregation, so
a pair that every basket has costs one row per task.

Each side carries one marker that stands in every basket. The pair of an item and the marker counts the
item's records and the pair of both markers counts all records, so one aggregation yields all four counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.runtime import cut

MARK = "\x00"


def _chunks(items: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.slice(items, s, size))


def basket_pairs(baskets: DataFrame, *, left: str, right: str, chunk: int = 256) -> DataFrame:
    """``left_item, right_item``: one row per basket and pair, markers included.

    Items are taken as given; null items are left out and an item twice on a side counts once. Null sides are empty.
    """
    def side(c):
        items = F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))
        return F.concat(F.array(F.lit(MARK)), items)

    rows = baskets.select(side(left).alias("l"), side(right).alias("r"))
    huge = (F.size("l") > chunk) | (F.size("r") > chunk)
    ordinary = rows.where(~huge)
    split = rows.where(huge).select(F.explode(_chunks(F.col("l"), chunk)).alias("l"), "r").select("l", F.explode(_chunks(F.col("r"), chunk)).alias("r"))
    # chunk pairs are bounded in size, so any placement by their content is balanced
    split = split.repartition(F.xxhash64("l", "r"))
    both = ordinary.unionByName(split)
    return both.select(F.explode("l").alias("left_item"), "r").select("left_item", F.explode("r").alias("right_item"))


def association(baskets: DataFrame, *, left: str, right: str, min_count: int = 8, min_lift: float | None = None,
                chunk: int = 256) -> DataFrame:
    """``left_item, right_item, n_both, n_left, n_right, n, lift, npmi`` for pairs in at least ``min_count`` baskets.

    ``lift`` is how many times more often than chance the pair stands together; with ``min_lift`` only
    pairs with n_both * n >= min_lift * n_left * n_right remain, compared in whole numbers. No pair of fewer
    baskets is left out of the counts of its items. ``min_count`` must be 1 or more. An empty table gives no rows.
    """
    counted = basket_pairs(baskets, left=left, right=right, chunk=chunk).groupBy("left_item", "right_item").agg(F.count("*").alias("k"))
    # an item of a kept pair has as many baskets as the pair at least, so its own count is kept, too
    kept = cut(counted.where((F.col("k") >= min_count) | ((F.col("left_item") == MARK) & (F.col("right_item") == MARK))))
    pairs = kept.where((F.col("left_item") != MARK) & (F.col("right_item") != MARK)).withColumnRenamed("k", "n_both")
    lefts = kept.where((F.col("left_item") != MARK) & (F.col("right_item") == MARK)).select("left_item", F.col("k").alias("n_left"))
    rights = kept.where((F.col("left_item") == MARK) & (F.col("right_item") != MARK)).select("right_item", F.col("k").alias("n_right"))
    total = kept.where((F.col("left_item") == MARK) & (F.col("right_item") == MARK)).select(F.col("k").alias("n"))
    # the total is one row by construction
    out = pairs.join(lefts, "left_item").join(rights, "right_item").join(F.broadcast(total))
    p = F.col("n_both") / F.col("n")
    lift = F.col("n_both") * F.col("n") / (F.col("n_left") * F.col("n_right"))
    if min_lift is not None:
        out = out.where(F.col("n_both").cast("decimal(38,0)") * F.col("n") >= F.col("n_left").cast("decimal(38,0)") * F.col("n_right") * F.lit(min_lift))
    return out.select("left_item", "right_item", "n_both", "n_left", "n_right", "n", lift.alias("lift"), F.when(p < 1, F.log(lift) / -F.log(p)).alias("npmi"))
