"""Retrieval and run metrics, a row per example first and grouped reports of those rows after.

Gold and retrieved sets are arrays. Empty gold has recall 1 and NDCG 1, empty retrieved has precision 0; a role
that an example doesn't have is null and left out of averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(gold: Column, got: Column) -> Column:
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(gold, got)) / F.size(gold))


def precision(gold: Column, got: Column) -> Column:
    return F.when(F.size(got) == 0, 0.0).otherwise(F.size(F.array_intersect(gold, got)) / F.size(got))


def f1(r: Column, p: Column) -> Column:
    return F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0)


def ndcg(gold: Column, ranked: Column, k: int) -> Column:
    """Binary gain 1 / log2(rank + 1) of the first ``k``, over the best possible."""
    gain = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    got = gain(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1 / F.log2(i + 2.0)).otherwise(0.0)))
    best = gain(F.transform(F.slice(gold, 1, k), lambda x, i: 1 / F.log2(i + 2.0)))
    return F.when(F.size(gold) == 0, 1.0).otherwise(got / best)


def reciprocal_rank(gold: Column, ranked: Column) -> Column:
    first = F.array_min(F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1 / first, F.lit(0.0))


def hit_at(gold: Column, ranked: Column, k: int) -> Column:
    return F.when(F.size(F.array_intersect(gold, F.slice(ranked, 1, k))) > 0, 1.0).otherwise(0.0)


def report(rows: DataFrame, sets: list[list[str]], metrics: dict[str, Column]) -> DataFrame:
    """One pass over the rows for all groupings (GROUPING SETS); ``grouping`` names the columns that a row is grouped by."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    name = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(name.alias("grouping"), *[m.alias(n) for n, m in metrics.items()])
    return out.select("grouping", *dims, *metrics)
