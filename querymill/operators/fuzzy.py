"""Fuzzy equality of texts: built-in tests first, sequence matching in Arrow batches for the pairs that can still reach the bound."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column, *, least: float = 0.75) -> Column:
    """1 for equal texts (case aside), shorter / longer where one holds the other, else the matching ratio; null under ``least``.

    A ratio is at most 2 * shorter / (sum of lengths); pairs that can't reach ``least`` never leave the JVM's view.
    An empty text is held by every text and scores 0. Null texts give null.
    """
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    n, m = F.length(x), F.length(y)
    reach = 2 * F.least(n, m) >= F.lit(least) * (n + m)
    candidates = F.when(reach & (x != y) & ~x.contains(y) & ~y.contains(x), x)
    score = F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), F.least(n, m) / F.greatest(n, m)).otherwise(_ratio(candidates, y))
    return F.when(score >= least, score)


#: Characters that are counted one by one, and the digits together, for an upper bound of what two texts share.
LETTERS = ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "w", "x", "y", "z", " ", "0123456789")


def _letters(text: Column) -> Column:
    """How many characters of each of LETTERS a text has, then how many others."""
    counts = [F.length(text) - F.length(F.translate(text, x, "")) for x in LETTERS]
    return F.array(*counts, F.length(text) - reduce(add, counts))


def value_matches(questions: DataFrame, values: DataFrame, *, top: int = 5, least: float = 0.75) -> DataFrame:
    """``query_id, col, value, score, rank``: values of a catalog that a question's candidates name.

    ``questions`` has query_id, db_id and candidates (array); ``values`` has db_id, col, value. Each distinct candidate meets each distinct
    value of its database whose length and letters allow a score of ``least``; both bounds lose no pair, as a text that holds another
    one and a matching ratio share ``least`` of all characters.
    """
    from querymill.operators.retrieval import top_k

    fold = lambda c: F.lower(F.trim(c))
    q = questions.select("query_id", "db_id", F.explode("candidates").alias("c")).select("query_id", "db_id", fold(F.col("c")).alias("x")).where("x is not null").distinct()
    v = values.where("value is not null").select("db_id", "col", "value", fold(F.col("value")).alias("y")).distinct()
    # few texts make many pairs: texts are dealt to lanes and values stand in each, in a number of partitions that isn't left to their size
    cores = max(1, questions.sparkSession.sparkContext.defaultParallelism)
    lane = F.pmod(F.xxhash64("x"), F.lit(4 * cores)).cast("int")
    texts = q.select("db_id", "x").distinct().select("db_id", "x", F.length("x").alias("n"), _letters(F.col("x")).alias("a"), lane.alias("lane"))
    names = v.select("db_id", "y").distinct().select("db_id", "y", F.length("y").alias("m"), _letters(F.col("y")).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(4 * cores - 1))).alias("lane"))
    texts, names = (x.repartition(cores, "db_id", "lane") for x in (texts, names))
    n, m = F.col("n"), F.col("m")
    enough = F.lit(least) * (n + m) - 1e-9
    shared = reduce(add, [F.least(F.col("a")[i], F.col("b")[i]) for i in range(len(LETTERS) + 1)])
    near = texts.join(names, ["db_id", "lane"]).where((2 * F.least(n, m) >= enough) & (2 * shared >= enough))
    scored = near.select("db_id", "x", "y", F.round(similarity(F.col("x"), F.col("y"), least=least), 6).alias("score")).where("score is not null")
    best = q.join(scored, ["db_id", "x"]).join(v, ["db_id", "y"]).groupBy("query_id", "col", "value").agg(F.max("score").alias("score")).withColumn("tie", F.concat_ws("|", "col", "value"))
    return top_k(best, top, tie="tie").drop("tie")
