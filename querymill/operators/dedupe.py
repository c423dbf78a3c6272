"""One row for each key where a record was delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str, columns: list[str], *, max_broadcast: int = 500_000) -> DataFrame:
    """``key`` and ``columns`` of the row with the largest ``order`` for each key; rows without key are left out.

    Equal or null orders are broken by the values themselves, so the choice is the same on every run.
    The keys that come more than once are found first, from the key column alone. Where they are at most ``max_broadcast``, they are
    broadcast: their rows alone are shuffled, and all others stay where they are read. Beyond that every row is aggregated by key.
    """
    rows = rows.where(F.col(key).isNotNull()).select(key, *dict.fromkeys([order, *columns]))
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in columns])).alias("m")
    one = lambda some: some.groupBy(key).agg(best).select(key, *[f"m.{c}" for c in columns])
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key).limit(max_broadcast + 1).toArrow()
    if twice.num_rows > max_broadcast:
        return one(rows)
    single = rows.select(key, *columns)
    if not twice.num_rows:
        return single
    again = rows.sparkSession.createDataFrame(twice).select(F.col(key).cast(rows.schema[key].dataType).alias(key))
    return single.join(F.broadcast(again), key, "left_anti").unionByName(one(rows.join(F.broadcast(again), key, "left_semi")))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``; nulls in a key are one key. Ties in ``order`` are the caller's to break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
