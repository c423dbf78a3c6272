"""Lineage cuts and size checks that hold on a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local master without that setting (tests) gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="querymill-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage ended: lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hashed_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``df``: the ones whose hashed key is smallest, in that order.

    Where the table is much larger, only a share of the hashes that holds about four times as many rows is
    looked at, so the tasks together keep and send a bounded number of rows, however many tasks there are.
    """
    n, wide = df.count(), 1 << 40
    place = F.pmod(F.xxhash64(key), F.lit(wide))
    few = df.where(place < int(wide * 4 * limit / n)) if n > 4 * limit else df
    return few.orderBy(place, key).limit(limit)


class TooLarge(ValueError):
    """A side that must be small is larger than its stated bound."""


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a table that is small by definition; raises TooLarge beyond ``limit`` rows."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise TooLarge(f"{what} has more than {limit} rows")
    return rows
