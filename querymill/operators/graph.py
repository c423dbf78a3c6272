"""Retrieval over a typed schema graph: entry points, personalised PageRank, bridges, pruning, expansion.

The graph is (nodes, edges) as DataFrames. Every operator works for many queries at once: state rows are keyed by
query_id, and edges stay inside one database.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators.dedupe import keep_first
from querymill.runtime import cut


def latest_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type): the one built last, of equal ones the heavier."""
    return keep_first(edges, ["src_id", "dst_id", "edge_type"], [F.col("built_at").desc_nulls_last(), F.col("weight").desc_nulls_last(), F.col("metadata").desc_nulls_last()])


def transitions(edges: DataFrame) -> DataFrame:
    """``src, dst, p``: weights of parallel edges summed, each source's outgoing weights made to sum to 1."""
    w = edges.groupBy(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).agg(F.sum("weight").alias("w")).where("w > 0")
    out = w.groupBy("src").agg(F.sum("w").alias("t"))
    return w.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))


def personalization(seeds: DataFrame, *, m: int = 5, parents: DataFrame | None = None) -> DataFrame:
    """``query_id, node_id, s`` summing to 1 per query from (query_id, node_id, score) rows: the best ``m``, at least 1e-9 each.

    ``parents`` (node_id, parent_id) adds the table of each seed that refers to another table, at half its weight, where it is no seed itself.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    top = seeds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= m).select("query_id", "node_id", F.greatest("score", F.lit(1e-9)).alias("s"))
    if parents is not None:
        more = top.join(parents, "node_id").groupBy("query_id", "parent_id").agg((F.max("s") / 2).alias("s")).withColumnRenamed("parent_id", "node_id")
        top = top.unionByName(more.join(top, ["query_id", "node_id"], "left_anti").select("query_id", "node_id", "s"))
    total = top.groupBy("query_id").agg(F.sum("s").alias("t"))
    return top.join(total, "query_id").select("query_id", "node_id", (F.col("s") / F.col("t")).alias("s"))


def ppr_step(state: DataFrame, p: DataFrame, seeds: DataFrame, alpha: float) -> DataFrame:
    """One power iteration; mass that leaves nodes without outgoing edges goes back to the seeds."""
    moved = state.join(p, state["node_id"] == p["src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("r") * F.col("p")).alias("r"))
    kept = moved.groupBy("query_id").agg(F.sum("r").alias("k"))
    restart = seeds.join(kept, "query_id", "left").select("query_id", "node_id", (F.col("s") * (1 - alpha * F.coalesce("k", F.lit(0.0)))).alias("r"))
    return moved.select("query_id", "node_id", (alpha * F.col("r")).alias("r")).unionByName(restart).groupBy("query_id", "node_id").agg(F.sum("r").alias("r"))


def ppr(p: DataFrame, seeds: DataFrame, *, alpha: float = 0.7, tol: float = 1e-6, max_rounds: int = 100, fixed: int | None = None) -> DataFrame:
    """Ranks ``query_id, node_id, r`` by power iteration over tables, for graphs of any size; ``p`` has grp, src, dst, p and ``seeds`` grp, query_id, node_id, s.

    A query stops in the round in which its ranks change by less than ``tol`` a node of its group (L1); one that doesn't stop in ``max_rounds`` has its seeds' weights.
    Queries stop by themselves, and no other one is touched. ``fixed`` rounds are done whatever the change.
    """
    p, seeds = cut(p), cut(seeds)
    ends = p.select("grp", F.explode(F.array("src", "dst")).alias("n")).unionByName(seeds.select("grp", F.col("node_id").alias("n"))).distinct()
    nodes = cut(seeds.select("grp", "query_id").distinct().join(ends.groupBy("grp").agg(F.count("*").alias("n")), "grp").select("query_id", "n"))
    p, open_, done = p.select("src", "dst", "p"), seeds.select("query_id", "node_id", "s"), None
    state = open_.select("query_id", "node_id", F.col("s").alias("r"))
    for _ in range(fixed or max_rounds):
        new = cut(ppr_step(state, p, open_, alpha))
        if fixed:
            state = new
            continue
        change = new.alias("a").join(state.alias("b"), ["query_id", "node_id"], "full").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("a.r", F.lit(0.0)) - F.coalesce("b.r", F.lit(0.0)))).alias("l1"))
        stopped = cut(change.join(nodes, "query_id").where(F.col("l1") < tol * F.col("n")).select("query_id"))
        state = new
        if not stopped.isEmpty():
            part = new.join(stopped, "query_id", "left_semi")
            done = part if done is None else done.unionByName(part)
            open_, state = cut(open_.join(stopped, "query_id", "left_anti")), cut(new.join(stopped, "query_id", "left_anti"))
            if open_.isEmpty():
                return done
    if fixed:
        return state
    rest = open_.select("query_id", "node_id", F.col("s").alias("r"))
    return rest if done is None else done.unionByName(rest)


def _iterate(p: pd.DataFrame, seeds: pd.DataFrame, alpha: float, tol: float, max_rounds: int, fixed: int | None) -> pd.DataFrame:
    """The same for all queries of one group in memory."""
    names, at = np.unique(np.concatenate([p["src"], p["dst"], seeds["node_id"]]).astype(str), return_inverse=True)
    src, dst, start = at[: len(p)], at[len(p) : 2 * len(p)], at[2 * len(p) :]
    weight, out = p["p"].to_numpy(), []
    for q, rows in seeds.groupby("query_id", sort=True):
        s = np.zeros(len(names))
        np.add.at(s, start[seeds.index.get_indexer(rows.index)], rows["s"].to_numpy())
        r = s
        for _ in range(fixed or max_rounds):
            moved = np.bincount(dst, r[src] * weight, len(names))
            new = alpha * moved + (1 - alpha * moved.sum()) * s
            done = np.abs(new - r).sum() < tol * len(names)
            r = new
            if done and not fixed:
                break
        else:
            r = r if fixed else s
        keep = r > 0
        out.append(pd.DataFrame({"query_id": q, "node_id": names[keep], "r": r[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "node_id": [], "r": []})


def ppr_by_group(p: DataFrame, seeds: DataFrame, *, alpha: float = 0.7, tol: float = 1e-6, max_rounds: int = 100, fixed: int | None = None, local_edges: int = 500_000) -> DataFrame:
    """Ranks as :func:`ppr` gives them, for graphs that fall into groups (databases).

    A group of at most ``local_edges`` edges and seeds is solved by one task; the larger ones, each by itself, take the loop over tables. Both follow one rule.
    """
    sizes = p.groupBy("grp").count().unionByName(seeds.groupBy("grp").count()).groupBy("grp").agg(F.sum("count").alias("n"))
    large = cut(sizes.where(F.col("n") > local_edges).select("grp"))
    kind = seeds.schema["query_id"].dataType.simpleString()
    solve = lambda q, e: q.groupBy("grp").cogroup(e.groupBy("grp")).applyInPandas(lambda s, e: _iterate(e, s, alpha, tol, max_rounds, fixed), f"query_id {kind}, node_id string, r double")
    if large.isEmpty():
        return solve(seeds, p)
    big = lambda x: x.join(large, "grp", "left_semi")
    rest = lambda x: x.join(large, "grp", "left_anti")
    return solve(rest(seeds), rest(p)).unionByName(ppr(big(p), big(seeds), alpha=alpha, tol=tol, max_rounds=max_rounds, fixed=fixed))


def ranked(scores: DataFrame, *, threshold: float = 0.0, cap: int = 20) -> DataFrame:
    """Scores (query_id, node_id, score) at or above the threshold, the best ``cap`` per query, with their ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    return scores.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def gap_pruned(hits: DataFrame, *, ratio: float | Column = 3.0, keep: int = 2) -> DataFrame:
    """Hits before the first fall of the score by more than ``ratio``; the first ``keep`` always stay."""
    order = Window.partitionBy("query_id").orderBy("rank")
    gap = (F.col("rank") > keep) & (F.lag("score").over(order) > ratio * F.col("score"))
    marked = hits.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0)))
    return marked.withColumn("gone", F.max("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("gone = 0").drop("gap", "gone")


def bridge_tables(hits: DataFrame, fk_edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables that retrieved columns refer to and that are missing: ``query_id, node_id, score`` at half the least score, their columns at 0.8 of that.

    ``columns`` has (node_id, parent_id); ``fk_edges`` has (src, dst) between columns.
    """
    least = hits.groupBy("query_id").agg((F.min("score") / 2).alias("s"))
    target = hits.join(fk_edges, hits["node_id"] == fk_edges["src"]).select("query_id", F.col("dst").alias("node_id")).join(columns, "node_id").select("query_id", F.col("parent_id").alias("node_id")).distinct()
    missing = target.join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").join(least, "query_id")
    below = missing.withColumnRenamed("node_id", "parent_id").join(columns, "parent_id").select("query_id", "node_id", (F.col("s") * 0.8).alias("score")).join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return missing.select("query_id", "node_id", F.col("s").alias("score")).unionByName(below)


def expand(tables: DataFrame, links: DataFrame, *, depth: int = 1) -> DataFrame:
    """``query_id, table_id, hops``: tables within ``depth`` references of the start tables (query_id, table_id), start included at 0.

    ``links`` (a, b) must hold both directions.
    """
    seen = tables.select("query_id", "table_id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for h in range(1, depth + 1):
        reached = front.join(links, front["table_id"] == links["a"]).select("query_id", F.col("b").alias("table_id")).distinct()
        front = reached.join(seen, ["query_id", "table_id"], "left_anti").withColumn("hops", F.lit(h))
        if h < depth:
            front = cut(front)
        seen = seen.unionByName(front)
    return seen
